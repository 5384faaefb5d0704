"""Search over parsed titles: one filter of joined conditions, or any of several queries, less the excluded titles."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    professor: str | None = None
    course: str | None = None
    year: int | None = None
    semester: int | None = None
    session: int | None = None
    weeks: tuple[int, int] | None = None

    def condition(self) -> Column | None:
        """All conditions given; rows with a null where one is asked for don't meet it. None if none is given."""
        tests = []
        if self.professor is not None:
            tests.append(F.exists("professor", lambda p: F.contains(p, F.lit(self.professor))))
        if self.course is not None:
            tests.append(F.contains("course", F.lit(self.course)))
        tests += [F.col(c) == v for c, v in (("year", self.year), ("semester", self.semester), ("session", self.session)) if v is not None]
        if self.weeks is not None:
            tests.append(F.col("week").between(*self.weeks))
        return F.coalesce(reduce(and_, tests), F.lit(False)) if tests else None


@dataclass(frozen=True)
class Query:
    filters: Filter = field(default_factory=Filter)
    queries: tuple[Filter, ...] = ()
    exclude_title: tuple[str, ...] = ()


def from_flags(professor=None, course=None, year=None, semester=None, week_from=None, week_to=None) -> Query:
    """A query of one filter; an open end of the weeks is 1 or 16."""
    weeks = (week_from or 1, week_to or 16) if week_from is not None or week_to is not None else None
    return Query(Filter(professor, course, year, semester, weeks=weeks))


def search(titles: DataFrame, query: Query) -> DataFrame:
    """Rows that meet the filter or one of the queries, one per video_id; without any condition all rows as they are."""
    tests = [c for c in (f.condition() for f in (query.filters, *query.queries)) if c is not None]
    rows = titles.where(reduce(or_, tests)).dropDuplicates(["video_id"]) if tests else titles
    for word in query.exclude_title:
        rows = rows.where(~F.coalesce(F.contains("original_title", F.lit(word)), F.lit(False)))
    return rows
