"""Structured parsing of lecture titles: patterns in order of priority, the first that matches decides."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrain.functions import text as T

_NAME, _WORDS, _DEPT = "[가-힣]{2,4}", r"\S+(?:\s+\S+)*?", r"\S+(?:학과|과)"
_WEEK, _SESSION = r"(\d+)주차", r"(\d+)차시"
# Name, pattern and the fields of its groups, in order of priority.
PATTERNS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("semester_explicit", rf"^(\S+)\s+(\d{{4}})\s+([12])학기\s+({_NAME}(?:/{_NAME})*)\s+{_WEEK}\s+{_SESSION}", ("course", "year", "semester", "professor", "week", "session")),
    ("co_teaching", rf"^(\d{{2}}-[12](?:/\d{{2}}-[12])?)\s+({_NAME}(?:/{_NAME})+)\s+({_WORDS})\s+{_WEEK}\s+{_SESSION}(?:\s*\(([^)]+)\))?", ("year_pair", "professor", "course", "week", "session", "department")),
    ("academic_year", rf"^(\d{{4}})학년도\s+([12])학기\s+({_WORDS})\s+{_WEEK}(?:[_\s]*{_SESSION})?(?:[_\s]*[^()\s]+)?(?:\s*\(([^)]+)\))?", ("year", "semester", "course", "week", "session", "professor")),
    ("numbered_prefix", rf"^\d+-\d+[.\s]+\s*({_NAME})\s+({_WORDS})\s+{_WEEK}\s+{_SESSION}(?:-\d+)?(?:\s*\(?([^)]*(?:학과|과))\)?)?", ("professor", "course", "week", "session", "department")),
    ("standard_kr", rf"^({_NAME})\s+(\d{{4}})\s+(?:({_DEPT})\s+)?({_WORDS})\s+{_WEEK}\s+{_SESSION}", ("professor", "year", "department", "course", "week", "session")),
    ("year_prof_course_week", rf"^(\d{{4}})\s+({_NAME})\s+({_WORDS})\s+{_WEEK}(?:\s+{_SESSION})?", ("year", "professor", "course", "week", "session")),
    ("year_course_week_prof", rf"^(\d{{4}})\s+({_WORDS})\s+{_WEEK}(?:[_\s]*{_SESSION})?(?:\s+\S+)*?\s*\(([^)]+)\)", ("year", "course", "week", "session", "professor")),
    ("prof_year_course_week_only", rf"^({_NAME})\s+(\d{{4}})\s+(?:({_DEPT})\s+)?({_WORDS})\s+{_WEEK}", ("professor", "year", "department", "course", "week")),
    ("year_semester_prefix", rf"^(\d{{4}}-[12])\s+({_NAME})\s+(?:({_DEPT})\s+)?({_WORDS})\s+{_WEEK}\s+{_SESSION}", ("year_pair", "professor", "department", "course", "week", "session")),
    ("prof_keyword_course", rf"^({_NAME})\s+(?:특강|OT)\s+({_WORDS})$", ("professor", "course")),
    ("prof_supplementary", rf"^({_NAME})\s+(?:(\d{{4}})\s+)?(?:({_DEPT})\s+)?({_WORDS})\s+(?:OT|특강|핵심영상|보완영상|질문응답|보충)", ("professor", "year", "department", "course")),
    ("dept_first", rf"^({_DEPT})\s+\S+\s+({_WORDS})\s+(\d{{4}})\s+{_WEEK}\s+{_SESSION}(?:\s+\S+)*\s+({_NAME})$", ("department", "course", "year", "week", "session", "professor")),
)

# What is taken from a title that no pattern matches, and words that are no names there.
FALLBACK = {"week": _WEEK, "session": _SESSION, "year": r"(?<!\d)(20\d{2})(?!\d)", "semester": "([12])학기", "department": "([가-힣]+(?:학과|과))"}
_IN_PARENTHESES, _AT_START = rf"\(({_NAME}(?:/{_NAME})*)\)", rf"^(?:\d+[-\s.]*)?({_NAME})\s"
NO_NAMES = ("주차", "차시", "학과", "학기", "학년도", "학년", "학기말", "중간", "기말")

# Decimal digits of all scripts, each ten in order from 0 to 9.
_DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")


def plain_digits(c: Column) -> Column:
    """Digits of any script, which the patterns take too, as ASCII."""
    return F.translate(c, _DIGITS, "0123456789" * (len(_DIGITS) // 10))


def fallback_names(title: Column) -> Column:
    """Names in the first parentheses that hold only names, else the name at the start; words of NO_NAMES are none."""
    names = lambda p: F.filter(T.professor_names(F.regexp_extract(title, "(?U)" + p, 1)), lambda x: ~x.isin(*NO_NAMES))
    return F.when(F.size(names(_IN_PARENTHESES)) > 0, names(_IN_PARENTHESES)).otherwise(names(_AT_START))


def parse(titles: DataFrame, *keep: str) -> DataFrame:
    """video_id, matched_pattern, professor (joined by |), course, year, semester, week, session, department, category, parse_error.

    The number of the matching pattern is found once; each field is then one extraction chosen by it. Null and blank titles
    and titles that no pattern matches are parse errors; of the latter, each field but the course is looked for by itself. Columns to `keep` come last.
    """
    t = F.coalesce("title", F.lit(""))
    which = F.lit(None).cast("int")
    for i, (_, pattern, _) in reversed(list(enumerate(PATTERNS))):
        which = F.when(t.rlike("(?U)" + pattern), F.lit(i)).otherwise(which)
    rows = titles.select("video_id", *keep, t.alias("t"), which.alias("which"))

    def field(name: str) -> Column:
        out = F.when(F.col("which").isNull(), F.regexp_extract("t", "(?U)" + FALLBACK[name], 1)) if name in FALLBACK else F.lit(None).cast("string")
        for i, (_, pattern, fields) in enumerate(PATTERNS):
            if name in fields:
                out = F.when(F.col("which") == i, F.regexp_extract("t", "(?U)" + pattern, fields.index(name) + 1)).otherwise(out)
        return F.nullif(out, F.lit(""))

    professors = F.when(F.col("which").isNull(), fallback_names(F.col("t"))).otherwise(T.professor_names(field("professor")))
    pair = plain_digits(field("year_pair"))
    number = lambda name: plain_digits(field(name)).try_cast("int")
    pair_year = F.when(pair.rlike(r"^\d{4}"), F.substring(pair, 1, 4).try_cast("int")).otherwise(2000 + F.substring(pair, 1, 2).try_cast("int"))
    names = F.when(F.col("which").isNotNull(), F.get(F.array(*[F.lit(p[0]) for p in PATTERNS]), F.coalesce("which", F.lit(0))))
    return rows.select(
        "video_id", names.alias("matched_pattern"), F.concat_ws("|", professors).alias("professor"), field("course").alias("course"),
        F.coalesce(number("year"), pair_year).alias("year"), F.coalesce(number("semester"), F.regexp_extract(pair, r"\d+-([12])", 1).try_cast("int")).alias("semester"),
        number("week").alias("week"), number("session").alias("session"), field("department").alias("department"), T.category(F.col("t")).alias("category"), F.col("which").isNull().alias("parse_error"), *keep,
    )


def match_key(title: Column) -> Column:
    """The form in which file names and titles are compared: NFC, no zero-width characters, blanks or punctuation, lower case."""
    bare = F.regexp_replace(T.composed(title), r"[\x{200B}-\x{200D}\x{FEFF}]", "")
    return F.lower(F.regexp_replace(bare, r"(?U)[\s\-_.,()\[\]?!~]+", ""))


def stem(file: Column) -> Column:
    """A file name without its ending."""
    return F.regexp_replace(file, r"\.[^.]+$", "")


def keys_match(file_key: Column, title_key: Column) -> Column:
    """Whether the key of a file name is that of a title, or its beginning where the name was cut, at 50 characters or more."""
    return (file_key == title_key) | ((F.length(file_key) >= 50) & F.startswith(title_key, file_key))


def near_names(names: DataFrame, most: int = 2) -> DataFrame:
    """name_a, name_b, distance: distinct names within 1 to `most` (1 or 2) edits of each other.

    Strings within k edits share a string that both reach by deleting at most k characters; names meet on these, so no
    pairs are made that have nothing in common.
    """
    shorter = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    n = names.where("name is not null").select(F.col("name").alias("a")).distinct()
    one = shorter(F.col("a"))
    keys = F.array_union(F.array("a"), one)
    if most > 1:
        keys = F.array_union(keys, F.flatten(F.transform(one, shorter)))
    keyed = n.select("a", F.explode(keys).alias("k"))
    pairs = keyed.join(keyed.withColumnRenamed("a", "b"), "k").where("a < b").select("a", "b").distinct()
    pairs = pairs.select(F.col("a").alias("name_a"), F.col("b").alias("name_b"), F.levenshtein("a", "b", most).alias("distance"))
    return pairs.where(F.col("distance").between(1, most))
