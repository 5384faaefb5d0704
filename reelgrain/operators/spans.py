"""Matching spans between two captioned videos and the indicators of their distribution in time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = "pair_id long, start_a double, end_a double, start_b double, end_b double, length double, sample string"


#: Version of the normal form of stored transcripts.
TEXT_VERSION = 2


def greedy_spans(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Spans (first and last line of a, first and last of b) from the cells (line of a, line of b) at which the lines agree.

    In the order of a, a line that is still free starts at its earliest free cell and takes the run of free cells on the
    cell's diagonal, both ways; all lines of the run are used up on both sides.
    """
    if not len(a):
        return []
    diagonal = b - a
    order = np.lexsort((a, diagonal))
    place = np.empty(len(a), np.int64)
    place[order] = np.arange(len(a))
    x, y = a[order], b[order]
    linked = np.zeros(len(a) + 1, bool)  # whether a cell follows the one before it on its diagonal
    linked[1:-1] = (np.diff(x) == 1) & (np.diff(diagonal[order]) == 0)
    used_a, used_b = set(), set()
    out = []
    for k in np.lexsort((b, a)):
        if a[k] in used_a or b[k] in used_b:
            continue
        lo = hi = place[k]
        while linked[lo] and x[lo - 1] not in used_a and y[lo - 1] not in used_b:
            lo -= 1
        while linked[hi + 1] and x[hi + 1] not in used_a and y[hi + 1] not in used_b:
            hi += 1
        used_a.update(x[lo : hi + 1].tolist())
        used_b.update(y[lo : hi + 1].tolist())
        out.append((int(x[lo]), int(x[hi]), int(y[lo]), int(y[hi])))
    return out


def _spans_of(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    found = greedy_spans(cells["a"].to_numpy(np.int64), cells["b"].to_numpy(np.int64))
    return pd.DataFrame([(key[0], *s) for s in found], columns=["pair_id", "a0", "a1", "b0", "b1"])


def match_spans(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """SPAN columns of every pair (pair_id, source, target) over lines (video_id, line, form, start, end, text).

    Lines meet on pair and form, so only agreeing lines are sent to the greedy step; times and the sample come back by a
    join on the ends of the spans. Spans without extent on either side are left out; empty forms agree with nothing.
    """
    some = lines.where("form <> ''").select("video_id", "line", F.xxhash64("form").alias("f1"), F.xxhash64(F.lit(1), "form").alias("f2"))
    left = pairs.join(some.withColumnsRenamed({"video_id": "source", "line": "a"}), "source")
    cells = left.join(some.withColumnsRenamed({"video_id": "target", "line": "b"}), ["target", "f1", "f2"]).select("pair_id", "a", "b")
    found = cells.groupBy("pair_id").applyInPandas(_spans_of, "pair_id long, a0 int, a1 int, b0 int, b1 int").join(pairs, "pair_id")
    for side, video in (("a", "source"), ("b", "target")):
        first = lines.select(F.col("video_id").alias(video), F.col("line").alias(f"{side}0"), F.col("start").alias(f"start_{side}"), F.substring(F.coalesce("text", F.lit("")), 1, 80).alias(f"sample_{side}"))
        last = lines.select(F.col("video_id").alias(video), F.col("line").alias(f"{side}1"), F.col("end").alias(f"end_{side}"))
        found = found.join(first, [video, f"{side}0"]).join(last, [video, f"{side}1"])
    found = found.where("end_a > start_a and end_b > start_b")
    return found.select("pair_id", "start_a", "end_a", "start_b", "end_b", (F.col("end_a") - F.col("start_a")).alias("length"), F.col("sample_a").alias("sample"))


def pair_indicators(pairs: DataFrame, spans: DataFrame) -> DataFrame:
    """Per pair (pair_id, dur_a, dur_b): longest, deviation and thirds; evenness (1 - Gini) and bins of both sides; bins of each half.

    thirds are those of the shorter video, by the middles on side a. In the halves the middles of the second aren't moved, so
    on side a they all fall into its last bin. Pairs without spans have zeros.
    """
    w = Window.partitionBy("pair_id")
    rows = spans.join(pairs, "pair_id").withColumns({"rank": F.row_number().over(w.orderBy("length", "start_a", "start_b")), "n": F.count("*").over(w)})
    mid = lambda s: (F.col(f"start_{s}") + F.col(f"end_{s}")) / 2
    part = lambda m, dur, k: F.least(F.lit(k - 1), F.floor(m / (F.when(dur > 0, dur) / k)))
    shorter, half = F.least("dur_a", "dur_b"), F.col("dur_a") / 2

    def bins(when, dur_a, dur_b):
        return (F.count_distinct(F.when(when, part(mid("a"), dur_a, 10))) + F.count_distinct(F.when(when, part(mid("b"), dur_b, 10)))) / 20

    early, late = F.col("start_a") < half, F.col("start_a") >= half
    thirds = F.greatest(F.lit(0.0), (F.count_distinct(part(mid("a"), shorter, 3)) - 1) / 2)
    by = rows.groupBy("pair_id").agg(
        F.max("length").alias("longest"), F.when(F.max("n") < 2, 0.0).otherwise(F.stddev_pop("length")).alias("deviation"), thirds.alias("thirds"), spread(F.col("length"), "pair_id").alias("evenness"),
        bins(F.lit(True), F.col("dur_a"), F.col("dur_b")).alias("bins"), bins(early, half, half).alias("first_half"), bins(late, half, half).alias("second_half"),
    )
    names = [c for c in by.columns if c != "pair_id"]
    return pairs.select("pair_id").join(by, "pair_id", "left").na.fill(0.0, names)


def normalised_transcripts(documents: DataFrame, version: int = TEXT_VERSION) -> DataFrame:
    """Stored transcripts (segments: array of start, end, text; version) in the normal form; those of this version are skipped."""
    from reelgrain.functions import text as T

    skipped = F.coalesce(F.col("version") >= version, F.lit(False))
    rest = [c for c in documents.columns if c not in ("segments", "version")]
    old = documents.where(skipped).select(*rest, "segments", "version", F.lit(True).alias("skipped"))
    # the form is a function of one text: texts are taken out, brought into the form and put back in their order
    each = documents.where(~skipped).withColumn("_k", F.monotonically_increasing_id()).select("_k", *rest, F.posexplode_outer("segments").alias("_i", "s"))
    each = each.withColumn("t", T.transcript_form(F.col("s.text")))
    one = F.struct("_i", F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("t").alias("text")).alias("s"))
    new = each.groupBy("_k", *rest).agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("_i").isNotNull(), one))), lambda x: x["s"]).alias("segments"))
    return old.unionByName(new.select(*rest, "segments", F.lit(version).alias("version"), F.lit(False).alias("skipped")))


def spread(length: Column, pair: str) -> Column:
    """1 - Gini of the span lengths of a pair (a window aggregate's input is `length`, ranked by `rank` among `n`)."""
    n, total = F.max("n"), F.sum(length)
    gini = F.sum((2 * F.col("rank") - F.col("n") - 1) * length) / (n * total)
    return F.when((n < 2) | (total == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - gini)))


def indicators(spans: DataFrame, pair: str, start: str, length: str, duration: str) -> DataFrame:
    """Longest span, evenness (1 - Gini), deviation of lengths, and coverage of ten bins and of thirds by the spans' middles."""
    w = Window.partitionBy(pair)
    rows = spans.withColumns({"rank": F.row_number().over(w.orderBy(length, start)), "n": F.count("*").over(w)})
    mid = (F.col(start) + F.col(length) / 2) / F.col(duration)
    part = lambda k: F.countDistinct(F.least(F.lit(k - 1), F.floor(mid * k)))
    return rows.groupBy(pair).agg(F.max(length).alias("longest"), spread(F.col(length), pair).alias("evenness"), F.stddev_pop(length).alias("deviation"), (part(10) / 10).alias("bins"), ((part(3) - 1) / 2).alias("thirds"))
