"""Long exact spans shared between records, by compact windows.

Tokens are the character q-grams of a record, each with a 64-bit min-hash. In the Cartesian tree over these hashes
(ties to the left) a node whose subtree spans at least t = min_chars - q + 1 tokens is a compact window: all runs of
min_chars characters whose least token is that node share one signature. Equal runs have equal tokens and therefore
the same signature under any one hash function, so for exact spans one function already finds every shared run; the
nodes are enumerated as the maximal runs of equal leftmost range minima. Windows meet on their signature, never in
pairs: a signature seen in one video only is dropped; windows of equal content meet on the content's hash; and the
rest, the borders of shared passages, are compared run by run on 128-bit hashes of the min_chars characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgrain.llm.records import blocks, placed_segments
from reelgrain.llm.rolling import Hashes, code_points, leftmost_minima
from reelgrain.storage import drop, materialize

BLOCK_CHARS = 8192
GRAM_CHARS = 64
#: Up to so many video ids of some 20 bytes a semi-join filter may be broadcast; beyond it both sides are shuffled.
BROADCAST_IDS = 500_000
_AT_ONCE = 1 << 20


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in portions of about a million characters."""
    for frame in frames:
        portion = (frame["text"].str.len().cumsum() // _AT_ONCE).to_numpy()
        for k in np.unique(portion):
            yield frame[portion == k]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts in one array, where each text begins, and the lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    return code_points("".join(texts)), np.cumsum(lengths) - lengths, lengths


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _windows(gram: int, run: int, size: int):
    """For mapInPandas: the compact windows of every block."""

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _batches(frames):
            frame = frame[frame["text"].str.len() >= run]
            if frame.empty:
                continue
            codes, begins, lengths = _joined(frame["text"].tolist())
            one, two = Hashes(codes, 0), Hashes(codes, 1)
            grams = np.arange(len(codes) - gram + 1)
            least = one.of(grams, grams + gram)
            at = leftmost_minima(least, run - gram + 1)
            owner = np.repeat(np.arange(len(frame)), lengths)[: len(at)]
            # starts of whole runs inside their own text, and inside the part of the block that no other block has
            own = np.arange(len(at)) - begins[owner]
            good = np.flatnonzero((own + run <= lengths[owner]) & (own < size))
            if not len(good):
                continue
            new = np.ones(len(good), bool)
            new[1:] = (at[good][1:] != at[good][:-1]) | (owner[good][1:] != owner[good][:-1]) | (np.diff(good) != 1)
            first = np.flatnonzero(new)
            s0, s1 = good[first], good[np.append(first[1:], len(good)) - 1]
            who, base = owner[s0], frame["block"].to_numpy(np.int64)[owner[s0]] * size - begins[owner[s0]]
            yield pd.DataFrame({"h": _signed(least[at[s0]]), "c1": _signed(one.of(s0, s1 + run)), "c2": _signed(two.of(s0, s1 + run)), "rel": (at[s0] - s0).astype(np.int32), "vkey": frame["vkey"].to_numpy()[who], "video_id": frame["video_id"].to_numpy()[who], "s0": s0 + base, "n": (s1 - s0 + 1).astype(np.int32)})

    return windows


def _runs(run: int, size: int):
    """For mapInPandas: a row for every run that begins in one of the block's candidate windows."""

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for frame in _batches([whole]):
                codes, begins, _ = _joined(frame["text"].tolist())
                one, two = Hashes(codes, 0), Hashes(codes, 1)
                counts = frame["windows"].str.len().to_numpy(np.int64)
                s0, n, lo, hi = (np.array([w[k] for ws in frame["windows"] for w in ws], np.int64) for k in ("s0", "n", "lo", "hi"))
                row = np.repeat(np.repeat(np.arange(len(frame)), counts), n)
                x = np.repeat(s0 - np.cumsum(n) + n, n) + np.arange(n.sum())
                at = x + (begins - frame["block"].to_numpy(np.int64) * size)[row]
                yield pd.DataFrame({"w1": _signed(one.of(at, at + run)), "w2": _signed(two.of(at, at + run)), "lo": np.repeat(lo, n), "hi": np.repeat(hi, n), "video_id": frame["video_id"].to_numpy()[row], "x": x})

    return runs


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping or touching intervals [a, b) of a video as one."""
    w = Window.partitionBy("video_id").orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.when(before >= F.col("a"), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("video_id", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def shared_intervals(captions: DataFrame, min_chars: int = 200, gram: int = GRAM_CHARS, block: int = BLOCK_CHARS) -> DataFrame:
    """video_id, a, b: the characters [a, b) of the video's record that lie in shared spans, as disjoint intervals.

    A shared span is a run of at least min_chars characters that occurs, character for character, in the record of
    another video. Empty input, and texts shorter than min_chars, give no rows; repeated rows count once; repeats within
    one video are not sharing. Reading twice: the second time only videos with borders of shared passages.
    """
    gram = max(1, min(gram, min_chars))
    overlap = min_chars - 1
    cut = blocks(placed_segments(captions), block, overlap).withColumn("vkey", F.xxhash64("video_id"))
    schema = "h long, c1 long, c2 long, rel int, vkey long, video_id string, s0 long, n int"
    windows = materialize(cut.mapInPandas(_windows(gram, min_chars, block), schema))

    met = windows.groupBy("h").agg(F.min("vkey").alias("lo"), F.max("vkey").alias("hi"), (F.min("c1") != F.max("c1")).alias("several"))
    met = met.where("lo < hi").select("h", "several")
    found = windows.join(met, "h")
    same = ["h", "c1", "c2", "rel", "n"]
    rep = F.min(F.struct("video_id", "s0")).alias("rep")
    contents = found.groupBy(*same, "several").agg(F.min("vkey").alias("lo"), F.max("vkey").alias("hi"), rep)
    contents = materialize(contents.where("lo < hi or several"))
    whole = windows.join(contents.where("lo < hi").select(*same), same, "left_semi")
    whole = materialize(whole.select("video_id", F.col("s0").alias("a"), (F.col("s0") + F.col("n") + overlap).alias("b")))

    # borders: all windows of contents that one video alone has, and one window of each content common to several
    alone = windows.join(contents.where("lo = hi").select(*same, "lo", "hi"), same).select("video_id", "s0", "n", "lo", "hi")
    common = contents.where("lo < hi and several").select("rep.video_id", "rep.s0", "n", "lo", "hi")
    border = materialize(alone.unionByName(common))
    drop(windows, contents)
    in_block = F.floor(F.col("s0") / block).cast("int").alias("block")
    listed = border.groupBy("video_id", in_block).agg(F.collect_list(F.struct("s0", "n", "lo", "hi")).alias("windows"))
    ids = border.select("video_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    again = blocks(placed_segments(captions.join(ids, "video_id", "left_semi")), block, overlap)
    runs = again.join(listed, ["video_id", "block"]).mapInPandas(_runs(min_chars, block), "w1 long, w2 long, lo long, hi long, video_id string, x long")
    runs = materialize(runs)
    drop(border)
    twice = runs.groupBy("w1", "w2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("w1", "w2")
    parts = runs.where("lo = hi").join(twice, ["w1", "w2"], "left_semi")
    parts = parts.select("video_id", F.col("x").alias("a"), (F.col("x") + min_chars).alias("b"))
    return _merged(whole.unionByName(parts))


def shared_segments(captions: DataFrame, min_chars: int = 200, **options) -> DataFrame:
    """segment_id of every segment all of whose characters lie in shared spans of its record."""
    spans = materialize(shared_intervals(captions, min_chars, **options))
    listed = spans.groupBy("video_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    ids = spans.select("video_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    placed = placed_segments(captions.join(ids, "video_id", "left_semi")).select("video_id", "segment_id", "off", "len")
    inside = F.exists("spans", lambda s: (s["a"] <= F.col("off")) & (s["b"] >= F.col("off") + F.col("len")))
    return placed.join(listed, "video_id").where(inside).select("segment_id")


def shared_share(captions: DataFrame, min_chars: int = 200, **options) -> DataFrame:
    """A row per record: video_id, n_chars, n_spans, shared_chars, share and spans (first character and length of each)."""
    spans = shared_intervals(captions, min_chars, **options)
    by = spans.groupBy("video_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("b") - F.col("a")).alias("shared_chars"), F.sort_array(F.collect_list(F.struct(F.col("a").alias("first"), (F.col("b") - F.col("a")).alias("chars")))).alias("spans"))
    size = placed_segments(captions).groupBy("video_id").agg(F.max(F.col("off") + F.col("len")).alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0))
    return size.join(by, "video_id", "left").select("video_id", "n_chars", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), shared.alias("shared_chars"), F.round(shared / F.col("n_chars"), 6).alias("share"), "spans")
