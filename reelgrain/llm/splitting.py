"""Splitting oversized texts at natural boundaries: all greedy cuts at once by pointer doubling.

Every boundary of a text is joined to the boundary at which the piece that begins `overlap` characters before it ends: the
farthest strong one (end of a sentence, or of a segment before a pause) in the latter half of what the piece may hold, else
the farthest end of a segment; squaring the successor table marks, in as many rounds as the
logarithm of the number of pieces, every boundary that the greedy cutting reaches from the text's start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrain.llm.records import placed_segments
from reelgrain.llm.rolling import code_points

#: Characters after which a sentence has ended, if a blank or the end of the text follows.
SENTENCE_ENDS = ".?!。？！…"
#: Seconds without speech that make the end of a segment a strong boundary.
PAUSE = 1.0


def greedy_cuts(ends: np.ndarray, length: int, limit: int, overlap: int, strong: np.ndarray | None = None) -> np.ndarray:
    """The ends of the pieces of a text of `length` characters, given its sorted natural boundaries.

    Each piece is the longest that fits and ends at a boundary; among those of `strong`, if given, where one lies in the
    latter half of the piece's new characters. Where two boundaries lie so far apart that none fits, cuts are made at the limit.
    """
    step = limit - overlap
    ends = np.unique(np.concatenate([ends[(ends > overlap) & (ends < length)], [length]]))
    # forced boundaries wherever no natural one can be reached from the one before
    known = np.concatenate([[overlap], ends])
    gaps = np.diff(known)
    wide = np.flatnonzero(gaps > step)
    forced = [np.arange(known[i] + step, known[i] + gaps[i], step) for i in wide]
    ends = np.unique(np.concatenate([ends, *forced])).astype(np.int64)
    n = len(ends)
    # places in the table: 0 is the start (as if a piece had ended at `overlap`), i + 1 is ends[i]
    reach = np.concatenate([[limit], ends + step])
    succ = np.searchsorted(ends, reach, side="right")
    if strong is not None and len(strong):
        best = np.flatnonzero(np.isin(ends, strong))
        last = np.searchsorted(ends[best], reach, side="right") - 1
        at = best[np.maximum(last, 0)] if len(best) else np.zeros(n + 1, np.int64)
        near = (last >= 0) & (ends[at] > reach - step / 2) & (reach < length) & (len(best) > 0)
        succ = np.where(near, at + 1, succ)
    succ[-1] = n
    on = np.zeros(n + 1, bool)
    on[0] = True
    while True:
        marks = succ[on]
        if on[marks].all():
            break
        on[marks] = True
        succ = succ[succ]
    on[0] = False
    return ends[np.flatnonzero(on) - 1]


def natural_ends(text: str, segment_ends: np.ndarray, before_pause: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places after which the text may be cut: the ends of sentences and segments, and those of them that are strong."""
    codes = code_points(text)
    after = np.isin(codes, np.array([ord(c) for c in SENTENCE_ENDS], np.uint32))
    after[:-1] &= codes[1:] == 32
    sentences = np.flatnonzero(after) + 1
    strong = sentences if before_pause is None else np.union1d(sentences, segment_ends[before_pause])
    return np.union1d(sentences, segment_ends), strong


def _cut(limit: int, overlap: int, with_text: bool):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, numbers, firsts, lasts, texts = [], [], [], [], []
            for row in frame.itertuples(index=False):
                text = " ".join(row.parts)
                if len(text) > limit:
                    lengths = np.fromiter((len(p) + 1 for p in row.parts), np.int64, len(row.parts))
                    ends, strong = natural_ends(text, np.cumsum(lengths) - 1, np.asarray(row.pauses, bool))
                    ends = greedy_cuts(ends, len(text), limit, overlap, strong)
                else:
                    ends = np.array([len(text)])
                starts = np.concatenate([[0], ends[:-1] - overlap])
                ids += [row.video_id] * len(ends)
                numbers += range(1, len(ends) + 1)
                firsts += starts.tolist()
                lasts += ends.tolist()
                texts += [text[a:b] for a, b in zip(starts, ends)] if with_text else [None] * len(ends)
            yield pd.DataFrame({"video_id": ids, "piece_no": numbers, "first": firsts, "last": lasts, "text": texts})

    return cut


def pieces(captions: DataFrame, limit: int = 4000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """video_id, piece_no, first, last, text: the record's characters [first, last) in pieces of at most `limit`.

    Consecutive pieces share exactly `overlap` characters (0 <= overlap < limit / 2). A record that fits is one piece; the
    text is kept whole. A pause is a second or more between the end of a segment and the start of the next; a segment whose end
    is null, before its start or missing has none after it. Nulls, empty texts and repeated rows as in the definition of the record; empty input gives no rows.
    """
    if not 0 <= 2 * overlap < limit:
        raise ValueError("the overlap must be less than half the limit")
    if "end" not in captions.columns:
        captions = captions.withColumn("end", F.lit(None).cast("double"))
    parts = F.sort_array(F.collect_list(F.struct("off", "text", "start", "end"))).alias("s")
    rows = placed_segments(captions, "end").groupBy("video_id").agg(parts)
    after = F.transform("s", lambda x, i: F.get("s", i + 1)["start"] - F.when(x["end"] >= x["start"], x["end"]))
    rows = rows.select("video_id", F.transform("s", lambda x: x["text"]).alias("parts"), F.transform(after, lambda x: F.coalesce(x >= PAUSE, F.lit(False))).alias("pauses"))
    return rows.mapInPandas(_cut(limit, overlap, with_text), "video_id string, piece_no int, first long, last long, text string")


def oversized(captions: DataFrame, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """The videos whose record had to be cut."""
    return pieces(captions, limit, overlap, with_text=False).where("piece_no = 2").select("video_id")
