"""Filling containers of fixed capacity with whole texts: bounded-space online packing.

Every partition keeps a fixed number of open containers. A text goes where it leaves least space; where it fits nowhere the
fullest open container is emitted and a new one begun. What is open at a partition's end is handed on to a next round
over fewer partitions, which places the items of the emptier containers anew, largest first, until one round has a
single partition. Only texts above the capacity are split: into full
containers and a rest that is placed like any other.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrain.llm.tokens import VOCABULARY, encoder
from reelgrain.storage import materialize

#: Open containers of a partition, and partitions whose leftovers meet in one partition of the next round.
OPEN, FAN_IN = 64, 64
#: Share of the capacity from which an open container is handed on as it is.
NEARLY_FULL = 0.97
ITEM = "struct<doc_id:bigint,piece_no:int,first_token:bigint,n_tokens:int>"
SCHEMA = f"container_id string, used int, open boolean, items array<{ITEM}>"


class Packer:
    """Best fit into a bounded number of open containers."""

    def __init__(self, capacity: int, most_open: int, prefix: str) -> None:
        self.capacity, self.most_open, self.prefix = capacity, most_open, prefix
        self.free: list[tuple[int, int]] = []  # space left and number of each open container, in order
        self.items: dict[int, list] = {}
        self.made = 0
        self.closed: list[tuple[str, int, bool, list]] = []

    def place(self, size: int, items: list) -> None:
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            left, k = self.free.pop(at)
        else:
            if len(self.free) >= self.most_open:
                self._emit(*self.free.pop(0), False)
            left, k = self.capacity, self.made
            self.made += 1
            self.items[k] = []
        self.items[k] += items
        if left == size:
            self._emit(0, k, False)
        else:
            insort(self.free, (left - size, k))

    def _emit(self, left: int, k: int, still_open: bool) -> None:
        self.closed.append((f"{self.prefix}-{k}", self.capacity - left, still_open, self.items.pop(k)))

    def taken(self) -> pd.DataFrame:
        out, self.closed = self.closed, []
        return pd.DataFrame(out, columns=["container_id", "used", "open", "items"])

    def rest(self) -> pd.DataFrame:
        for left, k in self.free:
            self._emit(left, k, True)
        self.free = []
        return self.taken()


def _pack_texts(capacity: int, most_open: int, vocabulary: str):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        packer = Packer(capacity, most_open, f"0-{TaskContext.get().partitionId()}")
        for frame in frames:
            for doc, text in zip(frame["doc_id"].tolist(), frame["text"].tolist()):
                n = len(encode(text))
                for k, first in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - first)
                    packer.place(size, [{"doc_id": doc, "piece_no": k, "first_token": first, "n_tokens": size}])
            yield packer.taken()
        yield packer.rest()

    return pack


def _pack_open(capacity: int, most_open: int, level: int):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(capacity, most_open, f"{level}-{TaskContext.get().partitionId()}")
        parts = list(frames)
        if not parts:
            return
        waiting = pd.concat(parts, ignore_index=True)  # at most FAN_IN * OPEN containers
        full = waiting["used"] >= NEARLY_FULL * capacity
        units = [(used, list(items)) for used, items in zip(waiting["used"][full], waiting["items"][full])]
        units += [(x["n_tokens"], [x]) for items in waiting["items"][~full] for x in items]
        for size, items in sorted(units, key=lambda u: (-u[0], u[1][0]["doc_id"] or 0, u[1][0]["piece_no"])):
            packer.place(size, items)
        yield packer.taken()
        yield packer.rest()

    return pack


def containers(documents: DataFrame, capacity: int = 2048, most_open: int = OPEN, vocabulary: str = VOCABULARY) -> DataFrame:
    """container_id, used, items: every token of every text in exactly one container of at most `capacity` tokens.

    Partitions are the scan's own, so no text is shuffled. Null and empty texts hold no tokens and are in no container;
    repeated rows are placed as often as they occur; ties go to the older container.
    """
    rows = documents.where("text is not null and text <> ''").select("doc_id", "text")
    parts = rows.rdd.getNumPartitions()
    packed = materialize(rows.mapInPandas(_pack_texts(capacity, most_open, vocabulary), SCHEMA))
    done, level = [packed.where("not open")], 1
    waiting = packed.where("open")
    while True:
        groups = -(-parts // FAN_IN)
        own = F.expr(f"cast(split(container_id, '-')[1] as int) div {FAN_IN}")
        placed = waiting.repartitionByRange(groups, own) if groups > 1 else waiting.coalesce(1)
        packed = materialize(placed.mapInPandas(_pack_open(capacity, FAN_IN * most_open, level), SCHEMA))
        if groups == 1:
            done.append(packed)
            break
        done.append(packed.where("not open"))
        waiting, parts, level = packed.where("open"), groups, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("container_id", "used", (F.lit(capacity) - F.col("used")).alias("unused"), "items")


def contents(packed: DataFrame) -> DataFrame:
    """A row per placed piece: container_id, slot, doc_id, piece_no, first_token, n_tokens, used, unused."""
    rows = packed.select("container_id", "used", "unused", F.posexplode("items").alias("slot", "item"))
    return rows.select("container_id", "slot", "item.*", "used", "unused")


def invariants(packed: DataFrame, capacity: int, waste: float = 0.02) -> DataFrame:
    """One row: texts packed, containers over the capacity, containers whose items don't add up to `used`, texts whose pieces
    don't cover their tokens exactly once, and whether at most `waste` of the space is unused, the emptiest container aside."""
    packed = materialize(packed)
    items = F.aggregate("items", F.lit(0), lambda a, x: a + x["n_tokens"])
    boxes = packed.agg(F.count_if(F.col("used") > capacity).alias("over_capacity"), F.count_if(items != F.col("used")).alias("wrong_sums"), (F.sum("unused") - F.max("unused") <= waste * capacity * F.count("*")).alias("well_filled"))
    pieces = contents(packed).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count("*").alias("k"), F.max("piece_no").alias("last"), F.countDistinct("piece_no").alias("different"))
    broken = (F.col("n") != F.col("end")) | (F.col("k") != F.col("last") + 1) | (F.col("k") != F.col("different"))
    texts = pieces.agg(F.count("*").alias("texts"), F.count_if(broken).alias("broken_texts"))
    both = texts.unionByName(boxes, allowMissingColumns=True)  # a row each
    counts = [F.max(c).alias(c) for c in ("texts", "over_capacity", "wrong_sums", "broken_texts")]
    return both.agg(*counts, F.coalesce(F.bool_and("well_filled"), F.lit(True)).alias("well_filled"))
