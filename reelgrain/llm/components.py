"""Consolidating pairwise matches into groups: union-find on a two-dimensional grid of edge blocks.

Vertices are hashed into `side` blocks, edges into the cells of the grid of block pairs. Every cell runs its own
union-find and gives each of its vertices the least vertex of its piece. A vertex meets at most 2 * side cells (its row
and its column), so exchanging its representatives gathers at most that many values, however many edges it has. Where
they differ, the links between them are the edges of the next, smaller round; a vertex that represents nothing leaves
with its least representative as parent. When no edges are left the parents are stable, and are followed back through
the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrain.storage import drop, materialize

#: Edges that one cell may hold on average; the grid's side follows from the number of edges.
EDGES_PER_CELL = 500_000


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each vertex 0..n-1 the least vertex linked with it: hooking roots together and pointer jumping."""
    parent = np.arange(n)
    while True:
        pa, pb = parent[a], parent[b]
        lo, hi = np.minimum(pa, pb), np.maximum(pa, pb)
        open_ = lo != hi
        if not open_.any():
            return parent
        np.minimum.at(parent, hi[open_], lo[open_])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _cell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas on a partition of whole cells: (v, rep) for every vertex.

    Cells that share a partition are joined on the way, which links no more than their edges do.
    """
    parts = [f for f in frames if len(f)]
    if not parts:
        return
    edges = pd.concat(parts, ignore_index=True)
    codes, names = pd.factorize(pd.concat([edges["u"], edges["v"]], ignore_index=True))
    order = np.argsort(names.to_numpy(object) if hasattr(names, "to_numpy") else names, kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    codes = rank[codes]
    root = _roots(codes[: len(edges)], codes[len(edges) :], len(names))
    names = np.asarray(names, object)[order]
    yield pd.DataFrame({"v": names, "rep": names[root]})


def connected_groups(links: DataFrame, source: str, target: str, edges_per_cell: int = EDGES_PER_CELL) -> DataFrame:
    """vertex, group: of every vertex with a link the least vertex linked with it directly or indirectly.

    links may hold repeats, both directions, self-links and nulls; the latter two link nothing. Vertices are compared
    as strings by code point. No links give no rows.
    """
    a, b = F.col(f"`{source}`").cast("string"), F.col(f"`{target}`").cast("string")
    edges = materialize(links.where(a != b).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    parents = []
    while (n := edges.count()) or not parents:
        side = max(1, int(np.ceil(np.sqrt(2 * n / edges_per_cell))))
        row, column = (F.pmod(F.xxhash64(c), F.lit(side)) for c in ("u", "v"))
        cell = F.concat_ws("-", F.least(row, column), F.greatest(row, column))
        local = edges.repartition(side * (side + 1) // 2, cell).mapInPandas(_cell, "v string, rep string")
        reps = local.groupBy("v").agg(F.sort_array(F.collect_set("rep")).alias("reps"))
        parent = F.when(F.array_contains("reps", F.col("v")), F.col("v")).otherwise(F.col("reps")[0]).alias("parent")
        reps = materialize(reps.select("v", parent, "reps"))
        parents.append(reps.select("v", "parent"))
        others = reps.where(F.size("reps") > 1).select(F.col("reps")[0].alias("u"), F.explode(F.slice("reps", 2, n or 1)).alias("v"))
        done, edges = edges, materialize(others.distinct())
        drop(done)
    labels = parents.pop().select(F.col("v").alias("vertex"), F.col("parent").alias("group"))
    while parents:
        known = labels.select(F.col("vertex").alias("parent"), "group")
        earlier = parents.pop().join(known, "parent", "left")
        labels = materialize(earlier.select(F.col("v").alias("vertex"), F.coalesce("group", "parent").alias("group")))
    return labels


def match_groups(results: DataFrame, grades: tuple[str, ...] = ("critical", "high"), **options) -> DataFrame:
    """video_id, group_id over the rows whose grade, ignoring letter case and blanks around it, is one of `grades`."""
    serious = results.where(F.lower(F.trim("grade")).isin(*grades))
    groups = connected_groups(serious, "source_video_id", "target_video_id", **options)
    return groups.select(F.col("vertex").alias("video_id"), F.col("group").alias("group_id"))
