"""Similarity of vectors inside groups, block against block, and alignment of fingerprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one block; a group of n rows is compared in (n / BLOCK) squared steps of one matrix product each.
BLOCK = 2000


def _links(threshold: float):
    def links(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        x = np.array(part["v"].tolist(), np.float64).reshape(len(part), -1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        left, right = (part["block"] == i).to_numpy(), (part["block"] == j).to_numpy()
        near = np.round(np.clip(x[left] @ x[right].T, 0, 1), 6) >= threshold
        ids = part["id"].to_numpy()
        near &= ids[left][:, None] != ids[right][None, :]
        out = [pd.DataFrame({"id": ids[left], "links": near.sum(1)})]
        if i != j:
            out.append(pd.DataFrame({"id": ids[right], "links": near.sum(0)}))
        return pd.concat(out)

    return links


def cosine_links(vectors: DataFrame, key: str, group: str, vector: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """id, links: how many other vectors of its group a vector has at a cosine of at least `threshold`.

    Groups of any size are cut into blocks by a hash of the key; every pair of blocks is one task, so no task holds more than
    two blocks and no pairs are written. Null vectors have no links, zero vectors have cosine 0.
    """
    sizes = vectors.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = vectors.join(sizes, group).select(F.col(group).alias("g"), F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), "blocks").cast("int").alias("block"), "blocks").where("v is not null and g is not null")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("g", "id", "v", "block", other)
    pairs = rows.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "v", "block")
    return pairs.groupBy("g", "i", "j").applyInPandas(_links(threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def best_alignment(a: np.ndarray, b: np.ndarray, reach: int = 400, step: int = 4, least: int = 16) -> float | None:
    """Least mean number of differing bits over the offsets -reach..reach at which at least `least` numbers overlap."""
    best = None
    for offset in range(-reach, reach + 1, step):
        x, y = (a[offset:], b) if offset >= 0 else (a, b[-offset:])
        n = min(len(x), len(y))
        if n >= least:
            m = float(np.bitwise_count(x[:n] ^ y[:n]).mean())
            best = m if best is None or m < best else best
    return best


def _align(frames):
    for frame in frames:
        to = lambda v: np.asarray(v, np.int64).astype(np.uint32)
        frame["hamming"] = [best_alignment(to(x), to(y)) if x is not None and y is not None else None for x, y in zip(frame["a"], frame["b"])]
        yield frame[["id", "hamming"]]


def alignments(pairs: DataFrame) -> DataFrame:
    """id, hamming of rows with id and two arrays of unsigned 32-bit numbers a and b; null where they never overlap enough."""
    return pairs.select("id", "a", "b").mapInPandas(_align, "id long, hamming double")


def pairs_of(rows: DataFrame, key: str, group: str, threshold: float, vector: str | None = None, seconds: str | None = None) -> DataFrame:
    """id, links: the partners of each row in its group, by cosine of its vectors, or, with `seconds`, by a least length of both.

    The kind of input decides: vectors are compared in blocks; lengths only need counting, as every long row is a partner.
    """
    if (vector is None) == (seconds is None):
        raise ValueError("give either vectors or seconds")
    if vector is not None:
        return cosine_links(rows, key, group, vector, threshold)
    long = rows.where(F.col(seconds) >= threshold)
    n = long.groupBy(F.col(group).alias("_g")).agg((F.count("*") - 1).alias("links"))
    return long.join(n, long[group].eqNullSafe(n["_g"])).select(F.col(key).alias("id"), "links")
