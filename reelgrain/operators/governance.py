"""Writes that people decide: whitelists, baseline phrases and the channels of professors, as merges of a table with a request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.alias("a").join(b.alias("b"), cond, "left")


def add_unique(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The requested rows with `state`: added, or duplicate where the key is there; a key asked for twice is added once."""
    asked = new.dropDuplicates(keys)
    known = old.select(*keys).distinct().withColumn("_old", F.lit(True))
    return _null_safe(asked, known, keys).select("a.*", F.when(F.col("_old"), "duplicate").otherwise("added").alias("state"))


def remove(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `old` whose key isn't among those to remove; keys that aren't there remove nothing."""
    known = gone.select(*keys).distinct().withColumn("_gone", F.lit(True))
    return _null_safe(old, known, keys).where(F.col("_gone").isNull()).select("a.*")


def add_phrases_counting(old: DataFrame, new: DataFrame, count: str = "n") -> DataFrame:
    """Phrases with their counts, one more for each that is added again; new ones begin at 1. Keys are all columns but the count."""
    keys = [c for c in old.columns if c != count]
    more = new.select(*keys).distinct().withColumn(count, F.lit(1).cast("long"))
    return old.select(*keys, F.col(count).cast("long").alias(count)).unionByName(more).groupBy(*keys).agg(F.sum(count).alias(count))


def whitelist_pairs(results: DataFrame, requests: DataFrame) -> DataFrame:
    """results (id, review_status, reviewed_by, reviewed_at) with the requested pairs (id, actor, at) as false positives."""
    r = requests.select("id", "actor", "at").dropDuplicates(["id"])
    rows = results.join(r, "id", "left")
    hit = F.col("actor").isNotNull()
    return rows.select("id", F.when(hit, "FALSE_POSITIVE").otherwise(F.col("review_status")).alias("review_status"), F.coalesce("actor", "reviewed_by").alias("reviewed_by"), F.coalesce("at", "reviewed_at").alias("reviewed_at"))


def reset_pairs(results: DataFrame, requests: DataFrame) -> DataFrame:
    """results with the requested pairs, where they are false positives, unreviewed again."""
    rows = results.join(requests.select("id").distinct().withColumn("_r", F.lit(True)), "id", "left")
    hit = F.col("_r").isNotNull() & (F.col("review_status") == "FALSE_POSITIVE")
    none = lambda c: F.when(~F.coalesce(hit, F.lit(False)), F.col(c)).alias(c)
    return rows.select("id", F.when(hit, "UNREVIEWED").otherwise(F.col("review_status")).alias("review_status"), none("reviewed_by"), none("reviewed_at"))


def missing_keys(old: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Requested keys that the table doesn't have: an error for those who asked."""
    return asked.select(*keys).distinct().join(old.select(*keys), keys, "left_anti")


def map_professors(members: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (professor_id, alias) with `state`: conflict where another professor owns the channel, else added or there.

    Of several professors asking for one free channel the first by name gets it.
    """
    owner = members.groupBy("alias").agg(F.min("professor_id").alias("owner"))
    first = requests.groupBy("alias").agg(F.min("professor_id").alias("first"))
    rows = requests.distinct().join(owner, "alias", "left").join(first, "alias")
    state = F.when(F.col("owner") == F.col("professor_id"), "there").when(F.col("owner").isNotNull() | (F.col("first") != F.col("professor_id")), "conflict").otherwise("added")
    return rows.select("professor_id", "alias", state.alias("state"))
