"""Relations that many operators start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order (which must be total): row_number over the keys."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def unique_videos(videos: DataFrame) -> DataFrame:
    """One row per video; repeated rows are exact copies, so any of them is right."""
    return videos.dropDuplicates(["video_id"])


def parsed_facts(results: DataFrame) -> DataFrame:
    """video_id, professor, course, week, session, year: what is known of a source video from its latest comparison."""
    one = F.max_by(F.struct("professor", "course", "week", "session", F.col("year_from").alias("year")), "id").alias("f")
    return results.groupBy(F.col("source_video_id").alias("video_id")).agg(one).select("video_id", "f.*")


def canonical(df: DataFrame, a: str, b: str) -> DataFrame:
    """The same rows with the two ids in order, as columns lo and hi."""
    return df.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)})


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep_old_if_null: list[str] = ()) -> DataFrame:
    """Upsert by full outer join: a key of `new` replaces the row of `old`; of the columns named, a null keeps the old value.

    Both frames have one row per key and the same columns. Keys are compared null-safe.
    """
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    joined = o.join(n, cond, "full_outer")
    out = []
    for c in old.columns:
        if c in keys or c in keep_old_if_null:
            out.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        else:
            out.append(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*out)


def violations(df: DataFrame, key: str, checks: list[tuple[str, Column]]) -> DataFrame:
    """key, check: a row per constraint that a row breaks; one projection and one explode."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in checks]))
    return df.select(F.col(key).alias("key"), F.explode(failed).alias("check"))


def ranked(rows: DataFrame, group: str, by: list, size: int = 64) -> DataFrame:
    """rows with `place`, their rank in the group by the total order `by` (columns, of which the first descends).

    The group is cut at quantiles of the first column, each part is ranked by itself and moved by the sizes of the parts
    before it, so that no task sorts a whole hot group.
    """
    first = by[0]
    cuts = rows.groupBy(group).agg(F.percentile_approx(first, [i / size for i in range(1, size)], 10_000).alias("cuts"))
    rows = rows.join(cuts, rows[group].eqNullSafe(cuts[group]), "left").drop(cuts[group])
    part = F.when(F.col(first).isNull(), size + 1).otherwise(F.coalesce(size - F.size(F.filter("cuts", lambda x: x < F.col(first))), F.lit(0)))
    rows = rows.withColumn("_part", part).drop("cuts")
    sizes = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).select(F.col(group).alias("_g"), F.col("_part").alias("_q"), "_before")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_part").orderBy(F.desc_nulls_last(first), *by[1:])))
    rows = rows.join(sizes, rows[group].eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_q")))
    return rows.withColumn("place", (F.col("_before") + F.col("_r")).cast("long")).drop("_part", "_r", "_g", "_q", "_before")
