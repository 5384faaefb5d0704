"""Runs that can be broken off: checkpoints of phases, markers of stages, guarded transitions and claims, derived from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpoints(done: DataFrame, phase: str, order: str) -> DataFrame:
    """phase, last: how far each phase has come."""
    return done.groupBy(phase).agg(F.max(order).alias("last"))


def resumed(rows: DataFrame, points: DataFrame, phase: str, order: str) -> DataFrame:
    """The rows after the checkpoint of their phase; all of a phase without one."""
    return rows.join(points, phase, "left").where(F.col("last").isNull() | (F.col(order) > F.col("last"))).drop("last")


def completed(markers: DataFrame, run: str, marker: str, stages: dict[str, str]) -> DataFrame:
    """A row per run and a column per stage, in order: whether its marker and those of all stages before it are there."""
    there = F.lit(True)
    out = []
    for stage, name in stages.items():
        there = there & F.bool_or(F.col(marker) == name)
        out.append(there.alias(stage))
    return markers.groupBy(run).agg(*out)


def transitions(requests: DataFrame, key: str, order: str, stage: str) -> DataFrame:
    """key, stage (the last one applied), refused, last_event: a request below the highest stage so far is refused."""
    before = F.max(stage).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = requests.withColumn("_back", F.coalesce(F.col(stage) < before, F.lit(False)))
    return rows.groupBy(key).agg(F.max(stage).alias("stage"), F.count_if("_back").alias("refused"), F.max(F.when(~F.col("_back"), F.col(order))).alias("last_event"))


def claimed(rows: DataFrame, free: Column, group: str, order: list[str], key: str, worker: str) -> DataFrame:
    """rows with claimed_by: of each group the oldest free row goes to the worker; the others keep their owner (column `owner`)."""
    first = rows.where(free).groupBy(group).agg(F.min_by(key, F.struct(*order)).alias(key)).select(key, F.lit(worker).alias("_new"))
    return rows.join(first, key, "left").withColumn("claimed_by", F.coalesce("_new", "owner")).drop("_new")
