"""Daily series: gap filling, forecasts and anomalies, for any number of series at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fill_gaps(points: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """A row for every day between a series' first and last one, missing values interpolated linearly.

    Repeated days must be resolved before. Series are kept apart; an empty input gives no rows.
    """
    w = Window.partitionBy(key)
    span = points.groupBy(key).agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    grid = span.select(key, F.explode(F.sequence("lo", "hi")).alias(day))
    rows = grid.join(points.select(key, day, value), [key, day], "left")
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(day).alias("d"), F.col(value).alias("v")))
    back = F.last(known, ignorenulls=True).over(w.orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(known, ignorenulls=True).over(w.orderBy(day).rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"b": back, "a": ahead})
    gap = F.datediff("a.d", "b.d")
    line = F.col("b.v") + (F.col("a.v") - F.col("b.v")) * F.datediff(day, F.col("b.d")) / F.when(gap > 0, gap)
    return rows.select(key, day, F.when(gap > 0, line).otherwise(F.col("b.v")).alias(value))


def linear_forecast(points: DataFrame, key: str, x: str, y: str, horizon: int) -> DataFrame:
    """Least squares per series, and `horizon` steps beyond its end with a band of 1.96 residual standard errors."""
    fit = points.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("icept"), F.max(x).alias("last"), F.count("*").alias("n"))
    error = points.join(fit, key).groupBy(key).agg(F.sum(F.pow(F.col(y) - F.col("slope") * F.col(x) - F.col("icept"), 2)).alias("sse"))
    rows = fit.join(error, key).withColumn("rse", F.sqrt(F.col("sse") / F.greatest(F.col("n") - 2, F.lit(1))))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    at = F.col("slope") * (F.col("last") + F.col("step")) + F.col("icept")
    return rows.select(key, "step", at.alias("predicted"), (at - 1.96 * F.col("rse")).alias("lower"), (at + 1.96 * F.col("rse")).alias("upper"))


def anomalies(points: DataFrame, key: str, value: str, sigmas: float = 3.0) -> DataFrame:
    """The points with z_score (by the population's deviation; null where that is 0) and is_anomaly."""
    w = Window.partitionBy(key)
    z = (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0))
    return points.withColumn("z_score", z).withColumn("is_anomaly", F.coalesce(F.round(F.abs("z_score"), 9) > sigmas, F.lit(False)))


def model_for(n) -> object:
    return F.when(n < 90, "linear").when(n <= 365, "arima").otherwise("prophet")


def incremental_ranges(last: DataFrame, column: str, today: str, lag: int = 3, lookback: int = 730) -> DataFrame:
    """start, stop, up_to_date and overall beside each report's last day (null: never collected).

    A report goes on the day after its last one, or `lookback` days before the stop; the stop is `lag` days before today, as
    data come late; overall is the day after the least last day of all.
    """
    stop = F.date_sub(F.lit(today).cast("date"), lag)
    start = F.coalesce(F.date_add(column, 1), F.date_sub(stop, lookback))
    overall = F.date_add(F.min(column).over(Window.partitionBy()), 1)  # a row per kind of report
    return last.withColumns({"start": start, "stop": stop, "up_to_date": start > stop, "overall": overall})
