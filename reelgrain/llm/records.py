"""The text of a video: its distinct caption rows in the order of speech, joined by one blank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _hashable(field: T.StructField) -> Column:
    # by position in quotes, as a name may hold dots
    c = F.col(f"`{field.name}`")
    return F.to_json(c) if isinstance(field.dataType, T.MapType) else c


def distinct_segments(captions: DataFrame, *keep: str) -> DataFrame:
    """Distinct caption rows with text, partitioned by video_id: video_id, segment_id, start, text and the columns kept.

    Rows without a video_id belong to no record and are left out, as are null and empty texts. Rows count as
    repeated only if all their columns agree; columns that are not carried on enter through one hash, so the only
    shuffle (by video_id) moves what is used.
    """
    cols = list(dict.fromkeys(["video_id", "segment_id", "start", "text", *keep]))
    rest = [_hashable(f) for f in captions.schema if f.name not in cols]
    rows = captions.where("video_id is not null and text is not null and text <> ''")
    rows = rows.select(*[F.col(f"`{c}`") for c in cols], (F.xxhash64(*rest) if rest else F.lit(0)).alias("_rest"))
    return rows.repartition("video_id").dropDuplicates().drop("_rest")


def speech_order() -> list[Column]:
    """Ties and nulls of start come in a fixed order."""
    return [F.col("start").asc_nulls_last(), F.col("segment_id"), F.col("text")]


def placed_segments(captions: DataFrame, *keep: str) -> DataFrame:
    """distinct_segments with `off`, the place of the segment's first character in the record, and `len`."""
    w = Window.partitionBy("video_id").orderBy(*speech_order()).rowsBetween(Window.unboundedPreceding, -1)
    rows = distinct_segments(captions, *keep).withColumn("len", F.length("text").cast("long"))
    return rows.withColumn("off", F.coalesce(F.sum(F.col("len") + 1).over(w), F.lit(0)).cast("long"))


def blocks(placed: DataFrame, size: int, overlap: int) -> DataFrame:
    """The records cut into blocks: video_id, block, text of the characters [block*size, (block+1)*size + overlap).

    A record of any length thus never has to fit into one row.
    """
    first = F.when(F.col("off") > 0, F.col("off") - 1).otherwise(F.lit(0))
    piece = F.when(F.col("off") > 0, F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    rows = placed.select("video_id", first.alias("p"), (F.col("off") + F.col("len")).alias("e"), piece.alias("piece"))
    low = F.greatest(F.lit(0), F.floor((F.col("p") - overlap) / size)).cast("int")
    rows = rows.withColumn("block", F.explode(F.sequence(low, F.floor((F.col("e") - 1) / size).cast("int"))))
    lo = F.greatest(F.col("p"), F.col("block").cast("long") * size)
    hi = F.least(F.col("e"), (F.col("block").cast("long") + 1) * size + overlap)
    rows = rows.select("video_id", "block", lo.alias("lo"), hi.alias("hi"), "p", "piece").where("lo < hi")
    rows = rows.withColumn("cut", F.substring(F.col("piece"), (F.col("lo") - F.col("p") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")))
    parts = F.sort_array(F.collect_list(F.struct("lo", "cut")))
    return rows.groupBy("video_id", "block").agg(F.array_join(F.transform(parts, lambda x: x["cut"]), "").alias("text"))

