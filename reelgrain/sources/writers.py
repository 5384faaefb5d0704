"""Sinks: Parquet, JSON, audit CSV and transcript exports, all written by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrain.functions import text as T

#: Report types with a date go to Parquet, those by dimensions to JSON.
TIME_SERIES = {"daily_metrics", "subscriber_changes", "retention"}


def write_parquet(df: DataFrame, path: str, append: bool = False, by: list[str] | None = None) -> None:
    writer = df.write.mode("append" if append else "overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_report(df: DataFrame, kind: str, path: str) -> None:
    writer = df.write.mode("overwrite")
    writer.parquet(path) if kind in TIME_SERIES else writer.json(path)


def write_audit(df: DataFrame, path: str, columns: list[str], allowed: dict[str, list[str]] | None = None) -> None:
    """Append the given columns (missing ones empty, others dropped) with cells that no spreadsheet runs.

    Values outside a closed vocabulary are an error.
    """
    for c, values in (allowed or {}).items():
        if df.where(F.col(c).isNotNull() & ~F.col(c).isin(*values)).head(1):
            raise ValueError(f"{c} has a value that is not one of {values}")
    cells = [(T.guarded(F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns]
    df.select(*cells).write.mode("append").option("header", True).csv(path)


def _ordered(lines: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("start", "segment_index", lines.alias("line")))), lambda x: x["line"])


def transcript_text(segments: DataFrame, kind: str = "txt", timestamps: bool = True, without_fillers: bool = False, meta: DataFrame | None = None) -> DataFrame:
    """video_id, body: a text, Markdown or JSON Lines document per video from segments (video_id, segment_index, start, end, text).

    meta (video_id, title, duration_seconds, privacy_status) adds a header; null texts are left out, and so are texts that are
    empty after removing fillers, except in JSON Lines.
    """
    spoken = T.without_fillers(F.col("text")) if without_fillers else F.col("text")
    rows = segments.where("text is not null").withColumn("text", spoken)
    if kind == "jsonl":
        fields = ["start", "end", "text"] if timestamps else ["text"]
        line, glue = F.to_json(F.struct(*fields)), "\n"
    else:
        rows = rows.where("text <> ''")
        line, glue = F.concat(F.concat(F.lit("["), T.hms(F.coalesce("start", F.lit(0.0))), F.lit("] ")) if timestamps else F.lit(""), "text"), "\n" if kind == "txt" else "\n\n"
    docs = rows.groupBy("video_id").agg(F.array_join(_ordered(line), glue).alias("body"))
    if meta is None or kind == "txt":
        return docs if kind == "txt" else docs.withColumn("body", F.concat("body", F.lit("\n")))
    if kind == "md":
        length = F.when(F.col("duration_seconds").isNotNull(), F.concat(F.lit("- duration: "), F.col("duration_seconds").cast("string"), F.lit("s\n"))).otherwise("")
        head = F.concat(F.lit("# "), "title", F.lit("\n\n- video_id: "), "video_id", F.lit("\n"), length, F.lit("- privacy_status: "), F.coalesce("privacy_status", F.lit("unknown")), F.lit("\n\n---\n\n"))
    else:
        head = F.concat(F.to_json(F.struct(F.lit(True).alias("_meta"), "video_id", "title", F.col("duration_seconds").alias("duration"))), F.lit("\n"))
    return docs.join(meta.withColumn("head", head).select("video_id", "head"), "video_id", "left").select("video_id", F.concat(F.coalesce("head", F.lit("")), "body", F.lit("\n")).alias("body"))


def export_transcripts(documents: DataFrame, path: str) -> None:
    """One folder per video, written in parallel."""
    documents.select("video_id", F.col("body").alias("value")).write.mode("overwrite").partitionBy("video_id").text(path)


def migrated(df: DataFrame, schema_of: DataFrame, required: list[str]) -> DataFrame:
    """df with the columns of a newer version (nulls where it has none); a required column without it is an error."""
    missing = [c for c in required if c not in df.columns and c not in schema_of.columns]
    if missing:
        raise ValueError(f"the columns {missing} are missing")
    return schema_of.limit(0).unionByName(df, allowMissingColumns=True)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per row, all or nothing: written beside the target, which is then replaced by a renaming."""
    import uuid

    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, target, old = (hadoop(f"{path.rstrip('/')}{x}") for x in (f".new-{uuid.uuid4().hex}", "", f".old-{uuid.uuid4().hex}"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.json(new.toString())
        had = fs.exists(target)
        if had and not fs.rename(target, old):
            raise OSError(f"{path} can't be replaced")
        if not fs.rename(new, target):
            if had:
                fs.rename(old, target)
            raise OSError(f"{path} can't be written")
        fs.delete(old, True)
    finally:
        fs.delete(new, True)


def save_manifest(entries: DataFrame, path: str, recovery: str) -> str:
    """Write a retry manifest, one entry per key; where the path can't be written, to the recovery path. The path written to."""
    key = ["video_id", "mp4_filename", "failed_stage"]
    one = entries.groupBy(*key).agg(F.max_by("reason", "attempt_count").alias("reason"), F.max("last_attempt_at").alias("last_attempt_at"), F.max("attempt_count").alias("attempt_count"))
    for target in (path, recovery):
        try:
            one.write.mode("overwrite").parquet(target)
            return target
        except Exception:
            if target == recovery:
                raise
    return recovery
