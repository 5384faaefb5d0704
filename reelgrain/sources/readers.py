"""Sources: Parquet, JSON, CSV and SRT files as DataFrames. A missing path is an empty frame of the schema asked for."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelgrain.functions import text as T
from reelgrain.functions.scoring import Policy
from reelgrain.sources import schemas

# Columns and labels of an exported video table, and files of other categories beside it.
EXPORT_COLUMNS = {"id": "동영상 ID", "ms": "근사치 길이(밀리초)", "created": "동영상 생성 타임스탬프", "privacy": "개인 정보 보호", "title": "동영상 제목(원본)"}
OPTIONAL_COLUMNS = {"language": "동영상 오디오 언어", "category": "동영상 카테고리"}
PRIVACY = {"공개": "public", "일부 공개": "unlisted", "비공개": "private"}
IGNORED_FILES = r"^(?:동영상 녹화|동영상 텍스트|댓글|재생목록|구독정보|시청 기록|검색 기록)"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_parquet(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame | None:
    """Parquet files; where there are none, an empty frame of `schema`, or None without one."""
    if _exists(spark, path):
        return spark.read.parquet(path)
    return spark.createDataFrame([], schema) if schema else None


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of one object or one array each, with or without a byte order mark; files that can't be read give nulls."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    body = F.trim(F.regexp_replace("value", "^\\x{FEFF}", ""))
    rows = F.when(F.startswith(body, F.lit("[")), F.from_json(body, f"array<struct<{_nested(schema)}>>")).otherwise(F.array(F.from_json(body, schema)))
    return raw.select("file", F.explode_outer(rows).alias("r")).select("file", "r.*")


def _nested(schema: str) -> str:
    parsed = StructType.fromDDL(schema)
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in parsed.fields)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """video_id (the file's name without its ending) and segments: array of start, end, text.

    A segment needs a start and a text; its end may be given as a duration. Documents without segments have an empty array.
    """
    rows = read_json(spark, path, "segments array<struct<start:double,`end`:double,duration:double,text:string>>")
    if "file" not in rows.columns:
        return spark.createDataFrame([], "video_id string, segments array<struct<start:double,`end`:double,text:string>>")
    return rows.select(F.regexp_replace("file", r"\.[^.]+$", "").alias("video_id"), tidy_segments(F.col("segments")).alias("segments"))


def tidy_segments(segments: Column) -> Column:
    whole = F.filter(F.coalesce(segments, F.array().cast("array<struct<start:double,`end`:double,duration:double,text:string>>")), lambda s: s["start"].isNotNull() & s["text"].isNotNull())
    return F.transform(whole, lambda s: F.struct(s["start"].alias("start"), F.coalesce(s["end"], s["start"] + s["duration"]).alias("end"), s["text"].alias("text")))


def parse_srt(texts: DataFrame, key: str, srt: str) -> DataFrame:
    """key, segment_index, start, end, text of every block of SRT captions; blocks without times or text are skipped."""
    body = F.regexp_replace(F.regexp_replace(F.col(srt), "^\\x{FEFF}", ""), "\r\n?", "\n")
    blocks = texts.select(F.col(key), F.posexplode(F.split(body, r"\n[ \t]*\n+")).alias("pos", "block"))
    pattern = r"(?s)(\d+:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d+:\d{2}:\d{2}[,.]\d{3})[^\n]*\n(.*)"
    part = lambda i: F.regexp_extract("block", pattern, i)
    rows = blocks.select(key, "pos", T.srt_seconds(part(1)).alias("start"), T.srt_seconds(part(2)).alias("end"), F.trim(F.regexp_replace(part(3), r"\s*\n\s*", " ")).alias("text"))
    rows = rows.where("start is not null and end is not null and text <> ''")
    place = F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1
    return rows.select(key, place.alias("segment_index"), "start", "end", "text")


def read_report_csv(spark: SparkSession, path: str) -> DataFrame:
    """A bulk report; no rows beneath the header, or a row with another number of fields than the header, is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    header = lines.head(1)
    if not header:
        raise ValueError(f"the report is empty: {path}")
    n = len(header[0][0].split(","))
    sizes = lines.agg(F.count("*").alias("n"), F.count_if(F.size(F.split("value", ",")) != n).alias("ragged")).first()
    if sizes.n < 2 or sizes.ragged:
        raise ValueError(f"the report has {sizes.n - 1} rows, {sizes.ragged} of them with another number of fields: {path}")
    return spark.read.csv(path, header=True, inferSchema=True, mode="FAILFAST")


def read_export(spark: SparkSession, paths: list[str], channel_id: str) -> tuple[DataFrame, DataFrame]:
    """Videos of an export that may be split into several CSV files, and the rows whose privacy label is not known.

    Of a repeated id the first row by file and place with a known label wins.
    """
    kept = [p for p in sorted(set(paths)) if not _ignored(Path(p).name)]
    rows = None
    for i, path in enumerate(kept):
        part = spark.read.csv(path, header=True, multiLine=True, escape='"')
        missing = set(EXPORT_COLUMNS.values()) - set(part.columns)
        if missing:
            raise ValueError(f"{path} lacks the columns {sorted(missing)}")
        cols = [F.trim(F.col(f"`{c}`")).alias(k) for k, c in EXPORT_COLUMNS.items()]
        cols += [(F.trim(F.col(f"`{c}`")) if c in part.columns else F.lit(None).cast("string")).alias(k) for k, c in OPTIONAL_COLUMNS.items()]
        part = part.select(*cols, F.lit(i).alias("file"), F.monotonically_increasing_id().alias("place"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no video table among the files")
    rows = rows.where("id <> ''").withColumn("status", F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIVACY.items() for x in kv]), F.col("privacy")))
    first = F.row_number().over(Window.partitionBy("id").orderBy("file", "place"))
    good = rows.where("status is not null").withColumn("rn", first).where("rn = 1")
    good = good.select(F.col("id").alias("video_id"), F.lit(channel_id).alias("channel_id"), "title", (F.coalesce(F.col("ms").try_cast("double"), F.lit(0.0)) / 1000).alias("duration_seconds"), F.nullif("language", F.lit("")).alias("language"), F.nullif("category", F.lit("")).alias("category"), F.col("status").alias("privacy_status"), F.try_to_timestamp("created").alias("created_at"))
    return good, rows.where("status is null").select(F.col("id").alias("video_id"), F.col("privacy").alias("raw_value"))


def _ignored(name: str) -> bool:
    import re

    return re.match(IGNORED_FILES, name) is not None


def flatten_videos(items: DataFrame) -> DataFrame:
    """Rows of an API's nested video items (id, snippet, statistics, contentDetails) with numbers and defaults."""
    n = lambda c: F.coalesce(F.col(f"statistics.{c}").try_cast("long"), F.lit(0))
    return items.select(F.col("id").alias("video_id"), F.col("snippet.channelId").alias("channel_id"), F.coalesce("snippet.title", F.lit("")).alias("title"), F.try_to_timestamp("snippet.publishedAt").alias("published_at"), T.iso_seconds(F.col("contentDetails.duration")).alias("duration_seconds"), n("viewCount").alias("view_count"), n("likeCount").alias("like_count"), n("commentCount").alias("comment_count"), F.coalesce("snippet.tags", F.array().cast("array<string>")).alias("tags"))


def load_policy(path: str) -> Policy:
    """A policy from a JSON file, or a YAML file where a YAML library is there; what it doesn't say has its default."""
    text = Path(path).read_text(encoding="utf-8-sig")
    try:
        raw = json.loads(text)
    except ValueError:
        import yaml

        raw = yaml.safe_load(text) or {}
    names = {"layer_a_min_seconds": "layer_a_min_seconds", "layer_c_evolution_band": "evolution_band", "matching_cosine_cull": "cosine_cull", "pattern_whole_threshold_ratio": "whole_ratio", "composite_weights": "weights"}
    unknown = set(raw) - set(names)
    if unknown:
        raise ValueError(f"the policy has unknown entries: {sorted(unknown)}")
    values = {names[k]: tuple(v) if isinstance(v, list) else v for k, v in raw.items()}
    return Policy(**values)


def read_manifest(spark: SparkSession, path: str, recovery: str | None = None) -> DataFrame:
    """A retry manifest; entries of a recovery file that the manifest lacks are added."""
    main = read_parquet(spark, path, schemas.MANIFEST)
    if recovery is None:
        return main
    more = read_parquet(spark, recovery, schemas.MANIFEST)
    key = ["video_id", "mp4_filename", "failed_stage"]
    return main.unionByName(more.join(main.select(*key), key, "left_anti"))


def find_files(spark: SparkSession, *patterns: str) -> list[str]:
    """The files that any of the patterns names, each once, in order."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found: set[str] = set()
    for pattern in patterns:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
        found |= {str(s.getPath().toUri().getPath()) for s in p.getFileSystem(conf).globStatus(p) or [] if s.isFile()}
    return sorted(found)


# Columns of an exported channel table.
CHANNEL_COLUMNS = {"id": "채널 ID", "title": "채널 제목(원본)", "country": "채널 국가", "privacy": "채널 공개 상태"}


def read_channel(spark: SparkSession, path: str) -> DataFrame:
    """The one channel of an export: the first row that has an id; the country is its first two characters, empty ones are null."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if missing := {CHANNEL_COLUMNS["id"], CHANNEL_COLUMNS["title"]} - set(rows.columns):
        raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    of = lambda k: F.trim(F.col(f"`{CHANNEL_COLUMNS[k]}`")) if CHANNEL_COLUMNS[k] in rows.columns else F.lit(None).cast("string")
    rows = rows.select(of("id").alias("channel_id"), of("title").alias("channel_title"), F.nullif(F.substring(of("country"), 1, 2), F.lit("")).alias("country"), of("privacy").alias("privacy"))
    return rows.where("channel_id <> ''").limit(1)


def read_parsed_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed titles of all JSON files below a folder that hold a list; files of another shape are passed over."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    body = F.trim(F.regexp_replace("value", "^\\x{FEFF}", ""))
    rows = raw.where(F.startswith(body, F.lit("["))).select(F.explode(F.from_json(body, f"array<struct<{_nested(schemas.PARSED_TITLE)}>>")).alias("r"))
    return rows.select("r.*").where("video_id is not null")


def load_search(path: str):
    """A search from a JSON file, or a YAML file where a YAML library is there: filters, queries and exclude.title_contains."""
    from reelgrain.operators.search import Filter, Query

    text = Path(path).read_text(encoding="utf-8-sig")
    try:
        raw = json.loads(text)
    except ValueError:
        import yaml

        raw = yaml.safe_load(text)
    raw = raw or {}

    def one(d: dict) -> Filter:
        weeks = d.get("weeks") or ((d.get("week_from") or 1, d.get("week_to") or 16) if d.get("week_from") or d.get("week_to") else None)
        return Filter(d.get("professor"), d.get("course"), d.get("year"), d.get("semester"), d.get("session"), tuple(weeks) if weeks else None)

    return Query(one(raw.get("filters") or {}), tuple(one(q) for q in raw.get("queries") or []), tuple((raw.get("exclude") or {}).get("title_contains") or ()))


#: Reports that a collection knows, and their columns of numbers.
REPORTS = ("daily_metrics", "traffic_sources", "demographics", "geography", "devices", "playback_locations", "subscriber_changes")


def collect_reports(read: dict, kinds: list[str] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The frames of the wanted reports (None: all), and what went wrong with those that failed; unknown kinds are passed over.

    `read` has a function without arguments for each kind. One report's failure doesn't keep the others from being collected.
    """
    done, failed = {}, {}
    for kind in kinds if kinds is not None else REPORTS:
        if kind not in REPORTS or kind not in read:
            continue
        try:
            frame = read[kind]()
            frame.schema  # a frame that can't be analysed fails here
            done[kind] = frame
        except Exception as error:
            failed[kind] = str(error).split("\n")[0]
    return done, failed


def retention_rows(rows: DataFrame) -> DataFrame:
    """Rows of a retention report (video_id, row: array of elapsed ratio, watch ratio and perhaps relative retention) as columns."""
    at = lambda i: F.get("row", F.lit(i)).try_cast("double")
    return rows.where(F.size("row") >= 2).select("video_id", at(0).alias("elapsed_ratio"), at(1).alias("audience_watch_ratio"), F.coalesce(at(2), F.lit(0.0)).alias("relative_retention"))
