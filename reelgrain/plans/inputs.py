"""Inputs that several queries derive from the tables, each beside the SQL that derives the same."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgrain.functions import text as T
from reelgrain.operators import titles as titles_op
from reelgrain.operators.facts import parsed_facts, unique_videos
from reelgrain.storage import table


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]"


_NFC = {o: unicodedata.normalize("NFC", chr(o)) for o in range(0xA0, 0x10000) if not 0xD800 <= o <= 0xDFFF}
_SINGLE = [(chr(o), x) for o, nfc in _NFC.items() if len(x := unicodedata.normalize("NFKC", chr(o))) == 1 and x != nfc]
BLANKS = r"\s\x0B\x85\p{Z}"


def phrase_sql(c: str) -> str:
    """The phrase form, with the compatibility decompositions to one character that SQL can express."""
    plain = f"nfc_normalize(translate(nfc_normalize({c}), {quoted(''.join(a for a, _ in _SINGLE))}, {quoted(''.join(b for _, b in _SINGLE))}))"
    return rf"trim(regexp_replace(regexp_replace(lower({plain}), '{_class(T.PHRASE_MARKS)}', ' ', 'g'), '[{BLANKS}\x1C-\x1F]+', ' ', 'g'))"


def key_sql(c: str) -> str:
    """The form in which file names and titles are compared."""
    bare = rf"regexp_replace(nfc_normalize({c}), '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g')"
    return rf"lower(regexp_replace({bare}, '[{BLANKS}\-_.,()\[\]?!~]+', '', 'g'))"


def names_sql(c: str) -> str:
    return f"list_filter(list_transform(string_split(trim({c}, '() '), '/'), lambda x: trim(x)), lambda x: x <> '')"


def category_sql(c: str) -> str:
    return "CASE WHEN " + " OR ".join(f"contains({c}, {quoted(k)})" for k in T.SUPPLEMENTARY) + " THEN 'supplementary' ELSE 'regular' END"


# What is known of each video: p from its latest comparison, v its own row, t its title, f a row per professor named.
FACTS = f"""p AS (SELECT source_video_id AS video_id, professor, course, week, session, year_from AS year FROM comparison_results QUALIFY row_number() OVER (PARTITION BY source_video_id ORDER BY id DESC)=1),
v AS (SELECT DISTINCT video_id, channel_id, title, epoch_us(published_at) AS us, published_at AT TIME ZONE 'UTC' AS ts, duration_seconds, view_count, like_count, comment_count, privacy_status FROM videos),
f AS (SELECT p.* EXCLUDE (professor), unnest({names_sql("professor")}) AS name, {category_sql("coalesce(title,'')")} AS category FROM p LEFT JOIN (SELECT video_id, title FROM v) t USING (video_id) WHERE course <> '')"""


def videos(spark, d) -> DataFrame:
    return unique_videos(table(spark, d, "videos"))


def facts(spark, d) -> DataFrame:
    return parsed_facts(table(spark, d, "comparison_results"))


def joined(spark, d) -> DataFrame:
    return facts(spark, d).join(videos(spark, d).select("video_id", "duration_seconds", "view_count", "published_at"), "video_id")


def owned(spark, d) -> DataFrame:
    """A row per video with a course and professor named: video_id, course, week, session, year, name, category."""
    title = videos(spark, d).select("video_id", T.category(F.coalesce("title", F.lit(""))).alias("category"))
    rows = facts(spark, d).where("course <> ''").join(title, "video_id", "left")
    rows = rows.withColumn("category", F.coalesce("category", F.lit("regular")))
    return rows.select("video_id", "course", "week", "session", "year", F.explode(T.professor_names(F.col("professor"))).alias("name"), "category")


# Retention curves: a video has those of the viewer that its views number, viewing by viewing; relative retention may be missing.
RETENTION = """ev AS (SELECT user_id, round((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1)*1.0e0/greatest(count(*) OVER (PARTITION BY user_id)-1,1),6) AS elapsed_ratio, value/50.0e0 AS audience_watch_ratio, coalesce(try_cast(json_extract_string(props,'$.k') AS BIGINT)/100.0e0,0.0e0) AS relative_retention FROM events),
ret AS (SELECT w.video_id, elapsed_ratio, audience_watch_ratio, relative_retention FROM (SELECT DISTINCT video_id, view_count FROM videos) w JOIN ev ON ev.user_id = w.view_count % 100),
hot AS (SELECT * FROM ret QUALIFY audience_watch_ratio > 1.3e0*avg(audience_watch_ratio) OVER (PARTITION BY video_id)),
skips AS (SELECT * FROM ret QUALIFY audience_watch_ratio < 0.7e0*avg(audience_watch_ratio) OVER (PARTITION BY video_id))"""


def retention(spark, d) -> DataFrame:
    """video_id, elapsed_ratio, audience_watch_ratio, relative_retention (0 where it is missing)."""
    by = Window.partitionBy("user_id")
    place, n = F.row_number().over(by.orderBy("ts", "event_id")) - 1, F.count("*").over(by)
    k = F.from_json("props", "k long")["k"]
    points = table(spark, d, "events").select("user_id", F.round(place / F.greatest(n - 1, F.lit(1)), 6).alias("elapsed_ratio"), (F.col("value") / 50.0).alias("audience_watch_ratio"), F.coalesce(k / 100.0, F.lit(0.0)).alias("relative_retention"))
    return videos(spark, d).select("video_id", (F.col("view_count") % 100).alias("user_id")).join(points, "user_id").drop("user_id")


def hotspots(points: DataFrame, factor: float = 1.3, above: bool = True) -> DataFrame:
    """The points of each video above (or below) `factor` times its mean: the mean is an aggregate, joined back by video."""
    mean = points.groupBy("video_id").agg((F.avg("audience_watch_ratio") * factor).alias("limit"))
    far = F.col("audience_watch_ratio") > F.col("limit") if above else F.col("audience_watch_ratio") < F.col("limit")
    return points.join(mean, "video_id").where(far).drop("limit")


# Scores of a model on five axes: per video, those of the professor whose name is typed as registered.
AXES = ("relevance", "accuracy", "clarity", "engagement", "depth")
EQS = """ax AS (SELECT detail_id, professor_name, len(courses) AS n_courses, CASE WHEN len(courses)=0 THEN 0.0e0 ELSE weekly_coverage END AS relevance, CASE WHEN len(courses)=0 THEN 0.0e0 ELSE session_completeness END AS accuracy,
CASE WHEN len(courses)=0 THEN 0.0e0 ELSE greatest(0.0e0,1.0e0-validation_error_count/10.0e0) END AS clarity, CASE WHEN len(courses)=0 THEN 0.0e0 ELSE least(1.0e0,avg_views/300.0e0) END AS engagement, CASE WHEN len(courses)=0 THEN 0.0e0 ELSE least(1.0e0,coalesce(avg_duration_minutes,0)/60.0e0) END AS depth FROM professor_detail)"""


def axes(spark, d) -> DataFrame:
    """detail_id, professor_name and the five axes; all 0 where there is nothing to judge."""
    c = F.col
    values = [c("weekly_coverage"), c("session_completeness"), F.greatest(F.lit(0.0), 1.0 - c("validation_error_count") / 10.0), F.least(F.lit(1.0), c("avg_views") / 300.0), F.least(F.lit(1.0), F.coalesce("avg_duration_minutes", F.lit(0.0)) / 60.0)]
    none = F.size("courses") == 0
    return table(spark, d, "professor_detail").select("detail_id", "professor_name", *[F.when(none, 0.0).otherwise(v).alias(a) for a, v in zip(AXES, values)])


# Files beside the videos: titles as file names, some with other blanks, some cut or renamed; size and time from the video's row.
FILES = f"""fl AS (SELECT video_id AS file_id, CASE view_count % 4 WHEN 0 THEN title WHEN 1 THEN replace(title,' ','_') WHEN 2 THEN substring(title,1,60) ELSE 'copy of ' || title END || '.mp4' AS file, duration_seconds + like_count % 3 AS fd, view_count*2000000.0e0 AS bytes, us + (comment_count % 3)*43200000001 AS file_us FROM v WHERE title <> '')"""


def files(spark, d) -> DataFrame:
    k = F.col("view_count") % 4
    name = F.when(k == 0, F.col("title")).when(k == 1, F.replace("title", F.lit(" "), F.lit("_"))).when(k == 2, F.substring("title", 1, 60)).otherwise(F.concat(F.lit("copy of "), "title"))
    rows = videos(spark, d).where("title <> ''")
    return rows.select(F.col("video_id").alias("file_id"), F.concat(name, F.lit(".mp4")).alias("file"), (F.col("duration_seconds") + F.col("like_count") % 3).alias("fd"), (F.col("view_count") * 2000000.0).alias("bytes"), (F.unix_micros("published_at") + (F.col("comment_count") % 3) * 43200000001).alias("file_us"))


def _translated(pattern: str) -> str:
    """A pattern of the Unicode classes of Java in the syntax of the SQL engine."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\S", r"\d"):
            out += r"\p{Nd}" if two == r"\d" else BLANKS if inside else f"[{'^' if two == r'\S' else ''}{BLANKS}]"
            i += 2
            continue
        if two[0] == "\\":
            out, i = out + two, i + 2
            continue
        inside = True if two[0] == "[" else False if two[0] == "]" else inside
        out, i = out + two[0], i + 1
    return out


def parser_sql(t: str) -> str:
    """The parser as a query over a relation with video_id and title."""
    patterns = [quoted(_translated(p)) for _, p, _ in titles_op.PATTERNS]
    which = "CASE " + " ".join(f"WHEN regexp_matches(t, {p}) THEN {i}" for i, p in enumerate(patterns)) + " END"
    single = {k: _translated(p).replace("(?<!\\p{Nd})", "(?:^|\\P{Nd})").replace("(?!\\p{Nd})", "(?:\\P{Nd}|$)") for k, p in titles_op.FALLBACK.items()}

    def field(name: str) -> str:
        cases = " ".join(f"WHEN which={i} THEN regexp_extract(t, {p}, {fields.index(name) + 1})" for i, (p, (_, _, fields)) in enumerate(zip(patterns, titles_op.PATTERNS)) if name in fields)
        other = f"WHEN which IS NULL THEN regexp_extract(t, {quoted(single[name])}, 1)" if name in single else ""
        return f"nullif(CASE {cases} {other} END, '')"

    def digits(c: str) -> str:
        return f"translate({c}, {quoted(titles_op._DIGITS)}, '{'0123456789' * (len(titles_op._DIGITS) // 10)}')"

    def number(name: str) -> str:
        return f"try_cast({digits(field(name))} AS INT)"

    def found(p: str) -> str:
        return f"list_filter({names_sql(f'regexp_extract(t, {quoted(_translated(p))}, 1)')}, lambda x: x NOT IN ({', '.join(map(quoted, titles_op.NO_NAMES))}))"

    inside, first = found(titles_op._IN_PARENTHESES), found(titles_op._AT_START)
    pair = digits(field("year_pair"))
    names = f"CASE WHEN which IS NULL THEN CASE WHEN len({inside}) > 0 THEN {inside} ELSE {first} END ELSE {names_sql(field('professor'))} END"
    pair_year = f"CASE WHEN regexp_matches({pair}, '^[0-9]{{4}}') THEN try_cast(substring({pair},1,4) AS INT) ELSE 2000 + try_cast(substring({pair},1,2) AS INT) END"
    pattern = "CASE which " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _, _) in enumerate(titles_op.PATTERNS)) + " END"
    return f"""SELECT video_id, {pattern} AS matched_pattern, coalesce(array_to_string({names}, '|'), '') AS professor, {field("course")} AS course, coalesce({number("year")}, {pair_year}) AS year,
coalesce({number("semester")}, try_cast(nullif(regexp_extract({pair}, '[0-9]+-([12])', 1), '') AS INT)) AS semester, {number("week")} AS week, {number("session")} AS session, {field("department")} AS department, {category_sql("t")} AS category, which IS NULL AS parse_error
FROM (SELECT *, {which} AS which FROM (SELECT video_id, coalesce(title,'') AS t FROM {t}))"""
