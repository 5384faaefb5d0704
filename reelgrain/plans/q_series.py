"""Queries on engagement facts and daily series (events as analytics facts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgrain.functions import scoring as S
from reelgrain.operators import series as O
from reelgrain.functions.text import words
from reelgrain.operators.facts import merge, unique_videos
from reelgrain.operators import lifecycle as L
from reelgrain.plans import inputs as I
from reelgrain.plans.registry import Registry
from reelgrain.storage import table
from reelgrain.streaming.daily import daily_counts_stream

QUERIES = Registry()
add = QUERIES.add
_DAY = "strftime(ts::DATE,'%Y-%m-%d')"
_MONEY = "round({0}+1e-9,2)"


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("day", F.to_date("ts"))


def _sum(c, name: str = "total"):
    return F.round(F.sum(c) + S.TIE, 2).alias(name)


@add("daily_metrics", f"SELECT {_DAY} AS day, count(*) AS n, round(sum(value)+1e-9,2) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def daily_metrics(spark, d):
    return events(spark, d).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), _sum("value"), F.countDistinct("user_id").alias("users"))


@add("traffic_sources", "SELECT event_type, count(*) AS n, round(sum(value)+1e-9,2) AS total FROM events GROUP BY 1")
def traffic_sources(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), _sum("value"))


@add("geography", "SELECT n_name, count(*) AS n, round(sum(c_acctbal)+1e-9,2) AS total FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1")
def geography(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("s"))
    return c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("n").alias("n"), _sum("s"))


@add("devices", "SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2")
def devices(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"))


@add("playback_locations", "SELECT caption_source, channel_id, count(*) AS n FROM case_c_video2 GROUP BY 1,2")
def playback_locations(spark, d):
    return table(spark, d, "case_c_video2").groupBy("caption_source", "channel_id").agg(F.count("*").alias("n"))


@add("demographic_share", "SELECT event_type, user_id % 7 AS age_group, round(100.0e0*count(*)/sum(count(*)) OVER (),6) AS share FROM events GROUP BY 1,2")
def demographic_share(spark, d):
    by = events(spark, d).groupBy("event_type", (F.col("user_id") % 7).alias("age_group")).agg(F.count("*").alias("n"))
    return by.select("event_type", "age_group", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@add("subscriber_changes", f"SELECT {_DAY} AS day, count(*) FILTER (WHERE event_type='click') AS gained, count(*) FILTER (WHERE event_type='error') AS lost FROM events GROUP BY 1")
def subscriber_changes(spark, d):
    t = F.col("event_type")
    return events(spark, d).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count_if(t == "click").alias("gained"), F.count_if(t == "error").alias("lost"))


@add("engagement", "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type='view') AS views, round(coalesce(sum(value) FILTER (WHERE event_type='view'),0)+1e-9,2) AS watched, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def engagement(spark, d):
    view = F.col("event_type") == "view"
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(view).alias("views"), F.round(F.coalesce(F.sum(F.when(view, F.col("value"))), F.lit(0.0)) + S.TIE, 2).alias("watched"), F.countDistinct("event_type").alias("kinds"))


_FILL = """p AS (SELECT user_id, ts::DATE AS day, count(*)::DOUBLE AS v FROM events GROUP BY 1,2), s AS (SELECT user_id, min(day) lo, max(day) hi FROM p GROUP BY 1),
g AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM s), j AS (SELECT g.user_id, g.day, p.v FROM g LEFT JOIN p ON p.user_id=g.user_id AND p.day=g.day),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER w AS bd, last_value(v IGNORE NULLS) OVER w AS bv, first_value(CASE WHEN v IS NOT NULL THEN day END IGNORE NULLS) OVER u AS ad, first_value(v IGNORE NULLS) OVER u AS av FROM j
WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), u AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _counts(spark, d) -> DataFrame:
    return events(spark, d).groupBy("user_id", "day").agg(F.count("*").cast("double").alias("v"))


@add("fill_missing_days", f"WITH {_FILL} SELECT user_id, strftime(day,'%Y-%m-%d') AS day, round(CASE WHEN ad > bd THEN bv+(av-bv)*(day-bd)/(ad-bd) ELSE bv END,6) AS v FROM k")
def fill_missing_days(spark, d):
    return O.fill_gaps(_counts(spark, d), "user_id", "day", "v").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("v", 6).alias("v"))


@add("linear_forecast", """WITH p AS (SELECT event_type, (ts::DATE - DATE '0001-01-01')+1 AS x, count(*)::DOUBLE AS y FROM events GROUP BY 1,2), f AS (SELECT event_type, regr_slope(y,x) s, regr_intercept(y,x) i, max(x) l, count(*) n FROM p GROUP BY 1),
e AS (SELECT event_type, sum((y-s*x-i)*(y-s*x-i)) sse FROM p JOIN f USING (event_type) GROUP BY 1), q AS (SELECT *, sqrt(sse/greatest(n-2,1)) AS rse FROM f JOIN e USING (event_type))
SELECT event_type, t.step::INT AS step, round(s*(l+t.step)+i,3) AS predicted, round(s*(l+t.step)+i-1.96*rse,3) AS lower, round(s*(l+t.step)+i+1.96*rse,3) AS upper FROM q, range(1,8) t(step)""")
def linear_forecast(spark, d):
    points = events(spark, d).groupBy("event_type", (F.datediff("day", F.lit("0001-01-01").cast("date")) + 1).alias("x")).agg(F.count("*").cast("double").alias("y"))
    return O.linear_forecast(points, "event_type", "x", "y", 7).select("event_type", "step", *[F.round(c, 3).alias(c) for c in ("predicted", "lower", "upper")])


@add("calendar_days", "SELECT strftime(day,'%Y-%m-%d') AS day, count(*) AS running FROM (SELECT unnest(generate_series(o_orderdate::DATE, o_orderdate::DATE + 2, INTERVAL 1 DAY)) AS day FROM orders) GROUP BY 1")
def calendar_days(spark, d):
    start = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(F.explode(F.sequence(start, F.date_add(start, 2))).alias("day")).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("running"))


@add("series_from_daily", "SELECT event_id, (try_cast(CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE strftime(ts::DATE,'%Y-%m-%d') END AS DATE) - DATE '0001-01-01' + 1)::INT AS ordinal FROM events WHERE event_id % 11 <> 0")
def series_from_daily(spark, d):
    raw = F.when(F.col("event_id") % 11 == 0, "bad").otherwise(F.date_format("day", "yyyy-MM-dd"))
    day = F.try_to_date(raw, "yyyy-MM-dd")
    return events(spark, d).where(day.isNotNull()).select("event_id", (F.datediff(day, F.lit("0001-01-01").cast("date")) + 1).alias("ordinal"))


@add("series_from_videos", "SELECT DISTINCT video_id, ((published_at AT TIME ZONE 'UTC')::DATE - DATE '0001-01-01' + 1)::INT AS ordinal, view_count AS value FROM videos WHERE view_count > 0")
def series_from_videos(spark, d):
    return unique_videos(table(spark, d, "videos")).where("view_count > 0").select("video_id", (F.datediff(F.to_date("published_at"), F.lit("0001-01-01").cast("date")) + 1).alias("ordinal"), F.col("view_count").alias("value"))


@add("backoff", "SELECT event_id, round(1.5e0*pow(2.0,event_id % 6),6) AS delay FROM events")
def backoff(spark, d):
    return events(spark, d).select("event_id", F.round(S.backoff(1.5, 2.0, F.col("event_id") % 6), 6).alias("delay"))


@add("map_lookup", "SELECT event_id, CASE event_type WHEN 'click' THEN 'positive' WHEN 'error' THEN 'negative' ELSE 'neutral' END AS label FROM events")
def map_lookup(spark, d):
    from reelgrain.functions.text import mapped

    return events(spark, d).select("event_id", mapped(F.col("event_type"), {"click": "positive", "error": "negative"}, "neutral").alias("label"))


@add("llm_json", "SELECT event_id, try_cast(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events")
def llm_json(spark, d):
    fence = F.concat(F.lit("text before\n```json\n"), "props", F.lit("\n```"))
    body = F.regexp_extract(fence, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return events(spark, d).select("event_id", F.from_json(body, "k long")["k"].alias("k"))


@add("json_ids", "SELECT event_id, len(ids)::BIGINT AS n, ids[1] AS first FROM (SELECT event_id, from_json('[\"' || user_id || '\",\"' || event_type || '\"]','[\"VARCHAR\"]') AS ids FROM events)")
def json_ids(spark, d):
    raw = F.concat(F.lit('["'), F.col("user_id").cast("string"), F.lit('","'), "event_type", F.lit('"]'))
    ids = F.from_json(raw, "array<string>")
    return events(spark, d).select("event_id", F.size(ids).cast("long").alias("n"), ids[0].alias("first"))


@add("batching", "SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY event_id)-1)//20 AS batch FROM events")
def batching(spark, d):
    rn = F.row_number().over(Window.partitionBy("event_type", "day").orderBy("event_id"))
    return events(spark, d).select("event_type", "event_id", F.floor((rn - 1) / 20).alias("batch"))


@add("quota_guard", "SELECT event_id FROM (SELECT event_id, sum(cost) OVER (PARTITION BY user_id ORDER BY event_id) AS c FROM (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 200 ELSE 50 END AS cost FROM events)) WHERE c <= 2000")
def quota_guard(spark, d):
    cost = F.when(F.col("event_type") == "click", 200).otherwise(50)
    so_far = F.sum("cost").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return events(spark, d).withColumn("cost", cost).withColumn("c", so_far).where("c <= 2000").select("event_id")


@add("stage_regression", "SELECT event_id FROM (SELECT event_id, st, max(st) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT event_id, user_id, list_position(['view','click','scroll','purchase','error'], event_type) AS st FROM events)) WHERE st < m")
def stage_regression(spark, d):
    stage = F.array_position(F.array(*[F.lit(x) for x in ("view", "click", "scroll", "purchase", "error")]), F.col("event_type"))
    before = F.max("st").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    return events(spark, d).withColumn("st", F.nullif(stage, F.lit(0).cast("long"))).withColumn("m", before).where("st < m").select("event_id")


@add("job_history", "SELECT event_id, event_type FROM events WHERE event_type IN ('view','error') ORDER BY ts DESC, event_id LIMIT 200 OFFSET 50")
def job_history(spark, d):
    return events(spark, d).where(F.col("event_type").isin("view", "error")).orderBy(F.desc("ts"), "event_id").offset(50).limit(200).select("event_id", "event_type")


@add("jobs_in_progress", "SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('click','view') GROUP BY 1")
def jobs_in_progress(spark, d):
    return events(spark, d).where(F.col("event_type").isin("click", "view")).groupBy("user_id").agg(F.count("*").alias("n"))


@add("recent_actions", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_actions(spark, d):
    return events(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id")


@add("job_ids", "SELECT event_id, strftime(ts,'%Y%m%d-%H%M') || CASE WHEN rn > 0 THEN '-' || rn ELSE '' END AS job_id FROM (SELECT event_id, ts, row_number() OVER (PARTITION BY strftime(ts,'%Y%m%d-%H%M') ORDER BY event_id)-1 AS rn FROM events)")
def job_ids(spark, d):
    minute = F.date_format("ts", "yyyyMMdd-HHmm")
    rows = events(spark, d).withColumn("minute", minute)
    rn = F.row_number().over(Window.partitionBy("minute").orderBy("event_id")) - 1
    return rows.withColumn("rn", rn).select("event_id", F.concat("minute", F.when(F.col("rn") > 0, F.concat(F.lit("-"), F.col("rn").cast("string"))).otherwise("")).alias("job_id"))


@add("expiry_status", "SELECT event_id, floor(epoch(ts - TIMESTAMP '2024-01-15 00:00:00')/86400)::BIGINT AS days, CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'expired' WHEN floor(epoch(ts - TIMESTAMP '2024-01-15 00:00:00')/86400) <= 7 THEN 'near_expiry' ELSE 'valid' END AS status FROM events")
def expiry_status(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp")) - 1705276800000000
    days = F.floor(us / 86400000000)
    return events(spark, d).select("event_id", days.alias("days"), F.when(us < 0, "expired").when(days <= 7, "near_expiry").otherwise("valid").alias("status"))


@add("pool_totals", "SELECT count(*) AS total, count(*) FILTER (WHERE event_type='view') AS processed, count(*) FILTER (WHERE event_type='error') AS failed, count(*) FILTER (WHERE event_type NOT IN ('view','error')) AS skipped FROM events")
def pool_totals(spark, d):
    t = F.col("event_type")
    return events(spark, d).agg(F.count("*").alias("total"), F.count_if(t == "view").alias("processed"), F.count_if(t == "error").alias("failed"), F.count_if(~t.isin("view", "error")).alias("skipped"))


@add("failure_summary", "SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS rn FROM events GROUP BY 1,2) WHERE rn <= 3")
def failure_summary(spark, d):
    by = events(spark, d).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return by.withColumn("rn", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))).where("rn <= 3").drop("rn")


@add("parse_timestamps", "SELECT event_id, round((event_id % 5)*3600 + (user_id % 60)*60 + (event_id % 60) + (event_id % 1000)/1000.0e0,3) AS seconds FROM events")
def parse_timestamps(spark, d):
    from reelgrain.functions.text import srt_seconds

    e, u = F.col("event_id"), F.col("user_id")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    srt = F.concat(pad(e % 5, 2), F.lit(":"), pad(u % 60, 2), F.lit(":"), pad(e % 60, 2), F.lit(","), pad(e % 1000, 3))
    return events(spark, d).select("event_id", F.round(srt_seconds(srt), 3).alias("seconds"))


@add("iso_duration", "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 0 ELSE (user_id % 3)*3600 + (event_id % 60)*60 + event_id % 50 END AS seconds FROM events")
def iso_duration(spark, d):
    from reelgrain.functions.text import iso_seconds

    e, u = F.col("event_id"), F.col("user_id")
    s = lambda c: c.cast("string")
    text = F.when(e % 13 == 0, "P1D").otherwise(F.concat(F.lit("PT"), F.when(u % 3 > 0, F.concat(s(u % 3), F.lit("H"))).otherwise(""), s(e % 60), F.lit("M"), s(e % 50), F.lit("S")))
    return events(spark, d).select("event_id", iso_seconds(text).alias("seconds"))


@add("fpcalc_parse", "SELECT event_id, event_id % 900 AS duration, 'FP' || user_id AS fingerprint FROM events WHERE event_id % 900 >= 30")
def fpcalc_parse(spark, d):
    out = F.concat(F.lit("DURATION="), (F.col("event_id") % 900).cast("string"), F.lit("\nFINGERPRINT=FP"), F.col("user_id").cast("string"), F.lit("\n"))
    rows = events(spark, d).select("event_id", F.regexp_extract(out, r"(?m)^DURATION=(\d+)$", 1).try_cast("long").alias("duration"), F.regexp_extract(out, r"(?m)^FINGERPRINT=(\S+)$", 1).alias("fingerprint"))
    return rows.where("duration >= 30")


@add("hms", "SELECT event_id, lpad((s//3600)::VARCHAR,2,'0')||':'||lpad((s%3600//60)::VARCHAR,2,'0')||':'||lpad((s%60)::VARCHAR,2,'0') AS hms FROM (SELECT event_id, floor(value*100)::BIGINT AS s FROM events)")
def hms(spark, d):
    from reelgrain.functions.text import hms as to_hms

    return events(spark, d).select("event_id", to_hms(F.col("value") * 100).alias("hms"))


@add("miss_class", "SELECT event_id, CASE WHEN event_type='error' THEN 'transcripts_disabled' WHEN user_id % 4 = 0 THEN 'private_no_captions_api' WHEN event_type='click' AND event_id % 2 = 0 THEN 'no_caption_track' WHEN event_type='click' OR event_id % 2 = 1 THEN 'api_error' ELSE 'unknown' END AS class FROM events")
def miss_class(spark, d):
    from reelgrain.functions.text import miss_class as classify

    primary = F.when(F.col("event_type") == "error", "TranscriptsDisabled").when(F.col("event_type") == "click", "NoTranscriptFound")
    fallback = F.when(F.col("event_id") % 2 == 1, "HttpError")
    privacy = F.when(F.col("user_id") % 4 == 0, "Private")
    return events(spark, d).select("event_id", classify(primary, fallback, privacy).alias("class"))


@add("stream_daily", f"SELECT {_DAY} AS day, event_type, count(*) AS n FROM events GROUP BY 1,2")
def stream_daily(spark, d):
    return daily_counts_stream(spark, f"{d}/events.parquet")


# retention -----------------------------------------------------------------------------------------------------------


@add("retention_points", f"WITH {I.RETENTION} SELECT video_id, elapsed_ratio, round(audience_watch_ratio,6) AS audience_watch_ratio, round(relative_retention,6) AS relative_retention FROM ret")
def retention_points(spark, d):
    return I.retention(spark, d).select("video_id", "elapsed_ratio", F.round("audience_watch_ratio", 6).alias("audience_watch_ratio"), F.round("relative_retention", 6).alias("relative_retention"))


@add("retention_hotspots", f"WITH {I.RETENTION} SELECT video_id, elapsed_ratio FROM hot")
def retention_hotspots(spark, d):
    return I.hotspots(I.retention(spark, d)).select("video_id", "elapsed_ratio")


@add("skip_zones", f"WITH {I.RETENTION} SELECT video_id, elapsed_ratio FROM skips")
def skip_zones(spark, d):
    return I.hotspots(I.retention(spark, d), 0.7, above=False).select("video_id", "elapsed_ratio")


# difficulty, which a model gives to a chapter, is here the share of a segment's words of four characters or more
_WORDS = "list_filter(string_split_regex(coalesce(text,''),'[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')"


@add("video_suggestions", f"""WITH {I.RETENTION}, df AS (SELECT DISTINCT video_id FROM (SELECT video_id, {_WORDS} AS w FROM case_c_video2) WHERE len(w) > 0 AND len(list_filter(w, lambda x: length(x) >= 4))*1.0e0/len(w) > 0.7)
SELECT DISTINCT video_id, 'long' AS rule FROM videos WHERE duration_seconds > 1800 UNION ALL SELECT DISTINCT video_id, 'hotspots' FROM hot UNION ALL SELECT DISTINCT video_id, 'skips' FROM skips UNION ALL SELECT v.video_id, 'difficult' FROM df JOIN (SELECT DISTINCT video_id FROM videos) v USING (video_id)""")
def video_suggestions(spark, d):
    points = I.retention(spark, d)
    mean = points.groupBy("video_id").agg(F.avg("audience_watch_ratio").alias("m"))
    r = F.col("audience_watch_ratio")
    curve = points.join(mean, "video_id").groupBy("video_id").agg(F.bool_or(r > 1.3 * F.col("m")).alias("hot"), F.bool_or(r < 0.7 * F.col("m")).alias("skip"))
    w = words(F.coalesce("text", F.lit("")))
    hard = table(spark, d, "case_c_video2").select("video_id", F.try_divide(F.size(F.filter(w, lambda x: F.length(x) >= 4)).cast("double"), F.size(w).cast("double")).alias("x")).groupBy("video_id").agg(F.bool_or(F.coalesce(F.col("x") > 0.7, F.lit(False))).alias("hard"))
    v = I.videos(spark, d).select("video_id", "duration_seconds").join(curve, "video_id", "left").join(hard, "video_id", "left")
    rules = [("long", F.col("duration_seconds") > 1800), ("hotspots", F.col("hot")), ("skips", F.col("skip")), ("difficult", F.col("hard"))]
    return v.select("video_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules]))).alias("rule"))


# series: events a day of each user, orders a day of each priority --------------------------------------------------------

_ORDERS = "od AS (SELECT o_orderpriority AS key, o_orderdate::DATE AS day, count(*)::DOUBLE AS v FROM orders GROUP BY 1,2), ed AS (SELECT 'user ' || user_id AS key, ts::DATE AS day, count(*)::DOUBLE AS v FROM events GROUP BY 1,2), sr AS (SELECT * FROM od UNION ALL SELECT * FROM ed)"


def _series(spark, d) -> DataFrame:
    by_day = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").cast("double").alias("v"))
    return by_day.unionByName(_counts(spark, d).select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("key"), "day", "v"))


@add("detect_anomalies", f"WITH {_ORDERS}, z AS (SELECT *, (v-avg(v) OVER (PARTITION BY key))/nullif(stddev_pop(v) OVER (PARTITION BY key),0) AS z FROM sr) SELECT key, strftime(day,'%Y-%m-%d') AS day, round(z,5) AS z FROM z WHERE round(abs(z),9) > 3")
def detect_anomalies(spark, d):
    rows = O.anomalies(_series(spark, d), "key", "v").where("is_anomaly")
    return rows.select("key", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("z_score", 5).alias("z"))


@add("model_select", f"WITH {_ORDERS} SELECT key, max(day)-min(day)+1 AS days, CASE WHEN max(day)-min(day)+1 < 90 THEN 'linear' WHEN max(day)-min(day)+1 <= 365 THEN 'arima' ELSE 'prophet' END AS model FROM sr GROUP BY 1")
def model_select(spark, d):
    """The model by the number of days once gaps are filled."""
    days = (F.datediff(F.max("day"), F.min("day")) + 1).cast("long")
    return _series(spark, d).groupBy("key").agg(days.alias("days"), O.model_for(days).alias("model"))


@add("series_gate", f"WITH {_ORDERS} SELECT key, count(*) AS points, max(day)-min(day)+1 AS days, CASE WHEN max(day)-min(day)+1 < 90 THEN 'linear' WHEN max(day)-min(day)+1 <= 365 THEN 'arima' ELSE 'prophet' END AS model FROM sr GROUP BY 1 HAVING count(*) >= 180")
def series_gate(spark, d):
    """Series with data enough for a forecast: 180 points before gaps are filled."""
    days = (F.datediff(F.max("day"), F.min("day")) + 1).cast("long")
    return _series(spark, d).groupBy("key").agg(F.count("*").alias("points"), days.alias("days"), O.model_for(days).alias("model")).where("points >= 180")


@add("holiday_expand", "SELECT o_orderpriority AS holiday, strftime(day,'%Y-%m-%d') AS ds, 0 AS lower_window, 0 AS upper_window, count(*) AS events FROM (SELECT o_orderpriority, unnest(generate_series(o_orderdate::DATE, (o_orderdate::DATE + (o_orderkey % 4)::INT), INTERVAL 1 DAY)) AS day FROM orders WHERE o_orderstatus = 'F') GROUP BY 1,2")
def holiday_expand(spark, d):
    """Calendar events with a begin and an end as holidays, a row a day: orders stand for events of up to four days."""
    start = F.to_date("o_orderdate")
    events_ = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("holiday"), start.alias("start"), F.date_add(start, (F.col("o_orderkey") % 4).cast("int")).alias("end"))
    days = events_.select("holiday", F.explode(F.sequence("start", "end")).alias("day"))
    return days.groupBy("holiday", F.date_format("day", "yyyy-MM-dd").alias("ds")).agg(F.lit(0).alias("lower_window"), F.lit(0).alias("upper_window"), F.count("*").alias("events"))


_TODAY, _LAG, _LOOKBACK = "2024-01-30", 3, 730


@add("incremental_start", f"WITH k AS (SELECT DISTINCT event_type FROM events UNION SELECT 'never collected'), l AS (SELECT k.event_type, max(ts::DATE) AS last FROM k LEFT JOIN events e ON e.event_type=k.event_type AND e.user_id % 3 = 0 GROUP BY 1), e AS (SELECT DATE '{_TODAY}' - {_LAG} AS day) SELECT event_type, strftime(coalesce(last+1, day-{_LOOKBACK}),'%Y-%m-%d') AS start, strftime(day,'%Y-%m-%d') AS stop, coalesce(last+1, day-{_LOOKBACK}) > day AS up_to_date, strftime((SELECT min(last)+1 FROM l),'%Y-%m-%d') AS overall FROM l, e")
def incremental_start(spark, d):
    """Where each report goes on: the day after its last one, two years back if there is none, until three days before today."""
    kinds = events(spark, d).select("event_type").distinct().union(spark.createDataFrame([("never collected",)], "event_type string"))
    last = kinds.join(events(spark, d).where("user_id % 3 = 0").groupBy("event_type").agg(F.max("day").alias("last")), "event_type", "left")
    return O.incremental_ranges(last, "last", _TODAY, _LAG, _LOOKBACK).select("event_type", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("start", "stop")], "up_to_date", F.date_format("overall", "yyyy-MM-dd").alias("overall"))


@add("incremental_merge", f"SELECT {_DAY} AS day, count(*) AS n, round(sum(value)+1e-9,2) AS total FROM events WHERE ts::DATE <= DATE '2024-01-27' GROUP BY 1")
def incremental_merge(spark, d):
    """Daily metrics kept until one day, of which the last three were incomplete, merged with what is read again from there."""
    rows = events(spark, d).where("day <= date'2024-01-27'")
    by = lambda x: x.groupBy("day").agg(F.count("*").alias("n"), _sum("value"))
    kept = by(rows.where("day <= date'2024-01-20' and (day < date'2024-01-18' or event_id % 2 = 0)"))
    read = by(rows.where(F.col("day") >= F.date_sub(F.lit("2024-01-20").cast("date"), _LAG - 1)))
    return merge(kept, read, ["day"]).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "total")


@add("trend_chart", """WITH p AS (SELECT event_type, (ts::DATE - DATE '0001-01-01')+1 AS x, count(*)::DOUBLE AS y FROM events GROUP BY 1,2), f AS (SELECT event_type, regr_slope(y,x) s, regr_intercept(y,x) i, max(x) l, count(*) n FROM p GROUP BY 1),
e AS (SELECT event_type, sum((y-s*x-i)*(y-s*x-i)) sse FROM p JOIN f USING (event_type) GROUP BY 1), q AS (SELECT *, sqrt(sse/greatest(n-2,1)) AS rse FROM f JOIN e USING (event_type)), fc AS (SELECT event_type, l+t.step AS x, t.step AS step, s*(l+t.step)+i AS y, 1.96*rse AS b FROM q, range(1,8) t(step))
SELECT event_type, 'actual' AS kind, x::INT AS x, x::INT AS place, round(y,3) AS y FROM p UNION ALL SELECT event_type, 'forecast', x::INT, step::INT, round(y,3) FROM fc UNION ALL SELECT event_type, 'band', x::INT, step::INT, round(y+b,3) FROM fc UNION ALL SELECT event_type, 'band', x::INT, (15-step)::INT, round(y-b,3) FROM fc""")
def trend_chart(spark, d):
    """Points of a trend chart: actual values, the forecast, and its band as a polygon, upper side forwards and lower side backwards."""
    points = events(spark, d).groupBy("event_type", (F.datediff("day", F.lit("0001-01-01").cast("date")) + 1).alias("x")).agg(F.count("*").cast("double").alias("y"))
    last = points.groupBy("event_type").agg(F.max("x").alias("last"))
    fc = O.linear_forecast(points, "event_type", "x", "y", 7).join(last, "event_type").withColumn("x", F.col("last") + F.col("step"))
    point = lambda kind, place, y: F.struct(F.lit(kind).alias("kind"), place.cast("int").alias("place"), F.col(y).alias("y"))
    drawn = fc.select("event_type", "x", F.explode(F.array(point("forecast", F.col("step"), "predicted"), point("band", F.col("step"), "upper"), point("band", 15 - F.col("step"), "lower"))).alias("p")).select("event_type", "p.kind", "x", "p.place", F.round("p.y", 3).alias("y"))
    return points.select("event_type", F.lit("actual").alias("kind"), "x", F.col("x").alias("place"), F.round("y", 3).alias("y")).unionByName(drawn)


@add("preset", "WITH h AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'gpu-native' END AS explicit, CASE WHEN p_partkey % 13 = 0 THEN 'cpu' END AS env, CASE WHEN p_partkey % 7 <> 0 THEN p_size/1.5e0 END AS vram, p_partkey % 3 AS gpus FROM part) SELECT p_partkey, coalesce(explicit, env, CASE WHEN vram IS NULL OR vram < 4 THEN 'cpu' WHEN vram < 16 THEN 'gpu-quantized' WHEN gpus > 1 THEN 'gpu-pool' ELSE 'gpu-native' END) AS preset, CASE WHEN explicit IS NOT NULL THEN 'explicit' WHEN env IS NOT NULL THEN 'env' ELSE 'auto' END AS source FROM h")
def preset(spark, d):
    """The preset of each host: asked for, else of its environment, else by its video memory (parts stand for hosts)."""
    k = F.col("p_partkey")
    hosts = table(spark, d, "part").select("p_partkey", F.when(k % 11 == 0, "gpu-native").alias("explicit"), F.when(k % 13 == 0, "cpu").alias("env"), F.when(k % 7 != 0, F.col("p_size") / 1.5).alias("vram"), (k % 3).alias("gpus"))
    source = F.when(F.col("explicit").isNotNull(), "explicit").when(F.col("env").isNotNull(), "env").otherwise("auto")
    return hosts.select("p_partkey", F.coalesce("explicit", "env", S.preset(F.col("vram"), F.col("gpus"))).alias("preset"), source.alias("source"))


@add("raced_overall", f"WITH {I.EQS} SELECT detail_id, round(CASE WHEN greatest({','.join(I.AXES)}) > 0 THEN ({'+'.join(I.AXES)})/5.0e0 ELSE 0.0e0 END,6) AS overall FROM ax")
def raced_overall(spark, d):
    return I.axes(spark, d).select("detail_id", F.round(S.raced(*[F.col(a) for a in I.AXES]), 6).alias("overall"))


# lifecycle -----------------------------------------------------------------------------------------------------------


@add("phase_status", "SELECT p.phase, coalesce(done,0) AS done, coalesce(n,0) AS total, coalesce(done,0) || '/' || coalesce(n,0) AS status FROM (VALUES ('view'),('click'),('missing')) p(phase) LEFT JOIN (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE user_id % 2 = 0) AS done FROM events GROUP BY 1) e ON e.event_type=p.phase")
def phase_status(spark, d):
    phases = spark.createDataFrame([("view",), ("click",), ("missing",)], "phase string")
    n = events(spark, d).groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("total"), F.count_if(F.col("user_id") % 2 == 0).alias("done"))
    rows = phases.join(n, "phase", "left").na.fill(0, ["done", "total"])
    return rows.select("phase", "done", "total", F.concat_ws("/", F.col("done").cast("string"), F.col("total").cast("string")).alias("status"))


@add("phase_resume", "WITH c AS (SELECT event_type AS phase, max(event_id) AS last FROM events WHERE user_id < 40 AND event_type <> 'error' GROUP BY 1) SELECT event_type AS phase, count(*) AS remaining, min(event_id) AS next FROM events e LEFT JOIN c ON c.phase=e.event_type WHERE e.event_id > coalesce(c.last,-1) GROUP BY 1")
def phase_resume(spark, d):
    """What is left of each phase after its checkpoint; a phase without one begins anew."""
    rows = events(spark, d).select(F.col("event_type").alias("phase"), "event_id")
    points = L.checkpoints(events(spark, d).where("user_id < 40 and event_type <> 'error'").select(F.col("event_type").alias("phase"), "event_id"), "phase", "event_id")
    return L.resumed(rows, points, "phase", "event_id").groupBy("phase").agg(F.count("*").alias("remaining"), F.min("event_id").alias("next"))


@add("stage_markers", "SELECT user_id, bool_or(event_type='view') AS collected, bool_or(event_type='view') AND bool_or(event_type='click') AS compared, bool_or(event_type='view') AND bool_or(event_type='click') AND bool_or(event_type='purchase') AS reported FROM events GROUP BY 1")
def stage_markers(spark, d):
    """Which stages of a run are complete: a stage is, once it and all before it have left their marker."""
    return L.completed(events(spark, d).select("user_id", "event_type"), "user_id", "event_type", {"collected": "view", "compared": "click", "reported": "purchase"})


@add("stage_transition", """WITH q AS (SELECT user_id, event_id, value, list_position(['view','click','scroll','purchase','error'], event_type) AS st FROM events WHERE event_type IN ('view','click','scroll','purchase','error')), m AS (SELECT *, max(st) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM q)
SELECT user_id, max(st)::BIGINT AS stage, count(*) FILTER (WHERE st < b) AS refused, arg_max(event_id, event_id) FILTER (WHERE NOT coalesce(st < b,false)) AS last_event FROM m GROUP BY 1""")
def stage_transition(spark, d):
    """Guarded transitions: a request to go back to an earlier stage is refused, the others are applied in their order."""
    stage = F.array_position(F.array(*[F.lit(x) for x in ("view", "click", "scroll", "purchase", "error")]), F.col("event_type"))
    return L.transitions(events(spark, d).where(stage > 0).select("user_id", "event_id", stage.alias("stage")), "user_id", "event_id", "stage")


@add("job_results", "SELECT user_id, count(*) AS n, max(event_id) AS last FROM (SELECT * FROM events WHERE event_type = 'purchase' UNION ALL SELECT * FROM events WHERE event_type = 'click') WHERE user_id IN (1, 2, 3) GROUP BY 1")
def job_results(spark, d):
    """Results of jobs as an append, and their reading by key."""
    e = events(spark, d).select("user_id", "event_id", "event_type")
    both = e.where("event_type = 'purchase'").unionByName(e.where("event_type = 'click'"))
    return both.where(F.col("user_id").isin(1, 2, 3)).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
