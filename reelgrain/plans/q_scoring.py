"""Queries on pairs: scores, grades, layers, patterns, filters, top-k and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrain.functions import scoring as S
from reelgrain.functions import text as T
from reelgrain.operators import governance as G
from reelgrain.operators import lifecycle as L
from reelgrain.operators.facts import canonical, latest, merge, ranked, unique_videos
from reelgrain.plans import inputs as I
from reelgrain.plans import q_captions as C
from reelgrain.plans.registry import Registry
from reelgrain.storage import table

QUERIES = Registry()
add = QUERIES.add
POLICY = S.Policy()
#: Videos, of some 30 bytes each, up to which their durations are broadcast.
BROADCAST_VIDEOS = 1_000_000

_SCORE5 = "round(greatest(0.0, least(100.0, 30.0*CAST(i1_hash_match AS INT) + 25.0*greatest(0.0,least(1.0,i2_cosine_similarity)) + 20.0*greatest(0.0,least(1.0,1.0-i3_change_rate)) + 15.0*(1.0/(1.0+i4_new_term_count)) + 10.0*greatest(0.0, 1.0-abs(i5_duration_diff_seconds)/60.0))) + 1e-9, 2)"
_GRADE = "CASE WHEN {0} >= 80 THEN 'critical' WHEN {0} >= 60 THEN 'high' WHEN {0} >= 40 THEN 'moderate' ELSE 'normal' END"
_VID = "v AS (SELECT DISTINCT video_id, channel_id, duration_seconds, title, view_count, published_at FROM videos)"


def results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "comparison_results")


def score5():
    return S.suspicion5(F.col("i1_hash_match"), F.col("i2_cosine_similarity"), F.col("i3_change_rate"), F.col("i4_new_term_count"), F.col("i5_duration_diff_seconds"))


def five():
    return [F.col(c) for c in ("i1_hash_match", "i2_cosine_similarity", "i3_change_rate", "i4_new_term_count", "i5_duration_diff_seconds")]


@add("entry_topk_pairs", f"""WITH s AS (SELECT id, source_video_id, target_video_id, {_SCORE5} AS score FROM comparison_results)
SELECT id, source_video_id, target_video_id, score, {_GRADE.format('score')} AS grade FROM s ORDER BY score DESC NULLS LAST, id LIMIT 100""")
def entry_topk_pairs(spark, d):
    rows = results(spark, d).select("id", "source_video_id", "target_video_id", score5().alias("score"))
    return rows.withColumn("grade", S.grade(F.col("score"))).orderBy(F.desc_nulls_last("score"), "id").limit(100)


@add("suspicion5", f"WITH s AS (SELECT id, {_SCORE5} AS score FROM comparison_results) SELECT id, score, {_GRADE.format('score')} AS grade FROM s")
def suspicion5(spark, d):
    return results(spark, d).select("id", score5().alias("score")).withColumn("grade", S.grade(F.col("score")))


_N8 = {"i1": "CAST(CAST(i1_hash_match AS INT) AS DOUBLE)", "i2": "greatest(0.0,least(1.0,i2_cosine_similarity))", "i3": "greatest(0.0,1.0-i3_change_rate)", "i4": "greatest(0.0,1.0-i4_new_term_count/100.0)", "i5": "greatest(0.0,1.0-abs(i5_duration_diff_seconds)/600.0)"}
_W5 = sum(POLICY.weights[k] for k in _N8)


@add("suspicion8", f"SELECT id, round(greatest(0.0,least(100.0,100.0*({' + '.join(f'{x}*{POLICY.weights[k] / _W5!r}' for k, x in _N8.items())})))+1e-9,2) AS score FROM comparison_results")
def suspicion8(spark, d):
    return results(spark, d).select("id", S.composite8(POLICY, *five()).alias("score"))


_AXIS = "i5_duration_diff_seconds AS i6, i3_change_rate*100 AS i7, 1.0-i3_change_rate AS i8"


@add("suspicion8_time_axis", f"WITH x AS (SELECT *, {_AXIS} FROM comparison_results) SELECT id, round(greatest(0.0,least(100.0,100.0*({' + '.join(f'{x}*{POLICY.weights[k]!r}' for k, x in _N8.items())} + least(1.0,i6/1200.0)*0.2 + greatest(0.0,1.0-i7/300.0)*0.1 + i8*0.1)))+1e-9,2) AS score FROM x")
def suspicion8_time_axis(spark, d):
    axis = F.col("i5_duration_diff_seconds"), F.col("i3_change_rate") * 100, 1.0 - F.col("i3_change_rate")
    return results(spark, d).select("id", S.composite8(POLICY, *five(), *axis).alias("score"))


@add("grade_counts", "SELECT g.grade, count(c.id) AS n FROM (VALUES ('critical'),('high'),('moderate'),('normal')) g(grade) LEFT JOIN comparison_results c ON lower(trim(c.grade)) = g.grade GROUP BY 1")
def grade_counts(spark, d):
    fixed = spark.createDataFrame([(g,) for g in ("critical", "high", "moderate", "normal")], "grade string")
    n = results(spark, d).groupBy(F.lower(F.trim("grade")).alias("grade")).agg(F.count("*").alias("n"))
    return fixed.join(n, "grade", "left").na.fill(0, ["n"])


@add("reuse_summary", """SELECT coalesce(professor,'') AS professor, count(*) AS n, count(*) FILTER (WHERE lower(trim(grade))='critical') AS critical, count(*) FILTER (WHERE lower(trim(grade))='high') AS high,
count(*) FILTER (WHERE lower(trim(grade))='moderate') AS moderate, count(*) FILTER (WHERE lower(trim(grade))='normal') AS normal, count(*) FILTER (WHERE review_status IS NOT NULL) AS reviewed, round(avg(coalesce(suspicion_score,0))+1e-9,2) AS mean_score FROM comparison_results GROUP BY 1""")
def reuse_summary(spark, d):
    g = F.lower(F.trim("grade"))
    counts = [F.count_if(g == x).alias(x) for x in ("critical", "high", "moderate", "normal")]
    return results(spark, d).groupBy(F.coalesce("professor", F.lit("")).alias("professor")).agg(F.count("*").alias("n"), *counts, F.count_if(F.col("review_status").isNotNull()).alias("reviewed"), F.round(F.avg(F.coalesce("suspicion_score", F.lit(0.0))) + S.TIE, 2).alias("mean_score"))


def with_durations(spark, d, *cols: str) -> DataFrame:
    """Pairs with the durations of both videos.

    The two numbers of a video are a narrow table: it is broadcast while it has at most BROADCAST_VIDEOS rows, so that videos
    compared very often don't make a hot key; beyond, both sides are shuffled and skewed partitions split as they run.
    """
    v = unique_videos(table(spark, d, "videos")).select("video_id", "duration_seconds")
    near = table(spark, d, "videos").count() <= BROADCAST_VIDEOS
    rows = results(spark, d).select("id", "source_video_id", "target_video_id", *cols)
    for side in ("source", "target"):
        own = v.withColumnsRenamed({"video_id": f"{side}_video_id", "duration_seconds": f"{side}_duration"})
        rows = rows.join(F.broadcast(own) if near else own, f"{side}_video_id", "left")
    return rows


_DUR = f"{_VID}, p AS (SELECT c.*, a.duration_seconds AS source_duration, b.duration_seconds AS target_duration FROM comparison_results c LEFT JOIN v a ON a.video_id=c.source_video_id LEFT JOIN v b ON b.video_id=c.target_video_id)"


@add("pattern4", f"""WITH {_DUR} SELECT id, CASE WHEN least(source_duration,target_duration) > 0 AND source_duration IS NOT NULL AND target_duration IS NOT NULL THEN
(CASE WHEN i2_cosine_similarity >= 0.5 THEN 'whole' ELSE 'scattered' END) || (CASE WHEN session=1 THEN '-same-week' ELSE '-different-week' END) END AS pattern FROM p""")
def pattern4(spark, d):
    rows = with_durations(spark, d, "i2_cosine_similarity", "session")
    shorter = F.when(F.col("source_duration").isNotNull() & F.col("target_duration").isNotNull(), F.least("source_duration", "target_duration"))
    return rows.select("id", S.pattern4(F.round(F.col("i2_cosine_similarity") * shorter, 9), shorter, F.col("session") == 1, 0.5 - 1e-12).alias("pattern"))


@add("attribution_parse", """SELECT id, CASE WHEN review_status IS NULL THEN NULL ELSE 'D' END AS layer FROM comparison_results""")
def attribution_parse(spark, d):
    raw = F.when(F.col("review_status").isNull(), "not json").otherwise('[{"layer":"D","action":"x","reason":"y"}]')
    parsed = F.coalesce(F.from_json(raw, "array<struct<layer:string,action:string,reason:string>>", {"mode": "PERMISSIVE"}), F.array().cast("array<struct<layer:string,action:string,reason:string>>"))
    return results(spark, d).select("id", F.explode_outer(F.filter(parsed, lambda x: x["layer"].isNotNull())).alias("t")).select("id", "t.layer")


@add("topk_pairs", f"SELECT id, suspicion_score, {_GRADE.format('suspicion_score')} AS grade FROM comparison_results ORDER BY suspicion_score DESC NULLS LAST, id LIMIT 50")
def topk_pairs(spark, d):
    return results(spark, d).orderBy(F.desc_nulls_last("suspicion_score"), "id").limit(50).select("id", "suspicion_score", S.grade(F.col("suspicion_score")).alias("grade"))


@add("topk_join", f"""WITH {_VID}, k AS (SELECT * FROM comparison_results ORDER BY i2_cosine_similarity DESC NULLS LAST, id LIMIT 200)
SELECT k.id, a.title AS source_title, b.title AS target_title, a.duration_seconds AS source_duration, b.duration_seconds AS target_duration FROM k LEFT JOIN v a ON a.video_id=k.source_video_id LEFT JOIN v b ON b.video_id=k.target_video_id""")
def topk_join(spark, d):
    k = results(spark, d).orderBy(F.desc_nulls_last("i2_cosine_similarity"), "id").limit(200).select("id", "source_video_id", "target_video_id")
    v = unique_videos(table(spark, d, "videos")).select("video_id", "title", "duration_seconds")
    for side in ("source", "target"):
        k = k.join(v.withColumnsRenamed({"video_id": f"{side}_video_id", "title": f"{side}_title", "duration_seconds": f"{side}_duration"}), f"{side}_video_id", "left")
    return k.select("id", "source_title", "target_title", "source_duration", "target_duration")


@add("appendix_filter", "SELECT id FROM comparison_results WHERE coalesce(i2_cosine_similarity >= 0.8,false) OR coalesce(i3_change_rate <= 0.2,false) OR coalesce(suspicion_score >= 60,false)")
def appendix_filter(spark, d):
    tests = [F.col("i2_cosine_similarity") >= 0.8, F.col("i3_change_rate") <= 0.2, F.col("suspicion_score") >= 60]
    return results(spark, d).where(tests[0] | tests[1] | tests[2]).select("id")


@add("pattern_distribution", "SELECT coalesce(nullif(lower(trim(grade)),''),'UNKNOWN') AS pattern, count(*) AS n FROM comparison_results GROUP BY 1")
def pattern_distribution(spark, d):
    return results(spark, d).groupBy(F.coalesce(F.nullif(F.lower(F.trim("grade")), F.lit("")), F.lit("UNKNOWN")).alias("pattern")).agg(F.count("*").alias("n"))


@add("distinct_videos", "SELECT coalesce(professor,'') AS professor, count(DISTINCT v) AS n FROM (SELECT professor, source_video_id v FROM comparison_results UNION SELECT professor, target_video_id FROM comparison_results) GROUP BY 1")
def distinct_videos(spark, d):
    r = results(spark, d)
    ids = r.select("professor", F.explode(F.array("source_video_id", "target_video_id")).alias("v"))
    return ids.groupBy(F.coalesce("professor", F.lit("")).alias("professor")).agg(F.countDistinct("v").alias("n"))


@add("pair_period", "SELECT coalesce(professor,'') AS professor, min(epoch_us(created_at)) AS first_us, max(epoch_us(created_at)) AS last_us, count(*) AS n FROM comparison_results GROUP BY 1")
def pair_period(spark, d):
    us = F.unix_micros("created_at")
    return results(spark, d).groupBy(F.coalesce("professor", F.lit("")).alias("professor")).agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.count("*").alias("n"))


@add("pattern_filter", "SELECT id FROM comparison_results WHERE lower(trim(grade)) IN ('critical','high') AND (professor = '강종인' OR course = 'SQL 활용')")
def pattern_filter(spark, d):
    return results(spark, d).where(F.lower(F.trim("grade")).isin("critical", "high") & ((F.col("professor") == "강종인") | (F.col("course") == "SQL 활용"))).select("id")


@add("comparison_list", "SELECT id, row_number() OVER (PARTITION BY course ORDER BY suspicion_score DESC NULLS LAST, id) AS place FROM comparison_results WHERE review_status IS NOT NULL AND lower(trim(grade)) = 'high'")
def comparison_list(spark, d):
    rows = results(spark, d).where(F.col("review_status").isNotNull() & (F.lower(F.trim("grade")) == "high"))
    return ranked(rows.select("id", "course", "suspicion_score"), "course", ["suspicion_score", "id"]).select("id", "place")


@add("status_list", "SELECT review_status, count(*) AS n, min(id) AS first_id FROM comparison_results WHERE review_status IS NOT NULL GROUP BY 1")
def status_list(spark, d):
    return results(spark, d).where("review_status is not null").groupBy("review_status").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@add("resolved_pairs", "SELECT id, lower(review_status) AS review_status FROM comparison_results WHERE lower(review_status) LIKE '%confirm%' OR lower(review_status) LIKE '%false%'")
def resolved_pairs(spark, d):
    s = F.lower("review_status")
    return results(spark, d).where(F.contains(s, F.lit("confirm")) | F.contains(s, F.lit("false"))).select("id", s.alias("review_status"))


@add("point_lookup", "SELECT id, source_video_id, target_video_id FROM comparison_results WHERE id IN (1, 100, 10000)")
def point_lookup(spark, d):
    return results(spark, d).where(F.col("id").isin(1, 100, 10000)).select("id", "source_video_id", "target_video_id")


@add("unfinished_pairs", """WITH x AS (SELECT DISTINCT least(source_video_id,target_video_id) lo, greatest(source_video_id,target_video_id) hi FROM comparison_results WHERE source_video_id <> target_video_id),
done AS (SELECT DISTINCT least(source_video_id,target_video_id) lo, greatest(source_video_id,target_video_id) hi FROM comparison_results WHERE reviewed_at IS NOT NULL)
SELECT lo, hi FROM x ANTI JOIN done USING (lo, hi)""")
def unfinished_pairs(spark, d):
    rows = canonical(results(spark, d), "source_video_id", "target_video_id")
    return rows.where("source_video_id <> target_video_id").select("lo", "hi").distinct().join(rows.where("reviewed_at is not null").select("lo", "hi"), ["lo", "hi"], "left_anti")


@add("whitelist_filter", """WITH w AS (SELECT DISTINCT least(source_video_id,target_video_id) lo, greatest(source_video_id,target_video_id) hi FROM comparison_results WHERE lower(review_status) LIKE '%false%')
SELECT id FROM comparison_results c WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.lo = least(c.source_video_id,c.target_video_id) AND w.hi = greatest(c.source_video_id,c.target_video_id))""")
def whitelist_filter(spark, d):
    rows = canonical(results(spark, d).select("id", "source_video_id", "target_video_id", "review_status"), "source_video_id", "target_video_id")
    return rows.join(rows.where(F.contains(F.lower("review_status"), F.lit("false"))).select("lo", "hi"), ["lo", "hi"], "left_anti").select("id")


@add("resume_skip", "SELECT c.id FROM comparison_results c ANTI JOIN (SELECT source_video_id, target_video_id FROM comparison_results WHERE reviewed_by IS NOT NULL) s USING (source_video_id, target_video_id)")
def resume_skip(spark, d):
    r = results(spark, d).select("id", "source_video_id", "target_video_id", "reviewed_by")
    return r.join(r.where("reviewed_by is not null").select("source_video_id", "target_video_id"), ["source_video_id", "target_video_id"], "left_anti").select("id")


@add("curated_decision", "WITH w AS (SELECT source_video_id s, target_video_id t, arg_max(lower(review_status), id) AS decision FROM comparison_results WHERE lower(review_status) LIKE '%confirm%' OR lower(review_status) LIKE '%false%' GROUP BY 1,2) SELECT c.id, w.decision FROM comparison_results c LEFT JOIN w ON w.s = split_part(c.source_video_id || ':' || c.target_video_id, ':', 1) AND w.t = split_part(c.source_video_id || ':' || c.target_video_id, ':', 2)")
def curated_decision(spark, d):
    r = results(spark, d)
    s = F.lower("review_status")
    known = r.where(F.contains(s, F.lit("confirm")) | F.contains(s, F.lit("false"))).groupBy(F.col("source_video_id").alias("s"), F.col("target_video_id").alias("t")).agg(F.max_by(s, "id").alias("decision"))
    key = F.split(F.concat_ws(":", "source_video_id", "target_video_id"), ":", 2)
    return r.select("id", key[0].alias("s"), key[1].alias("t")).join(known, ["s", "t"], "left").select("id", "decision")


@add("yearly_match", """WITH t AS (SELECT * FROM comparison_results WHERE course <> '' QUALIFY row_number() OVER (PARTITION BY course,week,session,year_from ORDER BY id DESC)=1)
SELECT a.id AS from_id, b.id AS to_id FROM t a JOIN t b ON a.course=b.course AND a.week=b.week AND a.session=b.session AND a.year_from + 1 = b.year_from""")
def yearly_match(spark, d):
    key = ["course", "week", "session"]
    rows = latest(results(spark, d).where("course <> ''").select("id", "year_from", *key), [*key, "year_from"], [F.col("id")])
    after = rows.select(*key, (F.col("year_from") - 1).alias("year_from"), F.col("id").alias("to_id"))
    return rows.withColumnRenamed("id", "from_id").join(after, [*key, "year_from"]).select("from_id", "to_id")


@add("source_types", """WITH o AS (SELECT video_id, min(CASE lower(caption_source) WHEN 'whisper' THEN 'asr' WHEN 'captions_api' THEN 'api' WHEN 'transcript_api' THEN 'api' WHEN 'manual' THEN 'manual' ELSE 'unknown' END) AS o FROM case_c_video2 WHERE caption_source IS NOT NULL GROUP BY 1),
p AS (SELECT c.id, coalesce(a.o,'unknown') s, coalesce(b.o,'unknown') t FROM comparison_results c LEFT JOIN o a ON a.video_id=c.source_video_id LEFT JOIN o b ON b.video_id=c.target_video_id)
SELECT id, CASE WHEN list_position(['manual','asr','api','unknown'], s) <= list_position(['manual','asr','api','unknown'], t) THEN s||'-'||t ELSE t||'-'||s END AS pair FROM p""")
def source_types(spark, d):
    o = table(spark, d, "case_c_video2").where("caption_source is not null").groupBy("video_id").agg(F.min(T.mapped(F.lower("caption_source"), T.ORIGIN, "unknown")).alias("o"))
    rows = results(spark, d).select("id", "source_video_id", "target_video_id")
    for side in ("source", "target"):
        rows = rows.join(o.withColumnsRenamed({"video_id": f"{side}_video_id", "o": side}), f"{side}_video_id", "left")
    rows = rows.na.fill("unknown", ["source", "target"])
    return rows.select("id", T.origin_pair(F.col("source"), F.col("target")).alias("pair"))


@add("duration_diff", f"WITH {_DUR} SELECT id, abs(source_duration - target_duration) AS diff FROM p WHERE source_duration IS NOT NULL AND target_duration IS NOT NULL")
def duration_diff(spark, d):
    return with_durations(spark, d).where("source_duration is not null and target_duration is not null").select("id", F.abs(F.col("source_duration") - F.col("target_duration")).alias("diff"))


@add("layer_a", f"WITH {_DUR} SELECT id FROM p WHERE source_duration >= 1200 AND target_duration >= 1200")
def layer_a(spark, d):
    # least(a, b) >= t as two one-sided filters, each pushed below its join
    return with_durations(spark, d).where("source_duration >= 1200 and target_duration >= 1200").select("id")


@add("raw_vs_culled", "SELECT channel_id, count(*)*(count(*)-1)//2 AS raw, count(*) FILTER (WHERE duration_seconds>=1200)*(count(*) FILTER (WHERE duration_seconds>=1200)-1)//2 AS kept FROM (SELECT DISTINCT video_id, channel_id, duration_seconds FROM videos) GROUP BY 1")
def raw_vs_culled(spark, d):
    # least(a, b) >= t holds for exactly the pairs of videos that are long enough: counted, never enumerated
    n, k = F.count("*"), F.count_if(F.col("duration_seconds") >= 1200)
    pairs = lambda x: F.floor(x * (x - 1) / 2).cast("long")
    return unique_videos(table(spark, d, "videos")).groupBy("channel_id").agg(pairs(n).alias("raw"), pairs(k).alias("kept"))


@add("nc2_length_pairs", "WITH v AS (SELECT DISTINCT video_id, channel_id, duration_seconds FROM videos) SELECT video_id, count(*) OVER (PARTITION BY channel_id) - 1 AS partners FROM v WHERE duration_seconds >= 1200")
def nc2_length_pairs(spark, d):
    # the pairs of a channel's long videos, as the number of partners of each
    rows = unique_videos(table(spark, d, "videos")).where("duration_seconds >= 1200")
    n = rows.groupBy("channel_id").agg((F.count("*") - 1).alias("partners"))
    return rows.join(n, rows["channel_id"].eqNullSafe(n["channel_id"])).select("video_id", "partners")


@add("run_progress", "SELECT coalesce(professor,'') AS professor, count(*) FILTER (WHERE reviewed_at IS NOT NULL) AS done, count(*) AS total, max(epoch_us(reviewed_at)) AS last_us FROM comparison_results GROUP BY 1")
def run_progress(spark, d):
    return results(spark, d).groupBy(F.coalesce("professor", F.lit("")).alias("professor")).agg(F.count("reviewed_at").alias("done"), F.count("*").alias("total"), F.max(F.unix_micros("reviewed_at")).alias("last_us"))


@add("resume_latest", "SELECT course, arg_max(id, (created_at, id)) AS run FROM comparison_results WHERE reviewed_at IS NULL GROUP BY 1")
def resume_latest(spark, d):
    return results(spark, d).where("reviewed_at is null").groupBy("course").agg(F.max_by("id", F.struct("created_at", "id")).alias("run"))


@add("review_update", "SELECT id, CASE WHEN id % 7 = 0 THEN 'confirmed' ELSE review_status END AS review_status FROM comparison_results")
def review_update(spark, d):
    r = results(spark, d).select("id", "review_status")
    updates = r.where("id % 7 = 0").select("id", F.lit("confirmed").alias("new"))
    return r.join(updates, "id", "left").select("id", F.coalesce("new", "review_status").alias("review_status"))


@add("insert_comparisons", """WITH o AS (SELECT * FROM comparison_results WHERE id % 3 <> 0), n AS (SELECT * FROM comparison_results WHERE id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY source_video_id,target_video_id ORDER BY id)=1)
SELECT id FROM o UNION ALL SELECT id FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.source_video_id=n.source_video_id AND o.target_video_id=n.target_video_id)""")
def insert_comparisons(spark, d):
    key = ["source_video_id", "target_video_id"]
    r = results(spark, d).select("id", *key)
    old, new = r.where("id % 3 <> 0"), latest(r.where("id % 3 = 0"), key, [-F.col("id")])
    return old.select("id").unionByName(new.join(old.select(*key), key, "left_anti").select("id"))


# layers and patterns over the spans of the source video: its caption segments, compared by the phrase form of their sample -----

_SPANS = f"""{C._C}, {C._BASE}, {C._WHITE}, sp AS (SELECT video_id, {C._L} AS len, b.f IS NOT NULL AS base, wl.f IS NOT NULL AS white FROM x LEFT JOIN b ON b.channel_id=x.channel_id AND b.f=x.f80 LEFT JOIN wl ON wl.channel_id=x.channel_id AND wl.f=x.f80),
ly AS (SELECT video_id, max(len) AS i6, round(sum(CASE WHEN base THEN len ELSE 0 END),6) AS base_s, count(*) FILTER (WHERE NOT base AND white) AS removed, count(*) FILTER (WHERE NOT base) AS remaining FROM sp GROUP BY 1),
tr AS (SELECT r.id, r.professor, r.grade, r.review_status, coalesce(i6 < 60,false) AS out, CASE WHEN coalesce(i6 < 60,false) THEN 'excluded' ELSE 'no-op' END AS a, CASE WHEN NOT coalesce(i6 < 60,false) AND coalesce(base_s,0) > 0 THEN 'subtracted' ELSE 'no-op' END AS b,
CASE WHEN NOT coalesce(i6 < 60,false) AND coalesce(removed,0) > 0 THEN 'subtracted' ELSE 'no-op' END AS d, CASE WHEN NOT coalesce(i6 < 60,false) AND coalesce(i2_cosine_similarity BETWEEN 0.60 AND 0.75,false) THEN 'demoted' ELSE 'no-op' END AS c FROM comparison_results r LEFT JOIN ly ON ly.video_id=r.source_video_id)"""


def span_layers(spark, d) -> DataFrame:
    """video_id, i6 (longest span), base_s (seconds of baseline phrases), removed (spans left after them that are whitelisted)."""
    rows = C.phrased(spark, d)
    hit = lambda known, name: known.select("channel_id", F.col("f").alias("f80"), F.lit(True).alias(name))
    rows = rows.join(hit(C.baseline(rows), "base"), ["channel_id", "f80"], "left").join(hit(C.whitelist(rows), "white"), ["channel_id", "f80"], "left")
    base = F.coalesce("base", F.lit(False))
    return rows.groupBy("video_id").agg(F.max(C._len()).alias("i6"), F.round(F.sum(F.when(base, C._len()).otherwise(0.0)), 6).alias("base_s"), F.count_if(~base & F.coalesce("white", F.lit(False))).alias("removed"))


def trails(spark, d) -> DataFrame:
    """id, professor, grade, review_status and t, the trail of the layers A, B, D and C of each pair."""
    rows = results(spark, d).select("id", "source_video_id", "professor", "grade", "review_status", "i2_cosine_similarity")
    rows = rows.join(span_layers(spark, d).withColumnRenamed("video_id", "source_video_id"), "source_video_id", "left")
    trail = S.layers(POLICY, F.col("i6"), F.col("i2_cosine_similarity"), F.coalesce("base_s", F.lit(0.0)), F.coalesce("removed", F.lit(0)))
    return rows.select("id", "professor", "grade", "review_status", trail.alias("t"))


@add("layer_cascade", f"WITH {_SPANS} SELECT id, a, b, d, c, CASE WHEN c='demoted' THEN 'moderate' ELSE lower(trim(grade)) END AS grade FROM tr")
def layer_cascade(spark, d):
    acts = [F.col("t")[i]["action"].alias(x) for i, x in enumerate("abdc")]
    return trails(spark, d).select("id", *acts, F.when(F.col("t")[3]["action"] == "demoted", "moderate").otherwise(F.lower(F.trim("grade"))).alias("grade"))


@add("attribution_totals", f"WITH {_SPANS} SELECT coalesce(lower(trim(grade)),'UNKNOWN') AS pattern, x.layer AS layer, x.action AS action, count(*) AS n, count(*) FILTER (WHERE review_status='FALSE_POSITIVE') AS false_positives FROM (SELECT *, unnest([{{'layer':'A','action':a}},{{'layer':'B','action':b}},{{'layer':'D','action':d}},{{'layer':'C','action':c}}]) AS x FROM tr) GROUP BY 1,2,3")
def attribution_totals(spark, d):
    """Totals over the trails as they are stored, in JSON: by pattern (here the grade), layer and action, with the false positives among them."""
    rows = trails(spark, d).withColumn("raw", F.to_json("t"))
    rows = rows.select(F.coalesce(F.lower(F.trim("grade")), F.lit("UNKNOWN")).alias("pattern"), "review_status", F.explode(F.from_json("raw", "array<struct<layer:string,action:string>>")).alias("x"))
    return rows.groupBy("pattern", "x.layer", "x.action").agg(F.count("*").alias("n"), F.count_if(F.col("review_status") == "FALSE_POSITIVE").alias("false_positives"))


@add("attribution_audit", f"WITH {_SPANS} SELECT id, x.layer AS layer, x.action AS action FROM (SELECT id, CASE WHEN review_status IS NULL THEN [NULL] ELSE [{{'layer':'A','action':a}},{{'layer':'B','action':b}},{{'layer':'D','action':d}},{{'layer':'C','action':c}}] END AS t FROM tr) q, unnest(t) u(x)")
def attribution_audit(spark, d):
    """A row per layer of each pair; a pair without a trail has one blank row."""
    rows = trails(spark, d).select("id", F.when(F.col("review_status").isNotNull(), F.to_json("t")).otherwise("not json").alias("raw"))
    parsed = F.filter(F.coalesce(F.from_json("raw", "array<struct<layer:string,action:string>>"), F.array().cast("array<struct<layer:string,action:string>>")), lambda x: x["layer"].isNotNull())
    return rows.select("id", F.explode_outer(parsed).alias("x")).select("id", "x.layer", "x.action")


@add("pattern6", f"""WITH {_DUR}, {_SPANS}, em AS (SELECT vec_id, list_transform(embedding, lambda x: floor((x::DOUBLE+1.0e0)*1000000000.0e0)::BIGINT) AS v FROM embeddings), ix AS (SELECT DISTINCT video_id, view_count % 500 AS vec_id FROM videos),
q AS (SELECT p.*, ly.i6, list_avg(list_transform(list_zip(ea.v,eb.v), lambda z: bit_count(xor(z[1],z[2])))) AS ham FROM p LEFT JOIN ly ON ly.video_id=p.source_video_id LEFT JOIN ix a ON a.video_id=p.source_video_id LEFT JOIN ix b ON b.video_id=p.target_video_id LEFT JOIN em ea ON ea.vec_id=a.vec_id LEFT JOIN em eb ON eb.vec_id=b.vec_id)
SELECT id, CASE WHEN least(source_duration,target_duration) > 0 AND source_duration IS NOT NULL AND target_duration IS NOT NULL THEN
CASE WHEN coalesce(round(ham,6) > 12,false) AND i2_cosine_similarity >= 0.85 AND coalesce(i6/least(source_duration,target_duration) >= 0.5,false) THEN 're-recorded-same-content'
WHEN 1.0-i3_change_rate >= 0.85 AND i3_change_rate <= 0.15 THEN 'tail-update' ELSE (CASE WHEN coalesce(i6/least(source_duration,target_duration) >= 0.8,false) THEN 'whole' ELSE 'scattered' END) || (CASE WHEN session=1 THEN '-same-week' ELSE '-different-week' END) END END AS pattern FROM q""")
def pattern6(spark, d):
    """The six patterns by longest span, bits that differ between the fingerprints of both videos, cosine and halves."""
    v = unique_videos(table(spark, d, "videos")).select("video_id", (F.col("view_count") % 500).alias("vec_id"))
    bits = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1.0) * 1000000000.0).cast("long"))
    e = table(spark, d, "embeddings").select("vec_id", bits.alias("v"))
    prints = v.join(e, "vec_id").select("video_id", "v")
    rows = with_durations(spark, d, "i2_cosine_similarity", "i3_change_rate", "session")
    # the fingerprints meet once per pair of videos, however often the two are compared
    key = ["source_video_id", "target_video_id"]
    pairs = rows.select(*key).distinct().join(prints.withColumnsRenamed({"video_id": key[0], "v": "a"}), key[0]).join(prints.withColumnsRenamed({"video_id": key[1], "v": "b"}), key[1])
    pairs = pairs.select(*key, F.round(S.bit_distance(F.col("a"), F.col("b")), 6).alias("ham"))
    rows = rows.join(pairs, key, "left").join(span_layers(spark, d).select(F.col("video_id").alias(key[0]), "i6"), key[0], "left")
    shorter = F.when(F.col("source_duration").isNotNull() & F.col("target_duration").isNotNull(), F.least("source_duration", "target_duration"))
    return rows.select("id", S.pattern6(F.col("i6"), shorter, F.col("session") == 1, F.col("ham"), F.col("i2_cosine_similarity"), 1.0 - F.col("i3_change_rate"), F.col("i3_change_rate"), 12).alias("pattern"))


@add("compare_pair", f"""WITH {_VID}, {C._C}, tx AS (SELECT video_id, sha256(string_agg(t,' ' ORDER BY start, segment_id)) AS h FROM (SELECT *, regexp_replace(text,'^[ \\t\\r\\n]+|[ \\t\\r\\n]+$','','g') AS t FROM c WHERE text IS NOT NULL) WHERE t <> '' GROUP BY 1),
em AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), m AS (SELECT v.video_id, h, duration_seconds AS s, e, list_distinct(list_filter(string_split_regex(title,'[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) AS w FROM v LEFT JOIN tx USING (video_id) LEFT JOIN em ON em.vec_id = v.view_count % 500)
SELECT r.id, coalesce(a.h = b.h,false) AS i1, round(coalesce(greatest(0.0,least(1.0,list_cosine_similarity(a.e,b.e))),0.0),5) AS i2, round(CASE WHEN a.w IS NULL OR b.w IS NULL THEN 1.0e0 WHEN len(list_distinct(a.w||b.w))=0 THEN 0.0e0 ELSE (2.0e0*len(list_distinct(a.w||b.w))-len(a.w)-len(b.w))/len(list_distinct(a.w||b.w)) END,6) AS i3,
CASE WHEN a.w IS NULL OR b.w IS NULL THEN 0 ELSE len(list_distinct(a.w||b.w))-len(a.w) END::BIGINT AS i4, coalesce(abs(a.s-b.s)::DOUBLE,60.0e0) AS i5 FROM comparison_results r LEFT JOIN m a ON a.video_id=r.source_video_id LEFT JOIN m b ON b.video_id=r.target_video_id""")
def compare_pair(spark, d):
    """The five indicators of every pair: equal transcripts, cosine of the videos' vectors, words of the titles, durations.

    What a video lacks has the indicator's default: false, 0, 1, 0 and 60. Each pair of videos is compared once.
    """
    from reelgrain.plans.q_captions import full_text

    v = unique_videos(table(spark, d, "videos")).select("video_id", F.col("duration_seconds").alias("s"), F.array_distinct(T.words(F.col("title"))).alias("w"), (F.col("view_count") % 500).alias("vec_id"))
    m = v.join(full_text(spark, d).select("video_id", F.col("hash").alias("h")), "video_id", "left").join(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("e")), "vec_id", "left").drop("vec_id")
    key = ["source_video_id", "target_video_id"]
    rows = results(spark, d).select("id", *key)
    pairs = rows.select(*key).distinct()
    for side, k in zip("ab", key):
        pairs = pairs.join(m.select(F.col("video_id").alias(k), *[F.col(c).alias(f"{c}_{side}") for c in "hsew"]), k, "left")
    words = F.col("w_a").isNotNull() & F.col("w_b").isNotNull()
    i2 = F.when(F.col("e_a").isNotNull() & F.col("e_b").isNotNull(), S.cosine(F.col("e_a"), F.col("e_b"))).otherwise(0.0)
    pairs = pairs.select(*key, F.coalesce(F.col("h_a") == F.col("h_b"), F.lit(False)).alias("i1"), F.round(i2, 5).alias("i2"), F.round(F.when(words, T.change_rate(F.col("w_a"), F.col("w_b"))).otherwise(1.0), 6).alias("i3"), F.when(words, T.new_terms(F.col("w_a"), F.col("w_b"))).otherwise(0).cast("long").alias("i4"), F.coalesce(F.abs(F.col("s_a") - F.col("s_b")).cast("double"), F.lit(60.0)).alias("i5"))
    return rows.join(pairs, key).select("id", "i1", "i2", "i3", "i4", "i5")


# claims, reviews and reports ---------------------------------------------------------------------------------------------


@add("claim_next", "WITH g AS (SELECT *, coalesce(lower(trim(grade)),'') AS g FROM comparison_results), k AS (SELECT arg_min(id, (created_at, id)) AS id FROM g WHERE reviewed_by IS NULL GROUP BY g) SELECT id, CASE WHEN id IN (SELECT id FROM k) THEN 'worker_1' ELSE reviewed_by END AS claimed_by FROM g")
def claim_next(spark, d):
    """The table after a worker has claimed the oldest free row of each kind."""
    rows = results(spark, d).select("id", F.coalesce(F.lower(F.trim("grade")), F.lit("")).alias("g"), "created_at", F.col("reviewed_by").alias("owner"))
    return L.claimed(rows, F.col("owner").isNull(), "g", ["created_at", "id"], "id", "worker_1").select("id", "claimed_by")


@add("whitelist_pairs", "SELECT id, CASE WHEN id % 97 = 0 THEN 'FALSE_POSITIVE' ELSE review_status END AS review_status, CASE WHEN id % 97 = 0 THEN 'admin' ELSE reviewed_by END AS reviewed_by, epoch_us(CASE WHEN id % 97 = 0 THEN TIMESTAMPTZ '2024-01-01 00:00:00+00' ELSE reviewed_at END) AS us FROM comparison_results")
def whitelist_pairs(spark, d):
    r = results(spark, d).select("id", "review_status", "reviewed_by", "reviewed_at")
    asked = r.where("id % 97 = 0").select("id", F.lit("admin").alias("actor"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"))
    return G.whitelist_pairs(r, asked).select("id", "review_status", "reviewed_by", F.unix_micros("reviewed_at").alias("us"))


@add("whitelist_remove", "SELECT id, CASE WHEN id % 5 = 0 AND review_status = 'FALSE_POSITIVE' THEN 'UNREVIEWED' ELSE review_status END AS review_status, CASE WHEN id % 5 = 0 AND review_status = 'FALSE_POSITIVE' THEN NULL ELSE reviewed_by END AS reviewed_by FROM comparison_results")
def whitelist_remove(spark, d):
    r = results(spark, d).select("id", "review_status", "reviewed_by", "reviewed_at")
    return G.reset_pairs(r, r.where("id % 5 = 0").select("id")).select("id", "review_status", "reviewed_by")


@add("review_upsert", "SELECT id, CASE WHEN id % 5 = 0 THEN 'CONFIRMED_DUPLICATE' ELSE review_status END AS status, CASE WHEN id % 5 = 0 THEN coalesce(CASE WHEN id % 2 = 0 THEN 'web' END, reviewed_by) ELSE reviewed_by END AS actor FROM comparison_results WHERE review_status IS NOT NULL OR id % 5 = 0")
def review_upsert(spark, d):
    """Reviews of the web pages over those that are there; an actor that isn't given leaves the old one."""
    r = results(spark, d).select("id", "review_status", "reviewed_by")
    old = r.where("review_status is not null").select("id", F.col("review_status").alias("status"), F.col("reviewed_by").alias("actor"))
    new = r.where("id % 5 = 0").select("id", F.lit("CONFIRMED_DUPLICATE").alias("status"), F.when(F.col("id") % 2 == 0, "web").alias("actor"))
    return merge(old, new, ["id"], ["actor"]).join(r.select("id", "reviewed_by"), "id").select("id", "status", F.coalesce("actor", F.when(F.col("id") % 5 == 0, F.col("reviewed_by"))).alias("actor"))


_HIT = "(coalesce(i2_cosine_similarity >= 0.8,false) OR coalesce(i3_change_rate <= 0.2,false) OR coalesce(suspicion_score >= 60,false))"


@add("report_assembly", f"""WITH r AS (SELECT *, coalesce(professor,'') AS who FROM comparison_results), n AS (SELECT who, count(DISTINCT v) AS videos FROM (SELECT who, source_video_id AS v FROM r UNION SELECT who, target_video_id FROM r) GROUP BY 1),
k AS (SELECT who, array_to_string(list(id ORDER BY suspicion_score DESC NULLS LAST, id),'|') AS top FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY who ORDER BY suspicion_score DESC NULLS LAST, id) <= 5) GROUP BY 1)
SELECT who AS professor, count(*) AS pairs, any_value(videos) AS videos, min(epoch_us(created_at)) AS first_us, max(epoch_us(created_at)) AS last_us, count(*) FILTER (WHERE lower(trim(grade))='critical') AS critical, count(*) FILTER (WHERE lower(trim(grade))='high') AS high, count(*) FILTER (WHERE {_HIT}) AS appendix, any_value(top) AS top FROM r JOIN n USING (who) JOIN k USING (who) GROUP BY 1""")
def report_assembly(spark, d):
    """A professor's reuse report: pairs, different videos, period, grades, appendix and the five pairs of the highest score."""
    r = results(spark, d).withColumn("who", F.coalesce("professor", F.lit("")))
    g = F.lower(F.trim("grade"))
    hit = F.coalesce(F.col("i2_cosine_similarity") >= 0.8, F.lit(False)) | F.coalesce(F.col("i3_change_rate") <= 0.2, F.lit(False)) | F.coalesce(F.col("suspicion_score") >= 60, F.lit(False))
    by = r.groupBy("who").agg(F.count("*").alias("pairs"), F.min(F.unix_micros("created_at")).alias("first_us"), F.max(F.unix_micros("created_at")).alias("last_us"), F.count_if(g == "critical").alias("critical"), F.count_if(g == "high").alias("high"), F.count_if(hit).alias("appendix"))
    n = r.select("who", F.explode(F.array("source_video_id", "target_video_id")).alias("v")).groupBy("who").agg(F.countDistinct("v").alias("videos"))
    w = Window.partitionBy("who").orderBy(F.desc_nulls_last("suspicion_score"), "id")
    k = r.select("who", "id", "suspicion_score").withColumn("rn", F.row_number().over(w)).where("rn <= 5").groupBy("who").agg(F.concat_ws("|", F.transform(F.sort_array(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"].cast("string"))).alias("top"))
    return by.join(n, "who").join(k, "who").select(F.col("who").alias("professor"), "pairs", "videos", "first_us", "last_us", "critical", "high", "appendix", "top")


@add("pair_view_model", f"WITH {_VID} SELECT c.id, coalesce(nullif(a.duration_seconds,0),600) AS source_duration, coalesce(nullif(b.duration_seconds,0),600) AS target_duration, coalesce(nullif(a.title,''),c.source_video_id) AS source_title, coalesce(nullif(b.title,''),c.target_video_id) AS target_title, coalesce(nullif(lower(trim(c.grade)),''),'whole-same-week') AS pattern, row_number() OVER (PARTITION BY coalesce(nullif(lower(trim(c.grade)),''),'whole-same-week'), c.course ORDER BY c.suspicion_score DESC NULLS LAST, c.id) AS place FROM comparison_results c LEFT JOIN v a ON a.video_id=c.source_video_id LEFT JOIN v b ON b.video_id=c.target_video_id")
def pair_view_model(spark, d):
    """What a page shows of a pair: durations (600 seconds where unknown), titles, and its place among those of its pattern and course."""
    v = unique_videos(table(spark, d, "videos")).select("video_id", "duration_seconds", "title")
    rows = results(spark, d).select("id", "source_video_id", "target_video_id", "grade", "course", "suspicion_score")
    for x in ("source", "target"):
        rows = rows.join(v.withColumnsRenamed({"video_id": f"{x}_video_id", "duration_seconds": f"{x}_s", "title": f"{x}_t"}), f"{x}_video_id", "left")
    length = lambda x: F.coalesce(F.nullif(f"{x}_s", F.lit(0).cast("long")), F.lit(600).cast("long")).alias(f"{x}_duration")
    title = lambda x: F.coalesce(F.nullif(F.col(f"{x}_t"), F.lit("")), F.col(f"{x}_video_id")).alias(f"{x}_title")
    pattern = F.coalesce(F.nullif(F.lower(F.trim("grade")), F.lit("")), F.lit("whole-same-week"))
    rows = rows.select("id", length("source"), length("target"), title("source"), title("target"), pattern.alias("pattern"), F.to_json(F.struct(pattern.alias("p"), "course")).alias("own"), "suspicion_score")
    return ranked(rows, "own", ["suspicion_score", "id"]).drop("own", "suspicion_score")


@add("span_colour", f"WITH {C._C}, {C._BASE}, {C._WHITE} SELECT segment_id, round(start,3) AS start, round({C._L},3) AS width, substring(text,1,40) AS label, CASE WHEN b.f IS NOT NULL THEN 'gray' WHEN wl.f IS NOT NULL THEN 'lightyellow' ELSE 'steelblue' END AS colour FROM x LEFT JOIN b ON b.channel_id=x.channel_id AND b.f=x.f80 LEFT JOIN wl ON wl.channel_id=x.channel_id AND wl.f=x.f80")
def span_colour(spark, d):
    """Bars of a timeline: begin, width, label of forty characters and the colour by what the layers said of the span."""
    rows = C.phrased(spark, d)
    hit = lambda known, name: known.select("channel_id", F.col("f").alias("f80"), F.lit(True).alias(name))
    rows = rows.join(hit(C.baseline(rows), "base"), ["channel_id", "f80"], "left").join(hit(C.whitelist(rows), "white"), ["channel_id", "f80"], "left")
    colour = F.when(F.col("base"), "gray").when(F.col("white"), "lightyellow").otherwise("steelblue")
    return rows.select("segment_id", F.round("start", 3).alias("start"), F.round(C._len(), 3).alias("width"), F.substring("text", 1, 40).alias("label"), colour.alias("colour"))
