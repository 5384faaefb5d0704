"""Queries on titles, videos and instructors: search, validation, department and channel reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrain.functions import text as T
from reelgrain.operators import titles as titles_op
from reelgrain.operators.facts import ranked
from reelgrain.plans import inputs as I
from reelgrain.plans.inputs import facts, joined, owned, videos
from reelgrain.plans.registry import Registry
from reelgrain.storage import materialize, table

QUERIES = Registry()
add = QUERIES.add
_P = I.FACTS
WEEKS = 16


@add("dept_overview", f"WITH {_P} SELECT count(*) AS n, count(DISTINCT p.professor) AS professors, count(DISTINCT course) AS courses, round(sum(duration_seconds)/3600.0,4) AS hours, sum(view_count)::BIGINT AS views, round(avg(CASE WHEN p.professor IS NULL THEN 0 ELSE 1 END),6) AS parsed FROM p JOIN v USING (video_id)")
def dept_overview(spark, d):
    return joined(spark, d).agg(F.count("*").alias("n"), F.countDistinct("professor").alias("professors"), F.countDistinct("course").alias("courses"), F.round(F.sum("duration_seconds") / 3600.0, 4).alias("hours"), F.sum("view_count").alias("views"), F.round(F.avg(F.when(F.col("professor").isNull(), 0).otherwise(1)), 6).alias("parsed"))


@add("compare_videos_tags", "WITH v AS (SELECT DISTINCT video_id, tags, view_count FROM videos) SELECT tag, count(*) AS n, round(avg(view_count),4) AS avg_views, sum(view_count)::BIGINT AS views FROM (SELECT unnest(tags) AS tag, view_count FROM v) GROUP BY 1")
def compare_videos_tags(spark, d):
    rows = videos(spark, d).select(F.explode("tags").alias("tag"), "view_count")
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg("view_count"), 4).alias("avg_views"), F.sum("view_count").alias("views"))


@add("channel_insights", "WITH v AS (SELECT DISTINCT video_id, channel_id, view_count, duration_seconds FROM videos) SELECT channel_id, round(avg(view_count),4) AS avg_views, round(avg(CASE WHEN duration_seconds > 0 THEN duration_seconds END),4) AS avg_duration FROM v GROUP BY 1")
def channel_insights(spark, d):
    return videos(spark, d).groupBy("channel_id").agg(F.round(F.avg("view_count"), 4).alias("avg_views"), F.round(F.avg(F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))), 4).alias("avg_duration"))


@add("bundle_summary", "WITH v AS (SELECT DISTINCT video_id, channel_id, duration_seconds, view_count, like_count FROM videos) SELECT channel_id, count(*) AS n, (sum(duration_seconds)//60)::BIGINT AS minutes, (sum(view_count)//count(*))::BIGINT AS avg_views, sum(like_count)::BIGINT AS likes FROM v GROUP BY 1")
def bundle_summary(spark, d):
    return videos(spark, d).groupBy("channel_id").agg(F.count("*").alias("n"), F.expr("sum(duration_seconds) div 60").alias("minutes"), F.expr("sum(view_count) div count(*)").alias("avg_views"), F.sum("like_count").alias("likes"))


@add("title_contains", "SELECT DISTINCT video_id FROM videos WHERE contains(title, '강종인')")
def title_contains(spark, d):
    return videos(spark, d).where(F.contains("title", F.lit("강종인"))).select("video_id")


@add("video_filter", "SELECT DISTINCT video_id FROM videos WHERE contains(title, '주차') AND (published_at AT TIME ZONE 'UTC')::DATE BETWEEN DATE '2021-03-01' AND DATE '2023-02-28'")
def video_filter(spark, d):
    return videos(spark, d).where(F.contains("title", F.lit("주차")) & F.to_date("published_at").between("2021-03-01", "2023-02-28")).select("video_id")


@add("safe_dates", "SELECT video_id, CASE WHEN try_cast(x AS DATE) IS NULL THEN NULL ELSE strftime(try_cast(x AS DATE),'%Y-%m-%d') END AS day FROM (SELECT DISTINCT video_id, CASE WHEN duration_seconds % 5 = 0 THEN 'n/a' ELSE substring(strftime(published_at AT TIME ZONE 'UTC','%Y-%m-%dT%H:%M:%S'),1,10) END AS x FROM videos)")
def safe_dates(spark, d):
    raw = F.when(F.col("duration_seconds") % 5 == 0, "n/a").otherwise(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"))
    return videos(spark, d).select("video_id", F.date_format(F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd"), "yyyy-MM-dd").alias("day"))


@add("search_filter", f"""WITH {_P} SELECT DISTINCT p.video_id FROM p JOIN v USING (video_id) WHERE ((contains(course,'SQL') AND week BETWEEN 1 AND 8) OR (contains(professor,'김') AND year = 2022)) AND NOT contains(coalesce(title,''),'특강') AND NOT contains(coalesce(title,''),'OT')""")
def search_filter(spark, d):
    rows = facts(spark, d).join(videos(spark, d).select("video_id", "title"), "video_id")
    either = (F.contains("course", F.lit("SQL")) & F.col("week").between(1, 8)) | (F.contains("professor", F.lit("김")) & (F.col("year") == 2022))
    banned = [F.contains(F.coalesce("title", F.lit("")), F.lit(k)) for k in ("특강", "OT")]
    return rows.where(either & ~banned[0] & ~banned[1]).select("video_id").distinct()


@add("search_queries", f"WITH {_P} SELECT DISTINCT video_id, CASE WHEN course = '회계원리' THEN 1 ELSE 2 END AS first_query FROM p WHERE course = '회계원리' OR week = 3")
def search_queries(spark, d):
    q = [F.col("course") == "회계원리", F.col("week") == 3]
    return facts(spark, d).where(q[0] | q[1]).select("video_id", F.when(q[0], 1).otherwise(2).alias("first_query")).distinct()


@add("course_sort", """WITH x AS (SELECT DISTINCT video_id, coalesce(title,'') AS title, coalesce(try_cast(nullif(regexp_extract(coalesce(title,''),'([0-9]+)\\s*주차\\s*([0-9]+)\\s*차시',1),'') AS INT),9999) AS w, coalesce(try_cast(nullif(regexp_extract(coalesce(title,''),'([0-9]+)\\s*주차\\s*([0-9]+)\\s*차시',2),'') AS INT),9999) AS s FROM videos)
SELECT video_id, w AS week, s AS session, row_number() OVER (PARTITION BY substring(title,1,2) ORDER BY w, s, video_id) AS place FROM x""")
def course_sort(spark, d):
    part = lambda i: F.coalesce(F.regexp_extract(F.coalesce("title", F.lit("")), r"([0-9]+)[ \t\n\r\f]*주차[ \t\n\r\f]*([0-9]+)[ \t\n\r\f]*차시", i).try_cast("int"), F.lit(9999))
    rows = videos(spark, d).select("video_id", F.substring(F.coalesce("title", F.lit("")), 1, 2).alias("k"), part(1).alias("week"), part(2).alias("session"))
    # weeks and sessions in one number, the greatest of which comes first
    rows = rows.withColumn("order", -(F.col("week").cast("long") * 1_000_000_000 + F.col("session")))
    return ranked(rows, "k", ["order", "video_id"]).select("video_id", "week", "session", "place")


@add("list_sorted", "WITH v AS (SELECT DISTINCT video_id, channel_id, like_count FROM videos) SELECT video_id, place FROM (SELECT video_id, row_number() OVER (PARTITION BY channel_id ORDER BY like_count DESC NULLS LAST, video_id) AS place FROM v) WHERE place <= 20")
def list_sorted(spark, d):
    w = Window.partitionBy("channel_id").orderBy(F.desc_nulls_last("like_count"), "video_id")
    return videos(spark, d).select("video_id", F.row_number().over(w).cast("long").alias("place")).where("place <= 20")


@add("dept_scope", f"WITH {_P} SELECT v.video_id FROM v SEMI JOIN (SELECT video_id FROM p WHERE year = 2022 AND week <= 8) q USING (video_id)")
def dept_scope(spark, d):
    return videos(spark, d).join(facts(spark, d).where("year = 2022 and week <= 8"), "video_id", "left_semi").select("video_id")


@add("professor_split", "SELECT detail_id, list_aggregate(list_transform(string_split(trim(professor_name, '() '),'/'), lambda x: trim(x)), 'string_agg', '|') AS names, len(string_split(trim(professor_name,'() '),'/'))::BIGINT AS n FROM professor_detail")
def professor_split(spark, d):
    names = T.professor_names(F.col("professor_name"))
    return table(spark, d, "professor_detail").select("detail_id", F.concat_ws("|", names).alias("names"), F.size(names).cast("long").alias("n"))


@add("category", "SELECT DISTINCT video_id, CASE WHEN contains(title,'OT') OR contains(title,'특강') OR contains(title,'핵심영상') OR contains(title,'보완영상') OR contains(title,'질문응답') OR contains(title,'보충') THEN 'supplementary' ELSE 'regular' END AS category FROM videos")
def category(spark, d):
    return videos(spark, d).select("video_id", T.category(F.coalesce("title", F.lit(""))).alias("category"))


@add("upload_year", "SELECT DISTINCT video_id, try_cast(substring(strftime(published_at AT TIME ZONE 'UTC','%Y-%m-%d'),1,4) AS INT) AS year FROM videos")
def upload_year(spark, d):
    return videos(spark, d).select("video_id", F.substring(F.date_format("published_at", "yyyy-MM-dd"), 1, 4).try_cast("int").alias("year"))




@add("levenshtein", "WITH n AS (SELECT p_partkey, p_name, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nx FROM part) SELECT p_partkey, levenshtein(p_name, nx)::INT AS distance FROM n WHERE nx IS NOT NULL")
def levenshtein(spark, d):
    after = F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_name", after.alias("nx")).where("nx is not null").select("p_partkey", F.levenshtein("p_name", "nx").alias("distance"))


# All nine rules, at the limits of the survey. RULES has those that the SQL twins of findings_union and findings_ranked hold.


# professors and weeks ------------------------------------------------------------------------------------------------


@add("prof_detail", f"""WITH {_P}, g AS (SELECT f.*, duration_seconds, view_count FROM f JOIN v USING (video_id)), w AS (SELECT name, week, count(DISTINCT session) AS k FROM g WHERE week IS NOT NULL AND session IS NOT NULL GROUP BY 1,2), c AS (SELECT name, avg(k*1.0e0/m) AS c FROM w JOIN (SELECT name, max(k) AS m FROM w GROUP BY 1) USING (name) GROUP BY 1)
SELECT name AS professor, count(*) AS n, array_to_string(list_sort(list(DISTINCT course)),'|') AS courses, round(count(DISTINCT week)/16.0e0,6) AS coverage, round(coalesce(any_value(c),0),6) AS completeness, round(avg(duration_seconds)/60.0e0,4) AS minutes,
sum(view_count)::BIGINT AS views, round(avg(view_count),4) AS avg_views FROM g LEFT JOIN c USING (name) GROUP BY 1""")
def prof_detail(spark, d):
    g = owned(spark, d).join(videos(spark, d).select("video_id", "duration_seconds", "view_count"), "video_id")
    weeks = g.where("week is not null and session is not null").groupBy("name", "week").agg(F.countDistinct("session").alias("k"))
    # the mean of k over the greatest k is the mean of k over that greatest
    whole = weeks.groupBy("name").agg((F.avg("k") / F.max("k")).alias("c"))
    by = g.groupBy("name").agg(F.count("*").alias("n"), F.concat_ws("|", F.sort_array(F.collect_set("course"))).alias("courses"), F.round(F.countDistinct("week") / float(WEEKS), 6).alias("coverage"), F.round(F.avg("duration_seconds") / 60.0, 4).alias("minutes"), F.sum("view_count").alias("views"), F.round(F.avg("view_count"), 4).alias("avg_views"))
    return by.join(whole, "name", "left").select(F.col("name").alias("professor"), "n", "courses", "coverage", F.round(F.coalesce("c", F.lit(0.0)), 6).alias("completeness"), "minutes", "views", "avg_views")


@add("session_completeness", f"WITH {_P}, w AS (SELECT name, week, count(DISTINCT session) AS s FROM f WHERE week IS NOT NULL AND session IS NOT NULL GROUP BY 1,2), m AS (SELECT name, max(s) AS m FROM w GROUP BY 1) SELECT name AS professor, round(avg(s*1.0e0/m),6) AS completeness FROM w JOIN m USING (name) GROUP BY 1")
def session_completeness(spark, d):
    weeks = owned(spark, d).where("week is not null and session is not null").groupBy("name", "week").agg(F.countDistinct("session").alias("s"))
    return weeks.groupBy(F.col("name").alias("professor")).agg(F.round(F.avg("s") / F.max("s"), 6).alias("completeness"))


# The calendar of one year: week w begins 7 * (w - 1) days after the first of March.
_YEAR, _TERM = 2022, "2022-03-01"
_COMPLIANCE = f"""{_P}, u AS (SELECT name, week, bool_or(ts > DATE '{_TERM}' + ((week-1)*7)::INT) AS late FROM f JOIN v USING (video_id) WHERE year = {_YEAR} AND week IS NOT NULL GROUP BY 1,2),
g AS (SELECT name, w AS week FROM (SELECT DISTINCT name FROM f SEMI JOIN v USING (video_id) WHERE year = {_YEAR}), range(1,17) r(w)),
st AS (SELECT g.name AS professor, g.week::INT AS week, CASE WHEN u.name IS NULL THEN 'missing' WHEN u.late THEN 'late' ELSE 'uploaded' END AS status FROM g LEFT JOIN u ON u.name=g.name AND u.week=g.week)"""


def _statuses(spark, d) -> DataFrame:
    """professor, week, status of every week of the calendar: late if any of the week's videos came after its begin."""
    rows = owned(spark, d).where(F.col("year") == _YEAR).join(videos(spark, d).select("video_id", "published_at"), "video_id")
    begin = F.date_add(F.lit(_TERM).cast("date"), (F.col("week") - 1) * 7).cast("timestamp")
    by = rows.where("week is not null").groupBy("name", "week").agg(F.bool_or(F.col("published_at") > begin).alias("late"), F.lit(True).alias("any"))
    grid = rows.select("name").distinct().withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(WEEKS))))
    status = F.when(F.col("any").isNull(), "missing").when(F.col("late"), "late").otherwise("uploaded")
    return grid.join(by, ["name", "week"], "left").select(F.col("name").alias("professor"), "week", status.alias("status"))


@add("compliance", f"WITH {_COMPLIANCE} SELECT professor, week, status, round(rate,6) AS rate FROM st JOIN (SELECT professor, CASE WHEN count(*) FILTER (WHERE status<>'missing')=0 THEN 0.0 ELSE count(*) FILTER (WHERE status='uploaded')*1.0e0/count(*) FILTER (WHERE status<>'missing') END AS rate FROM st GROUP BY 1) USING (professor)")
def compliance(spark, d):
    there, good = F.count_if(F.col("status") != "missing"), F.count_if(F.col("status") == "uploaded")
    rows = _statuses(spark, d)
    rate = F.round(F.coalesce(F.try_divide(good.cast("double"), there.cast("double")), F.lit(0.0)), 6)
    weeks = F.collect_list(F.struct("week", "status"))  # sixteen a professor
    return rows.groupBy("professor").agg(rate.alias("rate"), weeks.alias("w")).select("professor", "rate", F.explode("w").alias("x")).select("professor", "x.week", "x.status", "rate")


@add("heat_encode", f"WITH {_COMPLIANCE} SELECT professor, week, CASE status WHEN 'uploaded' THEN 1.0e0 WHEN 'late' THEN 0.5e0 ELSE 0.0e0 END AS heat FROM st")
def heat_encode(spark, d):
    code = F.create_map(*[F.lit(x) for x in ("uploaded", 1.0, "late", 0.5, "missing", 0.0)])
    return _statuses(spark, d).select("professor", "week", code[F.col("status")].alias("heat"))


# rankings and suggestions ----------------------------------------------------------------------------------------------


@add("rankings", "WITH v AS (SELECT DISTINCT video_id, channel_id, view_count, like_count, comment_count FROM videos) SELECT video_id, row_number() OVER (PARTITION BY channel_id ORDER BY view_count DESC NULLS LAST, video_id) AS by_views, row_number() OVER (PARTITION BY channel_id ORDER BY round((like_count+comment_count)*1.0e0/nullif(view_count,0),4) DESC NULLS LAST, video_id) AS by_engagement FROM v")
def rankings(spark, d):
    rate = F.round(F.try_divide((F.col("like_count") + F.col("comment_count")).cast("double"), F.col("view_count").cast("double")), 4)
    rows = videos(spark, d).select("video_id", "channel_id", "view_count", rate.alias("rate"))
    views = ranked(rows, "channel_id", ["view_count", "video_id"]).withColumnRenamed("place", "by_views")
    return ranked(views, "channel_id", ["rate", "video_id"]).select("video_id", "by_views", F.col("place").alias("by_engagement"))


_TOP = """o AS (SELECT channel_id, min(duration_seconds) AS lo, max(duration_seconds) AS hi, count(*) AS top FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY view_count DESC NULLS LAST, video_id) AS rn, count(*) OVER (PARTITION BY channel_id) AS n FROM (SELECT DISTINCT video_id, channel_id, view_count, duration_seconds FROM videos)) WHERE rn <= greatest(1, n//2) GROUP BY 1)"""


@add("compare_videos_optimal", f"WITH {_TOP} SELECT * FROM o")
def compare_videos_optimal(spark, d):
    rows = videos(spark, d).select("channel_id", "video_id", "view_count", "duration_seconds")
    n = rows.groupBy(F.col("channel_id").alias("c")).agg(F.count("*").alias("n"))
    rows = ranked(rows, "channel_id", ["view_count", "video_id"])
    rows = rows.join(n, rows["channel_id"].eqNullSafe(n["c"])).where("place <= greatest(1, n div 2)")
    return rows.groupBy("channel_id").agg(F.min("duration_seconds").alias("lo"), F.max("duration_seconds").alias("hi"), F.count("*").alias("top"))


_WEAK = " , ".join(f"CASE WHEN {a} < 0.6 THEN '{a}' END" for a in I.AXES)


@add("suggestions", f"""WITH {_P}, {I.EQS}, {_TOP}, x AS (SELECT DISTINCT video_id, channel_id, duration_seconds, view_count, like_count, comment_count FROM videos),
t AS (SELECT channel_id, sum(coalesce(duration_seconds,0)) AS s, sum(like_count+comment_count) AS e, sum(view_count) AS w FROM x GROUP BY 1), q AS (SELECT p.video_id, min_by(ax, detail_id) AS a FROM p JOIN ax ON ax.professor_name = p.professor GROUP BY 1)
SELECT video_id AS key, 'length' AS category, 'high' AS priority, '' AS evidence FROM x WHERE duration_seconds > 3600 UNION ALL SELECT video_id, 'length', 'medium', '' FROM x WHERE duration_seconds > 2400 AND duration_seconds <= 3600
UNION ALL SELECT video_id, 'engagement', CASE WHEN (like_count+comment_count)*1.0e0/view_count < 0.005 THEN 'high' ELSE 'medium' END, '' FROM x WHERE view_count > 100 AND (like_count+comment_count)*1.0e0/view_count < 0.01
UNION ALL SELECT t.channel_id, 'length', 'medium', lo || '-' || hi FROM t JOIN o ON o.channel_id=t.channel_id WHERE s > 0 AND lo > 0 AND hi > 0
UNION ALL SELECT x.video_id, 'content', 'medium', concat_ws(',', {_WEAK.replace("CASE WHEN ", "CASE WHEN a.").replace("a.'", "'")}) FROM x JOIN q USING (video_id) WHERE least(a.relevance, a.accuracy, a.clarity, a.engagement, a.depth) < 0.6
UNION ALL SELECT channel_id, 'engagement', 'medium', '' FROM t WHERE w > 0 AND e*1.0e0/w < 0.02""")
def suggestions(spark, d):
    """key (video, or channel), category, priority, evidence: rules on length, engagement, best lengths, weak axes and channels."""
    c, out = F.col, lambda rows, key, category, priority, evidence="": rows.select(F.col(key).alias("key"), F.lit(category).alias("category"), (priority if not isinstance(priority, str) else F.lit(priority)).alias("priority"), (evidence if not isinstance(evidence, str) else F.lit(evidence)).alias("evidence"))
    x = videos(spark, d).select("video_id", "channel_id", "duration_seconds", "view_count", "like_count", "comment_count")
    rate = F.try_divide((c("like_count") + c("comment_count")).cast("double"), c("view_count").cast("double"))
    t = x.groupBy("channel_id").agg(F.sum(F.coalesce("duration_seconds", F.lit(0))).alias("s"), F.sum(c("like_count") + c("comment_count")).alias("e"), F.sum("view_count").alias("w"))
    best = t.join(compare_videos_optimal(spark, d), "channel_id").where("s > 0 and lo > 0 and hi > 0")
    first = I.axes(spark, d).groupBy("professor_name").agg(F.min_by(F.struct(*I.AXES), "detail_id").alias("a"))
    scored = x.join(facts(spark, d).select("video_id", F.col("professor").alias("professor_name")), "video_id").join(F.broadcast(first), "professor_name")  # a register of fixed size
    weak = F.concat_ws(",", *[F.when(c(f"a.{a}") < 0.6, a) for a in I.AXES])
    parts = [
        out(x.where("duration_seconds > 2400"), "video_id", "length", F.when(c("duration_seconds") > 3600, "high").otherwise("medium")),
        out(x.where((c("view_count") > 100) & (rate < 0.01)), "video_id", "engagement", F.when(rate < 0.005, "high").otherwise("medium")),
        out(best, "channel_id", "length", "medium", F.concat_ws("-", c("lo").cast("string"), c("hi").cast("string"))),
        out(scored.where(weak != ""), "video_id", "content", "medium", weak),
        out(t.where("w > 0").where(c("e") / c("w") < 0.02), "channel_id", "engagement", "medium"),
    ]
    return reduce(DataFrame.unionByName, parts)


@add("bundle_channels", f"WITH {_P} SELECT v.channel_id, f.name AS professor, count(*) AS n, array_to_string(list_sort(list(DISTINCT f.course)),'|') AS courses FROM v JOIN f USING (video_id) GROUP BY 1,2")
def bundle_channels(spark, d):
    rows = owned(spark, d).join(videos(spark, d).select("video_id", "channel_id"), "video_id")
    return rows.groupBy("channel_id", F.col("name").alias("professor")).agg(F.count("*").alias("n"), F.concat_ws("|", F.sort_array(F.collect_set("course"))).alias("courses"))


@add("filter_desc", "SELECT channel_id, 'Bundle: ' || coalesce(channel_title, channel_id) AS title, concat_ws(' | ', 'channel=' || channel_id, CASE WHEN channel_title IS NOT NULL THEN 'keyword=' || channel_title END, CASE WHEN privacy_status IS NOT NULL THEN 'status=' || privacy_status END) AS description FROM channel_metadata")
def filter_desc(spark, d):
    said = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}="), c))
    return table(spark, d, "channel_metadata").select("channel_id", F.concat(F.lit("Bundle: "), F.coalesce("channel_title", "channel_id")).alias("title"), F.concat_ws(" | ", said("channel", "channel_id"), said("keyword", "channel_title"), said("status", "privacy_status")).alias("description"))


# titles --------------------------------------------------------------------------------------------------------------


@add("parse_stats", f"SELECT count(*) AS total, count(*) FILTER (WHERE NOT parse_error) AS parsed, count(*) FILTER (WHERE parse_error) AS failed, round(avg(CASE WHEN parse_error THEN 0.0 ELSE 1.0 END),6) AS rate FROM ({I.parser_sql('sample_titles')})")
def parse_stats(spark, d):
    rows = titles_op.parse(table(spark, d, "sample_titles"))
    return rows.agg(F.count("*").alias("total"), F.count_if(~F.col("parse_error")).alias("parsed"), F.count_if("parse_error").alias("failed"), F.round(F.avg(F.when(F.col("parse_error"), 0.0).otherwise(1.0)), 6).alias("rate"))


@add("title_parse", I.parser_sql("sample_titles"))
def title_parse(spark, d):
    return titles_op.parse(table(spark, d, "sample_titles"))


@add("match_key", f"SELECT video_id, {I.key_sql('title')} AS match_key FROM sample_titles")
def match_key(spark, d):
    return table(spark, d, "sample_titles").select("video_id", titles_op.match_key(F.col("title")).alias("match_key"))


@add("title_match", f"WITH {_P}, {I.FILES}, k AS (SELECT file_id, regexp_replace(file,'\\.[^.]+$','') AS stem, title FROM fl JOIN v ON v.video_id = fl.file_id) SELECT file_id, stem = title AS exact, a = b OR (length(a) >= 50 AND starts_with(b,a)) AS normalised FROM (SELECT *, {I.key_sql('stem')} AS a, {I.key_sql('title')} AS b FROM k)")
def title_match(spark, d):
    rows = I.files(spark, d).join(videos(spark, d).select(F.col("video_id").alias("file_id"), "title"), "file_id")
    rows = rows.withColumn("stem", titles_op.stem(F.col("file"))).withColumns({"a": titles_op.match_key(F.col("stem")), "b": titles_op.match_key(F.col("title"))})
    return rows.select("file_id", (F.col("stem") == F.col("title")).alias("exact"), titles_op.keys_match(F.col("a"), F.col("b")).alias("normalised"))


# validation rules: rule_id, severity, ids (joined by |), professor, details (in the order of the rule) -------------------


def _ids(c: str = "video_id") -> Column:
    return F.concat_ws("|", F.sort_array(F.collect_list(c)))


def _finding(rows: DataFrame, rule: str, severity: str, ids, professor=None, *details) -> DataFrame:
    parts = [F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in details]
    who = F.lit(None).cast("string") if professor is None else F.col(professor)
    return rows.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), (F.col(ids) if isinstance(ids, str) else ids).alias("ids"), who.alias("professor"), F.concat_ws("|", *parts).alias("details"))


def v001(spark, d) -> DataFrame:
    """The year of the title and that of the upload differ by more than one."""
    rows = joined(spark, d).withColumn("upload", F.year("published_at")).withColumn("gap", F.abs(F.col("year") - F.col("upload")))
    return _finding(rows.where("gap > 1"), "V-001", "WARNING", "video_id", None, "year", "upload", "gap")


def v002(spark, d) -> DataFrame:
    """Several videos of one professor, course, week and session."""
    key = ["name", "course", "week", "session"]
    by = owned(spark, d).where("week is not null and session is not null").groupBy(*key).agg(F.count("*").alias("n"), _ids().alias("ids")).where("n >= 2")
    return _finding(by, "V-002", "ERROR", "ids", "name", "course", "week", "session", "n")


def v003(spark, d, most: int = WEEKS) -> DataFrame:
    """A week below 1 or beyond the term."""
    return _finding(facts(spark, d).where((F.col("week") <= 0) | (F.col("week") > most)), "V-003", "ERROR", "video_id", None, "week")


def v004(spark, d) -> DataFrame:
    """Names of professors within two edits of each other, with the videos of both."""
    names = facts(spark, d).select("video_id", F.explode(T.professor_names(F.col("professor"))).alias("name"))
    by = materialize(names.groupBy("name").agg(F.collect_set("video_id").alias("v")))
    of = lambda x: by.select(F.col("name").alias(f"name_{x}"), F.col("v").alias(f"v_{x}"))
    pairs = titles_op.near_names(by.select("name")).join(of("a"), "name_a").join(of("b"), "name_b")
    return _finding(pairs, "V-004", "WARNING", F.concat_ws("|", F.sort_array(F.array_union("v_a", "v_b"))), None, "name_a", "name_b", "distance")


def v005(spark, d) -> DataFrame:
    """Titles that the parser can't read."""
    titles = table(spark, d, "sample_titles").select("video_id", "title").distinct()
    bad = titles_op.parse(titles, "title").where("parse_error")
    return _finding(bad, "V-005", "WARNING", "video_id", None, F.substring(F.coalesce("title", F.lit("")), 1, 80))


def v006(spark, d) -> DataFrame:
    """A session without the one before it, among the regular videos of a professor, course and week."""
    key = ["name", "course", "week"]
    rows = owned(spark, d).where("category <> 'supplementary' and week is not null and session is not null").groupBy(*key, "session").agg(F.max("video_id").alias("video_id"))
    gaps = rows.withColumn("before", F.lag("session").over(Window.partitionBy(*key).orderBy("session"))).where("session >= 2 and coalesce(before, -1) <> session - 1")
    return _finding(gaps, "V-006", "WARNING", "video_id", "name", "course", "week", "session", F.col("session") - 1)


def v007(spark, d, most: float = 3.0) -> DataFrame:
    """Durations more than three (sample) standard deviations from the mean of their course, of at least three videos."""
    rows = joined(spark, d).where("duration_seconds > 0 and course <> ''").select("video_id", "course", "duration_seconds")
    by = rows.groupBy("course").agg(F.avg("duration_seconds").alias("m"), F.stddev_samp("duration_seconds").alias("s"), F.count("*").alias("n")).where("n >= 3 and s > 0")
    far = rows.join(by, "course").where(F.abs(F.col("duration_seconds") - F.col("m")) / F.col("s") > most)
    return _finding(far, "V-007", "INFO", "video_id", None, "course", "duration_seconds")


def v008(spark, d) -> DataFrame:
    """Weeks that lack between the first and the last one of the regular videos of a professor and course."""
    rows = owned(spark, d).where("week is not null")
    regular = F.when(F.col("category") != "supplementary", F.col("week"))
    by = rows.groupBy("name", "course").agg(F.collect_set(regular).alias("weeks"), F.min(regular).alias("lo"), F.max(regular).alias("hi"), F.min("video_id").alias("first")).where("hi > lo")
    lacking = F.array_except(F.expr("sequence(lo, hi)"), F.col("weeks"))
    by = by.withColumn("lacking", F.concat_ws(",", F.transform(lacking, lambda x: x.cast("string")))).where("lacking <> ''")
    return _finding(by, "V-008", "WARNING", "first", "name", "course", "lacking")


def v009(spark, d) -> DataFrame:
    """Two or more weeks in a row without a regular video of a professor and course."""
    rows = owned(spark, d).where("category <> 'supplementary' and week is not null")
    weeks = rows.groupBy("name", "course", "week").agg(F.min("video_id").alias("video_id"))
    w = Window.partitionBy("name", "course")
    weeks = weeks.withColumns({"after": F.lead("week").over(w.orderBy("week")), "first": F.min("video_id").over(w)})
    return _finding(weeks.where("after - week > 2"), "V-009", "INFO", "first", "name", "course", "week", "after", F.col("after") - F.col("week") - 1)


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
# the SQL engine counts edits in bytes: the characters of both names, at most as many as there are letters, become ASCII
_EDITS = f"levenshtein(translate(a.name, u, '{_LETTERS}'), translate(b.name, u, '{_LETTERS}'))"
_V = {
    "v001": "SELECT 'V-001' AS rule_id, 'WARNING' AS severity, video_id AS ids, NULL::VARCHAR AS professor, concat_ws('|', p.year, date_part('year', ts), abs(p.year - date_part('year', ts))) AS details FROM p JOIN v USING (video_id) WHERE abs(p.year - date_part('year', ts)) > 1",
    "v002": "SELECT 'V-002' AS rule_id, 'ERROR' AS severity, array_to_string(list_sort(list(video_id)),'|') AS ids, name AS professor, concat_ws('|', course, week, session, count(*)) AS details FROM f WHERE week IS NOT NULL AND session IS NOT NULL GROUP BY name, course, week, session HAVING count(*) >= 2",
    "v003": "SELECT 'V-003' AS rule_id, 'ERROR' AS severity, video_id AS ids, NULL::VARCHAR AS professor, week::VARCHAR AS details FROM p WHERE week <= 0 OR week > 16",
    "v004": f"SELECT 'V-004' AS rule_id, 'WARNING' AS severity, array_to_string(list_sort(list_distinct(va || vb)),'|') AS ids, NULL::VARCHAR AS professor, concat_ws('|', an, bn, k) AS details FROM (SELECT a.name AS an, b.name AS bn, a.v AS va, b.v AS vb, {_EDITS} AS k FROM (SELECT x.*, array_to_string(list_distinct(string_split(x.name || y.name,'')),'') AS u, y.name AS other FROM (SELECT name, list(DISTINCT video_id) AS v FROM (SELECT video_id, unnest({I.names_sql('professor')}) AS name FROM p) GROUP BY 1) x JOIN (SELECT DISTINCT unnest({I.names_sql('professor')}) AS name FROM p) y ON x.name < y.name AND abs(length(x.name)-length(y.name)) <= 2) a JOIN (SELECT name, list(DISTINCT video_id) AS v FROM (SELECT video_id, unnest({I.names_sql('professor')}) AS name FROM p) GROUP BY 1) b ON b.name = a.other) WHERE k BETWEEN 1 AND 2",
    "v005": f"SELECT 'V-005' AS rule_id, 'WARNING' AS severity, video_id AS ids, NULL::VARCHAR AS professor, substring(title,1,80) AS details FROM (SELECT t.video_id, coalesce(t.title,'') AS title, parse_error FROM (SELECT DISTINCT video_id, title FROM sample_titles) t JOIN (SELECT DISTINCT title, parse_error FROM (SELECT video_id AS title, parse_error FROM ({I.parser_sql('(SELECT DISTINCT title AS video_id, title FROM sample_titles)')}))) r ON r.title IS NOT DISTINCT FROM t.title) WHERE parse_error",
    "v006": "SELECT 'V-006' AS rule_id, 'WARNING' AS severity, video_id AS ids, name AS professor, concat_ws('|', course, week, session, session-1) AS details FROM (SELECT *, lag(session) OVER (PARTITION BY name, course, week ORDER BY session) AS b FROM (SELECT name, course, week, session, max(video_id) AS video_id FROM f WHERE category <> 'supplementary' AND week IS NOT NULL AND session IS NOT NULL GROUP BY 1,2,3,4)) WHERE session >= 2 AND coalesce(b,-1) <> session-1",
    "v007": "SELECT 'V-007' AS rule_id, 'INFO' AS severity, video_id AS ids, NULL::VARCHAR AS professor, concat_ws('|', course, duration_seconds) AS details FROM (SELECT *, avg(duration_seconds) OVER (PARTITION BY course) AS m, stddev_samp(duration_seconds) OVER (PARTITION BY course) AS s, count(*) OVER (PARTITION BY course) AS n FROM p JOIN v USING (video_id) WHERE duration_seconds > 0 AND course <> '') WHERE n >= 3 AND s > 0 AND abs(duration_seconds-m)/s > 3",
    "v008": "SELECT 'V-008' AS rule_id, 'WARNING' AS severity, first AS ids, name AS professor, concat_ws('|', course, array_to_string(miss,',')) AS details FROM (SELECT name, course, min(video_id) AS first, list_filter(range(min(week) FILTER (WHERE category <> 'supplementary'), max(week) FILTER (WHERE category <> 'supplementary')+1), lambda x: NOT list_contains(list(week) FILTER (WHERE category <> 'supplementary'), x::INT)) AS miss FROM f WHERE week IS NOT NULL GROUP BY 1,2) WHERE len(miss) > 0",
    "v009": "SELECT 'V-009' AS rule_id, 'INFO' AS severity, first AS ids, name AS professor, concat_ws('|', course, week, nx, nx-week-1) AS details FROM (SELECT *, lead(week) OVER (PARTITION BY name, course ORDER BY week) AS nx, min(video_id) OVER (PARTITION BY name, course) AS first FROM (SELECT name, course, week, min(video_id) AS video_id FROM f WHERE category <> 'supplementary' AND week IS NOT NULL GROUP BY 1,2,3)) WHERE nx - week > 2",
}
RULES = {f"v00{i}": rule for i, rule in enumerate((v001, v002, v003, v004, v005, v006, v007, v008, v009), 1)}
for _name, _rule in RULES.items():
    add(_name, f"WITH {_P} {_V[_name]}")(_rule)


_RANK = "CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END"
_ALL = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in _V.values())


def _findings(spark, d) -> DataFrame:
    return reduce(DataFrame.unionByName, [rule(spark, d) for rule in RULES.values()])


@add("findings_union", f"WITH {_P} SELECT rule_id, count(*) AS n FROM ({_ALL}) GROUP BY 1")
def findings_union(spark, d):
    return _findings(spark, d).groupBy("rule_id").agg(F.count("*").alias("n"))


@add("findings_ranked", f"WITH {_P} SELECT *, {_RANK} AS place FROM ({_ALL})")
def findings_ranked(spark, d):
    return _findings(spark, d).withColumn("place", F.when(F.col("severity") == "ERROR", 0).when(F.col("severity") == "WARNING", 1).otherwise(2))


@add("rule_counts", f"WITH {_P} SELECT severity, count(*) AS n, count(DISTINCT rule_id) AS rules FROM ({_ALL}) WHERE rule_id IN ('V-001','V-002','V-006','V-009') GROUP BY 1")
def rule_counts(spark, d):
    some = reduce(DataFrame.unionByName, [RULES[x](spark, d) for x in ("v001", "v002", "v006", "v009")])
    return some.groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("rule_id").alias("rules"))


@add("details_json", f"WITH {_P} SELECT video_id, p.year AS title_year, date_part('year', ts)::INT AS upload_year, abs(p.year - date_part('year', ts))::INT AS difference FROM p JOIN v USING (video_id) WHERE abs(p.year - date_part('year', ts)) > 1")
def details_json(spark, d):
    rows = joined(spark, d).withColumn("upload", F.year("published_at")).where(F.abs(F.col("year") - F.col("upload")) > 1)
    as_json = F.to_json(F.struct(F.col("year").alias("title_year"), F.col("upload").alias("upload_year"), F.abs(F.col("year") - F.col("upload")).alias("difference")))
    return rows.select("video_id", F.from_json(as_json, "title_year int, upload_year int, difference int").alias("x")).select("video_id", "x.*")
