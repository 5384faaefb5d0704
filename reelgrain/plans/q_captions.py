"""Queries on caption segments: quality, repeats, spans, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgrain.functions import scoring as S
from reelgrain.functions import text as T
from reelgrain.operators import governance as G
from reelgrain.operators import spans as O
from reelgrain.operators.facts import unique_videos
from reelgrain.plans import inputs as I
from reelgrain.plans.registry import Registry
from reelgrain.sources.readers import parse_srt
from reelgrain.storage import table

QUERIES = Registry()
add = QUERIES.add
_C = 'c AS (SELECT DISTINCT segment_id, video_id, channel_id, segment_index, start, "end" AS fin, text, caption_source FROM case_c_video2)'
# Phrases that recognisers put into silence.
SILENCE = ("구독과\\s*좋아요", "시청해\\s*주셔서\\s*감사합니다", "구독\\s*부탁드립니다", "좋아요와\\s*구독", "알림\\s*설정", "구독\\s*좋아요\\s*알림", "like\\s*and\\s*subscribe")


def segments(spark, d) -> DataFrame:
    """Distinct caption rows; all queries here group by video, so they are placed by it once."""
    rows = table(spark, d, "case_c_video2").select("segment_id", "video_id", "channel_id", "segment_index", "start", F.col("end").alias("fin"), "text", "caption_source")
    return rows.repartition("video_id").dropDuplicates()


def _len():
    return F.greatest(F.lit(0.0), F.coalesce(F.col("fin") - F.col("start"), F.lit(0.0)))


_L = "greatest(0.0e0, coalesce(fin-start,0.0e0))"


@add("repeat_islands", f"""WITH {_C}, x AS (SELECT video_id, start, segment_id, text, CASE WHEN lag(text) OVER w = text THEN 0 ELSE 1 END AS new FROM c WHERE text <> '' WINDOW w AS (PARTITION BY video_id ORDER BY start, segment_id)),
y AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY start, segment_id) AS island FROM x) SELECT video_id, count(*) AS n, min(segment_id) AS first_segment FROM y GROUP BY video_id, island HAVING count(*) >= 2""")
def repeat_islands(spark, d):
    w = Window.partitionBy("video_id").orderBy("start", "segment_id")
    rows = segments(spark, d).where("text <> ''").withColumn("new", F.coalesce((F.lag("text").over(w) != F.col("text")).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("video_id", "island").agg(F.count("*").alias("n"), F.min("segment_id").alias("first_segment")).where("n >= 2").drop("island")


@add("cache_valid", f"WITH {_C} SELECT v.video_id, coalesce(n,0) > 0 AS valid FROM (SELECT DISTINCT video_id FROM videos) v LEFT JOIN (SELECT video_id, count(*) AS n FROM c WHERE text <> '' GROUP BY 1) k USING (video_id)")
def cache_valid(spark, d):
    n = segments(spark, d).where("text <> ''").groupBy("video_id").agg(F.count("*").alias("n"))
    return unique_videos(table(spark, d, "videos")).select("video_id").join(n, "video_id", "left").select("video_id", (F.coalesce("n", F.lit(0)) > 0).alias("valid"))


@add("full_text", f"WITH {_C} SELECT video_id, sha256(string_agg(t,' ' ORDER BY start, segment_id)) AS hash, length(string_agg(t,' ' ORDER BY start, segment_id))::BIGINT AS chars FROM (SELECT *, regexp_replace(text,'^[ \\t\\r\\n]+|[ \\t\\r\\n]+$','','g') AS t FROM c WHERE text IS NOT NULL) WHERE t <> '' GROUP BY 1")
def full_text(spark, d):
    rows = segments(spark, d).withColumn("t", F.regexp_replace("text", r"^[ \t\r\n]+|[ \t\r\n]+$", "")).where("t <> ''")
    parts = F.sort_array(F.collect_list(F.struct("start", "segment_id", "t")))
    rows = rows.groupBy("video_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("t"))
    return rows.select("video_id", F.sha2("t", 256).alias("hash"), F.length("t").cast("long").alias("chars"))


@add("source_maps", f"WITH {_C} SELECT CASE lower(caption_source) WHEN 'whisper' THEN 'asr' WHEN 'captions_api' THEN 'api' WHEN 'transcript_api' THEN 'api' WHEN 'manual' THEN 'manual' ELSE 'unknown' END AS origin, count(*) AS n FROM c GROUP BY 1")
def source_maps(spark, d):
    return segments(spark, d).groupBy(T.mapped(F.lower("caption_source"), T.ORIGIN, "unknown").alias("origin")).agg(F.count("*").alias("n"))


@add("cell_guard", f"WITH {_C} SELECT segment_id, CASE WHEN substring(text,1,1) IN ('=','+','-','@') THEN '''' || text ELSE text END AS cell FROM c")
def cell_guard(spark, d):
    return segments(spark, d).select("segment_id", T.guarded(F.col("text")).alias("cell"))


@add("source_cascade", f"WITH {_C} SELECT video_id, arg_min(coalesce(caption_source,'none'), (CASE caption_source WHEN 'manual' THEN 0 WHEN 'auto' THEN 1 WHEN 'captions_api' THEN 2 WHEN 'whisper' THEN 3 ELSE 4 END, segment_id)) AS source FROM c GROUP BY 1")
def source_cascade(spark, d):
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in ("manual", "auto", "captions_api", "whisper")]), F.col("caption_source")), F.lit(0).cast("long")), F.lit(9).cast("long"))
    return segments(spark, d).groupBy("video_id").agg(F.min_by(F.coalesce("caption_source", F.lit("none")), F.struct(rank, "segment_id")).alias("source"))


@add("time_bins", f"WITH {_C}, d AS (SELECT video_id, max(fin) AS dur FROM c GROUP BY 1), b AS (SELECT video_id, k.i AS bin, k.i*dur/10 AS lo, (k.i+1)*dur/10 AS hi FROM d, range(10) k(i) WHERE dur > 0) SELECT b.video_id, b.bin::INT AS bin, round(coalesce(sum(greatest(0.0,least(c.fin,b.hi)-greatest(c.start,b.lo))),0.0),4) AS covered FROM b LEFT JOIN c ON c.video_id=b.video_id GROUP BY 1,2")
def time_bins(spark, d):
    rows = segments(spark, d)
    dur = rows.groupBy("video_id").agg(F.max("fin").alias("dur")).where("dur > 0")
    bins = dur.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9))))
    j = bins.join(rows.select("video_id", "start", "fin"), "video_id")
    lo, hi = F.col("bin") * F.col("dur") / 10, (F.col("bin") + 1) * F.col("dur") / 10
    overlap = F.greatest(F.lit(0.0), F.least(F.col("fin"), hi) - F.greatest(F.col("start"), lo))
    return j.groupBy("video_id", "bin").agg(F.round(F.coalesce(F.sum(overlap), F.lit(0.0)), 4).alias("covered"))


_SPAN = f"{_C}, s AS (SELECT video_id, segment_id, start, {_L} AS len FROM c WHERE fin > start), d AS (SELECT video_id, max(start+len) AS dur FROM s GROUP BY 1), k AS (SELECT s.*, d.dur, row_number() OVER (PARTITION BY video_id ORDER BY len, start) AS r, count(*) OVER (PARTITION BY video_id) AS n FROM s JOIN d USING (video_id))"


@add("span_indicators", f"""WITH {_SPAN} SELECT video_id, round(max(len),4) AS longest, round(CASE WHEN max(n) < 2 THEN 0.0 ELSE greatest(0.0,least(1.0,1-sum((2*r-n-1)*len)/(max(n)*sum(len)))) END,4) AS evenness, round(stddev_pop(len),4) AS deviation,
round(count(DISTINCT least(9,floor((start+len/2)/dur*10)))/10.0,4) AS bins, round((count(DISTINCT least(2,floor((start+len/2)/dur*3)))-1)/2.0,4) AS thirds FROM k GROUP BY 1""")
def span_indicators(spark, d):
    s = segments(spark, d).where("fin > start").select("video_id", "start", (F.col("fin") - F.col("start")).alias("len"))
    s = s.withColumn("dur", F.max(F.col("start") + F.col("len")).over(Window.partitionBy("video_id")))
    rows = O.indicators(s, "video_id", "start", "len", "dur")
    return rows.select("video_id", *[F.round(c, 4).alias(c) for c in ("longest", "evenness", "deviation", "bins", "thirds")])


@add("span_diagonal", f"""WITH {_C}, l AS (SELECT video_id, text, row_number() OVER (PARTITION BY video_id ORDER BY start, segment_id) AS i FROM c WHERE text <> ''), u AS (SELECT video_id, text, min(i) AS i FROM l GROUP BY 1,2 HAVING count(*)=1),
p AS (SELECT id, source_video_id s, target_video_id t FROM comparison_results WHERE lower(trim(grade)) IN ('critical','high') AND source_video_id <> target_video_id),
m AS (SELECT p.id, a.i AS i, b.i AS j FROM p JOIN u a ON a.video_id=p.s JOIN u b ON b.video_id=p.t AND b.text=a.text), g AS (SELECT *, i - row_number() OVER (PARTITION BY id, i-j ORDER BY i) AS isl FROM m)
SELECT id, min(i) AS start_a, min(j) AS start_b, count(*) AS n FROM g GROUP BY id, i-j, isl""")
def span_diagonal(spark, d):
    w = Window.partitionBy("video_id").orderBy("start", "segment_id")
    u = segments(spark, d).where("text <> ''").withColumn("i", F.row_number().over(w)).groupBy("video_id", "text").agg(F.min("i").alias("i"), F.count("*").alias("n")).where("n = 1").drop("n")
    p = table(spark, d, "comparison_results").where("lower(trim(grade)) in ('critical', 'high') and source_video_id <> target_video_id").select("id", F.col("source_video_id").alias("s"), F.col("target_video_id").alias("t"))
    a = p.join(u.withColumnRenamed("video_id", "s"), "s")
    m = a.join(u.withColumnsRenamed({"video_id": "t", "i": "j"}), ["t", "text"]).select("id", "i", "j", (F.col("i") - F.col("j")).alias("diag"))
    m = m.withColumn("isl", F.col("i") - F.row_number().over(Window.partitionBy("id", "diag").orderBy("i")))
    return m.groupBy("id", "diag", "isl").agg(F.min("i").alias("start_a"), F.min("j").alias("start_b"), F.count("*").alias("n")).select("id", "start_a", "start_b", "n")


@add("earliest_n", "SELECT video_id, r::INT AS place FROM (SELECT video_id, dense_rank() OVER (ORDER BY video_id) AS r FROM (SELECT DISTINCT video_id FROM case_c_video2)) WHERE r <= 50")
def earliest_n(spark, d):
    first = table(spark, d, "case_c_video2").select("video_id").distinct().orderBy("video_id").limit(50)
    return first.withColumn("place", F.dense_rank().over(Window.orderBy("video_id")))


@add("export_txt")
def export_txt(spark, d):
    line = F.concat(F.lit("["), T.hms(F.col("start")), F.lit("] "), T.without_fillers(F.col("text")))
    rows = segments(spark, d).where("text is not null and start is not null").select("video_id", "start", "segment_id", line.alias("line")).where("not endswith(line, '] ')")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("start", "segment_id", "line"))), lambda x: x["line"])
    return rows.groupBy("video_id").agg(F.array_join(lines, "\n").alias("txt"))


@add("export_jsonl")
def export_jsonl(spark, d):
    row = F.to_json(F.struct("start", F.col("fin").alias("end"), "text"))
    rows = segments(spark, d).where("text <> ''").select("video_id", "start", "segment_id", row.alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("start", "segment_id", "line"))), lambda x: x["line"])
    return rows.groupBy("video_id").agg(F.array_join(lines, "\n").alias("jsonl"))


@add("export_counts", f"WITH {_C} SELECT count(*) AS total, count(k.video_id) AS exported, count(*) - count(k.video_id) AS skipped FROM (SELECT DISTINCT video_id FROM videos) v LEFT JOIN (SELECT DISTINCT video_id FROM c WHERE text <> '') k USING (video_id)")
def export_counts(spark, d):
    have = segments(spark, d).where("text <> ''").select("video_id").distinct().withColumn("have", F.lit(True))
    return unique_videos(table(spark, d, "videos")).join(have, "video_id", "left").agg(F.count("*").alias("total"), F.count("have").alias("exported"), F.count_if(F.col("have").isNull()).alias("skipped"))


@add("quality_universe", f"WITH {_C}, k AS (SELECT video_id, count(*) AS n FROM c GROUP BY 1), v AS (SELECT DISTINCT video_id, duration_seconds FROM videos) SELECT coalesce(k.video_id,v.video_id) AS video_id, n, duration_seconds FROM k FULL JOIN v ON k.video_id=v.video_id")
def quality_universe(spark, d):
    n = segments(spark, d).groupBy("video_id").agg(F.count("*").alias("n"))
    return n.join(unique_videos(table(spark, d, "videos")).select("video_id", "duration_seconds"), "video_id", "full_outer")


@add("idempotency_flags", "SELECT v.video_id, EXISTS (SELECT 1 FROM case_c_video2 c WHERE c.video_id=v.video_id) AS transcript, EXISTS (SELECT 1 FROM comparison_results r WHERE r.source_video_id=v.video_id) AS compared FROM (SELECT DISTINCT video_id FROM videos) v")
def idempotency_flags(spark, d):
    v = unique_videos(table(spark, d, "videos")).select("video_id")
    t = table(spark, d, "case_c_video2").select("video_id").distinct().withColumn("t", F.lit(True))
    r = table(spark, d, "comparison_results").select(F.col("source_video_id").alias("video_id")).distinct().withColumn("r", F.lit(True))
    return v.join(t, "video_id", "left").join(r, "video_id", "left").select("video_id", F.col("t").isNotNull().alias("transcript"), F.col("r").isNotNull().alias("compared"))


@add("gini_rank", f"WITH {_SPAN} SELECT video_id, segment_id, (2*r-n-1)::BIGINT AS weight FROM k")
def gini_rank(spark, d):
    w = Window.partitionBy("video_id")
    s = segments(spark, d).where("fin > start").withColumn("len", F.col("fin") - F.col("start"))
    rank, n = F.row_number().over(w.orderBy("len", "start")), F.count("*").over(w)
    return s.select("video_id", "segment_id", (2 * rank - n - 1).cast("long").alias("weight"))


@add("source_pair", f"WITH {_C}, o AS (SELECT DISTINCT video_id, coalesce(lower(caption_source),'unknown') AS s FROM c) SELECT video_id, min(s) || '-' || max(s) AS pair FROM o GROUP BY 1")
def source_pair(spark, d):
    s = F.coalesce(F.lower("caption_source"), F.lit("unknown"))
    return segments(spark, d).groupBy("video_id").agg(F.concat_ws("-", F.min(s), F.max(s)).alias("pair"))


@add("transcript_normalize", f"WITH {_C} SELECT segment_id, translate(trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text),'(?s)\\[.*?\\]|\\(.*?\\)|<.*?>|\\*.*?\\*|♪.*?♪|♪','','g'),'[.。,，?？!！~～…‥\"''`、]','','g'),'[ \\t\\n\\r\\f\\x0B]+',' ','g')),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS t FROM c WHERE text IS NOT NULL")
def transcript_normalize(spark, d):
    return segments(spark, d).where("text is not null").select("segment_id", T.transcript_form(F.col("text")).alias("t"))


@add("transcripts_versioned", f"WITH {_C} SELECT video_id, count(*) AS n, count(*) FILTER (WHERE caption_source = 'manual') = count(*) AS skipped, min(caption_source) AS first_source FROM (SELECT video_id, coalesce(caption_source,'manual') AS caption_source FROM c WHERE text <> '') GROUP BY 1")
def transcripts_versioned(spark, d):
    """Stored transcripts brought to the newest version of the normal form; those that have it already are skipped."""
    one = F.struct("start", F.col("fin").alias("end"), "text")
    rows = segments(spark, d).where("text <> ''").withColumn("source", F.coalesce("caption_source", F.lit("manual")))
    docs = rows.groupBy("video_id").agg(F.sort_array(F.collect_list(one)).alias("segments"), F.min("source").alias("first_source"), F.when(F.bool_and(F.col("source") == "manual"), O.TEXT_VERSION).otherwise(0).alias("version"))
    done = O.normalised_transcripts(docs)
    return done.select("video_id", F.size("segments").cast("long").alias("n"), "skipped", "first_source")


# quality -------------------------------------------------------------------------------------------------------------


@add("quality_checks", f"""WITH {_C}, {I.FACTS}, w AS (SELECT c.video_id, list_filter(string_split_regex(coalesce(text,''),'[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS w, text, {_L} AS len FROM c),
q AS (SELECT v.video_id, coalesce(v.duration_seconds,0) AS dur, any_value(p.course) AS course, count(w.video_id) AS n, sum(w.len) AS spoken, sum(length(coalesce(text,''))) AS chars, sum(len(w.w)) AS words, sum(len(list_filter(w.w, lambda x: list_contains(list_filter(string_split_regex(coalesce(p.course,''),'[ \\t\\n\\r\\f\\x0B]+'), lambda y: y <> ''), x)))) AS hits
FROM v LEFT JOIN p USING (video_id) LEFT JOIN w ON w.video_id=v.video_id GROUP BY v.video_id, v.duration_seconds),
r AS (SELECT video_id, n > 0 AS voice, dur >= 300 AS long_enough, CASE WHEN n > 0 AND course IS NOT NULL AND words > 0 THEN hits*1.0e0/words END AS relevance, CASE WHEN n > 0 AND dur > 0 THEN greatest(0.0e0, dur-spoken)/dur END AS silence, CASE WHEN n > 0 AND dur > 0 THEN chars/(dur/60.0e0) END AS density FROM q)
SELECT video_id, voice, long_enough, round(relevance,6) AS relevance, round(silence,6) AS silence, round(density,4) AS density, voice::INT + long_enough::INT + coalesce(relevance >= 0.1,false)::INT + coalesce(silence < 0.3,false)::INT + coalesce(density BETWEEN 200 AND 600,false)::INT AS passed FROM r""")
def quality_checks(spark, d):
    """Voice, least duration, share of words from the course's name, silence and density of every video, and how many of the five pass."""
    known = I.facts(spark, d).select("video_id", "course", F.coalesce(T.words(F.col("course")), F.array().cast("array<string>")).alias("terms"))
    v = I.videos(spark, d).select("video_id", F.coalesce("duration_seconds", F.lit(0)).alias("dur")).join(known, "video_id", "left")
    # hits are counted per video with its own terms, so segments are summed after meeting the one row of their video
    rows = segments(spark, d).select("video_id", F.coalesce("text", F.lit("")).alias("t"), _len().alias("len")).join(v.select("video_id", "terms"), "video_id")
    w = T.words(F.col("t"))
    by = rows.groupBy("video_id").agg(F.count("*").alias("n"), F.sum("len").alias("spoken"), F.sum(F.length("t")).alias("chars"), F.sum(F.size(w)).alias("words"), F.sum(F.size(F.filter(w, lambda x: F.array_contains(F.col("terms"), x)))).alias("hits"))
    q = v.join(by, "video_id", "left").na.fill(0, ["n"])
    some, timed = F.col("n") > 0, (F.col("n") > 0) & (F.col("dur") > 0)
    relevance = F.when(some & F.col("course").isNotNull() & (F.col("words") > 0), F.col("hits") / F.col("words"))
    silence = F.when(timed, F.greatest(F.lit(0.0), F.col("dur") - F.col("spoken")) / F.col("dur"))
    density = F.when(timed, F.col("chars") / (F.col("dur") / 60.0))
    q = q.select("video_id", some.alias("voice"), (F.col("dur") >= 300).alias("long_enough"), relevance.alias("relevance"), silence.alias("silence"), density.alias("density"))
    checks = [F.col("voice"), F.col("long_enough"), F.col("relevance") >= 0.1, F.col("silence") < 0.3, F.col("density").between(200, 600)]
    passed = sum((F.coalesce(x, F.lit(False)).cast("int") for x in checks), F.lit(0))
    return q.select("video_id", "voice", "long_enough", F.round("relevance", 6).alias("relevance"), F.round("silence", 6).alias("silence"), F.round("density", 4).alias("density"), passed.alias("passed"))


# What the recogniser gives with a segment: its compression ratio (here characters over different characters), and the language of most letters.
_ASR = f"""a AS (SELECT *, trim(coalesce(text,''), ' ' || chr(9) || chr(10) || chr(13)) AS t, CASE WHEN length(text) > 0 THEN length(text)*1.0e0/len(list_distinct(string_split(text,''))) ELSE 0.0e0 END AS ratio, len(regexp_extract_all(coalesce(text,''),'[가-힣]')) AS ko, len(regexp_extract_all(coalesce(text,''),'[A-Za-z]')) AS en FROM c)"""


@add("asr_flags", f"""WITH {_C}, {_ASR}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start, segment_id) - row_number() OVER (PARTITION BY video_id, t ORDER BY start, segment_id) AS isl FROM a),
p AS (SELECT video_id, max(k) >= 3 AS repeats FROM (SELECT video_id, t, isl, count(*) AS k FROM r WHERE t <> '' GROUP BY 1,2,3) GROUP BY 1),
s AS (SELECT video_id, avg(CASE WHEN coalesce(fin,0)-start < 0.5 THEN 1.0e0 ELSE 0.0e0 END) > 0.3 AS short, count(*) FILTER (WHERE ratio > 2.4) AS compression_violations, bool_or(regexp_matches(t, '(?i){"|".join(SILENCE)}')) AS filler, sum(ko) <= sum(en) AS mismatch FROM a GROUP BY 1)
SELECT s.video_id, coalesce(repeats,false) AS hallucination_repeat, false AS vad_over_truncated, mismatch AS language_mismatch, short AS short_segments_excess, filler AS silence_hallucination, compression_violations FROM s LEFT JOIN p USING (video_id)""")
def asr_flags(spark, d):
    """The six flags of a recognised transcript; Korean is expected."""
    text = F.coalesce("text", F.lit(""))
    letters = lambda p: F.length(F.regexp_replace(text, f"[^{p}]", ""))
    ratio = F.when(F.length("text") > 0, F.length("text") / F.size(F.array_distinct(F.split("text", "")))).otherwise(0.0)
    rows = segments(spark, d).select("video_id", "segment_id", "start", "fin", F.regexp_replace(text, r"^[ \t\n\r]+|[ \t\n\r]+$", "").alias("t"), ratio.alias("compression_ratio"), letters("가-힣").alias("ko"), letters("A-Za-z").alias("en"))
    w = Window.partitionBy("video_id").orderBy("start", "segment_id")
    new = F.coalesce((F.lag("t").over(w) != F.col("t")).cast("int"), F.lit(1))
    islands = rows.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    repeats = islands.where("t <> ''").groupBy("video_id", "island").count().groupBy("video_id").agg((F.max("count") >= 3).alias("repeats"))
    short = F.avg(F.when(F.coalesce("fin", F.lit(0.0)) - F.col("start") < 0.5, 1.0).otherwise(0.0)) > 0.3
    filler = F.bool_or(F.col("t").rlike("(?i)" + "|".join(SILENCE)))
    flags = rows.groupBy("video_id").agg(short.alias("short_segments_excess"), F.count_if(F.col("compression_ratio") > 2.4).alias("compression_violations"), filler.alias("silence_hallucination"), (F.sum("ko") <= F.sum("en")).alias("language_mismatch"))
    return flags.join(repeats, "video_id", "left").select("video_id", F.coalesce("repeats", F.lit(False)).alias("hallucination_repeat"), F.lit(False).alias("vad_over_truncated"), "language_mismatch", "short_segments_excess", "silence_hallucination", "compression_violations")


# retention -----------------------------------------------------------------------------------------------------------


@add("chapter_overlap", f"""WITH {_C}, {I.RETENTION}, k AS (SELECT c.segment_id, c.video_id, c.start/dur AS lo, c.fin/dur AS hi FROM c JOIN (SELECT DISTINCT video_id, duration_seconds*1.0e0 AS dur FROM videos WHERE duration_seconds > 0) w USING (video_id) SEMI JOIN hot USING (video_id))
SELECT segment_id, count(h.elapsed_ratio) AS hotspots, count(h.elapsed_ratio) > 0 AS retention_issue FROM k LEFT JOIN hot h ON h.video_id=k.video_id AND h.elapsed_ratio BETWEEN k.lo AND k.hi GROUP BY 1""")
def chapter_overlap(spark, d):
    """How many retention hotspots of its video lie in each segment; videos without hotspots or a duration have no rows."""
    hot = I.hotspots(I.retention(spark, d)).select("video_id", F.col("elapsed_ratio").alias("at"))
    spots = hot.groupBy("video_id").agg(F.sort_array(F.collect_list("at")).alias("spots"))  # as many as a curve has points
    dur = I.videos(spark, d).where("duration_seconds > 0").select("video_id", F.col("duration_seconds").cast("double").alias("dur"))
    rows = segments(spark, d).select("segment_id", "video_id", "start", "fin").join(dur, "video_id").join(spots, "video_id")
    inside = F.size(F.filter("spots", lambda x: (x >= F.col("start") / F.col("dur")) & (x <= F.col("fin") / F.col("dur"))))
    return rows.select("segment_id", inside.cast("long").alias("hotspots"), (inside > 0).alias("retention_issue"))


# baseline corpus and phrase whitelist of each channel: phrases in the phrase form ------------------------------------------

EARLIEST, OCCURRENCES, SAMPLE = 200, 3, 80
_X = f"x AS (SELECT *, {I.phrase_sql('text')} AS f, {I.phrase_sql(f'substring(text,1,{SAMPLE})')} AS f80 FROM c WHERE text IS NOT NULL)"
_BASE = f"""{_X}, e AS (SELECT channel_id, video_id FROM (SELECT DISTINCT channel_id, video_id FROM c) QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY video_id) <= {EARLIEST}),
b AS (SELECT channel_id, f, count(DISTINCT video_id) AS n, array_to_string(list_sort(list(DISTINCT video_id)),'|') AS sources FROM x SEMI JOIN e USING (channel_id, video_id) WHERE f <> '' GROUP BY 1,2 HAVING count(DISTINCT video_id) >= {OCCURRENCES})"""
_WHITE = "wl AS (SELECT DISTINCT channel_id, f FROM x WHERE segment_index = 0 AND f <> '')"


def phrased(spark, d) -> DataFrame:
    """Segments with f, the phrase form of their text, and f80, that of its first 80 characters, by which spans are compared."""
    rows = segments(spark, d).where("text is not null")
    rows = rows.withColumn("f", T.phrase(F.col("text")))
    return rows.withColumn("f80", F.when(F.length("text") <= SAMPLE, F.col("f")).otherwise(T.phrase(F.substring("text", 1, SAMPLE))))


def baseline(rows: DataFrame, earliest: int = EARLIEST, occurrences: int = OCCURRENCES) -> DataFrame:
    """channel_id, f, n, sources: phrases that occur in at least `occurrences` of the channel's earliest videos by name."""
    place = F.row_number().over(Window.partitionBy("channel_id").orderBy("video_id"))
    first = rows.select("channel_id", "video_id").distinct().withColumn("place", place).where(F.col("place") <= earliest).drop("place")
    by = rows.where("f <> ''").join(first, ["channel_id", "video_id"], "left_semi").groupBy("channel_id", "f").agg(F.countDistinct("video_id").alias("n"), F.concat_ws("|", F.sort_array(F.collect_set("video_id"))).alias("sources"))
    return by.where(F.col("n") >= occurrences)


def whitelist(rows: DataFrame) -> DataFrame:
    return rows.where("segment_index = 0 and f <> ''").select("channel_id", "f").distinct()


@add("span_marking", f"WITH {_C}, {_BASE} SELECT segment_id, b.f IS NOT NULL AS baseline FROM x LEFT JOIN b ON b.channel_id=x.channel_id AND b.f = x.f80")
def span_marking(spark, d):
    rows = phrased(spark, d)
    known = baseline(rows).select("channel_id", F.col("f").alias("f80"), F.lit(True).alias("hit"))
    return rows.join(known, ["channel_id", "f80"], "left").select("segment_id", F.col("hit").isNotNull().alias("baseline"))


@add("baseline_bootstrap", f"WITH {_C}, {_BASE} SELECT channel_id, f AS phrase, n AS occurrences, sources FROM b")
def baseline_bootstrap(spark, d):
    return baseline(phrased(spark, d)).select("channel_id", F.col("f").alias("phrase"), F.col("n").alias("occurrences"), "sources")


@add("baseline_subtract", f"WITH {_C}, {_BASE} SELECT video_id, count(*) FILTER (WHERE b.f IS NULL) AS kept, round(sum(CASE WHEN b.f IS NOT NULL THEN {_L} ELSE 0 END),4) AS subtracted FROM x LEFT JOIN b ON b.channel_id=x.channel_id AND b.f=x.f80 GROUP BY 1")
def baseline_subtract(spark, d):
    rows = phrased(spark, d)
    known = baseline(rows).select("channel_id", F.col("f").alias("f80"), F.lit(True).alias("hit"))
    return rows.join(known, ["channel_id", "f80"], "left").groupBy("video_id").agg(F.count_if(F.col("hit").isNull()).alias("kept"), F.round(F.sum(F.when(F.col("hit"), _len()).otherwise(0.0)), 4).alias("subtracted"))


@add("layer_b", f"WITH {_C}, {_BASE} SELECT segment_id FROM x ANTI JOIN (SELECT channel_id, f AS f80 FROM b) k USING (channel_id, f80)")
def layer_b(spark, d):
    """The spans that layer B leaves; its threshold is accepted and not used, as in the definition."""
    rows = phrased(spark, d)
    return rows.join(baseline(rows).select("channel_id", F.col("f").alias("f80")), ["channel_id", "f80"], "left_anti").select("segment_id")


@add("phrase_subtract", f"WITH {_C}, {_X}, {_WHITE} SELECT x.channel_id, count(wl.f) AS removed, count(*) - count(wl.f) AS remaining FROM x LEFT JOIN wl ON wl.channel_id=x.channel_id AND wl.f=x.f80 GROUP BY 1")
def phrase_subtract(spark, d):
    rows = phrased(spark, d)
    white = whitelist(rows).select("channel_id", F.col("f").alias("f80"), F.lit(True).alias("hit"))
    return rows.join(white, ["channel_id", "f80"], "left").groupBy("channel_id").agg(F.count("hit").alias("removed"), F.count_if(F.col("hit").isNull()).alias("remaining"))


@add("baseline_list", f"WITH {_C}, {_BASE} SELECT channel_id, f AS phrase, n AS occurrences, row_number() OVER (PARTITION BY channel_id ORDER BY n DESC, f) AS place FROM b")
def baseline_list(spark, d):
    w = Window.partitionBy("channel_id").orderBy(F.desc("n"), "f")
    return baseline(phrased(spark, d)).select("channel_id", F.col("f").alias("phrase"), F.col("n").alias("occurrences"), F.row_number().over(w).cast("long").alias("place"))


@add("baseline_add", f"WITH {_C}, {_BASE}, {_WHITE} SELECT coalesce(b.channel_id,wl.channel_id) AS channel_id, coalesce(b.f,wl.f) AS phrase, coalesce(n,0) + CASE WHEN wl.f IS NULL THEN 0 ELSE 1 END AS occurrences FROM b FULL JOIN wl ON wl.channel_id=b.channel_id AND wl.f=b.f")
def baseline_add(spark, d):
    rows = phrased(spark, d)
    return G.add_phrases_counting(baseline(rows).select("channel_id", "f", "n"), whitelist(rows)).select("channel_id", F.col("f").alias("phrase"), F.col("n").alias("occurrences"))


@add("baseline_remove", f"WITH {_C}, {_BASE}, {_WHITE} SELECT b.channel_id, b.f AS phrase FROM b ANTI JOIN wl ON wl.channel_id IS NOT DISTINCT FROM b.channel_id AND wl.f=b.f")
def baseline_remove(spark, d):
    rows = phrased(spark, d)
    return G.remove(baseline(rows).select("channel_id", "f"), whitelist(rows), ["channel_id", "f"]).select("channel_id", F.col("f").alias("phrase"))


@add("whitelist_add", f"WITH {_C}, {_X}, {_WHITE}, nw AS (SELECT channel_id, f FROM x WHERE segment_index = 1 AND f <> '') SELECT nw.channel_id, nw.f AS phrase, CASE WHEN any_value(wl.f) IS NULL THEN 'added' ELSE 'duplicate' END AS state FROM nw LEFT JOIN wl ON wl.channel_id IS NOT DISTINCT FROM nw.channel_id AND wl.f=nw.f GROUP BY 1,2")
def whitelist_add(spark, d):
    rows = phrased(spark, d)
    new = rows.where("segment_index = 1 and f <> ''").select("channel_id", "f")
    return G.add_unique(whitelist(rows), new, ["channel_id", "f"]).select("channel_id", F.col("f").alias("phrase"), "state")


# spans ---------------------------------------------------------------------------------------------------------------

_SERIOUS = "p AS (SELECT id, source_video_id s, target_video_id t FROM comparison_results WHERE lower(trim(grade)) IN ('critical','high') AND source_video_id <> target_video_id)"


def _serious(spark, d) -> DataFrame:
    return table(spark, d, "comparison_results").where("lower(trim(grade)) in ('critical', 'high') and source_video_id <> target_video_id").select(F.col("id").alias("pair_id"), F.col("source_video_id").alias("source"), F.col("target_video_id").alias("target"))


def _placed(spark, d) -> DataFrame:
    """Lines of every video with their place in the order of speech and their phrase form."""
    rows = segments(spark, d).withColumn("form", F.coalesce(T.phrase(F.col("text")), F.lit("")))
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("start", "segment_id")) - 1
    return rows.select("video_id", place.alias("line"), "form", "start", F.coalesce("fin", "start").alias("end"), "text")


@add("spans_exact")
def spans_exact(spark, d):
    return O.match_spans(_serious(spark, d), _placed(spark, d))


@add("spans_sorted")
def spans_sorted(spark, d):
    rows = spans_exact(spark, d).groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("start_a", "length"))).alias("s"))
    return rows.select("pair_id", F.posexplode("s").alias("place", "x")).select("pair_id", "place", "x.*")


@add("time_axis")
def time_axis(spark, d):
    """I-6 to I-8 of every serious pair in both definitions, and the coverage of each half: spans of spans_exact."""
    rows = _placed(spark, d)
    dur = rows.groupBy("video_id").agg(F.max_by("end", "line").alias("dur"))
    pairs = _serious(spark, d).join(dur.withColumnsRenamed({"video_id": "source", "dur": "dur_a"}), "source").join(dur.withColumnsRenamed({"video_id": "target", "dur": "dur_b"}), "target")
    out = O.pair_indicators(pairs.select("pair_id", "dur_a", "dur_b"), O.match_spans(_serious(spark, d), rows))
    return out.select("pair_id", *[F.round(c, 4).alias(c) for c in out.columns if c != "pair_id"])


@add("pairs_json")
def pairs_json(spark, d):
    """A document per pair with its spans nested in order."""
    spans = spans_exact(spark, d).groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("start_a", "end_a", "start_b", "end_b", "length", "sample"))).alias("match_spans"))
    rows = table(spark, d, "comparison_results").where("lower(trim(grade)) in ('critical', 'high')").select(F.col("id").alias("pair_id"), "source_video_id", "target_video_id", "suspicion_score", "grade")
    rows = rows.join(spans, "pair_id", "left")
    return rows.select("pair_id", F.to_json(F.struct("pair_id", "source_video_id", "target_video_id", "suspicion_score", "grade", F.coalesce("match_spans", F.array().cast(spans.schema["match_spans"].dataType)).alias("match_spans"))).alias("document"))


@add("srt_segments", f"WITH {_C} SELECT segment_id, round(floor(start) + floor((start-floor(start))*1000)/1000.0e0,3) AS start, round(floor(fin) + floor((fin-floor(fin))*1000)/1000.0e0,3) AS \"end\", trim(regexp_replace(text,'\\s*\\n\\s*',' ','g')) AS text FROM c WHERE text <> '' AND fin > start AND trim(text) <> ''")
def srt_segments(spark, d):
    """Captions written as SRT and read back."""
    stamp = lambda c: F.concat(T.hms(c), F.lit(","), F.lpad(F.floor((c - F.floor(c)) * 1000).cast("string"), 3, "0"))
    rows = segments(spark, d).where("text <> '' and fin > start")
    srt = rows.select("segment_id", F.concat(F.lit("1\n"), stamp(F.col("start")), F.lit(" --> "), stamp(F.col("fin")), F.lit("\n"), "text", F.lit("\n\n")).alias("srt"))
    return parse_srt(srt, "segment_id", "srt").select("segment_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


@add("transcript_cascade", f"WITH {_C} SELECT v.video_id, coalesce(arg_min(origin, (CASE origin WHEN 'manual' THEN 0 WHEN 'auto' THEN 1 WHEN 'captions_api' THEN 2 WHEN 'whisper' THEN 3 ELSE 4 END)),'none') AS source, CASE WHEN count(origin) > 0 THEN 'collected' WHEN any_value(v.privacy_status) IN ('private','unlisted') THEN 'private_no_captions_api' ELSE 'unknown' END AS outcome FROM (SELECT DISTINCT video_id, privacy_status FROM videos) v LEFT JOIN (SELECT DISTINCT video_id, coalesce(caption_source,'other') AS origin FROM c WHERE text <> '') o USING (video_id) GROUP BY 1")
def transcript_cascade(spark, d):
    """Collection of transcripts: for every video the source that comes first, or why there is none."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in ("manual", "auto", "captions_api", "whisper")]), F.col("origin")), F.lit(0).cast("long")), F.lit(9).cast("long"))
    have = segments(spark, d).where("text <> ''").withColumn("origin", F.coalesce("caption_source", F.lit("other"))).groupBy("video_id").agg(F.min_by("origin", rank).alias("origin"))
    v = I.videos(spark, d).select("video_id", "privacy_status").join(have, "video_id", "left")
    none = F.lit(None).cast("string")
    return v.select("video_id", F.coalesce("origin", F.lit("none")).alias("source"), F.when(F.col("origin").isNotNull(), "collected").otherwise(T.miss_class(none, none, F.col("privacy_status"))).alias("outcome"))
