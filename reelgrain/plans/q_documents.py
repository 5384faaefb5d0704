"""Queries on documents, registers, vectors and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgrain.functions import scoring as S
from reelgrain.functions import text as T
from reelgrain.operators import vectors as V
from reelgrain.operators.facts import latest, merge, unique_videos, violations
from reelgrain.operators import governance as G
from reelgrain.operators import titles as titles_op
from reelgrain.plans import inputs as I
from reelgrain.plans.registry import Registry
from reelgrain.storage import table

QUERIES = Registry()
add = QUERIES.add


def docs(spark, d) -> DataFrame:
    return table(spark, d, "documents")


@add("scan_parquet", "SELECT count(*) AS n, count(text) AS texts, sum(length(text))::BIGINT AS chars FROM documents")
def scan_parquet(spark, d):
    return docs(spark, d).agg(F.count("*").alias("n"), F.count("text").alias("texts"), F.sum(F.length("text")).alias("chars"))


@add("hash_duplicates", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def hash_duplicates(spark, d):
    return docs(spark, d).where("text is not null").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_TITLES = "v AS (SELECT DISTINCT video_id, list_filter(string_split_regex(title,'[ \\t\\n\\r\\f]+'), lambda w: w <> '') AS w FROM videos WHERE title IS NOT NULL), p AS (SELECT c.id, list_distinct(a.w) AS s, list_distinct(b.w) AS t FROM comparison_results c JOIN v a ON a.video_id=c.source_video_id JOIN v b ON b.video_id=c.target_video_id)"


_WORDS = "w AS (SELECT doc_id, unnest(list_filter(string_split_regex(text,'[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS t FROM documents WHERE text IS NOT NULL)"


@add("normalize_phrase_ascii", r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_]', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))) AS hash FROM documents WHERE regexp_matches(text, '^[\x00-\x7F]*$')""")
def normalize_phrase_ascii(spark, d):
    rows = docs(spark, d).where(F.col("text").rlike(r"^[\x00-\x7F]*$"))
    return rows.select("doc_id", F.sha2(T.ascii_phrase(F.col("text")), 256).alias("hash"))


@add("ascii_lower", "SELECT doc_id, sha256(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')) AS hash FROM documents")
def ascii_lower(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(T.ascii_lower(F.col("text")), 256).alias("hash"))


@add("questions", "SELECT doc_id FROM documents WHERE text <> '' AND (contains(text,'?') OR contains(text,'나요'))")
def questions(spark, d):
    return docs(spark, d).where((F.col("text") != "") & (F.contains("text", F.lit("?")) | F.contains("text", F.lit("나요")))).select("doc_id")


@add("sentiment_skip", "SELECT doc_id, NULL::VARCHAR AS sentiment, 0.0e0 AS score, false AS is_question FROM documents")
def sentiment_skip(spark, d):
    return docs(spark, d).select("doc_id", F.lit(None).cast("string").alias("sentiment"), F.lit(0.0).alias("score"), F.lit(False).alias("is_question"))


@add("best_track", "SELECT video_id, doc_id, lang FROM documents WHERE video_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY coalesce(nullif(list_position(['ko','en','ja'], lang),0),9), doc_id)=1")
def best_track(spark, d):
    rank = F.coalesce(F.nullif(F.array_position(F.array(F.lit("ko"), F.lit("en"), F.lit("ja")), F.col("lang")), F.lit(0).cast("long")), F.lit(9).cast("long"))
    best = F.min_by(F.struct("doc_id", "lang"), F.struct(rank, "doc_id")).alias("b")
    return docs(spark, d).where("video_id is not null").groupBy("video_id").agg(best).select("video_id", "b.doc_id", "b.lang")


@add("tolerance", "SELECT DISTINCT c.id FROM comparison_results c WHERE abs(i5_duration_diff_seconds) <= 1.0 OR abs(epoch_us(created_at)-epoch_us(reviewed_at)) <= 86400000000")
def tolerance(spark, d):
    gap = F.abs(F.unix_micros("created_at") - F.unix_micros("reviewed_at"))
    return table(spark, d, "comparison_results").where((F.abs("i5_duration_diff_seconds") <= 1.0) | (gap <= 86400000000)).select("id")


@add("whitelist_export", "SELECT 'pair' AS kind, id::VARCHAR AS key, course AS scope, NULL::VARCHAR AS phrase FROM comparison_results WHERE review_status IS NOT NULL UNION ALL SELECT 'phrase', segment_id, channel_id, text FROM (SELECT DISTINCT segment_id, channel_id, text FROM case_c_video2) WHERE text LIKE '[%'")
def whitelist_export(spark, d):
    pairs = table(spark, d, "comparison_results").where("review_status is not null").select(F.lit("pair").alias("kind"), F.col("id").cast("string").alias("key"), F.col("course").alias("scope"))
    phrases = table(spark, d, "case_c_video2").where(F.startswith("text", F.lit("["))).select(F.lit("phrase").alias("kind"), F.col("segment_id").alias("key"), F.col("channel_id").alias("scope"), F.col("text").alias("phrase")).distinct()
    return pairs.unionByName(phrases, allowMissingColumns=True)


@add("whitelist_views", "SELECT coalesce(review_status,'none') AS status, coalesce(reviewed_by,'none') AS actor, count(*) AS n, count(DISTINCT professor) AS professors FROM comparison_results GROUP BY 1,2")
def whitelist_views(spark, d):
    return table(spark, d, "comparison_results").groupBy(F.coalesce("review_status", F.lit("none")).alias("status"), F.coalesce("reviewed_by", F.lit("none")).alias("actor")).agg(F.count("*").alias("n"), F.countDistinct("professor").alias("professors"))


@add("slug", "SELECT id, regexp_replace(course,'\\s+','_','g') || '_' || week || '_' || session AS slug FROM comparison_results")
def slug(spark, d):
    return table(spark, d, "comparison_results").select("id", T.slug(F.col("course"), F.col("week").cast("string"), F.col("session").cast("string")).alias("slug"))


# vectors ---------------------------------------------------------------------------------------------------------

_DOUBLES = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"


@add("nc2_cosine_pairs", f"WITH e AS ({_DOUBLES}) SELECT a.vec_id AS id, count(*) FILTER (WHERE b.vec_id IS NOT NULL AND round(greatest(0.0,list_cosine_similarity(a.v,b.v)),6) >= 0.2) AS links FROM e a LEFT JOIN e b ON a.label=b.label AND a.vec_id<>b.vec_id GROUP BY 1")
def nc2_cosine_pairs(spark, d):
    return V.cosine_links(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 0.2)


@add("cosine_neighbour", f"WITH e AS ({_DOUBLES}), n AS (SELECT vec_id, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM e) SELECT vec_id, round(greatest(0.0,least(1.0,list_cosine_similarity(v,w))),6) AS cosine FROM n WHERE w IS NOT NULL")
def cosine_neighbour(spark, d):
    after = F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    return table(spark, d, "embeddings").withColumn("w", after).where("w is not null").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("w")), 6).alias("cosine"))


def _bits(c):
    return F.transform(c, lambda x: F.floor((x.cast("double") + 1.0) * 1000000000.0).cast("long"))


@add("hamming", "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor((x::DOUBLE+1.0e0)*1000000000.0e0)::BIGINT) AS v FROM embeddings), n AS (SELECT vec_id, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM e) SELECT vec_id, round(list_avg(list_transform(list_zip(v,w), lambda p: bit_count(xor(p[1],p[2])))),6) AS bits FROM n WHERE w IS NOT NULL")
def hamming(spark, d):
    after = F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    rows = table(spark, d, "embeddings").withColumn("w", after).where("w is not null")
    return rows.select("vec_id", F.round(S.bit_distance(_bits(F.col("embedding")), _bits(F.col("w"))), 6).alias("bits"))


# joins over channels and registers ---------------------------------------------------------------------------------

_VD = "v AS (SELECT DISTINCT video_id, channel_id, title, duration_seconds, view_count, privacy_status FROM videos)"


def vids(spark, d) -> DataFrame:
    return unique_videos(table(spark, d, "videos")).select("video_id", "channel_id", "title", "duration_seconds", "view_count", "privacy_status")


def channels(spark, d) -> DataFrame:
    return table(spark, d, "channel_metadata").dropDuplicates(["channel_id"])


@add("pool_videos", f"WITH {_VD}, m AS (SELECT channel_title, min(channel_id) AS channel_id FROM channel_metadata GROUP BY 1) SELECT m.channel_title, v.video_id FROM m JOIN v USING (channel_id)")
def pool_videos(spark, d):
    first = channels(spark, d).groupBy("channel_title").agg(F.min("channel_id").alias("channel_id"))
    return vids(spark, d).join(first, "channel_id").select("channel_title", "video_id")


@add("caption_pool", f"WITH {_VD} SELECT m.channel_title, count(*) AS n FROM channel_metadata m JOIN v USING (channel_id) SEMI JOIN case_c_video2 c USING (video_id) GROUP BY 1")
def caption_pool(spark, d):
    rows = vids(spark, d).join(table(spark, d, "case_c_video2").select("video_id"), "video_id", "left_semi")
    return rows.join(channels(spark, d).select("channel_id", "channel_title"), "channel_id").groupBy("channel_title").agg(F.count("*").alias("n"))


@add("explode_owners", "SELECT course, count(*) AS n, count(DISTINCT detail_id) AS people FROM (SELECT detail_id, unnest(courses) AS course FROM professor_detail) GROUP BY 1")
def explode_owners(spark, d):
    return table(spark, d, "professor_detail").select("detail_id", F.explode("courses").alias("course")).groupBy("course").agg(F.count("*").alias("n"), F.countDistinct("detail_id").alias("people"))


@add("ordered_distinct", "SELECT video_id, array_to_string(list_sort(list_distinct(tags || tags)),'|') AS tags FROM (SELECT DISTINCT video_id, tags FROM videos) WHERE tags IS NOT NULL")
def ordered_distinct(spark, d):
    rows = unique_videos(table(spark, d, "videos")).where("tags is not null")
    return rows.select("video_id", F.concat_ws("|", F.sort_array(F.array_distinct(F.concat("tags", "tags")))).alias("tags"))


@add("video_join", f"WITH {_VD} SELECT v.video_id, m.channel_title, v.duration_seconds FROM v LEFT JOIN (SELECT DISTINCT channel_id, channel_title FROM channel_metadata) m USING (channel_id)")
def video_join(spark, d):
    return vids(spark, d).join(channels(spark, d).select("channel_id", "channel_title"), "channel_id", "left").select("video_id", "channel_title", "duration_seconds")


@add("details_merge", f"WITH {_VD}, p AS (SELECT channel_id, any_value(privacy_status) AS ps FROM channel_metadata GROUP BY 1) SELECT v.video_id, coalesce(v.privacy_status, p.ps, 'public') AS privacy FROM v LEFT JOIN p USING (channel_id)")
def details_merge(spark, d):
    m = channels(spark, d).select("channel_id", F.col("privacy_status").alias("ps"))
    return vids(spark, d).join(m, "channel_id", "left").select("video_id", F.coalesce("privacy_status", "ps", F.lit("public")).alias("privacy"))


@add("new_videos", "SELECT DISTINCT video_id FROM videos ANTI JOIN case_c_video2 USING (video_id)")
def new_videos(spark, d):
    return vids(spark, d).join(table(spark, d, "case_c_video2").select("video_id"), "video_id", "left_anti").select("video_id")


@add("status_join", f"WITH {_VD} SELECT v.video_id, m.channel_title, count(c.segment_id) AS n FROM v JOIN channel_metadata m USING (channel_id) JOIN case_c_video2 c USING (video_id) GROUP BY 1,2")
def status_join(spark, d):
    n = table(spark, d, "case_c_video2").groupBy("video_id").agg(F.count("segment_id").alias("n"))
    return vids(spark, d).join(channels(spark, d).select("channel_id", "channel_title"), "channel_id").join(n, "video_id").select("video_id", "channel_title", "n")


@add("alias_semi", f"WITH {_VD} SELECT video_id FROM v WHERE channel_id IN (SELECT channel_id FROM channel_metadata WHERE contains(channel_title,'강의저장소'))")
def alias_semi(spark, d):
    some = channels(spark, d).where(F.contains("channel_title", F.lit("강의저장소"))).select("channel_id")
    return vids(spark, d).join(some, "channel_id", "left_semi").select("video_id")


@add("registry_union", "SELECT coalesce(a.channel_id,b.channel_id) AS channel_id, a.channel_id IS NOT NULL AS registered, b.channel_id IS NOT NULL AS used FROM (SELECT DISTINCT channel_id FROM channel_metadata) a FULL JOIN (SELECT DISTINCT channel_id FROM documents WHERE channel_id IS NOT NULL) b ON a.channel_id=b.channel_id")
def registry_union(spark, d):
    a = channels(spark, d).select("channel_id").withColumn("a", F.lit(True))
    b = docs(spark, d).where("channel_id is not null").select("channel_id").distinct().withColumn("b", F.lit(True))
    return a.join(b, "channel_id", "full_outer").select("channel_id", F.col("a").isNotNull().alias("registered"), F.col("b").isNotNull().alias("used"))


# merges: orders as a table of states, split into an old and a new part ------------------------------------------------


def _orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


_NEW = "n AS (SELECT o_orderkey, o_custkey+1 AS o_custkey, 'N' AS o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 0), o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0)"


def _new(spark, d) -> DataFrame:
    return _orders(spark, d).where("o_orderkey % 2 = 0").withColumns({"o_custkey": F.col("o_custkey") + 1, "o_orderstatus": F.lit("N"), "o_orderpriority": F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))})


@add("merge_status", f"WITH {_NEW} SELECT coalesce(n.o_orderkey,o.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_custkey ELSE o.o_custkey END AS o_custkey, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_totalprice ELSE o.o_totalprice END AS o_totalprice, coalesce(n.o_orderpriority,o.o_orderpriority) AS o_orderpriority FROM o FULL JOIN n ON n.o_orderkey=o.o_orderkey")
def merge_status(spark, d):
    return merge(_orders(spark, d).where("o_orderkey % 3 <> 0"), _new(spark, d), ["o_orderkey"], ["o_orderpriority"])


@add("merge_latest", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1")
def merge_latest(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return latest(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("last_order"))


@add("retry_merge", f"WITH {_NEW} SELECT coalesce(n.o_orderkey,o.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 1 WHEN n.o_orderkey IS NULL THEN 1 ELSE 2 END AS attempts FROM o FULL JOIN n ON n.o_orderkey=o.o_orderkey")
def retry_merge(spark, d):
    old = _orders(spark, d).where("o_orderkey % 3 <> 0").select("o_orderkey", F.lit(1).alias("k"))
    new = _new(spark, d).select("o_orderkey", F.lit(1).alias("k"))
    return old.unionByName(new).groupBy("o_orderkey").agg(F.sum("k").cast("int").alias("attempts"))


@add("retry_first", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus='F') DESC, o_orderkey) AS place FROM orders")
def retry_first(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc(F.col("o_orderstatus") == "F"), "o_orderkey")
    return _orders(spark, d).select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@add("manifest_recovery", f"WITH {_NEW} SELECT o_orderkey, o_orderstatus FROM o UNION ALL SELECT o_orderkey, o_orderstatus FROM n ANTI JOIN (SELECT o_orderkey FROM o) k USING (o_orderkey)")
def manifest_recovery(spark, d):
    old = _orders(spark, d).where("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus")
    return old.unionByName(_new(spark, d).select("o_orderkey", "o_orderstatus").join(old.select("o_orderkey"), "o_orderkey", "left_anti"))


@add("retry_targets", "SELECT o_orderkey, CASE WHEN l.n < 4 AND o_orderstatus <> 'P' THEN 'retry' ELSE 'overflow' END AS kind FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey=o_orderkey")
def retry_targets(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return _orders(spark, d).join(n, "o_orderkey").select("o_orderkey", F.when((F.col("n") < 4) & (F.col("o_orderstatus") != "P"), "retry").otherwise("overflow").alias("kind"))


@add("resolve_successes", "SELECT o_orderkey FROM orders ANTI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag='R') r USING (o_orderkey)")
def resolve_successes(spark, d):
    return _orders(spark, d).select("o_orderkey").join(table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@add("append_only", f"WITH {_NEW} SELECT count(*) AS n, sum(o_custkey)::BIGINT AS s FROM (SELECT o_custkey FROM o UNION ALL SELECT o_custkey FROM n)")
def append_only(spark, d):
    return _orders(spark, d).where("o_orderkey % 3 <> 0").unionByName(_new(spark, d)).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("s"))


@add("union_append", "SELECT video_id FROM sample_titles UNION ALL SELECT video_id FROM videos")
def union_append(spark, d):
    return table(spark, d, "sample_titles").select("video_id").unionByName(table(spark, d, "videos").select("video_id"))


@add("union_distinct", "SELECT video_id FROM sample_titles UNION SELECT video_id FROM case_c_video2")
def union_distinct(spark, d):
    return table(spark, d, "sample_titles").select("video_id").unionByName(table(spark, d, "case_c_video2").select("video_id").distinct()).distinct()


@add("constraint_violations", "SELECT segment_id AS key, 'end_after_start' AS \"check\" FROM case_c_video2 WHERE \"end\" <= start UNION ALL SELECT segment_id, 'text_present' FROM case_c_video2 WHERE text IS NULL OR text = ''")
def constraint_violations(spark, d):
    checks = [("end_after_start", F.col("end") > F.col("start")), ("text_present", F.coalesce(F.col("text") != "", F.lit(False)))]
    return violations(table(spark, d, "case_c_video2"), "segment_id", checks)


@add("form_validation", "SELECT id, CASE WHEN professor IS NULL THEN 'professor_missing' WHEN length(professor) > 12 THEN 'professor_too_long' WHEN year_from > year_to THEN 'period_order' ELSE 'ok' END AS result FROM comparison_results")
def form_validation(spark, d):
    first = F.coalesce(F.when(F.col("professor").isNull(), "professor_missing"), F.when(F.length("professor") > 12, "professor_too_long"), F.when(F.col("year_from") > F.col("year_to"), "period_order"), F.lit("ok"))
    return table(spark, d, "comparison_results").select("id", first.alias("result"))


# texts ---------------------------------------------------------------------------------------------------------------


def title_words(spark, d) -> DataFrame:
    """The different pairs of videos that are compared, with the words of both titles."""
    v = unique_videos(table(spark, d, "videos")).where("title is not null").select("video_id", F.array_distinct(T.words(F.col("title"))).alias("w"))
    rows = table(spark, d, "comparison_results").select("source_video_id", "target_video_id").distinct()
    return rows.join(v.withColumnsRenamed({"video_id": "source_video_id", "w": "s"}), "source_video_id").join(v.withColumnsRenamed({"video_id": "target_video_id", "w": "t"}), "target_video_id")


def _per_row(spark, d, value) -> DataFrame:
    """A value of each pair of videos for every row that compares the two: computed once per pair, however often it is compared."""
    key = ["source_video_id", "target_video_id"]
    return table(spark, d, "comparison_results").select("id", *key).join(title_words(spark, d).select(*key, value), key).drop(*key)


@add("change_rate", f"WITH {_TITLES} SELECT id, round(CASE WHEN len(list_distinct(s||t))=0 THEN 0 ELSE (2.0e0*len(list_distinct(s||t))-len(s)-len(t))/len(list_distinct(s||t)) END,6) AS rate FROM p")
def change_rate(spark, d):
    return _per_row(spark, d, F.round(T.change_rate(F.col("s"), F.col("t")), 6).alias("rate"))


@add("new_terms", f"WITH {_TITLES} SELECT id, (len(list_distinct(s||t))-len(s))::BIGINT AS n FROM p")
def new_terms(spark, d):
    return _per_row(spark, d, T.new_terms(F.col("s"), F.col("t")).alias("n"))


#: Words in more documents than this share meet their weight by a broadcast; as every document has a bounded number of words,
#: they are few: at most the mean number of different words of a document over the share.
COMMON = 0.01


@add("idf_filter", f"WITH {_WORDS}, n AS (SELECT count(*) AS n FROM documents), f AS (SELECT t, ln((SELECT n FROM n)*1.0e0/count(DISTINCT doc_id)) AS idf FROM w GROUP BY 1) SELECT doc_id, round(avg(idf),5) AS mean_idf FROM w JOIN f USING (t) GROUP BY 1 HAVING round(avg(idf),5) >= 3.0")
def idf_filter(spark, d):
    """Documents whose mean inverse document frequency, weighted by occurrence, is at least 3."""
    n = docs(spark, d).count()
    words = docs(spark, d).where("text is not null").select("doc_id", F.explode(T.words(F.col("text"))).alias("t")).groupBy("doc_id", "t").agg(F.count("*").alias("k"))
    idf = words.groupBy("t").agg(F.count("*").alias("df")).select("t", "df", F.log(F.lit(float(n)) / F.col("df")).alias("idf"))
    common = idf.where(F.col("df") > COMMON * n).select("t", "idf")
    small = common.count() <= 1_000_000
    # a common word would put a row of each document on one key: those words are looked up where the rows are, the others meet by shuffle
    marked = words.join(F.broadcast(common) if small else common, "t", "left")
    rare = marked.where("idf is null").drop("idf").join(idf.where(F.col("df") <= COMMON * n).select("t", "idf"), "t")
    by = marked.where("idf is not null").select("doc_id", "k", "idf").unionByName(rare.select("doc_id", "k", "idf")).groupBy("doc_id")
    return by.agg(F.round(F.sum(F.col("idf") * F.col("k")) / F.sum("k"), 5).alias("mean_idf")).where("mean_idf >= 3.0")


@add("normalize_phrase", f"SELECT doc_id, sha256({I.phrase_sql('text')}) AS hash FROM documents")
def normalize_phrase(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(T.phrase(F.col("text")), 256).alias("hash"))


@add("html_body", "SELECT doc_id, sha256('<p class=\"a\" hidden>' || translate(text,'<>&','') || '<br></p>') AS hash FROM documents WHERE text IS NOT NULL")
def html_body(spark, d):
    """The body of pages made of the texts, with a head, attributes in two kinds of quotes, comments and tags in capitals."""
    page = F.concat(F.lit("<html><head><title>t</title></head>\n<BODY class='x'><!-- c --><P class='a' hidden>"), F.translate("text", "<>&", ""), F.lit("<br></P></Body></html>"))
    return docs(spark, d).where("text is not null").select("doc_id", F.sha2(T.html_body(page), 256).alias("hash"))


@add("batch_keys", "SELECT channel_id, batch, sha256('[' || string_agg('[' || doc_id || ',' || coalesce(n_chars::VARCHAR,'null') || ']', ',' ORDER BY doc_id) || ']') AS key FROM (SELECT *, (row_number() OVER (PARTITION BY channel_id, source ORDER BY doc_id)-1)//20 AS batch FROM documents WHERE source = 'viewer_comment') GROUP BY 1,2")
def batch_keys(spark, d):
    """Cache keys of batches of twenty comments: the hash of their canonical JSON."""
    rn = F.row_number().over(Window.partitionBy("channel_id", "source").orderBy("doc_id"))
    rows = docs(spark, d).where("source = 'viewer_comment'").select("channel_id", "doc_id", "n_chars", "source").withColumn("batch", F.floor((rn - 1) / 20))
    one = F.concat(F.lit("["), F.concat_ws(",", F.col("doc_id").cast("string"), F.coalesce(F.col("n_chars").cast("string"), F.lit("null"))), F.lit("]"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", one.alias("j")))), lambda x: x["j"])
    return rows.groupBy("channel_id", "batch").agg(F.sha2(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")), 256).alias("key"))


# comments: documents with their source as topic, a model's label by their length, questions by their mark --------------------

_LABELS = {"긍정": "positive", "부정": "negative", "중립": "neutral", "LABEL_0": "negative", "LABEL_1": "neutral", "LABEL_2": "positive", "POSITIVE": "positive", "NEGATIVE": "negative", "NEUTRAL": "neutral", "positive": "positive", "negative": "negative", "neutral": "neutral"}
_RAW = list(_LABELS) + ["other"]
_RAW_SQL = f"[{','.join(map(I.quoted, _RAW))}][1 + n_chars % {len(_RAW)}]"
_MAP_SQL = "CASE " + _RAW_SQL + " " + " ".join(f"WHEN {I.quoted(a)} THEN '{b}'" for a, b in _LABELS.items()) + " ELSE 'neutral' END"


def comments(spark, d) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in _RAW]), (F.col("n_chars") % len(_RAW) + 1).cast("int"))
    flag = F.coalesce(F.contains("text", F.lit("?")), F.lit(False))
    return docs(spark, d).select("doc_id", "video_id", "source", "text", T.mapped(raw, _LABELS, "neutral").alias("sentiment"), flag.alias("is_question"))


@add("label_map", f"SELECT doc_id, {_MAP_SQL} AS label FROM documents")
def label_map(spark, d):
    return comments(spark, d).select("doc_id", F.col("sentiment").alias("label"))


_TOPICS = f"tp AS (SELECT video_id, source, count(*) AS n, round(count(*) FILTER (WHERE s='positive')*1.0e0/count(*),4) AS positive, round(count(*) FILTER (WHERE s='neutral')*1.0e0/count(*),4) AS neutral, round(count(*) FILTER (WHERE s='negative')*1.0e0/count(*),4) AS negative, array_to_string((list(doc_id ORDER BY doc_id))[1:3],'|') AS representatives FROM (SELECT *, {_MAP_SQL} AS s FROM documents WHERE video_id IS NOT NULL AND source IS NOT NULL) GROUP BY 1,2)"


def topics(spark, d) -> DataFrame:
    """Clusters of a video's comments by topic: size, shares of sentiments, and the first three as representatives."""
    rows = comments(spark, d).where("video_id is not null and source is not null").select("video_id", "source", "doc_id", "sentiment")
    share = [F.round(F.count_if(F.col("sentiment") == x) / F.count("*"), 4).alias(x) for x in ("positive", "neutral", "negative")]
    by = rows.groupBy("video_id", "source").agg(F.count("*").alias("n"), *share)
    w = Window.partitionBy("video_id", "source").orderBy("doc_id")
    first = rows.withColumn("rn", F.row_number().over(w)).where("rn <= 3").groupBy("video_id", "source").agg(F.concat_ws("|", F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string"))).alias("representatives"))
    return by.join(first, ["video_id", "source"])


@add("topic_clusters", f"WITH {_TOPICS} SELECT video_id, source AS topic, n, positive, neutral, negative, representatives FROM tp")
def topic_clusters(spark, d):
    return topics(spark, d).withColumnRenamed("source", "topic")


@add("question_hotspots", f"WITH {I.RETENTION}, bh AS (SELECT video_id, arg_min(elapsed_ratio, (-audience_watch_ratio, elapsed_ratio)) AS spot, max(audience_watch_ratio) AS r FROM hot GROUP BY 1) SELECT doc_id, video_id, round(greatest(0.0e0,spot-0.05e0),6) AS hotspot_start, round(least(1.0e0,spot+0.05e0),6) AS hotspot_end, round(least(1.0e0,r/2.0e0),6) AS relevance FROM documents JOIN bh USING (video_id) WHERE contains(text,'?') AND text <> ''")
def question_hotspots(spark, d):
    """Every question with a window of 0.05 around its video's highest hotspot, the earliest of several."""
    best = I.hotspots(I.retention(spark, d)).groupBy("video_id").agg(F.min_by("elapsed_ratio", F.struct(-F.col("audience_watch_ratio"), "elapsed_ratio")).alias("at"), F.max("audience_watch_ratio").alias("r"))
    q = comments(spark, d).where("is_question and text <> ''").select("doc_id", "video_id").join(best, "video_id")
    return q.select("doc_id", "video_id", F.round(F.greatest(F.lit(0.0), F.col("at") - 0.05), 6).alias("hotspot_start"), F.round(F.least(F.lit(1.0), F.col("at") + 0.05), 6).alias("hotspot_end"), F.round(F.least(F.lit(1.0), F.col("r") / 2.0), 6).alias("relevance"))


@add("hotspot_questions", f"WITH {I.RETENTION}, q AS (SELECT video_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)),'|') AS topics FROM documents WHERE contains(text,'?') AND video_id IS NOT NULL GROUP BY 1 HAVING count(source) > 0), m AS (SELECT video_id, greatest(1.0e0,max(audience_watch_ratio)) AS m FROM hot GROUP BY 1) SELECT video_id, elapsed_ratio, round(audience_watch_ratio,6) AS audience_watch_ratio, topics, n AS questions, round(least(1.0e0,audience_watch_ratio/m),4) AS relevance FROM hot JOIN q USING (video_id) JOIN m USING (video_id)")
def hotspot_questions(spark, d):
    """Every hotspot with all topics that its video's questions are about, and its height against the highest one."""
    hot = I.hotspots(I.retention(spark, d)).select("video_id", "elapsed_ratio", "audience_watch_ratio")
    q = comments(spark, d).where("is_question and video_id is not null").groupBy("video_id").agg(F.count("*").alias("questions"), F.concat_ws("|", F.sort_array(F.collect_set("source"))).alias("topics"), F.count("source").alias("k")).where("k > 0").drop("k")
    m = hot.groupBy("video_id").agg(F.greatest(F.lit(1.0), F.max("audience_watch_ratio")).alias("m"))
    rows = hot.join(q, "video_id").join(m, "video_id")
    return rows.select("video_id", "elapsed_ratio", F.round("audience_watch_ratio", 6).alias("audience_watch_ratio"), "topics", "questions", F.round(F.least(F.lit(1.0), F.col("audience_watch_ratio") / F.col("m")), 4).alias("relevance"))


@add("comment_report", f"WITH {_TOPICS}, {I.RETENTION} SELECT v.video_id, coalesce(t.total,0)::BIGINT AS total_comments, coalesce(t.topics,0) AS topics, coalesce(q.n,0) AS questions, coalesce(h.n,0) AS hotspots FROM (SELECT DISTINCT video_id FROM videos) v LEFT JOIN (SELECT video_id, sum(n) AS total, count(*) AS topics FROM tp GROUP BY 1) t USING (video_id) LEFT JOIN (SELECT video_id, count(*) AS n FROM documents WHERE contains(text,'?') GROUP BY 1) q USING (video_id) LEFT JOIN (SELECT video_id, count(*) AS n FROM hot GROUP BY 1) h USING (video_id)")
def comment_report(spark, d):
    """Totals of a video's comments, topics, questions and hotspots."""
    c = comments(spark, d).where("video_id is not null")
    t = c.where("source is not null").groupBy("video_id").agg(F.count("*").alias("total_comments"), F.countDistinct("source").alias("topics"))
    q = c.where("is_question").groupBy("video_id").agg(F.count("*").alias("questions"))
    h = I.hotspots(I.retention(spark, d)).groupBy("video_id").agg(F.count("*").alias("hotspots"))
    v = I.videos(spark, d).select("video_id").join(t, "video_id", "left").join(q, "video_id", "left").join(h, "video_id", "left")
    return v.na.fill(0, ["total_comments", "topics", "questions", "hotspots"])


@add("bundle_files", "WITH pg AS (SELECT video_id, min_by(text, doc_id) AS body FROM documents WHERE video_id IS NOT NULL AND text IS NOT NULL GROUP BY 1) SELECT channel_id, count(body) AS bundled, count(*) - count(body) AS skipped, array_to_string(list_sort(list(video_id) FILTER (WHERE body IS NULL)),'|') AS skipped_ids FROM (SELECT DISTINCT video_id, channel_id FROM videos) v LEFT JOIN (SELECT video_id, nullif(translate(body,'<>&',''),'') AS body FROM pg) USING (video_id) GROUP BY 1")
def bundle_files(spark, d):
    """A bundle from the pages that there are: videos without a page, or with one without a body, are skipped and listed."""
    page = F.concat(F.lit("<html><body>"), F.translate("text", "<>&", ""), F.lit("</body></html>"))
    pages = docs(spark, d).where("video_id is not null and text is not null").groupBy("video_id").agg(F.min_by(page, "doc_id").alias("page"))
    rows = I.videos(spark, d).select("video_id", "channel_id").join(pages, "video_id", "left").withColumn("body", F.nullif(T.html_body("page"), F.lit("")))
    none = F.when(F.col("body").isNull(), F.col("video_id"))
    return rows.groupBy("channel_id").agg(F.count("body").alias("bundled"), F.count_if(F.col("body").isNull()).alias("skipped"), F.concat_ws("|", F.sort_array(F.collect_list(none))).alias("skipped_ids")).withColumn("skipped_ids", F.nullif("skipped_ids", F.lit("")))


# scores on five axes -------------------------------------------------------------------------------------------------


@add("eqs_overall", f"WITH {I.EQS} SELECT detail_id, round(({'+'.join(I.AXES)})/5.0e0,6) AS overall FROM ax")
def eqs_overall(spark, d):
    return I.axes(spark, d).select("detail_id", F.round(sum((F.col(a) for a in I.AXES), F.lit(0.0)) / 5.0, 6).alias("overall"))


@add("eqs_join", f"WITH {I.EQS}, {I.FACTS} SELECT p.video_id, detail_id, concat_ws(',', {', '.join(f"CASE WHEN {a} < 0.6 THEN '{a}' END" for a in I.AXES)}) AS weak FROM p JOIN ax ON ax.professor_name = p.professor")
def eqs_join(spark, d):
    weak = F.concat_ws(",", *[F.when(F.col(a) < 0.6, a) for a in I.AXES])
    p = I.axes(spark, d).select(F.col("professor_name").alias("professor"), "detail_id", weak.alias("weak"))
    return I.facts(spark, d).select("video_id", "professor").join(F.broadcast(p), "professor").select("video_id", "detail_id", "weak")  # a register of fixed size


# files beside the videos ---------------------------------------------------------------------------------------------


@add("plausible_size", f"WITH {I.FACTS}, {I.FILES} SELECT file_id FROM fl WHERE fd > 0 AND bytes/fd BETWEEN 0.5e6 AND 10e6")
def plausible_size(spark, d):
    return I.files(spark, d).where(S.plausible(F.col("bytes"), F.col("fd"))).select("file_id")


_MAPPING = f"""{I.FACTS}, {I.FILES}, fk AS (SELECT *, regexp_replace(file,'\\.[^.]+$','') AS stem FROM fl), f2 AS (SELECT *, {I.key_sql("stem")} AS a FROM fk), t2 AS (SELECT video_id, title, us, duration_seconds AS td, {I.key_sql("title")} AS b FROM v WHERE title <> ''),
sc AS (SELECT file_id, video_id, CASE WHEN stem = title THEN 40 ELSE 30 END + CASE WHEN coalesce(abs(fd-td) <= 1,false) THEN 25 ELSE 0 END + CASE WHEN coalesce(td > 0 AND bytes/td BETWEEN 0.5e6 AND 10e6,false) THEN 5 ELSE 0 END + CASE WHEN abs(file_us-us) <= 86400000000 THEN 5 ELSE 0 END AS score FROM f2 JOIN t2 ON a = b OR (length(a) >= 50 AND starts_with(b,a))),
g AS (SELECT file_id, max(score) AS score, count(*) FILTER (WHERE k=1) AS ties, min(video_id) FILTER (WHERE k=1) AS video_id FROM (SELECT *, rank() OVER (PARTITION BY file_id ORDER BY score DESC) AS k FROM sc) GROUP BY 1),
dc AS (SELECT fl.file_id, score, CASE WHEN coalesce(score,0) < 40 THEN 'none' WHEN ties > 1 THEN 'ambiguous' WHEN score >= 65 THEN 'high' ELSE 'medium' END AS decision, CASE WHEN score >= 40 AND ties = 1 THEN g.video_id END AS video_id FROM fl LEFT JOIN g USING (file_id))"""


def decisions(spark, d) -> DataFrame:
    """file_id, score, decision, video_id: the video that each file is taken for.

    A decision needs 40 points, and duration, size and time give 35 at most: only files and videos whose titles match, or
    begin alike where the file's name was cut, have to meet; they do so on the first fifty characters of their keys.
    """
    f = I.files(spark, d).withColumn("stem", titles_op.stem(F.col("file"))).withColumn("a", titles_op.match_key(F.col("stem")))
    t = I.videos(spark, d).where("title <> ''").select("video_id", "title", F.unix_micros("published_at").alias("us"), F.col("duration_seconds").alias("td"), titles_op.match_key(F.col("title")).alias("b"))
    j = f.withColumn("k", F.substring("a", 1, 50)).join(t.withColumn("k", F.substring("b", 1, 50)), "k").where(titles_op.keys_match(F.col("a"), F.col("b")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    score = S.evidence(F.col("stem") == F.col("title"), F.lit(True), yes(F.abs(F.col("fd") - F.col("td")) <= 1), yes(S.plausible(F.col("bytes"), F.col("td"))), yes(F.abs(F.col("file_us") - F.col("us")) <= 86400000000))
    by = j.withColumn("score", score).groupBy("file_id", "score").agg(F.count("*").alias("ties"), F.min("video_id").alias("video_id"))
    best = by.groupBy("file_id").agg(F.max(F.struct("score", "ties", "video_id")).alias("x")).select("file_id", "x.*")
    best = f.select("file_id").join(best, "file_id", "left")
    decision = F.when(F.coalesce("score", F.lit(0)) < 40, "none").when(F.col("ties") > 1, "ambiguous").when(F.col("score") >= 65, "high").otherwise("medium")
    return best.select("file_id", "score", decision.alias("decision"), F.when((F.col("score") >= 40) & (F.col("ties") == 1), F.col("video_id")).alias("video_id"))


@add("evidence_mapping", f"WITH {_MAPPING} SELECT file_id, score, decision, video_id FROM dc")
def evidence_mapping(spark, d):
    return decisions(spark, d)


@add("mapping_counts", f"WITH {_MAPPING} SELECT decision, count(*) AS files, count(DISTINCT video_id) AS videos FROM dc GROUP BY 1 UNION ALL SELECT 'absent', 0, count(*) FROM (SELECT video_id FROM v ANTI JOIN (SELECT video_id FROM dc WHERE video_id IS NOT NULL) k USING (video_id))")
def mapping_counts(spark, d):
    """Files and videos by decision, and the videos that no file is taken for."""
    rows = decisions(spark, d)
    by = rows.groupBy("decision").agg(F.count("*").alias("files"), F.countDistinct("video_id").alias("videos"))
    absent = I.videos(spark, d).join(rows.where("video_id is not null").select("video_id"), "video_id", "left_anti").agg(F.lit("absent").alias("decision"), F.lit(0).cast("long").alias("files"), F.count("*").alias("videos"))
    return by.unionByName(absent)


# governance: professors and their channels -------------------------------------------------------------------------------


_MEMBERS = "mb AS (SELECT detail_id::VARCHAR AS professor_id, unnest(courses) AS alias FROM professor_detail WHERE detail_id % 3 <> 0), own AS (SELECT alias, min(professor_id) AS owner FROM mb GROUP BY 1), rq AS (SELECT DISTINCT detail_id::VARCHAR AS professor_id, unnest(courses) AS alias FROM professor_detail WHERE detail_id % 2 = 0), fr AS (SELECT alias, min(professor_id) AS first FROM rq GROUP BY 1)"


def _members(spark, d, where: str) -> DataFrame:
    return table(spark, d, "professor_detail").where(where).select(F.col("detail_id").cast("string").alias("professor_id"), F.explode("courses").alias("alias"))


@add("professor_list", f"WITH {_MEMBERS} SELECT professor_id, alias, professor_name, video_count, row_number() OVER (PARTITION BY professor_id ORDER BY alias) AS place FROM mb JOIN (SELECT detail_id::VARCHAR AS professor_id, professor_name, video_count FROM professor_detail) USING (professor_id)")
def professor_list(spark, d):
    """Memberships with the pool's row of each professor, in the order of professor and channel."""
    pool = table(spark, d, "professor_detail").select(F.col("detail_id").cast("string").alias("professor_id"), "professor_name", "video_count")
    place = F.row_number().over(Window.partitionBy("professor_id").orderBy("alias")).cast("long")
    return _members(spark, d, "detail_id % 3 <> 0").join(pool, "professor_id").select("professor_id", "alias", "professor_name", "video_count", place.alias("place"))


@add("governance_merge", f"WITH {_MEMBERS} SELECT professor_id, alias, CASE WHEN owner = professor_id THEN 'there' WHEN owner IS NOT NULL OR first <> professor_id THEN 'conflict' ELSE 'added' END AS state FROM rq LEFT JOIN own USING (alias) JOIN fr USING (alias)")
def governance_merge(spark, d):
    """Channels asked for by professors: added, there already, or owned by another."""
    return G.map_professors(_members(spark, d, "detail_id % 3 <> 0"), _members(spark, d, "detail_id % 2 = 0"))


@add("professor_unmap", f"WITH {_MEMBERS} SELECT professor_id, alias FROM mb ANTI JOIN rq USING (professor_id, alias)")
def professor_unmap(spark, d):
    return G.remove(_members(spark, d, "detail_id % 3 <> 0"), _members(spark, d, "detail_id % 2 = 0"), ["professor_id", "alias"])


@add("owner_uniqueness", "SELECT alias, count(DISTINCT professor_id) AS owners FROM (SELECT detail_id::VARCHAR AS professor_id, unnest(courses) AS alias FROM professor_detail WHERE detail_id % 3 <> 0) GROUP BY 1 HAVING count(DISTINCT professor_id) > 1")
def owner_uniqueness(spark, d):
    return _members(spark, d, "detail_id % 3 <> 0").groupBy("alias").agg(F.countDistinct("professor_id").alias("owners")).where("owners > 1")


@add("caption_gate", "SELECT m.channel_id, count(c.video_id) AS videos, CASE WHEN count(c.video_id) = 0 THEN 'empty' ELSE 'ok' END AS state FROM (SELECT DISTINCT channel_id FROM channel_metadata) m LEFT JOIN (SELECT DISTINCT video_id, channel_id FROM videos SEMI JOIN (SELECT video_id FROM case_c_video2 WHERE text <> '') k USING (video_id)) c USING (channel_id) GROUP BY 1")
def caption_gate(spark, d):
    """Channels whose pool of captions is empty can't be compared."""
    have = I.videos(spark, d).select("video_id", "channel_id").join(table(spark, d, "case_c_video2").where("text <> ''").select("video_id"), "video_id", "left_semi")
    rows = channels(spark, d).select("channel_id").join(have, "channel_id", "left").groupBy("channel_id").agg(F.count("video_id").alias("videos"))
    return rows.select("channel_id", "videos", F.when(F.col("videos") == 0, "empty").otherwise("ok").alias("state"))


@add("transcript_paths", "SELECT DISTINCT v.video_id, regexp_replace(trim(m.channel_title),'\\s+','_','g') || '/transcripts/' || v.video_id || '.json' AS path FROM videos v JOIN channel_metadata m USING (channel_id) WHERE m.channel_title <> ''")
def transcript_paths(spark, d):
    """Where a video's transcript lies: in the folder of its channel's alias; without an alias nowhere."""
    m = channels(spark, d).where("channel_title <> ''").select("channel_id", "channel_title")
    path = F.concat(F.regexp_replace(F.trim("channel_title"), r"\s+", "_"), F.lit("/transcripts/"), "video_id", F.lit(".json"))
    return I.videos(spark, d).select("video_id", "channel_id").join(m, "channel_id").select("video_id", path.alias("path"))


# merges --------------------------------------------------------------------------------------------------------------


@add("quality_upsert", f"WITH {_NEW} SELECT coalesce(n.o_orderkey,o.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_custkey ELSE o.o_custkey END AS o_custkey, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_orderpriority ELSE o.o_orderpriority END AS o_orderpriority FROM o FULL JOIN n ON n.o_orderkey=o.o_orderkey")
def quality_upsert(spark, d):
    """Full overwrite: a new row replaces all columns, nulls too."""
    cols = ["o_orderkey", "o_custkey", "o_orderpriority"]
    return merge(_orders(spark, d).where("o_orderkey % 3 <> 0").select(*cols), _new(spark, d).select(*cols), ["o_orderkey"])


@add("spans_replace", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 2 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1,2) UNION ALL SELECT l_orderkey, l_linenumber, max(l_quantity) + 1 FROM lineitem WHERE l_linenumber = 1 GROUP BY 1,2")
def spans_replace(spark, d):
    """Insert or replace by (comparison, span): lines of orders stand for spans, of which the first two are written anew."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    new = rows.where("l_linenumber <= 2").withColumn("l_quantity", F.col("l_quantity") + 1)
    return merge(rows.where("l_linenumber <> 1"), new, ["l_orderkey", "l_linenumber"])


@add("aborted_upsert", "WITH m AS (SELECT o_orderkey AS k, o_orderstatus AS stage, 1 AS n FROM orders WHERE o_orderkey % 3 = 0), a AS (SELECT o_orderkey AS k, o_orderstatus AS stage FROM orders WHERE o_orderkey % 2 = 0) SELECT coalesce(m.k,a.k) AS k, coalesce(m.stage,a.stage) AS stage, CASE WHEN a.k IS NULL THEN 'failed' ELSE 'aborted_by_user' END AS reason, coalesce(n,0) + CASE WHEN a.k IS NULL THEN 0 ELSE 1 END AS attempts FROM m FULL JOIN a ON a.k=m.k AND a.stage=m.stage")
def aborted_upsert(spark, d):
    """Entries of a retry manifest for what the user broke off: one attempt more where there is one, else a new one."""
    rows = _orders(spark, d).select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("stage"))
    old = rows.where("k % 3 = 0").select("*", F.lit("failed").alias("reason"), F.lit(1).alias("attempts"))
    gone = rows.where("k % 2 = 0").select("*", F.lit("aborted_by_user").alias("reason"), F.lit(1).alias("attempts"))
    last = F.max_by("reason", F.col("reason") == "aborted_by_user").alias("reason")
    return old.unionByName(gone).groupBy("k", "stage").agg(last, F.sum("attempts").cast("int").alias("attempts"))


@add("audio_alignment", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor((x::DOUBLE+1.0e0)*1000000000.0e0)::BIGINT) AS v FROM embeddings), n AS (SELECT vec_id, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM e), o AS (SELECT vec_id, CASE WHEN k >= 0 THEN v[k+1:] ELSE v END AS x, CASE WHEN k >= 0 THEN w ELSE w[1-k:] END AS y FROM n, (SELECT unnest(generate_series(-400,400,4)) AS k) WHERE w IS NOT NULL)
SELECT vec_id AS id, min(list_avg(list_transform(list_zip(x[1:least(len(x),len(y))],y[1:least(len(x),len(y))]), lambda p: bit_count(xor(p[1],p[2]))))) AS hamming FROM o WHERE least(len(x),len(y)) >= 16 GROUP BY 1""")
def audio_alignment(spark, d):
    after = F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    rows = table(spark, d, "embeddings").withColumn("w", after).where("w is not null")
    return V.alignments(rows.select(F.col("vec_id").alias("id"), _bits(F.col("embedding")).alias("a"), _bits(F.col("w")).alias("b")))
