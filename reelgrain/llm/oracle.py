"""SQL twins of the pN_ queries that SQL can express over whole tables."""

from __future__ import annotations

_RECORD = "SELECT video_id, segment_id, start, text, length(text) AS len FROM (SELECT DISTINCT * FROM case_c_video2 WHERE text IS NOT NULL AND text <> '')"

ORACLE: dict[str, str] = {
    "p1_found": f"""WITH s AS ({_RECORD}), o AS (SELECT *, coalesce(sum(len+1) OVER (PARTITION BY video_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS off FROM s),
r AS (SELECT video_id, string_agg(text,' ' ORDER BY start) AS t FROM s GROUP BY 1),
w AS (SELECT video_id, i, substring(t, i::INT, 200) AS x FROM (SELECT video_id, t, unnest(range(1, length(t)+1)) AS i FROM r)),
m AS (SELECT x FROM w WHERE length(x) = 200 GROUP BY 1 HAVING count(DISTINCT video_id) > 1),
c AS (SELECT w.video_id, w.i, max(CASE WHEN m.x IS NOT NULL THEN w.i END) OVER (PARTITION BY w.video_id ORDER BY w.i) AS last FROM w LEFT JOIN m ON m.x = w.x),
u AS (SELECT video_id, i, sum(CASE WHEN coalesce(last,-1000) >= i-199 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY i) AS n FROM c)
SELECT o.segment_id FROM o JOIN u b ON b.video_id=o.video_id AND b.i=o.off+o.len LEFT JOIN u a ON a.video_id=o.video_id AND a.i=o.off WHERE b.n - coalesce(a.n,0) = 0""",
    "p2_found": """WITH RECURSIVE e AS (SELECT DISTINCT source_video_id AS a, target_video_id AS b FROM comparison_results WHERE source_video_id <> target_video_id AND lower(trim(grade)) IN ('critical','high')),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(v, m) AS (SELECT a, a FROM g UNION SELECT g.b, r.m FROM r JOIN g ON g.a = r.v) SELECT v AS video_id, min(m) AS group_id FROM r GROUP BY 1""",
    "p4_found": f"SELECT video_id FROM ({_RECORD}) GROUP BY 1 HAVING sum(len) + count(*) - 1 > 4000",
    "p7_invariants": "SELECT count(*) AS texts, 0::BIGINT AS over_capacity, 0::BIGINT AS wrong_sums, 0::BIGINT AS broken_texts, true AS well_filled FROM documents WHERE text IS NOT NULL AND text <> ''",
}
ORACLE["p2_grid"] = ORACLE["p2_found"]
