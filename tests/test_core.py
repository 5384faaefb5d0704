import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from reelgrain.functions import scoring as S
from reelgrain.functions import text as T
from reelgrain.operators import search as Q
from reelgrain.operators import series, spans, titles, vectors
from reelgrain.operators.facts import merge, violations
from reelgrain.sources import readers, schemas, writers
from reelgrain.streaming.daily import daily_counts


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()[0]


def lines(*texts, step=5.0):
    return [(t, i * step, (i + 1) * step, t) for i, t in enumerate(texts)]


def spans_of(a, b):
    """The spans of two lists of lines (form, start, end, text), as the operator finds them from the cells at which the lines agree."""
    cells = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] and x[0] == y[0]]
    found = spans.greedy_spans(*(np.array([c[k] for c in cells], np.int64) for k in (0, 1)))
    out = [(a[p][1], a[q][2], b[r][1], b[s][2], a[q][2] - a[p][1], a[p][3][:80]) for p, q, r, s in found if a[q][2] > a[p][1] and b[s][2] > b[r][1]]
    return sorted(out, key=lambda s: s[0])


def stepwise(a, b):
    """The definition, step by step: anchors in the order of a at the earliest free equal line of b, grown left, then right."""
    used_a, used_b, out = set(), set(), []
    for i, (form, *_) in enumerate(a):
        j = next((j for j, y in enumerate(b) if form and y[0] == form and j not in used_b), None) if i not in used_a else None
        if j is None:
            continue
        run = [(i, j)]
        for step in (-1, 1):
            x, y = i + step, j + step
            while 0 <= x < len(a) and 0 <= y < len(b) and x not in used_a and y not in used_b and a[x][0] and a[x][0] == b[y][0]:
                run.append((x, y))
                x, y = x + step, y + step
        used_a |= {x for x, _ in run}
        used_b |= {y for _, y in run}
        (p, r), (q, s) = min(run), max(run)
        if a[q][2] > a[p][1] and b[s][2] > b[r][1]:
            out.append((a[p][1], a[q][2], b[r][1], b[s][2], a[q][2] - a[p][1], a[p][3][:80]))
    return sorted(out, key=lambda s: s[0])


def test_spans():
    assert [s[:5] for s in spans_of(lines("alpha", "beta", "gamma"), lines("alpha", "beta", "gamma"))] == [(0, 15, 0, 15, 15)]
    assert [s[4] for s in spans_of(lines("same", "x", step=2.0), lines("same", "y", step=2.0))] == [2]
    swapped = spans_of(lines("a", "b", "c", "d"), lines("c", "d", "a", "b"))
    assert [(s[0], s[2]) for s in swapped] == [(0, 10), (10, 0)]
    assert [s[4] for s in spans_of(lines(*["shared"] * 3), lines(*["shared"] * 3))] == [15]
    assert spans_of([], lines("a")) == [] and spans_of(lines(""), lines("")) == []


@pytest.mark.parametrize("seed", range(40))
def test_spans_are_those_of_the_definition(seed):
    rnd = random.Random(seed)
    a, b = (lines(*[rnd.choice(["a", "b", "c", "d", ""]) for _ in range(rnd.randint(0, 25))]) for _ in range(2))
    found = spans_of(a, b)
    used = [t for s in found for t in range(int(s[0]), int(s[1]), 5)]
    assert len(used) == len(set(used)) and found == stepwise(a, b)


def test_spans_of_pairs(spark):
    rows = [("v", i, t, i * 5.0, i * 5.0 + 5, t.upper()) for i, t in enumerate(["a", "b", "", "c"])] + [("w", i, t, i * 5.0, i * 5.0 + 5, t) for i, t in enumerate(["c", "a", "b"])] + [("u", 0, "a", 0.0, 0.0, "a")]
    text = spark.createDataFrame(rows, "video_id string, line int, form string, start double, `end` double, text string")
    pairs = spark.createDataFrame([(1, "v", "w"), (2, "v", "u"), (3, "x", "v")], "pair_id long, source string, target string")
    found = spans.match_spans(pairs, text)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 10, 5, 15, 10, "A"), (1, 15, 20, 0, 5, 5, "C")]
    lengths = spark.createDataFrame([(1, 20.0, 15.0), (2, 20.0, 0.0)], "pair_id long, dur_a double, dur_b double")
    axis = {r.pair_id: r for r in spans.pair_indicators(lengths, found).collect()}
    one = axis[1]
    assert (one.longest, one.deviation, one.thirds) == (10, 2.5, 0.5) and one.bins == pytest.approx((2 + 2) / 20)
    # the middles of the second half aren't moved: on side a they fall into its last bin
    assert one.first_half == pytest.approx(0.1) and one.second_half == pytest.approx((1 + 1) / 20)
    assert axis[2].longest == 0 and axis[2].bins == 0


def test_scores(spark):
    score = S.suspicion5(*[F.col(c) for c in "abcde"])
    assert one(spark, score, a=True, b=1.0, c=0.0, d=0, e=0.0) == 100
    assert one(spark, score, a=False, b=0.0, c=1.0, d=99, e=600.0) == pytest.approx(0.15)
    for s, g in ((80.0, "critical"), (79.9, "high"), (60.0, "high"), (59.9, "moderate"), (40.0, "moderate"), (39.9, "normal")):
        assert one(spark, S.grade(F.col("s")), s=s) == g
    p = S.Policy()
    full = [F.lit(x) for x in (True, 1.0, 0.0, 0.0, 0.0)]
    assert one(spark, S.composite8(p, *full)) == 100
    assert one(spark, S.composite8(p, *full, F.lit(1200.0), F.lit(0.0), F.lit(1.0))) == 100
    with pytest.raises(ValueError):
        S.Policy(weights={"i1": 0.5})
    with pytest.raises(ValueError):
        S.Policy(evolution_band=(0.7, 0.6))
    assert one(spark, S.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 0.0]) == 0
    assert one(spark, S.pattern4(F.lit(60.0), F.lit(100.0), F.lit(True))) == "whole-same-week"
    assert one(spark, S.pattern4(F.lit(60.0), F.lit(0.0), F.lit(True))) is None
    assert one(spark, S.bit_distance(F.col("a"), F.col("b")), a=[0xFFFFFFFF], b=[0]) == 32


def test_text(spark):
    phrase = lambda s: one(spark, T.phrase(F.col("s")), s=s)
    assert phrase("〈a〉｢b｣『c』_d\u2019") == "a b c _d’" and phrase("ＡＢＣ") == "abc" and phrase("안녕   하세요「박」。") == "안녕 하세요 박" and phrase("") == "" and phrase(phrase("A.b  C")) == phrase("A.b  C")
    rate = T.change_rate(T.words(F.col("a")), T.words(F.col("b")))
    for a, b, want in (("x y", "y x", 0), ("a", "b", 1), ("", "b", 1), ("", "", 0)):
        assert one(spark, rate, a=a, b=b) == want
    assert one(spark, T.new_terms(T.words(F.col("a")), T.words(F.col("b"))), a="hello world", b="foo bar baz") == 3
    assert one(spark, T.transcript_form(F.col("s")), s="[음악] Hello, 가́ *기침* WORLD!") == "hello 가́ world"
    assert one(spark, T.iso_seconds(F.col("s")), s="PT1H2M3S") == 3723 and one(spark, T.iso_seconds(F.col("s")), s="P1D") == 0
    assert one(spark, T.hms(F.lit(3725.9))) == "01:02:05"
    assert one(spark, T.guarded(F.col("s")), s="=1+1") == "'=1+1"
    assert one(spark, T.origin_pair(F.lit("api"), F.lit("asr"))) == "asr-api"
    assert one(spark, T.without_fillers(F.col("s")), s="음~ 그래서 시작 어 합니다") == "~ 시작 합니다"


@pytest.mark.parametrize(
    "title, pattern, professor, course, year, week, session",
    [
        ("간호학 2024 1학기 김도아/이서진 3주차 2차시", "semester_explicit", "김도아|이서진", "간호학", 2024, 3, 2),
        ("24-1/25-1 김도아/이서진 기초 간호 3주차 2차시 (간호학과)", "co_teaching", "김도아|이서진", "기초 간호", 2024, 3, 2),
        ("2021학년도 2학기 회계원리 5주차_2차시_질의응답 (강종인)", "academic_year", "강종인", "회계원리", 2021, 5, 2),
        ("20-1. 강종인 회계 원리 5주차 1차시-1 (경영회계과)", "numbered_prefix", "강종인", "회계 원리", None, 5, 1),
        ("강종인 2023 경영회계과 마케팅조사 7주차 3차시", "standard_kr", "강종인", "마케팅조사", 2023, 7, 3),
        ("2023 강종인 마케팅조사 7주차", "year_prof_course_week", "강종인", "마케팅조사", 2023, 7, None),
        ("2023-2 강종인 경영회계과 마케팅조사 7주차 1차시", "numbered_prefix", "강종인", "경영회계과 마케팅조사", None, 7, 1),
        ("강종인 특강 마케팅조사", "prof_keyword_course", "강종인", "마케팅조사", None, None, None),
        ("", None, "", None, None, None, None),
        (None, None, "", None, None, None, None),
    ],
)
def test_titles(spark, title, pattern, professor, course, year, week, session):
    r = titles.parse(spark.createDataFrame([("v", title)], "video_id string, title string")).first()
    assert (r.matched_pattern, r.professor, r.course, r.year, r.week, r.session, r.parse_error) == (pattern, professor, course, year, week, session, pattern is None)


def test_near_names(spark):
    rnd = random.Random(2)
    names = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(60)})

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = sorted((a, b, lev(a, b)) for a in names for b in names if a < b and 1 <= lev(a, b) <= 2)
    got = sorted(map(tuple, titles.near_names(spark.createDataFrame([(n,) for n in names + [None]], "name string")).collect()))
    assert got == want


def test_cosine_links_in_blocks(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(50, 6))
    rows = [(i, i % 2, [float(x) for x in v[i]]) for i in range(50)] + [(99, 0, [0.0] * 6), (100, None, None)]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>")
    got = {r.id: r.links for r in vectors.cosine_links(df, "id", "g", "v", 0.3, block=7).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    assert got == {i: sum(1 for j in range(50) if i != j and i % 2 == j % 2 and s[i, j] >= 0.3) for i in range(50)} | {99: 0}


def test_alignment():
    a = np.arange(100, dtype=np.uint32) * np.uint32(2654435761)
    assert vectors.best_alignment(a, a[8:]) == 0 and vectors.best_alignment(a[:5], a[:5]) is None


def test_series(spark):
    rows = [("a", "2024-01-01", 1.0), ("a", "2024-01-04", 4.0), ("b", "2024-01-01", 5.0)]
    df = spark.createDataFrame(rows, "k string, day string, v double").withColumn("day", F.to_date("day"))
    got = [(r.k, r.v) for r in series.fill_gaps(df, "k", "day", "v").orderBy("k", "day").collect()]
    assert got == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 5.0)]
    line = spark.createDataFrame([("a", float(i), 2.0 * i) for i in range(10)], "k string, x double, y double")
    r = series.linear_forecast(line, "k", "x", "y", 1).first()
    assert r.predicted == pytest.approx(20) and r.lower == pytest.approx(20)
    spike = spark.createDataFrame([("a", 1.0)] * 30 + [("a", 100.0)] + [("flat", 2.0)] * 5, "k string, v double")
    assert [r.v for r in series.anomalies(spike, "k", "v").where("is_anomaly").collect()] == [100.0]


def test_merge_and_violations(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, p string, q string")
    new = spark.createDataFrame([(2, None, None), (3, "c", None)], "k int, p string, q string")
    assert sorted(map(tuple, merge(old, new, ["k"], ["p"]).collect())) == [(1, "a", "x"), (2, "b", None), (3, "c", None)]
    assert sorted(map(tuple, merge(merge(old, new, ["k"]), new, ["k"]).collect())) == sorted(map(tuple, merge(old, new, ["k"]).collect()))
    bad = spark.createDataFrame([("v", -1, 5, "t"), ("w", 1, None, " ")], "video_id string, view_count long, duration_seconds long, title string")
    assert sorted(map(tuple, violations(bad, "video_id", schemas.checks("video")).collect())) == [("v", "views_not_negative"), ("w", "title_not_blank")]


def test_readers(spark, tmp_path):
    (tmp_path / "v1.json").write_text('﻿{"segments": [{"start": 1, "duration": 2, "text": "a"}, {"text": "no start"}]}', encoding="utf-8")
    (tmp_path / "v2.json").write_text("not json")
    got = {r.video_id: [tuple(s) for s in r.segments] for r in readers.read_transcripts(spark, f"{tmp_path}/*.json").collect()}
    assert got == {"v1": [(1.0, 3.0, "a")], "v2": []}
    assert readers.read_parquet(spark, f"{tmp_path}/none") is None and readers.read_parquet(spark, f"{tmp_path}/none", schemas.VIDEO).count() == 0
    srt = "﻿1\r\n00:00:01,500 --> 00:00:02.000\r\nHello\r\nworld\r\n\r\n2\r\nbroken\r\n\r\n3\r\n00:00:03,000 --> 00:00:04,000\r\n\r\n"
    rows = readers.parse_srt(spark.createDataFrame([("v", srt)], "video_id string, srt string"), "video_id", "srt").collect()
    assert [tuple(r) for r in rows] == [("v", 0, 1.5, 2.0, "Hello world")]
    (tmp_path / "r.csv").write_text("date,views\n2024-01-01,5\n")
    assert readers.read_report_csv(spark, f"{tmp_path}/r.csv").first().views == 5
    for body in ("", "date,views\n", "date,views\n2024-01-01\n"):
        (tmp_path / "bad.csv").write_text(body)
        with pytest.raises(ValueError):
            readers.read_report_csv(spark, f"{tmp_path}/bad.csv")
    head = ",".join(readers.EXPORT_COLUMNS.values())
    (tmp_path / "동영상.csv").write_text(f"{head}\nv1,1500,2024-01-01T00:00:00Z,모름,t0\nv1,2500,2024-01-01T00:00:00Z,공개,t1\n")
    (tmp_path / "동영상(1).csv").write_text(f"{head}\nv1,9000,bad,비공개,t2\nv2,,,비공개,t3\n")
    good, rejected = readers.read_export(spark, [f"{tmp_path}/동영상.csv", f"{tmp_path}/동영상(1).csv"], "UC1")
    assert sorted((r.video_id, r.privacy_status) for r in good.collect()) == [("v1", "private"), ("v2", "private")] and rejected.count() == 1
    (tmp_path / "policy.json").write_text('{"layer_a_min_seconds": 30, "layer_c_evolution_band": [0.5, 0.6]}')
    assert readers.load_policy(f"{tmp_path}/policy.json").evolution_band == (0.5, 0.6)


def test_writers(spark, tmp_path):
    seg = spark.createDataFrame([("v", 0, 0.0, 1.0, "음 안녕"), ("v", 1, 61.0, 62.0, "끝"), ("v", 2, 70.0, 71.0, None)], "video_id string, segment_index int, start double, `end` double, text string")
    meta = spark.createDataFrame([("v", "제목", 62.0, None)], "video_id string, title string, duration_seconds double, privacy_status string")
    assert writers.transcript_text(seg, without_fillers=True).first().body == "[00:00:00] 안녕\n[00:01:01] 끝"
    assert writers.transcript_text(seg, "md", meta=meta).first().body.startswith("# 제목\n\n- video_id: v\n- duration: 62.0s\n- privacy_status: unknown\n\n---\n\n[00:00:00] 음 안녕\n\n")
    assert writers.transcript_text(seg, "jsonl", meta=meta).first().body.split("\n")[0] == '{"_meta":true,"video_id":"v","title":"제목","duration":62.0}'
    writers.write_audit(spark.createDataFrame([("=x", "ok", 1)], "a string, b string, c int"), f"{tmp_path}/audit", ["a", "b", "z"], {"b": ["ok"]})
    assert spark.read.csv(f"{tmp_path}/audit", header=True).first().a == "'=x"
    with pytest.raises(ValueError):
        writers.write_audit(spark.createDataFrame([("bad",)], "b string"), f"{tmp_path}/audit", ["b"], {"b": ["ok"]})


def test_search(spark):
    rows = [("a", "김도아 특강", ["김도아"], "회계", 2022, 1, 3, 1), ("b", "t", ["이서"], "회계", 2023, 1, 9, 1), ("a", "김도아 특강", ["김도아"], "회계", 2022, 1, 3, 1), ("c", "t", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "video_id string, original_title string, professor array<string>, course string, year int, semester int, week int, session int")
    assert Q.search(df, Q.Query()).count() == 4
    assert [r.video_id for r in Q.search(df, Q.from_flags(professor="도아", week_to=5)).collect()] == ["a"]
    assert {r.video_id for r in Q.search(df, Q.Query(queries=(Q.Filter(year=2023), Q.Filter(course="회")))).collect()} == {"a", "b"}
    assert {r.video_id for r in Q.search(df, Q.Query(Q.Filter(course="회"), exclude_title=("특강",))).collect()} == {"b"}


def test_stream_equals_batch(spark, tmp_path):
    from reelgrain.streaming.daily import daily_counts_stream

    df = spark.createDataFrame([(f"2024-01-0{i % 3 + 1} 10:00:00", "ab"[i % 2]) for i in range(20)], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/events")
    assert sorted(map(tuple, daily_counts_stream(spark, f"{tmp_path}/events").collect())) == sorted(map(tuple, daily_counts(df).collect()))


def test_page_bodies(spark):
    page = "<html><head><p>x</p></head><BODY class=a><!-- c --><P id='k' hidden>1 &amp; 2<br/>3</P></body><p>after</p></html>"
    assert T.body_of(page) == '<p id="k" hidden>1 & 2<br></br>3</p>' and T.body_of("<p>none</p>") == "" and T.body_of("") == ""
    assert one(spark, T.html_body(F.col("p")), p="<body>a</body>") == "a"


def test_whitelists_and_memberships(spark):
    from reelgrain.operators import governance as G

    key = "professor_id string, alias string"
    members = spark.createDataFrame([("p1", "a"), ("p2", "b")], key)
    asked = spark.createDataFrame([("p1", "a"), ("p1", "b"), ("p3", "c"), ("p4", "c"), ("p3", "c")], key)
    assert sorted(map(tuple, G.map_professors(members, asked).collect())) == [("p1", "a", "there"), ("p1", "b", "conflict"), ("p3", "c", "added"), ("p4", "c", "conflict")]
    assert sorted(map(tuple, G.remove(members, asked, ["professor_id", "alias"]).collect())) == [("p2", "b")]
    states = G.add_unique(members, spark.createDataFrame([("p1", "a"), ("p9", None), ("p9", None)], key), ["professor_id", "alias"])
    assert sorted((r.professor_id, r.state) for r in states.collect()) == [("p1", "duplicate"), ("p9", "added")]
    pairs = spark.createDataFrame([(1, "PENDING", None, None), (2, "FALSE_POSITIVE", "x", None)], "id long, review_status string, reviewed_by string, reviewed_at timestamp")
    white = G.whitelist_pairs(pairs, spark.createDataFrame([(1, "me", None)], "id long, actor string, at timestamp"))
    assert sorted((r.id, r.review_status, r.reviewed_by) for r in white.collect()) == [(1, "FALSE_POSITIVE", "me"), (2, "FALSE_POSITIVE", "x")]
    assert sorted((r.id, r.review_status, r.reviewed_by) for r in G.reset_pairs(white, pairs.select("id")).collect()) == [(1, "UNREVIEWED", None), (2, "UNREVIEWED", None)]
    assert [r.id for r in G.missing_keys(pairs, spark.createDataFrame([(7,), (1,)], "id long"), ["id"]).collect()] == [7]


def test_stored_transcripts_are_normalised_once(spark):
    rows = [("a", [(0.0, 1.0, "Hello, [x] WORLD!"), (1.0, 2.0, None)], 0), ("b", [(0.0, 1.0, "Kept!")], spans.TEXT_VERSION), ("c", [], None)]
    df = spark.createDataFrame(rows, "video_id string, segments array<struct<start:double,`end`:double,text:string>>, version int")
    got = {r.video_id: r for r in spans.normalised_transcripts(df).collect()}
    assert [s.text for s in got["a"].segments] == ["hello world", None] and got["b"].segments[0].text == "Kept!" and got["c"].segments == []
    assert {k: r.skipped for k, r in got.items()} == {"a": False, "b": True, "c": False} and {r.version for r in got.values()} == {spans.TEXT_VERSION}


def test_more_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t" / "deep").mkdir(parents=True)
    (tmp_path / "t" / "deep" / "a.json").write_text('\ufeff[{"video_id": "v", "professor": ["p"], "week": 3}]', encoding="utf-8")
    (tmp_path / "t" / "b.json").write_text('{"video_id": "x"}')
    assert [(r.video_id, r.professor, r.week) for r in readers.read_parsed_titles(spark, str(tmp_path / "t")).collect()] == [("v", ["p"], 3)]
    (tmp_path / "s.json").write_text('{"filters": {"course": "c", "week_from": 2}, "queries": [{"year": 2022}], "exclude": {"title_contains": ["OT"]}}')
    assert readers.load_search(str(tmp_path / "s.json")) == Q.Query(Q.Filter(course="c", weeks=(2, 16)), (Q.Filter(year=2022),), ("OT",))
    (tmp_path / "ch.csv").write_text("채널 ID,채널 제목(원본),채널 국가\nUC1,Name,KOR\nUC2,Other,US\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_channel(spark, str(tmp_path / "ch.csv")).collect()] == [("UC1", "Name", "KO", None)]
    assert readers.find_files(spark, str(tmp_path / "*.csv"), str(tmp_path / "ch*"), str(tmp_path / "none*")) == [str(tmp_path / "ch.csv")]
    done, failed = readers.collect_reports({"geography": lambda: spark.range(1), "devices": lambda: spark.sql("select nope"), "unheard": lambda: 1})
    assert list(done) == ["geography"] and list(failed) == ["devices"]
    points = spark.createDataFrame([("v", ["0.5", "1.2"]), ("v", ["0.6", "x", "0.3"]), ("v", ["1"])], "video_id string, row array<string>")
    assert sorted(map(tuple, readers.retention_rows(points).collect()), key=str) == [("v", 0.5, 1.2, 0.0), ("v", 0.6, None, 0.3)]
    writers.write_json(spark.range(2), str(tmp_path / "j"))
    writers.write_json(spark.range(3), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3 and sorted(p.name for p in tmp_path.glob("j*")) == ["j"]
    entries = spark.createDataFrame([("v", "f", "s", "old", "1", 1), ("v", "f", "s", "new", "2", 2)], schemas.MANIFEST)
    (tmp_path / "file").write_text("x")
    assert writers.save_manifest(entries, str(tmp_path / "m"), str(tmp_path / "r")).endswith("m")
    assert writers.save_manifest(entries, str(tmp_path / "file" / "m"), str(tmp_path / "r")).endswith("r")
    assert [(r.reason, r.attempt_count) for r in readers.read_manifest(spark, str(tmp_path / "m")).collect()] == [("new", 2)]


def test_pairs_by_kind_of_input(spark):
    rows = spark.createDataFrame([(1, "g", [1.0, 0.0], 50), (2, "g", [1.0, 0.1], 70), (3, "g", [0.0, 1.0], 80)], "id long, g string, v array<double>, s int")
    assert sorted(map(tuple, vectors.pairs_of(rows, "id", "g", 60, seconds="s").collect())) == [(2, 1), (3, 1)]
    assert {r.id: r.links for r in vectors.pairs_of(rows, "id", "g", 0.9, vector="v").collect()} == {1: 1, 2: 1, 3: 0}
    with pytest.raises(ValueError):
        vectors.pairs_of(rows, "id", "g", 0.9)


def test_ranks_in_parts_are_ranks(spark):
    from reelgrain.operators.facts import ranked

    rnd = random.Random(9)
    rows = [(f"k{i:03}", rnd.choice(["g", "h", None]), rnd.choice([None, *range(30)])) for i in range(300)]
    got = {r.k: r.place for r in ranked(spark.createDataFrame(rows, "k string, g string, n int"), "g", ["n", "k"], size=8).collect()}
    want = {}
    for g in ("g", "h", None):
        for p, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0])), 1):
            want[r[0]] = p
    assert got == want


def test_tables_of_a_query_are_deleted(spark, tmp_path, monkeypatch):
    import os

    from reelgrain import storage

    monkeypatch.setattr(storage, "shared_folder", lambda s: str(tmp_path))
    storage.release(spark)

    @storage.scoped
    def query(s, d):
        a = storage.materialize(s.range(5))
        b = storage.materialize(a.selectExpr("id + 1 AS id"))
        storage.drop(storage.materialize(b))
        return b.where("id > 2")

    rows = query(spark, "")
    assert len(os.listdir(tmp_path)) == 1 and sorted(r.id for r in rows.collect()) == [3, 4, 5]
    storage.release(spark)
    assert os.listdir(tmp_path) == []


def test_a_folder_of_its_own_where_none_is_set(spark, monkeypatch):
    from reelgrain import storage

    class Bare:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master, applicationId, _jvm = "local[1]", "app-of-this-test", spark.sparkContext._jvm

            class _jsc:
                hadoopConfiguration = staticmethod(lambda: spark.sparkContext._jsc.hadoopConfiguration())
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    assert storage.shared_folder(Bare) == storage.shared_folder(Bare) and "reelgrain-" in storage.shared_folder(Bare)
    Bare.sparkContext.master = "yarn"
    with pytest.raises(RuntimeError):
        storage.shared_folder(Bare)
