from datetime import datetime

from reelgrain.plans import q_reports, registry

FACTS = "id long, source_video_id string, professor string, course string, week int, session int, year_from int"
VIDEOS = "video_id string, duration_seconds long, view_count long, published_at timestamp"


def write(spark, folder, rows, name, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def run(spark, folder, name):
    return registry.queries()[name](spark, str(folder))


def titles(spark, folder):
    rows = [("a", "2023 강종인 마케팅조사 7주차"), ("b", "감염관리학 2주차 Review Clip (한기원)"), ("b", "감염관리학 2주차 Review Clip (한기원)"), ("c", None), ("d", "[Law] Torts - Kim - Week 3 Session 1")]
    write(spark, folder, rows, "sample_titles", "video_id string, title string")


def test_parse_failures_are_those_of_the_parser(spark, tmp_path):
    titles(spark, tmp_path)
    assert sorted(map(tuple, run(spark, tmp_path, "v005").select("rule_id", "severity", "ids").collect())) == [("V-005", "WARNING", x) for x in "bcd"]
    assert tuple(run(spark, tmp_path, "parse_stats").first()) == (5, 1, 4, 0.2)


def test_near_names_come_from_the_videos(spark, tmp_path):
    rows = [(1, "v1", "김도아", "c", 1, 1, 2023), (2, "v2", "김도아", "c", 2, 1, 2023), (3, "v3", "김도하나", "c", 3, 1, 2023), (4, "v4", "김도하나 / Elizabeth", "c", 4, 1, 2023), (5, "v5", None, "c", 5, 1, 2023), (6, "v6", "(Elisabeth)", "c", 6, 1, 2023), (7, "v6", "(Elisabet)", "c", 6, 1, 2023)]
    write(spark, tmp_path, rows, "comparison_results", FACTS)
    got = sorted(map(tuple, run(spark, tmp_path, "v004").select("rule_id", "severity", "ids", "details").collect()))
    assert got == [("V-004", "WARNING", "v1|v2|v3|v4", "김도아|김도하나|2"), ("V-004", "WARNING", "v4|v6", "Elisabet|Elizabeth|2")]


def test_limits_of_weeks_and_durations(spark, tmp_path):
    weeks = {"a": -1, "b": 0, "c": 1, "d": 15, "e": 16, "f": 17, "g": None}
    rows = [(i, v, "김도아", "few", w, 1, 2023) for i, (v, w) in enumerate(weeks.items())] + [(100 + i, f"x{i:02}", "이서진", "many", 1, 1, 2023) for i in range(14)] + [(200 + i, f"y{i}", "이서진", "even", 1, 1, 2023) for i in range(6)]
    write(spark, tmp_path, rows, "comparison_results", FACTS)
    seconds = {f"x{i:02}": 1000 + i for i in range(13)} | {"x13": 9000} | {f"y{i}": 1000 for i in range(5)} | {"y5": 2000}
    spark.createDataFrame(list(seconds.items()), "video_id string, duration_seconds long").selectExpr("*", "'x' AS title", "1L AS view_count", "TIMESTAMP '2023-03-01 00:00:00' AS published_at").write.parquet(f"{tmp_path}/videos.parquet")
    ids = lambda name: sorted(r.ids for r in run(spark, tmp_path, name).collect())
    assert ids("v003") == ["a", "b", "f"]
    assert ids("v007") == ["x13"]


def test_nine_rules_are_united(spark, tmp_path):
    assert sorted(q_reports.RULES) == [f"v00{i}" for i in range(1, 10)]
    titles(spark, tmp_path)
    rows = [(1, "v1", "김도아", "c", 1, 1, 2023), (2, "v2", "김도하나", "d", 1, 1, 2023)]
    write(spark, tmp_path, rows, "comparison_results", FACTS)
    spark.sql(f"SELECT id AS video_id, 'x' AS title, 100L AS duration_seconds, 1L AS view_count, TIMESTAMP '2023-03-01 00:00:00' AS published_at FROM VALUES ('v1'), ('v2') AS t(id)").write.parquet(f"{tmp_path}/videos.parquet")
    assert sorted(map(tuple, run(spark, tmp_path, "findings_union").collect())) == [("V-004", 1), ("V-005", 3)]
    got = sorted(map(tuple, run(spark, tmp_path, "findings_ranked").select("rule_id", "severity", "ids", "place").collect()))
    assert got == [("V-004", "WARNING", "v1|v2", 1)] + [("V-005", "WARNING", x, 1) for x in "bcd"]


def rows_of(spark, tmp_path, facts, seconds=100):
    """facts: video, professor, course, week, session, year, title."""
    write(spark, tmp_path, [(i, f[0], f[1], f[2], f[3], f[4], f[5]) for i, f in enumerate(facts)], "comparison_results", FACTS)
    made = [(f[0], f[6], seconds, 1) for f in facts]
    spark.createDataFrame(made, "video_id string, title string, duration_seconds long, view_count long").selectExpr("*", "TIMESTAMP '2022-03-05 00:00:00' AS published_at").write.parquet(f"{tmp_path}/videos.parquet")


def got(spark, tmp_path, name):
    return sorted((r.ids, r.professor, r.details) for r in run(spark, tmp_path, name).collect())


def test_rules_take_professors_apart_and_leave_out_extra_videos(spark, tmp_path):
    facts = [
        ("v1", "김도아/이서진", "c", 1, 1, 2022, "x"), ("v2", "김도아", "c", 1, 1, 2022, "x"), ("v3", "이서진", "c", 1, 3, 2019, "x"), ("v4", "이서진", "c", 5, 2, 2022, "특강"), ("v5", "이서진", "c", 6, 1, 2022, "x"),
        ("v6", "김도아", "", 9, 9, 2022, "x"), ("v7", None, "c", 9, 9, 2022, "x"),
    ]
    rows_of(spark, tmp_path, facts)
    assert got(spark, tmp_path, "v001") == [("v3", None, "2019|2022|3")]
    assert got(spark, tmp_path, "v002") == [("v1|v2", "김도아", "c|1|1|2")]
    assert got(spark, tmp_path, "v006") == [("v3", "이서진", "c|1|3|2")]  # v4 is a special lecture
    assert got(spark, tmp_path, "v008") == [("v1", "이서진", "c|2,3,4,5")]
    assert got(spark, tmp_path, "v009") == [("v1", "이서진", "c|1|6|4")]


def test_compliance_by_the_calendar(spark, tmp_path):
    facts = [("v1", "김도아/이서진", "c", 1, 1, 2022, "x"), ("v2", "김도아", "c", 2, 1, 2022, "x"), ("v3", "김도아", "c", 3, 1, 2021, "x")]
    rows_of(spark, tmp_path, facts)
    seen = {(r.professor, r.week): (r.status, r.rate) for r in run(spark, tmp_path, "compliance").collect()}
    assert len(seen) == 32 and seen["김도아", 1] == ("late", 0.5) and seen["김도아", 2] == ("uploaded", 0.5) and seen["김도아", 3] == ("missing", 0.5) and seen["이서진", 1] == ("late", 0.0)
    heat = {(r.professor, r.week): r.heat for r in run(spark, tmp_path, "heat_encode").collect()}
    assert (heat["김도아", 1], heat["김도아", 2], heat["이서진", 5]) == (0.5, 1.0, 0.0)
