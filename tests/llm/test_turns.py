from reelgrain.llm.turns import turns

SCHEMA = "segment_id string, video_id string, start double, `end` double, text string, label string"
ROWS = [
    "여러분 안녕하세요 [음악]",
    "58:11 한예윤 교수: 오늘은 문제 3: 풀겠습니다 >> 학생1: 네",
    "(수강생 1) 음…",
    "[00:27:02] Prof: um… uh",
    "STUDENT1 - 비율은 2:1, 정의: 값",
    "Student 2: (박수)",
    "조교 : 회귀분석(regression) 입니다 S2:",
    "♪ 시작 음악 ♪ 네 알겠습니다",
    "Teaching Assistant - yes",
    "학​생 ３ :",
    "(30:29)",
    "<교수님> 주의 - 끝",
    None,
    "",
]


def test_turns(spark):
    rows = [(f"v_{i:02}", "v", float(i), None if i == 3 else i + 0.5, t, "x") for i, t in enumerate(ROWS)]
    rows += rows[:3] + [("w_0", "w", 0.0, 1.0, "no labels here: AI 튜터가 말합니다", "x"), ("u_0", "u", 0.0, 1.0, "SPEAKER_00: hm 화자 1) 말 spk0> [웃음]", "x")]
    got = sorted(map(tuple, turns(spark.createDataFrame(rows, SCHEMA)).select("video_id", "turn_no", "speaker", "segment_id", "words").collect()))
    assert got == [
        ("u", 1, "speaker1", "u_0", "말"),
        ("v", 1, "unknown", "v_00", "여러분 안녕하세요"),
        ("v", 2, "professor", "v_01", "오늘은 문제 3: 풀겠습니다"),
        ("v", 3, "student1", "v_01", "네 비율은 2:1, 정의: 값"),
        ("v", 4, "assistant", "v_06", "회귀분석(regression) 입니다"),
        ("v", 5, "student2", "v_07", "네 알겠습니다"),
        ("v", 6, "assistant", "v_08", "yes"),
        ("v", 7, "professor", "v_11", "주의 - 끝"),
    ]
    assert turns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hint_is_read_where_labels_are(spark):
    # two blanks before the colon, a clock time inside, a label at the end: no other label in the record
    rows = [("a_0", "a", 0.0, 1.0, "교수  : 시작합니다", "x"), ("b_0", "b", 0.0, 1.0, "학생 1 00:10 : 네", "x"), ("c_0", "c", 0.0, 1.0, "tutor -", "x"), ("c_1", "c", 1.0, 2.0, "yes", "x"), ("d_0", "d", 0.0, 1.0, "plain words", "x")]
    got = sorted((r.video_id, r.speaker) for r in turns(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("a", "professor"), ("b", "student1"), ("c", "assistant")]
