import pytest
from reelgrain.operators import titles


def parsed(spark, title):
    return titles.parse(spark.createDataFrame([("v", title)], "video_id string, title string")).first()


@pytest.mark.parametrize(
    "title, professor, year, semester, week, session, department",
    [
        ("감염관리학 2주차 Review Clip (한기원)", "한기원", None, None, 2, None, None),
        ("12. 김도아 자료실", "김도아", None, None, None, None, None),
        ("[보강] 2023-2학기 간호학과 4차시 (김도아/이서진)", "김도아|이서진", 2023, 2, None, 4, "간호학과"),
        ("(중간) 3주차 20231", "", None, None, 3, None, None),
        ("회계학 (중간/강종인) 120235", "강종인", None, None, None, None, None),
        ("강종인 (기말) 안내", "강종인", None, None, None, None, None),
        ("학년도 안내", "", None, None, None, None, None),
        ("(Kim) 7주차 2차시", "", None, None, 7, 2, None),
        ("회로이론 ５주차 Review Clip (송태섭) 20１９", "송태섭", 2019, None, 5, None, None),
        ("   ", "", None, None, None, None, None),
    ],
)
def test_fields_of_unmatched_titles(spark, title, professor, year, semester, week, session, department):
    r = parsed(spark, title)
    assert r.parse_error and r.matched_pattern is None and r.course is None
    assert (r.professor, r.year, r.semester, r.week, r.session, r.department) == (professor, year, semester, week, session, department)


def test_digits_of_other_scripts(spark):
    r = parsed(spark, "강종인 ２０２３ 마케팅조사 ７주차 ١차시")
    assert not r.parse_error and (r.year, r.week, r.session) == (2023, 7, 1)


def test_matched_titles_take_nothing_from_the_fallback(spark):
    r = parsed(spark, "강종인 특강 마케팅조사 3주차 2022 (김도아)")
    assert not r.parse_error and (r.professor, r.year, r.week) == ("강종인", None, None)
