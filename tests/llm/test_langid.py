import random

import numpy as np
import pytest
from reelgrain.llm.langid import CJ, HANGUL, Reading, document_languages, fit, in_sample, language_of, letters, line_languages, passages, segment_languages

PHRASES = {
    "en": ["we compare the first result with the second one in this lesson", "please read the notes before the next class and write a summary", "there is a strong relation between the load and the temperature"],
    "es": ["hoy vamos a comparar el primer resultado con el segundo en esta clase", "por favor lean los apuntes antes de la próxima clase y escriban un resumen", "hay una relación fuerte entre la carga y la temperatura"],
    "pt": ["hoje vamos comparar o primeiro resultado com o segundo nesta aula", "por favor leiam as notas antes da próxima aula e escrevam um resumo", "há uma relação forte entre a carga e a temperatura"],
    "de": ["heute vergleichen wir das erste Ergebnis mit dem zweiten in dieser Stunde", "bitte lesen Sie die Notizen vor der nächsten Stunde und schreiben eine Zusammenfassung", "es gibt einen starken Zusammenhang zwischen der Last und der Temperatur"],
    "vi": ["hôm nay chúng ta so sánh kết quả thứ nhất với kết quả thứ hai", "các bạn hãy đọc ghi chú trước buổi học sau và viết một bản tóm tắt", "hom nay chung ta so sanh ket qua thu nhat voi ket qua thu hai"],
    "ko": ["오늘은 첫 번째 결과를 두 번째 결과와 비교해 보겠습니다"],
    "ja": ["今日は最初の結果を次の結果と比べてみましょう"],
    "zh": ["今天我们来比较第一个结果和第二个结果之间的差异"],
    "ru": ["сегодня мы сравним первый результат со вторым на этом занятии"],
}


@pytest.mark.parametrize("label, code", [("ko_KR", "ko"), (" English ", "en"), ("zho", "zh"), ("pt-BR", "pt"), ("Brazilian Portuguese", "pt"), ("zh-Hans-CN", "zh"), ("fr", None), ("und", None), ("", None), (None, None), ("xx", None), ("n/a", None)])
def test_labels(label, code):
    assert language_of(label) == code


def test_parts():
    assert set(Reading(["search quality 파트에서 voltage activity 개념의 오류를 예로 시험에서 묻겠습니다"]).kind) == {HANGUL}
    han = Reading(["荷重分布標本抽出"])
    assert set(han.kind) == {CJ} and len(set(han.stretch)) == 1 and han.letters_of().sum() == 8 and len(han.start) == 7
    assert letters("가나 다 1. ab") == 5
    for mark in ("(p. 48)", "1. 2. 3.", "Q.", "----", "", "ab"):
        assert len(Reading([mark]).start) == 0
    read = Reading(["don't stop 'now", "", "a\n\nb"])
    assert read.text_of.tolist() == [0, 1, 2, 2, 2] and read.letters.tolist() == [11, 0, 1, 0, 1]


def test_lines(spark):
    rnd = random.Random(0)
    rows, want = [], {}
    for i in range(240):
        lang = rnd.choice(list(PHRASES))
        lines = [rnd.choice(PHRASES[lang]) + "." for _ in range(3)]
        langs = [{lang}] * 3
        label = lang
        if i % 6 == 0:
            label = rnd.choice([None, "xx", "", rnd.choice([x for x in PHRASES if x != lang])])
        if i % 9 == 0:
            other = rnd.choice([x for x in PHRASES if x != lang])
            lines[1] += " " + rnd.choice(PHRASES[other]) + "."
            langs = [{lang}, {lang, other}, {lang}]
        rows.append((i, "\n".join(lines), label, "x"))
        if label != lang or i % 9 == 0:
            want |= {(i, k, x): 1 for k in range(3) for x in langs[k] if letters(lines[k]) >= 20}
    rows += [(900, None, "en", "x"), (901, "", None, "x"), (902, "12 34", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, confidence string")
    got = {(r.doc_id, r.line_no, r.lang) for r in line_languages(df, only_doubtful=True).collect()}
    assert len(got ^ set(want)) <= 0.02 * len(want)
    assert all(0 < r.confidence <= 1 for r in line_languages(df).collect())
    assert line_languages(df.limit(0)).count() == 0


def labelled(spark, copies=40):
    rows = [(i, "\n".join(x + "." for x in PHRASES[k]), k, "x") for i, k in enumerate(list(PHRASES) * copies)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, confidence string")


def test_sample_of_any_number_of_documents(spark):
    df = labelled(spark)
    for n in (1, 10**3, 3 * 10**9, 2 * 10**10, 10**13):
        assert spark.range(1).select(in_sample("id", 3000, n).alias("x")).first()[0] in (True, False)
    ids = spark.range(200_000)
    assert abs(ids.where(in_sample("id", 10**9, 2 * 10**10)).count() - 10_000) < 500 and ids.where(in_sample("id", 5, 2)).count() == 200_000
    assert fit(df, 15 * 10**9, 2 * 10**10).tables[0][0].size > 50
    with pytest.raises(ValueError):
        fit(df, 3000, 2 * 10**13)
    assert fit(df.limit(0)) is None and fit(df.where("doc_id < 0")) is None


def test_languages_outside_the_nine_are_not_sure(spark):
    model = fit(labelled(spark))
    strange = ["сьогодні ми порівнюємо перший результат із другим на цьому занятті і пишемо підсумок", "aujourd'hui nous allons comparer le premier résultat avec le deuxième pendant ce cours", "dziś porównamy pierwszy wynik z drugim podczas tej lekcji"]
    own = [x[0] for x in PHRASES.values()]
    low, high = passages(model, Reading(strange)), passages(model, Reading(own))
    assert low["confidence"].max() < 0.5 and high["confidence"].min() > 0.8
    assert [list(PHRASES)[k] for k in range(9)] and len(high) == 9


def test_segments_and_documents(spark):
    model_rows = labelled(spark).collect()
    text = PHRASES["en"][0] + ". " + PHRASES["de"][1] + "."
    rows = [tuple(r) for r in model_rows] + [(9000, "x\n" + text, "es", "x"), (9001, None, "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, confidence string")
    found = sorted(segment_languages(df).where("doc_id = 9000").collect(), key=lambda r: r.first)
    assert [(r.line_no, r.lang) for r in found] == [(1, "en"), (1, "de")]
    assert [text[r["first"] : r["last"]] for r in found] == [PHRASES["en"][0], PHRASES["de"][1]]
    docs = {r.doc_id: r for r in document_languages(df).collect()}
    assert len(docs) == len(model_rows) + 1 and docs[9000].label == "wrong" and set(docs[9000].languages.split(",")) == {"en", "de"} and 0.4 < docs[9000].share < 0.7
    assert docs[0].label == "right" and np.isclose(docs[0].share, 1.0) and docs[0].confidence > 0.8
    assert document_languages(df.limit(0)).count() == 0 and segment_languages(df.limit(0)).count() == 0
