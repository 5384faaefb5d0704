import unicodedata

import pytest
from pyspark.sql import functions as F
from reelgrain.llm.visual_form import alike_classes, alike_pairs, caseless_form, confusables, form, visual_form


@pytest.mark.parametrize(
    "a, b",
    [("ＡＢ１", "AB1"), (unicodedata.normalize("NFD", "강종인 é"), "강종인 é"), ("a​b﻿­c", "abc"), ("a b　c d", "a b c d"), ("Ⅲ", "III"), ("Рrоf", "Prof"), ("ΑΤ", "AT"), ("다큐ㆍ기획", "다큐·기획"), ("A‐1", "A-1"), ("ｶﾞ", "ガ"), ("ﬁn", "fin"), ("ﾡ", "ㄱ"), ("tab\there", "tab here"), ("ё", "ë")],
)
def test_same_look(a, b):
    assert visual_form(a) == visual_form(b)
    assert visual_form(visual_form(a)) == visual_form(a)


@pytest.mark.parametrize("a, b", [("a", "A"), ("①", "1"), ("2²", "22"), ("a  b", "a b"), ("ㄱㅏ", "가"), ("й", "и"), ("½", "1/2"), ("㎏", "kg")])
def test_different_look(a, b):
    assert visual_form(a) != visual_form(b)


def test_public_confusables(spark):
    more = confusables(spark)
    assert len(more) > 200
    for a, b in (("ρ", "p"), ("υ", "u"), ("α", "a"), ("ι", "i"), ("ѵ", "v"), ("Ԍ", "G"), ("ց", "g"), ("ռ", "n"), ("ı", "i"), ("Ꭺ", "A"), ("Ꮪ", "S"), ("ά", "á")):
        assert visual_form(a, more) == b, a
    for a, b in (("З", "3"), ("б", "6"), ("ʰ", "h"), ("①", "1"), ("ㅇ", "o"), ("ㅣ", "l"), ("一", "-"), ("×", "x"), ("α", "A")):
        assert visual_form(a, more) != b, a
    df = spark.createDataFrame([("ραρ 가",), (None,), ("plain",)], "t string")
    assert [r[0] for r in df.select(form("t", more=more)).collect()] == ["pap 가", None, "plain"]


def test_caseless():
    assert caseless_form("Straße ①") == "strasse 1"


def test_columns(spark):
    df = spark.createDataFrame([("ＡＢ",), (None,), ("",), ("Ab 가",), ("{Z}~",)], "t string")
    assert [r[0] for r in df.select(form("t")).collect()] == ["AB", None, "", "Ab 가", "{Z}~"]
    assert [r[0] for r in df.select(form("t", fold=True)).collect()] == ["ab", None, "", "ab 가", "{z}~"]


def test_pairs_against_brute_force(spark):
    texts = ["AB", "ＡB", "Ａ​B", "ab", "AB", "x y", "x y", None, "", "AB", "​", "﻿"]
    rows = [("title" if i % 5 else "text", f"k{i:02}", t) for i, t in enumerate(texts)] + [("title", "k01", "ＡB"), ("title", None, "AB")]
    got = sorted(map(tuple, alike_pairs(spark.createDataFrame(rows, "field string, key string, content string")).collect()))
    full = sorted({(f, k, t) for f, k, t in rows if k and t})
    want = sorted({(f, a, b) for f, a, s in full for g, b, t in full if f == g and a < b and s != t and visual_form(s) == visual_form(t)})
    assert got == want and want
    classes = alike_classes(spark.createDataFrame(rows, "field string, key string, content string"))
    assert classes.where("class_key > key").count() == 0
    assert classes.agg(F.count("*")).first()[0] == len(full)
    assert alike_pairs(spark.createDataFrame([], "field string, key string, content string")).count() == 0
