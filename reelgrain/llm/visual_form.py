"""Visually identical text with different characters: one form in which equal-looking texts are equal.

Width variants, presentation forms and ligatures are resolved by their compatibility decomposition, except where it
changes the look (raised, lowered, circled, squared, fractions); look-alike letters and marks become the Latin letter or
the common mark; every blank becomes U+0020 and characters without a shape disappear; the result is composed (NFC).
Beyond the listed look-alikes, the wide form takes in the public confusables data of Unicode, as the Unicode library in Spark
has them: letters to letters of the same case, digits to digits and marks to marks of ASCII.
With fold=True the form is for caseless search instead: full compatibility decomposition and full case folding.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrain.storage import materialize

# Code points that are ignorable by default (Unicode property Default_Ignorable_Code_Point).
IGNORABLE = [(0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]
# Letters of other scripts drawn like Latin letters, after canonical decomposition.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԚԜаеорсухѕіјһԁԛԝӏӀ", "ABESIJKMHOPCTYXYQWaeopcyxsijhdqwlI"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳϹ", "ABEZHIKMNOPTYXovcjC"))
ARMENIAN = dict(zip("ՕՍՏօոսհ", "OUSonuh"))
LATIN = dict(zip("ɑɡɩꓲꓳꓮꓐꓚꓓꓰꓖꓧꓙꓗꓡꓟꓠꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "agiIOABCDEGHJKLMNPRSTUVWXYZ"))
# Marks drawn like a common mark.
MARKS = {"·": "‧∙⋅・ㆍᆞ•᛫⸱·", "-": "‐‑‒–−⁃˗﹘➖Ⲻ", "'": "‘’‛′ʼʹ`´ꞌ", '"': "“”‟″ʺ", ":": "∶ː꞉։׃", "/": "⁄∕⧸", "*": "∗⁎", ",": "‚", "~": "〜∼˜⁓", "|": "∣ǀ⎪", "!": "ǃ", "<": "‹˂", ">": "›˃", ";": ";", ".": "․", "_": "ˍ", "[": "❲", "]": "❳"}
#: Kinds of compatibility decomposition that leave the look alike.
_ALIKE = ("<wide>", "<narrow>", "<small>", "<compat>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")
_PLAIN = r"^[ -_a-~가-힣]*$"
_BLANKS = "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85  ⠀"


def _one(ch: str) -> str | None:
    """What a code point of canonically decomposed text turns into; None if it stays."""
    o = ord(ch)
    if any(a <= o <= b for a, b in IGNORABLE):
        return ""
    cat = unicodedata.category(ch)
    if cat == "Zs" or ch in _BLANKS:
        return " "
    if cat in ("Cc", "Cf"):
        return ""
    for to, alike in MARKS.items():
        if ch in alike:
            return to
    for letters in (CYRILLIC, GREEK, ARMENIAN, LATIN):
        if ch in letters:
            return letters[ch]
    kind, _, rest = unicodedata.decomposition(ch).partition(" ")
    if kind not in _ALIKE or 0x3131 <= o <= 0x318E:
        return None
    parts = [chr(int(x, 16)) for x in rest.split()]
    if parts[0] == " " or kind == "<compat>" and ch in "№℀℁℅℆":
        return None  # spacing forms of combining marks stay what they are
    new = "".join(y if (y := _one(x)) is not None else x for p in parts for x in unicodedata.normalize("NFD", p))
    return None if new == ch else new


@lru_cache(maxsize=1)
def _table() -> dict[int, str]:
    # single jamo that no syllable took in are drawn like the letters of the compatibility block
    return {o: new for o in range(0x7F, sys.maxunicode + 1) if not 0xAC00 <= o <= 0xD7A3 and not 0xD800 <= o <= 0xDFFF and (new := _one(chr(o))) is not None} | {o: "" for o in range(32) if chr(o) not in _BLANKS} | {ord(c): " " for c in _BLANKS} | {0x60: "'"}


@lru_cache(maxsize=1)
def _jamo() -> dict[int, str]:
    """Conjoining letters that stand alone, as letters of the compatibility block."""
    by = {unicodedata.decomposition(chr(o)).split()[-1]: chr(o) for o in range(0x3131, 0x318F)}
    vowels_and_heads = {int(k, 16): v for k, v in by.items()}
    finals = {0x11A8 + i: c for i, c in enumerate("ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ")}
    return vowels_and_heads | finals


_plain = re.compile(_PLAIN)


#: Kinds of compatibility decomposition that are another look: raised, lowered, enclosed.
_OTHER_LOOK = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")
#: Scripts whose letters stand for themselves, whatever they resemble.
_OWN = ("CJK", "HANGUL", "HIRAGANA", "KATAKANA", "IDEOGRAPHIC", "BOPOMOFO", "KANGXI")


def _class(ch: str) -> str:
    """Letters by case, digits, marks; letters without case go with the small ones."""
    kind = unicodedata.category(ch)
    return "upper" if kind in ("Lu", "Lt") else "lower" if kind in ("Ll", "Lo") else "digit" if kind == "Nd" else "mark" if kind[0] in "PS" and kind != "Sk" or kind == "Lm" else "none"


@lru_cache(maxsize=2)
def _confusables(jvm) -> dict[int, str]:
    known = _table()
    chars = [c for o in range(0x80, 0x20000) if o not in known and (c := chr(o)) and unicodedata.category(c) not in ("Cn", "Cs", "Co") and unicodedata.normalize("NFD", c) == c and not unicodedata.name(c, "").startswith(_OWN) and unicodedata.decomposition(c).split(" ")[0] not in _OTHER_LOOK]
    ascii_ = [chr(o) for o in range(33, 127)]
    skeletons = getattr(jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build().getSkeleton("\n".join(ascii_ + chars)).split("\n")
    to: dict[tuple[str, str], str] = {}
    for c, s in zip(ascii_, skeletons):
        to.setdefault((s, _class(c)), c)
    return {ord(c): x for c, s in zip(chars, skeletons[len(ascii_) :]) if (x := to.get((s, _class(c)))) is not None}


def confusables(spark: SparkSession) -> dict[int, str]:
    """Code points beyond the table of visual_form that are drawn like an ASCII character of their class; read once."""
    return _confusables(spark._jvm)


def visual_form(text: str, more: dict[int, str] | None = None) -> str:
    """The form of one text; texts look the same to a reader if and only if their forms are equal. `more` as from confusables."""
    if _plain.match(text):
        return text
    text = unicodedata.normalize("NFD", text).translate(_table())
    text = unicodedata.normalize("NFC", text.translate(more) if more else text)
    return text.translate(_jamo()) if re.search("[ᄀ-ᇿ]", text) else text


def caseless_form(text: str) -> str:
    """The form for search: full compatibility decomposition, full case folding, no look-alikes left."""
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", visual_form(text)).casefold())


def _per_distinct(values: pd.Series, form) -> pd.Series:
    codes, names = pd.factorize(values)
    forms = np.array([form(x) for x in names] + [None], object)
    return pd.Series(forms[codes])


@F.pandas_udf(T.StringType())
def _visual(values: pd.Series) -> pd.Series:
    return _per_distinct(values, visual_form)


@F.pandas_udf(T.StringType())
def _caseless(values: pd.Series) -> pd.Series:
    return _per_distinct(values, caseless_form)


def _wide(more: dict[int, str]):
    @F.pandas_udf(T.StringType())
    def wide(values: pd.Series) -> pd.Series:
        return _per_distinct(values, lambda x: visual_form(x, more))

    return wide


def form(text: str | Column, fold: bool = False, more: dict[int, str] | None = None) -> Column:
    """Column of the form, with the look-alikes of `more` too if given; null stays null. Texts of plain characters never leave the JVM."""
    c = F.col(text) if isinstance(text, str) else text
    if more:
        return F.coalesce(_wide(more)(F.when(~c.rlike(_PLAIN), c)), c)
    if fold:
        return F.coalesce(_caseless(F.when(~c.rlike(r"^[ -_a-z{-~가-힣&&[^A-Z]]*$"), c)), c)
    return F.coalesce(_visual(F.when(~c.rlike(_PLAIN), c)), c)


def _keyed(contents: DataFrame) -> DataFrame:
    """field, key, two hashes of the form and one of the content, for rows with a key and a content."""
    rows = contents.where("key is not null and content is not null and content <> ''")
    rows = rows.select("field", F.col("key").cast("string").alias("key"), F.xxhash64("content").alias("c"), form("content", more=confusables(contents.sparkSession)).alias("form"))
    return rows.select("field", "key", "c", F.xxhash64("form").alias("f1"), F.xxhash64(F.lit(1), "form").alias("f2"))


def alike_pairs(contents: DataFrame) -> DataFrame:
    """field, key_a, key_b: pairs of different keys, key_a < key_b, whose contents look the same in different characters.

    contents: field, key, content. Nulls and empty contents take part in no pair, repeated rows count once. The rows of a
    form meet by classes of equal content, so every pair that is looked at is a pair of the result.
    """
    rows = materialize(_keyed(contents))
    group = ["field", "f1", "f2"]
    several = rows.groupBy(*group).agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select(*group)
    rows = materialize(rows.join(several, group, "left_semi").distinct())
    classes = rows.select(*group, "c").distinct()
    couples = classes.join(classes.withColumnRenamed("c", "d"), group).where("c < d")
    left = couples.join(rows.withColumnRenamed("key", "a"), [*group, "c"])
    right = rows.select(*group, F.col("c").alias("d"), F.col("key").alias("b"))
    pairs = left.join(right, [*group, "d"]).where("a <> b")
    return pairs.select("field", F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))


def alike_classes(contents: DataFrame) -> DataFrame:
    """field, key, class_key, n_keys, n_contents: a row per key and class of equal-looking contents, named by its least key."""
    rows = _keyed(contents).distinct()
    group = ["field", "f1", "f2"]
    classes = rows.groupBy(*group).agg(F.min("key").alias("class_key"), F.countDistinct("key").alias("n_keys"), F.countDistinct("c").alias("n_contents"))
    return rows.select(*group, "key").distinct().join(classes, group).drop("f1", "f2")
