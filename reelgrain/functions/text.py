"""Scalar text functions as column expressions, inside the JVM wherever SQL can say it."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: characters that the phrase form replaces by a blank.
PHRASE_MARKS = "。、，．・「」『』''‥…—–·〈〉《》【】｢｣〔〕,.!?;:()[]{}-—–…\"'`~@#$%^&*+=|\\/<>"
# Fixed value: characters that the transcript form deletes.
TRANSCRIPT_MARKS = ".。,，?？!！~～…‥\"'`、"
# Meta marks in transcripts, and Korean fillers.
META = r"(?s)\[.*?\]|\(.*?\)|<.*?>|\*.*?\*|♪.*?♪|♪"
FILLERS = r"(?U)\b음+[~ㅡ]*\b|\b어+\b|\b에+\b|\b아+\b|\b그러니까\b|\b그래서\b"


def _class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[ \\t\\n\\r\\f\\x0B]+", " "))


def ascii_phrase(c: Column) -> Column:
    """Phrase form for text of ASCII and precomposed letters, without leaving the JVM."""
    return squeezed(F.regexp_replace(F.lower(c), _class(PHRASE_MARKS), " "))


@F.pandas_udf(T.StringType())
def phrase(values: pd.Series) -> pd.Series:
    """Phrase form: NFKC, case folding, marks to blanks, single blanks."""
    marks = re.compile("[" + re.escape(PHRASE_MARKS) + "]")
    one = lambda x: None if x is None else " ".join(marks.sub(" ", unicodedata.normalize("NFKC", x).casefold()).split())
    return values.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def composed(values: pd.Series) -> pd.Series:
    return values.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def transcript_form(c: Column) -> Column:
    """NFC, meta marks and punctuation deleted, single blanks, ASCII letters in lower case. Only texts that may change under
    NFC go through Python."""
    plain = c.rlike(r"^[\x{0}-\x{2FF}\x{2000}-\x{206F}\x{2600}-\x{26FF}\x{3000}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{FF00}-\x{FFEF}]*$")
    nfc = F.coalesce(composed(F.when(~plain, c)), c)
    return ascii_lower(squeezed(F.regexp_replace(F.regexp_replace(nfc, META, ""), _class(TRANSCRIPT_MARKS), "")))


def without_fillers(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, FILLERS, ""), " {2,}", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")


def change_rate(source: Column, target: Column) -> Column:
    """Symmetric difference over union of two word sets; 0 if both are empty."""
    s, t = F.array_distinct(source), F.array_distinct(target)
    both = F.size(F.array_union(s, t))
    return F.when(both == 0, 0.0).otherwise((F.size(F.array_except(s, t)) + F.size(F.array_except(t, s))) / F.when(both > 0, both))


def new_terms(source: Column, target: Column) -> Column:
    return F.size(F.array_except(F.array_distinct(target), F.array_distinct(source))).cast("long")


def hms(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60))


def srt_seconds(c: Column) -> Column:
    part = lambda i: F.regexp_extract(c, r"^(\d+):(\d{2}):(\d{2})[,.](\d{3})$", i).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000


def iso_seconds(c: Column) -> Column:
    """Seconds of PT#H#M#S; 0 where the text is none."""
    whole = F.coalesce(F.regexp_extract(c, r"^PT(?:\d+H)?(?:\d+M)?(?:\d+S)?$", 0), F.lit(""))
    take = lambda unit: F.coalesce(F.regexp_extract(whole, rf"(\d+){unit}", 1).try_cast("long"), F.lit(0))
    return take("H") * 3600 + take("M") * 60 + take("S")


def guarded(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), c)).otherwise(c)


def mapped(c: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


# Origins of captions.
ORIGIN = {"whisper": "asr", "captions_api": "api", "transcript_api": "api", "manual": "manual"}
ORIGIN_ORDER = ("manual", "asr", "api", "unknown")


def origin_pair(a: Column, b: Column) -> Column:
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in ORIGIN_ORDER]), c)
    return F.when(rank(a) <= rank(b), F.concat_ws("-", a, b)).otherwise(F.concat_ws("-", b, a))


def miss_class(primary: Column, fallback: Column, privacy: Column) -> Column:
    """Why a transcript is missing, from the names of the two errors (null: none) and the privacy of the video."""
    return (
        F.when(F.contains(F.coalesce(primary, F.lit("")), F.lit("TranscriptsDisabled")), "transcripts_disabled")
        .when(F.lower(F.coalesce(privacy, F.lit(""))).isin("private", "unlisted"), "private_no_captions_api")
        .when(F.contains(F.coalesce(primary, F.lit("")), F.lit("NoTranscriptFound")) & fallback.isNull(), "no_caption_track")
        .when(primary.isNotNull() | fallback.isNotNull(), "api_error")
        .otherwise("unknown")
    )


def slug(*parts: Column) -> Column:
    clean = [F.regexp_replace(F.regexp_replace(p, r"\.\.|[/\\]", ""), r"\s+", "_") for p in parts]
    return F.concat_ws("_", *clean)


def professor_names(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"^[() ]+|[() ]+$", ""), "/"), lambda x: F.trim(x)), lambda x: x != "")


# Keywords of supplementary videos.
SUPPLEMENTARY = ("핵심영상", "보완영상", "질문응답", "보충", "특강", "OT")


def category(title: Column) -> Column:
    hit = F.lit(False)
    for k in SUPPLEMENTARY:
        hit = hit | F.contains(title, F.lit(k))
    return F.when(hit, "supplementary").otherwise("regular")


class _Body(HTMLParser):
    """What stands between the body tags: tags, attributes and text; references resolved, comments left out."""

    def __init__(self) -> None:
        super().__init__()
        self.inside, self.parts = False, []

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.inside = True
        elif self.inside:
            self.parts.append("<" + tag + "".join(f" {k}" if v is None else f' {k}="{v}"' for k, v in attrs) + ">")

    def handle_endtag(self, tag):
        if tag == "body":
            self.inside = False
        elif self.inside:
            self.parts.append(f"</{tag}>")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def body_of(page: str) -> str:
    reader = _Body()
    reader.feed(page)
    return "".join(reader.parts)


@F.pandas_udf(T.StringType())
def html_body(pages: pd.Series) -> pd.Series:
    """The inner HTML of each page's body; empty where there is none."""
    return pages.map(body_of, na_action="ignore")
