"""Variant spellings of names typed by people, linked to the person they mean.

Spellings are read into tokens that scripts and typing habits leave alike (syllables of Hangul, romanised in one way;
keyboard slips decoded; titles dropped). MinHash bands over their padded q-grams give candidates among the spellings known
for the same course; the number of bands follows from the collision curve for the least similarity and the recall wanted.
Candidates are verified by Monge-Elkan similarity and the register's spellings are clustered by star clustering.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrain.llm.visual_form import form, visual_form
from reelgrain.storage import materialize

#: Least similarity of q-gram sets that shall meet, and with what probability; similarity from which spellings are one name.
LEAST_JACCARD, RECALL, ALIKE, ALIKE_IN_GROUP, ALIKE_ANYWHERE, LEAD = 0.35, 0.99, 0.8, 0.85, 0.95, 0.04
#: Hashes that must agree for two names to share a band.
ROWS = 2
#: A register of at most so many rows (times its courses and bands some 20 bytes) is broadcast; beyond it, shuffled.
BROADCAST_ROWS = 5_000

# Letters of the Revised Romanization, the Korean two-set keyboard, surnames, nicknames and titles.
HEADS = "g kk n d tt r m b pp s ss  j jj ch k t p h".split(" ")
VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
TAILS = " k k k n n n t l l l l l l l l m p p t t ng t t k t p t".split(" ")
KEYS = dict(zip("rRseEfaqQtTdwWczxvgkoiOjpuPhynbml", "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎㅏㅐㅑㅒㅓㅔㅕㅖㅗㅛㅜㅠㅡㅣ"))
_HEAD_LETTERS, _VOWEL_LETTERS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ", "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
_TAIL_LETTERS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
_DOUBLE = {"ㅗㅏ": "ㅘ", "ㅗㅐ": "ㅙ", "ㅗㅣ": "ㅚ", "ㅜㅓ": "ㅝ", "ㅜㅔ": "ㅞ", "ㅜㅣ": "ㅟ", "ㅡㅣ": "ㅢ", "ㄱㅅ": "ㄳ", "ㄴㅈ": "ㄵ", "ㄴㅎ": "ㄶ", "ㄹㄱ": "ㄺ", "ㄹㅁ": "ㄻ", "ㄹㅂ": "ㄼ", "ㄹㅅ": "ㄽ", "ㅂㅅ": "ㅄ"}
SURNAMES = {
    "강": "kang gang", "고": "ko go", "구": "koo gu ku", "권": "kwon gwon", "김": "kim gim", "나": "na ra", "남": "nam", "노": "noh roh no", "류": "ryu yoo yu ryoo lyu", "문": "moon mun", "민": "min", "박": "park pak bak", "배": "bae pae", "백": "baek paik", "서": "seo suh so", "성": "sung seong", "손": "son sohn", "송": "song soung", "신": "shin sin", "심": "shim sim", "안": "ahn an", "양": "yang", "오": "oh o", "우": "woo u", "유": "yoo yu", "윤": "yoon yun", "이": "lee yi i rhee li", "임": "lim im rim", "장": "jang chang", "전": "jeon chun jun", "정": "jung jeong chung", "조": "cho jo", "주": "joo ju", "진": "jin", "차": "cha", "최": "choi choe", "하": "ha", "한": "han hahn", "허": "heo hur huh", "홍": "hong houng", "황": "hwang whang",
}
NICKNAMES = {
    "patricia": "pat patty trish tricia", "theodore": "ted teddy theo", "michael": "mike mick micky", "elizabeth": "liz beth betty eliza lizzie", "margaret": "maggie meg peggy marge greta", "nathaniel": "nate nat nathan", "frederick": "fred freddie freddy fritz rick", "william": "will bill billy", "robert": "rob bob bobby", "richard": "rich dick rick", "katherine": "kate kathy katie cathy", "james": "jim jimmy jamie", "john": "jack johnny", "thomas": "tom tommy", "edward": "ed eddie ted", "charles": "charlie chuck", "joseph": "joe joey", "susan": "sue susie", "alexander": "alex sandy", "benjamin": "ben benny", "samuel": "sam sammy", "daniel": "dan danny", "matthew": "matt", "christopher": "chris kit", "anthony": "tony", "andrew": "andy drew", "jennifer": "jen jenny", "rebecca": "becky", "deborah": "deb debbie", "victoria": "vicky tori", "gregory": "greg", "stephen": "steve", "timothy": "tim", "nicholas": "nick", "jonathan": "jon", "philip": "phil", "dorothy": "dot dolly", "eleanor": "ellie nell", "abigail": "abby", "gabriel": "gabe", "leonard": "leo lenny", "lawrence": "larry", "raymond": "ray", "ronald": "ron", "walter": "walt", "zachary": "zach",
}
TITLES = r"(?:교수님?|선생님?|강사님?|쌤|박사님?|(?<![a-z])(?:professor|prof|dr|mr|mrs|ms|instructor|lecturer)(?![a-z])\.?)"

_surname_of: dict[str, set[str]] = {}
for _k, _v in SURNAMES.items():
    for _x in _v.split():
        _surname_of.setdefault(_x, set()).add(_k)
_full_name: dict[str, set[str]] = {}
for _k, _v in NICKNAMES.items():
    for _x in [_k, *_v.split()]:
        _full_name.setdefault(_x, set()).add(_k)


def _split(ch: str) -> tuple[int, int, int]:
    o = ord(ch) - 0xAC00
    return o // 588, o // 28 % 21, o % 28


def _sound(token: str) -> str:
    """A romanised token without the differences between ways of romanising."""
    for a, b in (("wh", "hw"), ("oo", "u"), ("ou", "o"), ("ee", "i"), ("eo", "e"), ("eu", "u"), ("ae", "e"), ("oe", "e"), ("uh", "e"), ("ah", "a"), ("oh", "o"), ("ch", "j"), ("sh", "s"), ("g", "k"), ("d", "t"), ("b", "p"), ("r", "l")):
        token = token.replace(a, b)
    return token


@lru_cache(maxsize=100_000)
def _syllable_sound(ch: str) -> str:
    h, v, t = _split(ch)
    return _sound(HEADS[h] + VOWELS[v] + TAILS[t])


@lru_cache(maxsize=100_000)
def _initials(ch: str) -> str:
    """Latin letters with which the romanised syllable may begin."""
    if ch == "*":
        return "abcdefghijklmnopqrstuvwxyz"
    h, v, _ = _split(ch)
    first = (HEADS[h] + VOWELS[v])[0]
    return first + {"g": "k", "k": "g", "d": "t", "t": "d", "b": "p", "p": "b", "r": "l", "j": "c", "c": "j"}.get(first, "")


@lru_cache(maxsize=200_000)
def _syllables_alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if "*" in (a, b):
        return 0.85
    x, y = _split(a), _split(b)
    return sum(p == q for p, q in zip(x, y)) / 3 if (x[2] or y[2]) else (sum(p == q for p, q in zip(x[:2], y[:2]))) / 2


def typed_hangul(keys: str) -> str | None:
    """What a text typed on a Korean keyboard in Latin mode was meant to be; None unless it gives whole syllables."""
    if not re.fullmatch(r"[a-zQWERTOP]{4,16}", keys):
        return None
    letters = [KEYS.get(k) or KEYS.get(k.lower()) for k in keys]
    if None in letters:
        return None
    out, i, n = "", 0, len(letters)
    while i < n:
        if letters[i] not in _HEAD_LETTERS or i + 1 >= n or letters[i + 1] not in _VOWEL_LETTERS:
            return None
        head, vowel, i = letters[i], letters[i + 1], i + 2
        if i < n and (d := _DOUBLE.get(vowel + letters[i])) and d in _VOWEL_LETTERS:
            vowel, i = d, i + 1
        tail = " "
        if i < n and letters[i] in _TAIL_LETTERS and not (i + 1 < n and letters[i + 1] in _VOWEL_LETTERS):
            tail, i = letters[i], i + 1
            if i < n and (d := _DOUBLE.get(tail + letters[i])) and d in _TAIL_LETTERS and not (i + 1 < n and letters[i + 1] in _VOWEL_LETTERS):
                tail, i = d, i + 1
        out += chr(0xAC00 + _HEAD_LETTERS.index(head) * 588 + _VOWEL_LETTERS.index(vowel) * 28 + _TAIL_LETTERS.index(tail))
    return out


class Name:
    """A spelling as read: Hangul syllables (with * for hidden ones) or Latin tokens."""

    __slots__ = ("hangul", "latin", "titled")

    def __init__(self, spelling: str) -> None:
        s = unicodedata.normalize("NFKC", visual_form(spelling))
        s = re.sub(r"\([^()]*\)", " ", s) if re.sub(r"\([^()]*\)", "", s).strip() else s.replace("(", " ").replace(")", " ")
        bare = re.sub(rf"(?i){TITLES}", " ", s)
        self.titled = bare != s
        bare = bare.strip(" .,/-_")
        self.hangul, self.latin = "", []
        if re.search("[가-힣]", bare):
            x = re.sub(r"(?<=[가-힣 ])[OX0○●◯*_](?=[가-힣 ]|$)|[○●◯*]", "*", bare)
            self.hangul = "".join(re.findall(r"[가-힣*]", x))
        else:
            tokens = re.findall(r"[^\W\d_]+", re.sub(r"(?<=\w)[-'’](?=\w)", "", unicodedata.normalize("NFD", bare)).encode("ascii", "ignore").decode())
            typed = typed_hangul(tokens[0]) if len(tokens) == 1 and tokens[0][0].islower() else None
            if typed and 2 <= len(typed) <= 3:
                self.hangul = typed
            else:
                self.latin = [t.lower() for t in tokens]

    def grams(self) -> set[str]:
        """Padded q-grams (q = 2) over the sounds of surname, given name and initials."""
        out: set[str] = set()
        if self.hangul:
            known = [_syllable_sound(c) for c in self.hangul if c != "*"]
            words = known + ["".join(_syllable_sound(c) for c in self.hangul[1:] if c != "*")]
            starts = known
        else:
            words = []
            for t in self.latin:
                sur = _surname_of.get(t)
                words += [_syllable_sound(x) for x in sur] if sur else []
                words.append(_sound(t))
                words += [_sound(x) for x in _full_name.get(t, ())]
            starts = words
        for w in words:
            out.update(w[i : i + 2] for i in range(len(w) - 1))
        out.update("^" + w[0] for w in starts if w)
        if self.hangul:
            out.update("^" + x for c in self.hangul if c != "*" for x in _initials(c))
        return out


@lru_cache(maxsize=200_000)
def _edits(a: str, b: str) -> float:
    """1 minus the edit distance (with neighbouring swaps) over the longer length."""
    if a == b:
        return 1.0
    prev2, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if prev2 is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        prev2, prev = prev, row
    return 1 - prev[-1] / max(len(a), len(b))


def _monge_elkan(a: list[str], b: list[str], alike) -> float:
    return sum(max(alike(x, y) for y in b) for x in a) / len(a)


def _latin_tokens(x: str, y: str) -> float:
    if x == y:
        return 1.0
    if _surname_of.get(x, set()) & _surname_of.get(y, set()) or _full_name.get(x, set()) & _full_name.get(y, set()):
        return 0.97
    if min(len(x), len(y)) == 1:
        return 0.85 if x[0] == y[0] else 0.0
    return max(_edits(x, y), _edits(_sound(x), _sound(y)) - 0.02)


#: Orders in which three syllables of a name come: as written, given name first, syllables of the given name swapped.
_ORDERS = (((0, 1, 2), 0.0), ((1, 2, 0), 0.03), ((2, 0, 1), 0.03), ((0, 2, 1), 0.04))


def _hangul_hangul(a: str, b: str) -> float:
    """Monge-Elkan over syllables that pair off one to one, in one of the usual orders."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < 2:
        return 0.0
    if len(a) == 2 and len(b) == 3:  # a given name alone
        return 0.92 * (_syllables_alike(a[0], b[1]) + _syllables_alike(a[1], b[2])) / 2
    if len(a) == len(b):
        if "*" in a + b:  # what is hidden is no typing slip: the rest must be the same
            alike = [_syllables_alike(x, y) for x, y in zip(a, b)]
            return sum(alike) / len(alike) - (0.1 if any(s < 1 for s, x, y in zip(alike, a, b) if "*" not in (x, y)) else 0.0)
        orders = _ORDERS if len(a) == 3 else (((*range(len(a)),), 0.0),)
        return max(sum(_syllables_alike(x, b[i]) for x, i in zip(a, order)) / len(a) - cost for order, cost in orders)
    if len(b) == len(a) + 1:  # a syllable too many
        return max((sum(map(_syllables_alike, a, b[:i] + b[i + 1 :])) / len(a) for i in range(len(b))), default=0.0) - 0.06
    return 0.0


def _latin_hangul(tokens: list[str], h: str) -> float:
    if len(h) < 2 or not tokens:
        return 0.0
    given = [_syllable_sound(c) if c != "*" else "" for c in h[1:]]
    initials = [_initials(c) for c in h[1:]]
    best = 0.0
    for i, t in enumerate(tokens):
        rest = tokens[:i] + tokens[i + 1 :]
        sur = 1.0 if h[0] in _surname_of.get(t, ()) else max(_edits(_sound(t), _sound(v)) for v in SURNAMES.get(h[0], _syllable_sound(h[0]) or "?").split()) - 0.1
        if sur < 0.6 or not rest:
            continue
        if all(len(x) == 1 for x in rest):
            fits = len(rest) <= len(initials) and all(x in i for x, i in zip(rest, initials))
            g = 0.0 if not fits else 0.86 if len(rest) == len(initials) else 0.7
        else:
            g = _edits(_sound("".join(rest)), "".join(given))
            g = max(g, 0.97 if _sound("".join(rest[::-1])) == "".join(given) else 0.0)
        best = max(best, (sur + g) / 2)
    if len(tokens) <= 2:  # a given name alone
        best = max(best, 0.9 * _edits(_sound("".join(tokens)), "".join(given)))
    return best


def similarity(a: Name, b: Name) -> float:
    """Monge-Elkan similarity of two readings, 0 to 1."""
    if a.hangul and b.hangul:
        return _hangul_hangul(a.hangul, b.hangul)
    if a.hangul or b.hangul:
        return _latin_hangul(a.latin or b.latin, a.hangul or b.hangul)
    x, y = sorted((a.latin, b.latin), key=len)
    if not x:
        return 0.0
    one = _monge_elkan(x, y, _latin_tokens)
    if len(x) == 1 and len(y) > 1:  # one part alone
        return 0.9 * one
    whole = _edits(_sound("".join(sorted(x))), _sound("".join(sorted(y)))) - 0.02
    return max((one + _monge_elkan(y, x, _latin_tokens)) / 2, whole)


def bands(least: float = LEAST_JACCARD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of `rows` hashes each: the collision curve 1 - (1 - s**rows)**b reaches the recall at the least similarity."""
    return math.ceil(math.log(1 - recall) / math.log(1 - least**rows))


_rnd = np.random.default_rng(20240101)
_A, _B = _rnd.integers(1, 1 << 61, 512, dtype=np.uint64) | np.uint64(1), _rnd.integers(0, 1 << 61, 512, dtype=np.uint64)


@lru_cache(maxsize=100_000)
def _hashes(gram: str, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = _A[:n] * np.uint64(zlib.crc32(gram.encode()) + 1) + _B[:n]
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def band_hashes(grams: set[str], n: int, rows: int = ROWS) -> np.ndarray:
    """A hash for each of n bands, of `rows` min-hashes each; none without grams."""
    if not grams:
        return np.zeros(0, np.int64)
    least = np.min([_hashes(g, n * rows) for g in grams], axis=0).reshape(n, rows)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            out = (out ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _signatures(n: int):
    """For mapInPandas over rows with `name`: the same rows with `bands`, an array of n hashes (empty if nothing is read)."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["bands"] = [band_hashes(Name(name).grams(), n) for name in frame["name"]]
            yield frame

    return sign


def _scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    readings: dict[str, Name] = {}

    def read(s: str) -> Name:
        if s not in readings:
            if len(readings) > 200_000:
                readings.clear()
            readings[s] = Name(s)
        return readings[s]

    for frame in frames:
        frame["score"] = [1.0 if a == b else similarity(read(a), read(b)) for a, b in zip(frame["name"], frame["spelling"])]
        yield frame[frame["score"] >= ALIKE]


def _signed(rows: DataFrame, *keep: str) -> DataFrame:
    kinds = dict(rows.dtypes)
    cols = ["name", *keep]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", bands array<long>"
    return rows.select(*cols).mapInPandas(_signatures(bands()), schema)


def _meeting(items: DataFrame, known: DataFrame, keep: list[str]) -> DataFrame:
    """Items and known spellings of the same course that share a band; `course` null meets any course."""
    band = [F.posexplode("bands").alias("band", "hash")]
    left = _signed(items, "course", *keep).select("name", "course", *keep, *band)
    right = _signed(known, "course", "detail_id").select(F.col("name").alias("spelling"), "course", "detail_id", *band)
    with_any = right.unionByName(right.withColumn("course", F.lit(None).cast("string")).distinct())
    rows = left.join(with_any, left.course.eqNullSafe(with_any.course) & (left.band == with_any.band) & (left.hash == with_any.hash))
    return rows.select("name", left.course, *keep, "spelling", "detail_id").distinct()


def _scores(pairs: DataFrame) -> DataFrame:
    return pairs.mapInPandas(_scored, ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes) + ", score double")


def register(details: DataFrame, results: DataFrame) -> DataFrame:
    """A row per spelling and course of the register: detail_id, name, course; courses also from results typed exactly so.

    A spelling without courses has a row whose course is null.
    """
    rows = details.where("professor_name is not null and detail_id is not null").select("detail_id", F.col("professor_name").alias("name"), "courses")
    own = rows.select("detail_id", "name", F.explode_outer("courses").alias("course"))
    seen = results.where("professor is not null and course is not null").select(F.col("professor").alias("name"), "course").distinct()
    seen = seen.join(F.broadcast(rows.select("detail_id", "name")) if rows.count() <= BROADCAST_ROWS else rows.select("detail_id", "name"), "name")
    whole = F.col("name").rlike("^[가-힣]{3}$") | F.col("name").rlike("^[A-Z][a-z]{2,} [A-Z][a-z]{3,}$")
    return own.unionByName(seen.where(whole).select("detail_id", "name", "course")).distinct()


@F.pandas_udf(T.BooleanType())
def _whole(names: pd.Series) -> pd.Series:
    """Whether a spelling has all parts of a name: no syllable hidden, no initials, nothing left out."""
    read = [Name(x) for x in names]
    return pd.Series([("*" not in n.hangul and len(n.hangul) >= 3) if n.hangul else len(n.latin) >= 2 and min(map(len, n.latin)) >= 2 for n in read])


def persons(known: DataFrame) -> DataFrame:
    """detail_id, person: star clustering of the register's rows; person is the least detail_id of the star's rows.

    Rows with similar names that share a course are linked. In turn the row with most links (then the least detail_id),
    whole names before names with parts hidden, shortened or left out, which may mean several people, among those not taken becomes a centre and takes its free neighbours, in rounds: a row is a centre once none of its
    free neighbours comes before it.
    """
    taught = known.where("course is not null")
    items = taught.withColumnRenamed("detail_id", "other")
    pairs = _scores(_meeting(items, taught, ["other"]).where("other <> detail_id"))
    links = materialize(pairs.select(F.col("other").alias("a"), F.col("detail_id").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score")))
    degree = links.groupBy("a").agg(F.sum("score").alias("degree"))
    whole = known.select("detail_id", _whole("name").alias("whole")).groupBy(F.col("detail_id").alias("a")).agg(F.max("whole").alias("whole"))
    # whole names come first: no sum of scores reaches the number of links
    nodes = whole.join(degree, "a", "left").na.fill(0.0, ["degree"])
    nodes = nodes.select("a", (F.col("degree") + F.when(F.col("whole"), float(1 << 40)).otherwise(0.0)).alias("degree"))
    free = materialize(nodes)
    stars: DataFrame | None = None
    while free.head(1):
        both = links.join(free, "a").join(free.withColumnsRenamed({"a": "b", "degree": "degree_b"}), "b")
        earlier = both.where("degree_b > degree or (degree_b = degree and b < a)").select("a").distinct()
        centres = free.join(earlier, "a", "left_anti").select("a")
        taken = both.join(centres, "a").groupBy("b").agg(F.max_by("a", F.struct("score", -F.col("a"))).alias("centre"))
        taken = taken.join(centres.withColumnRenamed("a", "b"), "b", "left_anti").select(F.col("b").alias("a"), "centre")
        new = materialize(taken.unionByName(centres.select("a", F.col("a").alias("centre"))))
        stars = new if stars is None else stars.unionByName(new)
        free = materialize(free.join(new.select("a"), "a", "left_anti"))
    if stars is None:
        return nodes.select(F.col("a").alias("detail_id"), F.col("a").alias("person"))
    least = stars.groupBy("centre").agg(F.min("a").alias("person"))
    return stars.join(least, "centre").select(F.col("a").alias("detail_id"), "person")


def course_groups(known: DataFrame) -> dict[str, str]:
    """Courses that people teach together, as name of the least one; as many entries as the register has courses."""
    group: dict[str, str] = {}

    def find(x: str) -> str:
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    taught = known.where("course is not null").groupBy("detail_id").agg(F.sort_array(F.collect_set("course")).alias("courses")).select("courses").distinct()
    for (courses,) in taught.collect():
        for c in courses[1:]:
            a, b = sorted((find(courses[0]), find(c)))
            group[b] = a
        find(courses[0])
    return {x: find(x) for x in group}


def _best(pairs: DataFrame, people: DataFrame, *keep: str) -> DataFrame:
    """The person most alike, if no other comes near."""
    by = pairs.join(people, "detail_id").groupBy("name", *keep, "person").agg(F.max("score").alias("score"))
    w = Window.partitionBy("name", *keep).orderBy(F.desc("score"), "person")
    ranked = by.withColumn("next", F.lead("score").over(w)).withColumn("place", F.row_number().over(w))
    return ranked.where((F.col("place") == 1) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= LEAD)).select("name", *keep, "person")


def linked(items: DataFrame, known: DataFrame, people: DataFrame) -> DataFrame:
    """name, course, person: the person whose spellings are most like the name, if clearly one is.

    First among the spellings known for the course; names that are like none of these (a guest in another's course) among
    those of courses taught by the same people; items without a course, or with one that the register doesn't have, among all,
    where they need to be nearly the same.
    """
    items = items.select("name", "course").distinct()
    groups = course_groups(known)
    small = lambda rows: F.broadcast(rows) if len(groups) <= BROADCAST_ROWS else rows
    foreign = materialize(items.where("course is not null").join(small(known.where("course is not null").select("course").distinct()), "course", "left_anti"))
    anywhere = foreign.select("name", F.lit(None).cast("string").alias("course"))
    pairs = materialize(_scores(_meeting(items.unionByName(anywhere).distinct(), known, [])))
    first = materialize(_best(pairs.where(F.col("course").isNotNull() | (F.col("score") >= ALIKE_ANYWHERE)), people, "course"))
    first = first.unionByName(first.where("course is null").select("name", "person").join(foreign, "name").select("name", "course", "person"))
    if not groups:
        return first
    table = items.sparkSession.createDataFrame(sorted(groups.items()), "course string, group string")
    tried = items.where("course is not null").join(pairs.select("name", "course").distinct(), ["name", "course"], "left_anti")
    wide = known.join(small(table), "course").select("detail_id", "name", F.col("group").alias("course")).distinct()
    left = tried.join(small(table), "course")
    again = _scores(_meeting(left.select("name", F.col("group").alias("course")).distinct(), wide, [])).where(F.col("score") >= ALIKE_IN_GROUP)
    second = _best(again, people, "course").withColumnRenamed("course", "group")
    return first.unionByName(left.join(second, ["name", "group"]).select("name", "course", "person"))


# Parts of titles that are no names.
_NO_NAME = r"(?i)\(영상 *\d+\)|no\.\s*\d+|vod-\d+|#\d+|\d{2,4}학년도|[12]학기|(?<!\d)\d{2,4}-[12]\.?(?!\d)|(?<!\d)20\d\d(?!\d)|\d+주차|\d+차시(?:-\d+)?|week \d+|session \d+|review clip|질의·응답|강의영상|특강|보충|(?<![a-z])ot(?![a-z])|\[[^\]]*\]|[가-힣]+과(?=\s|\)|$)|교양"


def _title_names(courses: list[str]):
    def names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        found = ahocorasick.Automaton()  # all courses at once, however many
        for c in courses:
            key = unicodedata.normalize("NFKC", visual_form(c)).casefold()
            if key and (key not in found or found.get(key)[2] > c):
                found.add_word(key, (len(key), key, c))
        if len(found):
            found.make_automaton()
        for frame in frames:
            out = []
            for video, title in zip(frame["video_id"], frame["title"]):
                t = unicodedata.normalize("NFKC", visual_form(title))
                folded, course = t.casefold(), None
                hits = [x for _, x in found.iter(folded)] if len(found) and len(folded) == len(t) else []
                if hits:
                    size, key, course = min(hits, key=lambda x: (-x[0], x[2]))
                    at = folded.find(key)
                    t = t[:at] + " | " + t[at + size :]
                rest = re.sub(_NO_NAME, " | ", t)
                rest = re.sub(r"[()\[\]_]| - |^\s*-|-\s*$", " | ", rest) if "쌤)" not in rest else re.sub(r"[\[\]_]| - |^\s*-|-\s*$", " | ", rest)
                for chunk in re.split(r"[|/]", rest):
                    chunk = chunk.strip(" -·,_")
                    if len(re.findall(r"[^\W\d_]", chunk)) >= 2:
                        out.append((video, title, chunk, course))
            yield pd.DataFrame(out, columns=["video_id", "title", "name", "course"])

    return names


def variants(results: DataFrame, details: DataFrame, titles: DataFrame) -> DataFrame:
    """field, record_key, detail_id: every spelling that is not the person's main one, linked to the person.

    Null names and titles give no rows; repeated rows count once. Spellings that are like no registered person's for their
    course, or like two persons' alike, are left out.
    """
    known = materialize(register(details, results))
    people = materialize(persons(known))
    main = people.join(details.select("detail_id", "professor_name").distinct(), "detail_id").where("detail_id = person").select("person", F.col("professor_name").alias("main"))
    others = people.where("detail_id <> person").select(F.lit("professor_name").alias("field"), F.col("detail_id").cast("string").alias("record_key"), F.col("person").alias("detail_id"))

    courses = sorted({r[0] for r in known.where("course is not null").select("course").distinct().collect()})  # bounded by the register
    named = titles.where("title is not null and title <> ''").select("video_id", "title").distinct()
    named = materialize(named.mapInPandas(_title_names(courses), "video_id string, title string, name string, course string"))
    typed = results.where("professor is not null").select("id", F.col("professor").alias("name"), "course")
    items = typed.select("name", "course").distinct().unionByName(named.select("name", "course").distinct()).distinct()
    found = materialize(linked(items, known, people).join(main, "person"))
    hit = F.broadcast(found) if found.count() <= 20 * BROADCAST_ROWS else found
    rows = typed.join(hit.withColumnsRenamed({"name": "name_", "course": "course_"}), (F.col("name") == F.col("name_")) & F.col("course").eqNullSafe(F.col("course_")))
    rows = rows.where(F.col("name") != F.col("main")).select(F.lit("professor").alias("field"), F.col("id").cast("string").alias("record_key"), F.col("person").alias("detail_id")).distinct()
    heads = named.join(found.withColumnsRenamed({"name": "name_", "course": "course_"}), (F.col("name") == F.col("name_")) & F.col("course").eqNullSafe(F.col("course_")))
    heads = heads.where(~F.contains(form("title"), form("main")))
    heads = heads.select(F.lit("title").alias("field"), F.col("video_id").alias("record_key"), F.col("person").alias("detail_id")).distinct()
    return rows.unionByName(others).unionByName(heads)
