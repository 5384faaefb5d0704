"""Languages of documents, lines and passages with confidence: words first, then progressively shorter character n-grams.

A text is read as stretches of words in one script (Han text, which has no blanks, as overlapping pairs of characters). A word
that the model knows is scored by its log frequency in each of the nine languages; one that it doesn't know by its
character n-grams of the longest length, from four down to one, of which any is known. A language that isn't usually written
in the script of a stretch starts with a handicap, no more. Stretches whose best language leaves a passage clearly better
explained by another are cut by the best path with a price on every change of language. The confidence is the tempered
posterior times the share of the stretch that the model knows, so a language outside the nine gets its nearest
relative with a low confidence. The frequencies are counted on a bounded sample of the labelled documents and counted
again with the languages found in the first round, which takes out wrong labels and passages in other languages.

All steps work on whole batches of texts as arrays of code points; words and n-grams are known by 64-bit hashes.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrain.llm.rolling import Hashes, code_points
from reelgrain.storage import drop, materialize

LANGS = ("ko", "en", "zh", "ja", "vi", "es", "pt", "de", "ru")
#: Kinds of script, and the languages usually written in each.
HANGUL, CJ, CYRILLIC, LATIN = 1, 2, 3, 4
SCRIPTS = {HANGUL: ("ko",), CJ: ("zh", "ja"), CYRILLIC: ("ru",), LATIN: ("en", "es", "pt", "de", "vi")}
#: Bound on the labelled documents from which frequencies are counted; the model has no other bound.
SAMPLE_DOCS = 3000
#: Least size of a stretch that is a sentence rather than a term: words, letters.
LATIN_WORDS, CYRILLIC_WORDS, HANGUL_LETTERS, HAN_LETTERS = 5, 4, 8, 8
#: Price of a change of language inside a stretch, and handicap of a language in a foreign script, in natural logarithms.
CHANGE, FOREIGN = 10.0, 8.0
LETTERS_PER_LINE = 20
#: A model of more bytes isn't broadcast: its sample must be made smaller.
MOST_BYTES = 512 << 20
GRAMS = (4, 3, 2, 1)
_FLOOR, _GRAM_FLOOR = -6.0, -3.0
_CHARS_AT_ONCE = 1 << 20

# Codes and English names of the languages.
CODES = {
    "ko": ("ko", "kor", "korean"), "en": ("en", "eng", "english"), "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin"),
    "ja": ("ja", "jpn", "japanese"), "vi": ("vi", "vie", "vietnamese"), "es": ("es", "spa", "spanish", "castilian"),
    "pt": ("pt", "por", "portuguese"), "de": ("de", "deu", "ger", "german"), "ru": ("ru", "rus", "russian"),
}
_BY_CODE = {x: code for code, names in CODES.items() for x in names}

# Ranges of code points of each script, of marks inside words, and of what ends a sentence without blanks.
_RANGES = {
    HANGUL: [(0xAC00, 0xD7A3), (0x1100, 0x11FF), (0x3131, 0x318E)],
    CJ: [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x3005, 0x3005), (0xF900, 0xFAFF)],
    CYRILLIC: [(0x0400, 0x052F)],
    LATIN: [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)],
}
_HIRAGANA, _KATAKANA = [(0x3040, 0x309F)], [(0x30A0, 0x30FF), (0x31F0, 0x31FF)]
_MARK, _APOSTROPHE, _STOP = 5, 6, 7
_hidden = re.compile("[­͏؜ᅟᅠ᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_plain = re.compile(r"^[ -~\n가-힣一-鿿぀-ヿЀ-ԯ、。，．？！：；（）À-ÖØ-öø-ƿḀ-ỿ]*$")
_not_letter = regex.compile(r"\P{L}+")


def language_of(label: str | None) -> str | None:
    """The code of the language that a label names in any usual way; None for no language or one that is not covered."""
    if label is None:
        return None
    words = re.split(r"[^a-z]+", label.strip().lower())
    # a code comes first; of a name, the language may follow its kind (Brazilian Portuguese)
    return _BY_CODE.get(words[0]) or next((_BY_CODE[w] for w in words[1:] if len(w) > 3 and w in _BY_CODE), None)


def letters(line: str) -> int:
    return len(_not_letter.sub("", line))


def _clean(text: str) -> str:
    if _plain.match(text):
        return text
    return unicodedata.normalize("NFKC", _hidden.sub("", text)).replace("İ", "I")


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point its kind, its kind within Japanese and Chinese (0: Han), and whether it is a letter."""
    kind, inner = np.zeros(sys.maxunicode + 1, np.uint8), np.zeros(sys.maxunicode + 1, np.uint8)
    for k, ranges in _RANGES.items():
        for a, b in ranges:
            kind[a : b + 1] = k
    kind[0x300:0x370] = _MARK
    for c in "'’":
        kind[ord(c)] = _APOSTROPHE
    for o in range(0x3001):
        if chr(o).isspace():
            kind[o] = _STOP
    for c in "。？！":
        kind[ord(c)] = _STOP
    for k, ranges in ((1, _HIRAGANA), (2, _KATAKANA)):
        for a, b in ranges:
            inner[a : b + 1] = k
    letter = np.array([unicodedata.category(chr(o))[0] == "L" for o in range(sys.maxunicode + 1)])
    return kind, inner, letter


class Reading:
    """Lines, words and stretches of a batch of texts, as arrays.

    Attributes: `text_of`, `begin` and `letters` of each line; `start`, `end`, `line`, `kind` and `stretch` of each word that
    belongs to a stretch long enough for a sentence (in order of the stretches).
    """

    def __init__(self, texts: list[str]) -> None:
        kinds, inner, is_letter = _classes()
        clean = [_clean(t) for t in texts]
        self.codes = codes = code_points("\n".join(clean).lower())
        cls = kinds[codes]
        breaks = np.flatnonzero(codes == 10)
        self.begin = np.concatenate([[0], breaks + 1])
        stop = np.concatenate([breaks, [len(codes)]])
        sizes = np.array([len(t) + 1 for t in clean], np.int64)
        self.text_of = np.searchsorted(np.cumsum(sizes), self.begin, side="right")
        up_to = np.concatenate([[0], np.cumsum(is_letter[codes])])
        self.letters = up_to[stop] - up_to[self.begin]
        # letters are counted as stored, also where a text was brought into another form
        for i in (k for k, (a, b) in enumerate(zip(texts, clean)) if a is not b):
            at = np.flatnonzero(self.text_of == i)
            self.letters[at] = [letters(x) for x in texts[i].split("\n")]
        self._words(cls, inner)
        self._stretches(cls)

    def _words(self, cls: np.ndarray, inner: np.ndarray) -> None:
        """Runs of letters of one script; Latin words take in marks and one apostrophe with letters after it."""
        n = len(cls)
        kind = cls.copy()
        kind[kind > LATIN] = 0
        after_letter = np.zeros(n, bool)
        if n > 1:
            marks = np.flatnonzero(cls == _MARK)
            for i in marks:  # few: composed text has hardly any
                if i and kind[i - 1] == LATIN:
                    kind[i] = LATIN
            after_letter[1:] = kind[:-1] == LATIN
            apostrophes = np.flatnonzero((cls == _APOSTROPHE) & after_letter)
            apostrophes = apostrophes[apostrophes + 1 < n]
            kind[apostrophes[kind[apostrophes + 1] == LATIN]] = LATIN
        sub = np.where(kind == CJ, inner[self.codes], 0)
        edge = np.flatnonzero((np.diff(kind) != 0) | (np.diff(sub) != 0)) + 1
        start = np.concatenate([[0], edge]) if n else np.zeros(0, np.int64)
        end = np.concatenate([edge, [n]]) if n else np.zeros(0, np.int64)
        word = kind[start] > 0 if n else np.zeros(0, bool)
        self.start, self.end = start[word], end[word]
        self.kind = kind[self.start]
        self.han = (self.kind == CJ) & (inner[self.codes[self.start]] == 0)

    def _stretches(self, cls: np.ndarray) -> None:
        line = np.searchsorted(self.begin, self.start, side="right") - 1
        n = len(line)
        if not n:
            self.line, self.stretch = line, np.zeros(0, np.int64)
            return
        stops = np.concatenate([[0], np.cumsum(cls == _STOP)])
        new = np.ones(n, bool)
        parted = (self.kind[1:] == CJ) & (stops[self.start[1:]] > stops[self.end[:-1]])
        new[1:] = (np.diff(line) != 0) | (np.diff(self.kind.astype(np.int8)) != 0) | parted
        stretch = np.cumsum(new) - 1
        size = self.end - self.start
        chars, words = np.bincount(stretch, size).astype(np.int64), np.bincount(stretch)
        kind = self.kind[new]
        long = ((kind == HANGUL) & (chars >= HANGUL_LETTERS)) | ((kind == CJ) & (chars >= HAN_LETTERS)) | ((kind == CYRILLIC) & (words >= CYRILLIC_WORDS)) | ((kind == LATIN) & (words >= LATIN_WORDS))
        keep = long[stretch]
        # lines of some length without a sentence: what there is most of counts as one
        with_long = np.zeros(len(self.begin), bool)
        with_long[line[keep]] = True
        by_kind = np.bincount(line * 5 + self.kind, size, minlength=5 * len(self.begin)).reshape(-1, 5)
        most = np.where(~with_long & (by_kind.sum(1) >= LETTERS_PER_LINE), by_kind.argmax(1), 0)
        joined = (most[line] == self.kind) & (most[line] > 0)
        stretch = np.where(joined, n + line, stretch)
        keep |= joined
        order = np.flatnonzero(keep)
        order = order[np.argsort(stretch[order], kind="stable")]
        self.start, self.end, self.kind, self.han = self.start[order], self.end[order], self.kind[order], self.han[order]
        self.line, stretch = line[order], stretch[order]
        self.stretch = np.unique(stretch, return_inverse=True)[1]
        self._pairs()

    def _pairs(self) -> None:
        """Runs of Han characters become their overlapping pairs."""
        size = self.end - self.start
        times = np.where(self.han & (size > 2), size - 1, 1)
        if (times == 1).all():
            return
        row = np.repeat(np.arange(len(size)), times)
        place = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        split = times[row] > 1
        start = self.start[row] + np.where(split, place, 0)
        self.end = np.where(split, start + 2, self.end[row])
        self.start, self.kind, self.line, self.stretch, self.han = start, self.kind[row], self.line[row], self.stretch[row], self.han[row]

    def letters_of(self) -> np.ndarray:
        """Characters that each word adds to its stretch: of overlapping pairs one, and the last one both."""
        size = self.end - self.start
        follows = np.zeros(len(size), bool)
        if len(size) > 1:
            follows[:-1] = self.start[1:] < self.end[:-1]
        return np.where(follows & self.han, 1, size)


def _grams(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length, the hashes of the n-grams of words (between blanks, but for single characters) and whose they are."""
    size = end - start + 2
    begins = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(owner)) - begins[owner]
    inside = (place > 0) & (place < size[owner] - 1)
    padded = np.full(len(owner), 32, np.uint32)
    padded[inside] = codes[(start[owner] + place - 1)[inside]]
    hashes = Hashes(padded)
    for n in GRAMS:
        at = np.flatnonzero(inside) if n == 1 else np.arange(max(0, len(owner) - n + 1))
        if n > 1:
            at = at[owner[at] == owner[at + n - 1]]
        yield n, hashes.of(at, at + n), owner[at]


class Model:
    """Scores of words and n-grams in each language: for 0 (words) and each length, sorted hashes and a row of scores each."""

    def __init__(self, tables: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.tables = tables

    @classmethod
    def of(cls, counts: pd.DataFrame) -> Model:
        """From kind, h and a count per language; entries counted once say nothing."""
        tables = {}
        for kind in (0, *GRAMS):
            rows = counts[counts["kind"] == kind].sort_values("h")
            n = rows[list(LANGS)].to_numpy(np.float64).reshape(len(rows), len(LANGS))
            p = np.log((n + 0.02) / (n.sum(0) + 1.0))
            score = np.maximum(p - p.max(1, keepdims=True), _FLOOR if kind == 0 else _GRAM_FLOOR) if len(rows) else p
            keys = rows["h"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(keys)
            tables[kind] = (keys[order], score[order].astype(np.float32))
        return cls(tables)

    def nbytes(self) -> int:
        return sum(k.nbytes + s.nbytes for k, s in self.tables.values())

    def _find(self, kind: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each hash in a table, and whether it is there."""
        keys = self.tables[kind][0]
        if not len(keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def words(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words in each language, and how much of each word the model knows, 0 to 1."""
        h = Hashes(codes).of(start, end)
        at, known = self._find(0, h)
        scores = np.zeros((len(h), len(LANGS)), np.float32)
        scores[known] = self.tables[0][1][at[known]]
        cover = known.astype(np.float32)
        other = np.flatnonzero(~known)
        if len(other):
            _, first, place = np.unique(h[other], return_index=True, return_inverse=True)
            s, c = self._backoff(codes, start[other[first]], end[other[first]])
            scores[other], cover[other] = s[place], c[place]
        return scores, cover

    def _backoff(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = len(start)
        scores, cover, open_ = np.zeros((k, len(LANGS))), np.zeros(k), np.ones(k, bool)
        for n, h, owner in _grams(codes, start, end):
            todo = open_[owner]
            h, owner = h[todo], owner[todo]
            at, known = self._find(n, h)
            found, of_all = np.bincount(owner[known], minlength=k), np.bincount(owner, minlength=k)
            hit = found > 0
            sums = np.stack([np.bincount(owner[known], self.tables[n][1][at[known], i], minlength=k) for i in range(len(LANGS))], axis=1)
            scores[hit] = np.maximum(sums[hit] / np.sqrt(found[hit])[:, None], _GRAM_FLOOR)
            cover[hit] = n / max(GRAMS) * found[hit] / of_all[hit]
            open_ &= ~hit
        return scores.astype(np.float32), cover.astype(np.float32)


_home = np.zeros((5, len(LANGS)))
for _k, _langs in SCRIPTS.items():
    _home[_k] = [0.0 if x in _langs else -FOREIGN for x in LANGS]


def _path(s: np.ndarray) -> np.ndarray:
    """The best language of every word, with a price on changes."""
    n, k = s.shape
    best, back = s[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        j = int(best.argmax())
        stay = best >= best[j] - CHANGE
        back[i] = np.where(stay, np.arange(k), j)
        best = np.where(stay, best, best[j] - CHANGE) + s[i]
    at = np.empty(n, np.int64)
    at[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        at[i - 1] = back[i, at[i]]
    return at


def passages(model: Model, read: Reading) -> pd.DataFrame:
    """A row per passage: text, line, first and last (characters of the line), lang (its number), letters, confidence, a, b (words)."""
    columns = ["text", "line", "first", "last", "lang", "letters", "confidence", "a", "b"]
    n = len(read.start)
    if not n:
        return pd.DataFrame({c: np.zeros(0) for c in columns})
    s, cover = model.words(read.codes, read.start, read.end)
    begins = np.flatnonzero(np.concatenate([[True], np.diff(read.stretch) != 0]))
    ends = np.concatenate([begins[1:], [n]])
    kind = read.kind[begins]
    home = _home[kind]
    totals = np.add.reduceat(s.astype(np.float64), begins) + home
    main = totals.argmax(1)
    # greatest advantage of another language over the main one on any passage; a row of great loss parts the stretches
    gain = np.insert((s - s[np.arange(n), main[read.stretch]][:, None]).astype(np.float64), begins, -1e6, axis=0)
    sums = np.cumsum(gain, axis=0)
    most = np.maximum.reduceat((sums - np.minimum.accumulate(sums, axis=0)).max(1), begins + np.arange(len(begins)))
    mixed = np.flatnonzero((most > CHANGE) & (kind == LATIN) & (ends - begins >= 2))
    a, b, lang = np.delete(begins, mixed), np.delete(ends, mixed), np.delete(main, mixed)
    more = []
    for i in mixed:
        at = _path(s[begins[i] : ends[i]].astype(np.float64) + home[i] / (ends[i] - begins[i]))
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        own = [(begins[i] + x, begins[i] + y, at[x]) for x, y in zip(cuts, cuts[1:]) if y - x >= LATIN_WORDS or len(cuts) == 2]
        more += own or [(begins[i], ends[i], main[i])]
    if more:
        x, y, z = (np.array(c, np.int64) for c in zip(*more))
        a, b, lang = np.concatenate([a, x]), np.concatenate([b, y]), np.concatenate([lang, z])
        order = np.argsort(a, kind="stable")
        a, b, lang = a[order], b[order], lang[order]
    upto = lambda v: np.concatenate([np.zeros((1, *v.shape[1:])), np.cumsum(v.astype(np.float64), axis=0)])
    each, chars = upto(s), read.letters_of()
    size, known = upto(chars), upto(chars * cover)
    count = b - a
    total = each[b] - each[a] + _home[read.kind[a]]
    # words of a text aren't independent: they tell half as much for every fourfold length
    tempered = (total - total[np.arange(len(a)), lang][:, None]) / np.sqrt(count)[:, None]
    posterior = 1 / np.exp(np.clip(tempered, -50, 50)).sum(1)
    n_letters = size[b] - size[a]
    share = (known[b] - known[a]) / np.maximum(n_letters, 1)
    line = read.line[a]
    return pd.DataFrame({
        "text": read.text_of[line], "line": line, "first": read.start[a] - read.begin[line], "last": read.end[b - 1] - read.begin[line], "lang": lang,
        "letters": n_letters.astype(np.int64), "confidence": np.clip(posterior * share, 0.0, 1.0), "a": a, "b": b,
    })


def _portions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in portions of about a million characters."""
    for frame in frames:
        portion = (frame["text"].str.len().cumsum() // _CHARS_AT_ONCE).to_numpy()
        for k in np.unique(portion):
            yield frame[portion == k]


COUNTS = "kind int, h long, lang int, n long"


def _count(model):
    """For mapInPandas over label (number of its language) and text: COUNTS by the labels, or by what the model of the first round finds."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _portions(frames):
            read = Reading(frame["text"].tolist())
            if not len(read.start):
                continue
            if model is None:
                label = frame["label"].to_numpy(np.int64)[read.text_of[read.line]]
                lang = np.where(_home[read.kind, label] == 0, label, -1)
            else:
                found = passages(model.value, read)
                lang = np.full(len(read.start), -1)
                for a, b, k in zip(found["a"], found["b"], found["lang"]):
                    lang[a:b] = k
            use = np.flatnonzero(lang >= 0)
            start, end, lang = read.start[use], read.end[use], lang[use]
            words = Hashes(read.codes).of(start, end)
            for k in np.unique(lang):
                own = np.flatnonzero(lang == k)
                keys, first, times = np.unique(words[own], return_index=True, return_counts=True)
                tables = [(0, keys, times)]
                # every word's n-grams once, as often as the word occurs
                for n, h, owner in _grams(read.codes, start[own[first]], end[own[first]]):
                    grams, place = np.unique(h, return_inverse=True)
                    tables.append((n, grams, np.bincount(place, times[owner], minlength=len(grams)).astype(np.int64)))
                for kind, h, n in tables:
                    yield pd.DataFrame({"kind": np.int32(kind), "h": h.view(np.int64), "lang": np.int32(k), "n": n})

    return count


def _model(counted: DataFrame) -> Model:
    each = [F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).alias(x) for i, x in enumerate(LANGS)]
    # as many rows as the bounded sample has repeated words and n-grams
    return Model.of(counted.groupBy("kind", "h").agg(F.sum("n").alias("n"), *each).where("n > 1").drop("n").toPandas())


@F.pandas_udf(T.IntegerType())
def _label(labels: pd.Series) -> pd.Series:
    return labels.map(lambda x: -1 if (code := language_of(x)) is None else LANGS.index(code)).astype("int32")


def in_sample(key: str, sample: int, of: int):
    """Condition under which about `sample` of `of` rows are taken, by the 64-bit hash of a column: right at any number of rows."""
    return F.xxhash64(key) < F.lit(min(2**63 - 1, -(2**63) + (sample << 64) // max(1, of)))


def fit(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, n_docs: int | None = None) -> Model | None:
    """A model from at most about sample_docs documents, chosen by a hash of doc_id, whole texts, in two rounds.

    n_docs is the number of documents where it is known. None if no document has a text; a sample without any is an error.
    """
    n = documents.count() if n_docs is None else n_docs
    rows = documents.where(in_sample("doc_id", sample_docs, n)).where("text is not null and text <> ''")
    rows = materialize(rows.select(_label(F.coalesce("lang", F.lit(""))).alias("label"), "text"))
    if not rows.head(1):
        if documents.where("text is not null and text <> ''").head(1):
            raise ValueError("the sample holds no document with a text: raise sample_docs")
        return None
    first = _model(rows.where("label >= 0").mapInPandas(_count(None), COUNTS))
    model = _model(rows.mapInPandas(_count(_shipped(documents, first)), COUNTS))
    drop(rows)
    return model


def _shipped(documents: DataFrame, model: Model):
    if model.nbytes() > MOST_BYTES:
        raise ValueError(f"a model of {model.nbytes()} bytes is too large to broadcast: lower sample_docs")
    return documents.sparkSession.sparkContext.broadcast(model)


def _found(model, level: str, only_doubtful: bool):
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(LANGS, object)
        for frame in _portions(frames):
            read = Reading(frame["text"].tolist())
            rows = passages(model.value, read)
            if not len(rows):
                continue
            k = len(LANGS)
            texts = len(frame)
            total = np.bincount(rows["text"] * k + rows["lang"], rows["letters"], minlength=texts * k).reshape(-1, k)
            sure = np.bincount(rows["text"] * k + rows["lang"], rows["letters"] * rows["confidence"], minlength=texts * k).reshape(-1, k)
            main = total.argmax(1)
            there = total.sum(1) > 0
            named = np.array([-1 if (c := language_of(x)) is None else LANGS.index(c) for x in frame["lang"]], np.int64)
            several = (total > 0).sum(1) > 1
            doubtful = (named != main) | several
            if level == "document":
                at = np.flatnonzero(there & (doubtful | (not only_doubtful)))
                status = np.where(named[at] < 0, "missing", np.where(named[at] != main[at], "wrong", "right"))
                all_of = [",".join(names[j] for j in np.argsort(-row, kind="stable") if row[j] > 0) for row in total[at]]
                yield pd.DataFrame({
                    "doc_id": frame["doc_id"].to_numpy()[at], "lang": names[main[at]], "confidence": sure[at, main[at]] / total[at].sum(1), "languages": all_of,
                    "share": total[at, main[at]] / total[at].sum(1), "label": status,
                })
                continue
            rows = rows[read.letters[rows["line"]] >= LETTERS_PER_LINE]
            if only_doubtful:
                rows = rows[doubtful[rows["text"]]]
            if level == "line":
                rows = rows.groupby(["text", "line", "lang"], as_index=False).agg(confidence=("confidence", "max"))
            first_line = np.searchsorted(read.text_of, np.arange(texts))
            text = rows["text"].to_numpy(np.int64)
            out = {"doc_id": frame["doc_id"].to_numpy()[text], "line_no": (rows["line"].to_numpy(np.int64) - first_line[text]).astype(np.int32)}
            if level == "segment":
                out |= {"first": rows["first"].to_numpy(), "last": rows["last"].to_numpy()}
            out |= {"lang": names[rows["lang"].to_numpy(np.int64)], "confidence": rows["confidence"].to_numpy()}
            if level == "line":
                out |= {"doc_lang": names[main[text]], "named": np.where(named[text] >= 0, names[named[text]], None)}
            yield pd.DataFrame(out)

    return find


SCHEMAS = {
    "line": "doc_id long, line_no int, lang string, confidence double, doc_lang string, named string",
    "segment": "doc_id long, line_no int, first long, last long, lang string, confidence double",
    "document": "doc_id long, lang string, confidence double, languages string, share double, label string",
}


def _languages(documents: DataFrame, level: str, only_doubtful: bool, sample_docs: int) -> DataFrame:
    model = fit(documents, sample_docs)
    if model is None:
        return documents.sparkSession.createDataFrame([], SCHEMAS[level])
    rows = documents.where("text is not null and text <> ''").select("doc_id", "lang", "text")
    return rows.mapInPandas(_found(_shipped(documents, model), level, only_doubtful), SCHEMAS[level])


def line_languages(documents: DataFrame, only_doubtful: bool = False, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, line_no, lang, confidence, doc_lang, named: a row per line of at least 20 letters and language of its sentences.

    doc_lang is the language with most letters of the text, `named` what its label names (null: none of the nine).
    only_doubtful keeps the documents whose label names no language or another one than doc_lang, or whose text has
    sentences in several. Null texts and texts without letters give no rows. Terms shorter than a sentence don't count.
    """
    return _languages(documents, "line", only_doubtful, sample_docs)


def segment_languages(documents: DataFrame, only_doubtful: bool = False, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, line_no, first, last, lang, confidence: the passages of lines of at least 20 letters, as characters [first, last) of the line.

    Characters are those of the line in compatibility composed form without ignorable ones, which for most lines is the line as stored.
    """
    return _languages(documents, "segment", only_doubtful, sample_docs)


def document_languages(documents: DataFrame, only_doubtful: bool = False, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, lang, confidence, languages, share, label: a row per document that has a sentence.

    lang has most letters of the text, `share` of them; languages lists all, most letters first; confidence is that of lang's
    passages by their letters, over all letters; label tells whether the given label is right, wrong or missing.
    """
    return _languages(documents, "document", only_doubtful, sample_docs)
