"""Mixing sources to target weights by soft membership.

A labelled-table classifier (multinomial naive Bayes on token ids, fitted on a bounded sample of labelled texts) gives every
distinct text its posterior over the sources, with the text's labels as prior; a text without label has the classifier
alone. Texts of nearly equal posterior, on a grid, form a profile: its tokens and its expected tokens of every source are one
distributed aggregation. Nonnegative rates of the profiles, at most their repeats, are fitted by projected gradient steps on
the squares between expected and wanted tokens of each source. As the profiles are few whatever the number of texts, the
steps run on the driver, without a job each, and the totals that they meet are exact for all texts.
What the labels say of the totals (a text stands for its label, one drawn by membership if it has several or none) is then met by
one factor per source, and systematic rounding along source and length turns rates into whole copies, the longest texts
first; what their totals miss is made up for by the rates of the shorter ones, so that a source ends within about one
short text of its target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgrain.llm.langid import in_sample
from reelgrain.llm.tokens import VOCABULARY, encoder
from reelgrain.storage import drop, materialize

#: Bounds of the classifier's sample and of the gradient steps; rows whose rates are added up in order in one window.
SAMPLE_DOCS, STEPS, ROWS_PER_PART = 3000, 500, 200_000
#: Weight of a text's labels against all other sources before its words are looked at.
LABEL_TRUST = 0.95
#: Steps of a membership on the grid of profiles, the finest first, and the most profiles that are gathered.
GRIDS, MOST_PROFILES = (8, 4, 2, 1), 200_000
#: Parts of the whole by which a source's expected tokens may be off when the steps end, and at which a size counts as met.
TOLERANCE, FAR = 1e-6, 2e-4


def _token_counts(vocabulary: str):
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        for frame in frames:
            for source, part in frame.groupby("source", sort=True):
                ids, n = np.unique(np.concatenate([np.asarray(encode(t), np.int64) for t in part["text"]] or [np.zeros(0, np.int64)]), return_counts=True)
                yield pd.DataFrame({"source": source, "token": ids, "n": n})

    return count


def fit(labelled: DataFrame, sources: list[str], sample_docs: int, vocabulary: str, n_docs: int) -> np.ndarray:
    """Log probability of each token in each source (array of tokens by sources), from about sample_docs of n_docs texts."""
    rows = materialize(labelled.where(in_sample("doc_id", sample_docs, n_docs)).select("source", "text"))
    if not rows.head(1) and labelled.head(1):
        raise ValueError("the sample holds no labelled text: raise sample_docs")
    counted = rows.mapInPandas(_token_counts(vocabulary), "source string, token long, n long").groupBy("source", "token").agg(F.sum("n").alias("n")).toPandas()
    drop(rows)
    size = encoder(vocabulary).n_vocab
    counts = np.zeros((size, len(sources)))
    place = {s: i for i, s in enumerate(sources)}
    for s, part in counted.groupby("source"):
        counts[part["token"].to_numpy(), place[s]] = part["n"].to_numpy()
    p = (counts + 0.1) / (counts.sum(0) + 0.1 * size)
    return np.log(p).astype(np.float32)


def _measured(log_p, vocabulary: str):
    """For mapInPandas: the number of tokens and the classifier's posterior of each text."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        table = log_p.value
        for frame in frames:
            tokens, posts = [], []
            for text in frame["text"]:
                ids = encode(text)
                score = table[ids].sum(0, dtype=np.float64)
                # words of a text aren't independent: scores are tempered by the root of its length
                score = np.exp((score - score.max()) / max(1.0, np.sqrt(len(ids))))
                tokens.append(len(ids))
                posts.append((score / score.sum()).astype(np.float32))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "source": frame["source"], "t1": frame["t1"], "t2": frame["t2"], "n_tokens": tokens, "post": posts})

    return measure


def _targets(targets: DataFrame) -> pd.DataFrame:
    """The target table, of fixed size: sources with a positive share, shares made to sum to 1."""
    rows = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("cap")).orderBy("source").toPandas()
    rows["share"] = rows["share"] / rows["share"].sum()
    return rows


def _running(c):
    """Sums of the first 1, 2, ... entries of an array."""
    return F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.aggregate(F.slice(c, 1, i), F.lit(0.0), lambda a, x: a + x))


def _texts(documents: DataFrame, targets: pd.DataFrame, sample_docs: int, vocabulary: str, trust: float = LABEL_TRUST) -> tuple[DataFrame, pd.DataFrame]:
    """A row per distinct text: t1, t2, doc_id, source (that it stands for), n_tokens, member (posterior over the sources), cap.

    Also the targets of the sources that label any text: what the classifier has never seen, it can't give.
    """
    sources = targets["source"].tolist()
    n = documents.count()
    rows = documents.where("text is not null and text <> ''").select("doc_id", "source", "text")
    rows = rows.where(F.col("source").isNull() | F.col("source").isin(sources))
    log_p = documents.sparkSession.sparkContext.broadcast(fit(rows.where("source is not null"), sources, sample_docs, vocabulary, n))
    rows = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    schema = "doc_id long, source string, t1 long, t2 long, n_tokens long, post array<float>"
    measured = docs = materialize(rows.mapInPandas(_measured(log_p, vocabulary), schema))
    seen = {r[0] for r in docs.select("source").distinct().collect()}  # a row per source
    there = [i for i, x in enumerate(sources) if x in seen]
    targets = targets.iloc[there].reset_index(drop=True)
    targets["share"] = targets["share"] / targets["share"].sum()
    sources = targets["source"].tolist()
    if not sources:
        return docs.limit(0), targets
    docs = docs.withColumn("post", F.array(*[F.col("post")[i] for i in there]))
    each = docs.groupBy("t1", "t2", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("post").alias("post"))
    labels = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "doc_id")))))
    by = each.groupBy("t1", "t2").agg(F.max("n_tokens").alias("n_tokens"), F.max("post").alias("post"), F.min("doc_id").alias("doc_id"), labels.alias("labels"))
    names = F.array(*[F.lit(s) for s in sources])
    caps = F.array(*[F.lit(int(c)) for c in targets["cap"]])
    known = F.size("labels")
    # the prior: the labels' trust shared among them, the rest among the other sources; without labels all alike
    own, other = F.lit(float(trust)) / known, F.lit(1.0 - trust) / F.greatest(F.lit(len(sources)) - known, F.lit(1))
    prior = F.transform(names, lambda s: F.when(known == 0, 1.0 / len(sources)).when(F.map_contains_key("labels", s), own).otherwise(other))
    by = by.withColumn("raw", F.zip_with("post", prior, lambda p, q: (F.greatest(p, F.lit(1e-6)) * q).cast("double")))
    by = by.withColumn("member", F.transform("raw", lambda x: x / F.aggregate("raw", F.lit(0.0), lambda a, y: a + y)))
    # the source for which a text stands: one of its labels, or any if it has none, drawn by membership with a number from its hash
    among = F.zip_with("member", names, lambda m, s: F.when((known == 0) | F.map_contains_key("labels", s), m).otherwise(0.0))
    by = by.withColumn("among", among).withColumn("sums", _running("among"))
    draw = F.pmod(F.xxhash64("t1", "t2", F.lit("source")), F.lit(1 << 30)) / float(1 << 30) * F.element_at("sums", -1)
    place = F.least(F.size(F.filter("sums", lambda x: x <= F.col("draw"))), F.lit(len(sources) - 1))
    by = by.withColumn("draw", draw).withColumn("source", F.element_at(names, place + 1))
    cap = F.array_min(F.transform(F.filter(F.arrays_zip(caps.alias("cap"), names.alias("s")), lambda x: (x["s"] == F.col("source")) | F.map_contains_key("labels", x["s"])), lambda x: x["cap"]))
    doc = F.coalesce(F.try_element_at("labels", "source"), "doc_id")
    out = materialize(by.select("t1", "t2", doc.alias("doc_id"), "source", "n_tokens", "member", cap.alias("cap")))
    drop(measured)
    return out, targets


def _key(grid: int):
    """The profile of a text: its membership in steps of 1 / grid, and its cap."""
    return F.concat_ws(",", F.col("cap").cast("string"), F.transform("member", lambda m: F.round(m * grid).cast("int").cast("string")))


def _fitted(expected: np.ndarray, cap: np.ndarray, wanted: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """The rates of the profiles after at most `steps` projected gradient steps, and how far the totals are off, in parts of the whole."""
    supply, rate = expected.sum(0), np.zeros(len(expected))
    member = expected / np.maximum(expected.sum(1, keepdims=True), 1e-12)
    for _ in range(steps):
        missing = wanted - rate @ expected
        if np.abs(missing).max() <= TOLERANCE * wanted.sum():
            break
        rate = np.clip(rate + member @ np.where(supply > 0, missing / np.where(supply > 0, supply, 1), 0.0), 0.0, cap)
    return rate, float(np.abs(wanted - rate @ expected).max() / max(wanted.sum(), 1e-12))


def rates(texts: DataFrame, targets: pd.DataFrame, steps: int = STEPS) -> tuple[np.ndarray, DataFrame, int]:
    """The expected tokens reached of each source, the profiles (key, rate), and the grid of their keys.

    A step adds to a profile's rate the correction of its sources, weighted by its membership, and clips it to [0, cap]: the
    gradient of the squares weighted by 1 / supply, in the metric of the profiles' tokens, where a step of 1 is safe.
    """
    k = len(targets)
    for grid in GRIDS:
        each = [F.sum(F.col("n_tokens") * F.col("member")[i]).alias(f"s{i}") for i in range(k)]
        profiles = materialize(texts.groupBy(_key(grid).alias("key")).agg(F.max("cap").cast("double").alias("cap"), *each))
        if grid == GRIDS[-1] or profiles.count() <= MOST_PROFILES:
            break
        drop(profiles)
    table = profiles.toPandas()
    drop(profiles)
    expected, cap = table[[f"s{i}" for i in range(k)]].to_numpy(np.float64).reshape(-1, k), table["cap"].to_numpy(np.float64)
    supply, most = expected.sum(0), (expected * cap[:, None]).sum(0)
    share = np.where(supply > 0, targets["share"].to_numpy(), 0.0)
    rate = np.zeros(len(table))
    if share.sum():
        share = share / share.sum()
        largest = np.min(most[share > 0] / share[share > 0])
        rate, off = _fitted(expected, cap, share * largest, steps)
        # where the sources' expected tokens can't all be met at that size, the largest size at which they can
        lo, hi = 0.0, 1.0
        while off > FAR and hi - lo > 1e-3:
            mid = (lo + hi) / 2
            now, far = _fitted(expected, cap, share * largest * mid, steps)
            lo, hi = (mid, hi) if far <= FAR else (lo, mid)
            rate = now if far <= FAR else rate
    # a text of a source that is wanted can always be drawn if its source lacks tokens
    table["rate"] = np.maximum(rate, 1e-6)
    fitted = texts.sparkSession.createDataFrame(table[["key", "rate"]], "key string, rate double")
    return rate @ expected, fitted, grid


def _factors(supply: pd.DataFrame, wanted: dict[str, float]) -> dict[str, float]:
    """For each source the factor on its rates at which their clipped total is what is wanted, or all there is.

    supply has a row per source, rate and cap with its tokens: not more than profiles times sources.
    """
    found = {}
    for source, part in supply.groupby("source"):
        n, rate, cap = (part[c].to_numpy(np.float64) for c in ("tokens", "rate", "cap"))
        goal, lo, hi = wanted.get(source, 0.0), 0.0, float((cap / rate).max())
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if n @ np.minimum(cap, mid * rate) < goal else (lo, mid)
        found[source] = hi
    return found


def _by_source(values: dict[str, float]):
    out = F.lit(0.0)
    for source, v in values.items():
        out = F.when(F.col("source") == source, v).otherwise(out)
    return out


def mixture(documents: DataFrame, targets: DataFrame, sample_docs: int = SAMPLE_DOCS, steps: int = STEPS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens, copies of the texts that the mixture takes at least once.

    Equal texts count as one text, represented by its least doc_id under the source that it stands for, so that no text is
    taken more often than the cap of each of its labels. The mixture is the largest that the scarcest source allows; sources
    without texts are left out and the others keep their proportions. Null and empty texts hold no tokens.
    """
    table = _targets(targets)
    nothing = documents.limit(0).select("doc_id", "source", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).alias("copies"))
    if not len(table):
        return nothing
    texts, table = _texts(documents, table, sample_docs, vocabulary)
    if not len(table):
        return nothing
    _, profiles, grid = rates(texts, table, steps)
    rows = texts.withColumn("key", _key(grid)).join(F.broadcast(profiles), "key")  # at most MOST_PROFILES rows
    lengths = texts.groupBy("source").agg(F.percentile_approx("n_tokens", [0.5, 0.9], 1000).alias("q"), F.sum(F.col("n_tokens") * F.col("cap")).alias("most"), F.count("*").alias("n")).collect()  # a row per source
    tier = F.when(F.col("n_tokens") > _by_source({r.source: float(r.q[1]) for r in lengths}), 0).when(F.col("n_tokens") > _by_source({r.source: float(r.q[0]) for r in lengths}), 1).otherwise(2)
    rows = materialize(rows.select("doc_id", "source", "n_tokens", "cap", "rate", "t1", "t2", tier.alias("tier")))
    drop(texts)
    most = {r.source: float(r.most) for r in lengths if r.most}
    share = {s: float(x) for s, x in zip(table["source"], table["share"]) if s in most}
    size = min((most[s] / x for s, x in share.items()), default=0.0)
    missing = {s: x * size for s, x in share.items()}
    parts = max(64, -(-sum(r.n for r in lengths) // ROWS_PER_PART))
    supply = rows.groupBy("source", "tier", "rate", "cap").agg(F.sum("n_tokens").alias("tokens")).toPandas()
    picked = []
    for k in range(3):
        factors = _factors(supply[supply["tier"] >= k], missing)
        picked.append(materialize(_rounded(rows.where(F.col("tier") == k), factors, parts)))
        for r in picked[-1].groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect():
            missing[r.source] -= r.n
    drop(rows)
    return picked[0].unionByName(picked[1]).unionByName(picked[2])


def _rounded(rows: DataFrame, factors: dict[str, float], parts: int) -> DataFrame:
    """Whole copies by systematic rounding of rate * factor in the order of length, over parts whose sums are small tables.

    parts follows from the number of rows, so that no window holds much more than ROWS_PER_PART of them.
    """
    rows = rows.withColumn("rate", F.least(F.col("cap").cast("double"), F.col("rate") * _by_source(factors)))
    part = F.floor(F.log2(F.col("n_tokens") + 1) * 4).cast("int")
    rows = rows.withColumn("part", part).withColumn("sub", F.pmod(F.col("t1"), F.lit(parts)))
    key = ["source", "part", "sub"]
    own = Window.partitionBy(*key).orderBy("n_tokens", "t1", "t2").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*key).agg(F.sum("rate").alias("sum"))
    first = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    whole = sums.groupBy("source", "part").agg(F.sum("sum").alias("all")).withColumn("up_to_part", F.coalesce(F.sum("all").over(first("source").orderBy("part")), F.lit(0.0)))
    sums = sums.withColumn("up_to_sub", F.coalesce(F.sum("sum").over(first("source", "part").orderBy("sub")), F.lit(0.0)))
    before = sums.join(whole, ["source", "part"]).select(*key, (F.col("up_to_part") + F.col("up_to_sub")).alias("before"))
    rows = rows.withColumn("upto", F.sum("rate").over(own)).join(before, key)
    end = F.round(F.col("before") + F.col("upto"), 6)
    copies = F.floor(end + 0.5) - F.floor(F.round(end - F.col("rate"), 6) + 0.5)
    rows = rows.withColumn("copies", F.least(F.greatest(copies, F.lit(0)), F.col("cap")).cast("int"))
    return rows.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per target source: target_share, n_texts, tokens (with repeats), actual_share and the most copies of one text."""
    by = mixed.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    total = Window.partitionBy()  # as many rows as sources
    rows = targets.select("source", "target_share", "max_repeats").join(by, "source", "left").na.fill(0, ["n_texts", "tokens", "most_copies"])
    return rows.withColumn("actual_share", F.round(F.col("tokens") / F.sum("tokens").over(total), 6))
