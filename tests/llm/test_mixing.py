import random

import numpy as np
import pandas as pd
import pytest
from reelgrain.llm.mixing import fit, mixture, rates, shares
from reelgrain.llm.tokens import VOCABULARY

SCHEMA = "doc_id long, source string, text string, cap long, rate double"
TARGETS = "source string, target_share double, max_repeats bigint"


def test_shares_and_caps(spark):
    rnd = random.Random(1)
    words = {"a": "alpha beta gamma delta", "b": "one two three four", "c": "red green blue grey"}
    rows = []
    for i in range(900):
        s = rnd.choices("abc", [6, 3, 1])[0]
        rows.append((i, s, " ".join(rnd.choice(words[s].split()) for _ in range(rnd.randint(3, 60))), 1, 0.5))
    rows += [(1000 + i, s, t, 1, 0.5) for i, (_, s, t, _, _) in enumerate(rows[:30])] + [(2000 + i, "c", rows[i][2], 1, 0.5) for i in range(5)]
    rows += [(3000, None, "red green blue " * 5, 1, 0.5), (3001, "a", None, 1, 0.5), (3002, "b", "", 1, 0.5), (3003, "zz", "other", 1, 0.5)]
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.3, 4), ("gone", 0.1, 1), (None, None, None)], TARGETS)
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixture(docs, targets).collect()
    text = {r[0]: r[2] for r in rows}
    cap = {"a": 1, "b": 2, "c": 4}
    assert all(0 < r.copies <= cap[r.source] for r in mixed)
    assert len({text[r.doc_id] for r in mixed}) == len(mixed)
    total = sum(r.n_tokens * r.copies for r in mixed)
    for s, want in (("a", 0.4), ("b", 0.3), ("c", 0.3)):
        assert abs(sum(r.n_tokens * r.copies for r in mixed if r.source == s) / total - want) < 0.01
    report = {r.source: r for r in shares(mixture(docs, targets), targets).collect()}
    assert report["gone"].actual_share == 0 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-4
    assert mixture(docs.limit(0), targets).count() == 0
    assert mixture(docs, targets.limit(0)).count() == 0


def test_soft_memberships_need_several_steps(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        m = rnd.choice([[0.7, 0.2, 0.1], [0.35, 0.6, 0.05], [0.2, 0.3, 0.5], [0.05, 0.05, 0.9]])
        rows.append((rnd.randint(5, 300), m, rnd.choice([1, 2])))
    texts = spark.createDataFrame(rows, "n_tokens int, member array<double>, cap int")
    targets = pd.DataFrame({"source": list("abc"), "share": [0.3, 0.3, 0.4], "cap": [1, 1, 1]})
    share = lambda x: np.asarray(x) / np.sum(x)
    once, _, _ = rates(texts, targets, steps=1)
    reached, fitted, grid = rates(texts, targets)
    assert np.abs(share(once) - targets["share"]).max() > 0.02
    assert np.abs(share(reached) - targets["share"]).max() < 0.001
    # the same totals from the texts themselves
    key = lambda m, cap: ",".join([str(cap), *(str(int(x * grid + 0.5)) for x in m)])
    rate = {r.key: r.rate for r in fitted.collect()}
    totals = sum(n * rate[key(m, cap)] * np.array(m) for n, m, cap in rows)
    assert np.allclose(totals, reached, rtol=1e-6) and all(0 <= rate[key(m, cap)] <= cap for _, m, cap in rows)


def test_labels_are_a_prior(spark):
    rnd = random.Random(4)
    words = {"a": "alpha beta gamma delta", "b": "one two three four"}
    say = lambda s, n: " ".join(rnd.choice(words[s].split()) for _ in range(n))
    rows = [(i, s, say(s, 40), 1, 0.5) for i, s in enumerate("ab" * 60)] + [(500, "a", say("b", 40), 1, 0.5), (501, None, say("b", 40), 1, 0.5)]
    from reelgrain.llm.mixing import _texts

    targets = pd.DataFrame({"source": ["a", "b"], "share": [0.5, 0.5], "cap": [1, 1]})
    texts, _ = _texts(spark.createDataFrame(rows, SCHEMA), targets, 3000, VOCABULARY)
    got = {r.doc_id: r for r in texts.collect()}
    assert got[0].member[0] > 0.95 and got[501].member[1] > 0.9 and got[501].source == "b"
    assert 0.05 < got[500].member[1] < got[501].member[1] and got[500].source == "a"


def test_an_empty_sample_is_an_error(spark):
    docs = spark.createDataFrame([(i, "a", "x y z", 1, 0.5) for i in range(50)], SCHEMA)
    with pytest.raises(ValueError):
        fit(docs, ["a"], 3000, VOCABULARY, 10**16)
    assert fit(docs, ["a"], 3 * 10**9, VOCABULARY, 4 * 10**9).shape[1] == 1
