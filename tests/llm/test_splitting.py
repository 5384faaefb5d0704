import random

import numpy as np
import pytest
from reelgrain.llm.splitting import greedy_cuts, natural_ends, oversized, pieces


def brute(ends, length, limit, overlap):
    cuts, start = [], 0
    while True:
        if length <= start + limit:
            return [*cuts, length]
        fit = [e for e in ends if start + overlap < e <= start + limit and e < length]
        cuts.append(max(fit) if fit else start + limit)
        start = cuts[-1] - overlap


@pytest.mark.parametrize("seed", range(30))
def test_greedy_cuts(seed):
    rnd = random.Random(seed)
    length, limit, overlap = rnd.randint(30, 900), 40, rnd.choice([0, 5, 15])
    dense = np.array(sorted(rnd.sample(range(1, length), rnd.randint(0, min(length // 8, 40)))), np.int64)
    cuts = greedy_cuts(dense, length, limit, overlap).tolist()
    starts = [0] + [c - overlap for c in cuts[:-1]]
    assert cuts[-1] == length and all(0 < b - a <= limit for a, b in zip(starts, cuts)) and cuts == sorted(set(cuts))
    every = np.arange(7, length, 7)
    assert greedy_cuts(every, length, limit, overlap).tolist() == brute(every.tolist(), length, limit, overlap)


def test_pieces_round_trip(spark):
    rnd = random.Random(5)
    rows = []
    for v in range(6):
        for k in range(rnd.choice([0, 1, 5, 40])):
            rows.append((f"v{v}_{k}", f"v{v}", float(k), rnd.choice(["문장이 하나 있습니다.", "no end", "x" * 150, "다음?"]), {"k": 1}))
    df = spark.createDataFrame(rows + rows[:3] + [("n", "v0", 0.5, None, None)], "segment_id string, video_id string, start double, text string, m map<string,int>")
    got = {}
    for r in sorted(pieces(df, 100, 20).collect()):
        assert r.text is not None and len(r.text) == r["last"] - r.first <= 100
        got[r.video_id] = got.get(r.video_id, "") + (r.text if r.piece_no == 1 else r.text[20:])
    want = {}
    for _, v, _, t, _ in rows:
        want.setdefault(v, []).append(t)
    assert got == {v: " ".join(t) for v, t in want.items()}
    assert {r[0] for r in oversized(df, 100, 20).collect()} == {v for v, t in got.items() if len(t) > 100}
    assert pieces(df.limit(0)).count() == 0


def test_cuts_at_sentences():
    text = "a" * 30 + ". " + "b" * 30 + " " + "c" * 40
    assert natural_ends(text, np.array([62, len(text)]))[0].tolist() == [31, 62, len(text)]


def test_cuts_at_pauses_and_sentences_before_segment_ends(spark):
    ends, strong = natural_ends("aaaa. bbbb cccc dddd", np.array([10, 15, 20]), np.array([True, False, False]))
    assert ends.tolist() == [5, 10, 15, 20] and strong.tolist() == [5, 10]
    every, some = np.arange(10, 400, 10), np.array([70, 160, 250])
    assert greedy_cuts(every, 400, 100, 20, some).tolist() == [70, 150, 230, 310, 390, 400]
    assert greedy_cuts(every, 400, 100, 20, np.array([30])).tolist() == greedy_cuts(every, 400, 100, 20).tolist()
    words = ["a" * 9] * 12  # nine characters and a blank each
    rows = [(f"s{i}", "v", i * 2.0, i * 2.0 + (0.5 if i in (6, 9) else 1.9), t, "x") for i, t in enumerate(words)]
    rows[6] = (*rows[6][:3], None, *rows[6][4:])  # no end: no pause
    df = spark.createDataFrame(rows, "segment_id string, video_id string, start double, `end` double, text string, label string")
    assert [(r.first, r["last"]) for r in sorted(pieces(df, 110, 10).collect())] == [(0, 99), (89, 119)]
