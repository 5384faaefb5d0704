import random

import pytest
from reelgrain.llm.shared_spans import shared_intervals, shared_segments, shared_share

SCHEMA = "segment_id string, video_id string, segment_index int, start double, text string"


def brute(texts: dict[str, str], n: int) -> dict[str, set[int]]:
    at: dict[str, set[str]] = {}
    for v, t in texts.items():
        for i in range(len(t) - n + 1):
            at.setdefault(t[i : i + n], set()).add(v)
    return {v: {j for i in range(len(t) - n + 1) if len(at[t[i : i + n]]) > 1 for j in range(i, i + n)} for v, t in texts.items()}


@pytest.mark.parametrize("seed", [1])
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    words = ["가나", "다", "abc", "de", "f😀g", "바사아"]
    common = [" ".join(rnd.choice(words) for _ in range(rnd.randint(10, 40))) for _ in range(4)] + ["a" * 60]
    rows, texts = [], {}
    for v in range(9):
        parts = [rnd.choice(common) if rnd.random() < 0.5 else " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(1, 7))]
        text = " ".join(parts)[rnd.randint(0, 9) :].strip()
        segs, i = [], 0
        while i < len(text):
            k = rnd.randint(1, 30)
            segs.append(text[i : i + k])
            i += k
        texts[f"v{v}"] = " ".join(segs)
        rows += [(f"v{v}_{k}", f"v{v}", k, float(k), s) for k, s in enumerate(segs)]
    rows += rows[:5] + [(None, "v1", 99, 5.5, None), ("x", "v1", 98, 5.25, ""), ("y", None, 0, 0.0, texts["v1"])]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(texts, 40)
    got: dict[str, set[int]] = {}
    for r in shared_intervals(df, 40, gram=12, block=64).collect():
        got.setdefault(r.video_id, set()).update(range(r.a, r.b))
    assert got == {v: s for v, s in want.items() if s}
    cases = set()
    for v in texts:
        off = 0
        for sid, _, _, _, t in [r for r in rows[:-8] if r[1] == v]:
            if set(range(off, off + len(t))) <= want[v]:
                cases.add(sid)
            off += len(t) + 1
    assert sorted(r[0] for r in shared_segments(df, 40, gram=12, block=64).collect()) == sorted(cases)
    share = {r.video_id: r for r in shared_share(df, 40, gram=12, block=64).collect()}
    assert {v: r.shared_chars for v, r in share.items()} == {v: len(s) for v, s in want.items()}


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", len long, off long, a string, h map<string,int>")
    assert shared_segments(df, 20).count() == 0
    assert shared_share(df, 20).count() == 0
