import pytest
from reelgrain.llm.packing import Packer, containers, contents
from reelgrain.llm.tokens import encoder

SCHEMA = "doc_id long, text string, container_id string, used int"


@pytest.mark.parametrize("parts", [1, 5, 70])
def test_every_token_once(spark, parts):
    texts = ["word " * (i * 7 % 40) + str(i) for i in range(150)] + [None, "", "long text of words " * 60]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], SCHEMA).repartition(parts)
    rows = contents(containers(df, capacity=50, most_open=4)).collect()
    n = {i: len(encoder().encode_ordinary(t)) for i, t in enumerate(texts) if t}
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
    assert {d: sum(k for _, k in p) for d, p in got.items()} == n
    assert all(len(p) == -(-n[d] // 50) for d, p in got.items())
    by = {}
    for r in rows:
        by.setdefault(r.container_id, []).append(r)
    assert all(sum(x.n_tokens for x in c) == c[0].used == 50 - c[0].unused <= 50 for c in by.values())
    assert len(by) <= 1.15 * sum(n.values()) / 50 + 2


def test_empty(spark):
    assert containers(spark.createDataFrame([], SCHEMA)).count() == 0


def test_best_fit():
    p = Packer(10, 2, "t")
    for size in (6, 3, 5, 1):
        p.place(size, [size])
    # 3 joins the 6, 5 opens a second container, 1 fills the first
    assert p.taken()["items"].tolist() == [[6, 3, 1]]
    p.place(7, [7])
    p.place(8, [8])  # fits nowhere: the fullest open container is emitted
    assert p.taken()["items"].tolist() == [[7]]
    assert p.rest()["items"].tolist() == [[8], [5]]
