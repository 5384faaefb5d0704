import random

from reelgrain.llm.components import connected_groups, match_groups


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in parent}


def test_random_graphs_on_a_fine_grid(spark):
    rnd = random.Random(3)
    edges = [(f"n{rnd.randint(0, 120)}", f"n{rnd.randint(0, 120)}") for _ in range(70)]
    edges += [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("hub", f"l{i}") for i in range(40)]
    edges += edges[:9] + [("z", "z"), (None, "n1"), ("n1", None)] + [(b, a) for a, b in edges[:5]]
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r.vertex: r.group for r in connected_groups(df, "a", "b", edges_per_cell=20).collect()}
    assert got == brute(edges)


def test_grades_and_empty(spark):
    rows = [("a", "b", " HIGH "), ("b", "c", "critical"), ("c", "d", "normal"), ("e", "e", "high"), ("f", "g", None)]
    df = spark.createDataFrame(rows, "source_video_id string, target_video_id string, grade string")
    assert sorted(map(tuple, match_groups(df).collect())) == [("a", "a"), ("b", "a"), ("c", "a")]
    assert match_groups(df.limit(0)).count() == 0
