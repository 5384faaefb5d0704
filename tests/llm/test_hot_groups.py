"""A third of all rows in one group: results stay whole."""

from reelgrain.llm.components import connected_groups
from reelgrain.llm.shared_spans import shared_segments
from reelgrain.llm.visual_form import alike_pairs


def test_a_third_of_the_videos_are_copies(spark):
    text = "".join(chr(0xAC00 + i * 37 % 900) for i in range(60))
    rows = [(f"c{v}_{k}", f"c{v}", float(k), text[k * 20 : k * 20 + 20]) for v in range(30) for k in range(3)]
    rows += [(f"o{v}_0", f"o{v}", 0.0, "".join(chr(0x4E00 + v * 61 + i) for i in range(60))) for v in range(60)]
    df = spark.createDataFrame(rows, "segment_id string, video_id string, start double, text string")
    assert {r[0] for r in shared_segments(df, 40, gram=8, block=32).collect()} == {r[0] for r in rows if r[0][0] == "c"}


def test_a_hub_with_a_third_of_the_links(spark):
    edges = [("hub", f"x{i}") for i in range(200)] + [(f"y{i}", f"y{i + 1}") for i in range(400)]
    got = connected_groups(spark.createDataFrame(edges, "a string, b string"), "a", "b", edges_per_cell=40).collect()
    assert {r.group for r in got if r.vertex[0] != "y"} == {"hub"} and {r.group for r in got if r.vertex[0] == "y"} == {"y0"}


def test_many_copies_of_one_text(spark):
    rows = [("text", f"k{i:04}", "AB") for i in range(300)] + [("text", "z1", "ＡB"), ("text", "z2", "Ａ​B")]
    got = alike_pairs(spark.createDataFrame(rows, "field string, key string, content string"))
    assert got.count() == 300 * 2 + 1
