"""The pN_ queries over the tables of TESTDATA.md."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrain.llm import components, langid, mixing, names, packing, shared_spans, splitting, turns, visual_form
from reelgrain.llm.oracle import ORACLE
from reelgrain.storage import scoped, table

Query = Callable[[SparkSession, str], DataFrame]


def _limit(spark: SparkSession, d: str, name: str) -> int:
    """A row of task_limits, a table of fixed size."""
    return table(spark, d, "task_limits").where(f"limit_name = '{name}'").select("amount").first()[0]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_segments(table(spark, d, "case_c_video2"), _limit(spark, d, "shared_span_min"))


def p1_shared_share(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_share(table(spark, d, "case_c_video2"), _limit(spark, d, "shared_span_min")).drop("spans")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.match_groups(table(spark, d, "comparison_results"))


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    """p2_found with cells so small that the grid has many of them and representatives are exchanged at any size of the tables."""
    return components.match_groups(table(spark, d, "comparison_results"), edges_per_cell=1000)


def _contents(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "sample_titles").select(F.lit("title").alias("field"), F.col("video_id").alias("key"), F.col("title").alias("content"))
    lines = table(spark, d, "case_c_video2").select(F.lit("text").alias("field"), F.col("segment_id").alias("key"), F.col("text").alias("content"))
    return titles.unionByName(lines)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return visual_form.alike_pairs(_contents(spark, d))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return visual_form.alike_classes(_contents(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "case_c_video2"), _limit(spark, d, "piece_max"), _limit(spark, d, "piece_overlap"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "case_c_video2"), _limit(spark, d, "piece_max"), _limit(spark, d, "piece_overlap"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variants(table(spark, d, "comparison_results"), table(spark, d, "professor_detail"), table(spark, d, "sample_titles"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.turns(table(spark, d, "case_c_video2")).select("video_id", "turn_no", "speaker", "segment_id")


def p6_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.turns(table(spark, d, "case_c_video2"))


def p7_contents(spark: SparkSession, d: str) -> DataFrame:
    return packing.contents(packing.containers(table(spark, d, "documents"), _limit(spark, d, "container_capacity")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.containers(table(spark, d, "documents"), _limit(spark, d, "container_capacity"))
    return packed.select("container_id", F.size("items").alias("n_items"), "used", "unused")


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    return packing.invariants(packing.containers(table(spark, d, "documents"), _limit(spark, d, "container_capacity")), _limit(spark, d, "container_capacity"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.line_languages(table(spark, d, "documents"), only_doubtful=True).select("doc_id", "line_no", "lang")


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    return langid.line_languages(table(spark, d, "documents"))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return langid.segment_languages(table(spark, d, "documents"))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return langid.document_languages(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    own = {name: scoped(f) for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}
    return dict(sorted(own.items(), key=lambda x: (int(x[0][1 : x[0].index("_")]), not x[0].endswith("_found"))))


def oracle_sql() -> dict[str, str]:
    return ORACLE
