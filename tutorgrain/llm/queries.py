"""Queries of the training-data problems 1, 2 and 5 to 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tutorgrain.llm import conversations, leaks, packing, pairs, splitting, sql, topn, truncation
from tutorgrain.session import table
from tutorgrain.storage import materialize

_TURN = ("dialogue_id", "turn_id", "role", "text", "sent_at")


def p1_ranked(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n_per_group(table(spark, d, "candidate_hits"), "exchange_id", "unit_id", "best_score", "fused_rank", 5)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_ranked(spark, d).select("exchange_id", "unit_id")


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    return truncation.detect_truncated(table(spark, d, "raw_rows"), "row_id", "raw_response_text", "run_name")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).where("is_cut").select("row_id")


def p2_source_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(_cuts(spark, d), "run_name")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.find_defects(table(spark, d, "tutor_pairs"), "pair_id", "student.text", "tutor.text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.find_broken(table(spark, d, "turn_rows"), *_TURN)


def p6_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild(table(spark, d, "turn_rows"), *_TURN)


def p7_placements(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.oversized(p7_placements(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_fill(p7_placements(spark, d))


def p7_tier_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.tier_fill(p7_containers(spark, d))


def p7_faults(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return packing.packing_faults(docs, materialize(packing.pack(docs), "placements"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("item_id", "doc_id")


def p8_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "doc_kind")
    return leaks.without_leaks(docs, p8_leaks(spark, d))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_pieces(spark, d).where("piece_no = 0").select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_ranked, p2_found, p2_source_rates, p5_found, p6_found, p6_conversations, p7_found, p7_placements,
        p7_containers, p7_tier_fill, p7_faults, p8_found, p8_leaks, p8_clean_documents, p9_found, p9_pieces,
    )
}

SQL = {"p1_found": sql.P1_FOUND, "p1_ranked": sql.P1_RANKED, "p7_faults": sql.P7_FAULTS, "p6_found": sql.P6_FOUND, "p6_conversations": sql.P6_TURNS}
