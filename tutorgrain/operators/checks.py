"""Baselines, integrity checks, anchors and diagnostics over assignments and responses."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorgrain.functions import text as T


def offset_accuracy(pred: DataFrame, gold: DataFrame, offsets: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(corpus, offset, n, exact): accuracy of predictions (corpus, item, idx, unit) against gold at idx + offset, at the best offset.

    Offsets are joined by equality, one row per prediction and offset; ties go to the smaller offset.
    """
    shifted = pred.withColumn("offset", F.explode(F.array(*map(F.lit, offsets)))).withColumn("at", F.col("idx") + F.col("offset"))
    g = gold.select("corpus", "item", F.col("idx").alias("at"), F.col("unit").alias("gold"))
    scored = shifted.join(g, ["corpus", "item", "at"]).groupBy("corpus", "offset").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("unit") == F.col("gold")).alias("hits"))
    best = scored.groupBy("corpus").agg(F.max(F.struct((F.col("hits") / F.col("n")).alias("a"), (-F.col("offset")).alias("o"), "n", "hits")).alias("b"))
    return best.select("corpus", (-F.col("b.o")).alias("offset"), F.col("b.n").alias("n"), F.round(F.col("b.a"), 6).alias("exact"))


def majority_baseline(gold: DataFrame) -> DataFrame:
    """(corpus, unit, n, share): the most frequent gold unit of each corpus; ties to the lower unit id."""
    c = gold.groupBy("corpus", "unit").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("corpus")
    ranked = c.withColumn("n", F.sum("c").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.col("c").desc(), "unit")))
    return ranked.where("k = 1").select("corpus", "unit", "n", F.round(F.col("c") / F.col("n"), 6).alias("share"))


def nearest_anchors(rows: DataFrame, label: str, reach: int = 3) -> DataFrame:
    """Rows with the nearest confident unit before and after, at most ``reach`` rows away."""
    w = Window.partitionBy("dialogue").orderBy("idx")
    unit = F.when(F.col(label).isin("AUTO_HIGH_KC", "AUTO_MEDIUM_KC"), F.col("unit_id"))
    left = F.last(unit, True).over(w.rowsBetween(-reach, -1))
    return rows.withColumn("left_anchor", left).withColumn("right_anchor", F.first(unit, True).over(w.rowsBetween(1, reach)))


def containment(texts: DataFrame, key: str, text: str, names: DataFrame, name_key: str, name: str) -> DataFrame:
    """(key, name_key): which names occur in which texts as whole words, by an n-gram join instead of a cross join."""
    tokens = F.split(T.match_normal(F.col(text)), " ")
    n = names.select(name_key, T.match_normal(F.col(name)).alias("gram")).where("gram <> ''").withColumn("len", F.size(F.split("gram", " ")))
    longest = n.agg(F.min("len"), F.max("len")).first()
    if longest[0] is None:
        return texts.select(key).limit(0).crossJoin(names.select(name_key).limit(0))
    grams = texts.select(key, F.explode(T.ngrams(tokens, longest[0], longest[1])).alias("gram"))
    return grams.join(n, "gram").select(key, name_key).distinct()


def criterion_integrity(judgments: DataFrame, library: DataFrame) -> DataFrame:
    """(status, n): judgments whose criterion is unknown, or whose unit or weight differs from the library's."""
    j = judgments.join(library.select("criterion_id", F.col("kc_id").alias("true_kc"), F.col("weight").alias("true_weight")), "criterion_id", "left")
    status = F.when(F.col("true_kc").isNull(), "unknown_criterion").when(F.col("kc_id") != F.col("true_kc"), "kc_mismatch").when(F.col("weight") != F.col("true_weight"), "weight_mismatch").otherwise("ok")
    return j.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def yes_no_rates(df: DataFrame, group: str, answer: str) -> DataFrame:
    """(group, yes, no, not_rated, rate): NA and blanks are not rated and leave the denominator."""
    a = F.upper(F.trim(F.coalesce(F.col(answer), F.lit(""))))
    out = df.groupBy(group).agg(F.count_if(a == "Y").alias("yes"), F.count_if(a == "N").alias("no"), F.count_if(~a.isin("Y", "N")).alias("not_rated"))
    return out.withColumn("rate", F.round(F.col("yes") / F.nullif(F.col("yes") + F.col("no"), F.lit(0)), 6))


def failure_mode(label: Column, size: Column, share: Column, margin: Column) -> Column:
    return (
        F.when(label == "NON_KC", "gated").when(F.coalesce(size, F.lit(0)) == 0, "no_candidates").when(label == "AUTO_HIGH_KC", "none")
        .when(share < 0.25, "scattered_branches").when(margin < 0.05, "close_race").otherwise("weak_support")
    )


def _ratio(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, (a or "").lower(), (b or "").lower(), autojunk=False).ratio()


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def conflict_checks(df: DataFrame, claim: str, definition: str, correction: str, least: float = 0.90) -> DataFrame:
    """``df`` with the mechanical stage of a claimed conflict: empty, same_words, near_copy, or kept."""
    norm = lambda c: T.match_normal(F.col(c))
    empty = (norm(claim) == "") | (norm(definition) == "")
    stage = F.when(empty, "empty").when(norm(claim) == norm(definition), "same_words")
    near = F.pandas_udf(_ratios, "double")(F.col(claim), F.coalesce(F.col(correction), F.lit(""))) >= least
    return df.withColumn("stage", F.coalesce(stage, F.when(near, "near_copy").otherwise("kept")))
