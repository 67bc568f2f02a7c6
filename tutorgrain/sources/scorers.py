"""Seams for model-backed scorers and judges; without a model they replay or use deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def score_pairs(df: DataFrame, left: str, right: str, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], out: str = "score") -> DataFrame:
    """``df`` with a score per text pair; ``load`` runs once per worker and returns the scoring function."""
    def scan(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in batches:
            yield pd.Series(model(list(zip(a.fillna(""), b.fillna("")))), dtype="float64")

    return df.withColumn(out, F.pandas_udf(scan, "double")(F.col(left), F.col(right)))


def overlap_scorer() -> Callable[[list[tuple[str, str]]], list[float]]:
    """A stand-in cross-encoder: share of the right text's words that the left one holds."""
    def score(pairs: list[tuple[str, str]]) -> list[float]:
        return [len(set(a.lower().split()) & set(b.lower().split())) / max(1, len(set(b.lower().split()))) for a, b in pairs]

    return score


def replay_judge(prompts: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Prompts with the recorded response of each; prompts without one keep a null, so they are counted as missing."""
    return prompts.join(responses, key, "left")


def order_averaged(forward: DataFrame, backward: DataFrame, keys: list[str], p: str) -> DataFrame:
    """Option probabilities averaged over the forward and the reversed option order."""
    both = forward.select(*keys, p).unionByName(backward.select(*keys, p))
    return both.groupBy(*keys).agg(F.avg(p).alias(p))


def apply_tie_break(pool: DataFrame, probabilities: DataFrame, key: str, least_p: float = 0.5, least_margin: float = 0.5, most_pool_margin: float = 999.0, epsilon: float = 1e-4) -> DataFrame:
    """The pool with the preferred unit promoted just above the leader where the preference is clear.

    ``pool``: (key, unit_id, score, pool_rank); ``probabilities``: (key, unit_id, p). Skipped where the pool's own margin is
    larger than ``most_pool_margin``.
    """
    w = Window.partitionBy(key)
    ranked = probabilities.withColumn("k", F.row_number().over(w.orderBy(F.col("p").desc(), "unit_id")))
    pick = ranked.groupBy(key).agg(F.max(F.when(F.col("k") == 1, F.col("unit_id"))).alias("pick"), F.max(F.when(F.col("k") == 1, F.col("p"))).alias("p1"), F.max(F.when(F.col("k") == 2, F.col("p"))).alias("p2"))
    pick = pick.where((F.col("p1") >= least_p) & (F.col("p1") - F.coalesce("p2", F.lit(0.0)) >= least_margin))
    top = pool.groupBy(key).agg(F.max("score").alias("lead"), (F.max(F.when(F.col("pool_rank") == 1, F.col("score"))) - F.coalesce(F.max(F.when(F.col("pool_rank") == 2, F.col("score"))), F.lit(0.0))).alias("gap"))
    j = pool.join(top, key).join(pick, key, "left")
    promoted = F.coalesce((F.col("pick") == F.col("unit_id")) & (F.col("gap") <= most_pool_margin), F.lit(False))
    j = j.withColumn("score", F.when(promoted & (F.col("pool_rank") > 1), F.col("lead") + epsilon).otherwise(F.col("score"))).withColumn("promoted", promoted)
    return j.withColumn("pool_rank", F.row_number().over(w.orderBy(F.col("score").desc(), "unit_id"))).select(*pool.columns, "promoted")
