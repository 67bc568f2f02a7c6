"""Deterministic score aggregation: null is never zero, nothing applicable gives null, every weight is explicit.

Scores come long: one row per unit and dimension. All operators are one or two grouped aggregations with map-side
combine, so a unit, family or tutor may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
CAPS = {"single": 0.5, "several": 0.25, "minor": 0.9}
ARC_DIMENSIONS = {"v1": ["scaffolding_quality", "student_level_calibration"], "v2": ["scaffolding_quality", "student_level_calibration", "proactive_clarification"]}
DIMENSIONS = ["error_detection", "error_reasoning", "error_localisation", "solution_control", "scaffolding_quality", "actionability_moving_forward", "local_coherence_relevance", "clarity_cognitive_load", "student_level_calibration", "proactive_clarification"]
MACRO_DIMENSIONS = ["adaptability", "consistency", "outcome_completion", "sequentiality"]


def applicable(value: Column, applicability: Column) -> Column:
    return value.isNotNull() & ~F.coalesce(applicability == "not_applicable", F.lit(False))


def weighted_mean(df: DataFrame, keys: list[str], value: str = "score", weight: str = "weight", applicability: str = "applicability") -> DataFrame:
    """(keys, value): weighted mean over applicable values; null where none applies or the weights sum to zero."""
    use = applicable(F.col(value), F.col(applicability))
    num, den = F.sum(F.when(use, F.col(weight) * F.col(value))), F.sum(F.when(use, F.col(weight)))
    return df.groupBy(*keys).agg((num / F.nullif(den, F.lit(0.0))).alias(value))


def blend(p: Column, k: Column, beta: float) -> Column:
    """Generic and criterion score mixed; a missing criterion score leaves the generic one."""
    if not 0.0 <= beta <= 1.0:
        raise ValueError("beta must lie in 0..1")
    return F.coalesce((1.0 - beta) * p + beta * k, p)


def exchange_weighted_mean(df: DataFrame, keys: list[str], score: str, n: str, drop_null: bool = True) -> DataFrame:
    """Mean of unit scores weighted by their exchanges; ``drop_null=False`` keeps the weight of units without a score."""
    weight = F.when(F.col(score).isNotNull(), F.col(n)) if drop_null else F.col(n)
    return df.groupBy(*keys).agg((F.sum(F.col(score) * F.col(n)) / F.nullif(F.sum(weight), F.lit(0))).alias(score))


def combine(first: Column, second: Column, share: float) -> Column:
    """``share`` of the first plus the rest of the second; a missing second leaves the first."""
    return F.coalesce(share * first + (1.0 - share) * second, first)


def capped(score: Column, cap: Column) -> Column:
    """The smaller of score and cap; no cap leaves the score, no score stays null."""
    return F.when(score.isNotNull(), F.least(score, cap))


def trust_cap(score: Column, verdict: Column, material: Column) -> Column:
    """The score under its factuality cap: several material contradictions, one, or only minor ones."""
    wrong = verdict == "contradicted"
    cap = (
        F.when(wrong & (material >= 2), CAPS["several"]).when(wrong & (material == 1), CAPS["single"])
        .when(wrong | (verdict == "minor_issue"), CAPS["minor"])
    )
    return capped(score, cap)


def trust_audit(pre: Column, reported: Column, flagged: Column, tolerance: float = 1e-9) -> Column:
    """consistent, unexplained_change, missing_reduction or not_comparable."""
    return (
        F.when(pre.isNull() | reported.isNull(), "not_comparable")
        .when(~flagged & (F.abs(pre - reported) > tolerance), "unexplained_change")
        .when(flagged & (reported > pre + tolerance), "missing_reduction")
        .otherwise("consistent")
    )


def sensitivity_grid(df: DataFrame, key: str, segment: str, arc: str, macro: str, rho: float, alphas: list[float]) -> DataFrame:
    """(alpha, key, total, rank) of every dialogue for every alpha; rank by total descending, then by key."""
    micro = combine(F.col(segment), F.col(arc), rho)
    grid = df.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    total = F.coalesce(F.col("alpha") * micro + (1 - F.col("alpha")) * F.col(macro), micro)
    grid = grid.select("alpha", key, F.round(total, 9).alias("total"))
    order = Window.partitionBy("alpha").orderBy(F.col("total").desc_nulls_last(), key)
    return grid.withColumn("rank", F.row_number().over(order))


def ranking_is_stable(grid: DataFrame, key: str) -> DataFrame:
    """(stable): is every dialogue's rank the same for every alpha?"""
    moved = grid.groupBy(key).agg((F.min("rank") != F.max("rank")).alias("m"))
    return moved.agg((~F.coalesce(F.bool_or("m"), F.lit(False))).alias("stable"))


def criterion_quality(rating: Column, weight: Column) -> Column:
    """A rating as quality: negative criteria count inverted."""
    return F.when(weight < 0, 1.0 - rating).otherwise(rating)


def criterion_score(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score) from (weight, rating, applicability); zero weights and inapplicable ratings do not count."""
    use = applicable(F.col("rating"), F.col("applicability")) & (F.col("weight") != 0)
    w = F.abs("weight")
    num, den = F.sum(F.when(use, w * criterion_quality(F.col("rating"), F.col("weight")))), F.sum(F.when(use, w))
    return df.groupBy(*keys).agg((num / F.nullif(den, F.lit(0))).alias("score"))


def severity_strata(df: DataFrame) -> DataFrame:
    """(severity, polarity, n, any_shortfall, full_shortfall) by absolute weight and sign over applicable ratings."""
    use = df.where(applicable(F.col("rating"), F.col("applicability")) & (F.col("weight") != 0))
    q = criterion_quality(F.col("rating"), F.col("weight"))
    return use.groupBy(F.abs("weight").alias("severity"), F.when(F.col("weight") > 0, "positive").otherwise("negative").alias("polarity")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(q < 1.0).alias("any_shortfall"), F.count_if(q <= 0.0).alias("full_shortfall")
    )


def routed(df: DataFrame, version: str) -> DataFrame:
    """Rows whose dimension belongs to their family's scope: arc dimensions to ``arc`` units, the others to local ones."""
    arc = F.col("dimension").isin(ARC_DIMENSIONS[version])
    return df.where(((F.col("family") == "arc") & arc) | ((F.col("family") != "arc") & ~arc))


def provenance(units: DataFrame, dims: DataFrame, alpha: float, beta: float, rho: float) -> DataFrame:
    """Every dimension's exact share of a tutor's score: (tutor, family, unit, dimension, coefficient, contribution, recoverable).

    ``units``: (tutor, family, unit, n, k_score, cap, macro); ``dims``: (unit, dimension, score, weight, applicability).
    Criterion scores and binding caps get rows of their own (``criteria``, ``cap_adjustment``) and a macro score the row
    ``macro``, so that contributions sum to the tutor's score without a rest. Units without a score carry no weight.
    """
    use = dims.where(applicable(F.col("score"), F.col("applicability")) & (F.col("weight") > 0))
    per = use.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("unit")))
    p = use.groupBy("unit").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("p"))
    u = units.join(p, "unit").withColumn("b", blend(F.col("p"), F.col("k_score"), beta))
    u = u.withColumn("capped", capped(F.col("b"), F.col("cap")))
    sums = u.groupBy("tutor", "family").agg(F.sum("n").alias("n_family")).withColumn("families", F.count(F.lit(1)).over(Window.partitionBy("tutor")))
    u = u.join(sums, ["tutor", "family"])
    share = F.when(F.col("families") == 1, 1.0).when(F.col("family") == "arc", round(1.0 - rho, 12)).otherwise(rho)
    micro = F.when(F.col("macro").isNull(), 1.0).otherwise(alpha)
    u = u.withColumn("coef", micro * share * F.col("n") / F.col("n_family"))
    k = F.col("k_score").isNotNull() & F.lit(beta > 0)
    dim = u.join(per, "unit").select("tutor", "family", "unit", "dimension", (F.col("coef") * F.when(k, 1.0 - beta).otherwise(1.0) * F.col("share")).alias("coefficient"), F.col("score").alias("s"))
    crit = u.where(k).select("tutor", "family", "unit", F.lit("criteria").alias("dimension"), (F.col("coef") * beta).alias("coefficient"), F.col("k_score").alias("s"))
    rows = dim.unionByName(crit).select("tutor", "family", "unit", "dimension", "coefficient", (F.col("coefficient") * F.col("s")).alias("contribution"), (F.col("coefficient") * (1.0 - F.col("s"))).alias("recoverable"))
    binding = u.where("capped < b").select("tutor", "family", "unit", F.lit("cap_adjustment").alias("dimension"), F.lit(0.0).alias("coefficient"), (F.col("coef") * (F.col("capped") - F.col("b"))).alias("contribution"), (F.col("coef") * (F.col("b") - F.col("capped"))).alias("recoverable"))
    macro = u.where("macro IS NOT NULL").groupBy("tutor").agg(F.max("macro").alias("m")).select("tutor", F.lit("macro").alias("family"), F.lit(None).cast(units.schema["unit"].dataType).alias("unit"), F.lit("macro").alias("dimension"), F.lit(round(1 - alpha, 12)).alias("coefficient"), (round(1 - alpha, 12) * F.col("m")).alias("contribution"), (round(1 - alpha, 12) * (1 - F.col("m"))).alias("recoverable"))
    return rows.unionByName(binding).unionByName(macro)


def improvement_targets(prov: DataFrame, limit: int, least: float = 0.0) -> DataFrame:
    """The ``limit`` rows of each tutor with the most to recover, and their share of all that is recoverable."""
    w = Window.partitionBy("tutor")
    order = w.orderBy(F.col("recoverable").desc(), F.col("unit"), F.col("dimension"))
    out = prov.withColumn("recoverable", F.round("recoverable", 9)).withColumn("share_of_total", F.col("recoverable") / F.nullif(F.sum("recoverable").over(w), F.lit(0.0)))
    out = out.where(F.col("recoverable") > least).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= limit)


def dimension_rollup(prov: DataFrame) -> DataFrame:
    return prov.groupBy("tutor", "dimension").agg(
        F.sum("contribution").alias("contribution"), F.sum("recoverable").alias("recoverable"),
        F.count(F.lit(1)).alias("units"), F.count_if(F.col("recoverable") > 0).alias("units_short"),
    )


def judge_panel(primary: DataFrame, secondary: DataFrame, keys: list[str], score: str) -> DataFrame:
    """(keys, a, b, agreed): both judges' scores where both judged; null is a value of its own."""
    j = primary.select(*keys, F.col(score).cast("double").alias("a")).join(secondary.select(*keys, F.col(score).cast("double").alias("b")), keys)
    return j.withColumn("agreed", F.col("a").eqNullSafe(F.col("b")))


def per_exchange(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, exchange, contribution): each unit's score spread over its member exchanges, divided by all exchanges.

    ``units``: (keys, score, members array); units without a score or members do not count.
    """
    live = units.where("score IS NOT NULL AND size(members) > 0")
    total = live.groupBy(*keys).agg(F.sum(F.size("members")).alias("total"))
    rows = live.select(*keys, "score", F.explode("members").alias("exchange")).join(total, keys)
    return rows.groupBy(*keys, "exchange").agg(F.sum(F.col("score") / F.col("total")).alias("contribution"))
