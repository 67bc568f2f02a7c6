"""Queries on score aggregation, provenance and statistics over judged units (with DuckDB statements).

A unit is an order, its dimensions are the order's lines: score, weight and applicability follow from their columns,
tutors are order priorities and every third unit is an arc unit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tutorgrain.operators import aggregate as A
from tutorgrain.operators import stats as S
from tutorgrain.session import table

_DIM = "CASE l_linenumber " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(["error_detection", "error_reasoning", "scaffolding_quality", "solution_control", "student_level_calibration", "clarity_cognitive_load", "proactive_clarification"], 1)) + " END"
_DIMS = f"""SELECT l_orderkey AS unit, {_DIM} AS dimension, CASE WHEN CAST(l_tax * 100 AS INT) = 0 THEN NULL ELSE (CAST(l_quantity AS INT) % 3) / 2.0E0 END AS score,
  1.0E0 + CAST(l_discount * 100 AS INT) AS weight, CASE WHEN l_returnflag = 'N' AND l_linenumber % 2 = 0 THEN 'not_applicable' ELSE 'applicable' END AS applicability,
  CAST(l_quantity AS INT) AS q, l_suppkey AS supp, l_linenumber AS line, l_returnflag AS flag FROM lineitem"""
_UNITS = """SELECT o_orderkey AS unit, o_orderpriority AS tutor, CASE WHEN o_orderkey % 3 = 0 THEN 'arc' ELSE 'local' END AS family, CAST(1 + o_custkey % 4 AS BIGINT) AS n,
  CASE WHEN o_orderkey % 4 = 0 THEN (o_custkey % 5) / 4.0E0 END AS k_score, CASE WHEN o_orderkey % 7 = 0 THEN 0.5E0 END AS cap, o_orderstatus AS status, o_custkey AS cust FROM orders"""
_MACRO = "CASE WHEN tutor LIKE '1%' THEN 0.75E0 WHEN tutor LIKE '2%' THEN 0.5E0 END"
_CRIT = """SELECT l_orderkey AS unit, CAST(CASE WHEN l_linenumber % 3 = 0 THEN -(1 + l_suppkey % 3) ELSE 1 + l_partkey % 3 END AS BIGINT) AS weight,
  CASE WHEN CAST(l_tax * 100 AS INT) = 1 THEN NULL ELSE (CAST(l_quantity AS INT) % 3) / 2.0E0 END AS rating, CASE WHEN l_returnflag = 'R' THEN 'not_applicable' ELSE 'applicable' END AS applicability FROM lineitem"""
_LABEL = "CASE {0} % 4 WHEN 0 THEN '0' WHEN 1 THEN '0.5' WHEN 2 THEN '1' ELSE 'N/A' END"
_RATE = f"""SELECT l_returnflag || l_linestatus AS dim, {_LABEL.format('CAST(l_quantity AS INT)')} AS a, {_LABEL.format('(CAST(l_quantity AS INT) + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END)')} AS b,
  l_orderkey * 10 + l_linenumber AS row, l_orderkey AS cluster, (CAST(l_quantity AS INT) % 11 - 5) / 10.0E0 AS delta FROM lineitem"""
_SEQ = "SELECT l_orderkey AS g, l_linenumber AS pos, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS pred, max(CASE WHEN CAST(l_quantity AS INT) % 3 = 0 THEN 1 ELSE 0 END) AS gold FROM lineitem GROUP BY l_orderkey, l_linenumber"


def _sql(spark, d, text: str, *tables: str) -> DataFrame:
    return spark.sql(text.replace(" FROM lineitem", " FROM {lineitem}").replace(" FROM orders", " FROM {orders}"), **{t: table(spark, d, t) for t in tables})


def dims(spark, d):
    return _sql(spark, d, _DIMS, "lineitem")


def units(spark, d):
    return _sql(spark, d, _UNITS, "orders")


def ratings(spark, d):
    return _sql(spark, d, _RATE, "lineitem")


def _conf(spark, d):
    return S.confusion(ratings(spark, d), "dim", "a", "b")


def unit_scores(spark, d) -> DataFrame:
    p = A.weighted_mean(dims(spark, d), ["unit"]).withColumnRenamed("score", "p")
    return units(spark, d).join(p, "unit").withColumn("b", A.blend(F.col("p"), F.col("k_score"), 0.2)).withColumn("score", A.capped(F.col("b"), F.col("cap")))


def weighted_mean(spark, d):
    return A.weighted_mean(dims(spark, d), ["unit"]).withColumn("score", F.round("score", 6))


def blended_scores(spark, d):
    return unit_scores(spark, d).select("unit", F.round("b", 6).alias("b"), F.round("score", 6).alias("score"))


def exchange_weighted(spark, d):
    return A.exchange_weighted_mean(unit_scores(spark, d), ["tutor", "family"], "score", "n").withColumn("score", F.round("score", 6))


def _dialogues(spark, d):
    fam = A.exchange_weighted_mean(unit_scores(spark, d), ["tutor", "family"], "score", "n")
    wide = fam.groupBy("tutor").agg(F.max(F.when(F.col("family") == "local", F.col("score"))).alias("seg"), F.max(F.when(F.col("family") == "arc", F.col("score"))).alias("arc"))
    return wide.withColumn("m", F.expr(_MACRO))


def combine_scores(spark, d):
    micro = A.combine(F.col("seg"), F.col("arc"), 0.75)
    return _dialogues(spark, d).select("tutor", F.round(micro, 6).alias("micro"), F.round(A.combine(micro, F.col("m"), 0.75), 6).alias("total"))


def sensitivity_grid(spark, d):
    grid = A.sensitivity_grid(_dialogues(spark, d), "tutor", "seg", "arc", "m", 0.75, [0.0, 0.25, 0.5, 0.75, 1.0])
    return grid.withColumn("total", F.round("total", 6))


def ranking_stable(spark, d):
    return A.ranking_is_stable(A.sensitivity_grid(_dialogues(spark, d), "tutor", "seg", "arc", "m", 0.75, [0.0, 0.25, 0.5, 0.75, 1.0]), "tutor")


def trust_cap(spark, d):
    u = unit_scores(spark, d).withColumn("verdict", F.expr("CASE cust % 4 WHEN 0 THEN 'contradicted' WHEN 1 THEN 'minor_issue' ELSE 'supported' END"))
    return u.select("unit", F.round(A.trust_cap(F.col("b"), F.col("verdict"), (F.col("cust") / 4).cast("int") % 3), 6).alias("capped"))


def trust_audit(spark, d):
    u = unit_scores(spark, d)
    verdict = A.trust_audit(F.round("b", 6), F.when(F.col("cust") % 3 == 0, F.round("b", 6)).otherwise(F.round(F.col("b") * 0.5, 6)), F.col("cust") % 2 == 0)
    return u.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def criterion_score(spark, d):
    return A.criterion_score(_sql(spark, d, _CRIT, "lineitem"), ["unit"]).withColumn("score", F.round("score", 6))


def severity_strata(spark, d):
    return A.severity_strata(_sql(spark, d, _CRIT, "lineitem"))


def routed_scores(spark, d):
    rows = dims(spark, d).join(units(spark, d).select("unit", "family"), "unit")
    return A.weighted_mean(A.routed(rows, "v2"), ["unit", "family"]).withColumn("score", F.round("score", 6))


def _prov(spark, d):
    u = units(spark, d).withColumn("macro", F.expr(_MACRO))
    return A.provenance(u, dims(spark, d), 0.75, 0.25, 0.75)


def provenance_contrib(spark, d):
    p = _prov(spark, d)
    return p.select("tutor", "family", "unit", "dimension", *[F.round(c, 9).alias(c) for c in ("coefficient", "contribution", "recoverable")])


def improvement_targets(spark, d):
    return A.improvement_targets(_prov(spark, d), 20).select("tutor", "unit", "dimension", "recoverable", "rank")


def dimension_rollup(spark, d):
    r = A.dimension_rollup(_prov(spark, d))
    return r.select("tutor", "dimension", F.round("contribution", 6).alias("contribution"), F.round("recoverable", 6).alias("recoverable"), "units")


def reconstruct_check(spark, d):
    return _prov(spark, d).groupBy("tutor").agg(F.round(F.sum("contribution"), 6).alias("total"))


def panel_compare(spark, d):
    r = dims(spark, d).groupBy("unit", "dimension").agg(F.max("score").alias("score"), F.max("supp").alias("supp"))
    second = r.withColumn("score", F.expr("CASE WHEN supp % 10 = 0 THEN NULL WHEN supp % 10 = 1 THEN 1.0E0 - score ELSE score END"))
    p = A.judge_panel(r, second, ["unit", "dimension"], "score")
    return p.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("agreed")).alias("disagreed"), F.round(F.avg((~F.col("agreed")).cast("double")), 6).alias("rate"))


def dimension_means(spark, d):
    use = dims(spark, d).where("score IS NOT NULL AND applicability <> 'not_applicable'")
    return use.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.avg((F.col("score") < 1).cast("double")), 6).alias("shortfall_rate"))


def beta_sweep(spark, d):
    u = unit_scores(spark, d).withColumn("beta", F.explode(F.array(*map(F.lit, [0.0, 0.1, 0.2, 0.5]))))
    b = F.coalesce((1 - F.col("beta")) * F.col("p") + F.col("beta") * F.col("k_score"), F.col("p"))
    u = u.withColumn("bb", b).withColumn("binding", F.col("cap") < b).withColumn("s", A.capped(b, F.col("cap")))
    return u.where("s IS NOT NULL").groupBy("tutor", "beta").agg(F.round(F.sum(F.col("s") * F.col("n")) / F.sum("n"), 6).alias("score"), F.count_if("binding").alias("caps_binding"))


def score_decomposition(spark, d):
    u = unit_scores(spark, d).where("p IS NOT NULL")
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 6)
    return u.groupBy("tutor").agg(mean("p").alias("raw"), mean("b").alias("with_criteria"), mean("score").alias("capped"))


def exchange_contributions(spark, d):
    u = unit_scores(spark, d).withColumn("members", F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: (F.col("unit") + i) % 50))
    return A.per_exchange(u.select("family", "score", "members"), ["family"]).withColumn("contribution", F.round("contribution", 9))


def cohen_kappa(spark, d):
    return S.cohen_kappa(_conf(spark, d), "dim")


def weighted_kappa(spark, d):
    return S.weighted_kappa(_conf(spark, d), "dim")


def gwet_ac2(spark, d):
    return S.gwet_ac2(_conf(spark, d), "dim")


def ac2_disagreement_norm(spark, d):
    return S.gwet_ac2(_conf(spark, d).where("a <> 'N/A' AND b <> 'N/A'"), "dim", True)


def class_scores(spark, d):
    return S.class_scores(_conf(spark, d), "dim")


def macro_f1(spark, d):
    return S.macro_f1(_conf(spark, d), "dim")


def raw_agreement(spark, d):
    c = _conf(spark, d)
    both = (F.col("a") != "N/A") & (F.col("b") != "N/A")
    same_use = (F.col("a") == "N/A") == (F.col("b") == "N/A")
    n = F.sum("c")
    return c.groupBy("dim").agg(n.alias("n"), F.round(F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)) / n, 6).alias("raw"), F.round(F.sum(F.when(same_use, F.col("c")).otherwise(0)) / n, 6).alias("applicability"),
        F.round(F.sum(F.when(both & (F.col("a") == F.col("b")), F.col("c")).otherwise(0)) / F.nullif(F.sum(F.when(both, F.col("c")).otherwise(0)), F.lit(0)), 6).alias("rating"))


def entropy_stats(spark, d):
    return S.entropy_stats(ratings(spark, d), "dim", "a")


def ari(spark, d):
    return S.adjusted_rand(_conf(spark, d), "dim")


def v_measure(spark, d):
    return S.v_measure(_conf(spark, d), "dim")


def jackknife_ari(spark, d):
    return S.jackknife_ari(_conf(spark, d), "dim")


def boundary_metrics(spark, d):
    return S.boundary_scores(_sql(spark, d, _SEQ, "lineitem"), "g", "pred", "gold")


def windowdiff(spark, d):
    return S.window_diff(_sql(spark, d, _SEQ, "lineitem"), "g", "pos", "pred", "gold")


def wilson_ci(spark, d):
    c = dims(spark, d).groupBy("dimension").agg(F.count_if(F.col("score") == 1.0).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return c.select("dimension", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def _discordant(spark, d):
    r = ratings(spark, d)
    return r.groupBy("dim").agg(F.count_if((F.col("a") == "1") & (F.col("b") != "1")).alias("b_only"), F.count_if((F.col("a") != "1") & (F.col("b") == "1")).alias("c_only"))


def mcnemar_counts(spark, d):
    return _discordant(spark, d)


def mcnemar_p(spark, d):
    small = units(spark, d).groupBy((F.col("cust") % 50).alias("g")).agg(F.count_if((F.col("unit") % 11 == 0) & (F.col("n") > 2)).alias("b"), F.count_if((F.col("unit") % 13 == 0) & (F.col("n") > 1)).alias("c"))
    return small.select("g", "b", "c", F.round(S.mcnemar_exact(F.col("b"), F.col("c")), 6).alias("p"))


def fisher_p(spark, d):
    u = units(spark, d)
    hit, arc = F.col("unit") % 31 == 0, F.col("family") == "arc"
    t = u.groupBy((F.col("cust") % 50).alias("g")).agg(F.count_if(hit & arc).alias("a"), F.count_if(~hit & arc).alias("b"), F.count_if(hit & ~arc).alias("c"), F.count_if(~hit & ~arc).alias("e"))
    return t.select("g", "a", "b", "c", "e", F.round(S.fisher_exact(F.col("a"), F.col("b"), F.col("c"), F.col("e")), 6).alias("p"))


def sign_flip_p(spark, d):
    return S.sign_flip(ratings(spark, d), "dim", "row", "delta", 100_000)


def bootstrap_ci(spark, d):
    return S.bootstrap_mean(ratings(spark, d), "dim", "row", "delta", 10_000)


def cluster_bootstrap_ci(spark, d):
    return S.bootstrap_mean(ratings(spark, d), "dim", "cluster", "delta", 10_000, share=0.9875)


def permutation_p(spark, d):
    return S.permutation_test(ratings(spark, d).withColumn("first", F.col("dim").startswith("A")), "first", "delta", 20_000)


def known_groups(spark, d):
    return unit_scores(spark, d).where("score IS NOT NULL").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.avg((F.col("score") >= 0.5).cast("double")), 6).alias("rate"))


def localisation_confusion(spark, d):
    u = units(spark, d)
    flagged, error = F.col("cap").isNotNull(), F.col("cust") % 5 == 0
    c = u.groupBy("tutor").agg(F.count_if(flagged & error).alias("tp"), F.count_if(flagged & ~error).alias("fp"), F.count_if(~flagged & error).alias("fn"), F.count_if(~flagged & ~error).alias("tn"))
    pr, rc, base = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), (F.col("tp") + F.col("fn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return c.select("tutor", "tp", "fp", "fn", "tn", F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(pr / base, 6).alias("enrichment"), F.round(F.col("tn") / F.nullif(F.col("tn") + F.col("fp"), F.lit(0)), 6).alias("specificity"))


def did_common_support(spark, d):
    u = unit_scores(spark, d).where("score IS NOT NULL").withColumn("item", F.col("cust") % 97).withColumn("arm", F.when(F.col("unit") % 2 == 0, "clean").otherwise("corrupt"))
    cells = u.groupBy("item", "family", "arm").agg(F.avg("score").alias("s"))
    wide = cells.groupBy("item").agg(*[F.max(F.when((F.col("family") == f) & (F.col("arm") == a), F.col("s"))).alias(f"{f}_{a}") for f in ("local", "arc") for a in ("clean", "corrupt")])
    full = wide.dropna()
    diff = (F.col("local_clean") - F.col("local_corrupt")) - (F.col("arc_clean") - F.col("arc_corrupt"))
    return full.agg(F.count(F.lit(1)).alias("items"), F.round(F.avg(diff), 6).alias("did"))


QUERIES = {f.__name__: f for f in (weighted_mean, blended_scores, exchange_weighted, combine_scores, sensitivity_grid, ranking_stable, trust_cap, trust_audit, criterion_score, severity_strata, routed_scores, provenance_contrib, improvement_targets, dimension_rollup, reconstruct_check, panel_compare, dimension_means, beta_sweep, score_decomposition, exchange_contributions, cohen_kappa, weighted_kappa, gwet_ac2, ac2_disagreement_norm, class_scores, macro_f1, raw_agreement, entropy_stats, ari, v_measure, jackknife_ari, boundary_metrics, windowdiff, wilson_ci, mcnemar_counts, mcnemar_p, fisher_p, sign_flip_p, bootstrap_ci, cluster_bootstrap_ci, permutation_p, known_groups, localisation_confusion, did_common_support)}

_USE = "score IS NOT NULL AND applicability <> 'not_applicable'"
_B = f"""dims AS ({_DIMS}), units AS ({_UNITS}), pm AS (SELECT unit, sum(weight * score) FILTER ({_USE}) / nullif(sum(weight) FILTER ({_USE}), 0) AS p FROM dims GROUP BY unit),
us AS (SELECT u.*, p, coalesce(0.8 * p + 0.2 * k_score, p) AS b, CASE WHEN p IS NOT NULL THEN least(coalesce(0.8 * p + 0.2 * k_score, p), coalesce(cap, 1e300)) END AS score FROM units u JOIN pm ON pm.unit = u.unit)"""
_FAM = _B + ", fam AS (SELECT tutor, family, sum(score * n) / nullif(sum(n) FILTER (score IS NOT NULL), 0) AS score FROM us GROUP BY ALL), dia AS (SELECT tutor, max(score) FILTER (family = 'local') AS seg, max(score) FILTER (family = 'arc') AS arc, " + _MACRO + " AS m FROM fam GROUP BY tutor), mic AS (SELECT *, coalesce(0.75 * seg + 0.25 * arc, seg) AS micro FROM dia)"
_GRID = _FAM + ", grid AS (SELECT alpha, tutor, round(coalesce(alpha * micro + (1 - alpha) * m, micro), 9) AS total FROM mic, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS alpha)), gr AS (SELECT *, row_number() OVER (PARTITION BY alpha ORDER BY total DESC NULLS LAST, tutor) AS rank FROM grid)"
_R = f"r AS ({_RATE}), conf AS (SELECT dim, a, b, count(*) AS c FROM r GROUP BY ALL), m1 AS (SELECT dim, a AS l1, sum(c) AS n1 FROM conf GROUP BY ALL), m2 AS (SELECT dim, b AS l2, sum(c) AS n2 FROM conf GROUP BY ALL), tot AS (SELECT dim, CAST(sum(c) AS BIGINT) AS n FROM conf GROUP BY dim)"


def _dw(x: str, y: str) -> str:
    return f"CASE WHEN {x} = {y} THEN 0.0 WHEN TRY_CAST({x} AS DOUBLE) IS NULL OR TRY_CAST({y} AS DOUBLE) IS NULL THEN 1.0 ELSE abs(TRY_CAST({x} AS DOUBLE) - TRY_CAST({y} AS DOUBLE)) / span END"


_LV = ", lv AS (SELECT dim, list(DISTINCT l) AS levels, CASE WHEN max(TRY_CAST(l AS DOUBLE)) > min(TRY_CAST(l AS DOUBLE)) THEN max(TRY_CAST(l AS DOUBLE)) - min(TRY_CAST(l AS DOUBLE)) ELSE 1.0 END AS span FROM (SELECT dim, a AS l FROM conf UNION SELECT dim, b FROM conf) GROUP BY dim)"


def _ac2(conf_filter: str, weight: str) -> str:
    return f"""WITH r AS ({_RATE}), conf AS (SELECT dim, a, b, count(*) AS c FROM r {conf_filter} GROUP BY ALL), tot AS (SELECT dim, CAST(sum(c) AS BIGINT) AS n FROM conf GROUP BY dim){_LV},
 pa AS (SELECT conf.dim, sum(c * (1 - ({_dw('a', 'b')}))) AS agree FROM conf JOIN lv ON lv.dim = conf.dim GROUP BY conf.dim),
 half AS (SELECT dim, l, sum(c) / 2 AS m FROM (SELECT dim, a AS l, c FROM conf UNION ALL SELECT dim, b, c FROM conf) GROUP BY ALL),
 sp AS (SELECT half.dim, sum(m / n * (1 - m / n)) AS spread FROM half JOIN tot ON tot.dim = half.dim GROUP BY half.dim),
 px AS (SELECT dim, span, unnest(levels) AS x, levels FROM lv), py AS (SELECT dim, span, x, unnest(levels) AS y FROM px),
 tw AS (SELECT dim, sum({weight.format(_dw('x', 'y'))}) AS tw, count(DISTINCT x) AS q FROM py GROUP BY dim),
 z AS (SELECT tot.dim, n, agree, q, tw / (q * (q - 1)) * spread AS pe FROM tot JOIN pa ON pa.dim = tot.dim JOIN sp ON sp.dim = tot.dim JOIN tw ON tw.dim = tot.dim)
 SELECT dim, n, round(CASE WHEN q >= 2 AND pe < 1 THEN (agree / n - pe) / (1 - pe) END, 6) AS ac2 FROM z"""


_PROV = f"""WITH dims AS ({_DIMS}), units0 AS ({_UNITS}), units AS (SELECT *, {_MACRO} AS macro FROM units0), use AS (SELECT * FROM dims WHERE {_USE} AND weight > 0),
 per AS (SELECT *, weight / sum(weight) OVER (PARTITION BY unit) AS share FROM use), p AS (SELECT unit, sum(score * weight) / sum(weight) AS p FROM use GROUP BY unit),
 u1 AS (SELECT units.*, coalesce(0.75 * p + 0.25 * k_score, p) AS b FROM units JOIN p ON p.unit = units.unit), u2 AS (SELECT *, least(b, coalesce(cap, 1e300)) AS capped FROM u1),
 sums0 AS (SELECT tutor, family, sum(n) AS nf FROM u2 GROUP BY ALL), sums AS (SELECT *, count(*) OVER (PARTITION BY tutor) AS families FROM sums0),
 u AS (SELECT u2.*, (CASE WHEN macro IS NULL THEN 1.0E0 ELSE 0.75E0 END) * (CASE WHEN families = 1 THEN 1.0E0 WHEN u2.family = 'arc' THEN 0.25E0 ELSE 0.75E0 END) * n / nf AS coef FROM u2 JOIN sums ON sums.tutor = u2.tutor AND sums.family = u2.family),
 parts AS (SELECT tutor, family, u.unit, dimension, coef * CASE WHEN k_score IS NOT NULL THEN 0.75E0 ELSE 1.0E0 END * share AS coefficient, per.score AS s FROM u JOIN per ON per.unit = u.unit
   UNION ALL SELECT tutor, family, unit, 'criteria', coef * 0.25E0, k_score FROM u WHERE k_score IS NOT NULL),
 prov AS (SELECT tutor, family, unit, dimension, coefficient, coefficient * s AS contribution, coefficient * (1 - s) AS recoverable FROM parts
   UNION ALL SELECT tutor, family, unit, 'cap_adjustment', 0.0, coef * (capped - b), coef * (b - capped) FROM u WHERE capped < b
   UNION ALL SELECT tutor, 'macro', NULL, 'macro', 0.25, 0.25 * max(macro), 0.25 * (1 - max(macro)) FROM u WHERE macro IS NOT NULL GROUP BY tutor)"""
_MEAN = "round(sum({0} * n) / sum(n), 6)"

SQL = {
    "weighted_mean": f"WITH {_B} SELECT unit, round(p, 6) AS score FROM pm",
    "blended_scores": f"WITH {_B} SELECT unit, round(b, 6) AS b, round(score, 6) AS score FROM us",
    "exchange_weighted": f"WITH {_FAM} SELECT tutor, family, round(score, 6) AS score FROM fam",
    "combine_scores": f"WITH {_FAM} SELECT tutor, round(micro, 6) AS micro, round(coalesce(0.75 * micro + 0.25 * m, micro), 6) AS total FROM mic",
    "sensitivity_grid": f"WITH {_GRID} SELECT CAST(alpha AS DOUBLE) AS alpha, tutor, round(total, 6) AS total, rank FROM gr",
    "ranking_stable": f"WITH {_GRID} SELECT NOT bool_or(m) AS stable FROM (SELECT min(rank) <> max(rank) AS m FROM gr GROUP BY tutor)",
    "trust_cap": f"WITH {_B} SELECT unit, round(CASE WHEN b IS NULL THEN NULL WHEN cust % 4 = 0 THEN least(b, CASE (cust // 4) % 3 WHEN 2 THEN 0.25 WHEN 1 THEN 0.5 ELSE 0.9 END) WHEN cust % 4 = 1 THEN least(b, 0.9) ELSE b END, 6) AS capped FROM us",
    "trust_audit": f"""WITH {_B}, x AS (SELECT round(b, 6) AS pre, CASE WHEN cust % 3 = 0 THEN round(b, 6) ELSE round(b * 0.5, 6) END AS rep, cust % 2 = 0 AS fl FROM us)
      SELECT CASE WHEN pre IS NULL OR rep IS NULL THEN 'not_comparable' WHEN NOT fl AND abs(pre - rep) > 1e-9 THEN 'unexplained_change' WHEN fl AND rep > pre + 1e-9 THEN 'missing_reduction' ELSE 'consistent' END AS verdict, count(*) AS n FROM x GROUP BY ALL""",
    "criterion_score": f"WITH c AS ({_CRIT}), k AS (SELECT *, rating IS NOT NULL AND applicability <> 'not_applicable' AND weight <> 0 AS use FROM c) SELECT unit, round(sum(abs(weight) * CASE WHEN weight < 0 THEN 1 - rating ELSE rating END) FILTER (use) / nullif(sum(abs(weight)) FILTER (use), 0), 6) AS score FROM k GROUP BY unit",
    "severity_strata": f"WITH c AS ({_CRIT}), k AS (SELECT *, CASE WHEN weight < 0 THEN 1 - rating ELSE rating END AS q FROM c WHERE rating IS NOT NULL AND applicability <> 'not_applicable' AND weight <> 0) SELECT abs(weight) AS severity, CASE WHEN weight > 0 THEN 'positive' ELSE 'negative' END AS polarity, count(*) AS n, count(*) FILTER (q < 1) AS any_shortfall, count(*) FILTER (q <= 0) AS full_shortfall FROM k GROUP BY ALL",
    "routed_scores": f"WITH dims AS ({_DIMS}), units AS ({_UNITS}), x AS (SELECT d.*, family FROM dims d JOIN units u ON u.unit = d.unit WHERE (family = 'arc') = (dimension IN ('scaffolding_quality', 'student_level_calibration', 'proactive_clarification'))) SELECT unit, family, round(sum(weight * score) FILTER ({_USE}) / nullif(sum(weight) FILTER ({_USE}), 0), 6) AS score FROM x GROUP BY ALL",
    "provenance_contrib": f"{_PROV} SELECT tutor, family, unit, dimension, round(coefficient, 9) AS coefficient, round(contribution, 9) AS contribution, round(recoverable, 9) AS recoverable FROM prov",
    "improvement_targets": f"{_PROV}, x AS (SELECT tutor, unit, dimension, round(recoverable, 9) AS recoverable FROM prov) SELECT *, row_number() OVER (PARTITION BY tutor ORDER BY recoverable DESC, unit NULLS FIRST, dimension) AS rank FROM x WHERE recoverable > 0 QUALIFY rank <= 20",
    "dimension_rollup": f"{_PROV} SELECT tutor, dimension, round(sum(contribution), 6) AS contribution, round(sum(recoverable), 6) AS recoverable, count(*) AS units FROM prov GROUP BY ALL",
    "reconstruct_check": f"""WITH dims AS ({_DIMS}), units0 AS ({_UNITS}), units AS (SELECT *, {_MACRO} AS macro FROM units0), p AS (SELECT unit, sum(score * weight) / sum(weight) AS p FROM dims WHERE {_USE} GROUP BY unit),
      s AS (SELECT tutor, family, macro, n, least(coalesce(0.75 * p + 0.25 * k_score, p), coalesce(cap, 1e300)) AS s FROM units JOIN p ON p.unit = units.unit), f AS (SELECT tutor, family, max(macro) AS m, sum(s * n) / sum(n) AS s FROM s GROUP BY ALL),
      w AS (SELECT tutor, max(m) AS m, coalesce(0.75 * max(s) FILTER (family = 'local') + 0.25 * max(s) FILTER (family = 'arc'), max(s)) AS micro FROM f GROUP BY tutor) SELECT tutor, round(coalesce(0.75 * micro + 0.25 * m, micro), 6) AS total FROM w""",
    "panel_compare": f"WITH r0 AS ({_DIMS}), r AS (SELECT unit, dimension, max(score) AS score, max(supp) AS supp FROM r0 GROUP BY ALL), x AS (SELECT dimension, score AS a, CASE WHEN supp % 10 = 0 THEN NULL WHEN supp % 10 = 1 THEN 1.0 - score ELSE score END AS b FROM r) SELECT dimension, count(*) AS n, count(*) FILTER (a IS DISTINCT FROM b) AS disagreed, round(avg(CASE WHEN a IS DISTINCT FROM b THEN 1.0 ELSE 0.0 END), 6) AS rate FROM x GROUP BY dimension",
    "dimension_means": f"WITH r AS ({_DIMS}) SELECT dimension, count(*) AS n, round(avg(score), 6) AS mean, round(avg(CASE WHEN score < 1 THEN 1.0 ELSE 0.0 END), 6) AS shortfall_rate FROM r WHERE {_USE} GROUP BY dimension",
    "beta_sweep": f"WITH {_B}, x AS (SELECT tutor, CAST(beta AS DOUBLE) AS beta, n, cap, coalesce((1 - beta) * p + beta * k_score, p) AS bb FROM us, (SELECT unnest([0.0, 0.1, 0.2, 0.5]) AS beta)) SELECT tutor, beta, round(sum(least(bb, coalesce(cap, 1e300)) * n) / sum(n), 6) AS score, count(*) FILTER (cap < bb) AS caps_binding FROM x WHERE bb IS NOT NULL GROUP BY ALL",
    "score_decomposition": f"WITH {_B} SELECT tutor, {_MEAN.format('p')} AS raw, {_MEAN.format('b')} AS with_criteria, {_MEAN.format('score')} AS capped FROM us WHERE p IS NOT NULL GROUP BY tutor",
    "exchange_contributions": f"WITH {_B}, t AS (SELECT family, sum(n) AS total FROM us WHERE score IS NOT NULL GROUP BY family), e AS (SELECT family, score, (unit + unnest(generate_series(1, n))) % 50 AS exchange FROM us WHERE score IS NOT NULL) SELECT e.family, exchange, round(sum(score / total), 9) AS contribution FROM e JOIN t ON t.family = e.family GROUP BY ALL",
    "cohen_kappa": f"WITH {_R}, pe AS (SELECT m1.dim, sum(n1 * n2) AS e FROM m1 JOIN m2 ON m2.dim = m1.dim AND l1 = l2 GROUP BY m1.dim), po AS (SELECT dim, sum(CASE WHEN a = b THEN c ELSE 0 END) AS o FROM conf GROUP BY dim) SELECT tot.dim, n, round(CASE WHEN n >= 2 AND e / (n * n) < 1 THEN (o / n - e / (n * n)) / (1 - e / (n * n)) END, 6) AS kappa FROM tot JOIN po ON po.dim = tot.dim JOIN pe ON pe.dim = tot.dim",
    "weighted_kappa": f"WITH {_R}{_LV}, o AS (SELECT conf.dim, sum(c * ({_dw('a', 'b')})) AS o FROM conf JOIN lv ON lv.dim = conf.dim GROUP BY conf.dim), e AS (SELECT m1.dim, sum(n1 * n2 * ({_dw('l1', 'l2')})) AS e FROM m1 JOIN m2 ON m2.dim = m1.dim JOIN lv ON lv.dim = m1.dim GROUP BY m1.dim) SELECT tot.dim, n, round(CASE WHEN e > 0 THEN 1 - (o / n) / (e / (n * n)) END, 6) AS weighted_kappa FROM tot JOIN o ON o.dim = tot.dim JOIN e ON e.dim = tot.dim",
    "gwet_ac2": _ac2("", "1 - ({0})"),
    "ac2_disagreement_norm": _ac2("WHERE a <> 'N/A' AND b <> 'N/A'", "{0}"),
    "class_scores": f"WITH {_R}, g AS (SELECT coalesce(m1.dim, m2.dim) AS dim, coalesce(l1, l2) AS label, coalesce(n1, 0) AS support, coalesce(n2, 0) AS predicted FROM m1 FULL JOIN m2 ON m2.dim = m1.dim AND l1 = l2), x AS (SELECT g.*, coalesce(c, 0) AS tp FROM g LEFT JOIN conf ON conf.dim = g.dim AND a = label AND b = label), y AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM x) SELECT dim, label, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM y",
    "raw_agreement": f"WITH {_R} SELECT dim, CAST(sum(c) AS BIGINT) AS n, round(sum(CASE WHEN a = b THEN c ELSE 0 END) / sum(c), 6) AS raw, round(sum(CASE WHEN (a = 'N/A') = (b = 'N/A') THEN c ELSE 0 END) / sum(c), 6) AS applicability, round(sum(CASE WHEN a <> 'N/A' AND a = b THEN c ELSE 0 END) / nullif(sum(CASE WHEN a <> 'N/A' AND b <> 'N/A' THEN c ELSE 0 END), 0), 6) AS rating FROM conf GROUP BY dim",
    "entropy_stats": f"WITH r AS ({_RATE}) SELECT dim, count(*) AS n, round(entropy(a), 6) AS entropy_bits, round((SELECT max(c) FROM (SELECT count(*) AS c FROM r r2 WHERE r2.dim = r.dim GROUP BY a)) / count(*), 6) AS modal_share, round(avg(CASE WHEN a = 'N/A' THEN 1.0 ELSE 0.0 END), 6) AS na_share, round(coalesce(var_samp(TRY_CAST(a AS DOUBLE)), 0), 6) AS variance FROM r GROUP BY dim",
    "ari": f"WITH {_R}, i AS (SELECT dim, sum(c * (c - 1) / 2) AS i FROM conf GROUP BY dim), sa AS (SELECT dim, sum(n1 * (n1 - 1) / 2) AS sa FROM m1 GROUP BY dim), sb AS (SELECT dim, sum(n2 * (n2 - 1) / 2) AS sb FROM m2 GROUP BY dim) SELECT tot.dim, n, round((i - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) AS ari FROM tot JOIN i ON i.dim = tot.dim JOIN sa ON sa.dim = tot.dim JOIN sb ON sb.dim = tot.dim",
    "v_measure": f"WITH {_R}, mi AS (SELECT conf.dim, sum(c / n * ln(CAST(c AS DOUBLE) * n / (CAST(n1 AS DOUBLE) * n2))) AS mi FROM conf JOIN m1 ON m1.dim = conf.dim AND l1 = a JOIN m2 ON m2.dim = conf.dim AND l2 = b JOIN tot ON tot.dim = conf.dim GROUP BY conf.dim), ha AS (SELECT m1.dim, -sum(n1 / n * ln(n1 / n)) AS h FROM m1 JOIN tot ON tot.dim = m1.dim GROUP BY m1.dim), hb AS (SELECT m2.dim, -sum(n2 / n * ln(n2 / n)) AS h FROM m2 JOIN tot ON tot.dim = m2.dim GROUP BY m2.dim) SELECT mi.dim, round(mi / ha.h, 6) AS homogeneity, round(mi / hb.h, 6) AS completeness, round(2 * (mi / ha.h) * (mi / hb.h) / (mi / ha.h + mi / hb.h), 6) AS v FROM mi JOIN ha ON ha.dim = mi.dim JOIN hb ON hb.dim = mi.dim",
    "boundary_metrics": f"WITH s AS ({_SEQ}), c AS (SELECT g, count(*) FILTER (pred = 1 AND gold = 1) AS tp, count(*) FILTER (pred = 1 AND gold = 0) AS fp, count(*) FILTER (pred = 0 AND gold = 1) AS fn FROM s GROUP BY g), p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM c) SELECT g, tp, fp, fn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) AS f1 FROM p",
    "windowdiff": f"WITH s AS ({_SEQ}), z AS (SELECT g, count(*) AS n, greatest(1, CAST(round_even((count(*) + 1) / (sum(gold) + 1) / 2, 0) AS INTEGER)) AS k0 FROM s GROUP BY g), k AS (SELECT g, n, CASE WHEN k0 >= n THEN greatest(1, n - 1) ELSE k0 END AS k FROM z), o AS (SELECT s.*, row_number() OVER (PARTITION BY g ORDER BY pos) AS i FROM s), w AS (SELECT a.g, a.i, k.k, sum(b.pred) AS p, sum(b.gold) AS q FROM o a JOIN k ON k.g = a.g JOIN o b ON b.g = a.g AND b.i BETWEEN a.i AND a.i + k.k - 1 WHERE a.i + k.k - 1 <= k.n GROUP BY ALL) SELECT g, CAST(max(k) AS INTEGER) AS k, round(avg(CASE WHEN p <> q THEN 1.0 ELSE 0.0 END), 6) AS windowdiff FROM w GROUP BY g",
    "wilson_ci": f"WITH r AS ({_DIMS}), c AS (SELECT dimension, count(*) FILTER (score = 1.0) AS k, count(*) AS n FROM r GROUP BY dimension) SELECT dimension, k, n, round(greatest(0, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS low, round(least(1, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS high FROM c",
    "mcnemar_counts": f"WITH r AS ({_RATE}) SELECT dim, count(*) FILTER (a = '1' AND b <> '1') AS b_only, count(*) FILTER (a <> '1' AND b = '1') AS c_only FROM r GROUP BY dim",
    "known_groups": f"WITH {_B} SELECT status, count(*) AS n, round(avg(score), 6) AS mean, round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM us WHERE score IS NOT NULL GROUP BY status",
    "localisation_confusion": f"WITH u AS ({_UNITS}), c AS (SELECT tutor, count(*) FILTER (cap IS NOT NULL AND cust % 5 = 0) AS tp, count(*) FILTER (cap IS NOT NULL AND cust % 5 <> 0) AS fp, count(*) FILTER (cap IS NULL AND cust % 5 = 0) AS fn, count(*) FILTER (cap IS NULL AND cust % 5 <> 0) AS tn FROM u GROUP BY tutor) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp / nullif(tp + fp, 0) / ((tp + fn) / (tp + fp + fn + tn)), 6) AS enrichment, round(tn / nullif(tn + fp, 0), 6) AS specificity FROM c",
    "did_common_support": f"WITH {_B}, c AS (SELECT cust % 97 AS item, avg(score) FILTER (family = 'local' AND unit % 2 = 0) AS a, avg(score) FILTER (family = 'local' AND unit % 2 = 1) AS b, avg(score) FILTER (family = 'arc' AND unit % 2 = 0) AS e, avg(score) FILTER (family = 'arc' AND unit % 2 = 1) AS f FROM us WHERE score IS NOT NULL GROUP BY ALL) SELECT count(*) AS items, round(avg((a - b) - (e - f)), 6) AS did FROM c WHERE a IS NOT NULL AND b IS NOT NULL AND e IS NOT NULL AND f IS NOT NULL",
}
SQL["macro_f1"] = f"SELECT dim, round(avg(f1), 6) AS macro_f1 FROM ({SQL['class_scores'].replace('round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6)', 'CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END')}) GROUP BY dim"
