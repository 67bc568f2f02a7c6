"""Agreement, partition, boundary and resampling statistics as aggregations.

Agreement statistics work on confusion counts, so their cost after one map-side-combined aggregation depends on the
labels, not on the rows. Resampling draws from a counter-based generator for cells of equal values, so its cost depends
on the distinct values and the replicates, not on the rows; no row is repeated by replicate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def confusion(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, a, b, c): label pairs and their counts; pairs with a null label are left out."""
    live = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return live.groupBy(group, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))


def _marginals(conf: DataFrame, group: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m1 = conf.groupBy(group, F.col("a").alias("l1")).agg(F.sum("c").alias("n1"))
    m2 = conf.groupBy(group, F.col("b").alias("l2")).agg(F.sum("c").alias("n2"))
    return m1, m2, conf.groupBy(group).agg(F.sum("c").alias("n"))


def cohen_kappa(conf: DataFrame, group: str) -> DataFrame:
    """(group, n, kappa): null below two pairs or where chance agreement is complete."""
    m1, m2, n = _marginals(conf, group)
    pe = m1.join(m2, group).where("l1 = l2").groupBy(group).agg(F.sum(F.col("n1") * F.col("n2")).alias("e"))
    po = conf.groupBy(group).agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("o"))
    j = n.join(po, group).join(pe, group, "left")
    o, e = F.col("o") / F.col("n"), F.coalesce(F.col("e"), F.lit(0)) / (F.col("n") * F.col("n"))
    return j.select(group, "n", F.round(F.when((F.col("n") >= 2) & (e < 1), (o - e) / (1 - e)), 6).alias("kappa"))


def _weight(a: Column, b: Column, span: Column) -> Column:
    """Linear disagreement of ordinal labels; N/A is a category of its own."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(a == b, 0.0).when(x.isNull() | y.isNull(), 1.0).otherwise(F.abs(x - y) / span)


def _levels(conf: DataFrame, group: str) -> DataFrame:
    both = conf.select(group, F.col("a").alias("l")).union(conf.select(group, F.col("b"))).distinct()
    x = F.col("l").try_cast("double")
    span = F.max(x) - F.min(x)
    return both.groupBy(group).agg(F.collect_set("l").alias("levels"), F.when(span > 0, span).otherwise(1.0).alias("span"))


def weighted_kappa(conf: DataFrame, group: str) -> DataFrame:
    """(group, n, weighted_kappa): linear weights over the observed levels; null where no disagreement is expected."""
    m1, m2, n = _marginals(conf, group)
    levels = _levels(conf, group)
    obs = conf.join(levels, group).groupBy(group).agg(F.sum(F.col("c") * _weight(F.col("a"), F.col("b"), F.col("span"))).alias("o"))
    exp = m1.join(m2, group).join(levels, group).groupBy(group).agg(F.sum(F.col("n1") * F.col("n2") * _weight(F.col("l1"), F.col("l2"), F.col("span"))).alias("e"))
    j = n.join(obs, group).join(exp, group)
    return j.select(group, "n", F.round(F.when(F.col("e") > 0, 1 - (F.col("o") / F.col("n")) / (F.col("e") / (F.col("n") * F.col("n")))), 6).alias("weighted_kappa"))


def gwet_ac2(conf: DataFrame, group: str, disagreement_norm: bool = False) -> DataFrame:
    """(group, n, ac2): chance by the weights of agreement, or by those of disagreement in the named variant."""
    levels = _levels(conf, group)
    n = conf.groupBy(group).agg(F.sum("c").alias("n"))
    pa = conf.join(levels, group).groupBy(group).agg(F.sum(F.col("c") * (1 - _weight(F.col("a"), F.col("b"), F.col("span")))).alias("agree"))
    half = conf.select(group, F.col("a").alias("l"), "c").union(conf.select(group, F.col("b"), "c")).groupBy(group, "l").agg((F.sum("c") / 2).alias("m"))
    spread = half.join(n, group).groupBy(group).agg(F.sum(F.col("m") / F.col("n") * (1 - F.col("m") / F.col("n"))).alias("spread"))
    pairs = levels.select(group, "span", F.explode("levels").alias("x"), "levels").select(group, "span", "x", F.explode("levels").alias("y"))
    w = _weight(F.col("x"), F.col("y"), F.col("span"))
    tw = pairs.groupBy(group).agg(F.sum(w if disagreement_norm else 1 - w).alias("tw"), F.countDistinct("x").alias("q"))
    j = n.join(pa, group).join(spread, group).join(tw, group)
    pe = F.col("tw") / (F.col("q") * (F.col("q") - 1)) * F.col("spread")
    ac2 = F.when((F.col("q") >= 2) & (pe < 1), (F.col("agree") / F.col("n") - pe) / (1 - pe))
    return j.select(group, "n", F.round(ac2, 6).alias("ac2"))


def class_scores(conf: DataFrame, group: str) -> DataFrame:
    """(group, label, support, predicted, precision, recall, f1): ``a`` is gold, ``b`` predicted; no cases give 0."""
    exact = _class_scores(conf, group)
    return exact.select(group, "label", "support", "predicted", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _class_scores(conf: DataFrame, group: str) -> DataFrame:
    gold = conf.groupBy(group, F.col("a").alias("label")).agg(F.sum("c").alias("support"))
    pred = conf.groupBy(group, F.col("b").alias("label")).agg(F.sum("c").alias("predicted"))
    hit = conf.where("a = b").select(group, F.col("a").alias("label"), F.col("c").alias("tp"))
    j = gold.join(pred, [group, "label"], "full").join(hit, [group, "label"], "left").fillna(0, ["support", "predicted", "tp"])
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return j.select(group, "label", "support", "predicted", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def macro_f1(conf: DataFrame, group: str) -> DataFrame:
    return _class_scores(conf, group).groupBy(group).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


def entropy_stats(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, n, entropy_bits, modal_share, na_share, variance): of labels; variance of the numeric ones, 0 below two."""
    c = df.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("c"))
    t = c.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(group)))
    x = F.col(label).try_cast("double")
    nn, s1, s2 = F.sum(F.when(x.isNotNull(), F.col("c"))), F.sum(x * F.col("c")), F.sum(x * x * F.col("c"))
    var = F.when(nn >= 2, (s2 - s1 * s1 / nn) / (nn - 1)).otherwise(0.0)
    return t.groupBy(group).agg(
        F.sum("c").alias("n"), F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy_bits"), F.round(F.max("p"), 6).alias("modal_share"),
        F.round(F.coalesce(F.sum(F.when(F.col(label) == "N/A", F.col("p"))), F.lit(0.0)), 6).alias("na_share"), F.round(var, 6).alias("variance"),
    )


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(conf: DataFrame, group: str) -> DataFrame:
    m1, m2, n = _marginals(conf, group)
    idx = conf.groupBy(group).agg(F.sum(_pairs(F.col("c"))).alias("i"))
    sa, sb = m1.groupBy(group).agg(F.sum(_pairs(F.col("n1"))).alias("sa")), m2.groupBy(group).agg(F.sum(_pairs(F.col("n2"))).alias("sb"))
    j = n.join(idx, group).join(sa, group).join(sb, group)
    exp, most = F.col("sa") * F.col("sb") / F.nullif(_pairs(F.col("n")), F.lit(0.0)), (F.col("sa") + F.col("sb")) / 2
    return j.select(group, "n", F.round(F.when((F.col("n") >= 2) & (most != exp), (F.col("i") - exp) / (most - exp)).otherwise(0.0), 6).alias("ari"))


def v_measure(conf: DataFrame, group: str) -> DataFrame:
    """(group, homogeneity, completeness, v): natural logarithms; a partition of one class is perfectly homogeneous."""
    m1, m2, n = _marginals(conf, group)
    h = lambda m, c, out: m.join(n, group).groupBy(group).agg((-F.sum(F.col(c) / F.col("n") * F.ln(F.col(c) / F.col("n")))).alias(out))
    full = conf.join(m1.withColumnRenamed("l1", "a"), [group, "a"]).join(m2.withColumnRenamed("l2", "b"), [group, "b"]).join(n, group)
    mi = full.groupBy(group).agg(F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("n1") * F.col("n2")))).alias("mi"))
    j = mi.join(h(m1, "n1", "ha"), group).join(h(m2, "n2", "hb"), group)
    hom = F.when(F.abs("ha") < 1e-12, 1.0).otherwise(F.col("mi") / F.col("ha"))
    com = F.when(F.abs("hb") < 1e-12, 1.0).otherwise(F.col("mi") / F.col("hb"))
    v = F.when(hom + com > 0, 2 * hom * com / (hom + com)).otherwise(0.0)
    return j.select(group, F.round(hom, 6).alias("homogeneity"), F.round(com, 6).alias("completeness"), F.round(v, 6).alias("v"))


def jackknife_ari(conf: DataFrame, group: str) -> DataFrame:
    """(group, n, ari, se): leave-one-out standard error of ARI, in closed form per cell instead of per row.

    Taking one row out of cell (a, b) lowers its cell and both margins by one, so rows of a cell share their replicate.
    """
    m1, m2, n = _marginals(conf, group)
    base = adjusted_rand(conf, group).select(group, "ari")
    i = conf.groupBy(group).agg(F.sum(_pairs(F.col("c"))).alias("i"))
    sa, sb = m1.groupBy(group).agg(F.sum(_pairs(F.col("n1"))).alias("sa")), m2.groupBy(group).agg(F.sum(_pairs(F.col("n2"))).alias("sb"))
    x = conf.join(m1.withColumnRenamed("l1", "a"), [group, "a"]).join(m2.withColumnRenamed("l2", "b"), [group, "b"]).join(n, group).join(i, group).join(sa, group).join(sb, group)
    i1, a1, b1 = F.col("i") - (F.col("c") - 1), F.col("sa") - (F.col("n1") - 1), F.col("sb") - (F.col("n2") - 1)
    exp, most = a1 * b1 / F.nullif(_pairs(F.col("n") - 1), F.lit(0.0)), (a1 + b1) / 2
    x = x.withColumn("r", F.when(most != exp, (i1 - exp) / (most - exp)).otherwise(0.0))
    s = x.groupBy(group).agg(F.max("n").alias("n"), F.sum(F.col("c") * F.col("r")).alias("s1"), F.sum(F.col("c") * F.col("r") * F.col("r")).alias("s2"))
    var = F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.lit(0.0)) * (F.col("n") - 1) / F.col("n")
    return s.join(base, group).select(group, "n", "ari", F.round(F.sqrt(var), 6).alias("se"))


def boundary_scores(df: DataFrame, group: str, pred: str, gold: str) -> DataFrame:
    """(group, tp, fp, fn, precision, recall, f1) of 0/1 boundary vectors given one row per position."""
    p, g = F.col(pred) == 1, F.col(gold) == 1
    c = df.groupBy(group).agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"))
    pr = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rc = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f1 = F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0)
    return c.select(group, "tp", "fp", "fn", F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def window_diff(df: DataFrame, group: str, position: str, pred: str, gold: str) -> DataFrame:
    """(group, k, windowdiff): windows of half the mean gold segment, half-even rounding, clamped below the length.

    Window sums are differences of running sums, so no window is materialised.
    """
    w = Window.partitionBy(group).orderBy(position)
    size = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(gold).alias("gs"))
    k = F.greatest(F.lit(1), F.bround((F.col("n") + 1) / (F.col("gs") + 1) / 2).cast("int"))
    size = size.withColumn("k", F.when(k >= F.col("n"), F.greatest(F.lit(1), F.col("n") - 1)).otherwise(k).cast("int"))
    run = df.withColumn("i", F.row_number().over(w)).withColumn("cp", F.sum(pred).over(w)).withColumn("cg", F.sum(gold).over(w)).join(size, group)
    later = run.select(group, (F.col("i") - F.col("k") + 1).alias("i"), F.col("cp").alias("ep"), F.col("cg").alias("eg"))
    starts = run.select(group, "i", "n", "k", (F.col("cp") - F.col(pred)).alias("sp"), (F.col("cg") - F.col(gold)).alias("sg"))
    j = starts.join(later, [group, "i"])
    differs = (F.col("ep") - F.col("sp")) != (F.col("eg") - F.col("sg"))
    return j.groupBy(group).agg(F.max("k").alias("k"), F.round(F.avg(differs.cast("double")), 6).alias("windowdiff"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval, clamped to 0..1; no trials give (0, 0)."""
    p, d = k / n, 1 + z * z / n
    c = (p + z * z / (2 * n)) / d
    h = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    none = n == 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), c - h)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), c + h))


def _log_choose(n: Column, k: Column) -> Column:
    """ln C(n, k) as a sum of k logarithms."""
    steps = F.sequence(F.lit(1), F.greatest(k, F.lit(1)))
    total = F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.ln((n - k + i) / i))
    return F.when(k <= 0, 0.0).otherwise(total)


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact p of discordant counts; 1 without any."""
    n, low = (b + c).cast("int"), F.least(b, c).cast("int")
    tail = F.aggregate(F.sequence(F.lit(0), low), F.lit(0.0), lambda a, i: a + F.exp(_log_choose(n, i) - n * F.ln(F.lit(2.0))))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


FISHER_CHUNK = 1_000_000  # tables a step


def _log_ratios(r1: int, r2: int, c1: int, x: int, step: int) -> Iterator[np.ndarray]:
    """ln P(x + step k) - ln P(x) for k = 1, 2, ... in chunks, until what follows adds nothing to a sum of them and 1."""
    last, reached, top = (min(r1, c1) if step > 0 else max(0, c1 - r2)), 0.0, 0.0
    while x != last:
        at = np.arange(x, x + step * min(FISHER_CHUNK, abs(last - x)), step, dtype=np.float64)
        if step > 0:
            ratio = np.log((r1 - at) * (c1 - at)) - np.log((at + 1) * (r2 - c1 + at + 1))
        else:
            ratio = np.log(at * (r2 - c1 + at)) - np.log((r1 - at + 1) * (c1 - at + 1))
        steps = reached + np.cumsum(ratio)
        yield steps
        x, reached, top = x + step * len(at), float(steps[-1]), max(top, float(steps.max()))
        if reached < top - 800 and ratio[-1] < 0:  # ratios only fall, and exp(-800) is 0
            return


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided exact p of a 2x2 table: all tables at most as likely as the observed one.

    Each table's likelihood follows from its neighbour's, outward from the observed one, so the work grows with the
    counts and not with their square.
    """

    def one(a: int, b: int, c: int, d: int) -> float:
        r1, r2, c1 = a + b, c + d, a + c
        top = max((float(x.max()) for s in (1, -1) for x in _log_ratios(r1, r2, c1, a, s)), default=0.0)
        top = max(top, 0.0)
        total = hit = np.exp(-top)
        for step in (1, -1):
            for x in _log_ratios(r1, r2, c1, a, step):
                p = np.exp(x - top)
                total, hit = total + p.sum(), hit + p[x <= 1e-9].sum()
        return min(1.0, float(hit / total))

    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(w + x + y + z) else one(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)], dtype="float64")

    return F.pandas_udf(p, "double")(*[x.cast("bigint") for x in (a, b, c, d)])


BATCHES = 16


def _cells(df: DataFrame, group: str, row: str, value: Column) -> DataFrame:
    """(group, s, n, c): ``c`` keys ``row`` of a group hold ``n`` values with the sum ``s`` each."""
    per = df.withColumn("x", value.cast("double")).where("x IS NOT NULL").groupBy(group, row).agg(F.round(F.sum("x"), 9).alias("s"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(group, "s", "n").agg(F.count(F.lit(1)).alias("c"))


def _replicates(cells: DataFrame, group: str, replicates: int, seed: int, start: Callable) -> DataFrame:
    """(group, r, s, n): per replicate the sums of ``s`` and ``n`` over all cells of a group, each times its drawn weight.

    ``start(group, size)`` begins a batch of ``size`` replicates and gives ``draw(generator, count)``: the weights of a cell
    of ``count`` keys in them. A generator is Philox keyed by seed, group, cell and batch, and a batch takes its cells in
    order, so results do not depend on partitioning. A task holds the sums of one batch of one group, no rows.
    """
    size = -(-replicates // BATCHES)
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as few bytes are much work here
    batches = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // size))).alias("b")
    rows = cells.select(group, "s", "n", "c", batches).repartition(parts, group, "b").sortWithinPartitions(group, "b", "s", "n")
    schema = T.StructType([rows.schema[group], T.StructField("r", T.LongType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.DoubleType())])
    names = schema.names

    def scan(stream):
        key, kind, draw, s_sum, n_sum = None, None, None, None, None

        def sums():
            r = key[1] * size + 1 + np.arange(len(s_sum), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(r), kind), pa.array(r), pa.array(s_sum), pa.array(n_sum)], names=names)

        for batch in stream:
            kind = batch.schema.field(0).type
            for g, s, n, c, b in zip(*(column.to_pylist() for column in batch.columns)):
                if key != (g, b):
                    if key is not None:
                        yield sums()
                    many = min(size, replicates - b * size)
                    key, draw, s_sum, n_sum = (g, b), start(g, many), np.zeros(many), np.zeros(many)
                digest = hashlib.blake2b(repr((seed, g, s, n, b)).encode(), digest_size=16).digest()
                w = draw(np.random.Generator(np.random.Philox(key=int.from_bytes(digest, "little"))), c)
                s_sum += s * w
                n_sum += n * w
        if key is not None:
            yield sums()

    return rows.mapInArrow(scan, schema)


def sign_flip(df: DataFrame, group: str, row: str, delta: str, replicates: int, seed: int = 1234) -> DataFrame:
    """(group, n, observed, p_one, p_two): sign-flip permutation of summed paired differences, add-one p values.

    Of ``c`` differences of equal size a binomial number keeps its sign. Without differences the p values are null.
    """
    obs = df.groupBy(group).agg(F.count(delta).alias("n"), F.sum(delta).alias("observed"))
    cells = _cells(df, group, row, F.col(delta)).groupBy(group, F.abs("s").alias("s"), F.lit(0).alias("n")).agg(F.sum("c").alias("c"))
    sums = _replicates(cells, group, replicates, seed, lambda g, size: lambda rng, c: 2 * rng.binomial(c, 0.5, size) - c).join(obs, group)
    hits = sums.groupBy(group).agg(F.count_if(F.col("s") >= F.col("observed") - 1e-9).alias("h1"), F.count_if(F.abs("s") >= F.abs("observed") - 1e-9).alias("h2"))
    p = [F.round((F.col(h) + 1) / (replicates + 1), 6).alias(out) for h, out in (("h1", "p_one"), ("h2", "p_two"))]
    return obs.join(hits, group, "left").select(group, "n", F.round("observed", 6).alias("observed"), *p)


def bootstrap_mean(df: DataFrame, group: str, row: str, value: str, replicates: int, seed: int = 1234, share: float = 0.95, least: int = 8) -> DataFrame:
    """(group, n, mean, low, high): percentile interval of the mean by Poisson resampling; null below ``least`` rows.

    Rows of one key ``row`` are drawn together, so a key of several rows makes it a cluster bootstrap.
    """
    sums = _replicates(_cells(df, group, row, F.col(value)), group, replicates, seed, lambda g, size: lambda rng, c: rng.poisson(c, size))
    means = sums.select(group, (F.col("s") / F.nullif(F.col("n"), F.lit(0.0))).alias("m"))
    ranked = means.where("m IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy("m")) - 1).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy(group)))
    tail = (1 - share) / 2
    ends = ranked.groupBy(group).agg(*[F.max(F.when(F.col("k") == F.floor(F.col("c") * at + 1e-9), F.col("m"))).alias(end) for end, at in (("low", tail), ("high", 1 - tail))])
    obs = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    enough = F.col("n") >= least
    return obs.join(ends, group, "left").select(group, "n", F.round("mean", 6).alias("mean"), F.round(F.when(enough, F.col("low")), 6).alias("low"), F.round(F.when(enough, F.col("high")), 6).alias("high"))


def permutation_test(df: DataFrame, in_first: str, value: str, replicates: int, seed: int = 1234) -> DataFrame:
    """(n_a, n_b, observed, p): two-sample permutation of the mean difference, group sizes kept; p is null if a group is empty.

    Equal values are dealt together, a hypergeometric number of them to the first group. Fewer than 10^9 rows.
    """
    live = df.where(F.col(in_first).isNotNull() & F.col(value).isNotNull())
    a, x = F.col(in_first), F.col(value).cast("double")
    sizes = live.agg(F.count_if(a).alias("n_a"), F.count_if(~a).alias("n_b"), F.sum(x).alias("total"), (F.avg(F.when(a, x)) - F.avg(F.when(~a, x))).alias("observed"))
    counts = live.groupBy(x.alias("s"), F.lit(1).alias("n")).agg(F.count(F.lit(1)).alias("c"))
    cells = counts.crossJoin(F.broadcast(sizes)).withColumn("g", F.struct("n_a", "n_b"))  # one row

    def deal(g, size):
        need, left = np.full(size, g["n_a"], np.int64), [g["n_a"] + g["n_b"]]

        def draw(rng, c):
            nonlocal need
            got = rng.hypergeometric(c, left[0] - c, need)
            need, left[0] = need - got, left[0] - c
            return got

        return draw

    sums = _replicates(cells, "g", replicates, seed, deal).crossJoin(F.broadcast(sizes))  # one row
    d = F.col("s") / F.col("n_a") - (F.col("total") - F.col("s")) / F.nullif(F.col("n_b"), F.lit(0))
    hits = sums.agg(F.count_if(F.abs(d) >= F.abs("observed") - 1e-12).alias("h"))
    p = F.when(F.col("observed").isNotNull(), F.round((F.col("h") + 1) / (replicates + 1), 6))
    return sizes.crossJoin(F.broadcast(hits)).select("n_a", "n_b", F.round("observed", 6).alias("observed"), p.alias("p"))  # one row each
