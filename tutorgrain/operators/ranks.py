"""Ranks within groups of any size: a group that holds most rows is ranked by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tutorgrain.storage import materialize


def distributed_rank(df: DataFrame, group: list[str], order: list, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: the row number from 1 within ``group`` by ``order``, which must settle every tie.

    Rows are range-partitioned by group and order and written, ranked inside each range, and shifted by the counts of
    the ranges before it; only those counts, one row per group and range, meet in one window.
    """
    columns = df.columns
    at = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = materialize(df.repartitionByRange(*group, *at).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    shift = counts.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = ranged.withColumn("_k", F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*at)))
    same = (F.col("a._range") == F.col("b._range")) & F.lit(True)
    for g in group:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    joined = inside.alias("a").join(shift.alias("b"), same)
    return joined.select(*[F.col(f"a.{c}") for c in columns], (F.col("a._k") + F.col("b._shift")).alias(name))
