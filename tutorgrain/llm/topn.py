"""Top N items within every group by simultaneous bisection.

Every row gets an order-preserving code (an array of 64-bit digits: score, secondary rank, identifier bytes; arrays
compare digit by digit in Spark, and a larger code ranks earlier). All groups then refine a cutoff at once: a round
cuts each open group's interval of the current digit at the midpoints of ``BITS`` halvings and counts the rows above
each midpoint in one map-side-combined aggregation; the sub-interval that holds the N-th row becomes the next interval.
A group closes when exactly N rows lie at or above its cutoff. No group is ever sorted or gathered in one place: a
round moves counts, at most ``2**BITS`` per group, and only rows inside open intervals are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorgrain.storage import materialize, release

BITS = 6
CHUNK = 7  # identifier bytes in one digit: 56 bits, so digits stay positive


NO_RANK = -(2**62)  # the digit of a missing rank; ranks lie between -2**61 and 2**61


def score_code(score: Column) -> Column:
    """The IEEE bits of a double as a BIGINT that sorts as the double does; -0.0 counts as 0.0."""
    bits = F.call_function(
        "java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), score.cast("double") + F.lit(0.0)
    ).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF)))


def score_digits(score: Column) -> list[Column]:
    """The score's code as two digits of 32 bits, so that differences of digits cannot overflow."""
    code = score_code(score)
    return [F.shiftright(code, 32), code.bitwiseAND(F.lit(0xFFFFFFFF))]


def identifier_digits(name: Column, digits: int) -> list[Column]:
    """Digits that sort a string descending by its UTF-8 bytes, the last one its length."""
    padded = F.rpad(F.hex(F.encode(name, "UTF-8")), digits * CHUNK * 2, "0")
    cut = [F.conv(F.substring(padded, k * CHUNK * 2 + 1, CHUNK * 2), 16, 10).cast("bigint") for k in range(digits)]
    return [-c for c in cut] + [-F.octet_length(name).cast("bigint")]


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, rank: str, n: int = 5) -> DataFrame:
    """The first ``n`` distinct items of every group: score descending, rank ascending with nulls last, item ascending.

    Returns (group, item, score, rank, position), position counting from 1. Rows whose score is null or NaN, or whose
    group or item is null, do not compete. Repeated rows of an item count once, by its first row in that order, so
    ties and rows delivered again have one defined result. A group with fewer than ``n`` items gives all of them; an
    empty table gives no rows. Other columns are ignored whatever their names.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(
        F.col(group).cast("string").alias("g"),
        F.col(item).cast("string").alias("i"),
        F.col(score).cast("double").alias("s"),
        F.col(rank).cast("bigint").alias("r"),
    ).where("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    low = F.lit(NO_RANK).cast("bigint")
    first = rows.groupBy("g", "i").agg(F.max(F.struct(F.col("s"), F.coalesce(-F.col("r"), low).alias("m"))).alias("x"))
    first = materialize(first.select("g", "i", F.col("x.s").alias("s"), F.col("x.m").alias("m")), "topn-items")
    digits = max(1, -(-(first.agg(F.max(F.octet_length("i"))).first()[0] or 1) // CHUNK))
    coded = first.withColumn("code", F.array(*score_digits(F.col("s")), F.col("m"), *identifier_digits(F.col("i"), digits)))

    cuts = _bisect(coded.select("g", "code"), n)
    # the own exchange of the few rows that are left lets AQE split the join's partition of a hot group
    kept = coded.join(cuts, "g").where(F.col("code") >= F.col("cut")).drop("cut").repartition("g")
    order = Window.partitionBy("g").orderBy(F.col("code").desc())  # at most n rows a group are left here
    return kept.select(
        F.col("g").alias(group),
        F.col("i").alias(item),
        F.col("s").alias(score),
        F.when(F.col("m") > low, -F.col("m")).cast("int").alias(rank),
        F.row_number().over(order).alias("position"),
    )


def _bisect(coded: DataFrame, n: int) -> DataFrame:
    """(g, cut): the code at and above which each group has exactly min(n, its size) rows."""
    stats = coded.groupBy("g").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.col("code")[0]).alias("lo"), F.max(F.col("code")[0]).alias("hi")
    )
    none = F.array().cast("array<bigint>")
    state = materialize(
        stats.select(
            "g",
            F.when(F.col("c") <= n, none).alias("cut"),
            none.alias("prefix"),
            F.lit(n).cast("bigint").alias("need"),
            F.lit(0).alias("was"), F.col("lo").alias("was_lo"), F.col("hi").alias("was_hi"),
            F.lit(0).alias("digit"), "lo", "hi",
        ),
        "topn-state",
    )
    cuts, active, base = state.where("cut IS NOT NULL").select("g", "cut"), coded, coded
    done = [cuts]
    while True:
        open_groups = state.where("cut IS NULL").drop("cut")
        if open_groups.isEmpty():
            return _union(done)
        inside = active.join(open_groups, "g").where("code[was] BETWEEN was_lo AND was_hi")
        # shift so that the interval, a power of two wide, falls into at most 2**BITS parts
        width = F.length(F.bin(F.col("hi") - F.col("lo")))
        part = F.expr(f"shiftrightunsigned(code[digit] - lo, CAST(greatest(0, width - {BITS}) AS INT))")
        inside = materialize(inside.withColumn("width", width).withColumn("part", part).drop("width"), "topn-open")
        state_keys = ["g", "prefix", "need", "digit"]
        counts = inside.groupBy(*state_keys, "part").agg(
            F.count(F.lit(1)).alias("c"),
            F.min(F.expr("code[digit]")).alias("lo"), F.max(F.expr("code[digit]")).alias("hi"),
            F.min(F.expr("get(code, digit + 1)")).alias("next_lo"), F.max(F.expr("get(code, digit + 1)")).alias("next_hi"),
        )
        down = Window.partitionBy("g").orderBy(F.col("part").desc())  # at most 2**BITS counts a group
        above = F.coalesce(F.sum("c").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = counts.withColumn("above", above).where("above < need AND above + c >= need")
        tie = F.col("lo") == F.col("hi")
        fits = F.col("above") + F.col("c") == F.col("need")
        after = hit.select(
            "g",
            F.when(fits, F.concat("prefix", F.array("lo"))).alias("cut"),
            F.when(tie, F.concat("prefix", F.array("lo"))).otherwise(F.col("prefix")).alias("prefix"),
            (F.col("need") - F.col("above")).alias("need"),
            F.col("digit").alias("was"), F.col("lo").alias("was_lo"), F.col("hi").alias("was_hi"),
            F.when(tie, F.col("digit") + 1).otherwise(F.col("digit")).alias("digit"),
            F.when(tie, F.col("next_lo")).otherwise(F.col("lo")).alias("lo"),
            F.when(tie, F.col("next_hi")).otherwise(F.col("hi")).alias("hi"),
        )
        state = materialize(after, "topn-state")
        done.append(state.where("cut IS NOT NULL").select("g", "cut"))
        if active is not base:
            release(active)
        active = inside.select("g", "code")
        active._tutorgrain_path = inside._tutorgrain_path


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
