"""Turns and exchanges: ordered grouping of dialogue turns without per-dialogue Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorgrain.functions import text as T


def dialogue_turns(rows: DataFrame, spoken_by: str | None = None) -> DataFrame:
    """(d, n, speaker, body, flags) of message rows, one row per dialogue and turn number: that of the lowest row id.

    A null dialogue id is read from ``turn_id``; rows without a turn number are left out; repeated rows count once.
    With ``spoken_by`` only this speaker's turns have a body, and a dialogue's rows are brought together once, so that
    windows over it need no further shuffle or sort.
    """
    text = F.col("text") if spoken_by is None else F.when(T.canonical_speaker(F.col("role")) == spoken_by, F.col("text"))
    parsed = rows.select(
        F.coalesce("dialogue_id", F.split_part("turn_id", F.lit("::"), F.lit(1))).alias("d"),
        F.expr("try_cast(regexp_extract(turn_id, '([0-9]+)$', 1) AS INT)").alias("n"),
        F.struct("row_id", "role", text.alias("text")).alias("x"),
    ).where("n IS NOT NULL AND d IS NOT NULL")
    if spoken_by is not None:
        parsed = parsed.repartition("d")
    first = parsed.groupBy("d", "n").agg(F.min("x").alias("x"))
    turns = first.select("d", "n", T.canonical_speaker(F.col("x.role")).alias("speaker"), T.normalize_text(F.col("x.text")).alias("body"))
    return turns.withColumn("flags", T.noise_flags(F.col("body")))


def _joined(rows: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.array_sort(rows), lambda x: x.body), lambda b: b != ""), "\n")


def run_exchanges(turns: DataFrame) -> DataFrame:
    """Exchanges by runs: a run of student turns with the run of tutor turns after it; tutor and unknown runs alone.

    One window gives the starts, its running sum the groups. (d, exchange_index, exchange_id, turn_start, turn_end,
    roles_pattern, student_text, tutor_text, status, flags).
    """
    w = Window.partitionBy("d").orderBy("n")
    before, now = F.lag("speaker").over(w), F.col("speaker")
    start = (
        before.isNull()
        | ((now == "student") & (before != "student"))
        | ((now == "tutor") & ~before.isin("student", "tutor"))
        | ((now == "unknown") & (before != "unknown"))
    )
    grouped = turns.withColumn("start", start.cast("int")).withColumn("g", F.sum("start").over(w) - 1)
    item = F.struct("n", "body")
    out = grouped.groupBy("d", "g").agg(
        F.min("n").alias("turn_start"), F.max("n").alias("turn_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "speaker"))), lambda x: F.upper(F.substring(x.speaker, 1, 1))), "").alias("roles_pattern"),
        _joined(F.collect_list(F.when(now == "student", item))).alias("student_text"),
        _joined(F.collect_list(F.when(now == "tutor", item))).alias("tutor_text"),
        F.count_if(now == "student").alias("ns"), F.count_if(now == "tutor").alias("nt"), F.count_if(now == "unknown").alias("nu"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"),
    )
    out = out.withColumns({c: T.normalize_text(F.col(c)) for c in ("student_text", "tutor_text")})
    status = (
        F.when(F.col("nu") > 0, "unknown_speaker_present")
        .when(F.col("ns") == 0, "missing_student")
        .when(F.col("nt") == 0, "missing_tutor")
        .when((F.col("student_text") == "") | (F.col("tutor_text") == ""), "empty_exchange_text")
        .otherwise("ok")
    )
    return out.select(
        "d", F.col("g").cast("int").alias("exchange_index"), exchange_id(F.col("d"), F.col("g")).alias("exchange_id"),
        "turn_start", "turn_end", "roles_pattern", "student_text", "tutor_text", status.alias("status"), "flags",
    )


def exchange_id(d: Column, index: Column) -> Column:
    return F.concat(d, F.lit("::ex_"), F.format_string("%04d", index.cast("bigint")))


def with_context(exchanges: DataFrame) -> DataFrame:
    """The ids of the exchange before and after; null at the ends."""
    w = Window.partitionBy("d").orderBy("exchange_index")
    return exchanges.withColumn("left_context", F.lag("exchange_id").over(w)).withColumn(
        "right_context", F.lead("exchange_id").over(w)
    )


def strict_pairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exchanges, violations): strict student-tutor pairs; a dialogue that breaks the rule is quarantined whole.

    Violations: (d, turns, bad_pairs) of dialogues with an odd number of turns or a pair with other roles.
    """
    w = Window.partitionBy("d").orderBy("n")
    pos = F.row_number().over(w) - 1
    paired = turns.withColumn("pos", pos).groupBy("d", F.floor(F.col("pos") / 2).alias("pair")).agg(
        F.max(F.when(F.col("pos") % 2 == 0, F.struct("speaker", "n", "body"))).alias("a"),
        F.max(F.when(F.col("pos") % 2 == 1, F.struct("speaker", "n", "body"))).alias("b"),
    )
    good = F.coalesce((F.col("a.speaker") == "student") & (F.col("b.speaker") == "tutor"), F.lit(False))
    marked = paired.withColumn("good", good)
    verdict = marked.groupBy("d").agg(
        F.sum(F.when(F.col("b").isNull(), 1).otherwise(2)).alias("turns"), F.count_if(~F.col("good")).alias("bad_pairs")
    )
    violations = verdict.where("bad_pairs > 0")
    pairs = marked.join(violations, "d", "left_anti").select(
        "d", F.col("pair").cast("int").alias("exchange_index"), exchange_id(F.col("d"), F.col("pair")).alias("exchange_id"),
        F.col("a.n").alias("turn_start"), F.col("b.n").alias("turn_end"),
        F.col("a.body").alias("student_text"), F.col("b.body").alias("tutor_text"),
    )
    return pairs, violations


def greedy_exchanges(turns: DataFrame) -> DataFrame:
    """Greedy grouping tutor-student-tutor, then student-tutor, then single turns, as one JVM fold per dialogue.

    (d, exchange_index, turn_start, turn_end, roles_pattern). The fold keeps the open positions of the current group; the
    choice at a turn depends on the roles of the two turns after it, which are attached beforehand by a window.
    """
    w = Window.partitionBy("d").orderBy("n")
    ahead = turns.withColumn("r1", F.lead("speaker", 1).over(w)).withColumn("r2", F.lead("speaker", 2).over(w))
    take = (
        F.when((F.col("speaker") == "tutor") & (F.col("r1") == "student") & (F.col("r2") == "tutor"), 3)
        .when((F.col("speaker") == "student") & (F.col("r1") == "tutor"), 2)
        .otherwise(1)
    )
    rows = ahead.withColumn("take", take).groupBy("d").agg(
        F.array_sort(F.collect_list(F.struct("n", F.upper(F.substring("speaker", 1, 1)).alias("role"), "take"))).alias("x")
    )
    start = F.struct(F.lit(0).alias("left"), F.array().cast("array<int>").alias("sizes"))

    def step(acc: Column, x: Column) -> Column:
        open_ = acc.left > 0
        return F.struct(
            F.when(open_, acc.left - 1).otherwise(x["take"] - 1).alias("left"),
            F.when(open_, acc.sizes).otherwise(F.concat(acc.sizes, F.array(x["take"]))).alias("sizes"),
        )

    sized = rows.withColumn("sizes", F.aggregate("x", start, step).getField("sizes"))
    cut = sized.select("d", "x", "sizes", F.posexplode("sizes").alias("exchange_index", "size"))
    first = F.aggregate(F.slice("sizes", F.lit(1), F.col("exchange_index")), F.lit(0), lambda a, b: a + b)
    members = F.slice("x", first + 1, F.col("size"))
    return cut.withColumn("m", members).select(
        "d", "exchange_index", F.col("m")[0].n.alias("turn_start"), F.element_at("m", -1).n.alias("turn_end"),
        F.array_join(F.transform("m", lambda x: x.role), "").alias("roles_pattern"),
    )


def normalization_audit(turns: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Counts per dialogue and whether it is ready: at least one exchange and none but ``ok`` ones."""
    t = turns.groupBy("d").agg(
        F.count(F.lit(1)).alias("turn_count"), F.count_if(F.col("speaker") == "student").alias("student_turns"),
        F.count_if(F.col("speaker") == "tutor").alias("tutor_turns"), F.count_if(F.col("speaker") == "unknown").alias("unknown_turns"),
    )
    e = exchanges.groupBy("d").agg(
        F.count(F.lit(1)).alias("exchange_count"),
        F.count_if(F.col("status") != "ok").alias("blocked_exchanges"),
    )
    return t.join(e, "d").withColumn("ready", (F.col("exchange_count") > 0) & (F.col("blocked_exchanges") == 0))


def rebuilt_turns(exchanges: DataFrame) -> DataFrame:
    """Two turns per exchange again: (d, turn_index, speaker, body)."""
    sides = F.array(
        F.struct(F.lit("student").alias("speaker"), F.col("student_text").alias("body")),
        F.struct(F.lit("tutor").alias("speaker"), F.col("tutor_text").alias("body")),
    )
    out = exchanges.select("d", "exchange_index", F.posexplode(sides).alias("k", "x"))
    return out.select("d", (F.col("exchange_index") * 2 + F.col("k")).alias("turn_index"), "x.speaker", "x.body")


def focus_pattern(exchanges: DataFrame, unit: str, position: str) -> DataFrame:
    """(unit, target_type, pattern, exchange_id): the focus target of every unit of exchanges.

    Priority self_correction (not in the first exchange), tutor_correction, confirmation, tutor_explanation; within one
    pattern the first exchange. Units without a pattern have a broad target if any tutor text, else no domain claim.
    """
    s, t = T.strip(F.col("student_text")), T.strip(F.col("tutor_text"))
    claim, question = s.rlike(f"(?i){T.CLAIM_MARKER}"), s.rlike(f"(?i){T.PURE_QUESTION}")
    correction = t.rlike(f"(?i){T.CORRECTION}")
    rank = (
        F.when((F.col(position) > 0) & s.rlike(f"(?i){T.SELF_CORRECTION}"), 1)
        .when((t != "") & correction & (F.length(s) >= T.ASSERTION_CHARS) & ~(question & ~claim), 2)
        .when((s != "") & (t != "") & (F.length(t) <= T.CONFIRMATION_CHARS) & ~t.contains("?") & ~correction & t.rlike(f"(?i){T.CONFIRMATION}"), 3)
        .when((t != "") & (s != "") & ~claim & question, 4)
    )
    best = exchanges.withColumn("rank", rank).groupBy(unit).agg(
        F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", position, "exchange_id"))).alias("b"),
        F.bool_or(t != "").alias("spoken"),
    )
    names = F.array(*map(F.lit, ["self_correction", "tutor_correction", "confirmation", "tutor_explanation"]))
    kind = F.when(F.col("b").isNotNull(), "precise_focus_target").when(F.col("spoken"), "broad_tutor_claim_target").otherwise("no_domain_claim")
    return best.select(unit, kind.alias("target_type"), F.get(names, F.col("b.rank") - 1).alias("pattern"), F.col("b.exchange_id").alias("exchange_id"))
