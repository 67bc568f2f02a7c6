"""Nested evaluation packets: explode members, join their parts, nest them back in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOCAL_DIMENSIONS, ARC_DIMENSIONS = 8, 2


def packet_mode(scope: Column, role: Column) -> Column:
    return (
        F.when(scope == "broad_kc_set", "broad_kc_set").when(scope == "branch_context", "branch_context").when(scope.isin("missing_kc", "non_kc"), "mixed_or_low_confidence")
        .when(role == "primary", "single_kc").otherwise("mixed_or_low_confidence")
    )


def build_packets(segments: DataFrame, exchanges: DataFrame, library: DataFrame) -> DataFrame:
    """One nested row per segment: member exchanges in order (missing ones keep their id), primary unit, text and hash.

    ``segments``: (segment_id, dialogue, dominant, members of exchange indexes); ``exchanges``: (exchange_id,
    student_text, tutor_text); ``library``: (unit_id, canonical_name).
    """
    ids = F.transform("members", lambda i: F.concat("dialogue", F.lit("::ex_"), F.format_string("%04d", i.cast("bigint"))))
    rows = segments.select("segment_id", "dialogue", "dominant", F.posexplode(ids).alias("pos", "exchange_id"))
    full = rows.join(exchanges.select("exchange_id", "student_text", "tutor_text"), "exchange_id", "left")
    item = F.struct("pos", "exchange_id", "student_text", "tutor_text")
    packed = full.groupBy("segment_id", "dialogue", "dominant").agg(F.array_sort(F.collect_list(item)).alias("member_exchanges"))
    text = F.array_join(F.transform("member_exchanges", lambda x: F.concat_ws("\n", F.concat(F.lit("Student: "), x.student_text), F.concat(F.lit("Tutor: "), x.tutor_text))), "\n")
    packed = packed.withColumn("segment_text", text).join(library.select(F.col("unit_id").alias("dominant"), F.col("canonical_name").alias("dominant_name")), "dominant", "left")
    return packed.withColumn("content_hash", F.sha2(F.to_json(F.struct("segment_id", "dominant", "segment_text")), 256))


def audit_packets(packets: DataFrame, segments: DataFrame) -> DataFrame:
    """(packets, segments, missing, empty, without_text, wrong_order): coverage and emptiness of a packet build."""
    gone = segments.select("segment_id").join(packets.select("segment_id"), "segment_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    s = segments.agg(F.count(F.lit(1)).alias("segments"))
    ids = F.transform("member_exchanges", lambda x: x.exchange_id)
    p = packets.agg(
        F.count(F.lit(1)).alias("packets"), F.count_if(F.size("member_exchanges") == 0).alias("empty"), F.count_if(F.col("segment_text") == "").alias("without_text"),
        F.count_if(F.array_sort(ids) != ids).alias("wrong_order"),
    )
    return p.crossJoin(F.broadcast(s)).crossJoin(F.broadcast(gone))  # one row each


def macro_packets(exchanges: DataFrame, excluded: DataFrame) -> DataFrame:
    """(d, n_exchanges, dialogue_text): all exchanges of a dialogue in order but the excluded ones."""
    kept = exchanges.join(excluded.select("exchange_id"), "exchange_id", "left_anti")
    item = F.struct("exchange_index", "student_text", "tutor_text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(F.lit("Student: "), x.student_text, F.lit("\nTutor: "), x.tutor_text)), "\n")
    return kept.groupBy("d").agg(F.count(F.lit(1)).alias("n_exchanges"), text.alias("dialogue_text"))


def prompt_rows(packets: DataFrame, instruction: str, library: DataFrame, condition: str = "B") -> DataFrame:
    """(segment_id, prompt, prompt_hash, leaks_unit): condition A shows no unit, B its name, C name and definition."""
    lib = library.select(F.col("unit_id").alias("dominant"), F.col("definition_or_summary").alias("definition"))
    rows = packets.join(lib, "dominant", "left")
    shown = {"A": F.lit(None).cast("string"), "B": F.col("dominant_name"), "C": F.concat_ws(": ", "dominant_name", "definition")}[condition]
    prompt = F.concat_ws("\n\n", F.lit(instruction), F.col("segment_text"), shown)
    out = rows.select("segment_id", "dominant", prompt.alias("prompt"))
    return out.select("segment_id", "prompt", F.sha2("prompt", 256).alias("prompt_hash"), F.coalesce(F.contains("prompt", F.col("dominant")), F.lit(False)).alias("leaks_unit"))


def criteria_for_packets(packets: DataFrame, criteria: DataFrame, units: str = "units", primary: str | None = None) -> DataFrame:
    """(segment_id, unit_no, criterion_no, criterion_id): criteria of a packet's primary unit and of all its other units."""
    every = F.coalesce(units, F.array().cast("array<string>"))
    if primary:
        every = F.concat(F.array(primary), every)
    rows = packets.select("segment_id", F.posexplode(F.array_distinct(F.array_compact(every))).alias("u", "kc_id"))
    return rows.join(criteria, "kc_id").select("segment_id", F.col("u").alias("unit_no"), "criterion_no", "criterion_id")


def references_for_packets(packets: DataFrame, references: DataFrame, units: str = "units", primary: str | None = None, cap: int = 3) -> DataFrame:
    """(segment_id, reference_no, kc_id, reference): the first ``cap`` of a packet's units that have a reference.

    ``references``: (kc_id, reference), one row a unit; null and blank ones are none.
    """
    every = F.coalesce(units, F.array().cast("array<string>"))
    if primary:
        every = F.concat(F.array(primary), every)
    rows = packets.select("segment_id", F.posexplode(F.array_distinct(F.array_compact(every))).alias("u", "kc_id"))
    live = rows.join(references.where(F.trim("reference") != ""), "kc_id")
    no = F.row_number().over(Window.partitionBy("segment_id").orderBy("u"))
    return live.select("segment_id", no.alias("reference_no"), "kc_id", "reference").where(F.col("reference_no") <= cap)
