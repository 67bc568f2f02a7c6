"""File sources and sinks of dialogue evaluation data: JSON lines, JSON documents, CSV and reports."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIALOGUE = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("dialogue_id", "id", "conversation_id")],
    *[
        T.StructField(n, T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("role", "speaker", "from", "author", "content", "text", "message", "utterance", "turn_id")])))
        for n in ("turns", "messages", "dialogue", "conversation")
    ],
])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True, missing_ok: bool = False) -> DataFrame:
    """Objects of a JSON-lines file, blank lines skipped.

    Strict reading fails on a line that is no object; lenient reading keeps such lines in ``_corrupt_record``. With
    ``missing_ok`` a path that does not exist gives an empty frame.
    """
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], wanted)
    if strict:
        return spark.read.schema(wanted).option("mode", "FAILFAST").json(path)
    return spark.read.schema(T.StructType([*wanted.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").option("encoding", "UTF-8").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def checked_library(library: DataFrame) -> DataFrame:
    """The library with its constraints enforced in the plan: unit_id present and unique, unit_type 'kc'."""
    bad = F.col("unit_id").isNull() | (F.coalesce("unit_type", F.lit("")) != "kc")
    rows = library.withColumn("unit_id", F.when(bad, F.raise_error(F.lit("library row without unit_id or of another type"))).otherwise(F.col("unit_id")))
    counts = rows.groupBy("unit_id").agg(F.count(F.lit(1)).alias("_n"))
    ok = counts.withColumn("unit_id", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated unit_id "), "unit_id"))).otherwise(F.col("unit_id"))).select("unit_id")
    return rows.join(ok, "unit_id")


def _first(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def dialogue_turns(dialogues: DataFrame) -> DataFrame:
    """(dialogue_id, turn_index, role, text) of dialogue objects under any of the accepted field names."""
    turns = F.coalesce("turns", "messages", "dialogue", "conversation")
    rows = dialogues.select(F.coalesce(_first(F.col("dialogue_id"), F.col("id"), F.col("conversation_id")), F.lit("dlg_000")).alias("dialogue_id"), F.posexplode(turns).alias("turn_index", "t"))
    return rows.select("dialogue_id", "turn_index", F.coalesce(_first(F.col("t.role"), F.col("t.speaker"), F.col("t.from"), F.col("t.author")), F.lit("unknown")).alias("role"), F.coalesce(_first(F.col("t.content"), F.col("t.text"), F.col("t.message"), F.col("t.utterance")), F.lit("")).alias("text"))


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    return dialogue_turns(read_jsonl(spark, path, DIALOGUE))


def read_pair_list(spark: SparkSession, path: str, conversation_id: str) -> DataFrame:
    """Turns of a document that is one list of ``{student, tutor}`` pairs: two turns a pair."""
    pair = "student struct<text string>, tutor struct<text string>"
    rows = spark.read.schema("value string").option("wholetext", True).text(path).select(F.from_json("value", f"array<struct<{pair.replace(' struct', ':struct').replace('text string', 'text:string')}>>").alias("p"))
    sides = rows.select(F.posexplode("p").alias("i", "x"))
    both = F.array(F.struct(F.lit("student").alias("role"), F.col("x.student.text").alias("text")), F.struct(F.lit("tutor").alias("role"), F.col("x.tutor.text").alias("text")))
    return sides.select(F.lit(conversation_id).alias("dialogue_id"), "i", F.posexplode(both).alias("k", "s")).select("dialogue_id", (F.col("i") * 2 + F.col("k")).alias("turn_index"), "s.role", "s.text")


def read_gold(spark: SparkSession, path: str, corpus: str) -> DataFrame:
    """(corpus, idx, primary, secondary, type) of a gold map with ``ex_0001`` keys."""
    row = "struct<primary:string,secondary:array<string>,type:string>"
    m = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", f"map<string,{row}>")).alias("k", "v"))
    return m.select(F.lit(corpus).alias("corpus"), F.regexp_extract("k", "([0-9]+)$", 1).cast("int").alias("idx"), "v.*")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys and non-ASCII text kept."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def sniff(path: str, head: str) -> str:
    """json, jsonl or text, by the file's suffix and then by its first character."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix in (".jsonl", ".ndjson"):
        return "jsonl"
    first = head.lstrip()[:1]
    if suffix == ".json" or first == "[":
        return "json"
    return "jsonl" if first == "{" and "\n{" in head else "json" if first == "{" else "text"


def discover(folder: str, hints: list[str]) -> str | None:
    """The first JSON-lines file of a run folder whose name holds a hint, in the order of the hints, then by name."""
    names = sorted(p for p in Path(folder).rglob("*.jsonl"))
    return next((str(p) for h in hints for p in names if h in p.name), None)


def library_path(spark: SparkSession, override: str | None = None) -> str:
    """The library's path: the argument, else ``spark.tutorgrain.library``, else TUTORGRAIN_LIBRARY."""
    found = override or spark.conf.get("spark.tutorgrain.library", None) or os.environ.get("TUTORGRAIN_LIBRARY")
    if not found:
        raise ValueError("no library path is configured")
    return found


def worksheet_rows(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Worksheet columns under the names the validation operators use; blank cells become null."""
    return df.select(*[F.nullif(F.trim(F.col(f"`{old}`").cast("string")), F.lit("")).alias(new) for old, new in names.items()])


def markdown_report(title: str, summary: DataFrame, limit: int = 1000) -> str:
    """A small summary frame as a markdown table; larger ones are an error, not cut."""
    rows = summary.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report holds at most {limit} rows")
    lines = [f"# {title}", "", "| " + " | ".join(summary.columns) + " |", "|" + "---|" * len(summary.columns)]
    return "\n".join(lines + ["| " + " | ".join(json.dumps(v, ensure_ascii=False, default=str) if not isinstance(v, str) else v for v in r) + " |" for r in rows]) + "\n"


def run_manifest(inputs: dict[str, DataFrame], **metadata: object) -> str:
    """Counts and order-free content hashes of the inputs of a run, as JSON with sorted keys."""
    out = {}
    for name, df in inputs.items():
        h = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])))
        n, s = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)"))).first()
        out[name] = {"rows": n, "hash": str(s or 0)}
    return json.dumps({"inputs": out, **metadata}, sort_keys=True, ensure_ascii=False, default=str)
