"""Free-text transcripts: one text becomes many turns, marked by colons, brackets or braces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorgrain.functions.text import STUDENT_LABELS, TUTOR_LABELS

# fixed values: confidence of each kind of marker
CONFIDENCE = {("colon", True): 0.98, ("colon", False): 0.88, ("bracket", True): 0.98, ("bracket", False): 0.88, ("brace", True): 0.95, ("brace", False): 0.85}
UNLABELLED, CONTINUED, UNCLOSED, LOW = 0.35, 0.40, 0.30, 0.75
TURN = "turn_index int, speaker string, text string, line_from int, line_to int, confidence double, marker string"
_COLON = re.compile(r"^\s*([A-Za-z]+)\s*:\s*(.*)$")
_BRACKET = re.compile(r"^\s*\[\s*([A-Za-z]+)\s*\]\s*:?\s*(.*)$")
_BRACE = re.compile(r"^\s*([A-Za-z]+)\s*\{\s*(.*)$")


def _speaker(label: str) -> str | None:
    name = label.strip().lower()
    return "student" if name in STUDENT_LABELS else "tutor" if name in TUTOR_LABELS else None


def parse_transcript(text: str | None) -> list[tuple]:
    """Turns of a transcript in order. Lines without a marker continue the turn before; brace turns end at their brace."""
    out: list[list] = []
    inside = False
    for number, line in enumerate((text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")):
        hit = None
        if not inside:
            for kind, pattern in (("bracket", _BRACKET), ("brace", _BRACE), ("colon", _COLON)):
                m = pattern.match(line)
                if m and (who := _speaker(m.group(1))):
                    hit = (kind, who, m.group(2), len(m.group(1)) > 1)
                    break
        if hit:
            kind, who, body, long = hit
            closed = kind == "brace" and body.rstrip().endswith("}")
            inside = kind == "brace" and not closed
            out.append([who, [body.rstrip()[:-1] if closed else body], number, number, CONFIDENCE[kind, long], kind])
            continue
        if inside:
            closed = line.rstrip().endswith("}")
            out[-1][1].append(line.rstrip()[:-1] if closed else line)
            out[-1][3], inside = number, not closed
            continue
        if not line.strip():
            continue
        if out:
            out[-1][1].append(line)
            out[-1][3] = number
            if out[-1][0] == "unknown":
                out[-1][4] = min(out[-1][4], CONTINUED)
        else:
            out.append(["unknown", [line], number, number, UNLABELLED, "none"])
    if inside:
        out[-1][4] = min(out[-1][4], UNCLOSED)
    return [(k, who, "\n".join(x.strip() for x in body).strip(), a, b, c, marker) for k, (who, body, a, b, c, marker) in enumerate(out)]


def transcript_turns(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, turn_index, speaker, text, line_from, line_to, confidence, marker) of whole transcripts, one per row."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *t) for k, x in zip(b.iloc[:, 0], b.iloc[:, 1]) for t in parse_transcript(x)]
            yield pd.DataFrame(rows, columns=["key", *[x.split()[0] for x in TURN.split(", ")]])

    out = df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("t")).mapInPandas(parse, f"key string, {TURN}")
    return out.withColumnRenamed("key", key)


def labelled_region(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, turn_index, speaker, text): only student and tutor turns; headers, footers and prose between fall away."""
    turns = transcript_turns(df, key, text).where("speaker <> 'unknown'")
    body = F.regexp_replace("text", r"(?s)\n\s*(?:[-=*_]{3,}|---|page \d+|end of (?:dialogue|conversation|transcript)).*$", "")
    return turns.select(key, "turn_index", "speaker", body.alias("text"))


def low_confidence(confidence: Column) -> Column:
    return confidence < LOW
