"""Texts cut off by field limits or in transfer, and how often each source cuts.

One Arrow pass runs a stack automaton over every whole text: strings, escapes, brackets and braces push and pop, so a
text that ends with something open was cut, while trailing commas, single-quoted dialects, unescaped inner quotes or
words around the JSON leave the stack empty. The pass also keeps what the automaton cannot judge: broken multibyte
tails, the length of the watched field and of the text, and the words after the last sentence terminator. Baselines per
source then decide about missing terminators: whether a source ends its texts with terminators at all, whether its
lengths pile up at their maximum (a field limit), and which short unterminated answers are complete idioms.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tutorgrain.storage import materialize

SCAN = (
    "kind string, open boolean, broken boolean, n_chars int, field_chars int, terminated boolean, tail string, "
    "tail_words int, closers int"
)
_MARK = re.compile(r"[\"'{}\[\]]")
_IN = {q: re.compile(r"(?:[^%s\\]|\\.)*(%s)?" % (q, q), re.S) for q in "\"'"}
_BROKEN = re.compile("(?:�|\\\\u[0-9a-fA-F]{0,3}|(?<!\\\\)\\\\)$")
_TERMINATED = re.compile(r"""(?:[.!?…。]["'”’)\]*_`]*|["”’]|:\)|```|---?|[)\]}>])$""")
_CLOSER = re.compile(r"[.!?…。](?=\s|$)")
_BARE_CLOSE = re.compile(r"[)\]}>]$")
_FULL_BRACKET = re.compile(r"[.!?]\s*\([^()]*[.!?]\)$")
_PAIR_LINE = re.compile(r"\n\W*[^\W\d][\w ]{0,40}?\s*[:=]\s*(?:[-+]?\d+(?:\.\d+)?%?|yes|no|true|false|none|null)$", re.I)
_SIGNED = re.compile(r"[.!?)\"]\s*\n[^\W\d][^\n]{2,60}\s\d+(?:\.\d+)?$")
#: Short answers that are complete without a terminator; more are learned from the closed fields of the table itself.
TERSE = ("ok", "okay", "none", "n/a", "na", "yes", "no", "see notes", "see note", "no issue found", "no issues found", "as exchange #", "as above", "fine", "pass", "fail", "done", "unchanged")


def automaton(text: str, start: int, fields: tuple[str, ...]) -> tuple[bool, str | None, int]:
    """(something is open at the end, content of the last watched field, where the last closed value ended)."""
    stack: list[str] = []
    at, size, value, closed = start, len(text), None, start
    quotes, key, last = "", None, None
    while True:
        m = _MARK.search(text, at)
        if m is None:
            return bool(stack), value, closed
        c, at = m.group(), m.end()
        if c in "\"'":
            if not stack or (quotes and c not in quotes):
                continue
            if not quotes:  # the first quote tells the dialect; JSON has no single quotes, the other has both
                quotes = '"' if c == '"' else "\"'"
            end = _IN[c].match(text, at)
            if end.group(1) is None:
                return True, value, closed
            content = text[at : end.end() - 1]
            colon = text[last : m.start()].strip() == ":" if last is not None else False
            if colon and key in fields:
                value = content
            key, last, at = content, end.end(), end.end()
        elif c in "{[":
            if stack or c == "{":
                stack.append(c)
        elif stack and stack[-1] == ("{" if c == "}" else "["):
            stack.pop()
            if not stack:
                closed, quotes, key, last = at, "", None, None
        if at >= size:
            return bool(stack), value, closed


def _decoded(raw: str) -> str:
    if "\\" not in raw:
        return raw
    try:
        return json.loads(f'"{raw}"', strict=False)
    except ValueError:
        return raw.replace('\\"', '"').replace("\\'", "'").replace("\\n", "\n")


def _ending(text: str) -> tuple[bool, str, int]:
    """(ends as a finished text, else the words after the last terminator, and their number)."""
    s = text.rstrip()
    if _PAIR_LINE.search("\n" + s[-160:]) or _SIGNED.search(s[-160:]):
        return True, "", 0
    if _TERMINATED.search(s) and not (_BARE_CLOSE.search(s) and not s.endswith(":)") and not _FULL_BRACKET.search(s)):
        return True, "", 0
    cut = 0
    for m in _CLOSER.finditer(s):
        cut = m.end()
    tail = re.sub(r"\d+", "#", s[cut:].strip().lower())
    return False, tail[:200], len(tail.split())


def scan_text(text: str | None, fields: tuple[str, ...]) -> tuple:
    if text is None or not text.strip("﻿​\xa0 \t\r\n"):
        return ("blank", False, False, 0, None, True, "", 0, 0)
    start = text.find("{")
    broken = bool(_BROKEN.search(text.rstrip()[-8:]))
    if start < 0:
        terminated, tail, words = _ending(text)
        return ("prose", False, broken, len(text), None, terminated, tail, words, len(_CLOSER.findall(text)))
    is_open, value, _ = automaton(text, start, fields)
    if value is None:
        return ("json", is_open, broken and is_open, len(text), None, True, "", 0, 0)
    value = _decoded(value)
    terminated, tail, words = _ending(value) if value.strip() else (True, "", 0)
    closers = len(_CLOSER.findall(value))
    return ("json", is_open, broken and is_open, len(text), len(value), terminated, tail, words, closers)


def detect_truncated(
    df: DataFrame, row_id: str, text: str, source: str, fields: tuple[str, ...] = ("rationale_short",),
    long_words: int = 8, min_pile: int = 3,
) -> DataFrame:
    """(row_id, source, is_cut, reason) for every row.

    A text is cut if its JSON ends with something open, if it ends in a broken character or escape, if it fills its
    source's length limit, or if its final words lack a terminator where the source's texts have one and they are no
    complete idiom. Null, empty and blank texts are never cut; a null source is a source of its own. Every row counts by
    itself, repeated rows too. An empty table gives no rows; other columns are ignored whatever their names.
    """

    @F.pandas_udf(SCAN)
    def scan(texts: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in SCAN.split(", ")]
        return pd.DataFrame([scan_text(t, fields) for t in texts], columns=names)

    rows = df.select(F.col(row_id).alias("id"), F.col(source).cast("string").alias("src"), scan(F.col(text)).alias("x"))
    rows = materialize(rows.select("id", "src", "x.*"), "truncation-scan")
    rows = rows.withColumn("size", F.when(F.col("kind") == "json", F.col("field_chars")).otherwise(F.col("n_chars")))

    # per source, kind and length: at most as many rows as lengths occur, combined before the shuffle
    whole = rows.where("kind <> 'blank' AND NOT open AND size > 0")
    lengths = whole.groupBy("src", "kind", "size").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("terminated")).alias("ragged"),
        F.count_if(~F.col("terminated") & (F.col("tail_words") >= long_words)).alias("ragged_long"),
        F.count_distinct(F.when(~F.col("terminated") & ((F.col("closers") >= 1) | (F.col("tail_words") >= long_words)), F.col("tail"))).alias("ragged_tails"),
        F.count_if((F.col("closers") >= 1) | (F.col("tail_words") >= long_words)).alias("longs"),
        F.sum("closers").alias("closers"),
    )
    top = lengths.groupBy("src", "kind").agg(
        F.sum("n").alias("rows_"), F.sum("ragged_long").alias("ragged_long"), F.sum("longs").alias("longs"),
        F.max(F.struct("size", "n", "ragged")).alias("m"),
        F.count(F.lit(1)).alias("distinct_sizes"),
        (F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("closers"), F.lit(1))).alias("chars_per_closer"),
    )
    base = top.select(
        F.col("src").alias("b_src"), F.col("kind").alias("b_kind"),
        F.when((F.col("m.n") >= min_pile) & (F.col("m.ragged") >= min_pile) & (F.col("m.n") >= 5 * F.col("rows_") / F.col("distinct_sizes")), F.col("m.size")).alias("limit"),
        # of rows that fill the limit with a terminator: more are expected from cutting than from chance?
        (F.col("m.ragged") / F.col("chars_per_closer") > (F.col("rows_") - F.col("m.n")) / F.col("m.size")).alias("likely"),
        # a source proves that it does without terminators by twenty long texts, most of them without
        ((F.col("longs") < 20) | (F.col("ragged_long") - F.when(F.col("m.n") >= min_pile, F.col("m.ragged")).otherwise(0) < 0.5 * F.col("longs"))).alias("closes"),
    )
    piles = _piles(lengths, top, min_pile)
    idioms = _idioms(rows, long_words)
    # most rows end with a terminator; they share the empty tail and must not meet in a join
    ragged, ended = rows.where("tail <> ''"), rows.where("tail = ''").withColumn("idiom", F.lit(False))
    rows = ragged.join(idioms, "tail", "left").unionByName(ended)
    joined = rows.join(base, F.col("src").eqNullSafe(F.col("b_src")) & (F.col("kind") == F.col("b_kind")), "left")
    joined = joined.join(piles, F.col("src").eqNullSafe(F.col("p_src")) & (F.col("kind") == F.col("p_kind")) & (F.col("size") == F.col("p_size")), "left")
    at_limit = F.coalesce((F.col("size") == F.col("limit")) | F.col("p_size").isNotNull(), F.lit(False))
    likely = F.coalesce("p_likely", "likely")
    terse = F.coalesce(F.col("idiom"), F.lit(False))
    reason = (
        F.when(F.col("kind") == "blank", None)
        .when(F.col("broken"), "broken_character")
        .when(F.col("open"), "open_structure")
        .when(at_limit & ~F.col("terminated"), "field_limit")
        .when(at_limit & likely, "field_limit")
        .when(F.col("terminated") | terse, None)
        .when((F.col("kind") == "prose") & F.coalesce("closes", F.lit(True)), "missing_terminator")
        .when((F.col("tail_words") >= long_words) & F.coalesce("closes", F.lit(True)), "missing_terminator")
    )
    out = joined.withColumn("reason", reason)
    return out.select(
        F.col("id").alias(row_id), F.col("src").alias(source), F.col("reason").isNotNull().alias("is_cut"), "reason"
    )


def _piles(lengths: DataFrame, top: DataFrame, min_pile: int, near: int = 8) -> DataFrame:
    """(p_src, p_kind, p_size, p_likely): lengths below the longest at which a source's texts pile up unterminated.

    They are limits that single values exceed, as from before a limit was lowered. A pile has ``min_pile`` different
    unterminated ends, other than short answers, and five times the rows and such ends of the lengths around it.
    """
    around = Window.partitionBy("src", "kind").orderBy("size").rangeBetween(-near, near)
    mean = lambda c: (F.sum(c).over(around) - F.col(c)) / (2 * near)
    at = lengths.withColumns({"n_near": mean("n"), "tails_near": mean("ragged_tails")})
    at = at.where((F.col("ragged_tails") >= min_pile) & (F.col("n") >= 5 * F.col("n_near")) & (F.col("ragged_tails") >= 5 * F.col("tails_near")))
    t = top.select(F.col("src").alias("t_src"), F.col("kind").alias("t_kind"), "rows_", "distinct_sizes", "chars_per_closer", "m")
    j = at.join(t, F.col("src").eqNullSafe(F.col("t_src")) & (F.col("kind") == F.col("t_kind")))
    j = j.where((F.col("size") < F.col("m.size")) & (F.col("n") >= 5 * F.col("rows_") / F.col("distinct_sizes")))
    likely = F.col("ragged") / F.col("chars_per_closer") > (F.col("rows_") - F.col("n")) / F.col("size")
    return j.select(F.col("src").alias("p_src"), F.col("kind").alias("p_kind"), F.col("size").alias("p_size"), likely.alias("p_likely"))


def _idioms(rows: DataFrame, long_words: int) -> DataFrame:
    """(tail, idiom): the fixed short answers, and those that recur as whole closed fields of at most four words.

    A learned one needs three rows and a ten-thousandth of all, so there are at most ten thousand.
    """
    spark = rows.sparkSession
    fixed = spark.createDataFrame([(t,) for t in TERSE], "tail string")
    field = rows.where("kind = 'json' AND NOT open AND NOT terminated AND tail_words BETWEEN 1 AND 4 AND closers = 0")
    total = rows.agg((F.count(F.lit(1)) / 10000).alias("least"))
    seen = field.groupBy("tail").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).where("n >= 3 AND n >= least")
    return fixed.unionByName(seen.select("tail")).distinct().withColumn("idiom", F.lit(True))


def truncation_rates(cuts: DataFrame, source: str) -> DataFrame:
    """(source, n_rows, n_cut, share_cut) from detect_truncated()'s rows."""
    return cuts.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("is_cut").alias("n_cut"),
        F.round(F.count_if("is_cut") / F.count(F.lit(1)), 6).alias("share_cut"),
    )
