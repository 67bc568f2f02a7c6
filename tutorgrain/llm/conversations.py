"""Conversations rebuilt from message rows.

Rows collapse to one row per turn (min and max tell whether a turn has one speaker and one text; both combine
map-side). Turns form a reply graph: a turn replies to the one that its reply pointer names, or without such a column to
the turn before it. Turns go to blocks of consecutive numbers, and in every block Kahn's algorithm sorts the graph wave
by wave, siblings by timestamp; turns that are left over hang on a message that was lost or on a cycle. A turn whose
parent lies in another block waits for it: where every turn replies to the one before, full blocks one after the other
settle that, and for free reply pointers the waits between blocks are followed by pointer doubling. Each block reports
how it passes on an unanswered student turn, and reports combine 256 at a time, so no conversation is gathered in one
place.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorgrain.operators.ranks import distributed_rank
from tutorgrain.storage import materialize

BLOCK = 256
# fixed values: usual names of the three speakers, in lower case
SPEAKERS = {
    "student": "student learner pupil user human s child kid client questioner asker trainee mentee estudiante alumno alumna schüler schülerin élève étudiant étudiante apprenant",
    "tutor": "tutor teacher assistant ai bot model t instructor coach mentor educator professor agent chatbot gpt lehrer lehrerin professeur profesor profesora enseignant docente",
    "system": "system sys developer platform moderator",
}
_SPACE = r"[\s   -‍    ⁠　﻿]+"


def speaker(role: Column) -> Column:
    """student, tutor or system under any usual name; null if it cannot be told."""
    name = F.regexp_replace(F.lower(role), r"[\s :.\[\](){}<>*_-]+", "")
    said = F.lit(None).cast("string")
    for who, names in SPEAKERS.items():
        said = F.when(name.isin(names.split()), F.lit(who)).otherwise(said)
    return said


def clean_text(text: Column) -> Column:
    """The text with runs of white space as one space and none at its ends; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, _SPACE, " ")), F.lit(""))


def _number(of: str) -> Column:
    return F.expr(f"try_cast(nullif(regexp_extract(`{of}`, '([0-9]+)\\\\s*$', 1), '') AS BIGINT)")


def turns(df: DataFrame, conversation: str, turn_id: str, role: str, text: str, sent_at: str, reply_to: str | None = None) -> DataFrame:
    """(d, n, p, who, body, at, clash): one row per conversation and turn number, ``p`` the number of the turn it replies to.

    n is null where turn_id has no number; p is null for a turn that opens a conversation.
    """
    parent = _number(reply_to) if reply_to else F.when(F.col("n") > 0, F.col("n") - 1)
    points = (F.col(reply_to).isNotNull() & F.col("p").isNull()) if reply_to else F.lit(False)
    rows = df.withColumn("n", _number(turn_id)).withColumn("p", parent).select(
        F.coalesce(F.col(conversation), F.nullif(F.split_part(F.col(turn_id), F.lit("::"), F.lit(1)), F.lit(""))).alias("d"), "n", "p", points.alias("astray"),
        F.coalesce(speaker(F.col(role)), F.lit("?")).alias("who"), clean_text(F.col(text)).alias("body"), F.col(sent_at).alias("at"),
    ).where("d IS NOT NULL")
    two = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    parents = two("p") | ((F.count("p") > 0) & (F.count("p") < F.count(F.lit(1)))) if reply_to else F.lit(False)
    return rows.groupBy("d", "n").agg(
        F.min("p").alias("p"), F.min("who").alias("who"), F.min("body").alias("body"), F.min("at").alias("at"),
        (two("who") | two("body") | (F.max("who") == "?") | (F.min("who") == "?") | parents | F.bool_or("astray")).alias("clash"),
    )


def kahn(numbers, parents, stamps) -> tuple[list[int], dict[int, tuple[int, int]], dict[int, int]]:
    """(turns in topological order, turn to (entry, wave), entry to the parent it waits for elsewhere) of a block.

    ``parents`` holds the number of the turn that a turn replies to, -1 for none. Turns leave in waves, each by timestamp
    and then by number; a turn whose parent belongs to another block is an entry of this block and leaves in its first
    wave. Turns missing from the order are left over: they hang on a lost turn or on a cycle.
    """
    at = {int(n): (s, int(n)) for n, s in zip(numbers, stamps)}
    replies: dict[int, list[int]] = {}
    waits: dict[int, int] = {}
    wave: list[int] = []
    home: dict[int, tuple[int, int]] = {}
    for n, p in zip(numbers, parents):
        n, p = int(n), int(p)
        if p >= 0 and p // BLOCK == n // BLOCK:
            replies.setdefault(p, []).append(n)
            continue
        wave.append(n)
        home[n] = (n if p >= 0 else -1, 0)
        if p >= 0:
            waits[n] = p
    order: list[int] = []
    while wave:
        wave.sort(key=at.__getitem__)
        order += wave
        after = []
        for n in wave:
            for m in replies.get(n, ()):  # a turn has one parent, so its in-degree falls to none here
                home[m] = (home[n][0], home[n][1] + 1)
                after.append(m)
        wave = after
    return order, home, waits


def reply_scan(numbers, kinds) -> tuple[int, int, bool, int]:
    """(first event, its number, a student turn inside went unanswered, number of the last open student turn or -1).

    ``kinds``: 1 a student turn, 2 a tutor turn with text, 0 neither; in the order of the conversation.
    """
    first, at, missing, pending = 0, -1, False, -1
    for n, k in zip(numbers, kinds):
        if k == 0:
            continue
        if first == 0:
            first, at = int(k), int(n)
        if k == 2:
            pending = -1
        else:
            missing = missing or (pending >= 0 and n != pending + 1)
            pending = int(n)
    return first, at, missing, pending


_BLOCKS = "ordered array<long>, left_over int, first int, first_n long, missing boolean, pending long"


def _blocks(numbers: pd.Series, parents: pd.Series, stamps: pd.Series, kinds: pd.Series) -> pd.DataFrame:
    out = []
    for ns, ps, ss, ks in zip(numbers, parents, stamps, kinds):
        known = ns >= 0
        order, _, _ = kahn(ns[known], ps[known], ss[known])
        kind = dict(zip(ns.tolist(), ks.tolist()))
        out.append((order, int(known.sum()) - len(order), *reply_scan(order, [kind[n] for n in order])))
    return pd.DataFrame(out, columns=["ordered", "left_over", "first", "first_n", "missing", "pending"])


def _kind() -> Column:
    return F.when(F.col("who") == "student", 1).when((F.col("who") == "tutor") & F.col("body").isNotNull(), 2).otherwise(0)


def _reports(rows: DataFrame, number: str, parent: Column) -> DataFrame:
    """A written report of every block of ``BLOCK`` numbers: Kahn's order, what is left over, how it passes on a question."""
    item = F.struct(F.coalesce(number, F.lit(-1)).alias("n"), F.coalesce(parent, F.lit(-1)).alias("p"), F.coalesce(F.unix_micros("at"), F.lit(2**62)).alias("at"), _kind().alias("k"))
    block = F.greatest(F.floor(F.coalesce(number, F.lit(0)) / BLOCK), F.lit(0)).alias("b")
    blocks = rows.groupBy("d", block).agg(  # numbers are unique in a conversation, so a block has BLOCK turns and one without a number
        F.collect_list(item).alias("x"), F.count("body").alias("texts"), F.bool_or("clash").alias("clash"),
        F.bool_or(F.col(number).isNull()).alias("lost"), F.max(number).alias("hi"), F.count(F.lit(1)).alias("c"),
    )
    judged = blocks.withColumn("s", F.pandas_udf(_blocks, _BLOCKS)("x.n", "x.p", "x.at", "x.k")).drop("x")
    return materialize(judged.select("d", "b", "texts", "clash", "lost", "hi", "c", "s.*"), "conversation-blocks")


def _merged(reports: DataFrame) -> DataFrame:
    """One report a conversation: runs of ``BLOCK`` blocks combine until every conversation is one."""
    top = reports.agg(F.max("b")).first()[0] or 0
    out = reports.drop("ordered")
    step_type = "struct<first:int,first_n:bigint,missing:boolean,pending:bigint>"

    def step(acc: Column, x: Column) -> Column:
        cut = (acc.pending >= 0) & (x.first == 1) & (x.first_n != acc.pending + 1)
        none = x.first == 0
        return F.struct(
            F.when(acc.first == 0, x.first).otherwise(acc.first).alias("first"), F.when(acc.first == 0, x.first_n).otherwise(acc.first_n).alias("first_n"),
            (acc.missing | x.missing | cut).alias("missing"), F.when(none, acc.pending).otherwise(x.pending).alias("pending"),
        ).cast(step_type)

    start = F.struct(F.lit(0).alias("first"), F.lit(-1).alias("first_n"), F.lit(False).alias("missing"), F.lit(-1).alias("pending")).cast(step_type)
    while top > 0:
        runs = out.groupBy("d", F.floor(F.col("b") / BLOCK).alias("b")).agg(
            F.sum("texts").alias("texts"), F.bool_or("clash").alias("clash"), F.bool_or("lost").alias("lost"), F.max("hi").alias("hi"),
            F.sum("c").alias("c"), F.sum("left_over").cast("int").alias("left_over"),
            F.sort_array(F.collect_list(F.struct("b", "first", "first_n", "missing", "pending"))).alias("steps"),
        )
        out = runs.withColumn("s", F.aggregate("steps", start, step)).drop("steps").select("d", "b", "texts", "clash", "lost", "hi", "c", "left_over", "s.*")
        top //= BLOCK
    return out


def _defects(whole: DataFrame, broken: Column) -> DataFrame:
    defect = (
        F.when(F.col("texts") == 0, "empty")
        .when(F.coalesce(F.col("clash") | F.col("lost") | broken, F.lit(True)), "broken")
        .when(F.col("missing") | (F.col("pending") >= 0), "missing_reply")
    )
    return whole.select("d", defect.alias("defect"))


def _judge(rows: DataFrame, replies: bool) -> tuple[DataFrame, DataFrame]:
    """((d, defect) of every conversation of turns(), reports of its blocks in the order of the sort)."""
    if not replies:  # turn n waits for turn n - 1: its block is full and sorted if nothing is lost
        reports = _reports(rows, "n", F.col("p"))
        return _defects(_merged(reports), (F.col("left_over") > 0) | (F.col("c") != F.col("hi") + 1)), reports
    ranked = sort_replies(rows)
    reports = _reports(ranked, "k", F.when(F.col("k") > 0, F.col("k") - 1))
    return _defects(_merged(reports), F.col("left_over") > 0), reports


def sort_replies(rows: DataFrame) -> DataFrame:
    """turns() with ``k``: the place from 0 in Kahn's order of the whole conversation, null for turns left over.

    Every block is sorted by itself; an entry waits for its parent's block. Entries point to the entry that their parent
    hangs on, and pointers double until each reaches a root or a lost turn, so rounds are the logarithm of the longest
    chain of blocks; what still points on after as many rounds as that can take hangs on a cycle.
    """
    item = F.struct("n", F.coalesce("p", F.lit(-1)).alias("p"), F.coalesce(F.unix_micros("at"), F.lit(2**62)).alias("at"))
    grouped = rows.where("n IS NOT NULL").groupBy("d", F.floor(F.col("n") / BLOCK).alias("b")).agg(F.collect_list(item).alias("x"))

    @F.pandas_udf("array<struct<n:bigint,entry:bigint,wave:bigint,waits:bigint>>")
    def local(numbers: pd.Series, parents: pd.Series, stamps: pd.Series) -> pd.Series:
        out = []
        for ns, ps, ss in zip(numbers, parents, stamps):
            order, home, waits = kahn(ns, ps, ss)
            out.append([{"n": n, "entry": home[n][0], "wave": home[n][1], "waits": waits.get(n)} for n in order])
        return pd.Series(out)

    nodes = materialize(grouped.select("d", F.inline(local("x.n", "x.p", "x.at"))), "reply-nodes")
    # (d, e, to, off): entry e lies off waves behind entry ``to``, or behind a root if ``to`` is -1; a lost parent gives null
    found = nodes.select("d", F.col("n").alias("waits"), F.col("entry").alias("to"), (F.col("wave") + 1).alias("off"))
    state = materialize(nodes.where("waits IS NOT NULL").select("d", F.col("n").alias("e"), "waits").join(found, ["d", "waits"], "left").select("d", "e", "to", "off"), "reply-state")
    rounds = max(1, state.count().bit_length() + 1)
    for _ in range(rounds):
        if state.where("to >= 0").isEmpty():
            break
        ahead = state.select("d", F.col("e").alias("to"), F.col("to").alias("next"), F.col("off").alias("more"))
        moved = state.where("to >= 0").join(ahead, ["d", "to"], "left").select("d", "e", F.col("next").alias("to"), (F.col("off") + F.col("more")).alias("off"))
        state = materialize(moved.unionByName(state.where("to IS NULL OR to < 0")), "reply-state")
    settled = state.where("to = -1").select("d", F.col("e").alias("entry"), "off")
    waves = nodes.join(settled, ["d", "entry"], "left").where("entry = -1 OR off IS NOT NULL")
    waves = waves.select("d", "n", (F.col("wave") + F.coalesce("off", F.lit(0))).alias("wave"))
    sorted_rows = rows.join(waves, ["d", "n"], "left")
    ranked = distributed_rank(sorted_rows.where("wave IS NOT NULL"), ["d"], ["wave", F.coalesce(F.unix_micros("at"), F.lit(2**62)), "n"], "k")
    return ranked.withColumn("k", F.col("k") - 1).unionByName(sorted_rows.where("wave IS NULL").withColumn("k", F.lit(None).cast("bigint"))).drop("wave")


def find_broken(df: DataFrame, conversation: str, turn_id: str, role: str, text: str, sent_at: str, reply_to: str | None = None) -> DataFrame:
    """(conversation, defect_type): the conversations to be dropped, with the first of empty, broken, missing_reply.

    A null conversation id is read from ``turn_id`` (the part before ``::``), the number at the end of ``turn_id`` gives
    the turn, however it is padded. ``reply_to`` names a column with the turn_id that a message replies to, null where it
    opens the conversation; without it a turn replies to the one before it and turns are numbered from 0. A conversation
    is broken if turns are left over by the sort (a lost message, a cycle), if a turn has two texts, speakers or
    parents, or a speaker that cannot be told. Rows without either id name no conversation and are left out. Rows that
    repeat a turn with the same speaker and text are one turn; blank and null texts are no text; a null or unknown role
    cannot be told; null timestamps come last. An empty table gives no rows; other columns are ignored whatever their
    names.
    """
    judged, _ = _judge(turns(df, conversation, turn_id, role, text, sent_at, reply_to), reply_to is not None)
    return judged.where("defect IS NOT NULL").select(F.col("d").alias(conversation), F.col("defect").alias("defect_type"))


def rebuild(df: DataFrame, conversation: str, turn_id: str, role: str, text: str, sent_at: str, reply_to: str | None = None) -> DataFrame:
    """(conversation, position, turn_no, speaker, text) of every sound conversation, one row per turn; see find_broken().

    ``position`` counts from 0 in the order of the sort.
    """
    rows = materialize(turns(df, conversation, turn_id, role, text, sent_at, reply_to), "turns")
    if reply_to:
        rows = materialize(sort_replies(rows), "sorted-turns")
        reports = _reports(rows, "k", F.when(F.col("k") > 0, F.col("k") - 1))
        judged, placed = _defects(_merged(reports), F.col("left_over") > 0), rows.withColumn("position", F.col("k"))
    else:
        judged, reports = _judge(rows, False)
        places = reports.select("d", "b", F.posexplode("ordered").alias("i", "n")).select("d", "n", (F.col("b") * BLOCK + F.col("i")).alias("position"))
        placed = rows.join(places, ["d", "n"])
    return placed.join(judged.where("defect IS NULL").select("d"), "d", "left_semi").select(
        F.col("d").alias(conversation), "position", F.col("n").alias("turn_no"), F.col("who").alias("speaker"), F.col("body").alias("text")
    )
