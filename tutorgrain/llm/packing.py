"""Containers of fixed capacity packed with whole texts, by hierarchical multi-length packing over size counts.

Only how many texts have each size matters for a packing, and there are at most ``capacity`` sizes, so the plan is made
from the size histogram, whole runs of equal windows at a time. Texts are routed to context-size tiers, each with windows
of its own length. From the longest tier down: texts of the tier first fill the tightest gaps of the containers that
longer tiers left, the others are packed into windows of the tier's length, and the windows join to containers, whose
gaps wait for the shorter tiers. The plan is a list of fill patterns with multiplicities whose length depends on the
capacity and the tiers alone, not on the number of texts. A distributed rank of every text within its size then names its
container: one shuffle, no driver-side texts. Containers are numbered by their fill and dealt to step groups in turn,
forth and back, which balances the groups' tokens.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tutorgrain.llm.tokens import TOKENIZER, sized
from tutorgrain.storage import materialize

TIERS = (128, 256, 512, 1024, 2048)
RANK_ROWS = 50_000  # rows that one task ranks at a time, even if all texts have one size


Pattern = list[list[int]]  # [size, copies] in order of placement


@dataclass
class Plan:
    """Fill patterns: pattern p stands for ``count[p]`` containers from number ``first[p]`` on."""

    capacity: int
    patterns: list[Pattern] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)

    @property
    def containers(self) -> int:
        return self.first[-1] + self.count[-1] if self.count else 0


class Windows:
    """Open windows of one length by their gaps: runs of equal windows, each a pattern and how many of it there are."""

    def __init__(self, length: int):
        self.length = length
        self.gaps: list[int] = []  # distinct gaps, ascending
        self.at: dict[int, list[tuple[Pattern, int]]] = {}

    def keep(self, gap: int, pattern: Pattern, number: int) -> None:
        if gap not in self.at:
            self.at[gap] = []
            insort(self.gaps, gap)
        self.at[gap].append((pattern, number))

    def fill(self, size: int, item: Pattern, todo: int) -> int:
        """Put up to ``todo`` items of a size into the tightest gaps that hold them; how many are left."""
        while todo:
            k = bisect_left(self.gaps, size)
            if k == len(self.gaps):
                break
            gap = self.gaps[k]
            pattern, number = self.at[gap].pop()
            if not self.at[gap]:
                del self.at[gap]
                self.gaps.pop(k)
            copies = min(gap // size, todo)
            used = min(number, todo // copies)
            if number > used:
                self.keep(gap, pattern, number - used)
            self.keep(gap - size * copies, _joined(pattern, item, copies), used)
            todo -= used * copies
        return todo

    def place(self, size: int, item: Pattern, todo: int) -> None:
        """Put all items into gaps, and open windows with as many copies as fit for those that no gap holds."""
        while todo := self.fill(size, item, todo):
            copies = min(self.length // size, todo)
            number = todo // copies
            self.keep(self.length - size * copies, _joined([], item, copies), number)
            todo -= number * copies

    def runs(self) -> Iterator[tuple[int, Pattern, int]]:
        """(fill, pattern, number) from the fullest windows on."""
        for gap in list(self.gaps):
            for pattern, number in self.at[gap]:
                yield self.length - gap, pattern, number


def _joined(pattern: Pattern, item: Pattern, copies: int) -> Pattern:
    out = [list(x) for x in pattern]
    for size, n in item:
        if out and out[-1][0] == size:
            out[-1][1] += n * copies
        else:
            out.append([size, n * copies])
    return out


def make_plan(sizes: dict[int, int], capacity: int, tiers: tuple[int, ...] = TIERS) -> Plan:
    """Pack ``sizes`` (size to number of texts, sizes from 1 to capacity) into containers of ``capacity``."""
    containers = Windows(capacity)
    bounds = sorted({min(t, capacity) for t in tiers if t > 0} | {capacity})
    for low, high in reversed(list(zip([0, *bounds[:-1]], bounds))):  # long tiers first
        own = Windows(high)
        for size in sorted((s for s, c in sizes.items() if low < s <= high and c > 0), reverse=True):
            rest = containers.fill(size, [[size, 1]], sizes[size])
            own.place(size, [[size, 1]], rest)
        for fill, pattern, number in list(own.runs()):
            containers.place(fill, pattern, number)
    plan, start = Plan(capacity), 0
    for _, pattern, number in containers.runs():
        plan.patterns.append(pattern)
        plan.count.append(number)
        plan.first.append(start)
        start += number
    return plan


class Slots:
    """Arrays that turn (size, rank within the size) into (container, position)."""

    def __init__(self, plan: Plan, zeros: int):
        runs: dict[int, list[tuple[int, int, int]]] = {}
        items, fill = [], []
        for p, pattern in enumerate(plan.patterns):
            position = 0
            for size, copies in pattern:
                runs.setdefault(size, []).append((p, copies, position))
                position += copies
            items.append(position)
            fill.append(sum(s * c for s, c in pattern))
        keys, pattern_of, copies_of, position_of = [], [], [], []
        for size, parts in sorted(runs.items()):
            rank = 0
            for p, copies, position in parts:
                keys.append((size << 44) + rank)
                pattern_of.append(p)
                copies_of.append(copies)
                position_of.append(position)
                rank += copies * plan.count[p]
        self.keys = np.array(keys, dtype="int64")
        self.pattern_of, self.copies_of, self.position_of = (np.array(x, dtype="int64") for x in (pattern_of, copies_of, position_of))
        self.first = np.array(plan.first or [0], dtype="int64")
        self.items, self.fill = np.array(items or [0], dtype="int64"), np.array(fill or [0], dtype="int64")
        self.containers = max(plan.containers, 1 if zeros else 0)

    def place(self, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        container, position = np.zeros_like(ranks), np.zeros_like(ranks)
        some = sizes > 0
        if some.any():
            key = (sizes[some] << 44) + ranks[some]
            k = np.searchsorted(self.keys, key, side="right") - 1
            inside, copies = key - self.keys[k], self.copies_of[k]
            container[some] = self.first[self.pattern_of[k]] + inside // copies
            position[some] = self.position_of[k] + inside % copies
        if not some.all():  # texts without tokens take no space: dealt to all containers, after their texts
            container[~some] = ranks[~some] % self.containers
            of = np.searchsorted(self.first, container[~some], side="right") - 1
            position[~some] = self.items[of] + ranks[~some] // self.containers
        fill = self.fill[np.searchsorted(self.first, container, side="right") - 1]
        return container, position, fill


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, step: int = 32,
    tiers: tuple[int, ...] = TIERS, tokenizer: str = TOKENIZER,
) -> DataFrame:
    """One row per text, or per piece of a text that alone exceeds the capacity.

    (doc_id, piece_no, n_pieces, token_from, n_tokens, tier, container_id, position, fill, step_group): ``position``
    counts the pieces of a container from 0, ``fill`` its tokens. Null, empty and blank texts are placed too: texts
    without tokens take no space. Copies are placed each by itself, ties in size by document id; an empty table gives
    no rows; other columns are ignored whatever their names.
    """
    rows = materialize(sized(docs, doc_id, text, tokenizer), "token-sizes")
    n, cap = F.col("n_tokens"), F.lit(capacity)
    parts = F.greatest(F.lit(1), F.ceil(n / cap)).cast("int")
    pieces = rows.withColumn("n_pieces", parts).select(
        "doc_id", "n_pieces", n.alias("total"), F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece_no")
    )
    pieces = pieces.withColumn("token_from", F.col("piece_no") * cap)
    pieces = pieces.withColumn("size", F.least(cap, F.col("total") - F.col("token_from")).cast("bigint")).drop("total")

    histogram = {r[0]: r[1] for r in pieces.groupBy("size").count().collect()}  # at most capacity + 1 rows
    buckets = max(1, -(-sum(histogram.values()) // RANK_ROWS))
    slots = Slots(make_plan(histogram, capacity, tiers), histogram.get(0, 0))
    steps = max(1, -(-slots.containers // step))

    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("size", "bucket").count().select(
        "size", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")
    )
    inside = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "piece_no")) - 1
    ranked = pieces.withColumn("inside", inside).join(offsets, ["size", "bucket"])
    ranked = ranked.withColumn("rank", F.col("inside") + F.col("offset"))
    shared = docs.sparkSession.sparkContext.broadcast(slots)  # its length depends on the capacity only

    @F.pandas_udf("container_id long, position long, fill long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        c, p, f = shared.value.place(size.to_numpy("int64"), rank.to_numpy("int64"))
        return pd.DataFrame({"container_id": c, "position": p, "fill": f})

    tier = F.lit(capacity)
    for t in sorted((t for t in tiers if t < capacity), reverse=True):
        tier = F.when(F.col("size") <= t, F.lit(t)).otherwise(tier)
    placed = ranked.withColumn("slot", place("size", "rank"))
    turn, at = F.floor(F.col("slot.container_id") / steps), F.col("slot.container_id") % steps
    return placed.select(
        "doc_id", "piece_no", "n_pieces", F.col("token_from").cast("int").alias("token_from"),
        F.col("size").cast("int").alias("n_tokens"), tier.cast("int").alias("tier"), "slot.container_id",
        F.col("slot.position").cast("int").alias("position"), F.col("slot.fill").cast("int").alias("fill"),
        F.when(turn % 2 == 0, at).otherwise(steps - 1 - at).alias("step_group"),
    )


def oversized(placements: DataFrame) -> DataFrame:
    """(doc_id) of the texts that had to be split: those with a further piece in a container."""
    placed = F.max(F.when(F.col("container_id").isNotNull(), F.col("piece_no")))
    return placements.groupBy("doc_id").agg(placed.alias("last")).where("last > 0").select("doc_id")


def container_fill(placements: DataFrame) -> DataFrame:
    """(container_id, n_items, fill, tier, step_group) of every container; its tier is that of its longest piece."""
    return placements.groupBy("container_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").cast("bigint").alias("fill"), F.max("tier").alias("tier"), F.max("step_group").alias("step_group")
    )


def tier_fill(containers: DataFrame, capacity: int = 2048) -> DataFrame:
    """(tier, n_containers, n_items, tokens, fill_share) from container_fill()'s rows."""
    return containers.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("fill").alias("tokens"),
        F.round(F.sum("fill") / (F.count(F.lit(1)) * capacity), 6).alias("fill_share"),
    )


def packing_faults(docs: DataFrame, placements: DataFrame, doc_id: str = "doc_id", capacity: int = 2048) -> DataFrame:
    """One row of counts that are all 0 in a right packing, beside the number of texts.

    (n_texts, texts_missing, pieces_repeated, pieces_missing, containers_over_capacity, fills_wrong, positions_wrong,
    containers_in_two_groups)
    """
    per_text = placements.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("piece_no").alias("distinct"), F.max("n_pieces").alias("n_pieces"))
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id")).join(per_text, "doc_id", "left")
    wrong = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    a = texts.agg(F.count(F.lit(1)).alias("n_texts"), wrong(F.col("n").isNull()).alias("texts_missing"), wrong(F.col("n") > F.col("distinct")).alias("pieces_repeated"), wrong(F.col("distinct") != F.col("n_pieces")).alias("pieces_missing"))
    per = placements.groupBy("container_id").agg(
        F.sum("n_tokens").alias("tokens"), F.min("fill").alias("lo"), F.max("fill").alias("hi"), F.count(F.lit(1)).alias("n"),
        F.countDistinct("position").alias("places"), F.max("position").alias("last"), F.countDistinct("step_group").alias("groups"),
    )
    b = per.agg(
        wrong(F.col("tokens") > capacity).alias("containers_over_capacity"), wrong((F.col("tokens") != F.col("lo")) | (F.col("lo") != F.col("hi"))).alias("fills_wrong"),
        wrong((F.col("n") != F.col("places")) | (F.col("last") + 1 != F.col("n"))).alias("positions_wrong"), wrong(F.col("groups") > 1).alias("containers_in_two_groups"),
    )
    return a.crossJoin(F.broadcast(b))  # one row each
