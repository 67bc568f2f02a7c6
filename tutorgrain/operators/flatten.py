"""Deeply nested JSON records as related flat tables.

An event parser reads every record into path-value-ordinal triples without building the record or recursing into it. A
first pass counts which JSON types stand at which path; places that usually hold a list, and the declared maps, are the
repeated ancestors. The second pass gives every value with its repeated ancestor, the path below it, and the ordinals
(positions and map keys) passed on the way. Triples of one ancestor and the same ordinals are one row of that ancestor's
table: grouping and pivoting them gives one flat table per ancestor, and a row's ordinals without the last are its
parent's key.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIPLE = "record_no bigint, record_id bigint, ancestor string, parent_key string, child_key string, path string, value string, value_type string"
PLACES = 100_000
ROOT = "$"
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|(")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)(?![0-9.eE])|(true|false|null|NaN|-?Infinity))')
_STRING = json.decoder.scanstring
_SPECIAL = re.compile(r"[.\[\]{}\\]")
_KEY_SPECIAL = re.compile(r"[.\\]")
_WORDS = {"true": "boolean", "false": "boolean", "null": "null"}
VALUE, FIRST_VALUE, KEY, FIRST_KEY, MORE = range(5)


@dataclass
class Shape:
    """Repeated places (lists and maps), places whose text may encode JSON, and the fields of every ancestor's table."""

    lists: frozenset[str] = frozenset()
    maps: frozenset[str] = frozenset()
    encoded: frozenset[str] = frozenset()
    fields: dict[str, list[str]] = field(default_factory=dict)


def events(text: str) -> Iterator[tuple[str, str | None, str, int, int]]:
    """(event, value, type, from, to) of one JSON text; events are ``{ } [ ] key value``. ValueError where it is no JSON."""
    at, state, inside = 0, VALUE, []
    token = _TOKEN.match
    while True:
        m = token(text, at)
        if m is None:
            raise ValueError(at)
        start, at, which = m.start(m.lastindex), m.end(), m.lastindex
        if which == 1:
            c = text[start]
            if c in "{[" and state <= FIRST_VALUE:
                yield c, None, "object" if c == "{" else "array", start, at
                inside.append(c)
                state = FIRST_KEY if c == "{" else FIRST_VALUE
                continue
            if c in "}]" and inside and inside[-1] == ("{" if c == "}" else "[") and (state == MORE or state == (FIRST_KEY if c == "}" else FIRST_VALUE)):
                inside.pop()
                yield c, None, "", start, at
            elif c == "," and state == MORE and inside:
                state = KEY if inside[-1] == "{" else VALUE
                continue
            else:
                raise ValueError(start)
        elif which == 2:
            value, at = _STRING(text, at, True)
            if state == KEY or state == FIRST_KEY:
                m = token(text, at)
                if m is None or m.group(1) != ":":
                    raise ValueError(at)
                yield "key", value, "", start, at
                at, state = m.end(), VALUE
                continue
            if state > FIRST_VALUE:
                raise ValueError(start)
            yield "value", value, "string", start, at
        else:
            if state > FIRST_VALUE:
                raise ValueError(start)
            yield "value", text[start:at], "number" if which == 3 else _WORDS.get(text[start:at], "number"), start, at
        state = MORE
        if not inside:
            if text[at:].strip(" \t\n\r"):
                raise ValueError(at)
            return


def encoded_events(text: str) -> list | None:
    """Events of what a text encodes, however often encoded: an object, an array or null; None for any other text."""
    head = text.lstrip(" \t\n\r")[:1]
    if head not in ("{", "[", '"') and text.strip(" \t\n\r") != "null":
        return None
    try:
        inner = list(events(text))
    except ValueError:
        return None
    if head == '"':
        return encoded_events(inner[0][1]) if inner[0][1].lstrip(" \t\n\r")[:1] in ("{", "[", '"') else None
    return [(*e, text) for e in inner] if len(inner[0]) == 5 else inner


def _name(key: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m.group(), key) if _SPECIAL.search(key) else key


def _key(key: str) -> str:
    return _KEY_SPECIAL.sub(lambda m: "\\" + m.group(), key) if _KEY_SPECIAL.search(key) else key


class Shredder:
    """Reads one record's events; ``put(ancestor, parent_key, child_key, path, value, type)`` gets its triples.

    Without a shape it counts places: every list repeats, text is decoded wherever it encodes an object or a list, and
    ``counts`` holds (path, type) pairs. What lies deeper than ``max_depth`` levels stays whole as JSON text.
    """

    def __init__(self, shape: Shape | None, maps: frozenset[str], max_depth: int):
        self.shape, self.maps, self.max_depth = shape, shape.maps if shape else maps, max_depth
        self.out: list[tuple | None] = []
        self.counts: dict[tuple[str, str], int] = {}
        self.repeated = False

    def read(self, text: str) -> None:
        self._consume(((*e, text) for e in events(text)), "", ROOT, "", "", "", 0)

    def _consume(self, source, place: str, ancestor: str, above: str, child: str, path: str, depth: int) -> None:
        # a frame: kind (o, l, m), place, ancestor, key above, own key, path, ordinal of the next element, keys seen
        frames: list[list] = []
        skip = 0
        for event, value, kind, start, end, text in source:
            if skip:
                skip += 1 if event in "{[" else -1 if event in "}]" else 0
                if skip == 0:
                    self._put(ancestor, above, child, path, text[begun:end], "array" if event == "]" else "object")
                continue
            if event == "key":
                top = frames[-1]
                self._repeated_key(top, value)
                if top[0] == "m":
                    above, child = top[3], value
                    place, ancestor, path = top[1] + "{}", top[1] + "{}", ""
                else:
                    name = _name(value)
                    place = f"{top[1]}.{name}" if top[1] else name
                    ancestor, above, child = top[2], top[3], top[4]
                    path = f"{top[5]}.{name}" if top[5] else name
                continue
            if event in "}]":
                frames.pop()
                continue
            if frames and frames[-1][0] == "l":
                top = frames[-1]
                place = ancestor = top[1] + "[]"
                above, child, path = top[3], str(top[6]), ""
                top[6] += 1
            if self._decodes(kind, value, place, ancestor, above, child, path, depth + len(frames)):
                continue
            if self.shape is None:
                self._count(place, kind)
                repeats = event == "["
            else:
                repeats = place in self.shape.lists
            if repeats and kind == "null":
                continue
            if repeats and event != "[":  # a single value counts as a list of one
                if path == "" and place == ancestor:
                    self._put(ancestor, above, child, "", None, "array")
                above = self._below(above, child, ancestor)
                ancestor = place = place + "[]"
                child, path = "0", ""
                repeats = False
            if event == "value":
                self._put(ancestor, above, child, path, None if kind == "null" else value, kind)
                continue
            if depth + len(frames) >= self.max_depth or (event == "[" and not repeats):
                skip, begun = 1, start
                continue
            is_map = event == "{" and place in self.maps
            if path == "" and (place == ancestor or not place):
                self._put(ancestor, above, child, "", None, kind)
            if event == "[" or is_map:
                frames.append(["l" if event == "[" else "m", place, ancestor, self._below(above, child, ancestor), child, path, 0, {}, None])
            else:
                frames.append(["o", place, ancestor, above, child, path, 0, {}, None])

    @staticmethod
    def _below(above: str, child: str, ancestor: str) -> str:
        return "" if ancestor == ROOT else f"{above}.{_key(child)}" if above else _key(child)

    def _decodes(self, kind: str, value: str | None, place: str, ancestor: str, above: str, child: str, path: str, depth: int) -> bool:
        if kind != "string" or (self.shape is not None and place not in self.shape.encoded):
            return False
        if depth >= self.max_depth:
            return False
        inner = encoded_events(value)
        if inner is None:
            return False
        self._consume(iter(inner), place, ancestor, above, child, path, depth)
        return True

    def _count(self, place: str, kind: str) -> None:
        self.counts[place, kind] = self.counts.get((place, kind), 0) + 1

    def _put(self, ancestor: str, above: str, child: str, path: str, value: str | None, kind: str) -> None:
        if self.shape is not None:
            self.out.append((ancestor, above, child, path, value, kind))

    def _repeated_key(self, frame: list, key: str) -> None:
        """A key that repeats in an object counts with its last value: triples of the earlier one are taken back."""
        now, spans = len(self.out), frame[7]
        if frame[8] is not None:
            spans[frame[8]] = (spans[frame[8]], now)
        if key in spans:
            for i in range(*spans[key]):
                self.out[i] = None
            self.repeated = True
        spans[key], frame[8] = now, key


def _clean(column: list, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(column, kind)
    except UnicodeEncodeError:  # lone surrogates from escapes have no UTF-8
        return pa.array([x if x is None else x.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for x in column], kind)


def place_counts(df: DataFrame, record: str, maps: tuple[str, ...] = (), max_depth: int = 64) -> DataFrame:
    """(path, type, n): how often a value of each JSON type stands at each path, summed in the tasks and then over them."""
    declared = frozenset(maps)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], int] = {}

        def flush() -> pa.RecordBatch:
            keys = list(total)
            return pa.RecordBatch.from_arrays([_clean([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], names=["path", "type", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                one = Shredder(None, declared, max_depth)
                try:
                    one.read(text)
                except ValueError:
                    continue
                for key, n in one.counts.items():
                    total[key] = total.get(key, 0) + n
            if len(total) > PLACES:
                yield flush()
                total = {}
        if total:
            yield flush()

    texts = df.select(F.col(record).cast("string").alias("t")).where("t IS NOT NULL")
    return texts.mapInArrow(scan, "path string, type string, n bigint").groupBy("path", "type").agg(F.sum("n").alias("n"))


class _Node:
    def __init__(self):
        self.n: dict[str, int] = {}
        self.below: dict[str, _Node] = {}

    def merge(self, other: _Node) -> None:
        for k, n in other.n.items():
            self.n[k] = self.n.get(k, 0) + n
        for name, node in other.below.items():
            self.below.setdefault(name, _Node()).merge(node)


_STEP = re.compile(r"\[\]|\{\}|(?:\\.|[^.\[\]{}\\])+|(?<=\.)(?=\.|$|\[|\{)|^(?=\.)")


def shape_of(counts: list[tuple[str, str, int]], maps: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> Shape:
    """The repeated places by their counts: a place repeats if arrays stand there at least as often as single values."""
    root = _Node()
    for path, kind, n in counts:
        node = root
        for step in _STEP.findall(path):
            node = node.below.setdefault(step, _Node())
        node.n[kind] = node.n.get(kind, 0) + n
    found_lists, found_encoded, fields = set(lists), {p for p in (*maps, *lists)}, {}
    todo = [(root, "", ROOT, "")]
    while todo:
        node, place, ancestor, path = todo.pop()
        held = node.n.get("array", 0) + node.n.get("object", 0)
        plain = node.n.get("string", 0) + node.n.get("number", 0) + node.n.get("boolean", 0)
        if held and held >= plain:
            found_encoded.add(place)
        single = plain + node.n.get("object", 0)
        if place in lists or (node.n.get("array", 0) and node.n["array"] >= single):
            found_lists.add(place)
            inner = node.below.pop("[]", _Node())
            alone = _Node()
            alone.n, alone.below = {k: n for k, n in node.n.items() if k not in ("array", "null")}, node.below
            inner.merge(alone)
            todo.append((inner, place + "[]", place + "[]", ""))
            fields.setdefault(place + "[]", [])
            continue
        if place in maps:
            fields.setdefault(place + "{}", [])
        if plain or node.n.get("null") and not held or (node.n.get("array") and place not in found_lists):
            fields.setdefault(ancestor, []).append(path)
        for name, child in node.below.items():
            if name == "{}":
                todo.append((child, place + "{}", place + "{}", ""))
            elif name != "[]":
                todo.append((child, f"{place}.{name}" if place else name, ancestor, f"{path}.{name}" if path else name))
    fields.setdefault(ROOT, [])
    return Shape(frozenset(found_lists), frozenset(maps), frozenset(found_encoded) | {""}, {a: sorted(p) for a, p in fields.items()})


def discover(df: DataFrame, record: str, maps: tuple[str, ...] = (), lists: tuple[str, ...] = (), max_depth: int = 64) -> Shape:
    """The shape of a table of records, from one pass over it; ``maps`` and ``lists`` name places that are known to repeat.

    Paths are a schema's vocabulary, not data, so they fit the driver; objects whose keys are data must be declared as
    maps, and more than 100,000 paths raise an error that says so.
    """
    rows = place_counts(df, record, maps, max_depth).limit(3 * PLACES + 1).collect()
    if len(rows) > 3 * PLACES:
        raise ValueError("more than 100,000 paths: declare objects whose keys are data in `maps`")
    return shape_of([tuple(r) for r in rows], maps, lists)


def triples(df: DataFrame, record_id: str, record: str, shape: Shape, max_depth: int = 64) -> DataFrame:
    """(record_no, record_id, ancestor, parent_key, child_key, path, value, value_type) of all records.

    ``ancestor`` is the path of the repeated place (``$`` for the record itself), ``path`` the place below it, empty for
    the element itself, which has one triple whatever it holds. A single value where a list is usual counts as a list of
    one; JSON encoded as text counts as what it encodes; missing, null and empty lists have no elements; a null element is
    one without fields; a list where single values are usual, and what lies deeper than ``max_depth``, stays one value,
    as JSON text. A key that repeats in an object counts with its last value. Records that are null, blank or no JSON
    give one triple of the type ``rejected`` with the reason; repeated ids give the rows of each record, told apart by
    ``record_no``; an empty table gives none; other columns are ignored whatever their names.
    """
    names = [x.split()[0] for x in TRIPLE.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 6]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for no, one, text in zip(*(c.to_pylist() for c in batch.columns)):
                reader = Shredder(shape, frozenset(), max_depth)
                try:
                    if text is None or not text.strip():
                        raise ValueError("null" if text is None else "blank")
                    reader.read(text)
                except ValueError as e:
                    at = getattr(e, "pos", e.args[0])  # of the string scanner or the parser
                    out.append((no, one, ROOT, "", "", "", f"no JSON at {at}" if isinstance(at, int) else at, "rejected"))
                    continue
                out += [(no, one, *t) for t in reader.out if t is not None] if reader.repeated else [(no, one, *t) for t in reader.out]
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([_clean(list(c), t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([_clean(list(c), t) for c, t in zip(columns, types)], names=names)

    rows = df.select(F.monotonically_increasing_id().alias("n"), F.col(record_id).cast("bigint").alias("i"), F.col(record).cast("string").alias("t"))
    return rows.mapInArrow(scan, TRIPLE)


KEYS = ["record_no", "record_id", "parent_key", "child_key"]


def children(found: DataFrame) -> DataFrame:
    """(record_id, ancestor, parent_key, child_key): the rows of all ancestors' tables, grouped from their triples.

    Triples of a row lie in one task, so the grouping combines them before it moves one row per child.
    """
    rows = found.where(F.col("ancestor") != ROOT).groupBy("record_no", "record_id", "ancestor", "parent_key", "child_key").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("record_id", "ancestor", "parent_key", "child_key")


def child_table(found: DataFrame, ancestor: str, fields: dict[str, str]) -> DataFrame:
    """One repeated ancestor as a flat table: record_id, parent_key, child_key and a column for each of ``fields``.

    ``fields`` maps column names to paths below the ancestor; the empty path is the element itself if it is a plain value.
    """
    own = found.where((F.col("ancestor") == ancestor) & (F.col("value_type") != "rejected"))
    marker = F.count(F.lit(1)).alias("_n")
    picked = [F.max(F.when(F.col("path") == path, F.col("value"))).alias(column) for column, path in fields.items()]
    keys = KEYS if ancestor != ROOT else KEYS[:2]
    return own.groupBy(*keys).agg(marker, *picked).drop("_n", "record_no")


def rejects(found: DataFrame) -> DataFrame:
    """(record_id, reason) of the records that gave no rows."""
    return found.where("value_type = 'rejected'").select("record_id", F.col("value").alias("reason"))


def tables(found: DataFrame, shape: Shape) -> dict[str, DataFrame]:
    """Every ancestor's table by its path, ``$`` for the records' own fields; columns are the paths seen, sorted.

    A path that clashes with a key column or, but for case, with another path gets the suffix ``_field`` as often as
    needed; a plain element's value is the column ``value``. Write ``found`` to a table first if several are read.
    """
    out = {}
    for ancestor, paths in shape.fields.items():
        taken, fields = set(KEYS), {}
        for path in paths:
            column = path or "value"
            while column.lower() in taken:
                column += "_field"
            taken.add(column.lower())
            fields[column] = path
        out[ancestor] = child_table(found, ancestor, fields)
    return out
