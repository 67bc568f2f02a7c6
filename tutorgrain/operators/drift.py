"""Schemas that drift between files: one list of changes and one consistent table.

Every file's top-level fields are profiled in one pass: JSON types, a one-permutation min-hash sketch of the normalised
values, the shapes of the values and their forms. Sketches merge by min and counts by sum, in the tasks and then in
partial aggregates, so no value set and no list of sketches is gathered. Consecutive files of a corpus are compared
field by field; where fields go and others come, a maximum-weight bipartite matching over value, shape and name
similarity tells renames from removals and additions. Rename links then join the names of one field over all files.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorgrain.operators.flatten import events
from tutorgrain.operators.ranks import distributed_rank
from tutorgrain.storage import materialize

SLOTS = 64
THRESHOLD = 0.5
_ISO = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:?\d\d)?$")
_NUMBER = re.compile(r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?$")
_PLAIN_INT = re.compile(r"(?:0|-?[1-9]\d{0,17})$")
_PLAIN_DEC = re.compile(r"-?(?:0|[1-9]\d*)\.\d+$")
_YES_NO = {"true": "1", "yes": "1", "y": "1", "false": "0", "no": "0", "n": "0"}
_PROFILE = "corpus string, file string, field string, written_at timestamp, kind string, key string, n bigint, sketch array<bigint>"
EMPTY_SLOT = 2**62


@dataclass(frozen=True)
class Deep:
    """An array or object nested too deeply for the JSON library: its text as it is."""

    kind: str
    raw: str


def read_line(text: str | None) -> dict | None:
    """The fields of a line, None where it is blank, no JSON or no object; a key that repeats counts with its last value."""
    if not text:
        return None
    try:
        line = json.loads(text)
    except ValueError:
        return None
    except RecursionError:
        return _read_deep(text)
    return line if isinstance(line, dict) else None


def _read_deep(text: str) -> dict | None:
    out, depth, key, begun = {}, 0, None, 0
    try:
        for event, value, kind, start, end in events(text):
            if depth == 0 and event != "{":
                return None
            if event in "{[":
                depth += 1
                begun = start if depth == 2 else begun
            elif event in "}]":
                depth -= 1
                if depth == 1:
                    out[key] = Deep("array" if event == "]" else "object", text[begun:end])
            elif depth == 1:
                key, out[key if event == "value" else value] = (value, None) if event == "key" else (key, json.loads(text[start:end]))
    except ValueError:
        return None
    return out


def json_type(value) -> str:
    if isinstance(value, Deep):
        return value.kind
    return {str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object"}[type(value)]


def form_of(value) -> str:
    """How a whole value is written: what unify() decides about the type of a column by."""
    if isinstance(value, bool):
        return "flag"
    if isinstance(value, float):
        return "dec"
    if isinstance(value, int):
        return "bit" if value in (0, 1) else "epoch" if _number(value)[1] == "time" else "int" if -(2**63) <= value < 2**63 else "dec"
    if not isinstance(value, str):
        return "object_id" if isinstance(value, dict) and isinstance(value.get("id"), (str, int)) else json_type(value)
    if value.lower() in _YES_NO:
        return "flag"
    if _PLAIN_INT.match(value):
        return form_of(int(value))
    if _PLAIN_DEC.match(value):
        return "dec"
    return "iso" if _instant(value) is not None else "text"


def _instant(text: str) -> datetime | None:
    if _ISO.match(text):
        try:
            at = datetime.fromisoformat(text)
            return at.replace(tzinfo=at.tzinfo or timezone.utc)
        except ValueError:
            pass
    return None


def tokens_of(value) -> list[tuple[str, str]]:
    """(normalised value, shape) of a field's value: lists and objects by their members, numbers and times by meaning."""
    if isinstance(value, bool):
        return [("1" if value else "0", "flag")]
    if isinstance(value, (int, float)):
        return [_number(value)]
    if isinstance(value, list):
        return [t for v in value if v is not None for t in tokens_of(v)]
    if isinstance(value, dict):
        return [t for v in value.values() if v is not None for t in tokens_of(v)]
    if isinstance(value, Deep):
        return [(value.raw, "deep")]
    text = str(value).strip()
    if text.lower() in _YES_NO:
        return [(_YES_NO[text.lower()], "flag")]
    if _NUMBER.match(text):
        return [_number(float(text) if re.search(r"[.eE]", text) else int(text))]
    at = _instant(text)
    if at is not None:
        return [(str(int(at.timestamp())), "time")]
    if ";" in text or "|" in text:
        parts = [p.strip() for p in re.split(r"[;|]", text)]
        if all(p and " " not in p for p in parts):
            return [t for p in parts for t in tokens_of(p)]
    return [(text, _shape(text))]


def _number(x: float) -> tuple[str, str]:
    if isinstance(x, int) and 10**11 < x < 10**13:
        return str(x // 1000), "time"
    if isinstance(x, int) and 10**9 < x < 4 * 10**9:
        return str(x), "time"
    if float(x).is_integer():
        return str(int(x)), "flag?" if x in (0, 1) else f"int{len(str(abs(int(x))))}"
    text = repr(float(x))
    return text, f"dec{len(text.partition('.')[2])}"


def _shape(text: str) -> str:
    words = text.split()
    if len(words) > 3:
        return f"text{int(math.log2(len(words)))}{text[-1] if not text[-1].isalnum() else ''}"
    if re.fullmatch(r"[0-9a-f]{12,}", text):
        return f"hex{len(text)}"
    out = re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", re.sub(r"[0-9]+", "9", text)))
    return out if len(out) <= 40 else f"#{xxhash.xxh3_64_hexdigest(out)}"


def _slot(token: str) -> tuple[int, int]:
    h = xxhash.xxh3_64_intdigest(token.encode("utf-8", "replace"))
    return h % SLOTS, h // SLOTS


OPEN_FIELDS = 50_000  # fields of files that a task keeps open before it gives them out


KNOWN = 50_000  # strings whose tokens a task remembers


def _count(found: dict[tuple, list], key: tuple, n: int = 1) -> None:
    entry = found.get(key)
    if entry is None:
        found[key] = [n, None]
    else:
        entry[0] += n


def _looked_up(value, known: dict) -> tuple[str, str, list[tuple[str, int, int]]]:
    """(JSON type, form, (shape, slot, hash) of the members) of a value; those of strings are remembered."""
    plain = isinstance(value, str)
    if plain and value in known:
        return known[value]
    out = json_type(value), form_of(value), [(shape, *_slot(token)) for token, shape in _tokens(value)]
    if plain:
        if len(known) >= KNOWN:
            known.clear()
        known[value] = out
    return out


def _tokens(value) -> list[tuple[str, str]]:
    try:
        return tokens_of(value)
    except RecursionError:  # nested less deeply than the JSON library gives up on
        return [(repr(type(value)), "deep")]


def _profile_value(found: dict[tuple, list], value, known: dict) -> None:
    """Add a field's value to its profile: type, form, members, shapes and the least hash of each sketch slot."""
    kind, form, tokens = _looked_up(value, known)
    _count(found, ("type", kind))
    _count(found, ("form", form))
    _count(found, ("members", ""), len(tokens))
    if ("sketch", "") not in found:
        found["sketch", ""] = [0, [EMPTY_SLOT] * SLOTS]
    sketch = found["sketch", ""][1]
    for shape, slot, h in tokens:
        _count(found, ("shape", shape))
        if h < sketch[slot]:
            sketch[slot] = h


def profile(df: DataFrame, corpus: str, file: str, written_at: str, payload: str) -> DataFrame:
    """(corpus, file, field, written_at, kind, key, n, sketch): profile entries of the fields of files, by task; written out.

    Lines that are null, blank, no JSON or no object are left out, null values do not count; fields in a file are those
    with any other value. ``*`` is the field of a file's own entry, which a file without readable lines has too.
    """
    names = [x.split()[0] for x in _PROFILE.split(", ")]

    types = [pa.string()] * 3 + [pa.timestamp("us", "UTC")] + [pa.string()] * 2 + [pa.int64(), pa.list_(pa.int64())]

    def flush(parts: dict[tuple, dict[tuple, list]]) -> pa.RecordBatch:
        cells = [(h[0], h[1], h[2].encode("utf-8", "replace").decode(), h[3], k[0], k[1].encode("utf-8", "replace").decode(), *v) for h, found in parts.items() for k, v in found.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), types)], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple, dict[tuple, list]] = {}
        known: dict = {}
        for batch in batches:
            for name, path, at, text in zip(*(c.to_pylist() for c in batch.columns)):
                _count(parts.setdefault((name, path, "*", at), {}), ("file", ""))
                for field, value in (read_line(text) or {}).items():
                    if value is not None:
                        _profile_value(parts.setdefault((name, path, field, at), {}), value, known)
            if len(parts) > OPEN_FIELDS:
                yield flush(parts)
                parts = {}
        if parts:
            yield flush(parts)

    lines = df.select(F.col(corpus).cast("string").alias("a"), F.col(file).cast("string").alias("b"), F.col(written_at).cast("timestamp").alias("c"), F.col(payload).cast("string").alias("d"))
    # lines of a file come together, so a task merges them before anything is shuffled; a large file spans several ranges
    lines = lines.where("b IS NOT NULL").repartitionByRange("a", "b", F.xxhash64("d"))
    return materialize(lines.mapInArrow(scan, _PROFILE).withColumn("corpus", _named("corpus")), "drift-profile")


def _named(corpus: str) -> Column:
    """A corpus as a key that is never null: a null corpus is a stream of its own."""
    return F.when(F.col(corpus).isNull(), "").otherwise(F.concat(F.lit("="), F.col(corpus)))


FIELD = ["corpus", "file", "field"]


def field_profiles(entries: DataFrame) -> DataFrame:
    """(corpus, file_no, file, field, type, n, members, slots): a row per file and field; file_no counts a corpus's files."""
    kinds = entries.where("kind IN ('type', 'members', 'file')").groupBy(*FIELD, "kind", "key").agg(F.min("written_at").alias("written_at"), F.sum("n").alias("n"))
    per = kinds.groupBy(*FIELD).agg(
        F.min("written_at").alias("written_at"),
        F.max(F.when(F.col("kind") == "type", F.struct("n", "key"))).getField("key").alias("type"),
        F.sum(F.when(F.col("kind") == "type", F.col("n"))).alias("n"),
        F.sum(F.when(F.col("kind") == "members", F.col("n"))).alias("members"),
    )
    least = entries.where("kind = 'sketch'").groupBy(*FIELD).agg(*[F.min(F.col("sketch")[k]).alias(f"s{k}") for k in range(SLOTS)])
    slots = least.select(*FIELD, F.array(*[f"s{k}" for k in range(SLOTS)]).alias("slots"))
    files = distributed_rank(per.where("field = '*'").select("corpus", "file", "written_at"), ["corpus"], ["written_at", "file"], "file_no")
    found = per.drop("written_at").join(slots, FIELD, "left")
    return files.select("corpus", "file", F.col("file_no") - 1).toDF("corpus", "file", "file_no").join(found, ["corpus", "file"])


def shape_shares(entries: DataFrame) -> DataFrame:
    """(corpus, file, field, key, share): how the members of a field share out over shapes.

    0 and 1 count as flags if no longer whole number stands beside them, else as one-digit numbers.
    """
    n = entries.where("kind = 'shape'").groupBy(*FIELD, "key").agg(F.sum("n").alias("n"))
    whole = n.groupBy(*FIELD).agg(F.bool_or(F.startswith("key", F.lit("int"))).alias("ints"), F.sum("n").alias("all"))
    key = F.when(F.col("key") != "flag?", F.col("key")).when(F.col("ints"), "int1").otherwise("flag")
    return n.join(whole, FIELD).groupBy(*FIELD, key.alias("key")).agg((F.sum("n") / F.max("all")).alias("share"))


def _words(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit(r"([a-z]+|\d+)"), F.lit(1)))


def similarities(gone: DataFrame, come: DataFrame, shares: DataFrame) -> DataFrame:
    """(corpus, step, old_field, new_field, weight): 0 to 1, do two fields look like one? Sketches, shapes, names, kinds.

    ``gone`` and ``come``: (corpus, step, file, field, type, n, members, slots), the fields that two consecutive files
    do not share.
    """
    key = ["corpus", "step"]
    side = lambda df, s: df.select(*key, *[F.col(c).alias(f"{s}_{c}") for c in df.columns if c not in key])
    pairs = side(gone, "o").join(side(come, "w"), key)
    held = lambda df, out: df.join(shares, FIELD).select(*key, F.col("field").alias(f"{out}_field"), "key", F.col("share").alias(out))
    shape = held(gone, "o").join(held(come, "w"), [*key, "key"]).groupBy(*key, "o_field", "w_field").agg(F.sum(F.least("o", "w")).alias("shape"))
    equal = F.size(F.filter(F.zip_with("o_slots", "w_slots", lambda x, y: (x == y) & (x != EMPTY_SLOT)), lambda x: x))
    filled = [F.size(F.filter(f"{s}_slots", lambda x: x != EMPTY_SLOT)) for s in "ow"]
    value = F.least(F.lit(1.0), 2.0 * equal / F.greatest(F.lit(1), F.least(*filled)))
    a, b = _words(F.col("o_field")), _words(F.col("w_field"))
    name = F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))
    lists = [(F.col(f"{s}_type") == "array") | (F.col(f"{s}_members") / F.col(f"{s}_n") > 1.05) for s in "ow"]
    objects = [F.col(f"{s}_type") == "object" for s in "ow"]
    kind = F.when(objects[0] != objects[1], 0.55).when(lists[0] != lists[1], 0.5).when(F.col("o_type") == F.col("w_type"), 1.0).otherwise(0.7)
    found = pairs.join(shape, [*key, "o_field", "w_field"], "left")
    weight = kind * (0.25 * value + 0.5 * F.coalesce("shape", F.lit(0.0)) + 0.25 * name)
    return found.select(*key, F.col("o_field").alias("old_field"), F.col("w_field").alias("new_field"), weight.alias("weight"))


def match(edges: list[tuple[str, str, float]], threshold: float = THRESHOLD) -> list[tuple[str, str]]:
    """Pairs of a maximum-weight bipartite matching over (old, new, weight) that reach the threshold (Hungarian method)."""
    edges = [e for e in edges if e[2] >= threshold]
    if not edges:
        return []
    old, new = sorted({e[0] for e in edges}), sorted({e[1] for e in edges})
    flip = len(old) > len(new)
    rows, columns = (new, old) if flip else (old, new)
    of_edge = {(e[1], e[0]) if flip else (e[0], e[1]): e[2] for e in edges}
    weight = [[of_edge.get((r, c), 0.0) for c in columns] for r in rows]
    n, m = len(rows), len(columns)
    u, v, of, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        of[0], j0 = i, 0
        least, used = [math.inf] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = of[j0], math.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    d = -weight[i0 - 1][j - 1] - u[i0] - v[j]
                    if d < least[j]:
                        least[j], way[j] = d, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[of[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if of[j0] == 0:
                break
        while j0:
            of[j0], j0 = of[way[j0]], way[j0]
    pairs = [(rows[of[j] - 1], columns[j - 1], weight[of[j] - 1][j - 1]) for j in range(1, m + 1) if of[j]]
    return [(b, a) if flip else (a, b) for a, b, w in pairs if w > 0]


def _renames(edges: pd.Series) -> pd.Series:
    return pd.Series([[{"old_field": a, "new_field": b} for a, b in match([(x["old_field"], x["new_field"], x["weight"]) for x in e])] for e in edges])


def changes(entries: DataFrame) -> DataFrame:
    """(file, change_type, old_field, new_field) of consecutive files; see find_changes()."""
    fields = field_profiles(entries)
    one = F.struct("file", "type", "n", "members", "slots")
    both = fields.select("corpus", F.col("file_no").alias("step"), "field", F.lit(1).alias("side"), one.alias("x")).unionByName(
        fields.select("corpus", (F.col("file_no") + 1).alias("step"), "field", F.lit(0).alias("side"), one.alias("x"))
    )
    per = materialize(both.groupBy("corpus", "step", "field").agg(
        F.any_value(F.when(F.col("side") == 0, F.col("x")), True).alias("old"), F.any_value(F.when(F.col("side") == 1, F.col("x")), True).alias("new"),
    ), "drift-fields")
    steps = per.where("field = '*' AND old IS NOT NULL AND new IS NOT NULL").select("corpus", "step", F.col("new.file").alias("now"))
    live = per.where("field <> '*'").join(steps, ["corpus", "step"])
    side = lambda s, t: live.where(f"{s} IS NOT NULL AND {t} IS NULL").select("corpus", "step", "now", "field", f"{s}.*")
    gone, come = side("old", "new"), side("new", "old")
    edges = similarities(gone.drop("now"), come.drop("now"), shape_shares(entries)).where(F.col("weight") >= THRESHOLD)
    # a row per step holds the edges between the fields that two files do not share: schemas, not data
    edges = edges.groupBy("corpus", "step").agg(F.sort_array(F.collect_list(F.struct("old_field", "new_field", "weight"))).alias("edges"))
    matched = edges.select("corpus", "step", F.inline(F.pandas_udf(_renames, "array<struct<old_field string, new_field string>>")("edges")))
    matched = materialize(matched, "drift-renames")
    none = F.lit("")
    change = lambda df, kind, a, b: df.select(F.col("now").alias("file"), F.lit(kind).alias("change_type"), a.alias("old_field"), b.alias("new_field"))
    lone = lambda df, c: df.join(matched.select("corpus", "step", F.col(c).alias("field")), ["corpus", "step", "field"], "left_anti")
    field = F.col("field")
    return (
        change(matched.join(steps, ["corpus", "step"]), "renamed", F.col("old_field"), F.col("new_field"))
        .unionByName(change(lone(gone, "old_field"), "removed", field, none))
        .unionByName(change(lone(come, "new_field"), "added", none, field))
        .unionByName(change(live.where("old.type <> new.type"), "retyped", field, field))
    )


def find_changes(df: DataFrame, corpus: str, file: str, written_at: str, payload: str) -> DataFrame:
    """(file, change_type, old_field, new_field): each file's changes against the file before it in its corpus.

    Files follow each other by ``written_at``, ties by name; a null corpus is a stream of its own, rows without a file
    name are left out. change_type is renamed, removed, added (old_field empty) or retyped (both the name); where a field has values of several types, the
    most frequent one counts. Repeated lines change nothing. An empty table gives no rows; other columns are ignored.
    """
    found = changes(profile(df, corpus, file, written_at, payload))
    return found.select(F.col("file").alias(file), "change_type", "old_field", "new_field")


def canonical_names(found: DataFrame, seen: DataFrame) -> dict[str, str]:
    """Each field name to the one name of its field: names joined by renames, under the one that most files use.

    ``seen``: (field, files). Field names are a schema's vocabulary, not data, so they fit the driver; more than
    100,000 raise an error.
    """
    files = {r[0]: r[1] for r in seen.limit(100_001).collect()}
    if len(files) > 100_000:
        raise ValueError("more than 100,000 field names")
    parent = {f: f for f in files}

    def root(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = found.where("change_type = 'renamed'").groupBy("old_field", "new_field").count().orderBy("old_field", "new_field").collect()
    for a, b, _ in links:
        parent[root(a)] = root(b)
    best: dict[str, str] = {}
    for f in sorted(files, key=lambda f: (-files[f], f)):
        best.setdefault(root(f), f)
    return {f: best[root(f)] for f in files}


#: The forms that all values of a column must have for it to get another type than text.
COLUMN_TYPES = (("boolean", {"flag", "bit"}, {"flag"}), ("timestamp", {"iso", "epoch"}, {"iso"}), ("bigint", {"int", "bit", "epoch"}, set()), ("double", {"int", "bit", "epoch", "dec"}, set()))


def column_types(forms: dict[str, set[str]]) -> dict[str, str]:
    """Column to boolean, timestamp, bigint, double, list, id or string by the forms of all its values in all files."""
    out = {}
    for column, seen in forms.items():
        out[column] = next((t for t, allowed, needed in COLUMN_TYPES if seen <= allowed and needed <= seen), None) or (
            "list" if "array" in seen and seen <= {"array", "text"} else "id" if "object_id" in seen and seen & {"text", "int"} and "array" not in seen else "string"
        )
    return out


def unify(df: DataFrame, line_id: str, corpus: str, file: str, line_no: str, written_at: str, payload: str) -> DataFrame:
    """All lines as one consistent table: the line's keys, one column per field under its one name, and ``_also``.

    A column is boolean, timestamp, bigint or double if every value of the field in every file is one, however written
    (yes and no, 0 and 1 beside them; ISO times, seconds and milliseconds; numbers and numeric text without leading
    zeros). Else it is text and holds strings as they are, lists and objects as JSON; where some files have lists and
    others text joined by ``;`` or ``|``, all are JSON lists, and where some have objects with an ``id`` and others plain
    values, all are plain. ``_also`` maps field names to JSON values that found no place: the second of two names of one
    field in a line, and objects given by their id. Lines that do not parse keep their keys and hold nulls; repeated
    lines stay. Fields that clash with a key's name, or but for case with another field's, get the suffix ``_field``.
    """
    entries = profile(df, corpus, file, written_at, payload)
    seen = entries.where("kind = 'type'").groupBy("field").agg(F.countDistinct("corpus", "file").alias("files"))
    names = canonical_names(changes(entries), seen)
    forms: dict[str, set[str]] = {}
    for f, form in entries.where("kind = 'form'").select("field", "key").distinct().collect():  # ten forms a field at most
        forms.setdefault(names[f], set()).add(form)
    types = column_types(forms)
    keys = [line_id, corpus, file, line_no]

    @F.pandas_udf("struct<v map<string,string>, also map<string,string>>")
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_unified(t, names, types) for t in texts], columns=["v", "also"])

    lines = df.select(*keys, read(F.col(payload).cast("string")).alias("_x"))
    taken, columns = {k.lower() for k in keys} | {"_also"}, []
    for c in sorted(types):
        out = c
        while out.lower() in taken:
            out += "_field"
        taken.add(out.lower())
        columns.append(F.col("_x.v")[c].cast(types[c] if types[c] in ("boolean", "timestamp", "bigint", "double") else "string").alias(out))
    return lines.select(*keys, *columns, F.when(F.size("_x.also") > 0, F.col("_x.also")).alias("_also"))


def _as_json(value) -> str:
    return value.raw if isinstance(value, Deep) else json.dumps(value, ensure_ascii=False)


def _unified(text: str | None, names: dict[str, str], types: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    out, also = {}, {}
    line = read_line(text) or {}
    # a field's own name goes before its other names, so the order of keys in a line decides nothing
    for field in sorted(line, key=lambda f: (names.get(f) != f, f)):
        value = line[field]
        if value is None or field not in names:
            continue
        name = names[field]
        if name in out:
            also[field] = _as_json(value)
            continue
        out[name] = _written(value, types[name])
        if types[name] == "id" and isinstance(value, dict):
            also[field] = _as_json(value)
    clean = lambda d: {k: v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if not v.isascii() else v for k, v in d.items()}
    return clean(out), clean(also)


def _written(value, kind: str) -> str:
    if kind == "boolean":
        return "true" if value is True or str(value).lower() in ("1", "true", "yes", "y") else "false"
    if kind == "timestamp":
        if isinstance(value, str) and not value.isdigit():
            return _instant(value).astimezone(timezone.utc).isoformat()
        n = int(value)
        return datetime.fromtimestamp(n // 1000 if n > 10**11 else n, timezone.utc).replace(microsecond=n % 1000 * 1000 if n > 10**11 else 0).isoformat()
    if kind == "list":
        if isinstance(value, str):
            value = re.split(r"[;|]", value) if re.fullmatch(r"[^\s;|]+(?:[;|][^\s;|]+)+", value) else [value]
        return _as_json(value)
    if kind == "id" and isinstance(value, dict) and "id" in value:
        return str(value["id"])
    return value if isinstance(value, str) else _as_json(value)
