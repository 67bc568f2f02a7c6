"""Scores of texts against a small library inside Arrow batches.

A text's score for a unit is a sum over its words, for BM25 and for character TF-IDF alike, so every word gets one
vector over the units, made once a worker. A batch of texts is scored by adding the vectors of its words; only the rows
that are asked for leave the batch, and nothing is shuffled. The index is collected and counted before; a library with
more than ``INDEX_ROWS`` postings gives no index, and the caller joins tables instead.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX_ROWS, INDEX_UNITS = 1_000_000, 20_000
TEXTS = 256  # texts scored at once
HALF = Decimal("0.5")
CELLS, CACHED = 2_000_000, 8_000_000  # numbers of one step and of the kept word vectors
WORDS = 10_000  # words whose n-grams are counted at once
ONCE = np.ones(WORDS)


def round_half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Values from zero on, rounded as Spark does: a half by a value's shortest decimal form goes up."""
    part = x * 10.0**digits
    whole = np.floor(part)
    part -= whole
    up = part >= 0.5
    part -= 0.5
    for at in zip(*np.nonzero(np.abs(part, out=part) < 1e-4)):
        up[at] = Decimal(repr(float(x[at]))).scaleb(digits) - int(whole[at]) >= HALF
    whole += up
    whole /= 10.0**digits
    return whole


class Index:
    """Postings (term, unit, weight); with ``idf`` the terms are character n-grams of words, else the words."""

    def __init__(self, terms: list[str], term_of: np.ndarray, unit_of: np.ndarray, weight: np.ndarray, n_units: int, idf: np.ndarray | None = None, sizes: tuple[int, ...] = ()):
        order = np.argsort(term_of, kind="stable")
        self.ids = {t: i for i, t in enumerate(terms)}
        self.start = np.searchsorted(term_of[order], np.arange(len(terms) + 1))
        self.unit, self.weight, self.n_units, self.idf, self.sizes = unit_of[order], weight[order], n_units, idf, sizes
        self.forget()

    def forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.vectors, self.held, self.used = np.zeros((64, self.n_units)), [], 0

    def _slot(self, letters: bytes) -> int:
        word = letters.decode(errors="replace")
        if self.idf is None:
            terms = [self.ids[word]] if word in self.ids else []
        else:
            padded = f" {word} "
            terms = [t for n in self.sizes for i in range(len(padded) - n + 1) if (t := self.ids.get(padded[i : i + n])) is not None]
        if not terms:
            self.slots[letters] = -1
            return -1
        if self.used == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        at = [slice(self.start[t], self.start[t + 1]) for t in terms]
        weight = [self.weight[s] if self.idf is None else self.weight[s] * self.idf[t] for s, t in zip(at, terms)]
        self.vectors[self.used] = np.bincount(np.concatenate([self.unit[s] for s in at]), np.concatenate(weight), self.n_units)
        self.held.append(np.array(terms))
        self.slots[letters] = self.used
        self.used += 1
        return self.used - 1

    def _slots(self, words: list[bytes]) -> np.ndarray:
        """The slots of a text's words that meet the index; a repeated word comes once for words, as often as it is there for n-grams."""
        known = self.slots
        if self.idf is None:
            words = list(dict.fromkeys(words))
        try:
            slots = [known[w] for w in words]
        except KeyError:
            slots = [known[w] if w in known else self._slot(w) for w in words]
        return np.array([s for s in slots if s >= 0], dtype=np.int64)

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """Scores (texts, units) of texts given as words, rounded to six places."""
        if self.used * self.n_units > CACHED or len(self.slots) > 500_000:
            self.forget()
        out = np.zeros((len(texts), self.n_units))
        norm, step = np.zeros(len(texts)), max(1, CELLS // self.n_units)
        rows, parts, size = [], [], 0
        for i, words in enumerate(texts):
            slots = self._slots(words)
            # a long text's words are counted, so that it takes no more room than the words the index knows
            slots, times = np.unique(slots, return_counts=True) if len(slots) > WORDS else (slots, ONCE[: len(slots)])
            for at in range(0, len(slots), step):
                out[i] += times[at : at + step] @ self.vectors.take(slots[at : at + step], axis=0)
            if self.idf is None or not len(slots):
                continue
            if len(words) > WORDS:
                norm[i] = self._length(slots, times)
                continue
            rows.append(i)
            parts.append(slots)
            size += len(slots)
            if size > WORDS:
                norm[rows] = self._lengths(parts)
                rows, parts, size = [], [], 0
        if rows:
            norm[rows] = self._lengths(parts)
        if self.idf is not None:
            out /= np.where(norm > 0, norm, 1.0)[:, None]
        return round_half_up(out, 6)

    def _lengths(self, texts: list[np.ndarray]) -> np.ndarray:
        """Lengths of the n-gram vectors of texts given as slots, each as often as its word comes."""
        held = [self.held[s] for at in texts for s in at.tolist()]
        size = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
        row, bits = np.repeat(np.arange(len(texts)), [len(at) for at in texts]), len(self.idf).bit_length()
        keys = np.repeat(row << bits, size) | np.concatenate(held)
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        w = np.diff(first, append=len(keys)) * self.idf[keys[first] & ((1 << bits) - 1)]
        return np.sqrt(np.bincount(keys[first] >> bits, w * w, len(texts)))

    def _length(self, slots: np.ndarray, times: np.ndarray) -> float:
        """The length of one text's n-gram vector, its different words and their numbers given."""
        tf = np.zeros(len(self.idf))
        for s, n in zip(slots.tolist(), times.tolist()):
            np.add.at(tf, self.held[s], n)
        return float(np.sqrt(np.sum((tf * self.idf) ** 2)))


def first_ranks(score: np.ndarray, k: int) -> np.ndarray:
    """Ranks from 1 by falling score, then unit; 0 beyond ``k`` and for scores that are not positive."""
    n, units = score.shape
    key = np.rint(-score * 1e6) * units + np.arange(units)
    top = np.argpartition(key, k - 1, axis=1)[:, :k] if k < units else np.tile(np.arange(units), (n, 1))
    top = np.take_along_axis(top, np.argsort(np.take_along_axis(key, top, axis=1), axis=1), axis=1)
    rank = np.zeros(score.shape, dtype=np.int32)
    np.put_along_axis(rank, top, np.arange(1, top.shape[1] + 1, dtype=np.int32)[None, :], axis=1)
    rank[score <= 0] = 0
    return rank


def collected(df: DataFrame) -> pa.Table | None:
    rows = df.limit(INDEX_ROWS + 1).toArrow()
    return rows if 0 < rows.num_rows <= INDEX_ROWS else None


def index_of(rows: pa.Table, units: list, term: str, weight: str, idf: str | None = None, sizes: tuple[int, ...] = ()) -> Index:
    """The index of collected postings (term, unit_id, weight) over the sorted ``units``."""
    place = {u: i for i, u in enumerate(units)}
    codes = rows.column(term).combine_chunks().dictionary_encode()
    terms, term_of = codes.dictionary.to_pylist(), codes.indices.to_numpy()
    unit_of = np.array([place[u] for u in rows.column("unit_id").to_pylist()], dtype=np.int64)
    per_term = None
    if idf is not None:
        per_term = np.zeros(len(terms))
        per_term[term_of] = rows.column(idf).to_numpy()
    return Index(terms, term_of, unit_of, rows.column(weight).to_numpy(), len(units), per_term, sizes)


def mapped(queries: DataFrame, key: str, columns: list, schema: list[T.StructField], known: object, pick: Callable) -> DataFrame:
    """(key, ...) of ``pick``: it gets ``known`` and the texts' columns, and gives the places of its rows' texts and their columns."""
    fields = T.StructType([T.StructField(key, queries.schema[key].dataType), *schema])
    # pickled with its classes, and opened once a worker: what is worked out there serves its later tasks
    shared = queries.sparkSession.sparkContext.broadcast([cloudpickle.dumps(known)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value
        if len(kept) == 1:
            kept.append(pickle.loads(kept[0]))
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                text, values = pick(kept[1], part.columns[1:])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text, pa.int64())), *values], names=fields.names)

    return queries.select(F.col(key), *columns).mapInArrow(scan, fields)


def words_of(column: pa.Array) -> list[list[bytes]]:
    r"""A column's words; bytes part at what `\s` means to Spark, strings at other blanks, too."""
    return [t.split() for t in column.cast(pa.binary()).to_pylist()]


def rows_of(queries: DataFrame, key: str, columns: list, unit: T.StructField, units: list, indexes: tuple[Index, ...], pick: Callable, schema: list[tuple[str, T.DataType]]) -> DataFrame:
    """(key, unit_id, ...) of ``pick``: it gets the indexes and the texts' words by column, and gives (text, unit, columns)."""

    def picked(known: tuple, columns: list[pa.Array]) -> tuple:
        labels, indexes = known
        text, at, values = pick(indexes, [words_of(c) for c in columns])
        return text, [labels.take(pa.array(at)), *values]

    fields = [T.StructField("unit_id", unit.dataType), *[T.StructField(n, t) for n, t in schema]]
    return mapped(queries, key, columns, fields, (pa.array(units), indexes), picked)
