"""Held-out evaluation passages inside training documents.

The n-grams of all normalised evaluation words form a hash table that is broadcast (its size is checked; larger sets go
in blocks, one scan of the corpus each). Every window of every document is looked up in it. A hit is verified exactly:
from the shared n-gram the match is extended both ways by the furthest-reaching method for edit distance over words,
and the pair counts if some run of at least ``min_run`` item words needs at most one edit in ``edit_every`` words.
With runs of 30 words and 3 edits at most, at least 7 words in a row are untouched, so 7-grams lose no case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAK = "item_id bigint, doc_id bigint, item_from int, item_words int, edits int, char_from int, char_to int"
_TAG = re.compile(r"<[^<>]{1,200}>")
_ENTITY = re.compile(r"&(?:[a-zA-Z]{2,10}|#\d{1,6}|#x[0-9a-fA-F]{1,6});")
_APOSTROPHES = {"&apos;", "&#39;", "&rsquo;", "&lsquo;", "&#x27;", "&#8217;"}
# a word: letters and digits of ASCII, joined over marks inside words, damaged characters and hyphens at line ends
_WORD = re.compile(
    r"[A-Za-z0-9]+(?:(?:[.,:;'`]|-[ \t]*\r?\n[ \t]*|[^\x00-\x7f    -‍ -    　–—…])+[A-Za-z0-9]+)*"
)
_MARKS = re.compile(r"[^a-z0-9]+")


def _blank(m: re.Match) -> str:
    return ("'" if m.group() in _APOSTROPHES else " ") * len(m.group())


def words_with_places(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Normalised words of a text and their places in it. Case, punctuation, white space and markup do not matter."""
    if "<" in text:
        text = _TAG.sub(_blank, text)
    if "&" in text:
        text = _ENTITY.sub(_blank, text)
    words, places = [], []
    for m in _WORD.finditer(text):
        w = m.group().lower()
        words.append(w if w.isalnum() and w.isascii() else _MARKS.sub("", w))
        places.append(m.span())
    return words, places


class EvalIndex:
    """N-gram table of evaluation items; words are numbered, documents' unknown words get numbers below zero."""

    def __init__(self, items: list[tuple[int, str]], n: int, min_run: int, edit_every: int):
        self.n, self.min_run, self.edit_every = n, min_run, edit_every
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        self.grams: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item_id, text in items:
            if text is None:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_with_places(text)[0]]
            if len(ids) < min_run:
                continue
            k = len(self.items)
            self.items.append((item_id, ids))
            for i in range(len(ids) - n + 1):
                self.grams.setdefault(tuple(ids[i : i + n]), []).append((k, i))

    def search(self, text: str) -> list[tuple[int, int, int, int, int, int]]:
        """(item_id, item_from, item_words, edits, char_from, char_to): the longest run found of each leaked item."""
        words, places = words_with_places(text)
        if len(words) < self.n:
            return []
        number = self.vocabulary.get
        ids = [number(w, -1) for w in words]
        found: dict[int, tuple] = {}
        last: dict[tuple[int, int], int] = {}
        grams, n = self.grams, self.n
        for j, gram in enumerate(zip(*(ids[k:] for k in range(n)))):
            hits = grams.get(gram)
            if hits is None:
                continue
            for k, i in hits:
                diagonal = (k, j - i)
                before, last[diagonal] = last.get(diagonal), j
                if before == j - 1:
                    continue  # inside a match that was extended from its first n-gram
                run = self._run(self.items[k][1], ids, i, j)
                if run and run[1] > found.get(k, (0, 0))[1]:
                    found[k] = run
        return [
            (self.items[k][0], a, size, edits, places[u][0], places[min(v, len(places)) - 1][1])
            for k, (a, size, edits, u, v) in found.items()
        ]

    def _run(self, item: list[int], doc: list[int], i: int, j: int) -> tuple[int, int, int, int, int] | None:
        """The longest run through the n-gram at (i, j) that keeps the edit share; (from, words, edits, doc span)."""
        n, every = self.n, self.edit_every
        left = _reach(item, doc, i - 1, j - 1, -1, every, len(item) - i)
        right = _reach(item, doc, i + n, j + n, 1, every, i + n)
        best = None
        for a, (la, da) in enumerate(left):
            for b, (lb, db) in enumerate(right):
                size = la + n + lb
                if size >= self.min_run and (a + b) * every <= size and (best is None or size > best[1]):
                    best = (i - la, size, a + b, j - da, j + n + db)
        return best


def _reach(item: list[int], doc: list[int], i: int, j: int, way: int, every: int, others: int) -> list[tuple[int, int]]:
    """For 0, 1, 2.. edits the most item words (and document words) that match from (i, j) on in one direction.

    Stops where more edits than one in ``every`` words would be needed even if all ``others`` item words matched.
    """
    size = len(item) - i if way > 0 else i + 1
    room = len(doc) - j if way > 0 else j + 1

    def slide(a: int, b: int) -> int:
        while a < size and b < room and item[i + way * a] == doc[j + way * b]:
            a, b = a + 1, b + 1
        return a

    front = {0: slide(0, 0)}
    out = [(front[0], front[0])]
    edits = 0
    while out[-1][0] < size and (edits + 1) * every <= out[-1][0] + others + every:
        edits += 1
        after: dict[int, int] = {}
        for d in range(-edits, edits + 1):
            # d: document words used minus item words used
            a = max(front.get(d, -1) + 1, front.get(d - 1, -1), front.get(d + 1, -2) + 1)
            if a < 0:
                continue
            a = min(a, size, room - d)
            if a < 0 or a + d < 0:
                continue
            after[d] = slide(a, a + d)
        if not after:
            break
        front = after
        d, a = max(front.items(), key=lambda x: (x[1], -abs(x[0])))
        if a <= out[-1][0] and edits > 1 and a >= size:
            break
        out.append((a, a + d))
    return out


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", n: int = 7, min_run: int = 30, edit_every: int = 10, block_bytes: int = 16 << 20,
) -> DataFrame:
    """(item_id, doc_id, item_from, item_words, edits, char_from, char_to): one row per item leaked into a document.

    Places count characters of the document's text and words of the item. Null and blank texts leak nothing, items
    shorter than ``min_run`` words cannot leak, copies of documents count by themselves, and either table may be empty.
    The evaluation set goes to the driver in blocks of at most ``block_bytes`` of text, so what is broadcast stays
    bounded whatever its size; other columns are ignored whatever their names.
    """
    spark = docs.sparkSession
    chosen = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("t"))
    total = chosen.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    corpus = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    out = None
    for b in range(blocks):
        part = chosen if blocks == 1 else chosen.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        found = corpus.mapInArrow(_scanner(spark, [tuple(r) for r in part.collect()], n, min_run, edit_every), LEAK)
        out = found if out is None else out.unionByName(found)
    return out


def _scanner(spark, rows: list[tuple[int, str]], n: int, min_run: int, edit_every: int):
    shared = spark.sparkContext.broadcast(rows)
    names = [x.split()[0] for x in LEAK.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 5]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or EvalIndex(shared.value, n, min_run, edit_every)
            out = [
                (item, doc, *rest)
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for item, *rest in index.search(text)
            ]
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return scan


def without_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no evaluation passage."""
    return docs.join(leaks.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
