"""Oversized texts cut at natural boundaries.

Candidate cuts are the starts of the tokenizer's words, each with a penalty for its kind: heading, turn, paragraph, list
entry, line, sentence, clause, word, or inside a word where a single word is very long. A dynamic program over the
candidates picks the cuts that minimise penalties plus size imbalance, subject to the size limit with the overlap
counted in. A candidate's cost is the least over the candidates at most a limit before it, so the work and the memory
grow with the text's length and not with its square. Token counts add up at the candidates, so a piece's size is a
difference of prefix sums; every piece is counted again at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorgrain.llm.tokens import PATTERN, TOKENIZER, encode, encoding, vocabulary

PIECE = "doc_id bigint, piece_no int, n_pieces int, char_from int, char_to int, n_tokens int, overlap_tokens int, cut_at string"
KINDS = ("heading", "turn", "paragraph", "list_entry", "line", "sentence", "clause", "word", "inside_word")
PENALTY = (0.0, 0.3, 0.6, 0.8, 1.0, 1.5, 4.0, 8.0, 40.0)
BALANCE = 6.0  # weight of a piece's squared relative distance from the even size
PIECE_COST = 3.0
LONG_WORD = 48  # tokens from which a single word gets candidates inside, or half of what the limit leaves beside the overlap
BLOCK = 64  # candidates that the program takes at once
_WORDS = regex.compile(PATTERN)
_HEADING = regex.compile(r"(?:#{1,6}\s|<h[1-6]\b|={3,}|\*\*[^*\n]{1,80}\*\*\s*$)", regex.M)
_TURN = regex.compile(r"[*_>\[\s]{0,4}\p{Lu}[\p{L}_ ]{0,20}\]?[*_]{0,2}\s?:[*_]{0,2}\s")
_ENTRY = regex.compile(r"\s*(?:[-*+•–]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s")
_SENTENCE = regex.compile(r"[.!?…。！？][\"'”’»)\]*_]*$")
_CLAUSE = regex.compile(r"[,;:—–)][\"'”’»]*$")


_LOOK, _ENDS, _PAUSES = frozenset(" \t\r\n\v\f"), frozenset(".!?…。！？\"'”’»)]*_"), frozenset(",;:—–")


def candidates(text: str, enc, long_word: int = LONG_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(character, tokens before it, kind) of every candidate cut, with both ends of the text."""
    chars, counts, kinds = [0], [0], [0]
    sizes: dict[str, int] = {}
    total = 0
    for m in _WORDS.finditer(text):
        word, at = m.group(), m.start()
        size = sizes.get(word)
        if size is None:
            size = sizes[word] = len(encode(enc, word))
        if at and not word.isspace():
            before, spaced = text[at - 1], word[0] == " "
            if before in _LOOK or (spaced and before in _ENDS):
                kind = _kind(text, at)  # only places that may be more than the start of a word
            elif spaced:
                kind = 6 if before in _PAUSES else 7
            else:
                kind = 8 if before.isalnum() else 7
            chars.append(at)
            counts.append(total)
            kinds.append(kind)
        if size >= long_word:
            parts, offsets = enc.decode_with_offsets(encode(enc, word))
            for k in range(1, len(offsets)):
                if offsets[k] > offsets[k - 1]:
                    chars.append(at + offsets[k])
                    counts.append(total + k)
                    kinds.append(8)
        total += size
    chars.append(len(text))
    counts.append(total)
    kinds.append(0)
    return np.array(chars), np.array(counts), np.array(kinds)


def _kind(text: str, at: int) -> int:
    k = at
    while k and text[k - 1] in " \t":
        k -= 1
    start = at + 1 if text[at] == " " else at
    if k == 0 or text[k - 1] in "\r\n":
        if _HEADING.match(text, start):
            return 0
        if _TURN.match(text, start, start + 40):
            return 1
        j, breaks = k, 0
        while j and text[j - 1] in " \t\r\n":
            j -= 1
            breaks += text[j] == "\n" or (text[j] == "\r" and text[j : j + 2] != "\r\n")
        if breaks > 1:
            return 2
        return 3 if _ENTRY.match(text, start) else 4
    before = text[max(0, k - 6) : k]
    if k < at or text[at] == " ":
        if _SENTENCE.search(before):
            return 5
        if _CLAUSE.search(before):
            return 6
        return 7
    return 7 if _CLAUSE.search(before) or not text[at - 1].isalnum() else 8


def cut(text: str, enc, limit: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
    """(char_from, char_to, n_tokens, overlap_tokens, cut_at) of the pieces in order; whole texts within the limit give one."""
    most = limit
    while True:
        pieces = _cut(text, enc, most, overlap)
        sizes = [len(encode(enc, text[a:b])) for a, b, *_ in pieces]
        if max(sizes) <= limit:
            return [(a, b, n, o, k) for (a, b, o, k), n in zip(pieces, sizes)]
        most -= max(1, max(sizes) - limit)  # white space at a cut can join differently; leave room for it


def _cut(text: str, enc, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    room = limit - overlap
    if room < 4:
        raise ValueError("a text cannot be cut below the limit")
    chars, count, kinds = candidates(text, enc, min(LONG_WORD, room // 2))
    total, last = int(count[-1]), len(chars) - 1
    if total <= limit:
        return [(0, len(text), 0, "end")]
    penalty = np.array(PENALTY)[kinds]
    penalty[last] = 0.0
    cost, found = _program(count, penalty, limit, overlap)
    if found is None:
        raise ValueError("a text cannot be cut below the limit")
    out, previous = [], 0
    for s, e in found:
        out.append((int(chars[s]), int(chars[e]), int(count[previous] - count[s]), "end" if e == last else KINDS[kinds[e]]))
        previous = e
    return out


def _starts(count: np.ndarray, penalty: np.ndarray, overlap: int) -> np.ndarray:
    """Where the next piece starts if one ends at a candidate: the mildest one within the overlap, the farthest of equals."""
    at = np.arange(len(count))
    low = np.searchsorted(count, count - overlap, side="left")
    start, open_ = at.copy(), (low < at)
    open_[0] = open_[-1] = False
    mild = np.minimum(penalty, 8.0)
    for level in np.unique(mild):
        of_level = np.append(np.flatnonzero(mild == level), len(count))
        nearest = of_level[np.searchsorted(of_level, low, side="left")]
        hit = open_ & (nearest < at)
        start[hit] = nearest[hit]
        open_ &= ~hit
    return start


def _program(count: np.ndarray, penalty: np.ndarray, limit: int, overlap: int) -> tuple[float, list[tuple[int, int]] | None]:
    """(cost, (start, end) of the pieces as candidates) of the best cuts.

    Candidates come in blocks: the pieces that begin before a block are tried for all its ends at once. A piece inside a
    block is shorter than the block, and is tried, end by end, only where such a piece could be cheaper.
    """
    total, last = int(count[-1]), len(count) - 1
    start = _starts(count, penalty, overlap)
    begins = count[start]
    even = (total - overlap) / np.ceil((total - overlap) / (limit - overlap)) + overlap
    cost, back = np.full(last + 1, np.inf), np.zeros(last + 1, dtype=np.int64)
    cost[0] = 0.0
    # a piece that begins at a candidate is at least as long as the way from it to its end
    first = np.searchsorted(count, count - limit, side="left")

    def ways(before: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = count[ends][:, None] - begins[before]
        out = (size - even) / even
        out *= out
        out *= BALANCE
        out += cost[before]
        out[size > limit] = np.inf
        return out

    for a in range(1, last + 1, BLOCK):
        ends = np.arange(a, min(a + BLOCK, last + 1))
        before = first[a] + np.flatnonzero(np.isfinite(cost[first[a] : a]))
        least = np.full(len(ends), np.inf)
        if len(before):
            tried = ways(before, ends)
            pick = np.argmin(tried, axis=1)
            least = tried[np.arange(len(ends)), pick]
            back[ends] = before[pick]
        cost[ends] = least + penalty[ends] + PIECE_COST
        longest = min(limit, count[ends[-1]] - begins[ends].min())
        off = max(0.0, even - longest) / even
        if cost[ends].min() + BALANCE * off * off < least.max():
            for k in range(1, len(ends)):
                inside = ways(ends[:k], ends[k : k + 1])[0]
                best = int(np.argmin(inside))
                if inside[best] < least[k]:
                    cost[ends[k]], back[ends[k]] = inside[best] + penalty[ends[k]] + PIECE_COST, ends[best]
    if not np.isfinite(cost[last]):
        return np.inf, None
    way = [last]
    while way[-1]:
        way.append(int(back[way[-1]]))
    way.reverse()
    return float(cost[last]), [(int(start[i]) if i else 0, j) for i, j in zip(way, way[1:])]


def split_oversized(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 512, overlap: int = 32, tokenizer: str = TOKENIZER
) -> DataFrame:
    """One row per piece of every text of more than ``limit`` tokens, in order, with its places in the whole text.

    (doc_id, piece_no, n_pieces, char_from, char_to, n_tokens, overlap_tokens, cut_at): pieces have at most ``limit``
    tokens counted by themselves, cover the text without gaps and share up to ``overlap`` tokens with the piece before;
    ``cut_at`` is the kind of boundary at the piece's end. Texts within the limit, null and empty ones give no rows;
    texts without any boundary are cut inside their words. Copies count by themselves; an empty table gives no rows.
    """
    if limit < 16 or not 0 <= overlap < limit // 2:
        raise ValueError("the limit must be at least 16 and the overlap less than half of it")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))
    names = [x.split()[0] for x in PIECE.split(", ")]
    types = [pa.int64(), *[pa.int32()] * 6, pa.string()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value)
        for batch in batches:
            out = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(encode(enc, t)) > limit:
                    pieces = cut(t, enc, limit, overlap)
                    out += [(doc, k, len(pieces), *piece) for k, piece in enumerate(pieces)]
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("t"))
    # a token has at least one byte, so shorter texts cannot exceed the limit
    return rows.where(F.octet_length("t") > limit).mapInArrow(scan, PIECE)
