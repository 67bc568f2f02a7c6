"""Evidence of texts for a small library's phrases inside Arrow batches.

A batch's tokens walk a trie of the library's n-grams; a token, n-gram or acronym that the library has leads to its
phrases, and what meets at one phrase is one number: which of its rare tokens, which acronyms, the best n-gram, and
whether the phrase is there as a whole. All columns of evidence follow from that number, so they are worked out once a
worker for each number that comes up. Nothing is shuffled; a larger library gives no phrasebook, and the caller joins
tables instead.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tutorgrain.functions.text import FUNCTION_WORDS, NUMBER_WORDS, PEDAGOGY_WORDS
from tutorgrain.operators import lexical as L

PHRASES, KEYS, UNITS = 100_000, 3_000_000, 20_000
STATES = 300_000  # kept numbers with their evidence
WORD = 30  # bits of the first mask, which shares its number with phrase, n-gram and whole match; later masks have 60
KINDS = ("exact_phrase", "acronym", "ngram", "rare_token_set")
MULT = (1.0, 0.85, 0.55, 0.42)
DROP = {*FUNCTION_WORDS, *NUMBER_WORDS, *PEDAGOGY_WORDS}
STATE_NAMES = ("candidate", "support_only", "reject")


def _signed_round(x: np.ndarray) -> np.ndarray:
    return np.where(x < 0, -1.0, 1.0) * L.round_half_up(np.abs(x), 6)


def _tokens(text: str) -> list[str]:
    """Content tokens of a text of a-z, A-Z, 0-9, blanks and commas."""
    return [w for w in re.sub(r"[^a-z0-9]+", " ", text.lower()).split() if len(w) >= 2 and w not in DROP]


def _csr(pairs: dict[int, list[tuple]], keys: int) -> tuple[np.ndarray, list[np.ndarray]]:
    flat = [x for k in range(keys) for x in pairs.get(k, ())]
    start = np.zeros(keys + 1, dtype=np.int64)
    start[1:] = np.cumsum([len(pairs.get(k, ())) for k in range(keys)])
    return start, [np.array(c, dtype=np.int64) for c in zip(*flat)]


class Phrasebook:
    """Phrases as dicts (unit, field, kind, weight, cap, phrase_no, norm, tokens, acronyms, core) in the order of unit, field and number.

    ``spec`` and ``rare`` give specificity and rarity by document frequency.
    """

    def __init__(self, phrases: list[dict], units: list, spec: list[float], rare: list[bool], short: int):
        self.phrases, self.units, self.spec, self.short = phrases, units, spec, short
        grams_of = [sorted({" ".join(t[i : i + n]) for n in (2, 3, 4) for i in range(len(t) - n + 1)}) for t in (p["tokens"] for p in phrases)]
        per_unit: dict[int, tuple[set, set]] = defaultdict(lambda: (set(), set()))
        for p, grams in zip(phrases, grams_of):
            tokens, texts = per_unit[p["unit"]]
            tokens.update(p["tokens"])
            if len(p["tokens"]) >= 2:
                texts.update(grams, (" ".join(p["tokens"]), p["norm"]))
        token_df, text_df = (Counter(x for pair in per_unit.values() for x in pair[k]) for k in (0, 1))
        self.norm_spec = [spec[text_df[p["norm"]]] for p in phrases]
        self.token_spec = {t: spec[n] for t, n in token_df.items()}

        vocabulary = sorted(token_df)
        token_id = {t: i for i, t in enumerate(vocabulary)}
        self.drop = sorted(DROP)
        self.known = pa.array([*self.drop, *vocabulary], pa.string())
        self.n_tokens = len(vocabulary)
        # n-grams by length, specificity and text: the best one has the highest number
        grams = sorted({g for of in grams_of for g in of}, key=lambda g: (g.count(" "), spec[text_df[g]], g))
        gram_id = {g: i for i, g in enumerate(grams)}
        self.grams, self.gram_spec = grams, [spec[text_df[g]] for g in grams]
        self.levels, before = [], token_id
        for n in (2, 3, 4):
            level = [g for g in grams if g.count(" ") == n - 1]
            keys = np.array([before[g.rpartition(" ")[0]] * max(1, self.n_tokens) + token_id[g.rpartition(" ")[2]] for g in level], dtype=np.int64)
            order = np.argsort(keys)
            before = {level[at]: i for i, at in enumerate(order)}
            self.levels.append((keys[order], np.array([gram_id[level[at]] for at in order], dtype=np.int64)))
        acronyms = sorted({a for p in phrases for a in p["acronyms"]})
        acronym_id = {a: i for i, a in enumerate(acronyms)}
        self.acronyms = pa.array(acronyms, pa.string())

        # by key: phrase, mask and bit, place of the n-gram among the phrase's, and what is counted
        self.n_keys = self.n_tokens + len(grams) + len(acronyms)
        pairs: dict[int, list[tuple]] = defaultdict(list)
        self.bits, self.own_grams, self.n_rare, masks = [], [], [], 1
        for pid, (p, own) in enumerate(zip(phrases, grams_of)):
            rare_own = sorted({t for t in p["tokens"] if rare[token_df[t]]})
            bits = [*rare_own, *sorted(set(p["acronyms"]))]
            for i, b in enumerate(bits):
                word, bit = (0, i) if i < WORD else (1 + (i - WORD) // 60, (i - WORD) % 60)
                masks = max(masks, word + 1)
                is_rare = i < len(rare_own)
                key = token_id[b] if is_rare else self.n_tokens + len(grams) + acronym_id[b]
                whole = is_rare and len(p["tokens"]) == 1
                pairs[key].append((pid, word, 1 << bit, 0, (1 << 40 if is_rare else 1 << 21) + (whole << 20)))
            if len(p["tokens"]) == 1 and not rare_own:
                pairs[token_id[p["tokens"][0]]].append((pid, 0, 0, 0, 1 << 20))
            own = sorted(own, key=gram_id.get)
            for i, g in enumerate(own):
                pairs[self.n_tokens + gram_id[g]].append((pid, 0, 0, i + 1, 1))
            self.bits.append(bits)
            self.n_rare.append(len(rare_own))
            self.own_grams.append([gram_id[g] for g in own])
        self.start, columns = _csr(pairs, self.n_keys)
        self.pid, self.word, self.bit, self.place, self.count = columns
        self.masks, self.place_bits = masks, max(map(len, self.own_grams)).bit_length()
        self.whole = np.array([len(own) or -1 for own in self.own_grams])
        self.padded = [f" {p['norm']} " for p in phrases]

        fields = sorted({p["field"] for p in phrases})
        kinds = ("identity", "negative", "support")
        self.unit_of = np.array([p["unit"] for p in phrases])
        self.group_of = self.unit_of * len(fields) + np.array([fields.index(p["field"]) for p in phrases])
        self.kind_of = np.array([kinds.index(p["kind"]) for p in phrases])
        self.named_of = np.array([p["field"] == "canonical_terms" for p in phrases])
        self.cap_of = np.array([p["cap"] for p in phrases])
        self.columns = [pa.array([units[p["unit"]] for p in phrases])] + [pa.array([p[c] for p in phrases], t) for c, t in (("field", pa.string()), ("kind", pa.string()), ("cap", pa.float64()), ("phrase_no", pa.int32()))]
        self.kind_names = pa.array(KINDS)
        self.forget()

    def fits(self) -> bool:
        """Whether its entries are few and phrase, whole match, n-gram and first mask have room in one number."""
        return len(self.pid) <= KEYS and len(self.phrases).bit_length() + 1 + self.place_bits + WORD <= 62

    def forget(self) -> None:
        self.ids: dict = {}
        self.text_ids: dict[str, int] = {}
        self.texts = pa.array([], pa.string())
        self.table = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.float64, np.float64, bool, bool)]

    def _state(self, pid: int, exact: int, place: int, masks: list[int]) -> tuple | None:
        """(pid, kind, text, score, specificity, accepted, refused) as the joined tables' columns have them, not yet rounded."""
        p, n, mask, shift = self.phrases[pid], self.n_rare[pid], masks[0], WORD
        for m in masks[1:]:
            mask, shift = mask | m << shift, shift + 60
        there = [(i, b) for i, b in enumerate(self.bits[pid]) if mask >> i & 1]
        rare, acro = [b for i, b in there if i < n], [b for i, b in there if i >= n]
        if exact:
            kind, text, spec = 0, p["norm"], self.norm_spec[pid]
        elif acro:
            kind, text, spec = 1, ",".join(acro), max(self.token_spec.get(a.lower(), self.spec[0]) for a in acro)
        elif place:
            g = self.own_grams[pid][place - 1]
            kind, text, spec = 2, self.grams[g], self.gram_spec[g]
        elif len(rare) >= 2:
            kind, text, spec = 3, ",".join(rare), sum(self.token_spec[t] for t in rare) / len(rare)
        else:
            return None
        score = p["weight"] * MULT[kind] * max(0.60, min(1.35, spec / max(math.log(4.0), 1.0)))
        accepted, refused = self._judged(p, kind, text, spec, exact > 0, rare, acro) if p["kind"] == "identity" else (False, False)
        return pid, kind, self.text_ids.setdefault(text, len(self.text_ids)), score, spec, accepted, refused

    def _judged(self, p: dict, kind: int, text: str, spec: float, exact: bool, rare: list[str], acro: list[str]) -> tuple[bool, bool]:
        """(accepted, refused as too short) of evidence for an identity field."""
        tokens, field, one, tok = p["tokens"], p["field"], len(p["tokens"]) == 1, p["tokens"][0]
        low, strong = [a.lower() for a in acro], exact or bool(acro)
        long_or_backed = lambda span: min(map(len, span)) >= self.short or bool(set(rare) - set(span))
        if field == "canonical_terms":
            if not strong:
                return False, False
            if one:
                ok = tok in rare and long_or_backed([tok])
                return ok, tok in rare and not ok
            ok = exact or long_or_backed(low)
            return ok, not ok
        if field == "formula_or_symbol_forms":
            ok = long_or_backed(tokens if exact else low) if strong else len(rare) >= 2
            return ok, strong and not ok
        if kind == 0:
            return not one and spec >= math.log(6.0), False
        if kind == 1:
            return False, False
        matched = set(_tokens(text))
        core = len(matched & p["core"])
        if kind == 2:
            return len(matched) >= 3 and spec >= math.log(10.0) and (core >= 2 or len(rare) >= 3), False
        return len(rare) >= 3 and spec >= math.log(8.0) and core >= 2, False

    def find(self, texts: pa.Array, acronyms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, row of the table) of every evidence, by text and phrase; texts are normalised, acronyms divided by blanks."""
        if len(self.ids) > STATES:
            self.forget()
        at, keys = self._keys(texts, acronyms)
        # every key of a text with all its phrases
        size = self.start[keys + 1] - self.start[keys]
        entry = np.repeat(self.start[keys] - np.cumsum(size) + size, size) + np.arange(size.sum())
        pair = np.repeat(at, size) * len(self.phrases) + self.pid[entry]
        order = np.argsort(pair)
        pair, entry = pair[order], entry[order]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        if not len(first):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        count = np.add.reduceat(self.count[entry], first)
        place = np.maximum.reduceat(self.place[entry], first)
        text, pid = np.divmod(pair[first], len(self.phrases))
        exact = (count >> 20) & 1
        whole = np.flatnonzero((count & 0xFFFFF) == self.whole[pid])
        if len(whole):
            said = texts.take(pa.array(text[whole])).to_pylist()
            exact[whole] = [self.padded[p] in f" {t} " for p, t in zip(pid[whole].tolist(), said)]
        keep = np.flatnonzero((exact > 0) | (place > 0) | ((count >> 21) & 0x7FFFF > 0) | (count >> 40 >= 2))
        if self.masks == 1:
            masks = [np.add.reduceat(self.bit[entry], first)[keep]]
        else:
            masks = [np.add.reduceat(np.where(self.word[entry] == w, self.bit[entry], 0), first)[keep] for w in range(self.masks)]
        text, pid, exact, place = text[keep], pid[keep], exact[keep], place[keep]
        state = (((pid << 1 | exact) << self.place_bits | place) << WORD) | masks[0]
        names = state.tolist() if self.masks == 1 else list(zip(state.tolist(), *[m.tolist() for m in masks[1:]]))
        ids = list(map(self.ids.get, names))
        if None in ids:
            rows, n = [], len(self.table[0])
            for i, known in enumerate(ids):
                if known is None and names[i] not in self.ids:
                    row = self._state(int(pid[i]), int(exact[i]), int(place[i]), [int(m[i]) for m in masks])
                    self.ids[names[i]] = n + len(rows) if row else -1
                    if row:
                        rows.append(row)
            ids = list(map(self.ids.get, names))
            if rows:
                new = [np.array(c, dtype=t.dtype) for t, c in zip(self.table, zip(*rows))]
                new[3:5] = [L.round_half_up(c, 6) for c in new[3:5]]
                self.table = [np.concatenate(x) for x in zip(self.table, new)]
                self.texts = pa.concat_arrays([self.texts, pa.array(list(self.text_ids)[len(self.texts) :], pa.string())])
        ids = np.array(ids, dtype=np.int64)
        return (text, ids) if (ids >= 0).all() else (text[ids >= 0], ids[ids >= 0])

    def _keys(self, texts: pa.Array, acronyms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, key): every text's distinct tokens, n-grams and acronyms that the library has."""

        def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
            parts = pc.split_pattern(column, " ")
            return parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64)

        words, at = split(texts)
        code = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.binary_length(words).to_numpy(zero_copy_only=False)
        keep = (code >= len(self.drop)) | ((code < 0) & (size >= 2))
        token, at = np.where(code < 0, -1, code - len(self.drop))[keep], at[keep]
        node, found_at, found = token, [at[token >= 0]], [token[token >= 0]]
        for n, (keys, gram) in zip((2, 3, 4), self.levels):
            if len(node) < 2 or not len(keys):
                break
            node, last = node[:-1], token[n - 1 :]
            i = np.flatnonzero((node >= 0) & (last >= 0) & (at[: len(node)] == at[n - 1 :]))
            asked = node[i] * self.n_tokens + last[i]
            to = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            there = keys[to] == asked
            node = np.full(len(node), -1, dtype=np.int64)
            node[i[there]] = to[there]
            found_at.append(at[i[there]])
            found.append(gram[to[there]] + self.n_tokens)
        if len(self.acronyms):
            words, at = split(acronyms)
            code = pc.fill_null(pc.index_in(words, value_set=self.acronyms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            found_at.append(at[code >= 0])
            found.append(code[code >= 0] + self.n_tokens + len(self.grams))
        return np.divmod(np.unique(np.concatenate(found_at) * self.n_keys + np.concatenate(found)), self.n_keys)

    def evidence(self, ids: np.ndarray) -> list[pa.Array]:
        """The columns of rows of the table, from unit_id to short_reject."""
        pid, kind, text, score, spec, accepted, refused = [t[ids] for t in self.table]
        at = pa.array(pid)
        return [*[c.take(at) for c in self.columns], self.kind_names.take(pa.array(kind)), self.texts.take(pa.array(text)), *map(pa.array, (score, spec, accepted, refused))]

    def score(self, at: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
        """Scores and gates of every text and unit with evidence, by text and unit; values are rounded to six places."""
        pid, kind, text, score, _, accepted, refused = [t[ids] for t in self.table]
        group = at * (int(self.group_of.max()) + 1) + self.group_of[pid] if len(pid) else at
        kept = self._best(group, pid, kind, text, score)
        at, pid, kind, score, accepted, refused, group = [x[kept] for x in (at, pid, kind, score, accepted, refused, group)]
        if not len(at):
            return {k: np.zeros(0) for k in ("text", "unit", "identity", "support", "negative", "exact", "score", "state")}
        of = self.kind_of[pid]
        identity = of == 0
        first = np.flatnonzero(np.diff(group, prepend=-1))
        pair = at[first] * len(self.units) + self.unit_of[pid[first]]
        start = np.flatnonzero(np.diff(pair, prepend=-1))
        add = lambda x: np.add.reduceat(np.add.reduceat(x, first), start)
        other = np.minimum(self.cap_of[pid[first]], np.add.reduceat(np.where(identity, 0.0, score), first))
        i = add(np.where(identity & accepted, score, 0.0))
        sup = add(np.where(identity & ~accepted & ~refused, np.minimum(score, 1.2), 0.0)) + np.add.reduceat(np.where(of[first] == 2, other, 0.0), start)
        neg = np.add.reduceat(np.where(of[first] == 1, other, 0.0), start)
        exact = add((self.named_of[pid] & accepted & (kind <= 1)).astype(np.int64)) > 0
        has = add((identity & accepted).astype(np.int64)) > 0
        i, neg, capped = i + np.where(exact, 4.0, 0.0), neg * np.where(exact, 0.35, 1.0), np.minimum(4.0, sup)
        net = i + capped - neg
        refuse = ((i < 3.0) & ~exact) | (net < 3.0) | ((neg >= (i + capped) * 0.70) & ~exact)
        state = np.where(has, np.where(refuse, 2, 0), np.where(sup >= 3.0, 1, 2))
        text, unit = np.divmod(pair[start], len(self.units))
        return {"text": text, "unit": unit, "identity": _signed_round(i), "support": _signed_round(capped), "negative": _signed_round(neg), "exact": exact, "score": _signed_round(net), "state": state}

    def _best(self, group: np.ndarray, pid: np.ndarray, kind: np.ndarray, text: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Places of each group's best evidence of every kind and text, of those the two best (one for negatives)."""
        first = np.diff(group, prepend=-1) != 0
        alone = first & np.append(first[1:], True)
        rest = np.flatnonzero(~alone)
        if not len(rest):
            return np.flatnonzero(alone)
        six = np.rint(score[rest] * 1e6).astype(np.int64)
        # the best of the same kind and text; phrases lie in their order, and the sort keeps it
        same = text[rest] * len(KINDS) + kind[rest]
        order = np.lexsort((-six, same, group[rest]))
        rest, six, same = rest[order], six[order], same[order]
        new = (np.diff(group[rest], prepend=-1) != 0) | (np.diff(same, prepend=-1) != 0)
        rest, six = rest[new], six[new]
        order = np.lexsort((-six, group[rest]))
        rest, six = rest[order], six[order]
        begin = np.flatnonzero(np.diff(group[rest], prepend=-1))
        size = np.diff(begin, append=len(rest))
        most = np.where(self.kind_of[pid[rest[begin]]] == 1, 1, 2)
        rank = np.arange(len(rest)) - np.repeat(begin, size)
        kept = rank < np.repeat(most, size)
        # equal scores on both sides of the cut go by text and kind
        cut = np.flatnonzero(size > most)
        for g in cut[six[begin[cut] + most[cut] - 1] == six[begin[cut] + most[cut]]].tolist():
            own = range(begin[g], begin[g] + size[g])
            name = lambda j: (-six[j], self.texts[int(text[rest[j]])].as_py(), KINDS[kind[rest[j]]])
            kept[own.start : own.stop] = False
            kept[sorted(own, key=name)[: most[g]]] = True
        return np.sort(np.append(np.flatnonzero(alone), rest[kept]))

    @staticmethod
    def ranks(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(place, rank) by text and rank from 1: candidates first, then exact ones, then by scores and unit."""
        if not len(s["text"]):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        six = lambda c: np.rint(s[c] * 1e6).astype(np.int64)
        main = ((s["text"] * 4 + 3 - 2 * (s["state"] == 0) - s["exact"]) << 32) - six("score")
        order = np.lexsort((-(six("identity") * 8_000_000 + six("support")), main))
        begin = np.flatnonzero(np.diff(s["text"][order], prepend=-1))
        return order, np.arange(1, len(order) + 1) - np.repeat(begin, np.diff(begin, append=len(order)))
