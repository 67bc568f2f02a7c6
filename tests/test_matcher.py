"""The matcher and the retrieval scores against plain loops over every text and every unit."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tutorgrain.functions import text as T
from tutorgrain.functions.text import FUNCTION_WORDS, NUMBER_WORDS, PEDAGOGY_WORDS, RETRIEVAL_STOPWORDS
from tutorgrain.operators import exchanges as X
from tutorgrain.operators import lexical as L
from tutorgrain.operators import matcher as M
from tutorgrain.operators import retrieval as R

LIBRARY = "unit_id string, canonical_name string, definition_or_summary string, topic_path array<string>, positive_profile struct<canonical_terms:array<string>,matching_cues:array<string>,likely_dialogue_surface_forms:array<string>>"
WORDS = "slope centroid NB entropy window score fold branch matrix pooled nested lagged SSE margin label cluster update purity split width".split()


def library(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(f"U{i:02}", say(2), rng.choice([None, say(9)]), [say(1)], ([say(rng.choice([1, 2, 3])) for _ in range(2)], rng.choice([None, [], [say(1), say(3)]]), [say(4)])) for i in range(14)]
    texts = [(f"q{i}", say(12)) for i in range(12)] + [("empty", ""), ("null", None)]
    return rows, texts


def norm(t):
    t = re.sub(r"([a-z])[-_]([a-z])", r"\1 \2", (t or "").lower())
    return re.sub(r"[^a-z0-9]+", " ", t).strip()


def content(t):
    drop = {*FUNCTION_WORDS, *NUMBER_WORDS, *PEDAGOGY_WORDS}
    return [w for w in norm(t).split() if len(w) >= 2 and w not in drop]


def grams(ts):
    return {" ".join(ts[i : i + n]) for n in (2, 3, 4) for i in range(len(ts) - n + 1)}


def caps(t):
    return {w.upper() for w in re.findall(r"\b[A-Za-z][A-Za-z0-9]{1,8}\b", t or "") if w.isupper()}


def plain_scores(rows, texts):
    fields = {"canonical_terms": (7.0, 8.0), "matching_cues": (5.5, 7.0), "likely_dialogue_surface_forms": (4.5, 5.5), "definition_or_summary": (0.7, 1.0)}
    reps = []
    for unit, _, definition, _, (terms, cues, forms) in rows:
        core = {t for p in [*terms, *(cues or [])] for t in content(p)}
        for field, values in (("canonical_terms", terms), ("matching_cues", cues or []), ("likely_dialogue_surface_forms", forms), ("definition_or_summary", [definition] if definition else [])):
            reps += [(unit, field, p, content(p), core) for p in values if content(p)]
    n = len({r[0] for r in reps})
    tdf, pdf = Counter(), Counter()
    for unit in {r[0] for r in reps}:
        own = [r for r in reps if r[0] == unit]
        tdf.update({t for r in own for t in r[3]})
        pdf.update({g for r in own for g in grams(r[3]) | ({" ".join(r[3]), norm(r[2])} if len(r[3]) > 1 else set())})
    spec = lambda df: math.log((n + 1) / (df + 1))
    rare = lambda t: tdf[t] <= max(2, int(0.03 * n)) or spec(tdf[t]) >= math.log(4)
    out = {}
    for key, text in texts:
        ts, nt = content(text), f" {norm(text)} "
        for unit in {r[0] for r in reps}:
            total = {"i": 0.0, "s": 0.0, "exact": False, "has": False, "any": False}
            for field, (weight, cap) in fields.items():
                found = {}
                for _, _, p, toks, core in [r for r in reps if r[0] == unit and r[1] == field]:
                    exact = f" {toks[0] if len(toks) == 1 else norm(p)} " in nt
                    acro = caps(p) & caps(text)
                    hits = sorted(((len(g.split()), spec(pdf[g]), g) for g in (grams(toks) | ({" ".join(toks)} if len(toks) > 1 else set())) & grams(ts)), reverse=True)
                    ro = {t for t in toks if t in ts and rare(t)}
                    if exact:
                        kind, mt, sp, mult = "exact", norm(p), spec(pdf[norm(p)]), 1.0
                    elif acro:
                        kind, mt, sp, mult = "acronym", ",".join(sorted(acro)), max(spec(tdf[a.lower()]) for a in acro), 0.85
                    elif hits:
                        kind, mt, sp, mult = "ngram", hits[0][2], hits[0][1], 0.55
                    elif len(ro) >= 2:
                        kind, mt, sp, mult = "set", ",".join(sorted(ro)), sum(spec(tdf[t]) for t in ro) / len(ro), 0.42
                    else:
                        continue
                    mtoks = set(content(mt))
                    ok = refused = False
                    if field == "canonical_terms" and (exact or acro):
                        if len(toks) == 1:
                            strong = len(toks[0]) >= 5 or bool(ro - {toks[0]})
                            ok, refused = rare(toks[0]) and strong, rare(toks[0]) and not strong
                        elif acro and not exact:
                            low = {a.lower() for a in acro}
                            ok = min(map(len, low)) >= 5 or bool(ro - low)
                            refused = not ok
                        else:
                            ok = True
                    elif field in ("matching_cues", "likely_dialogue_surface_forms"):
                        near = len(mtoks & core)
                        ok = (exact and len(toks) >= 2 and sp >= math.log(6)) or (kind == "ngram" and len(mtoks) >= 3 and sp >= math.log(10) and (near >= 2 or len(ro) >= 3)) or (kind == "set" and len(ro) >= 3 and sp >= math.log(8) and near >= 2)
                    score = round(weight * mult * max(0.6, min(1.35, sp / math.log(4))), 6)
                    k = (kind, mt)
                    if k not in found or score > found[k][0]:
                        found[k] = (score, ok, refused, kind, mt)
                top = sorted(found.values(), key=lambda e: (-e[0], e[4], e[3]))[:2]
                total["any"] |= bool(top)
                if field == "definition_or_summary":
                    total["s"] += min(cap, sum(e[0] for e in top))
                    continue
                for score, ok, refused, kind, _ in top:
                    if ok:
                        total["i"] += score
                        total["has"] = True
                        total["exact"] |= field == "canonical_terms" and kind in ("exact", "acronym")
                    elif not refused:
                        total["s"] += min(score, 1.2)
            if total["any"]:
                i, s = total["i"] + 4.0 * total["exact"], min(4.0, total["s"])
                if not total["has"]:
                    state = "support_only" if total["s"] >= 3 else "reject"
                else:
                    state = "reject" if (i < 3 and not total["exact"]) or i + s < 3 else "candidate"
                out[key, unit] = (round(i, 5), round(s, 5), total["exact"], state)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matcher_equals_loops(spark, seed):
    rows, texts = library(seed)
    lib, q = spark.createDataFrame(rows, LIBRARY), spark.createDataFrame(texts, "q string, t string")
    got = {(r.q, r.unit_id): (round(r.identity_score, 5), round(r.support_score, 5), r.exact, r.state) for r in M.score_units(M.evidence(q, "q", "t", lib), "q").collect()}
    assert got == plain_scores(rows, texts)


@pytest.mark.parametrize("seed", range(2))
def test_bm25_equals_loops(spark, seed):
    rows, texts = library(seed)
    lib, q = spark.createDataFrame(rows, LIBRARY), spark.createDataFrame(texts, "q string, t string")
    toks = lambda t: [w for w in norm(t).split() if len(w) >= 2 and w not in RETRIEVAL_STOPWORDS]
    docs = {f: {} for f in R.FIELDS}
    for unit, name, definition, path, (terms, cues, forms) in rows:
        for f, v in (("canonical", [name, *terms]), ("identity", cues or []), ("dialogue_forms", forms), ("topic", path), ("support", []), ("definition", [definition] if definition else [])):
            docs[f][unit] = toks(" ".join(v))
    want = {}
    for key, text in texts:
        for unit, *_ in rows:
            score = 0.0
            for f, (weight, ceiling) in R.FIELDS.items():
                df = Counter(t for d in docs[f].values() for t in set(d))
                avg, n, d = sum(map(len, docs[f].values())) / len(rows), len(rows), docs[f][unit]
                for t in set(toks(text)):
                    if d.count(t) and df[t] / n < ceiling:
                        score += weight * math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * d.count(t) * 2.4 / (d.count(t) + 1.4 * (0.25 + 0.75 * len(d) / avg))
            if round(score, 6) > 0:
                want[key, unit] = pytest.approx(score, abs=2e-6)
    got = {(r.q, r.unit_id): r.bm25_raw for r in R.bm25(q, "q", "t", lib).collect()}
    assert got == want


def test_one_unit_library_and_fusion(spark):
    lib = spark.createDataFrame([("U", "slope", None, [], (["slope"], None, None))], LIBRARY)
    q = spark.createDataFrame([("a", "the slope"), ("b", "nothing"), ("c", None)], "q string, t string")
    assert [r.q for r in R.bm25(q, "q", "t", lib).collect()] == []  # every unit has the word: above each ceiling
    assert [(r.q, r.char_rank) for r in R.char_tfidf(q, "q", "t", lib).collect()] == [("a", 1)]
    ranks = spark.createDataFrame([("q", "u", 1), ("q", "v", 1), ("q", "v", 2), ("q", "w", None)], "q string, unit_id string, rank int")
    fused = {r.unit_id: (r.fused_rank, r.source_count) for r in R.reciprocal_rank_fusion(ranks, "q").collect()}
    assert fused == {"v": (1, 2), "u": (2, 1)}


def test_rerank_edges(spark):
    pool = spark.createDataFrame([("one", "u", 0.3, 0.9), ("same", "u", 0.5, 1.0), ("same", "v", 0.5, 1.0)], "q string, unit_id string, s double, ce double")
    assert {(r.q, r.unit_id): r.reranked for r in R.rerank(pool, "q", "s", "ce").collect()} == {("one", "u"): 0.3, ("same", "u"): 0.5, ("same", "v"): 0.5}
    assert R.final_pool(pool.limit(0), "q", "unit_id", "s").count() == 0


def test_picked_ranks_equal_joined_tables_and_move_nothing(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["slope", "slopes", "matrix", "basis", "k-means", "kernel", "row", "rank", "the", "a", "Ünïcode", "x"]
    phrase = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    units = [(f"u{i:02d}", phrase(2), phrase(5), [phrase(2)], ([phrase(2), None], [phrase(1)], [phrase(2)])) for i in range(30)]
    units += [("v1", *units[3][1:]), ("v2", None, None, None, None)]  # equal units tie, an empty one never scores
    lib = spark.createDataFrame(units, LIBRARY)
    texts = [(f"q{i}", phrase(rng.randint(1, 9)), phrase(rng.randint(0, 9))) for i in range(40)] + [("none", None, None), ("blank", "  ", ""), ("odd", "the \t zzz qqq", "slope\nslope slope"), ("long", phrase(3000), "slope " * 2000)]
    q = spark.createDataFrame(texts, "q string, student_text string, tutor_text string").withColumn("combined_text", F.concat_ws(" ", "student_text", "tutor_text"))
    made = {
        "bm25": lambda: R.bm25_top(q, "q", "combined_text", lib, 7), "char": lambda: R.char_top(q, "q", "student_text", lib, 7),
        "fused": lambda: R.fused_top(q, "q", "combined_text", lib, 12, 5), "hybrid": lambda: R.hybrid_top(q, "q", lib, 8),
    }
    plain = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    for name, make in made.items():
        df = make()
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString(), name
        with monkeypatch.context() as m:
            m.setattr(R, "_indexes", lambda *_: None)
            joined = make()
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in joined.schema], name
        got = plain(df)
        assert got and got == plain(joined.select(df.columns)), name


RICH = (
    "unit_id string, canonical_name string, definition_or_summary string, topic_path array<string>, source_hierarchy_path array<string>, negative_profile struct<sibling_kc_names:array<string>,near_miss_or_gap_context:array<string>>, context_profile struct<leaf_topic:string>, "
    "positive_profile struct<canonical_terms:array<string>,matching_cues:array<string>,likely_dialogue_surface_forms:array<string>,formula_or_symbol_forms:array<string>>"
)


def rich_library():
    """Units with every kind of field, more rare tokens than one number holds, repeated phrases and equal scores."""
    rng = random.Random(9)
    vocabulary = ["slope", "matrix", "k-means", "NB", "X1", "SSE of", "the fold", "row", "IT", "prune", "leaf", "two", "depth", "basis", "of", "Ünï", "gain", "SVM"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    some = lambda n, m: rng.choice([None, [], [say(rng.randint(1, m)) for _ in range(n)], [say(rng.randint(1, m)) for _ in range(n)]])
    units = []
    for i in range(40):
        cues = some(5, 4)
        long = f"word{i} " + " ".join(f"word{rng.randint(0, 500)}" for _ in range(rng.choice([0, 20, 150])))
        units.append((f"u{i:02d}", say(2), rng.choice([None, say(9), long]), [say(2)], rng.choice([None, [say(2)]]), (some(3, 3), some(1, 5)), (rng.choice([None, say(2)]),), (some(2, 3), cues and [*cues, cues[0]], some(4, 6), some(3, 2))))
    units += [("v1", *units[3][1:]), ("v2", None, None, None, None, None, None, None)]
    text = lambda: " ".join(rng.choice([say(3), f"word{rng.randint(0, 500)}"]) for _ in range(rng.randint(1, 12)))
    texts = [(f"q{i}", text(), text()) for i in range(150)] + [("none", None, None), ("blank", "  ", ""), ("odd", "the \t zzz", "slope\nslope"), (None, text(), text())]
    texts += [(f"w{i}", " ".join(f"word{rng.randint(0, 500)}" for _ in range(200)), units[i][2]) for i in range(9)]
    return units, texts


def rich_frames(spark):
    units, texts = rich_library()
    q = spark.createDataFrame(texts, "q string, student_text string, tutor_text string")
    return spark.createDataFrame(units, RICH), q.withColumn("combined_text", F.concat_ws(" ", "student_text", "tutor_text"))


def rounded(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def equals_joined(monkeypatch, make):
    df = make()
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    with monkeypatch.context() as m:
        m.setattr(M, "phrasebook", lambda _: None)
        joined = make()
        want = rounded(joined.select(df.columns))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in joined.schema]
    got = rounded(df)
    assert got and got == want


def test_hierarchical_fusion_moves_nothing(spark, monkeypatch):
    lib, q = rich_frames(spark)
    equals_joined(monkeypatch, lambda: R.hierarchical_top(q, "q", lib, 9, 6))


@pytest.mark.parametrize("top", [4, 1000])
def test_ranked_units_move_nothing(spark, monkeypatch, top):
    lib, q = rich_frames(spark)
    equals_joined(monkeypatch, lambda: M.ranked_units(q, "q", "combined_text", lib, top))


def test_evidence_moves_nothing(spark, monkeypatch):
    lib, q = rich_frames(spark)
    for view in ("combined_text", "tutor_text"):
        equals_joined(monkeypatch, lambda: M.evidence(q, "q", view, lib))


def test_char_scores_at_every_white_space_and_in_long_texts(spark, monkeypatch):
    # words part at Spark's white space only; a text beyond the words counted at once scores as a short one does
    said = {"tab": "slope\tNB", "page": "slope\x0bNB\x0c\r\nslope", "wide": "slope\u2003NB slope\u00a0NB", "long": "slope NB fold " * 9 + "matrix", "none": " \n", "null": None}
    lib, q = spark.createDataFrame(library(2)[0], LIBRARY), spark.createDataFrame(list(said.items()), "q string, t string")
    want = R.char_tfidf(q, "q", "t", lib).where("char_rank <= 6").collect()
    for words in (10_000, 7):
        monkeypatch.setattr(L, "WORDS", words)
        assert sorted(map(tuple, R.char_top(q, "q", "t", lib, 6).collect())) == sorted(map(tuple, want))
        found = R._indexes(lib, "c")[1][0]
        lengths = found.score(L.words_of(pa.array(["slope NB fold " * 9 + "matrix", "slope"])))
        assert (lengths[1] == found.score([[b"slope"]])[0]).all() and (lengths[0] > 0).any()


def test_one_speakers_texts_keep_all_runs(spark):
    rows = [
        (1, "a", "a::t_0000", "student", "  slope\t fold "), (2, "a", "a::t_0001", "Tutor", "yes"), (3, "a", "a::t_0001", "student", "later row"), (4, None, "a::t_0002", "user", "NB\r\n\n\n\nfold\u00a0"),
        (5, "a", "a::t_0003", "learner", None), (6, "a", "a::t_0004", None, "noise"), (7, "b", "b::t_0007", "tutor", "alone"), (8, "b", "b::none", "student", "no number"),
    ]
    rows = spark.createDataFrame(rows, "row_id long, dialogue_id string, turn_id string, role string, text string")
    kept = lambda turns: X.run_exchanges(turns).drop("tutor_text", "status", "flags").orderBy("exchange_id")
    one = kept(X.dialogue_turns(rows, spoken_by="student"))
    assert one.collect() == kept(X.dialogue_turns(rows)).collect() and one.count() == 4
    # one shuffle brings a dialogue together, and nothing of another speaker's text goes through it
    plan = X.run_exchanges(X.dialogue_turns(rows, spoken_by="student")).select("exchange_id", "student_text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_normal_texts_skip_no_change(spark):
    ends = ["", " ", "\t", "\n", "\r", "\r\n", "\x0b", "\x0c", "\u00a0", "\u0085", "\u2028", "\u2029", "\n\n\n", "  ", " \u2028", "\u00a0\u0085", "\u2003", "\x01"]
    texts = [a + "slope" + m + "fold" + z for a in ends for m in ("", " ", "\n \n", "\r", "\n\n\n\n", "\t", "  ", "\u00a0") for z in ends] + [None, *ends]
    plain = F.regexp_replace(F.coalesce("t", F.lit("")), "\r\n?", "\n")
    plain = T.strip(F.regexp_replace(F.regexp_replace(plain, "[ \t]+", " "), "\n{3,}", "\n\n"))
    df = spark.createDataFrame([(t,) for t in texts], "t string").unionByName(spark.range(1).select(F.expr("CAST(X'61FF62' AS STRING)").alias("t")))
    assert df.where(~T.normalize_text(F.col("t")).eqNullSafe(plain)).count() == 0
