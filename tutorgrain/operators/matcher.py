"""Profile-native matching of dialogue texts against library phrases.

Instead of comparing every text with every phrase, both sides are turned into keys (n-grams, acronyms, rare tokens,
single-token phrases) and met on them; a phrase that shares no key cannot give evidence. A small library's phrases go to
the texts as a phrasebook, and evidence is found, judged, saturated and ranked in Arrow batches without a shuffle; a
larger library's keys are joined, and evidence is summed per (text, unit) with two small windows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from tutorgrain.functions import text as T
from tutorgrain.operators import lexical as L
from tutorgrain.operators import phrasebook as P

# fixed values: weight and cap of each field, by kind of evidence
IDENTITY = {"canonical_terms": (7.0, 8.0), "matching_cues": (5.5, 7.0), "likely_dialogue_surface_forms": (4.5, 5.5), "formula_or_symbol_forms": (6.5, 7.5)}
SUPPORT = {"matched_surface_terms_from_evidence": (3.2, 4.0), "child_surface_terms": (1.8, 2.0), "definition_or_summary": (0.7, 1.0), "leaf_topic": (0.6, 0.8)}
NEGATIVE = {"sibling_kc_names": (5.5, 7.5), "sibling_contrast_notes": (3.4, 4.5), "near_miss_or_gap_context": (2.5, 3.0)}
SHORT = 5


def phrases(library: DataFrame) -> DataFrame:
    """(unit_id, field, kind, weight, cap, phrase_no, norm, tokens, grams, acronyms, core) of every library phrase.

    Fields come from ``positive_profile``, ``negative_profile`` and ``context_profile`` where the library has them.
    """
    have = {f.name: f.dataType for f in library.schema.fields}

    def values(field: str) -> Column | None:
        for parent in ("positive_profile", "negative_profile", "context_profile"):
            if parent in have and field in [x.name for x in have[parent].fields]:
                c = F.col(f"{parent}.{field}")
                return c if parent != "context_profile" else F.array(c)
        return F.array(field) if field in have else None

    cells = []
    for kind, fields in (("identity", IDENTITY), ("support", SUPPORT), ("negative", NEGATIVE)):
        for field, (weight, cap) in fields.items():
            if (v := values(field)) is not None:
                cells.append(F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"), F.lit(cap).alias("cap"), F.coalesce(v.cast("array<string>"), F.array().cast("array<string>")).alias("v")))
    none = F.array().cast("array<string>")
    named = F.concat(*[F.coalesce(v, none) for f in ("canonical_terms", "matching_cues") if (v := values(f)) is not None], F.coalesce(F.col("source_hierarchy_path"), none) if "source_hierarchy_path" in have else none)
    rows = library.select("unit_id", T.content_tokens(F.array_join(named, " ")).alias("core"), F.explode(F.array(*cells)).alias("c"))
    rows = rows.select("unit_id", "core", "c.field", "c.kind", "c.weight", "c.cap", F.posexplode("c.v").alias("phrase_no", "phrase"))
    rows = rows.where("trim(phrase) <> ''").withColumn("tokens", T.content_tokens(F.col("phrase"))).where("size(tokens) > 0")
    grams = F.when(F.size("tokens") >= 2, F.array_distinct(F.concat(T.ngrams(F.col("tokens")), F.array(F.array_join("tokens", " "))))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("norm", T.match_normal(F.col("phrase"))).withColumn("grams", grams).withColumn("acronyms", T.acronyms(F.col("phrase")))


def specificity_tables(reps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(token, df), (phrase, df) and (units): document frequencies over distinct tokens and phrases per unit."""
    tokens = reps.select("unit_id", F.explode("tokens").alias("token")).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    grams = reps.select("unit_id", F.explode(F.when(F.size("tokens") >= 2, F.concat("grams", F.array("norm"))).otherwise(F.col("grams"))).alias("phrase"))
    grams = grams.distinct().groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    return tokens, grams, reps.agg(F.greatest(F.count_distinct("unit_id"), F.lit(1)).alias("units"))


def specificity(df: Column, units: Column) -> Column:
    return F.ln((units + 1) / (F.coalesce(df, F.lit(0)) + 1))


def is_rare(df: Column, units: Column) -> Column:
    return (F.coalesce(df, F.lit(0)) <= F.greatest(F.lit(2), F.floor(units * 0.03))) | (specificity(df, units) >= math.log(4.0))


EVIDENCE = [types.StructField(n, t) for n, t in (
    ("unit_id", types.StringType()), ("field", types.StringType()), ("kind", types.StringType()), ("cap", types.DoubleType()), ("phrase_no", types.IntegerType()), ("match_kind", types.StringType()),
    ("matched_text", types.StringType()), ("score", types.DoubleType()), ("specificity", types.DoubleType()), ("accepted", types.BooleanType()), ("short_reject", types.BooleanType()),
)]


def phrasebook(library: DataFrame) -> P.Phrasebook | None:
    """The library's phrases for Arrow batches; None if they are many, or if their unit ids are repeated or no strings."""
    if library.schema["unit_id"].dataType != types.StringType():
        return None
    wanted = ("unit_id", "field", "kind", "weight", "cap", "phrase_no", "norm", "tokens", "acronyms", "core")
    rows = phrases(library).select(*wanted).limit(P.PHRASES + 1).toArrow().to_pylist()
    places = {(r["unit_id"], r["field"], r["phrase_no"]) for r in rows}
    if not 0 < len(rows) <= P.PHRASES or len(places) < len(rows) or any(r["unit_id"] is None for r in rows):
        return None
    units = sorted({r["unit_id"] for r in rows})
    place, u = {x: i for i, x in enumerate(units)}, F.lit(len(units))
    if len(units) > P.UNITS:
        return None
    by_df = library.sparkSession.range(len(units) + 1).select("id", specificity(F.col("id"), u).alias("s"), is_rare(F.col("id"), u).alias("r")).collect()
    by_df.sort(key=lambda r: r.id)
    found = [r | {"unit": place[r["unit_id"]], "core": set(r["core"])} for r in sorted(rows, key=lambda r: (r["unit_id"], r["field"], r["phrase_no"]))]
    book = P.Phrasebook(found, units, [r.s for r in by_df], [r.r for r in by_df], SHORT)
    return book if book.fits() else None


def asked_texts(key: str, text: str) -> list[Column]:
    """A text's columns for a phrasebook; a text without a key is an empty one."""
    said = F.when(F.col(key).isNotNull(), F.col(text))
    return [T.match_normal(said), F.array_join(T.acronyms(said), " ")]


def evidence(texts: DataFrame, key: str, text: str, library: DataFrame) -> DataFrame:
    """(key, unit_id, field, kind, cap, phrase_no, match_kind, matched_text, score, specificity, accepted, short_reject).

    Texts without a key give none.
    """
    if (book := phrasebook(library)) is None:
        return joined_evidence(texts, key, text, library)

    def pick(book: P.Phrasebook, columns: list) -> tuple:
        at, ids = book.find(*columns)
        return at, book.evidence(ids)

    return L.mapped(texts, key, asked_texts(key, text), EVIDENCE, book, pick)


def ranked_units(texts: DataFrame, key: str, text: str, library: DataFrame, top_k: int = 10) -> DataFrame:
    """:func:`rank_units` of :func:`score_units` of :func:`evidence`; a small library's units are ranked where the texts lie."""
    if (book := phrasebook(library)) is None:
        return rank_units(score_units(joined_evidence(texts, key, text, library), key), key, top_k)

    def pick(book: P.Phrasebook, columns: list) -> tuple:
        s = book.score(*book.find(*columns))
        at, rank = book.ranks(s)
        at, rank = at[rank <= top_k], rank[rank <= top_k]
        states = pa.array(P.STATE_NAMES)
        return s["text"][at], [
            pa.array(book.units).take(pa.array(s["unit"][at], pa.int64())), *[pa.array(s[c][at], pa.float64()) for c in ("identity", "support", "negative")],
            pa.array(s["exact"][at], pa.bool_()), pa.array(s["score"][at], pa.float64()), states.take(pa.array(s["state"][at], pa.int64())), pa.array(rank, pa.int32()),
        ]

    d, n = types.DoubleType(), ("identity_score", "support_score", "negative_score")
    fields = [("unit_id", types.StringType()), *[(c, d) for c in n], ("exact", types.BooleanType()), ("score", d), ("state", types.StringType()), ("rank", types.IntegerType())]
    return L.mapped(texts, key, asked_texts(key, text), [types.StructField(c, t) for c, t in fields], book, pick)


def rank_matrix(book: P.Phrasebook, columns: list, place: np.ndarray, units: int) -> np.ndarray:
    """(texts, units): ranks from 1 of the units with positive evidence, else 0; ``place`` has the book's units' places."""
    s = book.score(*book.find(*columns))
    some = (s["exact"] > 0) | (s["identity"] > 0) | (s["support"] > 0)
    s = {k: v[some] for k, v in s.items()}
    at, rank = book.ranks(s)
    out = np.zeros((len(columns[0]), units), dtype=np.int32)
    if len(at):
        out[s["text"][at], place[s["unit"][at]]] = rank
    return out


def joined_evidence(texts: DataFrame, key: str, text: str, library: DataFrame) -> DataFrame:
    """:func:`evidence` as joins of keys, for libraries of any size."""
    reps = phrases(library)
    token_df, phrase_df, units = specificity_tables(reps)
    n = units.first()[0]
    u = F.lit(n)
    reps = reps.withColumn("pid", F.struct("unit_id", "field", "phrase_no"))
    rare = token_df.select("token", "df", is_rare(F.col("df"), u).alias("rare"), specificity(F.col("df"), u).alias("spec"))
    # keys of phrases: n-grams, acronyms, and tokens that are rare or the whole phrase
    p = reps.select("pid", F.size("tokens").alias("nt"), "grams", "acronyms", "tokens")
    gram_keys = p.select("pid", F.explode("grams").alias("k")).join(phrase_df.withColumnRenamed("phrase", "k"), "k").select("pid", F.lit("g").alias("t"), "k", specificity(F.col("df"), u).alias("spec"))
    acro_keys = p.select("pid", F.explode("acronyms").alias("k")).join(token_df.withColumnRenamed("token", "w"), F.lower("k") == F.col("w"), "left").select("pid", F.lit("a").alias("t"), "k", specificity(F.col("df"), u).alias("spec"))
    token_keys = p.select("pid", "nt", F.explode(F.array_distinct("tokens")).alias("token")).join(rare, "token").where("rare OR nt = 1")
    token_keys = token_keys.select("pid", F.when(F.col("rare"), "r").otherwise("o").alias("t"), F.col("token").alias("k"), "spec")
    keys = gram_keys.unionByName(acro_keys).unionByName(token_keys)
    q = texts.select(F.col(key).alias("q"), T.match_normal(F.col(text)).alias("qn"), T.content_tokens(F.col(text)).alias("qt"), T.acronyms(F.col(text)).alias("qa"))
    asked = q.select("q", F.explode(F.array_distinct(F.concat(
        F.transform(T.ngrams(F.col("qt")), lambda g: F.struct(F.lit("g").alias("t"), g.alias("k"))),
        F.transform("qa", lambda a: F.struct(F.lit("a").alias("t"), a.alias("k"))),
        F.transform("qt", lambda w: F.struct(F.lit("r").alias("t"), w.alias("k"))),
        F.transform("qt", lambda w: F.struct(F.lit("o").alias("t"), w.alias("k"))),
    ))).alias("x")).select("q", "x.t", "x.k")
    hit = asked.join(keys, ["t", "k"]).groupBy("q", "pid").agg(
        F.array_sort(F.collect_set(F.when(F.col("t") == "a", F.col("k")))).alias("acro"),
        F.max(F.when(F.col("t") == "a", F.col("spec"))).alias("acro_spec"),
        F.max(F.when(F.col("t") == "g", F.struct(F.size(F.split("k", " ")).alias("n"), "spec", "k"))).alias("gram"),
        F.array_sort(F.collect_set(F.when(F.col("t") == "r", F.col("k")))).alias("rare"),
        F.avg(F.when(F.col("t") == "r", F.col("spec"))).alias("rare_spec"),
    )
    norm_df = phrase_df.select(F.col("phrase").alias("norm"), F.col("df").alias("norm_df"))
    full = hit.join(reps.join(norm_df, "norm", "left"), "pid").join(q.select("q", "qn"), "q")
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    one = F.size("tokens") == 1
    exact = F.when(one, F.contains(pad(F.col("qn")), pad(F.col("tokens")[0]))).otherwise(F.contains(pad(F.col("qn")), pad(F.col("norm"))))
    full = full.withColumn("exact", exact).withColumn("n_rare", F.size("rare")).withColumn("has_acro", F.size("acro") > 0)
    kind = F.when(F.col("exact"), "exact_phrase").when(F.col("has_acro"), "acronym").when(F.col("gram").isNotNull(), "ngram").when(F.col("n_rare") >= 2, "rare_token_set")
    full = full.withColumn("match_kind", kind).where("match_kind IS NOT NULL")
    pick = lambda e, a, g, r: F.when(F.col("match_kind") == "exact_phrase", e).when(F.col("match_kind") == "acronym", a).when(F.col("match_kind") == "ngram", g).otherwise(r)
    full = full.withColumn("matched_text", pick(F.col("norm"), F.array_join("acro", ","), F.col("gram.k"), F.array_join("rare", ",")))
    full = full.withColumn("spec", pick(specificity(F.col("norm_df"), u), F.col("acro_spec"), F.col("gram.spec"), F.col("rare_spec")))
    mult = pick(F.lit(1.0), F.lit(0.85), F.lit(0.55), F.lit(0.42))
    matched = F.array_distinct(T.content_tokens(F.col("matched_text")))
    core = F.size(F.array_intersect(matched, F.col("core")))
    low_acro = F.transform("acro", lambda a: F.lower(a))
    shortest = lambda c: F.array_min(F.transform(c, lambda t: F.length(t)))
    backed = lambda span: F.size(F.array_except("rare", span)) >= 1
    tok = F.col("tokens")[0]
    tok_rare = F.array_contains("rare", tok) | (F.size(F.array_intersect("rare", F.array(tok))) > 0)
    strong = F.col("exact") | F.col("has_acro")
    span = F.when(F.col("exact"), F.col("tokens")).otherwise(low_acro)
    ok_single = tok_rare & ((F.length(tok) >= SHORT) | backed(F.array(tok)))
    ok_acro = (shortest(low_acro) >= SHORT) | backed(low_acro)
    ok_span = (shortest(span) >= SHORT) | backed(span)
    named = F.col("field") == "canonical_terms"
    formula = F.col("field") == "formula_or_symbol_forms"
    cue = F.col("field").isin("matching_cues", "likely_dialogue_surface_forms")
    only_acro = F.col("has_acro") & ~F.col("exact")
    accepted = (
        F.when(F.col("kind") != "identity", False)
        .when(named, F.when(~strong, False).when(one, ok_single).when(only_acro, ok_acro).otherwise(True))
        .when(formula, F.when(strong, ok_span).otherwise(F.col("n_rare") >= 2))
        .when(cue & F.col("exact") & ~one & (F.col("spec") >= math.log(6.0)), True)
        .when(cue & (F.col("match_kind") == "ngram"), (F.size(matched) >= 3) & (F.col("spec") >= math.log(10.0)) & ((core >= 2) | (F.col("n_rare") >= 3)))
        .when(cue & (F.col("match_kind") == "rare_token_set"), (F.col("n_rare") >= 3) & (F.col("spec") >= math.log(8.0)) & (core >= 2))
        .otherwise(False)
    )
    refused = (F.col("kind") == "identity") & (
        (named & strong & one & tok_rare & ~ok_single) | (named & ~one & only_acro & ~ok_acro) | (formula & strong & ~ok_span)
    )
    score = F.round(F.col("weight") * mult * F.greatest(F.lit(0.60), F.least(F.lit(1.35), F.col("spec") / max(math.log(4.0), 1.0))), 6)
    return full.select(
        F.col("q").alias(key), "unit_id", "field", "kind", "cap", "phrase_no", "match_kind", "matched_text", score.alias("score"), F.round("spec", 6).alias("specificity"),
        F.coalesce(accepted, F.lit(False)).alias("accepted"), F.coalesce(refused, F.lit(False)).alias("short_reject"),
    )


def score_units(found: DataFrame, key: str) -> DataFrame:
    """(key, unit_id, identity_score, support_score, negative_score, exact, score, state): profile scores and gates.

    Per field the best evidence of each (kind, text) counts, of those the two best (one for negatives).
    """
    same = Window.partitionBy(key, "unit_id", "field", "match_kind", "matched_text").orderBy(F.col("score").desc(), "phrase_no")
    best = found.withColumn("k", F.row_number().over(same)).where("k = 1")
    field = Window.partitionBy(key, "unit_id", "field").orderBy(F.col("score").desc(), "matched_text", "match_kind")
    best = best.withColumn("k", F.row_number().over(field)).where(F.col("k") <= F.when(F.col("kind") == "negative", 1).otherwise(2))
    identity = F.col("kind") == "identity"
    per_field = best.groupBy(key, "unit_id", "field", "kind", "cap").agg(
        F.sum(F.when(identity & F.col("accepted"), F.col("score"))).alias("i"),
        F.sum(F.when(identity & ~F.col("accepted") & ~F.col("short_reject"), F.least("score", F.lit(1.2)))).alias("fallback"),
        F.least(F.first("cap"), F.sum(F.when(~identity, F.col("score")))).alias("s"),
        F.bool_or(identity & F.col("accepted")).alias("has_identity"), F.bool_or(~F.col("accepted")).alias("has_other"),
        F.bool_or((F.col("field") == "canonical_terms") & F.col("accepted") & F.col("match_kind").isin("exact_phrase", "acronym")).alias("exact"),
    )
    z = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    unit = per_field.groupBy(key, "unit_id").agg(
        z(F.col("i")).alias("i"), (z(F.col("fallback")) + z(F.when(F.col("kind") == "support", F.col("s")))).alias("sup"),
        z(F.when(F.col("kind") == "negative", F.col("s"))).alias("neg"), F.bool_or("exact").alias("exact"), F.bool_or("has_identity").alias("has_identity"),
    )
    i, neg = F.col("i") + F.when(F.col("exact"), 4.0).otherwise(0.0), F.col("neg") * F.when(F.col("exact"), 0.35).otherwise(1.0)
    capped = F.least(F.lit(4.0), F.col("sup"))
    net = i + capped - neg
    state = (
        F.when(~F.col("has_identity") & (F.col("sup") >= 3.0), "support_only").when(~F.col("has_identity"), "reject")
        .when((i < 3.0) & ~F.col("exact"), "reject").when(net < 3.0, "reject")
        .when((neg >= (i + capped) * 0.70) & ~F.col("exact"), "reject").otherwise("candidate")
    )
    return unit.select(key, "unit_id", F.round(i, 6).alias("identity_score"), F.round(capped, 6).alias("support_score"), F.round(neg, 6).alias("negative_score"), "exact", F.round(net, 6).alias("score"), state.alias("state"))


def rank_units(scored: DataFrame, key: str, top_k: int = 10) -> DataFrame:
    order = Window.partitionBy(key).orderBy((F.col("state") == "candidate").desc(), F.col("exact").desc(), F.col("score").desc(), F.col("identity_score").desc(), F.col("support_score").desc(), "unit_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
