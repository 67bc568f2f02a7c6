"""Retrieval of library units for dialogue texts: fielded BM25, character TF-IDF, dense similarity, fusion, reranking.

Everything is a token join on postings followed by one aggregation per (query, unit); no query meets a unit with which
it shares nothing. Postings and document frequencies are tables, so Spark decides by their size how to join them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from tutorgrain.functions import text as T
from tutorgrain.operators import lexical as L
from tutorgrain.operators import matcher as M

# fixed values: weight and document-frequency ceiling of each field, and the constants of the scores
FIELDS = {"canonical": (2.8, 0.65), "identity": (2.4, 0.65), "dialogue_forms": (1.6, 0.55), "topic": (1.0, 0.50), "support": (0.9, 0.50), "definition": (0.55, 0.45)}
K1, B, RRF_K, FAMILY_CUTOFF, CE_WEIGHT = 1.4, 0.75, 11, 25, 0.55


def _present(df: DataFrame, path: str) -> Column:
    """A list field of the library as a non-null array; nulls inside and blanks dropped."""
    return F.filter(F.coalesce(F.col(path), F.array().cast("array<string>")), lambda x: F.trim(x) != "")


def library_fields(library: DataFrame) -> DataFrame:
    """(unit_id, field, phrases): the retrieval fields of every unit; a field a library lacks is empty."""
    none = F.array().cast("array<string>")
    one = lambda c: F.filter(F.array(F.coalesce(F.col(c), F.lit(""))), lambda x: F.trim(x) != "")
    parts = {
        "canonical": F.concat(one("canonical_name"), _present(library, "positive_profile.canonical_terms")),
        "identity": _present(library, "positive_profile.matching_cues"),
        "dialogue_forms": _present(library, "positive_profile.likely_dialogue_surface_forms"),
        "topic": _present(library, "topic_path"),
        "support": none,
        "definition": one("definition_or_summary"),
    }
    cells = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("phrases")) for k, v in parts.items()])
    return library.select("unit_id", F.explode(cells).alias("x")).select("unit_id", "x.field", "x.phrases")


def postings(library: DataFrame) -> DataFrame:
    """(field, token, unit_id, gain): what one query token adds to a unit's BM25 score.

    Average lengths count empty documents; tokens at or above their field's frequency ceiling are dropped.
    """
    docs = library_fields(library).withColumn("tokens", T.retrieval_tokens(F.array_join("phrases", " ")))
    docs = docs.withColumn("dl", F.size("tokens"))
    per_field = docs.groupBy("field").agg(F.avg("dl").alias("avgdl"), F.count(F.lit(1)).alias("units"))
    tf = docs.select("field", "unit_id", "dl", F.explode("tokens").alias("token")).groupBy("field", "unit_id", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("field", "token").agg(F.count(F.lit(1)).alias("df"))
    weights = docs.sparkSession.createDataFrame([(k, w, c) for k, (w, c) in FIELDS.items()], "field string, weight double, ceiling double")
    joined = tf.join(df, ["field", "token"]).join(per_field, "field").join(weights, "field")
    idf = F.ln((F.col("units") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    gain = F.col("weight") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return joined.where(F.col("df") / F.col("units") < F.col("ceiling")).select("field", "token", "unit_id", gain.alias("gain"))


SMALL_SIDE = 2_000_000  # postings up to this number are broadcast; larger ones are joined by shuffling both sides


def _by_query(asked: DataFrame, side: DataFrame, on: str) -> DataFrame:
    """``asked`` joined with postings so that a query's rows stay together if the postings are few.

    Counted first: few postings are broadcast to query tokens that lie by query, so scoring, normalising and ranking
    need no further shuffle of (query, unit) rows.
    """
    if side.limit(SMALL_SIDE + 1).count() > SMALL_SIDE:
        return asked.join(side, on)
    return asked.repartition("q").join(F.broadcast(side), on)


def bm25(queries: DataFrame, key: str, text: str, library: DataFrame) -> DataFrame:
    """(key, unit_id, bm25_raw, bm25_score, bm25_rank): every unit with a positive score, ranked within the query.

    Scores are rounded to six places before ranking, ties go to the lower unit id; null and empty queries give no rows.
    """
    asked = queries.select(F.col(key).alias("q"), F.explode(F.array_distinct(T.retrieval_tokens(F.col(text)))).alias("token"))
    raw = _by_query(asked, postings(library), "token").groupBy("q", "unit_id").agg(F.round(F.sum("gain"), 6).alias("bm25_raw"))
    per_query = Window.partitionBy("q")
    return raw.where("bm25_raw > 0").select(
        F.col("q").alias(key), "unit_id", "bm25_raw",
        F.round(F.col("bm25_raw") / F.max("bm25_raw").over(per_query), 6).alias("bm25_score"),
        F.row_number().over(per_query.orderBy(F.col("bm25_raw").desc(), "unit_id")).alias("bm25_rank"),
    )


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of each word padded with one blank on both sides; a shorter word comes once as it is."""
    padded = F.transform(T.words(F.lower(F.coalesce(text, F.lit("")))), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column, n: int) -> Column:
        size = F.length(w)
        sliding = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))
        # a word not longer than n is emitted whole, once: for the first n that reaches its length
        first = (F.lit(n) == low) if n == low else (size > n - 1)
        return F.when(size >= n, sliding).when(first, F.array(w)).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(padded, lambda w: F.flatten(F.array(*[of(w, n) for n in range(low, high + 1)]))))


def char_postings(library: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, idf), and (gram, unit_id, idf, u): the units' character TF-IDF vectors of unit length."""
    order = list(FIELDS)
    place = F.array_position(F.array(*map(F.lit, order)), F.col("field"))
    docs = library_fields(library).groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.array_join("phrases", " \n ").alias("x")))).alias("parts"))
    docs = docs.select("unit_id", F.explode(char_grams(F.array_join(F.transform("parts", lambda p: p.x), " \n "))).alias("gram"))
    tf = docs.groupBy("unit_id", "gram").agg(F.count(F.lit(1)).alias("tf"))
    total = library.select("unit_id").distinct().agg(F.count(F.lit(1)).alias("units"))
    df = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total))  # one row
    idf = df.select("gram", (F.ln((1 + F.col("units")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = tf.join(idf, "gram").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("unit_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return idf, weighted.join(norms, "unit_id").select("gram", "unit_id", "idf", (F.col("w") / F.col("norm")).alias("u"))


def char_tfidf(queries: DataFrame, key: str, text: str, library: DataFrame) -> DataFrame:
    """(key, unit_id, char_score, char_rank): cosine of character TF-IDF vectors, units with a positive score.

    Smooth idf over the library, queries use the library's vocabulary only, both sides have unit length.
    """
    idf, units = char_postings(library)
    asked = queries.select(F.col(key).alias("q"), F.explode(char_grams(F.col(text))).alias("gram")).groupBy("q", "gram").agg(F.count(F.lit(1)).alias("tf"))
    asked = asked.join(idf, "gram").withColumn("w", F.col("tf") * F.col("idf"))
    lengths = asked.groupBy("q").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scored = _by_query(asked, units.drop("idf"), "gram").groupBy("q", "unit_id").agg(F.sum(F.col("w") * F.col("u")).alias("dot")).join(lengths, "q")
    scored = scored.select("q", "unit_id", F.round(F.col("dot") / F.col("norm"), 6).alias("char_score")).where("char_score > 0")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("char_score").desc(), "unit_id"))
    return scored.select(F.col("q").alias(key), "unit_id", "char_score", rank.alias("char_rank"))


def _indexes(library: DataFrame, kinds: str) -> tuple[list, tuple[L.Index, ...]] | None:
    """The sorted units and the indexes of a library: ``b`` for BM25, ``c`` for characters; None if it is a large one."""
    units = library.select("unit_id").distinct().limit(L.INDEX_UNITS + 1).toArrow().column(0).to_pylist()
    if len(units) > L.INDEX_UNITS or None in units:
        return None
    units.sort()
    out = []
    for kind in kinds:
        rows = L.collected(postings(library).select("token", "unit_id", "gain") if kind == "b" else char_postings(library)[1])
        if rows is None:
            return None
        out.append(L.index_of(rows, units, "token", "gain") if kind == "b" else L.index_of(rows, units, "gram", "u", "idf", (3, 4, 5)))
    return units, tuple(out)


def _query_words(text: str, kind: str) -> Column:
    """A text's words for an index, divided by white space."""
    return T.match_normal(F.col(text), True) if kind == "b" else F.lower(F.coalesce(F.col(text), F.lit("")))


def _cells(rank: np.ndarray, *values: np.ndarray) -> tuple:
    """(texts, units, columns) of the places with a rank, in its order."""
    text, unit = np.nonzero(rank)
    order = np.lexsort((rank[text, unit], text))
    text, unit = text[order], unit[order]
    return text, unit, [pa.array(v[text, unit]) for v in (*values, rank)]


def bm25_top(queries: DataFrame, key: str, text: str, library: DataFrame, k: int) -> DataFrame:
    """The rows of :func:`bm25` up to rank ``k``; a small library's are picked where the texts lie."""
    if (known := _indexes(library, "b")) is None:
        return bm25(queries, key, text, library).where(F.col("bm25_rank") <= k)

    def pick(indexes: tuple, words: list) -> tuple:
        raw = indexes[0].score(words[0])
        share = L.round_half_up(raw / np.maximum(raw.max(axis=1), 1e-300)[:, None], 6)
        return _cells(L.first_ranks(raw, k), raw, share)

    kinds = [("bm25_raw", types.DoubleType()), ("bm25_score", types.DoubleType()), ("bm25_rank", types.IntegerType())]
    return L.rows_of(queries, key, [_query_words(text, "b")], library.schema["unit_id"], *known, pick, kinds)


def char_top(queries: DataFrame, key: str, text: str, library: DataFrame, k: int) -> DataFrame:
    """The rows of :func:`char_tfidf` up to rank ``k``; a small library's are picked where the texts lie."""
    if (known := _indexes(library, "c")) is None:
        return char_tfidf(queries, key, text, library).where(F.col("char_rank") <= k)

    def pick(indexes: tuple, words: list) -> tuple:
        score = indexes[0].score(words[0])
        return _cells(L.first_ranks(score, k), score)

    kinds = [("char_score", types.DoubleType()), ("char_rank", types.IntegerType())]
    return L.rows_of(queries, key, [_query_words(text, "c")], library.schema["unit_id"], *known, pick, kinds)


def fused_top(queries: DataFrame, key: str, text: str, library: DataFrame, cut: int, top: int, k: int = RRF_K) -> DataFrame:
    """:func:`reciprocal_rank_fusion` of both indexes' first ``cut`` ranks, up to fused rank ``top``."""
    if (known := _indexes(library, "bc")) is None:
        b, c = bm25(queries, key, text, library).withColumnRenamed("bm25_rank", "rank"), char_tfidf(queries, key, text, library).withColumnRenamed("char_rank", "rank")
        ranks = b.select(key, "unit_id", "rank").unionByName(c.select(key, "unit_id", "rank")).where(F.col("rank") <= cut)
        return reciprocal_rank_fusion(ranks, key, k=k).where(F.col("fused_rank") <= top)

    def pick(indexes: tuple, words: list) -> tuple:
        score, count, best, fused = _fused([L.first_ranks(i.score(w), cut) for i, w in zip(indexes, words)], k, top)
        return _cells(fused, score, count, best)

    return L.rows_of(queries, key, [_query_words(text, "b"), _query_words(text, "c")], library.schema["unit_id"], *known, pick, FUSED)


FUSED = [("rrf_score", types.DoubleType()), ("source_count", types.LongType()), ("best_rank", types.IntegerType()), ("fused_rank", types.IntegerType())]


def _fused(ranks: list[np.ndarray], k: int, top: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score, sources, best rank, fused rank) of two sources' ranks (texts, units), where 0 is none; fused ranks up to ``top``."""
    n_units = ranks[0].shape[1]
    none = n_units + 1
    parts = [np.where(r > 0, 1.0 / (k + r), 0.0) for r in ranks]
    score = L.round_half_up(parts[0] + parts[1], 9)
    count = (ranks[0] > 0).astype(np.int64) + (ranks[1] > 0)
    best = np.minimum(*[np.where(r > 0, r, none) for r in ranks])
    # one number per unit in the order of score, sources, best rank and unit
    place = ((np.rint(-score * 1e9).astype(np.int64) * 3 - count) * (none + 1) + best) * n_units + np.arange(n_units)
    order = np.argsort(place, axis=1)[:, :top]
    fused = np.zeros(score.shape, dtype=np.int32)
    np.put_along_axis(fused, order, np.arange(1, order.shape[1] + 1, dtype=np.int32)[None, :], axis=1)
    fused[count == 0] = 0
    return score, count, best.astype(np.int32), fused


def hierarchical_top(queries: DataFrame, key: str, library: DataFrame, cut: int = 40, top: int = 10, k: int = RRF_K) -> DataFrame:
    """:func:`hierarchical_fusion` of the profile ranks of ``student_text`` and ``tutor_text`` and both indexes' first ``cut`` ranks of ``combined_text``."""
    known, book = _indexes(library, "bc"), M.phrasebook(library)
    if known is None or book is None:
        profile = []
        for view in ("student_text", "tutor_text"):
            positive = M.score_units(M.evidence(queries, key, view, library), key).where("exact OR identity_score > 0 OR support_score > 0")
            profile.append(M.rank_units(positive, key, 10**9).select(key, "unit_id", "rank"))
        lexical = [bm25_top(queries, key, "combined_text", library, cut).withColumnRenamed("bm25_rank", "rank"), char_top(queries, key, "combined_text", library, cut).withColumnRenamed("char_rank", "rank")]
        return hierarchical_fusion({"profile": profile, "lexical": lexical}, key, k=k).where(F.col("fused_rank") <= top)
    units, indexes = known
    at = {u: i for i, u in enumerate(units)}
    place = np.array([at[u] for u in book.units])

    def pick(known: tuple, columns: list) -> tuple:
        labels, indexes, book, place = known
        profile = [M.rank_matrix(book, columns[i : i + 2], place, len(labels)) for i in (0, 2)]
        lexical = [L.first_ranks(i.score(L.words_of(c)), cut) for i, c in zip(indexes, columns[4:])]
        score, count, best, fused = _fused([_fused(of, k)[3] for of in (profile, lexical)], k, top)
        text, unit, values = _cells(fused, score, count, best)
        return text, [labels.take(pa.array(unit)), *values]

    columns = [*M.asked_texts(key, "student_text"), *M.asked_texts(key, "tutor_text"), _query_words("combined_text", "b"), _query_words("combined_text", "c")]
    fields = [types.StructField(n, t) for n, t in (("unit_id", library.schema["unit_id"].dataType), *FUSED)]
    return L.mapped(queries, key, columns, fields, (pa.array(units), indexes, book, place), pick)


def hybrid_top(queries: DataFrame, key: str, library: DataFrame, top_k: int = 40) -> DataFrame:
    """:func:`merge_views` of the texts' views ``student_text``, ``tutor_text`` and ``combined_text`` in both indexes."""
    views = ("student", "tutor", "combined")
    if (known := _indexes(library, "bc")) is None:
        both = []
        for index in (bm25, char_tfidf):
            parts = [index(queries, key, f"{v}_text", library).withColumn("view", F.lit(v)) for v in views]
            both.append(parts[0].unionByName(parts[1]).unionByName(parts[2]))
        return merge_views(*both, key, top_k)

    def pick(indexes: tuple, words: list) -> tuple:
        raw = [indexes[0].score(w) for w in words[:3]]
        bs, bt, bc = [L.round_half_up(x / np.maximum(x.max(axis=1), 1e-300)[:, None], 6) for x in raw]
        cs, ct, cc = char = [indexes[1].score(w) for w in words[3:]]
        none = 2**30
        # beyond top_k a rank only says that it is there: ranks of all positive scores, as the least of the views is shown
        b_rank, c_rank = [np.minimum.reduce([np.where(r > 0, r, none) for r in (L.first_ranks(x, x.shape[1]) for x in of)]) for of in (raw, char)]
        bm, ch = np.maximum.reduce([bs * 1.25, bt * 0.75, bc]), np.maximum.reduce([cs * 1.15, ct * 0.65, cc])
        agree = (bm >= 0.20).astype(np.int32) + (ch >= 0.12) + ((bs >= 0.12) | (cs >= 0.08))
        single = ((bm > 0) & (ch == 0)) | ((ch > 0) & (bm == 0))
        hybrid = L.round_half_up((0.65 * bm + 0.35 * ch) * np.where(single & (agree <= 1), 0.70, 1.0), 6)
        inside = np.minimum(b_rank, c_rank) <= top_k
        # one number per unit in the order of score, agreement and unit, those outside last
        place = (np.rint(-np.where(inside, hybrid, -1.0) * 1e6).astype(np.int64) * 4 - agree) * hybrid.shape[1] + np.arange(hybrid.shape[1])
        order = np.argsort(place, axis=1)[:, :top_k]
        rank = np.zeros(hybrid.shape, dtype=np.int32)
        np.put_along_axis(rank, order, np.arange(1, order.shape[1] + 1, dtype=np.int32)[None, :], axis=1)
        rank[~inside] = 0
        text, unit, columns = _cells(rank, bm, ch, hybrid, agree, b_rank, c_rank)
        for i in (0, 1):
            columns[i] = pa.array(L.round_half_up(columns[i].to_numpy(), 6))
        for i in (4, 5):
            x = columns[i].to_numpy()
            columns[i] = pa.array(x.astype(np.int32), mask=x == none)
        return text, unit, columns

    kinds = [(n, types.DoubleType()) for n in ("bm25_score", "char_score", "hybrid_score")] + [(n, types.IntegerType()) for n in ("agreement", "bm25_rank", "char_rank", "hybrid_rank")]
    return L.rows_of(queries, key, [_query_words(f"{v}_text", k) for k in "bc" for v in views], library.schema["unit_id"], *known, pick, kinds)


def merge_views(bm25_rows: DataFrame, char_rows: DataFrame, key: str, top_k: int = 40) -> DataFrame:
    """The student, tutor and combined views of both indexes as one hybrid ranking.

    Inputs have a column ``view``. One union and one aggregation replace six outer joins.
    """
    b = bm25_rows.select(key, "view", "unit_id", F.col("bm25_score").alias("b"), F.col("bm25_rank").alias("rank"), F.lit("b").alias("src"))
    c = char_rows.select(key, "view", "unit_id", F.col("char_score").alias("b"), F.col("char_rank").alias("rank"), F.lit("c").alias("src"))

    def score(src: str, view: str) -> Column:
        return F.coalesce(F.max(F.when((F.col("src") == src) & (F.col("view") == view), F.col("b"))), F.lit(0.0))

    m = b.unionByName(c).groupBy(key, "unit_id").agg(
        score("b", "student").alias("bs"), score("b", "tutor").alias("bt"), score("b", "combined").alias("bc"),
        score("c", "student").alias("cs"), score("c", "tutor").alias("ct"), score("c", "combined").alias("cc"),
        F.min("rank").alias("best"), F.min(F.when(F.col("src") == "b", F.col("rank"))).alias("bm25_rank"), F.min(F.when(F.col("src") == "c", F.col("rank"))).alias("char_rank"),
    ).where(F.col("best") <= top_k)
    bm, ch = F.greatest(F.col("bs") * 1.25, F.col("bt") * 0.75, F.col("bc")), F.greatest(F.col("cs") * 1.15, F.col("ct") * 0.65, F.col("cc"))
    agree = (bm >= 0.20).cast("int") + (ch >= 0.12).cast("int") + ((F.col("bs") >= 0.12) | (F.col("cs") >= 0.08)).cast("int")
    single = ((bm > 0) & (ch == 0)) | ((ch > 0) & (bm == 0))
    hybrid = (0.65 * bm + 0.35 * ch) * F.when(single & (agree <= 1), 0.70).otherwise(1.0)
    out = m.select(key, "unit_id", F.round(bm, 6).alias("bm25_score"), F.round(ch, 6).alias("char_score"), F.round(hybrid, 6).alias("hybrid_score"), agree.alias("agreement"), "bm25_rank", "char_rank")
    order = Window.partitionBy(key).orderBy(F.col("hybrid_score").desc(), F.col("agreement").desc(), "unit_id")
    return out.withColumn("hybrid_rank", F.row_number().over(order)).where(F.col("hybrid_rank") <= top_k)


DENSE_UNITS = 20_000


def dense_top_k(queries: DataFrame, key: str, units: DataFrame, unit: str, vector: str, k: int) -> DataFrame:
    """(key, unit, dense_score, dense_rank): dot products of unit-length vectors, the ``k`` best per query.

    The unit set is a library: it is counted and travels as one array, so a query's row is scored and cut to its ``k``
    best where it lies, without a shuffle. Sets of more than ``DENSE_UNITS`` vectors raise an error.
    """

    def scaled(df: DataFrame, name: str) -> DataFrame:
        d = F.transform(F.col(vector), lambda x: x.cast("double"))
        with_norm = df.select(F.col(name).alias("id"), d.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
        return with_norm.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))

    if units.limit(DENSE_UNITS + 1).count() > DENSE_UNITS:
        raise ValueError(f"more than {DENSE_UNITS} units")
    library = scaled(units, unit).agg(F.collect_list(F.struct("id", "v")).alias("units"))
    q = scaled(queries, key).select(F.col("id").alias("q"), F.col("v").alias("qv")).crossJoin(F.broadcast(library))  # one row
    dot = lambda u: F.round(F.aggregate(F.zip_with("qv", u.v, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 6)
    scored = F.array_sort(F.transform("units", lambda u: F.struct((-dot(u)).alias("s"), u.id.alias("u"))))
    best = q.select("q", F.posexplode(F.slice(scored, 1, k)).alias("p", "x"))
    return best.select(F.col("q").alias(key), F.col("x.u").alias(unit), (-F.col("x.s")).alias("dense_score"), (F.col("p") + 1).alias("dense_rank"))


def reciprocal_rank_fusion(ranks: DataFrame, key: str, unit: str = "unit_id", k: int = RRF_K) -> DataFrame:
    """(key, unit, rrf_score, source_count, best_rank, fused_rank) of rows (key, unit, source, rank)."""
    fused = ranks.where("rank IS NOT NULL").groupBy(key, unit).agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf_score"), F.count(F.lit(1)).alias("source_count"), F.min("rank").alias("best_rank")
    )
    fused = fused.withColumn("rrf_score", F.round("rrf_score", 9))
    order = Window.partitionBy(key).orderBy(F.col("rrf_score").desc(), F.col("source_count").desc(), "best_rank", unit)
    return fused.withColumn("fused_rank", F.row_number().over(order))


def hierarchical_fusion(families: dict[str, list[DataFrame]], key: str, k: int = RRF_K) -> DataFrame:
    """Fuse the sources of each family, then the families; a family of one source keeps its ranks."""
    outer = None
    for name, sources in families.items():
        inner = None
        for i, s in enumerate(sources):
            part = s.select(key, "unit_id", "rank").withColumn("source", F.lit(str(i)))
            inner = part if inner is None else inner.unionByName(part)
        if len(sources) > 1:
            inner = reciprocal_rank_fusion(inner, key, k=k).withColumn("rank", F.col("fused_rank"))
        part = inner.select(key, "unit_id", "rank").withColumn("source", F.lit(name))
        outer = part if outer is None else outer.unionByName(part)
    return reciprocal_rank_fusion(outer, key, k=k)


def min_max(value: Column, over) -> Column:
    """Value scaled to 0..1 within the window; a constant group gives 0.5."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.when(value.isNotNull(), 0.5))


def rerank(pool: DataFrame, key: str, composite: str, cross: str, weight: float = CE_WEIGHT, bypass: Column | None = None) -> DataFrame:
    """The pool with ``reranked``: a blend of both min-max scores; a pool of one keeps its composite.

    Where ``bypass`` holds (in older variants an exact match with a high composite) the composite stays, too.
    """
    w = Window.partitionBy(key)
    blended = weight * min_max(F.col(cross), w) + round(1 - weight, 12) * min_max(F.col(composite), w)
    alone = F.count(F.lit(1)).over(w) <= 1
    alone = alone if bypass is None else alone | F.coalesce(bypass, F.lit(False))
    return pool.withColumn("reranked", F.round(F.when(alone, F.coalesce(F.col(composite), F.lit(0.0))).otherwise(blended), 6))


def final_pool(pool: DataFrame, key: str, unit: str, score: str, top_k: int = 25) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.col(score).desc_nulls_last(), unit)
    return pool.withColumn("pool_rank", F.row_number().over(order)).where(F.col("pool_rank") <= top_k)


def branch_share(pool: DataFrame, key: str, branch: str, score: str) -> DataFrame:
    """(key, top_branch, top_share, active_branches, broad): how a pool's positive scores spread over branches."""
    per = pool.groupBy(key, F.coalesce(F.col(branch), F.lit("")).alias("b")).agg(F.sum(F.greatest(F.coalesce(F.col(score), F.lit(0.0)), F.lit(0.0))).alias("s"))
    total = F.sum("s").over(Window.partitionBy(key))
    shared = per.withColumn("share", F.round(F.col("s") / F.when(total > 0, total).otherwise(1.0), 6))
    out = shared.groupBy(key).agg(
        F.max_by("b", F.struct("share", F.expr("-ascii(b)"))).alias("top_branch"), F.max("share").alias("top_share"), F.count_if(F.col("share") >= 0.12).alias("active_branches")
    )
    return out.withColumn("broad", (F.col("active_branches") >= 3) & (F.col("top_share") < 0.45))


def branch_signature(path: Column, depth: int = 3) -> Column:
    return F.array_join(F.slice(F.coalesce(path, F.array().cast("array<string>")), 1, depth), " > ")


def unit_document(library: DataFrame) -> DataFrame:
    """(unit_id, document): a unit's fields in one text for encoders, joined by `` | ``."""
    parts = F.concat(
        F.array("canonical_name"), _present(library, "positive_profile.canonical_terms"), _present(library, "positive_profile.matching_cues"),
        F.array("definition_or_summary"),
    )
    return library.select("unit_id", F.array_join(F.filter(parts, lambda x: x.isNotNull() & (F.trim(x) != "")), " | ").alias("document"))


def vocabulary(library: DataFrame) -> DataFrame:
    """(token, df): in how many units each content token occurs."""
    tokens = library_fields(library).select("unit_id", F.explode(T.content_tokens(F.array_join("phrases", " "))).alias("token")).distinct()
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
