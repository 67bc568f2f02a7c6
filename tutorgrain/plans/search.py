"""Queries on retrieval, fusion, reranking and matching (with DuckDB statements)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tutorgrain.functions import text as T
from tutorgrain.operators import exchanges as X
from tutorgrain.operators import matcher as M
from tutorgrain.operators import retrieval as R
from tutorgrain.plans import dialogue
from tutorgrain.session import table


def _texts(spark, d) -> DataFrame:
    return dialogue.runs(spark, d).select("exchange_id", "student_text", "tutor_text", F.concat_ws(" ", "student_text", "tutor_text").alias("combined_text"))


def _library(spark, d) -> DataFrame:
    return table(spark, d, "kc_library")


def bm25_topk(spark, d):
    return R.bm25_top(_texts(spark, d), "exchange_id", "combined_text", _library(spark, d), 10)


def char_tfidf_topk(spark, d):
    said = X.run_exchanges(X.dialogue_turns(table(spark, d, "turn_rows"), spoken_by="student"))
    return R.char_top(said.select("exchange_id", "student_text"), "exchange_id", "student_text", _library(spark, d), 10)


def hybrid_views(spark, d):
    return R.hybrid_top(_texts(spark, d), "exchange_id", _library(spark, d))


def _vectors(spark, d):
    v = table(spark, d, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return v, first.select(F.col("label").cast("bigint").alias("unit"), "embedding")


def dense_topk(spark, d):
    v, units = _vectors(spark, d)
    return R.dense_top_k(v, "vec_id", units, "unit", "embedding", 3)


def dense_nn_accuracy(spark, d):
    v, units = _vectors(spark, d)
    best = R.dense_top_k(v, "vec_id", units, "unit", "embedding", 1).join(v.select("vec_id", "label"), "vec_id")
    return best.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("unit") == F.col("label")).cast("double")), 6).alias("accuracy"))


def rrf_fuse(spark, d):
    return R.fused_top(_texts(spark, d), "exchange_id", "combined_text", _library(spark, d), 40, 10)


def hierarchical_rrf(spark, d):
    return R.hierarchical_top(_texts(spark, d), "exchange_id", _library(spark, d))


def matcher_evidence(spark, d):
    return M.evidence(_texts(spark, d), "exchange_id", "student_text", _library(spark, d))


def matcher_rank(spark, d):
    return M.ranked_units(_texts(spark, d), "exchange_id", "student_text", _library(spark, d))


def token_df(spark, d):
    return M.specificity_tables(M.phrases(_library(spark, d)))[0]


def ngram_df(spark, d):
    return M.specificity_tables(M.phrases(_library(spark, d)))[1]


def phrase_specificity(spark, d):
    token, _, units = M.specificity_tables(M.phrases(_library(spark, d)))
    rows = token.crossJoin(F.broadcast(units))  # one row
    spec, rare = M.specificity(F.col("df"), F.col("units")), M.is_rare(F.col("df"), F.col("units"))
    return rows.select("token", F.round(spec, 6).alias("specificity"), rare.alias("rare"))


def library_vocabulary(spark, d):
    return R.vocabulary(_library(spark, d))


def unit_documents(spark, d):
    return R.unit_document(_library(spark, d))


def branch_signatures(spark, d):
    path = F.col("topic_path")
    return _library(spark, d).select("unit_id", R.branch_signature(path).alias("branch"), F.try_element_at(path, F.lit(-1)).alias("leaf"))


def pool(spark, d) -> DataFrame:
    """candidate_hits with one row per exchange and unit: the first by score, rank and hit id."""
    rows = table(spark, d, "candidate_hits").where("best_score IS NOT NULL AND NOT isnan(best_score)")
    rank = F.coalesce(F.col("fused_rank"), F.lit(2**31 - 1))
    item = F.struct((-F.col("best_score")).alias("a"), rank.alias("b"), "hit_id", "best_score", "local_best_score", "fused_rank", "source_family_count", "branch", "candidate_state", "eligible_for_dominant", "cross_encoder_score")
    return rows.groupBy("exchange_id", "unit_id").agg(F.min(item).alias("x")).select("exchange_id", "unit_id", "x.*").drop("a", "b")


def _reranked(spark, d):
    return R.rerank(pool(spark, d), "exchange_id", "best_score", "cross_encoder_score")


def minmax_rerank(spark, d):
    return _reranked(spark, d).select("exchange_id", "unit_id", "reranked")


def final_pool(spark, d):
    return R.final_pool(_reranked(spark, d), "exchange_id", "unit_id", "reranked").select("exchange_id", "unit_id", "reranked", "pool_rank")


def branch_share(spark, d):
    top = R.final_pool(_reranked(spark, d), "exchange_id", "unit_id", "reranked")
    return R.branch_share(top, "exchange_id", "branch", "reranked").drop("top_branch")


QUERIES = {f.__name__: f for f in (bm25_topk, char_tfidf_topk, hybrid_views, dense_topk, dense_nn_accuracy, rrf_fuse, hierarchical_rrf, matcher_evidence, matcher_rank, token_df, ngram_df, phrase_specificity, library_vocabulary, unit_documents, branch_signatures, minmax_rerank, final_pool, branch_share)}

_L = dialogue._list
_TOK = r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '([a-z])[-_{1}]([a-z])', '\1 \2', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 2 AND w NOT IN {2})"
_RTOK = lambda c: _TOK.format(c, "/", _L(T.RETRIEVAL_STOPWORDS))
_CTOK = lambda c: _TOK.format(c, "", _L(T.FUNCTION_WORDS + T.NUMBER_WORDS + T.PEDAGOGY_WORDS))
_CLEAN = "list_filter(coalesce({0}, []), lambda x: x IS NOT NULL AND trim(x) <> '')"
_FIELDS = f"""
fields AS (
  SELECT unit_id, 'canonical' AS field, {_CLEAN.format("list_concat([canonical_name], positive_profile.canonical_terms)")} AS phrases, 1 AS p FROM kc_library
  UNION ALL SELECT unit_id, 'identity', {_CLEAN.format("positive_profile.matching_cues")}, 2 FROM kc_library
  UNION ALL SELECT unit_id, 'dialogue_forms', {_CLEAN.format("positive_profile.likely_dialogue_surface_forms")}, 3 FROM kc_library
  UNION ALL SELECT unit_id, 'topic', {_CLEAN.format("topic_path")}, 4 FROM kc_library
  UNION ALL SELECT unit_id, 'support', [], 5 FROM kc_library
  UNION ALL SELECT unit_id, 'definition', {_CLEAN.format("[definition_or_summary]")}, 6 FROM kc_library
)"""
_RT = "WITH " + dialogue.RUNS + ", texts AS (SELECT exchange_id, student_text, tutor_text, student_text || ' ' || tutor_text AS combined_text FROM runs), " + _FIELDS.strip()
_W = "CASE field " + " ".join(f"WHEN '{k}' THEN {w}" for k, (w, _) in R.FIELDS.items()) + " END"
_C = "CASE field " + " ".join(f"WHEN '{k}' THEN {c}" for k, (_, c) in R.FIELDS.items()) + " END"
_BM25 = f""", docs AS (SELECT unit_id, field, {_RTOK("array_to_string(phrases, ' ')")} AS toks FROM fields),
 per AS (SELECT field, avg(len(toks)) AS avgdl, count(*) AS units FROM docs GROUP BY field),
 tf AS (SELECT field, unit_id, dl, token, count(*) AS tf FROM (SELECT field, unit_id, len(toks) AS dl, unnest(toks) AS token FROM docs) GROUP BY ALL),
 dfs AS (SELECT field, token, count(*) AS df FROM tf GROUP BY ALL),
 post AS (SELECT tf.token, tf.unit_id, {_W.replace('field', 'tf.field', 1)} * ln((units - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * dl / avgdl)) AS gain
   FROM tf JOIN dfs ON dfs.field = tf.field AND dfs.token = tf.token JOIN per ON per.field = tf.field WHERE df / units < {_C.replace('field', 'tf.field', 1)}),
 asked AS (SELECT DISTINCT exchange_id, unnest({_RTOK('combined_text')}) AS token FROM texts),
 raw AS (SELECT exchange_id, unit_id, round(sum(gain), 6) AS bm25_raw FROM asked JOIN post ON post.token = asked.token GROUP BY ALL),
 bm AS (SELECT exchange_id, unit_id, bm25_raw, round(bm25_raw / max(bm25_raw) OVER (PARTITION BY exchange_id), 6) AS bm25_score, row_number() OVER (PARTITION BY exchange_id ORDER BY bm25_raw DESC, unit_id) AS bm25_rank FROM raw WHERE bm25_raw > 0)
"""


def _char(column: str) -> str:
    grams = lambda c: f"""SELECT id, w, unnest(flatten([{', '.join(f"CASE WHEN length(w) >= {n} THEN list_transform(generate_series(1, length(w) - {n} + 1), lambda i: substr(w, i, {n})) ELSE {'[w]' if n == 3 else f'CASE WHEN length(w) > {n - 1} THEN [w] ELSE [] END'} END" for n in (3, 4, 5))}])) AS gram FROM (SELECT id, ' ' || unnest(list_filter(regexp_split_to_array(lower(x), '\\s+'), lambda w: w <> '')) || ' ' AS w FROM ({c}))"""
    docs = "SELECT unit_id AS id, string_agg(array_to_string(phrases, ' '), ' ' ORDER BY p) AS x FROM fields GROUP BY unit_id"
    asks = f"SELECT exchange_id AS id, {column} AS x FROM texts"
    return f""", ctf AS (SELECT id AS unit_id, gram, count(*) AS tf FROM ({grams(docs)}) GROUP BY ALL),
 cidf AS (SELECT gram, ln((1 + (SELECT count(DISTINCT unit_id) FROM kc_library)) / (1 + count(*))) + 1 AS idf FROM ctf GROUP BY gram),
 cw AS (SELECT unit_id, ctf.gram, tf * idf AS w FROM ctf JOIN cidf ON cidf.gram = ctf.gram),
 cn AS (SELECT unit_id, sqrt(sum(w * w)) AS norm FROM cw GROUP BY unit_id),
 qtf AS (SELECT id AS exchange_id, gram, count(*) AS tf FROM ({grams(asks)}) GROUP BY ALL),
 qw AS (SELECT exchange_id, qtf.gram, tf * idf AS w FROM qtf JOIN cidf ON cidf.gram = qtf.gram),
 qn AS (SELECT exchange_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY exchange_id),
 dots AS (SELECT q.exchange_id, c.unit_id, sum(q.w * (c.w / cn.norm)) AS dot FROM qw q JOIN cw c ON c.gram = q.gram JOIN cn ON cn.unit_id = c.unit_id GROUP BY ALL),
 cs AS (SELECT dots.exchange_id, unit_id, round(dot / norm, 6) AS char_score FROM dots JOIN qn ON qn.exchange_id = dots.exchange_id),
 ch AS (SELECT *, row_number() OVER (PARTITION BY exchange_id ORDER BY char_score DESC, unit_id) AS char_rank FROM cs WHERE char_score > 0)
"""  # fmt: skip


_POOL = """pool AS (SELECT * FROM candidate_hits WHERE best_score IS NOT NULL AND NOT isnan(best_score)
  QUALIFY row_number() OVER (PARTITION BY exchange_id, unit_id ORDER BY best_score DESC, fused_rank NULLS LAST, hit_id) = 1),
mm AS (SELECT *, count(*) OVER w AS c, min(best_score) OVER w AS b0, max(best_score) OVER w AS b1, min(cross_encoder_score) OVER w AS x0, max(cross_encoder_score) OVER w AS x1 FROM pool WINDOW w AS (PARTITION BY exchange_id)),
rr AS (SELECT exchange_id, unit_id, branch, best_score, fused_rank, source_family_count, candidate_state, eligible_for_dominant, local_best_score, cross_encoder_score,
  round(CASE WHEN c <= 1 THEN best_score ELSE 0.55 * CASE WHEN x1 > x0 THEN (cross_encoder_score - x0) / (x1 - x0) WHEN cross_encoder_score IS NOT NULL THEN 0.5 END
    + 0.45 * CASE WHEN b1 > b0 THEN (best_score - b0) / (b1 - b0) ELSE 0.5 END END, 6) AS reranked FROM mm),
fp AS (SELECT *, row_number() OVER (PARTITION BY exchange_id ORDER BY reranked DESC NULLS LAST, unit_id) AS pool_rank FROM rr)"""
_PHRASES = f"""reps0 AS (
  SELECT unit_id, 'canonical_terms' AS field, unnest(positive_profile.canonical_terms) AS phrase FROM kc_library
  UNION ALL SELECT unit_id, 'matching_cues', unnest(positive_profile.matching_cues) FROM kc_library
  UNION ALL SELECT unit_id, 'forms', unnest(positive_profile.likely_dialogue_surface_forms) FROM kc_library
  UNION ALL SELECT unit_id, 'definition', definition_or_summary FROM kc_library WHERE definition_or_summary IS NOT NULL
), reps AS (SELECT unit_id, phrase, {_CTOK('phrase')} AS toks FROM reps0 WHERE trim(phrase) <> ''),
tdf AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT unit_id, unnest(toks) AS token FROM reps) GROUP BY token)"""

SQL = {
    "bm25_topk": f"{_RT}{_BM25} SELECT exchange_id, unit_id, bm25_raw, bm25_score, bm25_rank FROM bm WHERE bm25_rank <= 10",
    "char_tfidf_topk": f"{_RT}{_char('student_text')} SELECT exchange_id, unit_id, char_score, char_rank FROM ch WHERE char_rank <= 10",
    "rrf_fuse": f"""{_RT}{_BM25}{_char('combined_text')}, ranks AS (SELECT exchange_id, unit_id, bm25_rank AS rank FROM bm WHERE bm25_rank <= 40 UNION ALL SELECT exchange_id, unit_id, char_rank FROM ch WHERE char_rank <= 40),
      f AS (SELECT exchange_id, unit_id, round(sum(1.0 / (11 + rank)), 9) AS rrf_score, count(*) AS source_count, min(rank) AS best_rank FROM ranks GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY exchange_id ORDER BY rrf_score DESC, source_count DESC, best_rank, unit_id) AS fused_rank FROM f) SELECT * FROM r WHERE fused_rank <= 10""",
    "dense_topk": """WITH u AS (SELECT label AS unit, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
      s AS (SELECT e.vec_id, CAST(u.unit AS BIGINT) AS unit, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])))), 6) AS dense_score FROM embeddings e, u)
      SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dense_score DESC, unit) AS dense_rank FROM s QUALIFY dense_rank <= 3""",
    "dense_nn_accuracy": """WITH u AS (SELECT label AS unit, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
      s AS (SELECT e.label, u.unit, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])))), 6) AS x, e.vec_id FROM embeddings e, u
        QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY x DESC, u.unit) = 1)
      SELECT label, count(*) AS n, round(avg(CASE WHEN unit = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM s GROUP BY label""",
    "token_df": f"WITH {_PHRASES} SELECT token, df FROM tdf",
    "phrase_specificity": f"WITH {_PHRASES}, n AS (SELECT count(DISTINCT unit_id) AS units FROM reps WHERE len(toks) > 0) SELECT token, round(ln((units + 1) / (df + 1)), 6) AS specificity, df <= greatest(2, floor(units * 0.03)) OR ln((units + 1) / (df + 1)) >= ln(4.0) AS rare FROM tdf, n",
    "library_vocabulary": f"WITH {_FIELDS.strip()}, t AS (SELECT DISTINCT unit_id, unnest({_CTOK("array_to_string(phrases, ' ')")}) AS token FROM fields) SELECT token, count(*) AS df FROM t GROUP BY token",
    "unit_documents": f"SELECT unit_id, array_to_string({_CLEAN.format('list_concat([canonical_name], positive_profile.canonical_terms, positive_profile.matching_cues, [definition_or_summary])')}, ' | ') AS document FROM kc_library",
    "branch_signatures": "SELECT unit_id, coalesce(array_to_string(topic_path[1:3], ' > '), '') AS branch, topic_path[-1] AS leaf FROM kc_library",
    "minmax_rerank": f"WITH {_POOL} SELECT exchange_id, unit_id, reranked FROM rr",
    "final_pool": f"WITH {_POOL} SELECT exchange_id, unit_id, reranked, pool_rank FROM fp WHERE pool_rank <= 25",
    "branch_share": f"""WITH {_POOL}, b AS (SELECT exchange_id, coalesce(branch, '') AS b, sum(greatest(coalesce(reranked, 0.0), 0.0)) AS s FROM fp WHERE pool_rank <= 25 GROUP BY ALL),
      sh AS (SELECT *, round(s / CASE WHEN sum(s) OVER (PARTITION BY exchange_id) > 0 THEN sum(s) OVER (PARTITION BY exchange_id) ELSE 1.0 END, 6) AS share FROM b),
      o AS (SELECT exchange_id, max(share) AS top_share, count(*) FILTER (share >= 0.12) AS active_branches FROM sh GROUP BY exchange_id) SELECT *, active_branches >= 3 AND top_share < 0.45 AS broad FROM o""",
}
