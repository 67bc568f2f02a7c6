"""Queries on assignment, segmentation, packets and response validation (with DuckDB statements)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorgrain.operators import aggregate as A
from tutorgrain.operators import assign as G
from tutorgrain.operators import contracts as V
from tutorgrain.operators import packets as P
from tutorgrain.operators import retrieval as R
from tutorgrain.plans import dialogue, nested, search
from tutorgrain.session import table


def _pool(spark, d) -> DataFrame:
    p = R.final_pool(search._reranked(spark, d), "exchange_id", "unit_id", "reranked")
    families = F.coalesce("source_family_count", F.lit(0))
    return p.select(
        "exchange_id", "unit_id", F.col("reranked").alias("score"), F.coalesce("eligible_for_dominant", F.lit(False)).alias("eligible"), F.lit(False).alias("exact"),
        (families >= 3).alias("corroborated"), F.coalesce(F.col("branch") != "lexical", F.lit(False)).alias("nonlexical"), families.alias("families"),
        F.coalesce(F.col("candidate_state") == "reranked", F.lit(False)).alias("is_candidate"), F.lit(False).alias("tutor_only"), "branch", F.col("cross_encoder_score").alias("ce"), "pool_rank",
        F.col("local_best_score").alias("char"),
    )


def _shares(spark, d) -> DataFrame:
    top = R.final_pool(search._reranked(spark, d), "exchange_id", "unit_id", "reranked")
    return R.branch_share(top, "exchange_id", "branch", "reranked").withColumn("gate", F.lit(None).cast("string"))


def pass1_labels(spark, d):
    return G.first_pass(_pool(spark, d), _shares(spark, d))


def multilabel_topk(spark, d):
    return G.multi_label(_pool(spark, d))


def abstention(spark, d):
    top = _pool(spark, d).where("pool_rank = 1")
    return top.select("exchange_id", G.abstains(F.col("exact"), F.when(F.col("corroborated"), 1.0).otherwise(0.0), F.col("char")).alias("abstained"))


def _rows(spark, d) -> DataFrame:
    item = F.struct("pool_rank", "unit_id", "score", "ce", "eligible", "corroborated", "families", "branch", "tutor_only")
    pools = _pool(spark, d).groupBy("exchange_id").agg(F.array_sort(F.collect_list(item)).alias("pool"))
    j = pass1_labels(spark, d).join(_shares(spark, d).select("exchange_id", "broad", "top_share"), "exchange_id").join(pools, "exchange_id")
    return j.withColumn("dialogue", F.split_part("exchange_id", F.lit("::"), F.lit(1))).withColumn("idx", F.regexp_extract("exchange_id", "([0-9]+)$", 1).cast("int"))


def context_resolution(spark, d):
    return G.second_pass(_rows(spark, d))


def _segment_rows(spark, d) -> DataFrame:
    sets = _rows(spark, d).select("dialogue", "idx", F.transform(F.slice("pool", 1, G.KC_SET), lambda c: c.unit_id).alias("kc_set"), "broad")
    return context_resolution(spark, d).join(sets, ["dialogue", "idx"])


def segments_fold(spark, d):
    return G.segments(_segment_rows(spark, d)).select("dialogue", "segment_no", "segment_id", "dominant", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


def _scoped(spark, d) -> DataFrame:
    r = _segment_rows(spark, d)
    return r.withColumn("scope", G.assignment_scope(F.col("final"), F.col("band"), F.col("action"), F.col("broad")))


def assignment_scopes(spark, d):
    s = _scoped(spark, d)
    return s.select("dialogue", "idx", "scope", G.scope_role(F.col("scope")).alias("role"), F.array_join(G.evaluator_set(F.col("scope"), F.col("resolved"), F.array().cast("array<string>"), F.col("kc_set")), ",").alias("units"))


def segment_scope(spark, d):
    rows = _scoped(spark, d)
    member = G.segments(_segment_rows(spark, d)).select("dialogue", "segment_id", F.explode("members").alias("idx"))
    return G.segment_scope(member.join(rows, ["dialogue", "idx"]), ["segment_id"])


def segment_boundaries(spark, d):
    member = G.segments(_segment_rows(spark, d)).select("dialogue", "segment_no", F.explode("members").alias("idx"))
    return G.boundaries(member)


def topic_rollup(spark, d):
    seg = G.segments(_segment_rows(spark, d))
    lib = table(spark, d, "kc_library").select(F.col("unit_id").alias("dominant"), F.get("topic_path", F.lit(0)).alias("topic"))
    return G.topic_rollup(seg.join(lib, "dominant", "left").withColumn("exchanges", F.size("members")))


def exchange_audit(spark, d):
    s = _scoped(spark, d).withColumn("exchange_id", F.concat("dialogue", F.lit("::ex_"), F.format_string("%04d", F.col("idx").cast("bigint"))))
    texts = dialogue.runs(spark, d).select("exchange_id", "student_text", "tutor_text")
    audit = G.exchange_audit(s.join(texts, "exchange_id", "left"))
    return audit.select("exchange_id", "readiness", *[F.array_join(c, ",").alias(c) for c in ("hard", "recommended", "suspect")])


def _packets(spark, d):
    seg = G.segments(_segment_rows(spark, d))
    return P.build_packets(seg, dialogue.runs(spark, d), table(spark, d, "kc_library")), seg


def packet_nest(spark, d):
    return _packets(spark, d)[0].select("segment_id", "dominant", "dominant_name", F.size("member_exchanges").alias("n_exchanges"), F.length("segment_text").alias("n_chars"), "content_hash")


def packet_audit(spark, d):
    return P.audit_packets(*_packets(spark, d))


def macro_packet(spark, d):
    runs = dialogue.runs(spark, d)
    meta = dialogue.gate_non_kc(spark, d).where("gate_type IS NOT NULL")
    return P.macro_packets(runs, meta)


def judge_prompts(spark, d):
    packets, _ = _packets(spark, d)
    return P.prompt_rows(packets, "Rate the tutor in this segment.", table(spark, d, "kc_library"), "C").drop("prompt")


def _responses(spark, d) -> DataFrame:
    # the parser stops after the first value, so text behind it is ruled out here
    text = F.col("raw_response_text")
    whole = F.when(F.rtrim(F.regexp_replace(text, r"\s+$", "")).endswith("}"), text)
    return table(spark, d, "raw_rows").select("row_id", "judge_prompt_id", "dialogue_id", F.try_parse_json(whole).alias("v"))


def _extracted(spark, d) -> DataFrame:
    """Like _responses(), but objects in a code fence or between words count, and payloads are repaired."""
    text = V.extract_macro_payload(F.col("raw_response_text"), F.col("dialogue_id"))
    return table(spark, d, "raw_rows").select("row_id", "judge_prompt_id", "dialogue_id", F.try_parse_json(text).alias("v"))


def contract_validate_json(spark, d):
    r = _responses(spark, d)
    v = F.when(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.col("v"))
    errors = V.macro_errors(v, F.col("dialogue_id"))
    return r.select("row_id", F.array_join(F.array_sort(errors), ",").alias("errors"))


def validation_report(spark, d):
    r = _responses(spark, d)
    v = F.when(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.col("v"))
    rows = r.select("judge_prompt_id", V.macro_errors(v, F.col("dialogue_id")).alias("errors"))
    return V.batch_report(table(spark, d, "raw_rows").select("judge_prompt_id"), rows, "judge_prompt_id", "errors")


def extracted_payloads(spark, d):
    return table(spark, d, "raw_rows").select("row_id", V.extract_object(F.col("raw_response_text")).isNotNull().alias("has_object"))


def macro_scores_long(spark, d):
    return _macro_scores(_responses(spark, d))


def macro_scores_extracted(spark, d):
    return _macro_scores(_extracted(spark, d))


def _macro_scores(responses: DataFrame) -> DataFrame:
    v = responses.where("v IS NOT NULL")
    cells = F.array(*[F.struct(F.lit(m).alias("dimension"), V.get(F.col("v"), f"$.dimension_scores.{m}", "double").alias("score"), V.get(F.col("v"), f"$.dimension_applicability.{m}", "string").alias("applicability")) for m in A.MACRO_DIMENSIONS])
    return v.select("row_id", F.explode(cells).alias("x")).select("row_id", "x.*")


def macro_means(spark, d):
    return _macro_means(macro_scores_long(spark, d))


def macro_means_extracted(spark, d):
    return _macro_means(macro_scores_extracted(spark, d))


def _macro_means(scores: DataFrame) -> DataFrame:
    use = scores.where("score IS NOT NULL AND applicability = 'applicable'")
    return use.groupBy("row_id").agg(F.round(F.avg("score"), 6).alias("macro"))


def quote_verbatim(spark, d):
    return _quotes_found(spark, d, _responses(spark, d))


def quote_verbatim_extracted(spark, d):
    return _quotes_found(spark, d, _extracted(spark, d))


def _quotes_found(spark, d, v: DataFrame) -> DataFrame:
    p = v.select("row_id", "dialogue_id", F.posexplode(V.get(F.col("v"), "$.evidence_pointers", "array<struct<dimension:string,exchange_id:string,quote:string>>")).alias("pos", "p"))
    texts = dialogue.turns(spark, d).groupBy("d").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda x: x.body), "\n").alias("all_text"))
    j = p.join(texts, p["dialogue_id"] == texts["d"], "left")
    found = F.coalesce(F.contains(V.normal_quote(F.col("all_text")), V.normal_quote(F.col("p.quote"))), F.lit(False))
    return j.select("row_id", "pos", found.alias("found"))


def factuality_verdicts(spark, d):
    return _verdicts(nested._triples(spark, d))


def _verdicts(found: DataFrame) -> DataFrame:
    """One row per segment of every record: triples of its errors meet its own, so nothing is joined or read twice."""
    error = F.col("ancestor") == nested.ERRORS
    segment = F.when(error, F.col("parent_key")).otherwise(F.col("child_key")).alias("segment_no")
    material = error & (F.col("path") == "severity") & (F.lower("value") == "material")
    own = found.where(F.col("ancestor").isin(nested.SEGMENTS, nested.ERRORS)).groupBy("record_no", "record_id", segment)
    rows = own.agg(F.count_if(material).cast("int").alias("material"), F.count_if(error & (F.col("path") == "")).cast("int").alias("n"))
    # an error without a severity is a minor one
    s = F.concat(F.array_repeat(F.lit("material"), F.col("material")), F.array_repeat(F.lit("minor"), F.col("n") - F.col("material")))
    return rows.select("record_id", "segment_no", V.factuality_verdict(s).alias("verdict"), "material")


def lcs_overlap(spark, d):
    p = table(spark, d, "tutor_pairs")
    return p.select("pair_id", V.overlap_length(F.col("student.text"), F.col("tutor.text")).alias("overlap"))


QUERIES = {f.__name__: f for f in (pass1_labels, multilabel_topk, abstention, context_resolution, segments_fold, assignment_scopes, segment_scope, segment_boundaries, topic_rollup, exchange_audit, packet_nest, packet_audit, macro_packet, judge_prompts, contract_validate_json, validation_report, extracted_payloads, macro_scores_long, macro_scores_extracted, macro_means, macro_means_extracted, quote_verbatim, quote_verbatim_extracted, factuality_verdicts, lcs_overlap)}

_P = search._POOL + """, pool25 AS (SELECT exchange_id, unit_id, reranked AS score, coalesce(eligible_for_dominant, false) AS eligible, coalesce(source_family_count, 0) >= 3 AS corroborated,
  coalesce(branch <> 'lexical', false) AS nonlexical, coalesce(source_family_count, 0) AS families, coalesce(candidate_state = 'reranked', false) AS is_candidate, local_best_score, pool_rank, branch FROM fp WHERE pool_rank <= 25)"""
_SHARE = search.SQL["branch_share"].split(", b AS", 1)[1].rsplit("SELECT *, active", 1)[0]
# DuckDB takes commas before a closing bracket for valid, JSON does not
_J = "CASE WHEN json_valid(raw_response_text) AND NOT regexp_matches(raw_response_text, ',\\s*[}\\]]') THEN CAST(raw_response_text AS JSON) END"


def _partial(dim: str) -> list[str]:
    t, x, na = f"json_type(v, '$.dimension_scores.{dim}')", f"TRY_CAST(v ->> '$.dimension_scores.{dim}' AS DOUBLE)", f"coalesce(v ->> '$.dimension_applicability.{dim}' = 'not_applicable', false)"
    num = f"{t} IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT')"
    return [
        f"CASE WHEN NOT coalesce(v ->> '$.dimension_applicability.{dim}' IN ('applicable', 'not_applicable'), false) THEN 'dimension_applicability.{dim}:invalid' END",
        f"CASE WHEN {t} IS NULL THEN 'dimension_scores.missing:{dim}' END",
        f"CASE WHEN {na} AND {t} <> 'NULL' THEN 'dimension_scores.{dim}:must_be_null_when_not_applicable' END",
        f"CASE WHEN NOT {na} AND {t} = 'NULL' THEN 'dimension_scores.{dim}:null_only_allowed_when_not_applicable' END",
        f"CASE WHEN NOT {na} AND {t} IN ('VARCHAR', 'BOOLEAN', 'ARRAY', 'OBJECT') THEN 'dimension_scores.{dim}:score_not_number' END",
        f"CASE WHEN NOT {na} AND {num} AND {x} NOT IN (0, 0.5, 1) THEN 'dimension_scores.{dim}:score_not_allowed' END",
    ]


_MISSING = "list_filter([" + ", ".join(f"CASE WHEN json_type(v, '$.{k}') IS NULL THEN 'missing_required_field:{k}' END" for k in ("dialogue_id", "dimension_scores", "dimension_applicability", "evidence_pointers", "rationale_short")) + "], lambda x: x IS NOT NULL)"
_PTR = "CAST(json_extract(v, '$.evidence_pointers[*]') AS JSON[])"
_DEEP = "list_filter([CASE WHEN v ->> '$.dialogue_id' <> dialogue_id THEN 'dialogue_id_mismatch' END, " + ", ".join(c for m in A.MACRO_DIMENSIONS for c in _partial(m)) + f""",
 CASE WHEN json_type(v, '$.evidence_pointers') <> 'ARRAY' THEN 'evidence_pointers:not_list' END,
 CASE WHEN len(list_filter({_PTR}, lambda p: NOT coalesce(p ->> '$.dimension' IN {dialogue._list(A.MACRO_DIMENSIONS)}, false))) > 0 THEN 'evidence_pointers:unknown_dimension' END,
 CASE WHEN len(list_filter({_PTR}, lambda p: length(trim(coalesce(p ->> '$.quote', ''))) < 4)) > 0 THEN 'evidence_pointers:quote_too_short' END,
 CASE WHEN json_type(v, '$.rationale_short') <> 'VARCHAR' THEN 'rationale_short:not_string' END,
 CASE WHEN length(trim(v ->> '$.rationale_short')) < 20 THEN 'rationale_short:too_short' END,
 CASE WHEN length(v ->> '$.rationale_short') > 1400 THEN 'rationale_short:too_long' END], lambda x: x IS NOT NULL)"""
_ERR = f"r0 AS (SELECT row_id, judge_prompt_id, dialogue_id, {_J} AS v0 FROM raw_rows), r AS (SELECT *, CASE WHEN json_type(v0) = 'OBJECT' THEN v0 END AS v FROM r0), e AS (SELECT row_id, judge_prompt_id, CASE WHEN v IS NULL THEN ['unparseable'] WHEN len({_MISSING}) > 0 THEN {_MISSING} ELSE {_DEEP} END AS errors FROM r)"

SQL = {
    "pass1_labels": f"""WITH {_P}, b AS {_SHARE.lstrip()}, sh2 AS (SELECT *, active_branches >= 3 AND top_share < 0.45 AS broad FROM o),
      l AS (SELECT *, bool_or(eligible) OVER (PARTITION BY exchange_id) AS any_e FROM pool25), k AS (SELECT *, row_number() OVER (PARTITION BY exchange_id ORDER BY score DESC NULLS LAST, unit_id) AS k FROM l WHERE eligible OR NOT any_e),
      t AS (SELECT a.*, coalesce(a.score, 0) AS top1, coalesce(a.score, 0) - coalesce(b.score, 0) AS margin FROM k a LEFT JOIN k b ON b.exchange_id = a.exchange_id AND b.k = 2 WHERE a.k = 1)
      SELECT t.exchange_id, CASE WHEN eligible AND corroborated AND nonlexical AND families >= 2 AND is_candidate AND margin / greatest(top1, 1e-12) >= 0.15 AND NOT broad THEN 'AUTO_HIGH_KC'
        WHEN eligible AND (corroborated OR (families >= 2 AND nonlexical)) AND top_share >= 0.32 THEN 'AUTO_MEDIUM_KC' ELSE 'NEEDS_PASS2' END AS label, unit_id, round(top1, 6) AS top1, round(margin, 6) AS margin
      FROM t JOIN sh2 ON sh2.exchange_id = t.exchange_id""",
    "multilabel_topk": f"WITH {_P}, k AS (SELECT *, row_number() OVER (PARTITION BY exchange_id ORDER BY pool_rank) AS k FROM pool25 WHERE pool_rank = 1 OR eligible) SELECT exchange_id, string_agg(unit_id, ',' ORDER BY k) AS unit_ids FROM k WHERE k <= 4 GROUP BY exchange_id",
    "abstention": f"WITH {_P} SELECT exchange_id, NOT corroborated AND coalesce(local_best_score, 0) < 0.3849 AS abstained FROM pool25 WHERE pool_rank = 1",
    "macro_packet": dialogue.SQL["gate_non_kc"].split("SELECT exchange_id, CASE", 1)[0] + ", gates AS (SELECT exchange_id, CASE" + dialogue.SQL["gate_non_kc"].split("SELECT exchange_id, CASE", 1)[1] + ") SELECT d, count(*) AS n_exchanges, string_agg('Student: ' || student_text || chr(10) || 'Tutor: ' || tutor_text, chr(10) ORDER BY exchange_index) AS dialogue_text FROM runs WHERE exchange_id NOT IN (SELECT exchange_id FROM gates WHERE gate_type IS NOT NULL) GROUP BY d",
    "contract_validate_json": f"WITH {_ERR} SELECT row_id, array_to_string(list_sort(errors), ',') AS errors FROM e",
    "validation_report": f"WITH {_ERR}, a AS (SELECT count(*) AS responses, count(*) FILTER (len(errors) = 0) AS valid, count(*) FILTER (len(errors) > 0) AS invalid, count(*) - count(DISTINCT judge_prompt_id) AS duplicates FROM e) SELECT *, CAST(0 AS BIGINT) AS missing, (SELECT count(DISTINCT judge_prompt_id) FROM raw_rows) AS prompts, CASE WHEN invalid = 0 AND duplicates = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM a",
}
SQL["macro_scores_long"] = f"WITH r0b AS (SELECT row_id, {_J} AS v FROM raw_rows WHERE {_J} IS NOT NULL) SELECT row_id, m AS dimension, TRY_CAST(v ->> ('$.dimension_scores.' || m) AS DOUBLE) AS score, v ->> ('$.dimension_applicability.' || m) AS applicability FROM r0b, (SELECT unnest({A.MACRO_DIMENSIONS}) AS m)"
SQL["macro_means"] = f"SELECT row_id, round(avg(score), 6) AS macro FROM ({SQL['macro_scores_long']}) WHERE score IS NOT NULL AND applicability = 'applicable' GROUP BY row_id"
_Q = lambda c: f"trim(regexp_replace(translate(lower(coalesce({c}, '')), '’‘“”', '''''\"\"'), '\\s+', ' ', 'g'))"
SQL["quote_verbatim"] = f"""WITH {dialogue.TURNS}, x AS (SELECT d, string_agg(body, chr(10) ORDER BY n) AS all_text FROM turns GROUP BY d), r0b AS (SELECT row_id, dialogue_id, {_J} AS v FROM raw_rows), q AS (SELECT row_id, dialogue_id, CAST(json_extract(v, '$.evidence_pointers[*]') AS JSON[]) AS ps FROM r0b WHERE json_type(v, '$.evidence_pointers') = 'ARRAY'),
  f AS (SELECT row_id, dialogue_id, unnest(generate_series(0, len(ps) - 1)) AS pos, ps FROM q WHERE len(ps) > 0) SELECT row_id, CAST(pos AS INTEGER) AS pos, coalesce(contains({_Q('all_text')}, {_Q("ps[pos + 1] ->> '$.quote'")}), false) AS found FROM f LEFT JOIN x ON x.d = f.dialogue_id"""
