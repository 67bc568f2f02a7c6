"""Queries on baselines, anchors, integrity and diagnostics (with DuckDB statements)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tutorgrain.operators import aggregate as A
from tutorgrain.operators import checks as C
from tutorgrain.operators import contracts as V
from tutorgrain.operators import flatten as N
from tutorgrain.plans import dialogue, judging, nested, scores
from tutorgrain.session import table


def _gold(spark, d) -> DataFrame:
    t = table(spark, d, "turn_rows").select(F.split_part("turn_id", F.lit("::"), F.lit(1)).alias("item"), F.expr("try_cast(regexp_extract(turn_id, '([0-9]+)$', 1) AS INT)").alias("n"), F.col("metadata.expected_kc_id").alias("u"))
    g = t.where("u IS NOT NULL").groupBy("item", (F.col("n") / 2).cast("int").alias("idx")).agg(F.min("u").alias("unit"))
    return g.withColumn("corpus", F.split_part("item", F.lit("_"), F.lit(1)))


def _top(spark, d) -> DataFrame:
    p = judging._pool(spark, d).where("pool_rank = 1")
    item = F.split_part("exchange_id", F.lit("::"), F.lit(1))
    return p.select(item.alias("item"), F.split_part(item, F.lit("_"), F.lit(1)).alias("corpus"), F.regexp_extract("exchange_id", "([0-9]+)$", 1).cast("int").alias("idx"), F.col("unit_id").alias("unit"))


def assignment_accuracy(spark, d):
    return C.offset_accuracy(_top(spark, d), _gold(spark, d))


def majority_baseline(spark, d):
    return C.majority_baseline(_gold(spark, d))


def nearest_anchors(spark, d):
    p = judging.pass1_labels(spark, d)
    rows = p.select(F.split_part("exchange_id", F.lit("::"), F.lit(1)).alias("dialogue"), F.regexp_extract("exchange_id", "([0-9]+)$", 1).cast("int").alias("idx"), "label", "unit_id")
    return C.nearest_anchors(rows, "label").select("dialogue", "idx", "left_anchor", "right_anchor")


def names_in_documents(spark, d):
    return C.containment(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "kc_library"), "unit_id", "canonical_name")


def unique_locations(spark, d):
    hits = names_in_documents(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("unit_id").alias("unit_id"))
    return hits.where("n = 1").select("doc_id", "unit_id")


def criterion_integrity(spark, d):
    li = table(spark, d, "lineitem")
    j = li.select(F.col("l_partkey").alias("criterion_id"), F.when(F.col("l_suppkey") % 50 == 0, F.lit(-1)).otherwise(F.col("l_partkey") % 7).cast("bigint").alias("kc_id"), (1 + F.col("l_partkey") % 3 + (F.col("l_linenumber") == 7).cast("int")).cast("bigint").alias("weight"))
    lib = table(spark, d, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("criterion_id"), (F.col("p_partkey") % 7).alias("kc_id"), (1 + F.col("p_partkey") % 3).cast("bigint").alias("weight"))
    return C.criterion_integrity(j, lib)


def focus_rates(spark, d):
    r = table(spark, d, "lineitem").select("l_linestatus", F.when(F.col("l_linenumber") == 7, None).when(F.col("l_returnflag") == "A", "Y").when(F.col("l_returnflag") == "R", "n ").otherwise("NA").alias("a"))
    return C.yes_no_rates(r, "l_linestatus", "a")


def candidate_diagnostic(spark, d):
    p = judging.pass1_labels(spark, d).join(judging._shares(spark, d).select("exchange_id", "top_share"), "exchange_id")
    size = judging._pool(spark, d).groupBy("exchange_id").agg(F.count(F.lit(1)).alias("size"))
    mode = C.failure_mode(F.col("label"), F.col("size"), F.col("top_share"), F.col("margin"))
    return p.join(size, "exchange_id", "left").groupBy(mode.alias("mode")).agg(F.count(F.lit(1)).alias("n"))


def definition_conflicts(spark, d):
    t = N.child_table(nested._triples(spark, d), nested.ERRORS, {"claim": "tutor_quote", "definition": "what_is_wrong", "correction": "correct_version"})
    return C.conflict_checks(t, "claim", "definition", "correction").groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def revelation_rates(spark, d):
    r = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") % 3 == 0, "full").when(F.col("l_linenumber") % 3 == 1, "partial").otherwise("none").alias("rev"), F.when(F.col("l_linestatus") == "O", "warranted").alias("warrant"))
    shown = F.col("rev") != "none"
    return r.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(shown.cast("double")), 6).alias("revealed"), F.round(F.avg((shown & F.col("warrant").isNull()).cast("double")), 6).alias("unwarranted"),
        F.round(F.avg(V.solution_control(F.col("rev"), F.col("warrant"))), 6).alias("solution_control"),
    )


def row_hashes(spark, d):
    t = dialogue.turns(spark, d)
    return t.select("d", "n", F.sha2(F.concat_ws("|", "d", F.col("n").cast("string"), "speaker", "body"), 256).alias("hash"))


def focus_grounding(spark, d):
    focus = dialogue.focus_target(spark, d).where("target_type = 'precise_focus_target'")
    texts = dialogue.runs(spark, d).select("exchange_id", F.concat_ws("\n", "student_text", "tutor_text").alias("span"))
    spans = focus.join(texts, "exchange_id").select("d", "span")
    ptr = V.get(F.col("v"), "$.evidence_pointers", "array<struct<dimension:string,exchange_id:string,quote:string>>")
    r = judging._extracted(spark, d).select("row_id", "dialogue_id", F.transform(ptr, lambda p: p.quote).alias("quotes"))
    j = r.join(spans, r["dialogue_id"] == spans["d"])
    hit = F.exists("quotes", lambda q: F.contains(V.normal_quote(F.col("span")), V.normal_quote(q)))
    return j.select("row_id", F.coalesce(hit, F.lit(False)).alias("grounded"))


def variant_diff(spark, d):
    p = table(spark, d, "tutor_pairs").select("pair_id", "arm", F.col("student.text").alias("s"), F.coalesce("tutor.text", F.lit("")).alias("t"))
    ratio = F.length("t") / F.nullif(F.length("s"), F.lit(0))
    return p.groupBy(F.coalesce("arm", F.lit("")).alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") == F.col("t")).alias("unchanged"), F.count_if(ratio < 0.6).alias("short"))


def candidate_features(spark, d):
    p = judging._pool(spark, d)
    support = F.col("families") >= 2
    return p.select("exchange_id", "unit_id", (F.col("exact") | F.col("corroborated") | (support & F.col("nonlexical"))).alias("dominant"), F.round(F.least(F.lit(4.0), 2.4 * F.col("score") + 1.6 * F.coalesce("char", F.lit(0.0))), 6).alias("lexical_component"))


def family_summary(spark, d):
    seg = judging.segment_scope(spark, d)
    return seg.groupBy("scope").agg(F.count(F.lit(1)).alias("packets"))


def review_queue(spark, d):
    r = judging.context_resolution(spark, d).where("final = 'MISSING_KC_REVIEW'")
    w = Window.partitionBy("dialogue").orderBy("idx")
    return r.select("dialogue", "idx", F.row_number().over(w).alias("queue_no"))


def segment_units(spark, d):
    seg = judging.G.segments(judging._segment_rows(spark, d))
    ids = seg.select("segment_id", F.explode(F.transform("members", lambda i: F.concat("dialogue", F.lit("::ex_"), F.format_string("%04d", i.cast("bigint"))))).alias("exchange_id"))
    j = ids.join(judging.multilabel_topk(spark, d), "exchange_id")
    return j.groupBy("segment_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("unit_ids", ","))))), ",").alias("units"))


def factuality_contract(spark, d):
    e = N.child_table(nested._triples(spark, d), nested.ERRORS, {c: c for c in ("tutor_quote", "what_is_wrong", "correct_version", "severity")})
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    known = F.coalesce(F.lower("severity").isin("material", "minor"), F.lit(False))
    errors = V.codes((blank("tutor_quote"), "tutor_quote:empty"), (blank("what_is_wrong"), "what_is_wrong:empty"), (blank("correct_version"), "correct_version:empty"), (~known, "severity:invalid"))
    return e.select(F.explode_outer(errors).alias("code")).groupBy(F.coalesce("code", F.lit("ok")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def rescored(spark, d):
    u = scores.unit_scores(spark, d).where("p IS NOT NULL")
    verdict = F.when(F.col("cust") % 6 == 0, "contradicted").when(F.col("cust") % 6 == 1, "minor_issue").otherwise("supported")
    u = u.withColumn("after", A.trust_cap(F.col("b"), verdict, (F.col("cust") % 3 + 1).cast("int")))
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 6)
    return u.groupBy("tutor").agg(mean("score").alias("before"), mean("after").alias("after"))


def scope_contrast(spark, d):
    rows = scores.dims(spark, d).where("score IS NOT NULL AND applicability <> 'not_applicable'").join(scores.units(spark, d).select("unit", "family"), "unit")
    own = F.col("dimension").isin(A.ARC_DIMENSIONS["v2"]) == (F.col("family") == "arc")
    g = rows.groupBy("dimension").agg(F.avg(F.when(own, F.col("score"))).alias("o"), F.avg(F.when(~own, F.col("score"))).alias("x"))
    return g.select("dimension", F.round("o", 6).alias("own_scope"), F.round("x", 6).alias("other_scope"))


def judge_plan(spark, d):
    seg = judging.segment_scope(spark, d)
    arc = F.col("scope").isin("branch_context", "broad_kc_set")
    names = lambda v: F.lit(",".join(v))
    local = [x for x in A.DIMENSIONS if x not in A.ARC_DIMENSIONS["v1"]]
    return seg.select("segment_id", F.when(arc, names(A.ARC_DIMENSIONS["v1"])).otherwise(names(local)).alias("dimensions"), F.when(arc, names(V.TRUST_FLAGS[1:2])).otherwise(names([V.TRUST_FLAGS[0], V.TRUST_FLAGS[2]])).alias("flags"))


QUERIES = {f.__name__: f for f in (review_queue, segment_units, factuality_contract, rescored, scope_contrast, judge_plan, assignment_accuracy, majority_baseline, nearest_anchors, names_in_documents, unique_locations, criterion_integrity, focus_rates, candidate_diagnostic, definition_conflicts, revelation_rates, row_hashes, focus_grounding, variant_diff, candidate_features, family_summary)}

_GOLD = "gold AS (SELECT split_part(item, '_', 1) AS corpus, item, n // 2 AS idx, min(u) AS unit FROM (SELECT split_part(turn_id, '::', 1) AS item, TRY_CAST(regexp_extract(turn_id, '([0-9]+)$', 1) AS INTEGER) AS n, metadata.expected_kc_id AS u FROM turn_rows) WHERE u IS NOT NULL GROUP BY ALL)"
_N = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '([a-z])[-_]([a-z])', '\1 \2', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_HITS = f"t AS (SELECT doc_id, ' ' || {_N.format('text')} || ' ' AS x FROM documents), k AS (SELECT unit_id, ' ' || {_N.format('canonical_name')} || ' ' AS y FROM kc_library), h AS (SELECT DISTINCT doc_id, unit_id FROM t JOIN k ON contains(x, y))"
_PASS1 = judging.SQL["pass1_labels"]
SQL = {
    "factuality_contract": nested._CHILDREN + """, f AS (SELECT v ->> '$.tutor_quote' AS q, CASE WHEN json_type(v, '$.what_is_wrong') <> 'NULL' THEN v ->> '$.what_is_wrong' END AS w, CASE WHEN json_type(v, '$.correct_version') <> 'NULL' THEN v ->> '$.correct_version' END AS c, CASE WHEN json_type(v, '$.severity') <> 'NULL' THEN v ->> '$.severity' END AS s FROM er),
      e AS (SELECT list_filter([CASE WHEN trim(coalesce(q, '')) = '' THEN 'tutor_quote:empty' END, CASE WHEN trim(coalesce(w, '')) = '' THEN 'what_is_wrong:empty' END, CASE WHEN trim(coalesce(c, '')) = '' THEN 'correct_version:empty' END, CASE WHEN NOT coalesce(lower(s) IN ('material', 'minor'), false) THEN 'severity:invalid' END], lambda x: x IS NOT NULL) AS l FROM f),
      u AS (SELECT unnest(CASE WHEN len(l) = 0 THEN ['ok'] ELSE l END) AS code FROM e) SELECT code, count(*) AS n FROM u GROUP BY code""",
    "rescored": f"WITH {scores._B}, x AS (SELECT tutor, n, score, CASE WHEN cust % 6 = 0 THEN least(b, CASE WHEN cust % 3 + 1 >= 2 THEN 0.25 ELSE 0.5 END) WHEN cust % 6 = 1 THEN least(b, 0.9) ELSE b END AS after FROM us WHERE p IS NOT NULL) SELECT tutor, {scores._MEAN.format('score')} AS before, {scores._MEAN.format('after')} AS after FROM x GROUP BY tutor",
    "scope_contrast": f"WITH dims AS ({scores._DIMS}), units AS ({scores._UNITS}), x AS (SELECT dimension, score, (dimension IN {dialogue._list(A.ARC_DIMENSIONS['v2'])}) = (family = 'arc') AS own FROM dims JOIN units ON units.unit = dims.unit WHERE {scores._USE}) SELECT dimension, round(avg(score) FILTER (own), 6) AS own_scope, round(avg(score) FILTER (NOT own), 6) AS other_scope FROM x GROUP BY dimension",
    "assignment_accuracy": f"WITH {judging._P}, {_GOLD}, top AS (SELECT split_part(exchange_id, '::', 1) AS item, CAST(regexp_extract(exchange_id, '([0-9]+)$', 1) AS INTEGER) AS idx, unit_id FROM pool25 WHERE pool_rank = 1), s AS (SELECT corpus, o AS \"offset\", count(*) AS n, count(*) FILTER (unit = unit_id) AS hits FROM top CROSS JOIN (SELECT unnest([0, 1, 2]) AS o) JOIN gold ON gold.item = top.item AND gold.idx = top.idx + o GROUP BY ALL) SELECT corpus, \"offset\", n, round(hits / n, 6) AS exact FROM s QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY hits / n DESC, \"offset\") = 1",
    "majority_baseline": f"WITH {_GOLD}, c AS (SELECT corpus, unit, count(*) AS c FROM gold GROUP BY ALL) SELECT corpus, unit, CAST(sum(c) OVER (PARTITION BY corpus) AS BIGINT) AS n, round(c / sum(c) OVER (PARTITION BY corpus), 6) AS share FROM c QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY c DESC, unit) = 1",
    "nearest_anchors": f"WITH p AS ({_PASS1}), r AS (SELECT split_part(exchange_id, '::', 1) AS dialogue, CAST(regexp_extract(exchange_id, '([0-9]+)$', 1) AS INTEGER) AS idx, CASE WHEN label IN ('AUTO_HIGH_KC', 'AUTO_MEDIUM_KC') THEN unit_id END AS u FROM p) SELECT dialogue, idx, last_value(u IGNORE NULLS) OVER (PARTITION BY dialogue ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS left_anchor, first_value(u IGNORE NULLS) OVER (PARTITION BY dialogue ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS right_anchor FROM r",
    "names_in_documents": f"WITH {_HITS} SELECT doc_id, unit_id FROM h",
    "unique_locations": f"WITH {_HITS} SELECT doc_id, min(unit_id) AS unit_id FROM h GROUP BY doc_id HAVING count(*) = 1",
    "criterion_integrity": "WITH j AS (SELECT l_partkey AS c, CASE WHEN l_suppkey % 50 = 0 THEN -1 ELSE l_partkey % 7 END AS k, 1 + l_partkey % 3 + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS w FROM lineitem), l AS (SELECT p_partkey AS c, p_partkey % 7 AS tk, 1 + p_partkey % 3 AS tw FROM part WHERE p_partkey % 10 <> 0) SELECT CASE WHEN tk IS NULL THEN 'unknown_criterion' WHEN k <> tk THEN 'kc_mismatch' WHEN w <> tw THEN 'weight_mismatch' ELSE 'ok' END AS status, count(*) AS n FROM j LEFT JOIN l ON l.c = j.c GROUP BY ALL",
    "focus_rates": "WITH r AS (SELECT l_linestatus, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'A' THEN 'Y' WHEN l_returnflag = 'R' THEN 'N' ELSE 'NA' END AS a FROM lineitem), c AS (SELECT l_linestatus, count(*) FILTER (a = 'Y') AS yes, count(*) FILTER (a = 'N') AS no, count(*) FILTER (a IS NULL OR a = 'NA') AS not_rated FROM r GROUP BY ALL) SELECT *, round(yes / nullif(yes + no, 0), 6) AS rate FROM c",
    "revelation_rates": "WITH r AS (SELECT l_returnflag, CASE l_linenumber % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'none' END AS rev, l_linestatus = 'O' AS w FROM lineitem) SELECT l_returnflag, count(*) AS n, round(avg(CASE WHEN rev <> 'none' THEN 1.0 ELSE 0.0 END), 6) AS revealed, round(avg(CASE WHEN rev <> 'none' AND NOT w THEN 1.0 ELSE 0.0 END), 6) AS unwarranted, round(avg(CASE WHEN rev = 'none' OR w THEN 1.0 WHEN rev = 'partial' THEN 0.5 ELSE 0.0 END), 6) AS solution_control FROM r GROUP BY ALL",
    "row_hashes": f"WITH {dialogue.TURNS} SELECT d, n, sha256(d || '|' || n || '|' || speaker || '|' || body) AS hash FROM turns",
    "variant_diff": "SELECT coalesce(arm, '') AS arm, count(*) AS n, count(*) FILTER (student.text = coalesce(tutor.text, '')) AS unchanged, count(*) FILTER (length(coalesce(tutor.text, '')) / nullif(length(student.text), 0) < 0.6) AS short FROM tutor_pairs GROUP BY ALL",
    "candidate_features": f"WITH {judging._P} SELECT exchange_id, unit_id, corroborated OR (families >= 2 AND nonlexical) AS dominant, round(least(4.0, 2.4 * score + 1.6 * coalesce(local_best_score, 0)), 6) AS lexical_component FROM pool25",
}
