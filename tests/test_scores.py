import json
import math

import pytest
from pyspark.sql import functions as F

from tutorgrain.operators import aggregate as A
from tutorgrain.operators import assign as G
from tutorgrain.operators import contracts as V
from tutorgrain.operators import stats as S


def test_null_is_not_zero(spark):
    df = spark.createDataFrame([("u", 1.0, 4.0, "applicable"), ("u", 0.0, 1.0, "applicable"), ("u", None, 9.0, "applicable"), ("u", 0.0, 9.0, "not_applicable"), ("v", None, 1.0, None)], "k string, score double, weight double, applicability string")
    assert {r.k: r.score for r in A.weighted_mean(df, ["k"]).collect()} == {"u": 0.8, "v": None}


def test_contributions_sum_to_the_score(spark):
    units = spark.createDataFrame([("t", "local", 1, 3, 0.5, None, 0.25), ("t", "local", 2, 1, None, 0.3, 0.25), ("t", "arc", 3, 2, None, None, 0.25)], "tutor string, family string, unit long, n long, k_score double, cap double, macro double")
    dims = spark.createDataFrame([(1, "a", 1.0, 1.0, "applicable"), (1, "b", 0.5, 3.0, "applicable"), (2, "a", 1.0, 2.0, "applicable"), (3, "c", 0.5, 1.0, "applicable")], "unit long, dimension string, score double, weight double, applicability string")
    total = A.provenance(units, dims, 0.8, 0.2, 0.6).agg(F.sum("contribution")).first()[0]
    u1, u2 = 0.8 * 0.625 + 0.2 * 0.5, 0.3
    want = 0.8 * (0.6 * (3 * u1 + u2) / 4 + 0.4 * 0.5) + 0.2 * 0.25
    assert total == pytest.approx(want, abs=1e-12)


def test_caps(spark):
    df = spark.createDataFrame([(0.95, "contradicted", 2), (0.95, "contradicted", 1), (0.95, "contradicted", 0), (0.95, "minor_issue", 0), (0.95, "supported", 0), (None, "contradicted", 2), (0.1, "contradicted", 1)], "s double, v string, m int")
    assert [r.x for r in df.select(A.trust_cap(F.col("s"), F.col("v"), F.col("m")).alias("x")).collect()] == [0.25, 0.5, 0.9, 0.9, 0.95, None, 0.1]


def test_exact_tests_match_enumeration(spark):
    df = spark.createDataFrame([(22, 7, 3, 1), (0, 0, 0, 0), (5, 5, 5, 5), (1, 9, 11, 3)], "a int, b int, c int, d int")
    got = df.select("a", "b", "c", "d", S.mcnemar_exact(F.col("a"), F.col("b")).alias("m"), S.fisher_exact(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("f")).collect()
    for r in got:
        n = r.a + r.b
        want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(r.a, r.b) + 1)) / 2**n)
        assert r.m == pytest.approx(want, rel=1e-9)
        p = lambda x, r=r: math.comb(r.a + r.b, x) * math.comb(r.c + r.d, r.a + r.c - x) / math.comb(r.a + r.b + r.c + r.d, r.a + r.c)
        xs = range(max(0, r.a - r.d), min(r.a + r.b, r.a + r.c) + 1)
        assert r.f == pytest.approx(min(1.0, sum(p(x) for x in xs if p(x) <= p(r.a) * (1 + 1e-9))), rel=1e-9)


def test_fisher_of_large_counts(spark):
    def want(a, b, c, d):
        f = [math.lgamma(x + 1) for x in range(a + b + c + d + 1)]
        p = lambda x: f[a + b] - f[x] - f[a + b - x] + f[c + d] - f[a + c - x] - f[c + d - a - c + x] + f[a + c] + f[b + d] - f[a + b + c + d]
        xs = range(max(0, a - d), min(a + b, a + c) + 1)
        return sum(math.exp(p(x)) for x in xs if p(x) <= p(a) + 1e-9)

    rows = [(1900, 58_000, 3900, 116_000), (30_000, 30_100, 30_050, 30_000), (40, 90_000, 10, 5), (0, 5, 7, 0)]
    df = spark.createDataFrame([*rows, (None, 1, 1, 1)], "a int, b int, c int, d int")
    got = {r.a: r.f for r in df.select("a", S.fisher_exact(*map(F.col, "abcd")).alias("f")).collect()}
    assert got.pop(None) is None
    assert got == {r[0]: pytest.approx(want(*r), rel=1e-6) for r in rows}


def test_jackknife_equals_leave_one_out(spark):
    pairs = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), ("b", "y"), ("b", "x"), ("c", "z")]

    def ari(p):
        from collections import Counter

        c2 = lambda c: sum(v * (v - 1) / 2 for v in c.values())
        i, a, b, n = c2(Counter(p)), c2(Counter(x for x, _ in p)), c2(Counter(y for _, y in p)), len(p) * (len(p) - 1) / 2
        return (i - a * b / n) / ((a + b) / 2 - a * b / n)

    reps = [ari(pairs[:k] + pairs[k + 1 :]) for k in range(len(pairs))]
    mean = sum(reps) / len(reps)
    se = math.sqrt((len(reps) - 1) / len(reps) * sum((r - mean) ** 2 for r in reps))
    conf = S.confusion(spark.createDataFrame([("g", a, b) for a, b in pairs], "g string, a string, b string"), "g", "a", "b")
    r = S.jackknife_ari(conf, "g").first()
    assert (r.ari, r.se) == (pytest.approx(ari(pairs), abs=1e-6), pytest.approx(se, abs=1e-6))


def test_resampling_is_the_same_for_any_partitioning(spark):
    df = spark.createDataFrame([("g", i, (i % 7 - 2) / 10) for i in range(60)], "g string, row long, v double")
    a = S.bootstrap_mean(df.repartition(1), "g", "row", "v", 50).first()
    b = S.bootstrap_mean(df.repartition(7), "g", "row", "v", 50).first()
    assert a == b and a.low <= a.mean <= a.high
    assert S.sign_flip(df, "g", "row", "v", 50).first() == S.sign_flip(df.repartition(5), "g", "row", "v", 50).first()
    assert S.bootstrap_mean(df.limit(5), "g", "row", "v", 20).first().low is None


def test_resampling_has_the_replicates_of_the_reference(spark):
    rows = [("g", i, 1.0) for i in range(12)] + [("h", i, d) for i, d in enumerate((0.5, -0.2, 0.3, 0.3, 0.1, -0.4, 0.2))]
    df = spark.createDataFrame(rows, "g string, row long, v double")
    p = {r.g: r for r in S.sign_flip(df, "g", "row", "v", 100_000).collect()}
    v = [d for g, _, d in rows if g == "h"]
    sums = [sum(x if k >> i & 1 else -x for i, x in enumerate(v)) for k in range(2 ** len(v))]
    assert p["g"].p_one == pytest.approx(1 / 2**12, abs=1e-4) and p["g"].p_two == pytest.approx(2 / 2**12, abs=2e-4)
    assert p["h"].p_one == pytest.approx(sum(s >= sum(v) - 1e-9 for s in sums) / len(sums), abs=0.01)
    assert p["h"].p_two == pytest.approx(sum(abs(s) >= abs(sum(v)) - 1e-9 for s in sums) / len(sums), abs=0.01)


def test_cluster_interval_and_permutation(spark):
    rows = [("g", k, (k * 37 % 101) / 100) for k in range(400) for _ in range(3)]  # three equal rows a cluster
    df = spark.createDataFrame(rows, "g string, k long, v double")
    r = S.bootstrap_mean(df, "g", "k", "v", 10_000, share=0.9875).first()
    m = sum(x for _, _, x in rows) / len(rows)
    se = math.sqrt(sum((x - m) ** 2 for _, _, x in rows) / len(rows) / 400)  # of 400 clusters, not of 1200 rows
    assert r.low == pytest.approx(m - 2.4977 * se, abs=0.15 * se) and r.high == pytest.approx(m + 2.4977 * se, abs=0.15 * se)
    from itertools import combinations

    v, first = [0.1, 0.2, 0.2, 0.5, 0.7, 0.9, 0.9], 3
    two = spark.createDataFrame([(x, i >= len(v) - first) for i, x in enumerate(v)], "v double, a boolean")
    gap = lambda pick: abs(sum(v[i] for i in pick) / first - sum(x for i, x in enumerate(v) if i not in pick) / (len(v) - first))
    gaps = [gap(c) for c in combinations(range(len(v)), first)]
    got = S.permutation_test(two, "a", "v", 20_000)
    assert got.first().p == pytest.approx(sum(g >= gap((4, 5, 6)) - 1e-12 for g in gaps) / len(gaps), abs=0.01) and got.first() == S.permutation_test(two.repartition(5), "a", "v", 20_000).first()
    assert S.permutation_test(two.where("a"), "a", "v", 100).first().p is None


@pytest.mark.parametrize(("query", "operator", "least"), [("sign_flip_p", "sign_flip", 100_000), ("bootstrap_ci", "bootstrap_mean", 10_000), ("cluster_bootstrap_ci", "bootstrap_mean", 10_000), ("permutation_p", "permutation_test", 20_000)])
def test_registered_replicates(monkeypatch, query, operator, least):
    from tutorgrain.plans import scores

    seen = []
    monkeypatch.setattr(S, operator, lambda *args, **more: seen.extend(x for x in args if isinstance(x, int)))
    monkeypatch.setattr(scores, "ratings", lambda *_: type("Rows", (), {"withColumn": lambda self, *_: self})())
    monkeypatch.setattr(scores, "F", type("Functions", (), {"col": staticmethod(lambda _: "")}))
    scores.QUERIES[query](None, "")
    assert seen == [least]


def row(idx, label, unit=None, **more):
    pool = [{"unit_id": u, "score": s, "ce": None, "eligible": e, "corroborated": False, "families": 1, "branch": b, "tutor_only": False} for u, s, e, b in more.pop("pool", [])]
    return {"idx": idx, "label": label, "unit_id": unit, "top1": 0.5, "broad": False, "top_share": 0.1, "pool": pool} | more


def test_context_pass():
    rows = [
        row(0, "AUTO_HIGH_KC", "A", pool=[("A", 0.9, True, "x")]),
        row(1, "NEEDS_PASS2", "B", pool=[("B", 0.5, False, "y"), ("A", 0.4, False, "x")]),
        row(2, "AUTO_MEDIUM_KC", "A", pool=[("A", 0.9, True, "x")]),
        row(3, "NEEDS_PASS2", "C", pool=[("C", 0.5, False, "z"), ("A", 0.8, False, "x")]),
        row(4, "NEEDS_PASS2", "D", pool=[("D", 0.5, False, "w")]),
        row(5, "NEEDS_NOVELTY_CHECK", None),
    ]
    out = G.resolve_context(rows)
    assert [(r["final"], r["resolved"]) for r in out] == [
        ("AUTO_HIGH_KC", "A"), ("AUTO_LOW_KC", "A"), ("AUTO_MEDIUM_KC", "A"), ("AUTO_LOW_KC", "A"), ("MISSING_KC_REVIEW", None), ("UNRESOLVED_AFTER_PASS1", None),
    ]
    assert out[1]["action"] == "pass2_same_neighbour_rescue" and out[3]["action"] == "pass2_left_context_continuation"


def test_segments_batch_equals_stream(spark, tmp_path):
    def r(i, final, kc, band, near=()):
        return ("d", i, final, kc, band, list(near))

    rows = [r(0, "AUTO_HIGH_KC", "A", "high"), r(1, "NON_KC", None, None), r(2, "AUTO_LOW_KC", "B", "low", ["A"]), r(3, "MISSING_KC_REVIEW", None, "missing_review"), r(4, "AUTO_HIGH_KC", "B", "high"), r(5, "AUTO_HIGH_KC", "B", "high"), r(6, "AUTO_MEDIUM_KC", "C", "medium", ["B"]), r(7, "AUTO_HIGH_KC", "D", "high")]
    schema = "dialogue string, idx int, final string, resolved string, band string, kc_set array<string>"
    df = spark.createDataFrame(rows, schema)
    batch = sorted((s.segment_no, s.dominant, list(s.members)) for s in G.segments(df).collect())
    assert batch == [(0, "A", [0, 1, 2]), (1, None, [3]), (2, "B", [4, 5, 6]), (3, "D", [7])]
    from tutorgrain.streaming.segments import stream_segments

    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = stream_segments(stream).writeStream.format("memory").queryName("segments_out").outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    got = sorted((s.segment_no, s.dominant, list(s.members)) for s in spark.table("segments_out").collect())
    assert got == batch[:3]  # the last segment stays open until the dialogue is silent


def valid_response():
    dims = {d: 1 for d in A.DIMENSIONS}
    return {
        "segment_id": "s", "evaluation_mode": "single_kc", "dimension_applicability": {d: "applicable" for d in A.DIMENSIONS}, "raw_dimension_scores": dims, "dimension_scores": dict(dims),
        "trust_flags": {f: 0 for f in V.TRUST_FLAGS}, "micro_score_raw": 0.5, "micro_score_dependency_adjusted": 0.5, "trust_adjusted_score": 0.5, "dependency_adjustments": [],
        "kc_grounding": {"primary_kc_used": True, "context_kcs_used": ["K"], "unsupported_or_wrong_kc_claims": []}, "flags": {}, "evidence_quotes": ["the slope is"], "rationale_short": "The tutor explains the slope well.",
    }


@pytest.mark.parametrize(("change", "code"), [
    ({}, None), ({"segment_id": "t"}, "segment_id_mismatch"), ({"micro_score_raw": 1.5}, "micro_score_raw:out_of_range_0_1"), ({"micro_score_raw": True}, "micro_score_raw:not_number"),
    ({"evidence_quotes": []}, "evidence_quotes:empty"), ({"evidence_quotes": ["never said"]}, "evidence_quotes:not_found_in_segment_text"), ({"rationale_short": "short"}, "rationale_short:too_short"),
    ({"trust_flags": {}}, "trust_flags.curriculum_hallucination:must_be_0_or_1"), ({"kc_grounding": {"primary_kc_used": 1, "context_kcs_used": ["Z"]}}, "kc_grounding.context_kcs_used:kc_not_in_packet"),
    ({"dependency_adjustments": [{"rule_id": "r", "applied": True, "reason": "long enough", "affected_dimensions": []}]}, "dependency_adjustments.affected_dimensions:empty_when_applied"),
])
def test_segment_contract(spark, change, code):
    text = json.dumps(valid_response() | change)
    df = spark.createDataFrame([(text, "s", "single_kc", "So the SLOPE  is two.".replace("SLOPE  is", "The slope is"), ["K"])], "t string, s string, m string, x string, u array<string>")
    errors = df.select(V.segment_errors(F.try_parse_json("t"), F.col("s"), F.col("m"), F.col("x"), F.col("u")).alias("e")).first().e
    assert (errors == []) if code is None else (code in errors)


def test_missing_fields_end_the_check(spark):
    df = spark.createDataFrame([("{}",), ("no",)], "t string")
    got = [r.e for r in df.select(V.segment_errors(F.try_parse_json("t"), F.lit("s"), F.lit("m"), F.lit(""), F.array(F.lit("K"))).alias("e")).collect()]
    assert all(e.startswith("missing_required_field") for e in got[0]) and len(got[0]) == 14 and got[1] == ["unparseable"]


def test_macro_scores_of_wrapped_and_repairable_responses(spark, tmp_path):
    from tutorgrain.plans import judging

    dims = A.MACRO_DIMENSIONS
    full = {"dialogue_id": "d", "dimension_scores": {m: 0.5 for m in dims}, "dimension_applicability": {m: "applicable" for m in dims}}
    text = json.dumps(full)
    loose = json.dumps(full | {"dialogue_id": "", "scale": 1, "dimension_scores": {m: " 1.0 " if m == dims[0] else "null" for m in dims}})
    rows = [(1, text), (2, f"```json\n{text}\n```"), (3, f"<think>{{x}}</think> My rating: {text} That is all."), (4, loose), (5, "no object"), (6, None), (7, text[:-9])]
    spark.createDataFrame([(i, "p", "d", t) for i, t in rows], "row_id long, judge_prompt_id string, dialogue_id string, raw_response_text string").write.parquet(f"{tmp_path}/raw_rows.parquet")
    got = {r.row_id: r.macro for r in judging.macro_means_extracted(spark, str(tmp_path)).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 0.5, 4: 1.0}
    scores = judging.macro_scores_extracted(spark, str(tmp_path)).where("row_id = 4").collect()
    assert {r.dimension: r.score for r in scores} == {m: 1.0 if m == dims[0] else None for m in dims}
    assert json.loads(V.macro_payload(loose, "d"))["dialogue_id"] == "d" and "scale" not in V.macro_payload(loose, "d")


def test_packets_get_all_criteria_and_three_references(spark):
    from tutorgrain.operators import packets as P

    packets = spark.createDataFrame([("s", "F", list("ABCDEF")), ("t", None, ["A", None]), ("u", None, None)], "segment_id string, lead string, units array<string>")
    criteria = spark.createDataFrame([(k, n, f"{k}{n}") for k in "BDEF" for n in (1, 2)] + [("A", 1, "A1")], "kc_id string, criterion_no int, criterion_id string")
    got = sorted((r.segment_id, r.unit_no, r.criterion_no, r.criterion_id) for r in P.criteria_for_packets(packets, criteria, primary="lead").collect())
    assert [x[3] for x in got] == ["F1", "F2", "A1", "B1", "B2", "D1", "D2", "E1", "E2", "A1"] and got[-1][0] == "t"
    references = spark.createDataFrame([("A", " "), ("B", None), ("C", "c"), ("D", "d"), ("E", "e"), ("F", "f")], "kc_id string, reference string")
    refs = sorted((r.segment_id, r.reference_no, r.kc_id) for r in P.references_for_packets(packets, references).collect())
    assert refs == [("s", 1, "C"), ("s", 2, "D"), ("s", 3, "E")]


def test_json_extraction_and_overlap():
    assert V.first_object("<think>{1}</think> so {bad} then {\"a\": {\"b\": 1}} end") == '{"a": {"b": 1}}'
    assert V.first_object(None) is None and V.first_object("none") is None
    assert V.longest_common("abcdef", "zzcdexx") == 3 and V.longest_common("", "a") == 0 and V.longest_common("same", "the same") == 4
