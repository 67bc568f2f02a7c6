import datetime
import itertools
import json

from tutorgrain.operators.drift import find_changes, match, tokens_of, unify

SCHEMA = "line_id long, corpus string, file_name string, line_no int, written_at timestamp, payload string, file string, field string"
DAY = datetime.datetime(2026, 1, 1)


def lines(spark, *files, corpus="c"):
    ids = itertools.count()
    rows = [
        (next(ids), corpus, f"{name}", n, DAY + datetime.timedelta(days=day), p if isinstance(p, str) or p is None else json.dumps(p), "x", "y")
        for day, (name, payloads) in enumerate(files)
        for n, p in enumerate(payloads)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return sorted(tuple(r) for r in find_changes(df, "corpus", "file_name", "written_at", "payload").collect())


def test_rename_retype_add_remove(spark):
    a = [{"resolved_kc_id": f"KC_A_{i:03}", "score": 0.1234 + i, "old_note": "gone"} for i in range(20)]
    b = [{"primary_kc_id": f"KC_A_{i + 5:03}", "score": str(0.1234 + i), "n_hits": i + 2} for i in range(20)]
    assert found(lines(spark, ("z", a), ("b", b))) == [
        ("b", "added", "", "n_hits"), ("b", "removed", "old_note", ""), ("b", "renamed", "resolved_kc_id", "primary_kc_id"), ("b", "retyped", "score", "score"),
    ]


def test_null_values_do_not_make_a_field(spark):
    assert found(lines(spark, ("a", [{"x": 1, "y": None}]), ("b", [{"x": 2, "y": 3}, {"x": None}]))) == [("b", "added", "", "y")]


def test_unreadable_lines_and_repeats(spark):
    assert found(lines(spark, ("a", [{"x": 1}, "{broken", "", None, "[1]"]), ("b", [{"x": 1}, {"x": 1}]))) == []
    assert found(lines(spark, ("a", [{"x": 1}]), ("b", ["{", None]), ("c", [{"x": 1}]))) == [("b", "removed", "x", ""), ("c", "added", "", "x")]


def test_order_is_by_time_and_corpus(spark):
    df = lines(spark, ("z", [{"x": 1}]), ("a", [{"x": 1, "y": "t"}]))
    assert found(df) == [("a", "added", "", "y")]
    assert found(df.unionByName(lines(spark, ("q", [{"other": True}]), corpus=None))) == [("a", "added", "", "y")]
    assert found(df.limit(0)) == []


def test_same_values_by_meaning():
    assert tokens_of("2026-02-25T18:09:04Z")[0] == tokens_of(1772042944000)[0]
    assert tokens_of(True)[0][0] == tokens_of("yes")[0][0] == "1"
    assert tokens_of("0.50")[0] == tokens_of(0.5)[0]
    assert tokens_of(["A_1", "B_2"]) == tokens_of("A_1;B_2")


def test_matching_takes_the_best_pairs_overall(spark):
    assert sorted(match([("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.8), ("b", "y", 0.55), ("c", "x", 0.4)])) == [("a", "y"), ("b", "x")]
    assert match([]) == [] and match([("a", "x", 0.4)]) == []
    ids, names = [f"KC_{i:03}" for i in range(30)], [f"name {'abc'[i % 3]}" for i in range(30)]
    a = [{"top_kc_id": i, "kc_name": n} for i, n in zip(ids, names)]
    b = [{"main_kc_name": n, "main_kc_id": i, "flag": k % 2 == 0} for k, (i, n) in enumerate(zip(ids, names))]
    assert found(lines(spark, ("a", a), ("b", b))) == [("b", "added", "", "flag"), ("b", "renamed", "kc_name", "main_kc_name"), ("b", "renamed", "top_kc_id", "main_kc_id")]


def test_unified_table(spark):
    a = [{"resolved_kc_id": f"KC_A_{i:03}", "done": True, "at": "2026-02-25T18:09:04Z", "line_no": i} for i in range(20)]
    b = [{"primary_kc_id": {"id": f"KC_A_{i + 5:03}", "name": "n"}, "done": "no", "at": 1772042944000, "line_no": i} for i in range(20)]
    c = [{"primary_kc_id": f"KC_A_{i + 5:03}", "done": 0, "at": 1772042944000} for i in range(20)] + ["{bad"]
    df = lines(spark, ("a", a), ("b", [x | {"primary_kc_id": x["primary_kc_id"]["id"]} for x in b]), ("c", c))
    out = unify(df, "line_id", "corpus", "file_name", "line_no", "written_at", "payload")
    assert "line_no_field" in out.columns
    rows = {r.line_id: r for r in out.collect()}
    name = "primary_kc_id"
    assert len(rows) == 61 and rows[0][name] == "KC_A_000" and rows[20][name] == "KC_A_005" and rows[60][name] is None
    assert rows[0].done is True and rows[20].done is False and rows[45].done is False
    assert rows[0]["at"] == rows[20]["at"] == datetime.datetime(2026, 2, 25, 18, 9, 4)


def test_unified_values_stay_as_they_are(spark):
    """One value of another kind keeps a column text; nothing is dropped or rewritten in it."""
    text = ["", "007", "N", "1500000000", "x y"]
    a = [{"t": v, "l": ["a;b", "c"], "e": 1500000000 + i, "ms": 1700000000123, "Case": 1, "case": 2} for i, v in enumerate(text)]
    a[0]["ms"] = "2026-02-25T18:09:04.5Z"
    b = [{"t": 7, "l": "A_1;B_2"}, {"t": ["p", 1], "l": "free; text"}, {"t": {"k": True}}, {"t": False}]
    out = unify(lines(spark, ("a", a), ("b", b)), "line_id", "corpus", "file_name", "line_no", "written_at", "payload")
    rows = [r for r in out.orderBy("line_id").collect()]
    assert [r.t for r in rows] == [*text, "7", '["p", 1]', '{"k": true}', "false"]
    assert [r.l for r in rows[4:7]] == ['["a;b", "c"]', '["A_1", "B_2"]', '["free; text"]']
    assert dict(out.dtypes)["e"] == "bigint" and rows[0].e == 1500000000
    assert rows[1].ms == datetime.datetime(2023, 11, 14, 22, 13, 20, 123000) and rows[0].ms.microsecond == 500000
    assert {c for c in out.columns if c.lower().startswith("case")} == {"Case", "case_field"}


def test_both_names_of_a_renamed_field_in_one_line(spark):
    a = [{"resolved_kc_id": f"KC_A_{i:03}"} for i in range(20)]
    b = [{"primary_kc_id": f"KC_A_{i + 5:03}"} for i in range(20)]
    c = [{"primary_kc_id": "KC_A_001", "resolved_kc_id": "KC_A_002"}]
    out = unify(lines(spark, ("a", a), ("b", b), ("c", c)), "line_id", "corpus", "file_name", "line_no", "written_at", "payload")
    last = out.where("line_id = 40").first()
    assert last.primary_kc_id == "KC_A_001" and last._also == {"resolved_kc_id": '"KC_A_002"'}


def test_very_deep_lines_keep_their_fields(spark):
    deep = '{"x": 1, "y": %s, "z": "t"}' % ("[" * 50_000 + "]" * 50_000)
    df = lines(spark, ("a", [{"x": 1}]), ("b", [deep]))
    assert found(df) == [("b", "added", "", "y"), ("b", "added", "", "z")]
    row = unify(df, "line_id", "corpus", "file_name", "line_no", "written_at", "payload").where("line_id = 1").first()
    assert row.x == 1 and row.z == "t" and row.y == "[" * 50_000 + "]" * 50_000


def test_rank_of_groups(spark):
    from pyspark.sql import functions as F

    from tutorgrain.operators.ranks import distributed_rank

    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, "hot").alias("g"), (-F.col("id")).alias("v"))
    got = distributed_rank(df, ["g"], ["v"], "k").collect()
    for g in ("hot", None):
        mine = sorted((r.v, r.k) for r in got if r.g == g)
        assert [k for _, k in mine] == list(range(1, len(mine) + 1))
