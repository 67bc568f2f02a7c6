import json

from tutorgrain.operators.flatten import Shape, child_table, children, discover, events, rejects, shape_of, tables, triples
from tutorgrain.plans.nested import KINDS, LISTS, MAPS

SCHEMA = "record_id long, record string, ancestor string, value_type string"


def found(spark, *records, maps=MAPS, lists=LISTS):
    df = spark.createDataFrame([(i, r, "x", "y") for i, r in enumerate(records)], SCHEMA)
    return triples(df, "record_id", "record", discover(df, "record", maps, lists))


def kids(spark, *records):
    rows = children(found(spark, *records)).collect()
    return sorted((*(() if len(records) == 1 else (r[0],)), KINDS.get(r[1], r[1]), r[2], r[3]) for r in rows)


def test_children_of_all_kinds(spark):
    record = json.dumps({
        "id_mapping": {"ledger_to_packet": {"ex_2": None, "ex_1": "ex_0"}},
        "segments": [
            {"raw_row": {"contract_errors": ["a", "a"]}, "errors": [{"evidence": [{"quote": "q"}, {}]}, {}]},
            {"raw_row": json.dumps({"contract_errors": "single"}), "errors": json.dumps({"severity": "minor"})},
        ],
    })
    assert kids(spark, record) == sorted([
        ("ledger_pair", "", "ex_2"), ("ledger_pair", "", "ex_1"), ("segment", "", "0"), ("segment", "", "1"),
        ("contract_error", "0", "0"), ("contract_error", "0", "1"), ("contract_error", "1", "0"),
        ("error", "0", "0"), ("error", "0", "1"), ("error", "1", "0"), ("evidence", "0.0", "0"), ("evidence", "0.0", "1"),
    ])


def test_missing_null_empty_and_broken(spark):
    records = ("", "   ", "no json", "{", "[]", "null", '"text"', "{}", '{"segments": null}', '{"segments": []}', '{"segments": "null"}', '{"id_mapping": 3}', None)
    assert kids(spark, *records) == []
    lost = {r.record_id: r.reason for r in rejects(found(spark, *records)).collect()}
    assert lost == {0: "blank", 1: "blank", 2: "no JSON at 0", 3: "no JSON at 1", 12: "null"}


def test_odd_shapes(spark):
    records = ('{"segments": {"errors": null}}', '{"segments": [null, 5, "text"]}', json.dumps(json.dumps({"segments": [{}]})), '{"segments": [{"errors": [null]}]}')
    assert kids(spark, *records) == sorted([(0, "segment", "", "0"), *[(1, "segment", "", str(i)) for i in range(3)], (2, "segment", "", "0"), (3, "error", "0", "0"), (3, "segment", "", "0")])


def test_tables_link_to_parents(spark):
    t = found(spark, json.dumps({"segments": [{"segment_id": "s", "errors": [{"severity": "minor", "evidence": [{"quote": "q" * 50000}]}]}]}))
    row = child_table(t, "segments[].errors[].evidence[]", {"quote": "quote", "ancestor": "none"}).first()
    assert (row.parent_key, row.child_key, len(row.quote), row["ancestor"]) == ("0.0", "0", 50000, None)
    assert child_table(t, "segments[].errors[]", {"severity": "severity"}).first().severity == "minor"
    assert child_table(t, "segments[]", {}).count() == 1


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, '{"segments": [{}]}'), (1, '{"segments": [{}]}')], "record_id long, record string")
    shape = discover(df, "record")
    assert children(triples(df, "record_id", "record", shape)).count() == 2
    empty = df.limit(0)
    assert children(triples(empty, "record_id", "record", discover(empty, "record"))).count() == 0


def test_repeated_places_of_an_unknown_shape_are_found(spark):
    orders = [{"no": i, "buyer": {"name": f"b{i}", "tags": ["x", "y"]}, "lines": [{"sku": "a.b", "qty": 2, "lots": [[1, 2], [3]]}, {"sku": "c"}]} for i in range(3)]
    orders += [{"no": 9, "lines": {"sku": "alone"}, "buyer": None, "parent_key": True}]
    df = spark.createDataFrame([(i, json.dumps(o), "", "") for i, o in enumerate(orders)], SCHEMA)
    shape = discover(df, "record")
    assert shape.lists == {"buyer.tags", "lines", "lines[].lots", "lines[].lots[]"}
    out = tables(triples(df, "record_id", "record", shape), shape)
    assert set(out) == {"$", "buyer.tags[]", "lines[]", "lines[].lots[]", "lines[].lots[][]"}
    assert sorted(out["$"].columns) == ["buyer.name", "no", "parent_key_field", "record_id"]
    assert sorted(map(tuple, out["lines[]"].select("record_id", "child_key", "sku", "qty").collect()))[-2:] == [(2, "1", "c", None), (3, "0", "alone", None)]
    assert sorted(map(tuple, out["lines[].lots[][]"].where("record_id = 1").select("parent_key", "child_key", "value").collect())) == [("0.0", "0", "1"), ("0.0", "1", "2"), ("0.1", "0", "3")]
    assert out["buyer.tags[]"].count() == 6


def test_no_depth_loses_a_record(spark):
    deep_list, deep_object = "[" * 50_000 + "]" * 50_000, '{"a":' * 5_000 + "1" + "}" * 5_000
    t = found(spark, deep_list, '{"a": %s}' % deep_object, maps=(), lists=())
    kept = t.where("value_type IN ('array', 'object') AND value IS NOT NULL").orderBy("record_id").collect()
    assert [r.record_id for r in kept] == [0, 1] and rejects(t).count() == 0
    assert len(kept[0].value) > 90_000 and kept[1].value.count("{") > 4_900


def test_rare_lists_stay_text_and_rare_json_text_stays_itself():
    shape = shape_of([("", "object", 9), ("note", "string", 8), ("note", "array", 1), ("note[]", "number", 2), ("tags", "array", 5), ("tags", "string", 4), ("tags[]", "string", 3)])
    assert shape.lists == {"tags"} and "note" not in shape.encoded and shape.fields["$"] == ["note"]
    from tutorgrain.operators.flatten import Shredder

    reader = Shredder(shape, frozenset(), 64)
    reader.read('{"note": [1, {"x": 2}], "tags": "t", "note2": "[1]"}')
    assert reader.out == [("$", "", "", "", None, "object"), ("$", "", "", "note", '[1, {"x": 2}]', "array"), ("tags[]", "", "0", "", "t", "string"), ("$", "", "", "note2", "[1]", "string")]


def test_repeated_keys_count_with_their_last_value_and_special_names():
    from tutorgrain.operators.flatten import Shredder

    reader = Shredder(Shape(frozenset({"a"}), frozenset({"m"}), frozenset({""})), frozenset(), 64)
    reader.read('{"a": [1, 2], "m": {"x.y": [7], "x.y": {"k": 1}}, "a": [3], "b.c[]": "\\ud800"}')
    kept = [t for t in reader.out if t is not None]
    assert [t[:5] for t in kept if t[0] == "a[]"] == [("a[]", "", "0", "", "3")]
    assert [t[:5] for t in kept if t[0] == "m{}"] == [("m{}", "", "x.y", "", None), ("m{}", "", "x.y", "k", "1")]
    assert kept[-1][3] == r"b\.c\[\]"


def test_events_reject_what_json_rejects():
    for text in ("", "[1,]", '{"a" 1}', "01", "[1 2]", '{"a":1,}', "{a:1}", "[}", "1 2", '"a\nb"', '["open', "-", "1.", "tru"):
        try:
            list(events(text))
        except ValueError:
            continue
        raise AssertionError(text)


def test_verdicts_of_segments(spark):
    from tutorgrain.plans.judging import _verdicts

    record = json.dumps({"segments": [
        {"errors": [{"severity": "minor"}, {}]}, {"errors": [{"severity": None}, {"severity": "Material"}]}, {"errors": []}, {}, None,
        {"errors": json.dumps({"severity": "material"})}, {"errors": [None]},
    ]})
    got = sorted((r.segment_no, r.verdict, r.material) for r in _verdicts(found(spark, record)).collect())
    assert got == [("0", "minor_issue", 0), ("1", "contradicted", 1), ("2", "supported", 0), ("3", "supported", 0), ("4", "supported", 0), ("5", "contradicted", 1), ("6", "minor_issue", 0)]
    df = spark.createDataFrame([(1, record, "", ""), (1, '{"segments": [{}]}', "", "")], SCHEMA)
    rows = [r.segment_no for r in _verdicts(triples(df, "record_id", "record", discover(df, "record", MAPS, LISTS))).collect()]
    assert sorted(rows) == ["0", "0", "1", "2", "3", "4", "5", "6"]


def test_error_queries_count_every_error(spark):
    from tutorgrain.plans import checking, judging, nested

    d = "/root/testdata/sf0.001"
    errors = nested.QUERIES["p3_errors"](spark, d)
    n = errors.count()
    assert n > 0 and sum(r.n for r in checking.definition_conflicts(spark, d).collect()) == n
    codes = {r.code: r.n for r in checking.factuality_contract(spark, d).collect()}
    material = errors.where("lower(severity) = 'material'").count()
    assert codes["ok"] <= n and sum(codes.values()) >= n
    assert sum(r.material for r in judging.factuality_verdicts(spark, d).collect()) == material
