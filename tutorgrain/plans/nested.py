"""Queries of the two general data problems: nested records (3) and drifting schemas (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorgrain.operators import drift, flatten
from tutorgrain.session import table

_DRIFT = ("corpus", "file_name", "written_at", "payload")


#: What is known of the factuality records: keys of this object are data, and these places repeat even where a value is single.
MAPS = ("id_mapping.ledger_to_packet",)
LISTS = ("segments", "segments[].raw_row.contract_errors", "segments[].errors", "segments[].errors[].evidence")
SEGMENTS, ERRORS = "segments[]", "segments[].errors[]"
KINDS = {
    "id_mapping.ledger_to_packet{}": "ledger_pair", "segments[]": "segment", "segments[].raw_row.contract_errors[]": "contract_error",
    "segments[].errors[]": "error", "segments[].errors[].evidence[]": "evidence",
}


def _triples(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "factuality_runs")
    return flatten.triples(runs, "record_id", "record", flatten.discover(runs, "record", MAPS, LISTS))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = flatten.children(_triples(spark, d)).where(F.col("ancestor").isin(*KINDS))
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("ancestor")]
    return rows.select("record_id", kind.alias("child_kind"), "parent_key", "child_key")


def _table(ancestor: str, **fields: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return flatten.child_table(_triples(spark, d), ancestor, fields)

    return query


def p3_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Records that are no JSON; the reason names the place, so only the ids are compared."""
    return flatten.rejects(_triples(spark, d)).select("record_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.find_changes(table(spark, d, "assignment_lines"), *_DRIFT)


def p4_assignments(spark: SparkSession, d: str) -> DataFrame:
    return drift.unify(table(spark, d, "assignment_lines"), "line_id", "corpus", "file_name", "line_no", "written_at", "payload")


QUERIES = {
    "p3_found": p3_found,
    "p3_records": _table("$", corpus="corpus", preregistration="preregistration", units_clean="units.clean", units_corrupt="units.corrupt", uniform_offset="id_mapping.uniform_offset", note="id_mapping.note"),
    "p3_segments": _table("segments[]", segment_id="segment_id", json_extracted="raw_row.json_extracted"),
    "p3_errors": _table("segments[].errors[]", tutor_quote="tutor_quote", what_is_wrong="what_is_wrong", correct_version="correct_version", severity="severity"),
    "p3_evidence": _table("segments[].errors[].evidence[]", exchange_id="exchange_id", quote="quote"),
    "p3_contract_errors": _table("segments[].raw_row.contract_errors[]", error_code=""),
    "p3_ledger_pairs": _table("id_mapping.ledger_to_packet{}", packet_exchange=""),
    "p3_rejects": p3_rejects,
    "p4_found": p4_found,
    "p4_assignments": p4_assignments,
}


def _dec(x: str) -> str:
    """JSON encoded as text as what it encodes."""
    return f"(CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x} ->> '$') AND left(trim({x} ->> '$'), 1) IN ('{{', '[') THEN CAST({x} ->> '$' AS JSON) ELSE {x} END)"


def _list(x: str) -> str:
    """A value as a list: null has no elements, a single value is a list of one."""
    return f"(CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN CAST([] AS JSON[]) WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [{x}] END)"


_CHILDREN = f"""WITH r AS (SELECT record_id, CAST(record AS JSON) AS j FROM factuality_runs WHERE json_valid(record)),
m AS (SELECT record_id, {_dec("json_extract(j, '$.id_mapping')")} AS m, {_dec("json_extract(j, '$.segments')")} AS s FROM r),
l AS (SELECT record_id, {_dec("json_extract(m, '$.ledger_to_packet')")} AS l, {_list('s')} AS s FROM m),
ledger AS (SELECT record_id, unnest(json_keys(l)) AS k, l FROM l WHERE json_type(l) = 'OBJECT'),
seg AS (SELECT record_id, i, {_dec('s[i + 1]')} AS g FROM (SELECT record_id, s, unnest(generate_series(0, len(s) - 1)) AS i FROM l WHERE len(s) > 0)),
raw AS (SELECT record_id, i, g, {_dec("json_extract(g, '$.raw_row')")} AS w, {_dec("json_extract(g, '$.errors')")} AS e FROM seg),
pair AS (SELECT record_id, i, {_dec("json_extract(w, '$.contract_errors')")} AS c, {_list('e')} AS e FROM raw),
ce AS (SELECT record_id, i, c[k + 1] AS v, k FROM (SELECT record_id, i, c, unnest(generate_series(0, len(c) - 1)) AS k FROM (SELECT record_id, i, {_list('c')} AS c FROM pair) WHERE len(c) > 0)),
er AS (SELECT record_id, i, k, {_dec('e[k + 1]')} AS v FROM (SELECT record_id, i, e, unnest(generate_series(0, len(e) - 1)) AS k FROM pair WHERE len(e) > 0)),
ev0 AS (SELECT record_id, i, k, {_dec("json_extract(v, '$.evidence')")} AS x FROM er),
ev AS (SELECT record_id, i, k, x[n + 1] AS v, n FROM (SELECT record_id, i, k, x, unnest(generate_series(0, len(x) - 1)) AS n FROM (SELECT record_id, i, k, {_list('x')} AS x FROM ev0) WHERE len(x) > 0))"""


def _field(name: str, path: str, of: str = "v") -> str:
    return f"CASE WHEN json_type({of}, '$.{path}') <> 'NULL' THEN {of} ->> '$.{path}' END AS {name}"


SQL = {
    "p3_found": _CHILDREN + """ SELECT record_id, 'ledger_pair' AS child_kind, '' AS parent_key, k AS child_key FROM ledger
      UNION ALL SELECT record_id, 'segment', '', CAST(i AS VARCHAR) FROM seg UNION ALL SELECT record_id, 'contract_error', CAST(i AS VARCHAR), CAST(k AS VARCHAR) FROM ce
      UNION ALL SELECT record_id, 'error', CAST(i AS VARCHAR), CAST(k AS VARCHAR) FROM er UNION ALL SELECT record_id, 'evidence', i || '.' || k, CAST(n AS VARCHAR) FROM ev""",
    "p3_records": f"WITH r AS (SELECT record_id, CAST(record AS JSON) AS j FROM factuality_runs WHERE json_valid(record)), x AS (SELECT record_id, j, {_dec("json_extract(j, '$.units')")} AS u, {_dec("json_extract(j, '$.id_mapping')")} AS m FROM r) SELECT record_id, "
    + ", ".join([_field("corpus", "corpus", "j"), _field("preregistration", "preregistration", "j"), _field("units_clean", "clean", "u"), _field("units_corrupt", "corrupt", "u"), _field("uniform_offset", "uniform_offset", "m"), _field("note", "note", "m")]) + " FROM x",
    "p3_segments": _CHILDREN + " SELECT record_id, '' AS parent_key, CAST(i AS VARCHAR) AS child_key, " + _field("segment_id", "segment_id", "g") + ", " + _field("json_extracted", "json_extracted", "w") + " FROM raw",
    "p3_rejects": "SELECT record_id FROM factuality_runs WHERE record IS NULL OR NOT json_valid(record)",
    "p3_errors": _CHILDREN + " SELECT record_id, CAST(i AS VARCHAR) AS parent_key, CAST(k AS VARCHAR) AS child_key, " + ", ".join(_field(c, c) for c in ("tutor_quote", "what_is_wrong", "correct_version", "severity")) + " FROM er",
    "p3_evidence": _CHILDREN + " SELECT record_id, i || '.' || k AS parent_key, CAST(n AS VARCHAR) AS child_key, " + ", ".join(_field(c, c) for c in ("exchange_id", "quote")) + " FROM ev",
    "p3_contract_errors": _CHILDREN + " SELECT record_id, CAST(i AS VARCHAR) AS parent_key, CAST(k AS VARCHAR) AS child_key, v ->> '$' AS error_code FROM ce",
    "p3_ledger_pairs": _CHILDREN + " SELECT record_id, '' AS parent_key, k AS child_key, l ->> ('$.' || k) AS packet_exchange FROM ledger",
}
