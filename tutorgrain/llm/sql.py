"""DuckDB statements that compute what the queries of this subpackage compute, where SQL can."""

from tutorgrain.llm.conversations import SPEAKERS

P1_FOUND = """
WITH first_rows AS (
  SELECT exchange_id, unit_id, best_score, fused_rank,
         row_number() OVER (PARTITION BY exchange_id, unit_id ORDER BY best_score DESC, fused_rank ASC NULLS LAST) AS k
  FROM candidate_hits
  WHERE best_score IS NOT NULL AND NOT isnan(best_score) AND exchange_id IS NOT NULL AND unit_id IS NOT NULL
), ranked AS (
  SELECT exchange_id, unit_id, best_score, fused_rank,
         row_number() OVER (PARTITION BY exchange_id ORDER BY best_score DESC, fused_rank ASC NULLS LAST, unit_id) AS position
  FROM first_rows WHERE k = 1
)
SELECT exchange_id, unit_id FROM ranked WHERE position <= 5
"""

P1_RANKED = P1_FOUND.replace(
    "SELECT exchange_id, unit_id FROM ranked",
    "SELECT exchange_id, unit_id, best_score, fused_rank, CAST(position AS INTEGER) AS position FROM ranked",
)

_TURNS = r"""
WITH named AS (
  SELECT coalesce(dialogue_id, nullif(split_part(turn_id, '::', 1), '')) AS d,
         TRY_CAST(nullif(regexp_extract(turn_id, '([0-9]+)\s*$', 1), '') AS BIGINT) AS n,
         regexp_replace(lower(role), '[\s\x{00A0}:.\[\](){}<>*_-]+', '', 'g') AS name,
         nullif(trim(regexp_replace(text, '[\s\x{00A0}\x{1680}\x{2000}-\x{200D}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]+', ' ', 'g')), '') AS body
  FROM turn_rows
), said AS (
  SELECT d, n, body, CASE WHEN name IN (@student) THEN 'student' WHEN name IN (@tutor) THEN 'tutor'
    WHEN name IN (@system) THEN 'system' ELSE '?' END AS who
  FROM named WHERE d IS NOT NULL
), turns AS (
  SELECT d, n, min(who) AS who, min(body) AS body,
         min(who) <> max(who) OR coalesce(min(body) <> max(body), false) OR bool_or(who = '?') AS clash
  FROM said GROUP BY d, n
), events AS (
  SELECT d, n, CASE WHEN who = 'student' THEN 1 WHEN who = 'tutor' AND body IS NOT NULL THEN 2 ELSE 0 END AS kind FROM turns
), following AS (
  SELECT d, n, kind, lead(kind) OVER w AS next_kind, lead(n) OVER w AS next_n
  FROM events WHERE kind > 0 WINDOW w AS (PARTITION BY d ORDER BY n)
), unanswered AS (
  SELECT DISTINCT d FROM following
  WHERE kind = 1 AND (next_kind IS NULL OR (next_kind = 1 AND next_n <> n + 1))
), judged AS (
  SELECT t.d, CASE WHEN count(body) = 0 THEN 'empty'
    WHEN bool_or(clash) OR bool_or(n IS NULL) OR min(n) <> 0 OR max(n) + 1 <> count(*) THEN 'broken'
    WHEN bool_or(u.d IS NOT NULL) THEN 'missing_reply' END AS defect
  FROM turns t LEFT JOIN unanswered u ON u.d = t.d GROUP BY t.d
)
"""
for _who, _names in SPEAKERS.items():
    _TURNS = _TURNS.replace(f"@{_who}", ",".join(f"'{n}'" for n in _names.split()))

P6_FOUND = _TURNS + "SELECT d AS dialogue_id, defect AS defect_type FROM judged WHERE defect IS NOT NULL"

P6_TURNS = (
    _TURNS
    + "SELECT t.d AS dialogue_id, row_number() OVER (PARTITION BY t.d ORDER BY t.n) - 1 AS position, t.n AS turn_no, t.who AS speaker, t.body AS text FROM turns t JOIN judged j ON j.d = t.d WHERE j.defect IS NULL"
)

#: What holds of any right packing; the packing itself has no single right answer.
P7_FAULTS = """
SELECT count(*) AS n_texts, 0 AS texts_missing, 0 AS pieces_repeated, 0 AS pieces_missing, 0 AS containers_over_capacity,
       0 AS fills_wrong, 0 AS positions_wrong, 0 AS containers_in_two_groups
FROM documents
"""
