"""Queries on dialogues: normalisation, exchanges, gates and focus targets (with DuckDB statements)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorgrain.functions import text as T
from tutorgrain.operators import exchanges as X
from tutorgrain.session import table


def turns(spark: SparkSession, d: str) -> DataFrame:
    return X.dialogue_turns(table(spark, d, "turn_rows"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    return X.run_exchanges(turns(spark, d))


def norm_turns(spark, d):
    return turns(spark, d).select("d", "n", "speaker", "body")


def noise_flags(spark, d):
    return turns(spark, d).select("d", "n", F.array_join("flags", ",").alias("flags"))


def style_tags(spark, d):
    t = turns(spark, d)
    return t.select("d", "n", F.array_join(T.style_tags(F.col("speaker"), F.col("body")), ",").alias("tags"))


def filler_strip(spark, d):
    t = turns(spark, d).withColumn("raw", T.light_tokens(F.col("body"))).withColumn("kept", T.without_fillers(F.col("raw")))
    return t.select(
        "d", "n", F.array_join("kept", " ").alias("match_text"), F.size("raw").cast("bigint").alias("raw_tokens"),
        F.size("kept").cast("bigint").alias("match_tokens"),
    )


def preview_turns(spark, d):
    return turns(spark, d).select("d", "n", T.preview(F.col("body"), 60).alias("preview"))


def exchanges_runs(spark, d):
    return runs(spark, d).drop("flags")


def exchange_context(spark, d):
    return X.with_context(runs(spark, d)).select("exchange_id", "left_context", "right_context")


def exchanges_strict(spark, d):
    return X.strict_pairs(turns(spark, d))[0]


def pairing_violations(spark, d):
    return X.strict_pairs(turns(spark, d))[1]


def exchanges_greedy(spark, d):
    return X.greedy_exchanges(turns(spark, d))


def norm_audit(spark, d):
    t = turns(spark, d)
    return X.normalization_audit(t, X.run_exchanges(t))


def rebuilt_dialogues(spark, d):
    return X.rebuilt_turns(runs(spark, d))


def gate_non_kc(spark, d):
    text = T.strip(F.concat_ws(" ", "student_text", "tutor_text"))
    return runs(spark, d).select("exchange_id", T.gate(text, F.col("flags")).alias("gate_type"))


def focus_target(spark, d):
    return X.focus_pattern(runs(spark, d), "d", "exchange_index")


QUERIES = {f.__name__: f for f in (norm_turns, noise_flags, style_tags, filler_strip, preview_turns, exchanges_runs, exchange_context, exchanges_strict, pairing_violations, exchanges_greedy, norm_audit, rebuilt_dialogues, gate_non_kc, focus_target)}


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _any(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({column}, '" + p.replace("'", "''") + "')" for p in phrases) + ")"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_STRIP = r"regexp_replace({0}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"


def _norm(column: str) -> str:
    inner = f"regexp_replace(coalesce({column}, ''), '\\r\\n?', chr(10), 'g')"
    inner = f"regexp_replace({inner}, '[ \\t]+', ' ', 'g')"
    return _STRIP.format(f"regexp_replace({inner}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


_WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"
_FLAGS = (
    "CASE WHEN body = '' THEN ['empty_or_near_empty'] ELSE list_filter(["
    f"CASE WHEN lower(body) IN {_list(T.SHORT_ACKS)} THEN 'acknowledgement_only' END, "
    f"CASE WHEN lower(body) IN {_list(T.GREETINGS)} THEN 'greeting_only' END, "
    f"CASE WHEN {_WORDS.format('lower(body)')} <= 2 AND NOT regexp_matches(body, '[0-9]') AND NOT contains(body, '?') THEN 'low_content_short' END"
    "], lambda x: x IS NOT NULL) END"
)
TURNS = f"""
turns0 AS (
  SELECT coalesce(dialogue_id, split_part(turn_id, '::', 1)) AS d, TRY_CAST(regexp_extract(turn_id, '([0-9]+)$', 1) AS INTEGER) AS n, row_id, role, text
  FROM turn_rows
), turns1 AS (
  SELECT d, n, CASE WHEN lower(trim(role)) IN {_list(T.STUDENT_LABELS)} THEN 'student' WHEN lower(trim(role)) IN {_list(T.TUTOR_LABELS)} THEN 'tutor' ELSE 'unknown' END AS speaker,
         {_norm('text')} AS body
  FROM turns0 WHERE n IS NOT NULL AND d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY d, n ORDER BY row_id) = 1
), turns AS (SELECT *, {_FLAGS} AS flags FROM turns1)
"""
RUNS = TURNS + f""", starts AS (
  SELECT *, lag(speaker) OVER w AS before FROM turns WINDOW w AS (PARTITION BY d ORDER BY n)
), grouped AS (
  SELECT *, sum(CASE WHEN before IS NULL OR (speaker = 'student' AND before <> 'student') OR (speaker = 'tutor' AND before NOT IN ('student', 'tutor'))
             OR (speaker = 'unknown' AND before <> 'unknown') THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY n) - 1 AS g FROM starts
), runs0 AS (
  SELECT d, g, min(n) AS turn_start, max(n) AS turn_end, string_agg(upper(speaker[1]), '' ORDER BY n) AS roles_pattern,
    coalesce(string_agg(body, chr(10) ORDER BY n) FILTER (speaker = 'student' AND body <> ''), '') AS s,
    coalesce(string_agg(body, chr(10) ORDER BY n) FILTER (speaker = 'tutor' AND body <> ''), '') AS t,
    count(*) FILTER (speaker = 'student') AS ns, count(*) FILTER (speaker = 'tutor') AS nt, count(*) FILTER (speaker = 'unknown') AS nu,
    flatten(list(flags)) AS flags
  FROM grouped GROUP BY d, g
), runs AS (
  SELECT d, CAST(g AS INTEGER) AS exchange_index, d || '::ex_' || printf('%04d', CAST(g AS BIGINT)) AS exchange_id, turn_start, turn_end, roles_pattern,
    {_norm('s')} AS student_text, {_norm('t')} AS tutor_text,
    CASE WHEN nu > 0 THEN 'unknown_speaker_present' WHEN ns = 0 THEN 'missing_student' WHEN nt = 0 THEN 'missing_tutor'
         WHEN s = '' OR t = '' THEN 'empty_exchange_text' ELSE 'ok' END AS status, flags
  FROM runs0
)
"""  # fmt: skip
_STRICT = TURNS + """, pos AS (
  SELECT *, row_number() OVER (PARTITION BY d ORDER BY n) - 1 AS p FROM turns
), pairs AS (
  SELECT d, p // 2 AS pair, count(*) AS c, max(speaker) FILTER (p % 2 = 0) AS a, max(speaker) FILTER (p % 2 = 1) AS b,
    min(n) AS turn_start, max(n) AS turn_end, max(body) FILTER (p % 2 = 0) AS student_text, max(body) FILTER (p % 2 = 1) AS tutor_text
  FROM pos GROUP BY d, p // 2
), verdict AS (
  SELECT d, CAST(sum(c) AS BIGINT) AS turns, count(*) FILTER (NOT coalesce(a = 'student' AND b = 'tutor', false)) AS bad_pairs FROM pairs GROUP BY d
)
"""


def _style(tags: dict, socratic: bool) -> str:
    cells = []
    for tag, phrases in tags.items():
        extra = "contains(t, '?') AND " if socratic and tag == "socratic_questioning" else ""
        cells.append(f"CASE WHEN {extra}{_any('t', phrases)} THEN '{tag}' END")
    return "list_filter([" + ", ".join(cells) + "], lambda x: x IS NOT NULL)"


def _phrases_removed(column: str) -> str:
    out = f"' ' || {column} || ' '"
    for p in T.DISCOURSE_PHRASES:
        out = f"regexp_replace({out}, '(?i)\\b{p}\\b', ' ', 'g')"
    return out


_GATE_TEXT = _STRIP.format("student_text || ' ' || tutor_text")
_S, _T = _STRIP.format("student_text"), _STRIP.format("tutor_text")


def _re(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_quoted('(?i)' + pattern)})"


SQL = {
    "norm_turns": f"WITH {TURNS} SELECT d, n, speaker, body FROM turns",
    "noise_flags": f"WITH {TURNS} SELECT d, n, array_to_string(flags, ',') AS flags FROM turns",
    "style_tags": f"""WITH {TURNS}, low AS (SELECT d, n, speaker, lower(body) AS t FROM turns),
      marked AS (SELECT *, {_style(T.STUDENT_STYLES, False)} AS st, {_style(T.TUTOR_STYLES, True)} AS tt FROM low)
      SELECT d, n, CASE WHEN speaker = 'student' THEN array_to_string(st, ',') WHEN speaker = 'tutor' AND len(tt) > 0 THEN array_to_string(tt, ',')
        WHEN speaker = 'tutor' AND {_any('t', T.EXPLANATION_CUES)} THEN 'direct_explanation' ELSE '' END AS tags FROM marked""",
    "filler_strip": f"""WITH {TURNS}, tok AS (SELECT d, n, regexp_extract_all({_phrases_removed('body')}, '[A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+)?') AS raw FROM turns),
      kept AS (SELECT *, list_filter(raw, lambda w: lower(w) NOT IN {_list(T.FILLER_WORDS)} OR regexp_matches(w, '[0-9_/-]') OR (regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]'))) AS k FROM tok)
      SELECT d, n, array_to_string(k, ' ') AS match_text, len(raw) AS raw_tokens, len(k) AS match_tokens FROM kept""",
    "preview_turns": f"""WITH {TURNS}, flat AS (SELECT d, n, {_STRIP.format("regexp_replace(body, '\\s+', ' ', 'g')")} AS f FROM turns)
      SELECT d, n, CASE WHEN length(f) <= 60 THEN f ELSE rtrim(substr(f, 1, 57)) || '...' END AS preview FROM flat""",
    "exchanges_runs": f"WITH {RUNS} SELECT d, exchange_index, exchange_id, turn_start, turn_end, roles_pattern, student_text, tutor_text, status FROM runs",
    "exchange_context": f"WITH {RUNS} SELECT exchange_id, lag(exchange_id) OVER w AS left_context, lead(exchange_id) OVER w AS right_context FROM runs WINDOW w AS (PARTITION BY d ORDER BY exchange_index)",
    "exchanges_strict": f"""WITH {_STRICT} SELECT d, CAST(pair AS INTEGER) AS exchange_index, d || '::ex_' || printf('%04d', CAST(pair AS BIGINT)) AS exchange_id, turn_start, turn_end, student_text, tutor_text
      FROM pairs WHERE d NOT IN (SELECT d FROM verdict WHERE bad_pairs > 0)""",
    "pairing_violations": f"WITH {_STRICT} SELECT d, turns, bad_pairs FROM verdict WHERE bad_pairs > 0",
    "exchanges_greedy": f"""WITH RECURSIVE {TURNS}, pos AS (
        SELECT d, n, speaker, row_number() OVER w AS i, lead(speaker, 1) OVER w AS r1, lead(speaker, 2) OVER w AS r2 FROM turns WINDOW w AS (PARTITION BY d ORDER BY n)
      ), sized AS (SELECT *, CASE WHEN speaker = 'tutor' AND r1 = 'student' AND r2 = 'tutor' THEN 3 WHEN speaker = 'student' AND r1 = 'tutor' THEN 2 ELSE 1 END AS take FROM pos),
      walk AS (SELECT d, i, take, 0 AS e FROM sized WHERE i = 1 UNION ALL SELECT s.d, s.i, s.take, w.e + 1 FROM walk w JOIN sized s ON s.d = w.d AND s.i = w.i + w.take)
      SELECT w.d, CAST(w.e AS INTEGER) AS exchange_index, min(s.n) AS turn_start, max(s.n) AS turn_end, string_agg(upper(s.speaker[1]), '' ORDER BY s.i) AS roles_pattern
      FROM walk w JOIN sized s ON s.d = w.d AND s.i >= w.i AND s.i < w.i + w.take GROUP BY w.d, w.e""",
    "norm_audit": f"""WITH {RUNS}, a AS (SELECT d, count(*) AS turn_count, count(*) FILTER (speaker = 'student') AS student_turns, count(*) FILTER (speaker = 'tutor') AS tutor_turns,
        count(*) FILTER (speaker = 'unknown') AS unknown_turns FROM turns GROUP BY d),
      b AS (SELECT d, count(*) AS exchange_count, count(*) FILTER (status <> 'ok') AS blocked_exchanges FROM runs GROUP BY d)
      SELECT a.*, b.exchange_count, b.blocked_exchanges, b.blocked_exchanges = 0 AS ready FROM a JOIN b ON a.d = b.d""",
    "rebuilt_dialogues": f"""WITH {RUNS} SELECT d, exchange_index * 2 AS turn_index, 'student' AS speaker, student_text AS body FROM runs
      UNION ALL SELECT d, exchange_index * 2 + 1, 'tutor', tutor_text FROM runs""",
    "gate_non_kc": f"""WITH {RUNS}, g AS (SELECT exchange_id, flags, {_GATE_TEXT} AS x FROM runs)
      SELECT exchange_id, CASE WHEN list_contains(flags, 'empty_or_near_empty') THEN 'low_content' WHEN len(flags) > 0 AND {_WORDS.format('x')} <= 8 AND NOT contains(x, '?') THEN 'low_content'
        WHEN x <> '' AND regexp_matches(lower(x), {_quoted('|'.join(T.META_CUES))}) THEN 'meta_framing' WHEN x <> '' AND regexp_matches(lower(x), {_quoted('|'.join(T.RECAP_CUES))}) THEN 'recap_synthesis' END AS gate_type FROM g""",
    "focus_target": f"""WITH {RUNS}, st AS (SELECT d, exchange_index, exchange_id, {_S} AS s, {_T} AS t FROM runs), ranked AS (
        SELECT *, CASE WHEN exchange_index > 0 AND {_re('s', T.SELF_CORRECTION)} THEN 1
          WHEN t <> '' AND {_re('t', T.CORRECTION)} AND length(s) >= {T.ASSERTION_CHARS} AND NOT ({_re('s', T.PURE_QUESTION)} AND NOT {_re('s', T.CLAIM_MARKER)}) THEN 2
          WHEN s <> '' AND t <> '' AND length(t) <= {T.CONFIRMATION_CHARS} AND NOT contains(t, '?') AND NOT {_re('t', T.CORRECTION)} AND {_re('t', T.CONFIRMATION)} THEN 3
          WHEN t <> '' AND s <> '' AND NOT {_re('s', T.CLAIM_MARKER)} AND {_re('s', T.PURE_QUESTION)} THEN 4 END AS r FROM st)
      SELECT d, CASE WHEN min(r) IS NOT NULL THEN 'precise_focus_target' WHEN bool_or(t <> '') THEN 'broad_tutor_claim_target' ELSE 'no_domain_claim' END AS target_type,
        CASE min(r) WHEN 1 THEN 'self_correction' WHEN 2 THEN 'tutor_correction' WHEN 3 THEN 'confirmation' WHEN 4 THEN 'tutor_explanation' END AS pattern,
        arg_min(exchange_id, r * 100000 + exchange_index) FILTER (r IS NOT NULL) AS exchange_id FROM ranked GROUP BY d""",
}
