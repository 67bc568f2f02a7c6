"""Assignment of library units to exchanges: first pass by columns, context pass and segmentation as ordered folds.

The folds are pure step functions over rows in exchange order. In batch they run over one array of small structs per
dialogue, in streams over the same rows as they arrive; both give the same result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
MARGIN, MEDIUM_SHARE, BROAD_SHARE, GUIDED_SHARE, NOVELTY, NEIGHBOURS, KC_SET = 0.15, 0.32, 0.45, 0.30, 0.70, 3, 6
WEAK_CHAR = 0.3849


def first_pass(pool: DataFrame, shares: DataFrame, key: str = "exchange_id") -> DataFrame:
    """(key, label, unit_id, top1, margin, reason): labels from the leading candidates of every pool.

    ``pool``: (key, unit_id, score, eligible, exact, corroborated, nonlexical, families, is_candidate, tutor_only);
    ``shares``: (key, gate, top_share, broad). Eligible candidates lead if there are any, else all do.
    """
    w = Window.partitionBy(key)
    lead = pool.withColumn("any_eligible", F.bool_or("eligible").over(w)).where("eligible OR NOT any_eligible")
    lead = lead.withColumn("k", F.row_number().over(w.orderBy(F.col("score").desc_nulls_last(), "unit_id"))).where("k <= 2")
    top = lead.groupBy(key).agg(
        F.max(F.when(F.col("k") == 1, F.struct("unit_id", "score", "eligible", "exact", "corroborated", "nonlexical", "families", "is_candidate", "tutor_only"))).alias("t"),
        F.max(F.when(F.col("k") == 2, F.col("score"))).alias("second"),
    )
    j = shares.join(top, key, "left")
    top1 = F.coalesce(F.col("t.score"), F.lit(0.0))
    margin = top1 - F.coalesce("second", F.lit(0.0))
    broad, share = F.coalesce("broad", F.lit(False)), F.coalesce("top_share", F.lit(0.0))
    backed = F.col("t.corroborated") | ((F.col("t.families") >= 2) & F.col("t.nonlexical"))
    high = (
        F.col("t.eligible") & F.col("t.corroborated") & F.col("t.nonlexical") & (F.col("t.families") >= 2) & F.col("t.is_candidate")
        & (margin / F.greatest(top1, F.lit(1e-12)) >= MARGIN) & ~F.col("t.tutor_only") & ~broad
    )
    label = (
        F.when(F.col("gate").isin("low_content", "meta_framing"), "NON_KC").when((F.col("gate") == "recap_synthesis") & broad, "NON_KC")
        .when(F.col("t").isNull(), "NEEDS_NOVELTY_CHECK")
        .when(F.col("t.exact") & F.col("t.corroborated") & ~(broad & (share < 0.35)), "AUTO_HIGH_KC").when(high, "AUTO_HIGH_KC")
        .when(F.col("t.eligible") & backed & (share >= MEDIUM_SHARE) & ~F.col("t.tutor_only"), "AUTO_MEDIUM_KC")
        .otherwise("NEEDS_PASS2")
    )
    return j.select(key, label.alias("label"), F.col("t.unit_id").alias("unit_id"), F.round(top1, 6).alias("top1"), F.round(margin, 6).alias("margin"))


def multi_label(pool: DataFrame, key: str = "exchange_id", limit: int = 3) -> DataFrame:
    """(key, unit_ids): the leading unit and up to ``limit`` eligible others in pool order, as one text."""
    rows = pool.where((F.col("pool_rank") == 1) | F.col("eligible"))
    order = Window.partitionBy(key).orderBy("pool_rank")
    kept = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("k", "unit_id"))), lambda x: x.unit_id)
    return kept.groupBy(key).agg(F.array_join(ids, ",").alias("unit_ids"))


def abstains(exact: Column, identity: Column, char_score: Column) -> Column:
    """Neither an exact match nor identity evidence, and a weak surface match."""
    return ~F.coalesce(exact, F.lit(False)) & (F.coalesce(identity, F.lit(0.0)) == 0.0) & (F.coalesce(char_score, F.lit(0.0)) < WEAK_CHAR)


def assignment_scope(label: Column, band: Column, action: Column, broad: Column) -> Column:
    return (
        F.when(label == "MISSING_KC_REVIEW", "missing_kc").when(label == "NON_KC", "non_kc")
        .when(broad & (band == "low") & (action == "pass2_broad_multibranch_closed_set"), "broad_kc_set")
        .when((band == "low") | F.startswith(F.coalesce(action, F.lit("")), F.lit("pass2_")), "branch_context").otherwise("single_kc")
    )


def scope_role(scope: Column) -> Column:
    return F.when(scope == "single_kc", "primary").when(scope == "branch_context", "context_anchor").when(scope == "broad_kc_set", "low_confidence_anchor").otherwise("none")


def evaluator_set(scope: Column, unit: Column, secondary: Column, kc_set: Column) -> Column:
    """Units an evaluator sees, in order and without repeats."""
    none = F.array().cast("array<string>")
    own = F.array_compact(F.array_distinct(F.concat(F.array(unit), F.coalesce(secondary, none))))
    near = F.array_compact(F.array_distinct(F.coalesce(kc_set, none)))
    return F.when(scope.isin("missing_kc", "non_kc"), F.coalesce(kc_set, none)).when(scope == "single_kc", own).when(F.size(near) > 0, near).otherwise(own)


# ---- context pass -------------------------------------------------------------------------------------------------


def _anchor(rows: list[dict], i: int, way: int) -> dict | None:
    for steps in range(1, NEIGHBOURS + 1):
        j = i + way * steps
        if not 0 <= j < len(rows):
            return None
        r = rows[j]
        if r["final"] in ("AUTO_HIGH_KC", "AUTO_MEDIUM_KC") and r["resolved"]:
            return r
        if r["final"] == "MISSING_KC_REVIEW":
            return None
    return None


def _supported(anchor: dict, row: dict) -> bool:
    unit, pool = anchor["resolved"], row["pool"]
    own = next((c for c in pool if c["unit_id"] == unit), None)
    if any(c["unit_id"] == unit for c in pool[:8]):
        return True
    if own and (own["eligible"] or own["corroborated"] or (own["branch"] and own["branch"] == anchor["branch"])):
        return True
    return bool(pool and pool[0]["branch"] and pool[0]["branch"] == anchor["branch"])


def resolve_context(rows: list[dict]) -> list[dict]:
    """Second pass over the exchanges of a dialogue in order: adds final, resolved, band and action to each row.

    A row has label, unit_id, top1, broad, top_share, and pool: candidates in rank order with unit_id, score, ce,
    eligible, corroborated, families, branch, tutor_only.
    """
    for r in rows:
        keep = r["label"] in ("NON_KC", "AUTO_HIGH_KC", "AUTO_MEDIUM_KC")
        r["final"] = r["label"] if keep else "UNRESOLVED_AFTER_PASS1"
        r["resolved"] = None if r["label"] == "NON_KC" else r["unit_id"]
        r["band"] = {"AUTO_HIGH_KC": "high", "AUTO_MEDIUM_KC": "medium"}.get(r["label"])
        r["action"] = "pass1_closed_set" if r["final"].startswith("AUTO_") else "pending_pass2"
        r["branch"] = r["pool"][0]["branch"] if r["pool"] else None
    for i, r in enumerate(rows):
        if r["final"] != "UNRESOLVED_AFTER_PASS1" or not r["pool"]:
            continue
        best, left, right = r["pool"][0], _anchor(rows, i, -1), _anchor(rows, i, 1)
        near = [(n, a) for n, a in (("left", left), ("right", right)) if a and _supported(a, r)]

        def low(unit: str | None, action: str, branch: str | None, r: dict = r) -> None:
            r.update(final="AUTO_LOW_KC", resolved=unit, band="low", action=action, branch=branch or r["branch"])

        if r["broad"] and r["top_share"] < BROAD_SHARE:
            pick = next((c for c in r["pool"] if not c["tutor_only"] and c["eligible"]), None)
            pick = pick or next((c for c in r["pool"] if not c["tutor_only"] and c["corroborated"]), best)
            low(pick["unit_id"], "pass2_broad_multibranch_closed_set", pick["branch"])
        elif left and right and left["resolved"] == right["resolved"] and _supported(left, r):
            low(left["resolved"], "pass2_same_neighbour_rescue", left["branch"])
        elif near and not r["broad"]:
            name, a = near[0]
            own = next((c for c in r["pool"] if c["unit_id"] == a["resolved"]), None)
            mine = next((c for c in r["pool"] if c["unit_id"] == r["unit_id"]), None)
            weaker = own and mine and own["ce"] is not None and mine["ce"] is not None and own["ce"] < mine["ce"]
            if own and (own["score"] or 0.0) > r["top1"] and not weaker:
                low(a["resolved"], f"pass2_{name}_context_continuation", a["branch"])
            else:
                low(r["unit_id"], "pass2_continuation_protected", r["branch"])
        elif best["eligible"] or best["corroborated"] or r["top_share"] >= GUIDED_SHARE:
            low(best["unit_id"], "pass2_branch_guided_best_candidate", best["branch"])
        else:
            weak = not best["corroborated"] and best["families"] < 2
            none_eligible = not any(c["eligible"] for c in r["pool"])
            score = 0.45 if none_eligible else 0.25 * weak
            score += 0.25 * (r["top_share"] < 0.25) + 0.20 * (not near) + 0.15 * (len(r["pool"]) <= 2)
            if min(1.0, score) >= NOVELTY - 1e-9:
                r.update(final="MISSING_KC_REVIEW", resolved=None, band="missing_review", action="novelty_gate_missing_kc_review")
            else:
                low(best["unit_id"], "pass2_low_confidence_closed_set_fallback", best["branch"])
    return rows


_RESOLVED = "array<struct<idx:int,final:string,resolved:string,band:string,action:string,branch:string>>"


def _resolve(groups: pd.Series) -> pd.Series:
    names = ("idx", "final", "resolved", "band", "action", "branch")
    out = []
    for rows in groups:
        rows = [dict(r) | {"pool": [dict(c) for c in (r["pool"] if r["pool"] is not None else [])]} for r in rows]
        out.append([{k: r[k] for k in names} for r in resolve_context(rows)])
    return pd.Series(out)


def second_pass(rows: DataFrame) -> DataFrame:
    """(dialogue, idx, final, resolved, band, action, branch): rows need dialogue, idx and what resolve_context() reads."""
    item = F.struct("idx", "label", "unit_id", "top1", "broad", "top_share", "pool")
    per = rows.groupBy("dialogue").agg(F.array_sort(F.collect_list(item), lambda a, b: a.idx - b.idx).alias("x"))
    return per.select("dialogue", F.explode(F.pandas_udf(_resolve, _RESOLVED)("x")).alias("r")).select("dialogue", "r.*")


# ---- segmentation -------------------------------------------------------------------------------------------------


@dataclass
class SegmentState:
    """An open segment: its first row's unit decides what may join."""

    dominant: str | None = None
    members: list[int] = field(default_factory=list)
    number: int = -1


def segment_step(state: SegmentState, row: dict) -> tuple[SegmentState, list[int] | None]:
    """(next state, members of the segment that this row closed or None) for the next exchange of a dialogue."""
    joins = False
    if state.members:
        kc, band, near = row["resolved"], row["band"], list(row["kc_set"] if row["kc_set"] is not None else [])
        if row["final"] == "NON_KC":
            joins = True
        elif row["final"] == "MISSING_KC_REVIEW":
            joins = False
        elif state.dominant and kc == state.dominant:
            joins = True
        elif band in ("low", "medium") and state.dominant and len(state.members) >= 2 and state.dominant in near:
            joins = True
        elif band == "low" and state.dominant in near:
            joins = True
    if joins:
        return SegmentState(state.dominant, [*state.members, int(row["idx"])], state.number), None
    dominant = row["resolved"] if row["final"] not in ("NON_KC", "MISSING_KC_REVIEW") else None
    return SegmentState(dominant, [int(row["idx"])], state.number + 1), state.members or None


def fold_segments(rows: list[dict]) -> list[tuple[int, str | None, list[int]]]:
    """(number, dominant unit, member indexes) of a dialogue's segments."""
    state, out = SegmentState(), []
    for row in rows:
        after, closed = segment_step(state, row)
        if closed:
            out.append((state.number, state.dominant, closed))
        state = after
    if state.members:
        out.append((state.number, state.dominant, state.members))
    return out


_SEGMENTS = "array<struct<number:int,dominant:string,members:array<int>>>"


def _fold(groups: pd.Series) -> pd.Series:
    return pd.Series([[{"number": n, "dominant": k, "members": m} for n, k, m in fold_segments([dict(r) for r in rows])] for rows in groups])


def segments(rows: DataFrame) -> DataFrame:
    """(dialogue, segment_no, segment_id, dominant, members) from rows (dialogue, idx, final, resolved, band, kc_set)."""
    item = F.struct("idx", "final", "resolved", "band", "kc_set")
    per = rows.groupBy("dialogue").agg(F.array_sort(F.collect_list(item), lambda a, b: a.idx - b.idx).alias("x"))
    out = per.select("dialogue", F.explode(F.pandas_udf(_fold, _SEGMENTS)("x")).alias("s"))
    return out.select("dialogue", F.col("s.number").alias("segment_no"), F.concat("dialogue", F.lit("::seg_"), F.format_string("%04d", F.col("s.number").cast("bigint"))).alias("segment_id"), "s.dominant", "s.members")


def segment_scope(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scope): missing over broad over branch; non_kc only if all rows are; else single."""
    s = F.col("scope")
    picked = F.when(F.bool_or(s == "missing_kc"), "missing_kc").when(F.bool_or(s == "broad_kc_set"), "broad_kc_set").when(F.bool_or(s == "branch_context"), "branch_context").when(F.bool_and(s == "non_kc"), "non_kc").otherwise("single_kc")
    return rows.groupBy(*keys).agg(picked.alias("scope"))


def boundaries(segment_rows: DataFrame) -> DataFrame:
    """(dialogue, idx, boundary): 1 where the next exchange opens another segment; the last exchange has no row."""
    w = Window.partitionBy("dialogue").orderBy("idx")
    nxt = F.lead("segment_no").over(w)
    return segment_rows.withColumn("boundary", (nxt != F.col("segment_no")).cast("int")).where("boundary IS NOT NULL").select("dialogue", "idx", "boundary")


def topic_rollup(units: DataFrame) -> DataFrame:
    """(dialogue, topic_no, topic, segments, exchanges): consecutive segments with one parent topic as islands.

    Rebuilt from the stated rule: a segment without a topic, or with another one, opens a unit.
    """
    w = Window.partitionBy("dialogue").orderBy("segment_no")
    new = (~F.lag("topic").over(w).eqNullSafe(F.col("topic")) | F.col("topic").isNull()).cast("int")
    marked = units.withColumn("new", new).withColumn("topic_no", F.sum("new").over(w) - 1)
    marked = marked.withColumn("topic_no", F.greatest(F.col("topic_no"), F.lit(0)))
    return marked.groupBy("dialogue", "topic_no").agg(F.first("topic", True).alias("topic"), F.count(F.lit(1)).alias("segments"), F.sum("exchanges").alias("exchanges"))


def exchange_audit(rows: DataFrame) -> DataFrame:
    """(exchange_id, readiness, hard, recommended, suspect): reason codes of assignment rows with their texts."""
    meta = r"(?i)\b(conversation|llm tutor|real human student|respond like|ask messy questions|teaching style|simulate|simulation|dialogue|transcript)\b"
    formula = r"(?i)\b(calculate|compute|formula|interval|z\s*=|z-statistic|laplace|smoothing|centroid|manhattan|euclidean|cosine|f1|precision|recall|specificity|sensitivity|prior|conditional probability|likelihood|entropy|gain ratio|information gain)\b"
    recap = r"(?i)\b(connect all|final strategy|summarize|summary|recap|overall|all these exercises|remember everything|four passes)\b"
    shift = r"(?i)\b(now exercise|exercise \d+|next|what about|switch|different from|instead|classification|clustering|naive bayes|decision tree|random forest|k-means|dbscan|confidence interval|z-statistic|precision|recall|f1|cosine|manhattan|euclidean)\b"
    soft_actions = ["pass2_branch_guided_best_candidate", "pass2_context_dependent_anaphora_bridge_rescue", "pass2_left_context_continuation", "pass2_right_context_continuation"]
    hard_actions = ["pass2_broad_multibranch_closed_set", "pass2_context_dependent_anchor_context_only"]
    text, action = F.concat_ws(" ", "student_text", "tutor_text"), F.coalesce("action", F.lit(""))
    soft = action.isin(soft_actions)
    pick = lambda *cells: F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, n if isinstance(n, Column) else F.lit(n)) for c, n in cells]))))
    hard = pick((F.col("resolved").isNull(), "missing_resolved_kc"), (F.col("band") == "low", "low_confidence"), (F.col("scope") == "broad_kc_set", "broad_kc_set"), (action.isin(hard_actions), action), (text.rlike(meta), "meta_or_orientation_turn"))
    advised = pick((F.col("scope") == "branch_context", "branch_context"), (soft, action), (soft & text.rlike(formula), "formula_or_calculation_context_rescue"), (text.rlike(recap), "recap_or_final_strategy"), (soft & text.rlike(shift), "context_rescue_with_possible_topic_shift"), (F.size("kc_set") >= 10, "wide_evaluator_kc_set"))
    suspect = pick((text.rlike(meta), "meta_or_orientation_turn_forced_to_kc"), (soft & text.rlike(formula), "formula_or_calculation_turn_with_context_rescue"), (text.rlike(recap), "recap_or_final_strategy_forced_to_kc"), (soft & text.rlike(shift), "context_rescue_with_possible_topic_shift"), (F.size("kc_set") >= 10, "wide_evaluator_kc_set"))
    rows = rows.withColumn("hard", hard).withColumn("recommended", advised).withColumn("suspect", suspect)
    status = F.when(F.size("hard") > 0, "hard_review_required").when(F.size("recommended") > 0, "review_recommended").otherwise("evaluation_ready")
    return rows.select("exchange_id", status.alias("readiness"), "hard", "recommended", "suspect")
