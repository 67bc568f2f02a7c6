"""Brute-force, round-trip and edge-case tests of the training-data operators."""

import datetime
import json
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tests.parity import DATA, HAVE_DATA, both
from tutorgrain.llm import conversations, leaks, packing, pairs, queries, splitting, topn, truncation
from tutorgrain.llm.tokens import encode, encoding, vocabulary

AT = datetime.datetime(2026, 1, 1)


@pytest.mark.skipif(not HAVE_DATA, reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    got, want = both(spark, queries.QUERIES[name], queries.SQL[name])
    assert got == want


@pytest.mark.skipif(not HAVE_DATA, reason="no test data")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


# ---- top n --------------------------------------------------------------------------------------------------------

HITS = "g string, i string, s double, r int, code string, cut int, lo int"


def best(rows, n):
    first = {}
    for g, i, s, r, *_ in rows:
        if g is None or i is None or s is None or s != s:
            continue
        k = (-s, r if r is not None else float("inf"))
        if (g, i) not in first or k < first[g, i]:
            first[g, i] = k
    out = {}
    for (g, i), k in first.items():
        out.setdefault(g, []).append((*k, i.encode()))
    return {(g, x[2].decode(), p + 1) for g, xs in out.items() for p, x in enumerate(sorted(xs)[:n])}


@pytest.mark.parametrize("n", [1, 3, 7])
def test_top_n_equals_sorting(spark, n):
    rng = random.Random(n)
    scores = [None, float("nan"), 0.0, -0.0, -1.5, 0.25, 0.25, 1e300, -1e300, 5e-324, float("inf"), 0.1, 0.1000000000000001]
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice([f"unit_{k:03}" for k in range(40)] + ["", "ü", "unit_0010", None]), rng.choice(scores), rng.choice([None, 1, 2, 3]), "x", 1, 2) for _ in range(600)]
    rows += [("lone", "u", 0.5, None, "x", 1, 2)]
    df = spark.createDataFrame(rows, HITS)
    got = {(r.g, r.i, r.position) for r in topn.top_n_per_group(df.repartition(5), "g", "i", "s", "r", n).collect()}
    assert got == best(rows, n)


def test_top_n_empty(spark):
    assert topn.top_n_per_group(spark.createDataFrame([], HITS), "g", "i", "s", "r").count() == 0
    with pytest.raises(ValueError, match="at least 1"):
        topn.top_n_per_group(spark.createDataFrame([], HITS), "g", "i", "s", "r", 0)


def test_score_code_keeps_order(spark):
    xs = [float("-inf"), -1e300, -2.0, -1.0, -5e-324, 0.0, 5e-324, 0.5, 1.0, 1e300, float("inf")]
    codes = [r.c for r in spark.createDataFrame([(x,) for x in xs], "x double").select(topn.score_code(F.col("x")).alias("c")).collect()]
    assert codes == sorted(codes) and len(set(codes)) == len(codes)


# ---- truncation ---------------------------------------------------------------------------------------------------

LONG = "The tutor names the slope and the reply corrects it in a steady and patient way"
WHOLE = json.dumps({"a": [1, {"b": "x"}], "rationale_short": LONG + "."})


@pytest.mark.parametrize(("text", "cut"), [
    (WHOLE, False), (WHOLE[:-1] + ",}", False), (WHOLE.replace('"', "'"), False), ("Here it is.\n" + WHOLE + "\n-- done --", False), ("```json\n" + WHOLE + "\n```", False),
    (WHOLE[:-1], True), (WHOLE[:-30], True), (WHOLE[:5], True), (WHOLE.replace(LONG + ".", LONG), True), (WHOLE.replace(LONG + ".", "n/a"), False),
    (WHOLE.replace(LONG + ".", "He said \\\"ok, got it\\\""), False), ('{"rationale_short": "say "well" then."}', False), ("Verdict: fine. " + LONG + ".", False), ("Verdict: fine. " + LONG, True),
    ("Verdict: fine. No issue found", False), ("Verdict: fine.\n\n- score: 1\n- reviewed: yes", False), ("Verdict: fine. The clos�", True), ("", False), ("  \n", False), (None, False), ('{"a": "\\u00', True),
    ('{"a": "' + "x" * 200000 + '"}', False), ('{"a": "' + "x" * 200000, True),
])
def test_truncation_cases(spark, text, cut):
    df = spark.createDataFrame([(1, text, "s", True)], "id long, t string, src string, open boolean")
    assert [r.is_cut for r in truncation.detect_truncated(df, "id", "t", "src").collect()] == [cut]


def test_field_limits_and_rates(spark):
    def answer(n):
        return json.dumps({"rationale_short": ("word " * 400)[: n - 1] + "x"})

    rows = [(i, answer(448), "capped") for i in range(20)] + [(100 + i, json.dumps({"rationale_short": "word " * (10 + i) + "end."}), "capped") for i in range(60)]
    rows += [(500 + i, json.dumps({"rationale_short": "word " * (20 + i) + "end"}), "bare") for i in range(30)] + [(900, answer(100), None), (900, answer(100), None)]
    df = spark.createDataFrame(rows, "id long, t string, src string")
    cuts = truncation.detect_truncated(df, "id", "t", "src")
    rates = {r.src: (r.n_rows, r.n_cut) for r in truncation.truncation_rates(cuts, "src").collect()}
    assert rates["capped"] == (80, 20) and rates["bare"] == (30, 0)  # a source that never ends its texts proves nothing
    assert rates[None][0] == 2
    assert truncation.detect_truncated(df.limit(0), "id", "t", "src").count() == 0


def test_a_longer_value_does_not_hide_a_limit(spark):
    def row(k, size, end=""):
        words = " ".join(f"w{(k * 31 + i * 7) % 97}" for i in range(200))
        return json.dumps({"rationale_short": (f"Point {k} is made. " + words)[: size - len(end)] + end})

    limited = [(k, ("The slope of case %02d falls when age goes out. " % k) * 8) for k in range(12)]
    cut = [(k, json.dumps({"rationale_short": (t[: 200 - len(e)] + e)})) for k, t in limited for e in (" and then it " + "abcdefghijkl"[k],)]
    whole = [(100 + k, row(k, 60 + 3 * k, ".")) for k in range(40)]
    longer = [(999, row(5, 320, "."))]
    df = spark.createDataFrame(cut + whole + longer, "id long, t string").selectExpr("*", "'s' AS src")
    got = {r.id for r in truncation.detect_truncated(df, "id", "t", "src").collect() if r.is_cut}
    assert got == {k for k, _ in cut}


# ---- pairs --------------------------------------------------------------------------------------------------------

Q = "Why does the slope change when I drop the age column of the table?"


@pytest.mark.parametrize(("answer", "defect"), [
    (None, "empty"), ("", "empty"), (" ​\n", "empty"), ("[No response]", "empty"), ("...", "empty"), ("N/A", "empty"),
    (Q, "copies_question"), ("You asked: " + Q, "copies_question"), (Q + " " + Q, "copies_question"), (Q.upper(), "copies_question"),
    (Q + " Because age explains a large part of the variance, the slope takes over its share once it is gone.", None),
    ("I'm sorry, but I can't help with that.", "refusal"), ("Lo siento, no puedo ayudarte con esa pregunta.", "refusal"), ("That topic is off limits for me.", "refusal"),
    ("I won't give you the number straight away: what does the slope do when age is dropped?", None), ("I can't find a mistake in your table. It is computed correctly.", None),
    ("Weil das Alter fehlt, ändert sich die Steigung, und der Wert wird mit der Zeit größer.", "other_language"),
    ("Because age explains the", "truncated"), ("Because age explains the vari-", "truncated"), ("Because of the�", "truncated"), ("It follows the rule of Dr.", "truncated"),
    ("Correct", None), ("K = 2", None), ("The result is 0.13", None), ("Right! :)", None), ("`3 / 4`", None), ("Yes.", None),
])
def test_pair_cases(spark, answer, defect):
    df = spark.createDataFrame([(1, (Q,), None if answer is None else (answer,), "x")], "pair_id long, student struct<text:string>, tutor struct<text:string>, copies string")
    got = [r.defect_type for r in pairs.find_defects(df, "pair_id", "student.text", "tutor.text").collect()]
    assert got == ([] if defect is None else [defect])


def test_pairs_nulls_long_and_empty(spark):
    schema = "pair_id long, student struct<text:string>, tutor struct<text:string>"
    df = spark.createDataFrame([(1, None, ("A full answer.",)), (2, (Q,), None), (2, (Q,), None), (3, (Q * 3000,), (Q * 3000,))], schema)
    got = sorted(tuple(r) for r in pairs.find_defects(df, "pair_id", "student.text", "tutor.text").collect())
    assert got == [(2, "empty"), (2, "empty"), (3, "copies_question")]
    assert pairs.find_defects(df.limit(0), "pair_id", "student.text", "tutor.text").count() == 0


def test_cut_answers_stay_cut_when_they_recur(spark):
    schema = "pair_id long, student struct<text:string>, tutor struct<text:string>"
    cut = [(k, (Q,), ("Not quite. However, noti",)) for k in range(3)]  # one pair, delivered three times
    cut += [(10 + k, (f"{Q} Case {k}.",), ("In most runs that is cl",)) for k in range(3)]  # equal cuts of three answers
    cut += [(20, (Q,), ("Becau",))]
    whole = [(30 + k, (f"{Q} Turn {k}.",), (a,)) for k, a in enumerate(["That fits your plot exactly"] * 4 + ["You said exactly what counts here.", "Because age counts.", "Because it falls.", "Because it rises."])]
    df = spark.createDataFrame(cut + whole, schema)
    got = sorted(tuple(r) for r in pairs.find_defects(df, "pair_id", "student.text", "tutor.text").collect())
    assert got == [(k, "truncated") for k, *_ in cut]


@pytest.mark.parametrize("times", [1, 8, 9, 30, 4000])
def test_copies_repeated_any_number_of_times(times):
    assert pairs.only_copies(Q, " ".join([Q] * times)) and not pairs.only_copies(Q, " ".join([Q] * times) + " And now" * 14 * times)


def test_dictionary_compression_sees_copies():
    assert pairs.added_share(Q, Q) < 0.2 < 0.6 < pairs.added_share(Q, "Sort the ledger by weight and then mark its heaviest entry twice.")


# ---- conversations ------------------------------------------------------------------------------------------------

TURN = "dialogue_id string, turn_id string, role string, text string, sent_at timestamp, n int, d string"


def judged(spark, *rows):
    data = [(d, t, r, x, AT + datetime.timedelta(seconds=k), 1, "z") for k, (d, t, r, x) in enumerate(rows)]
    df = spark.createDataFrame(data, TURN)
    return dict(tuple(r) for r in conversations.find_broken(df, "dialogue_id", "turn_id", "role", "text", "sent_at").collect())


def test_conversation_rules(spark):
    rows = [
        ("ok", "ok::t_0", "Student", "q"), (None, "ok::t_0001", " TUTOR", "a"), ("ok", "ok::t_1", "assistant", "a"),
        ("void", "void::t_0", "student", " "), ("void", "void::t_1", "tutor", None),
        ("gap", "gap::t_0", "student", "q"), ("gap", "gap::t_2", "tutor", "a"), ("late", "late::t_1", "tutor", "a"),
        ("two", "two::t_0", "student", "q"), ("two", "two::t_0", "student", "other"), ("two", "two::t_1", "tutor", "a"),
        ("who", "who::t_0", "student", "q"), ("who", "who::t_1", "speaker_3", "a"), ("none", "none::t_0", None, "q"),
        ("blank", "blank::t_0", "student", "q"), ("blank", "blank::t_1", "tutor", " "),
        ("run", "run::t_0", "s", "q"), ("run", "run::t_1", "s", "q2"), ("run", "run::t_2", "t", "a"),
        ("sys", "sys::t_0", "s", "q"), ("sys", "sys::t_1", "system", "note"), ("sys", "sys::t_2", "s", "q"), ("sys", "sys::t_3", "t", "a"),
        ("bad", "bad::x", "s", "q"),
    ]
    assert judged(spark, *rows) == {"void": "empty", "gap": "broken", "late": "broken", "two": "broken", "who": "broken", "none": "broken", "blank": "missing_reply", "sys": "missing_reply", "bad": "broken"}
    assert judged(spark) == {}


def test_long_conversations_cross_blocks(spark):
    long = [("d", f"d::t_{i}", "student" if i % 2 == 0 else "tutor", f"x{i}") for i in range(3 * conversations.BLOCK)]
    random.Random(1).shuffle(long)
    assert judged(spark, *long) == {}
    assert judged(spark, *[r for r in long if r[1] != f"d::t_{conversations.BLOCK}"]) == {"d": "broken"}
    silent = [(d, t, r, None if t == f"d::t_{2 * conversations.BLOCK - 1}" else x) for d, t, r, x in long]
    assert judged(spark, *silent) == {"d": "missing_reply"}


def test_kahn():
    assert conversations.kahn([2, 0, 1], [1, -1, 0], [5, 9, 7])[0] == [0, 1, 2]
    assert conversations.kahn([0, 2, 3], [-1, 1, 2], [1, 1, 1])[0] == [0]
    order, home, waits = conversations.kahn([256, 300, 301, 302], [255, 256, 256, 301], [1, 9, 4, 2])
    assert order == [256, 301, 300, 302] and home[302] == (256, 2) and waits == {256: 255}


def test_rebuilt_order(spark):
    df = spark.createDataFrame([("d", "d::t_1", "T", " a  b ", AT, 1, "z"), ("d", "d::t_0", "S", "q", None, 1, "z")], TURN)
    rows = conversations.rebuild(df, "dialogue_id", "turn_id", "role", "text", "sent_at").orderBy("turn_no").collect()
    assert [tuple(r) for r in rows] == [("d", 0, 0, "student", "q"), ("d", 1, 1, "tutor", "a b")]


REPLY = "dialogue_id string, turn_id string, role string, text string, sent_at timestamp, parent string, n string, p string"


def replies(spark, *rows):
    return spark.createDataFrame([(d, f"m{t}", r, x, AT + datetime.timedelta(seconds=s), None if p is None else f"m{p}", "x", "y") for d, t, r, x, s, p in rows], REPLY)


def reply_order(df, d):
    rows = conversations.rebuild(df, "dialogue_id", "turn_id", "role", "text", "sent_at", "parent").where(F.col("dialogue_id") == d).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(rows)))
    return [r.turn_no for r in rows]


def test_reply_pointers_branches_ties_and_cycles(spark):
    df = replies(
        spark,
        ("tree", 50, "s", "q", 9, None), ("tree", 7, "t", "late", 5, 50), ("tree", 9, "t", "early", 4, 50), ("tree", 3, "t", "tie", 5, 50), ("tree", 1, "t", "end", 0, 7),
        ("ring", 0, "s", "q", 0, None), ("ring", 1, "t", "a", 1, 0), ("ring", 2, "s", "q", 2, 3), ("ring", 3, "t", "a", 3, 2),
        ("lost", 0, "s", "q", 0, None), ("lost", 5, "t", "a", 1, 4), ("two", 0, "s", "q", 0, None), ("two", 1, "t", "a", 1, 0), ("two", 1, "t", "a", 1, 2), ("two", 2, "t", "a", 1, 0),
        ("mute", 0, "s", "q", 0, None), ("mute", 1, "system", "x", 1, 0),
    )
    got = dict(tuple(r) for r in conversations.find_broken(df, "dialogue_id", "turn_id", "role", "text", "sent_at", "parent").collect())
    assert got == {"ring": "broken", "lost": "broken", "two": "broken", "mute": "missing_reply"}
    assert reply_order(df, "tree") == [50, 9, 3, 7, 1]  # timestamps decide among siblings, numbers among equal timestamps


def test_reply_pointers_across_blocks(spark):
    rng = random.Random(4)
    numbers = rng.sample(range(5000), 700)  # a chain in random numbers crosses blocks at every step
    chain = [("d", n, "s" if k % 2 == 0 else "t", "x", 1000 - k, numbers[k - 1] if k else None) for k, n in enumerate(numbers)]
    assert reply_order(replies(spark, *chain), "d") == numbers
    ring = [*chain[:300], ("d", numbers[300], "s", "x", 0, numbers[699]), *chain[301:]]
    df = replies(spark, *ring)
    assert [tuple(r) for r in conversations.find_broken(df, "dialogue_id", "turn_id", "role", "text", "sent_at", "parent").collect()] == [("d", "broken")]


def test_reports_combine_over_many_blocks(spark):
    size = conversations.BLOCK * conversations.BLOCK + 300
    df = spark.range(size).selectExpr("'d' AS dialogue_id", "concat('d::t_', id) AS turn_id", "if(id % 2 = 0, 's', 't') AS role", "'x' AS text", "timestamp'2026-01-01' AS sent_at")
    assert conversations.find_broken(df, "dialogue_id", "turn_id", "role", "text", "sent_at").count() == 0
    mute = df.withColumn("text", F.when(F.col("turn_id") != f"d::t_{size // 2 * 2 - 301}", "x"))
    assert [r.defect_type for r in conversations.find_broken(mute, "dialogue_id", "turn_id", "role", "text", "sent_at").collect()] == ["missing_reply"]


# ---- packing ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_a_packing(seed):
    rng = random.Random(seed)
    sizes = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(40)}
    plan = packing.make_plan(sizes, 100, (25, 50, 100))
    used = {}
    for pattern, n in zip(plan.patterns, plan.count):
        assert sum(s * c for s, c in pattern) <= 100
        for s, c in pattern:
            used[s] = used.get(s, 0) + c * n
    assert used == sizes
    assert plan.containers <= 1.25 * -(-sum(s * c for s, c in sizes.items()) // 100) + 1


def test_tiers_shape_the_plan_and_cost_no_containers():
    rng = random.Random(3)
    sizes = {s: rng.randint(1, 40) for s in rng.sample(range(1, 2049), 500)} | {s: rng.randint(500, 900) for s in range(5, 900, 7)}
    least = -(-sum(s * c for s, c in sizes.items()) // 2048)
    plans = [packing.make_plan(sizes, 2048, tiers) for tiers in (packing.TIERS, (), (7, 99, 1000))]
    assert len({str(p.patterns) for p in plans}) == 3
    assert all(p.containers <= 1.005 * least + 1 for p in plans[:2])
    assert plans[2].containers <= 1.02 * least + 1  # windows of 1,000 leave 48 that the shorter tiers have to fill


def test_tiers_fill_gaps_first_then_their_own_windows():
    # 60 + 40 fill a container; the other short texts share windows of 50, and two windows share a container
    plan = packing.make_plan({60: 1, 40: 1, 25: 4}, 100, (50, 100))
    assert sorted((p, n) for p, n in zip(plan.patterns, plan.count)) == [([[25, 4]], 1), ([[60, 1], [40, 1]], 1)]


def test_step_groups_are_balanced_and_faults_are_seen(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, "word " * rng.choice([1, 5, 30, 200, 900])) for i in range(900)], "doc_id long, text string")
    placed = packing.pack(df, step=4)
    fills = packing.container_fill(placed)
    groups = [r.t for r in fills.groupBy("step_group").agg(F.sum("fill").alias("t"), F.count(F.lit(1)).alias("n")).where("n = 4").collect()]
    assert max(groups) - min(groups) <= 2048
    assert sum(r.tokens for r in packing.tier_fill(fills).collect()) == sum(r.n_tokens for r in placed.collect())
    assert tuple(packing.packing_faults(df, placed).first()) == (900, 0, 0, 0, 0, 0, 0, 0)
    worse = placed.where("doc_id <> 3").unionByName(placed.where("doc_id = 5"))
    assert tuple(packing.packing_faults(df, worse).first())[1:3] == (1, 1)


def test_pack_places_every_text_once(spark):
    rng = random.Random(5)
    rows = [(i, "word " * rng.choice([1, 5, 30, 200, 900]), "d", 1) for i in range(200)] + [(1000, None, "d", 1), (1001, "", "d", 1), (1002, "word " * 7000, "d", 1), (1003, "word " * 7000, "d", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size string, rank int")
    out = packing.pack(df, capacity=2048).collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows}
    by = {}
    for r in out:
        by.setdefault(r.container_id, []).append(r)
    for members in by.values():
        assert sorted(r.position for r in members) == list(range(len(members)))
        assert sum(r.n_tokens for r in members) == members[0].fill <= 2048
    assert sorted(by) == list(range(len(by)))
    split = [r for r in out if r.n_pieces > 1]
    assert {r.doc_id for r in split} == {1002, 1003} and all(r.token_from == 2048 * r.piece_no for r in split)
    assert {r.doc_id for r in packing.oversized(packing.pack(df)).collect()} == {1002, 1003}


def test_pack_edges(spark):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    only_empty = packing.pack(spark.createDataFrame([(1, ""), (2, None)], schema)).collect()
    assert sorted((r.container_id, r.position) for r in only_empty) == [(0, 0), (0, 1)]


# ---- leaks --------------------------------------------------------------------------------------------------------


def edit_run(item, doc, least=30, every=10):
    """Brute force: is there a run of item words and a stretch of document words within the edit share?"""
    for a in range(len(item)):
        for u in range(len(doc)):
            row = list(range(len(doc) - u + 1))
            for b in range(a, len(item)):
                last, row = row, [row[0] + 1]
                for j, w in enumerate(doc[u:]):
                    row.append(min(last[j] + (w != item[b]), last[j + 1] + 1, row[j] + 1))
                if b - a + 1 >= least and min(row) * every <= b - a + 1:
                    return True
    return False


@pytest.mark.parametrize("seed", range(12))
def test_leak_search_equals_brute_force(seed):
    rng = random.Random(seed)
    item = [f"w{rng.randint(0, 60)}" for _ in range(36)]
    doc = item[rng.randint(0, 5) :]
    for _ in range(rng.choice([2, 3, 4, 5])):
        k = rng.randrange(len(doc))
        how = rng.choice("sid")
        doc = doc[:k] + ([f"z{rng.randint(0, 9)}"] if how == "s" else [doc[k], "zz"] if how == "i" else []) + doc[k + 1 :]
    doc = ["pre"] * 3 + doc + ["post"] * 3
    index = leaks.EvalIndex([(1, " ".join(item))], 7, 30, 10)
    assert bool(index.search(" ".join(doc))) == edit_run(item, doc)


def test_leaks_through_damage(spark):
    item = "Suppose a colleague claims that row spacing 3.75 alone decides the nested density reach, although her matrix was taken from a loose threshold; state which of both readings could have produced the flat gap between them today"
    damaged = item.upper().replace(" ", "  \n> ").replace(",", "").replace("LOOSE", "**loose**").replace("ALONE", "<b>alone</b>").replace("NESTED", "nes-\nted")
    docs = spark.createDataFrame([(1, "x " + damaged, "t"), (2, " ".join(item.split()[:20]), "t"), (3, None, "t"), (4, "", "t"), (5, "x " + damaged, "t"), (6, "noise " * 50000 + item, "t")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "too short", 1)], "item_id long, text string, doc_id int")
    for block in (1 << 20, 50):
        got = sorted((r.item_id, r.doc_id) for r in leaks.find_leaks(docs, items, block_bytes=block).collect())
        assert got == [(7, 1), (7, 5), (7, 6)]
    assert leaks.find_leaks(docs.limit(0), items).count() == 0 and leaks.find_leaks(docs, items.limit(0)).count() == 0
    assert sorted(r.doc_id for r in leaks.without_leaks(docs, leaks.find_leaks(docs, items)).collect()) == [2, 3, 4]


# ---- splitting ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["A sentence of some words here. " * 200, "word " * 3000, "x" * 20000, "é" * 5000, "\n" * 4000, "Student: why?\nTutor: because of it.\n" * 200, "# Head\n\nText goes on. And on.\n\n- one\n- two\n" * 120, "🙂" * 1500])
@pytest.mark.parametrize("limit", [33, 64, 512])
def test_pieces_cover_the_text(text, limit):
    enc = encoding(vocabulary())
    pieces = splitting.cut(text, enc, limit, 16)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b in zip(pieces, pieces[1:]):
        assert a[0] < b[0] <= a[1] < b[1]
        assert b[3] <= 16
    assert all(len(encode(enc, text[a:b])) == n <= limit for a, b, n, *_ in pieces)


def test_natural_boundaries_win():
    text = "Student: why does it change?\nTutor: because the slope moves on.\n" * 60
    assert {p[4] for p in splitting.cut(text, encoding(vocabulary()), 128, 16)} == {"turn", "end"}


@pytest.mark.parametrize(("limit", "overlap"), [(64, 8), (48, 8), (16, 7)])
def test_small_limits_and_sentences_as_long_as_the_limit(limit, overlap):
    enc = encoding(vocabulary())
    text = ("The slope of the second plot " * 10 + "ends here. ") * 9
    pieces = splitting.cut(text, enc, limit, overlap)
    assert all(len(encode(enc, text[a:b])) == n <= limit for a, b, n, *_ in pieces) and pieces[-1][1] == len(text)
    with pytest.raises(ValueError, match="below the limit"):
        splitting.cut(text, enc, 10, 7)


def best_cost(count, penalty, limit, overlap):
    """The cost of the best cuts by a plain loop over all candidates."""
    total, n = count[-1], len(count)
    even = (total - overlap) / -(-(total - overlap) // (limit - overlap)) + overlap
    start = [0] + [min((j for j in range(e + 1) if count[j] >= count[e] - overlap and (j < e or count[max(0, e - 1)] < count[e] - overlap)), key=lambda j: (min(penalty[j], 8.0), j)) for e in range(1, n)]
    cost = [0.0] + [float("inf")] * (n - 1)
    for j in range(1, n):
        for i in range(j - 1, -1, -1):
            size = count[j] - count[start[i]]
            if size > limit + overlap:
                break
            if size <= limit:
                cost[j] = min(cost[j], cost[i] + splitting.BALANCE * ((size - even) / even) ** 2 + penalty[j] + splitting.PIECE_COST)
    return cost[-1]


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_the_best_over_all_candidates(seed):
    rng = random.Random(seed)
    enc = encoding(vocabulary())
    text = "".join(rng.choice(["word ", "slope, ", "end. ", "row\n", "Next para.\n\n", "longerword ", "x" * 90 + " "]) if rng.random() < 0.3 else "word " for _ in range(600))
    for limit, overlap in ((128, 16), (300, 0), (64, 20)):
        _, count, kinds = splitting.candidates(text, enc, min(48, (limit - overlap) // 2))
        penalty = splitting.np.array(splitting.PENALTY)[kinds]
        penalty[-1] = 0.0
        got, way = splitting._program(count, penalty, limit, overlap)
        assert abs(got - best_cost(count.tolist(), penalty.tolist(), limit, overlap)) < 1e-9
        assert way[0][0] == 0 and way[-1][1] == len(count) - 1


def test_long_texts_need_memory_for_a_window_only():
    count = splitting.np.arange(20_001)
    penalty = splitting.np.array([8.0, 8.0, 8.0, 1.5] * 5_000 + [0.0])
    tracemalloc.start()
    cost, way = splitting._program(count, penalty, 512, 32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and cost < float("inf")
    assert way[0][0] == 0 and way[-1][1] == 20_000 and all(a < c <= b < d and d - c <= 512 for (a, b), (c, d) in zip(way, way[1:]))


def test_split_table(spark):
    df = spark.createDataFrame([(1, "word " * 700, 1), (2, "short", 1), (3, None, 1), (4, "", 1), (5, "word " * 700, 1)], "doc_id long, text string, piece_no int")
    rows = splitting.split_oversized(df).collect()
    assert {r.doc_id for r in rows} == {1, 5} and all(r.n_pieces == 2 for r in rows)
    assert splitting.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        splitting.split_oversized(df, limit=10, overlap=9)
