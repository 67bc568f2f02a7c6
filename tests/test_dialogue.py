import pytest
from pyspark.sql import functions as F

from tutorgrain.functions import text as T
from tutorgrain.operators import exchanges as X
from tutorgrain.sources import files, scorers
from tutorgrain.sources.transcripts import labelled_region, parse_transcript, transcript_turns


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("a\r\n\r\n\r\n\r\nb \t c", "a\n\nb c"), (None, ""), ("  x ", "x")])
def test_normalize(spark, raw, want):
    assert one(spark, raw, T.normalize_text) == want


@pytest.mark.parametrize(("raw", "want"), [("", ["empty_or_near_empty"]), ("ok", ["acknowledgement_only", "low_content_short"]), ("why?", []), ("step 2", []), ("hello", ["greeting_only", "low_content_short"])])
def test_noise(spark, raw, want):
    assert one(spark, raw, T.noise_flags) == want


def test_ngrams_and_acronyms(spark):
    assert one(spark, "a b c", lambda c: T.ngrams(F.split(c, " "))) == ["a b", "b c", "a b c"]
    assert one(spark, "x", lambda c: T.ngrams(F.split(c, " "))) == []
    assert one(spark, "The SSE of K2 is Ok", T.acronyms) == ["SSE", "K2"]


def turns(spark, roles):
    df = spark.createDataFrame([("d", i, r, "text", []) for i, r in enumerate(roles)], "d string, n int, speaker string, body string, flags array<string>")
    return df


def walk(roles):
    out, i = [], 0
    while i < len(roles):
        size = 3 if roles[i : i + 3] == ["tutor", "student", "tutor"] else 2 if roles[i : i + 2] == ["student", "tutor"] else 1
        out.append((len(out), i, i + size - 1))
        i += size
    return out


@pytest.mark.parametrize("pattern", ["", "s", "stst", "tstts", "uust", "tsttstst", "ssttst", "tts"])
def test_greedy_equals_walk(spark, pattern):
    roles = [{"s": "student", "t": "tutor", "u": "unknown"}[c] for c in pattern]
    got = sorted((r.exchange_index, r.turn_start, r.turn_end) for r in X.greedy_exchanges(turns(spark, roles)).collect())
    assert got == walk(roles)


def test_runs_do_not_depend_on_partitions(spark):
    df = turns(spark, ["student", "student", "tutor", "unknown", "tutor", "student"])
    want = [("SST", "ok"), ("U", "unknown_speaker_present"), ("T", "missing_student"), ("S", "missing_tutor")]
    for n in (1, 8):
        got = X.run_exchanges(df.repartition(n)).orderBy("exchange_index").collect()
        assert [(r.roles_pattern, r.status) for r in got] == want


def test_transcripts(spark):
    text = "header\nStudent: hi\nthere\n[T] yes\nStudent {\nwhat\n}\nTutor: ok\n"
    got = [(t[1], t[2], t[5]) for t in parse_transcript(text)]
    assert got == [("unknown", "header", 0.35), ("student", "hi\nthere", 0.98), ("tutor", "yes", 0.88), ("student", "what", 0.95), ("tutor", "ok", 0.98)]
    assert parse_transcript(None) == [] and parse_transcript("S {open")[0][5] == 0.3
    df = spark.createDataFrame([("a", text), ("b", None)], "key string, text string")
    assert transcript_turns(df, "key", "text").count() == 5
    assert labelled_region(df, "key", "text").count() == 4


def test_files(spark, tmp_path):
    p = tmp_path / "d.jsonl"
    p.write_text('{"id": "a", "messages": [{"speaker": "user", "message": "x"}]}\n\n{"dialogue_id": "b", "turns": []}\n')
    assert [tuple(r) for r in files.read_dialogues(spark, str(p)).collect()] == [("a", 0, "user", "x")]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="(?i)failfast|malformed"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    assert files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int", strict=False).toPandas()["_corrupt_record"].notna().sum() == 1
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int", missing_ok=True).count() == 0
    (tmp_path / "gold.json").write_text('{"ex_0003": {"primary": "K", "secondary": ["L"], "type": "t"}}')
    assert tuple(files.read_gold(spark, str(tmp_path / "gold.json"), "c").first())[:3] == ("c", 3, "K")
    (tmp_path / "pairs.json").write_text('[{"student": {"text": "q"}, "tutor": {"text": "a"}}]')
    assert [tuple(r)[1:] for r in files.read_pair_list(spark, str(tmp_path / "pairs.json"), "c").collect()] == [(0, "student", "q"), (1, "tutor", "a")]
    assert files.sniff("x.jsonl", "") == "jsonl" and files.sniff("x", "[1]") == "json" and files.sniff("x", "S: hi") == "text"
    assert files.discover(str(tmp_path), ["zzz", "bad"]).endswith("bad.jsonl")
    lib = spark.createDataFrame([("u", "kc"), ("u", "kc")], "unit_id string, unit_type string")
    with pytest.raises(Exception, match="repeated unit_id"):
        files.checked_library(lib).collect()
    assert "| u |" in files.markdown_report("t", lib.limit(1).select("unit_id"))
    assert files.run_manifest({"l": lib}) == files.run_manifest({"l": lib.repartition(3)})


def test_scorers(spark):
    df = spark.createDataFrame([("a b", "a c"), (None, "x")], "l string, r string")
    assert [r.score for r in scorers.score_pairs(df, "l", "r", scorers.overlap_scorer).collect()] == [0.5, 0.0]
    pool = spark.createDataFrame([("q", "u", 0.9, 1), ("q", "v", 0.8, 2)], "q string, unit_id string, score double, pool_rank int")
    p = spark.createDataFrame([("q", "u", 0.1), ("q", "v", 0.9)], "q string, unit_id string, p double")
    out = {r.unit_id: r.pool_rank for r in scorers.apply_tie_break(pool, scorers.order_averaged(p, p, ["q", "unit_id"], "p"), "q").collect()}
    assert out == {"v": 1, "u": 2}
