"""Operators on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from runlens.functions import stats, text
from runlens.operators import bootstrap, diffs, events, exam, joins, scan, trials
from runlens.sources import transcripts
from runlens.streaming import windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_episodes_merge_by_gap(spark):
    hits = spark.createDataFrame([(1, i) for i in (0, 6, 13, 14, 30)], "f long, i long")
    spans = events.episode_spans(events.merged_episodes(hits, "f"), "f")
    assert rows(spans) == [(1, 0, 0, 6, 2), (1, 1, 13, 14, 2), (1, 2, 30, 30, 1)]


def test_context_keeps_both_ends(spark):
    ev = spark.createDataFrame([(1, i) for i in range(60)], "f long, i long")
    span = spark.createDataFrame([(1, 0, 5, 50, 9)], "f long, episode long, start_event long, end_event long, hits long")
    got = sorted(r["event"] for r in events.context(span, ev, "f").collect())
    assert got == [*range(2, 14), *range(41, 53)]


@pytest.mark.parametrize(
    ("said", "hit"),
    [("no", True), ("why did you do that", True), ("It is not what I meant, really", True), ("thanks, great", False), ("PLEASE STAHP DOING that", True), ("JSON HTTP", False), ("x" * 281 + " no", False)],
)
def test_correction(spark, said, hit):
    df = spark.createDataFrame([(said,)], "t string")
    assert df.select(text.correction(F.col("t"))).first()[0] is hit


def test_reask_needs_an_answer_between(spark):
    ask = "make the parser accept empty input files"
    t = [(1, 0, "user", ask), (1, 1, "user", ask), (1, 2, "assistant", "done"), (1, 3, "user", ask + " again")]
    got = rows(events.reasks(spark.createDataFrame(t, "conv_id long, turn long, role string, text string")))
    assert [(c, n, e) for c, n, e, _ in got] == [(1, 3, 1)]


def test_overlaps_equal_all_pairs(spark):
    iv = [("x", w, w * 700 % 5000, w * 700 % 5000 + w * 37 % 900) for w in range(40)]
    df = spark.createDataFrame(iv, "file string, who long, lo long, hi long")
    want = {(a[1], b[1]) for a in iv for b in iv if a[1] < b[1] and a[2] <= b[3] + 600 and b[2] <= a[3] + 600}
    got = [(r["a"], r["b"]) for r in events.overlaps(df, "file", "who", 600).collect()]
    assert set(got) == want and len(got) == len(want)


def test_intervals(spark):
    df = spark.createDataFrame([(0, 1000), (100, 10000), (0, 0)], "k long, n long")
    low, high = stats.poisson_interval(F.col("k"), F.col("n"))
    got = [tuple(r) for r in df.select(low, high).collect()]
    assert got[0][0] == 0 and got[0][1] == pytest.approx(3.69, abs=0.05)
    assert got[1] == (pytest.approx(8.14, abs=0.1), pytest.approx(12.16, abs=0.1)) and got[2] == (None, None)


@pytest.mark.parametrize(("ks", "verdict"), [([800, 400, 200, 100], "Declining"), ([100, 103, 100, 103], "Flat"), ([100, 200, 400], "Rising"), ([5, 5], "Not estimable")])
def test_trend(spark, ks, verdict):
    df = spark.createDataFrame([(float(i), float(k), 10000) for i, k in enumerate(ks)], "i double, k double, n long")
    got = stats.weighted_trend(df).first()
    assert got["verdict"] == verdict
    if verdict == "Declining":
        assert got["factor"] == pytest.approx(0.5, abs=0.01)


def test_scores_and_missing_trials(spark):
    t = spark.createDataFrame([("j", "a", 1.0, 10.0, 5.0), ("j", "a", 0.5, 10.0, 0.0), ("j", "b", 0.0, 90.0, 7.0), ("j", "b", 0.0, 90.0, None)], "job string, task string, reward double, weight double, tokens double")
    got = trials.job_scores(t).first()
    assert (got["score"], got["cost"]) == (pytest.approx(15 / 200), 6.0)
    dense = trials.densified(trials.first_trials(t, 3, "reward"), 3)
    assert dense.count() == 6 and dense.where("missing").count() == 2


def test_selection(spark):
    c = [(1, 1, 0.7, 1.0), (1, 2, 0.6, 1.0), (1, 3, 0.3, 1.0)]
    df = spark.createDataFrame(c, "grp long, ord long, score double, cost double").withColumns({"base_score": F.lit(0.5), "base_cost": F.lit(1.0), "best_score": F.lit(0.55)})
    got = {r["ord"]: (r["reason"], r["chosen"]) for r in trials.decide(df, 0.05, 0.1).collect()}
    assert got == {1: ("admitted", True), 2: ("admitted", False), 3: ("below floor", False)}


def test_joins(spark):
    files = spark.createDataFrame([("a/b/c.go",), ("a/x.go",), ("z.go",)], "path string")
    owners = spark.createDataFrame([("a", "A"), ("a/b", "B")], "prefix string, owner string")
    assert {r["path"]: r["owner"] for r in joins.longest_prefix(files, owners).collect()} == {"a/b/c.go": "B", "a/x.go": "A", "z.go": None}
    sets = [(i, [f"w{(i * k) % 11}" for k in range(1, 7)]) for i in range(1, 25)]
    df = spark.createDataFrame(sets, "id long, ws array<string>")
    want = {(a, b) for a, x in sets for b, y in sets if a < b and len({*x}) >= 3 and len({*y}) >= 3 and len({*x} & {*y}) / len({*x} | {*y}) >= 0.5}
    assert {(r["a"], r["b"]) for r in joins.similar_pairs(df, "id", F.col("ws")).collect()} == want


def test_shell_and_hash(spark):
    assert diffs.shell_code("git commit -m 'a b' && git push \"origin\"") == "git commit -m  && git push origin"
    df = spark.createDataFrame([("",), ("a",), (None,)], "t string")
    assert [r[0] for r in df.select(scan.fnv1a("t")).collect()] == ["cbf29ce484222325", "af63dc4c8601ec8c", None]


def test_recent_repeats(spark):
    t = [(1, i, v) for i, v in enumerate(["a", "a", "b", "a", None, None])]
    got = rows(scan.without_recent_repeats(spark.createDataFrame(t, "k long, n long, v string"), "k", "n", "v"))
    assert [n for _, n, _ in got] == [0, 2, 4, 5]


def test_bootstrap_repeats(spark):
    df = spark.createDataFrame([("a", float(i % 7)) for i in range(50)], "g string, v double")
    one, two = (bootstrap.median_interval(df, "g", "v").first() for _ in range(2))
    assert one == two and one["low"] <= one["median"] <= one["high"]


def test_outcome_order(spark):
    own = "cannot find module providing package ex.org/m/x: module lookup disabled by GOPROXY=off"
    cases = [
        (0, "--- FAIL", None, "pass"), (1, "undefined: X\n--- FAIL: a", None, "build_fail"), (1, "i/o timeout", None, "infra"), (124, "x", None, "timeout"), (3, "?", None, "infra"),
        (1, "dial tcp\n[build failed]", None, "infra"), (1, own, "ex.org/m", "build_fail"), (1, own, "ex.org/other", "infra"), (1, own + "\ngo: downloading x", "ex.org/m", "infra"),
        (1, "x.go:1 [setup failed]", None, "build_fail"), (1, "x.go:1 module [setup failed]", None, "infra"), (1, "a [FAIL] b", None, "test_fail"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "c int, l string, own string")
    assert [r[0] for r in df.select(exam.outcome(F.col("c"), F.col("l"), F.col("own"))).collect()] == [c[3] for c in cases]


def test_transcripts(spark, tmp_path):
    lines = [
        {"type": "user", "sessionId": "s", "timestamp": "t0", "message": {"content": "hello there"}},
        {"type": "user", "sessionId": "s", "message": {"content": "hello there"}},
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "x", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "x", "is_error": True, "content": "boom"}]}},
        {"type": "user", "isMeta": True, "message": {"content": "meta"}},
        {"type": "user", "message": {"content": "<command>"}},
    ]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "s.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    got = transcripts.events(transcripts.read_lines(spark, str(tmp_path))).orderBy("i").collect()

    assert [r["kind"] for r in got] == ["human", "assistant", "tool_use", "tool_result"]
    assert got[3]["is_error"] and got[3]["tool_id"] == "x" and {r["session_id"] for r in got} == {"s"}


def test_streams(spark, tmp_path):
    hits = spark.createDataFrame([(1, i) for i in (0, 3, 20, 40)], "session long, i long")
    hits.coalesce(1).write.parquet(str(tmp_path / "hits"))
    stream = windows.episodes(spark.readStream.schema(hits.schema).parquet(str(tmp_path / "hits")))
    q = stream.writeStream.format("memory").queryName("episodes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("episodes")) == [(1, 0, 3, 2), (1, 20, 20, 1)]


def test_score_error_is_that_of_resampling_within_tasks(spark):
    t = [("j", k, float(i < k), 1.0) for k in range(5) for i in range(4)]
    r = bootstrap.score_error(spark.createDataFrame(t, "job string, task long, reward double, weight double")).first()
    want = sum(4 * k / 4 * (1 - k / 4) for k in range(5)) ** 0.5 / 20
    assert (r["n"], r["score"]) == (20, 0.5) and abs(r["se"] - want) < 0.1 * want
    assert abs(r["band"] - 1.645 * 2**0.5 * r["se"]) < 1e-5
