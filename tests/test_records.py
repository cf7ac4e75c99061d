"""Readers of other programs' records, plug-ins, and rules of rounds and reports on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from runlens.operators import report, rounds
from runlens.plans import plugins
from runlens.sources import records


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_run_records(spark, tmp_path):
    message = {"event": {"type": "assistant", "message": {"content": [{"type": "tool_use"}, {"type": "text"}, {"type": "tool_use"}]}}, "time": "2026-10-01T05:59:59Z"}
    for name, run, lines in (("a 1", {"session_id": "s1"}, [message, {"event": {"type": "user"}}, message | {"time": "x"}]), ("a2", {}, [message]), ("a3", {"session_id": "s3"}, None)):
        d = tmp_path / name
        d.mkdir()
        (d / "run.json").write_text(json.dumps(run))
        if lines is not None:
            (d / "events.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    sessions, calls = records.run_records(spark, str(tmp_path))
    assert [tuple(r) for r in sessions.collect()] == [("s1", "a 1")] and [tuple(r) for r in calls.collect()] == [("s1", "2026-10-01T05", 2)]


def test_cached_facts_fold_helpers_into_their_session(spark):
    fact = lambda n, **more: {"facts": {"tool_calls_by_utc_hour": {"2026-10-01T05": n}, **more}}
    state = {"p/s1.jsonl": fact(2, hook_timeouts=1), "p/s1/subagents/a.jsonl": fact(3, host_hook_callbacks=2), "q/s2.jsonl": {}}
    calls, marks = records.cached_facts(spark.createDataFrame([(json.dumps(state),)], "raw string"))
    assert [tuple(r) for r in calls.collect()] == [("s1", "2026-10-01T05", 5)]
    assert sorted(tuple(r) for r in marks.collect()) == [("s1", 1, 0, 2), ("s2", 0, 0, 0)]


def test_task_folders(spark, tmp_path):
    def put(path, value):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(value if isinstance(value, str) else json.dumps(value))

    put(tmp_path / "t1" / "task.json", {"sha": "0123456789abcdef", "valid": True, "reason": "ok", "packages": ["./a"], "src_churn": 7})
    put(tmp_path / "t1" / "fairness" / "gate.json", {"stage": "gate", "pass": False, "reason": "probe"})
    put(tmp_path / "t1" / "fairness" / "probe.json", {"pass": False, "reason": "unclear"})
    put(tmp_path / "t1" / "fairness" / "flake.json", "{broken")
    put(tmp_path / "t2" / "retry.json", {"sha": "x", "valid": True, "reason": "infra"})
    put(tmp_path / "t3" / "task.json", {"valid": True})
    put(tmp_path / "t4" / "task.json", {"valid": False, "reason": "tests already pass on parent"})
    put(tmp_path / "t5" / "other.json", {})
    t = records.task_folders(spark, str(tmp_path)).withColumn("why", records.not_ready())
    got = {r["task"]: r for r in t.collect()}
    assert set(got) == {"0123456789ab", "t2", "t3", "t4"} and got["0123456789ab"]["packages"] == ["./a"] and got["0123456789ab"]["churn"] == 7
    assert {k: r["why"] for k, r in got.items()} == {"0123456789ab": "fairness/flake: unreadable", "t2": "pending retry: infra", "t3": None, "t4": "tests already pass on parent"}
    assert got["t2"]["pending"] and not got["t2"]["valid"]


def test_model_documents_of_other_versions_are_refused(spark, tmp_path):
    doc = {"format": records.MODEL_FORMAT, "format_version": 1, "architecture": {"name": "shop"}, "components": [{"name": "cart", "kind": "service", "state": "existing", "source": "svc/cart"}]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    assert [tuple(r) for r in records.architecture(spark, str(tmp_path / "m.json")).collect()] == [("shop", "cart", "service", "existing", "svc/cart")]
    (tmp_path / "n.json").write_text(json.dumps(doc | {"format_version": 2}))
    with pytest.raises(ValueError):
        records.architecture(spark, str(tmp_path / "n.json"))


def test_arguments():
    assert records.arguments(["--a-b", "1", "--c=x=y", "--flag", "--l", "[1]", "--c", "null", "--t", "true"]) == {"a_b": 1, "c": ["x=y", "null"], "flag": True, "l": [1], "t": True}
    with pytest.raises(ValueError):
        records.arguments(["x"])
    assert records.one_or_many(None) == [] and records.one_or_many(3) == [3] and records.one_or_many([1, 2]) == [1, 2]


def test_jsonl_sink(spark, tmp_path):
    for k in (1, 2):
        records.append_rows(spark.createDataFrame([(k, "é")], "a long, b string"), str(tmp_path / "out"))
    assert sorted(r["a"] for r in spark.read.json(str(tmp_path / "out")).collect()) == [1, 2]


def test_scorer_output(spark):
    assert one(spark, records.scorer_record(F.lit('{"a":1}\nlog\n{"a":2}\n[3]'))) == '{"a":2}' and one(spark, records.scorer_record(F.lit('{\n"a": 1\n}'))) == '{\n"a": 1\n}'
    assert one(spark, records.scorer_record(F.lit("nothing"))) is None


def test_miners(spark, tmp_path):
    (tmp_path / "p").mkdir()
    lines = [{"type": "assistant", "sessionId": "s", "timestamp": "2026-10-01T10:00:00Z", "message": {"content": [{"type": "tool_use", "id": "x", "name": "Bash", "input": {"command": "git commit -m x"}}]}}, {"type": "user", "timestamp": "2026-10-01T10:01:00Z", "message": {"content": [{"type": "tool_result", "tool_use_id": "x", "is_error": True, "content": "boom"}]}}]
    (tmp_path / "p" / "s.jsonl").write_text("\n".join(map(json.dumps, lines)))
    for miner in plugins.MINERS.values():
        made = miner(spark, root=str(tmp_path))
        assert set(made) == set(miner.records)
    assert plugins.MINERS["traces"](spark, root=str(tmp_path))["episodes"].count() == 1
    with pytest.raises(ValueError):
        plugins.MINERS["traces"](spark, root=str(tmp_path), other=1)
    assert plugins.Mode("traces", ("a",)).choices() == ["a", "noise", "new_pattern"]


def test_labels_outside_the_vocabulary_are_told_apart(spark):
    labels = spark.createDataFrame([(1, "a", ""), (2, "noise", ""), (3, "new_pattern", "own"), (4, "new_pattern", " "), (5, "b", "")], "id long, pattern string, new_pattern string")
    good, bad = rounds.valid_labels(labels, spark.createDataFrame([("a",)], "id string"))
    assert sorted(r["id"] for r in good.collect()) == [1, 2, 3] and sorted(r["id"] for r in bad.collect()) == [4, 5]


def test_prechecks(spark):
    assert one(spark, rounds.denied(F.lit("rm -rf x"), {"rm": "removes", "curl": "calls out"})) == ["removes"]
    ok = lambda c: one(spark, rounds.read_only(F.lit(c), ["cat", "grep"], ">|rm "))
    assert ok("cat a | grep b; cat c") and not ok("cat a > b") and not ok("ls; cat a")


def test_smoke_tasks_fall_back_to_the_first(spark):
    df = lambda least: spark.createDataFrame([(f"t{i}", i, 1.0 if i >= least else 0.0) for i in range(8)], "task string, ord long, least_reward double")
    pick = lambda least: sorted(r["task"] for r in rounds.smoke_tasks(df(least), 3).collect())
    assert pick(4) == ["t4", "t5", "t6"] and pick(6) == ["t0", "t1", "t2"]


def test_settled_rounds(spark):
    r = spark.createDataFrame([(0,), (1,)], "t long")
    assert one(spark, rounds.settled(r, F.lit(1))) and not one(spark, rounds.settled(r, F.lit(2))) and not one(spark, rounds.settled(r.limit(0), F.lit(0)))
    assert one(spark, rounds.unready(F.lit(6), F.lit(50), 0.1)) and not one(spark, rounds.unready(F.lit(5), F.lit(50), 0.1))


def test_generated_files(spark):
    rows = [("a/x_cgen.go",), ("a/gen/x.go",), ("api/x.pb.go",), ("out/x.go",), ("a/x.go",)]
    df = spark.createDataFrame(rows, "p string")
    assert [r[0] for r in df.select(report.why_generated(F.col("p"), ["out"])).collect()] == ["cgen_name", "heuristic", "heuristic", "csf_generated_path", None]
    assert one(spark, report.why_generated(F.lit("a.go"), None, F.lit("// Code generated by x. DO NOT EDIT."))) == "generated_header"


def test_leaks_allow_signatures_and_end_runs(spark):
    lines = ["func Load(path string) error { return open(path, flags, mode) }", "// a comment that is long enough to count", "func helper(first int, second int) int {", "x := first + second * 2"]
    added = spark.createDataFrame([(1, "a.go", 1, i, "+", x) for i, x in enumerate(lines)], "task long, file string, hunk long, pos long, marker string, line string")
    signatures = spark.createDataFrame([(1, "func Load(path string) error")], "task long, signature string")

    def found(text):
        return tuple(report.leaks(spark.createDataFrame([(1, text)], "task long, text string"), added, signatures).first())

    assert found("# T\nIt needs func Load(path string) error and // a comment that is long enough to count") == (1, 0, 0)
    assert found("# T\nwith func helper(first int, second int) int { in it")[1] == 1
    assert found("{ return open(path, flags, mode) }")[2] > 0
    check = report.instruction_check(spark.createDataFrame([(1, "the fix is x")], "task long, text string"), spark.createDataFrame([(1, 0, 3)], "task long, verbatim long, shared long"), spark.createDataFrame([(1, "Load")], "task long, symbol string")).first()
    assert not check["ok"] and check["reason"] == "leaks the fix (0 verbatim lines, 3 shared 8-token runs); omits Load; mentions the fix is, text before the # title"


def test_mining_longer_than_a_day_is_not_told(spark):
    df = lambda last: spark.createDataFrame([(1, 100, 5.0), (2, last, 1.0)], "task long, written long, seconds double")
    assert report.mining_seconds(df(160)).first()[0] == 65.0 and report.mining_seconds(df(10**6)).first()[0] is None and report.mining_seconds(df(160).limit(1)).first()[0] is None


def test_design_classes(spark):
    c = lambda *a: one(spark, rounds.design_class(*[F.lit(x) for x in a]))
    assert c(False, "ok", False, 1.0, "") == "NO-SUBMISSION" and c(True, "timeout", True, 1.0, "") == "INFRA" and c(True, None, True, 0.0, "") == "passed"
    assert c(True, "ok", False, 1.0, "a Literal") == "MALFORMED" and c(True, "ok", False, 0.5, "") == "INVALID-DESIGN" and c(True, "ok", False, 1.0, "") == "UNDER-TARGET"
