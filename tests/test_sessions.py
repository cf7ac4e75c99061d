"""Transcripts of odd shapes, detectors and joins over small cases worked by hand."""

import json

import pytest
from pyspark.sql import functions as F

from runlens.functions import text
from runlens.operators import events as ev
from runlens.operators import measure, runs, scan, sessions
from runlens.sources import kept, transcripts


def lines_of(spark, *files):
    rows = [(f"p/s{n}.jsonl", i, raw if isinstance(raw, str) else json.dumps(raw)) for n, f in enumerate(files) for i, raw in enumerate(f)]
    return spark.createDataFrame(rows, "file string, line_no int, raw string")


def user(content, **more):
    return {"type": "user", "sessionId": "s", "timestamp": "2026-10-01T10:00:00.000Z", "message": {"content": content}, **more}


def call(id_, name, at="2026-10-01T10:00:00.000Z", **given):
    return {"type": "assistant", "sessionId": "s", "timestamp": at, "cwd": "/r", "gitBranch": "fix", "message": {"content": [{"type": "tool_use", "id": id_, "name": name, "input": given}]}}


def result(id_, content, error=False, **more):
    return user([{"type": "tool_result", "tool_use_id": id_, "is_error": error, "content": content}], **more)


def test_content_is_a_text_or_blocks(spark):
    got = transcripts.events(
        lines_of(
            spark,
            [
                user('["a list in words"]', origin={"kind": "human"}), user([{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": "two"}]), "{broken", user(5),
                result("x", [{"type": "text", "text": "ok"}, {"type": "text", "text": "--- FAIL: TestA"}]), result("y", "plain"), result("z", None),
                call("q", "Bash", command="ls", b=[1, {"z": 1, "a": 2}]),
            ],
        )
    ).orderBy("i").collect()
    assert [(r["kind"], r["text"]) for r in got] == [
        ("human", '["a list in words"]'), ("human", "one\ntwo"), ("tool_result", "ok\n--- FAIL: TestA"), ("tool_result", "plain"), ("tool_result", ""), ("tool_use", None)
    ]
    assert got[-1]["input"] == '{"b":[1,{"a":2,"z":1}],"command":"ls"}'


def test_struggles_of_the_block_form_are_found(spark):
    e = transcripts.events(lines_of(spark, [call("a", "Bash", command="go test ./x"), result("a", [{"type": "text", "text": "--- FAIL: TestA"}], True), call("b", "Bash", command="go test ./x"), user("no, wrong")]))
    got = sorted((r["i"], r["signal"]) for r in sessions.signals(sessions.struggle_marks(e)).collect())
    assert got == [(1, "test_failure"), (1, "tool_error"), (2, "retry"), (3, "user_correction")]
    one = sessions.episodes(sessions.struggle_marks(e)).first()
    assert (one["start_event"], one["end_event"], one["hits"], one["tool_calls"], one["tool_errors"], one["human_turns"]) == (1, 3, 4, 1, 1, 1)
    assert one["signals"] == {"test_failure": 1, "tool_error": 1, "retry": 1, "user_correction": 1}


def test_a_retry_needs_the_latest_like_call_to_have_failed(spark):
    e = transcripts.events(lines_of(spark, [call("a", "Bash", command="x"), result("a", "boom", True), call("b", "Bash", command="x"), result("b", "fine"), call("c", "Bash", command="x"), call("d", "Read", command="x")]))
    assert [r["i"] for r in sessions.signals(sessions.struggle_marks(e)).where("signal = 'retry'").collect()] == [2]


def test_peers_and_repeats(spark):
    peer = '<cross-session-message from-session="s9" from-name="nine">\n hello </cross-session-message>'
    queued = {"type": "attachment", "sessionId": "s", "attachment": {"type": "queued_command", "prompt": peer}}
    told = user("The coordinator sent a message while you were working: x")
    got = transcripts.coordination_events(lines_of(spark, [queued, user(peer), user("typed"), told, user("typed"), user(peer.replace("s9", "s8"))])).orderBy("i").collect()
    assert [(r["kind"], r["sender"], r["text"]) for r in got] == [
        ("peer", "s9", "hello"), ("human", None, "typed"), ("coordinator", "coordinator", told["message"]["content"]), ("peer", "s8", "hello")
    ]
    assert got[0]["sender_name"] == "nine"


def test_polling_stops_at_a_message(spark):
    check = [call(f"c{i}", "Bash", command=f"gh pr view {i % 2}") for i in range(3)]
    e = transcripts.coordination_events(lines_of(spark, [*check, call("m", "SendMessage", to="x"), *check]))
    got = sessions.signals(sessions.coordination_marks(e)).where("signal = 'polling'")
    assert sorted(r["i"] for r in got.collect()) == [2, 6]


def test_lines_keep_their_order_in_splits_of_a_file(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "s.jsonl").write_text("\n".join(json.dumps({"n": i, "pad": "x" * 200}) for i in range(3000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        got = transcripts.read_lines(spark, str(tmp_path)).orderBy("line_no").select("file", F.get_json_object("raw", "$.n").cast("int").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["n"] for r in got] == list(range(3000)) and {r["file"] for r in got} == {"a b/s.jsonl"}


def test_overlaps_of_all_lengths(spark):
    import random

    rng = random.Random(3)
    rows = [(k, w, lo := rng.randrange(5000), lo + rng.choice([0, 3, 40, 900, 10**7])) for k in ("x", "y") for w in range(40) for _ in [0]]
    df = spark.createDataFrame(rows, "key string, who long, lo long, hi long")
    for slack in (0, 25):
        for whole in (False, True):
            got = sorted(tuple(r) for r in ev.overlaps(df, "key", "who", slack, whole).collect())
            f, g = (min, max) if whole else (max, min)
            want = sorted((k, a, b, f(la, lb), g(ha, hb)) for k, a, la, ha in rows for k2, b, lb, hb in rows if k == k2 and a < b and la <= hb + slack and lb <= ha + slack)
            assert got == want


@pytest.mark.parametrize(
    ("said", "want"),
    [("Token: abc", "Token: <secret>"), ("API_KEY=abc", "API_KEY=<secret>"), ("api-key = x", "api-key = <secret>"), ("ghp_0123456789ab", "<secret>"), ("in /home/me/x", "in ~/x"), ("a@b.example.com", "<email>"), ("10.0.0.1", "<ip>")],
)
def test_redaction(spark, said, want):
    assert spark.createDataFrame([(said,)], "t string").select(text.redacted(F.col("t"))).first()[0] == want


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert one(text.title_argument(lit("gh pr create --title 'Fix it now' -t x"))) == "Fix it now" and one(text.title_argument(lit('x --title="" -t short'))) == "short" and one(text.title_argument(lit("x"))) is None
    assert one(text.repo_key(lit("/r/app/worktrees/w1/src/a.go"), "/worktrees/")) == "/r/app//src/a.go" and one(text.repo_of(lit("/r/app/worktrees/w1"), "/worktrees/")) == "/r/app"
    assert one(text.iso_time(text.iso_seconds(lit("2026-10-02T07:00:01.5Z")))) == "2026-10-02T07:00:01.000Z"
    assert one(text.subsystem(lit("svc"), lit("./services/warden/election"))) == "warden" and one(text.area(lit("svc"), lit("./services/warden/election"))) == "svc/services/warden" and one(text.area(lit(""), lit("."))) == "(root)"
    assert one(text.relative_package(lit("svc"), lit("svc/x"))) == "./x" and one(text.relative_package(lit(""), lit(""))) == "./"
    assert one(text.joined_path(lit("./a/"), lit("."))) == "a" and one(text.under(lit("ab/c"), lit("a"))) is False and one(text.under(lit("a/c"), lit("a")))
    assert one(text.truncated(lit("  abcdef "), 3)) == "abc… [6 chars]" and one(text.shortened(lit("a  b\nc"), 3)) == "a b…"
    assert one(text.without_colours(lit("a\x1b[31mb\x1b[0m"))) == "ab" and one(text.last_lines(lit("a\nb\nc\n"), 2)) == "... [1 earlier lines]\nb\nc"
    assert one(text.failure_excerpt(lit("x\n--- FAIL: T\n a\n---- end\nz"))) == "--- FAIL: T\n a"
    assert one(text.unfenced(lit("```markdown\n# T\nbody\n```"))) == "# T\nbody" and one(text.unfenced(lit("Here:\n# T\nx"))) == "# T\nx"
    assert one(text.json_part(lit('so {"a": {"b": 1}} there'))) == '{"a": {"b": 1}}' and one(text.json_part(lit("```json\n[1]\n```"))) == "[1]"
    assert one(text.code_tokens(lit('f("a b", *x) // `y`'))) == ["f", "(", '"a b"', ",", "x", ")", "/", "/", "y"]
    assert [one(text.span_words(lit(d))) for d in (0.01, 0.1, 1.0, 12.25)] == ["under an hour", "2.4 hours", "1 day", "12.3 days"]
    assert [one(text.duration_words(lit(s))) for s in (10.0, 60.0, 660.0, 9000.0)] == ["about 1 minutes", "about 1 minute", "about 11 minutes", "about 2.5 hours"]


def test_fnv_of_a_batch(spark):
    def plain(t):
        h = 0xCBF29CE484222325
        for byte in t.encode():
            h = (h ^ byte) * 0x100000001B3 & (1 << 64) - 1
        return f"{h:016x}"

    said = ["", "a", "foobar", "é" * 40, "x" * 300, None, "b"]
    df = spark.createDataFrame([(t,) for t in said], "t string").coalesce(1)
    assert [r[0] for r in df.select(scan.fnv1a("t")).collect()] == [None if t is None else plain(t) for t in said]


def test_days_close_when_they_are_over(spark):
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    closed = lambda now: spark.range(1).select(measure.day_closed(F.lit("2026-10-01").cast("date"), at(now))).first()[0]
    assert not closed("2026-10-02 06:59:59") and closed("2026-10-02 07:00:00")


def run_row(file, push, request, end, outcome, commits=1, push_end=None):
    return (file, False, commits, push, request, end, push_end, outcome, "silent")


def test_rules_of_runs(spark):
    rows = [
        run_row("a", 60, 60, 3600, "pr_opened", push_end=3540), run_row("b", 60, 1200, 3600, "pr_opened", push_end=3540), run_row("c", None, None, 2400, "never_pushed"),
        run_row("d", None, None, 180, "never_pushed"), run_row("e", 0, None, 5400, "pushed_no_pr", push_end=5400),
    ]
    df = spark.createDataFrame(rows, "file string, subagent boolean, commits long, commit_to_push long, push_to_request long, commit_to_end long, push_to_end long, outcome string, brief string")
    s = {r["minutes"]: r for r in runs.rule_scores(df).collect()}
    assert (s[5]["fires"], s[5]["caught"], s[5]["nags"], s[5]["missed"], s[5]["score"]) == (3, 2, 1, 1, 1) and (s[30]["caught"], s[30]["nags"]) == (2, 0)
    best = runs.best_rule(runs.rule_scores(df)).first()
    assert (best["minutes"], best["score"], best["caught"]) == (2, 2, 3)
    assert sorted((r["file"], r["signal"]) for r in runs.run_signals(df).collect()) == [("b", "slow_pr"), ("c", "never_pushed"), ("d", "never_pushed"), ("e", "pushed_no_pr")]


def test_runs_of_commands(spark):
    def at(m):
        return f"2026-10-01T10:{m:02d}:00.000Z"

    file = [
        call("a", "Bash", at(0), command="git commit -m x"), result("a", "ok"), call("b", "Bash", at(20), command="git push -q origin fix1"), result("b", ""),
        call("c", "Bash", at(25), command="git commit -m y"), result("c", "bad", True), call("d", "Bash", at(30), command="git commit -m z"), result("d", "ok", timestamp=at(31)), user("where is the PR?", timestamp=at(40)),
    ]
    lines = lines_of(spark, file)
    e = transcripts.coordination_events(lines)
    r = runs.runs(e, transcripts.first_prompts(lines)).first()
    assert (r["commits"], r["commits_before_first_push"], r["unpushed_at_end"], r["pushes"], r["requests"], r["outcome"]) == (2, 1, 1, 1, 0, "pushed_no_pr")
    assert (r["commit_to_push"], r["push_to_request"], r["commit_to_end"]) == (1200, None, 2400) and [tuple(t) for t in r["pushed"]] == [("", "fix1")]
    assert [(m["i"], m["signal"]) for m in runs.moments(e).collect()] == [(8, "operator_pr_correction")]
    known = spark.createDataFrame([("", "fix1", 0)], "repo string, branch string, created long")
    assert runs.runs(e, transcripts.first_prompts(lines), known).first()["outcome"] == "pushed_no_pr"


def test_kept_tables_are_made_once(spark):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    assert kept.kept(spark, build, "test", "a").count() == kept.kept(spark, build, "test", "a").count() == 3 and len(made) == 1
