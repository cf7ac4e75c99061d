"""Code, pull-request, result-folder and report operators on small cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import bootstrap, code, pulls
from runlens.sources import reports, results

PATCH = """diff --git a/pkg/x.go b/pkg/x.go
--- a/pkg/x.go
+++ b/pkg/x.go
@@ -1,9 +1,22 @@ type Held struct {
+\tA, B int // two
+\tEmbedded
 \tOld string
+func (r *Repo[T]) Load(f func(int) error) error { return f(1) }
+func helper(s interface{}) int {
+// func not() {}
+\treturn 1
+type Kind int
+type Doer interface {
+\tDo(x int) error
+\tfmt.Stringer
+const (
+\tOne = 1
+\tTwo, Three = 2, 3
+)
+var x, Y = 1, 2
 const old = "an older message that stays here"
-func Gone() {}
diff --git a/pkg/x_test.go b/pkg/x_test.go
--- a/pkg/x_test.go
+++ b/pkg/x_test.go
@@ -1 +1,2 @@
+func TestX() {}
"""
TESTS = """diff --git a/pkg/x_test.go b/pkg/x_test.go
--- a/pkg/x_test.go
+++ b/pkg/x_test.go
@@ -1,2 +1,9 @@
+\tExpect(err).To(MatchError("this exact failure message"))
+\tExpect(s).To(Equal("an older message that stays here"))
+\tin := "this literal is used as an input"
+\tExpect(in).To(Equal("this literal is used as an input"))
+\tExpect(in).To(Equal("told literal, in the statement"))
+\tmock.EXPECT().Save(gomock.Any()).
+\t\tTimes(1).Times(2)
+\tm.EXPECT().Load().Times(3)
+\tm.EXPECT().Drop().Times(0)
+\thelper(r.Load)
+\t// Equal("a comment that is long enough to count")
"""


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_added_declarations(spark):
    got = code.added_declarations(frame(spark, [(1, PATCH), (2, None), (3, "")], "patch_id long, patch string"))
    assert [tuple(r) for r in got.orderBy("pos", "name").select("patch_id", "kind", "name", "signature").collect()] == [
        (1, "field", "A", "A, B int // two"), (1, "field", "B", "A, B int // two"),
        (1, "method", "Load", "func (r *Repo[T]) Load(f func(int) error) error"), (1, "func", "helper", "func helper(s interface{}) int"),
        (1, "type", "Kind", "type Kind int"), (1, "type", "Doer", "type Doer interface"), (1, "method", "Do", "Do(x int) error"),
        (1, "const", "One", "One = 1"), (1, "const", "Three", "Two, Three = 2, 3"), (1, "const", "Two", "Two, Three = 2, 3"),
        (1, "var", "Y", "var x, Y = 1, 2"), (1, "var", "x", "var x, Y = 1, 2"),
    ]


def test_exported_api(spark):
    src = frame(spark, [(1, "a.go", "func A() {\n}\nfunc b() {}\nvar C = 1\nfunc A() {"), (2, "b.go", None)], "patch_id long, file string, source string")
    assert sorted(r["name"] for r in code.exported_api(src).collect()) == ["A", "C"]


def tasks(spark, **more):
    row = {"id": 1, "log": "", "own_module": "ex.org/m", "src_patch": PATCH, "tests_patch": TESTS, "instruction": "", "existing": "", "dirs": ["pkg"]} | more
    schema = "id long, log string, own_module string, src_patch string, tests_patch string, instruction string, existing string, dirs array<string>"
    none = (2, None, None, None, None, None, None, None)
    return frame(spark, [tuple(row[c.split()[0]] for c in schema.split(", ")), none], schema)


def test_required_api(spark):
    log = "x.go:1: undefined: pkg.Kind\nr.Absent undefined (type T has no field or method Absent)\nno required module providing package ex.org/m/sub/new; go get\nundefined: pkg.Kind"
    got = {tuple(r) for r in code.required_api(tasks(spark, log=log)).collect()}
    assert got == {
        (1, "Kind", "type", "type Kind int"), (1, "Absent", "field or method", ""), (1, "sub/new;", "package", ""),
        (1, "Load", "method", "func (r *Repo[T]) Load(f func(int) error) error"), (1, "helper", "func", "func helper(s interface{}) int"),
    }
    assert {r["symbol"] for r in code.required_api(tasks(spark, dirs=["other"])).collect()} == set()


def test_specificity(spark):
    told = "Say told literal, in the statement. Call Load three times; never drop."
    got = {(r["kind"], r["detail"]): r["covered"] for r in code.specificity(tasks(spark, instruction=told)).collect()}
    assert got == {
        ("message", "this exact failure message"): False, ("message", "told literal, in the statement"): True,
        ("call_count", "Save.Times(2)"): False, ("call_count", "Load.Times(3)"): True, ("call_count", "Drop.Times(0)"): True, ("unexported", "func helper"): False,
    }
    known = code.specificity(tasks(spark, existing="x this exact failure message y")).where("kind = 'message'")
    assert [r["detail"] for r in known.collect()] == ["told literal, in the statement"]


@pytest.mark.parametrize(
    ("said", "kind"),
    [
        (None, "none"), (" \n", "none"), ("Do not push to main.", "silent"), ("Do not push anything", "defers"), ("don't push to main, and never open a PR", "defers"),
        ("When done, open the PR", "defers"), ("open a draft PR right away", "early"), ("Push after every commit", "early"), ("fix the bug", "silent"),
        ("never push --force; never push", "defers"),
    ],
)
def test_brief_class(spark, said, kind):
    assert frame(spark, [(said,)], "t string").select(pulls.brief_class(F.col("t"))).first()[0] == kind


def test_push_guess(spark):
    rows = [
        (1, "cd /a && git commit -m 'x; git push' ; git push -q origin fix", "/w", "own"), (2, "git -C ~/r push origin HEAD:refs/heads/topic | tail", "/w", "own"),
        (3, "git push -u origin HEAD", "/w", "own"), (4, "git push", "/w", "HEAD"), (5, "git status; cd /b", "/w", "own"), (6, "git push origin +x:+y", "/w", None), (7, None, "/w", "own"),
    ]
    got = pulls.push_guess(frame(spark, rows, "id long, command string, dir string, branch string"), "/home/me")
    assert {tuple(r) for r in got.collect()} == {(1, "fix", "/a"), (2, "topic", "/home/me/r"), (3, "own", "/w"), (6, "y", "/w")}


def test_slices(spark):
    prs = [
        (1, "Slice S4: parse", ""), (2, "Fix (slice: Big Parser)", ""), (3, "Fix (AB12, part)", None), (4, "Fix", "intro\n## Slice\n\n  The Loader. More\n## Proof\nx"),
        (5, "Fix", "## Proof\nthe slice works"), (6, "Fix", "this PR is the slice alpha, see slice Q7"), (7, "Fix", "mentions slice Q7 only"), (8, None, None), (9, "slice", "## Verification"),
    ]
    got = {r["number"]: (r["slice"], r["evidence"], r["proof"]) for r in pulls.slices(frame(spark, prs, "number long, title string, body string")).collect()}
    assert got == {
        1: ("S4", ["title_slice"], False), 2: ("big-parser", ["title_slice_tag"], False), 3: ("AB12", ["title_id"], False), 4: ("the-loader", ["body_slice_section"], True),
        5: ("pr-5", ["body_proof_section"], True), 6: ("Q7", ["body_slice_statement", "body_slice_id"], False), 9: ("pr-9", ["title_slice"], True),
    }


def test_slice_commits(spark):
    prs = frame(spark, [(1, 0, None, "Slice A1", ""), (2, 1, "m2", "Slice B1", ""), (3, 2, "gone", "Slice C1", ""), (4, 3, "c1", "Slice D1", ""), (5, 4, "c1", "none", "")], "number long, ord long, merge_commit string, title string, body string")
    window = frame(spark, [("c1", 0, "new (#1)", True), ("c0", 5, "old (#1)", True), ("m2", 1, "Merge pull request #2 from x", True), ("b1", 2, "work", False), ("b2", 3, "more", False), ("c9", 9, None, True)], "sha string, ord long, subject string, first_parent boolean")
    branches = frame(spark, [("m2", "b1"), ("m2", "b2"), ("m2", "outside")], "merge string, sha string")
    shas = lambda *s: frame(spark, [(x,) for x in s], "sha string")
    got = {tuple(r) for r in pulls.slice_commits(prs, window, branches, shas("c1", "b1"), shas("b2")).collect()}
    assert got == {(1, "A1", "c1", "candidate", True), (4, "D1", "c1", "candidate", False), (2, "B1", "b1", "candidate", True), (2, "B1", "b2", "rejected", False)}


def test_pass_count_null_has_the_spread_of_binomials(spark):
    rows = [("j", t, i < t % 4) for t in range(40) for i in range(4)]
    r = bootstrap.pass_count_null(frame(spark, rows, "job string, task long, passed boolean"), 4).first()
    want = np.sqrt(sum(4 * (t % 4 / 4) * (1 - t % 4 / 4) for t in range(40)))
    assert r["tasks"] == 40 and abs(r["sd"] - want) < 0.3 and r["p01"] <= r["p05"] < 0


def test_hard_drop_null(spark):
    rows = [("j", t, float(i % 2)) for t in range(30) for i in range(4)] + [("k", 1, 1.0), ("k", 2, None)]
    got = {r["job"]: r for r in bootstrap.hard_drop_null(frame(spark, rows, "job string, task long, reward double"), 4, 0.5).collect()}
    assert abs(got["j"]["drops_mean"] - 30 / 16) < 0.4 and abs(got["j"]["gains_mean"] - 30 / 16) < 0.4 and got["j"]["drops_p99"] >= got["j"]["drops_p95"]
    assert (got["k"]["drops_mean"], got["k"]["gains_mean"]) == (0, 0)


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_trial_results(spark, tmp_path):
    t = tmp_path / "jobs" / "j 1" / "a+b"
    put(t / "t0" / "meta.json", {"total_tokens": 5, "wall_s": 1.5, "status": "ok", "no_payload": True})
    put(t / "t0" / "verdict.json", {"combined_score": 0.5, "passed": True, "valid": 1, "status": "graded"})
    put(t / "t1" / "meta.json", {"total_tokens": 5})
    put(t / "t2" / "meta.json", {})
    put(t / "t2" / "verdict.json", "not json")
    put(t / "t3" / "verdict.json", {"combined_score": 1})
    got = {r["trial"]: r for r in results.trial_results(spark, str(tmp_path)).collect()}
    assert set(got) == {"t0", "t1", "t2"} and got["t0"]["job"] == "j 1" and got["t0"]["task"] == "a+b"
    assert tuple(got["t0"])[3:] == (True, 0.5, True, 1.0, "graded", True, 5, 1.5, "ok")
    assert not got["t1"]["graded"] and got["t1"]["score"] is None
    assert got["t2"]["graded"] and got["t2"]["score"] == 0.0 and got["t2"]["passed"] is False


def test_result_files(spark, tmp_path):
    put(tmp_path / "job" / "x1" / "result.json", {"task_name": "org/set/fix", "verifier_result": {"rewards": {"reward": 1}}})
    put(tmp_path / "job" / "x2" / "result.json", {"task_name": "plain", "verifier_result": None})
    put(tmp_path / "job" / "x3" / "result.json", "{broken")
    assert {tuple(r) for r in results.result_files(spark, str(tmp_path)).collect()} == {("job", "x1", "fix", 1.0), ("job", "x2", "plain", None)}


def test_rubric_results(spark, tmp_path):
    put(tmp_path / "jobs" / "j" / "s0" / "a" / "scores.json", {"total": 4, "passed": 3, "all_pass": 0})
    put(tmp_path / "jobs" / "j" / "s0" / "a" / "trajectory.json", {"usage": {"total_tokens": 9}})
    put(tmp_path / "jobs" / "j" / "s1" / "a" / "scores.json", {"total": 2, "passed": 2, "all_pass": 1})
    tasks = frame(spark, [("j", "a", 4), ("j", "b", 0)], "job string, task string, criteria long")
    got = {tuple(r)[1:] for r in results.rubric_results(spark, str(tmp_path), tasks, 2).collect()}
    assert got == {("a", 0, 0.75, 4.0, 3.0, False, 9, False), ("a", 1, 1.0, 2.0, 2.0, True, None, False), ("b", 0, 0.0, 1.0, 0.0, False, None, True), ("b", 1, 0.0, 1.0, 0.0, False, None, True)}


def test_reports(spark, tmp_path):
    df = frame(spark, [("a|b", 1.5), ("</script><!--", None)], "name string, v double")
    assert reports.markdown("T", df) == "# T\n\n| name | v |\n|-|-|\n| a\\|b | 1.5 |\n| </script><!-- |  |\n"
    page = reports.page("T & U", {"x": df})
    held = page.split('id="data">')[1].split("</script>")[0]
    assert json.loads(held)["x"][1] == {"name": "</script><!--", "v": None} and page.count("</script>") == 1
    with pytest.raises(ValueError):
        reports.report_rows(df, 1)
    with pytest.raises(ValueError):
        reports.write_report("x", str(tmp_path / ".." / "r.md")) if (tmp_path.parent / ".git").exists() else (tmp_path / ".git").mkdir() or reports.write_report("x", str(tmp_path / "r.md"))


def test_shell_counts(spark):
    rows = [
        (1, "git add . && git commit -m 'a; git push' && git push -u origin x"), (2, "git commit --amend; git push --dry-run"), (3, "gh pr create --draft; gh pr create --help"),
        (4, "gh api repos/o/r/pulls -f title=x"), (5, "gh api -X POST repos/o/r/pulls"), (6, "gh api --method=GET repos/o/r/pulls -f state=open"), (7, None),
    ]
    got = {tuple(r) for r in pulls.shell_counts(frame(spark, rows, "id long, command string")).collect()}
    assert got == {(1, 1, 1, 0), (2, 0, 0, 0), (3, 0, 0, 1), (4, 0, 0, 1), (5, 0, 0, 1), (6, 0, 0, 0), (7, 0, 0, 0)}


def test_asks_for_request(spark):
    said = [("Where's the PR?", True), ("this needs a draft pr", True), ("it hasn't been pushed", True), ("thanks", False), (None, False)]
    assert [r[0] for r in frame(spark, said, "t string, want boolean").select(pulls.asks_for_request(F.col("t")) == F.col("want")).collect()] == [True] * 5
