"""What a report of an exam says: commits that could be tasks, gates, the health of a split, examples and durations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text
from . import exam

# Limits of a candidate, and parts of names of generated files.
MOST_CHURN, MOST_PACKAGES = 400, 3
GENERATED = ["/gen/", ".pb.go", "_cgen", "zz_generated", "_string.go"]
# Limits of the checks of a split.
CHURN_RATIO, MOST_SHARE, MOST_TREE_GAP, MOST_OUTCOME_GAP, LEAST_DAYS = (0.67, 1.5), 0.40, 0.30, 0.30, 7.0


def numstat(shown: DataFrame) -> DataFrame:
    """(sha, path, churn) of the lines of ``shown(sha, text)``: added and deleted lines and a path between tabs; binary files count 0."""
    lines = shown.select("sha", F.explode(F.split("text", "\\r?\\n")).alias("line")).select("sha", F.split("line", "\t").alias("f")).where(F.size("f") >= 3)
    n = lambda i: F.coalesce(F.col("f")[i].try_cast("long"), F.lit(0))
    return lines.select("sha", F.col("f")[2].alias("path"), (n(0) + n(1)).alias("churn"))


def why_generated(path: Column, roots: list[str] | None = None, header: Column | None = None) -> Column:
    """Which rule makes a file generated, the cheap ones first; null for none. ``header`` is the file's first lines."""
    stem = F.split_part(F.element_at(F.split(path, "/"), -1), F.lit("."), F.lit(1))
    declared = F.exists(F.array(*[F.lit(r) for r in roots]), lambda r: text.under(path, r)) if roots else F.lit(False)
    noticed = F.coalesce(header.rlike("Code generated .*DO NOT EDIT"), F.lit(False)) if header is not None else F.lit(False)
    named = F.exists(F.array(*[F.lit(g) for g in GENERATED]), lambda g: F.contains(path, g))
    return F.when(stem.endswith("_cgen"), "cgen_name").when(named, "heuristic").when(declared, "csf_generated_path").when(noticed, "generated_header")


def candidates(files: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """(sha, src_churn, packages, reason) of commits by ``files(sha, path, churn)``: reason is null for candidates.

    Sources are Go files that are no tests and not generated; packages change both a source and a test. Rules apply in order.
    """
    go = files.where(F.col("path").endswith(".go"))
    test = F.col("path").endswith("_test.go")
    made = why_generated(F.col("path"), roots)
    source = ~test & made.isNull()
    folder = text.folder_of(F.col("path"))
    c = go.groupBy("sha").agg(
        F.sum(F.when(source, F.col("churn")).otherwise(0)).alias("src_churn"), F.collect_set(F.when(source, folder)).alias("src"), F.collect_set(F.when(test, folder)).alias("tst"),
        F.bool_or(~test & made.isNotNull()).alias("generated"),
    )
    c = c.withColumn("packages", F.array_sort(F.array_intersect("src", "tst")))
    reason = (
        F.when(F.size("src") == 0, F.when(F.col("generated"), "only generated code changed").otherwise("no Go source change"))
        .when(F.size("packages") == 0, "no package changes both source and tests")
        .when(F.col("src_churn") > MOST_CHURN, F.concat(F.lit("source churn "), F.col("src_churn").cast("string"), F.lit(f" > {MOST_CHURN}")))
        .when(F.size("src") > MOST_PACKAGES, F.concat(F.lit("source spans "), F.size("src").cast("string"), F.lit(f" packages > {MOST_PACKAGES}")))
    )
    return c.select("sha", "src_churn", "packages", reason.alias("reason"))


def mapped_files(files: DataFrame, owners: DataFrame) -> DataFrame:
    """(task, components, kinds, state, mapped, total) of ``files(task, path)`` by the longest prefix among ``owners(prefix, name, kind, state)``."""
    tried = files.select("task", "path", F.explode(text.path_prefixes(F.col("path"))).alias("prefix")).join(owners, "prefix")
    best = tried.groupBy("task", "path").agg(F.max_by(F.struct("name", "kind", "state"), F.length("prefix")).alias("o"))
    all_ = files.select("task", "path").distinct().join(best, ["task", "path"], "left")
    named = lambda c: F.array_sort(F.collect_set(F.col(f"o.{c}")))
    out = all_.groupBy("task").agg(named("name").alias("components"), named("kind").alias("kinds"), F.collect_set("o.state").alias("states"), F.count("o").alias("mapped"), F.count("*").alias("total"))
    state = F.when(F.size("states") == 1, F.col("states")[0]).when(F.size("states") > 1, "mixed")
    return out.select("task", "components", "kinds", state.alias("state"), "mapped", "total")


def required(status: Column) -> Column:
    """A guard binds an agent if the task's own fix passed it."""
    return status == "pass"


def gate_table(verdicts: DataFrame) -> DataFrame:
    """(gate, pass, fail, error, skipped, required) of ``verdicts(task, gate, status)``; an unknown status is an error."""
    s = F.when(F.col("status").isin("pass", "fail", "skipped"), F.col("status")).otherwise("error")
    n = lambda c: F.sum(c.cast("long"))
    return verdicts.withColumn("s", s).groupBy("gate").agg(*[n(F.col("s") == v).alias(v) for v in ("pass", "fail", "error", "skipped")], n(required(F.col("status"))).alias("required"))


def gate_totals(verdicts: DataFrame) -> DataFrame:
    """One row: tasks with a failing gate, tasks that any gate was run for, and whether all gates were skipped."""
    return verdicts.agg(
        F.count_distinct(F.when(F.col("status") == "fail", F.col("task"))).alias("failing"), F.count_distinct(F.when(F.col("status") != "skipped", F.col("task"))).alias("checked"),
        F.bool_and(F.col("status") == "skipped").alias("all_skipped"),
    )


def components_by_split(tasks: DataFrame, none: str = "(no declared component)") -> DataFrame:
    """(component, practice, held_out, excluded, place) of ``tasks(split, components)``: a task counts in each of its components, one without any in
    a row of its own, which comes last; others by size, then name."""
    named = F.when(F.size("components") > 0, F.col("components")).otherwise(F.array(F.lit(none)))
    t = tasks.select("split", F.explode(named).alias("component"))
    n = lambda v: F.sum((F.col("split") == v).cast("long"))
    c = t.groupBy("component").agg(n("practice").alias("practice"), n("held_out").alias("held_out"), n("excluded").alias("excluded"))
    order = [F.col("component").startswith("("), F.desc(F.col("practice") + F.col("held_out") + F.col("excluded")), F.col("component")]
    return c.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # components are few


def top_areas(tasks: DataFrame, column: str = "area", most: int = 6) -> DataFrame:
    """(area, share) of the areas with the largest share in either split, ties by name."""
    d = exam.share_difference(tasks, column)
    return d.select(column, F.greatest("practice", "held_out").alias("share")).orderBy(F.desc("share"), column).limit(most)


def _largest(tasks: DataFrame, column: str, check: str) -> DataFrame:
    """The largest share of held-out tasks in one value, the least value of equal ones."""
    h = tasks.where("split = 'held_out'")
    c = h.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("k"))
    top = c.agg(F.min(F.struct((-F.col("k")).alias("o"), "key")).alias("t"), F.sum("k").alias("n"))
    share = -F.col("t.o") / F.col("n")
    return top.select(F.lit(check).alias("id"), F.col("t.key").alias("key"), share.alias("value"), F.lit(None).cast("double").alias("other"), (share <= MOST_SHARE).alias("ok"))


def _widest(tasks: DataFrame, column: str, check: str, most: float) -> DataFrame:
    """The largest difference of shares between the splits, the least value of equal ones; none if a split is empty."""
    d = exam.share_difference(tasks, column).where(F.col(column).isNotNull())
    both = tasks.agg((F.bool_or(F.col("split") == "practice") & F.bool_or(F.col("split") == "held_out")).alias("both"))
    top = d.agg(F.min(F.struct((-F.col("difference")).alias("o"), F.col(column).alias("key"), "practice", "held_out")).alias("t")).crossJoin(both)  # one row each
    some = lambda c: F.when(F.col("both"), c)
    return top.select(F.lit(check).alias("id"), some(F.col("t.key")).alias("key"), some(F.col("t.held_out")).alias("value"), some(F.col("t.practice")).alias("other"), some(-F.col("t.o") <= most).alias("ok"))


def health(tasks: DataFrame) -> DataFrame:
    """(id, key, value, other, ok) of the six checks of ``tasks(split, churn, area, component, tree, outcome, ts)``; ok is null where it cannot be told.

    churn: median of the held-out over that of the practice tasks; area, component: largest share of the held-out ones; tree, outcome: widest
    difference of shares; span: days between the oldest and newest held-out task.
    """
    m = tasks.groupBy().agg(F.percentile(F.when(F.col("split") == "held_out", F.col("churn")), F.lit(0.5)).alias("h"), F.percentile(F.when(F.col("split") == "practice", F.col("churn")), F.lit(0.5)).alias("p"))
    ratio = F.when(F.col("p") > 0, F.col("h") / F.col("p"))
    churn = m.select(F.lit("churn").alias("id"), F.lit(None).cast("string").alias("key"), F.col("h").alias("value"), F.col("p").alias("other"), ratio.between(*CHURN_RATIO).alias("ok"))
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    span = tasks.where("split = 'held_out'").agg(((F.max(at) - F.min(at)) / 86400).alias("value"))
    span = span.select(F.lit("span").alias("id"), F.lit(None).cast("string").alias("key"), "value", F.lit(None).cast("double").alias("other"), (F.col("value") >= LEAST_DAYS).alias("ok"))
    out = churn.unionByName(_largest(tasks, "area", "area")).unionByName(_largest(tasks, "component", "component"))
    return out.unionByName(_widest(tasks, "tree", "tree", MOST_TREE_GAP)).unionByName(_widest(tasks, "outcome", "outcome", MOST_OUTCOME_GAP)).unionByName(span)


def verdict(checks: DataFrame) -> DataFrame:
    """(warnings, verdict) in words, of the rows that ``health`` gives."""
    warn = lambda i: F.bool_or((F.col("id") == i) & ~F.col("ok"))
    n = lambda c: F.sum(c.cast("int"))
    w = checks.agg(
        *[F.coalesce(warn(i), F.lit(False)).alias(i) for i in ("churn", "area", "component", "tree", "outcome", "span")], F.coalesce(n(~F.col("ok")), F.lit(0)).alias("warnings"),
        n(F.col("ok").isNull()).alias("open"), F.count("*").cast("int").alias("n"), F.max(F.when(F.col("id") == "churn", F.col("value") < F.col("other"))).alias("smaller"),
    )
    c, s = F.col, lambda x: F.col(x).cast("string")
    adjectives = F.array_compact(F.array(F.when(c("area") | c("component") | c("tree"), "narrower"), F.when(c("churn"), F.when(c("smaller"), "easier").otherwise("harder"))))
    none = F.size(adjectives) == 0
    what = F.when(none, "the final exam (held-out) differs from the practice set (evolve)").otherwise(
        F.concat(F.lit("the final exam (held-out) is "), F.array_join(adjectives, " and "), F.lit(" than the practice set (evolve)"))
    )
    what = F.concat(what, F.when(c("outcome"), F.when(none, " in the kind of task").otherwise(" and asks for a different kind of task")).otherwise(""), F.when(c("span"), ", and it covers only a very short stretch of work").otherwise(""))
    fix = F.concat(
        F.when(c("span"), "hold out the newest ~2 weeks of work").otherwise("hold out more tasks"), F.when(c("area") | c("component") | c("outcome"), ", balanced across subsystems and task kinds").otherwise(""),
        F.when(c("tree") | c("churn"), ", or mine further back so both sets draw from the same code").otherwise(""),
    )
    tail = F.when(c("open") > 0, F.concat(F.lit(" ("), s("open"), F.lit(" could not be checked yet)"))).otherwise("")
    good = F.concat(
        (c("n") - c("open")).cast("string"), F.lit(" of "), s("n"), F.lit(" checks pass"), tail,
        F.lit(": the final exam (held-out) looks like the practice set (evolve), so a gap between their scores can be read as learning versus memorizing."),
    )
    bad = F.concat(s("warnings"), F.lit(" of "), s("n"), F.lit(" checks warn: "), what, F.lit(", so its score would be hard to interpret. Suggested fix: "), fix, F.lit("."))
    return w.select("warnings", F.when(c("warnings") == 0, good).otherwise(bad).alias("verdict"))


def worked_example(tasks: DataFrame) -> DataFrame:
    """The task to show in full: told in words, of readable size, failing by an assertion, from the practice set, small; ties by task."""
    readable = F.col("churn").between(5, 60) & F.col("test_lines").between(8, 80)
    order = [~F.col("told"), ~readable, F.col("parent") != "test_fail", F.col("split") != "practice", F.col("churn"), F.col("task")]
    return tasks.where("split <> 'excluded'").orderBy(*order).limit(1)


def mining_seconds(tasks: DataFrame) -> DataFrame:
    """(seconds) from when the first task's check began to when the last was written; null for one task or more than a day."""
    t = tasks.where("written is not null")
    s = t.agg((F.max("written") - F.min("written") + F.min_by("seconds", "written")).alias("s")).crossJoin(tasks.agg(F.count("*").alias("n")))  # one row each
    return s.select(F.when((F.col("n") > 1) & (F.col("s") > 0) & (F.col("s") <= 86400), F.col("s")).alias("seconds"))


def fresh(verdicts: DataFrame, inputs: DataFrame) -> DataFrame:
    """(task, stage, fresh) of ``verdicts(task, stage, written)``: as new as every one of its ``inputs(task, stage, written)`` that exists."""
    newest = inputs.groupBy("task", "stage").agg(F.max("written").alias("newest"))
    return verdicts.join(newest, ["task", "stage"], "left").select("task", "stage", F.coalesce(F.col("newest") <= F.col("written"), F.lit(True)).alias("fresh"))


# ---------------------------------------------------------------- instructions

# What an instruction must not say, and the limits of what it may share with a fix.
FORBIDDEN = ["hidden test", "_test.go", "tests.patch", "src.patch", "this commit", "the commit", "the fix is"]
SHINGLE, MOST_SHARED, LEAK_BYTES = 8, 2, 25


def forbidden_mentions(instruction: Column) -> Column:
    return F.filter(F.array(*[F.lit(p) for p in FORBIDDEN]), lambda p: F.contains(F.lower(instruction), p))


@F.pandas_udf(StringType())
def _head_only(lines: pd.Series) -> pd.Series:
    """A declaring line up to the body that it opens: a brace after a space, outside brackets."""

    def one(line):
        t, depth = (line or "").strip(), 0
        for i, c in enumerate(t):
            depth += (c in "([") - (c in ")]")
            if c == "{" and depth == 0 and i and t[i - 1] == " ":
                return t[:i].rstrip()
        return t

    return lines.map(one)


def leaks(instructions: DataFrame, added: DataFrame, signatures: DataFrame) -> DataFrame:
    """(task, verbatim, shared) of ``instructions(task, text)``: lines of the fix that it holds, and runs of eight tokens that it shares.

    ``added(task, file, hunk, pos, marker, line)`` are the lines of the fix's diff, ``signatures(task, signature)`` what an instruction must name.
    Comments and lone strings are no code; of a line that declares an allowed signature only the body counts. A line counts as held from 25
    bytes on, white space folded. Runs of tokens end at every line that does not count.
    """
    code = F.col("line").rlike(r"\S") & ~F.trim("line").rlike(r'^(//|/\*|\*|"[^"]*"$)')
    a = added.withColumn("head", _head_only(F.col("line")))
    allowed = signatures.where("signature <> ''").groupBy("task").agg(F.collect_set(text.squash(F.col("signature"))).alias("allowed"))
    a = a.join(allowed, "task", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))
    rest = F.when(F.array_contains("allowed", text.squash(F.col("line"))), "").when(
        F.array_contains("allowed", text.squash(F.col("head"))), F.expr("substring(regexp_replace(line, '^\\\\s+|\\\\s+$', ''), length(head) + 1)")
    ).otherwise(F.col("line"))
    a = a.withColumn("rest", F.when((F.col("marker") == "+") & code, rest).otherwise(""))
    counts = F.col("rest").rlike(r"\S")
    run = F.sum((~counts).cast("int")).over(Window.partitionBy("task", "file", "hunk").orderBy("pos"))
    a = a.withColumn("run", run).where(counts)
    q = text.squash(F.col("rest"))
    said = instructions.select("task", F.col("text").alias("instruction"))
    held = a.withColumn("q", q).where(F.octet_length("q") >= LEAK_BYTES).join(said, "task").where(F.contains(text.squash(F.col("instruction")), F.col("q")))
    verbatim = held.groupBy("task").agg(F.count_distinct("q").alias("verbatim"))
    tokens = text.code_tokens(F.regexp_replace("rest", "//.*$", ""))
    runs = a.groupBy("task", "file", "hunk", "run").agg(F.array_sort(F.collect_list(F.struct("pos", tokens.alias("t")))).alias("all"))
    own = runs.select("task", F.explode(text.shingles(F.flatten(F.col("all.t")), SHINGLE)).alias("s")).distinct()
    told = instructions.select("task", F.explode(text.shingles(text.code_tokens(F.col("text")), SHINGLE)).alias("s")).distinct()
    shared = own.join(told, ["task", "s"]).groupBy("task").agg(F.count("*").alias("shared"))
    return instructions.select("task").join(verbatim, "task", "left").join(shared, "task", "left").na.fill(0, ["verbatim", "shared"])


def instruction_check(instructions: DataFrame, leak_rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task, ok, reason) of ``instructions(task, text)``: names every one of ``symbols(task, symbol)``, mentions nothing forbidden, leaks nothing."""
    word = lambda s: F.concat(F.lit(r"(?<![\p{IsAlphabetic}\p{N}_])\Q"), s, F.lit(r"\E(?![\p{IsAlphabetic}\p{N}_])"))
    m = symbols.join(instructions, "task").where(~F.regexp_like("text", word(F.col("symbol")))).groupBy("task").agg(F.array_sort(F.collect_set("symbol")).alias("missing"))
    none = F.array().cast("array<string>")
    c = instructions.join(leak_rows, "task").join(m, "task", "left").withColumn("missing", F.coalesce("missing", none))
    bad = F.concat(forbidden_mentions(F.col("text")), F.when(~F.col("text").startswith("# "), F.array(F.lit("text before the # title"))).otherwise(none))
    leaking = (F.col("verbatim") > 0) | (F.col("shared") > MOST_SHARED)
    reasons = F.array_compact(F.array(
        F.when(leaking, F.format_string("leaks the fix (%d verbatim lines, %d shared 8-token runs)", "verbatim", "shared")),
        F.when(F.size("missing") > 0, F.concat(F.lit("omits "), F.array_join("missing", ", "))), F.when(F.size(bad) > 0, F.concat(F.lit("mentions "), F.array_join(bad, ", "))),
    ))
    ok = F.size(reasons) == 0
    return c.select("task", ok.alias("ok"), F.when(ok, "written, leak-free, names every required symbol").otherwise(F.array_join(reasons, "; ")).alias("reason"))


def reviewed(reply: Column) -> Column:
    """(sufficient, ambiguities, guessed_names) of a reviewer's reply: its outermost JSON object, null unless it has all three, of their types."""
    found = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    j = F.try_parse_json(found)
    get = lambda n, t: F.try_variant_get(j, f"$.{n}", t)
    kind = lambda n: F.coalesce(F.schema_of_variant(F.try_variant_get(j, f"$.{n}", "variant")), F.lit(""))
    whole = (kind("sufficient") == "BOOLEAN") & kind("ambiguities").startswith("ARRAY") & kind("guessed_names").startswith("ARRAY")
    listed = lambda n: F.transform(get(n, "array<variant>"), lambda v: F.to_json(v))
    return F.when(whole, F.struct(get("sufficient", "boolean").alias("sufficient"), listed("ambiguities").alias("ambiguities"), listed("guessed_names").alias("guessed_names")))
