"""Runs: how an agent's commits reached a push and a request, one row a transcript of the coordination stream.

A step is a commit, push or opened request that a command made; a command counts for what its first result in the file proves: without
a result, or with an error, only the refs that its output shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text
from . import diffs, pulls
from .sessions import _first_result

# Seconds after which a push or a request is slow, branches of everybody, minutes of the rules.
SLACK, DEFAULT_BRANCHES, RULE_MINUTES = 600, ("main", "master"), (2, 5, 10, 15, 30, 60)


def steps(events: DataFrame, home: str = "") -> DataFrame:
    """(file, i, ord, kind, n, t, targets array<(repo, branch)>) in order: kinds commit, push and request."""
    e = events.where(F.col("kind").isin("tool_use", "tool_result")).withColumn("r", _first_result()).where(F.col("kind") == "tool_use")
    command = F.when(F.col("tool_name") == "Bash", F.coalesce(F.get_json_object("input", "$.command"), F.lit("")))
    e = e.withColumns({"command": command, "id": F.concat_ws(" ", "file", "i"), "t": text.iso_seconds(F.col("ts"))})
    e = e.where(F.col("command").isNotNull() | F.col("tool_name").endswith("create_pull_request"))
    e = e.withColumns({"err": F.coalesce("r.is_error", F.lit(True)), "said": F.coalesce("r.text", F.lit(""))})
    e = e.join(pulls.shell_counts(e.select("id", "command")), "id")
    by_tool = F.col("tool_name").endswith("create_pull_request")
    shown = diffs.ref_lines(F.col("said"))
    guess = pulls.push_guess(e.where("pushes > 0 and not err").select("id", "command", F.col("cwd").alias("dir"), "branch"))
    e = e.withColumn("shown", shown).join(guess.select("id", F.col("branch").alias("guessed")), "id", "left")
    guessed = F.when(F.col("guessed").isNotNull(), F.array(F.struct(F.lit("").alias("repo"), F.col("guessed").alias("branch"))))
    targets = F.when(F.size("shown") > 0, F.col("shown")).otherwise(F.coalesce(guessed, F.array().cast("array<struct<repo:string,branch:string>>")))
    none = F.lit(0).cast("long")
    made = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("commit").alias("kind"), F.when(F.col("err"), none).otherwise(F.col("commits")).alias("n")),
        F.struct(F.lit(1).alias("ord"), F.lit("push").alias("kind"), F.when(F.col("err") & (F.size("shown") == 0), none).otherwise(F.col("pushes")).alias("n")),
        F.struct(F.lit(2).alias("ord"), F.lit("request").alias("kind"), F.when(F.col("err"), none).when(by_tool, F.lit(1).cast("long")).otherwise(F.col("requests")).alias("n")),
    )
    s = e.select("file", "i", "t", targets.alias("targets"), F.explode(made).alias("s")).where("s.n > 0")
    return s.select("file", "i", F.col("s.ord").alias("ord"), F.col("s.kind").alias("kind"), F.col("s.n").alias("n"), "t", F.when(F.col("s.kind") == "push", F.col("targets")).alias("targets"))


def outcome(requested: Column, existing: Column, pushed: Column, branches: Column) -> Column:
    """How a run with commits ended."""
    shared = (F.size(branches) > 0) & F.forall(branches, lambda b: b.isin(*DEFAULT_BRANCHES))
    return (
        F.when(F.col("commits") == 0, "no_commits").when(requested > 0, "pr_opened").when(existing, "pr_existing").when((pushed > 0) & shared, "pushed_default")
        .when(pushed > 0, "pushed_no_pr").otherwise("never_pushed")
    )


def runs(events: DataFrame, prompts: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """One row a file: counts, latencies in seconds, pushed branches, what the brief says, and the outcome.

    ``prompts(file, prompt)`` are first prompts, which are briefs in helpers' files; ``requests(repo, branch, created)`` are requests
    known elsewhere: one for a pushed branch that was created by the end of the run makes it ``pr_existing``.
    """
    s = steps(events)
    first = F.min(F.when(F.col("kind") == "commit", F.struct("i", "ord"))).over(Window.partitionBy("file"))
    at = F.struct("i", "ord")
    s = s.withColumn("c", first)
    after = lambda kind: (F.col("kind") == kind) & (at >= F.col("c"))
    s = s.withColumns({"p": F.min(F.when(after("push"), at)).over(Window.partitionBy("file")), "last": F.max(F.when(F.col("kind") == "push", at)).over(Window.partitionBy("file"))})
    commit = F.when(F.col("kind") == "commit", F.col("n")).otherwise(0)
    one = s.groupBy("file").agg(
        F.sum(commit).alias("commits"), F.sum(F.when(F.col("p").isNull() | (at < F.col("p")), commit).otherwise(0)).alias("commits_before_first_push"),
        F.sum(F.when(F.col("last").isNull() | (at > F.col("last")), commit).otherwise(0)).alias("unpushed_at_end"), F.sum(after("push").cast("long")).alias("pushes"),
        F.sum(after("request").cast("long")).alias("requests"), F.min(F.when(F.col("kind") == "commit", F.struct("i", "ord", "t")))["t"].alias("commit_t"),
        F.min(F.when(after("push"), F.struct("i", "ord", "t")))["t"].alias("push_t"), F.min(F.when(after("request"), F.struct("i", "ord", "t")))["t"].alias("request_t"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("targets")))).alias("pushed"),
    )
    files = events.groupBy("file").agg(F.first("session_id").alias("session_id"), F.count("*").alias("events"), text.iso_seconds(F.max_by("ts", "i")).alias("end_t"))
    r = files.join(one, "file", "left").join(prompts, "file", "left").na.fill(0, ["commits", "commits_before_first_push", "unpushed_at_end", "pushes", "requests"])
    # A push that named no repository is one of the repository that the run names elsewhere, if that is one.
    named = F.array_distinct(F.filter(F.transform("pushed", lambda t: t["repo"]), lambda n: n != ""))
    only = F.when(F.size(named) == 1, named[0]).otherwise("")
    r = r.withColumn("pushed", F.coalesce("pushed", F.array().cast("array<struct<repo:string,branch:string>>"))).withColumn("only", only)
    r = r.withColumn("pushed", F.array_distinct(F.transform("pushed", lambda t: F.struct(F.when(t["repo"] == "", F.col("only")).otherwise(t["repo"]).alias("repo"), t["branch"].alias("branch"))))).drop("only")
    existing = F.lit(False)
    if requests is not None:
        asked = r.where("commits > 0 and requests = 0").select("file", "end_t", F.explode("pushed").alias("b"))
        asked = asked.where((F.col("b.repo") != "") & ~F.col("b.branch").isin(*DEFAULT_BRANCHES)).select("file", "end_t", "b.repo", "b.branch")
        known = asked.join(requests, ["repo", "branch"]).where("created <= end_t").select("file").distinct()
        r = r.join(known.withColumn("known", F.lit(True)), "file", "left")
        existing = F.coalesce("known", F.lit(False))
    helper = F.contains("file", F.lit("/subagents/"))
    gap = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.greatest(F.lit(0), F.col(b) - F.col(a)))
    return r.select(
        "file", "session_id", helper.alias("subagent"), "events", "commits", "commits_before_first_push", "unpushed_at_end", "pushes", "requests",
        gap("commit_t", "push_t").alias("commit_to_push"), gap("push_t", "request_t").alias("push_to_request"), gap("commit_t", "end_t").alias("commit_to_end"),
        gap("push_t", "end_t").alias("push_to_end"), "pushed", pulls.brief_class(F.when(helper, F.col("prompt"))).alias("brief"),
        outcome(F.col("requests"), existing, F.col("pushes"), F.transform("pushed", lambda t: t["branch"])).alias("outcome"),
    )


def is_gap() -> Column:
    return F.col("outcome").isin("pushed_no_pr", "never_pushed")


def run_signals(run_rows: DataFrame, slack: int = SLACK) -> DataFrame:
    """(file, signal) of runs that ended without a push or request, or were slow, or whose brief says to wait."""
    c = F.col
    signals = F.array(
        F.when(c("outcome") == "never_pushed", "never_pushed"), F.when(c("outcome") == "pushed_no_pr", "pushed_no_pr"), F.when(c("commit_to_push") > slack, "slow_push"),
        F.when(c("push_to_request") > slack, "slow_pr"), F.when(c("subagent") & (c("commits") > 0) & (c("brief") == "defers"), "brief_defers_pr"),
    )
    return run_rows.select("file", F.explode(F.array_compact(signals)).alias("signal"))


def moments(events: DataFrame) -> DataFrame:
    """(file, i, signal) of briefs that say to wait, and of the operator asking for a push or request after work began.

    Work begins with the first step, or with a brief to a helper.
    """
    brief = (F.col("kind") == "tool_use") & F.col("tool_name").isin("Agent", "Task")
    began = steps(events).groupBy("file").agg(F.min("i").alias("step_at"))
    first = F.min(F.when(brief, F.col("i"))).over(Window.partitionBy("file"))
    e = events.withColumn("brief_at", first).join(began, "file", "left")
    begun = (F.col("step_at") < F.col("i")) | (F.col("brief_at") < F.col("i"))
    told = F.when(brief & (pulls.brief_class(F.get_json_object("input", "$.prompt")) == "defers"), "brief_defers_pr")
    asked = F.when((F.col("kind") == "human") & begun & pulls.asks_for_request(F.col("text")), "operator_pr_correction")
    return e.select("file", "i", F.coalesce(told, asked).alias("signal")).where("signal is not null")


def population(run_rows: DataFrame) -> DataFrame:
    """One row for all runs, main sessions and helpers: counts, and quantiles of the latencies in minutes by nearest rank."""
    groups = F.explode(F.array(F.lit("all"), F.when(F.col("subagent"), "subagents").otherwise("main"))).alias("population")
    r = run_rows.select("*", groups)
    active = F.col("commits") > 0
    n = lambda c: F.sum(c.cast("long"))
    kinds = ("pr_opened", "pr_existing", "pushed_default", "pushed_no_pr", "never_pushed")
    out = r.groupBy("population").agg(
        F.count("*").alias("runs"), n(active).alias("active"), *[n(F.col("outcome") == k).alias(k) for k in kinds], n(active & is_gap()).alias("gaps"),
        n(active & (F.col("unpushed_at_end") > 0)).alias("unpushed"),
    )
    for column, name in (("commit_to_push", "push"), ("push_to_request", "request")):
        q = stats.ranked(r.where(active & F.col(column).isNotNull()), ["population"], column, {f"{name}_p50": 0.5, f"{name}_p90": 0.9, f"{name}_max": 1.0})
        out = out.join(q, "population", "left").na.fill(0, [f"{name}_p50", f"{name}_p90", f"{name}_max"])
    return out


def gaps_by_brief(run_rows: DataFrame) -> DataFrame:
    """(brief, runs, gaps) of helpers' runs with commits."""
    r = run_rows.where("subagent and commits > 0")
    return r.groupBy("brief").agg(F.count("*").alias("runs"), F.sum(is_gap().cast("long")).alias("gaps"))


def rule_scores(run_rows: DataFrame, minutes: tuple[int, ...] = RULE_MINUTES) -> DataFrame:
    """(minutes, fires, caught, nags, missed, score) of the rule: a first commit of that age without a push, or a push of that age without a
    request. What happened must be later than the limit; what did not, when the run ended, as late at least."""
    c = F.col
    r = run_rows.where("commits > 0").select("*", F.explode(F.array(*[F.lit(m).cast("long") for m in minutes])).alias("minutes"))
    limit = c("minutes") * 60
    no_push = F.when(c("commit_to_push").isNotNull(), c("commit_to_push") > limit).otherwise(F.coalesce("commit_to_end", F.lit(0)) >= limit)
    no_request = F.when(c("outcome") == "pr_existing", F.lit(False)).when(c("push_to_request").isNotNull(), c("push_to_request") > limit).when(c("push_to_end").isNotNull(), c("push_to_end") >= limit).otherwise(F.lit(False))
    fires = (c("outcome") != "pushed_default") & (no_push | no_request)
    n = lambda x: F.sum(x.cast("long"))
    out = r.groupBy("minutes").agg(n(fires).alias("fires"), n(fires & is_gap()).alias("caught"), n(fires & ~is_gap()).alias("nags"), n(~fires & is_gap()).alias("missed"))
    return out.withColumn("score", c("caught") - c("nags"))


def best_rule(scores: DataFrame) -> DataFrame:
    """The rule of the highest score, then of most gaps caught, then of the longest wait."""
    return scores.agg(F.max_by(F.struct(*scores.columns), F.struct("score", "caught", "minutes")).alias("b")).select("b.*")
