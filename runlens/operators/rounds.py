"""Rounds of a search: judging candidates, attributing their effects, calibrating noise, choosing tasks and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: components that change the structure.
STRUCTURAL = ["client_tool", "skill", "memory", "subagent"]
# Signs of components in a diff, in this order.
SIGNS = (
    ("memory", r"\bMemory\(|\.remember\(|\.recall\(|_STATE_DIR"), ("skill", "skills/|SkillRegistry|skill_use|skill_catalog|upload_skills"),
    ("client_tool", "ToolRegistry|register_tool|tool_spec|CLIENT_TOOLS"), ("subagent", r"\bsubcall\(|sub_agent|subagent"),
)


def relative_cost(cost: Column, base: Column) -> Column:
    """Change of cost against a base, 0 if either is missing or none."""
    return F.when((base > 0) & (cost > 0), cost / base - 1).otherwise(0.0)


def novelty(components: Column, known: Column) -> Column:
    """How many structural components a candidate touches that the incumbent has no accepted edit on."""
    return F.size(F.array_except(F.array_intersect(F.array_distinct(components), F.array(*[F.lit(c) for c in STRUCTURAL])), known))


def text_only(diff: Column) -> Column:
    """Whether every changed line of a diff is a string or a comment; false without any."""
    changed = F.filter(F.split(diff, "\n"), lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(\+\+\+|---)") & x.rlike(r"^.\s*\S"))
    return (F.size(changed) > 0) & F.forall(changed, lambda x: x.rlike(r"""^[+-]\s*(?:[frb]?["']|\"\"\")""") | x.rlike(r"^.\s*#"))


def component(diff: Column, signs: tuple = SIGNS) -> Column:
    """The first component that a diff shows a sign of; prompt for changes of text and without any sign."""
    out = F.when(text_only(diff), "prompt")
    for name, pattern in signs:
        out = out.when(diff.rlike(pattern), name)
    return out.otherwise("prompt")


def declared_component(declared: Column, diff: Column, signs: tuple = SIGNS) -> Column:
    """A declared component if the diff shows it, else the one that the diff shows."""
    d = F.lower(F.trim(F.coalesce(declared, F.lit(""))))
    shown = F.lit(False)
    for name, pattern in signs:
        shown = F.when(d == name, diff.rlike(pattern)).otherwise(shown)
    return F.when(shown, d).otherwise(component(diff, signs))


def judged(candidates: DataFrame, delta: float, beta0: float, beta1: float, w_s: float, w_c: float, w_n: float) -> DataFrame:
    """Candidates with ``admissible``, ``reason`` and ``chosen``: the admissible one of the best score, ties by ``ord``.

    Columns: grp, ord, score, cost, base_score, base_cost, best_score, novelty, guards (array of what is violated). The floor comes first;
    a gain over ``delta`` may cost a budget that grows with it, any other must be worth its cost; guards come last.
    """
    gain, dear = F.col("score") - F.col("base_score"), relative_cost(F.col("cost"), F.col("base_cost"))
    fits = F.when(gain > delta, dear <= beta0 + beta1 * gain).otherwise(w_s * gain - w_c * dear + w_n * F.col("novelty") > 0)
    reason = (
        F.when(F.col("score").isNull(), "not evaluated").when(F.col("score") < F.col("best_score") - delta, "below floor").when(~fits, "cost rule")
        .when(F.size("guards") > 0, F.concat(F.lit("guard: "), F.array_join("guards", "; "))).otherwise("admissible")
    )
    c = candidates.withColumn("reason", reason).withColumn("admissible", F.col("reason") == "admissible")
    rank = F.row_number().over(Window.partitionBy("grp").orderBy((~F.col("admissible")).cast("int"), F.desc("score"), "ord"))
    return c.withColumn("chosen", (rank == 1) & F.col("admissible"))


def attribution(edits: DataFrame, means: DataFrame, drop: float, most: int = 12) -> DataFrame:
    """(edit, predicted, hits, hit_rate, regressions, n_regressions) of ``edits(edit, predicted array)`` over ``means(task, base, new)`` of tasks in both.

    A predicted task that rose is a hit; a task that fell by ``drop`` and was not predicted is a regression, of which ``most`` are named.
    """
    p = edits.select("edit", F.explode_outer(F.array_distinct("predicted")).alias("task")).join(means, "task")
    hit = F.col("new") > F.col("base")
    a = p.groupBy("edit").agg(F.count("*").alias("predicted"), F.sum(hit.cast("long")).alias("hits"))
    fell = means.where(F.col("new") - F.col("base") <= -drop).select("task")
    named = edits.select("edit", "predicted")
    r = fell.crossJoin(F.broadcast(named)).where(~F.array_contains("predicted", F.col("task")))  # the edits of one candidate: a few
    r = r.groupBy("edit").agg(F.count("*").alias("n_regressions"), F.slice(F.array_sort(F.collect_set("task")), 1, most).alias("regressions"))
    out = edits.select("edit").join(a, "edit", "left").join(r, "edit", "left").na.fill(0, ["predicted", "hits", "n_regressions"])
    out = out.withColumn("regressions", F.coalesce("regressions", F.array().cast(r.schema["regressions"].dataType)))
    return out.withColumn("hit_rate", F.when(F.col("predicted") > 0, F.round(F.col("hits") / F.col("predicted"), 2)))


def unready(missing: Column, expected: Column, share: float) -> Column:
    """Whether too many trials are missing for an evaluation to count."""
    return missing > share * expected


def calibration(null: DataFrame, *keys: str) -> DataFrame:
    """(hard_drop, detectable, noise_passes, most_net_drops, most_drops) of each row of measured nulls, with its keys.

    ``null(abs_move_p99, se, passes_p01, net_p99, drops_p99)``: limits are the null's quantiles, with floors that leave room for one unlucky draw.
    """
    c = F.col
    return null.select(
        *keys, F.greatest(F.lit(0.25), F.round(F.coalesce("abs_move_p99", F.lit(0.25)) + 0.03, 2)).alias("hard_drop"), F.when(c("se") > 0, F.round(2 * c("se"), 5)).alias("detectable"),
        F.greatest(F.lit(2), F.bround(F.abs("passes_p01"), 0).cast("int")).alias("noise_passes"), F.greatest(F.lit(1), "net_p99").alias("most_net_drops"), F.greatest(F.lit(2), "drops_p99").alias("most_drops"),
    )


def floor_quantiles(rows: DataFrame, group: str, value: str, places: dict[str, float]) -> DataFrame:
    """Values at rank ``floor(f * n)`` (the last at most) of each group, by counts of values."""
    c = rows.groupBy(group, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(group)
    c = c.withColumns({"__to": F.sum("__c").over(w.orderBy("__v")), "__n": F.sum("__c").over(w)})
    at = lambda f: F.least(F.col("__n") - 1, F.floor(F.col("__n") * f))
    return c.groupBy(group).agg(*[F.min(F.when(F.col("__to") > at(f), F.col("__v"))).alias(n) for n, f in places.items()])


def diagnostics(trials: DataFrame) -> DataFrame:
    """One row a job of ``trials(job, steps, runs, failed_runs, tokens string, payload, malformed, valid, passed, status)``.

    Means leave out what is no number; rates are over all trials; the error rate is a ratio of sums.
    """
    n = lambda c: F.round(F.avg(c.cast("double")), 4)
    c = F.col
    none, odd = ~c("payload"), c("malformed")
    return trials.groupBy("job").agg(
        F.count("*").alias("trials"), n(c("steps")).alias("mean_steps"), F.round(F.sum("failed_runs") / F.greatest(F.lit(1), F.sum("runs")), 4).alias("error_rate"), F.round(F.avg(c("tokens").try_cast("double")), 4).alias("mean_tokens"),
        n(none).alias("no_payload"), n(odd & ~none).alias("malformed"), n(~odd & ~none & (c("valid") < 1)).alias("invalid"), n((c("valid") >= 1) & ~c("passed")).alias("under_target"), n(c("passed")).alias("pass_rate"),
        n(c("status") == "timeout").alias("timeouts"),
    )


def tool_calls(trajectories: DataFrame) -> DataFrame:
    """(trial, tool, arguments) of ``trajectories(trial, raw)``: the calls of assistant messages, in order."""
    messages = F.from_json(F.get_json_object("raw", "$.messages"), "array<struct<role:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>")
    m = trajectories.select("trial", F.posexplode(messages).alias("at", "m")).where("m.role = 'assistant'")
    t = m.select("trial", "at", F.posexplode("m.tool_calls").alias("nth", "c"))
    return t.select("trial", "at", "nth", F.coalesce("c.function.name", F.lit("")).alias("tool"), F.coalesce("c.function.arguments", F.lit("")).alias("arguments"))


def resolved(results: DataFrame, total: int = 500) -> DataFrame:
    """(job, ran, resolved, rate, rate_ran) over a fixed number of tasks, those that did not run included."""
    r = results.groupBy("job").agg(F.count("*").alias("ran"), F.sum(F.coalesce((F.col("reward") == 1).cast("long"), F.lit(0))).alias("resolved"))
    return r.withColumns({"rate": F.round(F.col("resolved") / total, 4), "rate_ran": F.round(F.col("resolved") / F.greatest(F.lit(1), F.col("ran")), 4)})


def infra_failure(kind: Column, message: Column) -> Column:
    """Whether an exception means that a trial had no environment; time-outs never do."""
    said = message.rlike(r"(?i)docker|compose|image|pull|registry|no space left|connection refused|daemon|network .* (not found|already exists)")
    return F.when(kind.isNull() & message.isNull(), False).when(kind.isin("AgentTimeoutError", "VerifierTimeoutError"), False).otherwise(F.coalesce(said, F.lit(False)) | F.coalesce(kind.isin("RuntimeError", "OSError"), F.lit(False)))


def failure_class(status: Column, verdict: Column, passed: Column, output: Column) -> Column:
    """How a trial of a small coding task ended."""
    has = lambda *names: F.coalesce(output.rlike("|".join(names)), F.lit(False))
    return (
        F.when(status == "crash", "HARNESS-CRASH").when(status == "infra", "INFRA").when(passed, "passed").when(verdict == "no_submission", "NO-SUBMISSION").when(verdict == "timeout", "TIMEOUT")
        .when(has("SyntaxError", "NameError", "IndentationError"), "BROKEN-MODULE").when(has("RecursionError"), "RECURSION-LIMIT").otherwise("WRONG-ANSWER")
    )


def design_class(payload: Column, status: Column, passed: Column, valid: Column, error: Column) -> Column:
    """How a trial of a design task ended."""
    e = F.coalesce(error, F.lit(""))
    odd = F.lower(e).rlike("literal|validation") | e.contains("PAYLOAD")
    return F.when(~payload, "NO-SUBMISSION").when(F.coalesce(status, F.lit("ok")) != "ok", "INFRA").when(passed, "passed").when(odd, "MALFORMED").when(F.coalesce(valid, F.lit(0.0)) < 1, "INVALID-DESIGN").otherwise("UNDER-TARGET")


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(signal, delta) of the signals that differ between ``before(signal, value)`` and ``after(signal, value)``; an absent one is 0."""
    a, b = before.withColumnRenamed("value", "x"), after.withColumnRenamed("value", "y")
    d = a.join(b, "signal", "full_outer").select("signal", (F.coalesce("y", F.lit(0.0)) - F.coalesce("x", F.lit(0.0))).alias("delta"))
    return d.where("delta <> 0")


def merged_counts(a: Column, b: Column) -> Column:
    """Two maps of counts added up, key by key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def majority(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each group, of equal ones the one that came first."""
    c = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return c.groupBy(group).agg(F.max_by(F.col(value), F.struct("n", -F.col("first"))).alias(value))


def resolved_settings(tasks: DataFrame, exact: DataFrame, major: DataFrame, named: DataFrame, default: str) -> DataFrame:
    """(task, setting, source): a task's own file, else the setting of its label, of its domain's majority, of a name like it, or the default.

    ``tasks(task, domain, own)``, ``exact(task, setting)``, ``major(domain, setting)``, ``named(name, setting)`` with names of small letters and digits.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^0-9a-z]+", "")
    leaf = F.element_at(F.split("task", "/"), -1)
    t = tasks.join(exact.withColumnRenamed("setting", "e"), "task", "left").join(major.withColumnRenamed("setting", "m"), "domain", "left")
    for n, key in enumerate((leaf, F.replace("task", F.lit("/"), F.lit("_")), F.col("domain"))):
        t = t.join(named.select(F.col("name").alias(f"k{n}"), F.col("setting").alias(f"n{n}")), plain(key) == F.col(f"k{n}"), "left")
    found = [("task", "own"), ("label", "e"), ("domain", "m"), ("name", "n0"), ("name", "n1"), ("name", "n2")]
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), s) for s, c in found], F.lit("default"))
    return t.select("task", F.coalesce(*[F.col(c) for _, c in found], F.lit(default)).alias("setting"), source.alias("source"))


def restricted(tasks: DataFrame, split: DataFrame, chosen: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Tasks of a split, of the chosen ids if any are given, and the first ``most`` of them by id."""
    t = tasks.join(split.select("task").distinct(), "task", "left_semi")
    t = t if chosen is None else t.join(chosen.select("task").distinct(), "task", "left_semi")
    return t if most is None else t.orderBy("task").limit(most)


def smoke_tasks(tasks: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of ``tasks(task, ord, least_reward)`` that always pass; if there are fewer, the first ``n`` of all."""
    solid = tasks.where("least_reward >= 1").orderBy("ord").limit(n)
    enough = solid.agg((F.count("*") >= n).alias("enough"))
    every = tasks.orderBy("ord").limit(n).crossJoin(enough).where("not enough").drop("enough")  # one row
    return solid.crossJoin(enough).where("enough").drop("enough").unionByName(every)


def spread_sample(rows: DataFrame, group: str, session: str, order: str, k: int) -> DataFrame:
    """Up to ``k`` rows of each group: first those that are the first of their session, then others, in order."""
    first = F.row_number().over(Window.partitionBy(group, session).orderBy(order)) > 1
    place = F.row_number().over(Window.partitionBy(group).orderBy("__again", order))
    return rows.withColumn("__again", first).withColumn("__p", place).where(F.col("__p") <= k).drop("__again", "__p")


def ranked_clusters(evidence: DataFrame, least: int, most: int) -> DataFrame:
    """Clusters of ``evidence(key, episodes, sessions)`` with ``least`` episodes, the largest first, ``most`` of them."""
    return evidence.where(F.col("episodes") >= least).orderBy(F.desc("episodes"), F.desc("sessions"), "key").limit(most)


def stride_pick(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Rows of each group with ``picked``: ``n`` positions at even strides from the first to the last, all if there are no more.

    Positions are rounded half to even; where two fall together the first free ones join them.
    """
    w = Window.partitionBy(group)
    r = rows.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count("*").over(w)})
    steps = F.sequence(F.lit(0), F.lit(max(n - 1, 0)))
    at = F.array_distinct(F.transform(steps, lambda i: F.bround(i * (F.col("__n") - 1) / max(1, n - 1), 0).cast("int")))
    free = F.array_except(F.sequence(F.lit(0), F.least(F.col("__n") - 1, F.lit(2 * n))), at)
    places = F.concat(at, F.slice(free, F.lit(1), F.greatest(F.lit(n) - F.size(at), F.lit(0))))
    picked = F.when(F.lit(n) >= F.col("__n"), True).when(F.lit(n) == 0, False).otherwise(F.array_contains(places, F.col("__i")))
    return r.withColumn("picked", picked).drop("__i", "__n")


def recent(records: DataFrame, order: str, measured: Column, most: int = 40, unmeasured: int = 4) -> DataFrame:
    """The last ``most`` records, of those without a measurement the last ``unmeasured`` only."""
    without = records.where(~measured).orderBy(F.desc(order)).limit(unmeasured)
    return records.where(measured).unionByName(without).orderBy(F.desc(order)).limit(most)


def replaced_round(log: DataFrame, new: DataFrame, t: int) -> DataFrame:
    """A log of ``t, edit, ...`` in which the edits of round ``t`` are the new ones; rows of other kinds (no edit) stay."""
    return log.where(~((F.col("t") == t) & F.col("edit").isNotNull())).unionByName(new)


def settled(rounds: DataFrame, t: Column) -> Column:
    """Whether a round is done, by the last one of the trajectory."""
    last = rounds.agg(F.max("t")).first()[0]
    return t <= F.lit(-1 if last is None else last)


def valid_labels(labels: DataFrame, vocabulary: DataFrame, escape: str = "new_pattern", noise: str = "noise") -> tuple[DataFrame, DataFrame]:
    """Labels whose pattern is an id of ``vocabulary(id)``, noise, or the escape with a name of its own; and the others."""
    ids = vocabulary.select(F.col("id").alias("pattern"), F.lit(True).alias("__known")).distinct()
    named = (F.col("pattern") == escape) & (F.trim(F.coalesce(F.col(escape), F.lit(""))) != "")
    ok = F.coalesce("__known", F.lit(False)) | (F.col("pattern") == noise) | F.coalesce(named, F.lit(False))
    j = labels.join(ids, "pattern", "left").withColumn("__ok", ok)
    return j.where("__ok").drop("__known", "__ok"), j.where("not __ok").drop("__known", "__ok")


def denied(diff: Column, patterns: dict[str, str]) -> Column:
    """The reasons of the patterns that a diff matches."""
    return F.array_compact(F.array(*[F.when(diff.rlike(p), why) for p, why in patterns.items()]))


def read_only(command: Column, allowed: list[str], deny: str) -> Column:
    """Whether each step of a command is an allowed one and nothing in it is denied."""
    steps = F.filter(F.transform(F.split(command, r"[|;&]+"), lambda s: F.regexp_extract(s, r"^\s*(\S+)", 1)), lambda s: s != "")
    return ~command.rlike(deny) & F.forall(steps, lambda s: s.isin(*allowed))
