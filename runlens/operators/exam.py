"""Exam building: gates, splits, split statistics and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_held_out(tasks: DataFrame, n: int) -> DataFrame:
    """Tasks with the split: the newest ``n`` are held out, undated ones last in line, ties by id.

    The cut is found by an ordered limit (each task keeps n rows), not by ranking all rows in one place.
    """
    order = [F.col("ts").isNull(), F.desc("ts"), F.col("task")]
    held = tasks.orderBy(*order).limit(n).select(F.col("task").alias("__t"))
    out = tasks.join(held, F.col("task") == F.col("__t"), "left")
    return out.withColumn("split", F.when(F.col("__t").isNotNull(), "held_out").otherwise("practice")).drop("__t")


def split_stats(tasks: DataFrame) -> DataFrame:
    q = F.percentile("churn", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    span = (F.unix_timestamp(F.max(F.col("ts").cast("timestamp"))) - F.unix_timestamp(F.min(F.col("ts").cast("timestamp")))) / 86400
    s = tasks.groupBy("split").agg(F.count("*").alias("n"), q.alias("q"), span.alias("span_days"), F.count_distinct("area").alias("areas"))
    return s.select("split", "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))], "span_days", "areas")


def share_difference(tasks: DataFrame, column: str) -> DataFrame:
    """Shares of each value in both splits, and their difference; absent is 0."""
    n = tasks.groupBy("split").agg(F.count("*").alias("total"))
    c = tasks.groupBy("split", column).agg(F.count("*").alias("k")).join(n, "split").withColumn("share", F.col("k") / F.col("total"))
    a = c.where("split = 'practice'").select(column, F.col("share").alias("practice"))
    b = c.where("split = 'held_out'").select(column, F.col("share").alias("held_out"))
    both = a.join(b, column, "full_outer").na.fill(0.0, ["practice", "held_out"])
    return both.withColumn("difference", F.abs(F.col("practice") - F.col("held_out")))


def gate(rows: DataFrame, stages: list[str]) -> DataFrame:
    """Whether all stages passed and the first that did not, in order; a stage that has not run fails."""
    failing = F.lit(None).cast("string")
    for s in reversed(stages):
        failing = F.when(~F.coalesce(F.col(s), F.lit(False)), s).otherwise(failing)
    return rows.withColumn("failing", failing).withColumn("ready", F.col("failing").isNull())


# What shows in a log that the build could not get its inputs.
INFRA = [
    "module lookup disabled by GOPROXY", "missing go.sum entry", "go: updates to go.mod needed", "dial tcp", "i/o timeout", "no such host",
    "cannot find module providing package", "go: downloading",
]


def outcome(exit_code: Column, log: Column, own_module: Column | None = None) -> Column:
    """Class of a test run, by ordered rules: only what the run itself shows is evidence.

    A line of missing inputs makes the run ``infra``, whatever follows, unless it misses a package of the module under test: then the
    code is at fault, and the build failed.
    """
    lines = F.split(F.coalesce(log, F.lit("")), "\r?\n")
    own = own_module if own_module is not None else F.lit(None).cast("string")
    blames = lambda x: F.coalesce(F.contains(x, F.concat(F.lit("providing package "), own, F.lit("/"))) | F.contains(x, F.concat(F.lit("providing package "), own, F.lit(":"))), F.lit(False))
    marked = lambda x: F.exists(F.array(*[F.lit(m) for m in INFRA]), lambda m: F.contains(x, m))
    infra, missing = F.exists(lines, lambda x: ~blames(x) & marked(x)), F.exists(lines, blames)
    has = lambda t: F.contains(log, F.lit(t))
    built = missing | has("[build failed]") | has("undefined: ") | (has("[setup failed]") & has(".go:") & ~has("module"))
    return (
        F.when(exit_code == 0, "pass").when(exit_code.isin(124, 137), "timeout").when(infra, "infra").when(built, "build_fail")
        .when(has("--- FAIL") | has("[FAIL]") | has("FAIL\t"), "test_fail").otherwise("infra")
    )


def decision(parent: Column, commit: Column) -> tuple[Column, Column]:
    """Whether a task is valid and why: the tests failed on the parent and pass on the commit; runs that prove nothing decide nothing."""
    either = lambda o: (parent == o) | (commit == o)
    reason = (
        F.when(either("infra"), "infra: a run could not assemble its build inputs").when(either("timeout"), "timeout: a run was killed")
        .when(parent == "pass", "tests already pass on parent").when(commit.isin("test_fail", "build_fail"), "tests fail on the commit").otherwise("ok")
    )
    return reason == "ok", reason


def stratified_window(rows: DataFrame, group: str, order: str, need: int, offset: int) -> DataFrame:
    """``need`` rows of each group, from a position that rotates with ``offset``."""
    g = Window.partitionBy(group)
    r = rows.withColumn("__r", F.row_number().over(g.orderBy(order)) - 1).withColumn("__n", F.count("*").over(g))
    return r.where(F.pmod(F.col("__r") - offset, F.col("__n")) < need).drop("__r", "__n")


def smallest_and_median(rows: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """The row of the smallest value of each group and the one at rank ``n / 2``, ties by ``tie``, with ``example``.

    The median's value and its place among equal values come from counts of values; only rows of the two values are ordered.
    """
    c = rows.groupBy(group, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(group)
    c = c.withColumns({"__to": F.sum("__c").over(w.orderBy("__v")), "__n": F.sum("__c").over(w)}).withColumn("__from", F.col("__to") - F.col("__c"))
    c = c.withColumn("__mid", F.floor(F.col("__n") / 2))
    c = c.where((F.col("__from") == 0) | ((F.col("__from") <= F.col("__mid")) & (F.col("__mid") < F.col("__to")))).withColumnRenamed(group, "__g")
    r = rows.join(F.broadcast(c), (F.col(group) == F.col("__g")) & (F.col(value) == F.col("__v")))  # two values a group
    r = r.withColumn("__r", F.row_number().over(Window.partitionBy(group, value).orderBy(tie)) - 1 + F.col("__from"))
    r = r.withColumn("example", F.when(F.col("__r") == 0, "smallest").when(F.col("__r") == F.col("__mid"), "median")).where("example is not null")
    return r.select(*rows.columns, "example")
