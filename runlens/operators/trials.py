"""Experiment evaluation: scores, paired comparisons, noise, selection, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def job_scores(trials: DataFrame) -> DataFrame:
    """Weighted score and mean positive cost of each job."""
    w = F.sum("weight")
    score = F.when(w != 0, F.sum(F.col("reward") * F.col("weight")) / w).otherwise(0.0)
    cost = F.avg(F.when(F.col("tokens") > 0, F.col("tokens")))
    return trials.groupBy("job").agg(score.alias("score"), cost.alias("cost"), F.count("*").alias("n"), F.count_distinct("task").alias("tasks"))


def first_trials(trials: DataFrame, k: int, *order: str) -> DataFrame:
    w = Window.partitionBy("job", "task").orderBy(*order)
    return trials.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= k)


def densified(trials: DataFrame, k: int) -> DataFrame:
    """One row for each job, task and slot; a missing trial counts 0 and is marked."""
    spark = trials.sparkSession
    grid = trials.select("job").distinct().crossJoin(trials.select("task").distinct()).crossJoin(spark.range(1, k + 1).withColumnRenamed("id", "slot"))
    out = grid.join(trials.select("job", "task", F.col("slot").cast("long").alias("slot"), "reward"), ["job", "task", "slot"], "left")
    return out.withColumn("missing", F.col("reward").isNull()).withColumn("reward", F.coalesce("reward", F.lit(0.0)))


def task_means(trials: DataFrame) -> DataFrame:
    return trials.groupBy("job", "task").agg(F.avg("reward").alias("mean"), F.stddev_samp("reward").alias("sd"), F.count("*").alias("n"))


def wins(trials: DataFrame, champion: str, candidate: str) -> DataFrame:
    """(wins, ties, losses) of the candidate over tasks of both jobs, by mean and then by spread, of trials with rewards 0 and 1.

    Spreads come from sums, which are exact for such rewards, so that equal tasks tie in any order of rows. As in SQL a null is above
    all else for a win (a mean without rewards, a spread of one trial), a task whose tie is unknown neither ties nor loses, and a count
    is null if nothing is known of any task.
    """
    n, s, q = F.count("reward"), F.sum("reward"), F.sum(F.col("reward") * F.col("reward"))
    sd = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1))))
    m = trials.where(F.col("job").isin(champion, candidate)).groupBy("job", "task").agg((s / n).alias("mean"), sd.alias("sd"))
    pick = lambda job, x: m.where(F.col("job") == job).select("task", F.col("mean").alias(f"{x}m"), F.col("sd").alias(f"{x}s"))
    p = pick(champion, "x").join(pick(candidate, "y"), "task")
    xm, xs, ym, ys = (F.col(c) for c in ("xm", "xs", "ym", "ys"))
    above = lambda y, x: F.coalesce(y > x, y.isNull() & x.isNotNull())
    win = above(ym, xm) | (ym.eqNullSafe(xm) & above(ys, xs))
    tie = (xm == ym) & (xs == ys)
    loss = ~win & ~tie
    return p.agg(*[F.sum(c.cast("long")).alias(name) for c, name in ((win, "wins"), (tie, "ties"), (loss, "losses"))])


def paired(means: DataFrame, champion: str, candidate: str) -> DataFrame:
    """Mean paired difference over tasks of both jobs, its error and t, and how many tasks moved."""
    a = means.where(F.col("job") == champion).select("task", F.col("mean").alias("a"))
    b = means.where(F.col("job") == candidate).select("task", F.col("mean").alias("b"))
    d = a.join(b, "task").withColumn("d", F.col("b") - F.col("a"))
    se = F.stddev_samp("d") / F.sqrt(F.count("*"))
    up, down = F.sum((F.col("d") > 1e-12).cast("long")), F.sum((F.col("d") < -1e-12).cast("long"))
    return d.agg(
        F.count("*").alias("n"), F.avg("d").alias("delta"), se.alias("se"), F.when(se > 0, F.avg("d") / se).alias("t"),
        up.alias("improved"), down.alias("worsened"), F.sum(((F.col("a") == 1) & (F.col("b") == 0)).cast("long")).alias("hard_drops"),
    )


def half_moves(trials: DataFrame, *order: str) -> DataFrame:
    """(job, task, d): the mean of each task's second half of trials less that of its first; an odd last trial counts in neither."""
    w = Window.partitionBy("job", "task")
    half = F.floor(F.col("n") / 2)
    t = trials.withColumn("r", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w)).where(F.floor(F.col("n") / 2) > 0)
    first, second = F.avg(F.when(F.col("r") <= half, F.col("reward"))), F.avg(F.when((F.col("r") > half) & (F.col("r") <= 2 * half), F.col("reward")))
    return t.groupBy("job", "task").agg((second - first).alias("d"))


def half_split(trials: DataFrame, *order: str) -> DataFrame:
    """Difference of the means of each task's first and second half of trials: a null of no change."""
    return half_moves(trials, *order).groupBy("job").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"))


def decide(candidates: DataFrame, floor_slack: float, cost_limit: float) -> DataFrame:
    """Candidates against incumbents with a reason each, and the admitted one of the best score of each group (ties: the first).

    Columns: grp, ord, score, cost, base_score, base_cost, best_score. A gain over the slack may cost more; otherwise cost may not rise over the limit.
    """
    gain = F.col("score") - F.col("base_score")
    dear = F.when((F.col("base_cost") > 0) & (F.col("cost") > 0), F.col("cost") / F.col("base_cost") - 1).otherwise(0.0)
    reason = (
        F.when(F.col("score") < F.col("best_score") - floor_slack, "below floor")
        .when((gain <= floor_slack) & (dear > cost_limit), "over budget")
        .when(gain <= 0, "no gain")
        .otherwise("admitted")
    )
    c = candidates.withColumn("reason", reason)
    rank = F.row_number().over(Window.partitionBy("grp").orderBy((F.col("reason") != "admitted").cast("int"), F.desc("score"), "ord"))
    return c.withColumn("chosen", (rank == 1) & (F.col("reason") == "admitted"))


def history(rows: DataFrame, at: int, window: int) -> DataFrame:
    """Attempts, acceptances, best recent yield and whether to prune, of each component of ``rows(t, component, gain, accepted)``."""
    recent = F.max(F.when((F.lit(at) - F.col("t") <= window) & (F.col("t") <= at), F.col("gain")))
    out = rows.groupBy("component").agg(F.count("*").alias("attempted"), F.sum(F.col("accepted").cast("long")).alias("accepted"), recent.alias("yield"))
    return out.withColumn("prune", F.coalesce(F.col("yield") <= 0, F.lit(True)))


def progress(rounds: DataFrame, back: int, slack: float) -> DataFrame:
    """Running best of ``rounds(t, score)`` and whether it stalled over ``back`` rounds."""
    w = Window.orderBy("t")
    best = F.max("score").over(w.rowsBetween(Window.unboundedPreceding, 0))
    stalled = F.coalesce((F.col("score") - F.lag("score", back).over(w) <= slack).cast("int"), F.lit(0))
    return rounds.withColumn("best", best).withColumn("stalled", stalled)


def both_ends(rows: DataFrame, group: str, value: str, tie: str, worst: int, best: int) -> DataFrame:
    """The ``worst`` lowest and ``best`` highest rows of each group, with ``pick``; a row that is both is worst.

    Each end is a limit of its own, which keeps that many rows of a group in every task before any shuffle.
    """
    low = F.row_number().over(Window.partitionBy(group).orderBy(value, tie))
    high = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), tie))
    a = rows.withColumn("__r", low).where(F.col("__r") <= worst).withColumn("pick", F.lit("worst"))
    b = rows.withColumn("__r", high).where(F.col("__r") <= best).withColumn("pick", F.lit("best"))
    b = b.join(a.select(group, tie), [group, tie], "left_anti").select(a.columns)
    return a.unionByName(b).drop("__r")
