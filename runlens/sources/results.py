"""Trial results from folders of JSON files: one pass over the files, narrow rows to one shuffle by folder.

A file that is no JSON counts as an empty object; a folder without files gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, folder: str, names: str) -> DataFrame:
    """(path, raw) of files of these names at any depth; the path is decoded."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).text(folder, wholetext=True)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(path.alias("path"), F.col("value").alias("raw"))


def _truthy(value: Column) -> Column:
    return F.coalesce(~value.isin("false", "null", "", "[]", "{}") & (F.coalesce(value.try_cast("double"), F.lit(1.0)) != 0), F.lit(False))


def _field(name: str) -> Column:
    return F.get_json_object("raw", f"$.{name}")


def _only(file: str, value: Column) -> Column:
    return F.max(F.when(F.col("file") == file, value))


def trial_results(spark: SparkSession, folder: str) -> DataFrame:
    """(job, task, trial, graded, score, passed, valid, verdict, no_payload, tokens, wall_s, status) of ``jobs/<job>/<task>/t*/``.

    A trial is a folder with ``meta.json``; without ``verdict.json`` it is not graded and has nulls. Missing scores are 0.
    """
    part = r"/jobs/([^/]+)/([^/]+)/(t[^/]*)/(meta|verdict)\.json$"
    at = [F.regexp_extract("path", part, i + 1).alias(n) for i, n in enumerate(("job", "task", "trial", "file"))]
    names = ("combined_score", "passed", "valid", "no_payload", "total_tokens", "wall_s", "status")
    rows = _files(spark, folder, "{meta,verdict}.json").where(F.col("path").rlike(part)).select(*at, *[_field(n).alias(n) for n in names])
    one = rows.groupBy("job", "task", "trial").agg(
        F.bool_or(F.col("file") == "meta").alias("begun"), F.bool_or(F.col("file") == "verdict").alias("graded"),
        _only("verdict", F.col("combined_score")).alias("score"), _only("verdict", F.col("passed")).alias("passed"), _only("verdict", F.col("valid")).alias("valid"),
        _only("verdict", F.col("status")).alias("verdict"), _only("meta", F.col("no_payload")).alias("no_payload"), _only("meta", F.col("total_tokens")).alias("tokens"),
        _only("meta", F.col("wall_s")).alias("wall_s"), _only("meta", F.col("status")).alias("status"),
    ).where("begun")
    when_graded = lambda c: F.when(F.col("graded"), c)
    number = lambda n: F.coalesce(F.col(n).try_cast("double"), F.lit(0.0))
    return one.select(
        "job", "task", "trial", "graded", when_graded(number("score")).alias("score"), when_graded(_truthy(F.col("passed"))).alias("passed"),
        when_graded(number("valid")).alias("valid"), when_graded(F.col("verdict")).alias("verdict"), when_graded(_truthy(F.col("no_payload"))).alias("no_payload"),
        when_graded(F.col("tokens").try_cast("long")).alias("tokens"), when_graded(F.col("wall_s").try_cast("double")).alias("wall_s"), when_graded(F.col("status")).alias("status"),
    )


def result_files(spark: SparkSession, folder: str) -> DataFrame:
    """(job, trial, task, reward) of ``<job>/<trial>/result.json``; the task is the last part of its name, no reward is null.

    Files that are no JSON are left out.
    """
    part = r"/([^/]+)/([^/]+)/result\.json$"
    rows = _files(spark, folder, "result.json").where(F.try_parse_json("raw").isNotNull() & F.col("path").rlike(part))
    task = F.element_at(F.split(F.coalesce(_field("task_name"), F.lit("")), "/"), -1)
    reward = _field("verifier_result.rewards.reward").try_cast("double")
    return rows.select(F.regexp_extract("path", part, 1).alias("job"), F.regexp_extract("path", part, 2).alias("trial"), task.alias("task"), reward.alias("reward"))


def rubric_results(spark: SparkSession, folder: str, tasks: DataFrame, slots: int) -> DataFrame:
    """(job, task, slot, reward, weight, passed, all_pass, tokens, missing) of ``jobs/<job>/s<slot>/<task>/{scores,trajectory}.json``.

    Each of ``tasks(job, task, criteria)`` has a row in each slot; without scores the reward is 0 and the weight its criteria, 1 at
    least. Tokens are null where none were used.
    """
    part = r"/jobs/([^/]+)/s(\d+)/([^/]+)/(scores|trajectory)\.json$"
    at = [F.regexp_extract("path", part, i + 1).alias(n) for i, n in enumerate(("job", "slot", "task", "file"))]
    rows = _files(spark, folder, "{scores,trajectory}.json").where(F.col("path").rlike(part))
    rows = rows.select(*at, _field("total").alias("total"), _field("passed").alias("passed"), _field("all_pass").alias("all"), _field("usage.total_tokens").alias("used"))
    rows = rows.withColumn("slot", F.col("slot").try_cast("long"))
    one = rows.groupBy("job", "slot", "task").agg(
        F.bool_or(F.col("file") == "scores").alias("scored"), _only("scores", F.col("total").try_cast("double")).alias("total"), _only("scores", F.col("passed").try_cast("double")).alias("passed"),
        F.bool_or((F.col("file") == "scores") & _truthy(F.col("all"))).alias("all_pass"), _only("trajectory", F.col("used").try_cast("long")).alias("used"),
    )
    grid = tasks.select("job", "task", "criteria", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"))
    full = grid.join(one, ["job", "slot", "task"], "left")
    scored = F.coalesce(F.col("scored"), F.lit(False))
    total = F.greatest(F.lit(1.0), F.floor(F.coalesce(F.when(scored, F.coalesce("total", F.lit(0.0))), F.col("criteria").cast("double"), F.lit(0.0))))
    passed = F.when(scored, F.coalesce("passed", F.lit(0.0))).otherwise(0.0)
    return full.select(
        "job", "task", "slot", (passed / total).alias("reward"), total.cast("double").alias("weight"), passed.alias("passed"),
        (scored & F.coalesce("all_pass", F.lit(False))).alias("all_pass"), F.when(F.col("used") > 0, F.col("used")).alias("tokens"), (~scored).alias("missing"),
    )
