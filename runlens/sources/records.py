"""Records that other programs leave: request lists, scorers' output, run folders, cached facts, task folders, architecture models."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sessions import session_of


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def requests(lists: DataFrame) -> DataFrame:
    """(number, title, body, merge_commit, merged_at, url) of the JSON arrays in ``lists(raw)``, names in either style.

    The merge commit is an object's ``oid`` or a plain text; missing texts are empty, other missing fields null; entries without a number go.
    """
    j = lists.select(F.explode(_get(F.try_parse_json("raw"), "$", "array<variant>")).alias("j"))
    g = lambda *names: F.coalesce(*[_get(F.col("j"), f"$.{n}") for n in names])
    merge = F.coalesce(_get(F.col("j"), "$.mergeCommit.oid"), F.when(F.schema_of_variant(F.try_variant_get("j", "$.mergeCommit", "variant")) == "STRING", _get(F.col("j"), "$.mergeCommit")), _get(F.col("j"), "$.merge_commit"))
    none = F.lit("")
    out = j.select(_get(F.col("j"), "$.number", "long").alias("number"), F.coalesce(g("title"), none).alias("title"), F.coalesce(g("body"), none).alias("body"), merge.alias("merge_commit"), g("mergedAt", "merged_at").alias("merged_at"), g("url").alias("url"))
    return out.where("number is not null")


def scorer_record(output: Column) -> Column:
    """The last line of an output that is a JSON object, as text; the whole output if that is one; null without."""
    is_object = lambda x: F.coalesce(F.schema_of_variant(F.try_parse_json(x)), F.lit("")).startswith("OBJECT")
    lines = F.filter(F.transform(F.split(output, "\r?\n"), lambda x: F.trim(x)), is_object)
    whole = F.trim(output)
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.when(is_object(whole), whole))


def signals(records: DataFrame) -> DataFrame:
    """(id, signal, value) of the numbers in ``records(id, raw)``.

    They are under ``signals`` or ``counts``, as an object or as a list of {id, count}, or else the fields of the record itself; an object's
    field may hold its number as ``count``. Beside a nested form the record's ``score`` and ``penalty`` count too.
    """
    j = records.select("id", F.try_parse_json("raw").alias("j"))
    kind = lambda n: F.coalesce(F.schema_of_variant(F.try_variant_get("j", f"$.{n}", "variant")), F.lit(""))
    nested = lambda n: kind(n).startswith("OBJECT") | kind(n).startswith("ARRAY")
    at = F.when(nested("signals"), F.try_variant_get("j", "$.signals", "variant")).when(nested("counts"), F.try_variant_get("j", "$.counts", "variant"))
    j = j.select("id", "j", F.coalesce(at, F.col("j")).alias("v"), at.isNotNull().alias("nested"))
    number = lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$"), F.try_variant_get(v, "$", "double"))
    listed = j.select("id", F.explode(_get(F.col("v"), "$", "array<variant>")).alias("x")).select("id", _get(F.col("x"), "$.id").alias("signal"), number(F.try_variant_get("x", "$.count", "variant")).alias("value"))
    named = j.select("id", F.explode(_get(F.col("v"), "$", "map<string,variant>")).alias("signal", "x")).select("id", "signal", F.coalesce(number(F.col("x")), number(F.try_variant_get("x", "$.count", "variant"))).alias("value"))
    own = F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), number(F.try_variant_get("j", f"$.{n}", "variant")).alias("value")) for n in ("score", "penalty")]))
    more = j.where("nested").select("id", own.alias("o")).select("id", "o.signal", "o.value")
    return listed.unionByName(named).unionByName(more).where("signal is not null and value is not null")


def arguments(argv: Sequence[str]) -> dict:
    """``--key value``, ``--key=value`` and bare ``--flag`` as a dictionary: hyphens become underscores, numbers, booleans, lists and objects keep
    their types, a key that repeats has a list."""
    out: dict = {}
    i = 0
    while i < len(argv):
        if not argv[i].startswith("--"):
            raise ValueError(f"expected --key, got {argv[i]!r}")
        key, given, raw = argv[i][2:].partition("=")
        if not given and i + 1 < len(argv) and not argv[i + 1].startswith("--"):
            i, given, raw = i + 1, "=", argv[i + 1]
        value: object = raw if given else True
        if given:
            try:
                parsed = json.loads(raw)
                value = raw if parsed is None or isinstance(parsed, str) else parsed
            except ValueError:
                pass
        key = key.replace("-", "_")
        out[key] = [*(out[key] if isinstance(out[key], list) else [out[key]]), value] if key in out else value
        i += 1
    return out


def one_or_many(value) -> list:
    """A list of what may be one value, several or none."""
    return list(value) if isinstance(value, list) else [] if value is None else [value]


#: Format and version of the architecture documents that are understood.
MODEL_FORMAT, MODEL_VERSION = "csf-architecture", 1


def architecture(spark: SparkSession, path: str, form: str = MODEL_FORMAT, version: int = MODEL_VERSION) -> DataFrame:
    """(architecture, name, kind, state, source) of the components of a model document; another format or version is an error."""
    doc = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("j"))
    said = doc.select(_get(F.col("j"), "$.format").alias("format"), _get(F.col("j"), "$.format_version", "int").alias("version")).first()
    if said is None or (said["format"], said["version"]) != (form, version):
        raise ValueError(f"{path} is no {form} document of version {version}: {said}")
    c = doc.select(_get(F.col("j"), "$.architecture.name").alias("architecture"), F.explode(_get(F.col("j"), "$.components", "array<variant>")).alias("c"))
    return c.select("architecture", *[_get(F.col("c"), f"$.{n}").alias(n) for n in ("name", "kind", "state", "source")])


def _whole(spark: SparkSession, folder: str, names: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).text(folder, wholetext=True)
    return files.select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("raw"), F.unix_timestamp("_metadata.file_modification_time").alias("written"))


def run_records(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(session, assignment) and (session, hour, calls) of ``<folder>/<assignment>/{run.json,events.jsonl}``.

    ``run.json`` names the session; every tool call of an assistant's message counts in the hour of its event. Events are read line by line;
    folders without either file, and lines that are no JSON, do not count.
    """
    at = lambda file: F.regexp_extract("path", rf"/([^/]+)/{file}$", 1)
    named = _whole(spark, folder, "run.json").select(at(r"run\.json").alias("assignment"), F.get_json_object("raw", "$.session_id").alias("session")).where("session is not null")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "events.jsonl").text(folder)
    lines = lines.select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.try_parse_json("value").alias("j"))
    e = lines.select(at(r"events\.jsonl").alias("assignment"), "j")
    present = e.select("assignment").distinct()
    blocks = F.explode(_get(F.col("j"), "$.event.message.content", "array<variant>")).alias("b")
    e = e.where(_get(F.col("j"), "$.event.type") == "assistant").select("assignment", F.substring(_get(F.col("j"), "$.time"), 1, 13).alias("hour"), blocks)
    calls = e.where((_get(F.col("b"), "$.type") == "tool_use") & (F.length("hour") == 13)).join(named, "assignment")
    return named.join(present, "assignment", "left_semi").select("session", "assignment"), calls.groupBy("session", "hour").agg(F.count("*").alias("calls"))


def cached_facts(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session, hour, calls) and (session, hook_timeouts, guard_rejections, host_hook_callbacks) of cached states.

    ``states(raw)`` are JSON objects from a file's path to its record, whose ``facts`` hold calls by hour and markers; a helper's file counts for
    its session, and counts of one session are added up.
    """
    kind = "map<string,struct<facts:struct<tool_calls_by_utc_hour:map<string,long>,hook_timeouts:long,guard_rejections:long,host_hook_callbacks:long>>>"
    f = states.select(F.explode(F.from_json("raw", kind)).alias("file", "s")).select(session_of(F.col("file")).alias("session"), F.col("s.facts").alias("f"))
    calls = f.select("session", F.explode("f.tool_calls_by_utc_hour").alias("hour", "n")).groupBy("session", "hour").agg(F.sum("n").alias("calls"))
    n = lambda c: F.sum(F.coalesce(F.col(f"f.{c}"), F.lit(0))).alias(c)
    return calls, f.groupBy("session").agg(n("hook_timeouts"), n("guard_rejections"), n("host_hook_callbacks"))


def task_folders(spark: SparkSession, folder: str) -> DataFrame:
    """(task, sha, subject, module_root, packages, churn, valid, reason, pending, parent, commit, seconds, written, verdicts) of ``<folder>/<task>/``.

    A folder's record is ``task.json``, else ``retry.json``, which leaves it pending and not valid; ``fairness/*.json`` are verdicts by stage,
    each with ``pass`` and ``reason``. One that cannot be read is a failed one.
    """
    files = _whole(spark, folder, "*.json")
    record = files.select(F.regexp_extract("path", r"/([^/]+)/(?:task|retry)\.json$", 1).alias("dir"), F.col("path").endswith("/retry.json").alias("retry"), "raw", "written").where("dir <> ''")
    one = record.groupBy("dir").agg(F.min_by(F.struct("raw", "retry", "written"), "retry").alias("r")).select("dir", F.parse_json("r.raw").alias("j"), F.col("r.retry").alias("pending"), "r.written")
    v = files.select(F.regexp_extract("path", r"/([^/]+)/fairness/([^/]+)\.json$", 1).alias("dir"), F.regexp_extract("path", r"/([^/]+)\.json$", 1).alias("file"), F.try_parse_json("raw").alias("j")).where("dir <> ''")
    verdict = F.struct(F.when(F.col("j").isNull(), False).otherwise(_get(F.col("j"), "$.pass", "boolean")).alias("pass"), F.when(F.col("j").isNull(), "unreadable").otherwise(_get(F.col("j"), "$.reason")).alias("reason"))
    v = v.select("dir", F.coalesce(_get(F.col("j"), "$.stage"), F.col("file")).alias("stage"), verdict.alias("v")).groupBy("dir").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "v")))).alias("verdicts"))
    g = lambda n, kind="string": _get(F.col("j"), f"$.{n}", kind)
    text_ = lambda n: F.coalesce(g(n), F.lit("")).alias(n)
    sha = F.coalesce(g("sha"), F.lit(""))
    return one.join(v, "dir", "left").select(
        F.when(F.length(sha) >= 12, F.substring(sha, 1, 12)).otherwise(F.col("dir")).alias("task"), sha.alias("sha"), text_("subject"), text_("module_root"), F.coalesce(g("packages", "array<string>"), F.array().cast("array<string>")).alias("packages"),
        F.coalesce(g("src_churn", "long"), F.lit(0)).alias("churn"), (~F.col("pending") & F.coalesce(g("valid", "boolean"), F.lit(False))).alias("valid"), text_("reason"), "pending", g("parent_outcome").alias("parent"), g("commit_outcome").alias("commit"),
        F.coalesce(g("seconds", "double"), F.lit(0.0)).alias("seconds"), "written", "verdicts",
    )


def not_ready(stages: Sequence[str] = ("flake", "api", "describe", "probe", "specificity")) -> Column:
    """Why a task of ``task_folders`` is not ready for an exam, null if it is: a task without a gate's verdict is ready once it is valid."""
    v = F.col("verdicts")
    failed = F.coalesce(*[F.when(v[s]["pass"] == False, F.concat(F.lit(f"fairness/{s}: "), F.coalesce(v[s]["reason"], F.lit("failed")))) for s in stages])  # noqa: E712
    gate = F.concat(F.lit("fairness/gate: "), F.coalesce(v["gate"]["reason"], F.lit("failed")))
    return F.when(F.col("pending"), F.concat(F.lit("pending retry: "), F.col("reason"))).when(~F.col("valid"), F.col("reason")).when(v["gate"].isNull(), None).when(F.coalesce(v["gate"]["pass"], F.lit(False)), None).otherwise(F.coalesce(failed, gate))


def append_rows(rows: DataFrame, folder: str) -> None:
    """Add rows as JSON lines to a folder."""
    rows.write.mode("append").json(folder)
