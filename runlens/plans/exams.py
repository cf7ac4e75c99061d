"""Queries of reports and rounds over the driver's tables, with SQL that states the rules anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diffs, exam, report, rounds, trials
from ..sources import bindings as b
from ..sources import records
from .base import query, r6

# ---------------------------------------------------------------- commits and gates

_FILES = """n AS (SELECT l_orderkey AS sha, 'p' || (l_suppkey % 5) || '/f' || (l_partkey % 7) || CASE l_linenumber % 5 WHEN 0 THEN '_test.go' WHEN 2 THEN '.pb.go' WHEN 4 THEN '.md' ELSE '.go' END AS path, CAST(floor(l_quantity) AS BIGINT) * 5 AS added, l_linenumber AS deleted FROM lineitem)"""


def _shown(spark, sf):
    path = "'p' || (l_suppkey % 5) || '/f' || (l_partkey % 7) || CASE l_linenumber % 5 WHEN 0 THEN '_test.go' WHEN 2 THEN '.pb.go' WHEN 4 THEN '.md' ELSE '.go' END"
    lines = b.table(spark, sf, "lineitem").selectExpr("l_orderkey AS sha", f"concat_ws('\\t', CAST(CAST(floor(l_quantity) AS BIGINT) * 5 AS STRING), CAST(l_linenumber AS STRING), {path}) AS line")
    return lines.groupBy("sha").agg(F.array_join(F.collect_list("line"), "\n").alias("text"))


@query(f"""WITH {_FILES}, g AS (SELECT sha, path, added + deleted AS churn, ends_with(path, '_test.go') AS test, contains(path, '.pb.go') AS made, split_part(path, '/', 1) AS dir FROM n WHERE ends_with(path, '.go')),
c AS (SELECT sha, CAST(coalesce(sum(churn) FILTER (WHERE NOT test AND NOT made), 0) AS BIGINT) AS src_churn, list_distinct(list(dir) FILTER (WHERE NOT test AND NOT made)) AS src, list_distinct(list(dir) FILTER (WHERE test)) AS tst, bool_or(made) AS made FROM g GROUP BY sha)
SELECT sha, src_churn, CAST(len(list_intersect(coalesce(src, []), coalesce(tst, []))) AS BIGINT) AS packages, CASE WHEN len(coalesce(src, [])) = 0 THEN CASE WHEN made THEN 'only generated code changed' ELSE 'no Go source change' END WHEN len(list_intersect(src, coalesce(tst, []))) = 0 THEN 'no package changes both source and tests'
WHEN src_churn > 400 THEN 'source churn ' || src_churn || ' > 400' WHEN len(src) > 3 THEN 'source spans ' || len(src) || ' packages > 3' END AS reason FROM c""")
def commit_candidates(spark, sf):
    """Which commits could be tasks, and why others could not."""
    c = report.candidates(report.numstat(_shown(spark, sf)))
    return c.withColumn("packages", F.size("packages").cast("long"))


_GUARDS = "v AS (SELECT o_custkey AS task, o_orderpriority AS gate, CASE o_orderkey % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'error' WHEN 3 THEN 'skipped' ELSE 'odd' END AS status FROM orders)"


def _guards(spark, sf):
    return b.table(spark, sf, "orders").selectExpr("o_custkey AS task", "o_orderpriority AS gate", "CASE o_orderkey % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'error' WHEN 3 THEN 'skipped' ELSE 'odd' END AS status")


@query(f"""WITH {_GUARDS} SELECT gate, count(*) FILTER (WHERE status = 'pass') AS pass, count(*) FILTER (WHERE status = 'fail') AS fail, count(*) FILTER (WHERE status IN ('error', 'odd')) AS error, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'pass') AS required FROM v GROUP BY gate""")
def gate_table(spark, sf):
    """Gates by status."""
    return report.gate_table(_guards(spark, sf))


@query(f"WITH {_GUARDS} SELECT count(DISTINCT task) FILTER (WHERE status = 'fail') AS failing, count(DISTINCT task) FILTER (WHERE status <> 'skipped') AS checked, bool_and(status = 'skipped') AS all_skipped FROM v")
def gate_totals(spark, sf):
    """Tasks that gates failed or were run for."""
    return report.gate_totals(_guards(spark, sf))


@query(r"""WITH own AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+/[a-z]{2})/', 1) AS prefix FROM pages WHERE page_id % 3 = 0), o AS (SELECT prefix, prefix AS name, right(prefix, 2) AS kind, CASE WHEN length(prefix) % 2 = 0 THEN 'existing' ELSE 'planned' END AS state FROM own WHERE prefix <> ''),
f AS (SELECT DISTINCT page_id % 40 AS task, regexp_replace(url, '^https?://', '') AS path FROM pages), j AS (SELECT f.task, f.path, name, kind, state FROM f LEFT JOIN o ON path = prefix OR starts_with(path, prefix || '/'))
SELECT task, coalesce(array_to_string(list_sort(list_distinct(list(name) FILTER (WHERE name IS NOT NULL))), ','), '') AS components, coalesce(array_to_string(list_sort(list_distinct(list(kind) FILTER (WHERE kind IS NOT NULL))), ','), '') AS kinds, CASE count(DISTINCT state) WHEN 0 THEN NULL WHEN 1 THEN min(state) ELSE 'mixed' END AS state,
count(name) AS mapped, count(*) AS total FROM j GROUP BY task""")
def mapped_files(spark, sf):
    """Components that own the pages of each group."""
    p = b.table(spark, sf, "pages")
    own = p.where("page_id % 3 = 0").select(F.regexp_extract("url", "^https?://([^/]+/[a-z]{2})/", 1).alias("prefix")).where("prefix <> ''").distinct()
    owners = own.selectExpr("prefix", "prefix AS name", "right(prefix, 2) AS kind", "CASE WHEN length(prefix) % 2 = 0 THEN 'existing' ELSE 'planned' END AS state")
    m = report.mapped_files(p.select((F.col("page_id") % 40).alias("task"), F.regexp_replace("url", "^https?://", "").alias("path")), owners)
    return m.withColumns({"components": F.array_join("components", ","), "kinds": F.array_join("kinds", ",")})


# ---------------------------------------------------------------- the split

_T = """x AS (SELECT p_partkey AS task, p_brand AS area, split_part(p_type, ' ', 1) AS tree, p_type AS component, CASE p_size % 3 WHEN 0 THEN 'test_fail' ELSE 'build_fail' END AS outcome, CAST(p_size AS DOUBLE) AS churn, f.ts FROM part LEFT JOIN (SELECT l_partkey, min(l_shipdate) AS ts FROM lineitem GROUP BY 1) f ON l_partkey = p_partkey),
s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY ts IS NULL, ts DESC, task) <= 60 THEN 'held_out' ELSE 'practice' END AS split FROM x)"""


def _tasks(spark, sf):
    more = b.table(spark, sf, "part").selectExpr("p_partkey AS task", "split_part(p_type, ' ', 1) AS first", "p_type AS component", "CASE p_size % 3 WHEN 0 THEN 'test_fail' ELSE 'build_fail' END AS outcome")
    return exam.newest_held_out(b.exam(spark, sf).join(more, "task").withColumn("tree", F.col("first")).drop("first"), 60)


_DIFF = "SELECT coalesce(p.{c}, h.{c}) AS key, coalesce(p.v, 0) AS practice, coalesce(h.v, 0) AS held_out FROM (SELECT {c}, count(*) / (SELECT count(*) FROM s WHERE split = 'practice') AS v FROM s WHERE split = 'practice' GROUP BY 1) p FULL JOIN (SELECT {c}, count(*) / (SELECT count(*) FROM s WHERE split = 'held_out') AS v FROM s WHERE split = 'held_out' GROUP BY 1) h ON p.{c} = h.{c}"
_MOST = "SELECT '{c}' AS id, {c} AS key, round(count(*) / (SELECT count(*) FROM s WHERE split = 'held_out'), 6) AS value, CAST(NULL AS DOUBLE) AS other, count(*) / (SELECT count(*) FROM s WHERE split = 'held_out') <= 0.4 AS ok FROM s WHERE split = 'held_out' GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1"
_WIDE = "SELECT '{c}' AS id, key, round(held_out, 6) AS value, round(practice, 6) AS other, abs(practice - held_out) <= 0.3 AS ok FROM (" + _DIFF + ") ORDER BY abs(practice - held_out) DESC, key LIMIT 1"
_HEALTH = f"""{_T}, q AS (SELECT quantile_cont(churn, 0.5) FILTER (WHERE split = 'held_out') AS h, quantile_cont(churn, 0.5) FILTER (WHERE split = 'practice') AS p, (floor(epoch(max(ts) FILTER (WHERE split = 'held_out'))) - floor(epoch(min(ts) FILTER (WHERE split = 'held_out')))) / 86400 AS days FROM s),
checks AS (SELECT 'churn' AS id, CAST(NULL AS VARCHAR) AS key, round(h, 6) AS value, round(p, 6) AS other, h / p BETWEEN 0.67 AND 1.5 AS ok FROM q UNION ALL ({_MOST.format(c="area")}) UNION ALL ({_MOST.format(c="component")}) UNION ALL ({_WIDE.format(c="tree")}) UNION ALL ({_WIDE.format(c="outcome")})
  UNION ALL SELECT 'span', NULL, round(days, 6), NULL, days >= 7 FROM q)"""


@query(f"WITH {_HEALTH} SELECT * FROM checks")
def split_health(spark, sf):
    """The six checks of a split."""
    return report.health(_tasks(spark, sf)).withColumns({"value": r6("value"), "other": r6("other")})


@query(f"""WITH {_HEALTH}, w AS (SELECT count(*) FILTER (WHERE NOT ok) AS warnings, bool_or(id = 'churn' AND NOT ok) AS churn, bool_or(id = 'churn' AND value < other) AS less, bool_or(id IN ('area', 'component') AND NOT ok) AS one, bool_or(id = 'tree' AND NOT ok) AS tree, bool_or(id = 'outcome' AND NOT ok) AS outcome, bool_or(id = 'span' AND NOT ok) AS span FROM checks),
a AS (SELECT *, CASE WHEN one OR tree THEN CASE WHEN churn THEN 'narrower and ' || CASE WHEN less THEN 'easier' ELSE 'harder' END ELSE 'narrower' END WHEN churn THEN CASE WHEN less THEN 'easier' ELSE 'harder' END END AS adj FROM w)
SELECT CAST(warnings AS INT) AS warnings, CASE WHEN warnings = 0 THEN '6 of 6 checks pass: the final exam (held-out) looks like the practice set (evolve), so a gap between their scores can be read as learning versus memorizing.' ELSE warnings || ' of 6 checks warn: ' || CASE WHEN adj IS NULL THEN 'the final exam (held-out) differs from the practice set (evolve)' ELSE 'the final exam (held-out) is ' || adj || ' than the practice set (evolve)' END
|| CASE WHEN outcome THEN CASE WHEN adj IS NULL THEN ' in the kind of task' ELSE ' and asks for a different kind of task' END ELSE '' END || CASE WHEN span THEN ', and it covers only a very short stretch of work' ELSE '' END || ', so its score would be hard to interpret. Suggested fix: ' || CASE WHEN span THEN 'hold out the newest ~2 weeks of work' ELSE 'hold out more tasks' END
|| CASE WHEN one OR outcome THEN ', balanced across subsystems and task kinds' ELSE '' END || CASE WHEN tree OR churn THEN ', or mine further back so both sets draw from the same code' ELSE '' END || '.' END AS verdict FROM a""")
def split_verdict(spark, sf):
    """What the checks say together, in words."""
    return report.verdict(report.health(_tasks(spark, sf)))


@query(f"WITH {_T} SELECT key AS area, round(greatest(practice, held_out), 6) AS share FROM ({_DIFF.format(c='area')}) ORDER BY greatest(practice, held_out) DESC, key LIMIT 6")
def top_areas(spark, sf):
    """Areas with the largest share in either split."""
    return report.top_areas(_tasks(spark, sf)).withColumn("share", r6("share"))


@query(f"""WITH {_T}, c AS (SELECT split, unnest(CASE CAST(churn AS BIGINT) % 4 WHEN 0 THEN ['(no declared component)'] WHEN 1 THEN [area] WHEN 2 THEN [area, tree] ELSE [tree] END) AS component FROM s),
n AS (SELECT component, count(*) FILTER (WHERE split = 'practice') AS practice, count(*) FILTER (WHERE split = 'held_out') AS held_out, CAST(0 AS BIGINT) AS excluded FROM c GROUP BY component) SELECT *, row_number() OVER (ORDER BY starts_with(component, '('), practice + held_out DESC, component) AS place FROM n""")
def components_by_split(spark, sf):
    """Tasks of each component in each split; those without one come last."""
    kind = F.col("churn").cast("long") % 4
    named = F.when(kind == 0, F.array().cast("array<string>")).when(kind == 1, F.array("area")).when(kind == 2, F.array("area", "tree")).otherwise(F.array("tree"))
    return report.components_by_split(_tasks(spark, sf).select("split", named.alias("components"))).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {_T}, e AS (SELECT *, task % 3 = 0 AS told, task % 90 AS test_lines FROM s) SELECT task FROM e ORDER BY NOT told, NOT (churn BETWEEN 5 AND 60 AND test_lines BETWEEN 8 AND 80), outcome <> 'test_fail', split <> 'practice', churn, task LIMIT 1")
def worked_example(spark, sf):
    """The task to show in full."""
    t = _tasks(spark, sf).withColumns({"told": F.col("task") % 3 == 0, "test_lines": F.col("task") % 90, "parent": F.col("outcome")})
    return report.worked_example(t).select("task")


@query(f"WITH {_T}, w AS (SELECT task, 1700000000 + task * 7 AS written, churn AS seconds FROM s) SELECT max(written) - min(written) + arg_min(seconds, written) AS seconds FROM w WHERE task <= 5000")
def mining_duration(spark, sf):
    """How long the making of tasks took."""
    t = _tasks(spark, sf).where("task <= 5000").select("task", (F.lit(1700000000) + F.col("task") * 7).alias("written"), F.col("churn").alias("seconds"))
    return report.mining_seconds(t)


@query("""WITH v AS (SELECT o_orderkey AS task, o_orderpriority AS stage, o_custkey % 50 AS written FROM orders), i AS (SELECT l_orderkey AS task, l_linenumber % 50 + 20 AS written FROM lineitem)
SELECT v.task, v.stage, coalesce((SELECT max(i.written) FROM i WHERE i.task = v.task) <= v.written, TRUE) AS fresh FROM v""")
def fresh_verdicts(spark, sf):
    """Verdicts that are as new as what they rest on."""
    v = b.table(spark, sf, "orders").selectExpr("o_orderkey AS task", "o_orderpriority AS stage", "o_custkey % 50 AS written")
    i = b.table(spark, sf, "lineitem").selectExpr("l_orderkey AS task", "l_linenumber % 50 + 20 AS written").join(v.select("task", "stage"), "task")
    return report.fresh(v, i)


# ---------------------------------------------------------------- instructions

_TOK = r"""regexp_extract_all({t}, '([\p{{L}}\p{{N}}_]+|"(?:\\.|[^"\n\\])*(?:"|\n|$)|[^\s`*#])', 1)"""
_EIGHT = "list_distinct(list_transform(range(1, greatest(len({t}) - 6, 1)), lambda j: array_to_string(list_slice({t}, j, j + 7), ' ')))"
_LEAK = rf"""ins AS (SELECT item_id AS task, CASE item_id % 3 WHEN 0 THEN '# ' || text WHEN 1 THEN '# Title' || chr(10) || substr(text, 1, 60) ELSE 'the fix is short' END AS t FROM benchmark),
ln AS (SELECT item_id AS task, unnest(string_split(text, ', ')) AS line, generate_subscripts(string_split(text, ', '), 1) AS pos FROM benchmark),
vb AS (SELECT l.task, count(DISTINCT trim(regexp_replace(line, '\s+', ' ', 'g'))) AS n FROM ln l JOIN ins USING (task) WHERE regexp_matches(line, '\S') AND strlen(trim(regexp_replace(line, '\s+', ' ', 'g'))) >= 25 AND contains(trim(regexp_replace(t, '\s+', ' ', 'g')), trim(regexp_replace(line, '\s+', ' ', 'g'))) GROUP BY l.task),
tk AS (SELECT task, flatten(list({_TOK.format(t="regexp_replace(line, '//.*$', '')")} ORDER BY pos)) AS ts FROM ln WHERE regexp_matches(line, '\S') GROUP BY task), ti AS (SELECT task, {_TOK.format(t="t")} AS ts FROM ins),
sh AS (SELECT tk.task, len(list_intersect({_EIGHT.format(t="tk.ts")}, {_EIGHT.format(t="ti.ts")})) AS n FROM tk JOIN ti USING (task) WHERE len(tk.ts) >= 8 AND len(ti.ts) >= 8),
lk AS (SELECT ins.task, t, coalesce(vb.n, 0) AS verbatim, CAST(coalesce(sh.n, 0) AS BIGINT) AS shared FROM ins LEFT JOIN vb USING (task) LEFT JOIN sh USING (task))"""


def _instructions(spark, sf):
    q = b.table(spark, sf, "benchmark")
    t = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("# "), "text")).when(F.col("item_id") % 3 == 1, F.concat(F.lit("# Title\n"), F.substring("text", 1, 60))).otherwise("the fix is short")
    added = q.select(F.col("item_id").alias("task"), F.lit("a.go").alias("file"), F.lit(1).alias("hunk"), F.posexplode(F.split("text", ", ")).alias("pos", "line"), F.lit("+").alias("marker"))
    none = q.limit(0).select(F.col("item_id").alias("task"), F.col("text").alias("signature"))
    ins = q.select(F.col("item_id").alias("task"), t.alias("text"))
    return q, ins, report.leaks(ins, added, none)


@query(f"WITH {_LEAK} SELECT task, verbatim, shared FROM lk")
def instruction_leaks(spark, sf):
    """What instructions give away of a fix."""
    return _instructions(spark, sf)[2]


@query(rf"""WITH {_LEAK}, sy AS (SELECT item_id AS task, regexp_extract(text, '([a-z]{{4,}})', 1) AS symbol FROM benchmark), ck AS (SELECT lk.*, symbol, regexp_matches(t, '(^|[^\p{{L}}\p{{N}}_])' || symbol || '([^\p{{L}}\p{{N}}_]|$)') AS named, contains(lower(t), 'the fix is') AS forb, starts_with(t, '# ') AS titled FROM lk JOIN sy USING (task) WHERE symbol <> '')
SELECT task, (verbatim = 0 AND shared <= 2) AND named AND NOT forb AND titled AS ok, CASE WHEN (verbatim = 0 AND shared <= 2) AND named AND NOT forb AND titled THEN 'written, leak-free, names every required symbol' ELSE array_to_string(list_filter([CASE WHEN verbatim > 0 OR shared > 2 THEN 'leaks the fix (' || verbatim || ' verbatim lines, ' || shared || ' shared 8-token runs)' END,
CASE WHEN NOT named THEN 'omits ' || symbol END, CASE WHEN forb OR NOT titled THEN 'mentions ' || array_to_string(list_filter([CASE WHEN forb THEN 'the fix is' END, CASE WHEN NOT titled THEN 'text before the # title' END], lambda z: z IS NOT NULL), ', ') END], lambda z: z IS NOT NULL), '; ') END AS reason FROM ck""")
def instruction_checks(spark, sf):
    """Whether instructions name what they must, and nothing more."""
    q, ins, leak = _instructions(spark, sf)
    symbols = q.select(F.col("item_id").alias("task"), F.regexp_extract("text", "([a-z]{4,})", 1).alias("symbol")).where("symbol <> ''")
    return report.instruction_check(ins.join(symbols.select("task"), "task"), leak, symbols)


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE doc_id % 2 = 0 END AS sufficient, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE CAST(2 AS BIGINT) END AS ambiguities FROM documents""")
def reviewer_replies(spark, sf):
    """Verdicts read from replies; those of the wrong types count as none."""
    reply = F.expr("""'Well: {"sufficient": ' || CASE WHEN doc_id % 4 = 3 THEN '"yes"' WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || ', "ambiguities": [{"a": 1}, "b"], "guessed_names": []} so.'""")
    r = b.table(spark, sf, "documents").select("doc_id", report.reviewed(reply).alias("r"))
    return r.select("doc_id", "r.sufficient", F.when(F.col("r").isNotNull(), F.size("r.ambiguities").cast("long")).alias("ambiguities"))


# ---------------------------------------------------------------- rounds

_LT = "t AS (SELECT l_returnflag AS job, l_suppkey AS task, CAST(l_linestatus = 'F' AS DOUBLE) AS reward, l_quantity AS weight, l_extendedprice AS tokens, * FROM lineitem)"
_JUDGED = f"""{_LT}, c AS (SELECT s_nationkey AS ord, job AS grp, round(sum(reward * weight) / sum(weight), 6) AS score, round(avg(tokens), 6) AS cost FROM t JOIN supplier ON s_suppkey = task GROUP BY 1, 2),
bs AS (SELECT job AS grp, round(sum(reward * weight) / sum(weight), 6) AS base_score, round(avg(tokens), 6) AS base_cost FROM t GROUP BY 1),
x AS (SELECT c.*, base_score, base_cost, max(score) OVER (PARTITION BY c.grp) AS best_score, score - base_score AS gain, cost / base_cost - 1 AS dear, ord % 3 AS nov, ord % 5 = 0 AS guarded FROM c JOIN bs USING (grp)),
y AS (SELECT *, CASE WHEN score < best_score - 0.05 THEN 'below floor' WHEN NOT CASE WHEN gain > 0.05 THEN dear <= 0.02 + 1.5 * gain ELSE gain - 0.1 * dear + 0.001 * nov > 0 END THEN 'cost rule' WHEN guarded THEN 'guard: slow' ELSE 'admissible' END AS reason FROM x)"""


@query(f"WITH {_JUDGED} SELECT CAST(ord AS BIGINT) AS ord, grp, reason, reason = 'admissible' AND row_number() OVER (PARTITION BY grp ORDER BY CAST(reason <> 'admissible' AS INT), score DESC, ord) = 1 AS chosen FROM y")
def judged_candidates(spark, sf):
    """Candidates against floor, cost rule and guards."""
    t = b.trials(spark, sf)
    score, cost = r6(F.sum(F.col("reward") * F.col("weight")) / F.sum("weight")), r6(F.avg("tokens"))
    nation = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("task"), F.col("s_nationkey").cast("long").alias("ord"))
    c = t.join(nation, "task").groupBy("ord", F.col("job").alias("grp")).agg(score.alias("score"), cost.alias("cost"))
    c = c.join(t.groupBy(F.col("job").alias("grp")).agg(score.alias("base_score"), cost.alias("base_cost")), "grp")
    guards = F.when(F.col("ord") % 5 == 0, F.array(F.lit("slow"))).otherwise(F.array().cast("array<string>"))
    c = c.withColumns({"best_score": F.max("score").over(trials.Window.partitionBy("grp")), "novelty": F.col("ord") % 3, "guards": guards})
    return rounds.judged(c, 0.05, 0.02, 1.5, 1.0, 0.1, 0.001).select("ord", "grp", "reason", "chosen")


@query(f"""WITH {_LT}, m AS (SELECT a.task, a.v AS base, c.v AS new FROM (SELECT task, avg(reward) AS v FROM t WHERE job = 'A' GROUP BY 1) a JOIN (SELECT task, avg(reward) AS v FROM t WHERE job = 'N' GROUP BY 1) c USING (task)), e AS (SELECT unnest([0, 1, 2]) AS edit),
p AS (SELECT edit, task, new > base AS hit FROM e JOIN m ON m.task % 4 = edit AND m.task <= 60), r AS (SELECT edit, count(*) AS n FROM e, m WHERE new - base <= -0.2 AND NOT (task % 4 = edit AND task <= 60) GROUP BY edit)
SELECT CAST(e.edit AS BIGINT) AS edit, (SELECT count(*) FROM p WHERE p.edit = e.edit) AS predicted, (SELECT count(*) FROM p WHERE p.edit = e.edit AND hit) AS hits, coalesce(r.n, 0) AS n_regressions, (SELECT round(avg(CAST(hit AS INT)), 2) FROM p WHERE p.edit = e.edit) AS hit_rate FROM e LEFT JOIN r USING (edit)""")
def edit_attribution(spark, sf):
    """Which predicted tasks rose, and which others fell."""
    m = trials.task_means(b.trials(spark, sf))
    pick = lambda job, n: m.where(F.col("job") == job).select("task", F.col("mean").alias(n))
    means = pick("A", "base").join(pick("N", "new"), "task")
    edits = spark.range(3).select(F.col("id").alias("edit"), F.filter(F.sequence(F.lit(0).cast("long"), F.lit(60).cast("long")), lambda t: t % 4 == F.col("id")).alias("predicted"))
    return rounds.attribution(edits, means, 0.2).drop("regressions")


@query(f"""WITH {_LT}, d AS (SELECT job, count(*) AS trials, round(avg(l_linenumber), 4) AS mean_steps, round(sum(l_linenumber % 3) / greatest(1, sum(l_linenumber)), 4) AS error_rate, round(avg(CASE WHEN l_linenumber % 4 <> 0 THEN l_partkey END), 4) AS mean_tokens, round(avg(CAST(l_suppkey % 7 = 0 AS INT)), 4) AS no_payload,
round(avg(CAST(l_suppkey % 5 = 0 AND l_suppkey % 7 <> 0 AS INT)), 4) AS malformed, round(avg(CAST(l_suppkey % 5 <> 0 AND l_suppkey % 7 <> 0 AND l_quantity < 10 AS INT)), 4) AS invalid, round(avg(CAST(l_quantity >= 10 AND reward = 0 AS INT)), 4) AS under_target, round(avg(reward), 4) AS pass_rate, round(avg(CAST(l_linenumber = 7 AS INT)), 4) AS timeouts FROM t GROUP BY job) SELECT * FROM d""")
def job_diagnostics(spark, sf):
    """How the trials of each job went."""
    t = b.table(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS job", "l_linenumber AS steps", "l_linenumber AS runs", "l_linenumber % 3 AS failed_runs", "CASE WHEN l_linenumber % 4 = 0 THEN 'n/a' ELSE CAST(l_partkey AS STRING) END AS tokens", "l_suppkey % 7 <> 0 AS payload",
        "l_suppkey % 5 = 0 AS malformed", "IF(l_quantity < 10, 0.5, 1.0) AS valid", "l_linestatus = 'F' AS passed", "IF(l_linenumber = 7, 'timeout', 'ok') AS status",
    )
    return rounds.diagnostics(t)


@query("SELECT conv_id AS trial, CAST(turn AS BIGINT) AS at, 'tool_' || (turn % 3) AS tool, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL")
def trajectory_calls(spark, sf):
    """Tool calls of trajectories, made of conversations whose answers call a tool each."""
    c = b.table(spark, sf, "conversations")
    call = F.array(F.struct(F.struct(F.concat(F.lit("tool_"), F.col("turn") % 3).alias("name"), F.lit("{}").alias("arguments")).alias("function")))
    m = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.struct("role", call.alias("tool_calls")).alias("m")))).alias("all"), F.array_sort(F.collect_list("turn")).alias("turns"))
    t = rounds.tool_calls(m.select(F.col("conv_id").alias("trial"), F.to_json(F.struct(F.col("all.m").alias("messages"))).alias("raw"), "turns").select("trial", "raw"))
    t = t.join(m.select(F.col("conv_id").alias("trial"), "turns"), "trial")
    return t.select("trial", F.element_at("turns", F.col("at") + 1).cast("long").alias("at"), "tool").groupBy("trial", "at", "tool").agg(F.count("*").alias("n"))


@query(f"WITH {_LT}, r AS (SELECT job, count(*) AS ran, count(*) FILTER (WHERE reward = 1) AS resolved FROM t WHERE l_linenumber = 1 GROUP BY job) SELECT *, round(resolved / 500, 4) AS rate, round(resolved / greatest(1, ran), 4) AS rate_ran FROM r")
def resolve_rates(spark, sf):
    """Resolved tasks over a fixed number of them."""
    return rounds.resolved(b.trials(spark, sf).where("l_linenumber = 1"))


_EX = "ex AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'AgentTimeoutError' WHEN 1 THEN 'RuntimeError' WHEN 2 THEN 'ValueError' WHEN 3 THEN 'ValueError' END AS kind, CASE o_orderkey % 5 WHEN 0 THEN 'docker' WHEN 1 THEN 'x' WHEN 2 THEN 'Image not found' WHEN 3 THEN 'y' END AS message FROM orders)"


@query(f"WITH {_EX} SELECT id, kind IS NOT NULL AND kind <> 'AgentTimeoutError' AND (message = 'Image not found' OR kind = 'RuntimeError') AS infra FROM ex WHERE kind IS NOT NULL UNION ALL SELECT id, FALSE FROM ex WHERE kind IS NULL")
def infra_failures(spark, sf):
    """Trials that had no environment."""
    e = b.table(spark, sf, "orders").selectExpr("o_orderkey AS id", "CASE o_orderkey % 5 WHEN 0 THEN 'AgentTimeoutError' WHEN 1 THEN 'RuntimeError' WHEN 2 THEN 'ValueError' WHEN 3 THEN 'ValueError' END AS kind", "CASE o_orderkey % 5 WHEN 0 THEN 'docker' WHEN 1 THEN 'x' WHEN 2 THEN 'Image not found' WHEN 3 THEN 'y' END AS message")
    return e.select("id", rounds.infra_failure(F.col("kind"), F.col("message")).alias("infra"))


@query("""SELECT class, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'HARNESS-CRASH' WHEN o_orderkey % 11 = 1 THEN 'INFRA' WHEN o_custkey % 2 = 0 THEN 'passed' WHEN o_orderkey % 7 = 0 THEN 'NO-SUBMISSION' WHEN o_orderkey % 7 = 1 THEN 'TIMEOUT' WHEN o_orderkey % 5 = 0 THEN 'BROKEN-MODULE' WHEN o_orderkey % 5 = 1 THEN 'RECURSION-LIMIT' ELSE 'WRONG-ANSWER' END AS class FROM orders) GROUP BY class""")
def failure_classes(spark, sf):
    """How trials of small coding tasks ended."""
    o = b.table(spark, sf, "orders").selectExpr(
        "CASE o_orderkey % 11 WHEN 0 THEN 'crash' WHEN 1 THEN 'infra' ELSE 'ok' END AS status", "CASE o_orderkey % 7 WHEN 0 THEN 'no_submission' WHEN 1 THEN 'timeout' END AS verdict", "o_custkey % 2 = 0 AS passed",
        "CASE o_orderkey % 5 WHEN 0 THEN 'a NameError b' WHEN 1 THEN 'RecursionError' END AS output",
    )
    return o.groupBy(rounds.failure_class(F.col("status"), F.col("verdict"), F.col("passed"), F.col("output")).alias("class")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderpriority AS signal, year(o_orderdate) AS y, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY ALL), a AS (SELECT * FROM c WHERE y = 1995), z AS (SELECT * FROM c WHERE y = 1996 AND signal <> '5-LOW')
SELECT coalesce(a.signal, z.signal) AS signal, coalesce(z.v, 0) - coalesce(a.v, 0) AS delta FROM a FULL JOIN z ON a.signal = z.signal WHERE coalesce(z.v, 0) <> coalesce(a.v, 0)""")
def moved_signals(spark, sf):
    """Signals that differ between two years; one that is absent counts 0."""
    c = b.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("signal"), F.year("o_orderdate").alias("y")).agg(F.count("*").cast("double").alias("value"))
    return rounds.moved(c.where("y = 1995").drop("y"), c.where("y = 1996 and signal <> '5-LOW'").drop("y"))


_ENV = """ts AS (SELECT DISTINCT source || '/' || lang AS task, source AS domain, CASE WHEN hash(source) IS NOT NULL AND length(source || lang) % 5 = 0 THEN 'own' END AS own FROM documents),
ex AS (SELECT task, 'exact_' || right(task, 2) AS setting FROM ts WHERE length(task) % 2 = 0 AND right(task, 2) <> 'en'),
mj AS (SELECT domain, setting FROM (SELECT split_part(task, '/', 1) AS domain, setting, count(*) AS n, min(task) AS f FROM ex GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n DESC, f) = 1)"""


@query(f"""WITH {_ENV} SELECT ts.task, coalesce(own, ex.setting, mj.setting, CASE WHEN right(ts.task, 2) IN ('en', 'fr') THEN 'named_' || right(ts.task, 2) END, 'default') AS setting,
CASE WHEN own IS NOT NULL THEN 'task' WHEN ex.setting IS NOT NULL THEN 'label' WHEN mj.setting IS NOT NULL THEN 'domain' WHEN right(ts.task, 2) IN ('en', 'fr') THEN 'name' ELSE 'default' END AS source FROM ts LEFT JOIN ex USING (task) LEFT JOIN mj USING (domain)""")
def task_settings(spark, sf):
    """The setting of each task by a chain of lookups, and which of them answered."""
    d = b.table(spark, sf, "documents").selectExpr("source || '/' || lang AS task", "source AS domain", "CASE WHEN length(source || lang) % 5 = 0 THEN 'own' END AS own").distinct()
    ex = d.where("length(task) % 2 = 0 and right(task, 2) <> 'en'").selectExpr("task", "'exact_' || right(task, 2) AS setting")
    ranked = ex.selectExpr("split_part(task, '/', 1) AS domain", "setting", "CAST(rank() OVER (ORDER BY task) AS BIGINT) AS ord")
    named = spark.createDataFrame([("en", "named_en"), ("fr", "named_fr")], "name string, setting string")
    return rounds.resolved_settings(d, ex, rounds.majority(ranked, "domain", "setting", "ord"), named, "default")


@query("SELECT l_suppkey AS task FROM (SELECT DISTINCT l_suppkey FROM lineitem) WHERE l_suppkey % 3 = 0 AND l_suppkey % 2 = 0 ORDER BY l_suppkey LIMIT 5")
def restricted_tasks(spark, sf):
    """Tasks of a split, among chosen ones, the first few."""
    t = b.trials(spark, sf).select("task").distinct()
    return rounds.restricted(t, t.where("task % 3 = 0"), t.where("task % 2 = 0"), 5)


@query(f"WITH {_LT}, m AS (SELECT task, min(reward) AS least FROM t GROUP BY task), s AS (SELECT task FROM m WHERE least >= 1 ORDER BY task LIMIT 4), a AS (SELECT task FROM m ORDER BY task LIMIT 4) SELECT task FROM s WHERE (SELECT count(*) FROM s) >= 4 UNION ALL SELECT task FROM a WHERE (SELECT count(*) FROM s) < 4")
def smoke_tasks(spark, sf):
    """Tasks for a quick trial: some that always pass, else the first."""
    t = b.trials(spark, sf).groupBy("task").agg(F.min("reward").alias("least_reward")).withColumn("ord", F.col("task"))
    return rounds.smoke_tasks(t, 4).select("task")


@query("WITH r AS (SELECT conv_id % 10 AS cluster, conv_id AS session, conv_id * 100 + turn AS id, row_number() OVER (PARTITION BY conv_id % 10, conv_id ORDER BY conv_id * 100 + turn) > 1 AS again FROM conversations) SELECT cluster, id FROM r QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY again, id) <= 6")
def spread_sample(spark, sf):
    """A few rows of each cluster, from different sessions first."""
    c = b.table(spark, sf, "conversations").selectExpr("conv_id % 10 AS cluster", "conv_id AS session", "conv_id * 100 + turn AS id")
    return rounds.spread_sample(c, "cluster", "session", "id", 6).select("cluster", "id")


@query("SELECT lang || source AS key, count(*) AS episodes, count(DISTINCT doc_id % 17) AS sessions FROM documents GROUP BY 1 HAVING count(*) >= 3 ORDER BY episodes DESC, sessions DESC, key LIMIT 10")
def ranked_clusters(spark, sf):
    """The largest clusters."""
    e = b.table(spark, sf, "documents").groupBy(F.concat("lang", "source").alias("key")).agg(F.count("*").alias("episodes"), F.count_distinct(F.col("doc_id") % 17).alias("sessions"))
    return rounds.ranked_clusters(e, 3, 10)


@query("""WITH r AS (SELECT p_brand AS area, p_partkey AS task, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
at AS (SELECT DISTINCT area, n, CAST(round_even(k * (n - 1) / 4.0, 0) AS BIGINT) AS i FROM (SELECT DISTINCT area, n FROM r), (SELECT unnest([0, 1, 2, 3, 4]) AS k)) SELECT r.area, r.task, r.n <= 5 OR "at".i IS NOT NULL AS picked FROM r LEFT JOIN "at" ON "at".area = r.area AND "at".i = r.i""".replace("at AS (", '"at" AS ('))
def stride_picks(spark, sf):
    """Tasks of each area at even strides."""
    return rounds.stride_pick(b.table(spark, sf, "part").selectExpr("p_brand AS area", "p_partkey AS task"), "area", "task", 5)


@query("WITH u AS (SELECT o_orderkey AS t FROM orders WHERE o_orderkey % 3 = 0 ORDER BY t DESC LIMIT 4), a AS (SELECT o_orderkey AS t FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT t FROM u) SELECT t FROM a ORDER BY t DESC LIMIT 40")
def recent_records(spark, sf):
    """The last records, few of them without a measurement."""
    return rounds.recent(b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("t")), "t", F.col("t") % 3 != 0)


@query("SELECT o_orderkey % 9 AS t, CASE WHEN o_custkey % 4 <> 0 THEN 'C' || (o_custkey % 4) END AS edit, count(*) AS n FROM orders WHERE NOT (o_orderkey % 9 = 5 AND o_custkey % 4 <> 0) GROUP BY ALL UNION ALL SELECT 5, 'C9', 1")
def replaced_round(spark, sf):
    """A log whose round 5 is written anew; its rows of other kinds stay."""
    log = b.table(spark, sf, "orders").selectExpr("o_orderkey % 9 AS t", "CASE WHEN o_custkey % 4 <> 0 THEN 'C' || (o_custkey % 4) END AS edit").groupBy("t", "edit").agg(F.count("*").alias("n"))
    return rounds.replaced_round(log, spark.sql("SELECT 5L AS t, 'C9' AS edit, 1L AS n"), 5)


@query(f"""WITH {_LT}, s AS (SELECT *, row_number() OVER (PARTITION BY job, task ORDER BY l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_linestatus) AS slot, count(*) OVER (PARTITION BY job, task) AS n FROM t),
d AS (SELECT job, round(abs(avg(CASE WHEN slot > floor(n / 2) AND slot <= 2 * floor(n / 2) THEN reward END) - avg(CASE WHEN slot <= floor(n / 2) THEN reward END)), 6) AS d FROM s WHERE floor(n / 2) > 0 GROUP BY job, task), l AS (SELECT job, list_sort(list(d)) AS xs FROM d GROUP BY job)
SELECT job, xs[1 + least(len(xs) - 1, CAST(floor(0.9 * len(xs)) AS INT))] AS p90, xs[1 + least(len(xs) - 1, CAST(floor(0.95 * len(xs)) AS INT))] AS p95, xs[1 + least(len(xs) - 1, CAST(floor(0.99 * len(xs)) AS INT))] AS p99, xs[len(xs)] AS most FROM l""")
def half_split_moves(spark, sf):
    """How far tasks move between halves of their own trials, by quantiles."""
    moves = trials.half_moves(b.trials(spark, sf), *b.TRIAL_ORDER, "reward").withColumn("d", r6(F.abs("d")))
    return rounds.floor_quantiles(moves, "job", "d", {"p90": 0.9, "p95": 0.95, "p99": 0.99, "most": 1.0})


@query("""SELECT n_nationkey AS id, greatest(0.25, round(n_nationkey / 10.0 + 0.03, 2)) AS hard_drop, CASE WHEN n_nationkey > 0 THEN round(n_nationkey / 50.0, 5) END AS detectable, CAST(greatest(2, round_even(n_nationkey / 2.0, 0)) AS INT) AS noise_passes, CAST(greatest(1, n_nationkey % 4) AS INT) AS most_net_drops, CAST(greatest(2, n_nationkey % 6) AS INT) AS most_drops FROM nation""")
def calibration_limits(spark, sf):
    """Limits that follow from measured nulls."""
    n = b.table(spark, sf, "nation").selectExpr("n_nationkey AS id", "n_nationkey / 10.0D AS abs_move_p99", "n_nationkey / 100.0D AS se", "-n_nationkey / 2.0D AS passes_p01", "CAST(n_nationkey % 4 AS INT) AS net_p99", "CAST(n_nationkey % 6 AS INT) AS drops_p99")
    return rounds.calibration(n, "id")


_DIFFS = "CASE o_orderkey % 6 WHEN 0 THEN '+++ b/x' || chr(10) || '+ \"Memory( text\"' WHEN 1 THEN '+x = Memory(1)' WHEN 2 THEN '+open(skills/a)' WHEN 3 THEN '-ToolRegistry()' WHEN 4 THEN '+subcall(2)' ELSE '+plain = 1' END"


@query(f"""SELECT id, CASE k WHEN 1 THEN 'memory' WHEN 2 THEN 'skill' WHEN 3 THEN 'client_tool' WHEN 4 THEN 'subagent' ELSE 'prompt' END AS component, k = 0 AS text_only, CASE WHEN said = 'skill' AND k = 2 THEN 'skill' WHEN k = 1 THEN 'memory' WHEN k = 2 THEN 'skill' WHEN k = 3 THEN 'client_tool' WHEN k = 4 THEN 'subagent' ELSE 'prompt' END AS kept,
CAST(CASE WHEN k IN (2, 3) THEN 1 ELSE 0 END AS INT) AS novelty FROM (SELECT o_orderkey AS id, o_orderkey % 6 AS k, 'skill' AS said FROM orders)""")
def edit_components(spark, sf):
    """Components that edits touch, by what their diffs show."""
    o = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_DIFFS).alias("diff"))
    c = rounds.component(F.col("diff"))
    known = F.array(F.lit("memory"), F.lit("subagent"))
    return o.select("id", c.alias("component"), rounds.text_only(F.col("diff")).alias("text_only"), rounds.declared_component(F.lit(" Skill"), F.col("diff")).alias("kept"), rounds.novelty(F.array(c), known).alias("novelty"))


# ---------------------------------------------------------------- records of other programs


@query("""SELECT o_orderkey AS number, 'T' || o_custkey AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'b' ELSE '' END AS body, CASE o_orderkey % 3 WHEN 0 THEN 'm' || o_orderkey WHEN 1 THEN 'n' || o_orderkey END AS merge_commit, '2024' AS merged_at, CAST(NULL AS VARCHAR) AS url FROM orders""")
def request_lists(spark, sf):
    """Requests read from JSON lists of either style."""
    one = F.expr("""'{"number":' || o_orderkey || ',"title":"T' || o_custkey || '"' || IF(o_orderkey % 2 = 0, ',"body":"b"', '') || CASE o_orderkey % 3 WHEN 0 THEN ',"mergeCommit":{"oid":"m' || o_orderkey || '"}' WHEN 1 THEN ',"merge_commit":"n' || o_orderkey || '"' ELSE '' END || IF(o_orderkey % 2 = 0, ',"mergedAt":"2024"}', ',"merged_at":"2024"}')""")
    lists = b.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit(',{"title":"none"}]')).alias("raw"))
    return records.requests(lists)


@query("""WITH d AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k, o_custkey AS v FROM orders) SELECT id, 'a' AS signal, CAST(v AS DOUBLE) AS value FROM d WHERE k <> 3 UNION ALL SELECT id, 'b', 2.5 FROM d WHERE k IN (0, 1) UNION ALL SELECT id, 'score', 0.5 FROM d WHERE k IN (0, 1, 2)""")
def scorer_signals(spark, sf):
    """Numbers of scorers' records in their three shapes, from the last line of what they printed."""
    record = F.expr("""CASE o_orderkey % 4 WHEN 0 THEN '{"signals":{"a":' || o_custkey || ',"b":{"count":2.5},"c":"x"},"score":0.5}' WHEN 1 THEN '{"counts":[{"id":"a","count":' || o_custkey || '},{"id":"b","count":2.5},{"id":"c","count":null}],"score":0.5}' WHEN 2 THEN '{"a":' || o_custkey || ',"score":0.5}' ELSE 'no record' END""")
    o = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), records.scorer_record(F.concat(F.lit("log line\n[1]\n"), record, F.lit("\n"))).alias("raw"))
    return records.signals(o.where("raw is not null"))


@query("SELECT user_id % 20 AS session, k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS k, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL")
def merged_counts(spark, sf):
    """Maps of counts added up, pair by pair."""
    e = b.event_stream(spark, sf).groupBy("user_id", (F.col("k") % 3).alias("k")).agg(F.count("*").alias("n"))
    m = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m")).groupBy((F.col("user_id") % 20).alias("session")).agg(F.collect_list("m").alias("all"))
    total = F.aggregate("all", F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<bigint>")), rounds.merged_counts)
    return m.select("session", F.explode(total).alias("k", "n"))


@query("SELECT patch, file, count(*) AS lines FROM (SELECT doc_id % 7 AS patch, 'd' || (doc_id % 3) || '/f.go' AS file FROM documents) WHERE file <> 'd1/f.go' GROUP BY ALL")
def restricted_patches(spark, sf):
    """Added lines of patches within some folders; a patch adds a line for each document."""
    d = b.table(spark, sf, "documents").selectExpr("doc_id % 7 AS patch_id", "'d' || (doc_id % 3) || '/f.go' AS file").groupBy("patch_id", "file").agg(F.count("*").cast("int").alias("n"))
    one = F.format_string("diff --git a/%s b/%s\n--- a/%s\n+++ b/%s\n@@ -0,0 +1,%d @@\n%s", "file", "file", "file", "file", "n", F.repeat(F.lit("+x\n"), F.col("n")))
    p = d.groupBy("patch_id").agg(F.array_join(F.array_sort(F.collect_list(one)), "").alias("patch"))
    lines = diffs.diff_lines(p).where(F.split_part("file", F.lit("/"), F.lit(1)).isin("d0", "d2") & (F.col("marker") == "+"))
    return lines.groupBy(F.col("patch_id").alias("patch"), "file").agg(F.count("*").alias("lines"))
