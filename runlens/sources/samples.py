"""Session transcripts made of the driver's event table: raw JSON lines that hold every shape the readers know.

A user is a session and a file, an event a line; what the line says follows from the event's type and its number ``k``. Every fifth
user's file is a helper's below the session of the user before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bindings import table

_TOOL = '"message":{"content":[{"type":"tool_use","id":"t{e}","name":"%s","input":%s}]}'
_RESULT = '%s"message":{"content":[{"type":"tool_result","tool_use_id":"{p}",%s"content":%s}]}'
#: Cases of each event type, by the remainder of k: type of the line, and its fields with placeholders in braces.
CASES = {
    "signup": (
        ("user", '"origin":{"kind":"human"},"message":{"content":"please fix the flaky build of module {k6}"}'),
        ("user", '"message":{"content":"no, that\'s not what i asked"}'),
        ("user", '"message":{"content":[{"type":"text","text":"wait"},{"type":"text","text":"<system-reminder>x</system-reminder> undo it"}]}'),
        ("user", '"message":{"content":" [Request interrupted by user for tool use]"}'),
        ("user", '"isMeta":true,"message":{"content":"meta text"}'),
        ("user", '"message":{"content":"<local-command>ls</local-command>"}'),
        ("user", '"origin":{"kind":"peer","name":"n{k9}"},"message":{"content":"<cross-session-message from-session=\\"s{k9}\\" from-name=\\"x\\"> {news} </cross-session-message>"}'),
        ("user", '"message":{"content":"The coordinator sent a message while you were working: stop {k2}"}'),
    ),
    "view": (
        ("assistant", '"message":{"content":[{"type":"text","text":"done {k}"}]}'),
        ("assistant", '"message":{"content":[{"type":"text","text":"I am Waiting on the other session"},{"type":"text","text":"  "}]}'),
        ("assistant", '"message":{"content":[{"type":"text","text":"already merged by them"}]}'),
        ("assistant", '"message":{"content":[{"type":"thinking","thinking":"hm"},{"type":"text","text":"who owns this module"}]}'),
        ("assistant", '"message":{"content":[{"type":"text","text":"ok"},{"type":"tool_use","id":"t{e}","name":"Bash","input":{"timeout":5,"command":"go test ./p{k4}"}}]}'),
    ),
    "click": (
        *[("assistant", _TOOL % ("Bash", '{"command":"gh pr checks 12 --repo team/app --part {k2}"}'))] * 4,
        ("assistant", _TOOL % ("Bash", '{"command":"go build ./..."}')),
        ("assistant", _TOOL % ("Edit", '{"file_path":"{root}/src/f{d4}.go"}')),
        ("assistant", _TOOL % ("SendMessage", '{"to":"s{k9}"}')),
        ("assistant", _TOOL % ("Bash", '{"command":"gh pr create --title \'Repair the flaky build of module {d3}\'"}')),
        ("assistant", _TOOL % ("Bash", '{"command":"{git}"}')),
        ("assistant", _TOOL % ("Bash", '{"command":"gh issue comment 4 --body \'Claimed by me\'"}')),
    ),
    "error": (
        ("user", _RESULT % ("", '"is_error":true,', '"exit {k}"')),
        ("user", _RESULT % ("", '"is_error":true,', '[{"type":"text","text":"ok"},{"type":"image"},{"type":"text","text":"  --- FAIL: TestA"}]')),
        ("user", _RESULT % ("", "", '"the hook did not respond"')),
        ("user", _RESULT % ('"toolDenialKind":"rejected",', '"is_error":true,', '"no"')),
        ("user", _RESULT % ('"toolDenialKind":"interrupted",', '"is_error":true,', '"cut off"')),
        ("user", _RESULT % ("", '"is_error":true,', '"The user doesn\'t want to proceed with this tool use"')),
        ("user", _RESULT % ("", '"is_error":true,', '"Permission to use Bash was denied"')),
        ("user", _RESULT % ("", '"is_error":true,', '"  hook didn\'t respond\\nmore"')),
        ("user", _RESULT % ("", '"is_error":true,', '"this file is isolated in the worktree of another"')),
        ("user", _RESULT % ("", "", '"= 2 failed in 1s ="')),
        ("user", _RESULT % ("", "", '"CONFLICT (content): Merge conflict in a.go"')),
        ("user", _RESULT % ("", "", '"To github.com:team/app.git\\n * [new branch]      fix{k3} -> fix{k3}\\nthe tree belongs to a different worktree"')),
    ),
    "purchase": (
        ("attachment", '"attachment":{"type":"silent_turn_reminder"}'),
        ("attachment", '"attachment":{"type":"hook_system_message","content":"Stop hook didn\'t respond in time"}'),
        ("attachment", '"attachment":{"type":"queued_command","origin":{"kind":"human"},"prompt":"please fix the flaky build of module {k6}"}'),
        ("system", '"hookInfos":[{"command":"other"},{"command":"callback"}]'),
        ("attachment", '"attachment":{"type":"hook_system_message","content":"fine"}'),
    ),
}


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, raw), as ``transcripts.read_lines`` gives them; lines of some numbers are cut short and no JSON."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("u"), F.col("event_id").alias("e"), "ts", F.col("event_type").alias("t"), F.get_json_object("props", "$.k").cast("long").alias("k")
    )
    order = Window.partitionBy("u").orderBy("ts", "e")
    called = F.last(F.expr("CASE WHEN t = 'click' OR (t = 'view' AND k % 5 = 4) THEN 't' || e END"), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumns({"line_no": (F.row_number().over(order) - 1).cast("int"), "p": F.coalesce(called, F.lit("none"))})
    cases = spark.createDataFrame([(t, len(rows), r, name, body) for t, rows in CASES.items() for r, (name, body) in enumerate(rows)], "t string, m long, r long, line_type string, body string")
    e = e.join(F.broadcast(cases), "t").where("k % m = r")
    values = {
        "{git}": "CASE (k DIV 10) % 3 WHEN 0 THEN 'git commit -m wip' WHEN 1 THEN 'git push -q origin fix{k3}' ELSE 'git commit -m wip && git push -q origin fix{k3}' END",
        "{k}": "k", "{k2}": "k % 2", "{k3}": "k % 3", "{k4}": "k % 4", "{k6}": "k % 6", "{k9}": "k % 9", "{d3}": "(k DIV 10) % 3", "{d4}": "(k DIV 10) % 4", "{e}": "e", "{p}": "p",
        "{root}": "cwd", "{news}": "CASE WHEN k % 3 = 0 THEN 'never mind the plan' ELSE 'the interface is ready' END",
    }
    e = e.selectExpr(
        "*", "u - CAST(u % 5 = 0 AS INT) AS number", "'/repo/app' || CASE WHEN u % 3 <> 0 THEN '/worktrees/w' || u ELSE '' END AS cwd",
        "CASE WHEN k % 4 = 0 THEN 'fix' || u % 2 ELSE 'main' END AS branch", "CASE WHEN u % 5 = 0 THEN 'a' || u END AS agent",
    )
    body = F.col("body")
    for name, sql in values.items():
        body = F.replace(body, F.lit(name), F.expr(sql).cast("string"))
    head = F.format_string(
        '{"type":"%s","timestamp":"%sZ","sessionId":"s%s",%s"cwd":"%s","gitBranch":"%s",', "line_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), "number",
        F.coalesce(F.concat(F.lit('"isSidechain":true,"agentId":"'), "agent", F.lit('",')), F.lit("")), "cwd", "branch",
    )
    file = F.concat(F.lit("p"), F.pmod("number", F.lit(7)), F.lit("/s"), "number", F.coalesce(F.concat(F.lit("/subagents/"), "agent"), F.lit("")), F.lit(".jsonl"))
    return e.select(file.alias("file"), "line_no", F.concat(head, body, F.expr("CASE WHEN k % 37 = 36 THEN '' ELSE '}' END")).alias("raw"))
