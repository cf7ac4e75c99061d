"""Queries over session transcripts: the readers run on JSON lines made of the event table, the SQL on that table itself.

The SQL states the rules anew, with their fixed values, and never reads the engine's.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import events as ev
from ..operators import measure, phrases, runs, sessions
from ..sources import samples, transcripts
from ..sources.kept import kept
from .base import query, r6

#: Between a repository and its work trees in the made transcripts.
MARKER = "/worktrees/"
_CHI = "({df} * pow(1 - 2.0 / (9 * {df}) + ({z}) * sqrt(2.0 / (9 * {df})), 3.0))"

# ---------------------------------------------------------------- SQL: events as the lines say them

_LINES = r"""e AS (SELECT user_id AS u, event_id AS e, ts AS tm, event_type AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS line FROM events),
l0 AS (SELECT *, coalesce(last_value(CASE WHEN t = 'click' OR (t = 'view' AND k % 5 = 4) THEN 't' || e END IGNORE NULLS) OVER (PARTITION BY u ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'none') AS p,
  u % 5 = 0 AS helper, 's' || (u - CAST(u % 5 = 0 AS BIGINT)) AS ses, 'p' || (((u - CAST(u % 5 = 0 AS BIGINT)) % 7 + 7) % 7) AS project, strftime(tm, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts,
  '/repo/app' || CASE WHEN u % 3 <> 0 THEN '/worktrees/w' || u ELSE '' END AS cwd, CASE WHEN k % 4 = 0 THEN 'fix' || (u % 2) ELSE 'main' END AS branch FROM e),
l AS (SELECT *, project || '/' || ses || CASE WHEN helper THEN '/subagents/a' || u ELSE '' END || '.jsonl' AS file FROM l0 WHERE k % 37 <> 36)"""

_TOOLS = r"""tool AS (
  SELECT *, 1 AS block, 't' || e AS tool_id, 'Bash' AS tool_name, '{"command":"go test ./p' || (k % 4) || '","timeout":5}' AS input FROM l WHERE t = 'view' AND k % 5 = 4
  UNION ALL SELECT *, 0, 't' || e, CASE k % 10 WHEN 5 THEN 'Edit' WHEN 6 THEN 'SendMessage' ELSE 'Bash' END,
    CASE WHEN k % 10 < 4 THEN '{"command":"gh pr checks 12 --repo team/app --part ' || (k % 2) || '"}' WHEN k % 10 = 4 THEN '{"command":"go build ./..."}'
    WHEN k % 10 = 5 THEN '{"file_path":"' || CASE WHEN u % 3 <> 0 THEN '/repo/app/worktrees/w' || u ELSE '/repo/app' END || '/src/f' || ((k // 10) % 4) || '.go"}' WHEN k % 10 = 6 THEN '{"to":"s' || (k % 9) || '"}'
    WHEN k % 10 = 7 THEN '{"command":"gh pr create --title ''Repair the flaky build of module ' || ((k // 10) % 3) || '''"}' WHEN k % 10 = 8 THEN '{"command":"' || CASE (k // 10) % 3 WHEN 0 THEN 'git commit -m wip' WHEN 1 THEN 'git push -q origin fix' || (k % 3) ELSE 'git commit -m wip && git push -q origin fix' || (k % 3) END || '"}'
    ELSE '{"command":"gh issue comment 4 --body ''Claimed by me''"}' END FROM l WHERE t = 'click'),
said AS (SELECT *, 0 AS block, CASE k % 5 WHEN 0 THEN 'done ' || k WHEN 1 THEN 'I am Waiting on the other session' WHEN 2 THEN 'already merged by them' WHEN 3 THEN 'who owns this module' ELSE 'ok' END AS text FROM l WHERE t = 'view'),
result AS (SELECT *, 0 AS block, k % 12 IN (0, 1, 3, 4, 5, 6, 7, 8) AS is_error, CASE k % 12 WHEN 3 THEN 'rejected' WHEN 4 THEN 'interrupted' END AS denial,
  CASE k % 12 WHEN 0 THEN 'exit ' || k WHEN 1 THEN 'ok' || chr(10) || '  --- FAIL: TestA' WHEN 2 THEN 'the hook did not respond' WHEN 3 THEN 'no' WHEN 4 THEN 'cut off' WHEN 5 THEN 'The user doesn''t want to proceed with this tool use'
  WHEN 6 THEN 'Permission to use Bash was denied' WHEN 7 THEN '  hook didn''t respond' || chr(10) || 'more' WHEN 8 THEN 'this file is isolated in the worktree of another' WHEN 9 THEN '= 2 failed in 1s =' WHEN 10 THEN 'CONFLICT (content): Merge conflict in a.go'
  ELSE 'To github.com:team/app.git' || chr(10) || ' * [new branch]      fix' || (k % 3) || ' -> fix' || (k % 3) || chr(10) || 'the tree belongs to a different worktree' END AS text FROM l WHERE t = 'error'),
typed AS (SELECT *, 0 AS block, CASE k % 8 WHEN 0 THEN 'please fix the flaky build of module ' || (k % 6) WHEN 1 THEN 'no, that''s not what i asked' WHEN 2 THEN 'wait' || chr(10) || ' undo it'
    ELSE 'The coordinator sent a message while you were working: stop ' || (k % 2) END AS text FROM l WHERE t = 'signup' AND (k % 8 = 0 OR (k % 8 IN (1, 2, 7) AND NOT helper))
  UNION ALL SELECT *, 0, 'please fix the flaky build of module ' || (k % 6) FROM l WHERE t = 'purchase' AND k % 5 = 2)"""

_S = (
    _LINES
    + ",\n"
    + _TOOLS
    + r""",
c AS (SELECT file, ses, helper, u, line, block, ts, 'tool_use' AS kind, NULL AS text, tool_id, tool_name, input, NULL AS is_error, NULL AS denial FROM tool
  UNION ALL SELECT file, ses, helper, u, line, block, ts, 'assistant', text, NULL, NULL, NULL, NULL, NULL FROM said
  UNION ALL SELECT file, ses, helper, u, line, block, ts, 'tool_result', text, p, NULL, NULL, is_error, denial FROM result
  UNION ALL SELECT file, ses, helper, u, line, block, ts, 'human', text, NULL, NULL, NULL, NULL, NULL FROM typed
  UNION ALL SELECT file, ses, helper, u, line, 0, ts, 'interrupt', NULL, NULL, NULL, NULL, NULL, NULL FROM l WHERE t = 'signup' AND k % 8 = 3
  UNION ALL SELECT file, ses, helper, u, line, 0, ts, 'silence_reminder', NULL, NULL, NULL, NULL, NULL, NULL FROM l WHERE t = 'purchase' AND k % 5 = 0
  UNION ALL SELECT file, ses, helper, u, line, 0, ts, 'hook_no_response', 'Stop hook didn''t respond in time', NULL, NULL, NULL, NULL, NULL FROM l WHERE t = 'purchase' AND k % 5 = 1),
f AS (SELECT *, coalesce(kind = 'human' AND lag(kind) OVER w = 'human' AND lag(text) OVER w = text, FALSE) AS again FROM c WINDOW w AS (PARTITION BY file ORDER BY line, block)),
s AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY line, block) - 1 AS i, ts, ses AS session_id, CASE WHEN helper THEN 'a' || u END AS agent_id, kind, text, tool_id, tool_name, input, is_error, denial FROM f WHERE NOT again)"""
)


def _lines(spark, sf):
    return kept(spark, lambda: samples.raw_lines(spark, sf), "lines", sf)


def _events(spark, sf):
    return transcripts.events(_lines(spark, sf))


@query(f"WITH {_S} SELECT * FROM s")
def transcript_events(spark, sf):
    """The struggle stream of all transcripts."""
    return _events(spark, sf)


# ---------------------------------------------------------------- struggle signals and episodes

_WORDS = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}'']+'), lambda w: w <> '')"
_STOPS = "['the', 'and', 'for', 'you', 'that', 'this', 'with', 'are', 'can', 'what', 'how', 'was', 'but', 'not', 'have', 'has', 'from', 'your', 'all', 'any', 'its', 'it''s', 'just', 'into', 'out', 'now', 'then', 'they', 'them', 'there', 'here', 'also', 'use', 'get', 'did', 'does', 'will', 'would', 'should', 'please']"
_CONTENT = f"list_distinct(list_filter({_WORDS}, lambda w: length(w) >= 3 AND NOT list_contains({_STOPS}, w)))"
_TRI = "list_distinct(list_transform(range(1, greatest(length({t}) - 2, 1) + 1), lambda j: substr({t}, j, 3)))"
_LIKE = "(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))))"
_TEST_FAILED = r"regexp_matches(text, '(?m)^\s*(--- FAIL|FAIL\t|FAIL .*\[build failed\]|FAILED \(failures|Tests failed|FAILED .*::|=.* failed)|test result: FAILED| FAILED in |\tfail\t|Process completed with exit code|tests failed')"
_DENIED = "CASE WHEN denial IS NOT NULL THEN denial <> 'interrupted' ELSE contains(text, 'doesn''t want to proceed with this tool use') OR (starts_with(text, 'Permission to use') AND contains(text, 'denied')) OR starts_with(text, 'permission was denied') END"
_HOOK = "(contains(text, 'hook did not respond') OR contains(text, 'hook didn''t respond'))"
_PUSHBACK = """(list_has_any(ws, ['no', 'nope', 'nah', 'wtf', 'why', 'stop', 'again', 'bruh', 'wrong', 'ugh', 'huh', 'wait', 'undo'])
  OR len(list_filter(['i said', 'i told you', 'i asked', 'not what i', 'that''s not', 'thats not', 'you didn''t', 'you did not', 'didnt', 'still not', 'still broken', 'doesn''t work', 'didn''t work', 'not working', 'why did you', 'don''t do', 'you were supposed', 'instead of'],
    lambda p: contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || p || ' '))) > 0)"""

_HITS = (
    _S
    + f""",
r AS (SELECT *, {_HOOK} AS hook, {_DENIED} AS denied FROM s WHERE kind = 'tool_result'),
first_result AS (SELECT file, tool_id, arg_min(is_error OR {_TEST_FAILED}, i) AS failed FROM s WHERE kind = 'tool_result' GROUP BY ALL),
uses AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY i) AS n, {_TRI.format(t="input")} AS tri FROM s WHERE kind = 'tool_use'),
twins AS (SELECT b.file, b.i, arg_max(a.tool_id, a.n) AS tool_id FROM uses b JOIN uses a ON a.file = b.file AND a.n BETWEEN b.n - 4 AND b.n - 1 AND a.tool_name = b.tool_name AND (a.input = b.input OR {_LIKE.format(a="a.tri", b="b.tri")} >= 0.85) GROUP BY ALL),
h AS (SELECT file, i, text, sum(CAST(kind IN ('assistant', 'tool_use') AS INT)) OVER (PARTITION BY file ORDER BY i) AS outs, kind, last_value(CASE WHEN kind NOT IN ('silence_reminder', 'hook_no_response') THEN kind END IGNORE NULLS) OVER (PARTITION BY file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after FROM s),
humans AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY i) AS n, {_CONTENT.format(t="text")} AS cw, {_WORDS.format(t="text")} AS ws FROM h WHERE kind = 'human'),
hits AS (SELECT file, i, 'tool_error' AS signal FROM r WHERE is_error AND NOT hook AND NOT denied AND denial IS NULL
  UNION ALL SELECT file, i, 'hook_timeout' FROM r WHERE hook UNION ALL SELECT file, i, 'hook_timeout' FROM s WHERE kind = 'hook_no_response'
  UNION ALL SELECT file, i, 'permission_denial' FROM r WHERE NOT hook AND denied
  UNION ALL SELECT file, i, 'user_interrupt' FROM s WHERE kind = 'interrupt' UNION ALL SELECT file, i, 'silence' FROM s WHERE kind = 'silence_reminder'
  UNION ALL SELECT file, i, 'test_failure' FROM s WHERE kind = 'tool_result' AND {_TEST_FAILED}
  UNION ALL SELECT file, i, 'user_correction' FROM humans WHERE after IN ('tool_use', 'tool_result', 'assistant', 'interrupt') AND length(text) <= 280 AND {_PUSHBACK}
  UNION ALL SELECT file, i, 'retry' FROM twins JOIN first_result USING (file, tool_id) WHERE failed
  UNION ALL SELECT DISTINCT b.file, b.i, 'reask' FROM humans b JOIN humans a ON a.file = b.file AND a.n BETWEEN b.n - 10 AND b.n - 1 AND len(a.cw) >= 4 AND len(b.cw) >= 4 AND a.outs < b.outs AND {_LIKE.format(a="a.cw", b="b.cw")} >= 0.6)"""
)


def _struggles(spark, sf):
    return kept(spark, lambda: sessions.struggle_marks(_events(spark, sf)), "struggles", sf)


@query(f"WITH {_HITS} SELECT * FROM hits")
def struggle_signals(spark, sf):
    """Every hit of the nine struggle detectors."""
    return sessions.signals(_struggles(spark, sf))


_EPISODES = (
    _HITS
    + """,
merged AS (SELECT file, i, list(signal) AS sigs FROM hits GROUP BY ALL),
marked AS (SELECT *, CAST(i - lag(i) OVER (PARTITION BY file ORDER BY i) > 6 AS INT) AS fresh FROM merged),
numbered AS (SELECT *, CAST(sum(coalesce(fresh, 0)) OVER (PARTITION BY file ORDER BY i) AS BIGINT) AS episode FROM marked),
spans AS (SELECT file, episode, min(i) AS start_event, max(i) AS end_event, CAST(sum(len(sigs)) AS BIGINT) AS hits FROM numbered GROUP BY ALL),
sizes AS (SELECT file, count(*) AS session_events FROM s GROUP BY file),
shown AS (SELECT x.*, a.session_id, a.agent_id, a.ts AS start, b.ts AS "end", contains(x.file, '/subagents/') AS subagent, session_events, end_event - start_event + 1 AS span_events,
  (SELECT CAST(count(*) AS BIGINT) FROM s WHERE s.file = x.file AND s.i BETWEEN start_event AND end_event AND kind = 'tool_use') AS tool_calls,
  (SELECT CAST(count(*) AS BIGINT) FROM s WHERE s.file = x.file AND s.i BETWEEN start_event AND end_event AND kind = 'tool_result' AND is_error) AS tool_errors,
  (SELECT CAST(count(*) AS BIGINT) FROM s WHERE s.file = x.file AND s.i BETWEEN start_event AND end_event AND kind = 'human') AS human_turns,
  coalesce((SELECT arg_max(text, i) FROM s WHERE s.file = x.file AND s.i <= start_event AND kind = 'human'), '') AS user_turn
  FROM spans x JOIN s a ON a.file = x.file AND a.i = start_event JOIN s b ON b.file = x.file AND b.i = end_event JOIN sizes ON sizes.file = x.file)"""
)


def _episodes(spark, sf):
    return kept(spark, lambda: sessions.episodes(_struggles(spark, sf)), "episodes", sf)


@query(f"WITH {_EPISODES} SELECT * FROM shown")
def struggle_episodes(spark, sf):
    """Episodes of struggle with their counts and the turn that the agent was working on."""
    return _episodes(spark, sf).select("file", "episode", "start_event", "end_event", "hits", "session_id", "agent_id", "start", "end", "subagent", "session_events", "span_events", "tool_calls", "tool_errors", "human_turns", "user_turn")


@query(f"""WITH {_EPISODES}, per AS (SELECT n.file, n.episode, unnest(n.sigs) AS signal FROM numbered n), one AS (SELECT file, episode, signal, count(*) AS n FROM per GROUP BY ALL)
SELECT signal, count(*) AS episodes, CAST(sum(n) AS BIGINT) AS hits, count(DISTINCT session_id) AS sessions FROM one JOIN shown USING (file, episode) GROUP BY signal""")
def struggle_summary(spark, sf):
    """Episodes and hits of each signal, and the sessions that have it."""
    return sessions.signal_summary(_episodes(spark, sf))


@query(f"""WITH {_EPISODES} SELECT (SELECT count(DISTINCT file) FROM s) AS files, (SELECT count(DISTINCT split_part(file, '/', 1)) FROM s) AS projects, (SELECT count(DISTINCT ses) FROM l) AS sessions,
(SELECT count(*) FROM s) AS events, (SELECT count(*) FROM shown) AS episodes, (SELECT count(DISTINCT session_id) FROM shown) AS sessions_with_episodes""")
def transcript_totals(spark, sf):
    """Files, projects, sessions (helpers' files belong to theirs) and events of all transcripts, and how many have episodes."""
    events = _struggles(spark, sf)
    t = events.agg(
        F.count_distinct("file").alias("files"), F.count_distinct(F.split_part("file", F.lit("/"), F.lit(1))).alias("projects"),
        F.count_distinct(sessions.session_of(F.col("file"))).alias("sessions"), F.count("*").alias("events"),
    )
    return t.crossJoin(_episodes(spark, sf).agg(F.count("*").alias("episodes"), F.count_distinct("session_id").alias("sessions_with_episodes")))  # one row each


@query(f"""WITH {_HITS}, w AS (SELECT *, count(*) OVER (PARTITION BY file) AS n FROM s), x AS (SELECT file, i, signal, kind, least(i + 2, n - 1) AS hi, greatest(i - 3, 0) AS lo FROM hits JOIN w USING (file, i) WHERE signal = 'permission_denial')
SELECT x.file, x.i AS hit, s.i, s.kind, (SELECT arg_max(tool_name, i) FROM s c WHERE c.file = x.file AND c.i < s.i AND c.kind = 'tool_use' AND c.tool_id = s.tool_id) AS tool FROM x JOIN s ON s.file = x.file AND s.i BETWEEN lo AND hi WHERE s.kind = 'tool_result'""")
def denial_context(spark, sf):
    """Results round each denied permission, with the tool of the nearest call before that they answer."""
    events = _struggles(spark, sf)
    h = events.where(F.array_contains("signals", "permission_denial")).select("file", "i")
    spans = h.select("file", F.col("i").alias("episode"), F.col("i").alias("start_event"), F.col("i").alias("end_event"))
    named = F.last(F.when(F.col("kind") == "tool_use", F.col("tool_name")), ignorenulls=True).over(sessions.Window.partitionBy("file", "tool_id").orderBy("i"))
    shown = ev.context(spans, events.withColumn("tool", named), "file").where("kind = 'tool_result'")
    return shown.select("file", F.col("episode").alias("hit"), F.col("event").alias("i"), "kind", "tool")


# ---------------------------------------------------------------- facts and sessions

_MARKS = (
    _S
    + """,
calls AS (SELECT session_id AS session, substr(ts, 1, 13) AS hour, count(*) AS calls FROM s WHERE kind = 'tool_use' GROUP BY ALL),
heads AS (SELECT session_id AS session, kind, is_error, split_part(ltrim(text), chr(10), 1) AS head FROM s WHERE kind IN ('tool_result', 'hook_no_response')),
marks AS (SELECT session, sum(CASE WHEN kind = 'hook_no_response' OR (is_error AND contains(head, 'hook didn''t respond')) THEN 1 ELSE 0 END) AS hook_timeouts, sum(CASE WHEN is_error AND contains(head, 'isolated in the worktree') THEN 1 ELSE 0 END) AS guard_rejections FROM heads GROUP BY session),
hooks AS (SELECT ses AS session, count(*) AS callbacks FROM l WHERE t = 'purchase' AND k % 5 = 3 GROUP BY ses),
facts AS (SELECT session, CAST(coalesce(hook_timeouts, 0) AS BIGINT) AS hook_timeouts, CAST(coalesce(guard_rejections, 0) AS BIGINT) AS guard_rejections, coalesce(callbacks, 0) AS host_hook_callbacks FROM (SELECT DISTINCT ses AS session FROM l) LEFT JOIN marks USING (session) LEFT JOIN hooks USING (session))"""
)


def _session_facts(spark, sf):
    return sessions.transcript_sessions(_struggles(spark, sf).drop("signals"), transcripts.host_hooks(_lines(spark, sf)))


@query(f"WITH {_MARKS} SELECT * FROM facts")
def host_markers(spark, sf):
    """Signs of a host round each session: its own messages that open error results, and its hooks."""
    return _session_facts(spark, sf)[1]


@query(f"WITH {_MARKS} SELECT * FROM calls")
def session_calls(spark, sf):
    """Tool calls of each session by hour, helpers' files folded in."""
    return _session_facts(spark, sf)[0]


# ---------------------------------------------------------------- coordination

_P = (
    _LINES
    + ",\n"
    + _TOOLS
    + r""",
c AS (SELECT file, line, block, ts, ses, cwd, branch, 'tool_use' AS kind, NULL::VARCHAR AS text, tool_id, tool_name, input, NULL::BOOLEAN AS is_error, NULL::VARCHAR AS sender, NULL::VARCHAR AS sender_name FROM tool
  UNION ALL SELECT file, line, block, ts, ses, cwd, branch, 'assistant', text, NULL, NULL, NULL, NULL, NULL, NULL FROM said
  UNION ALL SELECT file, line, block, ts, ses, cwd, branch, 'tool_result', text, p, NULL, NULL, is_error, NULL, NULL FROM result
  UNION ALL SELECT file, line, block, ts, ses, cwd, branch, 'human', text, NULL, NULL, NULL, NULL, NULL, NULL FROM typed WHERE NOT (t = 'signup' AND k % 8 = 7)
  UNION ALL SELECT file, line, 0, ts, ses, cwd, branch, 'coordinator', 'The coordinator sent a message while you were working: stop ' || (k % 2), NULL, NULL, NULL, NULL, 'coordinator', NULL FROM l WHERE t = 'signup' AND k % 8 = 7
  UNION ALL SELECT file, line, 0, ts, ses, cwd, branch, 'peer', CASE WHEN k % 3 = 0 THEN 'never mind the plan' ELSE 'the interface is ready' END, NULL, NULL, NULL, NULL, 's' || (k % 9), 'n' || (k % 9) FROM l WHERE t = 'signup' AND k % 8 = 6),
o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, block) AS n, CASE WHEN kind = 'peer' THEN 'peer ' || sender || ' ' || substr(text, 1, 120) WHEN kind IN ('human', 'coordinator') THEN kind || ' ' || text END AS heard FROM c),
walk AS (SELECT file, n, TRUE AS keep, [coalesce(heard, '')] AS last8 FROM o WHERE n = 1
  UNION ALL SELECT o.file, o.n, o.heard IS NULL OR NOT list_contains(last8, o.heard), CASE WHEN o.heard IS NULL OR NOT list_contains(last8, o.heard) THEN list_slice(list_append(last8, coalesce(o.heard, '')), -8, -1) ELSE last8 END FROM walk JOIN o ON o.file = walk.file AND o.n = walk.n + 1),
m AS (SELECT o.file, row_number() OVER (PARTITION BY o.file ORDER BY o.n) - 1 AS i, ts, ses AS session_id, cwd, branch, kind, text, tool_id, tool_name, input, is_error, sender, sender_name FROM o JOIN walk USING (file, n) WHERE keep)"""
)


def _peers(spark, sf):
    return kept(spark, lambda: transcripts.coordination_events(_lines(spark, sf)), "coordination", sf)


@query(f"WITH RECURSIVE {_P} SELECT * FROM m")
def coordination_events(spark, sf):
    """The coordination stream of all transcripts: messages of peers and coordinators told apart, repeats left out."""
    return _peers(spark, sf).drop("agent_id")


_RETRACT = "contains(lower(text), 'never mind')"
_POLLS = (
    _P
    + f""",
out AS (SELECT file, i, tool_name = 'SendMessage' AS sends, CASE WHEN tool_name = 'Bash' AND contains(input, 'gh pr checks') THEN json_extract_string(input, '$.command') END AS cmd FROM m WHERE kind = 'tool_use'),
turns AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY i) AS n, coalesce(max(CASE WHEN sends THEN i END) OVER (PARTITION BY file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS stop, {_TRI.format(t="coalesce(cmd, '')")} AS tri FROM out),
polls AS (SELECT b.file, b.i FROM turns b JOIN turns a ON a.file = b.file AND a.n BETWEEN b.n - 12 AND b.n - 1 AND a.i > b.stop AND a.cmd IS NOT NULL AND (a.cmd = b.cmd OR {_LIKE.format(a="a.tri", b="b.tri")} >= 0.8) WHERE b.cmd IS NOT NULL GROUP BY ALL HAVING count(*) + 1 >= 3),
back AS (SELECT *, row_number() OVER (PARTITION BY file, sender ORDER BY i) AS nth FROM m WHERE kind IN ('peer', 'coordinator') AND {_RETRACT}),
shits AS (SELECT file, i, 'peer_message' AS signal FROM m WHERE kind = 'peer' UNION ALL SELECT file, i, 'coordinator_message' FROM m WHERE kind = 'coordinator'
  UNION ALL SELECT file, i, 'peer_retraction' FROM back UNION ALL SELECT file, i, 'peer_churn' FROM back WHERE nth >= 2
  UNION ALL SELECT file, i, 'message_out' FROM out WHERE sends
  UNION ALL SELECT file, i, 'vcs_conflict' FROM m WHERE kind = 'tool_result' AND contains(text, 'CONFLICT (')
  UNION ALL SELECT file, i, 'worktree_collision' FROM m WHERE kind = 'tool_result' AND contains(text, 'belongs to a different worktree')
  UNION ALL SELECT file, i, 'already_done' FROM m WHERE kind = 'assistant' AND contains(text, 'already merged')
  UNION ALL SELECT file, i, 'blocked_on_other' FROM m WHERE kind = 'assistant' AND contains(lower(text), 'waiting on the other')
  UNION ALL SELECT file, i, 'ownership_question' FROM m WHERE kind = 'assistant' AND contains(text, 'who owns')
  UNION ALL SELECT file, i, 'claim' FROM m WHERE kind = 'tool_use' AND contains(input, 'gh issue comment') AND contains(lower(input), 'claimed by')
  UNION ALL SELECT file, i, 'polling' FROM polls)"""
)


@query(f"WITH RECURSIVE {_POLLS} SELECT * FROM shits")
def session_coordination(spark, sf):
    """Every hit of the coordination detectors that look at one transcript."""
    return sessions.signals(sessions.coordination_marks(_peers(spark, sf), phrases.phrases_for("helper")))


_HANDLED = (
    _P
    + f""",
handled AS (SELECT a.file, a.i, a.sender, a.kind = 'coordinator' AS coordinator, {_RETRACT.replace("text", "a.text")} AS retraction,
  coalesce((SELECT min(b.i) FROM m b WHERE b.file = a.file AND b.i BETWEEN a.i + 1 AND a.i + 20 AND b.kind = 'tool_use' AND b.tool_name <> 'SendMessage') < coalesce((SELECT min(b.i) FROM m b WHERE b.file = a.file AND b.i BETWEEN a.i + 1 AND a.i + 20 AND b.kind IN ('human', 'peer', 'coordinator')), 1000000), FALSE) AS acted,
  EXISTS (SELECT 1 FROM m b WHERE b.file = a.file AND b.i BETWEEN a.i + 1 AND a.i + 60 AND b.kind = 'tool_use' AND b.tool_name = 'SendMessage') AS replied FROM m a WHERE a.kind IN ('peer', 'coordinator'))"""
)


@query(f"WITH RECURSIVE {_HANDLED} SELECT * FROM handled")
def incoming_outcomes(spark, sf):
    """How each message that came in was handled."""
    return sessions.message_outcomes(_peers(spark, sf))


@query(f"""WITH RECURSIVE {_HANDLED}, sent AS (SELECT a.file, a.i, arg_min(b.is_error, b.i) AS failed FROM m a LEFT JOIN m b ON b.file = a.file AND b.kind = 'tool_result' AND b.tool_id = a.tool_id WHERE a.kind = 'tool_use' AND a.tool_name = 'SendMessage' GROUP BY ALL)
SELECT count(*) AS messages, CAST(sum(CAST(NOT coordinator AS INT)) AS BIGINT) AS from_peers, CAST(sum(CAST(coordinator AS INT)) AS BIGINT) AS from_coordinator, CAST(sum(CAST(acted AS INT)) AS BIGINT) AS acted, CAST(sum(CAST(replied AS INT)) AS BIGINT) AS replied,
CAST(sum(CAST(retraction AS INT)) AS BIGINT) AS retractions, count(DISTINCT sender) AS senders, (SELECT count(*) FROM sent) AS message_out_calls, (SELECT CAST(sum(CAST(coalesce(failed, FALSE) AS INT)) AS BIGINT) FROM sent) AS message_out_failed FROM handled""")
def peer_summary(spark, sf):
    """All messages in one row."""
    events = _peers(spark, sf)
    return sessions.peer_summary(sessions.message_outcomes(events), events)


_SECS = "CAST(epoch(CAST(replace(substr(ts, 1, 19), 'T', ' ') AS TIMESTAMP)) AS BIGINT)"
_FACTS = (
    _P
    + f""",
edits AS (SELECT session_id, CASE WHEN contains(path, '/worktrees/') THEN regexp_replace(path, '^(.*?)/worktrees/[^/]*/(.*)$', '\\1//\\2') ELSE path END AS key, min(t) AS lo, max(t) AS hi FROM (SELECT session_id, json_extract_string(input, '$.file_path') AS path, {_SECS} AS t FROM m WHERE tool_name = 'Edit') GROUP BY ALL),
branches AS (SELECT session_id, split_part(cwd, '/worktrees/', 1) AS repo, branch, min({_SECS}) AS lo, max({_SECS}) AS hi FROM m WHERE branch <> 'main' GROUP BY ALL),
titles AS (SELECT session_id, 'pr' AS kind, regexp_extract(input, '--title ''([^'']*)''', 1) AS title, {_SECS} AS t FROM m WHERE contains(input, 'gh pr create'))"""
)


@query(f"WITH RECURSIVE {_FACTS} SELECT a.session_id AS a, b.session_id AS b, split_part(a.key, '//', 1) AS repo, count(*) AS files, min(least(a.lo, b.lo)) AS lo, max(greatest(a.hi, b.hi)) AS hi FROM edits a JOIN edits b ON a.key = b.key AND a.session_id < b.session_id AND a.lo <= b.hi + 1800 AND b.lo <= a.hi + 1800 GROUP BY ALL")
def sessions_on_one_file(spark, sf):
    """Sessions that edited the same files, by repository."""
    return sessions.shared_files(sessions.edit_times(_peers(spark, sf), MARKER))


@query(f"WITH RECURSIVE {_FACTS} SELECT a.session_id AS a, b.session_id AS b, a.repo, a.branch, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM branches a JOIN branches b ON a.repo = b.repo AND a.branch = b.branch AND a.session_id < b.session_id AND a.lo <= b.hi AND b.lo <= a.hi")
def sessions_on_one_branch(spark, sf):
    """Sessions that were on one branch at the same time."""
    return sessions.shared_branches(sessions.branch_times(_peers(spark, sf), MARKER))


@query(f"WITH RECURSIVE {_FACTS} SELECT * FROM titles")
def created_titles(spark, sf):
    """Titles of the requests that sessions opened by command."""
    return sessions.created_titles(_peers(spark, sf))


# ---------------------------------------------------------------- functions over the tables' texts


@query(r"""SELECT page_id, regexp_replace(url, '^(.*?)/([a-z]{2})/', '\1//') AS key, split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS tree, CAST(floor(epoch(TIMESTAMP '2024-01-01' + INTERVAL (page_id) HOUR)) AS BIGINT) AS secs,
strftime(TIMESTAMP '2024-01-01' + INTERVAL (page_id) HOUR, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS iso, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder FROM pages""")
def path_and_time_functions(spark, sf):
    """Path and time functions over the pages."""
    from ..sources.bindings import table

    p = table(spark, sf, "pages")
    secs = F.lit(1704067200) + F.col("page_id") * 3600
    iso = text.iso_time(secs)
    key = F.regexp_replace("url", "^(.*?)/([a-z]{2})/", "$1/trees/$2/")
    return p.select(
        "page_id", text.repo_key(key, "/trees/").alias("key"), text.module_tree(F.regexp_replace("url", "^https?://", "")).alias("tree"), text.iso_seconds(iso).alias("secs"), iso.alias("iso"), text.folder_of(F.col("url")).alias("folder"),
    )


@query("""SELECT doc_id, CASE WHEN length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) <= 400 THEN trim(text, ' ' || chr(10) || chr(9) || chr(13)) ELSE substr(trim(text, ' ' || chr(10) || chr(9) || chr(13)), 1, 400) || '… [' || length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) || ' chars]' END AS short,
CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, CAST(floor(keep * 2 / 5) AS INT)) || marker || right(text, CAST(keep - floor(keep * 2 / 5) AS INT)) END AS middle
FROM (SELECT *, greatest(0, 300 - length(marker)) AS keep FROM (SELECT doc_id, text, chr(10) || '...[' || (length(text) - 300) || ' characters trimmed to fit the context]...' || chr(10) AS marker FROM documents))""")
def shortened_texts(spark, sf):
    """Texts cut at their end and in their middle."""
    from ..sources.bindings import table

    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", text.truncated(t, 400).alias("short"), text.middle_trimmed(t, 300).alias("middle"))


@query("SELECT conv_id, turn, round(len(text) / 7.0, 6) AS x, CASE WHEN d < 1 THEN CASE WHEN h < 1 THEN 'under an hour' ELSE regexp_replace(printf('%.1f', round(h * 10) / 10), '[.]0$', '') || ' hours' END ELSE regexp_replace(printf('%.1f', round(d * 10) / 10), '[.]0$', '') || ' day' || CASE WHEN round(d * 10) / 10 = 1 THEN '' ELSE 's' END END AS span FROM (SELECT conv_id, turn, text, len(text) / 97.0 AS d, len(text) * 24 / 97.0 AS h FROM conversations)")
def number_words(spark, sf):
    """Numbers of days in words."""
    from ..sources.bindings import table

    n = F.length("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", r6(n / 7.0).alias("x"), text.span_words(n / 97.0).alias("span"))


# ---------------------------------------------------------------- runs

_RUNS = (
    _P
    + f""",
fr AS (SELECT file, tool_id, arg_min(is_error, i) AS err, arg_min(text, i) AS said FROM m WHERE kind = 'tool_result' GROUP BY ALL),
x AS (SELECT c.file, c.i, input, {_SECS} AS t, said FROM m c JOIN fr USING (file, tool_id) WHERE c.kind = 'tool_use' AND NOT err),
steps AS (SELECT file, i, 0 AS ord, 'commit' AS kind, t, input, said FROM x WHERE contains(input, 'git commit') UNION ALL SELECT file, i, 1, 'push', t, input, said FROM x WHERE contains(input, 'git push')
  UNION ALL SELECT file, i, 2, 'request', t, input, said FROM x WHERE contains(input, 'gh pr create')),
fc AS (SELECT file, min(i * 10 + ord) AS c FROM steps WHERE kind = 'commit' GROUP BY file),
pp AS (SELECT s.*, i * 10 + ord AS pos, c, min(CASE WHEN kind = 'push' AND i * 10 + ord >= c THEN i * 10 + ord END) OVER (PARTITION BY file) AS p, max(CASE WHEN kind = 'push' THEN i * 10 + ord END) OVER (PARTITION BY file) AS last FROM steps s LEFT JOIN fc USING (file)),
per AS (SELECT file, count(*) FILTER (WHERE kind = 'commit') AS commits, count(*) FILTER (WHERE kind = 'commit' AND (p IS NULL OR pos < p)) AS before_push, count(*) FILTER (WHERE kind = 'commit' AND (last IS NULL OR pos > last)) AS unpushed,
  count(*) FILTER (WHERE kind = 'push' AND pos >= c) AS pushes, count(*) FILTER (WHERE kind = 'request' AND pos >= c) AS requests, arg_min(t, pos) FILTER (WHERE kind = 'commit') AS ct, arg_min(t, pos) FILTER (WHERE kind = 'push' AND pos >= c) AS pt,
  arg_min(t, pos) FILTER (WHERE kind = 'request' AND pos >= c) AS rt FROM pp GROUP BY file),
tg AS (SELECT DISTINCT file, CASE WHEN contains(said, ' -> fix') THEN 'team/app' ELSE '' END AS repo, 'fix' || CASE WHEN contains(said, ' -> fix') THEN regexp_extract(said, ' -> fix([0-9])', 1) ELSE regexp_extract(input, 'origin fix([0-9])', 1) END AS branch FROM steps WHERE kind = 'push'),
tgs AS (SELECT DISTINCT file, CASE WHEN repo = '' AND bool_or(repo <> '') OVER (PARTITION BY file) THEN 'team/app' ELSE repo END AS repo, branch FROM tg),
ends AS (SELECT file, arg_max({_SECS}, i) AS end_t, count(*) AS events, any_value(session_id) AS session_id FROM m GROUP BY file),
known AS (SELECT DISTINCT file FROM tgs JOIN ends USING (file) JOIN (VALUES ('team/app', 'fix0', 1704500000), ('team/app', 'fix1', 1706000000)) AS q(repo, branch, created) ON q.repo = tgs.repo AND q.branch = tgs.branch WHERE created <= end_t),
briefs AS (SELECT file, CASE WHEN NOT any_value(helper) OR arg_min(t, line) = 'error' THEN 'none' ELSE 'silent' END AS brief FROM l WHERE t IN ('signup', 'error') GROUP BY file),
run AS (SELECT file, session_id, contains(file, '/subagents/') AS subagent, events, coalesce(commits, 0) AS commits, coalesce(before_push, 0) AS commits_before_first_push, coalesce(unpushed, 0) AS unpushed_at_end, coalesce(pushes, 0) AS pushes, coalesce(requests, 0) AS requests,
  greatest(0, pt - ct) AS commit_to_push, greatest(0, rt - pt) AS push_to_request, greatest(0, end_t - ct) AS commit_to_end, greatest(0, end_t - pt) AS push_to_end, (SELECT count(*) FROM tgs WHERE tgs.file = ends.file) AS branches, coalesce(brief, 'none') AS brief,
  CASE WHEN coalesce(commits, 0) = 0 THEN 'no_commits' WHEN requests > 0 THEN 'pr_opened' WHEN file IN (SELECT file FROM known) THEN 'pr_existing' WHEN pushes > 0 THEN 'pushed_no_pr' ELSE 'never_pushed' END AS outcome FROM ends LEFT JOIN per USING (file) LEFT JOIN briefs USING (file))"""
)
# A difference with a missing end is missing.
_RUNS = _RUNS.replace("greatest(0, pt - ct)", "CASE WHEN pt - ct IS NOT NULL THEN greatest(0, pt - ct) END").replace("greatest(0, rt - pt)", "CASE WHEN rt - pt IS NOT NULL THEN greatest(0, rt - pt) END")
_RUNS = _RUNS.replace("greatest(0, end_t - ct)", "CASE WHEN ct IS NOT NULL THEN greatest(0, end_t - ct) END").replace("greatest(0, end_t - pt)", "CASE WHEN pt IS NOT NULL THEN greatest(0, end_t - pt) END")


def _run_rows(spark, sf):
    lines = _lines(spark, sf)
    requests = spark.createDataFrame([("team/app", "fix0", 1704500000), ("team/app", "fix1", 1706000000)], "repo string, branch string, created long")
    return kept(spark, lambda: runs.runs(_peers(spark, sf), transcripts.first_prompts(lines), requests), "runs", sf)


@query(f"WITH RECURSIVE {_RUNS} SELECT * FROM run")
def session_runs(spark, sf):
    """How each transcript's commits reached a push and a request."""
    r = _run_rows(spark, sf)
    return r.withColumn("branches", F.size("pushed").cast("long")).drop("pushed")


@query(f"""WITH RECURSIVE {_RUNS} SELECT file, unnest(list_filter([CASE WHEN outcome IN ('never_pushed', 'pushed_no_pr') THEN outcome END, CASE WHEN commit_to_push > 600 THEN 'slow_push' END, CASE WHEN push_to_request > 600 THEN 'slow_pr' END], lambda x: x IS NOT NULL)) AS signal FROM run""")
def run_signals(spark, sf):
    """Signals of runs that did not end with a request, or late."""
    return runs.run_signals(_run_rows(spark, sf))


_Q = "coalesce(list_sort(list({c}) FILTER (WHERE commits > 0 AND {c} IS NOT NULL))[1 + CAST(round((count({c}) FILTER (WHERE commits > 0) - 1) * {p}) AS INT)], 0)"


@query(f"""WITH RECURSIVE {_RUNS}, pops AS (SELECT 'all' AS population, * FROM run UNION ALL SELECT CASE WHEN subagent THEN 'subagents' ELSE 'main' END, * FROM run)
SELECT population, count(*) AS runs, count(*) FILTER (WHERE commits > 0) AS active, {", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in ("pr_opened", "pr_existing", "pushed_default", "pushed_no_pr", "never_pushed"))},
count(*) FILTER (WHERE commits > 0 AND outcome IN ('pushed_no_pr', 'never_pushed')) AS gaps, count(*) FILTER (WHERE commits > 0 AND unpushed_at_end > 0) AS unpushed,
{", ".join(f"{_Q.format(c=c, p=p)} AS {n}_{s}" for c, n in (("commit_to_push", "push"), ("push_to_request", "request")) for p, s in ((0.5, "p50"), (0.9, "p90"), (1.0, "max")))} FROM pops GROUP BY population""")
def run_population(spark, sf):
    """Counts and latencies of all runs, main sessions and helpers."""
    return runs.population(_run_rows(spark, sf))


@query(f"WITH RECURSIVE {_RUNS} SELECT brief, count(*) AS runs, count(*) FILTER (WHERE outcome IN ('pushed_no_pr', 'never_pushed')) AS gaps FROM run WHERE subagent AND commits > 0 GROUP BY brief")
def gaps_by_brief(spark, sf):
    """Helpers' runs without a request by what their brief says."""
    return runs.gaps_by_brief(_run_rows(spark, sf))


_RULES = (
    _RUNS
    + """,
fired AS (SELECT minutes, outcome IN ('pushed_no_pr', 'never_pushed') AS gap, CASE WHEN commit_to_push IS NOT NULL THEN commit_to_push > minutes * 60 ELSE coalesce(commit_to_end, 0) >= minutes * 60 END
  OR CASE WHEN outcome = 'pr_existing' THEN FALSE WHEN push_to_request IS NOT NULL THEN push_to_request > minutes * 60 WHEN push_to_end IS NOT NULL THEN push_to_end >= minutes * 60 ELSE FALSE END AS fires FROM run, (SELECT unnest([2, 5, 10, 15, 30, 60]) AS minutes) WHERE commits > 0),
score AS (SELECT CAST(minutes AS BIGINT) AS minutes, count(*) FILTER (WHERE fires) AS fires, count(*) FILTER (WHERE fires AND gap) AS caught, count(*) FILTER (WHERE fires AND NOT gap) AS nags, count(*) FILTER (WHERE NOT fires AND gap) AS missed,
  count(*) FILTER (WHERE fires AND gap) - count(*) FILTER (WHERE fires AND NOT gap) AS score FROM fired GROUP BY minutes)"""
)


@query(f"WITH RECURSIVE {_RULES} SELECT * FROM score")
def run_rules(spark, sf):
    """What a rule of each number of minutes would catch, miss and nag about."""
    return runs.rule_scores(_run_rows(spark, sf))


@query(f"WITH RECURSIVE {_RULES} SELECT * FROM score ORDER BY score DESC, caught DESC, minutes DESC LIMIT 1")
def best_run_rule(spark, sf):
    """The best of the rules."""
    return runs.best_rule(runs.rule_scores(_run_rows(spark, sf)))


# ---------------------------------------------------------------- rates

_H = """hx AS (SELECT DISTINCT 's' || user_id AS session, 'a' || user_id AS assignment FROM events WHERE user_id % 4 = 1 UNION ALL SELECT 's100000', 'a100000'),
hc AS (SELECT 's' || user_id AS session, strftime(ts, '%Y-%m-%dT%H') AS hour, count(*) AS calls FROM events WHERE user_id % 4 = 1 AND event_type = 'purchase' GROUP BY ALL)"""
_ATTR = (
    _MARKS
    + f""",
{_H},
tc AS (SELECT session, sum(calls) AS n FROM calls GROUP BY session), hn AS (SELECT session, sum(calls) AS n FROM hc GROUP BY session),
att AS (SELECT coalesce(f.session, hx.session) AS session, CASE WHEN hx.session IS NOT NULL THEN 'csf_harness' WHEN hook_timeouts + guard_rejections + host_hook_callbacks > 0 THEN 'desktop_hosted' ELSE 'cli' END AS host,
  CASE WHEN hx.session IS NOT NULL THEN 'csf_harness' ELSE 'transcript' END AS denominator, CAST(coalesce(tc.n, 0) AS BIGINT) AS transcript_calls, CASE WHEN hx.session IS NOT NULL THEN CAST(coalesce(hn.n, 0) AS BIGINT) END AS harness_calls,
  coalesce(hook_timeouts, 0) AS hook_timeouts, coalesce(guard_rejections, 0) AS guard_rejections, coalesce(host_hook_callbacks, 0) AS host_hook_callbacks, assignment
  FROM facts f FULL JOIN hx ON hx.session = f.session LEFT JOIN tc ON tc.session = f.session LEFT JOIN hn ON hn.session = hx.session),
hrs AS (SELECT * FROM calls WHERE session NOT IN (SELECT session FROM hx) UNION ALL SELECT * FROM hc)"""
)


def _harness(spark, sf):
    from ..sources.bindings import table

    e = table(spark, sf, "events").where("user_id % 4 = 1").withColumn("session", F.concat(F.lit("s"), "user_id"))
    h = e.select("session", F.concat(F.lit("a"), "user_id").alias("assignment")).distinct().unionByName(spark.sql("SELECT 's100000' AS session, 'a100000' AS assignment"))
    return h, e.where("event_type = 'purchase'").groupBy("session", F.date_format("ts", "yyyy-MM-dd'T'HH").alias("hour")).agg(F.count("*").alias("calls"))


def _attributed(spark, sf):
    calls, marks = _session_facts(spark, sf)
    harness, harness_calls = _harness(spark, sf)
    sessions_, hours = measure.attributed(calls, marks, harness_calls, harness)
    return kept(spark, lambda: sessions_, "attributed", sf), kept(spark, lambda: hours, "hours", sf)


@query(f"WITH {_ATTR} SELECT * FROM att")
def attributed_sessions(spark, sf):
    """Sessions of transcripts and harness records joined, with their host."""
    return _attributed(spark, sf)[0]


_LABELS = (
    _EPISODES
    + """,
ep AS (SELECT file || '#' || start_event AS id, session_id AS session, start, (start_event * 7 + span_events) % 6 AS v, start_event % 3 <> 0 AS fx FROM shown),
lab AS (SELECT id, session, CAST((CAST(replace(substr(start, 1, 19), 'T', ' ') AS TIMESTAMP) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) AS day, CASE WHEN v = 0 THEN NULL WHEN v = 1 THEN 'noise' ELSE 'p' || v END AS pattern, v NOT IN (0, 5) AS canonical, v <> 0 AND fx AS fixable, v > 1 AND fx AS struggle FROM ep)"""
)


def _labelled(spark, sf):
    e = _episodes(spark, sf).select(F.concat_ws("#", "file", "start_event").alias("id"), F.col("session_id").alias("session"), "start", ((F.col("start_event") * 7 + F.col("span_events")) % 6).alias("v"), (F.col("start_event") % 3 != 0).alias("fixable"))
    labels = e.where("v <> 0").select("id", F.when(F.col("v") == 1, "noise").otherwise(F.concat(F.lit("p"), "v")).alias("pattern"), (F.col("v") != 5).alias("canonical"), "fixable")
    return kept(spark, lambda: measure.labelled(e.select("id", "session", "start"), labels), "labelled", sf)


@query(f"WITH {_LABELS} SELECT * FROM lab")
def labelled_episodes(spark, sf):
    """Episodes with their labels, the day and whether they count as struggles."""
    return _labelled(spark, sf)


def _with(*parts: str) -> str:
    """One list of common tables from several that begin alike."""
    seen, out = set(), []
    for part in parts:
        for line in re.split(r",\n(?=[a-z_0-9]+ AS \()", part):
            name = line.split(" AS (")[0].strip()
            if name not in seen:
                seen.add(name)
                out.append(line)
    return ",\n".join(out)


_DAYS = _with(_ATTR, _LABELS) + """,
act AS (SELECT CAST((CAST(replace(hour, 'T', ' ') || ':00:00' AS TIMESTAMP) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) AS day, host, session, calls, 0 AS ep, 0 AS lb, 0 AS noise, 0 AS st FROM hrs JOIN att USING (session)
  UNION ALL SELECT day, coalesce(host, 'cli'), session, 0, 1, CAST(pattern IS NOT NULL AS INT), CAST(coalesce(pattern = 'noise', FALSE) AS INT), CAST(struggle AS INT) FROM lab LEFT JOIN att USING (session))"""
_K1 = "1000 * (CASE WHEN struggles > 0 THEN " + _CHI.format(df="(2.0 * struggles)", z=-stats.Z95) + " / 2 ELSE 0.0 END) / tool_calls"
_K2 = "1000 * (" + _CHI.format(df="(2.0 * struggles + 2)", z=stats.Z95) + " / 2) / tool_calls"
_RATED = f"CASE WHEN tool_calls > 0 THEN round(1000.0 * struggles / tool_calls, 3) END AS rate, CASE WHEN tool_calls > 0 THEN round({_K1}, 3) END AS low, CASE WHEN tool_calls > 0 THEN round({_K2}, 3) END AS high"


def _daily(spark, sf):
    sessions_, hours = _attributed(spark, sf)
    eps = _labelled(spark, sf)
    return measure.daily(sessions_, hours, eps, F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")), sessions_, hours, eps


@query(f"""WITH {_DAYS}, d AS (SELECT day, count(DISTINCT session) AS sessions, CAST(sum(calls) AS BIGINT) AS tool_calls, CAST(sum(ep) AS BIGINT) AS episodes, CAST(sum(lb) AS BIGINT) AS labelled, CAST(sum(noise) AS BIGINT) AS noise, CAST(sum(st) AS BIGINT) AS struggles FROM act GROUP BY day)
SELECT *, {_RATED}, ((CAST(day + 1 AS TIMESTAMP) AT TIME ZONE 'America/Los_Angeles') AT TIME ZONE 'UTC') <= TIMESTAMP '2024-01-20 12:00:00' AS closed FROM d""")
def struggle_days(spark, sf):
    """The record of each day: calls, episodes, labels, struggles, their rate and whether the day is over."""
    return _daily(spark, sf)[0]


@query(f"""WITH {_DAYS}, d AS (SELECT day, host, count(DISTINCT session) AS sessions, CAST(sum(calls) AS BIGINT) AS tool_calls, CAST(sum(st) AS BIGINT) AS struggles FROM act GROUP BY ALL HAVING sum(calls) > 0 OR sum(st) > 0) SELECT *, {_RATED} FROM d""")
def struggle_day_hosts(spark, sf):
    """The slices of each day by host."""
    sessions_, hours = _attributed(spark, sf)
    return measure.daily_hosts(sessions_, hours, _labelled(spark, sf))


@query(f"""WITH {_DAYS} SELECT day, pattern, canonical, coalesce(host, 'cli') AS host, count(*) AS episodes, CAST(sum(CAST(fixable AS INT)) AS BIGINT) AS fixable FROM lab LEFT JOIN att USING (session) WHERE pattern <> 'noise' GROUP BY ALL""")
def struggle_day_patterns(spark, sf):
    """Labelled episodes of each day by pattern and host."""
    return measure.daily_patterns(_attributed(spark, sf)[0], _labelled(spark, sf))


@query("""WITH raw AS (SELECT doc_id AS id, CASE doc_id % 7 WHEN 0 THEN 'noise' WHEN 1 THEN lang WHEN 2 THEN 'english' ELSE 'slug_' || (doc_id % 5) END AS raw FROM documents),
al AS (SELECT * FROM (VALUES ('en', 'english'), ('fr', 'french'), ('slug_1', 'french')) AS a(alias, id)),
lab AS (SELECT raw.id, raw, coalesce(al.id, raw) AS pattern, al.id IS NOT NULL OR raw IN ('english', 'french') AS canonical FROM raw LEFT JOIN al ON al.alias = raw)
SELECT (SELECT count(DISTINCT raw) FROM raw WHERE raw <> 'noise') AS raw_slugs, (SELECT count(DISTINCT raw) FROM raw WHERE raw IN (SELECT alias FROM al)) AS aliases_folded,
(SELECT count(DISTINCT raw) FROM raw WHERE raw <> 'noise' AND raw NOT IN (SELECT alias FROM al) AND raw NOT IN ('english', 'french')) AS uncanonical, count(*) AS labels, count(DISTINCT CASE WHEN canonical AND pattern <> 'noise' THEN pattern END) AS canonical_ids,
CAST(sum(CAST(raw <> pattern AS INT)) AS BIGINT) AS labels_remapped FROM lab""")
def folding_statistics(spark, sf):
    """What folding raw names into a vocabulary changed."""
    from ..operators import joins
    from ..sources.bindings import table

    d = table(spark, sf, "documents")
    m = F.col("doc_id") % 7
    raw = d.select(F.col("doc_id").alias("id"), F.when(m == 0, "noise").when(m == 1, F.col("lang")).when(m == 2, "english").otherwise(F.concat(F.lit("slug_"), F.col("doc_id") % 5)).alias("raw"))
    aliases = spark.createDataFrame([("en", "english"), ("fr", "french"), ("slug_1", "french")], "alias string, id string")
    labels = joins.folded(raw.withColumnRenamed("id", "label"), aliases).withColumnRenamed("label", "id")
    return measure.folding(raw, labels.select("id", "pattern", "canonical"), aliases)


@query(f"""WITH {_DAYS}, d AS (SELECT day, CAST(sum(calls) AS BIGINT) AS tool_calls, CAST(sum(st) AS BIGINT) AS struggles FROM act GROUP BY day),
w AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week, CAST(sum(tool_calls) AS BIGINT) AS tool_calls, CAST(sum(struggles) AS BIGINT) AS struggles, bool_or(((CAST(day + 1 AS TIMESTAMP) AT TIME ZONE 'America/Los_Angeles') AT TIME ZONE 'UTC') > TIMESTAMP '2024-01-20 12:00:00') AS open FROM d GROUP BY 1),
ws AS (SELECT CAST(date_trunc('week', CAST((CAST(replace(hour, 'T', ' ') || ':00:00' AS TIMESTAMP) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE)) AS DATE) AS week, count(DISTINCT session) AS sessions FROM hrs GROUP BY 1)
SELECT week, tool_calls, struggles, open, coalesce(sessions, 0) AS sessions, {_RATED} FROM w LEFT JOIN ws USING (week)""")
def struggle_weeks(spark, sf):
    """The record of each week, open while one of its days is."""
    days, _, hours, _ = _daily(spark, sf)
    return measure.weekly(days, hours)


@query(f"""WITH {_DAYS}, d AS (SELECT day, host, CAST(sum(calls) AS BIGINT) AS tool_calls, CAST(sum(st) AS BIGINT) AS struggles FROM act GROUP BY ALL HAVING sum(calls) > 0 OR sum(st) > 0),
a AS (SELECT day, CAST(sum(calls) AS BIGINT) AS tool_calls, CAST(sum(st) AS BIGINT) AS struggles FROM act GROUP BY day)
SELECT 'rate' AS series, day, 'all' AS host, NULL AS pattern, CASE WHEN tool_calls > 0 THEN round(1000.0 * struggles / tool_calls, 3) END AS value, tool_calls, struggles FROM a
UNION ALL SELECT 'rate', day, host, NULL, CASE WHEN tool_calls > 0 THEN round(1000.0 * struggles / tool_calls, 3) END, tool_calls, struggles FROM d
UNION ALL SELECT 'episodes', day, coalesce(host, 'cli'), pattern, CAST(count(*) AS DOUBLE), NULL, NULL FROM lab LEFT JOIN att USING (session) WHERE pattern <> 'noise' AND canonical GROUP BY ALL""")
def struggle_series(spark, sf):
    """The long form of the records: rates by host, episodes by pattern and host."""
    days, sessions_, hours, eps = _daily(spark, sf)
    return measure.series(days, measure.daily_hosts(sessions_, hours, eps), measure.daily_patterns(sessions_, eps))


@query()
def struggle_records(spark, sf):
    """The days with their hosts, patterns and uncanonical names nested in them."""
    days, sessions_, hours, eps = _daily(spark, sf)
    return measure.daily_records(days, measure.daily_hosts(sessions_, hours, eps), measure.daily_patterns(sessions_, eps))
