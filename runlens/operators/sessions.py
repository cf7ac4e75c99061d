"""Detectors, episodes and facts over the two event streams of session transcripts.

All take events as ``sources.transcripts`` gives them: rows (file, i, ts, session_id, kind, ...), numbered within their file. A detector
looks at one file alone, so all of them share the shuffle by file; look-backs are windows over a bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import events as ev
from . import phrases

# Look-backs, repeats and likenesses of the retry and polling rules.
RETRY_BACK, RETRY_LIKENESS = 4, 0.85
POLL_BACK, POLL_REPEATS, POLL_LIKENESS = 12, 3, 0.8
# Kinds after which a push-back is one, and kinds that say nothing about it.
ACTED, UNSAID = ("tool_use", "tool_result", "assistant", "interrupt"), ("silence_reminder", "hook_no_response")


def _in_file() -> Window:
    return Window.partitionBy("file").orderBy("i")


def _alike(a: Column, b: Column, least: float) -> Column:
    return (a == b) | (text.jaccard(text.trigrams(a), text.trigrams(b)) >= least)


def _first_result() -> Column:
    """The first result in the file that names a row's call: (i, is_error, text)."""
    return F.min(F.when(F.col("kind") == "tool_result", F.struct("i", "is_error", "text"))).over(Window.partitionBy("file", "tool_id"))


def _same_kind() -> Window:
    return Window.partitionBy("file", "kind").orderBy("i")


def struggle_marks(events: DataFrame, acronyms: list[str] = text.ACRONYMS) -> DataFrame:
    """Events with the struggle ``signals`` that hit them, in one pass over a file's rows.

    A retry repeats one of the last four calls of the same tool with nearly the same input, the latest such, if that call's first result
    was an error or told of a failed test. A re-ask repeats one of the last ten human turns after the agent said or did something. A
    push-back counts right after the agent acted, reminders aside.
    """
    said, result = F.coalesce("text", F.lit("")), F.col("kind") == "tool_result"
    before = F.last(F.when(~F.col("kind").isin(*UNSAID), F.col("kind")), ignorenulls=True).over(_in_file().rowsBetween(Window.unboundedPreceding, -1))
    answers = F.sum(F.col("kind").isin("assistant", "tool_use").cast("int")).over(_in_file())
    r = F.col("result")
    failed = F.coalesce(r["is_error"] | phrases.test_failure(r["text"]), F.lit(False))
    e = events.withColumns({"after": before, "answers": answers, "result": F.when(F.col("kind") == "tool_use", _first_result())})
    e = e.withColumns({"call": F.struct("tool_name", "input", failed.alias("failed")), "cw": F.when(F.col("kind") == "human", text.content_words(said))})
    calls = [F.lag("call", n).over(_same_kind()) for n in range(1, RETRY_BACK + 1)]
    turns = F.collect_list(F.struct("answers", F.coalesce("cw", F.array().cast("array<string>")).alias("cw"))).over(_same_kind().rowsBetween(-10, -1))
    e = e.withColumns({"calls": F.when(F.col("kind") == "tool_use", F.array(*calls)), "turns": F.when(F.col("kind") == "human", turns)})
    similar = F.filter("calls", lambda c: (c["tool_name"] == F.col("tool_name")) & _alike(c["input"], F.col("input"), RETRY_LIKENESS))
    again = lambda t: (F.size(t["cw"]) >= 4) & (t["answers"] < F.col("answers")) & (text.jaccard(t["cw"], F.col("cw")) >= 0.6)
    kind = phrases.result_class(said, F.coalesce("is_error", F.lit(False)), F.col("denial"))
    signals = F.array_compact(
        F.array(
            F.when(result, kind), F.when(F.col("kind") == "hook_no_response", "hook_timeout"), F.when(F.col("kind") == "interrupt", "user_interrupt"),
            F.when(F.col("kind") == "silence_reminder", "silence"), F.when(result & phrases.test_failure(said), "test_failure"),
            F.when((F.col("kind") == "human") & F.col("after").isin(*ACTED) & text.correction(said, acronyms), "user_correction"),
            F.when(F.try_element_at(similar, F.lit(1))["failed"], "retry"),
            F.when((F.size("cw") >= 4) & F.exists("turns", again), "reask"),
        )
    )
    return e.select(*events.columns, signals.alias("signals"))


def signals(marked: DataFrame) -> DataFrame:
    """(file, i, signal) of marked events."""
    return marked.select("file", "i", F.explode("signals").alias("signal"))


def episodes(marked: DataFrame, gap: int = ev.GAP, turn_chars: int = 800) -> DataFrame:
    """One row for each run of marked events at most ``gap`` apart, of all signals together.

    (file, session_id, agent_id, subagent, episode, start, end, start_event, end_event, hits, signals map, user_turn, span_events,
    tool_calls, tool_errors, human_turns, session_events). The turn is the last human one at or before the start, empty without one.
    Everything is a window or a sum within a file: its rows are shuffled once.
    """
    w, hit = _in_file(), F.size("signals") > 0
    last = F.last(F.when(hit, F.col("i")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    turn = F.last(F.when(F.col("kind") == "human", F.col("text")), ignorenulls=True).over(w)
    e = marked.withColumns({"hit": hit, "new": (hit & (F.col("i") - F.coalesce(last, F.lit(-1 - gap)) > gap)).cast("long"), "turn": turn, "session_events": F.count("*").over(Window.partitionBy("file"))})
    e = e.withColumn("episode", F.sum("new").over(w) - 1).where("episode >= 0")
    e = e.withColumn("stop", F.max(F.when(F.col("hit"), F.col("i"))).over(Window.partitionBy("file", "episode"))).where("i <= stop")
    n = lambda c: F.sum(c.cast("long"))
    out = e.groupBy("file", "episode").agg(
        F.first("session_id").alias("session_id"), F.first("agent_id").alias("agent_id"), F.min_by("ts", "i").alias("start"), F.max_by("ts", "i").alias("end"),
        F.min("i").alias("start_event"), F.max("i").alias("end_event"), F.flatten(F.collect_list("signals")).alias("all"),
        text.truncated(F.coalesce(F.min_by("turn", "i"), F.lit("")), turn_chars).alias("user_turn"), F.count("*").alias("span_events"), n(F.col("kind") == "tool_use").alias("tool_calls"),
        n((F.col("kind") == "tool_result") & F.coalesce("is_error", F.lit(False))).alias("tool_errors"), n(F.col("kind") == "human").alias("human_turns"), F.first("session_events").alias("session_events"),
    )
    counted = F.map_from_entries(F.transform(F.array_sort(F.array_distinct("all")), lambda s: F.struct(s, F.size(F.filter("all", lambda x: x == s)))))
    out = out.withColumns({"hits": F.size("all").cast("long"), "signals": counted, "subagent": F.contains("file", F.lit("/subagents/"))})
    return out.drop("all")


def signal_summary(episode_rows: DataFrame) -> DataFrame:
    """(signal, episodes, hits, sessions): episodes count once a signal, hits as often as they are."""
    e = episode_rows.select("session_id", F.explode("signals").alias("signal", "n"))
    return e.groupBy("signal").agg(F.count("*").alias("episodes"), F.sum(F.col("n").cast("long")).alias("hits"), F.count_distinct("session_id").alias("sessions"))


def session_of(file: Column) -> Column:
    """The session that a file belongs to: a helper's file below a session counts for that session."""
    parts = F.split(file, "/")
    return F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.element_at(parts, 1)), r"\.jsonl$", "")


def tool_calls_by_hour(events: DataFrame) -> DataFrame:
    """(file, hour, calls): calls by the first 13 characters of their time; shorter times do not count."""
    calls = events.where((F.col("kind") == "tool_use") & (F.length("ts") >= 13))
    return calls.groupBy("file", F.substring("ts", 1, 13).alias("hour")).agg(F.count("*").alias("calls"))


def host_markers(events: DataFrame) -> DataFrame:
    """(file, hook_timeouts, guard_rejections) of all files: error results whose first line is the host's, and its own notes.

    A first line that names both counts as a timeout. A successful result that quotes a host counts as nothing.
    """
    head = F.regexp_extract(F.coalesce("text", F.lit("")), r"^\s*([^\n]*)", 1)
    failed = (F.col("kind") == "tool_result") & F.coalesce("is_error", F.lit(False))
    timeout = (failed & phrases.any_of(head, phrases.HOOK_TIMEOUT)) | (F.col("kind") == "hook_no_response")
    guard = failed & ~phrases.any_of(head, phrases.HOOK_TIMEOUT) & phrases.any_of(head, phrases.GUARD)
    n = lambda c: F.sum(c.cast("long"))
    return events.groupBy("file").agg(n(timeout).alias("hook_timeouts"), n(guard).alias("guard_rejections"))


def transcript_sessions(events: DataFrame, hooks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session, hour, calls) and (session, hook_timeouts, guard_rejections, host_hook_callbacks), helpers' files folded in."""
    calls = tool_calls_by_hour(events).groupBy(session_of(F.col("file")).alias("session"), "hour").agg(F.sum("calls").alias("calls"))
    m = host_markers(events).join(hooks, "file", "full_outer").na.fill(0)
    marks = [F.sum(c).alias(c) for c in ("hook_timeouts", "guard_rejections", "host_hook_callbacks")]
    return calls, m.groupBy(session_of(F.col("file")).alias("session")).agg(*marks)


# ---------------------------------------------------------------- coordination


def command_of(rows_input: Column, name: Column) -> Column:
    """The command of a shell call, null for other calls."""
    return F.when(name == "Bash", F.get_json_object(rows_input, "$.command"))


def message_out(name: Column) -> Column:
    return (name == "SendMessage") | name.endswith("send_message")


def coordination_marks(events: DataFrame, lists: dict[str, list[str]] = phrases.PHRASES, back: int = POLL_BACK, repeats: int = POLL_REPEATS) -> DataFrame:
    """Events with the coordination ``signals`` that hit them and that one file can show, in one pass over its rows.

    Churn is the second and later retraction of a sender. Polling is a status check that was run ``repeats`` times, nearly alike, within
    ``back`` calls and with no message sent between.
    """
    said, low = F.coalesce("text", F.lit("")), F.lower(F.coalesce("text", F.lit("")))
    spoken, incoming, result, call = F.col("kind").isin("human", "assistant"), F.col("kind").isin("peer", "coordinator"), F.col("kind") == "tool_result", F.col("kind") == "tool_use"
    command = command_of(F.col("input"), F.col("tool_name"))
    has = lambda name: phrases.any_of(low, lists[name])
    back_ = incoming & has("peer_retraction")
    e = events.withColumns({"command": command, "out": call & message_out(F.col("tool_name")), "withdrawn": back_})
    e = e.withColumn("status", F.when(call & phrases.any_of(F.col("command"), phrases.STATUS_CHECKS), F.col("command")))
    e = e.withColumns({
        "nth": F.sum(F.col("withdrawn").cast("int")).over(Window.partitionBy("file", "sender").orderBy("i")),
        "before": F.when(F.col("status").isNotNull(), F.reverse(F.collect_list(F.struct("status", "out")).over(_same_kind().rowsBetween(-back, -1)))),
    })
    stop = F.array_position(F.transform("before", lambda b: b["out"]), True).cast("int")
    near = F.when(stop > 0, F.slice("before", F.lit(1), stop - 1)).otherwise(F.col("before"))
    seen = F.size(F.filter(near, lambda b: b["status"].isNotNull() & _alike(b["status"], F.col("status"), POLL_LIKENESS)))
    said_low = F.lower("command")
    found = {
        "user_relay": (F.col("kind") == "human") & has("user_relay"), "peer_message": F.col("kind") == "peer", "coordinator_message": F.col("kind") == "coordinator", "peer_retraction": F.col("withdrawn"),
        "peer_churn": F.col("withdrawn") & (F.col("nth") >= 2), "message_out": F.col("out"),
        "vcs_conflict": result & phrases.any_of(said, phrases.VCS_CONFLICT), "worktree_collision": result & phrases.any_of(said, phrases.WORKTREE),
        "already_done": spoken & has("already_done"), "blocked_on_other": (F.col("kind") == "assistant") & has("blocked_on_other"), "ownership_question": spoken & has("ownership_question"),
        "claim": call & phrases.any_of(said_low, phrases.COMMENT_COMMANDS) & phrases.any_of(said_low, phrases.CLAIMS),
        "polling": F.col("status").isNotNull() & (seen + 1 >= repeats),
    }
    return e.select(*events.columns, F.array_compact(F.array(*[F.when(c, n) for n, c in found.items()])).alias("signals"))


def message_outcomes(events: DataFrame, lists: dict[str, list[str]] = phrases.PHRASES) -> DataFrame:
    """(file, i, sender, coordinator, retraction, acted, replied) of every message that came in."""
    turn, out = F.col("kind").isin("human", "peer", "coordinator"), (F.col("kind") == "tool_use") & message_out(F.col("tool_name"))
    o = ev.outcomes(events, "file", F.col("kind").isin("peer", "coordinator"), turn, (F.col("kind") == "tool_use") & ~out, out)
    back = phrases.any_of(F.lower("text"), lists["peer_retraction"])
    return o.select("file", "i", F.col("sender"), (F.col("kind") == "coordinator").alias("coordinator"), back.alias("retraction"), "acted", "replied")


def peer_summary(outcomes: DataFrame, events: DataFrame) -> DataFrame:
    """One row: messages, where from, how handled, and the messages that went out, failed ones apart."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    c = F.col
    came = outcomes.agg(
        F.count("*").alias("messages"), n(~c("coordinator")).alias("from_peers"), n(c("coordinator")).alias("from_coordinator"), n(c("acted")).alias("acted"),
        n(c("replied")).alias("replied"), n(c("retraction")).alias("retractions"), F.count_distinct("sender").alias("senders"),
    )
    sent = events.where(F.col("kind").isin("tool_use", "tool_result")).withColumn("result", _first_result()).where((F.col("kind") == "tool_use") & message_out(F.col("tool_name")))
    went = sent.agg(F.count("*").alias("message_out_calls"), n(F.coalesce("result.is_error", F.lit(False))).alias("message_out_failed"))
    return came.crossJoin(went)  # one row each


# ---------------------------------------------------------------- facts across sessions

# Tools that edit files, and branches that are nobody's own.
EDIT_TOOLS, SHARED_BRANCHES = ("Edit", "Write", "MultiEdit", "NotebookEdit"), ("", "main", "master", "HEAD")


def edit_times(events: DataFrame, marker: str) -> DataFrame:
    """(session_id, key, lo, hi): when a session edited a repository's file, first and last, worktrees folded."""
    path = F.coalesce(F.get_json_object("input", "$.file_path"), F.get_json_object("input", "$.notebook_path"))
    e = events.where((F.col("kind") == "tool_use") & F.col("tool_name").isin(*EDIT_TOOLS) & (F.col("session_id") != ""))
    e = e.select("session_id", text.repo_key(path, marker).alias("key"), text.iso_seconds(F.col("ts")).alias("t")).where("key is not null and t is not null")
    return e.groupBy("session_id", "key").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))


def branch_times(events: DataFrame, marker: str) -> DataFrame:
    """(session_id, repo, branch, lo, hi): when a session was seen on a branch of its own."""
    e = events.where(~F.col("branch").isin(*SHARED_BRANCHES) & (F.col("cwd") != "") & (F.col("session_id") != ""))
    e = e.select("session_id", text.repo_of(F.col("cwd"), marker).alias("repo"), "branch", text.iso_seconds(F.col("ts")).alias("t")).where("t is not null")
    return e.groupBy("session_id", "repo", "branch").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))


def created_titles(events: DataFrame) -> DataFrame:
    """(session_id, kind, title, t) of the requests and issues that a session opened by command."""
    command = command_of(F.col("input"), F.col("tool_name"))
    e = events.where((F.col("kind") == "tool_use") & (F.col("session_id") != "")).withColumn("command", command).where("command is not null")
    kinds = F.array_compact(F.array(*[F.when(F.contains("command", F.lit(f"gh {n} create")), n) for n in ("pr", "issue")]))
    e = e.select("session_id", F.explode(kinds).alias("kind"), text.title_argument(F.col("command")).alias("title"), text.iso_seconds(F.col("ts")).alias("t"))
    return e.where("title is not null and t is not null")


def shared_files(edits: DataFrame, slack: int = 1800) -> DataFrame:
    """(a, b, repo, files, lo, hi) of sessions that edited the same files of a repository within ``slack`` seconds."""
    pairs = ev.overlaps(edits, "key", "session_id", slack, whole=True)
    repo = F.split_part("key", F.lit("//"), F.lit(1))
    return pairs.groupBy("a", "b", repo.alias("repo")).agg(F.count("*").alias("files"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def shared_branches(branches: DataFrame) -> DataFrame:
    """(a, b, repo, branch, lo, hi) of sessions that were on one branch at the same time."""
    keyed = branches.select("session_id", F.struct("repo", "branch").alias("key"), "lo", "hi")
    return ev.overlaps(keyed, "key", "session_id", 0).select("a", "b", "key.repo", "key.branch", "lo", "hi")
