"""Session transcripts: JSON lines with nested content, to one row an event.

A line's content is a text or a list of blocks, and so is a tool result's; both are read as variants, so that a text that looks like a
list stays a text. Lines that are no JSON are skipped. Events are numbered within their file in the order of lines and blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import system_reminders_removed
from ..operators.scan import without_recent_repeats

EVENT = "struct<kind:string,text:string,tool_id:string,tool_name:string,input:string,is_error:boolean,ts:string,sender:string,sender_name:string>"
#: Fixed value: the command by which a host that sits round a session shows in its hooks.
HOST_HOOK = "callback"
#: Fixed value: how a message of a coordinator begins.
COORDINATOR = "The coordinator sent a message while you were working"


def read_lines(spark: SparkSession, folder: str, exclude: tuple[str, ...] = (), since: str | None = None) -> DataFrame:
    """(file, line_no, raw) of all *.jsonl files below a folder; files are filtered by path and change time.

    Files are read line by line in splits of any size; a line's place is its split's offset and its order within it. ``file`` is
    relative to the folder.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(folder)
    meta = F.col("_metadata")
    path = F.url_decode(F.replace(meta["file_path"], F.lit("+"), F.lit("%2B")))
    lines = lines.select(path.alias("path"), meta["file_modification_time"].alias("changed"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("raw"))
    root = folder.split("://", 1)[-1].split(":", 1)[-1].rstrip("/") + "/"
    lines = lines.withColumn("file", F.substring_index("path", root, -1))
    for part in exclude:
        lines = lines.where(~F.col("file").contains(part))
    if since:
        lines = lines.where(F.col("changed") >= F.lit(since).cast("timestamp"))
    place = Window.partitionBy("file").orderBy("block", "seq")
    return lines.withColumn("line_no", (F.row_number().over(place) - 1).cast("int")).where("trim(raw) <> ''").select("file", "line_no", "raw")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _blocks(v: Column, path: str) -> Column:
    """The list at a path, or null if there is another thing."""
    return _get(v, path, "array<variant>")


def content_text(v: Column, path: str) -> Column:
    """A text, or the texts of a list of blocks joined by line breaks; nothing else has a text."""
    said = F.filter(F.transform(_blocks(v, path), lambda b: _get(b, "$.text")), lambda t: t.isNotNull())
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))
    return F.when(kind.startswith("ARRAY"), F.array_join(said, "\n")).when(kind == "STRING", _get(v, path)).otherwise("")


def _event(kind, text=None, tool_id=None, tool_name=None, input_=None, is_error=None, ts=None, sender=None, sender_name=None) -> Column:
    null = F.lit(None).cast("string")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(
        kind.alias("kind"), (null if text is None else text).alias("text"), (null if tool_id is None else tool_id).alias("tool_id"),
        (null if tool_name is None else tool_name).alias("tool_name"), (null if input_ is None else input_).alias("input"),
        (F.lit(None).cast("boolean") if is_error is None else is_error).alias("is_error"), (null if ts is None else ts).alias("ts"),
        (null if sender is None else sender).alias("sender"), (null if sender_name is None else sender_name).alias("sender_name"),
    )


def _parsed(lines: DataFrame) -> DataFrame:
    """Lines that are JSON, with what both streams of events need of them."""
    j = F.col("j")
    p = lines.withColumn("j", F.try_parse_json("raw")).where("j is not null")
    flag = lambda path: F.coalesce(_get(j, path, "boolean"), F.lit(False))
    return p.select(
        "file", "line_no", "j", _get(j, "$.type").alias("type"), F.coalesce(_get(j, "$.timestamp"), F.lit("")).alias("ts"),
        F.nullif(_get(j, "$.sessionId"), F.lit("")).alias("session"), _get(j, "$.agentId").alias("agent"), flag("$.isSidechain").alias("side"), flag("$.isMeta").alias("meta"),
        _get(j, "$.origin.kind").alias("origin"), _get(j, "$.toolDenialKind").alias("denial"), F.coalesce(_get(j, "$.cwd"), F.lit("")).alias("cwd"),
        F.coalesce(_get(j, "$.gitBranch"), F.lit("")).alias("branch"),
    )


def _assistant() -> Column:
    """Texts that are not blank, and tool calls, of an assistant's blocks."""
    text = lambda b: F.coalesce(_get(b, "$.text"), F.lit(""))
    name = lambda b, n: F.coalesce(_get(b, f"$.{n}"), F.lit(""))
    made = F.transform(
        _blocks(F.col("j"), "$.message.content"),
        lambda b: F.when((_get(b, "$.type") == "text") & text(b).rlike(r"\S"), _event("assistant", text(b)))
        .when(_get(b, "$.type") == "tool_use", _event("tool_use", None, name(b, "id"), name(b, "name"), F.coalesce(F.to_json(F.try_variant_get(b, "$.input", "variant")), F.lit("")))),
    )
    return F.array_compact(made)


def _results() -> Column:
    made = F.transform(
        _blocks(F.col("j"), "$.message.content"),
        lambda b: F.when(
            _get(b, "$.type") == "tool_result",
            _event("tool_result", content_text(b, "$.content"), F.coalesce(_get(b, "$.tool_use_id"), F.lit("")), is_error=F.coalesce(_get(b, "$.is_error", "boolean"), F.lit(False))),
        ),
    )
    return F.coalesce(F.array_compact(made), F.array().cast(f"array<{EVENT}>"))


def _only(event: Column, when: Column) -> Column:
    return F.when(when, F.array(event)).otherwise(F.array().cast(f"array<{EVENT}>"))


def _human(text: Column) -> Column:
    """Whether a plain user line was typed: its origin says so, or without one it is no side chain and starts with no bracket."""
    return F.when(F.col("origin").isNotNull(), F.col("origin") == "human").otherwise(~F.col("side") & ~text.rlike(r"^\s*[<\[]"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(system_reminders_removed(text), r"^\s+|\s+$", "")


def _numbered(e: DataFrame, *more: str) -> DataFrame:
    w = Window.partitionBy("file").orderBy("line_no", "block_no")
    return e.withColumn("i", (F.row_number().over(w) - 1).cast("long")).select("file", "i", "ts", "session_id", "agent_id", *more)


def _exploded(p: DataFrame, made: Column) -> DataFrame:
    """One row an event, with the first session and agent that the file names, before the others are left out."""
    whole = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda c: F.first(c, ignorenulls=True).over(whole)
    p = p.withColumns({"made": made, "session_id": F.coalesce(first("session"), F.lit("")), "agent_id": first("agent")})
    e = p.select("file", "line_no", F.col("ts").alias("line_ts"), "session_id", "agent_id", "denial", "cwd", "branch", F.posexplode("made").alias("block_no", "b"))
    return e.select("file", "line_no", "block_no", F.coalesce("b.ts", "line_ts").alias("ts"), "session_id", "agent_id", "denial", "cwd", "branch", *[F.col(f"b.{c}").alias(c) for c in ("kind", "text", "tool_id", "tool_name", "input", "is_error", "sender", "sender_name")])


def events(lines: DataFrame) -> DataFrame:
    """(file, i, ts, session_id, agent_id, kind, text, tool_id, tool_name, input, is_error, denial) of the struggle stream.

    Kinds: human, tool_use, tool_result, assistant, interrupt, silence_reminder, hook_no_response. Results go before everything else of a
    user line; an interruption before meta lines, which are dropped. A human turn equal to the event right before it is dropped: a
    queued message can be recorded twice. Tool inputs are JSON with sorted names.
    """
    p, j = _parsed(lines), F.col("j")
    text = content_text(j, "$.message.content")
    interrupted = text.rlike(r"^\s*\[Request interrupted by user")
    typed = ~F.col("meta") & _human(text) & (_stripped(text) != "")
    user = F.when(F.size(_results()) > 0, _results()).when(interrupted, F.array(_event("interrupt"))).otherwise(_only(_event("human", _stripped(text)), typed))
    said = F.coalesce(_get(j, "$.attachment.content"), F.lit(""))
    prompt = _stripped(F.coalesce(_get(j, "$.attachment.prompt"), F.lit("")))
    queued = F.coalesce(_get(j, "$.attachment.origin.kind") == "human", F.lit(False)) | F.coalesce(_get(j, "$.attachment.humanTurn", "boolean"), F.lit(False))
    queued = queued & (F.coalesce(_get(j, "$.attachment.commandMode"), F.lit("prompt")) == "prompt") & (prompt != "")
    kind = _get(j, "$.attachment.type")
    attached = (
        F.when(kind == "silent_turn_reminder", F.array(_event("silence_reminder")))
        .when(kind == "hook_system_message", _only(_event("hook_no_response", said), said.contains("didn't respond") | said.contains("did not respond")))
        .when(kind == "queued_command", _only(_event("human", prompt, ts=_get(j, "$.attachment.timestamp")), queued))
    )
    made = F.when(F.col("type") == "assistant", _assistant()).when(F.col("type") == "user", user).when(F.col("type") == "attachment", attached)
    e = _exploded(p, made)
    w = Window.partitionBy("file").orderBy("line_no", "block_no")
    again = (F.col("kind") == "human") & (F.lag("kind").over(w) == "human") & (F.lag("text").over(w) == F.col("text"))
    e = e.withColumn("again", F.coalesce(again, F.lit(False))).where("not again")
    return _numbered(e, "kind", "text", "tool_id", "tool_name", "input", "is_error", "denial")


def host_hooks(lines: DataFrame) -> DataFrame:
    """(file, host_hook_callbacks): lines by which a host registers its hooks, for files that have any."""
    hooks = F.transform(_blocks(F.col("j"), "$.hookInfos"), lambda h: _get(h, "$.command"))
    p = _parsed(lines).where(F.col("type") == "system").where(F.array_contains(hooks, HOST_HOOK))
    return p.groupBy("file").agg(F.count("*").alias("host_hook_callbacks"))


def peer_message(text: Column) -> tuple[Column, Column, Column]:
    """(session, name, body) of a message of another session that a text holds, null without one."""
    rest = F.regexp_extract(text, r"(?s)(<cross-session-message.*)", 1)
    attribute = lambda n: F.regexp_extract(rest, f'(?s){n}="([^"]*)', 1)
    body = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^>]*>(.*?)(?:</cross-session-message>.*)?$", 1), r"^\s+|\s+$", "")
    known = text.contains("<cross-session-message") & rest.contains(">")
    return tuple(F.when(known, c) for c in (attribute("from-session"), attribute("from-name"), body))


def _incoming(text: Column, at: str) -> tuple[Column, Column]:
    """Whether a text came from a peer or a coordinator, and its event."""
    j = F.col("j")
    session, name, body = peer_message(text)
    from_peer = F.coalesce(_get(j, f"{at}origin.kind") == "peer", F.lit(False))
    given = lambda field, found: F.coalesce(F.when(from_peer, F.nullif(_get(j, f"{at}origin.{field}"), F.lit(""))), found, F.lit(""))
    peer = _event("peer", given("body", body), sender=given("fromSession", session), sender_name=given("name", name))
    from_coordinator = F.coalesce(_get(j, f"{at}origin.kind") == "coordinator", F.lit(False)) | text.rlike(r"^\s*" + COORDINATOR)
    told = _event("coordinator", F.regexp_replace(text, r"^\s+|\s+$", ""), sender=F.lit("coordinator"))
    is_peer = from_peer | body.isNotNull()
    return is_peer | from_coordinator, F.when(is_peer, peer).otherwise(told)


def coordination_events(lines: DataFrame, back: int = 8) -> DataFrame:
    """(file, i, ts, session_id, agent_id, cwd, branch, kind, text, tool_id, tool_name, input, is_error, sender, sender_name).

    Kinds: human, peer, coordinator, tool_use, tool_result, assistant. A message that one of the ``back`` events kept before it repeats is
    dropped: equal text, of a peer's the same sender and first 120 characters.
    """
    p, j = _parsed(lines), F.col("j")
    text = content_text(j, "$.message.content")
    came, event = _incoming(text, "$.")
    typed = ~F.col("meta") & ~text.rlike(r"^\s*\[Request interrupted") & _human(text) & (_stripped(text) != "")
    user = F.when(F.size(_results()) > 0, _results()).when(came, F.array(event)).otherwise(_only(_event("human", _stripped(text)), typed))
    prompt = F.coalesce(_get(j, "$.attachment.prompt"), F.lit(""))
    queued, later = _incoming(prompt, "$.attachment.")
    by_hand = F.coalesce(_get(j, "$.attachment.origin.kind") == "human", F.lit(False)) | F.coalesce(_get(j, "$.attachment.humanTurn", "boolean"), F.lit(False))
    attached = F.when(queued, F.array(later)).otherwise(_only(_event("human", _stripped(prompt)), by_hand & (_stripped(prompt) != "")))
    attached = F.when(_get(j, "$.attachment.type") == "queued_command", attached)
    made = F.when(F.col("type") == "assistant", _assistant()).when(F.col("type") == "user", user).when(F.col("type") == "attachment", attached)
    e = _exploded(p, made)
    heard = F.when(F.col("kind") == "peer", F.concat(F.lit("peer "), F.col("sender"), F.lit(" "), F.substring("text", 1, 120)))
    heard = heard.when(F.col("kind").isin("human", "coordinator"), F.concat("kind", F.lit(" "), "text"))
    e = without_recent_repeats(e.withColumn("heard", heard).withColumn("place", F.struct("line_no", "block_no")), "file", "place", "heard", back, count_all=True)
    return _numbered(e, "cwd", "branch", "kind", "text", "tool_id", "tool_name", "input", "is_error", "sender", "sender_name")


def first_prompts(lines: DataFrame) -> DataFrame:
    """(file, prompt) of the first user line: its text, and nothing if it carries tool results."""
    p, j = _parsed(lines).where(F.col("type") == "user"), F.col("j")
    text = F.when(F.size(_results()) > 0, F.lit("")).otherwise(content_text(j, "$.message.content"))
    return p.groupBy("file").agg(F.min_by(text, "line_no").alias("prompt"))


def changed_files(listing: DataFrame, state: DataFrame, parameters: str = "") -> DataFrame:
    """Files of ``listing(file, changed, size, digest)`` that ``state`` does not have alike: by time and size, else by digest.

    A state of other ``parameters`` (how records were made: format, limits) counts as none, so that records of two kinds never mix.
    """
    s = state.where(F.col("parameters") == parameters) if "parameters" in state.columns else state.where(F.lit(parameters == ""))
    s = s.select(F.col("file").alias("f0"), F.col("changed").alias("c0"), F.col("size").alias("s0"), F.col("digest").alias("d0"))
    same = (F.col("file") == F.col("f0")) & (((F.col("changed") == F.col("c0")) & (F.col("size") == F.col("s0"))) | (F.col("digest") == F.col("d0")))
    return listing.join(s, same, "left_anti")


def live_state(state: DataFrame, listing: DataFrame) -> DataFrame:
    """State of files that still exist."""
    return state.join(listing.select("file").distinct(), "file", "left_semi")
