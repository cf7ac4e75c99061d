"""Phrase detectors over turns and tool results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of each signal, searched in lower-case text; names of particular assistants are left to callers
# (``phrases_for``).
PHRASES = {
    "user_relay": [
        "other agent", "other session", "another session", "another agent", "other chat", "other window", "other instance",
        "wrong session", "wrong chat", "wrong window", "tell the other", "relay this", "pass this to", "pass this along",
        "forward this", "from-session=", "cross-session-message", "other conversation", "parallel session",
    ],
    "peer_retraction": [
        "withdraw", "void", "disregard", "ignore my", "ignore the previous", "ignore that", "retract", "scratch that",
        "never mind", "nevermind", "correction:", "supersede", "no longer", "rename", "final name", "changed my mind",
        "reversed", "revert my", "instead of what i",
    ],
    "already_done": [
        "already done by", "already been done", "already implemented", "already landed", "already merged", "already fixed",
        "already open", "already filed", "duplicate of", "duplicates #", "another session already", "other session already",
        "already working on", "already being worked", "already in flight", "already handled by", "superseded by",
        "already did this", "already claimed",
    ],
    "blocked_on_other": [
        "waiting on the other", "waiting for the other", "waiting on another", "waiting for another", "blocked on the other",
        "blocked by the other", "blocked on another", "blocked by another", "owned by another", "another session owns",
        "other session owns", "owned by the other", "until the other", "once the other", "waiting for #", "waiting on #",
        "blocked on #", "blocked by #", "keep waiting for", "still waiting for", "waiting for that", "until it lands",
        "until that lands", "until it merges", "until that merges",
    ],
    "ownership_question": [
        "who owns", "who's working", "who is working", "is anyone working", "is someone working", "anyone else working",
        "anyone already", "which session owns", "which session is", "whose is", "owner of this", "who's doing", "who is doing",
        "is this mine", "is that mine", "not mine", "isn't mine", "someone else's",
    ],
}
# Markers of tool results, searched as they are.
VCS_CONFLICT = [
    "CONFLICT (", "Merge conflict in", "could not apply", "Automatic merge failed", "needs merge", "Unmerged paths",
    "! [rejected]", "Updates were rejected", "non-fast-forward", "is already checked out at", "is already used by worktree",
    "rebase in progress", "stale info", "cannot lock ref",
]
HOOK_TIMEOUT = ["hook did not respond", "hook didn't respond"]
GUARD = ["isolated in the worktree", "running in an isolated git worktree"]
WORKTREE = ["belongs to a different worktree", "Do not write to other worktrees"]
# Commands that look at a state, that comment, and words of a claim.
STATUS_CHECKS = [
    "gh pr view", "gh pr checks", "gh issue view", "gh run view", "gh run list", "gh run watch", "gh api repos", "git fetch",
    "git ls-remote", "git log origin", "gh pr list",
]
COMMENT_COMMANDS = ["gh issue comment", "gh pr comment", "/comments"]
CLAIMS = ["claimed by", "released by", "claiming", "releasing"]
#: Which roles can say what; None: any.
SPEAKERS = {"user_relay": ["user"], "peer_retraction": None, "already_done": ["user", "assistant"], "blocked_on_other": ["assistant"], "ownership_question": ["user", "assistant"]}


def phrases_for(assistant: str) -> dict[str, list[str]]:
    """The phrases, with those that name an assistant."""
    name = assistant.lower()
    return PHRASES | {"user_relay": [*PHRASES["user_relay"], f"other {name}", f"another {name}"]}


def any_of(text: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p))


def signals(turns: DataFrame, phrases: dict[str, list[str]] = PHRASES) -> DataFrame:
    """The rows of ``turns(role, text, ...)`` once for each signal that they hold."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = []
    for name, said in phrases.items():
        who = SPEAKERS.get(name)
        hit = any_of(low, said) if who is None else F.col("role").isin(who) & any_of(low, said)
        hits.append(F.when(hit, F.lit(name)))
    return turns.withColumn("signal", F.explode(F.array_compact(F.array(*hits))))


def test_failure(text: Column) -> Column:
    """Whether any line of a log says that a test failed."""
    line = (
        r"(?m)^\s*(?:--- FAIL|FAIL\t|FAIL .*\[build failed\]|FAILED \(failures|Tests failed|FAILED .*::|=(?=.* failed)(?=.*[0-9]))"
        r"|test result: FAILED| FAILED in |\tfail\t|\"conclusion\": ?\"failure\"|Process completed with exit code|tests failed"
    )
    return text.rlike(line)


def result_class(text: Column, is_error: Column, denial: Column) -> Column:
    """Class of a tool result: a hook that timed out, a denied permission, an error, or null.

    A denial field other than ``interrupted`` is a denial; without one the text decides.
    """
    hook = any_of(text, HOOK_TIMEOUT)
    said = text.contains("doesn't want to proceed with this tool use") | text.rlike("denied by the .{1,40} auto mode classifier")
    said = said | (text.startswith("Permission to use") & text.contains("denied")) | text.startswith("permission was denied")
    denied = F.when(denial.isNotNull(), denial != "interrupted").otherwise(said)
    return F.when(hook, "hook_timeout").when(denied, "permission_denial").when(is_error & denial.isNull(), "tool_error")
