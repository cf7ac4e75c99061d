"""What can be plugged in: miners by name, domains, sources of tool calls, and modes of labelling."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs, sessions
from ..sources import transcripts


class CallSource(Protocol):
    """A source of tool calls: (session, hour, calls)."""

    def calls(self, spark: SparkSession) -> DataFrame: ...


class Domain(Protocol):
    """A domain of tasks: its trials as (job, task, trial, reward, weight, tokens), what a candidate must not break, and how a task is shown."""

    name: str

    def trials(self, spark: SparkSession, job: str) -> DataFrame: ...

    def guards(self, incumbent: DataFrame, candidate: DataFrame) -> DataFrame: ...

    def render(self, trial: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Miner:
    """A miner by name: what it takes, what it gives, and the tables that it makes of its arguments."""

    name: str
    about: str
    inputs: dict[str, str]
    records: dict[str, str]
    run: Callable[..., dict[str, DataFrame]]

    def __call__(self, spark: SparkSession, **given) -> dict[str, DataFrame]:
        if unknown := set(given) - set(self.inputs):
            raise ValueError(f"{self.name}: unknown arguments {sorted(unknown)}; known: {sorted(self.inputs)}")
        return self.run(spark, **given)


@dataclass(frozen=True)
class Mode:
    """A way to label what a miner finds: the names to choose from, and the escape for a name of one's own."""

    miner: str
    vocabulary: tuple[str, ...] = ()
    escape: str = "new_pattern"
    fields: dict[str, str] = field(default_factory=lambda: {"id": "string", "pattern": "string", "summary": "string", "harness_fixable": "boolean"})

    def choices(self, noise: str = "noise") -> list[str]:
        return [*self.vocabulary, noise, self.escape]


def _read(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), since: str | None = None) -> DataFrame:
    return transcripts.read_lines(spark, root, tuple(exclude), since)


def _traces(spark: SparkSession, **given) -> dict[str, DataFrame]:
    lines = _read(spark, **given)
    marked = sessions.struggle_marks(transcripts.events(lines))
    calls, marks = sessions.transcript_sessions(marked.drop("signals"), transcripts.host_hooks(lines))
    episodes = sessions.episodes(marked)
    return {"episodes": episodes, "calls": calls, "marks": marks, "summary": sessions.signal_summary(episodes)}


def _handoffs(spark: SparkSession, marker: str = "/worktrees/", **given) -> dict[str, DataFrame]:
    events = transcripts.coordination_events(_read(spark, **given))
    marked = sessions.coordination_marks(events)
    return {
        "episodes": sessions.episodes(marked), "outcomes": sessions.message_outcomes(events), "files": sessions.shared_files(sessions.edit_times(events, marker)),
        "branches": sessions.shared_branches(sessions.branch_times(events, marker)), "titles": sessions.created_titles(events),
    }


def _gaps(spark: SparkSession, **given) -> dict[str, DataFrame]:
    lines = _read(spark, **given)
    events = transcripts.coordination_events(lines)
    found = runs.runs(events, transcripts.first_prompts(lines))
    return {"runs": found.where(F.col("commits") > 0), "signals": runs.run_signals(found).unionByName(runs.moments(events).drop("i")), "rules": runs.rule_scores(found), "population": runs.population(found)}


_FILES = {"root": "folder of transcripts", "exclude": "parts of paths to leave out", "since": "least time of change"}
MINERS = {
    m.name: m
    for m in (
        Miner("traces", "struggles of agents", _FILES, {"episodes": "a run of hits", "calls": "calls by hour", "marks": "signs of a host", "summary": "counts by signal"}, _traces),
        Miner("handoffs", "coordination between sessions", _FILES | {"marker": "between a repository and its work trees"}, {"episodes": "a run of hits", "outcomes": "messages", "files": "shared files", "branches": "shared branches", "titles": "opened requests"}, _handoffs),
        Miner("pr-gap", "commits that reach no request", _FILES, {"runs": "a transcript", "signals": "a hit", "rules": "a limit in minutes", "population": "counts"}, _gaps),
    )
}
