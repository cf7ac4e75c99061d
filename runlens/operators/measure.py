"""The rate of struggles: sessions of two sources joined, episodes with their labels, and records by day, host and pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats

ZONE = "America/Los_Angeles"
NOISE = "noise"
# Hosts, the first for sessions that a harness launched, the last for all without a sign of another.
HARNESS, HOSTED, PLAIN = "csf_harness", "desktop_hosted", "cli"


def local_day(utc: Column) -> Column:
    """The calendar day of a UTC wall-clock time (timestamp without zone)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), utc).cast("date")


def hour_day(hour: Column) -> Column:
    return local_day(F.to_timestamp_ntz(hour, F.lit("yyyy-MM-dd'T'HH")))


def day_closed(day: Column, now: Column) -> Column:
    """Whether the last second of a day has passed at ``now`` (UTC without zone)."""
    return F.convert_timezone(F.lit(ZONE), F.lit("UTC"), F.date_add(day, 1).cast("timestamp_ntz")) <= now


def attributed(calls: DataFrame, marks: DataFrame, harness_calls: DataFrame, harness: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions of transcripts and of harness records, and their calls by hour.

    ``calls(session, hour, calls)`` and ``marks(session, hook_timeouts, guard_rejections, host_hook_callbacks)`` are of transcripts;
    ``harness_calls(session, hour, calls)`` and ``harness(session, assignment)`` of records. A session that a record names has the
    record's host and calls; any other is hosted if it shows a host's mark, and else plain.
    """
    total = lambda df, name: df.groupBy("session").agg(F.sum("calls").alias(name))
    t = marks.join(total(calls, "t_calls"), "session", "left").withColumn("in_t", F.lit(True))
    h = harness.groupBy("session").agg(F.min("assignment").alias("assignment")).join(total(harness_calls, "h_calls"), "session", "left").withColumn("in_h", F.lit(True))
    both = t.join(h, "session", "full_outer")
    named = F.coalesce("in_h", F.lit(False))
    marked = F.col("hook_timeouts") + F.col("guard_rejections") + F.col("host_hook_callbacks") > 0
    zero = lambda c: F.coalesce(c, F.lit(0))
    sessions = both.select(
        "session", F.when(named, HARNESS).when(marked, HOSTED).otherwise(PLAIN).alias("host"), F.when(named, HARNESS).otherwise("transcript").alias("denominator"),
        zero("t_calls").alias("transcript_calls"), F.when(named, zero("h_calls")).alias("harness_calls"), zero("hook_timeouts").alias("hook_timeouts"),
        zero("guard_rejections").alias("guard_rejections"), zero("host_hook_callbacks").alias("host_hook_callbacks"), "assignment",
    )
    own = calls.join(harness.select("session").distinct(), "session", "left_anti")
    return sessions, own.unionByName(harness_calls.join(harness.select("session").distinct(), "session", "left_semi"))


def labelled(episodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, session, day, pattern, canonical, fixable, struggle) of every episode; without a label pattern is null."""
    e = episodes.select("id", "session", local_day(F.to_timestamp_ntz(F.substring("start", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))).alias("day"))
    j = e.join(labels.select("id", "pattern", "canonical", "fixable"), "id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    known = F.col("pattern").isNotNull()
    j = j.withColumns({"canonical": known & F.coalesce("canonical", F.lit(True)), "fixable": flag("fixable")})
    return j.withColumn("struggle", known & (F.col("pattern") != NOISE) & F.col("fixable"))


def live_labels(labels: DataFrame, episodes: DataFrame) -> DataFrame:
    """Labels of episodes that still exist."""
    return labels.join(episodes.select("id"), "id", "left_semi")


def _rate(out: DataFrame) -> DataFrame:
    low, high = stats.poisson_interval(F.col("struggles"), F.col("tool_calls"))
    return out.withColumns({"rate": stats.rate_per_thousand(F.col("struggles"), F.col("tool_calls")), "low": low, "high": high})


def _activity(sessions: DataFrame, hours: DataFrame, eps: DataFrame) -> DataFrame:
    """(day, host, session, calls, episodes, labelled, noise, struggles, seen) in long form; an unknown session is plain."""
    hosts = sessions.select("session", "host")
    host = F.coalesce("host", F.lit(PLAIN)).alias("host")
    n = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    zero = F.lit(0).cast("long")
    a = hours.join(hosts, "session").select(hour_day(F.col("hour")).alias("day"), "host", "session", F.col("calls").cast("long").alias("calls"), *[zero.alias(c) for c in ("episodes", "labelled", "noise", "struggles")])
    known = F.col("pattern").isNotNull()
    b = eps.where("day is not null").join(hosts, "session", "left")
    b = b.select("day", host, "session", zero.alias("calls"), F.lit(1).cast("long").alias("episodes"), n(known).alias("labelled"), n(known & (F.col("pattern") == NOISE)).alias("noise"), n(F.col("struggle")).alias("struggles"))
    return a.unionByName(b)


def daily(sessions: DataFrame, hours: DataFrame, eps: DataFrame, now: Column) -> DataFrame:
    """(day, closed, sessions, tool_calls, episodes, labelled, noise, struggles, rate, low, high)."""
    a = _activity(sessions, hours, eps).groupBy("day").agg(
        F.count_distinct("session").alias("sessions"), F.sum("calls").alias("tool_calls"), *[F.sum(c).alias(c) for c in ("episodes", "labelled", "noise", "struggles")]
    )
    return _rate(a).withColumn("closed", day_closed(F.col("day"), now))


def daily_hosts(sessions: DataFrame, hours: DataFrame, eps: DataFrame) -> DataFrame:
    """(day, host, sessions, tool_calls, struggles, rate, low, high) of hosts with a call or a struggle that day."""
    a = _activity(sessions, hours, eps).groupBy("day", "host").agg(F.count_distinct("session").alias("sessions"), F.sum("calls").alias("tool_calls"), F.sum("struggles").alias("struggles"))
    return _rate(a.where("tool_calls > 0 or struggles > 0"))


def daily_patterns(sessions: DataFrame, eps: DataFrame) -> DataFrame:
    """(day, pattern, canonical, host, episodes, fixable) of labelled episodes that are no noise."""
    e = eps.where((F.col("pattern") != NOISE) & F.col("day").isNotNull()).join(sessions.select("session", "host"), "session", "left")
    return e.groupBy("day", "pattern", "canonical", F.coalesce("host", F.lit(PLAIN)).alias("host")).agg(F.count("*").alias("episodes"), F.sum(F.col("fixable").cast("long")).alias("fixable"))


def daily_records(days: DataFrame, hosts: DataFrame, patterns: DataFrame) -> DataFrame:
    """The days with maps nested in them, for a JSON sink: host to its slice, pattern to its episodes by host, and uncanonical patterns."""
    h = hosts.groupBy("day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("host", F.struct("sessions", "tool_calls", "struggles", "rate", "low", "high"))))).alias("hosts"))
    p = patterns.where("canonical").groupBy("day", "pattern").agg(
        F.sum("episodes").alias("episodes"), F.sum("fixable").alias("fixable"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("host", "episodes")))).alias("hosts")
    )
    p = p.groupBy("day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pattern", F.struct("episodes", "fixable"))))).alias("patterns"))
    u = patterns.where("not canonical").groupBy("day", "pattern").agg(F.sum("episodes").alias("n")).groupBy("day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pattern", "n")))).alias("uncanonical"))
    return days.join(h, "day", "left").join(p, "day", "left").join(u, "day", "left")


def weekly(days: DataFrame, sessions_hours: DataFrame) -> DataFrame:
    """(week, sessions, tool_calls, struggles, rate, low, high, open) of weeks from Monday on; open while one of its days is."""
    week = lambda d: F.date_trunc("week", d).cast("date").alias("week")
    w = days.groupBy(week(F.col("day"))).agg(F.sum("tool_calls").alias("tool_calls"), F.sum("struggles").alias("struggles"), F.bool_or(~F.col("closed")).alias("open"))
    s = sessions_hours.select(week(hour_day(F.col("hour"))), "session").groupBy("week").agg(F.count_distinct("session").alias("sessions"))
    return _rate(w.join(s, "week", "left").na.fill(0, ["sessions"]))


def folding(raw_labels: DataFrame, labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row: what folding names through ``aliases(alias, id)`` did to ``raw_labels(id, raw)``, which became ``labels(id, pattern, canonical)``."""
    ids = aliases.select(F.col("id").alias("raw")).distinct().withColumn("is_id", F.lit(True))
    names = aliases.select(F.col("alias").alias("raw")).distinct().withColumn("is_alias", F.lit(True))
    raw = raw_labels.select("raw").where(F.col("raw") != NOISE).distinct().join(ids, "raw", "left").join(names, "raw", "left")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    alias, own = F.coalesce("is_alias", F.lit(False)), F.coalesce("is_id", F.lit(False))
    a = raw.agg(F.count("*").alias("raw_slugs"), n(alias).alias("aliases_folded"), n(~alias & ~own).alias("uncanonical"))
    used = F.when(F.col("canonical") & (F.col("pattern") != NOISE), F.col("pattern"))
    b = labels.agg(F.count("*").alias("labels"), F.count_distinct(used).alias("canonical_ids"))
    c = raw_labels.join(labels.select("id", "pattern"), "id").agg(n(F.col("raw") != F.col("pattern")).alias("labels_remapped"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def series(days: DataFrame, hosts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(series, day, host, pattern, value, tool_calls, struggles) in long form: the rate for all and each host, episodes for each pattern."""
    null = lambda t: F.lit(None).cast(t)
    rate = lambda df, host: df.select(F.lit("rate").alias("series"), "day", host.alias("host"), null("string").alias("pattern"), F.col("rate").alias("value"), "tool_calls", "struggles")
    p = patterns.where("canonical").select(F.lit("episodes").alias("series"), "day", "host", "pattern", F.col("episodes").cast("double").alias("value"), null("long").alias("tool_calls"), null("long").alias("struggles"))
    return rate(days, F.lit("all")).unionByName(rate(hosts, F.col("host"))).unionByName(p)
