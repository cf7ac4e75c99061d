"""Operators over ordered events: ordinals, detectors, episodes, outcomes, interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

GAP = 6
#: Intervals of a bucket that lie together when pairs are made, larger buckets are dealt to blocks, and the parts that pairs are made in.
BLOCK, PARTS = 1024, 64


def with_ordinal(events: DataFrame, key: str, *order: str) -> DataFrame:
    """Position ``i`` of each event in its file, from 0: the identity that all detectors use."""
    return events.withColumn("i", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def merged_episodes(hits: DataFrame, key: str, gap: int = GAP) -> DataFrame:
    """(key, episode, i, signal): hits of all signals numbered by runs whose neighbours are at most ``gap`` apart."""
    w = Window.partitionBy(key).orderBy("i")
    new = (F.col("i") - F.lag("i").over(w) > gap).cast("int")
    numbered = hits.withColumn("__new", F.coalesce(new, F.lit(0)))
    return numbered.withColumn("episode", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def episode_spans(numbered: DataFrame, key: str) -> DataFrame:
    """(key, episode, start_event, end_event, hits)."""
    return numbered.groupBy(key, "episode").agg(F.min("i").alias("start_event"), F.max("i").alias("end_event"), F.count("*").alias("hits"))


def context(spans: DataFrame, events: DataFrame, key: str, before: int = 3, after: int = 2, most: int = 24) -> DataFrame:
    """Events round each span; of ``most`` or more the first and last halves stay."""
    e = events.select(F.col(key).alias("__k"), F.col("i").alias("event"), *[c for c in events.columns if c not in (key, "i")])
    lo, hi = F.greatest(F.col("start_event") - before, F.lit(0)), F.col("end_event") + after
    joined = spans.join(e, (F.col(key) == F.col("__k")) & (F.col("event") >= lo) & (F.col("event") <= hi)).drop("__k")
    span = Window.partitionBy(key, "episode")
    first, last = F.min("event").over(span), F.max("event").over(span)
    kept = (last - first < most) | (F.col("event") < first + most // 2) | (F.col("event") > last - most // 2)
    return joined.withColumn("__keep", kept).where("__keep").drop("__keep")


def last_before(events: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """The latest non-null ``value`` of an earlier event."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(name, F.last(value, ignorenulls=True).over(w))


def outcomes(events: DataFrame, key: str, incoming: Column, turn: Column, tool: Column, reply: Column, act: int = 20, answer: int = 60) -> DataFrame:
    """Incoming messages with whether a tool call followed within ``act`` events and before the next turn, and a reply within ``answer``."""
    w = Window.partitionBy(key).orderBy("i")
    tool_at = F.min(F.when(tool, F.col("i"))).over(w.rowsBetween(1, act))
    turn_at = F.min(F.when(turn, F.col("i"))).over(w.rowsBetween(1, act))
    acted = tool_at.isNotNull() & (turn_at.isNull() | (tool_at < turn_at))
    replied = F.coalesce(F.max(reply.cast("int")).over(w.rowsBetween(1, answer)) == 1, F.lit(False))
    return events.withColumn("acted", acted).withColumn("replied", replied).where(incoming)


def repeats(events: DataFrame, key: str, who: str) -> DataFrame:
    """The second and later events of each sender in a file."""
    w = Window.partitionBy(key, who).orderBy("i")
    return events.withColumn("nth", F.row_number().over(w)).where("nth >= 2")


def polls(calls: DataFrame, key: str, same: str, stop: Column, window: int = 12, least: int = 3) -> DataFrame:
    """Calls that repeat at least ``least`` times among the previous ``window`` calls after the last stopping event.

    Counted in one window pass: occurrences of the call since the later of its window's start and the last stop.
    """
    w = Window.partitionBy(key).orderBy("i")
    numbered = calls.withColumn("__n", F.row_number().over(w)).withColumn("__stop", F.coalesce(F.max(F.when(stop, F.col("i"))).over(w), F.lit(-1)))
    own = Window.partitionBy(key, same, "__stop").orderBy("__n").rangeBetween(-window, 0)
    return numbered.where(~stop).withColumn("seen", F.count("*").over(own)).where(F.col("seen") >= least).drop("__n", "__stop")


def corrections(turns: DataFrame) -> DataFrame:
    """Human turns right after the agent acted that push back."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("after", F.lag("role").over(w)).where((F.col("role") == "user") & (F.col("after") == "assistant") & text.correction(F.col("text")))


def reasks(turns: DataFrame, back: int = 10, least: float = 0.6, words: int = 4) -> DataFrame:
    """Human turns that repeat one of the previous ``back`` human turns, with an answer in between."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.withColumn("answers", F.sum((F.col("role") == "assistant").cast("int")).over(w)).where("role = 'user'")
    t = t.withColumn("n", F.row_number().over(w)).withColumn("cw", text.content_words(F.col("text"))).where(F.size("cw") >= words)
    a, b = t.alias("a"), t.select("conv_id", F.col("turn").alias("earlier"), F.col("n").alias("n0"), F.col("cw").alias("cw0"), F.col("answers").alias("answers0")).alias("b")
    hit = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("n0") < F.col("n")) & (F.col("n0") >= F.col("n") - back) & (F.col("answers0") < F.col("answers")))
    hit = hit.withColumn("likeness", text.jaccard(F.col("cw"), F.col("cw0"))).where(F.col("likeness") >= least)
    return hit.groupBy(F.col("a.conv_id").alias("conv_id"), "turn").agg(F.max("earlier").alias("earlier"), F.max("likeness").alias("likeness"))


def overlaps(intervals: DataFrame, key: str, who: str, slack: int, whole: bool = False) -> DataFrame:
    """Pairs (key, a, b, lo, hi) of owners whose [lo, hi] (seconds) on one key overlap within ``slack``, with what they share, or with
    all that they cover (``whole``).

    An interval is at home on the level of its length (a power of two) in at most two buckets of that width, and asks on the levels
    above that its key has: a pair meets in the equi-join of a bucket on the level of the longer one. So a long interval neither widens
    the buckets of others nor is in many of them, on whichever key it lies. A bucket that many are at home in is dealt to blocks, each
    of which all that ask there visit, so that its pairs are made by many tasks.
    """
    iv = intervals.select(key, F.col(who).alias("who"), "lo", "hi")
    iv = iv.withColumn("level", F.ceil(F.log2((F.col("hi") - F.col("lo") + slack + 1).cast("double"))).cast("int"))
    levels = iv.select(F.col(key).alias("__key"), F.col("level").alias("at")).distinct()
    width = lambda level: F.pow(F.lit(2.0), level).cast("long")
    buckets = lambda level: F.explode(F.sequence(F.floor(F.col("lo") / width(level)), F.floor((F.col("hi") + slack) / width(level)))).alias("bucket")
    home = iv.select(F.col(key), F.col("level").alias("at"), buckets(F.col("level")), F.struct("who", "lo", "hi").alias("x"))
    asks = iv.join(levels, (F.col(key) == F.col("__key")) & (F.col("at") >= F.col("level")))
    asks = asks.select(F.col(key), "at", buckets(F.col("at")), F.struct("who", "lo", "hi", "level").alias("y"))
    x, y = F.col("x"), F.col("y")
    near = (x["lo"] <= y["hi"] + slack) & (y["lo"] <= x["hi"] + slack)
    once = F.col("bucket") == F.floor(F.greatest(x["lo"], y["lo"]) / width(F.col("at")))  # one bucket for each pair
    order = F.when(y["level"] == F.col("at"), x["who"] < y["who"]).otherwise(x["who"] != y["who"])
    place = [key, "at", "bucket"]
    large = F.broadcast(home.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"))
    blocks = F.coalesce("blocks", F.lit(1))
    home = home.join(large, place, "left").withColumn("block", F.pmod(F.xxhash64("x"), blocks).cast("int")).drop("blocks")
    asks = asks.join(large, place, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    asks, home = (side.repartition(PARTS, *place, "block") for side in (asks, home))  # few bytes make many pairs, so Spark is not to merge parts
    met = asks.join(home, [*place, "block"]).where(near & once & order)
    lo, hi = (F.least, F.greatest) if whole else (F.greatest, F.least)
    return met.select(key, F.least(x["who"], y["who"]).alias("a"), F.greatest(x["who"], y["who"]).alias("b"), lo(x["lo"], y["lo"]).alias("lo"), hi(x["hi"], y["hi"]).alias("hi"))
