"""Intervals, trends and budgets as expressions over aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def rate_per_thousand(k: Column, n: Column) -> Column:
    """Null without a denominator, 0 without events."""
    return F.when(n > 0, F.round(1000.0 * k / n, 3))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    p, z2 = k / n, z * z
    mid, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low = F.when(n > 0, F.greatest(F.lit(0.0), (mid - half) / (1 + z2 / n)))
    return low, F.when(n > 0, F.least(F.lit(1.0), (mid + half) / (1 + z2 / n)))


def chi2_quantile(z: float, df: Column) -> Column:
    """The Wilson-Hilferty approximation at the normal quantile ``z``."""
    return df * F.pow(1 - 2.0 / (9 * df) + z * F.sqrt(2.0 / (9 * df)), F.lit(3.0))


def poisson_interval(k: Column, n: Column) -> tuple[Column, Column]:
    """Exact-style bounds of a rate per thousand; null without a denominator, 0 below for no events."""
    low = F.when(k > 0, chi2_quantile(-Z95, 2.0 * k) / 2).otherwise(0.0)
    high = chi2_quantile(Z95, 2.0 * k + 2) / 2
    return F.when(n > 0, F.round(1000 * low / n, 3)), F.when(n > 0, F.round(1000 * high / n, 3))


def weighted_trend(weeks: DataFrame, least: int = 200) -> DataFrame:
    """(points, factor, low, high, verdict) of ``weeks(i, k, n)``: log-linear, weighted by events.

    Weeks without events or with fewer than ``least`` calls do not count; under three points nothing is estimated.
    """
    used = weeks.where((F.col("k") >= 1) & (F.col("n") >= least)).withColumn("y", F.log(F.col("k") / F.col("n")))
    s = used.agg(
        F.count("*").alias("points"), F.sum("k").alias("w"), F.sum(F.col("k") * F.col("i")).alias("wx"), F.sum(F.col("k") * F.col("y")).alias("wy"),
        F.sum(F.col("k") * F.col("i") * F.col("i")).alias("wxx"), F.sum(F.col("k") * F.col("i") * F.col("y")).alias("wxy"),
    )
    sxx = F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w")
    slope = (F.col("wxy") - F.col("wx") * F.col("wy") / F.col("w")) / sxx
    ok = (F.col("points") >= 3) & (sxx > 0)
    bounds = [F.when(ok, F.round(F.exp(slope + d * Z95 / F.sqrt(sxx)), 6)) for d in (0, -1, 1)]
    out = s.select(F.col("points"), *[b.alias(x) for b, x in zip(bounds, ("factor", "low", "high"))])
    verdict = F.when(F.col("factor").isNull(), "Not estimable").when(F.col("high") < 1, "Declining").when(F.col("low") > 1, "Rising").otherwise("Flat")
    return out.withColumn("verdict", verdict)


def annealed(t: Column, rounds: Column, low: int, high: int) -> Column:
    """A cosine schedule from ``high`` down to ``low`` over the rounds."""
    return low + (high - low) * 0.5 * (1 + F.cos(math.pi * t / F.greatest(rounds, F.lit(1))))


def ranked(rows: DataFrame, group: list[str], value: str, places: dict[str, float]) -> DataFrame:
    """Values at rounded ranks ``(n - 1) * p`` of each group, by counts of each value and their running sums.

    Equal values are one row before anything is ordered, so that no task gathers a group's rows. Without groups there is one row, of
    nulls if there is no value; nulls do not count.
    """
    return _at_ranks(rows, group, value, {name: F.round((F.col("n") - 1) * p, 0) for name, p in places.items()})


def upper_medians(rows: DataFrame, group: list[str], value: str, name: str = "upper_median") -> DataFrame:
    """The value at rank ``n / 2``, rounded down, of each group."""
    return _at_ranks(rows, group, value, {name: F.floor(F.col("n") / 2)})


def _at_ranks(rows: DataFrame, group: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    own = [F.col(g) for g in group] or [F.lit(0).alias("__all")]
    c = rows.where(F.col(value).isNotNull()).groupBy(*own, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    keys = group or ["__all"]
    c = c.withColumns({"__to": F.sum("__c").over(Window.partitionBy(*keys).orderBy("__v")), "n": F.sum("__c").over(Window.partitionBy(*keys))})
    picks = [F.min(F.when(F.col("__to") > rank, F.col("__v"))).alias(name) for name, rank in ranks.items()]
    return c.groupBy(*keys).agg(*picks).drop("__all") if group else c.agg(*picks)
