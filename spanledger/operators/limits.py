"""Rate-limit snapshots: which reading to keep, which window binds, what is stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_stale(age: Column, limit: int) -> Column:
    """Unknown age, older than limit, or more than a minute in the future."""
    return age.isNull() | (age > limit) | (age < -60)


def fraction(percent: Column) -> Column:
    """A used fraction: null if negative or not a number, at most 1."""
    return F.when((percent >= 0) & ~F.isnan(percent), F.least(percent, F.lit(1.0)))


def merge_snapshots(snapshots: DataFrame) -> DataFrame:
    """One snapshot of each agent: windows beat none, fresh beats stale, then the newer, then the higher rank.

    snapshots: agent, windows (bigint), stale, updated_at, rank, and tier, which is inherited if the kept one has none.
    """
    order = F.struct((F.col("windows") > 0).alias("w"), (~F.col("stale")).alias("f"), "updated_at", "rank")
    best = snapshots.groupBy("agent").agg(F.max(F.struct(order.alias("o"), "windows", "stale", "tier")).alias("b"), F.max("tier").alias("any_tier"))
    return best.select("agent", "b.windows", "b.stale", "b.o.updated_at", "b.o.rank", F.coalesce("b.tier", "any_tier").alias("tier"))


def binding_window(windows: DataFrame, now: int) -> DataFrame:
    """Of each agent the fullest window that is fresh and not reset; ties go to the earlier reset, then the label."""
    live = windows.where(~F.col("stale") & (F.col("resets_at").isNull() | (F.col("resets_at") > now)) & F.col("fraction").isNotNull())
    key = F.struct((-F.col("fraction")).alias("f"), F.coalesce("resets_at", F.lit(2**62)).alias("r"), "label")
    return live.groupBy("agent").agg(F.min(F.struct(key.alias("k"), "fraction", "label", "resets_at")).alias("b")).select("agent", "b.label", "b.fraction", "b.resets_at")


def alarms(windows: DataFrame, now: int, least: float = 0.9) -> DataFrame:
    """Windows at least so full that haven't been reset."""
    return windows.where((F.col("fraction") >= least) & (F.col("resets_at").isNull() | (F.col("resets_at") > now)))


def newest_reading(readings: DataFrame, key: str) -> DataFrame:
    """The newest reading of each key; of equal times the later row."""
    return readings.groupBy(key).agg(F.max(F.struct("at", "seq")).alias("_m")).select(key, F.col("_m.at").alias("at"), F.col("_m.seq").alias("seq"))
