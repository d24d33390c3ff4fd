"""Identity-based merging of usage rows in which larger readings supersede smaller ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TOKEN_BUCKETS, total_tokens
from .ordered import SLICE, Sliced


def identity() -> Column:
    """E:<event id>, or S:<shape> for rows without one: provider, model, five buckets and created."""
    shape = F.concat_ws("\x1f", F.lit("S"), F.coalesce("provider", F.lit("")), F.coalesce("model", F.lit("")), *TOKEN_BUCKETS, "created")
    return F.when(F.col("event_id") != "", F.concat(F.lit("E:"), F.col("event_id"))).otherwise(shape)


def supersede(rows: DataFrame) -> DataFrame:
    """One row of each identity: the reading with most tokens (the first of equals), at the place of the first.

    The best row's seq is found by partial maxima, so a hot identity is no hot task; the rows themselves are then
    matched by seq, which is unique.
    """
    keyed = rows.select("seq", identity().alias("_key"), total_tokens().alias("_tokens"))
    best = keyed.groupBy("_key").agg(F.max(F.struct("_tokens", (-F.col("seq")).alias("_neg"))).alias("b"), F.min("seq").alias("position"))
    winners = best.select((-F.col("b._neg")).alias("seq"), "position")
    return rows.join(winners, "seq").withColumn("seq", F.col("position")).drop("position")


def merge_sources(base: DataFrame, others: list[DataFrame], dedup_base: bool = False) -> DataFrame:
    """Rows of all sources in their order, deduplicated.

    With dedup_base every source is (live merge). Without it all rows of the first source stay; of those that share an
    identity only the last can be superseded by a later source, and later sources are deduplicated among themselves.
    """
    if dedup_base or not others:
        return supersede(reduce(DataFrame.unionByName, others, base)) if dedup_base else base
    keyed = base.withColumn("_key", identity())
    last = keyed.groupBy("_key").agg(F.max("seq").alias("seq"))
    targets = keyed.drop("_key").join(last.select("seq"), "seq", "left_semi")
    merged = supersede(reduce(DataFrame.unionByName, others, targets))
    return base.join(last.select("seq"), "seq", "left_anti").unionByName(merged.select(base.columns))


def insert_or_ignore(table: DataFrame, fresh: DataFrame, key: str = "event_id") -> DataFrame:
    """The rows of fresh to append: their key isn't in table, and of several in fresh the first by seq counts."""
    first = fresh.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("seq").alias("seq")).select("seq")
    return fresh.join(first, "seq", "left_semi").join(table.select(key), key, "left_anti")


def positions(rows: DataFrame, key: str) -> DataFrame:
    """(key, first): where each key was first seen, by seq."""
    return rows.groupBy(key).agg(F.min("seq").alias("first"))


# --- ordered folds over the lines of a file ---------------------------------------------------------------------


def carry_forward(lines: DataFrame, file: str, order: str) -> DataFrame:
    """Lines with session (first known so far), model (last known so far) and cwd (last turn's, else the first meta's).

    lines has meta_session, meta_cwd, turn_model and turn_cwd, null where a line doesn't say. A file of any length is cut into
    ranges, so that it isn't one task.
    """
    s = Sliced(lines, [file], [order])
    known = lambda c, pick: pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))
    held = {"_s": (known("meta_session", F.min_by), "first"), "_m": (known("turn_model", F.max_by), "last"), "_t": (known("turn_cwd", F.max_by), "last"), "_c": (known("meta_cwd", F.min_by), "first")}
    so_far = s.so_far()
    here = s.rows.withColumns({
        "session": F.first("meta_session", ignorenulls=True).over(so_far), "model": F.last("turn_model", ignorenulls=True).over(so_far),
        "_turn": F.last("turn_cwd", ignorenulls=True).over(so_far), "_meta": F.first("meta_cwd", ignorenulls=True).over(so_far),
    })
    both = s.carry(here, held)
    done = both.withColumns({"session": F.coalesce("_s", "session"), "model": F.coalesce("model", "_m"), "cwd": F.coalesce("_turn", "_t", "_c", "_meta")})
    return done.drop(*held, "_turn", "_meta", SLICE)


def drop_replays(calls: DataFrame, file: str, order: str, total: str, own: str) -> DataFrame:
    """Calls without those that repeat the running total; `disagrees` marks a total that didn't grow by the call's own tokens.

    Calls without total are kept and compared to nothing. call_no is the place of a kept call in its file.
    """
    s = Sliced(calls, [file], [order])
    here = s.rows.withColumn("_lag", F.last(total, ignorenulls=True).over(s.within().rowsBetween(Window.unboundedPreceding, -1)))
    both = s.carry(here, {"_last": (F.max_by(total, F.when(F.col(total).isNotNull(), F.col(order))), "last")})
    known = both.withColumn("_before", F.coalesce("_lag", "_last"))
    kept = known.where(F.col(total).isNull() | F.col("_before").isNull() | (F.col(total) != F.col("_before")))
    kept = kept.withColumn("disagrees", F.coalesce(F.col(total) - F.col("_before") != F.col(own), F.lit(False))).drop("_before", "_lag", "_last")
    placed = s.carry(kept, {"_calls": (F.count(F.lit(1)), "sum")})
    return placed.withColumn("call_no", F.row_number().over(s.within()) + F.col("_calls")).drop("_calls", SLICE)


def cumulative_to_delta(snapshots: DataFrame, keys: list[str], order: str, counters: list[str]) -> DataFrame:
    """What each snapshot of running totals adds to the one before; never below zero, and none that adds no tokens."""
    s = Sliced(snapshots, keys, [order])
    w = s.within()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    here = s.rows.withColumns({f"_lag_{c}": F.lag(zero(c)).over(w) for c in counters})
    both = s.carry(here, {f"_last_{c}": (F.max_by(zero(c), F.col(order)), "last") for c in counters})
    out = both.withColumns({f"delta_{c}": F.greatest(zero(c) - F.coalesce(f"_lag_{c}", f"_last_{c}", F.lit(0)), F.lit(0)) for c in counters})
    out = out.drop(SLICE, *(f"_{k}_{c}" for k in ("lag", "last") for c in counters))
    return out.where(reduce(lambda a, b: a + b, (F.col(f"delta_{c}") for c in counters)) > 0)
