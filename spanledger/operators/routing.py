"""Rollups of routing events, model escalations within sessions, and attribution of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import scaled_round
from ..schema import is_billable, is_quota, needs_price, total_tokens
from .ordered import numbered

OBSERVED = ["retries", "escalations", "review_defects"]


def aggregates(events: DataFrame) -> DataFrame:
    """By agent, model and provider: tasks by what their cost stands on, observed counts, passes and failures."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    priced = is_billable() & F.col("cost").isNotNull()
    free = F.col("cost_status").isin("free", "local")
    return events.groupBy("agent", "model", "provider").agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("tokens").alias("tokens"), scaled_round(F.coalesce(F.sum(F.when(priced, F.col("cost"))), F.lit(0.0)), 6).alias("cost"), n(priced).alias("priced_tasks"),
        n(~priced & ~free & ~is_quota()).alias("unpriced_tasks"), n(is_quota()).alias("quota_tasks"), n(free).alias("free_tasks"),
        *(x for c in OBSERVED for x in (F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_observed"), n(F.col(c) > 0).alias(f"{c}_affected"))),
        n(F.col("test_result")).alias("passes"), n(~F.col("test_result")).alias("failures"),
    )


def basis() -> Column:
    """What a cost per success stands on; the gravest reason counts."""
    unpriced, quota, priced = (F.col(f"{c}_tasks") for c in ("unpriced", "quota", "priced"))
    return (
        F.when(F.col("passes") == 0, "no_successes").when((unpriced > 0) & (priced == 0), "unpriced").when(unpriced > 0, "floor")
        .when((quota > 0) & (priced == 0), "quota").when(quota > 0, "plus_quota").when(priced > 0, "exact").otherwise("free")
    )


def rates(agg: DataFrame) -> DataFrame:
    """Rates over what was observed, null over nothing; the cost per success only where it is a figure."""
    out = agg.withColumn("basis", basis())
    per = F.when(F.col("basis") == "free", F.lit(0.0)).when(F.col("basis") == "exact", scaled_round(F.try_divide("cost", "passes"), 6))
    pct = lambda part, whole: scaled_round(F.try_divide(part * 100.0, whole), 4)
    return out.select(
        "agent", "model", "provider", "basis", per.alias("cost_per_success"), pct(F.col("passes"), F.col("passes") + F.col("failures")).alias("success_rate"), *(pct(F.col(f"{c}_affected"), F.col(f"{c}_observed")).alias(f"{c}_rate") for c in OBSERVED)
    )


def withheld_by_reason(tally: DataFrame, since: int | None = None) -> DataFrame:
    """Runs by reason, most first; a day counts if its last second is in range."""
    kept = tally if since is None else tally.where(F.col("day") + 86399 >= since)
    return kept.groupBy("reason").agg(F.sum("runs").alias("runs")).orderBy(F.desc("runs"), "reason")


def escalation_rows(usage: DataFrame, rate: DataFrame) -> DataFrame:
    """Rows of sessions with several rows, beside the session's opening model and both rates.

    The opener is found by aggregation (undated rows come first), not by a window over the session, so that one long
    session is no long task.
    """
    rows = usage.where("session_id is not null").select("session_id", "seq", "created", "model", "requests", "cost", "cost_status")
    opened = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("created", "seq", "model")).alias("o")).where("n >= 2")
    opened = opened.select("session_id", F.col("o.seq").alias("open_seq"), F.col("o.model").alias("opening"))
    named = opened.join(rate.select(F.col("model").alias("opening"), F.col("rate").alias("open_rate")), "opening", "left")
    return rows.join(named, "session_id").join(rate, "model", "left")


def escalations(usage: DataFrame, rate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counters: one row, transitions by opening and priciest model).

    A change to or from a model without rate can't be ranked and is counted. The priciest model reached counts, the
    first of equals; each row above the opening rate counts once.
    """
    rows = escalation_rows(usage, rate)
    later = (F.col("seq") != F.col("open_seq")) & (F.col("model") != F.col("opening"))
    above = later & (F.col("rate") > F.col("open_rate"))
    unknown = later & (F.col("open_rate").isNull() | F.col("rate").isNull())
    per = rows.groupBy("session_id", "opening").agg(
        F.sum(F.when(unknown, 1).otherwise(0)).alias("unclassified"), F.max(F.when(above, F.struct("rate", (-F.col("created")).alias("a"), (-F.col("seq")).alias("b"), "model"))).getField("model").alias("to"),
        F.coalesce(F.sum(F.when(above & is_billable(), F.col("cost"))), F.lit(0.0)).alias("cost_after"), F.sum(F.when(above & is_quota(), F.col("requests")).otherwise(0)).alias("quota_after"),
        F.sum(F.when(above & needs_price() & ~is_billable(), F.col("requests")).otherwise(0)).alias("unpriced_after"),
    )
    counters = per.agg(F.count(F.lit(1)).alias("sessions_examined"), F.count("to").alias("sessions_escalated"), F.coalesce(F.sum("unclassified"), F.lit(0)).alias("unclassified_changes"))
    moves = per.where("to is not null").groupBy(F.col("opening").alias("from_model"), F.col("to").alias("to_model")).agg(
        F.count(F.lit(1)).alias("sessions"), scaled_round(F.sum("cost_after"), 6).alias("cost_after"), F.sum("unpriced_after").alias("unpriced_after"), F.sum("quota_after").alias("quota_after")
    )
    return counters, moves.orderBy(F.desc("sessions"), F.desc("cost_after"), "from_model", "to_model")


def attribution(usage: DataFrame, session: str, skip: int) -> DataFrame:
    """One row over the requests of a session after the first `skip`: requests, tokens, cost and status.

    Differing statuses, or a billable one without cost, make the whole unavailable.
    """
    tail = numbered(usage.where(F.col("session_id") == session), ["session_id"], ["seq"], "_n").where(F.col("_n") > skip)
    sums = tail.agg(
        F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum(total_tokens()), F.lit(0)).alias("tokens"), F.sum("cost").alias("cost"), F.count_distinct("cost_status").alias("k"), F.max("cost_status").alias("s"),
        F.sum(F.when(is_billable() & F.col("cost").isNull(), 1).otherwise(0)).alias("open"),
    )
    sure = (F.col("k") == 1) & (F.col("open") == 0)
    return sums.select("requests", "tokens", F.when(sure, scaled_round(F.col("cost"), 6)).alias("cost"), F.when(sure, F.col("s")).otherwise("unavailable").alias("cost_status"))


def hook_activity(recorded: DataFrame, withheld: DataFrame, prefix: str) -> DataFrame:
    """Runs recorded and withheld of the agents whose name begins with prefix."""
    a = recorded.where(F.col("agent").startswith(prefix)).agg(F.count(F.lit(1)).alias("recorded"))
    b = withheld.where(F.col("agent").startswith(prefix)).agg(F.coalesce(F.sum("runs"), F.lit(0)).alias("withheld"))
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def attributed_requests(events: DataFrame, prefix: str) -> DataFrame:
    """One row: the requests already attributed to events whose id begins with prefix (taken literally) and that have tokens."""
    mine = F.col("event_id").startswith(prefix) & (F.col("tokens") > 0)
    return events.agg(F.coalesce(F.sum(F.when(mine, F.col("requests"))), F.lit(0)).alias("attributed"))


def routing_events(observed: DataFrame, usage: DataFrame, session: str, skip: int, phase: str = "implement") -> DataFrame:
    """A routing event of an observed test run: what was used since the last one, beside its verdict."""
    spent = attribution(usage, session, skip).withColumnRenamed("cost_status", "status").withColumn("_one", F.lit(1))
    seen = observed.where(F.col("passed").isNotNull()).select("session_id", "tool_use_id", "agent_type", "passed").withColumn("_one", F.lit(1))
    return seen.join(spent, "_one").select(
        F.concat_ws(":", "session_id", "tool_use_id").alias("event_id"), F.col("session_id").alias("task"), F.lit(phase).alias("phase"), F.coalesce("agent_type", F.lit("main")).alias("agent"), F.col("requests"), F.col("tokens"), "cost",
        F.col("status").alias("cost_status"), F.col("passed").alias("test_result"),
    )
