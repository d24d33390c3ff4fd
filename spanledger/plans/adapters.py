"""Frames of the usage model from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import limits, stamps
from ..session import table
from .stamp_sql import stamped

NOW = 1_780_000_000  # 2026-05-28, inside the tables' time
DAY_START = NOW - NOW % 86400


def usage(spark: SparkSession, d: str) -> DataFrame:
    """usage_event as usage rows for queries that don't read `created`: seq is id, and there is no created."""
    return _usage(table(spark, d, "usage_event"), F.lit(None)).drop("created")


def usage_dated(spark: SparkSession, d: str) -> DataFrame:
    """usage() with created, the second that the event's own stamp names, or 0 where it is undated or unresolved."""
    read = stamps.normalise(table(spark, d, "usage_event").withColumn("_from", F.lit("usage_event.created")), table(spark, d, "host_clock"), "created", "host_id", "_from")
    return _usage(read, F.coalesce(F.floor(F.col("stamp_micros") / 1_000_000), F.lit(0)))


def _usage(u: DataFrame, created: Column) -> DataFrame:
    bill = F.when(F.lower(F.trim("billing")).startswith("sub"), "subscription").otherwise("per_token")
    return u.select(
        F.col("id").alias("seq"), F.when(F.col("event_id") != "", F.col("event_id")).alias("event_id"), "provider", "model", F.upper("category").alias("category"), "cost_status", bill.alias("billing"),
        F.coalesce("requests", F.lit(0)).alias("requests"), *(F.coalesce(f"{c}_tokens", F.lit(0)).alias(c) for c in ("input", "output", "reasoning", "cache_read", "cache_write")), "cost", F.lit(None).cast("double").alias("api_equivalent_cost"),
        created.cast("long").alias("created"), "session_id", "project", F.col("input_tokens").isNull().alias("incomplete"),
    )


_USAGE_SQL = """
usage AS (
  SELECT id AS seq, nullif(event_id, '') AS event_id, provider, model, upper(category) AS category, cost_status,
    CASE WHEN lower(trim(billing)) LIKE 'sub%' THEN 'subscription' ELSE 'per_token' END AS billing, coalesce(requests, 0) AS requests,
    coalesce(input_tokens, 0) AS input, coalesce(output_tokens, 0) AS output, coalesce(reasoning_tokens, 0) AS reasoning,
    coalesce(cache_read_tokens, 0) AS cache_read, coalesce(cache_write_tokens, 0) AS cache_write, cost,{created} session_id, project, input_tokens IS NULL AS incomplete,
    coalesce(input_tokens, 0) + coalesce(output_tokens, 0) + coalesce(reasoning_tokens, 0) + coalesce(cache_read_tokens, 0) + coalesce(cache_write_tokens, 0) AS tokens,
    cost_status IN ('reported', 'calculated', 'estimated') AS billable, cost_status IN ('reported', 'calculated', 'estimated') AND cost IS NOT NULL AS priced,
    cost_status NOT IN ('free', 'local', 'quota') AS needs_price, cost_status = 'quota' AS on_quota
  FROM {source})"""
USAGE_SQL = _USAGE_SQL.format(created="", source="usage_event")
DATED_SQL = stamped("read", "SELECT id AS k, created AS raw, host_id FROM usage_event") + "," + _USAGE_SQL.format(created=" coalesce(r.micros // 1000000, 0) AS created,", source="usage_event e LEFT JOIN read r ON r.k = e.id")

COUNTERS_SQL = """cast(coalesce(sum(requests), 0) AS BIGINT) AS requests, cast(coalesce(sum(input), 0) AS BIGINT) AS input, cast(coalesce(sum(output), 0) AS BIGINT) AS output,
    cast(coalesce(sum(reasoning), 0) AS BIGINT) AS reasoning, cast(coalesce(sum(cache_read), 0) AS BIGINT) AS cache_read, cast(coalesce(sum(cache_write), 0) AS BIGINT) AS cache_write,
    coalesce(sum(cost) FILTER (priced), 0.0) AS cost, cast(coalesce(sum(requests) FILTER (priced), 0) AS BIGINT) AS priced_requests,
    cast(coalesce(sum(requests) FILTER (needs_price AND NOT priced), 0) AS BIGINT) AS unpriced_requests, cast(coalesce(sum(requests) FILTER (on_quota), 0) AS BIGINT) AS quota_requests"""


def routing(spark: SparkSession, d: str) -> DataFrame:
    """orders as routing events: a task an order, its agent by priority, its result by status, counters null on a modulus."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*(F.lit(x) for x in ("reported", "estimated", "quota", "unavailable", "free", "calculated"))), (k % 6 + 1).cast("int"))
    return o.select(
        k.cast("string").alias("event_id"), F.col("o_orderpriority").alias("agent"), F.concat(F.lit("model-"), (F.col("o_custkey") % 4).cast("string")).alias("model"), F.concat(F.lit("host-"), (F.col("o_custkey") % 2).cast("string")).alias("provider"),
        status.alias("cost_status"), F.floor("o_totalprice").cast("long").alias("tokens"), F.when(k % 7 != 0, F.floor("o_totalprice") / 100000.0).alias("cost"), F.when(k % 3 != 0, k % 4).alias("retries"), F.when(k % 5 != 0, k % 2).alias("escalations"),
        F.when(k % 11 == 0, k % 3).alias("review_defects"), F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False).alias("test_result"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created"),
    )


ROUTING_SQL = """
routing AS (
  SELECT cast(o_orderkey AS VARCHAR) AS event_id, o_orderpriority AS agent, 'model-' || cast(o_custkey % 4 AS VARCHAR) AS model, 'host-' || cast(o_custkey % 2 AS VARCHAR) AS provider,
    (['reported', 'estimated', 'quota', 'unavailable', 'free', 'calculated'])[o_orderkey % 6 + 1] AS cost_status, cast(floor(o_totalprice) AS BIGINT) AS tokens,
    CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice) / 100000.0 END AS cost, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 4 END AS retries,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 2 END AS escalations, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey % 3 END AS review_defects,
    CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS test_result, cast(floor(epoch(o_orderdate)) AS BIGINT) AS created
  FROM orders)"""


def tally(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as a tally of withheld runs: day, agent and reason with its runs."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("day"), F.col("l_linestatus").alias("agent"), F.col("l_returnflag").alias("reason")).agg(F.count(F.lit(1)).alias("runs"))


TALLY_SQL = "tally AS (SELECT cast(floor(epoch(l_shipdate)) AS BIGINT) AS day, l_linestatus AS agent, l_returnflag AS reason, count(*) AS runs FROM lineitem GROUP BY ALL)"


STALE_AFTER = 6 * 3600


def windows(spark: SparkSession, d: str, now: int = NOW) -> DataFrame:
    """limit_record as limit windows by its own stamps: an agent a panel and host, stale by updated_at, reset at resets_at.

    An undated or unresolved resets_at is no known reset. seq is limit_id.
    """
    clock = table(spark, d, "host_clock")
    r = table(spark, d, "limit_record").withColumns({"_u": F.lit("limit_record.updated_at"), "_r": F.lit("limit_record.resets_at")})
    at = stamps.normalise(r, clock, "updated_at", "host_id", "_u").withColumn("_updated", F.floor(F.col("stamp_micros") / 1_000_000))
    both = stamps.normalise(at, clock, "resets_at", "host_id", "_r").withColumn("_resets", F.floor(F.col("stamp_micros") / 1_000_000))
    stale = limits.is_stale(F.lit(now) - F.col("_updated"), STALE_AFTER)
    return both.select(F.concat_ws("/", "panel", "host_id").alias("agent"), F.coalesce("title", "label").alias("label"), limits.fraction(F.col("percent_used")).alias("fraction"), stale.alias("stale"), F.col("_updated").cast("long").alias("updated_at"), F.col("_resets").cast("long").alias("resets_at"), F.col("limit_id").alias("seq"), "ready")


WINDOWS_SQL = (
    stamped("updated", "SELECT limit_id AS k, updated_at AS raw, host_id FROM limit_record") + "," + stamped("resets", "SELECT limit_id AS k, resets_at AS raw, host_id FROM limit_record")
    + f""",
windows AS (
  SELECT concat_ws('/', panel, host_id) AS agent, coalesce(title, label) AS label, CASE WHEN percent_used >= 0 AND NOT isnan(percent_used) THEN least(percent_used, 1.0) END AS fraction,
    u.micros IS NULL OR {NOW} - u.micros // 1000000 > {STALE_AFTER} OR {NOW} - u.micros // 1000000 < -60 AS stale, u.micros // 1000000 AS updated_at, r.micros // 1000000 AS resets_at, limit_id AS seq, ready
  FROM limit_record l LEFT JOIN updated u ON u.k = l.limit_id LEFT JOIN resets r ON r.k = l.limit_id)"""
)

# Example dimensions, as parameters of the queries; not anyone's prices.
RATES = [
    ("sable-1:70b", True, False, 3.0, 15.0, None, 0.3, 3.75), ("glint-1-pro", True, False, 1.0, 5.0, 6.0, 0.1, 1.25), ("harrow-1-free", False, True, None, None, None, None, None), ("anthropic/marrow-1", False, False, 6.0, 22.5, None, 0.6, 7.5),
    ("marrow-1", False, False, 5.0, 20.0, None, None, 6.0), ("tessel-1-mini", False, False, 0.25, 1.25, None, 0.025, 0.3), ("cobble-1", False, False, 2.0, 8.0, None, 0.5, None), ("lumen-1", True, False, 0.5, 2.5, None, 0.05, 0.6),
    ("gemini/lumen-2", False, False, 0.7, 2.8, None, 0.07, 0.7), ("quillon-1:7b", False, False, 4.0, 16.0, None, 0.4, 5.0),
]
TIERS = [("sable-1:70b", 2000, 6.0, 22.5, 0.6, 7.5), ("sable-1:70b", 10000, 9.0, 30.0, None, None), ("lumen-1", 5000, 1.0, 5.0, 0.1, 1.2)]
PERIODS = [("glint-1-pro", "2025-12-31", 2.0, 10.0), ("glint-1-pro", "2026-03-31", 1.5, 7.5), ("cobble-1", "2026-01-31", 4.0, 16.0)]
BUDGETS = [
    ("all-month", "global", None, NOW - 30 * 86400, 50.0, 75.0, 90.0), ("all-day", "global", None, DAY_START, 1.0, 75.0, 90.0), ("anthropic", "provider", "Anthropic", NOW - 30 * 86400, 12.0, 50.0, 80.0),
    ("sable", "model", "SABLE-1:70B", NOW - 30 * 86400, 4.0, 75.0, 90.0), ("unused", "provider", "nobody", DAY_START, 5.0, 75.0, 90.0),
]


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, "key string, curated boolean, free boolean, r_input double, r_output double, r_reasoning double, r_cache_read double, r_cache_write double")


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*t[:4], None, *t[4:]) for t in TIERS], "key string, threshold long, r_input double, r_output double, r_reasoning double, r_cache_read double, r_cache_write double")


def periods(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(*p, None, None, None) for p in PERIODS], "key string, through string, r_input double, r_output double, r_reasoning double, r_cache_read double, r_cache_write double")
    return df.withColumn("through", F.to_date("through"))


def budgets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUDGETS, "name string, scope string, scope_name string, since long, limit double, warn_pct double, critical_pct double")


def _literal(value) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else f"'{value}'" if isinstance(value, str) else f"cast({value!r} AS DOUBLE)" if isinstance(value, float) else str(value)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of literal rows."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"


RATES_SQL = values("rates", "key, curated, free, r_input, r_output, r_reasoning, r_cache_read, r_cache_write", RATES)
TIERS_SQL = values("tiers", "key, threshold, t_input, t_output, t_cache_read, t_cache_write", TIERS)
PERIODS_SQL = values("periods", "key, through, p_input, p_output", PERIODS)
BUDGETS_SQL = values("budgets", 'name, scope, scope_name, since, "limit", warn_pct, critical_pct', BUDGETS)
