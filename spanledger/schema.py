"""The usage and routing schemas, the closed vocabularies and their predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Categories and cost statuses in their order.
CATEGORIES = ["LOCAL", "FREE", "PAID", "CLOUD", "UNKNOWN"]
COST_STATUSES = ["reported", "calculated", "estimated", "free", "local", "quota", "unavailable"]
BILLABLE = ["reported", "calculated", "estimated"]
TOKEN_BUCKETS = ["input", "output", "reasoning", "cache_read", "cache_write"]
#: Counts are whole numbers below this, or refused.
MAX_COUNT = 2**53

_f = T.StructField
USAGE_SCHEMA = T.StructType([
    _f("seq", T.LongType()), _f("event_id", T.StringType()), _f("provider", T.StringType()), _f("model", T.StringType()), _f("category", T.StringType()), _f("cost_status", T.StringType()), _f("billing", T.StringType()),
    _f("requests", T.LongType()), *(_f(c, T.LongType()) for c in TOKEN_BUCKETS), _f("cost", T.DoubleType()), _f("api_equivalent_cost", T.DoubleType()), _f("created", T.LongType()),
    _f("session_id", T.StringType()), _f("project", T.StringType()), _f("incomplete", T.BooleanType()),
])
ROUTING_SCHEMA = T.StructType([
    *(_f(c, T.StringType()) for c in ("event_id", "task", "phase", "agent", "model", "provider", "category", "cost_status")), _f("requests", T.LongType()), _f("tokens", T.LongType()), _f("created", T.LongType()),
    _f("cost", T.DoubleType()), _f("retries", T.IntegerType()), _f("escalations", T.IntegerType()), _f("review_defects", T.IntegerType()), _f("test_result", T.BooleanType()),
])


def is_billable(status: str = "cost_status") -> Column:
    return F.col(status).isin(BILLABLE)


def is_free_or_local(status: str = "cost_status") -> Column:
    return F.col(status).isin("free", "local")


def is_quota(status: str = "cost_status") -> Column:
    return F.col(status) == "quota"


def needs_price(status: str = "cost_status") -> Column:
    return ~F.col(status).isin("free", "local", "quota")


def is_known(status: str = "cost_status") -> Column:
    return F.col(status) != "unavailable"


def ordinal(column: Column, order: list[str]) -> Column:
    """The place of a label in its vocabulary; labels outside it come last."""
    out = F.lit(len(order))
    for i, label in reversed(list(enumerate(order))):
        out = F.when(column == label, i).otherwise(out)
    return out


def known_label(column: Column, vocabulary: list[str], fallback: str) -> Column:
    """A label of the vocabulary; any other, and null, degrades to the pessimistic one."""
    return F.when(column.isin(vocabulary), column).otherwise(fallback)


def total_tokens() -> Column:
    return sum((F.col(c) for c in TOKEN_BUCKETS[1:]), F.col(TOKEN_BUCKETS[0]))
