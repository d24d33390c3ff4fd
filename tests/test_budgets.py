"""Budgets, models and alerts beyond the bounds that once cut them off."""

from spanledger.operators import export, usage

USAGE = "provider string, model string, cost_status string, requests long, input long, output long, reasoning long, cache_read long, cache_write long, cost double, api_equivalent_cost double, created long, session_id string"
BUDGETS = "name string, scope string, scope_name string, since long, limit double, warn_pct double, critical_pct double"


def test_more_starts_than_a_thousand(spark):
    spent = [(s, 1.0) for s in (5, 500, 999, 1000, 1050, 1099, 2000)]
    rows = spark.createDataFrame([("P", "m", "reported", 1, 1, 0, 0, 0, 0, c, None, s, None) for s, c in spent], USAGE)
    starts = [*range(1, 1101), None]
    budgets = spark.createDataFrame([(f"b{s}", "provider" if s and s % 2 else "global", "p" if s and s % 2 else None, s, 100.0, 75.0, 90.0) for s in starts], BUDGETS)
    got = {r["name"]: r["spend"] for r in usage.budget_status(rows, budgets).collect()}
    assert got == {f"b{s}": sum(c for at, c in spent if s is not None and at >= s) for s in starts}


def test_record_and_alerts_are_whole(spark):
    rows = spark.createDataFrame([("p", f"m{i}", "reported", 1, i, 0, 0, 0, 0, 1.0, None, 86400, "s") for i in range(1, 61)], USAGE)
    status = spark.createDataFrame([(f"b{i:04}", 80.0, "warn") for i in range(1001)], "name string, pct double, level string")
    budgets = [{"name": r["name"], "scope": "global", "scope_name": None, "period": "daily", "limit": 100.0, "spend": 80.0, "unpriced_requests": 0, "quota_requests": 0, "priced_requests": 1} for r in status.collect()]
    record = export.desktop_record(rows, budgets, 1)
    assert {m: u["inputTokens"] for m, u in record["modelUsage"].items()} == {f"m{i}": i for i in range(1, 61)} and len(record["limits"]) == 1001
    assert len(export.check_budgets(status)[0]) == 1001
