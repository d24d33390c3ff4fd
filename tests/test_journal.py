"""The journal: strict, idempotent, prunable."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from spanledger.functions import scalars
from spanledger.operators import export, journal, routing
from spanledger.operators.journal import Journal, Refused
from spanledger.schema import USAGE_SCHEMA

NOW = 1_780_000_000


def frame(spark, *events):
    return spark.createDataFrame([(e if isinstance(e, str) else json.dumps(e),) for e in events], "line string")


def event(**more):
    return {"event_id": "e", "provider": "p", "model": "m", "input_tokens": 1, "output_tokens": 2} | more


@pytest.mark.parametrize("bad", [
    "[]", "{", event(extra=1), event(input_tokens="3"), event(input_tokens=1.5), event(output_tokens=-1), event(cache_read_tokens=1e300), {k: v for k, v in event().items() if k != "event_id"}, event(cost_status="estimated"), event(billing="free"), event(cost=-1), event(cost="1"),
    event(cost=1, billing="subscription"), event(model=None),
])
def test_bad_events_refuse_the_batch(spark, tmp_path, bad):
    j = Journal(spark, str(tmp_path / "j"))
    with pytest.raises(Refused):
        j.record_events(frame(spark, event(event_id="good"), bad), NOW)
    assert j.read("usage").count() == 0


def test_record_is_idempotent(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"))
    assert j.record_events(frame(spark, event(cost=0.5, created=1_700_000_000_000), event(event_id="f", input_tokens=1200.0), event(event_id="f")), NOW) == 2
    assert j.record_events(frame(spark, event(), event(event_id="g", billing="subscription")), NOW) == 1
    got = {r["event_id"]: (r["cost_status"], r["created"], r["input"]) for r in j.read("usage").collect()}
    assert got == {"e": ("reported", 1_700_000_000, 1), "f": ("unavailable", NOW, 1200), "g": ("quota", NOW, 1)}
    seqs = [r["seq"] for r in j.read("usage").collect()]
    assert len(set(seqs)) == 3 and j.read("usage", after=min(seqs)).count() == 2


def test_routing_and_tally(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"))
    schema = "event_id string, task string, phase string, agent string, model string, provider string, category string, cost_status string, requests long, tokens long, created long, cost double, retries int, escalations int, review_defects int, test_result boolean"
    row = lambda **m: spark.createDataFrame([{"event_id": "s1:1", "task": "t", "agent": "a", "model": "m", **m}], schema)
    assert j.record_routing(row(cost=1.0)) == 1 and j.record_routing(row(cost=1.0)) == 0
    assert tuple(j.read("routing").select("phase", "cost_status", "retries").first()) == ("implement", "reported", None)
    with pytest.raises(Refused):
        j.record_routing(row(event_id="x", retries=-1))
    j.tally("a", "pipe", NOW)
    j.tally("a", "pipe", NOW + 5)
    assert [tuple(r) for r in j.tallies().collect()] == [(NOW - NOW % 86400, "a", "pipe", 2)]


def test_prune(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"))
    day = 86400
    rows = [(i, f"e{i}", "p", "m", "PAID", "reported", "per_token", 1, 1, 0, 0, 0, 0, 1.0, None, c, None, None, False) for i, c in enumerate([NOW - 200 * day, NOW - 100 * day, 0, NOW - 90 * day])]
    j.record_usage(spark.createDataFrame(rows, USAGE_SCHEMA))
    with pytest.raises(Refused):
        j.prune(NOW - 5 * day, NOW)
    assert j.prune(NOW - 80 * day, NOW)["usage"] == 2
    assert {r["event_id"] for r in j.read("usage").collect()} == {"e2", "e3"}  # undated, and the newest


def test_prune_of_sessions_and_tallies(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"))
    old, new, cut = NOW - 200 * 86400, NOW - 10 * 86400, NOW - 80 * 86400
    ids = [("claude-code:a:1", old), ("claude-code:a:2", new), ("claude-code:b:1", old), ("other:a:1", old), (None, old), ("claude-code:c", old), ("x", 0)]
    rows = spark.createDataFrame([(i, "t", "a", "m", c) for i, c in ids], "event_id string, task string, agent string, model string, created long")
    assert {r["event_id"] for r in journal.kept_routing(rows, cut, "claude-code").collect()} == {"claude-code:a:1", "claude-code:a:2", "x"}
    j.tally("a", "pipe", old)
    j.tally("a", "pipe", new)
    j.prune(cut, NOW)
    assert [r["day"] for r in j.tallies().collect()] == [new - new % 86400]


def test_crash_between_renames(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"))
    j.tally("a", "pipe", NOW)
    (tmp_path / "j" / "tally").rename(tmp_path / "j" / "tally.old")
    assert Journal(spark, str(tmp_path / "j")).tallies().count() == 1 and not (tmp_path / "j" / "tally.old").exists()


def test_scan(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"))
    rows = [(i, f"e{i}", "p", "m", cat, status, bill, 1, tokens, 0, 0, 0, 0, cost, None, NOW, None, None, False) for i, (cat, status, bill, tokens, cost) in enumerate([("PAID", "quota", "subscription", 1, None), ("odd", "odd", "odd", -5, 1.0), ("PAID", "quota", "per_token", 1, None)])]
    j.record_usage(spark.createDataFrame(rows, USAGE_SCHEMA))
    got = {r["event_id"]: (r["category"], r["cost_status"], r["billing"], r["input"]) for r in j.scan_usage().collect()}
    assert got == {"e0": ("PAID", "unavailable", "subscription", 1), "e1": ("UNKNOWN", "unavailable", "per_token", 0), "e2": ("PAID", "quota", "per_token", 1)}
    top = max(r["seq"] for r in j.read("usage").collect())
    assert j.scan_usage(after=top).count() == 0 and j.scan_usage(after=top + 5).count() == 3


def test_lock_and_version(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"), wait=0.1)
    (tmp_path / "j" / "lock").write_text("")
    with pytest.raises(Refused):
        j.tally("a", "b", NOW)
    (tmp_path / "j" / "version.json").write_text(json.dumps({"version": journal.VERSION + 1}))
    with pytest.raises(Refused):
        Journal(spark, str(tmp_path / "j"))


def test_older_files_lack_columns(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"))
    spark.createDataFrame([(1, "e", "m")], "seq long, event_id string, model string").write.parquet(str(tmp_path / "j" / "usage"))
    assert j.read("usage").first()["provider"] is None


def test_exports(spark, tmp_path):
    rows = [(1, "e", "p", "=1+1", "PAID", "reported", "per_token", 1, 1, 2, 3, 4, 5, 0.25, None, NOW - 10, "s", None, False), (2, "f", "p", "-5", "PAID", "quota", "subscription", 2, 1, 0, 0, 0, 0, None, None, 0, None, "/w", False)]
    usage = spark.createDataFrame(rows, USAGE_SCHEMA)
    got = export.csv_rows(usage).orderBy("created").collect()
    assert list(got[0].asDict()) == export.CSV_COLUMNS and len(export.CSV_COLUMNS) == 15
    assert [r["model"] for r in got] == ["-5", "'=1+1"] and got[0]["cost"] == ""
    export.write_csv(usage, str(tmp_path / "csv"))
    assert json.loads(export.json_rows(usage).first()[0]).keys() == export.JSON_FIELDS.keys()
    doc = export.summary(usage, NOW, 1)
    assert doc["by_session"]["rows"][0]["requests"] + doc["by_session"]["other"]["requests"] == doc["totals"]["requests"] == 3
    assert sum(p["requests"] for p in doc["provenance"]) == 3
    assert export.validate_budget({"scope": "provider", "limit": 1}) and not export.validate_budget({"limit": 5})
    assert export.balance_budget([{"name": "a", "scope": "model"}, {"name": "b", "scope": "global", "period": "monthly"}])["name"] == "b"
    with pytest.raises(ValueError):
        export.summary(usage, NOW, 0)
    export.write_atomic(str(tmp_path / "x"), "hello")
    assert (tmp_path / "x").read_text() == "hello" and (tmp_path / "x").stat().st_mode & 0o777 == 0o600


def test_routing_exports_and_checks(spark):
    events = spark.createDataFrame([("s:%_1", "=x", "m", "p", "reported", 1, 5, 1.0, 10, None, 1, None, True), ("s:2", "a", "m", "p", "quota", 2, 5, None, 20, 0, 0, None, None)],
        "event_id string, agent string, model string, provider string, cost_status string, requests long, tokens long, cost double, created long, retries int, escalations int, review_defects int, test_result boolean")
    assert {r["agent"] for r in export.routing_rows(events).collect()} == {"'=x", "a"} and export.routing_rows(events, 15).count() == 1
    docs = [json.loads(r[0]) for r in export.routing_document(events).collect()]
    assert {(d["agent"], d["basis"], d["retries_rate"]) for d in docs} == {("=x", "exact", None), ("a", "no_successes", 0.0)}
    assert [routing.attributed_requests(events, p).first()[0] for p in ("s:", "s:%", "s:_", "")] == [3, 1, 0, 3]
    usage = spark.createDataFrame([(1, "e", "p", "m", "PAID", "reported", "per_token", 1, 1, 2, 3, 4, 5, 0.25, None, 9, "s", None, False), (2, "f", "p", "m", "PAID", "reported", "per_token", 1, 1, 0, 0, 0, 0, 0.5, None, 10, "s", None, False)], USAGE_SCHEMA)
    run = spark.createDataFrame([("s", "t", None, "observable:both", True)], "session_id string, tool_use_id string, agent_type string, verdict string, passed boolean")
    r = routing.routing_events(run, usage, "s", 1).first()
    assert (r["event_id"], r["requests"], r["cost"], r["test_result"]) == ("s:t", 1, 0.5, True)
    status = spark.createDataFrame([("b", "ok"), ("c", "warn")], "name string, level string")
    assert export.check_budgets(status) == ([{"name": "c", "level": "warn"}], 1)
    assert export.doctor([{"id": "x", "status": "ok", "rows": 3, "detail": ""}], usage, spark.createDataFrame([("usage", 2)], "table_name string, n long"))[:2] == ["x: ok, 3 rows", "journal usage: 2 rows"]
    assert export.usage_document(usage, status, status).groupBy("section").count().count() == 4
    assert export.unknown_keys({"a": 1, "b": [{"c": 1, "x": 2}], "y": {}}, {"a": None, "b": [{"c": None}]}) == [".b[].x", ".y"]
    row = spark.range(1).select(scalars.coverage_label(F.lit(99.96), F.lit(0)).alias("a"), scalars.coverage_label(F.lit(50.0), F.lit(1500)).alias("b"), scalars.coverage_label(F.lit(None).cast("double"), F.lit(7)).alias("c"), scalars.coverage_label(F.lit(None).cast("double"), F.lit(0)).alias("d")).first()
    assert tuple(row) == ("all priced", "50% priced · 1.5K on quota", "7 on quota", "")


def test_desktop_record(spark):
    day = NOW - NOW % 86400
    row = lambda i, at, session, status, cost, model="m": (i, f"e{i}", "p", model, "PAID", status, "per_token", 1, 10, 2, 3, 4, 5, cost, None, at, session, None, False)
    usage = spark.createDataFrame([row(1, day + 5, "a", "reported", 1.0), row(2, day - 5, "a", "unavailable", None), row(3, 0, None, "quota", None, "n"), row(4, day + 9, "b", "free", None)], USAGE_SCHEMA)
    budgets = [{"name": "g", "scope": "global", "scope_name": None, "period": "monthly", "limit": 50.0, "spend": 75.0, "unpriced_requests": 1, "quota_requests": 1, "priced_requests": 1, "resets_at": "x"}, {"name": "q", "scope": "model", "scope_name": "n", "period": "daily", "limit": 0.0, "spend": 0.0, "unpriced_requests": 0, "quota_requests": 1, "priced_requests": 0}]
    r = export.desktop_record(usage, budgets, NOW, balance=budgets[0])
    assert (r["todayPrompts"], r["todaySessions"], r["todayTotalTokens"], r["totalPrompts"], r["totalSessions"], r["activeDays"]) == (2, 2, 48, 4, 2, 2)
    assert r["recentDays"][-2:] == [{"date": str(datetime.fromtimestamp(day - 5, UTC).date()), "messageCount": 24}, {"date": str(datetime.fromtimestamp(day, UTC).date()), "messageCount": 48}]
    assert r["modelUsage"]["m"] == {"inputTokens": 30, "outputTokens": 15, "cacheReadInputTokens": 12, "cacheCreationInputTokens": 15} and r["todayTokensByModel"] == {"m": 48}
    assert r["limits"][0] == {"label": "Monthly budget (global)", "title": "Monthly budget", "percent": 1.0, "resetsAt": "x"} and r["limits"][1]["percent"] == 0.0
    assert r["tierLabel"] == "Budget $50/month" and r["usageStatusText"] == "Spend partly unpriced" and r["balance"]["remaining"] == 0.0
    assert r["authHelpText"] == "1 of 2 billable requests have no price; spend is a floor. global monthly: 1 budgeted requests have no price; its meter is a floor. model:n daily: all 1 requests are on quota; its meter has nothing per-token to draw."
    empty = export.desktop_record(usage.where("seq < 0"), [], NOW)
    assert not empty["ready"] and empty["tierLabel"] == "Pay as you go" and [d["messageCount"] for d in empty["recentDays"]] == [0] * 7
