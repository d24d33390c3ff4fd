"""Readers against small logs and stores written here."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from spanledger.schema import MAX_COUNT, TOKEN_BUCKETS
from spanledger.sources import config, lines, registry, stores, telemetry

SECRET = "do not show this text"


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def assistant(rid, out=10, model="m-1", **usage):
    return {"requestId": rid, "uuid": "u" + str(rid), "timestamp": "2026-01-02T03:04:05.5Z", "sessionId": "s1", "cwd": "/work/a/", "message": {"id": "x", "role": "assistant", "model": model, "content": SECRET, "usage": {"input_tokens": 5, "output_tokens": out, **usage}}}


def test_transcripts(spark, tmp_path):
    write(tmp_path / "t" / "a.jsonl", [assistant("r1"), assistant("r1", 20), assistant("r2", model="<synthetic>"), assistant("r3", 0, input_tokens=0), assistant(None, output_tokens=None), assistant("r4", cache_read_input_tokens=1.5), {"message": {"role": "user", "content": SECRET, "usage": None}}, '{"broken": "usage'])
    rows = lines.transcript_usage(lines.read_lines(spark, str(tmp_path / "t")))
    got = {(r["event_id"], r["output"], r["incomplete"]) for r in rows.collect()}
    assert got == {("r1", 10, False), ("r1", 20, False), ("x", 0, True), ("r4", 10, False)}
    first = rows.where("event_id = 'r4'").first()
    assert (first["project"], first["created"], first["cache_read"]) == ("/work/a", 1767323045, 0)
    assert SECRET not in str(rows.collect())
    told = lines.skipped(lines.read_lines(spark, str(tmp_path / "t")), lines.TRANSCRIPT, F.col("r.timestamp").isNull()).first()
    assert (told["lines"], told["malformed"], told["undated"]) == (8, 1, 1)


HOSTILE = [None, True, "3", "", -1, 1.5, 1e308, 2**60, [], {}, "x" * 10]


@pytest.mark.parametrize("key", ["input_tokens", "output_tokens", "cache_read_input_tokens"])
def test_hostile_counts(spark, tmp_path, key):
    write(tmp_path / "t" / "a.jsonl", [assistant(f"r{i}", **{key: v}) for i, v in enumerate(HOSTILE)])
    rows = lines.transcript_usage(lines.read_lines(spark, str(tmp_path / "t"))).collect()
    assert len(rows) == len(HOSTILE)
    assert all(0 <= r[c] <= MAX_COUNT for r in rows for c in TOKEN_BUCKETS)


def call(n, total, cached=0, reasoning=0):
    return {"type": "event_msg", "timestamp": f"2026-01-02T00:00:{n:02d}Z", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 100, "cached_input_tokens": cached, "output_tokens": 50, "reasoning_output_tokens": reasoning, "total_tokens": 150}, "total_token_usage": {"total_tokens": total}}, "rate_limits": {"limit_id": "main", "primary": {"used_percent": n, "window_minutes": 300, "resets_at": 99}}}}


def test_rollouts(spark, tmp_path):
    write(tmp_path / "r" / "x.jsonl", [
        {"type": "session_meta", "payload": {"id": "S", "cwd": "/meta"}}, {"type": "turn_context", "payload": {"model": "g-1"}}, call(1, 150, cached=40, reasoning=20), call(2, 150), {"type": "session_meta", "payload": {"id": "other"}},
        {"type": "turn_context", "payload": {"model_slug": "g-2", "cwd": "/turn"}}, call(3, 300), call(4, 500),
    ])
    read = lines.read_lines(spark, str(tmp_path / "r"))
    got = [(r["event_id"], r["model"], r["project"], r["input"], r["output"], r["reasoning"], r["cache_read"]) for r in lines.rollout_usage(read).orderBy("created").collect()]
    t = "codex:2026-01-02T00:00:0"
    assert got == [(t + "1Z:150:150", "g-1", "/meta", 60, 30, 20, 40), (t + "3Z:150:300", "g-2", "/turn", 100, 50, 0, 0), (t + "4Z:150:500", "g-2", "/turn", 100, 50, 0, 0)]
    assert [tuple(r) for r in lines.rollout_limits(read).select("limit_id", "window", "used_percent", "minutes").collect()] == [("main", "primary", 4.0, 300)]


def test_forks_estimates_and_old_layouts(spark, tmp_path):
    zero = call(5, 900) | {"payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 0, "output_tokens": 0, "total_tokens": 400}, "total_token_usage": {"total_tokens": 900}}}}
    gone = call(6, 950) | {"payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 7, "total_tokens": 7}}}}
    old = {"type": "response_item", "timestamp": "2026-01-02T00:00:07Z", "payload": {"payload": call(7, 960)["payload"]}}
    write(tmp_path / "r" / "a-11111111-2222-3333-4444-555555555555_x.jsonl", [call(1, 150), zero, gone, old])
    write(tmp_path / "r" / "b-11111111-2222-3333-4444-666666666666.jsonl", [call(1, 150), call(8, 300)])
    rows = lines.rollout_usage(lines.read_lines(spark, str(tmp_path / "r"))).collect()
    ids = sorted(r["event_id"] for r in rows)
    assert [i.split("Z")[1] for i in ids] == [":150:150", ":150:150", ":7:0", ":150:960", ":150:300"]
    assert {r["incomplete"] for r in rows if r["input"] == 7} == {True} and "11111111-2222-3333-4444-555555555555" in {r["session_id"] for r in rows}


def test_snapshots(spark, tmp_path):
    shut = lambda n, i: {"type": "session.shutdown", "timestamp": "2026-01-01T00:00:00Z", "data": {"modelMetrics": {"a": {"requests": {"count": n}, "usage": {"inputTokens": i, "outputTokens": 1}}}}}
    write(tmp_path / "c" / "l.jsonl", [shut(2, 10), shut(2, 10), shut(5, 30), shut(6, 5)])
    got = [(r["requests"], r["input"], r["output"]) for r in lines.snapshot_usage(lines.read_lines(spark, str(tmp_path / "c"))).orderBy("input").collect()]
    assert got == [(2, 10, 1), (3, 20, 0)]
    assert [r["event_id"] for r in lines.snapshot_usage(lines.read_lines(spark, str(tmp_path / "c"))).orderBy("input").collect()] == ["copilot:shutdown:c:a:11", "copilot:shutdown:c:a:31"]


def test_telemetry(spark, tmp_path):
    made = lambda status, name="gemini_cli.api_response": json.dumps({"attributes": {"event.name": name, "event.timestamp": "2026-01-01T00:00:00Z", "model": 'm"}{', "status_code": status, "prompt_id": "p", "session.id": "s", "input_token_count": 10, "cached_content_token_count": 4, "output_token_count": 2, "total_token_count": 12}}, indent=1)
    (tmp_path / "t.json").write_text(made(200) + made(None) + "\n" + made(500) + made(200, "other") + '{"open": "')
    objects = telemetry.read_objects(spark, str(tmp_path / "t.json"))
    assert objects.count() == 4
    rows = telemetry.telemetry_usage(objects).collect()
    assert [(r["model"], r["input"], r["cache_read"], r["event_id"]) for r in rows] == [('m"}{', 6, 4, "gemini:p:2026-01-01T00:00:00Z:12")] * 2


def test_telemetry_without_identity(spark, tmp_path):
    made = lambda **m: json.dumps({"attributes": {"event.name": "gemini_cli.api_response", "event.timestamp": "2026-01-01T00:00:00Z", "model": "m", "prompt_id": "p", "input_token_count": 1, "output_token_count": 2, "total_token_count": 3} | m}, indent=1)
    (tmp_path / "t.json").write_text(made(prompt_id=None) + made(model=" ") + made(input_token_count=0, output_token_count=0) + made(model=" a ", output_token_count=None) + '"odd { quote' + "}" + made(prompt_id='\\" {'))
    rows = telemetry.telemetry_usage(telemetry.read_objects(spark, str(tmp_path / "t.json"))).collect()
    assert [(r["event_id"], r["model"], r["incomplete"]) for r in rows] == [(None, "m", False), ("gemini:p:2026-01-01T00:00:00Z:3", "a", True), ('gemini:\\" {:2026-01-01T00:00:00Z:3', "m", False)]


def test_store_provenance(spark):
    row = lambda i, provider, model, cost, source=None: (json.dumps({"id": i, "role": "assistant", "providerID": provider, "modelID": model, "cost": cost, "cost_source": source, "tokens": {"inputTokens": 1, "output": 1}}), 5)
    data = [
        row("reported", "anthropic", "m", 1.0, "provider_reported"), row("estimated", "anthropic", "m", 1.0, "estimated"), row("calculated", "anthropic", "m", 0.0), row("local", "ollama", "m", 1.0), row("free", "x", "m-free", None), row("quota", "x", "m:cloud", 0.0),
        row("paid", "x", "m", 2.0), row("open", "x", "m", 0.0), row("spent", "x", "m:cloud", 3.0), ('{"role":"assistant","id":"bare"}', 5), ('{"role":"assistant"', 5),
    ]
    got = {r["event_id"]: (r["cost_status"], r["category"], r["cost"], r["incomplete"]) for r in stores.message_usage(spark.createDataFrame(data, "data string, time_created long")).collect()}
    assert got == {
        "reported": ("reported", "PAID", 1.0, False), "estimated": ("estimated", "PAID", 1.0, False), "calculated": ("calculated", "PAID", 0.0, False), "local": ("local", "LOCAL", 1.0, False), "free": ("free", "FREE", None, False), "quota": ("quota", "CLOUD", None, False),
        "paid": ("calculated", "PAID", 2.0, False), "open": ("unavailable", "UNKNOWN", 0.0, False), "spent": ("unavailable", "CLOUD", 3.0, False), "bare": ("unavailable", "UNKNOWN", None, True),
    }


def test_one_pipeline(spark, tmp_path, store):
    write(tmp_path / "t" / "a.jsonl", [assistant("r1", model="local-ollama"), assistant("r2", model="big")])
    rates = spark.createDataFrame([("big", True, False, 1e6, 1e6, None, None, None), ("m", True, False, 2e6, 2e6, None, 0.0, None)], config.RATE_SCHEMA)
    tiers, periods = spark.createDataFrame([], config.TIER_SCHEMA), spark.createDataFrame([], config.PERIOD_SCHEMA.replace("through string", "through date"))
    told = registry.usage(spark, {"claude_code": str(tmp_path / "t"), "copilot": store}, rates, tiers, periods, {"copilot": "subscription", "claude_code": "per_token"})
    got = {r["event_id"]: (r["category"], r["cost_status"], r["cost"], r["api_equivalent_cost"]) for r in told.collect()}
    assert got == {"r1": ("LOCAL", "unavailable", None, None), "r2": ("PAID", "estimated", 15.0, None), "copilot:s1:1": ("PAID", "quota", None, 22.0), "copilot:gone:2": ("PAID", "quota", None, 4.0)}


@pytest.fixture
def store(tmp_path):
    path = str(tmp_path / "s.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE message(data TEXT, time_created INTEGER)")
    good = {"role": "assistant", "providerID": "p", "modelID": "m", "id": "i1", "sessionID": "s", "cost": 0.5, "tokens": {"input": 3, "output": 4, "cache": {"read": 5}}}
    con.executemany("INSERT INTO message VALUES (?, ?)", [(json.dumps(good), 1_700_000_000_000), (json.dumps({"info": good | {"id": "i2", "cost": -1}}), 1_700_000_100), (json.dumps({"role": "user"}), 5), ("not json", 6)])
    con.execute("CREATE TABLE assistant_usage_events(id INTEGER, session_id TEXT, model TEXT, input_tokens INT, output_tokens INT, cache_read_tokens INT, created_at TEXT)")
    con.executemany("INSERT INTO assistant_usage_events VALUES (?,?,?,?,?,?,?)", [(1, "s1", "m", 10, 5, 4, "2026-01-01T00:00:00Z"), (2, "gone", "m", 1, 1, None, "1700000000000")])
    con.execute("CREATE TABLE sessions(id TEXT, cwd TEXT)")
    con.execute("INSERT INTO sessions VALUES ('s1', '/w/')")
    con.commit()
    con.close()
    return path


def test_stores(spark, store):
    rows = stores.message_usage(stores.read_store(spark, store, "message", "data string, time_created long")).orderBy("event_id").collect()
    assert [(r["event_id"], r["cost"], r["cost_status"], r["created"], r["cache_read"]) for r in rows] == [("i1", 0.5, "calculated", 1_700_000_000, 5), ("i2", None, "unavailable", 1_700_000_100, 5)]
    late = stores.read_store(spark, store, "message").where("time_created >= 1700000000000")
    assert late.count() == 1
    events = stores.event_usage(stores.read_store(spark, store, "assistant_usage_events", stores.EVENTS), stores.read_store(spark, store, "sessions", stores.SESSIONS)).orderBy("event_id").collect()
    assert [(r["event_id"], r["input"], r["cache_read"], r["project"], r["created"]) for r in events] == [("copilot:gone:2", 1, 0, None, 1700000000), ("copilot:s1:1", 6, 4, "/w", 1767225600)]
    assert stores.store_of(["/nowhere.db", store], {"sessions", "message"}) == store


def test_registry_merges_in_order(spark, tmp_path, store):
    write(tmp_path / "t" / "a.jsonl", [assistant("i1", 99), assistant("r1")])
    rows = registry.read_all(spark, {"opencode": store, "claude_code": str(tmp_path / "t")}).collect()
    assert sorted((r["event_id"], r["output"]) for r in rows) == [("i1", 99), ("i2", 4), ("r1", 10)]
    said = {r["id"]: r["status"] for r in registry.report(spark, {"opencode": "/nowhere.db", "claude_code": str(tmp_path / "t")})}
    assert said["opencode"] == "failed" and said["claude_code"] == "ok" and said["codex"] == "absent"


def test_rate_tables(spark, tmp_path):
    (tmp_path / "r.toml").write_text('[model."A"]\ninput = 1\noutput = 2.5\n[model."A".tier-200]\ninput = 3\n[[model."A".period]]\nthrough = "2026-01-31"\ninput = 9\n[[model."A".period]]\nthrough = "2026-02-31"\ninput = 9\n[model."bad"]\ninput = -1\n[model."F"]\nfree = true\n[model."F".tier-x]\ninput = 1\n')
    rates, tiers, periods, warnings = config.read_rates_toml(spark, str(tmp_path / "r.toml"))
    assert {(r["key"], r["free"], r["r_input"]) for r in rates.collect()} == {("a", False, 1.0), ("f", True, None)}
    assert [(r["threshold"], r["r_input"]) for r in tiers.collect()] == [(200, 3.0)] and periods.count() == 1 and len(warnings) == 3
    (tmp_path / "r.tsv").write_text("a\tinput=1\toutput=2\na\tinput=3\ttier=100\nbroken\tinput=x\nalone\n# note\n")
    rates, tiers, skipped = config.read_rates_tsv(spark, str(tmp_path / "r.tsv"))
    assert rates.count() == 1 and tiers.first()["threshold"] == 100 and skipped.first()[0] == 2


def test_pricing_page(spark):
    html = "<p>x</p><table><tr><th>Model</th><th>Input</th><th>Output</th></tr><tr><td><b>Big One 2.5</b></td><td>$1.25</td><td>Free</td></tr></table><table><tr><td>other</td><td>1</td></tr></table>"
    got = config.pricing_rows(spark.createDataFrame([(html,), (None,)], "h string"), "h").collect()
    assert [(r["key"], r["prices"]) for r in got] == [("big-one-2.5", [1.25, 0.0])]


def test_limits_and_status_line(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "tierLabel": "Pro", "updatedAt": "x", "limits": [{"label": "l", "title": "T", "percent": 1.4}, {"label": "m", "percent": -1}]}))
    assert [(r["label"], r["fraction"]) for r in config.read_panel_limits(spark, str(tmp_path)).collect()] == [("T", 1.0)]
    (tmp_path / "b.json").write_text(json.dumps({"id": "b", "usageStatusText": "Not signed in", "ready": False}))
    (tmp_path / ".hidden.json").write_text(json.dumps({"id": "hidden"}))
    assert {(r["agent"], r["status_text"], len(r["windows"])) for r in config.read_panel_records(spark, str(tmp_path)).collect()} == {("a", None, 1), ("b", "Not signed in", 0)}
    line = json.dumps({"rate_limits": {"five_hour": {"used_percentage": 42, "resets_at": 1000 + 8040}, "seven_day": {"used_percentage": 9, "resets_at": 1}}})
    assert config.status_windows(spark.createDataFrame([(line,), ("{}",)], "line string"), 1000).select("status_line").orderBy(F.desc("status_line")).collect()[0][0] == "5h 42% (resets 2h 14m)"


def test_billing_evidence(tmp_path):
    assert config.billing_of("per_token", account={}) == ("per_token", "setting")
    assert config.billing_of(api_key=True, account={}) == ("per_token", "api key")
    assert config.billing_of(account={}) == ("subscription", "account")
    assert config.sticky_billing(("subscription", "account"), config.billing_of()) == ("subscription", "account")
    assert config.read_account(str(tmp_path / "none.json")) is None
    (tmp_path / "s" / "subagents").mkdir(parents=True)
    (tmp_path / "s" / "subagents" / "agent-1.jsonl").write_text("")
    assert config.transcript_of(str(tmp_path), "s", "1").endswith("agent-1.jsonl") and config.transcript_of(str(tmp_path), "s", "2").endswith("s.jsonl")


def test_sse(spark):
    df = spark.createDataFrame([("data: {\"a\":1}",), ("data: [DONE]",), ("",), ("{\"a\":2}",), (": ping",)], "line string")
    assert [r[0] for r in lines.sse_documents(df).collect()] == ['{"a":1}', '{"a":2}']


def test_local_responses(spark):
    stream = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate([{"model": "l", "done": False}, {"model": "l", "created_at": "2026-01-01T00:00:00.123456789Z", "prompt_eval_count": 7, "eval_count": 3, "done": True}])], "pos long, line string")
    r = lines.local_generate_usage(lines.piped_documents(stream), 5).first()
    assert (r["input"], r["output"], r["created"], r["cost_status"]) == (7, 3, 1767225600, "local")
    chat = {"id": "c", "model": "l", "created": 99, "usage": {"prompt_tokens": 10, "completion_tokens": 5, "prompt_tokens_details": {"cached_tokens": 4}, "completion_tokens_details": {"reasoning_tokens": 2}}}
    pretty = spark.createDataFrame(list(enumerate(json.dumps(chat, indent=1).splitlines())), "pos long, line string")
    sse = spark.createDataFrame([(0, "data: {\"id\": \"c\"}"), (1, "data: " + json.dumps(chat)), (2, "data: [DONE]")], "pos long, line string")
    for df in (pretty, sse):
        r = lines.local_chat_usage(lines.piped_documents(df), 5).first()
        assert (r["event_id"], r["input"], r["output"], r["reasoning"], r["cache_read"], r["created"]) == ("c", 6, 3, 2, 4, 99)


def test_cached_limits(spark, tmp_path):
    limits = [{"kind": "session", "percent": 42, "resets_at": "2026-01-01T00:00:00Z"}, {"kind": "weekly_scoped", "percent": 5, "scope": {"model": {"display_name": "M"}}}, {"kind": "weekly_scoped", "percent": 150}, {"kind": "odd", "percent": 1}, {"kind": "session", "percent": -1}]
    (tmp_path / "c.json").write_text(json.dumps({"account": SECRET, "cachedUsageUtilization": {"fetchedAtMs": 1999, "utilization": {"limits": limits}}}))
    windows, dropped = config.read_cached_limits(spark, str(tmp_path / "c.json"))
    assert {(r["label"], r["fraction"], r["resets_at"], r["fetched_at"]) for r in windows.collect()} == {("Session (5-hour)", 0.42, 1767225600, 1), ("Weekly · M", 0.05, None, 1), ("Weekly (scoped)", 1.0, None, 1)}
    assert dropped.first()[0] == 2
