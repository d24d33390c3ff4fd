"""The catalogue of queries beside their SQL, and rules that hold across them."""

from pathlib import Path

import pytest
from parity import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanledger.functions import scalars as X
from spanledger.operators import limits, routing, supersede, usage, views
from spanledger.plans import adapters, reference
from spanledger.schema import USAGE_SCHEMA, known_label, total_tokens

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_parity(spark, name):
    assert compare(spark, entry.queries()[name], entry.oracle_sql()[name], DATA) is None


@needs_data
def test_rows_and_other_make_totals(spark):
    u = adapters.usage(spark, DATA)
    want = u.agg(F.sum("requests"), F.sum(total_tokens())).first()
    for keys, top in ((["model"], 3), (["session_id"], 2), (["project"], 0)):
        got = usage.top_with_other(u, keys, top).agg(F.sum("requests"), F.sum(total_tokens())).first()
        assert tuple(got) == tuple(want)
    assert usage.provenance(u).agg(F.sum("requests")).first()[0] == want[0]
    assert reference.q21(spark, DATA).first()["sessions_examined"] > 0


def frame(spark, *rows):
    base = dict(seq=1, event_id=None, provider="p", model="m", category="PAID", cost_status="reported", billing="per_token", requests=1, input=1, output=0, reasoning=0, cache_read=0, cache_write=0, cost=None, api_equivalent_cost=None, created=10, session_id=None, project=None, incomplete=False)
    return spark.createDataFrame([base | {"seq": i} | r for i, r in enumerate(rows)], USAGE_SCHEMA)


def test_unknown_cost_is_never_zero(spark):
    for rows in ([{"cost_status": "quota"}], [{"cost_status": "unavailable"}], [{"cost": None}]):
        assert usage.with_ratios(frame(spark, *rows).agg(*usage.counters())).first()["cost_value"] is None
    assert usage.with_ratios(frame(spark, {"cost_status": "free"}).agg(*usage.counters())).first()["cost_value"] == 0.0
    r = usage.with_ratios(frame(spark, {"cost": 1.0}, {"cost_status": "unavailable"}).agg(*usage.counters())).first()
    assert (r["cost_value"], r["cost_is_floor"]) == (1.0, True)


def test_empty_usage(spark):
    u = frame(spark).where("seq < 0")
    assert usage.totals(u).first()["cost"] == 0.0 and usage.daily_totals(u).count() == 0 and usage.top_with_other(u, ["model"], 3).count() == 0
    assert usage.provenance(u).count() == 7 and usage.coverage(u).first()["coverage_pct"] is None and usage.burn(u, 100).first()["projectable"] is False


def test_merge_of_sources(spark):
    base = frame(spark, {"event_id": "a", "input": 5}, {"event_id": "a", "input": 6}, {"event_id": "b", "input": 5})
    other = frame(spark, {"event_id": "a", "input": 9}, {"event_id": "b", "input": 5}, {"event_id": "c"}, {"event_id": "c", "input": 3}).withColumn("seq", F.col("seq") + 100)
    rows = lambda df: sorted((r["seq"], r["event_id"], r["input"]) for r in df.collect())
    assert rows(supersede.merge_sources(base, [other])) == [(0, "a", 5), (1, "a", 9), (2, "b", 5), (102, "c", 3)]
    assert rows(supersede.merge_sources(base, [other], dedup_base=True)) == [(0, "a", 9), (2, "b", 5), (102, "c", 3)]
    assert supersede.supersede(frame(spark, {"event_id": ""}, {"event_id": None}, {"event_id": None, "created": 11})).count() == 2


def test_escalations(spark):
    rate = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("c2", 3.0), ("free", None)], "model string, rate double")
    turns = [
        ("s", "a", 0, 1.0), ("s", "b", 5, 2.0), ("s", "c", 6, 4.0), ("s", "c2", 7, None), ("s", "free", 8, 1.0), ("s", "a", 9, 9.0), ("t", "b", 1, 1.0), ("t", "a", 2, 1.0), ("u", "zz", 1, 1.0), ("u", "a", 2, 1.0), ("u", "zz", 3, 1.0), ("v", "a", 1, 1.0), (None, "c", 1, 1.0),
    ]
    u = frame(spark, *({"session_id": s, "model": m, "created": c, "cost": cost} for s, m, c, cost in turns))
    counters, moves = routing.escalations(u, rate)
    assert tuple(counters.first()) == (3, 1, 2)
    assert [tuple(r) for r in moves.collect()] == [("a", "c", 1, 6.0, 0, 0)]


def test_views(spark):
    u = frame(spark, {"project": "/w/", "provider": "P"}, {"project": None}, {"session_id": "s", "created": 0})
    assert u.where(views.matches(project="/w")).count() == 1 and u.where(views.matches(project="(unattributed)")).count() == 2 and u.where(views.matches(provider="p")).count() == 3
    assert u.where(views.in_range(F.col("created"), 10, 7)).count() == 3 and u.where(views.in_range(F.col("created"), 10**6, 7)).count() == 0 and u.where(views.in_range(F.col("created"), 10**6, None)).count() == 3
    costs = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0)], "project string, cost double")
    assert [r[0] for r in views.sort_view(costs, "projects", ["project"]).collect()] == ["c", "a", "b"]
    assert [r[0] for r in views.sort_view(costs, "projects", ["project"], descending=False).collect()] == ["a", "c", "b"]
    assert views.search(costs, "A", ["project"]).count() == 1
    with pytest.raises(ValueError):
        views.sort_view(costs, "projects", ["project"], "nothing")


def test_scalars(spark):
    cases = {
        "classify": [(X.classify(F.lit(p), F.lit(m)), w) for p, m, w in (("cloudflare", "x", "UNKNOWN"), ("x-cloud", "y", "CLOUD"), ("ollama", "free", "LOCAL"), ("zz", "a-free", "FREE"), ("zz", "freeform", "UNKNOWN"), ("azure-openai", "x", "PAID"), (None, None, "UNKNOWN"))],
        "dotted": [(X.dotted_version(F.lit("claude-4-5-6")), "claude-4.5.6"), (X.strip_date(F.lit("m-20250101")), "m"), (X.strip_date(F.lit("m-2025-01-01")), "m")],
        "count": [(X.count_or_null(F.lit(v)), w) for v, w in ((1200.0, 1200), (1.5, None), (-1.0, None), (1e308, None))],
        "epoch": [(X.epoch_seconds(F.lit(v)), w) for v, w in ((1_700_000_000, 1_700_000_000), (1_700_000_000_999, 1_700_000_000), (1_700_000_000_999_999, 1_700_000_000))],
        "path": [(X.project_path(F.lit("/a/b//")), "/a/b"), (X.project_path(F.lit("///")), "///"), (X.project_path(F.lit(" ")), None)],
        "labels": [(X.window_label(F.lit(m).cast("int")), w) for m, w in ((300, "Session (5-hour)"), (10080, "Weekly (7-day)"), (1440, "1-day window"), (120, "2-hour window"), (90, "90-minute window"), (None, "Primary window"), (0, "Primary window"))] + [(X.plan_label(F.lit("default_claude_max_20x")), "Max 20x"), (X.plan_label(F.lit("pro")), "Pro"), (X.plan_label(F.lit("none")), None)],
        "text": [(X.url_host(F.lit("https://u:p@h.org:80/x")), "h.org"), (X.url_host(F.lit("http://[::1]:9/x")), "::1"), (X.url_host(F.lit("nope")), "nope"), (X.url_host(F.lit("ftp://a@b@c:1?x")), "c"), (X.strip_html(F.lit("<p>a&amp;b <b>c</b></p><script>x</script>")), "a&b c"), (X.csv_guard(F.lit("-5")), "-5"), (X.csv_guard(F.lit("=x")), "'=x")],
        "round": [(X.scaled_round(F.lit(1.005), 2), 1.0), (X.percent(F.lit(1), F.lit(0)), None)],
        "share": [(X.share_label(F.lit(1), F.lit(1000)), "<1%"), (X.share_label(F.lit(0), F.lit(5)), None), (X.share_label(F.lit(1), F.lit(4)), "25%"), (X.format_duration(F.lit(8040)), "2h 14m"), (X.format_duration(F.lit(97300)), "1d 3h"), (X.format_count(F.lit(1500)), "1.5K")],
        "session": [(X.session_of_file(F.lit("rollout-2026-01-01T00-00-00-0199a213-81c0-7800-8aa1-bbab2a035a53.jsonl")), "0199a213-81c0-7800-8aa1-bbab2a035a53"), (X.session_of_file(F.lit("x.jsonl")), None)],
        "known": [(known_label(F.lit("odd"), ["a"], "b"), "b")],
    }
    flat = [(f"{k}{i}", c, w) for k, pairs in cases.items() for i, (c, w) in enumerate(pairs)]
    row = spark.range(1).select(*(c.alias(n) for n, c, _ in flat)).first()
    assert {n: row[n] for n, _, _ in flat} == {n: w for n, _, w in flat}


def test_limits(spark):
    snaps = [("a", 0, False, 9, 1, "T"), ("a", 2, True, 1, 1, None), ("b", 1, False, 5, 1, None), ("b", 1, False, 5, 2, None)]
    got = {r["agent"]: (r["windows"], r["rank"], r["tier"]) for r in limits.merge_snapshots(spark.createDataFrame(snaps, "agent string, windows int, stale boolean, updated_at long, rank int, tier string")).collect()}
    assert got == {"a": (2, 1, "T"), "b": (1, 2, None)}
    ages = spark.createDataFrame([(None,), (5,), (100,), (-61,), (-60,)], "age long").select(limits.is_stale(F.col("age"), 50)).collect()
    assert [r[0] for r in ages] == [True, False, True, True, False]


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if Path(DATA).exists():
        assert entry.entry(spark).count() > 0


def test_four_digits(spark):
    import random

    rng = random.Random(1)
    values = [0.0, 0.00005, 0.00015, 0.01015, 1.00005, 0.5, 2.675, 123456.78905] + [rng.randrange(10**7) / 10**rng.randrange(3, 8) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.four_digits(F.col("v")).alias("s"))
    assert all(r["s"] == f"{r['v']:.4f}" for r in df.collect())
