"""Stamps, dedup, rolling totals, drift and nested records on small cases."""

import json
import random
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from spanledger.functions import jsonwalk
from spanledger.operators import dedup, drift, nested, rolling, stamps

U, R, X = stamps.UNDATED, stamps.RESOLVED, stamps.UNRESOLVED


def utc(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1_000_000)


@pytest.mark.parametrize("raw,zone,order,want", [
    (None, "Etc/UTC", None, (U, None)), (" \t", None, None, (U, None)), ("0", None, None, (U, None)), ("-5", None, None, (U, None)), ("0.0", None, None, (U, None)),
    ("1756684800", None, None, (R, 1756684800 * 10**6)), ("1756684800.916", None, None, (R, 1756684800916000)), ("1756684800916", None, None, (R, 1756684800916000)), ("1756684800916123", None, None, (R, 1756684800916123)), ("100000000000", None, None, (R, 10**17)), ("100000000001", None, None, (R, 100000000001000)),
    ("2025-09-01T00:03:02.949Z", None, None, (R, utc(2025, 9, 1, 0, 3, 2, 949000))), ("20250901T000129Z", None, None, (R, utc(2025, 9, 1, 0, 1, 29))), ("2025-09-01 17:39:41 +0930", None, None, (R, utc(2025, 9, 1, 8, 9, 41))), ("2025-09-01T12:33:25.864+01:00", None, None, (R, utc(2025, 9, 1, 11, 33, 25, 864000))),
    ("2025-09-01 06:43:46 UTC", None, None, (R, utc(2025, 9, 1, 6, 43, 46))), ("2025-09-07 20:09:40 BST", None, None, (R, utc(2025, 9, 7, 19, 9, 40))), ("2025-09-10 12:32:17 EDT", None, None, (R, utc(2025, 9, 10, 16, 32, 17))), ("Tue, 02 Sep 2025 12:33:18 +0200", None, None, (R, utc(2025, 9, 2, 10, 33, 18))),
    ("2025-09-02 12:00:00 XYZ", "Etc/UTC", None, (X, None)), ("2025-09-02 12:00:00", None, None, (X, None)), ("2025-09-02 12:00:00", "No/Where", None, (X, None)), ("2025-09-02 12:00:00", "Asia/Tokyo", None, (R, utc(2025, 9, 2, 3))),
    ("2025-03-30T02:30:00", "Europe/Berlin", None, (X, None)), ("2025-10-26T02:30:00", "Europe/Berlin", None, (X, None)), ("2025-10-26T03:00:00", "Europe/Berlin", None, (R, utc(2025, 10, 26, 2))), ("2025-10-26T02:30:00+01:00", "Europe/Berlin", None, (R, utc(2025, 10, 26, 1, 30))),
    ("11/9/2025 7:06:08 PM", "Etc/UTC", "dmy", (R, utc(2025, 9, 11, 19, 6, 8))), ("11/9/2025 7:06:08 PM", "Etc/UTC", "mdy", (R, utc(2025, 11, 9, 19, 6, 8))), ("11/9/2025 7:06:08 PM", "Etc/UTC", None, (X, None)), ("9/9/2025 12:06:08 AM", "Etc/UTC", None, (R, utc(2025, 9, 9, 0, 6, 8))),
    ("26/9/2025 12:15:54 PM", "Etc/UTC", None, (R, utc(2025, 9, 26, 12, 15, 54))), ("26/9/2025 12:15:54 PM", "Etc/UTC", "mdy", (X, None)), ("26/9/2025 13:15:54 PM", "Etc/UTC", "dmy", (X, None)), ("30/2/2025 10:00:00", "Etc/UTC", None, (X, None)),
    ("2025-13-04 18:28:13Z", None, None, (X, None)), ("2026-06-1T25:09:47Z", None, None, (X, None)), ("08:32:09", "Etc/UTC", None, (X, None)), ("n/a", "Etc/UTC", None, (X, None)), ("2025-09-01", "Etc/UTC", None, (X, None)), ("nan", None, None, (X, None)), ("x" * 10000, None, None, (X, None)),
])
def test_read_stamp(raw, zone, order, want):
    assert stamps.read_stamp(raw, zone, order) == (*want, "" if want[0] == R else None)


@pytest.mark.parametrize("raw,micros,rest", [
    ("2026-01-02T03:04:05.123456789Z", utc(2026, 1, 2, 3, 4, 5, 123456), "789"), ("2026-01-02T03:04:05.123456001Z", utc(2026, 1, 2, 3, 4, 5, 123456), "001"), ("2026-01-02T03:04:05.1234560Z", utc(2026, 1, 2, 3, 4, 5, 123456), ""),
    ("1767323045.123456789012345678901234567890", 1767323045123456, "78901234567890123456789"), ("1767323045123.4567", 1767323045123456, "7"), ("1767323045123456.70", 1767323045123456, "7"), ("+5", 5 * 10**6, ""), (".5", 5 * 10**5, ""), ("0.0000001", 0, "1"),
])
def test_written_precision(raw, micros, rest):
    assert stamps.read_stamp(raw, None, None) == (R, micros, rest) and stamps.read_stamp("9" * 400, None, None) == (X, None, None)


def test_local_times_round_trip():
    rng = random.Random(2)
    for _ in range(300):
        zone = rng.choice(["Europe/London", "America/New_York", "Australia/Adelaide", "America/Sao_Paulo"])
        at = datetime.fromtimestamp(rng.randrange(1_600_000_000, 1_800_000_000), timezone.utc)
        local = at.astimezone(ZoneInfo(zone))
        status, micros, _ = stamps.read_stamp(local.strftime("%Y-%m-%d %H:%M:%S"), zone, None)
        assert status == X and local.fold in (0, 1) and abs(local.hour - 1) <= 1 or micros == int(at.timestamp()) * 10**6


def test_normalise_and_dictionary(spark, tmp_path):
    clock = spark.createDataFrame([("h1", "Asia/Tokyo", "dmy"), ("h2", None, None), ("h3", "Etc/UTC", None), ("h3", "Asia/Tokyo", None)], "host_id string, zone_name string, date_order string")
    rows = [(1, "2025-09-02 12:00:00", "h1"), (2, "2025-09-02 12:00:00", "h2"), (3, None, "h1"), (4, " ", None), (5, "2025-09-02 12:00:00", "h3"), (6, "2025-09-02 12:00:00Z", None), (7, "2025-09-02 12:00:00", "new")]
    df = spark.createDataFrame(rows * 1, "id long, ts string, host string").selectExpr("*", "'clash' AS status", "1 AS n")
    got = {r["id"]: (r["stamp_status"], r["status"]) for r in stamps.normalise(df, clock, "ts", "host").collect()}
    assert got == {1: (R, "clash"), 2: (X, "clash"), 3: (U, "clash"), 4: (U, "clash"), 5: (X, "clash"), 6: (R, "clash"), 7: (X, "clash")}
    words = stamps.with_clock(df.selectExpr("ts AS _raw", "host AS _host", "'t' AS _source"), clock).select("_raw", "_source", "_zone", "_order")
    kept = str(tmp_path / "words")
    first = stamps.build_dictionary(words.where("_zone = ''"), kept)
    assert all(r["fresh"] for r in first.collect())
    both = stamps.build_dictionary(words, kept).collect()
    assert len(both) == words.distinct().count() and {r["fresh"] for r in both} == {True, False}
    again = stamps.build_dictionary(words, kept).collect()
    assert not any(r["fresh"] for r in again) and {r[:7] for r in again} == {r[:7] for r in both}
    # Two runs that both added a key leave it twice in the folder and once in the dictionary.
    spark.read.option("recursiveFileLookup", "true").parquet(kept).write.parquet(f"{kept}/part-again")
    assert stamps.read_dictionary(spark, kept).count() == len(both)
    # A kept dictionary is used, not read anew: counts are those of now.
    assert stamps.build_dictionary(words.where("_zone = ''").unionByName(words.where("_zone = ''")), kept).agg(F.sum("n")).first()[0] == 2 * words.where("_zone = ''").count()
    assert stamps.normalise(df.where("id < 0"), clock, "ts", "host").count() == 0
    fine = spark.createDataFrame([("2026-01-02T03:04:05.123456789Z", None), ("9007199254740993", None)], "ts string, host string")
    for _ in range(2):  # fresh, then from the dictionary
        got = {r[0] for r in stamps.normalise(fine, clock, "ts", "host", dictionary=str(tmp_path / "fine")).select(stamps.instant_text()).collect()}
        assert got == {"2026-01-02T03:04:05.123456789Z", "2255-06-05T23:47:34.740993Z"}


def test_hot_spellings(spark):
    clock = spark.createDataFrame([("h", "Etc/UTC", None)], "host_id string, zone_name string, date_order string")
    df = spark.range(6000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'n/a' ELSE concat('2025-09-02 12:00:', lpad(id % 60, 2, '0')) END AS ts", "'h' AS host")
    got = stamps.normalise(df, clock, "ts", "host").groupBy("stamp_status").count().collect()
    assert {r[0]: r[1] for r in got} == {R: 3000, X: 3000}


def test_surplus(spark):
    rows = [(1, "a", 5), (2, "a", 9), (3, "a", 9), (4, "b", None), (5, "b", 0), (6, "c", 1), (7, None, 1), (8, None, 2)]
    df = spark.createDataFrame(rows, "id long, k string, w long").withColumn("_n", F.lit(0))
    assert {r["id"] for r in dedup.surplus(df.where("k is not null"), ["k"], "id", "w").collect()} == {1, 3, 5}
    assert {r["id"] for r in dedup.surplus(df, ["k"], "id", "w").collect()} == {1, 3, 5, 7}
    assert dedup.surplus(df.where("id < 0"), ["k"], "id", "w").count() == 0
    kept = lambda c: {r[0] for r in c.kept().collect()}
    assert kept(dedup.Copies(df, ["k"], ["id"], "w")) == {2, 4, 6, 8}
    assert kept(dedup.Copies(df.where("id in (1, 4, 7)"), ["k"], ["id"], "w", df.where("id not in (1, 4, 7)"))) == {2, 4, 6, 8}
    held = dedup.absorb(df.where("id < 0"), df.where("id % 2 = 0"), ["k"], "id", "w")
    assert {r["id"] for r in dedup.absorb(held, df.where("id % 2 = 1"), ["k"], "id", "w").collect()} == {2, 4, 6, 8}
    one = spark.createDataFrame([(1, "", None, "u"), (2, "r", "m", "u"), (3, None, "", ""), (4, None, "m", "u")], "id long, a string, b string, c string")
    assert [r[0] for r in one.orderBy("id").select(dedup.first_filled("a", "b", "c")).collect()] == ["2:u", "0:r", None, "1:m"]


def test_hot_identity(spark, monkeypatch):
    monkeypatch.setattr(dedup, "LEAST_HOT", 50)
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('p', id div 6) ELSE concat('s', id) END AS k", "id % 7 AS w")
    best = {}
    for r in df.collect():
        key = (-r["w"], r["id"])
        best[r["k"]] = min(best.get(r["k"], key), key)
    assert {r["id"] for r in dedup.surplus(df, ["k"], "id", "w").collect()} == set(range(3000)) - {i for _, i in best.values()}


def test_two_stacks_against_recompute():
    rng = random.Random(5)
    days = sorted(rng.sample(range(100), 40))
    items = [(d, (1, rng.randrange(50), rng.random(), rng.randrange(2), rng.choice([None, rng.random()]))) for d in days]
    for day, active, (seven, thirty) in rolling.windows_of(iter(items), (7, 30)):
        for got, width in ((seven, 7), (thirty, 30)):
            inside = [x for d, x in items if day - width < d <= day]
            assert got[:2] == (len(inside), sum(x[1] for x in inside)) and abs(got[2] - sum(x[2] for x in inside)) < 1e-9
            assert got[4] == max((x[4] for x in inside if x[4] is not None), default=None)
        assert active == (day in days)


def test_trailing_totals(spark):
    start = int(datetime(2026, 1, 1, 23, 59, tzinfo=timezone.utc).timestamp() * 10**6)
    rows = [("m", start, 10, 1.0), ("m", start, None, None), ("m", start + 9 * 86400 * 10**6, 5, None), (None, start, 1, float("nan"))]
    daily = rolling.daily_totals(spark.createDataFrame(rows, "model string, at long, tokens long, cost double"), "model", "at", "tokens", "cost")
    got = rolling.trailing_totals(daily).orderBy("entity", "day").collect()
    mine = [r for r in got if r["entity"] == "m"]
    assert [r["day"] for r in mine] == [date(2026, 1, 1) + timedelta(days=i) for i in range(10)]
    assert [r["tokens_7"] for r in mine] == [10] * 7 + [0, 0, 5] and mine[-1]["tokens_30"] == 15
    assert mine[-1]["cost_7"] is None and mine[-1]["cost_30"] == 1.0 and mine[0]["avg_cost_7"] == 1 / 7
    alone = [r for r in got if r["entity"] is None]
    assert len(alone) == 1 and alone[0]["cost_7"] is None
    assert rolling.trailing_totals(daily.where("entity = 'none'")).count() == 0


RECORDS = "rec_id long, feed_id string, feed_kind string, file_no int, body string"
ALIAS = "feed_kind string, canonical_path string, spelling_path string"


def ingested(spark, rows):
    return drift.ingest(spark.createDataFrame(rows, RECORDS), ["rec_id", "feed_id", "feed_kind", "file_no"], "body", [drift.Target("a", "long", ("a",))])


def test_changes(spark):
    rows = [
        (1, "f", "k", 1, '{"a": 1, "old": "x", "o": {"p": null}}'), (2, "f", "k", 1, '{"a": 2, "cut'), (3, "f", "k", 3, '{"a": "1", "new": "x", "o": {"p": 1}, "extra": [{"in": 1}]}'), (4, "f", "k", 3, None),
        (5, "f", "k", 4, "[1]"), (6, "g", "other", 1, '{"old": 1}'), (7, "g", "other", 2, '{"new": 1}'), (8, None, "k", 1, '{"z": 1}'),
    ]
    alias = [("k", "old", "new"), ("k", "canon", "unused"), ("k", "second", "new")]
    got = {(r["feed_id"], r["file_no"], r["field_path"], r["change"]) for r in drift.changes(ingested(spark, rows), spark.createDataFrame(alias, ALIAS)).collect()}
    want = {("f", 3, "a", "retyped"), ("f", 3, "new", "renamed"), ("f", 3, "extra", "added"), ("g", 2, "old", "removed"), ("g", 2, "new", "added")}
    assert got == want | {("f", 4, p, "removed") for p in ("a", "new", "o", "o.p", "extra")}
    assert drift.changes(ingested(spark, []), spark.createDataFrame([], ALIAS)).count() == 0


def test_ingest_and_promote(spark):
    targets = [drift.Target("n", "long", ("n", "count")), drift.Target("s", "string", ("s.t",)), drift.Target("b", "boolean", ("b",))]
    bodies = ['{"n": 5, "s": {"t": "x"}, "b": true, "cost": 1.5}', '{"count": "7", "b": "yes", "cost": "2"}', '{"n": 1.5, "count": 3}', '{"n": 1, "count": 2}', None, "", "{", '{"n": 1e400, "s": {"t": [1]}, "e": {}}', '{"n": 12345678901234567890}']
    df = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    rows = {r["id"]: r for r in drift.ingest(df, ["id"], "body", targets).collect()}
    assert (rows[0]["n"], rows[0]["s"], rows[0]["b"], json.loads(rows[0]["_rescued"])) == (5, "x", True, {"cost": 1.5})
    assert (rows[1]["n"], rows[1]["b"], json.loads(rows[1]["_rescued"])) == (7, None, {"b": "yes", "cost": "2"})
    assert (rows[2]["n"], json.loads(rows[2]["_rescued"])) == (3, {"n": 1.5})
    assert (rows[3]["n"], json.loads(rows[3]["_rescued"])) == (1, {"count": 2})
    assert [rows[i]["_whole"] for i in (4, 5, 6)] == [False] * 3 and rows[4]["_rescued"] is None and json.loads(rows[6]["_rescued"]) == "{"
    assert rows[7]["n"] is None and json.loads(rows[7]["_rescued"])["s.t"] == [1] and rows[8]["n"] is None
    more = {r["id"]: r for r in drift.promote(drift.ingest(df, ["id"], "body", targets), drift.Target("cost", "double", ("cost",))).collect()}
    assert (more[0]["cost"], more[0]["_rescued"], more[1]["cost"], json.loads(more[1]["_rescued"])) == (1.5, None, 2.0, {"b": "yes"})


def test_dotted_keys_collide():
    values, rescued, kinds = drift.ingest_body({"a.b": 1, "a": {"b": "x"}}, [drift.Target("t", "long", ("a.b",))])
    assert values == [1] and json.loads(rescued) == {"a.b#": "x"} and kinds == {"a.b": 3, "a": 8}


@pytest.mark.parametrize("value,to,want", [
    ("1_000", "long", (False, None)), ("007", "long", (False, None)), ("1_0.5", "double", (False, None)), (jsonwalk.Num(str(2**53 + 1)), "double", (False, None)), (jsonwalk.Num(str(2**53)), "double", (True, 2.0**53)),
    (jsonwalk.Num("0.1"), "double", (True, 0.1)), (jsonwalk.Num("0.10000000000000000001"), "double", (False, None)), (jsonwalk.Num("1e400"), "double", (False, None)), (jsonwalk.Num("1e99999999999999999999"), "long", (False, None)), (jsonwalk.Num("1e3"), "long", (True, 1000)),
    (jsonwalk.Num("7.0"), "long", (True, 7)), (jsonwalk.Num("7.5"), "long", (False, None)), (jsonwalk.Num("1.50"), "string", (True, "1.50")), (True, "long", (False, None)), ("true", "boolean", (True, True)), ("True", "boolean", (False, None)), ("x" * 10**6, "long", (False, None)), ("５", "long", (False, None)),
])
def test_casts_are_lossless(value, to, want):
    assert drift.cast(value, to) == want


def test_spellings_of_targets():
    got = drift.with_spellings([drift.Target("v", "string", ("version",)), drift.Target("o", "string", ("other",))], [("version", "cliVersion"), ("version", "cli_version"), ("x", "y")])
    assert got[0].paths == ("version", "cliVersion", "cli_version") and got[1].paths == ("other",)


def walk_items(value, keys="", pos=""):
    """Every object in an array, recursively."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk_items(v, f"{keys}.{k}" if keys else k, pos)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            at = f"{pos}.{i}" if pos else str(i)
            if isinstance(v, dict):
                yield keys, at
            yield from walk_items(v, keys + "[]", at)


def make_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind >= 5:
        return {rng.choice("abcde#."): make_value(rng, depth + 1) for _ in range(rng.randrange(4))}
    if kind == 4:
        return [make_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return [None, True, rng.randrange(5), rng.choice(["x", "é", "[{}]"])][kind]


def test_nested_against_recursion_and_round_trip(spark):
    rng = random.Random(7)
    bodies = [json.dumps({"k": make_value(rng), "l": [make_value(rng), {"a": 1}]}) for _ in range(80)] + ["[{}]", None, '{"a": [{}', "{}", "", '{"a": NaN}']
    df = spark.createDataFrame(list(enumerate(bodies)), "rec_id long, body string").withColumn("path", F.lit("clash"))
    occ = nested.occurrences(df, "rec_id", "body")
    got = sorted((r["rec_id"], r["path"], r["item_pos"]) for r in nested.bridge(occ).where("in_array").collect())
    assert got == sorted((i, k, p) for i, b in enumerate(bodies) if (v := jsonwalk.whole_object(b)) is not None for k, p in walk_items(v))
    texts = {r["hash"].hex(): r["canonical"] for r in nested.objects(occ).collect()}
    for r in occ.where("parent_node is null").collect():
        assert jsonwalk.canonical(nested.rebuild(texts, r["hash"].hex())) == jsonwalk.canonical(jsonwalk.whole_object(bodies[r["rec_id"]]))
    by_node = {(r["rec_id"], r["node"]): r for r in occ.collect()}
    for (rec, _), r in by_node.items():
        if r["parent_node"] is not None:
            assert by_node[rec, r["parent_node"]]["hash"] == r["parent_hash"]


def test_deep_and_odd_bodies():
    deep = '{"a":' * 300 + "{}" + "}" * 300
    assert len(list(nested.occurrences_of(jsonwalk.whole_object(deep)))) == 301
    assert jsonwalk.whole_object('{"a": 1} x') is None and jsonwalk.whole_object('{"a": Infinity}') is None and jsonwalk.whole_object(' {"a": 1, "a": 2}\n') == {"a": "2"}
    assert jsonwalk.whole_object('{"a":' * 200000) is None
    deep = '{"a":' * 50000 + '{"b":[{"c":' + "9" * 5000 + '},1e400,1e500,2.50]}' + "}" * 50000
    value = jsonwalk.whole_object(deep)
    assert jsonwalk.dumps(value) == deep == jsonwalk._any_depth(value, False)
    assert json.loads(drift.layout_text({"b\ud800": 1, "a": 2})) == {"a": 2, jsonwalk.clean("b\ud800"): 1}
    rows = list(nested.occurrences_of(value))
    assert len(rows) == 50002 and rows[-1][5] == "a." * 50000 + "b" and rows[-1][6] == "0"
    assert jsonwalk.dumps(nested.rebuild({r[2].hex(): r[9] for r in rows}, rows[0][2].hex())) == deep
    assert len({r[2] for r in nested.occurrences_of({"l": [{"n": jsonwalk.Num("1e400")}, {"n": jsonwalk.Num("1e500")}]})}) == 3
    values, rescued, layout = drift.ingest_body(value, [drift.Target("x", "long", ("x",))])
    assert values == [None] and len(layout) == 50001 and len(jsonwalk.dumps(layout)) < 10**8


@pytest.mark.parametrize("seed", range(4))
def test_deep_reader_reads_what_the_shallow_one_reads(seed):
    rng = random.Random(seed)
    for _ in range(100):
        text = json.dumps({"k": make_value(rng), "l": [make_value(rng)]})
        at = rng.randrange(len(text))
        for t in (text, text[:at], text[:at] + rng.choice('{}[],:"0 x') + text[at:]):
            want = jsonwalk.whole_object(t)
            try:
                got = jsonwalk._deep(t)
            except ValueError:
                got = None
            assert want is None or got == want
            assert want is None or jsonwalk._any_depth(want, True) == jsonwalk.canonical(want)
            assert got is None or not isinstance(got, dict) or got == want


def test_flat_with_a_hot_object(spark):
    bodies = [(i, '{"a":[{"n":1},{"n":1},{"k":"x%d"},{}]}' % i) for i in range(1500)]
    occ = nested.occurrences(spark.createDataFrame(bodies, "rec_id long, body string"), "rec_id", "body")
    got = sorted((r["rec_id"], r["array_path"], r["item_pos"], r["field"], r["value"]) for r in nested.flat(occ).collect())
    assert got == sorted(x for i in range(1500) for x in ((i, "a", "0", "n", "1"), (i, "a", "1", "n", "1"), (i, "a", "2", "k", f"x{i}")))


def test_values_of_objects(spark):
    body = '{"s":"x","n":1.50,"t":true,"z":null,"o":{"in":1},"e":[],"l":[1,["a",{"q":2}]]}'
    occ = nested.occurrences(spark.createDataFrame([(1, body)], "rec_id long, body string"), "rec_id", "body")
    got = {(r["field"], r["item_pos"], r["type"], r["value"]) for r in nested.values(nested.objects(occ)).collect()}
    want = {("s", "", "string", "x"), ("n", "", "number", "1.50"), ("t", "", "boolean", "true"), ("z", "", "null", None), ("e", "", "empty", None), ("l[]", "0", "number", "1"), ("l[][]", "1.0", "string", "a"), ("in", "", "number", "1"), ("q", "", "number", "2")}
    assert got == want
