"""The queries by the events' own instants, against a plain reading of each stamp."""

from datetime import UTC, datetime

import pytest

import __spark_entry__ as entry
from spanledger.operators.stamps import read_stamp

ZONES = {"berlin": ("Europe/Berlin", "dmy"), "boston": ("America/New_York", "mdy"), "lost": (None, None)}
RECEIVED = ("2026-05-20 10:00:00", "2026-05-22 03:30:00")
# id, batch, host, event_id, created, input_tokens, model
EVENTS = [
    (1, 0, "berlin", None, "2026-05-19T23:30:00Z", 10, "m"), (2, 1, "berlin", "", "2026-05-20 01:30:00", 10, "m"), (3, 1, "boston", None, "05/19/2026 7:30:00 PM", 10, "m"), (4, 1, "boston", None, "2026-05-19T23:30:01Z", 10, "m"),
    (5, 0, "lost", "e", "1779150600", 5, "n"), (6, 1, "lost", "e", "2026-05-19T00:30:00Z", 9, "n"), (7, 0, "lost", None, "03/04/2026 10:00", 3, "m"), (8, 1, "lost", None, "03/04/2026 10:00", 3, "m"), (9, 1, "lost", None, None, 3, "m"),
    (10, 0, "berlin", None, "1779147000000", 7, "n"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("events"))
    counts = ("requests", "input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens")
    schema = "id long, batch_no int, received_at string, host_id string, event_id string, provider string, model string, category string, cost_status string, " + ", ".join(f"{c} long" for c in counts) + ", cost double, created string, session_id string, project string, billing string"
    rows = [(i, b, RECEIVED[b], host, event, "p", model, "PAID", "reported", 1, tokens, 0, 0, 0, 0, 0.5, created, "s", "/w", None) for i, b, host, event, created, tokens, model in EVENTS]
    spark.createDataFrame(rows, schema).selectExpr("* EXCEPT (received_at)", "cast(received_at AS timestamp_ntz) AS received_at").write.parquet(f"{d}/usage_event.parquet")
    spark.createDataFrame([(h, *z) for h, z in ZONES.items()], "host_id string, zone_name string, date_order string").write.parquet(f"{d}/host_clock.parquet")
    return d


def second(event):
    micros = read_stamp(event[4], *ZONES[event[2]])[1]
    return 0 if micros is None else micros // 1_000_000


def test_supersede_by_instant(spark, folder):
    held = {}
    for e in EVENTS:
        key = e[3] or ("p", e[6], e[5], second(e))
        first = held.get(key, (e[0],))[0]
        if key not in held or e[5] > held[key][1]:
            held[key] = (first, e[5], second(e))
    got = {(r["seq"], r["tokens"], r["created"]) for r in entry.queries()["q30_supersede"](spark, folder).collect()}
    assert got == set(held.values()) and {s for s, *_ in got} == {1, 4, 5, 7, 10}


def test_days_by_instant(spark, folder):
    days = {}
    for e in EVENTS:
        if s := second(e):
            day = datetime.fromtimestamp(s, UTC).date()
            days[day] = days.get(day, 0) + e[5]
    assert {r["day"]: r["tokens"] for r in entry.queries()["q09_by_day"](spark, folder).collect()} == days
    assert {str(d) for d in days} == {"2026-05-18", "2026-05-19"}
