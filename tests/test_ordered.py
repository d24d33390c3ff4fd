"""Ordered folds over cut groups against plain walks."""

import random

import pytest

from spanledger.operators import ordered, supersede


@pytest.fixture
def many_slices(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_numbers(spark, many_slices):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i) for i in rng.sample(range(1000), 500)]
    got = ordered.numbered(spark.createDataFrame(rows, "g string, o long"), ["g"], ["o"]).collect()
    assert {(r["g"], r["o"], r["n"]) for r in got} == {(g, r[1], i + 1) for g, rs in groups(rows).items() for i, r in enumerate(rs)}
    assert ordered.numbered(spark.createDataFrame([], "g string, o long"), ["g"], ["o"]).count() == 0


def test_carry_forward(spark, many_slices):
    rng = random.Random(2)
    some = lambda i: f"v{i}" if rng.random() < 0.02 else None
    rows = [(rng.choice(["hot", "hot", "hot", "b"]), i, some(i), some(i), some(i), some(i)) for i in range(600)]
    got = supersede.carry_forward(spark.createDataFrame(rows, "f string, o long, meta_session string, meta_cwd string, turn_model string, turn_cwd string"), "f", "o")
    want = set()
    for f, rs in groups(rows).items():
        session = model = turn = meta = None
        for _, o, ms, mc, tm, tc in rs:
            session, model, turn, meta = session or ms, tm or model, tc or turn, meta or mc
            want.add((f, o, session, model, turn or meta))
    assert {(r["f"], r["o"], r["session"], r["model"], r["cwd"]) for r in got.collect()} == want


def test_replays_and_deltas(spark, many_slices):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "b"]), i, rng.choice([None, *range(4)]), rng.randrange(3)) for i in range(500)]
    df = spark.createDataFrame(rows, "f string, o long, total long, own long")
    kept, deltas = set(), set()
    for f, rs in groups(rows).items():
        before, n, last = None, 0, 0
        for _, o, total, own in rs:
            if total is None or before is None or total != before:
                n += 1
                kept.add((f, o, total is not None and before is not None and total - before != own, n))
            before = total if total is not None else before
            if max((total or 0) - last, 0):
                deltas.add((f, o, (total or 0) - last))
            last = total or 0
    assert {(r["f"], r["o"], r["disagrees"], r["call_no"]) for r in supersede.drop_replays(df, "f", "o", "total", "own").collect()} == kept
    assert {(r["f"], r["o"], r["delta_total"]) for r in supersede.cumulative_to_delta(df, ["f"], "o", ["total"]).collect()} == deltas
