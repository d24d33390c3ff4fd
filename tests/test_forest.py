"""Hierarchies against a brute-force walk, with partitions small enough that links cross them."""

import random

import pytest
from pyspark.sql import functions as F

from spanledger.operators import forest

SCHEMA = "_id string, _parent string, _group string, _order long, tag string"


def brute(rows):
    """{id: (state, root, depth, ancestors)} by walking up."""
    parent = {r[0]: r[1] for r in rows}
    out = {}
    for v in parent:
        seen, x = [], v
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x is not None and x in parent:
            out[v] = ("circle" if x == v else "below_circle", None, None, None)
        else:
            out[v] = ("tree" if x is None else "orphan", seen[-1], len(seen) - 1, seen[1:])
    return out


def make(seed, n, groups, local):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = f"g{rng.choice(groups)}"
        r = rng.random()
        if r < 0.05:
            p = None
        elif r < 0.08:
            p = f"missing{rng.randrange(5)}"
        elif r < 0.1:
            p = f"n{rng.randrange(n)}"
        elif r < 0.12:
            p = f"n{i}"
        elif rng.random() < local and i:
            p = f"n{rng.randrange(max(0, i - 5), i)}"
        else:
            p = f"n{rng.randrange(max(1, i))}"
        rows.append((f"n{i}", p, g, i, "x"))
    return rows


@pytest.mark.parametrize("seed,n,groups,limit", [(1, 300, [0], 20), (2, 400, range(9), 1000), (3, 500, [0, 0, 0, 1, 2, 3], 30), (4, 200, range(200), 1000)])
def test_against_walk(spark, monkeypatch, seed, n, groups, limit):
    monkeypatch.setattr(forest, "GROUP_ROWS", limit)
    monkeypatch.setattr(forest, "LEAST_ROWS", 20)
    rows = make(seed, n, groups, 0.8)
    made = forest.Forest(spark.createDataFrame(rows, SCHEMA))
    want = brute(rows)
    assert {r[0] for r in made.circle_nodes().select("_id").collect()} == {v for v, w in want.items() if w[0] == "circle"}
    nodes = made.nodes()
    got = {r["_id"]: r for r in nodes.collect()}
    assert got.keys() == want.keys()
    inside = {}
    for v, (state, root, depth, above) in want.items():
        r = got[v]
        assert (r["state"], r["root"], r["depth"]) == (state, root, depth), v
        for a in above or []:
            inside.setdefault(a, set()).add(v)
    by_root = {}
    for v, r in got.items():
        if r["root"] is not None:
            by_root.setdefault(r["root"], []).append(r)
    for rows_of in by_root.values():
        assert sorted(r["enter"] for r in rows_of) == list(range(len(rows_of)))
        for a in rows_of:
            below = {b["_id"] for b in rows_of if a["enter"] < b["enter"] < a["exit"]}
            assert below == inside.get(a["_id"], set()) and a["descendants"] == len(below)
    paths = {v: "/".join([*reversed(w[3]), v]) for v, w in want.items() if w[1] is not None}
    assert {r["_id"]: r["path"] for r in forest.expand_paths(nodes, nodes.select("_id")).collect()} == paths
    split = {r["_id"]: (r["anchor"], r["path"]) for r in forest.pieces(forest.Forest(spark.createDataFrame(rows, SCHEMA), forest.path_pieces(3), forest.PIECES)).collect()}
    assert split.keys() == paths.keys() and all(p.count("/") < 3 for _, p in split.values())
    assert all(paths[v] == (f"{paths[a]}/{p}" if a else p) for v, (a, p) in split.items())


def test_paths_of_a_chain(spark):
    rows = [(f"n{i:05}", f"n{i - 1:05}" if i else None, "g", i, None) for i in range(20000)]
    made = forest.Forest(spark.createDataFrame(rows, SCHEMA), forest.path_pieces(), forest.PIECES)
    assert forest.pieces(made).agg(F.max(F.length("path"))).first()[0] < 65 * 7
    got = forest.expand_paths(made.nodes(), spark.createDataFrame([("n19999",), ("n00000",)], "_id string")).collect()
    assert {r["_id"]: r["path"].count("/") for r in got} == {"n19999": 19999, "n00000": 0}


def test_many_pointers_to_one(spark, monkeypatch):
    monkeypatch.setattr(forest, "JUMP_HOT", 10)
    steps = [(i, 5000 if i < 4000 else i + 1 if i < 5010 else None, 1) for i in range(5011)]
    got = forest.jump(spark.createDataFrame(steps, "id long, ptr long, total long").withColumn("last", F.col("id")), ["last"]).collect()
    assert all(r["ptr"] is None and r["last"] == 5010 and r["total"] == (12 if r["id"] < 4000 else 5011 - r["id"]) for r in got)


def test_small_circle_across_partitions(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAST_ROWS", 1)
    rows = [("a", "b", "g1", 1, None), ("b", "c", "g2", 2, None), ("c", "a", "g3", 3, None), ("d", "a", "g4", 4, None), ("e", None, None, 5, None)]
    made = forest.Forest(spark.createDataFrame(rows, SCHEMA))
    assert {r[0] for r in made.circle_nodes().select("_id").collect()} == {"a", "b", "c"}
    assert {r["_id"]: r["state"] for r in made.nodes().collect()} == {"a": "circle", "b": "circle", "c": "circle", "d": "below_circle", "e": "tree"}


def test_empty(spark):
    made = forest.Forest(spark.createDataFrame([], SCHEMA))
    assert made.circle_nodes().count() == 0 and made.nodes().count() == 0


def test_clashing_columns(spark):
    rows = spark.createDataFrame([("a", None, None, 1, "x"), ("b", "a", None, None, None), ("b2", "a", "g", 2, "x")], SCHEMA).selectExpr("*", "1 AS size", "2 AS root", "3 AS weight")
    got = {r["_id"]: (r["root"], r["tag"]) for r in forest.Forest(rows).nodes().collect()}
    assert got == {"a": ("a", "x"), "b": ("a", None), "b2": ("a", "x")}


def test_first_rows(spark):
    df = spark.createDataFrame([("u", 2, "late"), ("u", 1, "early"), ("", 3, "x"), (None, 4, "y")], "k string, o long, v string")
    assert [tuple(r) for r in forest.first_rows(df, "k", "o", ["v"]).collect()] == [("u", 1, "early")]


def test_siblings_keep_order(spark):
    rows = [("r", None, "g", 0, None), ("b", "r", "g", 2, None), ("a", "r", "g", 1, None), ("c", "b", "g", 3, None)]
    got = forest.Forest(spark.createDataFrame(rows, SCHEMA)).nodes().orderBy("enter").select(F.collect_list("_id")).first()[0]
    assert got == ["r", "a", "b", "c"]
