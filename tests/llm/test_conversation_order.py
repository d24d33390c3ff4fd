"""The order of messages against a plain walk, with a session cut into slices."""

import random
from hashlib import md5

import pytest

from spanledger.llm.conversations import Conversations
from spanledger.operators import forest

SCHEMA = "line_id long, session_id string, agent_id string, uuid string, parent_uuid string, role string, content string, order long"


def walk(rows):
    """line_id of every line: parents first, siblings by their order, undated ones last."""
    key = {r[3]: (2**62 if r[7] is None else r[7], md5(f"{r[1]}\0{r[3]}".encode()).digest()) for r in rows}
    below = {}
    for r in rows:
        below.setdefault(r[4], []).append(r)
    todo = sorted(below[None], key=lambda r: (key[r[3]][0], r[0]), reverse=True)
    out = []
    while todo:
        r = todo.pop()
        out.append(r[0])
        todo += sorted(below.get(r[3], []), key=lambda c: key[c[3]], reverse=True)
    return out


def listed(made):
    return [r["line_id"] for r in made.ordered().orderBy("session_id", "agent_id", "root_order", "root_line", "seq").collect()]


def test_undated_parent_in_the_last_slice(spark, monkeypatch):
    monkeypatch.setattr(forest, "GROUP_ROWS", 10)
    monkeypatch.setattr(forest, "LEAST_ROWS", 2)
    # u1 and u2 are undated, hence in one slice; u3 is dated, in an earlier one.
    rows = [(1, "s", None, "u1", None, "assistant", "a", None), (2, "s", None, "u2", "u1", "assistant", "b", None), (3, "s", None, "u3", "u1", "assistant", "c", 1)]
    rows += [(i, "s", None, f"u{i}", "u3", "assistant", "d", i) for i in range(4, 16)]
    assert listed(Conversations(spark.createDataFrame(rows, SCHEMA))) == walk(rows) == [1, 3, *range(4, 16), 2]


@pytest.mark.parametrize("seed,n,limit,near", [(1, 120, 10, 4), (2, 300, 30, 40), (3, 300, 12, 3), (4, 200, 1000, 9)])
def test_order_against_walk(spark, monkeypatch, seed, n, limit, near):
    monkeypatch.setattr(forest, "GROUP_ROWS", limit)
    monkeypatch.setattr(forest, "LEAST_ROWS", 10)
    rng = random.Random(seed)
    rows = [(i, "s", None, f"u{i}", None if i == 0 or rng.random() < 0.02 else f"u{rng.randrange(max(0, i - near), i)}", "assistant", "x", rng.choice([i, i, rng.randrange(n), None])) for i in range(n)]
    assert listed(Conversations(spark.createDataFrame(rows, SCHEMA))) == walk(rows)
