"""Conversations against a plain walk, with sessions cut into slices."""

import random

import pytest

from spanledger.llm.conversations import Conversations
from spanledger.operators import forest

SCHEMA = "line_id long, session_id string, agent_id string, uuid string, parent_uuid string, role string, content string, order long"


def plain(rows):
    """{(session, agent): (broken, empty, unanswered)} to leave out."""
    lines, loose = {}, []
    for r in sorted(rows):
        _, s, a, u, p, role, content, _ = r
        if not s:
            continue
        word = (role or "").strip().lower()
        kind = word if word in ("user", "assistant") and content is not None and content.strip() else None
        if u:
            lines.setdefault((s, u), (a or "", p, kind))
        else:
            loose.append(((s, a or ""), kind))
    talks, out, waits = {}, set(), set()
    for (s, u), (a, p, kind) in lines.items():
        talks.setdefault((s, a), []).append(kind)
        seen, x = set(), u
        while x is not None and (s, x) in lines and x not in seen:
            seen.add(x)
            x = lines[s, x][1]
        if x is not None:
            out.add((s, a))
    for talk, kind in loose:
        talks.setdefault(talk, []).append(kind)
        if kind == "user":
            waits.add(talk)
    empty = {t for t, kinds in talks.items() if not any(kinds)}
    answered = set()
    for (s, u), (a, p, kind) in lines.items():
        if kind == "assistant":
            x, seen = p, {u}
            while x is not None and (s, x) in lines and lines[s, x][0] == a and x not in seen:
                if lines[s, x][2] == "user":
                    answered.add((s, x))
                    break
                seen.add(x)
                x = lines[s, x][1]
    waits |= {(s, a) for (s, u), (a, p, kind) in lines.items() if kind == "user" and (s, u) not in answered}
    return {t: (t in out, t in empty, t in waits) for t in out | empty | waits}


def make(seed, n, sessions, agents):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s, a = f"s{rng.randrange(sessions)}", rng.choice([None, *(f"a{k}" for k in range(agents))])
        same = [r for r in rows if r[1] == s and r[3]]
        talk = [r for r in same if r[2] == a]
        p = None
        if same and rng.random() < 0.9:
            p = rng.choice((talk or same)[-4:] if rng.random() < 0.9 else same)[3]
        elif rng.random() < 0.05:
            p = "gone"
        elif rng.random() < 0.3:
            p = f"u{min(n - 1, i + rng.randrange(9))}"
        role = rng.choice(["user", "assistant", " Assistant", "assistant", "USER ", None, "system"])
        rows.append((i, s, a, None if rng.random() < 0.01 else f"u{i}", p, role, rng.choice(["text", "more", "text", " \n", None]), i))
        if rng.random() < 0.05:
            rows.append((n + i, *rows[-1][1:]))
    return rows


@pytest.mark.parametrize("seed,n,sessions,agents,limit", [(1, 400, 60, 2, 1000), (2, 300, 2, 3, 20), (3, 200, 20, 0, 4), (4, 150, 40, 1, 1000)])
def test_rejected_against_walk(spark, monkeypatch, seed, n, sessions, agents, limit):
    monkeypatch.setattr(forest, "GROUP_ROWS", limit)
    rows = make(seed, n, sessions, agents)
    made = Conversations(spark.createDataFrame(rows, SCHEMA))
    assert {(r["session_id"], r["agent_id"]): (r["broken"], r["empty"], r["unanswered"]) for r in made.rejected().collect()} == plain(rows)


def test_order_and_edge_cases(spark):
    rows = [
        (1, "s", None, "u1", None, "user", "q", 10), (2, "s", None, "u2", "u1", "assistant", "a", 30), (3, "s", None, "u3", "u1", "assistant", "b", 20), (4, "s", None, "u4", "u3", "user", "c", 5),
        (5, "s", None, "u5", "u4", "assistant", "d", 4), (6, None, None, "u6", None, "user", "lost", 1), (7, "t", "x", "u7", "u7", "user", "loop", 1), (8, "e", "", None, None, None, None, None),
    ]
    made = Conversations(spark.createDataFrame(rows, SCHEMA))
    assert {(r[0], r[1], *r[2:]) for r in made.rejected().collect()} == {("t", "x", True, False, True), ("e", "", False, True, False)}
    got = made.ordered().orderBy("session_id", "agent_id", "root_order", "root_line", "seq").collect()
    assert [r["line_id"] for r in got] == [1, 3, 4, 5, 2]


def test_no_lines(spark):
    made = Conversations(spark.createDataFrame([], SCHEMA))
    assert made.rejected().count() == 0 and made.ordered().count() == 0
