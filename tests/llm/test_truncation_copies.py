"""The prefix join against brute force over all longer texts: many copies, many partitions, short texts."""

import random

import pytest

from spanledger.llm import truncation as tr

START = "A text that is long enough to count as a copy"


def brute(rows):
    """{key: inside_line} of the texts that any longer one goes on from."""
    texts = {t for _, t in rows if t}
    ahead = {}
    for t in texts:
        longer = [u for u in texts if len(u) > len(t) and u.startswith(t)]
        if longer:
            ahead[t] = any(tr._goes_on(t, u) for u in longer)
    return {k: ahead[t] for k, t in rows if t in ahead}


def found(spark, rows):
    got = tr.prefix_of_longer(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    return {r["doc_id"]: r["inside_line"] for r in got}


@pytest.mark.parametrize("others", [[], ["Z other text, of which no longer copy exists here"], ["Z other text, cut short in the middle of a wo", "Z other text, cut short in the middle of a word"]])
def test_many_copies(spark, monkeypatch, others):
    texts = [START] * 23 + [START + "\nand a line"] * 7 + [START + "\nand a line more"] + others
    rows = list(enumerate(texts))
    assert found(spark, rows) == brute(rows)
    monkeypatch.setattr(tr, "SORT_BYTES", 60)
    assert found(spark, rows) == brute(rows)


def test_a_line_break_doesnt_hide_the_rest_of_a_word(spark):
    rows = [(1, "a short cut te"), (2, "a short cut te\nand more"), (3, "a short cut text"), (4, "x"), (5, "xyz")]
    assert found(spark, rows) == brute(rows) == {1: True, 4: True}


@pytest.mark.parametrize("seed,bytes_", [(7, 32 << 20), (8, 200), (9, 30), (10, 1)])
def test_against_brute_force(spark, monkeypatch, seed, bytes_):
    monkeypatch.setattr(tr, "SORT_BYTES", bytes_)
    monkeypatch.setattr(tr, "KEY_CHARS", 2)
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab\n.") for _ in range(rng.randrange(0, 6))) + "c" * rng.randrange(2) for _ in range(300)] + ["aaab"] * 100 + ["aaabbbbbbbbb. x"] * 40 + ["漢字。", "漢字。と", "a" * 40, "a" * 41 + ". b"]
    rows = list(enumerate(texts)) + [(1000, None)]
    assert found(spark, rows) == brute(rows)


def test_follow_bits_say_what_goes_on_says():
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("ab .\n\r\"漢。\t") for _ in range(rng.randrange(1, 5)))
        c = rng.choice("ab .\n\r\"漢。\t")
        assert bool(tr._wanted(t) and tr._bits(c) & tr._wanted(t)) == tr._goes_on(t, t + c)
