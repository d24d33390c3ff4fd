"""Cut texts: endings, field limits, and the prefix join against brute force."""

import random

import pytest

from spanledger.llm import truncation as tr


@pytest.mark.parametrize("text,want", [
    (None, tr.BLANK), ("", tr.BLANK), (" \n", tr.BLANK), ("A whole sentence.", tr.COMPLETE), ("Half a sent", tr.SENTENCE_OPEN), ("Text ''in italics.''", tr.COMPLETE), ("東京都。", tr.COMPLETE), ("東京都の", tr.SENTENCE_OPEN),
    ("One. [[Cat", tr.MARKUP_OPEN), ("One.\n[[Category:Foo]]", tr.STRUCTURE), ("One.<ref>Author, p. 3", tr.MARKUP_OPEN), ("One.<ref>Author, p. 3.</ref>", tr.STRUCTURE), ("One.{{cite book |ti", tr.MARKUP_OPEN),
    ("{{Infobox\n| a = b\n| c", tr.MARKUP_OPEN), ("{{Infobox\n| a = b\n}}", tr.STRUCTURE), ("x.\n* item without stop", tr.ITEM), ("x.\n* [[Link]]", tr.STRUCTURE), ("x.\n== Head ==", tr.STRUCTURE), ("x.\n== He", tr.MARKUP_OPEN), ("x <!-- note", tr.MARKUP_OPEN),
    ("{{open one\n\nThen a paragraph.", tr.COMPLETE), ("{{open|one. Then it ends..", tr.COMPLETE), ("cut here…", tr.MARKED), ("cut here [...]", tr.MARKED), ("{| class=x\n|-\n| 1 || 2", tr.MARKUP_OPEN), ("{|\n| 1\n|}", tr.STRUCTURE), ("ab�", tr.SENTENCE_OPEN),
])
def test_ending(text, want):
    assert tr.ending(text) == want


def test_prefixes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tr, "SORT_BYTES", 100)
    rng = random.Random(4)
    texts = ["ab", "ab", "ab"] * 20 + ["".join(rng.choice("ab ") for _ in range(rng.randrange(1, 9))) for _ in range(150)] + ["abc", "a\nb", "漢字と", "漢字"]
    rows = list(enumerate(texts)) + [(900, None), (901, "")]
    got = {r[0] for r in tr.prefix_of_longer(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").select("doc_id").collect()}
    assert got == {i for i, t in rows if t and any(o and len(o) > len(t) and o.startswith(t) for _, o in rows)}


def test_evidence(spark):
    prose = "This is a long sentence about a thing that goes on for a while and then it ends here. "
    rows = [(i, "limited", (prose * 9)[:400] if i % 2 else prose * (1 + i % 4)) for i in range(40)]
    rows += [(100 + i, "free", prose * (i + 1)) for i in range(8)]
    rows += [(200, "free", prose + "* A list\n* item that"), (201, "mirror", prose + "* A list\n* item that goes on further"), (202, "free", None), (203, None, ""), (204, None, "Ends in the mid"), (205, "free", prose + "\n\n== Heading =="), (206, "mirror", prose + "\n\n== Heading ==\nText of it.")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS ending", "2 AS truncated")
    told = tr.evidence(docs, "doc_id", "text", "source")
    got = {r["doc_id"]: r for r in told.collect()}
    assert len(got) == len(rows)
    assert {i for i, r in got.items() if r["truncated"]} == {*range(1, 40, 2), 200, 204}
    assert got[205]["has_longer"] and not got[205]["inside_line"]
    shares = {r["source"]: r["share"] for r in tr.source_shares(told).collect()}
    assert shares["limited"] == 0.5 and shares["mirror"] == 0


def test_empty(spark):
    assert tr.evidence(spark.createDataFrame([], "doc_id long, source string, text string"), "doc_id", "text", "source").count() == 0
