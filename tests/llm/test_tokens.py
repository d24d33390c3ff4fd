"""Token ids against the public library, and round trips."""

import random

import numpy as np
import pytest

from spanledger.llm import tokens


@pytest.fixture(scope="module")
def own():
    return tokens.Encoder()


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def texts():
    rng = random.Random(3)
    alphabet = "abcde  \n\t'stéü漢字カナ0123😀 　<|endoftext|>[[]]{{}}"
    out = ["", " ", "\n\n", "hello world", "it's  the\r\n\r\nend ", "<|endoftext|>", "a" * 3000, "漢字" * 700, "ab" * 2000, "\x00\x01", "é" * 50]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)]


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_matches_the_library(own, public):
    some = texts()
    assert split(*own.encode(some)) == [e.ids for e in public.encode_batch(some, add_special_tokens=False)]


def test_round_trip(own):
    some = texts()
    assert [own.decode(x) for x in split(*own.encode(some))] == some


def test_heap_and_rounds_agree(own):
    rng = random.Random(1)
    words = [bytes(rng.choice(b"aabbcde") for _ in range(rng.randrange(2, 400))) for _ in range(100)]
    assert split(*own.merge(words)) == [own.merge_long(w).tolist() for w in words]


def test_cache_starts_anew(own, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    want = split(*own.encode(["one two three four five"]))
    assert split(*own.encode(["one two three four five"])) == want


def test_frames(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_CHARS", 10)
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "x" * 50), (5, "hello world")], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in tokens.token_ids(docs, "doc_id", "text").collect()}
    assert got[2] == got[3] == [] and got[1] == got[5] == [31373, 995] and len(got[4]) > 1
    assert {r[0]: r[1] for r in tokens.token_counts(docs, "doc_id", "text").collect()} == {k: len(v) for k, v in got.items()}
    assert tokens.token_ids(docs.where("doc_id < 0"), "doc_id", "text").count() == 0
