"""Containers: nothing lost, nothing overfull, little room left; the curve visits every cell by single steps."""

import itertools

import numpy as np
import pytest

from spanledger.llm import packing


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_steps(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = packing.hilbert(points, bits)
    assert sorted(keys.tolist()) == list(range(len(points)))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_pack_keeps_everything(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", 150)
    monkeypatch.setattr(packing, "STRETCH", 64)
    rng = np.random.default_rng(0)
    rows = [(i, int(n), int(rng.integers(1000))) for i, n in enumerate([0, 0, 50, 100, 51, 500, *rng.integers(1, 120, 400)])]
    specs = [(1, 50), (2, 100), (3, 1000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long, curve long"), "doc_id", specs).toPandas()
    for spec, capacity in specs:
        mine = got[got.spec_id == spec]
        for i, n, _ in rows:
            doc = mine[mine.doc_id == i].sort_values("piece_no")
            assert doc.n_tokens.sum() == n
            assert doc.first_token.tolist() == list(range(0, max(n, 1), capacity))
            assert len(doc) == max(1, -(-n // capacity))
        packed = mine[mine.container_id.notna()].groupby("container_id").n_tokens.sum()
        assert packed.max() <= capacity
        assert len(packed) <= 1.1 * packed.sum() / capacity + 8
        assert mine[mine.n_tokens == 0].container_id.isna().all()


def test_documents(spark):
    docs = spark.createDataFrame([(1, "hello world " * 30), (2, None), (3, ""), (4, "hello world"), (5, "\n" * 5)], "doc_id long, text string")
    spec = spark.createDataFrame([(1, 16), (2, 64)], "spec_id int, capacity_tokens int")
    got = packing.pack_documents(docs, "doc_id", "text", spec).toPandas()
    assert set(got.doc_id) == {1, 2, 3, 4, 5} and got[got.doc_id.isin([2, 3])].container_id.isna().all()
    assert packing.pack_documents(docs.where("doc_id = 0"), "doc_id", "text", spec).count() == 0


def test_bad_capacity(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long, curve long"), "doc_id", [(1, 0)])
