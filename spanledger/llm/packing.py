"""Items of varying length into containers of fixed capacity (problem 9), along a space-filling curve.

A document's tokens are hashed into a vector, projected to a few dimensions and given its place on a Hilbert curve.
Documents are sorted by that place, so that neighbours in a container tend to be alike, and packed by best fit within
stretches of the curve.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .tokens import BYTE_BPE_50K, encoded_batches

BUCKETS, DIMS, BITS = 128, 4, 12
#: Items that are sorted by size and placed together; containers that stay open for the next ones.
STRETCH, OPEN_CONTAINERS = 4096, 512
#: Items of one packing task.
TASK_ITEMS = 400_000
#: Items that are worth a task of their own while cores are free: a few stretches each, as a task leaves its last containers open.
LEAST_ITEMS = 8 * STRETCH
#: Capacities that one run may serve; each document has a row for each.
MAX_SPECS = 1000


def _projection() -> np.ndarray:
    return np.random.default_rng(9).standard_normal((BUCKETS, DIMS)) / math.sqrt(DIMS)


def vectors(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The projected unit vectors of hashed token counts (damped by a square root), one row for each text."""
    n = len(counts)
    buckets = ((ids.astype(np.uint64) * np.uint64(2654435761)) % np.uint64(2**32)) >> np.uint64(25)
    rows = np.repeat(np.arange(n, dtype=np.int64), counts)
    table = np.sqrt(np.bincount(rows * BUCKETS + buckets.astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS))
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm > 0, norm, 1)) @ _projection()


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of non-negative integer points (rows) below 2**bits, by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            inside = (x[i] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(inside, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def sized_documents(docs: DataFrame, key: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """(key, n_tokens, y: projected vector), one pass over the texts; null and empty texts have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, counts in encoded_batches(batch.column(1), path):
                flat = vectors(ids, counts).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * DIMS), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts, type=pa.int64()), lists], names=[key, "n_tokens", "y"])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens bigint, y array<float>")


def with_curve(sized: DataFrame) -> DataFrame:
    """sized with `curve`, the place on the curve; each dimension is scaled by its mean and spread over all documents."""
    stats = sized.where("n_tokens > 0").agg(*(f(F.col("y")[i]).alias(f"{n}{i}") for i in range(DIMS) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(DIMS)])
    spread = np.array([stats[f"s{i}"] or 1.0 for i in range(DIMS)])

    @F.pandas_udf(T.LongType())
    def place(y: pd.Series) -> pd.Series:
        if not len(y):
            return pd.Series([], dtype="int64")
        z = (np.stack(y.to_list()) - mean) / spread
        cells = np.clip(1 / (1 + np.exp(-1.7 * z)) * (1 << BITS), 0, (1 << BITS) - 1)
        return pd.Series(hilbert(cells.astype(np.int64)))

    return sized.withColumn("curve", place("y")).drop("y")


class BestFit:
    """Open containers by free space; an item goes where it leaves least."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.free = capacity, first, []

    def stretch(self, sizes: list[int]) -> list[int]:
        """The container of each item of a stretch; large items choose first."""
        out = [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = bisect_left(self.free, (sizes[i], -1))
            if at < len(self.free):
                room, where = self.free.pop(at)
            else:
                room, where = self.capacity, self.next
                self.next += 1
            out[i] = where
            if room > sizes[i]:
                insort(self.free, (room - sizes[i], where))
        if len(self.free) > OPEN_CONTAINERS:  # those with least room close
            del self.free[: len(self.free) - OPEN_CONTAINERS]
        return out


def pack(sized: DataFrame, key: str, specs: list[tuple[int, int]]) -> DataFrame:
    """spec_id, container_id, key, piece_no, first_token, n_tokens of every piece of every document.

    A document longer than the capacity is cut into full containers and a rest; no other is. A document without tokens
    takes no room: it has one row without container. Containers are unique within a spec.
    """
    if len(specs) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} capacities")
    if any(c is None or c <= 0 for _, c in specs):
        raise ValueError("a capacity must be positive")
    columns = ["spec_id", "container_id", key, "piece_no", "first_token", "n_tokens"]
    # Of the literal list of capacities every document gets an item each: its rest, and the full pieces before it.
    each = F.explode(F.array(*(F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in specs)))
    items = sized.withColumn("_s", each).select("_s.*", key, "curve", "n_tokens", (F.col("n_tokens") % F.col("_s.capacity")).alias("rest"), F.floor(F.col("n_tokens") / F.col("_s.capacity")).cast("long").alias("full"))
    none = items.where("n_tokens = 0").select("spec_id", F.lit(None).cast("string").alias("container_id"), key, F.lit(0).cast("long").alias("piece_no"), F.lit(0).cast("long").alias("first_token"), "n_tokens")
    pieces = items.where("full > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece_no"))
    whole = pieces.select("spec_id", F.concat_ws(":", F.lit("f"), F.col(key), "piece_no").alias("container_id"), key, "piece_no", (F.col("piece_no") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("n_tokens"))
    rests = items.where("rest > 0")
    n = rests.count()
    schema = T.StructType([T.StructField("spec_id", T.IntegerType()), T.StructField("container_id", T.StringType()), sized.schema[key], *(T.StructField(c, T.LongType()) for c in columns[3:])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, packers, held = TaskContext.get().partitionId(), {}, None

        def place(frame: pd.DataFrame) -> pd.DataFrame:
            spec, capacity = int(frame["spec_id"].iloc[0]), int(frame["capacity"].iloc[0])
            packer = packers.setdefault(spec, BestFit(capacity, 0))
            where = [f"r:{part}:{c}" for c in packer.stretch(frame["rest"].tolist())]
            full = frame["full"].to_numpy()
            return pd.DataFrame({"spec_id": frame["spec_id"], "container_id": where, key: frame[key], "piece_no": full, "first_token": full * capacity, "n_tokens": frame["rest"]})[columns]

        for pdf in batches:
            held = pdf if held is None or not len(held) else pd.concat([held, pdf], ignore_index=True)
            while len(held):
                same = int((held["spec_id"].to_numpy() == held["spec_id"].iloc[0]).argmin()) or len(held)
                if same == len(held) and same < STRETCH:
                    break
                take = min(same, STRETCH)
                yield place(held.iloc[:take])
                held = held.iloc[take:].reset_index(drop=True)
        if held is not None and len(held):
            yield place(held)

    parts = max(1, math.ceil(n / TASK_ITEMS), min(sized.sparkSession.sparkContext.defaultParallelism, n // LEAST_ITEMS))
    laid = rests.select("spec_id", "capacity", "curve", key, "rest", "full").repartitionByRange(parts, "spec_id", "curve", key).sortWithinPartitions("spec_id", "curve", key)
    return laid.mapInPandas(run, schema).unionByName(whole).unionByName(none)


def pack_documents(docs: DataFrame, key: str, text: str, container_spec: DataFrame, path: str = BYTE_BPE_50K) -> DataFrame:
    """pack() of the texts' token counts for every capacity of container_spec (spec_id, capacity_tokens)."""
    specs = [(r["spec_id"], r["capacity_tokens"]) for r in container_spec.select("spec_id", "capacity_tokens").distinct().orderBy("spec_id").limit(MAX_SPECS + 1).collect()]
    sized = materialize(sized_documents(docs, key, text, path), "sized")
    curved = materialize(with_curve(sized), "curve")
    return pack(curved, key, specs)
