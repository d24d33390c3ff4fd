"""Encoding of a whole corpus with a public byte-level BPE vocabulary (problem 8).

Texts are split by the vocabulary's pattern; the distinct words of a batch that aren't known yet are merged together
in numpy rounds. All their symbols lie in one flat array with the rank of each neighbouring pair beside it; a round
merges the lowest-ranked pair of every word and looks up only the pairs that changed, by binary search over the
sorted pair keys.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files.
VOCABULARIES = "/opt/tokenizers"
BYTE_BPE_50K = f"{VOCABULARIES}/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NONE = np.int32(2**31 - 1)
#: Words of more bytes are merged one by one with a heap: a round for each of their merges would cost the square.
LONG_WORD = 1024
#: Entries of a worker's dictionary of encoded words; beyond it the dictionary starts anew.
CACHE_WORDS = 300_000
#: Characters that are split and encoded at once, however many rows they are.
BATCH_CHARS = 4_000_000


class Encoder:
    """Encodes texts with the ranks of one vocabulary file; ids are ranks. Texts are ordinary text throughout."""

    def __init__(self, path: str = BYTE_BPE_50K, pattern: str = PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.words = {rank: word for word, rank in ranks.items()}
        self.base = max(ranks.values()) + 1
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                a, b = ranks.get(word[:cut]), ranks.get(word[cut:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.store, self.used = np.empty(1 << 16, dtype=np.int32), 0
        self.starts, self.lengths = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, _NONE if they don't merge."""
        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each); no word may be empty."""
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        s = self.bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]
        starts = np.cumsum(lens) - lens
        rank = np.full(len(s), _NONE, dtype=np.int32)
        if len(s) > 1:
            rank[:-1] = self._rank(s[:-1], s[1:])
        rank[starts + lens - 1] = _NONE
        which = np.arange(len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(which):
            lowest = np.minimum.reduceat(rank, starts)
            alive = lowest != _NONE
            if not alive.all():
                kept = np.repeat(alive, lens)
                done.append((which[~alive], lens[~alive], s[~kept]))
                s, rank, which, lens, lowest = s[kept], rank[kept], which[alive], lens[alive], lowest[alive]
                starts = np.cumsum(lens) - lens
                if not len(which):
                    break
            hits = np.flatnonzero(rank == np.repeat(lowest, lens))
            at = hits[np.searchsorted(hits, starts)]  # the leftmost of each word
            s[at] = lowest
            kept = np.ones(len(s), dtype=bool)
            kept[at + 1] = False
            s, rank = s[kept], rank[kept]
            gone = np.arange(len(which))
            at, starts, lens = at - gone, starts - gone, lens - 1
            ends = starts + lens - 1
            rank[at] = _NONE
            inner = at[at < ends]
            rank[inner] = self._rank(s[inner], s[inner + 1])
            inner = at[at > starts] - 1
            rank[inner] = self._rank(s[inner], s[inner + 1])
        return self._ordered(done, len(words))

    @staticmethod
    def _ordered(done: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
        if not done:
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
        which, lens, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(which, kind="stable")
        return take_runs(ids, np.cumsum(lens) - lens, lens, order), lens[order]

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word: the same merges, lowest rank first and leftmost among equals, off a heap."""
        ids = self.bytes[np.frombuffer(word, dtype=np.uint8)]
        first = self._rank(ids[:-1], ids[1:]).tolist()
        ids = ids.tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        ranks = self._pairs()
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                k = after[i]
                if (x := ranks.get(r * self.base + ids[k])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (h := before[i]) >= 0 and (x := ranks.get(ids[h] * self.base + r)) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def _pairs(self) -> dict[int, int]:
        if not hasattr(self, "_table"):
            self._table = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        return self._table

    def _learn(self, words: list[str]) -> None:
        """Encode words that aren't known and keep them."""
        coded = [w.encode() for w in words]
        short = [i for i, w in enumerate(coded) if len(w) <= LONG_WORD]
        ids, lens = self.merge([coded[i] for i in short])
        if len(short) < len(words):
            pieces = {i: p for i, p in zip(short, np.split(ids, np.cumsum(lens)[:-1]))}
            pieces |= {i: self.merge_long(w) for i, w in enumerate(coded) if i not in pieces}
            ids = np.concatenate([pieces[i] for i in range(len(words))])
            lens = np.array([len(pieces[i]) for i in range(len(words))], dtype=np.int64)
        need = self.used + len(ids)
        if need > len(self.store):
            self.store = np.concatenate([self.store[: self.used], np.empty(max(need, len(self.store)), dtype=np.int32)])
        self.store[self.used : need] = ids
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lens) - lens])
        self.lengths = np.concatenate([self.lengths, lens])
        self.used = need

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each)."""
        if len(self.known) > CACHE_WORDS:
            self._clear()
        split = [self.split(t) for t in texts]
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        words = [w for part in split for w in part]
        if fresh := [w for w in dict.fromkeys(words) if w not in self.known]:
            self._learn(fresh)
        at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        lens = self.lengths[at]
        ids = take_runs(self.store, self.starts, self.lengths, at)
        upto = np.concatenate([[0], np.cumsum(lens)])
        ends = np.cumsum(counts)
        return ids, upto[ends] - upto[ends - counts]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.words[i] for i in ids).decode("utf-8", "replace")


def take_runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of values that begin at starts[which], one after the other."""
    lens = lengths[which]
    total = int(lens.sum())
    shift = starts[which] - (np.cumsum(lens) - lens)
    return values[np.repeat(shift, lens) + np.arange(total)]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    return Encoder(path)


def encoded_batches(texts: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, ids, ids of each row) over an Arrow column, in pieces of about BATCH_CHARS characters."""
    coder, n, lo = encoder(path), len(texts), 0
    sizes = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + n + 1]).tolist() if n else []
    while lo < n:
        hi, size = lo, 0
        while hi < n and (hi == lo or size + sizes[hi] <= BATCH_CHARS):
            size += sizes[hi]
            hi += 1
        ids, counts = coder.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
        yield lo, hi, ids, counts
        lo = hi


def token_ids(docs: DataFrame, key: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids): the ids of each text without special tokens. Null and empty texts have an empty list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo, hi, ids, counts in encoded_batches(texts, path):
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), lists], names=[key, "ids"])

    kept = docs.select(F.col(key), F.col(text).cast("string"))
    return kept.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(docs: DataFrame, key: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """(key, n_tokens) of each text; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [c for *_, c in encoded_batches(batch.column(1), path)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts) if counts else [], type=pa.int64())], names=[key, "n_tokens"])

    kept = docs.select(F.col(key), F.col(text).cast("string"))
    return kept.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens bigint")
