"""Encoding of a corpus with a public byte-level BPE vocabulary.

Two tiers: a minimal perfect hash, built once on the driver from the vocabulary, resolves pre-tokens that are vocabulary
entries; all others are merged with a heap over a linked list of bytes.
"""

from __future__ import annotations

import base64
import heapq
import importlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ship

_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def hash_bytes(items: list[bytes]) -> np.ndarray:
    """64-bit polynomial hash of each byte string, computed over all of them at once."""
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    data = np.frombuffer(b"".join(items), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(lengths)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max(initial=0)), _MULT, np.uint64))
        place = np.arange(len(data)) - np.repeat(ends - lengths, lengths)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(data * powers[place], dtype=np.uint64)])
        return _mix(sums[ends] - sums[ends - lengths] + lengths.astype(np.uint64))


class MinimalPerfectHash:
    """Hash-and-displace: n keys fill exactly n slots; a lookup is two array gathers and one comparison of bytes."""

    def __init__(self, keys: list[bytes], values: list[int], per_bucket: int = 3):
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        h = hash_bytes(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        self.displace = np.zeros(self.buckets, np.int64)
        taken = np.zeros(n, bool)
        slot_of = np.full(n, -1, np.int64)
        free = None
        for b in np.argsort(-sizes, kind="stable"):
            ids = order[starts[b] : starts[b + 1]]
            if not len(ids):
                break
            if len(ids) == 1:
                # single keys take the slots left over; their slot is stored itself
                if free is None:
                    free = iter(np.flatnonzero(~taken))
                slot = next(free)
                self.displace[b], slot_of[ids[0]] = -slot - 1, slot
                continue
            d, step = 1, 16
            while True:
                # a block of displacements is tried at once
                tried = self._slots(h[ids][None, :], np.arange(d, d + step, dtype=np.uint64)[:, None])
                ordered = np.sort(tried, axis=1)
                good = ~taken[tried].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    d += int(good.argmax())
                    slots = tried[good.argmax()]
                    break
                d, step = d + step, min(4096, step * 4)
            self.displace[b] = d
            taken[slots], slot_of[ids] = True, slots
        self.keys = [b""] * n
        self.values = np.zeros(n, np.int32)
        for i, s in enumerate(slot_of):
            self.keys[s] = keys[i]
            self.values[s] = values[i]

    def _slots(self, h: np.ndarray, d) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_mix(h ^ (d * _MULT)) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, items: list[bytes]) -> list[int]:
        """Value of each item, -1 where it is no key."""
        if not items:
            return []
        h = hash_bytes(items)
        d = self.displace[(h % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(d < 0, -d - 1, self._slots(h, np.maximum(d, 0).astype(np.uint64)))
        keys = self.keys
        return [int(v) if keys[s] == x else -1 for s, v, x in zip(slots.tolist(), self.values[slots].tolist(), items, strict=True)]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one pre-token: a heap of pair ranks over a linked list of parts."""
    n = len(piece)
    end = list(range(1, n + 1))  # part i covers piece[i:end[i]]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, e = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != e:
            continue  # one of the two parts has changed since
        end[i], alive[j] = e, False
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encoder of one vocabulary file of ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = pattern
        self.table = MinimalPerfectHash(list(self.ranks), list(self.ranks.values()))
        self.cache: dict[str, list[int]] = {}
        self._find = None

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "_find": None}

    def encode_batch(self, texts: list[str | None], cache_entries: int = 200_000) -> list[list[int]]:
        if self._find is None:
            import regex

            self._find = regex.compile(self.pattern).findall
        split = [self._find(t) if t else [] for t in texts]
        cache = self.cache
        new = [p for p in dict.fromkeys(itertools.chain.from_iterable(split)) if p not in cache]
        if new:
            raw = [p.encode() for p in new]
            for p, b, i in zip(new, raw, self.table.lookup(raw), strict=True):
                cache[p] = [i] if i >= 0 else merge_bytes(b, self.ranks)
        out = [list(itertools.chain.from_iterable(map(cache.__getitem__, s))) for s in split]
        if len(cache) > cache_entries:
            cache.clear()
        return out


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and split pattern of a vocabulary file that is installed beside the engine, never inside it."""
    m = importlib.import_module("public_tokenizers")
    return m.path(name), m.PATTERN


def encode_corpus(df: DataFrame, key: str, text: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``key`` and ``ids`` (array<int>): the text encoded without special tokens; null and empty texts give an empty list.

    Narrow: one pass, no shuffle. The encoder (a few MB, its size fixed by the vocabulary) is broadcast once.
    Repeated rows are kept; other columns are dropped.
    """
    if path is None:
        path, pattern = public_vocabulary()
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(Encoder(path, pattern))

    def encode(batches):
        e = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                ids = e.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["k", "ids"])

    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return src.mapInArrow(encode, f"k {dict(src.dtypes)['k']}, ids array<int>").withColumnRenamed("k", key)
