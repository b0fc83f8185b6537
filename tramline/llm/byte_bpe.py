"""Byte-level BPE encoding and decoding by a two-tier lookup."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Bytes of a worker's memory of text units already encoded, and what an entry takes besides its own; it is emptied when full.
_MEMORY, _ENTRY = 128 << 20, 190
#: White space that is not ASCII, or that Python and Unicode class differently: such texts are split as a whole.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]")
#: A run of white space with what follows it. No token of the pattern crosses from other text into white space.
_UNIT = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


class PerfectHash:
    """A minimal perfect hash over byte strings by hash and displace: n keys, n slots, one displacement a bucket.

    A key's 64-bit hash picks its bucket; the bucket's displacement seeds a second hash that picks the slot.
    Buckets are placed from the largest down, each with the first displacement that meets free slots only.
    get() compares the stored key, so strings that are not keys give None.
    """

    def __init__(self, keys: list[bytes], values: list[int], load: int = 4):
        n = self.n = len(keys)
        self.buckets = max(1, n // load)
        buckets: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) < n:
            raise ValueError("keys repeat")
        for i, h in enumerate(hashes):
            buckets[h % self.buckets].append(i)
        self.shift = [0] * self.buckets
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        free = bytearray(b"\1" * n)
        for b in sorted(range(self.buckets), key=lambda b: -len(buckets[b])):
            d = 0
            while buckets[b]:
                slots = {self._slot(hashes[i], d) for i in buckets[b]}
                if len(slots) == len(buckets[b]) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for i in buckets[b]:
                s = self._slot(hashes[i], d)
                free[s], self.keys[s], self.values[s] = 0, keys[i], values[i]

    def _slot(self, h: int, d: int) -> int:
        h = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        return ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 >> 24 & 0xFFFFFFFFFF) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        s = self._slot(h, self.shift[h % self.buckets])
        return self.values[s] if self.keys[s] == key else None


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as lines:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]


class Codec:
    """Encodes and decodes with merge ranks; kept once per worker."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.rank = dict(ranks)
        self.token = [b""] * (max(self.rank.values(), default=-1) + 1)
        for k, v in ranks:
            self.token[v] = k
        self.split = regex.compile(pattern)
        self.memory: dict[str, bytes] = {}
        self.held = 0

    @cached_property
    def whole(self) -> PerfectHash:
        """Built when first used: decoding does without."""
        return PerfectHash(list(self.rank), list(self.rank.values()))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: adjacent tokens of the lowest rank merge first, the leftmost of equals before others.

        Tokens are a linked list over byte positions; a heap holds the ranks of adjacent pairs. Entries whose left
        token has gone or whose pair has changed since are skipped.
        """
        n, rank = len(piece), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            j = after[i]
            if j >= n or j < 0 or after[j] != end:
                continue
            after[i], after[j] = end, -1
            if end < n:
                before[end] = i
                if (r := rank.get(piece[i : after[end]])) is not None:
                    heappush(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := rank.get(piece[p:end])) is not None:
                heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : after[i]]])
            i = after[i]
        return out

    def _unit(self, unit: str) -> bytes:
        ids: list[int] = []
        for match in self.split.findall(unit):
            piece = match.encode()
            if (found := self.whole.get(piece)) is not None:
                ids.append(found)
            else:
                ids += self.merge(piece)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if _ODD_SPACE.search(text):
            return self._unit(text)
        units, memory = _UNIT.findall(text), self.memory
        try:
            return b"".join(map(memory.__getitem__, units))
        except KeyError:
            pass
        if self.held > _MEMORY:
            memory.clear()
            self.held = 0
        for u in units:
            if u not in memory:
                memory[u] = ids = self._unit(u)
                self.held += len(u) + len(ids) + _ENTRY
        return b"".join(map(memory.__getitem__, units))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_kept: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _kept:
        _kept[path, pattern] = Codec(path, pattern)
    return _kept[path, pattern]


def _small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in parts, so that a worker holds the ids of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """-> (id_col, ids binary: little-endian unsigned 32-bit), one row per input row and no shuffle.

    Each match of the pattern is encoded by itself, without special tokens: a match that is in the vocabulary by the
    perfect hash, others by merging. Null and empty texts have no ids. Repeated rows and rows without an id are
    encoded like others. Other columns are ignored; an empty table gives an empty result.
    """
    path, pattern = _defaults(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in _small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.encode(t or "") for t in batch.column(1).to_pylist()], pa.binary())], ["_id", "ids"])

    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return base.mapInArrow(run, "_id long, ids binary").withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id_col, ids) -> (id_col, ids, data binary): the bytes of the ids in turn, without reading them as text."""
    path, pattern = _defaults(path, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in _small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.decode(x) for x in batch.column(1).to_pylist()], pa.binary())], ["_id", "ids", "data"])

    return encoded.select(F.col(id_col).alias("_id"), "ids").mapInArrow(run, "_id long, ids binary, data binary").withColumnRenamed("_id", id_col)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )
