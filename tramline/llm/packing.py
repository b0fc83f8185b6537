"""Packing token sequences by minimum bin slack over the multiset of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import filterfalse
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, numbered, sliced, table

#: Production parameters of op7.
CAPACITY, END_ID = 4096, 2
_BUCKETS = 1024
#: Bytes of a worker's memory of chunks already tokenised, and what an entry takes besides its own; it is emptied when full.
_MEMORY, _ENTRY = 128 << 20, 170
#: Texts that are tokenised in one go.
_TOGETHER = 32


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Chunks(dict):
    """White-space delimited chunk, A-Z lower-cased -> its ids as little-endian bytes.

    The tokenizer lower-cases and drops white space, and no token crosses it: a text's ids are those of its chunks.
    Nor does one cross from a letter or digit into the marks after it, so a chunk's ids are those of its stem and
    its closing marks. (A letter that lower-cases or normalises to one with a combining mark is none here: the
    pre-tokenizer joins that mark with what follows.) Stems of letters only are one word each; many are tokenised in one call.
    """

    #: Closing marks that may be cut off. No apostrophe (contractions) and no angle bracket (special tokens).
    MARKS = b".,;:!?%&*$#|"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.held = 0

    def __setitem__(self, chunk: bytes, ids: bytes) -> None:
        self.held += len(chunk) + len(ids) + _ENTRY
        super().__setitem__(chunk, ids)

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Chunks that are new to any of the texts are learned together first."""
        split = [(t or "").encode().lower().split() for t in texts]  # ASCII only; other letters and white space are left to the tokenizer
        if self.held > _MEMORY:
            self.clear()
            self.held = 0
        known, new = self.__contains__, set()
        for chunks in split:
            new.update(filterfalse(known, set(chunks)))
        if new:
            cut = {c: self._cut(c) for c in new}
            self._learn({part for parts in cut.values() for part in parts if part not in self})
            for c, parts in cut.items():
                if len(parts) > 1:
                    self[c] = self[parts[0]] + self[parts[1]]
        return [b"".join(map(self.__getitem__, chunks)) for chunks in split]

    def _cut(self, chunk: bytes) -> tuple[bytes, ...]:
        stem = chunk.rstrip(self.MARKS)
        if not stem or len(stem) == len(chunk):
            return (chunk,)
        return (stem, chunk[len(stem) :]) if normalize("NFC", stem.decode()[-1].lower()).isalnum() else (chunk,)

    def _learn(self, parts: set[bytes]) -> None:
        texts = {p: p.decode() for p in parts}
        words = [p for p, t in texts.items() if t.isascii() and t.isalpha() or t.isalpha() and normalize("NFC", t.lower()).isalpha()]
        if len(words) > 1:
            found = self.tokenizer.encode(" ".join(texts[p] for p in words), add_special_tokens=False)
            ids, of = np.array(found.ids, "<u4"), np.array(found.word_ids)
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            if len(starts) == len(words):
                data, bounds = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                for p, x, y in zip(words, bounds, bounds[1:]):
                    self[p] = data[x:y]
        rest = [p for p in parts if p not in self]
        for p, found in zip(rest, self.tokenizer.encode_batch([texts[p] for p in rest], add_special_tokens=False)):
            self[p] = np.array(found.ids, "<u4").tobytes()


_kept: dict[str, _Chunks] = {}


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    if path not in _kept:
        _kept[path] = _Chunks(path)
    chunks = _kept[path]
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
    for batch in sliced(batches):
        rows: list[list] = [[], [], [], [], []]
        keys = batch.column(0).to_pylist()
        for first in range(0, len(keys), _TOGETHER):
            texts = batch.column(1).slice(first, _TOGETHER).to_pylist()
            for key, ids in zip(keys[first : first + _TOGETHER], chunks.encode_all(texts)):
                ids += end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    for column, x in zip(rows, (key, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)):
                        column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["_id", "start", "length", "ids_crc32", "doc_tokens"])


def fill(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Minimum bin slack: [(how many windows, {length: pieces a window})], using every piece once.

    The largest piece left opens a window. A bitset holds the sums that the other pieces can make; lengths join it
    from the largest down, each in parts of 1, 2, 4, ... pieces up to its count, until the window's room can be met
    exactly. The best sum is traced back to counts of each length, and the window is repeated as often as the counts
    allow. Work and result depend on the number of different lengths (at most the capacity), not on the pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("piece lengths must lie within the capacity")
    order, plan = sorted(left, reverse=True), []
    while left:
        order = [n for n in order if n in left]
        seed = order[0]
        room, used = capacity - seed, {seed: 1}
        reach, mask, trail = 1, (1 << room + 1) - 1, []
        for n in order:
            if n > room:
                continue
            free, part = min(left[n] - (n == seed), room // n), 1
            while free > 0 and not reach >> room & 1:
                part = min(part, free)
                trail.append((n, part, reach))
                reach |= reach << n * part & mask
                free, part = free - part, 2 * part
            if reach >> room & 1:
                break
        total = reach.bit_length() - 1
        for n, part, before in reversed(trail):
            if not before >> total & 1:
                used[n] = used.get(n, 0) + part
                total -= n * part
        times = min(left[n] // k for n, k in used.items())
        plan.append((times, used))
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return plan


def _ranges(plan: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The plan as ranges of piece ranks: (length and first rank, first sequence, pieces a window, offset), sorted."""
    rows, taken, sequence = [], {}, 0
    for times, used in plan:
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            rows.append((n << 44 | taken.get(n, 0), sequence, k, offset))
            taken[n] = taken.get(n, 0) + times * k
            offset += n * k
        sequence += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4


def _place(batches: Iterator[pa.RecordBatch], ranges) -> Iterator[pa.RecordBatch]:
    first, sequence, pieces, offset = ranges
    for batch in batches:
        length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
        key = length << 44 | rank
        at = np.searchsorted(first, key, "right") - 1
        nth = key - first[at]
        out = [pa.array(sequence[at] + nth // pieces[at]), pa.array(offset[at] + nth % pieces[at] * length)]
        names = [n for n in batch.schema.names if n != "_rank"]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + out, [*names, "sequence_id", "offset"])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """-> (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset; all long), one row per piece.

    A text's ids (null: none) and end_id are cut into pieces of `capacity` ids and a rest; the rests fill windows of
    at most `capacity` by minimum bin slack (see fill). Every document has at least its end id, so empty texts have
    one piece of length 1. Rows that repeat an id are documents of their own; rows without an id keep a null.
    Ties go to the lower hash bucket and then the smaller id and start. Other columns are ignored; an empty table
    gives an empty result.

    The driver sees the number of pieces by length only, `capacity` rows at most whatever the input; the plan that
    goes back is bounded in the same way. Pieces are numbered within their length by counts per (length, bucket),
    so a length that most pieces share is spread over all tasks, and look their window up by rank.
    """
    path = path or vocabulary_path("word_bpe_49k.json")
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    pieces = checkpointed(base.mapInArrow(lambda it: _pieces(it, path, capacity, end_id), "_id long, start long, length long, ids_crc32 long, doc_tokens long"))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    ranges = _ranges(fill(counts, capacity))
    bucket = F.pmod(F.xxhash64("_id", "start"), F.lit(_BUCKETS)).cast("int")
    ranked = numbered(pieces, "length", bucket, ["_id", "start", "ids_crc32"], "_rank")
    kinds = "_id long, start long, length long, ids_crc32 long, doc_tokens long"
    placed = ranked.select("_id", "start", "length", "ids_crc32", "doc_tokens", "_rank").mapInArrow(lambda it: _place(it, ranges), f"{kinds}, sequence_id long, offset long")
    return placed.withColumnRenamed("_id", id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
