"""Packing by minimum bin slack.

A document's ids (with the end id) are cut into full windows and a rest; the rests and the short
documents wait as a multiset of lengths. For each window the longest of them is taken, and a
subset-sum table over the others (one bit for each sum, lengths falling, the count of each length in
binary parts) says how close to the capacity their sums come; the sum next to it is backtracked to
counts by length. Lengths are tried until the capacity itself is reached, mostly after a few dozen.
Slack that no subset fills is filled with the front of the longest document left.

A task packs its own documents as they come and keeps a remainder for the ones to come (choice makes
windows fill), so nothing is shuffled and neither hot sources nor copies matter. What is left at the
task's end fills windows of falling powers of two, by the same table, as those need no padding: no
sequence is padded, and a task has less than one short sequence for each power below the capacity.

Ids are those of the tokenizers library for a vocabulary of word pieces (see ``bpe.py``, whose encoder
is used): texts are cut at white space; pieces of plain words (letters of Latin-1, digits, signs) are
found in flat byte arrays and known by their hash, and each distinct piece is encoded once.

A row of the result is one sequence: sequence_id, n_tokens, ids (little-endian, unsigned, 32 bits) and
its pieces (doc_id, start: the document's ids before the piece, length, offset in the sequence,
doc_tokens). ``sequence_id`` is the task's partition number and the sequence's in it, so that a task
that is run again gives the same rows.

Nulls and edge cases: a null or empty text is its end id alone, so every document is in the result; a
null id is kept; repeated rows are packed each; special strings in a text give their ids; a document
longer than the capacity takes as many windows as it fills; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.llm import bpe
from revcast.llm import common as C

CAPACITY, END = 4096, 2
#: Windows' worth of tokens that a task keeps to choose from while documents come.
KEPT = 128
#: Windows' worth of tokens gathered before packing.
GATHERED = 512


# ------------------------------------------------------------------ minimum bin slack
class Waiting:
    """A multiset of lengths below the capacity, each with what has that length."""

    def __init__(self):
        self.of: dict[int, list] = {}
        self.lengths: list[int] = []
        self.total = 0

    def add(self, length: int, item) -> None:
        if length not in self.of:
            self.of[length] = []
            insort(self.lengths, length)
        self.of[length].append(item)
        self.total += length

    def take(self, length: int):
        items = self.of[length]
        item = items.pop()
        if not items:
            del self.of[length]
            del self.lengths[bisect_right(self.lengths, length) - 1]
        self.total -= length
        return item


def closest(waiting: Waiting, capacity: int) -> dict[int, int]:
    """{length: count}: lengths that sum up to the capacity, or as close below it as any do together with
    the longest that fits."""
    fits = bisect_right(waiting.lengths, capacity)
    if not fits:
        return {}
    seed = waiting.lengths[fits - 1]
    reach, mask, full = 1 << seed, (1 << capacity + 1) - 1, 1 << capacity
    steps: list[tuple[int, int, int]] = []  # (sums before, length, how many of it)
    for i in range(fits - 1, -1, -1):
        if reach & full:
            break
        length = waiting.lengths[i]
        left = min(len(waiting.of[length]) - (i == fits - 1), (capacity - seed) // length)
        part = 1
        while left > 0 and not reach & full:
            many = min(part, left)
            steps.append((reach, length, many))
            reach |= reach << length * many & mask
            left -= many
            part *= 2
    at, counts = reach.bit_length() - 1, {seed: 1}
    for before, length, many in reversed(steps):
        if not before >> at & 1:
            counts[length] = counts.get(length, 0) + many
            at -= length * many
    return counts


def window(waiting: Waiting, capacity: int) -> list[tuple[object, int, int]]:
    """(item, start in it, length) that fill the capacity; there must be as much. A cut item's rest goes back."""
    filled, room = [], capacity
    for length, count in closest(waiting, capacity).items():
        for _ in range(count):
            item, start = waiting.take(length)
            filled.append((item, start, length))
            room -= length
    while room:
        length = waiting.lengths[-1]
        item, start = waiting.take(length)
        cut = min(room, length)
        filled.append((item, start, cut))
        room -= cut
        if cut < length:
            waiting.add(length - cut, (item, start + cut))
    return filled


def windows(waiting: Waiting, capacity: int, keep: int) -> Iterator[list[tuple[object, int, int]]]:
    """Full windows until at most ``keep`` tokens wait; with keep 0 also windows of falling powers of two."""
    while waiting.total >= max(capacity, keep + 1):
        yield window(waiting, capacity)
    while not keep and waiting.total:
        yield window(waiting, 1 << waiting.total.bit_length() - 1)


# ------------------------------------------------------------------ the operator
SCHEMA = "sequence_id long, n_tokens int, ids binary, pieces array<struct<doc_id:long,start:long,length:long,offset:long,doc_tokens:long>>"
_PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64()), ("doc_tokens", pa.int64())])


def _sequences(packed: list[list[tuple]], first: int) -> pa.RecordBatch:
    """Sequences of (document, start, length); a document is (doc_id, ids)."""
    flat = [(doc[0], start, length, len(doc[1])) for row in packed for doc, start, length in row]
    bounds = np.concatenate(([0], np.cumsum([len(row) for row in packed])))
    size = np.array([p[2] for p in flat], np.int64)
    before = np.concatenate(([0], np.cumsum(size)))
    offset = before[:-1] - np.repeat(before[bounds[:-1]], np.diff(bounds))
    column = lambda i: pa.array([p[i] for p in flat], pa.int64())
    pieces = pa.StructArray.from_arrays([column(0), column(1), pa.array(size), pa.array(offset), column(3)], fields=list(_PIECE))
    ids = [b"".join([doc[1][start : start + length].tobytes() for doc, start, length in row]) for row in packed]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(first, first + len(packed))), pa.array(np.diff(before[bounds]).astype(np.int32)), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pieces)],
        names=["sequence_id", "n_tokens", "ids", "pieces"])


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """The sequences of ``docs`` (doc_id, text). ``vocabulary``: path of the tokenizer's file, read by the driver."""
    if not 1 <= capacity < 1 << 31:
        raise ValueError("capacity must be positive")
    spec = docs.sparkSession.sparkContext.broadcast(bpe.vocabulary_text(vocabulary or bpe.default_vocabulary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, waiting, ready = bpe.piece_ids_of(spec.value), Waiting(), []
        number = TaskContext.get().partitionId() << 32

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            while len(ready) > least:
                part, ready[:256] = ready[:256], []
                yield _sequences(part, number)
                number += len(part)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            data, offsets = C.text_bytes(batch.column("text"))
            for lo, hi in C.chunks(offsets):
                ids, bounds = encode.of_texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], end)
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), lo):
                    doc = (doc_ids[i], ids[a:b])
                    whole = (b - a) // capacity * capacity
                    ready.extend([(doc, at, capacity)] for at in range(0, whole, capacity))
                    if b - a > whole:
                        waiting.add(b - a - whole, (doc, whole))
                if waiting.total >= GATHERED * capacity:
                    ready.extend(windows(waiting, capacity, KEPT * capacity))
                yield from flush(255)
        ready.extend(windows(waiting, capacity, 0))
        yield from flush(0)

    return C.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def pieces_of(sequences: DataFrame) -> DataFrame:
    """A row for each piece, with the checksum of its ids."""
    each = sequences.select("sequence_id", "ids", F.explode("pieces").alias("p")).select("sequence_id", "ids", "p.*")
    crc = F.crc32(F.substring("ids", (4 * F.col("offset") + 1).cast("int"), (4 * F.col("length")).cast("int")))
    return each.select("doc_id", "start", "length", crc.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_slack_packing(spark, sf_dir: str) -> DataFrame:
    return pieces_of(pack(C.table(spark, sf_dir, "documents")))
