"""Token-id packing: best-fit decreasing with a segment tree, written as binary id matrices.

Each text becomes token ids and the end token. Texts over the row length are split without loss:
full rows, and a rest. The segments of a block (BLOCK tokens of consecutive texts in a task) are
placed by decreasing length, each into the open row with the least room that holds it; a segment
tree over the room left (its leaves say whether an open row has just so much) finds that row in
logarithmic time. Blocks bound a task's memory whatever its partition, and nothing is shuffled, so
neither hot sources nor copies matter; a block of about a thousand rows or more packs nearly full.

A row of the result is one row of the id matrix:

* ids: `row_length` little-endian ids (unsigned, 16 bits where the vocabulary fits them, else 32),
  padded with the end token; n_tokens of them count;
* cu_seqlens: cumulative segment lengths, 0 first, n_tokens last;
* position_resets: where the position counter restarts, that is each segment's start;
* doc_ids, parts: of each segment the text, and its first token's place in that text.

`unpack_ids` gives each text's ids back. Rows are named by their first segment (doc_id, part),
which no other row holds.

Nulls and edge cases: a null or empty text is its end token alone, so every text is in the result;
special strings in a text are ordinary text; a null id is packed as a null id; repeated rows are
packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.llm import common as C

ROW_LENGTH = 2048
#: Tokens gathered before they are packed.
BLOCK = 4_000_000


class RoomTree:
    """Open rows by the room left in them; `fit` finds the least room that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _mark(self, room: int, value: bool) -> None:
        node = self.leaves + room
        while node and self.any[node] != value:
            self.any[node] = value
            if not value and self.any[node ^ 1]:
                break
            node >>= 1

    def add(self, room: int, row: int) -> None:
        if not self.rows[room]:
            self._mark(room, True)
        self.rows[room].append(row)

    def fit(self, need: int) -> int | None:
        """Takes out a row of the least room >= need; None if there is none."""
        node = self.leaves + need
        while not self.any[node]:
            while node & 1:  # a right child: go up until there is something to the right
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:  # past the last leaf of this level
                return None
        while node < self.leaves:
            node <<= 1
            if not self.any[node]:
                node += 1
        room = node - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self._mark(room, False)
        return room, row


def pack_segments(lengths: np.ndarray, row_length: int) -> list[list[int]]:
    """Best-fit decreasing: the segments (numbers into ``lengths``) of each row."""
    tree, rows = RoomTree(row_length), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = tree.fit(length) if length < row_length else None
        if found is None:
            room, row = row_length, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        if room > length:
            tree.add(room - length, row)
    return rows


def split_text(n_tokens: int, row_length: int) -> list[tuple[int, int]]:
    """(start, length) of a text's segments: full rows and the rest."""
    return [(at, min(row_length, n_tokens - at)) for at in range(0, n_tokens, row_length)]


class Block:
    """Texts' ids, gathered and packed."""

    def __init__(self, row_length: int, end: int, width: str):
        self.row_length, self.end, self.width = row_length, end, width
        self.clear()

    def clear(self) -> None:
        self.tokens, self.texts = 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.texts.append((doc_id, np.append(ids, self.end).astype(self.width)))
        self.tokens += len(ids) + 1

    def rows(self) -> Iterator[pa.RecordBatch]:
        segments = [(t, at, n) for t, (_, ids) in enumerate(self.texts) for at, n in split_text(len(ids), self.row_length)]
        packed = pack_segments(np.array([n for _, _, n in segments], np.int64), self.row_length)
        for lo in range(0, len(packed), 512):
            yield self._batch([[segments[i] for i in row] for row in packed[lo : lo + 512]])

    def _batch(self, rows) -> pa.RecordBatch:
        matrix = np.full((len(rows), self.row_length), self.end, self.width)
        ends = []
        for line, row in zip(matrix, rows):
            cut = np.cumsum([0, *(n for _, _, n in row)])
            for (t, at, n), to in zip(row, cut):
                line[to : to + n] = self.texts[t][1][at : at + n]
            ends.append(cut)
        doc_ids = [[self.texts[t][0] for t, _, _ in row] for row in rows]
        parts = [[at for _, at, _ in row] for row in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in doc_ids], pa.int64()), pa.array([p[0] for p in parts], pa.int32()), pa.array([len(r) for r in rows], pa.int32()),
             pa.array([int(c[-1]) for c in ends], pa.int32()), pa.array(doc_ids, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32())),
             pa.array([c.tolist() for c in ends], pa.list_(pa.int32())), pa.array([c[:-1].tolist() for c in ends], pa.list_(pa.int32())),
             pa.array([line.tobytes() for line in matrix], pa.binary())],
            names=["doc_id", "part", "n_segments", "n_tokens", "doc_ids", "parts", "cu_seqlens", "position_resets", "ids"])


SCHEMA = ("doc_id long, part int, n_segments int, n_tokens int, doc_ids array<long>, parts array<int>, "
          "cu_seqlens array<int>, position_resets array<int>, ids binary")


# ------------------------------------------------------------------ ids
def byte_bpe(lines: bytes) -> tuple[Callable[[str], np.ndarray], int]:
    """Encoder of a rank file (base64 token, id) and the first free id, which ends a text."""
    key = hash(lines)
    if key not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        encoding = tiktoken.Encoding(f"ranks-{len(ranks)}", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _ENCODERS[key] = (lambda text: np.asarray(encoding.encode_ordinary(text), np.uint32), len(ranks))
    return _ENCODERS[key]


_ENCODERS: dict[int, tuple] = {}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pack(docs: DataFrame, row_length: int = ROW_LENGTH, ranks: str | None = None, block: int = BLOCK) -> DataFrame:
    """The packed rows of ``docs`` (doc_id, text). ``ranks``: path of the vocabulary, read by the driver."""
    if not 1 <= row_length < 1 << 31:
        raise ValueError("row_length must be positive")
    with open(ranks or default_ranks(), "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encode, end = byte_bpe(lines.value)
        held = Block(row_length, end, "<u2" if end < 1 << 16 else "<u4")
        for batch in batches:
            for i in range(batch.num_rows):
                held.add(batch.column("doc_id")[i].as_py(), encode(batch.column("text")[i].as_py() or ""))
                if held.tokens >= block:
                    yield from held.rows()
                    held.clear()
        if held.texts:
            yield from held.rows()

    return C.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def unpack_ids(packed: DataFrame, row_length: int = ROW_LENGTH) -> DataFrame:
    """doc_id, ids array<int> (the end token last) of each text, from the packed rows. Texts with a
    null id, or with an id that stands in several rows, can't be told apart and are left out."""

    def run(batches):
        for batch in batches:
            docs, parts, ids = [], [], []
            for r in batch.to_pylist():
                line = np.frombuffer(r["ids"], f"<u{len(r['ids']) // row_length}")
                for d, p, a, b in zip(r["doc_ids"], r["parts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
                    docs.append(d)
                    parts.append(p)
                    ids.append(line[a:b].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(parts, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "part", "ids"])

    pieces = packed.select("doc_ids", "parts", "cu_seqlens", "ids").mapInArrow(run, "doc_id long, part int, ids array<int>").filter("doc_id is not null")
    whole = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("p"))
    whole = whole.filter(F.size(F.array_distinct(F.transform("p", lambda x: x["part"]))) == F.size("p"))
    return whole.select("doc_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet: the id matrix's rows as fixed-size binaries, with their segments."""
    packed.write.mode("overwrite").parquet(path)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
