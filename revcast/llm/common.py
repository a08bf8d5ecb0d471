"""Shared pieces of the text operators.

* Arrow text batches as flat byte arrays, words and word hashes found with
  vectorised numpy passes (no Python loop over words);
* a packed exchange: (key, doc, position) triples travel as byte blobs, one row
  for each bucket and flush, and meet in their bucket;
* a fixed-size bit filter that spares a shuffle of rows which cannot match;
* ``checkpointed``: lineage cut in the shared folder of ``spark.checkpoint.dir``; ``consumed`` and
  ``release`` delete what has been read.

Hash values only depend on the text, never on the process or the machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revcast.session import delete_folder, ensure_checkpoint_dir

#: Bytes of text that a numpy pass handles at once (a longer text is one pass).
CHUNK_BYTES = 1 << 19
#: At most so many texts in a pass, so that a text's number fits 16 bits.
CHUNK_TEXTS = 60_000

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: Byte classes: a word is a maximal run of True.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
ALNUM_ANY_CASE = ALNUM.copy()
ALNUM_ANY_CASE[0x41:0x5B] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Folders of the checkpoints made within the innermost ``consumed()`` of this thread or task.
_MADE: ContextVar[list[str] | None] = ContextVar("checkpoints", default=None)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; later reads survive a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    made = _MADE.get()
    if made is not None:
        made.append(checkpoint_folder(out))
    return out


def checkpoint_folder(df: DataFrame) -> str:
    """Where a DataFrame that ``checkpointed`` gave has its rows."""
    return df._jdf.queryExecution().logical().rdd().getCheckpointFile().get()  # noqa: SLF001 - no Python wrapper


def release(df: DataFrame) -> None:
    """Deletes the rows of a DataFrame that ``checkpointed`` gave and nothing reads any more."""
    delete_folder(df.sparkSession, checkpoint_folder(df))


@contextmanager
def consumed(spark: SparkSession) -> Iterator[None]:
    """Checkpoints made within are deleted at the end: for a result that is written within. Without it
    they stay until the application's folder is cleaned up, as a lazy result may read them at any time."""
    token = _MADE.set([])
    try:
        yield
    finally:
        made = _MADE.get()
        _MADE.reset(token)
        for folder in made:
            delete_folder(spark, folder)


#: Bytes of an Arrow batch between the JVM and Python; a task holds a few of them.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session's Arrow batches have at most BATCH_BYTES (or what the user set, if less), as
    texts and blobs are wide rows."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH).removesuffix("b").isdigit() and not 0 < int(conf.get(_BATCH).removesuffix("b")) <= BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system: workers live on between tasks and share a machine with the heap."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Ids that stand for texts without one lie above this.
NO_ID = 1 << 62


def id_or_text(doc_id: Column, text: Column) -> Column:
    """The id, or for a row without one a number of its text, above NO_ID and so behind all usual ids."""
    return F.coalesce(doc_id.cast("long"), F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 2) + F.lit(NO_ID))


# ------------------------------------------------------------------ hashing
def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit (uint64 in, uint64 out)."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


_BYTE_VALUE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
_LOWER_VALUE = _BYTE_VALUE[_LOWER]

_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse (mod 2**64); kept for the process, grown by doubling."""
    have = len(_POW[0])
    if n >= have:
        size = max(1 << 16, 1 << int(n).bit_length())
        for i, b in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size + 1, b, np.uint64)
            steps[0] = 1
            _POW[i] = np.cumprod(steps, dtype=np.uint64)
    return _POW[0], _POW[1]


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each range; equal content gives equal hashes wherever it stands."""
    pow_, inv = powers(len(values))
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * pow_[: len(values)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts])


# ------------------------------------------------------------------ text batches
def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def int_column(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES; whole texts only."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + CHUNK_TEXTS)
        yield lo, hi
        lo = hi


class Words:
    """The words of a run of texts.

    ``starts``/``ends``: byte range of each word; ``first``: number of the first word of each
    text (and the total); ``hash``: a 64-bit hash of each word's bytes (A-Z lowered if asked).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE, lower: bool = False):
        inside = kind[data]
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        full = offsets[:-1] < offsets[1:]
        before[offsets[:-1][full]] = False
        after[offsets[1:][full] - 1] = False
        self.data, self.offsets, self.lower = data, offsets, lower
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.count = np.diff(self.first)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = range_hash((_LOWER_VALUE if self.lower else _BYTE_VALUE)[self.data], self.starts, self.ends)
        return self._hash

    def text_of(self, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word numbers) of all runs of ``width`` words inside one text, and their texts' numbers."""
        runs = np.maximum(self.count - width + 1, 0)
        text = np.repeat(np.arange(len(runs)), runs)
        at = np.arange(len(text)) + np.repeat(self.first[:-1] - (np.cumsum(runs) - runs), runs)
        return at, text

    def windows(self, at: np.ndarray, width: int) -> np.ndarray:
        """Hash of the ``width`` words from each word number in ``at``."""
        return range_hash(self.hash, at, at + width)


def word_chunks(batch: pa.RecordBatch, text: str, kind: np.ndarray = NOT_SPACE, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    data, offsets = text_bytes(batch.column(text))
    for lo, hi in chunks(offsets):
        yield lo, hi, Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], kind, lower)
    give_back()


def by_text_and_value(value: np.ndarray, text: np.ndarray) -> np.ndarray:
    """An order by (text, value); ``text`` is below 2**16."""
    order = np.argsort(value)
    return order[np.argsort(text[order].astype(np.uint16), kind="stable")]


# ------------------------------------------------------------------ packed exchange
#: Triples gathered before they are packed, and about how many of a bucket are handled at once.
FLUSH = 500_000
PACKED = "bucket int, kind int, keys binary, docs binary, spots binary, more binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("spots", pa.binary()), ("more", pa.binary())])


def bucket_count(spark: SparkSession) -> int:
    """A bucket for each shuffle partition."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 16)


def pack(keys: np.ndarray, docs: np.ndarray, spots: np.ndarray, buckets: int, kind: int = 0, more: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(key, doc, spot) and, if given, one more number as rows of bytes, one row for each bucket that has any."""
    if not len(keys):
        return
    bucket = ((keys >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order], prepend=np.int32(-1)))
    ends = np.append(edge[1:], len(keys))
    found = pa.array(bucket[order][edge].astype(np.int32))
    blobs = []
    for column, kind_of in ((keys, np.uint64), (docs, np.int64), (spots, np.int32), (more, np.int64)):
        if column is None:
            blobs.append(pa.array([b""] * len(edge), pa.binary()))
        else:
            column = column[order].astype(kind_of)
            blobs.append(pa.array([column[i:j].tobytes() for i, j in zip(edge, ends)], pa.binary()))
    yield pa.RecordBatch.from_arrays([found, pa.array(np.full(len(edge), kind, np.int32)), *blobs], schema=_PACKED)


def _blobs(column: pa.Array, kind_of: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of byte blobs (a view), and where each row's begin."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    size = np.dtype(kind_of).itemsize
    count = (offsets[-1] - offsets[0]) // size
    values = np.frombuffer(data, kind_of, count, offsets[0]) if count else np.zeros(0, kind_of)
    return values, (offsets - offsets[0]) // size


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, tuple[np.ndarray, ...]]]:
    """Of rows sorted by bucket (best by kind too), each bucket's columns (keys, docs, spots, more) by
    kind, in parts of about FLUSH triples; equal keys are in one part. Nothing is copied but a part."""
    now, held = None, {}

    def parts():
        whole = {k: tuple(np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*held[k])) for k in held}
        held.clear()
        n = sum(len(columns[0]) for columns in whole.values()) // FLUSH + 1
        if n == 1:
            yield whole
            return
        part_of = {k: ((columns[0] >> np.uint64(16)) % np.uint64(n)).astype(np.uint16) for k, columns in whole.items()}
        for i in range(n):
            picks = {k: np.flatnonzero(part == i) for k, part in part_of.items()}
            yield {k: tuple(c[picks[k]] if len(c) else c for c in columns) for k, columns in whole.items() if len(picks[k])}

    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "kind"))
        blobs = [_blobs(batch.column(c).cast(pa.binary()), t) for c, t in zip(("keys", "docs", "spots", "more"), (np.uint64, np.int64, np.int32, np.int64))]
        first = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1]))))
        for i, j in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows]):
            if bucket[i] != now and held:
                yield from parts()
            now = bucket[i]
            held.setdefault(int(kind[i]), []).append(tuple(values[at[i] : at[j]] for values, at in blobs))
    if held:
        yield from parts()
    give_back()


def meet(packed: DataFrame) -> DataFrame:
    """Rows of a bucket together, in one task and one after the other."""
    return packed.repartitionById(bucket_count(packed.sparkSession), F.col("bucket")).sortWithinPartitions("bucket", "kind")


def runs_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    start = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(sorted_keys)))


# ------------------------------------------------------------------ bit filter
#: Words of 64 bits in the filter: 128 KB, whatever the input.
FILTER_WORDS = 1 << 14


def may_match(keys: DataFrame, key: str) -> "MayMatch":
    """A one-hash bit filter over ``keys[key]`` of fixed size (FILTER_WORDS longs reach the driver).

    It only spares shuffling: a row that it lets through is still joined exactly, and when
    it is full it lets all through.
    """
    h = F.pmod(F.xxhash64(key), F.lit(FILTER_WORDS * 64))
    rows = keys.select(h.alias("h")).groupBy((F.col("h") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(h % 64))")).alias("b")).collect()
    bits = [0] * FILTER_WORDS
    for r in rows:
        bits[r["w"]] = r["b"]
    return MayMatch(bits)


class MayMatch:
    def __init__(self, bits: list[int]):
        self._text = ",".join(map(str, bits))

    def __call__(self, key: Column) -> Column:
        h = F.pmod(F.xxhash64(key), F.lit(FILTER_WORDS * 64))
        words = F.split(F.lit(self._text), ",").cast("array<bigint>")
        word = F.get(words, (h / 64).cast("int"))
        return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (h % 64).cast("int"))) != 0
