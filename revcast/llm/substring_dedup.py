"""Exact removal of repeated passages, found at difference-cover anchors.

A window is 50 consecutive words of one text. A word goes when a window over it stands, word for
word, in a text with a smaller id too.

Anchors. With the difference cover D = {1, 5, 11, 24, 25, 27} of the integers modulo 31, any two
positions i and j have a shift d < 31 with (i + d) mod 31 and (j + d) mod 31 both in D. So when the
same 50 words start at i in one text and at j in another, both texts hash the same 20 words at an
anchor i + d, j + d (d + 20 <= 50): six of 31 positions are hashed and no match is lost.

Extension. Only windows that hold an anchor met in another text can match. Their 50-word hashes
meet in a second exchange, where the smallest id of each hash decides. Both exchanges are combined
before they travel: of each hash a flush sends the smallest and the largest id only, and what the
flush itself settles goes to the result. So a passage that a third of all texts share sends a few
rows for each flush, and no group is gathered.

Nulls and edge cases: a null or empty text has no words (kept hash: of the empty string); texts
under 50 words lose nothing; windows repeated inside one text only stay; a null id is no smaller
than any other and no other is smaller than it, so its rows stay whole; rows that repeat an id are
one text's rows (they don't remove each other's words); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revcast.llm import common as C

WIDTH = 50
#: A difference cover (six residues) of the integers modulo 31.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WIDTH - PERIOD + 1

assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))

_AT_COVER = np.zeros(PERIOD, bool)
_AT_COVER[list(COVER)] = True


def _settle(key, doc, spot):
    """Of triples in one place: order by (key, doc), and each run's start, smallest and largest doc."""
    order = np.lexsort((doc, key))
    key, doc, spot = key[order], doc[order], spot[order]
    start, length = C.runs_of(key)
    least, most = doc[start], doc[start + length - 1]
    return key, doc, spot, start, length, least, most


# ------------------------------------------------------------------ anchors
def _map_anchors(buckets: int):
    """Kind 0: the anchors still to be met (of each hash in a flush the rows of its smallest text,
    and one row of its largest); kind 1: (doc, spot) of anchors already met."""

    def flush(held):
        key, doc, spot, start, length, least, most = _settle(*map(np.concatenate, zip(*held)))
        met = np.repeat(least != most, length)
        first = doc == np.repeat(least, length)
        yield from C.pack(key[met], doc[met], spot[met], buckets, 1)
        yield from C.pack(key[first & ~met], doc[first & ~met], spot[first & ~met], buckets)
        both = start[least != most]
        for side in (least, most):  # so that other flushes learn of it
            yield from C.pack(key[both], side[least != most], np.full(len(both), -1, np.int32), buckets)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            ids = C.int_column(batch.column("doc_id"))
            for lo, _, words in C.word_chunks(batch, "text"):
                at, text = words.text_of(ANCHOR)
                spot = at - words.first[text]
                pick = _AT_COVER[spot % PERIOD] & (words.count[text] >= WIDTH)
                at, text, spot = at[pick], text[pick], spot[pick]
                held.append((words.windows(at, ANCHOR), ids[lo + text], spot))
                n += len(at)
                if n >= C.FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _settled(decide, buckets: int):
    """Packed (doc, spot), by doc, of what ``decide`` takes from each bucket."""

    def run(batches):
        held, n = [], 0
        for kinds in C.unpack(batches):
            for doc, spot in decide(kinds):
                held.append((doc, spot))
                n += len(doc)
            if n >= C.FLUSH:
                doc, spot = map(np.concatenate, zip(*held))
                yield from C.pack(C.mix(doc.astype(np.uint64)), doc, spot, buckets)
                held, n = [], 0
        if n:
            doc, spot = map(np.concatenate, zip(*held))
            yield from C.pack(C.mix(doc.astype(np.uint64)), doc, spot, buckets)

    return run


def _by_doc(batches):
    """One row for each doc, its spots as int32 bytes."""
    for kinds in C.unpack(batches):
        _, doc, spot, _ = kinds[0]
        order = np.lexsort((spot, doc))
        doc, spot = doc[order], spot[order]
        start, length = C.runs_of(doc)
        yield pa.RecordBatch.from_arrays([pa.array(doc[start]), pa.array([spot[i : i + n].tobytes() for i, n in zip(start, length)], pa.binary())], names=["doc_id", "spots"])


def _anchors_met(kinds):
    if 1 in kinds:
        yield kinds[1][1], kinds[1][2]
    if 0 in kinds:
        _, doc, spot, _, length, least, most = _settle(*kinds[0][:3])
        pick = np.repeat(least != most, length) & (spot >= 0)
        yield doc[pick], spot[pick]


# ------------------------------------------------------------------ windows
def _spots_of(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.int32)


def _map_windows(buckets: int):
    """Kind 0: (window, doc, spot) of each window's smallest text in a flush; kind 1: (doc, spot)
    of windows that a smaller text in the flush holds."""

    def flush(held):
        key, doc, spot, start, length, least, _ = _settle(*map(np.concatenate, zip(*held)))
        first = doc == np.repeat(least, length)
        yield from C.pack(key[first], doc[first], spot[first], buckets)
        yield from C.pack(key[~first], doc[~first], spot[~first], buckets, 1)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            ids, spots = C.int_column(batch.column("doc_id")), batch.column("spots").to_pylist()
            for lo, hi, words in C.word_chunks(batch, "text"):
                edge = np.zeros(len(words.starts) + 1, np.int64)  # of runs of windows over an anchor
                for x in range(lo, hi):
                    last = words.count[x - lo] - WIDTH
                    if last >= 0:
                        anchor = _spots_of(spots[x])
                        anchor = anchor[anchor <= last + PERIOD - 1].astype(np.int64)  # of another row with this id
                        base = words.first[x - lo]
                        np.add.at(edge, base + np.clip(anchor - PERIOD + 1, 0, last + 1), 1)
                        np.add.at(edge, base + np.minimum(anchor, last) + 1, -1)
                at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                text = np.searchsorted(words.first, at, "right") - 1
                held.append((words.windows(at, WIDTH), ids[lo + text], at - words.first[text]))
                n += len(at)
                if n >= C.FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _windows_gone(kinds):
    if 1 in kinds:
        yield kinds[1][1], kinds[1][2]
    if 0 in kinds:
        _, doc, spot, _, length, least, _ = _settle(*kinds[0][:3])
        pick = doc > np.repeat(least, length)
        yield doc[pick], spot[pick]


# ------------------------------------------------------------------ what is kept
def gone_words(count: int, spots: np.ndarray) -> np.ndarray:
    """Of ``count`` words, which are covered by a window at one of ``spots``."""
    edge = np.zeros(count + 1, np.int64)
    spots = spots[spots <= count - WIDTH]
    np.add.at(edge, spots, 1)
    np.add.at(edge, spots + WIDTH, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept_rows(batches):
    """doc_id, n_words, n_removed, kept (words joined by one space)."""
    for batch in batches:
        texts, spots = batch.column("text").to_pylist(), batch.column("spots").to_pylist()
        total, removed, kept = [], [], []
        for text, blob in zip(texts, spots):
            words = (text or "").encode().split()
            total.append(len(words))
            if blob:
                gone = gone_words(len(words), _spots_of(blob))
                removed.append(int(gone.sum()))
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            else:
                removed.append(0)
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                          pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "n_words", "n_removed", "kept"])


def _kept_digests(batches):
    """doc_id, n_words, n_removed, kept_sha256."""
    for rows in _kept_rows(batches):
        kept = [hashlib.sha256(k.encode()).hexdigest() for k in rows.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept_sha256"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, spots): starts, as int32 bytes, of the windows that a smaller id holds."""
    spark = docs.sparkSession
    docs = C.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    buckets = C.bucket_count(spark)

    def gather(packed: DataFrame, decide) -> DataFrame:
        decided = C.meet(packed).mapInArrow(_settled(decide, buckets), C.PACKED)
        return C.checkpointed(C.meet(decided).mapInArrow(_by_doc, "doc_id long, spots binary"))

    anchors = gather(docs.mapInArrow(_map_anchors(buckets), C.PACKED), _anchors_met)
    maybe = C.may_match(anchors, "doc_id")
    near = docs.filter(maybe(F.col("doc_id"))).join(anchors, "doc_id")
    return gather(near.mapInArrow(_map_windows(buckets), C.PACKED), _windows_gone)


def _with_spots(docs: DataFrame, *more: str) -> DataFrame:
    """Rows with the spots of their id; only rows whose id may have any are shuffled."""
    gone = repeated_windows(docs)
    maybe = C.may_match(gone, "doc_id")
    hit = F.coalesce(maybe(F.col("doc_id")), F.lit(False))
    own = F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(F.struct(own, *more).alias("row"), "text", own, hit.alias("hit"))
    spots = F.lit(None).cast("binary").alias("spots")
    return rows.filter("not hit").select("row", "text", spots).unionByName(
        rows.filter("hit").join(gone, "doc_id", "left").select("row", "text", "spots"))


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of ``docs`` (doc_id, text)."""
    rows = _with_spots(docs.select("doc_id", "text"))
    return (rows.mapInArrow(_kept_digests, "row struct<doc_id:bigint>, n_words long, n_removed long, kept_sha256 string")
            .select("row.doc_id", "n_words", "n_removed", "kept_sha256"))


def _cut_rows(batches):
    """The rows with their removed words (and the white space after each) cut out of the text."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, blob in enumerate(batch.column("spots").to_pylist()):
            if blob and texts[i]:
                data = texts[i].encode()
                words = C.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                gone = gone_words(len(words.starts), _spots_of(blob))
                ends = np.append(words.starts[1:], len(data))
                texts[i] = (data[: words.starts[0]] + b"".join(data[a:b] for a, b, g in zip(words.starts, ends, gone) if not g)).decode()
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns; the text without the removed words (n_chars follows it)."""
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = _with_spots(docs, *more)
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    out = rows.mapInArrow(_cut_rows, schema).select("row.*", "text").select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in more else out


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return removal_digests(C.table(spark, sf_dir, "documents"))


SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
gone AS (SELECT doc_id, i FROM windows JOIN (SELECT h, min(doc_id) AS m FROM windows GROUP BY 1) USING (h) WHERE doc_id > m),
covered AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM gone)),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words) t ANTI JOIN covered USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.k, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""
