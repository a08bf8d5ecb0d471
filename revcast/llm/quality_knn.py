"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

A text's terms are its pairs of neighbouring byte classes (48 classes: 2,304 terms) and a few shape
terms (shares of capitals, symbols, digits, repeated words and lines, ... in steps). Their weights
(square root of the frequency, times the inverse document frequency) are projected on the leading
singular directions of the reference texts. Each text is then compared with all reference vectors
by blocked matrix products (exact cosines), and its neighbours' labels are weighted by similarity.

Fit: a bounded sample, SAMPLE labelled rows at most, those with the smallest hash of the id among
the rows whose crc32(id as text) mod 5 is not 0. So the broadcast model (SAMPLE x RANK vectors and
the projection) has a fixed size. Labels, language, source and id are no inputs of a score.

Nulls and edge cases: a null or empty text has no terms and scores the share of label 1 among the
reference rows; a null label is no label, and an id with several labels counts as their mean,
rounded; without any labelled row each score is 0.5; a null id is never held out (held_out false);
repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revcast.llm import common as C

SAMPLE = 4096
RANK = 64
NEIGHBOURS = 15
#: A similarity counts with this power.
SHARPNESS = 8
KEEP_FROM = 0.3
#: Reference vectors compared at once with the texts of a pass.
BLOCK = 1024
#: Parts into which rows are dealt by crc32(id); those of part 0 are held out.
PARTS = 5


def _byte_classes() -> tuple[np.ndarray, int]:
    """Class of each byte: a letter in either case is one class each way, bytes of other kinds share some."""
    cls = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        if "a" <= c <= "z":
            cls[b] = 1 + b - ord("a")
        elif "A" <= c <= "Z":
            cls[b] = 27
        elif c.isdigit() and b < 128:
            cls[b] = 28
        elif b in (0x20, 0x09):
            cls[b] = 29
        elif b in (0x0A, 0x0D):
            cls[b] = 30
        elif c in "#*$%&|<>":
            cls[b] = 31 + "#*$%&|<>".index(c)
        elif c in ".,":
            cls[b] = 39
        elif c in "!?":
            cls[b] = 40
        elif b < 128:
            cls[b] = 41
        else:
            cls[b] = 42 + b % 6
    return cls, 48


CLASS, CLASSES = _byte_classes()
STEPS = 8
SHAPES = 10
TERMS = CLASSES * CLASSES + STEPS * SHAPES
#: A shape term counts as much as so large a share of all pairs.
SHAPE_WEIGHT = 0.15


def term_weights(words: C.Words) -> np.ndarray:
    """Square roots of the term frequencies, one row for each text (zero for an empty one)."""
    data, offsets = words.data, words.offsets
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, TERMS), np.float32)
    if not len(data):
        return out
    text = np.repeat(np.arange(n), size)
    cls = CLASS[data]
    inside = text[1:] == text[:-1]
    pairs = CLASSES * CLASSES
    counts = np.bincount((text[1:] * pairs + cls[:-1] * CLASSES + cls[1:])[inside], minlength=n * pairs).reshape(n, pairs)
    out[:, :pairs] = counts / np.maximum(size - 1, 1)[:, None]
    share = lambda mask: np.bincount(text[mask], minlength=n) / np.maximum(size, 1)
    total = np.maximum(words.count, 1)
    at, owner = words.text_of()
    order = C.by_text_and_value(words.hash, owner)
    same = (words.hash[order][1:] == words.hash[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again = np.bincount(owner[order][1:][same], minlength=n) / total
    twice = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1]))
    stutter = np.bincount(owner[twice], minlength=n) / total
    lines = C.Words(data, offsets, data_lines())
    line_at, line_owner = lines.text_of()
    order = C.by_text_and_value(lines.hash, line_owner)
    same = (lines.hash[order][1:] == lines.hash[order][:-1]) & (line_owner[order][1:] == line_owner[order][:-1])
    line_again = np.bincount(line_owner[order][1:][same], minlength=n) / np.maximum(lines.count, 1)
    top = counts.max(1) / np.maximum(size - 1, 1)
    length = words.ends - words.starts
    shapes = [share(cls == 27), share((cls >= 31) & (cls < 39)), share(cls == 28), share(cls == 40), again, stutter, line_again, 4 * top,
              np.bincount(owner, length, minlength=n) / total / 16, np.log2(1 + words.count) / 16]
    for i, x in enumerate(shapes):
        # between two steps, both count in part
        x = np.clip(np.sqrt(x), 0, 1) * (STEPS - 1)
        low = np.minimum(x.astype(np.int64), STEPS - 2)
        rows, base = np.arange(n), pairs + i * STEPS
        out[rows, base + low] += SHAPE_WEIGHT * (low + 1 - x)
        out[rows, base + low + 1] += SHAPE_WEIGHT * (x - low)
    out[size == 0] = 0
    return np.sqrt(out)


def data_lines() -> np.ndarray:
    kind = np.ones(256, bool)
    kind[0x0A] = False
    return kind


@dataclass
class Model:
    """idf (terms), basis (terms x rank), vectors (references x rank, of length 1), labels, prior."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, weights: np.ndarray) -> np.ndarray:
        vectors = (weights * self.idf) @ self.basis
        return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)

    def score(self, weights: np.ndarray) -> np.ndarray:
        """Similarity-weighted mean label of each text's nearest references."""
        n, k = len(weights), min(NEIGHBOURS, len(self.labels))
        vectors = self.project(weights)
        best, label = np.full((n, 0), 0, np.float32), np.zeros((n, 0), np.float32)
        for lo in range(0, len(self.labels), BLOCK):
            near = vectors @ self.vectors[lo : lo + BLOCK].T
            best = np.hstack([best, near])
            label = np.hstack([label, np.broadcast_to(self.labels[lo : lo + BLOCK], near.shape)])
            if best.shape[1] > k:
                top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                best, label = np.take_along_axis(best, top, 1), np.take_along_axis(label, top, 1)
        weight = np.maximum(best, 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(1)
        empty = ~weights.any(1) | (total <= 0)
        return np.where(empty, self.prior, (weight * label).sum(1) / np.where(total > 0, total, 1))


def fit(weights: np.ndarray, labels: np.ndarray) -> Model:
    """The latent-semantic model of the reference texts (a randomised singular value decomposition)."""
    if not len(labels):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    idf = np.log((1 + len(labels)) / (1 + (weights > 0).sum(0))).astype(np.float32) + 1
    x = weights * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rank = min(RANK, *x.shape)
    q = np.linalg.qr(x.T @ (x @ np.random.default_rng(7).standard_normal((TERMS, min(rank + 16, TERMS))).astype(np.float32)))[0]
    for _ in range(3):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    model = Model(idf, (q @ v.T)[:, :rank].astype(np.float32), np.zeros((0, rank), np.float32), labels.astype(np.float32), float(labels.mean()))
    model.vectors = model.project(weights)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(PARTS)) == 0, F.lit(False))


def _sparse_weights(batches):
    """label and the non-zero term weights of the reference texts."""
    for batch in batches:
        labels = C.int_column(batch.column("label"))
        for lo, hi, words in C.word_chunks(batch, "text"):
            rows = term_weights(words)
            at = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(labels[lo:hi]), pa.array([a.astype(np.int32).tobytes() for a in at], pa.binary()),
                                              pa.array([r[a].tobytes() for r, a in zip(rows, at)], pa.binary())], names=["label", "at", "weight"])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Model:
    """The model of the bounded sample of labelled rows; rows that are held out are never among them."""
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).alias("label")).filter("doc_id is not null and label is not null")
              .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.round(F.avg("label")).cast("long").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = texts.dropDuplicates(["doc_id"]).select("label", "text").mapInArrow(_sparse_weights, "label long, at binary, weight binary").collect()
    weights = np.zeros((len(rows), TERMS), np.float32)
    for x, r in zip(weights, rows):
        x[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["weight"], np.float32)
    order = np.lexsort(weights[:, ::97].T) if len(rows) else np.zeros(0, np.int64)  # whichever order the rows came in
    return fit(weights[order], np.array([r["label"] for r in rows], np.float32)[order])


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` (its columns, text among them) with the score as column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for lo, hi, words in C.word_chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), pa.array(np.clip(model.score(term_weights(words)), 0, 1).astype(np.float64))], names=["row", "score"])

    rows = C.small_batches(docs).select(F.struct("*").alias("row"), "text")
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])).select("row.*", F.col("score").alias(name))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scored(docs, train(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def op9_quality_knn(spark, sf_dir: str) -> DataFrame:
    return classify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
