"""Hard-negative mining with an STR-packed R-tree.

Rows are packed by sort-tile-recursive: Spark cuts them by label and the widest coordinate into tiles
(a range partitioning, ties cut by id, so that no label and no value makes a tile of its own size), and
a tile's task packs what it holds by the next coordinates into leaves, and leaves into boxes above
them. A box ``[lo, hi]`` bounds the inner product with an anchor q coordinate by coordinate:
``sum(min(q*lo, q*hi)) <= score <= sum(max(q*lo, q*hi))``. A queue takes boxes best first and leaves
out those outside the score window, strictly below the kth score found, or level with it with larger
ids only.

Two searches run over the same tiles, in each of which an anchor's results of all tiles meet by
anchor: positives among the tiles that hold its label, then negatives in every tile, in the score
windows its positives give. Anchors go to tiles as rows and are streamed against the tile's tree, so
a task holds one tile and one batch of anchors.

Scores are exact integers. Ties go to the smaller id, null ids last.

Nulls and edge cases: a row with a null label or vector, with a null or non-finite component, or with
one of ``2**28 / scale`` or more in size (a score could exceed a long) takes no part, nor does an empty
vector or one whose length isn't the commonest; a null id is no anchor and keeps its label, but may be
found; repeated rows are rows of their own (each anchor row is searched for, and another row with its
id may be its positive); labels without other rows, or windows without rows, give no result; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revcast.llm import common as C
from revcast.llm.vectors import commonest_length, finite_vectors, matrix

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Negative scores lie between these percentages of the positive's.
LOW, HIGH = 50, 95
#: Rows of a tile at most, about; there are as many tiles as shuffle partitions at least.
TILE = 1 << 16
#: Rows of a leaf, and boxes below a box.
LEAF, FAN = 64, 16
_BIG = np.iinfo(np.int64).max


# ------------------------------------------------------------------ the tree
def str_order(x: np.ndarray, per: int, coordinates: list[int]) -> np.ndarray:
    """Sort-tile-recursive: an order in which each run of ``per`` rows is a tile. Slabs by the first
    coordinate, each cut by the next; as many coordinates as there are cuts to make."""
    order = np.argsort(x[:, coordinates[0]], kind="stable")
    leaves = -(-len(x) // per)
    if leaves <= 1 or len(coordinates) == 1:
        return order
    slabs = max(2, round(leaves ** (1 / min(len(coordinates), max(1, leaves.bit_length() - 1)))))
    size = -(-leaves // slabs) * per
    return np.concatenate([(part := order[i : i + size])[str_order(x[part], per, coordinates[1:])] for i in range(0, len(x), size)])


class RTree:
    """The rows of one label in a tile. Level 0 has the leaves' boxes, the last level a few boxes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        wide = np.argsort(-(x.max(0) - x.min(0)), kind="stable").tolist()
        order = str_order(x, LEAF, wide)
        self.ids, self.x = ids[order], x[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lo, hi, least, per = self.x, self.x, self.ids, LEAF
        while True:
            cut = np.arange(0, len(least), per)
            lo, hi, least = np.minimum.reduceat(lo, cut, 0), np.maximum.reduceat(hi, cut, 0), np.minimum.reduceat(least, cut)
            self.levels.append((lo, hi, least))
            if len(least) <= FAN:
                return
            per = FAN

    def bounds(self, level: int, boxes: slice, up: np.ndarray, down: np.ndarray) -> tuple[list[float], list[float], list[int]]:
        """Lowest and highest score in each box, and its least id. up, down: the anchor's positive and negative parts."""
        lo, hi, least = (a[boxes] for a in self.levels[level])
        return (lo @ up + hi @ down).tolist(), (hi @ up + lo @ down).tolist(), least.tolist()


class Search:
    """The best ``k`` rows in the score window [low, high]: (-score, id, number) triples, best first."""

    __slots__ = ("low", "high", "k", "best")

    def __init__(self, low: float, high: float, k: int):
        self.low, self.high, self.k, self.best = low, high, k, []

    def wants(self, lowest: float, highest: float, least: int) -> bool:
        if highest < self.low or lowest > self.high:
            return False
        if len(self.best) < self.k:
            return True
        top, worst = min(highest, self.high), self.best[-1]
        return top > -worst[0] or top == -worst[0] and least <= worst[1]

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        least = self.low if len(self.best) < self.k else max(self.low, -self.best[-1][0])
        at = np.flatnonzero((scores >= least) & (scores <= self.high))
        if not len(at):
            return
        at = at[np.lexsort((ids[at], -scores[at]))[: self.k]]
        self.best = sorted([*self.best, *zip((-scores[at]).tolist(), ids[at].tolist())])[: self.k]


def search(trees: list[RTree], q: np.ndarray, searches: list[Search]) -> None:
    """Fills ``searches`` from all trees by one best-first queue."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    queue: list[tuple[float, int, int, int, int, float]] = []

    def push(t: int, level: int, boxes: slice) -> None:
        for i, (low, high, least) in enumerate(zip(*trees[t].bounds(level, boxes, up, down)), boxes.start):
            if any(s.wants(low, high, least) for s in searches):
                heapq.heappush(queue, (-high, least, t, level, i, low))

    for t, tree in enumerate(trees):
        push(t, len(tree.levels) - 1, slice(0, len(tree.levels[-1][2])))
    while queue:
        high, least, t, level, i, low = heapq.heappop(queue)
        asking = [s for s in searches if s.wants(low, -high, least)]
        if not asking:
            continue
        if level:
            push(t, level - 1, slice(i * FAN, min((i + 1) * FAN, len(trees[t].levels[level - 1][2]))))
        else:
            rows = slice(i * LEAF, (i + 1) * LEAF)
            scores, ids = trees[t].x[rows] @ q, trees[t].ids[rows]
            for s in asking:
                s.take(scores, ids)


# ------------------------------------------------------------------ tiles
def rows_of(table: DataFrame, id: str = "vec_id", vector: str = "embedding", label: Column | None = None, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, label, x) of the rows that take part, x = floor(scale * component), and the vectors' length."""
    picked = table.select(F.col(id).cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col(vector).alias("x"))
    picked = finite_vectors(picked.filter("label is not null"), "x", float(1 << 28) / scale)
    length = commonest_length(picked, "x")
    if not length:
        return picked.limit(0), 0
    x = F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c).cast("int"))
    return picked.filter(F.size("x") == length).select("vec_id", "label", x.alias("x")), length


def tiles_of(rows: DataFrame, length: int) -> DataFrame:
    """``rows`` with their tile: ranges of (label, widest coordinate, id), written once for both searches."""
    n, *spread = rows.agg(F.count("*"), *[F.max(F.get("x", F.lit(i))) - F.min(F.get("x", F.lit(i))) for i in range(length)]).first()
    wide = max(range(length), key=lambda i: (spread[i] or 0, -i))
    tiles = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TILE))
    dealt = rows.repartitionByRange(tiles, F.col("label"), F.get("x", F.lit(wide)), F.col("vec_id"))
    return C.checkpointed(dealt.withColumn("tile", F.spark_partition_id()))


_FOUND = "anchor_id long, anchor_label long, anchor_row long, nth int, found_id long, score long"


def _searched(tiles: DataFrame, count: int, asked: DataFrame, length: int, same_label: bool) -> DataFrame:
    """Each anchor of ``asked`` (tile, vec_id, label, x, windows, k, row) against the rows of its tile
    that have its label, or another one: (anchor, number of the window, found row) in any order."""
    held = tiles.select("tile", "vec_id", "label", "x", F.lit(None).cast("array<struct<low:double,high:double>>").alias("windows"), F.lit(0).alias("k"), F.lit(None).cast("long").alias("row"))
    met = held.unionByName(asked.select(held.columns)).repartitionById(count, F.col("tile")).sortWithinPartitions("tile", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gathered, trees = None, [], {}

        def plant():
            ids, labels, x = (np.concatenate(c) for c in zip(*gathered))
            dtype = float if length * float(np.abs(x).max()) ** 2 < 2**52 else np.int64  # both exact
            for label in np.unique(labels).tolist():
                own = labels == label
                trees[label] = RTree(ids[own], x[own].astype(dtype))
            gathered.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            tile, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "k"))
            cut = np.flatnonzero(np.concatenate(([True], (tile[1:] != tile[:-1]) | ((k[1:] > 0) != (k[:-1] > 0)))))
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(tile)]):
                part = batch.slice(i, j - i)
                if tile[i] != now:
                    now, gathered, trees = tile[i], [], {}
                ids = part.column("vec_id").fill_null(_BIG).to_numpy(zero_copy_only=False)
                labels = part.column("label").to_numpy(zero_copy_only=False)
                x = matrix(part.column("x"), length)
                if not k[i]:
                    gathered.append((ids, labels, x))
                    continue
                if gathered:
                    plant()
                yield _answers(part, ids, labels, x, trees, same_label)

    return C.small_batches(met).mapInArrow(run, _FOUND).withColumn("found_id", F.nullif("found_id", F.lit(_BIG)))


def _answers(part: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, trees: dict[int, RTree], same_label: bool) -> pa.RecordBatch:
    out: list[tuple] = []
    rows = part.column("row").to_pylist()
    for a, (id, label, windows, k) in enumerate(zip(ids.tolist(), labels.tolist(), part.column("windows").to_pylist(), part.column("k").to_pylist())):
        met = [t for other, t in trees.items() if (other == label) == same_label]
        if not met:
            continue
        searches = [Search(w["low"], w["high"], k) for w in windows]
        search(met, x[a].astype(met[0].x.dtype), searches)
        out += [(id, label, rows[a], nth, found, int(-score)) for nth, s in enumerate(searches) for score, found in s.best]
    columns = zip(*out) if out else [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["anchor_id", "anchor_label", "anchor_row", "nth", "found_id", "score"])


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of each key over all tiles, and their rank."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("found_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# ------------------------------------------------------------------ the operator
def mine(rows: DataFrame, length: int, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each row of ``rows``
    (vec_id, label, x) for which ``anchors`` holds."""
    empty = rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not length:
        return empty
    tiles = tiles_of(rows, length)
    last = tiles.agg(F.max("tile")).first()[0]
    if last is None:
        return empty
    # the anchor row itself is among its label's rows, with the score of its own square: one more is asked for
    asking = C.checkpointed(tiles.filter(anchors & F.col("vec_id").isNotNull()).select("vec_id", "label", "x", F.monotonically_increasing_id().alias("row")))
    every = F.array(F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    holding = tiles.select("tile", "label").distinct()
    first = asking.join(holding, "label").select("tile", "vec_id", "label", "x", every.alias("windows"), F.lit(positives + 1).alias("k"), "row")
    found = _first(_searched(tiles, last + 1, first, length, True), ["anchor_row"], positives + 1)
    # of the rows with the anchor's id and square, one is the anchor: it goes, or the last row where it isn't among them
    square = asking.select(F.col("row").alias("anchor_row"), F.aggregate("x", F.lit(0).cast("long"), lambda s, c: s + c.cast("long") * c).alias("square"))
    own = (F.col("found_id") == F.col("anchor_id")) & (F.col("score") == F.col("square"))
    found = found.join(square, "anchor_row").withColumn("own", F.min(F.when(own, F.col("rank"))).over(W.partitionBy("anchor_row")))
    kept = found.filter(F.col("rank") != F.coalesce("own", F.lit(positives + 1)))
    near = C.checkpointed(kept.select("anchor_row", "anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # distinct windows of an anchor, in order; integer scores between them
    score = F.col("positive_score").cast("decimal(20,0)")
    bound = near.select("anchor_row", "positive_score", F.ceil(score * low / 100).cast("double").alias("low"), F.floor(score * high / 100).cast("double").alias("high")).filter("low <= high")
    windows = bound.groupBy("anchor_row").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("windows"))
    every_tile = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("tile")
    second = asking.join(windows, asking["row"] == windows["anchor_row"]).select(every_tile, "vec_id", "label", "x", "windows", F.lit(negatives).alias("k"), "row")
    hard = _first(_searched(tiles, last + 1, second, length, False), ["anchor_row", "nth"], negatives)
    hard = hard.select("anchor_row", "nth", "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    numbered = windows.select("anchor_row", F.posexplode("windows").alias("nth", "w")).select("anchor_row", "nth", "w.low", "w.high")
    asked = near.join(bound.distinct(), ["anchor_row", "positive_score"])
    return asked.join(numbered, ["anchor_row", "low", "high"]).join(hard, ["anchor_row", "nth"]).select(empty.columns)


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    table = C.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows, length = rows_of(table, label=label)
    return mine(rows, length, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT a, b, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
), n AS (
  SELECT p.a, p.b, p.score AS positive_score, s.b AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 3
"""
