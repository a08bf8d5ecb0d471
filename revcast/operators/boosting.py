"""Gradient-boosted quantile regression (M4, M3, M7-M8): one model for each granularity and quantile.

Each round fits a Spark ML decision tree to the negative gradient of the pinball loss (``q`` above the
prediction so far, ``q - 1`` below), re-estimates the value of every leaf as the quantile ``q`` of the
residuals that fall into it, and adds that, times the learning rate, to the prediction.  The first
80 % of the rows in time order train; the pinball loss on the rest is watched, training ends after
``patience`` rounds without a better one, and the rounds after the best are dropped.

A fitted model is a table of tree nodes (round, node, feature, threshold, children, value); round 0 is
the starting quantile.  The table is what is stored, its inner nodes are the split counts, and scoring
walks it with built-in array functions (rounds x depth steps a row, no Python, no shuffle).

Lineage: every round's predictions are cached; every ``LAND_EVERY`` rounds they are written to the
shared folder, so that a lost executor repeats a few rounds at most.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revcast import constants as K
from revcast.operators.metrics import pinball
from revcast.operators.splits import chrono_index, holdout_assign

QUANTILE_ACCURACY = 10_000
LAND_EVERY = 10
NODES = ("granularity string, quantile double, round int, node int, feature string, threshold double, "
         "left int, right int, value double")


@dataclass(frozen=True)
class BoostingParams:
    """``rounds`` at most; ``subsample``: share of the training rows that a round's tree sees."""

    rounds: int = 60
    rate: float = 0.3
    depth: int = 5
    leaf_rows: int = 20
    patience: int = 8
    subsample: float = 0.8
    bins: int = 32
    seed: int = 42


# ------------------------------------------------------------------ trees
_LINE = re.compile(r"( *)(?:(If|Else) \(feature (\d+) (?:<=|>) (\S+?)\)|Predict: \S+)")


@dataclass(frozen=True)
class Node:
    """An inner node (feature number, threshold, children's numbers) or a leaf (value)."""

    feature: int | None = None
    threshold: float | None = None
    left: int | None = None
    right: int | None = None
    value: float | None = None


def tree_nodes(description: str, values: list[float]) -> list[Node]:
    """The nodes of a tree in the order of its printed description, children by number; the k-th leaf has ``values[k]``."""
    lines = [m for m in map(_LINE.fullmatch, description.splitlines()) if m]
    nodes: list[Node] = []
    leaves = iter(values)
    at = 0

    def read() -> int:
        nonlocal at
        line, number = lines[at], len(nodes)
        at += 1
        nodes.append(Node())
        if line[2] is None:
            nodes[number] = Node(value=next(leaves))
            return number
        left = read()
        at += 1  # the matching Else
        nodes[number] = Node(int(line[3]), float(line[4]), left, read())
        return number

    read()
    return nodes


@dataclass
class BoostedModel:
    """Trees of one (granularity, quantile) model by round; round 0 is a single leaf."""

    granularity: str
    quantile: float
    features: list[str]
    trees: list[list[Node]]

    def prediction(self, x: Column) -> Column:
        """Sum of the leaf values that the features (array<double>) reach."""
        depth = max(map(_depth, self.trees))
        table = json.dumps([[{"f": n.feature, "t": n.threshold, "l": n.left, "r": n.right, "v": n.value} for n in t] for t in self.trees])
        trees = F.from_json(F.lit(table), "array<array<struct<f:int,t:double,l:int,r:int,v:double>>>")

        def leaf(tree: Column) -> Column:
            def step(at: Column, _: Column) -> Column:
                node = F.get(tree, at)
                return F.when(node["f"].isNull(), at).when(F.get(x, node["f"]) <= node["t"], node["l"]).otherwise(node["r"])

            return F.get(tree, F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step) if depth else F.lit(0))["v"]

        return F.aggregate(trees, F.lit(0.0), lambda total, tree: total + leaf(tree))

    def rows(self) -> list[tuple]:
        return [(self.granularity, self.quantile, r, i, None if n.feature is None else self.features[n.feature], n.threshold, n.left, n.right, n.value)
                for r, tree in enumerate(self.trees) for i, n in enumerate(tree)]


def _depth(tree: list[Node], at: int = 0) -> int:
    node = tree[at]
    return 0 if node.feature is None else 1 + max(_depth(tree, node.left), _depth(tree, node.right))


# ------------------------------------------------------------------ fitting
def prepare(train: DataFrame, names: list[str], granularity: str, label: str = K.TARGET) -> DataFrame:
    """(idx, role, y, x): the rows with a label in time order, the last fifth set apart, landed once for all quantiles."""
    from revcast.plans.daily import materialize

    order = [c for c in ["date", *K.GRANULARITIES[granularity], "campaign_id"] if c in train.columns]
    rows = holdout_assign(chrono_index(train.where(F.col(label).isNotNull()), order))
    return materialize(assembled(rows, names, label), "boosting")


def assembled(rows: DataFrame, names: list[str], label: str = K.TARGET) -> DataFrame:
    vec = VectorAssembler(inputCols=names, outputCol="x", handleInvalid="keep")
    return vec.transform(rows.select("idx", "role", F.col(label).cast("double").alias("y"), *names)).select("idx", "role", "y", "x")


def _loss(rows: DataFrame, quantile: float) -> float | None:
    return rows.where("role = 'valid'").agg(F.avg(pinball(F.col("y"), F.col("f"), F.lit(quantile)))).first()[0]


def fit_quantile(data: DataFrame, names: list[str], granularity: str, quantile: float, params: BoostingParams = BoostingParams(),
                 watch: Callable[[int, float], None] | None = None) -> BoostedModel:
    """One boosted model on prepared rows.  ``watch`` is told each round's holdout loss.  Without any
    training row the model is the constant 0; without holdout rows no round is dropped."""
    from revcast.plans.daily import discard, materialize

    start = data.where("role = 'train'").agg(F.percentile_approx("y", quantile, QUANTILE_ACCURACY)).first()[0]
    trees: list[list[Node]] = [[Node(value=0.0 if start is None else float(start))]]
    if start is None:
        return BoostedModel(granularity, quantile, names, trees)
    learner = DecisionTreeRegressor(featuresCol="x", labelCol="gradient", leafCol="leaf", maxDepth=params.depth, maxBins=params.bins,
                                    minInstancesPerNode=params.leaf_rows, seed=params.seed, cacheNodeIds=False)
    held, landed = data.withColumn("f", F.lit(float(start))).persist(), None
    best, best_round = _loss(held, quantile), 0
    if watch:
        watch(0, best)
    for r in range(1, params.rounds + 1):
        gradient = F.when(F.col("y") > F.col("f"), F.lit(quantile)).otherwise(F.lit(quantile - 1))
        seen = F.pmod(F.xxhash64(F.lit(params.seed + r), "idx"), F.lit(1000)) < int(1000 * params.subsample)
        tree = learner.fit(held.where((F.col("role") == "train") & seen).select("x", gradient.alias("gradient")))
        placed = tree.transform(held).withColumn("leaf", F.col("leaf").cast("int"))
        found = placed.where("role = 'train'").groupBy("leaf").agg(F.percentile_approx(F.col("y") - F.col("f"), quantile, QUANTILE_ACCURACY).alias("v")).collect()
        values = [0.0] * ((tree.numNodes + 1) // 2)  # at most 2 ** depth
        for row in found:
            values[row["leaf"]] = params.rate * row["v"]
        trees.append(tree_nodes(tree.toDebugString, values))
        moved = placed.select("idx", "role", "y", "x", (F.col("f") + F.get(F.array(*map(F.lit, values)), F.col("leaf"))).alias("f"))
        after = materialize(moved, "boosting") if r % LAND_EVERY == 0 else moved.persist()
        loss = _loss(after, quantile)
        held.unpersist()
        held = after
        if r % LAND_EVERY == 0:
            if landed is not None:
                discard(landed)
            landed = after
        if watch:
            watch(r, loss)
        if loss is None or loss < best:
            best, best_round = loss, r
        elif r - best_round >= params.patience:
            break
    held.unpersist()
    if landed is not None:
        discard(landed)
    return BoostedModel(granularity, quantile, names, trees[: best_round + 1])


def _at_once(spark: SparkSession, jobs: Iterable[Callable[[], object]], parallelism: int) -> list:
    """The jobs' results; several are under way at once, as one round's small jobs leave cores idle."""
    with ThreadPool(max(1, parallelism)) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), list(jobs), chunksize=1)


class BoostedQuantiles:
    """The models of one granularity, by quantile."""

    def __init__(self, granularity: str, features: list[str], models: dict[float, BoostedModel]):
        self.granularity, self.features, self.models = granularity, features, models

    def predict(self, df: DataFrame, key_cols: list[str]) -> DataFrame:
        """Per row: q10, q50, q90; they may cross (the forecast repairs that)."""
        x = F.array(*[F.col(c).cast("double") for c in self.features])
        rows = df.select(*key_cols, x.alias("_x"))
        return rows.select(*key_cols, *[self.models[q].prediction(F.col("_x")).alias(f"q{int(q * 100)}") for q in K.QUANTILES])

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The node table (rounds x 2 ** (depth + 1) rows a model at most)."""
        return spark.createDataFrame([row for m in self.models.values() for row in m.rows()], NODES)

    def importances(self) -> DataFrame:
        """M8: number of splits on each feature, by quantile."""
        spark = SparkSession.getActiveSession()
        return split_counts(self.nodes(spark), spark.createDataFrame([(self.granularity, f) for f in self.features], "granularity string, feature string"))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.nodes(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = json.dumps({"granularity": self.granularity, "features": self.features})
        spark.createDataFrame([(meta,)], "meta string").write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "BoostedQuantiles":
        meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        number = {f: i for i, f in enumerate(meta["features"])}
        trees: dict[float, dict[int, list[Node]]] = {}
        for r in spark.read.parquet(f"{path}/nodes").orderBy("quantile", "round", "node").collect():
            node = Node(number.get(r["feature"]), r["threshold"], r["left"], r["right"], r["value"])
            trees.setdefault(r["quantile"], {}).setdefault(r["round"], []).append(node)
        models = {q: BoostedModel(meta["granularity"], q, meta["features"], [by[r] for r in sorted(by)]) for q, by in trees.items()}
        return BoostedQuantiles(meta["granularity"], meta["features"], models)


def split_counts(nodes: DataFrame, features: DataFrame) -> DataFrame:
    """(granularity, quantile, feature, importance): inner nodes that split on each of ``features``, 0 where none does."""
    counts = nodes.where(F.col("feature").isNotNull()).groupBy("granularity", "quantile", "feature").agg(F.count("*").cast("double").alias("importance"))
    every = features.crossJoin(features.sparkSession.createDataFrame([(float(q),) for q in K.QUANTILES], "quantile double"))  # names x 3
    return every.join(counts, ["granularity", "quantile", "feature"], "left").select("granularity", "quantile", "feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def fit_boosted(train: DataFrame, names: list[str], granularity: str, params: BoostingParams = BoostingParams(), parallelism: int = 3) -> BoostedQuantiles:
    """All quantiles of a granularity."""
    from revcast.plans.daily import discard

    data = prepare(train, names, granularity)
    fits = _at_once(data.sparkSession, [lambda q=q: fit_quantile(data, names, granularity, q, params) for q in K.QUANTILES], parallelism)
    discard(data)
    return BoostedQuantiles(granularity, names, {m.quantile: m for m in fits})


def train_boosted(features: DataFrame, dictionary: DataFrame, granularities: Iterable[str] = tuple(K.GRANULARITIES),
                  params: BoostingParams = BoostingParams(), lag: int = 0) -> dict[str, BoostedQuantiles]:
    """M7: the models of each granularity; ``lag`` as in ``model.train_all``."""
    from revcast.operators.features import lag_features
    from revcast.operators.model import granularity_training_set

    features = lag_features(features, lag)
    return {g: fit_boosted(*granularity_training_set(features, g, dictionary), g, params) for g in granularities}


def cross_validate_boosted(features: DataFrame, granularity: str, dictionary: DataFrame, params: BoostingParams = BoostingParams(), parallelism: int = 5) -> DataFrame:
    """M2, M5, M6: for each expanding fold a model of each quantile is fitted on the rows before it, with
    the fold itself as the watched holdout, as the original does, and scored on the fold."""
    from revcast.operators.metrics import evaluate
    from revcast.operators.model import granularity_training_set
    from revcast.operators.splits import cv_fold_bounds

    train, names = granularity_training_set(features, granularity, dictionary)
    data = prepare(train, names, granularity)
    jobs = []
    for fold, start, end in cv_fold_bounds(data.count()):
        role = F.when(F.col("idx") < start, "train").otherwise("valid")
        rows = data.where(F.col("idx") < end).withColumn("role", role)
        jobs += [lambda q=q, fold=fold, rows=rows: (fold, rows, fit_quantile(rows, names, granularity, q, params)) for q in K.QUANTILES]
    scored = []
    for fold, rows, m in _at_once(data.sparkSession, jobs, parallelism):
        scored.append(rows.where("role = 'valid'").select(F.lit(fold).alias("fold"), F.lit(m.quantile).alias("quantile"), "y", m.prediction(vector_to_array("x")).alias("yhat")))
    return evaluate(reduce(DataFrame.unionByName, scored), group_cols=("fold",)).withColumn("granularity", F.lit(granularity))

