"""Feature matrix (M1), training metadata (A17/A20) and the quantile forest
(M4, M7-M9) with its model store (S11).

Quantile forest (Meinshausen 2006, simplified): a Spark ML random forest is
fitted once per granularity; every training row is routed to one leaf per tree
(``leafCol``), per (tree, leaf) the label quantiles are estimated with
``percentile_approx`` (bounded sketch, partial aggregation), and a prediction
averages the quantiles of the leaves a row falls into.  One fit serves all
quantiles and the output never crosses (each tree's quantiles are ordered).
The leaf table has at most trees x 2^depth rows; scoring holds it as a constant.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revcast import constants as K
from revcast.functions.expr import finite_or_zero
from revcast.operators.encode import encode, fit_dictionary
from revcast.operators.forecast import lookback
from revcast.operators.rollup import daily_rollup, latest_rows, numeric_features

FOREST_PARAMS = dict(numTrees=20, maxDepth=6, minInstancesPerNode=20, subsamplingRate=0.8,
                     featureSubsetStrategy="onethird", maxBins=32, seed=42)
QUANTILE_ACCURACY = 10_000


def feature_names(df: DataFrame) -> list[str]:
    """Encoded categoricals present + numeric columns minus the excluded list, in column order."""
    cats = [c for c in K.CATEGORICAL_COLS if c in df.columns]
    num = set(numeric_features(df))
    return [c for c in df.columns if c in cats or c in num]


def feature_matrix(df: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, list[str]]:
    """M1: encode categoricals, pick features, NaN/Inf/NULL -> 0."""
    enc = encode(df, dictionary)
    names = feature_names(enc)
    return enc.withColumns({c: finite_or_zero(F.col(c)) for c in names}), names


def training_metadata(features: DataFrame) -> DataFrame:
    """A17 + A20 as one row (vocabularies are distinct first, then collected)."""
    n_feat = len([c for c in K.CATEGORICAL_COLS if c in features.columns]) + len(numeric_features(features))
    chans = features.select("channel").distinct().agg(
        F.array_join(F.array_sort(F.collect_list("channel")), ",").alias("channels"))
    types = features.select("campaign_type").distinct().agg(
        F.array_join(F.array_sort(F.collect_list("campaign_type")), ",").alias("campaign_types"))
    return features.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(n_feat).cast("bigint").alias("n_features"),
        F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        chans.select("channels").scalar().alias("channels"),
        types.select("campaign_types").scalar().alias("campaign_types"),
        F.round(F.min(K.TARGET), 2).alias("target_min"), F.round(F.max(K.TARGET), 2).alias("target_max"))


@dataclass
class QuantileForest:
    granularity: str
    features: list[str]
    forest: RandomForestRegressionModel
    leaves: DataFrame          # tree, leaf, q10, q50, q90

    def _leaf_table(self) -> Column:
        """Quantiles by tree and leaf as a constant (trees x 2 ** depth entries, whatever the data)."""
        trees: dict[int, dict[int, list[float]]] = {}
        for r in self.leaves.collect():
            trees.setdefault(r["tree"], {})[r["leaf"]] = [r[f"q{int(q * 100)}"] for q in K.QUANTILES]
        table = [[trees.get(t, {}).get(leaf) for leaf in range(max(trees.get(t, {0: 0})) + 1)] for t in range(self.forest.getNumTrees)]
        return F.from_json(F.lit(json.dumps(table)), "array<array<array<double>>>")

    def predict(self, df: DataFrame, key_cols: list[str]) -> DataFrame:
        """Per row: q10, q50, q90 averaged over trees; the leaves are looked up in place, without a shuffle."""
        vec = VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="keep")
        scored = self.forest.transform(vec.transform(df.select(*key_cols, *self.features)))
        table = self._leaf_table()
        found = F.transform(vector_to_array("_leaf"), lambda leaf, tree: F.get(F.get(table, tree), leaf.cast("int")))
        rows = scored.select(*key_cols, F.filter(found, lambda q: q.isNotNull()).alias("_q"))

        def mean(i: int) -> Column:
            return F.aggregate("_q", F.lit(0.0), lambda a, q: a + F.get(q, F.lit(i))) / F.size("_q")

        return rows.select(*key_cols, *[mean(i).alias(f"q{int(q * 100)}") for i, q in enumerate(K.QUANTILES)])

    def importances(self) -> DataFrame:
        """M8: forest importances (normalised gain), one row per quantile and feature."""
        spark = SparkSession.getActiveSession()
        imp = self.forest.featureImportances.toArray().tolist()
        rows = [(self.granularity, float(q), f, float(v)) for q in K.QUANTILES for f, v in zip(self.features, imp)]
        return spark.createDataFrame(rows, "granularity string, quantile double, feature string, importance double")

    def save(self, path: str) -> None:
        self.forest.write().overwrite().save(os.path.join(path, "forest"))
        self.leaves.write.mode("overwrite").parquet(os.path.join(path, "leaves"))
        spark = self.leaves.sparkSession
        meta = json.dumps({"granularity": self.granularity, "features": self.features})
        spark.createDataFrame([(meta,)], "meta string").write.mode("overwrite").json(os.path.join(path, "meta"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "QuantileForest":
        meta = json.loads(spark.read.json(os.path.join(path, "meta")).first()["meta"])
        return QuantileForest(meta["granularity"], meta["features"],
                              RandomForestRegressionModel.load(os.path.join(path, "forest")),
                              spark.read.parquet(os.path.join(path, "leaves")))


def granularity_training_set(features: DataFrame, granularity: str, dictionary: DataFrame) -> tuple[DataFrame, list]:
    """A1 rollup, then the feature matrix for that level."""
    rolled = daily_rollup(features, granularity)
    return feature_matrix(rolled, dictionary)


def fit_forest(train: DataFrame, names: list[str], granularity: str, label: str = K.TARGET,
               params: dict | None = None) -> QuantileForest:
    vec = VectorAssembler(inputCols=names, outputCol="_features", handleInvalid="keep")
    rf = RandomForestRegressor(featuresCol="_features", labelCol=label, leafCol="_leaf",
                               **{**FOREST_PARAMS, **(params or {})})
    from revcast.plans.daily import materialize
    # the forest makes several passes over its input: compute the matrix once
    data = vec.transform(materialize(train.select(*names, label).where(F.col(label).isNotNull()), "train"))
    model = rf.fit(data)
    leaf_rows = model.transform(data).select(F.col(label).alias("_y"),
                                             F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf"))
    qs = [float(q) for q in K.QUANTILES]
    leaves = (leaf_rows.withColumn("leaf", F.col("leaf").cast("int")).groupBy("tree", "leaf")
              .agg(F.percentile_approx("_y", qs, QUANTILE_ACCURACY).alias("_q"))
              .select("tree", "leaf", *[F.col("_q")[i].alias(f"q{int(q * 100)}") for i, q in enumerate(qs)]))
    return QuantileForest(granularity, names, model, materialize(leaves, "leaves"))


def train_all(features: DataFrame, granularities=tuple(K.GRANULARITIES), lag: int = 0) -> tuple[dict, DataFrame]:
    """M7: one forest per granularity (all quantiles each); returns models and the dictionary.
    ``lag`` > 0 trains on features shifted by that many rows per campaign (D7)."""
    from revcast.operators.features import lag_features
    dictionary = fit_dictionary(features)
    features = lag_features(features, lag)
    models = {}
    for g in granularities:
        train, names = granularity_training_set(features, g, dictionary)
        models[g] = fit_forest(train, names, g)
    return models, dictionary


def importance_table(models: dict) -> DataFrame:
    out = None
    for m in models.values():
        out = m.importances() if out is None else out.unionByName(m.importances())
    return out


def forest_daily_quantiles(features: DataFrame, models: dict, dictionary: DataFrame) -> DataFrame:
    """Each group's latest rolled-up row scored once -> (granularity, keys, daily_quantiles).

    Only groups active in the longest look-back are forecast, so only those days are read."""
    features = lookback(features, max(K.HORIZONS))
    out = None
    for g, m in models.items():
        keys = K.GRANULARITIES[g]
        if g == "campaign":
            latest = latest_rows(features, g)
        else:
            # roll up only each group's last day instead of the whole history
            last = features.groupBy(*keys).agg(F.max("date").alias("date"))
            latest = daily_rollup(features.join(last, [*keys, "date"], "left_semi"), g)
        mat, _ = feature_matrix(latest.withColumns({f"_key_{k}": F.col(k) for k in keys}), dictionary)
        pred = m.predict(mat, [f"_key_{k}" for k in keys])
        labelled = pred.select(
            F.lit(g).alias("granularity"),
            *[(F.col(f"_key_{k}") if k in keys else F.lit(K.ALL)).alias(k) for k in K.CATEGORICAL_COLS],
            F.array("q10", "q50", "q90").alias("daily_quantiles"))
        out = labelled if out is None else out.unionByName(labelled)
    return out


def cross_validate(features: DataFrame, granularity: str, dictionary: DataFrame,
                   params: dict | None = None) -> DataFrame:
    """M2 + M5/M6 for the forest: fit on each expanding fold, score its test rows."""
    from revcast.operators.metrics import evaluate
    from revcast.operators.splits import chrono_index, cv_fold_bounds

    train_all_rows, names = granularity_training_set(features, granularity, dictionary)
    order = [c for c in ["date", *K.GRANULARITIES[granularity], "campaign_id"] if c in train_all_rows.columns]
    ix = chrono_index(train_all_rows, order)
    n = ix.count()
    out = None
    for fold, start, end in cv_fold_bounds(n):
        tr = ix.where(F.col("idx") < start)
        te = ix.where((F.col("idx") >= start) & (F.col("idx") < end))
        m = fit_forest(tr, names, granularity, params=params)
        p = m.predict(te, ["idx"]).join(te.select("idx", F.col(K.TARGET).alias("y")), "idx")
        long = p.select("y", F.inline(F.array(*[F.struct(F.lit(float(q)).alias("quantile"),
                                                         F.col(f"q{int(q * 100)}").alias("yhat"))
                                                for q in K.QUANTILES])))
        ev = evaluate(long).withColumn("fold", F.lit(fold)).withColumn("granularity", F.lit(granularity))
        out = ev if out is None else out.unionByName(ev)
    return out
