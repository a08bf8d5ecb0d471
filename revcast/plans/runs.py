"""End-to-end runs: training (models + importances) and forecasting (table + report).

These are the batch entry points a scheduler calls; every heavy step is a
Spark job, the driver only sequences them.  The daily table is materialised
once under ``spark.checkpoint.dir`` and shared by all steps.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from revcast.operators.boosting import BoostedQuantiles, BoostingParams, cross_validate_boosted, train_boosted
from revcast.operators.chunked import CHUNK_ROWS, clean_chunked, engineer_features_chunked
from revcast.constants import GRANULARITIES
from revcast.operators.clean import clean
from revcast.operators.encode import fit_dictionary
from revcast.operators.features import engineer_features
from revcast.operators.forecast import forecast, format_forecast
from revcast.operators.model import (
    QuantileForest, cross_validate, forest_daily_quantiles, importance_table, train_all, training_metadata,
)
from revcast.operators.report import report_lines
from revcast.plans import store
from revcast.plans.daily import materialize
from revcast.sources import sinks
from revcast.sources.fixture import ad_daily
from revcast.sources.vendors import load_all_channels


def load_daily(spark: SparkSession, source: str, kind: str = "vendors") -> DataFrame:
    """Engineered daily table from vendor CSV exports (``kind='vendors'``) or the star-schema fixture.

    In vendor data many ids may share one name, so a (channel, campaign_name)
    series has no bound: its windows always take the chunked, skew-safe plan.
    The fixture has one row per day per series by construction.
    """
    if kind != "vendors":
        return materialize(engineer_features(clean(ad_daily(spark, source))), "features", True)
    cleaned = materialize(clean_chunked(materialize(load_all_channels(spark, source), "raw"), CHUNK_ROWS))
    return materialize(engineer_features_chunked(cleaned, CHUNK_ROWS), "features", True)


def train(spark: SparkSession, features: DataFrame, model_dir: str, lag: int = 0, evaluate: bool = True, kind: str = "boosted",
          params: BoostingParams = BoostingParams()) -> dict:
    """Fit one model per granularity (``kind``: ``boosted`` quantile regressions, or a quantile ``forest``)
    and publish them with the dictionary, the importances, the training's metadata and (``evaluate``) the
    five-fold pinball loss and coverage of each granularity and quantile; ``lag=1`` trains on the previous
    row's features (no same-day leakage, D7)."""
    if kind == "boosted":
        dictionary = materialize(fit_dictionary(features), "dictionary")
        models = train_boosted(features, dictionary, params=params, lag=lag)
    else:
        models, dictionary = train_all(features, lag=lag)

    def write(folder: str) -> None:
        for g, m in models.items():
            m.save(f"{folder}/{g}")
        dictionary.write.parquet(f"{folder}/dictionary")
        sinks.write_importances(importance_table(models), f"{folder}/feature_importances")
        training_metadata(features).write.parquet(f"{folder}/metadata")
        spark.createDataFrame([(kind,)], "kind string").write.parquet(f"{folder}/kind")
        if evaluate:
            validate = (lambda g: cross_validate_boosted(features, g, dictionary, params)) if kind == "boosted" else (lambda g: cross_validate(features, g, dictionary))
            reduce(DataFrame.unionByName, [validate(g) for g in GRANULARITIES]).write.parquet(f"{folder}/evaluation")

    store.publish(spark, model_dir, write)
    return models


def load_models(spark: SparkSession, model_dir: str) -> tuple[dict, DataFrame]:
    """All models of the store's newest training, at any path that Spark reads; a missing one is an error."""
    return _load(spark, store.newest(spark, model_dir))


def _load(spark: SparkSession, folder: str) -> tuple[dict, DataFrame]:
    kind = spark.read.parquet(f"{folder}/kind").first()["kind"]
    loader = BoostedQuantiles if kind == "boosted" else QuantileForest
    return {g: loader.load(spark, f"{folder}/{g}") for g in GRANULARITIES}, spark.read.parquet(f"{folder}/dictionary")


def predict(spark: SparkSession, features: DataFrame, out_dir: str, model_dir: str | None = None,
            multiplier: float = 1.0) -> DataFrame:
    """Forecast table (+ CSV export and text report).  Without a model store the
    empirical-quantile model is used."""
    dq, imp, meta = None, None, None
    if model_dir:
        folder = store.newest(spark, model_dir)
        models, dictionary = _load(spark, folder)
        dq = forest_daily_quantiles(features, models, dictionary)
        imp = importance_table(models)
        meta = spark.read.parquet(f"{folder}/metadata")
    fc = materialize(forecast(features, multiplier, daily_quantiles=dq), "forecast")
    sinks.write_forecast(fc, os.path.join(out_dir, "predictions"))
    # the report reads the exported (rounded) forecast, as the original does
    sinks.write_report(report_lines(format_forecast(fc), imp, features, meta), os.path.join(out_dir, "causal_summary"))
    return fc
