import numpy as np
from pyspark.sql import functions as F

from revcast.operators.encode import encode, fit_dictionary
from revcast.operators.metrics import exact_quantiles
from revcast.operators.splits import cv_fold_bounds, ordered_index


def test_cv_bounds_match_expanding_split():
    for n in (12, 13, 600):
        ts = n // 6
        bounds = cv_fold_bounds(n)
        assert [b[1] for b in bounds] == list(range(n - 5 * ts, n, ts))
        assert all(e - s == ts for _, s, e in bounds)


def test_ordered_index(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = sorted((r["v"], r["idx"]) for r in ordered_index(df, ["v"], "idx").collect())
    assert [i for _, i in got] == list(range(1000))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(size=301).round(3).tolist()
    df = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(vals)], "g int, y double")
    got = {(r["g"], r["quantile"]): r["y"] for r in exact_quantiles(df, ["g"], "y").collect()}
    for g in range(3):
        arr = np.array(vals[g::3])
        for q in (0.1, 0.5, 0.9):
            assert abs(got[(g, q)] - np.quantile(arr, q)) < 1e-9


def test_unseen_in_sort_order(spark):
    train = spark.createDataFrame([("b",), ("A",), ("a",)], "campaign_name string")
    d = {r["value"]: r["idx"] for r in fit_dictionary(train, ["campaign_name"]).collect()}
    # byte order: upper case < '__UNSEEN__' < lower case
    assert d == {"A": 0, "__UNSEEN__": 1, "a": 2, "b": 3}
    test = spark.createDataFrame([("a",), ("zz",)], "campaign_name string")
    enc = sorted(r["campaign_name"] for r in encode(test, fit_dictionary(train, ["campaign_name"]),
                                                    ["campaign_name"]).collect())
    assert enc == [1, 2]
