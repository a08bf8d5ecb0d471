"""Boosted quantile regressions: trees, early stopping, scores, split counts, cross validation; the model store."""

import tempfile

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from revcast.operators import boosting as B
from revcast.operators import model as mo
from revcast.operators.encode import fit_dictionary
from revcast.operators.metrics import constant_quantile_cv, pinball
from revcast.operators.splits import chrono_index


def rows_with_noise(spark, n=4000, drift=0):
    """idx, role, y, x (two features that matter, one that doesn't); the noise's spread follows the second."""
    rnd = np.random.default_rng(11)
    a, b, c = rnd.random(n), rnd.random(n), rnd.random(n)
    y = 10 * (a > 0.5) + rnd.standard_normal(n) * (0.5 + 4 * (b > 0.7))
    y[int(0.8 * n):] += drift
    df = spark.createDataFrame([(i, "train" if i < 0.8 * n else "valid", float(t), *map(float, f)) for i, (t, *f) in enumerate(zip(y, a, b, c))],
                               "idx long, role string, y double, a double, b double, c double")
    return B.assembled(df.withColumnRenamed("y", "revenue"), ["a", "b", "c"]).cache()


def test_tree_nodes_hold_the_tree(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 5), float((i * i) % 11)) for i in range(300)], "a double, b double, y double")
    data = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df)
    tree = DecisionTreeRegressor(featuresCol="x", labelCol="y", maxDepth=4, leafCol="leaf").fit(data)
    scored = tree.transform(data)
    leaves = {int(r["leaf"]): r["prediction"] for r in scored.select("leaf", "prediction").distinct().collect()}
    nodes = B.tree_nodes(tree.toDebugString, [leaves.get(i, 0.0) for i in range((tree.numNodes + 1) // 2)])
    assert len(nodes) == tree.numNodes
    m = B.BoostedModel("channel", 0.5, ["a", "b"], [nodes])
    wrong = scored.where(F.abs(m.prediction(vector_to_array("x")) - F.col("prediction")) > 1e-12)
    assert wrong.count() == 0


def test_quantiles_follow_the_noise(spark):
    data = rows_with_noise(spark)
    models = {q: B.fit_quantile(data, ["a", "b", "c"], "channel", q, B.BoostingParams(rounds=15, depth=3)) for q in (0.1, 0.9)}
    p = data.where("role = 'valid'").select("y", vector_to_array("x").alias("v"), *[m.prediction(vector_to_array("x")).alias(f"q{int(10 * q)}") for q, m in models.items()])
    low, high, narrow, wide = p.agg(F.avg((F.col("y") <= F.col("q1")).cast("int")), F.avg((F.col("y") <= F.col("q9")).cast("int")),
                                    F.avg(F.when(F.get("v", F.lit(1)) < 0.7, F.col("q9") - F.col("q1"))), F.avg(F.when(F.get("v", F.lit(1)) > 0.7, F.col("q9") - F.col("q1")))).first()
    assert 0.05 < low < 0.16 and 0.84 < high < 0.95 and wide > 4 * narrow


def test_early_stopping_goes_back_to_the_best_round(spark):
    """After a jump in the holdout, rounds beyond the first few only make it worse."""
    losses = {}
    data = rows_with_noise(spark, 1500, drift=-4)
    m = B.fit_quantile(data, ["a", "b", "c"], "channel", 0.5, B.BoostingParams(rounds=30, depth=4, leaf_rows=5, patience=3), losses.__setitem__)
    best = min(losses, key=losses.get)
    assert best < max(losses) < 30 and max(losses) == best + 3
    assert len(m.trees) == best + 1
    got = data.where("role = 'valid'").agg(F.avg(pinball(F.col("y"), m.prediction(vector_to_array("x")), F.lit(0.5)))).first()[0]
    assert got == pytest.approx(losses[best], rel=1e-12)


def test_no_rows_and_no_holdout(spark):
    data = rows_with_noise(spark, 200)
    assert B.fit_quantile(data.limit(0), ["a", "b", "c"], "channel", 0.5).trees == [[B.Node(value=0.0)]]
    m = B.fit_quantile(data.where("role = 'train'"), ["a", "b", "c"], "channel", 0.5, B.BoostingParams(rounds=2))
    assert len(m.trees) == 3


@pytest.fixture(scope="module")
def boosted(spark, features_small):
    train, names = mo.granularity_training_set(features_small, "channel", fit_dictionary(features_small))
    return train, B.fit_boosted(train, names, "channel", B.BoostingParams(rounds=4))


def test_fits_leave_no_landed_rows(spark, features_small):
    import glob

    from revcast.session import ensure_checkpoint_dir
    left = lambda: set(glob.glob(ensure_checkpoint_dir(spark).removeprefix("file:") + "/revcast-boosting-*"))
    train, names = mo.granularity_training_set(features_small, "channel", fit_dictionary(features_small))
    before = left()
    B.fit_boosted(train.where("date > '2001-01-01'"), names, "channel", B.BoostingParams(rounds=11, depth=2))
    assert left() == before


def test_fit_uses_the_last_fifth_as_holdout(features_small):
    train, names = mo.granularity_training_set(features_small, "channel", fit_dictionary(features_small))
    data = B.prepare(train, names, "channel")
    n = data.count()
    assert data.where("role = 'train'").agg(F.max("idx"), F.count("*")).first() == (int(0.8 * n) - 1, int(0.8 * n))


def test_split_counts_differ_by_quantile(boosted):
    _, model = boosted
    counts = {}
    for r in model.importances().collect():
        counts.setdefault(r["quantile"], {})[r["feature"]] = r["importance"]
    assert {tuple(sorted(c)) for c in counts.values()} == {tuple(sorted(model.features))}
    assert len({tuple(sorted(c.items())) for c in counts.values()}) == 3
    for q, c in counts.items():
        assert sum(c.values()) == sum(n.feature is not None for t in model.models[q].trees for n in t) > 0


def test_stored_model_scores_alike_without_python(spark, boosted):
    train, model = boosted
    path = "file://" + tempfile.mkdtemp(prefix="revcast-boosted-") + "/channel"
    model.save(path)
    back = B.BoostedQuantiles.load(spark, path)
    keyed = train.select("*", F.struct("date", "channel").alias("k"))
    one, two = model.predict(keyed, ["k"]), back.predict(keyed, ["k"])
    assert one.exceptAll(two).count() == 0 and one.count() == train.count()
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan.split("Scan")[0].split("Project")[0]


def test_boosting_beats_forest_and_constant(features_small):
    d = fit_dictionary(features_small)
    mean = lambda df: {r["quantile"]: r["loss"] for r in df.groupBy("quantile").agg(F.avg("pinball_loss").alias("loss")).collect()}
    ours = B.cross_validate_boosted(features_small, "campaign", d, B.BoostingParams(rounds=12, rate=0.4))
    rows = ours.collect()
    assert {(r["fold"], r["quantile"]) for r in rows} == {(k, q) for k in range(5) for q in (0.1, 0.5, 0.9)}
    train, _ = mo.granularity_training_set(features_small, "campaign", d)
    forest, constant = mean(mo.cross_validate(features_small, "campaign", d)), mean(constant_quantile_cv(chrono_index(train)))
    for q, loss in mean(ours).items():
        assert loss < forest[q] < constant[q]


def test_store_reads_finished_trainings_only(spark):
    from revcast.plans import store

    path = "file://" + tempfile.mkdtemp(prefix="revcast-store-")
    with pytest.raises(Exception):
        store.newest(spark, path)

    def write(folder, value, fail=False):
        spark.createDataFrame([(value,)], "v int").write.parquet(f"{folder}/one")
        if fail:
            raise RuntimeError("ended half-way")
        spark.createDataFrame([(value,)], "v int").write.parquet(f"{folder}/two")

    read = lambda: [spark.read.parquet(f"{store.newest(spark, path)}/{t}").first()["v"] for t in ("one", "two")]
    store.publish(spark, path, lambda f: write(f, 1))
    assert read() == [1, 1]
    with pytest.raises(RuntimeError):
        store.publish(spark, path, lambda f: write(f, 2, fail=True))
    assert read() == [1, 1]
    store.publish(spark, path, lambda f: write(f, 3))
    assert read() == [3, 3] and store.manifest(spark, path).count() == 2
