"""Fits against NumPy and MLlib, folds without leakage, resampling."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.operators import bootstrap, learn, reshape, trees


def data(n=300, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + [0.0, 10.0, 3.0]
    period = rng.integers(2018, 2023, n)
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=n)
    label = (y - y.mean() + rng.normal(size=n) > 0).astype(int)
    return period, x, y, label


@pytest.fixture(scope="module")
def frame(spark):
    period, x, y, label = data()
    rows = [(i, int(p), *map(float, v), float(t), int(c)) for i, (p, v, t, c) in enumerate(zip(period, x, y, label))]
    return spark.createDataFrame(rows, "id long, p int, a double, b double, c double, y double, label int").repartition(4)


def test_folds_train_strictly_earlier(frame):
    folds = reshape.expanding_folds(frame, "p", [2020, 2021])
    rows = folds.groupBy("fold", "fold_role").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).collect()
    for r in rows:
        assert r["hi"] < r["fold"] if r["fold_role"] == "TRAIN" else r["lo"] == r["hi"] == r["fold"]


@pytest.mark.parametrize("alpha", [0.0, 1.0, 50.0])
def test_ridge_matches_the_normal_equations(frame, alpha):
    period, x, y, _ = data()
    fit = learn.fit_ridge(frame, "p", [2021], [learn.Candidate("m", ("a", "b", "c"))], [alpha], "y")[0]
    use = period < 2021
    z = (x[use] - x[use].mean(0)) / x[use].std(0)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y[use] - y[use].mean()))
    assert np.allclose(fit.weights, w, atol=1e-9) and fit.intercept == pytest.approx(y[use].mean())
    got = {r["id"]: r["prediction"] for r in learn.oof_predict(frame, [fit], "p", ["id"]).collect()}
    for i in np.flatnonzero(period == 2021):
        assert got[i] == pytest.approx(y[use].mean() + ((x[i] - x[use].mean(0)) / x[use].std(0)) @ w)
    assert len(got) == (period == 2021).sum()


def test_constant_feature_is_harmless(frame):
    rows = frame.withColumn("k", F.lit(7.0))
    fit = learn.fit_ridge(rows, "p", [2021], [learn.Candidate("m", ("a", "k"))], [1.0], "y")[0]
    assert fit.weights[1] == pytest.approx(0.0) and np.isfinite(fit.weights).all()


def test_logistic_matches_mllib(frame):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    period, x, _, label = data()
    c = 0.5
    fit = learn.fit_logistic(frame, "p", [2022], [learn.Candidate("m", ("a", "b", "c"))], [c], "label")[0]
    use = period < 2022
    mean, sd = x[use].mean(0), x[use].std(0)
    scaled = frame.where("p < 2022").select(F.col("label").cast("double").alias("l"), *[((F.col(n) - float(m)) / float(s)).alias(n) for n, m, s in zip("abc", mean, sd)])
    model = LogisticRegression(labelCol="l", featuresCol="x", regParam=1.0 / (c * use.sum()), standardization=False, tol=1e-12, maxIter=300).fit(
        VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(scaled)
    )
    assert np.allclose(fit.weights, model.coefficients.toArray(), atol=1e-5)
    assert fit.intercept == pytest.approx(model.intercept, abs=1e-5)


def test_logistic_fills_the_training_median(spark, frame):
    period, x, _, label = data()
    rows = frame.withColumn("a", F.when(F.col("id") % 5 != 0, F.col("a")))
    fit = learn.fit_logistic(rows, "p", [2021, 2022], [learn.Candidate("m", ("a", "b"))], [1.0], "label")
    for f in fit:
        use = (period < f.fold) & (np.arange(len(period)) % 5 != 0)
        assert f.fill[0] == pytest.approx(np.median(x[use, 0]))


def test_later_rows_cannot_change_a_fold(frame):
    """Leakage: changing validation rows must not move the fold's model."""
    changed = frame.withColumn("y", F.when(F.col("p") >= 2021, F.col("y") * 100).otherwise(F.col("y"))).withColumn(
        "a", F.when(F.col("p") >= 2021, F.lit(1e6)).otherwise(F.col("a"))
    )
    c = [learn.Candidate("m", ("a", "b"))]
    one = learn.fit_ridge(frame, "p", [2021], c, [1.0], "y")[0]
    two = learn.fit_ridge(changed, "p", [2021], c, [1.0], "y")[0]
    assert np.allclose(one.weights, two.weights, rtol=1e-5)


def test_backtest_pools_and_beats_a_constant(frame):
    fits = learn.fit_ridge(frame, "p", [2020, 2021, 2022], learn.ablation(("a", "b")), [1.0], "y")
    table = learn.backtest_ridge(frame, fits, "p", "y")
    assert table.count() == 9
    pooled = {r["candidate"]: r for r in learn.pooled(table, ["mae", "rmse"]).collect()}
    assert pooled["full"]["weighted_mae"] < pooled["without_a"]["weighted_mae"]
    period, x, y, _ = data()
    n = sum((period == f).sum() for f in (2020, 2021, 2022))
    assert pooled["full"]["weight_total"] == n
    bank = learn.oof_residuals(frame, fits, "p", "y", ["id"])
    assert bank.count() == 3 * n


def test_holdout_routes_by_completeness(frame):
    rows = frame.withColumn("split", F.when(F.col("p") == 2022, "holdout").otherwise("train")).withColumn("a", F.when(F.col("id") % 4 != 0, F.col("a")))
    out = learn.evaluate_holdout(rows, "split", "holdout", learn.Candidate("p", ("a", "b")), learn.Candidate("f", ("b",)), "y", ["id"], alpha=1.0).collect()
    assert {(r["id"] % 4 == 0, r["prediction_mode"]) for r in out} == {(True, "FALLBACK"), (False, "PRIMARY")}


def test_calibrators_recover_a_known_distortion(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(0.05, 0.95, 4000)
    truth = 1 / (1 + np.exp(-0.5 * np.log(p / (1 - p))))
    y = (rng.uniform(size=4000) < truth).astype(int)
    df = spark.createDataFrame([(float(round(a, 3)), int(b)) for a, b in zip(p, y)], "p double, y int")
    out = learn.fit_calibrators(df, "p", "y")(df).toPandas()
    q = out["p"].to_numpy()
    want = 1 / (1 + np.exp(-0.5 * np.log(q / (1 - q))))
    assert np.abs(out["sigmoid"] - want).mean() < 0.03
    order = out.sort_values("p")["isotonic"].to_numpy()
    assert (np.diff(order) >= -1e-12).all() and out["isotonic"].mean() == pytest.approx(out["y"].mean(), abs=1e-6)


def test_trees_score_every_fold(frame):
    rows = learn.gbt_time_cv(frame, "p", [2021, 2022], ["a", "b"], "label", iterations=3).collect()
    assert {r["fold"] for r in rows} == {2021, 2022} and all(r["accuracy"] > 0.6 for r in rows)


def test_trees_do_not_see_later_rows_and_take_nulls(frame):
    edges = trees.quantile_bins(frame, ["a", "b"], "p", 2021, bins=8)
    binned = frame.select("p", "label", *[trees.bin_of(F.col(c), edges[c]).alias(c) for c in ("a", "b")])
    one = trees.fit_trees(binned, "p", ["a", "b"], "label", number=2, depth=2, folds=[2021])
    changed = binned.withColumn("label", F.when(F.col("p") >= 2021, 1 - F.col("label")).otherwise(F.col("label")))
    two = trees.fit_trees(changed, "p", ["a", "b"], "label", number=2, depth=2, folds=[2021])
    key = lambda fitted: sorted(tuple(r) for r in fitted.splits.collect())
    assert key(one) == key(two) and key(one)
    holes = binned.withColumn("a", F.when(F.col("a") > 2, F.col("a")))
    assert trees.fit_trees(holes, "p", ["a", "b"], "label", number=1, depth=2, folds=[2021, 2022]).held_out.where("p is null").count() == 0
    with pytest.raises(ValueError, match="both classes"):
        trees.fit_trees(binned.withColumn("label", F.lit(1)), "p", ["a"], "label", number=1, folds=[2021])


def test_bootstrap_is_stable_and_covers(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0.3, 1.0, 500), 2)
    df = spark.createDataFrame([("g", float(v)) for v in x], "g string, x double")
    df = df.withColumn("id", F.monotonically_increasing_id()).cache()
    one = bootstrap.bootstrap_mean(df.repartition(1), "g", "x", "id", 2000, 7).first()
    two = bootstrap.bootstrap_mean(df.repartition(7), "g", "x", "id", 2000, 7).first()
    assert one["ci_low"] == pytest.approx(two["ci_low"]) and one["ci_high"] == pytest.approx(two["ci_high"])
    half = 1.96 * x.std() / np.sqrt(len(x))
    assert one["mean"] == pytest.approx(x.mean()) and one["n"] == 500
    assert one["ci_low"] == pytest.approx(x.mean() - half, abs=0.02) and one["ci_high"] == pytest.approx(x.mean() + half, abs=0.02)


def test_learning_queries_take_all_folds_and_penalties(spark, monkeypatch):
    from __spark_entry__ import queries

    class Seen(Exception):
        pass

    def caught(*args, **settings):
        raise Seen(args, settings)

    monkeypatch.setattr(learn, "fit_logistic", caught)
    folder = "/root/testdata/sf0.001"
    sources = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    periods = sorted({int(r["source"].rstrip().split("_")[-1].lstrip("abcdefghijklmnopqrstuvwxyz-")) for r in sources.select("source").distinct().collect()})
    for name in ("logistic_grid", "calibrators", "governance_report"):
        with pytest.raises(Seen) as found:
            queries()[name](spark, folder)
        args, settings = found.value.args
        assert args[2] == periods[1:] and settings == {}
        assert name != "logistic_grid" or len(args[4]) == 12
