"""Isotonic fits against the minimax formula, cut into many stretches and in one."""

from __future__ import annotations

import numpy as np
import pytest

from fieldglass.operators import isotonic, learn, skew


def minimax(y, w):
    n = len(y)
    mean = lambda j, k: np.sum(y[j:k + 1] * w[j:k + 1]) / np.sum(w[j:k + 1])
    return [max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]


def cases():
    rng = np.random.default_rng(8)
    x = np.arange(60.0)
    yield x, np.sort(rng.normal(size=60)), np.ones(60)
    yield x, np.sort(rng.normal(size=60))[::-1], rng.integers(1, 5, 60).astype(float)
    yield x, (rng.uniform(size=60) < x / 60).astype(float), np.ones(60)
    yield x, np.sin(x / 5), rng.uniform(0.1, 3, 60)
    yield np.repeat(np.arange(12.0), 5), rng.normal(size=60), np.ones(60)
    yield np.zeros(1), np.array([2.5]), np.ones(1)


@pytest.mark.parametrize("most_rows", [4, 1000])
@pytest.mark.parametrize("number", range(6))
def test_fit_equals_minimax(spark, monkeypatch, number, most_rows):
    monkeypatch.setattr(skew, "PIECE_ROWS", 7)
    x, y, w = list(cases())[number]
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist(), w.tolist()), (None, 1.0, 1.0), (3.0, None, 1.0)], "x double, y double, w double")
    blocks = isotonic.fit_isotonic(df, "x", "y", "w", most_rows=most_rows).collect()
    at = np.unique(x)
    sums = np.array([np.sum(y[x == v] * w[x == v]) for v in at])
    weights = np.array([np.sum(w[x == v]) for v in at])
    want = minimax(sums / weights, weights)
    for v, value in zip(at, want):
        mine = [b["value"] for b in blocks if b["low"] <= v <= b["high"]]
        assert len(mine) == 1 and mine[0] == pytest.approx(value, abs=1e-9)


def test_apply_interpolates_and_clips(spark):
    blocks = spark.createDataFrame([(0.1, 0.2, 0.0, 1.0), (0.4, 0.4, 0.5, 1.0), (0.6, 0.9, 1.0, 1.0)], "low double, high double, value double, weight double")
    df = spark.createDataFrame([(1, 0.0), (2, 0.15), (3, 0.3), (4, 0.4), (5, 0.5), (6, 0.95), (7, None)], "id long, p double")
    got = {r["id"]: r["isotonic"] for r in isotonic.apply_isotonic(df, "p", blocks).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: pytest.approx(0.25), 4: 0.5, 5: pytest.approx(0.75), 6: 1.0, 7: None}


def test_no_rows_give_no_blocks(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert isotonic.fit_isotonic(empty, "x", "y").count() == 0


def test_sigmoid_of_separated_and_empty_classes_is_finite(spark):
    rows = [(0.1 + 0.01 * i, int(i > 20)) for i in range(40)]
    out = learn.fit_calibrators(spark.createDataFrame(rows, "p double, y int"), "p", "y")(spark.createDataFrame(rows, "p double, y int"))
    assert out.where("sigmoid is null or isnan(sigmoid) or isotonic is null").count() == 0
