"""Fitting and back-testing on tables.

Data passes are shared by all folds and candidates:

* ridge needs only sums of products, which add up over periods, so one aggregate
  per period yields every expanding fold's normal equations;
* logistic regression takes a Newton step for *all* models per pass: tasks sum
  gradients and curvatures with NumPy, the small systems are solved outside;
* scoring adds one prediction column per model and computes all metrics in a
  single aggregate.

What reaches the driver is bounded by (periods or models) x features squared.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions.scalars import inverse_logit, logit

from .aggregates import long_features, weighted_summary
from .quantiles import exact_quantiles


@dataclass(frozen=True)
class Candidate:
    name: str
    features: tuple[str, ...]


@dataclass(frozen=True)
class Fit:
    """A linear predictor on standardised features, for one fold."""

    candidate: str
    setting: float
    fold: int
    features: tuple[str, ...]
    intercept: float
    weights: tuple[float, ...]
    means: tuple[float, ...]
    sds: tuple[float, ...]
    fill: tuple[float | None, ...] = ()
    train_mean: float = 0.0

    def score(self) -> Column:
        """Intercept plus weighted standardised features, as one expression."""
        total = F.lit(float(self.intercept))
        fills = self.fill or (None,) * len(self.features)
        for name, w, m, s, fill in zip(self.features, self.weights, self.means, self.sds, fills):
            x = F.col(name).cast("double")
            if fill is not None:
                x = F.coalesce(x, F.lit(float(fill)))
            total = total + F.lit(float(w)) * (x - F.lit(float(m))) / F.lit(float(s))
        return total

    def terms(self) -> dict[str, Column]:
        """Per-feature contributions; with the intercept they rebuild the score."""
        fills = self.fill or (None,) * len(self.features)
        out = {}
        for name, w, m, s, fill in zip(self.features, self.weights, self.means, self.sds, fills):
            x = F.col(name).cast("double")
            x = F.coalesce(x, F.lit(float(fill))) if fill is not None else x
            out[name] = F.lit(float(w)) * (x - F.lit(float(m))) / F.lit(float(s))
        return out


def _all_features(candidates: Sequence[Candidate]) -> list[str]:
    return list(dict.fromkeys(f for c in candidates for f in c.features))


def _safe_sd(variance: np.ndarray) -> np.ndarray:
    """A constant feature keeps scale one, so its standardised value is zero."""
    return np.where(variance > 1e-24, np.sqrt(np.maximum(variance, 0.0)), 1.0)


# -- ridge ----------------------------------------------------------------------

def fit_ridge(
    df: DataFrame,
    period: str,
    folds: Sequence[int],
    candidates: Sequence[Candidate],
    alphas: Sequence[float],
    target: str,
) -> list[Fit]:
    """M3: minimise |y - Zw|^2 + alpha |w|^2 for each fold's earlier periods.

    Z is standardised with the population sd of the training rows; the
    intercept is free.  Rows must be complete.  Two aggregate passes in all.
    """
    columns = [*_all_features(candidates), target]
    x = [F.col(c).cast("double") for c in columns]
    # Sums are taken about the overall means to keep them well conditioned.
    center = np.array(df.agg(*[F.avg(c) for c in x]).first(), dtype="float64")
    z = [c - F.lit(float(m)) for c, m in zip(x, center)]
    pairs = [(i, j) for i in range(len(z)) for j in range(i + 1)]
    table = df.groupBy(F.col(period).alias("p")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(c) for c in z]).alias("s"),
        F.array(*[F.sum(z[i] * z[j]) for i, j in pairs]).alias("ss"),
    ).collect()  # one row per period
    fits = []
    for fold in folds:
        rows = [r for r in table if r["p"] is not None and r["p"] < fold]
        if not rows:
            raise ValueError(f"fold {fold} has no earlier period")
        n = float(sum(r["n"] for r in rows))
        mean = np.sum([r["s"] for r in rows], axis=0) / n
        cov = np.zeros((len(z), len(z)))
        for (i, j), value in zip(pairs, np.sum([r["ss"] for r in rows], axis=0)):
            cov[i, j] = cov[j, i] = value / n - mean[i] * mean[j]
        y = len(z) - 1
        for c in candidates:
            k = [columns.index(f) for f in c.features]
            sd = _safe_sd(np.diag(cov)[k])
            gram = n * cov[np.ix_(k, k)] / np.outer(sd, sd)
            right = n * cov[k, y] / sd
            for alpha in alphas:
                w = np.linalg.lstsq(gram + alpha * np.eye(len(k)), right, rcond=None)[0]
                level = float(mean[y] + center[y])
                fits.append(Fit(c.name, float(alpha), int(fold), c.features, level, tuple(w), tuple(mean[k] + center[k]), tuple(sd), (), level))
    return fits


# -- logistic -----------------------------------------------------------------------

def _training_scale(df, period, folds, features):
    """Medians, means and sds of each fold's training rows after median filling."""
    x = [F.col(f).cast("double") for f in features]
    table = df.groupBy(F.col(period).alias("p")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.count(c) for c in x]).alias("k"),
        F.array(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in x]).alias("s"),
        F.array(*[F.coalesce(F.sum(c * c), F.lit(0.0)) for c in x]).alias("q"),
    ).collect()
    missing = any(k < r["n"] for r in table for k in r["k"])
    medians: dict[tuple[int, str], float] = {}
    if missing:
        counts = long_features(df, [period], features).where("feature_value IS NOT NULL").groupBy(
            period, "feature_name", "feature_value"
        ).agg(F.count(F.lit(1)).alias("c"))
        # Value counts, not rows, are copied to the folds.
        uses = F.array_compact(F.array(*[F.when(F.col(period) < f, F.lit(int(f))) for f in folds]))
        copies = counts.withColumn("fold", F.explode(uses))
        found = exact_quantiles(copies, ["fold", "feature_name"], "feature_value", {"m": 0.5}, weight="c")
        medians = {(r["fold"], r["feature_name"]): r["m"] for r in found.collect()}
    out = {}
    for fold in folds:
        rows = [r for r in table if r["p"] is not None and r["p"] < fold]
        if not rows:
            raise ValueError(f"fold {fold} has no earlier period")
        n = float(sum(r["n"] for r in rows))
        k, s, q = (np.sum([r[c] for r in rows], axis=0, dtype="float64") for c in ("k", "s", "q"))
        fill = np.array([medians.get((int(fold), f), 0.0) for f in features])
        gap = n - k
        mean = (s + gap * fill) / n
        sd = _safe_sd((q + gap * fill * fill) / n - mean * mean)
        out[int(fold)] = (n, fill, mean, sd)
    return out


def fit_logistic(
    df: DataFrame,
    period: str,
    folds: Sequence[int],
    candidates: Sequence[Candidate],
    cs: Sequence[float],
    target: str,
    iterations: int = 30,
    tolerance: float = 1e-9,
) -> list[Fit]:
    """M2 / M7: minimise C * log loss + |w|^2 / 2 for every fold, candidate and C.

    Missing features take the training median; features are standardised; the
    intercept is free.  One pass over the rows per Newton step serves all
    models.
    """
    features = _all_features(candidates)
    data = df.where(F.col(target).isNotNull()).select(
        F.col(period).cast("long").alias("__p"), F.col(target).cast("double").alias("__y"),
        *[F.col(f).cast("double").alias(f) for f in features],
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        scale = _training_scale(data, "__p", folds, features)
        models = [
            (int(fold), c, float(reg), np.array([features.index(f) for f in c.features]))
            for fold in folds for c in candidates for reg in cs
        ]
        weights = [np.zeros(len(k) + 1) for *_, k in models]
        steps: list[np.ndarray | None] = [None] * len(models)
        losses = [np.inf] * len(models)
        done = [False] * len(models)
        for _ in range(iterations):
            live = [i for i, d in enumerate(done) if not d]
            if not live:
                break
            sums = _newton_sums(data, features, scale, models, weights, live)
            for i in live:
                _, _, reg, k = models[i]
                size = len(k) + 1
                flat = sums[i]
                penalty = np.r_[0.0, np.ones(size - 1)]
                loss = reg * flat[0] + 0.5 * float(np.sum((penalty * weights[i]) ** 2))
                if loss > losses[i] + 1e-12 * abs(losses[i]) and steps[i] is not None and np.max(np.abs(steps[i])) > tolerance:
                    # Overshoot: go back half of the last step.
                    steps[i] = steps[i] / 2.0
                    weights[i] = weights[i] - steps[i]
                    continue
                losses[i] = loss
                gradient = reg * flat[1 : size + 1] + penalty * weights[i]
                curvature = reg * flat[size + 1 :].reshape(size, size) + np.diag(penalty)
                step = -np.linalg.lstsq(curvature, gradient, rcond=None)[0]
                weights[i], steps[i] = weights[i] + step, step
                done[i] = bool(np.max(np.abs(step)) < tolerance)
    finally:
        data.unpersist()
    fits = []
    for (fold, c, reg, k), w in zip(models, weights):
        _, fill, mean, sd = scale[fold]
        fits.append(Fit(c.name, reg, fold, c.features, float(w[0]), tuple(w[1:]), tuple(mean[k]), tuple(sd[k]), tuple(fill[k])))
    return fits


def _newton_sums(data, features, scale, models, weights, live) -> dict[int, np.ndarray]:
    """Loss, gradient and curvature sums of the live models, in one pass."""
    plan = [(i, models[i][0], models[i][3], weights[i]) for i in live]
    # Models of one fold and candidate differ in weights alone: their rows are standardised once and worked as one matrix.
    alike: dict[int, dict[tuple, list[int]]] = {}
    for i, fold, k, _ in plan:
        alike.setdefault(fold, {}).setdefault(tuple(k), []).append(i)

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {i: np.zeros(1 + len(w) + len(w) ** 2) for i, _, _, w in plan}
        for batch in batches:
            periods, y = batch["__p"].to_numpy(), batch["__y"].to_numpy()
            raw = batch[features].to_numpy(dtype="float64")
            for fold, candidates in alike.items():
                _, fill, mean, sd = scale[fold]
                use = periods < fold
                x, t = raw[use], y[use]
                z = (np.where(np.isnan(x), fill, x) - mean) / sd
                for k, members in candidates.items():
                    a = np.column_stack([np.ones(len(z)), z[:, list(k)]])
                    size = a.shape[1]
                    products = (a[:, :, None] * a[:, None, :]).reshape(len(a), size * size)
                    w = np.column_stack([weights[i] for i in members])
                    eta = a @ w
                    e = np.exp(-np.abs(eta))
                    p = np.where(eta >= 0, 1.0, e) / (1.0 + e)
                    loss = np.sum(np.maximum(eta, 0.0) + np.log1p(e), axis=0) - (t @ a) @ w
                    slope = a.T @ (p - t[:, None])
                    curve = products.T @ (p * (1.0 - p))
                    for c, i in enumerate(members):
                        sums[i] += np.r_[loss[c], slope[:, c], curve[:, c]]
        yield pd.DataFrame({
            "model": np.repeat(list(sums), [len(v) for v in sums.values()]), "pos": np.concatenate([np.arange(len(v)) for v in sums.values()]),
            "value": np.concatenate(list(sums.values())),
        })

    rows = data.mapInPandas(partials, "model long, pos long, value double").groupBy("model", "pos").agg(
        F.sum("value").alias("value")
    ).collect()  # models x (features + 1)^2
    out = {i: np.zeros(1 + len(w) + len(w) ** 2) for i, _, _, w in plan}
    for r in rows:
        out[r["model"]][r["pos"]] = r["value"]
    return out


# -- prediction and back-tests -----------------------------------------------------------

def prediction(fits: Sequence[Fit], period: str, logistic: bool = False) -> Column:
    """Out-of-fold prediction: each validation period uses its own fold's model."""
    out = F.when(F.lit(False), F.lit(0.0))
    for fit in fits:
        score = inverse_logit(fit.score()) if logistic else fit.score()
        out = out.when(F.col(period) == fit.fold, score)
    return out


def _groups(fits: Sequence[Fit]) -> dict[tuple[str, float], list[Fit]]:
    out: dict[tuple[str, float], list[Fit]] = {}
    for fit in fits:
        out.setdefault((fit.candidate, fit.setting), []).append(fit)
    return out


def models_table(spark: SparkSession, fits: Sequence[Fit], features: Sequence[str]) -> DataFrame:
    """One row per model: candidate, setting, fold, intercept, terms (weight, mean, sd, fill per feature), train_mean.

    A feature that a candidate leaves out weighs nothing; a model that fills
    nothing gives null where one of its features is null.
    """
    rows = []
    for f in fits:
        fills = f.fill or (None,) * len(f.features)
        parts = dict(zip(f.features, zip(f.weights, f.means, f.sds, fills)))
        terms = [[None if v is None else float(v) for v in parts.get(name, (0.0, 0.0, 1.0, 0.0))] for name in features]
        rows.append((f.candidate, float(f.setting), int(f.fold), float(f.intercept), terms, float(f.train_mean)))
    return spark.createDataFrame(
        rows, "candidate string, setting double, fold long, intercept double, terms array<array<double>>, train_mean double"
    )


def _scored(df: DataFrame, fits: Sequence[Fit], period: str, logistic: bool) -> DataFrame:
    """Rows of the validation periods beside every model of their fold, with its prediction.

    Models are a table joined by fold, not expressions of the plan, so the plan
    does not grow with them; there are periods x candidates x settings of them.
    """
    features = list(dict.fromkeys(f for fit in fits for f in fit.features))
    models = models_table(df.sparkSession, fits, features)
    rows = df.withColumn("__fold", F.col(period).cast("long")).join(
        F.broadcast(models.withColumnRenamed("fold", "__fold").withColumnRenamed("candidate", "__candidate").withColumnRenamed("setting", "__setting")),
        "__fold",
    )
    score = F.col("intercept")
    for i, name in enumerate(features):
        weight, mean, sd, fill = (F.get(F.get("terms", F.lit(i)), F.lit(k)) for k in range(4))
        x = F.coalesce(F.col(name).cast("double"), fill)
        # A weight of zero without a fill is a feature the model does not know.
        score = score + weight * (x - mean) / sd
    return rows.withColumn("__prediction", inverse_logit(score) if logistic else score)


def oof_predict(
    df: DataFrame, fits: Sequence[Fit], period: str, keep: Sequence[str], logistic: bool = False
) -> DataFrame:
    """M5: long (row, candidate, setting, prediction) for the validation periods."""
    return _scored(df, fits, period, logistic).select(
        *keep, F.col("__fold").alias("fold"), F.col("__candidate").alias("candidate"), F.col("__setting").alias("setting"),
        F.col("__prediction").alias("prediction"),
    )


def _score_wide(df, fits, period, measures, logistic):
    """All models' measures in one aggregate over the validation periods."""
    rows = _scored(df, fits, period, logistic)
    out = rows.groupBy(
        F.col("__candidate").alias("candidate"), F.col("__setting").alias("setting"), F.col("__fold").alias("fold")
    ).agg(*[m.alias(k) for k, m in measures(F.col("__prediction")).items()])
    return out


def backtest_ridge(
    df: DataFrame, fits: Sequence[Fit], period: str, target: str
) -> DataFrame:
    """M4: MAE, RMSE, bias and R^2 per candidate, alpha and fold, against the
    fold's training mean as a constant baseline."""
    y = F.col(target).cast("double")
    level = F.col("train_mean")

    def measures(p: Column) -> dict[str, Column]:
        e = p - y
        return {
            "n": F.count(F.lit(1)), "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "bias": F.avg(e),
            "r2": F.lit(1.0) - F.avg(e * e) / F.nullif(F.var_pop(y), F.lit(0.0)),
            "baseline_mae": F.avg(F.abs(level - y)),
        }

    return _score_wide(df, fits, period, measures, False)


def backtest_logistic(
    df: DataFrame, fits: Sequence[Fit], period: str, target: str, epsilon: float = 1e-6
) -> DataFrame:
    """M7: Brier, log loss and accuracy per candidate, C and fold."""
    from .aggregates import log_loss

    y = F.col(target).cast("double")

    def measures(p: Column) -> dict[str, Column]:
        return {
            "n": F.count(F.lit(1)), "brier": F.avg((p - y) * (p - y)), "log_loss": F.avg(log_loss(p, y, epsilon)),
            "accuracy": F.avg(((p >= 0.5) == (y == 1.0)).cast("double")),
        }

    return _score_wide(df, fits, period, measures, True)


def pooled(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Fold results weighted by rows, with the worst fold and its spread."""
    return weighted_summary(results, ["candidate", "setting"], "n", list(metrics))


def ablation(features: Sequence[str]) -> list[Candidate]:
    """M7: the full set and every set with one feature left out."""
    full = tuple(features)
    return [Candidate("full", full)] + [
        Candidate(f"without_{f}", tuple(g for g in full if g != f)) for f in full
    ]


def oof_residuals(
    df: DataFrame, fits: Sequence[Fit], period: str, target: str, keep: Sequence[str]
) -> DataFrame:
    """M6: actual minus out-of-fold prediction; the bank behind offer pricing."""
    rows = oof_predict(df, fits, period, list(dict.fromkeys([*keep, target])))
    return rows.withColumn("residual", F.col(target) - F.col("prediction"))


def coefficients(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    """Standardised coefficients by candidate, setting and fold (long)."""
    rows = [
        (f.candidate, f.setting, f.fold, name, float(w), float(m), float(s))
        for f in fits for name, w, m, s in zip(f.features, f.weights, f.means, f.sds)
    ]
    return spark.createDataFrame(
        rows, "candidate string, setting double, fold long, feature_name string, coefficient double, train_mean double, train_sd double"
    )


def evaluate_holdout(
    df: DataFrame,
    split: str,
    holdout: str,
    primary: Candidate,
    fallback: Candidate,
    target: str,
    keep: Sequence[str],
    alpha: float | None = None,
    c: float | None = None,
) -> DataFrame:
    """Fit on all rows outside the holdout, score the holdout once.

    A row with all primary features uses the primary model, else the fallback.
    Give ``alpha`` for ridge or ``c`` for logistic regression.
    """
    from functools import reduce

    from fieldglass.functions.scalars import route_fallback

    def complete(candidate: Candidate) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in candidate.features])

    rows = df.withColumn("__period", F.when(F.col(split) == holdout, 1).otherwise(0))
    fits = []
    for candidate in (primary, fallback):
        train = rows.where(complete(candidate) & F.col(target).isNotNull())
        fits += (
            fit_ridge(train, "__period", [1], [candidate], [alpha], target)
            if alpha is not None
            else fit_logistic(train, "__period", [1], [candidate], [c], target)
        )
    scores = [f.score() if alpha is not None else inverse_logit(f.score()) for f in fits]
    scored = rows.where("__period = 1")
    routed = route_fallback(scored, complete(primary), scores[0], F.when(complete(fallback), scores[1]))
    return routed.select(*keep, target, "prediction", "prediction_mode", "route_reason")


# -- MLlib models -----------------------------------------------------------------------------

def gbt_time_cv(
    df: DataFrame, period: str, folds: Sequence[int], features: Sequence[str], target: str,
    iterations: int = 20, depth: int = 3, step: float = 0.1, seed: int = 42,
) -> DataFrame:
    """M8: boosted trees fitted on earlier periods and scored on each fold."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from .aggregates import probability_metrics

    filled = [f"__f_{f}" for f in features]
    imputer = Imputer(strategy="median", inputCols=list(features), outputCols=filled)
    assembler = VectorAssembler(inputCols=filled, outputCol="__x")
    gbt = GBTClassifier(
        featuresCol="__x", labelCol="__y", maxIter=iterations, maxDepth=depth, stepSize=step, seed=seed, maxBins=64
    )
    data = df.select(
        F.col(period).cast("long").alias("fold"), F.col(target).cast("double").alias("__y"),
        *[F.col(f).cast("double").alias(f) for f in features],
    ).where("__y IS NOT NULL")
    out = None
    for fold in folds:
        train = data.where(F.col("fold") < fold)
        fill = imputer.fit(train)
        model = gbt.fit(assembler.transform(fill.transform(train)))
        scored = model.transform(assembler.transform(fill.transform(data.where(F.col("fold") == fold))))
        rows = scored.select("fold", "__y", vector_to_array("probability")[1].alias("p"))
        out = rows if out is None else out.unionByName(rows)
    return probability_metrics(out, "fold", "p", "__y", 1e-6)


def fit_calibrators(oof: DataFrame, p: str, y: str):
    """M9: sigmoid (on the log-odds) and isotonic maps of a raw probability.

    Equal probabilities are merged with their counts first; weighted fits on the
    merged points equal fits on the rows.  Returns a function adding the columns
    ``sigmoid`` and ``isotonic``.
    """
    from .isotonic import apply_isotonic, fit_isotonic

    raw = F.col(p).cast("double")
    points = oof.where(raw.isNotNull() & F.col(y).isNotNull()).groupBy(
        raw.alias("__p"), F.col(y).cast("double").alias("__y")
    ).agg(F.count(F.lit(1)).cast("double").alias("__w"))
    intercept, slope = fit_sigmoid(points.withColumn("__l", logit(F.col("__p"))), "__l", "__y", "__w")
    blocks = fit_isotonic(points, "__p", "__y", "__w")

    def apply(df: DataFrame) -> DataFrame:
        scored = df.withColumn("sigmoid", inverse_logit(F.lit(intercept) + F.lit(slope) * logit(raw)))
        return apply_isotonic(scored, p, blocks)

    return apply


def fit_sigmoid(
    points: DataFrame, x: str, y: str, weight: str, penalty: float = 1e-6, iterations: int = 50, tolerance: float = 1e-10
) -> tuple[float, float]:
    """Intercept and slope of a weighted logistic line: Newton steps, each one aggregate of five sums.

    The small penalty on the slope keeps it finite where the classes separate.
    A step that raises the loss is halved; without convergence a warning is given.
    """
    a, b = 0.0, 0.0
    step, best = (0.0, 0.0), math.inf
    for _ in range(iterations):
        score = F.lit(a) + F.lit(b) * F.col(x)
        chance = inverse_logit(score)
        slack, spread = F.col(weight) * (chance - F.col(y)), F.col(weight) * chance * (1 - chance)
        loss = F.col(weight) * (F.greatest(score, F.lit(0.0)) + F.log1p(F.exp(-F.abs(score))) - F.col(y) * score)
        row = points.agg(
            F.sum(loss), F.sum(slack), F.sum(slack * F.col(x)), F.sum(spread), F.sum(spread * F.col(x)),
            F.sum(spread * F.col(x) * F.col(x)),
        ).first()
        if row[0] is None:
            raise ValueError("no row to fit the sigmoid on")
        total = row[0] + penalty * b * b / 2
        if total > best + 1e-12 * abs(best) and max(abs(step[0]), abs(step[1])) > tolerance:
            step = (step[0] / 2, step[1] / 2)
            a, b = a - step[0], b - step[1]
            continue
        best = total
        g0, g1 = row[1], row[2] + penalty * b
        h00, h01, h11 = row[3] + penalty, row[4], row[5] + penalty
        det = h00 * h11 - h01 * h01
        step = (-(h11 * g0 - h01 * g1) / det, -(h00 * g1 - h01 * g0) / det)
        a, b = a + step[0], b + step[1]
        if max(abs(step[0]), abs(step[1])) < tolerance:
            return a, b
    warnings.warn(f"the sigmoid did not settle in {iterations} steps", RuntimeWarning, stacklevel=2)
    return a, b


# -- governance --------------------------------------------------------------------------------

def governance_report(
    season_results: DataFrame, baseline: str, blend_results: DataFrame | None = None, registry: Mapping[str, str] | None = None
) -> dict[str, DataFrame]:
    """Scorecard with improvements over the baseline, fold results, blend grid, registry."""
    from .aggregates import versus_baseline
    from .windows import rank_summary

    card = weighted_summary(season_results, "candidate", "n", ["brier", "log_loss", "accuracy"])
    card = versus_baseline(card, "candidate", baseline, ["weighted_brier", "weighted_log_loss"])
    card = card.withColumn("score", -F.col("weighted_brier"))
    card = rank_summary(card, "score", "scorecard_rank", ["weighted_log_loss", "worst_brier", "candidate"]).drop("score")
    frames = {"scorecard": card, "season_results": season_results}
    if blend_results is not None:
        frames["blend_grid"] = blend_results
    if registry:
        frames["registry"] = season_results.sparkSession.createDataFrame(list(registry.items()), "candidate string, role string")
    return frames
