"""Quality classifier: regularised quadratic discriminant over transformed text statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldglass.llm.common import landed, texts
from fieldglass.llm.fitting import labelled, remainder

PARTS, HELD_OUT = 3, 1
#: Share of the pooled covariance in each class covariance, and of a multiple of the identity in the result.
TOWARDS_POOLED = 0.05
TOWARDS_SPHERE = 0.02
#: Log-density differences are cut to this size before they become probabilities.
FARTHEST = 30.0

FEATURES = (
    "log_words", "log_word_length", "symbols", "capitals", "digits", "distinct_words", "stutter", "window_repeats",
    "line_repeats", "log_line_words", "sentence_ends", "bars", "marks", "other",
)
_KIND = np.zeros((256, 7), np.int64)
for _i, _set in enumerate(("#*$%&<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "|", ".,;:!?'\"()-", " \t\n\r\v\f")):
    _KIND[[ord(c) for c in _set], _i] = 1
_KIND[[*range(97, 123)], 6] = 1
_ENDS = frozenset(".!?…:;")
_CLOSERS = "\"'”»)]"


def _odds(part: float, whole: float) -> float:
    """Log odds of a share, smoothed so that nothing and everything stay finite."""
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str) -> list[float]:
    """Transformed statistics of one text; an empty text has those of no words."""
    words = text.split()
    count = len(words)
    symbols, capitals, digits, bars, marks, blanks, small = (
        np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256) @ _KIND
    ).tolist()
    chars = max(len(text) - blanks, 0)
    lines = [line for line in text.split("\n") if line.strip()]
    windows = max(count - 2, 0)
    repeats = windows - len(set(zip(words, words[1:], words[2:]))) if windows else 0
    other = max(chars - symbols - capitals - digits - bars - marks - small, 0)
    return [
        float(np.log1p(count)), float(np.log1p(chars / count)) if count else 0.0,
        _odds(symbols, max(chars, symbols)), _odds(capitals, capitals + small), _odds(digits, max(chars, digits)),
        float(np.log((len(set(words)) + 1) / (count + 1))), _odds(sum(map(eq, words, words[1:])), max(count - 1, 0)),
        _odds(repeats, windows), _odds(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(count / len(lines))) if lines else 0.0,
        _odds(sum(line.rstrip().rstrip(_CLOSERS)[-1:] in _ENDS for line in lines), len(lines)), _odds(bars, max(chars, bars)),
        _odds(marks, max(chars, marks)), _odds(other, max(chars, other)),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Class means, Cholesky factors of shrunk covariances, their log determinants and log priors."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    logdets: tuple[float, ...]
    priors: tuple[float, ...]

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        """Log prior plus log density of class k, but for a constant: half the Mahalanobis distance is a solve with the factor."""
        z = np.linalg.solve(self.factors[k], (x - self.means[k]).T)
        return self.priors[k] - 0.5 * (z * z).sum(0) - 0.5 * self.logdets[k]

    def score(self, features: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        x = (features - self.centre) / self.scale
        gap = np.clip(self.log_density(x, 1) - self.log_density(x, 0), -FARTHEST, FARTHEST)
        return 1 / (1 + np.exp(-gap))


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sums and sums of products of the features by class, from rows (y, x).

    Tasks add up their own rows; Spark adds the numbers, of which there are two
    times 1 + d + d x d.
    """
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if batch.num_rows:
                y = np.array(batch.column(0).to_pylist())
                x = np.array(batch.column(1).to_pylist(), float)
                for k in (0, 1):
                    own = x[y == k]
                    total[k] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], total.shape[1]), pa.int32()),
             pa.array(np.tile(np.arange(total.shape[1]), 2), pa.int32()), pa.array(total.ravel(), pa.float64())],
            names=["y", "i", "v"],
        )

    sums = np.zeros((2, 1 + d + d * d))
    for y, i, v in rows.select("y", "x").mapInArrow(run, "y int, i int, v double").groupBy("y", "i").agg(
        F.sum("v")
    ).collect():
        sums[y, i] = v
    return sums[:, 0], sums[:, 1:1 + d], sums[:, 1 + d:].reshape(2, d, d)


def fit(rows: DataFrame) -> Discriminant | float:
    """The discriminant; where one class has fewer than two rows, the share of class 1 instead (0.5 without rows)."""
    counts, sums, products = moments(rows)
    if counts.min() < 2:
        return float(counts[1] / counts.sum()) if counts.sum() else 0.5
    total = counts.sum()
    centre = sums.sum(0) / total
    scale = np.sqrt(np.maximum(products.sum(0).diagonal() / total - centre**2, 0))
    scale[scale < 1e-6] = 1.0
    means, scatter = [], []
    for k in (0, 1):
        mean = sums[k] / counts[k]
        means.append((mean - centre) / scale)
        scatter.append((products[k] / counts[k] - np.outer(mean, mean)) / np.outer(scale, scale))
    pooled = (counts[0] * scatter[0] + counts[1] * scatter[1]) / total
    factors, logdets = [], []
    for k in (0, 1):
        shrunk = (1 - TOWARDS_POOLED) * scatter[k] + TOWARDS_POOLED * pooled
        size = max(float(np.trace(shrunk)) / len(centre), 1e-6)
        shrunk = (1 - TOWARDS_SPHERE) * shrunk + TOWARDS_SPHERE * size * np.eye(len(centre))
        factors.append(np.linalg.cholesky(shrunk))
        logdets.append(2 * float(np.log(factors[-1].diagonal()).sum()))
    return Discriminant(
        centre, scale, tuple(means), tuple(factors), tuple(logdets), tuple(np.log(counts / total).tolist())
    )


def features(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, x) of (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "x"]
            )

    return docs.mapInArrow(run, f"doc_id {kind}, x array<double>")


def classify_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text_column: str = "text",
    parts: int = PARTS, held: int = HELD_OUT,
) -> DataFrame:
    """Score every whole text with a model learned from the labelled rows that are not held out.

    Columns: doc_id, held_out, score (probability of label 1), predicted, one row
    per row.  All labelled rows teach, through sums of products; the model is a
    few hundred numbers.  The texts are read once, their statistics written to
    the shared folder.

    Null texts count as empty; those are scored like others, by their statistics.
    Rows without an id are never held out and never taught.  Repeated rows are
    scored each; other columns are left out.  Without two rows of each class all
    scores are the share of class 1, and 0.5 without labels.
    """
    table = landed(features(texts(docs, id_column, text_column)), "statistics")
    model = fit(table.join(labelled(labels, label, parts, held), "doc_id"))
    kind = dict(table.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, float):
                found = np.full(batch.num_rows, model)
            else:
                x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
                found = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    scored = table.mapInArrow(run, f"doc_id {kind}, score double")
    held_out = F.coalesce(remainder(F.col("doc_id"), parts) == held, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
