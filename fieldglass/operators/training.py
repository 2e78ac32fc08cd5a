"""Training frames that cannot see the holdout."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import QualityError, require_columns
from .skew import join_lookup


class HoldoutError(QualityError):
    """A training plan that could read the holdout."""


def _nodes(plan) -> Iterator:
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _excludes(frame: DataFrame, condition, column: str, value: str) -> bool:
    """Whether a condition on one column folds to an empty relation for a value; nothing is run."""
    one = frame.sparkSession.range(1).select(F.lit(value).alias(column)).where(condition.sql())
    return one._jdf.queryExecution().optimizedPlan().toString().startswith("LocalRelation <empty>")


def locked(frame: DataFrame, column: str, holdout: Sequence[str]) -> DataFrame:
    """The frame itself if no scan in its plan can yield a holdout row; else HoldoutError, before a row is read.

    ``column`` is the split's name in the files.  Every scan that reads it must
    carry a pushed filter on this column alone that is false for each value of
    ``holdout``.  A plan in which no scan reads the column proves nothing and is
    refused too; so is one that reads it from anything but files.
    """
    scans = guarded = 0
    for node in _nodes(frame._jdf.queryExecution().sparkPlan()):
        if not node.children().isEmpty():
            continue
        names = [node.output().apply(i).name() for i in range(node.output().size())]
        if column in names:
            scans += 1
            if node.getClass().getSimpleName() == "FileSourceScanExec":
                filters = [*_items(node.dataFilters()), *_items(node.partitionFilters())]
                alone = [f for f in filters if f.references().size() == 1 and f.references().head().name() == column]
                guarded += all(any(_excludes(frame, f, column, value) for f in alone) for value in holdout)
    if not scans or guarded < scans:
        raise HoldoutError(f"the plan does not keep {column} in {list(holdout)} out of its scans")
    return frame


def training_frame(
    dataset: DataFrame, splits: DataFrame, key: str, target: str, features: Sequence[str], split: str = "split_name",
    development: Sequence[str] = ("train", "validation"), holdout: Sequence[str] = ("holdout",),
    eligible: str | None = "is_core_model_eligible", extra: DataFrame | None = None, extra_columns: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Key, ``keep``, split, target and features of the development rows, optionally with an external table.

    Only splits named in ``development`` and rows marked ``eligible`` are
    selected, and ``locked`` refuses the plan unless the scan of the splits keeps
    the holdout out.  A development row without target fails the query when it is
    reached.  ``extra`` (one row per key) is joined on the left: rows it does not
    know stay, with nulls.
    """
    require_columns(dataset, [key, target, *features, *keep])
    if set(development) & set(holdout):
        raise HoldoutError("a split is both development and holdout")
    chosen = splits.where(F.col(split).isin(*development))
    if eligible is not None:
        chosen = chosen.where(F.col(eligible))
    chosen = locked(chosen.select(key, split), split, holdout)
    known = F.when(F.col(target).isNull(), F.raise_error(F.lit("development row without target"))).otherwise(F.col(target))
    columns = list(dict.fromkeys([key, *keep, *features]))
    rows = dataset.select(*columns, target).join(chosen, key).withColumn(target, known)
    if extra is not None:
        rows = join_lookup(rows, extra.select(key, *extra_columns), key, "left")
    return locked(rows.select(key, *[c for c in columns if c != key], split, target, *extra_columns), split, holdout)
