"""Contract queries: a Spark plan and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.session import load

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the driver's tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)


def query(name: str, oracle: str | None = None):
    """Register ``build(tables) -> DataFrame`` under a contract name."""

    def wrap(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return wrap


def cents(column: str) -> Column:
    """A price as whole cents: sums do not depend on their order."""
    return F.round(F.col(column) * 100).cast("long")


def rounded(column: str | Column, digits: int = 6) -> Column:
    """Rounded value; adding zero turns a negative zero into zero."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits) + F.lit(0.0)
