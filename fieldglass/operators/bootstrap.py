"""Bootstrap interval of a mean."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import names

#: Blocks that rows are dealt to by key; a block is drawn as a whole.
BLOCKS = 1000
#: Tasks that the (block, replicate) pairs are spread over.
SPREAD = 64
#: Values are added as whole numbers of this many decimals.
DIGITS = 9
_HEX = 8


def poisson_thresholds() -> list[int]:
    """Where a 32-bit number passes the cumulative chances of 0, 1, 2, ... draws at mean 1."""
    total, out = 0.0, []
    for k in range(13):
        total += math.exp(-1.0) / math.factorial(k)
        out.append(math.floor(total * 2 ** (4 * _HEX)))
    return out


def hashed(text: Column) -> Column:
    """The first 32 bits of a text's MD5, as every engine computes them."""
    return F.conv(F.substring(F.md5(text), 1, _HEX), 16, 10).cast("long")


def bootstrap_mean(
    df: DataFrame, by: str | Sequence[str], value: str, key: str, replicates: int = 10_000, seed: int = 7,
    low: float = 0.025, high: float = 0.975, blocks: int = BLOCKS,
) -> DataFrame:
    """Percentile interval of each group's mean from Poisson resampling of blocks.

    Columns: by, n, mean, ci_low, ci_high.  Rows are dealt to blocks by the hash
    of ``key`` (null keys share one), each block is reduced to its count and sum,
    and every (block, replicate) draws a Poisson weight from a hash.  Sums are of
    whole numbers, so neither partitioning nor row order can change a digit, and
    the work beyond one map-side combined pass does not grow with the rows.  With
    fewer rows than blocks nearly every row is a block of its own.

    Rows without a value are left out; a group without values has no row.
    """
    by = names(by)
    rows = df.where(F.col(value).isNotNull()).select(
        *by, (hashed(F.coalesce(F.col(key).cast("string"), F.lit(""))) % blocks).alias("__b"),
        F.round(F.col(value).cast("double") * 10**DIGITS).cast("decimal(20,0)").alias("__x"),
    )
    sums = rows.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"), F.sum("__x").alias("__s"))
    number = hashed(F.concat_ws(":", F.col("__b").cast("string"), F.col("__r").cast("string"), F.lit(str(seed))))
    weight = sum((F.when(number >= t, 1).otherwise(0) for t in poisson_thresholds()), F.lit(0))
    drawn = sums.repartition(SPREAD, "__b").select(
        *by, "__b", "__n", "__s", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("__r")
    ).withColumn("__w", weight.cast("long"))
    means = drawn.groupBy(*by, "__r").agg(
        F.sum(F.col("__w") * F.col("__n")).alias("__wn"), F.sum(F.col("__w").cast("decimal(4,0)") * F.col("__s").cast("decimal(30,0)")).alias("__ws")
    ).withColumn("m", F.col("__ws").cast("double") / F.nullif(F.col("__wn"), F.lit(0)) / 10**DIGITS)
    # A group now has exactly ``replicates`` rows.
    interval = means.groupBy(*by).agg(
        F.percentile("m", F.lit(low)).alias("ci_low"), F.percentile("m", F.lit(high)).alias("ci_high")
    )
    point = sums.groupBy(*by).agg(
        F.sum("__n").alias("n"), (F.sum("__s").cast("double") / F.sum("__n") / 10**DIGITS).alias("mean")
    )
    if not by:
        return point.select("n", "mean", *[interval.select(c).scalar().alias(c) for c in ("ci_low", "ci_high")]).where("n > 0")
    # Null-safe, so that the null group keeps its interval.
    side = interval.select(*[F.col(k).alias(f"__k_{k}") for k in by], "ci_low", "ci_high")
    same = F.lit(True)
    for k in by:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return point.join(side, same).select(*by, "n", "mean", "ci_low", "ci_high")
