"""Data-quality gates (Q1-Q5) and table profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import names


class QualityError(RuntimeError):
    """A table broke its contract; the message lists the counts."""


@dataclass(frozen=True)
class Rules:
    """What a table must satisfy.

    ``rows`` maps a check name to a condition that marks a *bad* row.  All row
    rules are counted by one aggregate; keys by a second; each reference by an
    anti join.
    """

    columns: Sequence[str] = ()
    rows: Mapping[str, Column] = field(default_factory=dict)
    key: Sequence[str] = ()
    references: Mapping[str, tuple[DataFrame, Sequence[str]]] = field(default_factory=dict)
    row_count: int | None = None
    not_empty: bool = True
    sums_to_one: tuple[Sequence[str], str] | None = None
    severity: Mapping[str, str] = field(default_factory=dict)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail early, at plan time, on a missing column."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise QualityError("missing columns: " + ", ".join(missing))
    return df


def row_checks(df: DataFrame, rules: Mapping[str, Column], **counts: Column) -> DataFrame:
    """One pass over the table, one output row per rule.

    ``rules`` mark bad rows; ``counts`` are further aggregates that give an
    issue count directly.
    """
    wide = df.agg(
        *[F.count(F.when(bad, 1)).alias(name) for name, bad in rules.items()],
        *[c.cast("long").alias(name) for name, c in counts.items()],
    )
    items = F.array(*[
        F.struct(F.lit(n).alias("check_name"), F.col(n).cast("long").alias("issue_count")) for n in [*rules, *counts]
    ])
    return wide.select(F.explode(items).alias("__i")).select("__i.check_name", "__i.issue_count")


def key_check(df: DataFrame, key: str | Sequence[str], name: str = "duplicate_keys") -> DataFrame:
    """Number of keys held by more than one row."""
    dup = df.groupBy(*names(key)).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return dup.agg(F.count(F.lit(1)).alias("issue_count")).select(F.lit(name).alias("check_name"), "issue_count")


def reference_check(df: DataFrame, other: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Rows whose non-null key is absent from the referenced table."""
    present = other.select(*on).distinct()
    keyed = df.select(*on).dropna(subset=list(on))
    return keyed.join(present, list(on), "left_anti").agg(F.count(F.lit(1)).alias("issue_count")).select(
        F.lit(name).alias("check_name"), "issue_count"
    )


def sum_check(df: DataFrame, by: Sequence[str], value: str, name: str, tolerance: float = 1e-6) -> DataFrame:
    """Q5: groups whose shares do not add to one."""
    sums = df.groupBy(*by).agg(F.sum(value).alias("__s"))
    return sums.where(F.abs(F.col("__s") - 1.0) > tolerance).agg(F.count(F.lit(1)).alias("issue_count")).select(
        F.lit(name).alias("check_name"), "issue_count"
    )


def quality_report(df: DataFrame, rules: Rules) -> DataFrame:
    """Q2 / Q3: ``(check_name, issue_count, severity, status)`` rows."""
    require_columns(df, rules.columns)
    counts = {}
    if rules.not_empty or rules.row_count is not None:
        n = F.count(F.lit(1))
        counts["row_count"] = (n == 0) if rules.row_count is None else (n != rules.row_count)
    parts = []
    if rules.rows or counts:
        parts.append(row_checks(df, rules.rows, **counts))
    if rules.key:
        parts.append(key_check(df, rules.key))
    for name, (other, on) in rules.references.items():
        parts.append(reference_check(df, other, on, name))
    if rules.sums_to_one:
        parts.append(sum_check(df, *rules.sums_to_one, name="sum_to_one"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    severity = F.lit("error")
    for name, level in rules.severity.items():
        severity = F.when(F.col("check_name") == name, level).otherwise(severity)
    return out.withColumn("severity", severity).withColumn(
        "status", F.when(F.col("issue_count") == 0, "PASS").otherwise("FAIL")
    )


def expect(df: DataFrame, rules: Rules) -> None:
    """Q1: raise with counts if an error-level check fails (one small collect)."""
    failed = [
        f"{r.check_name}={r.issue_count}"
        for r in quality_report(df, rules).where("status = 'FAIL' AND severity = 'error'").collect()
    ]
    if failed:
        raise QualityError("quality checks failed: " + ", ".join(sorted(failed)))


def recompute_check(
    stored: DataFrame, rebuilt: DataFrame, on: Sequence[str], columns: Sequence[str], tolerance: float = 1e-6
) -> DataFrame:
    """Q4: mismatches between a stored column and its rebuilt value, per column."""
    a = stored.select(*on, *[F.col(c).alias(f"__s_{c}") for c in columns])
    b = rebuilt.select(*on, *[F.col(c).alias(f"__r_{c}") for c in columns])
    joined = a.join(b, list(on), "full_outer")
    rules = {}
    for c in columns:
        s, r = F.col(f"__s_{c}"), F.col(f"__r_{c}")
        rules[c] = (s.isNull() != r.isNull()) | F.coalesce(F.abs(s - r) > tolerance, F.lit(False))
    return row_checks(joined, rules)


def profile_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row, null and distinct counts with text minimum and maximum per column.

    Null counts and ranges share one aggregate.  Distinct counts are taken from
    (column, value) pairs grouped map-side, so no per-column distinct expansion.
    """
    columns = list(columns or df.columns)
    items = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns
    ])
    pairs = df.select(F.explode(items).alias("__i")).select("__i.column_name", "__i.v")
    per_value = pairs.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("__c"))
    return per_value.groupBy("column_name").agg(
        F.sum("__c").alias("row_count"),
        F.sum(F.when(F.col("v").isNull(), F.col("__c")).otherwise(0)).alias("null_count"),
        F.count("v").alias("distinct_count"),
        F.min("v").alias("min_text"),
        F.max("v").alias("max_text"),
    )


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, distinct_error: float | None = None) -> DataFrame:
    """One row per column: type, rows, nulls, typed bounds and, if asked for, an approximate distinct count.

    Bounds keep their type: ``min_number`` and ``max_number`` for numbers and
    booleans, ``min_time`` and ``max_time`` for dates and times, ``min_text`` and
    ``max_text`` for text; columns of other types have none.  All columns share one
    aggregate of one row per task, so nothing but that row is shuffled.
    ``distinct_error`` is the relative standard deviation of the sketch.  An empty
    table has zero rows and null bounds.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)

    def bounds(name: str) -> list[Column]:
        kind, column = types[name], F.col(name)
        number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or kind.startswith("decimal")
        moment = kind in ("date", "timestamp", "timestamp_ntz")
        as_number = column.cast("int").cast("double") if kind == "boolean" else column.cast("double") if number else None
        as_time = column.cast("timestamp_ntz") if moment else None
        out = []
        for label, value, cast in (("number", as_number, "double"), ("time", as_time, "timestamp_ntz"), ("text", column if kind == "string" else None, "string")):
            for side, pick in (("min", F.min), ("max", F.max)):
                out.append((F.lit(None).cast(cast) if value is None else pick(value)).alias(f"{side}_{label}"))
        return out

    def summary(name: str) -> Column:
        sketch = F.approx_count_distinct(name, distinct_error) if distinct_error else F.lit(None).cast("long")
        return F.struct(
            F.lit(name).alias("column_name"), F.lit(types[name]).alias("data_type"), F.count(F.lit(1)).alias("row_count"),
            F.count(F.when(F.col(name).isNull(), 1)).alias("null_count"), *bounds(name), sketch.alias("approximate_distinct"),
        )

    wide = df.agg(F.array(*[summary(c) for c in columns]).alias("__c"))
    return wide.select(F.inline("__c"))


def profile_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, keys held by several rows, rows beyond the first of their key, rows with a null key.

    Counted per key first (map-side combined), so a hot key is one row a task.
    """
    key = names(key)
    nulls = F.lit(False)
    for k in key:
        nulls = nulls | F.col(k).isNull()
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).withColumn("__null", nulls)
    return counts.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("key_count"),
        F.count(F.when(F.col("__n") > 1, 1)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(F.col("__null"), F.col("__n"))), F.lit(0)).alias("null_key_rows"),
    )
