"""What the two classifiers share: held-out rows and labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo a number of parts; null ids give null."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(parts))


def labelled(labels: DataFrame, label: str, parts: int, held: int) -> DataFrame:
    """Rows to learn from: doc_id and y (0 or 1), one per id, without the held-out part.

    Ids or labels that are null, and labels other than 0 and 1, teach nothing; an
    id labelled twice counts as 1 if any of its rows does.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (remainder(F.col("doc_id"), parts) != held))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))
