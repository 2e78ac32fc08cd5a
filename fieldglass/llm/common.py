"""What the corpus operators share: tables, landed intermediates, text columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldglass.session import shared_folder

#: White space of the text contracts: blank and U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write once to the folder all executors share and go on from there.

    The new plan starts at files, so a lost executor costs a reread and later
    joins are planned with measured sizes.  ``codec`` is zstd where whole texts
    are written.
    """
    spark = df.sparkSession
    location = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(location)
    out = spark.read.schema(df.schema).parquet(location)
    out._landed_at = location
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``landed`` wrote and that no later step reads."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame._landed_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id and text under fixed names; null texts become empty, other columns go."""
    return docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def words_of(text: Column) -> Column:
    """Words of a text as an array: what lies between white space."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """The rows of a documents table with another text and its length, in the table's own columns."""
    new = docs.withColumn("text", text)
    return new.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)
