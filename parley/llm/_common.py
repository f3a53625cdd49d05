"""Column access that extra columns cannot disturb, and what the rest of the library shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.shared import HEAVY, drop, materialize, salted_join, scratch, spread_join, swept  # noqa: F401

#: The white space that separates words in every contract of this folder: space, tab, LF, VT, FF, CR.
SPACE = " \t\n\x0b\x0c\r"


def q(name: str) -> Column:
    """The column called exactly `name`, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str) -> DataFrame:
    """Only the columns an operator works on, under its own names, so that extra columns cannot clash."""
    return docs.select(q(id_col).alias("doc_id"), q(text_col).alias("text"), *(q(c).alias(n) for n, c in more.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most: int = 1000, size: str = "4m") -> None:
    """Let Arrow batches have `most` rows and `size` bytes at most: a row here is a whole text, and a worker holds a batch
    at once. The session keeps this, since plans read it when they run, after the operator is done."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, str(most))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def row_key(text: Column) -> Column:
    """Tells apart rows that repeat an id with another text."""
    return F.xxhash64(text)
