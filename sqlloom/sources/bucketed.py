"""Tables kept in buckets of their join key, so that a round shuffles its new rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 200


def append(df: DataFrame, table: str, key: str, buckets: int = BUCKETS, path: str | None = None) -> None:
    """Add rows to ``table``, which is made at first use, in ``buckets`` buckets of ``key``.

    The new rows are dealt by the key first, so each append adds one sorted file a bucket.  Joins and groupings of
    tables with the same key and number of buckets need no shuffle.  ``path`` puts a new table outside the warehouse.
    Keys are expected to be nearly unique (a question, a prompt): all rows of one key are in one bucket.
    """
    out = df.repartition(buckets, key).write.mode("append").bucketBy(buckets, key).sortBy(key)
    if path and not df.sparkSession.catalog.tableExists(table):
        out = out.option("path", path)
    out.saveAsTable(table)


def append_new(df: DataFrame, table: str, key: str, buckets: int = BUCKETS, path: str | None = None) -> None:
    """Add the rows whose key the table does not hold yet; run again, it adds nothing.

    A null key never equals a stored one, so such rows are added each time.  The stored side is not shuffled.
    """
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        stored = spark.table(table).select(F.col(key).alias("_stored"))
        df = df.join(stored.hint("merge"), F.col(key) == F.col("_stored"), "left_anti")
    append(df, table, key, buckets, path)


def compact(spark: SparkSession, table: str, target: str, key: str, buckets: int = BUCKETS, path: str | None = None) -> None:
    """The rows of ``table`` as a new table with one file a bucket; many appends leave many files a bucket, which are sorted when read."""
    append(spark.table(table), target, key, buckets, path)
