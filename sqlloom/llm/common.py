"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlloom.session import scratch_dir

# Words of the corpus operators: runs of anything but ASCII white space, [^\x20\x09-\x0D]+.
# bytes.split() without an argument cuts at exactly these characters.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).withMetadata(df.columns[0], {"path": path})


def reread(df: DataFrame) -> DataFrame:
    """A table made by ``stored`` once more, with columns of its own, to meet itself in a cogroup."""
    return df.sparkSession.read.schema(df.schema).parquet(df.schema[0].metadata["path"])


def discard(df: DataFrame) -> None:
    """Remove a table made by ``stored`` that no later step reads."""
    spark = df.sparkSession
    path = df.schema[0].metadata["path"]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def utf8(value: str | None) -> bytes:
    """UTF-8 of a text; null is the empty text."""
    return b"" if value is None else value.encode("utf-8", "replace")


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the identifier's decimal text falls on the remainder; a null identifier does not."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def numbered_rows(df: DataFrame) -> DataFrame:
    """Adds ``id``, 1 to the number of rows of a stored table; the driver sees one number for each of its partitions."""
    at = F.monotonically_increasing_id()
    part, place = F.shiftright(at, 33).alias("_part"), (at.bitwiseAND((1 << 33) - 1)).alias("_place")
    rows = df.select("*", part, place)
    before = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).selectExpr(
        "_part", "coalesce(sum(_n) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before")
    return rows.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_place") + 1).alias("id"))
