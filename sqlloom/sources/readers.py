"""Sources, all with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlloom import schemas
from sqlloom.sources.csv_spans import read_csv
from sqlloom.sources.json_spans import read_records


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Nested catalog records of a JSON list or of lines, cut in parallel; display copies of the names are not read.

    What is no record is left out here; ``unreadable_records`` gives it.
    """
    return read_records(spark, path, schemas.RAW_CATALOG).where("rejected IS NULL").drop("rejected")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions under the names the prompt builder uses, from a JSON list or lines, cut in parallel."""
    return read_records(spark, path, schemas.QUESTIONS).where("rejected IS NULL").select(
        "question_id", F.col("db_id").alias("database"), "question", F.col("query").alias("sql"))


def unreadable_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``rejected``: the text of each part of JSON files that is not a record of the schema.

    ``read_records`` gives records and rejects in one scan.
    """
    return read_records(spark, path, schema).where("rejected IS NOT NULL").select("rejected")


def read_columnar_json(spark: SparkSession, path: str, columns: list[str] | T.StructType) -> DataFrame:
    """Column-oriented documents ``{column: {index: value}}`` to rows.

    One document per file; an index is unique within its document, and a
    document is one task, so large data should come as many documents.  The cells are
    brought together by (document, index), which needs no map look-ups.

    With names all values are text.  With a ``StructType`` they have its types, and ``rejected`` maps the
    columns whose text is not of their type, null in the row, to that text (null where there is none).
    """
    if isinstance(columns, T.StructType):
        text = read_columnar_json(spark, path, columns.names)
        typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in columns}
        bad = F.array_compact(F.array(*[
            F.when(F.col(n).isNotNull() & c.isNull(), F.struct(F.lit(n).alias("key"), F.col(n).alias("value"))) for n, c in typed.items()]))
        rejected = F.when(F.size(bad) > 0, F.map_from_entries(bad)).alias("rejected")
        return text.select("document", "idx", *[c.alias(n) for n, c in typed.items()], rejected)
    schema = T.StructType([T.StructField(c, T.MapType(T.StringType(), T.StringType())) for c in columns])

    def cells_of(column: str) -> Column:
        return F.transform(
            F.map_entries(column),
            lambda e: F.struct(F.lit(column).alias("column"), e["key"].alias("idx"), e["value"].alias("value")))

    none = F.array().cast("array<struct<column:string,idx:string,value:string>>")
    cells = F.flatten(F.array(*[F.coalesce(cells_of(c), none) for c in columns]))
    return (
        spark.read.schema(schema).option("multiLine", True).json(path)
        .select(F.col("_metadata.file_path").alias("document"), F.explode(cells).alias("c"))
        .groupBy("document", F.col("c.idx").cast("long").alias("idx"))
        .agg(*[F.max(F.when(F.col("c.column") == c, F.col("c.value"))).alias(c) for c in columns])
    )


def read_predictions_csv(spark: SparkSession, path: str, schema: T.StructType = schemas.PREDICTIONS) -> DataFrame:
    """CSV with a header in each file, cut in parallel; quoted cells may hold line breaks and doubled quotes.

    Columns are taken by the names in the header of their file, in any order; an absent column and a cell that
    is not of its type are null.
    """
    return read_csv(spark, path, schema)
