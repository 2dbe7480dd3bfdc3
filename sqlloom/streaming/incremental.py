"""Incremental parsing of newly arrived responses, and progress by shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlloom import schemas
from sqlloom.functions.relational import join_rows
from sqlloom.operators.extract import extract_reasoning_sql
from sqlloom.operators.prompts import shard_of
from sqlloom.session import scratch_dir
from sqlloom.sources.commits import commit, read_committed


def read_response_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """JSON-lines response files as they land in ``path``, with the time of their file as ``arrived``."""
    files = (
        spark.readStream.schema(schemas.DELIVERIES)
        .option("maxFilesPerTrigger", files_per_batch).json(path)
    )
    return files.select("*", F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_path").alias("file"))


def stream_extract(spark: SparkSession, source: str, sink: str, checkpoint: str) -> None:
    """Parse the response files not seen before and append them to ``sink``; returns when all are done.

    The checkpoint holds which files were read and the sink its committed
    batches, so a stopped or failed run is continued without loss or repeats.
    All three folders must be shared by the executors.  A response may be delivered again or retried: the sink keeps
    every delivery, no state is held between batches, and ``read_parsed`` gives the last of each question.
    """
    query = (
        extract_reasoning_sql(read_response_stream(spark, source))
        .writeStream.format("parquet").outputMode("append")
        .option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


PARSED = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("sql", T.StringType()),
    T.StructField("parse_status", T.StringType()),
])


_DELIVERED = T.StructType([
    *PARSED.fields,
    T.StructField("attempt", T.IntegerType()),
    T.StructField("arrived", T.TimestampType()),
    T.StructField("file", T.StringType()),
])


def read_parsed(spark: SparkSession, sink: str) -> DataFrame:
    """One row for each question of the sink: its highest attempt, of which the file that arrived last counts.

    Without ``attempt`` a response is attempt 0.  Files of one time go by their path, and lines of one file by what was parsed, so the choice
    does not depend on the order of tasks.  Rows without a question are kept, each.  Each task passes on one row a question, so a question
    delivered very often is not gathered in one task.
    """
    delivered = spark.read.schema(_DELIVERED).parquet(sink)
    names = PARSED.names
    last = Window.partitionBy("question_id").orderBy(
        F.coalesce("attempt", F.lit(0)).desc(), F.desc("arrived"), F.desc("file"), *[F.desc(n) for n in names[1:]])
    chosen = (
        delivered.where("question_id IS NOT NULL").withColumn("_place", F.row_number().over(last)).where("_place = 1")
    )
    return chosen.select(names).unionByName(delivered.where("question_id IS NULL").select(names))


def progress_by_shard(questions: DataFrame, annotations: DataFrame, n_shards: int = 4) -> DataFrame:
    """Questions asked and processed in each shard."""
    done = annotations.select("question_id").distinct().withColumn("done", F.lit(1))
    return (
        join_rows(questions.select("question_id"), done, how="left")
        .groupBy(shard_of(F.col("question_id"), n_shards).alias("shard"))
        .agg(F.count(F.lit(1)).alias("n_asked"), F.count("done").alias("n_processed"))
    )


_COUNTS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("n_processed", T.LongType())])
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream_progress(done: DataFrame, questions: DataFrame, path: str, checkpoint: str, n_shards: int = 4) -> None:
    """Add the questions that newly arrived in the stream ``done`` to the counts in ``path``; returns when all are counted.

    Each batch publishes its counts as a run of its own id, so a batch that is repeated after a failure
    counts once.  The ids seen are keyed state in RocksDB on the executors' disks, one a question, kept in ``checkpoint``: a question
    delivered again, in whatever batch, is not counted again, and earlier batches are not read.  Ids of no question and null ids are not counted.
    """
    spark, asked = done.sparkSession, questions.select("question_id")

    def add(batch: DataFrame, batch_id: int) -> None:
        ids = scratch_dir(spark, "ids")
        batch.write.parquet(ids)  # the state needs every partition of a batch to run, also where its counts are published already
        counts = join_rows(spark.read.schema(batch.schema).parquet(ids), asked, how="left_semi").groupBy(
            shard_of(F.col("question_id"), n_shards).alias("shard")).agg(F.count(F.lit(1)).alias("n_processed"))
        commit(spark, path, f"batch-{batch_id}", lambda folder: counts.write.parquet(folder))

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = (
            done.select("question_id").dropDuplicates(["question_id"])
            .writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(_PROVIDER, before)
    query.awaitTermination()


def read_progress(spark: SparkSession, path: str, questions: DataFrame, n_shards: int = 4) -> DataFrame:
    """Questions asked and processed in each shard, by the counts that ``stream_progress`` published with the same shards."""
    asked = questions.groupBy(shard_of(F.col("question_id"), n_shards).alias("shard")).agg(F.count(F.lit(1)).alias("n_asked"))
    done = read_committed(spark, path, _COUNTS).groupBy("shard").agg(F.sum("n_processed").alias("n_processed"))
    return asked.join(done, "shard", "left").select("shard", "n_asked", F.coalesce("n_processed", F.lit(0)).alias("n_processed"))
