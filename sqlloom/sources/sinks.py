"""Sinks and the shapes they write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.functions.ranking import number_rows
from sqlloom.operators.extract import norm_class
from sqlloom.session import scratch_dir
from sqlloom.sources.commits import commit


def write_annotations(annotations: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet by ``class_norm``, one of three classes, so that a filter on it reads its own files only.

    ``classification`` is free text of the model and stays a data column.
    """
    by_class = annotations.withColumn("class_norm", norm_class(F.col("classification")))
    by_class.write.mode(mode).partitionBy("class_norm").parquet(path)


def commit_annotations(annotations: DataFrame, path: str, run: str) -> bool:
    """Annotations of one run, by ``class_norm``, published whole; False if the run had been published.

    A run that failed at any step may be started again: ``commits.read_committed`` gives one copy of it.
    """
    return commit(annotations.sparkSession, path, run, lambda folder: write_annotations(annotations, folder))


def write_splits(samples: DataFrame, path: str) -> None:
    """Training samples by split."""
    samples.write.mode("append").partitionBy("split").parquet(path)


def write_columnar_json(df: DataFrame, path: str, key: str, rows_per_document: int = 10_000) -> None:
    """Column-oriented documents of at most ``rows_per_document`` neighbouring keys, one per file.

    ``key`` must be unique; it becomes the index.
    """
    document = F.floor(F.col(key) / rows_per_document)
    cells = [
        F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), F.col(c).cast("string")))).alias(c)
        for c in df.columns if c != key
    ]
    (
        df.groupBy(document.alias("document")).agg(*cells)
        .select("document", F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"}))
        .write.partitionBy("document").text(path)
    )


def unpivot_export(df: DataFrame, key: str) -> DataFrame:
    """Long form (key, column, value) with every value as text."""
    columns = [c for c in df.columns if c != key]
    as_text = df.select(key, *[F.col(c).cast("string").alias(c) for c in columns])
    return as_text.unpivot(key, columns, "column_name", "value")


def write_predictions_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def eval_pairs(rows: DataFrame) -> DataFrame:
    """Keyed predicted and gold lines; a line holds neither breaks nor tabs."""
    def one_line(name: str):
        return F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"[\n\r\t]", " ")

    return rows.select("question_id", one_line("pred_sql").alias("pred"), one_line("gold_sql").alias("gold"),
                       one_line("db_id").alias("db_id"))


def write_eval_pairs(rows: DataFrame, path: str) -> None:
    """Tab-separated ``question_id, pred, gold, db``; quotes stand for themselves."""
    pairs = eval_pairs(rows)
    pairs.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in pairs.columns])).write.text(path)


def write_evaluator_files(rows: DataFrame, pred_path: str, gold_path: str) -> None:
    """Two line-aligned texts: the predictions, and ``gold<TAB>db_id``.

    Both are in the order of the unique ``question_id`` within and across their part files, so
    line n of one belongs to line n of the other, wherever the files are cut.  The pairs are worked out
    once and stored in the shared scratch folder for both.
    """
    spark, stored = rows.sparkSession, scratch_dir(rows.sparkSession, "pairs")
    pairs = eval_pairs(rows)
    pairs.write.parquet(stored)
    ordered = spark.read.schema(pairs.schema).parquet(stored).repartitionByRange("question_id").sortWithinPartitions("question_id")
    ordered.select("pred").write.text(pred_path)
    ordered.select(F.concat_ws("\t", "gold", "db_id")).write.text(gold_path)


def commit_evaluator_files(rows: DataFrame, path: str, run: str) -> bool:
    """Both files of ``write_evaluator_files`` as ``pred`` and ``gold`` of one folder, published together.

    ``commits.committed_folders`` gives the folder; an evaluator never meets one file of a run without the other.
    """
    return commit(rows.sparkSession, path, run, lambda folder: write_evaluator_files(rows, f"{folder}/pred", f"{folder}/gold"))


def transcript(samples: DataFrame) -> DataFrame:
    """Entries of prompt and answer, numbered in the order of the (unique) ``question_id``.

    The texts are worked out once and stored; bounds and counts read the stored keys only.
    """
    rows = number_rows(samples.select("question_id", "sample", "answer"), ["question_id"], "sample_no")
    return rows.select("sample_no", F.concat(
        F.lit("Sample "), F.col("sample_no").cast("string"), F.lit(":\n"), F.col("sample"),
        F.lit("\nGenerated SQL:\n"), F.coalesce("answer", F.lit("")), F.lit("\n"),
    ).alias("entry"))


def write_transcript(samples: DataFrame, path: str) -> None:
    """Transcript text; entries are in order within and across the part files."""
    ordered = transcript(samples).repartitionByRange("sample_no").sortWithinPartitions("sample_no")
    ordered.select("entry").write.text(path)
