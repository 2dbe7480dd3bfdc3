"""Training-set tables from annotated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.functions.relational import join_rows
from sqlloom.functions.text import render, strip
from sqlloom.plans import templates as T


def valid_samples(annotations: DataFrame, scores: DataFrame) -> DataFrame:
    """Annotated rows with score 1."""
    good = scores.where(F.col("score") == 1).select("question_id")
    return join_rows(annotations, good, how="left_semi")


def samples_by_class(annotations: DataFrame, classes: tuple[str, ...] = ("EASY",)) -> DataFrame:
    return annotations.where(F.col("classification").isin(*classes))


def sft_pairs(samples: DataFrame) -> DataFrame:
    """``text`` is the prompt with fields and links, ``labels`` the reasoning and the query."""
    schema = F.concat(F.lit("Fields:\n"), F.col("fields"), F.lit("\nSchema_links:"), F.col("schema_links"))
    return samples.select(
        "question_id",
        render(T.TASK, question=F.col("question"), schema=schema).alias("text"),
        render(T.TARGET, reasoning=F.col("reasoning"), sql=F.col("predicted_sql")).alias("labels"),
    )


def split_reasoning(reasoning: Column) -> Column:
    """A line break before every digit followed by a dot, also inside numbers."""
    return strip(F.regexp_replace(reasoning, r"(?U)(\d\.)", "\n$1"))


def sft_single_text(samples: DataFrame) -> DataFrame:
    return samples.select("question_id", render(
        T.SINGLE_TEXT, question=F.col("question"), schema=F.col("fields"),
        reasoning=split_reasoning(F.col("reasoning")), sql=F.col("predicted_sql"),
    ).alias("text_to_sql"))


def train_eval_union(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Both single-text sets in one table, told apart by ``split``."""
    return sft_single_text(train).withColumn("split", F.lit("train")).unionByName(
        sft_single_text(evaluation).withColumn("split", F.lit("eval"))
    )


def token_budget(samples: DataFrame, column: str = "text", budget: int = 512) -> DataFrame:
    """Length in blank-separated tokens, whether it exceeds the budget, and the text cut to it."""
    tokens = F.filter(F.split(F.col(column), r"\s+"), lambda t: t != "")
    return samples.withColumn("_tokens", tokens).select(
        "question_id",
        F.size("_tokens").alias("n_tokens"),
        (F.size("_tokens") > budget).alias("over_budget"),
        F.array_join(F.slice("_tokens", 1, budget), " ").alias("cut_text"),
    )


def dataset_stats(annotations: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows before and after the score filter: by class and database, by class, in total."""
    scored = join_rows(annotations.select("question_id", "classification", "db_id"),
                       scores.select("question_id", "score"), how="left")
    return (
        scored.rollup("classification", "db_id")
        .agg(
            F.grouping_id().alias("g"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count(F.when(F.col("score") == 1, 1)).alias("n_valid"),
        )
        .select(
            F.when(F.col("g") == 0, "class_database").when(F.col("g") == 1, "class").otherwise("total").alias("level"),
            "classification", "db_id", "n_rows", "n_valid",
        )
    )
