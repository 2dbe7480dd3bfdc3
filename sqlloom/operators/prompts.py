"""Question preparation: schema text, prompt tables, shards and stored completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.functions.relational import join_catalog, join_rows
from sqlloom.functions.text import render
from sqlloom.operators.catalog import schema_texts, serialize_linking_schema, serialize_typed_schema
from sqlloom.operators.extract import norm_class
from sqlloom.plans import templates as T


def question_schema(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Attach the typed schema text of its database to each question."""
    texts = serialize_typed_schema(catalog).withColumnRenamed("typed_schema", "schema")
    return join_catalog(questions.select("question_id", "db_id", "question"), texts).select(
        "question_id", "db_id", "question", "schema")


def questions_without_schema(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    rows = questions.select("question_id", "db_id", "question")
    return join_catalog(rows, catalog.select("db_id"), "left_anti").select("question_id", "db_id", "question")


def baseline_prompt(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    return question_schema(questions, catalog).select(
        "question_id", render(T.BASELINE, question=F.col("question"), schema=F.col("schema")).alias("prompt")
    )


def schema_link_prompt(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    q = questions.select("question_id", "db_id", "question")
    return join_catalog(q, serialize_linking_schema(catalog)).select(
        "question_id",
        render(T.SCHEMA_LINK, question=F.col("question"), schema_text=F.col("schema_text"),
               fk_text=F.col("fk_text")).alias("prompt"),
    )


def classification_prompt(questions: DataFrame, links: DataFrame) -> DataFrame:
    q = questions.select("question_id", "question")
    return join_rows(q, links.select("question_id", "schema_links")).select(
        "question_id",
        render(T.CLASSIFICATION, question=F.col("question"), schema_links=F.col("schema_links")).alias("prompt"),
    )


def sql_prompt(questions: DataFrame, links: DataFrame, labels: DataFrame, catalog: DataFrame) -> DataFrame:
    """Prompt for the query, chosen by class; fields and keys go along for the annotated row."""
    slots = {s: F.col(s) for s in ("question", "schema_links", "foreign_keys")}
    route = norm_class(F.col("classification"))
    prompt = (
        F.when(route == "EASY", render(T.SQL_EASY, **slots))
        .when(route == "NON-NESTED", render(T.SQL_MEDIUM, **slots))
        .otherwise(render(T.SQL_HARD, **slots))
    )
    rows = join_rows(questions.select("question_id", "db_id", "question"), links.select("question_id", "schema_links"))
    rows = join_rows(rows, labels.select("question_id", "classification"))
    return join_catalog(rows, schema_texts(catalog).select("db_id", "fields", "foreign_keys")).select(
        "question_id", route.alias("route"), "fields", "foreign_keys", prompt.alias("prompt"))


def correction_prompt(questions: DataFrame, parsed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Prompt to repair a parsed query; rows without a parsed query have nothing to repair."""
    names = ("fields", "foreign_keys", "primary_keys", "question", "reasoning", "sql")
    answers = parsed.where(F.col("sql").isNotNull()).select("question_id", "reasoning", "sql")
    rows = join_rows(questions.select("question_id", "db_id", "question"), answers)
    return join_catalog(rows, schema_texts(catalog)).select(
        "question_id", render(T.CORRECTION, **{n: F.col(n) for n in names}).alias("prompt"))


def inference_prompt(rows: DataFrame, schema: str = "schema_links") -> DataFrame:
    """Prompt from a question and the schema column named by ``schema``.

    A missing column and a null cell both give the default text.
    """
    def slot(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in rows.columns else F.lit(default)

    return rows.select(
        "question_id",
        render(T.TASK, question=slot("question", T.NO_QUESTION), schema=slot(schema, T.NO_SCHEMA)).alias("prompt"),
    )


def shard_of(key: Column, n_shards: int) -> Column:
    return F.pmod(key, F.lit(n_shards)).cast("int")


def question_shards(questions: DataFrame, n_shards: int = 4) -> DataFrame:
    """Sizes of the stable shards of the questions."""
    return questions.groupBy(shard_of(F.col("question_id"), n_shards).alias("shard")).agg(
        F.count(F.lit(1)).alias("n_questions")
    )


def with_prompt_hash(prompts: DataFrame) -> DataFrame:
    """A ``prompt_hash`` that is stored already stays, and with it the buckets of its table."""
    return prompts if "prompt_hash" in prompts.columns else prompts.withColumn("prompt_hash", F.sha2("prompt", 256))


def pending_prompts(prompts: DataFrame, completions: DataFrame) -> DataFrame:
    """Prompts without a stored completion, ready to be sent."""
    done = completions.select("prompt_hash").distinct()
    asked = with_prompt_hash(prompts).select("question_id", "prompt_hash", "prompt")
    return join_rows(asked, done, "prompt_hash", "left_anti")


def join_completions(prompts: DataFrame, completions: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Each prompt with its last attempt among the first ``max_attempts``, null when still pending."""
    last = completions.where(F.col("attempt") <= max_attempts).groupBy("prompt_hash").agg(
        F.count(F.lit(1)).alias("n_attempts"),
        F.max("attempt").alias("attempt"),
        F.max_by("status", "attempt").alias("status"),
        F.max_by("completion", "attempt").alias("completion"),
    )
    return join_rows(with_prompt_hash(prompts).select("question_id", "prompt_hash"), last, "prompt_hash", "left")
