"""The annotation chain: questions, catalog and three response tables to annotated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.functions.relational import join_catalog, join_rows
from sqlloom.operators.catalog import schema_texts
from sqlloom.operators.extract import extract_label, extract_schema_links, has_tags, reasoning_sql


def annotation_rejects(
    questions: DataFrame, catalog: DataFrame, links: DataFrame, classes: DataFrame, answers: DataFrame
) -> DataFrame:
    """Every question that ``annotate`` leaves out, with its reasons; accepted and rejected ones are all questions."""
    rows = questions.select("question_id", "db_id")
    tagged = F.coalesce(has_tags(F.col("response")), F.lit(False)).alias("_tagged")
    for part in (
        links.select("question_id", F.lit(True).alias("_links")),
        classes.select("question_id", F.lit(True).alias("_class")),
        answers.select("question_id", tagged),
    ):
        rows = join_rows(rows, part, how="left")
    rows = join_catalog(rows, catalog.select("db_id", F.lit(True).alias("_known")), "left")
    reason = F.concat_ws(
        ", ",
        F.when(F.col("_links").isNull(), "no link response"),
        F.when(F.col("_class").isNull(), "no class response"),
        F.when(F.col("_tagged").isNull(), "no answer").when(~F.col("_tagged"), "answer without tags"),
        F.when(F.col("_known").isNull(), "unknown database"),
    )
    return rows.select("question_id", "db_id", reason.alias("reason")).where(F.col("reason") != "")


def annotate(
    questions: DataFrame, catalog: DataFrame, links: DataFrame, classes: DataFrame, answers: DataFrame
) -> DataFrame:
    """One annotated row per question whose database is known and whose answer could be parsed.

    The responses are reduced to their extracted parts before they are joined.
    All joins but the last use ``question_id``, so each table is shuffled once.
    """
    # rows without tags have no query; the test is on the raw text because a filter on the
    # extracted query would be pushed to the scan and repeat the extraction there
    answer = reasoning_sql(F.col("response"))
    parsed = answers.where(has_tags(F.col("response"))).select("question_id", answer.alias("r")).select(
        "question_id", F.col("r.sql").alias("predicted_sql"), "r.reasoning")
    rows = questions.select("question_id", "db_id", "question", F.col("query").alias("gold_sql"))
    for part in (
        extract_schema_links(links),
        extract_label(classes).select("question_id", "classification"),
        parsed,
    ):
        rows = join_rows(rows, part)
    return join_catalog(rows, schema_texts(catalog).select("db_id", "fields", "foreign_keys")).select(
        "question_id", "question", "schema_links", "fields", "foreign_keys", "classification",
        "predicted_sql", "gold_sql", "db_id", "reasoning")
