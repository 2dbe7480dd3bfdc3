"""Ranking of schema items per question and the schema text of the best ones.

A question meets the items of its own database through one join on ``db_id``;
scoring, ranking and cutting then happen on the arrays inside the row, so
question x item rows are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlloom.functions.arrays import new_value, runs
from sqlloom.functions.relational import join_catalog, join_rows, once
from sqlloom.operators.catalog import filtered_schema_text, foreign_keys_text

# How much of a schema is kept.
TOP_TABLES = 6
TOP_COLUMNS = 10


def _tokens(c: Column) -> Column:
    words = F.split(F.lower(c), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def _weighted_items(catalog: DataFrame) -> DataFrame:
    """Tables and columns of each database, nested, every name split into weighted tokens.

    A token weighs 1 / number of items of the database that hold it.  Items are sorted by
    (table, column) with the table in front of its columns; their tokens are sorted by token,
    which gives the counts, and then back by item.  So the work of a row grows as its sorts do,
    and the catalog is not shuffled.  The foreign keys go along for the schema text.
    """
    def item(tab_idx: Column, col_idx: Column, name: Column) -> Column:
        return F.struct(tab_idx.alias("tab_idx"), col_idx.alias("col_idx"), name.alias("name"))

    tables = F.transform("table_names_original", lambda t, i: item(i, F.lit(-1), t))
    columns = F.filter(
        F.transform("column_names_original", lambda c, i: item(
            F.get(c, F.lit(0)).try_cast("int"), i, F.get(c, F.lit(1)))),
        lambda c: (c["tab_idx"] >= 0) & (c["tab_idx"] < F.size("table_names_original")))
    rows = once(catalog, foreign_keys_text=foreign_keys_text(), _items=F.array_sort(F.concat(tables, columns)))

    found = F.flatten(F.transform("_items", lambda c, p: F.transform(
        F.coalesce(_tokens(c["name"]), F.array().cast("array<string>")),
        lambda w, k: F.struct(w.alias("token"), p.alias("item"), k.alias("pos")))))

    def token(item: Column, pos: Column, word: Column, w: Column) -> Column:
        return F.struct(item.alias("item"), pos.alias("pos"), word.alias("token"), w.alias("w"))

    weighed = F.flatten(F.transform(runs(F.array_sort(found), new_value("token")), lambda r: F.transform(
        r, lambda o: token(o["item"], o["pos"], o["token"], F.lit(1.0) / F.size(r)))))
    marks = F.transform("_items", lambda c, p: token(p, F.lit(-1), F.lit(""), F.lit(0.0)))
    rows = once(rows, _tokens=runs(F.array_sort(F.concat(marks, weighed)), lambda a, x, i: x["pos"] == -1))

    with_tokens = F.transform("_items", lambda c, p: F.struct(
        c["tab_idx"].alias("tab_idx"), c["col_idx"].alias("col_idx"), c["name"].alias("name"),
        F.transform(F.slice(F.get("_tokens", p), 2, F.size(F.get("_tokens", p))), lambda t: F.struct(
            t["token"].alias("token"), t["w"].alias("w"))).alias("tokens")))
    nested = F.transform(runs(with_tokens, lambda a, x, i: x["col_idx"] == -1), lambda r: F.struct(
        r[0]["tab_idx"].alias("tab_idx"), r[0]["name"].alias("table_name"), r[0]["tokens"].alias("tokens"),
        F.transform(F.slice(r, 2, F.size(r)), lambda c: F.struct(
            c["col_idx"].alias("col_idx"), c["name"].alias("column_name"), c["tokens"].alias("tokens"))).alias("columns")))
    return rows.select("db_id", "foreign_keys_text", nested.alias("items"))


def scored_items(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each question with ``items``, its tables and columns carrying a score."""
    return score_items(questions, _weighted_items(catalog))


def score_items(questions: DataFrame, weighted: DataFrame, *kept: str, along: tuple[str, ...] = ()) -> DataFrame:
    """``scored_items`` from weighted items; ``kept`` names more fields of tables and columns alike that stay.

    ``along`` names columns of the questions that go with them.
    """
    asked = questions.select("question_id", "db_id", *along, _tokens(F.col("question")).alias("_asked"))

    def score(tokens: Column) -> Column:
        total = F.aggregate(tokens, F.lit(0.0), lambda acc, t: acc + F.when(
            F.array_contains("_asked", t["token"]), t["w"]).otherwise(0.0))
        return (F.floor(total * 1e6 + 0.5) / 1e6).alias("score")

    def table(t: Column) -> Column:
        return F.struct(
            t["tab_idx"].alias("tab_idx"), t["table_name"].alias("table_name"), score(t["tokens"]),
            *[t[n].alias(n) for n in kept],
            F.transform(t["columns"], lambda c: F.struct(
                c["col_idx"].alias("col_idx"), c["column_name"].alias("column_name"), score(c["tokens"]),
                *[c[n].alias(n) for n in kept])
            ).alias("columns"),
        )

    # worked out once, however many expressions name the items
    return once(join_catalog(asked, weighted), scored=F.transform("items", table)).select(
        "question_id", "db_id", *along, "foreign_keys_text", F.col("scored").alias("items"))


def schema_item_scores(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per question and item; tables have a null column.  Zero scores stay."""
    t = F.col("t")
    rows = F.concat(
        F.array(F.struct(F.lit(None).cast("int").alias("col_idx"), F.lit(None).cast("string").alias("column_name"),
                         t["score"].alias("score"))),
        t["columns"],
    )
    return (
        scored_items(questions, catalog).select("question_id", F.explode("items").alias("t"))
        .select("question_id", t["tab_idx"].alias("tab_idx"), t["table_name"].alias("table_name"),
                F.explode(rows).alias("c"))
        .select("question_id", "tab_idx", "table_name", "c.col_idx", "c.column_name", "c.score")
    )


def best(items: Column, index: str, k: int) -> Column:
    """The k items with the highest score, ties by position."""
    # 0 - score, since a negated zero would sort apart from zero
    keyed = F.transform(items, lambda i: F.struct(
        (F.lit(0.0) - i["score"]).alias("down"), i[index].alias("pos"), i.alias("item")))
    return F.transform(F.slice(F.sort_array(keyed), 1, k), lambda s: s["item"])


def best_items(scored: DataFrame, k_tables: int = TOP_TABLES, k_columns: int = TOP_COLUMNS) -> DataFrame:
    """Cut ``items`` to the best tables and the best columns of each, in rank order."""
    cut = F.transform(
        best(F.col("items"), "tab_idx", k_tables),
        lambda t: F.struct(
            t["tab_idx"].alias("tab_idx"), t["table_name"].alias("table_name"), t["score"].alias("score"),
            best(t["columns"], "col_idx", k_columns).alias("columns")),
    )
    return once(scored, _best=cut).withColumn("items", F.col("_best")).drop("_best")


def top_k_tables(scored: DataFrame, k: int = TOP_TABLES) -> DataFrame:
    return once(scored, _best=best(F.col("items"), "tab_idx", k)).select("question_id", F.posexplode("_best").alias("pos", "t")).select(
        "question_id", (F.col("pos") + 1).alias("table_rank"), "t.tab_idx", "t.table_name", "t.score"
    )


def top_k_columns(scored: DataFrame, k_tables: int = TOP_TABLES, k: int = TOP_COLUMNS) -> DataFrame:
    return (
        best_items(scored, k_tables, k)
        .select("question_id", F.posexplode("items").alias("t_pos", "t"))
        .select("question_id", (F.col("t_pos") + 1).alias("table_rank"), "t.table_name",
                F.posexplode("t.columns").alias("c_pos", "c"))
        .select("question_id", "table_rank", "table_name", (F.col("c_pos") + 1).alias("column_rank"),
                "c.column_name", "c.score")
    )


def filtered_schema(scored: DataFrame, kept_only: bool = False) -> DataFrame:
    """Schema text of the best items of each question, with its foreign keys."""
    items = F.transform("items", lambda t: F.struct(
        t["table_name"].alias("table_name"), F.lit("").alias("table_comment"),
        F.transform(t["columns"], lambda c: c["column_name"]).alias("column_names")))
    return best_items(scored).select(
        "question_id", filtered_schema_text(items, F.col("foreign_keys_text"), kept_only).alias("filtered_schema")
    )


# --- scores from outside, one row per question and item ---------------------------------------------

def external_top_tables(scores: DataFrame, k: int = TOP_TABLES) -> DataFrame:
    """Best tables by an outside score table; Spark cuts to k per task before the shuffle."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "tab_idx")
    return (
        scores.where(F.col("column_name").isNull())
        .withColumn("table_rank", F.row_number().over(order)).where(F.col("table_rank") <= k)
        .select("question_id", "table_rank", "tab_idx", "table_name", "score")
    )


def external_top_columns(scores: DataFrame, k_tables: int = TOP_TABLES, k: int = TOP_COLUMNS) -> DataFrame:
    order = Window.partitionBy("question_id", "tab_idx").orderBy(F.desc("score"), "col_idx")
    kept = external_top_tables(scores, k_tables).select("question_id", "tab_idx", "table_rank")
    best = scores.where(F.col("column_name").isNotNull()).withColumn(
        "column_rank", F.row_number().over(order)).where(F.col("column_rank") <= k)
    return join_rows(best, kept, ["question_id", "tab_idx"]).select(
        "question_id", "table_rank", "table_name", "column_rank", "column_name", "score")
