"""Relational building blocks shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_in(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """``key NOT IN (SELECT other_key FROM other)`` as a shuffled anti join.

    Spark plans a SQL ``NOT IN`` as a null-aware anti join whose list is always
    broadcast.  Here the list may be of any size; the three null rules are kept
    by two counts: a null in the list rejects every row, an empty list keeps
    every row, and otherwise a null key is rejected.
    """
    listed = other.select(F.col(other_key).alias("_listed"))
    nulls = listed.where(F.col("_listed").isNull()).select(F.count(F.lit(1)))
    size = listed.select(F.count(F.lit(1)))
    return (
        df.join(listed.distinct(), F.col(key) == F.col("_listed"), "left_anti")
        .where((nulls.scalar() == 0) & (F.col(key).isNotNull() | (size.scalar() == 0)))
    )


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once per row.

    The optimizer folds a projection into the one expression that uses it; when
    that use is inside a lambda, the value would be worked out again for every
    element.  A one-row generator keeps it apart.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def join_rows(left: DataFrame, right: DataFrame, on: str | list[str] = "question_id", how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the questions.

    The size Spark estimates for extracted or rendered text is far below the
    real one, so such a side could be broadcast by mistake; it is sorted and
    merged instead, without a shuffle where both sides are partitioned alike.
    """
    return left.join(right.hint("merge"), on, how)


def join_catalog(rows: DataFrame, derived: DataFrame, how: str = "inner", broadcast: bool = False) -> DataFrame:
    """Join rows with something derived from the catalog, one row per database.

    Both sides are shuffled by ``db_id``, at every size; a database with very many rows is split
    by the adaptive skew join, which may do so as each database is one row here.  A caller who knows that the
    derived side fits into every executor may ask for it to be broadcast instead.
    """
    return rows.join(F.broadcast(derived) if broadcast else derived.hint("merge"), "db_id", how)
