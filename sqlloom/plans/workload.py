"""The relational query shapes a text-to-SQL corpus is made of, on the star-schema tables.

Every function takes a callable that returns a table by name.  Sums of doubles
go through a decimal so that the result does not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlloom.functions.ranking import number_rows
from sqlloom.functions.relational import not_in

Tables = Callable[[str], DataFrame]


def _money(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)")


def _sum(name: str) -> Column:
    return F.sum(_money(name)).cast("double")


def _mean(name: str) -> Column:
    return F.round(_sum(name) / F.count(name), 4)


def _top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First k rows with their rank; the window sees k rows only."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _year(name: str) -> Column:
    return F.year(F.col(name))


def _in_years(name: str, first: int, last: int) -> Column:
    """Date bounds instead of a function of the date, so that the scan can skip row groups."""
    c = F.col(name)
    return (c >= F.lit(f"{first}-01-01").cast("timestamp_ntz")) & (c < F.lit(f"{last + 1}-01-01").cast("timestamp_ntz"))


def w_filter_gt(t: Tables) -> DataFrame:
    return t("part").where("p_size > 25").select("p_partkey", "p_name")


def w_between(t: Tables) -> DataFrame:
    return t("part").where(F.col("p_size").between(10, 20)).select("p_partkey", "p_size")


def w_top1_filtered(t: Tables) -> DataFrame:
    rich = t("customer").where("c_mktsegment = 'FURNITURE'").select("c_custkey", "c_name", "c_acctbal")
    return _top(rich, 1, F.desc("c_acctbal"), F.asc("c_custkey"))


def w_sum_or(t: Tables) -> DataFrame:
    two = t("customer").where("c_mktsegment = 'FURNITURE' OR c_mktsegment = 'MACHINERY'")
    return two.agg(_sum("c_acctbal").alias("total_balance"))


def w_like(t: Tables) -> DataFrame:
    return t("part").where(F.col("p_name").ilike("%RING%")).select("p_partkey", "p_name")


def w_group_top1_sum(t: Tables) -> DataFrame:
    brands = t("part").groupBy("p_brand").agg(_sum("p_retailprice").alias("total_value"))
    return _top(brands, 1, F.desc("total_value"), F.asc("p_brand"))


def w_count_distinct(t: Tables) -> DataFrame:
    return t("events").where("event_type = 'purchase' AND value > 100").agg(
        F.count_distinct("user_id").alias("n_users"))


def w_sort_asc(t: Tables) -> DataFrame:
    rows = t("customer").select("c_custkey", "c_name", "c_acctbal")
    return number_rows(rows, ["c_acctbal", "c_custkey"], "rank", stored=True)


def w_group_top1_count(t: Tables) -> DataFrame:
    years = t("orders").groupBy(_year("o_orderdate").alias("order_year")).agg(F.count(F.lit(1)).alias("n_orders"))
    return _top(years, 1, F.desc("n_orders"), F.asc("order_year"))


def w_having_avg(t: Tables) -> DataFrame:
    return t("customer").groupBy("c_nationkey").agg(_mean("c_acctbal").alias("mean_balance")).where(
        "mean_balance > 4500")


def w_filter_group_count(t: Tables) -> DataFrame:
    return t("part").where("p_size > 25").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_parts"))


def w_top3_count(t: Tables) -> DataFrame:
    brands = t("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_parts"))
    return _top(brands, 3, F.desc("n_parts"), F.asc("p_brand"))


def w_multi_agg(t: Tables) -> DataFrame:
    return t("part").groupBy("p_type").agg(
        F.max("p_retailprice").alias("max_price"), _mean("p_retailprice").alias("mean_price"))


def w_having_distinct(t: Tables) -> DataFrame:
    return t("part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("n_brands")).where("n_brands > 1")


def w_top1(t: Tables) -> DataFrame:
    return _top(t("orders").select("o_orderkey", "o_totalprice"), 1, F.desc("o_totalprice"), F.asc("o_orderkey"))


def w_gt_scalar_avg(t: Tables) -> DataFrame:
    mean = t("customer").select(_sum("c_acctbal") / F.count("c_acctbal"))
    return t("customer").where(F.col("c_acctbal") > mean.scalar()).select("c_custkey", "c_acctbal")


def w_join_two_distinct(t: Tables) -> DataFrame:
    customers = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count_distinct("c_custkey").alias("n_customers"))
    suppliers = t("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.count_distinct("s_suppkey").alias("n_suppliers"))
    return t("nation").select("n_nationkey", "n_name").join(customers, "n_nationkey").join(suppliers, "n_nationkey").select(
        "n_name", "n_customers", "n_suppliers")


def w_join_having_eq(t: Tables) -> DataFrame:
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("l_orderkey").alias("n_lines")).where("n_lines = 2")
    orders = t("orders").select("o_orderkey", "o_totalprice")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_totalprice")


def w_join_distinct_or(t: Tables) -> DataFrame:
    buyers = t("orders").where(_in_years("o_orderdate", 1997, 1998)).select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").join(buyers.distinct(), "c_custkey", "left_semi").select("c_name").distinct()


def w_join3_sorted(t: Tables) -> DataFrame:
    rows = (
        t("orders").where(_in_years("o_orderdate", 1998, 1998))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("c_name", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    )
    # lineitem has no unique key here, so all shown columns take part in the order
    return number_rows(rows, rows.columns, "rank")


def w_join_having_gt(t: Tables) -> DataFrame:
    orders = t("orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n_orders")).where("n_orders > 1")
    return t("customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment", "n_orders")


def w_not_in_self(t: Tables) -> DataFrame:
    events = t("events")
    clicks = events.where("event_type = 'click'").select("user_id").distinct()
    return not_in(clicks, "user_id", events.where("event_type = 'purchase' AND value > 100"), "user_id")


def w_not_in_other(t: Tables) -> DataFrame:
    large = t("orders").where("o_totalprice > 400000")
    return not_in(t("customer").select("c_custkey", "c_name"), "c_custkey", large, "o_custkey")


def w_distinct_lt_max(t: Tables) -> DataFrame:
    top = t("part").select(F.max("p_retailprice"))
    return t("part").where(F.col("p_retailprice") < top.scalar()).select("p_retailprice").distinct()


def w_join_filter(t: Tables) -> DataFrame:
    lines = t("lineitem").where(_in_years("l_shipdate", 1999, 1999) & (F.col("l_returnflag") == "A"))
    return t("orders").where("o_orderstatus = 'F'").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def w_having_scalar(t: Tables) -> DataFrame:
    mean = t("customer").select(_sum("c_acctbal") / F.count("c_acctbal"))
    return (
        t("customer").groupBy("c_nationkey")
        .agg(F.min("c_acctbal").alias("min_balance"), (_sum("c_acctbal") / F.count("c_acctbal")).alias("mean_balance"))
        .where(F.col("mean_balance") > mean.scalar()).select("c_nationkey", "min_balance")
    )


def w_join_scalar_eq(t: Tables) -> DataFrame:
    # a name is not unique in part; the smallest key makes the sub-query one row
    part = t("part").where("p_name = 'small ring'").agg(
        F.min("p_partkey").alias("p_partkey"), F.min_by("p_name", "p_partkey").alias("p_name"))
    # an aggregate without keys is one row, so the lines of a popular part stay where they are
    return t("lineitem").join(F.broadcast(part), F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_quantity", "p_name")


def w_join3_composite(t: Tables) -> DataFrame:
    customer = t("customer")
    top = customer.select(F.max("c_acctbal"))
    peaks = customer.groupBy("c_nationkey", "c_mktsegment").agg(F.max("c_acctbal").alias("peak")).where(
        F.col("peak") == top.scalar()).select("c_nationkey", "c_mktsegment")
    return (
        t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
        .join(customer.join(peaks, ["c_nationkey", "c_mktsegment"]), "c_custkey")
        .select("o_orderkey", "c_name", "c_nationkey", "c_mktsegment")
    )


def _users(t: Tables, kind: str) -> DataFrame:
    # set operations shuffle their rows; without the copies a busy user is one row per task
    return t("events").where(F.col("event_type") == kind).select("user_id").distinct()


def w_intersect(t: Tables) -> DataFrame:
    return _users(t, "click").intersect(_users(t, "purchase"))


def w_except(t: Tables) -> DataFrame:
    buyers = t("events").where("event_type = 'purchase' AND value > 100").select("user_id").distinct()
    return _users(t, "click").subtract(buyers)


def w_union(t: Tables) -> DataFrame:
    return t("customer").select(F.col("c_nationkey").alias("nationkey")).union(
        t("supplier").select("s_nationkey")).distinct()


def w_count_star_filter(t: Tables) -> DataFrame:
    return t("events").where("value > 100").agg(F.count(F.lit(1)).alias("n_events"))


def w_group_join_top1(t: Tables) -> DataFrame:
    # orders are counted per customer first: the join then carries one row per customer
    per_customer = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    nations = (
        per_customer.join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey").agg(F.sum("n").alias("n_orders"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n_orders")
    )
    return _top(nations, 1, F.desc("n_orders"), F.asc("n_name"))


def w_never(t: Tables) -> DataFrame:
    year = t("orders").where(_in_years("o_orderdate", 1997, 1997)).select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").select("c_custkey").join(year.distinct(), "c_custkey", "left_anti")


def w_impossible_range(t: Tables) -> DataFrame:
    orders = t("orders")
    return orders.where("o_totalprice > 400000").select("o_orderstatus").distinct().intersect(
        orders.where("o_totalprice < 100000").select("o_orderstatus").distinct())


SHAPES: dict[str, Callable[[Tables], DataFrame]] = {
    name: f for name, f in list(globals().items()) if name.startswith("w_")
}
