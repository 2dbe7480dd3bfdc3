"""Comparison of query results as multisets of typed rows whose columns may stand in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.functions.relational import once

_CELL = "struct<name:string,cell:string>"


def _typed(value: Column) -> Column:
    """A variant as text that is equal for equal values: 1, 1.0 and 1e0 agree, the text "1" is another value."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    number = text.try_cast("double")
    whole = F.when(number % 1 == 0, number.try_cast("decimal(38,0)").cast("string"))
    return (
        F.when(kind == "VOID", None)
        .when(kind == "STRING", F.concat(F.lit("s"), text))
        .when(kind == "BOOLEAN", F.concat(F.lit("b"), text))
        .when((kind == "BIGINT") | text.rlike("^-?[0-9]+$"), F.concat(F.lit("n"), text))
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.concat(F.lit("n"), F.coalesce(whole, number.cast("string"))))
        .otherwise(F.concat(F.lit("o"), text))
    )


def _cells(text: Column) -> Column:
    """Array of (column, cell) of a row's text: an object, or a list, whose columns are named by their places.

    Any other text is a row of one cell, and a null is a row of none.
    """
    by_name = F.transform(F.map_entries(F.from_json(text, "map<string,variant>")), lambda e: F.struct(
        e["key"].alias("name"), _typed(e["value"]).alias("cell")))
    by_place = F.transform(F.from_json(text, "array<variant>"), lambda v, i: F.struct(
        i.cast("string").alias("name"), _typed(v).alias("cell")))
    alone = F.when(text.isNotNull(), F.array(F.struct(F.lit("").alias("name"), F.concat(F.lit("t"), text).alias("cell"))))
    return F.coalesce(by_name.cast(f"array<{_CELL}>"), by_place.cast(f"array<{_CELL}>"), alone, F.array().cast(f"array<{_CELL}>"))


def _pairings(columns: DataFrame) -> DataFrame:
    """``query_id, gold, pairings``: the gold columns, and each way to set the predicted columns beside them.

    Two columns may be paired if they hold the same values equally often.  Of columns of one side that hold the same values row
    by row only the first free one is tried, as they are alike.  Without any such pairing, columns of equal names are paired if both
    sides have the same names, and else those of equal places, so that differences are counted.
    """
    def side(name: str) -> Column:
        mine = F.filter("columns", lambda c: c["side"] == name)
        return F.array_sort(mine, lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1)
                            .when(a["name"] < b["name"], -1).otherwise(1))

    def names(of: str) -> Column:
        return F.transform(of, lambda c: c["name"])

    def longer(found: Column, gold: Column) -> Column:
        def fits(used: Column, c: Column) -> Column:
            sooner = F.exists("pred", lambda o: (o["rows"] == c["rows"]) & (o["name"] < c["name"]) & ~F.array_contains(used, o["name"]))
            return (c["held"] == gold["held"]) & ~F.array_contains(used, c["name"]) & ~sooner

        return F.flatten(F.transform(found, lambda used: F.transform(
            F.filter("pred", lambda c: fits(used, c)), lambda c: F.array_append(used, c["name"]))))

    start = F.array(F.array().cast("array<string>"))
    equal = F.when(F.size("gold") == F.size("pred"), F.aggregate("gold", start, longer))
    plain = F.when(F.array_sort(names("gold")) == F.array_sort(names("pred")), names("gold")).otherwise(names("pred"))
    sides = columns.groupBy("query_id").agg(F.collect_list(F.struct("side", "name", "place", "held", "rows")).alias("columns"))
    return (
        once(sides, gold=side("gold"), pred=side("pred"))
        .select("query_id", names("gold").alias("gold"), F.when(F.size(equal) > 0, equal).otherwise(F.array(plain)).alias("pairings"))
    )


def execution_match(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Whether gold and predicted result rows agree as multisets, per query.

    ``results`` holds ``query_id, side, row_json``; a row is a JSON object or list.  Cells are compared by type and value, rows without regard
    to their order, and columns without regard to order and names: each is known by the multiset of its values, a commutative sum of hashes, and
    rows are then compared cell by cell under the pairing of columns that this allows.  ``n_missing`` and ``n_extra`` count the rows that only
    one side has, under the pairing with fewest of them.

    ``queries`` lists the ids that were run: without any result row on either side the two results agree.  A null cell and an absent one are
    equal, so an object should keep its null cells, or a column without any value is not seen.  Columns of one name belong in a list, not in an
    object.  Another text is one cell, a null text no cell.

    Copies are counted before the shuffle, so a query with very many rows is spread over its distinct rows, and the values of its columns are
    summed up in the tasks.  Columns that hold the same values in different order leave several pairings, k of them up to k!;
    each of these is tried on each row.
    """
    counted = results.groupBy("query_id", "side", "row_json").agg(F.count(F.lit(1)).alias("n"))
    rows = once(counted, cells=_cells(F.col("row_json")))

    def weighed(*parts: Column | str) -> Column:
        return F.sum(F.when(F.col("c.cell").isNotNull(), F.xxhash64(*parts).cast("decimal(20,0)") * F.col("n")).otherwise(0))

    columns = (
        rows.select("query_id", "side", "row_json", "n", F.posexplode("cells").alias("place", "c"))
        .groupBy("query_id", "side", F.col("c.name").alias("name"))
        .agg(F.min("place").alias("place"), weighed("c.cell").alias("held"), weighed("row_json", "c.cell").alias("rows"))
    )
    paired = rows.join(_pairings(columns).hint("merge"), "query_id", "left")

    def under(order: Column) -> Column:
        cells = F.map_from_entries("cells")
        return F.transform(order, lambda name: F.try_element_at(cells, name))

    orders = F.coalesce(F.transform("pairings", lambda p: F.when(F.col("side") == "gold", F.col("gold")).otherwise(p)),
                        F.array(F.array().cast("array<string>")))
    weight = F.when(F.col("side") == "gold", F.col("n")).otherwise(-F.col("n"))
    verdict = (
        paired.select("query_id", weight.alias("weight"), F.posexplode(F.transform(orders, under)).alias("pairing", "row"))
        .groupBy("query_id", "pairing", "row").agg(F.sum("weight").alias("surplus"))
        .groupBy("query_id", "pairing").agg(
            F.sum(F.greatest("surplus", F.lit(0))).alias("n_missing"),
            F.sum(F.greatest(-F.col("surplus"), F.lit(0))).alias("n_extra"),
        )
        .groupBy("query_id").agg(F.min(F.struct((F.col("n_missing") + F.col("n_extra")).alias("n"), "n_missing", "n_extra")).alias("v"))
        .select("query_id", "v.n_missing", "v.n_extra")
    )
    verdict = queries.select("query_id").join(verdict.hint("merge"), "query_id", "left").fillna(0, ["n_missing", "n_extra"])
    return verdict.withColumn("matches", (F.col("n_missing") == 0) & (F.col("n_extra") == 0))
