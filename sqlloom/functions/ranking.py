"""Numbering of a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlloom.session import scratch_dir

_SAMPLES = 32  # sampled keys for each range
ROWS_PER_RANGE = 50_000


def _bounds(df: DataFrame, order: list[str], ranges: int) -> list[tuple]:
    """Keys that cut the table into ranges of about equal size.

    The sample is the keys of smallest hash, so it is the same in every run; each task passes on a
    bounded number, and few rows give few ranges.
    """
    keys = df.select(*order)
    sample = keys.orderBy(F.xxhash64(*order), *order).limit(_SAMPLES * ranges).orderBy(*order).collect()
    return [tuple(r) for r in sample[_SAMPLES::_SAMPLES]]


def _range_of(bounds: list[tuple], fields: list[T.StructField]) -> Column:
    """How many of the sorted bounds are not above the row's key, by binary search."""
    if not bounds:
        return F.lit(0)

    def key(values: list[Column]) -> Column:
        return F.struct(*[v.cast(f.dataType).alias(f.name) for v, f in zip(values, fields)])

    cuts = F.array(*[key([F.lit(v) for v in b]) for b in bounds])
    own = key([F.col(f.name) for f in fields])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= own, at + step).otherwise(at))


def number_rows(df: DataFrame, order: list[str], name: str, stored: bool = False) -> DataFrame:
    """Add the 1-based position of every row under an ascending total order, nulls first.

    The input is worked out once and stored in the shared scratch folder; bounds and counts then read the stored
    keys only.  ``stored`` says that the input is a plain scan of a table already, which needs no copy.  The range of a row
    follows from its key and the bounds, so a lost executor cannot move a row.  A position is the offset of the range plus the
    place inside it; the offsets are one row per range.  ``order`` names columns of plain types and should end in
    a unique key, which also spreads a hot leading value over several ranges.  The result comes out in that order,
    partition after partition.
    """
    if not stored:
        path = scratch_dir(df.sparkSession, "numbered")
        df.write.parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
    # a range is sorted by one task, so there are more of them in a larger table
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_RANGE))
    part = _range_of(_bounds(df, order, ranges), [df.schema[c] for c in order])
    sizes = df.select(part.alias("_part")).groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # one row per range, so both the window and the broadcast are bounded by the number of ranges
    offsets = sizes.selectExpr(
        "_part",
        "sum(_size) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _offset",
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        df.withColumn("_part", part).repartitionByRange(ranges, "_part").withColumn("_place", inside)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.coalesce("_offset", F.lit(0)) + F.col("_place"))
        .drop("_part", "_offset", "_place")
    )
