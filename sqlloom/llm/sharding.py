"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlloom.llm.common import discard, stored


def shard_quotas(rows: int, shards: int) -> list[int]:
    """Exact shard sizes: at most one row apart, the larger ones first."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` balls are good, out of ``good`` and ``bad`` ones.

    The law is summed up from its mode by the ratios of neighbouring chances and inverted at a uniform number,
    the same way at every size.  Counts further from the mode than 12 standard deviations and 64, whose chances
    together vanish beside the rounding of a double, are not summed, so memory grows with the root of the draw.
    """
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(drawn * (good / total) * (bad / total) * ((total - drawn) / (total - 1)))
    low, high = max(low, mode - int(12 * spread) - 64), min(high, mode + int(12 * spread) + 64)
    k = np.arange(low, high)  # the chance of k + 1 over that of k
    steps = np.log((good - k).astype(float)) + np.log((drawn - k).astype(float)) - np.log(k + 1.0) - np.log((bad - drawn + k + 1).astype(float))
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    chances = np.cumsum(np.exp(logs - logs[mode - low]))
    return low + int(np.searchsorted(chances, rng.random() * chances[-1], side="right"))


def communication_matrix(counts: list[int], quotas: list[int], seed: int) -> list[list[int]]:
    """How many rows each partition sends to each shard.

    Row p is a multivariate hypergeometric draw of ``counts[p]`` balls from what
    the earlier partitions left of the quotas, shard by shard: the distribution that a uniform
    permutation of all rows would give.  Rows add up to the partitions' counts
    and columns to the quotas.
    """
    rng, left, matrix = np.random.default_rng(seed), list(quotas), []
    for n in counts:
        others, drawn = sum(left), []
        for quota in left:
            others -= quota
            drawn.append(hypergeometric(rng, quota, others, n))
            n -= drawn[-1]
        left = [quota - d for quota, d in zip(left, drawn)]
        matrix.append(drawn)
    return matrix


def shuffle_into_shards(rows: DataFrame, shards: int = 24, seed: int = 20240607, partitions: int | None = None,
                        block_rows: int = 100_000) -> DataFrame:
    """Uniform random shuffle of a table into shards whose row counts are at most one apart.

    1. Every row gets two random keys and a source partition; the rows are stored, so that
       a lost executor cannot draw them anew.
    2. The partition counts (one number per partition) go to the driver, which draws the
       communication matrix: exact partition-to-shard counts.
    3. Each partition orders its rows by the first key and cuts that order by its row of the matrix.
    4. After the exchange the rows of a shard are ordered by the second key.  A shard is numbered in
       blocks of about ``block_rows`` rows, so no shard is ever one task.

    Returns ``row`` (a struct of all input columns, so none of their names can clash), ``shard``
    (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).  Nulls, empty texts and extra
    columns are carried as they are; repeated rows are dealt out one by one, as their keys
    also hold the place of a row; an empty table gives an empty result.  ``partitions`` defaults to the
    session's number of shuffle partitions.  Only DataFrame functions run on the executors.
    """
    spark = rows.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = (
        rows.select(F.struct("*").alias("row"))
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_h", F.xxhash64(F.lit(seed), F.col("_place"), F.to_json("row")))
        .select("row", "_h", F.xxhash64(F.lit(seed + 1), "_h", "_place").alias("_k"),
                F.pmod(F.xxhash64(F.lit(seed + 2), "_h"), F.lit(parts)).cast("int").alias("_part"))
    )
    keyed = stored(keyed, "shard-keys")
    counts = {r["_part"]: r["n"] for r in keyed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(counts)
    quotas = shard_quotas(sum(counts.values()), shards)
    matrix = communication_matrix([counts[p] for p in order], quotas, seed)
    cuts = spark.createDataFrame([(p, [int(x) for x in np.cumsum(m)]) for p, m in zip(order, matrix)],
                                 "_part int, _cuts array<bigint>")
    blocks = max(1, -(-max(quotas, default=0) // block_rows))
    local = F.row_number().over(Window.partitionBy("_part").orderBy("_h", "_k"))
    sent = (
        keyed.withColumn("_rank", local)
        .join(F.broadcast(cuts), "_part")  # one row per partition
        .withColumn("shard", F.size(F.filter("_cuts", lambda c: c < F.col("_rank"))))
        .select("row", "shard", F.pmod("_k", F.lit(blocks)).cast("int").alias("_block"), "_k", "_h")
    )
    sent = stored(sent, "shard-sent")
    discard(keyed)
    sizes = sent.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_k", "_h"))
    return (
        sent.withColumn("_in", inside)
        .join(F.broadcast(offsets), ["shard", "_block"])  # shards x blocks rows, each standing for about block_rows
        .select("row", "shard", (F.col("_offset") + F.col("_in") - 1).cast("bigint").alias("slot"))
    )
