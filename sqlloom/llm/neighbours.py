"""Approximate nearest neighbours by a forest of random-projection trees and exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlloom.llm.common import stored

_BLOCK = 4096  # rows of a leaf that are compared at a time
_PROBES, _RECALL = 200, 0.95  # queries whose neighbours are found by full comparison, and the share of them that the forest has to meet


@dataclass
class Tree:
    """Inner nodes in arrays; a negative child is the leaf -child - 1."""

    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray  # nodes x 2: below or at the cut, above it


def grow_tree(sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """Split at the median of a random projection until a leaf of the sample is small."""
    normals, cuts, children, leaves = [], [], [], 0
    todo = [(np.arange(len(sample)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        normal = rng.normal(size=sample.shape[1])
        seen = sample[rows] @ normal
        cut = float(np.median(seen)) if len(rows) else 0.0
        low = seen <= cut
        if len(rows) <= leaf or low.all():
            me, leaves = -leaves - 1, leaves + 1
        else:
            me = len(normals)
            normals.append(normal)
            cuts.append(cut)
            children.append([0, 0])
            todo += [(rows[low], me, 0), (rows[~low], me, 1)]
        if parent >= 0:
            children[parent][side] = me
    d = sample.shape[1]
    return Tree(np.array(normals).reshape(-1, d), np.array(cuts), np.array(children, np.int64).reshape(-1, 2))


def leaves_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    at = np.zeros(len(x), np.int64) if len(tree.cuts) else np.full(len(x), -1)
    while (open_ := np.flatnonzero(at >= 0)).size:
        node = at[open_]
        above = np.einsum("ij,ij->i", x[open_], tree.normals[node]) > tree.cuts[node]
        at[open_] = tree.children[node, above.astype(np.int64)]
    return -at - 1


def search_leaves(forest: list[Tree], x: np.ndarray, visits: int) -> list[tuple[int, int]]:
    """The leaves of all trees that one queue visits first, the largest margin to any cut on the way first."""
    sides = [t.normals @ x - t.cuts for t in forest]
    queue = [(-np.inf, t, 0 if len(tree.cuts) else -1) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    found = []
    while queue and len(found) < visits:
        margin, t, node = heapq.heappop(queue)
        if node < 0:
            found.append((t, -node - 1))
            continue
        side = float(sides[t][node])
        for k, room in ((0, -side), (1, side)):
            heapq.heappush(queue, (max(margin, -room), t, int(forest[t].children[node, k])))
    return found


def leaf_margins(tree: Tree, x: np.ndarray) -> np.ndarray:
    """For every row and leaf the largest margin on the way to it; one queue visits leaves in this order."""
    if not len(tree.cuts):
        return np.full((len(x), 1), -np.inf)
    sides = x @ tree.normals.T - tree.cuts
    inner, leaves = np.full((len(tree.cuts), len(x)), -np.inf), np.full((len(tree.cuts) + 1, len(x)), -np.inf)
    for node, below_above in enumerate(tree.children):  # a node comes before its children
        for child, room in zip(below_above, (-sides[:, node], sides[:, node])):
            margin = np.maximum(inner[node], -room)
            if child < 0:
                leaves[-child - 1] = margin
            else:
                inner[child] = margin
    return leaves.T


def needed_visits(forest: list[Tree], probes: np.ndarray, owner: np.ndarray, near: np.ndarray, recall: float) -> int:
    """The leaves to visit until ``recall`` of all neighbours (rows of ``near``, of the probes ``owner``) are met in some tree."""
    margins = [leaf_margins(t, probes) for t in forest]
    order = np.sort(np.concatenate(margins, axis=1), axis=1)
    first = np.min([m[owner, leaves_of(t, near)] for t, m in zip(forest, margins)], axis=0)
    needed = np.sort([np.searchsorted(order[o], f, side="right") for o, f in zip(owner, first)])
    return int(needed[int(np.ceil(recall * len(needed))) - 1])


def true_neighbours(classes: DataFrame, firsts: np.ndarray, probes: np.ndarray, k: int) -> pa.Table:
    """``probe``, ``first`` and ``v`` of the k best other classes for each probe, by comparison with every class."""
    box = classes.sparkSession.sparkContext.broadcast((firsts, probes))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked = box.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            score = asked @ _unit(batch.column(1), len(ids)).T
            score[own[:, None] == ids] = -np.inf
            near = np.argsort(-score, axis=1, kind="stable")[:, :k]
            at = pa.array(near.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(own), dtype=np.int32), near.shape[1])), batch.column(0).take(at),
                                              pa.array(np.take_along_axis(score, near, axis=1).ravel()), batch.column(1).take(at)], names=["probe", "first", "score", "v"])

    kind = classes.schema["v"].dataType.simpleString()
    found = classes.select("first", "v").mapInArrow(best, f"probe int, first bigint, score double, v {kind}").where("score > double('-infinity')")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "first")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("probe", "first", "v").toArrow()


def _unit(vectors: pa.Array, n: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine in double precision, summed in the same order for equal rows."""
    return (rows * query).sum(axis=1) / (np.sqrt((query * query).sum()) * np.sqrt((rows * rows).sum(axis=1)))


def vector_type(embeddings: DataFrame) -> str:
    """Floats stay as they are (they are exact in double precision); anything else is read as doubles."""
    kind = embeddings.schema["embedding"].dataType.simpleString()
    return kind if kind == "array<float>" else "array<double>"


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` of the rows that take part: finite, not zero, of the commonest dimension, one per identifier and vector."""
    v = F.col("embedding").cast(vector_type(embeddings))
    good = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    common = good.groupBy(F.size("v").alias("_d")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_d").limit(1)
    return good.join(F.broadcast(common), F.size("v") == F.col("_d"), "left_semi")  # one row


def _search_leaf(k: int):
    """Exact comparison of a leaf's queries with its rows; the k best for each query pass on."""

    def run(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "first": [], "score": []}
        if len(rows) and len(queries):
            ids = rows["first"].to_numpy()
            x = np.stack(rows["v"].to_numpy()).astype(np.float64)
            for q, v in zip(queries["first"], queries["v"]):
                v = v.astype(np.float64)
                score = np.concatenate([cosines(v, x[at:at + _BLOCK]) for at in range(0, len(x), _BLOCK)])
                if len(score) > k:  # with all ties of the k-th
                    near = np.flatnonzero(score >= np.partition(score, -k)[-k])
                    near = near[np.lexsort((ids[near], -score[near]))][:k]
                else:
                    near = np.arange(len(score))
                out["query"] += [q] * len(near)
                out["first"] += ids[near].tolist()
                out["score"] += score[near].tolist()
        return pd.DataFrame(out).astype({"query": "int64", "first": "int64", "score": "float64"})

    return run


def nearest(embeddings: DataFrame, is_query, k: int = 5, trees: int = 8, visits: int = 200, leaf_rows: int = 256,
            sample_rows: int = 20_000, seed: int = 5) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for every query row its k rows of largest cosine that were found.

    The forest is fitted on at most ``sample_rows`` vectors (those with the smallest hash) that come to the driver; it
    splits until a leaf stands for about ``leaf_rows`` of all rows, or for eight of the sample.  Every row is put into its
    leaf of every tree.  A query takes leaves in the order of one priority queue shared by all trees, and the rows of these
    leaves are compared exactly on the original vectors.  It takes ``visits`` leaves, or as many more as a fixed number of probes
    (queries of the smallest hash, compared with every row) need until 95 in 100 of their true neighbours are met; so
    recall holds at every table size.  Vectors without clusters, the hardest case, need a fixed share of all leaves.

    Equal vectors are one class in the index: it stands for its k + 1 smallest identifiers, which is all that a
    ranking with ties to the smaller identifier can use, so a vector that many rows share is no large leaf.
    Leaves that hold far more rows than planned are searched in blocks.  Null identifiers, and vectors that are null, zero,
    of another than the commonest dimension, or hold null or non-finite components take no part; a repeated row counts
    once; extra columns are ignored; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = stored(usable(embeddings).distinct(), "vectors")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], schema)
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    classes = stored(ranked.groupBy("v").agg(F.min("vec_id").alias("first"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "vector-classes")
    sample = classes.select("v", "first").orderBy(F.xxhash64(F.lit(seed), "first"), "first").limit(sample_rows).toArrow()
    points = np.array(sample["v"].to_pylist(), np.float64)
    points /= np.sqrt((points * points).sum(axis=1, keepdims=True))
    kinds = classes.count()
    rng = np.random.default_rng(seed)
    forest = [grow_tree(points, max(8, leaf_rows * len(points) // kinds), rng) for _ in range(trees)]
    box = spark.sparkContext.broadcast(forest)  # bounded by trees x sample_rows / 8 nodes

    def unit(batch: pa.RecordBatch, at: int) -> np.ndarray:
        return _unit(batch.column(at), batch.num_rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(batch, 1)
                for t, tree in enumerate(box.value):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(leaves_of(tree, x).astype(np.int32)), batch.column(0), batch.column(1)],
                                                     names=["tree", "leaf", "first", "v"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(unit(batch, 1) if batch.num_rows else ()):
                t, leaf = zip(*search_leaves(box.value, x, visits))
                at = pa.array([i] * len(t))
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(leaf, pa.int32()), batch.column(0).take(at), batch.column(1).take(at)],
                                                 names=["tree", "leaf", "first", "v"])

    kind = f"tree int, leaf int, first bigint, v {vector_type(embeddings)}"
    slim = classes.select("first", "v")
    wanted = rows.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "v")
    asked = wanted.join(slim.hint("merge"), "v").select("query_id", "first", "v")
    asked = stored(asked, "vector-queries")
    drawn = asked.select("first", "v").distinct().orderBy(F.xxhash64(F.lit(seed + 1), "first"), "first").limit(_PROBES).toArrow()
    if drawn.num_rows and kinds > 1:
        probes = _unit(drawn["v"].combine_chunks(), drawn.num_rows)
        truth = true_neighbours(slim, drawn["first"].to_numpy(), probes, k)
        near_truth = _unit(truth["v"].combine_chunks(), truth.num_rows)
        visits = max(visits, needed_visits(forest, probes, truth["probe"].to_numpy(), near_truth, _RECALL))
    index = slim.mapInArrow(place, kind)
    sizes = index.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * max(leaf_rows, 8 * kinds // len(points)))
    cut = [(r["tree"], r["leaf"], -(-r["n"] // (2 * leaf_rows))) for r in sizes.collect()]  # fewer rows than leaves

    def in_blocks(df: DataFrame, block) -> DataFrame:
        blocks = spark.createDataFrame(cut, "tree int, leaf int, _blocks int")
        joined = df.join(F.broadcast(blocks), ["tree", "leaf"], "left")
        return joined.select("tree", "leaf", block(F.coalesce(F.col("_blocks"), F.lit(1))).alias("block"), "first", "v")

    held = in_blocks(index, lambda n: F.pmod(F.xxhash64("first"), n).cast("int"))
    search = in_blocks(asked.select("first", "v").distinct().mapInArrow(visit, kind), lambda n: F.explode(F.sequence(F.lit(0), n - 1)))
    near = held.groupBy("tree", "leaf", "block").cogroup(search.groupBy("tree", "leaf", "block")).applyInPandas(
        _search_leaf(k + 1), "query bigint, first bigint, score double")
    near = near.distinct()
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first"))).where(F.col("_r") <= k + 1)
    members = best.join(classes.select("first", "ids").hint("merge"), "first").select("query", "score", F.explode("ids").alias("vec_id"))
    # the rows of the k + 1 best classes, at most (k + 1) squared for each class of queries
    shortlist = members.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= k + 1)
    answers = asked.select("query_id", "first").join(shortlist.hint("merge"), F.col("first") == F.col("query")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
