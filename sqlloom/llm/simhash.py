"""SimHash fingerprints linked through a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlloom.llm.common import stored, utf8
from sqlloom.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
#: Differing bits touch at most as many bytes, so linked fingerprints share at least five of eight.
MIN_SHARED_BYTES = 8 - MAX_BITS
#: Any five shared positions put at least three into the first six (prefix filter), so postings
#: on three positions of these six meet every linked pair.
POSTING_POSITIONS = tuple(combinations(range(6), 3))
#: A longer posting list is cut further by two more shared positions; past this again, flips are looked up.
LONG_POSTING = 2048

_CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a whole text; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = utf8(text).lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), 42)  # a bit is set in over half of one hash if it is set in it
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, ones = len(words) - width + 1, np.zeros(64, np.int64)
    spans = zip(starts[:n].tolist(), ends[width - 1:].tolist())
    hashes = np.fromiter((xxh64_intdigest(joined[s:e], 42) for s, e in spans), np.uint64, n).astype(">u8").view(np.uint8).reshape(n, 8)
    for at in range(0, n, _CHUNK):
        ones += np.unpackbits(hashes[at:at + _CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's bits as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def postings(distinct: DataFrame) -> DataFrame:
    """The inverted index: one posting (``key``, ``fp``) for each choice of three byte positions."""
    byte = [F.shiftrightunsigned("fp", 56 - 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = [F.lit(c << 24).cast("bigint") + F.shiftleft(byte[i], 16) + F.shiftleft(byte[j], 8) + byte[k]
            for c, (i, j, k) in enumerate(POSTING_POSITIONS)]
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count filter on shared positional bytes, then the exact number of differing bits."""
    x = a ^ b
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    keep = shared >= MIN_SHARED_BYTES
    keep[keep] = np.bitwise_count(x[keep]) <= MAX_BITS
    return keep


def _pairs_of_runs(key: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs within runs of equal (sorted) keys, one distance in the run at a time."""
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    end = np.repeat(cut[1:], np.diff(cut))
    at, lag = np.arange(len(key)), 1
    while True:
        at = at[at + lag < end[at]]
        if not at.size:
            return
        a, b = fps[at], fps[at + lag]
        keep = _verified(a, b)
        if keep.any():
            yield a[keep], b[keep]
        lag += 1


def _flips(positions: tuple[int, ...]) -> list[int]:
    bits = [56 - 8 * p + i for p in positions for i in range(8)]
    return [sum(1 << b for b in chosen) for n in range(1, MAX_BITS + 1) for chosen in combinations(bits, n)]


def _pairs_of_long(fps: np.ndarray, triple: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of a long posting list: they share two more positions, so it is cut by each two."""
    others = [p for p in range(8) if p not in triple]
    for i, j in combinations(others, 2):
        key = ((fps >> np.uint64(56 - 8 * i)) & np.uint64(255)) << np.uint64(8) | ((fps >> np.uint64(56 - 8 * j)) & np.uint64(255))
        order = np.argsort(key, kind="stable")
        key, part = key[order], fps[order]
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        sizes = np.diff(cut)
        short = np.repeat(sizes <= LONG_POSTING, sizes)
        if short.any():
            yield from _pairs_of_runs(key[short], part[short])
        masks = _flips(tuple(p for p in others if p not in (i, j))) if not short.all() else []
        for k in np.flatnonzero(sizes > LONG_POSTING):  # five bytes are equal: look up every flip of the other three
            run = np.sort(part[cut[k]:cut[k + 1]])
            for mask in masks:
                wanted = run ^ np.uint64(mask)
                hit = run[np.minimum(np.searchsorted(run, wanted), len(run) - 1)] == wanted
                if hit.any():
                    yield run[hit], wanted[hit]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as connect the same nodes: every node with the smallest it reaches."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = inverse[:len(a)], inverse[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while (label[label] != label).any():
            label = label[label]
        if (label[left] == label[right]).all():
            moved = label != np.arange(len(nodes))
            return nodes[moved], nodes[label[moved]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists in key order; the list that a batch ends in waits for the next batch."""

    def linked(keys: list[np.ndarray], fps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, fp = np.concatenate(keys), np.concatenate(fps)
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        sizes = np.diff(cut)
        short = np.repeat((sizes > 1) & (sizes <= LONG_POSTING), sizes)
        found = [*_pairs_of_runs(key[short], fp[short])] if short.any() else []
        for k in np.flatnonzero(sizes > LONG_POSTING):
            held: list = []
            for pair in _pairs_of_long(fp[cut[k]:cut[k + 1]], POSTING_POSITIONS[int(key[cut[k]]) >> 24]):
                held.append(pair)
                if sum(len(x) for x, _ in held) > 1 << 20:  # bounded memory
                    held = [spanning(*map(np.concatenate, zip(*held)))]
            found += held
        if found:
            a, b = spanning(*map(np.concatenate, zip(*found)))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    keys: list[np.ndarray] = []
    fps: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        last = int(np.searchsorted(key, key[-1]))
        if last or (keys and keys[-1][-1] != key[-1]):
            yield from linked([*keys, key[:last]], [*fps, fp[:last]])
            keys, fps = [], []
        keys.append(key[last:])
        fps.append(fp[last:])
    if keys:
        yield from linked(keys, fps)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every document.

    Documents are linked when their fingerprints differ in at most three bits; ``component_id`` is the
    smallest ``doc_id`` that can be reached.  Equal fingerprints are one class, so copies are never
    paired; classes meet through posting lists on byte positions, a pair is kept when enough
    positional bytes are shared (count filter) and then verified bit by bit.  A task passes on a
    spanning forest of what it has linked, not the pairs.

    A null or empty text, or one without words, has fingerprint zero and is linked like any other.  A null ``doc_id``
    keeps its row and is not counted for the smallest one; repeated rows come out repeated; extra columns are
    ignored; an empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, id_column, text_column), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    lists = postings(classes.select("fp")).repartition("key").sortWithinPartitions("key", "fp")
    roots = components(lists.mapInArrow(_links, "a bigint, b bigint"))
    placed = classes.join(roots.hint("merge"), classes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least.hint("merge"), "root").select("fp", "component_id")
    return prints.join(named.hint("merge"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group, that of the smallest ``doc_id``; columns as they come.

    Rows that repeat a ``doc_id`` are one document, of which one row stays (the smallest text hash); rows without
    one all stay.
    """
    copies = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_copy")).distinct()
    once = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    left = docs.where("doc_id IS NOT NULL").join(copies.hint("merge"), F.col("doc_id") == F.col("_copy"), "left_anti")
    first = left.withColumn("_once", once).where("_once = 1").drop("_once")
    return first.unionByName(docs.where("doc_id IS NULL"))
