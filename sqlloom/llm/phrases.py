"""Phrase collocations from n-grams counted in quotient filters."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlloom.llm import quotient
from sqlloom.llm.common import reread, stored, utf8

_BLOCK_BYTES = 8 << 20  # text that shares one local dictionary
_OCCURRENCES = 1_000_000  # held by a task before they are handed on
_BREAK = b"\xff"  # never a byte of UTF-8; stands for the end of a piece
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _BREAK * 10)


def _words(raw: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of a text, a break behind every piece.  What is left to split at is blank and tab."""
    return raw.lower().translate(_PIECES).replace(_BREAK, b" \xff ").split()


def _coded_blocks(docs: DataFrame) -> DataFrame:
    """The tokenized corpus, read once: per block one row with its ``codes`` and one row per distinct (language, word).

    ``codes`` numbers the words of the block from 1; 0 ends a piece.  A block's number follows from its
    partition, and the table is stored before it is used, so both kinds of rows belong together.
    """
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("code", pa.int32()), ("n", pa.int64()), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32

        def fresh() -> tuple[dict, list, int]:
            number = itertools.count(1)
            return defaultdict(lambda: defaultdict(number.__next__, {_BREAK: 0})), [], 0

        def close() -> Iterator[pa.RecordBatch]:
            all_codes = np.concatenate(codes)
            times = np.bincount(all_codes)
            yield pa.RecordBatch.from_arrays([pa.array([block]), *[pa.nulls(1, f.type) for f in schema][1:5], pa.array([all_codes.tobytes()], pa.binary())], schema=schema)
            for lang, own in known.items():
                del own[_BREAK]
                at = np.fromiter(own.values(), np.int32, len(own))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(own), block)), pa.repeat(pa.scalar(lang, pa.string()), len(own)), pa.array(list(own), pa.binary()).cast(pa.string()),
                    pa.array(at), pa.array(times[at]), pa.nulls(len(own), pa.binary())], schema=schema)

        known, codes, held = fresh()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = utf8(text.as_py())
                if held and held + len(raw) > _BLOCK_BYTES:
                    yield from close()
                    block += 1
                    known, codes, held = fresh()
                words = _words(raw)
                if words:
                    words.append(_BREAK)
                    codes.append(np.fromiter(map(known[lang].__getitem__, words), np.int32, len(words)))
                    held += len(raw)
        if held:
            yield from close()

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(
        run, "block bigint, lang string, word string, code int, n bigint, codes binary")


def _filters(ids: np.ndarray, usable: np.ndarray, orders: range, bits: int, shards: int, block: int) -> Iterator[tuple]:
    """Rows (block, order, shard, filter) of the n-grams of a block; ``usable`` marks the neighbours that may be part of one."""
    for n in orders:
        many = len(ids) - n + 1
        if many <= 0:
            return
        good = np.ones(many, bool)
        for k in range(n - 1):
            good &= usable[k:k + many]
        at = np.flatnonzero(good)
        if not len(at):
            return
        packing = quotient.Packing(n, bits)
        limbs, counts = quotient.tally(packing.permute(packing.pack([ids[at + k] for k in range(n)])))
        shard = packing.shard(limbs[0], shards)
        cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield block, n, int(shard[a]), quotient.build(packing, [x[a:b] for x in limbs], counts[a:b])


def _frequent_words(words: DataFrame, min_count: int) -> DataFrame:
    """Words with at least ``min_count`` occurrences, numbered within their partition, in one sorted pass.

    Rows (``part``, ``place``, ``lang``, ``word``, ``f``) name a frequent word.  Rows (``part``, ``block``, ``codes``, ``places``) tell a block which of
    its codes are which words, many in a row.  A word is held back only until its count is reached, so one in very
    many blocks streams through.
    """
    schema = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64()),
                        ("block", pa.int64()), ("codes", pa.binary()), ("places", pa.binary())])
    null = lambda n, *fields: [pa.nulls(n, schema.field(f).type) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, numbered = TaskContext.get().partitionId(), 0
        going: tuple[str, str, int, int] | None = None  # a frequent word that may go on: language, word, place, count so far
        held: list[pa.RecordBatch] = []  # rows of a word that may still become frequent

        def named(rows: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
            lang, word, place, f = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array(place, pa.int64()), pa.array(lang, pa.string()),
                                               pa.array(word, pa.string()), pa.array(f, pa.int64()), *null(len(rows), "block", "codes", "places")], schema=schema)

        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # block, code and place of occurrences not yet handed on

        def occurrences() -> pa.RecordBatch:
            block, code, place = (np.concatenate(x) for x in zip(*found))
            found.clear()
            order = np.argsort(block, kind="stable")
            block, code, place = block[order], code[order].astype("<i4"), place[order].astype("<i8")
            cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))).tolist()
            spans = list(zip(cuts[:-1], cuts[1:]))
            return pa.RecordBatch.from_arrays([
                pa.array([part] * len(spans), pa.int32()), *null(len(spans), "place", "lang", "word", "f"), pa.array(block[cuts[:-1]]),
                pa.array([code[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([place[a:b].tobytes() for a, b in spans], pa.binary())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            lang, word, block, code, n = (table.column(c) for c in ("lang", "word", "block", "code", "n"))
            rows = table.num_rows
            new = np.concatenate(([True], pc.or_(pc.not_equal(word[1:], word[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False).astype(bool))) if rows > 1 else np.ones(1, bool)
            starts = np.flatnonzero(new)
            count = np.add.reduceat(n.to_numpy(), starts)
            key = lambda i: (lang[int(starts[i])].as_py(), word[int(starts[i])].as_py())
            place = np.full(len(starts), -1, np.int64)
            done = []
            if going and going[:2] == key(0):
                count[0] += going[3]
                place[0] = going[2]
            elif going:
                done.append(going)
            frequent = count >= min_count
            fresh = np.flatnonzero(frequent & (place < 0))
            place[fresh] = numbered + np.arange(len(fresh))
            numbered += len(fresh)
            often = np.flatnonzero(frequent)
            whole = often[often < len(starts) - 1]  # the last run may go on in the next batch
            at = pa.array(starts[whole])
            done += zip(lang.take(at).to_pylist(), word.take(at).to_pylist(), place[whole].tolist(), count[whole].tolist())
            last = len(starts) - 1
            going = (*key(last), int(place[last]), int(count[last])) if frequent[last] else None
            held = [] if going else table.slice(int(starts[last])).to_batches()
            if done:
                yield named(done)
            size = np.diff(np.append(starts, rows))
            each = np.repeat(place, size)
            kept = np.flatnonzero(np.repeat(frequent, size))
            if len(kept):
                found.append((block.to_numpy()[kept], code.to_numpy()[kept], each[kept]))
                if sum(len(f[0]) for f in found) > _OCCURRENCES:
                    yield occurrences()
        if found:
            yield occurrences()
        if going:
            yield named([going])

    return words.select("lang", "word", "block", "code", "n").repartition("lang", "word").sortWithinPartitions("lang", "word").mapInArrow(
        run, "part int, place bigint, lang string, word string, f bigint, block bigint, codes binary, places binary")


_FILTER_SCHEMA = "block bigint, words int, shard int, filter binary"


def _table(rows: list[tuple], more: list[tuple[str, pa.DataType]] = ()) -> pa.Table:
    schema = pa.schema([("block", pa.int64()), ("words", pa.int32()), ("shard", pa.int32()), ("filter", pa.binary()), *more])
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _merged(filters: DataFrame, min_count: int, shards: int, blocks: bool) -> DataFrame:
    """Sums of the filters of each (order, shard): rows ``words``, ``ids``, ``a`` of the frequent n-grams.

    With ``blocks``, also one row (``block``, ``keys``) for every block of a shard, the block's own frequent
    keys, so that a block learns them without a table of all of them.  A key occurs once in a
    block's filter, so no key is hot; a task holds one shard at a time.
    """
    schema = pa.schema([("block", pa.int64()), ("words", pa.int32()), ("ids", pa.list_(pa.int64())), ("a", pa.int64()), ("keys", pa.binary())])

    def close(words: int, owners: list[int], blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        packing, limbs, counts = quotient.merge(blobs)
        good = counts >= min_count
        limbs, counts = [x[good] for x in limbs], counts[good]
        n = len(counts)
        if not n:
            return
        ids = np.stack(packing.unpack(packing.restore(limbs)), axis=1).ravel()
        yield pa.RecordBatch.from_arrays([
            pa.nulls(n, pa.int64()), pa.array(np.full(n, words, np.int32)),
            pa.ListArray.from_arrays(pa.array(np.arange(0, words * n + 1, words, dtype=np.int32)), pa.array(ids)), pa.array(counts), pa.nulls(n, pa.binary())], schema=schema)
        if blocks:
            frequent = _one_key(packing, limbs)
            for owner, blob in zip(owners, blobs):
                own = _one_key(packing, quotient.read(blob)[1])
                own = own[np.isin(own, frequent, assume_unique=True)]
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array([owner]), *[pa.nulls(1, f.type) for f in schema][1:4], pa.array([own.tobytes()], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, owners, blobs = None, [], []
        for batch in batches:
            for block, words, shard, blob in zip(*[c.to_pylist() for c in batch.columns]):
                if (words, shard) != now:
                    if blobs:
                        yield from close(now[0], owners, blobs)
                    now, owners, blobs = (words, shard), [], []
                owners.append(block)
                blobs.append(blob)
        if blobs:
            yield from close(now[0], owners, blobs)

    return filters.repartition(shards, "words", "shard").sortWithinPartitions("words", "shard", "block").mapInArrow(
        run, "block bigint, words int, ids array<bigint>, a bigint, keys binary")


def _one_key(packing: quotient.Packing, limbs: list[np.ndarray]) -> np.ndarray:
    """Two limbs of a pair of words, at most 64 bits, as one number."""
    return (limbs[0] << np.uint64(packing.widths[1])) | limbs[1]


def _joined(table: pa.Table, column: str) -> bytes:
    return b"".join(table.column(column).to_pylist())


def frequent_ngrams(docs: DataFrame, min_count: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: vocabulary (``lang``, ``word``, ``f``, ``id``), n-grams (``words``, ``ids``, ``a``), totals (``lang``, ``n``).

    The vocabulary holds the words, the n-grams the phrases of 2 to ``longest`` words, with at least ``min_count`` occurrences.
    An n-gram cannot occur more often than a part of it, so words below the count end a run, pairs are counted first
    and longer n-grams only where all their pairs are frequent; nothing that can pass is left out.
    Corpus, words and filters are shuffled; no table of words or n-grams goes to the driver or to every task.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = stored(_coded_blocks(docs), "phrases-coded")
    words = coded.where("codes IS NULL").select("block", "lang", "word", "code", "n")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    found_words = stored(_frequent_words(words, min_count), "phrases-words")
    named = found_words.where("f IS NOT NULL")
    sizes = dict(named.groupBy("part").agg(F.max("place") + 1).collect())  # one number a partition
    before = np.zeros(max(sizes, default=0) + 1, np.int64)
    for p in range(1, len(before)):
        before[p] = before[p - 1] + sizes.get(p - 1, 0)
    vocabulary = named.select("lang", "word", "f", (F.get(F.lit(before), F.col("part")) + F.col("place") + 1).alias("id"))
    bits = max(sum(sizes.values()).bit_length(), 1)
    quotient.Packing(longest, bits)  # refuses more words than it can number
    names = found_words.where("f IS NULL").select("block", "part", "codes", "places")

    def pairs(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        codes = np.frombuffer(_joined(left, "codes"), np.int32)
        number = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
        for part, own, places in zip(*[right.column(c).to_pylist() for c in ("part", "codes", "places")]):
            number[np.frombuffer(own, "<i4")] = before[part] + np.frombuffer(places, "<i8") + 1
        ids = number[codes]
        ids = ids[np.concatenate(([True], (ids[1:] != 0) | (ids[:-1] != 0)))] if len(ids) else ids  # one break is as good as many
        rows = list(_filters(ids, (ids[:-1] != 0) & (ids[1:] != 0), range(2, 3), bits, shards, key[0].as_py()))
        return _table([*[(*r, None) for r in rows], (key[0].as_py(), None, None, None, ids.astype("<u4").tobytes())], [("ids", pa.binary())])

    numbered = stored(reread(coded).where("codes IS NOT NULL").select("block", "codes").groupBy("block").cogroup(names.groupBy("block")).applyInArrow(
        pairs, _FILTER_SCHEMA + ", ids binary"), "phrases-pairs")
    found = stored(_merged(numbered.where("filter IS NOT NULL").drop("ids"), min_count, shards, True), "phrases-frequent")

    def longer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.sort(np.frombuffer(_joined(right, "keys"), np.uint64))
        ids = np.frombuffer(_joined(left, "ids"), "<u4").astype(np.int64)
        if not len(keys) or len(ids) < 3:
            return _table([])
        usable = (ids[:-1] != 0) & (ids[1:] != 0)
        at = np.flatnonzero(usable)
        packing = quotient.Packing(2, bits)
        own = _one_key(packing, packing.permute(packing.pack([ids[at], ids[at + 1]])))
        usable[at] = keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own
        return _table(list(_filters(ids, usable, range(3, longest + 1), bits, shards, key[0].as_py())))

    grams = found.where("keys IS NULL").select("words", "ids", "a")
    if longest > 2:
        wider = reread(numbered).where("filter IS NULL").select("block", "ids").groupBy("block").cogroup(
            found.where("keys IS NOT NULL").select("block", "keys").groupBy("block")).applyInArrow(longer, _FILTER_SCHEMA)
        grams = grams.unionAll(stored(_merged(wider, min_count, shards, False), "phrases-longer").select("words", "ids", "a"))
    return vocabulary, grams, totals


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def collocations(docs: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000, cover_percent: int = 100) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the best phrases of each language.

    Texts are lower-cased (A-Z), cut into pieces at sentence marks and line breaks and these into words at blanks
    and tabs; phrases stay within a piece.  ``a`` counts a phrase's occurrences, ``l`` and ``r`` those of the two parts of
    its weakest cut (the earliest of equals), ``n`` the words of the language; the score is
    floor(1000 a n / (l r)), worked out in decimals of 38 digits.  A phrase inside a longer one that has at least
    ``cover_percent`` in 100 of its occurrences is left out.  The ``top`` of a language is a report; ties go to the more frequent, then to
    the phrase first in byte order.

    A null language is ``und``, a null text empty; a text repeated in several rows counts each time; identifiers and extra
    columns are not used; an empty table gives an empty result.
    """
    vocabulary, grams, totals = frequent_ngrams(docs, min_count, longest)
    counts = grams.select("ids", "a").unionAll(vocabulary.select(F.array("id"), "f"))
    own = grams.join(vocabulary.select(F.col("id").alias("_first"), "lang"), F.get("ids", F.lit(0)) == F.col("_first")).join(
        totals.hint("merge"), "lang").select("lang", "words", "ids", "a", "n")
    part = lambda side: counts.select(F.col("ids").alias(f"_{side}"), F.col("a").alias(side)).hint("merge")
    cuts = own.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "*", F.slice("ids", F.lit(1), F.col("k")).alias("_l"), F.slice("ids", F.col("k") + 1, F.col("words") - F.col("k")).alias("_r"))
    # an integral division of decimals keeps 38 digits on both sides; the result is at most ten times n
    cuts = cuts.join(part("l"), "_l").join(part("r"), "_r").withColumn("_above", (_exact("a") * _exact("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"))
    cuts = cuts.withColumn("_below", _exact("l") * _exact("r")).withColumn("score", F.expr("CAST(_above AS DECIMAL(38,0)) div CAST(_below AS DECIMAL(38,0))"))
    scored = cuts.groupBy("ids", "lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
    inside = grams.where("words > 2").select("a", "ids", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("_size")).select(
        "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - F.col("_size") + 1), lambda s: F.slice("ids", s, F.col("_size")))).alias("ids"))
    cover = inside.groupBy("ids").agg(F.max("a").alias("_cover"))
    kept = scored.join(cover.hint("merge"), "ids", "left").where(F.col("_cover").isNull() | (100 * F.col("_cover") < cover_percent * F.col("a")))
    spelled = kept.select("ids", F.posexplode("ids").alias("_at", "id")).join(vocabulary.select("id", "word").hint("merge"), "id").groupBy("ids").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return kept.join(spelled.hint("merge"), "ids").select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score").withColumn(
        "rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
