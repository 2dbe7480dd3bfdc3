"""Best-fit packing of tokenized documents in bulk-synchronous rounds."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlloom.llm.common import discard, stored
from sqlloom.llm.quality import text_parts

_KNOWN_WORDS = 250_000  # words kept in a worker with their ids; beyond them, only those of the texts at hand stay
_RANGE_ROWS = 50_000  # slots and pieces of a range, which one task holds
_WORDS_A_CALL = 200
_TEXT_BYTES = 1 << 20  # text encoded at once
#: Marks at the end of a word, behind a letter that stays one letter in lower case (U+0130 does not).
_MARKED = r"([a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}])([!-/:-@\[-`{-~]+)([ \t\n\v\f\r]|$)"
_ENCODERS: dict[int, WordEncoder] = {}


class WordEncoder:
    """Ids of words by a tokenizer that never merges across ASCII white space, remembered from text to text."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of many workers only wait for each other
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        probe = "Ab c,d. e\tf,g h!?"  # what the words below rely on
        if self.tokenizer.encode(probe, add_special_tokens=False).ids != [
                i for part in ("ab", "c", ",", "d", ".", "e", "f", ",", "g", "h", "!?") for i in self.tokenizer.encode(part, add_special_tokens=False).ids]:
            raise ValueError("this tokenizer merges across white space or marks, or tells capitals apart")
        self.plain = Tokenizer(self.tokenizer.model)  # the same merges; words of a-z need no normalizer, and their bytes are their letters
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _learn(self, words: list[str]) -> None:
        letters = [w for w in words if w.isalpha()]  # each is one token of the pre-tokenizer, so many go in one call
        plain = [w for w in letters if w.isascii() and w.islower()]
        other = [w for w in letters if not (w.isascii() and w.islower())]
        for encoder, own in ((self.plain, plain), (self.tokenizer, other)):
            groups = [own[i:i + _WORDS_A_CALL] for i in range(0, len(own), _WORDS_A_CALL)]
            for group, e in zip(groups, encoder.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                ends = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)
                if len(ends) == len(group):
                    raw, ends = ids.tobytes(), ends.tolist()
                    self.known.update(zip(group, map(raw.__getitem__, map(slice, [0, *ends], ends))))
        rest = [w for w in words if w not in self.known]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def _encoded(self, texts: pa.Array) -> Iterator[bytes]:
        low = pa.compute.replace_substring_regex(pa.compute.ascii_lower(texts), _MARKED, r"\1 \2\3")  # such marks are tokens of their own
        low = pa.compute.if_else(pa.compute.match_substring(texts, "<|"), texts, low)  # the tokenizer lower-cases all but special tokens
        split = pa.compute.ascii_split_whitespace(low)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, distinct))
        missing = [w for w, ids in zip(distinct, found) if ids is None]
        if missing:
            self._learn(missing)
            found = list(map(self.known.__getitem__, distinct))
        if len(self.known) > _KNOWN_WORDS:
            self.known = {"": b"", **dict(zip(distinct, found))}
        ids = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = words.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        taken = ids[np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - n), n) + np.arange(n.sum())].tobytes()
        bounds = (4 * np.append(0, ends)[split.offsets.to_numpy() - split.offsets[0].as_py()]).tolist()
        yield from (taken[a:b] for a, b in zip(bounds, bounds[1:]))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit words; texts are split, and new words looked up, many at a time."""
        for i, j in text_parts(texts, _TEXT_BYTES):
            yield from self._encoded(pa.compute.fill_null(texts[i:j], ""))


def _encoder(definition: str) -> WordEncoder:
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(definition)
    return _ENCODERS[key]


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``.

    A document is its ids followed by ``end_id``; only a longer one than ``capacity`` is cut.  A null text is empty.
    """
    with open(tokenizer, encoding="utf-8") as f:
        box = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(box.value)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Successor sweep over one range of gaps and documents, the largest first.

    Gaps open a level and documents close the innermost one, so a document gets the smallest gap that is
    still free and not smaller than it.  What finds no partner in this range is numbered for the others.
    """
    held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
    if not held:
        return
    size, kind, ident = map(np.concatenate, zip(*held))
    depth = np.cumsum(np.where(kind == 0, 1, -1))
    level = depth + (kind == 1)
    order = np.argsort(level, kind="stable")
    pair = (level[order[1:]] == level[order[:-1]]) & (kind[order[:-1]] == 0) & (kind[order[1:]] == 1)
    gap, doc = order[:-1][pair], order[1:][pair]
    free = np.ones(len(size), bool)
    free[gap] = free[doc] = False
    rest = np.flatnonzero(free)
    rank = np.empty(len(rest), np.int64)
    for k in (0, 1):
        own = kind[rest] == k
        rank[own] = np.arange(own.sum())
    part = TaskContext.get().partitionId()
    n = len(gap)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([np.full(n, 2), kind[rest]]).astype(np.int32)), pa.array(np.concatenate([ident[doc], ident[rest]])),
        pa.array(np.concatenate([ident[gap], ident[rest]])), pa.array(np.concatenate([size[doc], size[rest]])),
        pa.array(np.full(n + len(rest), part, np.int32)), pa.array(np.concatenate([np.zeros(n, np.int64), rank]))],
        names=["kind", "item", "seq", "length", "part", "rank"])


def _runs_between_ranges(counts: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int, int]]:
    """Matches left-over documents of a range with left-over gaps of earlier ranges, the nearest first, as runs of ranks."""
    stack: list[list[int]] = []
    runs = []
    for part in sorted({p for p, _ in counts}):
        waiting, at = counts.get((part, 1), 0), 0
        while waiting and stack:
            source = stack[-1]
            take = min(waiting, source[1])
            runs.append((len(runs), part, at, source[0], source[1] - 1, take))
            at, waiting, source[1] = at + take, waiting - take, source[1] - take
            if not source[1]:
                stack.pop()
        if counts.get((part, 0)):
            stack.append([part, counts[part, 0]])
    return runs


def _matched(slots: DataFrame, docs: DataFrame, rows: int) -> DataFrame:
    """``item``, ``seq``, ``length`` of one round: every document that a slot is left for gets the smallest such slot.

    ``rows`` counts both; ranges hold as many at every size, so there are more of them for larger tables.
    """
    spark = docs.sparkSession
    parts = -(-rows // _RANGE_ROWS)
    both = slots.select("size", F.lit(0).alias("kind"), F.col("seq").alias("id")).unionAll(
        docs.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.col("item").alias("id")))
    order = [F.desc("size"), F.asc("kind"), F.asc("id")]
    swept = stored(both.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        _sweep, "kind int, item bigint, seq bigint, length bigint, part int, rank bigint"), "pack-swept")
    counts = {(r["part"], r["kind"]): r["n"] for r in swept.where("kind < 2").groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = _runs_between_ranges(counts)  # at most two for each range
    near = swept.where("kind = 2").select("item", "seq", "length")
    if runs:
        names = ["run", "d_part", "d_from", "g_part", "g_top", "n"]
        table = F.broadcast(spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*runs)], names=names)))  # rows would start Python tasks
        docs_left = swept.where("kind = 1").join(table, (F.col("part") == F.col("d_part")) & (F.col("rank") >= F.col("d_from")) & (
            F.col("rank") < F.col("d_from") + F.col("n"))).select("run", (F.col("rank") - F.col("d_from")).alias("place"), "item", "length")
        gaps_left = swept.where("kind = 0").join(table, (F.col("part") == F.col("g_part")) & (F.col("rank") <= F.col("g_top")) & (
            F.col("rank") > F.col("g_top") - F.col("n"))).select("run", (F.col("g_top") - F.col("rank")).alias("place"), "seq")
        near = near.unionAll(docs_left.join(gaps_left.hint("merge"), ["run", "place"]).select("item", "seq", "length"))
    found = stored(near, "pack-matched")
    discard(swept)
    return found


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of ``length`` 1 to ``capacity``, in as few sequences as best fit finds.

    Bulk-synchronous best fit: pieces over half the capacity open a sequence each.  The others follow by size
    class, the larger first.  In a round, the free gaps are cut into slots that hold any piece of the class,
    pieces and slots are range-sorted together, each range is swept for the smallest fitting slot, ranges exchange
    counts of what is left over (the driver sees two numbers a range), and the gaps shrink by what
    they got.  Sequences are opened when the gaps cannot hold the rest; rounds repeat until the class is placed.  Once a round leaves
    slots empty, no waiting piece fits them, so the next one opens sequences for all: a few rounds a class, whatever the lengths.

    Ties (equal lengths) are resolved by rank, repeated rows are placed one by one, and no piece is cut further.
    ``row`` holds the input columns, so names cannot clash; an empty table gives an empty result.
    """
    spark = pieces.sparkSession
    items = stored(pieces.select(F.struct("*").alias("row"), F.col("length").cast("bigint").alias("length"), F.monotonically_increasing_id().alias("item")), "pack-items")
    opening = items.where(F.col("length") * 2 > capacity)
    placed = [opening.select("item", F.col("item").alias("seq"))]
    gaps = stored(opening.where(F.col("length") < capacity).select(F.col("item").alias("seq"), (capacity - F.col("length")).alias("gap")), "pack-gaps")
    opened, high = 0, capacity // 2
    while high >= 1:
        low = high // 2 if high > capacity // 16 else 0
        docs = stored(items.where((F.col("length") > low) & (F.col("length") <= high)).select("item", "length"), "pack-class")
        n, total, least = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.min("length")).first()
        turn, done, slots_left, each = 0, 0, False, capacity // high
        while n:
            k = F.greatest(F.floor(F.col("gap") / high), F.lit(1)).cast("int")
            # a gap below the smallest piece is no place for any
            room, places = gaps.where(F.col("gap") >= least).agg(F.coalesce(F.sum("gap"), F.lit(0)), F.coalesce(F.sum(k), F.lit(0))).first()
            if turn == 0 or (turn == 1 and done):  # at first as few sequences as the tokens need
                new = -(-max(0, total - room) // capacity)
            elif slots_left:  # no piece fits what was left, so all get a place
                new = -(-n // each)
            else:
                new = -(-max(0, n - places) // each)
            new = max(new, not places)
            fresh = spark.range(opened, opened + new).select((-F.col("id") - 1).alias("seq"), F.lit(capacity).cast("bigint").alias("gap"))
            opened, turn = opened + new, turn + 1
            usable = gaps.where(F.col("gap") >= least).unionAll(fresh)
            slots = usable.select("seq", F.explode(F.concat(
                F.array(F.col("gap") - (k - 1) * high), F.array_repeat(F.lit(high).cast("bigint"), k - 1))).alias("size"))
            found = _matched(slots, docs, n + places + new * each)
            used = found.groupBy("seq").agg(F.sum("length").alias("used"))
            shrunk = gaps.unionAll(fresh).join(used.hint("merge"), "seq", "left").select("seq", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
            following = stored(shrunk.where("gap > 0"), "pack-gaps")
            placed.append(found.select("item", "seq"))
            done, filled = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
            n, total, slots_left = n - done, total - filled, done < places + new * each
            rest = stored(docs.join(found.select("item").hint("merge"), "item", "left_anti"), "pack-class") if n else docs
            discard(gaps)
            if n:
                discard(docs)
                least = rest.agg(F.min("length")).first()[0]
            gaps, docs = following, rest
        discard(docs)
        high = low
    place = reduce(DataFrame.unionAll, placed)
    before = Window.partitionBy("seq").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)  # at most `capacity` pieces
    return items.join(place.hint("merge"), "item").select(
        "row", F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    Null and empty texts are the end id alone; repeated rows and null identifiers are packed like others; extra columns
    are not carried.
    """
    packed = pack(tokenized_pieces(docs, tokenizer, capacity, with_ids=with_ids), capacity)
    return packed.select("row.*", "sequence_id", "offset")


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Sequences used, and the number that the tokens would need at least."""
    return packed.agg(F.countDistinct("sequence_id").alias("sequences"), F.ceil(F.sum("length") / capacity).alias("least"))

