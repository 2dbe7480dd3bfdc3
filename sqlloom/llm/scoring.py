"""Language-model scores of whole texts by n-gram tries over tokens and, inside tokens, over bytes; exact token counts of the training texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.llm.common import discard, numbered_rows, stored, utf8
from sqlloom.llm.quality import added, discounts, fit, word_grams
from sqlloom.llm.trie import PairTrie, Trie, build

_END = b"\x03"  # the end of a text, as the trie of bytes spells it
_EDGE = 0  # the end of a text, and what stands before its first word, in pairs; words are numbered from 1
_TOKENS = 2 << 20  # of a block
_WORDS = 300_000  # distinct, of a block
_SHARD = 4 << 20  # tokens whose pairs make up a shard
_TRIES: dict[int, Trie] = {}
_BLOCK = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("tokens", pa.binary()),
                    ("words", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("n_ends", pa.int64())])
_CODED = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n_known", pa.list_(pa.int64())),
                    ("base_score", pa.list_(pa.float64())), ("sizes", pa.binary()), ("tokens", pa.binary()), ("ids", pa.binary()), ("c", pa.binary()), ("own", pa.binary())])
_CHUNK = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("n", pa.binary())])
_ANSWER = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("n", pa.binary()), ("kinds", pa.binary()), ("seen", pa.list_(pa.int64())), ("hot", pa.list_(pa.int64()))])


def packed(values: np.ndarray) -> bytes:
    """Numbers, the first bytes of all before the second bytes of all, compressed."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as numbers of words in order of appearance, with the words and their counts in training texts; a block ends at a text."""
    number = TaskContext.get().partitionId() << 32

    def start() -> tuple:
        index: defaultdict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        return index, [], [], [], 0

    def emit() -> pa.RecordBatch:
        sizes = np.fromiter(map(len, texts), np.int32, len(texts))
        tokens = np.concatenate(texts)
        n = np.bincount(tokens[~np.repeat(np.array(held, bool), sizes)], minlength=len(index))
        row = (number, ids, held, packed(sizes), packed(tokens), [w.decode("utf-8") for w in index], n, len(tokens) + len(texts), len(held) - sum(held))
        return _batch([row], _BLOCK)

    index, ids, held, texts, size = start()
    for batch in batches:
        for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            words = utf8(text.as_py()).lower().split()
            texts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
            ids.append(doc_id)
            held.append(out)
            size += len(words) + 1
            if size >= _TOKENS or len(index) >= _WORDS:
                yield emit()
                number += 1
                index, ids, held, texts, size = start()
    if texts:
        yield emit()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [w.encode("utf-8") for w in batch.column(0).to_pylist()]
        if words:
            codes, first = word_grams(words)
            times = np.repeat(batch.column(1).to_numpy(), np.diff(np.concatenate((first, [len(codes)]))))
            seen, inverse = np.unique(codes, return_inverse=True)
            total = np.zeros(len(seen), np.int64)
            np.add.at(total, inverse, times)
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(seen), pa.string()), pa.array(seen), pa.array(total)], names=["lang", "code", "n"])


def word_scores(trie: Trie, words: list[bytes]) -> np.ndarray:
    """Log10 probability of each word with its boundary; equal n-grams are looked up once."""
    if not words:
        return np.zeros(0)
    codes, first = word_grams(words)
    seen, inverse = np.unique(codes, return_inverse=True)
    return np.add.reduceat(trie.log10(seen)[inverse], first)


def token_scores(counts: np.ndarray, spelled: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """Witten-Bell: (count + kinds * trie probability) / (total + kinds), in log10; the trie alone without training tokens."""
    if not total:
        return spelled
    with np.errstate(divide="ignore"):
        seen = np.log(counts)
    return (np.logaddexp(seen, np.log(kinds) + spelled * np.log(10)) - np.log(total + kinds)) / np.log(10)


def pair_scores(n: np.ndarray, before: np.ndarray, kinds: np.ndarray, lower: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Log10 probability of a token behind another: its count less a discount, and what all discounts of the context free times ``lower``.

    ``n`` counts the pair, ``before`` the context, ``kinds`` (three columns) the context's followers seen once, twice and more
    often; ``lower`` is the token's log10 probability without context, which stands alone behind a context never seen.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.log((n - cut[np.minimum(n, 3)]) / before)
        free = np.log(kinds @ cut[1:] / before)
        return np.where(before > 0, np.logaddexp(own, free + lower * np.log(10)) / np.log(10), lower)


class Deal:
    """Which shard holds a pair: its context's, or for a context with more than a shard's tokens, one of several by its follower."""

    def __init__(self, shards: int, hot: dict[int, int]):
        self.shards = shards
        self.hot = np.array(sorted(hot), np.uint64)  # fewer than there are shards
        self.spread = np.array([hot[x] for x in sorted(hot)], np.uint64)

    def place(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the hot contexts, and whether the context is one."""
        at = np.minimum(np.searchsorted(self.hot, ids), max(len(self.hot) - 1, 0))
        return at, self.hot[at] == ids if len(self.hot) else np.zeros(len(ids), bool)

    def __call__(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        def mixed(x: np.ndarray) -> np.ndarray:
            return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)

        at, hit = self.place(first)
        shard = mixed(first)
        shard[hit] += mixed(second[hit]) % self.spread[at[hit]]
        return (shard % np.uint64(self.shards)).astype(np.int32)


class Pairs:
    """The neighbouring tokens of a block: distinct pairs by shard, those with a counted context first asked for."""

    def __init__(self, row: dict, deal: Deal, ends: int):
        ids, c = unpacked(row["ids"], np.uint32), unpacked(row["c"], np.int64)
        sizes, tokens = unpacked(row["sizes"], np.int32), unpacked(row["tokens"], np.int32)
        stops = np.cumsum(sizes + 1, dtype=np.int64) - 1
        inner = np.ones(len(tokens) + len(sizes), bool)
        inner[stops] = False
        at = np.full(len(inner), len(ids), np.int32)  # one behind the words stands for the edge
        at[inner] = tokens
        before = np.concatenate((at[-1:], at[:-1]))  # the last token of a block is an end
        ids, self.c = np.append(ids, np.uint32(_EDGE)), np.append(c, ends)
        codes, place, self.inverse = np.unique(ids[before].astype(np.uint64) << np.uint64(32) | ids[at], return_index=True, return_inverse=True)
        self.starts, self.at, self.before = stops - sizes, at[place], self.c[before[place]]
        train = np.repeat(~np.array(row["held_out"], bool), sizes + 1)
        self.n = np.bincount(self.inverse[train], minlength=len(codes))
        self.first, self.second = codes >> np.uint64(32), codes & np.uint64((1 << 32) - 1)
        shard, asked = deal(self.first, self.second), np.flatnonzero(self.before > 0)
        self.order = asked[np.argsort(shard[asked], kind="stable")]
        self.shard = shard[self.order]
        self.cuts = np.flatnonzero(np.append(True, self.shard[1:] != self.shard[:-1])[:len(self.shard)])

    def chunks(self) -> Iterator[tuple[int, np.ndarray]]:
        """Shards, ascending, and their pairs, ascending."""
        for i, j in zip(self.cuts, np.append(self.cuts[1:], len(self.order))):
            yield int(self.shard[i]), self.order[i:j]


def _starts(first: np.ndarray) -> np.ndarray:
    return np.append(True, first[1:] != first[:-1])[:len(first)]


def _answer(chunks: pa.Table, deal: Deal) -> pa.Table:
    """A shard: counts of its pairs over all blocks in a trie, and for each block the counts and contexts that it asked for."""
    asked = [(np.cumsum(unpacked(a, np.uint64), dtype=np.uint64), unpacked(b, np.uint32).astype(np.uint64), unpacked(n, np.int64))
             for a, b, n in zip(*(chunks[x].to_pylist() for x in ("first", "second", "n")))]
    codes, n = added([((a << np.uint64(32) | b)[n > 0], n[n > 0]) for a, b, n in asked])
    trie = PairTrie(codes >> np.uint64(32), codes & np.uint64((1 << 32) - 1), n)
    shard, rows = chunks["shard"][0].as_py(), []
    for block, (a, b, _) in zip(chunks["block"].to_pylist(), asked):
        rows.append((shard, block, packed(trie.counts(a, b)), packed(trie.kinds(a[_starts(a)]).ravel()), None, None))
    hot = trie.contexts[deal.place(trie.contexts)[1]]
    parts = np.column_stack((hot.astype(np.int64), trie.kinds(hot))).ravel()
    rows.append((shard, None, None, None, [int((n == k).sum()) for k in (1, 2, 3, 4)], parts))
    return pa.Table.from_batches([_batch(rows, _ANSWER)])


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every document.

    Tokens are the words of the lower-cased (A-Z) text and one end.  ``base_score`` uses exact counts of all training
    tokens; ``score`` is the log10 probability of the text by an interpolated model of two tries.  A token is read
    behind the token before it (the first one behind the edge of the text): exact counts of all pairs, none left out, less
    modified Kneser-Ney discounts; what these free goes to the token without context.  That one has the Witten-Bell
    share of unseen events spelled by a Kneser-Ney trie of byte 5-grams inside tokens, the rest going to exact
    counts.  Both tries have Elias-Fano pointers; probabilities without context are kept to 24 bits.

    The texts become blocks of some two million tokens, numbered as the block met its words.  Counts are added up by
    word over the whole corpus, and each block gets back number, count and probability of just its words, so the
    vocabulary is never in one place.  Then each block deals its distinct pairs to shards by context, those of
    frequent contexts to several; a shard adds up the pairs of all blocks, puts them into a trie and answers each block in
    the order it asked.  The trie of bytes, whose size the number of byte 5-grams bounds, is broadcast and memory-mapped;
    the driver sees for each shard its numbers of rare pairs and of the followers of contexts that several shards hold.

    A null text is empty and scores its end; a null ``doc_id`` is held out only if the expression says so; repeated
    rows are repeated texts; extra columns are ignored; an empty table gives an empty result.  Without training
    texts all counts are zero and the trie is uniform over bytes.  More than 2^32 - 1 distinct words are refused.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    blocks = stored(texts.mapInArrow(_blocks, "block bigint, doc_id array<bigint>, held_out array<boolean>, sizes binary, tokens binary, "
                                              "words array<string>, n array<bigint>, n_tokens bigint, n_ends bigint"), "score-blocks")
    found = blocks.select("block", F.posexplode(F.arrays_zip("words", "n")).alias("at", "w")).select(F.col("w.words").alias("word"), F.col("w.n").alias("n"), "block", "at")
    # a word comes with one entry for each block
    words = stored(found.groupBy("word").agg(F.sum("n").alias("c"), F.collect_list(F.struct("block", "at")).alias("places")), "score-words")
    sizes = blocks.agg(F.coalesce(F.sum("n_ends"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count(F.lit(1))).first()
    ends, shards = int(sizes[0]), -(-max(int(sizes[1]), 1) // _SHARD)
    total, kinds = int(sums[0]) + ends, int(sums[1]) + (ends > 0)
    if sums[2] >= 1 << 32:
        raise ValueError(f"{sums[2]} distinct words do not fit numbers of 32 bits")
    grams = words.where("c > 0").select("word", "c").mapInArrow(_grams, "lang string, code bigint, n bigint")
    counted = grams.unionAll(_ending(spark, ends)).groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    trie = build(fit(counted))
    box = spark.sparkContext.broadcast(trie)
    end = token_scores(np.array([ends]), word_scores(Trie(trie), [_END]), total, kinds)
    numbered = numbered_rows(words)
    spread = {r.id: 1 + r.c // _SHARD for r in numbered.where(F.col("c") >= _SHARD).select("id", "c").collect()}  # fewer than shards
    deal = Deal(shards, spread | ({_EDGE: 1 + ends // _SHARD} if ends >= _SHARD else {}))
    base_all, base_end, known_end = float(total + kinds + 1), float(np.log10((ends + 1) / (total + kinds + 1))), int(ends > 0)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Probabilities of words without context."""
        trie = _trie(box.value)
        for batch in batches:
            own = token_scores(batch.column(1).to_numpy(), word_scores(trie, [w.encode("utf-8") for w in batch.column(0).to_pylist()]), total, kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(own.astype(np.float32))], names=["c", "id", "places", "own"])

    def coded(texts: pa.Table, asked: pa.Table) -> pa.Table:
        row, at = texts.to_pylist()[0], asked["at"].to_numpy()
        ids, c, own = np.zeros(len(at), np.uint32), np.zeros(len(at), np.int64), np.zeros(len(at), np.float32)
        ids[at], c[at], own[at] = asked["id"].to_numpy(), asked["c"].to_numpy(), asked["own"].to_numpy()
        base, known = np.log10((c + 1) / base_all), c > 0
        sizes, tokens = unpacked(row["sizes"], np.int32), unpacked(row["tokens"], np.int32)
        parts = np.split(tokens, np.cumsum(sizes)[:-1])
        return pa.Table.from_batches([_batch([(row["block"], row["doc_id"], row["held_out"], [int(known[x].sum()) + known_end for x in parts],
                                               [float(base[x].sum()) + base_end for x in parts], row["sizes"], row["tokens"], packed(ids), packed(c), packed(own))], _CODED)])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                pairs = Pairs(row, deal, ends)
                yield _batch([(shard, row["block"], packed(np.diff(pairs.first[x], prepend=np.uint64(0))), packed(pairs.second[x].astype(np.uint32)), packed(pairs.n[x]))
                              for shard, x in pairs.chunks()], _CHUNK)

    asked = numbered.select("word", "c", "id", "places").mapInArrow(alone, "c bigint, id bigint, places array<struct<block:bigint,at:int>>, own float")
    asked = asked.select(F.inline("places"), "id", "c", "own")
    state = stored(blocks.select("block", "doc_id", "held_out", "sizes", "tokens").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(
        coded, "block bigint, doc_id array<bigint>, held_out array<boolean>, n_known array<bigint>, base_score array<double>, "
               "sizes binary, tokens binary, ids binary, c binary, own binary"), "score-coded")
    discard(blocks)
    discard(words)
    chunks = state.select("block", "held_out", "sizes", "tokens", "ids", "c").mapInArrow(ask, "shard int, block bigint, first binary, second binary, n binary")
    answers = stored(chunks.groupBy("shard").applyInArrow(
        lambda found: _answer(found, deal), "shard int, block bigint, n binary, kinds binary, seen array<bigint>, hot array<bigint>"), "score-answers")
    seen, hot = np.zeros(4, np.int64), np.zeros((len(deal.hot), 3), np.int64)
    for r in answers.where("block IS NULL").select("seen", "hot").collect():
        seen += r.seen
        parts = np.array(r.hot, np.int64).reshape(-1, 4)
        np.add.at(hot, deal.place(parts[:, 0].astype(np.uint64))[0], parts[:, 1:])
    cut = discounts(seen.tolist())

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        row, answers = texts.to_pylist()[0], answers.sort_by("shard")
        pairs = Pairs(row, deal, ends)
        n, followers = np.zeros(len(pairs.first), np.int64), np.zeros((len(pairs.first), 3), np.int64)
        if len(pairs.order):
            first = pairs.first[pairs.order]
            opens = _starts(first)
            opens[pairs.cuts] = True
            n[pairs.order] = np.concatenate([unpacked(x, np.int64) for x in answers["n"].to_pylist()])
            followers[pairs.order] = np.concatenate([unpacked(x, np.int64) for x in answers["kinds"].to_pylist()]).reshape(-1, 3)[np.cumsum(opens) - 1]
            at, hit = deal.place(pairs.first)
            followers[hit] = hot[at[hit]]
        lower = np.append(unpacked(row["own"], np.float32).astype(np.float64), end)[pairs.at]
        logs = np.add.reduceat(pair_scores(n, pairs.before, followers, lower, cut)[pairs.inverse], pairs.starts)
        sizes = unpacked(row["sizes"], np.int32).astype(np.int64) + 1
        return pa.table({"doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()), "n_tokens": sizes,
                         "n_known": pa.array(row["n_known"], pa.int64()), "train_tokens": np.full(len(sizes), total, np.int64),
                         "base_score": pa.array(row["base_score"], pa.float64()), "score": logs})

    return state.groupBy("block").cogroup(answers.where("block IS NOT NULL").select("shard", "block", "n", "kinds").groupBy("block")).applyInArrow(
        run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _ending(spark, ends: int) -> DataFrame:
    codes, _ = word_grams([_END])
    rows = [(None, int(x), ends) for x in codes] if ends else []
    return spark.createDataFrame(rows, "lang string, code bigint, n bigint")


def _trie(data: bytes) -> Trie:
    key = hash(data)
    if key not in _TRIES:
        _TRIES.clear()
        _TRIES[key] = Trie(data)
    return _TRIES[key]
