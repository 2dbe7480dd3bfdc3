"""The corpus operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import math
import random
import re
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sqlloom.llm import chat, langid, neighbours, packing, pieces, pii, quality, scoring, sharding, simhash
from sqlloom.llm import trie as tries
from sqlloom.llm.queries import QUERIES, piece_model, word_tokenizer

TEXTS = [
    "Write to a.b@c.org or call +1 (988) 555-2485 today, from 10.0.0.1 please.", None, "", "   \n", "one", "one",
    "The quick brown fox jumps over the lazy dog. " * 40, "The quick brown fox jumps over the lazy dog. " * 40, "x" * 5000,
    "4111 1111 1111 1111 é 😀 password=abc12345678", "<|im_start|>user <|im_end|>", "a@b.c@d.e 1.2.3.4.5.6.7.8 256.1.1.1",
]
SCHEMA = "doc_id long, text string, lang string, row string, shard int, spans string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "en" if i % 2 else "fr", "r", 1, "s") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[6]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing_against_the_tokenizer(spark, docs, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(word_tokenizer())
    rows = packing.pack_documents(docs, word_tokenizer(), 64).collect()
    wanted = []
    for r in docs.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [0]
        wanted += [(r.doc_id, p, at, len(ids[at:at + 64]), zlib.crc32(np.array(ids[at:at + 64], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), 64))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(wanted, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty, word_tokenizer(), 64).count() == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[7] = x[50]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(400, None, 0), (450, [0.0] * 8, 0), (500, [float("nan")] * 8, 0), (550, [1.0, None], 0), (None, [1.0] * 8, 0)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    found = {}
    for r in neighbours.nearest(df, lambda i: i % 50 == 0).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(found) == {0, 50, 100, 150, 200, 250}
    hits = 0
    x = x.astype(float)
    for q, near in found.items():
        score = x @ x[q] / np.sqrt((x * x).sum(1) * (x[q] @ x[q]))
        score[q] = -9
        top = set(np.argsort(-score)[:5].tolist())
        hits += len(top & {v for v, _ in near.values()})
        assert sorted(near) == [1, 2, 3, 4, 5] and all(abs(score[v] - s) < 1e-12 for v, s in near.values())
    assert hits >= 27
    assert neighbours.nearest(df.where("vec_id < 0"), lambda i: i % 50 == 0).count() == 0


def test_neighbours_recall_with_many_leaves(spark):
    x = np.random.default_rng(4).normal(size=(4000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    found = neighbours.nearest(df, lambda i: i % 50 == 0, visits=20, leaf_rows=16).collect()
    x = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    score = x[::50] @ x.T
    score[np.arange(80), np.arange(0, 4000, 50)] = -9
    top = {(50 * q, int(v)) for q, row in enumerate(np.argsort(-score, axis=1)[:, :5]) for v in row}
    assert len(top & {(r.query_id, r.vec_id) for r in found}) >= 0.9 * len(top)


def test_margins_give_the_order_of_the_queue():
    rng = np.random.default_rng(6)
    forest = [neighbours.grow_tree(rng.normal(size=(300, 6)), 8, rng) for _ in range(3)]
    for x in rng.normal(size=(5, 6)):
        flat = [(m, t, i) for t, tree in enumerate(forest) for i, m in enumerate(neighbours.leaf_margins(tree, x[None])[0])]
        margin = {(t, i): m for m, t, i in flat}
        visited = neighbours.search_leaves(forest, x, len(flat))
        assert [margin[v] for v in visited] == pytest.approx(sorted(m for m, *_ in flat)) and len(set(visited)) == len(flat)


def test_personal_data_against_plain_patterns(docs, empty):
    for r in pii.find_spans(docs).collect():
        line = ",".join(f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.spans if s.kind < 4)
        assert line == brute.base_row(r.row.text)[-1]
    assert "[EMAIL]" in pii.redact(docs).where("doc_id = 0").first().text and pii.redact(docs).columns == docs.columns
    assert pii.find_spans(empty).count() == 0


def test_fingerprints_against_a_plain_loop(docs, empty):
    from xxhash import xxh64_intdigest

    rows = simhash.near_duplicates(docs).collect()
    prints = {}
    for r in docs.collect():
        words = (r.text or "").lower().split()
        shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
        hashes = [xxh64_intdigest(s, 42) for s in shingles]
        prints[r.doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        reach, todo = {prints[r.doc_id]}, [prints[r.doc_id]]
        while todo:
            a = todo.pop()
            for b in set(prints.values()) - reach:
                if (a ^ b).bit_count() <= 3:
                    reach.add(b)
                    todo.append(b)
        assert r.component_id == min(i for i, p in prints.items() if p in reach and i is not None)
    assert len(rows) == len(TEXTS) + 1 and simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(docs).where("doc_id IN (4, 5, 6, 7)").count() == 2


def test_links_of_long_postings_against_all_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    fps = np.unique(np.array([int(b) ^ sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 4))) for b in rng.integers(0, 2**63, 2) for _ in range(60)], np.uint64))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    for _ in range(len(fps)):
        label = np.array([label[r].min() for r in near])
    byte = lambda p: (fps >> np.uint64(56 - 8 * p)) & np.uint64(255)
    key = np.concatenate([(np.uint64(c << 24) + (byte(i) << np.uint64(16)) + (byte(j) << np.uint64(8)) + byte(k)).astype(np.int64) for c, (i, j, k) in enumerate(simhash.POSTING_POSITIONS)])
    fp = np.tile(fps, len(simhash.POSTING_POSITIONS))
    order = np.lexsort((fp, key))
    for limit in (2048, 24):
        monkeypatch.setattr(simhash, "LONG_POSTING", limit)
        batches = [pa.RecordBatch.from_arrays([pa.array(key[order][a:a + 100]), pa.array(fp[order][a:a + 100].view(np.int64))], names=["key", "fp"]) for a in range(0, len(key), 100)]
        found = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64)) for b in simhash._links(iter(batches))]
        a, b = simhash.spanning(*map(np.concatenate, zip(*found)))
        root = dict(zip(a.tolist(), b.tolist()))
        assert [root.get(int(f), int(f)) for f in fps] == fps[label].tolist()


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a<|im_end|>\n<|im_start|>assistant\nb"), (1, 1, "assistant", "<\\|x|> <|"), (2, 0, None, None), (2, 0, None, None),
            (None, 5, "as%0Asistant\n", "x"), (3, None, "assistant", "😀é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(df).select("*", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    assert all(r.identical for r in out.values())
    assert [(t.role, t.text) for t in out[1].turns] == [(r[2], r[3]) for r in rows[:2]] and out[1].loss == "<\\|x|> <|" and out[1].escaped
    assert [(t.role, t.text) for t in out[2].turns] == [("", "")] * 2 and out[None].turns[0].role == rows[4][2]
    assert out[3].loss == "😀é" and not out[3].escaped and chat.format_conversations(df.where("turn > 9")).count() == 0


def test_pieces_against_the_library(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    coded = pieces.encode(docs, piece_model())
    for r in coded.collect():
        assert r.ids == sp.encode(r.row.text or "") and r.n_pieces == len(r.ids) and r.round_trip
    assert {(r.row.text or "") == r.text for r in pieces.decode(coded, piece_model()).collect()} == {True}
    assert pieces.encode(empty, piece_model()).count() == 0


def test_quality_spells_bounded_slices_of_words(monkeypatch):
    words = {b"w%d" % i: i % 5 + 1 for i in range(2 * quality._SLICE + 3)}
    codes, first = quality.word_grams(list(words))
    whole = quality.added([(codes, np.repeat(list(words.values()), np.diff(np.append(first, len(codes)))))])
    texts = pa.array([" ".join(w.decode() for w in words), None, "w1 w2 " * 20])
    sizes, spell = [], quality.word_grams
    monkeypatch.setattr(quality, "word_grams", lambda w: sizes.append(len(w)) or spell(w))
    found = quality.added(list(quality.spelled(words)))
    assert all(map(np.array_equal, found, whole))
    model = quality.fit(pa.table({"lang": pa.array([None] * len(whole[0]), pa.string()), "code": whole[0], "n": whole[1]}))
    rows, width, logs = quality.measure_texts(model, {None: 0}, [None] * 3, texts)
    assert max(sizes) == quality._SLICE
    assert [r[0] for r in rows] == [len(words), 0, 40] and width == [len(codes), 0, 120]
    assert logs == pytest.approx([model.log10(codes, 0).sum(), 0, 20 * model.log10(spell([b"w1", b"w2"])[0], 0).sum()])


def test_quality_texts_are_measured_in_parts():
    texts = pa.array(["x" * 1000, None] * 4000 + ["y" * (3 * quality._PART)] + ["z"] * 5)
    parts = list(quality.text_parts(texts))
    assert [i for i, _ in parts] == [0, *[j for _, j in parts[:-1]]] and parts[-1][1] == len(texts)
    assert max(sum(len(t or "") for t in texts[i:j].to_pylist()[1:]) for i, j in parts) <= quality._PART
    assert list(quality.text_parts(texts[:0])) == [(0, 0)]


def test_quality_counts_and_probabilities(docs, empty):
    for r in quality.quality(docs).collect():
        words = (r.row.text or "").split()
        windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r.base_failed and r.kept)
    assert quality.quality(empty).count() == 0


def test_copies_of_one_text_leave_the_band_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'de'").select("doc_id", "text", "lang")
    one = docs.where("length(text) BETWEEN 800 AND 1500").orderBy("doc_id").limit(1)
    copies = one.crossJoin(spark.range(3 * docs.count())).select((F.col("id") + 10**7).alias("doc_id"), "text", "lang")
    assert quality.distinct_texts(docs.unionAll(copies)).count() == docs.select("text").distinct().count()
    rows = lambda df: {r.doc_id: (r.kept, round(r.low, 9), round(r.high, 9)) for r in quality.quality(df).where("row.doc_id < 10000000").select("row.doc_id", "kept", "low", "high").collect()}
    alone = rows(docs)
    assert rows(docs.unionAll(copies)) == alone and sum(k for k, *_ in alone.values()) > 100
    assert all(high - low >= 0.2 - 1e-9 for _, low, high in alone.values())


def test_trie_holds_the_model():
    rng = np.random.default_rng(0)
    words = [bytes(rng.choice(list(b"abcd"), rng.integers(1, 7))) for _ in range(2000)]
    codes, n = np.unique(quality.word_grams(words)[0], return_counts=True)
    model = quality.fit(pa.table({"lang": pa.array([None] * len(codes), pa.string()), "code": codes, "n": n}))
    for context in codes[::97] >> 8:  # probabilities add up to one
        assert abs((10 ** model.log10((context << 8) | np.arange(256), 0)).sum() - 1) < 1e-4
    trie, asked = tries.Trie(tries.build(model)), np.concatenate([codes, codes ^ 1])
    assert np.abs(trie.log10(asked) - model.log10(asked, 0)).mean() < 0.02
    for v in (np.sort(rng.integers(0, 10**6, 500)), np.zeros(3, int), np.arange(70)):
        assert (tries.elias_fano_get(tries.elias_fano(v), np.arange(len(v))) == v).all()


def test_scores_against_plain_counts(docs, empty):
    from collections import Counter

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").lower().split(), None]
    rows = docs.collect()
    c = Counter(w for r in rows if not held(r.doc_id) for w in tokens(r.text))
    total, kinds = sum(c.values()), len(c)
    want = sorted((len(tokens(r.text)), sum(c[w] > 0 for w in tokens(r.text)), total, round(sum(np.log10((c[w] + 1) / (total + kinds + 1)) for w in tokens(r.text)), 6)) for r in rows)
    out = scoring.score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(np.isfinite(r.score) and r.score <= 0 for r in out)
    assert scoring.score(empty, F.lit(False)).count() == 0


def test_score_blocks_do_not_grow_with_input_partitions(spark):
    """A partition of 4.4 million tokens, some of them in texts with many distinct words, comes as several blocks."""
    one = spark.range(44, numPartitions=1).select(
        F.col("id").alias("doc_id"), (F.col("id") % 7 == 2).alias("held_out"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: (i % F.when(F.col("id") % 11 == 0, 100_000).otherwise(50)).cast("string")), " ").alias("text"))
    blocks = one.mapInArrow(scoring._blocks, "block bigint, doc_id array<bigint>, held_out array<boolean>, sizes binary, tokens binary, "
                                             "words array<string>, n array<bigint>, n_tokens bigint, n_ends bigint").collect()
    assert len(blocks) == len({b.block for b in blocks}) == 3 and sorted(i for b in blocks for i in b.doc_id) == list(range(44))
    assert all(b.n_tokens < scoring._TOKENS + 100_001 and len(b.words) < scoring._WORDS + 100_001 for b in blocks)
    assert sum(b.n_tokens for b in blocks) == 44 * 100_001 and sum(sum(b.n) + b.n_ends for b in blocks) == 100_001 * sum(i % 7 != 2 for i in range(44))
    for b in blocks:
        words = np.array(b.words)[scoring.unpacked(b.tokens, np.int32)]
        at = np.cumsum(scoring.unpacked(b.sizes, np.int32))
        assert all((w == [str(j % (50 if i % 11 else 100_000)) for j in range(100_000)]).all() for i, w in zip(b.doc_id, np.split(words, at[:-1])))


def test_scores_read_tokens_behind_the_token_before(spark, monkeypatch):
    """Against a plain model of pairs, over several blocks and shards, with contexts that several shards hold."""
    from collections import Counter

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a b", "b c d", "a", "e f", "g"]) if i % 3 else rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for i in range(60)]
    texts += [None, "", "never seen", "a b c d", "d a c b", texts[5]]
    rows = [(i, t) for i, t in enumerate(texts)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").lower().split(), None]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    pairs = Counter((a, b) for i, t in rows if not held(i) for a, b in zip([None, *tokens(t)], tokens(t)))
    cut = quality.discounts([sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)])
    words = sorted(w for w in c if w)
    codes = [quality.word_grams([w.encode() if w else b"\x03"])[0] for w in [*words, None]]
    n = Counter()
    for w, code in zip([*words, None], codes):
        n.update({int(x): c[w] * int((code == x).sum()) for x in np.unique(code)})
    model = quality.fit(pa.table({"lang": pa.array([None] * len(n), pa.string()), "code": list(n), "n": list(n.values())}))
    trie = tries.Trie(tries.build(model))

    def plain(t):
        score = 0.0
        for a, b in zip([None, *tokens(t)], tokens(t)):
            p = (c[b] + len(c) * 10 ** scoring.word_scores(trie, [b.encode() if b else b"\x03"])[0]) / (sum(c.values()) + len(c))
            if c[a]:
                followers = [x for (y, _), x in pairs.items() if y == a]
                p = (pairs[a, b] - cut[min(pairs[a, b], 3)] + sum(cut[min(x, 3)] for x in followers) * p) / c[a]
            score += math.log10(p)
        return score

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    is_held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    for shard in (scoring._SHARD, 40, 7):
        monkeypatch.setattr(scoring, "_SHARD", shard)
        out = {r.doc_id: r.score for r in scoring.score(docs, is_held).collect()}
        assert len(out) == len(rows) and all(abs(out[i] - plain(t)) < 1e-4 for i, t in rows)
    assert out[63] > out[64]  # the same words, out of order
    assert scoring.score(docs, F.lit(True)).agg(F.max("score")).first()[0] < 0


def test_language_of_held_out_texts(spark, docs, empty):
    df = QUERIES["op9_byte_cnn"](spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert df.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.9
    out = langid.identify(docs, F.lit(True)).collect()
    assert {r.lang_pred for r in out if not (r.row.text or "").strip()} == {"und"} and len(out) == len(TEXTS) + 1
    assert langid.identify(empty, F.lit(True)).count() == 0


def test_shards_are_exact(docs, empty):
    rows = sharding.shuffle_into_shards(docs, 5, block_rows=2).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(TEXTS) + 1 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    m = np.array(sharding.communication_matrix([5, 0, 8], sharding.shard_quotas(13, 4), 1))
    assert m.sum(axis=1).tolist() == [5, 0, 8] and m.sum(axis=0).tolist() == [4, 3, 3, 3]
    assert sharding.shuffle_into_shards(empty, 5).count() == 0


def test_spans_of_a_long_text(spark):
    draw = random.Random(3)
    bits = ["a@b.co", "Dr. Jane Doe", "123-45-6789", "10.0.0.1", "+1 (212) 555-0100", "(212) 555-0100", "token=abcdefgh1", "token=me@host.example",
            "4111 1111 1111 1111", "James", "\u00e9\u4e2d", "word", "password: 10.20.30.40x9", "x@James Bond.de"]
    texts = ["", " ".join(draw.choices(bits, k=3000)), "".join(draw.choices(bits, k=700)), "a@b.co " * 5000 + "z" * 9000 + " a@b.co"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # a candidate stays where no base span overlaps it
    for r in pii._candidates(docs, "text").collect():
        found = [m.span() for m in re.finditer(pii._MORE, texts[r["_c0"]])]
        free = [(a, b) for a, b in found if not any(x.start < b and a < x.end for x in r.base)]
        assert [(m.start, m.end) for m in r.more] == free and (len(texts[r["_c0"]]) < 10**4 or len(r.base) > 900)
    spans = {r.row.doc_id: sorted((s.start, s.end, s.kind) for s in r.spans) for r in pii.find_spans(docs).collect()}
    for r in pii.redact(docs).collect():
        out, at, source = [], 0, texts[r.doc_id]
        for a, b, kind in spans[r.doc_id]:
            if a >= at:
                out.append(source[at:a] + f"[{pii.KINDS[kind].upper()}]")
            at = max(at, b)
        assert r.text == "".join(out) + source[at:]


def test_hypergeometric_draws_follow_their_law():
    rng = np.random.default_rng(1)
    for good, bad, drawn in ((7, 9, 6), (3, 30, 12), (20, 2, 15)):
        got = np.bincount([sharding.hypergeometric(rng, good, bad, drawn) for _ in range(20000)], minlength=drawn + 1) / 20000
        want = [math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn) for k in range(drawn + 1)]
        assert np.abs(got - want).max() < 0.02
    big = [sharding.hypergeometric(rng, 10**10, 3 * 10**10, 10**8) for _ in range(300)]
    spread = (10**8 * 0.25 * 0.75) ** 0.5
    assert abs(np.mean(big) - 25 * 10**6) < spread / 3 and 0.8 < np.std(big) / spread < 1.2


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, "")
        assert left.columns == docs.columns
    assert 0 < left.count() < docs.count()


def test_a_hot_length_needs_few_rounds(spark, monkeypatch):
    rounds = []
    matched = packing._matched
    monkeypatch.setattr(packing, "_matched", lambda *a: rounds.append(1) or matched(*a))
    monkeypatch.setattr(packing, "_RANGE_ROWS", 3000)  # several ranges
    lengths = [900] * 2000 + [1300] * 6000 + [7] * 50
    pieces_ = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    out = packing.pack(pieces_, 2048).select("row.doc_id", "row.length", "sequence_id", "offset").collect()
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(out) == len(lengths) and len(rounds) <= 20 and len(by) == 7000
    for places in by.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048


def test_sequences_against_best_fit_decreasing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    packed = packing.pack_documents(docs, word_tokenizer(), 2048).select("length", "sequence_id").collect()
    free = []
    for n in sorted((r.length for r in packed), reverse=True):
        at = min((i for i, g in enumerate(free) if g >= n), key=lambda i: free[i], default=None)
        if at is None:
            free.append(2048 - n)
        else:
            free[at] -= n
    assert len({r.sequence_id for r in packed}) <= len(free) + 1


def test_pieces_of_a_very_long_text(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    texts = ["word " * 200_000, "x" * 3000 + " " + "😀é" * 500, "ab" * 200 + "中" * 300]
    for r in pieces.encode(spark.createDataFrame([(t,) for t in texts], "text string"), piece_model()).collect():
        assert r.ids == sp.encode(r.row.text) and r.round_trip


def test_tokenizers_that_merge_over_blanks_are_refused():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        packing.WordEncoder(f.read())


def test_marks_capitals_and_special_tokens_as_the_tokenizer_has_them():
    from tokenizers import Tokenizer

    with open(word_tokenizer(), encoding="utf-8") as f:
        encoder, plain = packing.WordEncoder(f.read()), Tokenizer.from_file(word_tokenizer())
    rng = np.random.default_rng(5)
    parts = [*"aZé1½中ᄀ😀_~«$<|", "İ", "ß", "Σ", "ſ", "×", "Å", "ﬁ", "́", "̇", "'s", "'", "!!", "?.", ",", "<|", "|>", "<|endoftext|>",
             " ", "\t", "\x0b", "\x1c", "\x85", " ", " ", "\0", "‍"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(3000)] + [None, "", " ", "İ!!", "It's, 'it'!", "armió, e.g. a--"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(pa.array(texts))] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_kept_with_their_ids_are_bounded():
    with open(word_tokenizer(), encoding="utf-8") as f:
        encoder = packing.WordEncoder(f.read())
    letters = "abcdefghij"
    words = ["".join(letters[int(d)] for d in str(i)) for i in range(400_000)]
    texts = pa.array([" ".join(words[i:i + 500]) + " the end." for i in range(0, len(words), 500)])
    for i in range(0, len(texts), 50):
        assert len(list(encoder.encode(texts[i:i + 50]))) == 50
    assert len(encoder.known) <= 300_000 and "the" in encoder.known and "end." not in encoder.known


def test_runs_between_ranges_start_no_python_task(spark, monkeypatch):
    made = []
    create = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **b: made.append(create(self, *a, **b)) or made[-1])
    monkeypatch.setattr(packing, "_RANGE_ROWS", 200)
    packed = packing.pack(spark.range(3000).selectExpr("id AS doc_id", "1 + id % 1500 AS length"), 2048)
    assert packed.count() == 3000 and made
    assert all(df._jdf.queryExecution().optimizedPlan().nodeName() == "LocalRelation" for df in made)
