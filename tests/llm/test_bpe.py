"""Byte-pair encoding against the library that the file is made for."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sqlloom.llm import bpe
from sqlloom.llm.queries import QUERIES, word_tokenizer

HARD = [
    None, "", " \t\n", "one", "one", "Don't WE'LL it's 'tis x'S", "ÀÉÎ a\u0301e\u0300 Σίσυφος ΟΔΟΣ İstanbul ǅ", "中文 and 日本語 123 4567", "😀👩‍👩‍👧 ok",
    "<|endoftext|>a<|startoftext|><|endoftext|> <|endof", "a\x1cb\x1d c\x85d\xa0e\u2028f\u3000g", "\x00\x7f\ufeff\ufffd", "x" * 5000, "ab" * 3000 + "cdefgh" * 2000,
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(word_tokenizer())


@pytest.fixture(scope="module")
def coder():
    with open(word_tokenizer(), encoding="utf-8") as f:
        return bpe.MergeCoder(f.read())


def ids(coder, text):
    return np.frombuffer(coder.encode(text), "<u4").tolist()


def test_hard_texts(coder, plain):
    rng = random.Random(5)
    letters = "abcthein XYZ 'sΣςé\u0301İ中123.,!?<|>\t\n\x85\x1f_-😀"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for text in [*HARD, *made]:
        wanted = plain.encode(text or "", add_special_tokens=False).ids
        assert ids(coder, text) == wanted, text
        assert coder.decode(np.array(wanted, np.int64)) == plain.decode(wanted, skip_special_tokens=False)


def test_every_assigned_letter(coder, plain):
    for c in range(0, 0x3000):
        if chr(c).isprintable() and c not in (0x1c89, 0x1c8a):  # these two are newer than Python's tables
            assert ids(coder, f"a{chr(c)}b") == plain.encode(f"a{chr(c)}b", add_special_tokens=False).ids, hex(c)


def test_stale_entries_and_long_words(coder, plain):
    text = "thethe" * 40_000 + " " + "é" * 10_000
    assert ids(coder, text) == plain.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing(coder, plain, monkeypatch):
    monkeypatch.setattr(bpe, "_KNOWN_CHUNKS", 3)
    monkeypatch.setattr(bpe, "_KNOWN_WORDS", 2)
    for k in range(30):
        text = f"word{k} other{k} the the"
        assert ids(coder, text) == plain.encode(text, add_special_tokens=False).ids


def test_operator_on_a_table(spark, plain, monkeypatch):
    monkeypatch.setattr(bpe, "_OUTPUT_CHARACTERS", 50)  # several batches
    rows = [(i if i != 3 else None, t, "r", [1], "d") for i, t in enumerate(HARD)]
    docs = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, row string, ids array<int>, decoded string")
    coded = bpe.encode(docs, word_tokenizer(), with_decoded=True)
    out = coded.collect()
    assert len(out) == len(HARD) + 1 and out[0].row.row == "r"
    for r in out:
        wanted = plain.encode(r.row.text or "", add_special_tokens=False).ids
        assert r.ids == wanted and r.decoded == plain.decode(wanted, skip_special_tokens=False)
    assert bpe.decode(coded, word_tokenizer()).select("decoded").collect() == coded.select("decoded").collect()
    assert bpe.decode(coded.withColumn("ids", F.lit(None).cast("array<int>")), word_tokenizer()).select("decoded").distinct().collect() == [("",)]
    assert bpe.encode(docs.where("doc_id > 99"), word_tokenizer()).count() == 0


def test_query_against_the_library(spark, plain, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = QUERIES["op13_bpe"](spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        e = plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        hexed = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, e)), plain.decode(e, skip_special_tokens=False))]
        assert [r.n_tokens, r.ids_sha256, r.decoded_sha256] == [len(e), *hexed]


def test_other_files_are_refused():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        bpe.MergeCoder(f.read())
