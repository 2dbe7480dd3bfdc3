"""Quotient filters and phrase collocations against plain counts."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from sqlloom.llm import phrases, quotient
from sqlloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, ids array<int>"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("bits", [1, 3, 16, 25, 27, 32])
@pytest.mark.parametrize("words", [2, 3, 5])
def test_filters_lose_nothing(words, bits):
    rng = np.random.default_rng(bits)
    packing = quotient.Packing(words, bits)
    columns = [rng.integers(0, 2**bits, 2000) for _ in range(words)]
    limbs = packing.pack(columns)
    assert all((a == b).all() for a, b in zip(packing.unpack(limbs), columns))
    moved = packing.permute(limbs)
    assert all((a == b).all() for a, b in zip(packing.restore(moved), limbs))
    wanted = Counter(zip(*[c.tolist() for c in columns]))
    keys, counts = quotient.tally(moved)
    counts[::7] += 300  # beyond one byte
    shard = packing.shard(keys[0], 7)
    assert (np.diff(shard) >= 0).all() and shard.max() < 7
    blob = quotient.build(packing, keys, counts)
    again, same, n = quotient.read(blob)
    assert again.widths == packing.widths and (n == counts).all() and all((a == b).all() for a, b in zip(same, keys))
    _, keys, n = quotient.merge([blob, blob, quotient.build(packing, [k[:0] for k in keys], n[:0])])
    found = dict(zip(zip(*[c.tolist() for c in packing.unpack(packing.restore(keys))]), n.tolist()))
    assert set(found) == set(wanted) and sum(found.values()) == 2 * int(counts.sum())


def test_too_wide_words_are_refused():
    with pytest.raises(ValueError):
        quotient.Packing(2, 33)


def plain(rows, min_count, top=2000, cover=100):
    """The contract, phrase by phrase."""
    counts, totals = {}, Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        own = counts.setdefault(lang, Counter())
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 6):
                own.update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        found = []
        inside = {}
        for p, a in own.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p) and a >= min_count:
                        inside[p[i:j]] = max(inside.get(p[i:j], 0), a)
        for p, a in own.items():
            if len(p) > 1 and a >= min_count and 100 * inside.get(p, 0) < cover * a:
                score, _, l, r = min((1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), a, l, r, score))
        out += [(lang, i + 1, f[2].decode(), f[3], f[4], f[5], totals[lang], f[6]) for i, f in enumerate(sorted(found)[:top])]
    return sorted(out)


def made_rows():
    rng = np.random.default_rng(2)
    words = ["a", "B", "c", "é", "ÀB", "d\x00e", "f\x0bg", "h\xa0i"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 12))) + rng.choice([".", "!b", "\n", "\tc"]), ["en", None, "und", ""][i % 4]) for i in range(300)]
    rows += [(None, "very long " * 3000, "en"), (1, None, None), (1, "", "en"), (2, " .,;\t", "fr"), *[(9, "same text here. Same text", "fr")] * 40]
    return [(*r, "p", 1, [1]) for r in rows]


@pytest.mark.parametrize("min_count,top,cover", [(10, 2000, 100), (3, 5, 60), (40, 2000, 100)])
def test_collocations_against_plain_counts(spark, monkeypatch, min_count, top, cover):
    monkeypatch.setattr(phrases, "_BLOCK_BYTES", 700)  # many blocks
    monkeypatch.setattr(phrases, "_OCCURRENCES", 40)
    rows = made_rows()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7 if cover == 60 else before)  # words that go on over batches
    found = phrases.collocations(spark.createDataFrame(rows, SCHEMA), min_count, top=top, cover_percent=cover)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert tuple(found.columns) == COLUMNS
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, min_count, top, cover)


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "", 1, None), (2, "a b", None, "", 1, None)], SCHEMA)).count() == 0


def test_query_against_sql(spark, sf_dir):
    documents = duckdb.read_parquet(f"{sf_dir}/documents.parquet")  # noqa: F841
    wanted = sorted(duckdb.sql(ORACLE_SQL["op12_collocations"]).fetchall())
    assert wanted and sorted(tuple(r) for r in QUERIES["op12_collocations"](spark, sf_dir).collect()) == wanted
