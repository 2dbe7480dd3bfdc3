"""Prefix trie of conversations against a plain trie."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from sqlloom.llm import turns
from sqlloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string"


@pytest.fixture
def shards(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def plain(sequences):
    """Nodes of {conv_id: [(role, text), ...]}."""
    nodes = {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    out = {}
    for path, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        ends = sorted(c for c in members if len(sequences[c]) == len(path))
        out[path] = {"conv": min(members), "n": len(members), "own": (len(members) - 1) * words, "children": 0, "leaves": 0, "saved": 0,
                     "sha": hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()}
    for path in out:
        if path:
            out[path[:-1]]["children"] += 1
    for path, node in out.items():
        for d in range(len(path) + 1):
            above = out[path[:d]]
            above["saved"] += node["own"]
            above["leaves"] += node["children"] == 0
    return sorted((v["conv"], len(p), out[p[:-1]]["conv"] if p else -1, v["n"], v["children"], v["leaves"], v["saved"], v["sha"]) for p, v in out.items())


def rows_of(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def sequences_of(rows):
    found = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        found.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return found


def rebuilt(sequences):
    out = {}
    for c, own in sequences.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = sequences.get(c - c % 20, [])[:h] + own[h:]
    return out


def made_rows(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(120):
        for t in range(rng.integers(0, 6)):
            rows.append((c, t, ["user", "assistant"][t % 2], "w " * int(rng.integers(0, 3)), 0, "k"))
    for c in range(200, 260):  # a hot conversation, and one that goes on
        rows += [(c, t, "user", "same text", 0, "k") for t in range(3 + (c > 255))]
    rows += [(300 + k, t, "user", "deep", 0, "k") for k in range(3) for t in range(100 + k)]  # several matrices
    rows += [(400, None, None, None, 0, "k"), (400, None, "a", ""), (400, 0, "b", "x" * 5000 + " y"), (400, 0, "a", "z"), (400, 0, "a", "z"), (None, 0, "user", "lost")]
    rows += [(401, t, "user", t * "deep ") for t in range(33)] + [(402, t, "user", t * "deep ") for t in range(32)]
    return [(*r[:4], 0, "k") for r in rows]


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_against_a_plain_trie(spark, shards, parts):
    shards(parts)
    rows = made_rows(parts)
    ordered = turns.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(turns.prefix_trie(ordered)) == plain(sequences_of(rows))
    assert rows_of(turns.prefix_trie(*turns.with_shared_heads(ordered))) == plain(rebuilt(sequences_of(rows)))


def test_equal_conversations_over_many_shards(spark, shards):
    shards(9)
    rows = [(c, t, "user", f"turn {t}", 0, "") for c in range(500) for t in range(40)] + [(900, 0, "user", "turn 0", 0, "")]
    found = turns.prefix_trie(turns.numbered_turns(spark.createDataFrame(rows, SCHEMA)))
    assert rows_of(found) == plain(sequences_of(rows))


def test_turnless_and_empty(spark, shards):
    shards(5)
    none = turns.numbered_turns(spark.createDataFrame([], SCHEMA))
    assert turns.prefix_trie(none).count() == 0
    members = spark.createDataFrame([(c,) for c in range(30)], "conv_id long")
    assert rows_of(turns.prefix_trie(none, members)) == plain({c: [] for c in range(30)})


def test_sorted_matrices_and_shared_prefixes():
    rng = np.random.default_rng(1)
    seqs = [tuple(rng.integers(0, 2, rng.integers(0, 5)).tolist()) for _ in range(200)] + [(1,) * k for k in range(90, 140)] + [(1,) * 70 + (0,) * 40] * 3
    size = np.array([len(s) for s in seqs])
    flat, start = np.array([x for s in seqs for x in s]), np.cumsum(size) - size
    conv = rng.permutation(len(seqs))
    order = turns.sorted_rows(flat, start, size, conv)
    ranked = [seqs[i] for i in order]
    assert [(seqs[i], conv[i]) for i in order] == sorted(zip(seqs, conv))
    common = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(ranked, ranked[1:])]
    assert turns.shared_prefix(flat, start[order], size[order]).tolist() == [-1, *common]


def test_owners_of_border_nodes():
    # first row's share with the row before, share of first and last row, length of the last row
    found = turns.owners([(0, -1, 0, 3), (1, 2, 5, 5), (4, 5, 1, 6), (5, 1, 1, 1)])
    place = {(s, d): o for s, a, b, o in found for d in range(a, b + 1)}
    assert place == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (4, 0): 0, (4, 1): 0, (4, 2): 0, (4, 3): 1, (4, 4): 1, (4, 5): 1, (5, 0): 0, (5, 1): 0}


def test_query_against_sql(spark, sf_dir):
    conversations = duckdb.read_parquet(f"{sf_dir}/conversations.parquet")  # noqa: F841
    wanted = sorted(tuple(-1 if v is None else v for v in r) for r in duckdb.sql(ORACLE_SQL["op11_prefix_trie"]).fetchall())
    assert wanted and rows_of(QUERIES["op11_prefix_trie"](spark, sf_dir)) == wanted
