"""An n-gram trie in a few compact, memory-mapped levels with Elias-Fano pointers."""

from __future__ import annotations

import json
import mmap
import tempfile

import numpy as np

from sqlloom.llm.quality import ORDER, KneserNey

_NONE = 255  # quantised code of a value that is not there


def elias_fano(values: np.ndarray) -> dict[str, np.ndarray]:
    """A monotone sequence as packed low bits and a unary bit vector of the high parts with its running counts."""
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    v = values.astype(np.uint64)
    bits = np.zeros((n * low + 127) // 64 * 64, np.uint8)
    for b in range(low):
        bits[np.arange(n) * low + b] = (v >> np.uint64(b)) & np.uint64(1)
    high = np.zeros(((n + (top >> low) + 64) // 64 + 1) * 64, np.uint8)
    high[(v >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    words = np.packbits(high, bitorder="little").view(np.uint64)
    return {"low": np.packbits(bits, bitorder="little").view(np.uint64), "high": words,
            "before": np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])).astype(np.uint32), "width": np.array([low], np.int64)}


def elias_fano_get(ef: dict[str, np.ndarray], i: np.ndarray) -> np.ndarray:
    """The i-th values: the place of the i-th set bit gives the high part."""
    low = int(ef["width"][0])
    word = np.searchsorted(ef["before"], i, side="right") - 1
    rank, bits, place = i - ef["before"][word].astype(np.int64), ef["high"][word], np.zeros(len(i), np.int64)
    for half in (32, 16, 8, 4, 2, 1):  # the rank-th set bit of a word by halving
        count = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
        right = rank >= count
        rank = rank - np.where(right, count, 0)
        place += np.where(right, half, 0)
        bits = np.where(right, bits >> np.uint64(half), bits)
    value = (word * 64 + place - i) << low
    if low:
        at = i * low
        w, s = at // 64, (at % 64).astype(np.uint64)
        spill = np.where(s > 0, ef["low"][np.minimum(w + 1, len(ef["low"]) - 1)] << ((np.uint64(64) - s) & np.uint64(63)), np.uint64(0))
        value |= (((ef["low"][w] >> s) | spill) & np.uint64((1 << low) - 1)).astype(np.int64)
    return value


def _successor(symbols: np.ndarray, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The place of each symbol among the ascending symbols from ``low`` to ``high``; -1 if it is not there."""
    end = high.copy()
    while (low < high).any():
        open_ = low < high
        mid = (low + high) // 2
        less = open_ & (symbols[np.minimum(mid, len(symbols) - 1)] < symbol)
        low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
    hit = (low < end) & (symbols[np.minimum(low, len(symbols) - 1)] == symbol) if len(symbols) else np.zeros(len(symbol), bool)
    return np.where(hit, low, -1)


def _quantised(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of one byte and the book of values they stand for: means of equally full bins."""
    codes = np.full(len(values), _NONE, np.uint8)
    seen = np.sort(values[known])
    if not len(seen):
        return codes, np.zeros(1, np.float32)
    bins = [b for b in np.array_split(seen, _NONE) if len(b)]
    edges = np.unique([b[0] for b in bins])
    at = np.searchsorted(edges, values[known], side="right") - 1
    total, count = np.zeros(len(edges)), np.zeros(len(edges))
    np.add.at(total, at, values[known])
    np.add.at(count, at, 1)
    codes[known] = at
    return codes, (total / np.maximum(count, 1)).astype(np.float32)


def build(model: KneserNey) -> bytes:
    """The levels of a model of one language: a node for each n-gram, its children in a row in the next level.

    A level holds the last byte of each node, a quantised probability and backoff, and the monotone
    pointers to the first child of each node.
    """
    parts: dict[str, np.ndarray] = {}
    keys = [g[0] for g in model.grams]
    nodes: list[np.ndarray] = [np.empty(0, np.int64)] * (ORDER + 1)
    above = np.empty(0, np.int64)
    for k in range(ORDER, 0, -1):  # every prefix of a node is a node
        nodes[k] = np.union1d(np.union1d(keys[k - 1], above), model.contexts[k][0] if k < ORDER else above)
        above = nodes[k] >> 8
    for k in range(1, ORDER + 1):
        own = nodes[k]
        parts[f"{k}/symbol"] = (own & 255).astype(np.uint8)
        for name, (have, logs) in (("log", model.grams[k - 1]), ("back", model.contexts[k] if k < ORDER else (np.empty(0, np.int64), np.empty(0)))):
            at = np.minimum(np.searchsorted(have, own), max(len(have) - 1, 0))
            known = have[at] == own if len(have) else np.zeros(len(own), bool)
            values = np.where(known, logs[at], 0) if len(have) else np.zeros(len(own))
            parts[f"{k}/{name}"], parts[f"{k}/{name}/book"] = _quantised(values, known)
        if k < ORDER:
            first = np.searchsorted(nodes[k + 1] >> 8, own)
            for name, a in elias_fano(np.concatenate((first, [len(nodes[k + 1])]))).items():
                parts[f"{k}/child/{name}"] = a
    root = model.contexts[0][1]
    parts["root"] = np.array([root[0] if len(root) else 0.0], np.float64)
    table, at = {}, 0
    for name, a in parts.items():
        at = -(-at // 8) * 8
        table[name] = (at, str(a.dtype), len(a))
        at += a.nbytes
    head = json.dumps(table).encode()
    head += b" " * (-(len(head) + 8) % 8)
    out = bytearray(8 + len(head) + at)
    out[:8] = len(head).to_bytes(8, "little")
    out[8:8 + len(head)] = head
    for name, a in parts.items():
        start = 8 + len(head) + table[name][0]
        out[start:start + a.nbytes] = a.tobytes()
    return bytes(out)


class Trie:
    """Levels mapped from an unnamed file, so that a worker reads the pages it needs and leaves nothing behind."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(self._map[:8], "little")
        self.parts = {name: np.frombuffer(self._map, np.dtype(kind), size, 8 + n + at) for name, (at, kind, size) in json.loads(self._map[8:8 + n]).items()}
        self.children = {k: {x: self.parts[f"{k}/child/{x}"] for x in ("low", "high", "before", "width")} for k in range(1, ORDER)}

    def _step(self, k: int, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The child of each node of level k - 1 by successor search among its children; -1 if there is none."""
        symbols = self.parts[f"{k}/symbol"]
        if k == 1:
            low, high = np.zeros(len(symbol), np.int64), np.full(len(symbol), len(symbols))
        else:
            low, high = elias_fano_get(self.children[k - 1], node), elias_fano_get(self.children[k - 1], node + 1)
        return _successor(symbols, low, high, symbol)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """Log10 probability of the last byte of every five-byte code: the longest known n-gram, and the backoffs on the way to it."""
        total, left = np.zeros(len(codes)), np.arange(len(codes))
        for order in range(ORDER, 0, -1):
            node, context = np.zeros(len(left), np.int64), np.full(len(left), -1)
            for k in range(1, order + 1):
                context = node if k == order else context
                symbol = ((codes[left] >> 8 * (order - k)) & 255).astype(np.uint8)
                live = node >= 0
                after = np.full(len(left), -1)
                after[live] = self._step(k, node[live], symbol[live])
                node = after
            code = np.full(len(left), _NONE, np.uint8)
            code[node >= 0] = self.parts[f"{order}/log"][node[node >= 0]]
            hit = code != _NONE
            total[left[hit]] += self.parts[f"{order}/log/book"][code[hit]]
            left, context = left[~hit], context[~hit]
            if order > 1:
                code = np.full(len(left), _NONE, np.uint8)
                code[context >= 0] = self.parts[f"{order - 1}/back"][context[context >= 0]]
                known = code != _NONE
                total[left[known]] += self.parts[f"{order - 1}/back/book"][code[known]]
            else:
                total[left] += self.parts["root"][0]
        total[left] += np.log10(1 / 256)
        return total


class PairTrie:
    """Counts of pairs of token numbers in two levels: contexts, and each one's followers in a row, with Elias-Fano pointers."""

    def __init__(self, first: np.ndarray, second: np.ndarray, n: np.ndarray):
        """Distinct pairs, ascending."""
        self.contexts, start = np.unique(first, return_index=True)
        self.child, self.symbols, self.n = elias_fano(np.append(start, len(first))), second, n
        self._kinds = np.stack([np.add.reduceat(x.astype(np.int64), start) for x in (n == 1, n == 2, n > 2)], axis=1) if len(start) else np.zeros((0, 3), np.int64)

    def _node(self, first: np.ndarray) -> np.ndarray:
        return _successor(self.contexts, np.zeros(len(first), np.int64), np.full(len(first), len(self.contexts)), first)

    def counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """How often each pair was counted, by successor search among the followers of its context."""
        node, found = self._node(first), np.zeros(len(first), np.int64)
        live = np.flatnonzero(node >= 0)
        node = node[live]
        at = _successor(self.symbols, elias_fano_get(self.child, node), elias_fano_get(self.child, node + 1), second[live])
        found[live[at >= 0]] = self.n[at[at >= 0]]
        return found

    def kinds(self, first: np.ndarray) -> np.ndarray:
        """Followers of each context that were counted once, twice and more often."""
        node, found = self._node(first), np.zeros((len(first), 3), np.int64)
        found[node >= 0] = self._kinds[node[node >= 0]]
        return found
