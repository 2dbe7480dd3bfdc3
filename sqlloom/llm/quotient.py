"""Counting quotient filters over packed n-grams: lossless, compact, merged by sorted order."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = "<HHHq"  # words of an n-gram, bits of a word, bits of the quotient, entries
# fixed odd multipliers of the round function (the usual 64-bit finishers)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_ROUNDS = 4


class Packing:
    """N-grams of ``words`` word ids of ``bits`` bits each, as limbs of at most 64 bits, and a permutation of their whole range.

    Each round adds (exclusive or) to one limb a mixture of the others, as in a Feistel network, so
    every round can be taken back and no two n-grams fall together.  The first limb begins with the quotient.
    """

    def __init__(self, words: int, bits: int):
        if not 1 <= bits <= 32:
            raise ValueError("a word id has 1 to 32 bits")
        self.words, self.bits = words, bits
        width = words * bits
        limbs = max(2, -(-width // 64))
        size = -(-width // limbs)
        self.widths = [size] * (limbs - 1) + [width - size * (limbs - 1)]
        self.masks = [np.uint64((1 << w) - 1) for w in self.widths]

    def pack(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        """Limbs of n-grams given as one array of ids for each word."""
        out = [np.zeros(len(columns[0]), np.uint64) for _ in self.widths]
        at = 0
        for ids in columns:
            ids = ids.astype(np.uint64)
            limb, off = divmod(at, self.widths[0])
            out[limb] |= (ids << np.uint64(off)) & self.masks[limb]
            if off + self.bits > self.widths[limb] and limb + 1 < len(out):
                out[limb + 1] |= ids >> np.uint64(self.widths[limb] - off)
            at += self.bits
        return out

    def unpack(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        """The ids that ``pack`` was given."""
        one, columns = np.uint64((1 << self.bits) - 1), []
        for k in range(self.words):
            limb, off = divmod(k * self.bits, self.widths[0])
            ids = limbs[limb] >> np.uint64(off)
            if off + self.bits > self.widths[limb] and limb + 1 < len(limbs):
                ids = ids | (limbs[limb + 1] << np.uint64(self.widths[limb] - off))
            columns.append((ids & one).astype(np.int64))
        return columns

    def _mixed(self, limbs: list[np.ndarray], k: int, turn: int) -> np.ndarray:
        x = np.full(len(limbs[0]), (turn * len(limbs) + k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
        for j, limb in enumerate(limbs):
            if j != k:
                x = (x ^ limb) * _MIX[0]
                x ^= x >> np.uint64(32)
                x *= _MIX[1]
                x ^= x >> np.uint64(29)
        return x & self.masks[k]

    def permute(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        out = list(limbs)
        for turn in range(_ROUNDS):
            for k in range(len(out)):
                out[k] = out[k] ^ self._mixed(out, k, turn)
        return out

    def restore(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        out = list(limbs)
        for turn in reversed(range(_ROUNDS)):
            for k in reversed(range(len(out))):
                out[k] = out[k] ^ self._mixed(out, k, turn)
        return out

    def shard(self, first: np.ndarray, shards: int) -> np.ndarray:
        """Which of equal ranges of the quotient a first limb falls into; ranges follow each other in sorted order."""
        kept = min(self.widths[0], 31)
        return ((first >> np.uint64(self.widths[0] - kept)) * np.uint64(shards) >> np.uint64(kept)).astype(np.int64)


def tally(limbs: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct keys and the sums of their counts (ones, if none are given)."""
    if not len(limbs[0]):
        return limbs, np.empty(0, np.int64)
    order = np.lexsort(limbs[::-1])
    limbs = [x[order] for x in limbs]
    new = np.zeros(len(order), bool)
    new[0] = True
    for x in limbs:
        new[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(new)
    n = np.diff(np.append(starts, len(order))) if counts is None else np.add.reduceat(counts[order], starts)
    return [x[starts] for x in limbs], n.astype(np.int64)


def build(packing: Packing, limbs: list[np.ndarray], counts: np.ndarray) -> bytes:
    """The filter of sorted distinct permuted keys.

    Quotients are not written: a bit for each entry and a zero bit behind each quotient's run say which entries belong to it.
    The full remainder of each entry follows, then its counter, one byte up to 254 and eight more beyond.
    """
    n = len(counts)
    q = min(max(n, 1).bit_length() - 1, packing.widths[0])
    low = packing.widths[0] - q
    quotient = (limbs[0] >> np.uint64(low)).astype(np.int64) if q else np.zeros(n, np.int64)
    bits = np.zeros(n + (1 << q), np.uint8)
    bits[np.arange(n) + quotient] = 1
    parts = [np.packbits(bits).tobytes()]
    for limb, width in zip([limbs[0] & np.uint64((1 << low) - 1), *limbs[1:]], [low, *packing.widths[1:]]):
        parts.append(limb.astype("<u8").view(np.uint8).reshape(n, 8)[:, : -(-width // 8)].tobytes())
    large = counts >= 255
    parts += [np.where(large, 255, counts).astype(np.uint8).tobytes(), counts[large].astype("<i8").tobytes()]
    return struct.pack(_HEAD, packing.words, packing.bits, q, n) + b"".join(parts)


def read(blob: bytes) -> tuple[Packing, list[np.ndarray], np.ndarray]:
    """Packing, sorted keys and counts of a filter."""
    words, bits, q, n = struct.unpack_from(_HEAD, blob)
    packing, at = Packing(words, bits), struct.calcsize(_HEAD)

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(blob, np.uint8, size, at - size)

    marks = np.unpackbits(take(-(-(n + (1 << q)) // 8)))[: n + (1 << q)]
    quotient = np.flatnonzero(marks) - np.arange(n)
    low, limbs = packing.widths[0] - q, []
    for width in [low, *packing.widths[1:]]:
        size = -(-width // 8)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = take(n * size).reshape(n, size)
        limbs.append(wide.view("<u8").ravel().astype(np.uint64))
    limbs[0] = limbs[0] | (quotient.astype(np.uint64) << np.uint64(low)) if q else limbs[0]
    counts = take(n).astype(np.int64)
    large = counts == 255
    counts[large] = take(8 * int(large.sum())).view("<i8")
    return packing, limbs, counts


def merge(blobs: list[bytes]) -> tuple[Packing, list[np.ndarray], np.ndarray]:
    """Sum of filters of one packing (one filter at least)."""
    found = [read(b) for b in blobs]
    limbs, counts = tally([np.concatenate(x) for x in zip(*[f[1] for f in found])], np.concatenate([f[2] for f in found]))
    return found[0][0], limbs, counts
