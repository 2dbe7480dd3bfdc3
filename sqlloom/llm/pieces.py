"""SentencePiece encoding by suffix-array matching, and decoding."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"  # how the vocabulary writes a blank
_KNOWN_SEGMENTS = 500_000  # segments kept in a worker with their ids; more are encoded anew
_INDEX_CHARACTERS = 600_000  # text indexed at a time
_ROWS = 1024  # texts whose new segments are indexed together
_LONG = 256  # longer segments merge through a queue instead of in step with the others
_SEPARATOR = 1  # no piece holds this code point
_CODERS: dict[int, PieceCoder] = {}


class PieceCoder:
    """Encoder and decoder of a byte-pair model with byte fallback.

    Pieces hold blanks at their beginning only, so a text falls apart before each run of blanks and the
    segments are encoded one by one; the segments that a batch brings anew are indexed together.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        kinds = [p.is_control(i) or p.is_unknown(i) or p.is_unused(i) for i in range(p.get_piece_size())]
        spell = [p.id_to_piece(i) for i in range(len(kinds))]
        self.bytes = {int(spell[i][1:-1], 16): i for i in range(len(kinds)) if p.is_byte(i)}
        plain = [i for i in range(len(kinds)) if not kinds[i] and not p.is_byte(i)]
        if any(SPACE in spell[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece of this model reaches over a blank")
        self.longest = max(len(spell[i]) for i in plain)
        self.pieces = np.array([spell[i] for i in plain], f"<U{self.longest}")
        self.last = np.char.ljust(self.pieces, self.longest, chr(0x10FFFF))  # the last string that each piece begins
        self.sizes = np.char.str_len(self.pieces)
        self.ids = np.array(plain, np.int64)
        self.score = np.full(len(kinds), -np.inf)
        self.score[plain] = [p.get_score(i) for i in plain]
        self.surface = [b"" if kinds[i] else bytes([int(spell[i][1:-1], 16)]) if p.is_byte(i) else spell[i].replace(SPACE, " ").encode() for i in range(len(kinds))]
        self.known: dict[str, bytes] = {}

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence of every piece in an indexed text: sorted keys (place and length) and piece ids.

        The suffixes, as far as the longest piece reaches, are sorted; a binary search for a piece and for
        the last string it begins finds its range of occurrences; the edges are then sorted by place.
        """
        padded = np.concatenate((text, np.full(self.longest, _SEPARATOR, np.uint32)))
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.longest)[:len(text)]).view(f"<U{self.longest}").ravel()
        order = np.argsort(suffixes, kind="stable")
        ranked = suffixes[order]
        low = np.searchsorted(ranked, self.pieces, side="left")
        count = np.searchsorted(ranked, self.last, side="right") - low
        found = np.flatnonzero(count)
        n = count[found]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = order[np.repeat(low[found], n) + inside]
        key = place * (self.longest + 1) + np.repeat(self.sizes[found], n)
        by_place = np.argsort(key)
        return key[by_place], np.repeat(self.ids[found], n)[by_place]

    def _encode_new(self, segments: list[str]) -> None:
        """Relax the edges of a batch in merge order: again and again the best edge over two neighbouring tokens replaces them."""
        text = np.frombuffer((chr(_SEPARATOR).join(segments) + chr(_SEPARATOR)).encode("utf-32-le"), np.uint32)
        keys, ids = self.edges(text)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        first = np.cumsum(sizes + 1) - sizes - 1

        def edge(place: np.ndarray, length: np.ndarray) -> np.ndarray:
            wanted = place * (self.longest + 1) + np.minimum(length, self.longest)
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            hit = (keys[at] == wanted) & (length <= self.longest) if len(keys) else np.zeros(len(place), bool)
            return np.where(hit, ids[at] if len(keys) else 0, -1)

        short = sizes <= _LONG
        done: list[tuple[np.ndarray, np.ndarray]] = []  # start and length of final tokens
        own = sizes[short]
        start = np.arange(own.sum()) + np.repeat(first[short] - (np.cumsum(own) - own), own)
        length = np.ones(len(start), np.int64)
        owner = np.repeat(np.flatnonzero(short), sizes[short])
        while len(start) > 1:
            joined = edge(start[:-1], length[:-1] + length[1:])
            value = np.where((owner[:-1] == owner[1:]) & (joined >= 0), self.score[joined], -np.inf)
            groups = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.maximum.reduceat(np.append(value, -np.inf), groups)
            count = np.diff(np.append(groups, len(start)))
            live = np.repeat(best > -np.inf, count)
            if not live.all():  # segments without a further merge are finished
                done.append((start[~live], length[~live]))
            top = np.flatnonzero(live[:-1] & (value == np.repeat(best, count)[:-1]))
            _, leftmost = np.unique(owner[top], return_index=True)
            at = top[leftmost]
            length[at] += length[at + 1]
            live[at + 1] = False
            start, length, owner = start[live], length[live], owner[live]
        done.append((start, length))
        for k in np.flatnonzero(~short):
            done.append(self._merge_long(int(first[k]), int(sizes[k]), dict(zip(keys.tolist(), ids.tolist()))))
        start, length = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(start)
        start, length = start[order], length[order]
        piece = edge(start, length)
        cut = np.searchsorted(start, first)
        ends = np.append(cut[1:], len(start))
        raw = np.maximum(piece, 0).astype("<u4").tobytes()
        self.known.update((segment, raw[a:b]) for segment, a, b in zip(segments, (4 * cut).tolist(), (4 * ends).tolist()))
        # characters outside the vocabulary are spelled by bytes
        for k in np.unique(np.searchsorted(cut, np.flatnonzero(piece < 0), side="right") - 1).tolist():
            out: list[int] = []
            for i, s in zip(piece[cut[k]:ends[k]].tolist(), (start[cut[k]:ends[k]] - start[cut[k]]).tolist()):
                out += [i] if i >= 0 else [self.bytes[x] for x in segments[k][s].encode("utf-8", "replace")]
            self.known[segments[k]] = np.array(out, "<u4").tobytes()

    def _merge_long(self, first: int, size: int, edges: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        length, after, before = [1] * size, list(range(1, size + 1)), list(range(-1, size - 1))
        queue: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            n = length[i] + length[j] if j < size else self.longest + 1
            found = edges.get((first + i) * (self.longest + 1) + n, -1) if n <= self.longest else -1
            if found >= 0:
                heapq.heappush(queue, (-self.score[found], i, length[i], length[j]))

        for i in range(size - 1):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if length[i] != a or j >= size or length[j] != b:
                continue  # one of the two has changed since
            length[i], length[j], after[i] = a + b, 0, after[j]
            if after[j] < size:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        kept = [i for i in range(size) if length[i]]
        return np.array(kept, np.int64) + first, np.array([length[i] for i in kept], np.int64)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit words."""
        cuts = [segments_of(t or "") for t in texts]
        missing = {s for c in cuts for s in c if s not in self.known}
        if missing and len(self.known) + len(missing) > _KNOWN_SEGMENTS:
            self.known.clear()
            missing = {s for c in cuts for s in c}
        held, room = [], 0
        for s in sorted(missing):
            held.append(s)
            room += len(s) + 1
            if room > _INDEX_CHARACTERS:
                self._encode_new(held)
                held, room = [], 0
        if held:
            self._encode_new(held)
        return [b"".join(map(self.known.__getitem__, c)) for c in cuts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the blank that encoding put in front is taken away."""
        text = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text.removeprefix(" ")


def segments_of(text: str) -> list[str]:
    """A text behind one blank, cut before each run of blanks; an empty text has no segment."""
    if not text:
        return []
    text = text.replace(SPACE, " ")
    if "  " in text or text[0] == " ":
        return [s.replace(" ", SPACE) for s in re.findall(" *[^ ]+| +", " " + text)]
    return [SPACE + w for w in text.split(" ")]


def _coder(model: bytes) -> PieceCoder:
    key = hash(model)
    if key not in _CODERS:
        _CODERS[key] = PieceCoder(model)
    return _CODERS[key]


def encode(docs: DataFrame, model_path: str, with_ids: bool = True, text_column: str = "text") -> DataFrame:
    """``row`` (the document's columns), ``n_pieces``, ``ids_crc32``, ``round_trip`` and, if asked for, ``ids`` of every whole text.

    The ids are those of the model's own library.  ``round_trip`` says whether decoding gives the text back
    (a text that holds the vocabulary's blank sign itself comes back with blanks).  Null and empty texts have no
    ids; repeated rows, null identifiers and extra columns are carried; an empty table gives an
    empty result.  No row is shuffled; a worker's memory is bounded by its batch and its remembered segments.
    """
    with open(model_path, "rb") as f:
        box = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    names = ["row", "n_pieces", "ids_crc32", "round_trip", "ids"][: 4 + with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(box.value)
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), _ROWS):
                batch = whole.slice(at, _ROWS)
                texts = batch.column(0).field(text_column).to_pylist()
                ids = [np.frombuffer(x, "<u4") for x in coder.encode_batch(texts)]
                same = [coder.decode(x) == (t or "") for x, t in zip(ids, texts)]
                columns = [batch.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(same, pa.bool_())]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.struct("*").alias("row"))
    fields = [rows.schema["row"], T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()),
              T.StructField("round_trip", T.BooleanType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return rows.mapInArrow(run, T.StructType(fields[: 4 + with_ids]))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``row`` and ``text`` from ``row`` and ``ids``; null ids are the empty text."""
    with open(model_path, "rb") as f:
        box = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(box.value)
        for batch in batches:
            texts = [coder.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    rows = encoded.select("row", "ids")
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
