"""Byte-pair encoding by a queue of merge ranks, and decoding."""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KNOWN_CHUNKS, _KNOWN_WORDS = 800_000, 400_000  # kept in a worker with their ids; more are encoded anew
_LONGEST_KNOWN = 64  # longer ones are encoded each time, so what is kept stays bounded
_OUTPUT_CHARACTERS = 2_000_000  # text encoded before a batch is handed on
_SEPARATORS = re.compile("[\x1c-\x1f]")  # Python cuts at them, the Unicode property White_Space does not hold them
_CODERS: dict[int, MergeCoder] = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 stands for itself, the others follow from code point 256 on."""
    plain = {b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _class_body(holds: Callable[[str], bool]) -> str:
    """The inside of a character class: the ranges of code points that a property holds for."""
    points = [c for c in range(sys.maxunicode + 1) if holds(chr(c))]
    starts = [c for c, before in zip(points, [-2, *points]) if c != before + 1]
    ends = [c for c, after in zip(points, [*points[1:], -2]) if c != after - 1]
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(starts, ends))


class MergeCoder:
    """Encoder and decoder of a ``tokenizers`` file with a byte-level BPE model whose words never hold white space.

    A file that asks for anything else (another model or normalizer, drop-out, prefixes, words with blanks) is refused.
    White space ends every word and composes with nothing, so a text falls apart at ASCII white space and
    what an earlier text has brought is remembered.  Letters and digits are those of Python's Unicode tables; the few of a
    later version count as symbols.
    """

    def __init__(self, definition: str):
        d = json.loads(definition)
        model, before, split = d["model"], d["normalizer"], d["pre_tokenizer"]
        steps = before["normalizers"] if before and before["type"] == "Sequence" else []
        kinds = [s["type"] for s in steps]
        cuts = split["pretokenizers"] if split and split["type"] == "Sequence" else []
        fits = (
            model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and kinds == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " "
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
            and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"] and d["decoder"] is None and not d["post_processor"]
            and not any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in d["added_tokens"])
        )
        if not fits:
            raise ValueError("not a byte-level BPE over lower-cased words")
        pattern = cuts[0]["pattern"]["Regex"]
        for name, holds in ((r"\p{L}", lambda c: unicodedata.category(c)[0] == "L"), (r"\p{N}", lambda c: unicodedata.category(c)[0] == "N"),
                            (r"\s", lambda c: c.isspace() and not _SEPARATORS.match(c))):
            pattern = pattern.replace(name, _class_body(holds))
        self.words = re.compile(pattern)
        if self.words.search(" \t\n\x85\xa0　"):
            raise ValueError("words of this file hold white space")
        added = {a["content"]: a["id"] for a in d["added_tokens"]}
        self.added, self.added_at = added, re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        vocabulary = model["vocab"]
        self.base = max([*vocabulary.values(), *added.values()]) + 1
        self.spell = [""] * self.base
        for token, i in [*vocabulary.items(), *added.items()]:
            self.spell[i] = token
        letters, end = _byte_letters(), model.get("end_of_word_suffix") or ""
        self.inner = [vocabulary.get(c, -1) for c in letters]
        self.final = [vocabulary.get(c + end, -1) for c in letters]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.made = [vocabulary[a + b] for a, b in merges]  # by rank
        self.rank = {vocabulary[a] * self.base + vocabulary[b]: r for r, (a, b) in enumerate(merges)}
        self.known_words: dict[str, list[int]] = {}
        self.known: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Join neighbours, the pair of lowest rank first and the leftmost of equals, until no pair has a rank.

        Symbols are a doubly linked list; the queue holds rank and place.  An entry is stale, and
        skipped, when the symbols at its place no longer make the token it was put in for.
        """
        n, base, ranks, made = len(symbols), self.base, self.rank, self.made
        get, pop, push = ranks.get, heapq.heappop, heapq.heappush
        queue = []
        for i in range(n - 1):
            r = get(symbols[i] * base + symbols[i + 1])
            if r is not None:
                queue.append(r * n + i)
        if not queue:
            return symbols
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            rank, i = divmod(pop(queue), n)
            j = after[i]
            if symbols[i] < 0 or j == n:
                continue
            now = get(symbols[i] * base + symbols[j])
            if now is None or made[now] != made[rank]:
                continue
            symbols[i], symbols[j] = made[rank], -1
            k, p = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                r = get(symbols[i] * base + symbols[k])
                if r is not None:
                    push(queue, r * n + i)
            if p >= 0:
                r = get(symbols[p] * base + symbols[i])
                if r is not None:
                    push(queue, r * n + p)
        return [s for s in symbols if s >= 0]

    def _word(self, word: str) -> list[int]:
        found = self.known_words.get(word)
        if found is None:
            raw = word.encode("utf-8", "replace")
            symbols = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
            found = self.merge([s for s in symbols if s >= 0])  # as in the library, a byte outside the vocabulary is left out
            if len(word) <= _LONGEST_KNOWN:
                self.known_words[word] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a text without ASCII white space and added tokens, as little-endian 32-bit words."""
        if not chunk.isascii():
            # letter by letter: a capital sigma has one small form wherever it stands
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        ids: list[int] = []
        for word in self.words.findall(chunk.lower()):
            ids += self._word(word)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit words; null is the empty text."""
        if not text:
            return b""
        if self.added_at and self.added_at.search(text):
            parts = self.added_at.split(text)
            return b"".join(np.array([self.added[p]], "<u4").tobytes() if i % 2 else self.encode(p) for i, p in enumerate(parts))
        # no word reaches over white space; where there are separators, the pattern finds it
        chunks = [text] if _SEPARATORS.search(text) else text.split()
        known = self.known
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            pass
        if len(known) > _KNOWN_CHUNKS:
            known.clear()
        if len(self.known_words) > _KNOWN_WORDS:
            self.known_words.clear()
        out = []
        for c in chunks:
            ids = known.get(c)
            if ids is None:
                ids = self._chunk(c)
                if len(c) <= _LONGEST_KNOWN:
                    known[c] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary's strings one after the other; a file without a decoder puts a blank between them."""
        spell = self.spell
        return " ".join([spell[i] for i in ids.tolist() if 0 <= i < self.base])


def _coder(definition: str) -> MergeCoder:
    key = hash(definition)
    if key not in _CODERS:
        _CODERS[key] = MergeCoder(definition)
    return _CODERS[key]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs of rows of bounded text, one row at least."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset:texts.offset + len(texts) + 1]) if len(texts) else []
    at = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > _OUTPUT_CHARACTERS:
            yield at, i - at
            at, held = i, 0
        held += n
    yield at, len(texts) - at


def encode(docs: DataFrame, tokenizer: str, text_column: str = "text", with_decoded: bool = False) -> DataFrame:
    """``row`` (the document's columns), ``ids`` and, if asked for, ``decoded`` of every whole text.

    The ids are those of the file's own library without added special tokens, truncation or padding; strings of special
    tokens inside a text are these tokens.  ``decoded`` is made from the ids alone.  Null and empty texts have no ids and
    decode to the empty text; repeated rows, null identifiers and extra columns are carried, in ``row``, so
    names cannot clash; an empty table gives an empty result.  No row is shuffled; a worker's memory is
    bounded by its batch, its longest text and its remembered words.
    """
    with open(tokenizer, encoding="utf-8") as f:
        box = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    names = ["row", "ids", "decoded"][: 2 + with_decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(box.value)
        for whole in batches:
            texts = whole.column(0).field(text_column)
            for at, n in _slices(texts):
                ids = [np.frombuffer(coder.encode(t), "<u4").astype(np.int32) for t in texts.slice(at, n).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64))).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                columns = [whole.column(0).slice(at, n), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if with_decoded:
                    columns.append(pa.array([coder.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.struct("*").alias("row"))
    fields = [rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return rows.mapInArrow(run, T.StructType(fields[: 2 + with_decoded]))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``row`` and ``decoded`` from ``row`` and ``ids``; null ids are the empty text, and ids outside the vocabulary are left out."""
    with open(tokenizer, encoding="utf-8") as f:
        box = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(box.value)
        for batch in batches:
            texts = [coder.decode(np.array([i for i in x.as_py() or [] if i is not None], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "decoded"])

    rows = encoded.select("row", "ids")
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("decoded", T.StringType())]))
