"""Records of JSON files, lists and lines alike, cut in parallel.

A JSON list cannot be split at line breaks.  Spark's text source is asked to cut at ``}`` instead, which it can do from
any byte offset; whether such a place lies inside a string, and how deep, depends on everything before it.  So a first
pass sums up every split for both possibilities, the sums are combined in order (a few numbers a split), and
a second pass cuts the records, each split knowing how it begins.  A record that reaches over splits is put together
from its parts.  Both passes scan a split block after block, so a task holds a block and the record that is open.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTE, _ESCAPE, _BREAK = ord('"'), ord("\\"), ord("\n")
_DEPTH = np.zeros(256, np.int8)
_DEPTH[[ord("{"), ord("[")]] = 1
_DEPTH[[ord("}"), ord("]")]] = -1
_BLANK = np.isin(np.arange(256), list(b" \t\r"))


@dataclass
class Scan:
    """What the bytes of a split mean when it begins inside (1) or outside (0) a string."""

    data: np.ndarray
    in_string: np.ndarray  # before each byte, and behind the last one
    change: np.ndarray  # of depth by each byte
    starts_line: np.ndarray  # places of "{" that are the first thing on a line
    indent: np.ndarray  # their distance from the line break

    @property
    def ends_in_string(self) -> int:
        return int(self.in_string[-1])


def scan(data: bytes, begins_in_string: int) -> Scan:
    """A string ends at the next quote that no backslash escapes; a raw line break, which JSON forbids in strings, ends it too."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    quote = raw == _QUOTE
    if b"\\" in data:  # a byte is escaped if an odd run of backslashes stands before it
        at, slash = np.arange(n, dtype=np.int32), raw == _ESCAPE
        last_other = np.maximum.accumulate(np.where(slash, np.int32(-1), at))
        quote[1:] &= ~(slash[:-1] & ((at[:-1] - last_other[:-1]) % 2 == 1))
    seen = np.concatenate((np.zeros(1, np.int32), np.cumsum(quote, dtype=np.int32)))  # quotes before each byte
    # quotes before the line of each byte; the first line goes on from what is before
    breaks = np.flatnonzero(raw == _BREAK)
    before_line = np.repeat(np.concatenate(([np.int32(-begins_in_string)], seen[breaks])), np.diff(np.concatenate(([0], breaks + 1, [n + 1]))))
    in_string = ((seen - before_line) & 1).astype(bool)
    change = np.where(in_string[:-1], np.int8(0), _DEPTH[raw])
    opening = np.flatnonzero((raw == ord("{")) & ~in_string[:-1])
    solid = np.concatenate(([-1], np.flatnonzero(~_BLANK[raw])))  # bytes that are no blanks
    before = solid[np.searchsorted(solid, opening) - 1]
    on_line = (before >= 0) & (raw[before] == _BREAK) if n else opening
    first = opening[on_line]
    return Scan(raw, in_string, change, first, first - before[on_line] - 1)


def record_starts(s: Scan, depth: int, base: int, indent: int) -> np.ndarray:
    """Places where a record begins: an opening brace at the depth of the records.

    A line that begins with a brace as far from its start as the file's first record does begins a record in any case, so
    that a broken record does not take the following ones with it (``indent`` below 0: no such line).
    """
    total = np.cumsum(s.change, dtype=np.int64) - s.change  # before each byte
    sure = s.starts_line[s.indent == indent] if indent >= 0 else s.starts_line[:0]
    opening = np.flatnonzero((s.data == ord("{")) & ~s.in_string[:-1])
    level = depth + total[opening]
    if len(sure):
        last = np.searchsorted(sure, opening, side="right")
        level = np.where(last > 0, base + total[opening] - total[sure[last - 1]], level)
    return opening[level == base]


def depth_behind(s: Scan, depth: int, base: int, indent: int) -> int:
    """The depth behind the last byte, by the same rule as ``record_starts``."""
    sure = s.starts_line[s.indent == indent] if indent >= 0 else s.starts_line[:0]
    return base + int(s.change[sure[-1]:].sum(dtype=np.int64)) if len(sure) else depth + int(s.change.sum(dtype=np.int64))


def _first_record(data: bytes, before: bytes) -> int | None:
    """The indent of the first record, -1 if something stands before it on its line, or None without one; ``before`` is what precedes the bytes."""
    at = data.find(b"{")
    if at < 0:
        return None
    line = (before + data[:at]).rpartition(b"\n")[2]
    return len(line) if not line.strip(b" \t\r\xef\xbb\xbf") else -1


_SUM = ("file string, split bigint, size bigint, file_size bigint, base int, indent int, ends_0 int, ends_1 int, depth_0 bigint, depth_1 bigint, "
        "after map<int,bigint>")
_BLOCK = 1 << 20  # bytes scanned at once; a scan holds some dozen times as many


def _split_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], bytes, bool]]:
    """((file, split, file size), bytes, whether they are the last) of each split of a task, block after block.

    The braces that the reader cut at are put back, so a block ends behind a brace and no escape reaches over its end.
    """
    now, parts, held = None, [], 0
    for batch in batches:
        for file, split, size, text in zip(*[c.to_pylist() for c in batch.columns]):
            if (file, split, size) != now:
                if now:
                    yield now, b"".join(parts), True
                now, parts, held = (file, split, size), [], 0
            elif held >= _BLOCK:
                yield now, b"".join(parts), False
                parts, held = [], 0
            data = text.encode()
            parts += [data, b"}"]
            held += len(data) + 1
    if now:
        yield now, b"".join(parts), True


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, new = [], True
    for (file, split, file_size), data, last in _split_blocks(batches):
        if new:
            base, indent = int(split == 0 and data.lstrip(b" \t\r\n\xef\xbb\xbf")[:1] == b"["), None if split == 0 else -1
            size, ends, depth, after = 0, [0, 1], [0, 0], {}
        if indent is None:
            indent = _first_record(data, b"" if new else b"}")
        out = scan(data, ends[0])
        change = int(out.change.sum(dtype=np.int64))
        if ends[0] == ends[1]:
            ends, depth = [out.ends_in_string] * 2, [d + change for d in depth]
        else:
            line = data.find(b"\n") + 1 or len(data)  # the possibilities differ up to the first line break only
            other = scan(data[:line], ends[1])
            depth = [depth[0] + change, depth[1] + int(other.change.sum(dtype=np.int64)) + int(out.change[line:].sum(dtype=np.int64))]
            ends = [out.ends_in_string, other.ends_in_string if line == len(data) else out.ends_in_string]
        # what follows the last line that begins a record, for each indent
        after = {i: d + change for i, d in after.items()}
        at, place = np.unique(out.indent[::-1], return_index=True)
        after |= {int(i): int(out.change[out.starts_line[::-1][p]:].sum(dtype=np.int64)) for i, p in zip(at, place)}
        size, new = size + len(data), last
        if last:
            rows.append((file, split, size, file_size, base, -1 if indent is None else indent, *ends, *depth, list(after.items())))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.map_(pa.int32(), pa.int64())]
    names = [f.split()[0] for f in _SUM.replace("int,bigint", "").split(", ")]
    columns = zip(*rows) if rows else [[]] * len(kinds)
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"), "value")


def split_sums(spark: SparkSession, path: str) -> DataFrame:
    """One row for each split of the files: how it ends and what it does to the depth, begun outside and inside a string."""
    return _chunks(spark, path).mapInArrow(_sums, _SUM)


def begin_states(sums: list[tuple]) -> list[tuple]:
    """(file, split, in string, depth, base, indent, whole) from the sums of all splits; ``whole`` tells that the last brace of a file is its own."""
    files = defaultdict(list)
    for s in sums:
        files[s[0]].append(s)
    found = []
    for file, splits in files.items():
        splits.sort(key=lambda s: s[1])
        base, indent = splits[0][4], splits[0][5]
        inside, depth, size = 0, 0, sum(s[2] for s in splits)
        for s in splits:
            # the reader gives no sign whether a brace or the end of the file ended the last part; its size does
            whole = s is not splits[-1] or size <= s[3]
            found.append((file, s[1], inside, depth, base, indent, whole))
            depth = base + s[10][indent] if indent in s[10] else depth + s[8 + inside]
            inside = s[6 + inside]
    return found


_PARTS = "file string, split bigint, place bigint, kind int, text binary"
HEAD, RECORD, TAIL = 0, 1, 2


def record_spans(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``place`` (byte offset within its split's text), ``split``, ``text``: every record of JSON files, and what stands between records.

    Files may be lists or hold one record after another, on one line or several, and are cut into splits of
    ``spark.sql.files.maxPartitionBytes``.  Each record is one row; other text than blanks, commas and the brackets
    of the list is a row too, so nothing is lost.  Compressed files, which cannot be split, are one task.
    """
    chunks = _chunks(spark, path)
    sums = [tuple(r) for r in split_sums(spark, path).collect()]  # one row a split
    states = {(s[0], s[1]): s[2:] for s in begin_states(sums)}
    box = spark.sparkContext.broadcast(states)

    def cut(batches: Iterator[pa.RecordBatch], inner: bool) -> Iterator[pa.RecordBatch]:
        """The records that begin and end in a split (``inner``), or else what stands before and behind them."""
        def batch(file: str, split: int, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            kind, place, text = zip(*rows)
            k = len(rows)
            return pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(file), k), pa.array([split] * k, pa.int64()), pa.array(place, pa.int64()), pa.array(kind, pa.int32()), pa.array(text, pa.binary())],
                names=["file", "split", "place", "kind", "text"])

        new = True
        for (file, split, _), data, last in _split_blocks(batches):
            if new:
                inside, depth, base, indent, whole = box.value[file, split]
                kind, place, held, offset = HEAD, 0, [], 0  # the span that is open
            data = data if whole or not last else data[:-1]
            s, rows, begin = scan(data, inside), [], 0
            for start in record_starts(s, depth, base, indent).tolist():
                if inner == (kind == RECORD):
                    rows.append((kind, place, b"".join([*held, data[begin:start]])))
                kind, place, held, begin = RECORD, offset + start, [], start
            held.append(data[begin:])
            inside, depth, offset, new = s.ends_in_string, depth_behind(s, depth, base, indent), offset + len(data), last
            if last and not inner:
                rows.append((TAIL if kind == RECORD else HEAD, place, b"".join(held)))
            if rows:
                yield batch(file, split, rows)

    def parts(inner: bool) -> DataFrame:
        return chunks.mapInArrow(lambda batches: cut(batches, inner), _PARTS)

    # the beginning of a split belongs to the last record that began before it: a few rows a split
    by_file = Window.partitionBy("file").orderBy("split", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(F.col("kind") == TAIL, F.struct("split", "place")), ignorenulls=True).over(by_file)
    joined = parts(False).withColumn("_owner", owner).groupBy("file", "_owner").agg(
        F.sort_array(F.collect_list(F.struct("split", "kind", "text"))).alias("_p")).select(
        "file", F.coalesce("_owner.split", F.lit(0)).alias("split"), F.coalesce("_owner.place", F.lit(0)).cast("bigint").alias("place"),
        F.aggregate("_p", F.lit(b""), lambda s, p: F.concat(s, p["text"])).alias("text"))
    text = F.regexp_replace(F.col("text").cast("string"), r"^[\s\x{FEFF},\[]+|(?<![\s,\]])[\s,\]]+$", "")
    spans = parts(True).select("file", "split", "place", "text").unionAll(joined).select("file", "split", "place", text.alias("text"))
    # behind the last brace of a record there may be text that belongs to none
    end = F.char_length("text") - F.char_length(F.substring_index("text", "}", -1))
    pieces = F.when(F.col("text").startswith("{") & (end > 0), F.array(F.substring("text", F.lit(1), end), F.substring("text", end + 1, F.char_length("text")))).otherwise(F.array("text"))
    clean = F.transform(pieces, lambda p: F.regexp_replace(p, r"^[\s,\]]+", ""))
    return spans.select("file", "split", "place", F.explode(F.filter(clean, lambda p: p != "")).alias("text"))


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The columns of the schema and ``rejected``: the text of a span that is no record of the schema, with nulls before it."""
    mark = T.StructType([*schema.fields, T.StructField("_unreadable", T.StringType())])
    # a scalar or list would be read as a record of nulls
    record = F.when(F.col("text").startswith("{"), F.from_json("text", mark, {"columnNameOfCorruptRecord": "_unreadable"}))
    bad = F.col("r").isNull() | F.col("r._unreadable").isNotNull()
    return record_spans(spark, path).select("text", record.alias("r")).select(
        *[F.when(~bad, F.col(f"r.`{f.name}`")).alias(f.name) for f in schema], F.when(bad, F.col("text")).alias("rejected"))
