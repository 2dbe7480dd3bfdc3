"""Records of quoted CSV files, cut in parallel.

A line break may stand inside quotes, and whether it does depends on everything before it.  Each split is therefore
read once for both possibilities, which mostly agree after some lines; the end states are chained in order
(two numbers a split), and a second pass cuts the records, each split knowing how it begins.
"""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the rest of a quoted cell, up to and with its closing quote; text behind that quote belongs to the cell
_CLOSES = re.compile(r'(?:[^"]|"")*+"[^,]*+(?:,|$)')
_OPENS = re.compile(r'(?:"(?:[^"]|"")*+"[^,]*+,|[^",][^,]*+,|,)*+"(?:[^"]|"")*+')
HEAD, RECORD, TAIL = 0, 1, 2


def open_behind(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted cell, given whether it begins in one.

    A quote opens a cell only as its first character, and two quotes inside a cell stand for one.
    """
    if '"' not in line:
        return inside
    if inside:
        closed = _CLOSES.match(line)
        if not closed:
            return True
        if not closed.group().endswith(","):
            return False
        line = line[closed.end():]
    return _OPENS.fullmatch(line) is not None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The splits of a task, each with its lines, which are read as they come."""
    rows = ((file, split, line) for batch in batches for file, split, line in zip(*[c.to_pylist() for c in batch.columns]))
    row = next(rows, None)
    while row is not None:
        now = row[:2]

        def lines() -> Iterator[str]:
            nonlocal row
            while row is not None and row[:2] == now:
                yield row[2]
                row = next(rows, None)

        left = lines()
        yield now, left
        for _ in left:
            pass


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for (file, split), lines in _splits(batches):
        states, head, heading = [False, True], [], split == 0
        for line in lines:
            states = [open_behind(line, s) for s in states] if states[0] != states[1] else [open_behind(line, states[0])] * 2
            if heading and (head or line.strip("﻿\r")):
                head.append(line)
                heading = states[0]
        rows.append({"file": file, "split": split, "ends_0": states[0], "ends_1": states[1], "header": "\n".join(head) if split == 0 else None})
    yield pa.RecordBatch.from_pylist(rows, pa.schema([
        ("file", pa.string()), ("split", pa.int64()), ("ends_0", pa.bool_()), ("ends_1", pa.bool_()), ("header", pa.string())]))


def names_of(header: str) -> list[str]:
    """Column names of a header record; it must end within the first split of its file."""
    return next(csv.reader([header.lstrip("﻿").rstrip("\r")], strict=False), [])


def begin_states(ends: list[tuple]) -> dict[tuple[str, int], bool]:
    """Whether each split of each file begins inside quotes."""
    files = defaultdict(list)
    for file, split, *states in ends:
        files[file].append((split, states))
    found = {}
    for file, splits in files.items():
        inside = False
        for split, states in sorted(splits):
            found[file, split] = inside
            inside = states[inside]
    return found


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The columns of the schema from CSV files with a header each, of which one file may be many tasks.

    Columns are taken by the names in the header of their own file, in any order; an absent column, a missing
    cell and a cell that is not of its type are null; the first of two columns with one name counts.  Quoted cells may
    hold commas, doubled quotes and line breaks.  Lines end with a line feed, with or without a carriage return.  A quote
    that is never closed takes the rest of its file into one record.  A file is read twice, in splits of
    ``spark.sql.files.maxPartitionBytes``; lines are handled as they come, so a task holds one record and the lines of
    a batch.  Two numbers a split, and a header a file, come to the driver.  A compressed file is one task.
    """
    lines = _lines(spark, path)
    ends = [tuple(r) for r in lines.mapInArrow(_ends, "file string, split bigint, ends_0 boolean, ends_1 boolean, header string").collect()]
    headers = {e[0]: names_of(e[4]) for e in ends if e[4] is not None}
    width = max([1, *map(len, headers.values())])
    places = {file: [names.index(n) if n in names else width for n in schema.names] for file, names in headers.items()}
    box = spark.sparkContext.broadcast((begin_states([e[:4] for e in ends]), places))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, at = box.value
        kinds = pa.schema([("file", pa.string()), ("split", pa.int64()), ("kind", pa.int32()), ("text", pa.string()), ("at", pa.list_(pa.int32()))])
        for (file, split), lines_of in _splits(batches):
            inside, rows, parts, kind, heading = states[file, split], [], [], HEAD, split == 0

            def row(kind: int, text: str) -> None:
                rows.append({"file": file, "split": split, "kind": kind, "text": text, "at": at[file]})

            for line in lines_of:
                if not inside:
                    kind = RECORD
                parts.append(line)
                inside = open_behind(line, inside)
                if not inside:
                    text = "\n".join(parts).rstrip("\r")
                    if kind == HEAD:
                        row(kind, text)
                    elif text.strip("﻿"):
                        if not heading:
                            row(kind, text)
                        heading = False
                    parts = []
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows.clear()
            if parts:  # goes on in the next split; without one it is a record all the same
                row(HEAD if kind == HEAD else TAIL, "\n".join(parts))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)

    parts = lines.mapInArrow(cut, "file string, split bigint, kind int, text string, at array<int>")
    # what a split begins with, inside quotes, belongs to the last record left open before it: two rows a split at most
    before = Window.partitionBy("file").orderBy("split", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(F.col("kind") == TAIL, F.col("split")), ignorenulls=True).over(before)
    joined = parts.where(F.col("kind") != RECORD).withColumn("_owner", owner).groupBy("file", "_owner").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "kind", "text"))), lambda p: p["text"]), "\n").alias("text"),
        F.first("at").alias("at"))
    records = parts.where(F.col("kind") == RECORD).select("text", "at").unionAll(joined.select("text", "at"))
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    parsed = F.from_csv("text", cells.simpleString()[len("struct<"):-1].replace(":", " "), {"quote": '"', "escape": '"', "lineSep": "\u0001"})
    held = records.select("at", parsed.alias("r")).select("at", F.array(*[F.col(f"r.c{i}") for i in range(width)]).alias("cells"))

    def column(i: int, field: T.StructField) -> Column:
        return F.get("cells", F.get("at", F.lit(i))).try_cast(field.dataType).alias(field.name)

    return held.select(*[column(i, f) for i, f in enumerate(schema)])
