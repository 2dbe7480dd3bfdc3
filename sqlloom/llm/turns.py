"""Prefix trie of conversations from sorted turn-id matrices of range shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlloom.llm.common import numbered_rows, stored, text_of

_COLUMNS = 32  # turns of a matrix; longer conversations go on in the next one
_OUTPUT_ROWS = 20_000
_WORD = r"[^\x20\x09-\x0D]+"
_NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODES = pa.schema([
    ("shard", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("before", pa.int64()),
    ("ends", pa.string()), ("parent", pa.int64()), ("parent_first", pa.bool_()), ("parent_last", pa.bool_()),
    ("ending", pa.bool_()), ("first_ids", pa.list_(pa.int64())), ("first_words", pa.list_(pa.int64())), ("last_ids", pa.list_(pa.int64()))])
_NODES_DDL = ("shard int, depth bigint, conv_id bigint, first boolean, last boolean, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, "
              "before bigint, ends string, parent bigint, parent_first boolean, parent_last boolean, ending boolean, "
              "first_ids array<bigint>, first_words array<bigint>, last_ids array<bigint>")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``position`` (from 1), ``role``, ``text``: turns in order, null turns first, ties by role and text; nulls are empty."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    return turns.select("conv_id", at.cast("bigint").alias("position"), "role", "text")


def with_shared_heads(turns: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns, and all ``conv_id``: a conversation's first h turns are those of the conversation whose number ends its group of ``every``.

    h is crc32 of the decimal number modulo ``most + 1``.  A head that is shorter, or missing, leaves fewer turns, so a
    conversation may have none.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    members = turns.select("conv_id").distinct()
    heads = turns.where(F.col("position") <= most).select(F.col("conv_id").alias("_base"), "position", "role", "text")
    shared = members.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("_base"), h.alias("_h")).join(
        heads.hint("merge"), "_base").where("position <= _h").select("conv_id", "position", "role", "text")
    own = turns.where(F.col("position") > h).select("conv_id", (F.col("position") + most).alias("position"), "role", "text")
    return shared.unionAll(own), members


def _sequences(turns: DataFrame, members: DataFrame) -> DataFrame:
    """``conv_id``, ``ids``, ``words``: one number for each distinct (role, text), and the words of each text, in order.

    A turn is known by the SHA-256 of its role's length, role and text, so texts are not shuffled again.
    """
    key = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = stored(turns.select("conv_id", "position", key.alias("key"), F.regexp_count("text", F.lit(_WORD)).cast("bigint").alias("words")), "trie-turns")
    known = numbered_rows(stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("times")), "trie-distinct")).select("key", "id")
    gathered = rows.join(known.hint("merge"), "key").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "id", "words"))).alias("_t"))
    pick = lambda f: F.coalesce(F.transform("_t", lambda t: t[f]), F.array().cast("array<bigint>")).alias(f"{f}s" if f == "id" else f)
    return members.join(gathered.hint("merge"), "conv_id", "left").select("conv_id", pick("id"), pick("words"))


def _matrix(flat: np.ndarray, start: np.ndarray, size: np.ndarray, at: int) -> np.ndarray:
    """Turn ids ``at`` to ``at + _COLUMNS`` of rows, padded with -1 behind their end."""
    place = at + np.arange(_COLUMNS)
    inside = place < size[:, None]
    return np.where(inside, flat[np.where(inside, start[:, None] + place, 0)], -1)


def sorted_rows(flat: np.ndarray, start: np.ndarray, size: np.ndarray, conv: np.ndarray) -> np.ndarray:
    """Order of rows by their sequences, a prefix before what goes on, equals by ``conv``.

    Matrices are sorted from the deepest to the first, each by a stable lexsort of the rows that reach it.
    """
    by_conv = np.argsort(conv, kind="stable")
    order = np.empty(0, np.int64)
    deepest = int(size.max(initial=0))
    # rows by the matrix their last turn lies in; -1 for rows without a turn
    last = (size[by_conv] - 1) // _COLUMNS
    by_last = by_conv[np.argsort(last, kind="stable")]
    cut = np.searchsorted(np.sort(last), np.arange(-1, (deepest - 1) // _COLUMNS + 2))
    for m in reversed(range((deepest - 1) // _COLUMNS + 1)):
        order = np.concatenate((by_last[cut[m + 1]:cut[m + 2]], order))
        block = _matrix(flat, start[order], size[order], m * _COLUMNS)
        order = order[np.lexsort(block.T[::-1])]
    return np.concatenate((by_last[cut[0]:cut[1]], order))


def shared_prefix(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many turns each sorted row shares with the row before it; -1 for the first.

    Change masks of neighbouring rows are OR-accumulated over the columns, so a row begins a node at each depth
    from its first change on; rows go on into the next matrix with the groups they have formed.
    """
    shared = np.minimum(size, np.concatenate(([0], size[:-1])))
    rows, group = np.arange(len(size)), np.zeros(len(size), np.int64)
    for at in range(0, int(size.max(initial=0)), _COLUMNS):
        reach = size[rows] > at
        rows, group = rows[reach], group[reach]
        block = _matrix(flat, start[rows], size[rows], at)
        changed = np.logical_or.accumulate(np.concatenate(((group[1:] != group[:-1])[:, None], block[1:] != block[:-1]), axis=1), axis=1)
        broken = changed[:, -1] & ~changed[:, 0]
        shared[rows[1:][broken]] = at + np.argmax(changed[broken], axis=1) - 1
        group = np.concatenate(([0], np.cumsum(changed[:, -1])))
    shared[:1] = -1
    return shared


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one range of sequences, one row (``ending``) for each conversation that ends on its first or last path, and its edges.

    All sums run over rows: a node's leaves are the rows that no following row goes on from, its children
    and the words of its nodes belong to the rows that begin them.  So parts of a node in several
    shards add up once the first row of each shard knows what it shares with the row before.
    """
    from pyspark import TaskContext

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    conv = table.column("conv_id").to_numpy()
    ids, words = (table.column(c).combine_chunks() for c in ("ids", "words"))
    size = np.asarray(ids.value_lengths()).astype(np.int64)
    flat, flat_words = ids.flatten().to_numpy(), words.flatten().to_numpy()
    flat = flat if len(flat) else np.zeros(1, np.int64)
    start = np.cumsum(size) - size
    order = sorted_rows(flat, start, size, conv)
    conv, size, start = conv[order], size[order], start[order]
    shared = shared_prefix(flat, start, size)
    total = np.concatenate(([0], np.cumsum(flat_words)))
    all_words = total[start + size] - total[start]
    new_words = all_words - (total[start + np.maximum(shared, 0)] - total[start])
    leaf = (np.append(shared[1:], -1) < size).astype(np.int64)
    shard, n, top = TaskContext.get().partitionId(), len(conv), len(conv) - 1
    null = lambda k, field: pa.nulls(k, _NODES.field(field).type)
    edge = [null(1, f) for f in _NODES.names]
    edge[0] = pa.array([shard], pa.int32())
    for k, (row, values) in zip((-3, -2, -1), ((0, flat), (0, flat_words), (top, flat))):
        edge[k] = pa.array([values[start[row]:start[row] + size[row]]], _NODES.types[k])
    yield pa.RecordBatch.from_arrays(edge, schema=_NODES)

    waiting: list[pa.RecordBatch] = []
    pending = 0
    rows, parent = np.arange(n), None
    for depth in range(int(size.max()) + 1):
        if depth:
            reach = size[rows] >= depth
            node_of = node_of[reach]
            rows = rows[reach]
        begins = shared[rows] < depth
        at = np.flatnonzero(begins)
        lead = rows[at]
        before = total[start[lead] + depth - 1] - total[start[lead]] if depth else np.zeros(1, np.int64)
        many = np.diff(np.append(at, len(rows)))
        least = np.minimum.reduceat(conv[rows], at)
        tokens = np.add.reduceat(all_words[rows], at) - many * before
        single = np.add.reduceat(new_words[rows], at) - new_words[lead] + all_words[lead] - before
        going = (size[rows] > depth) & (shared[rows] <= depth)
        first, last = lead == 0, rows[np.append(at[1:], len(rows)) - 1] == top
        up = parent[0][node_of[at]] if depth else np.zeros(1, np.int64)
        sides = [x[node_of[at]] if depth else np.zeros(1, bool) for x in parent[1:]] if depth else [np.zeros(1, bool)] * 2
        node_of = np.cumsum(begins) - 1
        ends = np.full(len(at), _NO_ENDS, object)
        ending = np.flatnonzero(size[rows] == depth)
        edgewise = (first | last)[node_of[ending]]
        inner = ending[~edgewise]
        if len(inner):
            cuts = np.flatnonzero(np.concatenate(([True], node_of[inner][1:] != node_of[inner][:-1], [True])))
            for a, b in zip(cuts[:-1], cuts[1:]):
                ends[node_of[inner[a]]] = hashlib.sha256(",".join(map(str, conv[rows[inner[a:b]]].tolist())).encode()).hexdigest()
        k = len(at)
        made = [np.full(k, shard, np.int32), np.full(k, depth), least, first, last, many, np.add.reduceat(going.astype(np.int64), at),
                np.add.reduceat(leaf[rows], at), tokens - single, before, ends, up, *sides, np.zeros(k, bool)]
        waiting.append(pa.RecordBatch.from_arrays([*[pa.array(x, t, mask=np.full(k, depth == 0) if f == "parent" else None) for x, f, t in zip(made, _NODES.names, _NODES.types)],
                                                   *[null(k, f) for f in _NODES.names[15:]]], schema=_NODES))
        outer = ending[edgewise]
        if len(outer):
            k, own = len(outer), node_of[outer]
            marks = {"shard": np.full(k, shard, np.int32), "depth": np.full(k, depth), "conv_id": conv[rows[outer]], "first": first[own], "last": last[own], "ending": np.ones(k, bool)}
            waiting.append(pa.RecordBatch.from_arrays([pa.array(marks[f], t) if f in marks else null(k, f) for f, t in zip(_NODES.names, _NODES.types)], schema=_NODES))
        parent = (least, first, last)
        pending += len(at) + len(outer)
        if pending > _OUTPUT_ROWS:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, pending = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def owners(edges: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(shard, from depth, to depth, owner): in which shard the nodes on the first path of each shard began.

    ``edges`` lists, by shard, what its first row shares with the last row before it (-1 for none), what its first and last rows
    share, and the length of its last row.  The stack holds the last path of the shards so far.
    """
    stack: list[tuple[int, int, int]] = []

    def cut(depth: int) -> None:
        while stack and stack[-1][0] > depth:
            stack.pop()
        if stack and stack[-1][1] > depth:
            stack[-1] = (stack[-1][0], depth, stack[-1][2])

    found = []
    for shard, shared, across, length in edges:
        cut(shared)
        found += [(shard, *s) for s in stack]
        kept = min(shared, across)
        cut(kept)
        if length > kept:
            stack.append((kept + 1, length, shard))
    return found


def _hashed_ends(ends: DataFrame, key: list[str]) -> DataFrame:
    """SHA-256 of the sorted, comma-joined numbers of each key, hashed as they stream by, so a hot key needs no memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def flush() -> pa.RecordBatch:
            columns = zip(*done) if done else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.string()))], names=[*key, "_sha"])

        for batch in batches:
            *keys, conv = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(conv):
                continue
            new = np.zeros(len(conv), bool)
            new[0] = True
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            cuts = [*np.flatnonzero(new).tolist(), len(conv)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                own = tuple(int(k[a]) for k in keys)
                line = ",".join(map(str, conv[a:b].tolist())).encode()
                if own == now:
                    state.update(b"," + line)
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = own, hashlib.sha256(line)
            yield flush()
            done.clear()
        if now is not None:
            done.append((*now, state.hexdigest()))
            yield flush()

    return ends.select(*key, "conv_id").repartition(*key).sortWithinPartitions(*key, "conv_id").mapInArrow(
        run, "owner int, depth bigint, tag int, _sha string")


def _common(a: str, b: str) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(a).cast("bigint"))


def prefix_trie(turns: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Every distinct sequence of first turns as a node, from the empty root.

    ``turns`` has ``conv_id``, ``position``, ``role``, ``text``; ``members`` lists all ``conv_id``, turnless ones too
    (absent: those of ``turns``).  Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves`` (childless nodes below, itself included), ``saved_tokens`` (over the subtree, (members - 1) times the words of a
    node's last text) and ``ends_sha256`` (numbers of the members that end there).

    Sequences are range-sharded with ``conv_id`` as the last key, so equal conversations fill as many shards as they need.  A shard sorts
    its padded matrices and adds up every depth; nodes on the border of shards are added up again.  The driver
    sees four numbers for each shard.  The turn ids of one conversation, not its texts, are one row.

    Null ``conv_id`` name no conversation and are left out; null role or text is empty; ties and repeated rows are turns of their own, ordered by
    role and text; extra columns are ignored; an empty table gives an empty result.
    """
    spark = turns.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sequences = stored(_sequences(turns, turns.select("conv_id").distinct() if members is None else members), "trie-sequences")
    made = stored(sequences.repartitionByRange(shards, "ids", "conv_id").mapInArrow(_shard, _NODES_DDL), "trie-shards")
    by_shard = Window.orderBy("shard")  # one row a shard
    edge = made.where("first_ids IS NOT NULL").select("shard", "first_ids", "first_words", "last_ids", F.lag("last_ids").over(by_shard).alias("_prior")).select(
        "shard", F.when(F.col("_prior").isNull(), F.lit(-1)).otherwise(_common("first_ids", "_prior")).alias("b_prev"),
        _common("first_ids", "last_ids").alias("across"), F.size("last_ids").cast("bigint").alias("length"), "first_words").select(
        "shard", "b_prev", "across", "length", F.aggregate(F.slice("first_words", F.lit(1), F.greatest("b_prev", F.lit(0))), F.lit(0).cast("bigint"), lambda s, w: s + w).alias("words"))
    edges = sorted(tuple(r) for r in edge.collect())
    spans = spark.createDataFrame(owners([e[:4] for e in edges]), "shard int, d_from bigint, d_to bigint, s_owner int")
    following = [e[1] for e in edges[1:]] + [-1]
    known = spark.createDataFrame([(e[0], e[1], after, e[3], e[4]) for e, after in zip(edges, following)], "shard int, b_prev bigint, b_next bigint, length bigint, words bigint")

    def located(df: DataFrame, depth: Column, first: str, last: str, owner: str, tag: str) -> DataFrame:
        """Adds the shard where a node began and whether it is shared (tag 0) or whole (1 on the first path, 2 otherwise)."""
        from_before = F.col(first) & (depth <= F.col("b_prev"))
        span = F.broadcast(spans.select(F.col("shard").alias("_s"), "d_from", "d_to", "s_owner"))  # bounded by the shards
        out = df.join(span, from_before & (F.col("shard") == F.col("_s")) & depth.between(F.col("d_from"), F.col("d_to")), "left")
        is_shared = from_before | (F.col(last) & (depth <= F.col("b_next")))
        return out.select(*df.columns, F.coalesce("s_owner", "shard").alias(owner), F.when(is_shared, 0).when(F.col(first), 1).otherwise(2).alias(tag))

    rows = made.where("first_ids IS NULL").join(F.broadcast(known), "shard")
    rows = located(rows, F.col("depth"), "first", "last", "owner", "tag")
    nodes = located(rows.where("NOT ending"), F.col("depth") - 1, "parent_first", "parent_last", "parent_owner", "parent_tag")
    key = ["owner", "depth", "tag"]
    hashed = _hashed_ends(rows.where("ending"), key)

    inside_before, at_end = F.col("first") & (F.col("depth") <= F.col("b_prev")), F.col("last") & (F.col("b_next") >= F.col("length"))
    parts = nodes.where("tag = 0").withColumns({
        "n_children": F.col("n_children") - F.when(inside_before & (F.col("b_prev") > F.col("depth")), 1).otherwise(0),
        "n_leaves": F.col("n_leaves") - F.when(at_end, 1).otherwise(0),
        # its first row brings no nodes up to the depth that it shares with the row before
        "saved": F.col("saved") + F.when(inside_before, F.col("words") - F.col("before")).otherwise(0)})
    joint = parts.groupBy("owner", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.min("parent_owner").alias("parent_owner"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")])
    above = joint.select(F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_above"))
    # a whole node finds its shared parent by its own shard, so the many children of a hot node are spread
    local = parts.select("shard", "owner", "depth").join(joint.select("owner", "depth", F.col("conv_id").alias("_above")), ["owner", "depth"]).select(
        "shard", F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), "_above")
    sums = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved"]
    whole = nodes.where("tag > 0")
    apart = whole.where("parent_tag > 0 OR depth = 0").select(*sums, "owner", "tag", "first", "last", "ends", "parent")
    below = whole.where("parent_tag = 0 AND depth > 0").join(local.hint("merge"), ["shard", "parent_owner", "depth"]).select(
        *sums, "owner", "tag", "first", "last", "ends", F.col("_above").alias("parent"))
    border = joint.join(above.hint("merge"), ["parent_owner", "depth"], "left").select(
        *sums, "owner", F.lit(0).alias("tag"), F.lit(True).alias("first"), F.lit(True).alias("last"), F.lit(_NO_ENDS).alias("ends"), F.col("_above").alias("parent"))
    ready = lambda df, ends: df.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), ends.alias("ends_sha256"))
    everything = apart.unionAll(below).unionAll(border)
    inner = everything.where("NOT (first OR last)")
    outer = everything.where("first OR last").join(hashed.hint("merge"), key, "left")
    return ready(inner, F.col("ends")).unionAll(ready(outer, F.coalesce("_sha", "ends")))
