"""The prefix trie of conversations: union-find over the common prefixes of sorted neighbours.

A conversation is the sequence of its turns' digests (16 bytes each of role and
text). Equal sequences are brought together first, so a group of copies is one
sequence with a count. Distinct sequences are sorted over all tasks; the longest
common prefix (LCP) of each with the one before is an edge of that depth. Edges
are taken in descending depth, and a union of two components at a depth gives the branching
node there; below it, nodes with one child follow the longer sequence. Sorted in that way the
nodes are a preorder, so what a subtree holds is summed up level by level.

A task does this for blocks of bounded size. Nodes on the first or the last sequence
of a block may go on in the block beside it: they stay open, and the block is
contracted to these two sequences with what is known of each open node. Contracted
blocks are merged by the same function, FAN_IN neighbours a task and round,
until one is left. A closed node whose parent is still open names it by the digest of its
prefix, and gets its number when that parent is closed.

Defined results: turns without a conversation id belong to none. Turns are in the order of
(turn, role, text), nulls first, so repeated turns stand beside each other. Null roles and texts are empty.
An empty table has no node. A conversation without turns after being rebuilt ends in the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import checkpointed

#: Bytes of a turn's digest, and of a turn in a packed sequence: digest and number of words (8 bytes).
DIGEST, TURN = 16, 24
#: Turns of a block, and blocks that one task merges.
BLOCK, FAN_IN = 200_000, 64
#: Ids that are joined to one piece of text before they are hashed.
PIECE = 4_096
#: Named nodes that may be sent to all executors: 12 MB.
BROADCAST_NAMES = 300_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, parent_name binary, name binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
FOREST = "place long, lengths binary, turns binary, at binary, members binary, least binary, leaves binary, saved binary, children binary, ends binary"


def packed_turns(table: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, packed.

    Turns are sorted by (conversation, turn) over all tasks and packed to runs there, so
    a long conversation is dealt over several tasks and comes together as a few rows of 24 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = table.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), words.alias("words"))
    order = ("conv_id", F.asc_nulls_first("turn"), "role", "digest")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            ids = batch.column("conv_id").to_numpy()
            made = np.zeros(len(ids), np.dtype([("digest", f"S{DIGEST}"), ("words", "<i8")]))
            turns = made.view(np.uint8).reshape(len(ids), TURN)
            turns[:, :DIGEST] = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint8).reshape(-1, DIGEST)
            made["words"] = batch.column("words").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.empty(0, int)
            ends = np.append(first[1:], len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(np.full(len(first), part << 32 | number)), pa.array([turns[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())], ["conv_id", "run", "turns"])

    runs = rows.mapInArrow(run, "conv_id long, run long, turns binary")
    return runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "turns")))["turns"].alias("r")).select("conv_id", F.expr("aggregate(r, CAST('' AS BINARY), (s, x) -> s || x)").alias("turns"))


def rebuilt(table: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of the conversation whose number is the multiple of 20 below, then the own turns after the first h.

    h is the crc32 of the id in decimal, modulo 4. Below 0, the multiple of 20 is the next one towards 0.
    """
    own = checkpointed(packed_turns(table))
    heads = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.substring("turns", 1, 3 * TURN).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    based = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).withColumn("cut", (h * TURN).cast("int")).join(heads, "base", "left")
    return based.select("conv_id", F.expr("substring(coalesce(head, CAST('' AS BINARY)), 1, cut) || substring(turns, cut + 1, greatest(length(turns) - cut, 0))").alias("turns"))


def sequences(rows: DataFrame) -> DataFrame:
    """(turns, members, least, ends): distinct sequences, how many conversations are equal to each, the least of these, and the hash of all their ids in order.

    Ids are sorted over all tasks and joined to pieces there, so a large group of copies
    reaches the task that hashes it as a few long strings.
    """
    named = checkpointed(rows.withColumn("name", F.sha2("turns", 256)))
    once = named.groupBy("name").agg(F.count("*").alias("members"), F.min("conv_id").alias("least"))
    texts = named.join(once.select(F.col("least").alias("conv_id"), "members"), "conv_id").select("name", "turns", "members", F.col("conv_id").alias("least"))
    ids = named.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, own = batch.column("name").to_pylist(), batch.column("conv_id").to_pylist()
            cuts = [0, *(i for i in range(1, len(own)) if names[i] != names[i - 1]), len(own)] if own else []
            cuts = sorted({*cuts, *range(0, len(own), PIECE)})
            pairs = list(zip(cuts, cuts[1:], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array([names[a] for a, _ in pairs], pa.string()), pa.array([own[a] for a, _ in pairs], pa.int64()), pa.array([",".join(map(str, own[a:b])) for a, b in pairs], pa.string())], ["name", "first", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            names, done = [], []
            for name, piece in zip(batch.column("name").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if name == now:
                    state.update(b",")
                else:
                    if now is not None:
                        names.append(now)
                        done.append(state.hexdigest())
                    now, state = name, hashlib.sha256()
                state.update(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(done, pa.string())], ["name", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["name", "ends"])

    pieces = ids.mapInArrow(joined, "name string, first long, piece string")
    ends = pieces.repartition("name").sortWithinPartitions("name", "first").mapInArrow(hashed, "name string, ends string")
    return texts.join(ends, "name").select("turns", "members", "least", "ends")


@dataclass
class Forest:
    """Sorted sequences and, for nodes on them, what is known so far.

    turns holds all sequences, one after the other. at, members, least, leaves, saved, children, ends: one entry for each node
    of which something is known: (sequence << 32 | depth), conversations that end in it or in closed nodes
    below, the least of them, leaves and saved tokens of closed nodes below, closed children, and
    the hash of those that end in it (or empty).
    """

    lengths: np.ndarray
    turns: np.ndarray
    at: np.ndarray
    members: np.ndarray
    least: np.ndarray
    leaves: np.ndarray
    saved: np.ndarray
    children: np.ndarray
    ends: np.ndarray


_NONE = np.iinfo(np.int64).max


def _turns(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, TURN)


def common_prefixes(lengths: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each sequence with the one before; -1 for the first. digests: (turns, 2) of all sequences."""
    start = np.concatenate([[0], np.cumsum(lengths)])
    out = np.full(len(lengths), -1, np.int64)
    if len(lengths) < 2:
        return out
    both = np.minimum(lengths[:-1], lengths[1:])
    some = np.flatnonzero(both)
    out[1:] = 0
    if len(some):
        size = both[some]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        a, b = np.repeat(start[:-2][some], size) + inside, np.repeat(start[1:-1][some], size) + inside
        differ = np.where((digests[a] != digests[b]).any(1), inside, np.repeat(size, size))
        out[1 + some] = np.minimum.reduceat(differ, np.cumsum(size) - size)
    return out


def branching(lcp: np.ndarray) -> np.ndarray:
    """For each sequence but the first, the sequence on which the node lies where it leaves the ones before.

    Union-find over the edges (i - 1, i) in descending depth; a component is named by its
    first sequence, and of edges of one depth the left comes first.
    """
    root = list(range(len(lcp)))
    owner = np.zeros(len(lcp), np.int64)
    for i in (np.lexsort((np.arange(1, len(lcp)), -lcp[1:])) + 1).tolist():
        a = i - 1
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        owner[i] = a
        root[i] = a
    return owner


def _names(digests: np.ndarray, start: np.ndarray):
    """A function that names the node of a sequence at a depth, by a digest chained along the sequence."""
    chains: dict[int, list[bytes]] = {}

    def name(sequence: int, depth: int) -> bytes:
        if sequence not in chains:
            chain = [bytes(DIGEST)]
            for turn in digests[start[sequence] : start[sequence + 1]]:
                chain.append(hashlib.sha256(chain[-1] + turn.tobytes()).digest()[:DIGEST])
            chains[sequence] = chain
        return chains[sequence][depth]

    return name


def grow(forest: Forest, last_round: bool, named: bool = False) -> tuple[dict[str, object], Forest | None]:
    """(columns of the nodes that are closed, the contraction to the first and the last sequence); with last_round all nodes are closed.

    named: closed nodes get their names, by which others may have called them.
    """
    lengths, m = forest.lengths, len(forest.lengths)
    start = np.concatenate([[0], np.cumsum(lengths)])
    digests = np.ascontiguousarray(forest.turns[:, :DIGEST]).view("<u8").reshape(-1, 2)
    words = np.ascontiguousarray(forest.turns[:, DIGEST:]).view("<i8").reshape(-1)
    lcp = common_prefixes(lengths, digests)
    owner = branching(lcp)
    # Nodes of sequence i: depths lcp[i] + 1 to its length, the root with the first; all of them in preorder.
    count = lengths - lcp
    first = np.cumsum(count) - count
    n = int(count.sum())
    of = np.repeat(np.arange(m), count)
    depth = np.arange(n) - first[of] + lcp[of] + 1
    node = lambda seq, d: first[seq] + d - lcp[seq] - 1
    parent = np.arange(n) - 1
    parent[first[1:]] = node(owner[1:], lcp[1:])
    word = np.where(depth > 0, words[np.minimum(start[of] + np.maximum(depth, 1) - 1, max(len(words) - 1, 0))] if len(words) else 0, 0)
    own = {"members": np.zeros(n, np.int64), "least": np.full(n, _NONE), "leaves": np.zeros(n, np.int64), "saved": np.zeros(n, np.int64), "children": np.zeros(n, np.int64)}
    ends = np.full(n, "", object)
    # What is known of a node is told with any sequence through it; it lies on the first of these.
    seq, d = forest.at >> 32, forest.at & 0xFFFFFFFF
    while (far := d <= lcp[seq]).any():
        seq = np.where(far, owner[seq], seq)
    spot = node(seq, d)
    for k in ("members", "leaves", "saved", "children"):
        np.add.at(own[k], spot, getattr(forest, k))
    np.minimum.at(own["least"], spot, forest.least)
    said = forest.ends != ""
    ends[spot[said]] = forest.ends[said]

    level = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[level], np.arange(int(depth.max()) + 2))
    levels = [level[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    total, least = own["members"].copy(), own["least"].copy()
    children = own["children"] + np.bincount(parent[1:], minlength=n)
    for nodes in levels[:0:-1]:
        np.add.at(total, parent[nodes], total[nodes])
        np.minimum.at(least, parent[nodes], least[nodes])
    leaves, saved = own["leaves"].copy(), own["saved"] + (total - 1) * word
    leaves[children == 0] = 1
    for nodes in levels[:0:-1]:
        np.add.at(leaves, parent[nodes], leaves[nodes])
        np.add.at(saved, parent[nodes], saved[nodes])

    open_ = np.zeros(n, bool)
    if not last_round:
        open_[: first[0] + count[0]] = True
        at = first[m - 1] + count[m - 1] - 1
        while not open_[at]:
            open_[at] = True
            at = parent[at]
    out = np.flatnonzero(~open_)
    up = parent[out]
    known = ~open_[up] | (out == 0)
    name = _names(digests, start)
    columns = {
        "conv_id": least[out], "depth": depth[out],
        "parent_conv_id": pa.array(least[up], mask=~known | (out == 0)),
        "parent_name": pa.array([None if k else name(s, d) for k, s, d in zip(known.tolist(), of[up].tolist(), depth[up].tolist(), strict=True)], pa.binary()),
        "name": pa.array([name(s, d) for s, d in zip(of[out].tolist(), depth[out].tolist(), strict=True)], pa.binary()) if named else pa.nulls(len(out), pa.binary()),
        "n_convs": total[out], "n_children": children[out], "n_leaves": leaves[out], "saved_tokens": saved[out],
        "ends_sha256": pa.array([e or EMPTY_SHA for e in ends[out].tolist()], pa.string()),
    }
    if last_round:
        return columns, None
    # What closed children of open nodes hold is kept by these.
    shut = np.flatnonzero(~open_ & open_[parent])
    for k, v in (("members", total), ("leaves", leaves), ("saved", saved), ("children", np.ones(n, np.int64))):
        np.add.at(own[k], parent[shut], v[shut])
    np.minimum.at(own["least"], parent[shut], least[shut])
    keep = np.flatnonzero(open_)
    both = [0, m - 1] if m > 1 else [0]
    # A node on the first sequence is told with it, any other with the last.
    at = np.where(of[keep] == 0, 0, len(both) - 1) << 32 | depth[keep]
    turns = np.concatenate([forest.turns[start[i] : start[i + 1]] for i in both])
    return columns, Forest(lengths[both], turns, at, *(own[k][keep] for k in ("members", "least", "leaves", "saved", "children")), ends[keep])


def _node_batches(columns: dict[str, object]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in NODE.split(", ")]
    whole = pa.RecordBatch.from_arrays([columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c]) for c in names], names)
    for at in range(0, whole.num_rows, 1 << 15):
        yield whole.slice(at, 1 << 15)


def _forest_row(place: int, f: Forest) -> dict[str, object]:
    out = {k: np.ascontiguousarray(getattr(f, k)).tobytes() for k in ("lengths", "turns", "at", "members", "least", "leaves", "saved", "children")}
    return {"place": place, **out, "ends": "\n".join(f.ends.tolist()).encode()}


def _read_forest(row: dict[str, object]) -> Forest:
    numbers = [np.frombuffer(row[k], np.int64) for k in ("at", "members", "least", "leaves", "saved", "children")]
    return Forest(np.frombuffer(row["lengths"], np.int64), _turns(row["turns"]), *numbers, np.array(row["ends"].decode().split("\n"), object))


def _joined(parts: list[Forest]) -> Forest:
    """Neighbouring forests as one, their sequences in order."""
    shift = np.cumsum([0, *(len(p.lengths) for p in parts)])
    at = np.concatenate([p.at + (int(s) << 32) for p, s in zip(parts, shift, strict=False)])
    rest = [np.concatenate([getattr(p, k) for p in parts]) for k in ("members", "least", "leaves", "saved", "children", "ends")]
    return Forest(np.concatenate([p.lengths for p in parts]), np.concatenate([p.turns for p in parts]), at, *rest)


_BOTH = ", ".join(("kind int", NODE, FOREST))


def _both(nodes: pa.RecordBatch | None, forest: dict[str, object] | None, schema: pa.Schema) -> pa.RecordBatch:
    """Nodes (kind 0) or a contracted forest (kind 1) as rows of one table."""
    n = nodes.num_rows if nodes is not None else 1
    columns = [pa.array(np.full(n, 0 if nodes is not None else 1, np.int32))]
    for field in list(schema)[1:]:
        if nodes is not None and field.name in nodes.schema.names:
            columns.append(nodes.column(field.name).cast(field.type))
        elif forest is not None and field.name in forest:
            columns.append(pa.array([forest[field.name]], field.type))
        else:
            columns.append(pa.nulls(n, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
_SCHEMA = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in _BOTH.split(", ")])


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the sorted sequences of one partition."""
    place, rows, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("turns", "members", "least", "ends")), strict=True):
            rows.append(row)
            size += len(row[0]) // TURN + 1
            if size >= BLOCK:
                yield from _block(rows, place)
                place, rows, size = place + 1, [], 0
    if rows:
        yield from _block(rows, place)


def _block(rows: list[tuple], place: int) -> Iterator[pa.RecordBatch]:
    lengths = np.array([len(r[0]) // TURN for r in rows], np.int64)
    zero = np.zeros(len(rows), np.int64)
    at = np.arange(len(rows), dtype=np.int64) << 32 | lengths
    forest = Forest(lengths, _turns(b"".join(r[0] for r in rows)), at, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), zero, zero, zero, np.array([r[3] for r in rows], object))
    columns, left = grow(forest, False)
    for nodes in _node_batches(columns):
        yield _both(nodes, None, _SCHEMA)
    yield _both(None, _forest_row(place, left), _SCHEMA)


def _merged(last_round: bool):
    """Contracted forests of one group, in order, to one."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        columns, left = grow(_joined([_read_forest(r) for r in rows]), last_round, named=True)
        out = [_both(nodes, None, _SCHEMA) for nodes in _node_batches(columns)]
        if left is not None:
            out.append(_both(None, _forest_row(key[0].as_py() << 32, left), _SCHEMA))
        return pa.Table.from_batches(out, _SCHEMA)

    return run


def build(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the trie of rows (conv_id, turns).

    A node is told by its least conversation and its depth.
    """
    ordered = sequences(rows).repartitionByRange("turns").sortWithinPartitions("turns")
    now = checkpointed(ordered.mapInArrow(_first_round, _BOTH))
    nodes, forest = ([f.split()[0] for f in x.split(", ")] for x in (NODE, FOREST))
    done = now.where("kind = 0").select(*nodes)
    # A place is (partition << 32) + block; the number of rounds is that of the partitions' digits to the base FAN_IN.
    top = now.where("kind = 1").agg(F.max("place")).first()[0]
    top = None if top is None else top >> 32
    while top is not None:
        top, last = top // FAN_IN, top < FAN_IN
        groups = now.where("kind = 1").select(*forest).withColumn("group", F.expr(f"shiftright(place, 32) div {FAN_IN}"))
        now = checkpointed(groups.groupBy("group").applyInArrow(_merged(last), _BOTH))
        done = done.unionByName(now.where("kind = 0").select(*nodes))
        if last:
            break
    names = checkpointed(done.where("name IS NOT NULL").select(F.col("name").alias("parent_name"), F.col("conv_id").alias("told")))
    side = F.broadcast(names) if names.count() <= BROADCAST_NAMES else names
    told = done.join(side, "parent_name", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "told"))
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(table: DataFrame) -> DataFrame:
    """Every node of the trie of the rebuilt conversations of (conv_id, turn, role, text)."""
    return build(rebuilt(table))
