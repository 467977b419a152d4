"""Exact Jaccard self-join of documents on word n-grams, up to connected groups.

The join is the product of the sparse document by n-gram matrix with its
transpose, in blocks, where an entry is the number of n-grams that two
documents share and entries below the bound that the two sizes set are thrown
away. Three steps keep it from touching all pairs:

1. Documents with equal n-gram sets form one class (128-bit digest of the set);
   only the least id of a class goes on, so copies never meet in pairs.
2. Blocks of rows are found by a pigeonhole bound. For two sets of sizes x and y
   to reach the threshold t, at most H = (1 - t)(x + y)/(1 + t) n-grams may lie
   in one of them only. With the hash space cut into more than H ranges, at
   least one range holds the same n-grams in both. Where H is large (sets of about 400 n-grams
   or more), fewer and wider ranges do: so many that the chance that these H n-grams hit every range is
   below 2 ** -64, the chance that two given n-grams have one hash. Long documents that
   share a passage are then not tied, where narrow ranges tie them into groups that
   grow with the table. Each document therefore sends
   one digest per range (for its class of sizes and for the class below, as two
   nodes), and nodes that share a digest are tied by edges to the first node of its
   list, as the sorted digests stream by. Ranges in which a document has nothing
   do not tie; where they are so many that the bound could hold for empty ranges
   alone, the document also sends digests under another hash, and only after
   the last of several hashes are empty ranges tied. No list is capped and
   no link is lost, but with that chance. A passage that many documents share fills a whole range
   only where it makes up most of a document, so common passages tie nothing.
3. The tied groups, each of one class of sizes and the next, are the blocks, but for those
   without a node of a document's own class, whose pairs all meet in another group. A
   group that is larger than a block is first held against a few of its own rows, some
   by hash and then those that overlap most with these (so that a text from which many
   copies differ is found). Rows that these link into the group's largest
   component are settled: no link between two of them can change a result. The open rows
   are cut into blocks, each of which meets each other and each block of settled rows in a
   task of its own, so the work grows with open rows times rows, not with the square of the group. Inside a task, columns
   with many rows are multiplied as dense tiles and the others by their lists;
   overlap counts are compared exactly with 185 * overlap >= 85 * (x + y) (for
   t = 0.85), and only a spanning forest of the links leaves the task.

Defined results: a null text, or one without words, has no n-grams and is
linked with nothing, not even with its like. A text with fewer words than n is
one n-gram. Rows with the same id and text are one document's; rows with the
same id and different texts take part each on its own and share the id. A null
id takes no part and has no component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm import common
from voxloom.llm.common import checkpointed, slices, small_batches, without_ids
from voxloom.llm.components import connected_components

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Hashes tried before empty ranges are tied.
TRIES = 5
#: Log2 of the chance at most that a pair above the threshold shares no digest, where there are fewer ranges than n-grams that may differ: that of two given n-grams with one hash.
MISSED = -64
#: Rows and n-grams of a block at most (a group of one very long document may exceed the latter).
BLOCK_ROWS, BLOCK_GRAMS = 2000, 1_500_000
#: Rows of a large group that all its others are held against first, at most (fewer where they hold more than a quarter of a block's n-grams).
PIVOTS = 16


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) - (1 << 63)
        return value


def gram_sets(texts: list[str | None], n: int, words: _Words) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams."""
    split = [t.encode().lower().split() if t else [] for t in texts]
    counts = [len(w) for w in split]
    flat = np.fromiter((h for w in split for h in map(words.__getitem__, w)), np.int64, sum(counts)).view(np.uint64)
    out, at = [], 0
    grams = np.zeros(max(0, len(flat) - n + 1), np.uint64)
    for j in range(n):
        grams = grams * _M1 + flat[j : j + len(grams)]
    grams = _mix(grams)
    for c in counts:
        if c >= n:
            out.append(np.unique(grams[at : at + c - n + 1]))
        elif c:
            short = np.array([c], np.uint64)
            for h in flat[at : at + c]:
                short = short * _M2 + h
            out.append(_mix(short))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


@lru_cache(maxsize=8)
def _classes(percent: int) -> list[int]:
    """First sizes of the size classes; partners are of the same or the next class."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * 100 // percent + 1)
    return starts


def _missed(k: int, odd: int, shared: int) -> float:
    """Log2 of a bound on the chance that none of k ranges holds some of the shared n-grams and none of the odd ones.

    Whether ranges are hit is negatively associated (balls in bins), so the product over the ranges bounds it.
    """
    if k < 2:
        return 0.0
    clear, bare = (math.exp(balls * math.log1p(-1 / k)) for balls in (odd, shared))
    return k * math.log1p(-clear * (1 - bare)) / math.log(2)


@lru_cache(maxsize=4096)
def _ranges(lower_class: int, percent: int) -> tuple[int, int]:
    """(ranges, spare) for pairs whose smaller set is of that class; 0 ranges if only equal sets can link.

    As many as the pigeonhole asks for, or the least number that misses a pair with a chance of 2 ** MISSED, where that is less.
    A set with more empty ranges than are spared (its hashes are not spread evenly) sends digests under other hashes too.
    """
    least, top = _classes(percent)[lower_class], _classes(percent)[lower_class + 1] - 1
    odd = (100 - percent) * (top + top * 100 // percent) // (100 + percent)
    spare = 1 + odd // 12
    if not odd:
        return 0, 0
    shared = -(-2 * percent * least // (100 + percent))
    if _missed(odd, odd, shared) > MISSED:
        return odd + 1 + spare, spare
    low, high = 1, odd
    while high - low > 1:
        k = (low + high) // 2
        low, high = (low, k) if _missed(k, odd, shared) <= MISSED else (k, high)
    return high, 1 + high // 12


def range_digests(grams: np.ndarray, percent: int) -> list[np.ndarray]:
    """The digests by which a set is tied to any other with which it may link: of its class of sizes, and of the class below."""
    none = np.empty(0, np.uint64)
    if not len(grams):
        return [none, none]
    starts = _classes(percent)
    own = int(np.searchsorted(starts, len(grams), side="right")) - 1
    out = []
    for lower in (own, own - 1):
        k, spare = _ranges(lower, percent) if lower >= 0 else (0, 0)
        found = [none]
        for attempt in range(TRIES if k else 0):
            g = grams if not attempt else np.sort(_mix(grams + np.array([attempt], np.uint64) * _M1))
            part = ((g >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            salt = _mix(np.array([lower * 8 + attempt], np.uint64))
            found.append(_mix(np.add.reduceat(_mix(g ^ _M1), first) + _mix((part[first] + np.uint64(1)) * _M1 ^ salt)))
            if k - len(first) <= spare:
                break
            if attempt == TRIES - 1:
                empty = np.setdiff1d(np.arange(k, dtype=np.uint64), part[first])
                found.append(_mix(_mix((empty + np.uint64(1)) * _M1 ^ salt) + _M2))
        out.append(np.concatenate(found))
    return out


def set_digests(docs: DataFrame, n: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_shingles, s1, s2): size and digest of each row's n-gram set; no digest for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for part in slices(batch, text):
                sets = gram_sets(part.column(text).to_pylist(), n, words)
                digests = [np.frombuffer(hashlib.blake2b(g.tobytes(), digest_size=16).digest(), np.int64) if len(g) else (None, None) for g in sets]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([len(g) for g in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64())], ["doc", "n_shingles", "s1", "s2"])

    return small_batches(docs.select(F.col(key).cast("long").alias(key), text)).mapInArrow(run, "doc long, n_shingles long, s1 long, s2 long")


def _ties(docs: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    """(a, b): nodes whose documents share a range digest, each with the first of the digest's list.

    A document has two nodes, 2 * id for its class of sizes and 2 * id + 1 for the class below
    (wrapped beyond 64 bits, where two ids may come to share a node), so that ties of one class of sizes
    do not go on in the next.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for part in slices(batch, text):
                digests = [d for g in gram_sets(part.column(text).to_pylist(), n, words) for d in range_digests(g, percent)]
                flat = np.concatenate(digests) if digests else np.empty(0, np.uint64)
                nodes = np.repeat(part.column(key).to_numpy(zero_copy_only=False).astype(np.int64) * 2, 2)
                nodes[1::2] += 1
                owner = np.repeat(nodes, [len(d) for d in digests])
                for at in range(0, len(flat), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(flat[at : at + (1 << 17)].view(np.int64)), pa.array(owner[at : at + (1 << 17)].astype(np.int64))], ["digest", "doc"])

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, head = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            d, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.concatenate([[d[0] != digest], d[1:] != d[:-1]])
            heads = np.where(new, doc, 0)
            at = np.maximum.accumulate(np.where(new, np.arange(len(d)), -1))
            heads = np.where(at >= 0, doc[np.maximum(at, 0)], head if head is not None else 0)
            digest, head = d[-1], heads[-1]
            tied = (~new) & (heads != doc)
            yield pa.RecordBatch.from_arrays([pa.array(heads[tied].astype(np.int64)), pa.array(doc[tied])], ["a", "b"])

    sent = docs.select(F.col(key).cast("long").alias(key), text).where(F.col(key).isNotNull()).mapInArrow(send, "digest long, doc long")
    ties = sent.repartition("digest").sortWithinPartitions("digest", "doc").mapInArrow(tie, "a long, b long")
    # All ties of a node come together, so that contraction leaves about one row a node however many partitions there are.
    return ties.repartition("b")


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Numbers of shared n-grams: the block of the product with rows left and columns right (left again if None)."""
    rows = left if right is None else [*left, *right]
    a, b = len(left), len(left) if right is None else len(right)
    grams = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    order = np.argsort(grams, kind="stable")
    g, of = grams[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(g)))
    out = np.zeros((a, b), np.float32)
    # Columns with few rows: the pairs of their lists, all columns of one length at a time.
    for c in range(2, min(int(count.max(initial=0)), 24) + 1):
        own = first[count == c]
        for at in range(0, len(own), max(1, 1_000_000 // (c * c))):
            lists = of[own[at : at + max(1, 1_000_000 // (c * c)), None] + np.arange(c)]
            i, j = np.repeat(lists, c, axis=1).ravel(), np.tile(lists, (1, c)).ravel()
            if right is not None:
                use = (i < a) & (j >= a)
                i, j = i[use], j[use] - a
            out += np.bincount(i * b + j, minlength=a * b).reshape(a, b).astype(np.float32) if a * b <= 4 * len(i) else 0
            if a * b > 4 * len(i):
                np.add.at(out, (i, j), 1)
    # Columns with many rows: dense tiles.
    wide = np.flatnonzero(count > 24)
    tile = max(256, 8_000_000 // max(1, len(rows)))
    for at in range(0, len(wide), tile):
        own = wide[at : at + tile]
        places = np.concatenate([np.arange(first[w], first[w] + count[w]) for w in own])
        dense = np.zeros((len(rows), len(own)), np.float32)
        dense[of[places], np.repeat(np.arange(len(own)), count[own])] = 1
        out += dense[:a] @ (dense[:a] if right is None else dense[a:]).T
    return out


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix, as (root, member)."""
    todo, out = np.ones(len(links), bool), []
    for root in range(len(links)):
        if not todo[root]:
            continue
        todo[root] = False
        front = np.array([root])
        while len(front):
            found = np.flatnonzero(links[front].any(0) & todo)
            todo[found] = False
            out += [(root, int(f)) for f in found]
            front = found
    return out


def block_links(docs: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning links of one block (all of side 0) or between two (sides 0 and 1)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    i, j = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    two = len(j) > 0
    shared = overlaps([sets[x] for x in i], [sets[x] for x in j] if two else None)
    good = np.empty(shared.shape, bool)
    for at in range(0, len(i), 256):
        strip, total = shared[at : at + 256].astype(np.int64), sizes[i][at : at + 256, None] + sizes[j if two else i][None, :]
        good[at : at + 256] = ((100 + percent) * strip >= percent * total) & (strip > 0)
    del shared
    if two:
        full = np.zeros((len(docs), len(docs)), bool)
        full[np.ix_(i, j)] = good
        full[np.ix_(j, i)] = good.T
    else:
        np.fill_diagonal(good, False)
        full, docs = good, docs[i]
    return [(int(docs[a]), int(docs[b])) for a, b in _forest(full)]


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int, key: str, text: str, tasks: Column) -> DataFrame:
    """(task, group, side, doc, s1, s2, grams) for each task of the wanted (doc, s1, s2): the n-grams of the rows of that id and set."""
    # A document has a few tasks: two classes of sizes.
    of_doc = wanted.groupBy("doc", "s1", "s2").agg(F.collect_list(tasks).alias("tasks"))
    # Only the wanted documents' texts are shuffled, and those once: more ids than are broadcast are left to the join with the tasks.
    tied = checkpointed(wanted.select("doc").distinct())
    whole = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("words"))
    if tied.count() <= common.BROADCAST_IDS:
        whole = whole.join(F.broadcast(tied), "doc", "left_semi")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for part in slices(batch, "words"):
                sets = gram_sets(part.column("words").to_pylist(), n, words)
                digests = [np.frombuffer(hashlib.blake2b(g.tobytes(), digest_size=16).digest(), np.int64) if len(g) else (None, None) for g in sets]
                same = [i for i, (d, a, b) in enumerate(zip(digests, part.column("s1").to_pylist(), part.column("s2").to_pylist(), strict=True)) if len(sets[i]) and d[0] == a and d[1] == b]
                docs_of, tasks = part.column("doc").to_pylist(), part.column("tasks").to_pylist()
                sent = [(t["task"], t["group"], t["side"], docs_of[i], int(digests[i][0]), int(digests[i][1]), i) for i in same for t in tasks[i]]
                for at in range(0, len(sent), 64):
                    rows = sent[at : at + 64]
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)), pa.array([sets[r[6]].tobytes() for r in rows], pa.binary())], ["task", "group", "side", "doc", "s1", "s2", "grams"])

    return whole.join(of_doc.hint("shuffle_hash"), "doc").mapInArrow(to_sets, "task long, group long, side int, doc long, s1 long, s2 long, grams binary")


def _multiplied(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): spanning links of each task and group in it. Sides 0 and 1 are rows and columns (0 alone: of a block with itself); 2 and 3 likewise, and nothing where one of them is missing."""

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        group, doc, side, grams = (pdf[c].to_numpy() for c in ("group", "doc", "side", "grams"))
        order = np.argsort(group, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if side[own[0]] < 2 or side[own].min() < side[own].max():
                out += block_links(doc[own], [np.frombuffer(grams[i], np.uint64) for i in own], side[own] & 1, percent)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.select("task", "group", "side", "doc", "grams").groupBy("task").applyInPandas(multiply, "a long, b long")


_SET = ("group", "doc", "s1", "s2")


def _against(large: DataFrame, pivots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(group, doc, s1, s2, few, linked, score): of each row of the large groups the pivots it links with, and its mean overlap with them for their sizes."""
    parts = large.select("group", "parts", "few").distinct()
    task = F.xxhash64("group", "part").alias("task")
    heads = pivots.join(parts, "group").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(*_SET, "few", task, F.lit(0).alias("side"))
    each = large.withColumn("part", F.pmod(F.xxhash64("doc"), "parts")).select(*_SET, "few", task, F.lit(1).alias("side"))
    rows = heads.union(each).join(sets, ["doc", "s1", "s2"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        group, side = pdf["group"].to_numpy(), pdf["side"].to_numpy()
        grams = [np.frombuffer(g, np.uint64) for g in pdf["grams"]]
        docs = pdf["doc"].to_numpy()
        order = np.argsort(group, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            few, all_ = own[side[own] == 0], own[side[own] == 1]
            if not len(few) or not len(all_):
                continue
            shared = overlaps([grams[i] for i in few], [grams[i] for i in all_]).astype(np.int64)
            total = np.array([len(grams[i]) for i in few])[:, None] + np.array([len(grams[i]) for i in all_])[None, :]
            good, score = ((100 + percent) * shared >= percent * total) & (shared > 0), (shared / total).mean(0)
            found = pdf.iloc[all_][[*_SET, "few"]].copy()
            found["linked"] = [docs[few[good[:, j]]].tolist() for j in range(len(all_))]
            found["score"] = score
            out.append(found)
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in (*_SET, "few", "linked", "score")})

    return rows.groupBy("task").applyInPandas(compare, "group long, doc long, s1 long, s2 long, few long, linked array<long>, score double")


def settled(large: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """((a, b) links found, large with a column open): rows are held against a few of their group, and are open unless in its largest component so far."""
    slot = F.pmod(F.xxhash64("s1", "s2", "doc"), "few").alias("slot")
    row = F.struct("doc", "s1", "s2")
    pick = lambda rows, best: rows.groupBy("group", slot).agg(best.alias("row")).select("group", "row.*")
    first = checkpointed(_against(large, checkpointed(pick(large, F.min_by(row, F.xxhash64("doc", "s1")))), sets, percent))
    second = checkpointed(_against(large, checkpointed(pick(first, F.max_by(row, F.struct("score", "doc")))), sets, percent))
    links = checkpointed(first.union(second).select(F.col("doc").alias("a"), F.explode("linked").alias("b")).where("a <> b"))
    of = connected_components(links).withColumnsRenamed({"node": "doc"})
    known = checkpointed(large.join(of, "doc", "left"))
    sizes = known.where("component IS NOT NULL").groupBy("group", "component").agg(F.count("*").alias("rows"))
    # One row a group, put down first, so that the join with a hot group's rows is one that AQE can split.
    main = checkpointed(sizes.groupBy("group").agg(F.max_by("component", F.struct("rows", "component")).alias("main")))
    rest = known.join(main, "group", "left").withColumn("open", ~F.coalesce(F.col("component") == F.col("main"), F.lit(False)))
    return links, checkpointed(rest.drop("component", "main"))


def _large_links(large: DataFrame, docs: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    """(a, b): links that join what links inside groups larger than a block. large: (doc, group, n_shingles, s1, s2, parts, few)."""
    no_task = F.struct(F.lit(0).cast("long").alias("task"), F.lit(0).cast("long").alias("group"), F.lit(0).alias("side"))
    sets = checkpointed(_sets_of(docs, large.select("doc", "s1", "s2").distinct(), n, key, text, no_task).select("doc", "s1", "s2", "grams"))
    links, known = settled(large, sets, percent)
    opened = known.where("open").groupBy("group").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("grams"))
    cut = checkpointed(opened.select("group", F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("long").alias("cuts")))
    placed = known.join(cut, "group").withColumn("part", F.pmod(F.xxhash64("doc"), F.when(F.col("open"), F.col("cuts")).otherwise(F.col("parts"))))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).alias("other")
    task = lambda kind, a, b: F.xxhash64("group", F.lit(kind), a, b).alias("task")
    among = placed.where("open").select(*_SET, "part", upto("cuts")).select(*_SET, task("open", F.least("part", "other"), F.greatest("part", "other")), F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"))
    across = placed.where("open").select(*_SET, "part", upto("parts")).select(*_SET, task("settled", F.col("part"), F.col("other")), F.lit(2).alias("side"))
    other = placed.where("NOT open").select(*_SET, "part", upto("cuts")).select(*_SET, task("settled", F.col("other"), F.col("part")), F.lit(3).alias("side"))
    return links.union(_multiplied(among.union(across).union(other).join(sets, ["doc", "s1", "s2"]), percent))


def _group_links(groups: DataFrame, docs: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    """(a, b): spanning links inside the tied groups. groups: (doc, group, n_shingles, s1, s2) of each class that is tied."""
    sized = groups.groupBy("group").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("grams"), F.max("n_shingles").alias("most")).where("rows > 1")
    parts = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("long").alias("parts")
    # The more n-grams a group's rows have, the fewer of them go to all its tasks.
    few = F.greatest(F.lit(1), F.least(F.lit(PIVOTS), F.floor(F.lit(BLOCK_GRAMS // 4) / F.col("most")))).cast("long").alias("few")
    # Put down before the join, which AQE can then split where one group is hot.
    placed = checkpointed(groups.join(checkpointed(sized.select("group", parts, few)), "group"))
    small = F.col("parts") == 1
    total, large = placed.agg(F.coalesce(F.sum(F.when(small, F.col("n_shingles"))), F.lit(0)), F.count_if(~small)).first()
    # Small groups go to bins with others.
    bins = max(1, math.ceil(total / (BLOCK_GRAMS // 4)))
    task = F.struct(F.pmod(F.xxhash64("group"), F.lit(bins)).alias("task"), F.col("group"), F.lit(0).alias("side"))
    links = _multiplied(_sets_of(docs, placed.where(small), n, key, text, task), percent)
    return links.union(_large_links(placed.where(~small), docs, n, percent, key, text)) if large else links


def _node(column: str) -> Column:
    """The node of an id and a bit; the shift wraps as doubling does in the tasks, whatever the session's ANSI mode."""
    return F.call_function("shiftleft", F.col(column), F.lit(1)).bitwiseOR(F.col("bit"))


def jaccard_components(docs: DataFrame, *, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row; documents link when 100 * overlap >= percent * union."""
    own = checkpointed(set_digests(docs, n, key=key, text=text))
    classes = own.where("n_shingles > 0 and doc is not null").groupBy("s1", "s2").agg(F.min("doc").alias("head"), F.max("n_shingles").alias("n_shingles"))
    heads = own.where("doc is not null and n_shingles > 0").select("doc", "s1", "s2").distinct().join(classes, ["s1", "s2"])
    to_head = checkpointed(heads.select("doc", "head"))
    # Rows with equal sets, and rows of one id with several sets, tie each other.
    same = to_head.where("doc <> head").select(F.col("doc").alias("a"), F.col("head").alias("b"))
    both = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("bit")
    nodes = same.select("a", "b", both).select(_node("b").alias("a"), _node("a").alias("b"))
    groups = connected_components(_ties(docs, n, percent, key, text).union(nodes)).withColumnsRenamed({"component": "group"})
    of_class = classes.select("head", "n_shingles", "s1", "s2", both).withColumn("node", _node("head"))
    grouped = checkpointed(of_class.join(groups, "node").select(F.col("head").alias("doc"), "group", "bit", "n_shingles", "s1", "s2"))
    # Of two rows that may link, the one of the lower class of sizes (of one class, both) is in their group by its node of bit 0. A group
    # of nodes of bit 1 alone, as near copies make it beside that of their own class, has no such pair. Put down before the join, for AQE as below.
    paired = checkpointed(grouped.where("bit = 0").select("group").distinct())
    compared = grouped.join(paired, "group", "left_semi").drop("bit")
    # Put down before they are contracted, so that no task holds the Python workers of both.
    links = checkpointed(_group_links(compared, docs, n, percent, key, text))
    found = connected_components(links.union(same)).withColumnsRenamed({"node": "doc", "component": "least"})
    return own.join(found, "doc", "left").select(F.col("doc").alias(key), "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc")).otherwise(F.col("doc")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, *, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose component has a smaller id; rows with a null id stay."""
    found = jaccard_components(docs, n=n, percent=percent, key=key, text=text)
    gone = found.where(F.col("component_id") < F.col(key)).select(F.col(key).alias("__join_doc")).distinct()
    return without_ids(docs, gone, "__join_doc", key)
