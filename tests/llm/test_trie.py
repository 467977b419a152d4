import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, members string"


def conversations(seed=3, n=140):
    r, rows = random.Random(seed), []
    for c in range(n):
        if c % 11 == 4 or c == 60:
            continue
        shared = r.random()
        for t in range(r.choice((1, 2, 3, 4, 6))):
            text = f"hello {t} there" if shared < 0.4 else r.choice(("yes", "no\tit is", None, "", "a b\nc"))
            rows.append((c, t, r.choice(("user", "assistant")) if shared > 0.8 else "user", text, 1, "m"))
    rows += [(c, t, "user", f"copy {t}", 1, "m") for c in range(200, 260) for t in range(5)]
    rows += [(300, None, None, "before all", 1, "m"), (300, 0, "user", None, 1, "m"), (None, 0, "user", "nobody's", 1, "m"), (20, 2, "user", "again", 1, "m"), (-7, 0, "u", "x", 1, "m")]
    rows += [(400, t, "user", f"long {t}", 1, "m") for t in range(700)] + [(401, t, "user", f"long {t}", 1, "m") for t in range(650)]
    rows += [rows[0], rows[0]]
    r.shuffle(rows)
    return rows


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    key = lambda x: (x[0], x[1], hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()[:16])
    own = {c: [(role, text) for _, role, text in sorted(turns, key=key)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        made[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    words = lambda node: len(node[-1][1].split()) if node else 0
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = (len(members[node]) - 1) * words(node) + sum(saved[k] for k in below)
    sha = lambda node: hashlib.sha256(",".join(str(c) for c in sorted(c for c in members[node] if len(made[c]) == len(node))).encode()).hexdigest()
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids.get(node, [])), leaves[node], saved[node], sha(node)) for node, m in members.items())


def collected(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def test_matches_brute_force(spark):
    rows = conversations()
    assert collected(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("block,fan,names", [(1, 2, 0), (7, 3, 0), (40, 64, 10**6)])
def test_blocks_and_rounds_do_not_matter(spark, monkeypatch, block, fan, names):
    rows = conversations(seed=block, n=90)
    monkeypatch.setattr(trie, "FAN_IN", fan)
    monkeypatch.setattr(trie, "BROADCAST_NAMES", names)
    # Workers read the module's own constants, so small blocks are set where blocks are cut.
    own = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        with_block = trie._first_round

        def small(batches):
            trie.BLOCK = block
            return with_block(batches)

        monkeypatch.setattr(trie, "_first_round", small)
        assert collected(trie.prefix_trie(own)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_common_prefixes_and_branching():
    texts = sorted(["", "a", "ab", "abc", "abd", "b", "bca", "bcb", "c"])
    lengths = np.array([len(t) for t in texts])
    digests = np.array([[ord(c), 1] for t in texts for c in t], np.int64)
    lcp = trie.common_prefixes(lengths, digests)
    assert lcp.tolist() == [-1, 0, 1, 2, 2, 0, 1, 2, 0]
    owner = trie.branching(lcp)
    for i in range(1, len(texts)):
        # The first sequence with the prefix of that length.
        assert owner[i] == next(j for j, t in enumerate(texts) if t[: lcp[i]] == texts[i][: lcp[i]] and len(t) >= lcp[i])


def test_large_groups_are_hashed_in_pieces(spark, monkeypatch):
    n = 30_000
    rows = spark.range(n).select((F.col("id") * 7 % n).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("u").alias("role"), F.lit("same").alias("text"))
    got = collected(trie.build(trie.packed_turns(rows)))
    want = hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()
    assert got == [(0, 0, None, n, 1, 1, n - 1, trie.EMPTY_SHA), (0, 1, 0, n, 0, 1, n - 1, want)]


def test_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "x", 1, "m")], SCHEMA)).count() == 0
