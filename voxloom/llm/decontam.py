"""Benchmark items inside documents, by size-partitioned MinHash containment search.

All in DataFrame expressions. Items are partitioned by the size q of their set of
word shingles, each size a partition of its own with the MinHash sketch that its size
asks for: of q shingles of which a share t must lie in a document, the
q - ceil(t*q) + 1 of least hash (the bottom of the set's MinHash order) cannot
all be absent. So, other than with signatures of one length for all sizes, no document
is missed. Document shingles, made in one scan, are probed against the sketches
by an equi-join on the hash; a hit gives a candidate pair, and a partition whose
items ask for more shingles than the document has is passed over. For the
candidates alone the shingles are made again as text, and the containment is
counted exactly.

Words are maximal runs of letters and digits in lower case. Defined results: an
item with fewer words than a shingle is one shingle of all its words, looked
for among runs of that many words; an item without words is in no document.
Null and empty texts hold nothing. Rows with a null id give no pair. Repeated
ids are taken together: a document holds an item if one of its rows does, with
the largest count; repeated items likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import checkpointed, with_ids, without_ids

#: Up to so many sketch rows (16 bytes each) are sent to all executors: 8 MB.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _sql_hashes(words: str, n: int) -> str:
    """64-bit hashes of the runs of n words of an array that has n or more."""
    parts = ", ".join(f"{words}[i + {j}]" if j else f"{words}[i]" for j in range(n))
    return f"transform(sequence(0, size({words}) - {n}), i -> xxhash64({parts}))"


def _sql_texts(words: str, n: int) -> str:
    """The runs of n words as text; none if there are fewer words."""
    return f"IF(size({words}) < {n}, CAST(array() AS array<string>), transform(sequence(1, size({words}) - {n - 1}), i -> array_join(slice({words}, i, {n}), ' ')))"


def _by_width(size: int, make) -> Column:
    return F.expr(f"CASE width {' '.join(f'WHEN {n} THEN {make(n)}' for n in range(1, size + 1))} END")


def item_sketches(benchmark: DataFrame, *, size: int = 5, percent: int = 80, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, width, q, need, sketch): width words a shingle, q distinct shingles, need of them asked for."""
    words = benchmark.where(F.col(key).isNotNull()).select(F.col(key).alias("item"), words_of(F.col(text)).alias("w")).where("size(w) > 0")
    widths = words.withColumn("width", F.least(F.lit(size), F.size("w")))
    each = _by_width(size, lambda n: f"array_distinct({_sql_hashes('w', n)})")
    sized = widths.select("item", "width", each.alias("hashes")).withColumn("q", F.size("hashes"))
    need = sized.withColumn("need", F.ceil(F.col("q") * percent / F.lit(100.0)).cast("int"))
    # The order of the sketch is that of a second hash, so that it is unrelated to the probes' partitioning.
    return need.withColumn("sketch", F.expr("slice(array_sort(transform(hashes, h -> struct(xxhash64(h, 7) AS o, h AS h))).h, 1, q - need + 1)")).drop("hashes")


def find_items(docs: DataFrame, benchmark: DataFrame, *, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key, n_shingles, n_shared): documents that hold percent of an item's distinct shingles, or more."""
    items = item_sketches(benchmark, size=size, percent=percent, key=item_key, text=item_text)
    sketches = checkpointed(items.select(F.explode("sketch").alias("h"), "item", "width", "need"))
    counted = {r[0]: r[1] for r in sketches.groupBy("width").count().collect()}  # at most ``size`` rows
    # One scan makes the shingles of all widths that items have.
    each = [f"IF(size(w) < {n}, CAST(array() AS array<bigint>), {_sql_hashes('w', n)})" for n in sorted(counted)]
    words = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), words_of(F.col(text)).alias("w"))
    probes = words.select("doc", F.size("w").alias("n"), F.explode(F.expr(f"concat({', '.join(each or ['CAST(array() AS array<bigint>)'])})")).alias("h"))
    side = F.broadcast(sketches) if sum(counted.values()) <= BROADCAST_ROWS else sketches
    hits = probes.join(side, "h").where(F.col("n") - (F.col("width") - 1) >= F.col("need")).select("doc", "item")
    return _verified(checkpointed(hits.distinct()), docs, benchmark, size, percent, key, text, item_key, item_text)


def _verified(candidates: DataFrame, docs: DataFrame, benchmark: DataFrame, size: int, percent: int, key: str, text: str, item_key: str, item_text: str) -> DataFrame:
    item_words = benchmark.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item"), words_of(F.col(item_text)).alias("v")).where("size(v) > 0")
    item_words = item_words.withColumn("width", F.least(F.lit(size), F.size("v")))
    item_sets = item_words.select("item", F.struct("item", "width", F.array_distinct(_by_width(size, lambda n: _sql_texts("v", n))).alias("wanted")).alias("one"))
    # Only the candidates' texts are shuffled and cut into words again; each meets its items in one row.
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("t"), F.xxhash64(key).alias("of"))
    held = with_ids(rows, candidates.select(F.xxhash64("doc").alias("wanted")).distinct(), "wanted", "of").select("doc", words_of(F.col("t")).alias("w"))
    of_doc = candidates.join(item_sets, "item").groupBy("doc").agg(F.collect_list("one").alias("items"))  # as many as the benchmark has
    made = held.join(of_doc.hint("shuffle_hash"), "doc").select("doc", "items", "w", F.expr(_sql_texts("w", size)).alias("full"))
    own = " ".join(f"WHEN {n} THEN {'full' if n == size else _sql_texts('w', n)}" for n in range(1, size + 1))
    counts = F.expr(f"transform(items, x -> struct(x.item AS item, size(x.wanted) AS n_shingles, size(array_intersect(CASE x.width {own} END, x.wanted)) AS n_shared))")
    counted = made.select("doc", F.explode(counts).alias("x")).select("doc", "x.*")
    good = counted.where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent)
    return good.groupBy("doc", "item").agg(F.max(F.struct("n_shared", "n_shingles")).alias("best")).select(F.col("doc").alias(key), F.col("item").alias(item_key), "best.n_shingles", "best.n_shared")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item; rows with a null id stay."""
    gone = find_items(docs, benchmark, size=size, percent=percent, key=key, text=text).select(F.col(key).alias("__leak_doc")).distinct()
    return without_ids(docs, gone, "__leak_doc", key)
