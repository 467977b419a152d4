"""Fingerprints of documents by order MinHash, in DataFrame expressions alone.

A text's k-mers are its runs of k words, each numbered by how often it came before
in the text, so that the repeats of a k-mer are different elements. Each signature has
an order of the elements of its own: hashes of 40 bits counted upwards, round the end, from
the signature's constant. It selects the ``length`` least elements, puts them in the
order of their places in the text and hashes that tuple to 32 bits. A fingerprint is
``count`` signatures; the likeness of two texts is the share of equal ones. Since tuples
keep the order of the text, it falls with moved parts as well as with changed words, as
the edit distance does.

All orders are turns of one circle, so a text's elements are sorted once as long
integers (hash, place), and the least of every order are those that follow its
constant. All of it happens in the row of the text: nothing is exploded or shuffled.

Defined results: a null text is empty. A text with fewer words than k has one
k-mer of all of them; the one k-mer of a text without words is the empty word, so such texts are
alike among themselves and unlike all others. Where a text has fewer elements than
``length``, the circle is gone round again. Places of texts of 16 million words or more are
kept in 16 million steps. Rows are independent, so repeated rows have equal
fingerprints. In ``edited_report``, documents follow each other by
falling id; rows of one id share its place, and the one whose text has the least
hash is what the rows of the id before see as the next document. Rows without an
id have no next document: their halves are followed by nothing, and what they are
compared with is the empty text. No documents give no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import checkpointed

#: Words of a k-mer, k-mers of a signature and signatures of a fingerprint.
K, LENGTH, COUNT = 5, 2, 64
#: Steps of the places in a text: the low bits of an element, beside its hash.
_STEPS = 1 << 24


def _constants(n: int) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(str(i).encode(), digest_size=8).digest(), "little", signed=True) for i in range(n)]


def with_fingerprint(rows: DataFrame, text: str, name: str, *, k: int = K, length: int = LENGTH, count: int = COUNT) -> DataFrame:
    """rows with the signatures of a text column as an array of ``count`` ints.

    Columns that a later step reads more than once are steps of their own, so that Spark computes them once.
    """
    constants = ", ".join(f"{c & -_STEPS}L" for c in _constants(count))
    steps = {
        "w": r"split(btrim(coalesce({text}, ''), ' \t\n\u000b\f\r'), '[\\x20\\x09-\\x0D]+')".replace("{text}", f"`{text}`"),
        "h": "transform({w}, x -> xxhash64(x))",
        "k": f"transform(sequence(0, greatest(size({{h}}) - {k}, 0)), i -> xxhash64({', '.join(f'get({{h}}, i + {j})' for j in range(k))}) & -{_STEPS}L)",
        "dup": "size(array_distinct({k})) < size({k})",
        "p": f"sort_array(IF(size({{k}}) < {_STEPS}, transform({{k}}, (x, i) -> x | (i + 1)), transform({{k}}, (x, i) -> x | (i div (size({{k}}) div {_STEPS - 1} + 1) + 1))))",
        # Only texts that repeat a k-mer are numbered; a first occurrence keeps the hash of its k-mer, so both ways agree.
        "b": f"IF({{dup}}, filter(sequence(0, size({{p}}) - 1), i -> i = 0 OR {{p}}[i] & -{_STEPS}L <> {{p}}[greatest(i - 1, 0)] & -{_STEPS}L), NULL)",
        "f": "flatten(transform({b}, (x, r) -> array_repeat(x, coalesce(get({b}, r + 1), size({p})) - x)))",
        "e": f"IF({{dup}}, sort_array(transform({{p}}, (x, i) -> IF(i = {{f}}[i], x, (xxhash64(x & -{_STEPS}L, i - {{f}}[i]) & -{_STEPS}L) | (x & {_STEPS - 1}L)))), {{p}})",
        # Constants have the place 0, which no element has: in the sorted whole they show how many elements lie below them.
        "m": f"sort_array(concat({{e}}, array({constants})))",
        "o": f"filter(sequence(0, size({{m}}) - 1), i -> {{m}}[i] & {_STEPS - 1}L = 0)",
    }
    out, own = rows, {n: f"__omh_{n}" for n in steps}
    for n, sql in steps.items():
        out = out.withColumn(own[n], F.expr(sql.format(**own)))
    # Before the j-th constant in order lie j other constants.
    at = "{e}[({o}[j] - j + i) % size({e})]".format(**own)
    chosen = f"sort_array(transform(sequence(0, {length - 1}), i -> struct({at} & {_STEPS - 1}L AS at, {at} & -{_STEPS}L AS x))).x"
    made = F.expr(f"transform(sequence(0, {count - 1}), j -> CAST(shiftright(xxhash64({chosen}), 32) AS INT))")
    return out.withColumn(name, made).drop(*own.values())


def likeness(a: str, b: str) -> Column:
    """Share of equal signatures of two array columns."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> IF(x = y, 1, 0)), 0, (s, x) -> s + x) / CAST(size({a}) AS DOUBLE)")


def as_text(signatures: str) -> Column:
    """A fingerprint as text: eight hexadecimal digits a signature."""
    return F.expr(f"array_join(transform({signatures}, v -> lpad(lower(hex(v & 4294967295L)), 8, '0')), '')")


def fingerprints(docs: DataFrame, *, text: str = "text", k: int = K, length: int = LENGTH, count: int = COUNT) -> DataFrame:
    """docs in their own columns and ``fingerprint``, in place of a column of that name."""
    made = with_fingerprint(docs, text, "__omh_a", k=k, length=length, count=count)
    return made.withColumn("fingerprint", as_text("__omh_a")).drop("__omh_a")


def followers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, next_id, most): for each id the next lower one (the greatest for the least), and the length of its longest text.

    Ids are sorted over all tasks; a row's successor is the row with the next number
    of its partition, or the first of the next partition, of which there is one row each.
    """
    sizes = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.max(F.length(F.coalesce(text, F.lit("")))).alias("most"))
    ranked = checkpointed(sizes.orderBy(F.desc("id")).withColumn("at", F.monotonically_increasing_id()))
    parts = ranked.groupBy(F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = parts.select("last", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.first("first").over(whole)).alias("then"))
    # One row a partition: its size is that of the plan, not of the data.
    linked = ranked.join(F.broadcast(ends), F.col("at") == F.col("last"), "left").select("id", "most", F.coalesce("then", F.col("at") + 1).alias("then"))
    return linked.join(ranked.select(F.col("at").alias("then"), F.col("id").alias("next_id")), "then").select("id", "next_id", "most")


def edited_report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K, length: int = LENGTH, count: int = COUNT) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the text with its last half (floor of its code points) replaced by
    as many code points from the beginning of the next document, or all of it.
    Texts are shuffled once, by id, and read twice from there; heads of half their length are shuffled once more.
    """
    links = checkpointed(followers(docs, key, text))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("t"))
    dealt = rows.where("id IS NOT NULL").repartition("id")
    # The rows of an id in a fixed order; rows that tie are equal.
    placed = dealt.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("t"), F.length("t"))))
    wanted = links.select(F.col("next_id").alias("id"), F.col("id").alias("before"), F.expr("most div 2").cast("int").alias("need"))
    heads = placed.where("place = 1").join(wanted, "id").select(F.col("before").alias("id"), F.left("t", F.col("need")).alias("head"))
    with_id = placed.join(heads, "id", "left")
    without = rows.where("id IS NULL").select("id", "t", F.lit(0).alias("place"), F.lit(None).cast("string").alias("head"))
    sizes = {"k": k, "length": length, "count": count}
    made = checkpointed(_compared(with_id, **sizes).unionByName(_compared(without, **sizes)))
    empty = with_fingerprint(docs.sparkSession.createDataFrame([("",)], "t string"), "t", "a", **sizes).first()["a"]
    seen = made.where("place = 1").select(F.col("id").alias("next_id"), F.col("a").alias("b")).join(links.select("id", "next_id"), "next_id").select("id", "b")
    joined = made.join(seen, "id", "left").withColumn("b", F.coalesce("b", F.array(*[F.lit(v) for v in empty])))
    return joined.select(F.col("id").alias(key), "n_chars", "edited_sha256", as_text("a").alias("fingerprint"), as_text("e").alias("edited_fingerprint"), "near_edited", likeness("a", "b").alias("near_next"))


def _compared(rows: DataFrame, **sizes: int) -> DataFrame:
    """(id, place, n_chars, edited_sha256, a, e, near_edited) of rows of (id, place, t, head)."""
    counted = rows.withColumn("n_chars", F.length("t").cast("long")).withColumn("half", F.expr("CAST(n_chars div 2 AS INT)"))
    edited = counted.withColumn("edited", F.concat(F.left("t", F.col("n_chars").cast("int") - F.col("half")), F.left(F.coalesce("head", F.lit("")), F.col("half"))))
    both = with_fingerprint(with_fingerprint(edited, "t", "a", **sizes), "edited", "e", **sizes)
    return both.select("id", "place", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", "e", likeness("a", "e").alias("near_edited"))
