"""Removal of lines that many documents share.

Lines are exploded as (128-bit hash of the normalised line, document). Distinct
documents are counted per hash, which Spark does in two steps, so a line that a
third of the corpus holds is spread over its documents first. Hashes over the
threshold are joined back to the pairs of their documents; the few pairs left
are gathered per document, and each document is put together again by line
position.

Defined results: a null or empty text is one empty line. Rows with the same id
count as one document; each keeps its own lines. A row with a null id loses no
line and counts for none. No documents give no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import ASCII_SPACE, checkpointed, slices, small_batches


#: Common lines that may be sent to all executors: 12 MB.
BROADCAST_LINES = 500_000


def line_key(line: str) -> bytes:
    """The key: ASCII white space stripped at both ends, A-Z in lower case."""
    return line.strip(ASCII_SPACE).encode().lower()


def _hash(line: str, min_chars: int) -> bytes | None:
    bare = line.strip(ASCII_SPACE)
    return hashlib.blake2b(bare.encode().lower(), digest_size=16).digest() if len(bare) >= min_chars else None


def line_hashes(docs: DataFrame, min_chars: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(h1, h2, doc) once for each distinct long line of each row with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                high, low, owner = [], [], []
                for i, t in zip(part.column(key).to_pylist(), part.column(text).to_pylist(), strict=True):
                    if not t or i is None:
                        continue
                    for h in {_hash(line, min_chars) for line in t.split("\n")} - {None}:
                        a, b = struct.unpack("<qq", h)
                        high.append(a)
                        low.append(b)
                        owner.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(owner, pa.int64())], ["h1", "h2", "doc"])

    return small_batches(docs.select(F.col(key).cast("long").alias(key), text)).mapInArrow(run, "h1 long, h2 long, doc long")


def lines_to_drop(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, gone): the hashes of the lines that each document loses, for those that lose any."""
    pairs = checkpointed(line_hashes(docs, min_chars, key=key, text=text))
    common = pairs.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("keeper")).where(F.col("n_docs") >= min_docs)
    common = checkpointed(common.drop("n_docs"))
    # The counted hashes go to all executors, so that the pairs of a very common line stay where they are; beyond, AQE splits its side.
    side = F.broadcast(common) if common.count() <= BROADCAST_LINES else common
    lost = pairs.join(side, ["h1", "h2"]).where("doc <> keeper")
    return lost.groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))


def _rebuilt(docs: DataFrame, make: Callable, fields: list[T.StructField], kept: list[str], min_chars: int, min_docs: int, key: str, text: str) -> DataFrame:
    gone = lines_to_drop(docs, min_chars=min_chars, min_docs=min_docs, key=key, text=text)
    # Names of our own, so that no column of the input clashes.
    own = [f"__line_{i}" for i in range(len(kept) + 1)]
    left = docs.select(F.col(key).cast("long").alias("__line_doc"), F.col(text).alias(own[0]), *[F.col(c).alias(n) for c, n in zip(kept, own[1:], strict=True)])
    joined = left.join(gone.select(F.col("doc").alias("__line_doc"), "gone").hint("shuffle_hash"), "__line_doc", "left").drop("__line_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, own[0]):
                made = []
                for t, g in zip(part.column(own[0]).to_pylist(), part.column("gone").to_pylist(), strict=True):
                    lines = (t or "").split("\n")
                    drop = {struct.pack("<qq", x["h1"], x["h2"]) for x in g or ()}
                    stay = [x for x in lines if _hash(x, min_chars) not in drop] if drop else lines
                    made.append(make(t, lines, stay))
                columns = [pa.array([m[i] for m in made], pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for i, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in own[1:]), *columns], [*kept, *(f.name for f in fields)])

    return joined.mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + fields))


def drop_common_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs in their own columns, text without the lines that at least min_docs documents hold (but for the largest id)."""
    kept = [c for c in docs.columns if c != text]
    fields = [T.StructField(text, T.StringType())]
    return _rebuilt(docs, lambda t, lines, stay: (t if len(stay) == len(lines) else "\n".join(stay),), fields, kept, min_chars, min_docs, key, text).select(*docs.columns)


def line_report(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_lines, n_dropped, kept_sha256) of every row."""
    fields = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    return _rebuilt(docs, lambda t, lines, stay: (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()), fields, [key], min_chars, min_docs, key, text)
