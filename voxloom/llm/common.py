"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words in the contracts: \x20 and \x09-\x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Texts that a Python worker holds as objects at a time; Arrow batches are cut to it.
ARROW_ROWS = 2_000
SLICE_ROWS, SLICE_CHARS = 512, 3_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of spark.checkpoint.dir.

    Only where that is unset and Spark is local (tests) is a temporary folder taken.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not (context.master or "").startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def small_batches(df: DataFrame) -> DataFrame:
    """df, after asking its session for Arrow batches of at most ARROW_ROWS rows: whole texts are long, and a batch is held on both sides."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    return df


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that a worker holds a bounded number of texts as Python objects."""
    lengths = batch.column(text).to_pandas().str.len().fillna(0).tolist() if batch.num_rows > 1 else [0] * batch.num_rows
    start, chars = 0, 0
    for row, length in enumerate(lengths):
        if row > start and (chars + length > SLICE_CHARS or row - start >= SLICE_ROWS):
            yield batch.slice(start, row - start)
            start, chars = row, 0
        chars += length
    if batch.num_rows > start:
        yield batch.slice(start)


def crc32_of_id(column: str = "doc_id"):
    """crc32 of the id written as text, by which rows are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


#: Ids that may be sent to all executors: 8 MB.
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, gone: DataFrame, column: str, key: str) -> DataFrame:
    """docs less the rows whose key is in gone; rows with a null key stay.

    The counted ids are broadcast up to BROADCAST_IDS, so that no text is shuffled; beyond, both sides are.
    """
    gone = checkpointed(gone)
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, docs[key].cast("long") == side[column].cast("long"), "left_anti")


def with_ids(docs: DataFrame, wanted: DataFrame, column: str, key: str) -> DataFrame:
    """docs of the rows whose key is in wanted; the counted ids are broadcast up to BROADCAST_IDS."""
    wanted = checkpointed(wanted)
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    return docs.join(side, docs[key].cast("long") == side[column].cast("long"), "left_semi")
