"""Frames that arrive as files, transformed one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from voxloom.operators.ragft import forward
from voxloom.operators.voxel import with_yuv

POINTS = "frame_id int, x long, y long, z long, red int, green int, blue int"


def transform_frames(spark: SparkSession, source: str, sink: str, checkpoint: str, bsize: int | list[int], depth: int) -> StreamingQuery:
    """Transform whole frames of Parquet points as their files appear; each batch's coefficients are appended to sink by frame."""

    def one(batch: DataFrame, batch_id: int) -> None:
        forward(with_yuv(batch), bsize, depth).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return spark.readStream.schema(POINTS).parquet(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
