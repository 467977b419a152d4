"""Catalogues of sequences and experiments as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (dataset, sequence, first file, last file, depth, path).
SEQUENCES = (
    ("8iVFBv2", "redandblack", 1450, 1749, 10, "%s/%s/Ply/%s_vox10_%04d.ply"),
    ("8iVFBv2", "soldier", 536, 835, 10, "%s/%s/Ply/%s_vox10_%04d.ply"),
    ("8iVFBv2", "longdress", 1051, 1350, 10, "%s/%s/Ply/%s_vox10_%04d.ply"),
    ("8iVFBv2", "loot", 1000, 1299, 10, "%s/%s/Ply/%s_vox10_%04d.ply"),
    ("MVUB", "andrew9", 0, 317, 9, "%s/%s/ply/frame%04d.ply"),
    ("MVUB", "david9", 0, 215, 9, "%s/%s/ply/frame%04d.ply"),
    ("MVUB", "phil9", 0, 244, 9, "%s/%s/ply/frame%04d.ply"),
    ("MVUB", "ricardo9", 0, 215, 9, "%s/%s/ply/frame%04d.ply"),
    ("MVUB", "sarah9", 0, 206, 9, "%s/%s/ply/frame%04d.ply"),
)
#: Quantisation steps of every sweep.
STEPS = (1, 2, 4, 8, 12, 16, 20, 24, 32, 64)
#: Sizes of exp2_b44, exp2_b444 and exp2_b4444 on the sequences of depth 10, which stop a level short of the root.
SHORT_FOURS = ((2, 2, 2, 2, 2, 4, 4), (2, 2, 2, 4, 4, 4), (2, 4, 4, 4, 4))


def sequences(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(SEQUENCES), "dataset string, sequence string, first_file int, last_file int, depth int, path string")
    return rows.withColumn("n_frames", F.col("last_file") - F.col("first_file") + 1)


def frames(spark: SparkSession) -> DataFrame:
    """One row a frame, counted from 1, with its file number."""
    each = sequences(spark).select("dataset", "sequence", "depth", "first_file", F.explode(F.sequence(F.lit(1), F.col("n_frames"))).alias("frame"))
    return each.select("dataset", "sequence", "frame", (F.col("first_file") + F.col("frame") - 1).alias("file_no"), "depth")


def frame_path(dataset: str, sequence: str, frame: int, root: str = ".") -> tuple[str, int]:
    """(path, depth) of a frame counted from 1; an unknown sequence or frame is an error."""
    for d, s, first, last, depth, path in SEQUENCES:
        if (d, s) == (dataset, sequence):
            if not 1 <= frame <= last - first + 1:
                raise ValueError(f"{sequence} has {last - first + 1} frames, no frame {frame}")
            number = first + frame - 1
            name = path % ((d, s, s, number) if path.count("%s") == 3 else (d, s, number))
            return f"{root}/{name}", depth
    raise ValueError(f"no sequence {sequence} in {dataset}")


def _vector(finest: list[int], depth: int) -> list[int]:
    """Sizes coarsest first: twos from the root down to the given finest levels, as many as fit."""
    left = depth - sum(b.bit_length() - 1 for b in finest)
    return [2] * max(0, left) + finest


def experiments(spark: SparkSession) -> DataFrame:
    """(dataset, sequence, exp_name, bsize, multilevel): the sweeps' configurations, a row each."""
    rows: list[tuple[str, str, str, list[int], bool]] = []
    for dataset, sequence, _, _, depth, _ in SEQUENCES:
        finest = (2, 4, 8, 16) if dataset == "MVUB" else (2, 4, 8, 16, 32)
        rows += [(dataset, sequence, f"exp1_b{b}", _vector([b], depth), True) for b in finest]
        fours = [_vector([4] * n, depth) for n in (2, 3, 4)] if dataset == "MVUB" else SHORT_FOURS
        rows += [(dataset, sequence, "exp2_b" + "4" * n, list(v), True) for n, v in zip((2, 3, 4), fours, strict=True)]
        rows += [(dataset, sequence, f"exp_zhang_b{b}", [b], False) for b in (2, 4, 8, 16)]
        if dataset == "8iVFBv2":
            rows += [(dataset, sequence, "exp2_b" + "".join(map(str, v)), _vector(v, depth), True) for v in ([4, 8], [4, 4, 8], [4, 8, 8], [8, 8, 8])]
            rows += [(dataset, sequence, f"exp4_b{b}", _vector([b], depth), True) for b in (2, 4, 8, 16)]
    return spark.createDataFrame(rows, "dataset string, sequence string, exp_name string, bsize array<int>, multilevel boolean")
