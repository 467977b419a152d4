"""ASCII PLY point clouds as tables, read and written in parallel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.plans.catalog import frame_path

HEADER_LINES = 200
#: Properties of a vertex that are read.
COLUMNS = ("x", "y", "z", "red", "green", "blue")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file, or of a folder whose parts follow each other by name; lines count from 0.

    Only the line counts of the file splits (one row each) are summed up in order; the rows stay where they are.
    """
    own = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    splits = own.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = splits.withColumn("before", F.sum("n").over(Window.orderBy("file", "at")) - F.col("n")).drop("n")
    return own.join(F.broadcast(before), ["file", "at"]).select((F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")


def read_header(spark: SparkSession, path: str, header_lines: int = HEADER_LINES) -> dict[str, object]:
    """{vertices, faces, properties, width, lines, skip} by keyword; at most header_lines lines are looked at.

    skip: lines of elements between the header and the vertices.
    """
    lines = [r["value"] for r in numbered_lines(spark, path).where(F.col("line") < header_lines).orderBy("line").collect()]
    return header_of(lines)


def header_of(lines: list[str]) -> dict[str, object]:
    """read_header of the first lines of a file."""
    out: dict[str, object] = {"vertices": 0, "faces": 0, "properties": [], "width": None, "lines": 0, "skip": 0}
    element, seen = "", 0
    for i, line in enumerate(lines):
        words = line.split()
        if words[:2] == ["format", "binary_little_endian"] or words[:2] == ["format", "binary_big_endian"]:
            raise ValueError("only ASCII PLY is read")
        if words[:1] == ["element"]:
            element = words[1]
            if element == "vertex":
                out["skip"] = seen
            if element in ("vertex", "face"):
                out["vertices" if element == "vertex" else "faces"] = int(words[2])
            seen += int(words[2])
        elif words[:1] == ["property"] and element == "vertex":
            out["properties"].append(words[-1])
        elif words[:2] == ["comment", "width"]:
            out["width"] = int(words[2])
        elif words[:1] == ["end_header"]:
            return out | {"lines": i + 1}
    raise ValueError(f"no end_header in the first {len(lines)} lines")


def read_ply(spark: SparkSession, path: str, frame_id: int = 0, header_lines: int = HEADER_LINES) -> DataFrame:
    """(frame_id, x, y, z, red, green, blue) of the vertices of a file, or of a folder of parts.

    Vertices are the lines that the header's counts give, whatever the faces look like.
    """
    head = read_header(spark, path, header_lines)
    names, first = head["properties"], head["lines"] + head["skip"]
    rows = numbered_lines(spark, path).where((F.col("line") >= first) & (F.col("line") < first + head["vertices"])).select(F.split(F.trim("value"), r"\s+").alias("w"))
    at = {n: F.col("w")[i] for i, n in enumerate(names)}
    return rows.select(
        F.lit(frame_id).alias("frame_id"),
        *[F.floor(at[a].cast("double")).cast("long").alias(a) for a in ("x", "y", "z")],
        *[at[c].cast("double").cast("int").alias(c) for c in ("red", "green", "blue")],
    )


_HEAD = "frame_id int, first long, vertices long, places array<int>, problem string"


def _parsed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The header of one file: its first line of vertices, their number, and the places of the columns; or what is wrong."""
    frame, lines = pdf["frame_id"].iloc[0], pdf.sort_values("line")["value"].tolist()
    try:
        head = header_of(lines)
        places = [head["properties"].index(n) for n in COLUMNS]
        return pd.DataFrame({"frame_id": [frame], "first": [head["lines"] + head["skip"]], "vertices": [head["vertices"]], "places": [places], "problem": [None]})
    except ValueError as e:
        return pd.DataFrame({"frame_id": [frame], "first": [0], "vertices": [0], "places": [[]], "problem": [str(e)]})


def read_frames(spark: SparkSession, paths: dict[int, str], header_lines: int = HEADER_LINES) -> DataFrame:
    """(frame_id, x, y, z, red, green, blue) of many files (or folders of parts), by frame, in one scan.

    Lines are numbered by file from the counts of the file's splits; every file has a header of its own, read in Spark. A bad header is an
    error when rows are asked for. Names of files (the last part of a path) tell frames apart, so they must differ.
    """
    names = {path.rstrip("/").rpartition("/")[2]: frame for frame, path in paths.items()}
    if len(names) < len(paths):
        raise ValueError("two frames have files of one name")
    lines = spark.read.text(list(paths.values())).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    steps = F.split("file", "/")
    name = F.element_at(steps, -1)
    # One row a frame: as many as are asked for.
    known = F.broadcast(spark.createDataFrame(list(names.items()), "name string, frame_id int"))
    own = lines.withColumn("name", F.when(F.element_at(steps, -2).isin(*names), F.element_at(steps, -2)).otherwise(name)).join(known, "name").drop("name")
    splits = own.groupBy("frame_id", "file", "at").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = splits.withColumn("before", F.sum("n").over(Window.partitionBy("frame_id").orderBy("file", "at")) - F.col("n")).select("file", "at", "before", "first")
    numbered = own.join(F.broadcast(before), ["file", "at"]).select("frame_id", (F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")
    heads = numbered.where(F.col("line") < header_lines).groupBy("frame_id").applyInPandas(_parsed, _HEAD)
    rows = numbered.join(F.broadcast(heads), "frame_id").where("problem IS NOT NULL OR line >= first AND line < first + vertices")
    words = rows.select("frame_id", F.split(F.trim("value"), r"\s+").alias("w"), F.expr("IF(problem IS NULL, places, CAST(raise_error(problem) AS array<int>))").alias("p"))
    at = {n: F.expr(f"w[p[{i}]]") for i, n in enumerate(COLUMNS)}
    return words.select("frame_id", *[F.floor(at[a].cast("double")).cast("long").alias(a) for a in COLUMNS[:3]], *[at[c].cast("double").cast("int").alias(c) for c in COLUMNS[3:]])


def load_frames(spark: SparkSession, dataset: str, sequence: str, frames: list[int], root: str = ".") -> tuple[DataFrame, int]:
    """(points of the frames of a catalogued sequence, counted from 1, as frame_id; their depth)."""
    paths = {f: frame_path(dataset, sequence, f, root) for f in frames}
    return read_frames(spark, {f: path for f, (path, _) in paths.items()}), next(depth for _, depth in paths.values())


def depth_of(spark: SparkSession, path: str) -> int | None:
    """log2(width + 1) of the header's width comment, if it has one."""
    width = read_header(spark, path)["width"]
    return None if width is None else int(width + 1).bit_length() - 1


def write_ply(points: DataFrame, path: str, width: int | None = None, faces: DataFrame | None = None) -> None:
    """Write a folder with header and rows as text parts in order (part 0 starts with the header).

    Rows are sorted by a range shuffle, so no task holds the whole cloud; joined
    in name order, the parts are one PLY file. faces: (i, j, k) of vertex rows.
    """
    n, m = points.count(), faces.count() if faces is not None else 0
    head = ["ply", "format ascii 1.0", *([f"comment width {width}"] if width is not None else []), f"element vertex {n}", *[f"property float {a}" for a in "xyz"], *[f"property uchar {c}" for c in ("red", "green", "blue")]]
    head += [f"element face {m}", "property list uchar int vertex_indices"] if faces is not None else []
    spark = points.sparkSession
    top = spark.createDataFrame([(0, i, 0, 0, line) for i, line in enumerate([*head, "end_header"])], "part int, a long, b long, c long, line string")
    body = points.select(F.lit(1).alias("part"), F.col("x").alias("a"), F.col("y").alias("b"), F.col("z").alias("c"), F.format_string("%d %d %d %d %d %d", "x", "y", "z", "red", "green", "blue").alias("line"))
    rows = top.unionByName(body)
    if faces is not None:
        rows = rows.unionByName(faces.select(F.lit(2).alias("part"), F.col("i").cast("long").alias("a"), F.col("j").cast("long").alias("b"), F.col("k").cast("long").alias("c"), F.format_string("3 %d %d %d", "i", "j", "k").alias("line")))
    rows.orderBy("part", "a", "b", "c").select("line").write.mode("overwrite").text(path)


def write_metrics(rd: DataFrame, path: str) -> None:
    """Rate-distortion rows, partitioned for later scans."""
    rd.write.mode("append").partitionBy("dataset", "sequence").parquet(path)
