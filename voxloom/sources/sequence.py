"""Readers of recorded sequences: index files, pose files and images.

A text index is read whole (it is one small file a sequence), so file order, on
which ties depend, is the position in the split text; many sequences are read
in parallel, a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.checks import require, require_any
from voxloom.sources.png import decode_png, rgb_only

POSE_FIELDS = ("t", "tx", "ty", "tz", "qx", "qy", "qz", "qw")


def stripped(column: Column) -> Column:
    """Without white space at either end; Spark's trim takes blanks only."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def text_lines(files: DataFrame, text: str = "value", keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """keys, idx (from 0 among what is left) and line of each file's lines that
    are neither blank nor comments."""
    lines = F.transform(F.split(F.col(text), "\n", -1), stripped)
    kept = F.filter(lines, lambda line: (line != "") & ~line.startswith("#"))
    return files.select(*keys, F.posexplode(kept).alias("idx", "line"))


def parse_index(files: DataFrame, text: str = "value", strict: bool = True) -> DataFrame:
    """seq_id, idx, t and path of index lines: fields parted by one blank, the
    rest ignored.  A line of one field or a bad number is an error; ``strict``
    also fails when there are no entries."""
    fields = F.split("line", " ", -1)
    second = require(F.size(fields) >= 2, F.get(fields, F.lit(1)), "an index line has a time and a path")
    entries = text_lines(files, text).select("seq_id", "idx", fields[0].cast("double").alias("t"), second.alias("path"))
    return require_any(entries, "the index has no entries") if strict else entries


def parse_poses(files: DataFrame, text: str = "value", strict: bool = True) -> DataFrame:
    """seq_id, idx, t, tx ... qw of pose lines: exactly eight fields."""
    fields = F.split("line", r"\s+", -1)
    checked = require(F.size(fields) == 8, fields, "a pose line has eight fields")
    columns = [F.get(checked, F.lit(k)).cast("double").alias(n) for k, n in enumerate(POSE_FIELDS)]
    entries = text_lines(files, text).select("seq_id", "idx", *columns)
    return require_any(entries, "the pose file has no entries") if strict else entries


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: seq_id (the folder's name) and value."""
    found = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return found.select(F.element_at(F.split("file", "/"), -2).alias("seq_id"), "value")


def read_index(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_index(read_text_files(spark, path), strict=strict)


def read_poses(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_poses(read_text_files(spark, path), strict=strict)


def read_images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """path and content (binary) of image files, listed by Spark."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def decode_frames(frames: DataFrame, keys: list[str], stride: int = 1) -> DataFrame:
    """Pixels of frames (keys, rgb and depth: PNG binaries): keys, v, u, red,
    green, blue and raw.  The stride is applied while decoding, since Spark
    cannot push a filter below Python; images must agree in size."""
    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                rgb, depth = rgb_only(decode_png(row["rgb"])), decode_png(row["depth"])
                if rgb.ndim != 3 or rgb.dtype != np.uint8:
                    raise ValueError("a colour image is 8-bit RGB")
                if depth.ndim != 2 or depth.shape != rgb.shape[:2]:
                    raise ValueError("a depth image is grey and as large as its colour image")
                v, u = np.mgrid[0 : depth.shape[0] : stride, 0 : depth.shape[1] : stride]
                v, u = v.ravel(), u.ravel()
                colour = rgb[v, u].astype(np.int16)
                yield pd.DataFrame(
                    {k: row[k] for k in keys}
                    | {"v": v, "u": u, "red": colour[:, 0], "green": colour[:, 1], "blue": colour[:, 2], "raw": depth[v, u].astype(np.int32)}
                )

    schema = f"{kinds}, v int, u int, red smallint, green smallint, blue smallint, raw int"
    return frames.select(*keys, "rgb", "depth").mapInPandas(run, schema)


def snapshot_id(path: Column) -> Column:
    """The number in .../snapshot_0005.npz."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.element_at(F.split(stem, "_"), -1)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot table that ``sinks.maps`` writes; none is an error."""
    return require_any(spark.read.parquet(path), "there are no snapshots")
