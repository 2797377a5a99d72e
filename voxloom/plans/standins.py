"""The driver's tables as observations, times, poses, images and labels."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.sources.png import encode_png

#: A small vocabulary; ids between have no name.
FINE = {
    1: " Wall ", 2: "sky", 3: "floor", 4: "Ceiling", 5: "bed", 7: "windowpane", 8: "cabinet", 10: "person", 12: "door", 14: "table",
    15: "plant", 18: "curtain", 19: "chair", 22: "painting", 23: "sofa", 24: "shelf", 27: "mirror", 28: "rug", 30: "armchair", 33: "desk",
    36: "lamp", 37: "bathtub", 38: "railing", 41: "box", 45: "bookcase", 50: "tree",
}
SEEN = ("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as labelled points; DECIMAL, so that sums are exact."""
    cents = lambda c, p: F.col(c).cast(f"decimal({p},2)")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        (cents("l_quantity", 12) - F.lit(25)).alias("x"),
        ((cents("l_extendedprice", 12) - F.lit(50000)) * F.lit(Decimal("0.001"))).alias("y"),
        (cents("l_tax", 4) * F.lit(10)).alias("z"),
        cents("l_tax", 4).alias("r"),
        cents("l_discount", 4).alias("g"),
        (cents("l_tax", 4) + cents("l_discount", 4)).alias("b"),
        F.col("l_linenumber").cast("bigint").alias("label"),
        (cents("l_discount", 4) * F.lit(10)).cast("decimal(4,1)").alias("conf"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate") - FIRST_MONTH).cast("int").alias("frame_idx"),
        *SEEN,
    )


#: The first month of the line items, 1992-01, as year * 12 + month.
FIRST_MONTH = 1992 * 12 + 1


def times(spark: SparkSession, sf_dir: str, kind: str, name: str) -> DataFrame:
    """Events of a type as index entries: seq_id, <name>_idx, <name>_t (microseconds)."""
    rows = table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.select(F.lit("s").alias("seq_id"), F.col("event_id").alias(f"{name}_idx"), micros.alias(f"{name}_t"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as poses: quaternions of small integers, never zero."""
    k, value = F.col("event_id"), F.coalesce(F.col("value"), F.lit(0.0))
    rows = table(spark, sf_dir, "events").filter("event_type = 'view'")
    return rows.select(
        k.alias("frame_idx"), value.alias("tx"), (value / 2.0).alias("ty"), (-value).alias("tz"),
        (k % 3 - 1).cast("double").alias("qx"), (k % 5 - 2).cast("double").alias("qy"), (k % 7 - 3).cast("double").alias("qz"),
        (k % 2 + 1).cast("double").alias("qw"),
    )


def placed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as camera points of the frame their part names."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_partkey").alias("frame_idx"), "l_orderkey", "l_linenumber",
        (F.col("l_quantity") - 25.0).alias("x"), ((F.col("l_extendedprice") - 50000.0) / 1000.0).alias("y"), (F.col("l_tax") * 10.0).alias("z"),
    )


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 images: vec_id, and rgb (with alpha) and depth as PNG."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"vec_id": batch["vec_id"], "rgb": [], "depth": []}
            for values in batch["w"]:
                w = np.asarray(values, np.int64).reshape(8, 8)
                channels = [w % 256, w * 7 % 256, w * 13 % 256, np.full((8, 8), 255)]
                out["rgb"].append(encode_png(np.stack(channels, 2).astype(np.uint8)))
                out["depth"].append(encode_png((w % 65536).astype(np.uint16)))
            yield pd.DataFrame(out)

    whole = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("bigint"))
    return table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("w")).mapInPandas(run, "vec_id bigint, rgb binary, depth binary")


def halves() -> object:
    """Makes a predictor: label 3 on the left half with 0.75, 7 on the right with 0.5."""

    class Halves:
        def predict(self, rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            left = np.arange(rgb.shape[1]) < rgb.shape[1] // 2
            whole = np.broadcast_to(left, rgb.shape[:2])
            return np.where(whole, 3, 7), np.where(whole, np.float32(0.75), np.float32(0.5))

    return Halves()


def depth_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 depth images with a confidence for each pixel."""
    from voxloom.operators.geometry import image_pixels

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"), "embedding")
    pixels = image_pixels(rows, "embedding", 8, "e")
    size = F.abs(F.col("e").cast("double"))
    return pixels.withColumn("depth", (size * 10.0).cast("float")).withColumn("conf", size.cast("float"))
