"""ASCII PLY: lines as a DataFrame, and a writer.

Lines are made on the executors.  Parts are text files written by Spark; the
header needs the number of points, so ``write_ply`` counts first and lays the
header before the parts.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.checks import finite
from voxloom.functions.pixels import byte_colour

HEADER = (
    "ply\nformat ascii 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\n"
    "property uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
)


def coordinate(column: Column) -> Column:
    """Six decimals of a FLOAT, ties to even, as a decimal that prints itself."""
    return F.bround(column.cast("float").cast("double").cast("decimal(38,18)"), 6).cast("string")


def finite_points(points: DataFrame) -> DataFrame:
    return points.filter(finite(F.col("x").cast("float")) & finite(F.col("y").cast("float")) & finite(F.col("z").cast("float")))


def quantised_points(points: DataFrame, order: list[str] | None = None) -> DataFrame:
    """x, y, z (FLOAT) and 8-bit r, g, b of the finite points.  Colours that are
    fractional in type and nowhere above 1 are scaled by 255."""
    kept = finite_points(points)
    # FLOAT colours are scaled in FLOAT: 0.3 becomes 76, in DOUBLE it would be 77
    kind = "float" if points.schema["r"].dataType.typeName() == "float" else "double"
    channels = [F.col(c).cast(kind) for c in "rgb"]
    if points.schema["r"].dataType.typeName() in ("float", "double", "decimal"):
        top = kept.agg(F.max(F.greatest(*channels)).alias("__top"))
        kept = kept.join(top).withColumn("__scale", F.when(F.col("__top") <= 1.0, 255.0).otherwise(1.0))
        colours = [byte_colour(c, F.col("__scale").cast(kind)).alias(n) for c, n in zip(channels, "rgb", strict=True)]
    else:
        colours = [byte_colour(c).alias(n) for c, n in zip(channels, "rgb", strict=True)]
    return kept.select(*(order or []), *[F.col(c).cast("float").alias(c) for c in "xyz"], *colours)


def ply_lines(points: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``order`` columns and the line of each point."""
    rows = quantised_points(points, order)
    text = F.concat_ws(" ", *[coordinate(F.col(c)) for c in "xyz"], *[F.col(c).cast("string") for c in "rgb"])
    return rows.select(*(order or []), text.alias("line"))


def write_ply(points: DataFrame, path: str, order: list[str] | None = None) -> int:
    """Writes one PLY file to any path that Spark writes to; returns its points.

    The parts are streamed into the file one after another through the file
    system that holds them, so the driver has a buffer, never the points.
    """
    lines = ply_lines(points, order)
    if order:
        lines = lines.orderBy(*order)
    spark, parts = lines.sparkSession, f"{path}.parts"
    lines.select("line").write.mode("overwrite").text(parts)
    n = spark.read.text(parts).count()
    hadoop = spark._jvm.org.apache.hadoop
    folder, conf = hadoop.fs.Path(parts), spark._jsc.hadoopConfiguration()
    store = folder.getFileSystem(conf)
    store.setWriteChecksum(False)
    out = store.create(hadoop.fs.Path(path), True)
    try:
        out.write(bytearray(HEADER.format(n=n).encode()))
        for name in sorted(str(x.getPath().getName()) for x in store.listStatus(folder)):
            if name.startswith("part-"):
                part = store.open(hadoop.fs.Path(folder, name))
                try:
                    hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                finally:
                    part.close()
    finally:
        out.close()
        store.setWriteChecksum(True)
        store.delete(folder, True)
    return n


def class_points(voxels: DataFrame, coarse_id: int) -> DataFrame:
    """The voxels of one coarse class."""
    return voxels.filter(F.col("coarse_id") == coarse_id)


def write_class_layers(voxels: DataFrame, palette: DataFrame, names: DataFrame, folder: str) -> list[str]:
    """One PLY for each coarse class present (coarse_id on ``voxels``), in the
    class's colour, named by id and name; returns the paths."""
    present = voxels.select("coarse_id").distinct().join(names, "coarse_id").orderBy("coarse_id").collect()
    paths = []
    for row in present:  # as many as there are classes
        own = class_points(voxels, row["coarse_id"]).drop("r", "g", "b")
        coloured = own.join(palette.select(F.col("label").alias("coarse_id"), "r", "g", "b"), "coarse_id")
        paths.append(os.path.join(folder, f"{row['coarse_id']:02d}_{row['coarse_name']}.ply"))
        write_ply(coloured, paths[-1])
    return paths
