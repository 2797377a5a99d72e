"""Per-pixel semantics: predictors, softmax, resizing, palettes, thresholds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.pixels import blend, hsv_channels, single

UNKNOWN_LABEL = 150
#: The spacing of hues, and the colour of the unknown label.
GOLDEN_RATIO = 0.618033988749895
PALETTE_SATURATION, PALETTE_VALUE, UNKNOWN_GREY = 0.70, 0.95, 0.45
AGREEMENT, CONFIDENCE = 0.60, 0.45
#: Mean and deviation of red, green and blue that image models are trained with.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


class Predictor(Protocol):
    """Labels (int64) and confidences (float32) of an 8-bit (H, W, 3) image."""

    def predict(self, rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...


class LogitsPredictor:
    """A predictor over a function that gives logits (K, h, w): bilinear resize
    to the image, softmax, argmax."""

    def __init__(self, logits: Callable[[np.ndarray], np.ndarray]):
        self.logits = logits

    def predict(self, rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if rgb.ndim != 3 or rgb.shape[2] != 3 or rgb.dtype != np.uint8:
            raise ValueError("an image is uint8 of shape (H, W, 3)")
        full = resize_bilinear(self.logits(rgb).astype(np.float64), rgb.shape[0], rgb.shape[1])
        top = full.max(0)
        return full.argmax(0).astype(np.int64), (1 / np.exp(full - top).sum(0)).astype(np.float32)


class OnnxPredictor(LogitsPredictor):
    """A predictor over an ONNX segmentation model: scaled and normalised
    planes in, logits out.  ``session`` is an onnxruntime session (or anything
    with its ``run`` and ``get_inputs``); ``of_file`` makes a factory that every
    worker calls for itself."""

    def __init__(self, session, mean: tuple[float, ...] = MEAN, deviation: tuple[float, ...] = DEVIATION):
        self.session, self.input = session, session.get_inputs()[0].name
        self.mean, self.deviation = np.array(mean, np.float32), np.array(deviation, np.float32)
        super().__init__(self.scores)

    def scores(self, rgb: np.ndarray) -> np.ndarray:
        planes = ((rgb.astype(np.float32) / 255 - self.mean) / self.deviation).transpose(2, 0, 1)[None]
        return self.session.run(None, {self.input: planes})[0][0]

    @staticmethod
    def of_file(path: str) -> Callable[[], OnnxPredictor]:
        def make() -> OnnxPredictor:
            try:
                import onnxruntime
            except ImportError as missing:
                raise RuntimeError("an ONNX model needs onnxruntime") from missing
            return OnnxPredictor(onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"]))

        return make


def source_positions(n_out: int, n_in: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two neighbours of each output place and the weight of the second."""
    at = np.maximum((np.arange(n_out) + 0.5) * n_in / n_out - 0.5, 0)
    first = np.minimum(at.astype(np.int64), n_in - 1)
    return first, np.minimum(first + 1, n_in - 1), at - first


def resize_bilinear(planes: np.ndarray, height: int, width: int) -> np.ndarray:
    """(K, h, w) to (K, height, width), corners not aligned."""
    v0, v1, fv = source_positions(height, planes.shape[1])
    u0, u1, fu = source_positions(width, planes.shape[2])
    rows = planes[:, v0] * (1 - fv)[:, None] + planes[:, v1] * fv[:, None]
    return rows[:, :, u0] * (1 - fu) + rows[:, :, u1] * fu


def resize_pixels(images: DataFrame, values: str, size: tuple[int, int], out: tuple[int, int], keys: list[str], name: str = "value") -> DataFrame:
    """Bilinear resize of row-major array columns to a row for each output
    pixel; neighbours are read from the array, nothing is joined."""
    (h, w), (oh, ow) = size, out
    grid = images.select(*keys, values, F.explode(F.sequence(F.lit(0), F.lit(oh * ow - 1))).alias("__k"))
    v, u = F.floor(F.col("__k") / ow).cast("int"), (F.col("__k") % ow).cast("int")

    def around(place: Column, n_in: int, n_out: int) -> tuple[Column, Column, Column]:
        at = F.greatest((place.cast("double") + 0.5) * F.lit(float(n_in)) / F.lit(float(n_out)) - 0.5, F.lit(0.0))
        first = F.least(F.floor(at), F.lit(n_in - 1)).cast("int")
        return first, F.least(first + 1, F.lit(n_in - 1)).cast("int"), at - first.cast("double")

    (v0, v1, fv), (u0, u1, fu) = around(v, h, oh), around(u, w, ow)
    cell = lambda a, b: F.element_at(F.col(values), a * w + b + 1).cast("double")
    top = cell(v0, u0) * (1 - fu) + cell(v0, u1) * fu
    low = cell(v1, u0) * (1 - fu) + cell(v1, u1) * fu
    return grid.select(*keys, v.alias("v"), u.alias("u"), (top * (1 - fv) + low * fv).alias(name))


def argmax_softmax(logits: Column) -> tuple[Column, Column]:
    """The first label of the largest logit, and its softmax probability."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top.cast("double")))
    return (F.array_position(logits, top) - 1).cast("bigint"), (F.lit(1.0) / total).cast("float")


def unknown_label(label: Column, agreement: Column, confidence: Column, least_agreement: float = AGREEMENT, least_confidence: float = CONFIDENCE) -> Column:
    """The label, or the unknown one where agreement or confidence is below its
    threshold; both are compared as FLOAT."""
    low = (agreement.cast("float") < single(least_agreement)) | (confidence.cast("float") < single(least_confidence))
    return F.when(low, F.lit(UNKNOWN_LABEL).cast("bigint")).otherwise(label.cast("bigint"))


def hsv_palette(spark: SparkSession, classes: int = UNKNOWN_LABEL + 1) -> DataFrame:
    """label, r, g, b (FLOAT): hues a golden ratio apart, the unknown label grey."""
    labels = spark.range(classes).select(F.col("id").alias("label"))
    hue = (F.col("label").cast("double") * F.lit(GOLDEN_RATIO)) % F.lit(1.0)
    channels = hsv_channels(hue, PALETTE_SATURATION, PALETTE_VALUE)
    grey = single(UNKNOWN_GREY)
    return labels.select("label", *[F.when(F.col("label") == UNKNOWN_LABEL, grey).otherwise(c).alias(n) for n, c in channels.items()])


def random_palette(spark: SparkSession, classes: int, seed: int = 42) -> DataFrame:
    """label and 8-bit r, g, b drawn from a seeded PCG64 generator."""
    colours = np.random.default_rng(seed).integers(0, 256, (classes, 3), np.uint8)
    rows = [(k, *map(int, c)) for k, c in enumerate(colours)]
    return spark.createDataFrame(rows, "label bigint, r smallint, g smallint, b smallint")


def painted(points: DataFrame, red: float, green: float, blue: float) -> DataFrame:
    """Points in one colour (FLOAT), whatever theirs was."""
    kept = [c for c in points.columns if c not in ("r", "g", "b")]
    return points.select(*kept, single(red).alias("r"), single(green).alias("g"), single(blue).alias("b"))


def coloured(df: DataFrame, palette: DataFrame, prefix: str = "class_") -> DataFrame:
    """Adds each label's palette colour.  A palette is as long as the
    vocabulary; adaptive execution broadcasts it once its size is known."""
    colours = palette.select("label", *[F.col(c).alias(prefix + c) for c in "rgb"])
    return df.join(colours, "label")


def overlay(pixels: DataFrame, palette: DataFrame, alpha: float = 0.45) -> DataFrame:
    """8-bit pixels blended with their labels' 8-bit colours."""
    own = coloured(pixels, palette)
    return own.select(*[c for c in pixels.columns if c not in "rgb"], *[blend(F.col(c), F.col("class_" + c), alpha).alias(c) for c in "rgb"])


def segment(frames: DataFrame, make: Callable[[], Predictor], keys: list[str]) -> DataFrame:
    """Runs a predictor over frames (rgb: binary uint8, height, width): a row
    for each pixel, keys, v, u, label, conf.  One predictor for each worker."""
    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = make()
        for batch in batches:
            for row in batch.to_dict("records"):
                h, w = int(row["height"]), int(row["width"])
                labels, confidence = predictor.predict(np.frombuffer(row["rgb"], np.uint8).reshape(h, w, 3))
                v, u = np.divmod(np.arange(h * w), w)
                yield pd.DataFrame({k: row[k] for k in keys} | {"v": v, "u": u, "label": labels.ravel(), "conf": confidence.ravel()})

    return frames.select(*keys, "rgb", "height", "width").mapInPandas(run, f"{kinds}, v int, u int, label bigint, conf float")
