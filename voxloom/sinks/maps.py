"""Map snapshots, experiment rows and overlays."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.checks import require_any
from voxloom.sources.png import encode_png


def write_snapshot(voxels: DataFrame, path: str, frame: int) -> str:
    """The map after a frame, as its own partition of the snapshot table; a
    second writing replaces it."""
    target = f"{path.rstrip('/')}/snapshot_frame={frame}"
    voxels.write.mode("overwrite").parquet(target)
    return target


def snapshot_npz(voxels: pd.DataFrame, current: np.ndarray) -> bytes:
    """A small map as the arrays that array-based viewers read."""
    out = io.BytesIO()
    v = voxels.sort_values(["ix", "iy", "iz"])
    np.savez_compressed(
        out,
        points=v[["x", "y", "z"]].to_numpy(np.float32),
        rgb_colors=v[["r", "g", "b"]].to_numpy(np.float32),
        labels=v["label"].to_numpy(np.int64),
        semantic_agreement=v["semantic_agreement"].to_numpy(np.float32),
        mean_model_confidence=v["mean_model_confidence"].to_numpy(np.float32),
        observation_counts=v["observation_count"].to_numpy(np.int32),
        current_points_world=np.asarray(current, np.float64),
    )
    return out.getvalue()


#: Arrays of a snapshot file and the map's columns they hold.
NPZ_COLUMNS = {
    "points": ("x", "y", "z"), "rgb_colors": ("r", "g", "b"), "labels": ("label",), "semantic_agreement": ("semantic_agreement",),
    "mean_model_confidence": ("mean_model_confidence",), "observation_counts": ("observation_count",),
}
NPZ_ROWS = (
    "snapshot_frame int, place bigint, x float, y float, z float, r float, g float, b float, label bigint, semantic_agreement float, "
    "mean_model_confidence float, observation_count int"
)


def npz_snapshots(snapshots: DataFrame, current: DataFrame) -> DataFrame:
    """snapshot_frame and npz: each snapshot as one file's bytes, made by the
    task that holds it.  ``current`` has snapshot_frame, x, y and z, the points
    of the frame itself.  A snapshot has to fit a worker, as its file would."""

    def run(voxels: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(voxels):
            return pd.DataFrame({"snapshot_frame": [], "npz": []})
        data = snapshot_npz(voxels, points[["x", "y", "z"]].to_numpy(np.float64))
        return pd.DataFrame({"snapshot_frame": [voxels["snapshot_frame"].iloc[0]], "npz": [data]})

    own = current.select("snapshot_frame", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    return snapshots.groupBy("snapshot_frame").cogroup(own.groupBy("snapshot_frame")).applyInPandas(run, "snapshot_frame int, npz binary")


def read_npz(files: DataFrame) -> DataFrame:
    """The voxels of snapshot files (snapshot_frame, npz), a row each; a file
    that lacks an array is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for frame, data in zip(batch["snapshot_frame"], batch["npz"], strict=True):
                arrays = load_npz(bytes(data))
                out = {"snapshot_frame": frame, "place": np.arange(len(arrays["labels"]))}
                for name, columns in NPZ_COLUMNS.items():
                    values = arrays[name].reshape(-1, len(columns))
                    out |= {c: values[:, k] for k, c in enumerate(columns)}
                yield pd.DataFrame(out)

    return files.select("snapshot_frame", "npz").mapInPandas(run, NPZ_ROWS)


def label_arrays(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, labels and confidence: the pixels of each frame (keys, v, u, label,
    conf) as the bytes of two NPY files; all pixels must be there."""
    kinds = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)

    def packed(values: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.save(out, values)
        return out.getvalue()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shape = (int(group["v"].max()) + 1, int(group["u"].max()) + 1)
        if len(group) != shape[0] * shape[1]:
            raise ValueError("an image lacks pixels or has some twice")
        labels, confidence = np.zeros(shape, np.int64), np.zeros(shape, np.float32)
        labels[group["v"], group["u"]], confidence[group["v"], group["u"]] = group["label"], group["conf"]
        return pd.DataFrame({k: [group[k].iloc[0]] for k in keys} | {"labels": [packed(labels)], "confidence": [packed(confidence)]})

    chosen = pixels.select(*keys, "v", "u", "label", "conf")
    return chosen.groupBy(*keys).applyInPandas(run, f"{kinds}, labels binary, confidence binary")


def read_label_arrays(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """The pixels of ``label_arrays`` rows: keys, v, u, label and conf."""
    kinds = ", ".join(f"{k} {arrays.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                labels, confidence = (np.load(io.BytesIO(bytes(row[c]))) for c in ("labels", "confidence"))
                if labels.shape != confidence.shape:
                    raise ValueError("labels and confidences differ in size")
                v, u = (x.ravel() for x in np.indices(labels.shape))
                yield pd.DataFrame({k: row[k] for k in keys} | {"v": v, "u": u, "label": labels.ravel(), "conf": confidence.ravel()})

    return arrays.select(*keys, "labels", "confidence").mapInPandas(run, f"{kinds}, v int, u int, label bigint, conf float")


def load_npz(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in found.files}


def write_experiments(rows: DataFrame, path: str) -> None:
    """Experiment rows as one CSV with a header, quotes doubled; none is an error."""
    require_any(rows, "there are no experiment rows").coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def overlay_png(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys and png: blended pixels (keys, v, u and 8-bit r, g, b) as images,
    each made by the task that holds its pixels; all pixels must be there."""
    kinds = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shape = (int(group["v"].max()) + 1, int(group["u"].max()) + 1)
        if len(group) != shape[0] * shape[1]:
            raise ValueError("an image lacks pixels or has some twice")
        image = np.zeros((*shape, 3), np.uint8)
        image[group["v"], group["u"]] = group[["r", "g", "b"]].to_numpy()
        return pd.DataFrame({k: [group[k].iloc[0]] for k in keys} | {"png": [encode_png(image)]})

    return pixels.select(*keys, "v", "u", "r", "g", "b").groupBy(*keys).applyInPandas(run, f"{kinds}, png binary")


def write_images(images: DataFrame, folder: str) -> None:
    """PNG files of frames (frame_idx; rgb: binary uint8, height, width), each
    written by the executor that holds it, to a folder that all share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names = []
            for row in batch.to_dict("records"):
                image = np.frombuffer(row["rgb"], np.uint8).reshape(int(row["height"]), int(row["width"]), 3)
                names.append(os.path.join(folder, f"rgb_{int(row['frame_idx']):04d}.png"))
                with open(names[-1], "wb") as out:
                    out.write(encode_png(image))
            yield pd.DataFrame({"path": names})

    images.select("frame_idx", "rgb", "height", "width").mapInPandas(run, "path string").count()
