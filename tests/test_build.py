"""The command from a recorded folder to maps, and replays of what it wrote."""

import csv
import sys

import numpy as np
import pytest
from test_replay import folder  # noqa: F401

from voxloom import build, replay
from voxloom.operators import semantics
from voxloom.plans.standins import halves

SMALL = {"frame_step": 1, "pixel_stride": 2, "voxel_size": 0.5, "every": 2, "fx": 8.0, "fy": 8.0, "cx": 3.5, "cy": 3.5}


def test_build_and_replay(spark, folder, tmp_path):  # noqa: F811
    out = str(tmp_path / "out")
    build.build(spark, build.Settings(str(folder), out, notes="a note", **SMALL), halves)
    assert [r[0] for r in spark.read.parquet(f"{out}/snapshots").select("snapshot_frame").distinct().orderBy("snapshot_frame").collect()] == [0, 2, 4]
    whole = spark.read.parquet(f"{out}/map")
    assert whole.selectExpr("sum(observation_count)").first()[0] == 5 * 15
    with open(f"{out}/map.ply") as file:
        assert f"element vertex {whole.count()}\n" in file.read()
    rows = [r for p in (tmp_path / "out/experiments").glob("part-*") for r in csv.DictReader(p.open())]
    assert len(rows) == 1 and rows[0]["raw_point_count"] == "75" and rows[0]["notes"] == "a note" and float(rows[0]["build_time_seconds"]) > 0
    assert rows[0]["output_path"] == f"{out}/map.ply" and float(rows[0]["ply_size_mb"]) > 0 and rows[0]["selected_frames"] == "5"
    replay.main(["--snapshots", f"{out}/snapshots", "--points", f"{out}/points", "--output", str(tmp_path / "replay")])
    captions = [r["caption"] for r in spark.read.parquet(str(tmp_path / "replay/frames")).orderBy("snapshot_frame").collect()]
    assert len(captions) == 3 and all(c.endswith("Current observations: 15") for c in captions)
    # without a table of points: what each snapshot has beyond the one before
    replay.main(["--snapshots", f"{out}/snapshots", "--output", str(tmp_path / "replay")])
    captions = [r["caption"] for r in spark.read.parquet(str(tmp_path / "replay/frames")).orderBy("snapshot_frame").collect()]
    assert [c.split(": ")[-1] for c in captions] == ["15", "30", "30"]


def test_nothing_to_build(spark, folder, tmp_path):  # noqa: F811
    with pytest.raises(ValueError, match="no frame"):
        far = tmp_path / "far"
        (far / "rgb").mkdir(parents=True)
        (far / "rgb.txt").write_text("1.0 rgb/1.png\n")
        (far / "depth.txt").write_text("9.0 depth/1.png\n")
        (far / "groundtruth.txt").write_text("1 0 0 0 0 0 0 1\n")
        build.build(spark, build.Settings(str(far), str(tmp_path / "none")), halves)


def test_arguments():
    settings, make = build.parse_arguments(["--sequence", "a", "--output", "b", "--voxel-size", "0.1", "--predictor", "voxloom.plans.standins:halves"])
    assert settings == build.Settings("a", "b", voxel_size=0.1) and make is halves
    with pytest.raises(SystemExit):
        build.parse_arguments(["--sequence", "a", "--output", "b"])


class Session:
    """Stands in for an onnxruntime session: scores are the planes themselves."""

    def get_inputs(self):
        return [type("Input", (), {"name": "pixels"})]

    def run(self, _, feeds):
        return [feeds["pixels"][:, :, ::2, ::2]]


def test_onnx_predictor():
    image = np.zeros((4, 6, 3), np.uint8)
    image[:, :, 1] = 255
    labels, confidence = semantics.OnnxPredictor(Session()).predict(image)
    assert labels.shape == confidence.shape == (4, 6) and (labels == 1).all() and ((0.5 < confidence) & (confidence <= 1)).all()
    scores = (np.array([0, 1, 0]) - semantics.MEAN) / semantics.DEVIATION
    assert confidence[0, 0] == pytest.approx(1 / np.exp(scores - scores.max()).sum(), abs=1e-5)
    sys.modules["onnxruntime"], kept = None, sys.modules.get("onnxruntime")
    try:
        with pytest.raises(RuntimeError, match="onnxruntime"):
            semantics.OnnxPredictor.of_file("x.onnx")()
    finally:
        sys.modules.pop("onnxruntime")
        if kept:
            sys.modules["onnxruntime"] = kept


def test_streamed_snapshots_do_not_depend_on_batches(spark, tmp_path):
    from voxloom.operators import fusion, snapshots
    from voxloom.streaming import mapping

    rows = [(0.1 * (k % 9), 0.0, 0.0, 0.5, 0.5, 0.5, k % 3, 0.5, k // 10) for k in range(70)]
    obs = spark.createDataFrame(rows, "x double, y double, z double, r float, g float, b float, label bigint, conf float, frame_idx int")
    mapping.write_frames(obs, str(tmp_path / "frames"))
    wanted = snapshots.map_snapshots(fusion.partials(obs, 0.25, by=["frame_idx"]), [0, 3, 6])
    text = lambda frame: sorted(map(str, frame.select(sorted(frame.columns)).collect()))
    for n in (1, 2, 7):
        snaps = str(tmp_path / f"snaps{n}")
        mapping.stream_map(spark, str(tmp_path / "frames"), obs.schema, 0.25, str(tmp_path / f"state{n}"), snaps, 3, n)
        assert text(spark.read.parquet(snaps)) == text(wanted)
