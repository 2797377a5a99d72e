"""A tiny recorded sequence from files to a map and its replay."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom import replay
from voxloom.operators import fusion, selection, snapshots
from voxloom.sources import png, sequence


def halves():
    """Makes a predictor: label 3 on the left half with 0.75, 7 on the right with 0.5."""

    class Halves:  # local, so that workers get it by value
        def predict(self, rgb):
            labels = np.full(rgb.shape[:2], 3)
            labels[:, rgb.shape[1] // 2 :] = 7
            return labels, np.where(labels == 3, np.float32(0.75), np.float32(0.5))

    return Halves


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("recorded") / "seq"
    (root / "rgb").mkdir(parents=True)
    (root / "depth").mkdir()
    lines = {"rgb": ["# colour"], "depth": ["# depth"], "groundtruth": ["# pose"]}
    for k in range(6):
        rgb = np.full((8, 8, 4), 255, np.uint8) if k == 0 else np.full((8, 8, 3), 40 * k, np.uint8)
        depth = np.full((8, 8), 5000, np.uint16)
        depth[0, 0] = 0
        (root / f"rgb/{k}.png").write_bytes(png.encode_png(rgb))
        (root / f"depth/{k}.png").write_bytes(png.encode_png(depth))
        lines["rgb"].append(f"{k}.0 rgb/{k}.png")
        lines["depth"].append(f"{k}.01 depth/{k}.png")
        lines["groundtruth"].append(f"{k}.015 {k} 0 0 0 0 0 1")
    for name, rows in lines.items():
        (root / f"{name}.txt").write_text("\n".join(rows) + "\n")
    return root


def observations(spark, folder, step=1):
    rgb, depth = (sequence.read_index(spark, f"{folder}/{n}.txt") for n in ("rgb", "depth"))
    poses = sequence.read_poses(spark, f"{folder}/groundtruth.txt")
    records = replay.associate(rgb, depth, poses)
    frames = replay.selected(records, step)
    images = sequence.read_images(spark, str(folder))
    return records, replay.semantic_observations(frames, images, halves(), 2, fx=8.0, fy=8.0, cx=3.5, cy=3.5)


def test_records(spark, folder):
    records, _ = observations(spark, folder)
    # the first depth time lies before the first pose
    found = [(r["rec_idx"], r["rgb_path"], r["tx"]) for r in records.orderBy("rec_idx").collect()]
    assert found == [(k, f"rgb/{k + 1}.png", float(k + 1)) for k in range(5)]


def test_map(spark, folder):
    _, obs = observations(spark, folder, 2)
    rows = obs.collect()
    assert len(rows) == 3 * 15 and {r["frame_idx"] for r in rows} == {0, 1, 2}
    point = next(r for r in rows if (r["frame_idx"], r["v"], r["u"]) == (1, 2, 4))
    assert (point["x"], point["y"], point["z"]) == (0.5 / 8 + 3, -1.5 / 8, 1.0) and point["label"] == 7
    assert point["r"] == pytest.approx(120 / 255)
    voxels = fusion.voxel_map(obs, 0.5)
    assert voxels.agg(F.sum("observation_count")).first()[0] == 45
    assert {r["label"] for r in voxels.collect()} == {3, 7}


def test_replay(spark, folder, tmp_path):
    _, obs = observations(spark, folder)
    frames = selection.snapshot_frames(4, 3)
    maps = snapshots.map_snapshots(fusion.partials(obs, 0.5, by=["frame_idx"]), frames)
    maps.write.partitionBy("snapshot_frame").parquet(str(tmp_path / "maps"))
    points = obs.groupBy(F.col("frame_idx").alias("snapshot_frame")).agg(F.count("*").alias("points"))
    table = replay.replay_table(maps, points, 5.0, 2.0, 0.6, 0.45).orderBy("snapshot_frame").collect()
    assert [r["snapshot_frame"] for r in table] == [0, 3, 4] and [r["repeats"] for r in table] == [1, 1, 11]
    assert table[1]["caption"].startswith("Frame 2/3    |    Map voxels: ") and table[1]["caption"].endswith("Current observations: 15")
    replay.main(["--snapshots", str(tmp_path / "maps"), "--output", str(tmp_path / "out"), "--fps", "4"])
    assert spark.read.parquet(str(tmp_path / "out/frames")).count() == 3
    assert spark.read.parquet(str(tmp_path / "out/voxels")).count() == maps.count()
    assert spark.read.parquet(str(tmp_path / "out/camera")).count() == 1


def test_arguments():
    assert replay.parse_arguments(["--snapshots", "a", "--output", "b"]) == replay.Parameters("a", "b")
    with pytest.raises(SystemExit):
        replay.parse_arguments([])
