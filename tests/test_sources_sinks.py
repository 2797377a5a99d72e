import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import fusion, labels, semantics
from voxloom.sinks import maps, ply
from voxloom.sources import datasource, png, sequence
from voxloom.streaming import mapping

FILES = "seq_id string, value string"


def test_index(spark):
    text = "# c\n\n\t1.0 a b\n"
    found = sequence.parse_index(spark.createDataFrame([("s", text)], FILES)).collect()
    assert [tuple(r) for r in found] == [("s", 0, 1.0, "a")]
    for bad in ("1.0\n", "x a\n"):
        with pytest.raises(Exception):  # noqa: B017
            sequence.parse_index(spark.createDataFrame([("s", bad)], FILES), strict=False).collect()
    with pytest.raises(ValueError, match="no entries"):
        sequence.parse_index(spark.createDataFrame([("s", "# only\n")], FILES))


def test_poses(spark):
    good = sequence.parse_poses(spark.createDataFrame([("s", "1 2 3\t4  5 6 7 8\n")], FILES)).first()
    assert tuple(good)[2:] == (1, 2, 3, 4, 5, 6, 7, 8)
    with pytest.raises(Exception, match="eight fields"):
        sequence.parse_poses(spark.createDataFrame([("s", "1 2 3 4 5 6 7\n")], FILES), strict=False).collect()


@pytest.mark.parametrize("shape, kind", [((5, 7), np.uint8), ((5, 7), np.uint16), ((4, 3, 3), np.uint8), ((4, 3, 4), np.uint8), ((2, 2, 3), np.uint16)])
def test_png_round_trip(shape, kind):
    image = np.random.default_rng(0).integers(0, np.iinfo(kind).max, shape, endpoint=True).astype(kind)
    assert np.array_equal(png.decode_png(png.encode_png(image)), image)


def filtered(image, kind):
    """A PNG of an 8-bit RGB image in which all lines use one filter."""
    import struct
    import zlib

    h, w, _ = image.shape
    rows, above, body = image.reshape(h, -1).astype(int), np.zeros(w * 3, int), b""
    for row in rows:
        left, corner = np.concatenate([[0] * 3, row[:-3]]), np.concatenate([[0] * 3, above[:-3]])
        near = left + above - corner
        a, b, c = abs(near - left), abs(near - above), abs(near - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        guess = (0 * row, left, above, (left + above) // 2, paeth)[kind]
        body += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda n, x: struct.pack(">I", len(x)) + n + x + struct.pack(">I", zlib.crc32(n + x))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return png.SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    image = np.random.default_rng(kind).integers(0, 256, (6, 5, 3)).astype(np.uint8)
    assert np.array_equal(png.decode_png(filtered(image, kind)), image)


def test_damaged_png():
    good = png.encode_png(np.zeros((2, 2), np.uint8))
    for bad in (b"", good[:-20], good[:40] + b"x" + good[41:]):
        with pytest.raises(ValueError):
            png.decode_png(bad)
    assert png.rgb_only(np.zeros((2, 2, 4))).shape == (2, 2, 3)


def test_sequence_folder(spark, tmp_path):
    folder = tmp_path / "seq"
    (folder / "rgb").mkdir(parents=True)
    (folder / "depth").mkdir()
    rgb = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    depth = np.full((4, 4), 5000, np.uint16)
    (folder / "rgb/1.png").write_bytes(png.encode_png(rgb))
    (folder / "depth/1.png").write_bytes(png.encode_png(depth))
    (folder / "rgb.txt").write_text("# c\n1.0 rgb/1.png\n")
    (folder / "depth.txt").write_text("1.0 depth/1.png\n")
    (folder / "groundtruth.txt").write_text("1.0 0 0 0 0 0 0 1\n")
    datasource.register(spark)
    got = spark.read.format("camera_sequence").option("kind", "depth").load(str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("seq", 0, 1.0, "depth/1.png")]
    assert sequence.read_index(spark, str(folder / "rgb.txt")).first()["path"] == "rgb/1.png"
    assert sequence.read_poses(spark, str(folder / "groundtruth.txt")).first()["qw"] == 1.0
    images = sequence.read_images(spark, str(folder))
    name = F.element_at(F.split("path", "/"), -2)
    both = images.withColumn("kind", name)
    frame = both.groupBy().agg(F.max(F.when(F.col("kind") == "rgb", F.col("content"))).alias("rgb"), F.max(F.when(F.col("kind") == "depth", F.col("content"))).alias("depth"))
    pixels = sequence.decode_frames(frame.withColumn("frame_idx", F.lit(0)), ["frame_idx"], 2)
    assert pixels.count() == 4 and pixels.filter("v = 2 and u = 2").first()["red"] == rgb[2, 2, 0]
    with pytest.raises(Exception):  # noqa: B017
        spark.read.format("camera_sequence").load(str(folder / "rgb")).collect()


def test_snapshot_id(spark):
    assert spark.range(1).select(sequence.snapshot_id(F.lit("a/b_c/snapshot_0015.npz"))).first()[0] == "0015"


POINTS = "k int, x double, y double, z double, r float, g float, b float"


def test_ply_colours(spark):
    low = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.5, 1.0, 0.0)], POINTS)
    assert tuple(ply.quantised_points(low).select(*"rgb").first()) == (128, 255, 0)
    high = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 200.5, 300.0, -4.0)], POINTS)
    assert tuple(ply.quantised_points(high).select(*"rgb").first()) == (200, 255, 0)
    whole = spark.createDataFrame([(0.0, 0.0, 0.0, 1, 0, 300)], "x double, y double, z double, r int, g int, b int")
    assert tuple(ply.quantised_points(whole).select(*"rgb").first()) == (1, 0, 255)


def test_ply_ties_and_not_finite(spark, tmp_path):
    rows = [(0, 0.0078125, -0.0078125, 1.0, 0.1, 0.2, 0.3), (1, math.nan, 0.0, 0.0, 0.1, 0.2, 0.3), (2, math.inf, 0.0, 0.0, 9.0, 9.0, 9.0)]
    path = str(tmp_path / "out" / "p.ply")
    assert ply.write_ply(spark.createDataFrame(rows, POINTS), path, ["k"]) == 1
    lines = open(path).read().split("\n")
    assert lines[2] == "element vertex 1" and lines[10] == "0.007812 -0.007812 1.000000 26 51 76" and lines[9] == "end_header"


def voxels(spark):
    rows = [(0.1 * k, 0.0, 0.0, 0.5, 0.5, 0.5, k % 2, 0.5) for k in range(8)]
    obs = spark.createDataFrame(rows, "x double, y double, z double, r float, g float, b float, label bigint, conf float")
    return obs, fusion.voxel_map(obs, 0.25)


def test_layers_csv_npz_and_snapshots(spark, tmp_path):
    _, found = voxels(spark)
    palette = semantics.hsv_palette(spark, 15)
    paths = ply.write_class_layers(found.withColumn("coarse_id", F.col("label") + 2), palette, labels.coarse_table(spark), str(tmp_path))
    assert all(p.split("/")[-1] in ("02_wall_structure.ply", "03_ground_surface.ply") for p in paths) and paths
    maps.write_snapshot(found, str(tmp_path / "maps"), 5)
    maps.write_snapshot(found, str(tmp_path / "maps"), 5)
    assert sequence.read_snapshots(spark, str(tmp_path / "maps")).filter("snapshot_frame = 5").count() == found.count()
    arrays = maps.load_npz(maps.snapshot_npz(found.toPandas(), np.zeros((2, 3))))
    assert arrays["points"].dtype == np.float32 and arrays["observation_counts"].sum() == 8
    row = spark.createDataFrame([(5, 0.02)], "frame_step int, voxel_size_m double")
    maps.write_experiments(row, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["frame_step", "voxel_size_m"]
    with pytest.raises(ValueError):
        maps.write_experiments(row.limit(0), str(tmp_path / "none"))
    image = spark.createDataFrame([(3, bytearray(range(12)), 2, 2)], "frame_idx int, rgb binary, height int, width int")
    maps.write_images(image, str(tmp_path / "png"))
    assert png.decode_png((tmp_path / "png/rgb_0003.png").read_bytes()).ravel().tolist() == list(range(12))


def test_stream_equals_batch(spark, tmp_path):
    obs, batch = voxels(spark)
    mapping.write_frames(obs.withColumn("frame_idx", F.col("label").cast("int")), str(tmp_path / "frames"))
    snaps = str(tmp_path / "snaps")
    done = mapping.stream_map(spark, str(tmp_path / "frames"), obs.schema, 0.25, str(tmp_path / "state"), snaps, every=2)
    assert done[0] == 0
    text = lambda frame: sorted(map(str, frame.select(sorted(frame.columns)).collect()))
    assert text(mapping.last_map(spark, snaps)) == text(batch)
    # nothing new: the same checkpoint goes on where it stopped
    assert mapping.stream_map(spark, str(tmp_path / "frames"), obs.schema, 0.25, str(tmp_path / "state"), snaps, every=2) == []
