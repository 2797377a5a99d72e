import pytest
from pyspark.sql import functions as F

from voxloom.operators import labels, metrics, semantics


def test_remap(spark):
    remap = labels.CoarseRemap({0: " Wall ", 1: "sky", 4: "Screen Door"})
    ids = spark.createDataFrame([(k,) for k in (0, 1, 2, 4)], "label bigint")
    assert [r[1] for r in remap.remap(ids).orderBy("label").collect()] == [2, 1, 1, 5]
    assert remap.remap(ids.limit(0)).count() == 0
    assert remap.lookup(spark).count() == 5
    for bad in (5, -1):
        with pytest.raises(Exception, match="outside the table"):
            remap.remap(spark.createDataFrame([(bad,)], "label bigint")).collect()


@pytest.mark.parametrize("names, error", [({}, ValueError), ({-1: "wall"}, ValueError), ({0: 3}, TypeError), ({"a": "wall"}, TypeError)])
def test_bad_vocabulary(names, error):
    with pytest.raises(error):
        labels.CoarseRemap(names)


def test_groups():
    assert len(labels.fine_to_coarse()) == sum(map(len, labels.COARSE_GROUPS.values())) == 91
    with pytest.raises(ValueError, match="two groups"):
        labels.fine_to_coarse({"ceiling": ("x",), "opening": (" X",)})
    with pytest.raises(ValueError, match="unknown coarse"):
        labels.fine_to_coarse({"roof": ("x",)})


def test_names(spark):
    remap = labels.CoarseRemap({0: "wall"})
    assert remap.coarse_name(14) == "navigation_structure"
    for bad in (15, -1):
        with pytest.raises(ValueError):
            remap.coarse_name(bad)
    vocabulary = spark.createDataFrame([(3, "desk")], "fine_id bigint, fine_name string")
    ids = spark.createDataFrame([(3,), (9,)], "label bigint")
    assert {tuple(r) for r in labels.with_class_names(ids, vocabulary).collect()} == {(3, "desk"), (9, "unknown_9")}
    assert labels.coarse_table(spark).count() == 15


def test_unknown_threshold(spark):
    rows = spark.createDataFrame([(1, 0.60, 0.45), (2, 0.59, 0.9), (3, 0.9, 0.44)], "label bigint, a float, c float")
    found = rows.select(semantics.unknown_label(F.col("label"), F.col("a"), F.col("c")))
    assert [r[0] for r in found.collect()] == [1, 150, 150]


def test_palettes(spark):
    hsv = {r["label"]: r[1:] for r in semantics.hsv_palette(spark).collect()}
    assert len(hsv) == 151
    assert hsv[0] == pytest.approx((0.95, 0.285, 0.285)) and hsv[150] == pytest.approx((0.45,) * 3)
    import colorsys

    for k in range(150):
        assert hsv[k] == pytest.approx(colorsys.hsv_to_rgb((k * semantics.GOLDEN_RATIO) % 1.0, 0.7, 0.95), abs=1e-6)
    drawn = semantics.random_palette(spark, 3).orderBy("label").collect()
    assert [tuple(r[1:]) for r in drawn] == [(136, 38, 217), (22, 205, 251), (33, 198, 193)]


def test_overlay(spark):
    pixels = spark.createDataFrame([(0, 1, 100, 0, 255)], "k int, label bigint, r int, g int, b int")
    palette = spark.createDataFrame([(1, 200, 10, 255)], "label bigint, r int, g int, b int")
    assert tuple(semantics.overlay(pixels, palette).select(*"rgb").first()) == (145, 4, 255)


def test_top_classes(spark):
    pixels = spark.createDataFrame([(k,) for k in (1, 1, 2, 2, 3, 4, 4, 4)], "label bigint")
    top = metrics.top_classes(metrics.class_histogram(pixels), 3).collect()
    assert [(r["label"], r["pixels"]) for r in top] == [(4, 3), (2, 2), (1, 2)]
    assert top[0]["ratio"] == 3 / 8


def test_softmax_and_predictor(spark):
    import numpy as np

    row = spark.createDataFrame([([0.0, 2.0, 2.0, 1.0],)], "l array<float>")
    label, confidence = row.select(*semantics.argmax_softmax(F.col("l"))).first()
    e = np.exp(np.array([0, 2, 2, 1.0]) - 2)
    assert label == 1 and confidence == pytest.approx(1 / e.sum())
    predictor = semantics.LogitsPredictor(lambda rgb: np.stack([np.zeros((2, 2)), np.array([[1.0, -1], [1, -1]])]))
    labels_, confidence = predictor.predict(np.zeros((4, 4, 3), np.uint8))
    assert labels_[:, 0].tolist() == [1] * 4 and labels_[:, 3].tolist() == [0] * 4 and confidence.dtype == np.float32
    for bad in (np.zeros((4, 4), np.uint8), np.zeros((4, 4, 3), np.float32)):
        with pytest.raises(ValueError):
            predictor.predict(bad)
    frames = spark.createDataFrame([(7, bytearray(48), 4, 4)], "frame_idx int, rgb binary, height int, width int")
    make = lambda: semantics.LogitsPredictor(lambda rgb: np.zeros((2, 2, 2)))
    assert semantics.segment(frames, make, ["frame_idx"]).filter("label = 0 and conf = 0.5").count() == 16


def test_resize_matches_pixels(spark):
    import numpy as np

    image = np.arange(12.0).reshape(3, 4) ** 1.5
    frame = spark.createDataFrame([(1, image.ravel().tolist())], "k int, a array<double>")
    found = semantics.resize_pixels(frame, "a", (3, 4), (5, 6), ["k"]).orderBy("v", "u").collect()
    wanted = semantics.resize_bilinear(image[None], 5, 6)[0].ravel()
    assert [r["value"] for r in found] == pytest.approx(wanted.tolist())


def test_caption_and_schedule(spark):
    row = spark.range(1).select(metrics.caption(F.lit(0), F.lit(9), F.lit(1234567), F.lit(5)).alias("c")).first()
    assert row["c"] == "Frame 1/9    |    Map voxels: 1,234,567    |    Current observations: 5"
    shown = metrics.frame_schedule(spark.range(3), "id", 5.0, 2.0).orderBy("id").collect()
    assert [r["repeats"] for r in shown] == [1, 1, 11]


def test_quality_of_an_empty_map(spark):
    none = spark.createDataFrame([], "semantic_agreement float, observation_count int")
    found = metrics.fusion_quality(none).first()
    assert found["voxels"] == 0 and found["retention_ratio"] == 0.0
