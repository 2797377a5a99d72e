"""The queries, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.pixels import byte_colour, depth_to_metres, unit_colour, valid_depth
from voxloom.functions.poses import TRANSLATION, distance
from voxloom.operators import association as assoc
from voxloom.operators import fusion, geometry, labels, metrics, selection, semantics, snapshots
from voxloom.plans.standins import FINE, SEEN, depth_pixels, halves, image_files, observations, placed_points, poses, table, times
from voxloom.replay import frame_points, replay_table
from voxloom.replay import semantic_pixels as label_pixels
from voxloom.session import saved, scratch
from voxloom.sinks.maps import label_arrays, npz_snapshots, overlay_png, read_label_arrays, read_npz, write_experiments, write_snapshot
from voxloom.sinks.ply import class_points, ply_lines
from voxloom.sinks.ply import finite_points as drop_not_finite
from voxloom.sources.png import encode_png
from voxloom.sources.sequence import decode_frames, parse_index, parse_poses, read_snapshots
from voxloom.streaming.mapping import last_map, stream_map, write_frames
from voxloom.streaming.visits import stream_visits, visits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SIZE = 4.0
#: Association tolerance: a minute in microseconds.
WIDTH = 60_000_000
EVERY = 20
STEPS, SIZES = (5, 10, 20), (2.0, 4.0, 8.0)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL that several queries share

OBS = """
o AS (
  SELECT *, r + g AS b,
         CAST(floor(CAST(x AS DOUBLE) / 4.0::DOUBLE) AS BIGINT) AS ix,
         CAST(floor(CAST(y AS DOUBLE) / 4.0::DOUBLE) AS BIGINT) AS iy,
         CAST(floor(CAST(z AS DOUBLE) / 4.0::DOUBLE) AS BIGINT) AS iz
  FROM (
    SELECT CAST(l_quantity AS DECIMAL(12,2)) - 25 AS x,
           (CAST(l_extendedprice AS DECIMAL(12,2)) - 50000) * CAST(0.001 AS DECIMAL(4,3)) AS y,
           CAST(l_tax AS DECIMAL(4,2)) * 10 AS z,
           CAST(l_tax AS DECIMAL(4,2)) AS r, CAST(l_discount AS DECIMAL(4,2)) AS g,
           CAST(l_linenumber AS BIGINT) AS label,
           CAST(CAST(l_discount AS DECIMAL(4,2)) * 10 AS DECIMAL(4,1)) AS conf,
           CAST(year(l_shipdate) * 12 + month(l_shipdate) - 23905 AS INTEGER) AS frame_idx,
           l_shipdate, l_orderkey, l_partkey, l_suppkey, l_extendedprice
    FROM lineitem
  )
)"""
PARTS = """
p AS (
  SELECT {by}ix, iy, iz, label, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb,
         sum(conf) AS sconf, count(*) AS n,
         min((l_shipdate, l_orderkey, l_partkey, l_suppkey, l_extendedprice)) AS first_seen
  FROM {source} GROUP BY {by}ix, iy, iz, label
)"""
MEANS = ", ".join(f"CAST(CAST(sum(s{c}) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS FLOAT) AS {c}" for c in "xyzrgb")
FINAL = """
SELECT {by}ix, iy, iz, """ + MEANS + """, {label} AS label,
       CAST(CASE WHEN sum(sconf) > 0 THEN CAST(max(sconf) AS DOUBLE) / CAST(sum(sconf) AS DOUBLE) ELSE 0 END AS FLOAT) AS semantic_agreement,
       CAST(CAST(sum(sconf) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS FLOAT) AS mean_model_confidence,
       CAST(sum(n) AS INTEGER) AS observation_count
FROM p GROUP BY {by}ix, iy, iz"""
LOWEST = "arg_max(label, (sconf, -label))"
MAP = "WITH " + OBS + "," + PARTS.format(by="", source="o") + FINAL.format(by="", label=LOWEST)
FIRST_SEEN = (
    "WITH " + OBS + "," + PARTS.format(by="", source="o")
    + ", q AS (SELECT *, row_number() OVER (PARTITION BY ix, iy, iz ORDER BY sconf DESC, first_seen) AS place FROM p)"
    + FINAL.format(by="", label="max(label) FILTER (place = 1)").replace("FROM p", "FROM q")
)
#: Every 20th frame counted from the table's first, and the last.
FRAMES = """e AS (SELECT min(frame_idx) AS lo, max(frame_idx) AS hi FROM o),
f AS (SELECT DISTINCT least(k * 20, hi - lo) AS snapshot_frame, lo FROM e, range(1000) AS r(k)),
s AS (SELECT o.*, CAST(f.snapshot_frame AS INTEGER) AS snapshot_frame FROM o JOIN f ON o.frame_idx - f.lo <= f.snapshot_frame)"""
SNAPSHOT_MAP = "WITH " + OBS + ", " + FRAMES + "," + PARTS.format(by="snapshot_frame, ", source="s") + FINAL.format(by="snapshot_frame, ", label=LOWEST)
UNKNOWN = "semantic_agreement < CAST(0.6 AS FLOAT) OR mean_model_confidence < CAST(0.45 AS FLOAT)"
CANDIDATES = """
a AS (SELECT event_id AS rgb_idx, epoch_us(ts) AS rgb_t FROM events WHERE event_type = 'view'),
b AS (SELECT event_id AS depth_idx, epoch_us(ts) AS depth_t FROM events WHERE event_type = 'click'),
c AS (SELECT rgb_idx, depth_idx, abs(rgb_t - depth_t) AS difference FROM a JOIN b ON abs(rgb_t - depth_t) <= 60000000)"""
GREEDY = "WITH RECURSIVE " + CANDIDATES + """,
k AS (SELECT *, row_number() OVER (ORDER BY difference, rgb_idx, depth_idx) AS k FROM c),
g AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS l, CAST([] AS BIGINT[]) AS r
  UNION ALL
  SELECT k.k, CASE WHEN list_contains(l, rgb_idx) OR list_contains(r, depth_idx) THEN l ELSE list_append(l, rgb_idx) END,
         CASE WHEN list_contains(l, rgb_idx) OR list_contains(r, depth_idx) THEN r ELSE list_append(r, depth_idx) END
  FROM g JOIN k ON k.k = g.k + 1
),
z AS (SELECT l, r FROM g ORDER BY k DESC LIMIT 1),
m AS (SELECT unnest(l) AS rgb_idx, unnest(r) AS depth_idx FROM z)
SELECT c.rgb_idx, c.depth_idx, c.difference FROM m JOIN c USING (rgb_idx, depth_idx)"""
PIXELS = """
e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, embedding, unnest(range(64)) AS k FROM embeddings),
d AS (
  SELECT vec_id, label, CAST(k // 8 AS INTEGER) AS v, CAST(k % 8 AS INTEGER) AS u,
         CAST(abs(CAST(embedding[k + 1] AS DOUBLE)) * 10.0::DOUBLE AS FLOAT) AS depth,
         CAST(abs(CAST(embedding[k + 1] AS DOUBLE)) AS FLOAT) AS conf
  FROM e
)"""
CAMERA = """
SELECT vec_id{more}, v, u, ((CAST(u AS DOUBLE) - 3.5::DOUBLE) * CAST(depth AS DOUBLE)) / 8.0::DOUBLE AS x,
       ((CAST(v AS DOUBLE) - 3.5::DOUBLE) * CAST(depth AS DOUBLE)) / 8.0::DOUBLE AS y, CAST(depth AS DOUBLE) AS z
FROM d WHERE v % 2 = 0 AND u % 2 = 0 AND isfinite(depth) AND depth >= CAST(0.1 AS FLOAT) AND depth <= CAST(5 AS FLOAT)"""
POSES = """
w AS (
  SELECT event_id AS frame_idx, coalesce(value, 0.0::DOUBLE) AS tx, coalesce(value, 0.0::DOUBLE) / 2.0::DOUBLE AS ty, -coalesce(value, 0.0::DOUBLE) AS tz,
         CAST(event_id % 3 - 1 AS DOUBLE) AS ax, CAST(event_id % 5 - 2 AS DOUBLE) AS ay,
         CAST(event_id % 7 - 3 AS DOUBLE) AS az, CAST(event_id % 2 + 1 AS DOUBLE) AS aw
  FROM events WHERE event_type = 'view'
),
n AS (SELECT *, sqrt(ax * ax + ay * ay + az * az + aw * aw) AS l FROM w),
q AS (SELECT frame_idx, tx, ty, tz, ax / l AS x, ay / l AS y, az / l AS z, aw / l AS w FROM n),
t AS (
  SELECT frame_idx,
         1.0::DOUBLE - 2.0::DOUBLE * (y * y + z * z) AS r00, 2.0::DOUBLE * (x * y - z * w) AS r01, 2.0::DOUBLE * (x * z + y * w) AS r02,
         2.0::DOUBLE * (x * y + z * w) AS r10, 1.0::DOUBLE - 2.0::DOUBLE * (x * x + z * z) AS r11, 2.0::DOUBLE * (y * z - x * w) AS r12,
         2.0::DOUBLE * (x * z - y * w) AS r20, 2.0::DOUBLE * (y * z + x * w) AS r21, 1.0::DOUBLE - 2.0::DOUBLE * (x * x + y * y) AS r22,
         tx, ty, tz
  FROM q
)"""
CLOUD = """
c AS (
  SELECT l_partkey AS frame_idx, l_orderkey, l_linenumber, l_quantity - 25.0::DOUBLE AS x,
         (l_extendedprice - 50000.0::DOUBLE) / 1000.0::DOUBLE AS y, l_tax * 10.0::DOUBLE AS z
  FROM lineitem
),
g AS (
  SELECT c.frame_idx, l_orderkey, l_linenumber, c.x AS px, c.y AS py, c.z AS pz, tx, ty, tz,
         c.x * r00 + c.y * r01 + c.z * r02 + tx AS x, c.x * r10 + c.y * r11 + c.z * r12 + ty AS y, c.x * r20 + c.y * r21 + c.z * r22 + tz AS z
  FROM c JOIN t ON c.frame_idx = t.frame_idx
)"""
HSV = """
h AS (SELECT range AS label, (CAST(range AS DOUBLE) * CAST('0.618033988749895' AS DOUBLE)) % 1.0::DOUBLE AS hue FROM range(151)),
i AS (SELECT label, floor(hue * 6.0::DOUBLE) AS i, hue * 6.0::DOUBLE - floor(hue * 6.0::DOUBLE) AS f FROM h),
j AS (
  SELECT label, i, 0.95::DOUBLE AS v, 0.95::DOUBLE * (1.0::DOUBLE - 0.7::DOUBLE) AS p,
         0.95::DOUBLE * (1.0::DOUBLE - 0.7::DOUBLE * f) AS q, 0.95::DOUBLE * (1.0::DOUBLE - 0.7::DOUBLE * (1.0::DOUBLE - f)) AS t
  FROM i
),
palette AS (
  SELECT label,
         CAST(CASE WHEN label = 150 THEN 0.45 ELSE CASE CAST(i AS INTEGER) WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END END AS FLOAT) AS r,
         CAST(CASE WHEN label = 150 THEN 0.45 ELSE CASE CAST(i AS INTEGER) WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q WHEN 4 THEN p ELSE p END END AS FLOAT) AS g,
         CAST(CASE WHEN label = 150 THEN 0.45 ELSE CASE CAST(i AS INTEGER) WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END END AS FLOAT) AS b
  FROM j
)"""
VOCABULARY = "fine AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in FINE.items()) + ") AS t(fine_id, fine_name))"
COARSE = """
groups AS (SELECT * FROM (VALUES ('wall', 2), ('floor', 3), ('rug', 3), ('ceiling', 4), ('windowpane', 5), ('door', 5), ('table', 6), ('desk', 6),
  ('chair', 7), ('sofa', 7), ('armchair', 7), ('cabinet', 8), ('shelf', 8), ('bookcase', 8), ('person', 10), ('lamp', 11), ('bathtub', 11),
  ('box', 12), ('plant', 13), ('curtain', 13), ('painting', 13), ('mirror', 13), ('railing', 14)) AS t(name, coarse_id)),
remapped AS (
  SELECT p_partkey, CAST(coalesce(groups.coarse_id, 1) AS BIGINT) AS coarse_id
  FROM part LEFT JOIN fine ON p_size = fine_id LEFT JOIN groups ON lower(trim(fine_name)) = groups.name
)"""
NAMES = "names AS (SELECT unnest(range(15)) AS id, unnest([" + ", ".join(f"'{n}'" for n in labels.COARSE_NAMES) + "]) AS name)"


# --- voxel maps


@query(MAP)
def voxel_map_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused map: sums for each voxel and label, then the strongest label."""
    return fusion.voxel_map(observations(spark, sf_dir), SIZE)


@query(FIRST_SEEN)
def voxel_fusion_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.voxel_map(observations(spark, sf_dir), SIZE, tie="first_seen", seen=F.struct(*SEEN))


@query("WITH " + OBS + """ SELECT ix, iy, iz, """ + ", ".join(f"CAST(CAST(sum({c}) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS FLOAT) AS {c}" for c in "xyzrgb") + " FROM o GROUP BY ix, iy, iz")
def voxel_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.downsample(observations(spark, sf_dir), SIZE)


@query(MAP)
def voxel_map_incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts of the observations fused apart and merged."""
    obs = observations(spark, sf_dir)
    return fusion.finalize(fusion.merge(*[fusion.partials(obs.filter(F.pmod("l_orderkey", F.lit(3)) == k), SIZE) for k in range(3)]))


@query(SNAPSHOT_MAP)
def voxel_map_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map after every 20th frame and after the last one."""
    return snapshots.whole_snapshots(fusion.partials(observations(spark, sf_dir), SIZE, by=["frame_idx"]), EVERY)


def streamed(spark: SparkSession, sf_dir: str, every: int) -> str:
    """The snapshot table of a stream of yearly frames."""
    obs = observations(spark, sf_dir).withColumn("frame_idx", F.floor(F.col("frame_idx") / 12).cast("int")).drop(*SEEN)
    base = scratch(spark, "stream")
    write_frames(obs, f"{base}/frames")
    stream_map(spark, f"{base}/frames", obs.schema, SIZE, f"{base}/state", f"{base}/snapshots", every)
    return f"{base}/snapshots"


@query(MAP)
def voxel_map_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map after a stream of yearly frames."""
    return last_map(spark, streamed(spark, sf_dir, 5))


YEARS = """y AS (SELECT * REPLACE (CAST(floor(frame_idx / 12) AS INTEGER) AS frame_idx) FROM o),
e AS (SELECT max(frame_idx) AS hi FROM y),
f AS (SELECT DISTINCT least(CAST(ceil(frame_idx / 2) * 2 AS INTEGER), hi) AS snapshot_frame FROM y, e),
s AS (SELECT y.*, f.snapshot_frame FROM y JOIN f ON y.frame_idx <= f.snapshot_frame)"""


@query("WITH " + OBS + ", " + YEARS + "," + PARTS.format(by="snapshot_frame, ", source="s") + FINAL.format(by="snapshot_frame, ", label=LOWEST))
def stream_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maps that the stream exports after every second year and the last."""
    return spark.read.parquet(streamed(spark, sf_dir, 2))


@query("WITH " + OBS + " SELECT ix, iy, iz, count(DISTINCT floor(frame_idx / 48)) AS frames, count(*) AS observations FROM o GROUP BY ALL")
def voxel_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames (of four years) and observations of each voxel, by a state of one's own.
    All frames come in one micro-batch: files of one second have no order."""
    obs = observations(spark, sf_dir).withColumn("frame_idx", F.floor(F.col("frame_idx") / 48).cast("int")).select("x", "y", "z", "frame_idx")
    base = scratch(spark, "visits")
    write_frames(obs, f"{base}/frames")
    stream_visits(spark, f"{base}/frames", obs.schema, SIZE, f"{base}/state", f"{base}/changes", 1000)
    return visits(spark, f"{base}/changes")


@query(MAP)
def voxel_map_empty_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update without observations changes nothing."""
    obs = observations(spark, sf_dir)
    nothing = fusion.partials(obs.filter("label < 0"), SIZE)
    return fusion.finalize(fusion.merge(nothing, fusion.partials(obs, SIZE), nothing))


@query("WITH m AS (" + MAP + ") SELECT ix, iy, iz, CAST(row_number() OVER (ORDER BY ix, iy, iz) - 1 AS BIGINT) AS place FROM m")
def voxel_export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each voxel in an export by key."""
    return selection.numbered(fusion.voxel_map(observations(spark, sf_dir), SIZE), ["ix", "iy", "iz"], "place").select("ix", "iy", "iz", "place")


@query("WITH m AS (" + MAP + ") SELECT ix, iy, iz, x, y, z, CAST(0.2 AS FLOAT) AS r, CAST(0.4 AS FLOAT) AS g, CAST(0.6 AS FLOAT) AS b FROM m")
def constant_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    voxels = fusion.voxel_map(observations(spark, sf_dir), SIZE)
    return semantics.painted(voxels.select("ix", "iy", "iz", "x", "y", "z"), 0.2, 0.4, 0.6)


NPZ = "snapshot_frame, x, y, z, r, g, b, label, semantic_agreement, mean_model_confidence, observation_count"


@query("WITH m AS (" + SNAPSHOT_MAP + f") SELECT CAST(row_number() OVER (PARTITION BY snapshot_frame ORDER BY ix, iy, iz) - 1 AS BIGINT) AS place, {NPZ} FROM m")
def npz_snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots written as array files and read back."""
    obs = observations(spark, sf_dir)
    current = obs.select(F.col("frame_idx").alias("snapshot_frame"), "x", "y", "z")
    return read_npz(npz_snapshots(voxel_map_snapshots(spark, sf_dir), current))


@query("WITH m AS (" + SNAPSHOT_MAP + ") SELECT snapshot_frame, count(*) AS voxels, CAST(row_number() OVER (ORDER BY snapshot_frame) - 1 AS BIGINT) AS place FROM m GROUP BY snapshot_frame")
def snapshot_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as a table that the sink wrote lists them, in order."""
    found, base = saved(voxel_map_snapshots(spark, sf_dir)), scratch(spark, "maps")
    for row in found.select("snapshot_frame").distinct().collect():  # a handful of frames
        write_snapshot(found.filter(F.col("snapshot_frame") == row[0]).drop("snapshot_frame"), base, row[0])
    counts = read_snapshots(spark, base).groupBy("snapshot_frame").agg(F.count("*").alias("voxels"))
    return selection.numbered(counts, ["snapshot_frame"], "place")


@query("WITH " + OBS + """, m AS (""" + SNAPSHOT_MAP + """), c AS (SELECT snapshot_frame, count(*) AS voxels, row_number() OVER (ORDER BY snapshot_frame) AS place,
count(*) OVER () AS total FROM m GROUP BY snapshot_frame),
p AS (SELECT frame_idx - (SELECT min(frame_idx) FROM o) AS snapshot_frame, count(*) AS points FROM o GROUP BY frame_idx)
SELECT snapshot_frame, concat('Frame ', place, '/', total, '    |    Map voxels: ', format('{:,}', voxels), '    |    Current observations: ',
       format('{:,}', coalesce(points, 0))) AS caption, CAST(CASE WHEN place = total THEN 11 ELSE 1 END AS INTEGER) AS repeats
FROM c LEFT JOIN p USING (snapshot_frame)""")
def replay_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a replay of the snapshots shows under each frame, and how often."""
    obs = observations(spark, sf_dir)
    first = obs.agg(F.min("frame_idx").alias("first"))
    current = frame_points(obs.join(first).withColumn("frame_idx", F.col("frame_idx") - F.col("first")))
    table = replay_table(voxel_map_snapshots(spark, sf_dir), current, 5.0, 2.0, semantics.AGREEMENT, semantics.CONFIDENCE)
    return table.select("snapshot_frame", "caption", "repeats")


@query("WITH " + OBS + " SELECT count(*) AS voxels FROM (SELECT DISTINCT ix, iy, iz FROM o)")
def voxel_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.voxel_count(fusion.partials(observations(spark, sf_dir), SIZE))


@query("WITH m AS (" + MAP + f") SELECT ix, iy, iz, CAST(CASE WHEN {UNKNOWN} THEN 150 ELSE label END AS BIGINT) AS label FROM m")
def unknown_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    voxels = fusion.voxel_map(observations(spark, sf_dir), SIZE)
    label = semantics.unknown_label(F.col("label"), F.col("semantic_agreement"), F.col("mean_model_confidence"))
    return voxels.select("ix", "iy", "iz", label.alias("label"))


@query("WITH m AS (" + SNAPSHOT_MAP + f""") SELECT snapshot_frame, count(*) AS voxels, CAST(count(*) FILTER ({UNKNOWN}) AS BIGINT) AS unknown_voxels,
CAST(count(*) FILTER ({UNKNOWN}) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS unknown_ratio FROM m GROUP BY snapshot_frame""")
def snapshot_unknown_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_metrics(voxel_map_snapshots(spark, sf_dir))


@query("WITH m AS (" + MAP + """) SELECT CAST(sum(observation_count) AS BIGINT) AS raw_points, count(*) AS voxels,
CAST(count(*) AS DOUBLE) / CAST(sum(observation_count) AS DOUBLE) AS retention_ratio,
CAST(sum(observation_count) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean_observations,
CAST(count(*) FILTER (observation_count > 1) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS multi_observation_ratio,
round(avg(CAST(semantic_agreement AS DOUBLE)), 6) AS mean_agreement,
CAST(count(*) FILTER (semantic_agreement < CAST(0.6 AS FLOAT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS low_agreement_ratio FROM m""")
def fusion_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fusion_quality(fusion.voxel_map(observations(spark, sf_dir), SIZE))


# --- association


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb, depth = times(spark, sf_dir, "view", "rgb"), times(spark, sf_dir, "click", "depth")
    pairs = assoc.band_join(rgb, depth, "rgb_t", "depth_t", WIDTH, ["seq_id"])
    return pairs.select("seq_id", "rgb_idx", "depth_idx", assoc.time_difference(F.col("rgb_t"), F.col("depth_t")).alias("difference"))


@query("WITH " + CANDIDATES + " SELECT rgb_idx, depth_idx, difference FROM c")
def assoc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).drop("seq_id")


def matched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb, depth = times(spark, sf_dir, "view", "rgb"), times(spark, sf_dir, "click", "depth")
    return assoc.match_nearest(rgb, depth, "seq_id", "rgb_idx", "rgb_t", "depth_idx", "depth_t", WIDTH)


@query(GREEDY)
def assoc_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_events(spark, sf_dir).drop("seq_id")


@query(GREEDY)
def assoc_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matching by rounds, for sequences too large for one task."""
    return assoc.match_mutual(candidates(spark, sf_dir), "seq_id", "rgb_idx", "depth_idx", "difference", saved).drop("seq_id")


@query(GREEDY.replace("SELECT c.rgb_idx, c.depth_idx, c.difference FROM", "SELECT c.rgb_idx, c.depth_idx, CAST(row_number() OVER (ORDER BY b.depth_t, c.difference, c.rgb_idx, c.depth_idx) - 1 AS INTEGER) AS rec_idx FROM") + " JOIN b USING (depth_idx)")
def assoc_depth_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matched pairs numbered by depth time."""
    matched = matched_events(spark, sf_dir)
    depth = times(spark, sf_dir, "click", "depth").select("depth_idx", "depth_t")
    ordered = assoc.in_depth_order(matched.join(depth, "depth_idx"), "seq_id", "depth_t", "difference", "rgb_idx", "depth_idx")
    return ordered.select("rgb_idx", "depth_idx", "rec_idx")


@query("""
WITH b AS (SELECT event_id AS depth_idx, epoch_us(ts) AS depth_t FROM events WHERE event_type = 'click'),
p AS (SELECT event_id AS pose_idx, epoch_us(ts) AS pose_t FROM events WHERE event_type = 'error'),
r AS (SELECT arg_min(pose_t, pose_idx) AS lo, arg_max(pose_t, pose_idx) AS hi FROM p),
c AS (SELECT depth_idx, depth_t, pose_idx, abs(depth_t - pose_t) AS gap FROM b JOIN p ON abs(depth_t - pose_t) <= 60000000)
SELECT depth_idx, arg_min(pose_idx, (gap, pose_idx)) AS pose_idx, min(gap) AS asof_gap
FROM c, r WHERE depth_t BETWEEN lo AND hi GROUP BY depth_idx""")
def assoc_nearest_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth, pose = times(spark, sf_dir, "click", "depth"), times(spark, sf_dir, "error", "pose")
    found = assoc.nearest_asof(depth, pose, "seq_id", "depth_idx", "depth_t", "pose_idx", "pose_t", WIDTH)
    return found.select("depth_idx", "pose_idx", "asof_gap")


@query("""
WITH b AS (SELECT event_id AS depth_idx, epoch_us(ts) AS depth_t FROM events WHERE event_type = 'click'),
p AS (SELECT event_id AS pose_idx, epoch_us(ts) AS pose_t FROM events WHERE event_type = 'error')
SELECT depth_idx, arg_min(pose_idx, (abs(depth_t - pose_t), pose_idx)) AS pose_idx, min(abs(depth_t - pose_t)) AS gap FROM b, p GROUP BY depth_idx""")
def assoc_nearest_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest pose at any distance."""
    depth, pose = times(spark, sf_dir, "click", "depth"), times(spark, sf_dir, "error", "pose")
    return assoc.nearest_entry(depth, pose, "seq_id", "depth_idx", "depth_t", "pose_idx", "pose_t").drop("seq_id")


@query("WITH " + CANDIDATES + " SELECT count(*) AS n, avg(difference) AS mean, max(difference) AS max, CAST(median(difference) AS DOUBLE) AS median FROM c")
def assoc_time_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assoc.time_statistics(candidates(spark, sf_dir), "difference")


#: One step for each entry of the first list: the best of the first j of the second is the best of what it was, of its pair and of those before j.
ORDERED = """WITH RECURSIVE
a AS (SELECT row_number() OVER (ORDER BY epoch_us(ts), event_id) AS i, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
b AS (SELECT row_number() OVER (ORDER BY epoch_us(ts), event_id) AS j, epoch_us(ts) AS t FROM events WHERE event_type = 'click'),
d AS (
  SELECT CAST(0 AS BIGINT) AS i, j, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS e FROM (SELECT 0 AS j UNION ALL SELECT j FROM b)
  UNION ALL
  SELECT i, j, best.n, -best.m FROM (
    SELECT i, j, max(own) OVER (ORDER BY j ROWS UNBOUNDED PRECEDING) AS best FROM (
      SELECT i, j, CASE WHEN gap <= 60000000 AND struct_pack(n := pn + 1, m := -(pe + gap)) > struct_pack(n := n, m := -e)
                        THEN struct_pack(n := pn + 1, m := -(pe + gap)) ELSE struct_pack(n := n, m := -e) END AS own
      FROM (
        SELECT a.i, d.j, d.n, d.e, lag(d.n) OVER (ORDER BY d.j) AS pn, lag(d.e) OVER (ORDER BY d.j) AS pe, abs(a.t - b.t) AS gap
        FROM d JOIN a ON a.i = d.i + 1 LEFT JOIN b ON b.j = d.j
      )
    )
  )
),
z AS (SELECT n, e FROM d ORDER BY i DESC, j DESC LIMIT 1)
SELECT n AS matches, CAST(e AS DOUBLE) AS total_difference FROM z"""


@query(ORDERED)
def dp_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-preserving matching: most pairs, then least total difference."""
    rgb, depth = times(spark, sf_dir, "view", "rgb"), times(spark, sf_dir, "click", "depth")
    pairs = assoc.match_ordered(rgb, depth, "seq_id", "rgb_idx", "rgb_t", "depth_idx", "depth_t", WIDTH)
    return pairs.agg(F.count("*").alias("matches"), F.sum("difference").alias("total_difference"))


# --- selection

EVENT_PLACE = "n AS (SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS rec_idx FROM events)"


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.numbered(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"]).drop("ts")


@query("WITH " + EVENT_PLACE + " SELECT event_id, rec_idx FROM n WHERE rec_idx % 20 = 0")
def frame_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.every_nth(numbered_events(spark, sf_dir), 20)


@query("WITH " + EVENT_PLACE + " SELECT event_id, rec_idx FROM n WHERE rec_idx = (SELECT count(*) // 2 FROM events)")
def middle_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.middle_row(numbered_events(spark, sf_dir))


@query("""WITH n AS (SELECT l_orderkey, l_partkey, CAST(row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS rec_idx FROM lineitem)
SELECT l_orderkey, l_partkey, rec_idx FROM n WHERE rec_idx % 4 = 0""")
def highlight_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.numbered(table(spark, sf_dir, "lineitem").select(*SEEN), list(SEEN))
    return selection.every_nth(rows, 4).select("l_orderkey", "l_partkey", "rec_idx")


LINE_PLACE = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, CAST(row_number() OVER (ORDER BY {LINE_PLACE}) - 1 AS BIGINT) AS rec_idx FROM lineitem")
def numbered_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of rows that carry more columns than their order."""
    rows = selection.numbered(table(spark, sf_dir, "lineitem"), LINE_PLACE.split(", "))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "rec_idx")


@query("""WITH p AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 11 = 0 THEN CAST('inf' AS DOUBLE) ELSE event_id / 4.0::DOUBLE END AS x,
CASE WHEN event_id % 13 = 0 THEN CAST('-inf' AS DOUBLE) ELSE -event_id / 8.0::DOUBLE END AS y FROM events)
SELECT event_id, x, y FROM p WHERE isfinite(x) AND isfinite(y)""")
def finite_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points without a coordinate that is not finite."""
    k, number = F.col("event_id"), lambda x: F.lit(float(x))
    x = F.when(k % 7 == 0, number("nan")).when(k % 11 == 0, number("inf")).otherwise(k / 4.0)
    y = F.when(k % 13 == 0, number("-inf")).otherwise(-k / 8.0)
    points = table(spark, sf_dir, "events").select(k, x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"))
    return drop_not_finite(points).drop("z")


# --- geometry


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, CAST(CAST(trunc(l_extendedprice) AS INTEGER) AS FLOAT) / CAST(5000 AS FLOAT) AS depth_m FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(depth_m AS FLOAT) AS depth_m FROM d WHERE isfinite(depth_m) AND depth_m >= CAST(0.1 AS FLOAT) AND depth_m <= CAST(5 AS FLOAT)""")
def depth_to_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    depth = depth_to_metres(F.col("l_extendedprice").cast("int"))
    return rows.select("l_orderkey", "l_linenumber", depth.alias("depth_m")).filter(valid_depth(F.col("depth_m")))


@query("WITH " + PIXELS + CAMERA.format(more=""))
def backproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.backproject(depth_pixels(spark, sf_dir), 2, 8.0, 8.0, 3.5, 3.5, carry=["vec_id"])


@query("WITH " + PIXELS + CAMERA.format(more=", label, conf"))
def backproject_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.backproject(depth_pixels(spark, sf_dir), 2, 8.0, 8.0, 3.5, 3.5, carry=["vec_id", "label", "conf"])


@query("WITH " + POSES + " SELECT * FROM t")
def pose_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.pose_matrices(poses(spark, sf_dir), ["frame_idx"])


@query("WITH " + POSES + "," + CLOUD + " SELECT frame_idx, l_orderkey, l_linenumber, x, y, z FROM g")
def transform_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.to_world(placed_points(spark, sf_dir), geometry.pose_matrices(poses(spark, sf_dir), ["frame_idx"]), ["frame_idx"])


@query("WITH " + POSES + "," + CLOUD + """ SELECT frame_idx, l_orderkey, l_linenumber, round(sqrt(px * px + py * py + pz * pz), 6) AS camera_distance,
round(sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty) + (z - tz) * (z - tz)), 6) AS world_distance FROM g""")
def rigid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each point to its camera, before and after it is placed."""
    points = placed_points(spark, sf_dir).select("*", *[F.col(c).alias("p" + c) for c in "xyz"])
    matrices = geometry.pose_matrices(poses(spark, sf_dir), ["frame_idx"])
    world = geometry.to_world(points, matrices, ["frame_idx"]).join(matrices.select("frame_idx", *TRANSLATION), "frame_idx")
    zero = (F.lit(0.0),) * 3
    before = distance((F.col("px"), F.col("py"), F.col("pz")), zero)
    after = distance((F.col("x"), F.col("y"), F.col("z")), tuple(F.col(t) for t in TRANSLATION))
    return world.select("frame_idx", "l_orderkey", "l_linenumber", F.round(before, 6).alias("camera_distance"), F.round(after, 6).alias("world_distance"))


@query("WITH " + OBS + " SELECT " + ", ".join(f"CAST({f}({c}) AS DOUBLE) AS {f}_{c}" for c in "xyz" for f in ("min", "max")) + " FROM o")
def cloud_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = geometry.bounds(observations(spark, sf_dir))
    return box.select(*[F.col(f"{f}_{c}").cast("double").alias(f"{f}_{c}") for c in "xyz" for f in ("min", "max")])


@query("WITH " + OBS + """, e AS (SELECT CAST(min(x) AS DOUBLE) AS lx, CAST(max(x) AS DOUBLE) AS hx, CAST(min(y) AS DOUBLE) AS ly, CAST(max(y) AS DOUBLE) AS hy,
CAST(min(z) AS DOUBLE) AS lz, CAST(max(z) AS DOUBLE) AS hz FROM o),
r AS (SELECT *, greatest(sqrt((hx - lx) ** 2 + (hy - ly) ** 2 + (hz - lz) ** 2) / 2, 0.1::DOUBLE) AS r, sqrt(1.3::DOUBLE ** 2 * 2 + 0.9::DOUBLE ** 2) AS d FROM e)
SELECT round((lx + hx) / 2, 6) AS center_x, round((ly + hy) / 2, 6) AS center_y, round((lz + hz) / 2, 6) AS center_z,
round((lx + hx) / 2 + 1.3::DOUBLE / d * 3 * r, 6) AS eye_x, round((ly + hy) / 2 - 1.3::DOUBLE / d * 3 * r, 6) AS eye_y, round((lz + hz) / 2 + 0.9::DOUBLE / d * 3 * r, 6) AS eye_z,
0.0::DOUBLE AS up_x, 0.0::DOUBLE AS up_y, 1.0::DOUBLE AS up_z, round(greatest(0.01::DOUBLE, r), 6) AS near_clip, round(5.5::DOUBLE * r, 6) AS far_clip FROM r""")
def fixed_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    camera = geometry.fixed_camera(observations(spark, sf_dir))
    return camera.select(*[F.round(c, 6).alias(c) for c in camera.columns])


# --- semantics


@query("""
WITH m AS (SELECT vec_id, embedding, list_max(embedding) AS top FROM embeddings)
SELECT vec_id, CAST(list_position(embedding, top) - 1 AS BIGINT) AS label,
       round(CAST(CAST(1.0::DOUBLE / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(top AS DOUBLE)))) AS FLOAT) AS DOUBLE), 6) AS conf
FROM m""")
def argmax_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, confidence = semantics.argmax_softmax(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.round(confidence.cast("double"), 6).alias("conf"))


@query("""
WITH k AS (SELECT vec_id, embedding, unnest(range(144)) AS k FROM embeddings),
p AS (SELECT vec_id, embedding, CAST(k // 12 AS INTEGER) AS v, CAST(k % 12 AS INTEGER) AS u FROM k),
s AS (SELECT *, greatest((v + 0.5::DOUBLE) * 8 / 12 - 0.5::DOUBLE, 0) AS sv, greatest((u + 0.5::DOUBLE) * 8 / 12 - 0.5::DOUBLE, 0) AS su FROM p),
n AS (SELECT *, CAST(least(floor(sv), 7) AS INTEGER) AS v0, CAST(least(floor(su), 7) AS INTEGER) AS u0 FROM s),
w AS (SELECT *, least(v0 + 1, 7) AS v1, least(u0 + 1, 7) AS u1, sv - v0 AS fv, su - u0 AS fu FROM n)
SELECT vec_id, v, u, round((CAST(embedding[v0 * 8 + u0 + 1] AS DOUBLE) * (1 - fu) + CAST(embedding[v0 * 8 + u1 + 1] AS DOUBLE) * fu) * (1 - fv)
  + (CAST(embedding[v1 * 8 + u0 + 1] AS DOUBLE) * (1 - fu) + CAST(embedding[v1 * 8 + u1 + 1] AS DOUBLE) * fu) * fv, 6) AS value FROM w""")
def bilinear_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    resized = semantics.resize_pixels(table(spark, sf_dir, "embeddings"), "embedding", (8, 8), (12, 12), ["vec_id"])
    return resized.select("vec_id", "v", "u", F.round("value", 6).alias("value"))


@query("WITH " + VOCABULARY + """, c AS (SELECT CAST(l_partkey % 40 AS BIGINT) AS label, count(*) AS pixels FROM lineitem GROUP BY ALL)
SELECT label, pixels, CAST(pixels AS DOUBLE) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE) AS ratio,
       coalesce(fine_name, concat('unknown_', label)) AS class_name
FROM c LEFT JOIN fine ON label = fine_id ORDER BY pixels DESC, label DESC LIMIT 15""")
def class_histogram_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("label"))
    vocabulary = spark.createDataFrame(list(FINE.items()), "fine_id bigint, fine_name string")
    return labels.with_class_names(metrics.top_classes(metrics.class_histogram(pixels), 15), vocabulary)


def remapped_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("label"))
    return labels.CoarseRemap(FINE).remap(parts).drop("label")


@query("WITH " + VOCABULARY + "," + COARSE + " SELECT p_partkey, coarse_id FROM remapped")
def coarse_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remapped_parts(spark, sf_dir)


@query("WITH " + VOCABULARY + "," + COARSE + "," + NAMES + """
SELECT coarse_id, count(*) AS points, concat(lpad(CAST(coarse_id AS VARCHAR), 2, '0'), '_', any_value(name), '.ply') AS file_name
FROM remapped JOIN names ON id = coarse_id GROUP BY coarse_id""")
def coarse_layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = remapped_parts(spark, sf_dir).groupBy("coarse_id").agg(F.count("*").alias("points"))
    file_name = F.format_string("%02d_%s.ply", F.col("coarse_id"), F.col("coarse_name"))
    return counts.join(labels.coarse_table(spark), "coarse_id").select("coarse_id", "points", file_name.alias("file_name"))


@query("SELECT p_type AS fine_name, count(DISTINCT p_brand) AS groups FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) > 1")
def coarse_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.duplicate_labels(table(spark, sf_dir, "part").select(F.col("p_type").alias("fine_name"), F.col("p_brand").alias("coarse_name")))


@query("WITH " + HSV + " SELECT label, r, g, b FROM palette")
def palette_hsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.hsv_palette(spark)


BYTES = ", ".join(f"round_even(CAST({c} AS DOUBLE) * 255, 0) AS {c}" for c in "rgb")


@query("WITH " + HSV + f", k AS (SELECT label, {BYTES} FROM palette)" + """
SELECT l_orderkey, l_linenumber, l_partkey,
""" + ", ".join(f"CAST(trunc(least(greatest(0.55::DOUBLE * CAST({p} AS DOUBLE) + 0.45::DOUBLE * {c}, 0), 255)) AS INTEGER) AS {c}" for p, c in (("l_partkey % 256", "r"), ("l_suppkey % 256", "g"), ("l_orderkey % 256", "b"))) + """
FROM lineitem JOIN k ON label = l_linenumber""")
def overlay_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    palette = semantics.hsv_palette(spark)
    palette = palette.select("label", *[byte_colour(F.col(c).cast("double"), 255.0).alias(c) for c in "rgb"])
    colours = {"r": "l_partkey", "g": "l_suppkey", "b": "l_orderkey"}
    pixels = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_linenumber").cast("bigint").alias("label"), *[(F.col(k) % 256).alias(c) for c, k in colours.items()]
    )
    return semantics.overlay(pixels, palette).drop("label")


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST(CAST({p} % 256 AS FLOAT) / CAST(255 AS FLOAT) AS FLOAT) AS {c}" for p, c in (("l_partkey", "r"), ("l_suppkey", "g"), ("l_orderkey", "b"))) + " FROM lineitem")
def colour_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    colours = {"r": "l_partkey", "g": "l_suppkey", "b": "l_orderkey"}
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", *[unit_colour((F.col(k) % 256).cast("smallint")).alias(c) for c, k in colours.items()])


@query("WITH " + VOCABULARY + "," + COARSE + """ SELECT p_partkey, coarse_id FROM remapped WHERE coarse_id = 3""")
def class_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of one coarse class, as its layer holds them."""
    return class_points(remapped_parts(spark, sf_dir), 3)


@query("SELECT CAST(p_size AS BIGINT) AS label, count(*) AS parts FROM part WHERE p_size < 0 OR p_size > 45 GROUP BY p_size")
def label_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the remap table, which the remap refuses, and their parts."""
    parts = table(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("label"))
    return labels.CoarseRemap({k: v for k, v in FINE.items() if k <= 45}).outside(parts).withColumnRenamed("n", "parts")


IMAGES = """
cell AS (SELECT vec_id, embedding, unnest(range(64)) AS k FROM embeddings),
word AS (
  SELECT vec_id, CAST(k // 8 AS INTEGER) AS v, CAST(k % 8 AS INTEGER) AS u, CAST(floor(abs(CAST(embedding[k + 1] AS DOUBLE)) * 1000) AS BIGINT) AS w FROM cell
),
x AS (SELECT vec_id, v, u, CAST(w % 256 AS SMALLINT) AS red, CAST(w * 7 % 256 AS SMALLINT) AS green, CAST(w * 13 % 256 AS SMALLINT) AS blue, CAST(w % 65536 AS INTEGER) AS raw FROM word)"""


@query("WITH " + IMAGES + " SELECT * FROM x WHERE v % 2 = 0 AND u % 2 = 0")
def png_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour (with an alpha channel) and 16-bit depth images, written as PNG,
    decoded and read on a stride."""
    return decode_frames(image_files(spark, sf_dir), ["vec_id"], 2)


@query("WITH " + IMAGES + """ SELECT CAST(vec_id AS INTEGER) AS frame_idx, v, u, red, green, blue, raw, CAST(CASE WHEN u < 4 THEN 3 ELSE 7 END AS BIGINT) AS label,
CAST(CASE WHEN u < 4 THEN 0.75 ELSE 0.5 END AS FLOAT) AS pconf FROM x WHERE v % 2 = 0 AND u % 2 = 0""")
def semantic_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour, depth, label and confidence of the pixels of each frame, from one
    decoding and one prediction a frame."""
    frames = image_files(spark, sf_dir).select(F.lit("s").alias("seq_id"), F.col("vec_id").cast("int").alias("frame_idx"), "rgb", "depth")
    return label_pixels(frames, halves, 2).drop("seq_id")


@query("WITH " + PIXELS + " SELECT vec_id, v, u, label, conf FROM d")
def label_array_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and confidences of each image, written as arrays and read back."""
    return read_label_arrays(label_arrays(depth_pixels(spark, sf_dir), ["vec_id"]), ["vec_id"])


@query("WITH " + HSV + f", c AS (SELECT label, {BYTES} FROM palette), " + IMAGES + """
SELECT vec_id, v, u, """ + ", ".join(f"CAST(trunc(least(greatest(0.55::DOUBLE * CAST({n} AS DOUBLE) + 0.45::DOUBLE * {c}, 0), 255)) AS SMALLINT) AS {n}" for n, c in (("red", "r"), ("green", "g"), ("blue", "b"))) + """
FROM x JOIN c ON c.label = x.raw % 150""")
def overlay_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlays written as PNG and decoded."""
    pixels = decode_frames(image_files(spark, sf_dir), ["vec_id"])
    base = pixels.select("vec_id", "v", "u", F.col("red").alias("r"), F.col("green").alias("g"), F.col("blue").alias("b"), (F.col("raw") % 150).cast("bigint").alias("label"))
    palette = semantics.hsv_palette(spark)
    palette = palette.select("label", *[byte_colour(F.col(c).cast("double"), 255.0).alias(c) for c in "rgb"])
    images = overlay_png(semantics.overlay(base, palette).drop("label"), ["vec_id"])
    grey = F.lit(encode_png(np.zeros((8, 8), np.uint16)))
    return decode_frames(images.select("vec_id", F.col("png").alias("rgb"), grey.alias("depth")), ["vec_id"]).drop("raw")


# --- metrics, sinks, sources


@query("WITH " + OBS + """, g AS (SELECT * FROM (VALUES (5), (10), (20)) AS s(frame_step), (VALUES (2.0::DOUBLE), (4.0::DOUBLE), (8.0::DOUBLE)) AS v(voxel_size_m)),
j AS (SELECT frame_step, voxel_size_m, frame_idx, floor(CAST(x AS DOUBLE) / voxel_size_m) AS a, floor(CAST(y AS DOUBLE) / voxel_size_m) AS b, floor(CAST(z AS DOUBLE) / voxel_size_m) AS c
      FROM o JOIN g ON frame_idx % frame_step = 0)
SELECT frame_step, voxel_size_m, count(DISTINCT frame_idx) AS selected_frames, count(*) AS raw_point_count, count(DISTINCT (a, b, c)) AS downsampled_point_count,
       round(CAST(count(DISTINCT (a, b, c)) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS retention_ratio FROM j GROUP BY frame_step, voxel_size_m""")
def experiment_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([(s, v) for s in STEPS for v in SIZES], "frame_step int, voxel_size_m double")
    return metrics.sweep(observations(spark, sf_dir), grid, "frame_idx")


PLY_BYTE = "CAST(round_even(least(greatest(CAST(CAST(CAST({c} AS FLOAT) * CAST(255 AS FLOAT) AS FLOAT) AS DOUBLE), 0), 255), 0) AS INTEGER)"


@query("WITH " + OBS + """ SELECT l_orderkey, l_partkey, concat_ws(' ', """ + ", ".join(f"printf('%.6f', CAST(CAST({c} AS FLOAT) AS DOUBLE))" for c in "xyz") + ", "
       + ", ".join(PLY_BYTE.format(c=c) for c in "rgb") + ") AS line FROM o")
def ply_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    points = obs.select("l_orderkey", "l_partkey", *[F.col(c).cast("float").alias(c) for c in "xyzrgb"])
    return ply_lines(points, ["l_orderkey", "l_partkey"])


@query("SELECT quantile_cont(l_extendedprice, 0.98::DOUBLE) AS value FROM lineitem")
def depth_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentile(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.98)


@query("""SELECT concat('Frame ', l_linenumber, '/7    |    Map voxels: ', format('{:,}', count(*)), '    |    Current observations: ',
format('{:,}', CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT))) AS caption FROM lineitem GROUP BY l_linenumber""")
def caption_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    return counts.select(metrics.caption(F.col("l_linenumber") - 1, F.lit(7), F.col("n"), F.col("q")).alias("caption"))


@query("WITH m AS (" + SQL["fusion_quality"] + """), t AS (SELECT unnest([
  concat('Raw observations: ', format('{:,}', raw_points)), concat('Map voxels: ', format('{:,}', voxels)), concat('Retention: ', printf('%.2f', round_even(retention_ratio * 10000, 0) / 100), '%'),
  concat('Mean observations per voxel: ', printf('%.2f', round_even(mean_observations * 100, 0) / 100)), concat('Voxels seen more than once: ', printf('%.2f', round_even(multi_observation_ratio * 10000, 0) / 100), '%'),
  concat('Mean semantic agreement: ', printf('%.4f', round_even(mean_agreement * 10000, 0) / 10000)), concat('Voxels of low agreement: ', printf('%.2f', round_even(low_agreement_ratio * 10000, 0) / 100), '%')]) AS line, unnest(range(7)) AS place FROM m)
SELECT CAST(place AS INTEGER) AS place, line FROM t""")
def fusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of a map as the lines of a report."""
    return metrics.report_lines(fusion_quality(spark, sf_dir))


@query("WITH s AS (" + SQL["experiment_sweep"] + """) SELECT CAST(frame_step AS VARCHAR) AS frame_step, CAST(voxel_size_m AS VARCHAR) AS voxel_size_m, '4' AS pixel_stride,
CAST(selected_frames AS VARCHAR) AS selected_frames, CAST(raw_point_count AS VARCHAR) AS raw_point_count, CAST(downsampled_point_count AS VARCHAR) AS downsampled_point_count,
retention_ratio, 0.5::DOUBLE AS build_time_seconds, round(CAST(downsampled_point_count * 48 AS DOUBLE) / 1048576, 6) AS ply_size_mb,
concat('maps/', frame_step, '.ply') AS output_path, 'a "quoted", note' AS notes FROM s""")
def experiment_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment rows written as CSV and read back."""
    path = F.concat(F.lit("maps/"), F.col("frame_step").cast("string"), F.lit(".ply"))
    rows = metrics.experiment_rows(experiment_sweep(spark, sf_dir), 4, F.lit(0.5), F.col("downsampled_point_count") * 48, path, F.lit('a "quoted", note'))
    folder = scratch(spark, "experiments")
    write_experiments(rows, folder)
    read = spark.read.csv(folder, header=True, escape='"')
    return read.withColumns({c: F.col(c).cast("double") for c in ("retention_ratio", "build_time_seconds", "ply_size_mb")})


def event_files(spark: SparkSession, sf_dir: str, line) -> DataFrame:
    """A text file for each hundred events, with a comment and a blank line."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.floor(F.col("event_id") / 100).cast("string")).alias("seq_id"), "event_id")
    lines = F.transform(F.sort_array(F.collect_list("event_id")), line)
    return rows.groupBy("seq_id").agg(F.concat(F.lit("# c\n\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("value"))


PLACE = "CAST(row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) - 1 AS INTEGER)"


@query(f"SELECT concat('s', event_id // 100) AS seq_id, {PLACE} AS idx, event_id + 0.5::DOUBLE AS t, concat('rgb/', event_id, '.png') AS path FROM events")
def index_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda k: F.concat(F.lit("\t"), k.cast("string"), F.lit(".5 rgb/"), k.cast("string"), F.lit(".png more"))
    return parse_index(event_files(spark, sf_dir, text), strict=False)


@query(f"""SELECT concat('s', event_id // 100) AS seq_id, {PLACE} AS idx, event_id + 0.25::DOUBLE AS t, CAST(event_id % 10 AS DOUBLE) AS tx, -1.5::DOUBLE AS ty,
CAST(event_id % 7 AS DOUBLE) AS tz, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, 0.5::DOUBLE AS qz, 1.0::DOUBLE AS qw FROM events""")
def pose_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: c.cast("string")
    text = lambda k: F.concat(s(k), F.lit(".25  "), s(k % 10), F.lit("\t-1.5 "), s(k % 7), F.lit(" 0 0 0.5 1"))
    return parse_poses(event_files(spark, sf_dir, text), strict=False)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
