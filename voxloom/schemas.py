"""Canonical schemas, as DDL."""

INDEX_ENTRY = "seq_id string, idx int, t double, path string"
POSE = "seq_id string, idx int, t double, tx double, ty double, tz double, qx double, qy double, qz double, qw double"
OBSERVATION = (
    "seq_id string, frame_idx int, v int, u int, x double, y double, z double, r float, g float, b float, label bigint, conf float"
)
VOXEL_MAP = (
    "ix bigint, iy bigint, iz bigint, x float, y float, z float, r float, g float, b float, label bigint, "
    "semantic_agreement float, mean_model_confidence float, observation_count int"
)
EXPERIMENT = (
    "frame_step int, voxel_size_m double, pixel_stride int, selected_frames int, raw_point_count bigint, downsampled_point_count bigint, "
    "retention_ratio double, build_time_seconds double, ply_size_mb double, output_path string, notes string"
)
