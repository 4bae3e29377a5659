"""Explicit schemas of the engine's tables, and the parameters its operators share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


FRAMES = _struct(
    ("video_id", StringType()), ("path", StringType()), ("file_name", StringType()),
    ("frame_no", LongType()), ("t_sec", DoubleType()), ("length", LongType()),
)
FRAME_SCORES = StructType([*FRAMES.fields, *_struct(("sharpness", DoubleType()), ("decoded", BooleanType())).fields])
FRAME_MANIFEST = _struct(
    ("video_id", StringType()), ("src_path", StringType()), ("src_frame_no", LongType()), ("t_sec", DoubleType()),
    ("sharpness", DoubleType()), ("seq_no", LongType()), ("out_name", StringType()),
)
GPS_CSV = _struct(*((name, StringType()) for name in ("SourceFile", "GPSDateTime", "GPSLatitude", "GPSLongitude", "GPSAltitude")))
GPS_FIXES = _struct(
    ("video_id", StringType()), ("ts", TimestampType()), ("lat", DoubleType()), ("lon", DoubleType()), ("alt", DoubleType()),
)
ARTIFACTS = _struct(("video_id", StringType()), ("model_id", StringType()), ("file_name", StringType()), ("length", LongType()))
POINTS = _struct(
    ("cloud_id", StringType()), ("point_id", LongType()),
    *((name, DoubleType()) for name in ("x", "y", "z", "r", "g", "b")),
)
TRIANGLES = _struct(("cloud_id", StringType()), *((name, LongType()) for name in ("face_id", "a", "b", "c")))
LOG_LINES = _struct(
    ("run_id", LongType()), ("line_no", LongType()), ("ts", TimestampType()),
    ("logger", StringType()), ("level", StringType()), ("message", StringType()),
)
FILTER_METADATA = _struct(
    ("input_dir", StringType()), ("output_dir", StringType()), ("original_count", LongType()),
    ("after_blur_filter", LongType()), ("final_count", LongType()), ("blur_threshold", DoubleType()),
    ("fps_target", DoubleType()), ("filtered_files", ArrayType(StringType())),
)


@dataclass(frozen=True)
class Params:
    """Settings that more than one operator reads."""

    source_fps: float = 1.0
    target_fps: float = 5.0
    blur_thresh: float = 100.0
    overlap: int = 10
    ratio: float = 0.8
