"""Writers. All overwrite: nothing of an earlier, longer run stays behind."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_metadata(rows: DataFrame, path: str) -> None:
    """Stage metadata (demux, filter or model) as JSON, one folder a video."""
    rows.write.mode("overwrite").partitionBy("video_id").json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The filtered frame set: which source file has which new name. Bytes are not copied."""
    manifest.write.mode("overwrite").partitionBy("video_id").parquet(path)


def write_points(points: DataFrame, path: str) -> None:
    points.write.mode("overwrite").partitionBy("cloud_id").parquet(path)
