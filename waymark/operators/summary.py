"""Counts and statistics a video, and the assembly of its stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.filtering import is_sharp


def frame_count(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video_id").agg(F.count("*").alias("frame_count"))


def quality_stats(scores: DataFrame, threshold: float = 100.0, videos: DataFrame | None = None) -> DataFrame:
    """Population statistics of sharpness a video. With `videos`, one without frames gets an error row."""
    value = F.col("sharpness")
    stats = scores.groupBy("video_id").agg(
        F.count("*").alias("total_frames"), F.avg(value).alias("mean_sharpness"), F.stddev_pop(value).alias("std_sharpness"),
        F.min(value).alias("min_sharpness"), F.max(value).alias("max_sharpness"),
        F.count_if(is_sharp(threshold)).alias("frames_above_threshold"),
    ).withColumn("blur_threshold", F.lit(float(threshold)))
    if videos is None:
        return stats
    none = F.when(F.col("total_frames").isNull(), F.lit("No frames to analyze"))
    return videos.select("video_id").join(stats, "video_id", "left").withColumn("error", none)


def file_chunks(manifest: DataFrame, size: int = 1000) -> DataFrame:
    """New names of a video in order, `size` of them to a row: video_id, chunk (from 0), files. A video may be of any length."""
    names = F.transform(F.sort_array(F.collect_list(F.struct("seq_no", "out_name"))), lambda x: x["out_name"])
    return manifest.groupBy("video_id", F.expr(f"(seq_no - 1) div {size}").alias("chunk")).agg(names.alias("files"))


def filter_funnel(
    scores: DataFrame, manifest: DataFrame, threshold: float = 100.0, target_fps: float = 5.0, videos: DataFrame | None = None, most_files: int = 1_000_000
) -> DataFrame:
    """Counts before, between and after the filters, with the new names in order; no list (null) for a video that keeps more than
    `most_files`: `file_chunks` has those."""
    before = scores.groupBy("video_id").agg(
        F.count("*").alias("original_count"), F.count_if(is_sharp(threshold)).alias("after_blur_filter")
    )
    name = F.when(F.col("seq_no") <= most_files, F.struct("seq_no", "out_name"))  # others are not gathered
    names = F.when(F.count("*") <= most_files, F.transform(F.sort_array(F.collect_list(name)), lambda x: x["out_name"]))
    kept = manifest.groupBy("video_id").agg(F.count("*").alias("final_count"), names.alias("filtered_files"))
    base = before if videos is None else videos.select("video_id").join(before, "video_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return base.join(kept, "video_id", "left").select(
        "video_id", zero("original_count"), zero("after_blur_filter"), zero("final_count"),
        F.lit(float(threshold)).alias("blur_threshold"), F.lit(float(target_fps)).alias("fps_target"),
        F.when(F.col("final_count").isNull(), F.array().cast("array<string>")).otherwise(F.col("filtered_files")).alias("filtered_files"),
    )


def assemble(demux: DataFrame, filtered: DataFrame, sfm: DataFrame, gps: DataFrame | None = None) -> DataFrame:
    """Videos that finished all stages; GPS is optional."""
    out = demux.join(filtered, "video_id").join(sfm, "video_id")
    return out if gps is None else out.join(gps, "video_id", "left")
