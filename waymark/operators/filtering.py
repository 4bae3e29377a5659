"""Frame filters: blur, sampling in time, renumbering, and the guards around them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import scalars
from waymark.functions.sharpness import image_sharpness
from waymark.operators.ordering import positions


def score_images(images: DataFrame) -> DataFrame:
    """path, sharpness, decoded; undecodable images score 0 and stay."""
    return images.select("path", image_sharpness("image").alias("sharpness"), (F.col("image.height") > 0).alias("decoded"))


def is_sharp(threshold: float, column: str = "sharpness") -> Column:
    """At or above the threshold. NaN is not sharp, though Spark orders it above all numbers."""
    return (F.col(column) >= F.lit(float(threshold))) & ~F.isnan(column)


def blur_filter(scores: DataFrame, threshold: float = 100.0) -> DataFrame:
    return scores.filter(is_sharp(threshold))


#: Frames of a video are in order of their number; the path breaks ties.
FRAME_ORDER = ["frame_no", "path"]


def sampling_step(source_fps: float, target_fps: float) -> int:
    """Every how many-th survivor stays; 1 if the target is no lower than the source."""
    if not target_fps > 0 or not source_fps > 0:
        raise ValueError(f"frame rates must be positive: {source_fps}, {target_fps}")
    return 1 if target_fps >= source_fps else math.ceil(source_fps / target_fps)


def temporal_sample(sharp: DataFrame, source_fps: float = 1.0, target_fps: float = 5.0) -> DataFrame:
    """Every n-th survivor of each video, counted among survivors and not by frame number. A video may be of any length."""
    step = sampling_step(source_fps, target_fps)
    if step == 1:
        return sharp
    return positions(sharp, "video_id", FRAME_ORDER, "_i").filter(F.col("_i") % step == 0).drop("_i")


def renumber(selected: DataFrame) -> DataFrame:
    """Manifest: new sequence numbers and names beside the original number and time."""
    return _named(positions(selected, "video_id", FRAME_ORDER, "_i"), 1)


def _named(placed: DataFrame, step: int) -> DataFrame:
    """Every `step`-th of the placed frames; of these, its number is its place in steps, counted from 1."""
    rows = placed.filter(F.col("_i") % step == 0).withColumn("seq_no", F.expr(f"_i div {step} + 1"))
    return rows.select(
        "video_id", F.col("path").alias("src_path"), F.col("frame_no").alias("src_frame_no"), "t_sec", "sharpness", "seq_no",
        scalars.out_name(F.col("seq_no")).alias("out_name"),
    )


def manifest(scores: DataFrame, threshold: float = 100.0, source_fps: float = 1.0, target_fps: float = 5.0) -> DataFrame:
    """Blur filter, sampling and renumbering: frames are put in order once, as a place among survivors tells both whether a frame
    stays and its new number."""
    step = sampling_step(source_fps, target_fps)
    return _named(positions(blur_filter(scores, threshold), "video_id", FRAME_ORDER, "_i"), step)


def in_order(frames: DataFrame) -> DataFrame:
    return frames.orderBy("video_id", "frame_no", "path")


def require_frames(frames: DataFrame, where: str = "input") -> DataFrame:
    """Fail early if there is no frame at all."""
    if frames.limit(1).isEmpty():
        raise ValueError(f"no frames in {where}")
    return frames


def without(videos: DataFrame, other: DataFrame) -> DataFrame:
    """Videos that have no row in `other`: no frames, no model, or a stage that failed."""
    return videos.join(other.select("video_id").distinct(), "video_id", "left_anti")


def require_models(videos: DataFrame, artifacts: DataFrame) -> None:
    missing = without(videos, artifacts.filter(F.col("model_id").isNotNull())).select("video_id").limit(5).collect()
    if missing:
        raise RuntimeError("no model for " + ", ".join(str(r[0]) for r in missing))
