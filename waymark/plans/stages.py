"""The stages of a run as functions, and the run over many videos at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import scalars
from waymark.operators import filtering, models, summary
from waymark.schemas import Params


def place(*parts: str) -> Column:
    """A path below a video's own folder."""
    return F.concat_ws("/", "video_id", *map(F.lit, parts))


def demux_stage(frames: DataFrame, fixes: DataFrame | None = None, videos: DataFrame | None = None) -> DataFrame:
    """video_id, source_video (of `videos`: video_id, path; else null), frame_dir, frame_count, gps path if there are usable
    fixes, and the time of the run."""
    counts = summary.frame_count(frames).withColumn("timestamp", scalars.iso_now()).withColumn("frame_dir", place("frames"))
    if videos is None:
        counts = counts.withColumn("source_video", F.lit(None).cast("string"))
    else:
        counts = counts.join(videos.groupBy("video_id").agg(F.min("path").alias("source_video")), "video_id", "left")
    if fixes is None:
        return counts.withColumn("gps_csv", F.lit(None).cast("string"))
    usable = fixes.groupBy("video_id").agg(
        (F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()) > 0).alias("has_gps")
    )
    return counts.join(usable, "video_id", "left").withColumn("gps_csv", scalars.path_if(F.col("has_gps"), place("gps.csv"))).drop("has_gps")


def filter_stage(scores: DataFrame, params: Params = Params(), chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The manifest (`chosen`, if it was made before), and the funnel with the folders that it leads from and to."""
    if chosen is None:
        chosen = filtering.manifest(scores, params.blur_thresh, params.source_fps, params.target_fps)
    funnel = summary.filter_funnel(scores, chosen, params.blur_thresh, params.target_fps)
    return chosen, funnel.select("video_id", place("frames").alias("input_dir"), place("frames_filtered").alias("output_dir"), *funnel.columns[1:])


def sfm_stage(artifacts: DataFrame, demux: DataFrame | None = None) -> DataFrame:
    """The best model of each video with its audit and paths; the GPS file is that of the demux stage, if given."""
    best = models.best_model(artifacts).join(models.audit(artifacts), ["video_id", "model_id"])
    best = best.withColumns({
        "workspace": place("sparse"), "model_path": F.concat_ws("/", place("sparse"), "model_id"), "ply_path": place("model.ply"),
        "frames_path": place("frames_filtered"), "files_exist": F.struct("points3D", "cameras", "images", "ply"),
    }).drop("points3D", "cameras", "images", "ply")
    if demux is None:
        return best.withColumn("gps_csv_path", F.lit(None).cast("string"))
    return best.join(demux.select("video_id", F.col("gps_csv").alias("gps_csv_path")), "video_id", "left")


STAGES = {"demux": demux_stage, "filter": filter_stage, "sfm": sfm_stage}


def run_stage(name: str, *args, **options):
    if name not in STAGES:
        raise ValueError(f"unknown stage: {name}")
    return STAGES[name](*args, **options)


def run_all(
    scores: DataFrame, artifacts: DataFrame, fixes: DataFrame | None = None, params: Params = Params(), videos: DataFrame | None = None,
) -> DataFrame:
    """One nested result for each video that came through all stages; `videos` (video_id, path) names their source files."""
    demux = demux_stage(scores, fixes, videos)
    _, funnel = filter_stage(scores, params)
    return assembled(demux, funnel, sfm_stage(artifacts, demux))


def assembled(demux: DataFrame, funnel: DataFrame, sfm: DataFrame) -> DataFrame:
    """video_id and the nested result of each video that all three stages have."""
    pack = lambda df, name: df.select("video_id", F.struct(*[c for c in df.columns if c != "video_id"]).alias(name))
    whole = summary.assemble(pack(demux, "d"), pack(funnel, "f"), pack(sfm, "s"))
    outputs = F.struct(
        F.col("s.ply_path").alias("point_cloud"), F.col("s.model_path").alias("model_path"), F.col("f.output_dir").alias("filtered_frames"),
    )
    result = scalars.run_result(F.col("video_id"), F.col("d.source_video"), F.col("d"), F.col("f"), F.col("s"), outputs)
    return whole.select("video_id", result.alias("result"))
