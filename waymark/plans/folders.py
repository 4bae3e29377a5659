"""A run over folders, from image files to written results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import filtering
from waymark.plans import stages
from waymark.schemas import Params
from waymark.sources import catalogue, sinks


@dataclass(frozen=True)
class Run:
    """What a run has written, read back: `results` of videos that came through all stages, `unfinished` (video_id, missing) of the
    others with the stages that they lack, in order."""

    scores: DataFrame
    manifest: DataFrame
    demux: DataFrame
    filter: DataFrame
    sfm: DataFrame
    results: DataFrame
    unfinished: DataFrame


def run_folders(
    spark: SparkSession, frames: str, models: str, out: str, gps: str | None = None, videos: str | None = None, params: Params = Params(),
    glob: str = catalogue.FRAME_GLOB,
) -> Run:
    """Score the frames below `frames`, filter and renumber them, rank the models below `models`, and write below `out`: scores and
    manifest as Parquet, the metadata of each stage and the results as JSON, all by video.

    `gps` is one CSV of tracks or a folder of them, `videos` a folder of source files; a video's id is its file's name without
    extension. Every image is read once: scores are written first, and all that follows reads them. A video without a sharp frame
    has a filter stage with no files; one without a model, or with a model but no frames, is unfinished and fails no other video.
    No frames at all is an error, raised before anything is written. A second run into `out` replaces the first.
    """
    filtering.require_frames(catalogue.frames(spark, frames, glob, params.source_fps), frames)
    catalogue.scored_frames(spark, frames, glob, params.source_fps).write.mode("overwrite").parquet(f"{out}/scores")
    scores = spark.read.parquet(f"{out}/scores")
    fixes = None if gps is None else catalogue.gps_track(spark, gps)
    sources = None if videos is None else catalogue.source_videos(spark, videos)
    found = catalogue.artifacts(spark, models)

    chosen, funnel = stages.filter_stage(scores, params)
    sinks.write_manifest(chosen, f"{out}/manifest")
    manifest = spark.read.schema(chosen.schema).parquet(f"{out}/manifest")
    demux = _written(stages.demux_stage(scores, fixes, sources), f"{out}/demux")
    funnel = _written(stages.filter_stage(scores, params, manifest)[1], f"{out}/filter")
    sfm = _written(stages.sfm_stage(found, demux), f"{out}/sfm")
    results = _written(stages.assembled(demux, funnel, sfm), f"{out}/results")

    names = {"demux": demux, "filter": funnel, "sfm": sfm}
    passed = [df.select("video_id", F.lit(name).alias("stage")) for name, df in names.items()]
    by_video = passed[0].unionByName(passed[1]).unionByName(passed[2]).groupBy("video_id").agg(F.collect_set("stage").alias("done"))
    missing = F.array_except(F.array(*map(F.lit, names)), F.col("done"))
    unfinished = by_video.select("video_id", missing.alias("missing")).filter(F.size("missing") > 0)
    return Run(scores, manifest, demux, funnel, sfm, results, unfinished)


def _written(rows: DataFrame, path: str) -> DataFrame:
    """rows as JSON by video, read with the schema that they had."""
    sinks.write_metadata(rows, path)
    return rows.sparkSession.read.schema(rows.schema).json(path)
