"""Reconstruction outputs: audit the files, choose the best model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import scalars


def audit(artifacts: DataFrame) -> DataFrame:
    """Which of the four files a model has, and the point cloud's size. The cloud lies beside the models."""
    name = F.col("file_name")
    clouds = artifacts.filter(name.endswith(".ply")).groupBy("video_id").agg(F.max("length").alias("ply_length"))
    has = lambda file, alias: F.bool_or(name == file).alias(alias)
    models = artifacts.filter(F.col("model_id").isNotNull()).groupBy("video_id", "model_id").agg(
        has("points3D.bin", "points3D"), has("cameras.bin", "cameras"), has("images.bin", "images")
    )
    return models.join(clouds, "video_id", "left").select(
        "video_id", "model_id", "points3D", "cameras", "images", F.col("ply_length").isNotNull().alias("ply"),
        scalars.size_mb(F.col("ply_length")).alias("ply_size_mb"),
    )


def best_model(artifacts: DataFrame) -> DataFrame:
    """A video's model with the most images, as its image file's size tells; ties to the first id."""
    images = F.when(F.col("file_name") == "images.bin", scalars.image_estimate(F.col("length")))
    sizes = artifacts.filter(F.col("model_id").isNotNull()).groupBy("video_id", "model_id").agg(
        F.coalesce(F.max(images), F.lit(0).cast("bigint")).alias("n_images")
    )
    return best_by_count(sizes, "n_images")


def best_by_count(models: DataFrame, count: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc(count), "model_id"))
    return models.withColumn("_r", rank).filter("_r = 1").drop("_r")
