"""Point clouds and meshes: colours, edges, vertices, normals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def colour_max(points: DataFrame) -> DataFrame:
    """Largest colour value of each cloud; alpha is not looked at."""
    return points.groupBy("cloud_id").agg(F.max(F.greatest("r", "g", "b")).alias("max_colour"))


def normalise_colours(points: DataFrame) -> DataFrame:
    """Colours to 0..1: a cloud with any value above 1 is divided by 255; alpha goes."""
    scale = F.when(F.col("max_colour") > 1, 255.0).otherwise(1.0)
    keep = [c for c in points.columns if c not in ("r", "g", "b", "a", "cloud_id")]
    return points.join(colour_max(points), "cloud_id").select("cloud_id", *keep, *[(F.col(c) / scale).alias(c) for c in "rgb"])


def mesh_edges(triangles: DataFrame) -> DataFrame:
    """Undirected edges, each once."""
    side = lambda p, q: F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"))
    sides = F.explode(F.array(side("a", "b"), side("b", "c"), side("a", "c")))
    return triangles.select(sides.alias("e")).select("e.u", "e.v").distinct()


def mesh_vertices(vertices: DataFrame) -> DataFrame:
    return vertices.select("x", "y", "z")


def vertex_normals(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Area-weighted unit normals. vertices: id, x, y, z; triangles: a, b, c. A vertex of flat triangles only gets zeros."""
    at = lambda c: vertices.select(F.col("id").alias(c), *[F.col(k).alias(k + c) for k in "xyz"])
    t = triangles.select("a", "b", "c").join(at("a"), "a").join(at("b"), "b").join(at("c"), "c")
    d = lambda k, p: F.col(k + p) - F.col(k + "a")
    cross = lambda p, q: d(p, "b") * d(q, "c") - d(q, "b") * d(p, "c")
    corners = t.select(
        F.explode(F.array("a", "b", "c")).alias("id"), cross("y", "z").alias("nx"), cross("z", "x").alias("ny"), cross("x", "y").alias("nz")
    )
    sums = corners.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("nx", "ny", "nz")])
    norm = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return sums.select("id", *[F.when(norm > 0, F.col(c) / norm).otherwise(0.0).alias(c) for c in ("nx", "ny", "nz")])
