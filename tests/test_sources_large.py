"""Logs read in splits, faces of meshes, sharpness of images of any size."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions.sharpness import _variance, array_sharpness
from waymark.operators import points
from waymark.sources import catalogue


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbers_over_splits(spark, tmp_path, small_splits):
    rng = np.random.default_rng(2)
    want = []
    for name, count in (("a.log", 400), ("b.log", 3), ("c.log", 150), ("none.log", 0)):
        lines = ["" if k % 7 == 3 else f"2024-05-01 10:00:00,{k:03d} - run - INFO - {name} {k} " + "é" * int(rng.integers(0, 400)) for k in range(count)]
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name != "b.log" and lines else ""), "utf-8")
        want += [(name, k + 1, x) for k, x in enumerate(lines)]
    rows = catalogue.numbered_lines(spark, str(tmp_path))
    assert rows.select(F.spark_partition_id()).distinct().count() > 20
    got = rows.select(F.element_at(F.split("path", "/"), -1), "line_no", "value")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    parsed = catalogue.read_log(spark, str(tmp_path / "a.log"), 5).filter("level IS NOT NULL").orderBy("line_no").collect()
    assert [(r.line_no, r.run_id) for r in parsed] == [(k + 1, 5) for k in range(400) if k % 7 != 3] and parsed[0].ts.year == 2024


def ply(order, faces, extra=False, count_kind="uchar", index_kind="int"):
    e = "<" if order == "binary_little_endian" else ">"
    kinds = {"uchar": "B", "int": "i", "uint": "I", "ushort": "H"}
    vertices = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1)]
    head = f"ply\nformat {order} 1.0\nelement vertex {len(vertices)}\nproperty float x\nproperty float y\nproperty float z\nelement face {len(faces)}\n"
    head += ("property uchar flag\n" if extra else "") + f"property list {count_kind} {index_kind} vertex_indices\nend_header\n"
    body = b"".join(struct.pack(e + "3f", *v) for v in vertices)
    for f in faces:
        body += (struct.pack("B", 7) if extra else b"") + struct.pack(e + kinds[count_kind], len(f)) + struct.pack(f"{e}{len(f)}{kinds[index_kind]}", *f)
    return head.encode() + body


@pytest.mark.parametrize(("order", "extra", "count_kind", "index_kind"), [("binary_little_endian", False, "uchar", "int"), ("binary_big_endian", True, "ushort", "uint")])
def test_faces(spark, tmp_path, order, extra, count_kind, index_kind):
    mesh = [(0, 1, 2), (0, 2, 3), (0, 1, 4)]
    mixed = [(0, 1, 2, 3), (0, 1, 4), (1, 2), (), (4, 3, 2, 1, 0)]
    for name, faces in (("mesh", mesh), ("mixed", mixed), ("none", [])):
        (tmp_path / f"{name}.ply").write_bytes(ply(order, faces, extra, count_kind, index_kind))
    rows = sorted(map(tuple, catalogue.ply_triangles(spark, str(tmp_path)).collect()))
    fans = [("mixed", 0, 0, 1, 2), ("mixed", 0, 0, 2, 3), ("mixed", 1, 0, 1, 4), ("mixed", 4, 4, 1, 0), ("mixed", 4, 4, 2, 1), ("mixed", 4, 4, 3, 2)]
    assert rows == sorted([("mesh", k, *f) for k, f in enumerate(mesh)] + fans)
    triangles = catalogue.ply_triangles(spark, str(tmp_path)).filter("cloud_id = 'mesh'")
    edges = sorted(map(tuple, points.mesh_edges(triangles.select("a", "b", "c")).collect()))
    assert edges == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (1, 4), (2, 3)]
    vertices = catalogue.ply_points(spark, str(tmp_path)).filter("cloud_id = 'mesh'")
    normals = points.vertex_normals(vertices.select(F.col("point_id").alias("id"), "x", "y", "z"), triangles.select("a", "b", "c"))
    assert normals.count() == 5 and vertices.count() == 5


def test_corner_that_is_no_vertex(spark, tmp_path):
    (tmp_path / "bad.ply").write_bytes(ply("binary_little_endian", [(0, 1, 9)]))
    with pytest.raises(Exception, match="no vertex"):
        catalogue.ply_triangles(spark, str(tmp_path)).collect()


@pytest.mark.parametrize(("side", "offset"), [(1, 0), (2, 0), (3, 5), (8, 1e8), (64, 0), (64, 1e8)])
def test_sharpness_of_any_size(spark, side, offset):
    rng = np.random.default_rng(side)
    images = [rng.uniform(0, 2, (side, side)) + offset for _ in range(3)]
    rows = [(k, [float(x) for x in im.ravel()]) for k, im in enumerate(images)] + [(9, [1.0] * (side * side + 1)), (10, None)]
    df = spark.createDataFrame(rows, "id int, pixels array<double>")
    got = {r.id: r.s for r in df.select("id", array_sharpness(F.col("pixels"), side).alias("s")).collect()}
    assert got[9] is None and got[10] is None
    assert [got[k] for k in range(3)] == pytest.approx([_variance(im) for im in images], rel=1e-6)
