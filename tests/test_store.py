"""The fit in columns, the master store of points, and tiles that are kept up to date."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import geo

POINTS = "cloud_id string, point_id bigint, x double, y double, z double"
PAIRS = "video_id string, x double, y double, z double, u double, v double, w double"


def umeyama(src, dst):
    ms, md = src.mean(axis=0), dst.mean(axis=0)
    u, d, vt = np.linalg.svd((dst - md).T @ (src - ms) / len(src))
    s = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
    rot = u @ s @ vt
    scale = (d * np.diag(s)).sum() / ((src - ms) ** 2).sum(axis=1).mean()
    return scale, rot, md - scale * rot @ ms


def test_fit_equals_a_decomposition(spark):
    rng, rows, want = np.random.default_rng(8), [], {}
    for k in range(12):
        src = rng.normal(size=(9, 3)) * 10.0 ** rng.integers(-2, 4)
        turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        if k % 3 and np.linalg.det(turn) < 0:
            turn[:, 0] *= -1  # of the others some are mirrored: the best rotation is asked for
        dst = 2.5 * src @ turn.T + rng.normal(size=3) * 100 + rng.normal(size=src.shape) * 0.01 * np.abs(src).max()
        want[f"v{k}"] = umeyama(src, dst)
        rows += [(f"v{k}", *map(float, a), *map(float, b)) for a, b in zip(src, dst, strict=True)]
    rows += [("v0", None, 1.0, 1.0, 1.0, 1.0, 1.0), ("v0", float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0)]
    out = geo.similarity_fit(spark.createDataFrame(rows, PAIRS))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        scale, rot, shift = want[r.video_id]
        assert r.scale == pytest.approx(scale, rel=1e-6) and np.allclose(np.reshape(r.rotation, (3, 3)), rot, atol=1e-6)
        assert np.allclose(r["shift"], shift, rtol=1e-6, atol=1e-4)


def test_fit_without_spread(spark):
    r = geo.similarity_fit(spark.createDataFrame([("one", 1.0, 2.0, 3.0, 4.0, 6.0, 8.0)], PAIRS)).collect()[0]
    assert r.scale == 1.0 and r.rotation == [1, 0, 0, 0, 1, 0, 0, 0, 1] and r["shift"] == [3.0, 4.0, 5.0]
    assert geo.similarity_fit(spark.createDataFrame([], PAIRS)).count() == 0


def cloud(name, first, last):
    return [(name, i, i * 0.5, -i * 0.25, float(i % 7)) for i in range(first, last)]


def test_checksum(spark):
    rows = cloud("a", 0, 40) + cloud("b", 0, 41)
    get = lambda rows: {r.cloud_id: (r.n_points, r.checksum) for r in geo.cloud_checksum(spark.createDataFrame(rows, POINTS)).collect()}
    whole = get(rows)
    assert get(rows[::-1]) == whole and whole["a"][0] == 40 and whole["a"][1] != whole["b"][1]
    first, second = get(rows[:20]), get(rows[20:40])
    assert (first["a"][1] + second["a"][1]) % 2**60 == whole["a"][1]
    assert get([*rows[:39], ("a", 39, 19.5, -9.75, 4.5)])["a"] != whole["a"]
    assert get([("n", 1, None, 1.0, 1.0)])["n"] != get([("n", 1, 0.0, 1.0, 1.0)])["n"]


def test_append_twice(spark, tmp_path):
    place = str(tmp_path / "store")
    points = lambda rows: spark.createDataFrame(rows, POINTS)
    assert geo.append_points(points(cloud("a", 0, 30) + cloud("a", 0, 5) + cloud("b", 0, 10)), place, parts=8) == 40
    assert geo.append_points(points(cloud("a", 0, 30) + cloud("b", 0, 10)), place, parts=8) == 0
    assert geo.append_points(points(cloud("a", 20, 35) + cloud("c", 0, 3) + [("a", 99, 0.0002, 0.0, 0.0)]), place, parts=8) == 8
    assert geo.append_points(points([]), place, parts=8) == 0
    found = spark.read.parquet(place)
    assert sorted(map(tuple, found.select("cloud_id", "point_id").collect())) == sorted([("a", i) for i in range(35)] + [("b", i) for i in range(10)] + [("c", i) for i in range(3)])


def test_tiles_merge_and_retile(spark):
    rows = cloud("a", 0, 200)
    points = spark.createDataFrame(rows, POINTS)
    want = sorted(map(tuple, geo.tiles(points, 10.0).collect()))
    odd = F.col("point_id") % 2 == 1
    both = geo.merge_tiles(geo.tiles(points.filter(odd), 10.0), geo.tiles(points.filter(~odd), 10.0))
    assert sorted(map(tuple, both.select(*geo.tiles(points, 10.0).columns).collect())) == want
    old = geo.tiles(points.filter("point_id < 100"), 10.0)
    touched = points.filter("point_id >= 100").select(*[c.alias(k) for k, c in geo.tile_keys(10.0).items()])
    out = geo.retile(old, points, touched, 10.0)
    assert sorted(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    second = plan[plan.index("LeftAnti"):]
    assert second.index("Aggregate [tile_x", second.index("Aggregate [tile_x")) < second.index("LeftSemi")  # an Aggregate stands above the semi-join


def test_untouched_blocks_stay(spark, tmp_path):
    place = str(tmp_path / "tiles")
    points = spark.createDataFrame(cloud("a", 0, 400), POINTS)
    geo.write_tiles(geo.tiles(points.filter("point_id < 300"), 10.0), place, 4)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(place) for f in names if f.startswith("part-")}
    before = files()
    changed = points.filter("point_id < 20 OR point_id >= 60")  # some points go, some are new
    touched = points.filter("point_id >= 300 OR point_id >= 20 AND point_id < 60").select(*[c.alias(k) for k, c in geo.tile_keys(10.0).items()])
    geo.update_tiles(place, changed, touched, 10.0, 4)
    want = sorted(map(tuple, geo.tiles(changed, 10.0).collect()))
    assert sorted(map(tuple, spark.read.parquet(place).drop("block_x", "block_y").collect())) == want
    keys = {(r[0] // 4, r[1] // 4) for r in touched.collect()}
    kept = {f for f in before if not any(f"/block_x={x}/block_y={y}/" in f for x, y in keys)}
    after = files()
    assert kept and len(kept) < len(before) and all(after.get(f) == before[f] for f in kept)


def test_emptied_block(spark, tmp_path):
    place = str(tmp_path / "tiles")
    points = spark.createDataFrame(cloud("a", 0, 100), POINTS)
    geo.write_tiles(geo.tiles(points, 10.0), place, 1)
    left = points.filter("point_id < 20 OR point_id >= 60")
    touched = points.filter("point_id >= 20 AND point_id < 60").select(*[c.alias(k) for k, c in geo.tile_keys(10.0).items()])
    geo.update_tiles(place, left, touched, 10.0, 1)
    assert sorted(map(tuple, spark.read.parquet(place).drop("block_x", "block_y").collect())) == sorted(map(tuple, geo.tiles(left, 10.0).collect()))
