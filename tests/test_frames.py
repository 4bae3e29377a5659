"""Unit tests of the frame operators on small hand-made tables."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.functions import scalars
from waymark.functions.sharpness import _variance, array_sharpness, image_sharpness
from waymark.operators import filtering, geo, logs, matching, models, points, summary
from waymark import schemas
from waymark.plans import stages
from waymark.schemas import Params
from waymark.sources import catalogue, sinks
from waymark.streaming import streams

SCORES = "video_id string, path string, frame_no bigint, t_sec double, sharpness double"


def frames(spark, values, video="v"):
    return spark.createDataFrame([(video, f"frame_{i:07d}.jpg", i, i - 1.0, v) for i, v in enumerate(values, 1)], SCORES)


def test_blur_keeps_threshold_and_drops_nan(spark):
    out = filtering.blur_filter(frames(spark, [100.0, 99.9, math.nan, None, 200.0]))
    assert sorted(r.frame_no for r in out.collect()) == [1, 5]


@pytest.mark.parametrize("fps, want", [(5, [1, 2, 3, 4, 5, 6]), (1, [1, 2, 3, 4, 5, 6]), (0.5, [1, 3, 5]), (0.3, [1, 5])])
def test_sampling_rates(spark, fps, want):
    out = filtering.temporal_sample(frames(spark, [1.0] * 6), 1.0, fps)
    assert sorted(r.frame_no for r in out.collect()) == want


def test_sampling_counts_survivors_and_keeps_time(spark):
    out = filtering.manifest(frames(spark, [200.0, 1.0, 200.0, 1.0, 200.0]), 100.0, 1.0, 0.5).orderBy("seq_no").collect()
    assert [(r.src_frame_no, r.t_sec, r.seq_no, r.out_name) for r in out] == [
        (1, 0.0, 1, "frame_0000001.jpg"), (5, 4.0, 2, "frame_0000002.jpg"),
    ]


def test_bad_rates():
    for fps in (0, -1):
        with pytest.raises(ValueError):
            filtering.sampling_step(1.0, fps)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.floats(0.01, 0.999))
def test_closed_form_is_the_greedy_choice(n, fps):
    last, want = -1 / fps, []
    for i in range(n):
        if i - last >= 1 / fps:
            want.append(i)
            last = i
    assert [i for i in range(n) if i % filtering.sampling_step(1.0, fps) == 0] == want


def test_second_video_changes_nothing(spark):
    one = frames(spark, [150.0, 90.0, 120.0, 130.0])
    both = one.unionByName(frames(spark, [500.0] * 3, "w"))
    run = lambda df: sorted(map(tuple, filtering.manifest(df, 100.0, 1.0, 0.5).filter("video_id = 'v'").collect()))
    assert run(one) == run(both.orderBy(F.rand(3)))


def test_funnel_and_stats(spark):
    scores = frames(spark, [1.0, 2.0]).unionByName(frames(spark, [100.0, 300.0], "w"))
    videos = spark.createDataFrame([("v",), ("w",), ("x",)], "video_id string")
    out = {r.video_id: r for r in summary.filter_funnel(scores, filtering.manifest(scores), videos=videos).collect()}
    assert [(out[v].original_count, out[v].after_blur_filter, out[v].final_count) for v in "vwx"] == [(2, 0, 0), (2, 2, 2), (0, 0, 0)]
    assert out["v"].filtered_files == [] and out["w"].filtered_files == ["frame_0000001.jpg", "frame_0000002.jpg"]
    stats = {r.video_id: r for r in summary.quality_stats(scores, videos=videos).collect()}
    assert stats["w"].std_sharpness == 100.0 and stats["w"].frames_above_threshold == 2 and stats["w"].error is None
    assert stats["x"].error and stats["x"].total_frames is None


def test_scalars(spark):
    rows = [("/a/v/frame_0000007.jpg",), ("frame_x.jpg",), ("plain.jpg",), ("frame_ 7 .jpg",)]
    df = spark.createDataFrame(rows, "p string")
    assert [r[0] for r in df.select(scalars.frame_no(F.col("p"))).collect()] == [7, 0, 0, 7]
    with pytest.raises(Exception, match="not a frame name"):
        df.select(scalars.frame_no_strict(F.col("p"))).collect()
    gps = spark.createDataFrame([("37 deg 46' 30.00\" S",), ("12.5",), ("bad",), (None,)], "s string")
    assert [r[0] for r in gps.select(scalars.gps_degrees(F.col("s"))).collect()] == [-37.775, 12.5, None, None]
    one = spark.range(1)
    assert one.select(scalars.size_mb(F.lit(int(0.125 * 1048576))), scalars.image_estimate(F.lit(250))).first() == (0.12, 2)
    assert one.select(scalars.parent_name(F.lit("/a/b/c.d")), scalars.sibling(F.lit("/a/b/c.d"), "e"), scalars.sibling(F.lit("c"), "e")).first() == ("b", "/a/b/e", "e")


def jpeg(spark, path, value):
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(16, 16, 5)
    for x in range(16):
        for y in range(16):
            grey = value(x, y) & 255
            image.setRGB(x, y, grey << 16 | grey << 8 | grey)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))


def test_images(spark, tmp_path):
    folder = tmp_path / "video_id=v"
    folder.mkdir()
    jpeg(spark, folder / "frame_0000001.jpg", lambda x, y: (x * 7919 + y * 104729) * 31 % 251)
    jpeg(spark, folder / "frame_0000002.jpg", lambda x, y: x * 8)
    (folder / "frame_0000003.jpg").write_bytes(b"no image")
    listed = catalogue.frames(spark, str(tmp_path))
    assert sorted((r.video_id, r.frame_no, r.t_sec) for r in listed.collect()) == [("v", 1, 0.0), ("v", 2, 1.0), ("v", 3, 2.0)]
    got = {r.path[-5]: r for r in filtering.score_images(catalogue.pixels(spark, str(tmp_path))).collect()}
    assert got["1"].sharpness > 1000 > got["2"].sharpness and got["3"].sharpness == 0.0 and not got["3"].decoded


def test_sharpness_forms_agree(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (5, 8, 8)).astype(float)
    df = spark.createDataFrame([(i, g.ravel().tolist()) for i, g in enumerate(grey)], "i int, e array<double>")
    for i, value in df.select("i", array_sharpness(F.col("e"), 8)).collect():
        assert value == pytest.approx(_variance(grey[i]))
    assert image_sharpness is not None and _variance(np.ones((1, 1))) == 0.0


def test_guards(spark):
    videos = spark.createDataFrame([("v",), ("w",)], "video_id string")
    assert [r[0] for r in filtering.without(videos, frames(spark, [1.0])).collect()] == ["w"]
    with pytest.raises(ValueError):
        filtering.require_frames(frames(spark, [1.0]).filter("false"))
    found = spark.createDataFrame([("v", "0", "images.bin", 500)], "video_id string, model_id string, file_name string, length bigint")
    with pytest.raises(RuntimeError, match="w"):
        filtering.require_models(videos, found)


def test_models(spark, tmp_path):
    for name, size in (("v/sparse/0/images.bin", 90), ("v/sparse/1/images.bin", 900), ("v/sparse/2/cameras.bin", 9), ("v/model.ply", 1048576), ("w/sparse/0/points3D.bin", 3), ("w/sparse/1/images.bin", 99)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    found = catalogue.artifacts(spark, str(tmp_path))
    assert {r.video_id: (r.model_id, r.n_images) for r in models.best_model(found).collect()} == {"v": ("1", 9), "w": ("0", 0)}
    audit = {(r.video_id, r.model_id): r for r in models.audit(found).collect()}
    assert audit["v", "1"].images and audit["v", "1"].ply_size_mb == 1.0 and not audit["v", "2"].images
    assert audit["w", "0"].points3D and not audit["w", "0"].ply and audit["w", "0"].ply_size_mb is None
    fixes = spark.createDataFrame([("v", 1.0, 2.0)], "video_id string, lat double, lon double")
    scores = frames(spark, [150.0, 90.0]).unionByName(frames(spark, [150.0], "x"))
    out = stages.run_all(scores, found, fixes, Params()).collect()
    assert [r.video_id for r in out] == ["v"] and out[0].result.stages.filter.final_count == 1 and out[0].result.stages.demux.gps_csv == "v/gps.csv"
    assert out[0].result.source_video is None and out[0].result.final_outputs.model_path == "v/sparse/1"
    videos = spark.createDataFrame([("v", "in/v.mp4")], "video_id string, path string")
    got = stages.run_all(scores, found, fixes, Params(), videos).first().result
    assert got.source_video == got.stages.demux.source_video == "in/v.mp4" and got.stages.demux.frame_dir == "v/frames"
    assert (got.stages.filter.input_dir, got.stages.filter.output_dir) == ("v/frames", "v/frames_filtered")
    sfm = got.stages.sfm
    assert (sfm.workspace, sfm.ply_path, sfm.frames_path, sfm.gps_csv_path) == ("v/sparse", "v/model.ply", "v/frames_filtered", "v/gps.csv")
    assert sfm.files_exist.images and sfm.files_exist.ply and not sfm.files_exist.cameras and sfm.ply_size_mb == 1.0
    _, funnel = stages.filter_stage(scores)
    sinks.write_metadata(funnel, str(tmp_path / "filter"))
    sinks.write_metadata(stages.sfm_stage(found), str(tmp_path / "sfm"))
    keys = {f.name for f in schemas.FILTER_METADATA}
    assert keys <= set(spark.read.json(str(tmp_path / "filter")).columns) and spark.read.json(str(tmp_path / "sfm")).count() == 2
    with pytest.raises(ValueError):
        stages.run_stage("other")


def test_logs(spark, tmp_path):
    lines = ["2025-05-30 10:00:00,000 - p - INFO - Starting full pipeline for a", "2025-05-30 10:00:01,250 - p - INFO - done", "free text", "2025-05-30 10:00:09,000 - p - ERROR - Starting full pipeline for b"]
    (tmp_path / "p.log").write_text("\n".join(lines) + "\n")
    rows = catalogue.read_log(spark, str(tmp_path / "p.log"))
    got = {r.line_no: r for r in logs.job_status(rows).collect()}
    assert [got[i].job for i in (1, 2, 3, 4)] == [1, 1, 1, 2] and got[2].seconds == 1.25 and got[3].ts is None and got[3].message == "free text"
    assert sorted(r.line_no for r in logs.tail(rows, 2).collect()) == [3, 4]


def test_json_gps_and_sinks(spark, tmp_path):
    (tmp_path / "e.json").write_text('[{"SourceFile": "a.mp4", "Odd": [1]}]')
    exif = catalogue.exif_json(spark, str(tmp_path / "e.json"))
    assert exif.select(F.try_variant_get("exif", "$.SourceFile", "string")).first()[0] == "a.mp4"
    (tmp_path / "gps.csv").write_text("SourceFile,GPSDateTime,GPSLatitude,GPSLongitude,GPSAltitude\nx/a.mp4,2025:05:30 10:00:00Z,\"1 deg 30' 0.00\"\" N\",\"2 deg 0' 0.00\"\" W\",5 m Below Sea Level\nx/b.mp4,,bad,,\n")
    fixes = catalogue.gps_track(spark, str(tmp_path / "gps.csv")).collect()
    assert (fixes[0].video_id, fixes[0].ts, fixes[0].lat, fixes[0].lon, fixes[0].alt) == ("a", dt.datetime(2025, 5, 30, 10), 1.5, -2.0, -5.0)
    assert fixes[1].lat is None
    got = {r.video_id: r.has_gps for r in catalogue.has_gps(catalogue.gps_track(spark, str(tmp_path / "gps.csv"))).collect()}
    assert got == {"a": True, "b": False}
    for n in (3, 1):
        sinks.write_manifest(filtering.manifest(frames(spark, [200.0] * n)), str(tmp_path / "m"))
        sinks.write_metadata(summary.frame_count(frames(spark, [1.0] * n)), str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1 and spark.read.json(str(tmp_path / "j")).first().frame_count == 1


def test_ply_and_points(spark, tmp_path):
    import numpy as np

    kind = [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")]
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 2\n" + "".join(f"property {'float' if len(n) == 1 else 'uchar'} {n}\n" for n, _ in kind) + "end_header\n"
    (tmp_path / "c.ply").write_bytes(head.encode() + np.array([(1, 2, 3, 255, 0, 51), (4, 5, 6, 0, 0, 0)], kind).tobytes())
    cloud = catalogue.ply_points(spark, str(tmp_path))
    out = sorted(map(tuple, points.normalise_colours(cloud).select("point_id", "x", "r", "b").collect()))
    assert out == [(0, 1.0, 1.0, 0.2), (1, 4.0, 0.0, 0.0)]
    (tmp_path / "odd").mkdir()
    big = np.array([(7, 8, 9, 1, 2, 3)], [(n, k.replace("<", ">")) for n, k in kind]).tobytes()
    (tmp_path / "odd" / "b.ply").write_bytes(head.replace("little", "big").replace("vertex 2", "vertex 1").encode() + big)
    (tmp_path / "odd" / "none.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nend_header\n")
    assert [tuple(r) for r in catalogue.ply_points(spark, str(tmp_path / "odd")).select("cloud_id", "x", "z").collect()] == [("b", 7.0, 9.0)]
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "a.ply").write_bytes(head.replace("binary_little_endian", "ascii").encode())
    with pytest.raises(Exception, match="ascii"):
        catalogue.ply_points(spark, str(tmp_path / "text")).collect()
    small = spark.createDataFrame([("c", 0.5, 0.2, 1.0, 9.0)], "cloud_id string, r double, g double, b double, a double")
    assert tuple(points.normalise_colours(small).first()) == ("c", 0.5, 0.2, 1.0)
    sinks.write_points(cloud, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_mesh(spark):
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 1.0, 1.0, 0.0)], "id bigint, x double, y double, z double")
    triangles = spark.createDataFrame([(0, 1, 2), (2, 1, 3)], "a bigint, b bigint, c bigint")
    assert points.mesh_edges(triangles).count() == 5 and points.mesh_vertices(vertices).columns == ["x", "y", "z"]
    assert {tuple(r)[1:] for r in points.vertex_normals(vertices, triangles).collect()} == {(0.0, 0.0, 1.0)}


def test_pairs(spark):
    seq = spark.createDataFrame([("v", i) for i in range(1, 8)], "video_id string, seq_no bigint")
    got = {(r.seq_a, r.seq_b) for r in matching.sequential_pairs(seq, 3).collect()}
    assert got == {(a, b) for a in range(1, 8) for b in range(a + 1, min(a + 3, 7) + 1)}
    assert matching.exhaustive_pairs(seq).count() == 21
    desc = spark.createDataFrame([("a", 1, [0.0, 0.0]), ("b", 2, [0.0, 1.0]), ("b", 3, [5.0, 0.0]), ("c", 4, [1.0, 1.0])], "image string, desc_id bigint, vec array<double>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "image_a string, image_b string")
    assert [(r.desc_a, r.desc_b, r.dist) for r in matching.ratio_match(pairs, desc).collect()] == [(1, 2, 1.0)]


def test_geo(spark):
    import numpy as np

    x, y, z = geo.ecef(F.lit(0.0), F.lit(0.0), F.lit(10.0))
    assert spark.range(1).select(x, y, z).first() == (6378147.0, 0.0, 0.0)
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    src = rng.normal(size=(20, 3))
    dst = 2.5 * src @ turn.T + [1, 2, 3]
    pairs = spark.createDataFrame([("v", *map(float, (*s, *t))) for s, t in zip(src, dst, strict=True)], "video_id string, x double, y double, z double, u double, v double, w double")
    fit = geo.similarity_fit(pairs)
    row = fit.first()
    assert row.scale == pytest.approx(2.5) and row.shift == pytest.approx([1, 2, 3]) and np.allclose(np.reshape(row.rotation, (3, 3)), turn)
    fitted = geo.apply_fit(pairs, fit).select("video_id", F.col("fu").alias("x"), F.col("fv").alias("y"), F.col("fw").alias("z"), "u", "v", "w")
    gate = geo.residual_gate(fitted).first()
    assert gate.within and gate.rms_residual < 1e-6


def test_alignment(spark):
    at = lambda s: dt.datetime(2025, 1, 1, 0, 0, s)
    shots = spark.createDataFrame([("v", 1, at(0)), ("v", 2, at(3)), ("v", 3, at(10))], "video_id string, frame_no bigint, ts timestamp")
    fixes = spark.createDataFrame([("v", at(2), 0.0, 0.0), ("v", at(6), 4.0, 8.0)], "video_id string, ts timestamp, lat double, lon double")
    got = {r.frame_no: r.lat for r in geo.align(shots, fixes).collect()}
    assert got == {1: None, 2: 0.0, 3: 4.0}
    assert {r.frame_no: r.lon for r in geo.align(shots, fixes, True).collect()} == {1: None, 2: 2.0, 3: 8.0}
    assert geo.polyline(fixes).first().polyline == [[0.0, 0.0], [8.0, 4.0]]


def test_store_tiles_and_manifest(spark):
    cols = "cloud_id string, checksum string, x double, y double, z double"
    store = spark.createDataFrame([("c", "1", 0.0, 0.0, 0.0)], cols)
    new = spark.createDataFrame([("c", "1", 0.0, 0.0, 0.0), ("c", "2", 11.0, 0.0, 1.0), ("c", "2", 11.0, 0.0, 1.0)], cols)
    fresh = geo.merge_points(store, new)
    assert [r.checksum for r in fresh.collect()] == ["2"]
    old = geo.tiles(store, 10.0)
    whole = store.unionByName(fresh.select(*store.columns))
    touched = geo.tiles(fresh, 10.0)
    assert sorted(map(tuple, geo.retile(old, whole, touched, 10.0).collect())) == sorted(map(tuple, geo.tiles(whole, 10.0).collect()))
    pages = spark.createDataFrame([("a", "old", 1), ("b", "only", 1)], "path string, title string, updated int")
    later = spark.createDataFrame([("a", "new", 2)], pages.schema)
    assert sorted((r.path, r.title) for r in geo.site_manifest(pages, later).collect()) == [("a", "new"), ("b", "only")]


def test_streams(spark, tmp_path):
    rows = frames(spark, [200.0, 1.0, 200.0, 200.0, 200.0])
    rows.coalesce(1).write.parquet(str(tmp_path / "s"))
    arriving = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))
    got = streams.drain(streams.temporal_sample(streams.blur_filter(arriving), 1.0, 0.5), "t_sample")
    want = filtering.temporal_sample(filtering.blur_filter(rows), 1.0, 0.5)
    assert sorted(r.frame_no for r in got.collect()) == sorted(r.frame_no for r in want.collect()) == [1, 4]
    (tmp_path / "drop").mkdir()
    for name in ("a.mp4", "b.mov", "c.txt"):
        (tmp_path / "drop" / name).write_bytes(b"x")
    assert sorted(r.path[-5:] for r in streams.drain(streams.watch_folder(spark, str(tmp_path / "drop")), "t_jobs").collect()) == ["a.mp4", "b.mov"]
    assert streams.drain(streams.watch_folder(spark, str(tmp_path / "drop"), since="2999-01-01"), "t_none").count() == 0
