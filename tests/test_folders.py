"""A run from files to results, and readers and columns that only it uses."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from waymark import schemas
from waymark.functions import scalars
from waymark.plans import folders
from waymark.sources import catalogue


def jpeg(spark, path, value):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(16, 16, 5)
    for x in range(16):
        for y in range(16):
            grey = value(x, y) & 255
            image.setRGB(x, y, grey << 16 | grey << 8 | grey)
    path.parent.mkdir(parents=True, exist_ok=True)
    jvm.javax.imageio.ImageIO.write(image, path.suffix[1:], jvm.java.io.File(str(path)))


def sharp(x, y):
    return (x * 7919 + y * 104729) * 31 % 251


def flat(x, y):
    return x * 8


@pytest.fixture
def root(spark, tmp_path):
    """a: sharp frames 1, 2, 4 and a blurred 3; b: one blurred frame; c: frames, but no model; d: a model, but no frames."""
    for video, n, how in (("a", 1, sharp), ("a", 2, sharp), ("a", 3, flat), ("a", 4, sharp), ("b", 1, flat), ("c", 1, sharp)):
        jpeg(spark, tmp_path / "frames" / f"video_id={video}" / f"frame_{n:07d}.jpg", how)
    (tmp_path / "frames" / "video_id=a" / "frame_0000005.jpg").write_bytes(b"no image")
    for name, size in (("a/sparse/0/images.bin", 200), ("a/sparse/1/images.bin", 900), ("a/model.ply", 1048576), ("b/sparse/0/images.bin", 300), ("d/sparse/0/images.bin", 300)):
        (tmp_path / "models" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "models" / name).write_bytes(b"x" * size)
    (tmp_path / "videos").mkdir()
    (tmp_path / "videos" / "a.mp4").write_bytes(b"v")
    (tmp_path / "gps.csv").write_text("SourceFile,GPSDateTime,GPSLatitude,GPSLongitude,GPSAltitude\na.mp4,2025:05:30 10:00:00Z,1.5,2.5,9 m\nb.mp4,,bad,,\n")
    return tmp_path


def test_run(spark, root):
    params = schemas.Params(source_fps=1.0, target_fps=0.5)
    args = (spark, str(root / "frames"), str(root / "models"), str(root / "out"), str(root / "gps.csv"), str(root / "videos"), params)
    for _ in range(2):  # a second run replaces the first
        run = folders.run_folders(*args)
        assert {(r.video_id, r.frame_no, r.decoded, r.sharpness > 100) for r in run.scores.collect()} == {
            ("a", 1, True, True), ("a", 2, True, True), ("a", 3, True, False), ("a", 4, True, True), ("a", 5, False, False),
            ("b", 1, True, False), ("c", 1, True, True),
        }
        kept = [(r.video_id, r.src_frame_no, r.t_sec, r.out_name) for r in run.manifest.orderBy("video_id", "seq_no").collect()]
        assert kept == [("a", 1, 0.0, "frame_0000001.jpg"), ("a", 4, 3.0, "frame_0000002.jpg"), ("c", 1, 0.0, "frame_0000001.jpg")]
        out = {r.video_id: r.result for r in run.results.collect()}
        assert set(out) == {"a", "b"}
        a, b = out["a"], out["b"]
        assert (a.status, a.stages.demux.frame_count, a.stages.demux.gps_csv) == ("success", 5, "a/gps.csv") and a.source_video.endswith("videos/a.mp4")
        counts = a.stages.filter
        assert (counts.original_count, counts.after_blur_filter, counts.final_count) == (5, 3, 2)
        assert counts.filtered_files == ["frame_0000001.jpg", "frame_0000002.jpg"]
        assert (a.final_outputs.model_path, a.stages.sfm.n_images, a.stages.sfm.ply_size_mb) == ("a/sparse/1", 9, 1.0)
        assert (b.stages.filter.final_count, b.stages.filter.filtered_files, b.stages.demux.gps_csv, b.source_video) == (0, [], None, None)
        assert {(r.video_id, tuple(r.missing)) for r in run.unfinished.collect()} == {("c", ("sfm",)), ("d", ("demux", "filter"))}
    assert spark.read.json(str(root / "out" / "filter")).count() == 3


def test_no_frames(spark, root):
    with pytest.raises(ValueError, match="no frames"):
        folders.run_folders(spark, str(root / "videos"), str(root / "models"), str(root / "none"))
    assert not (root / "none").exists()


def test_scored_frames_are_the_catalogue(spark, root):
    scored, listed = catalogue.scored_frames(spark, str(root / "frames")), catalogue.frames(spark, str(root / "frames"))
    assert {f.name: f.dataType for f in scored.schema} == {f.name: f.dataType for f in schemas.FRAME_SCORES}
    assert {f.name: f.dataType for f in listed.schema} == {f.name: f.dataType for f in schemas.FRAMES}
    same = [c for c in listed.columns if c != "path"]
    assert sorted(scored.select(same).collect()) == sorted(listed.select(same).collect())


def test_other_images(spark, tmp_path):
    for name in ("v/shot_3.png", "v/frame_0000001.jpg", "w/shot_x.jpg"):
        jpeg(spark, tmp_path / name, sharp)
    (tmp_path / "v" / "notes.txt").write_text("no image")
    found = catalogue.frames(spark, str(tmp_path), catalogue.ANY_IMAGE_GLOB)
    assert {(r.video_id, r.file_name, r.frame_no) for r in found.collect()} == {("v", "shot_3.png", 3), ("v", "frame_0000001.jpg", 1), ("w", "shot_x.jpg", 0)}


def test_video_id_and_time(spark):
    rows = spark.createDataFrame([("in/a.b.mp4", dt.datetime(2025, 5, 30, 10)), ("c", None)], "path string, at timestamp")
    got = [r[0] for r in rows.select(scalars.video_id(F.col("path"), F.col("at"))).collect()]
    assert got == ["a.b_1748599200", "c"]
    stamp = spark.range(1).select(scalars.iso_now()).first()[0]
    assert abs((dt.datetime.now(dt.UTC).replace(tzinfo=None) - dt.datetime.fromisoformat(stamp)).total_seconds()) < 60
