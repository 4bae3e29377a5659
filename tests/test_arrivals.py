"""Streams joined within bounds of time, and samples of videos that are complete, however their frames arrive."""

import datetime as dt
import random

import pytest

from waymark.operators.filtering import manifest
from waymark.streaming import streams

FRAMES = "video_id string, frame_no bigint, ts timestamp"
FIXES = "video_id string, ts timestamp, lat double, lon double"


def at(minutes):
    return dt.datetime(2024, 5, 1, 8) + dt.timedelta(minutes=minutes)


class Folder:
    """Two drop folders, joined again and again from where the last run stopped."""

    def __init__(self, spark, tmp_path, how):
        self.spark, self.path, self.how, self.progress = spark, tmp_path, how, []
        for name, kind in (("frames", FRAMES), ("fixes", FIXES)):
            spark.createDataFrame([], kind).write.parquet(str(tmp_path / name))

    def take(self, frames=(), fixes=()):
        for rows, name, kind in ((frames, "frames", FRAMES), (fixes, "fixes", FIXES)):
            if rows:
                self.spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(self.path / name))
        a, b = (self.spark.readStream.schema(k).parquet(str(self.path / n)) for n, k in (("frames", FRAMES), ("fixes", FIXES)))
        joined = streams.gps_join(a, b, "2 minutes", "1 minute", "10 minutes", self.how)
        query = (
            joined.writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "check"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        self.progress.append(query.lastProgress)

    def rows(self):
        return sorted(map(tuple, self.spark.read.parquet(str(self.path / "out")).select("video_id", "frame_no", "lat").collect()), key=str)


def test_bounds_and_late_rows(spark, tmp_path):
    folder = Folder(spark, tmp_path, "inner")
    folder.take([("v", 1, at(10))], [("v", at(8), 1.0, 0.0), ("v", at(11), 2.0, 0.0), ("v", at(7.9), 3.0, 0.0), ("v", at(11.1), 4.0, 0.0), ("w", at(10), 5.0, 0.0)])
    assert folder.rows() == [("v", 1, 1.0), ("v", 1, 2.0)]
    folder.take([("v", 2, at(60))], [("v", at(60), 6.0, 0.0)])  # both watermarks move to minute 50
    folder.take(fixes=[("v", at(10), 7.0, 0.0), ("v", at(59), 8.0, 0.0)])  # the first is too late, the second is not
    assert folder.rows() == [("v", 1, 1.0), ("v", 1, 2.0), ("v", 2, 6.0), ("v", 2, 8.0)]
    folder.take([("x", 3, at(600))], [("x", at(700), 9.0, 0.0)])
    assert folder.progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2  # what nothing can meet any more is gone


def test_frames_without_fix(spark, tmp_path):
    folder = Folder(spark, tmp_path, "leftOuter")
    folder.take([("v", 1, at(10)), ("v", 2, at(20)), (None, 3, at(20))], [("v", at(10), 1.0, 0.0)])
    folder.take([("v", 4, at(200))], [("v", at(200), 2.0, 0.0)])
    folder.take([("v", 5, at(300))], [("v", at(300), 3.0, 0.0)])
    assert set(folder.rows()) >= {(None, 3, None), ("v", 1, 1.0), ("v", 2, None), ("v", 4, 2.0)}


def arrivals(spark, seed=3):
    rng = random.Random(seed)
    rows = [(v, n, f"frame_{n}.jpg", float(n), rng.uniform(0, 40), None) for v in (1, 2, 3) for n in range(1, 30)]
    marks = [(v, None, None, None, None, 29) for v in (1, 2)] + [(3, None, None, None, None, 30)]  # one frame of 3 never comes
    rows += rows[:10]  # files that come twice
    whole = spark.createDataFrame(rows, streams.ARRIVALS)
    rng.shuffle(rows)
    parts = [rows[:30] + marks[:1], rows[30:60] + marks[1:], rows[60:]]
    want = manifest(whole.dropDuplicates().filter("video_id < 3").drop("frame_count"), 20.0, 1.0, 0.3)
    return [spark.createDataFrame(p, streams.ARRIVALS) for p in parts], sorted(map(tuple, want.collect()))


def got(spark, job):
    columns = ("video_id", "src_path", "src_frame_no", "t_sec", "sharpness", "seq_no", "out_name")
    return sorted(map(tuple, job.samples(spark).select(*columns).collect()))


def test_completed_samples(spark, tmp_path):
    parts, want = arrivals(spark)
    job = streams.CompletedSamples(str(tmp_path), 20.0, 1.0, 0.3)
    for k, part in enumerate(parts):
        job.batch(part, k)
        assert all(r[0] != 3 for r in got(spark, job))
    assert got(spark, job) == want


@pytest.mark.parametrize("crash", ["arrived", "done", "sampled"])
def test_replayed_batch(spark, tmp_path, crash):
    """A batch that ran whole, or stopped after a folder, gives the same when it runs again; so do the batches after it."""
    parts, want = arrivals(spark)
    job = streams.CompletedSamples(str(tmp_path), 20.0, 1.0, 0.3)
    for k, part in enumerate(parts):
        job.batch(part, k)
        for name in ("sampled", "done", "arrived"):
            if name == crash:
                break
            folder = tmp_path / name / f"batch={k}"
            folder.rename(tmp_path / f"lost-{name}-{k}")
        job.batch(part, k)
    assert got(spark, job) == want
    for k, part in enumerate(parts):
        job.batch(part, k)
    assert got(spark, job) == want


def test_as_a_stream(spark, tmp_path):
    parts, want = arrivals(spark)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "drop"))
    job = streams.CompletedSamples(str(tmp_path / "job"), 20.0, 1.0, 0.3)
    arriving = spark.readStream.schema(streams.ARRIVALS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "drop"))
    job.run(arriving)
    assert got(spark, job) == want
