"""Places in an order where one key has half of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import filtering, geo, summary
from waymark.operators.ordering import dealt, positions

KIND = "video_id string, frame_no bigint, path string, t_sec double, sharpness double, n int"


def rows(seed=1):
    rng = random.Random(seed)
    out = [("hot", k, f"p{k}", float(k), rng.uniform(0, 200), 1) for k in range(4000)]
    out += [(f"v{k % 400}", k, f"p{k}", float(k), rng.uniform(0, 200), 1) for k in range(3000)]
    out += [("same", 0, "p", 0.0, 150.0, 1)] * 1000 + [(None, None, None, None, None, 1), (None, 3, "a", 1.0, 120.0, 1)]
    rng.shuffle(out)
    return out


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_task_with_more_than_a_slot(spark, many_ranges):
    df = spark.createDataFrame(rows(), KIND)
    sizes = [r["count"] for r in dealt(df, "video_id", filtering.FRAME_ORDER).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 8002 and max(sizes) < 2 * 8002 / 16  # the hot video has half of all rows, one frame an eighth


def test_positions(spark, many_ranges):
    data = rows()
    got = {}
    for r in positions(spark.createDataFrame(data, KIND), "video_id", filtering.FRAME_ORDER, "at").collect():
        got.setdefault(r.video_id, []).append((r["at"], r.frame_no, r.path))
    for video, found in got.items():
        mine = sorted(((f is not None, f or 0, p or "") for v, f, p, *_ in data if v == video))
        assert [x[0] for x in sorted(found)] == list(range(len(mine)))
        assert [(f is not None, f or 0, p or "") for _, f, p in sorted(found)] == mine


@pytest.mark.parametrize("fps", [5.0, 1.0, 0.5, 0.3])
def test_manifest_is_sampling_and_renumbering(spark, many_ranges, fps):
    df = spark.createDataFrame(rows(), KIND)
    sharp = filtering.blur_filter(df, 100.0)
    two = filtering.renumber(filtering.temporal_sample(sharp, 1.0, fps))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, filtering.manifest(df, 100.0, 1.0, fps).collect())) == sorted(map(key, two.collect()))


def test_no_rows(spark):
    assert positions(spark.createDataFrame([], KIND), "video_id", ["frame_no"], "at").count() == 0


def test_tracks_in_chunks(spark, many_ranges):
    rng = random.Random(2)
    fixes = [("hot", k, float(k), 1.0) for k in range(2500)] + [("v", k, float(-k), 2.0) for k in range(30)]
    rng.shuffle(fixes)
    df = spark.createDataFrame(fixes, "video_id string, ts bigint, lon double, lat double")
    rows = {(r.video_id, r.chunk): r.polyline for r in geo.polyline_chunks(df, 100).collect()}
    assert len(rows) == 26 and max(map(len, rows.values())) == 100
    assert [p for k in range(25) for p in rows["hot", k]] == [[float(k), 1.0] for k in range(2500)] and len(rows["v", 0]) == 30
    whole = {r.video_id: r.polyline for r in geo.polyline(df, 2500).collect()}
    assert whole["v"] == rows["v", 0] and len(whole["hot"]) == 2500
    with pytest.raises(ValueError, match="polyline_chunks"):
        geo.polyline(df, 2499)


def test_names_in_chunks(spark):
    df = spark.createDataFrame([("a", k, f"p{k}", float(k), 150.0, 1) for k in range(25)] + [("b", 0, "p", 0.0, 1.0, 1)], KIND)
    made = filtering.manifest(df)
    rows = {(r.video_id, r.chunk): r.files for r in summary.file_chunks(made, 10).collect()}
    names = [f"frame_{k:07d}.jpg" for k in range(1, 26)]
    assert rows == {("a", 0): names[:10], ("a", 1): names[10:20], ("a", 2): names[20:]}
    for most, want in ((25, names), (24, None)):
        found = {r.video_id: (r.final_count, r.filtered_files) for r in summary.filter_funnel(df, made, most_files=most).collect()}
        assert found == {"a": (25, want), "b": (0, [])}
