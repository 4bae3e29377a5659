"""Streams over folders of parts, results that do not pass through the driver, samples that are ordered from disk."""

import random

import pandas as pd

from waymark.plans import queries as base
from waymark.streaming import streams


def test_folder_of_parts(spark, tmp_path):
    whole = base.table(spark, "/root/testdata/sf0.001", "events")
    whole.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_sample", "stream_dedup"):
        want = base.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        got = base.QUERIES[name](spark, str(tmp_path))
        assert got.inputFiles() and all("/stream-" in x for x in got.inputFiles())
        assert len(want) > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_ordered():
    rng = random.Random(5)
    rows = pd.DataFrame({"frame_no": [rng.randint(0, 90) for _ in range(500)], "path": [f"p{rng.randint(0, 9)}" for _ in range(500)], "x": range(500)})
    for most in (7, 60, 1000):
        parts = list(streams.ordered((rows.iloc[i : i + 20] for i in range(0, 500, 20)), ["frame_no", "path"], most))
        got = pd.concat(parts)
        want = rows.sort_values(["frame_no", "path"])
        assert got[["frame_no", "path"]].values.tolist() == want[["frame_no", "path"]].values.tolist() and sorted(got.x) == list(range(500))
        assert most > 500 or max(map(len, parts)) <= most
    assert list(streams.ordered([], ["frame_no"])) == []
