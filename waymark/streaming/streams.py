"""Streams: a drop folder, filters and sampling of arriving frames, repeated files."""

from __future__ import annotations

import heapq
import pickle
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from waymark.functions import scalars
from waymark.operators.filtering import is_sharp, manifest, sampling_step
from waymark.session import cut, exists, shared_dir


def watch_folder(spark: SparkSession, root: str, since: str | None = None, glob: str = "*.{mp4,mov}") -> DataFrame:
    """One job row for each video file; with `since`, files older than that are left alone."""
    kind = "path string, modificationTime timestamp, length bigint, content binary"
    seen = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", glob).load(root)
    jobs = seen.select(
        scalars.video_id(F.col("path"), F.col("modificationTime")).alias("video_id"), "path", "length", "modificationTime"
    )
    return jobs if since is None else jobs.filter(F.col("modificationTime") >= F.lit(since).cast("timestamp"))


def table_stream(spark: SparkSession, folder: str, name: str, schema: StructType, times: int = 1) -> DataFrame:
    """A table of `folder`, one file or a folder of part files, as a stream; `times` > 1 delivers each file that often."""
    # A stream reads folders only, so a single file is picked from its folder by its name.
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    parts = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    read = lambda: spark.readStream.schema(schema)
    one = lambda: read().parquet(f"{folder}/{name}") if parts else read().option("pathGlobFilter", name).parquet(folder)
    out = one()
    for _ in range(times - 1):
        out = out.unionByName(one())
    return out


def blur_filter(scores: DataFrame, threshold: float = 100.0) -> DataFrame:
    return scores.filter(is_sharp(threshold))


def ordered(batches: Iterable[pd.DataFrame], keys: list[str], most: int = 100_000) -> Iterator[pd.DataFrame]:
    """The rows of all batches in the order of `keys`, nulls last, with about `most` rows in memory: more are merged from disk."""
    held: list[pd.DataFrame] = []
    starts: list[int] = []
    piece = max(1, most // 100)
    with tempfile.TemporaryFile() as file:
        for rows in batches:
            held.append(rows)
            if sum(map(len, held)) >= most:
                starts.append(_spill(file, pd.concat(held).sort_values(keys), piece))
                held = []
        if not starts:
            if held:
                yield pd.concat(held).sort_values(keys)
            return
        if held:
            starts.append(_spill(file, pd.concat(held).sort_values(keys), piece))
            columns = held[0].columns
            held = []
        else:
            columns = rows.columns
        at = [columns.get_loc(k) for k in keys]
        merged = heapq.merge(*(_rows(file, a) for a in starts), key=lambda r: [(True, 0) if pd.isna(r[i]) else (False, r[i]) for i in at])
        while part := list(islice(merged, most)):
            yield pd.DataFrame.from_records(part, columns=columns)


def _spill(file: BinaryIO, rows: pd.DataFrame, piece: int) -> int:
    """Write a sorted run behind all others; its place."""
    start = file.seek(0, 2)
    for i in range(0, len(rows), piece):
        pickle.dump(rows.iloc[i : i + piece], file)
    pickle.dump(None, file)
    return start


def _rows(file: BinaryIO, place: int) -> Iterator[tuple]:
    while True:
        file.seek(place)
        rows = pickle.load(file)
        if rows is None:
            return
        place = file.tell()
        yield from rows.itertuples(index=False, name=None)


def temporal_sample(sharp: DataFrame, source_fps: float = 1.0, target_fps: float = 5.0) -> DataFrame:
    """As the batch operator, in order of arrival: a late frame is counted when it comes, and nothing is taken back.

    sharp: video_id, frame_no, path, t_sec, sharpness. The state of a video is one count.
    """
    step = sampling_step(source_fps, target_fps)
    columns = ["video_id", "frame_no", "path", "t_sec", "sharpness"]
    types = dict(sharp.dtypes)

    def sample(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for rows in ordered(batches, ["frame_no", "path"]):
            at = pd.RangeIndex(seen, seen + len(rows))
            seen += len(rows)
            yield rows[at % step == 0][columns]
        state.update((seen,))

    return sharp.select(*columns).groupBy("video_id").applyInPandasWithState(
        sample, ", ".join(f"{c} {types[c]}" for c in columns), "seen bigint", "append", GroupStateTimeout.NoTimeout
    )


def first_arrivals(rows: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """Each key once, however often its file comes within the delay."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now, and give the table it wrote: Parquet in a fresh folder under the shared one."""
    spark = stream.sparkSession
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # A stream that nothing comes to makes no folder.
    spark.createDataFrame([], stream.schema).write.parquet(f"{place}/rows")
    query = (
        stream.writeStream.format("parquet").queryName(name).outputMode("append").option("path", f"{place}/rows")
        .option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def gps_join(frames: DataFrame, fixes: DataFrame, before: str = "10 seconds", after: str = "10 seconds", delay: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Frames with every fix of their video from `before` their ts to `after` it, both ends included.

    frames: video_id, frame_no, ts; fixes: video_id, ts, lat, lon. Rows of either stream may come up to `delay` late; later ones are
    dropped. As both have a watermark and the condition bounds both times, a row is kept only until nothing can meet it any more.
    how="leftOuter" also gives frames without a fix, once that is certain.
    """
    a = frames.select("video_id", "frame_no", "ts").withWatermark("ts", delay).alias("a")
    b = fixes.select(F.col("video_id").alias("fix_video"), F.col("ts").alias("fix_ts"), "lat", "lon").withWatermark("fix_ts", delay).alias("b")
    near = F.expr(f"video_id = fix_video AND fix_ts >= ts - INTERVAL {before} AND fix_ts <= ts + INTERVAL {after}")
    return a.join(b, near, how).drop("fix_video")


#: What a drop folder of a running job holds: frames, and for each finished video a marker with the number of its frames.
ARRIVALS = "video_id bigint, frame_no bigint, path string, t_sec double, sharpness double, frame_count bigint"


class CompletedSamples:
    """Exact samples of videos whose frames come in any order, made when a video is complete.

    A row with frame_count is a video's marker; it is complete when as many different frames have come, before the marker or
    after it. `batch` is for foreachBatch. All that it writes lies in folders named by the batch, and of these it reads none
    that is later, so a batch that runs again, whole or after a crash halfway, leaves the same files. Frames lie in buckets of
    videos, so that a batch reads only the buckets that it touches.
    """

    def __init__(self, place: str, threshold: float = 100.0, source_fps: float = 1.0, target_fps: float = 5.0, buckets: int = 64):
        self.place, self.buckets, self.settings = place, buckets, (threshold, source_fps, target_fps)

    def _until(self, spark: SparkSession, name: str, batch_id: int, schema: StructType) -> DataFrame:
        if not exists(spark, f"{self.place}/{name}"):
            return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
        return spark.read.option("basePath", f"{self.place}/{name}").schema(StructType([*schema.fields, StructField("batch", IntegerType())])).parquet(f"{self.place}/{name}").filter(F.col("batch") <= batch_id)

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        bucket = F.pmod(F.xxhash64("video_id"), F.lit(self.buckets)).cast("int")
        rows = rows.withColumn("bucket", bucket)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.place}/arrived/batch={batch_id}")
        schema = spark.createDataFrame([], ARRIVALS + ", bucket int").schema
        arrived = self._until(spark, "arrived", batch_id, schema)
        now = arrived.filter(F.col("batch") == batch_id)
        buckets = [r[0] for r in now.select("bucket").distinct().collect()]  # self.buckets numbers at most
        touched = now.select("video_id").distinct()
        here = arrived.filter(F.col("bucket").isin(buckets)).join(touched, "video_id", "left_semi")
        frames = here.filter("frame_count IS NULL").dropDuplicates(["video_id", "frame_no", "path"])
        wanted = here.filter("frame_count IS NOT NULL").groupBy("video_id").agg(F.max("frame_count").alias("wanted"))
        there = wanted.join(frames.groupBy("video_id").count(), "video_id", "left")
        complete = there.filter(F.coalesce("count", F.lit(0)) >= F.col("wanted")).select("video_id")
        done_kind = spark.createDataFrame([], "video_id bigint").schema
        done = self._until(spark, "done", batch_id - 1, done_kind).select("video_id")
        complete = cut(complete.join(done, "video_id", "left_anti"))
        complete.write.mode("overwrite").parquet(f"{self.place}/done/batch={batch_id}")
        columns = ["video_id", "path", "frame_no", "t_sec", "sharpness"]
        sample = manifest(frames.join(complete, "video_id", "left_semi").select(columns), *self.settings)
        sample.write.mode("overwrite").parquet(f"{self.place}/sampled/batch={batch_id}")

    def run(self, arriving: DataFrame) -> DataFrame:
        """Take in a stream of ARRIVALS until nothing is left, and give all samples so far."""
        query = (
            arriving.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.place}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return self.samples(arriving.sparkSession)

    def samples(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.place}/sampled").drop("batch")
