"""Readers: frame files, images, GPS tracks, JSON metadata, logs, model files, meshes and points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark import schemas
from waymark.functions import scalars
from waymark.functions.sharpness import image_sharpness
from waymark.session import cut, small

FRAME_GLOB = "frame_*.jpg"
ANY_IMAGE_GLOB = "*.{jpg,jpeg,png}"


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length below root; contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        .load(root).select("path", "modificationTime", "length")
    )


def frames(spark: SparkSession, root: str, glob: str = FRAME_GLOB, source_fps: float = 1.0) -> DataFrame:
    """Catalogue of frame files; the video is the `video_id=` folder, or else the parent folder."""
    return files(spark, root, glob).select(*_frame_columns(F.col("path"), source_fps), "length")


def _frame_columns(path: Column, source_fps: float) -> list[Column]:
    tagged, number = F.regexp_extract(path, r"video_id=([^/]+)/", 1), scalars.frame_no(path)
    return [
        F.when(tagged != "", tagged).otherwise(scalars.parent_name(path)).alias("video_id"), path.alias("path"),
        scalars.file_name(path).alias("file_name"), number.alias("frame_no"), scalars.frame_time(number, source_fps).alias("t_sec"),
    ]


def pixels(spark: SparkSession, root: str, glob: str = FRAME_GLOB) -> DataFrame:
    """path and decoded image; undecodable files stay, with height -1."""
    return (
        spark.read.format("image").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("dropInvalid", "false")
        .load(root).select(F.col("image.origin").alias("path"), "image")
    )


def scored_frames(spark: SparkSession, root: str, glob: str = FRAME_GLOB, source_fps: float = 1.0) -> DataFrame:
    """The catalogue with sharpness and decoded, from one read of each image; undecodable files stay and score 0. Pixels never leave
    the task that reads them."""
    raw = (
        spark.read.format("image").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("dropInvalid", "false")
        .load(root).select("image", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"))
    )
    return raw.select(
        *_frame_columns(F.col("path"), source_fps), "length",
        image_sharpness("image").alias("sharpness"), (F.col("image.height") > 0).alias("decoded"),
    )


def gps_track(spark: SparkSession, path: str) -> DataFrame:
    """CSV of GPS tags to fixes; values that do not parse become null."""
    rows = spark.read.csv(path, header=True, schema=schemas.GPS_CSV, escape='"')
    stamp = F.regexp_replace("GPSDateTime", r"Z$", "")
    return rows.select(
        scalars.stem(F.col("SourceFile")).alias("video_id"),
        F.coalesce(
            F.try_to_timestamp(stamp, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(stamp, F.lit("yyyy:MM:dd HH:mm:ss.SSS"))
        ).alias("ts"),
        scalars.gps_degrees(F.col("GPSLatitude")).alias("lat"),
        scalars.gps_degrees(F.col("GPSLongitude")).alias("lon"),
        scalars.gps_altitude(F.col("GPSAltitude")).alias("alt"),
    )


def has_gps(fixes: DataFrame) -> DataFrame:
    """Per video, whether any fix has both coordinates."""
    return fixes.groupBy("video_id").agg((F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()) > 0).alias("has_gps"))


def exif_json(spark: SparkSession, path: str) -> DataFrame:
    """First object of each JSON file as a variant; a file that is not JSON gives null."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.try_variant_get(F.try_parse_json("value"), "$[0]", "variant").alias("exif"))


def log_lines(lines: DataFrame) -> DataFrame:
    """Parse run_id, line_no, value rows of `time - logger - level - message`; other lines keep only their message."""
    shape = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) - (.+?) - ([A-Z]+) - (.*)$"
    part = lambda i: F.when(F.col("value").rlike(shape), F.regexp_extract("value", shape, i))
    return lines.select(
        "run_id", "line_no", F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd HH:mm:ss,SSS")).alias("ts"),
        part(2).alias("logger"), part(3).alias("level"), F.coalesce(part(4), F.col("value")).alias("message"),
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 1) and value of every line of text files. A file may be read in many splits: a line's number is its place
    in its split and the counts of the splits before; splits are told by where they begin, and a task reads each from its start."""
    number = F.monotonically_increasing_id()  # in a task's order of reading, so consecutive within a split
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"))
    lines = read.withColumn("_n", number)
    each = lines.groupBy("path", "_start").agg(F.min("_n").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("path").orderBy("_start")) - F.col("_rows")
    splits = cut(each.select("path", "_start", (before - F.col("_first") + 1).alias("_shift")))
    return lines.join(small(splits, 200), ["path", "_start"]).select("path", (F.col("_n") + F.col("_shift")).alias("line_no"), "value")


def read_log(spark: SparkSession, path: str, run_id: int = 0) -> DataFrame:
    """Log files with the number of each line in its file; large files are read in splits."""
    rows = numbered_lines(spark, path)
    return log_lines(rows.select(F.lit(run_id).cast("bigint").alias("run_id"), "line_no", "value"))


def source_videos(spark: SparkSession, root: str, glob: str = "*.{mp4,MP4,mov,MOV}") -> DataFrame:
    """video_id (the file's name without extension) and path of source files."""
    return files(spark, root, glob).select(scalars.stem(F.col("path")).alias("video_id"), "path")


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Files below `<video>/sparse/<model>/` and `<video>/*.ply`; a file beside the models has model_id null."""
    path = F.col("path")
    model = F.regexp_extract(path, r"/sparse/([^/]+)/[^/]+$", 1)
    return files(spark, root).select(
        F.regexp_extract(path, r"([^/]+)/(?:sparse/[^/]+/)?[^/]+$", 1).alias("video_id"),
        F.when(model != "", model).alias("model_id"), scalars.file_name(path).alias("file_name"), "length",
    )


_KINDS = {"float": "f4", "float32": "f4", "double": "f8", "float64": "f8", "uchar": "u1", "uint8": "u1", "char": "i1", "int8": "i1",
          "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4"}
_ORDERS = {"binary_little_endian": "<", "binary_big_endian": ">"}


class Ply:
    """Header of a binary PLY file, and its elements one after another."""

    def __init__(self, path: str, content: bytes):
        head, _, self.body = content.partition(b"end_header\n")
        lines = [x.split() for x in head.decode("ascii", "replace").splitlines()]
        form = next((x[1] for x in lines if x[:1] == ["format"] and len(x) > 1), "none")
        if form not in _ORDERS:
            raise ValueError(f"{path}: PLY format {form} is not read")
        self.path, self.order, self.elements = path, _ORDERS[form], []
        for x in lines:
            if x[:1] == ["element"]:
                self.elements.append((x[1], int(x[2]), []))
            elif x[:1] == ["property"]:
                self.elements[-1][2].append(x[1:])
        self.name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]

    def kind(self, name: str) -> str:
        return self.order + _KINDS[name]

    def record(self, properties: list, lists: int | None = None) -> np.dtype:
        """An element as one record: without lists, or with lists that all have so many entries."""
        fields = []
        for p in properties:
            if p[0] != "list":
                fields.append((p[-1], self.kind(p[0])))
            elif lists is None:
                raise ValueError(f"{self.path}: lists among {p[-1]} are not read")
            else:
                fields += [("#" + p[-1], self.kind(p[1])), (p[-1], self.kind(p[2]), (lists,))]
        return np.dtype(fields)

    def vertices(self) -> np.ndarray:
        at = 0
        for name, count, properties in self.elements:
            if name == "vertex":
                return np.frombuffer(self.body, self.record(properties), count, at)
            at += count * self.record(properties).itemsize
        return np.zeros(0, np.dtype([]))

    def faces(self) -> tuple[np.ndarray, np.ndarray]:
        """Corners of all faces, one face after another, and the number of corners of each."""
        at = 0
        for name, count, properties in self.elements:
            if name == "face":
                return self._faces(at, count, properties)
            at += count * self.record(properties).itemsize
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _faces(self, at: int, count: int, properties: list) -> tuple[np.ndarray, np.ndarray]:
        corners = next((p[-1] for p in properties if p[0] == "list" and p[-1] in ("vertex_indices", "vertex_index")), None)
        if corners is None:
            raise ValueError(f"{self.path}: faces without vertex_indices")
        if sum(p[0] == "list" for p in properties) == 1:  # meshes of triangles alone are records of one size
            record = self.record(properties, 3)
            if at + count * record.itemsize <= len(self.body):
                rows = np.frombuffer(self.body, record, count, at)
                if (rows["#" + corners] == 3).all():
                    return rows[corners].astype(np.int64).ravel(), np.full(count, 3, np.int64)
        found, sizes = [], np.zeros(count, np.int64)
        for k in range(count):
            for p in properties:
                if p[0] != "list":
                    at += np.dtype(self.kind(p[0])).itemsize
                    continue
                n = int(np.frombuffer(self.body, self.kind(p[1]), 1, at)[0])
                at += np.dtype(self.kind(p[1])).itemsize
                if p[-1] == corners:
                    found.append(np.frombuffer(self.body, self.kind(p[2]), n, at))
                    sizes[k] = n
                at += n * np.dtype(self.kind(p[2])).itemsize
        return np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64), sizes


def fans(corners: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triangles (n, 3) of faces of any number of corners, and the face of each: a polygon is a fan from its first corner; faces
    of less than three corners give none."""
    begin = np.cumsum(sizes) - sizes
    each = np.maximum(sizes - 2, 0)
    face = np.repeat(np.arange(len(sizes)), each)
    step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    first = begin[face]
    return np.column_stack([corners[first], corners[first + step + 1], corners[first + step + 2]]), face


def _ply_files(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").option("recursiveFileLookup", "true").load(root)
    return raw.select("path", "content")


def ply_points(spark: SparkSession, root: str) -> DataFrame:
    """Binary PLY files of either byte order with float or double x, y, z and optional colours; one task a file.

    A file without vertices gives no rows; one in another format, or with lists among its vertices, is an error.
    """
    names = {"r": "red", "g": "green", "b": "blue"}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                ply = Ply(path, content)
                points = ply.vertices()
                if not len(points):
                    continue
                out = pd.DataFrame({"cloud_id": [ply.name] * len(points), "point_id": np.arange(len(points))})
                for c in "xyzrgb":
                    name = names.get(c, c)
                    out[c] = points[name].astype(float) if name in points.dtype.names else np.nan
                yield out

    return _ply_files(spark, root).mapInPandas(read, schemas.POINTS)


def ply_triangles(spark: SparkSession, root: str) -> DataFrame:
    """cloud_id, face_id, a, b, c of binary PLY files: corners are numbers of vertices, from 0, as `ply_points` has them.

    Meshes of triangles are read at once, mixed lists face by face; polygons become fans of triangles with one face_id. A corner
    that is no vertex is an error; a file without faces gives no rows. One task a file, in pieces of 100,000 triangles.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                ply = Ply(path, content)
                triangles, face = fans(*ply.faces())
                points = next((n for name, n, _ in ply.elements if name == "vertex"), 0)
                if len(triangles) and not 0 <= triangles.min() <= triangles.max() < points:
                    raise ValueError(f"{path}: a face has a corner that is no vertex")
                for start in range(0, len(triangles), 100_000):
                    part = triangles[start : start + 100_000]
                    yield pd.DataFrame({"cloud_id": [ply.name] * len(part), "face_id": face[start : start + 100_000], "a": part[:, 0], "b": part[:, 1], "c": part[:, 2]})

    return _ply_files(spark, root).mapInPandas(read, schemas.TRIANGLES)
