"""Image pairs, and descriptor matches across a pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def sequential_pairs(frames: DataFrame, overlap: int = 10) -> DataFrame:
    """Each frame with its next `overlap` frames. Blocks of that many frames keep the join from growing with n² a video."""
    block = F.floor(F.col("seq_no") / overlap)
    a = frames.select("video_id", F.col("seq_no").alias("seq_a"), F.explode(F.array(block, block + 1)).alias("_b"))
    b = frames.select("video_id", F.col("seq_no").alias("seq_b"), block.alias("_b"))
    near = (F.col("seq_b") > F.col("seq_a")) & (F.col("seq_b") <= F.col("seq_a") + overlap)
    return a.join(b, ["video_id", "_b"]).filter(near).select("video_id", "seq_a", "seq_b")


def exhaustive_pairs(frames: DataFrame) -> DataFrame:
    """All pairs of a video: n²/2 of them, so for short videos only."""
    a = frames.select("video_id", F.col("seq_no").alias("seq_a"))
    b = frames.select("video_id", F.col("seq_no").alias("seq_b"))
    return a.join(b, "video_id").filter("seq_a < seq_b")


def _tiles(descriptors: DataFrame, tile: int) -> DataFrame:
    """Descriptors of an image in lists of about `tile`, by desc_id; those with null or non-finite values take no part."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = descriptors.filter(F.col("vec").isNotNull() & ~bad & F.col("image").isNotNull())
    vec = F.col("vec").cast("array<double>")
    rows = good.select("image", "desc_id", vec.alias("vec"), F.size("vec").alias("width"))
    parts = rows.groupBy("image", "width").agg(F.ceil(F.count("*") / tile).alias("parts"))
    dealt = rows.join(parts, ["image", "width"]).withColumn("part", F.pmod(F.xxhash64("desc_id"), F.col("parts")))
    return dealt.groupBy("image", "width", "part").agg(F.sort_array(F.collect_list(F.struct("desc_id", "vec"))).alias("rows"))


def _dense(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors (n, width) of one list of descriptors."""
    ids, vec = column.field("desc_id"), column.field("vec")
    return ids, vec.flatten().to_numpy().reshape(len(ids), -1)


def nearest_two(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a, its two nearest rows of b (-1 if there is none), of ties the first, and their distances.

    |a|² + |b|² - 2ab finds whatever may be among the two within its own rounding; these few are measured again, exactly.
    """
    square_a, square_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    d = square_a[:, None] + square_b - 2 * (a @ b.T)
    k = min(2, len(b)) - 1
    slack = 8 * (a.shape[1] + 4) * np.finfo(float).eps * (square_a + square_b.max())
    row, col = np.nonzero(d <= (np.partition(d, k, axis=1)[:, k] + 2 * slack)[:, None])
    exact = np.empty(len(row))
    for start in range(0, len(row), 65_536):
        part = slice(start, start + 65_536)
        exact[part] = np.sqrt(((a[row[part]] - b[col[part]]) ** 2).sum(axis=1))
    order = np.lexsort((col, exact, row))
    row, col, exact = row[order], col[order], exact[order]
    first = np.searchsorted(row, np.arange(len(a)))
    index, dist = np.full((len(a), 2), -1), np.full((len(a), 2), np.nan)
    for j in range(k + 1):
        index[:, j], dist[:, j] = col[first + j], exact[first + j]
    return index, dist


def ratio_match(pairs: DataFrame, descriptors: DataFrame, ratio: float = 0.8, tile: int = 1024) -> DataFrame:
    """For each descriptor of image a, its nearest in image b if clearly nearer than the second.

    pairs: image_a, image_b; descriptors: image, desc_id, vec. Equal distances go to the smaller desc_id.
    An image b with a single descriptor has no second to compare with, and gives no match. Only vectors of equal width are
    compared; those with null or non-finite values take no part.

    Images are cut into tiles of about `tile` descriptors. A task multiplies a tile of a with a tile of b, two `tile`² products at
    a time, and gives the two nearest of each descriptor there; these are merged over the tiles of b. So there is no row for a
    pair of descriptors, and an image of any size is many tasks' work.
    """
    tiles = _tiles(descriptors, tile)
    a = tiles.select(F.col("image").alias("image_a"), "width", F.col("rows").alias("rows_a"))
    b = tiles.select(F.col("image").alias("image_b"), "width", F.col("rows").alias("rows_b"))
    met = pairs.select("image_a", "image_b").join(a, "image_a").join(b, ["image_b", "width"]).select("image_a", "image_b", "rows_a", "rows_b")
    types = {f.name: f.dataType for f in met.schema.fields}
    desc = descriptors.schema["desc_id"].dataType
    schema = StructType([
        StructField("image_a", types["image_a"]), StructField("image_b", types["image_b"]), StructField("desc_a", desc),
        StructField("dist", DoubleType()), StructField("desc_b", desc), StructField("next_dist", DoubleType()), StructField("next_b", desc),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ids_a, va), (ids_b, vb) = (_dense(batch.column(c).slice(i, 1).flatten()) for c in ("rows_a", "rows_b"))
                index, dist = nearest_two(va, vb)
                pick = [ids_b.take(pa.array(index[:, j], mask=index[:, j] < 0)) for j in (0, 1)]
                same = [pa.repeat(batch.column(c)[i], len(ids_a)) for c in ("image_a", "image_b")]
                near = [pa.array(dist[:, j], mask=index[:, j] < 0) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, ids_a, near[0], pick[0], near[1], pick[1]], schema.names)

    found = met.mapInArrow(run, schema)
    two = F.array(F.struct("dist", F.col("desc_b").alias("id")), F.struct(F.col("next_dist").alias("dist"), F.col("next_b").alias("id")))
    best = found.withColumn("_two", F.filter(two, lambda x: x["dist"].isNotNull())).groupBy("image_a", "image_b", "desc_a").agg(
        F.sort_array(F.flatten(F.collect_list("_two"))).alias("_best")  # two for each tile of b
    )
    first, second = F.get("_best", F.lit(0)), F.get("_best", F.lit(1))
    out = best.select("image_a", "image_b", "desc_a", first["id"].alias("desc_b"), first["dist"].alias("dist"), second["dist"].alias("second"))
    return out.filter(F.col("dist") < ratio * F.col("second"))
