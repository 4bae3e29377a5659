"""Sharpness: population variance of the 4-neighbour Laplacian, borders mirrored without repeating the edge."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _variance(grey: np.ndarray) -> float:
    if not grey.size:
        return 0.0
    # A side of one pixel has no neighbour to mirror; it then repeats itself.
    rows = np.pad(grey, ((1, 1), (0, 0)), "reflect" if grey.shape[0] > 1 else "edge")
    cols = np.pad(grey, ((0, 0), (1, 1)), "reflect" if grey.shape[1] > 1 else "edge")
    out = rows[:-2] + rows[2:] + cols[:, :-2] + cols[:, 2:] - 4 * grey
    return float(out.var())


@F.pandas_udf(DoubleType())
def image_sharpness(image: pd.DataFrame) -> pd.Series:
    """Over the image source's struct; an image that could not be decoded scores 0."""
    scores = []
    for height, width, channels, data in zip(image["height"], image["width"], image["nChannels"], image["data"], strict=True):
        if data is None or height is None or height <= 0:
            scores.append(0.0)
            continue
        pixels = np.frombuffer(data, np.uint8).reshape(int(height), int(width), int(channels)).astype(np.float64)
        grey = pixels[:, :, 0] if channels < 3 else np.rint(pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299]))
        scores.append(_variance(grey))
    return pd.Series(scores, dtype="float64")


def array_sharpness(pixels: Column, side: int) -> Column:
    """The same over an array of side*side grey values, as built-in functions only, for any side.

    Each cell looks up its four neighbours by their place, so the expression is as long for a large image as for a small one. The
    variance is from one pass of mergeable moments, count, mean and sum of squares about the mean, which does not cancel.
    """
    last = side - 1
    at = lambda i: F.element_at(pixels, (i + 1).cast("int")).cast("double")

    def cell(x: Column, i: Column) -> Column:
        row, col = F.floor(i / side), i % side
        up, down = (i + side, i - side) if side > 1 else (i, i)
        right, left = (i + 1, i - 1) if side > 1 else (i, i)
        above, below = F.when(row == 0, up).otherwise(i - side), F.when(row == last, down).otherwise(i + side)
        before, after = F.when(col == 0, right).otherwise(i - 1), F.when(col == last, left).otherwise(i + 1)
        around = (above, below, before, after) if side > 1 else (i, i, i, i)
        return at(around[0]) + at(around[1]) + at(around[2]) + at(around[3]) - 4 * x.cast("double")

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(acc: Column, x: Column) -> Column:
        n, off = acc["n"] + 1, x - acc["mean"]
        mean = acc["mean"] + off / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["m2"] + off * (x - mean)).alias("m2"))

    moments = F.aggregate(F.transform(pixels, cell), start, step, lambda acc: acc["m2"] / acc["n"])
    return F.when(F.size(pixels) == side * side, moments)
