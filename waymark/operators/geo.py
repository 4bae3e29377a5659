"""Tracks and places: alignment in time, earth-centred coordinates, fits, tiles, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.ordering import positions
from waymark.session import cut, exists, remove

#: Fixed values of WGS-84.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563


def align(frames: DataFrame, fixes: DataFrame, interpolate: bool = False) -> DataFrame:
    """Each frame with the last fix at or before its ts. frames: video_id, frame_no, ts; fixes: video_id, ts, lat, lon.

    With interpolate, coordinates lie on the line to the next fix where there is one. Fixes come before frames of equal ts.
    """
    fix = F.struct("ts", "lat", "lon")
    both = frames.select("video_id", "ts", "frame_no", F.lit(None).cast("struct<ts:timestamp,lat:double,lon:double>").alias("fix")).unionByName(
        fixes.select("video_id", F.col("ts").cast("timestamp").alias("ts"), "lat", "lon").select(
            "video_id", "ts", F.lit(None).cast("bigint").alias("frame_no"), fix.alias("fix")
        )
    )
    order = Window.partitionBy("video_id").orderBy("ts", F.col("fix").isNull(), "fix", "frame_no")
    rows = both.withColumn("before", F.last("fix", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if interpolate:
        rows = rows.withColumn("after", F.first("fix", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.filter(F.col("fix").isNull())
    lat, lon = F.col("before.lat"), F.col("before.lon")
    if interpolate:
        t = lambda c: F.col(c).cast("double")
        share = (t("ts") - t("before.ts")) / F.nullif(t("after.ts") - t("before.ts"), F.lit(0.0))
        lat = F.coalesce(lat + share * (F.col("after.lat") - lat), lat)
        lon = F.coalesce(lon + share * (F.col("after.lon") - lon), lon)
    return rows.select("video_id", "frame_no", "ts", F.col("before.ts").alias("fix_ts"), lat.alias("lat"), lon.alias("lon"))


def ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    """Degrees and metres to earth-centred x, y, z."""
    e2 = FLATTENING * (2 - FLATTENING)
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(SEMI_MAJOR) / F.sqrt(F.lit(1.0) - F.lit(e2) * F.sin(phi) * F.sin(phi))
    flat = (n + alt) * F.cos(phi)
    return flat * F.cos(lam), flat * F.sin(lam), (n * F.lit(1 - e2) + alt) * F.sin(phi)


#: Squarings of the 4 by 4 matrix: its largest eigenvalue then stands alone, unless two are equal to within rounding.
SQUARINGS = 50


def similarity_fit(pairs: DataFrame) -> DataFrame:
    """Scale, rotation (rows of a 3 by 3) and shift that best take camera centres (x, y, z) to places (u, v, w), per video.

    Sums in Spark give means and cross-covariance. The rotation is that of the unit quaternion that belongs to the largest
    eigenvalue of Horn's symmetric 4 by 4 matrix; the matrix, shifted to have no negative eigenvalue, is squared again and again
    until it is that quaternion's outer product, of which the rotation is a sum of entries. So all is columns, a row a video.
    Without any spread the rotation is none, and the scale 1. Rows with a null or non-finite coordinate take no part.
    """
    src, dst = ("x", "y", "z"), ("u", "v", "w")
    names = (*src, *dst)
    values = [F.col(c).cast("double") for c in names]
    good = pairs.filter(reduce(lambda a, b: a & b, [v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) for v in values]))
    means = [F.avg(c).alias("m" + c) for c in names]
    cross = [F.covar_pop(b, a).alias("c" + b + a) for b in dst for a in src]
    spread = sum((F.var_pop(c) for c in src[1:]), F.var_pop(src[0])).alias("spread")
    sums = good.groupBy("video_id").agg(F.count("*").alias("n"), *means, *cross, spread)
    s = [[F.col("c" + b + a) for b in dst] for a in src]  # source by place
    sxx, sxy, sxz, syx, syy, syz, szx, szy, szz = (x for row in s for x in row)
    horn = [
        sxx + syy + szz, syz - szy, szx - sxz, sxy - syx,
        syz - szy, sxx - syy - szz, sxy + syx, szx + sxz,
        szx - sxz, sxy + syx, syy - sxx - szz, syz + szy,
        sxy - syx, szx + sxz, syz + szy, szz - sxx - syy,
    ]
    size = F.sqrt(F.aggregate("_h", F.lit(0.0), lambda acc, x: acc + x * x))
    upright = F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(16)])
    shifted = F.transform("_h", lambda x, i: x / F.col("_size") + F.when(i % 5 == 0, 1.0).otherwise(0.0))
    cell = lambda m, i, j: F.element_at(m, (4 * i + j + 1).cast("int"))
    product = lambda m, i, j: reduce(lambda a, b: a + b, [cell(m, i, F.lit(k)) * cell(m, F.lit(k), j) for k in range(4)])

    def square(m: Column) -> Column:
        """m times m, divided by its trace, which for a symmetric matrix is the sum of all squares."""
        trace = F.array(F.aggregate(m, F.lit(0.0), lambda acc, x: acc + x * x))
        return F.transform(trace, lambda t: F.transform(m, lambda x, p: product(m, F.floor(p / 4), p % 4) / t))[0]

    rows = sums.withColumn("_h", F.array(*horn)).withColumn("_size", size)
    outer = F.aggregate(F.sequence(F.lit(1), F.lit(SQUARINGS)), shifted, lambda m, _: square(m))
    rows = rows.withColumn("_q", F.when(F.col("_size") > 0, outer).otherwise(upright))
    q = lambda i, j: F.col("_q")[4 * i + j]
    rotation = [
        q(0, 0) + q(1, 1) - q(2, 2) - q(3, 3), 2 * (q(1, 2) - q(0, 3)), 2 * (q(1, 3) + q(0, 2)),
        2 * (q(1, 2) + q(0, 3)), q(0, 0) - q(1, 1) + q(2, 2) - q(3, 3), 2 * (q(2, 3) - q(0, 1)),
        2 * (q(1, 3) - q(0, 2)), 2 * (q(2, 3) + q(0, 1)), q(0, 0) - q(1, 1) - q(2, 2) + q(3, 3),
    ]
    rows = rows.withColumn("rotation", F.array(*rotation))
    r = lambda i, j: F.col("rotation")[3 * i + j]
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    along = total([r(i, j) * F.col("c" + b + a) for i, b in enumerate(dst) for j, a in enumerate(src)])
    rows = rows.withColumn("scale", F.when(F.col("spread") > 0, along / F.col("spread")).otherwise(1.0))
    shift = [F.col("m" + b) - F.col("scale") * total([r(i, j) * F.col("m" + a) for j, a in enumerate(src)]) for i, b in enumerate(dst)]
    return rows.select("video_id", "n", "scale", "rotation", F.array(*shift).alias("shift"))


def apply_fit(pairs: DataFrame, fits: DataFrame) -> DataFrame:
    """pairs with the fitted places fu, fv, fw."""
    row = lambda i: sum((F.col("rotation")[3 * i + j] * F.col(c) for j, c in enumerate("yz", 1)), F.col("rotation")[3 * i] * F.col("x"))
    placed = [(F.col("scale") * row(i) + F.col("shift")[i]).alias(c) for i, c in enumerate(("fu", "fv", "fw"))]
    return pairs.join(fits, "video_id").select(*[pairs[c] for c in pairs.columns], *placed)


def residual_gate(pairs: DataFrame, limit: float = 5.0) -> DataFrame:
    """Distance of (x, y, z) from (u, v, w) a video: largest, root mean square, and whether all lie within the limit."""
    square = sum((F.pow(F.col(a) - F.col(b), 2) for a, b in (("y", "v"), ("z", "w"))), F.pow(F.col("x") - F.col("u"), 2))
    rows = pairs.withColumn("_d2", square)
    return rows.groupBy("video_id").agg(
        F.sqrt(F.max("_d2")).alias("max_residual"), F.sqrt(F.avg("_d2")).alias("rms_residual"),
        (F.max("_d2") <= limit * limit).alias("within"),
    )


def merge_points(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of `incoming` that the store lacks, by cloud and checksum, each once: what an append has to write."""
    key = ["cloud_id", "checksum"]
    return incoming.dropDuplicates(key).join(store.select(*key).distinct(), key, "left_anti")


def point_checksum(*columns: str, digits: int = 3) -> Column:
    """60 bits of a point's content: md5 of its coordinates, rounded to so many decimals, as integers; null coordinates count too."""
    whole = [F.coalesce(F.floor(F.col(c) * 10**digits + 0.5).cast("string"), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(",", *whole)), 1, 15), 16, 10).cast("bigint")


def cloud_checksum(points: DataFrame, coordinates: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """n_points and a checksum of each cloud that does not depend on the order of its points: their sum modulo 2**60, so that
    checksums of parts add up, and a point that stands twice counts twice."""
    total = F.sum(point_checksum(*coordinates).cast("decimal(38,0)")) % F.lit(2**60).cast("decimal(38,0)")
    return points.groupBy("cloud_id").agg(F.count("*").alias("n_points"), total.cast("bigint").alias("checksum"))


STORE_PARTS = 256


def append_points(incoming: DataFrame, path: str, coordinates: tuple[str, ...] = ("x", "y", "z"), parts: int = STORE_PARTS) -> int:
    """Add the points that the master store at `path` lacks, each once, and tell how many: a repeated append adds none.

    Points are the same if cloud and rounded coordinates are. The store is Parquet in at most `parts` folders, by a hash of the
    cloud; only folders of clouds that come in are listed and read, and of these only the clouds themselves. One writer at a time.
    """
    spark = incoming.sparkSession
    part = F.pmod(F.xxhash64("cloud_id"), F.lit(parts)).cast("int")
    fresh = incoming.withColumns({"checksum": point_checksum(*coordinates), "part": part})
    if exists(spark, path):
        touched = [r[0] for r in fresh.select("part").distinct().collect()]  # `parts` numbers at most
        store = spark.read.parquet(path).filter(F.col("part").isin(touched)).select("cloud_id", "checksum")
        store = store.join(fresh.select("cloud_id").distinct(), "cloud_id", "left_semi")
        fresh = merge_points(store, fresh)
    else:
        fresh = fresh.dropDuplicates(["cloud_id", "checksum"])
    fresh = cut(fresh)  # what is written must not depend on the store while it grows
    added = fresh.count()
    if added:
        fresh.repartition("part").write.mode("append").partitionBy("part").parquet(path)
    return added


_TILE = ("tile_x", "tile_y")


def tile_keys(size: float, origin: tuple[float, float] = (0.0, 0.0)) -> dict[str, Column]:
    return {"tile_" + c: F.floor((F.col(c) - F.lit(o)) / F.lit(float(size))).cast("bigint") for c, o in zip("xy", origin, strict=True)}


def _bounds(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy(*_TILE).agg(F.count("*").alias("n_points"), *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def tiles(points: DataFrame, size: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Count and bounds of the points in each square tile."""
    return _bounds(points.withColumns(tile_keys(size, origin)))


def merge_tiles(old: DataFrame, added: DataFrame) -> DataFrame:
    """Tiles of all points from tiles of disjoint parts of them: counts add up, bounds widen; no point is read again."""
    bounds = [f(f"{n}_{c}").alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return old.unionByName(added).groupBy(*_TILE).agg(F.sum("n_points").alias("n_points"), *bounds)


def retile(old: DataFrame, points: DataFrame, touched: DataFrame, size: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Tiles after a change: the touched keys computed anew from their points alone, the others as they were. A touched tile
    that has no points any more is gone."""
    keys = touched.select(*_TILE).distinct()
    fresh = _bounds(points.withColumns(tile_keys(size, origin)).join(keys, list(_TILE), "left_semi"))
    return old.join(keys, list(_TILE), "left_anti").unionByName(fresh)


def _blocks(side: int) -> dict[str, Column]:
    return {"block_" + c: F.floor(F.col("tile_" + c) / side).cast("bigint") for c in "xy"}


def write_tiles(tiled: DataFrame, path: str, side: int = 64) -> None:
    """Tiles as Parquet in a folder for each block of `side` by `side` tiles; blocks that are written replace what was there,
    others are left alone."""
    blocks = tiled.withColumns(_blocks(side)).repartition("block_x", "block_y")
    blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block_x", "block_y").parquet(path)


def update_tiles(path: str, points: DataFrame, touched: DataFrame, size: float, side: int = 64, origin: tuple[float, float] = (0.0, 0.0)) -> None:
    """Bring the tiles at `path` up to date after a change of the touched ones. Only blocks with a touched tile are read and
    written; the folder of a block that has no tile any more is removed."""
    spark = points.sparkSession
    keys = cut(touched.select(*_TILE).distinct())
    blocks = keys.select(*(c.alias(k) for k, c in _blocks(side).items())).distinct()
    old = spark.read.parquet(path)
    here = old.join(F.broadcast(blocks) if keys.count() < 100_000 else blocks, ["block_x", "block_y"], "left_semi")
    fresh = cut(retile(here.drop("block_x", "block_y"), points, keys, size, origin))
    write_tiles(fresh, path, side)
    empty = blocks.join(fresh.withColumns(_blocks(side)), ["block_x", "block_y"], "left_anti")
    for r in empty.collect():  # blocks that lost all their tiles: of those touched, so few
        remove(spark, f"{path}/block_x={r[0]}/block_y={r[1]}")


def polyline_chunks(fixes: DataFrame, size: int = 1000) -> DataFrame:
    """A video's fixes in order of time (ties by lon, then lat), `size` of them to a row: video_id, chunk (from 0), polyline. A track
    may be of any length."""
    placed = positions(fixes.select("video_id", "ts", "lon", "lat"), "video_id", ["ts", "lon", "lat"], "_i")
    points = F.sort_array(F.collect_list(F.struct("_i", "lon", "lat")))
    return placed.groupBy("video_id", F.expr(f"_i div {size}").alias("chunk")).agg(F.transform(points, lambda p: F.array(p["lon"], p["lat"])).alias("polyline"))


def polyline(fixes: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A video's fixes in order of time, in one row. A track of more than `most` fixes is an error: `polyline_chunks` has those."""
    longest = fixes.groupBy("video_id").count().agg(F.max("count")).first()[0] or 0
    if longest > most:
        raise ValueError(f"a track has {longest} fixes, more than {most}: use polyline_chunks")
    points = F.sort_array(F.collect_list(F.struct("ts", "lon", "lat")))
    return fixes.groupBy("video_id").agg(F.transform(points, lambda p: F.array(p["lon"], p["lat"])).alias("polyline"))


def site_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Latest entry of each path over both tables: path, title, updated."""
    order = Window.partitionBy("path").orderBy(F.desc("updated"), F.desc("title"))
    return old.unionByName(new).withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
