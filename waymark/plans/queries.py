"""Registered queries over the driver's tables, each with the SQL that gives the same rows.

The tables stand in for frames: `events` are scored frames (user = video, value = sharpness), `view` rows GPS fixes,
`embeddings` 8 by 8 images or descriptors, `lineitem` triangles, `orders` versions of pages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import scalars
from waymark.functions.sharpness import array_sharpness
from waymark.operators import filtering, geo, logs, matching, models, points, summary
from waymark.session import shared_dir
from waymark.streaming import streams

THRESHOLD, FPS, OVERLAP, RATIO = 20.0, 0.25, 3, 0.95

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def as_frames(events: DataFrame) -> DataFrame:
    number = F.col("event_id")
    return events.select(
        F.col("user_id").alias("video_id"), scalars.out_name(number).alias("path"), number.alias("frame_no"),
        scalars.frame_time(number).alias("t_sec"), F.col("value").alias("sharpness"),
    )


def scores(spark: SparkSession, d: str) -> DataFrame:
    return as_frames(table(spark, d, "events"))


def numbered(spark: SparkSession, d: str) -> DataFrame:
    """Purchases of each user as a renumbered frame set."""
    bought = as_frames(table(spark, d, "events").filter("event_type = 'purchase'"))
    return filtering.renumber(bought)


RANKED = """ranked AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i
  FROM events WHERE value >= 20),
kept AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM ranked WHERE i % 4 = 0)"""
SEQ = """f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq
  FROM events WHERE event_type = 'purchase')"""
SEQ_ALL = "f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events)"
SAMPLED_SQL = f"""WITH {RANKED} SELECT user_id AS video_id, printf('frame_%07d.jpg', event_id) AS src_path, event_id AS src_frame_no,
  CAST(event_id - 1 AS DOUBLE) AS t_sec, value AS sharpness, CAST(seq AS BIGINT) AS seq_no,
  printf('frame_%07d.jpg', seq) AS out_name FROM kept"""


@query("SELECT user_id AS video_id, event_id AS frame_no, value AS sharpness FROM events WHERE value >= 20 AND NOT isnan(value)")
def blur_filter(spark, d):
    return filtering.blur_filter(scores(spark, d), THRESHOLD).select("video_id", "frame_no", "sharpness")


@query(SAMPLED_SQL)
def temporal_sample(spark, d):
    return filtering.manifest(scores(spark, d), THRESHOLD, 1.0, FPS)


@query(f"""WITH {RANKED}, n AS (SELECT user_id, count(*) AS original_count, count_if(value >= 20) AS after_blur_filter FROM events GROUP BY 1),
k AS (SELECT user_id, count(*) AS final_count, string_agg(printf('frame_%07d.jpg', seq), ',' ORDER BY seq) AS names FROM kept GROUP BY 1)
SELECT n.user_id AS video_id, original_count, CAST(after_blur_filter AS BIGINT) AS after_blur_filter,
  coalesce(final_count, 0) AS final_count, CAST(20 AS DOUBLE) AS blur_threshold, CAST(0.25 AS DOUBLE) AS fps_target,
  coalesce(names, '') AS filtered_files FROM n LEFT JOIN k USING (user_id)""")
def filter_funnel(spark, d):
    all_scores = scores(spark, d)
    chosen = filtering.manifest(all_scores, THRESHOLD, 1.0, FPS)
    out = summary.filter_funnel(all_scores, chosen, THRESHOLD, FPS)
    return out.withColumn("filtered_files", F.array_join("filtered_files", ","))


@query("""SELECT user_id AS video_id, count(*) AS total_frames, round(avg(value), 6) AS mean_sharpness,
  round(stddev_pop(value), 6) AS std_sharpness, min(value) AS min_sharpness, max(value) AS max_sharpness,
  CAST(count_if(value >= 20) AS BIGINT) AS frames_above_threshold, CAST(20 AS DOUBLE) AS blur_threshold FROM events GROUP BY 1""")
def quality_stats(spark, d):
    out = summary.quality_stats(scores(spark, d), THRESHOLD)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_sharpness", "std_sharpness")})


@query("""SELECT c_custkey AS video_id, count(event_id) AS total_frames,
  CASE WHEN count(event_id) = 0 THEN 'No frames to analyze' END AS error
  FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1""")
def quality_errors(spark, d):
    videos = table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"))
    out = summary.quality_stats(scores(spark, d), THRESHOLD, videos)
    return out.select("video_id", F.coalesce("total_frames", F.lit(0).cast("bigint")).alias("total_frames"), "error")


@query("""WITH px AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT vec_id, e, r, k FROM px, range(8) t(r), range(8) s(k)),
lap AS (SELECT vec_id, e[(CASE r WHEN 0 THEN 1 ELSE r - 1 END) * 8 + k + 1] + e[(CASE r WHEN 7 THEN 6 ELSE r + 1 END) * 8 + k + 1]
  + e[r * 8 + (CASE k WHEN 0 THEN 1 ELSE k - 1 END) + 1] + e[r * 8 + (CASE k WHEN 7 THEN 6 ELSE k + 1 END) + 1] - 4 * e[r * 8 + k + 1] AS v FROM c)
SELECT vec_id, round(var_pop(v), 6) AS sharpness FROM lap GROUP BY 1""")
def sharpness_8x8(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(array_sharpness(F.col("embedding"), 8), 6).alias("sharpness"))


@query("""WITH n AS (SELECT event_id, printf('frame_%07d.jpg', event_id) AS file_name FROM events)
SELECT event_id, file_name, coalesce(try_cast(split_part(replace(file_name, '.jpg', ''), '_', 2) AS BIGINT), 0) AS frame_no,
  CAST(event_id - 1 AS DOUBLE) AS t_sec FROM n""")
def frame_numbers(spark, d):
    names = table(spark, d, "events").select("event_id", scalars.out_name(F.col("event_id")).alias("file_name"))
    number = scalars.frame_no(F.col("file_name"))
    return names.select("event_id", "file_name", number.alias("frame_no"), scalars.frame_time(number).alias("t_sec"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages)
SELECT page_id, regexp_extract(path, '([^/]*)$', 1) AS file_name, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem,
  regexp_extract(path, '([^/]+)/[^/]*$', 1) AS parent, regexp_replace(path, '[^/]*$', 'gps.csv') AS sibling FROM p""")
def path_parts(spark, d):
    path = F.col("path")
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("path"))
    return pages.select(
        "page_id", scalars.file_name(path).alias("file_name"), scalars.stem(path).alias("stem"), scalars.parent_name(path).alias("parent"),
        scalars.sibling(path, "gps.csv").alias("sibling"),
    )


@query(r"""WITH v AS (SELECT event_id, CAST(event_id % 90 AS INT) AS dg, CAST(event_id % 60 AS INT) AS mn FROM events)
SELECT event_id, round((dg + mn / 60.0 + 30.0 / 3600) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END, 9) AS lat,
  event_id % 3 = 0 AS located FROM v""")
def gps_values(spark, d):
    n = F.col("event_id")
    text = F.format_string("%d deg %d' 30.00\" %s", (n % 90).cast("int"), (n % 60).cast("int"), F.when(n % 2 == 0, "N").otherwise("S"))
    label = F.when(n % 3 == 0, "GPS fix").otherwise("plain")
    return table(spark, d, "events").select(
        "event_id", F.round(scalars.gps_degrees(text), 9).alias("lat"), scalars.mentions_location(label).alias("located")
    )


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id AS video_id, event_type AS model_id, n AS n_images FROM c
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""")
def best_model(spark, d):
    counts = table(spark, d, "events").groupBy(F.col("user_id").alias("video_id"), F.col("event_type").alias("model_id")).agg(
        F.count("*").alias("n_images")
    )
    return models.best_by_count(counts, "n_images")


def as_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as model files: their number tells which file."""
    names = F.array(*map(F.lit, ("points3D.bin", "cameras.bin", "images.bin")))
    lines = table(spark, d, "lineitem")
    model = F.col("l_linenumber") <= 3
    return lines.select(
        F.col("l_orderkey").cast("string").alias("video_id"), F.when(model, F.col("l_returnflag")).alias("model_id"),
        F.when(model, F.get(names, F.col("l_linenumber") - 1)).otherwise("model.ply").alias("file_name"),
        (F.col("l_quantity").cast("bigint") * 100000).alias("length"),
    )


@query("""WITH f AS (SELECT CAST(l_orderkey AS VARCHAR) AS v, l_returnflag AS m, l_linenumber AS k, CAST(l_quantity AS BIGINT) * 100000 AS n FROM lineitem),
p AS (SELECT v, max(n) AS pn FROM f WHERE k > 3 GROUP BY 1)
SELECT f.v AS video_id, m AS model_id, bool_or(k = 1) AS points3D, bool_or(k = 2) AS cameras, bool_or(k = 3) AS images,
  max(pn) IS NOT NULL AS ply, round_even(max(pn) / 1048576.0::DOUBLE, 2) AS ply_size_mb
FROM f LEFT JOIN p ON f.v = p.v WHERE k <= 3 GROUP BY 1, 2""")
def artifact_audit(spark, d):
    return models.audit(as_artifacts(spark, d))


@query("""WITH f AS (SELECT CAST(l_orderkey AS VARCHAR) AS v, l_returnflag AS m, l_linenumber AS k, CAST(l_quantity AS BIGINT) * 100000 AS n FROM lineitem),
s AS (SELECT v, m, coalesce(max(CASE WHEN k = 3 THEN n // 100 END), 0) AS c FROM f WHERE k <= 3 GROUP BY 1, 2)
SELECT v AS video_id, m AS model_id, c AS n_images FROM s QUALIFY row_number() OVER (PARTITION BY v ORDER BY c DESC, m) = 1""")
def best_model_files(spark, d):
    return models.best_model(as_artifacts(spark, d))


@query("""SELECT user_id AS run_id, event_id AS line_no, event_type AS message FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20""")
def tail_per_run(spark, d):
    lines = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), F.col("event_type").alias("message"))
    return logs.tail(lines)


@query("""WITH j AS (SELECT user_id, event_id, event_type, ts, sum(CASE WHEN event_type = 'login' OR event_type = 'purchase' THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY event_id) AS job FROM events)
SELECT user_id AS run_id, event_id AS line_no, CAST(job AS BIGINT) AS job, CAST(row_number() OVER w AS INT) AS step,
  (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS seconds FROM j WINDOW w AS (PARTITION BY user_id, job ORDER BY event_id)""")
def job_status(spark, d):
    start = F.when(F.col("event_type").isin("login", "purchase"), "Starting").otherwise(F.col("event_type"))
    lines = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), "ts", start.alias("message"))
    return logs.job_status(lines, "Starting").select("run_id", "line_no", "job", "step", "seconds")


@query("""WITH a AS (SELECT user_id, count(*) AS frame_count FROM events GROUP BY 1),
b AS (SELECT user_id, count(*) AS sharp FROM events WHERE value >= 20 GROUP BY 1),
c AS (SELECT user_id, max(ts) AS last_fix FROM events WHERE event_type = 'view' GROUP BY 1),
m AS (SELECT user_id, event_type AS model_id FROM events GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) = 1)
SELECT a.user_id AS video_id, frame_count, sharp, model_id, last_fix FROM a JOIN b USING (user_id) JOIN m USING (user_id) LEFT JOIN c USING (user_id)""")
def stage_assembly(spark, d):
    frames = scores(spark, d)
    fixes = table(spark, d, "events").filter("event_type = 'view'").groupBy(F.col("user_id").alias("video_id")).agg(F.max("ts").alias("last_fix"))
    sharp = filtering.blur_filter(frames, THRESHOLD).groupBy("video_id").agg(F.count("*").alias("sharp"))
    return summary.assemble(summary.frame_count(frames), sharp, best_model(spark, d).select("video_id", "model_id"), fixes)


@query("""SELECT c_custkey AS video_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def videos_without_frames(spark, d):
    videos = table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"))
    return filtering.without(videos, scores(spark, d))


@query("""SELECT c_custkey AS video_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')""")
def videos_without_model(spark, d):
    """What require_models names: videos whose artifacts hold no model. Only purchases count as files of a model."""
    videos = table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"))
    model = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    found = table(spark, d, "events").select(F.col("user_id").alias("video_id"), model.alias("model_id"))
    return filtering.without(videos, found.filter(F.col("model_id").isNotNull()))


@query("""SELECT user_id AS video_id, event_id AS frame_no, printf('frame_%07d.jpg', event_id) AS path FROM events ORDER BY 1, 2, 3""")
def frames_in_order(spark, d):
    return filtering.in_order(scores(spark, d)).select("video_id", "frame_no", "path")


@query("""WITH n AS (SELECT event_id, printf('frame_%07d.jpg', event_id) AS path FROM events)
SELECT event_id, CAST(split_part(replace(path, '.jpg', ''), '_', 2) AS BIGINT) AS frame_no FROM n""")
def frame_numbers_strict(spark, d):
    names = table(spark, d, "events").select("event_id", scalars.out_name(F.col("event_id")).alias("path"))
    return names.select("event_id", scalars.frame_no_strict(F.col("path")).alias("frame_no"))


@query(f"WITH {SEQ} SELECT a.user_id AS video_id, a.seq AS seq_a, b.seq AS seq_b FROM f a JOIN f b ON a.user_id = b.user_id AND b.seq > a.seq AND b.seq <= a.seq + 3")
def sequential_pairs(spark, d):
    return matching.sequential_pairs(numbered(spark, d), OVERLAP)


@query(f"WITH {SEQ} SELECT a.user_id AS video_id, a.seq AS seq_a, b.seq AS seq_b FROM f a JOIN f b ON a.user_id = b.user_id AND b.seq > a.seq")
def exhaustive_pairs(spark, d):
    return matching.exhaustive_pairs(numbered(spark, d))


@query(f"WITH {SEQ_ALL} SELECT a.user_id AS video_id, a.seq AS seq_a, b.seq AS seq_b FROM f a JOIN f b ON a.user_id = b.user_id AND b.seq > a.seq AND b.seq <= a.seq + 3")
def sequential_pairs_all(spark, d):
    """As sequential_pairs, with every event as a frame."""
    return matching.sequential_pairs(filtering.renumber(scores(spark, d)), OVERLAP)


@query(f"WITH {SEQ_ALL} SELECT a.user_id AS video_id, a.seq AS seq_a, b.seq AS seq_b FROM f a JOIN f b ON a.user_id = b.user_id AND b.seq > a.seq")
def exhaustive_pairs_all(spark, d):
    """As exhaustive_pairs, with every event as a frame."""
    return matching.exhaustive_pairs(filtering.renumber(scores(spark, d)))


@query("""WITH d AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
m AS (SELECT DISTINCT label FROM d), p AS (SELECT a.label AS a, min(b.label) AS b FROM m a JOIN m b ON b.label > a.label GROUP BY 1),
x AS (SELECT p.a, p.b, q.vec_id AS va, r.vec_id AS vb, list_distance(q.e, r.e) AS dist FROM p JOIN d q ON q.label = p.a JOIN d r ON r.label = p.b),
k AS (SELECT *, row_number() OVER w AS rn, lead(dist) OVER w AS second FROM x WINDOW w AS (PARTITION BY a, b, va ORDER BY dist, vb))
SELECT a AS image_a, b AS image_b, va AS desc_a, vb AS desc_b, round(dist, 6) AS dist, round(second, 6) AS second
FROM k WHERE rn = 1 AND dist < 0.95 * second""")
def ratio_match(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("label").alias("image"), F.col("vec_id").alias("desc_id"), F.col("embedding").alias("vec"))
    images = vectors.filter("image IS NOT NULL").select(F.col("image").alias("image_a")).distinct()
    pairs = images.withColumn("image_b", F.lead("image_a").over(Window.orderBy("image_a"))).filter("image_b IS NOT NULL")
    out = matching.ratio_match(pairs, vectors, RATIO)
    return out.select("image_a", "image_b", "desc_a", "desc_b", F.round("dist", 6).alias("dist"), F.round("second", 6).alias("second"))


@query("""WITH c AS (SELECT user_id, event_id, CASE WHEN user_id % 2 = 0 THEN CAST(event_id % 256 AS DOUBLE) ELSE (event_id % 256) / 255.0::DOUBLE END AS r FROM events),
m AS (SELECT user_id, max(r) AS mx FROM c GROUP BY 1)
SELECT user_id AS cloud_id, event_id AS point_id, round(r / CASE WHEN mx > 1 THEN 255.0 ELSE 1.0 END, 9) AS r,
  round(r / 2 / CASE WHEN mx > 1 THEN 255.0 ELSE 1.0 END, 9) AS g, round(r / 4 / CASE WHEN mx > 1 THEN 255.0 ELSE 1.0 END, 9) AS b
FROM c JOIN m USING (user_id)""")
def colour_normalise(spark, d):
    grey = (F.col("event_id") % 256).cast("double")
    red = F.when(F.col("user_id") % 2 == 0, grey).otherwise(grey / 255)
    cloud = table(spark, d, "events").select(
        F.col("user_id").alias("cloud_id"), F.col("event_id").alias("point_id"), red.alias("r"), (red / 2).alias("g"), (red / 4).alias("b"),
        F.lit(900.0).alias("a"),
    )
    out = points.normalise_colours(cloud)
    return out.select("cloud_id", "point_id", *[F.round(c, 9).alias(c) for c in "rgb"])


@query("""WITH t AS (SELECT l_orderkey AS a, l_partkey AS b, l_suppkey AS c FROM lineitem),
e AS (SELECT a AS p, b AS q FROM t UNION ALL SELECT b, c FROM t UNION ALL SELECT a, c FROM t)
SELECT DISTINCT least(p, q) AS u, greatest(p, q) AS v FROM e""")
def mesh_edges(spark, d):
    keys = {"l_orderkey": "a", "l_partkey": "b", "l_suppkey": "c"}
    return points.mesh_edges(table(spark, d, "lineitem").select(*[F.col(k).alias(v) for k, v in keys.items()]))


def as_vertices(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


@query("SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings")
def mesh_vertices(spark, d):
    return points.mesh_vertices(as_vertices(spark, d))


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
t AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b, l_linenumber AS c FROM lineitem),
n AS (SELECT t.a, t.b, t.c, (q.y - p.y) * (r.z - p.z) - (q.z - p.z) * (r.y - p.y) AS nx,
  (q.z - p.z) * (r.x - p.x) - (q.x - p.x) * (r.z - p.z) AS ny, (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) AS nz
  FROM t JOIN v p ON p.id = t.a JOIN v q ON q.id = t.b JOIN v r ON r.id = t.c),
k AS (SELECT a AS id, nx, ny, nz FROM n UNION ALL SELECT b, nx, ny, nz FROM n UNION ALL SELECT c, nx, ny, nz FROM n),
s AS (SELECT id, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM k GROUP BY 1), l AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS m FROM s)
SELECT id, round(CASE WHEN m > 0 THEN nx / m ELSE 0 END, 6) + 0 AS nx, round(CASE WHEN m > 0 THEN ny / m ELSE 0 END, 6) + 0 AS ny,
  round(CASE WHEN m > 0 THEN nz / m ELSE 0 END, 6) + 0 AS nz FROM l""")
def vertex_normals(spark, d):
    keys = {"l_partkey": "a", "l_suppkey": "b", "l_linenumber": "c"}
    triangles = table(spark, d, "lineitem").select(*[F.col(k).cast("bigint").alias(v) for k, v in keys.items()]).distinct()
    out = points.vertex_normals(as_vertices(spark, d), triangles)
    return out.select("id", *[(F.round(c, 6) + 0).alias(c) for c in ("nx", "ny", "nz")])


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def props_json(spark, d):
    parsed = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(parsed, "$.k", "string").alias("k"))


def as_track(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("user_id", "video_id")
    frames = events.filter("event_type = 'purchase'").select("video_id", F.col("event_id").alias("frame_no"), "ts")
    fixes = events.filter("event_type = 'view'").select("video_id", "ts", (F.col("value") / 10).alias("lat"), (F.col("value") / 5).alias("lon"))
    return frames, fixes


@query("""WITH f AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'),
g AS (SELECT user_id, ts AS fts, value FROM events WHERE event_type = 'view')
SELECT f.user_id AS video_id, event_id AS frame_no, round(value / 10, 6) AS lat, round(value / 5, 6) AS lon
FROM f ASOF LEFT JOIN g ON f.user_id = g.user_id AND f.ts >= g.fts""")
def frame_gps_asof(spark, d):
    out = geo.align(*as_track(spark, d))
    return out.select("video_id", "frame_no", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("""WITH f AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'),
g AS (SELECT user_id, ts AS fts, value / 10 AS lat FROM events WHERE event_type = 'view'),
b AS (SELECT f.*, g.fts AS t0, g.lat AS l0 FROM f ASOF LEFT JOIN g ON f.user_id = g.user_id AND f.ts >= g.fts),
a AS (SELECT b.*, g.fts AS t1, g.lat AS l1 FROM b ASOF LEFT JOIN g ON b.user_id = g.user_id AND b.ts <= g.fts)
SELECT user_id AS video_id, event_id AS frame_no, round(CASE WHEN l0 IS NULL THEN NULL WHEN l1 IS NULL OR t1 = t0 THEN l0
  ELSE l0 + (epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0)) * (l1 - l0) END, 4) AS lat FROM a""")
def frame_gps_linear(spark, d):
    return geo.align(*as_track(spark, d), interpolate=True).select("video_id", "frame_no", F.round("lat", 4).alias("lat"))


@query("""WITH p AS (SELECT event_id, radians(value / 10) AS phi, radians(value / 5) AS lam, CAST(event_id % 1000 AS DOUBLE) AS h FROM events),
n AS (SELECT *, 6378137.0 / sqrt(1 - 0.0066943799901413165 * sin(phi) * sin(phi)) AS n FROM p)
SELECT event_id, round((n + h) * cos(phi) * cos(lam), 3) AS x, round((n + h) * cos(phi) * sin(lam), 3) AS y,
  round((n * (1 - 0.0066943799901413165) + h) * sin(phi), 3) AS z FROM n""")
def ecef(spark, d):
    v = F.col("value")
    x, y, z = geo.ecef(v / 10, v / 5, (F.col("event_id") % 1000).cast("double"))
    return table(spark, d, "events").select("event_id", *[F.round(c, 3).alias(n) for n, c in (("x", x), ("y", y), ("z", z))])


def as_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Centres and places per label: a place is the centre turned, doubled, moved, with a little noise."""
    at = lambda i: F.col("embedding")[i].cast("double")
    noise = at(3) / 100
    return table(spark, d, "embeddings").select(
        F.col("label").alias("video_id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"),
        (-2 * at(1) + 10 + noise).alias("u"), (2 * at(0) - 5 + noise).alias("v"), (2 * at(2) + 1 + noise).alias("w"),
    )


@query("""WITH p AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT label, pow(e[1] + 2 * e[2] - 10 - e[4] / 100, 2) + pow(e[2] - 2 * e[1] + 5 - e[4] / 100, 2) + pow(e[3] - 2 * e[3] - 1 - e[4] / 100, 2) AS d2 FROM p)
SELECT label AS video_id, round(sqrt(max(d2)), 6) AS max_residual, round(sqrt(avg(d2)), 6) AS rms_residual, max(d2) <= 225 AS within FROM d GROUP BY 1""")
def residual_gate(spark, d):
    out = geo.residual_gate(as_pairs(spark, d), 15.0)
    return out.select("video_id", *[F.round(c, 6).alias(c) for c in ("max_residual", "rms_residual")], "within")


_HORN = ("c00 + c11 + c22", "c12 - c21", "c20 - c02", "c01 - c10", "c12 - c21", "c00 - c11 - c22", "c01 + c10", "c20 + c02",
         "c20 - c02", "c01 + c10", "c11 - c00 - c22", "c12 + c21", "c01 - c10", "c20 + c02", "c12 + c21", "c22 - c00 - c11")
_PLACE = ("-2 * e[2] + 10 + e[4] / 100", "2 * e[1] - 5 + e[4] / 100", "2 * e[3] + 1 + e[4] / 100")
_COVAR = ", ".join(f"covar_pop({v}, e[{i + 1}]) AS c{i}{j}" for i in range(3) for j, v in enumerate(_PLACE))
_MEANS = ", ".join(f"avg(e[{i + 1}]) AS x{i}, avg({v}) AS u{i}" for i, v in enumerate(_PLACE))
_TURN = ("q[1] + q[6] - q[11] - q[16]", "2 * (q[7] - q[4])", "2 * (q[8] + q[3])", "2 * (q[7] + q[4])", "q[1] - q[6] + q[11] - q[16]",
         "2 * (q[12] - q[2])", "2 * (q[8] - q[3])", "2 * (q[12] + q[2])", "q[1] - q[6] - q[11] + q[16]")


@query(f"""WITH p AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT label, count(*) AS n, {_COVAR}, {_MEANS}, var_pop(e[1]) + var_pop(e[2]) + var_pop(e[3]) AS spread FROM p GROUP BY 1),
h AS (SELECT *, [{", ".join(_HORN)}] AS h FROM s),
m AS (SELECT *, [h[i] / sqrt(list_sum([x * x FOR x IN h])) + CASE WHEN i % 5 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR i IN range(1, 17)] AS m FROM h),
q AS (SELECT *, list_reduce([m FOR i IN range({geo.SQUARINGS + 1})], lambda a, b: [(a[(i - 1) // 4 * 4 + 1] * a[(i - 1) % 4 + 1] + a[(i - 1) // 4 * 4 + 2] * a[(i - 1) % 4 + 5]
  + a[(i - 1) // 4 * 4 + 3] * a[(i - 1) % 4 + 9] + a[(i - 1) // 4 * 4 + 4] * a[(i - 1) % 4 + 13]) / (list_sum([x * x FOR x IN a])) FOR i IN range(1, 17)]) AS q FROM m),
r AS (SELECT *, {", ".join(f"{t} AS r{i // 3}{i % 3}" for i, t in enumerate(_TURN))} FROM q),
f AS (SELECT *, ({" + ".join(f"r{j}{i} * c{i}{j}" for i in range(3) for j in range(3))}) / spread AS scale FROM r)
SELECT label AS video_id, n, round(scale, 6) AS scale, {", ".join(f"round(r{i}{j}, 6) AS r{i}{j}" for i in range(3) for j in range(3))},
  {", ".join(f"round(u{i} - scale * (r{i}0 * x0 + r{i}1 * x1 + r{i}2 * x2), 5) AS shift{i}" for i in range(3))} FROM f""")
def similarity_fit(spark, d):
    fit = geo.similarity_fit(as_pairs(spark, d))
    turn = [F.round(F.col("rotation")[3 * i + j], 6).alias(f"r{i}{j}") for i in range(3) for j in range(3)]
    return fit.select("video_id", "n", F.round("scale", 6).alias("scale"), *turn, *[F.round(F.col("shift")[i], 5).alias(f"shift{i}") for i in range(3)])


@query("""WITH s AS (SELECT l_orderkey AS cloud_id, l_partkey AS checksum FROM lineitem WHERE l_linenumber = 1)
SELECT DISTINCT l_orderkey AS cloud_id, l_partkey AS checksum FROM lineitem
WHERE (l_orderkey, l_partkey) NOT IN (SELECT cloud_id, checksum FROM s)""")
def merge_points(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cloud_id"), F.col("l_partkey").alias("checksum"), "l_linenumber")
    return geo.merge_points(rows.filter("l_linenumber = 1"), rows).select("cloud_id", "checksum")


TILES_SQL = """SELECT CAST(floor(l_extendedprice / 1000) AS BIGINT) AS tile_x, CAST(floor(l_quantity / 1000) AS BIGINT) AS tile_y, count(*) AS n_points,
  min(l_extendedprice) AS min_x, max(l_extendedprice) AS max_x, min(l_quantity) AS min_y, max(l_quantity) AS max_y,
  min(l_tax) AS min_z, max(l_tax) AS max_z FROM lineitem GROUP BY 1, 2"""


def as_points(spark: SparkSession, d: str) -> DataFrame:
    keys = {"l_extendedprice": "x", "l_quantity": "y", "l_tax": "z"}
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cloud_id"), "l_linenumber", *[F.col(k).alias(v) for k, v in keys.items()])


@query(TILES_SQL)
def point_tiles(spark, d):
    return geo.tiles(as_points(spark, d), 1000.0)


@query(TILES_SQL)
def retile(spark, d):
    """Tiles of all points but the seventh lines, then those lines come in: only tiles that they touch are made anew."""
    points = as_points(spark, d)
    old, new = points.filter("l_linenumber < 7"), points.filter("l_linenumber = 7")
    touched = new.select(*[c.alias(k) for k, c in geo.tile_keys(1000.0).items()])
    return geo.retile(geo.tiles(old, 1000.0), points, touched, 1000.0)


@query(TILES_SQL)
def merged_tiles(spark, d):
    """Tiles of all points from tiles of two parts of them."""
    points = as_points(spark, d)
    return geo.merge_tiles(*(geo.tiles(points.filter(f"l_linenumber {which} 4"), 1000.0) for which in ("<", ">=")))


@query("""WITH p AS (SELECT l_orderkey, md5(concat_ws(',', CAST(floor(l_extendedprice * 1000 + 0.5) AS BIGINT), CAST(floor(l_quantity * 1000 + 0.5) AS BIGINT),
  CAST(floor(l_tax * 1000 + 0.5) AS BIGINT))) AS h FROM lineitem)
SELECT l_orderkey AS cloud_id, count(*) AS n_points, CAST(sum(CAST('0x' || h[1:15] AS BIGINT)) % 1152921504606846976 AS BIGINT) AS checksum FROM p GROUP BY 1""")
def cloud_checksum(spark, d):
    return geo.cloud_checksum(as_points(spark, d))


@query("""SELECT user_id AS video_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS polyline
FROM events WHERE event_type = 'view' GROUP BY 1""")
def gps_polyline(spark, d):
    fixes = table(spark, d, "events").filter("event_type = 'view'").select(
        F.col("user_id").alias("video_id"), "ts", F.col("event_id").alias("lon"), F.lit(0).cast("bigint").alias("lat")
    )
    line = F.array_join(F.transform("polyline", lambda p: p[0].cast("string")), ",")
    return geo.polyline(fixes).select("video_id", line.alias("polyline"))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events WHERE event_type = 'view')
SELECT user_id AS video_id, i // 8 AS chunk, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY i) AS polyline FROM p GROUP BY 1, 2""")
def gps_polyline_chunks(spark, d):
    fixes = table(spark, d, "events").filter("event_type = 'view'").select(
        F.col("user_id").alias("video_id"), "ts", F.col("event_id").alias("lon"), F.lit(0).cast("bigint").alias("lat")
    )
    line = F.array_join(F.transform("polyline", lambda p: p[0].cast("string")), ",")
    return geo.polyline_chunks(fixes, 8).select("video_id", "chunk", line.alias("polyline"))


@query(f"""WITH {RANKED} SELECT user_id AS video_id, (seq - 1) // 5 AS chunk, string_agg(printf('frame_%07d.jpg', seq), ',' ORDER BY seq) AS files
FROM kept GROUP BY 1, 2""")
def file_chunks(spark, d):
    out = summary.file_chunks(filtering.manifest(scores(spark, d), THRESHOLD, 1.0, FPS), 5)
    return out.select("video_id", "chunk", F.array_join("files", ",").alias("files"))


@query("""SELECT o_custkey AS path, CAST(o_orderkey AS VARCHAR) AS title, o_orderdate AS updated FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) = 1""")
def site_manifest(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("path"), F.col("o_orderkey").cast("string").alias("title"), F.col("o_orderdate").alias("updated")
    )
    old = F.col("title").endswith("1")
    return geo.site_manifest(rows.filter(old), rows.filter(~old))


@query(SAMPLED_SQL)
def stream_sample(spark, d):
    schema = table(spark, d, "events").schema
    arriving = as_frames(streams.table_stream(spark, d, "events.parquet", schema))
    kept = streams.temporal_sample(streams.blur_filter(arriving, THRESHOLD), 1.0, FPS)
    return filtering.renumber(streams.drain(kept, f"sample_{uuid.uuid4().hex}"))


@query("SELECT event_id, user_id, value FROM events")
def stream_dedup(spark, d):
    schema = table(spark, d, "events").schema
    twice = streams.table_stream(spark, d, "events.parquet", schema, times=2).withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.drain(streams.first_arrivals(twice, "event_id", "ts"), f"dedup_{uuid.uuid4().hex}").select("event_id", "user_id", "value")


@query("""WITH f AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'),
g AS (SELECT user_id, ts AS fix_ts, value FROM events WHERE event_type = 'view')
SELECT f.user_id AS video_id, event_id AS frame_no, epoch_us(fix_ts) - epoch_us(ts) AS apart_us, round(value / 10, 6) AS lat, round(value / 5, 6) AS lon
FROM f JOIN g ON f.user_id = g.user_id AND fix_ts >= ts - INTERVAL 3 HOUR AND fix_ts <= ts + INTERVAL 1 HOUR""")
def stream_gps_join(spark, d):
    """Two streams over events, purchases as frames and views as fixes, joined within bounds both ways."""
    schema = table(spark, d, "events").schema
    frames, fixes = (streams.table_stream(spark, d, "events.parquet", schema).filter(F.col("event_type") == kind) for kind in ("purchase", "view"))
    video, ts = F.col("user_id").alias("video_id"), F.col("ts").cast("timestamp").alias("ts")
    joined = streams.gps_join(
        frames.select(video, F.col("event_id").alias("frame_no"), ts), fixes.select(video, ts, (F.col("value") / 10).alias("lat"), (F.col("value") / 5).alias("lon")),
        "3 HOURS", "1 HOUR",
    )
    out = streams.drain(joined, f"gps_{uuid.uuid4().hex}")
    apart = F.unix_micros("fix_ts") - F.unix_micros("ts")
    return out.select("video_id", "frame_no", apart.alias("apart_us"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(SAMPLED_SQL)
def stream_completed_sample(spark, d):
    """Frames of all events dropped out of order in four files, with a marker for each video; samples are made when a video is complete."""
    rows = scores(spark, d)
    none = F.lit(None)
    frames = rows.select("video_id", "frame_no", "path", "t_sec", "sharpness", none.cast("bigint").alias("frame_count"))
    marks = rows.groupBy("video_id").agg(F.count("*").alias("frame_count"))
    place = f"{shared_dir(spark)}/completed-{uuid.uuid4().hex}"
    dropped = frames.unionByName(marks, allowMissingColumns=True).repartition(4, F.xxhash64("frame_no", "video_id"))
    dropped.write.parquet(f"{place}/drop")
    arriving = spark.readStream.schema(streams.ARRIVALS).option("maxFilesPerTrigger", 1).parquet(f"{place}/drop")
    return streams.CompletedSamples(place, THRESHOLD, 1.0, FPS, buckets=8).run(arriving)
