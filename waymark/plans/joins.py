"""Join-shaped queries: tiered, spatial, as-of and look-up joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.text import path_job, path_track
from waymark.functions.vectors import vec
from waymark.operators import geometry as G
from waymark.operators.matching import calibration_attach, calibration_match, frame_boxes, tiered_match
from waymark.operators.spatial import box_join, cone_join, radius_join
from waymark.registry import query
from waymark.sources import survey as S


@query(S.with_tables("frames points", "SELECT f.frame_id, count(*) AS n, min(p.point_id) AS first_point FROM frames f JOIN points p ON (p.x - f.ox) * (p.x - f.ox) + (p.y - f.oy) * (p.y - f.oy) <= 64 AND p.x BETWEEN f.ox - 8 AND f.ox + 8 GROUP BY f.frame_id"))
def radius_query(spark: SparkSession, sf: str) -> DataFrame:
    near = radius_join(S.frames(spark, sf), S.points(spark, sf), ("ox", "oy"), ("x", "y"), 8.0)
    return near.groupBy("frame_id").agg(F.count("*").alias("n"), F.min("point_id").alias("first_point"))


@query(
    S.with_tables(
        "frames points",
        """, c AS (SELECT f.frame_id, p.point_id, greatest(least(((p.x - ox) * fx + (p.y - oy) * fy), 10), 0) AS t, p.x - ox AS dx, p.y - oy AS dy, fx, fy FROM frames f JOIN points p ON p.x BETWEEN ox - 12 AND ox + 12 AND p.y BETWEEN oy - 12 AND oy + 12)
SELECT frame_id, count(*) AS n FROM c WHERE (dx - t * fx) * (dx - t * fx) + (dy - t * fy) * (dy - t * fy) <= 4 GROUP BY frame_id""",
    )
)
def capsule_query(spark: SparkSession, sf: str) -> DataFrame:
    """Points within 2 m of the segment from a frame to 10 m ahead."""
    near = radius_join(S.frames(spark, sf), S.points(spark, sf), ("ox", "oy"), ("x", "y"), 12.0)
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    t = F.greatest(F.least(dx * F.col("fx") + dy * F.col("fy"), F.lit(10.0)), F.lit(0.0))
    ex, ey = dx - t * F.col("fx"), dy - t * F.col("fy")
    return near.filter(ex * ex + ey * ey <= 4.0).groupBy("frame_id").agg(F.count("*").alias("n"))


_CONE = """, c AS (SELECT f.frame_id, b.file_id, b.block_id, (min_x + max_x) / 2 - ox AS vx, (min_y + max_y) / 2 - oy AS vy, (min_z + max_z) / 2 - oz AS vz, fx, fy,
  sqrt((max_x - min_x) ** 2 + (max_y - min_y) ** 2 + (max_z - min_z) ** 2) / 2 AS radius FROM frames f JOIN {blocks} b ON true),
d AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS d FROM c)
SELECT frame_id, count(*) AS n FROM d WHERE d > 0 AND d - radius <= 60 AND acos(greatest(least((vx * fx + vy * fy) / d, 1), -1)) <= 0.35::DOUBLE + CASE WHEN d <= radius THEN pi() ELSE asin(least(1, radius / d)) END GROUP BY frame_id"""

#: Small blocks of the points, so that a cone meets some of them.
_TILES = "tiles AS (SELECT file_id, floor(x / 20) * 1000 + floor(y / 20) AS block_id, " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in "xyz") + " FROM points GROUP BY ALL)"


def _tiles(spark: SparkSession, sf: str) -> DataFrame:
    p = S.points(spark, sf).withColumn("block_id", F.floor(F.col("x") / 20) * 1000 + F.floor(F.col("y") / 20))
    return p.groupBy("file_id", "block_id").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"])


@query(S.with_tables("frames points", ", " + _TILES + _CONE.format(blocks="tiles")))
def frame_block_cone(spark: SparkSession, sf: str) -> DataFrame:
    hit = cone_join(S.frames(spark, sf), _tiles(spark, sf), vec("ox", "oy", "oz"), vec("fx", "fy", "fz"), F.lit(0.35), 0.0, 60.0, 60.0)
    return hit.groupBy("frame_id").agg(F.count("*").alias("n"))


@query(
    S.with_tables(
        "points frames",
        ", " + _TILES + " SELECT f.frame_id, count(*) AS n FROM frames f JOIN tiles t ON t.min_x <= ox + 5 AND t.max_x >= ox - 5 AND t.min_y <= oy + 5 AND t.max_y >= oy - 5 AND t.min_z <= oz + 5 AND t.max_z >= oz - 5 GROUP BY f.frame_id",
    )
)
def detection_block_aabb(spark: SparkSession, sf: str) -> DataFrame:
    box = S.frames(spark, sf).withColumns({"bx0": F.col("ox") - 5, "by0": F.col("oy") - 5, "bx1": F.col("ox") + 5, "by1": F.col("oy") + 5})
    hit = box_join(box, _tiles(spark, sf), ("bx0", "by0", "bx1", "by1"), ("min_x", "min_y", "max_x", "max_y"), 20.0, ())
    return hit.filter("min_z <= oz + 5 AND max_z >= oz - 5").groupBy("frame_id").agg(F.count("*").alias("n"))


_DIST = "sqrt(greatest(min_x - ox, 0, ox - max_x) ** 2 + greatest(min_y - oy, 0, oy - max_y) ** 2)"


@query(
    S.with_tables(
        "frames files",
        f""", t AS (SELECT frame_id, file_id, {_DIST} AS d, CASE WHEN track_id % 10 = file_id AND ordinal % 3 = 0 THEN 0 WHEN track_id % 5 = file_id THEN 1 ELSE 2 END AS tier FROM frames, files),
m AS (SELECT *, min(tier) OVER (PARTITION BY frame_id) AS best FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY d, file_id) AS rank FROM m WHERE tier = best)
SELECT frame_id, file_id, tier, rank::INTEGER AS rank FROM k WHERE tier = 0 OR rank <= 3""",
    )
)
def match_files(spark: SparkSession, sf: str) -> DataFrame:
    """The most specific non-empty tier; the exact tier is never capped, the others at 3."""
    f, p = S.frames(spark, sf), S.files(spark, sf)
    exact = F.when(F.col("ordinal") % 3 == 0, F.col("track_id") % 10)
    return tiered_match(f, p, "frame_id", [(exact, F.col("file_id")), (F.col("track_id") % 5, F.col("file_id"))], "file_id", 3)


@query(S.with_tables("frames files", f", k AS (SELECT frame_id, file_id, row_number() OVER (PARTITION BY frame_id ORDER BY {_DIST}, file_id) AS rank FROM frames JOIN files ON track_id % 10 = file_id) SELECT frame_id, file_id, rank::INTEGER AS rank FROM k WHERE rank <= 6"))
def match_files_legacy(spark: SparkSession, sf: str) -> DataFrame:
    joined = S.frames(spark, sf).withColumn("route", F.col("track_id") % 10).join(S.files(spark, sf), F.col("route") == F.col("file_id"))
    distance = G.bbox_distance_2d(F.col("ox"), F.col("oy"), tuple(F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")))  # type: ignore[arg-type]
    rank = F.row_number().over(W.partitionBy("frame_id").orderBy(distance, "file_id"))
    return joined.select("frame_id", "file_id", rank.alias("rank")).filter("rank <= 6")


_TASKS = """, t AS (SELECT frame_id, 'Job_' || (frame_id % 40) || CASE WHEN frame_id % 2 = 0 THEN '.JOB' ELSE '' END AS job_name, CASE WHEN frame_id % 3 > 0 THEN 'Track' || (track_id % 5) END AS track_name,
    (frame_id * 37 % 604800)::DOUBLE AS gps_sow, 2290 + frame_id % 3 AS gps_week, frame_id % 4 > 0 AS week_inferred, 7040 AS image_width, 3520 AS image_height FROM frames),
b AS (SELECT 'job_' || s_nationkey AS job, 'track' || (s_suppkey % 5) || '.scan' AS track, s_suppkey AS calib_id, CASE WHEN s_suppkey % 4 > 0 THEN 2290 + s_suppkey % 3 END AS calib_week, CASE WHEN s_suppkey % 7 = 0 THEN 8000 ELSE 7040 END AS width, 3520 AS height FROM supplier),
m AS (SELECT frame_id, count(calib_id) AS n, min(calib_id) AS pick FROM t LEFT JOIN b ON b.job = regexp_replace(lower(t.job_name), '\\.job$', '') AND (t.track_name IS NULL OR regexp_replace(b.track, '\\.scan$', '') = lower(t.track_name)) GROUP BY frame_id)"""


def _tasks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Frames as tasks that name a job and, most of them, a track; suppliers as calibrations."""
    i = F.col("frame_id")
    job = F.concat(F.lit("Job_"), i % 40, F.when(i % 2 == 0, ".JOB").otherwise(""))
    own = {"job_name": job, "track_name": F.when(i % 3 > 0, F.concat(F.lit("Track"), F.col("track_id") % 5)), "gps_sow": (i * 37 % 604800).cast("double"), "gps_week": 2290 + i % 3, "week_inferred": i % 4 > 0, "image_width": F.lit(7040), "image_height": F.lit(3520)}
    s = F.col("s_suppkey")
    bundle = {"job": F.concat(F.lit("job_"), "s_nationkey"), "track": F.concat(F.lit("track"), s % 5, F.lit(".scan")), "calib_id": s, "calib_week": F.when(s % 4 > 0, 2290 + s % 3), "width": F.when(s % 7 == 0, 8000).otherwise(7040), "height": F.lit(3520)}
    pick = lambda d: [v.alias(k) for k, v in d.items()]
    return S.frames(spark, sf).select("frame_id", *pick(own)), S.read(spark, sf, "supplier").select(*pick(bundle))


@query(S.with_tables("frames", _TASKS + " SELECT frame_id, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN pick END AS calib_id FROM m"))
def calib_match(spark: SparkSession, sf: str) -> DataFrame:
    """The calibration of each task by job and, where it names one, track."""
    return calibration_match(*_tasks(spark, sf), "frame_id")


@query(S.with_tables("frames", _TASKS + " SELECT frame_id, pick AS calib_id FROM m WHERE n = 1"))
def calib_match_simple(spark: SparkSession, sf: str) -> DataFrame:
    """The older look-up: the one entry that fits, or none."""
    return calibration_match(*_tasks(spark, sf), "frame_id").filter("status = 'matched'").select("frame_id", "calib_id")


_SHIFT = "epoch_us(TIMESTAMP '1980-01-06 00:00:00' + to_seconds(gps_week::BIGINT * 604800 + gps_sow::BIGINT - 18))"


@query(S.with_tables("frames", _TASKS + f""", j AS (SELECT t.*, m.n, m.pick, b.calib_week, b.width, b.height FROM t JOIN m USING (frame_id) LEFT JOIN b ON m.n = 1 AND b.calib_id = m.pick),
k AS (SELECT *, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN width <> image_width OR height <> image_height THEN 'size_mismatch' WHEN calib_week IS NOT NULL AND calib_week <> gps_week AND NOT week_inferred THEN 'week_conflict' WHEN calib_week IS NOT NULL AND calib_week <> gps_week THEN 'week_replaced' ELSE 'attached' END AS status FROM j),
w AS (SELECT frame_id, status, CASE WHEN status IN ('attached', 'week_replaced') THEN pick END AS calib_id, (CASE WHEN status = 'week_replaced' THEN calib_week ELSE gps_week END)::BIGINT AS gps_week, gps_sow FROM k)
SELECT frame_id, status, calib_id, gps_week, {_SHIFT} AS micros FROM w"""))
def calib_attach(spark: SparkSession, sf: str) -> DataFrame:
    """A calibration's week replaces one that was inferred, and the time follows; against a given
    one it is a conflict, and another image size is an error."""
    tasks, bundle = _tasks(spark, sf)
    found = calibration_attach(tasks, calibration_match(tasks, bundle, "frame_id"), bundle, "frame_id")
    return found.select("frame_id", "status", "calib_id", "gps_week", F.unix_micros("taken_at").alias("micros"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'given' WHEN p_partkey % 3 = 0 THEN 'Job_' || p_size END AS job, CASE WHEN p_partkey % 5 = 0 THEN 'T' WHEN p_partkey % 2 = 0 THEN 'track_' || (p_partkey % 7) END AS track FROM part""")
def task_job_track(spark: SparkSession, sf: str) -> DataFrame:
    """Job and track of an image from its path, where they aren't given; the file's own name,
    which may look like a job, never counts."""
    p = F.col("p_partkey")
    folders = F.concat(F.lit("/data/job_old/"), F.when(p % 3 == 0, F.concat(F.lit("Job_"), "p_size", F.lit(".job"))).otherwise("x"), F.lit("/"), F.when(p % 2 == 0, F.concat(F.lit("track_"), p % 7)).otherwise("Track7b"), F.lit("/Job_9_a.jpg"))
    folders = F.when(p % 3 == 0, folders).otherwise(F.replace(folders, F.lit("job_old"), F.lit("old")))
    made = S.read(spark, sf, "part").select(p.alias("id"), folders.alias("path"), F.when(p % 4 == 0, "given").alias("j"), F.when(p % 5 == 0, "T").alias("t"))
    return made.select("id", path_job(F.col("path"), F.col("j")).alias("job"), path_track(F.col("path"), F.col("t")).alias("track"))


@query(S.with_tables("pole_observations detections", ", l AS (SELECT image_name, detection_index, max(quality) AS quality FROM pole_observations GROUP BY ALL) SELECT d.image_name, d.detection_index, coalesce('P' || d.class_id, '') AS class_key, CASE WHEN l.image_name IS NULL THEN '' ELSE 'P' || d.order_id END AS support_id FROM detections d LEFT JOIN l USING (image_name, detection_index)"))
def support_attach(spark: SparkSession, sf: str) -> DataFrame:
    d = S.detections(spark, sf)
    poles = S.pole_observations(spark, sf).select("image_name", "detection_index").distinct().withColumn("found", F.lit(True))
    joined = d.join(poles, ["image_name", "detection_index"], "left")
    return joined.select("image_name", "detection_index", F.concat(F.lit("P"), "class_id").alias("class_key"), F.when(F.col("found"), F.concat(F.lit("P"), "order_id")).otherwise("").alias("support_id"))


@query(S.with_tables("features", "SELECT id, round((point_x - 500) ** 2 + (point_y - 250) ** 2, 6) + 0.0 AS d2 FROM features WHERE NOT deleted AND (point_x - 500) ** 2 + (point_y - 250) ** 2 <= 90000"))
def overlay_radius(spark: SparkSession, sf: str) -> DataFrame:
    f = S.features(spark, sf).filter(~F.col("deleted") & F.col("point_x").between(200, 800) & F.col("point_y").between(-50, 550))
    d2 = (F.col("point_x") - 500) ** 2 + (F.col("point_y") - 250) ** 2
    return f.filter(d2 <= 90000).select("id", (F.round(d2, 6) + 0.0).alias("d2"))


@query(S.with_tables("features", "SELECT id, round((point_x - 500) ** 2 + (point_y - 250) ** 2, 6) + 0.0 AS d2 FROM features WHERE NOT deleted AND point_x BETWEEN 100 AND 900 AND point_y BETWEEN -150 AND 650 ORDER BY (point_x - 500) ** 2 + (point_y - 250) ** 2, id LIMIT 20"))
def overlay_project(spark: SparkSession, sf: str) -> DataFrame:
    """Box filter, then the 20 nearest (a top-k report)."""
    f = S.features(spark, sf).filter(~F.col("deleted") & F.col("point_x").between(100, 900) & F.col("point_y").between(-150, 650))
    d2 = (F.col("point_x") - 500) ** 2 + (F.col("point_y") - 250) ** 2
    return f.select("id", (F.round(d2, 6) + 0.0).alias("d2"), d2.alias("o")).orderBy("o", "id").limit(20).drop("o")


@query(S.with_tables("detections", """, l AS (SELECT d.*, 'view' || (d.order_id % 400) AS frame, d.detection_index % 2 AS model, o_orderdate FROM detections d JOIN orders ON o_orderkey = d.order_id AND o_orderstatus = 'F'),
n AS (SELECT frame, max(struct_pack(at := o_orderdate, run := order_id)).run AS run FROM l GROUP BY frame),
u AS (SELECT l.*, row_number() OVER (PARTITION BY l.frame, model, class_id, round(x0), round(y0), round(x1), round(y1) ORDER BY confidence DESC, detection_index) AS k FROM l JOIN n ON n.frame = l.frame AND n.run = l.order_id WHERE n.run % 7 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY confidence DESC, model, detection_index) AS rank, count(*) OVER (PARTITION BY frame) AS size FROM u WHERE k = 1)
SELECT n.frame AS image_name, n.run AS run_id, model, detection_index, rank::INTEGER AS rank, run % 7 = 0 OR coalesce(size, 0) > 4 AS truncated FROM n LEFT JOIN (SELECT * FROM r WHERE rank <= 4) r ON r.frame = n.frame"""))
def frame_detections(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of each frame from the newest completed run that has it; orders serve as runs."""
    d = S.detections(spark, sf).join(S.runs(spark, sf).filter("status = 'F'").select("run_id", "finished_at"), F.col("order_id") == F.col("run_id"))
    d = d.withColumns({"image_name": F.concat(F.lit("view"), F.col("run_id") % 400), "model": F.col("detection_index") % 2})
    documents = d.select("image_name", "run_id", "finished_at", (F.col("run_id") % 7 != 0).alias("readable")).distinct()
    return frame_boxes(documents, d, 4)


@query(S.with_tables("frames", "SELECT frame_id, lag(frame_id) OVER w AS previous, lead(frame_id) OVER w AS next FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY ordinal)"))
def track_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("track_id").orderBy("ordinal")
    return S.frames(spark, sf).select("frame_id", F.lag("frame_id").over(w).alias("previous"), F.lead("frame_id").over(w).alias("next"))


@query(
    S.with_tables(
        "frames",
        """, n AS (SELECT *, lag(struct_pack(i := frame_id, x := ox, y := oy)) OVER w AS p, lead(struct_pack(i := frame_id, x := ox, y := oy)) OVER w AS q FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY ordinal)),
c AS (SELECT frame_id, fx, fy, ox, oy, p AS t, 1 AS o FROM n WHERE p IS NOT NULL UNION ALL SELECT frame_id, fx, fy, ox, oy, q, 0 FROM n WHERE q IS NOT NULL),
a AS (SELECT frame_id, t.i AS target, o, degrees(acos(greatest(least(((t.x - ox) * fx + (t.y - oy) * fy) / sqrt((t.x - ox) ** 2 + (t.y - oy) ** 2), 1), -1))) AS angle FROM c WHERE (t.x - ox) ** 2 + (t.y - oy) ** 2 > 0)
SELECT frame_id, target FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY round(angle, 6), o) AS k FROM a WHERE angle <= 50) WHERE k = 1""",
    )
)
def directional_target(spark: SparkSession, sf: str) -> DataFrame:
    """The neighbour nearest to the view direction, at most 50 degrees off; ties go forward."""
    w = W.partitionBy("track_id").orderBy("ordinal")
    other = F.struct(F.col("frame_id").alias("i"), F.col("ox").alias("x"), F.col("oy").alias("y"))
    n = S.frames(spark, sf).withColumn("ahead", F.lead(other).over(w)).withColumn("behind", F.lag(other).over(w))
    n = n.withColumn("t", F.explode(F.array(F.struct(F.col("ahead").alias("n"), F.lit(0).alias("o")), F.struct(F.col("behind").alias("n"), F.lit(1).alias("o"))))).filter("t.n IS NOT NULL")
    dx, dy = F.col("t.n.x") - F.col("ox"), F.col("t.n.y") - F.col("oy")
    d = F.sqrt(dx * dx + dy * dy)
    angle = F.degrees(F.acos(F.greatest(F.least((dx * F.col("fx") + dy * F.col("fy")) / d, F.lit(1.0)), F.lit(-1.0))))
    a = n.filter(d > 0).select("frame_id", F.col("t.n.i").alias("target"), F.col("t.o").alias("o"), angle.alias("angle")).filter("angle <= 50")
    return a.groupBy("frame_id").agg(F.min_by("target", F.struct(F.round("angle", 6), "o")).alias("target"))


@query(S.with_tables("splits", "SELECT base, count(*) AS pieces, count(DISTINCT split_index) AS indices, bool_and(point_count > 0) AS all_filled, sum(point_count)::BIGINT AS points FROM splits GROUP BY base"))
def split_companions(spark: SparkSession, sf: str) -> DataFrame:
    return S.splits(spark, sf).groupBy("base").agg(F.count("*").alias("pieces"), F.countDistinct("split_index").alias("indices"), F.bool_and(F.col("point_count") > 0).alias("all_filled"), F.sum("point_count").alias("points"))


@query(S.with_tables("frames", ", r AS (SELECT o_orderkey, o_custkey % 15 AS u, o_orderdate FROM orders) SELECT f.frame_id, max(r.o_orderdate) AS last_order FROM frames f LEFT JOIN r ON r.u = f.track_id % 15 AND r.o_orderdate <= f.ts GROUP BY f.frame_id"))
def asof_last(spark: SparkSession, sf: str) -> DataFrame:
    """As-of join: the latest order at or before each frame, by a union and one window."""
    f = S.frames(spark, sf).select((F.col("track_id") % 15).alias("u"), F.col("ts").alias("at"), "frame_id", F.lit(None).cast("timestamp_ntz").alias("seen"))
    o = S.read(spark, sf, "orders")
    o = o.select((F.col("o_custkey") % 15).alias("u"), F.col("o_orderdate").alias("at"), F.lit(None).cast("long").alias("frame_id"), F.col("o_orderdate").alias("seen"))
    w = W.partitionBy("u").orderBy("at", F.col("frame_id").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    both = f.unionByName(o).withColumn("last_order", F.last("seen", ignorenulls=True).over(w))
    return both.filter("frame_id IS NOT NULL").select("frame_id", "last_order")


@query(S.with_tables("frames", "SELECT frame_id FROM frames f WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = f.frame_id AND o.o_orderstatus = 'F')"))
def artifact_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Frames without a finished result: what a rerun still has to do."""
    done = S.runs(spark, sf).filter("status = 'F'").select(F.col("run_id").alias("frame_id"))
    return S.frames(spark, sf).join(done, "frame_id", "left_anti").select("frame_id")


@query(S.with_tables("frames", ", w(n) AS (VALUES (5), (120), (999999)) SELECT n AS wanted, coalesce((SELECT frame_id FROM frames WHERE frame_id = n), (SELECT frame_id FROM frames ORDER BY (ox - 200) ** 2 + (oy - 100) ** 2, frame_id LIMIT 1)) AS frame_id FROM w"))
def locate_frame(spark: SparkSession, sf: str) -> DataFrame:
    """By id, else the frame nearest to a place."""
    f = S.frames(spark, sf)
    wanted = spark.createDataFrame([(5,), (120,), (999999,)], "wanted int")
    d2 = (F.col("ox") - 200) ** 2 + (F.col("oy") - 100) ** 2
    nearest = f.agg(F.min_by("frame_id", F.struct(d2, "frame_id")).alias("nearest"))
    found = f.select(F.col("frame_id").alias("own")).join(F.broadcast(wanted), F.col("wanted") == F.col("own"), "right")
    return found.crossJoin(F.broadcast(nearest)).select("wanted", F.coalesce("own", "nearest").alias("frame_id"))  # one row
