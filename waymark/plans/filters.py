"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.text import canonical_name, canonical_track, natural_key
from waymark.functions.vectors import cross, dot, vec
from waymark.operators.matching import nearest_boxes
from waymark.registry import query
from waymark.sources import survey as S


@query(S.with_tables("frames", "SELECT frame_id FROM frames WHERE lower(record_name) IN ('click', 'view') AND ordinal BETWEEN 2 AND 11"))
def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    f = S.frames(spark, sf)
    return f.filter(F.lower("record_name").isin("click", "view") & F.col("ordinal").between(2, 11)).select("frame_id")


@query("SELECT p_partkey AS id, regexp_extract(lower(p_brand), '^[^0-9]*') || chr(1) || lpad(regexp_extract(p_brand, '[0-9]+'), 20, '0') AS key FROM part")
def natural_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Keys by which brands sort in natural order: digit runs compare as numbers."""
    p = S.read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), natural_key(F.col("p_brand")).alias("key")).sort("key", "id")


@query(S.with_tables("frames", ", g AS (SELECT track_id, min(ordinal) AS lo, max(ordinal) AS hi, count(*) AS n FROM frames WHERE ordinal BETWEEN 3 AND 8 GROUP BY track_id) SELECT track_id, n AS frames, hi - lo + 1 = n AS contiguous FROM g"))
def frame_range(spark: SparkSession, sf: str) -> DataFrame:
    g = S.frames(spark, sf).filter(F.col("ordinal").between(3, 8)).groupBy("track_id").agg(F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count("*").alias("frames"))
    return g.select("track_id", "frames", (F.col("hi") - F.col("lo") + 1 == F.col("frames")).alias("contiguous"))


@query(S.with_tables("frames", "SELECT frame_id, k % 7 <> 0 AS valid FROM frames"))
def rotation_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a rotation matrix: orthonormal within 1e-5 and determinant 1. Every seventh k is scaled."""
    s = F.when(F.col("k") % 7 == 0, 1.01).otherwise(1.0)
    f = S.frames(spark, sf).withColumns({"a1": F.col("fy") * s, "a2": -F.col("fx") * s, "a3": F.lit(0.0), "b1": F.col("fx"), "b2": F.col("fy"), "b3": F.lit(0.0), "c1": F.lit(0.0), "c2": F.lit(0.0), "c3": F.lit(1.0)})
    a, b, c = vec("a1", "a2", "a3"), vec("b1", "b2", "b3"), vec("c1", "c2", "c3")
    small = lambda x: F.abs(x) <= 1e-5
    ok = small(dot(a, a) - 1) & small(dot(b, b) - 1) & small(dot(c, c) - 1) & small(dot(a, b)) & small(dot(b, c)) & small(dot(a, c)) & (F.abs(dot(cross(a, b), c) - 1) <= 1e-5)
    return f.select("frame_id", ok.alias("valid"))


@query("SELECT l_orderkey AS o, l_linenumber AS n, abs(l_extendedprice / 0.05::DOUBLE - round_even(l_extendedprice / 0.05::DOUBLE, 0)) <= 1e-4 AS on_grid FROM lineitem")
def grid_valid(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_extendedprice") / 0.05
    return S.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), (F.abs(q - F.rint(q)) <= 1e-4).alias("on_grid"))


@query(S.with_tables("detections", "SELECT image_name, detection_index, CASE WHEN point_count >= 30 THEN 'accepted' WHEN point_count >= 15 AND confidence >= 0.95::DOUBLE THEN 'fallback' ELSE 'rejected' END AS state, concat_ws(';', CASE WHEN point_count < 30 THEN 'few_points' END, CASE WHEN point_count < 15 THEN 'too_few_points' END, CASE WHEN confidence < 0.95::DOUBLE THEN 'low_confidence' END) AS reasons FROM detections"))
def min_points_gate(spark: SparkSession, sf: str) -> DataFrame:
    few, fewer, low = F.col("point_count") < 30, F.col("point_count") < 15, F.col("confidence") < 0.95
    state = F.when(~few, "accepted").when(~fewer & ~low, "fallback").otherwise("rejected")
    reasons = F.concat_ws(";", F.when(few, "few_points"), F.when(fewer, "too_few_points"), F.when(low, "low_confidence"))
    return S.detections(spark, sf).select("image_name", "detection_index", state.alias("state"), reasons.alias("reasons"))


@query(S.with_tables("detections", "SELECT image_name, detection_index, quantile_cont(z, 0.95) OVER w - quantile_cont(z, 0.05) OVER w <= 0.0512345::DOUBLE AS flat FROM detections WINDOW w AS (PARTITION BY image_name)"))
def range_fallback_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Depth spread between the 5 and 95 % quantiles of an image."""
    d = S.detections(spark, sf)
    spread = d.groupBy("image_name").agg((F.percentile("z", 0.95) - F.percentile("z", 0.05) <= 0.0512345).alias("flat"))
    return d.join(spread, "image_name").select("image_name", "detection_index", "flat")


@query(S.with_tables("frames", "SELECT frame_id, degrees(acos(greatest(least(fy, 1), -1))) > 45 AS rejected FROM frames WHERE k NOT IN (12, 13, 87, 88)"))
def angle_gate(spark: SparkSession, sf: str) -> DataFrame:
    angle = F.degrees(F.acos(F.greatest(F.least("fy", F.lit(1.0)), F.lit(-1.0))))
    return S.frames(spark, sf).filter(~F.col("k").isin(12, 13, 87, 88)).select("frame_id", (angle > 45).alias("rejected"))


@query(S.with_tables("points", "SELECT class_id, count(*) AS n FROM points WHERE sqrt((x - 200) ** 2 + (y - 160) ** 2) > 0.1 AND sqrt((x - 200) ** 2 + (y - 160) ** 2) <= 60 GROUP BY class_id"))
def range_mask(spark: SparkSession, sf: str) -> DataFrame:
    d = F.sqrt((F.col("x") - 200) ** 2 + (F.col("y") - 160) ** 2)
    return S.points(spark, sf).filter((d > 0.1) & (d <= 60)).groupBy("class_id").agg(F.count("*").alias("n"))


#: A concave polygon in pixels.
POLYGON = ((150.0, 100.0), (260.0, 110.0), (240.0, 170.0), (205.0, 140.0), (170.0, 220.0))
_EDGES = list(zip(POLYGON, POLYGON[1:] + POLYGON[:1]))
_CROSS = " + ".join(f"CASE WHEN ({ay} > y) <> ({by} > y) AND x < ({bx} - {ax}) * (y - {ay})::DOUBLE / ({by} - {ay}) + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in _EDGES)


@query(S.with_tables("points", f"SELECT class_id, count(*) AS n, min(point_id) AS first_point FROM points WHERE ({_CROSS}) % 2 = 1 GROUP BY class_id"))
def mask_member(spark: SparkSession, sf: str) -> DataFrame:
    """Even-odd test of points against a polygon."""
    x, y = F.col("x"), F.col("y")
    crossings = sum(F.when(((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0) for (ax, ay), (bx, by) in _EDGES)
    return S.points(spark, sf).filter(crossings % 2 == 1).groupBy("class_id").agg(F.count("*").alias("n"), F.min("point_id").alias("first_point"))


@query(
    S.with_tables(
        "points",
        """, low AS (SELECT floor(x / 10) AS cx, floor(y / 10) AS cy, quantile_cont(z, 0.1) AS z0 FROM points GROUP BY ALL),
smooth AS (SELECT a.cx, a.cy, min(b.z0) AS ground FROM low a JOIN low b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 GROUP BY a.cx, a.cy)
SELECT class_id, count(*) AS n FROM points JOIN smooth ON floor(x / 10) = cx AND floor(y / 10) = cy WHERE z > ground + 0.2 GROUP BY class_id""",
    )
)
def terrain_clearance(spark: SparkSession, sf: str) -> DataFrame:
    """Points over the lowest ground of their 3 x 3 cells; neighbours come by an equi-join."""
    p = S.points(spark, sf).withColumn("cx", F.floor(F.col("x") / 10)).withColumn("cy", F.floor(F.col("y") / 10))
    low = p.groupBy("cx", "cy").agg(F.percentile("z", 0.1).alias("z0"))
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    spread = low.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).select((F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), "z0")
    ground = spread.groupBy("cx", "cy").agg(F.min("z0").alias("ground"))
    return p.join(ground, ["cx", "cy"]).filter(F.col("z") > F.col("ground") + 0.2).groupBy("class_id").agg(F.count("*").alias("n"))


@query(S.with_tables("points", ", c AS (SELECT block_id, max(CASE WHEN abs(x - 200) <= 40 AND abs(y - 160) <= 40 THEN 1 ELSE 0 END) AS any_in FROM points GROUP BY block_id) SELECT block_id, any_in = 1 AS inside FROM c"))
def crop_extent(spark: SparkSession, sf: str) -> DataFrame:
    near = (F.abs(F.col("x") - 200) <= 40) & (F.abs(F.col("y") - 160) <= 40)
    return S.points(spark, sf).groupBy("block_id").agg(F.bool_or(near).alias("inside"))


@query(S.with_tables("frames files", ", d AS (SELECT frame_id, min(sqrt(greatest(min_x - ox, 0, ox - max_x) ** 2 + greatest(min_y - oy, 0, oy - max_y) ** 2)) AS d FROM frames, files GROUP BY frame_id) SELECT frame_id, round(d, 6) + 0.0 AS distance FROM d WHERE d > 25"))
def proximity_check(spark: SparkSession, sf: str) -> DataFrame:
    """Frames whose nearest file is too far."""
    near = nearest_boxes(S.frames(spark, sf), S.files(spark, sf), "frame_id", "file_id", 1)
    return near.filter("distance > 25").select("frame_id", (F.round("distance", 6) + 0.0).alias("distance"))


@query(S.with_tables("detections", "SELECT image_name, detection_index, CASE WHEN confidence >= 0.93::DOUBLE THEN x END AS x, x1 > x0 AND y1 > y0 AS finite_box FROM detections"))
def accepted_position(spark: SparkSession, sf: str) -> DataFrame:
    finite = F.lit(True)
    for c in ("x0", "y0", "x1", "y1"):
        finite = finite & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return S.detections(spark, sf).select("image_name", "detection_index", F.when(F.col("confidence") >= 0.93, F.col("x")).alias("x"), (finite & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).alias("finite_box"))


@query(S.with_tables("detections", "SELECT image_name, detection_index FROM detections WHERE ((5 BETWEEN x0 AND x1) OR (5 BETWEEN x0 - 4096 AND x1 - 4096) OR (5 BETWEEN x0 + 4096 AND x1 + 4096)) AND 500 BETWEEN y0 AND y1"))
def box_contains_uv(spark: SparkSession, sf: str) -> DataFrame:
    """Seam-aware containment of the pixel (5, 500)."""
    inside = F.lit(False)
    for s in (-4096.0, 0.0, 4096.0):
        inside = inside | F.lit(5.0).between(F.col("x0") + s, F.col("x1") + s)
    return S.detections(spark, sf).filter(inside & F.lit(500.0).between(F.col("y0"), F.col("y1"))).select("image_name", "detection_index")


@query(S.with_tables("points", ", h AS (SELECT file_id, class_id, count(*) AS n FROM points GROUP BY ALL) SELECT file_id, CASE WHEN sum(CASE WHEN class_id IN (2, 9) THEN n ELSE 0 END) > 0 AND count(*) > 1 THEN 'HYBRID' ELSE 'GEOMETRY' END AS policy FROM h GROUP BY file_id"))
def class_policy(spark: SparkSession, sf: str) -> DataFrame:
    h = S.points(spark, sf).groupBy("file_id", "class_id").agg(F.count("*").alias("n"))
    known = F.sum(F.when(F.col("class_id").isin(2, 9), F.col("n")).otherwise(0))
    return h.groupBy("file_id").agg(F.when((known > 0) & (F.count("*") > 1), "HYBRID").otherwise("GEOMETRY").alias("policy"))


@query("SELECT c_custkey AS id, CASE WHEN regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') = '' THEN NULL ELSE regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') END AS name, regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT AS track FROM customer")
def canonical_names(spark: SparkSession, sf: str) -> DataFrame:
    return S.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), canonical_name(F.col("c_name")).alias("name"), canonical_track(F.col("c_name")).alias("track"))


@query(S.with_tables("splits", "SELECT file_id, path FROM splits WHERE regexp_replace(lower(base), '[^a-z0-9]', '', 'g') = 'brand12'"))
def job_filter(spark: SparkSession, sf: str) -> DataFrame:
    s = S.splits(spark, sf)
    return s.filter(canonical_name(F.col("base")) == "brand12").select("file_id", "path")
