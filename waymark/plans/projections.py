"""Queries over camera geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.vectors import const, dot, norm, vec
from waymark.operators import geometry as G
from waymark.operators.spatial import radius_join
from waymark.registry import query
from waymark.sources import survey as S

WIDTH, HEIGHT = 2048.0, 1024.0


def r(x, digits: int = 6):
    return F.round(x, digits) + 0.0


def framed(df: DataFrame):
    return G.camera_axes(df, vec("fx", "fy", "fz"), const(0, 0, 1))


@query(S.with_tables("frames", "SELECT frame_id, round(fx / sqrt(fx * fx + fy * fy), 6) + 0.0 AS nx, round(fy / sqrt(fx * fx + fy * fy), 6) + 0.0 AS ny FROM frames"))
def vec_normalize(spark: SparkSession, sf: str) -> DataFrame:
    from waymark.functions.vectors import unit

    n = unit(vec("fx", "fy", "fz"))
    return S.frames(spark, sf).select("frame_id", r(n[0]).alias("nx"), r(n[1]).alias("ny"))


@query(S.with_tables("frames", "SELECT frame_id, round(fy, 6) + 0.0 AS rx, round(-fx, 6) + 0.0 AS ry, 0.0::DOUBLE AS rz, 0.0::DOUBLE AS ux, 0.0::DOUBLE AS uy, 1.0::DOUBLE AS uz FROM frames"))
def camera_axes(spark: SparkSession, sf: str) -> DataFrame:
    df, (_, right, up) = framed(S.frames(spark, sf))
    return df.select("frame_id", *[r(c).alias(n) for c, n in zip((*right, *up), ("rx", "ry", "rz", "ux", "uy", "uz"))])


_OFFSET_SQL = S.with_tables(
    "frames",
    """, a AS (SELECT *, cos(radians(7.5::DOUBLE)) AS cy, sin(radians(7.5::DOUBLE)) AS sy, cos(radians(-3.25::DOUBLE)) AS cp, sin(radians(-3.25::DOUBLE)) AS sp FROM frames)
SELECT frame_id, round(cp * (cy * fx - sy * fy), 6) + 0.0 AS fx, round(cp * (cy * fy + sy * fx), 6) + 0.0 AS fy, round(sp, 6) + 0.0 AS fz,
 round(sy * fx + cy * fy, 6) + 0.0 AS rx, round(sy * fy - cy * fx, 6) + 0.0 AS ry FROM a""",
)


@query(_OFFSET_SQL)
def axes_offset(spark: SparkSession, sf: str) -> DataFrame:
    df, axes = framed(S.frames(spark, sf))
    f, right, _ = G.axes_offset(*axes, F.lit(7.5), F.lit(-3.25))
    return df.select("frame_id", r(f[0]).alias("fx"), r(f[1]).alias("fy"), r(f[2]).alias("fz"), r(right[0]).alias("rx"), r(right[1]).alias("ry"))


@query(S.with_tables("frames", "SELECT frame_id, round(CASE WHEN k % 10 = 0 THEN 0 ELSE fy END, 6) + 0.0 AS rx, round(CASE WHEN k % 10 = 0 THEN 1 ELSE -fx END, 6) + 0.0 AS ry FROM frames"))
def view_axes(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth k looks straight up, where the fallback decides."""
    up = F.col("k") % 10 == 0
    f = tuple(F.when(up, F.lit(v)).otherwise(F.col(c)) for c, v in zip(("fx", "fy", "fz"), (0.0, 0.0, 1.0)))
    df, (_, right, _) = G.view_axes(S.frames(spark, sf), f, const(0, 0, 1))  # type: ignore[arg-type]
    return df.select("frame_id", r(right[0]).alias("rx"), r(right[1]).alias("ry"))


@query(S.with_tables("frames", "SELECT frame_id, round(fy, 6) + 0.0 AS rx, round(-fx, 6) + 0.0 AS ry, 1.0::DOUBLE AS uz FROM frames"))
def roll_stable_axes(spark: SparkSession, sf: str) -> DataFrame:
    df, (_, right, up) = G.roll_stable_axes(S.frames(spark, sf), vec("fx", "fy", "fz"), const(0, 0, 1), const(1, 0, 0))
    return df.select("frame_id", r(right[0]).alias("rx"), r(right[1]).alias("ry"), r(up[2]).alias("uz"))


#: Points near each frame, with the offset to it along its own axes.
_SEEN_SQL = """, near AS (SELECT f.frame_id, p.point_id, p.x - f.ox AS dx, p.y - f.oy AS dy, p.z - f.oz AS dz, f.fx, f.fy FROM frames f JOIN points p
  ON (p.x - f.ox) * (p.x - f.ox) + (p.y - f.oy) * (p.y - f.oy) <= 225 AND p.x BETWEEN f.ox - 15 AND f.ox + 15),
seen AS (SELECT frame_id, point_id, sqrt(dx * dx + dy * dy + dz * dz) AS d, dx * fy - dy * fx AS side, dz AS up, dx * fx + dy * fy AS ahead FROM near)
"""


def seen(spark: SparkSession, sf: str, radius: float = 15.0):
    """Points near each frame, with the frame's axes."""
    frames, axes = framed(S.frames(spark, sf))
    return radius_join(frames, S.points(spark, sf), ("ox", "oy"), ("x", "y"), radius), axes


_UV = "(atan2(side / d, ahead / d) / (2 * pi()) + 0.5) * 2048 AS u, (0.5 - asin(greatest(least(up / d, 1), -1)) / pi()) * 1024 AS v"


@query(S.with_tables("frames points", _SEEN_SQL + f"SELECT frame_id, point_id, round(u, 4) + 0.0 AS u, round(v, 4) + 0.0 AS v, round(d, 4) + 0.0 AS distance FROM (SELECT *, {_UV} FROM seen)"))
def project_equirect(spark: SparkSession, sf: str) -> DataFrame:
    near, axes = seen(spark, sf)
    u, v, d = G.project_equirect(vec("x", "y", "z"), vec("ox", "oy", "oz"), axes, WIDTH, HEIGHT)
    return near.select("frame_id", "point_id", r(u, 4).alias("u"), r(v, 4).alias("v"), r(d, 4).alias("distance"))


@query(
    S.with_tables(
        "frames points",
        _SEEN_SQL + """SELECT frame_id, point_id, round(512 + 512 / tan(radians(90.0::DOUBLE) / 2) * (side / ahead), 4) + 0.0 AS u, round(384 - 384 / tan(radians(60.0::DOUBLE) / 2) * (up / ahead), 4) + 0.0 AS v FROM seen WHERE ahead > 0.5""",
    )
)
def project_persp(spark: SparkSession, sf: str) -> DataFrame:
    near, axes = seen(spark, sf)
    u, v, _, _ = G.project_persp(vec("x", "y", "z"), vec("ox", "oy", "oz"), axes, 1024.0, 768.0, F.lit(90.0), F.lit(60.0))
    ahead = dot(tuple(F.col(a) - F.col(b) for a, b in zip("xyz", ("ox", "oy", "oz"))), axes[0])  # type: ignore[arg-type]
    return near.filter(ahead > 0.5).select("frame_id", "point_id", r(u, 4).alias("u"), r(v, 4).alias("v"))


@query(
    S.with_tables(
        "frames points",
        _SEEN_SQL + f""", cells AS (SELECT frame_id, point_id, d, floor(u / 32) AS cu, floor(v / 32) AS cv FROM (SELECT *, {_UV} FROM seen)),
best AS (SELECT *, row_number() OVER (PARTITION BY frame_id, cu, cv ORDER BY d, point_id) AS k FROM cells)
SELECT frame_id, count(*) AS cells, round(avg(d), 6) + 0.0 AS mean_distance FROM best WHERE k = 1 GROUP BY frame_id""",
    )
)
def frame_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: points near each frame, projected into its panorama, nearest per screen cell."""
    near, axes = seen(spark, sf)
    u, v, d = G.project_equirect(vec("x", "y", "z"), vec("ox", "oy", "oz"), axes, WIDTH, HEIGHT)
    cells = near.select("frame_id", F.floor(u / 32).alias("cu"), F.floor(v / 32).alias("cv"), F.struct(d.alias("d"), "point_id").alias("p"))
    return cells.groupBy("frame_id", "cu", "cv").agg(F.min("p").alias("p")).groupBy("frame_id").agg(F.count("*").alias("cells"), r(F.avg("p.d")).alias("mean_distance"))


@query(S.with_tables("detections", "SELECT image_name, detection_index, round(0.5 * 1024 / tan(radians(40 + q) / 2), 6) AS fx, round(0.5 * 768 / tan(radians(30 + q) / 2), 6) AS fy FROM detections"))
def focal(spark: SparkSession, sf: str) -> DataFrame:
    d = S.detections(spark, sf)
    q = F.col("point_count").cast("double")
    fx, fy = G.focal(1024.0, 768.0, 40 + q, 30 + q)
    return d.select("image_name", "detection_index", r(fx).alias("fx"), r(fy).alias("fy"))


_RAY = """, p AS (SELECT image_name, detection_index, ((x0 + x1) / 2 / 4096 - 0.5) * 2 * pi() AS lon, (0.5 - (y0 + y1) / 2 / 2048) * pi() AS lat FROM detections)
SELECT image_name, detection_index, round(cos(lat) * sin(lon), 6) + 0.0 AS rx, round(cos(lat) * cos(lon), 6) + 0.0 AS ry, round(sin(lat), 6) + 0.0 AS rz FROM p"""


@query(S.with_tables("detections", _RAY))
def pixel_ray(spark: SparkSession, sf: str) -> DataFrame:
    axes = (const(0, 1, 0), const(1, 0, 0), const(0, 0, 1))
    ray = G.pixel_ray((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, axes, 4096.0, 2048.0)
    return S.detections(spark, sf).select("image_name", "detection_index", *[r(c).alias(n) for c, n in zip(ray, ("rx", "ry", "rz"))])


@query(S.with_tables("detections", "SELECT image_name, detection_index, round((x0 + x1) / 2, 4) + 0.0 AS u, round((y0 + y1) / 2, 4) + 0.0 AS v FROM detections WHERE (x0 + x1) / 2 < 4095 AND (x0 + x1) / 2 > 1"))
def ray_equirect(spark: SparkSession, sf: str) -> DataFrame:
    """A pixel to its ray and back."""
    axes = (const(0, 1, 0), const(1, 0, 0), const(0, 0, 1))
    px = (F.col("x0") + F.col("x1")) / 2
    u, v = G.ray_equirect(G.pixel_ray(px, (F.col("y0") + F.col("y1")) / 2, axes, 4096.0, 2048.0), axes, 4096.0, 2048.0)
    return S.detections(spark, sf).filter((px > 1) & (px < 4095)).select("image_name", "detection_index", r(u, 4).alias("u"), r(v, 4).alias("v"))


@query(S.with_tables("detections", "SELECT image_name, detection_index, round(x0 / 4, 4) + 0.0 AS u, round(y0 / 4, 4) + 0.0 AS v FROM detections"))
def persp_ray(spark: SparkSession, sf: str) -> DataFrame:
    """A view pixel to its ray and back."""
    axes = (const(0, 1, 0), const(1, 0, 0), const(0, 0, 1))
    ray = G.persp_ray(F.col("x0") / 4, F.col("y0") / 4, axes, 1024.0, 512.0, F.lit(90.0), F.lit(60.0))
    u, v, _, _ = G.project_persp(ray, const(0, 0, 0), axes, 1024.0, 512.0, F.lit(90.0), F.lit(60.0))
    return S.detections(spark, sf).select("image_name", "detection_index", r(u, 4).alias("u"), r(v, 4).alias("v"))


@query(S.with_tables("frames", "SELECT frame_id, round((degrees(atan2(fx, fy)) + 360) % 360.0::DOUBLE, 4) % 360.0::DOUBLE + 0.0 AS heading FROM frames"))
def heading(spark: SparkSession, sf: str) -> DataFrame:
    return S.frames(spark, sf).select("frame_id", (F.pmod(F.round(G.heading(F.col("fx"), F.col("fy")), 4), F.lit(360.0)) + 0.0).alias("heading"))


@query(
    S.with_tables(
        "frames",
        """, p AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY ordinal)),
h AS (SELECT *, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2) AS a FROM p)
SELECT track_id, count(*) AS frames, round(coalesce(sum(2 * 6371008.8::DOUBLE * asin(least(1.0, sqrt(a)))), 0), 2) + 0.0 AS length_m, round(min(lon), 6) AS west, round(max(lon), 6) AS east, round(min(lat), 6) AS south, round(max(lat), 6) AS north FROM h GROUP BY track_id""",
    )
)
def track_summary(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("track_id").orderBy("ordinal")
    f = S.frames(spark, sf).withColumn("step", G.haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")))
    return f.groupBy("track_id").agg(F.count("*").alias("frames"), r(F.coalesce(F.sum("step"), F.lit(0.0)), 2).alias("length_m"), r(F.min("lon")).alias("west"), r(F.max("lon")).alias("east"), r(F.min("lat")).alias("south"), r(F.max("lat")).alias("north"))


@query(
    S.with_tables(
        "frames",
        """, p AS (SELECT *, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY ordinal))
SELECT frame_id, round((degrees(atan2(sin(radians(nlon - lon)) * cos(radians(nlat)), cos(radians(lat)) * sin(radians(nlat)) - sin(radians(lat)) * cos(radians(nlat)) * cos(radians(nlon - lon)))) + 360) % 360.0::DOUBLE, 3) + 0.0 AS bearing FROM p WHERE nlon IS NOT NULL""",
    )
)
def bearing(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("track_id").orderBy("ordinal")
    f = S.frames(spark, sf).withColumn("nlon", F.lead("lon").over(w)).withColumn("nlat", F.lead("lat").over(w)).filter("nlon IS NOT NULL")
    return f.select("frame_id", r(G.bearing(F.col("lon"), F.col("lat"), F.col("nlon"), F.col("nlat")), 3).alias("bearing"))


@query(S.with_tables("frames", "SELECT frame_id, ((3.6::DOUBLE * k * 3 + 540) % 360.0::DOUBLE) - 180 AS angle FROM frames"))
def signed_angle(spark: SparkSession, sf: str) -> DataFrame:
    return S.frames(spark, sf).select("frame_id", G.signed_angle(3.6 * F.col("k") * 3).alias("angle"))


@query("SELECT i::INTEGER AS tile, (i * 90.0::DOUBLE) - 180 AS west_deg, (i * 90.0::DOUBLE) - 90 AS east_deg, i * 1024.0::DOUBLE AS x0, (i + 1) * 1024.0::DOUBLE AS x1 FROM range(4) t(i)")
def tiles(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.range(4).select(F.col("id").cast("int").alias("tile"))
    return t.select("tile", (F.col("tile") * 90.0 - 180).alias("west_deg"), (F.col("tile") * 90.0 - 90).alias("east_deg"), (F.col("tile") * 1024.0).alias("x0"), ((F.col("tile") + 1) * 1024.0).alias("x1"))


@query("SELECT x::INTEGER AS px, y::INTEGER AS py, round((((x + 0.5) / 64) - 0.5) * 360, 6) + 0.0 AS lon_deg, round((0.5 - (y + 0.5) / 32) * 180, 6) + 0.0 AS lat_deg FROM range(64) a(x), range(32) b(y)")
def remap_grid(spark: SparkSession, sf: str) -> DataFrame:
    g = spark.range(64 * 32).select((F.col("id") % 64).cast("int").alias("px"), F.floor(F.col("id") / 64).cast("int").alias("py"))
    return g.select("px", "py", r(((F.col("px") + 0.5) / 64 - 0.5) * 360).alias("lon_deg"), r((0.5 - (F.col("py") + 0.5) / 32) * 180).alias("lat_deg"))


@query(S.with_tables("detections", "SELECT image_name, detection_index, floor(x0 - 8) AS ex0, floor(y0 - 8) AS ey0, ceil(x1 + 8) AS ex1, ceil(y1 + 8) AS ey1, least(greatest(floor(x0 - 8), 0), 4095) AS cx0, least(greatest(ceil(x1 + 8), least(greatest(floor(x0 - 8), 0), 4095) + 1), 4096) AS cx1 FROM detections"))
def bbox_expand(spark: SparkSession, sf: str) -> DataFrame:
    d = S.detections(spark, sf)
    left = F.floor(F.col("x0") - 8).cast("double")
    right = F.ceil(F.col("x1") + 8).cast("double")
    inner = F.least(F.greatest(left, F.lit(0.0)), F.lit(4095.0))
    return d.select("image_name", "detection_index", left.alias("ex0"), F.floor(F.col("y0") - 8).cast("double").alias("ey0"), right.alias("ex1"), F.ceil(F.col("y1") + 8).cast("double").alias("ey1"), inner.alias("cx0"), F.least(F.greatest(right, inner + 1), F.lit(4096.0)).alias("cx1"))


@query(S.with_tables("detections", ", c AS (SELECT image_name, detection_index, degrees(acos(greatest(least(cos(radians(180 * (0.5 - y0 / 2048))) * cos(radians(180 * (0.5 - y1 / 2048))) * cos(radians(360 * (x1 - x0) / 4096)) + sin(radians(180 * (0.5 - y0 / 2048))) * sin(radians(180 * (0.5 - y1 / 2048))), 1), -1))) AS a FROM detections) SELECT image_name, detection_index, round(a, 4) + 0.0 AS diagonal_deg FROM c"))
def bbox_angle(spark: SparkSession, sf: str) -> DataFrame:
    """Angle between the rays of two opposite corners."""
    axes = (const(0, 1, 0), const(1, 0, 0), const(0, 0, 1))
    a = G.pixel_ray(F.col("x0"), F.col("y0"), axes, 4096.0, 2048.0)
    b = G.pixel_ray(F.col("x1"), F.col("y1"), axes, 4096.0, 2048.0)
    angle = F.degrees(F.acos(F.greatest(F.least(dot(a, b) / (norm(a) * norm(b)), F.lit(1.0)), F.lit(-1.0))))
    return S.detections(spark, sf).select("image_name", "detection_index", r(angle, 4).alias("diagonal_deg"))


@query(
    S.with_tables(
        "detections",
        """, m AS (SELECT image_name, atan2(avg(sin(2 * pi() * x0 / 4096)), avg(cos(2 * pi() * x0 / 4096))) * 4096 / (2 * pi()) AS centre FROM detections GROUP BY image_name)
SELECT d.image_name, d.detection_index, round(x0 - 4096 * round_even((x0 - centre) / 4096, 0), 4) + 0.0 AS x FROM detections d JOIN m USING (image_name)""",
    )
)
def unwrap_x(spark: SparkSession, sf: str) -> DataFrame:
    """Circular x to the interval around the circular mean of its image."""
    import math

    d = S.detections(spark, sf)
    t = F.col("x0") * (2 * math.pi / 4096)
    m = d.groupBy("image_name").agg((F.atan2(F.avg(F.sin(t)), F.avg(F.cos(t))) * (4096 / (2 * math.pi))).alias("centre"))
    return d.join(m, "image_name").select("image_name", "detection_index", r(F.col("x0") - 4096 * F.bround((F.col("x0") - F.col("centre")) / 4096, 0), 4).alias("x"))


@query(S.with_tables("frames", "SELECT frame_id, round(ox + 12 * fx, 6) + 0.0 AS x, round(oy + 12 * fy, 6) + 0.0 AS y, oz AS z FROM frames"))
def panorama_pick(spark: SparkSession, sf: str) -> DataFrame:
    """The point 12 m away at the panorama's centre."""
    df, axes = framed(S.frames(spark, sf))
    ray = G.pixel_ray(F.lit(WIDTH / 2), F.lit(HEIGHT / 2), axes, WIDTH, HEIGHT)
    return df.select("frame_id", r(F.col("ox") + 12 * ray[0]).alias("x"), r(F.col("oy") + 12 * ray[1]).alias("y"), r(F.col("oz") + 12 * ray[2]).alias("z"))


@query(S.with_tables("frames", "SELECT frame_id, record_name, track_id, ordinal, lon, lat FROM frames"))
def public_frame(spark: SparkSession, sf: str) -> DataFrame:
    return S.frames(spark, sf).select("frame_id", "record_name", "track_id", "ordinal", "lon", "lat")
