"""Queries over rectified views, boxes and corridors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.vectors import const, sub, vec
from waymark.operators import geometry as G
from waymark.operators import views as V
from waymark.plans.filters import _CROSS, POLYGON
from waymark.plans.projections import _SEEN_SQL, _UV, r, seen
from waymark.registry import query
from waymark.sources import survey as S

PANO = (4096.0, 2048.0)
BOX = ("x0", "y0", "x1", "y1")
KEYS = ("image_name", "detection_index")

#: A panorama pixel's ray along right, forward and up.
_RAY_SQL = "cos(lat) * sin(lon) AS rx, cos(lat) * cos(lon) AS ry, sin(lat) AS rz"
_ANGLES = "(px / 4096 - 0.5) * 2 * pi() AS lon, (0.5 - py / 2048) * pi() AS lat"
_NINE = """p AS (SELECT row, image_name, detection_index, unnest([x0, x0, x1, x1, (x0 + x1) / 2, (x0 + x1) / 2, x0, x1, (x0 + x1) / 2]) AS px, unnest([y0, y1, y0, y1, y0, y1, (y0 + y1) / 2, (y0 + y1) / 2, (y0 + y1) / 2]) AS py, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER () AS row FROM detections))"""


def box() -> tuple:
    return tuple(F.col(c) for c in BOX)


@query(S.with_tables("detections", f""", a AS (SELECT *, {_ANGLES} FROM (SELECT *, (x0 + x1) / 2 AS px, (y0 + y1) / 2 AS py FROM detections)), b AS (SELECT *, {_RAY_SQL} FROM a)
SELECT image_name, detection_index, CASE WHEN ry > 1e-6 THEN round(512 + 512 * (rx / ry), 3) + 0.0 END AS u, CASE WHEN ry > 1e-6 THEN round(256 - 256 / tan(radians(30.0::DOUBLE)) * (rz / ry), 3) + 0.0 END AS v FROM b WHERE abs(ry) > 0.01"""))
def ray_persp(spark: SparkSession, sf: str) -> DataFrame:
    """Box centres in a forward view; null for those behind it."""
    x0, y0, x1, y1 = box()
    ray = G.pixel_ray((x0 + x1) / 2, (y0 + y1) / 2, V.forward_axes(), *PANO)
    u, v = V.ray_persp(ray, V.forward_axes(), 1024.0, 512.0, F.lit(90.0), F.lit(60.0))
    return S.detections(spark, sf).filter(F.abs(ray[1]) > 0.01).select(*KEYS, r(u, 3).alias("u"), r(v, 3).alias("v"))


@query(S.with_tables("detections", f""", {_NINE}, a AS (SELECT *, {_ANGLES} FROM p), b AS (SELECT *, {_RAY_SQL} FROM a), c AS (SELECT row, image_name, detection_index, 512 + 512 * (rx / ry) AS u, 256 - 256 / tan(radians(30.0::DOUBLE)) * (rz / ry) AS v FROM b WHERE ry > 0.01)
SELECT image_name, detection_index, count(*)::INTEGER AS n, round(min(u), 3) + 0.0 AS u0, round(min(v), 3) + 0.0 AS v0, round(max(u), 3) + 0.0 AS u1, round(max(v), 3) + 0.0 AS v1 FROM c GROUP BY row, image_name, detection_index"""))
def pano_to_persp(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of the pixels of each box that a forward view sees (more than 0.6 degrees ahead)."""
    d = V.pano_to_persp_box(S.detections(spark, sf), KEYS, box(), PANO, (1024.0, 512.0), 90.0, 60.0, 0.01).filter("n > 0")
    return d.select(*KEYS, "n", *[r(F.col(c), 3).alias(c) for c in ("u0", "v0", "u1", "v1")])


@query(S.with_tables("detections", ", n AS (SELECT *, 3 + 4 * point_count AS n FROM detections) SELECT image_name, detection_index, (9 + ceil(n / greatest(1, n // 64)))::INTEGER AS pixels, round(4.5::DOUBLE * (x0 + x1) + list_sum(list_transform(range(0, n, greatest(1, n // 64)), lambda i: x0 + i)), 4) AS sum_x FROM n"))
def support_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of each box and of a polygon of 3 to 203 vertices."""
    n = 3 + 4 * F.col("point_count")
    polygon = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((F.col("x0") + i).alias("x"), F.col("y0").alias("y")))
    d = S.detections(spark, sf).withColumn("polygon", polygon).select(*KEYS, V.support_pixels(*box(), F.col("polygon")).alias("p"))
    return d.select(*KEYS, F.size("p").alias("pixels"), F.round(F.aggregate("p", F.lit(0.0), lambda s, p: s + p["x"]), 4).alias("sum_x"))


_FOV = """, f AS (SELECT *, cos(lat) * sin(lon) AS fx, cos(lat) * cos(lon) AS fy, sin(lat) AS fz FROM (SELECT *, ((x0 + x1) / 2 / 4096 - 0.5) * 2 * pi() AS lon, (0.5 - (y0 + y1) / 2 / 2048) * pi() AS lat, row_number() OVER () AS row FROM detections)),
g AS (SELECT row, image_name, detection_index, fx, fy, fz, sqrt(fx * fx + fy * fy) AS h, unnest([x0, x0, x1, x1, (x0 + x1) / 2, (x0 + x1) / 2, x0, x1, (x0 + x1) / 2]) AS px, unnest([y0, y1, y0, y1, y0, y1, (y0 + y1) / 2, (y0 + y1) / 2, (y0 + y1) / 2]) AS py FROM f),
a AS (SELECT *, (px / 4096 - 0.5) * 2 * pi() AS lon, (0.5 - py / 2048) * pi() AS lat FROM g),
l AS (SELECT row, image_name, detection_index, (sx * fy - sy * fx) / h AS x, -sx * fx * fz / h - sy * fy * fz / h + sz * h AS y, sx * fx + sy * fy + sz * fz AS z FROM (SELECT *, cos(lat) * sin(lon) AS sx, cos(lat) * cos(lon) AS sy, sin(lat) AS sz FROM a)),
m AS (SELECT row, image_name, detection_index, max(CASE WHEN z > 1e-6 THEN abs(atan2(x, z)) ELSE 0 END) AS h, max(CASE WHEN z > 1e-6 THEN abs(atan2(y, z)) ELSE 0 END) AS v FROM l GROUP BY ALL)
SELECT image_name, detection_index, round(least(greatest(degrees(h * 2) + 4, 8), 120), 4) AS hfov, round(least(greatest(degrees(v * 2) + 4, 8), 120), 4) AS vfov FROM m"""


@query(S.with_tables("detections", _FOV))
def rect_fov(spark: SparkSession, sf: str) -> DataFrame:
    """Each detection's own rectified view: axes towards its centre and fields that hold it."""
    x0, y0, x1, y1 = box()
    d, axes = G.roll_stable_axes(S.detections(spark, sf), G.pixel_ray((x0 + x1) / 2, (y0 + y1) / 2, V.forward_axes(), *PANO), const(0, 0, 1), const(1, 0, 0))
    d = V.rect_fov_box(d, KEYS, box(), PANO, axes, 2.0, 8.0, 120.0)
    return d.select(*KEYS, F.round("hfov", 4).alias("hfov"), F.round("vfov", 4).alias("vfov"))


_TO_PANO = """, c AS (SELECT row, image_name, detection_index, unnest([x0 / 4, x0 / 4, x1 / 4, x1 / 4]) AS px, unnest([y0 / 4, y1 / 4, y0 / 4, y1 / 4]) AS py FROM (SELECT *, row_number() OVER () AS row FROM detections)),
d AS (SELECT *, (px - 512) / 512 AS x, (512 - py) / 512 AS y, cos(radians(7.5::DOUBLE)) AS cy, sin(radians(7.5::DOUBLE)) AS sy, cos(radians(-3.25::DOUBLE)) AS cp, sin(radians(-3.25::DOUBLE)) AS sp FROM c),
e AS (SELECT *, sqrt(x * x + y * y + 1) AS n FROM d),
f AS (SELECT row, image_name, detection_index, (atan2((x * cy + sy) / n, (-x * sy * cp + cy * cp + y * sp) / n) / (2 * pi()) + 0.5) * 4096 AS u, (0.5 - asin((x * sy * sp - cy * sp + y * cp) / n) / pi()) * 2048 AS v FROM e),
m AS (SELECT *, ((atan2(avg(sin(u * 2 * pi() / 4096)) OVER w, avg(cos(u * 2 * pi() / 4096)) OVER w) + 2 * pi()) % (2 * pi())) * 4096 / (2 * pi()) AS centre FROM f WINDOW w AS (PARTITION BY row)),
g AS (SELECT row, image_name, detection_index, u + round_even((centre - u) / 4096, 0) * 4096 AS u, v FROM m)
SELECT image_name, detection_index, round(min(u), 3) AS u0, round(min(v), 3) AS v0, round(max(u), 3) AS u1, round(max(v), 3) AS v1 FROM g GROUP BY row, image_name, detection_index"""


@query(S.with_tables("detections", _TO_PANO))
def bbox_to_pano(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of a forward view (1024 pixels, 90 degrees) in a panorama that is turned by 7.5
    and -3.25 degrees against it."""
    pano = G.axes_offset(*V.forward_axes(), F.lit(7.5), F.lit(-3.25))
    d, found = V.box_to_pano(S.detections(spark, sf), tuple(c / 4 for c in box()), V.forward_axes(), (1024.0, 1024.0), F.lit(90.0), F.lit(90.0), pano, PANO)
    return d.select(*KEYS, *[F.round(c, 3).alias(n) for c, n in zip(found, ("u0", "v0", "u1", "v1"))])


@query(S.with_tables("detections", "SELECT image_name, detection_index, least(greatest(x0, 0), 2047) AS x0, least(greatest(y0, 0), 511) AS y0, greatest(least(greatest(x0, 0), 2047) + 1, least(x1, 2048)) AS x1, greatest(least(greatest(y0, 0), 511) + 1, least(y1, 512)) AS y1 FROM detections"))
def bbox_clamp(spark: SparkSession, sf: str) -> DataFrame:
    return S.detections(spark, sf).select(*KEYS, *[c.alias(n) for c, n in zip(V.clamp_box(*box(), 2048, 512), BOX)])


@query(S.with_tables("detections", "SELECT image_name, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM detections GROUP BY image_name"))
def bbox_of_points(spark: SparkSession, sf: str) -> DataFrame:
    """The box around all boxes of an image."""
    d = S.detections(spark, sf).groupBy("image_name")
    return d.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query(S.with_tables("detections", "SELECT image_name, detection_index, greatest(0, x0 - greatest(1, x1 - x0) * 0.5::DOUBLE) AS x0, greatest(0, y0 - greatest(1, y1 - y0) * 0.25::DOUBLE) AS y0, least(4095, x1 + greatest(1, x1 - x0) * 0.5::DOUBLE) AS x1, 2047.0::DOUBLE AS y1 FROM detections"))
def corridor_bbox(spark: SparkSession, sf: str) -> DataFrame:
    return S.detections(spark, sf).select(*KEYS, *[c.alias(n) for c, n in zip(V.corridor_box(*box(), 4096, 2048, 0.5, 0.25), BOX)])


@query(S.with_tables("frames points", _SEEN_SQL.replace("dx, p.y - f.oy AS dy", "dx, p.y - f.oy AS dy, p.x - f.ox - 8 * f.fx AS ex, p.y - f.oy - 8 * f.fy AS ey").replace("point_id, sqrt(dx", "point_id, sqrt(ex * ex + ey * ey) AS off, sqrt(dx") + f""", q AS (SELECT *, {_UV} FROM seen)
SELECT frame_id, count(*) FILTER (WHERE v >= 400 AND v <= 900 AND u >= 900 AND u <= 1148) AS strict, count(*) FILTER (WHERE v >= 400 AND v <= 900 AND (u >= 900 AND u <= 1148 OR off > 0.75::DOUBLE)) AS expanded FROM q GROUP BY frame_id"""))
def corridor_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Points in the corridor under a sign 8 m ahead, and with the remote ones in its rows."""
    near, axes = seen(spark, sf)
    u, v, _ = G.project_equirect(vec("x", "y", "z"), vec("ox", "oy", "oz"), axes, 2048.0, 1024.0)
    off = F.sqrt((F.col("x") - F.col("ox") - 8 * F.col("fx")) ** 2 + (F.col("y") - F.col("oy") - 8 * F.col("fy")) ** 2)
    strict, expanded = V.corridor_masks(u, v, (900.0, 400.0, 1148.0, 900.0), off, 0.75)
    return near.groupBy("frame_id").agg(F.count_if(strict).alias("strict"), F.count_if(expanded).alias("expanded"))


@query(S.with_tables("points", f", q AS (SELECT class_id, floor(x) + 0.5 AS x, floor(y) + 0.5 AS y FROM points WHERE floor(x) BETWEEN 150 AND 259 AND floor(y) BETWEEN 100 AND 219) SELECT class_id, count(*) AS n FROM q WHERE ({_CROSS}) % 2 = 1 GROUP BY class_id"))
def mask_core(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pixels inside the unpadded mask: its crop first, then the mask at pixel centres."""
    edges = list(zip(POLYGON, POLYGON[1:] + POLYGON[:1]))
    x, y = F.col("px") + 0.5, F.col("py") + 0.5
    crossings = sum(F.when(((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0) for (ax, ay), (bx, by) in edges)
    p = S.points(spark, sf).select("class_id", F.floor("x").alias("px"), F.floor("y").alias("py")).filter(F.col("px").between(150, 259) & F.col("py").between(100, 219))
    return p.filter(crossings % 2 == 1).groupBy("class_id").agg(F.count("*").alias("n"))


@query(
    S.with_tables(
        "frames",
        """, p AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY ordinal)),
h AS (SELECT *, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2) AS a FROM p)
SELECT frame_id, CASE WHEN a IS NOT NULL THEN round(2 * 6371008.8::DOUBLE * asin(least(1.0, sqrt(a))), 3) END AS step_m FROM h""",
    )
)
def haversine(spark: SparkSession, sf: str) -> DataFrame:
    """Metres from the frame before in the track; null for the first."""
    w = W.partitionBy("track_id").orderBy("ordinal")
    step = G.haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    return S.frames(spark, sf).select("frame_id", F.round(F.when(F.lag("lon").over(w).isNotNull(), step), 3).alias("step_m"))


@query(S.with_tables("frames points", _SEEN_SQL + f""", q AS (SELECT *, {_UV} FROM seen) SELECT frame_id, point_id, CASE WHEN d > 4 THEN round((u / 2048 + 1) % 1.0::DOUBLE, 6) + 0.0 END AS u, CASE WHEN d > 4 THEN round(v / 1024, 6) END AS v FROM q"""))
def local_to_pano(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised panorama coordinates of points, none for those nearer than 4 m."""
    near, axes = seen(spark, sf)
    u, v, _ = V.local_to_pano(sub(vec("x", "y", "z"), vec("ox", "oy", "oz")), axes, 4.0)
    return near.select("frame_id", "point_id", r(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query(S.with_tables("detections", ", a AS (SELECT *, (((x0 / 4096) % 1.0::DOUBLE) - 0.5) * 2 * pi() AS lon, (0.5 - least(1, greatest(0, y0 / 2048))) * pi() AS lat FROM detections) SELECT image_name, detection_index, round(-9.88::DOUBLE * cos(lat) * cos(lon), 6) + 0.0 AS sx, round(9.88::DOUBLE * sin(lat), 6) + 0.0 AS sy, round(-9.88::DOUBLE * cos(lat) * sin(lon), 6) + 0.0 AS sz FROM a"))
def uv_to_sphere(spark: SparkSession, sf: str) -> DataFrame:
    s = V.uv_sphere(F.col("x0") / PANO[0], F.col("y0") / PANO[1], 9.88)
    return S.detections(spark, sf).select(*KEYS, *[r(c).alias(n) for c, n in zip(s, ("sx", "sy", "sz"))])


_OVERVIEW = "image_name string, detection_index long, fx double, fy double, fz double, hfov double, vfov double, fits boolean"


def _overviews(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rays = np.array(pdf["rays"].tolist()).reshape(len(pdf), -1, 3)
        f, h, v, good = V.fit_overviews(rays, np.array([0.0, 0.0, 1.0]), 2.0, 100.0, 16 / 9)
        yield pd.DataFrame({"image_name": pdf["image_name"], "detection_index": pdf["detection_index"], "fx": f[:, 0], "fy": f[:, 1], "fz": f[:, 2], "hfov": h, "vfov": v, "fits": good})


@query()
def fit_overview(spark: SparkSession, sf: str) -> DataFrame:
    """For each detection one view that holds its corners and the ground 20 degrees below it."""
    x0, y0, x1, y1 = box()
    points = [(x0, y0), (x0, y1), (x1, y0), (x1, y1), ((x0 + x1) / 2, F.least(y1 + 20 * 2048 / 180.0, F.lit(2047.0)))]
    rays = F.array(*[c for p in points for c in G.pixel_ray(*p, V.forward_axes(), *PANO)])
    return S.detections(spark, sf).select(*KEYS, rays.alias("rays")).mapInPandas(_overviews, _OVERVIEW)
