"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import geometry as G
from waymark.operators.splits import validate_splits as validate_headers
from waymark.registry import query
from waymark.sources import survey as S


@query(S.with_tables("files", "SELECT * FROM files"))
def file_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return S.files(spark, sf)


@query(S.with_tables("points", "SELECT file_id, class_id, count(*) AS n FROM points GROUP BY ALL"))
def class_hist(spark: SparkSession, sf: str) -> DataFrame:
    return S.points(spark, sf).groupBy("file_id", "class_id").agg(F.count("*").alias("n"))


@query(S.with_tables("points", "SELECT block_id % 4 AS part, count(*) AS points, count(DISTINCT class_id) AS classes, sum(CASE WHEN class_id = 2 THEN 1 ELSE 0 END)::BIGINT AS ground, max(intensity) AS brightest FROM points GROUP BY ALL"))
def class_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = S.points(spark, sf).groupBy((F.col("block_id") % 4).alias("part"))
    return p.agg(F.count("*").alias("points"), F.countDistinct("class_id").alias("classes"), F.sum((F.col("class_id") == 2).cast("long")).alias("ground"), F.max("intensity").alias("brightest"))


@query("SELECT n_regionkey AS region, CASE WHEN count(*) = count(n_name) AND count(DISTINCT substr(n_name, 1, 1)) = 1 THEN min(substr(n_name, 1, 1)) END AS common FROM nation GROUP BY n_regionkey")
def common_crs(spark: SparkSession, sf: str) -> DataFrame:
    """One value if all are known and equal, else null."""
    v = F.substring("n_name", 1, 1)
    same = F.when((F.count("*") == F.count(v)) & (F.countDistinct(v) == 1), F.min(v))
    return S.read(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(same.alias("common"))


@query(S.with_tables("splits", "SELECT base, count(*) = max(split_index) - min(split_index) + 1 AS contiguous, min(split_index) = 0 AS from_zero, count(*) > count(DISTINCT split_index) AS repeats, sum(point_count)::BIGINT AS points, concat_ws(';', CASE WHEN count(*) > count(DISTINCT split_index) THEN 'repeated_index' END, CASE WHEN min(point_count) < 2 THEN 'small_split' END) AS reasons FROM splits GROUP BY base"))
def validate_splits(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("split_index")
    repeats = F.count("*") > F.countDistinct(i)
    reasons = F.concat_ws(";", F.when(repeats, "repeated_index"), F.when(F.min("point_count") < 2, "small_split"))
    return S.splits(spark, sf).groupBy("base").agg((F.count("*") == F.max(i) - F.min(i) + 1).alias("contiguous"), (F.min(i) == 0).alias("from_zero"), repeats.alias("repeats"), F.sum("point_count").alias("points"), reasons.alias("reasons"))


_PARTS = ", ".join(f"sum(('0x' || substr(h, {15 * i + 1}, 15))::BIGINT)::VARCHAR" for i in range(4))


@query(S.with_tables("frames", f", h AS (SELECT record_name, sha256(frame_id || ':' || track_id) AS h FROM frames) SELECT record_name, sha256(concat_ws(':', count(*)::VARCHAR, {_PARTS})) AS signature FROM h GROUP BY record_name"))
def dataset_sig(spark: SparkSession, sf: str) -> DataFrame:
    """A hash that doesn't depend on the order of rows: each frame's SHA-256 is added up in four
    parts of 60 bits, so no group is gathered."""
    h = S.frames(spark, sf).select("record_name", F.sha2(F.concat_ws(":", "frame_id", "track_id"), 256).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return h.groupBy("record_name").agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *map(part, range(4))), 256).alias("signature"))


@query(S.with_tables("detections", "SELECT image_name, class_id, list_sort(list(point_count))[least(greatest(3, ceil(count(*) * 0.25)::BIGINT), count(*))] AS front FROM detections GROUP BY ALL"))
def front_surface(spark: SparkSession, sf: str) -> DataFrame:
    """An order statistic, not interpolated: rank max(3, ceil(n q)), at most n."""
    n = F.count("*")
    rank = F.least(F.greatest(F.lit(3), F.ceil(n * 0.25)), n).cast("int")
    return S.detections(spark, sf).groupBy("image_name", "class_id").agg(F.element_at(F.sort_array(F.collect_list("point_count")), rank).alias("front"))


@query(S.with_tables("detections", ", a AS (SELECT image_name, min(z) AS anchor FROM detections GROUP BY image_name) SELECT d.image_name, count(*) AS kept FROM detections d JOIN a USING (image_name) WHERE z <= anchor + 0.0412345::DOUBLE GROUP BY d.image_name"))
def depth_window(spark: SparkSession, sf: str) -> DataFrame:
    d = S.detections(spark, sf)
    return d.join(d.groupBy("image_name").agg(F.min("z").alias("anchor")), "image_name").filter(F.col("z") <= F.col("anchor") + 0.0412345).groupBy("image_name").agg(F.count("*").alias("kept"))


@query(S.with_tables("points", "SELECT floor(x / 5)::BIGINT AS cx, floor(y / 5)::BIGINT AS cy, count(*) AS n, quantile_cont(z, 0.5) AS median_z FROM points GROUP BY ALL"))
def xy_cells(spark: SparkSession, sf: str) -> DataFrame:
    p = S.points(spark, sf).groupBy(F.floor(F.col("x") / 5).alias("cx"), F.floor(F.col("y") / 5).alias("cy"))
    return p.agg(F.count("*").alias("n"), F.median("z").alias("median_z"))


_CELLS = """, c AS (SELECT floor(x / 10) AS cx, floor(y / 10) AS cy, floor(z / 0.25) AS bin FROM points),
d AS (SELECT cx, cy, bin, count(*) AS n FROM c GROUP BY ALL), i AS (SELECT *, bin - row_number() OVER (PARTITION BY cx, cy ORDER BY bin) AS g, bin - lag(bin) OVER (PARTITION BY cx, cy ORDER BY bin) AS gap FROM d),
r AS (SELECT cx, cy, g, count(*) AS run, sum(n) AS n, max(gap) AS gap FROM i GROUP BY ALL)
SELECT cx::BIGINT AS cx, cy::BIGINT AS cy, sum(run)::BIGINT AS bins, max(run) AS longest, coalesce(max(gap) - 1, 0)::BIGINT AS max_gap FROM r GROUP BY cx, cy HAVING sum(n) >= 10"""


@query(S.with_tables("points", _CELLS))
def vertical_continuity(spark: SparkSession, sf: str) -> DataFrame:
    """Occupied height bins of each cell, their longest run and greatest gap."""
    from waymark.operators.sequences import islands

    p = S.points(spark, sf).select(F.floor(F.col("x") / 10).alias("cx"), F.floor(F.col("y") / 10).alias("cy"), F.floor(F.col("z") / 0.25).alias("bin"))
    bins = p.groupBy("cx", "cy", "bin").agg(F.count("*").alias("n"))
    runs = islands(bins, ("cx", "cy"), "bin").groupBy("cx", "cy", "island").agg(F.count("*").alias("run"), F.sum("n").alias("n"), F.max("gap").alias("gap"))
    g = runs.groupBy("cx", "cy").agg(F.sum("run").alias("bins"), F.max("run").alias("longest"), F.coalesce(F.max("gap") - 1, F.lit(0)).alias("max_gap"), F.sum("n").alias("n"))
    return g.filter("n >= 10").drop("n")


@query(S.with_tables("points", "SELECT block_id, count(DISTINCT floor(z / 0.5)) AS observed, round(count(DISTINCT floor(z / 0.5)) / (floor(max(z) / 0.5) - floor(min(z) / 0.5) + 1), 6) AS support FROM points GROUP BY block_id"))
def middle_support(spark: SparkSession, sf: str) -> DataFrame:
    b = F.floor(F.col("z") / 0.5)
    return S.points(spark, sf).groupBy("block_id").agg(F.countDistinct(b).alias("observed"), F.round(F.countDistinct(b) / (F.max(b) - F.min(b) + 1), 6).alias("support"))


@query(S.with_tables("detections", ", p AS (SELECT a.image_name, a.detection_index AS i, b.detection_index AS j, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS w, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM detections a JOIN detections b ON a.image_name = b.image_name AND a.detection_index < b.detection_index) SELECT image_name, i, j, round(w / (s - w), 6) AS iou FROM p WHERE w > 0"))
def iou(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of boxes within an image; images are small, so the join is on the image."""
    box = ("x0", "y0", "x1", "y1")
    d = S.detections(spark, sf).select("image_name", F.col("detection_index").alias("i"), *box)
    e = d.select("image_name", F.col("i").alias("j"), *[F.col(c).alias(f"o{c}") for c in box])
    v = G.iou(tuple(F.col(c) for c in box), tuple(F.col(f"o{c}") for c in box))
    return d.join(e, "image_name").filter("i < j").select("image_name", "i", "j", F.round(v, 6).alias("iou")).filter("iou > 0")


@query(S.with_tables("pole_observations", "SELECT record_name, image_name, count(*) AS n FROM pole_observations GROUP BY ALL HAVING count(*) >= 2"))
def obs_min_filter(spark: SparkSession, sf: str) -> DataFrame:
    return S.pole_observations(spark, sf).groupBy("record_name", "image_name").agg(F.count("*").alias("n")).filter("n >= 2")


@query(S.with_tables("detections", "SELECT record_name, class_id, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, count(*) AS n FROM detections GROUP BY ALL"))
def axis_regression(spark: SparkSession, sf: str) -> DataFrame:
    d = S.detections(spark, sf).groupBy("record_name", "class_id")
    return d.agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.count("*").alias("n"))


_MAD = """, m AS (SELECT record_name, quantile_cont(y0, 0.5) AS centre FROM detections GROUP BY record_name)
SELECT d.record_name, any_value(centre) AS median, quantile_cont(abs(y0 - centre), 0.5) AS mad, count(*) >= 3 AND quantile_cont(abs(y0 - centre), 0.5) <= 200 AS stable FROM detections d JOIN m USING (record_name) GROUP BY d.record_name"""


@query(S.with_tables("detections", _MAD))
def align_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Median and median absolute deviation, and whether they call the record stable."""
    d = S.detections(spark, sf)
    m = d.groupBy("record_name").agg(F.median("y0").alias("centre"))
    mad = F.median(F.abs(F.col("y0") - F.col("centre")))
    return d.join(m, "record_name").groupBy("record_name").agg(F.first("centre").alias("median"), mad.alias("mad"), ((F.count("*") >= 3) & (mad <= 200)).alias("stable"))


@query(S.with_tables("runs", "SELECT status, count(*) AS runs, count(DISTINCT dataset_id) AS datasets, round(sum(cost), 2) AS cost FROM runs GROUP BY status"))
def result_summary(spark: SparkSession, sf: str) -> DataFrame:
    return S.runs(spark, sf).groupBy("status").agg(F.count("*").alias("runs"), F.countDistinct("dataset_id").alias("datasets"), F.round(F.sum("cost"), 2).alias("cost"))


@query("SELECT floor(max(try_cast(regexp_extract(c_name, '([0-9]+)$', 1) AS DOUBLE)))::BIGINT + 1 AS next_id FROM customer")
def next_id(spark: SparkSession, sf: str) -> DataFrame:
    n = F.regexp_extract("c_name", "([0-9]+)$", 1).try_cast("double")
    return S.read(spark, sf, "customer").agg((F.floor(F.max(n)) + 1).alias("next_id"))


@query(S.with_tables("pole_observations", ", w AS (SELECT record_name, sum(quality) AS s, sum(quality * pole_x) / sum(quality) AS cx, sum(quality * pole_y) / sum(quality) AS cy FROM pole_observations GROUP BY record_name) SELECT p.record_name, round(any_value(cx), 4) AS cx, round(any_value(cy), 4) AS cy, round(sqrt(sum(quality * ((pole_x - cx) ** 2 + (pole_y - cy) ** 2)) / any_value(s)), 4) AS spread FROM pole_observations p JOIN w USING (record_name) GROUP BY p.record_name"))
def weighted_spread(spark: SparkSession, sf: str) -> DataFrame:
    p, q = S.pole_observations(spark, sf), F.col("quality")
    w = p.groupBy("record_name").agg(F.sum(q).alias("s"), (F.sum(q * F.col("pole_x")) / F.sum(q)).alias("cx"), (F.sum(q * F.col("pole_y")) / F.sum(q)).alias("cy"))
    d2 = (F.col("pole_x") - F.col("cx")) ** 2 + (F.col("pole_y") - F.col("cy")) ** 2
    return p.join(w, "record_name").groupBy("record_name").agg(F.round(F.first("cx"), 4).alias("cx"), F.round(F.first("cy"), 4).alias("cy"), F.round(F.sqrt(F.sum(q * d2) / F.first("s")), 4).alias("spread"))


@query(S.with_tables("frames", "SELECT record_name, track_id, count(*) AS n FROM frames GROUP BY ROLLUP (record_name, track_id)"))
def track_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return S.frames(spark, sf).rollup("record_name", "track_id").agg(F.count("*").alias("n"))


#: Split files and the full file of each brand: most fit, and every reason to refuse has some.
_SPLIT_SQL = """, s AS (SELECT p_brand AS base, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, p_size AS points, substr(p_brand, 7)::INTEGER AS b FROM part),
h AS (SELECT base, b, i + CASE WHEN b % 9 = 1 AND i > 1 THEN 1 ELSE 0 END AS split_index, points::BIGINT AS points, CASE WHEN b % 9 = 2 AND i = 1 THEN 'other' ELSE 'tm' END AS crs, CASE WHEN b % 9 = 3 AND i = 1 THEN 7 ELSE 3 END AS format, CASE WHEN b % 9 = 4 AND i = 1 THEN 0.001::DOUBLE ELSE 0.01::DOUBLE END AS scale,
  k::DOUBLE + CASE WHEN b % 9 = 5 AND i = 1 THEN 0.005::DOUBLE ELSE 0 END AS lo, (k + points)::DOUBLE AS hi FROM s),
f AS (SELECT base, sum(points) + CASE WHEN any_value(b) % 9 = 6 THEN 1 ELSE 0 END AS points, min(floor(lo)) - CASE WHEN any_value(b) % 9 = 7 THEN 1 ELSE 0 END AS lo, max(hi) AS hi FROM h GROUP BY base),
g AS (SELECT base, count(*) AS n, sum(points) AS points, min(split_index) = 1 AND max(split_index) = count(*) AS whole, bool_and(crs = 'tm') AS crs, bool_and(format = 3) AS format, bool_and(scale = 0.01) AS scales, bool_and(abs((lo - 1.0) / scale - round((lo - 1.0) / scale)) <= 1e-4) AS grid, min(lo) AS lo, max(hi) AS hi FROM h GROUP BY base)
SELECT base, n AS split_count, g.points::BIGINT AS split_points, concat_ws(',', CASE WHEN NOT whole THEN 'non_contiguous_split_indices' END, CASE WHEN NOT grid THEN 'invalid_scale_offset_grid' END, CASE WHEN NOT scales THEN 'scale_mismatch' END, CASE WHEN NOT crs THEN 'crs_mismatch' END, CASE WHEN NOT format THEN 'point_format_mismatch' END,
  CASE WHEN g.points <> f.points THEN 'point_count_mismatch' END, CASE WHEN abs(g.lo - f.lo) > 0.01::DOUBLE OR abs(g.hi - f.hi) > 0.01::DOUBLE THEN 'bounds_mismatch' END) AS reasons FROM g JOIN f USING (base)"""


@query(S.with_tables("splits", _SPLIT_SQL))
def split_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the split files of each brand may stand for its full file, from their headers."""
    from pyspark.sql import Window as W

    p = S.read(spark, sf, "part")
    b, i = F.pmod(F.substring("p_brand", 7, 9).cast("int"), F.lit(9)), F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))
    own = p.select(F.col("p_brand").alias("base"), b.alias("b"), i.alias("i"), F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("points"))
    first = lambda kind: (F.col("b") == kind) & (F.col("i") == 1)
    lo, hi = F.col("k") + F.when(first(5), 0.005).otherwise(0.0), (F.col("k") + F.col("points")).cast("double")
    header = lambda points, crs, form, scale, lo, hi: [points.alias("points"), crs.alias("crs"), form.alias("format"), F.lit("x,y,z").alias("dimensions"), *[scale.alias(f"scale_{a}") for a in "xyz"], *[F.lit(1.0).alias(f"offset_{a}") for a in "xyz"], *[lo.alias(f"min_{a}") for a in "xyz"], *[hi.alias(f"max_{a}") for a in "xyz"]]
    index = F.col("i") + ((F.col("b") == 1) & (F.col("i") > 1)).cast("int")
    splits = own.select("base", "b", index.alias("split_index"), *header(F.col("points"), F.when(first(2), "other").otherwise("tm"), F.when(first(3), 7).otherwise(3), F.when(first(4), 0.001).otherwise(0.01), lo, hi))
    total = splits.groupBy("base", "b").agg(F.sum("points").alias("n"), F.min(F.floor("min_x")).alias("lo"), F.max("max_x").alias("hi"))
    full = total.select("base", *header(F.col("n") + (F.col("b") == 6).cast("int"), F.lit("tm"), F.lit(3), F.lit(0.01), (F.col("lo") - (F.col("b") == 7).cast("int")).cast("double"), F.col("hi")))
    return validate_headers(full, splits).withColumn("reasons", F.concat_ws(",", "reasons"))
