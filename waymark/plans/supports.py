"""Queries over supports: ranking, gates, axes, ground and reconciliation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import clustering as C
from waymark.operators import poles as P
from waymark.operators import supports as X
from waymark.operators.sequences import islands
from waymark import registry
from waymark.registry import query
from waymark.sources import survey as S

KEYS = ("image_name", "detection_index")

#: Detections as support candidates: their measures stand in for those of fitted shafts.
_CAND = ", c AS (SELECT image_name, detection_index, 0.05::DOUBLE * point_count AS distance, confidence - 0.17::DOUBLE AS complete, 1 - l_tax * 5 AS coverage, l_tax AS rmse, 1 - confidence AS multi, z AS score, point_count AS n, l_tax FROM detections)"


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    tax = (F.col("y1") - F.col("y0") - 30) / 100
    d = S.detections(spark, sf).withColumn("tax", F.round(tax, 6))
    return d.select(*KEYS, (0.05 * F.col("point_count")).alias("distance"), (F.col("confidence") - 0.17).alias("complete"), (1 - F.col("tax") * 5).alias("coverage"), F.col("tax").alias("rmse"), (1 - F.col("confidence")).alias("multi"), F.col("z").alias("score"), F.col("point_count").alias("n"))


@query(S.with_tables("detections", _CAND + " SELECT image_name, detection_index, round(distance + 1 - (0.45::DOUBLE * least(1, greatest(0, coverage)) + 0.45::DOUBLE * least(1, greatest(0, complete)) + 0.1::DOUBLE * (1 - multi)), 6) AS cost FROM c"))
def junction_cost(spark: SparkSession, sf: str) -> DataFrame:
    cost = X.junction_cost(F.col("distance"), F.col("coverage"), F.col("complete"), F.col("multi"))
    return candidates(spark, sf).select(*KEYS, F.round(cost, 6).alias("cost"))


@query(S.with_tables("detections", _CAND + """, k AS (SELECT *, CASE WHEN round(complete, 6) < 0.75 THEN 1 ELSE 0 END AS k0, CASE WHEN distance <= 0.75 THEN 0 ELSE 1 END AS k1, CASE WHEN distance <= 0.75 THEN -score ELSE distance + 1 - (0.45::DOUBLE * least(1, greatest(0, coverage)) + 0.45::DOUBLE * least(1, greatest(0, complete)) + 0.1::DOUBLE * (1 - multi)) END AS k2 FROM c)
SELECT image_name, detection_index FROM (SELECT *, row_number() OVER (PARTITION BY image_name ORDER BY k0, k1, round(k2, 6), detection_index) AS r FROM k) WHERE r = 1"""))
def rank_pole(spark: SparkSession, sf: str) -> DataFrame:
    """The best candidate of each image; measures that tie at a micrometre fall to the index."""
    c = candidates(spark, sf)
    key = X.rank_key(F.col("distance"), F.round("complete", 6), F.col("coverage"), F.col("rmse"), F.col("multi"), F.col("score"), F.col("n"))
    c = c.withColumn("k", key)
    order = F.struct("k.k0", "k.k1", F.round("k.k2", 6), "detection_index")
    return c.groupBy("image_name").agg(F.min_by("detection_index", order).alias("detection_index"))


@query(S.with_tables("detections", _CAND + " SELECT image_name, detection_index, CASE WHEN distance > 0.75 AND distance <= 3 AND n % 2 = 0 AND round(coverage, 6) >= 0.8 AND n >= 20 THEN 0.15 ELSE 0.45 END::DOUBLE AS required FROM c"))
def arm_threshold(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf)
    wide = F.when(F.round("coverage", 6) >= 0.8, 1.0).otherwise(0.0)
    return c.select(*KEYS, F.round(X.arm_threshold(F.col("distance"), wide, wide, F.col("n").cast("double"), F.col("n") % 2 == 0, 0.45), 6).alias("required"))


@query(S.with_tables("detections", ", g AS (SELECT image_name, detection_index, least(1, (0.25::DOUBLE * point_count - 8) / 2) AS t FROM detections), w AS (SELECT *, CASE WHEN t > 0 THEN t * t * (3 - 2 * t) END AS w FROM g) SELECT image_name, detection_index, round(1.5 + 1.5 * w, 6) AS span, round(0.5 + 0.25 * w, 6) AS complete, round(0.35::DOUBLE + 0.25 * w, 6) AS arm FROM w"))
def long_gates(spark: SparkSession, sf: str) -> DataFrame:
    gates = X.long_gates(0.25 * F.col("point_count"))
    return S.detections(spark, sf).select(*KEYS, *[F.round(g, 6).alias(n) for g, n in zip(gates, ("span", "complete", "arm"))])


@query(S.with_tables("frames", ", t AS (SELECT frame_id, k / 20.0::DOUBLE AS tilt, least(1, greatest(0, (k / 20.0::DOUBLE - 2) / 2)) AS t, fx * 0.05::DOUBLE AS sx, fy * 0.05::DOUBLE AS sy FROM frames) SELECT frame_id, round(sx * t * t * (3 - 2 * t), 9) + 0.0 AS ax, round(sy * t * t * (3 - 2 * t), 9) + 0.0 AS ay, round(1 - t * t * (3 - 2 * t), 9) AS strength FROM t"))
def axis_plumb(spark: SparkSession, sf: str) -> DataFrame:
    ax, ay, s = X.plumb(F.col("k") / 20.0, F.col("fx") * 0.05, F.col("fy") * 0.05)
    return S.frames(spark, sf).select("frame_id", (F.round(ax, 9) + 0.0).alias("ax"), (F.round(ay, 9) + 0.0).alias("ay"), F.round(s, 9).alias("strength"))


@query(S.with_tables("frames", ", g AS (SELECT *, fx * 0.05::DOUBLE AS ax, fy * 0.05::DOUBLE AS ay, 0.02::DOUBLE AS a, -0.01::DOUBLE AS b FROM frames), h AS (SELECT *, (a * ox + b * oy + 1) / (1 - a * ax - b * ay) AS z FROM g) SELECT frame_id, round(ax * z + ox, 6) AS x, round(ay * z + oy, 6) AS y, round(z, 6) + 0.0 AS z FROM h"))
def axis_ground(spark: SparkSession, sf: str) -> DataFrame:
    """Where a tilted shaft through each frame's place meets a plane."""
    lit = lambda v: F.lit(float(v))
    x, y, z = X.meet(F.col("fx") * 0.05, F.col("ox"), F.col("fy") * 0.05, F.col("oy"), lit(0.02), lit(-0.01), lit(1), lit(0))
    return S.frames(spark, sf).select("frame_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), (F.round(z, 6) + 0.0).alias("z"))


@query(S.with_tables("points", ", m AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, avg(z) OVER w AS mz FROM points WINDOW w AS (PARTITION BY block_id)), s AS (SELECT block_id, count(*) AS n, any_value(mz) AS c, sum((x - mx) ** 2) AS xx, sum((x - mx) * (y - my)) AS xy, sum((y - my) ** 2) AS yy, sum((x - mx) * (z - mz)) AS xz, sum((y - my) * (z - mz)) AS yz FROM m GROUP BY block_id) SELECT block_id, n, round((xz * yy - yz * xy) / (xx * yy - xy * xy), 6) + 0.0 AS a, round((yz * xx - xz * xy) / (xx * yy - xy * xy), 6) + 0.0 AS b, round(c, 6) AS c FROM s"))
def ground_plane(spark: SparkSession, sf: str) -> DataFrame:
    """Least-squares plane of each block from pre-aggregated sums."""
    p = X.plane(S.points(spark, sf), ("block_id",), "x", "y", "z")
    return p.select("block_id", "n", *[(F.round(c, 6) + (0.0 if c != "c" else 0)).alias(c) for c in "abc"])


@query(S.with_tables("points", ", b AS (SELECT file_id, floor((z + 20) / 0.5) AS bin, quantile_cont(z, 0.5) AS t, quantile_cont(x, 0.5) AS v, count(*) AS n FROM points GROUP BY ALL HAVING count(*) >= 3), p AS (SELECT a.file_id, quantile_cont((b.v - a.v) / (b.t - a.t), 0.5) AS slope FROM b a JOIN b ON a.file_id = b.file_id AND b.t - a.t > 1e-9 GROUP BY a.file_id) SELECT b.file_id, round(any_value(slope), 6) AS slope, round(quantile_cont(v - slope * t, 0.5), 6) AS intercept, count(*) AS bins FROM b JOIN p ON b.file_id = p.file_id GROUP BY b.file_id"))
def axis_theil_sen(spark: SparkSession, sf: str) -> DataFrame:
    """Median of pairwise slopes of x over the height bins of each file."""
    b = S.points(spark, sf).groupBy("file_id", F.floor((F.col("z") + 20) / 0.5).alias("bin")).agg(F.median("z").alias("t"), F.median("x").alias("v"), F.count("*").alias("n")).filter("n >= 3")
    return X.theil_sen(b, ("file_id",), "t", "v").select("file_id", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "bins")


_AXIS_CELLS = """, c AS (SELECT floor(x / 10)::BIGINT AS cx, floor(y / 10)::BIGINT AS cy, z FROM points), m AS (SELECT cx, cy, count(*) AS n, min(z) AS low, max(z) - min(z) AS span FROM c GROUP BY ALL HAVING count(*) >= 6 AND max(z) - min(z) >= 0.9::DOUBLE),
b AS (SELECT DISTINCT cx, cy, n, span, floor((z - low) / 0.25 + 1e-9) AS bin FROM c JOIN m USING (cx, cy)), i AS (SELECT *, bin - row_number() OVER (PARTITION BY cx, cy ORDER BY bin) AS g FROM b),
r AS (SELECT cx, cy, any_value(n) AS n, any_value(span) AS span, g, count(*) AS run, min(bin) AS lo, max(bin) AS hi FROM i GROUP BY cx, cy, g),
q AS (SELECT cx, cy, any_value(n) AS n, any_value(span) AS span, sum(run) AS bins, max(run) AS longest, max(hi) - min(lo) + 1 AS expected FROM r GROUP BY cx, cy)
SELECT cx, cy, n, bins::BIGINT AS bins, longest, round(longest + bins / expected + least(span, 8) / 0.25 + 0.05::DOUBLE * sqrt(n), 6) AS quality FROM q WHERE bins >= 3"""


@query(S.with_tables("points", _AXIS_CELLS))
def axis_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that may hold a shaft: enough points, span and height bins; quality by the longest
    run, occupancy, span and number."""
    p = S.points(spark, sf).select(F.floor(F.col("x") / 10).alias("cx"), F.floor(F.col("y") / 10).alias("cy"), "z")
    cells = p.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.min("z").alias("low"), (F.max("z") - F.min("z")).alias("span")).filter("n >= 6 AND span >= 0.9D")
    bins = p.join(cells, ["cx", "cy"]).select("cx", "cy", "n", "span", F.floor((F.col("z") - F.col("low")) / 0.25 + 1e-9).alias("bin")).distinct()
    runs = islands(bins, ("cx", "cy"), "bin").groupBy("cx", "cy", "island").agg(F.first("n").alias("n"), F.first("span").alias("span"), F.count("*").alias("run"), F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    g = runs.groupBy("cx", "cy").agg(F.first("n").alias("n"), F.first("span").alias("span"), F.sum("run").alias("bins"), F.max("run").alias("longest"), (F.max("hi") - F.min("lo") + 1).alias("expected"))
    quality = F.col("longest") + F.col("bins") / F.col("expected") + F.least(F.col("span"), F.lit(8.0)) / 0.25 + 0.05 * F.sqrt("n")
    return g.filter("bins >= 3").select("cx", "cy", "n", "bins", "longest", F.round(quality, 6).alias("quality"))


@query(S.with_tables("points", """, b AS (SELECT file_id, floor((z + 20) / 0.25)::BIGINT AS bin, quantile_cont(x, 0.5) AS x FROM points GROUP BY ALL HAVING count(*) >= 2), l AS (SELECT *, bin - lag(bin) OVER w AS gap, abs(x - lag(x) OVER w) AS jump FROM b WINDOW w AS (PARTITION BY file_id ORDER BY bin)),
g AS (SELECT *, sum(CASE WHEN gap = 1 AND jump <= 40 THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY bin) AS piece FROM l), s AS (SELECT file_id, piece, min(bin) AS first, max(bin) AS last, count(*) AS n FROM g GROUP BY ALL)
SELECT file_id, first, last, n FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, first) AS k FROM s) WHERE k = 1"""))
def axis_stable(spark: SparkSession, sf: str) -> DataFrame:
    """The longest smooth run of height bins of each file."""
    from pyspark.sql import Window as W

    b = S.points(spark, sf).groupBy("file_id", F.floor((F.col("z") + 20) / 0.25).alias("bin")).agg(F.median("x").alias("x"), F.count("*").alias("m")).filter("m >= 2")
    w = W.partitionBy("file_id").orderBy("bin")
    smooth = (F.col("bin") - F.lag("bin").over(w) == 1) & (F.abs(F.col("x") - F.lag("x").over(w)) <= 40)
    b = b.withColumn("cut", F.when(smooth, 0).otherwise(1)).withColumn("piece", F.sum("cut").over(w))
    s = b.groupBy("file_id", "piece").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("o"), "first", "last", "n")).alias("b")
    return s.groupBy("file_id").agg(best).select("file_id", "b.first", "b.last", "b.n")


@query(S.with_tables("points", ", d AS (SELECT block_id, quantile_cont(abs(x - 200), 0.5) FILTER (WHERE class_id IN (2, 9)) AS c, quantile_cont(abs(x - 200), 0.5) FILTER (WHERE class_id NOT IN (2, 9)) AS g FROM points GROUP BY block_id) SELECT block_id, CASE WHEN c IS NULL THEN 'geometry' WHEN g IS NULL OR NOT g + 0.1::DOUBLE < c THEN 'classified' ELSE 'geometry' END AS source FROM d"))
def ground_choose(spark: SparkSession, sf: str) -> DataFrame:
    """Geometric ground wins if it is 0.10 m nearer than classified ground, or alone."""
    far, known = F.abs(F.col("x") - 200), F.col("class_id").isin(2, 9)
    d = S.points(spark, sf).groupBy("block_id").agg(F.median(F.when(known, far)).alias("c"), F.median(F.when(~known, far)).alias("g"))
    source = F.when(F.col("c").isNull(), "geometry").when(F.col("g").isNull() | ~(F.col("g") + 0.1 < F.col("c")), "classified").otherwise("geometry")
    return d.select("block_id", source.alias("source"))


#: One made pole for each supplier: a shaft of 48 rings of six points and a tilted ground grid.
#: What the search should find is known.
@query("SELECT s_suppkey AS detection_id, (10 * (s_suppkey % 40))::DOUBLE AS x, (20 * (s_suppkey // 40))::DOUBLE AS y, 0.0::DOUBLE AS z, 'VISIBLE' AS state FROM supplier")
def find_poles(spark: SparkSession, sf: str) -> DataFrame:
    """Full search for the support under each sign, base to a decimetre."""
    s = S.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("detection_id"), (10.0 * (F.col("s_suppkey") % 40)).alias("cx"), (20.0 * F.floor(F.col("s_suppkey") / 40)).alias("cy"))
    s = s.withColumns({"sign_x": F.col("cx") + 0.3, "sign_y": F.col("cy"), "sign_z": F.lit(4.5)})
    i = F.col("i")
    angle, ring = F.radians(60.0 * (i % 6)), F.floor(i / 6)
    noise = 0.003 * F.sin(12.9898 * i + F.col("detection_id"))
    shaft = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(287)))).withColumns({"x": F.col("cx") + 0.055 * F.cos(angle) + noise, "y": F.col("cy") + 0.055 * F.sin(angle) - noise, "z": 0.3 + 0.1 * ring})
    gx, gy = (i % 15 - 7) * 0.2, (F.floor(i / 15) - 7) * 0.2
    ground = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(224)))).withColumns({"x": F.col("cx") + gx, "y": F.col("cy") + gy, "z": 0.05 * gx + 0.02 * gy})
    both = shaft.unionByName(ground).select("detection_id", "sign_x", "sign_y", "sign_z", "x", "y", "z")
    return P.find_poles(both).select("detection_id", *[(F.round(f"base_{c}", 1) + 0.0).alias(c) for c in "xyz"], "state")


#: Members up to which groups are solved many at once; larger ones go singly.
SMALL_GROUP = 32


def _medians(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        sizes = p["x"].str.len().to_numpy()
        m = np.empty((len(p), 3))
        small = sizes <= SMALL_GROUP
        if small.any():
            x, y, z, w = (np.concatenate(p.loc[small, c].to_list()).astype(float) for c in ("x", "y", "z", "point_count"))
            m[small] = C.geometric_median_many(np.c_[x, y, z], w, sizes[small])
        for i in np.flatnonzero(~small):
            _, x, y, z, w = p.iloc[i]
            m[i] = C.geometric_median(np.c_[x, y, z].astype(float), np.asarray(w, float))
        yield pd.DataFrame({"image_name": p["image_name"], "x": m[:, 0], "y": m[:, 1], "z": m[:, 2]})


_FAR = "sqrt((q.x - cx) ** 2 + (q.y - cy) ** 2 + (q.z - cz) ** 2)"
_PULLED = ", ".join(f"list_sum(list_transform(p, lambda q: q.{d} * q.w / {_FAR})) / list_sum(list_transform(p, lambda q: q.w / {_FAR})) AS s{d}" for d in "xyz")
_MEDIAN = S.with_tables("detections", f""", g AS (SELECT image_name, list(struct_pack(x := x, y := y, z := z, w := point_count::DOUBLE)) AS p FROM detections GROUP BY image_name),
r AS (SELECT image_name, p, 0 AS k, {", ".join(f"list_sum(list_transform(p, lambda q: q.{d} * q.w)) / list_sum(list_transform(p, lambda q: q.w)) AS c{d}" for d in "xyz")}, len(p) = 1 AS done FROM g
UNION ALL SELECT image_name, p, k + 1, coalesce(h.x, sx), coalesce(h.y, sy), coalesce(h.z, sz), h IS NOT NULL OR sqrt((sx - cx) ** 2 + (sy - cy) ** 2 + (sz - cz) ** 2) <= 1e-7
FROM (SELECT *, list_reverse_sort(list_transform(list_filter(p, lambda q: {_FAR} <= 1e-9), lambda q: struct_pack(w := q.w, x := q.x, y := q.y, z := q.z)))[1] AS h, {_PULLED} FROM r WHERE NOT done AND k < 40))
SELECT image_name, round(arg_max(cx, k), 4) + 0.0 AS x, round(arg_max(cy, k), 4) + 0.0 AS y, round(arg_max(cz, k), 4) + 0.0 AS z FROM r GROUP BY image_name""").replace("WITH ", "WITH RECURSIVE ", 1)


@query(_MEDIAN)
def geo_median(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted geometric median of each image's positions."""
    groups = C.group_arrays(S.detections(spark, sf), ("image_name",), ("x", "y", "z", "point_count"))
    found = groups.mapInPandas(_medians, "image_name string, x double, y double, z double")
    return found.select("image_name", *[(F.round(c, 4) + 0.0).alias(c) for c in "xyz"])


def covering(centres: np.ndarray, quality: np.ndarray, sign: np.ndarray, radius: float, direct: float = X.DIRECT_M) -> np.ndarray:
    """Greedy seeds: direct ones first, then by quality and nearness (measures that tie at a
    nanometre fall to the place); each covers its radius."""
    far = np.round(np.hypot(*(centres - sign).T), 9)
    left, out = np.ones(len(centres), bool), []
    for k in np.lexsort((centres[:, 1], centres[:, 0], far, -np.round(quality, 9), far > direct)):
        if left[k]:
            out.append(k)
            left &= np.hypot(*(centres - centres[k]).T) > radius
    return np.array(out, np.int64)


def _seeds(pdf: pd.DataFrame) -> pd.DataFrame:
    xy = pdf[["cx", "cy"]].to_numpy(float) + 0.5
    picked = covering(xy, pdf["quality"].to_numpy(float), xy.mean(0), 1.5)
    return pdf.iloc[picked][["area", "cx", "cy"]].assign(rank=np.arange(len(picked)))


_SEEDS = f"""WITH RECURSIVE a AS ({registry.ORACLE["axis_cells"]}), b AS (SELECT floor(cx / 8)::BIGINT || ':' || floor(cy / 8)::BIGINT AS area, cx, cy, round(quality, 9) AS quality FROM a),
m AS (SELECT area, avg(cx + 0.5::DOUBLE) AS mx, avg(cy + 0.5::DOUBLE) AS my FROM b GROUP BY area), f AS (SELECT b.*, round(sqrt((cx + 0.5::DOUBLE - mx) ** 2 + (cy + 0.5::DOUBLE - my) ** 2), 9) AS far FROM b JOIN m USING (area)),
o AS (SELECT area, list(struct_pack(cx := cx, cy := cy) ORDER BY far > 0.75, quality DESC, far, cx, cy) AS todo FROM f GROUP BY area),
r AS (SELECT area, todo, 1 AS k, [todo[1]] AS kept FROM o
UNION ALL SELECT area, todo, k + 1, CASE WHEN len(list_filter(kept, lambda q: (q.cx - todo[k + 1].cx) ** 2 + (q.cy - todo[k + 1].cy) ** 2 <= 2.25)) > 0 THEN kept ELSE list_append(kept, todo[k + 1]) END FROM r WHERE k < len(todo)),
e AS (SELECT area, unnest(kept) AS c, unnest(range(len(kept))) AS rank FROM r WHERE k = len(todo))
SELECT area, c.cx AS cx, c.cy AS cy, rank FROM e"""


@query(_SEEDS)
def seed_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Covering seeds among the cells of each area of 8 x 8 cells."""
    cells = axis_cells(spark, sf).withColumn("area", F.concat_ws(":", F.floor(F.col("cx") / 8), F.floor(F.col("cy") / 8)))
    return cells.groupBy("area").applyInPandas(_seeds, "area string, cx long, cy long, rank long")


@query(S.with_tables("detections", ", n AS (SELECT *, row_number() OVER () AS r FROM detections), d AS (SELECT a.r, a.image_name, a.detection_index, a.point_count, a.confidence, round(sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS far, count(*)::INTEGER AS members FROM n a JOIN n b ON a.image_name = b.image_name GROUP BY ALL) SELECT image_name, detection_index, far AS distance_sum, members FROM (SELECT *, row_number() OVER (PARTITION BY image_name ORDER BY far, -point_count, -confidence, detection_index) AS k FROM d) WHERE k = 1"))
def representative(spark: SparkSession, sf: str) -> DataFrame:
    """Medoid of each image's positions; ties by points, confidence and index."""
    order = [-F.col("point_count"), -F.col("confidence"), F.col("detection_index")]
    m = X.medoid(S.detections(spark, sf), ("image_name",), ("x", "y"), order, "detection_index")
    return m.select("image_name", "detection_index", F.col("distance_sum"), "members")


@query(S.with_tables("detections", "SELECT record_name, class_id, image_name, detection_index FROM (SELECT *, row_number() OVER (PARTITION BY record_name, class_id ORDER BY CASE WHEN detection_index = 1 THEN 0 ELSE 1 END, -point_count, -confidence, lower(image_name), detection_index) AS k FROM detections) WHERE k = 1"))
def relation_pick(spark: SparkSession, sf: str) -> DataFrame:
    """One relation of each canonical id: its own first, then by points and confidence."""
    order = F.struct((F.col("detection_index") != 1).alias("a"), (-F.col("point_count")).alias("b"), (-F.col("confidence")).alias("c"), F.lower("image_name").alias("d"), "detection_index", "image_name")
    return S.detections(spark, sf).groupBy("record_name", "class_id").agg(F.min(order).alias("m")).select("record_name", "class_id", "m.image_name", "m.detection_index")


_RECONCILE = """, t AS (SELECT frame_id AS target_id, record_name, ordinal AS row, ox + 3 AS x, oy AS y, 5.0::DOUBLE AS z, ox AS hx, oy AS hy FROM frames),
a AS (SELECT frame_id AS anchor_id, record_name, ox + ((frame_id * 7) % 10) * 0.05::DOUBLE AS ax, oy AS ay, 2.0 + (frame_id % 3) AS az, ordinal + d AS row FROM frames, (VALUES (0), (1)) v(d) WHERE frame_id % 3 <> 0 OR d = 0),
n AS (SELECT t.*, anchor_id, ax, ay, az, sqrt((hx - ax) ** 2 + (hy - ay) ** 2) AS off, sqrt((t.x - ax) ** 2 + (t.y - ay) ** 2) AS distance, a.row AS arow FROM t JOIN a ON t.record_name = a.record_name AND ax BETWEEN hx - 1 AND hx + 1),
m AS (SELECT target_id, anchor_id, min(off) AS off, min(distance) AS distance, count(DISTINCT arow) AS frames FROM n WHERE off <= 0.3 AND (hx - ax) ** 2 + (hy - ay) ** 2 <= 0.09::DOUBLE AND distance > 0.75 AND distance <= 12 AND z - az >= 1.8 AND abs(row - arow) <= 2 GROUP BY ALL HAVING count(DISTINCT arow) >= 2),
k AS (SELECT *, row_number() OVER w AS k, lead(off) OVER w AS next FROM m WINDOW w AS (PARTITION BY target_id ORDER BY off, distance, anchor_id))
SELECT target_id, anchor_id, round(off, 6) AS off, round(distance, 6) AS distance, frames FROM k WHERE k = 1 AND (next IS NULL OR next - off >= 0.1::DOUBLE)"""


@query(S.with_tables("frames", _RECONCILE))
def support_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Signs beside each frame, linked to anchors that two frames nearby saw directly."""
    f = S.frames(spark, sf)
    targets = f.select(F.col("frame_id").alias("target_id"), "record_name", F.col("ordinal").alias("row"), (F.col("ox") + 3).alias("x"), F.col("oy").alias("y"), F.lit(5.0).alias("z"), F.col("ox").alias("hx"), F.col("oy").alias("hy"))
    step = F.when(F.col("frame_id") % 3 != 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    anchors = f.withColumn("d", F.explode(step)).select(F.col("frame_id").alias("anchor_id"), "record_name", (F.col("ordinal") + F.col("d")).alias("row"), (F.col("ox") + ((F.col("frame_id") * 7) % 10) * 0.05).alias("ax"), F.col("oy").alias("ay"), (2.0 + F.col("frame_id") % 3).alias("az"))
    out = X.reconcile(targets, anchors)
    return out.select("target_id", "anchor_id", F.round("off", 6).alias("off"), F.round("distance", 6).alias("distance"), "frames")


@query(S.with_tables("detections", ", t AS (SELECT record_name, class_id, point_count, detection_index, image_name, ((image_name[4:])::BIGINT * 31 + detection_index) % 5 - 2 AS dx FROM detections), m AS (SELECT record_name, count(*) AS n, quantile_cont(dx, 0.5) AS centre FROM t GROUP BY record_name), d AS (SELECT t.record_name, any_value(n) AS n, quantile_cont(abs(dx - centre), 0.5) AS mad, bool_or(abs(dx) >= 3) AS edge FROM t JOIN m USING (record_name) GROUP BY t.record_name) SELECT record_name, CASE WHEN n < 3 THEN 'insufficient_data' WHEN mad <= 1 AND NOT edge THEN 'recommendation' ELSE 'ambiguous' END AS status FROM d"))
def align_decide(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict over a record's shifts: enough of them, a small MAD and none at the search limit."""
    dx = (F.regexp_extract("image_name", r"(\d+)$", 1).cast("long") * 31 + F.col("detection_index")) % 5 - 2
    t = S.detections(spark, sf).select("record_name", dx.alias("dx"))
    m = t.groupBy("record_name").agg(F.count("*").alias("n"), F.median("dx").alias("centre"))
    d = t.join(m, "record_name").groupBy("record_name").agg(F.first("n").alias("n"), F.median(F.abs(F.col("dx") - F.col("centre"))).alias("mad"), F.bool_or(F.abs("dx") >= 3).alias("edge"))
    return d.select("record_name", F.when(F.col("n") < 3, "insufficient_data").when((F.col("mad") <= 1) & ~F.col("edge"), "recommendation").otherwise("ambiguous").alias("status"))


@query(S.with_tables("frames", """, g AS (SELECT record_name, row_number() OVER (PARTITION BY record_name ORDER BY ts, frame_id) - 1 AS i, count(*) OVER (PARTITION BY record_name) AS n, frame_id FROM frames), t AS (SELECT greatest(1, ceil(60 / count(DISTINCT record_name)))::BIGINT AS t FROM frames),
q AS (SELECT DISTINCT record_name, n, k, CASE WHEN t = 1 THEN n // 2 ELSE round_even(k * (n - 1) / (t - 1), 0)::BIGINT END AS i FROM g, t, range(60) r(k) WHERE k < t), l AS (SELECT *, lag(i) OVER (PARTITION BY record_name ORDER BY k) AS p FROM q), s AS (SELECT *, sum(CASE WHEN p = i THEN 1 ELSE 0 END) OVER (PARTITION BY record_name ORDER BY k) AS stuck FROM l),
o AS (SELECT *, row_number() OVER (ORDER BY k, record_name) AS turn FROM s WHERE stuck = 0) SELECT g.record_name, g.frame_id FROM o JOIN g ON g.record_name = o.record_name AND g.i = o.i WHERE turn <= 60"""))
def align_select(spark: SparkSession, sf: str) -> DataFrame:
    """60 frames, round-robin over records and evenly spaced in each (a sample is the feature)."""
    from pyspark.sql import Window as W

    w = W.partitionBy("record_name")
    g = S.frames(spark, sf).select("record_name", "frame_id", (F.row_number().over(w.orderBy("ts", "frame_id")) - 1).cast("long").alias("i"), F.count("*").over(w).alias("n"))
    sizes = g.groupBy("record_name").agg(F.first("n").alias("n"))
    share = sizes.agg(F.greatest(F.lit(1), F.ceil(60 / F.count("*"))).alias("t"))
    q = sizes.crossJoin(F.broadcast(share)).withColumn("k", F.explode(F.expr("sequence(0L, t - 1)")))  # one row
    q = q.withColumn("i", F.when(F.col("t") == 1, F.floor(F.col("n") / 2)).otherwise(F.bround(F.col("k") * (F.col("n") - 1) / F.nullif(F.col("t") - 1, F.lit(0)), 0)).cast("long"))
    q = q.withColumn("same", F.coalesce((F.lag("i").over(w.orderBy("k")) == F.col("i")).cast("int"), F.lit(0))).withColumn("stuck", F.sum("same").over(w.orderBy("k"))).filter("stuck = 0")
    picked = q.orderBy("k", "record_name").limit(60).select("record_name", "i")
    return g.join(F.broadcast(picked), ["record_name", "i"]).select("record_name", "frame_id")


@query(S.with_tables("points", ", n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY point_id) - 1 AS i, count(*) OVER (PARTITION BY file_id) AS n FROM (SELECT * FROM points WHERE sqrt((x - 200) ** 2 + (y - 160) ** 2 + (z - 3) ** 2) BETWEEN 3 AND 90 AND red * 3 > 10)) SELECT file_id, point_id FROM n WHERE n <= 200 OR i IN (SELECT floor(k * (n.n - 1) / 199.0::DOUBLE + 1e-9) FROM range(200) t(k))"))
def align_points(spark: SparkSession, sf: str) -> DataFrame:
    """Coloured points in a shell around a place, 200 evenly spaced of each file."""
    from waymark.operators.sequences import even_sample

    d = F.sqrt((F.col("x") - 200) ** 2 + (F.col("y") - 160) ** 2 + (F.col("z") - 3) ** 2)
    p = S.points(spark, sf).filter(d.between(3, 90) & (F.col("red") * 3 > 10))
    return even_sample(p, ("file_id",), ["point_id"], F.lit(200)).select("file_id", "point_id")


@query("""WITH s AS (SELECT s_suppkey AS id, s_nationkey AS g, s_suppkey * 7 % 64 AS px, 5 + s_suppkey * 11 % 22 AS py FROM supplier), o AS (SELECT dx, dy FROM range(-2, 3) a(dx), range(-2, 3) b(dy)),
c AS (SELECT *, (((px + 1) % 64) * 31 + (py - 1) * 17 + ((px + 1) % 64) * (py - 1) * 5) % 256 AS wanted, (((px + dx + 64) % 64) * 31 + (py + dy) * 17 + ((px + dx + 64) % 64) * (py + dy) * 5) % 256 AS shown FROM s, o),
e AS (SELECT g, dx, dy, abs(wanted - shown) AS e, row_number() OVER (PARTITION BY g, dx, dy ORDER BY abs(wanted - shown)) AS k, count(*) OVER (PARTITION BY g, dx, dy) AS n FROM c), m AS (SELECT g, dx, dy, avg(e) AS err FROM e WHERE k <= greatest(1, floor(n * 0.8::DOUBLE)) GROUP BY ALL)
SELECT g AS image, dx, dy, round(err, 6) AS error FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(err, 9), abs(dx) + abs(dy), dx, dy) AS k FROM m) WHERE k = 1""")
def rgb_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Shift of each image with the least trimmed mean colour error. The shifts of a search are
    25, a fixed array; images are made from a formula, so their true shift (1, -1) is known."""
    k, f = F.col("s_suppkey"), lambda x, y: (x * 31 + y * 17 + x * y * 5) % 256
    s = S.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("image"), (k * 7 % 64).alias("px"), (5 + k * 11 % 22).alias("py"))
    shifts = F.array(*[F.struct(F.lit(a).cast("long").alias("dx"), F.lit(b).cast("long").alias("dy")) for a in range(-2, 3) for b in range(-2, 3)])
    c = s.withColumn("s", F.explode(shifts)).select("image", "s.dx", "s.dy", F.abs(f((F.col("px") + 1) % 64, F.col("py") - 1) - f((F.col("px") + F.col("s.dx") + 64) % 64, F.col("py") + F.col("s.dy"))).alias("e"))
    g = c.groupBy("image", "dx", "dy").agg(F.sort_array(F.collect_list("e")).alias("e"))
    kept = F.expr("slice(e, 1, cast(greatest(1, floor(size(e) * 0.8D)) AS int))")
    g = g.withColumn("k", kept).withColumn("error", F.aggregate("k", F.lit(0.0), lambda a, b: a + b) / F.size("k"))
    best = F.min(F.struct(F.round("error", 9).alias("a"), (F.abs("dx") + F.abs("dy")).alias("b"), "dx", "dy", "error")).alias("b")
    return g.groupBy("image").agg(best).select("image", "b.dx", "b.dy", F.round("b.error", 6).alias("error"))


_SIDES = """, c AS (SELECT image_name, detection_index AS id, round(0.15::DOUBLE * point_count, 6) AS distance, round(0.7::DOUBLE + confidence / 10, 6) AS complete, round(1 - l_tax, 6) AS coverage, l_tax AS rmse, 0.0::DOUBLE AS multi, point_count * (1 + 2 * (detection_index % 2)) AS n,
CASE detection_index % 3 WHEN 0 THEN 'ALONG_TRAVEL' WHEN 1 THEN 'LEFT_OF_TRAVEL' ELSE 'RIGHT_OF_TRAVEL' END AS side, CASE WHEN point_count % 10 > 0 THEN (1.0 + 9 * (detection_index % 2)) * point_count END AS ridge, CASE WHEN point_count % 9 > 0 THEN 20 * point_count * (1 + 4 * (detection_index % 2)) END AS arm_points, class_id FROM detections),
a AS (SELECT *, round(distance + 1 - (0.45::DOUBLE * coverage + 0.45::DOUBLE * complete + 0.1::DOUBLE), 6) AS cost, distance <= 0.75 AS direct FROM c)"""


def _pick(keys: str) -> str:
    """The rule in SQL, over rows r with an order o that sorts."""
    return f""", s AS (SELECT *, row_number() OVER (PARTITION BY image_name ORDER BY {keys}, id) AS o FROM r), b AS (SELECT * FROM s WHERE o = 1),
t AS (SELECT s.*, b.complete AS bc, b.coverage AS bv, b.side AS bs, b.direct OR b.ridge IS NULL OR b.arm_points IS NULL AS fixed, min(s.distance) OVER (PARTITION BY image_name) AS nearest FROM s JOIN b USING (image_name) WHERE NOT s.direct AND (s.complete >= 0.75) = (b.complete >= 0.75)),
n AS (SELECT *, count(*) OVER (PARTITION BY image_name) AS ties FROM t WHERE ridge IS NOT NULL AND distance <= nearest + 0.75 AND abs(complete - bc) <= 0.10 + 1e-9 AND abs(coverage - bv) <= 0.10 + 1e-9),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_name ORDER BY -ridge, o) AS k FROM n WHERE NOT fixed AND ties >= 2 AND arm_points IS NOT NULL AND side = CASE bs WHEN 'LEFT_OF_TRAVEL' THEN 'RIGHT_OF_TRAVEL' WHEN 'RIGHT_OF_TRAVEL' THEN 'LEFT_OF_TRAVEL' END) WHERE k = 1),
f AS (SELECT b.image_name, b.id, p.id AS other, coalesce(p.ridge >= 2.5 * b.ridge AND p.arm_points / greatest(0.25, p.distance) >= 2 * b.arm_points / greatest(0.25, b.distance) AND p.n / greatest(1.0::DOUBLE, b.n) >= 1.5, false) AS flipped FROM b LEFT JOIN p USING (image_name))
SELECT image_name, CASE WHEN flipped THEN other ELSE id END AS id, flipped FROM f"""


def _sided(spark: SparkSession, sf: str) -> DataFrame:
    """Detections as candidates at both sides of a road; every second arm is far denser."""
    i, n = F.col("detection_index"), F.col("point_count")
    tax = F.round((F.col("y1") - F.col("y0") - 30) / 100, 6)
    own = {
        "id": i, "distance": F.round(0.15 * n, 6), "complete": F.round(0.7 + F.col("confidence") / 10, 6), "coverage": F.round(1 - tax, 6), "rmse": tax, "multi": F.lit(0.0), "n": n * (1 + 2 * (i % 2)),
        "side": F.when(i % 3 == 0, "ALONG_TRAVEL").when(i % 3 == 1, "LEFT_OF_TRAVEL").otherwise("RIGHT_OF_TRAVEL"), "ridge": F.when(n % 10 > 0, (1.0 + 9 * (i % 2)) * n), "arm_points": F.when(n % 9 > 0, 20 * n * (1 + 4 * (i % 2))),
    }
    return S.detections(spark, sf).select("image_name", "class_id", *[v.alias(k) for k, v in own.items()])


@query(S.with_tables("detections", _SIDES + ", r AS (SELECT *, CASE WHEN complete < 0.75 THEN 1 ELSE 0 END AS k0, CASE WHEN direct THEN 0 ELSE 1 END AS k1, CASE WHEN direct THEN -n ELSE cost END AS k2 FROM a)" + _pick("k0, k1, k2")))
def pick_pole(spark: SparkSession, sf: str) -> DataFrame:
    """The best support of each image, unless the other side's arm is a much denser near tie."""
    c = _sided(spark, sf)
    direct = F.col("distance") <= X.DIRECT_M
    cost = F.round(X.junction_cost(F.col("distance"), F.col("coverage"), F.col("complete"), F.col("multi")), 6)
    return X.pick_pole(c.withColumn("rank", F.struct((F.col("complete") < 0.75).cast("int").alias("k0"), (~direct).cast("int").alias("k1"), F.when(direct, -F.col("n").cast("double")).otherwise(cost).alias("k2"))), ("image_name",))


_TIER = "CASE WHEN complete < 0.75 THEN 1 ELSE 0 END, CASE WHEN class_id = 0 THEN 1 ELSE 0 END, CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END, CASE WHEN direct THEN 0 ELSE 1 END"


@query(S.with_tables("detections", _SIDES + f""", q AS (SELECT *, dense_rank() OVER (PARTITION BY image_name ORDER BY {_TIER}) AS tier FROM a),
r AS (SELECT *, CASE WHEN direct THEN -complete ELSE cost END AS k4, CASE WHEN direct THEN rmse ELSE -coverage END AS k5, CASE WHEN direct THEN 'Infinity'::DOUBLE ELSE -complete END AS k6, CASE WHEN direct THEN distance ELSE rmse END AS k7, CASE WHEN direct THEN -n ELSE 'Infinity'::DOUBLE END AS k8, CASE WHEN direct THEN 0 ELSE distance END AS k9, CASE WHEN direct THEN 0 ELSE -n END AS k10 FROM q WHERE tier = 1)""" + _pick("k4, k5, k6, k7, k8, k9, k10")))
def pick_cross_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The same over candidates of two search profiles, the best tier alone."""
    c = _sided(spark, sf)
    key = X.cross_profile_key(F.col("distance"), F.col("complete"), F.col("class_id") != 0, F.col("id") % 4 != 0, F.col("coverage"), F.col("rmse"), F.lit(None).cast("double"), F.col("multi"), F.col("n"))
    return X.pick_cross_profile(c.withColumn("rank", key), ("image_name",))


@query(S.with_tables("points", """, a AS (SELECT point_id AS arm, x AS sx, y AS sy, z AS sz, x + point_id % 4 AS ax, y + 0.5::DOUBLE * (point_id % 4) AS ay, sqrt(1.25::DOUBLE) * (point_id % 4) AS len FROM points WHERE point_id % 3 = 0),
m AS (SELECT a.*, ((p.x - sx) * (ax - sx) + (p.y - sy) * (ay - sy)) / len AS along, abs((p.x - sx) * (ay - sy) - (p.y - sy) * (ax - sx)) / len AS off FROM a JOIN points p ON len > 0 AND p.x BETWEEN sx - 1 AND ax + 1 AND p.y BETWEEN sy - 1 AND ay + 1 AND p.z - sz BETWEEN -3 AND 3),
b AS (SELECT arm, len, least(ceil(len / 0.5::DOUBLE) - 1, floor(along / 0.5::DOUBLE)) AS bin, count(*) AS n, count(*) FILTER (WHERE along >= least(0.5::DOUBLE, 0.2::DOUBLE * len) AND along <= len - least(0.5::DOUBLE, 0.2::DOUBLE * len)) AS inner_n FROM m WHERE along >= 0 AND along <= len AND off <= 1 GROUP BY ALL),
g AS (SELECT arm, count(*) FILTER (WHERE n >= 1) AS occupied, sum(n)::BIGINT AS points, sum(inner_n)::BIGINT AS inner_n FROM b GROUP BY arm),
j AS (SELECT a.arm, a.len, greatest(1, ceil(len / 0.5::DOUBLE))::BIGINT AS expected, coalesce(occupied, 0) AS occupied, coalesce(points, 0) AS points, coalesce(inner_n, 0) AS inner_n FROM a LEFT JOIN g USING (arm))
SELECT arm, CASE WHEN len = 0 THEN 1 ELSE expected END AS expected, CASE WHEN len = 0 THEN 1 ELSE occupied END AS occupied, round(CASE WHEN len = 0 THEN 1 ELSE occupied / expected END, 6) AS coverage, points, CASE WHEN inner_n > 0 THEN inner_n ELSE points END AS ridge_points,
round(CASE WHEN len = 0 THEN 0 WHEN inner_n > 0 THEN inner_n / greatest(0.5::DOUBLE, len - 2 * least(0.5::DOUBLE, 0.2::DOUBLE * len)) ELSE points / greatest(len, 0.5::DOUBLE) END, 6) AS ridge_density FROM j"""))
def arm_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Points along the way from a sign to its support."""
    p, i = S.points(spark, sf), F.col("point_id")
    arms = p.filter(i % 3 == 0).select(i.alias("arm"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), (F.col("x") + i % 4).alias("ax"), (F.col("y") + 0.5 * (i % 4)).alias("ay"))
    c = X.arm_coverage(arms, p, "arm", radius=1.0, below=3.0, above=3.0, bin_m=0.5, least=1)
    return c.withColumns({n: F.round(n, 6) for n in ("coverage", "ridge_density")})


_REMAP = """, n AS (SELECT order_id * 10 + detection_index AS obs_id, image_name, point_count AS pole_point_count, l_tax AS pole_quality, confidence, order_id, detection_index FROM detections),
m AS (SELECT obs_id, min(obs_id) OVER (PARTITION BY order_id, detection_index % 3) AS canonical_id FROM n WHERE detection_index <= 6),
r AS (SELECT * FROM n WHERE detection_index % 3 <> 1 OR order_id % 2 = 0),
j AS (SELECT coalesce(canonical_id, r.obs_id) AS canonical_id, r.* FROM r LEFT JOIN m USING (obs_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY obs_id <> canonical_id, -pole_point_count, -pole_quality, -confidence, lower(image_name), obs_id) AS k FROM j),
s AS (SELECT canonical_id, list_sort(list(DISTINCT obs_id)) AS ids FROM m GROUP BY canonical_id)
SELECT canonical_id, obs_id, image_name, coalesce(len(ids), 1)::INTEGER AS observation_count, array_to_string(coalesce(ids, [canonical_id]), ',') AS source_ids FROM k LEFT JOIN s USING (canonical_id) WHERE k = 1"""


@query(S.with_tables("detections", _REMAP))
def relation_remap(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of an image's sightings after every third of these were merged into one sign."""
    from pyspark.sql import Window as W

    i = F.col("detection_index")
    d = S.detections(spark, sf).withColumns({"obs_id": F.col("order_id") * 10 + i, "pole_quality": F.round((F.col("y1") - F.col("y0") - 30) / 100, 6)})
    merged = d.filter(i <= 6).select("obs_id", F.min("obs_id").over(W.partitionBy("order_id", i % 3)).alias("canonical_id"))
    relations = d.filter((i % 3 != 1) | (F.col("order_id") % 2 == 0)).select("obs_id", "image_name", F.col("point_count").alias("pole_point_count"), "pole_quality", "confidence")
    return C.remap_relations(relations, merged).select("canonical_id", "obs_id", "image_name", "observation_count", F.concat_ws(",", F.col("source_ids").cast("array<string>")).alias("source_ids"))
