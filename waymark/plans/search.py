"""Queries of the support search over street scenes, one for each supplier.

A scene is a sign, a shaft (at the sign, or across the road at the end of an arm), ground that
tilts, and by its kind: a broken arm, a wire beside the arm, a hidden foot, a tilted shaft, a
second shaft, classes. All noise is hashed from ids, so that every run sees the same points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import pole_search as P
from waymark.operators.axes import Search
from waymark.registry import query
from waymark.sources import survey as S

KEY = ("sign_id",)
KINDS = 8


def _noise(scale: float, *parts: Column | str) -> Column:
    """Hashed from ids: 2001 even steps from -scale to scale."""
    return (F.pmod(F.xxhash64(*parts), F.lit(2001)) - 1000) * (scale / 1000)


def scene_signs(spark: SparkSession, sf: str) -> DataFrame:
    """sign_id, kind, sx, sy, sz, fx, fy, confidence and reach, how far the shaft stands."""
    i = F.col("s_suppkey")
    s = S.read(spark, sf, "supplier").select(i.cast("long").alias("sign_id"), F.pmod(i, F.lit(KINDS)).cast("int").alias("kind"), (60.0 * F.pmod(i, F.lit(100))).alias("sx"), (60.0 * F.floor(i / 100)).alias("sy"))
    reach = F.when(F.col("kind") == 0, 0.3).when(F.col("kind") == 5, 0.4).when(F.col("kind") == 3, 10.0).otherwise(3.0 + _noise(0.8, "sign_id"))
    return s.select("*", F.lit(5.0).alias("sz"), F.lit(1.0).alias("fx"), F.lit(0.0).alias("fy"), (0.7 + 0.01 * F.pmod("sign_id", F.lit(30))).alias("confidence"), reach.alias("reach"))


def scene_points(signs: DataFrame) -> DataFrame:
    """x, y, z, cls, rn, nr of all scenes."""
    i, kind = F.col("i"), F.col("kind")

    def rows(count: int, where: Column, cls: int, *xyz: Column) -> DataFrame:
        own = signs.filter(where).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        noisy = [c + _noise(scale, "sign_id", "i", F.lit(f"{cls}{axis}{count}")) for c, scale, axis in zip(xyz, (0.004, 0.004, 0.006), "xyz")]
        return own.select(*[c.alias(n) for c, n in zip(noisy, "xyz")], F.lit(cls).alias("cls"), F.lit(1).alias("rn"), F.when(i % 7 == 0, 2).otherwise(1).alias("nr"))

    # the shaft stands across the road, right of travel, but left in kind 7
    turn = F.when(kind == 7, 1.0).otherwise(-1.0)
    foot_y = F.col("sy") + turn * F.col("reach")
    ring, angle = F.floor(i / 6), F.radians(60.0 * (i % 6))
    low = F.when(kind == 5, 1.2).otherwise(0.1)
    lean = F.when(kind == 6, 0.12).otherwise(0.01)
    z = low + ring * ((5.2 - low) / 47)
    shaft = rows(288, F.lit(True), 6, F.col("sx") + 0.055 * F.cos(angle) + lean * z, foot_y + 0.055 * F.sin(angle), z)
    part = F.col("i") / 359
    arm = rows(360, (F.col("reach") > 0.75) & (kind != 2), 15, F.col("sx") + lean * F.col("sz") * part, F.col("sy") + turn * F.col("reach") * part, F.col("sz") - 0.1 + 0.2 * part)
    broken = rows(90, kind == 2, 15, F.col("sx") + F.lit(0.0), F.col("sy") + turn * F.col("reach") * F.when(i < 45, i / 45 * 0.15).otherwise(0.85 + (i - 45) / 45 * 0.15), F.col("sz") + F.lit(0.0))
    wire = rows(60, kind == 4, 14, F.col("sx") + 0.15, F.col("sy") + turn * F.col("reach") * i / 59, F.col("sz") + 0.22)
    gx, gy = (i % 17 - 8) * 0.19, (F.floor(i / 17) - 8) * 0.19
    tilt = lambda x, y: 0.05 * x + 0.02 * y
    ground = rows(289, F.lit(True), 2, F.col("sx") + gx, foot_y + gy, tilt(gx, gy))
    second = rows(288, kind == 1, 6, F.col("sx") + 2.0 + 0.055 * F.cos(angle), foot_y + 0.055 * F.sin(angle), z)
    second_ground = rows(289, kind == 1, 2, F.col("sx") + 2.0 + gx, foot_y + gy, tilt(gx + 2.0, gy))
    out = shaft
    for more in (arm, broken, wire, ground, second, second_ground):
        out = out.unionByName(more)
    return out


def corridor() -> Column:
    """The strict corridor: a metre to both sides of the sign."""
    return F.abs(F.col("y") - F.col("sy")) <= 1.0


def _mm(df: DataFrame, *names: str) -> list[Column]:
    return [(F.round(n, 3) + 0.0).alias(n) for n in names]


def _near(spark: SparkSession, sf: str, s: Search) -> tuple[DataFrame, DataFrame]:
    signs = scene_signs(spark, sf)
    return signs, P.neighbourhoods(signs, scene_points(signs), KEY, s, corridor())


@query()
def axis_discover(spark: SparkSession, sf: str) -> DataFrame:
    """Every shaft around each sign: a fit a covering seed, near fits settled by quality."""
    s = Search()
    _, near = _near(spark, sf, s)
    group = (*KEY, P.PROFILE)
    points = P.shaft_points(near, KEY, s, False).filter(F.col(P.PROFILE) == "expanded")
    cells = P.shaft_cells(points, group, s)
    fits = P.distinct_fits(P.axis_fits(points, cells, P.seeds(cells, group, s), group, s, False), group, s)
    return fits.select(*KEY, "seed", "n", "bins", "longest", *_mm(fits, "z0", "bx", "by", "kx", "ky", "rmse", "end_tilt"))


@query()
def ground_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Ground under each shaft's foot: classified and geometric planes, and the one chosen."""
    s = Search()
    signs, near = _near(spark, sf, s)
    turn = F.when(F.col("kind") == 7, 1.0).otherwise(-1.0)
    feet = signs.select(*KEY, F.lit("strict").alias(P.PROFILE), F.lit(0).alias("seed"), F.lit(0.0).alias("z0"), F.lit(0.01).alias("kx"), F.lit(0.0).alias("ky"), F.col("sx").alias("bx"), (F.col("sy") + turn * F.col("reach")).alias("by"), F.lit(0.0).alias("low"))
    g = P.grounds(feet, near, KEY, s, True)
    return g.select(*KEY, *_mm(g, "plane_z", "base_x", "base_y", "base_z", "ground_rmse", "ground_support"), "ground_cells", "ground_source")


_ARMS = """WITH a AS (SELECT s_suppkey AS arm, (4 + s_suppkey % 5)::DOUBLE AS len FROM supplier),
p AS (SELECT l_suppkey AS arm, (l_orderkey * 31 + l_linenumber * 17) % 1000 / 999.0::DOUBLE AS t, (l_partkey * 7 % 101 - 50) * 0.001::DOUBLE AS side, l_linenumber, l_orderkey, l_partkey FROM lineitem),
q AS (SELECT arm, len, t * len AS along, side, CASE WHEN l_linenumber % 7 = 0 THEN (l_partkey % 59 - 29) * 0.01::DOUBLE WHEN l_linenumber % 4 = 0 THEN 0.22::DOUBLE + (l_orderkey % 41 - 20) * 0.002::DOUBLE ELSE t * len * 0.03::DOUBLE - 0.1::DOUBLE + (l_orderkey % 41 - 20) * 0.002::DOUBLE END AS up FROM p JOIN a USING (arm)),
m AS (SELECT *, ceil(len / 0.25::DOUBLE)::BIGINT AS e, row_number() OVER () AS r FROM q WHERE along >= 0 AND along <= len AND abs(side) <= 0.25 AND up >= -0.3 AND up <= 0.3),
b AS (SELECT *, least(e - 1, floor(along / 0.25::DOUBLE)::BIGINT) AS bin, along >= 0.25 AND along <= len - 0.25 AS inside FROM m),
ends AS (SELECT arm, bin > 1 AS far, floor(side / 0.06::DOUBLE) AS cs, floor(up / 0.06::DOUBLE) AS cu, count(*) AS n, median(along) AS ma, median(side) AS ms, median(up) AS mu FROM b WHERE bin <= 1 OR bin >= e - 2 GROUP BY ALL HAVING count(*) >= 2),
modes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arm, far ORDER BY n DESC, abs(mu), abs(ms), ma) AS k FROM ends) WHERE k <= 32),
lines AS (SELECT f.arm, 100 * f.k + t.k AS line, f.ma, f.ms, f.mu, (t.ms - f.ms) / (t.ma - f.ma) AS ss, (t.mu - f.mu) / (t.ma - f.ma) AS su FROM modes f JOIN modes t ON f.arm = t.arm AND NOT f.far AND t.far JOIN a ON a.arm = f.arm
  WHERE t.ma - f.ma >= 0.5 * len AND abs((t.ms - f.ms) / (t.ma - f.ma)) <= tan(radians(15)) AND abs((t.mu - f.mu) / (t.ma - f.ma)) <= tan(radians(35))),
met AS (SELECT l.arm, line, bin, e, inside, sqrt((side - (ms + (along - ma) * ss)) ** 2 + (up - (mu + (along - ma) * su)) ** 2) AS off FROM lines l JOIN b USING (arm)),
tube AS (SELECT * FROM met WHERE off <= 0.1::DOUBLE),
per_bin AS (SELECT arm, line, bin, any_value(e) AS e, count(*) AS c FROM tube GROUP BY ALL),
one AS (SELECT arm, line, count(*) FILTER (WHERE c >= 2) AS lined, coalesce(bool_or(c >= 2 AND bin <= 1), false) AND coalesce(bool_or(c >= 2 AND bin >= e - 2), false) AS anchored, coalesce(sum(c) FILTER (WHERE bin >= 2 AND bin <= e - 3), 0) AS mid FROM per_bin GROUP BY arm, line),
two AS (SELECT arm, line, median(off) AS off, count(*) FILTER (WHERE inside) AS ridge FROM tube GROUP BY arm, line),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY anchored DESC, lined DESC, mid DESC, off, line) AS k FROM one JOIN two USING (arm, line)) WHERE k = 1),
whole AS (SELECT arm, count(*) AS n, count(*) FILTER (WHERE bin >= 2 AND bin <= e - 3) AS mids FROM b GROUP BY arm),
occ AS (SELECT arm, count(*) FILTER (WHERE c >= 2) AS occupied FROM (SELECT arm, bin, count(*) AS c FROM b GROUP BY arm, bin) GROUP BY arm)
SELECT a.arm, ceil(len / 0.25::DOUBLE)::INTEGER AS expected, coalesce(occupied, 0)::INTEGER AS occupied, coalesce(n, 0)::INTEGER AS arm_points, coalesce(ridge, 0)::INTEGER AS ridge_points, round(coalesce(ridge, 0) / (len - 0.5::DOUBLE), 6) AS ridge_density, coalesce(lined, 0)::INTEGER AS lined,
  round(coalesce(lined, 0) / greatest(1, coalesce(occupied, 0)), 6) AS line_ratio, round(coalesce(mid, 0) / greatest(1, coalesce(mids, 0)), 6) AS line_share, coalesce(anchored, false) AS anchored FROM a LEFT JOIN whole USING (arm) LEFT JOIN occ USING (arm) LEFT JOIN best USING (arm)"""


@query(_ARMS)
def arm_centreline(spark: SparkSession, sf: str) -> DataFrame:
    """The line that most of a noisy arm follows: mast points that rise, a wire above, clutter."""
    arms = S.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("arm"), *[F.lit(v).alias(n) for n, v in (("sx", 0.0), ("sy", 0.0), ("sz", 0.0), ("ay", 0.0))], (4 + F.col("s_suppkey") % 5).cast("double").alias("ax"))
    o, n, k = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    p = S.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("arm"), ((o * 31 + n * 17) % 1000 / 999.0).alias("t"), ((k * 7 % 101 - 50) * 0.001).alias("side"), o, n, k).join(arms.select("arm", "ax"), "arm")
    x, jitter = F.col("t") * F.col("ax"), (o % 41 - 20) * 0.002
    up = F.when(n % 7 == 0, (k % 59 - 29) * 0.01).when(n % 4 == 0, 0.22 + jitter).otherwise(x * 0.03 - 0.1 + jitter)
    c = P.arm_lines(arms, p.select("arm", x.alias("x"), (-F.col("side")).alias("y"), up.alias("z")), ("arm",), Search(), ("arm",))
    return c.select("arm", "expected", "occupied", "arm_points", "ridge_points", F.round("ridge_density", 6).alias("ridge_density"), "lined", F.round("line_ratio", 6).alias("line_ratio"), F.round("line_share", 6).alias("line_share"), "anchored")


def _told(found: DataFrame, *more: str) -> DataFrame:
    return found.select(*KEY, P.PROFILE, "mode", *more, *_mm(found, "base_x", "base_y", "base_z", "distance", "rmse", "complete", "coverage", "line_coverage", "ground_rmse", "score"), "n", "lined", "anchored", "state", "method", "status", "side")


@query()
def find_poles_corridor(spark: SparkSession, sf: str) -> DataFrame:
    """The support of each sign from the strict and the expanded corridor."""
    s = Search()
    signs, near = _near(spark, sf, s)
    return _told(P.find_supports(signs, near, KEY, s, False)[0])


@query()
def extract_pole(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a second, wider search for signs without an AUTO support."""
    signs = scene_signs(spark, sf)
    found = P.extract(signs, scene_points(signs), KEY, corridor())[0]
    return _told(found.withColumn("quality", F.round("quality", 6)), "attempt", "quality")


@query()
def pole_hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """Supports of both searches that only their arm speaks against, spaced."""
    signs = scene_signs(spark, sf)
    h = P.extract(signs, scene_points(signs), KEY, corridor())[1]
    return h.select(*KEY, "place", "attempt", P.PROFILE, "reason", "expected", "occupied", "lined", "anchored", *_mm(h, "ax", "ay", "distance", "rmse", "span", "coverage", "line_coverage", "line_ratio", "line_share"))
