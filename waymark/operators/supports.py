"""Ranking of support candidates, their gates, and links from repeated direct anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.operators.spatial import radius_join

DIRECT_M = 0.75


def smooth(x: Column) -> Column:
    """0 to 1 without corners, for x clipped to that range."""
    t = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def junction_cost(distance: Column, coverage: Column, completeness: Column, multi: Column) -> Column:
    """Metres; quality is worth one metre at most."""
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return distance + 1 - (0.45 * unit(coverage) + 0.45 * unit(completeness) + 0.10 * (1 - unit(multi)))


def rank_key(distance: Column, completeness: Column, coverage: Column, rmse: Column, multi: Column, score: Column, count: Column, preferred: float = 0.75) -> Column:
    """A struct that sorts candidates, best first: complete ones, then direct ones; direct ones
    by score, remote ones by junction cost, then by the finer measures of each kind."""
    direct = distance <= DIRECT_M
    either = lambda a, b: F.when(direct, a).otherwise(b).cast("double")
    return F.struct(
        (completeness < preferred).cast("int").alias("k0"), (~direct).cast("int").alias("k1"), either(-score, junction_cost(distance, coverage, completeness, multi)).alias("k2"), either(-completeness, -coverage).alias("k3"), either(rmse, -completeness).alias("k4"),
        either(multi, rmse).alias("k5"), either(distance, multi).alias("k6"), either(-count, distance).alias("k7"), either(F.lit(0.0), -score).alias("k8"), either(F.lit(0.0), -count).alias("k9"),
    )


def arm_threshold(distance: Column, coverage: Column, coherent: Column, density: Column, anchored: Column, required: float) -> Column:
    """The point fraction an arm needs: a third (0.10 at least) for short, complete, dense ones."""
    short = (distance > DIRECT_M) & (distance <= 4 * DIRECT_M) & anchored & (coverage >= 0.95) & (coherent >= 0.95) & (density >= 20)
    return F.when(F.coalesce(short, F.lit(False)), min(required, max(0.10, required / 3))).otherwise(required)


def long_gates(distance: Column, start: float = 8.0, over: float = 2.0, span: tuple[float, float] = (1.5, 3.0), complete: tuple[float, float] = (0.5, 0.75), arm: tuple[float, float] = (0.35, 0.6)) -> tuple[Column, Column, Column]:
    """Span, completeness and arm coverage that a remote support needs; null up to `start`."""
    x = (distance - start) / over
    w = F.when(x > 0, smooth(x))
    return tuple(lo + (max(lo, hi) - lo) * w for lo, hi in (span, complete, arm))  # type: ignore[return-value]


def plumb(tilt: Column, slope_x: Column, slope_y: Column) -> tuple[Column, Column, Column]:
    """(slope x, slope y, strength): tilts to 2 degrees stand upright, those to 4 are blended."""
    kept = smooth((tilt - 2) / 2)
    return slope_x * kept, slope_y * kept, 1 - kept


def meet(ax: Column, bx: Column, ay: Column, by: Column, a: Column, b: Column, c: Column, fallback: Column) -> tuple[Column, Column, Column]:
    """Axis (x = ax z + bx, y = ay z + by) on the plane z = a x + b y + c."""
    k = 1 - a * ax - b * ay
    z = F.when(F.abs(k) > 1e-9, (a * bx + b * by + c) / F.when(F.abs(k) > 1e-9, k)).otherwise(fallback)
    return ax * z + bx, ay * z + by, z


def plane(df: DataFrame, keys: tuple[str, ...], x: str, y: str, z: str) -> DataFrame:
    """Least-squares plane of each key: n, a, b and c at its mean x, y. Sums about the means are
    pre-aggregated; a plane that isn't determined is null."""
    mean = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate((x, y, z))])
    d = df.join(mean, list(keys)).select(*keys, "n", "m0", "m1", "m2", (F.col(x) - F.col("m0")).alias("dx"), (F.col(y) - F.col("m1")).alias("dy"), (F.col(z) - F.col("m2")).alias("dz"))
    s = d.groupBy(*keys).agg(F.first("n").alias("n"), F.first("m2").alias("c"), *[F.sum(F.col(f"d{a}") * F.col(f"d{b}")).alias(f"s{a}{b}") for a, b in ("xx", "xy", "yy", "xz", "yz")])
    det = F.col("sxx") * F.col("syy") - F.col("sxy") ** 2
    good = F.when(det > 1e-9, det)
    return s.select(*keys, "n", ((F.col("sxz") * F.col("syy") - F.col("syz") * F.col("sxy")) / good).alias("a"), ((F.col("syz") * F.col("sxx") - F.col("sxz") * F.col("sxy")) / good).alias("b"), "c")


def theil_sen(bins: DataFrame, keys: tuple[str, ...], t: str, v: str) -> DataFrame:
    """Median slope over pairs and median intercept; a key has few bins, so pairs are few."""
    other = bins.select(*keys, F.col(t).alias("__t"), F.col(v).alias("__v"))
    pairs = bins.join(other, list(keys)).filter(F.col("__t") - F.col(t) > 1e-9)
    slope = pairs.groupBy(*keys).agg(F.median((F.col("__v") - F.col(v)) / (F.col("__t") - F.col(t))).alias("slope"))
    return bins.join(slope, list(keys)).groupBy(*keys).agg(F.first("slope").alias("slope"), F.median(F.col(v) - F.col("slope") * F.col(t)).alias("intercept"), F.count("*").alias("bins"))


def medoid(df: DataFrame, keys: tuple[str, ...], xy: tuple[str, str], order: list[Column], keep: str) -> DataFrame:
    """The row of each key with the least sum of distances to the others (then by `order`).
    Keys are clusters of one object: small, so distances are taken inside one array."""
    x, y = xy
    rows = df.groupBy(*keys).agg(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"), *[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(keep).alias("keep"))).alias("r"))
    total = lambda a: F.aggregate("r", F.lit(0.0), lambda s, b: s + F.hypot(a["x"] - b["x"], a["y"] - b["y"]))
    ranked = F.transform("r", lambda a: F.struct(F.round(total(a), 6).alias("far"), *[a[f"o{i}"].alias(f"o{i}") for i in range(len(order))], a["keep"].alias("keep")))
    best = F.array_min(ranked)
    return rows.select(*keys, best["keep"].alias(keep), best["far"].alias("distance_sum"), F.size("r").alias("members"))


def reconcile(targets: DataFrame, anchors: DataFrame, radius: float = 0.30, rows: int = 2, link: tuple[float, float] = (DIRECT_M, 12.0), drop: float = 1.8, margin: float = 1.0) -> DataFrame:
    """Links targets without a direct support to anchors that were seen directly nearby.

    targets: target_id, record_name, row, x, y, z (the sign) and hx, hy (a rejected hypothesis of
    it, a row each); anchors: anchor_id, record_name, row (of each frame that saw it), ax, ay, az.
    An anchor counts if two of its frames are within `rows` of the target's, it stands at the
    hypothesis and within the link's distances, and the sign hangs `drop` above its foot. The
    nearest to a hypothesis wins; where the second is nearly as near nothing is linked."""
    places = anchors.select("anchor_id", F.col("record_name").alias("arecord"), "ax", "ay", "az").distinct()
    near = radius_join(targets, places, ("hx", "hy"), ("ax", "ay"), radius).filter("record_name = arecord")
    near = near.withColumn("off", F.hypot(F.col("hx") - F.col("ax"), F.col("hy") - F.col("ay"))).withColumn("distance", F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay")))
    near = near.filter((F.col("distance") > link[0]) & (F.col("distance") <= link[1]) & (F.col("z") - F.col("az") >= drop))
    frames = anchors.select("anchor_id", F.col("row").alias("arow")).distinct()
    seen = near.join(frames, "anchor_id").filter(F.abs(F.col("row") - F.col("arow")) <= rows)
    keys = ["target_id", "anchor_id"]
    seen = seen.groupBy(*keys).agg(F.countDistinct("arow").alias("frames"), F.min(F.struct("off", "distance", "ax", "ay", "az")).alias("m")).filter("frames >= 2")
    w = W.partitionBy("target_id").orderBy("m", "anchor_id")
    ranked = seen.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("m.off").over(w))
    clear = F.col("next").isNull() | (F.col("next") - F.col("m.off") >= min(margin, radius / 3))
    return ranked.filter((F.col("k") == 1) & clear).select(*keys, F.col("m.off").alias("off"), F.col("m.distance").alias("distance"), "frames")


def cross_profile_key(distance: Column, completeness: Column, grounded: Column, auto: Column, coverage: Column, rmse: Column, ground_rmse: Column, multi: Column, count: Column, preferred: float = 0.75) -> Column:
    """A struct that sorts candidates of different search profiles, best first: k0 to k3 are the
    tier (complete, with ground, automatic, direct); no measure depends on a profile's bins."""
    direct = distance <= DIRECT_M
    either = lambda a, b: F.when(direct, a).otherwise(b).cast("double")
    flags = [(completeness < preferred), ~grounded, ~auto, ~direct]
    rest = [either(-completeness, F.round(junction_cost(distance, coverage, completeness, multi), 6)), either(rmse, -coverage), either(ground_rmse, -completeness), either(distance, rmse), either(-count, ground_rmse), either(F.lit(0.0), distance), either(F.lit(0.0), -count)]
    return F.struct(*[f.cast("int").alias(f"k{i}") for i, f in enumerate(flags)], *[F.coalesce(r, F.lit(float("inf"))).alias(f"k{i + 4}") for i, r in enumerate(rest)])


def pick_pole(candidates: DataFrame, keys: tuple[str, ...], preferred: float = 0.75) -> DataFrame:
    """The best candidate of each key. candidates: keys, id, rank (a struct that sorts), distance,
    complete, coverage, side, ridge (points a metre of the arm), arm_points, n.

    A remote winner at one side of the road gives way to the strongest arm of the other side if
    that is a near tie (0.75 m from the nearest, 0.10 in completeness and coverage) and far
    denser: 2.5 times in its ridge, twice in all its arm, 1.5 times the points of the shaft."""
    return _pick(candidates, keys, preferred, F.lit(True))


def _pick(candidates: DataFrame, keys: tuple[str, ...], preferred: float, tier: Column) -> DataFrame:
    """The rule of pick_pole among candidates for which `tier` holds (it may use b, the best of
    the key). Rows move once, by their keys; both windows and the sums use that order."""
    w = W.partitionBy(*keys)
    row = F.struct("rank", "id", "distance", "complete", "coverage", "side", "ridge", "arm_points", "n")
    c = candidates.select(*keys, row.alias("c")).withColumn("b", F.min("c").over(w))
    may = (F.col("b.distance") > DIRECT_M) & F.col("b.ridge").isNotNull() & F.col("b.arm_points").isNotNull()
    for k in keys:
        may = may & F.col(k).isNotNull()
    remote = tier & (F.col("c.distance") > DIRECT_M) & ((F.col("c.complete") >= preferred) == (F.col("b.complete") >= preferred))
    # where nothing can flip the best row is enough
    c = c.withColumn("remote", F.coalesce(may & remote, F.lit(False))).filter("remote OR c <=> b")
    c = c.withColumn("nearest", F.min(F.when(F.col("remote"), F.col("c.distance"))).over(w))
    near = F.col("remote") & F.col("c.ridge").isNotNull() & (F.col("c.distance") <= F.col("nearest") + 0.75)
    near = near & (F.abs(F.col("c.complete") - F.col("b.complete")) <= 0.10 + 1e-9) & (F.abs(F.col("c.coverage") - F.col("b.coverage")) <= 0.10 + 1e-9)
    other = F.when(F.col("b.side") == "LEFT_OF_TRAVEL", "RIGHT_OF_TRAVEL").when(F.col("b.side") == "RIGHT_OF_TRAVEL", "LEFT_OF_TRAVEL")
    opposite = F.when(near & (F.col("c.side") == other) & F.col("c.arm_points").isNotNull(), F.struct((-F.col("c.ridge")).alias("r"), "c"))
    joined = c.groupBy(*keys).agg(F.min("b").alias("b"), F.count(F.when(near, 1)).alias("ties"), F.min(opposite)["c"].alias("o"))
    dense = lambda s: F.col(f"{s}.arm_points") / F.greatest(F.lit(0.25), F.col(f"{s}.distance"))
    flips = (F.col("ties") >= 2) & (F.col("o.ridge") >= 2.5 * F.greatest(F.col("b.ridge"), F.lit(1e-9))) & (dense("o") >= 2.0 * F.greatest(dense("b"), F.lit(1e-9))) & (F.col("o.n") / F.greatest(F.lit(1.0), F.col("b.n")) >= 1.5)
    flips = F.coalesce(flips, F.lit(False))
    return joined.select(*keys, F.when(flips, F.col("o.id")).otherwise(F.col("b.id")).alias("id"), flips.alias("flipped"))


def pick_cross_profile(candidates: DataFrame, keys: tuple[str, ...], preferred: float = 0.75) -> DataFrame:
    """pick_pole among the candidates of the best tier (rank is a cross_profile_key; the best row
    is of the best tier, as its rank begins with it)."""
    tier = F.lit(True)
    for i in range(4):
        tier = tier & F.col(f"c.rank.k{i}").eqNullSafe(F.col(f"b.rank.k{i}"))
    return _pick(candidates, keys, preferred, tier)


def arm_coverage(arms: DataFrame, points: DataFrame, key: str, radius: float = 0.25, below: float = 0.30, above: float = 0.30, bin_m: float = 0.25, least: int = 2, cell: float = 4.0) -> DataFrame:
    """How far points cover the way from a sign (key, sx, sy, sz) to an axis (ax, ay): expected
    and occupied bins (of `least` points or more), coverage, points, and the points and density of
    the inner part, without a bin at each end. Points (x, y, z) meet arms by grid cells of the
    arm's box. An arm of no length is covered."""
    length = F.hypot(F.col("ax") - F.col("sx"), F.col("ay") - F.col("sy"))
    arms = arms.withColumn("length", length)
    at = lambda c: F.floor(c / cell)
    reach = lambda a, b: F.explode(F.sequence(at(F.least(a, b) - radius), at(F.greatest(a, b) + radius)))
    long_ = arms.filter("length > 1e-9").withColumn("cx", reach(F.col("sx"), F.col("ax"))).withColumn("cy", reach(F.col("sy"), F.col("ay")))
    met = long_.join(points.select("x", "y", "z", at(F.col("x")).alias("cx"), at(F.col("y")).alias("cy")), ["cx", "cy"])
    ux, uy = (F.col("ax") - F.col("sx")) / F.col("length"), (F.col("ay") - F.col("sy")) / F.col("length")
    dx, dy, dz = F.col("x") - F.col("sx"), F.col("y") - F.col("sy"), F.col("z") - F.col("sz")
    met = met.withColumns({"along": dx * ux + dy * uy, "off": F.abs(dx * uy - dy * ux), "up": dz})
    met = met.filter((F.col("along") >= 0) & (F.col("along") <= F.col("length")) & (F.col("off") <= radius) & (F.col("up") >= -below) & (F.col("up") <= above))
    expected = F.greatest(F.lit(1), F.ceil(F.col("length") / bin_m))
    margin = F.least(F.lit(bin_m), 0.2 * F.col("length"))
    met = met.withColumns({"bin": F.least(expected - 1, F.floor(F.col("along") / bin_m)), "inner": (F.col("along") >= margin) & (F.col("along") <= F.col("length") - margin)})
    bins = met.groupBy(key, "bin").agg(F.count("*").alias("n"), F.sum(F.col("inner").cast("int")).alias("inner"))
    found = bins.groupBy(key).agg(F.sum((F.col("n") >= least).cast("int")).alias("occupied"), F.sum("n").alias("points"), F.sum("inner").alias("inner"))
    out = arms.join(found, key, "left").withColumn("none", F.col("length") <= 1e-9)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    has_inner = zero("inner") > 0
    ridge = F.when(has_inner, F.col("inner")).otherwise(zero("points"))
    span = F.when(has_inner, F.greatest(F.lit(bin_m), F.col("length") - 2 * margin)).otherwise(F.greatest(F.col("length"), F.lit(bin_m)))
    flat = lambda a, b: F.when(F.col("none"), F.lit(a)).otherwise(b)
    return out.select(key, flat(1, expected).cast("long").alias("expected"), flat(1, zero("occupied")).cast("long").alias("occupied"), flat(1.0, zero("occupied") / expected).alias("coverage"), flat(0, zero("points")).cast("long").alias("points"), flat(0, ridge).cast("long").alias("ridge_points"), flat(0.0, ridge / span).alias("ridge_density"))
