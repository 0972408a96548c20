"""The search for the support under each sign, stage by stage.

Each stage is a table: shaft points, cells, seeds, axis fits, arms, grounds, candidates, picks.
Selections, joins and gates are DataFrame expressions; points meet signs, seeds, arms and feet
by grid cells. Only fits go to numpy (axes.py), many bounded places a batch: a seed's cylinder,
an arm's box, a foot's disc.

Tables: signs (keys, sx, sy, sz, fx, fy: where the vehicle went) and near (keys, sx, sy, sz and
the points around: x, y, z, cls, rn, nr, strict, expanded). cls is null without a class, rn and
nr (return number, number of returns) may be null; strict and expanded tell whether a point lies
in the corridor below the sign. Both corridors are searched in one pass as `profile`. Signs with
a null position and points that aren't finite are never near anything; a sign without a support
has no row. Repeated points count each; keys of signs must be unique.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators import axes as A
from waymark.operators import supports as X
from waymark.operators.axes import Search
from waymark.operators.clustering import group_arrays
from waymark.operators.components import shared_checkpoint
from waymark.operators.sequences import islands

Keys = tuple[str, ...]
PROFILE = "profile"
MOST_HYPOTHESES, HYPOTHESIS_M = 64, 0.15
#: Signs (counted) that are sent to every task, some 100 bytes each; with more, points are
#: shuffled to their cells.
FEW_SIGNS = 500_000


def _kinds(df: DataFrame, names: Keys) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _grouped(df: DataFrame, keys: Keys, columns: Keys, schema: str, solve: Callable[..., list[tuple]], fixed: Keys = ()) -> DataFrame:
    """solve gets a group's columns as float arrays, then those that are the same in all its rows
    (fixed) as numbers, and returns its rows without the keys."""
    names = [*keys, *[c.split()[0] for c in schema.split(", ")]]
    first = len(keys) + len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                own = [np.asarray(c, float) for c in row[len(keys) : first]]  # nulls are NaN
                rows += [(*row[: len(keys)], *r) for r in solve(*own, *row[first:])]
            yield pd.DataFrame(rows, columns=names)

    return group_arrays(df, keys, columns, fixed).mapInPandas(run, f"{_kinds(df, keys)}, {schema}")


def neighbourhoods(signs: DataFrame, points: DataFrame, keys: Keys, s: Search, strict: Column, expanded: Column | None = None) -> DataFrame:
    """near: points within reach of each sign in the plane and in height. strict and expanded are
    expressions over sx, sy, sz, x, y, z and other columns of signs; expanded defaults to strict
    or farther than a direct support."""
    # cells as wide as a circle: a point reaches four at most, a sign stays in its own
    at = lambda c: F.floor(c / (2 * s.reach))
    reached = lambda c: F.explode(F.sequence(at(F.col(c) - s.reach), at(F.col(c) + s.reach)))
    cell = F.shiftleft(F.col("__cx"), 32).bitwiseXOR(F.col("__cy")).alias("__cell")
    placed = signs.withColumns({"__cx": at(F.col("sx")), "__cy": at(F.col("sy"))}).select(*signs.columns, cell)
    spread = points.select("x", "y", "z", "cls", "rn", "nr").withColumn("__cx", reached("x")).withColumn("__cy", reached("y")).select("x", "y", "z", "cls", "rn", "nr", cell)
    few = signs.limit(FEW_SIGNS + 1).count() <= FEW_SIGNS
    met = spread.join(F.broadcast(placed) if few else placed, "__cell")
    far = F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2)
    met = met.filter((far <= s.reach) & (F.col("z") >= F.col("sz") - s.drop) & (F.col("z") <= F.col("sz") + s.above))
    wide = strict | (far > s.direct) if expanded is None else expanded
    return met.select(*keys, "sx", "sy", "sz", "x", "y", "z", "cls", "rn", "nr", strict.alias("strict"), wide.alias("expanded"))


def _of_class(classes: tuple[int, ...]) -> Column:
    return F.coalesce(F.col("cls").isin(*classes), F.lit(False)) if classes else F.lit(False)


def terrain(low: DataFrame, keys: Keys, s: Search) -> DataFrame:
    """keys, cx, cy, terrain of each cell: a quantile of `low` over the cells within ground_core.
    A sign has as many cells as its circle holds, whatever the number of its points."""
    k = math.floor(s.ground_core / s.ground_cell + 1e-9)
    around = [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1) if (i * i + j * j) * s.ground_cell**2 <= s.ground_core**2 + 1e-9]

    def solve(cx, cy, low) -> list[tuple]:
        i, j = (c.astype(np.int64) - int(c.min()) + k for c in (cx, cy))
        grid = np.full((i.max() + k + 1, j.max() + k + 1), np.nan)
        grid[i, j] = low
        near = np.sort(np.stack([grid[i + a, j + b] for a, b in around], 1), axis=1)  # no cell: NaN, last
        place = s.ground_quantile * ((~np.isnan(near)).sum(1) - 1)
        one, rows = np.floor(place).astype(np.int64), np.arange(len(near))
        part, two = place - one, np.ceil(place).astype(np.int64)
        return list(zip(cx.astype(np.int64).tolist(), cy.astype(np.int64).tolist(), ((1 - part) * near[rows, one] + part * near[rows, two]).tolist()))

    return _grouped(low, keys, ("cx", "cy", "low"), "cx long, cy long, terrain double", solve)


def shaft_points(near: DataFrame, keys: Keys, s: Search, classified: bool) -> DataFrame:
    """Points that may belong to a shaft, a row a profile: those of shaft classes or, without
    classes, those clear of the terrain (a low quantile of the low points of the cells around)."""
    far = F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2)
    own = near.filter(far <= s.radius)
    if classified:
        own = own.filter(~_of_class(s.ground_classes))
        own = own.filter(_of_class(s.pole_classes)) if s.pole_classes else own.filter(~_of_class(s.excluded_classes))
    elif s.clearance > 0:
        cell = lambda c: F.floor((F.col(c) - F.col(f"s{c}")) / s.ground_cell)
        point = ("x", "y", "z", "cls", "rn", "nr", "strict", "expanded")
        # the points of a cell travel as one array, which gives the cell's low point, too
        cells = own.groupBy(*keys, cell("x").alias("cx"), cell("y").alias("cy")).agg(*[F.first(f"s{c}").alias(f"s{c}") for c in "xyz"], F.collect_list(F.struct(*point)).alias("all"))
        low = cells.select(*keys, "cx", "cy", F.element_at(F.sort_array("all.z"), (F.floor(s.ground_quantile * (F.size("all") - 1)) + 1).cast("int")).alias("low"))
        own = cells.join(terrain(low, keys, s), [*keys, "cx", "cy"]).select(*keys, "sx", "sy", "sz", "terrain", F.explode("all").alias("p"))
        own = own.filter(F.col("p.z") > F.col("terrain") + s.clearance).select(*keys, "sx", "sy", "sz", *[f"p.{c}" for c in point])
    profiles = F.array_compact(F.array(F.when(F.col("strict"), F.lit("strict")), F.when(F.col("expanded"), F.lit("expanded"))))
    voxel = lambda c: F.floor((F.col(c) - F.col(f"s{c}")) / s.voxel)
    return own.select(*keys, F.explode(profiles).alias(PROFILE), "sx", "sy", "sz", "x", "y", "z", "cls", "rn", "nr", voxel("x").alias("px"), voxel("y").alias("py"))


def shaft_cells(points: DataFrame, keys: Keys, s: Search) -> DataFrame:
    """Cells (px, py) with points, height and height bins enough: n, median mx and my, quality by
    longest run, occupancy, height and number, and distance to the sign; sz and all (the points)
    go along, so that a fit needn't fetch them again."""
    cell = [*keys, "px", "py"]
    g = points.groupBy(*cell).agg(F.first("sx").alias("sx"), F.first("sy").alias("sy"), F.first("sz").alias("sz"), F.count("*").alias("n"), F.min("z").alias("low"), (F.max("z") - F.min("z")).alias("span"), F.collect_list(F.struct("x", "y", "z", "cls", "rn", "nr")).alias("all"))
    g = g.filter((F.col("n") >= max(3, s.points // 5)) & (F.col("span") >= 0.6 * s.span))
    g = g.withColumns({f"a{c}": F.sort_array(f"all.{c}") for c in "xyz"})
    middle = lambda a: (F.element_at(a, F.floor((F.col("n") + 1) / 2).cast("int")) + F.element_at(a, F.floor(F.col("n") / 2).cast("int") + 1)) / 2
    g = g.withColumns({"mx": middle("ax"), "my": middle("ay"), "at": F.array_distinct(F.transform("az", lambda z: F.floor((z - F.col("low")) / s.bin_m)))})
    # longest run of the bins, which come in order
    step = lambda r, b: F.struct(b.alias("b"), F.when(b == r["b"] + 1, r["run"] + 1).otherwise(1).alias("run"), F.greatest(r["most"], F.when(b == r["b"] + 1, r["run"] + 1).otherwise(1)).alias("most"))
    none = F.struct(F.lit(-2).cast("long").alias("b"), F.lit(0).alias("run"), F.lit(0).alias("most"))
    g = g.withColumns({"bins": F.size("at").cast("long"), "expected": F.element_at("at", -1) - F.element_at("at", 1) + 1}).filter(F.col("bins") >= max(3, s.bins // 2))
    g = g.withColumn("longest", F.aggregate("at", none, step, lambda r: r["most"]).cast("long"))
    quality = F.col("longest") + F.col("bins") / F.col("expected") + F.least(F.col("span"), F.lit(s.drop)) / s.bin_m + 0.05 * F.sqrt("n")
    far = F.sqrt((F.col("mx") - F.col("sx")) ** 2 + (F.col("my") - F.col("sy")) ** 2)
    return g.select(*cell, "n", "mx", "my", "longest", "bins", quality.alias("quality"), far.alias("distance"), "sz", "all")


def seeds(cells: DataFrame, keys: Keys, s: Search) -> DataFrame:
    """Cells that cover all others, chosen greedily: direct ones first, then by quality and
    nearness. Returns keys, seed (its order), px, py, mx, my."""
    radius = max(1.5 * s.voxel, 0.6 * s.cluster)

    def cover(px, py, mx, my, quality, distance) -> list[tuple]:
        left, out = np.ones(len(px), bool), []
        for k in np.lexsort((py, px, distance, -quality, distance > s.direct)):
            if left[k]:
                out.append((len(out), int(px[k]), int(py[k]), mx[k], my[k]))
                left &= np.sqrt((mx - mx[k]) ** 2 + (my - my[k]) ** 2) > radius
        return out

    return _grouped(cells, keys, ("px", "py", "mx", "my", "quality", "distance"), "seed int, px long, py long, mx double, my double", cover)


_FIT = "z0 double, kx double, ky double, bx double, by double, n int, rmse double, span double, z_lo double, z_hi double, bins int, longest int, max_gap double, occupancy double, end_tilt double, low double, multi double, main_class int, main_share double, heights array<double>"


def axis_fits(points: DataFrame, cells: DataFrame, chosen: DataFrame, keys: Keys, s: Search, classified: bool) -> DataFrame:
    """An axis for each seed whose cylinder holds one: x = bx + kx (z - z0), y alike. rmse counts
    the shaft below the sign's arms, too; heights are those of the points on it."""
    k = math.ceil(s.cluster / s.voxel - 1e-9)
    own = cells if not classified else points.groupBy(*keys, "px", "py").agg(F.first("sz").alias("sz"), F.collect_list(F.struct("x", "y", "z", "cls", "rn", "nr")).alias("all"))
    # a place's few cells and few seeds meet by its keys alone: what follows groups by these, too
    wide = chosen.select(*keys, "seed", "mx", "my", F.col("px").alias("qx"), F.col("py").alias("qy"))
    met = own.select(*keys, "px", "py", "sz", "all").join(wide, list(keys)).filter((F.abs(F.col("px") - F.col("qx")) <= k) & (F.abs(F.col("py") - F.col("qy")) <= k))
    met = met.select(*keys, "seed", "mx", "my", "sz", F.explode("all").alias("p")).select(*keys, "seed", "mx", "my", "sz", "p.*")
    met = met.filter(F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2) <= s.cluster)

    def fit(x, y, z, cls, rn, nr, sz) -> list[tuple]:
        xyz = np.c_[x, y, z]
        f = A.shaft_axis(xyz, s)
        if f is None:
            return []
        on, line, h = f["on"], f["line"], z[f["on"]]
        shaft = on & (z < sz - s.arm_below)
        rmse = max(f["rmse"], float(np.sqrt(np.mean(f["off"][shaft] ** 2)))) if shaft.sum() >= s.points else f["rmse"]
        told = on & (nr > 0) & (rn > 0) & (rn <= nr)
        multi = float((nr[told] > 1).mean()) if told.any() else None
        known = cls[on & (cls >= 0)].astype(int) if classified else np.array([], int)
        names, counts = np.unique(known, return_counts=True)
        main = (int(names[counts.argmax()]), float(counts.max() / len(known))) if len(known) else (None, None)
        return [(f["z0"], *line[0], *line[1], int(on.sum()), rmse, float(np.ptp(h)), float(h.min()), float(h.max()), f["bins"], f["longest"], f["max_gap"], f["occupancy"], f["end_tilt"], float(np.quantile(h, 0.02)), multi, *main, sorted(h.tolist()))]

    return _grouped(met, (*keys, "seed"), ("x", "y", "z", "cls", "rn", "nr"), _FIT, fit, ("sz",))


def distinct_fits(fits: DataFrame, keys: Keys, s: Search) -> DataFrame:
    """Of fits nearer than the dedupe radius the better one stays: longer run, then occupancy,
    points and rmse. Fits come in the order of their seeds."""
    radius = max(1.5 * s.voxel, 0.5 * s.cluster)

    def best(seed, bx, by, longest, occupancy, n, rmse) -> list[tuple]:
        kept: list[int] = []
        quality = list(zip(longest, occupancy, n, -rmse))
        for i in np.argsort(seed):
            twin = next((k for k, j in enumerate(kept) if math.sqrt((bx[i] - bx[j]) ** 2 + (by[i] - by[j]) ** 2) < radius), None)
            if twin is None:
                kept.append(int(i))
            elif quality[i] > quality[kept[twin]]:
                kept[twin] = int(i)
        return [(int(seed[i]),) for i in kept]

    return fits.join(_grouped(fits, keys, ("seed", "bx", "by", "longest", "occupancy", "n", "rmse"), "seed int", best), [*keys, "seed"])


_ARM = "expected int, occupied int, coverage double, arm_points int, ridge_points int, ridge_density double, lined int, line_coverage double, line_ratio double, line_share double, anchored boolean"


def arm_lines(arms: DataFrame, points: DataFrame, keys: Keys, s: Search, meet: Keys = (), cell: float = 2.0) -> DataFrame:
    """arms: keys, sx, sy, sz, ax, ay. points: x, y, z and the columns of `meet`, which must be
    equal. Returns keys and how far points cover the way from sign to axis, in all and along its
    best straight line (axes.arm_line). Points meet arms by grid cells of the arm's box; where
    `meet` is given, a place's points meet its few arms by that alone, and what follows groups by
    it without another shuffle."""
    length = F.sqrt((F.col("ax") - F.col("sx")) ** 2 + (F.col("ay") - F.col("sy")) ** 2)
    arms = arms.select(*keys, *[c for c in meet if c not in keys], "sx", "sy", "sz", "ax", "ay", length.alias("length"))
    at = lambda c: F.floor(c / cell)
    span = lambda a, b: F.explode(F.sequence(at(F.least(a, b) - s.arm_radius), at(F.greatest(a, b) + s.arm_radius)))
    long_ = arms.filter("length > 1e-9")
    if meet:
        met = points.select(*meet, "x", "y", "z").join(long_, list(meet))
    else:
        long_ = long_.withColumn("__i", span(F.col("sx"), F.col("ax"))).withColumn("__j", span(F.col("sy"), F.col("ay")))
        met = long_.join(points.select("x", "y", "z", at(F.col("x")).alias("__i"), at(F.col("y")).alias("__j")), ["__i", "__j"])
    ux, uy = (F.col("ax") - F.col("sx")) / F.col("length"), (F.col("ay") - F.col("sy")) / F.col("length")
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    met = met.select(*keys, "length", (dx * ux + dy * uy).alias("along"), (dx * uy - dy * ux).alias("side"), (F.col("z") - F.col("sz")).alias("up"))
    met = met.filter((F.col("along") >= 0) & (F.col("along") <= F.col("length")) & (F.abs("side") <= s.arm_radius) & (F.col("up") >= -s.arm_below) & (F.col("up") <= s.arm_above))
    found = _grouped(met, keys, ("along", "side", "up"), _ARM, lambda along, side, up, length: [tuple(A.arm_line(along, side, up, float(length), s).values())], ("length",))
    out = arms.select(*keys, "length").join(found, list(keys), "left")
    none = F.col("length") <= 1e-9  # an arm of no length is covered
    blank = {c.split()[0]: c.split()[1] for c in _ARM.split(", ")}
    whole = {"expected": 1, "occupied": 1, "coverage": 1.0, "lined": 1, "line_coverage": 1.0, "line_ratio": 1.0, "line_share": 1.0, "anchored": True}
    empty = {"expected": F.greatest(F.lit(1), F.ceil(F.col("length") / s.arm_bin))}
    fill = lambda c, kind: F.when(none, F.lit(whole.get(c, 0))).otherwise(F.coalesce(c, empty.get(c, F.lit(False) if kind == "boolean" else F.lit(0)))).cast(kind).alias(c)
    return out.select(*keys, *[fill(c, kind) for c, kind in blank.items()])


def attached(fits: DataFrame, signs: DataFrame, keys: Keys, s: Search, classified: bool) -> DataFrame:
    """Fits with the place (ax, ay) of their axis at the sign's height and the distance from it;
    those too far, and rough remote ones without classes, are left out."""
    own = fits.join(signs.select(*keys, "sx", "sy", "sz", "fx", "fy"), list(keys))
    own = own.withColumns({"ax": F.col("bx") + F.col("kx") * (F.col("sz") - F.col("z0")), "ay": F.col("by") + F.col("ky") * (F.col("sz") - F.col("z0"))})
    own = own.withColumn("distance", F.sqrt((F.col("ax") - F.col("sx")) ** 2 + (F.col("ay") - F.col("sy")) ** 2)).filter(F.col("distance") <= s.far)
    own = own.withColumn("remote", F.col("distance") > s.direct)
    return own if classified else own.filter(~F.col("remote") | (F.col("rmse") <= s.remote_rmse))


def gated(own: DataFrame, near: DataFrame, keys: Keys, s: Search, classified: bool) -> DataFrame:
    """attached fits with their arms (null for direct ones) and `reason`, why one is rejected."""
    one = (*keys, PROFILE, "seed")
    points = near.filter((F.col("z") >= F.col("sz") - s.arm_below) & (F.col("z") <= F.col("sz") + s.arm_above))  # arm_lines asks again
    points = points.filter(~_of_class(s.ground_classes)) if classified else points
    arms = arm_lines(own.filter("remote"), points.select(*keys, "x", "y", "z"), one, s, keys)
    both = own.join(arms, list(one), "left")
    needed = X.arm_threshold(F.col("distance"), F.least("coverage", "line_coverage"), F.col("line_ratio"), F.col("ridge_density"), F.col("anchored"), s.arm_share)
    broken = (F.col("expected") > 4) & (~F.col("anchored") | (F.col("line_coverage") < s.arm_cover) | (F.col("line_ratio") < s.arm_ratio) | (F.col("line_share") < needed))
    reason = F.when(F.col("coverage") < s.arm_cover, "raw_coverage").when(broken, "coherent_arm").when(F.col("end_tilt") > s.remote_tilt, "endpoint_tilt")
    return both.withColumn("reason", F.when(F.col("remote"), reason))


def hypotheses(tested: DataFrame, s: Search) -> DataFrame:
    """Supports that only their arm speaks against."""
    return tested.filter(F.col("reason").isin("raw_coverage", "coherent_arm") & (F.col("end_tilt").isNull() | (F.col("end_tilt") <= s.remote_tilt)))


_GROUND = "plane_z double, base_x double, base_y double, base_z double, ground_rmse double, ground_cells int, ground_source string, ground_support double"


def grounds(own: DataFrame, near: DataFrame, keys: Keys, s: Search, classified: bool) -> DataFrame:
    """Ground under each axis that has some: its height at the lowest point seen, where the axis
    meets it, and how far its nearest cell is from there."""
    one = (*keys, PROFILE, "seed")
    foot = own.select(*one, "z0", "kx", "ky", "bx", "by", (F.col("bx") + F.col("kx") * (F.col("low") - F.col("z0"))).alias("cx"), (F.col("by") + F.col("ky") * (F.col("low") - F.col("z0"))).alias("cy"))
    below = near.filter(F.col("z") <= F.col("sz") - (0.0 if classified else s.ground_drop))  # local_ground asks again
    met = below.select(*keys, "sz", "x", "y", "z", "cls").join(foot, list(keys))  # a place's few feet
    met = met.filter(F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2) <= s.ground_radius)

    def fit(x, y, z, cls, sz, z0, kx, ky, bx, by, cx, cy) -> list[tuple]:
        g = A.local_ground(np.c_[x, y, z], np.nan_to_num(cls, nan=-1) if classified else None, np.r_[cx, cy], float(sz), s)
        if g is None:
            return []
        base = A.foot(np.array([[kx, ky], [bx, by]]), float(z0), g)
        return [(float(g["plane"][2]), *base.tolist(), g["rmse"], len(g["cells"]), g["source"], float(np.hypot(*(g["cells"][:, :2] - base[:2]).T).min()))]

    return _grouped(met, one, ("x", "y", "z", "cls"), _GROUND, fit, ("sz", "z0", "kx", "ky", "bx", "by", "cx", "cy"))


def candidates(tested: DataFrame, ground: DataFrame, keys: Keys, s: Search, classified: bool) -> DataFrame:
    """What passes all gates, with state, method, status, score and side."""
    one = [*keys, PROFILE, "seed"]
    c = tested.filter("reason IS NULL").join(ground, one, "inner" if s.need_ground else "left")
    z, sz = F.col("plane_z"), F.col("sz")
    c = c.filter(z.isNull() | (sz - z >= s.ground_drop))
    begin = z + (sz - z) * s.middle_from
    middle_bins = F.greatest(F.lit(1), F.floor((sz - begin) / s.bin_m) + 1)
    inside = F.filter("heights", lambda h: (h >= begin) & (h <= sz))
    seen = F.size(F.array_distinct(F.filter(F.transform(inside, lambda h: F.floor((h - begin) / s.bin_m + 1e-9)), lambda b: (b >= 0) & (b < middle_bins))))
    c = c.withColumn("middle", seen / middle_bins)
    c = c.withColumn("complete", F.least("middle", F.least(F.lit(1.0), (F.col("z_hi") - F.col("z_lo")) / F.greatest(F.lit(s.bin_m), sz - z)))).filter(z.isNull() | (F.col("middle") >= s.middle))
    low_x, low_y = (F.col(f"b{a}") + F.col(f"k{a}") * (F.col("low") - F.col("z0")) for a in "xy")
    c = c.withColumns({"base_x": F.coalesce("base_x", low_x), "base_y": F.coalesce("base_y", low_y), "gap": F.col("low") - F.col("base_z"), "base_z": F.coalesce("base_z", "low")})
    hidden, sunk = F.col("gap") > s.occluded, F.col("gap") < -s.sunk
    unsure = sunk | hidden | (F.col("ground_rmse") > 0.75 * s.ground_rmse) | (F.col("complete") < s.preferred) | (F.col("ground_support") > s.ground_support)
    rough = ~F.col("remote") & (F.col("rmse") > s.remote_rmse) & (not classified)
    c = c.withColumns({
        "state": F.when(z.isNull(), "UNKNOWN").when(sunk, "GROUND_CONFLICT").when(hidden, "OCCLUDED").otherwise("VISIBLE"),
        "method": F.when(z.isNull(), "OBS_BOTTOM").when(hidden, "GROUND_EXTR").otherwise("GROUND_SNAP"),
        "status": F.when(z.isNull() | unsure | rough, "REVIEW").otherwise("AUTO"),
    })
    if not classified:
        good = (F.coalesce("complete", F.lit(0.0)) >= s.remote_complete) & (F.col("rmse") <= s.remote_rmse) & (F.coalesce("ground_rmse", F.lit(0.0)) <= s.remote_ground_rmse)
        c = c.filter(~F.col("remote") | good)
    span, complete, arm = X.long_gates(F.col("distance"), s.long_from, s.long_over, (s.span, s.long_span), (0.0 if classified else s.remote_complete, s.long_complete), (s.arm_cover, s.long_cover))
    long_good = (F.col("span") >= span) & (z.isNull() | (F.col("complete") >= complete)) & (F.coalesce("line_coverage", F.lit(0.0)) >= arm)
    c = c.filter(~F.col("remote") | span.isNull() | long_good)
    height = F.when(z.isNull(), F.lit(s.drop)).otherwise(F.greatest(F.lit(s.bin_m), sz - F.col("base_z")))
    zero = lambda n: F.coalesce(n, F.lit(0.0))
    score = F.least("span", height) + 0.08 * F.col("bins") + 0.03 * F.sqrt("n") - 5 * F.col("rmse") - 0.15 * F.col("distance") + 0.5 * zero("coverage") - 0.5 * zero("multi")
    c = c.withColumn("score", score).filter(~(F.coalesce(F.col("main_class").isin(*s.ground_classes), F.lit(False)) & (F.col("main_share") > s.ground_share)))
    # right of travel is the forward vector turned clockwise
    norm = F.nullif(F.sqrt(F.col("fx") ** 2 + F.col("fy") ** 2), F.lit(0.0))
    lateral = ((F.col("ax") - F.col("sx")) * F.col("fy") - (F.col("ay") - F.col("sy")) * F.col("fx")) / norm
    c = c.withColumn("lateral", lateral)
    along = (F.abs("lateral") < 0.15) | (F.abs("lateral") < 0.5 * F.col("distance"))
    return c.withColumn("side", F.when(F.col("lateral").isNull(), None).when(along, "ALONG_TRAVEL").when(F.col("lateral") > 0, "RIGHT_OF_TRAVEL").otherwise("LEFT_OF_TRAVEL"))


def _ranked(found: DataFrame, s: Search, cross: bool = False) -> DataFrame:
    cover = F.coalesce("line_coverage", "coverage", F.lit(0.0))
    complete, multi = F.coalesce("complete", F.lit(0.0)), F.coalesce("multi", F.lit(0.0))
    near = lambda c: F.round(c, 9)  # noqa: E731  # sums over points depend on their order in the last digits
    if cross:
        rank = X.cross_profile_key(near("distance"), near(complete), F.col("plane_z").isNotNull(), F.col("status") == "AUTO", near(cover), near("rmse"), near("ground_rmse"), near(multi), F.col("n"), s.preferred)
    else:
        rank = X.rank_key(near("distance"), near(complete), near(cover), near("rmse"), near(multi), near("score"), F.col("n"), s.preferred)
    return found.select("*", rank.alias("rank")).withColumns({"__cover": cover, "__complete": complete})


def _best(found: DataFrame, keys: Keys, name: str, s: Search, cross: bool = False) -> DataFrame:
    """The best of each key's candidates, known by the integer column `name`."""
    r = _ranked(found, s, cross).select(*keys, F.col(name).alias("id"), "rank", "distance", F.col("__complete").alias("complete"), F.col("__cover").alias("coverage"), "side", F.col("ridge_density").alias("ridge"), "arm_points", "n")
    picked = (X.pick_cross_profile if cross else X.pick_pole)(r, keys, s.preferred)
    return found.join(picked.select(*keys, F.col("id").alias(name)), [*keys, name])


def search(signs: DataFrame, near: DataFrame, keys: Keys, s: Search, classified: bool) -> tuple[DataFrame, DataFrame]:
    """(the best candidate of each sign and profile, the rejected hypotheses)."""
    group = (*keys, PROFILE)
    points = shaft_points(near, keys, s, classified)
    cells = shared_checkpoint(shaft_cells(points, group, s))
    fits = shared_checkpoint(axis_fits(points, cells, seeds(cells, group, s), group, s, classified))
    tested = shared_checkpoint(gated(attached(distinct_fits(fits, group, s), signs, keys, s, classified), near, keys, s, classified))
    found = shared_checkpoint(candidates(tested, grounds(tested.filter("reason IS NULL"), near, keys, s, classified), keys, s, classified))
    return _best(found, group, "seed", s), hypotheses(tested, s)


def find_supports(signs: DataFrame, near: DataFrame, keys: Keys, s: Search, classified: bool) -> tuple[DataFrame, DataFrame]:
    """(a support a sign, the rejected hypotheses). A direct support of the strict corridor is
    taken; else the better one of the strict and the expanded corridor. `mode` tells which
    corridor was searched last."""
    best, rejected = search(signs, near, keys, s, classified)
    more = near.groupBy(*keys).agg(F.max(F.col("expanded") & ~F.col("strict")).alias("more"))
    best = shared_checkpoint(best.withColumn("which", F.when(F.col(PROFILE) == "strict", 1).otherwise(2)))
    direct = best.filter((F.col("which") == 1) & ~F.col("remote")).select(*keys, F.lit(True).alias("direct"))
    known = best.join(direct, list(keys), "left").join(more, list(keys))
    done = F.coalesce("direct", F.lit(False)) | ~F.col("more")
    chosen = _best(known.filter((F.col("which") == 1) | ~done), keys, "which", s)
    return chosen.withColumn("mode", F.when(done, "strict").otherwise("remote_expanded")).drop("which", "direct", "more"), rejected


def spaced(rejected: DataFrame, keys: Keys) -> DataFrame:
    """Hypotheses of each key, smoothest, tallest and nearest first, none within HYPOTHESIS_M of
    one before it; at most MOST_HYPOTHESES. Adds their order."""

    def keep(seed, rmse, span, distance, ax, ay, which) -> list[tuple]:
        out: list[int] = []
        for i in np.lexsort((ay, ax, distance, -span, rmse)):
            if len(out) < MOST_HYPOTHESES and not (out and (np.hypot(ax[out] - ax[i], ay[out] - ay[i]) <= HYPOTHESIS_M).any()):
                out.append(int(i))
        return [(int(which[i]), int(seed[i]), k) for k, i in enumerate(out)]

    coded = rejected.withColumn("which", F.when(F.col("attempt") == "fallback", 2).otherwise(0) + F.when(F.col(PROFILE) == "expanded", 1).otherwise(0))
    return coded.join(_grouped(coded, keys, ("seed", "rmse", "span", "distance", "ax", "ay", "which"), "which int, seed int, place int", keep), [*keys, "which", "seed"]).drop("which")


#: A second, wider search (fixed values).
WIDER = {"radius": 12.0, "drop": 10.0, "above": 4.0, "far": 12.0, "span": 0.5, "arm_radius": 0.4, "arm_below": 0.6, "arm_above": 0.6, "arm_bin": 0.4, "arm_cover": 0.4}


def extract(signs: DataFrame, points: DataFrame, keys: Keys, corridor: Column, s: Search | None = None, wider: Search | None = None, classified: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the support of each sign, its rejected hypotheses). signs: keys, sx, sy, sz, fx, fy and
    confidence. Signs without an AUTO support are searched a second time, within wider limits;
    what that finds is REVIEW, and taken if the first search found none or the worse one.
    corridor: see `neighbourhoods`."""
    s = s or Search()
    wider = wider or replace(s, **WIDER)
    first, rejected = find_supports(signs, neighbourhoods(signs, points, keys, s, corridor), keys, s, classified)
    first = shared_checkpoint(first.withColumn("attempt", F.lit("strict")))
    rejected = shared_checkpoint(rejected.withColumn("attempt", F.lit("strict")))
    again = shared_checkpoint(signs.join(first.filter("status = 'AUTO'").select(*keys), list(keys), "left_anti"))
    second, more = find_supports(again, neighbourhoods(again, points, keys, wider, corridor), keys, wider, classified)
    # its own status ranks it; what is returned of it is REVIEW
    second = shared_checkpoint(second.withColumn("attempt", F.lit("fallback")))
    both = first.unionByName(second).withColumn("which", F.when(F.col("attempt") == "strict", 1).otherwise(2))
    best = _best(shared_checkpoint(both), keys, "which", s, cross=True).drop("which")
    best = best.withColumn("status", F.when(F.col("attempt") == "fallback", "REVIEW").otherwise(F.col("status")))
    own = best.join(signs.select(*keys, "confidence"), list(keys))
    cover = F.coalesce("complete", F.least(F.lit(1.0), F.col("span") / 2))
    quality = F.col("confidence") * cover * F.exp(-5 * F.col("rmse") - 2 * F.coalesce("ground_rmse", F.lit(s.ground_rmse)))
    own = own.withColumn("quality", quality * F.when(F.col("status") == "AUTO", 1.0).otherwise(0.75))
    return own, spaced(rejected.unionByName(more.withColumn("attempt", F.lit("fallback"))), keys)
