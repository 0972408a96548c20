"""Rectified views: boxes and polygons between panorama and view pixels, and fields of view.

Pixels of one detection are an array column, so a box or polygon is mapped by `transform`
inside one row and nothing is exploded or regrouped."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.vectors import TAU, Vec, bind, clip, const, dot
from waymark.operators import geometry as G

POLYGON_STEPS = 64
Pixel = tuple[Column, Column]


def pixels(*points: Pixel) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def support_pixels(x0: Column, y0: Column, x1: Column, y1: Column, polygon: Column | None = None) -> Column:
    """Corners, edge middles and centre of a box, then about 64 pixels along the polygon, which
    should be a column of its own: it is looked at for each pixel."""
    mx, my = (x0 + x1) * 0.5, (y0 + y1) * 0.5
    box = pixels((x0, y0), (x0, y1), (x1, y0), (x1, y1), (mx, y0), (mx, y1), (x0, my), (x1, my), (mx, my))
    if polygon is None:
        return box
    step = F.greatest(F.lit(1), F.floor(F.size(polygon) / POLYGON_STEPS))
    # only the pixels that stay are looked at
    some = F.transform(F.sequence(F.lit(0), F.size(polygon) - 1, step.cast("int")), lambda i: F.get(polygon, i))
    return F.concat(box, F.when(F.size(polygon) > 0, some).otherwise(F.array().cast("array<struct<x:double,y:double>>")))


def box_of(points: Column) -> tuple[Column, Column, Column, Column]:
    """Least and greatest pixel of an array; null for an empty one."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def clamp_box(x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """A box inside the image, one pixel wide and high at least."""
    a, b = clip(x0, 0.0, width - 1.0), clip(y0, 0.0, height - 1.0)
    return a, b, F.greatest(a + 1, F.least(F.lit(float(width)), x1)), F.greatest(b + 1, F.least(F.lit(float(height)), y1))


def local(ray: Vec, axes: G.Axes) -> Vec:
    """(right, up, forward) of a ray."""
    f, r, u = axes
    return dot(ray, r), dot(ray, u), dot(ray, f)


def ray_persp(ray: Vec, axes: G.Axes, width: float, height: float, hfov: Column, vfov: Column) -> Pixel:
    """View pixel of a ray; null for one that isn't in front."""
    x, y, z = local(ray, axes)
    depth = F.when(z > 1e-6, z)
    fx, fy = G.focal(width, height, hfov, vfov)
    return width * 0.5 + fx * (x / depth), height * 0.5 - fy * (y / depth)


def pano_to_persp(points: Column, pano: G.Axes, pano_size: tuple[float, float], view: G.Axes, size: tuple[float, float], hfov: Column, vfov: Column) -> Column:
    """Panorama pixels as view pixels; those behind the view go."""

    def one(p: Column) -> Column:
        x, y = ray_persp(G.pixel_ray(p["x"], p["y"], pano, *pano_size), view, *size, hfov, vfov)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.filter(F.transform(points, one), lambda p: p["x"].isNotNull())


def persp_to_pano(points: Column, view: G.Axes, size: tuple[float, float], hfov: Column, vfov: Column, pano: G.Axes, pano_size: tuple[float, float]) -> Column:
    def one(p: Column) -> Column:
        x, y = G.ray_equirect(G.persp_ray(p["x"], p["y"], view, *size, hfov, vfov), pano, *pano_size)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(points, one)


def box_to_pano(df: DataFrame, box: tuple, view: G.Axes, size: tuple[float, float], hfov: Column, vfov: Column, pano: G.Axes, pano_size: tuple[float, float], name: str = "__pano") -> tuple[DataFrame, tuple]:
    """A view box as the panorama box of its corners, x unwrapped around their circular mean.
    Corners are columns, not an array, so all of it stays in code generation."""
    x0, y0, x1, y1 = box
    us, vs = [], []
    for i, (x, y) in enumerate(((x0, y0), (x0, y1), (x1, y0), (x1, y1))):
        df, ray = bind(df, f"{name}_ray{i}", G.persp_ray(x, y, view, *size, hfov, vfov))
        u, v = G.ray_equirect(ray, pano, *pano_size)
        df = df.withColumns({f"{name}_u{i}": u, f"{name}_v{i}": v})
        us.append(F.col(f"{name}_u{i}"))
        vs.append(F.col(f"{name}_v{i}"))
    width = pano_size[0]
    total = lambda f: sum((f(u * (TAU / width)) for u in us), F.lit(0.0))
    df = df.withColumn(f"{name}_mid", F.pmod(F.atan2(total(F.sin), total(F.cos)), F.lit(TAU)) * (width / TAU))
    near = [u + F.bround((F.col(f"{name}_mid") - u) / width, 0) * width for u in us]
    return df, (F.least(*near), F.least(*vs), F.greatest(*near), F.greatest(*vs))


def unwrap(points: Column, width: float, reference: Column | None = None) -> Column:
    """Circular x moved by whole turns to the turn around `reference`, or their circular mean."""
    if reference is None:
        total = lambda f: F.aggregate(points, F.lit(0.0), lambda s, p: s + f(p["x"] * (TAU / width)))
        reference = F.pmod(F.atan2(total(F.sin), total(F.cos)), F.lit(TAU)) * (width / TAU)
    return F.transform(points, lambda p: F.struct((p["x"] + F.bround((reference - p["x"]) / width, 0) * width).alias("x"), p["y"].alias("y")))


def rect_fov(points: Column, pano: G.Axes, pano_size: tuple[float, float], view: G.Axes, margin: float, least: float, most: float) -> tuple[Column, Column]:
    """Fields of view (degrees) that hold the pixels with a margin, within limits."""

    def widest(pick: Callable[[Vec], Column]) -> Column:
        def one(p: Column) -> Column:
            v = local(G.pixel_ray(p["x"], p["y"], pano, *pano_size), view)
            return F.when(v[2] > 1e-6, F.abs(F.atan2(pick(v), v[2]))).otherwise(0.0)

        full = F.degrees(F.array_max(F.transform(points, one)) * 2) + 2 * margin
        return F.least(F.greatest(full, F.lit(max(least, 1.0))), F.lit(most))

    return widest(lambda v: v[0]), widest(lambda v: v[1])


def nine_rays(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, size: tuple[float, float]) -> np.ndarray:
    """boxes x 9 x 3: rays (right, forward, up) of the corners, edge middles and centres of boxes
    in a panorama of `forward_axes`."""
    lon = (np.stack([x0, (x0 + x1) * 0.5, x1], 1) / size[0] - 0.5) * TAU
    lat = (0.5 - np.stack([y0, (y0 + y1) * 0.5, y1], 1) / size[1]) * math.pi
    flat = np.cos(lat)[:, None, :]
    rays = [flat * np.sin(lon)[:, :, None], flat * np.cos(lon)[:, :, None], np.broadcast_to(np.sin(lat)[:, None, :], (len(x0), 3, 3))]
    return np.stack([r.reshape(-1, 9) for r in rays], 2)


def _by_batches(df: DataFrame, keep: tuple[str, ...], given: list[Column], schema: str, solve: Callable[..., list[np.ndarray]]) -> DataFrame:
    """keep and what solve makes of the given numbers (nulls are NaN), an Arrow batch at a time.
    Nine pixels a row make code of over 8000 bytes, which the JVM leaves uncompiled."""
    rows = df.select(*keep, *[c.cast("double").alias(f"__{i}") for i, c in enumerate(given)])
    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in keep)
    names = [*keep, *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = solve(*[c.to_numpy(zero_copy_only=False) for c in batch.columns[len(keep) :]])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(m) for m in made]], names=names)

    return rows.mapInArrow(run, f"{kinds}, {schema}")


def pano_to_persp_box(df: DataFrame, keep: tuple[str, ...], box: tuple, pano_size: tuple[float, float], size: tuple[float, float], hfov: float, vfov: float, ahead: float) -> DataFrame:
    """keep, n, u0, v0, u1, v1: how many of a box's nine pixels a forward view sees (the ray's part
    along it over `ahead`) and their box, as `pano_to_persp` and `box_of` give them; n is 0 for none."""
    fx, fy = size[0] * 0.5 / math.tan(math.radians(hfov) / 2), size[1] * 0.5 / math.tan(math.radians(vfov) / 2)

    def solve(*edges: np.ndarray) -> list[np.ndarray]:
        right, forward, up = np.moveaxis(nine_rays(*edges, pano_size), 2, 0)
        seen = forward > ahead
        depth = np.where(seen, forward, 1.0)
        u, v = size[0] * 0.5 + fx * (right / depth), size[1] * 0.5 - fy * (up / depth)
        return [seen.sum(1).astype(np.int32), *[np.where(seen, c, np.inf).min(1) for c in (u, v)], *[np.where(seen, c, -np.inf).max(1) for c in (u, v)]]

    return _by_batches(df, keep, list(box), "n int, u0 double, v0 double, u1 double, v1 double", solve)


def rect_fov_box(df: DataFrame, keep: tuple[str, ...], box: tuple, pano_size: tuple[float, float], view: G.Axes, margin: float, least: float, most: float) -> DataFrame:
    """keep, hfov, vfov: as `rect_fov` for the nine pixels of a box in a panorama of `forward_axes`.
    The widest angle is that of the greatest tangent."""

    def solve(x0, y0, x1, y1, *axes: np.ndarray) -> list[np.ndarray]:
        rays = nine_rays(x0, y0, x1, y1, pano_size)
        ahead, right, up = (np.einsum("nkd,dn->nk", rays, np.stack(axes[i : i + 3])) for i in (0, 3, 6))
        front = ahead > 1e-6
        depth = np.where(front, ahead, 1.0)
        widest = [np.arctan(np.where(front, np.abs(c) / depth, 0.0).max(1)) for c in (right, up)]
        return [np.minimum(np.maximum(np.degrees(w * 2) + 2 * margin, max(least, 1.0)), most) for w in widest]

    return _by_batches(df, keep, [*box, *[c for axis in view for c in axis]], "hfov double, vfov double", solve)


def corridor_box(x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int, side: float, top: float) -> tuple[Column, Column, Column, Column]:
    """The part of a view under a sign where its support may stand."""
    w, h = F.greatest(F.lit(1.0), x1 - x0), F.greatest(F.lit(1.0), y1 - y0)
    return F.greatest(F.lit(0.0), x0 - w * side), F.greatest(F.lit(0.0), y0 - h * top), F.least(F.lit(width - 1.0), x1 + w * side), F.lit(height - 1.0)


def corridor_masks(u: Column, v: Column, box: tuple, distance: Column, direct: float) -> tuple[Column, Column]:
    """(inside the corridor, or in its rows and farther than `direct` from the sign)."""
    x0, y0, x1, y1 = (F.lit(c) if not isinstance(c, Column) else c for c in box)
    rows = F.coalesce((v >= y0) & (v <= y1), F.lit(False))
    strict = rows & (u >= x0) & (u <= x1)
    return strict, strict | (rows & (distance > direct))


def uv_direction(u: Column, v: Column) -> Vec:
    """(right, up, forward) of normalised panorama coordinates; u wraps, v is clamped."""
    lon, lat = (F.pmod(u, F.lit(1.0)) - 0.5) * TAU, (0.5 - clip(v, 0.0, 1.0)) * math.pi
    return F.cos(lat) * F.sin(lon), F.sin(lat), F.cos(lat) * F.cos(lon)


def uv_sphere(u: Column, v: Column, radius: float) -> Vec:
    """Place on the viewer's sphere, whose axes are -x forward, -z right and +y up."""
    r, up, f = uv_direction(u, v)
    return f * -radius, up * radius, r * -radius


def local_to_pano(point: Vec, axes: G.Axes, nearest: float = 0.05) -> tuple[Column, Column, Column]:
    """Normalised u, v and depth of a point given from the frame's origin; null if too near."""
    u, v, d = G.project_equirect(point, const(0, 0, 0), axes, 1.0, 1.0)
    far = d > nearest
    return F.when(far, F.pmod(u, F.lit(1.0))), F.when(far, clip(v, 0.0, 1.0)), F.when(far, d)


def forward_axes() -> G.Axes:
    """Forward along y, right along x, up along z."""
    return const(0, 1, 0), const(1, 0, 0), const(0, 0, 1)


def fit_overviews(rays: np.ndarray, up: np.ndarray, padding: float, most: float, aspect: float, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Views of n x k unit rays with square pixels: (forward, hfov, vfov, good). Each round
    turns every view to the middle of its own angular extent; a view that can't hold its rays
    within `most` degrees isn't good."""
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    total = rays.sum(1)
    good = np.linalg.norm(total, axis=1) > 1e-10
    forward = unit(np.where(good[:, None], total, rays[:, 0]))

    def angles() -> tuple[np.ndarray, ...]:
        side = np.cross(forward, up)
        flat = np.linalg.norm(side, axis=1) < 1e-8
        right = unit(np.where(flat[:, None], np.array([1.0, 0.0, 0.0]), side))
        above = np.cross(right, forward)
        x, y, z = (np.einsum("nkd,nd->nk", rays, a) for a in (right, above, forward))
        return right, above, np.arctan2(x, z), np.arctan2(y, z), z.min(1)

    for _ in range(rounds):
        right, above, h, v, ahead = angles()
        good &= ahead > 1e-8
        dh, dv = (h.min(1) + h.max(1)) / 2, (v.min(1) + v.max(1)) / 2
        move = np.maximum(np.abs(dh), np.abs(dv))
        good &= move < np.radians(89)
        step = good & (move >= 1e-11)
        if not step.any():
            break
        turned = forward + right * np.tan(dh)[:, None] + above * np.tan(dv)[:, None]
        forward = np.where(step[:, None], unit(turned), forward)
    _, _, h, v, ahead = angles()
    half_h, half_v = np.abs(h).max(1) + np.radians(padding), np.abs(v).max(1) + np.radians(padding)
    good &= (ahead > 1e-8) & (np.maximum(half_h, half_v) < np.radians(89.9))
    scale = np.maximum(np.maximum(np.tan(half_h) / aspect, np.tan(half_v)), np.tan(np.radians(1e-4)))
    hfov, vfov = np.degrees(2 * np.arctan(aspect * scale)), np.degrees(2 * np.arctan(scale))
    good &= (hfov <= most + 1e-9) & (vfov <= most + 1e-9)
    return forward, hfov, vfov, good
