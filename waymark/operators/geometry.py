"""Camera geometry as column expressions: axes, projections and their inverses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.vectors import TAU, Vec, add, bind, clip, const, cross, dot, norm, pick, scale, sub, unit

EARTH_RADIUS_M = 6371008.8


Axes = tuple[Vec, Vec, Vec]


def camera_axes(df: DataFrame, forward: Vec, up: Vec, name: str = "axes") -> tuple[DataFrame, Axes]:
    """Right-handed forward, right, up, as columns of df."""
    df, f = bind(df, f"{name}_f", unit(forward))
    df, r = bind(df, f"{name}_s", cross(f, up))
    df, r = bind(df, f"{name}_r", unit(r))
    df, u = bind(df, f"{name}_u", cross(r, f))
    return df, (f, r, u)


def axes_offset(f: Vec, r: Vec, u: Vec, yaw_deg: Column, pitch_deg: Column) -> Axes:
    """Positive yaw moves projected points right, positive pitch moves them down."""
    cy, sy, cp, sp = F.cos(F.radians(yaw_deg)), F.sin(F.radians(yaw_deg)), F.cos(F.radians(pitch_deg)), F.sin(F.radians(pitch_deg))
    turned = sub(scale(f, cy), scale(r, sy))
    right = add(scale(f, sy), scale(r, cy))
    return add(scale(turned, cp), scale(u, sp)), right, sub(scale(u, cp), scale(turned, sp))


def view_axes(df: DataFrame, forward: Vec, up: Vec, fallback_right: Vec | None = None, name: str = "view") -> tuple[DataFrame, Axes]:
    """Axes of a rectified view; where forward and up are parallel a fallback gives the right."""
    df, f = bind(df, f"{name}_f", unit(forward))
    df, first = bind(df, f"{name}_a", cross(f, up))
    df, second = bind(df, f"{name}_b", cross(f, fallback_right or const(1, 0, 0)))
    chosen = pick(norm(first) >= 1e-8, first, pick(norm(second) >= 1e-8, second, cross(f, const(0, 1, 0))))
    df, r = bind(df, f"{name}_s", chosen)
    df, r = bind(df, f"{name}_r", unit(r))
    df, u = bind(df, f"{name}_u", cross(r, f))
    return df, (f, r, u)


def roll_stable_axes(df: DataFrame, forward: Vec, up: Vec, right: Vec, name: str = "roll") -> tuple[DataFrame, Axes]:
    """Up is the reference up made square to forward; at its pole the reference right decides."""
    df, f = bind(df, f"{name}_f", unit(forward))
    df, ref = bind(df, f"{name}_ref", unit(up))
    df, flat = bind(df, f"{name}_flat", sub(ref, scale(f, dot(ref, f))))
    df, side = bind(df, f"{name}_side", sub(right, scale(f, dot(right, f))))
    usable = norm(flat) >= 1e-8
    df, s = bind(df, f"{name}_s", pick(usable, cross(f, flat), pick(norm(side) >= 1e-8, side, const(1, 0, 0))))
    df, r = bind(df, f"{name}_r", unit(s))
    df, u = bind(df, f"{name}_u", cross(r, f))
    return df, (f, r, u)


def project_equirect(point: Vec, origin: Vec, axes: Axes, width: float, height: float) -> tuple[Column, Column, Column]:
    """Panorama u, v and distance of a point; a point at the origin looks straight ahead."""
    f, r, u = axes
    v = sub(point, origin)
    d = norm(v)
    safe = F.when(d > 0, d).otherwise(1.0)
    x, y, z = dot(v, r) / safe, clip(dot(v, u) / safe, -1.0, 1.0), dot(v, f) / safe
    return (F.atan2(x, z) / TAU + 0.5) * width, (0.5 - F.asin(y) / math.pi) * height, d


def focal(width: float, height: float, hfov: Column, vfov: Column) -> tuple[Column, Column]:
    return (F.lit(width) * 0.5) / F.tan(F.radians(hfov) / 2), (F.lit(height) * 0.5) / F.tan(F.radians(vfov) / 2)


def project_persp(point: Vec, origin: Vec, axes: Axes, width: float, height: float, hfov: Column, vfov: Column) -> tuple[Column, Column, Column, Column]:
    """u, v (null when not in front), distance and whether the point is in front."""
    f, r, u = axes
    v = sub(point, origin)
    x, y, z = dot(v, r), dot(v, u), dot(v, f)
    fx, fy = focal(width, height, hfov, vfov)
    ok = z > 1e-6
    depth = F.when(ok, z)
    return width * 0.5 + fx * (x / depth), height * 0.5 - fy * (y / depth), norm(v), ok


def pixel_ray(px: Column, py: Column, axes: Axes, width: float, height: float) -> Vec:
    f, r, u = axes
    lon, lat = (px / width - 0.5) * TAU, (0.5 - py / height) * math.pi
    return add(add(scale(f, F.cos(lat) * F.cos(lon)), scale(r, F.cos(lat) * F.sin(lon))), scale(u, F.sin(lat)))


def ray_equirect(ray: Vec, axes: Axes, width: float, height: float) -> tuple[Column, Column]:
    u, v, _ = project_equirect(ray, const(0, 0, 0), axes, width, height)
    return u, v


def persp_ray(px: Column, py: Column, axes: Axes, width: float, height: float, hfov: Column, vfov: Column) -> Vec:
    f, r, u = axes
    fx, fy = focal(width, height, hfov, vfov)
    return unit(add(f, add(scale(r, (px - width * 0.5) / fx), scale(u, (height * 0.5 - py) / fy))))


def heading(east: Column, north: Column) -> Column:
    """Compass bearing in degrees; null for a direction that is nearly vertical."""
    return F.when(F.hypot(east, north) > 1e-12, F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0)))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dl, a, b = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    return F.pmod(F.degrees(F.atan2(F.sin(dl) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dl))) + 360.0, F.lit(360.0))


def signed_angle(degrees: Column) -> Column:
    """Wrapped to -180 (included) .. 180."""
    return F.pmod(degrees + 540.0, F.lit(360.0)) - 180.0


def bbox_distance_2d(x: Column, y: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    x0, y0, x1, y1 = box
    zero = F.lit(0.0)
    return F.hypot(F.greatest(x0 - x, zero, x - x1), F.greatest(y0 - y, zero, y - y1))


def bbox_distance_3d(p: Vec, low: Vec, high: Vec) -> Column:
    zero = F.lit(0.0)
    return norm(tuple(F.greatest(a - x, zero, x - b) for x, a, b in zip(p, low, high)))  # type: ignore[arg-type]


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    zero = F.lit(0.0)
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero)
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)
    area = lambda q: F.greatest(q[2] - q[0], zero) * F.greatest(q[3] - q[1], zero)
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def iou_circular(a: tuple[Column, ...], b: tuple[Column, ...], width: float) -> Column:
    """Greatest IoU over shifts of b by a whole turn, for boxes across the seam."""
    return F.greatest(*[iou(a, (b[0] + s, b[1], b[2] + s, b[3])) for s in (-width, 0.0, width)])


def cone_hit(low: Vec, high: Vec, origin: Vec, ray: Vec, angle: Column, margin: float, reach: float) -> Column:
    """Whether a block can meet a view cone. A block centred just at the origin never does."""
    v = sub(scale(add(low, high), 0.5), origin)
    d, radius = norm(v), norm(sub(high, low)) * 0.5
    to = F.acos(clip(dot(v, ray) / F.when(d > 0, d), -1.0, 1.0))
    spread = F.when(d <= radius, math.pi).otherwise(F.asin(F.least(F.lit(1.0), radius / F.when(d > 0, d))))
    return F.coalesce((d > 0) & (d - radius <= reach) & (to <= angle + margin + spread), F.lit(False))
