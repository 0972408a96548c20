"""Pole shafts and ground under signs: robust fits per detection.

Candidates per detection are a bounded neighbourhood (the search radius), so each detection is
one group; the fits themselves are short numpy functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from waymark.operators.axes import parts_quantile


def theil_sen(t: np.ndarray, v: np.ndarray) -> tuple[float, float]:
    """Median pairwise slope and the median intercept."""
    i, j = np.triu_indices(len(t), 1)
    apart = np.abs(t[j] - t[i]) > 1e-9
    slope = float(np.median((v[j] - v[i])[apart] / (t[j] - t[i])[apart])) if apart.any() else 0.0
    return slope, float(np.median(v - slope * t))


def fit_axis(xyz: np.ndarray, bin_m: float = 0.10, rounds: int = 5, floor: float = 0.05) -> dict | None:
    """Shaft axis x(z), y(z): medians of height bins, a Theil-Sen seed, then least squares on
    the points within median + 3 MAD of the axis. Tilts under 2 degrees become vertical, those
    up to 4 are blended towards it."""
    if len(xyz) < 3:
        return None
    z = xyz[:, 2]
    bins = np.floor((z - z.min()) / bin_m + 1e-9).astype(int)
    which = np.unique(bins, return_inverse=True)[1].ravel()
    mid = np.stack([parts_quantile(c, which, 0.5) for c in xyz.T], 1)
    if len(mid) < 3:
        return None
    (ax, bx), (ay, by) = theil_sen(mid[:, 2], mid[:, 0]), theil_sen(mid[:, 2], mid[:, 1])
    keep = np.ones(len(xyz), bool)
    for _ in range(rounds):
        far = np.hypot(xyz[:, 0] - ax * z - bx, xyz[:, 1] - ay * z - by)
        m = np.median(far)
        new = far <= max(floor, m + 3 * np.median(np.abs(far - m)))
        if new.sum() < 3:
            break
        a = np.c_[z[new], np.ones(new.sum())]
        (ax, bx), (ay, by) = np.linalg.lstsq(a, xyz[new, 0], rcond=None)[0], np.linalg.lstsq(a, xyz[new, 1], rcond=None)[0]
        if (new == keep).all():
            break
        keep = new
    tilt = float(np.degrees(np.arctan(np.hypot(ax, ay))))
    s = min(1.0, max(0.0, (tilt - 2) / 2))
    s = s * s * (3 - 2 * s)
    zm = float(z[keep].mean())
    bx, by = bx + ax * zm * (1 - s), by + ay * zm * (1 - s)
    ax, ay = ax * s, ay * s
    far = np.hypot(xyz[keep, 0] - ax * z[keep] - bx, xyz[keep, 1] - ay * z[keep] - by)
    return {"ax": float(ax), "bx": float(bx), "ay": float(ay), "by": float(by), "tilt_deg": tilt, "rmse": float(np.sqrt((far**2).mean())), "inliers": int(keep.sum()), "bins": len(mid), "low": float(z[keep].min()), "top": float(z[keep].max())}


def fit_ground(xyz: np.ndarray, cell_m: float = 0.20, quantile: float = 0.10, band: float = 0.35, rounds: int = 5) -> dict | None:
    """Plane through the low points of cells, refitted within 3 MAD."""
    if len(xyz) < 3:
        return None
    cells = np.floor(xyz[:, :2] / cell_m).astype(np.int64)
    _, which = np.unique(cells, axis=0, return_inverse=True)
    low = np.stack([parts_quantile(c, which.ravel(), q) for c, q in zip(xyz.T, (0.5, 0.5, quantile))], 1)
    low = low[np.abs(low[:, 2] - np.median(low[:, 2])) <= band]
    keep = np.ones(len(low), bool)
    plane = None
    for _ in range(rounds):
        if keep.sum() < 3:
            return None
        plane = np.linalg.lstsq(np.c_[low[keep, :2], np.ones(keep.sum())], low[keep, 2], rcond=None)[0]
        off = np.abs(low[:, 2] - low[:, :2] @ plane[:2] - plane[2])
        m = np.median(off)
        new = off <= max(0.02, m + 3 * np.median(np.abs(off - m)))
        if (new == keep).all():
            break
        keep = new
    off = low[keep, 2] - low[keep, :2] @ plane[:2] - plane[2]
    return {"a": float(plane[0]), "b": float(plane[1]), "c": float(plane[2]), "rmse": float(np.sqrt((off**2).mean())), "cells": int(keep.sum())}


def meet(axis: dict, ground: dict) -> tuple[float, float, float]:
    """Where the axis meets the plane; a plane along the axis gives the lowest point seen."""
    k = 1 - ground["a"] * axis["ax"] - ground["b"] * axis["ay"]
    z = (ground["a"] * axis["bx"] + ground["b"] * axis["by"] + ground["c"]) / k if abs(k) > 1e-9 else axis["low"]
    return axis["ax"] * z + axis["bx"], axis["ay"] * z + axis["by"], z


def contact(gap: float) -> str:
    """State of the shaft's foot from the height between it and the ground."""
    return "OCCLUDED" if gap > 0.35 else "GROUND_CONFLICT" if gap < -0.10 else "VISIBLE"


_FOUND = "detection_id long, base_x double, base_y double, base_z double, tilt_deg double, axis_rmse double, ground_rmse double, inliers long, state string, status string"


def find_pole(points: pd.DataFrame, shaft_m: float = 0.35) -> pd.DataFrame:
    """The support of one detection (sign_x, sign_y, sign_z): the XY cell with most height bins
    near the sign seeds the axis, all points give the ground."""
    xyz = points[["x", "y", "z"]].to_numpy(float)
    sign = points[["sign_x", "sign_y", "sign_z"]].iloc[0].to_numpy(float)
    empty = pd.DataFrame(columns=[c.split()[0] for c in _FOUND.split(", ")])
    ground = fit_ground(xyz)
    if ground is None:
        return empty
    clear = xyz[xyz[:, 2] > xyz[:, :2] @ np.array([ground["a"], ground["b"]]) + ground["c"] + 0.2]
    best = None
    for c in np.unique(np.floor(clear[:, :2] / 0.2), axis=0) if len(clear) else ():
        near = clear[np.hypot(*(clear[:, :2] - (c + 0.5) * 0.2).T) <= shaft_m]
        bins = len(np.unique(np.floor(near[:, 2] / 0.1)))
        key = (bins, -float(np.hypot(*((c + 0.5) * 0.2 - sign[:2]))), *(-c))
        if bins >= 10 and (best is None or key > best[0]):
            best = key, near
    axis = fit_axis(best[1]) if best else None
    if axis is None or sign[2] - (sign[:2] @ np.array([ground["a"], ground["b"]]) + ground["c"]) < 1.8:
        return empty
    x, y, z = meet(axis, ground)
    state = contact(axis["low"] - z)
    auto = state == "VISIBLE" and ground["rmse"] <= 0.075 and axis["rmse"] <= 0.095
    row = (int(points["detection_id"].iloc[0]), x, y, z, axis["tilt_deg"], axis["rmse"], ground["rmse"], axis["inliers"], state, "AUTO" if auto else "REVIEW")
    return pd.DataFrame([row], columns=empty.columns)


def find_poles(neighbourhoods: DataFrame) -> DataFrame:
    """neighbourhoods: detection_id, sign_x, sign_y, sign_z and the points within the search
    radius (x, y, z). One row for each detection whose support is found."""
    return neighbourhoods.groupBy("detection_id").applyInPandas(lambda p: find_pole(p), _FOUND)


def colour_shift(image: np.ndarray, px: np.ndarray, rgb: np.ndarray, reach: int, trim: float) -> tuple[int, int, float]:
    """Shift (dx, dy) of the pixels with the least trimmed mean colour error; x wraps; ties go
    to the smallest |dx| + |dy|, then dx, then dy."""
    h, w = image.shape[:2]
    best = None
    for dx in range(-reach, reach + 1):
        for dy in range(-reach, reach + 1):
            y = px[:, 1] + dy
            ok = (y >= 0) & (y < h)
            err = np.sort(np.abs(image[y[ok], (px[ok, 0] + dx) % w].astype(float) - rgb[ok]).mean(1))
            if len(err):
                key = (round(float(err[: max(1, int(len(err) * trim))].mean()), 9), abs(dx) + abs(dy), dx, dy)
                best = key if best is None or key < best else best
    return (best[2], best[3], best[0]) if best else (0, 0, float("nan"))
