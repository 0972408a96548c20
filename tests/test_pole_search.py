"""The support search: fits against plain loops and known truth, then each stage's table against
a plain version of that stage."""

from __future__ import annotations

import math
import os
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from waymark.operators import axes as A
from waymark.operators import pole_search as P
from waymark.operators.axes import Search
from waymark.plans import search as Q

DATA = "/root/testdata/sf0.001"
SF = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
S = Search()
KEY = ["sign_id"]
GROUP = [*KEY, "profile"]


def median(values):
    v = sorted(values)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


# ---- fits ----------------------------------------------------------------------------------


def plain_arm(along, side, up, length, s=S):
    """axes.arm_line with one point and one pair of modes at a time."""
    n = max(1, math.ceil(length / s.arm_bin))
    bins = [min(n - 1, math.floor(a / s.arm_bin)) for a in along]
    full = lambda own: [sum(1 for i in own if bins[i] == b) >= s.arm_least for b in range(n)]
    every = range(len(along))
    occupied = sum(full(every))

    def modes(at):
        cells = defaultdict(list)
        for i in at:
            cells[math.floor(side[i] / 0.06), math.floor(up[i] / 0.06)].append(i)
        found = [(median([along[i] for i in c]), median([side[i] for i in c]), median([up[i] for i in c]), len(c)) for c in cells.values() if len(c) >= s.arm_least]
        return sorted(found, key=lambda m: (-m[3], abs(m[2]), abs(m[1]), m[0]))[:32]

    best = None
    for a in modes([i for i in every if bins[i] <= 1]):
        for b in modes([i for i in every if bins[i] >= n - 2]):
            if b[0] - a[0] < length / 2:
                continue
            m, k = (b[1] - a[1]) / (b[0] - a[0]), (b[2] - a[2]) / (b[0] - a[0])
            if abs(m) > math.tan(math.radians(15)) or abs(k) > math.tan(math.radians(35)):
                continue
            off = {i: math.sqrt((side[i] - (a[1] + (along[i] - a[0]) * m)) ** 2 + (up[i] - (a[2] + (along[i] - a[0]) * k)) ** 2) for i in every}
            own = [i for i in every if off[i] <= s.arm_tube]
            f = full(own)
            key = (any(f[:2]) and any(f[-2:]), sum(f), sum(1 for i in own if 2 <= bins[i] <= n - 3), -median([off[i] for i in own]) if own else -math.inf)
            if best is None or key > best[0]:
                best = key, own
    between = [i for i in every if 2 <= bins[i] <= n - 3]
    if n <= 4:
        own, lined, anchored, share, ratio = list(every), occupied, occupied > 0, 1.0 * bool(along), 1.0 * bool(occupied)
    else:
        own, lined, anchored = (best[1], best[0][1], best[0][0]) if best else ([], 0, False)
        share, ratio = len(set(own) & set(between)) / max(1, len(between)), lined / max(1, occupied)
    margin = min(s.arm_bin, 0.2 * length)
    inner = [i for i in every if margin <= along[i] <= length - margin]
    room = max(s.arm_bin, length - 2 * margin) if inner else max(length, s.arm_bin)
    ridge = len(set(own) & set(inner or every))
    return {"expected": n, "occupied": occupied, "coverage": occupied / n, "arm_points": len(along), "ridge_points": ridge, "ridge_density": ridge / room, "lined": lined, "line_coverage": lined / n, "line_ratio": ratio, "line_share": share, "anchored": anchored}


@pytest.mark.parametrize("seed", range(12))
def test_arm_line(seed):
    rng = np.random.default_rng(seed)
    length = float(rng.choice([0.8, 1.0, 1.9, 3.1, 6.4]))
    n = int(rng.integers(1, 260))
    along = rng.uniform(0, length, n)
    mast = rng.random(n) < 0.6
    side = np.where(mast, 0.05 * along / length + rng.normal(0, 0.02, n), rng.uniform(-0.25, 0.25, n)).clip(-0.25, 0.25)
    up = np.where(mast, -0.15 + 0.2 * along / length + rng.normal(0, 0.02, n), rng.uniform(-0.3, 0.3, n)).clip(-0.3, 0.3)
    keep = ~((along > 0.4 * length) & (along < 0.6 * length)) if seed % 3 == 0 else np.ones(n, bool)
    got = A.arm_line(along[keep], side[keep], up[keep], length, S)
    want = plain_arm(along[keep].tolist(), side[keep].tolist(), up[keep].tolist(), length)
    assert got == pytest.approx(want)


def test_arm_of_a_rising_mast_beats_a_flat_wire():
    x = np.linspace(0, 5, 400)
    wire = np.linspace(0, 5, 45)
    found = A.arm_line(np.r_[x, wire], np.r_[0 * x, 0 * wire], np.r_[-0.2 + 0.05 * x, 0.25 + 0 * wire], 5.0, S)
    assert found["anchored"] and found["lined"] == 20 and found["line_share"] > 0.85 and found["ridge_points"] == pytest.approx(360, abs=5)
    none = A.arm_line(np.array([]), np.array([]), np.array([]), 5.0, S)
    assert (none["occupied"], none["lined"], none["anchored"], none["line_share"]) == (0, 0, False, 0.0)


def shaft(rng, lean=(0.0, 0.0), low=0.1, high=5.0, rings=48, noise=0.004):
    z = np.repeat(np.linspace(low, high, rings), 6)
    a = np.tile(np.radians(60.0 * np.arange(6)), rings)
    xyz = np.c_[0.055 * np.cos(a) + lean[0] * z, 0.055 * np.sin(a) + lean[1] * z, z]
    return xyz + rng.normal(0, noise, xyz.shape)


@pytest.mark.parametrize("lean", [(0.0, 0.0), (0.02, -0.01), (0.1, 0.05), (-0.15, 0.1)])
def test_shaft_axis(lean):
    """The axis of a noisy shaft to a few millimetres; tilts under two degrees stand upright."""
    xyz = shaft(np.random.default_rng(3), lean)
    near = np.hypot(*(xyz[:, :2] - np.array(lean) * 2.5).T) <= 0.6
    f = A.shaft_axis(xyz[near], replace(S, inlier=0.18))
    at = f["line"][1] - f["line"][0] * (f["z0"] - 2.5)
    assert np.abs(at - np.array(lean) * 2.5).max() < 0.006
    tilt = math.degrees(math.atan(math.hypot(*lean)))
    assert np.abs(f["line"][0] - (np.array(lean) if tilt > 4 else 0)).max() < 0.006
    assert f["end_tilt"] == pytest.approx(tilt, abs=0.3)


def test_shaft_axis_ignores_a_car_and_an_arm():
    rng = np.random.default_rng(8)
    clean = shaft(rng)
    car = np.c_[rng.uniform(0.05, 0.2, 150), rng.uniform(-0.1, 0.2, 150), rng.uniform(0.3, 0.9, 150)]
    arm = np.c_[rng.uniform(0, 0.24, 120), rng.normal(0, 0.02, 120), rng.uniform(4.9, 5.05, 120)]
    f = A.shaft_axis(np.r_[clean, car, arm], S)
    assert np.abs(f["line"][0] * (0 - f["z0"]) + f["line"][1]).max() < 0.012


def test_no_shaft():
    rng = np.random.default_rng(1)
    assert A.shaft_axis(rng.normal(0, 0.05, (10, 3)), S) is None  # few
    assert A.shaft_axis(np.c_[rng.normal(0, 0.02, (100, 2)), rng.uniform(0, 0.4, 100)], S) is None  # low
    assert A.shaft_axis(np.c_[rng.normal(0, 0.02, (60, 2)), np.r_[rng.uniform(0, 0.7, 30), rng.uniform(3, 3.7, 30)]], S) is None  # a gap
    assert A.shaft_axis(shaft(rng, (0.4, 0.0)), S) is None  # leans


def disc(rng, a, b, c, radius=1.4, hole=0.3, n=900):
    xy = rng.uniform(-radius, radius, (n, 2))
    xy = xy[(np.hypot(*xy.T) > hole) & (np.hypot(*xy.T) < radius)]
    return np.c_[xy, xy @ [a, b] + c]


def test_ground_plane():
    """Exact planes to a micrometre; grass above and a pit below don't count."""
    rng = np.random.default_rng(5)
    xyz = disc(rng, 0.05, 0.02, 1.0)
    for classified in (False, True):
        g = A.ground_plane(xyz, np.zeros(2), classified, S)
        assert g["rmse"] < 0.02 and g["plane"][2] == pytest.approx(1.0, abs=0.02 if not classified else 0.01)
    level = disc(rng, 0.0, 0.0, 1.0)
    grass = np.c_[level[::3, :2], level[::3, 2] + rng.uniform(0.1, 0.5, len(level[::3]))]
    pit = np.c_[level[:3, :2], level[:3, 2] - 3]
    g = A.ground_plane(np.r_[level, grass], np.zeros(2), False, S)
    assert g["plane"] == pytest.approx([0, 0, 1], abs=1e-6)
    g = A.ground_plane(np.r_[np.repeat(level, 12, axis=0), pit], np.zeros(2), False, S)
    assert g["plane"] == pytest.approx([0, 0, 1], abs=1e-6)
    assert A.ground_plane(level[:4], np.zeros(2), False, S) is None
    assert A.ground_plane(np.c_[level[:, :2], rng.uniform(0, 3, len(level))], np.zeros(2), True, S) is None  # rough


def test_ground_beyond_a_kerb():
    """A shaft on an unclassified pavement: classified road is farther, so the pavement wins; with
    classified pavement, too, classes win."""
    rng = np.random.default_rng(6)
    xyz = disc(rng, 0.0, 0.0, 0.0, radius=1.5, n=3000)
    road = xyz[:, 0] > 0.9
    xyz[~road, 2] = 0.15
    road_only = np.where(road, 2, 1)
    assert A.local_ground(xyz, road_only, np.zeros(2), 5.0, S)["source"] == "geometry"
    assert A.local_ground(xyz, np.full(len(xyz), 2), np.zeros(2), 5.0, S)["source"] == "classified"
    assert A.local_ground(xyz, None, np.zeros(2), 5.0, S)["plane"][2] == pytest.approx(0.15, abs=1e-6)
    assert A.local_ground(xyz, None, np.zeros(2), 1.0, S) is None  # nothing 1.8 m below the sign
    assert A.local_ground(xyz[road], road_only[road], np.array([1.2, 0.0]), 1.7, S)["source"] == "classified"


def test_foot():
    at = np.array([2.0, 1.0])
    g = {"plane": np.array([0.1, -0.05, 3.0]), "at": at}
    line, z0 = np.array([[0.02, 0.01], [2.1, 0.9]]), 5.0
    x, y, z = A.foot(line, z0, g)
    assert [x, y] == pytest.approx(line[0] * (z - z0) + line[1]) and z == pytest.approx(3 + 0.1 * (x - 2) - 0.05 * (y - 1))


# ---- stages over scenes --------------------------------------------------------------------


@pytest.fixture(scope="module")
def scene(spark):
    """Every stage's table as pandas; scenes of all kinds."""
    cut = P.shared_checkpoint
    signs = cut(Q.scene_signs(spark, DATA))
    near = cut(P.neighbourhoods(signs, Q.scene_points(signs), Q.KEY, S, Q.corridor()))
    group = (*Q.KEY, P.PROFILE)
    points = cut(P.shaft_points(near, Q.KEY, S, False))
    cells = cut(P.shaft_cells(points, group, S))
    chosen = cut(P.seeds(cells, group, S))
    fits = cut(P.axis_fits(points, cells, chosen, group, S, False))
    distinct = cut(P.distinct_fits(fits, group, S))
    tested = cut(P.gated(P.attached(distinct, signs, Q.KEY, S, False), near, Q.KEY, S, False))
    ground = cut(P.grounds(tested.filter("reason IS NULL"), near, Q.KEY, S, False))
    found = cut(P.candidates(tested, ground, Q.KEY, S, False))
    frames = {"signs": signs, "near": near, "points": points, "cells": cells, "chosen": chosen, "fits": fits, "distinct": distinct, "tested": tested, "ground": ground, "found": found}
    return {k: v.toPandas() for k, v in frames.items()} | {"frames": frames}


def rows(df, columns, digits=9):
    return sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df[columns].itertuples(index=False))


@SF
def test_neighbourhoods(scene, spark):
    all_points = Q.scene_points(scene["frames"]["signs"]).toPandas()
    for sign in scene["signs"].itertuples():
        far = np.sqrt((all_points.x - sign.sx) ** 2 + (all_points.y - sign.sy) ** 2)
        want = all_points[(far <= 9.5) & (all_points.z >= sign.sz - 8) & (all_points.z <= sign.sz + 3)]
        got = scene["near"][scene["near"].sign_id == sign.sign_id]
        assert rows(got, ["x", "y", "z"]) == rows(want, ["x", "y", "z"])
        far = np.sqrt((got.x - sign.sx) ** 2 + (got.y - sign.sy) ** 2)
        assert (got.strict == ((got.y - sign.sy).abs() <= 1)).all() and (got.expanded == (got.strict | (far > 0.75))).all()


@SF
def test_shaft_points(scene):
    for sign_id, near in scene["near"].groupby("sign_id"):
        x, y, z = near.x.to_numpy(), near.y.to_numpy(), near.z.to_numpy()
        sx, sy = near.sx.iloc[0], near.sy.iloc[0]
        inside = np.sqrt((x - sx) ** 2 + (y - sy) ** 2) <= 8
        cells = defaultdict(list)
        at = [(math.floor((a - sx) / 0.25), math.floor((b - sy) / 0.25)) for a, b in zip(x, y)]
        for i in np.flatnonzero(inside):
            cells[at[i]].append(z[i])
        low = {c: sorted(v)[math.floor(0.1 * (len(v) - 1))] for c, v in cells.items()}
        terrain = {c: np.quantile([v for d, v in low.items() if (c[0] - d[0]) ** 2 + (c[1] - d[1]) ** 2 <= 9], 0.1) for c in low}
        keep = [i for i in np.flatnonzero(inside) if z[i] > terrain[at[i]] + 0.2]
        want = [(p, x[i], y[i], z[i]) for i in keep for p, flag in (("strict", near.strict.iloc[i]), ("expanded", near.expanded.iloc[i])) if flag]
        got = scene["points"][scene["points"].sign_id == sign_id]
        assert rows(got, ["profile", "x", "y", "z"]) == sorted((p, round(a, 9), round(b, 9), round(c, 9)) for p, a, b, c in want)


@SF
def test_cells_and_seeds(scene):
    sx = dict(zip(scene["signs"].sign_id, zip(scene["signs"].sx, scene["signs"].sy)))
    want_cells, want_seeds = [], []
    for key, pts in scene["points"].groupby(GROUP):
        own = []
        for (px, py), p in pts.groupby(["px", "py"]):
            span = p.z.max() - p.z.min()
            bins = sorted({math.floor((v - p.z.min()) / 0.15) for v in p.z})
            if len(p) < 3 or span < 0.45 or len(bins) < 3:
                continue
            run = best = 1
            for a, b in zip(bins, bins[1:]):
                run = run + 1 if b == a + 1 else 1
                best = max(best, run)
            mx, my = median(p.x), median(p.y)
            quality = best + len(bins) / (bins[-1] - bins[0] + 1) + min(span, 8) / 0.15 + 0.05 * math.sqrt(len(p))
            own.append((px, py, len(p), mx, my, best, quality, math.hypot(mx - sx[key[0]][0], my - sx[key[0]][1])))
        want_cells += [(*key, *c[:3], round(c[3], 9), round(c[4], 9), c[5], round(c[6], 6)) for c in own]
        kept = []
        for c in sorted(own, key=lambda c: (c[7] > 0.75, -c[6], c[7], c[0], c[1])):
            if all(math.hypot(c[3] - k[3], c[4] - k[4]) > 0.15 for k in kept):
                kept.append(c)
        want_seeds += [(*key, i, c[0], c[1]) for i, c in enumerate(kept)]
    cells = scene["cells"].assign(quality=scene["cells"].quality.round(6))
    assert rows(cells, [*GROUP, "px", "py", "n", "mx", "my", "longest", "quality"]) == sorted(want_cells)
    assert rows(scene["chosen"], [*GROUP, "seed", "px", "py"]) == sorted(want_seeds)


@SF
def test_axis_fits(scene):
    """A fit for just the seeds whose cylinder of points in good cells gives one, with its measures."""
    want = []
    cells = set(map(tuple, scene["cells"][[*GROUP, "px", "py"]].itertuples(index=False)))
    pts = scene["points"][[tuple(r) in cells for r in scene["points"][[*GROUP, "px", "py"]].itertuples(index=False)]]
    for key, seeds in scene["chosen"].groupby(GROUP):
        own = pts[(pts.sign_id == key[0]) & (pts.profile == key[1])]
        for seed in seeds.itertuples():
            p = own[np.sqrt((own.x - seed.mx) ** 2 + (own.y - seed.my) ** 2) <= 0.24]
            f = A.shaft_axis(p[["x", "y", "z"]].to_numpy(), S)
            if f:
                want.append((*key, seed.seed, int(f["on"].sum()), round(f["z0"], 6), *np.round(f["line"][1], 6), f["bins"], f["longest"], round(float((p.nr[f["on"]] > 1).mean()), 6)))
    got = scene["fits"].round(6)
    assert rows(got, [*GROUP, "seed", "n", "z0", "bx", "by", "bins", "longest", "multi"], 6) == sorted(want)
    kept = []
    for key, fits in scene["fits"].groupby(GROUP):
        own = []
        for f in fits.sort_values("seed").itertuples():
            twin = next((i for i, k in enumerate(own) if math.hypot(f.bx - k.bx, f.by - k.by) < 0.15), None)
            if twin is None:
                own.append(f)
            elif (f.longest, f.occupancy, f.n, -f.rmse) > (own[twin].longest, own[twin].occupancy, own[twin].n, -own[twin].rmse):
                own[twin] = f
        kept += [(*key, f.seed) for f in own]
    assert rows(scene["distinct"], [*GROUP, "seed"]) == sorted(kept)


@SF
def test_arms_and_reasons(scene):
    signs = scene["signs"].set_index("sign_id")
    for r in scene["tested"].itertuples():
        s = signs.loc[r.sign_id]
        ax, ay = r.bx + r.kx * (s.sz - r.z0), r.by + r.ky * (s.sz - r.z0)
        far = math.hypot(ax - s.sx, ay - s.sy)
        assert (r.distance, r.remote) == (pytest.approx(far), far > 0.75) and far <= 8
        if not r.remote:
            assert r.reason is None
            continue
        n = scene["near"][scene["near"].sign_id == r.sign_id]
        ux, uy = (ax - s.sx) / far, (ay - s.sy) / far
        dx, dy, up = n.x - s.sx, n.y - s.sy, n.z - s.sz
        along, side = dx * ux + dy * uy, dx * uy - dy * ux
        m = (along >= 0) & (along <= far) & (side.abs() <= 0.25) & (up.abs() <= 0.3)
        a = plain_arm(along[m].tolist(), side[m].tolist(), up[m].tolist(), far)
        assert {k: getattr(r, k) for k in a} == pytest.approx(a)
        short = far <= 3 and a["anchored"] and min(a["coverage"], a["line_coverage"], a["line_ratio"]) >= 0.95 and a["ridge_density"] >= 20
        bad = a["expected"] > 4 and (not a["anchored"] or a["line_coverage"] < 0.5 or a["line_ratio"] < 0.65 or a["line_share"] < (0.1 if short else 0.3))
        assert r.reason == ("raw_coverage" if a["coverage"] < 0.5 else "coherent_arm" if bad else "endpoint_tilt" if (r.end_tilt or 0) > 5 else None)
    assert {"raw_coverage", "endpoint_tilt", None} <= set(scene["tested"].reason)


@SF
def test_candidates(scene):
    """Ground by the place's own points, and the gates, state, status, score and side of each."""
    tested = scene["tested"][scene["tested"].reason.isna()].merge(scene["signs"][["sign_id", "sz"]].rename(columns={"sz": "sign_z"}), on="sign_id")
    want = []
    for r in tested.itertuples():
        n = scene["near"][scene["near"].sign_id == r.sign_id]
        cx, cy = r.bx + r.kx * (r.low - r.z0), r.by + r.ky * (r.low - r.z0)
        n = n[np.sqrt((n.x - cx) ** 2 + (n.y - cy) ** 2) <= 1.5]
        g = A.local_ground(n[["x", "y", "z"]].to_numpy(), None, np.array([cx, cy]), r.sign_z, S)
        if g is None or r.sign_z - g["plane"][2] < 1.8:
            continue
        base = A.foot(np.array([[r.kx, r.ky], [r.bx, r.by]]), r.z0, g)
        lo = g["plane"][2] + 0.2 * (r.sign_z - g["plane"][2])
        expected = math.floor((r.sign_z - lo) / 0.15) + 1
        seen = {math.floor((h - lo) / 0.15 + 1e-9) for h in r.heights if lo <= h <= r.sign_z}
        middle = len({b for b in seen if 0 <= b < expected}) / expected
        complete = min(middle, 1.0, (r.z_hi - r.z_lo) / (r.sign_z - g["plane"][2]))
        support = min(math.hypot(x - base[0], y - base[1]) for x, y, _ in g["cells"])
        if middle < 0.3 or (r.remote and (complete < 0.75 or r.rmse > 0.095 or g["rmse"] > 0.15)):
            continue
        gap = r.low - base[2]
        state = "GROUND_CONFLICT" if gap < -0.1 else "OCCLUDED" if gap > 0.35 else "VISIBLE"
        auto = state == "VISIBLE" and g["rmse"] <= 0.15 and complete >= 0.75 and support <= 0.35 and r.rmse <= 0.095
        score = min(r.span, r.sign_z - base[2]) + 0.08 * r.bins + 0.03 * math.sqrt(r.n) - 5 * r.rmse - 0.15 * r.distance + 0.5 * (r.coverage if r.remote else 0) - 0.5 * r.multi
        lateral = -(r.ay - r.sy)  # the vehicle goes east
        side = "ALONG_TRAVEL" if abs(lateral) < max(0.15, 0.5 * r.distance) else "RIGHT_OF_TRAVEL" if lateral > 0 else "LEFT_OF_TRAVEL"
        want.append((r.sign_id, r.profile, r.seed, *[round(float(v), 6) for v in (*base, complete, score)], state, "AUTO" if auto else "REVIEW", side))
    got = scene["found"].round(6)
    assert rows(got, [*GROUP, "seed", "base_x", "base_y", "base_z", "complete", "score", "state", "status", "side"], 5) == sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in w) for w in want)


@SF
def test_find_supports_and_extract(scene, spark):
    """What each kind of scene must give, and the base to a centimetre of the truth."""
    signs, near = scene["frames"]["signs"], scene["frames"]["near"]
    one = P.find_supports(signs, near, Q.KEY, S, False)[0].toPandas().set_index("sign_id")
    best, rejected = P.extract(signs, Q.scene_points(signs), Q.KEY, Q.corridor())
    two, h = best.toPandas().set_index("sign_id"), rejected.toPandas()
    for s in scene["signs"].itertuples():
        i, y = s.sign_id, s.sy + (s.reach if s.kind == 7 else -s.reach)
        if s.kind in (2, 6):
            assert i not in one.index and i not in two.index
        elif s.kind == 3:  # ten metres away: the wider search alone, for review
            assert i not in one.index and two.loc[i, "attempt"] == "fallback" and two.loc[i, "status"] == "REVIEW"
        else:
            assert one.loc[i, "base_z"] == pytest.approx(two.loc[i, "base_z"], abs=0.02)
            direct = s.kind in (0, 5)
            assert (one.loc[i, "mode"], one.loc[i, "profile"]) == (("strict", "strict") if direct else ("remote_expanded", "expanded"))
            assert one.loc[i, "side"] == ("LEFT_OF_TRAVEL" if s.kind == 7 else "RIGHT_OF_TRAVEL")
            assert one.loc[i, "state"] == ("OCCLUDED" if s.kind == 5 else "VISIBLE") and one.loc[i, "status"] == ("REVIEW" if s.kind == 5 else "AUTO")
        if i in two.index:
            t = two.loc[i]
            assert math.hypot(t.base_x - s.sx, t.base_y - y) < 0.04 and abs(t.base_z) < 0.02
            want = s.confidence * t.complete * math.exp(-5 * t.rmse - 2 * t.ground_rmse) * (1 if t.status == "AUTO" else 0.75)
            assert t.quality == pytest.approx(want)
    broken = set(scene["signs"][scene["signs"].kind == 2].sign_id)
    assert broken <= set(h.sign_id) and (h.reason.isin(["raw_coverage", "coherent_arm"])).all()
    for _, own in h.sort_values("place").groupby("sign_id"):
        xy = own[["ax", "ay"]].to_numpy()
        assert list(own.place) == list(range(len(own))) and all(np.hypot(*(xy[:k] - xy[k]).T).min() > 0.15 for k in range(1, len(xy)))
        assert list(own.rmse) == sorted(own.rmse)


def test_pick_of_corridors_and_spacing(spark):
    """Hypotheses: smoothest first, spaced, bounded; nulls and no rows at all."""
    rng = np.random.default_rng(9)
    data = pd.DataFrame({"sign_id": rng.integers(0, 3, 400), "seed": np.arange(400), "rmse": rng.choice([0.02, 0.03], 400), "span": rng.choice([1.0, 2.0], 400), "distance": rng.uniform(1, 8, 400).round(1), "ax": rng.uniform(0, 2, 400), "ay": rng.uniform(0, 2, 400)})
    data["attempt"], data["profile"] = np.where(data.seed % 2, "strict", "fallback"), np.where(data.seed % 3, "strict", "expanded")
    got = P.spaced(spark.createDataFrame(data), ("sign_id",)).toPandas()
    for sign, own in data.groupby("sign_id"):
        kept = []
        for r in own.sort_values(["rmse", "span", "distance", "ax", "ay"], ascending=[True, False, True, True, True]).itertuples():
            if len(kept) < 64 and all(math.hypot(r.ax - k.ax, r.ay - k.ay) > 0.15 for k in kept):
                kept.append(r)
        assert got[got.sign_id == sign].sort_values("place").seed.tolist() == [k.seed for k in kept]


def test_empty_and_null(spark):
    signs = spark.createDataFrame([(1, None, 0.0, 5.0, 1.0, 0.0, 0.9), (2, 0.0, 0.0, 5.0, None, None, 0.9)], "sign_id long, sx double, sy double, sz double, fx double, fy double, confidence double")
    points = spark.createDataFrame([(0.1, 0.1, 1.0, None, None, None), (float("nan"), 0.0, 1.0, 1, 1, 1), (None, None, None, None, None, None)], "x double, y double, z double, cls int, rn int, nr int")
    for p in (points, points.limit(0)):
        best, rejected = P.extract(signs, p, Q.KEY, Q.corridor())
        assert best.count() == 0 and rejected.count() == 0


@SF
def test_classified_search(scene):
    """By classes alone, without terrain: shafts of class 6 and ground of class 2; excluded and
    ground points belong to no shaft."""
    signs, near = scene["frames"]["signs"], scene["frames"]["near"]
    s = replace(S, excluded_classes=(14, 15))
    pts = P.shaft_points(near, Q.KEY, s, True).toPandas()
    assert set(pts.cls) == {6}
    assert set(P.shaft_points(near, Q.KEY, replace(S, pole_classes=(15,)), True).toPandas().cls) == {15}
    got = P.find_supports(signs, near, Q.KEY, s, True)[0].toPandas().set_index("sign_id")
    for x in scene["signs"].itertuples():
        assert (x.sign_id in got.index) == (x.kind not in (2, 3, 6))
    assert (got.main_class == 6).all() and (got.main_share == 1).all() and set(got.ground_source) == {"classified"}


@SF
def test_points_move_once_a_stage(scene):
    """Voxels, fits, arms and grounds each shuffle their points once: what follows groups by the
    keys that brought points together."""
    f, group = scene["frames"], (*Q.KEY, P.PROFILE)
    moves = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert moves(P.shaft_cells(f["points"], group, S)) == 1
    assert moves(P.axis_fits(f["points"], f["cells"], f["chosen"], group, S, False)) == 2  # cells and seeds
    assert moves(P.grounds(f["tested"].filter("reason IS NULL"), f["near"], Q.KEY, S, False)) == 2  # points and feet
    assert moves(P.shaft_points(f["near"], Q.KEY, S, False)) <= 4  # points twice, cells twice


def test_terrain(spark):
    rng = np.random.default_rng(4)
    cells = {(int(i), int(j)): float(rng.normal()) for i, j in rng.integers(-9, 9, (120, 2))}
    low = spark.createDataFrame([(1, i, j, v) for (i, j), v in cells.items()], "sign_id long, cx long, cy long, low double")
    for r in P.terrain(low, Q.KEY, S).collect():
        assert r.terrain == pytest.approx(np.quantile([v for (i, j), v in cells.items() if (i - r.cx) ** 2 + (j - r.cy) ** 2 <= 9], 0.1))
