from __future__ import annotations

import os
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark import registry
from waymark.operators import clustering as C
from waymark.operators import poles as P
from waymark.operators import spatial, tiles
from waymark.operators.components import shared_checkpoint
from waymark.operators.sequences import even_sample, water_fill
from waymark.operators.spatial import radius_join
from waymark.operators.splits import validate_splits
from waymark.plans import clustering, supports, tables

DATA = "/root/testdata/sf0.001"


def test_radius_join_is_exact(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(-20, 20, (60, 2)), rng.uniform(-20, 20, (80, 2))
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "i long, ax double, ay double")
    right = spark.createDataFrame([(j, float(x), float(y)) for j, (x, y) in enumerate(b)], "j long, bx double, by double")
    got = {(r.i, r.j) for r in radius_join(left, right, ("ax", "ay"), ("bx", "by"), 5.0).collect()}
    assert got == {(i, j) for i in range(60) for j in range(80) if ((a[i] - b[j]) ** 2).sum() <= 25}


def test_density_cluster(spark):
    rng = np.random.default_rng(2)
    xyz = np.r_[rng.normal(0, 0.1, (30, 3)), rng.normal(5, 0.1, (20, 3)), [[20.0, 20, 20]]]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double")
    got = {r.point_id: r.component for r in C.density_cluster(df, 0.6, 4).collect()}
    assert {got[i] for i in range(30)} == {0} and {got[i] for i in range(30, 50)} == {30} and got[50] is None


def test_components(spark):
    from waymark.operators.components import components

    rng = np.random.default_rng(12)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (None, 7)]
    label = {x: x for p in pairs for x in p if x is not None}
    for _ in label:
        for a, b in pairs:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in pairs if a is not None and a != b for x in (a, b)}
    links = spark.createDataFrame(pairs, "a long, b long")
    for few in (0, 1000):
        got = components(links, few).collect()
        assert len(got) == len(linked) and {r.node: r.root for r in got} == {x: label[x] for x in linked}
        assert components(links.limit(0), few).count() == 0


def test_route_sample(spark):
    sizes = spark.createDataFrame([("a", 6), ("b", 2)], "t string, n long")
    assert {(r.t, r.quota) for r in water_fill(sizes, "t", "n", 5, "t").collect()} == {("a", 3), ("b", 2)}
    frames = spark.createDataFrame([("a", i) for i in range(6)] + [("b", i) for i in range(2)], "t string, o long")
    q = F.when(F.col("t") == "a", 3).otherwise(2)
    got = sorted((r.t, r.o) for r in even_sample(frames, ("t",), ["o"], q, half_even=True).collect())
    assert got == [("a", 0), ("a", 2), ("a", 5), ("b", 0), ("b", 1)]


def test_route_sample_is_its_sql(spark, tmp_path):
    """More tracks than the budget, one of them over 2000 frames; and tracks whose even places are halves."""
    halves = [(n, q) for n in range(2, 120) for q in range(2, n) if any(round(k * (n - 1) / (q - 1)) != round(k * ((n - 1) / (q - 1))) for k in range(q))]
    n, q = next((n, q) for n, q in halves if 500 // q * n < 20000)
    for name, tracks in (("many", [2100] + 500 * [2]), ("halves", 500 // q * [n])):
        rows = [(i, t, i) for i, t in enumerate(t for t, size in enumerate(tracks) for _ in range(size))]
        sf = str(tmp_path / name)
        events = spark.createDataFrame(rows, "event_id long, user_id long, s long")
        events.selectExpr("event_id", "user_id", "timestamp_seconds(s)::timestamp_ntz AS ts", "'view' AS event_type", "1.0D AS value", "'{\"k\": 1}' AS props").write.parquet(f"{sf}/events.parquet")
        duck = duckdb.connect()
        duck.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
        want = Counter(duck.sql(f"SELECT track_id, ordinal, frame_id FROM ({registry.ORACLE['route_sample']})").fetchall())
        assert Counter(tuple(r) for r in registry.QUERIES["route_sample"](spark, sf).collect()) == want
        assert sum(want.values()) == (3000 if name == "many" else 500)


def plain_nms(rows, threshold, width):
    """rows: index, confidence, x0, y0, x1, y1. One pair at a time."""
    kept = []
    for i, c, x0, y0, x1, y1 in sorted(rows, key=lambda r: (-r[1], r[0])):
        for k in kept:
            h = max(0, min(y1, k[5]) - max(y0, k[3]))
            w = max(max(0, min(x1 + s, k[4]) - max(x0 + s, k[2])) for s in (-width, 0, width))
            union = (x1 - x0) * (y1 - y0) + (k[4] - k[2]) * (k[5] - k[3]) - w * h
            if union > 0 and w * h / union >= threshold:
                k[6].append(i)
                break
        else:
            kept.append((i, c, x0, y0, x1, y1, [i]))
    return [(k[0], k[1], ",".join(map(str, sorted(k[6])))) for k in kept]


def test_nms_keeps_the_best_and_joins_sources():
    boxes = np.array([[0.0, 0, 10, 10], [1, 0, 11, 10], [4095, 0, 4105, 10]])
    assert C.nms(np.array([1, 2, 3]), np.array([0.5, 0.9, 0.8]), boxes, 0.5, 4096.0) == [(2, 0.9, "1,2,3")]


def test_nms_by_index_joins_sources_to_all_of_it():
    """As the SQL of the query does: 3 overlaps one of two kept boxes with index 2, and is joined to both."""
    boxes = np.array([[0, 0, 10, 10], [100, 0, 110, 10], [0, 0, 10, 9]], float)
    assert C.nms(np.array([2, 2, 3]), np.array([0.9, 0.8, 0.7]), boxes, 0.5, 4096.0, by_index=True) == [(2, 0.9, "2,3"), (2, 0.8, "2,3")]


def test_nms_merge_by_bands(spark):
    """Tall boxes, boxes over the seam, repeated indices, boxes without area: as pair by pair."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(400):
        x, y, w, h = (float(rng.uniform(0, 4096)), *(float(rng.choice(v)) for v in ([0, 500, 511, 1500], [0, 40, 300], [0, 30, 900])))
        rows.append((f"i{k % 5}", int(k % 2), int(rng.integers(0, 60)), float(rng.choice([0.5, 0.7, 0.9])), x, y, x + w, y + h))
    schema = "image_name string, class_id long, detection_index long, confidence double, x0 double, y0 double, x1 double, y1 double"
    got = C.nms_merge(spark.createDataFrame(rows, schema)).collect()
    want = Counter()
    for key in {r[:2] for r in rows}:
        want.update((*key, *r) for r in plain_nms([r[2:] for r in rows if r[:2] == key], 0.5, 4096.0))
    assert Counter(tuple(r) for r in got) == want
    assert C.nms_merge(spark.createDataFrame([], schema)).count() == 0


def test_nms_merge_ties_go_by_the_table(spark, tmp_path):
    """Two boxes of one index and confidence: the first of the table stays, though the file it is in is read last."""
    row = lambda key, line, price, quantity, discount: (key, 1, 5, line, quantity, price, discount, 0.0, "R", "F")
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    first, second, third = row(1, 1, 100.0, 20.0, 0.1), row(1, 1, 115.0, 20.0, 0.1), row(1, 2, 130.0, 20.0, 0.2)
    others = [row(k, 1, 7.0 * k, 1.0, 0.0) for k in range(2, 2000)]
    for k, rows in enumerate(([first], [second, third, *others])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"lineitem.parquet/k={k}"))
    got = clustering.nms_merge(spark, str(tmp_path)).filter("image_name = 'img1'").collect()
    assert sorted((r.detection_index, r.confidence, r.sources) for r in got) == [(1, 0.9, "1,1"), (2, 0.8, "2")]


def test_remap_relations(spark):
    """Relations follow their signs; one of each sign stays; those without a sign stay all."""
    merged = [(1, 1), (2, 1), (3, 1), (5, 5), (6, 7), (7, 7)]
    rel = [(1, "b", 5, 0.5, 0.9, "own"), (2, "a", 90, 0.9, 0.9, "more"), (6, "a", 3, None, 0.1, "x"), (6, "B", 3, float("nan"), 0.5, "y"), (7, None, None, None, None, "own7"), (9, "c", 1, 0.1, 0.1, "free"), (9, "b", 1, 0.1, 0.1, "free first"), (None, "n", 1, 1.0, 1.0, "lost"), (None, "n", 1, 1.0, 1.0, "lost"), (3, "z", 1, 0.1, 0.1, "third")]
    df = spark.createDataFrame(rel, "obs_id long, image_name string, pole_point_count long, pole_quality double, confidence double, note string")
    ids = spark.createDataFrame(merged, "obs_id long, canonical_id long")
    got = {(r.canonical_id, r.note, tuple(r.source_ids or ()), r.observation_count) for r in C.remap_relations(df, ids).collect()}
    assert got == {(1, "own", (1, 2, 3), 3), (7, "own7", (6, 7), 2), (9, "free first", (9,), 1), (None, "lost", (), None)}
    assert C.remap_relations(df, ids).count() == 5
    without = C.remap_relations(df.filter("obs_id IS NULL OR obs_id NOT IN (1, 7)"), ids)
    assert {(r.canonical_id, r.note) for r in without.collect()} == {(1, "more"), (7, "y"), (9, "free first"), (None, "lost")}
    assert C.remap_relations(df.limit(0), ids).count() == 0


def test_relations_follow_deduped_signs(spark):
    """After sign_dedupe every relation names a sign that is left, and each sign has one at most."""
    rng = np.random.default_rng(3)
    rows = [(i, "r", 1, f"im{i % 7}", i, float(rng.choice([0, 0.1, 0.2, 9])), float(rng.choice([0, 0.1])), 0.0, None, int(rng.integers(1, 9)), 0.5) for i in range(60)]
    signs = spark.createDataFrame(rows, "obs_id long, record_name string, class_id long, image_name string, detection_index long, x double, y double, z double, support_id string, point_count long, confidence double")
    merged = C.sign_dedupe(signs).select("obs_id", "canonical_id").collect()
    rel = [(i, f"im{i % 7}", int(i % 5), 0.5, 0.5) for i in range(0, 60, 2)]
    got = C.remap_relations(spark.createDataFrame(rel, "obs_id long, image_name string, pole_point_count long, pole_quality double, confidence double"), spark.createDataFrame(merged)).collect()
    canonical = dict(map(tuple, merged))
    best = {}
    for r in rel:
        key = (r[0] != canonical[r[0]], -r[2], r[1], r[0])
        best[canonical[r[0]]] = min(best.get(canonical[r[0]], (key, r[0])), (key, r[0]))
    assert {r.canonical_id: r.obs_id for r in got} == {c: v[1] for c, v in best.items()}
    assert all(sorted(r.source_ids) == sorted(i for i, c in canonical.items() if c == r.canonical_id) for r in got)


HEADER = ["points", "crs", "format", "dimensions", *[f"{n}_{a}" for n in ("scale", "offset", "min", "max") for a in "xyz"]]


def test_validate_splits(spark):
    """A failing base for each reason."""
    whole = dict(points=100, crs="c", format=3, dimensions="x,y", **{f"scale_{a}": 0.01 for a in "xyz"}, **{f"offset_{a}": 100.0 for a in "xyz"}, **{f"min_{a}": 110.0 for a in "xyz"}, **{f"max_{a}": 120.0 for a in "xyz"})
    half = [whole | {"points": 60, "max_x": 115.0}, whole | {"points": 40, "min_x": 115.01}]
    cases = {
        "good": half, "rebased": [half[0] | {"offset_x": 50.005, "min_x": 110.005, "max_x": 115.005}, half[1]], "gap": [half[0], half[1] | {"split_index": 3}], "twice": [half[0], half[1] | {"split_index": 1}], "from_zero": [half[0] | {"split_index": 0}, half[1] | {"split_index": 1}],
        "off_grid": [half[0] | {"max_y": 120.005}, half[1]], "null_bound": [half[0] | {"min_z": None}, half[1]], "backwards": [half[0] | {"min_y": 121.0}, half[1]], "scale": [half[0] | {"scale_z": 0.001}, half[1]], "crs": [half[0] | {"crs": None}, half[1]],
        "format": [half[0], half[1] | {"format": 7}], "dimensions": [half[0], half[1] | {"dimensions": "x"}], "count": [half[0], half[1] | {"points": 41}], "bounds": [half[0] | {"max_z": 119.0}, half[1] | {"max_z": 119.5}], "infinite": [half[0] | {"max_x": float("inf")}, half[1]],
    }
    schema = "base string, split_index long, points long, crs string, format long, dimensions string, " + ", ".join(f"{c} double" for c in HEADER[4:])
    full = [(b, None, *[whole[c] for c in HEADER]) for b in [*cases, "alone"]]
    splits = [(b, s.get("split_index", k + 1), *[s[c] for c in HEADER]) for b, rows in cases.items() for k, s in enumerate(rows)] + [("orphan", 1, *[whole[c] for c in HEADER])]
    got = {r.base: r.reasons for r in validate_splits(spark.createDataFrame(full, schema).drop("split_index"), spark.createDataFrame(splits, schema)).collect()}
    index, grid, scale, bounds = ["non_contiguous_split_indices"], ["invalid_scale_offset_grid"], ["scale_mismatch"], ["bounds_mismatch"]
    assert got == {"good": [], "rebased": [], "gap": index, "twice": index, "from_zero": index, "off_grid": grid, "null_bound": grid, "backwards": grid, "scale": scale, "crs": ["crs_mismatch"], "format": ["point_format_mismatch"], "dimensions": ["point_format_mismatch"], "count": ["point_count_mismatch"], "bounds": bounds, "infinite": [*grid, *bounds], "alone": ["no_splits"], "orphan": ["no_full_file"]}


def plain_dedupe(rows):
    """rows: id, record, class, image, index, x, y, z, support, points, confidence. One merge at a time."""
    key = lambda r: (r[1], r[3].lower(), r[4], r[0])

    def pair(a, b):
        if a[1:3] != b[1:3] or (a[3].strip() and a[3].lower() == b[3].lower()) or (a[8] and b[8] and a[8] != b[8]):
            return None
        rx, rz = C.SUPPORTED if a[8] and b[8] else C.UNSUPPORTED
        xy, z = float(np.hypot(a[5] - b[5], a[6] - b[6])), abs(a[7] - b[7])
        return max(xy / rx, z / rz) if xy <= rx + 1e-12 and z <= rz + 1e-12 else None

    def link(p, q):
        scores = [pair(a, b) for a in p for b in q]
        return None if None in scores else max(scores)

    groups = [[r] for r in sorted(rows, key=key)]
    while True:
        found = [(s, i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)) if (s := link(groups[i], groups[j])) is not None]
        if not found:
            break
        _, i, j = min(found)
        merged = sorted(groups[i] + groups[j], key=key)
        groups = sorted([g for k, g in enumerate(groups) if k not in (i, j)] + [merged], key=lambda g: [key(r) for r in g])
    out = {}
    for g in groups:
        far = {r[0]: round(sum(pair(r, o) or 0 for o in g if o is not r), 9) for r in g}
        best = min(g, key=lambda r: (not r[8], far[r[0]], -r[9], -r[10], key(r)))
        out |= {r[0]: (best[0], len(g)) for r in g}
    return out


def test_sign_dedupe(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(70):
        x, y, z = (rng.integers(0, 4, 3) * 0.4 + rng.uniform(-0.13, 0.13, 3)).tolist()
        rows.append((i, "r", int(rng.integers(2)), f"Im{rng.integers(25)}", int(rng.integers(3)), x * (i % 9 > 0), y * 0.3, z * 0.2, ["", "A", "B", None][int(rng.integers(4))], int(rng.integers(5)), float(rng.integers(4)) / 4))
    rows.append((99, "r", 0, "", 1, 0.0, 0.0, 0.0, None, 1, 0.5))
    want = plain_dedupe(rows)
    df = spark.createDataFrame([*rows, (100, "r", 0, "im", 1, None, 0.0, 0.0, None, None, None)], "obs_id long, record_name string, class_id int, image_name string, detection_index long, x double, y double, z double, support_id string, point_count int, confidence double")
    for few in (C.FEW_MEMBERS, 0):
        got = {r.obs_id: (r.canonical_id, r["size"]) for r in C.sign_dedupe(df, few=few).collect()}
        assert got.pop(100) == (100, 1) and got == want
    assert max(n for _, n in want.values()) > 2


def spots(rng, n, spread):
    """Sightings around places, some of them on the edges of tiles of 64 and 38.4 metres."""
    at = np.r_[rng.uniform(-300, 300, (n, 2)), rng.integers(-4, 5, (n // 8, 2)) * 64.0, rng.integers(-4, 5, (n // 8, 2)) * 38.4]
    return at[rng.integers(0, len(at), 4 * n)] + rng.normal(0, spread, (4 * n, 2))


def test_sign_dedupe_by_tiles(spark, monkeypatch):
    """Whole tiles, crowded ones and rows without a place give what joins give, and little is stored between."""
    rng = np.random.default_rng(21)
    xy = [tuple(map(float, p)) for p in spots(rng, 700, 0.08)]
    rows = [(i, [None, "s", "r"][min(i % 23, 2)], int(i % 2), [None, "", f"Im{i % 301}"][min(i % 19, 2)], i % 3, *xy[i], [float("nan"), None, float(i % 3) / 20][min(i % 29, 2)], [None, " ", "A", "B"][int(rng.integers(4))], i % 5 or None, 0.1 * (i % 7) or None) for i in range(len(xy))]
    rows += [(i + 9000, "r", 0, f"im{i}", 1, 10.0 + 0.001 * (i % 50), 10.0, 0.0, None, 1, 0.5) for i in range(120)]
    schema = "obs_id long, record_name string, class_id int, image_name string, detection_index long, x double, y double, z double, support_id string, point_count int, confidence double"
    df = spark.createDataFrame(rows, schema)
    stored = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(spark.sparkContext.getCheckpointDir()[5:]) for f in files)
    C.shared_checkpoint(df.limit(1))
    before = stored()
    got = {r.obs_id: (r.canonical_id, r["size"]) for r in C.sign_dedupe(df).collect()}
    assert stored() - before < 60 * len(rows)
    own = df.select("obs_id", "record_name", "class_id", F.lower("image_name").alias("image"), "detection_index", "x", "y", "z", F.nullif(F.trim("support_id"), F.lit("")).alias("support"), "point_count", "confidence")
    want = {r.obs_id: (r.canonical_id, r["size"]) for r in C._dedupe_by_joins(own, C.SUPPORTED, C.UNSUPPORTED, C.FEW_MEMBERS).collect()}
    assert got == want and len(got) == len(rows) and len({c for c, _ in got.values()}) < 0.9 * len(rows)
    monkeypatch.setattr(tiles, "TILE_PAIRS", 500)
    monkeypatch.setattr(tiles, "TILE_ROWS", 60)
    monkeypatch.setattr(tiles, "BATCH_ROWS", 300)
    assert {r.obs_id: (r.canonical_id, r["size"]) for r in C.sign_dedupe(df).collect()} == want


def test_complete_link_does_not_chain():
    d = np.full((3, 3), np.inf)
    d[0, 1], d[1, 2] = 0.8, 0.8
    assert C.agglomerate(d).tolist() == [0, 0, 2]


def test_pole_merge(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(90):
        c = int(rng.integers(5))
        x, y, z = (np.array([c * 3.0, c, 0.1]) + rng.normal(0, 0.08, 3) + (rng.uniform(-0.4, 0.4, 3) if i % 9 == 0 else 0)).tolist()
        rows.append((i, f"r{i % 2}", f"im{rng.integers(30)}", i % 4, x, y, z, float(rng.integers(1, 9)) / 10, ["AUTO", "REVIEW"][i % 13 == 0], ["A", "B"][i % 17 == 0], ["VISIBLE", "OCCLUDED", "GROUND_CONFLICT"][int(rng.integers(12)) // 5]))
    names = "obs_id record_name image_name detection_index pole_x pole_y pole_z quality pole_status pole_type occlusion".split()
    df = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, "long string string long double double double double string string string".split())))
    label = list(range(len(rows)))
    near = lambda a, b: a[1] == b[1] and (a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2 <= 0.25**2
    for _ in rows:
        label = [min(label[j] for j, o in enumerate(rows) if near(r, o)) for r in rows]
    want = {}
    for c in set(label):
        own = [r for r, k in zip(rows, label) if k == c]
        best = {}
        for r in sorted(own, key=lambda r: (-r[7], r[3], r[0])):
            best.setdefault(r[2], r)
        one = sorted(best.values())
        xyz, w, valid = np.array([r[4:7] for r in one]), np.array([r[7] for r in one]), np.array([r[10] != "GROUND_CONFLICT" for r in one])
        seed = valid if valid.sum() >= 2 else np.ones(len(one), bool)
        mid = C.geometric_median(xyz[seed], w[seed])
        fx, fz = np.linalg.norm(xyz[:, :2] - mid[:2], axis=1), np.abs(xyz[:, 2] - mid[2])
        top = lambda f: max(0.2, np.median(f[seed]) + 3 * 1.4826 * np.median(np.abs(f[seed] - np.median(f[seed]))))  # noqa: E731, B023
        used = valid & (fx <= top(fx)) & (fz <= top(fz))
        used = used if used.any() else seed
        used = np.ones(1, bool) if len(one) == 1 else used
        centre = C.geometric_median(xyz[used], w[used])
        spread = np.sqrt(np.average(((xyz[used, :2] - centre[:2]) ** 2).sum(1), weights=w[used]))
        types, states = {r[9] for r in own}, {r[10] for r in one}
        auto = all(r[8] == "AUTO" for r, u in zip(one, used) if u) and len(types) == 1 and used.all()
        for r in own:
            want[r[0]] = (*np.round(centre, 5), len(one), len(own), int((~used).sum()), round(spread, 5), "AUTO" if auto else "REVIEW", types.pop() if len(types) == 1 else "MIXED" if len(types) > 1 else want[own[0][0]][8], states.copy().pop() if len(states) == 1 else "MIXED")
    for few in (C.FEW_MEMBERS, 1):
        got = {r.obs_id: (*np.round([r.x, r.y, r.z], 5), r.frames, r.members, r.outliers, round(r.xy_spread, 5), r.status, r.pole_type, r.occlusion) for r in C.pole_merge(df, 0.25, few).collect()}
        assert set(got) == set(want)
        for i, w in want.items():
            assert np.allclose([float(v) for v in got[i][:7]], [float(v) for v in w[:7]], atol=3e-5) and got[i][7:] == w[7:], (i, got[i], w)
    assert any(w[5] for w in want.values()) and max(w[3] for w in want.values()) > 5


def test_pole_merge_by_tiles(spark, monkeypatch):
    """The same for supports; of some the quality, the height or the record is missing."""
    rng = np.random.default_rng(22)
    xy = [tuple(map(float, p)) for p in spots(rng, 700, 0.06)]
    rows = [(i, [None, "s", "r"][min(i % 23, 2)], [None, f"im{i % 301}"][i % 19 > 0], i % 3, *xy[i], [None, i % 3 / 20][i % 97 > 0], [None, i % 7 / 7][i % 89 > 0], ["AUTO", "AUTO", "REVIEW", None][i % 4], ["A", "B"][i % 17 == 0], ["VISIBLE", None, "GROUND_CONFLICT"][i % 3]) for i in range(len(xy))]
    rows += [(i + 9000, "r", f"im{i}", 1, 10.0 + 0.002 * (i % 50), 10.0, 0.1 * (i % 3), 0.5, "AUTO", "A", "VISIBLE") for i in range(120)]
    rows = [r for r in rows if r[6] is not None or r[1] == "r"]
    names = "obs_id record_name image_name detection_index pole_x pole_y pole_z quality pole_status pole_type occlusion".split()
    df = spark.createDataFrame([r if r[6] is not None else (*r[:6], 0.0, *r[7:]) for r in rows], ", ".join(f"{n} {t}" for n, t in zip(names, "long string string long double double double double string string string".split())))
    plain = df.withColumns({"pole_status": F.coalesce("pole_status", F.lit("")), "occlusion": F.coalesce("occlusion", F.lit("UNKNOWN"))})
    near = lambda df: {r.obs_id: (r.support_id, *(round(v, 5) for v in (r.x, r.y, r.z, r.xy_spread, r.z_spread)), *r[5:8], *r[10:]) for r in df.collect()}
    stored = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(spark.sparkContext.getCheckpointDir()[5:]) for f in files)
    C.shared_checkpoint(df.limit(1))
    before = stored()
    got = near(C.pole_merge(df, 0.15))
    assert stored() - before < 120 * len(rows)
    want = near(C._merge_by_joins(plain, 0.15, C.FEW_MEMBERS))

    def same(got):
        assert set(got) == set(want) == {r[0] for r in rows}
        for i, w in want.items():
            assert got[i][0] == w[0] and got[i][6:] == w[6:] and np.allclose(got[i][1:6], w[1:6], atol=3e-5), (i, got[i], w)

    same(got)
    assert len({w[0] for w in want.values()}) < 0.9 * len(rows)
    for name, most in (("TILE_PAIRS", 500), ("TILE_ROWS", 60), ("BATCH_ROWS", 300)):
        monkeypatch.setattr(tiles, name, most)
    same(near(C.pole_merge(df, 0.15)))


def test_geometric_median_resists_an_outlier():
    xyz = np.r_[np.tile([1.0, 2, 3], (5, 1)) + np.random.default_rng(3).normal(0, 0.01, (5, 3)), [[50.0, 50, 50]]]
    assert np.abs(C.geometric_median(xyz, np.ones(6)) - [1, 2, 3]).max() < 0.05


def scene(rng, tilt=0.0):
    z = np.repeat(np.linspace(0.3, 5, 48), 6)
    angle = np.tile(np.arange(6) * np.pi / 3, 48)
    shaft = np.c_[10 + tilt * z + 0.055 * np.cos(angle), 20 + 0.055 * np.sin(angle), z] + rng.normal(0, 0.004, (288, 3))
    g = np.stack(np.meshgrid(np.linspace(8.6, 11.4, 15), np.linspace(18.6, 21.4, 15)), -1).reshape(-1, 2)
    ground = np.c_[g, 0.05 * (g[:, 0] - 10) + 0.02 * (g[:, 1] - 20)]
    return np.r_[shaft, ground]


def test_find_poles(spark):
    xyz = scene(np.random.default_rng(4))
    df = spark.createDataFrame([(7, 10.3, 20.0, 4.5, *map(float, p)) for p in xyz], "detection_id long, sign_x double, sign_y double, sign_z double, x double, y double, z double")
    r = P.find_poles(df).collect()
    assert len(r) == 1 and abs(r[0].base_x - 10) < 0.05 and abs(r[0].base_y - 20) < 0.05 and abs(r[0].base_z) < 0.05 and r[0].state == "VISIBLE"


def test_tilted_axis():
    xyz = scene(np.random.default_rng(5), 0.12)
    axis = P.fit_axis(xyz[:288])
    assert abs(axis["ax"] - 0.12) < 0.02 and abs(axis["tilt_deg"] - np.degrees(np.arctan(0.12))) < 1


def test_colour_shift():
    rng = np.random.default_rng(6)
    image = rng.integers(0, 256, (40, 60, 3))
    px = np.c_[rng.integers(0, 60, 200), rng.integers(5, 35, 200)]
    rgb = image[px[:, 1] - 1, (px[:, 0] + 2) % 60]
    assert P.colour_shift(image, px, rgb.astype(float), 3, 0.8)[:2] == (2, -1)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_density_cluster_query(spark):
    """The query against neighbours counted one by one."""
    from waymark import registry
    from waymark.operators.components import roots
    from waymark.sources import survey as S

    p = S.points(spark, DATA).select("point_id", "x", "y", "z").toPandas().sort_values("point_id")
    ids, xyz = p["point_id"].to_numpy(), p[["x", "y", "z"]].to_numpy()
    a, b = [], []
    for lo in range(0, len(ids), 500):
        i, j = np.nonzero(((xyz[lo : lo + 500, None] - xyz[None]) ** 2).sum(2) <= 36.0)
        a.append(i + lo)
        b.append(j)
    a, b = np.concatenate(a), np.concatenate(b)
    core = np.bincount(a, minlength=len(ids)) >= 6
    both = core[a] & core[b]
    node, root = roots(ids[a[both]], ids[b[both]])
    want = dict(zip(node.tolist(), root.tolist()))
    for i in np.flatnonzero(~core):
        near = [j for j in b[a == i] if core[j]]
        if near:
            want[int(ids[i])] = want[int(ids[min(near, key=lambda j: (((xyz[i] - xyz[j]) ** 2).sum(), ids[j]))])]
    got = registry.QUERIES["density_cluster"](spark, DATA).collect()
    assert len(got) == len(ids) and sum(r.core for r in got) == core.sum()
    assert {r.point_id: r.component for r in got if r.component is not None} == want


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    df = SimpleNamespace(sparkSession=SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_checkpoint(df)


def test_nearest_boxes_of_few_boxes_shuffles_no_rows(spark):
    """The same as by the grid, and no row of the left side is shuffled or checkpointed."""
    from waymark.operators.matching import nearest_boxes

    rng = np.random.default_rng(5)
    low = rng.uniform(0, 500, (12, 3))
    boxes = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(low, low + rng.uniform(1, 60, (12, 3))))], "box long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(-900, 4000, (300, 3)))], "id long, ox double, oy double, oz double")
    for dims in ("xy", "xyz"):
        few, grid = nearest_boxes(left, boxes, "id", "box", 2, dims), nearest_boxes(left, boxes, "id", "box", 2, dims, few=0)
        assert "hashpartitioning(id" not in few._jdf.queryExecution().executedPlan().toString()
        key = lambda r: (r.id, r.box, round(r.distance, 9))
        assert sorted(map(key, few.collect())) == sorted(map(key, grid.collect())) and few.count() == 600
    assert nearest_boxes(left, boxes.limit(0), "id", "box", 2).count() == 0


def test_linked_components_list_no_pairs_of_a_crowd(spark):
    """Like components of all near pairs, in two and three dimensions; 3000 points of one spot,
    4.5 million pairs, are one component."""
    rng = np.random.default_rng(7)
    xyz = np.r_[rng.normal(0, 4, (500, 3)), rng.normal(0, 0.3, (100, 3)) + 30]
    rows = [(i, *map(float, p)) for i, p in enumerate(xyz)] + [(900, float("nan"), 0.0, 0.0), (901, None, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "id long, x double, y double, z double")
    for dims in (("x", "y"), ("x", "y", "z")):
        want = C.components(p, C.near_pairs(p, 0.8, "id", dims), "id")
        assert sorted(map(tuple, C.linked_components(p, 0.8, "id", dims).collect())) == sorted(map(tuple, want.collect()))
    crowd = spark.range(3000).select("id", F.lit(1.0).alias("x"), (F.col("id") * 1e-5).alias("y"))
    assert {r.component for r in C.linked_components(crowd, 0.8, "id", ("x", "y")).collect()} == {0}


def test_geometric_medians_of_many_groups_at_once():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 12, 400)
    xyz, w = rng.integers(0, 4, (sizes.sum(), 3)).astype(float), rng.integers(1, 5, sizes.sum()).astype(float)
    cut = np.cumsum(sizes)[:-1]
    want = [C.geometric_median(p, v) for p, v in zip(np.split(xyz, cut), np.split(w, cut))]
    assert np.abs(C.geometric_median_many(xyz, w, sizes) - want).max() < 1e-6


def test_many_small_groups_at_once():
    """Consensus and complete link of many groups, as one by one."""
    import numpy as np

    from waymark.operators import clustering as C

    rng = np.random.default_rng(11)
    sizes = rng.integers(2, 33, 300)
    xyz = rng.normal(0, 0.1, (sizes.sum(), 3)).round(2) + (rng.random(sizes.sum()) < 0.1)[:, None]
    w, valid = rng.uniform(0.5, 1, sizes.sum()), rng.random(sizes.sum()) < 0.6
    centres, used = C.pole_consensus_many(xyz, w, valid, sizes)
    for k, own in enumerate(np.split(np.arange(sizes.sum()), np.cumsum(sizes)[:-1])):
        centre, want = C.pole_consensus(xyz[own], w[own], valid[own])
        assert (used[own] == want).all() and np.abs(centres[k] - centre).max() < 1e-6
    for n in (1, 2, 5, 16):
        score = np.where(rng.random((200, n, n)) < 0.6, rng.integers(1, 9, (200, n, n)) / 8, np.inf)
        assert (C.agglomerate_many(score) == np.array([C.agglomerate(s) for s in score])).all()


def test_picks_move_rows_once(spark):
    """Candidates are shuffled by their keys once, whatever is compared of them."""
    if os.path.isdir(DATA):
        for name in ("pick_pole", "pick_cross_profile"):
            plan = supports.__dict__[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and "Join" not in plan


def test_points_in_ellipses(spark, monkeypatch):
    """Counts are exact across cells and batches, and no pair of a box and a point becomes a row."""
    rng = np.random.default_rng(3)
    xy, low, size = rng.uniform(-60, 60, (300, 2)), rng.uniform(-60, 60, (90, 2)), rng.uniform(1, 40, (90, 2))
    points = spark.createDataFrame([(i, i % 2, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(999, 0, None, 1.0)], "point_id long, kind int, x double, y double")
    rows = [(i // 3 if i else None, i % 3, i % 2, float(a), float(b), float(a + w), float(b + h)) for i, ((a, b), (w, h)) in enumerate(zip(low, size))]
    boxes = spark.createDataFrame(rows, "image long, j long, kind long, x0 double, y0 double, x1 double, y1 double")
    want = {}
    for image, j, kind, x0, y0, x1, y1 in rows:
        ins = [i for i, (x, y) in enumerate(xy) if i % 2 == kind and ((x - (x0 + x1) / 2) / ((x1 - x0) / 2)) ** 2 + ((y - (y0 + y1) / 2) / ((y1 - y0) / 2)) ** 2 <= 1]
        if ins:
            want[image, j] = (len(ins), min(ins))
    monkeypatch.setattr(spatial, "ELLIPSE_PAIRS", 7)
    out = spatial.points_in_ellipses(boxes, points, ("image", "j"))
    assert {(r.image, r.j): (r.n, r.first_point) for r in out.collect()} == want and "Join" not in out._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert {(r.image, r.j): (r.n, r.first_point) for r in spatial.points_in_ellipses(boxes, points, ("image", "j")).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    if os.path.isdir(DATA):
        assert "Join" not in tables.mask_join(spark, DATA)._jdf.queryExecution().executedPlan().toString()
