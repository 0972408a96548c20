from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark import registry
from waymark.operators import geometry as G
from waymark.operators import tables as T
from waymark.operators import views as V
from waymark.plans import views as plans
from waymark.plans.supports import covering
from waymark.sources import survey as S

DATA = "/root/testdata/sf0.001"


def test_overview_holds_its_rays():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(50, 1, 3)) * [1, 1, 0.3]
    rays = base / np.linalg.norm(base, axis=2, keepdims=True) + rng.normal(0, 0.15, (50, 6, 3))
    rays /= np.linalg.norm(rays, axis=2, keepdims=True)
    f, h, v, good = V.fit_overviews(rays, np.array([0.0, 0.0, 1.0]), 2.0, 120.0, 1.5)
    assert good.sum() > 40
    for i in np.flatnonzero(good):
        r = np.cross(f[i], [0, 0, 1])
        r /= np.linalg.norm(r)
        u = np.cross(r, f[i])
        x, y, z = rays[i] @ r, rays[i] @ u, rays[i] @ f[i]
        assert (z > 0).all() and np.abs(x / z).max() <= np.tan(np.radians(h[i] / 2)) and np.abs(y / z).max() <= np.tan(np.radians(v[i] / 2))
        assert abs(np.tan(np.radians(h[i] / 2)) - 1.5 * np.tan(np.radians(v[i] / 2))) < 1e-9
        assert abs(np.arctan2(x, z).min() + np.arctan2(x, z).max()) < 1e-3
    assert not V.fit_overviews(np.array([[[0, 1.0, 0], [0, -1.0, 0]]]), np.array([0.0, 0, 1]), 2.0, 120.0, 1.0)[3][0]


def test_polygons_there_and_back(spark):
    view = (V.forward_axes(), (1024.0, 1024.0), F.lit(90.0), F.lit(90.0))
    p = V.pixels((F.lit(100.0), F.lit(200.0)), (F.lit(900.0), F.lit(210.0)))
    df = spark.range(1).withColumn("p", p).withColumn("q", V.unwrap(V.persp_to_pano(F.col("p"), *view, V.forward_axes(), (4096.0, 2048.0)), 4096.0))
    back = df.select(V.pano_to_persp(F.col("q"), V.forward_axes(), (4096.0, 2048.0), *view).alias("b")).first().b
    assert np.allclose([(b.x, b.y) for b in back], [(100, 200), (900, 210)])


def test_ordinals_and_upserts(spark):
    rng = np.random.default_rng(2)
    values = rng.permutation(500).tolist()
    df = spark.createDataFrame([(int(v), f"n{v}") for v in values], "k long, n string")
    got = T.ordinals(df, ("k",), width=7).collect()
    assert sorted((r.k, r.ordinal) for r in got) == [(k, k + 1) for k in range(500)]
    table = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, n string, created long")
    new = spark.createDataFrame([(2, "B", 99), (3, "c", 30)], "id long, n string, created long")
    assert {tuple(r) for r in T.upsert(table, new, ("id",), ("created",)).collect()} == {(1, "a", 10), (2, "B", 20), (3, "c", 30)}


def test_covering_seeds():
    centres = np.array([[0.0, 0], [0.2, 0], [5, 0], [5.1, 0], [9, 0]])
    picked = covering(centres, np.array([1.0, 2, 5, 4, 9]), np.zeros(2), 0.5)
    assert picked.tolist() == [1, 4, 2]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_fit_overview_query(spark):
    """The query against one view at a time in plain Python."""
    df = registry.QUERIES["fit_overview"](spark, DATA)
    x0, y0, x1, y1 = (c for c in plans.box())
    points = [(x0, y0), (x0, y1), (x1, y0), (x1, y1), ((x0 + x1) / 2, F.least(y1 + 20 * 2048 / 180.0, F.lit(2047.0)))]
    rays = F.array(*[c for p in points for c in G.pixel_ray(*p, V.forward_axes(), *plans.PANO)])
    given: dict = {}
    for r in S.detections(spark, DATA).select("image_name", "detection_index", rays.alias("rays")).collect():
        given.setdefault((r.image_name, r.detection_index), []).append(r.rays)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    unit = lambda a: [p / math.sqrt(dot(a, a)) for p in a]
    fits = 0
    got = df.collect()
    assert len(got) == sum(map(len, given.values()))
    for r in [r for r in got if len(given[r.image_name, r.detection_index]) == 1][::7]:
        (flat,) = given[r.image_name, r.detection_index]
        own = [flat[k : k + 3] for k in range(0, 15, 3)]
        f = unit([sum(v[k] for v in own) for k in range(3)])
        for _ in range(20):
            right = unit(cross(f, [0.0, 0.0, 1.0]))
            above = cross(right, f)
            h, v = [math.atan2(dot(o, right), dot(o, f)) for o in own], [math.atan2(dot(o, above), dot(o, f)) for o in own]
            dh, dv = (min(h) + max(h)) / 2, (min(v) + max(v)) / 2
            if max(abs(dh), abs(dv)) < 1e-11:
                break
            f = unit([f[k] + right[k] * math.tan(dh) + above[k] * math.tan(dv) for k in range(3)])
        if r.fits:
            fits += 1
            assert max(abs(a - b) for a, b in zip(f, (r.fx, r.fy, r.fz))) < 1e-8
            assert all(math.degrees(2 * max(abs(x) for x in a)) <= fov + 1e-6 for a, fov in ((h, r.hfov), (v, r.vfov)))
    assert fits > 50


def test_box_views_are_code_that_compiles(spark):
    """Nine pixels a row were one method of over 8000 bytes, which the JVM interprets."""
    from waymark import registry

    for name in ("pano_to_persp", "rect_fov"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        told = spark._jvm.PythonSQLUtils.explainString(plan, "codegen")
        sizes = [int(x.split(";")[0]) for x in told.split("maxMethodCodeSize:")[1:]]
        assert all(x < 8000 for x in sizes), (name, sizes)


def test_support_pixels_of_an_empty_polygon(spark):
    lit = F.lit
    shape = "array<struct<x:double,y:double>>"
    for polygon, want in ((F.array().cast(shape), 9), (lit(None).cast(shape), 9), (F.transform(F.sequence(lit(0), lit(202)), lambda i: F.struct(i.cast("double").alias("x"), lit(0.0).alias("y"))), 9 + 68)):
        df = spark.range(1).select(polygon.alias("q"))
        assert df.select(F.size(V.support_pixels(lit(0.0), lit(0.0), lit(1.0), lit(1.0), F.col("q")))).first()[0] == want
