from __future__ import annotations

import math

from pyspark.sql import functions as F

from waymark.functions import text
from waymark.functions.vectors import vec
from waymark.operators import geometry as G


def test_golden_projection(spark):
    df = spark.createDataFrame([(0.36, 0.48, 0.8, 0.1, -0.2, 0.97, 12.5, -4.25, 3.75)], "fx double, fy double, fz double, ux double, uy double, uz double, x double, y double, z double")
    df, axes = G.camera_axes(df, vec("fx", "fy", "fz"), vec("ux", "uy", "uz"))
    axes = G.axes_offset(*axes, F.lit(7.5), F.lit(-3.25))
    zero = (F.lit(0.0),) * 3
    u, v, d = df.select(*G.project_equirect(vec("x", "y", "z"), zero, axes, 1.0, 1.0)).first()
    assert math.isclose(u, 0.7061724312999704, abs_tol=1e-9)
    assert math.isclose(v, 0.43329805654137143, abs_tol=1e-9)
    assert math.isclose(d, 13.724977231310804, abs_tol=1e-9)


def test_zero_direction_is_an_error(spark):
    import pytest

    df = spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double")
    from waymark.functions.vectors import unit

    with pytest.raises(Exception, match="no direction"):
        df.select(*unit(vec("x", "y", "z"))).collect()


def test_names_and_times(spark):
    row = spark.range(1).select(
        text.canonical_name(F.lit("Job-01 A")), text.canonical_name(F.lit("--")), text.canonical_track(F.lit("Track0012")),
        text.image_time(F.lit("250311_0201184477")).cast("string"), text.gps_time(F.lit(2357), F.lit(180096.447723)).cast("string"),
    ).first()
    assert tuple(row) == ("job01a", None, 12, "2025-03-11 02:01:18.4477", "2025-03-11 02:01:18.447723")


def test_natural_key(spark):
    df = spark.createDataFrame([("a10",), ("a9",), ("a09b",), ("b1",)], "s string").select("s", text.natural_key(F.col("s")).alias("k"))
    assert [r.s for r in df.orderBy("k").collect()] == ["a9", "a09b", "a10", "b1"]
