"""Do numbered split files replace a full point file? Judged from headers alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = "xyz"


def _grid_ok() -> Column:
    """Bounds are finite, in order and on the file's own scale and offset grid."""
    good = F.lit(True)
    for a in AXES:
        lo, hi, scale, offset = (F.col(f"{n}_{a}") for n in ("min", "max", "scale", "offset"))
        known = lo.isNotNull() & hi.isNotNull() & scale.isNotNull() & offset.isNotNull()
        finite = F.abs(lo + hi + scale + offset) < float("inf")
        on = lambda v: F.abs((v - offset) / scale - F.rint((v - offset) / scale)) <= 1e-4  # noqa: B023, E731
        good = good & F.when(known & finite & (scale > 0), (lo <= hi) & on(lo) & on(hi)).otherwise(False)
    return good


def validate_splits(full: DataFrame, splits: DataFrame) -> DataFrame:
    """full: base and a header (points, crs, format, dimensions, and scale_, offset_, min_, max_ of
    x, y, z), one row a base. splits: the same and split_index, counted from 1. Returns base,
    split_count, split_points and reasons (empty: the splits may stand for the full file): indices
    with gaps or repeats, headers off their grid, scales, coordinate systems or formats that
    differ, points that don't add up, bounds of all splits more than a scale unit off.

    A null in a header is off the grid or, for texts, equal to a null alone. A base without splits
    has the reason no_splits, splits without a full file have no_full_file."""
    columns = ["points", "crs", "format", "dimensions", *[f"{n}_{a}" for n in ("scale", "offset", "min", "max") for a in AXES]]
    header = full.select("base", F.struct(*columns).alias("full"), _grid_ok().alias("full_ok"))
    own = splits.withColumn("ok", _grid_ok()).join(header, "base", "left")
    same = lambda *names: F.bool_and(_all(*[F.col(n).eqNullSafe(F.col(f"full.{n}")) for n in names]))
    near = F.bool_and(F.coalesce(_all(*[F.abs(F.col(f"scale_{a}") - F.col(f"full.scale_{a}")) <= 1e-15 for a in AXES]), F.lit(False)))
    g = own.groupBy("base").agg(
        F.count("*").alias("split_count"), F.sum("points").alias("split_points"), F.bool_and("ok").alias("ok"), near.alias("scales"), same("crs").alias("crs"), same("format", "dimensions").alias("format"),
        ((F.min("split_index") == 1) & (F.max("split_index") == F.count("*")) & (F.countDistinct("split_index") == F.count("*"))).alias("contiguous"),
        *[F.min(f"min_{a}").alias(f"lo_{a}") for a in AXES], *[F.max(f"max_{a}").alias(f"hi_{a}") for a in AXES],
    )
    both = header.withColumn("there", F.lit(True)).join(g, "base", "full")
    within = _all(*[F.abs(F.col(f"{side}_{a}") - F.col(f"full.{end}_{a}")) <= F.greatest(F.col(f"full.scale_{a}"), F.lit(1e-12)) for side, end in (("lo", "min"), ("hi", "max")) for a in AXES])
    wrong = lambda good, reason: F.when(~F.coalesce(good, F.lit(False)), reason)
    checks = [
        wrong(F.col("contiguous"), "non_contiguous_split_indices"), wrong(F.col("ok") & F.col("full_ok"), "invalid_scale_offset_grid"), wrong(F.col("scales"), "scale_mismatch"), wrong(F.col("crs"), "crs_mismatch"),
        wrong(F.col("format"), "point_format_mismatch"), wrong(F.col("split_points") == F.col("full.points"), "point_count_mismatch"), wrong(within, "bounds_mismatch"),
    ]
    reasons = F.when(F.col("there").isNull(), F.array(F.lit("no_full_file"))).when(F.col("split_count").isNull(), F.array(F.lit("no_splits"))).otherwise(F.array_compact(F.array(*checks)))
    return both.select("base", F.coalesce("split_count", F.lit(0)).alias("split_count"), F.coalesce("split_points", F.lit(0)).alias("split_points"), reasons.alias("reasons"))


def _all(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
