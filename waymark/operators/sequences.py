"""Window-shaped operators: islands, even samples and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.operators.tables import ordinals


def islands(df: DataFrame, keys: tuple[str, ...], position: str) -> DataFrame:
    """Adds island (equal for consecutive positions of a key) and gap (to the one before)."""
    w = W.partitionBy(*keys).orderBy(position)
    return df.withColumn("island", F.col(position) - F.row_number().over(w)).withColumn("gap", F.col(position) - F.lag(position).over(w))


def even_sample(df: DataFrame, keys: tuple[str, ...], order: list[Column | str], count: Column, half_even: bool = False) -> DataFrame:
    """`count` evenly spaced rows of each key, ends included; one row is the first.

    A row at index i is wanted if some k in 0..count-1 maps to it: k (n - 1) / (count - 1),
    truncated or rounded half to even."""
    w = W.partitionBy(*keys)
    numbered = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w)).withColumn("__q", F.least(count, F.col("__n")).cast("long"))
    step = (F.col("__n") - 1) / F.nullif(F.col("__q") - 1, F.lit(0))
    at = lambda k: k * (F.col("__n") - 1) / F.nullif(F.col("__q") - 1, F.lit(0))  # noqa: E731 (k * step misses halves)
    place = lambda k: (F.bround(at(k), 0) if half_even else F.floor(at(k) + 1e-9)).cast("long")
    guess = F.floor(F.col("__i") / F.nullif(step, F.lit(0.0)))
    near = F.lit(False)
    for d in (-1, 0, 1, 2):
        k = guess + d
        near = near | ((k >= 0) & (k < F.col("__q")) & (place(k) == F.col("__i")))
    wanted = F.when(F.col("__q") <= 0, False).when(F.col("__q") == 1, F.col("__i") == 0).when(F.col("__q") == F.col("__n"), True).otherwise(F.coalesce(near, F.lit(False)))
    return numbered.filter(wanted).drop("__i", "__n", "__q")


def water_fill(sizes: DataFrame, key: str, size: str, budget: int, order: str) -> DataFrame:
    """Round-robin quotas: every key gets one in turn until the budget or its size is reached.

    Closed form: the level is the greatest L with sum(min(size, L)) <= budget; what is left
    goes one each to the first keys, in order, that still have more. Sizes are one row a key, and
    the level needs only how many keys have each size."""
    by_size = sizes.groupBy(F.col(size).alias("s")).agg(F.count("*").alias("c"))
    w = W.orderBy("s")
    table = by_size.withColumn("below", F.coalesce(F.sum(F.col("s") * F.col("c")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    table = table.withColumn("above", F.sum("c").over(w.rowsBetween(0, W.unboundedFollowing))).withColumn("prior", F.coalesce(F.lag("s").over(w), F.lit(0)))
    level = F.floor((F.lit(budget) - F.col("below")) / F.col("above"))
    found = table.withColumn("l", level).filter("l >= prior").agg(F.max(F.least("l", "s")).alias("level"))
    full = sizes.crossJoin(F.broadcast(found)).withColumn("level", F.coalesce("level", F.lit(0)))  # one row
    quota = full.withColumn("q", F.least(F.col(size), F.col("level")))
    used = quota.agg(F.sum("q").alias("used"))
    left = quota.crossJoin(F.broadcast(used)).withColumn("more", (F.col(size) > F.col("level")).cast("int"))  # one row
    waiting = ordinals(left.filter("more = 1").select(*dict.fromkeys((key, order))), (order,), "__turn").select(key, "__turn")
    extra = F.coalesce(F.col("__turn") <= F.lit(budget) - F.col("used"), F.lit(False)).cast("long")
    return left.join(waiting, key, "left").select(key, (F.col("q") + extra).cast("long").alias("quota"))
