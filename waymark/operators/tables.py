"""Changes to stored tables as whole-table rewrites: upserts, conditional updates, ordinals.

Parquet has no row updates: each function returns the table after the change, to be written
beside the old one and put in its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.operators.components import shared_checkpoint


def upsert(table: DataFrame, changes: DataFrame, keys: tuple[str, ...], kept: tuple[str, ...] = ()) -> DataFrame:
    """Rows of changes replace those of equal keys (the columns in `kept` stay as they were)."""
    values = [c for c in table.columns if c not in keys]
    new = changes.select(*keys, F.struct(*values).alias("__new"))
    old = table.select(*keys, F.struct(*values).alias("__old"))
    both = old.join(new, list(keys), "full")
    pick = lambda c: F.when(F.col("__new").isNull() | (F.col("__old").isNotNull() & F.lit(c in kept)), F.col(f"__old.{c}")).otherwise(F.col(f"__new.{c}")).alias(c)
    return both.select(*[c if c in keys else pick(c) for c in table.columns])


def update_if(table: DataFrame, changes: DataFrame, key: str, condition: Column, columns: tuple[str, ...]) -> DataFrame:
    """changes: key, expected and new_<column>; a row is changed where the condition, which may
    use `expected`, holds. `outcome` tells for each row: updated, refused or null (not asked)."""
    joined = table.join(changes, key, "left")
    asked = F.col(f"new_{columns[0]}").isNotNull()
    good = asked & F.coalesce(condition, F.lit(False))
    return joined.select(*[F.when(good, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns], F.when(good, "updated").when(asked, "refused").alias("outcome"))


def ordinals(df: DataFrame, order: tuple[str, ...], name: str = "ordinal", width: int | None = None) -> DataFrame:
    """1, 2, ... in global order without one task for all rows: rows are dealt by range, ranked
    in each range, and moved by the sizes of the ranges before (one number a partition)."""
    dealt = df.repartitionByRange(width, *order) if width else df.repartitionByRange(*order)
    dealt = shared_checkpoint(dealt.withColumn("__p", F.spark_partition_id()))
    before = dealt.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = dealt.withColumn("__k", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    return ranked.join(F.broadcast(before.select("__p", "__before")), "__p").withColumn(name, F.col("__k") + F.col("__before")).drop("__p", "__k", "__before")


def drop_field(properties: Column, name: str) -> Column:
    """A feature's properties without one field (names compare without case)."""
    return F.map_filter(properties, lambda k, _: F.lower(k) != name.lower())
