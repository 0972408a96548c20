"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its weight's share of the corpus bytes over its own
bytes. No rate is cut unless a caller asks for it with `most`, and then misses the weights. A document's
count is the Poisson quantile of a number in [0, 1) hashed from the seed and its id; it is
exploded by that count and all copies are dealt out and sorted by a second hash, which shuffles
them globally. Sizes are pre-aggregated by source; rates are broadcast only up to FEW_SOURCES.

A null source is a source of its own, a null text has no bytes; rows without an id are hashed by
their texts.
Repeated rows get equal counts and each its own copies. Sources without bytes get rate 1.
Extra columns named in `carry` are kept, others ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import kept

#: Up to this rate counts come from a table of TERMS terms, beyond which P(count) is under 1e-16.
TABLE_RATE, TERMS = 8.0, 50
FEW_SOURCES = 10_000


def _hash(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]))


def name_of(doc_id: Column, text: Column) -> Column:
    """What a row is hashed by: its id or, without one, its text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))


def unit(seed: str, *parts: Column) -> Column:
    """52 bits of MD5 as a number in [0, 1)."""
    return F.conv(F.substring(_hash(seed, *parts), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: DataFrame | None = None, most: float | None = None) -> DataFrame:
    """source and rate. weights: source and weight (any positive scale); None weighs all alike."""
    sizes = docs.groupBy(docs["source"].alias("source")).agg(F.sum(F.octet_length(F.coalesce(docs["text"], F.lit(""))).cast("long")).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        named = weights.select(weights["source"].alias("__s"), weights["weight"].cast("double").alias("weight"))
        sizes = sizes.join(named, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    row = sizes.agg(F.sum("size"), F.sum(F.when(F.col("size") > 0, F.col("weight")))).first()
    total, weight = float(row[0] or 0), float(row[1] or 1)
    share = F.col("weight") / weight * total / F.col("size")
    rate = F.when(F.col("size") > 0, share if most is None else F.least(F.lit(most), share)).otherwise(1.0)
    return sizes.select("source", rate.alias("rate"))


def cumulative(rate: Column) -> Column:
    """P(count <= 0), P(count <= 1), ... as an array, for rates of at most TABLE_RATE."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.array(F.exp(-rate)),
        lambda a, k: F.concat(a, F.array(F.element_at(a, -1) * rate / k)),
    )
    return F.aggregate(terms, F.array().cast("array<double>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + p)))


@F.pandas_udf(IntegerType())
def quantile(rate: pd.Series, u: pd.Series) -> pd.Series:
    """How many counts k have P(count <= k) <= u, for any rate: terms outward from the mode, by
    their ratios, so that none underflows."""
    out = np.zeros(len(rate), np.int32)
    for value in np.unique(rate):
        spread = int(12 * math.sqrt(value) + 60)
        low = max(0, int(value) - spread)
        k = np.arange(low, int(value) + spread + 1)
        below = np.cumsum(np.exp(np.cumsum(np.r_[low * math.log(value) - value - math.lgamma(low + 1) if value > 0 else 0.0, np.log(value / k[1:]) if value > 0 else np.full(len(k) - 1, -np.inf)])))
        at = np.flatnonzero(rate == value)
        out[at] = low + np.searchsorted(below, u.iloc[at], side="right")
    return pd.Series(out)


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: str = "mix", carry: tuple[str, ...] = ("doc_id", "text", "source"), most: float | None = None) -> DataFrame:
    """carry, copy (1 to the count) and shuffle_key, dealt out and sorted by shuffle_key."""
    # stored: else each of the two looks at it and the join would read the documents again
    by_source = kept(rates(docs, weights, most), "rates").select(F.col("source").alias("__s"), F.col("rate").alias("__rate"), F.when(F.col("rate") <= TABLE_RATE, cumulative(F.col("rate"))).alias("__cdf"))
    if by_source.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        by_source = F.broadcast(by_source)
    own = docs.select(*[docs[c] for c in carry], docs["source"].alias("__source"), name_of(docs["doc_id"], docs["text"]).alias("__id"))
    own = own.join(by_source, F.col("__source").eqNullSafe(F.col("__s")))
    own = own.withColumn("__u", unit(seed, F.col("__id")))
    few = F.expr("size(filter(__cdf, x -> x <= __u))")
    if by_source.filter(F.col("__rate") > TABLE_RATE).isEmpty():
        own = own.withColumn("__n", few)
    else:
        own = own.withColumn("__n", F.when(F.col("__rate") <= TABLE_RATE, few).otherwise(quantile("__rate", "__u")))
    own = own.filter("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    own = own.withColumn("shuffle_key", _hash(seed + "-order", F.col("__id"), F.col("copy")))
    return own.select(*carry, "copy", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")


ORACLE_SQL = f"""
WITH s AS (SELECT source, sum(strlen(coalesce(text, ''))) AS size FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN size > 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM s WHERE size > 0) * (SELECT sum(size) FROM s) / size ELSE 1.0 END AS rate FROM s),
t AS (SELECT source, rate, unnest(range((rate + 12 * sqrt(rate) + 60)::BIGINT)) AS i FROM r),
k AS (SELECT source, i AS n, sum(exp(i * ln(rate) - rate - lgamma(i + 1))) OVER (PARTITION BY source ORDER BY i) AS below FROM t),
n AS (SELECT *, coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) AS name FROM documents),
u AS (SELECT doc_id, text, source, name, ('0x' || substr(md5('mix:' || name), 1, 13))::BIGINT / {float(1 << 52)!r} AS u, row_number() OVER () AS row FROM n),
c AS (SELECT u.row, u.doc_id, any_value(u.name) AS name, any_value(u.text) AS text, any_value(u.source) AS source, count(*) FILTER (WHERE k.below <= u.u) AS n FROM u JOIN k ON u.source IS NOT DISTINCT FROM k.source GROUP BY u.row, u.doc_id)
SELECT doc_id, text, source, copy::INTEGER AS copy, md5('mix-order:' || name || ':' || copy::VARCHAR) AS shuffle_key
FROM (SELECT doc_id, text, source, name, unnest(range(1, n + 1)) AS copy FROM c)
"""
