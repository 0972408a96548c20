"""Window queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.operators.sequences import islands
from waymark.registry import query
from waymark.sources import survey as S


@query(S.with_tables("detections", "SELECT image_name, class_id, detection_index FROM (SELECT *, row_number() OVER (PARTITION BY image_name, class_id ORDER BY detection_index) AS k FROM detections) WHERE k = 1"))
def win_first_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return S.detections(spark, sf).groupBy("image_name", "class_id").agg(F.min("detection_index").alias("detection_index"))


@query(S.with_tables("pole_observations", "SELECT record_name, image_name, detection_index, quality FROM (SELECT *, row_number() OVER (PARTITION BY record_name, image_name ORDER BY quality DESC, detection_index) AS k FROM pole_observations) WHERE k = 1"))
def win_best_per_frame(spark: SparkSession, sf: str) -> DataFrame:
    best = F.min(F.struct((-F.col("quality")).alias("q"), "detection_index", "quality")).alias("b")
    return S.pole_observations(spark, sf).groupBy("record_name", "image_name").agg(best).select("record_name", "image_name", "b.detection_index", "b.quality")


@query(S.with_tables("points", "SELECT cx, cy, point_id FROM (SELECT floor(x / 4)::BIGINT AS cx, floor(y / 4)::BIGINT AS cy, point_id, row_number() OVER (PARTITION BY floor(x / 4), floor(y / 4) ORDER BY z, point_id) AS k FROM points) WHERE k = 1"))
def win_nearest_cell(spark: SparkSession, sf: str) -> DataFrame:
    p = S.points(spark, sf).groupBy(F.floor(F.col("x") / 4).alias("cx"), F.floor(F.col("y") / 4).alias("cy"))
    return p.agg(F.min_by("point_id", F.struct("z", "point_id")).alias("point_id"))


@query(S.with_tables("frames", ", s AS (SELECT track_id, sqrt((ox - lag(ox) OVER w) ** 2 + (oy - lag(oy) OVER w) ** 2) AS d FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY ordinal)) SELECT track_id, round(coalesce(sum(d), 0), 4) AS length FROM s GROUP BY track_id"))
def win_consecutive_dist(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("track_id").orderBy("ordinal")
    d = F.sqrt((F.col("ox") - F.lag("ox").over(w)) ** 2 + (F.col("oy") - F.lag("oy").over(w)) ** 2)
    return S.frames(spark, sf).select("track_id", d.alias("d")).groupBy("track_id").agg(F.round(F.coalesce(F.sum("d"), F.lit(0.0)), 4).alias("length"))


_ISLAND = """, f AS (SELECT track_id, ordinal, ordinal - row_number() OVER (PARTITION BY track_id ORDER BY ordinal) AS g FROM frames WHERE k < 60)
SELECT track_id, min(ordinal) AS first, max(ordinal) AS last, count(*) AS n FROM f GROUP BY track_id, g HAVING count(*) >= 2"""


@query(S.with_tables("frames", _ISLAND))
def win_route_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Contiguous pieces of a route, two frames or more."""
    f = islands(S.frames(spark, sf).filter("k < 60"), ("track_id",), "ordinal")
    return f.groupBy("track_id", "island").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("n")).filter("n >= 2").drop("island")


@query(S.with_tables("frames", ", f AS (SELECT track_id, ordinal - row_number() OVER (PARTITION BY track_id ORDER BY ordinal) AS g FROM frames WHERE k < 60), c AS (SELECT track_id, g, count(*) AS n FROM f GROUP BY ALL) SELECT track_id, max(n) AS longest FROM c GROUP BY track_id"))
def win_islands(spark: SparkSession, sf: str) -> DataFrame:
    f = islands(S.frames(spark, sf).filter("k < 60"), ("track_id",), "ordinal").groupBy("track_id", "island").count()
    return f.groupBy("track_id").agg(F.max("count").alias("longest"))


@query(S.with_tables("points", ", g AS (SELECT block_id, z - lag(z) OVER (PARTITION BY block_id ORDER BY z) AS gap FROM points) SELECT block_id, round(max(gap), 6) AS max_gap FROM g GROUP BY block_id"))
def win_max_gap(spark: SparkSession, sf: str) -> DataFrame:
    gap = F.col("z") - F.lag("z").over(W.partitionBy("block_id").orderBy("z"))
    return S.points(spark, sf).select("block_id", gap.alias("gap")).groupBy("block_id").agg(F.round(F.max("gap"), 6).alias("max_gap"))


@query(S.with_tables("detections", ", r AS (SELECT image_name, point_count, row_number() OVER w AS k, point_count - lead(point_count) OVER w AS margin FROM detections WINDOW w AS (PARTITION BY image_name ORDER BY point_count DESC, detection_index)) SELECT image_name, point_count AS best, margin FROM r WHERE k = 1 AND (margin IS NULL OR margin >= 5)"))
def win_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    """The best of an image if the second is clearly worse."""
    w = W.partitionBy("image_name").orderBy(F.desc("point_count"), "detection_index")
    d = S.detections(spark, sf).select("image_name", F.col("point_count").alias("best"), F.row_number().over(w).alias("k"), (F.col("point_count") - F.lead("point_count").over(w)).alias("margin"))
    return d.filter("k = 1 AND (margin IS NULL OR margin >= 5)").drop("k")


@query(S.with_tables("frames", "SELECT frame_id, ordinal FROM frames"))
def win_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return S.frames(spark, sf).select("frame_id", "ordinal")


@query(S.with_tables("frames", "SELECT frame_id, (SELECT count(*) FROM frames g WHERE g.track_id = f.track_id AND g.ordinal < f.ordinal) AS rank FROM frames f"))
def rank_in_track(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("track_id").orderBy("ordinal")
    return S.frames(spark, sf).select("frame_id", (F.row_number().over(w) - 1).cast("long").alias("rank"))


@query(S.with_tables("frames", "SELECT track_id, string_agg(lon::DECIMAL(12, 6)::VARCHAR || ' ' || lat::DECIMAL(12, 6)::VARCHAR, ',' ORDER BY ordinal) AS line FROM frames GROUP BY track_id"))
def route_line(spark: SparkSession, sf: str) -> DataFrame:
    """The ordered positions of each track."""
    text = F.concat(F.col("lon").cast("decimal(12,6)").cast("string"), F.lit(" "), F.col("lat").cast("decimal(12,6)").cast("string"))
    pairs = F.array_sort(F.collect_list(F.struct("ordinal", text.alias("t"))))
    return S.frames(spark, sf).groupBy("track_id").agg(F.array_join(F.transform(pairs, lambda p: p["t"]), ",").alias("line"))
