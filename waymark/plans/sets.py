"""Set operations and small-table updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.tables import ordinals
from waymark.registry import query
from waymark.sources import survey as S


@query(S.with_tables("frames", "SELECT frame_id, record_name, source FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY source) AS k FROM (SELECT frame_id, record_name, 'csv' AS source FROM frames WHERE record_name IN ('view', 'click') UNION ALL SELECT frame_id, record_name, 'delivery' FROM frames WHERE k >= 20)) WHERE k = 1"))
def union_scanners(spark: SparkSession, sf: str) -> DataFrame:
    """Two scanners, first discovery per key: a pre-aggregated minimum."""
    f = S.frames(spark, sf)
    a = f.filter(F.col("record_name").isin("view", "click")).select("frame_id", "record_name", F.lit("csv").alias("source"))
    b = f.filter("k >= 20").select("frame_id", "record_name", F.lit("delivery").alias("source"))
    return a.unionByName(b).groupBy("frame_id").agg(F.min(F.struct("source", "record_name")).alias("m")).select("frame_id", "m.record_name", "m.source")


@query(S.with_tables("detections", "SELECT DISTINCT image_name, class_id, round(x0, 6) AS x0, round(y0, 6) AS y0 FROM detections"))
def dedupe_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return S.detections(spark, sf).select("image_name", "class_id", F.round("x0", 6).alias("x0"), F.round("y0", 6).alias("y0")).distinct()


@query(S.with_tables("detections", ", g AS (SELECT image_name, list_sort(list_distinct(list(class_id))) AS classes FROM detections GROUP BY image_name) SELECT image_name, array_to_string(list_sort(list_intersect(classes, [0, 2, 4])), ',') AS common FROM g"))
def class_intersection(spark: SparkSession, sf: str) -> DataFrame:
    g = S.detections(spark, sf).groupBy("image_name").agg(F.collect_set("class_id").alias("c"))
    wanted = F.array(*[F.lit(x).cast("long") for x in (0, 2, 4)])
    return g.select("image_name", F.array_join(F.array_sort(F.array_intersect("c", wanted)), ",").alias("common"))


@query(S.with_tables("detections", "SELECT record_name, array_to_string(list_sort(list_distinct(list(class_id))), ',') AS sources FROM detections GROUP BY record_name"))
def sources_union(spark: SparkSession, sf: str) -> DataFrame:
    return S.detections(spark, sf).groupBy("record_name").agg(F.array_join(F.array_sort(F.collect_set("class_id")), ",").alias("sources"))


@query(S.with_tables("splits", ", f AS (SELECT base FROM splits GROUP BY base HAVING count(DISTINCT split_index) = 5 AND sum(point_count) > 2000) SELECT file_id, s.base FROM splits s WHERE base NOT IN (SELECT base FROM f)"))
def except_full_files(spark: SparkSession, sf: str) -> DataFrame:
    s = S.splits(spark, sf)
    full = s.groupBy("base").agg(F.countDistinct("split_index").alias("n"), F.sum("point_count").alias("p")).filter("n = 5 AND p > 2000")
    return s.join(full, "base", "left_anti").select("file_id", "base")


@query(S.with_tables("detections", "SELECT a.class_id AS a, b.class_id AS b, count(*) AS images FROM (SELECT DISTINCT image_name, class_id FROM detections) a JOIN (SELECT DISTINCT image_name, class_id FROM detections) b ON a.image_name = b.image_name AND a.class_id < b.class_id GROUP BY ALL"))
def images_shared(spark: SparkSession, sf: str) -> DataFrame:
    """How many images pairs of classes share."""
    d = S.detections(spark, sf).select("image_name", F.col("class_id").alias("a")).distinct()
    return d.join(d.withColumnRenamed("a", "b"), "image_name").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("images"))


@query(S.with_tables("features", "SELECT id, point_x, point_y, deleted OR id % 17 = 0 AS deleted, CASE WHEN id % 13 = 0 THEN upper(name) ELSE name END AS name FROM features"))
def overlay_update(spark: SparkSession, sf: str) -> DataFrame:
    """Features after a change log: the last change of each id wins."""
    f = S.features(spark, sf)
    renamed = f.filter("id % 13 = 0").select("id", F.lit(1).alias("revision"), F.upper("name").alias("new_name"), F.lit(None).cast("boolean").alias("gone"))
    gone = f.filter("id % 17 = 0").select("id", F.lit(2).alias("revision"), F.lit(None).cast("string").alias("new_name"), F.lit(True).alias("gone"))
    last = renamed.unionByName(gone).groupBy("id").agg(F.max_by("new_name", F.when(F.col("new_name").isNotNull(), F.col("revision"))).alias("new_name"), F.max("gone").alias("gone"))
    out = f.join(last, "id", "left")
    return out.select("id", "point_x", "point_y", (F.col("deleted") | F.coalesce("gone", F.lit(False))).alias("deleted"), F.coalesce("new_name", "name").alias("name"))


@query(S.with_tables("features", "SELECT id, name, row_number() OVER (ORDER BY id) AS ordinal FROM features WHERE NOT deleted"))
def sink_overlay_edit(spark: SparkSession, sf: str) -> DataFrame:
    """What an edited layer writes: rows not deleted, in order."""
    f = S.features(spark, sf).filter("NOT deleted").select("id", "name")
    return ordinals(f, ("id",))


@query(S.with_tables("runs", "SELECT dataset_id, count(*) AS total, count(*) FILTER (WHERE status = 'O') AS queued, max(finished_at) AS updated FROM runs GROUP BY dataset_id"))
def datasets_list(spark: SparkSession, sf: str) -> DataFrame:
    return S.runs(spark, sf).groupBy("dataset_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "O").alias("queued"), F.max("finished_at").alias("updated"))


@query(S.with_tables("runs", "SELECT run_id, CASE status WHEN 'O' THEN 'interrupted' WHEN 'P' THEN 'queued' ELSE 'completed' END AS status FROM runs"))
def restart_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("status")
    return S.runs(spark, sf).select("run_id", F.when(s == "O", "interrupted").when(s == "P", "queued").otherwise("completed").alias("status"))
