"""Clustering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import clustering as C
from waymark.registry import query
from waymark.sources import survey as S


_OVER = "greatest(0, least(q.y1, n.y1) - greatest(q.y0, n.y0)) * greatest(0, least(n.x1, q.x1) - greatest(n.x0, q.x0), least(n.x1 - 4096, q.x1) - greatest(n.x0 - 4096, q.x0), least(n.x1 + 4096, q.x1) - greatest(n.x0 + 4096, q.x0))"
_AREAS = "(q.x1 - q.x0) * (q.y1 - q.y0) + (n.x1 - n.x0) * (n.y1 - n.y0)"
_NMS = S.with_tables("detections", f""", o AS (SELECT image_name, class_id, list(struct_pack(i := detection_index, c := confidence, x0 := x0, y0 := y0, x1 := x1, y1 := y1, s := [detection_index]) ORDER BY confidence DESC, detection_index) AS b FROM detections GROUP BY image_name, class_id),
r AS (SELECT image_name, class_id, b, 1 AS k, [b[1]] AS kept FROM o
UNION ALL SELECT image_name, class_id, b, k + 1, CASE WHEN hit IS NULL THEN list_append(kept, n) ELSE list_transform(kept, lambda q: CASE WHEN q.i = hit THEN struct_pack(i := q.i, c := q.c, x0 := q.x0, y0 := q.y0, x1 := q.x1, y1 := q.y1, s := list_append(q.s, n.i)) ELSE q END) END
FROM (SELECT *, list_filter(kept, lambda q: {_OVER} >= 0.5 * ({_AREAS} - {_OVER}))[1].i AS hit FROM (SELECT *, b[k + 1] AS n FROM r WHERE k < len(b)))),
e AS (SELECT image_name, class_id, unnest(kept) AS q FROM r WHERE k = len(b))
SELECT image_name, class_id, q.i AS detection_index, q.c AS confidence, array_to_string(list_sort(q.s), ',') AS sources FROM e""").replace("WITH ", "WITH RECURSIVE ", 1)


@query(_NMS)
def nms_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Ties of confidence and index, which the SQL leaves open, go by the order of the table."""
    place = {"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")}
    return C.nms_merge(S.detections(spark, sf).withColumns(place), by_index=True, place=tuple(place))  # by_index: as the SQL tells kept boxes apart


_EDGES = """, n AS (SELECT point_id, x, y, z FROM points), p AS (SELECT a.point_id AS a, b.point_id AS b FROM n a JOIN n b ON a.point_id <> b.point_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4 AND abs(a.x - b.x) <= 2)"""


@query(S.with_tables("points", _EDGES + " SELECT a, count(*) AS n FROM p GROUP BY a"))
def neighbour_counts(spark: SparkSession, sf: str) -> DataFrame:
    pairs = C.near_pairs(S.points(spark, sf), 2.0, "point_id", ("x", "y"))
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.count("*").alias("n"))


_COMPONENTS = """WITH RECURSIVE n AS (SELECT vec_id * 21 + j AS id, 200 + 500 * embedding[3 * j + 1]::DOUBLE AS x, 160 + 400 * embedding[3 * j + 2]::DOUBLE AS y FROM embeddings, range(21) t(j)),
p AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON abs(a.x - b.x) <= 0.8 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.64::DOUBLE),
r AS (SELECT id AS a, id AS l FROM n UNION SELECT p.a, r.l FROM r JOIN p ON p.b = r.a WHERE r.l < p.a)
SELECT a AS point_id, min(l) AS component FROM r GROUP BY a"""


@query(_COMPONENTS)
def components(spark: SparkSession, sf: str) -> DataFrame:
    return C.linked_components(S.points(spark, sf), 0.8, "point_id", ("x", "y"))


@query()
def density_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return C.density_cluster(S.points(spark, sf), 6.0, 6)


def _signs(spark: SparkSession, sf: str) -> DataFrame:
    return S.detections(spark, sf).withColumn("obs_id", F.col("order_id") * 10 + F.col("detection_index"))


@query()
def pole_merge(spark: SparkSession, sf: str) -> DataFrame:
    obs = S.pole_observations(spark, sf).withColumn("obs_id", F.regexp_extract("image_name", r"(\d+)$", 1).cast("long") * 10 + F.col("detection_index"))
    i = F.col("obs_id")
    made = {"pole_status": F.when(i % 5 > 0, "AUTO").otherwise("REVIEW"), "pole_type": F.when(i % 11 > 0, "ROUND").otherwise("BOX"), "occlusion": F.when(i % 7 == 0, "GROUND_CONFLICT").when(i % 3 == 0, "OCCLUDED").otherwise("VISIBLE")}
    return C.pole_merge(obs.dropDuplicates(["obs_id"]).withColumns(made), 0.15)


@query()
def sign_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Supports are made up by place: some sightings have one, some don't."""
    s = _signs(spark, sf).dropDuplicates(["obs_id"])
    return C.sign_dedupe(s.withColumn("support_id", F.when(F.col("order_id") % 3 > 0, F.concat(F.lit("P"), F.floor("x").cast("string"), F.lit("_"), F.col("order_id") % 2))))
