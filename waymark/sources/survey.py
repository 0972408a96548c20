"""Survey tables derived from the given Parquet tables, as DataFrames and as SQL.

The same arithmetic in both, so that a query and its SQL start from equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("event_id").alias("frame_id"), F.col("event_type").alias("record_name"), F.col("user_id").alias("track_id"), "ts",
        (F.row_number().over(order) - 1).cast("long").alias("ordinal"),
        (20.0 * F.col("user_id") + (F.col("event_id") % 97)).alias("ox"), F.col("value").alias("oy"), F.lit(2.0).alias("oz"), k.alias("k"),
        F.sin(F.radians(3.6 * k)).alias("fx"), F.cos(F.radians(3.6 * k)).alias("fy"), F.lit(0.0).alias("fz"),
    ).withColumn("lon", 127 + F.col("ox") / 100000).withColumn("lat", 37 + F.col("oy") / 100000)


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("j"))
    at = lambda i: F.element_at("embedding", 3 * F.col("j") + i).cast("double")
    pid = (F.col("vec_id") * 21 + F.col("j")).cast("long")
    return e.select(
        pid.alias("point_id"), (200 + 500 * at(1)).alias("x"), (160 + 400 * at(2)).alias("y"), (3 + 10 * at(3)).alias("z"),
        F.col("label").alias("class_id"), F.col("label").alias("file_id"), F.floor(F.col("vec_id") / 50).alias("block_id"),
        (pid * 7 % 256).cast("int").alias("red"), (pid * 13 % 65536).cast("int").alias("intensity"),
    )


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return p.groupBy("file_id", "block_id").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"], F.count("*").alias("n"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    return blocks(spark, sf).groupBy("file_id").agg(*[f(f"{n}_{c}").alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"], F.sum("n").alias("n"))


def detections(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "lineitem")
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    left, top = F.pmod(p, F.lit(4096.0)), 20 * q
    return d.select(
        F.concat("l_returnflag", "l_linestatus").alias("record_name"), F.concat(F.lit("img"), "l_orderkey").alias("image_name"),
        F.col("l_linenumber").cast("long").alias("detection_index"), (F.col("l_suppkey") % 5).alias("class_id"), (1 - F.col("l_discount")).alias("confidence"),
        left.alias("x0"), top.alias("y0"), (left + 40 + q).alias("x1"), (top + 30 + 100 * F.col("l_tax")).alias("y1"),
        (10 * (F.col("l_partkey") % 40) + 0.06 * F.pmod(q, F.lit(5.0))).alias("x"), (5 * F.col("l_suppkey") + F.col("l_tax")).alias("y"), (5 + F.col("l_discount")).alias("z"), q.cast("int").alias("point_count"),
        F.col("l_orderkey").alias("order_id"),
    )


def pole_observations(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "lineitem").filter("l_tax > 0.02")
    return d.select(
        F.concat("l_returnflag", "l_linestatus").alias("record_name"), F.concat(F.lit("img"), "l_orderkey").alias("image_name"), F.col("l_linenumber").cast("long").alias("detection_index"),
        (10 * (F.col("l_partkey") % 40) + 0.2 * F.col("l_linenumber")).alias("pole_x"), (5 * F.col("l_suppkey") + 0.1 * F.col("l_linenumber")).alias("pole_y"), (0.1 * F.col("l_discount")).alias("pole_z"), (1 - F.col("l_tax")).alias("quality"),
    )


def features(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.pmod(37.0 * F.col("c_custkey"), F.lit(1000.0)).alias("point_x"), (F.col("c_acctbal") / 10).alias("point_y"), (F.col("c_custkey") % 10 == 0).alias("deleted"), F.col("c_name").alias("name"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("dataset_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("finished_at"), F.col("o_totalprice").alias("cost"))


def splits(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("file_id"), F.col("p_brand").alias("base"), (F.col("p_partkey") % 5).alias("split_index"), F.col("p_size").cast("long").alias("point_count"), F.col("p_name").alias("path"))


_P = ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in "xyz")
_M = ", ".join(f"min(min_{c}) AS min_{c}, max(max_{c}) AS max_{c}" for c in "xyz")
SQL = {
    "frames": """frames AS (SELECT *, 127 + ox / 100000 AS lon, 37 + oy / 100000 AS lat FROM (SELECT event_id AS frame_id, event_type AS record_name, user_id AS track_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ordinal,
      20.0::DOUBLE * user_id + (event_id % 97) AS ox, value AS oy, 2.0::DOUBLE AS oz, k, sin(radians(3.6::DOUBLE * k)) AS fx, cos(radians(3.6::DOUBLE * k)) AS fy, 0.0::DOUBLE AS fz FROM (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k FROM events)))""",
    "points": """points AS (SELECT vec_id * 21 + j AS point_id, 200 + 500 * embedding[3 * j + 1]::DOUBLE AS x, 160 + 400 * embedding[3 * j + 2]::DOUBLE AS y, 3 + 10 * embedding[3 * j + 3]::DOUBLE AS z, label AS class_id, label AS file_id, vec_id // 50 AS block_id,
      ((vec_id * 21 + j) * 7 % 256)::INTEGER AS red, ((vec_id * 21 + j) * 13 % 65536)::INTEGER AS intensity FROM embeddings, range(21) AS t(j))""",
    "blocks": f"blocks AS (SELECT file_id, block_id, {_P}, count(*) AS n FROM points GROUP BY ALL)",
    "files": f"files AS (SELECT file_id, {_M}, sum(n)::BIGINT AS n FROM blocks GROUP BY ALL)",
    "detections": """detections AS (SELECT *, x0 + 40 + q AS x1, y0 + 30 + 100 * l_tax AS y1 FROM (SELECT l_returnflag || l_linestatus AS record_name, 'img' || l_orderkey AS image_name, l_linenumber::BIGINT AS detection_index, l_suppkey % 5 AS class_id, 1 - l_discount AS confidence, l_quantity AS q, l_tax,
      (l_extendedprice % 4096.0::DOUBLE) AS x0, 20 * l_quantity AS y0, 10 * (l_partkey % 40) + 0.06::DOUBLE * (l_quantity % 5.0::DOUBLE) AS x, 5 * l_suppkey + l_tax AS y, 5 + l_discount AS z, l_quantity::INTEGER AS point_count, l_orderkey AS order_id FROM lineitem))""",
    "pole_observations": """pole_observations AS (SELECT l_returnflag || l_linestatus AS record_name, 'img' || l_orderkey AS image_name, l_linenumber::BIGINT AS detection_index, 10 * (l_partkey % 40) + 0.2::DOUBLE * l_linenumber AS pole_x,
      5 * l_suppkey + 0.1::DOUBLE * l_linenumber AS pole_y, 0.1::DOUBLE * l_discount AS pole_z, 1 - l_tax AS quality FROM lineitem WHERE l_tax > 0.02::DOUBLE)""",
    "features": "features AS (SELECT c_custkey AS id, (37.0::DOUBLE * c_custkey) % 1000.0::DOUBLE AS point_x, c_acctbal / 10 AS point_y, c_custkey % 10 = 0 AS deleted, c_name AS name FROM customer)",
    "runs": "runs AS (SELECT o_orderkey AS run_id, o_custkey AS dataset_id, o_orderstatus AS status, o_orderdate AS finished_at, o_totalprice AS cost FROM orders)",
    "splits": "splits AS (SELECT p_partkey AS file_id, p_brand AS base, p_partkey % 5 AS split_index, p_size::BIGINT AS point_count, p_name AS path FROM part)",
}
_NEEDS = {"blocks": ("points",), "files": ("points", "blocks")}


def with_tables(names: str, body: str) -> str:
    """body after the CTEs of the named tables; body may go on with `, more AS (...)`."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in (*_NEEDS.get(n, ()), n) if x not in order]
    return "WITH " + ",\n".join(SQL[n] for n in order) + ("\n" if not body.lstrip().startswith(",") else "") + body
