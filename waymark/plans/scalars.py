"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import crs, formats, text
from waymark.registry import query
from waymark.sources import survey as S


@query("SELECT o_orderkey AS id, 'D' || substr(sha256(o_orderkey::VARCHAR || '|' || o_orderstatus), 1, 19) AS detection_id FROM orders")
def make_detection_id(spark: SparkSession, sf: str) -> DataFrame:
    o = S.read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), text.opaque_id("D", F.col("o_orderkey").cast("string"), F.col("o_orderstatus")).alias("detection_id"))


@query("SELECT p_partkey AS id, regexp_replace(p_type || ' / ' || p_name, '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM part")
def sanitize_name(spark: SparkSession, sf: str) -> DataFrame:
    return S.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.safe_name(F.concat("p_type", F.lit(" / "), "p_name")).alias("name"))


@query("SELECT event_id AS id, date_trunc('second', ts) AS at FROM events")
def parse_image_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    """Times written as yyMMdd_HHmmss and read back."""
    e = S.read(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), text.image_time(F.date_format("ts", "yyMMdd_HHmmss")).alias("at"))


@query("SELECT l_orderkey AS o, l_linenumber AS n, epoch_us(TIMESTAMP '1980-01-06 00:00:00' + to_seconds((2300 + l_linenumber)::BIGINT * 604800 + (l_partkey * 37 % 604800) - 18)) AS micros FROM lineitem")
def gps_sow_to_utc(spark: SparkSession, sf: str) -> DataFrame:
    d = S.read(spark, sf, "lineitem")
    at = text.gps_time(2300 + F.col("l_linenumber"), (F.col("l_partkey") * 37 % 604800).cast("double"))
    return d.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.unix_micros(at).alias("micros"))


@query("SELECT event_id AS id, json_extract_string(props, '$.k')::INTEGER AS k, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS whole FROM events")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return S.read(spark, sf, "events").select(F.col("event_id").alias("id"), k.try_cast("int").alias("k"), k.rlike(r"^-?\d+$").alias("whole"))


@query("SELECT o_orderkey AS id, CASE WHEN t * t * (3 - 2 * t) IS NULL THEN 0 ELSE round(t * t * (3 - 2 * t), 9) END AS s FROM (SELECT o_orderkey, least(greatest((o_totalprice - 50000) / 100000, 0), 1) AS t FROM orders)")
def smoothstep(spark: SparkSession, sf: str) -> DataFrame:
    t = F.least(F.greatest((F.col("o_totalprice") - 50000) / 100000, F.lit(0.0)), F.lit(1.0))
    return S.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round(t * t * (3 - 2 * t), 9).alias("s"))


@query("SELECT p_partkey AS id, list_transform(string_split(p_size || ';' || p_partkey || ';x', ';'), lambda v: try_cast(v AS DOUBLE)) AS numbers FROM part")
def number_list(spark: SparkSession, sf: str) -> DataFrame:
    p = S.read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), text.number_list(F.concat_ws(";", "p_size", "p_partkey", F.lit("x"))).alias("numbers"))


@query(S.with_tables("frames", f"SELECT frame_id, round(e, 3) AS east, round(n, 3) AS north FROM (SELECT frame_id, {crs.TM_SQL[0]} AS e, {crs.TM_SQL[1]} AS n FROM (SELECT *, {crs.TM_SQL[2]} FROM frames))"))
def transverse_mercator(spark: SparkSession, sf: str) -> DataFrame:
    """Longitude and latitude to metres of a Transverse Mercator zone."""
    e, n = crs.transverse_mercator(F.col("lon"), F.col("lat"))
    return S.frames(spark, sf).select("frame_id", F.round(e, 3).alias("east"), F.round(n, 3).alias("north"))


@query(S.with_tables("frames", "SELECT frame_id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM frames"))
def inverse_mercator(spark: SparkSession, sf: str) -> DataFrame:
    """Longitude and latitude to metres and back."""
    e, n = crs.transverse_mercator(F.col("lon"), F.col("lat"))
    placed = S.frames(spark, sf).select("frame_id", e.alias("e"), n.alias("n"))
    at = placed.select("frame_id", crs.inverse_mercator_far(F.col("e"), F.col("n")).alias("at"))
    return at.select("frame_id", F.round("at.lon", 7).alias("lon"), F.round("at.lat", 7).alias("lat"))


_RING = f"""SELECT frame_id, list(round(e, 3) ORDER BY k) AS east, list(round(n, 3) ORDER BY k) AS north, list(z ORDER BY k) AS z FROM (SELECT frame_id, k, z, {crs.TM_SQL[0]} AS e, {crs.TM_SQL[1]} AS n FROM (SELECT *, {crs.TM_SQL[2]} FROM
(SELECT frame_id, q AS k, oz + q AS z, lon + 0.001::DOUBLE * (q % 2) AS lon, lat + 0.002::DOUBLE * (q // 2) AS lat FROM frames, range(4) t(q)))) GROUP BY frame_id"""


@query(S.with_tables("frames", _RING))
def reproject_geom(spark: SparkSession, sf: str) -> DataFrame:
    """A polygon of four corners at each frame, projected as one geometry."""
    corner = lambda k: F.struct((F.col("lon") + 0.001 * (k % 2)).alias("x"), (F.col("lat") + 0.002 * (k // 2)).alias("y"), (F.col("oz") + k).alias("z"))
    ring = F.array(*[corner(k) for k in range(4)])
    moved = S.frames(spark, sf).select("frame_id", F.struct(F.lit("Polygon").alias("type"), F.array(F.array(ring)).alias("coordinates")).alias("g")).select("frame_id", crs.reproject(F.col("g"), crs.transverse_mercator).alias("g"))
    return moved.select("frame_id", F.expr("g.coordinates[0][0]").alias("r")).select("frame_id", F.transform("r.x", lambda v: F.round(v, 3)).alias("east"), F.transform("r.y", lambda v: F.round(v, 3)).alias("north"), F.col("r.z").alias("z"))


_UNIT = "least(floor(log(2, b) / 10 + 1e-12), 4)"
_SIZE = f"CASE WHEN b = 0 THEN '0 B' ELSE (CASE WHEN b / pow(1024, {_UNIT}) >= 10 OR {_UNIT} = 0 THEN printf('%.0f', round(b / pow(1024, {_UNIT}), 0)) ELSE printf('%.1f', round(b / pow(1024, {_UNIT}), 1)) END) || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][{_UNIT}::INTEGER + 1] END"


@query(f"""SELECT o_orderkey AS id, {_SIZE} AS size, CASE WHEN d >= 1000 THEN printf('%.1f', round(d / 1000, 1)) || ' km' ELSE floor(d + 0.5::DOUBLE)::BIGINT || ' m' END AS far,
CASE WHEN s < 60 THEN ceil(s)::BIGINT || '\ucd08' ELSE floor(s / 60)::BIGINT || '\ubd84 ' || ceil(s - floor(s / 60) * 60)::BIGINT || '\ucd08' END AS took, strftime(o_orderdate, '%m. %d. %H:%M') AS day, strftime(o_orderdate, '%H:%M:%S') AS clock
FROM (SELECT *, (o_orderkey::DOUBLE * o_orderkey * (o_orderkey % 13))::DOUBLE AS b, o_totalprice / 50 AS d, o_totalprice / 900 AS s FROM orders)""")
def display_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes, distances, durations and times as people read them."""
    o, i, t = S.read(spark, sf, "orders"), F.col("o_orderkey").cast("double"), F.col("o_totalprice")
    return o.select(F.col("o_orderkey").alias("id"), formats.bytes_text(i * i * (F.col("o_orderkey") % 13)).alias("size"), formats.distance_text(t / 50).alias("far"), formats.duration_text(t / 900).alias("took"), formats.date_text(F.col("o_orderdate")).alias("day"), formats.clock_text(F.col("o_orderdate")).alias("clock"))
