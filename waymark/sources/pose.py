"""Camera poses: headerless vendor CSV of 17 columns, its sphere sidecar and INI files; the
delivery layout, and the older one of camera folders.

All files of a delivery are read as one distributed text scan. Rows that don't parse or whose
rotation isn't one are skipped, as the deliveries hold such rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.text import gps_time, image_time
from waymark.functions.vectors import cross, dot, vec

COLUMNS = 17
IMAGES = r"(?i)\.(jpg|jpeg|png|tif|tiff)$"


def delimiter(sample: Column) -> Column:
    """The commonest of semicolon, tab and comma in a text; a semicolon wins ties."""
    n = lambda c: F.length(sample) - F.length(F.replace(sample, F.lit(c), F.lit("")))
    return F.when((n(";") >= n(",")) & (n(";") >= n("\t")) & (n(";") > 0), ";").when((n("\t") > n(",")), "\t").otherwise(",")


def read_rows(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, row (1-based, of lines) and cells of the non-blank lines of every matching file."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    lines = files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("value"))
    lines = lines.withColumn("sep", delimiter(F.substring("value", 1, 8192))).select("path", "sep", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("row", "line"))
    cells = F.transform(F.split("line", F.concat(F.lit("["), F.col("sep"), F.lit("]"))), lambda c: F.trim(c))
    return lines.filter(F.trim("line") != "").select("path", (F.col("row") + 1).alias("row"), cells.alias("cells"))


def rotation_ok(a, b, c) -> Column:
    """Columns a, b, c are orthonormal within 1e-5 with determinant 1, and forward x up = right."""
    small = lambda x, e=1e-5: F.abs(x) <= e
    return small(dot(a, a) - 1) & small(dot(b, b) - 1) & small(dot(c, c) - 1) & small(dot(a, b)) & small(dot(b, c)) & small(dot(a, c)) & small(dot(cross(a, b), c) - 1)


def _poses(rows: DataFrame, dated: Column, gps_week: int | None, leap: int) -> DataFrame:
    """Pose columns of rows (path, row, cells, job_name, track_name). The week is given, or of
    three candidates the one nearest to the date that `dated` holds."""
    rows = rows.filter((F.size("cells") == COLUMNS) & F.try_element_at("cells", F.lit(1)).rlike(IMAGES))
    number = lambda i: F.try_element_at("cells", F.lit(i)).try_cast("double")
    names = ["gps_sow", "ox", "oy", "oz", "omega_gon", "phi_gon", "kappa_gon", *[f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]]
    out = rows.select("path", "row", "job_name", "track_name", dated.alias("__dated"), F.element_at("cells", 1).alias("image_name"), *[number(i + 2).alias(n) for i, n in enumerate(names)])
    for n in names:
        out = out.filter(F.col(n).isNotNull() & ~F.isnan(n))
    right, up, back = vec("r11", "r21", "r31"), vec("r12", "r22", "r32"), vec("r13", "r23", "r33")
    out = out.filter(rotation_ok(right, up, back))
    stamp = F.regexp_extract("__dated", r"(20\d{6})_(\d{4})", 0)
    job = F.when(stamp != "", F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmm")))
    base = F.floor((F.unix_seconds(job) - 315964800) / 604800)
    candidates = F.array(*[F.struct(F.abs(F.unix_micros(gps_time(base + d, F.col("gps_sow"), leap)) - F.unix_micros(job)).alias("off"), (base + d).alias("week")) for d in (-1, 0, 1)])
    week = F.lit(gps_week) if gps_week is not None else F.array_min(candidates)["week"]
    out = out.withColumn("gps_week", week.cast("long")).withColumn("taken_at", gps_time(F.col("gps_week"), F.col("gps_sow"), leap))
    out = out.withColumns({"fx": -F.col("r13"), "fy": -F.col("r23"), "fz": -F.col("r33"), "ux": F.col("r12"), "uy": F.col("r22"), "uz": F.col("r32")})
    return out.withColumn("record_name", F.concat_ws("_", "job_name", "track_name")).drop("__dated")


def scan_pose_sphere(spark: SparkSession, root: str, gps_week: int | None = None, leap: int = 18) -> DataFrame:
    parts = F.split("path", "/")
    rows = read_rows(spark, root, "*_Sphere.csv").withColumns({"job_name": F.element_at(parts, -4), "track_name": F.element_at(parts, -3)})
    return _poses(rows, F.col("job_name"), gps_week, leap)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _any_case(name: str) -> str:
    """A file pattern for a name in upper or lower case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name)


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """folder and image_name of every image below root that isn't empty; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("_metadata.file_path").alias("path")).filter(F.col("path").rlike(IMAGES))
    return files.select(folder(F.col("path")).alias("folder"), F.regexp_extract("path", "[^/]*$", 0).alias("image_name"))


def scan_pose_delivery(spark: SparkSession, root: str, gps_week: int | None = None, leap: int = 18) -> DataFrame:
    """Poses of a delivery: External Orientation.csv beside the images of a camera folder. The
    folder's Internal Orientation.txt must describe a sphere, an INI of the track above must
    identify the system, and only rows whose image is there count. A week that isn't given
    follows from the date in the path below root."""
    known = scan_ini(spark, root, "MMSIdentification").select(folder(F.col("path")).alias("track"), F.col("path").alias("ini_path"), "values")
    known = known.groupBy("track").agg(F.min_by("values", F.lower("ini_path")).alias("ini"))
    spheres = scan_sidecar(spark, root, "Internal Orientation.txt").filter(F.col("sphere_radius_m").isNotNull() & (F.size("longitude_limits_deg") == 2)).select(folder(F.col("path")).alias("folder"))
    parts = F.split("path", "/")
    rows = read_rows(spark, root, _any_case("External Orientation.csv")).withColumns({"job_name": F.element_at(parts, -4), "track_name": F.element_at(parts, -3), "folder": folder(F.col("path")), "track": folder(folder(F.col("path")))})
    rows = rows.join(known, "track").join(spheres.distinct(), "folder", "left_semi").withColumn("image_name", F.try_element_at("cells", F.lit(1)))
    rows = rows.join(list_images(spark, root), ["folder", "image_name"], "left_semi")
    inner = re.sub(r"^[a-z]+:/*", "/", root).strip("/")
    below = F.replace(F.element_at(F.split("path", re.escape(inner), 2), -1), F.lit("/"), F.lit("_"))
    ini = rows.select("path", F.col("ini")["Manufacturer"].alias("manufacturer"), F.col("ini")["ModelName"].alias("model_name"), F.col("ini")["SerialNumber"].alias("serial_number")).distinct()
    return _poses(rows.drop("image_name"), below, gps_week, leap).join(ini, "path")


#: Columns of the older layout, from the second on.
LEGACY = "ox oy oz fx fy fz ux uy uz roll_deg pitch_deg yaw_deg omega_deg phi_deg kappa_deg".split()


def scan_pose_legacy(spark: SparkSession, root: str) -> DataFrame:
    """Poses of the older layout: any CSV below a folder named CAM, image in the second column,
    17 columns or more, time in the image's name; only rows whose image is there count."""
    rows = read_rows(spark, root, "*.{csv,CSV,Csv}").filter(F.lower("path").contains("/cam/")).withColumn("folder", folder(F.col("path")))
    rows = rows.filter((F.size("cells") >= COLUMNS) & F.try_element_at("cells", F.lit(2)).rlike(IMAGES)).withColumn("image_name", F.element_at("cells", 2))
    rows = rows.join(list_images(spark, root), ["folder", "image_name"], "left_semi")
    record = F.element_at(F.split("path", "/"), -3)
    out = rows.select("path", "row", "image_name", record.alias("job_name"), F.lit(None).cast("string").alias("track_name"), record.alias("record_name"), F.element_at(F.split(record, "_"), -1).alias("route_id"), image_time(F.col("image_name")).alias("taken_at"), *[F.try_element_at("cells", F.lit(i + 3)).try_cast("double").alias(n) for i, n in enumerate(LEGACY)])
    whole = F.col("taken_at").isNotNull()
    for n in LEGACY:
        whole &= F.col(n).isNotNull()
    return out.filter(whole)


def scan_frames(*scans: DataFrame) -> DataFrame:
    """Union of scans, the first discovery of each (image, file) alone, in time order."""
    both = None
    for i, s in enumerate(scans):
        own = s.withColumn("__scan", F.lit(i))
        both = own if both is None else both.unionByName(own, allowMissingColumns=True)
    w = W.partitionBy("image_name", "path").orderBy("__scan", "row")
    return both.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k", "__scan").orderBy("taken_at", "path", "row")


def scan_sidecar(spark: SparkSession, root: str, pattern: str = "*_Sphere.txt") -> DataFrame:
    """path and the sphere's fields; 0..360 / 0..180 about (180, 90) is the usual sphere."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    lines = F.filter(F.split(F.regexp_replace("value", "^﻿", ""), r"\r\n|\n|\r"), lambda x: F.instr(x, "=") > 0)
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)), F.trim(F.regexp_replace(x, "^[^=]*=", ""))))
    values = text.select(F.col("_metadata.file_path").alias("path"), F.map_from_entries(entries).alias("m"))
    numbers = lambda k: F.transform(F.split(F.col("m")[k], ","), lambda v: F.trim(v).try_cast("double"))
    out = values.select("path", numbers("ImageSize").alias("size"), numbers("WidthLimits").alias("w"), numbers("HeightLimits").alias("h"), numbers("PanoramaHotSpot").alias("hot"), F.col("m")["SphereRadius"].try_cast("double").alias("sphere_radius_m"))
    same = lambda c, a, b: (F.abs(F.col(c)[0] - a) <= 1e-9) & (F.abs(F.col(c)[1] - b) <= 1e-9)
    shifted = F.coalesce(same("w", 0, 360) & same("h", 0, 180) & same("hot", 180, 90), F.lit(False))
    pick = lambda c, a, b: F.when(shifted, F.array(F.lit(float(a)), F.lit(float(b)))).otherwise(F.col(c))
    return out.select("path", F.when(F.size("size") == 2, F.col("size")[0].cast("int")).alias("image_width"), F.when(F.size("size") == 2, F.col("size")[1].cast("int")).alias("image_height"), pick("w", -180, 180).alias("longitude_limits_deg"), pick("h", -90, 90).alias("latitude_limits_deg"), pick("hot", 0, 0).alias("hotspot"), "sphere_radius_m")


def scan_ini(spark: SparkSession, root: str, section: str) -> DataFrame:
    """path and key/value map of the INI files that hold a section."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ini").text(root, wholetext=True)
    body = F.regexp_extract("value", rf"(?ms)^\[{section}\]\s*$(.*?)(?=^\[|\z)", 1)
    entries = F.transform(F.filter(F.split(body, r"\r\n|\n|\r"), lambda x: F.instr(x, "=") > 0), lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)), F.trim(F.regexp_replace(x, "^[^=]*=", ""))))
    return text.filter(F.col("value").rlike(rf"(?m)^\[{section}\]\s*$")).select(F.col("_metadata.file_path").alias("path"), F.map_from_entries(entries).alias("values"))
