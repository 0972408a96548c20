"""Per-frame result documents (JSON): reading them as detections and supports, writing them.

One document is one row of text; broken documents and entries are skipped, as a run may have
been cut off while it wrote them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.text import opaque_id

_POLE = "found boolean, x double, y double, z double, type string, method string, status string, occluded_bottom boolean, occlusion_status string, point_count int, quality double, axis_rmse_m double, ground_rmse_m double, bottom_gap_m double, association_distance_m double, completeness_ratio double"
_DETECTION = f"detection_index long, image_name string, class_id long, class_name string, confidence double, x double, y double, z double, point_count long, accepted_for_shp boolean, bbox_xyxy array<double>, mask_polygon array<array<double>>, pole struct<{_POLE.replace(' ', ':').replace(',:', ',')}>"
DOCUMENT = f"run_fingerprint string, image_name string, record_name string, model_name string, pose_row_number long, detections array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in _DETECTION.split(', '))}>>"


def detection_id(record: Column, image: Column, index: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return opaque_id("D", text(record), text(image), F.coalesce(index.cast("long"), F.lit(0)).cast("string"))


def documents(spark: SparkSession, root: str, fingerprint: str | None = None, pattern: str = "*.txt") -> DataFrame:
    """Parsed documents of one run (all runs where no fingerprint is given)."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    parsed = files.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", DOCUMENT, {"mode": "PERMISSIVE"}).alias("d")).filter("d.detections IS NOT NULL")
    out = parsed.select("path", "d.*")
    return out if fingerprint is None else out.filter(F.col("run_fingerprint") == fingerprint)


def _entries(docs: DataFrame) -> DataFrame:
    d = docs.withColumn("e", F.explode("detections")).filter("e IS NOT NULL AND e.x IS NOT NULL AND coalesce(e.accepted_for_shp, true)")
    image = F.coalesce("e.image_name", "image_name")
    return d.withColumn("image", image).withColumn("detection_id", detection_id(F.col("record_name"), image, F.col("e.detection_index")))


def scan_results(docs: DataFrame) -> DataFrame:
    """Detections that were accepted and have a position."""
    d = _entries(docs)
    own = ("detection_index", "class_id", "class_name", "confidence", "x", "y", "z", "point_count")
    return d.select("record_name", F.col("image").alias("image_name"), "detection_id", *[F.col(f"e.{c}").alias(c) for c in own], "run_fingerprint", "model_name", "pose_row_number")


def scan_pole_obs(docs: DataFrame) -> DataFrame:
    """Supports found under them, with a state of occlusion for documents that lack one."""
    d = _entries(docs).filter("e.pole.found AND e.pole.x IS NOT NULL")
    hidden = F.col("e.pole.occluded_bottom")
    state = F.coalesce("e.pole.occlusion_status", F.when(hidden, "OCCLUDED").when(~hidden, "VISIBLE").otherwise("UNKNOWN"))
    own = {"pole_x": "x", "pole_y": "y", "pole_z": "z", "pole_type": "type", "pole_method": "method", "pole_status": "status", "pole_point_count": "point_count", "pole_quality": "quality", "axis_rmse_m": "axis_rmse_m", "ground_rmse_m": "ground_rmse_m", "bottom_gap_m": "bottom_gap_m", "association_distance_m": "association_distance_m", "completeness_ratio": "completeness_ratio"}
    return d.select("record_name", F.col("image").alias("image_name"), "detection_id", F.col("e.detection_index").alias("detection_index"), F.col("e.class_id").alias("class_id"), F.col("e.confidence").alias("confidence"), *[F.col(f"e.pole.{v}").alias(k) for k, v in own.items()], state.alias("pole_occlusion_status"), "pose_row_number", "run_fingerprint")


def sink_frame_json(frames: DataFrame, path: str) -> None:
    """One document a frame (columns of DOCUMENT), a folder for each record; a rerun replaces
    the records it holds and no others."""
    frames.withColumn("record", F.col("record_name")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 1).partitionBy("record").json(path)


def sink_manifest(spark: SparkSession, path: str, document: dict) -> None:
    """Writes one JSON document as a whole or not at all: beside its place first, then renamed
    over it by the file system that the path names. Numbers that JSON lacks are an error."""
    text = json.dumps(document, ensure_ascii=False, indent=2, allow_nan=False) + "\n"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(staged, True)
    try:
        out.write(bytearray(text.encode()))
        out.close()
        replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(staged, target, replace)
    except Exception:
        fs.delete(staged, False)
        raise
