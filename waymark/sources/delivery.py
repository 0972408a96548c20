"""Finding and naming the files of a delivery: point clouds, their identity, headers and
reference systems."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRACK = r"(?i)^Track[_-]?\d+$"
HEADERS = "path string, version string, point_format int, record_bytes int, points long, scale array<double>, offset array<double>, low array<double>, high array<double>"


def discover_points(spark: SparkSession, root: str, pattern: str = "*.{las,LAS,pcdb,PCDB}") -> DataFrame:
    """path, size and kind of every point cloud; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("size"), F.lower(F.substring_index("path", ".", -1)).alias("kind")).orderBy(F.lower("path"), "path")


def las_identity(path: Column, job: str = r"(?i)^(.+)_(Track[_-]?\d+)(?:_(\d+))?$", delivery: str = r"^(.*?)[_-](\d+)$") -> Column:
    """job, track, split and base: from the file's name, else from the nearest track folder."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    at = F.array_max(F.transform(folders, lambda x, i: F.when(x.rlike(TRACK), i)))
    track = F.when(at.isNotNull(), F.element_at(folders, at + 1))
    above = F.when(at >= 1, F.element_at(folders, F.greatest(at, F.lit(1))))
    named, dealt = stem.rlike(job), stem.rlike(delivery) & at.isNotNull()
    number = lambda p, g: F.nullif(F.regexp_extract(stem, p, g), F.lit("")).try_cast("int")
    return F.struct(
        F.when(named, F.regexp_extract(stem, job, 1)).when(dealt, above).alias("job_name"), F.when(named, F.regexp_extract(stem, job, 2)).otherwise(track).alias("track_name"), F.when(named, number(job, 3)).when(dealt, number(delivery, 2)).alias("split_index"),
        F.when(named, F.concat_ws("_", F.regexp_extract(stem, job, 1), F.regexp_extract(stem, job, 2))).when(dealt, F.regexp_extract(stem, delivery, 1)).otherwise(stem).alias("base"),
    )


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if data[:4] == b"LASF" and len(data) >= 227:
                minor, v = data[25], struct.unpack_from("<12d", data, 131)
                count = struct.unpack_from("<Q", data, 247)[0] if minor >= 4 and len(data) >= 255 else struct.unpack_from("<I", data, 107)[0]
                rows.append((path, f"{data[24]}.{minor}", data[104] & 63, struct.unpack_from("<H", data, 105)[0], count, list(v[:3]), list(v[3:6]), [v[7], v[9], v[11]], [v[6], v[8], v[10]]))
        cols = list(zip(*rows)) or [()] * 9
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.float64())] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in HEADERS.split(", ")])


def scan_headers(spark: SparkSession, root: str) -> DataFrame:
    """Headers of LAS files; only their first 375 bytes leave the reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{las,LAS}").load(root)
    return files.select("path", F.substring("content", 1, 375).alias("head")).mapInArrow(_headers, HEADERS)


def crs_sidecars(points: DataFrame, sidecars: DataFrame, root: str) -> DataFrame:
    """points: path; sidecars: path and text of the .prj files. For each point cloud the text of
    the nearest folder up to root that has any, if that folder's texts agree; else null."""
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    text = F.regexp_replace("text", "^\ufeff|\u0000|^\\s+|\\s+$", "")
    known = sidecars.groupBy(folder(F.col("path")).alias("folder")).agg(F.collect_set(F.nullif(text, F.lit(""))).alias("texts"))
    parts = F.split(folder(F.col("path")), "/")
    top = len(root.rstrip("/").split("/"))
    above = F.transform(F.sequence(F.lit(top), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    climbed = points.select("path", F.posexplode(above).alias("depth", "folder")).join(known, "folder")
    best = climbed.groupBy("path").agg(F.max_by("texts", "depth").alias("texts"))
    return points.select("path").join(best, "path", "left").select("path", F.when(F.size("texts") == 1, F.col("texts")[0]).alias("crs"))


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.prj").text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def first_discovery(files: DataFrame, key: Column, order: tuple[str, ...]) -> DataFrame:
    """One file of each key, the first in order."""
    w = W.partitionBy(key).orderBy(*order)
    return files.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
