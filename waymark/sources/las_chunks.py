"""LAS files by chunks: a partition reads its points' byte range and nothing else of the file.

Files of any size split; what pyarrow's file systems open (local, S3, GCS, HDFS by libhdfs) can
be read. Partitions are planned from headers (HEAD bytes of each file). Filters on x, y and z
leave out files whose header's bounds can't match and points before they reach the JVM; Spark
tests what comes again. Columns that the schema doesn't name aren't decoded into rows.

A file without points has no partition, a truncated one has the points that are whole; what isn't
a LAS file fails the plan by name. Bounds that aren't finite or in order prune nothing."""

from __future__ import annotations

import fnmatch
import posixpath
import struct
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from waymark.sources.pointclouds import CHUNK, POINTS, Las

HEAD = 375
#: Points a partition, unless the option `points` says otherwise: 40 to 130 MB.
PARTITION_POINTS = 2_000_000
AXES = "xyz"


@dataclass
class Chunk(InputPartition):
    path: str
    size: int
    start: int
    count: int


def opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{posixpath.abspath(root)}")


def listed(root: str, pattern: str) -> list[tuple[str, int]]:
    """Paths and sizes of matching files, in order; names match whatever their case."""
    store, at = opened(root)
    info = store.get_file_info(at)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and fnmatch.fnmatch(f.base_name.lower(), pattern.lower()))


class LasReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names = schema.names
        self.root, self.pattern = options["path"], options.get("pattern", "*.las")
        self.points = int(options.get("points", PARTITION_POINTS))
        self.bounds = {a: (-np.inf, np.inf) for a in AXES}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in self.bounds:
                low, high = self.bounds[f.attribute[0]]
                above = isinstance(f, (GreaterThan, GreaterThanOrEqual))
                self.bounds[f.attribute[0]] = (max(low, float(f.value)), high) if above else (low, min(high, float(f.value)))
            yield f  # Spark tests all of them again

    def head(self, file: tuple[str, int]) -> Las:
        path, size = file
        store, _ = opened(self.root)
        with store.open_input_file(path) as f:
            try:
                return Las(f.read(HEAD).ljust(HEAD, b"\0"), size)
            except (ValueError, struct.error, IndexError) as e:
                raise ValueError(f"{path}: {e}") from e

    def may_match(self, las: Las) -> bool:
        if not (np.isfinite([las.low, las.high]).all() and (las.low <= las.high).all()):
            return True
        # a coordinate may be stored half a scale unit off its bound
        return all(lo - s <= self.bounds[a][1] and hi + s >= self.bounds[a][0] for a, lo, hi, s in zip(AXES, las.low, las.high, las.scale))

    def partitions(self) -> list[Chunk]:
        files = listed(self.root, self.pattern)
        with ThreadPoolExecutor(32) as pool:
            heads = list(pool.map(self.head, files))
        return [Chunk(path, size, start, min(self.points, las.count - start)) for (path, size), las in zip(files, heads) if self.may_match(las) for start in range(0, las.count, self.points)]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing matches
            return
        las = self.head((partition.path, partition.size))
        store, _ = opened(self.root)
        with store.open_input_file(partition.path) as f:
            at, stop = partition.start, partition.start + partition.count
            while at < stop:
                # batches end where the index's chunks do
                n = min(CHUNK - at % CHUNK, stop - at)
                f.seek(las.at + at * las.size)
                raw = np.frombuffer(f.read(n * las.size), las.dtype())
                yield self.batch(partition.path, las, at, raw)
                at += n

    def batch(self, path: str, las: Las, at: int, raw: np.ndarray) -> pa.RecordBatch:
        p = las.decode(raw)
        keep = np.ones(len(raw), bool)
        for i, a in enumerate(AXES):
            low, high = self.bounds[a]
            if (low, high) != (-np.inf, np.inf):
                keep &= (p["xyz"][:, i] >= low) & (p["xyz"][:, i] <= high)
        first = at // CHUNK * CHUNK
        whole = f"las:{first}:{min(CHUNK, las.count - first)}"
        made = {
            "path": lambda: pa.array([path] * int(keep.sum()), pa.string()), "block": lambda: pa.array([whole] * int(keep.sum()), pa.string()), "source_index": lambda: pa.array(np.arange(at, at + len(raw))[keep]),
            **{a: lambda i=i: pa.array(p["xyz"][keep, i]) for i, a in enumerate(AXES)}, **{c: lambda i=i: pa.array(p["rgb"][keep, i].astype(np.int32)) for i, c in enumerate(("red", "green", "blue"))},
            "gps_time": lambda: pa.array(p["gps_time"][keep]), **{c: lambda c=c: pa.array(p[c][keep].astype(np.int32)) for c in ("intensity", "classification", "return_number", "number_of_returns")},
        }
        return pa.RecordBatch.from_arrays([made[n]() for n in self.names], names=self.names)


class LasChunks(DataSource):
    """spark.read.format("las_chunks").option("path", root); options: pattern, points."""

    @classmethod
    def name(cls) -> str:
        return "las_chunks"

    def schema(self) -> str:
        return POINTS

    def reader(self, schema: StructType) -> LasReader:
        return LasReader(schema, self.options)


def read_chunks(spark: SparkSession, root: str, columns: tuple[str, ...] | None = None, pattern: str = "*.las", points: int = PARTITION_POINTS) -> DataFrame:
    """Points of the files under root, with the named columns alone; where() on x, y and z prunes."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasChunks)
    kinds = dict(c.split() for c in POINTS.split(", "))
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    return spark.read.format("las_chunks").schema(schema).option("pattern", pattern).option("points", points).load(root)


def index(spark: SparkSession, root: str, pattern: str = "*.las") -> DataFrame:
    """Chunks of CHUNK points with their bounds: the index of a catalog, from places alone."""
    p = read_chunks(spark, root, ("path", "block", *AXES, "source_index"), pattern)
    ends = [f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES]
    return p.groupBy("path", "block").agg(F.min("source_index").alias("start"), F.count("*").alias("n"), *ends)
