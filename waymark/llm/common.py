"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir or, only where that is unset in local
    mode (tests), a temporary folder. On a cluster it must be set: executors don't share others."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset; on a cluster it must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="waymark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, so that later stages
    neither repeat the work nor depend on the executors that did it."""
    path = f"{shared_dir(df.sparkSession)}/waymark-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: list[str] = []

#: Bytes of an Arrow batch, about; a larger row goes alone.
BATCH_BYTES = 4 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of about BATCH_BYTES, whose workers give back what
    they have freed. An executor holds each batch outside its heap, and its workers stay between
    stages. The session keeps the bound, as plans are made when results are written; one that is
    smaller already stays."""
    conf = df.sparkSession.conf
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", conf.get(_BOUND).lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        conf.set(_BOUND, f"{BATCH_BYTES}b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Returns freed memory of this process to the system, which allocators else keep."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def sweep(spark: SparkSession) -> int:
    """Deletes what `kept` has written in this process; results that read it must have been
    written or collected before. Returns how many folders went."""
    found, _KEPT[:] = list(_KEPT), []
    for path in found:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(found)


def columns_as(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone; extra columns of the input, whatever their names, go."""
    return df.select(*[df[n] for n in names])


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def thin(rows: DataFrame, group: str, order: Column, count: int) -> DataFrame:
    """About 4 * count rows of each group (all, where there are fewer), by a hash threshold set
    from the pre-aggregated counts. Rows of a group must differ in `order`, as equal ones would
    stay or go together. Whatever the input's size, no more than that is left to rank, so the
    exact choice of `count` rows moves little."""
    sizes = rows.groupBy(group).count().filter(F.col(group).isNotNull()).collect()
    parts = 1 << 40
    least = [(r[0], min(parts, parts * 4 * count // r[1] + 1)) for r in sizes]
    kind = rows.schema[group].dataType.simpleString()
    bounds = rows.sparkSession.createDataFrame(least, f"`{group}` {kind}, __least long")  # a row a group
    return rows.join(F.broadcast(bounds), group).filter(F.pmod(order, F.lit(parts)) < F.col("__least")).drop("__least")


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of a text or binary column; a longer text goes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
