"""Incremental views over a growing folder of results, and stateful upload checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "image_name string, record_name string, run_fingerprint string, accepted boolean, ts timestamp"


def results(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """New result documents as they come; per_trigger holds the pace."""
    return spark.readStream.schema(RESULT).option("maxFilesPerTrigger", per_trigger).json(path)


def counters(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Accepted and all results of each record by minute; a minute closes when late has passed."""
    windowed = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "record_name")
    return windowed.agg(F.count("*").alias("seen"), F.sum(F.col("accepted").cast("long")).alias("accepted"))


def unseen(stream: DataFrame, done: DataFrame) -> DataFrame:
    """Skips documents that a finished run has already."""
    return stream.join(done.select("image_name", "run_fingerprint").distinct(), ["image_name", "run_fingerprint"], "left_anti")


def interim_layers(results_dir: str, layers_dir: str, build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps each epoch's results in a folder of its own and builds the interim
    layers anew from all of them into the epoch's layer folder. An epoch that comes again (a
    restart replays the last one) overwrites just what it wrote before, so nothing counts twice.
    An epoch without rows leaves the layers of the one before in place."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{results_dir}/epoch={epoch}")
        known = spark.read.option("basePath", results_dir).schema(batch.schema.add("epoch", "long")).parquet(results_dir)
        known = known.filter(F.col("epoch") <= epoch).drop("epoch")
        if not known.isEmpty():
            build(known).write.mode("overwrite").parquet(f"{layers_dir}/epoch={epoch}")

    return run


def newest_layers(spark: SparkSession, layers_dir: str) -> DataFrame:
    """The layers of the last epoch that was built whole (a write in progress has no _SUCCESS)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(layers_dir)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = [s.getPath().getParent().toString() for s in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{layers_dir}/epoch=*/_SUCCESS")) or []]
    if not whole:
        raise FileNotFoundError(f"no layers in {layers_dir}")
    return spark.read.parquet(max(whole, key=lambda p: int(p.rsplit("=", 1)[1])))


def refresh_layers(stream: DataFrame, recompute: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls recompute(batch, epoch) for each batch, such as `interim_layers`."""
    return stream.writeStream.foreachBatch(recompute).option("checkpointLocation", checkpoint)


UPLOAD = "file string, at long, size long, accepted boolean, offset long"


def _uploads(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    offset = state.get[0] if state.exists else 0
    rows = []
    # a trigger's chunks come in several Arrow batches; their order is that of the whole trigger
    for at, size in sorted((int(r.at), int(r.size)) for pdf in pdfs for r in pdf.itertuples(index=False)):
        good = at == offset  # compare and set
        offset += size if good else 0
        rows.append((key[0], at, size, good, offset))
    state.update((offset,))
    yield pd.DataFrame(rows, columns=["file", "at", "size", "accepted", "offset"])


def chunk_upload(chunks: DataFrame) -> DataFrame:
    """chunks: file, at, size. Each file's state is its offset; a chunk elsewhere is refused.
    Chunks of one trigger count in the order of their places, however they arrive."""
    return chunks.groupBy("file").applyInPandasWithState(_uploads, UPLOAD, "offset long", "append", GroupStateTimeout.NoTimeout)


#: Which state of a job may follow which.
MOVES = {
    "pending": ("validating", "failed", "cancelled"),
    "validating": ("running", "failed", "cancelled"),
    "running": ("succeeded", "failed", "cancelled"),
    "failed": ("retrying",),
    "retrying": ("running", "failed", "cancelled"),
    "succeeded": (),
    "cancelled": (),
}
TERMINAL = ("succeeded", "cancelled")


def _rows(pdfs: Iterator[pd.DataFrame], order: str) -> list:
    found = [r for pdf in pdfs for r in pdf.itertuples(index=False)]
    return sorted(found, key=lambda r: getattr(r, order))


def _moves(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, out = state.get[0] if state.exists else "pending", []
    for r in _rows(pdfs, "seq"):
        good = r.target == now or r.target in MOVES.get(now, ())
        now = r.target if good else now
        out.append((key[0], int(r.seq), r.target, good, now))
    state.update((now,))
    yield pd.DataFrame(out, columns=["job", "seq", "target", "accepted", "state"])


def state_machine(requests: DataFrame) -> DataFrame:
    """requests: job, seq, target. Each job starts pending; moves that aren't allowed are refused."""
    return requests.groupBy("job").applyInPandasWithState(_moves, "job string, seq long, target string, accepted boolean, state string", "state string", "append", GroupStateTimeout.NoTimeout)


def _changes(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, out = state.get if state.exists else (None, None), []
    for r in _rows(pdfs, "seq"):
        if last[0] in TERMINAL or (r.status, r.done) == tuple(last):
            continue
        last = (r.status, int(r.done))
        out.append((key[0], int(r.seq), *last))
    if last[0] is not None:
        state.update(tuple(last))
    yield pd.DataFrame(out, columns=["run_id", "seq", "status", "done"])


def run_events(snapshots: DataFrame) -> DataFrame:
    """snapshots: run_id, seq, status, done. Only changes are passed on, up to a terminal state."""
    return snapshots.groupBy("run_id").applyInPandasWithState(_changes, "run_id string, seq long, status string, done long", "status string, done long", "append", GroupStateTimeout.NoTimeout)


def _revisions(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, out = state.get[0] if state.exists else 0, []
    for r in _rows(pdfs, "seq"):
        good = int(r.expected) == now
        now += good
        out.append((key[0], int(r.seq), good, now))
    state.update((now,))
    yield pd.DataFrame(out, columns=["layer", "seq", "accepted", "revision"])


def overlay_revisions(edits: DataFrame) -> DataFrame:
    """edits: layer, seq, expected. An edit counts if it was made on the newest revision; the
    rows are the audit trail."""
    return edits.groupBy("layer").applyInPandasWithState(_revisions, "layer string, seq long, accepted boolean, revision long", "revision long", "append", GroupStateTimeout.NoTimeout)


TTL_S, MOST, BUCKETS = 30, 1024, 16


def _remember(ttl_s: int, most: int):
    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get)) if state.exists else {}
        # a map's order is that of the last failures, oldest first
        out = []

        def forget(now: float) -> None:
            for address in [a for a, at in known.items() if at + ttl_s <= now]:
                del known[address]
                out.append((address, "expired"))

        if state.hasTimedOut:
            forget(state.getCurrentWatermarkMs() / 1000)
        else:
            for r in _rows(pdfs, "ts"):
                at = r.ts.timestamp()
                forget(at)
                if known.pop(r.address, None) is None:
                    out.append((r.address, "failed"))
                known[r.address] = at
                if len(known) > most:
                    oldest = next(iter(known))
                    del known[oldest]
                    out.append((oldest, "evicted"))
        if known:
            state.update((list(known), list(known.values())))
            state.setTimeoutTimestamp(max(int((min(known.values()) + ttl_s) * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["address", "state"])

    return run


def ttl_cache(failures: DataFrame, ttl_s: int = TTL_S, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """failures: address, ts. An address is remembered for ttl_s seconds after its last failure.
    Addresses are dealt over buckets by hash, each of which remembers `most` at most: the one
    whose last failure is the oldest gives way. Returns address and state: failed (new),
    expired, evicted."""
    late = failures.withWatermark("ts", "0 seconds").withColumn("bucket", F.pmod(F.xxhash64("address"), F.lit(buckets)))
    return late.groupBy("bucket").applyInPandasWithState(_remember(ttl_s, most), "address string, state string", "addresses array<string>, at array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def heartbeat(stream: DataFrame, write, checkpoint: str, every: str = "10 seconds"):
    """Calls write(batch, id) once an interval at most: the throttled update of a manifest."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every)
