"""Exact substring dedup over a corpus with suffix arrays of shards.

1. Sketch: each text's starts of WIDTH-byte strings are split into runs by a content-chosen key
   (anchors.py). Equal strings have equal keys, so a key seen once clears all its starts.
2. Runs whose bytes are all equal to another run's are settled by their hashes: the key's and
   one of all their bytes, 128 bits together. Copies of whole texts have such runs alone.
3. Keys with several different runs, or with a run that may repeat itself, are open: one text piece of each different run goes to a
   shard, where induced sorting and permuted common prefixes (suffix.py) find repeated starts.
   A shard takes whole keys, about SHARD_BYTES at a time, so memory has a bound.
4. A key with over `hot_runs` different runs (a passage that very many documents share) or over
   GATHER_BYTES in them isn't gathered in a shard: the hashes of its single strings are counted
   instead, pre-aggregated.

Each start belongs to one run and each run to one shard, so every pair of equal strings meets.
A row is known by 96 bits of its id and text (e, f) until spans return to it; equal rows are
one there, cut once and given its spans each.

Nulls and empty texts have no bytes: nothing is removed. Texts under the width only lose
nothing. Repeated rows are copies of each other, even with equal ids. A null id is kept as null.
Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import runs
from .common import arrow_map, by_bytes, kept
from .suffix import repeated_windows

SHARD_BYTES = 2 << 20
HOT_RUNS = 4096
GATHER_BYTES = 8 << 20
#: p: start, starts in the run and whether it may repeat itself, packed (32, 31 and 1 bits).
_RUNS = "e long, f int, v long, c long, p long"
_PIECES = "e long, f int, v long, p long, piece binary"
_SPANS = "e long, f int, start int, stop int"


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _start(p: Column) -> Column:
    return F.shiftright(p, 32).cast("int")


def _starts(p: Column) -> Column:
    return F.shiftright(p, 1).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 2, 1 << 21):
                found = runs(part.column(2).to_pylist(), width)
                v, s, n, c, again = (np.concatenate(x) for x in zip(*found))
                own = pa.array(np.repeat(np.arange(len(part)), [len(f[0]) for f in found]))
                packed = s << 32 | n << 1 | again
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), _i64(v), _i64(c), pa.array(packed)], names=["e", "f", "v", "c", "p"])

    return run


def _pieces(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 2, 1 << 21):
                e, f, text, wanted = (part.column(i).to_pylist() for i in range(4))
                rows = []
                for i in range(len(part)):
                    for w in wanted[i]:
                        s = w["p"] >> 32
                        rows.append((e[i], f[i], w["v"], w["p"], text[i][s : s + (w["p"] >> 1 & 0x7FFFFFFF) + width - 1]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["e", "f", "v", "p", "piece"])

    return run


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[False, flags, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _shards(width: int):
    """Rows come sorted by key; a shard ends where a key ends."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for (e, f, _, p, _), flags in zip(rows, repeated_windows([r[4] for r in rows], width)):
            s = p >> 32
            for a, b in zip(*_spans(flags[: p >> 1 & 0x7FFFFFFF])):
                out.append((e, f, s + int(a), s + int(b) - 1 + width))
        cols = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["e", "f", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= SHARD_BYTES and row[2] != held[-1][2]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    return run


def _strings(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for e, f, _, p, piece in zip(*(batch.column(i).to_pylist() for i in range(5))):
                s, n = p >> 32, p >> 1 & 0x7FFFFFFF
                raw = b"".join(xxhash.xxh3_128_digest(piece[i : i + width]) for i in range(n))
                w = np.frombuffer(raw, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([e] * n, pa.int64()), pa.array([f] * n, pa.int32()), pa.array(np.arange(s, s + n, dtype=np.int32)), _i64(w[:, 0]), _i64(w[:, 1])], names=["e", "f", "s", "w1", "w2"])

    return run


def _merged(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["start"], min(x["stop"], size)) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, batch.schema.names.index("body"), 1 << 21):
                rest = part.select([n for n in part.schema.names if n not in ("body", "spans")])
                removed, found, digest, texts, sizes = [], [], [], [], []
                for text, spans in zip(*(part.column(n).to_pylist() for n in ("body", "spans"))):
                    gone = _merged(spans, len(text))
                    if gone:
                        ends = [0, *(x for ab in gone for x in ab), len(text)]
                        left = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))
                    else:
                        left = text
                    sizes.append(len(text))
                    removed.append(sum(b - a for a, b in gone))
                    found.append(len(gone))
                    digest.append(hashlib.sha256(left).hexdigest())
                    if keep_text:  # a cut inside a character leaves bytes that are no text
                        texts.append(left.decode("utf-8", "ignore"))
                extra = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(found, pa.int64()), pa.array(digest, pa.string())]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if keep_text:
                    extra, names = [*extra, pa.array(texts, pa.string())], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays([*rest.columns, *extra], names=[*rest.schema.names, *names])

    return run


def remove_repeats(docs: DataFrame, width: int = 200, hot_runs: int = HOT_RUNS, keep_text: bool = True, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Removes every byte that a width-byte string covers which also starts elsewhere.

    docs: text and the columns in carry, doc_id among them. Returns carry, n_bytes, n_removed,
    n_spans, kept_sha256, and kept_text if asked for."""
    text = F.coalesce(docs["text"], F.lit(""))
    e, f = F.xxhash64(F.lit(7), docs["doc_id"], text), F.hash(F.lit(11), text, docs["doc_id"])
    own = docs.select(*[docs[c] for c in carry], text.cast("binary").alias("body"), e.alias("e"), f.alias("f"))
    sketch = kept(arrow_map(own.filter(F.length("body") >= width).select("e", "f", "body"), _sketch(width), _RUNS), "runs")

    itself = F.max(F.col("p").bitwiseAND(F.lit(1))).alias("itself")
    repeated = sketch.groupBy("v").agg(F.count("*").alias("count"), itself).filter("count > 1 or itself = 1").select("v")
    again = kept(sketch.join(repeated, "v"), "repeated")
    # one run of each class of equal ones, and whether there are more
    classes = kept(again.groupBy("v", "c").agg(F.first(F.struct("e", "f", "p")).alias("one"), (F.count("*") > 1).alias("settled"), itself).select("v", "c", "one.*", "settled", "itself"), "classes")
    several = classes.groupBy("v").agg(F.count("*").alias("different"), F.max("itself").alias("self"), F.sum(_starts(F.col("p")) + width).alias("size")).filter("different > 1 or self = 1").drop("self")
    settled = again.join(classes.filter("settled").select("v", "c"), ["v", "c"]).select("e", "f", _start(F.col("p")).alias("start"), (_start(F.col("p")) + _starts(F.col("p")) + (width - 1)).alias("stop"))
    open_ = classes.join(several, "v").withColumn("hot", (F.col("different") > hot_runs) | (F.col("size") > GATHER_BYTES))
    once = own.filter(F.length("body") >= width).select("e", "f", "body").dropDuplicates(["e", "f"])

    def wanted(which: DataFrame) -> DataFrame:
        per_doc = which.groupBy("e", "f").agg(F.collect_list(F.struct("v", "p")).alias("wanted"))
        return arrow_map(once.join(per_doc, ["e", "f"]).select("e", "f", "body", "wanted"), _pieces(width), _PIECES)

    found = arrow_map(wanted(open_.filter("NOT hot")).repartition("v").sortWithinPartitions("v"), _shards(width), _SPANS)
    strings = arrow_map(wanted(open_.filter("hot")), _strings(width), "e long, f int, s int, w1 long, w2 long")
    twice = strings.groupBy("w1", "w2").count().filter("count > 1").select("w1", "w2")
    hot = strings.join(twice, ["w1", "w2"]).select("e", "f", F.col("s").alias("start"), (F.col("s") + width).alias("stop"))

    spans = settled.unionByName(found).unionByName(hot).groupBy("e", "f").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    out = own.join(spans, ["e", "f"], "left").select(*carry, "body", "spans")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema]
    schema = ", ".join([*kinds, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *["kept_text string"] * keep_text])
    return arrow_map(out, _cut(keep_text), schema)
