"""SimHash near-dedup with Golay-code keys.

A fingerprint is the bitwise majority of the XXH64 of a text's word shingles. Two fingerprints
link at MAX_BITS = 4 or fewer differing bits. Candidates come from the perfect binary Golay code
[23, 12, 7]: the fingerprint is cut into segments of 22, 21 and 21 bits. Within a segment, two
values that differ in one or two bits always lie within distance 4 of a common codeword (their
midpoint's), and a value has one or six codewords that near. By the pigeonhole principle four
errors leave either
  - one segment without error and another with at most two: the key is the first segment itself
    with a codeword of the second; or
  - two segments with just one error each: the key is a codeword of each. One error changes the
    parity, so even values give their nearest codeword alone and odd ones all of theirs.
So every linked pair shares a key. Fingerprints of a key are compared with each other and leave
a local spanning structure, never all pairs; keys with over HOT fingerprints are compared in
pairs of blocks by several tasks. Equal fingerprints are one node from the start.

Null and empty texts have no words and fingerprint zero, which links like any other. Texts of
fewer words than a shingle are one shingle. Repeated rows get a row each. Null ids are kept and
never name a component unless all its ids are null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.components import components

from .common import arrow_map, by_bytes, kept

SHINGLE, SEED, MAX_BITS = 4, 42, 4
HOT = 1 << 16
_BATCH = 1 << 18
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and size
_GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(_UPPER).split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        part = hashes[lo : lo + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome of each byte at each place of a 23-bit value, error patterns of weight up to 4
    by syndrome, how many each has)."""
    def syndrome(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= _GENERATOR << (i - 11)
        return x

    single = [syndrome(1 << i) for i in range(23)]
    table = np.zeros((3, 256), np.int64)
    for place in range(3):
        for byte in range(256):
            for bit in range(8):
                if byte >> bit & 1 and 8 * place + bit < 23:
                    table[place, byte] ^= single[8 * place + bit]
    patterns = np.zeros((2048, 6), np.int64)
    sizes = np.zeros(2048, np.int64)
    for weight in range(5):
        for places in combinations(range(23), weight):
            s = 0
            for i in places:
                s ^= single[i]
            patterns[s, sizes[s]] = sum(1 << i for i in places)
            sizes[s] += 1
    return table, patterns, sizes


def codewords(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the codewords within distance 4, nearest first: n x 6; how many)."""
    table, patterns, sizes = _golay()
    s = table[0, values & 255] ^ table[1, values >> 8 & 255] ^ table[2, values >> 16 & 255]
    return (values[:, None] ^ patterns[s]) >> 11, sizes[s]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place of its fingerprint) for uint64 fingerprints."""
    value = [(prints >> np.uint64(a)).astype(np.int64) & ((1 << n) - 1) for a, n in SEGMENTS]
    near = [codewords(v) for v in value]
    odd = [np.bitwise_count(v) & 1 == 1 for v in value]
    rows = np.arange(len(prints))
    out_key, out_row = [], []
    tag = 0
    for s in range(3):
        for t in range(3):
            if s != t:
                for j in range(6):
                    use = near[t][1] > j
                    out_key.append((tag << 36) | (value[s][use] << 12) | near[t][0][use, j])
                    out_row.append(rows[use])
                tag += 1
    for s, t in combinations(range(3), 2):
        for i in range(6):
            for j in range(6):
                use = (near[s][1] > i) & (near[t][1] > j) & (odd[s] | (i == 0)) & (odd[t] | (j == 0))
                out_key.append((tag << 36) | (near[s][0][use, i] << 12) | near[t][0][use, j])
                out_row.append(rows[use])
        tag += 1
    return np.concatenate(out_key), np.concatenate(out_row)


def _print_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, batch.num_columns - 1, 1 << 22):
                found = [fingerprint(t, shingle) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.array(found, np.uint64).view(np.int64))], names=[*part.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """carry and fp, the fingerprint as a signed long."""
    rows = docs.select(*[docs[c] for c in carry], F.coalesce(docs["text"], F.lit("")).cast("binary").alias("__body"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1])
    return arrow_map(rows, _print_batches(shingle), kinds + "fp long")


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        for lo in range(0, len(prints), 4096):
            key, row = keys(prints[lo : lo + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[lo : lo + 4096][row].view(np.int64))], names=["k", "fp"])


def local_roots(key: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key: (fingerprint, another of its component among its key's rows)."""
    label = np.arange(len(key))
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    left = np.repeat(np.r_[edge[1:], len(key)], np.diff(np.r_[edge, len(key)])) - np.arange(len(key)) - 1
    step, rows = 1, np.flatnonzero(left >= 1)
    while len(rows):
        near = np.bitwise_count(prints[rows] ^ prints[rows + step]) <= bits
        a, b = rows[near], rows[near] + step
        while len(a):
            x, y = label[a], label[b]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            open_ = lo != hi
            if not open_.any():
                break
            np.minimum.at(label, hi[open_], lo[open_])
            while (label[label] != label).any():
                label = label[label]
        step += 1
        rows = rows[left[rows] >= step]
    moved = np.flatnonzero(label != np.arange(len(key)))
    return prints[moved], prints[label[moved]]


def _compare(bits: int, hot: int):
    """Rows (key, fingerprint) sorted by key. Gives links (a, b), and with key not null the rows
    of keys that are too large for one task."""

    def links(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        a, b = local_roots(key, prints, bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64())], names=["a", "b", "k"])

    def later(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        own = pa.array(prints.view(np.int64))
        return pa.RecordBatch.from_arrays([own, own, pa.array(key)], names=["a", "b", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_, prints, given_up = [], [], None
        size = 0
        for batch in batches:
            k, p = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            keys_.append(k)
            prints.append(p)
            size += len(k)
            if size < _BATCH:
                continue
            k, p = np.concatenate(keys_), np.concatenate(prints)
            if given_up is not None:
                n = int(np.searchsorted(k, given_up, side="right"))
                if n:
                    yield later(k[:n], p[:n])
                if n < len(k):
                    given_up = None
                k, p = k[n:], p[n:]
            if len(k):
                tail = int(np.searchsorted(k, k[-1]))
                if tail:
                    yield from split(k[:tail], p[:tail])
                k, p = k[tail:], p[tail:]
                if len(k) > hot:
                    given_up = k[0]
                    yield later(k, p)
                    k, p = k[:0], p[:0]
            keys_, prints, size = [k], [p], len(k)
        k, p = (np.concatenate(keys_), np.concatenate(prints)) if keys_ else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        if given_up is not None:
            n = int(np.searchsorted(k, given_up, side="right"))
            if n:
                yield later(k[:n], p[:n])
            k, p = k[n:], p[n:]
        if len(k):
            yield from split(k, p)

    def split(k: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sizes = np.diff(np.r_[edge, len(k)])
        big = np.repeat(sizes > hot, sizes)
        if big.any():
            yield later(k[big], p[big])
        yield links(k[~big], p[~big])

    return run


def near_prints(prints: DataFrame, bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """prints: distinct fp. Returns links a, b that join just the fingerprints which chains of
    pairs at `bits` (at most MAX_BITS) or fewer differing bits join."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the keys cover up to {MAX_BITS} differing bits")
    schema = "a long, b long, k long"
    rows = arrow_map(prints.select("fp"), _emit_keys, "k long, fp long").repartition("k").sortWithinPartitions("k")
    first = kept(arrow_map(rows, _compare(bits, hot), schema), "links")
    late = first.filter("k IS NOT NULL").select("k", F.col("a").alias("fp"))
    blocks = late.groupBy("k").agg(F.ceil(F.count("*") / (hot / 2)).alias("blocks"))
    late = late.join(blocks, "k").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    late = late.select(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("k"), "fp").repartition("k").sortWithinPartitions("k")
    # a pair of blocks has about `hot` rows and goes whole
    second = arrow_map(late, _compare(bits, 1 << 62), schema)
    return first.filter("k IS NULL").unionByName(second).select("a", "b").distinct()


def label(prints: DataFrame, bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """prints: doc_id and fp. Returns fp, component_id and root (the component's least
    fingerprint) for every distinct fingerprint."""
    nodes = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(near_prints(nodes.select("fp"), bits, hot))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "component_id", "root")


def dedup(docs: DataFrame, bits: int = MAX_BITS, hot: int = HOT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits) and component_id of every row."""
    own = kept(fingerprints(docs, ("doc_id",), shingle), "fingerprints")
    return own.join(label(own, bits, hot), "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
