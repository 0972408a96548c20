"""Benchmark decontamination by a broadcast set of test n-grams.

Benchmark items are few: their windows of N words (an item of fewer words is one window) are
collected and broadcast, as long as the benchmark's bytes, counted first, are at most
MOST_BYTES. Words of a text become numbers of the benchmark's own vocabulary (0: not in it).
Only runs of N known words can hold a window; there a rolling hash is looked up in the set and
each hit is verified word by word.

A larger benchmark isn't broadcast: 128-bit digests of all its windows meet those of the
documents in a shuffled join (`scan_shuffled`), with the same result. Only windows whose bit is
set in a broadcast filter (MOST_BITS at most) go there.

Null texts have no words: such documents aren't hit and such items have no windows. Repeated
documents are judged alike; equal texts of several items all count. Null item ids are windows
but are not listed. Extra columns are ignored; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, by_bytes, kept

N = 13
#: About 40 bytes of memory a byte in the driver and each worker.
MOST_BYTES = 4 << 20

#: Word bytes lower-cased; all others become spaces. Words are digits, letters and non-ASCII.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Windows:
    def __init__(self, items: list[tuple[object, bytes]], n: int = N) -> None:
        self.n, self.vocabulary, self.known = n, {}, {}
        for item, text in items:
            words = words_of(text)
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                self.known.setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.by_size = {size: np.unique(self._hash(np.array([k for k in self.known if len(k) == size], np.uint64))) for size in sorted({len(k) for k in self.known})}

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(rows.shape[0], np.uint64)
        for j in range(rows.shape[1]):
            h = (h ^ rows[:, j]) * _MIX
            h ^= h >> np.uint64(29)
        return h

    def find(self, text: bytes) -> tuple[int, np.ndarray | None, set]:
        """(words, hit flags or None, items)."""
        words = words_of(text)
        ids = list(map(self.vocabulary.get, words))
        if ids.count(None) == len(ids):
            return len(words), None, set()
        codes = np.array([x or 0 for x in ids], np.uint64)
        # length of the run of known words that starts at each word
        gaps = np.flatnonzero(np.r_[codes, np.uint64(0)] == 0)
        room = gaps[np.searchsorted(gaps, np.arange(len(codes)))] - np.arange(len(codes))
        hit, items = None, set()
        for size, hashes in self.by_size.items():
            at = np.flatnonzero(room >= size)
            if not len(at):
                continue
            rows = codes[at[:, None] + np.arange(size)]
            place = np.searchsorted(hashes, h := self._hash(rows))
            place[place == len(hashes)] = 0
            for k in np.flatnonzero(hashes[place] == h).tolist():
                found = self.known.get(tuple(rows[k].tolist()))
                if found:
                    if hit is None:
                        hit = np.zeros(len(words), bool)
                    hit[at[k] : at[k] + size] = True
                    items |= found
        return len(words), hit, items


def bytes_of(benchmark: DataFrame) -> int:
    return benchmark.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def windows(benchmark: DataFrame, n: int = N, most: int = MOST_BYTES) -> Windows:
    """The benchmark's windows, in the driver; over `most` bytes of text are refused."""
    rows = benchmark.select(benchmark["item_id"], F.coalesce(benchmark["text"], F.lit("")).cast("binary").alias("body"))
    if (size := bytes_of(benchmark)) > most:
        raise ValueError(f"the benchmark has {size} bytes, too many to broadcast: use scan_shuffled")
    return Windows([(r[0], bytes(r[1])) for r in rows.collect()], n)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, most: int = MOST_BYTES, carry: tuple[str, ...] = ("doc_id",), keep_text: bool = False) -> DataFrame:
    """What `scan` returns, by the way that the benchmark's size allows."""
    if bytes_of(benchmark) <= most:
        return scan(docs, windows(benchmark, n, most), carry, keep_text)
    return scan_shuffled(docs, benchmark, n, carry, keep_text)


def is_contaminated(n_hit: int, n_words: int) -> bool:
    """A twentieth or more of the words."""
    return n_hit > 0 and 20 * n_hit >= n_words


_COLUMNS = (("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()))
_KINDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _judged(carried: pa.RecordBatch, texts: list[bytes], found: list[tuple[int, np.ndarray | None, set]], keep_text: bool) -> pa.RecordBatch:
    """carried with the columns that follow from (words, hit flags, items) of each text."""
    rows, clean = [], []
    for text, (n, hit, items) in zip(texts, found):
        n_hit = int(hit.sum()) if hit is not None else 0
        names = sorted(str(i) for i in items if i is not None)
        rows.append((n, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), is_contaminated(n_hit, n)))
        if keep_text:
            clean.append(_without(text, hit).decode() if n_hit else text.decode())
    cols = [pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [()] * 5, _COLUMNS)]
    names = [n for n, _ in _COLUMNS]
    if keep_text:
        cols, names = [*cols, pa.array(clean, pa.string())], [*names, "clean_text"]
    return pa.RecordBatch.from_arrays([*carried.columns, *cols], names=[*carried.schema.names, *names])


def _kinds(rows: DataFrame, carry: tuple[str, ...], keep_text: bool) -> str:
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(carry)]]
    return ", ".join([*own, _KINDS, *["clean_text string"] * keep_text])


def scan(docs: DataFrame, found: Windows, carry: tuple[str, ...] = ("doc_id",), keep_text: bool = False) -> DataFrame:
    """carry, n_words, n_hit, n_items, items_sha256, contaminated; with keep_text also
    clean_text, the text without the hit words (what separates words stays)."""
    shared = docs.sparkSession.sparkContext.broadcast(found)  # of a benchmark whose bytes were counted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in by_bytes(batch, batch.num_columns - 1, 1 << 22):
                texts = part.column(part.num_columns - 1).to_pylist()
                yield _judged(part.select(range(part.num_columns - 1)), texts, list(map(own.find, texts)), keep_text)

    rows = docs.select(*[docs[c] for c in carry], F.coalesce(docs["text"], F.lit("")).cast("binary").alias("__body"))
    return arrow_map(rows, run, _kinds(rows, carry, keep_text))


def _digests(words: list[bytes], size: int) -> np.ndarray:
    """128-bit digests, as pairs of longs, of all windows of `size` words."""
    raw = b"".join(xxhash.xxh3_128_digest(b" ".join(words[i : i + size])) for i in range(len(words) - size + 1))
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


#: Bits of the filter before the shuffle: ten a window, up to 128 MB.
MOST_BITS = 1 << 30


def _filter(wanted: DataFrame) -> np.ndarray:
    """A bit set of the windows' digests, made in tasks and merged by a tree: a digest without its
    bit is in no item, so only few windows of documents go through the shuffle."""
    count = max(1, wanted.count())
    bits = min(MOST_BITS, max(1 << 16, 1 << (10 * count - 1).bit_length()))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)
            np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=["bits"])

    def merge(a: bytes, b: bytes) -> bytes:
        both = np.frombuffer(zlib.decompress(a), np.uint8) | np.frombuffer(zlib.decompress(b), np.uint8)
        return zlib.compress(both.tobytes(), 1)

    parts = arrow_map(wanted.select("w1").coalesce(64), part, "bits binary").rdd.map(lambda r: bytes(r.bits))
    return np.frombuffer(zlib.decompress(parts.treeReduce(merge, 3)), np.uint8) if not wanted.isEmpty() else np.zeros(bits // 8, np.uint8)


def _may_be(bits: np.ndarray, w: np.ndarray) -> np.ndarray:
    at = w.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def scan_shuffled(docs: DataFrame, benchmark: DataFrame, n: int = N, carry: tuple[str, ...] = ("doc_id",), keep_text: bool = False) -> DataFrame:
    """What `scan` returns, for a benchmark of any size. Rows are known by 96 bits of their id
    and text until their hits come back."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, 1 << 20):
                for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = words_of(text)
                    if words:
                        size = min(n, len(words))
                        w = _digests(words, size)
                        yield pa.RecordBatch.from_arrays([pa.array([item] * len(w), pa.string()), pa.array(np.full(len(w), size, np.int32)), pa.array(w[:, 0]), pa.array(w[:, 1])], names=["item", "size", "w1", "w2"])

    wanted = benchmark.select(benchmark["item_id"].cast("string"), F.coalesce(benchmark["text"], F.lit("")).cast("binary").alias("body"))
    wanted = kept(arrow_map(wanted, items, "item string, size int, w1 long, w2 long").distinct(), "benchmark")
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())  # n at most
    shared = docs.sparkSession.sparkContext.broadcast(_filter(wanted))  # MOST_BITS at most

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 2, 1 << 20):
                for e, f, text in zip(*(part.column(k).to_pylist() for k in range(3))):
                    words = words_of(text)
                    for size in sizes:
                        if len(words) >= size:
                            w = _digests(words, size)
                            at = np.flatnonzero(_may_be(shared.value, np.ascontiguousarray(w[:, 0])))
                            w = w[at]
                            yield pa.RecordBatch.from_arrays([pa.array([e] * len(w), pa.int64()), pa.array([f] * len(w), pa.int32()), pa.array(at.astype(np.int32)), pa.array(np.full(len(w), size, np.int32)), pa.array(w[:, 0]), pa.array(w[:, 1])], names=["e", "f", "at", "size", "w1", "w2"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, len(carry), 1 << 22):
                texts, hits, names = (part.column(len(carry) + k).to_pylist() for k in range(3))
                found = []
                for text, spans, own in zip(texts, hits, names):
                    count = len(words_of(text))
                    hit = np.zeros(count, bool) if spans else None
                    for s in spans or ():
                        hit[s["at"] : s["at"] + s["size"]] = True
                    found.append((count, hit, set(own or ())))
                yield _judged(part.select(range(len(carry))), texts, found, keep_text)

    text = F.coalesce(docs["text"], F.lit(""))
    e, f = F.xxhash64(F.lit(3), docs["doc_id"], text), F.hash(F.lit(13), text, docs["doc_id"])
    own = docs.select(*[docs[c] for c in carry], text.cast("binary").alias("__body"), e.alias("__e"), f.alias("__f"))
    seen = arrow_map(own.select("__e", "__f", "__body"), places, "e long, f int, at int, size int, w1 long, w2 long")
    met = seen.join(wanted, ["size", "w1", "w2"]).groupBy("e", "f").agg(F.collect_set(F.struct("at", "size")).alias("__hits"), F.collect_set("item").alias("__items"))
    rows = own.join(met, (F.col("__e") == F.col("e")) & (F.col("__f") == F.col("f")), "left").select(*carry, "__body", "__hits", "__items")
    return arrow_map(rows, judge, _kinds(rows, carry, keep_text))


def _without(text: bytes, hit: np.ndarray) -> bytes:
    plain, at, out, last = text.translate(_TABLE), 0, [], 0
    for word, gone in zip(plain.split(), hit):
        at = plain.index(word, at)
        if gone:
            out.append(text[last:at])
            last = at + len(word)
        at += len(word)
    return b"".join([*out, text[last:]])
