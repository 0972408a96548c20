from __future__ import annotations

import hashlib
import math
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline as P
from waymark.llm import common, decontaminate, queries, simhash_dedup, substring_dedup, toxicity

DATA = "/root/testdata/sf0.001"


def firsts(texts: dict) -> set:
    """The least id of each chain of fingerprints at 4 or fewer bits, compared one by one."""
    prints = {}
    for i, t in texts.items():
        words = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        n = min(4, len(words))
        grams = [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    label = {i: i for i in prints}
    for _ in prints:
        new = {i: min(label[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
        if new == label:
            break
        label = new
    return set(label.values())


def covered(text: str, items: list) -> bool:
    """Whether occurrences of 13-word windows (whole items, where shorter) hold a twentieth of the words."""
    split = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    words, hit = split(text), set()
    for item in map(split, items):
        n = min(13, len(item))
        windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if item else set()
        hit |= {j for k in range(len(words) - n + 1) if n and tuple(words[k : k + n]) in windows for j in range(k, k + n)}
    return bool(hit) and 20 * len(hit) >= len(words)


def poisson_counts(rows) -> Counter:
    size = Counter()
    for r in rows:
        size[r.source] += len((r.text or "").encode())
    filled = [s for s in size if size[s]]
    out = Counter()
    for r in rows:
        rate = sum(size.values()) / len(filled) / size[r.source] if size[r.source] else 1.0
        u = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        n, below = 0, math.exp(-rate)
        while below <= u:
            n += 1
            below += math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))
        out[r.doc_id] += n
    return +out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = P.kept(stage(spark, docs, DATA), name)
        after = out.collect()
        assert {r.doc_id for r in after} <= set(before)
        if name != "source_mixing":
            assert out.columns == columns and len(after) == len({r.doc_id for r in after})
        if name == "toxicity":
            scored = queries.op3_toxicity(spark, DATA).collect()
            assert {r.doc_id for r in after} == {r.doc_id for r in scored if not r.predicted}
        if name == "suffix_array_dedup":
            width, seen = 200, {}
            for r in before.values():
                t = (r.text or "").encode()
                for i in range(len(t) - width + 1):
                    seen[t[i : i + width]] = seen.get(t[i : i + width], 0) + 1
            for r in after:
                old = before[r.doc_id].text.encode()
                clean = all(seen[old[i : i + width]] == 1 for i in range(len(old) - width + 1))
                assert (r.text.encode() == old) == clean
        if name == "simhash_near_dedup":
            assert {r.doc_id for r in after} == firsts({i: r.text for i, r in before.items()})
        if name == "benchmark_decontamination":
            items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert {r.doc_id for r in after} == {i for i, r in before.items() if not covered(r.text, items)} != set()
        if name == "source_mixing":
            assert Counter(r.doc_id for r in after) == poisson_counts(before.values())
        docs = out
    assert P.ORACLE_SQL is None and len(P.STAGES) == 5


def test_nulls_and_repeats(spark, tmp_path):
    rows = [(1, "one two three four five", "en", "a", 3), (1, "one two three four five", "en", "a", 3), (1, "quite another text of this id", "en", "a", 3), (None, None, None, None, None), (None, "x y z w q r", None, "b", None), (2, "", "en", None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for data, least in ((rows, 2), ([], 0)):
        docs = spark.createDataFrame(data, schema)
        for name, stage in P.STAGES[:-1]:
            docs = P.kept(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert docs.count() >= least and docs.filter("doc_id = 1").count() == min(2, len(data))  # different texts of one id both stay
        P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()


BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def test_workers_take_small_batches(spark):
    """Of each stage with Python on texts, however many rows of a table are alike in size."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat(cast(id % 10 AS string), 6000) AS text")
    spark.conf.unset(BOUND)
    found = common.arrow_map(docs, sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 3000 and max(r.size for r in found) < common.BATCH_BYTES + 20_000
    for made in (lambda: toxicity.score(docs, None), lambda: simhash_dedup.fingerprints(docs), lambda: substring_dedup.remove_repeats(docs), lambda: decontaminate.scan(docs, None)):
        spark.conf.unset(BOUND)
        made()
        assert spark.conf.get(BOUND) == f"{common.BATCH_BYTES}b"
    for own, stays in (("64k", True), ("2m", True), ("64m", False), ("4097k", False)):
        spark.conf.set(BOUND, own)
        common.arrow_map(docs, sizes, "n long, size long")
        assert (spark.conf.get(BOUND) != f"{common.BATCH_BYTES}b") == stays
    spark.conf.unset(BOUND)


@pytest.mark.skipif(not os.path.exists("/proc/self/statm"), reason="memory is read from /proc")
def test_workers_give_memory_back(spark):
    """A task that frees 150 MB below what it keeps leaves its worker about as small as it was."""

    def task(held):
        def run(batches):
            for _ in batches:
                before = resident()
                arrays = [np.ones(100_000, np.uint8) for _ in range(1500)]
                held.append(np.ones(100_000, np.uint8))  # keeps the heap's end in place
                del arrays
                yield pa.RecordBatch.from_arrays([pa.array([before]), pa.array([resident()])], names=["before", "after"])

        return run

    held: list = []
    before = resident()
    for _ in task(held)([None]):
        pass
    assert resident() - before > 100e6  # kept by the allocator
    common.give_back()
    assert resident() - before < 50e6
