from __future__ import annotations

import json
import os

import pytest

from waymark.streaming import progress


def test_uploads_and_counters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"file": "a", "at": 0, "size": 5}, {"file": "a", "at": 5, "size": 3}, {"file": "a", "at": 9, "size": 1}, {"file": "b", "at": 2, "size": 2}]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    chunks = spark.readStream.schema("file string, at long, size long").json(str(tmp_path / "in"))
    q = progress.chunk_upload(chunks).writeStream.format("memory").queryName("uploads").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.file, r.at, r.accepted, r.offset) for r in spark.table("uploads").collect()} == {("a", 0, True, 5), ("a", 5, True, 8), ("a", 9, False, 8), ("b", 2, False, 0)}


def test_unseen(spark, tmp_path):
    (tmp_path / "r").mkdir()
    docs = [{"image_name": f"i{k}", "record_name": "r", "run_fingerprint": "f", "accepted": k > 0, "ts": "2024-01-01T00:00:00Z"} for k in range(3)]
    (tmp_path / "r" / "1.json").write_text("\n".join(map(json.dumps, docs)))
    done = spark.createDataFrame([("i0", "f")], "image_name string, run_fingerprint string")
    q = progress.unseen(progress.results(spark, str(tmp_path / "r")), done).writeStream.format("memory").queryName("todo").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.image_name for r in spark.table("todo").collect()} == {"i1", "i2"}


def test_states(spark, tmp_path):
    def run(op, rows, schema, name):
        d = tmp_path / name
        d.mkdir()
        (d / "1.json").write_text("\n".join(map(json.dumps, rows)))
        q = op(spark.readStream.schema(schema).json(str(d))).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    moves = [("a", 1, "validating"), ("a", 2, "running"), ("a", 3, "pending"), ("a", 4, "succeeded"), ("a", 5, "running"), ("b", 1, "running")]
    got = run(progress.state_machine, [dict(zip(("job", "seq", "target"), m)) for m in moves], "job string, seq long, target string", "moves")
    assert {(r.job, r.seq): r.accepted for r in got} == {("a", 1): True, ("a", 2): True, ("a", 3): False, ("a", 4): True, ("a", 5): False, ("b", 1): False}
    shots = [("r", 1, "running", 1), ("r", 2, "running", 1), ("r", 3, "running", 2), ("r", 4, "succeeded", 2), ("r", 5, "succeeded", 3)]
    got = run(progress.run_events, [dict(zip(("run_id", "seq", "status", "done"), s)) for s in shots], "run_id string, seq long, status string, done long", "events_")
    assert sorted(r.seq for r in got) == [1, 3, 4]
    edits = [("l", 1, 0), ("l", 2, 0), ("l", 3, 1)]
    got = run(progress.overlay_revisions, [dict(zip(("layer", "seq", "expected"), e)) for e in edits], "layer string, seq long, expected long", "revisions")
    assert sorted((r.seq, r.accepted, r.revision) for r in got) == [(1, True, 1), (2, False, 1), (3, True, 2)]
    fails = [{"address": "x", "ts": "2024-01-01T00:00:00Z"}, {"address": "x", "ts": "2024-01-01T00:00:05Z"}]
    got = run(progress.ttl_cache, fails, "address string, ts timestamp", "failures")
    assert [(r.address, r.state) for r in got if r.state == "failed"] == [("x", "failed")]


def _play(spark, tmp_path, op, files, schema, name):
    """Each list of rows is a file and a trigger of its own."""
    d = tmp_path / name
    d.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(d))
    for k, rows in enumerate(files):
        (d / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(d / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    q = op(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_uploads_over_several_arrow_batches(spark, tmp_path):
    """Chunks in reverse order, two rows an Arrow batch: all are good in the trigger's own order."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = [{"file": "a", "at": 10 * k, "size": 10} for k in reversed(range(9))]
        got = _play(spark, tmp_path, progress.chunk_upload, [rows, [{"file": "a", "at": 90, "size": 1}, {"file": "a", "at": 5, "size": 1}]], "file string, at long, size long", "batched")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r.accepted for r in got) == 10 and max(r.offset for r in got) == 91 and [r.at for r in got if not r.accepted] == [5]


def test_ttl_cache_is_bounded(spark, tmp_path):
    """The oldest gives way, a repeated failure renews, and what is old expires."""
    at = lambda a, s: {"address": a, "ts": f"2024-01-01T00:00:{s:02d}Z"}
    files = [[at("a", 0), at("b", 1), at("a", 2)], [at("c", 3), at("d", 4)], [at("e", 50)], [at("f", 55)]]
    got = _play(spark, tmp_path, lambda s: progress.ttl_cache(s, ttl_s=30, most=3, buckets=1), files, "address string, ts timestamp", "bounded")
    states = [(r.address, r.state) for r in got]
    assert sorted(states) == sorted([("a", "failed"), ("b", "failed"), ("c", "failed"), ("b", "evicted"), ("d", "failed"), ("a", "expired"), ("c", "expired"), ("d", "expired"), ("e", "failed"), ("f", "failed")])


def test_interim_layers_replay(spark, tmp_path):
    """A replayed epoch, whole or after it had stopped half way, changes nothing."""
    results, layers = str(tmp_path / "results"), str(tmp_path / "layers")
    run = progress.interim_layers(results, layers, lambda df: df.groupBy("record").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n"))
    batch = lambda *rows: spark.createDataFrame(list(rows), "record string, n long")
    now = lambda: {r.record: r.n for r in progress.newest_layers(spark, layers).collect()}
    with pytest.raises(FileNotFoundError):
        progress.newest_layers(spark, layers)
    run(batch(("a", 1), ("b", 2)), 0)
    assert now() == {"a": 1, "b": 2}
    run(batch(("a", 10)), 1)
    run(batch(("a", 10)), 1)
    assert now() == {"a": 11, "b": 2}
    (tmp_path / "layers" / "epoch=2").mkdir()  # stopped before its layers were whole
    assert now() == {"a": 11, "b": 2}
    run(batch(("c", 5)), 2)
    run(batch().limit(0), 3)
    assert now() == {"a": 11, "b": 2, "c": 5}


def test_interim_layers_in_a_stream(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "0.json").write_text('{"record": "a", "n": 1}')
    stream = spark.readStream.schema("record string, n long").option("maxFilesPerTrigger", 1).json(str(d))
    run = progress.interim_layers(str(tmp_path / "r"), str(tmp_path / "l"), lambda df: df.groupBy("record").count())
    for k in (1, 2):
        progress.refresh_layers(stream, run, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        (d / f"{k}.json").write_text('{"record": "a", "n": 1}')
    assert progress.newest_layers(spark, str(tmp_path / "l")).collect()[0]["count"] == 2
