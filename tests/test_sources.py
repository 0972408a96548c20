from __future__ import annotations

import json
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThan, GreaterThanOrEqual, LessThanOrEqual

from waymark.functions import crs
from waymark.sources import las_chunks, layers, pointclouds, pose


def test_pose_rows(spark, tmp_path):
    d = tmp_path / "Job_20250311_0200" / "Track1" / "Sphere"
    d.mkdir(parents=True)
    good = "a.jpg;180096.447723;1;2;3;0;0;0;1;0;0;0;1;0;0;0;1"
    (d / "X_Sphere.csv").write_text("\n".join(["image;header", good, "", "b.jpg;x;1;2;3;0;0;0;1;0;0;0;1;0;0;0;1", "c.jpg;1;1;2;3;0;0;0;2;0;0;0;1;0;0;0;1", "d.jpg;1;2"]))
    rows = pose.scan_frames(pose.scan_pose_sphere(spark, str(tmp_path))).collect()
    assert [(r.image_name, r.row, r.gps_week, str(r.taken_at)) for r in rows] == [("a.jpg", 2, 2357, "2025-03-11 02:01:18.447723")]
    assert (rows[0].fx, rows[0].fy, rows[0].fz, rows[0].uy) == (0, 0, -1, 1)
    (d / "X_Sphere.txt").write_text("ImageSize=7040, 3520\nWidthLimits=0,360\nHeightLimits=0,180\nPanoramaHotSpot=180,90\nSphereRadius=5\n")
    s = pose.scan_sidecar(spark, str(tmp_path)).first()
    assert (s.image_width, s.longitude_limits_deg, s.latitude_limits_deg, s.hotspot) == (7040, [-180.0, 180.0], [-90.0, 90.0], [0.0, 0.0])


def test_block_file(spark, tmp_path):
    xyz = np.array([[300000.0, 4100000.0, 100.0], [300010.0, 4100004.0, 102.0]])
    db = sqlite3.connect(tmp_path / "a.pcdb")
    db.execute("CREATE TABLE CRYSTAL_CUBE (NAME TEXT, DATA BLOB)")
    blob = pointclouds.encode_block(xyz, np.array([[1, 2, 3]] * 2), np.array([7, 8]))
    db.executemany("INSERT INTO CRYSTAL_CUBE VALUES (?, ?)", [("b.bpc", blob), ("a.bpc", blob[:-5]), ("x.other", blob)])
    db.commit()
    db.close()
    found = pointclouds.scan_index(spark, str(tmp_path)).orderBy("block").collect()
    assert [(r.block, r.n, r.max_x) for r in found] == [("a.bpc", 2, 300010.0), ("b.bpc", 2, 300010.0)]
    points = pointclouds.read_points(spark, str(tmp_path)).orderBy("block", "x").collect()
    assert [(p.block, round(p.x, 3), p.intensity, p.classification) for p in points] == [("a.bpc", 300000.0, 7, -1), ("b.bpc", 300000.0, 7, -1), ("b.bpc", 300010.0, 8, -1)]


def test_las_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    xyz = np.round(rng.uniform(0, 50, (1000, 3)), 3) + [300000, 4100000, 0]
    (tmp_path / "a.las").write_bytes(pointclouds.encode_las(xyz, rng.integers(0, 256, (1000, 3))))
    got = pointclouds.read_points(spark, str(tmp_path)).orderBy("source_index").select("x", "y", "z").toPandas().to_numpy()
    assert np.abs(got - xyz).max() < 1e-3
    assert pointclouds.scan_index(spark, str(tmp_path)).first().n == 1000


def test_las_attributes(spark, tmp_path):
    from waymark.sources import previews

    rows = [(1, 10.0 + i, 20.0, 0.5 * i, i, 2 * i, 3, 100 + i, i % 7, 1e5 + i / 8, 1 + i % 3, 3) for i in range(40)]
    names = "crop_id x y z red green blue intensity classification gps_time return_number number_of_returns".split()
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'crop_id' else 'double' if n in ('x', 'y', 'z', 'gps_time') else 'int'}" for n in names))
    (tmp_path / "c.las").write_bytes(previews.las_crops(df).first().las)
    got = pointclouds.read_points(spark, str(tmp_path)).orderBy("x").select(*names[1:]).collect()
    assert [tuple(round(v, 6) for v in r) for r in got] == [r[1:] for r in rows]
    assert pointclouds.Las((tmp_path / "c.las").read_bytes()).format == 7


def test_layer_round_trip(spark, tmp_path):
    layers.register(spark)
    df = spark.createDataFrame([(1.5, 2.5, 3.5, "é" * 50, 7), (4.0, 5.0, 6.0, None, None)], "x double, y double, z double, name string, n long").coalesce(1)
    path = str(tmp_path / "layer")
    df.write.format("waymark_layer").mode("append").save(path)
    rows = layers.scan_layer(spark, path).orderBy("ordinal").collect()
    assert [(r.x, r.y, r.z) for r in rows] == [(1.5, 2.5, 3.5), (4.0, 5.0, 6.0)]
    assert rows[0].properties == {"name": "é" * 40, "n": "7"} and rows[1].properties == {}
    df.limit(1).write.format("waymark_layer").mode("append").save(path)  # replaced as a whole
    assert layers.scan_layer(spark, path).count() == 1


def test_results(spark, tmp_path):
    import hashlib
    import json

    from waymark.sources import results

    good = {"detection_index": 1, "x": 1.0, "y": 2.0, "z": 3.0, "class_id": 5, "confidence": 0.9, "pole": {"found": True, "x": 1.5, "y": 2.5, "z": 0.0, "occluded_bottom": True}}
    doc = {"run_fingerprint": "f", "image_name": "i.jpg", "record_name": "r", "detections": [good, {**good, "detection_index": 2, "x": None}, {**good, "detection_index": 3, "accepted_for_shp": False}, {**good, "detection_index": 4, "pole": {"found": False}}]}
    (tmp_path / "a.txt").write_text(json.dumps(doc))
    (tmp_path / "b.txt").write_text(json.dumps(doc)[:-40])
    (tmp_path / "c.txt").write_text(json.dumps({**doc, "run_fingerprint": "other"}))
    docs = results.documents(spark, str(tmp_path), "f")
    rows = results.scan_results(docs).orderBy("detection_index").collect()
    assert [r.detection_index for r in rows] == [1, 4]
    assert rows[0].detection_id == "D" + hashlib.sha256(b"r|i.jpg|1").hexdigest()[:19]
    poles = results.scan_pole_obs(docs).collect()
    assert [(p.detection_index, p.pole_x, p.pole_occlusion_status) for p in poles] == [(1, 1.5, "OCCLUDED")]
    out = str(tmp_path / "out")
    results.sink_frame_json(docs.drop("path"), out)
    assert results.scan_results(results.documents(spark, out, None, "*.json")).count() == 2


def test_calibration(spark, tmp_path):
    from waymark.sources import calibration

    scan = tmp_path / "Job1" / "Track1.scan"
    scan.mkdir(parents=True)
    db = sqlite3.connect(scan / "scan.db")
    db.execute("CREATE TABLE [SCAN.IMAGING_SENSORS] (ID INTEGER, FRIENDLY_NAME TEXT, INNER_ORIENTATION TEXT, OUTER_ORIENTATION TEXT)")
    inner = "<A><Camera><Name>c1</Name><SN>s1</SN><Width>10</Width><Height>20</Height><Calib><Model><f>1.5</f></Model></Calib></Camera><Camera><Name>c2</Name><SN>s2</SN></Camera></A>"
    outer = "<A><Camera><Name>c1</Name><SN>s1</SN><Calib><BoresightExternal><rx>0.25</rx></BoresightExternal></Calib></Camera></A>"
    db.execute("INSERT INTO [SCAN.IMAGING_SENSORS] VALUES (1, 'pano', ?, ?)", (inner, outer))
    db.commit()
    db.close()
    db = sqlite3.connect(tmp_path / "Job1" / "job.db")
    db.execute("CREATE TABLE [JOB.SENSORCALIBRATION] (SECTION TEXT, KEYNAME TEXT, KEYVALUE BLOB)")
    db.executemany("INSERT INTO [JOB.SENSORCALIBRATION] VALUES (?, ?, ?)", [("Laser", "Angles", calibration.encode_hidden("1.5,-2,3e1")), ("Laser", "Name", b"plain"), ("Laser", "Raw", b"\x01\x02\x80")])
    db.execute("CREATE TABLE [JOB.SETTINGS] (SECTION TEXT, KEYNAME TEXT, KEYVALUE TEXT)")
    db.execute("INSERT INTO [JOB.SETTINGS] VALUES ('User Data', 'GPSWeek', '2357')")
    db.commit()
    db.close()
    cameras = calibration.scan_cameras(spark, str(tmp_path))
    got = {r.serial: r for r in cameras.collect()}
    assert got["s1"].intrinsic == {"Model.f": "1.5"} and got["s1"].extrinsic == {"BoresightExternal.rx": "0.25"} and got["s2"].extrinsic is None
    keys = calibration.scan_job_calibration(spark, str(tmp_path))
    assert {r.key: (r.text, r.decoded) for r in keys.collect()} == {"Angles": (None, "1.5,-2,3e1"), "Name": ("plain", None), "Raw": (None, None)}
    assert calibration.scan_job_week(spark, str(tmp_path)).first().gps_week == 2357
    rows = calibration.calibration_rows(cameras, keys)
    assert {(r.component, r.parameter, r.value, r.unit) for r in rows.collect()} == {("Laser", "Angles.0", 1.5, "deg"), ("Laser", "Angles.1", -2.0, "deg"), ("Laser", "Angles.2", 30.0, "deg"), ("c1", "Model.f", 1.5, "unknown"), ("c1", "BoresightExternal.rx", 0.25, "unknown")}
    calibration.sink_calibration(rows, str(tmp_path / "out"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "out" / "csv")).count() == 5


def test_delivery(spark, tmp_path):
    from waymark.sources import delivery

    d = tmp_path / "J1" / "Track_2" / "las"
    d.mkdir(parents=True)
    xyz = np.array([[1.0, 2, 3], [4, 5, 6]])
    for name in ("J9_Track7_3.las", "cloud_12.las", "odd.las"):
        (d / name).write_bytes(pointclouds.encode_las(xyz, np.zeros((2, 3))))
    (tmp_path / "J1" / "a.prj").write_text("WKT-A")
    (tmp_path / "J1" / "b.prj").write_text("WKT-A\n")
    files = delivery.discover_points(spark, str(tmp_path))
    named = {r.path.rsplit("/", 1)[1]: r.i for r in files.select("path", delivery.las_identity(files["path"]).alias("i")).collect()}
    assert tuple(named["J9_Track7_3.las"]) == ("J9", "Track7", 3, "J9_Track7") and tuple(named["cloud_12.las"]) == ("J1", "Track_2", 12, "cloud") and tuple(named["odd.las"]) == (None, "Track_2", None, "odd")
    head = delivery.scan_headers(spark, str(tmp_path)).first()
    assert (head.points, head.point_format, head.low, head.high) == (2, 2, [1.0, 2.0, 3.0], [4.0, 5.0, 6.0])
    texts = delivery.read_sidecars(spark, str(tmp_path)).selectExpr("regexp_replace(path, '^file:/+', 'file:/') AS path", "text")
    points = files.selectExpr("regexp_replace(path, '^file:/+', 'file:/') AS path")
    assert {r.crs for r in delivery.crs_sidecars(points, texts, f"file:{tmp_path}").collect()} == {"WKT-A"}
    (tmp_path / "J1" / "Track_2" / "c.prj").write_text("X")
    (tmp_path / "J1" / "Track_2" / "d.prj").write_text("Y")
    texts = delivery.read_sidecars(spark, str(tmp_path)).selectExpr("regexp_replace(path, '^file:/+', 'file:/') AS path", "text")
    assert {r.crs for r in delivery.crs_sidecars(points, texts, f"file:{tmp_path}").collect()} == {None}


def test_previews(spark):
    from pyspark.sql import functions as F

    from waymark.sources import previews

    df = spark.createDataFrame([(1, i, i * 0.5, 1.0, 2.0, i % 256, 5, 6) for i in range(1000)] + [(2, 0, 1.0, 1.0, 1.0, 1, 2, 3)], "frame_id long, point_id long, x double, y double, z double, red int, green int, blue int")
    rows = {r.frame_id: r for r in previews.previews(df, previews.SPACE, (F.col("x"), F.col("y"), F.col("z")), 100).collect()}
    kind, at, rgb = previews.decode(rows[1].preview)
    assert kind == b"MMSP" and len(at) == 100 and at[0, 0] == 0 and at[-1, 0] == 499.5 and rgb[0].tolist() == [0, 5, 6] and rows[2].points == 1
    crop = previews.las_crops(df.filter("frame_id = 1").withColumnRenamed("frame_id", "crop_id")).first()
    assert pointclouds.Las(bytes(crop.las)).count == 1000
    assert len(previews.encode(previews.SCREEN, np.zeros((0, 3)), np.zeros((0, 3)))) == 40


def test_settings():
    import pytest

    from waymark.sources import settings as T

    options = {"mode": "off", "radius": 1.0, "count": 3, "debug": False}
    got = T.load("config_version: 1\na:\n  mode: off # no boolean\n  radius: 2\nb:\n  debug: true\n", options, {"radius": (0, 5)})
    assert got == {"mode": "off", "radius": 2.0, "count": 3, "debug": True}
    for bad in ("x: 1", "a:\n  count: 1\nb:\n  count: 2", "debug: 1", "radius: 9", "config_version: 2"):
        with pytest.raises(T.SettingsError):
            T.load(bad, options, {"radius": (0, 5)})
    assert T.overlay(options, {"Best": {"count": 9, "mode": "x"}}, "/m/best.pt", {"mode": "y"})["count"] == 9
    assert T.select_models(["B.pt", "a.pt"], ["A.PT", "b.pt"]) == ["B.pt", "a.pt"]
    assert T.fingerprint({"a": 1, "path": "x"}, ("path",)) == T.fingerprint({"path": "y", "a": 1}, ("path",))


def test_delivery_poses(spark, tmp_path):
    good = "a.jpg;180096.447723;1;2;3;0;0;0;1;0;0;0;1;0;0;0;1"
    root = tmp_path / "20250311_0200_area"
    for track, ini, sphere, images in (("T1", True, True, ("a.jpg", "b.jpg")), ("T2", False, True, ("a.jpg",)), ("T3", True, False, ("a.jpg",)), ("T4", True, True, ())):
        camera = root / "Survey1" / track / "Camera01"
        camera.mkdir(parents=True)
        (camera / "external orientation.CSV").write_text("\n".join([good, good.replace("a.jpg", "gone.jpg"), good.replace("a.jpg", "b.jpg") + ";9"]))
        (camera / "Internal Orientation.txt").write_text("ImageSize=8, 4\nWidthLimits=0,360\nHeightLimits=0,180\nPanoramaHotSpot=180,90\nSphereRadius=5\n" if sphere else "Focal=1\n")
        for name in images:
            (camera / name).write_bytes(b"jpg")
        if ini:
            (root / "Survey1" / track / "z.ini").write_text("[MMSIdentification]\nManufacturer = Maker\nModelName=M\nSerialNumber=7\n[Other]\nx=1\n")
    rows = pose.scan_pose_delivery(spark, str(tmp_path)).collect()
    assert [(r.image_name, r.row, r.job_name, r.track_name, r.gps_week, str(r.taken_at), r.manufacturer, r.serial_number) for r in rows] == [("a.jpg", 1, "Survey1", "T1", 2357, "2025-03-11 02:01:18.447723", "Maker", "7")]


def test_legacy_poses(spark, tmp_path):
    d = tmp_path / "Route_17" / "CAM"
    d.mkdir(parents=True)
    row = "1,250311_020118447723.jpg,1,2,3,0,1,0,0,0,1,.1,.2,.3,4,5,6"
    (d / "250311_020118447723.jpg").write_bytes(b"jpg")
    (d / "p.csv").write_text("\n".join(["n,image", row + ",extra", row.replace("250311", "250312"), row.replace("1,2,3", "1,x,3")]))
    (tmp_path / "Route_17" / "other.csv").write_text(row)
    rows = pose.scan_pose_legacy(spark, str(tmp_path)).collect()
    assert [(r.image_name, r.row, r.record_name, r.route_id, str(r.taken_at), r.oy, r.fy, r.uz, r.kappa_deg) for r in rows] == [("250311_020118447723.jpg", 2, "Route_17", "17", "2025-03-11 02:01:18.447723", 2.0, 1.0, 1.0, 6.0)]


def test_table_encoding():
    import pytest

    table = lambda raw: bytes(8) + (33).to_bytes(2, "little") + len(raw).to_bytes(2, "little") + bytes(21) + raw
    assert layers.infer_encoding(table(" 한글".encode())) == "utf-8" and layers.infer_encoding(table(" 한글".encode("cp949"))) == "cp949"
    for bad in (b"short", table(b"\xff\xff\xff"), table(b"")):
        with pytest.raises(ValueError):
            layers.infer_encoding(bad)


def test_manifest_and_metrics(spark, tmp_path):
    import json
    import os

    import pytest

    from waymark.operators.metrics import StageMetrics
    from waymark.sources.results import sink_manifest

    path = f"{tmp_path}/out/run.json"
    for n in (1, 2):
        sink_manifest(spark, f"file://{path}", {"n": n, "name": "é"})
        assert json.load(open(path)) == {"n": n, "name": "é"}
    with pytest.raises(ValueError):
        sink_manifest(spark, f"file://{path}", {"n": float("nan")})
    assert json.load(open(path))["n"] == 2 and not [f for f in os.listdir(tmp_path / "out") if f.endswith(".tmp")]
    m = StageMetrics()
    for _ in range(2):
        with m.timed("match"):
            m.counted(spark.range(7), "match").write.format("noop").mode("overwrite").save()
    (row,) = m.snapshot(spark).collect()
    assert (row.stage, row["count"], row.rows) == ("match", 2, 14) and row.seconds > 0


def test_required_calibration(spark):
    import pytest

    from waymark.operators.matching import require_calibration

    good = spark.createDataFrame([(1, "attached"), (2, "week_replaced")], "k long, status string")
    assert require_calibration(good).count() == 2
    with pytest.raises(ValueError, match="1 missing"):
        require_calibration(good.union(spark.createDataFrame([(3, "missing")], good.schema)))


def test_las_chunks(spark, tmp_path, monkeypatch):
    """A partition a chunk, its columns alone, files pruned by bounds; the same points as by file."""
    rng = np.random.default_rng(21)
    for k in range(3):
        (tmp_path / f"f{k}.LAS").write_bytes(pointclouds.encode_las(rng.uniform(0, 50, (700, 3)) + [100 * k, 0, 0], rng.integers(0, 256, (700, 3)), attributes={"classification": rng.integers(0, 20, 700), "gps_time": rng.uniform(0, 9, 700)}))
    (tmp_path / "none.las").write_bytes(pointclouds.encode_las(np.empty((0, 3)), np.empty((0, 3))))
    whole = (tmp_path / "f2.LAS").read_bytes()
    (tmp_path / "cut.las").write_bytes(whole[: 375 + 36 * 10 + 5])  # ten points and a piece of one
    (tmp_path / "other.txt").write_text("no points")
    chunks = las_chunks.read_chunks(spark, str(tmp_path), points=300)
    assert chunks.rdd.getNumPartitions() == 3 * 3 + 1
    columns = [c for c in chunks.columns if c not in ("path", "block")]
    plain = pointclouds.read_points(spark, str(tmp_path), "*.{las,LAS}")
    key = lambda df: sorted(map(tuple, df.select(F.element_at(F.split("path", "/"), -1), *columns).collect()), key=str)
    assert key(chunks) == key(plain) and chunks.count() == 2110
    found = las_chunks.read_chunks(spark, str(tmp_path), ("x", "z"), points=300).where("x > 110 AND x <= 140 AND z >= 10")
    want = plain.where("x > 110 AND x <= 140 AND z >= 10").select("x", "z")
    assert sorted(found.collect()) == sorted(want.collect())
    reader = las_chunks.LasReader(found.schema, {"path": f"file://{tmp_path}", "points": "300"})
    tests = [GreaterThan(("x",), 110.0), LessThanOrEqual(("x",), 140.0), GreaterThanOrEqual(("z",), 10.0)]
    assert list(reader.pushFilters(tests)) == tests and {p.path.rsplit("/", 1)[1] for p in reader.partitions()} == {"f1.LAS"}
    assert [b.schema.names for b in reader.read(reader.partitions()[0])] == [["x", "z"]]
    i = {(r.path.rsplit("/", 1)[1], r.block): r for r in las_chunks.index(spark, str(tmp_path)).collect()}
    assert set(i) == {("f0.LAS", "las:0:700"), ("f1.LAS", "las:0:700"), ("f2.LAS", "las:0:700"), ("cut.las", "las:0:10")}
    assert i["f1.LAS", "las:0:700"].n == 700 and 100 <= i["f1.LAS", "las:0:700"].min_x < 102
    (tmp_path / "bad.las").write_bytes(b"not LAS" * 100)
    with pytest.raises(Exception, match="bad.las"):
        las_chunks.read_chunks(spark, str(tmp_path)).count()


def test_las_over_two_gigabytes(spark, tmp_path):
    """A sparse file of 3 GB: each partition seeks to its own range."""
    n = 120_000_000
    head = bytearray(pointclouds.encode_las(np.array([[0.0, 0, 0], [1.0, 2, 3]]), np.zeros((2, 3)))[:375])
    struct.pack_into("<Q", head, 247, n)
    with open(tmp_path / "huge.las", "wb") as f:
        f.write(head)
        f.truncate(375 + 26 * n)
        f.seek(375 + 26 * (n - 1))
        f.write(struct.pack("<3i", 1000, 2000, 3000))
    assert (tmp_path / "huge.las").stat().st_size > 2 << 30
    df = las_chunks.read_chunks(spark, str(tmp_path), ("x", "y", "z", "source_index"))
    assert df.rdd.getNumPartitions() == 60
    reader = las_chunks.LasReader(df.schema, {"path": str(tmp_path)})
    *_, last = reader.read(reader.partitions()[-1])
    assert [v[-1] for v in last.to_pydict().values()] == [1.0, 2.0, 3.0, n - 1]


def _published(spark, root, name):
    return sorted((dict(r.properties) for r in layers.scan_layer(spark, f"{root}/{name}").collect()), key=lambda p: p.get("det_id", ""))


def test_publish_layers(spark, tmp_path, monkeypatch):
    """Fixed attributes, both layers or none: a failure between the moves leaves the old state."""
    root = str(tmp_path / "out")
    sign = dict(class_id=59, class_name="sign" * 20, confidence=0.91234, x=1.5, y=2.5, z=3.25, detection_id="d1", support_id=None, image_name="a.jpg", timestamp_iso="2025-03-11T02:01:18", point_count=7, point_crop_path="/crops/r/a_1.las", gps_week=2357, bbox=[1.0, 2.0, 3.0, 4.5], panorama_width=7040, panorama_height=3520)
    kinds = "class_id long, class_name string, confidence double, x double, y double, z double, detection_id string, support_id string, image_name string, timestamp_iso string, point_count long, point_crop_path string, gps_week long, bbox array<double>, panorama_width long, panorama_height long"
    signs = lambda n: spark.createDataFrame([tuple((sign | {"detection_id": f"d{i}"}).values()) for i in range(n)] + [tuple((sign | {"x": None}).values())], kinds)
    poles = lambda n: spark.createDataFrame([(f"d{i}", 1.0, 2.0, 0.5, None if i == 0 else i == 1, 3 if i else None, 0.0123, True) for i in range(n)], "detection_id string, pole_x double, pole_y double, pole_z double, pole_occluded boolean, obs_count long, axis_rmse_m double, arm_anchored boolean")
    layers.publish(spark, root, signs(3), poles(3), "WKT")
    got = _published(spark, root, "signs")
    assert len(got) == 3 and got[0] == {"class_id": "59", "class_nm": ("sign" * 20)[:40], "conf": "0.9123", "x": "1.5000", "y": "2.5000", "z": "3.2500", "det_id": "d0", "img_name": "a.jpg", "img_time": "2025-03-11T02:01:18", "pt_count": "7", "las_file": "a_1.las", "gps_week": "2357", "bbox_l": "1.0000", "bbox_t": "2.0000", "bbox_r": "3.0000", "bbox_b": "4.5000", "pano_w": "7040", "pano_h": "3520"}
    got = _published(spark, root, "poles")
    assert [(p["occ_state"], p.get("occluded"), p["occl_cnt"], p["unk_occ"], p["obs_count"], p["det_count"]) for p in got] == [("UNKNOWN", None, "0", "1", "1", "1"), ("OCCLUDED", "T", "1", "0", "3", "3"), ("VISIBLE", "F", "0", "0", "3", "3")]
    assert (got[0]["class_id"], got[0]["arm_end"], got[0]["axis_rmse"], got[0]["reconciled"]) == ("-1", "T", "0.0123", "F")
    files = list((tmp_path / "out" / "poles").glob("*.dbf"))
    assert {len(layers.decode_dbf(f.read_bytes())[0]) for f in files} == {49} and {len(layers.decode_dbf(f.read_bytes())[0]) for f in (tmp_path / "out" / "signs").glob("*.dbf")} == {25}
    assert {f.read_text() for f in (tmp_path / "out" / "signs").glob("*.prj")} == {"WKT"}

    before = (_published(spark, root, "signs"), _published(spark, root, "poles"))
    real, moves = layers.swap, []

    def failing(store, pairs, journal):
        class Broken:
            def __getattr__(self, name):
                return getattr(store, name)

            def move(self, a, b):
                moves.append(b)
                if len(pairs) == 2 and b.endswith("/poles") and ".publishing-" in a:
                    raise OSError("locked")
                store.move(a, b)

        real(Broken(), pairs, journal)

    monkeypatch.setattr(layers, "swap", failing)
    with pytest.raises(OSError, match="locked"):
        layers.publish(spark, root, signs(1), poles(1))
    assert (_published(spark, root, "signs"), _published(spark, root, "poles")) == before and any(m.endswith("/signs") for m in moves)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["poles", "signs"]

    def crashing(store, pairs, journal):  # the process ends between two moves
        if len(pairs) == 1:
            return real(store, pairs, journal)
        plan = [(a, b, f"{b}.old-1", True) for a, b in pairs]
        layers._put(store, journal, json.dumps(plan).encode())
        store.move(plan[0][1], plan[0][2])
        store.move(plan[0][0], plan[0][1])
        raise KeyboardInterrupt

    monkeypatch.setattr(layers, "swap", crashing)
    with pytest.raises(KeyboardInterrupt):
        layers.publish(spark, root, signs(1), poles(1))
    assert len(_published(spark, root, "signs")) == 1
    assert layers.recover(root) == 1 and layers.recover(root) == 0
    assert (_published(spark, root, "signs"), _published(spark, root, "poles")) == before
    monkeypatch.setattr(layers, "swap", real)
    layers.publish(spark, root, signs(2), poles(0))
    assert len(_published(spark, root, "signs")) == 2 and _published(spark, root, "poles") == []
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if "old" in p.name or p.name.startswith(".publish")) == []


def test_layer_of_several_bundles_a_task(spark, tmp_path):
    layers.register(spark)
    df = spark.range(25).coalesce(1).selectExpr("id AS x", "0.0D AS y", "1.0D AS z", "id % 2 = 0 AS even").withColumn("x", F.col("x").cast("double"))
    df.write.format("waymark_layer").option("rows", 10).mode("append").save(str(tmp_path / "l"))
    assert len(list((tmp_path / "l").glob("*.shp"))) == 3
    got = layers.scan_layer(spark, str(tmp_path / "l")).collect()
    assert sorted((r.x, r.properties["even"]) for r in got) == [(float(i), "F" if i % 2 else "T") for i in range(25)]


def _shape(code, parts, deep):
    """A record's content: lines, rings or a multipoint of (x, y, z)."""
    points = [p for part in parts for p in part]
    box = struct.pack("<4d", 0, 0, 0, 0)
    starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
    head = struct.pack("<2i", len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) if code % 10 != 8 else struct.pack("<i", len(points))
    z = struct.pack("<2d", 0, 0) + struct.pack(f"<{len(points)}d", *[p[2] for p in points]) if deep else b""
    return struct.pack("<i", code) + box + head + b"".join(struct.pack("<2d", *p[:2]) for p in points) + z


def test_overlay_shapes(spark, tmp_path):
    """Lines, polygons with holes and islands, multipoints and nulls, in place or projected."""
    square = lambda x, y, s, up=0.0: [(x, y, up), (x, y + s, up), (x + s, y + s, up), (x + s, y, up), (x, y, up)]
    east, north = 200000.0, 600000.0
    at = lambda ring: [(x + east, y + north, z) for x, y, z in ring]
    hole, other = square(2, 2, 1)[::-1], square(20, 20, 5, 7.0)
    line = [(0.0, 0.0, 1.0), (10.0, 5.0, 2.0)]
    shapes = [_shape(5, [at(square(0, 0, 10)), at(other), at(hole)], False), _shape(15, [at(other)], True), _shape(3, [at(line)], False), _shape(13, [at(line), at(line[::-1])], True), _shape(8, [at(line)], False), struct.pack("<i", 0), struct.pack("<i2d", 1, east, north), _shape(5, [], False), _shape(5, [at(hole)], False)]
    data = bytearray(100)
    for i, c in enumerate(shapes, 1):
        data += struct.pack(">2i", i, len(c) // 2) + c
    (tmp_path / "o.shp").write_bytes(data)
    (tmp_path / "o.dbf").write_bytes(layers.encode_dbf([("name", "C", 10, 0), ("v", "C", 5, 0)], [(f"n{i}", "NaN") for i in range(len(shapes))]))
    assert layers.scan_overlay(spark, str(tmp_path)).count() == 0  # no .shx, no bundle
    (tmp_path / "o.shx").write_bytes(bytes(100))
    rows = layers.scan_overlay(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r.id for r in rows] == [f"f_{i:09d}" for i in (0, 1, 2, 3, 4, 6, 8)] and rows[0].properties == {"name": "n0"}
    assert [r.geometry.type for r in rows] == ["MultiPolygon", "Polygon", "LineString", "MultiLineString", "MultiPoint", "Point", "Polygon"]
    flat = lambda r: [[[tuple(p) for p in ring] for ring in polygon] for polygon in r.geometry.coordinates]
    level = lambda ring: [(x, y, 0.0) for x, y, _ in at(ring)]
    assert flat(rows[0]) == [[at(square(0, 0, 10)), at(hole)], [level(other)]]
    assert flat(rows[1]) == [[at(other)]] and flat(rows[3]) == [[at(line), at(line[::-1])]] and flat(rows[4]) == [[level(line)]] and flat(rows[5]) == [[[(east, north, 0.0)]]]
    moved = layers.scan_overlay(spark, str(tmp_path), crs.inverse_mercator)
    back = moved.withColumn("geometry", crs.reproject(F.col("geometry"), crs.transverse_mercator)).orderBy("ordinal").collect()
    lonlat = moved.orderBy("ordinal").collect()
    assert abs(lonlat[5].geometry.coordinates[0][0][0].x - 127) < 1e-9 and abs(lonlat[5].geometry.coordinates[0][0][0].y - 38) < 1e-9
    for a, b in zip(rows, back):
        assert a.geometry.type == b.geometry.type
        assert np.abs(np.array([p for g in flat(a) for r in g for p in r]) - np.array([p for g in flat(b) for r in g for p in r])).max() < 1e-3


def test_projection_round_trip(spark):
    """To a millimetre within two degrees of the central meridian."""
    grid = spark.createDataFrame([(125 + 4 * i / 20, 33 + 6 * j / 20) for i in range(21) for j in range(21)] + [(None, 38.0)], "lon double, lat double")
    e, n = crs.transverse_mercator(F.col("lon"), F.col("lat"))
    lon, lat = crs.inverse_mercator(F.col("e"), F.col("n"))
    e2, n2 = crs.transverse_mercator(F.col("lon2"), F.col("lat2"))
    d = grid.select(e.alias("e"), n.alias("n")).select("e", "n", lon.alias("lon2"), lat.alias("lat2")).select(F.max(F.abs(e2 - F.col("e"))).alias("e"), F.max(F.abs(n2 - F.col("n"))).alias("n")).first()
    assert d.e < 1e-3 and d.n < 1e-3


def test_inverse_far_from_the_meridian(spark):
    """Within a ten-millionth of a degree; nulls stay."""
    grid = spark.createDataFrame([(127 + 3.0 * i, 33 + 2.0 * j) for i in range(-12, 13) for j in range(4)] + [(None, 38.0)], "lon double, lat double")
    at = grid.select("lon", "lat", crs.inverse_mercator_far(*crs.transverse_mercator(F.col("lon"), F.col("lat"))).alias("at"))
    d = at.select(F.max(F.abs(F.col("at.lon") - F.col("lon"))).alias("x"), F.max(F.abs(F.col("at.lat") - F.col("lat"))).alias("y"), F.count("at.lon").alias("n")).first()
    assert d.x < 1e-9 and d.y < 1e-9 and d.n == 100
