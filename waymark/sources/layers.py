"""Point layers in SHP/DBF form: a reader over binaryFile and a Python data source that writes.

The writer stages bundles of ROWS rows at most beside the target, in any store that pyarrow's
file systems open (local, S3, GCS, HDFS by libhdfs), and moves all of them at commit; abort
removes what was staged, so a layer appears whole or not at all. `publish` does the same for
several layers at once."""

from __future__ import annotations

import itertools
import json
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from waymark.functions.crs import reproject

POINT_Z = 11


def encode_shp(points: list[tuple[float, float, float]]) -> tuple[bytes, bytes]:
    """(.shp, .shx) of PointZ shapes."""
    body, index, at = bytearray(), bytearray(), 50
    for i, (x, y, z) in enumerate(points, 1):
        shape = struct.pack("<i4d", POINT_Z, x, y, z, 0.0)
        body += struct.pack(">2i", i, len(shape) // 2) + shape
        index += struct.pack(">2i", at, len(shape) // 2)
        at += 4 + len(shape) // 2
    lows, highs = ([f(p[k] for p in points) for k in range(3)] if points else [0.0] * 3 for f in (min, max))
    box = struct.pack("<8d", lows[0], lows[1], highs[0], highs[1], lows[2], highs[2], 0.0, 0.0)
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i", 1000, POINT_Z) + box
    return head(50 + len(body) // 2) + bytes(body), head(50 + len(index) // 2) + bytes(index)


def decode_shp(data: bytes) -> list[tuple[float, float, float] | None]:
    """Points of a PointZ (11), PointM (21) or Point (1) file; null shapes are None."""
    out, at = [], 100
    while at + 12 <= len(data):
        (_, words), (kind,) = struct.unpack_from(">2i", data, at), struct.unpack_from("<i", data, at + 8)
        if kind in (1, 11, 21):
            x, y = struct.unpack_from("<2d", data, at + 12)
            out.append((x, y, struct.unpack_from("<d", data, at + 28)[0] if kind == 11 else 0.0))
        else:
            out.append(None)
        at += 8 + 2 * words
    return out


def encode_dbf(fields: list[tuple[str, str, int, int]], rows: list[tuple]) -> bytes:
    """fields: name (10 characters at most), C, N, F or L, width, decimals. Texts are cut to their
    width (whole characters); a number that doesn't fit is an error; null is blank."""
    size = 1 + sum(f[2] for f in fields)
    out = bytearray(struct.pack("<4BI2H20x", 3, 126, 1, 1, len(rows), 33 + 32 * len(fields), size))
    for name, kind, width, decimals in fields:
        out += struct.pack("<11sc4x2B14x", name.encode()[:10], kind.encode(), width, decimals)
    out += b"\r"
    for row in rows:
        out += b" "
        for value, (name, kind, width, decimals) in zip(row, fields):
            if value is None or value != value:
                cell = b" " * width
            elif kind == "L":
                cell = b"T" if value else b"F"
            elif kind in "NF":
                cell = (f"{value:.{decimals}f}" if decimals else str(int(value))).rjust(width).encode()
                if len(cell) > width:
                    raise ValueError(f"{name}: {value} is wider than {width}")
            else:
                cell = str(value).encode()[:width].decode("utf-8", "ignore").encode().ljust(width)
            out += cell
    return bytes(out) + b"\x1a"


def decode_dbf(data: bytes, encoding: str = "utf-8") -> tuple[list[str], list[dict[str, str] | None]]:
    """(field names, rows as texts); deleted rows are None, blanks are left out."""
    count, head, size = struct.unpack_from("<I2H", data, 4)
    fields, at = [], 32
    while at < head - 1 and data[at] != 13:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), data[at + 16]))
        at += 32
    rows: list[dict[str, str] | None] = []
    for i in range(count):
        start = head + i * size
        if data[start : start + 1] == b"*":
            rows.append(None)
            continue
        row, pos = {}, start + 1
        for name, width in fields:
            if text := data[pos : pos + width].decode(encoding, "replace").strip():
                row[name] = text
            pos += width
        rows.append(row)
    return [f[0] for f in fields], rows


_FEATURES = "stem string, id string, ordinal long, x double, y double, z double, properties map<string,string>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for stem, shp, dbf in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows = [(stem, f"f_{i:09d}", i, *p, list(r.items())) for i, (p, r) in enumerate(zip(decode_shp(shp), decode_dbf(dbf, infer_encoding(dbf))[1])) if p is not None and r is not None]
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in _FEATURES.split(", ")])


def scan_layer(spark: SparkSession, root: str) -> DataFrame:
    """Features of every bundle (.shp with its .dbf) under root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{shp,dbf}").load(root)
    stem = F.regexp_replace("path", r"\.(shp|dbf)$", "")
    ends = lambda e: F.max(F.when(F.col("path").endswith(e), F.col("content")))
    bundle = found.groupBy(stem.alias("stem")).agg(ends(".shp").alias("shp"), ends(".dbf").alias("dbf")).filter("shp IS NOT NULL AND dbf IS NOT NULL")
    return bundle.mapInArrow(_features, _FEATURES)


#: Kinds of shapes (fixed values): Z and M forms are 10 and 20 more.
SHAPES = {1: "Point", 3: "PolyLine", 5: "Polygon", 8: "MultiPoint"}


def _inside(x: float, y: float, ring: list[tuple]) -> bool:
    odd = False
    for (ax, ay, _), (bx, by, _) in zip(ring, [*ring[1:], ring[0]]):
        odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return odd


def _polygons(rings: list[list[tuple]]) -> list[list[list[tuple]]]:
    """Clockwise rings each begin a polygon; other ones are holes of the first polygon around them,
    and without such a one polygons of their own."""
    area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, [*r[1:], r[0]]))
    rings = [r for r in rings if r]
    out = [[r] for r in rings if area(r) <= 0]
    for hole in (r for r in rings if area(r) > 0):
        around = next((p for p in out if _inside(*hole[0][:2], p[0])), None)
        if around is None:
            out.append([hole])
        else:
            around.append(hole)
    return out


def decode_shapes(data: bytes) -> list[tuple[str, list] | None]:
    """(type, coordinates) of every shape, with GeoJSON's type names; coordinates are polygons of
    rings (lines, points) of (x, y, z) at every type. Null and empty shapes are None."""
    out: list[tuple[str, list] | None] = []
    at = 100
    while at + 12 <= len(data):
        (_, words), (code,) = struct.unpack_from(">2i", data, at), struct.unpack_from("<i", data, at + 8)
        body, end = at + 12, at + 8 + 2 * words
        at = end
        kind, deep = SHAPES.get(code % 10), 10 < code < 20
        if kind is None:
            out.append(None)
        elif kind == "Point":
            x, y = struct.unpack_from("<2d", data, body)
            out.append(("Point", [[[(x, y, struct.unpack_from("<d", data, body + 16)[0] if deep else 0.0)]]]))
        else:
            parts, count = struct.unpack_from("<2i", data, body + 32) if kind != "MultiPoint" else (1, struct.unpack_from("<i", data, body + 32)[0])
            starts = struct.unpack_from(f"<{parts}i", data, body + 40) if kind != "MultiPoint" else (0,)
            place = body + 40 + 4 * parts if kind != "MultiPoint" else body + 36
            xy = struct.unpack_from(f"<{2 * count}d", data, place)
            z = struct.unpack_from(f"<{count}d", data, place + 16 * count + 16) if deep else (0.0,) * count
            points = list(zip(xy[::2], xy[1::2], z))
            rings = [points[a:b] for a, b in zip(starts, [*starts[1:], count])]
            if not count:
                out.append(None)
            elif kind == "Polygon":
                found = _polygons(rings)
                out.append(("Polygon" if len(found) == 1 else "MultiPolygon", found))
            elif kind == "PolyLine":
                out.append(("LineString" if len(rings) == 1 else "MultiLineString", [rings]))
            else:
                out.append(("MultiPoint", [rings]))
    return out


_OVERLAY = "stem string, id string, ordinal long, geometry struct<type: string, coordinates: array<array<array<struct<x: double, y: double, z: double>>>>>, properties map<string,string>"


def _overlay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    point = pa.struct([(a, pa.float64()) for a in "xyz"])
    shape = pa.struct([("type", pa.string()), ("coordinates", pa.list_(pa.list_(pa.list_(point))))])
    for batch in batches:
        for stem, shp, dbf in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows = []
            for i, (g, r) in enumerate(zip(decode_shapes(shp), decode_dbf(dbf, infer_encoding(dbf))[1])):
                if g is not None and r is not None:
                    nested = [[[dict(zip("xyz", p)) for p in ring] for ring in polygon] for polygon in g[1]]
                    rows.append((stem, f"f_{i:09d}", i, {"type": g[0], "coordinates": nested}, [(k, v) for k, v in r.items() if v.lower() != "nan"]))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.int64(), shape, pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["stem", "id", "ordinal", "geometry", "properties"])


def scan_overlay(spark: SparkSession, root: str, project: Callable[[Column, Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """Points, lines and polygons of every bundle (.shp, .shx and .dbf) under root, projected at
    import if `project` (such as crs.inverse_mercator) is given. NaN attributes are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{shp,shx,dbf}").load(root)
    ends = lambda e: F.max(F.when(F.col("path").endswith(e), F.col("content")))
    whole = F.max(F.col("path").endswith(".shx")).alias("index")
    bundle = found.groupBy(F.regexp_replace("path", r"\.(shp|shx|dbf)$", "").alias("stem")).agg(ends(".shp").alias("shp"), ends(".dbf").alias("dbf"), whole).filter("shp IS NOT NULL AND dbf IS NOT NULL AND index")
    features = bundle.select("stem", "shp", "dbf").mapInArrow(_overlay, _OVERLAY)
    return features.withColumn("geometry", reproject(F.col("geometry"), project)) if project else features


def infer_encoding(dbf: bytes) -> str:
    """The encoding of a table's texts: UTF-8 where its rows (8 MB of them at most) are that,
    else CP949; neither, or a broken header, is an error."""
    if len(dbf) < 12:
        raise ValueError("the table's header is incomplete")
    head, size = int.from_bytes(dbf[8:10], "little"), int.from_bytes(dbf[10:12], "little")
    if not 33 <= head <= len(dbf) or not size:
        raise ValueError("the table's header or row length is invalid")
    rows = dbf[head : head + max(1, (8 << 20) // size) * size]
    for name in ("utf-8", "cp949"):
        try:
            rows.decode(name)
            return name
        except UnicodeDecodeError:
            continue
    raise ValueError("neither UTF-8 nor CP949: name the encoding")


#: Rows of a bundle, at most; a task holds no more of them.
ROWS = 100_000


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _there(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != fs.FileType.NotFound


def _put(store: fs.FileSystem, path: str, data: bytes) -> None:
    with store.open_output_stream(path) as f:
        f.write(data)


def swap(store: fs.FileSystem, pairs: list[tuple[str, str]], journal: str) -> None:
    """Puts every staged folder in its target's place, or none. What is to be done stands in the
    journal first; a failure undoes it at once, and `undo` undoes it after a crash. Backups go
    once the journal is gone."""
    plan = [(staged, target, f"{target}.old-{uuid.uuid4().hex}", _there(store, target)) for staged, target in pairs]
    _put(store, journal, json.dumps(plan).encode())
    try:
        for staged, target, backup, existed in plan:
            if existed:
                store.move(target, backup)
            store.move(staged, target)
    except Exception:
        undo(store, journal)
        raise
    store.delete_file(journal)
    for _, _, backup, existed in plan:
        if existed:
            store.delete_dir(backup)


def undo(store: fs.FileSystem, journal: str) -> None:
    """Takes back what a journal's swap did, however far it came; may itself be repeated. A target
    without its backup is still the old one, if there was one."""
    with store.open_input_stream(journal) as f:
        plan = json.loads(f.read())
    for _, target, backup, existed in reversed(plan):
        if _there(store, target) and (not existed or _there(store, backup)):
            store.delete_dir(target)
        if _there(store, backup):
            store.move(backup, target)
    store.delete_file(journal)


class Staged(WriterCommitMessage):
    def __init__(self, stems: list[str]) -> None:
        self.stems = stems


class _LayerWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], names: list[str], kinds: list[str]) -> None:
        self.path, self.wkt = options["path"].rstrip("/"), options.get("wkt", "")
        self.rows = int(options.get("rows", ROWS))
        self.id = uuid.uuid4().hex
        own = [(n[:10], "C", 80, 0) if k == "string" else (n[:10], "L", 1, 0) if k == "boolean" else (n[:10], "N", 20, 0 if k in ("integer", "long") else 9) for n, k in zip(names, kinds) if n not in ("x", "y", "z")]
        self.fields = [tuple(f) for f in json.loads(options["fields"])] if "fields" in options else own
        self.names = [f[0] for f in self.fields] if "fields" in options else [n for n in names if n not in ("x", "y", "z")]

    def _stage(self) -> tuple[fs.FileSystem, str, str]:
        store, path = store_of(self.path)
        folder, _, name = path.rpartition("/")
        return store, path, f"{folder}/.staged-{self.id}-{name}"

    def write(self, iterator) -> Staged:
        store, _, stage = self._stage()
        stems = []
        while rows := [r.asDict() for r in itertools.islice(iterator, self.rows)]:
            store.create_dir(stage)
            stem = f"layer-{uuid.uuid4().hex[:12]}"
            shp, shx = encode_shp([(r["x"], r["y"], r["z"]) for r in rows])
            dbf = encode_dbf(self.fields, [tuple(r[n] for n in self.names) for r in rows])
            for end, data in ((".shp", shp), (".shx", shx), (".dbf", dbf), (".prj", self.wkt.encode()), (".cpg", b"UTF-8")):
                _put(store, f"{stage}/{stem}{end}", data)
            stems.append(stem)
        return Staged(stems)

    def commit(self, messages: list) -> None:
        store, path, stage = self._stage()
        store.create_dir(stage)
        good = {s for m in messages if m for s in m.stems}
        for f in store.get_file_info(fs.FileSelector(stage)):  # what failed attempts of a task left goes
            if f.base_name.partition(".")[0] not in good:
                store.delete_file(f.path)
        swap(store, [(stage, path)], f"{stage}.journal")

    def abort(self, messages: list) -> None:
        store, _, stage = self._stage()
        if _there(store, stage):
            store.delete_dir(stage)


class LayerSource(DataSource):
    """df with x, y, z and attributes: df.write.format("waymark_layer").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "waymark_layer"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _LayerWriter(self.options, schema.names, [f.dataType.typeName() for f in schema])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LayerSource)


#: The attributes of published layers: name, type, width, decimals, and the column they come
#: from (fixed values; class_id of a support without one is -1).
SIGN_FIELDS = """
class_id N 50 0 class_id
class_nm C 40 0 class_name
model_nm C 80 0 model_name
obj_type C 16 0 model_object_type
conf F 10 4 confidence
x F 18 4 x
y F 18 4 y
z F 18 4 z
det_id C 20 0 detection_id
support_id C 20 0 support_id
img_name C 80 0 image_name
img_time C 26 0 timestamp_iso
pt_count N 50 0 point_count
las_file C 100 0 point_crop_path
pose_fmt C 16 0 pose_format
gps_week N 8 0 gps_week
pc_src C 8 0 pointcloud_source
calib_id C 12 0 calibration_sha256
run_id C 12 0 run_fingerprint
bbox_l F 18 4 bbox_left
bbox_t F 18 4 bbox_top
bbox_r F 18 4 bbox_right
bbox_b F 18 4 bbox_bottom
pano_w N 10 0 panorama_width
pano_h N 10 0 panorama_height
"""
POLE_FIELDS = """
class_id N 50 0 class_id
class_nm C 40 0 class_name
model_nm C 80 0 model_name
obj_type C 16 0 model_object_type
conf F 10 4 confidence
x F 18 4 x
y F 18 4 y
z F 18 4 z
det_id C 20 0 detection_id
support_id C 20 0 support_id
pole_type C 12 0 pole_type
method C 28 0 pole_method
status C 12 0 pole_status
reconciled L 1 0 support_reconciled
repl_rem L 1 0 support_reconciled_replaced_remote
hyp_dist F 10 4 support_hypothesis_distance_m
occluded L 1 0 pole_occluded
occ_state C 16 0 pole_occlusion_status
pole_cnt N 50 0 pole_count
obs_count N 50 0 obs_count
det_count N 50 0 detection_count
occl_cnt N 50 0 occluded_count
unk_occ N 50 0 unknown_occlusion_count
pt_count N 50 0 pole_point_count
axis_rmse F 10 4 axis_rmse_m
grnd_rmse F 10 4 ground_rmse_m
axis_stab L 1 0 axis_stabilized
btm_gap F 10 4 bottom_gap_m
grnd_dist F 10 4 ground_support_distance_m
assoc_m F 10 4 association_distance_m
arm_cov F 10 4 arm_coverage
arm_3d F 10 4 arm_line_coverage
arm_ratio F 10 4 arm_line_ratio
arm_pts F 10 4 arm_line_share
arm_end L 1 0 arm_anchored
complete F 10 4 completeness_ratio
dom_class N 5 0 dominant_class_id
cls_purity F 10 4 dominant_class_fraction
class_req C 8 0 classification_mode_requested
class_mode C 10 0 classification_mode
search_md C 40 0 pole_search_mode
fallback L 1 0 pole_fallback_used
xy_spread F 10 4 xy_spread_m
z_spread F 10 4 z_spread_m
outlier_n N 10 0 consensus_outlier_count
img_name C 80 0 image_name
img_time C 26 0 timestamp_iso
las_file C 100 0 pole_point_crop_path
run_id C 12 0 run_fingerprint
"""
_KINDS = {"C": "string", "F": "double", "L": "boolean", "N": "long"}


def _fields(text: str) -> list[tuple[str, str, int, int, str]]:
    return [(n, k, int(w), int(d), source) for n, k, w, d, source in (line.split() for line in text.split("\n") if line)]


def _attributes(df: DataFrame, text: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """df's columns as a layer's attributes; columns that df lacks are null. Texts are cut, null
    texts empty; of files their names alone count."""
    out = []
    for name, kind, width, _, source in _fields(text):
        value = df[source] if source in df.columns else F.lit(None)
        value = value.cast(_KINDS[kind])
        if source.endswith("_path"):
            value = F.element_at(F.split(value, r"[/\\]"), -1)
        if name in (defaults or {}):
            value = F.coalesce(value, defaults[name])
        out.append((F.substring(F.coalesce(value, F.lit("")), 1, width) if kind == "C" else value).alias(name))
    return df.select(*out)


def sign_layer(signs: DataFrame) -> DataFrame:
    """Signs with a place as rows of the published layer; `bbox` (left, top, right, bottom) may
    stand for its four columns."""
    if "bbox" in signs.columns:
        whole = F.size("bbox") == 4
        signs = signs.withColumns({f"bbox_{side}": F.when(whole, F.get("bbox", F.lit(i))) for i, side in enumerate(("left", "top", "right", "bottom"))})
    return _attributes(signs.filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL"), SIGN_FIELDS)


def pole_layer(poles: DataFrame) -> DataFrame:
    """Supports (pole_x, pole_y, pole_z) as rows of the published layer. Counts default to one
    observation; the state of the foot and its counts follow from pole_occluded if not given."""
    own = poles.withColumns({a: F.col(f"pole_{a}") for a in "xyz"}).filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    hidden = F.col("pole_occluded") if "pole_occluded" in own.columns else F.lit(None).cast("boolean")
    seen = F.coalesce(F.nullif(F.col("obs_count"), F.lit(0)), F.lit(1)) if "obs_count" in own.columns else F.lit(1)
    zero, no = F.lit(0).cast("long"), F.lit(False)
    defaults = {
        "class_id": F.lit(-1).cast("long"), "conf": F.lit(0.0), "reconciled": no, "repl_rem": no, "occ_state": F.when(hidden, "OCCLUDED").when(~hidden, "VISIBLE").otherwise("UNKNOWN"), "pole_cnt": zero, "obs_count": F.lit(1).cast("long"),
        "det_count": seen.cast("long"), "occl_cnt": F.coalesce(hidden, no).cast("long"), "unk_occ": hidden.isNull().cast("long"), "pt_count": zero, "outlier_n": zero,
    }
    return _attributes(own, POLE_FIELDS, defaults)


def recover(root: str) -> int:
    """Undoes publications that a crash cut short and removes what they had staged; returns how
    many. One process publishes under a root at a time."""
    store, at = store_of(root.rstrip("/"))
    if not _there(store, at):
        return 0
    found = [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.base_name.startswith(".publish-") and f.base_name.endswith(".journal")]
    for journal in found:
        undo(store, journal)
    for f in store.get_file_info(fs.FileSelector(at)):
        if f.base_name.startswith(".publishing-"):
            store.delete_dir(f.path)
    return len(found)


def publish(spark: SparkSession, root: str, signs: DataFrame, poles: DataFrame, wkt: str = "") -> None:
    """Both layers under root (signs and poles) as one: staged in full by Spark's tasks, then
    moved together. If anything fails, the layers before stay as they were, and readers never
    meet the signs of one run with the supports of another."""
    register(spark)
    root = root.rstrip("/")
    store, at = store_of(root)
    store.create_dir(at)
    recover(root)
    stage = f".publishing-{uuid.uuid4().hex}"
    try:
        for name, rows, text in (("signs", sign_layer(signs), SIGN_FIELDS), ("poles", pole_layer(poles), POLE_FIELDS)):
            fields = json.dumps([f[:4] for f in _fields(text)])
            rows.write.format("waymark_layer").option("fields", fields).option("wkt", wkt).mode("append").save(f"{root}/{stage}/{name}")
        swap(store, [(f"{at}/{stage}/{n}", f"{at}/{n}") for n in ("signs", "poles")], f"{at}/.publish-{uuid.uuid4().hex}.journal")
    except Exception:
        recover(root)
        raise
    store.delete_dir(f"{at}/{stage}")
