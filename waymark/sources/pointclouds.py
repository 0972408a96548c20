"""Point clouds: block files (SQLite with packed blobs) and LAS, decoded in Arrow batches.

Files come through Spark's binaryFile reader, so any store Spark reads will do; a file is one
row and must be under 2 GB (deliveries are split well below that). Index scans give blocks with
bounds; point scans give the points of the wanted files alone."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the block format.
HEADER = struct.Struct("<6dI")
RECORD = np.dtype([("d", "<f4", 3), ("rgb", "u1", 3), ("intensity", "<u2")])
#: Bytes of a LAS point by format, for formats 0 to 10.
LAS_SIZES = (20, 28, 26, 34, 57, 63, 30, 36, 38, 59, 67)
CHUNK = 250_000

POINTS = "path string, block string, x double, y double, z double, red int, green int, blue int, intensity int, classification int, gps_time double, return_number int, number_of_returns int, source_index long"
BLOCKS = "path string, source_type string, block string, start long, n long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")


def cubes(content: bytes) -> list[tuple[str, bytes]]:
    """Names and blobs of a block file, in name order."""
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(content)
        return [(n, bytes(b)) for n, b in db.execute("SELECT NAME, DATA FROM CRYSTAL_CUBE WHERE NAME LIKE '%.bpc' ORDER BY NAME")]
    finally:
        db.close()


def decode_block(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Points of a blob: offsets from the block's centre, as many as its bytes hold."""
    *box, count = HEADER.unpack_from(blob)
    count = min(count, (len(blob) - HEADER.size) // RECORD.itemsize)
    raw = np.frombuffer(blob, RECORD, count, HEADER.size)
    low, high = np.array(box[:3]), np.array(box[3:])
    return raw["d"].astype(np.float64) + (low + high) / 2, raw


def encode_block(xyz: np.ndarray, rgb: np.ndarray, intensity: np.ndarray) -> bytes:
    low, high = xyz.min(0), xyz.max(0)
    raw = np.zeros(len(xyz), RECORD)
    raw["d"], raw["rgb"], raw["intensity"] = xyz - (low + high) / 2, rgb, intensity
    return HEADER.pack(*low, *high, len(xyz)) + raw.tobytes()


class Las:
    """Header and points of a LAS file; `length` is the file's size where content is its head alone."""

    def __init__(self, content: bytes, length: int | None = None) -> None:
        if content[:4] != b"LASF":
            raise ValueError("not a LAS file")
        self.content = content
        self.minor = content[25]
        self.at, = struct.unpack_from("<I", content, 96)
        self.format, self.size = content[104] & 63, struct.unpack_from("<H", content, 105)[0]
        self.count = struct.unpack_from("<Q", content, 247)[0] if self.minor >= 4 else struct.unpack_from("<I", content, 107)[0]
        values = struct.unpack_from("<12d", content, 131)
        self.scale, self.offset = np.array(values[:3]), np.array(values[3:6])
        self.low, self.high = np.array(struct.unpack_from("<6d", content, 179)).reshape(3, 2).T[::-1]
        self.count = min(self.count, max(0, (length or len(content)) - self.at) // max(1, self.size))

    def dtype(self) -> np.dtype:
        f, new = self.format, self.format >= 6
        fields = [("xyz", "<i4", 3, 0), ("intensity", "<u2", 1, 12)]
        fields += [("returns", "u1", 1, 14), ("cls", "u1", 1, 16 if new else 15)]
        if new or f in (1, 3, 4, 5):
            fields.append(("time", "<f8", 1, 22 if new else 20))
        if f in (2, 3, 5, 7, 8, 10):
            fields.append(("rgb", "<u2", 3, {2: 20, 3: 28, 5: 28}.get(f, 30)))
        return np.dtype({"names": [x[0] for x in fields], "formats": [(x[1], x[2]) if x[2] > 1 else x[1] for x in fields], "offsets": [x[3] for x in fields], "itemsize": self.size})

    def read(self, start: int, count: int) -> dict[str, np.ndarray]:
        return self.decode(np.frombuffer(self.content, self.dtype(), max(0, min(count, self.count - start)), self.at + start * self.size))

    def decode(self, raw: np.ndarray) -> dict[str, np.ndarray]:
        n, new = len(raw), self.format >= 6
        returns = raw["returns"]
        rgb = raw["rgb"].astype(np.int64) if "rgb" in raw.dtype.names else np.full((n, 3), -1)
        small = np.where(rgb < 0, 128, (rgb + 128) // 257 if (rgb > 255).any() else rgb)
        return {
            "xyz": raw["xyz"] * self.scale + self.offset, "rgb": small, "intensity": raw["intensity"].astype(np.int64), "classification": (raw["cls"] if new else raw["cls"] & 31).astype(np.int64),
            "gps_time": raw["time"] if "time" in raw.dtype.names else np.full(n, np.nan), "return_number": (returns & (15 if new else 7)).astype(np.int64), "number_of_returns": (returns >> (4 if new else 3) & (15 if new else 7)).astype(np.int64),
        }


#: What format 7 keeps of a point besides place and colour.
ATTRIBUTES = ("intensity", "classification", "gps_time", "return_number", "number_of_returns")


def encode_las(xyz: np.ndarray, rgb: np.ndarray, scale: float = 0.001, attributes: dict[str, np.ndarray] | None = None) -> bytes:
    """LAS 1.4: offset at the least corner, 8-bit colours times 257. Point format 2, or 7 with
    attributes (those of ATTRIBUTES; missing ones and missing values are zero)."""
    offset = xyz.min(0) if len(xyz) else np.zeros(3)
    if attributes is None:
        kind, dtype = 2, np.dtype({"names": ["xyz", "rgb"], "formats": [("<i4", 3), ("<u2", 3)], "offsets": [0, 20], "itemsize": 26})
    else:
        kind, dtype = 7, np.dtype({"names": ["xyz", "intensity", "returns", "cls", "time", "rgb"], "formats": [("<i4", 3), "<u2", "u1", "u1", "<f8", ("<u2", 3)], "offsets": [0, 12, 14, 16, 22, 30], "itemsize": 36})
    raw = np.zeros(len(xyz), dtype)
    raw["xyz"], raw["rgb"] = np.rint((xyz - offset) / scale), np.asarray(rgb, np.int64) * 257
    if attributes is not None:
        own = {n: np.nan_to_num(np.asarray(attributes.get(n, np.zeros(len(xyz))), float)) for n in ATTRIBUTES}
        whole = {n: np.clip(own[n], 0, top).astype(np.int64) for n, top in (("intensity", 65535), ("classification", 255), ("return_number", 15), ("number_of_returns", 15))}
        raw["intensity"], raw["cls"], raw["time"] = whole["intensity"], whole["classification"], own["gps_time"]
        raw["returns"] = whole["return_number"] | whole["number_of_returns"] << 4
    head = bytearray(375)
    head[0:4], head[24:26], head[104] = b"LASF", bytes((1, 4)), kind
    struct.pack_into("<H", head, 94, 375)
    struct.pack_into("<I", head, 96, 375)
    struct.pack_into("<H", head, 105, dtype.itemsize)
    if kind < 6:  # newer formats have the wide count alone
        struct.pack_into("<I", head, 107, min(len(xyz), 2**32 - 1))
    struct.pack_into("<6d", head, 131, *[scale] * 3, *offset)
    high = xyz.max(0) if len(xyz) else offset
    struct.pack_into("<6d", head, 179, high[0], offset[0], high[1], offset[1], high[2], offset[2])
    struct.pack_into("<Q", head, 247, len(xyz))
    return bytes(head) + raw.tobytes()


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    names, types = zip(*[c.split() for c in schema.split(", ")])
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types)], names=list(names))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows: list[tuple] = []
            if content[:4] == b"LASF":
                las = Las(content)
                for start in range(0, las.count, CHUNK):
                    xyz = las.read(start, CHUNK)["xyz"]
                    rows.append((path, "las", f"las:{start}:{len(xyz)}", start, len(xyz), *xyz.min(0).tolist(), *xyz.max(0).tolist()))
            else:
                for name, blob in cubes(content):
                    if len(blob) >= HEADER.size:
                        *box, count = HEADER.unpack_from(blob)
                        rows.append((path, "pcdb", name, 0, count, *box))
            yield _table(rows, BLOCKS)


def scan_index(spark: SparkSession, root: str, pattern: str = "*.{las,LAS,pcdb,PCDB}") -> DataFrame:
    """Blocks with bounds: the pruning index of a catalog."""
    return files(spark, root, pattern).mapInArrow(_index, BLOCKS)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(path, block, xyz, rgb, intensity, cls, time, rn, nr, index) -> pa.RecordBatch:
        n = len(xyz)
        cols = [pa.array([path] * n), pa.array([block] * n), *[pa.array(xyz[:, i]) for i in range(3)], *[pa.array(rgb[:, i].astype(np.int32)) for i in range(3)], pa.array(intensity.astype(np.int32)), pa.array(cls.astype(np.int32)), pa.array(time), pa.array(rn.astype(np.int32)), pa.array(nr.astype(np.int32)), pa.array(index)]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in POINTS.split(", ")])

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if content[:4] == b"LASF":
                las = Las(content)
                for start in range(0, las.count, CHUNK):
                    p = las.read(start, CHUNK)
                    yield batch_of(path, f"las:{start}:{len(p['xyz'])}", p["xyz"], p["rgb"], p["intensity"], p["classification"], p["gps_time"], p["return_number"], p["number_of_returns"], np.arange(start, start + len(p["xyz"])))
            else:
                for name, blob in cubes(content):
                    if len(blob) >= HEADER.size:
                        xyz, raw = decode_block(blob)
                        n = len(xyz)
                        yield batch_of(path, name, xyz, raw["rgb"], raw["intensity"], np.full(n, -1), np.full(n, np.nan), np.zeros(n), np.zeros(n), np.full(n, -1, np.int64))


def read_points(spark: SparkSession, root: str, pattern: str = "*.{las,LAS,pcdb,PCDB}") -> DataFrame:
    """Points; what a format lacks is -1 (class, index), NaN (time), 0 (returns) or 128 (colour)."""
    return files(spark, root, pattern).mapInArrow(_points, POINTS)
