"""Binary previews of the points around frames, and derived LAS crops: one value a frame, made
inside grouped Arrow functions from budgeted samples, so a group has a fixed bound."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.sequences import even_sample
from waymark.sources.pointclouds import ATTRIBUTES, encode_las

#: Fixed values of the preview format: a 40-byte header, then 15 bytes a point.
HEAD = struct.Struct("<4sHHI6fI")
POINT = np.dtype([("at", "<f4", (3,)), ("rgb", "u1", (3,))])
SPACE, SCREEN, VERSION = b"MMSP", b"MMSO", 1


def encode(kind: bytes, at: np.ndarray, rgb: np.ndarray) -> bytes:
    """kind SPACE: offsets from the frame; SCREEN: u, v and distance."""
    at = np.asarray(at, "<f4").reshape(-1, 3)
    low, high = (at.min(0), at.max(0)) if len(at) else (np.zeros(3), np.zeros(3))
    rows = np.empty(len(at), POINT)
    rows["at"], rows["rgb"] = at, rgb
    return HEAD.pack(kind, VERSION, 1 if kind == SPACE else 3, len(at), *low.tolist(), *high.tolist(), 0) + rows.tobytes()


def decode(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    kind, _, _, n, *_ = HEAD.unpack_from(data)
    rows = np.frombuffer(data, POINT, n, HEAD.size)
    return kind, rows["at"], rows["rgb"]


def _encoder(kind: bytes) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("point_id", kind="stable")
        return pd.DataFrame({"frame_id": [p["frame_id"].iloc[0]], "points": [len(p)], "preview": [encode(kind, p[["a", "b", "c"]].to_numpy(float), p[["red", "green", "blue"]].to_numpy(np.uint8))]})

    return run


def previews(points: DataFrame, kind: bytes, at: tuple[Column, Column, Column], budget: int) -> DataFrame:
    """points: frame_id, point_id, red, green, blue and what `at` uses. An even sample of
    `budget` points a frame (the feature), as one binary value."""
    own = points.select("frame_id", "point_id", *[c.cast("double").alias(n) for c, n in zip(at, "abc")], "red", "green", "blue")
    few = even_sample(own, ("frame_id",), ["point_id"], F.lit(budget))
    return few.groupBy("frame_id").applyInPandas(_encoder(kind), "frame_id long, points long, preview binary")


def las_crops(points: DataFrame) -> DataFrame:
    """points: crop_id, x, y, z, red, green, blue and any of ATTRIBUTES (a bounded crop each).
    crop_id and a LAS file, with attributes in point format 7."""
    more = [n for n in ATTRIBUTES if n in points.columns]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        extra = {n: p[n].to_numpy(float) for n in more} or None
        return pd.DataFrame({"crop_id": [p["crop_id"].iloc[0]], "las": [encode_las(p[["x", "y", "z"]].to_numpy(float), p[["red", "green", "blue"]].to_numpy(np.int64), attributes=extra)]})

    return points.select("crop_id", "x", "y", "z", "red", "green", "blue", *more).groupBy("crop_id").applyInPandas(run, "crop_id long, las binary")
