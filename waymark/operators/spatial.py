"""Spatial joins that plan as equi-joins on grid cells, with the exact test on top.

A plain distance predicate plans as a nested loop; a cell equality plans as a hash or
sort-merge join, which AQE can split where a cell is hot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.vectors import Vec
from waymark.operators.geometry import cone_hit


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def around(x: Column, size: float, reach: float) -> Column:
    """Array of the cells within reach of x."""
    return F.sequence(cell(x - reach, size), cell(x + reach, size))


def radius_join(left: DataFrame, right: DataFrame, left_xy: tuple[str, str], right_xy: tuple[str, str], radius: float, size: float | None = None) -> DataFrame:
    """Pairs within an exact XY radius. The left side is copied to the cells it reaches (nine
    at most, as cells are as wide as the radius); the right side stays in its own."""
    size = max(size or radius, radius)
    (lx, ly), (rx, ry) = left_xy, right_xy
    a = left.withColumn("__cx", F.explode(around(F.col(lx), size, radius))).withColumn("__cy", F.explode(around(F.col(ly), size, radius)))
    b = right.withColumn("__cx", cell(F.col(rx), size)).withColumn("__cy", cell(F.col(ry), size))
    dx, dy = F.col(rx) - F.col(lx), F.col(ry) - F.col(ly)
    return a.join(b, ["__cx", "__cy"]).filter(dx * dx + dy * dy <= radius * radius).drop("__cx", "__cy")


def cells_of_box(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """Array of (cx, cy) that a box touches."""
    xs, ys = F.sequence(cell(x0, size), cell(x1, size)), F.sequence(cell(y0, size), cell(y1, size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def box_join(left: DataFrame, right: DataFrame, left_box: tuple[str, ...], right_box: tuple[str, ...], size: float, keys: tuple[str, ...]) -> DataFrame:
    """Pairs of overlapping boxes (x0, y0, x1, y1). A pair meets in each shared cell but is
    kept in one alone: the first cell of its overlap."""
    a = left.withColumn("__c", F.explode(cells_of_box(*[F.col(c) for c in left_box], size)))
    b = right.withColumn("__c", F.explode(cells_of_box(*[F.col(c) for c in right_box], size)))
    x0, y0, x1, y1 = (F.col(c) for c in left_box)
    u0, v0, u1, v1 = (F.col(c) for c in right_box)
    first = (F.col("__c.cx") == cell(F.greatest(x0, u0), size)) & (F.col("__c.cy") == cell(F.greatest(y0, v0), size))
    return a.join(b, ["__c", *keys]).filter((x0 <= u1) & (u0 <= x1) & (y0 <= v1) & (v0 <= y1) & first).drop("__c")


#: Cells of points and their boxes (boxes are a few units high, so cells are low), tasks that
#: share a cell's boxes, and pairs tested at a time.
ELLIPSE_CELL, ELLIPSE_SHARES, ELLIPSE_PAIRS = (32.0, 8.0), 4, 1 << 18


def points_in_ellipses(boxes: DataFrame, points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, n, first_point: how many points (kind, x, y, point_id) lie in the ellipse of each box
    (keys, kind, x0, y0, x1, y1) of their kind, and the least id. Boxes and points move to
    cells, points first; boxes stream past the points of their cell, sorted by x, so that no pair
    becomes a row."""
    w, h = ELLIPSE_CELL
    own = [F.col("kind").cast("long").alias("kind"), "cx", "cy"]
    b = boxes.withColumn("cx", F.explode(F.sequence(cell(F.col("x0"), w), cell(F.col("x1"), w)))).withColumn("cy", F.explode(F.sequence(cell(F.col("y0"), h), cell(F.col("y1"), h))))
    b = b.filter("kind IS NOT NULL").select(*own, F.pmod(F.xxhash64(*keys, "x0", "y0"), F.lit(ELLIPSE_SHARES)).alias("share"), F.lit(1).alias("side"), "x0", "y0", "x1", "y1", F.lit(0).cast("long").alias("id"), *keys)
    p = points.filter("kind IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").withColumn("cx", cell(F.col("x"), w)).withColumn("cy", cell(F.col("y"), h))
    p = p.select(*own, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ELLIPSE_SHARES - 1).cast("long"))).alias("share"), F.lit(0).alias("side"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("point_id").cast("long").alias("id"), *[F.lit(None).cast(boxes.schema[k].dataType).alias(k) for k in keys])
    at = ["kind", "cx", "cy", "share"]
    met = p.unionByName(b).repartition(*at).sortWithinPartitions(*at, "side")
    kinds = ", ".join(f"`{k}` {boxes.schema[k].dataType.simpleString()}" for k in keys)
    return met.mapInArrow(_inside, f"{kinds}, n long, first_point long").groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first_point").alias("first_point"))


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (4 of the cell, side, 4 of the box or point, id, keys) by cell, points before boxes."""
    now, parts, held = None, [], None
    for batch in batches:
        *head, side, x0, y0, x1, y1, ids = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(10)]
        head = np.stack(head)
        change = (head[:, 1:] != head[:, :-1]).any(0) | (side[1:] != side[:-1])
        edges = np.flatnonzero(np.r_[len(batch) > 0, change]).tolist()
        out = []
        for a, b in zip(edges, [*edges[1:], len(batch)]):
            if (this := tuple(head[:, a].tolist())) != now:
                now, parts, held = this, [], None
            if not side[a]:
                parts.append((x0[a:b], y0[a:b], ids[a:b]))
            elif parts:
                if held is None:
                    px, py, pid = map(np.concatenate, zip(*parts))
                    order = np.argsort(px, kind="stable")
                    held = px[order], py[order], pid[order]
                out += [(rows + a, n, first) for rows, n, first in _tested(held, x0[a:b], y0[a:b], x1[a:b], y1[a:b])]
        if out:
            rows, n, first = map(np.concatenate, zip(*out))
            cols = [batch.column(i).take(pa.array(rows)) for i in range(10, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n), pa.array(first)], names=[*batch.schema.names[10:], "n", "first_point"])


def _tested(points: tuple, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(box, points inside, least id) of the boxes that have any; points are sorted by x."""
    px, py, pid = points
    begin, end = np.searchsorted(px, x0, "left"), np.searchsorted(px, x1, "right")
    some = np.flatnonzero(end > begin)
    size = (end - begin)[some]
    ends = np.cumsum(size)
    i = 0
    while i < len(some):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + ELLIPSE_PAIRS, "right")))
        box, n = some[i:j], size[i:j]
        start = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(begin[box] - start, n)
        each = lambda v: np.repeat(v[box], n)  # noqa: E731, B023
        y = py[at]
        ex, ey = (px[at] - each((x0 + x1) / 2)) / each((x1 - x0) / 2), (y - each((y0 + y1) / 2)) / each((y1 - y0) / 2)
        inside = (ex * ex + ey * ey <= 1) & (y >= each(y0)) & (y <= each(y1))
        count = np.add.reduceat(inside.astype(np.int64), start)
        first = np.minimum.reduceat(np.where(inside, pid[at], np.iinfo(np.int64).max), start)
        hit = np.flatnonzero(count)
        yield box[hit], count[hit], first[hit]
        i = j


def cone_join(views: DataFrame, blocks: DataFrame, origin: Vec, ray: Vec, angle: Column, margin: float, reach: float, size: float) -> DataFrame:
    """Blocks (min_x .. max_z) that each view's cone can meet: cells within reach, then the
    exact cone test."""
    a = views.withColumn("__cx", F.explode(around(origin[0], size, reach))).withColumn("__cy", F.explode(around(origin[1], size, reach)))
    half = F.sqrt(sum((F.col(f"max_{c}") - F.col(f"min_{c}")) ** 2 for c in "xyz")) / 2
    mid = [(F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in "xy"]
    # the test takes a block as a ball, so its cells are those of the ball
    b = blocks.withColumn("__c", F.explode(cells_of_box(mid[0] - half, mid[1] - half, mid[0] + half, mid[1] + half, size)))
    b = b.withColumn("__cx", F.col("__c.cx")).withColumn("__cy", F.col("__c.cy")).drop("__c")
    low, high = tuple(F.col(f"min_{c}") for c in "xyz"), tuple(F.col(f"max_{c}") for c in "xyz")
    hit = a.join(b, ["__cx", "__cy"]).filter(cone_hit(low, high, origin, ray, angle, margin, reach))  # type: ignore[arg-type]
    keys = [c for c in hit.columns if not c.startswith("__")]
    return hit.select(*keys).distinct()  # a ball in several cells of a view meets it once
