"""Work on near rows by tiles many times as wide as the radius: a row moves once, to its tile, and
what a tile holds whole is finished there. What reaches its edge, and tiles that are crowded, are
left to joins. Both kinds of rows come from one pass, packed into one small checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.operators.components import roots, shared_checkpoint
from waymark.operators.spatial import cell

#: Radii along a tile's side.
SIDE = 256
#: Rows and near candidates of a tile that a task may take whole.
TILE_ROWS, TILE_PAIRS = 100_000, 2_000_000
#: Rows after which whole tiles are solved, and so those of a packed cell.
BATCH_ROWS = 65_536

#: Takes rows of whole tiles, pairs a < b of near rows and which rows have to be left; returns what
#: is finished and all rows that are left.
Solve = Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], tuple[pa.Table, np.ndarray]]


def numbers(column: pa.ChunkedArray, null: float = 0) -> np.ndarray:
    return column.combine_chunks().fill_null(null).to_numpy(zero_copy_only=False)


def codes(column: pa.ChunkedArray, none: tuple[str, ...] = ()) -> tuple[np.ndarray, list]:
    """Numbers of a text column and its texts by number; nulls and what trims to `none` are -1."""
    found = column.combine_chunks().dictionary_encode()
    texts = found.dictionary.to_pylist()
    at = found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    new = np.array([-1 if t.strip(" ") in none else k for k, t in enumerate(texts)] + [-1], np.int64)
    return new[at], texts


def reached(n: int, a: np.ndarray, b: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(component of each of n rows by its least row, rows whose component holds one of some)."""
    root = np.arange(n)
    if len(a):
        node, least = roots(a, b)
        root[node] = least
    held = np.zeros(n, bool)
    held[root[some]] = True
    return root, held[root]


def _ranges(tile: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by tile and cell, and for each, as two ranges of that order, the later rows of
    its own and the four next cells. tile: -1 for rows that are near nothing."""
    own = np.flatnonzero(tile >= 0)
    cx, cy = np.floor(x[own] / radius).astype(np.int64), np.floor(y[own] / radius).astype(np.int64)
    start = np.flatnonzero(np.r_[True, tile[own][1:] != tile[own][:-1]]) if len(own) else own
    size = np.diff(np.r_[start, len(own)])
    for c in (cx, cy):
        if len(own):
            c -= np.repeat(np.minimum.reduceat(c, start), size) - 1
    width = int(max(cx.max(initial=0), cy.max(initial=0))) + 3
    key = (tile[own] * width + cx) * width + cy
    order = np.argsort(key, kind="stable")
    own, key = own[order], key[order]
    at = lambda k, side: np.searchsorted(key, k, side)
    low = np.stack([np.arange(1, len(own) + 1), at(key + width - 1, "left")])
    return own, low, np.stack([at(key + 1, "right"), at(key + width + 1, "right")])


def near_rows(tile: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of whole tiles (rows start to end, tiles ascend) with the pairs a < b of rows of a tile
    within radius, counted from start, and which rows are of tiles with more than `most` candidates,
    which have no pairs here. A run has twice as many candidates at most."""
    own, low, high = _ranges(np.where(np.isfinite(x) & np.isfinite(y), tile, -1), x, y, radius)
    count = (high - low).sum(0)
    per = np.bincount(tile[own], weights=count, minlength=int(tile[-1]) + 1)
    crowded = per > most
    run = (np.cumsum(np.where(crowded, 0, per)) // max(most, 1))[tile]
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    for start, end in zip(starts, np.r_[starts[1:], len(run)]):
        i, j = np.searchsorted(tile[own], tile[start], "left"), np.searchsorted(tile[own], tile[end - 1], "right")
        mine = np.flatnonzero(~crowded[tile[own[i:j]]]) + i
        pairs = []
        for lo, hi in zip(low[:, mine], high[:, mine]):
            n = hi - lo
            a = np.repeat(own[mine], n)
            b = own[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            near = (x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2 <= radius * radius
            pairs.append((a[near] - start, b[near] - start))
        a, b = (np.concatenate(p) for p in zip(*pairs))
        yield int(start), int(end), np.minimum(a, b), np.maximum(a, b), crowded[tile[start:end]]


def _packed(table: pa.Table, kind: int) -> pa.RecordBatch:
    cell_ = BytesIO()
    pq.write_table(table, cell_, compression="zstd")
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([cell_.getvalue()], pa.binary())], names=["kind", "body"])


def _pass(solve: Solve, columns: list[str], dims: tuple[str, str], radius: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        tile, edge = np.cumsum(numbers(t["__first"], False)) - 1, numbers(t["__edge"], True)
        x, y = (numbers(t[d], float("nan")).astype(float) for d in dims)
        x = np.where(numbers(t["__good"], False) & (np.maximum(np.abs(x), np.abs(y)) <= 1e15), x, np.nan)
        done, left = [], []
        t = t.select(columns)
        for start, end, a, b, crowded in near_rows(tile, x, y, radius, TILE_PAIRS):
            rows = t.slice(start, end - start)
            found, open_ = solve(rows, a, b, edge[start:end] | crowded)
            done.append(found)
            left.append(rows.filter(pa.array(open_)))
        for kind, tables in enumerate((done, left)):
            if (table := pa.concat_tables(tables)).num_rows:
                yield _packed(table, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, tail, crowded = [], [], False  # whole tiles; the tile that may go on, and if it is crowded
        count = lambda parts: sum(p.num_rows for p in parts)
        left = lambda parts: _packed(pa.Table.from_batches(parts).select(columns), 1)
        for batch in batches:
            first = np.flatnonzero(numbers(pa.chunked_array([batch.column("__first")]), False))
            if len(first):
                if first[0]:
                    tail.append(batch.slice(0, first[0]))
                if crowded and tail:
                    yield left(tail)
                elif tail:
                    ready += tail
                crowded, tail = False, [batch.slice(first[-1])]
                if first[-1] > first[0]:
                    ready.append(batch.slice(first[0], first[-1] - first[0]))
            elif batch.num_rows:
                tail.append(batch)
            if crowded or count(tail) > TILE_ROWS:
                crowded = True
                if tail:
                    yield left(tail)
                tail = []
            if count(ready) >= BATCH_ROWS:
                yield from whole(ready)
                ready = []
        if tail:
            ready += tail
        if ready:
            yield from whole(ready)

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body in batch.column("body"):
            yield from pq.read_table(pa.BufferReader(body.as_buffer())).to_batches(max_chunksize=10_000)


def by_tiles(rows: DataFrame, dims: tuple[str, str], radius: float, within: tuple[str, ...], order: tuple[str, ...], solve: Solve, schema: str, left: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(what solve finishes, rows it leaves, or None). Rows of equal `within` in one tile come to solve in
    `order`; those without a place or a `within` are near nothing. left: rows to leave in any case.
    Rows near an edge, and those of crowded tiles, are told to solve as left; it has to leave all
    that is linked to them, too."""
    side = SIDE * radius
    columns = rows.columns
    good = F.lit(True)
    for d in dims:
        good = good & F.coalesce(F.abs(F.col(d)) < float("inf"), F.lit(False))
    for c in within:
        good = good & F.col(c).isNotNull()
    tiles = [f"__t{i}" for i in range(len(dims))]
    edge = F.lit(False) if left is None else F.coalesce(left, F.lit(True))
    for d, t in zip(dims, tiles):
        reach = radius * (1 + 1e-6) + 1e-14 * F.abs(F.col(d))
        edge = edge | (good & ((F.col(d) - F.col(t) * side <= reach) | ((F.col(t) + 1) * side - F.col(d) <= reach) | (F.abs(F.col(d)) > 1e15)))
    placed = rows.withColumns({t: F.when(good, cell(F.col(d), side)).otherwise(F.xxhash64(*order)) for d, t in zip(dims, tiles)})
    numbered = placed.withColumn("__k", F.row_number().over(W.partitionBy(*within, *tiles).orderBy(*order)))
    sent = numbered.select((F.col("__k") == 1).alias("__first"), good.alias("__good"), edge.alias("__edge"), *columns)
    packed = shared_checkpoint(sent.mapInArrow(_pass(solve, columns, dims, radius), "kind int, body binary"))
    part = lambda kind, names: packed.filter(F.col("kind") == kind).select("body").mapInArrow(_unpack, names)
    rest = part(1, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields))
    return part(0, schema), None if packed.filter("kind = 1").isEmpty() else rest
