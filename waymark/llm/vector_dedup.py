"""Embedding near-dedup over a robust-pruned flat graph.

1. Equal vectors become one node. Centroids come from a bounded sample (SAMPLE nodes, least
   hash first); each node joins the shards of its OVERLAP nearest centroids. Shards of over
   SPLIT times the wanted size are split again by centroids of their own, learned from SAMPLE
   of their members in a task each, so the number of shards grows with the input. Only shards
   whose members all lie within reach of each other stay whole.
2. In each shard every node gets candidates, from which robust pruning keeps at most DEGREE
   neighbours, none of them much nearer to a kept one than to the node; links are made mutual.
3. Adjacency lists of a node from all its shards are united.
4. In each shard all members search the graph at once: greedily from the medoid to their own
   surroundings, then on through every neighbour within reach while new nodes are in range.
   From there the search leaves the shard: the lists that a node found has from other shards
   name new nodes, as long as the triangle inequality allows them to be in range. These are
   followed over the united graph, round by round, until no new pair is found.
5. Pairs count if their cosine in double precision reaches the bound.
6. `audit` measures recall against brute force for a set of query nodes.

A pair within one shard counts where the first shard that both share is searched, so pairs
never are gathered to be told apart: `dedup` takes from each task the number of links by node
and a spanning forest, whose size is that of the nodes. Shards over `cap` nodes are split by
hash into blocks; each pair of blocks is one task, so no task holds more than two blocks.

Null vectors, vectors with null or non-finite components and zero vectors link with nothing;
vectors of different lengths don't link with each other. Equal vectors, and rows repeated with
the same id, link with each other. Null ids are kept; such rows count as links but never name a
component. Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.components import components, roots

from .common import kept

LEAST = 0.95
SAMPLE, SHARD, MAX_SHARDS, OVERLAP, CAP, SPLIT = 20_000, 1000, 4096, 3, 2000, 6
DEGREE, CANDIDATES, ALPHA, BEAM = 24, 48, 1.2, 16
#: Similarities taken in single precision keep this margin before the exact test.
MARGIN = 1e-4


def centroids(vectors: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the (hash-ordered) sample."""
    own = vectors[np.linspace(0, len(vectors) - 1, count).astype(int)]
    for _ in range(rounds):
        near = np.concatenate([(vectors[i : i + 4096] @ own.T).argmax(1) for i in range(0, len(vectors), 4096)])
        total = np.zeros_like(own)
        np.add.at(total, near, vectors)
        size = np.linalg.norm(total, axis=1)
        own = np.where(size[:, None] > 0, total / np.maximum(size, 1e-30)[:, None], own)
    return own


def build(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbours of each unit vector, mutual."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    k = min(CANDIDATES, n - 1)
    out = []
    for lo in range(0, n, 512):
        rows = np.arange(lo, min(n, lo + 512))
        sim = x[rows] @ x.T
        sim[np.arange(len(rows)), rows] = -2
        cand = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        own = np.take_along_axis(sim, cand, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        cand, own = np.take_along_axis(cand, order, 1), np.take_along_axis(own, order, 1)
        dist = 2 - 2 * own
        alive = np.ones(cand.shape, bool)
        chosen = np.zeros(cand.shape, bool)
        for j in range(k):  # candidate j is kept if alive; then it prunes those nearer to it
            take = alive[:, j] & (chosen.sum(1) < DEGREE)
            chosen[:, j] = take
            between = 2 - 2 * np.einsum("nd,nkd->nk", x[cand[:, j]], x[cand])
            gone = ALPHA * between <= dist
            alive &= ~(gone & take[:, None])
        out += [c[f] for c, f in zip(cand, chosen)]
    back = np.repeat(np.arange(n), [len(o) for o in out])
    to = np.concatenate(out)
    a, b = np.r_[back, to], np.r_[to, back]
    pairs = np.unique(a * n + b)
    a, b = pairs // n, pairs % n
    return np.split(b, np.searchsorted(a, np.arange(1, n)))


def _padded(lists: list[np.ndarray]) -> np.ndarray:
    width = max(1, max(map(len, lists), default=1))
    out = np.full((len(lists), width), -1, np.int64)
    for i, own in enumerate(lists):
        out[i, : len(own)] = own
    return out


def search(x: np.ndarray, graph: list[np.ndarray], queries: np.ndarray, least: float, beam: int = BEAM) -> np.ndarray:
    """Queries x nodes: True for all nodes found with similarity `least` or more, by greedy
    search from the medoid and then by expanding the range."""
    n, q = len(x), len(queries)
    nbr = _padded(graph)
    medoid = int(np.argmax(x @ x.mean(0)))
    found = np.zeros((q, n), bool)
    for lo in range(0, q, 512):
        own = queries[lo : lo + 512]
        m = len(own)
        hits = found[lo : lo + 512]
        seen = np.zeros((m, n), bool)
        ids = np.full((m, beam), -1, np.int64)
        sims = np.full((m, beam), -3.0)
        opened = np.ones((m, beam), bool)
        ids[:, 0], sims[:, 0], opened[:, 0] = medoid, own @ x[medoid], False
        seen[:, medoid] = True
        hits[sims[:, 0] >= least, medoid] = True
        while True:
            best = np.where(opened, -9, sims).argmax(1)
            rows = np.flatnonzero(~opened[np.arange(m), best])
            if not len(rows):
                break
            opened[rows, best[rows]] = True
            cand = nbr[ids[rows, best[rows]]]
            good = (cand >= 0) & ~seen[rows[:, None], cand]
            r, c = np.nonzero(good)
            node = cand[r, c]
            seen[rows[r], node] = True
            value = np.full(cand.shape, -3.0)
            value[r, c] = np.einsum("nd,nd->n", own[rows[r]], x[node])
            hit = value[r, c] >= least
            hits[rows[r[hit]], node[hit]] = True
            all_ids, all_sims = np.c_[ids[rows], cand], np.c_[sims[rows], value]
            all_open = np.c_[opened[rows], np.zeros(cand.shape, bool)]
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[rows], sims[rows] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1)
            opened[rows] = np.take_along_axis(all_open, top, 1) | (sims[rows] < -2)
        front = np.nonzero(hits)
        while len(front[0]):
            nxt = []
            for s in range(0, len(front[0]), 1 << 14):
                a, b = front[0][s : s + (1 << 14)], front[1][s : s + (1 << 14)]
                cand = nbr[b]
                r, c = np.nonzero((cand >= 0) & ~seen[a[:, None], cand])
                pair = np.unique(a[r] * n + cand[r, c])
                pa_, pb = pair // n, pair % n
                seen[pa_, pb] = True
                hit = np.einsum("nd,nd->n", own[pa_], x[pb]) >= least
                hits[pa_[hit], pb[hit]] = True
                nxt.append((pa_[hit], pb[hit]))
            front = np.concatenate([a for a, _ in nxt]), np.concatenate([b for _, b in nxt])
    return found


def _unit(column) -> np.ndarray:
    """Vectors of length 1; components are scaled first, so that no square over- or underflows."""
    x = np.array(column.tolist(), np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _adjacency(pdf: pd.DataFrame) -> pd.DataFrame:
    node, x = pdf["node"].to_numpy(), _unit(pdf["v"])
    graph = build(x)
    return pd.DataFrame({"shard": pdf["shard"], "node": node, "near": [node[g].tolist() for g in graph], "sim": [(x[g] @ x[i]).tolist() for i, g in enumerate(graph)]})


_FOUND = "kind int, a long, b long, n double"
PAIR, COUNT, BEYOND = 0, 1, 2


def _found(least: float, every_pair: bool):
    """Searches one shard, or a pair of its blocks. Rows: PAIR (a, b: linked nodes; all pairs
    that count here, or a spanning forest), COUNT (a: node, n: rows it is linked to here) and
    BEYOND (a: asking node, b: node of another shard that may be in range)."""
    reach = math.acos(least)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard, lo, hi = key
        base, asks = pdf[pdf["block"] == lo].reset_index(drop=True), pdf[pdf["block"] == hi].reset_index(drop=True)
        none = pd.DataFrame({"kind": [], "a": [], "b": [], "n": []}).astype({"kind": "int32", "a": "int64", "b": "int64", "n": "float64"})
        if not len(base) or not len(asks):
            return none
        x, node = _unit(base["v"]), base["node"].to_numpy()
        y, own = (x, node) if lo == hi else (_unit(asks["v"]), asks["node"].to_numpy())
        order = np.argsort(node)
        graph, beyond = [], []  # beyond: (place, shards of the list, nodes, angles)
        for i, lists in enumerate(base["lists"]):
            inner = [np.zeros(0, np.int64)]
            for part in lists if lists is not None else ():
                near = np.asarray(part["near"], np.int64)
                at = np.minimum(np.searchsorted(node[order], near), len(node) - 1)
                here = node[order][at] == near
                inner.append(order[at][here])
                if part["shard"] != shard:
                    angle = _angle(np.asarray(part["sim"], np.float64))
                    far = ~here & (angle <= 2 * reach + MARGIN)
                    if far.any():
                        beyond.append((i, part["shard"], near[far], angle[far]))
            graph.append(np.unique(np.concatenate(inner)))
        hits = search(x, graph, y, least - MARGIN)
        member, mine = np.array(base["shards"].tolist(), np.int64), np.array(asks["shards"].tolist(), np.int64)
        weight, weight_asks = base["rows"].to_numpy(float), asks["rows"].to_numpy(float)
        for s in range(0, len(y), 256):
            q, k = np.nonzero(hits[s : s + 256])
            q += s
            exact = (np.einsum("nd,nd->n", y[q], x[k]) >= least) & (own[q] != node[k])
            hits[q[~exact], k[~exact]] = False
        if lo == hi:
            hits |= hits.T
        out, label = [], np.zeros((0, 2), np.int64)
        counts, counts_asks = np.zeros(len(node)), np.zeros(len(own))
        for s in range(0, len(y), 256):
            q, k = np.nonzero(hits[s : s + 256])
            q += s
            shared = mine[q][:, :, None] == member[k][:, None, :]
            first = np.where(shared.any(2) & (mine[q] >= 0), mine[q], np.iinfo(np.int64).max).min(1) == shard
            np.add.at(counts_asks, q[first], weight[k[first]])
            if lo != hi:
                np.add.at(counts, k[first], weight_asks[q[first]])
            if every_pair:
                keep = first & ((own[q] > node[k]) | (lo != hi))
                a, b = own[q[keep]], node[k[keep]]
                out.append(pd.DataFrame({"kind": PAIR, "a": np.maximum(a, b), "b": np.minimum(a, b), "n": 0.0}))
            elif len(q):  # a forest of what is linked so far
                label = np.stack(roots(np.r_[own[q], label[:, 0]], np.r_[node[k], label[:, 1]]), 1)
        if not every_pair:
            label = label[label[:, 0] != label[:, 1]]
            out.append(pd.DataFrame({"kind": PAIR, "a": label[:, 0], "b": label[:, 1], "n": 0.0}))
            for ids, n in ((own, counts_asks), (node, counts)):
                out.append(pd.DataFrame({"kind": COUNT, "a": ids[n > 0], "b": 0, "n": n[n > 0]}))
        for i, other, near, angle in beyond:
            q = np.flatnonzero(hits[:, i] & ~(mine == other).any(1))
            if len(q):
                r, c = np.nonzero(angle[None, :] <= reach + _angle(y[q] @ x[i])[:, None] + MARGIN)
                out.append(pd.DataFrame({"kind": BEYOND, "a": own[q[r]], "b": near[c], "n": 0.0}))
        got = pd.concat(out) if out else none
        return got.drop_duplicates() if len(beyond) else got

    return run


def nodes_of(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """node, v, id (least), rows: the distinct vectors that can link."""
    v = F.transform(vectors[column], lambda x: x.cast("double"))
    good = vectors.select(vectors[key].alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0))
    good = good.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    good = good.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    grouped = good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    return grouped.withColumn("node", F.monotonically_increasing_id())


def _nearest(x: np.ndarray, middle: np.ndarray, k: int) -> np.ndarray:
    sim = x.astype(np.float32) @ middle.T
    k = min(k, sim.shape[1])
    return np.argpartition(-sim, k - 1, axis=1)[:, :k]


def sharded(nodes: DataFrame, least: float, shard: int, most: int = MAX_SHARDS) -> DataFrame:
    """nodes with shards: the OVERLAP * 2 or fewer shards of each, as a sorted array."""
    spark = nodes.sparkSession
    sizes = {r["size"]: r["count"] for r in nodes.groupBy(F.size("v").alias("size")).count().collect()}  # a row a vector length
    sample: dict[int, list] = {n: [] for n in sizes}
    for r in nodes.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).collect():
        sample[len(r["v"])].append(r["v"])
    middle, first = {}, 0
    for n in sorted(sizes):
        own = _unit(pd.Series(sample[n])) if sample[n] else np.ones((1, n))
        middle[n] = first, centroids(own, max(1, min(most, len(own), sizes[n] // shard))).astype(np.float32)
        first += len(middle[n][1])
    shared = spark.sparkContext.broadcast(middle)  # at most MAX_SHARDS rows, and one a vector length

    @F.pandas_udf("array<long>")
    def coarse(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype=object)
        size = v.map(len).to_numpy()
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            begin, own = shared.value[n]
            for i, c in zip(at, (_nearest(_unit(v.iloc[at]), own, OVERLAP) + begin).tolist()):
                out.iat[i] = c
        return out

    cells = kept(nodes.withColumn("cell", F.explode(coarse("v"))), "cells")
    large = kept(cells.groupBy("cell").count().filter(F.col("count") > SPLIT * shard), "large")
    if large.isEmpty():
        return cells.groupBy("node").agg(*[F.first(c).alias(c) for c in nodes.columns if c != "node"], F.array_sort(F.collect_set(F.col("cell") * (1 << 32))).alias("shards"))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(pdf["v"])
        whole = centroids(x, 1)
        tight = (x @ whole[0]).min() >= math.cos(math.acos(least) / 2)
        count = 1 if tight else min(len(x), most, int(pdf["count"].iloc[0]) // shard)
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "middle": [centroids(x, count).tolist()]})

    picked = cells.join(large, "cell").filter(F.pmod(F.xxhash64("node", "cell"), F.col("count")) < SAMPLE)
    subs = kept(picked.select("cell", "count", "v").groupBy("cell").applyInPandas(train, "cell long, middle array<array<double>>"), "middles")

    def split(batches):
        known: dict[int, np.ndarray] = {}
        for pdf in batches:
            for cell, own in pdf.groupby("cell"):
                if cell not in known:
                    known[cell] = np.array([list(x) for x in own["middle"].iloc[0]], np.float32)
                near = _nearest(_unit(own["v"]), known[cell], 2)
                yield pd.DataFrame({"node": np.repeat(own["node"].to_numpy(), near.shape[1]), "shard": (cell << 32) + near.ravel()})

    # a cell's centroids come with one row of each range of its members, not with each member
    parts = cells.join(large.select("cell"), "cell", "left_semi").select("node", "cell", "v")
    fine = parts.join(F.broadcast(subs) if large.count() <= most else subs, "cell").mapInPandas(split, "node long, shard long")
    plain = cells.join(large.select("cell"), "cell", "left_anti").select("node", (F.col("cell") * (1 << 32)).alias("shard"))
    shards = plain.unionByName(fine).groupBy("node").agg(F.array_sort(F.collect_set("shard")).alias("shards"))
    return nodes.join(shards, "node")


def links(nodes: DataFrame, least: float = LEAST, cap: int = CAP, shard: int = SHARD, every_pair: bool = False, most: int = MAX_SHARDS) -> DataFrame:
    """nodes: node, v, rows (a stored table). Returns PAIR and COUNT rows as `_found` does, with
    those that lie beyond the shards."""
    own = kept(sharded(nodes.select("node", "v", "rows"), least, shard, most), "shards")
    width = 2 * OVERLAP
    padded = F.slice(F.concat("shards", F.array_repeat(F.lit(-1).cast("long"), width)), 1, width)
    member = own.select("node", "v", "rows", padded.alias("shards"), F.explode("shards").alias("shard"))
    blocks = member.groupBy("shard").agg(F.ceil(F.count("*") / cap).alias("blocks"))
    member = kept(member.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))), "members")
    lists = member.select("node", "v", "shard", "block").groupBy("shard", "block").applyInPandas(_adjacency, "shard long, node long, near array<long>, sim array<double>")
    united = kept(lists.groupBy("node").agg(F.collect_list(F.struct("shard", "near", "sim")).alias("lists")), "united")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = member.join(united, "node").withColumn("other", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    dealt = dealt.withColumn("lists", F.when(F.col("block") == F.col("lo"), F.col("lists")))
    found = kept(dealt.select("shard", "lo", "hi", "block", "node", "v", "rows", "shards", "lists").groupBy("shard", "lo", "hi").applyInPandas(_found(least, every_pair), _FOUND), "found")
    return found.filter(F.col("kind") != BEYOND).unionByName(_beyond(found, own, united, least))


def _beyond(found: DataFrame, own: DataFrame, united: DataFrame, least: float) -> DataFrame:
    """Follows the united graph from asking nodes (a) to nodes of other shards (b), until no new
    pair is in range."""
    spark, reach = found.sparkSession, math.acos(least)

    @F.pandas_udf("double")
    def cosine(v: pd.Series, w: pd.Series) -> pd.Series:
        out = np.zeros(len(v))
        for n in v.map(len).unique():
            at = np.flatnonzero(v.map(len) == n)
            out[at] = np.einsum("nd,nd->n", _unit(v.iloc[at]), _unit(w.iloc[at]))
        return pd.Series(out)

    asked = found.filter(F.col("kind") == BEYOND).select("a", "b").distinct()
    seen = spark.createDataFrame([], "a long, b long, sim double")
    left = own.select(F.col("node").alias("a"), F.col("v").alias("va"), F.col("shards").alias("sa"), F.col("rows").alias("ra"))
    right = own.select(F.col("node").alias("b"), F.col("v").alias("vb"), F.col("shards").alias("sb"), F.col("rows").alias("rb"))
    while True:
        # nodes that share a shard have been compared there
        pairs = asked.join(left, "a").join(right, "b").filter(~F.arrays_overlap("sa", "sb") & (F.size("va") == F.size("vb")))
        new = kept(pairs.withColumn("sim", cosine("va", "vb")).filter(F.col("sim") >= least).select("a", "b", "sim", "sa", "ra", "rb"), "beyond")
        if new.isEmpty():
            break
        seen = seen.unionByName(new.select("a", "b", "sim"))
        steps = new.join(united.withColumnRenamed("node", "b"), "b").select("a", "sa", "sim", F.explode("lists").alias("l"))
        steps = steps.filter(~F.array_contains("sa", F.col("l.shard"))).select("a", "sim", F.explode(F.arrays_zip("l.near", "l.sim")).alias("n"))
        steps = steps.filter(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("n.sim")))) <= F.lit(reach + MARGIN) + F.acos(F.least(F.lit(1.0), F.col("sim"))))
        asked = steps.select("a", F.col("n.near").alias("b")).filter("a <> b").distinct().join(seen.select("a", "b"), ["a", "b"], "left_anti")
    both = seen.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rows = own.select("node", "rows")
    pairs = both.select(F.lit(PAIR).alias("kind"), "a", "b", F.lit(0.0).alias("n"))
    counts = both.unionAll(both.select("b", "a")).join(rows.withColumnRenamed("node", "b"), "b").select(F.lit(COUNT).alias("kind"), "a", F.lit(0).cast("long").alias("b"), F.col("rows").cast("double").alias("n"))
    return pairs.unionByName(counts)


def near_pairs(nodes: DataFrame, least: float = LEAST, cap: int = CAP, shard: int = SHARD, most: int = MAX_SHARDS) -> DataFrame:
    """Distinct pairs a > b of nodes found similar."""
    return links(nodes, least, cap, shard, True, most).filter(F.col("kind") == PAIR).select("a", "b")


def dedup(vectors: DataFrame, least: float = LEAST, cap: int = CAP, shard: int = SHARD, most: int = MAX_SHARDS) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row a vector."""
    nodes = kept(nodes_of(vectors), "vectors")
    found = kept(links(nodes, least, cap, shard, False, most), "links")
    degree = found.filter(F.col("kind") == COUNT).groupBy(F.col("a").alias("node")).agg(F.sum("n").cast("long").alias("linked"))
    named = nodes.join(components(found.filter(F.col("kind") == PAIR).select("a", "b")), "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("id").alias("component")), "root").select("node", "component")
    found = nodes.join(named, "node").join(degree, "node", "left").select("v", (F.col("rows") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), "component")
    key = F.transform(F.transform(vectors["embedding"], lambda x: x.cast("double")), lambda x: x + F.lit(0.0))
    out = vectors.select(vectors["vec_id"], key.alias("v")).join(found, "v", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def audit(vectors: DataFrame, pairs: DataFrame, nodes: DataFrame, least: float = LEAST, block: int = 20_000) -> tuple[int, int]:
    """(pairs found, pairs that brute force finds) for all nodes whose id is divisible by 50
    against all rows, `block` of them at a time."""
    asked = kept(nodes.filter(F.col("id") % 50 == 0).select("node", "v"), "asked")
    rounds = -(-asked.count() // block)
    truth = nodes.sparkSession.createDataFrame([], "a long, b long")
    for k in range(rounds):
        truth = truth.unionByName(_truth(asked.filter(F.pmod(F.xxhash64("node"), F.lit(rounds)) == k), nodes, least))
    truth = kept(truth.distinct(), "truth")
    return truth.join(pairs, ["a", "b"], "left_semi").count(), truth.count()


def _truth(asked: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    by_size: dict[int, tuple[list, list]] = {}
    for r in asked.collect():  # about `block` rows
        ids, vs = by_size.setdefault(len(r["v"]), ([], []))
        ids.append(r["node"])
        vs.append(r["v"])
    shared = nodes.sparkSession.sparkContext.broadcast({n: (np.array(ids), _unit(pd.Series(vs))) for n, (ids, vs) in by_size.items()})

    def run(batches):
        for pdf in batches:
            size = pdf["v"].map(len)
            for n, (ids, q) in shared.value.items():
                own = pdf[size == n]
                for lo in range(0, len(own), 1000):
                    part = own.iloc[lo : lo + 1000]
                    a, b = np.nonzero(_unit(part["v"]) @ q.T >= least)
                    node = part["node"].to_numpy()[a]
                    differ = node != ids[b]
                    yield pd.DataFrame({"a": np.maximum(node, ids[b])[differ], "b": np.minimum(node, ids[b])[differ]})

    return nodes.select("node", "v").mapInPandas(run, "a long, b long")
