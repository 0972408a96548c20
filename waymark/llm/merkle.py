"""A Merkle manifest of a dataset, by supersteps over RDDs.

Leaves are digests of whole rows, numbered by source. A superstep upward sends each node's
digest to its parent, the parent of every FAN consecutive ones; a parent that has them all (it
knows how many from the size of its level) hashes and goes on, till each source has one node,
its subroot. Subroots, numbered by source, are the leaves of one more tree. Supersteps downward
send each node the siblings on its way to the root, from which its leaf is verified.

Nodes are keyed by tree and place, so no source of any size comes together; a superstep's
table is a FAN-th of the one before, written to the shared folder, and its number of partitions
follows its size (PART_NODES nodes each). A node's path goes to its children's place once, not once a child.

Nulls are `-` in a leaf, null sources come first. Rows of one source and id go by their leaf;
repeated rows are leaves of their own. Null ids come first and count as not chosen for
tampering. An empty table gives an empty result. Extra columns are not part of a leaf."""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept

FAN = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that a superstep gathers in one partition, about.
PART_NODES = 50_000
_NODE = "tree string, i long, n long, digest string"


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*columns: Column) -> Column:
    """SHA-256 in hex of the columns in order: `-` for null, else byte count, `:`, value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def place_by(rows: DataFrame, tree: str, order: tuple[str, ...]) -> DataFrame:
    """i (from 0) and n for every row: its place in its tree and the tree's size. Rows are
    dealt by range; only counts of a tree in a partition are summed up over partitions."""
    dealt = kept(rows.repartitionByRange(tree, *order).withColumn("part", F.spark_partition_id()), "places")
    ranked = dealt.withColumn("k", F.row_number().over(W.partitionBy("part", tree).orderBy(*order)))
    own = W.partitionBy("t")
    sizes = dealt.groupBy("part", F.col(tree).alias("t")).agg(F.count("*").alias("c"))
    sizes = sizes.select(F.col("part").alias("p"), "t", (F.sum("c").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")).alias("before"), F.sum("c").over(own).alias("n"))
    joined = ranked.join(sizes, (F.col("part") == F.col("p")) & F.col(tree).eqNullSafe(F.col("t")))
    return joined.select(*rows.columns, (F.col("k") - 1 + F.col("before")).alias("i"), "n")


def _home(key: tuple) -> int:
    return zlib.crc32(repr(key).encode())


def _parent(node: tuple) -> tuple:
    tree, i, n, digest = node
    return (tree, i // FAN), (i % FAN, n, digest)


def _complete(sent: tuple) -> tuple:
    """A parent from its children's messages."""
    (tree, i), messages = sent
    children = sorted(messages)
    n = children[0][1]
    if [c[0] for c in children] != list(range(min(FAN, n - FAN * i))):
        raise ValueError(f"node {i} of a level of {n} has children {[c[0] for c in children]}")
    return tree, i, -(-n // FAN), _h(*[c[2] for c in children])


def _parts(nodes: int) -> int:
    return nodes // PART_NODES + 1


def _by_key(pairs: Iterator[tuple]) -> Iterator[tuple]:
    found: dict = {}
    for key, value in pairs:
        found.setdefault(key, []).append(value)
    return iter(found.items())


def _gather(pairs: RDD, parts: int) -> RDD:
    """(key, its values). A level's size sets the partitions, so that upper levels take few
    tasks; they are merged before Python reads them."""
    return pairs.partitionBy(parts, _home).coalesce(parts).mapPartitions(_by_key)


def climb(nodes: DataFrame) -> list[tuple[DataFrame, int]]:
    """nodes: tree, i, n, digest of the lowest level. Returns every level's table and the number
    of its nodes, lowest first; a tree's top is the only node (n = 1) of its highest level."""
    spark = nodes.sparkSession
    level = nodes.select("tree", "i", "n", "digest")
    most, count = level.agg(F.max("n"), F.count("*")).first()
    levels = [(level, count)]
    while most and most > 1:
        sent = _gather(level.filter("n > 1").rdd.map(_parent), _parts(count))
        level = kept(spark.createDataFrame(sent.map(_complete), _NODE, verifySchema=False), "level")
        most, count = level.agg(F.max("n"), F.count("*")).first()
        levels.append((level, count))
    return levels


def tops_of(levels: list[tuple[DataFrame, int]]) -> DataFrame:
    """tree, digest and level of every tree's last node."""
    found = [level.filter("n = 1").select("tree", "digest", F.lit(k).alias("level")) for k, (level, _) in enumerate(levels)]
    return functools.reduce(DataFrame.unionAll, found)


def _to_parent(node: tuple) -> tuple:
    tree, i, _, digest, own = node
    return (tree, i // FAN), (i % FAN, digest, own)


def _send(met: tuple) -> Iterator[tuple]:
    """From a node that knows its way to the root to each of its children: their siblings, left
    and right, and then the node's own way."""
    (tree, i), (ways, children) = met
    children = sorted(children, key=lambda c: c[0])
    way = next(iter(ways), (None, None))[0]
    if children and way is None:
        raise ValueError(f"node {i} doesn't know its way to the root")
    digests = [c[1] for c in children]
    for place, _, own in children:
        yield (tree, FAN * i + place), (("".join(digests[:place]), "".join(digests[place + 1 :]), *way), own)


def descend(levels: list[tuple[DataFrame, int]], leaves: RDD, tops: DataFrame) -> RDD:
    """levels: as climb returns them. leaves: (tree, i, n, digest, own) for the lowest level.
    tops: tree, level and way, a row a tree. Returns ((tree, i), (way, own)) for every leaf."""
    found = None
    for k in range(len(levels) - 1, -1, -1):
        level, count = levels[k]
        parts = _parts(count)
        begin = tops.filter(F.col("level") == k).coalesce(parts).rdd.map(lambda r: ((r.tree, 0), (tuple(r.way), None)))
        nodes = leaves if k == 0 else level.rdd.map(lambda r: (*r, None))
        if k == 0:  # lone leaves
            alone = leaves.filter(lambda x: x[2] == 1).map(lambda x: ((x[0], 0), x[4]))
            begin = _met(begin, alone, parts).flatMap(lambda met: [(met[0], (way[0], own)) for way in met[1][0] for own in met[1][1]])
        if found is None:
            found = begin
        else:  # a way goes once to where its node's children meet
            found = _met(found, nodes.filter(lambda x: x[2] > 1).map(_to_parent), parts).flatMap(_send).union(begin)
    return found


def _met(ways: RDD, children: RDD, parts: int) -> RDD:
    """Both by their node's key, as lists."""
    both = _gather(ways.mapValues(lambda x: (0, x)).union(children.mapValues(lambda x: (1, x))), parts)
    return both.mapValues(lambda found: ([x for side, x in found if side == 0], [x for side, x in found if side == 1]))


def _verified(row: tuple) -> tuple:
    _, (way, (doc_id, leaf, changed)) = row
    siblings, (subroot, root) = way[:-2], way[-2:]
    folded = changed
    for left, right in zip(siblings[::2], siblings[1::2]):
        folded = _h(left, folded, right)
    return doc_id, leaf, subroot, root, _h(*siblings), folded, folded == root


def manifest(docs: DataFrame, tampered: Column | None = None, columns: tuple[str, ...] = COLUMNS, tree: str = "source") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    tampered: the text as it was found later (None: unchanged); a row is verified if its leaf
    with that text and the siblings of the untampered tree fold to the root."""
    spark = docs.sparkSession
    own = [docs[c] for c in columns]
    later = [(tampered if tampered is not None else docs[c]) if c == "text" else docs[c] for c in columns]
    rows = docs.select(docs[tree].alias("tree"), docs["doc_id"].alias("doc_id"), leaf_of(*own).alias("digest"), leaf_of(*later).alias("changed"))
    leaves = kept(place_by(kept(rows, "digests"), "tree", ("doc_id", "digest")), "leaves")
    levels = climb(leaves)
    subroots = kept(place_by(tops_of(levels).select(F.lit("").alias("top"), "tree", "digest", "level"), "top", ("tree",)), "subroots")
    upper = climb(subroots.select(F.col("top").alias("tree"), "i", "n", "digest"))
    root = tops_of(upper).select("tree", "level", F.array("digest").alias("way"))
    ways = descend(upper, subroots.rdd.map(lambda r: (r.top, r.i, r.n, r.digest, (r.tree, r.level, r.digest))), root)
    ways = ways.map(lambda x: (x[1][1][0], x[1][1][1], [*x[1][0][:-1], x[1][1][2], x[1][0][-1]]))
    tops = kept(spark.createDataFrame(ways, "tree string, level int, way array<string>", verifySchema=False), "tops")
    found = descend(levels, leaves.rdd.map(lambda r: (r.tree, r.i, r.n, r.digest, (r.doc_id, r.digest, r.changed))), tops)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return spark.createDataFrame(found.map(_verified), f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", verifySchema=False)


def newlines_lost(doc_id: Column, text: Column) -> Column:
    """The tampering of the query: no newlines in documents of even crc32 of the id."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


ORACLE_SQL = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda a, k: xor(a >> 1, (a & 1) * 3988292384))) AS t),
docs AS (SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS front,
  coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 2 = 0, false) AS hit FROM documents, crc),
two AS (SELECT doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS late, front FROM docs),
leaves AS (SELECT doc_id, source, leaf, sha256(front || coalesce(strlen(late) || ':' || late, '-')) AS changed,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM two),
up AS (SELECT source, 0 AS lvl, i, n, leaf AS digest FROM leaves
  UNION ALL SELECT source, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY source, lvl, i // 3, n),
subs AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, i, n, digest FROM subs
  UNION ALL SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 3, n),
sides AS (SELECT a.source, a.lvl, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM up a JOIN up b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.source, a.lvl, a.i),
top_sides AS (SELECT a.lvl, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM top a JOIN top b ON a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.lvl, a.i),
own AS (SELECT row_number() OVER () AS id, l.*, s.digest AS subroot, s.i AS place FROM leaves l JOIN subs s ON l.source IS NOT DISTINCT FROM s.source),
ways AS (SELECT o.id, s.lvl, s.l, s.r FROM own o JOIN sides s ON o.source IS NOT DISTINCT FROM s.source AND o.i // (3 ** s.lvl)::BIGINT = s.i
  UNION ALL SELECT o.id, 1000 + t.lvl, t.l, t.r FROM own o JOIN top_sides t ON o.place // (3 ** t.lvl)::BIGINT = t.i),
way AS (SELECT id, string_agg(l || r, '' ORDER BY lvl) AS proof, list(l || '|' || r ORDER BY lvl) AS steps FROM ways GROUP BY id),
done AS (SELECT o.id, sha256(coalesce(proof, '')) AS proof_sha256, coalesce(list_reduce(steps, lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2)), changed), changed) AS folded_root FROM own o LEFT JOIN way w ON o.id = w.id),
root AS (SELECT digest FROM top WHERE n = 1)
SELECT o.doc_id, o.leaf, o.subroot, r.digest AS root, d.proof_sha256, d.folded_root, d.folded_root = r.digest AS verified FROM own o JOIN done d USING (id), root r
"""
