"""Grouping of spelling variants by a symmetric-delete join.

Words are counted over the whole corpus (pre-aggregated by word). Every word emits itself and
its single deletions, each known by the position of what was deleted. Rows of one key meet:

- a word and a deletion of another one: these differ by one inserted code point;
- deletions at the same position: these differ by one replaced code point;

so keys with positions are exact and no pairs within a key are formed: each row takes the
number of its partners and the best of them from its key. A key of one position has at most as
many words as the alphabet has letters. Where equal neighbours give a deletion twice, only the
first position counts as a deletion (the distinct ones); all count for replacements. The best
partner of each row is verified to be at distance one. Roots follow forms by joins of the
form table with itself, each of which doubles the way.

Keys of over KEY_BYTES bytes are SHA-256 digests. A word of over LONG code points emits its
deletions only if another one shares its first or last END code points and differs in length by
one at most, as all near ones do.

A null or empty text has no words; a null id is hashed as an empty one. Repeated rows count
each. Words without near words have n_near 0, form and form_n null and themselves as root. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept

RUN = "[A-Za-zÀ-ÿ]+"
KEY_BYTES, LONG, END = 64, 256, 64


def runs_of(docs: DataFrame) -> DataFrame:
    """doc_id and run: maximal runs of letters, A-Z lower-cased, other letters as they are."""
    run = F.col("run")
    # lower() would change other capitals, too; translate() is the slower of the two
    lowered = F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, string.ascii_uppercase, string.ascii_lowercase))
    found = docs.select(docs["doc_id"].alias("doc_id"), F.explode(F.regexp_extract_all(docs["text"], F.lit(RUN), F.lit(0))).alias("run"))
    return found.select("doc_id", lowered.alias("run"))


def without(word: Column, at: Column) -> Column:
    """The word less its code point at a place from 1."""
    return F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.length(word)))


def garbled(doc_id: Column, run: Column, every: int) -> Column:
    """The run, or where `every` divides its hash with the document's id, the run less one letter."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    return F.when(h % every == 0, without(run, (h % F.length(run) + 1).cast("int"))).otherwise(run)


def vocabulary(words: DataFrame, min_length: int, min_count: int) -> DataFrame:
    """words: word. Returns word and n, its occurrences, for the long and frequent enough."""
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _emitting(vocab: DataFrame) -> DataFrame:
    """The words that may have near ones, of the long ones."""
    long = vocab.filter(F.length("word") > LONG)
    ends = F.explode(F.array(F.struct(F.lit("first").alias("side"), F.left("word", F.lit(END)).alias("end")), F.struct(F.lit("last").alias("side"), F.right("word", F.lit(END)).alias("end"))))
    # lengths that differ by one at most share one of these numbers
    rows = long.select("word", ends.alias("e")).select("word", "e.side", "e.end", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size"))
    shared = rows.groupBy("side", "end", "size").agg(F.count("*").alias("c")).filter("c > 1")
    stays = rows.join(shared, ["side", "end", "size"], "left_semi").select("word").distinct()
    return vocab.filter(F.length("word") <= LONG).unionByName(long.join(stays, "word", "left_semi"))


def _key(part: Column) -> Column:
    return F.when(F.octet_length(part) <= KEY_BYTES, part).otherwise(F.concat(F.lit("#"), F.sha2(part, 256)))


def deletions(vocab: DataFrame) -> DataFrame:
    """key, pos (0: the word itself, else the place of what was deleted), fresh (the first place
    that gives this deletion), word, n."""
    word, pos = F.col("word"), F.col("pos")
    rows = vocab.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("pos"))
    fresh = (pos == 1) | (F.substring(word, pos, F.lit(1)) != F.substring(word, pos - 1, F.lit(1)))
    return rows.select(_key(F.when(pos == 0, word).otherwise(without(word, pos))).alias("key"), "pos", ((pos > 0) & fresh).alias("fresh"), "word", "n")


def near_words(vocab: DataFrame) -> DataFrame:
    """word, n_near and best (m: minus the occurrences, word) of every word with near ones; the
    best has most occurrences, of several such it is the first in code-point order."""
    rows = deletions(_emitting(vocab)).repartition("key")  # serves both windows
    ranked = W.partitionBy("key", "pos").orderBy(F.desc("n"), "word")
    other = F.struct((-F.col("n")).alias("m"), "word")
    rows = rows.select(
        "*",
        F.when(F.row_number().over(ranked) == 1, F.lead(other).over(ranked)).otherwise(F.first(other).over(ranked)).alias("replaced"),
        (F.count("*").over(W.partitionBy("key", "pos")) - 1).alias("replacements"),
    )
    key = W.partitionBy("key")
    rows = rows.select(
        "*",
        F.max(F.when(F.col("pos") == 0, other)).over(key).alias("itself"),
        F.min(F.when(F.col("fresh"), other)).over(key).alias("longer"),
        F.count(F.when(F.col("fresh"), F.lit(1))).over(key).alias("longer_count"),
    )
    own = F.col("pos") == 0
    near = F.when(own, F.col("longer_count")).otherwise(F.col("replacements") + (F.col("fresh") & F.col("itself").isNotNull()).cast("long"))
    best = F.when(own, F.col("longer")).otherwise(F.array_min(F.array("replaced", F.when(F.col("fresh"), F.col("itself")))))
    found = rows.select("word", near.alias("near"), best.alias("best")).filter("near > 0")
    apart = F.levenshtein(F.col("word"), F.col("best.word"), 1) != 1
    checked = F.when(apart, F.raise_error(F.concat(F.lit("not near: "), F.col("word"))).cast("long")).otherwise(F.col("near"))
    return found.groupBy("word").agg(F.sum(checked).alias("n_near"), F.min("best").alias("best"))


def roots_of(forms: DataFrame) -> DataFrame:
    """forms: word and form, without cycles. Returns word and root, what the forms lead to."""
    now = kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = kept(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now


def group_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, every: int = 199) -> DataFrame:
    """docs: doc_id and text. Returns word, form, root, n, n_near, form_n.

    The form of a word is its best near word, if that occurs `ratio` times as often at least.
    every: see `garbled`; of so many runs, one loses a letter."""
    words = runs_of(docs).select(garbled(F.col("doc_id"), F.col("run"), every).alias("word"))
    vocab = kept(vocabulary(words, min_length, min_count), "vocabulary")
    near = vocab.join(near_words(vocab), "word", "left")
    better = -F.col("best.m") >= ratio * F.col("n")
    named = kept(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("best.word")).alias("form"), F.when(better, -F.col("best.m")).alias("form_n")), "forms")
    roots = roots_of(named.filter("form IS NOT NULL"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda a, k: xor(a >> 1, (a & 1) * 3988292384))) AS t),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
pairs AS (SELECT id, run, count(*) AS c FROM runs GROUP BY ALL),
bytes AS (SELECT id, run, c, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END)) AS b FROM pairs),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
words AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM hashed),
vocab AS (SELECT word, sum(c)::BIGINT AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
dels AS (SELECT word, n, p, word[:p - 1] || word[p + 1:] AS key FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM vocab)),
near AS (SELECT a.word, b.word AS other, b.n FROM dels a JOIN dels b ON a.key = b.key AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM dels a JOIN vocab b ON a.key = b.word
  UNION SELECT b.word, a.word, a.n FROM dels a JOIN vocab b ON a.key = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS best_n FROM near GROUP BY word),
named AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN other END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM vocab v LEFT JOIN best b ON v.word = b.word),
way AS (SELECT word, word AS place, 0 AS step FROM named UNION ALL SELECT w.word, m.form, step + 1 FROM way w JOIN named m ON w.place = m.word WHERE m.form IS NOT NULL)
SELECT m.word, m.form, r.root, m.n, m.n_near, m.form_n FROM named m JOIN (SELECT word, arg_max(place, step) AS root FROM way GROUP BY word) r ON m.word = r.word
"""
