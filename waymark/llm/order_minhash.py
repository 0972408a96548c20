"""Order MinHash fingerprints (Marçais et al. 2019) in DataFrame functions alone.

A text is its words; its k-mers are WORDS consecutive ones, each numbered by its occurrence, so
repeats count. Numbered k-mers are parted in two halves by their hash. For each of SIGNATURES
seeded permutations the least one of each half is taken, the two are put in text order, and their
hashes are hashed to one signature: it stays only if both k-mers and their order do, so that it
follows edit distance and not just shared content. The likeness of two fingerprints is their share of equal
signatures.

Occurrences are numbered by a sort of (hash, place) in one number, where runs of equal hashes
count up. The k-mers are then exploded, and the minima are kept by hash aggregation on the
text's own key, by which rows already lie: only texts and results are shuffled.

Words are what blanks part, and single ideographs, kana or hangul syllables. A text of fewer words than
WORDS is one k-mer, a text without words (null is empty) one empty k-mer: all such texts have
one fingerprint. Up to 2^27 words a text. Equal texts have equal fingerprints, whatever their
ids. Rows are in order of id (null first), then of two 64-bit hashes with their texts; the
next of a repeated row is the row's equal, and of the last of these the following row's. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.tables import ordinals

from .common import kept

WORDS, SIGNATURES = 5, 32
#: A hash's 36 upper bits and a place of 27 in one positive number.
PLACE_BITS = 27
BLANKS = r"\s+|(?<=[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af])"
KEY = ("k1", "k2")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value made once: a lambda's variable isn't made anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _packed(h: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(h, 64 - 63 + PLACE_BITS), PLACE_BITS).bitwiseOR(place.cast("long"))


def _hash_of(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def _place_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def kmers(text: Column, words: int = WORDS) -> Column:
    """Hashes of the k-mers, in text order."""
    hashes = F.transform(F.array_remove(F.split(text, BLANKS), ""), lambda w: F.xxhash64(w))
    return _let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)])))


def _sorted_by_hash(hashes: Column) -> Column:
    """(hash, place), ascending."""
    return F.sort_array(F.transform(hashes, _packed))


def _sorted_by_place(ordered: Column) -> Column:
    """(place, hash of k-mer and occurrence), ascending, from (hash, place) in order: the members
    of each run of equal hashes count from 0, and the first keeps its hash."""
    first = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda r: (r == 0) | (_hash_of(F.get(s, r)) != _hash_of(F.get(s, r - 1))))

    def member(a: Column) -> Callable[[Column], Column]:
        def at(r: Column) -> Column:
            packed = F.get(ordered, r)
            h = F.when(r == a, _hash_of(packed)).otherwise(F.shiftrightunsigned(F.xxhash64(_hash_of(packed), r - a), PLACE_BITS + 1))
            return F.shiftleft(_place_of(packed), 63 - PLACE_BITS).bitwiseOR(h)

        return at

    return F.sort_array(_let(first(ordered), lambda starts: F.flatten(F.transform(starts, lambda a, j: F.transform(F.sequence(a, F.coalesce(F.get(starts, j + 1), F.size(ordered)) - 1), member(a))))))


def numbered(texts: DataFrame, keys: tuple[str, ...], words: int = WORDS) -> DataFrame:
    """keys, place and h (36 bits of a k-mer's hash, from its second occurrence on with its
    number), a row a k-mer. Where no k-mer repeats, nothing needs sorting. Each array is a column
    of its own select, so that Spark makes it once and not within the next one's lambdas."""
    rows = texts.select(*keys, kmers(F.col("text"), words).alias("hashes"))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    rows = rows.select(*keys, "hashes", F.when(repeats, _sorted_by_hash(F.col("hashes"))).alias("ordered"))
    rows = rows.select(*keys, "hashes", F.when(F.col("ordered").isNotNull(), _sorted_by_place(F.col("ordered"))).alias("placed"))
    moved = lambda x: F.shiftleft(x, PLACE_BITS + 1)
    rows = rows.select(*keys, F.coalesce(F.transform("placed", moved), "hashes").alias("all"))
    # outer: else Spark puts a filter of size(all) > 0 before, which makes the array twice
    return rows.select(*keys, F.posexplode_outer("all").alias("place", "h")).withColumn("h", F.shiftrightunsigned("h", PLACE_BITS + 1))


def signatures(texts: DataFrame, keys: tuple[str, ...], count: int = SIGNATURES, words: int = WORDS) -> DataFrame:
    """texts: keys and text. Returns keys and signatures (array of int); keys must be unique."""
    rows = numbered(texts, keys, words)
    minima = [F.min(_packed(F.xxhash64("h", F.lit(j)), F.col("place"))).alias(f"m{j}") for j in range(count)]
    halves = rows.groupBy(*keys, (F.col("h") % 2).alias("half")).agg(*minima)
    halves = halves.select(*keys, "half", F.array(*[f"m{j}" for j in range(count)]).alias("least"))
    least = halves.groupBy(*keys).agg(*[F.max(F.when(F.col("half") == k, F.col("least"))).alias(f"least{k}") for k in (0, 1)])
    # a half may be empty; null hashes are passed over
    none = F.transform(F.coalesce("least0", "least1"), lambda _: F.lit(None).cast("long"))

    def signature(a: Column, b: Column) -> Column:
        swapped = F.coalesce(_place_of(b) < _place_of(a), F.lit(False))
        h = F.xxhash64(_hash_of(F.when(swapped, b).otherwise(a)), _hash_of(F.when(swapped, a).otherwise(b)))
        return F.shiftright(h, 32).cast("int")

    return least.select(*keys, F.zip_with(F.coalesce("least0", none), F.coalesce("least1", none), signature).alias("signatures"))


def fingerprint_of(signatures: Column) -> Column:
    return F.concat_ws("", F.transform(signatures, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def _row_key(docs: DataFrame) -> list[Column]:
    """128 bits of id and text, by which equal rows are known."""
    return [F.xxhash64(docs["doc_id"], _text(docs)).alias("k1"), F.xxhash64(F.lit(13), _text(docs), docs["doc_id"]).alias("k2")]


def fingerprints(docs: DataFrame, count: int = SIGNATURES, words: int = WORDS) -> DataFrame:
    """doc_id, signatures and fingerprint of docs' rows, one for each of equal rows."""
    named = docs.select(docs["doc_id"].alias("doc_id"), *_row_key(docs), _text(docs).alias("text")).groupBy(*KEY).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    return signatures(named, (*KEY, "doc_id"), count, words).select("doc_id", "signatures", fingerprint_of(F.col("signatures")).alias("fingerprint"))


def _as(df: DataFrame, prefix: str, *more: Column | str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in KEY], *more)


def _on(left: str, right: str) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(left + c) == F.col(right + c) for c in KEY])


def successors(docs: DataFrame) -> DataFrame:
    """k1, k2 (a row for all equal rows), doc_id, copies, n_chars and next_k1, next_k2 of the
    following row (after the last: of the first)."""
    found = docs.select(docs["doc_id"].alias("doc_id"), *_row_key(docs), F.length(_text(docs)).cast("long").alias("n_chars"))
    found = found.groupBy(*KEY).agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_chars").alias("n_chars"))
    placed = kept(ordinals(found, ("doc_id", *KEY)), "order")
    last = placed.agg(F.max("ordinal")).first()[0]
    before = F.when(F.col("ordinal") == 1, F.lit(last)).otherwise(F.col("ordinal") - 1)
    return placed.join(_as(placed, "next_", before.alias("ordinal")), "ordinal").drop("ordinal")


def edit_likeness(docs: DataFrame, count: int = SIGNATURES, words: int = WORDS) -> DataFrame:
    """For every row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. The edited text has the last quarter of its code points replaced
    by as many of the next row's first (or by all of them)."""
    after = kept(successors(docs), "successors")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    # one row a key, in one exchange that both joins with texts read
    texts = docs.select(*_row_key(docs), _text(docs).alias("text")).groupBy(*KEY).agg(F.first("text").alias("text"))
    wanted = after.select("next_k1", "next_k2", F.col("k1").alias("for_k1"), F.col("k2").alias("for_k2"), quarter.alias("quarter"))
    heads = texts.join(wanted, _on("", "next_")).select("for_k1", "for_k2", F.substring("text", F.lit(1), F.col("quarter")).alias("head"))
    whole = texts.join(_as(after, "own_", "copies", "n_chars"), _on("", "own_")).join(heads, _on("", "for_"))
    left = F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int"))
    by_itself = F.concat(left, F.substring("text", F.lit(1), quarter))
    sides = [F.col("text"), F.concat(left, F.col("head")), F.when(F.col("copies") > 1, by_itself)]
    rows = whole.select(*KEY, F.posexplode(F.array(*sides)).alias("side", "text")).filter("text IS NOT NULL")
    rows = rows.select(*KEY, "side", "text", F.when(F.col("side") > 0, F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))
    found = kept(signatures(rows, (*KEY, "side", "sha"), count, words), "signatures")

    main = found.filter("side = 0")
    edited = _as(found.filter("side > 0"), "edited_", "side", "sha", F.col("signatures").alias("changed"))
    following = _as(main, "following_", F.col("signatures").alias("following"))
    both = main.select(*KEY, "signatures").join(_as(after, "own_", "doc_id", "copies", "n_chars", "next_k1", "next_k2"), _on("", "own_")).join(edited, _on("", "edited_")).join(following, _on("next_", "following_"))
    # of equal rows all but the last are followed by their equal
    itself = F.col("side") == 2
    times = F.when(itself, F.col("copies") - 1).otherwise(F.lit(1).cast("long"))
    out = both.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), fingerprint_of(F.col("signatures")).alias("fingerprint"), fingerprint_of(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("changed")).alias("near_edited"), F.when(itself, 1.0).otherwise(likeness(F.col("signatures"), F.col("following"))).alias("near_next"), times.alias("times"),
    )
    return out.select(*[c for c in out.columns if c != "times"], F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")).drop("copy")
