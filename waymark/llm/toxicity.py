"""Toxicity by a linear-chain conditional random field over words.

Labels are given for documents only, so token labels are derived first: in toxic training
documents a token is labelled toxic if one of its features (the word, its prefixes and
suffixes) is found in toxic documents alone, or nearly, and in more of them than chance
explains for any feature at all; all other tokens are not. Near copies count once there, as
they would make their common words look like evidence. The field (two labels, hashed features,
transitions) is fitted to these sequences by gradient ascent on the conditional likelihood. Its
forward-backward marginals give the toxic spans and, through a small logistic model fitted on
the training documents, the document's score.

A sequence is SEQUENCE words of one document; all sequences of a batch go side by side in
numpy. A null or empty text has no words and the score of one without toxic marginals.
Repeated rows are scored alike, null ids are kept (never trained on), extra columns ignored.
Without labels of both kinds the score is 0 for every text.

The training sample is bounded: SAMPLE_TOXIC and SAMPLE_CLEAN documents, least hash first, until
they have SAMPLE_CHARS characters for each of these documents. They are taken whole, whatever
their length, as evidence may stand anywhere; only the one that passes the bound is read in
passages of PASSAGE characters at hashed places. Of rows with one id the longest text counts.
More clean ones make it less likely that a word is found in toxic
documents alone by chance.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .anchors import _power
from .common import arrow_map, by_bytes, kept, thin

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS, PASSAGE = 800, 2400, 4_000, 4_000
SEQUENCE = 128
#: So many that words which share a feature by their hash alone are few.
FEATURES = 1 << 20
STEPS = 40
#: Evidence that labels a token: weighted share of toxic documents among those with the feature,
#: and the chance that any feature has its count by luck, if toxic documents were TILT times as
#: likely to have it.
SHARE, CHANCE, TILT = 0.9, 1e-2, 1.5
FAINT = 0.2
#: Least hashes of three words by which near copies are known, and the share of them that tells.
SKETCH, ALIKE = 16, 0.25
#: Words remembered in a worker, and characters scored at a time.
MEMORY, CHUNK = 150_000, 1 << 20
#: Words of the sample that the fit looks at together.
RUN = 1 << 18

_WORDS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_WORDS).split()


def features(words: list[bytes]) -> np.ndarray:
    """Twelve 64-bit features a word: itself, its prefixes of 3 to 9 bytes and its suffixes of
    3 to 6; all are differences of one running polynomial hash."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    up, down = _power(max(1, len(data)))
    total = np.r_[np.zeros(1, np.uint64), np.add.accumulate(data * up[: len(data)])]
    begin = np.cumsum(sizes) - sizes
    end = begin + sizes
    out = np.empty((len(words), 12), np.uint64)
    parts = [(begin, end), *((begin, np.minimum(begin + k, end)) for k in range(3, 10)), *((np.maximum(end - k, begin), end) for k in range(3, 7))]
    for k, (x, y) in enumerate(parts):
        kind = 0 if not k else 1 if k < 8 else 2  # equal strings of different kinds differ
        h = (total[y] - total[x]) * down[np.minimum(x, len(down) - 1)] + np.uint64(kind)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        out[:, k] = h
    return out


def slots(hashes: np.ndarray) -> np.ndarray:
    """Places of features in the table of weights."""
    return (hashes >> np.uint64(40)).astype(np.int64) % FEATURES


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and document of each sequence, longest first."""
    starts = np.r_[0, np.cumsum(lengths)]
    per = -(-lengths // SEQUENCE)
    own = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(per) - per, per)
    begin = starts[own] + nth * SEQUENCE
    size = np.minimum(SEQUENCE, starts[own + 1] - begin)
    order = np.argsort(-size, kind="stable")
    return begin[order], size[order], own[order]


def marginals(emission: np.ndarray, layout: tuple, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward on all sequences: P(toxic) by token, expected transitions (2 x 2) and
    the log partition of each sequence. emission: log-odds of toxic; trans: log weights."""
    begin, size, _ = layout
    n, e = len(emission), np.exp(np.clip(emission, -30, 30))
    w = np.exp(trans)
    ahead = np.zeros((n, 2))
    norm = np.zeros(n)
    live = np.array([np.searchsorted(-size, -t, side="left") for t in range(int(size[0]) if len(size) else 0)])
    for t, k in enumerate(live):
        at = begin[:k] + t
        if t:
            prev = ahead[at - 1]
            a0, a1 = prev[:, 0] * w[0, 0] + prev[:, 1] * w[1, 0], (prev[:, 0] * w[0, 1] + prev[:, 1] * w[1, 1]) * e[at]
        else:
            a0, a1 = np.ones(k), e[at]
        z = a0 + a1
        ahead[at, 0], ahead[at, 1], norm[at] = a0 / z, a1 / z, np.log(z)
    behind = np.ones((n, 2))
    moves = np.zeros((2, 2))
    for t in range(len(live) - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        nxt = behind[at + 1] * np.stack([np.ones(len(at)), e[at + 1]], 1)
        b = nxt @ w.T
        pair = ahead[at][:, :, None] * w[None] * nxt[:, None, :]
        moves += (pair / pair.sum((1, 2))[:, None, None]).sum(0)
        behind[at] = b / b.sum(1)[:, None]
    ahead *= behind
    return ahead[:, 1] / ahead.sum(1), moves, norm


def toxic_odds(emission: np.ndarray, layout: tuple, trans: np.ndarray) -> np.ndarray:
    """P(toxic) by token, as `marginals` gives it, by odds alone."""
    begin, size, _ = layout
    e, w = np.exp(np.clip(emission, -30, 30)), np.exp(trans)
    steps = int(size[0]) if len(size) else 0
    live = [int(k) for k in np.searchsorted(-size, -np.arange(steps), side="left")]
    ahead, odds = e.copy(), np.empty_like(e)
    for t in range(1, steps):
        at = begin[: live[t]] + t
        r = ahead[at - 1]
        ahead[at] = e[at] * (w[0, 1] + r * w[1, 1]) / (w[0, 0] + r * w[1, 0])
    back = np.ones(len(begin))
    for t in range(steps - 1, -1, -1):
        at = begin[: live[t]] + t
        s = back[: live[t]]
        odds[at] = ahead[at] * s
        x = e[at] * s
        back[: live[t]] = (w[1, 0] + w[1, 1] * x) / (w[0, 0] + w[0, 1] * x)
    return odds / (1 + odds)


def _summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """By document: 1, log of the expected toxic words, the greatest marginal, their density.
    Marginals under FAINT count nothing: in a long text they would add up to a word."""
    own = np.repeat(np.arange(len(lengths)), lengths)
    total = np.bincount(own, np.where(p >= FAINT, p, 0), len(lengths))
    top = np.zeros(len(lengths))
    np.maximum.at(top, own, p)
    return np.stack([np.ones(len(lengths)), np.log1p(total), top, np.log1p(100 * total / np.maximum(lengths, 1))], 1)


class Field:
    def __init__(self, weights: np.ndarray, bias: float, trans: np.ndarray, outer: np.ndarray) -> None:
        self.weights, self.bias, self.trans, self.outer = weights, bias, trans, outer
        self.known: dict[bytes, float] = {}

    def __reduce__(self):
        return Field, (self.weights, self.bias, self.trans, self.outer)

    def emissions(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.known.get, words))
        if None in found:
            new = list({w for w, x in zip(words, found) if x is None})
            value = dict(zip(new, (self.weights[slots(features(new))].sum(1) + self.bias).tolist()))
            if len(self.known) > MEMORY:
                self.known.clear()
            self.known.update(value)
            found = [value[w] if x is None else x for w, x in zip(words, found)]
        return np.array(found, np.float64)

    def tag(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(P(toxic) of every word, words by text)."""
        split = [words_of(t) for t in texts]
        lengths = np.array([len(s) for s in split], np.int64)
        p = toxic_odds(self.emissions([w for s in split for w in s]), _layout(lengths), self.trans)
        return p, lengths

    def score(self, texts: list[str]) -> np.ndarray:
        return self.judged(*self.tag(texts))

    def judged(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_summary(p, lengths) @ self.outer, -30, 30)))

    def spans(self, text: str, least: float = 0.5) -> list[tuple[int, int]]:
        """Offsets (in characters) of runs of words whose marginal is `least` or more."""
        return runs_of(text, self.tag([text])[0], least)


def runs_of(text: str, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """Offsets (in characters) of runs of words with p of `least` or more; p is by the words of
    `words_of`."""
    high = p >= least
    if not high.any():
        return []
    plain = np.frombuffer(text.lower().encode("utf-8", "replace").translate(_WORDS), np.uint8)
    inside = np.r_[False, plain != 32, False]
    begin, end = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    first, last = np.flatnonzero(high & ~np.r_[False, high[:-1]]), np.flatnonzero(high & ~np.r_[high[1:], False])
    at = np.r_[0, np.cumsum((np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8) & 0xC0) != 0x80)]  # characters before a byte
    start, stop = at[begin[first]], at[end[last]]
    if len(text.lower()) != len(text):  # characters that are longer in lower case
        own = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
        start, stop = own[start], own[stop - 1] + 1
    return list(zip(start.tolist(), stop.tolist()))


def distinct(texts: Iterable[tuple[list[bytes], int]]) -> Iterator[tuple[list[bytes], int]]:
    """The texts (words, label) that are no near copies of earlier ones."""
    seen: set[int] = set()
    for words, label in texts:
        own = sorted({xxhash.xxh3_64_intdigest(b" ".join(words[j : j + 3])) for j in range(max(1, len(words) - 2))})[:SKETCH]
        if sum(x in seen for x in own) < ALIKE * len(own):
            seen.update(own)
            yield words, label


def _runs(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs (first, last + 1) of neighbours with about `most` words; a larger one goes alone."""
    first = np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // most, prepend=-2)).tolist()
    return list(zip(first, [*first[1:], len(sizes)]))


def _sums(weights: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The sum of each row's weights, some rows at a time."""
    return np.concatenate([weights[places[i : i + RUN // 8]].sum(1) for i in range(0, len(places), RUN // 8)])


def fit(texts: Iterable[str], toxic: Iterable[int]) -> Field | None:
    """All that has a number for each word of the sample is `ids` and `gold`: the rest is made
    and dropped RUN words at a time."""
    index: dict[bytes, int] = {}
    coded, y = [], []  # a text's words are numbers as soon as it is read: they take far less room
    for words, label in distinct((words_of(t), x) for t, x in zip(texts, toxic)):
        coded.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words)))
        y.append(label)
    y = np.array(y, bool)
    if not y.any() or y.all():
        return None
    lengths = np.array([len(c) for c in coded], np.int64)
    vocabulary = list(index)
    del index
    hashes = features(vocabulary)
    slots_ = slots(hashes).astype(np.int32)
    total = len(vocabulary)
    del vocabulary
    # token labels from document frequencies of the features
    words = [np.unique(c) for c in coded]
    ids = np.concatenate(coded)
    del coded
    parts = _runs(np.array([len(w) for w in words], np.int64), RUN)
    counts = []
    for k in range(hashes.shape[1]):  # features themselves, not their slots, which some share
        _, which = np.unique(hashes[:, k], return_inverse=True)
        n = int(which.max()) + 1
        bad, good = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for a, b in parts:
            doc = np.repeat(np.arange(a, b), [len(w) for w in words[a:b]])
            per_doc = np.unique(doc * n + which[np.concatenate(words[a:b])])
            label = y[per_doc // n]
            bad += np.bincount(per_doc[label] % n, minlength=n).astype(np.int32)
            good += np.bincount(per_doc[~label] % n, minlength=n).astype(np.int32)
        counts.append((which.astype(np.int32), bad, good))
    support = math.log(sum(len(bad) for _, bad, _ in counts) / CHANCE) / -math.log(min(0.7, TILT * y.mean()))
    sign = np.zeros(total, bool)
    for which, bad, good in counts:
        sign |= ((bad >= support) & (bad >= SHARE * (bad + good * (y.sum() / (~y).sum()))))[which]
    gold = sign[ids] & np.repeat(y, lengths)
    del words, counts, hashes, which, bad, good
    # the field; sequences don't meet, so those of a run go side by side and runs one by one
    begin, size, _ = _layout(lengths)
    size, inner = size[np.argsort(begin)], np.ones(len(ids), bool)
    inner[begin] = False
    seen = np.array([[np.count_nonzero(inner[1:] & (gold[:-1] == i) & (gold[1:] == j)) for j in (False, True)] for i in (False, True)], np.float64)
    del begin, inner
    ends = np.r_[0, np.cumsum(size)]
    runs = [(int(ends[a]), int(ends[b]), _layout(size[a:b])) for a, b in _runs(size, RUN)]
    weights, bias, trans = np.zeros(FEATURES), -3.0, np.zeros((2, 2))
    gw, gb, gt = np.full(FEATURES, 1e-3), 1e-3, np.full((2, 2), 1e-3)
    for _ in range(STEPS):
        emission = _sums(weights, slots_) + bias
        by_word, moves = np.zeros(total), np.zeros((2, 2))
        for a, b, layout in runs:
            p, moved, _ = marginals(emission[ids[a:b]], layout, trans)
            by_word += np.bincount(ids[a:b], gold[a:b] - p, total)
            moves += moved
        d = -0.1 * weights
        for k in range(slots_.shape[1]):
            d += np.bincount(slots_[:, k], by_word, FEATURES)
        db, dt = float(by_word.sum()), seen - moves - 0.1 * trans
        gw += d * d
        gb += db * db
        gt += dt * dt
        d /= np.sqrt(gw)
        weights += 0.4 * d
        bias += 0.4 * db / np.sqrt(gb)
        trans += 0.2 * dt / np.sqrt(gt)
    field = Field(weights.astype(np.float32), bias, trans, np.zeros(4))
    del weights, gw, d
    emission, ends = (_sums(field.weights, slots_) + bias).astype(np.float64), np.r_[0, np.cumsum(lengths)]
    x = np.concatenate([_summary(marginals(emission[ids[ends[a] : ends[b]]], _layout(lengths[a:b]), trans)[0], lengths[a:b]) for a, b in _runs(lengths, RUN)])
    t, outer = y.astype(float), np.zeros(4)
    for _ in range(50):  # Newton steps
        q = 1 / (1 + np.exp(-np.clip(x @ outer, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(4)
        outer = outer + np.linalg.solve(h, x.T @ (t - q) - 1e-2 * outer)
    field.outer = outer
    return field


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic: the bounded training sample of the labelled documents whose
    crc32(doc_id) mod 5 is not 0."""
    own = labels.select(labels["doc_id"], labels["toxic"].cast("int").alias("toxic")).filter("toxic IN (0, 1) AND doc_id IS NOT NULL")
    own = own.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # ids first, so that no texts are moved but those chosen
    sizes = docs.select(docs["doc_id"], F.length(docs["text"]).cast("long").alias("n")).filter("n IS NOT NULL")
    most = F.when(F.col("toxic") == 1, SAMPLE_TOXIC).otherwise(SAMPLE_CLEAN)
    ids = kept(sizes.join(own, "doc_id").groupBy("doc_id", "toxic").agg(F.max("n").alias("n")), "labelled")
    ids = thin(ids, "toxic", F.xxhash64("doc_id"), max(SAMPLE_TOXIC, SAMPLE_CLEAN))
    first = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    before = F.sum("n").over(first.rowsBetween(Window.unboundedPreceding, -1))
    picked = ids.select("doc_id", "toxic", "n", F.row_number().over(first).alias("k"), F.least("n", most * SAMPLE_CHARS - F.coalesce(before, F.lit(0))).alias("take")).filter((F.col("k") <= most) & ((F.col("take") > 0) | (F.col("n") == 0))).collect()
    label = {r["doc_id"]: r["toxic"] for r in picked}
    rows = docs.select(docs["doc_id"], docs["text"]).filter(F.col("doc_id").isin(list(label)) & F.col("text").isNotNull())
    part = {r["doc_id"]: r["take"] for r in picked if r["take"] < r["n"]}  # one a label at most
    text = F.col("text")
    for doc_id, take in part.items():
        text = F.when(F.col("doc_id") == F.lit(doc_id), _passages(F.col("text"), take)).otherwise(text)
    rows = rows.groupBy("doc_id").agg(F.max(F.struct(F.length("text").alias("n"), "text"))["text"].alias("text"))
    return rows.select("doc_id", text.alias("text"), F.col("doc_id").isin([i for i, y in label.items() if y]).cast("int").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame) -> Field | None:
    """Fits the field on the sample, in one task."""
    made = arrow_map(sample(docs, labels).coalesce(1), _fitted, "field binary").collect()
    return pickle.loads(made[0]["field"]) if made else None


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fits the field on the whole sample, which is bounded, in one task."""
    rows = sorted(r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(3))))
    toxic = [y for _, _, y in rows]
    rows.reverse()
    field = fit((rows.pop()[1] for _ in toxic), toxic)  # a text goes as soon as it is read
    if field:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(field)], pa.binary())], names=["field"])


def _passages(text: Column, take: int) -> Column:
    """Passages of PASSAGE characters, about `take` in all, of places by least hash."""
    size = min(PASSAGE, take)
    every = F.sequence(F.lit(0), ((F.length(text) - 1) / size).cast("int"))
    order = F.array_sort(F.transform(every, lambda i: F.struct(F.xxhash64(i).alias("h"), i.alias("i"))))
    places = F.array_sort(F.transform(F.slice(order, 1, max(1, take // size)), lambda s: s["i"]))
    return F.array_join(F.transform(places, lambda i: F.substring(text, i * size + 1, F.lit(size))), " ")


def score(docs: DataFrame, field: Field | None, carry: tuple[str, ...] = ("doc_id",), spans: bool = False) -> DataFrame:
    """carry, score (0 to 1) and, if asked for, spans (offsets in characters of the runs of words
    whose marginal is a half or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # FEATURES floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in by_bytes(batch, batch.num_columns - 1, CHUNK):
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                p, lengths = own.tag(texts) if own else (np.zeros(0), np.zeros(len(texts), np.int64))
                value = own.judged(p, lengths) if own else np.zeros(len(texts))
                cols, names = [*part.columns[:-1], pa.array(value, pa.float64())], [*part.schema.names[:-1], "score"]
                if spans:
                    ends = np.cumsum(lengths)
                    found = [[{"start": a, "stop": b} for a, b in runs_of(t, p[e - n : e])] for t, e, n in zip(texts, ends, lengths)]
                    cols, names = [*cols, pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], [*names, "spans"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(*[docs[c] for c in carry], docs["text"].alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]]
    return arrow_map(rows, run, ", ".join([*kinds, "score double", *["spans array<struct<start:int,stop:int>>"] * spans]))
