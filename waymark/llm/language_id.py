"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of its labelled text is built. A text
is parsed greedily into the longest phrases that occur in the sample (Ziv and Merhav); the
language that needs the fewest phrases per letter wins. Texts are cut every SEGMENT characters,
where a phrase ends too, so that all segments of a batch walk the automata side by side in
numpy: one table look-up per character and language.

Only letters carry the decision: other characters become one space. A null text, an empty one
or one with no letter is `und` with score 0. The score is 1 - best / second-best phrase rate,
which is 0 for a tie; ties go to the language that sorts first. Repeated rows are judged alike,
null ids are kept (and never trained on or held out), extra columns ignored. With no labelled
text at all, every text is `und`.

The sample is the documented bound of the training: SAMPLE_DOCS different texts a language,
least hash first, of longer texts a passage of SAMPLE_CHARS characters at a hashed place, and
SAMPLE_TOTAL characters in all. Every label is learned, and every letter of the samples is kept apart; only
letters that no sample holds share a class, which no phrase can contain.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, kept, thin

SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TOTAL = 60, 4000, 40_000
SEGMENT = 1024
#: Table columns of a language at most (its commonest letters; the others are searched), and
#: cells of all tables together, below which many languages have fewer columns.
COLUMNS, CELLS = 64, 1 << 26
_CHUNK = 1 << 21


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Automaton:
    """Suffix automaton as a table: row = state, column = class of character. An entry is
    twice the next state, plus 1 where a new phrase begins. Classes from `width` on have no
    column: their entries are searched by state * classes + class."""

    def __init__(self, codes: list[int], classes: int, width: int) -> None:
        link, length, nxt, last = [-1], [0], [{}], 0
        for c in codes:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.states, self.width = len(nxt), min(width, classes)
        self.root = np.array([nxt[0].get(c, 0) for c in range(classes)], np.int32) * 2 + 1
        self.table = np.tile(self.root[: self.width], (len(nxt), 1)).astype(np.int32)
        rare = {}
        for s, own in enumerate(nxt):
            if s:
                for c, to in own.items():
                    if c < self.width:
                        self.table[s, c] = to * 2
                    else:
                        rare[s * classes + c] = to * 2
        self.table, self.classes = self.table.ravel(), classes
        self.keys = np.array(sorted(rare), np.int64)
        self.values = np.array([rare[k] for k in self.keys.tolist()], np.int32)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        if self.width == self.classes:
            return self.table[state * self.width + c]
        out = self.table[state * self.width + np.minimum(c, self.width - 1)]
        at = np.flatnonzero(c >= self.width)
        if len(at):
            key = state[at] * self.classes + c[at]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[at] = np.where(self.keys[place] == key, self.values[place], self.root[c[at]])
        return out


class Model:
    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        points = {lang: _points(samples[lang].lower()) for lang in self.langs}
        seen = Counter()
        for p in points.values():
            seen.update(p[_is_letter()[p]].tolist())
        self.lookup = np.where(_is_letter(), 1, 0).astype(np.uint32)  # 0: space, 1: letters of no sample
        for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))):
            self.lookup[c] = i + 2
        width = max(2, min(COLUMNS, CELLS // max(1, 2 * sum(map(len, points.values())))))
        self.own, self.automata = [], []
        for lang in self.langs:
            codes = self.squeeze(self.lookup[points[lang]])
            letters = [c for c, _ in sorted(Counter(codes[codes > 1].tolist()).items(), key=lambda x: (-x[1], x[0]))]
            own = np.ones(len(seen) + 2, np.int64)  # the language's classes: 0, 1 (not its letter), its letters
            own[0], own[letters] = 0, np.arange(len(letters)) + 2
            self.own.append(own)
            self.automata.append(Automaton(own[codes].tolist(), len(letters) + 2, width))

    @staticmethod
    def squeeze(codes: np.ndarray) -> np.ndarray:
        """Runs of spaces become one."""
        return codes[~((codes == 0) & np.r_[False, codes[:-1] == 0])] if len(codes) else codes

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by text and language, letters by text)."""
        codes = [self.squeeze(self.lookup[_points(t.lower())]) for t in texts]
        letters = np.array([int((c > 0).sum()) for c in codes], np.int64)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if not self.langs or not len(texts):
            return out, letters
        flat = np.concatenate([*codes, np.zeros(1, np.uint32)])
        starts = np.r_[0, np.cumsum([len(c) for c in codes])]
        seg, own = [], []
        for i, c in enumerate(codes):
            own += [i] * -(-len(c) // SEGMENT)
            seg += range(int(starts[i]), int(starts[i + 1]), SEGMENT)
        seg, own = np.array(seg, np.int64), np.array(own, np.int64)
        size = np.minimum(SEGMENT, starts[own + 1] - seg) if len(own) else seg
        order = np.argsort(-size, kind="stable")
        seg, own, size = seg[order], own[order], size[order]
        for k, (own_class, automaton) in enumerate(zip(self.own, self.automata)):
            state, chars = np.zeros(len(seg), np.int64), own_class[flat]
            count = np.ones(len(seg), np.int64)  # the first phrase
            live = len(seg)
            for step in range(int(size[0]) if len(size) else 0):
                while live and size[live - 1] <= step:
                    live -= 1
                v = automaton.step(state[:live], chars[seg[:live] + step])
                if step:
                    count[:live] += v & 1
                state[:live] = v >> 1
            out[:, k] = np.bincount(own, count, len(texts)).astype(np.int64)
        return out, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        phrases, letters = self.phrases([t or "" for t in texts])
        langs, scores = [], []
        for row, n in zip(phrases, letters):
            if not n or not self.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            best = int(np.argmin(row))
            second = np.partition(row, 1)[1] if len(row) > 1 else 2 * row[best]
            langs.append(self.langs[best])
            scores.append(float(1 - row[best] / max(second, 1)))
        return langs, scores


@lru_cache(1)
def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(dict(samples))


def held_out(doc_id: str = "doc_id", modulus: int = 4, remainder: int = 2):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def learn(docs: DataFrame, by_hash_only_if=None) -> tuple[tuple[str, str], ...]:
    """The bounded training samples: (language, text), from text and lang of the rows that
    pass the condition."""
    rows = docs.select(docs["doc_id"], docs["text"], docs["lang"])
    if by_hash_only_if is not None:
        rows = rows.filter(by_hash_only_if)
    rows = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64("text").alias("h"))
    texts = kept(rows.select("lang", "h").distinct(), "hashes")  # copies of a text are one sample
    first = Window.partitionBy("lang").orderBy("h")
    picked = thin(texts, "lang", F.col("h"), SAMPLE_DOCS).select("lang", "h", F.row_number().over(first).alias("k")).filter(F.col("k") <= SAMPLE_DOCS)
    picked = docs.sparkSession.createDataFrame(picked.collect(), "lang string, h long, k int")  # SAMPLE_DOCS a language
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    passage = F.when(F.length("text") > SAMPLE_CHARS, F.substring("text", place.cast("int"), F.lit(SAMPLE_CHARS))).otherwise(F.col("text"))
    picked = rows.join(F.broadcast(picked), ["lang", "h"]).select("lang", "h", "k", passage.alias("text")).dropDuplicates(["lang", "h"]).collect()
    out: dict[str, str] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["k"])):
        if len(out.get(r["lang"], "")) < SAMPLE_TOTAL:
            out[r["lang"]] = out.get(r["lang"], "") + " " + r["text"]
    return tuple(sorted((lang, text[:SAMPLE_TOTAL]) for lang, text in out.items()))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry, lang_pred and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # at most SAMPLE_TOTAL characters a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            for own in by_bytes(batch, batch.num_columns - 1, _CHUNK):
                langs, scores = model.predict(own.column(own.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*own.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(*[docs[c] for c in carry], docs["text"].alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
