"""Exact token counts at every prefix of a text, by dynamic programming over the token lattice.

Byte-pair encoding has two properties that make this possible: every prefix of a valid token
sequence is valid itself, and a sequence is valid just if each two neighbours are. So the
encoding of a prefix is that of a shorter prefix plus one token, the only one among the tokens
that end there which may follow the shorter prefix's last token. `Lattice` stores for each
prefix of a run of bytes that last token and the count; as the vocabulary marks word ends, it
also stores the count of the prefix taken as a whole word. Neighbours are judged by the
merges that their borders go through (`_crossings`). No text is encoded again for any prefix.

`PrefixCounts` cuts a text into words as the library's normaliser and pattern do: composed,
lower-cased, white space dropped, contractions, runs of letters, single digits, runs of other
characters; special strings are one token. A run's counts are remembered by its bytes; unknown
runs of a batch are walked in sorted order, so that common beginnings are walked once.

`prefix_table` stores the counts at every character, from which `longest_prefix` answers
truncation and budget questions. Counts may fall when a character is added, as longer prefixes
can need fewer tokens. `count_tokens` gives the last entries alone.

Nulls and empty texts have no bytes and no tokens. Repeated rows are counted alike, null ids
are kept, extra columns ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

TOKENIZER = "word_bpe_49k.json"
#: Runs remembered in a worker; beyond it the memory starts afresh.
MEMORY = 400_000
#: Longer runs aren't remembered.
LONG_RUN = 64
_NONE = 1 << 30
#: Fixed values of the vocabulary's pattern.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_ASCII = re.compile("|".join(CONTRACTIONS) + r"|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
_ANY = regex.compile("|".join(CONTRACTIONS) + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: Characters whose lower case depends on their place in Python, but not in the vocabulary's normaliser.
_PLACED = "Σ"
_SPACE = regex.compile(r"\p{White_Space}")


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands
    for itself, the other bytes follow from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Lattice:
    """Prefix counts of one run of bytes. A state is the longest end of the bytes so far that
    begins some token; its tokens are those that end there. States are made when first met."""

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str) -> None:
        letters = byte_letters()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.merged = {(vocabulary[a], vocabulary[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.parts = {vocabulary[a + b]: (vocabulary[a], vocabulary[b], rank) for rank, (a, b) in enumerate(pairs)}
        self.inside: dict[bytes, int] = {}  # tokens inside a word and at its end, by their bytes
        self.closing: dict[bytes, int] = {}
        for text, token in vocabulary.items():
            final = bool(end) and text.endswith(end)
            raw = bytes(letters[c] for c in (text[: -len(end)] if final else text))
            if final or not end:
                self.closing[raw] = token
            if not final:
                self.inside[raw] = token
        self.begins = {raw[:n] for tokens in (self.inside, self.closing) for raw in tokens for n in range(len(raw) + 1)}
        self.states, self.names = {b"": 0}, [b""]
        self.step: dict[int, int] = {}
        self.ends: list[tuple] = [((), ())]
        self.follows: dict[int, bool] = {}
        self.borders: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.clear()

    def clear(self) -> None:
        self.path, self.last, self.count, self.whole = [0], [-1], [0], [0]

    def _border(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at a token's left (0) or right (1) border while it is merged,
        each with the rank of the merge that ends it."""
        if token not in self.borders[side]:
            out, until, at = [], _NONE, token
            while True:
                out.append((at, until))
                if at not in self.parts:
                    break
                left, right, until = self.parts[at]
                at = right if side else left
            self.borders[side][token] = out
        return self.borders[side][token]

    def _crossings(self, a: int, b: int, before: int = _NONE) -> bool:
        """Whether a merge across the border of tokens a and b comes before rank `before` and
        before those that end its two symbols (of equal merges the left one comes first)."""
        return any((rank := self.merged.get((x, y))) is not None and rank < before and rank < x_ends and rank <= y_ends for x, x_ends in self._border(a, 1) for y, y_ends in self._border(b, 0))

    def _may_follow(self, key: int) -> bool:
        """key: tokens a and b. Whether their bytes together are encoded as just these."""
        if len(self.follows) > MEMORY:
            self.follows.clear()
        known = self.follows[key] = not self._crossings(key >> 20, key & 0xFFFFF)
        return known

    def _alone(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as it."""
        if token not in self.parts:
            return True
        a, b, rank = self.parts[token]
        return self._alone(a) and self._alone(b) and not self._crossings(a, b, rank)

    def _next(self, state: int, byte: int) -> int:
        name = self.names[state] + bytes((byte,))
        while name not in self.begins:
            name = name[1:]
        to = self.states.get(name)
        if to is None:
            to = self.states[name] = len(self.names)
            self.names.append(name)
            tails = [name[k:] for k in range(len(name))]  # longest first
            self.ends.append(tuple(tuple((len(t), own[t]) for t in tails if t in own and self._alone(own[t])) for own in (self.inside, self.closing)))
        self.step[state << 8 | byte] = to
        return to

    def state(self) -> tuple:
        return self.path, self.last, self.count, self.whole, len(self.path)

    def back(self, state: tuple) -> None:
        """To an earlier state, of this run or of one before the last clear()."""
        self.path, self.last, self.count, self.whole, size = state
        self.cut(size - 1)

    def cut(self, size: int) -> None:
        for own in (self.path, self.last, self.count, self.whole):
            del own[size + 1 :]

    def extend(self, data: bytes) -> None:
        path, last, count, whole = self.path, self.last, self.count, self.whole
        step, ends, follow = self.step.get, self.ends, self.follows.get
        state, i = path[-1], len(path) - 1
        for byte in data:
            i += 1
            to = step(state << 8 | byte)
            state = self._next(state, byte) if to is None else to
            path.append(state)
            inside, closing = ends[state]
            for size, token in inside:
                k = i - size
                if k:
                    key = last[k] << 20 | token
                    known = follow(key)
                    if not (self._may_follow(key) if known is None else known):
                        continue
                last.append(token)
                count.append(count[k] + 1)
                break
            for size, token in closing:
                k = i - size
                if k:
                    key = last[k] << 20 | token
                    known = follow(key)
                    if not (self._may_follow(key) if known is None else known):
                        continue
                whole.append(count[k] + 1)
                break

    def run(self, data: bytes, before: bytes) -> list[int]:
        """Counts of each prefix, taken as a whole word. `before` is the run walked last, whose
        common beginning is not walked again."""
        same = len(commonprefix((before, data)))
        self.cut(same)
        self.extend(data[same:])
        return self.whole[1:]


class _Walk:
    """Counts by character of one white-space word with any characters: what the pattern takes
    as one run depends on the characters before, so the walk keeps the open run (in the
    lattice), its kind and, after an apostrophe, the first letter of what may be a contraction."""

    def __init__(self, lattice: Lattice, base: int) -> None:
        self.lattice, self.base, self.before, self.kind, self.maybe = lattice, base, base, "", ""
        lattice.clear()

    def total(self) -> int:
        return self.base + self.lattice.whole[-1]

    def state(self) -> tuple:
        return self.base, self.before, self.kind, self.maybe, self.lattice.state()

    def back(self, state: tuple) -> None:
        self.base, self.before, self.kind, self.maybe, own = state
        self.lattice.back(own)

    def begin(self, kind: str, data: bytes = b"") -> None:
        self.before, self.base = self.base, self.total()
        self.kind, self.maybe = kind, ""
        self.lattice.clear()
        self.lattice.extend(data)

    def go_on(self, kind: str, data: bytes) -> None:
        self.kind, self.maybe = kind, ""
        self.lattice.extend(data)

    def feed(self, c: str) -> None:
        data = c.encode("utf-8", "replace")
        category = unicodedata.category(c)[0]
        if _SPACE.match(c):
            self.begin("")
        elif category == "N":
            self.begin("N", data)
        elif category != "L":
            if self.kind in ("P", "'"):
                self.go_on("P", data)
            else:
                self.begin("'" if c == "'" else "P", data)
        elif self.kind == "'":
            if "'" + c in CONTRACTIONS:
                self.go_on("C", data)
            else:
                self.begin("L", data)
                self.maybe = c
        elif self.maybe and "'" + self.maybe + c in CONTRACTIONS:
            whole = ("'" + self.maybe + c).encode()
            self.base = self.before
            self.lattice.clear()
            self.go_on("C", whole)
        elif self.kind == "L":
            self.go_on("L", data)
        else:
            self.begin("L", data)


@lru_cache(1)
def _joining() -> frozenset[str]:
    """Characters that may melt into the one before when text is composed."""
    out = set()
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.combining(c):
            out.add(c)
        parts = unicodedata.decomposition(c)
        if parts and parts[0] != "<":
            out.update(chr(int(p, 16)) for p in parts.split()[1:])
    out.update(map(chr, range(0x1160, 0x1200)))  # Hangul vowels and finals join by rule
    return frozenset(out)


class PrefixCounts:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.lattice = Lattice(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        special = sorted((t["content"] for t in whole["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else re.compile(r"(?!)")
        self.known: dict[str, bytes | list[int]] = {}
        self.words: dict[bytes, list[int]] = {}
        self.last: dict[bytes, int] = {}

    def _learn(self, runs: set[str]) -> dict[str, bytes | list[int]]:
        out = {}
        before = b""
        for r in sorted(runs):
            data = r.encode("utf-8", "replace")
            found, before = self.lattice.run(data, before), data
            out[r] = bytes(found) if found[-1] < 256 and max(found) < 256 else list(found)
        self.lattice.clear()
        return out

    def of_runs(self, runs: list[str]) -> list[bytes | list[int]]:
        """The prefix counts of each run, by bytes."""
        found = list(map(self.known.get, runs))
        if None in found:
            new = self._learn({r for r, f in zip(runs, found) if f is None})
            if len(self.known) + len(new) > MEMORY:
                self.known.clear()
            self.known.update((r, f) for r, f in new.items() if len(r) <= LONG_RUN)
            found = [new[r] if f is None else f for r, f in zip(runs, found)]
        return found

    def _runs(self, text: str) -> list[str]:
        """The runs of a text without special strings."""
        if text.isascii():
            return _ASCII.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return _ANY.findall("".join(c.lower() for c in text) if _PLACED in text else text.lower())

    def of_word(self, word: bytes) -> list[int]:
        """Counts at each character of a word without ASCII white space."""
        found = self.words.get(word)
        if found is None:
            found = self._walk(word.decode("utf-8", "replace"))
            if len(self.words) > MEMORY // 4:
                self.words.clear()
            if len(word) <= LONG_RUN:
                self.words[word] = found
        return found

    def _walk(self, word: str) -> list[int]:
        out: list[int] = []
        base = at = 0
        for m in self.special.finditer(word):
            self._part(word[at : m.start()], base, out)
            base = out[-1] if out else 0
            self._part(m.group()[:-1], base, out)
            base += 1
            out.append(base)
            at = m.end()
        self._part(word[at:], base, out)
        self.lattice.clear()
        return out

    def _part(self, part: str, base: int, out: list[int]) -> None:
        walk = _Walk(self.lattice, base)
        plain = part.isascii() or unicodedata.is_normalized("NFC", part)
        begin = 0
        while begin < len(part):
            end = begin + 1
            while not plain and end < len(part) and part[end] in _joining():
                end += 1
            for stop in range(begin + 1, end + 1):  # prefixes that end inside what is composed
                state = walk.state()
                for c in part[begin:stop] if plain else unicodedata.normalize("NFC", part[begin:stop]):
                    for x in c.lower():
                        walk.feed(x)
                out.append(walk.total())
                if stop < end:
                    walk.back(state)
            begin = end

    def _last(self, words: list[bytes]) -> list[int]:
        """The last entries of words: those of their runs together, one for a special string."""
        runs: list[str] = []
        ends, extra = [0], []
        for w in words:
            parts = self.special.split(w.decode("utf-8", "replace"))
            for part in parts:
                runs += self._runs(part)
            ends.append(len(runs))
            extra.append(len(parts) - 1)
        last = np.r_[0, np.cumsum(np.fromiter(map(itemgetter(-1), self.of_runs(runs)), np.int64, len(runs)))]
        return (np.diff(last[ends]) + np.array(extra, np.int64)).tolist()

    def totals(self, texts: list[bytes]) -> list[int]:
        """The last entry of each text's prefix counts."""
        split = [t.split() for t in texts]
        words = [w for own in split for w in own]
        found = list(map(self.last.get, words))
        if None in found:
            new = list({w for w, n in zip(words, found) if n is None})
            counts = dict(zip(new, self._last(new)))
            if len(self.last) + len(new) > MEMORY:
                self.last.clear()
            self.last.update((w, n) for w, n in counts.items() if len(w) <= LONG_RUN)
            found = [counts[w] if n is None else n for w, n in zip(words, found)]
        total = np.r_[0, np.cumsum(np.array(found, np.int64))]
        return np.diff(total[np.cumsum([0, *map(len, split)])]).tolist()

    def table(self, text: bytes) -> list[int]:
        """Tokens of the prefix of each number of characters, from none on."""
        out, at, base = [0], 0, 0
        for w in text.split():
            begin = text.index(w, at)
            out += [base] * (begin - at)
            at = begin + len(w)
            own = self.of_word(w)
            out += [base + n for n in own]
            base += own[-1]
        out += [base] * (len(text) - at)
        return out


def longest(table: list[int], budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens (0 where even that is less)."""
    return max((i for i, n in enumerate(table) if n <= budget), default=0)


@lru_cache(2)
def counter(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _count(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path or default_path())
        for batch in batches:
            for part in by_bytes(batch, 1, 1 << 22):
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_length(part.column(1)).cast(pa.int64()), pa.array(count.totals(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, limit: int = 2048, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. path: the vocabulary file on the workers; None
    takes the public one installed there."""
    own = docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).cast("binary").alias("body"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_count(path), f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def _prefixes(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path or default_path())
        for batch in batches:
            for part in by_bytes(batch, 1, 1 << 20):
                found = pa.array(map(count.table, part.column(1).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), found], names=["doc_id", "counts"])

    return run


def prefix_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and counts: the tokens of the prefixes of 0, 1, 2, ... characters."""
    own = docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).cast("binary").alias("body"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_prefixes(path), f"doc_id {kind}, counts array<int>")


def longest_prefix(table: DataFrame, budget: int) -> DataFrame:
    """Of a stored prefix table doc_id, n_chars (of the longest prefix of at most `budget`
    tokens) and n_tokens (of that prefix), with built-in functions alone."""
    fits = F.transform("counts", lambda n: (n <= budget).cast("int"))
    n = F.greatest(F.lit(0), F.size("counts") - F.array_position(F.reverse(fits), 1)).cast("int")
    return table.select("doc_id", n.alias("n_chars"), F.element_at("counts", n + 1).alias("n_tokens"))
