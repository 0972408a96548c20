"""Spelling variants, Merkle manifest and order MinHash against plain Python."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from waymark.llm import merkle, order_minhash, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, key string, tree string, side int, signatures string"


def docs_of(spark, rows):
    """rows: doc_id, text, lang, source, n_chars; extra columns clash with names operators use."""
    return spark.createDataFrame([(*r, "w", "k", "t", 1, "s") for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(4, 10))) for _ in range(40)]
    words += [w[:3] + "x" + w[4:] for w in words[:20]] + [w + "s" for w in words[:10]] + ["aabbaa", "aaabbaa", "abbaa", "ÀÉabcd", "àéabcd", "Zebras"]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 120, 60)]
    texts += [None, "", "\n\n", "a\nb", "one two three", "漢字かな交じり文", "x " * 300, "q" * 1000, "no-break space \U0001f600 end"]
    texts += [texts[3]] * 4
    rows = [(i, t, "en" if i % 3 else None, ["s0", "s0", "s1", None, "é", ""][i % 6] if i < 60 else f"own{i}", i * 7 if i % 5 else None) for i, t in enumerate(texts)]
    # a null id, repeated rows, rows of one id
    return [*rows, (None, texts[1], None, "s0", 3), (None, texts[1], None, "s0", 3), rows[3], rows[3], rows[3], (3, "another text of this id", None, "s0", 1), (10**15, "the last of all, with some words", "en", "s9", 2)]


def lowered(x):
    return "".join(c.lower() if c.isascii() else c for c in x)


def variants(rows, min_length=6, min_count=5, ratio=5, every=199):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    found = {w: sorted((-n[x], x) for x in n if near(w, x)) for w in n}
    form = {w: v[0][1] if v and -v[0][0] >= ratio * n[w] else None for w, v in found.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(found[w]), n.get(form[w])) for w in n}


@pytest.mark.parametrize("args", [{}, {"min_count": 2, "ratio": 2, "every": 7}, {"min_length": 1, "min_count": 1, "ratio": 1000}])
def test_spelling(spark, rows, args):
    got = spelling.group_variants(docs_of(spark, rows), **args).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = variants(rows, **args)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_spelling_chain_and_long_words(spark):
    long = "".join(np.random.default_rng(3).choice(list("abcdefgh"), 3000))
    words = ["roots"] * 125 + ["rootes"] * 25 + ["rootesx"] * 5 + ["rootesxy"] + [long] * 10 + [long[:1500] + "z" + long[1500:]] * 2 + [long[1:]] + ["y" + long[:-1]] + ["lonely"] * 3 + ["k" * 70] + ["k" * 71] * 5
    rows = [(i, w, None, None, None) for i, w in enumerate(words)]
    got = {tuple(r) for r in spelling.group_variants(docs_of(spark, rows), 5, 1, 5, 10**9).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == variants(rows, 5, 1, 5, 10**9)
    assert ("rootesxy", "rootesx", "roots", 1, 1, 5) in got


def test_spelling_of_nothing(spark):
    assert spelling.group_variants(docs_of(spark, [(1, None, None, None, None), (2, "", None, None, None)])).count() == 0
    assert spelling.group_variants(docs_of(spark, []).limit(0)).count() == 0


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    def leaf(i, text, lang, source, n):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])

    def proofs(digests):
        """Root and, for each, its siblings as (left, right) of every level."""
        ways, level, of = [[] for _ in digests], list(digests), list(range(len(digests)))
        while len(level) > 1:
            for k, way in enumerate(ways):
                run = of[k] // 3 * 3
                way.append((level[run : of[k]], level[of[k] + 1 : run + 3]))
                of[k] //= 3
            level = [H(*level[i : i + 3]) for i in range(0, len(level), 3)]
        return level[0], ways

    trees = defaultdict(list)
    for i, text, lang, source, n in rows:
        late = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        trees[source].append(((i is not None, i or 0, leaf(i, text, lang, source, n)), i, leaf(i, late, lang, source, n)))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: (sorted(trees[s]), *proofs([x[0][2] for x in sorted(trees[s])])) for s in order}
    root, ways = proofs([inner[s][1] for s in order])
    out = []
    for s, upper in zip(order, ways):
        members, sub, lower = inner[s]
        for (key, i, late), way in zip(members, lower):
            at = late
            for left, right in [*way, *upper]:
                at = H(*left, at, *right)
            out.append((i, key[2], sub, root, H(*[d for left, right in [*way, *upper] for d in (*left, *right)]), at, at == root))
    return Counter(out)


def test_merkle(spark, rows, monkeypatch):
    docs = docs_of(spark, rows)
    monkeypatch.setattr(merkle, "PART_NODES", 10)
    got = merkle.manifest(docs, merkle.newlines_lost(docs["doc_id"], docs["text"])).collect()
    assert Counter(tuple(r) for r in got) == plain_manifest(rows)
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(i, "a\n", None, "s", None) for i in range(28)], [(1, "same\n", "x", str(i), 2) for i in range(10)]])
def test_merkle_shapes(spark, rows):
    docs = docs_of(spark, rows) if rows else docs_of(spark, [(1, None, None, None, None)]).limit(0)
    got = merkle.manifest(docs, merkle.newlines_lost(docs["doc_id"], docs["text"])).collect()
    assert Counter(tuple(r) for r in got) == (plain_manifest(rows) if rows else Counter())


def test_merkle_misses_nothing():
    with pytest.raises(ValueError):
        merkle._complete((("s", 0), [(0, 5, "a"), (2, 5, "b")]))


M64 = (1 << 64) - 1


def xx(*values, seed=42):
    """Spark's xxhash64: each value's hash is the next one's seed."""
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", int(v)) if isinstance(v, np.int32) else struct.pack("<Q", v & M64)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed


def plain_signatures(text, count=order_minhash.SIGNATURES, words=order_minhash.WORDS):
    found = [w for w in re.split(r"[ \t\n\r\f\x0b]+|(?<=[぀-ヿ㐀-鿿가-힯])", text or "") if w]
    h = [xx(w) for w in found]
    seen, marked = Counter(), []
    for i in range(max(len(h) - words, 0) + 1):
        k = xx(*h[i : i + words]) >> 28
        marked.append((xx(k, np.int32(seen[k])) >> 28 if seen[k] else k, i))
        seen[k] += 1
    out = []
    for j in range(count):
        two = [min(((xx(e, np.int32(j)) >> 28, i) for e, i in marked if e % 2 == half), default=None) for half in (0, 1)]
        two = sorted((x for x in two if x), key=lambda x: x[1])
        out.append((xx(*[x[0] for x in two]) >> 32) & 0xFFFFFFFF)
    return out


def test_order_minhash(spark, rows):
    got = order_minhash.edit_likeness(docs_of(spark, rows)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    key = lambda r: (r[0] is not None, r[0] or 0)

    def tie(r):  # equal ids go by two hashes
        t = r[1] or ""
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        ids = [] if r[0] is None else [r[0]]
        return signed(xx(*ids, t)), signed(xx(t, *ids, seed=xx(np.int32(13))))

    ordered = sorted(rows, key=lambda r: (*key(r), *tie(r)))
    sig = {t: plain_signatures(t) for t in {r[1] or "" for r in rows}}
    like = lambda a, b: sum(x == y for x, y in zip(a, b)) / len(a)
    name = lambda s: "".join(f"{x:08x}" for x in s)
    want = Counter()
    for r, nxt in zip(ordered, [*ordered[1:], ordered[0]]):
        t, n = r[1] or "", nxt[1] or ""
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        e = plain_signatures(edited)
        want[(r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), name(sig[t]), name(e), like(sig[t], e), like(sig[t], sig[n]))] += 1
    assert Counter(tuple(r) for r in got) == want


def test_order_minhash_follows_order(spark):
    """Blocks of words in another order keep the k-mers but not the signatures."""
    words = [f"w{i}" for i in range(600)]
    moved = [*words[300:], *words[:300]]
    one = [*words[:300], "new", *words[301:]]
    texts = [" ".join(x) for x in (words, moved, one, words)]
    found = {r.doc_id: r.signatures for r in order_minhash.fingerprints(docs_of(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), count=64).collect()}
    like = lambda a, b: sum(x == y for x, y in zip(found[a], found[b])) / 64
    assert like(0, 3) == 1 and like(0, 2) > 0.9 and 0.25 < like(0, 1) < 0.75


@pytest.mark.parametrize("rows", [[], [(5, "alone in here", None, None, None)], [(None, None, None, None, None)] * 3])
def test_order_minhash_small(spark, rows):
    docs = docs_of(spark, rows) if rows else docs_of(spark, [(1, None, None, None, None)]).limit(0)
    got = order_minhash.edit_likeness(docs).collect()
    assert len(got) == len(rows) and all(r.near_next == 1 for r in got)


def test_order_minhash_is_native(spark, rows):
    plan = order_minhash.edit_likeness(docs_of(spark, rows).select("doc_id", "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
