"""Operators against brute force on small tables with nulls, empties, ties and repeats."""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash

from waymark.llm import common, decontaminate, mixing, simhash_dedup, substring_dedup, token_counts, url_rules, vector_dedup, warc
from waymark.llm import suffix
from waymark.llm.anchors import runs
from waymark.llm.suffix import permuted_lcp, repeated_windows, suffix_array

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, count long"


def docs_of(spark, texts, ids=None):
    """Extra columns clash with names that operators use."""
    rows = [(i, t, None, "s" if k % 3 else None, None, "x", 7) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(2, 7))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(words, n))
    shared, own = make(60), [make(int(n)) for n in rng.integers(5, 200, 30)]
    out = [None, "", " ", "ä", *own, own[3], own[3], make(20) + shared + make(30), shared, make(5) + " " + shared, "ab " * 200, "ab " * 150 + make(40), "x" * 1000]
    near = own[5].split()
    near[2] = "changed"
    return [*out, " ".join(near), " ".join(near + ["end"]), "THE " + own[6], "the " + own[6]]


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(150):
        t = np.r_[rng.integers(1, rng.integers(2, 5), rng.integers(1, 60)), 0].astype(np.int16)
        sa, plain = suffix_array(t), t.tolist()
        assert sa.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
        plcp, before = permuted_lcp(t, sa, np.full(len(t), 1 << 30))
        for i, b in enumerate(before.tolist()):
            if b >= 0:
                n = 0
                while max(i, b) + n < len(plain) and plain[i + n] == plain[b + n]:
                    n += 1
                assert plcp[i] == n


def test_suffix_array_of_long_text(monkeypatch):
    """Prose with repeats recurses on its names, whether suffixes are induced many at a time or singly."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("aehinorst"), rng.integers(2, 9))) for _ in range(3000)]
    some = " ".join(rng.choice(words, 30_000))
    raw = (some + some[1000:30_000] + "ab" * 3000 + some[:50_000]).encode()
    t = np.r_[np.frombuffer(raw, np.uint8).astype(np.int16) + 1, 0].astype(np.int16)
    n, rank, step = len(t), t.astype(np.int64), 1
    while True:  # plain doubling
        key = rank * (n + 1) + np.r_[rank[step:] + 1, np.zeros(min(step, n), np.int64)][:n]
        _, rank = np.unique(key, return_inverse=True)
        if rank.max() == n - 1:
            break
        step *= 2
    depth, whole = [], suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda x: (depth.append(int(x.max())), whole(x))[1])
    for many in (suffix.MANY, 0, 1 << 40):
        monkeypatch.setattr(suffix, "MANY", many)
        assert (suffix.suffix_array(t) == np.argsort(rank)).all()
    assert len(depth) > 9 and max(depth) > 2048


def test_runs_meet_by_key():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 100, 300).astype(np.uint8)) for _ in range(6)]
    texts += [texts[0][50:280] + texts[1][:90], b"ab" * 200, b"short"]
    keys: dict[bytes, set[int]] = {}
    for t, (v, s, n, *_) in zip(texts, runs(texts, 64)):
        assert sum(n.tolist()) == max(0, len(t) - 63)
        for key, start, count in zip(v.tolist(), s.tolist(), n.tolist()):
            for i in range(start, start + count):
                keys.setdefault(t[i : i + 64], set()).add(key)
    assert all(len(k) == 1 for k in keys.values())


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats(spark, texts, hot):
    width = 60
    got = substring_dedup.remove_repeats(docs_of(spark, texts), width=width, hot_runs=hot).collect()
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + width] for t in data for i in range(len(t) - width + 1))
    assert len(got) == len(texts)
    for r in got:
        t = data[r.doc_id]
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
        assert r.kept_text == kept.decode("utf-8", "ignore")


def test_repeated_rows_with_one_id(spark):
    text = "word " * 3 + "".join(chr(97 + i * i % 26) for i in range(200))
    got = substring_dedup.remove_repeats(docs_of(spark, [text, text, "other"], [5, 5, None]), width=50).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("5", len(text)), ("5", len(text)), ("None", 0)]


def test_shard_pieces():
    rng = np.random.default_rng(3)
    for _ in range(40):
        w = int(rng.integers(2, 12))
        pieces = [bytes(rng.integers(97, 99, rng.integers(0, 50)).astype(np.uint8)) for _ in range(6)]
        seen = Counter(p[i : i + w] for p in pieces for i in range(len(p) - w + 1))
        assert [h.tolist() for h in repeated_windows(pieces, w)] == [[seen[p[i : i + w]] > 1 for i in range(len(p) - w + 1)] for p in pieces]


def plain_print(t: str | None) -> int:
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
    n = min(4, len(words))
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("hot", [simhash_dedup.HOT, 2])
def test_simhash(spark, texts, hot):
    rng = np.random.default_rng(4)
    got = {r.doc_id: r for r in simhash_dedup.dedup(docs_of(spark, texts)).collect()}
    prints = [plain_print(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    # chains of made-up fingerprints
    base = rng.integers(0, 2**63, 40).tolist()
    made = list(base)
    for b in base:
        for _ in range(6):
            for bit in rng.choice(64, 4, replace=False):
                b ^= 1 << int(bit)
            made.append(b)
    made = [int(np.uint64(m).view(np.int64)) for m in made]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(made)] + [(None, made[0])], "doc_id long, fp long")
    label = {r.fp: r.component_id for r in simhash_dedup.label(rows, hot=hot).collect()}
    least = list(range(len(made)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(made):
            for j, b in enumerate(made):
                if (np.uint64(a & (2**64 - 1)) ^ np.uint64(b & (2**64 - 1))).bit_count() <= 4 and least[j] < least[i]:
                    least[i], changed = least[j], True
    assert [label[m] for m in made] == least


def test_keys_cover_four_errors():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(64, 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    sets = [[set() for _ in a], [set() for _ in a]]
    for own, x in zip(sets, (a, b)):
        for k, r in zip(*(z.tolist() for z in simhash_dedup.keys(x))):
            own[r].add(k)
    assert all(x & y for x, y in zip(*sets))


@pytest.mark.parametrize("cap", [6000, 40])
def test_vectors(spark, cap):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 16))
    x = np.r_[base, base[:10] + rng.normal(size=(10, 16)) * 0.1, base[:3], np.tile(base[5], (30, 1)) + rng.normal(size=(30, 16)) * 0.15]
    rows = [(i, v.astype(float).tolist(), "x") for i, v in enumerate(x)]
    odd = [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [float("nan")] * 16, "x"), (903, [None] * 16, "x"), (0, rows[0][1], "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rows string")
    got = vector_dedup.dedup(df, cap=cap, shard=20).collect()
    y = np.r_[x, x[:1]]
    ids = [*range(len(x)), 0]
    u = y / np.linalg.norm(y, axis=1)[:, None]
    link = u @ u.T >= 0.95
    least = ids.copy()
    for _ in range(len(ids)):
        least = [min(least[j] for j in np.flatnonzero(row)) for row in link]
    want = Counter((i, int(row.sum()) - 1, c) for i, row, c in zip(ids, link, least))
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id < 900) == want
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got if r.vec_id >= 900)


def planted(rng, n, size, groups):
    """n random vectors, and `groups` tight clusters of 2 to 12 near copies."""
    x = [rng.normal(size=(n, size))]
    for k in range(groups):
        x.append(rng.normal(size=(1, size)) + rng.normal(size=(2 + k % 11, size)) * 0.15)
    return np.concatenate(x)


@pytest.mark.parametrize("most", [vector_dedup.MAX_SHARDS, 4])
def test_vector_recall(spark, most):
    """Over 5,000 vectors with planted links; with few first centroids, cells are split again."""
    rng = np.random.default_rng(10)
    x = planted(rng, 4000, 24, 220)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    assert len(x) > 5000 and link.sum() > 2000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    shard = 150
    got = {r.vec_id: r for r in vector_dedup.dedup(df, shard=shard, most=most).collect()}
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.95 * link.sum() <= found <= link.sum()
    assert all(got[i].n_links <= link[i].sum() for i in range(len(x)))
    nodes = vector_dedup.kept(vector_dedup.nodes_of(df), "nodes")
    pairs = vector_dedup.kept(vector_dedup.near_pairs(nodes, shard=shard, most=most), "pairs")
    hit, all_ = vector_dedup.audit(df, pairs, nodes, block=30)
    asked = [i for i in range(len(x)) if i % 50 == 0]
    assert all_ == len({(max(i, j), min(i, j)) for i in asked for j in np.flatnonzero(link[i])}) > 0 and hit >= 0.95 * all_
    assert abs(2 * pairs.count() - found) <= 0.02 * found


def test_extreme_vectors(spark):
    rows = [[1e200, 1e200], [1e200, 1.001e200], [1e-200, 1e-200], [1.0, 0.1], [1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [5e-324, 0.0, 0.0, 0.0], [1e308, 1e307, 0.0, 0.0]]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.dedup(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6)}
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vector_dedup.dedup(empty).count() == 0


def test_search_leaves_the_shard(spark):
    """Linked nodes that share no shard are found over the lists of a node between them."""
    at = [0.0, 0.25, 0.55, 0.85]  # radians; 0.95 is reached up to 0.317
    v = [[float(np.cos(t)), float(np.sin(t))] for t in at]
    own = spark.createDataFrame([(i, x, 1, s) for i, (x, s) in enumerate(zip(v, ([1], [2], [2, 3], [3])))], "node long, v array<double>, rows long, shards array<long>")
    sim = lambda i, j: float(np.cos(at[i] - at[j]))
    lists = [(1, [{"shard": 2, "near": [2], "sim": [sim(1, 2)]}]), (2, [{"shard": 2, "near": [1], "sim": [sim(1, 2)]}, {"shard": 3, "near": [3], "sim": [sim(2, 3)]}])]
    united = spark.createDataFrame(lists, "node long, lists array<struct<shard:long,near:array<long>,sim:array<double>>>")
    found = spark.createDataFrame([(vector_dedup.BEYOND, 0, 1, 0.0), (vector_dedup.BEYOND, 0, 3, 0.0)], vector_dedup._FOUND)
    got = vector_dedup._beyond(found, own, united, 0.95).collect()
    assert [(r.a, r.b) for r in got if r.kind == vector_dedup.PAIR] == [(1, 0)]
    assert sorted((r.a, r.n) for r in got if r.kind == vector_dedup.COUNT) == [(0, 1.0), (1, 1.0)]


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    odd = ["don't stop", "a<|endoftext|>b  <|startoftext|>", "İX é ﬁ", "x" * 300, "١٢ 3４", "a b\u2028c\x1cd"]
    all_texts = [*texts, *odd]
    t = Tokenizer.from_file(token_counts.default_path())
    got = {r.doc_id: r for r in token_counts.count_tokens(docs_of(spark, all_texts), limit=50).collect()}
    for i, text in enumerate(all_texts):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 50)


def test_every_prefix(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(8)
    t = Tokenizer.from_file(token_counts.default_path())
    count = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    letters = list("abcdefghijklmnopqrstuvwxyz'' 0.!,é-'STRELV") + ["\u0301"]
    odd = ["don't it'll 're we'rex 'r 'l 'll x'sy !'s ''s", "a<|endoftext|>b  <|startoftext|>x <|endoftext <|endoftext||>", "İX é ﬁ e\u0323\u0301x q\u0323\u0307", "١٢ 3４ 12a", "a\xa0b\u2028c\x1cd\x85e", "A\u030angstro\u0308m ΣΑΣ", "日本語한국어\u1112\u1161\u11ab", "antidisestablishmentarianism" * 6, "😀👩\u200d👧 !!!???", "'\u0301s 'S 'RE", "a" * 300, "", None]
    texts = odd + ["".join(rng.choice(letters, rng.integers(1, 30))) for _ in range(150)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    table = token_counts.prefix_table(rows).cache()
    got = {r.doc_id: r.counts for r in table.collect()}
    for i, x in enumerate(texts):
        assert got[i] == [count((x or "")[:n]) for n in range(len(x or "") + 1)], x
    for budget in (0, 1, 4, 9):
        for r in token_counts.longest_prefix(table, budget).collect():
            n = token_counts.longest(got[r.doc_id], budget)
            assert (r.n_chars, r.n_tokens) == (n, count((texts[r.doc_id] or "")[:n])) and r.n_tokens <= budget
    assert token_counts.count_tokens(rows.limit(0)).count() == token_counts.prefix_table(rows.limit(0)).count() == 0


def test_long_word_and_text(spark):
    """A long text without white space, and one of many words, take linear time."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.default_path())
    rng = np.random.default_rng(9)
    word = "".join(rng.choice(list("aeionrst"), 200_000))
    texts = [word, word[:9] + " " + "the brown fox, " * 40_000]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.counts for r in token_counts.prefix_table(rows).collect()}
    for i, x in enumerate(texts):
        for n in (1, 77, 1000, len(x)):
            assert got[i][n] == len(t.encode(x[:n], add_special_tokens=False).ids)
    assert sorted(r.n_tokens for r in token_counts.count_tokens(rows).collect()) == sorted(got[i][-1] for i in got)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?y", "http://example.net", "http://net/", "http://xnet/", "https://x.example.com/de/a#b", "http://example.com/den", "http://q.org/fr/", "http://q.org/frx", "a://b.net?q=/x", "http://u@e.net:80/p", "x://y://z.net/"]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)] + [(3, urls[3], "h", "x")], "page_id long, url string, rule string, host string")
    for r in url_rules.judge(pages).collect():
        url = urls[r.page_id] or ""
        rest = url.partition("://")[2] if "://" in url else ""
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
        fit = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2]), url
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_decontamination(spark, texts):
    items = [(1, texts[10]), (2, "short one"), (3, None), (4, ""), (5, texts[12]), (10, texts[12]), (None, texts[14])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    own = [*texts, "a Short, ONE b", "zz " + " ".join((texts[10] or "").split()[:15]) + " yy" * 300]
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs_of(spark, own), bench, keep_text=True).collect()}
    assert got == {r.doc_id: r for r in decontaminate.decontaminate(docs_of(spark, own), bench, most=10, keep_text=True).collect()}  # shuffled
    words = lambda t: decontaminate.words_of((t or "").encode())
    for i, text in enumerate(own):
        w, hit, found = words(text), set(), set()
        for item, t in items:
            x = words(t)
            n = min(13, len(x))
            wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if x else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found.add(item)
        names = sorted(str(x) for x in found if x is not None)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    for most in (10, -1):
        assert not any(r.contaminated for r in decontaminate.decontaminate(docs_of(spark, own), bench.limit(0), most=most).collect())
    with pytest.raises(ValueError, match="too many"):
        decontaminate.windows(bench, most=10)


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "", None, "<p>a</p>", "WARC/1.1\r\nx", "é" * 50, "<p>a</p>"]
    rows = [(i, None if i == 5 else f"http://h/{i}\r\nx", h, "x") for i, h in enumerate(html)] + [(None, "u", "lone", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/w"
    warc.write(pages, path, per_file=3, compression="none")
    assert warc.read(spark, path).filter("gap IS NULL").count() == len(rows)
    path = f"file://{tmp_path}/z"
    warc.write(pages, path, per_file=3)
    got = {r.page_id: r for r in warc.digests(warc.read(spark, path)).collect()}
    import base64

    for i, _, h, _ in rows:
        data = (h or "").encode()
        first = min([j for j, x in enumerate(html) if (x or "") == (h or "")], default=None)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if i is None or i == first else ("revisit", first))
    assert warc.read(spark, path).filter("gap IS NOT NULL").count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_damage_costs_one_record(spark, tmp_path, compression):
    import glob
    import gzip

    rng = np.random.default_rng(8)
    html = ["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(40)]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string").selectExpr("page_id", "'http://h/' AS url", "html").coalesce(1)
    warc.write(pages, f"file://{tmp_path}/w", compression=compression)
    (name,) = glob.glob(f"{tmp_path}/w/part-*")
    data = bytearray(open(name, "rb").read())
    plain = gzip.decompress(data) if compression == "gzip" else bytes(data)
    assert [int(h["warc-record-id"][10:-1]) for _, h, _ in warc.salvage(plain)[0]] == [int(x) for x in re.findall(rb"WARC-Record-ID: <urn:page:(\d+)>", plain)]
    starts = [at for at, *_ in warc.salvage(bytes(data))[0]]
    assert len(set(starts)) == 40
    data[starts[20] + 800] ^= 1
    found, gaps = warc.salvage(bytes(data))
    assert [at for at, *_ in found] == starts[:20] + starts[21:]
    assert gaps == [(starts[20], starts[21] - starts[20])]


def test_members_of_any_size():
    import gzip

    for size in (0, 5, (1 << 24) - 1, (1 << 24) + 7):
        assert gzip.decompress(warc._member_row(b"x" * size) + b"\0") == b"x" * size


def test_salvage():
    import gzip

    def rec(n, body):
        return b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, len(body), body)

    a, b, c = rec(1, b"one"), rec(2, b"two" * 9), rec(3, b"three")
    broken = b.replace(b"Content-Length: 27", b"Content-Length: 99")
    found, gaps = warc.salvage(a + broken + c)
    assert [h["warc-record-id"] for _, h, _ in found] == ["<urn:1>", "<urn:3>"] and gaps == [(len(a), len(broken))]
    found, gaps = warc.salvage(b"junk" + a + c[:-10])
    assert len(found) == 1 and gaps == [(0, 4), (4 + len(a), len(c) - 10)]
    za, zb, zc = map(gzip.compress, (a, b, c))
    bad = zb[:20] + b"\xff\xff" + zb[22:]
    found, gaps = warc.salvage(za + bad + zc)
    assert [h["warc-record-id"] for _, h, _ in found] == ["<urn:1>", "<urn:3>"] and sum(n for _, n in gaps) == len(bad)
    assert warc.salvage(b"") == ([], [])
    many = [rec(n, bytes(np.random.default_rng(n).integers(32, 127, 3000, np.uint8))) for n in range(40)]
    one = gzip.compress(b"".join(many))
    bad = one[: len(one) // 2] + b"\0" * 60 + one[len(one) // 2 + 60 :]
    found, gaps = warc.salvage(bad + zc)
    ids = [h["warc-record-id"] for _, h, _ in found]
    assert 10 < len(ids) < 40 and ids[:-1] == [f"<urn:{n}>" for n in range(len(ids) - 1)] and ids[-1] == "<urn:3>" and sum(n for _, n in gaps) == len(bad)


def test_mixing(spark):
    rows = [(i, "ab" * (1 + i % 5), "big" if i % 3 else ("small" if i % 2 else None)) for i in range(3000)] + [(None, None, "big"), (7, "x", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    size = Counter()
    for r in got:
        size[r.source] += len(r.text or "")
    total = sum(len(t or "") for _, t, _ in rows)
    assert all(abs(size[s] / total - 1 / 3) < 0.04 for s in ("big", "small", None))
    per = Counter((r.doc_id, r.source, r.text) for r in got)
    assert max(per.values()) <= 20 and sorted(got, key=lambda r: r.shuffle_key) != sorted(got, key=lambda r: str(r.doc_id))
    weights = spark.createDataFrame([("big", 3.0), ("small", 1.0)], "source string, weight double")
    only = Counter(r.source for r in mixing.mix(docs, weights).collect())
    assert None not in only and only["big"] > only["small"]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_small_sources_reach_their_weight(spark):
    rows = [(i, "x" * 100, "big") for i in range(20_000)] + [(100_000 + i, "y" * 100, "tiny") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = Counter({r.source: r["count"] for r in mixing.mix(docs).groupBy("source").count().collect()})
    assert abs(size["tiny"] / sum(size.values()) - 0.5) < 0.03
    assert Counter({r.source: r["count"] for r in mixing.mix(docs, most=8.0).groupBy("source").count().collect()})["tiny"] < 1000
    u = np.linspace(0.001, 0.999, 99).tolist()
    for rate in (0.0, 2.5, 9.0, 100.0):
        p, want = np.cumsum([np.exp(k * np.log(rate) - rate - sum(np.log(np.arange(1, k + 1)))) if rate else float(k == 0) for k in range(400)]), []
        got = [r.n for r in spark.createDataFrame([(rate, x) for x in u], "r double, u double").select("u", mixing.quantile("r", "u").alias("n")).orderBy("u").collect()]
        assert got == [int((p <= x).sum()) for x in u], rate


def test_poisson_quantile(spark):
    u = np.linspace(0.001, 0.999, 200)
    df = spark.createDataFrame([(float(x),) for x in u], "u double").withColumn("cdf", mixing.cumulative(mixing.F.lit(2.5)))
    got = [r.n for r in df.selectExpr("u", "size(filter(cdf, x -> x <= u)) AS n").orderBy("u").collect()]
    p = np.cumsum([np.exp(-2.5) * 2.5**k / float(np.prod(np.arange(1, k + 1))) for k in range(40)])
    assert got == [int((p <= x).sum()) for x in u]


def test_sweep(spark):
    from waymark.llm import common

    common.sweep(spark)
    df = common.kept(spark.range(3).toDF("x"), "swept")
    assert df.count() == 3 and common.sweep(spark) == 1
    with pytest.raises(Exception, match="(?i)not.exist|PATH_NOT_FOUND"):
        spark.read.parquet(df.inputFiles()[0]).count()


@pytest.mark.parametrize("raw", [b"a" * 300_000, b"ab" * 150_000, b"   \n" * 75_000, b"abc" * 1000 + b"=" * 100_000 + b"abc" * 1000 + b"=" * 100_000])
def test_periodic_bytes(raw):
    """Runs of a period cost a few microseconds a byte, not a numpy step each (which took over 25 s here)."""
    began = time.time()
    (hit,) = repeated_windows([raw], 200)
    assert time.time() - began < 5
    seen = Counter(raw[i : i + 200] for i in range(len(raw) - 199))
    assert hit.tolist() == [seen[raw[i : i + 200]] > 1 for i in range(len(raw) - 199)]


def test_long_names_of_suffixes():
    """LMS substrings of over FAR symbols that are alike for long, compared by their rests."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        parts = [b"c" * int(n) + b"d" * int(m) + b"a" for n, m in zip(rng.integers(60, 200, 12), rng.integers(60, 75, 12))]
        raw = b"".join(parts[i] for i in rng.integers(0, 12, 10))
        t = np.r_[np.frombuffer(raw, np.uint8).astype(np.int16) + 1, 0].astype(np.int16)
        plain = t.tolist()
        assert suffix_array(t).tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])


def test_many_equal_rows(spark):
    """2000 rows of one text and id take about as long as 2000 of different ids."""
    text = "".join(np.random.default_rng(4).choice(list("abcdefgh "), 5000))
    took = []
    for ids in (list(range(2000)), [None] * 2000):
        rows = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string").repartition(4)
        began = time.time()
        got = substring_dedup.remove_repeats(rows, width=200, keep_text=False).collect()
        took.append(time.time() - began)
        assert len(got) == 2000 and {(r.n_removed, r.n_spans) for r in got} == {(5000, 1)}
    assert took[1] < 2 * took[0] + 2


def test_gathered_or_counted(spark, texts, monkeypatch):
    """Keys over GATHER_BYTES give the same result."""
    docs = docs_of(spark, texts)
    want = sorted(map(tuple, substring_dedup.remove_repeats(docs, width=50, keep_text=False).collect()), key=str)
    monkeypatch.setattr(substring_dedup, "GATHER_BYTES", 1)
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs, width=50, keep_text=False).collect()), key=str) == want


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[2,1,1024]", "yarn"])
def test_a_cluster_needs_a_shared_folder(master):
    """Unset, the folder would be one that executors don't share."""
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session)


def test_filter_before_the_shuffle(spark):
    """No digest of the benchmark is left out, few others pass; an empty one passes none."""
    rng = np.random.default_rng(8)
    w = rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    bits = decontaminate._filter(spark.createDataFrame([(int(x),) for x in w], "w1 long").repartition(5))
    assert decontaminate._may_be(bits, w).all() and decontaminate._may_be(bits, rng.integers(-(1 << 63), (1 << 63) - 1, 20000)).mean() < 0.12
    assert not decontaminate._may_be(decontaminate._filter(spark.createDataFrame([], "w1 long")), w).any()
