"""Trained operators: parses against brute force, marginals against enumeration, accuracy on held-out rows."""

from __future__ import annotations

import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest

from waymark.llm import language_id, queries, toxicity
from waymark.llm.common import table

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


def test_cross_parsing():
    model = language_id.Model({"a": "the cat sat on the mat", "b": "der hund und die katze"})
    texts = ["the cat and die katze", "xyz", "on the hund", "the " * 900]
    got, letters = model.phrases(texts)
    for i, t in enumerate(texts):
        codes = model.squeeze(model.lookup[language_id._points(t)]).tolist()
        assert letters[i] == sum(c.isalpha() for c in t)
        for k, lang in enumerate(model.langs):
            train = bytes(model.squeeze(model.lookup[language_id._points({"a": "the cat sat on the mat", "b": "der hund und die katze"}[lang])]).tolist())
            n = 0
            for lo in range(0, len(codes), language_id.SEGMENT):
                part = bytes(codes[lo : lo + language_id.SEGMENT])
                at = 0
                while at < len(part):
                    size = 1
                    while at + size < len(part) and part[at : at + size + 1] in train:
                        size += 1
                    at, n = at + size, n + 1
            assert got[i, k] == n
    assert model.predict([None, "", "123 --", "the mat"])[0] == ["und", "und", "und", "a"]


def test_letters_of_all_scripts(monkeypatch):
    rng = np.random.default_rng(5)
    latin, cyrillic = [chr(97 + i) for i in range(26)], [chr(0x430 + i) for i in range(32)]
    han = [chr(0x4E00 + i) for i in range(300)]
    text = lambda abc, n: " ".join("".join(rng.choice(abc, 5)) for _ in range(n))
    greek, thai = [chr(0x3B1 + i) for i in range(17)], [chr(0xE01 + i) for i in range(30)]
    scripts = {"latin": latin, "cyrillic": cyrillic, "greek": greek, "thai": thai, "han": han}
    samples = {k: text(v, 900 if k in ("latin", "cyrillic") else 300) for k, v in scripts.items()}
    texts = [text(v, 30) for v in scripts.values()]
    model = language_id.Model(samples)
    assert model.predict(texts)[0] == list(scripts)
    monkeypatch.setattr(language_id, "CELLS", 1)  # no columns for letters: all are searched
    assert (language_id.Model(samples).phrases(texts)[0] == model.phrases(texts)[0]).all()


def test_every_language_is_learned(spark):
    copies = [(i, "copied " + "abcdefghij"[i % 5] * 9, "copies") for i in range(20_000)]
    others = [(i, f"text of {i}", f"l{i:03}") for i in range(230)]
    docs = spark.createDataFrame(copies + others, "doc_id long, text string, lang string")
    samples = dict(language_id.learn(docs))
    assert len(samples) == 231 and sorted(samples["copies"].split()[1::2]) == [c * 9 for c in "abcde"]


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    e, trans = rng.normal(size=5), rng.normal(size=(2, 2))
    weight = np.zeros(5)
    total = 0.0
    for y in itertools.product((0, 1), repeat=5):
        s = np.exp(sum(e[i] * v for i, v in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total += s
        weight += s * np.array(y)
    layout = toxicity._layout(np.array([0, 5]))
    assert np.allclose(toxicity.marginals(e, layout, trans)[0], weight / total)
    assert np.allclose(toxicity.toxic_odds(e, layout, trans), weight / total)


def test_toxic_spans():
    rng = np.random.default_rng(2)
    words = [f"w{chr(97 + i)}{chr(97 + j)}x" for i in range(20) for j in range(10)]
    texts, labels = [], []
    for k in range(200):
        t = rng.choice(words, 40).tolist()
        if k % 2:
            for p in rng.choice(40, 4, replace=False):
                t[p] = "vilething"
        texts.append(" ".join(t))
        labels.append(k % 2)
    field = toxicity.fit(texts, labels)
    assert field.spans("wabx vilething, wacx Vilething vilething") == [(5, 14), (21, 40)]
    assert field.spans("é — Vilething, wabx 😀") == [(4, 13)] and field.spans("İx Vilething, b") == [(3, 12)]
    assert (field.score(texts) >= 0.5).tolist() == [bool(x) for x in labels]
    assert toxicity.fit(["a"], [0]) is None and 0 <= field.score([""])[0] < 0.5


def test_near_copies_are_no_evidence():
    rng = np.random.default_rng(3)
    parts = ["ta", "ko", "mi", "re", "su", "lo", "ne", "ba", "du", "fi"]
    word = lambda: "".join(rng.choice(parts, rng.integers(2, 5)))
    text = lambda n: [word() for _ in range(n)]
    texts, labels = [], []
    for k in range(160):
        t = text(60)
        if k % 4 == 0:
            t[k % 60] = "vilething"
        texts.append(" ".join(t))
        labels.append(int(k % 4 == 0))
    base = text(80)
    base[5] = "vilething"
    for _ in range(40):  # near copies of one toxic text
        t = list(base)
        for p in rng.choice(np.arange(6, 80), 3, replace=False):
            t[p] = word()
        texts.append(" ".join(t))
        labels.append(1)
    assert sum(1 for _ in toxicity.distinct((toxicity.words_of(t), 0) for t in texts)) < 170
    field = toxicity.fit(texts, labels)
    clean = [" ".join(text(200)) for _ in range(50)] + [" ".join(base[6:] * 20)]
    assert (field.score(clean) < 0.5).all()
    assert (field.score([c + " vilething" for c in clean[:50]]) >= 0.5).all()


def test_long_texts_are_learned(spark, monkeypatch):
    rng = np.random.default_rng(6)
    parts = ["ta", "ko", "mi", "re", "su", "lo", "ne", "ba", "du", "fi"]
    text = lambda n: ["".join(rng.choice(parts, rng.integers(2, 5))) for _ in range(n)]
    rows = []
    for k in range(120):
        t = text(1000)  # over SAMPLE_CHARS characters
        if k % 3 == 0:
            t[int(rng.integers(1000))] = "vilething"
        rows.append((k, " ".join(t), "long", int(k % 3 == 0)))
    rows.append((500, "quick brown fox jumps", "short", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    assert min(len(r[1]) for r in rows[:-1]) > toxicity.SAMPLE_CHARS
    samples = dict(language_id.learn(docs))
    assert set(samples) == {"long", "short"} and len(samples["long"]) == language_id.SAMPLE_TOTAL
    field = toxicity.learn(docs, docs.select("doc_id", "toxic"))
    assert (field.score([" ".join([*text(50), "vilething"]), " ".join(text(50))]) >= 0.5).tolist() == [True, False]
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 3)
    toxic = [len(r.text) for r in toxicity.sample(docs, docs.select("doc_id", "toxic")).collect() if r.toxic]  # the bound is on all of them together
    assert 2 <= len(toxic) <= 3 and max(toxic) > toxicity.SAMPLE_CHARS and sum(toxic) <= 3 * toxicity.SAMPLE_CHARS + 10


@needs_data
def test_language_accuracy(spark):
    docs = table(spark, DATA, "documents")
    got = {r.doc_id: r for r in queries.op2_language_id(spark, DATA).collect()}
    truth = [(got[r.doc_id], r.lang) for r in docs.collect()]
    held = [g.lang_pred == lang for g, lang in truth if g.held_out]
    assert len(got) == docs.count() and np.mean(held) > 0.98 and all(0 <= g.score <= 1 for g, _ in truth)


@needs_data
def test_toxicity_query(spark):
    """The query against a plain loop over the documents, and its recall and precision."""
    docs = {r.doc_id: r.text or "" for r in table(spark, DATA, "documents").collect()}
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, DATA).collect()}
    assert set(got) == set(docs)
    field = toxicity.learn(table(spark, DATA, "documents"), table(spark, DATA, "labels"))
    for i, text in docs.items():
        assert abs(field.score([text])[0] - got[i].score) < 1e-9 and got[i].predicted == (got[i].score >= 0.5)
        assert [(s.start, s.stop) for s in got[i].spans] == field.spans(text)
    toxic = {r.doc_id: r.toxic for r in table(spark, DATA, "labels").collect()}
    found = [i for i in toxic if got[i].predicted]
    known = [i for i in toxic if toxic[i]]
    # some documents with the label hold no toxic word: junk that kept it. The others have words
    # of which ten toxic documents or more, and no clean one, have some.
    words = {i: set(toxicity.words_of(docs[i])) for i in toxic}
    telling = {w for w, n in Counter(w for i in known for w in words[i]).items() if n >= 10} - {w for i in toxic if not toxic[i] for w in words[i]}
    real = [i for i in known if words[i] & telling]
    assert len(telling) >= 5 and len(real) >= 0.6 * len(known)
    assert sum(toxic[i] for i in found) >= 0.95 * len(found) and sum(got[i].predicted for i in real) >= 0.95 * len(real)
    held = [i for i in real if got[i].held_out]
    assert held and all(got[i].predicted for i in held)
    assert all(got[i].spans for i in found)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", None, "s"), (None, None, "en", "s")], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()] == [0.0, 0.0]
    assert {r.lang_pred for r in language_id.identify(docs, language_id.learn(docs)).collect()} == {"und"}


def test_toxic_fit_is_bounded(monkeypatch):
    """The fit takes little more than its words' numbers, and runs of any size give one field."""
    import tracemalloc

    rng, names = random.Random(5), ["".join(p) for p in itertools.product("bdfgklmn", "aeiou", "prstvxyz")]
    texts = [" ".join(rng.choices(names, k=6000)) + (" vile" * 3 if i % 3 == 0 else "") for i in range(60)]
    monkeypatch.setattr(toxicity, "STEPS", 2)
    monkeypatch.setattr(toxicity, "FEATURES", 1 << 12)
    whole = toxicity.fit(texts, [int(i % 3 == 0) for i in range(60)])
    monkeypatch.setattr(toxicity, "RUN", 1 << 13, raising=False)
    tracemalloc.start()
    field = toxicity.fit(texts, [int(i % 3 == 0) for i in range(60)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * 360_000  # it took about 100 bytes a word
    assert np.allclose(field.weights, whole.weights, atol=1e-5) and np.allclose(field.outer, whole.outer, atol=1e-6)
