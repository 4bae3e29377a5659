"""The network against a plain one, its gradients against differences, and its held-out accuracy."""

import zlib

import numpy as np
import pytest

from waymark.llm import language

KIND = "doc_id bigint, text string, lang string, h int, raw string"


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_states(layer, raw):
    n, h, out = language.HIDDEN, np.zeros(language.HIDDEN), []
    for byte in raw:
        own, back = layer.own[:, byte].astype(float), layer.back.astype(float) @ h
        z, r = sigmoid(own[:n] + back[:n]), sigmoid(own[n : 2 * n] + back[n : 2 * n])
        h = (1 - z) * h + z * np.tanh(own[2 * n :] + r * back[2 * n :])
        out.append(h)
    return np.array(out)


def plain_chances(model, text):
    raw, sums = text.encode(), np.zeros(len(model.langs))
    for at in range(0, len(raw), language.WINDOW):
        piece = raw[at : at + language.WINDOW]
        states = np.hstack([plain_states(model.ahead, piece), plain_states(model.behind, piece[::-1])[::-1]])
        p = np.exp(states @ model.out.T.astype(float) + model.bias)
        p /= p.sum(axis=1, keepdims=True)
        sums += p[[b >= 128 or chr(b).isalpha() for b in piece]].sum(axis=0)
    return sums / sums.sum() if sums.sum() else np.full(len(model.langs), 1 / len(model.langs))


def untrained(langs=("a", "b", "c")):
    return language.fit(np.zeros((1, language.WINDOW), np.uint8), np.zeros(1, int), list(langs), steps=0)


def test_chances():
    model = untrained()
    texts = ["Un été à la plage, 12 fois.", "", "x", "...", "word " * 40, "é" * 64, "a" * 65]
    got = model.chances(texts)
    assert np.allclose(got, [plain_chances(model, t) for t in texts], atol=1e-5)


def test_gradients():
    """Back through time: a weight's gradient is the loss's difference quotient."""
    rng, model = np.random.default_rng(3), untrained()
    rows = rng.integers(97, 123, (5, 12)).astype(np.uint8)
    rows[0, 9:] = 255
    steps = np.ascontiguousarray(rows.T)
    wanted = rng.normal(size=(12, language.HIDDEN, 5)).astype(np.float32)
    keep = []
    model.ahead.run(steps, np.empty_like(wanted), keep)
    own, back = model.ahead.learn(steps, keep, wanted)

    def loss():
        return float((model.ahead.run(steps, np.empty_like(wanted)).astype(float) * wanted).sum())

    for weights, grad in ((model.ahead.own, own), (model.ahead.back, back)):
        for at in rng.permutation(np.argwhere(np.abs(grad) > 0.05))[:25]:
            at, e = tuple(at), np.float32(1e-2)
            weights[at] += e
            up = loss()
            weights[at] -= 2 * e
            down = loss()
            weights[at] += e
            assert (up - down) / 0.02 == pytest.approx(grad[at], rel=0.03, abs=0.02)


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    found = {r.doc_id: r for r in language.predict(docs, model).collect()}
    told = [(r.lang, found[r.doc_id]) for r in docs.select("doc_id", "lang").collect()]
    assert all(f.held_out == (zlib.crc32(str(f.doc_id).encode()) % 3 == 1) for f in found.values()) and all(0 <= f.score <= 1 for f in found.values())
    unseen = [(x, f.lang_pred) for x, f in told if f.held_out and x is not None]
    assert len(unseen) > 200 and sum(a == b for a, b in unseen) >= 0.97 * len(unseen)
    texts = [r.text for r in docs.orderBy("doc_id").limit(20).collect()]
    assert np.allclose(model.chances(texts), [plain_chances(model, t[:100_000]) for t in texts], atol=1e-4)


def test_odd_rows(spark):
    rows = [(i, "the and of that with " * 3, "en", 1, "x") for i in range(60)] + [(100 + i, "der und die das ein " * 3, "de", 1, "x") for i in range(60)]
    rows += [(None, "ohne", "xx", 1, "x"), (301, None, "en", 1, "x"), (302, "", None, 1, "x"), (303, "12 34 ... !", "de", 1, "x"), (304, "é", None, 1, "x")]
    rows += [(5, "the and of that with", "en", 1, "x"), (5, "the and of that with", "en", 1, "x"), (305, "that with " * 300_000, None, 1, "x")]
    docs = spark.createDataFrame(rows, KIND)
    model = language.train(docs, per_lang=30, each=1, steps=60)
    assert model.langs == ["de", "en"]  # a row without id teaches nothing
    found = language.predict(docs, model).collect()
    assert len(found) == len(rows) and {r.lang_pred for r in found} == {"de", "en", "und"}
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert by[301] == by[302] == by[303] == [("und", 0.0)] and by[304][0][0] != "und" and by[305][0][0] == "en"
    assert by[5][1] == by[5][2] and by[None][0][0] in ("de", "en") and by[150][0][0] == "de"
    none = language.train(docs.limit(0))
    assert none.langs == [] and language.predict(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    one = language.train(docs.filter("lang = 'en' and doc_id < 10"))
    assert {r.lang_pred for r in language.predict(docs, one).collect()} == {"en", "und"}
