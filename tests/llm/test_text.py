"""Token, licence, url, personal-data and quality operators against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import chunks, licenses, packing, pii, quality, tokens, urls

WORDS = ["the", "and", " of", "naïve", "Été", "don't", "1234", "word", "\n", "\n\n", "  ", "\t", "日本", "<|endoftext|>", "x.y", "🙂", "ſ", "\x1c"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    own = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    shared = " ".join(rng.choice(["alpha", "beta", "gamma.\nNew"]) for _ in range(3000))
    return [None, "", " ", "\n", "a", shared, shared + " tail", "head " + shared, "a" * 30000, "日" * 5000, *own, *own[:20]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (5, texts[5], "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.file_path("byte_bpe_50k.json"))


def test_chunked_bpe(spark, docs, texts, library):
    want = sorted(
        (
            len(e.ids), hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest(),
        )
        for e in library.encode_batch([t or "" for t in [*texts, "no id", texts[5]]], add_special_tokens=False)
    )
    for options in ({}, {"mean": 64}, {"mean": 64, "chunk_bytes": 20_000, "group_bytes": 100_000}):
        out = chunks.digests(chunks.encode(docs, decoded=True, **options))
        assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == want
    for options in ({}, {"part_bytes": 3_000, "mean": 64, "chunk_bytes": 20_000}):
        out = chunks.encoded_digests(docs, **options)
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        rows = out.collect()
        assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    out = chunks.digests(chunks.encode(docs, decoded=True, part_bytes=3_000))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == want
    out = chunks.digests(chunks.decode(chunks.encode(docs, part_bytes=20_000)))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == want
    assert chunks.encoded_digests(docs.limit(0)).collect() == []
    out = chunks.digests(chunks.decode(chunks.encode(docs)))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == want
    assert chunks.encode(docs.limit(0), decoded=True).collect() == []
    assert chunks.decode(docs.limit(1).selectExpr("doc_id", "CAST(null AS array<int>) AS ids")).first().text is None


def test_chunks_are_shared(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*[texts[5]] * 3, texts[6]])], "doc_id bigint, text string")
    found = chunks.reuse(docs, 256).first()
    assert found.chunks > 3 * found.distinct_chunks and found.bytes > 3 * found.distinct_bytes


def test_joins_are_repeated_until_they_agree(texts, library):
    """Chunk ids that do not hold near the joins: encoding goes on outwards until they do."""
    enc = tokens.encoder()
    rng = random.Random(1)
    for _ in range(300):
        raw = " ".join(rng.choice(["alpha", "beta", "don't", "x1y2", "Été", "日本"]) for _ in range(rng.randint(1, 60))).encode()
        ends = sorted({len(raw), *(k for k in (rng.randrange(1, len(raw)) for _ in range(3)) if raw[k] & 0xC0 != 0x80)})
        parts = [raw[a:b].decode() for a, b in zip([0, *ends], ends)]  # noqa: B905
        ids = [np.frombuffer(x, "<u4") for x in enc.encode_many(parts)]
        assert chunks.Joiner(enc).join([list(range(len(parts)))], ids, [p.encode() for p in parts])[0].tolist() == library.encode(raw.decode(), add_special_tokens=False).ids
    text = "one two three four five six seven eight"
    left, right = enc.encode_many([text[:20]])[0], enc.encode_many([text[20:]])[0]
    spoilt = np.concatenate([np.frombuffer(left, "<u4")[:1], *(np.frombuffer(enc.whole(c), "<u4") for c in text[3:20])])  # letter by letter
    joiner = chunks.Joiner(enc)
    assert joiner.join([[0, 1]], [spoilt, np.frombuffer(right, "<u4")], [text[:20].encode(), text[20:].encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert joiner.repeated > 0


def test_packing(spark, docs, texts, library):
    out = packing.pack_documents(docs, 256).collect()
    pieces = {}
    for doc, text in [*enumerate(texts), (None, "no id"), (5, texts[5])]:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        n = (len(ids) - 1) % 256 + 1
        at = [0, *range(n, len(ids), 256), len(ids)]
        for k, (a, b) in enumerate(zip(at, at[1:])):  # noqa: B905
            key = (doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
            pieces[key] = pieces.get(key, 0) + 1
    got = {}
    for r in out:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == pieces
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 256
    free = []  # best-fit decreasing, document by document
    for length in sorted((r.length for r in out), reverse=True):
        fit = min((i for i, x in enumerate(free) if x >= length), key=lambda i: free[i], default=None)
        free.append(256 - length) if fit is None else free.__setitem__(fit, free[fit] - length)
    assert len(bins) <= len(free)


def test_packing_nothing_and_bad_lengths(spark, docs):
    assert packing.pack_documents(docs.limit(0)).collect() == []
    rows = [(i, 100 if i % 3 else 256 if i % 2 else 57, i % 5) for i in range(3000)]
    hot = packing.best_fit(spark.createDataFrame(rows, "doc_id bigint, length bigint, _slot int"), ["doc_id"], 256, slot_rows=70).collect()
    assert sorted(tuple(r)[:3] for r in hot) == rows
    used = {}
    for r in sorted(hot, key=lambda r: r.offset):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 256 and len(used) == 500 + 1000 + 125
    whole = packing.best_fit(spark.createDataFrame([(1, 256), (2, 256)], "doc_id bigint, length bigint"), ["doc_id"], 256).collect()
    assert len({r.sequence_id for r in whole}) == 2 and {r.offset for r in whole} == {0}
    bad = spark.createDataFrame([(1, 300)], "doc_id bigint, length bigint")
    with pytest.raises(ValueError):
        packing.best_fit(bad, ["doc_id"], 256)


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_licenses(spark):
    notice = licenses.TEMPLATES["mit/notice"]
    header = licenses.TEMPLATES["apache-2.0/header"]
    half = header.split(". ")
    rows = [
        (1, f"Some prose.\n{notice.upper()}\nmore prose"), (2, "\n".join([half[0] + ".", half[1]])), (3, "nothing here at all"), (4, None), (5, ""),
        (6, "Released under the MIT"), (None, notice), (7, notice + " " + "word " * 50000), (8, notice), (8, notice),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, license string")
    hits = licenses.scan(docs)
    got = sorted((r.doc_id or 0, r.unit, r.license, round(r.dice, 6)) for r in hits.collect())
    want = []
    sets = {k: licenses.bigrams(v.encode()) for k, v in licenses.TEMPLATES.items()}
    for doc, text in rows:
        lines = (text or "").split("\n")
        found = [("line", x) for x in lines] + ([("paragraph", text)] if len(lines) > 1 else [])
        for unit, body in found:
            best = max(((dice(licenses.bigrams(body.encode()), s), [-ord(c) for c in k], k) for k, s in sets.items()), default=None)
            if best and best[0] >= 0.8:
                want.append((doc or 0, unit, best[2], round(best[0], 6)))
    assert got == sorted(want) and any(u == "paragraph" for _, u, _, _ in got)
    every = sorted(((r.doc_id or 0, r.n_matches, r.best_template) for r in licenses.per_document(docs).collect()), key=str)
    want = [(1, 1, "mit/notice"), (2, 1, "apache-2.0/header"), (3, 0, None), (4, 0, None), (5, 0, None), (6, 1, "mit/notice"), (0, 1, "mit/notice"), (7, 1, "mit/notice"), (8, 1, "mit/notice"), (8, 1, "mit/notice")]
    assert every == sorted(want, key=str)
    same = spark.createDataFrame([(8, notice), (8, "plain"), (None, notice), (None, "plain")], "doc_id bigint, text string")
    for anywhere in (False, True):
        assert sorted((r.n_matches, r.licenses) for r in licenses.per_document(same, anywhere).collect()) == [(0, ""), (0, ""), (1, "mit"), (1, "mit")]
    full = "\n".join(licenses.TEMPLATES["mit/text"].replace(". ", ".\n").split("\n"))
    inside = spark.createDataFrame([(1, full), (2, "It was a long day. " + full + " And then we went home."), (3, licenses.TEMPLATES["bsd-3-clause/text"])], "doc_id bigint, text string")
    assert {r.doc_id: (r.best_template, r.dice) for r in licenses.per_document(inside).collect() if r.doc_id != 2} == {1: ("mit/text", 1.0), 3: ("bsd-3-clause/text", 1.0)}
    assert [r.best_template for r in licenses.per_document(inside, True).orderBy("doc_id").collect()] == ["mit/text", "mit/text", "bsd-3-clause/text"]
    assert licenses.scan(docs.limit(0)).collect() == [] and licenses.per_document(docs.limit(0)).collect() == []


def matches(glob, text):
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob), text, re.S) is not None


def test_automaton():
    rng = random.Random(2)
    globs = ["".join(rng.choice("ab*.") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    texts = ["".join(rng.choice("ab.") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    got = urls.Automaton(globs).match([t.encode() for t in texts])
    assert got.tolist() == [[matches(g, t) for g in globs] for t in texts]
    assert urls.Automaton(["?*.com/*"]).match([b".a.com/x", b".org/a.com/x"]).ravel().tolist() == [True, False]
    assert urls.Automaton([]).match([b"x"]).shape == (1, 0)


def test_urls(spark):
    rows = [
        ("http://Example.COM/en/1?x#y", "example.com", "/en/1", "example.com/en/", "block"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://a.www.example.com/en/x", "a.www.example.com", "/en/x", "www.example.com/en/", "allow"), ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://a.net/es/q", "a.net", "/es/q", "net/es/", "block"), ("http://a.net/de/", "a.net", "/de/", None, "allow"), ("http://x.org/x.com/", "x.org", "/x.com/", None, "allow"),
        ("http://spam-farm.example.org/en/", "spam-farm.example.org", "/en/", None, "block"), ("example.com/en/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("http://com?q=/", "com", "", None, "allow"), ("http://com/", "com", "/", "com/", "allow"), ("a://b://c.com/x", "b:", "//c.com/x", None, "allow"),
        ("http://x.org/" + "y" * 50000, "x.org", "/" + "y" * 50000, None, "allow"), ("http://é.org\n/a\nb", "é.org\n", "/a\nb", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, r[0], "h") for i, r in enumerate(rows)] + [(None, None, "h")], "page_id bigint, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge(pages).collect()}
    assert [got[i] for i in range(len(rows))] == [r[1:] for r in rows]
    assert got[None] == ("", "", None, "allow") and urls.judge(pages.limit(0)).collect() == []


def plain_spans(text):
    def luhn(digits):
        return sum((v if k % 2 == 0 else sum(divmod(2 * v, 10))) for k, v in enumerate(map(int, digits[::-1]))) % 10 == 0

    def digits(s):
        return re.sub("[^0-9]", "", s)

    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(found)


def test_base_spans():
    rng = random.Random(6)
    letters = list("0123456789") * 2 + list("  ..--++@@()abZ%_\n\té٣")
    for _ in range(20000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("1" * 200000 + "a" * 200000 + "@" * 1000) == []


def test_pii(spark):
    card = "4111111111111111"
    rng = random.Random(1)
    many = [(100 + i, f"note {i} mail user{i}@mail.example.com and call +1 (415) 555-{1000 + i} from 10.0.0.{i} ref {rng.randint(100, 99999)}") for i in range(60)]
    rows = [
        (1, f"pay {card} now. Later the holder wrote {card[-8:]} again"), (2, "call +1 (415) 555-0199 or 4155550199 today"), (3, None), (4, ""), (5, "plain words only"),
        (6, "ask hsr.29@mail5.example.com, that is hsr.29 to us"), (7, "5927243074273351 and 5927243074273351"), (None, "x@y.zz"), (5, "plain words only"), *many,
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, spans int")
    model = pii.train(docs)
    got = pii.find(docs, model).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        base = pii._line(plain_spans(text[r.doc_id] or ""))
        assert r.base == base and set(filter(None, base.split(","))) <= set(filter(None, r.spans.split(",")))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [base.count(k + ":") for k in pii.KINDS]
    spans = {r.doc_id: r.spans for r in got}
    assert "phone:26:36" in spans[2] and spans[5] == "" and spans[7] == ""
    assert spans[1] == "card:4:20,card:49:57" and spans[6] == "email:4:28,email:38:44"
    again = spark.createDataFrame([(1, r[1]) for r in rows] * 3, "doc_id bigint, text string")  # one id in every row, more rows than the sample
    first = pii.train(again, sample=40)
    assert np.array_equal(first.weights, pii.train(again.repartition(5), sample=40).weights)
    many_nodes = spark.createDataFrame([(1, "12 " * 50_000 + rows[0][1])], "doc_id bigint, text string")
    assert pii.train(many_nodes).ready
    clean = {r.doc_id: r for r in pii.redact(docs, model).collect()}
    assert clean[2].text == "call [PHONE] or [PHONE] today" and clean[3].text is None and clean[2].spans == 1
    none = pii.train(docs.limit(0))
    assert not none.ready and pii.find(docs.limit(0), none).collect() == []


def test_propagation_agrees_with_enumeration():
    """On a graph without loops the messages give exact marginals."""
    import itertools

    rng = np.random.default_rng(0)
    n = len(pii.LABELS)
    model = pii.Model(rng.normal(size=(pii.WIDTH + 1, n)), rng.normal(size=(n, n)), np.eye(n))
    model.skip = model.skip + model.skip.T
    model.weak = rng.normal(size=(n, n))
    model.weak = model.weak + model.weak.T
    g = pii.Graph([(0, 1)] * 4, [[1], [2, 5], [9], [64]], [0, 0, 2, 0], [(0, 1)], [(1, 2)], weak=[(2, 3)])
    local = pii._design(g.features) @ model.weights
    want = np.zeros((4, n))
    for y in itertools.product(range(n), repeat=4):
        if y[2] == 2:
            p = np.exp(local[0, y[0]] + local[1, y[1]] + local[3, y[3]] + model.chain[y[0], y[1]] + model.skip[y[1], y[2]] + model.weak[y[2], y[3]])
            for i in range(4):
                want[i, y[i]] += p
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(pii.propagate(g, model), want, atol=1e-4)


def test_quality_chain_agrees_with_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    model = quality.Model(np.zeros(2), np.ones(2), rng.normal(size=2), 0.3, rng.normal(size=(2, 2)))
    x, bounds = rng.normal(size=(7, 2)), np.array([0, 4, 5, 7])
    got = model.marginals(x, bounds)
    odds = model.odds(x)
    for a, b in zip(bounds, bounds[1:]):  # noqa: B905
        weight = np.zeros((b - a, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            p = np.exp(sum(odds[a + i] * v for i, v in enumerate(y)) + sum(model.move[u, v] for u, v in zip(y, y[1:])))  # noqa: B905
            for i, v in enumerate(y):
                weight[i, v] += p
        assert np.allclose(got[a:b], weight[:, 1] / weight.sum(axis=1))


def test_quality(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.train(docs, labels)
    out = quality.score(docs, model)
    assert out.count() == docs.count() and out.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    held = out.join(labels, "doc_id").filter("held_out")
    assert held.filter("predicted = quality").count() >= 0.95 * held.count()
    ids = {r.doc_id: r.held_out for r in out.collect()}
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in ids.items())
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, "\n" * 3000, 1), (2, "word " * 100000, 1)], "doc_id bigint, text string, score int")
    rows = quality.score(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and not [r for r in rows if r.doc_id is None][0].held_out
    blank = quality.train(docs, labels.filter("false"))
    assert {r.score for r in quality.score(docs.limit(20), blank).collect()} == {0.5}
    assert quality.with_score(docs.limit(3).withColumn("x", F.lit(1)), model).columns[-2:] == ["x", "score"]
    clash = docs.limit(3).withColumn("_score", F.lit(1)).withColumn("__score", F.lit(2))
    assert quality.keep(clash, model, 0.0).columns == clash.columns and quality.keep(clash, model, 0.0).count() == 3
    # Long documents give a stretch of lines, and rows that share an id count up to the bound.
    breaks = spark.createDataFrame([(1, "\n" * 200_000)] * 40 + [(i, "some words here.\n" * 9) for i in range(2, 60)], "doc_id bigint, text string")
    every = spark.createDataFrame([(i, int(i > 1)) for i in range(1, 60)], "doc_id bigint, quality int")
    small = quality.train(breaks, every, rows=50, lines=30)
    assert np.array_equal(small.weights, quality.train(breaks.repartition(5), every, rows=50, lines=30).weights)
    assert np.isfinite(quality.train(breaks.limit(0), every).weights).all()
