"""Quality of long texts in stretches against all lines at once, and columns of any name and type."""

import hashlib
import random
import time
import tracemalloc

import numpy as np
import pytest

from waymark.llm import chunks, exact, packing, pii, quality, tokens


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))


def whole(model, text):
    features, bounds = quality.line_features([text])
    return float(model.calibrate(quality._weighted(model.marginals(features, bounds), features, bounds))[0])


@pytest.mark.parametrize("lines", [1, 2, 399, 400, 401, 4001, 9000])
def test_stretches(model, monkeypatch, lines):
    monkeypatch.setattr(quality, "LONG", 400)
    rng = random.Random(lines)
    made = ["", "   ", "one two three", "buy now !!! $$$", "The and of that thé 12", "a | b | c"]
    text = "\n".join(rng.choice(made) + rng.choice(["", " x", f" {rng.random()}"]) for _ in range(lines))
    for t in (text, text + "\n", "\n" * lines):
        assert np.concatenate(list(quality.stretches(t))) == pytest.approx(quality.own_features([t])[0], abs=1e-12)
        assert model.calibrate(np.array([model.long_score(t)]))[0] == pytest.approx(whole(model, t), abs=1e-9)
        assert model.scores(["short", t, ""])[1] == pytest.approx(whole(model, t), abs=1e-9)


def test_two_million_newlines(model):
    start = time.process_time()
    tracemalloc.start()
    score = model.scores(["\n" * 2_000_000])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 <= score <= 1 and peak < 500e6 and time.process_time() - start < 60
    assert score == pytest.approx(model.scores(["\n" * 30_000])[0], abs=1e-3)


def test_columns_of_any_name(spark, model):
    rows = [(k, f"the text of {k}", (1, 2), [("x", 3)], 5) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `a.b` struct<`a b`: int, `c-d`: int>, `ba``ck` array<struct<`x y`: string, z: int>>, _score int")
    kept = quality.keep(docs, model, 0.0)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    assert exact.drop_copies(docs).columns == docs.columns
    clean = pii.redact(docs, pii.train(docs))
    assert clean.columns == docs.columns and sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))
    items = spark.createDataFrame([(k, 3 + k, (1, 2), 7) for k in range(6)], "`do``c` int, length bigint, `a.b` struct<`a b`: int, c: int>, `x y` int")
    packed = packing.best_fit(items, ["`do``c`"], 10)
    assert packed.columns == [*items.columns, "sequence_id", "offset"] and packed.count() == 6


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.file_path("byte_bpe_50k.json"))


MADE = [
    "word", "don't", "x1", "é", "ß,", "\u3002", "\u3042", "\u4e2d\u6587", "\U0001f600", "\u00a0", "\u3000", "\u2003", "\u1680", "\u2028", "\x85", "\u180e",
    "<|endoftext|>", "!?", "\t", "\r", "  ", "\n\n", "'s", "\u0e01\u0e33", "\ufeff", "\u200b", "12",
]


def test_parts_have_the_ids_of_the_text(library):
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(MADE) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 40)))
        parts = [bytes(p).decode() for p in chunks.split(text.encode(), rng.choice([1, 1, 7, 40]))]
        assert "".join(parts) == text
        ids = [i for p in parts for i in library.encode(p, add_special_tokens=False).ids]
        assert ids == library.encode(text, add_special_tokens=False).ids, (text, parts)
    assert len(list(chunks.split(b"a b c d", 1))) == 4
    assert len(list(chunks.split(b"", 1))) == len(list(chunks.split(b"\n" * 50, 1))) == len(list(chunks.split(b"x" * 50, 1))) == 1


def test_long_text_in_parts(spark, library):
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    long = " ".join(rng.choices(words, k=900_000))
    texts = [long, "short", long[:2_500_000] + "\n" * 300_000 + "é", None, "", "x" * 2_100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in chunks.encoded_digests(docs).collect()}
    assert sorted(found) == list(range(len(texts)))
    for k, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[k].n_tokens == len(ids) and found[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
