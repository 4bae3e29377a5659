"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import spelling


def plain_words(rows, modulus=97, shortest=5, least=3):
    n = Counter()
    for doc, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def plain_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, **options):
    words = plain_words(rows, **options)
    form, out = {}, []
    for w, n in words.items():
        close = [x for x in words if plain_near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out.append((w, n, len(close)))
    found = []
    for w, n, k in out:
        root = w
        while form[root]:
            root = form[root]
        found.append((w, form[w], root, n, k, words[form[w]] if form[w] else None))
    return sorted(found)


def got(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "x", b"") for r in rows], "doc_id bigint, text string, n int, word string, node binary")
    return sorted(map(tuple, spelling.variants(docs, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def made(letters, seed, number=260):
    """Words from few letters, so that many are near, many alike in all counts, with counts that make chains."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list(letters), rng.integers(5, 8))) for _ in range(number)]
    return [(i, " ".join(rng.choice(words, 400) if i % 3 else words)) for i in range(12)]


@pytest.mark.parametrize(("letters", "most"), [("abcé", 4000), ("ab", 3), ("abcdefghijklmnopqrstuvwxyzàÀ", 5)])
def test_variants(spark, letters, most):
    rows = made(letters, 7)
    assert got(spark, rows, most=most) == plain(rows)


def test_chain(spark):
    rows = [(1, "aaaaa " * 40 + "aaaab " * 20 + "aaabb " * 10 + "aabbb " * 5 + "abbbb " * 3)]
    found = {r[0]: r for r in got(spark, rows, modulus=10**12)}
    assert found["abbbb"][1:3] == ("abbbb", "abbbb")[:0] + (None, "abbbb") and found["aabbb"][1:3] == ("aaabb", "aaaaa") and found["aaaaa"][1] is None


def test_odd_rows(spark):
    assert got(spark, []) == [] and got(spark, [(1, None), (2, ""), (3, "1 2 3")]) == []
    long = "word" * 100_000
    rows = [(None, "Hello hello HELLO hallo"), (None, "hello héllo hÉllo HÉLLO"), (5, None), (5, "hallo hallo hellö Hellö hellö"), (5, "hallo hallo"), (6, f"{long} {long}x {long} {long} {long}x {long}x")]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows * 3, most=2) == plain(rows * 3)


def test_very_long_text(spark):
    rows = [(1, "alpha beta gamma gamme " * 200_000)]
    assert got(spark, rows) == plain(rows)


words = st.text("abé", min_size=0, max_size=7)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_near(a, b):
    a, b = a.encode("latin-1"), b.encode("latin-1")
    assert spelling.near(a, b) == plain_near(a, b) == bool(spelling.near_rows(*spelling.grid([a]), *spelling.grid([b]))[0])


def test_counts_past_a_byte():
    """Counts of 255 and more are one count: searches lose nothing."""
    data = [b"a" * n for n in (253, 254, 255, 256, 257, 300)]
    vec = spelling.vectors(data)
    shard = np.zeros(len(data), int)
    found = {(i, j) for of, to, _ in spelling.Trie(shard, vec).search(shard, vec) for i, j in zip(of.tolist(), to.tolist(), strict=True)}
    assert all((i, j) in found or (j, i) in found for i in range(6) for j in range(6) if abs(len(data[i]) - len(data[j])) <= 1)
