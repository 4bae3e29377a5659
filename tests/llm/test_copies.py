"""Dedup, joins and search against brute force, with nulls, ties, repeats, empty tables and hot groups."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import exact, jaccard, repeats, suffix, topk
from waymark.llm.components import components


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact(spark):
    rows = [(i, t) for i, t in enumerate(["Abc", "aBC", "É", "é", None, "", "x" * 50000, "X" * 50000, "x" * 49999 + "y", "one"])]
    rows += [(20 + i, "hot copy") for i in range(200)] + [(5, ""), (None, "abc"), (None, None), (30, "hot copy")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, keep_id int").repartition(3)
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        seen = False
        for i in sorted(ids, key=lambda i: (i is not None, i)):
            kept = i == keep and not seen
            seen |= kept
            want.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in exact.groups(docs, all_hashes=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert [r[:4] for r in sorted((tuple(r) for r in exact.groups(docs, prefix=2).drop("text_sha256").select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)] == sorted((w[:4] for w in want), key=str)
    odd = docs.withColumnsRenamed({"keep_id": "_sha"}).withColumn("text_sha256", F.lit("x")).withColumn("kept", F.lit(3))
    out = exact.drop_copies(odd)
    assert out.columns == odd.columns and sorted(lower(r.text) for r in out.collect()) == sorted(groups)
    ones = odd.filter("doc_id IS NOT NULL AND doc_id NOT IN (5, 30)")  # no id twice: no text is hashed again
    assert sorted(r.doc_id for r in exact.drop_copies(ones).collect()) == sorted({max(i for i in ids if i not in (None, 5, 30)) for ids in groups.values() if set(ids) - {None, 5, 30}})
    assert exact.drop_copies(odd.limit(0)).collect() == []
    out = exact.drop_copies(docs)
    assert out.columns == docs.columns and sorted(lower(r.text) for r in out.collect()) == sorted(groups)
    assert exact.groups(docs.limit(0)).collect() == []


def brute_links(rows, percent, width):
    def shingles(text):
        words = [w for w in lower(text).replace("\t", " ").replace("\n", " ").split(" ") if w]
        return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.fixture(scope="module")
def near():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(200)]
    rows, i = [], 0
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 9, 11, 12, 14, 20, 60, 200, 600]))]
        for _ in range(rng.choice([1, 2, 5, 12, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((rng.randrange(10**6) * 1000 + i, (" ".join(words)).upper() if i % 5 == 0 else "\t".join(words)))
            i += 1
    return [*rows, (7, None), (8, ""), (9, " \n")]


@pytest.mark.parametrize("percent, width, block", [(90, 3, 300_000), (90, 3, 800), (80, 5, 800)])
def test_jaccard(spark, near, percent, width, block):
    """A small block size sends large families through the path for hot groups."""
    docs = spark.createDataFrame([(*r, 1) for r in near], "doc_id bigint, text string, node int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs, percent, width, block).collect()}
    assert got == brute_links(near, percent, width)


@pytest.mark.parametrize("passages, block, rounds", [(True, 300, 2), (False, 1500, 1)])
def test_jaccard_unlinked_family(spark, monkeypatch, passages, block, rounds):
    """Texts hang together by rare shingles, but few are linked: texts of common passages, whose keys are crowded and so split,
    or windows of a long text, which hang together as a chain."""
    rng = random.Random(1)
    pool = [" ".join(f"p{k}w{i}" for i in range(20)) for k in range(60)]
    rows = []
    for i in range(300):
        text = " ".join(rng.sample(pool, 6)) if passages else " ".join(f"w{k}" for k in range(12 * i, 12 * i + 110))
        rows.append((2 * i + 10, text))
        if i % 10 == 0 if passages else i > 290:
            rows.append((2 * i + 11, text.replace(" ", f" odd{i} ", 1)))
    calls, keyed = [], jaccard._link_keyed

    def watch(*args, last, **options):
        out = keyed(*args, last=last, **options)
        calls.append(last)
        return out

    monkeypatch.setattr(jaccard, "_link_keyed", watch)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs, 90, 3, block).collect()}
    assert got == brute_links(rows, 90, 3)
    assert len(calls) == rounds
    assert len({c for _, c in got.values()}) >= 290


def test_jaccard_unlinked_family_with_repeated_ids(spark):
    """An id with several texts in a crowded family: each text links by its own shingles, also where another lacks the key."""
    rng = random.Random(1)
    pool = [" ".join(f"p{k}w{i}" for i in range(20)) for k in range(60)]
    rows = []
    for i in range(300):
        text = " ".join(rng.sample(pool, 6))
        rows.append((2 * i + 10, text))
        if i % 3 == 0:
            rows.append((2 * i + 10, " ".join(rng.sample(pool, 6))))
        if i % 10 == 0:
            rows.append((2 * i + 11, rows[-1][1].replace(" ", f" odd{i} ", 1)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs, 90, 3, 300).collect())
    # Ids of one document's texts are told apart, and then linked by force: a link from each to the next.
    whole = brute_links([(k, t) for k, (_, t) in enumerate(rows)], 90, 3)
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (d, _) in enumerate(rows):
        x, y = find(d), find(rows[whole[k][1]][0])
        root[max(x, y)] = min(x, y)
    assert got == sorted((d, whole[k][0], find(d)) for k, (d, _) in enumerate(rows))
    assert len({c for *_, c in got}) < len({d for d, _ in rows})


def test_jaccard_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(3, text), (3, text), (5, text + " more"), (None, text), (None, None), (None, "alone words here"), (9, "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.classes(docs).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (5, 3), (None, 3), (None, None), (None, None), (9, 9)], key=str)
    assert jaccard.classes(docs.limit(0)).collect() == []
    left = jaccard.one_of_each(docs.filter("doc_id IS NOT NULL"))
    assert sorted(r.doc_id for r in left.collect()) == [3, 3, 9]


def test_tree_finds_all_that_overlap_enough():
    rng = np.random.default_rng(0)
    points = rng.poisson(3, (500, jaccard.AXES)).astype(np.int32)
    points[250:] = np.maximum(points[:250] + rng.integers(-1, 2, (250, jaccard.AXES)) * (rng.random((250, jaccard.AXES)) < 0.05), 0)
    tree, alike = jaccard.RTree(points), jaccard.Similarity(90)
    total = points.sum(axis=1)
    for i in range(0, 500, 7):
        want = np.flatnonzero(np.minimum(points, points[i]).sum(axis=1) >= alike.need(total + total[i]))
        assert set(want) <= set(tree.search(points[i], int(total[i]), alike.need).tolist())


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in {x for a, b in edges if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_topk(spark):
    rng = random.Random(8)
    vectors = [[rng.choice([0.0, 0.5, -0.25, 1.0, 0.001, -3.7]) for _ in range(6)] for _ in range(700)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(700, None), (750, [float("nan")] * 6), (800, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (850, [float("inf")] + [0.0] * 5), (900, [1e12] + [0.0] * 5), (901, [-1e12] + [0.0] * 5), (None, vectors[0]), (950, [2.0, 1.0]), (1000, [])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, score int").repartition(5)
    import math

    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = [math.floor(256 * float(np.float32(x))) for x in v]
    want = set()
    for q, v in good.items():
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good.items() if i != q)[:5]
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    for options in ({}, {"shard_rows": 40, "tile_rows": 4, "fan_in": 3}):
        got = topk.search(table, **options).collect()
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert topk.search(table.limit(0)).collect() == []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a shard comes in several batches
    try:
        assert {tuple(r) for r in topk.search(table, shard_rows=100, tile_rows=5).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    few = topk.search(table.filter("vec_id IN (0, 3)")).collect()
    assert len(few) == 1
    big = spark.createDataFrame([(0, [1e8, 1.0]), (1, [1e6, 0.0])], "vec_id bigint, embedding array<double>")
    assert topk.search(big).first().score == 25600000000 * 256000000
    huge = [(0, [1e12, 1.0]), (1, [-1e12, 3.0]), (2, [3.0, 0.0]), (3, [2.0, 5.0])]
    low = topk.search(spark.createDataFrame(huge, "vec_id bigint, embedding array<double>"), k=2)  # the lowest does not fit, but is no result
    assert [(r.vec_id, r.score) for r in low.orderBy("rank").collect()] == [(2, int(256e12) * 768), (3, int(256e12) * 512 + 256 * 1280)]
    with pytest.raises(Exception, match="64 bits"):
        topk.search(spark.createDataFrame([(0, [4e9 * 256]), (1, [4e9 * 256])], "vec_id bigint, embedding array<double>")).collect()
    same = spark.createDataFrame([(50, [1.0]), (50, [1.0]), (50, [2.0]), (2, [3.0]), (2, [3.0])], "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score // 65536) for r in topk.search(same, k=3, shard_rows=2).collect())
    one, two = [(50, 1, 2, 3), (50, 2, 2, 3), (50, 3, 50, 2)], [(50, 1, 2, 6), (50, 2, 2, 6), (50, 3, 50, 2)]
    assert got == sorted(one + one + two)


def test_topk_grid(spark):
    rows = spark.range(1000).selectExpr("id AS vec_id", "array(1.0D) AS v").unionAll(spark.range(500).selectExpr("50L AS vec_id", "array(2.0D) AS v"))
    shards, groups, tiles = topk.grid(1500, 520, 50, 10, 100)
    assert (shards, groups, tiles) == (150, 9, 6)
    cells = topk.dealt(rows, 50, shards, groups, tiles)
    assert cells.count() == 1500 * tiles + 520 * groups
    assert cells.filter("number IS NOT NULL").groupBy("cell").count().agg({"count": "max"}).first()[0] < 150  # a hot id fills no tile
    assert topk.grid(10**9, 2 * 10**7) == (61036, 954, 306) and topk.grid(100, 2) == (1, 1, 1) and topk.grid(0, 0) == (1, 1, 1)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for t in range(150):
        s = rng.integers(0, int(rng.choice([1, 2, 3, 4, 256, 5000])), int(rng.integers(1, 120)))
        s = np.tile(s, 4) if t % 3 == 0 else s
        want = sorted(range(len(s)), key=lambda i: list(s[i:]))
        assert suffix.suffix_array(s).tolist() == suffix.suffix_array(s, 0).tolist() == suffix.suffix_array(s, 10**9).tolist() == want
        if s.max() < 256:
            raw = s.astype(np.uint8).tobytes()
            common = suffix.common_prefixes(raw, np.array(want), 20)
            for a, b in zip(want, want[1:]):  # noqa: B905
                k = 0
                while max(a, b) + k < len(raw) and k < 20 and raw[a + k] == raw[b + k]:
                    k += 1
                assert common[b] == k


def brute_removal(rows, length):
    docs = [(2**63 - 1 if i is None else i, (t or "").encode(), i) for i, t in rows]
    first = {}
    for d, raw, _ in docs:
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, raw, i in docs:
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < d:
                gone[k : k + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [repeats.CROWD, 1])
def test_repeats(spark, crowd):
    """A crowd of 1 sends every anchor with two stretches through the path for hot ones."""
    rng = random.Random(3)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    passages = [some(rng.choice([48, 50, 51, 60, 120, 400]), "abé ") for _ in range(25)]
    rows = []
    for i in range(250):
        text = ""
        for _ in range(rng.randint(0, 5)):
            c = rng.random()
            text += some(rng.randint(1, 80), "abcdefgh ") if c < 0.4 else rng.choice(passages)[rng.choice([0, 0, 3]) :] if c < 0.9 else "a" * rng.randint(1, 150)
        rows.append((rng.choice([i * 7 % 251, None]) if i % 37 == 0 else i * 7 % 251, text))
    rows += [(500 + k, rows[k][1]) for k in range(20)] + [(900, None), (901, ""), (902, "x" * 30), (903, "x" * 30), (7, "\0" * 200), (904, "\0" * 80 + "q"), rows[3]]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, g int").repartition(3)
    got = sorted((tuple(r) for r in repeats.remove(docs, crowd=crowd).drop("kept").collect()), key=str)
    assert got == brute_removal(rows, 50)
    assert repeats.remove(docs.limit(0)).collect() == []


def test_repeats_long_and_hot(spark):
    """A text of over a megabyte that shares passages, one id in many rows, and null ids."""
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(1_300_000))
    rows = [(50, long), (60, "x" + long[1_048_500:1_048_700] + "y"), (40, "q" + long[200_000:200_090] + "z"), (61, long[-300:])]
    rows += [(7, f"row {i} " + long[500:700] + f" end {i}") for i in range(60)] + [(None, f"null {i} " + long[800:1000]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted((tuple(r) for r in repeats.remove(docs).drop("kept").collect()), key=str) == brute_removal(rows, 50)
