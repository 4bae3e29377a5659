"""The manifest against a plain tree with hashlib."""

import hashlib
import zlib

import pytest

from waymark.llm import merkle

KIND = "doc_id bigint, source string, lang string, n_chars bigint, text string, g int, _tie string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], row[4])))


def climb(nodes, at, arity):
    """Root of the nodes, and of the siblings on the way from nodes[at] on their places."""
    way = []
    while len(nodes) > 1:
        first = at - at % arity
        way.append((nodes[first:at], nodes[at + 1 : first + arity]))
        nodes = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        at //= arity
    return nodes[0], way


def plain(rows, arity=2):
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    for p in order:
        parts[p].sort(key=lambda x: x[:3])
    tops = [climb([x[2] for x in parts[p]], 0, arity)[0] for p in order]
    out = []
    for k, p in enumerate(order):
        leaves = [x[2] for x in parts[p]]
        for i, (*_, own, r) in enumerate(parts[p]):
            sub, low = climb(leaves, i, arity)
            root, high = climb(tops, k, arity)
            way = low + high
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            value = leaf((*r[:3], r[3] + 1, r[4])) if hit else own
            for left, right in way:
                value = h(*left, value, *right)
            out.append((r[0], own, sub, root, h(*(s for left, right in way for s in left + right)), value, value == root))
    return sorted(out, key=repr)


def got(spark, rows, **options):
    found = merkle.manifest(spark.createDataFrame(rows, KIND), merkle.tampered(), **options)
    return sorted(map(tuple, found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def docs(n, lang="en", first=0):
    return [(i, f"s{i % 3}", lang, i, f"text {i}", 1, "x") for i in range(first, first + n)]


ODD = [
    (5, None, None, None, None, 1, "x"), (7, "s", None, 3, "", 1, "x"), (None, "s", "en", 1, "no id", 1, "x"), (None, None, None, None, None, 1, "x"),
    (3, "s", "en", 1, "twice", 1, "x"), (3, "s", "en", 1, "twice", 2, "y"), (3, "s", "en", 1, "other", 1, "x"),
    (9, "é", "é", 2**62, "ü" * 30_000, 1, "x"), (14, "", "", 0, "a", 1, "x"), (21, "s", "Z", -4, "b", 1, "x"),
]


MANY = ODD + docs(45) + docs(17, "de", 100) + docs(16, "fr", 200)


@pytest.mark.parametrize(("rows", "levels"), [(docs(1), 10), (docs(2), 1), (ODD, 2), (MANY, 1), (MANY, 2), (MANY, 10)])
def test_manifest(spark, rows, levels):
    assert got(spark, rows, levels=levels) == plain(rows)


def test_wider_parents(spark):
    rows = ODD + docs(50) + docs(9, "de", 100)
    assert got(spark, rows, arity=3, levels=2) == plain(rows, 3)


def test_no_rows_and_repeated_rows(spark):
    assert got(spark, []) == []
    rows = [(3, "s", "en", 1, "twice", 1, "x")] * 40 + docs(5, "de")
    assert got(spark, rows, levels=2) == plain(rows)


def test_states(spark):
    """What a parent keeps for a slot is the state of the hash after the children to the left of it, and is enough to go on."""
    light = spark.createDataFrame([(0, 5, i, bytes([i]) * 32) for i in range(5)], "g bigint, n bigint, pos bigint, digest binary")
    tree = merkle.trees(light, 2, 10).collect()[0]
    state = merkle._words([tree.states[64 + 32 : 64 + 64]]).T.copy()  # second parent, second slot
    done = merkle.finish(merkle.absorb(state, merkle.message(merkle._words([bytes([3]) * 32]))), merkle.np.array([2]))
    assert merkle._raw(done).hex() == h((bytes([2]) * 32).hex(), (bytes([3]) * 32).hex()) == tree.digests[32 * 6 : 32 * 7].hex()
    assert (tree.m, tree.height, len(tree.states) // 64) == (5, 3, 3 + 2 + 1)
