"""Spelling variants: words one inserted, deleted or replaced letter apart, found in a trie over counts of letter groups.

A word is the vector of how many of its letters fall into each of 24 groups; the trie has a level for each group, a child for each
count. One edit adds a letter to a group, takes one from a group, or does both, so a search goes depth first through the trie and
may take at each level the child with the same count, with one more (once: the surplus) or with one less (once: the deficit).
Words at the leaves it reaches are compared letter by letter. Of two words with different vectors the one that has less at the
first level that tells them apart looks for the other: so a deficit comes only after a surplus, and each pair is met once.

The trie is cut into shards: nodes with at most `most` words, each at the depth that it needs. Words go to their shard, and as
questions to every shard within their budget; a shard is a stretch of a task's stream, its words first.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import arrow
from waymark.session import cut, small

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RUN = re.compile("[a-zÀ-ÿ]+")
GROUPS = 24
#: Letters take groups in this order, the 25th and 26th those of the first two; letters past z by their code point.
_ORDER = b"etaoinshrdlcumwfgypbvkjxqz"
_GROUP = np.arange(256) % GROUPS
_GROUP[list(_ORDER)] = np.arange(26) % GROUPS
#: Depths at which the trie may be cut into shards.
DEPTHS = (1, 2, 3, 4, 5, 6, 8, 10, 13, 17, GROUPS)
_HELD = 400_000  # words counted in a task before they are passed on
_WIDE = 32  # letters compared side by side; longer words are compared one by one
_FRONT = 200_000  # places in the trie that a search follows side by side


def runs(text: str) -> Counter:
    """How often each run of letters stands in the text, A-Z lower-cased."""
    low = text.encode().translate(_LOWER).decode()
    return Counter(_RUN.findall(low) if len(low) < 4_000_000 else (m.group() for m in _RUN.finditer(low)))


def worn(doc: object, found: Counter, modulus: int) -> Iterator[tuple[str, int]]:
    """Runs of a document, of some a letter less: where the modulus divides the crc32 of `<doc>:<run>`."""
    begin = zlib.crc32(f"{'' if doc is None else doc}:".encode())
    for run, n in found.items():
        h = zlib.crc32(run.encode(), begin)
        if h % modulus == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        yield run, n


def vectors(words: list[bytes]) -> np.ndarray:
    """Counts of letter groups, 255 for more; words are in Latin-1, where every letter is a byte."""
    of = np.repeat(np.arange(len(words)), [len(w) for w in words])
    group = _GROUP[np.frombuffer(b"".join(words), np.uint8)]
    return np.minimum(np.bincount(of * GROUPS + group, minlength=len(words) * GROUPS), 255).astype(np.uint8).reshape(-1, GROUPS)


def vocabulary(docs: DataFrame, modulus: int = 97, shortest: int = 5, least: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, vec: words of at least `shortest` letters that occur at least `least` times. Null texts have none; a null id
    counts as an empty one; rows with a repeated id are documents of their own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in arrow.slices(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), arrow.texts(part, "text"), strict=True):
                    for word, n in worn(doc, runs(text), modulus):
                        if len(word) >= shortest:
                            held[word] = held.get(word, 0) + n
                    if len(held) > _HELD:
                        yield out()
                        held = {}
        yield out()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = vectors([w.encode("latin-1") for w in batch.column("word").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v.tobytes() for v in vec], pa.binary())], ["word", "n", "vec"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = read.mapInArrow(arrow.tidy(count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least).mapInArrow(spread, "word string, n bigint, vec binary")


def reach(vec: np.ndarray, node: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes at `depth` below the given nodes that words with these vectors can reach with what is left of their budget: which
    word, and the node."""
    begin = node.shape[1]
    moved = node.astype(np.int16) - vec[:, :begin]
    surplus, deficit = (moved > 0).any(axis=1), (moved < 0).any(axis=1)
    straight = np.hstack([node, vec[:, begin:depth]])
    levels = range(begin, depth)
    more, less = {j: ~surplus & (vec[:, j] < 255) for j in levels}, {j: vec[:, j] > 0 for j in levels}
    moves = [(), *((j, None) for j in levels), *((None, j) for j in levels), *combinations(levels, 2)]
    for up, down in (m or (None, None) for m in moves):
        allowed = np.ones(len(vec), bool)
        if up is not None:
            allowed &= more[up]
        if down is not None:
            allowed &= less[down] & ~deficit & (surplus | (up is not None))
        which = np.flatnonzero(allowed)
        to = straight[which]
        if up is not None:
            to[:, up] += np.uint8(1)
        if down is not None:
            to[:, down] -= np.uint8(1)
        yield which, to


class Trie:
    """Words of several shards by shard and vector: for each level the sorted keys (parent, count) of its nodes."""

    def __init__(self, shard: np.ndarray, vec: np.ndarray):
        self.order = np.lexsort([*vec.T[::-1], shard])
        rows, shards = vec[self.order], shard[self.order]
        new = np.r_[True, shards[1:] != shards[:-1]]
        self.shards = shards[new]
        self.keys = []
        for level in range(GROUPS):
            parent = np.cumsum(new) - 1
            new = new | np.r_[True, rows[1:, level] != rows[:-1, level]]
            self.keys.append((parent[new] << 8) | rows[new, level])
        self.first = np.r_[np.flatnonzero(new), len(rows)]

    def search(self, shard: np.ndarray, vec: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs (question, word) whose vectors are apart by a surplus and then a deficit of one at most, and whether they are apart."""
        at = np.searchsorted(self.shards, shard)
        none = np.zeros(len(shard), bool)
        stack = [(0, np.arange(len(shard)), at, none, none)]
        while stack:
            level, of, node, surplus, deficit = stack.pop()
            if len(of) > _FRONT:
                half = len(of) // 2
                stack += [(level, *(x[half:] for x in (of, node, surplus, deficit))), (level, *(x[:half] for x in (of, node, surplus, deficit)))]
                continue
            if level == GROUPS:
                size = self.first[node + 1] - self.first[node]
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                yield np.repeat(of, size), self.order[np.repeat(self.first[node], size) + place], np.repeat(surplus, size)
                continue
            keys, count, onward = self.keys[level], vec[of, level].astype(np.int64), []
            for by, allowed in ((0, None), (1, ~surplus & (count < 255)), (-1, surplus & ~deficit & (count > 0))):
                mine = np.arange(len(of)) if allowed is None else np.flatnonzero(allowed)
                key = (node[mine] << 8) | (count[mine] + by)
                child = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                mine, child = mine[keys[child] == key], child[keys[child] == key]
                onward.append((of[mine], child, surplus[mine] | (by > 0), deficit[mine] | (by < 0)))
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*onward, strict=True))))


def near(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced letter makes b of a."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b) + 1:
        return False
    apart = int.from_bytes(a[: len(b)]) ^ int.from_bytes(b)
    same = len(b) - (apart.bit_length() + 7) // 8  # letters that both begin with
    return a[same + 1 :] == b[same + (len(a) == len(b)) :] and a != b


def grid(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first _WIDE letters of each word, padded with zeros, and the words' lengths."""
    out = np.array([w[:_WIDE] for w in words], f"S{_WIDE}").view(np.uint8).reshape(-1, _WIDE)
    return out, np.array([len(w) for w in words])


def near_rows(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """As near, for rows of words of at most _WIDE letters, side by side."""
    out = np.zeros(len(a), bool)
    even = np.flatnonzero(size_a == size_b)
    out[even] = (a[even] != b[even]).sum(axis=1) == 1
    for x, y, size in ((a, b, size_a - size_b), (b, a, size_b - size_a)):
        rows = np.flatnonzero(size == 1)  # x has a letter more
        long, short = x[rows], y[rows]
        first = (long != short).argmax(axis=1)  # where the letter is, or later in a run of that letter
        late = (long[:, 1:] != short[:, :-1]) & (np.arange(_WIDE - 1) >= first[:, None])
        out[rows] = ~late.any(axis=1)
    return out


def _ask(asks: DataFrame, depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = batch.column("word"), batch.column("n")
            vec = vectors([w.encode("latin-1") for w in word.to_pylist()])
            node = np.frombuffer(b"".join(batch.column("node").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            for which, to in reach(vec, node, depth):
                if len(which):
                    nodes = to.tobytes()
                    cells = [nodes[i : i + depth] for i in range(0, len(nodes), depth)]
                    take = pa.array(which)
                    yield pa.RecordBatch.from_arrays([word.take(take), n.take(take), pa.array(cells, pa.binary())], ["word", "n", "node"])

    return asks.mapInArrow(run, "word string, n bigint, node binary")


def shards(words: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Words and questions (node, part, word, n), each at the nodes of the trie's cut.

    A node with more than `most` words is cut again further down. Words that are alike in all groups stand at one node; where
    they are more than `most`, they are dealt over parts, and questions go to each part.
    """
    whole, first = F.lit(b"").alias("node"), F.lit(0).cast("bigint").alias("part")
    asks = words.select("word", "n", whole)
    if words.count() <= most:
        return words.select(whole, first, "word", "n"), asks.select("node", first, "word", "n")
    placed, asked = [], []
    for depth in DEPTHS:
        here = words.withColumn("node", F.substring("vec", 1, depth))
        counts = here.groupBy("node").agg(F.count("*").alias("words"))
        last = depth == GROUPS
        parts = F.ceil(F.col("words") / most) if last else F.lit(1).cast("bigint")
        counts = cut(counts.select("node", ((F.col("words") > most) & F.lit(not last)).alias("split"), parts.alias("parts")))
        table = small(counts, 64)
        here, asks = here.join(table, "node"), _ask(asks, depth).join(table, "node")  # nodes without words drop out
        part = F.pmod(F.xxhash64("word"), F.col("parts")).alias("part")
        placed.append(here.filter(~F.col("split")).select("node", part, "word", "n"))
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
        asked.append(asks.filter(~F.col("split")).select("node", every, "word", "n"))
        if last or counts.filter("split").isEmpty():
            break
        words, asks = cut(here.filter("split").select("word", "n", "vec")), cut(asks.filter("split").select("word", "n", "node"))
    for found in (placed, asked):
        while len(found) > 1:
            found.append(found.pop().unionByName(found.pop()))
    return placed[0], asked[0]


class Found:
    """What a task has found out about words: how many near ones, and the best of them."""

    def __init__(self) -> None:
        self.count: Counter = Counter()
        self.best: dict[bytes, tuple[int, bytes]] = {}

    def add(self, word: bytes, other: bytes, n: int) -> None:
        self.count[word] += 1
        if word not in self.best or (-n, other) < self.best[word]:
            self.best[word] = (-n, other)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """word, n_near, best, in batches; then nothing is known any more."""
        words = list(self.count)
        kind = pa.struct([("n", pa.int64()), ("form", pa.string())])
        for start in range(0, len(words), 10_000):
            part = words[start : start + 10_000]
            best = [{"n": self.best[w][0], "form": self.best[w][1].decode("latin-1")} for w in part]
            columns = [pa.array([w.decode("latin-1") for w in part], pa.string()), pa.array([self.count[w] for w in part], pa.int64()), pa.array(best, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n_near", "best"])
        self.count.clear()
        self.best.clear()


def neighbours(words: DataFrame, most: int = 30_000) -> DataFrame:
    """word, n_near and best (struct of -n and form: the near word of largest n, of ties the smallest) for words with near words."""
    placed, asked = shards(words, most)
    stream = placed.withColumn("ask", F.lit(False)).unionByName(asked.withColumn("ask", F.lit(True)))
    dealt = stream.repartition("node", "part").sortWithinPartitions("node", "part", "ask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple] = []  # words of the shards that this batch asks
        trie, found = None, Found()
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch.column(k).to_pylist() for k in ("node", "part", "word", "n", "ask")}
            shard = list(zip(c["node"], c["part"], strict=True))
            rows = list(zip(shard, [w.encode("latin-1") for w in c["word"]], c["n"], strict=True))
            if not (trie and all(c["ask"]) and shard[0] == shard[-1] == known[0][0] == known[-1][0]):
                known = [r for r in known if r[0] == shard[0]] + [r for r, ask in zip(rows, c["ask"], strict=True) if not ask]
                number = {k: i for i, k in enumerate(dict.fromkeys(r[0] for r in known))}
                trie = Trie(np.array([number[r[0]] for r in known]), vectors([r[1] for r in known])) if known else None
                known_letters, known_size = grid([r[1] for r in known])
            asks = [r for r, ask in zip(rows, c["ask"], strict=True) if ask and r[0] in number]  # a part may have got no word
            if not asks:
                continue
            letters, size = grid([r[1] for r in asks])
            for of, to, apart in trie.search(np.array([number[r[0]] for r in asks]), vectors([r[1] for r in asks])):
                good = near_rows(letters[of], size[of], known_letters[to], known_size[to])
                for k in np.flatnonzero((size[of] > _WIDE) | (known_size[to] > _WIDE)).tolist():
                    good[k] = near(asks[of[k]][1], known[to[k]][1])
                for i, j, both in zip(of[good].tolist(), to[good].tolist(), apart[good].tolist(), strict=True):
                    word, other = asks[i], known[j]
                    found.add(word[1], other[1], other[2])
                    if both:
                        found.add(other[1], word[1], word[2])
            if len(found.count) > _HELD:
                yield from found.rows()
        yield from found.rows()

    found = dealt.mapInArrow(arrow.tidy(run), "word string, n_near bigint, best struct<n: bigint, form: string>")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root for rows (word, form): where following forms ends. Each step doubles the way that is known; as a form occurs
    at least twice as often as its word, ways are short and have no rings."""
    way = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = way.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        # Only roots that lead on matter; of a root that many words share there is one row here.
        leads = cut(onward.join(way.select(F.col("root").alias("_at")).distinct(), "_at", "left_semi"))
        if leads.isEmpty():
            return way
        joined = way.join(small(leads, 120), F.col("root") == F.col("_at"), "left")
        way = cut(joined.select("word", F.coalesce("_next", "root").alias("root")))


def variants(docs: DataFrame, most: int = 30_000, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary.

    Near words differ by one inserted, deleted or replaced letter. A word's form is its near word of largest n, of ties the
    smallest by code points, if it occurs at least twice as often; its root is where forms lead. No rows and texts without words
    give no rows; null texts have no words; repeated rows count again; other columns than id and text are not read.
    """
    words = cut(vocabulary(docs, **options))
    near_words = cut(neighbours(words, most))
    joined = cut(words.select("word", "n").join(near_words, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        *(F.when(-F.col("best.n") >= 2 * F.col("n"), x).alias(a) for x, a in ((F.col("best.form"), "form"), (-F.col("best.n"), "form_n"))),
    ))
    ends = roots(joined.filter("form IS NOT NULL"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
