"""N-gram Jaccard join: group counts of documents as points in R-trees, over families that share rare shingles.

Two alike sets share most of their shingles, so also one of the rarest few of each. Documents with such a rare shingle in
common, directly or through others, form a family, and only there are links looked for. In a family, shingle hashes are
dealt into groups and documents are points whose coordinates are counts a group; a tree of boxes over the points bounds
the overlap of a document with all points of a box by the sum of smaller coordinates, and what that leaves is verified on
the sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import arrow, words
from waymark.llm.components import components
from waymark.session import cut, small

AXES = 64  # coordinates of a point
LEAF = 16  # points or boxes in a box
_K = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_sets(texts: list[str], width: int = 3) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; a text with fewer words has one of all its words, or none."""
    raw, begins = words.join(texts)
    raw = raw.lower()  # of bytes: A-Z only
    starts, ends = words.find(raw)
    hashed = words.hashes(raw, starts, ends)
    first = np.searchsorted(starts, begins)
    rolled = np.zeros(max(len(hashed) - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = words.mix(rolled * _K[0] + hashed[k : k + len(rolled)] + _K[1])
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for h in hashed[a:b]:
                whole = words.mix(whole * _K[0] + h + _K[2])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Similarity:
    """Jaccard of at least percent/100, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def need(self, total):
        """Fewest shared elements of two sets whose sizes sum to total."""
        return -(-(self.percent * total) // (100 + self.percent))

    def least(self, size):
        """Fewest elements that a set of that size shares with any that is alike; also the size of its smallest partner."""
        return -(-self.percent * size // 100)

    def extra(self, size):
        """How many of the shared elements a look at the first ones is to show."""
        return np.minimum(1 + size * (100 - self.percent) // 100, self.least(size))

    def first(self, size):
        """In any order that all sets keep to, the shared elements of two alike sets begin within so many of each, plus one."""
        return size - self.least(size) + 1


class RTree:
    """Boxes over points, packed level by level: points sorted by size and then by coordinates in turn fill the leaves."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        total = points.sum(axis=1)
        order = np.argsort(total, kind="stable")
        slab = max(LEAF, int(np.ceil(np.sqrt(n / LEAF))) * LEAF)
        spread = points.var(axis=0)
        axis = np.argsort(-spread)[:3]
        order = np.concatenate([s[np.lexsort(points[s][:, axis].T)] for s in (order[i : i + slab] for i in range(0, n, slab))]) if n else order
        self.order = order
        self.levels = []  # from the leaves up: highest coordinates and lowest size of each box
        high, low = points[order], total[order]
        while len(high) > 1 or not self.levels:
            cuts = np.arange(0, max(len(high), 1), LEAF)
            high, low = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low, cuts)
            self.levels.append((high, low))

    def search(self, point: np.ndarray, size: int, need) -> np.ndarray:
        """Positions of all points in boxes that may hold one with enough overlap."""
        boxes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[depth]
            boxes = boxes[boxes < len(high)]
            bound = np.minimum(high[boxes], point).sum(axis=1)
            boxes = boxes[bound >= need(low[boxes] + size)]
            boxes = (boxes[:, None] * LEAF + np.arange(LEAF)).ravel()
        return self.order[boxes[boxes < len(self.order)]]


def coordinates(sets: list[np.ndarray]) -> np.ndarray:
    """Counts of each set's hashes by their lowest bits."""
    if not sets:
        return np.zeros((0, AXES), np.int32)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    axis = (np.concatenate(sets) & np.uint64(AXES - 1)).astype(np.int64)
    return np.bincount(row * AXES + axis, minlength=len(sets) * AXES).reshape(len(sets), AXES).astype(np.int32)


def link(sets: list[np.ndarray], alike: Similarity, group: list[int], asking: np.ndarray | None = None) -> list[int]:
    """Groups after linking: `group` numbers sets that are linked already; alike ones are joined. With `asking` only pairs
    with one such set are looked at. A pair within a group needs no look."""
    n = len(sets)
    points = coordinates(sets)
    sizes = np.array([len(s) for s in sets])
    tree = RTree(points)
    label = np.array(group)
    need = alike.need
    for i in range(n) if asking is None else np.flatnonzero(asking):
        if (label == label[0]).all():
            break
        found = tree.search(points[i], int(sizes[i]), need)
        found = found[label[found] != label[i]]
        found = found[np.minimum(points[found], points[i]).sum(axis=1) >= need(sizes[found] + sizes[i])]
        for j in found:
            if label[i] == label[j]:
                continue
            a, b = (sets[i], sets[j]) if sizes[i] < sizes[j] else (sets[j], sets[i])
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            if int((b[at] == a).sum()) >= need(int(sizes[i] + sizes[j])):
                label[label == label[j]] = label[i]
    return label.tolist()


def _profile(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles and two halves of a hash of the set, for every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch, "text"):
                sets = shingle_sets(arrow.texts(part, "text"), width)
                marks = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8") for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()),
                        pa.array([m[1] for m in marks], pa.int64()),
                    ],
                    ["doc_id", "n_shingles", "hi", "lo"],
                )

    return docs.mapInArrow(arrow.tidy(run), f"doc_id {kind}, n_shingles bigint, hi bigint, lo bigint")


def _deal(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order by bucket, and for each bucket that has any its number and its stretch; others, however many, are not looked at."""
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    start = _runs(ordered)[1]
    return order, list(zip(ordered[start].tolist(), start.tolist(), np.append(start[1:], len(ordered)).tolist(), strict=True))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((words.mix(key) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _bytes(table: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(column).to_pylist() if x is not None), kind)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values: the number of each one's run, and the runs' starts."""
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    return np.cumsum(fresh) - 1, np.flatnonzero(fresh)


_NOBODY = np.iinfo(np.int64).min


def _shared_counts(docs: DataFrame, alike: Similarity, width: int, buckets: int) -> DataFrame:
    """node, shared: how many of a document's smallest hashes another document has among its own.

    The smallest hashes of alike sets, a bit more than each may be without, show `extra` of the shared ones. A slice of
    documents sends a key once; what the slice itself shares is counted there, so a key of very many documents is one entry
    a slice. Answers go back by slice, packed, and are summed there: one row a document, however many buckets its keys met in.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch, "text", 4_000_000):
                found = [s[: alike.first(len(s)) - 1 + alike.extra(len(s))] if len(s) else s for s in shingle_sets(arrow.texts(part, "text"), width)]
                key = np.concatenate(found)
                if not len(key):
                    continue
                node = np.repeat(part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), [len(f) for f in found])
                order = np.argsort(key, kind="stable")
                key, node = key[order], node[order]
                run, start = _runs(key)
                many = np.bincount(run)[run] > 1
                who, n = np.unique(node[many], return_counts=True)
                key, node = key[start], np.where(many[start], _NOBODY, node[start])
                order, parts = _deal(_bucket(key, buckets))
                key, node = key[order], node[order]
                # Any number does for a slice that only brings its answers together; ids that come again are summed at the end.
                where = hash((part.column("doc_id")[0].as_py(), part.num_rows, len(key)))
                rows = [(k, where, key[i:j].tobytes(), node[i:j].tobytes(), None) for k, i, j in parts]
                if len(who):
                    rows.append((int(who[0]) % buckets, where, None, who.tobytes(), n.astype("<i8").tobytes()))
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield _batch(rows, ["bucket", "slice", "keys", "nodes", "counts"], kinds)

    def meet(table: pa.Table) -> pa.Table:
        own = pc.is_valid(table.column("keys"))
        sent, told = table.filter(own), table.filter(pc.invert(own))
        key = _bytes(sent, "keys", "<u8")
        _, run = np.unique(key, return_inverse=True)
        shared = np.bincount(run)[run] > 1 if len(key) else np.zeros(0, bool)
        rows, at = list(zip(*(told.column(c).to_pylist() for c in ("slice", "nodes", "counts")), strict=True)), 0
        for where, raw in zip(sent.column("slice").to_pylist(), sent.column("nodes").to_pylist(), strict=True):
            node = np.frombuffer(raw, "<i8")
            who, n = np.unique(node[shared[at : at + len(node)] & (node != _NOBODY)], return_counts=True)
            at += len(node)
            if len(who):
                rows.append((where, who.tobytes(), n.astype("<i8").tobytes()))
        kinds = [pa.int64(), pa.binary(), pa.binary()]
        arrow.release()
        return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["slice", "nodes", "counts"])

    def total(table: pa.Table) -> pa.Table:
        node, run = np.unique(_bytes(table, "nodes", "<i8"), return_inverse=True)
        arrow.release()
        return pa.table({"node": node, "n": np.bincount(run, _bytes(table, "counts", "<i8"), len(node)).astype(np.int64)})

    packed = docs.filter("doc_id IS NOT NULL").mapInArrow(arrow.tidy(pack), "bucket bigint, slice bigint, keys binary, nodes binary, counts binary")
    met = packed.groupBy("bucket").applyInArrow(meet, "slice bigint, nodes binary, counts binary")
    return met.groupBy("slice").applyInArrow(total, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("shared"))


def _slices(docs: DataFrame, width: int) -> DataFrame:
    """Sets of (node, text) in slices: slice, nodes, sizes, shingles (packed 64-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch, "text", 4_000_000):
                sets = shingle_sets(arrow.texts(part, "text"), width)
                sizes = np.array([len(s) for s in sets], np.int64)
                nodes = part.column("node").to_numpy(zero_copy_only=False).astype(np.int64)
                yield _batch([(nodes.tobytes(), sizes.tobytes(), np.concatenate(sets).tobytes())], ["nodes", "sizes", "shingles"], [pa.binary()] * 3)

    return docs.mapInArrow(arrow.tidy(run), "nodes binary, sizes binary, shingles binary").withColumn("slice", F.monotonically_increasing_id())


def _sets(slices: DataFrame) -> DataFrame:
    """Slices to rows node, shingles; empty sets are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = 8 * np.cumsum(np.frombuffer(row["sizes"], "<i8"))
                cuts = zip(np.frombuffer(row["nodes"], "<i8").tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True)
                rows = [(n, row["shingles"][i:j]) for n, i, j in cuts if j > i]
                if rows:
                    yield _batch(rows, ["node", "shingles"], [pa.int64(), pa.binary()])

    return slices.select("nodes", "sizes", "shingles").mapInArrow(arrow.tidy(run), "node bigint, shingles binary")


def _frequencies(slices: DataFrame, buckets: int) -> DataFrame:
    """slice, keys, held: for every slice the shingles that more than one document has, and how many have them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key, n = np.unique(np.frombuffer(row["shingles"], "<u8"), return_counts=True)
                order, parts = _deal(_bucket(key, buckets))
                key, n = key[order], n[order].astype("<i4")
                if parts:
                    rows = [(k, row["slice"], key[i:j].tobytes(), n[i:j].tobytes()) for k, i, j in parts]
                    yield _batch(rows, ["bucket", "slice", "keys", "held"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    def count(table: pa.Table) -> pa.Table:
        key, n = _bytes(table, "keys", "<u8"), _bytes(table, "held", "<i4").astype(np.int64)
        sizes = [len(x) // 8 for x in table.column("keys").to_pylist()]
        _, run = np.unique(key, return_inverse=True)
        total = np.bincount(run, n).astype(np.int64)[run]
        rows, at = [], 0
        for where, size in zip(table.column("slice").to_pylist(), sizes, strict=True):
            keep = total[at : at + size] > 1
            if keep.any():
                rows.append((where, key[at : at + size][keep].tobytes(), total[at : at + size][keep].tobytes()))
            at += size
        kinds = [pa.int64(), pa.binary(), pa.binary()]
        arrow.release()
        return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["slice", "keys", "held"])

    packed = slices.select("slice", "shingles").mapInArrow(arrow.tidy(pack), "bucket bigint, slice bigint, keys binary, held binary")
    return packed.groupBy("bucket").applyInArrow(count, "slice bigint, keys binary, held binary")


def _stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the smallest node of each key, and edges from the key's other nodes to it, each once."""
    order = np.lexsort((node, key))
    run, start = _runs(key[order])
    own, hub = node[order], node[order][start][run]
    pairs = np.unique(np.column_stack([own[own != hub], hub[own != hub]]), axis=0)
    return order[start], pairs[:, 0], pairs[:, 1]


def _rarest(left: pa.Table, right: pa.Table, alike: Similarity, more: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice and its frequencies: the number of the set, the rank in it by rarity, and the shingle, for those among the
    first `alike.first` + more of a set that another document has; in order of set and rank."""
    sizes, shingle = _bytes(left, "sizes", "<i8"), _bytes(left, "shingles", "<u8")
    known, held = _bytes(right, "keys", "<u8"), _bytes(right, "held", "<i8")
    if not len(known) or not len(shingle):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    order = np.argsort(known)
    known, held = known[order], held[order]
    at = np.minimum(np.searchsorted(known, shingle), len(known) - 1)
    n = np.where(known[at] == shingle, held[at], 1)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((shingle, n, doc))
    rank = np.arange(len(doc)) - (np.cumsum(sizes) - sizes)[doc]
    keep = (rank < alike.first(sizes)[doc] + more) & (n[order] > 1)
    return doc[keep], rank[keep], shingle[order[keep]]


def _rare_edges(slices: DataFrame, held: DataFrame, alike: Similarity, buckets: int) -> DataFrame:
    """Edges (a, b) by which documents that share one of their rarest shingles hang together.

    A set's shingles are ordered by how many have them; where those that nobody else has fill the first ones, the document
    is alike to none. A slice sends a key once, with its smallest node, and ties the others to that node itself.
    """

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["bucket", "keys", "nodes", "hubs"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        doc, _, key = _rarest(left, right, alike)
        rows = []
        if len(key):
            node = _bytes(left, "nodes", "<i8")[doc]
            head, a, b = _stars(key, node)
            key, node = key[head], node[head]
            order, parts = _deal(_bucket(key, buckets))
            key, node = key[order], node[order]
            rows = [(k, key[i:j].tobytes(), node[i:j].tobytes(), None) for k, i, j in parts]
            if len(a):
                rows.append((int(a[0]) % buckets, None, a.tobytes(), b.tobytes()))
        arrow.release()
        return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names)

    def tie(table: pa.Table) -> pa.Table:
        own = pc.is_valid(table.column("keys"))
        sent, told = table.filter(own), table.filter(pc.invert(own))
        _, a, b = _stars(_bytes(sent, "keys", "<u8"), _bytes(sent, "nodes", "<i8"))
        arrow.release()
        return pa.table({"a": np.concatenate([a, _bytes(told, "nodes", "<i8")]), "b": np.concatenate([b, _bytes(told, "hubs", "<i8")])})

    chosen = slices.groupBy("slice").cogroup(held.groupBy("slice")).applyInArrow(pick, "bucket bigint, keys binary, nodes binary, hubs binary")
    return chosen.groupBy("bucket").applyInArrow(tie, "a bigint, b bigint")


def _blocks(rows: DataFrame, keys: list[str], alike: Similarity, reps: bool = False) -> DataFrame:
    """Link the sets of each block (rows alike in keys: node, label, asks, shingles), and give edges a, b between nodes; with
    reps also one node of each group that is left, with its set (a = b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in arrow.groups(batches, keys):
            node, label, asks = (table.column(c).to_pylist() for c in ("node", "label", "asks"))
            sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
            number = {x: i for i, x in enumerate(dict.fromkeys(label))}
            out = link(sets, alike, [number[x] for x in label], None if all(asks) else np.array(asks))
            first: dict[int, int] = {}
            rows = []
            for i, g in enumerate(out):
                if first.setdefault(g, i) != i:
                    rows.append((node[i], node[first[g]], None, table.column("family")[0].as_py()))
            if reps:
                rows += [(node[i], node[i], sets[i].tobytes(), table.column("family")[0].as_py()) for i in first.values()]
            if rows:
                a, b, s, f = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.binary()), pa.array(f, pa.int64())], ["a", "b", "shingles", "family"])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "node")
    return dealt.mapInArrow(arrow.tidy(run), "a bigint, b bigint, shingles binary, family bigint")


def _small(df: DataFrame) -> DataFrame:
    """df, all of whose columns are numbers, marked for broadcast if a count shows that it is small."""
    return small(df, 8 * len(df.columns) + 8)


def classes(
    docs: DataFrame, percent: int = 90, width: int = 3, block: int = 50_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the smallest doc_id that links lead to.

    Rows with equal sets form a class, in which the smallest id stands for all; copies are never compared. A family of more
    than `block` shingles is split into blocks of about that many: first each block by itself, then one document of each
    group that is left against some of the other blocks, and what is still apart where it shares rare shingles with another
    group (_link_apart). So no task holds more than a few blocks, and a family costs what its size does.

    Null and empty texts have no shingles and link with nothing. Rows of one doc_id are one document with several texts,
    linked by any. A row without doc_id counts in its class but stands for none: if no row of the class has an id it links
    with nothing and its component_id is null. No rows give no rows; other columns are not read.
    """
    alike = Similarity(percent)
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(_profile(base, width))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    mark = ["hi", "lo", "n_shingles"]
    real = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    first = cut(real.groupBy(*mark).agg(F.min("doc_id").alias("node")))

    # Documents that share enough of their smallest hashes, then those of them that share one of their rarest shingles.
    shared = _shared_counts(base, alike, width, max(8, total // 16_000_000))
    fewest = f"({percent} * n_shingles + 99) DIV 100"  # the size of the smallest partner
    enough = F.expr(f"shared >= least(1 + {100 - percent} * ({fewest}) DIV 100, ({percent} * ({fewest}) + 99) DIV 100)")
    looked = cut(first.join(shared, "node").filter(enough).select("node").distinct())
    slices = cut(_slices(base.join(_small(looked), base["doc_id"] == looked["node"]).select("node", "text"), width))
    volume = slices.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    buckets = max(8, volume // 8_000_000)
    families = cut(components(_rare_edges(slices, _frequencies(slices, buckets), alike, buckets)).withColumnRenamed("component", "family"))

    # Where to look: members of families with the number of blocks of each family.
    sized = families.join(first.groupBy("node").agg(F.sum("n_shingles").alias("n")), "node")
    blocks = sized.groupBy("family").agg(F.ceil(F.sum("n") / block).cast("bigint").alias("k"))
    members = cut(sized.join(_small(cut(blocks)), "family").select("node", "family", "k"))
    hold = _sets(slices).join(_small(members), "node").select(
        "family", "node", F.col("node").alias("label"), "k", F.lit(True).alias("asks"), "shingles", F.pmod(F.xxhash64("node"), "k").alias("tile")
    )
    large = not members.filter("k > 1").isEmpty()
    edges = _link_large(hold, alike, block) if large else _blocks(hold, ["family", "tile"], alike).select("a", "b")
    found = components(edges)

    # Each class's smallest id over its component, then back to the rows by class.
    joined = first.join(found, "node", "left").select(*mark, F.coalesce("component", "node").alias("component_id"))
    return rows.join(joined, mark, "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _link_large(hold: DataFrame, alike: Similarity, block: int) -> DataFrame:
    hold = cut(hold)
    own = cut(_blocks(hold, ["family", "tile"], alike, reps=True))
    edges = own.filter("shingles IS NULL").select("a", "b")
    # One document of each group of a large family, block against block.
    split = cut(hold.filter("k > 1").select("family").distinct())
    reps = own.filter("shingles IS NOT NULL").join(_small(split), "family").select(
        "family", F.col("a").alias("node"), F.col("a").alias("label"), F.lit(True).alias("asks"), "shingles"
    )
    room = reps.groupBy("family").agg(F.ceil(F.sum(F.octet_length("shingles")) / (8 * block)).cast("bigint").alias("k2"))
    dealt = reps.join(_small(cut(room)), "family").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(1)), "k2")).drop("k2")
    edges = cut(edges.unionByName(_blocks(dealt, ["family", "tile"], alike).select("a", "b")))
    found = components(edges)
    # What is still apart: few against all of the family, or else by the rarest shingles that members of different groups share.
    state = cut(hold.filter("k > 1").drop("label").join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"))
    sums = cut(_sums(state.select(F.col("family").alias("key"), "label", (F.octet_length("shingles") / 8).cast("bigint").alias("n")), alike, block))
    few, many = (cut(sums.filter(c)) for c in ("cheap", "NOT cheap"))
    if not few.isEmpty():
        rows = state.select(F.col("family").alias("key"), "node", "label", "shingles").join(_small(few), "key")
        edges = edges.unionByName(_few_by_all(rows, alike))
    if not many.isEmpty():
        left = state.join(_small(many.select(F.col("key").alias("family"))), "family").select("node", "label", "shingles")
        edges = edges.unionByName(_link_apart(cut(left), alike, block))
    return edges


def _sums(rows: DataFrame, alike: Similarity, block: int, copies: float = 1.0) -> DataFrame:
    """Of rows key, label, n, for keys with several labels: the sum of n as `all`, the label that has most of it, the numbers of
    blocks of all (k) and of what has another label (km), and whether to meet tile by tile is cheaper, as it copies less, than to
    split the key by the rarest shingles of its sets, of which each gives so many copies."""
    keys = F.expr(f"n * (n - ({alike.percent} * n + 99) DIV 100 + 1)") * copies
    sums = rows.groupBy("key", "label").agg(F.sum("n").alias("n"), F.sum(keys).alias("split")).groupBy("key").agg(
        F.count("*").alias("parts"), F.sum("n").alias("all"), F.max("n").alias("top"), F.max_by("label", F.struct("n", "label")).alias("most"),
        F.sum("split").alias("split"),
    )
    blocks = lambda n: F.ceil(n / block).cast("bigint")
    out = sums.filter("parts > 1").select("key", "all", "top", "most", "split", blocks(F.col("all")).alias("k"), blocks(F.col("all") - F.col("top")).alias("km"))
    return out.select("key", "all", "most", "k", "km", F.expr("all * CAST(km AS DOUBLE) + (all - top) * CAST(k AS DOUBLE) <= split").alias("cheap"))


#: Blocks on each side of a tile in which few sets meet many.
_TILE = 4


def _few_by_all(rows: DataFrame, alike: Similarity) -> DataFrame:
    """Edges between the sets outside a key's largest label and all of the key's, tile by tile. rows: key, node, label, shingles,
    most, k, km. A row's copies are made right before they are dealt, one behind the other, so that they compress well. A tile
    is of _TILE blocks a side, a few megabytes, as a set is copied once for each tile of the other side."""
    rows = rows.withColumns({c: F.ceil(F.col(c) / _TILE).cast("bigint") for c in ("k", "km")})
    number = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    own = ["key", F.lit(0).cast("bigint").alias("family"), "node", "label", "shingles"]
    asking = rows.filter("label <> most").select(*own, F.lit(True).alias("asks"), number(2, F.col("km")).alias("i"), upto("k").alias("j"))
    asked = rows.select(*own, F.lit(False).alias("asks"), upto("km").alias("i"), number(3, F.col("k")).alias("j"))
    return _blocks(asking.unionByName(asked), ["key", "i", "j"], alike).select("a", "b")


def _prefixes(left: DataFrame, alike: Similarity) -> DataFrame:
    """node, label, n, own, keys: of each set its size, its rarest shingles that others have (packed, rarest first; one more than
    alike sets are sure to share one of), and how many of them are without that one more."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch, "shingles", 4_000_000):
                sets = part.column("shingles").to_pylist()
                sizes = np.array([len(x) // 8 for x in sets], "<i8")
                nodes, labels = (part.column(c).to_numpy(zero_copy_only=False).astype("<i8") for c in ("node", "label"))
                row = (nodes.tobytes(), labels.tobytes(), sizes.tobytes(), b"".join(sets))
                yield _batch([row], ["nodes", "labels", "sizes", "shingles"], [pa.binary()] * 4)

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, rank, key = _rarest(left, right, alike, 1)
        node, label, size = (_bytes(left, c, "<i8") for c in ("nodes", "labels", "sizes"))
        own = np.bincount(doc[rank < alike.first(size)[doc]], minlength=len(size)).astype(np.int64)
        ends = np.searchsorted(doc, np.arange(len(size) + 1)).tolist()
        keys = [key[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
        arrow.release()
        return pa.table({"node": node, "label": label, "n": size, "own": own, "keys": pa.array(keys, pa.binary())})

    packed = left.mapInArrow(arrow.tidy(pack), "nodes binary, labels binary, sizes binary, shingles binary")
    slices = cut(packed.withColumn("slice", F.monotonically_increasing_id()))
    volume = slices.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    held = _frequencies(slices, max(8, volume // 8_000_000))
    return slices.groupBy("slice").cogroup(held.groupBy("slice")).applyInArrow(pick, "node bigint, label bigint, n bigint, own bigint, keys binary")


def _keyed(prefixes: DataFrame, after: bool = False) -> DataFrame:
    """key, node, label, n: a row for each own key of a set; with `after` (rows have such a key) for that key with each behind
    it, if the set has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch, "keys", 50_000 if after else 2_000_000):
                rows = part.to_pylist()
                found = [np.frombuffer(r["keys"], "<u8") for r in rows]
                if after:
                    own = [np.array(r["key"], "<i8").view("<u8") for r in rows]
                    # Another text of the same id may be without the key; it meets others by keys of its own.
                    behind = [f[np.flatnonzero(f == h)[0] + 1 :] if (f == h).any() else f[:0] for h, f in zip(own, found, strict=True)]
                    found = [words.mix(h * _K[0] + f) for h, f in zip(own, behind, strict=True)]
                else:
                    found = [f[: r["own"]] for r, f in zip(rows, found, strict=True)]
                many = [len(f) for f in found]
                if sum(many):
                    fixed = [np.repeat(np.array([r[c] for r in rows], np.int64), many) for c in ("node", "label", "n")]
                    key = np.concatenate(found).view("<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, *fixed)], ["key", "node", "label", "n"])

    columns = ["node", "label", "n", "own", "keys", *(["key"] if after else [])]
    return prefixes.select(*columns).mapInArrow(arrow.tidy(run), "key bigint, node bigint, label bigint, n bigint")


def _link_apart(left: DataFrame, alike: Similarity, block: int) -> DataFrame:
    """Edges between sets (node, label, shingles) of different labels, looked for only where they share a key.

    A key is one of a set's rarest shingles; keys that only one label has are done. Keys of up to `block` shingles in all are
    dealt together into blocks of about that many. In a larger one, the sets outside its largest label meet all of it, if that
    copies less. If not, it is split: two alike sets share a second one of their rarest shingles too, so its sets meet by
    the key with each that comes behind it. Only sets that share two of their rarest shingles with many blocks of unlinked
    others then still cost their square.
    """
    prefixes = cut(_prefixes(left, alike))
    found, wide = _link_keyed(_keyed(prefixes), left, alike, block, last=alike.percent <= 50)
    if wide is None:
        return found
    # An id with several texts stands once for each in both.
    again = wide.select("key", "node").distinct().join(prefixes, "node")
    return found.unionByName(_link_keyed(_keyed(again, after=True), left, alike, block, last=True)[0])


def _link_keyed(keyed: DataFrame, left: DataFrame, alike: Similarity, block: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Edges by keys, and the rows (key, node, label, n) of keys that are to be split; none of those if it is the last time."""
    keyed = cut(keyed)
    sums = cut(_sums(keyed, alike, block, 0.5))  # a key meets half of a set's keys, as it meets those behind it only
    mass = sums.filter("k = 1").agg(F.sum("all")).first()[0] or 0
    crowded = cut(sums.filter("k > 1"))
    # Keys of any size but the crowded ones have few rows, so that this join has no hot key.
    near = keyed.join(_small(crowded.select("key")), "key", "left_anti").join(sums.select("key"), "key")
    near = near.select("node", F.pmod(F.xxhash64("key"), F.lit(mass // block + 1)).alias("tile")).distinct()
    sets = left.select("node", "label", "shingles", F.lit(True).alias("asks"), F.lit(0).cast("bigint").alias("family"))
    out = _blocks(near.join(sets, "node"), ["tile"], alike).select("a", "b")
    if crowded.isEmpty():
        return out, None
    rows = keyed.join(_small(crowded), "key")
    tiled = (rows if last else rows.filter("cheap")).select("key", "node", "most", "k", "km").distinct()  # a node may have several sets
    out = out.unionByName(_few_by_all(tiled.join(left.select("node", "label", "shingles"), "node"), alike))
    wide = None if last else cut(rows.filter("NOT cheap").select("key", "node", "label", "n"))
    return out, wide if wide is not None and not wide.isEmpty() else None


def one_of_each(docs: DataFrame, percent: int = 80, width: int = 5, **options) -> DataFrame:
    """docs with only the smallest doc_id of each component, all columns kept. Rows without an id stay."""
    found = classes(docs, percent, width, **options)
    drop = cut(found.filter("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(_small(drop), "doc_id", "left_anti")
