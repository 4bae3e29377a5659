"""A Merkle manifest of a dataset: a SHA-256 tree whose parents retain the hash state before each child.

A parent hashes its children's digests as hex text. As such a digest fills just one block of SHA-256, the state of the hash
before each child is eight words, which a parent keeps (`trees`, column states). Whoever wants to know what root a changed leaf
would give (`prove`) resumes at each level the state kept for the leaf's slot and adds the replacement and the siblings to its
right; what stands to its left is never hashed again. Trees are cut into blocks of arity ** levels nodes, each one row, so no
task holds more than a few blocks, however large a group is.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm import arrow
from waymark.session import cut, small

_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= x else (low, mid - 1)
    return low


#: The first 32 bits of the fractions of the primes' cube and square roots, by which SHA-256 is defined.
_ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _PRIMES], np.uint32)
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _PRIMES[:8]], np.uint32)
#: Four hex digits as four bytes of text, for every 16 bits.
_HEX = np.frombuffer(b"".join(b"%04x" % v for v in range(1 << 16)), ">u4").astype(np.uint32)
_SLICE = 8192  # columns worked on at a time, so that they stay in the processor's cache


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256 states (8, n) after one more block (16, n) each."""
    if state.shape[1] > _SLICE:
        wide = np.broadcast_to(block, (16, state.shape[1]))
        return np.hstack([absorb(state[:, i : i + _SLICE], wide[:, i : i + _SLICE]) for i in range(0, state.shape[1], _SLICE)])
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        k = t & 15
        if t >= 16:
            x, y = w[(t + 1) & 15], w[(t + 14) & 15]
            low, high = _turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3)), _turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))
            w[k] = w[k] + low + w[(t + 9) & 15] + high
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (w[k] + _ROUND[t])
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def message(digests: np.ndarray) -> np.ndarray:
    """The block (16, n) that the hex text of a digest (n, 8) is."""
    out = np.empty((16, len(digests)), np.uint32)
    out[0::2], out[1::2] = _HEX[(digests >> np.uint32(16)).T], _HEX[(digests & np.uint32(0xFFFF)).T]
    return out


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 8) of messages that were so many whole blocks."""
    last = np.zeros((16, len(blocks)), np.uint32)
    last[0] = 0x80000000
    last[14], last[15] = (blocks.astype(np.uint64) >> np.uint64(23)).astype(np.uint32), (blocks * 512).astype(np.uint32)
    return absorb(state, last).T


def _fresh(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def _raw(words: np.ndarray) -> bytes:
    return words.astype(">u4").tobytes()


def _words(raws: list[bytes]) -> np.ndarray:
    """(n, 8) from 32 bytes each."""
    return np.frombuffer(b"".join(raws), ">u4").astype(np.uint32).reshape(-1, 8)


def grow(leaves: np.ndarray, counts: np.ndarray, heights: np.ndarray, arity: int) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Digests of all levels, states before each child of all parents, and roots of many trees of so many leaves and levels."""
    trees = len(counts)
    digests, states, roots = ([b""] * trees for _ in range(3))
    digest, count = leaves, counts.astype(np.int64)
    level = 0
    while True:
        begin = np.cumsum(count) - count
        for k in np.flatnonzero(count):
            digests[k] += _raw(mine := digest[begin[k] : begin[k] + count[k]])
            if heights[k] == level:
                roots[k] = _raw(mine)
        live = heights > level
        if not live.any():
            return digests, states, roots
        up = np.where(live, -(-count // arity), 0)
        above = np.cumsum(up) - up
        place = np.arange(up.sum()) - np.repeat(above, up)
        run = np.minimum(arity, np.repeat(count, up) - place * arity)
        first = np.repeat(begin, up) + place * arity
        state, kept = _fresh(len(run)), np.zeros((len(run), arity, 8), np.uint32)
        for j in range(arity):
            mine = np.flatnonzero(run > j)
            kept[mine, j] = state[:, mine].T
            state[:, mine] = absorb(state[:, mine], message(digest[first[mine] + j]))
        digest, count = finish(state, run), up
        for k in np.flatnonzero(live):
            states[k] += _raw(kept[above[k] : above[k] + up[k]])
        level += 1


def _height(n: int, arity: int) -> int:
    """Levels above n nodes until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // arity), out + 1
    return out


def steps(trees: dict[str, list], of: np.ndarray, at: np.ndarray, arity: int) -> Iterator[tuple]:
    """On the way up from node at[i] of tree of[i], for each level: the nodes that still go on, their slots, the number of their
    parents' children, the states kept before the slots, and all children's digests."""
    digest, state = (_words(trees[k]) for k in ("digests", "states"))
    height, count = np.array(trees["height"]), np.array(trees["m"], np.int64)
    size = np.array([len(x) // 32 for x in trees["digests"]])
    number = np.array([len(x) // (32 * arity) for x in trees["states"]])
    here, there = np.cumsum(size) - size, np.cumsum(number) - number
    state, at = state.reshape(-1, arity, 8), at.copy()
    for level in range(height.max(initial=0)):
        rows = np.flatnonzero(height[of] > level)
        tree = of[rows]
        parent, slot = np.divmod(at[rows], arity)
        run = np.minimum(arity, count[tree] - parent * arity)
        kids = np.minimum((here[tree] + parent * arity)[:, None] + np.arange(arity), len(digest) - 1)
        yield rows, slot, run, state[there[tree] + parent, slot], digest[kids]
        at[rows] = parent
        up = -(-count // arity)
        here, there, count = here + count, there + up, up


def _record(arity: int) -> np.dtype:
    return np.dtype([("slot", "u1"), ("run", "u1"), ("state", ">u4", (8,)), ("kids", ">u4", (arity, 8))])


class Climb:
    """Leaves on their way to the root, with what a replacement makes of it and with the hash of all siblings met."""

    def __init__(self, leaves: np.ndarray):
        self.digest = leaves.copy()
        self.proof, self.met = _fresh(len(leaves)), np.zeros(len(leaves), np.int64)

    def step(self, rows: np.ndarray, slot: np.ndarray, run: np.ndarray, state: np.ndarray, kids: np.ndarray) -> None:
        resumed = state.T.copy()
        for j in range(kids.shape[1]):
            mine = np.flatnonzero((j >= slot) & (j < run))
            what = np.where((slot[mine] == j)[:, None], self.digest[rows[mine]], kids[mine, j])
            resumed[:, mine] = absorb(resumed[:, mine], message(what))
            other = np.flatnonzero((j != slot) & (j < run))
            self.proof[:, rows[other]] = absorb(self.proof[:, rows[other]], message(kids[other, j]))
            self.met[rows[other]] += 1
        self.digest[rows] = finish(resumed, run)


def field(c: Column) -> Column:
    """How a value enters a leaf: `-` if null, else its bytes of UTF-8 counted, a colon, and the value."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """SHA-256 of the fields, one after another."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def place(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (key, part, leaf, ...) with g (the part's number, parts in order, null first), n (its rows) and pos (the row's place
    in its part, by key, null first, then leaf); and the parts with g and n.

    Rows are dealt by range, so a part of any size is spread; a place is that in the range and the counts of ranges before.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["part", "key", "leaf", "_tie"]  # equal rows are told apart too, so that many of them are no single range
    sorted_rows = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()  # range and place in it
    at = cut(sorted_rows.drop("_tie")).withColumn("_i", number)
    at = at.withColumns({"_p": F.shiftright("_i", 33), "_r": F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_i")
    each = at.groupBy("_p", "part").agg(F.min("_r").alias("_first"), F.count("*").alias("_rows"))
    part = Window.partitionBy("part")
    each = cut(each.withColumns({"_end": F.sum("_rows").over(part.orderBy("_p")), "n": F.sum("_rows").over(part)}))
    begins = each.filter(F.col("_end") == F.col("_rows"))  # the range where a part begins; ranges are in order of parts
    before = begins.groupBy("_p").agg(F.count("*").alias("_c"))  # a row for each range at most
    before = before.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("part")) - 1
    parts = cut(begins.withColumn("_k", inside).join(small(cut(before), 16), "_p").select("part", (F.col("_before") + F.col("_k")).alias("g"), "n"))
    named = small(parts.select(F.col("part").alias("_part"), "g"), 120)
    each = cut(each.join(named, F.col("part").eqNullSafe(F.col("_part"))).select(
        F.col("_p").alias("_q"), "_part", "g", "n", (F.col("_end") - F.col("_rows") - F.col("_first")).alias("_shift")
    ))
    same = (F.col("_p") == F.col("_q")) & F.col("part").eqNullSafe(F.col("_part"))
    found = at.join(small(each, 140), same).withColumn("pos", F.col("_r") + F.col("_shift"))
    return found.drop("_p", "_r", "_q", "_part", "_shift"), parts


_TREE = "g bigint, n bigint, block bigint, m bigint, height int, digests binary, states binary, root binary"


def trees(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """A row for each block of arity ** levels neighbouring nodes (g, n, pos, digest) of a tree: digests of all levels, states
    before each child of all parents, and the block's root. A tree of one block ends at its root, others go on."""
    size = arity**levels
    block = (F.col("pos") - F.col("pos") % size) / size
    dealt = nodes.select("g", "n", block.cast("bigint").alias("block"), (F.col("pos") % size).alias("at"), "digest")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in arrow.whole_runs(batches, ["g", "block"], 32_768):
            g, n, b = (table.column(c).to_numpy() for c in ("g", "n", "block"))
            first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (b[1:] != b[:-1])])
            counts = np.diff(np.r_[first, len(g)])
            heights = np.array([_height(x, arity) if x <= size else levels for x in n[first].tolist()], np.int32)
            digests, states, roots = grow(_words(table.column("digest").to_pylist()), counts, heights, arity)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (g[first], n[first], b[first], counts, heights)] + [pa.array(x, pa.binary()) for x in (digests, states, roots)],
                ["g", "n", "block", "m", "height", "digests", "states", "root"],
            )

    return dealt.repartition("g", "block").sortWithinPartitions("g", "block", "at").mapInArrow(arrow.tidy(build), _TREE)


def _stages(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """Blocks of nodes, of these blocks' roots, and so on: as many stages as the largest tree needs."""
    size, out = arity**levels, []
    while True:
        out.append(cut(trees(nodes, arity, levels)))
        more = out[-1].filter(F.col("n") > size)
        if more.isEmpty():
            return out
        nodes = more.select("g", F.ceil(F.col("n") / size).alias("n"), F.col("block").alias("pos"), F.col("root").alias("digest"))


_ABOVE = "g bigint, block bigint, path binary, subroot binary, top binary"


def _descend(blocks: DataFrame, arity: int) -> DataFrame:
    """For each node of blocks, which have the paths from their roots on, the path from the node on, and the node's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 8):
                t = batch.slice(start, 8).to_pydict()
                count = np.array(t["m"])
                of = np.repeat(np.arange(len(count)), count)
                at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                paths = [b""] * len(of)
                for rows, slot, run_of, state, kids in steps(t, of, at, arity):
                    record = np.zeros(len(rows), _record(arity))
                    record["slot"], record["run"], record["state"], record["kids"] = slot, run_of, state, kids
                    for i, r in zip(rows.tolist(), record, strict=True):
                        paths[i] += r.tobytes()
                own = [t["digests"][k][32 * i : 32 * i + 32] for k, i in zip(of.tolist(), at.tolist(), strict=True)]
                whole = [p + t["path"][k] for p, k in zip(paths, of.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(t["g"])[of]), pa.array(np.array(t["block"])[of] * t["size"][0] + at), pa.array(whole, pa.binary())]
                    + [pa.array([t[c][k] for k in of.tolist()], pa.binary()) for c in ("subroot", "top")] + [pa.array(own, pa.binary())],
                    ["g", "block", "path", "subroot", "top", "own"],
                )

    return blocks.mapInArrow(arrow.tidy(run), _ABOVE + ", own binary")


def prove(rows: DataFrame, arity: int = 2, levels: int = 10) -> DataFrame:
    """For rows (key, part, leaf, other): key, leaf, subroot, root, proof_sha256, folded_root as hex text, and verified.

    Leaves of a part ascend by key; runs of `arity` nodes become their parent until one is left, the part's subroot; subroots,
    ordered by part, likewise become the root. proof_sha256 is of the siblings on the way from the leaf to the root.
    folded_root is what `other` (null: the leaf) in the leaf's place gives. Rows with equal or null keys are leaves like others,
    in order of their leaves; null parts are a part, the first. No rows give no rows. leaf and other are 32 bytes.
    """
    size = arity**levels
    rows = cut(rows.select("key", "part", "leaf", "other"))
    placed, parts = place(rows)
    placed = cut(placed.drop("part"))
    stages = _stages(placed.select("g", "n", "pos", F.col("leaf").alias("digest")), arity, levels)
    roots = [t.filter(F.col("n") <= size) for t in stages]
    lone = F.lit(0).cast("bigint").alias("g")
    ends = [t.select(lone, F.lit(parts.count()).cast("bigint").alias("n"), F.col("g").alias("pos"), F.col("root").alias("digest")) for t in roots]
    nodes = ends[0]
    for more in ends[1:]:
        nodes = nodes.unionByName(more)
    tops = _stages(nodes, arity, levels)

    def known(blocks: DataFrame, above: DataFrame | None, by: list[str]) -> DataFrame:
        if above is None:
            nothing = F.lit(b"")
            blocks = blocks.withColumns({"path": nothing, "subroot": nothing, "top": F.col("root")})
        else:
            blocks = blocks.join(small(above, 150 + 20 * (34 + 32 * arity)), by)
        return blocks.withColumn("size", F.lit(size).cast("bigint"))

    above = None
    for t in reversed(tops):
        above = cut(_descend(known(t, above, ["g", "block"]), arity))
    named = cut(above.select(F.col("block").alias("g"), "path", F.col("own").alias("subroot"), "top"))
    above = None
    for k in range(len(stages) - 1, -1, -1):
        blocks = known(roots[k], named, ["g"])
        if above is not None:
            blocks = blocks.unionByName(known(stages[k].filter(F.col("n") > size), above, ["g", "block"]), allowMissingColumns=True)
        if k:
            above = cut(_descend(blocks, arity)).drop("own")
    return _finish(blocks, placed, arity, size)


def _finish(blocks: DataFrame, placed: DataFrame, arity: int, size: int) -> DataFrame:
    """Leaves meet their block, which comes before them in the same stream, and climb from it to the root."""
    kind = dict(placed.dtypes)["key"]
    own = ["height", "m", "digests", "states", "path", "subroot", "top"]
    block = ((F.col("pos") - F.col("pos") % size) / size).cast("bigint").alias("block")
    leaves = placed.select("g", block, (F.col("pos") % size).alias("at"), "key", "leaf", "other")
    stream = blocks.select("g", "block", F.lit(-1).cast("bigint").alias("at"), *own).unionByName(leaves, allowMissingColumns=True)
    record = _record(arity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in arrow.whole_runs(batches, ["g", "block"], 16_384):
            at = table.column("at").to_numpy()
            heads = np.flatnonzero(at < 0)
            mine = np.flatnonzero(at >= 0)
            of = (np.cumsum(at < 0) - 1)[mine]
            trees_of = table.select(own).take(heads).to_pydict()
            rows = table.select(["key", "leaf", "other"]).take(mine).combine_chunks()
            leaf_raw, other = rows.column("leaf").to_pylist(), rows.column("other").to_pylist()
            climb = Climb(_words([o or x for o, x in zip(other, leaf_raw, strict=True)]))
            for step in steps(trees_of, of, at[mine], arity):
                climb.step(*step)
            long = np.array([len(p) // record.itemsize for p in trees_of["path"]], np.int64)
            paths = np.frombuffer(b"".join(trees_of["path"]), record)
            begin = np.cumsum(long) - long
            for level in range(long.max(initial=0)):
                on = np.flatnonzero(long[of] > level)
                r = paths[begin[of[on]] + level]
                climb.step(on, r["slot"].astype(np.int64), r["run"].astype(np.int64), r["state"].astype(np.uint32), r["kids"].astype(np.uint32))
            proof, folded = _raw(finish(climb.proof, climb.met)), _raw(climb.digest)
            cells = [[x[i : i + 32] for i in range(0, len(x), 32)] for x in (proof, folded)]
            same = [[trees_of[c][k] for k in of.tolist()] for c in ("subroot", "top")]
            for start in range(0, len(mine), 8192):
                part = slice(start, start + 8192)
                columns = [pa.array(x[part], pa.binary()) for x in (leaf_raw, *same, *cells)]
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays(rows.column("key").slice(start, 8192).chunks), *columns], ["key", "leaf", "subroot", "root", "proof", "folded"]
                )

    dealt = stream.repartition("g", "block").sortWithinPartitions("g", "block", "at")
    found = dealt.mapInArrow(arrow.tidy(run), f"key {kind}, leaf binary, subroot binary, root binary, proof binary, folded binary")
    text = [F.lower(F.hex(c)).alias(n) for c, n in (("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"), ("proof", "proof_sha256"), ("folded", "folded_root"))]
    return found.select("key", *text, (F.col("folded") == F.col("root")).alias("verified"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, part_col: str = "lang", id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id beside what `prove` tells of a tree over docs, whose leaves are of `fields`; only these columns, part and id are read.

    changed: columns as they would be after tampering; where they are null-safe equal to the true ones nothing is tampered with.
    """
    true = [F.col(f) for f in fields]
    other = [(changed or {}).get(f, F.col(f)) for f in fields]
    differs = F.lit(False)
    for f in changed or {}:
        differs = differs | ~F.col(f).eqNullSafe(changed[f])
    rows = docs.select(F.col(id_col).alias("key"), F.col(part_col).alias("part"), leaf(*true).alias("leaf"), F.when(differs, leaf(*other)).alias("other"))
    return prove(rows, **options).withColumnRenamed("key", "doc_id")


def tampered(id_col: str = "doc_id", column: str = "n_chars", modulus: int = 7) -> dict[str, Column]:
    """One more in `column` where the modulus divides the crc32 of the id in decimal; nulls stay."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == 0
    return {column: F.when(hit, F.col(column).cast("decimal(38,0)") + 1).otherwise(F.col(column).cast("decimal(38,0)"))}
