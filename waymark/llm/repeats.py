"""Removal of byte strings that an earlier document has, by suffix arrays over shards of candidate stretches.

Every string of `length` bytes has an anchor: the least, by a hash, of its substrings of GRAM bytes. Strings that lie next
to each other mostly share theirs, so an anchor stands for a stretch of the text, and equal strings have equal anchors.
Stretches that are equal as a whole are settled by their hashes. Where stretches share an anchor but differ - at the ends
of repeated passages - the stretches themselves go to shards, and a suffix array over each shard, with the common prefixes
of neighbours, tells which strings they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from waymark.llm import arrow, words
from waymark.llm.suffix import common_prefixes, suffix_array
from waymark.session import cut, small

GRAM = 24
#: An anchor with more different stretches than this is settled string by string in Spark, so that no task gathers them.
#: So many fill one suffix array.
CROWD = 25_000
LAST = 2**63 - 1
_K = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: So many string starts of a text are looked at together; below 2^23.
_PART = 1 << 20
FULL, EDGE, PARTNER, CROWD_EDGE, CROWD_PARTNER = 1, 2, 3, 4, 5


def anchors(raw: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts that lie end to end: hash of each anchor, the first and last string start that it stands for, a hash of the
    stretch, and how far into it the anchor begins. Long texts are worked through in parts, at whose borders a stretch may end."""
    none = np.zeros(0, np.int64)
    found = [(none.astype(np.uint64), none, none, none.astype(np.uint64), none)]
    n = len(raw) - length + 1
    inside = np.ones(max(n, 0), bool)  # strings that do not run over the end of their text
    for e in ends.tolist():
        inside[max(e - length + 1, 0) : e] = False
    for base in range(0, n, _PART):
        anchor, first, last, stretch, at = _anchors(raw[base : base + _PART + length - 1], inside[base : base + _PART], length)
        found.append((anchor, first + base, last + base, stretch, at))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _anchors(raw: bytes, inside: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    span = length - GRAM + 1
    view = lambda k: np.ndarray((len(raw) - GRAM + 1,), "<u8", raw, k, (1,))
    gram = words.mix(view(0) * _K[0] + words.mix(view(8) * _K[1] + view(16) * _K[2]))
    low = (gram & np.uint64(2**64 - 2**23)) | np.arange(len(gram), dtype=np.uint64)  # ties to the first
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: width - span], low[span - width :])
    turn = np.ones(len(low) + 1, bool)  # between strings that do not share an anchor
    turn[1:-1] = (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])
    first, last = np.flatnonzero(turn[:-1] & inside), np.flatnonzero(turn[1:] & inside)
    at = (low[first] & np.uint64(2**23 - 1)).astype(np.int64)
    # Grams laid end to end from the start and back from the end cover the stretch and so tell it.
    stretch = (last - first).astype(np.uint64)
    for k in range(-(-(span + length) // (2 * GRAM))):
        stretch = words.mix(stretch * _K[1] + gram[first + k * GRAM])
        stretch = words.mix(stretch * _K[2] + gram[last + length - (k + 1) * GRAM])
    return gram[at], first, last, stretch, at - first


class Group:
    """The anchors of a group of documents, each (anchor, stretch) once: that of the smallest document stands for the others."""

    def __init__(self, table: pa.Table, length: int, buckets: int):
        rows = sorted(zip(table.column("d").to_pylist(), table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True), key=lambda r: (r[0], r[2]))
        self.d = np.array([r[0] for r in rows], np.int64)
        self.ids = [r[1] for r in rows]
        self.raw = [r[2].encode() for r in rows]
        ends = np.cumsum([0, *map(len, self.raw)])
        self.anchor, first, last, self.stretch, self.inside = anchors(b"".join(self.raw), ends[1:], length)
        self.doc = np.searchsorted(ends, first, "right") - 1
        self.first, self.last = first - ends[self.doc], last - ends[self.doc]
        self.bucket = (self.anchor >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        # One of each pair, by bucket and then in order of documents; `of` leads from an occurrence to it.
        pair = words.mix(self.anchor * _K[1] + self.stretch)
        by = np.argsort(pair)
        differ = lambda x: np.concatenate([[True], x[by][1:] != x[by][:-1]])[: len(by)]
        fresh = differ(self.anchor) | differ(self.stretch)
        if (fresh != differ(pair)).any():  # two pairs with one hash
            by = np.lexsort((self.stretch, self.anchor))
            fresh = differ(self.anchor) | differ(self.stretch)
        head, of = np.minimum.reduceat(by, np.flatnonzero(fresh)) if len(by) else by, np.empty(len(by), np.int64)
        of[by] = np.cumsum(fresh) - 1
        order = np.lexsort((head, self.bucket[head]))
        self.one = head[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.of = back[of]
        self.starts = np.searchsorted(self.bucket[self.one], np.arange(buckets + 1, dtype=np.uint64))

    def requests(self) -> Iterator[tuple]:
        """bucket, anchors, stretches (48 bits each), and documents, as bytes."""
        six = lambda x: x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        for b in np.flatnonzero(np.diff(self.starts)):
            one = self.one[self.starts[b] : self.starts[b + 1]]
            yield int(b), six(self.anchor[one]), six(self.stretch[one]), self.d[self.doc[one]].astype("<i8").tobytes()

    def codes(self, replies: pa.Table) -> np.ndarray:
        """What the buckets said of each pair."""
        out = np.zeros(len(self.one), np.uint8)
        for b, at, code in zip(*(replies.column(c).to_pylist() for c in ("bucket", "at", "code")), strict=True):
            if b is not None:
                out[self.starts[b] + np.frombuffer(at, "<u4")] = np.frombuffer(code, np.uint8)
        return out


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _settle(table: pa.Table, most: int) -> Iterator[tuple]:
    """Of one bucket's requests: which stretches an earlier document has as a whole, and which have to be looked at closely."""
    groups = table.column("g").to_pylist()
    anchor = [_unpack(x) for x in table.column("anchor").to_pylist()]
    stretch = np.concatenate([_unpack(x) for x in table.column("stretch").to_pylist()])
    doc = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("docs").to_pylist()])
    sizes = [len(x) for x in anchor]
    anchor = np.concatenate(anchor)
    order = np.argsort(anchor, kind="stable")
    again = np.flatnonzero(anchor[order][1:] == anchor[order][:-1])
    shared = np.zeros(len(order), bool)
    shared[again], shared[again + 1] = True, True
    order = order[shared]
    code = np.zeros(len(anchor), np.uint8)
    if len(order):
        order = order[np.lexsort((doc[order], stretch[order], anchor[order]))]
        a, s, d = anchor[order], stretch[order], doc[order]
        new_a = np.concatenate([[True], a[1:] != a[:-1]])
        new_s = new_a | np.concatenate([[True], s[1:] != s[:-1]])
        of_a, of_s = np.cumsum(new_a) - 1, np.cumsum(new_s) - 1
        least_s = d[np.flatnonzero(new_s)]  # documents rise within a stretch
        least_a = np.minimum.reduceat(d, np.flatnonzero(new_a))
        kinds = np.bincount(of_a[new_s])
        full = d > least_s[of_s]
        several = kinds[of_a] > 1
        crowd = kinds[of_a] > most
        edge, partner = ~full & several & (d > least_a[of_a]), ~full & several & (d == least_a[of_a])
        code[order] = np.select([full, edge & crowd, partner & crowd, edge, partner], [FULL, CROWD_EDGE, CROWD_PARTNER, EDGE, PARTNER], 0)
    at = 0
    for g, n in zip(groups, sizes, strict=True):
        mine = code[at : at + n]
        at += n
        found = np.flatnonzero(mine)
        if len(found):
            yield g, found.astype("<u4").tobytes(), mine[found].tobytes(), bool((mine >= CROWD_EDGE).any())


def _may_share(table: pa.Table, length: int) -> pa.Table:
    """The contexts that may share a string with another one of their anchor.

    Equal strings have their anchor at the same place, with length - GRAM bytes beside it in all. How many of them lie before it
    falls into one of four ranges, and for each range some bytes before and after it must agree. Hashes stand for the bytes
    here: a chance agreement only keeps more.
    """
    rest = length - GRAM
    step = rest // 4 + 1
    contexts = table.column("context").to_pylist()
    sizes = np.array([len(c) for c in contexts], np.int64)
    at = length + np.cumsum(sizes) - sizes + table.column("inside").to_numpy()
    raw = bytes(length) + b"".join(contexts) + bytes(length)
    view = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    anchor = table.column("anchor").to_numpy().astype(np.uint64)
    inside = table.column("inside").to_numpy()
    keep = np.zeros(len(contexts), bool)
    for before in range(0, rest + 1, step):
        after = rest - min(before + step - 1, rest)
        key = words.mix(anchor * _K[0] + np.uint64(before + 1))
        for start, many in ((at - before, before), (at + GRAM, after)):
            for k in range(0, many, 8):
                key = words.mix(key * _K[1] + (view[start + k] & words.KEEP[min(many - k, 8)]))
        mine = np.flatnonzero((inside >= before) & (inside + GRAM + after <= sizes))
        mine = mine[np.argsort(key[mine])]
        equal = key[mine][1:] == key[mine][:-1]
        keep[mine[1:][equal]] = True
        keep[mine[:-1][equal]] = True
    return table.filter(pa.array(keep))


def shared_strings(contexts: list[bytes], docs: np.ndarray, length: int) -> list[int]:
    """For each context a number whose bit k is set if the string at k also stands in a context of a smaller document."""
    raw = b"\0".join([*contexts, b""])
    sizes = np.array([len(c) for c in contexts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(raw, np.uint8).astype(np.int64) + 1
    text[begin + sizes] = 0  # below every byte, also of contexts that hold zeros
    order = suffix_array(text)
    lcp = common_prefixes(raw, order, length)
    of = np.repeat(np.arange(len(contexts)), sizes + 1)
    whole = np.arange(len(raw)) + length <= (begin + sizes)[of]
    # Neighbours with `length` bytes in common are one class; strings that run over a context's end are left out, and never lie
    # between equal ones that do not.
    order = order[whole[order]]
    if not len(order):
        return [0] * len(contexts)
    group = np.cumsum(np.concatenate([[True], lcp[order[1:]] < length])) - 1
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(docs[of[order]], heads)[group]
    hit = order[least < docs[of[order]]]
    out = [0] * len(contexts)
    for c, k in zip(of[hit].tolist(), (hit - begin[of[hit]]).tolist(), strict=True):
        out[c] |= 1 << k
    return out


def remove(docs: DataFrame, length: int = 50, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) and kept_sha256 for every row.

    A byte goes if a string of `length` bytes over it also starts in a document with a smaller doc_id; strings are judged on
    the input. Of rows with equal texts all but those of the smallest id lose everything, or nothing if shorter than
    `length`. Rows of one doc_id take nothing from each other; a null id counts as the largest. Null text counts as empty.
    Texts of any length are taken whole; other columns are not read. No rows give no rows. `kept` is null where all goes.
    """
    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("d"), text.alias("text"))
    key = ["t1", "t2", "n_bytes"]
    rows = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text"), "n_bytes": F.octet_length("text").cast("bigint")})
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    copies = cut(rows.groupBy(*key).agg(F.min("d").alias("least"), F.count("*").alias("_n")).filter("_n > 1").select(*key, "least"))
    marked = rows.join(small(copies, 40), key, "left")
    again = F.coalesce(F.col("d") > F.col("least"), F.lit(False))
    gone = F.col("n_bytes") >= length
    copied = marked.filter(again).select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).cast("bigint").alias("n_removed"),
        F.when(gone, 1).otherwise(0).cast("bigint").alias("n_spans"),
        F.when(~gone, F.col("text").cast("binary")).alias("kept"), F.sha2(F.when(gone, F.lit("")).otherwise(F.col("text")), 256).alias("kept_sha256"),
    )

    buckets = max(8, total // 5_000_000)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, count = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in arrow.slices(batch, "text", 1_500_000):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([place + count], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["g", "data"])
                count += 1

    own = cut(marked.filter(~again).select("d", "doc_id", "text").mapInArrow(arrow.tidy(pack), "g bigint, data binary"))

    def group(data: bytes) -> Group:
        return Group(pa.ipc.open_stream(data).read_all(), length, buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, data in zip(batch.column("g").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if found := list(group(data).requests()):
                    b, a, s, d = zip(*found, strict=True)
                    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([g] * len(b), b, a, s, d), kinds, strict=True)], ["g", "bucket", "anchor", "stretch", "docs"])

    def settle(table: pa.Table) -> pa.Table:
        found = list(_settle(table, crowd))
        g, at, code, many = zip(*found, strict=True) if found else ((), (), (), ())
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
        bucket = [table.column("bucket")[0].as_py()] * len(g)
        arrow.release()
        return pa.table([pa.array(x, t) for x, t in zip((g, bucket, at, code, many), kinds, strict=True)], ["g", "bucket", "at", "code", "crowd"])

    asked = own.mapInArrow(arrow.tidy(ask), "g bigint, bucket bigint, anchor binary, stretch binary, docs binary")
    codes = cut(asked.groupBy("bucket").applyInArrow(settle, "g bigint, bucket bigint, at binary, code binary, crowd boolean"))

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            own = group(left.column("data")[0].as_py())
            code = own.codes(right)
            g = left.column("g")[0].as_py()
            for k in np.flatnonzero(code >= EDGE).tolist():
                i = int(own.one[k])
                doc = int(own.doc[i])
                rows.append((
                    g, k, int(own.anchor[i].astype(np.int64)), int(own.d[doc]), bool(code[k] >= CROWD_EDGE), int(own.inside[i]),
                    own.raw[doc][int(own.first[i]) : int(own.last[i]) + length],
                ))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
        arrow.release()
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["g", "k", "anchor", "d", "crowd", "inside", "context"])

    # Texts are shuffled once, for the two steps that need them beside what the buckets said.
    dealt, crowded = own.repartition("g"), not codes.filter("crowd").isEmpty()
    sent = dealt.groupBy("g").cogroup(codes.groupBy("g")).applyInArrow(contexts, "g bigint, k bigint, anchor bigint, d bigint, crowd boolean, inside int, context binary")
    sent = cut(sent) if crowded else sent

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        kept: list[pa.Table] = []

        def done() -> pa.RecordBatch:
            table = pa.concat_tables(kept)
            kept.clear()
            bits = shared_strings(table.column("context").to_pylist(), table.column("d").to_numpy(), length)
            keep = [i for i, x in enumerate(bits) if x]
            pick = lambda c: pa.array(table.column(c).take(pa.array(keep, pa.int64())).to_pylist(), pa.int64())
            return pa.RecordBatch.from_arrays([pick("g"), pick("k"), pa.array([bits[i] for i in keep], pa.int64())], ["g", "k", "bits"])

        size = 0
        for _, table in arrow.groups(batches, ["anchor"]):
            held.append(table)
            size += table.nbytes
            if size > 2_000_000:
                kept.append(_may_share(pa.concat_tables(held), length))
                held, size = [], 0
                if sum(x.nbytes for x in kept) > 2_000_000:
                    yield done()
        if held:
            kept.append(_may_share(pa.concat_tables(held), length))
        if kept:
            yield done()

    bits = sent.filter("NOT crowd").repartition("anchor").sortWithinPartitions("anchor", "d").mapInArrow(arrow.tidy(arrays), "g bigint, k bigint, bits bigint")
    if crowded:
        bits = bits.unionByName(_crowd(sent.filter("crowd"), length))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for data in left.column("data").to_pylist():
            own = group(data)
            code = own.codes(right)
            mask: dict[int, int] = {}
            for k, b in zip(right.column("k").to_pylist(), right.column("bits").to_pylist(), strict=True):
                if k is not None:
                    mask[k] = mask.get(k, 0) | b
            begin = np.searchsorted(own.doc, np.arange(len(own.raw) + 1))
            stands = own.d[own.doc[own.one]]
            for i, raw in enumerate(own.raw):
                edge = np.zeros(len(raw) + 1, np.int32)
                mine = np.arange(begin[i], begin[i + 1])
                of = own.of[mine]
                full = (code[of] == FULL) | (stands[of] < own.d[i])
                np.add.at(edge, own.first[mine[full]], 1)
                np.add.at(edge, own.last[mine[full]] + length, -1)
                if mask:
                    for j, k in zip(mine[~full].tolist(), of[~full].tolist(), strict=True):
                        b, at = mask.get(k, 0), int(own.first[j])
                        while b:
                            if b & 1:
                                edge[at] += 1
                                edge[at + length] -= 1
                            b, at = b >> 1, at + 1
                gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
                n = int(gone.sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if n else raw
                spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if n else 0
                out.append((own.ids[i], len(raw), n, spans, kept, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        arrow.release()
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    told = codes.select("g", "bucket", "at", "code", none("k", "bigint"), none("bits", "bigint")).unionByName(
        bits.select("g", none("bucket", "bigint"), none("at", "binary"), none("code", "binary"), "k", "bits")
    )
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"
    return dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(finish, schema).unionByName(copied)


def _crowd(sent: DataFrame, length: int) -> DataFrame:
    """The same as bits for anchors with very many different stretches: each string by its hash, as a partial aggregate."""
    at = F.explode(F.sequence(F.lit(0), F.octet_length("context") - length)).alias("at")
    strings = sent.select("g", "k", "d", "context", at).withColumn("s", F.expr(f"substring(context, at + 1, {length})"))
    strings = strings.select("g", "k", "d", "at", F.xxhash64("s").alias("s1"), F.xxhash64(F.lit(7), "s").alias("s2"))
    least = strings.groupBy("s1", "s2").agg(F.min("d").alias("least"))
    hit = strings.join(least, ["s1", "s2"]).filter("least < d")
    return hit.groupBy("g", "k").agg(F.expr("bit_or(shiftleft(1L, at))").alias("bits"))
