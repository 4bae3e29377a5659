"""BPE encoding and decoding with content-defined chunks that documents share."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from waymark.llm import arrow, tokens

WINDOW = 16
_PART = ["doc_id", "text", "row", "part", "last"]
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: A character that is surely no white space, and a space or newline after it: between them pre-tokens part whatever stands around.
#: White space beyond ASCII begins with the bytes C2, E1, E2, or is E3 80 80.
_SURE = re.compile(rb"(?:[!-~]|[\xC3-\xDF][\x80-\xBF]|(?:[\xE0\xE4-\xEF][\x80-\xBF]|\xE3[\x81-\xBF])[\x80-\xBF]|\xE3\x80[\x81-\xBF]|[\xF0-\xF7][\x80-\xBF]{3})[ \n]")


def cut_points(raw: bytes, mean: int = 1024) -> list[int]:
    """Ends of the chunks of a text's bytes: where a hash of the 16 bytes before falls below a bound, at least a quarter and
    at most eight times `mean` apart, and never inside a character."""
    n, low, high = len(raw), mean // 4, mean * 8
    found: list[int] = []
    if n > low + WINDOW:
        buf = np.frombuffer(raw, np.uint8)
        at = lambda k: np.ndarray((n - WINDOW + 1,), "<u8", raw, k, (1,))
        hashed = at(0) * _MIX[0] + at(8) * _MIX[1]
        hashed ^= hashed >> np.uint64(29)
        hashed *= _MIX[0]
        ends = np.flatnonzero(hashed < np.uint64(2**64 // mean)) + WINDOW
        found = ends[(ends < n)].tolist()
        found = [e for e in found if buf[e] & 0xC0 != 0x80]
    out, last = [], 0
    for end in [*found, n]:
        if end - last < low and end < n:
            continue
        while end - last > high:
            last += high
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


def split(raw: memoryview | bytes, most: int) -> Iterator[memoryview | bytes]:
    """A text's bytes in parts of `most` bytes or a little more, whose ids in a row are those of the text: they part at sure breaks
    only. Where none comes, a part is as long as it must be."""
    start = 0
    while len(raw) - start > most and (found := _SURE.search(raw, start + most - 1)):
        yield raw[start : found.end() - 1]
        start = found.end() - 1
    yield raw[start:]


def parted(batch: pa.RecordBatch, first: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) with texts of more than `most` bytes in parts, a part a batch: also the row's number from `first` on, the
    part's from 0 on, and whether it is the last."""
    sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
    start = 0
    for end in [*np.flatnonzero(sizes > most).tolist(), batch.num_rows]:
        if end > start:
            n = end - start
            some = [*batch.slice(start, n).columns, pa.array(np.arange(first + start, first + end)), pa.array(np.zeros(n, np.int32)), pa.array(np.ones(n, bool))]
            yield pa.RecordBatch.from_arrays(some, _PART)
        if end < batch.num_rows:
            raw = memoryview(batch.column("text")[end].as_buffer())
            done = 0
            for k, part in enumerate(split(raw, most)):
                done += len(part)
                some = [pa.array([str(part, "utf-8")]), pa.array([first + end]), pa.array([k], pa.int32()), pa.array([done == len(raw)])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(end, 1), *some], _PART)
        start = end + 1


class Joiner:
    """Ids of whole texts from those of their chunks.

    A space or newline after a byte that is printable and no space is a break between pre-tokens whatever stands around it, so
    ids between two such breaks inside a chunk hold in the whole text too. What lies between the last break before a join of
    chunks and the first one after it is encoded anew, together with a flank on either side, out to the next break. If the
    flanks' new ids are those of the chunks, the join is done; if not, it is encoded again from farther out, until they agree.
    """

    def __init__(self, enc: tokens.Encoder):
        self.enc = enc
        self.special = [s.encode() for s in enc.special]
        self.mended = self.repeated = 0

    def join(self, docs: list[list[int]], chunks: list[np.ndarray], raws: list[bytes]) -> list[np.ndarray]:
        """docs: numbers of each text's chunks in order; chunks and raws: ids and bytes by number."""
        out: list[np.ndarray] = []
        todo: list[tuple] = []  # text, joins' places and its breaks
        for k, parts in enumerate(docs):
            ids = np.concatenate([np.empty(0, "<u4"), *(chunks[c] for c in parts)])
            out.append(ids)
            if len(parts) < 2:
                continue
            raw = b"".join(raws[c] for c in parts)
            if any(s in raw for s in self.special):
                out[k] = np.frombuffer(self.enc.whole(raw.decode()), "<u4")
                continue
            ends = np.cumsum(self.enc.lengths[ids])
            sure = self._breaks(raw)
            sure = np.concatenate([[0], sure[np.isin(sure, ends, assume_unique=True)], [len(raw)]])
            at = np.cumsum([len(raws[c]) for c in parts])[:-1]
            left, right = np.searchsorted(sure, at, "left") - 1, np.searchsorted(sure, at, "right")
            inside = right - left == 1  # else a break lies just there, and nothing can have changed
            if inside.any():
                todo.append((k, raw, ends, sure, [(a, a, b, b) for a, b in zip(left[inside].tolist(), right[inside].tolist(), strict=True)]))
        reach = 1
        while todo:
            todo = self._round(out, todo, reach)
            reach *= 2
        return out

    @staticmethod
    def _breaks(raw: bytes) -> np.ndarray:
        buf = np.frombuffer(raw, np.uint8)
        before = buf[:-1]
        return np.flatnonzero(((buf[1:] == 32) | (buf[1:] == 10)) & (before > 32) & (before < 127)) + 1

    def _round(self, out: list[np.ndarray], todo: list[tuple], reach: int) -> list[tuple]:
        """Encode every window with flanks of `reach` breaks; texts with a window whose flanks differ come back, wider."""
        windows: list[str] = []
        for t, (k, raw, ends, sure, spans) in enumerate(todo):
            wide: list[tuple] = []  # breaks by number: flank, window, window's end, flank's end
            for _, a, b, _ in spans:
                lo, hi = max(a - reach, 0), min(b + reach, len(sure) - 1)
                if wide and lo <= wide[-1][3]:
                    lo, a = wide[-1][:2]
                    wide.pop()
                wide.append((lo, a, b, hi))
            todo[t] = (k, raw, ends, sure, wide)
            windows += [raw[sure[lo] : sure[hi]].decode() for lo, _, _, hi in wide]
        fresh = iter(self.enc.encode_many(windows))
        again = []
        for k, raw, ends, sure, wide in todo:
            old = out[k]
            parts, done, differ = [], 0, False
            for lo, a, b, hi in wide:
                new = np.frombuffer(next(fresh), "<u4")
                i, j, m, n = (0 if x == 0 else int(np.searchsorted(ends, x)) + 1 for x in sure[[lo, a, b, hi]].tolist())
                if len(new) < (j - i) + (n - m) or (new[: j - i] != old[i:j]).any() or (new[len(new) - (n - m) :] != old[m:n]).any():
                    differ = not (lo == 0 and hi == len(sure) - 1)  # a window over the whole text needs no agreement
                    i, n = (0, len(old)) if not differ else (i, n)
                parts += [old[done:i], new]
                done = n
                self.mended += 1
            if differ:
                self.repeated += 1
                again.append((k, raw, ends, sure, [(lo, lo, hi, hi) for lo, _, _, hi in wide]))
            else:
                out[k] = np.concatenate([*parts, old[done:]])
        return again


def _rows(rows: list[tuple], names: str, kinds: list) -> pa.Table:
    return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names.split())


class Slice:
    """Some texts with their ids, sent as one compressed row, and their distinct chunks by number."""

    def __init__(self, data: bytes, mean: int):
        table = pa.ipc.open_stream(data).read_all()
        self.rows, known = table.drop_columns(["text"]), {}
        self.order = []
        for text in table.column("text").to_pylist():
            raw = (text or "").encode()
            ends = cut_points(raw, mean)
            self.order.append([known.setdefault(raw[a:b], len(known)) for a, b in zip([0, *ends], ends)])  # noqa: B905
        self.chunks: list[bytes] = list(known)

    @staticmethod
    def data(part: pa.RecordBatch) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(part)
        return sink.getvalue().to_pybytes()

    def keys(self) -> np.ndarray:
        """Two numbers a chunk, by which it is known elsewhere."""
        raw = b"".join(hashlib.blake2b(c, digest_size=16).digest() for c in self.chunks)
        return np.frombuffer(raw, "<u8").reshape(-1, 2)


def _number(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of two numbers each: the first place of each different one, and which of them every row is."""
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    ordered = rows[order]
    fresh = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])[: len(rows)]
    of = np.empty(len(rows), np.int64)
    of[order] = np.cumsum(fresh) - 1
    return order[fresh], of


def _assembled(
    docs: DataFrame, model: str, ranks: str, mean: int, chunk_bytes: int, group_bytes: int, part_bytes: int, finish: Callable, join: Callable, schema: str
) -> DataFrame:
    """Ids of all texts (doc_id, text) to `finish`, each chunk that several slices of texts have encoded in one of them only.

    Texts of more than part_bytes go in parts, rows of their own on the whole way. `finish` makes a table of parts (row, part, last
    and what `schema` names), and `join` takes them, in the order of the text, from stream to stream, where any text has more than
    one. Texts are shuffled once, in compressed slices of about 4 MB. A slice sends 16 bytes for each of its chunks to the bucket of
    that hash; where slices meet, the first one is to encode the chunk, and its ids go by way of the bucket to the others. What no
    other slice has is encoded in its place. However many texts hold a chunk, a bucket hears of it once a slice, and so that this
    is bounded too, slices of more than `group_bytes` of texts fall into groups with buckets of their own.
    """
    size = F.octet_length("text")
    total, longest = (x or 0 for x in docs.agg(F.sum(size), F.max(size)).first())
    groups = 1 + total // group_bytes
    each = max(8, total // groups // chunk_bytes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, count, rows = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for some in parted(batch, place + rows, part_bytes):
                for part in arrow.slices(some, "text", 4_000_000):
                    yield pa.RecordBatch.from_arrays([pa.array([place + count], pa.int64()), pa.array([Slice.data(part)], pa.binary())], ["slice", "data"])
                    count += 1
            rows += batch.num_rows

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch.column("slice").to_pylist(), batch.column("data").to_pylist(), strict=True):
                keys = Slice(data, mean).keys()
                bucket = ((keys[:, 0] >> np.uint64(32)) * np.uint64(each) >> np.uint64(32)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[by], np.arange(each + 1)).tolist()
                rows = [
                    (where % groups * each + b, where, by[i:j].astype("<i4").tobytes(), keys[by[i:j]].tobytes())
                    for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i
                ]
                if rows:
                    yield from _rows(rows, "bucket slice at keys", [pa.int64(), pa.int64(), pa.binary(), pa.binary()]).to_batches()

    def settle(table: pa.Table) -> pa.Table:
        """Which of its chunks each slice shares with another, and which of them it is to encode."""
        asked = sorted(zip(*(table.column(c).to_pylist() for c in ("slice", "at", "keys")), strict=True))
        keys = np.frombuffer(b"".join(r[2] for r in asked), "<u8").reshape(-1, 2)
        head, of = _number(keys)
        shared = np.bincount(of)[of] > 1
        first = np.zeros(len(keys), bool)
        first[head] = True
        rows, done = [], 0
        for where, at, raw in asked:
            mine = slice(done, done + len(at) // 4)
            done = mine.stop
            keep = shared[mine]
            if keep.any():
                own = first[mine][keep]
                rows.append((table.column("bucket")[0].as_py(), where, np.frombuffer(at, "<i4")[keep].tobytes(), keys[mine][keep].tobytes(), own.tobytes()))
        arrow.release()
        return _rows(rows, "bucket slice at keys own", [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])

    def encode_own(texts: pa.Table, told: pa.Table) -> pa.Table:
        enc, rows = tokens.encoder(model, ranks), []
        if texts.num_rows and told.num_rows:
            known = Slice(texts.column("data")[0].as_py(), mean).chunks
            for bucket, at, keys, own in zip(*(told.column(c).to_pylist() for c in ("bucket", "at", "keys", "own")), strict=True):
                own = np.frombuffer(own, bool)
                if own.any():
                    ids = enc.encode_many([known[c].decode() for c in np.frombuffer(at, "<i4")[own].tolist()])
                    sizes = np.array([len(x) // 4 for x in ids], "<i4").tobytes()
                    rows.append((bucket, np.frombuffer(keys, "<u8").reshape(-1, 2)[own].tobytes(), sizes, b"".join(ids)))
        arrow.release()
        return _rows(rows, "bucket keys sizes ids", [pa.int64(), pa.binary(), pa.binary(), pa.binary()])

    def deliver(table: pa.Table) -> pa.Table:
        """Ids of a bucket's shared chunks to all slices that have them."""
        rows = list(zip(*(table.column(c).to_pylist() for c in ("slice", "at", "keys", "sizes", "ids")), strict=True))
        done, wanted = [r for r in rows if r[4] is not None], [r for r in rows if r[4] is None]
        keys = np.frombuffer(b"".join(r[2] for r in [*done, *wanted]), "<u8").reshape(-1, 2)
        sizes = np.frombuffer(b"".join(r[3] for r in done), "<i4")
        ids = np.split(np.frombuffer(b"".join(r[4] for r in done), "<u4"), np.cumsum(sizes)[:-1]) if len(sizes) else []
        _, of = _number(keys)
        source = np.empty(len(keys), np.int64)
        source[of[: len(sizes)]] = np.arange(len(sizes))
        out, at = [], len(sizes)
        for where, place, raw, _, _ in wanted:
            mine = [ids[k] for k in source[of[at : at + len(place) // 4]].tolist()]
            at += len(place) // 4
            out.append((where, place, np.array([len(x) for x in mine], "<i4").tobytes(), np.concatenate(mine).tobytes()))
        arrow.release()
        return _rows(out, "slice at sizes ids", [pa.int64(), pa.binary(), pa.binary(), pa.binary()])

    def assemble(texts: pa.Table, told: pa.Table) -> pa.Table:
        enc, out = tokens.encoder(model, ranks), []
        for data in texts.column("data").to_pylist():
            own = Slice(data, mean)
            ids: list = [None] * len(own.chunks)
            for at, sizes, raw in zip(*(told.column(c).to_pylist() for c in ("at", "sizes", "ids")), strict=True):
                parts = np.split(np.frombuffer(raw, "<u4"), np.cumsum(np.frombuffer(sizes, "<i4"))[:-1])
                for k, x in zip(np.frombuffer(at, "<i4").tolist(), parts, strict=True):
                    ids[k] = x
            left = [k for k, x in enumerate(ids) if x is None]
            for k, x in zip(left, enc.encode_many([own.chunks[k].decode() for k in left]), strict=True):
                ids[k] = np.frombuffer(x, "<u4")
            out.append(finish(enc, own.rows, Joiner(enc).join(own.order, ids, own.chunks)))
        arrow.release()
        return pa.concat_tables(out) if out else finish(enc, nothing, [])

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    nothing = pa.schema([("doc_id", id_type), ("row", pa.int64()), ("part", pa.int32()), ("last", pa.bool_())]).empty_table()
    slices = docs.mapInArrow(arrow.tidy(pack), "slice bigint, data binary").repartition("slice")
    asked = slices.mapInArrow(arrow.tidy(ask), "bucket bigint, slice bigint, at binary, keys binary")
    told = asked.groupBy("bucket").applyInArrow(settle, "bucket bigint, slice bigint, at binary, keys binary, own binary")
    own = slices.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(encode_own, "bucket bigint, keys binary, sizes binary, ids binary")
    met = told.drop("own").unionByName(own, allowMissingColumns=True)
    sent = met.groupBy("bucket").applyInArrow(deliver, "slice bigint, at binary, sizes binary, ids binary")
    made = slices.groupBy("slice").cogroup(sent.groupBy("slice")).applyInArrow(assemble, f"{schema}, row bigint, part int, last boolean")
    if longest > part_bytes:
        made = made.repartition("row").sortWithinPartitions("row", "part").mapInArrow(arrow.tidy(join), made.schema)
    return made.drop("row", "part", "last")


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    values = np.concatenate([np.empty(0, "<u4"), *ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole texts from parts in order; one that is a text by itself is left as it is."""
    held: list[tuple] = []
    for batch in batches:
        texts = batch.column("text") if "text" in batch.schema.names else None
        ends, done = np.flatnonzero(batch.column("last").to_numpy(zero_copy_only=False)).tolist(), 0
        for end in [*ends, batch.num_rows]:
            for k in range(done, min(end + 1, batch.num_rows)):
                held.append((batch.column("ids")[k].values, None if texts is None else texts[k].as_py()))
            if end < batch.num_rows:
                row = {c: batch.column(c).slice(end, 1) for c in batch.schema.names}
                if len(held) > 1:
                    row["ids"] = _lists([np.concatenate([x.to_numpy() for x, _ in held])])
                    if texts is not None:
                        row["text"] = pa.array(["".join(t for _, t in held)])
                yield pa.RecordBatch.from_pydict(row, batch.schema)
                held = []
            done = end + 1


def encode(
    docs: DataFrame, model: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", mean: int = 1024, decoded: bool = False,
    chunk_bytes: int = 16_000_000, group_bytes: int = 32_000_000_000, part_bytes: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id and ids (array<int>) of every text, as the tokenizers library gives them without special tokens; with `decoded`
    also text, decoded from them as decode() does, in the same step.

    Texts are cut where a rolling hash says so, a chunk is encoded once, wherever its texts lie (once in each `group_bytes` of
    texts), and joins are encoded anew until they agree with the chunks. A text of more than `part_bytes` is worked through in
    parts, between places where pre-tokens part in any case (before a space or newline after another character); only a stretch
    without such a place must go as one. A null text counts as empty and has no ids. Repeated and null ids are texts like
    others, other columns are not read, and no rows give none.
    """
    kind = dict(docs.dtypes)[id_col]

    def finish(enc: tokens.Encoder, rows: pa.Table, ids: list[np.ndarray]) -> pa.Table:
        columns = {"doc_id": rows.column("doc_id"), "ids": _lists(ids)}
        if decoded:
            columns["text"] = pa.array(map(enc.decode, ids), pa.string())
        return pa.table(columns | {c: rows.column(c) for c in ("row", "part", "last")})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, ids array<int>" + ", text string" * decoded
    return _assembled(rows, model, ranks, mean, chunk_bytes, group_bytes, part_bytes, finish, _joined, schema)


class Digest:
    """Count of ids, hash of the decimal ids joined by commas, and hash of the decoded text, part by part."""

    def __init__(self, enc: tokens.Encoder):
        self.enc, self.n, self.ids, self.text = enc, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray) -> Digest:
        if len(ids):
            said = ",".join(map(_decimals(len(self.enc.bytes)).__getitem__, ids.tolist()))
            self.ids.update(("," + said if self.n else said).encode())
            self.text.update(self.enc.decode(ids).encode())
            self.n += len(ids)
        return self

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


@functools.lru_cache(2)
def _decimals(n: int) -> list[str]:
    return list(map(str, range(n)))


def encoded_digests(
    docs: DataFrame, model: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", mean: int = 1024, chunk_bytes: int = 16_000_000,
    group_bytes: int = 32_000_000_000, part_bytes: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of digests(encode(docs, decoded=True)), made where a text's ids are put together.

    So a text that goes in parts is hashed part by part, and neither its ids nor what they decode to ever stand in one row. Nulls,
    ids and other columns as in `encode`.
    """
    kind = dict(docs.dtypes)[id_col]

    def finish(enc: tokens.Encoder, rows: pa.Table, ids: list[np.ndarray]) -> pa.Table:
        whole = pc.and_(pc.equal(rows.column("part"), 0), rows.column("last")).to_pylist()
        told = [Digest(enc).add(x).row() if w else (0, None, None) for x, w in zip(ids, whole, strict=True)]
        left = pa.array([None if w else x.astype("<u4").tobytes() for x, w in zip(ids, whole, strict=True)], pa.binary())
        made = _rows(told, "n_tokens ids_sha256 decoded_sha256", [pa.int64(), pa.string(), pa.string()])
        made = made.add_column(0, "doc_id", rows.column("doc_id")).append_column("_ids", left)
        for c in ("row", "part", "last"):
            made = made.append_column(c, rows.column(c))
        return made

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, state = tokens.encoder(model, ranks), None
        for batch in batches:
            told: list[tuple] = []
            for n, a, b, ids, last in zip(*(batch.column(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256", "_ids", "last")), strict=True):
                if not ids.is_valid:
                    told.append((n.as_py(), a.as_py(), b.as_py()))
                    continue
                state = (state or Digest(enc)).add(np.frombuffer(ids.as_buffer(), "<u4"))
                if last.as_py():
                    told.append(state.row())
                    state = None
            ends = batch.filter(batch.column("last"))
            made = dict(zip(ends.schema.names, ends.columns, strict=True)) | dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), zip(*told, strict=True), strict=False))
            made["_ids"] = pa.nulls(ends.num_rows, pa.binary())
            yield pa.RecordBatch.from_pydict(made, batch.schema)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, _ids binary"
    return _assembled(rows, model, ranks, mean, chunk_bytes, group_bytes, part_bytes, finish, join, schema).drop("_ids")


def decode(encoded: DataFrame, model: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, ids and text, special tokens kept; bytes that are no UTF-8 become U+FFFD. Null ids give a null text, no ids an empty one."""
    kind = dict(encoded.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(model, ranks)
        for batch in batches:
            text = [None if x is None else enc.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(arrow.tidy(run), f"doc_id {kind}, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256. Null ids and texts count as empty."""
    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>"))
    return decoded.select(
        "doc_id", F.size(ids).cast("bigint").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("decoded_sha256"),
    )


def reuse(docs: DataFrame, mean: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: how many chunks the texts have, how many distinct ones, and their bytes. For reports; a hash stands for a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch, "text"):
                keys, sizes = [], []
                for text in arrow.texts(part, "text"):
                    raw = text.encode()
                    ends = cut_points(raw, mean)
                    keys += [hashlib.blake2b(raw[a:b], digest_size=16).hexdigest() for a, b in zip([0, *ends], ends)]  # noqa: B905
                    sizes += np.diff([0, *ends]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sizes, pa.int64())], ["key", "size"])

    each = docs.select(F.col(text_col).alias("text")).mapInArrow(arrow.tidy(run), "key string, size bigint").groupBy("key").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return each.agg(
        F.sum("n").alias("chunks"), F.count("*").alias("distinct_chunks"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("size").alias("distinct_bytes"),
    )
