"""Best-fit packing of token sequences by large-item matching."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from waymark.llm import arrow, tokens
from waymark.llm.arrow import quoted, unused
from waymark.session import cut, small

PIECES = "doc_id {id}, piece int, start bigint, length bigint, ids binary"


def token_pieces(
    docs: DataFrame, capacity: int = 2048, end_id: int = 0, model: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken",
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian uint32): each document's ids and the end id, cut if longer than capacity.

    Only the first piece may be shorter than capacity. A null or empty text is one piece with the end id alone. Other columns
    are not read; rows with a repeated or null id are documents like any other.
    """
    kind = dict(docs.dtypes)[id_col]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(model, ranks)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in arrow.slices(batch, "text"):
                rows: list[tuple] = []
                for doc, raw in zip(part.column("doc_id").to_pylist(), enc.encode_many(arrow.texts(part, "text")), strict=True):
                    raw += end
                    n = len(raw) // 4
                    first = (n - 1) % capacity + 1
                    at = [0, *range(first, n, capacity), n]
                    rows += [(doc, k, at[k], at[k + 1] - at[k], raw[4 * at[k] : 4 * at[k + 1]]) for k in range(len(at) - 1)]
                columns = list(zip(*rows, strict=True))
                types = [part.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids"]
                )
        enc.forget()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(arrow.tidy(cut_up), PIECES.format(id=kind))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, copies, first sequence, offset) for a histogram of lengths.

    Bins with equal contents are handled as one class, so the work follows the number of distinct lengths and not of
    documents. Lengths above a third of the capacity go at most two to a bin: the longest takes the longest partner that
    fits. Shorter ones, in falling order, go to the bin with the least room that holds them.
    """
    left, used, rows, bins = dict(counts), dict.fromkeys(counts, 0), [], 0
    free: list[tuple[int, int, int]] = []  # room, first sequence, number of bins

    def put(length: int, copies: int, first: int, offset: int) -> None:
        rows.append((length, used[length], copies, first, offset))
        used[length] += copies
        left[length] -= copies

    large = sorted(x for x in counts if 3 * x > capacity)
    while large:
        top = large[-1]
        if not left[top]:
            large.pop()
            continue
        at = bisect_left(large, capacity - top + 1) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        partner = large[at] if at >= 0 else 0
        if partner == top and left[top] == 1:  # itself is the only one of its length: look below
            at -= 1
            while at >= 0 and not left[large[at]]:
                at -= 1
            partner = large[at] if at >= 0 else 0
        n = left[top] if not partner else (left[top] // 2 if partner == top else min(left[top], left[partner]))
        put(top, n, bins, 0)
        if partner:
            put(partner, n, bins, top)
        if capacity - top - partner:
            insort(free, (capacity - top - partner, bins, n))
        bins += n

    for small in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[small]:
            at = bisect_left(free, (small, -1, 0))
            if at == len(free):
                each = capacity // small
                n = max(1, left[small] // each)
                free.append((capacity, bins, n))
                bins += n
                at = len(free) - 1
            room, first, n = free.pop(at)
            each = min(room // small, left[small])
            take = min(n, left[small] // each)
            if take < n:
                insort(free, (room, first + take, n - take))
            for k in range(each):
                put(small, take, first, capacity - room + k * small)
            if room - each * small:
                insort(free, (room - each * small, first, take))
    return rows


def best_fit(items: DataFrame, order: list[str], capacity: int = 2048, length_col: str = "length", slot_rows: int = 1_000) -> DataFrame:
    """items with sequence_id and offset: every row whole in one sequence of at most `capacity`, gapless from 0.

    Every length must lie in 1..capacity. Rows as long as the capacity are sequences by themselves, with numbers below 0, and
    need no plan. Of the others only the histogram, `capacity` rows at most, comes to the driver, and only the plan made of it
    goes back, its size bounded by the capacity too. A row's rank among those of its length is its rank in a slot of that length
    plus the rows of the slots before; a length has a slot for each `slot_rows` of its rows, so that a length that most rows
    share is dealt over as many tasks as it fills. `order` names columns that tell rows apart; rows equal in all of them may
    change places. Columns of items may have any names but the two new ones. No rows give no rows.
    """
    spark, names = items.sparkSession, items.columns
    counts = {r[0]: r[1] for r in items.groupBy(length_col).count().collect()}
    if any(x is None or not 0 < x <= capacity for x in counts):
        raise ValueError("a length lies outside 1..capacity")
    whole = items.filter(F.col(length_col) == capacity).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")}
    )
    counts.pop(capacity, None)
    if not counts:
        return whole
    by_length: dict[int, list[tuple]] = {}
    for length, first, copies, sequence, offset in plan(counts, capacity):
        by_length.setdefault(length, []).append((first, copies, sequence, offset))
    shared = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in by_length.items()})
    slot, number, rank, before = (unused(x, items.columns) for x in ("_slot", "_number", "_rank", "_before"))
    many_kind = StructType([StructField(length_col, items.schema[length_col].dataType), StructField(number, LongType())])
    many = spark.createDataFrame([(x, 1 + n // slot_rows) for x, n in counts.items()], many_kind)
    dealt = items.filter(F.col(length_col) < capacity).join(F.broadcast(many), length_col)  # a row for each length
    dealt = dealt.withColumn(slot, F.pmod(F.xxhash64(*order), number)).select(*map(quoted, items.columns), slot)
    sizes = dealt.groupBy(length_col, slot).count()
    sizes = cut(sizes.select(length_col, slot, (F.sum("count").over(Window.partitionBy(length_col).orderBy(slot)) - F.col("count")).alias(before)))
    inside = F.row_number().over(Window.partitionBy(length_col, slot).orderBy(*order)) - 1
    ranked = dealt.withColumn(rank, inside).join(small(sizes, 24), [length_col, slot]).withColumn(rank, F.col(rank) + F.col(before))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            length = batch.column(length_col).to_numpy(zero_copy_only=False)
            at = batch.column(rank).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                mine = np.flatnonzero(length == value)
                runs = table[int(value)]
                k = np.searchsorted(runs[:, 0], at[mine], "right") - 1
                sequence[mine] = runs[k, 2] + at[mine] - runs[k, 0]
                offset[mine] = runs[k, 3]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    schema = StructType([*(StructField(f.name, f.dataType) for f in items.schema.fields), StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return arrow.over(ranked.select(*map(quoted, names), rank), place, schema).unionByName(whole)


def pack_documents(docs: DataFrame, capacity: int = 2048, **options) -> DataFrame:
    """Token pieces with crc32 instead of ids, each with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece with the end id alone; repeated and null ids are documents like others; of docs only id and
    text are read. No rows give no rows.
    """
    pieces = token_pieces(docs, capacity, **options)
    light = cut(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return best_fit(light, ["doc_id", "piece", "ids_crc32"], capacity)
