"""Helpers for work on Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def slices(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with at most that many bytes in a string column; a longer text stands alone."""
    sizes = np.zeros(batch.num_rows, np.int64)
    lengths = pc.binary_length(batch.column(column)).fill_null(0)
    sizes[:] = lengths.to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def release() -> None:
    """Give memory that is free by now back to the system: workers live on, and beside them stands the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that releases memory at the end of its task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def unused(name: str, *columns: list[str]) -> str:
    """name, or name with underscores before it so that none of the columns is called that, in any case."""
    taken = {c.lower() for names in columns for c in names}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    """A column's name in back-ticks, as Spark takes it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def over(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """df.mapInArrow for columns of any name: Spark looks them up by plain names, so they have such on the way."""
    names = df.columns
    made = [f"c{k}" for k in range(len(schema.fields))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(b.rename_columns(names) for b in batches):
            yield out.rename_columns(made)

    kind = StructType([StructField(n, f.dataType) for n, f in zip(made, schema.fields, strict=True)])
    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(tidy(renamed), kind).toDF(*(f.name for f in schema.fields))


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """Values of a string column, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys over a stream of batches that is sorted by them."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                if key is not None and rows[start] != key:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = rows[start]
                held.append(batch.slice(start, i - start))
                start = i
    if key is not None:
        yield key, pa.Table.from_batches(held)


def whole_runs(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows from a stream that is sorted by integer keys; no run of equal keys is parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held)
            last = np.ones(table.num_rows, bool)
            for k in keys:
                column = table.column(k).to_numpy()
                last &= column == column[-1]
            start = table.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
            if start:
                yield table.slice(0, start)
                held = table.slice(start).to_batches()
    if held:
        yield pa.Table.from_batches(held)
