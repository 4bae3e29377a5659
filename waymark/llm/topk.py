"""Exact top-k search: a grid of query tiles by groups of shards, partial lists merged as a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm import arrow


def quantise(vector: Column) -> Column:
    """floor(256 x) of every component, as double; null where the vector is null or holds null or non-finite components."""
    infinite = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == infinite))
    # floor() of a double is a bigint in Spark; whole numbers from 2^53 on have no fraction, and multiplying by 256 is exact.
    whole = lambda x: F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: whole(x.cast("double") * 256)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of whole doubles as rows, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


#: Scores beyond 64 bits stand at these bounds until it is known whether they belong to a result.
_LOW, _HIGH = -(2**63) + 1, 2**63 - 1


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows: in doubles where they are exact, in 64-bit integers where no sum can pass them, else, only for rows
    and columns with such values, in whole numbers of any size."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not width:
        return np.zeros((len(a), len(b)), np.int64)
    most_a, most_b = np.abs(a).max(axis=1, initial=0), np.abs(b).max(axis=1, initial=0)
    if most_a.max(initial=0) * most_b.max(initial=0) * width < 2**53:
        return (a @ b.T).astype(np.int64)
    large = most_b * most_a.max(initial=0) * width >= 2**62
    far = most_a * most_b[~large].max(initial=0) * width >= 2**62
    out = np.zeros((len(a), len(b)), np.int64)
    out[np.ix_(~far, ~large)] = a[~far].astype(np.int64) @ b[~large].astype(np.int64).T
    to_int = np.frompyfunc(int, 1, 1)
    for rows, columns in ((far, ~large), (np.ones(len(a), bool), large)):
        if rows.any() and columns.any():
            exact = to_int(a[rows]) @ to_int(b[columns]).T
            out[np.ix_(rows, columns)] = np.clip(exact, _LOW, _HIGH).astype(np.int64)
    return out


def _own(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The place of each query's own row among the candidates, or -1: the first with its id and vector. ids must rise."""
    out = np.full(len(query), -1)
    for i, at in enumerate(np.searchsorted(ids, query).tolist()):
        while at < len(ids) and ids[at] == query[i]:
            if _padded(matrix[at], matrix.shape[1] + vectors.shape[1]) == _padded(vectors[i], matrix.shape[1] + vectors.shape[1]):
                out[i] = at
                break
            at += 1
    return out


def _padded(row: np.ndarray, width: int) -> bytes:
    return (np.pad(row, (0, width - len(row))) + 0.0).tobytes()


def _best(query: np.ndarray, own: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row of a tile, the candidate at `own` left out, ties to the smaller id. ids must rise."""
    mine = np.zeros(scores.shape, bool)
    at = np.flatnonzero(own >= 0)
    mine[at, own[at]] = True
    if k < scores.shape[1]:
        edge = np.partition(np.where(mine, np.iinfo(np.int64).min, scores), scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        keep = (scores >= edge[:, None]) & ~mine  # all ties at the edge, so that the smallest ids can be told
    else:
        keep = ~mine
    row, col = np.nonzero(keep)
    value = scores[row, col]
    order = np.lexsort((col, -value, row))
    row, col, value = row[order], col[order], value[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
    good = rank < k
    return query[row[good]], ids[col[good]], value[good]


#: Vectors of a group at most, in shards: what one task has to multiply with its tile.
_GROUP_SHARDS = 64


def grid(count: int, asked: int, every: int = 50, shard_rows: int = 16384, tile_rows: int = 65536) -> tuple[int, int, int]:
    """Numbers of shards, groups of shards, and tiles of queries, for `count` vectors and `asked` queries."""
    shards, tiles = max(1, -(-count // shard_rows)), max(1, -(-asked // tile_rows))
    return shards, max(-(-shards // _GROUP_SHARDS), min(shards, -(-every // tiles))), tiles


def dealt(rows: DataFrame, every: int, shards: int, groups: int, tiles: int) -> DataFrame:
    """The vectors of each cell of the grid, a group by a tile: every query once a group (shard null), every vector once a tile."""
    spread = F.xxhash64("vec_id")
    shard = F.pmod(spread, F.lit(shards))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("number", F.monotonically_increasing_id())
    # Queries of one id are dealt over all tiles.
    asked = asked.withColumns({"shard": F.lit(None).cast("bigint"), "tile": F.pmod(F.xxhash64("vec_id", "number"), F.lit(tiles))}).withColumn("group", each(groups))
    held = rows.withColumns({"number": F.lit(None).cast("bigint"), "shard": shard}).withColumn("tile", each(tiles)).withColumn("group", F.col("shard") % groups)
    return asked.unionByName(held).withColumn("cell", F.col("group") * tiles + F.col("tile"))


class Tile:
    """The queries of a cell with their best so far; vectors come in blocks with rising ids."""

    def __init__(self, parts: list[pa.RecordBatch], k: int):
        table = pa.Table.from_batches(parts)
        self.k, self.number, self.query = k, table.column("number").to_numpy(), table.column("vec_id").to_numpy()
        self.vectors = _matrix(table.column("v"))
        self.met = np.zeros(len(self.query), bool)  # whether a query's own row has come by
        self.best: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3 for _ in range(0, len(self.query), self.STEP)]

    STEP = 512

    def meet(self, batch: pa.RecordBatch) -> None:
        ids, matrix = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"))
        for n, at in enumerate(range(0, len(self.query), self.STEP)):
            here = slice(at, at + self.STEP)
            part = self.vectors[here]
            own = np.where(self.met[here], -1, _own(self.query[here], part, ids, matrix))
            self.met[here] |= own >= 0
            found = _best(np.arange(len(part)), own, ids, _scores(part, matrix), self.k)
            row, vec, score = (np.concatenate(x) for x in zip(self.best[n], found, strict=True))
            order = np.lexsort((vec, -score, row))
            row, vec, score = row[order], vec[order], score[order]
            good = np.arange(len(row)) - np.searchsorted(row, row, "left") < self.k
            self.best[n] = row[good], vec[good], score[good]

    def lists(self, group: int) -> Iterator[pa.RecordBatch]:
        for n, (row, vec, score) in enumerate(self.best):
            if len(row):
                at = n * self.STEP + row
                columns = [self.number[at], self.query[at], vec, score, np.full(len(at), group)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["number", "query_id", "vec_id", "score", "group"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bool, pa.RecordBatch]]:
    """cell, group, whether these are queries, and rows: what of a batch belongs together, in order."""
    for batch in batches:
        cell, asked = batch.column("cell").to_numpy(), batch.column("number").is_valid().to_numpy(zero_copy_only=False)
        shard = batch.column("shard").fill_null(-1).to_numpy()
        turn = np.flatnonzero((cell[1:] != cell[:-1]) | (shard[1:] != shard[:-1])) + 1
        ends = [0, *turn.tolist(), batch.num_rows]
        for i, j in zip(ends, ends[1:], strict=False):
            if i < j:
                yield int(cell[i]), batch.column("group")[i].as_py(), bool(asked[i]), batch.slice(i, j - i)


def search(
    vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 16384,
    tile_rows: int = 65536, fan_in: int = 16,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products for every row whose id is divisible by `every`.

    A grid of tiles of queries by groups of shards: of n vectors and q queries there are t = q / tile_rows tiles, rounded up, and g
    groups of at most 64 shards (g also makes `every` tasks, where there are as many shards). Each vector is sent t times and each query
    g times, n t + q g rows in all; a task holds its tile, takes the vectors of its group batch by batch, keeps k of them for each query
    as it goes, and so sends k rows for each of its queries, q g k in all. Lists are merged `fan_in` groups at a time.

    Rows with null ids or with vectors that are null or hold null or non-finite components take no part. Of rows that share an id each
    is a candidate, and each a query with a list of its own, in which only its own row has no place; vectors of different lengths are
    compared over what both have. A result with a score that does not fit into 64 bits is an error. No rows give no rows.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), quantise(F.col(vector_col)).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    size = vectors.agg(F.count("*").alias("n"), F.count_if(F.col(id_col).cast("bigint") % every == 0).alias("q")).first()
    shards, groups, tiles = grid(size["n"], size["q"], every, shard_rows, tile_rows)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, waiting, tile = None, 0, [], None
        for cell, its_group, asked, part in _parts(batches):
            if cell != at:
                if tile is not None:
                    yield from tile.lists(group)
                at, group, waiting, tile = cell, its_group, [], None
            if asked:
                waiting.append(part)
                continue
            if tile is None and waiting:
                tile, waiting = Tile(waiting, k), []
            if tile is not None:
                tile.meet(part)
        if tile is not None:
            yield from tile.lists(group)

    both = dealt(rows, every, shards, groups, tiles).repartition(groups * tiles, "cell")
    both = both.sortWithinPartitions("cell", F.asc_nulls_first("shard"), "vec_id", "v", "number")
    lists = both.select("cell", "group", "shard", "number", "vec_id", "v").mapInArrow(arrow.tidy(multiply), "number bigint, query_id bigint, vec_id bigint, score bigint, group bigint")
    order = [F.desc("score"), F.asc("vec_id")]
    while groups > 1:
        groups = -(-groups // fan_in)
        lists = lists.withColumn("group", F.floor(F.col("group") / fan_in))
        top = F.row_number().over(Window.partitionBy("number", "group").orderBy(*order))
        lists = lists.withColumn("_r", top).filter(F.col("_r") <= k).drop("_r")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(*order)).alias("rank")
    fits = F.when((F.col("score") > _LOW) & (F.col("score") < _HIGH), F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit into 64 bits")))
    return lists.select("query_id", rank, "vec_id", "score").filter(F.col("rank") <= k).withColumn("score", fits.cast("bigint"))
