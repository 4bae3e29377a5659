"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from waymark.llm import arrow, words

#: Classes of bytes, by which a line's make-up is told.
_KINDS = np.full(256, 9, np.uint8)
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\n\x0b\x0c", b".,;:'\"-()", b"!?", b"|", b"#$%&*@^~")):
    _KINDS[list(_bytes)] = _k
_KINDS[128:] = 8
OWN = 14  # features of a line by itself


LONG = 4_000  # lines from which on a text is worked through in stretches of so many


def own_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of all texts by itself (lines by OWN), where each text's lines begin (one more at the end), and a
    hash of each line's words, 0 if it has none.

    They are shares of byte classes, its length, its words' mean length, the share of words equal to the word before, and whether
    an equal line stands above it in the text.
    """
    raw, begins = words.join(texts)
    buf = np.frombuffer(raw, np.uint8)
    breaks = buf == 10
    line = np.cumsum(breaks, dtype=np.int64) - breaks  # a newline belongs to the line it ends
    n = int(breaks.sum())
    counts = np.bincount(line * 10 + _KINDS[buf], minlength=10 * n).reshape(n, 10).astype(np.float64)
    counts[:, 3] -= 1  # the newline
    size = counts.sum(axis=1)
    starts, ends = words.find(raw)
    hashed = words.hashes(raw, starts, ends)
    of = line[starts]
    again = np.zeros(len(of))
    again[1:] = (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])
    number = np.bincount(of, minlength=n).astype(np.float64)
    repeated = np.bincount(of, again, n) / np.maximum(number - 1, 1)
    first = np.concatenate([[0], np.cumsum(number.astype(np.int64))])
    key = np.zeros(n, np.uint64)
    full = number > 0
    if len(of):
        place = (np.arange(len(of)) - first[of]).astype(np.uint64)
        key[full] = np.add.reduceat(words.mix(hashed + place * np.uint64(0x9E3779B97F4A7C15)), first[:-1][full])
    bounds = np.searchsorted(np.flatnonzero(breaks), begins[1:] - 1) + 1
    bounds = np.concatenate([[0], bounds])
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    copy = np.zeros(n)
    order = np.lexsort((np.arange(n), key, doc))
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1]) & full[order][1:]
    copy[order[1:][same]] = 1
    own = np.column_stack([
        counts / np.maximum(size, 1)[:, None], np.log1p(size) / 5, np.minimum(size / np.maximum(number, 1), 40) / 10, repeated, copy
    ])
    return own, bounds, np.where(full, np.maximum(key, np.uint64(1)), np.uint64(0))


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line of all texts (lines by 3 * OWN + 2), its own and beside them those of the lines before and after,
    and where each text's lines begin (one more at the end)."""
    own, bounds, _ = own_features(texts)
    n = len(own)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    opens, closes = bounds[:-1], bounds[1:] - 1
    before[opens], after[closes] = 0, 0
    edge = np.zeros((n, 2))
    edge[opens, 0], edge[closes, 1] = 1, 1
    return np.hstack([own, before, after, edge]), bounds


def stretches(text: str) -> Iterator[np.ndarray]:
    """Own features of a long text's lines, LONG lines at a time, as own_features gives them for the whole text."""
    raw = text.encode()
    ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), len(raw))
    seen = np.zeros(0, np.uint64)
    for first in range(0, len(ends), LONG):
        start = int(ends[first - 1]) + 1 if first else 0
        own, _, key = own_features([raw[start : int(ends[min(first + LONG, len(ends)) - 1])].decode()])
        known = np.searchsorted(seen, key)
        own[(key > 0) & (known < len(seen)) & (seen[np.minimum(known, max(len(seen) - 1, 0))] == key if len(seen) else False), -1] = 1
        seen = np.union1d(seen, key[key > 0])
        yield own


@dataclass
class Model:
    """Weights of a field with the labels bad (0) and good (1), and of the step from a document's mean to its score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # log-odds of good for a line
    bias: float
    move: np.ndarray  # log potentials of neighbouring labels
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, features: np.ndarray) -> np.ndarray:
        return (features - self.mean) / self.scale @ self.weights + self.bias

    def pass_on(self, odds: np.ndarray, move: np.ndarray) -> np.ndarray:
        """Log-odds that a line's neighbour gets from its own."""
        return np.logaddexp(odds + move[1, 1], move[0, 1]) - np.logaddexp(odds + move[1, 0], move[0, 0])

    def chains(self, odds: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log-odds of each line, all texts side by side: forward includes the line's own."""
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        begin, length = bounds[:-1][order], sizes[order]
        forward, backward = odds.copy(), np.zeros_like(odds)
        live = len(order)
        for t in range(1, int(length[0]) if len(length) else 0):
            while live and length[live - 1] <= t:
                live -= 1
            at = begin[:live] + t
            forward[at] += self.pass_on(forward[at - 1], self.move)
            at = begin[:live] + length[:live] - 1 - t
            backward[at] = self.pass_on(odds[at + 1] + backward[at + 1], self.move.T)
        return forward, backward

    def long_odds(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds and lengths of a long text's lines; features of one stretch at a time are held."""
        odds, sizes, last, held = [], [], np.zeros(OWN), None

        def take(own: np.ndarray, after: np.ndarray, opens: bool, closes: bool) -> None:
            edge = np.zeros((len(own), 2))
            edge[0, 0], edge[-1, 1] = opens, closes
            odds.append(self.odds(np.hstack([own, np.vstack([last, own[:-1]]), np.vstack([own[1:], after]), edge])))
            sizes.append(np.expm1(own[:, 10] * 5) + 1)

        for own in stretches(text):
            if held is not None:
                take(held, own[0], not odds, False)
                last = held[-1]
            held = own
        take(held, np.zeros(OWN), not odds, True)
        return np.concatenate(odds), np.concatenate(sizes)

    def long_score(self, text: str) -> float:
        odds, sizes = self.long_odds(text)
        both = _scan(odds, self.move) + _scan(odds[::-1], self.move.T)[::-1] - odds
        return float((_sigmoid(both) * sizes).sum() / sizes.sum())

    def marginals(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        forward, backward = self.chains(self.odds(features), bounds)
        return _sigmoid(forward + backward)

    def scores(self, texts: list[str]) -> np.ndarray:
        """A text's mean of the lines' chances of being good, weighted by their length, brought to a probability."""
        mean = np.zeros(len(texts))
        long = np.array([t.count("\n") >= LONG for t in texts], bool)
        if (short := [t for t, far in zip(texts, long, strict=True) if not far]):
            features, bounds = line_features(short)
            mean[~long] = _weighted(self.marginals(features, bounds), features, bounds)
        for k in np.flatnonzero(long):
            mean[k] = self.long_score(texts[k])
        return self.calibrate(mean)

    def calibrate(self, mean: np.ndarray) -> np.ndarray:
        p = np.clip(mean, 1e-6, 1 - 1e-6)
        return _sigmoid(self.slope * np.log(p / (1 - p)) + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _scan(odds: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Forward log-odds of one long chain. A step multiplies the chances of both labels by a 2 by 2 matrix; the products of blocks
    of steps are made side by side, then joined one after another, then each block runs from where the one before ended."""
    size = max(1, int(len(odds) ** 0.5))
    blocks = -(-len(odds) // size)
    steps = np.zeros(blocks * size)
    steps[: len(odds)] = np.clip(odds, -300, 300)
    steps = steps.reshape(blocks, size)
    good, bad = np.exp(np.minimum(steps, 0)), np.exp(-np.maximum(steps, 0))  # a step's factors, the larger of them 1
    factor = np.exp(move - move.max())

    def step(g: np.ndarray, b: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        new_g, new_b = good[:, t] * (g * factor[1, 1] + b * factor[0, 1]), bad[:, t] * (g * factor[1, 0] + b * factor[0, 0])
        return new_g, new_b

    g, b = np.array([[1.0], [0.0]]).repeat(blocks, 1), np.array([[0.0], [1.0]]).repeat(blocks, 1)  # from either label alone
    for t in range(size):
        g, b = step(g, b, t)
        top = np.maximum(np.maximum(g, b).max(axis=0), 1e-300)
        g, b = g / top, b / top
    starts, state = np.empty((2, blocks)), None
    for k in range(blocks):
        starts[:, k] = (np.nan, np.nan) if state is None else state
        if state is None:  # the first block begins without a line before it
            x = np.array([good[0, 0], bad[0, 0]])
            for t in range(1, size):
                x = np.array([good[0, t] * (x[0] * factor[1, 1] + x[1] * factor[0, 1]), bad[0, t] * (x[0] * factor[1, 0] + x[1] * factor[0, 0])])
                x /= x.sum()
            state = x
        else:
            state = np.array([state @ g[:, k], state @ b[:, k]])
        state = state / max(state.sum(), 1e-300)
    out = np.empty((blocks, size))
    g, b = starts[0].copy(), starts[1].copy()
    for t in range(size):
        g, b = step(g, b, t)
        if not t:
            g[0], b[0] = good[0, 0], bad[0, 0]
        total = np.maximum(g + b, 1e-300)
        g, b = g / total, b / total
        out[:, t] = np.log(np.maximum(g, 1e-300)) - np.log(np.maximum(b, 1e-300))
    return out.ravel()[: len(odds)]


def _weighted(good: np.ndarray, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    length = np.expm1(features[:, 10] * 5) + 1
    return np.add.reduceat(good * length, bounds[:-1]) / np.add.reduceat(length, bounds[:-1])


def fit(features: list[np.ndarray], labels: np.ndarray, steps: int = 120, ridge: float = 1e-3) -> Model:
    """Maximum likelihood with a ridge, every line of a document bearing the document's label. Both labels weigh the same."""
    width = 3 * OWN + 2
    if not features or len(set(labels.tolist())) < 2:
        score = 2.0 if features and labels.all() else -2.0 if features else 0.0
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)), 0.0, score)
    x = np.vstack(features)
    bounds = np.concatenate([[0], np.cumsum([len(f) for f in features])])
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-3, np.zeros(width), 0.0, np.zeros((2, 2)))
    doc = np.repeat(np.arange(len(features)), np.diff(bounds))
    y = labels[doc].astype(float)
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))[doc] / np.sqrt(np.diff(bounds)[doc])
    weight /= weight.sum()
    z = (x - model.mean) / model.scale
    inner = np.ones(len(x), bool)
    inner[bounds[:-1]] = False  # lines with a line above
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), weight[at])
    params = np.zeros(width + 5)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        model.weights, model.bias, model.move = params[:width], params[width], params[width + 1 :].reshape(2, 2)
        odds = z @ model.weights + model.bias
        forward, backward = model.chains(odds, bounds)
        miss = weight * (y - _sigmoid(forward + backward))
        # Chances of the two labels at both ends of a step, up to a factor that the sum takes out.
        ahead = odds[at] + backward[at]
        joint = np.stack([forward[at - 1] * a + ahead * b + model.move[a, b] for a in (0, 1) for b in (0, 1)])
        joint = np.exp(joint - joint.max(axis=0))
        joint /= joint.sum(axis=0)
        expected = (joint * weight[at]).sum(axis=1).reshape(2, 2)
        grad = np.concatenate([z.T @ miss, [miss.sum()], (seen - expected).ravel()]) - ridge * params
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        params = params + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights, model.bias, model.move = params[:width], float(params[width]), params[width + 1 :].reshape(2, 2)
    mean = np.clip(_weighted(model.marginals(x, bounds), x, bounds), 1e-6, 1 - 1e-6)
    logit = np.log(mean / (1 - mean))
    model.slope, model.shift = _line(logit, labels)
    return model


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a one-input logistic fit, by Newton's method with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(25):
        p = _sigmoid(a * x + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * x).sum() - 0.1 * a, (y - p).sum() - 0.1 * b])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + step[0], b + step[1]
    return float(max(a, 0.05)), float(b)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _stretch(features: np.ndarray, lines: int) -> np.ndarray:
    """At most `lines` neighbouring lines of a document; where they begin depends on the document alone."""
    if len(features) <= lines:
        return features
    start = zlib.crc32(features.astype("<f4").tobytes()) % (len(features) - lines + 1)
    return features[start : start + lines]


def train(docs: DataFrame, labels: DataFrame, rows: int = 3000, lines: int = 200, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most `rows` labelled documents that are not held out, the first by a hash of their ids, and of each on at most
    `lines` neighbouring lines, whose features are those of the whole text.

    Only features come to the driver, never texts: rows * lines * 176 bytes at most. Of rows that share an id the first by their
    features count, so that a task that runs again gives the same. Labels that are null do not count; without labelled rows
    every score is 0.5. Null texts count as empty.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = F.coalesce(F.col(text_col), F.lit(""))
    sample = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    sample = sample.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("h"), "quality", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch, "text", 500_000):
                features, bounds = line_features(arrow.texts(part, "text"))
                raw = [_stretch(features[a:b], lines).astype("<f4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("quality").cast(pa.int32()), pa.array(raw, pa.binary())], ["h", "quality", "features"])

    # In a fixed order, for sums of floats depend on it; repeated ids may give more rows than were chosen.
    found = sample.mapInArrow(arrow.tidy(extract), "h bigint, quality int, features binary").orderBy("h", "quality", "features").limit(rows).toArrow()
    pairs = sorted(zip(found.column("quality").to_pylist(), found.column("features").to_pylist(), strict=True))
    x = [np.frombuffer(f, "<f4").reshape(-1, 3 * OWN + 2).astype(np.float64) for _, f in pairs]
    return fit(x, np.array([int(q) for q, _ in pairs]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row. A null text counts as empty: one empty line. Texts of any length are
    scored whole, repeated rows alike; only id and text are read, and of them only the text enters the score."""
    return with_score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"),
    )


def keep(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows with a score of at least `threshold`, with the columns of docs, whatever their names."""
    name = arrow.unused("_score", docs.columns)
    return with_score(docs, model, text_col, name).filter(F.col(name) >= threshold).drop(name)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs, all columns kept, with the score beside them; no column may have that name yet. Null texts count as empty, repeated
    and null ids do not matter, and texts of any length are scored whole. No rows give no rows."""
    if name.lower() in map(str.lower, docs.columns):
        raise ValueError(f"there is a column {name} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch, text_col, 500_000):
                scores = pa.array(shared.value.scores(arrow.texts(part, text_col)), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*columns, name])

    schema = StructType([*(StructField(f.name, f.dataType) for f in docs.schema.fields), StructField(name, DoubleType())])
    return arrow.over(docs, run, schema)
