"""Language of a text from a bidirectional gated recurrent network over its bytes, trained in numpy.

A text is read in windows of 64 bytes, side by side, so that a long text takes no more steps than many short ones. In each window
two gated recurrent layers run over the bytes, one from each end; both states of a byte give the chances of the languages at that
byte. A text's chances are their mean over the bytes of its letters, over all windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from waymark.llm import arrow

WINDOW = 64
HIDDEN = 8
_PAD = 255  # no byte of UTF-8; it leaves a state as it is
_SHUT = -60.0
_SIDE = 2048  # windows side by side
#: Bytes of letters: ASCII letters and whatever is not ASCII.
_LETTER = np.zeros(256, np.float32)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 255)]] = 1


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (windows, WINDOW) of all texts, the last window of each padded, and the text that each window is of."""
    raws = [t.encode() for t in texts]
    counts = np.array([-(-len(r) // WINDOW) for r in raws], np.int64)
    out = np.full(int(counts.sum()) * WINDOW, _PAD, np.uint8)
    for raw, at in zip(raws, (np.cumsum(counts) - counts) * WINDOW, strict=True):
        out[at : at + len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), counts)


@dataclass
class Layer:
    """A gated recurrent layer: what each byte gives to update, reset and candidate (3H, 256), and what the state gives (3H, H)."""

    own: np.ndarray
    back: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Layer:
        own = rng.normal(0, 0.3, (3 * HIDDEN, 256)).astype(np.float32)
        own[:HIDDEN, _PAD] = _SHUT
        return cls(own, rng.normal(0, 0.3, (3 * HIDDEN, HIDDEN)).astype(np.float32))

    def run(self, steps: np.ndarray, out: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Fill out (steps, H, n) with the states after each step over bytes (steps, n); keep gets what going back needs."""
        n, h = HIDDEN, np.zeros((HIDDEN, steps.shape[1]), np.float32)
        half = np.float32(0.5)
        for t, byte in enumerate(steps):
            a = self.own.take(byte, axis=1, mode="clip")
            u = self.back @ h
            gate = a[: 2 * n]
            gate += u[: 2 * n]
            gate *= half
            np.tanh(gate, out=gate)
            gate *= half
            gate += half
            c = a[2 * n :]
            c += gate[n:] * u[2 * n :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((h, gate, c, u[2 * n :]))
            h = h + gate[:n] * (c - h)
            out[t] = h
        return out

    def learn(self, steps: np.ndarray, keep: list, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of own and back, through time, from those of the states (steps, H, n)."""
        n = HIDDEN
        dh, back = np.zeros_like(wanted[0]), np.zeros_like(self.back)
        given = np.empty((len(steps), 3 * n, steps.shape[1]), np.float32)
        for t in range(len(steps) - 1, -1, -1):
            h, gate, c, u = keep[t]
            z, r = gate[:n], gate[n:]
            dh = dh + wanted[t]
            dc = dh * z * (1 - c * c)
            dz, dr, du = dh * (c - h) * z * (1 - z), dc * u * r * (1 - r), dc * r
            given[t, :n], given[t, n : 2 * n], given[t, 2 * n :] = dz, dr, dc
            d = np.concatenate([dz, dr, du])
            back += d @ h.T
            dh = dh * (1 - z) + self.back.T @ d
        flat = steps.ravel()
        own = np.stack([np.bincount(flat, given[:, k].ravel(), 256) for k in range(3 * n)]).astype(np.float32)
        own[:, _PAD] = 0
        return own, back


@dataclass
class Model:
    """Two layers, one from each end, and what their states (2H) give to each language."""

    langs: list[str]
    ahead: Layer
    behind: Layer
    out: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.ahead.own, self.ahead.back, self.behind.own, self.behind.back, self.out, self.bias]

    def labels(self, rows: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Chances (steps, languages, n) at every byte of windows (n, steps), and both states there (steps, 2H, n)."""
        steps = np.ascontiguousarray(rows.T).astype(np.intp)
        ahead, behind = keep or (None, None)
        states = np.empty((len(steps), 2 * HIDDEN, len(rows)), np.float32)
        self.ahead.run(steps, states[:, :HIDDEN], ahead)
        self.behind.run(steps[::-1], states[::-1, HIDDEN:], behind)
        p = self.out @ states
        p += self.bias[:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p, states

    def chances(self, texts: list[str]) -> np.ndarray:
        """Chances (texts, languages): the mean over bytes of letters; all alike for a text without any."""
        rows, of = windows(texts)
        sums = np.zeros((len(texts), len(self.langs)))
        for start in range(0, len(rows), _SIDE):
            block = rows[start : start + _SIDE]
            weight = _LETTER[block.T]
            each = np.einsum("skn,sn->nk", self.labels(block)[0], weight)
            np.add.at(sums, of[start : start + _SIDE], each)
        total = sums.sum(axis=1, keepdims=True)
        return np.where(total > 0, sums / np.maximum(total, 1e-9), 1 / max(1, len(self.langs)))


def fit(rows: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = 160, batch: int = 512, rate: float = 0.02, seed: int = 7) -> Model:
    """Cross-entropy at every byte of a letter against its window's label, languages weighing alike, by Adam."""
    rng = np.random.default_rng(seed)
    model = Model(langs, Layer.fresh(rng), Layer.fresh(rng), rng.normal(0, 0.3, (len(langs), 2 * HIDDEN)).astype(np.float32), np.zeros(len(langs), np.float32))
    if len(langs) < 2 or not len(rows):
        return model
    share = len(labels) / len(langs) / np.maximum(np.bincount(labels, minlength=len(langs)), 1)
    first, second = ([np.zeros_like(p) for p in model.parts()] for _ in range(2))
    for step in range(1, steps + 1):
        mine = rng.integers(0, len(rows), min(batch, len(rows)))
        keep: tuple[list, list] = ([], [])
        p, states = model.labels(rows[mine], keep)
        weight = _LETTER[rows[mine].T] * share[labels[mine]].astype(np.float32)
        weight /= max(float(weight.sum()), 1e-9)
        p[:, labels[mine], np.arange(len(mine))] -= 1
        p *= weight[:, None, :]
        there = model.out.T @ p
        ordered = np.ascontiguousarray(rows[mine].T)
        ahead = model.ahead.learn(ordered, keep[0], there[:, :HIDDEN])
        behind = model.behind.learn(ordered[::-1], keep[1], there[::-1, HIDDEN:])
        grads = [*ahead, *behind, np.einsum("skn,shn->kh", p, states), p.sum(axis=(0, 2))]
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for x, g, m, v in zip(model.parts(), grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 3, is 1. A null id is not held out, nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_lang: int = 400, each: int = 4, most_langs: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    """Fit on `per_lang` documents of each language that are not held out, the first by a hash of their ids, and of each on `each`
    windows spread over its text. Of languages the `most_langs` commonest are learned.

    Only windows come to the driver: per_lang * each * most_langs * 64 bytes at most. Rows without id, text or language teach
    nothing. Without any the model knows no language.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.xxhash64("doc_id").alias("h"), "lang", "text")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return fit(np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), [])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # Spark keeps only as many before it shuffles
    first = known.filter(F.col("lang").isin(langs)).select("lang", "h").withColumn("k", rank).filter(F.col("k") <= per_lang)
    best = first.groupBy("lang").agg(F.max("h").alias("top"))  # most_langs rows at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch, "text"):
                rows, of = windows(arrow.texts(part, "text"))
                size = np.bincount(of, minlength=part.num_rows)
                begin = np.cumsum(size) - size
                raw = [rows[b + np.unique(np.arange(each) * n // each)].tobytes() if n else b"" for b, n in zip(begin, size, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array(raw, pa.binary())], ["lang", "h", "raw"])

    chosen = known.join(F.broadcast(best), "lang").filter(F.col("h") <= F.col("top")).select("lang", "h", "text")
    found = chosen.mapInArrow(arrow.tidy(extract), "lang string, h bigint, raw binary").orderBy("lang", "h", "raw").limit(2 * per_lang * len(langs)).toArrow()
    number = {x: k for k, x in enumerate(langs)}
    pairs = [(number[x], np.frombuffer(raw, np.uint8).reshape(-1, WINDOW)) for x, raw in zip(found.column("lang").to_pylist(), found.column("raw").to_pylist(), strict=True)]
    rows = np.vstack([r for _, r in pairs] or [np.zeros((0, WINDOW), np.uint8)])
    return fit(rows, np.repeat([k for k, _ in pairs], [len(r) for _, r in pairs]).astype(np.int64), langs, **options)



def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; of docs only id and text are read, and only the text enters a prediction.

    Texts of any length are read whole. lang_pred is the likeliest language, of ties the first by name, and score its chance;
    `und` and 0 for null texts, for texts without a letter, and if the model knows no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    read = docs.select(F.col(id_col).alias("doc_id"), F.when(letter, F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            for part in arrow.slices(batch, "text", 1_000_000):
                texts = arrow.texts(part, "text")
                if found.langs:
                    chances = found.chances(texts)
                    best = chances.argmax(axis=1)
                    told = [(found.langs[k], float(chances[i, k])) if t else ("und", 0.0) for i, (t, k) in enumerate(zip(texts, best.tolist(), strict=True))]
                else:
                    told = [("und", 0.0)] * len(texts)
                names, scores = zip(*told, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType
    schema = StructType([StructField("doc_id", kind), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return read.mapInArrow(arrow.tidy(run), schema).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
