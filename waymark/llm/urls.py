"""URL filters: glob rules as one bit-parallel automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import arrow


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and the start of a path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"?*.{self.host}{self.path}*"


RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Globs for urls that no rule fits, over `.host` and path: any of them blocks.
BLOCK_GLOBS = ("*.spam*", "*-farm.*", "*.cheap-*", "*casino*", "*-pills.*", "*/ads/*", "*/tracker/*", "*.click/*")


class Automaton:
    """All patterns at once: state bit k of a url is set when the first k tokens of its pattern fit what has been read.

    `*` loops on any byte, `?*` (only at the start) on any byte but `/`, so it stays in the host; a single `?` is any byte.
    Patterns lie one after another in 64-bit words; a shift carries from word to word, and the first bit of a pattern is set
    anew from the state's own start bit only.
    """

    def __init__(self, patterns: list[str]):
        tokens: list[list[tuple[int | None, np.ndarray | None]]] = []
        everything, host = np.ones(256, bool), np.ones(256, bool)
        host[ord("/")] = False
        for pattern in patterns:
            raw, out, loop = pattern.encode(), [], None
            i = 0
            while i < len(raw):
                if raw[i : i + 2] == b"?*" and not out:
                    loop, i = host, i + 2
                elif raw[i : i + 1] == b"*":
                    loop, i = everything, i + 1
                else:
                    out.append((None if raw[i : i + 1] == b"?" else raw[i], loop))
                    loop, i = None, i + 1
            out.append((-1, loop))  # what loops once all is read
            tokens.append(out)
        bits = sum(len(t) for t in tokens)
        self.words = max(1, -(-bits // 64))
        step, stay = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.start, self.ends = np.zeros(self.words, np.uint64), []
        k = 0
        for out in tokens:
            for j, (byte, loop) in enumerate(out):
                word, bit = k // 64, np.uint64(1 << (k % 64))
                if j == 0:
                    self.start[word] |= bit
                if loop is not None:
                    stay[loop, word] |= bit
                if byte == -1:
                    self.ends.append((word, bit))
                else:  # reading this byte moves bit k to bit k + 1
                    step[:, word] |= np.where(np.full(256, byte is None) | (np.arange(256) == byte), bit, np.uint64(0))
                k += 1
        self.step, self.stay = step, stay

    def match(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text, a column for each pattern. Texts go through together, byte by byte; ended ones drop out."""
        n = len(texts)
        out = np.zeros((n, len(self.ends)), bool)
        if not n:
            return out
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        state = np.tile(self.start, (n, 1))
        live = n
        longest = lengths[order]
        for i in range(int(longest[0]) if n else 0):
            while live and longest[live - 1] <= i:
                live -= 1
            byte = data[starts[:live] + i]
            now = state[:live]
            moved = now & self.step[byte]
            shifted = moved << np.uint64(1)
            shifted[:, 1:] |= moved[:, :-1] >> np.uint64(63)
            state[:live] = shifted | (now & self.stay[byte])
        for j, (word, bit) in enumerate(self.ends):
            out[order, j] = state[:, word] & bit != 0
        return out


def parts(url) -> tuple:
    """Host (A-Z lower-cased) and path of a url column: between the first `://` and the first `/`, `?` or `#`, and from there up to `?` or `#`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://(.*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return host, path


def judge(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, globs: tuple[str, ...] = BLOCK_GLOBS, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict of every url. Of the rules that fit, the longest name wins (of equal ones the first
    given); where none fits, a url is blocked if a glob fits and else allowed.

    Null, empty and odd urls have an empty host and path, fit no rule and are allowed unless a glob fits. Repeated rows are
    judged each. Only id and url are read.
    """
    kind = dict(pages.dtypes)[id_col]
    ranked = sorted(rules, key=lambda r: -len(r.name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([r.glob for r in ranked] + list(globs))
        for batch in batches:
            for part in arrow.slices(batch, "canonical", 4_000_000):
                hits = automaton.match([t.encode() for t in arrow.texts(part, "canonical")])
                own, other = hits[:, : len(ranked)], hits[:, len(ranked) :].any(axis=1)
                first = np.where(own.any(axis=1), own.argmax(axis=1) if ranked else 0, -1)
                rule = [ranked[k].name if k >= 0 else None for k in first]
                verdict = [ranked[k].verdict if k >= 0 else ("block" if o else "allow") for k, o in zip(first, other, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("page_id", "host", "path")), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                    ["page_id", "host", "path", "rule", "verdict"],
                )

    host, path = parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("canonical", F.concat(F.lit("."), "host", "path"))
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
