"""Exact byte-level BPE ids, with the work on repeated words done once.

A break before white space that follows a non-space is a break between pre-tokens whatever stands around it, so a text
is the sum of its units: a space or newline with the word after it. Units are kept in a bounded cache. Texts with runs of
white space go to the encoder whole.
"""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np

_OTHER_SPACE = re.compile(r"[^\S \n][ \n]")
_ODD = ("\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
#: Letters and digits below this code point are classed alike by every version of Unicode that a library may carry.
_STABLE = 0x250


def file_path(name: str) -> str:
    """A file of the installed public tokenizers, or a path as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode_many(texts): the ids of each as little-endian uint32 bytes.

    `model` is a tokenizers file, `ranks` the same vocabulary as ranks, which encodes faster; ids are the same. Texts with
    a special token's string or with characters beyond the stable range go to the tokenizers library itself.
    """

    def __init__(self, model: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", entries: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(file_path(model))
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(file_path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        special = {i: t for i, t in self.exact.get_added_tokens_decoder().items()}
        self.special = [t.content for t in special.values()]
        size = max([*table.values(), *special]) + 1
        self.bytes = [b""] * size
        for raw, i in table.items():
            self.bytes[i] = raw
        for i, t in special.items():
            self.bytes[i] = t.content.encode()
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.opens = np.array([x[:1] in (b" ", b"\n") for x in self.bytes])
        self.units: dict[str, bytes] = {}
        self.entries = entries

    def whole(self, text: str) -> bytes:
        if any(s in text for s in self.special) or (not text.isascii() and max(text) >= chr(_STABLE)):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def _plain(self, text: str) -> bool:
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(s in text for s in self.special):
            return False
        if text.isascii():
            return not any(c in text for c in _ODD) or not _OTHER_SPACE.search(text)
        return not _OTHER_SPACE.search(text)

    def _learn(self, words: list[str]) -> None:
        """Put the units of these words into the cache, encoding the ordinary ones in one go."""
        text, known = [], []
        for w in words:
            unit = w if w[:1] == "\n" else " " + w
            if unit[-1].isspace() or not (w.isascii() or max(w) < chr(_STABLE)):
                self.units[w] = self.whole(unit)
            else:
                text.append(unit)
                known.append(w)
        if not known:
            return
        ids = np.array(self.fast.encode_ordinary("".join(text)), "<u4")
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(known):
            for w, unit in zip(known, text, strict=True):
                self.units[w] = self.whole(unit)
            return
        raw, at = ids.tobytes(), [*(starts * 4).tolist(), 4 * len(ids)]
        self.units.update((w, raw[at[i] : at[i + 1]]) for i, w in enumerate(known))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        split: list[tuple[int, list[str]]] = []
        fresh: set[str] = set()
        for i, text in enumerate(texts):
            if self._plain(text):
                words = text.replace("\n", " \n").split(" ")
                fresh.update(words[1:])
                split.append((i, words))
            elif text:
                out[i] = self.whole(text)
        fresh.difference_update(self.units)
        before = len(self.units)
        self._learn(list(fresh))
        get = self.units.__getitem__
        for i, words in split:
            head = self.whole(words[0]) if words[0] else b""
            out[i] = head + b"".join(map(get, words[1:]))
        if len(self.units) > self.entries:
            for w in list(fresh)[: len(self.units) - max(self.entries, before)]:
                self.units.pop(w, None)
        return out

    def forget(self) -> None:
        """Empty the cache of units, at the end of a task."""
        self.units = {}

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(2)
def encoder(model: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> Encoder:
    """One for each Python worker, kept from task to task."""
    return Encoder(model, ranks)
