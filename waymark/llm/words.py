"""Words and their hashes over many texts at once, with numpy."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def find(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not white space (0x20, 0x09 to 0x0D)."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~SPACE[np.frombuffer(raw, np.uint8)]
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes, eight bytes at a time."""
    padded = raw + bytes(8)
    view = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))
    rest = ends - starts
    out = mix(rest.astype(np.uint64) * _C + np.uint64(1))
    live, at = np.arange(len(starts)), starts
    while len(live):
        out[live] = mix((out[live] ^ (view[at] & KEEP[np.minimum(rest[live], 8)])) * _C)
        rest[live] -= 8
        live = live[rest[live] > 0]
        at = starts[live] + (ends[live] - starts[live] - rest[live])
    return out


def join(texts: list[str]) -> tuple[bytes, np.ndarray]:
    """UTF-8 of all texts with a newline after each, and where each begins (one more at the end)."""
    raws = [t.encode() for t in texts]
    sizes = np.array([len(r) + 1 for r in raws], np.int64)
    return b"\n".join([*raws, b""]), np.concatenate([[0], np.cumsum(sizes)])
