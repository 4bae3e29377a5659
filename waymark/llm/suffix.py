"""Suffix arrays by induced sorting, and permuted common prefixes, as array operations."""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last, a sentinel, counts as such."""
    n = len(s)
    step = np.sign(np.diff(s))
    at = np.where(step != 0, np.arange(n - 1), n)
    ahead = np.minimum.accumulate(at[::-1])[::-1]  # first place from here on where neighbours differ
    out = np.ones(n, bool)
    out[:-1] = step[np.minimum(ahead, n - 2)] > 0
    return out


def _induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, letters: int) -> np.ndarray:
    """Order of all suffixes from that of the seeds (leftmost-smaller ones): larger suffixes from the left, then smaller ones
    from the right, a letter's bucket at a time. What a bucket puts into itself is done in rounds, one for each repeat."""
    counts = np.bincount(s, minlength=letters)
    begin = np.cumsum(counts) - counts
    bigs = np.bincount(s[~small], minlength=letters)
    out = np.full(len(s), -1, np.int64)
    head = begin.copy()
    by_letter = np.argsort(s[seeds], kind="stable")
    seeds = seeds[by_letter]
    seed_at = np.searchsorted(s[seeds], np.arange(letters + 1))

    def add(items: np.ndarray) -> None:
        """Append items, in order, to the buckets of their letters."""
        c = s[items]
        order = np.argsort(c, kind="stable")
        c = c[order]
        out[head[c] + np.arange(len(c)) - np.searchsorted(c, c, "left")] = items[order]
        head[:] += np.bincount(c, minlength=letters)

    for c in np.flatnonzero(counts):
        at = begin[c]
        while at < head[c]:  # grows as the bucket feeds itself
            now = out[at : head[c]]
            at = head[c]
            before = now[now > 0] - 1
            add(before[~small[before]])
        now = seeds[seed_at[c] : seed_at[c + 1]]
        before = now[now > 0] - 1
        add(before[~small[before]])

    tail = begin + counts

    def prepend(items: np.ndarray) -> None:
        """The same from the ends of the buckets, downwards."""
        c = s[items]
        order = np.argsort(c, kind="stable")
        c = c[order]
        out[tail[c] - 1 - (np.arange(len(c)) - np.searchsorted(c, c, "left"))] = items[order]
        tail[:] -= np.bincount(c, minlength=letters)

    prepend(np.array([len(s) - 1]))  # the sentinel
    for c in np.flatnonzero(counts)[::-1]:
        at = begin[c] + counts[c]
        while at > tail[c]:
            now = out[tail[c] : at][::-1]
            at = tail[c]
            before = now[now > 0] - 1
            prepend(before[small[before]])
        now = out[begin[c] : begin[c] + bigs[c]][::-1]
        before = now[now > 0] - 1
        prepend(before[small[before]])
    return out


def _induce_one_by_one(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, letters: int) -> np.ndarray:
    """The same suffix by suffix, for strings over many letters, whose buckets hold next to nothing each."""
    ends = np.cumsum(np.bincount(s, minlength=letters))
    head, tail = np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()
    # The letter before each suffix, where the one that begins there is larger or smaller than its next; -1 elsewhere.
    before = np.concatenate([[-1], s[:-1]])
    is_small = np.concatenate([[False], small[:-1]])
    from_left, from_right = np.where(is_small, -1, before).tolist(), np.where(is_small, before, -1).tolist()
    out = [0] * len(s)  # no suffix comes from 0, so places that are still empty lead nowhere
    for j, c in zip(seeds[::-1].tolist(), s[seeds[::-1]].tolist(), strict=True):
        tail[c] -= 1
        out[tail[c]] = j
    for j in out:  # both loops meet what they put farther on
        c = from_left[j]
        if c >= 0:
            out[head[c]] = j - 1
            head[c] += 1
    tail = ends.tolist()
    for j in reversed(out):
        c = from_right[j]
        if c >= 0:
            tail[c] -= 1
            out[tail[c]] = j - 1
    return np.array(out, np.int64)


def _same(s: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the stretches of that length at a and at b are equal."""
    out = np.ones(len(a), bool)
    live, k = np.arange(len(a)), 0
    while len(live):
        live = live[length[live] > k]
        differ = s[a[live] + k] != s[b[live] + k]
        out[live[differ]] = False
        live, k = live[~differ], k + 1
    return out


def suffix_array(text: np.ndarray, dense: int = 256) -> np.ndarray:
    """Start positions of all suffixes in order. text: whole numbers from 0.

    Leftmost-smaller substrings are sorted by inducing, named, and the string of names is sorted in the same way, down to one
    whose names all differ. Where a letter stands `dense` times on average a bucket's suffixes are moved together.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    s = np.concatenate([text.astype(np.int64) + 1, [0]])
    letters = int(s.max()) + 1
    small = _types(s)
    first = np.zeros(n + 1, bool)
    first[1:] = small[1:] & ~small[:-1]
    seeds = np.flatnonzero(first)
    induce = _induce if letters * dense <= n else _induce_one_by_one
    order = induce(s, small, seeds, letters)
    ranked = order[first[order]]
    end = np.concatenate([seeds[1:], [n]])  # each reaches to the next one, which it includes
    length = np.zeros(n + 1, np.int64)
    length[seeds] = end - seeds + 1
    length[n] = 1
    a, b = ranked[:-1], ranked[1:]
    equal = length[a] == length[b]
    at = np.flatnonzero(equal)
    equal[at] = _same(s, a[at], b[at], length[a[at]])
    name = np.zeros(n + 1, np.int64)
    name[ranked] = np.concatenate([[0], np.cumsum(~equal)])
    if not equal.any():
        return induce(s, small, ranked, letters)[1:]
    inner = suffix_array(name[seeds], dense)
    return induce(s, small, seeds[inner], letters)[1:]


def common_prefixes(raw: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, by its place in the text, the length it has in common with the one before it in order, at most `most`."""
    n = len(raw)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    view = np.ndarray((n + most + 8,), "<u8", raw + bytes(most + 16), 0, (1,))
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    for k in range(0, most, 8):
        differ = view[live + k] ^ view[before[live] + k]
        equal = differ == 0
        lowest = differ[~equal] & (~differ[~equal] + np.uint64(1))
        out[live[~equal]] = k + np.log2(lowest.astype(np.float64)).astype(np.int64) // 8
        live = live[equal]
        out[live] = k + 8
    rest = n - np.maximum(np.arange(n), before)
    return np.minimum(np.minimum(out, rest), most)
