"""Personal data: fixed patterns, and a skip-chain conditional random field that carries labels to other mentions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import arrow

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

_HINT = re.compile(r"[0-9@]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind leaves the matches as they are, for a match never begins inside a run of digits, and saves trying to.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_SPACE = re.compile(r"\s")
_RUN = re.compile(r"[0-9]+")
#: What may stand between the digit groups of one number.
_GAP = re.compile(r"[\s()./\u2010-\u2014-]{1,4}")
_NAME = re.compile(r"[A-Za-z0-9._%+-]+")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
#: Mailboxes named after a task (RFC 2142 and usual ones): as words they name no person.
_ROLES = frozenset(
    "abuse account accounts admin billing careers contact customer editor enquiries feedback hello help home hostmaster info jobs legal "
    "list mail mailer-daemon marketing media news newsletter no-reply noreply office orders postmaster press privacy root sales security "
    "service services shop staff subscribe support team test unsubscribe usenet user users uucp webmaster".split()
)
_EDGE = "\"'`.,;:!?()[]{}<>«»“”‘’"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match is a run of local characters up to an `@`, so looking left from each `@` finds it in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; kinds number as in KINDS."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if not _HINT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Graph:
    """Mentions of one text with what ties them: base spans, what meets a key of one, and other tokens with a digit or an `@`."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)  # 0: not covered by a base span
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)
    truth: list[int] = field(default_factory=list)  # for fits: the label, or -1 where it is not known
    weak: list[tuple[int, int]] = field(default_factory=list)  # ties of plain words, see `_plain`


WIDTH = 65
#: The one feature of a mention that is a plain word: its shape tells nothing.
_WORD = 64
#: Names that are ordinary words or numbers as well: letters with hyphens, single letters with dots, signs and digits alone.
_PLAIN = re.compile(r"[a-z]+(?:-[a-z]+)*|(?:[a-z]\.)+[a-z]|[0-9._%+-]+")


def _shape(token: str) -> list[int]:
    """Positions of the features that a token has, 0..29."""
    digits = sum(map(token.count, "0123456789"))
    letters = sum(map(str.isalpha, token))
    out = [min(digits, 8) if digits < 10 else 9 if digits < 14 else 10 if digits < 20 else 11]
    out.append(12 + min(token.count("."), 4))
    out.append(17 + min(token.count("-"), 3))
    out.append(21 if not letters else 22 if letters < digits else 23)
    if "@" in token:
        out.append(24 if "." in token.partition("@")[2] else 25)
    if token.startswith("+"):
        out.append(26)
    if token.startswith("("):
        out.append(27)
    if "=" in token or ":" in token or "/" in token:
        out.append(28)
    if digits and 2 * digits >= len(token):
        out.append(29)
    return out


def _keys(token: str) -> set[str]:
    """By what tokens that meet no base span are taken for the same thing; no key of a base span is among them."""
    bare = token.strip(_EDGE).lower()
    digits = _digits(bare)
    out = {"token=" + bare} if len(bare) > 5 else set()
    if len(digits) >= 7:
        out.add("token#" + digits[-7:])
    if "@" in bare and len(bare.partition("@")[0]) > 3:
        out.add("token=" + bare.partition("@")[0])
    return out


def _digits(text: str) -> str:
    return "".join(_RUN.findall(text))


def _name(word: str) -> str:
    return word.strip("._%+-").lower()


def _plain(name: str) -> bool:
    """Whether equal words are likely to be just words: `will`, `april`, `well-known`, `2024`, but not `jane.doe` or `will7`."""
    return bool(_PLAIN.fullmatch(name))


def _base_keys(text: str, kind: int) -> set[str]:
    """`=` and an e-mail's name, for a plain one also `~` and it, by which bare words meet it; `#` and the last seven of all digits
    (of an e-mail's name: its digits)."""
    name = text.partition("@")[0] if kind == 0 else ""
    digits, bare = _digits(name or text), _name(name)
    out = {"#" + digits[-7:]} if len(digits) >= 7 else set()
    if len(bare) > 3:
        out.add("=" + bare)
        if _plain(bare):
            out.add("~" + bare)
    return out


def _cased(c: str) -> bool:
    return c.lower() != c.upper()


def _names(text: str, names: set[str]) -> Iterator[tuple[int, int, str]]:
    """Whole words that are the name of an e-mail, with a host after it if one follows. A mailbox's role is a mention only with one;
    a plain word without one has a key of its own, whose ties are weak."""
    for m in _NAME.finditer(text):
        name = _name(m.group())
        if name not in names:
            continue
        start = m.start() + len(m.group()) - len(m.group().lstrip("._%+-"))
        end, host = start + len(name), _HOST.match(text, m.end())
        if name in _ROLES and not host:
            continue
        # Letters of scripts with cases would make it another word; others are written without spaces.
        if not (m.start() and _cased(text[m.start() - 1])) and not (m.end() < len(text) and _cased(text[m.end()])):
            yield start, host.end() if host else end, ("~" if _plain(name) and not host else "=") + name


#: Longer numbers (only names of e-mails hold such) are met as a whole or by an end of so many digits.
_ENDS = 24


class Numbers:
    """Digits of base spans: whole numbers, and all their ends of seven digits or more."""

    def __init__(self) -> None:
        self.whole: set[str] = set()
        self.ends: set[str] = set()

    def add(self, digits: str) -> None:
        if len(digits) >= 7:
            self.whole.add(digits)
            self.ends.update(digits[i:] for i in range(max(0, len(digits) - _ENDS), len(digits) - 6))

    def longest(self) -> int:
        return max(map(len, self.whole), default=0) + 2

    def says(self, digits: str) -> bool:
        """Whether these are a number or its end, or its end behind a trunk 0, or the whole of it behind an international 00. Other
        digits before an end make it another number."""
        if digits in self.ends or digits in self.whole:
            return True
        return digits[:1] == "0" and digits[1:] in self.ends and digits[1:] not in self.whole or digits[:2] == "00" and digits[2:] in self.whole


def _numbers(text: str, numbers: Numbers, busy: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Runs of digit groups, in one token or several, that are a number of `numbers` or an end of it: the longest such run up to a
    group. One that hangs on further digits before it, by a hyphen, dot or slash, is another number and no mention."""
    longest = numbers.longest()

    def meet(groups: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
        joined = "".join(text[a:b] for a, b in groups)
        offset = [0]
        for a, b in groups:
            offset.append(offset[-1] + b - a)
        for k in range(len(groups)):
            end = offset[k + 1]
            if end < 7 or joined[end - 7 : end] not in numbers.ends:
                continue
            i, best = k, None
            while i >= 0 and end - offset[i] <= longest:
                if end - offset[i] >= 7 and numbers.says(joined[offset[i] : end]):
                    best = i
                i -= 1
            if best is None:
                continue
            start, stop = groups[best][0], groups[k][1]
            if best and not re.search(r"[\s(]", text[groups[best - 1][1] : start]):
                continue
            if start and text[start - 1] == "(" and ")" in text[start:stop]:
                start -= 1
            if start and text[start - 1] == "+":
                start -= 1
            yield start, stop, "#" + joined[end - 7 : end]

    run: list[tuple[int, int]] = []
    k = 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        while k < len(busy) and busy[k][1] <= a:
            k += 1
        taken = k < len(busy) and busy[k][0] < b
        if run and (taken or not _GAP.fullmatch(text, run[-1][1], a)):
            yield from meet(run)
            run = []
        if not taken:
            run.append((a, b))
    yield from meet(run)


def _union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _apart(found: Iterable[tuple[int, int, str]], busy: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """What of `found` lies outside `busy`, from the left, of overlapping ones the first and longest."""
    out, k, done = [], 0, 0
    for a, b, key in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        while k < len(busy) and busy[k][1] <= a:
            k += 1
        if a >= done and not (k < len(busy) and busy[k][0] < b):
            out.append((a, b, key))
            done = b
    return out


def _mentions(text: str, spans: list[tuple[int, int, int]], busy: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, key) outside the base spans of all that meets a key of one, in order."""
    names: set[str] = set()
    numbers = Numbers()
    for a, k, b in spans:
        for key in _base_keys(text[a:b], k):
            if key[0] == "=":
                names.add(key[1:])
            elif key[0] == "#":
                numbers.add(_digits(text[a:b].partition("@")[0]))
    found = list(_names(text, names)) if names else []
    if numbers.whole:
        found += _numbers(text, numbers, busy)
    return _apart(found, busy)


def graph(text: str, spans: list[tuple[int, int, int]]) -> Graph:
    g = Graph()
    if not _HINT.search(text):
        return g
    busy = _union((a, b) for a, _, b in spans)
    nodes = [(a, b, k + 1, _base_keys(text[a:b], k)) for a, k, b in spans]
    if spans:
        met = _mentions(text, spans, busy)
        nodes += [(a, b, 0, {key}) for a, b, key in met]
        busy = _union([*busy, *((a, b) for a, b, _ in met)])
    k, done = 0, 0
    hit = _HINT.search(text)
    while hit:
        start = hit.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        end = done = _TOKEN.match(text, start).end()
        while k < len(busy) and busy[k][1] <= start:
            k += 1
        if not (k < len(busy) and busy[k][0] < end):
            nodes.append((start, end, 0, None))
        hit = _HINT.search(text, end)
    seen: dict[str, int] = {}
    previous_end = -3
    for i, (start, end, label, keys) in enumerate(sorted(nodes, key=lambda x: x[:3])):
        token = text[start:end]
        left, right = len(token) - len(token.lstrip(_EDGE)), len(token.rstrip(_EDGE))
        g.spans.append((start + left, start + right) if keys is None and right > left else (start, end))
        g.label.append(label)
        own = [_WORD] if not label and keys and all(x[0] == "~" for x in keys) else _shape(token)
        g.features.append(own)
        if i and start - previous_end <= 2:
            g.chain.append((i - 1, i))
            g.features[i - 1] = g.features[i - 1] + [30 + f for f in own if f < 17]
            g.features[i] = own + [47 + f for f in g.features[i - 1] if f < 17]
        for key in _keys(token) if keys is None else keys:
            if key in seen and seen[key] != i:
                (g.weak if key[0] == "~" else g.skip).append((seen[key], i))
            seen[key] = i
        previous_end = end
    g.skip = sorted(set(g.skip))
    g.weak = sorted(set(g.weak) - set(g.skip))
    return g


@dataclass
class Model:
    """Log potentials: of a token's label by its features, of neighbours' labels, of tied mentions' labels, and of those tied by a
    plain word."""

    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    ready: bool = True
    weak: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS))))


def _design(features: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(features), WIDTH + 1))
    x[:, WIDTH] = 1
    for i, f in enumerate(features):
        x[i, f] = 1
    return x


def _forms(span: str, kind: int) -> list[str]:
    """Other ways to write what a base span says, which the patterns miss."""
    if kind == 0:
        name = _name(span.partition("@")[0])
        return [] if len(name) <= 3 else [name + "@desk", name.upper() + "@desk"] if _plain(name) else [name, name.upper()]
    digits = _digits(span)
    if kind == 1 or len(digits) < 7:
        return []
    groups = [digits[max(i - 4, 0) : i] for i in range(len(digits), 0, -4)][::-1]
    return [digits[-7:], digits[-8:], digits, " ".join(groups[-3:]), "-".join(groups[-2:])]


_AWORD = re.compile(r"(?<![A-Za-z0-9@._%+-])[A-Za-z]{4,20}(?![A-Za-z0-9@._%+-])")


def example(text: str, foreign: str = "", nodes: int = 60) -> Graph:
    """The graph of a text for a fit, with mentions of known labels planted behind it.

    Each base span of the text is written once more, in a form that the patterns miss, so a tie with a known label leads to it. A
    base span of another text (`foreign`) is put after them, and an address named after a word of this text: what meets their keys in
    this text does so by chance, and is no entity.
    A mention of the text itself that meets a key of its own spans has no known label. Of long texts a stretch of at most
    `nodes` nodes is taken, the planted ones included.
    """
    spans, planted, whole = base_spans(text), {}, text
    for i, (a, k, b) in enumerate(spans[:: max(1, len(spans) // 8)]):
        if forms := _forms(text[a:b], k):
            form = forms[(zlib.crc32(text.encode()) + i) % len(forms)]
            whole += "\nnote: "
            planted[len(whole), len(whole) + len(form)] = k + 1
            whole += form + " again"
    own = len(whole)
    whole += "\n" + foreign
    # The word after a place that the text itself gives, so that all kinds of words come, the common ones most often.
    if word := _AWORD.search(text, zlib.crc32(text.encode()) % (len(text) + 1)) or _AWORD.search(text):
        whole += f" or {word.group().lower()}@example.net"
    g = graph(whole, base_spans(whole))
    near: dict[int, list[int]] = {}
    for i, j in g.skip + g.weak:
        near.setdefault(i, []).append(j)
        near.setdefault(j, []).append(i)
    for i, label in enumerate(g.label):
        if not label and (known := planted.get(g.spans[i])):
            label = known
        elif not label and any(g.label[j] and g.spans[j][0] < own for j in near.get(i, ())):
            label = -1
        g.truth.append(label)
    first = max(0, len(g.label) - nodes)
    inside = lambda edges: [(i - first, j - first) for i, j in edges if i >= first and j >= first]
    return Graph(g.spans[first:], g.features[first:], g.label[first:], inside(g.chain), inside(g.skip), g.truth[first:], inside(g.weak))


def examples(texts: list[str]) -> list[Graph]:
    """An example of each text, the last base span before it as the foreign one."""
    out, foreign = [], ""
    for text in texts:
        out.append(example(text, foreign))
        for a, _, b in base_spans(text)[:1]:
            foreign = text[a:b]
    return out


def fit(graphs: list[Graph], steps: int = 300, ridge: float = 1e-5) -> Model:
    """Weights of features, neighbours and ties together, by the pseudo-likelihood of the known labels: each node's label given
    its features and its neighbours' labels, as far as they are known. The patterns themselves are no features. What ties are
    worth is told by planted mentions, which look like no entity, and by chance meetings with spans of other texts."""
    truth = np.array([y for g in graphs for y in g.truth], int)
    n = len(LABELS)
    if not (truth > 0).any():
        return Model(np.zeros((WIDTH + 1, n)), np.zeros((n, n)), np.zeros((n, n)), False)
    x = _design([f for g in graphs for f in g.features])
    left, right, tied, weak = (np.zeros((len(truth), n)) for _ in range(4))  # how many neighbours of each label a node has
    at = 0
    for g in graphs:
        for edges, forth, back in ((g.chain, left, right), (g.skip, tied, tied), (g.weak, weak, weak)):
            for i, j in edges:
                if truth[at + i] >= 0 and truth[at + j] >= 0:
                    forth[at + j, truth[at + i]] += 1
                    back[at + i, truth[at + j]] += 1
        at += len(g.truth)
    known = truth >= 0
    x, left, right, tied, weak, y = x[known], left[known], right[known], tied[known], weak[known], np.eye(n)[truth[known]]
    # What kinds have in common about ties, agreement of entities and an entity's tie to none, has weights of its own beside those
    # of each pair of labels, so that a kind with few examples is helped by the others.
    agree, differ = np.diag([0.0, *[1.0] * (n - 1)]), np.zeros((n, n))
    differ[0, 1:] = differ[1:, 0] = 1
    params = np.zeros((WIDTH + 1 + 3 * n + 1, n))
    m, v = np.zeros_like(params), np.zeros_like(params)
    weights, chain, skip, words = slice(0, WIDTH + 1), slice(WIDTH + 1, WIDTH + 1 + n), slice(WIDTH + 1 + n, -1 - n), slice(-1 - n, -1)
    loose = lambda: params[words] + params[words].T
    ties = lambda: params[skip] + params[skip].T + params[-1, 0] * agree + params[-1, 1] * differ
    for step in range(1, steps + 1):
        c = params[chain]
        p = x @ params[weights] + left @ c + right @ c.T + tied @ ties() + weak @ loose()
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        miss = y - p
        tie, light = tied.T @ miss, weak.T @ miss
        common = np.zeros((1, n))
        common[0, :2] = (tie * agree).sum(), (tie * differ).sum()
        grad = np.concatenate([x.T @ miss, left.T @ miss + (right.T @ miss).T, tie + tie.T, light + light.T, common]) / len(x) - ridge * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params = params + 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(params[weights], params[chain], ties(), weak=loose())


def propagate(g: Graph, model: Model, rounds: int = 30, damping: float = 0.3) -> np.ndarray:
    """Marginals by loopy sum-product over chain and skip edges; tokens under base spans are held at their labels."""
    n, k = len(g.spans), len(LABELS)
    local = _design(g.features) @ model.weights
    fixed = np.array(g.label)
    local[fixed > 0] = -60
    local[np.flatnonzero(fixed), fixed[fixed > 0]] = 0
    edges = g.chain + g.skip + g.weak
    if edges:
        kinds = ((model.chain, g.chain), (model.skip, g.skip), (model.weak, g.weak))
        pair = np.concatenate([np.repeat(potential[None], len(of), 0) for potential, of in kinds])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        i, j = np.array(edges).T
        source, target = np.concatenate([i, j]), np.concatenate([j, i])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((2 * len(edges), k))
        for _ in range(rounds):
            total = local.copy()
            np.add.at(total, target, message)
            out = total[source] - message[back]
            fresh = out[:, :, None] + pair
            top = fresh.max(axis=1)
            fresh = top + np.log(np.exp(fresh - top[:, None, :]).sum(axis=1))
            fresh -= fresh.max(axis=1, keepdims=True)
            change = np.abs(fresh - message).max()
            message = damping * message + (1 - damping) * fresh
            if change < 1e-4:
                break
        np.add.at(local, target, message)
    p = np.exp(local - local.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, spans: list[tuple[int, int, int]], model: Model, sure: float = 0.9) -> list[tuple[int, int, int]]:
    """Spans beyond the base ones: mentions whose label the field is sure of, and that ties lead to from a base span of that kind."""
    if not model.ready or not spans:
        return []
    g = graph(text, spans)
    tied = {i for edge in g.skip + g.weak for i in edge if not g.label[i]}
    if not tied:
        return []
    p = propagate(g, model)
    label = {i: y for i, y in enumerate(g.label) if y}
    near: dict[int, list[int]] = {}
    for i, j in g.skip + g.weak:
        near.setdefault(i, []).append(j)
        near.setdefault(j, []).append(i)
    todo, out = list(label), []
    while todo:
        i = todo.pop()
        for j in near.get(i, ()):
            if j not in label and p[j].argmax() == label[i] and p[j].max() >= sure:
                label[j] = label[i]
                todo.append(j)
                out.append((g.spans[j][0], label[j] - 1, g.spans[j][1]))
    return sorted(out)


def train(docs: DataFrame, sample: int = 20_000, nodes: int = 60, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the documents among `sample` ids, the first by a hash of the id, that hold a digit or an `@`; of rows that share an
    id the first by their features, `sample` rows in all. Only features, labels and ties of at most `nodes` nodes of each come to
    the driver. Null texts do not count; without any base span the model adds no spans."""
    ids = docs.select(F.col(id_col).alias("doc_id")).filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.col(text_col)
    rows = docs.filter(text.rlike("[0-9@]")).select(F.col(id_col).alias("doc_id"), text.alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.list_(pa.list_(pa.int32()))
        kinds = {"features": pairs, "label": pa.list_(pa.int32()), "chain": pairs, "skip": pairs, "truth": pa.list_(pa.int32()), "weak": pairs}
        for batch in batches:
            found = [example(t, f, nodes) for t, f in zip(arrow.texts(batch, "text"), arrow.texts(batch, "foreign"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), *(pa.array([getattr(g, c) for g in found], t) for c, t in kinds.items())], ["h", *kinds])

    # The foreign span is made up from the id, so that it does not depend on how rows lie: a number and a name.
    h = F.xxhash64("doc_id")
    number = F.lpad(F.pmod(h, F.lit(10**10)).cast("string"), 10, "7")
    foreign = F.concat(F.lit("+1 "), number, F.lit(" or user"), F.substring(number, 1, 3), F.lit("@example.com"))
    schema = "h bigint, features array<array<int>>, label array<int>, chain array<array<int>>, skip array<array<int>>, truth array<int>, weak array<array<int>>"
    found = rows.join(F.broadcast(ids.distinct()), "doc_id").select(h.alias("h"), "text", foreign.alias("foreign")).mapInArrow(arrow.tidy(extract), schema)
    # In a fixed order, for sums of floats depend on it.
    kept = found.orderBy("h", "label", "features", "chain", "skip", "truth", "weak").limit(sample).toArrow().to_pylist()
    return fit([Graph([], r["features"], r["label"], r["chain"], r["skip"], r["truth"], r["weak"]) for r in kept])


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of base spans), base and spans (`kind:start:end`, comma-joined) for every row.

    Starts and ends count code points. Null text counts as empty; texts of any length are searched whole, repeated rows
    each; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch, "text"):
                counts, base, every = np.zeros((part.num_rows, 4), np.int64), [], []
                for r, text in enumerate(arrow.texts(part, "text")):
                    spans = base_spans(text)
                    for _, k, _ in spans:
                        counts[r, k] += 1
                    base.append(_line(spans))
                    every.append(_line(spans + added_spans(text, spans, shared.value)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(counts[:, k]) for k in range(4)), pa.array(base), pa.array(every)],
                    ["doc_id", *("n_" + k for k in KINDS), "base", "spans"],
                )

    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base string, spans string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(arrow.tidy(run), schema)


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; all other columns as they are. Null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        spans = base_spans(text)
        spans = sorted(spans + added_spans(text, spans, shared.value))
        out, at = [], 0
        for a, k, b in spans:
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch, text_col):
                text = pa.array([clean(t) for t in part.column(text_col).to_pylist()], pa.string())
                yield part.set_column(part.schema.get_field_index(text_col), text_col, text)

    return arrow.over(docs, run, docs.schema)
