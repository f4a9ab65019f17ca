"""Personal data by candidate gradient boosting.

Strict patterns find the base spans, which always stay. Looser generators propose more spans, overlapping as they come: spelled-out
addresses, dotted card numbers, telephone numbers without a plus. What one proposes hangs on the span and its neighbours alone. Boosted trees
score each by its format and by the words around it; a threshold for each kind, calibrated for precision on documents the trees
haven't seen, picks those to add. Of overlapping ones the likeliest stays, and none may touch a base span.

No labels exist for this, so documents label themselves (``document_examples``): a base span rewritten in a looser format, in its own
surroundings, is personal data; what is proposed in a document without any base span is not. Every document takes part, four fifths of them to
fit and one fifth to calibrate. Features fall into fixed bins (``CUTS``), so examples with equal bins are one row with two counts; trees and thresholds
are made from these counts, whose sums are whole numbers and don't hang on their order. Up to ``MOST`` such rows the driver sums them, more are summed by
a job for each level of a tree. Seeded sentences (``examples``) are added, for formats that the documents lack; a kind
of which the calibrating documents hold fewer than ``FEW`` is calibrated on sentences.

Defined results: a null text counts as empty and has no spans; repeated rows have equal spans; positions are code points of the whole text, ends
exclusive; an empty table gives an empty result. Extra columns are kept; names that clash with the added ones are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from zlib import crc32
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from .common import drop, materialize

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[Span]]:
    """The strict spans of each kind, leftmost and non-overlapping within the kind; linear in the text's length."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out["email"].append((start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    if not any(c in text for c in "0123456789"):
        return out
    for m in DOTTED.finditer(text):
        start, parts = m.start(), m.group().split(".")
        for four in range(0, len(parts) - 3, 4):
            end = start + sum(map(len, parts[four : four + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[four : four + 4]):
                out["ip"].append((start, end))
            start = end + 1
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            out["phone"].append(m.span())
    return out


AT = re.compile(r"\[at\]|\(at\)|\{at\}|\bat\b|＠|@", re.I)
SPELLED = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\}|\bdot\b)\s?)[A-Za-z0-9-]{1,63})+", re.I)
LOOSE_IP = re.compile(r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\))\s?[0-9]{1,3}){3}(?![A-Za-z0-9])", re.I)
LOOSE_CARD = re.compile(r"(?<![A-Za-z0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){12,18}(?![A-Za-z0-9])")
LOOSE_PHONE = re.compile(r"(?<![A-Za-z0-9])(?:\(\+?[0-9]{1,4}\)|\+|[0-9])[\x20()./0-9-]{5,24}[0-9](?![A-Za-z0-9])")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What may be personal data besides the base spans; much of it isn't."""
    out: list[tuple[str, int, int]] = []
    for m in AT.finditer(text):
        end = m.start() - text[max(0, m.start() - 1) : m.start()].isspace()
        start, after = end, m.end() + text[m.end() : m.end() + 1].isspace()
        while start and end - start < 64 and text[start - 1] in LOCAL:
            start -= 1
        if start < end and (d := SPELLED.match(text, after)):
            out.append(("email", start, d.end()))
    out += [("ip", *m.span()) for m in LOOSE_IP.finditer(text)]
    out += [("card", *m.span()) for m in LOOSE_CARD.finditer(text)]
    out += [("phone", *m.span()) for m in LOOSE_PHONE.finditer(text)]
    return out


#: Words that tell of each kind, and words that tell against all.
CUES = {
    "email": ("mail", "contact", "write", "reach", "address"),
    "ip": ("ip", "host", "server", "login", "address", "client"),
    "card": ("card", "visa", "credit", "payment", "mastercard", "amex"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "contact", "reach", "dial", "cell"),
}
AGAINST = ("version", "order", "id", "isbn", "invoice", "ref", "total", "page", "serial", "section", "release", "token", "password", "date", "no", "item", "score")
#: Ends of host names that are common in addresses.
TOP = ("com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "it", "nl", "uk", "eu", "us", "ca", "ch")
WORDS = re.compile(r"[a-z]+")


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, digits = text[start:end], _digits(text[start:end])
    around = text[max(0, start - 40) : start].lower()
    words = set(WORDS.findall(around)[-5:])
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    parts = [int(g) for g in re.findall(r"[0-9]+", span)] or [0]
    return [
        *(float(kind == k) for k in KINDS),
        float(len(span)), float(len(digits)), len(digits) / len(span), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
        float(span[0] in "+("), float("(" in span), float("." in span), float("-" in span), float(" " in span), float("/" in span),
        float(len(digits) >= 12 and luhn(digits)), float(max(parts) <= 255), float(min(parts)),
        float("[" in span or "{" in span or "(at" in span.lower() or "(dot" in span.lower()), float(" dot " in span.lower()), float(bool(digits) and len(set(digits)) <= 2),
        float(bool(words & set(CUES[kind]))), float(bool(words & set(AGAINST))),
        float(text[end : end + 1].isalnum()), float(text[start - 1 : start].isalnum()), float(bool(re.match(r"(?:19|20)[0-9]{2}[-/.]", span))),
        float((last := WORDS.findall(span.lower())[-1:]) != [] and last[0] in TOP), float(min(12, len(last[0]))) if last else 0.0,
    ]


def examples(n: int, seed: int) -> Iterator[tuple[str, str, int, int, int]]:
    """``text, kind, start, end, label`` of ``n`` made sentences, a third of them without a telling word before the span."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(pick(*"abcdefghijklmnoprstuv") for _ in range(int(rng.integers(3, 9))))

    def card(size: int) -> str:
        body = pick("4", "5", "37", "6011") + d(20)
        return next(x for c in "0123456789" if luhn(x := body[: size - 1] + c))

    def grouped(x: str, mark: str) -> str:
        return mark.join(x[i : i + 4] for i in range(0, len(x), 4))

    for _ in range(n):
        kind, good = pick(*KINDS), int(rng.integers(2))
        if kind == "email":
            at, dot = pick(("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", " dot "), ("{at}", "{dot}"), (" (at) ", " (dot) "))
            x = f"{word()}.{d(2)}{at}{word()}{dot}{pick('com', 'org', 'net', 'de')}" if good else f"{word()} at {word()}{pick('. ', '.')}{word()}"
        elif kind == "ip":
            octets = [str(int(v)) for v in rng.integers(1, 256, 4)]
            x = pick("[.]", "(.)", "[dot]").join(octets) if good else pick(f"{d(1)}.{d(1)}.{d(1)}.{d(3)}", f"{int(rng.integers(256, 999))}.{d(3)}.{d(3)}.{d(3)}", f"{d(2)}. {d(2)}. {d(2)}. {d(2)}")
        elif kind == "card":
            x = grouped(card(int(pick(15, 16, 16))), pick(".", "/", "  ", "_", " - ")) if good else pick(d(13), grouped(d(16), pick(".", "/", "_")), d(14), f"{d(4)}-{d(2)}-{d(2)} {d(2)}.{d(2)}.{d(2)}")
        else:
            area, mid, last = "2" + d(2), pick("555", d(3)), d(4)
            x = pick(f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"00{pick('44', '49', '33', '1')} {d(3)} {d(3)} {d(4)}", f"{area} {mid} {last}") if good else pick(
                f"20{d(2)}-0{pick(*'123456789')}-1{d(1)}", d(7), d(9), d(16), f"{d(3)}.{d(5)}", f"{d(4)} {d(4)} {d(2)}", f"{d(1)}.{d(3)}.{d(3)}.{d(3)}", f"{d(2)}/{d(2)}/{d(4)}"
            )
        cue = pick(*CUES[kind], "", "") if good else pick(*AGAINST, "", *[word() for _ in range(6)])
        before = f"{word()} {word()} {cue}{pick(' ', ': ', ' is ') if cue else ''}".lstrip()
        text = f"{before}{x} {word()} {word()}"
        yield text, kind, len(before), len(before) + len(x), good


DEPTH, WIDTH, FEW = 3, 29, 20
#: Rows of counts that the driver sums itself.
MOST = 200_000
#: Gradients are summed as whole numbers of this part of one.
SCALE = 1 << 20
_COUNTS = [*range(25), 28, 32, 40, 48, 64]
#: Where each feature may be split; those not named are 0 or 1.
CUTS = [np.array({4: _COUNTS, 5: _COUNTS, 6: [k / 16 for k in range(16)], 7: _COUNTS[:16], 8: _COUNTS, 9: _COUNTS[:17], 18: [*_COUNTS, 100, 255, 999, 9999], 28: range(12)}.get(j, [0]), float) for j in range(WIDTH)]
BINS = max(map(len, CUTS)) + 1
IS_CUT = np.arange(BINS) < np.array([len(c) for c in CUTS])[:, None]
LIMITS = np.arange(0.5, 0.99, 0.01)


def binned(x: np.ndarray) -> np.ndarray:
    """The bin of each feature: how many of its cuts are below it."""
    return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(CUTS)], axis=1).astype(np.uint8)


def leaf(x: np.ndarray, columns: np.ndarray, limits: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row of ``x`` reaches in each tree after ``depth`` steps, counted within its level."""
    node, rows, trees = np.zeros((len(x), len(columns)), np.int64), np.arange(len(x))[:, None], np.arange(len(columns))
    for _ in range(depth):
        node = 2 * node + 1 + (x[rows, columns[trees, node]] > limits[trees, node])
    return node - (2**depth - 1)


@dataclass
class Trees:
    """Boosted trees of depth ``DEPTH``: in level order the split's column and cut, by number and by value, then the leaves."""

    bias: float
    columns: np.ndarray
    cuts: np.ndarray
    values: np.ndarray
    leaves: np.ndarray
    thresholds: dict[str, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.bias + self.margin(x, self.values))

    def margin(self, x: np.ndarray, limits: np.ndarray, first: int = 0) -> np.ndarray:
        """The sum of the trees from ``first`` on, of features by ``values`` or of bins by ``cuts``."""
        leaves = self.leaves[first:]
        return leaves[np.arange(len(leaves)), leaf(x, self.columns[first:], limits[first:], DEPTH)].sum(axis=1)


def _logistic(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


class Counted:
    """Examples by their bins: how many there are, and how many of them are personal data. All its sums are whole numbers."""

    def __init__(self, bins: np.ndarray, n: np.ndarray, good: np.ndarray):
        self.bins, self.n, self.good = bins, n, good
        self.margin, self.trees = np.zeros(len(n)), 0

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Counted:
        bins = np.frombuffer(b"".join(rows["bins"]), np.uint8).reshape(len(rows), WIDTH)
        return cls(bins, rows["n"].to_numpy(np.int64), rows["good"].to_numpy(np.int64))

    def totals(self) -> np.ndarray:
        return np.array([self.n.sum(), self.good.sum()])

    def _probability(self, trees: Trees) -> np.ndarray:
        if self.trees < len(trees.leaves):
            self.margin += trees.margin(self.bins, trees.cuts, self.trees)
            self.trees = len(trees.leaves)
        return _logistic(trees.bias + self.margin)

    def sums(self, trees: Trees, columns: np.ndarray, cuts: np.ndarray, level: int) -> np.ndarray:
        """Gradients and curvatures of the loss by node of the next tree's ``level``, feature and bin."""
        p = self._probability(trees)
        at = (leaf(self.bins, columns, cuts, level) * WIDTH + np.arange(WIDTH)) * BINS + self.bins
        size = 2**level * WIDTH * BINS
        of = lambda w: np.bincount(at.ravel(), np.repeat(np.rint(w * SCALE), WIDTH), size).astype(np.int64)
        return np.stack([of(self.n * p - self.good), of(self.n * p * (1 - p))]).reshape(2, 2**level, WIDTH, BINS)

    def picked(self, trees: Trees, limits: np.ndarray) -> np.ndarray:
        """By kind and by each of its ``limits``: how many examples reach it, and how many of them are personal data."""
        p, kind = self._probability(trees), self.bins[:, : len(KINDS)].argmax(axis=1) if len(self.n) else np.zeros(0, int)
        reach = lambda k, t: (kind == k) & (p >= t)
        return np.array([[[self.n[at].sum(), self.good[at].sum()] for at in (reach(k, t) for t in own)] for k, own in enumerate(limits)])


class Spread:
    """The same sums of more rows than the driver takes: each task sums its own, the driver adds an array a task."""

    def __init__(self, table: DataFrame):
        self.table = table

    def _sum(self, of, *args) -> np.ndarray:
        def own(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = sum(of(Counted.of(part), *args) for part in parts if len(part))
            if isinstance(total, np.ndarray):
                yield pd.DataFrame({"sums": [total.astype(np.int64).tobytes()]})

        like = of(Counted(np.zeros((0, WIDTH), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)), *args).astype(np.int64)
        return sum((np.frombuffer(r.sums, np.int64).reshape(like.shape) for r in self.table.mapInPandas(own, "sums binary").collect()), like)

    def totals(self) -> np.ndarray:
        return self._sum(Counted.totals)

    def sums(self, *args) -> np.ndarray:
        return self._sum(Counted.sums, *args)

    def picked(self, *args) -> np.ndarray:
        return self._sum(Counted.picked, *args)


def fit(parts: list[Counted | Spread], rounds: int = 60, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss; every node takes the split of most gain."""
    n, good = sum(p.totals() for p in parts)
    share = float(np.clip(good / n if n else 0.5, 1e-3, 1 - 1e-3))
    inner = 2**DEPTH - 1
    trees = Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), int), np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), {})
    for _ in range(rounds):
        columns, cuts, values, leaves = np.zeros((1, inner), int), np.zeros((1, inner), int), np.zeros((1, inner)), np.zeros((1, inner + 1))
        for level in range(DEPTH):
            g, h = sum(p.sums(trees, columns, cuts, level) for p in parts) / SCALE
            gs, hs = g.sum(axis=2, keepdims=True), h.sum(axis=2, keepdims=True)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gain = np.where(IS_CUT, gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge), -1.0)
            for node, best in enumerate(gain.reshape(2**level, -1).argmax(axis=1).tolist()):
                at, (c, j) = 2**level - 1 + node, divmod(best, BINS)
                columns[0, at], cuts[0, at], values[0, at] = c, j, CUTS[c][j]
                if level == DEPTH - 1:
                    left, right = (gl[node, c, j], hl[node, c, j]), (gs[node, c, 0] - gl[node, c, j], hs[node, c, 0] - hl[node, c, j])
                    leaves[0, 2 * node : 2 * node + 2] = [-rate * a / (b + ridge) for a, b in (left, right)]
        trees = Trees(trees.bias, *(np.concatenate(x) for x in ((trees.columns, columns), (trees.cuts, cuts), (trees.values, values), (trees.leaves, leaves))), {})
    return trees


def loosened(kind: str, span: str, pick: int) -> str:
    """A base span as people write it to slip past strict patterns."""
    digits = _digits(span)
    if kind == "email":
        at, dot = ((" at ", "."), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), ("(at)", "."), (" [at] ", " [dot] "))[pick % 6]
        name, _, domain = span.partition("@")
        return name + at + domain.replace(".", dot)
    if kind == "ip":
        return span.replace(".", ("[.]", "(.)", "[dot]")[pick % 3])
    if kind == "card":
        return ("._/"[pick % 3]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return ("00" + digits, f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"{digits[:3]}-{digits[3:6]}-{digits[6:]}", f"{digits[:3]}.{digits[3:6]}.{digits[6:]}")[pick % 4]


def document_examples(text: str) -> Iterator[tuple[str, str, int, int, int]]:
    """``text, kind, start, end, label`` from one document: the first base span of each kind loosened, or what is proposed where there are none."""
    base = base_spans(text)
    if not any(base.values()):
        yield from ((text, *c, 0) for c in candidates(text))
    for kind, spans in base.items():
        for start, end in spans[:1]:
            new = loosened(kind, text[start:end], crc32(text[start:end].encode("utf-8", "surrogatepass")))
            changed, stop = text[:start] + new + text[end:], start + len(new)
            for k, s, e in candidates(changed):
                shared = min(e, stop) - max(s, start)
                if shared > 0:
                    yield changed, k, s, e, int(k == kind and shared >= 0.8 * max(e - s, len(new)))


def _made(n: int, seed: int) -> Counted:
    rows = list(examples(n, seed))
    x = np.array([features(*r[:4]) for r in rows], float).reshape(len(rows), WIDTH)
    return Counted(binned(x), np.ones(len(rows), np.int64), np.array([r[4] for r in rows], np.int64))


def counted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``bins, out, n, good`` of the examples of all documents, a written table; those of a fifth of the documents, the same in every run, are ``out``."""
    place = F.xxhash64(F.col(doc_id), F.col(text))
    whole = docs.where(F.length(text) > 0).select((F.pmod(place, F.lit(5)) == 0).alias("out"), F.col(text).alias("text"))

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(out, e[4], features(*e[:4])) for t, out in zip(part["text"], part["out"], strict=True) for e in document_examples(t)]
            bins = binned(np.array([f[2] for f in found], float).reshape(len(found), WIDTH))
            rows = pd.DataFrame({"bins": [b.tobytes() for b in bins], "out": [f[0] for f in found], "good": [f[1] for f in found]})
            yield rows.groupby(["bins", "out"])["good"].agg(["size", "sum"]).reset_index()

    one = whole.mapInPandas(of, "bins binary, out boolean, size long, sum long")
    return materialize(one.groupBy("bins", "out").agg(F.sum("size").alias("n"), F.sum("sum").alias("good")), "counted")


def from_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, Counted | Spread, Counted | Spread]:
    """The written counts of all documents' examples, those to fit and those to calibrate."""
    table = counted(docs, text, doc_id)
    sides = [table.where(~F.col("out")), table.where("out")]
    few = table.count() <= MOST
    return table, *(Counted.of(side.toPandas()) if few else Spread(side) for side in sides)


def trained(fitted: list[Counted | Spread], other: Counted | Spread | None, sentences: int, precision: float, seed: int) -> Trees:
    """Trees fitted to examples and ``sentences`` made ones; each kind's threshold is the least at which the others come to ``precision``."""
    made, spare = (_made(n, s) for n, s in ((sentences, seed), (sentences // 2, seed + 1)))
    trees = fit([*fitted, made])
    limits = np.tile([0.0, *LIMITS], (len(KINDS), 1))
    of_sentences = spare.picked(trees, limits)
    of_documents = other.picked(trees, limits) if other else np.zeros_like(of_sentences)
    for kind, own, made_up in zip(KINDS, of_documents, of_sentences, strict=True):
        n, good = (own if own[0, 1] >= FEW else made_up)[1:].T
        trees.thresholds[kind] = float(min(LIMITS[(n > 0) & (good >= precision * n)], default=0.99))
    return trees


@cache
def model(n: int = 4_000, precision: float = 0.98, seed: int = 5) -> Trees:
    """Fitted to made sentences alone, for texts of which there are no documents to learn from."""
    return trained([], None, n, precision, seed)


def train(docs: DataFrame, text: str = "text", sentences: int = 2_000, precision: float = 0.98, seed: int = 5) -> Trees:
    """Fitted to all documents and to ``sentences``."""
    table, fitted, other = from_documents(docs, text)
    trees = trained([fitted], other, sentences, precision, seed)
    drop(table)
    return trees


def held_out(docs: DataFrame, trees: Trees) -> dict[str, tuple[float, float, int]]:
    """By kind: precision and recall on the calibrating documents' candidates, and the number that are personal data."""
    table, _, other = from_documents(docs)
    got = other.picked(trees, np.array([[0.0, trees.thresholds[k]] for k in KINDS])).tolist()
    drop(table)
    return {k: (hits / n if n else 1.0, hits / good if good else 1.0, good) for k, ((_, good), (n, hits)) in zip(KINDS, got, strict=True)}


def added_spans(text: str, base: dict[str, list[Span]], trees: Trees) -> dict[str, list[Span]]:
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    taken = sorted(s for spans in base.values() for s in spans)
    starts = np.array([s for s, _ in taken])
    ends = np.maximum.accumulate(np.array([e for _, e in taken])) if taken else np.array([])

    def free(start: int, end: int) -> bool:
        before = int(np.searchsorted(starts, end)) if taken else 0
        return before == 0 or ends[before - 1] <= start

    found = [c for c in candidates(text) if free(c[1], c[2])]
    if not found:
        return out
    p = trees.probability(np.array([features(text, *c) for c in found]))
    last: dict[int, int] = {}
    for _, (kind, start, end) in sorted(((-q, c) for q, c in zip(p, found, strict=True) if q >= trees.thresholds[c[0]]), key=lambda x: (x[0], x[1][1] - x[1][2], x[1][1])):
        if not any(i in last for i in range(start, end)):
            last.update(dict.fromkeys(range(start, end), 1))
            out[kind].append((start, end))
    return out


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def found(docs: DataFrame, text: str = "text", trees: Trees | None = None) -> DataFrame:
    """``docs`` with ``n_email, n_ip, n_card, n_phone`` and ``base_sha256`` of the base spans, and ``spans``, all of them."""
    added = [c.split()[0] for c in FOUND.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(trees or model())

    @F.pandas_udf(FOUND)
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for x in part:
                base = base_spans(x or "")
                more = added_spans(x or "", base, shared.value)
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined({k: base[k] + more[k] for k in KINDS})))
            yield pd.DataFrame(rows, columns=added)

    marked = docs.select(columns.row(docs, *added).alias("row"), of(columns.column(text)).alias("pii"))
    return marked.select("row.*", "pii.*")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets."""
    marked = found(docs.select(columns.row(docs).alias("row"), columns.column(text).alias("text")))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for x, all_ in zip(texts, spans, strict=True):
            places = sorted(((int(s), int(e), k) for k, s, e in (p.split(":") for p in (all_ or "").split(",") if p)), reverse=True)
            edge = None
            for s, e, k in places:
                e = e if edge is None else min(e, edge)
                if s < e:
                    x = f"{x[:s]}[{k}]{x[e:]}"
                edge = s
            out.append(x)
        return pd.Series(out)

    marked = marked.select("row", cut(F.col("text"), F.col("spans")).alias("text"))
    return marked.select(*(F.col("text") if c == text else F.col("row").getField(c) for c in docs.columns)).toDF(*docs.columns)
