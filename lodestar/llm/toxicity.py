"""Toxicity by a factorization machine over hashed terms.

A document's terms are its lower-cased words and the first four letters of longer ones, each hashed and
counted once. The score adds a weight for every term and a product of factors for every pair of terms,
so that an insult next to a mention of a group can weigh more than both alone.

Fitted on a bounded sample of labelled rows (``rows``), twice. First with all terms that ``LEAST`` rows hold: the weights alone for some passes, then
weights and factors. The ``terms`` whose weights and pairs moved the margins most stay, so that a term that tells nothing alone stays for its pairs. So do all
terms, in whatever number, that go with a label more often than chance allows, among all rows or beside one of the ``CONTEXTS`` strongest terms (``telling``):
rare insults that are toxic beside a group only. How much of that may be chance is tried by ``CHANCE``, up to all terms, and the fit with the least loss on rows
kept out is taken. Every fifth row is kept out of both, and a logistic curve
over its margins makes the score a probability. Defined results: null and empty texts get the score of no terms; if no row
is labelled, or all labels agree, the score is the smoothed share of label 1 for every text.
Repeated rows get equal scores, ties can't arise, an empty table gives an empty result, and a very
long text is scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample

WORD = re.compile(r"\w+")
BUCKETS = 1 << 20
#: Rows that must hold a term.
LEAST = 3
#: Terms beside which others are tested, and the shares of tests passed that chance may make up; None takes all terms.
CONTEXTS, CHANCE = 16, (0.05, 0.5, 0.9, None)
#: Terms remembered by a worker before it starts afresh; bounds its memory.
REMEMBERED = 300_000
#: Rows whose terms are weighed at once; bounds the driver's memory.
AT_ONCE = 256


def hashed(word: str) -> tuple[int, ...]:
    """The buckets of a word's terms."""
    whole = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
    if len(word) < 5:
        return (whole,)
    return (whole, zlib.crc32(b"^" + word[:4].encode("utf-8", "surrogatepass")) % BUCKETS)


class Terms:
    """The distinct buckets of a text, with a bounded memory of the words seen."""

    def __init__(self, slots: np.ndarray | None = None):
        self.slots, self.seen = slots, {}

    def _of(self, word: str) -> tuple[int, ...]:
        found = hashed(word)
        if self.slots is not None:
            found = tuple(s for s in self.slots[list(found)].tolist() if s >= 0)
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen[word] = found
        return found

    def __call__(self, text: str | None) -> list[int]:
        seen, of, out = self.seen, self._of, set()
        for word in set(WORD.findall((text or "").lower())):
            found = seen.get(word)
            out.update(of(word) if found is None else found)
        return sorted(out)


@dataclass
class FactorizationMachine:
    """``slots`` maps a bucket to its place among the weights, or -1; ``slope`` and ``shift`` lay the score over the margin."""

    slots: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, rows: Sequence[Sequence[int]]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        for at in range(0, len(rows), AT_ONCE):
            flat, starts, full = _flat(rows[at : at + AT_ONCE])
            if len(flat):
                f = self.factors[flat]
                s, q = np.add.reduceat(f, starts, axis=0), np.add.reduceat(f * f, starts, axis=0)
                out[at : at + AT_ONCE][full] += np.add.reduceat(self.weights[flat], starts) + 0.5 * (s * s - q).sum(axis=1)
        return out

    def score(self, rows: Sequence[Sequence[int]]) -> np.ndarray:
        return _logistic(self.slope * self.margin(rows) + self.shift)


def _logistic(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _flat(rows: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms of all rows end to end in 32 bits, where those of each full row begin, and which rows are full."""
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.empty(int(lengths.sum()), np.int32)
    for start, r in zip((np.cumsum(lengths) - lengths).tolist(), rows, strict=True):
        flat[start : start + len(r)] = r
    full = lengths > 0
    return flat, (np.cumsum(lengths) - lengths)[full], full


class Rows:
    """The terms of rows end to end, as places among ``size`` weights; terms without a place are left out."""

    def __init__(self, rows: Sequence[Sequence[int]], slots: np.ndarray):
        mine = [p[p >= 0] for p in (slots[np.asarray(r, np.int32)] for r in rows)]
        self.place, self.count, self.size = _flat(mine)[0], np.array([len(p) for p in mine], np.int64), int(slots.max(initial=-1)) + 1
        self.start = np.cumsum(self.count) - self.count

    def batch(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms of some rows, and for each the row's place among them."""
        n = self.count[rows]
        of = np.repeat(np.arange(len(rows)), n)
        return self.place[np.repeat(self.start[rows] - (np.cumsum(n) - n), n) + np.arange(len(of))], of


def _sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(of, values[:, k], n) for k in range(values.shape[1])], axis=1)


def _descend(x: Rows, y: np.ndarray, factors: int, passes: int, alone: int, batch: int = 64, rate: float = 0.1, decay: float = 0.01, pair_decay: float = 0.3) -> tuple[float, np.ndarray, np.ndarray]:
    """AdaGrad steps on the logistic loss over shuffled batches with a fixed seed; in the first ``alone`` passes weights only."""
    rng = np.random.default_rng(7)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    b, w, v = float(np.log(prior / (1 - prior))), np.zeros(x.size), rng.normal(0, 0.02, (x.size, factors))
    gb, gw, gv = 1e-4, np.full(x.size, 1e-4), np.full((x.size, factors), 1e-4)
    for turn in range(passes):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            n = len(part)
            term, of = x.batch(part)
            mine = v[term]
            sums = _sums(of, mine, n)
            pairs = 0.5 * ((sums * sums).sum(axis=1) - np.bincount(of, (mine * mine).sum(axis=1), n)) if turn >= alone else 0.0
            error = _logistic(b + np.bincount(of, w[term], n) + pairs) - y[part]
            gb += error.mean() ** 2
            b -= rate * error.mean() / np.sqrt(gb)
            used, place = np.unique(term, return_inverse=True)
            e = error[of] / n
            dw = np.bincount(place, e, len(used)) + decay * w[used] / n
            gw[used] += dw * dw
            w[used] -= rate * dw / np.sqrt(gw[used])
            if turn >= alone:
                dv = _sums(place, e[:, None] * (sums[of] - mine), len(used)) + pair_decay * v[used] / n
                gv[used] += dv * dv
                v[used] -= 0.2 * rate * dv / np.sqrt(gv[used])
    return b, w, v


def _moved(x: Rows, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """By term: the squares of what it adds to the margins, its pairs included, over all rows."""
    out = np.zeros(x.size)
    for at in range(0, len(x.count), 256):
        rows = np.arange(at, min(at + 256, len(x.count)))
        term, of = x.batch(rows)
        mine = v[term]
        out += np.bincount(term, (w[term] + (mine * (_sums(of, mine, len(rows))[of] - mine)).sum(axis=1)) ** 2, x.size)
    return out


def _unlikely(n: np.ndarray, k: np.ndarray, share: float) -> np.ndarray:
    """The logarithm of a bound on the chance that ``k`` of ``n`` have a label that ``share`` of all have (Chernoff)."""
    q = k / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(q > 0, q * np.log(q / share), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - share)), 0)
    return np.minimum(0, np.log(2) - n * far)


def telling(rows: Sequence[Sequence[int]], y: np.ndarray, chances: tuple[float, ...]) -> list[np.ndarray]:
    """The terms that go with a label more often than chance, alone or beside or without a strong term; of the tests passed about each of ``chances`` are chance (Benjamini-Hochberg)."""
    flat, _, _ = _flat(rows)
    of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    held = np.bincount(flat, minlength=BUCKETS)
    terms = np.flatnonzero(held)
    place = (np.cumsum(held > 0, dtype=np.int32) - 1)[flat]
    del flat

    def tests(mine: np.ndarray) -> np.ndarray:
        share, at = y[mine].mean() if mine.any() else 0.0, mine[of]
        if not 0 < share < 1:
            return np.zeros(len(terms))
        n = np.bincount(place[at], minlength=len(terms))
        return np.where(n >= LEAST, _unlikely(n, np.bincount(place[at & bad], minlength=len(terms)), share), 0.0)

    bad = (y == 1)[of]
    alone = tests(np.ones(len(rows), bool))
    held = held[terms]
    strong = [c for c in np.argsort(alone, kind="stable")[:CONTEXTS] if alone[c] < -10 and held[c] >= 0.01 * len(rows)]
    beside = []
    for c in strong:
        has = np.zeros(len(rows), bool)
        has[of[place == c]] = True
        beside += [tests(has), tests(~has)]
    all_ = np.concatenate([alone, *beside])
    real = np.sort(all_[all_ < 0])
    out = []
    for chance in chances:
        passed = np.flatnonzero(real <= np.log(chance * np.arange(1, len(real) + 1) / max(1, len(all_))))
        out.append(terms[np.unique(np.flatnonzero(all_ <= real[passed[-1]]) % len(terms))] if len(passed) else np.zeros(0, np.int64))
    return out


def _curve(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve over the margins, by Newton steps towards smoothed labels."""
    ones = y.sum()
    goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    x, a = np.stack([margin, np.ones(len(y))], axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = _logistic(x @ a)
        a = a - np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + 1e-6 * np.eye(2), x.T @ (p - goal))
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


def fit(rows: Sequence[Sequence[int]], labels: np.ndarray, terms: int, factors: int, steps: int = 1200) -> FactorizationMachine:
    """The machine of a sample; ``steps`` batches at least are taken in the first fit, twice as many in the second."""
    y = np.asarray(labels, float)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    slots = np.full(BUCKETS, -1, np.int32)
    bias, w, v = float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, factors))
    if not 0 < y.sum() < len(y):
        return FactorizationMachine(slots, bias, w, v)
    out = np.arange(len(y)) % 5 == 4
    mine = [r for r, o in zip(rows, out, strict=True) if not o]
    held = np.bincount(_flat(mine)[0], minlength=BUCKETS)
    known = np.flatnonzero(held >= LEAST)
    passes = max(8, -(-steps * 64 // max(1, len(mine))))

    def fitted(places: np.ndarray, passes: int, alone: int) -> tuple[FactorizationMachine, Rows]:
        slots = np.full(BUCKETS, -1, np.int32)
        slots[places] = np.arange(len(places))
        x = Rows(mine, slots)
        return FactorizationMachine(slots, *_descend(x, y[~out], factors, passes, alone)), x

    def placed(model: FactorizationMachine, which: np.ndarray) -> list[np.ndarray]:
        return [p[p >= 0] for p in (model.slots[np.asarray(rows[i], np.int32)] for i in np.flatnonzero(which))]

    first, x = fitted(known, passes, passes // 2)
    moved = known[np.argsort(-_moved(x, first.weights, first.factors), kind="stable")[:terms]]
    del first, x
    trial = np.arange(len(y)) % 10 == 4
    best, least, size = None, np.inf, 0
    for more in [*telling(mine, y[~out], tuple(c for c in CHANCE if c)), *([known] if None in CHANCE else [])]:
        places = np.union1d(moved, more)
        if len(places) < 1.1 * size:
            continue
        size = len(places)
        model, _ = fitted(places, 2 * passes, passes // 2)
        margin = model.margin(placed(model, trial))
        loss = float(np.logaddexp(0, np.where(y[trial] == 1, -margin, margin)).mean()) if trial.any() else 0.0
        if loss < least:
            best, least = model, loss
    model = best
    if 0 < y[out].sum() < out.sum():
        model.slope, model.shift = _curve(model.margin(placed(model, out)), y[out])
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = 12_000, terms: int = 512, factors: int = 4) -> FactorizationMachine:
    """Fit on at most ``rows`` labelled documents; their terms are hashed by the executors."""

    def terms_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Terms()
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "terms": [of(x) for x in part["text"]], "label": part["label"]})

    sample = labelled_sample(docs, labels, "toxic", usable, rows)
    got = sample.mapInPandas(terms_of, "doc_id long, terms array<int>, label int").toArrow().combine_chunks()
    ids, held, labels_ = (got[c].combine_chunks() for c in got.column_names)
    flat, edges = held.values.to_numpy(), held.offsets.to_numpy()
    order = np.argsort(ids.to_numpy(), kind="stable")
    return fit([flat[edges[i] : edges[i + 1]] for i in order.tolist()], labels_.to_numpy()[order], terms, factors)


def scores(docs: DataFrame, model: FactorizationMachine, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Terms(shared.value.slots)
        for part in parts:
            yield pd.Series(shared.value.score([of(x) for x in part]), dtype="float64")

    return docs.withColumn("score", score(F.col(text)))
