"""Document quality by Bradley-Terry pairwise ranking.

Each document has a strength, linear in features of its format and its words. Preference pairs (a document
labelled good over one labelled bad) are fitted by logistic loss on the difference of their features.
The cut is a quantile of the strengths: the share of bad labels. The score is a logistic curve of the strength,
laid so that the cut scores ``CUT``.

Fitted on a bounded sample of labelled rows (``rows``) and a bounded number of pairs drawn from it (``pairs``).
Defined results: null texts count as empty; without labels of both kinds every score is 0.5. Repeated rows score
alike, an empty table gives an empty result, and very long texts are measured whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample

CUT = 0.3


def _classes() -> np.ndarray:
    """By byte: upper case, lower case, digit, end mark, exclamation, bar, other symbol, line end, beyond ASCII."""
    out = np.zeros((256, 9))
    for byte in range(256):
        c = chr(byte)
        if byte >= 128:
            out[byte, 8] = 1
        elif c.isupper():
            out[byte, 0] = 1
        elif c.islower():
            out[byte, 1] = 1
        elif c.isdigit():
            out[byte, 2] = 1
        elif c in ".,;:?":
            out[byte, 3] = 1
        elif c == "!":
            out[byte, 4] = 1
        elif c == "|":
            out[byte, 5] = 1
        elif c == "\n":
            out[byte, 7] = 1
        elif c.isprintable() and c != " ":
            out[byte, 6] = 1
    return out


CLASSES = _classes()


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, chars = len(words), max(1, len(raw))
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASSES / chars
    count = Counter(words)
    again = sum(map(bytes.__eq__, words, words[1:])) / max(1, n)
    most = max(count.values(), default=0) / max(1, n)
    lines = raw.split(b"\n")
    repeated = 1 - len(set(lines)) / len(lines)
    distinct = np.log1p(len(count)) / np.log1p(max(1, n))
    length = min(30.0, chars / max(1, n))
    capital = share[0] / max(1e-9, share[0] + share[1] + share[8])
    few = float(n < 5)
    return np.concatenate([np.sqrt(share), [np.sqrt(again), most, repeated, distinct, length, capital, np.sqrt(capital), few, min(12.0, np.log1p(n))]])


WIDTH = 18


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.cut + np.log(CUT / (1 - CUT)), -30, 30)))


def fit(x: np.ndarray, labels: np.ndarray, pairs: int, steps: int = 25, ridge: float = 1e-3) -> Ranking:
    """Newton steps on the logistic loss of the pairs' feature differences."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    width = x.shape[1]
    if not len(good) or not len(bad):
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(11)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(width)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        slope = d.T @ p / pairs - ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(width)
        w = w + np.linalg.solve(curve, slope)
    model = Ranking(mean, scale, w, 0.0)
    ranked = np.sort(model.strength(x))
    model.cut = float((ranked[len(bad) - 1] + ranked[min(len(bad), len(x) - 1)]) / 2)
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = 20_000, pairs: int = 40_000) -> Ranking:
    """Fit on at most ``rows`` labelled documents; the executors measure them."""

    def measured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "x": [features(t).tolist() for t in part["text"]], "label": part["label"]})

    sample = labelled_sample(docs, labels, "quality", usable, rows)
    got = sample.mapInPandas(measured, "doc_id long, x array<double>, label int").toPandas().sort_values("doc_id")
    x = np.array([list(v) for v in got["x"]], float).reshape(len(got), WIDTH)
    return fit(x, got["label"].to_numpy(), pairs)


def scores(docs: DataFrame, model: Ranking, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            x = np.array([features(t) for t in part]).reshape(len(part), WIDTH)
            yield pd.Series(shared.value.score(x), dtype="float64")

    return docs.withColumn("score", score(F.col(text)))


def accepted(docs: DataFrame, model: Ranking, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``CUT`` or more, with their columns."""
    named = docs.withColumnsRenamed({c: "kept score" for c in docs.columns if c.lower() == "score"})
    kept = scores(named, model, text).where(F.col("score") >= CUT).drop("score")
    return kept.withColumnsRenamed({"kept score": c for c in docs.columns if c.lower() == "score"})
