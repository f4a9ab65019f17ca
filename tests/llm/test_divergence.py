import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from lodestar.llm import divergence

from .tables import DOCS, odd, odd_rows


def brute(rows, least, top):
    """``(lang, source, text)`` to ``(lang, source, part, item, value, rank)``."""
    groups, docs, all_ = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        groups[lang, source].update(terms)
        all_[lang].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(n, kept=kept):
            of = sum(n[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (n[t] + 5) // of for t in kept}

        own = {s: shares(n) for (x, s), n in groups.items() if x == lang}
        whole = shares(all_[lang])
        for s in own:
            pair = [(o, sum(abs(own[s][t] - own[o][t]) for t in kept)) for o in own if o != s]
            term = [(t, own[s][t] - whole[t]) for t in kept if groups[lang, s][t] and own[s][t] > whole[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, n) for n, (i, v) in enumerate(items[:most], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def rows(seed, n=300, sources=13):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdeéЖ日"), rng.integers(1, 6))) for _ in range(120)]
    weights = rng.dirichlet(np.ones(120) * 0.3, sources)
    made = []
    for i in range(n):
        s = int(rng.integers(sources))
        made.append((i, " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choice(vocabulary, rng.integers(0, 60), p=weights[s])) + " x1y-Z", ["en", "de"][s % 2], f"s{s}", 1))
    return made


@pytest.mark.parametrize("room, width", [(2, 1 << 14), (3, 16), (8, 1 << 14)])
def test_equals_brute_force(spark, monkeypatch, room, width):
    monkeypatch.setattr(divergence, "WIDTH", width)
    made = rows(room)
    df = spark.createDataFrame(made, DOCS).repartition(5)
    assert got(divergence.audit(df, least=3, top=7, room=room)) == brute([(r[2], r[3], r[1]) for r in made], 3, 7)


def test_odd_rows(spark):
    want = brute([(r[2], r[3], r[1]) for r in odd_rows()], 1, 50)
    assert got(divergence.audit(odd(spark), least=1)) == want
    assert all(r[4] == 0 and r[2] == "pair" for r in got(divergence.audit(odd(spark))))
    assert got(divergence.audit(odd(spark, []))) == []


def test_large_counts_are_exact(spark):
    n, of = [0, 1, 7, 10**12, 4 * 10**15], 9 * 10**15 - 3
    df = spark.createDataFrame([(x,) for x in n], "n long")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(divergence.share(F.col("n"), F.lit(of))).collect()] == [1 + 10**9 * (x + 5) // of for x in n]


@pytest.mark.parametrize("blocks", [2, 4, 6, 10])
def test_all_blocks_meet_once(blocks):
    met = [tuple(sorted(p)) for r in divergence.rounds(blocks) for p in r]
    assert sorted(met) == list(combinations(range(blocks), 2))
    assert all(len({b for p in r for b in p}) == blocks for r in divergence.rounds(blocks))


def test_counts_are_handed_on_before_they_fill_memory(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(divergence, "HELD", 10)
    part = pd.DataFrame([(r[2], r[3], r[1]) for r in rows(1, 50)], columns=["lang", "source", "text"])
    parts = list(divergence._counts(iter([part])))
    assert len(parts) > 20 and all(len(p) < 100 for p in parts)
