"""Which values of the table a question names, and in which columns they may filter."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..operators.schema import Column
from . import operations

#: Question words that are never terms.
STOP_WORDS = (
    "in", "the", "and", "or", "a", "an", "of", "to", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "shall", "can", "which", "what", "where", "who", "how", "when", "all", "show", "list", "give", "find", "tell", "me", "their",
    "its", "with", "for", "by", "from", "on", "at", "that", "this", "these", "those", "each", "any", "only", "also", "both", "georgia", "company", "companies",
    "supplier", "suppliers", "linked", "related", "associated", "across", "among", "including", "such", "into", "not", "no", "full", "set", "complete", "entire", "total",
    "count", "number", "highest", "lowest", "most", "least", "top", "bottom",
)
GENERIC = (
    "supplier", "company", "companies", "manufacturer", "manufacturers", "provider", "providers", "facility", "facilities",
)
LEAST = 3


@dataclass
class Matched:
    filters: dict[str, list[str]] = field(default_factory=dict)
    kinds: dict[tuple[str, str], str] = field(default_factory=dict)
    unmatched: list[str] = field(default_factory=list)
    candidates: list[tuple[str, str]] = field(default_factory=list)
    rejected: list[tuple[str, str, str]] = field(default_factory=list)

    def to_debug_dict(self) -> dict[str, object]:
        return {"perfect": self.kinds, "candidate": self.candidates, "rejected": self.rejected, "deterministic_filters": self.filters}


def flat(s: str) -> str:
    return re.sub(r"[\s/]+", " ", s.lower()).strip()


def tiers(q: str) -> set[str]:
    pairs = re.findall(r"\btier\s*(\d+)\s*(?:/|and|or|&|,)\s*(?:tier\s*)?(\d+)\b", q.lower())
    return {n for pair in pairs for n in pair} | set(re.findall(r"\btier\s*(\d+)\b", q.lower()))


def slash_phrases(q: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?:[a-z]+\s+)?\d+/\d+|[a-z]+/[a-z]+", q.lower())))


def token_set(s: str) -> set[str]:
    found = re.findall(r"[a-z0-9]+(?:/[a-z0-9]+)?", s.lower())
    single = [t[:-3] + "y" if t.endswith("ies") and len(t) > 4 else t[:-1] if t.endswith("s") and not t.endswith("ss") and len(t) > 3 else t for t in found]
    return {*found, *single}


def is_tier_column(column: str) -> bool:
    name = re.sub(r"[^a-z0-9]+", "_", column.lower())
    return any(k in name for k in operations.COLUMNS["tier"])


def without_conflicts(values: list[str], kinds: dict[str, str], q: str) -> list[str]:
    """A value that a slash phrase of the question names anchors the column: what only expansion found, and what is part of an anchor, goes."""
    asked = [(p, flat(p)) for p in slash_phrases(q)]
    anchors = [v for v in values if any(p in v.lower() or f in flat(v) for p, f in asked)]
    if not anchors:
        return values
    inside = lambda v: any(flat(v) != flat(a) and flat(v) in flat(a) for a in anchors)
    return [v for v in values if v in anchors or not kinds.get(v, "").startswith(("tier_", "soft_")) and not inside(v)]


def longest_first(values: list[str]) -> list[str]:
    """Without values that begin a longer one that is kept."""
    kept: list[str] = []
    for v in sorted(values, key=lambda v: (-len(v), v)):
        if not any(k.lower().startswith(v.lower()) and k.lower() != v.lower() for k in kept):
            kept.append(v)
    return kept


def match(q: str, index: dict[str, Column]) -> Matched:
    """Values found whole, by tier number, by all their words, or by a part of theirs between commas."""
    low, asked, out = q.lower(), tiers(q), Matched()
    spread = token_set(" ".join([low, flat(low), *(f"tier {t}" for t in sorted(asked))]))
    for c in (m for m in index.values() if m.filterable and m.match != "numeric"):
        kinds: dict[str, str] = {}
        for v in c.values:
            if len(v) >= LEAST and v.lower() in low:
                kinds[v] = c.match
            elif asked and is_tier_column(c.name) and any(re.search(rf"\btier\s*{t}\b", v.lower()) for t in asked):
                kinds[v] = f"tier_{c.match}"
            elif ("/" in q or asked) and (words := token_set(v)) and (not asked or is_tier_column(c.name)) and (words - set(GENERIC) or words) <= spread:
                kinds[v] = f"soft_{c.match}"
        for p in c.parts:
            if len(p) >= LEAST and p.lower() in low and p not in kinds:
                kinds[p] = "component"
        values = longest_first(without_conflicts(list(kinds), kinds, q) if "/" in q else list(kinds))
        if values:
            out.filters[c.name] = values
            out.kinds |= {(c.name, v): kinds[v] for v in values}
    exact = [v.lower() for c, vs in out.filters.items() if index[c].match == "exact" for v in vs]
    for c in [c for c in out.filters if index[c].match == "partial"]:
        out.filters[c] = [v for v in out.filters[c] if not any(v.lower() != e and v.lower() in e for e in exact)]
        if not out.filters[c]:
            del out.filters[c]
    named = " ".join(v.lower() for vs in out.filters.values() for v in vs)
    words = [w.strip(".,;?!\"'()[]{}:").lower() for w in q.split()]
    out.unmatched = [w for w in words if len(w) >= LEAST and w not in STOP_WORDS and w not in named]
    return out


def ngrams(q: str, longest: int = 6) -> list[str]:
    t = re.findall(r"[A-Za-z0-9]+(?:/[A-Za-z0-9]+)*", q)
    return [g for n in range(longest, 0, -1) for i in range(len(t) - n + 1) if len(g := " ".join(t[i : i + n])) >= LEAST]


def live_values(q: str, index: dict[str, Column], longest: int = 6, top: int = 10, keep: Callable[[str, str], bool] | None = None) -> list[tuple[float, str, str, str]]:
    """``score, column, value, phrase`` of the columns and values that ``keep`` takes: 3 for the value itself, 2 for it but for spaces and slashes, 1 for a part; longer phrases first."""
    grams = sorted(ngrams(q, longest), key=len)
    whole, lows, flats = " ".join(re.findall(r"[A-Za-z0-9]+(?:/[A-Za-z0-9]+)*", q)).lower(), {}, {}
    for g in grams:
        lows.setdefault(g.lower(), g)
        flats.setdefault(flat(g), g)
    out = []
    for c in (m for m in index.values() if m.filterable):
        for v in (x for x in c.values if keep is None or keep(c.name, x)):
            low = v.lower()
            if g := lows.get(low):
                s = 3
            elif g := flats.get(flat(v)):
                s = 2
            elif len(v) >= LEAST and low in whole:
                s, g = 1, next((g for g in grams if low in g.lower()), None)
            if g:
                out.append((s + len(v) / 100, c.name, v, g))
    return sorted(out, key=lambda x: (-x[0], x[1], x[2]))[:top]


def is_column_name(phrase: str, index: dict[str, Column]) -> bool:
    name = re.sub(r"[^a-z0-9]+", "_", phrase.lower()).strip("_")
    return name in index or any(name == re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_") for c in index)


def resolve(q: str, index: dict[str, Column], longest: int = 6) -> Matched:
    """Values that may filter without asking back (perfect), those that might (candidates), and those turned down, with reasons."""
    out, covered = Matched(), set()
    found = live_values(q, index, longest, 10**6)
    asked = tiers(q)
    have = {(c, v) for _, c, v, _ in found}
    found += [(0.5 + len(v) / 100, c.name, v, f"tier {t}") for c in index.values() if is_tier_column(c.name) for v in c.values for t in sorted(asked) if (c.name, v) not in have and re.search(rf"\btier\s*{t}\b", v.lower())]
    phrases = [flat(p) for p in slash_phrases(q)]
    anchors = {v for _, _, v, _ in found if any(flat(v) == p or p in flat(v) for p in phrases)}
    for score, column, value, phrase in found:
        if is_column_name(value, index):
            out.rejected.append((column, value, "column name"))
        elif operations.is_analytical_phrase(value):
            out.rejected.append((column, value, "analytical"))
        elif not operations.fits_column(phrase if score < 1 else value, column):
            out.rejected.append((column, value, "incompatible column"))
        elif score < 1 or value not in anchors and any(flat(value) in flat(a) for a in anchors) or (column, phrase.lower()) in covered:
            out.candidates.append((column, value))
        else:
            covered.add((column, phrase.lower()))
            out.filters.setdefault(column, []).append(value)
            out.kinds[column, value] = "exact" if score >= 3 else "normalised" if score >= 2 else "contains"
    return out
