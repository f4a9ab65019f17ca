"""Rewriting of questions for retrieval, with guards that keep a generator to the table's own vocabulary.

A generator is anything with ``generate(prompt) -> str``; without one, or when what it says can't be used, the question itself and
its phrases are the probes.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from typing import Protocol

from ..operators.schema import Column
from . import matcher, operations

#: The keys that each stage's answer must have.
PROBE_KEYS = ("intent", "target_columns", "probe_queries", "explicit_filters", "is_broad")
QUERY_KEYS = ("final_rewritten_queries", "confidence", "mapped_user_phrases")
#: What a question may be about.
INTENTS = ("list", "count", "compare", "group", "supplier_discovery", "location", "relationship", "yes_no", "other")
#: Words that any query may hold.
ANY_QUERY = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "company", "companies", "complete", "count", "county", "counties", "each", "every", "for", "from", "give", "has", "have", "highest", "how",
    "in", "include", "including", "is", "list", "location", "locations", "map", "most", "of", "only", "or", "provide", "related", "role", "roles", "show", "single", "supplier", "suppliers",
    "their", "the", "them", "to", "total", "under", "what", "which", "with", "within", "filter", "match", "matches", "query", "search",
)
MOST_PROBES, MOST_QUERIES, MOST_UNKNOWN, MOST_TERMS, ATTEMPTS = 10, 6, 2, 30, 2
#: What names the whole table's place, and where that is noted.
EVERYWHERE = ("georgia", "ga", "state of georgia")
SCOPE = "__dataset_scope"


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


def first_object(said: str) -> dict | None:
    """The first JSON object of a text, whatever stands around it."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", said or ""):
        try:
            value, _ = decoder.raw_decode(said, m.start())
        except ValueError:
            continue
        return value if isinstance(value, dict) else None
    return None


def asked(generator: Generator | None, prompt: str, keys: tuple[str, ...]) -> dict | None:
    for _ in range(ATTEMPTS if generator else 0):
        found = first_object(generator.generate(prompt))
        if found is not None and set(keys) <= set(found):
            return found
    return None


def as_list(value: object, most: int | None = None) -> list[str]:
    """Nothing, one value or several as distinct strings, without blank ones, in order."""
    items = [] if value is None else value if isinstance(value, list | tuple | set) else [value]
    return list(dict.fromkeys(t for v in items if (t := str(v).strip())))[:most]


def as_bool(value: object, default: bool = False) -> bool:
    if isinstance(value, str):
        return value.strip().lower() in ("true", "yes", "1")
    return value if isinstance(value, bool) else default


def plain_name(name: object) -> str:
    return re.sub(r"[^a-z0-9]+", "_", str(name).lower()).strip("_")


def target_columns(said: object, index: dict[str, Column]) -> list[str]:
    """The columns that a generator named, whatever their spelling; made-up ones are left out."""
    real = {plain_name(c): c for c in index}
    return list(dict.fromkeys(real[k] for c in as_list(said) if (k := plain_name(c)) in real))


def explicit_filters(said: object, index: dict[str, Column], everywhere: tuple[str, ...] = EVERYWHERE) -> dict[str, str]:
    """Filters on real columns. What holds for the whole table (its state, say) is noted under ``SCOPE`` and filters no place."""
    out: dict[str, str] = {}
    for name, value in said.items() if isinstance(said, dict) else ():
        value, column = str(value).strip(), next(iter(target_columns([name], index)), None)
        scope = column is None and plain_name(name) in ("dataset_scope", "scope", "kb_scope")
        wide = column is not None and value.lower() in everywhere and any(w in plain_name(column) for w in ("location", "county", "city"))
        if value and (scope or wide):
            out[SCOPE] = value
        elif value and column:
            out[column] = value
    return out


@dataclass(frozen=True)
class Mapped:
    phrase: str
    terms: tuple[str, ...]
    confidence: str


def mapped_phrases(said: object, discovered: dict[str, list[str]]) -> tuple[list[Mapped], list[str]]:
    """A generator's phrases with those of their terms that were found in columns which such a phrase may mean, and what was refused.

    ``discovered`` has each found term's columns. A phrase that loses terms is less trusted, and so is one for which names of columns alone stand;
    one that asks for an operation maps to nothing.
    """
    if not isinstance(said, list):
        return [], ["not a list"]
    known, names = {t.lower(): t for t in discovered}, {c for columns in discovered.values() for c in columns}
    out, refused = [], []
    for item in (x for x in said if isinstance(x, dict)):
        phrase, asked_ = str(item.get("user_phrase", "")).strip(), as_list(item.get("kb_supported_terms"), MOST_TERMS)
        kind = operations.kind_of(phrase)
        if kind == "analytical":
            refused.append(f"operation: {phrase}")
            continue
        fits = lambda t: kind == "general" or not discovered[t] or any(operations.fits_column(phrase, c) for c in discovered[t])  # noqa: E731, B023
        kept = [known[t.lower()] for t in asked_ if t.lower() in known and fits(known[t.lower()])]
        refused += [f"term: {t}" for t in asked_ if known.get(t.lower()) not in kept]
        said_ = str(item.get("confidence", "")).strip().lower()
        trust = said_ if said_ in ("low", "medium", "high") else "low"
        trust = "low" if asked_ and not kept else "medium" if len(kept) < len(asked_) and trust == "high" else trust
        trust = "low" if kept and all(re.sub(r"[^a-z0-9]+", "_", t.lower()).strip("_") in names for t in kept) else trust
        out.append(Mapped(phrase, tuple(dict.fromkeys(kept)), trust))
    return out, refused


def schema_lines(index: dict[str, Column]) -> str:
    return "\n".join(f"- {c.name}: {c.match}" + (", filterable" if c.filterable else "") for c in index.values())


@dataclass(frozen=True)
class Rewritten:
    """What a question is searched by, and what a generator takes it to mean; what no generator confirms is trusted least."""

    queries: list[str]
    intent: str = "other"
    targets: list[str] = field(default_factory=list)
    filters: dict[str, str] = field(default_factory=dict)
    mapped: list[Mapped] = field(default_factory=list)
    exhaustive: bool = False
    confidence: str = "low"
    warnings: list[str] = field(default_factory=list)


def intent_of(said: object, q: str) -> str:
    """A generator's intent where it is a known one, else one by the question's words."""
    if known := [x for x in as_list(said) if x in INTENTS]:
        return known[0]
    kind = operations.detect(q)["operation"]
    return "count" if kind == "count" else "group" if kind == "aggregate_sum" else "supplier_discovery" if operations.found(q, (r"suppliers?", "company", "companies")) else "other"


def first(q: str, index: dict[str, Column], generator: Generator | None = None) -> Rewritten:
    """The first stage sees names of columns alone: probes, the question itself the first of them."""
    said = asked(generator, f"Question: {q}\nColumns:\n{schema_lines(index)}\nAnswer as JSON with keys {', '.join(PROBE_KEYS)}.", PROBE_KEYS)
    if said is None:
        warned = ["no probes from the generator"] if generator else []
        return Rewritten(list(dict.fromkeys([q, *matcher.ngrams(q)[:3]])), intent_of(None, q), warnings=warned)
    intent = intent_of(said["intent"], q)
    broad = as_bool(said["is_broad"], True) or bool(operations.detect(q)["exhaustive"]) or intent in ("count", "group", "supplier_discovery", "list")
    queries = list(dict.fromkeys([q, *as_list(said["probe_queries"])]))[:MOST_PROBES]
    return Rewritten(queries, intent, target_columns(said["target_columns"], index), explicit_filters(said["explicit_filters"], index), exhaustive=broad)


def probes(q: str, index: dict[str, Column], generator: Generator | None = None) -> list[str]:
    return first(q, index, generator).queries


def supported(query: str, q: str, terms: list[str]) -> bool:
    """A query may hold one word at most, in one number or the other, that neither the question nor the found terms have, words of any query aside."""
    known = matcher.token_set(" ".join([q, *terms, *ANY_QUERY]))
    return len({t for t in re.findall(r"[a-z0-9]+(?:/[a-z0-9]+)?", query.lower()) if len(t) >= 3 and not matcher.token_set(t) & known}) < MOST_UNKNOWN


def second(q: str, index: dict[str, Column], begun: Rewritten, discovered: dict[str, list[str]], generator: Generator | None = None) -> Rewritten:
    """The second stage sees the terms that the probes' rows use, and may say no others. ``discovered`` has each term's columns.

    Without an answer, the question and the first probes stay. A refused query, or no term at all, lowers the trust.
    """
    terms = list(discovered)
    held = ", ".join(f"{c} = {v}" for c, v in begun.filters.items()) or "none"
    prompt = f"Question: {q}\nColumns:\n{schema_lines(index)}\nProbes: {'; '.join(begun.queries)}\nFilters: {held}\nTerms: {', '.join(terms)}\nAnswer as JSON with keys {', '.join(QUERY_KEYS)}."
    said = asked(generator, prompt, QUERY_KEYS)
    operation = operations.detect(q)
    if said is None:
        return replace(begun, queries=begun.queries[:5], exhaustive=bool(operation["exhaustive"]) or begun.intent in ("count", "group"), warnings=[*begun.warnings, "question and probes only", f"{len(terms)} terms found"])
    known = [*terms, *begun.filters.values(), *(c.replace("_", " ") for c in index)]
    given = as_list(said["final_rewritten_queries"])
    kept = [x for x in given if supported(x, q, known)]
    refused = [f"query: {x}" for x in given if x not in kept]
    mapped, lost = mapped_phrases(said["mapped_user_phrases"], discovered)
    intent = intent_of(said.get("intent", begun.intent), q)
    trust = str(said["confidence"]).strip().lower()
    return Rewritten(
        list(dict.fromkeys([q, *kept]))[:MOST_QUERIES],
        intent,
        target_columns(said.get("target_columns"), index) or begun.targets,
        begun.filters,
        mapped,
        as_bool(said.get("requires_exhaustive_retrieval")) or bool(operation["exhaustive"]) or intent in ("count", "group"),
        trust if trust in ("medium", "high") and not refused and terms else "low",
        [*begun.warnings, *as_list(said.get("warnings"), MOST_TERMS), *refused, *lost],
    )


def queries(q: str, index: dict[str, Column], terms: list[str], generator: Generator | None = None) -> list[str]:
    return second(q, index, Rewritten(probes(q, index)), {t: [] for t in terms}, generator).queries
