"""Questions compiled to rows: operation, metric, group, filters and probes of each, by the same rules as one question at a time."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators import predicates, retrieval
from ..operators.schema import Column
from . import matcher, operations, rewrite

#: Numeric columns that a question means if it names none.
USUAL = ("employment", "employees", "employee", "jobs", "headcount", "investment", "amount", "capacity")
SCHEMA = """q string, kind string, direction string, exhaustive boolean, metric string, grouping string, words array<string>, unmatched boolean, related boolean, filters_key string,
filters array<struct<column: string, values: array<struct<low: string, words: array<string>>>>>, probes array<struct<terms: array<struct<term: string, times: int>>, words: array<string>>>"""


def metric(q: str, names: list[str]) -> str | None:
    """The numeric column that the question names, else a usual one, else the first that isn't an id."""
    asked = matcher.token_set(q)
    named = [c for c in names if asked & set(c.lower().split("_"))]
    usual = [c for w in USUAL for c in names if w in c.lower()]
    return next(iter([*named, *usual, *(c for c in names if "id" not in c.lower()), *names]), None)


def group(q: str, names: list[str], sizes: dict[str, int]) -> str | None:
    """A place column for counties, else the text column whose name shares most words with the question, fewest values first."""
    asked = matcher.token_set(q)
    if asked & {"county", "counties"}:
        for want in (("county",), ("location", "city", "address")):
            if hit := [c for c in names if any(w in c.lower() for w in want)]:
                return hit[0]
    shared = sorted((-len(asked & matcher.token_set(c.replace("_", " "))), sizes.get(c, 0), c) for c in names)
    return shared[0][2] if shared and shared[0][0] else None


def long_words(q: str) -> list[str]:
    """The words that may tell the group by the values of a column, where no name does."""
    return sorted(w for w in matcher.token_set(q) if len(w) >= 4)


def filters(q: str, found: matcher.Matched, resolved: matcher.Matched, columns: list[str]) -> tuple[predicates.Filters, list[tuple[str, str]]]:
    """The filters of a question without a generator, and the tiers that were dropped as they don't filter their column."""
    return without_odd_tiers(q, predicates.merged(found.filters, resolved.filters, columns))


def without_odd_tiers(q: str, given: predicates.Filters) -> tuple[predicates.Filters, list[tuple[str, str]]]:
    if not matcher.tiers(q):
        return given, []
    odd = [(c, v) for c, vs in given.items() for v in vs if operations.kind_of(v) == "tier" and not matcher.is_tier_column(c)]
    return {c: kept for c, vs in given.items() if (kept := [v for v in vs if (c, v) not in odd])}, odd


def row(q: str, index: dict[str, Column], columns: list[str], numbers: list[str], texts: list[str], strict: bool, most: int) -> dict[str, object]:
    intent = operations.effective_intent(q, strict)
    found = matcher.match(q, index)
    chosen, _ = filters(q, found, matcher.resolve(q, index), columns)
    kept = {c: [v for v in vs if v.strip()] for c, vs in chosen.items()}
    listed = [{"column": c, "values": [{"low": v.strip().lower(), "words": predicates.words_of(v)} for v in vs]} for c, vs in kept.items()]
    related = any(p in q.lower() for p in predicates.RELATIONSHIP) and "primary_oems" in kept
    grouping = group(q, texts, {c.name: c.n_values for c in index.values()}) if intent["type"] == "aggregate_sum" else None
    probes = rewrite.probes(q, index)[: most or None]
    return {
        "q": q, "kind": intent["type"], "direction": intent.get("direction", "desc"), "exhaustive": bool(operations.detect(q)["exhaustive"]), "metric": metric(q, numbers), "grouping": grouping,
        "words": long_words(q) if intent["type"] == "aggregate_sum" and not grouping else [], "unmatched": bool(found.unmatched), "related": related,
        "filters_key": json.dumps([[[f["column"], [v["low"] for v in f["values"]]] for f in listed], related]), "filters": listed,
        "probes": [{"terms": [{"term": t, "times": n} for t, n in Counter(p.lower().split()).items()], "words": [w for w in retrieval.words_asked(p) if w]} for p in probes],
    }


def table(asked: DataFrame, index: dict[str, Column], columns: list[str], numbers: list[str], texts: list[str], strict: bool, most: int) -> DataFrame:
    """A row for each question of ``asked(q, named)``; ``named`` holds column, value and part of values too many to hold that the question names."""
    many = [c.name for c in index.values() if not c.held and c.filterable]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                named = {c: [sorted(x["value"] for x in r["named"] or [] if x["column"] == c and x["part"] == part) for part in (False, True)] for c in many}
                known = index | {c: replace(index[c], values=tuple(v), parts=tuple(p)) for c, (v, p) in named.items()}
                out.append(row(r["q"], known, columns, numbers, texts, strict, most))
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    return asked.mapInArrow(compiled, SCHEMA)
