"""Filters over a table: a column's values are alternatives, columns must all agree.

Choices that depend on the data (equality or part, one filter or all) are made from the counts of one aggregate over the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import schema as sc

Filters = dict[str, list[str]]
#: Business words too general to match alone, and phrases that ask for a relationship.
GENERAL_NAMES = (
    "corp", "inc", "llc", "ltd", "co", "group", "automotive", "manufacturing", "industries", "international", "america", "americas", "holdings", "enterprise",
    "enterprises", "company", "systems",
)
RELATIONSHIP = ("linked to", "supplier of", "supply chain", "supplier network", "connected to", "supplies to", "works with", "partners with")
#: Fixed value: a part that hits this few rows is widened to its words.
FEW = 2


def _low(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit("Unknown")))


def equal(column: str, value: str) -> Column:
    return F.trim(_low(column)) == value.strip().lower()


def part(column: str, value: str) -> Column:
    return F.contains(_low(column), F.lit(value.strip().lower()))


def words_of(value: str) -> list[str]:
    return [w for w in value.lower().replace(",", " ").replace(".", " ").split() if len(w) >= 4 and w not in GENERAL_NAMES]


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


class Chosen:
    """Predicates for a set of filters over a table, from one counting pass."""

    def __init__(self, df: DataFrame, filters: Filters, match: dict[str, str]):
        self.filters = {c: [v for v in vs if str(v).strip()] for c, vs in filters.items() if c in match and c in df.columns}
        self.match, self.df = match, df
        wanted = [(c, v) for c, vs in self.filters.items() for v in vs]
        aggs = [F.count_if(t(c, v)).alias(f"{k}{i}") for i, (c, v) in enumerate(wanted) for k, t in (("e", equal), ("p", part))]
        row = df.agg(*aggs).first() if aggs else {}
        self.counts = {cv: (row[f"e{i}"], row[f"p{i}"]) for i, cv in enumerate(wanted)}

    def value(self, column: str, value: str, widen: bool = False) -> Column:
        exact, partial = self.counts[column, value]
        if self.match[column] == "exact" and exact:
            return equal(column, value)
        if widen and partial <= FEW:
            return any_of([part(column, value), *(part(column, w) for w in words_of(value))])
        return part(column, value)

    def column(self, column: str, widen: bool = False) -> Column:
        return any_of([self.value(column, v, widen) for v in self.filters[column]])

    def every(self) -> Column:
        return all_of([self.column(c) for c in self.filters])


def filtered(df: DataFrame, filters: Filters, match: dict[str, str]) -> DataFrame:
    return df.where(Chosen(df, filters, match).every())


def best_single(df: DataFrame, filters: Filters, match: dict[str, str], question: str = "") -> tuple[DataFrame, Filters]:
    """The one column whose filter hits fewest rows (but some), exact columns first; all rows if none hits."""
    chosen = Chosen(df, filters, match)
    columns = list(chosen.filters)
    if not columns:
        return df, {}
    hits = df.agg(*[F.count_if(chosen.column(c, True)).alias(c) for c in columns]).first()
    related = any(p in question.lower() for p in RELATIONSHIP) and "primary_oems" in columns
    for banned in (["company"] if related else [], []):
        fit = sorted((match[c] != "exact", hits[c], i) for i, c in enumerate(columns) if hits[c] and c not in banned)
        if fit:
            c = columns[fit[0][2]]
            return df.where(chosen.column(c, True)), {c: chosen.filters[c]}
    return df, {}


def deterministic_base(df: DataFrame, filters: Filters, match: dict[str, str], fall_back: bool = True) -> DataFrame:
    """The filtered rows; if there are none, all rows or none."""
    hits = filtered(df, filters, match)
    return hits if not hits.isEmpty() else df if fall_back else df.limit(0)


def entity_search(df: DataFrame, filters: Filters) -> DataFrame:
    """Literal parts, alternatives within a column; without filters there are no rows."""
    known = {c: v for c, v in filters.items() if c in df.columns and v}
    return df.where(all_of([any_of([part(c, v) for v in vs]) for c, vs in known.items()])) if known else df.limit(0)


def merged(base: Filters, more: Filters, columns: list[str]) -> Filters:
    """Both filters, each value once whatever its case; unknown columns and metadata (``__``) dropped."""
    out: Filters = {}
    for filters in (base, more):
        for c, vs in filters.items():
            if c.startswith("__") or c not in columns:
                continue
            for v in vs if isinstance(vs, list) else [vs]:
                if str(v).lower() not in [x.lower() for x in out.get(c, [])]:
                    out.setdefault(c, []).append(str(v))
    return out


def matches(index: dict[str, sc.Column]) -> dict[str, str]:
    return {c: m.match for c, m in index.items() if m.match != "numeric"}
