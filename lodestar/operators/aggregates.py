"""Counts, grouped sums, ranks and single points of failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning, text


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def group_key(column: str) -> Column:
    place = any(w in column.lower() for w in ("location", "address", "county", "city"))
    return text.component(F.col(column)) if place else F.coalesce(F.col(column).cast("string"), F.lit("Unknown"))


def grouped_sum(df: DataFrame, group: str, metric: str, direction: str = "desc") -> DataFrame:
    total = f"total_{metric}"
    out = df.groupBy(group_key(group).alias(group)).agg(F.sum(metric).alias(total))
    return out.orderBy(F.col(total).asc_nulls_last() if direction == "asc" else F.col(total).desc_nulls_last(), group)


def ranked(df: DataFrame, metric: str, order: str, n: int = 1, direction: str = "desc") -> DataFrame:
    """The ``n`` first rows by ``metric``, ties by ``order``."""
    key = F.col(metric).asc_nulls_last() if direction == "asc" else F.col(metric).desc_nulls_last()
    return df.orderBy(key, order).limit(n)


def single_points(df: DataFrame, role: str, company: str) -> DataFrame:
    """The rows of roles that exactly one company holds, with ``company_count``.

    Rows without a role are no role. Roles are counted once and joined back, so no group is gathered.
    """
    known = df.where(F.col(role).isNotNull() & (F.col(role) != cleaning.UNKNOWN)) if dict(df.dtypes)[role] == "string" else df.where(F.col(role).isNotNull())
    alone = known.groupBy(role).agg(F.min(company).alias("a"), F.max(company).alias("b"), F.count_distinct(company).alias("company_count")).where("company_count = 1").select(role, "company_count")
    return known.join(alone, role)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(column).asc_nulls_last())


def missing_summary(df: DataFrame) -> DataFrame:
    """``column, missing, percent``: NULL or Unknown cells of each column, in one pass."""
    gone = lambda c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit(cleaning.UNKNOWN)) == cleaning.UNKNOWN)
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *[gone(c).alias(c) for c in df.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns]))
    out = one.select("n_rows", pairs.alias("x")).select("x.column", "x.missing", "n_rows")
    return out.select("column", "missing", F.round(100.0 * F.col("missing") / F.greatest("n_rows", F.lit(1)), 2).alias("percent"))
