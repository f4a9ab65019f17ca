"""Columns of any name: with dots, backticks, other cases, or names that an operator uses itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *added: str) -> list[str]:
    """The columns of ``df`` but those that ``added`` ones replace, in whatever case."""
    gone = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in gone]


def row(df: DataFrame, *added: str) -> Column:
    """The columns of ``df``, but those that ``added`` ones replace, as one struct."""
    return F.struct(*(column(c) for c in others(df, *added)))
