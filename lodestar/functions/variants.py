"""JSON as VARIANT columns: parsed once, then read by path and type.

Text that isn't JSON is a null VARIANT, a path that leads nowhere or to another type a null value. Written to Parquet, a VARIANT keeps its values' types; where the session
shreds (``spark.sql.variant.writeShredding.enabled``), common paths are columns of their own that a scan can read alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with a VARIANT for each ``name=column`` of JSON text, in the place of a column of that name."""
    return df.withColumns({name: F.try_parse_json(column) for name, column in columns.items()})


def at(variant: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(variant, path, kind)


def holds(variant: str | Column, keys: list[str]) -> Column:
    """Whether the value is an object that has all ``keys``, null ones included."""
    made = F.col(variant) if isinstance(variant, str) else variant
    has = [F.coalesce(F.try_variant_get(made, f"$.{k}", "variant").isNotNull(), F.lit(False)) for k in keys]
    out = F.lit(True)
    for h in has:
        out = out & h
    return out


def shape(df: DataFrame, variant: str) -> str | None:
    """The schema that fits all values of a VARIANT column, found in one combined aggregate."""
    return df.agg(F.schema_of_variant_agg(variant)).first()[0]
