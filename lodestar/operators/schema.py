"""What is known of a table's columns: how to match them, their values and their parts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Columns that are never searched, never filtered, and always matched in part.
SKIPPED = ("_row_id", "latitude", "longitude", "address")
UNFILTERED = ("classification_method", "supplier_or_affiliation_type")
PARTIAL = ("primary_oems",)
MOST_EXACT, LONGEST_EXACT, LEAST_PART = 60, 50, 3
#: Values of a column that the driver may hold; of columns with more it gets those that a question names, by a join.
MOST_VALUES = 10_000


@dataclass(frozen=True)
class Column:
    name: str
    match: str
    filterable: bool = True
    values: tuple[str, ...] = ()
    parts: tuple[str, ...] = field(default=())
    n_values: int = 0

    @property
    def held(self) -> bool:
        return self.n_values <= MOST_VALUES


def profile(df: DataFrame) -> DataFrame:
    """``column, n_values, mean_length, match`` of each text column, in one pass."""
    names = [c for c, t in df.dtypes if t == "string" and c not in SKIPPED]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, n_values long, mean_length double, match string")
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(c).alias("value")) for c in names])).alias("x")).select("x.*")
    values = values.where("value is not null and value <> '' and lower(value) <> 'nan'").distinct()
    exact = (F.col("n_values") <= MOST_EXACT) & (F.col("mean_length") <= LONGEST_EXACT) & ~F.col("column").isin(*PARTIAL)
    return values.groupBy("column").agg(F.count(F.lit(1)).alias("n_values"), F.avg(F.length("value")).alias("mean_length")).withColumn("match", F.when(exact, "exact").otherwise("partial"))


def components(df: DataFrame, column: str) -> DataFrame:
    """``component``: the distinct comma-parts of a column's values that have any."""
    parts = df.select(F.explode(F.split(column, ",")).alias("component")).select(F.trim("component").alias("component"))
    return parts.where(F.length("component") >= LEAST_PART).distinct()


def index(df: DataFrame) -> dict[str, Column]:
    """The columns by name. Values come to the driver for columns with at most ``MOST_VALUES`` of them."""
    sizes = {r["column"]: r for r in profile(df).collect()}
    out = {}
    for f in df.schema:
        if f.name in SKIPPED:
            continue
        if isinstance(f.dataType, NumericType):
            out[f.name] = Column(f.name, "numeric", False)
            continue
        size = sizes.get(f.name)
        values: tuple[str, ...] = ()
        if size and size["n_values"] <= MOST_VALUES:
            rows = df.select(F.trim(f.name).alias("v")).where("v <> '' and lower(v) <> 'nan'").distinct().collect()
            values = tuple(sorted(r["v"] for r in rows))
        parts = sorted({p.strip() for v in values for p in v.split(",") if len(p.strip()) >= LEAST_PART}) if any("," in v for v in values) else []
        out[f.name] = Column(f.name, size["match"] if size else "exact", f.name not in UNFILTERED, values, tuple(parts), size["n_values"] if size else 0)
    return out
