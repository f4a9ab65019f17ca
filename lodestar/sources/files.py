"""Finding and loading knowledge tables and question sheets, and saving results."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning
from . import xlsx


def find(folders: list[str], given: str | None = None, preferred: tuple[str, ...] = ()) -> Path:
    """``given``, else the spreadsheet below ``folders`` whose name has a preferred word; lock and debug files don't count."""
    if given:
        return Path(given)
    found = sorted(p for f in folders for p in Path(f).rglob("*.xls*") if not p.name.startswith("~$") and "debug" not in p.name.lower())
    if not found:
        raise FileNotFoundError(f"no spreadsheet below {', '.join(folders)}")
    return min(found, key=lambda p: not any(w in p.name.lower() for w in preferred))


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table by its file's kind: xlsx, csv, json or parquet."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "xlsx":
        return xlsx.read(spark, path)
    return spark.read.csv(path, header=True) if kind == "csv" else spark.read.json(path) if kind == "json" else spark.read.parquet(path)


def knowledge(spark: SparkSession, path: str) -> DataFrame:
    raw = load(spark, path)
    out = cleaning.normalise(raw, order="source_row" if "source_row" in raw.columns else None)
    return out.drop("source_row")


def questions(raw: DataFrame) -> DataFrame:
    """``num, category, question, human_answer``: columns found by their headers, else by place; rows without a question dropped."""
    names = [c for c in raw.columns if c != "source_row"]
    by = lambda *words: next((c for c in names if any(w in c.lower() for w in words)), None)
    at = lambda i: names[min(i, len(names) - 1)]
    num, category = by("num", "number", "#", "id") or at(0), by("category", "use case")
    question, answer = by("question") or at(2), by("human", "validated") or at(3)
    out = raw.select(F.trim(F.col(num).cast("string")).try_cast("double").try_cast("int").alias("num"), (F.col(category) if category else F.lit(None)).cast("string").alias("category"), F.trim(question).alias("question"), F.trim(answer).alias("human_answer"))
    return out.where("question is not null and question <> '' and lower(question) <> 'nan'")


def debug_report(df: DataFrame, path: str) -> None:
    from ..operators import aggregates

    texts = [c for c, t in df.dtypes if t == "string"][:2]
    xlsx.write(path, {"data": df, "missing": aggregates.missing_summary(df)} | {c: aggregates.value_counts(df, c) for c in texts})


def save_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
