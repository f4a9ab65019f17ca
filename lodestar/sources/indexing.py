"""The index job: a knowledge table's parents and embedded chunks, upserted as tables.

``python -m lodestar.sources.indexing knowledge.xlsx --path /shared/index`` runs it; ``--dry-run`` writes nothing, ``--preview 5`` shows chunks.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, retrieval
from . import files, upsert, xlsx
from .written import drop, materialize


@dataclass(frozen=True)
class Indexed:
    """How many chunks were embedded, the length of their vectors (0 for none), by which model, and the folders that now hold both tables."""

    chunks: int
    vector_size: int
    model: str
    parents: str
    children: str


def index(kb: DataFrame, path: str, model: str = "hashed words", embed: Callable[[str], Column] = retrieval.embed, recreate: bool = False) -> Indexed:
    """Upsert ``kb``'s parents by record and its chunks, embedded, by chunk. Each chunk is embedded once, and counted as it is written."""
    parents = chunks.parents(kb)
    seen = Observation("indexed")
    each = chunks.children(parents).withColumn("embedding", embed("embedding_text"))
    counts = F.count(F.lit(1)).alias("chunks"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("size")
    children = materialize(each.observe(seen, *counts), "chunks")
    done = seen.get
    held = [upsert.upsert(table, f"{path}/{name}", [key], recreate) for table, name, key in ((parents, "parents", "record_id"), (children, "children", "chunk_id"))]
    drop(children)
    return Indexed(done["chunks"], done["size"], model, *held)


def export(kb: DataFrame, path: str) -> None:
    """A workbook of what people read of the chunks."""
    parents = chunks.parents(kb)
    xlsx.write(path, chunks.exported(parents, chunks.children(parents)))


def main(given: list[str] | None = None) -> Indexed | None:
    p = argparse.ArgumentParser(description="Index a knowledge table.")
    p.add_argument("table")
    p.add_argument("--path", default="index")
    p.add_argument("--model", default="hashed words")
    p.add_argument("--recreate-child-table", dest="recreate", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--preview", type=int, default=0)
    asked = p.parse_args(given)
    spark = SparkSession.builder.getOrCreate()
    kb = files.knowledge(spark, asked.table)
    if asked.preview:
        parents = chunks.parents(kb)
        chunks.exported(parents, chunks.children(parents))["children"].show(asked.preview, truncate=80)
    if asked.dry_run:
        return None
    done = index(kb, asked.path, asked.model, recreate=asked.recreate)
    print(done)
    return done


if __name__ == "__main__":
    main()
