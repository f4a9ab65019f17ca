"""Keyed upsert of tables that a lost writer can't harm.

A table is a folder with ``data`` and ``log``. Rows are dealt into buckets by a hash of their keys; a folder below ``data`` holds one bucket's rows and is never
changed. ``log`` holds numbered manifests, each with the folder of every bucket; the highest one is the table. A writer makes new folders for the buckets that its
batch touches, writes its manifest beside the log, and claims the next number for it: the claim succeeds for one writer only, and the manifest
appears whole or not at all. So a writer that dies leaves folders that no manifest names, and the table as it was; readers see one version throughout.
A writer that finds its number taken merges the buckets that have changed meanwhile anew, and claims the next.

A claim is a hard link on a local file system, and a rename that may not overwrite elsewhere (atomic on HDFS; object stores without such a rename need a lock).

Defined results: of rows of a batch with equal keys the last by ``order`` stays, of those the one with the greatest hash; null keys are equal to each other; an empty
batch makes a version with the same folders; a batch's columns must be the table's, in any order.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .written import delete, drop, materialize

BUCKETS, TRIES = 64, 20
BUCKET = "bucket__"


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, (a["`" + k.replace("`", "``") + "`"].eqNullSafe(b["`" + k.replace("`", "``") + "`"]) for k in keys))


def one_a_key(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row of each key. Rows are compared by ``order``, then by a hash, as they are counted: one shuffle, combined before it."""
    plain = [_quoted(f.name) if not any(t in f.dataType.simpleString() for t in ("map<", "variant")) else F.to_json(F.struct(_quoted(f.name))) for f in rows.schema]
    place = F.struct(*([_quoted(order)] if order else []), F.xxhash64(*plain))
    best = rows.groupBy(*(_quoted(k) for k in keys)).agg(F.max_by(F.struct(*(_quoted(c) for c in rows.columns)), place).alias("row__"))
    return best.select("row__.*")


def merged(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``new``, one row a key, and the rows of ``old`` with other keys. One shuffle for each side, none gathered."""
    new = one_a_key(new, keys, order)
    return old.join(new.select(*(_quoted(k) for k in keys)), _same(old, new, keys), "left_anti").select(*(_quoted(c) for c in old.columns)).unionByName(new)


@dataclass(frozen=True)
class Version:
    """A manifest: the table's columns, keys and number of buckets, and the folder of each bucket that has rows."""

    number: int
    schema: StructType
    keys: list[str]
    buckets: int
    folders: dict[str, str]

    def text(self) -> str:
        return json.dumps({"schema": self.schema.jsonValue(), "keys": self.keys, "buckets": self.buckets, "folders": self.folders})


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _listed(spark: SparkSession, path: str) -> list[str]:
    system, at = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []


def version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The table's latest version, or the one asked for; None if there is none."""
    numbers = [int(n.removesuffix(".json")) for n in _listed(spark, f"{path}/log") if n.endswith(".json")]
    number = max(numbers, default=None) if number is None else number if number in numbers else None
    if number is None:
        return None
    said = json.loads(_read(spark, f"{path}/log/{number:020d}.json"))
    return Version(number, StructType.fromJson(said["schema"]), said["keys"], said["buckets"], said["folders"])


def _read(spark: SparkSession, path: str) -> str:
    system, at = _hadoop(spark, path)
    stream = system.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _claim(spark: SparkSession, path: str, number: int, text: str) -> bool:
    """Puts a manifest into the log under a number that no other has; False if one has it. The text is whole before it has a number."""
    system, log = _hadoop(spark, f"{path}/log")
    system.mkdirs(log)
    jvm, draft, name = spark.sparkContext._jvm, f"{path}/log/.draft-{uuid.uuid4().hex}", f"{path}/log/{number:020d}.json"
    if log.toUri().getScheme() in (None, "file") and system.getScheme() == "file":
        draft, name = (jvm.org.apache.hadoop.fs.Path(p).toUri().getPath() for p in (draft, name))
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, name)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    out = system.create(jvm.org.apache.hadoop.fs.Path(draft), False)
    out.write(bytearray(text.encode()))
    out.hsync()
    out.close()
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(log.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(jvm.org.apache.hadoop.fs.Path(draft), jvm.org.apache.hadoop.fs.Path(name), never)
    except Exception as e:
        delete(spark, draft)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def _write(rows: DataFrame, path: str) -> dict[str, str]:
    """Writes ``rows`` with their bucket into a folder of their own and returns the buckets' folders, below ``path``."""
    at = f"data/{uuid.uuid4().hex}"
    rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{at}")
    return {n.removeprefix(f"{BUCKET}="): f"{at}/{n}" for n in _listed(rows.sparkSession, f"{path}/{at}") if n.startswith(f"{BUCKET}=")}


def _folders(spark: SparkSession, path: str, held: Version, buckets: set[str] | None = None) -> DataFrame | None:
    found = [f"{path}/{f}" for b, f in held.folders.items() if buckets is None or b in buckets]
    return spark.read.schema(held.schema).parquet(*found) if found else None


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(_quoted(k) for k in keys)), F.lit(buckets)).cast("int")


def upsert(new: DataFrame, path: str, keys: list[str], recreate: bool = False, order: str | None = None, buckets: int = BUCKETS) -> str:
    """Puts ``new`` into the table at ``path``, in the place of rows with equal keys, and returns ``current``.

    ``recreate`` leaves nothing but ``new``; ``buckets`` is that of a new table.
    """
    spark = new.sparkSession
    base = version(spark, path)
    shape = StructType(sorted((f for f in new.schema), key=lambda f: f.name))
    batch = None
    merged_: dict[str, tuple[str | None, str]] = {}
    try:
        for _ in range(TRIES):
            held = None if recreate or base is None else base
            number = buckets if held is None else held.buckets
            if held and (sorted(held.keys) != sorted(keys) or sorted((f.name, f.dataType.simpleString()) for f in held.schema) != [(f.name, f.dataType.simpleString()) for f in shape]):
                raise ValueError(f"the table at {path} has other columns or keys")
            if batch is None:
                batch = materialize(one_a_key(new, keys, order).withColumn(BUCKET, _bucket(keys, number)), "batch")
                touched = {str(r[0]) for r in batch.select(BUCKET).distinct().collect()}
            had = held.folders if held else {}
            stale = {b for b in touched if b not in merged_ or merged_[b][0] != had.get(b)}
            if stale:
                own = batch.where(F.col(BUCKET).isin([int(b) for b in stale]))
                old = _folders(spark, path, held, stale) if held else None
                if old is not None:
                    rest = old.join(own.select(*(_quoted(k) for k in keys)), _same(old, own, keys), "left_anti")
                    own = own.unionByName(rest.withColumn(BUCKET, _bucket(keys, number)))
                merged_ |= {b: (had.get(b), f) for b, f in _write(own, path).items()}
            folders = {b: f for b, f in had.items() if b != "none"} | {b: f for b, (_, f) in merged_.items()}
            if not folders:
                spark.createDataFrame([], new.schema).write.parquet(f"{path}/{(none := f'data/{uuid.uuid4().hex}')}")
                folders = {"none": none}
            made = Version(base.number + 1 if base else 1, held.schema if held else new.schema, keys, number, folders)
            if _claim(spark, path, made.number, made.text()):
                return _glob(path, made)
            base = version(spark, path)
        raise RuntimeError(f"{TRIES} other writers were faster at {path}")
    finally:
        if batch is not None:
            drop(batch)


def _glob(path: str, held: Version) -> str:
    return f"{path}/{{{','.join(sorted(held.folders.values()))}}}"


def current(spark: SparkSession, path: str) -> str | None:
    """A pattern of the folders that hold the table now, for ``spark.read.parquet``; None if there is no table."""
    held = version(spark, path)
    return held and _glob(path, held)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table's rows, now or in an earlier version."""
    held = version(spark, path, number)
    if held is None:
        raise FileNotFoundError(f"no such table or version: {path}")
    return _folders(spark, path, held)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes manifests before the last ``keep``, then the folders that none of those left names; how many folders went.

    Not while others write: what they have not yet claimed is named by none.
    """
    numbers = [n for n in _listed(spark, f"{path}/log") if n.endswith(".json")]
    for n in numbers[:-keep]:
        delete(spark, f"{path}/log/{n}")
    named = {f for n in numbers[-keep:] for f in version(spark, path, int(n.removesuffix(".json"))).folders.values()}
    gone = 0
    for at in _listed(spark, f"{path}/data"):
        parts = [f"data/{at}/{n}" for n in _listed(spark, f"{path}/data/{at}") if n.startswith(f"{BUCKET}=")] or [f"data/{at}"]
        for part in (p for p in parts if p not in named):
            delete(spark, f"{path}/{part}")
            gone += 1
    return gone
