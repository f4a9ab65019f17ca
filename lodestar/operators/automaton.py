"""Which of many values stand in each of many texts, by Aho-Corasick automata.

Values are dealt into shards by a hash and texts into slices; a task makes one shard's automaton and runs its slice's texts through it once, however many
values there are. A shard has about ``SHARD`` values, which bounds a task's memory, as does what a slice's texts hold together; values that begin alike are no key of anything. Texts are read once for
each shard, so once for all where the values fit one.

Defined results: case is Spark's ``lower``; a null text holds nothing; null values and those shorter than ``least`` are left out; equal values are found once a text.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a shard; texts of a slice, and about how many letters they have.
SHARD, SLICE, LETTERS = 200_000, 20_000, 8_000_000


def _scanned(values: pa.Table, texts: pa.Table) -> pa.Table:
    """``id, low``: places of texts and of values in numbers of 32 bits, as a text may hold thousands of values."""
    import ahocorasick

    at, which = array("i"), array("i")
    if len(values) and len(texts):
        tree = ahocorasick.Automaton()
        for n, v in enumerate(values["low"]):
            tree.add_word(v.as_py(), n)
        tree.make_automaton()
        for i, text in enumerate(texts["low"]):
            held = {n for _, n in tree.iter(text.as_py())}
            at.extend([i] * len(held))
            which.extend(held)
    pick = lambda column, places: column.take(pa.array(places, pa.int32()) if not len(places) else pa.Array.from_buffers(pa.int32(), len(places), [None, pa.py_buffer(places)]))
    return pa.table({"id": pick(texts["id"], at), "low": pick(values["low"], which)})


def holders(asked: DataFrame, values: DataFrame, least: int = 3, shard: int = SHARD, slice_: int = SLICE, letters: int = LETTERS) -> DataFrame:
    """``id, value``: the values of ``values(value)`` that stand in each text of ``asked(id, q)``, whatever the case."""
    own = values.select(F.lower("value").alias("low"), "value").where(F.length("low") >= least).distinct()
    lows, texts = own.select("low").distinct(), asked.select("id", F.lower("q").alias("low")).where("low is not null")
    n, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("low")), F.lit(0))).first()
    shards, slices = max(1, -(-lows.count() // shard)), max(1, -(-n // slice_), -(-size // letters))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = lows.select("low", dealt("low", shards).alias("shard"), every(slices).alias("slice"))
    right = texts.select("id", "low", F.pmod(F.xxhash64("id", "low"), F.lit(slices)).cast("int").alias("slice"), every(shards).alias("shard"))
    kind = asked.schema["id"].dataType.simpleString()
    met = left.groupBy("shard", "slice").cogroup(right.groupBy("shard", "slice")).applyInArrow(_scanned, f"id {kind}, low string")
    return met.distinct().join(own, "low").select("id", "value")
