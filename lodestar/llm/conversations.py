"""Repair of conversations' structure by a fold in Spark SQL.

A conversation's turns, in order, are kept, given another role, deleted, or joined by new turns of no text, at the least cost that makes their roles
a system turn or none, then pairs of user and assistant (or nothing at all). Faults come from windows: a turn is blank, or repeats an earlier
turn's role and text (both must be deleted), or is truncated (it costs more wherever it stays).

Turns are numbered in order by one range shuffle, so a conversation of any length is spread over tasks; equal turns are one row with a count. Each
``BLOCK`` numbers in a row hold a few conversations or a segment of one. A segment's turns are collected and sorted, and ``aggregate()`` carries four structs
(cost, audit): the cheapest way to have nothing yet, or a system, user or assistant turn last. ``least()`` of the structs takes the lower cost,
then the lesser audit. A segment inside a conversation is folded once for each of the four ways to enter it, and a second fold of the same kind joins the segments
of a conversation. Its audit is one value, so the segments' audits meet in one row; the texts never do.

Of ways that cost the same, neither's audit begins with the other's: both have a letter for each turn, and more insertions cost more. So the lesser
of two beginnings stays the lesser whatever follows, and the fold's choice is the whole audit's.

Defined results: turns of a conversation stand by turn (nulls first), then role and text by code point; a null role or text is one space; a role without a first
letter, or with another than s, u or a, fits nowhere as it is; a null id is an id. No rows give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Numbers in a row that are folded together; a power of two.
BITS = 9
BLOCK = 1 << BITS
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
WAY = "struct<cost:bigint,audit:string>"
#: Nothing yet, and the last role's initial.
STATES = ("n", "s", "u", "a")
SPACES = " \t\n\x0b\f\r"


def ordered(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n, place``: unequal turns, how often each stands there, and their number in order; a written table."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    one = turns.select("conv_id", "turn", text("role"), text("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    one = materialize(one, "turns")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    # The range's ends go through the driver, so whole texts can't be part of them.
    split = one.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    return materialize(split.withColumn("place", F.monotonically_increasing_id()), "ordered")


def flagged(ordered_: DataFrame) -> DataFrame:
    """Each row with ``initial`` and its first fault: ``blank``, ``duplicate`` or ``truncated``; the text gives way to its digest.

    The first of equal turns is found by two windows: within the rows that a task numbered, then among those first ones.
    """
    bare = F.rtrim("text", F.lit(SPACES))
    said = F.struct("role", F.sha2("text", 256).alias("text")).alias("said")
    rows = ordered_.select(
        "conv_id", "turn", "n", "place", F.substring("role", 1, 1).alias("initial"), said, (bare == "").alias("blank"), F.substring(bare, -1, 1).alias("last"), F.shiftright("place", 33).alias("part")
    )
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "said", "part").orderBy("place")))
    apart = F.when(F.col("nth") > 1, F.col("part"))
    rows = rows.withColumn("first", (F.col("nth") == 1) & (F.row_number().over(Window.partitionBy("conv_id", "said", apart).orderBy("place")) == 1))
    duplicate = ~F.col("blank") & ~F.col("first")
    truncated = ~F.col("blank") & F.col("first") & ~F.col("last").isin(".", "!", "?")
    return rows.select("conv_id", "turn", "n", "place", "initial", "blank", duplicate.alias("duplicate"), truncated.alias("truncated"))


def _more(way: Column, letter: str, cost: Column | int) -> Column:
    """``way`` and one more edit; null, where it is."""
    return F.when(way.isNotNull(), F.struct((way["cost"] + cost).cast("long").alias("cost"), F.concat(way["audit"], F.lit(letter)).alias("audit")))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value made once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _filled(ways: Column) -> Column:
    """The four ways, with turns inserted where that is cheaper; never more than two in a row."""
    user = F.least(ways["u"], *(_more(ways[s], "I", INSERT) for s in "nsa"))
    return _let(user, lambda u: _ways(ways["n"], ways["s"], u, F.least(ways["a"], _more(u, "I", INSERT))))


def _edited(ways: Column, turn: Column) -> Column:
    free, stay = ~turn["delete"], turn["stay"]
    kept = lambda way, initial: F.when(free & (turn["initial"] == initial), _more(way, "K", stay))
    named = lambda way: F.when(free, _more(way, "R", stay + REROLE))
    gone = lambda way: _more(way, "D", DELETE)
    user = _let(F.least(ways["n"], ways["s"], ways["a"]), lambda w: F.least(gone(ways["u"]), kept(w, "u"), named(w)))
    return _ways(gone(ways["n"]), F.least(gone(ways["s"]), kept(ways["n"], "s")), user, F.least(gone(ways["a"]), kept(ways["u"], "a"), named(ways["u"])))


def _step(ways: Column, turn: Column) -> Column:
    """The four ways after one more turn."""
    return _let(_filled(ways), lambda w: _edited(w, turn))


def _ways(*four: Column) -> Column:
    return F.struct(*(w.cast(WAY).alias(s) for w, s in zip(four, STATES, strict=True)))


def _entered(state: str) -> Column:
    none = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    return _ways(*(none if s == state else F.lit(None) for s in STATES))


def segments(flags: DataFrame) -> DataFrame:
    """A row for each conversation and block: its turns, what they count up to, and ``ways``, by the state in which it is entered."""
    turn = F.struct("place", "turn", "initial", "n", (F.col("blank") | F.col("duplicate")).alias("delete"), F.when(F.col("truncated"), TRUNCATED).otherwise(0).alias("stay"))
    sums = [F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"), F.sum(F.when(F.col("duplicate"), F.col("n")).when(F.col("blank"), 0).otherwise(F.col("n") - 1)).alias("duplicate")]
    rows = flags.groupBy("conv_id", F.shiftright("place", BITS).alias("block")).agg(F.array_sort(F.collect_list(turn)).alias("turns"), *sums, F.count_if("truncated").alias("truncated"))
    entered = lambda s: F.aggregate("turns", _entered(s), _step)
    # Only what begins a block can have begun before it.
    inner = F.col("turns")[0]["place"].bitwiseAND(BLOCK - 1) == 0
    ways = F.struct(entered("n").alias("n"), *(F.when(inner, entered(s)).alias(s) for s in STATES[1:]))
    known = F.filter("turns", lambda t: t["turn"].isNotNull())["turn"]
    pairs = F.zip_with(F.slice("turns", 1, F.size("turns") - 1), F.slice("turns", 2, F.size("turns") - 1), lambda a, b: F.concat(a["initial"], b["initial"]))
    return rows.select(
        "conv_id", "block", "turns", ways.alias("ways"), "blank", "duplicate", "truncated", F.array_size(F.array_distinct(known)).alias("distinct"), F.array_min(known).alias("low"), F.array_max(known).alias("high"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda x, t: x + t["n"] - 1).alias("copies"), F.array_size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).alias("illegal"),
    )


JOINED = "struct<cost:bigint,audit:string,path:string>"


def _join(ways: Column, segment: Column) -> Column:
    """The four ways after a segment; ``path`` notes the states in which segments were entered."""

    def through(a: str, b: str) -> Column:
        way, more = ways[a], segment["ways"][a][b]
        return F.when(way.isNotNull() & more.isNotNull(), F.struct((way["cost"] + more["cost"]).alias("cost"), F.concat(way["audit"], more["audit"]).alias("audit"), F.concat(way["path"], F.lit(a)).alias("path")))

    return F.struct(*(F.least(*(through(a, b) for a in STATES)).cast(JOINED).alias(b) for b in STATES))


def plans(segments_: DataFrame) -> DataFrame:
    """A row a conversation: its counts and gaps, ``cost``, ``audit``, and its ``segments`` with the audit that each got."""
    whole = F.struct("block", "ways", "turns", "distinct", "low", "high")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "copies", "illegal")]
    rows = segments_.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", whole.alias("s"))), _by_block).alias("parts"), *sums)
    rows = rows.withColumn("parts", F.transform("parts", lambda p: p["s"]))
    begin = F.struct(*(F.when(F.lit(s == "n"), F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"), F.lit("").alias("path"))).cast(JOINED).alias(s) for s in STATES))
    rows = rows.withColumn("ways", F.aggregate("parts", begin, _join))
    ends = [("n", 0), ("a", 0), ("u", 1), ("s", 2)]
    done = F.least(*(F.when(F.col("ways")[s].isNotNull(), F.struct((F.col("ways")[s]["cost"] + k * INSERT).alias("cost"), F.concat(F.col("ways")[s]["audit"], F.lit("I" * k)).alias("audit"), F.concat(F.col("ways")[s]["path"], F.lit(s)).alias("path"), F.lit(k).alias("more"))) for s, k in ends))
    rows = rows.withColumn("done", done)
    # Where one segment ends and the next begins.
    edges = F.zip_with(F.slice("parts", 1, F.size("parts") - 1), F.slice("parts", 2, F.size("parts") - 1), lambda a, b: F.struct(F.element_at(a["turns"], -1).alias("a"), b["turns"][0].alias("b")))
    rows = rows.withColumn("edges", edges)
    illegal = F.col("illegal") + F.col("copies") + F.array_size(F.filter("edges", lambda e: ~F.concat(e["a"]["initial"], e["b"]["initial"]).isin("su", "ua", "au")))
    twice = F.array_size(F.filter("edges", lambda e: e["a"]["turn"] == e["b"]["turn"]))
    distinct = F.aggregate("parts", F.lit(0), lambda x, p: x + p["distinct"]) - twice
    low, high = F.array_min(F.col("parts")["low"]), F.array_max(F.col("parts")["high"])
    state = lambda i: F.substring(F.col("done")["path"], i + 1, F.lit(1))
    of = lambda ways, s: F.coalesce(*(F.when(s == x, ways[x]) for x in STATES))
    audits = F.transform("parts", lambda p, i: F.struct(p["turns"].alias("turns"), state(i).alias("entered"), of(of(p["ways"], state(i)), state(i + 1))["audit"].alias("audit")))
    rows = rows.withColumn("segments", audits)
    return rows.select(
        "conv_id", F.coalesce(high - low + 1 - distinct, F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", illegal.cast("long").alias("illegal"),
        (F.col("done")["cost"] + DELETE * F.col("copies")).alias("cost"), "segments", F.col("done")["more"].alias("more"),
    )


def _by_block(a: Column, b: Column) -> Column:
    return (a["block"] > b["block"]).cast("int") - (a["block"] < b["block"]).cast("int")


def _edits(segment: Column) -> Column:
    """The edits of each turn of a segment: any insertions before it, then its own letter."""
    return F.zip_with(segment["turns"], F.regexp_extract_all(segment["audit"], F.lit("(I*[KRD])"), F.lit(1)), lambda t, e: F.struct(t["place"].alias("place"), t["initial"].alias("initial"), t["n"].alias("n"), e.alias("edits")))


def audited(plans_: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``; equal turns after the first have a D of their own."""
    letters = lambda s: F.array_join(F.transform(_edits(s), lambda e: F.concat(e["edits"], F.repeat(F.lit("D"), (e["n"] - 1).cast("int")))), "")
    audit = F.concat(F.array_join(F.transform("segments", letters), ""), F.repeat(F.lit("I"), "more"))
    return plans_.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", audit.alias("audit"))


def repaired(plans_: DataFrame, ordered_: DataFrame) -> DataFrame:
    """``conv_id, place, line, role, text, edit``: the turns that stay or are new, in order of ``place`` and ``line``."""
    parts = plans_.select("conv_id", F.posexplode("segments").alias("nth", "segment"), "more")
    turns = parts.select("conv_id", "nth", F.col("segment")["entered"].alias("entered"), F.explode(_edits(F.col("segment"))).alias("e")).select("conv_id", "nth", "entered", "e.*")
    segment = Window.partitionBy("conv_id", "nth")
    lines = F.length(F.translate("edits", "D", ""))
    before = F.coalesce(F.sum(lines).over(segment.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    system = F.col("edits").endswith("K") & (F.col("initial") == "s")
    shift = F.max(F.when(system, 1).when(F.col("entered") == "u", 1).otherwise(0)).over(segment)
    turns = turns.withColumns({"before": before, "shift": shift}).where(lines > 0)
    new = turns.select("conv_id", "place", F.posexplode(F.split(F.translate("edits", "D", ""), "")).alias("line", "edit"), "before", "shift")
    # After a segment's beginning, users and assistants take turns.
    role = F.when((F.col("before") + F.col("line") + F.col("shift")) % 2 == 0, "user").otherwise("assistant")
    new = new.select("conv_id", "place", "line", "edit", role.alias("role"))
    own = ordered_.select("place", F.col("role").alias("own_role"), F.col("text").alias("own_text"))
    done = new.join(own, "place").select(
        "conv_id", "place", "line", F.when(F.col("edit") == "K", F.col("own_role")).otherwise(F.col("role")).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("own_text")).alias("text"), "edit"
    )
    # Turns inserted at the end: an assistant, or a user and an assistant.
    last = plans_.where("more > 0").select("conv_id", F.explode(F.sequence(2 - F.col("more"), F.lit(1))).alias("line"))
    last = last.select("conv_id", F.lit((1 << 63) - 1).alias("place"), "line", F.when(F.col("line") == 0, "user").otherwise("assistant").alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))
    return done.unionByName(last)


def digests(repaired_: DataFrame) -> DataFrame:
    """``conv_key, repaired_sha256`` of ``role:text`` lines; hashed as they stream by in order, so that no conversation's text is held whole."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = hashed = None
        for part in parts:
            done = []
            for k, line in zip(part["conv_key"], part["said"], strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, hashed.hexdigest()))
                    key, hashed = k, hashlib.sha256(line.encode())
                else:
                    hashed.update(b"\n" + line.encode())
            yield pd.DataFrame(done, columns=["conv_key", "repaired_sha256"])
        if key is not None:
            yield pd.DataFrame([(key, hashed.hexdigest())], columns=["conv_key", "repaired_sha256"])

    lines = repaired_.select(conv_key().alias("conv_key"), "place", "line", F.concat("role", F.lit(":"), "text").alias("said"))
    return lines.repartition("conv_key").sortWithinPartitions("conv_key", "place", "line").drop("place", "line").mapInPandas(of, "conv_key string, repaired_sha256 string")


def conv_key() -> Column:
    """A text for each id, the null one included."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults put in by a checksum of id and turn: dropped, emptied, without its stops, repeated, or made a user's."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text")
    return rows.select("conv_id", "turn", role, text, F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def report(turns: DataFrame, all_ids: DataFrame | None = None) -> DataFrame:
    """A row for each id of ``all_ids`` (those of ``turns``, if none are given): counts of faults, cost and audit of the repair, and its digest."""
    rows = ordered(turns)
    plan = materialize(plans(segments(flagged(rows))), "plans")
    found = audited(plan).withColumn("conv_key", conv_key()).drop("conv_id")
    ids = (turns if all_ids is None else all_ids).select("conv_id").distinct().withColumn("conv_key", conv_key())
    out = ids.join(found, "conv_key", "left").join(digests(repaired(plan, rows)), "conv_key", "left")
    zero = reduce(lambda d, c: d.withColumn(c, F.coalesce(c, F.lit(0).cast("long"))), ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), out)
    return zero.withColumn("audit", F.coalesce("audit", F.lit(""))).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))).drop("conv_key")
