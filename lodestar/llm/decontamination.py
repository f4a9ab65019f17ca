"""Benchmark decontamination by template canonicalisation.

Texts become templates: names (capitalised words, wherever they stand; several with single spaces between are one), numbers (in digits, or one of ``NUMBERS``
in words), and units after numbers give way to typed placeholders; the rest is lower-cased (ß is ss, as in capitals) and loses its punctuation. Windows of five
template words are hashed; a hash join of documents with benchmark items finds shared windows. Windows with fewer than three literal words say
little as templates, so they keep their values in the hash. An item is judged by its windows of three literal words or more if those are most
of it, else by all.

Items stand in two forms: as they are, and in lower case, where capitalised words are words like any other. Documents in lower case or in capitals have
no names either, so they meet the second form. What counts is the form of which more is found.

A placeholder keeps the value it stands for, so that slots can be checked where an item stands: met windows whose places in the document
and in the item differ by about the same are one occurrence, and within it every value of the item stands for one value of the
document (the one with most windows on the same diagonal, then the smallest); windows whose slots say otherwise don't count. A document
is contaminated by an item if one occurrence holds at least 0.8 of the item's windows; it is verbatim where each place of the item that was met at all
was met with its own values.

Texts of fewer than five words are one window, the whole text: an item so short is found as a whole document only. The items' windows are
broadcast while they are at most ``MOST_BROADCAST`` and ``MOST_BYTES``; beyond that the join shuffles the hashes.

Defined results: null and empty texts match nothing; rows with equal doc_id (or item_id) count as one document (item); a null id is an id;
an empty table on either side gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, SHARE, LITERALS = 5, 0.8, 3
MOST_BROADCAST, MOST_BYTES = 1_000_000, 64_000_000
#: Words that are units where they follow a number.
UNITS = (
    "mm", "cm", "m", "km", "mi", "miles", "ft", "feet", "inches", "meters", "metres", "kilometers", "kilometres",
    "mg", "g", "kg", "t", "lb", "lbs", "oz", "grams", "kilograms", "tons", "ml", "cl", "l", "liters", "litres",
    "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years",
    "kmh", "mph", "w", "kw", "mw", "kwh", "v", "a", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb",
    "usd", "eur", "gbp", "dollars", "euros", "pounds", "cents", "percent", "degrees",
)
SLOT = "⟦([anu])[^⟧]*+⟧"
#: Joins the words of a name; a letter, so that it stays where punctuation goes.
JOINT = "\u01c0"
#: Numbers in words, with their digits.
NUMBERS = {
    "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000,
}
IN_WORDS = "(?=[" + "".join(sorted({w[0] for w in NUMBERS})) + r"])(?<![\p{L}\p{N}⟦" + JOINT + "])(" + "|".join(NUMBERS) + r")(?![\p{L}\p{N}" + JOINT + "⟧])"
#: One of ``NUMBERS`` between single spaces.
SPELLED = "(?:^| )(?:" + "|".join(NUMBERS) + ")(?: |$)"


def _bare(t: Column) -> Column:
    return F.regexp_replace(t, r"[^\p{L}\p{N}⟦⟧]+", " ")


def _numbered(t: Column) -> Column:
    t = F.regexp_replace(t, r"(?:[.,:/](?!(?<=[0-9].)[0-9])|[^\p{L}\p{N}⟦⟧.,:/])+", " ")
    t = F.regexp_replace(t, r"([0-9][0-9.,:/]*)", " ⟦n$1⟧ ")
    return F.regexp_replace(t, r"(?<=⟧ {1,3})(" + "|".join(UNITS) + r")(?= |$)", "⟦u$1⟧")


def _in_digits(t: Column) -> Column:
    """Numbers in words as digits."""
    marked = F.regexp_replace(t, IN_WORDS, "⟦$1⟧")
    for word, number in NUMBERS.items():
        marked = F.replace(marked, F.lit(f"⟦{word}⟧"), F.lit(str(number)))
    return marked


def templates(texts: DataFrame, key: str) -> DataFrame:
    """``key, template``: words between single spaces; a placeholder is ``⟦`` a, n or u, the value ``⟧``.

    Texts without digits and numbers in words take a shorter way to the same template. Steps stand in projections of their own, so that none is made twice.
    Expressions look at the letter itself before what is behind it, as they are tried at every letter.
    """
    t = F.col("template")
    out = texts.select(key, F.when(F.contains("text", F.lit("⟦")) | F.contains("text", F.lit("⟧")), F.translate("text", "⟦⟧", "  ")).otherwise(F.col("text")).alias("template"))
    out = out.select(key, F.lower(F.regexp_replace(t, r"(?=\p{Lu})(?<![\p{L}\p{N}])(\p{Lu}\p{Ll}++)(?![\p{L}\p{N}])", "⟦a$1⟧")).alias("template"))
    out = out.select(key, F.replace(F.replace("template", F.lit("⟧ ⟦a"), F.lit(JOINT)), F.lit("ß"), F.lit("ss")).alias("template"))
    out = out.select(key, "template", F.trim(_bare(t)).alias("bare"))
    # One search tells the texts without numbers; of the others, those with numbers in words.
    numbers = F.regexp_like("bare", F.lit("[0-9]|" + SPELLED))
    spoken = F.when(F.regexp_like("bare", F.lit(SPELLED)), _in_digits(t)).otherwise(t)
    return out.select(key, F.when(numbers, F.trim(F.regexp_replace(_numbered(spoken), "  +", " "))).otherwise(F.col("bare")).alias("template"))


def windows(texts: DataFrame, key: str) -> DataFrame:
    """``key, pos, window, weak, hash`` of every window of ``texts(key, text)``; the window is null where there are no words."""
    word = "[^ ]++"
    # A match takes a word and its space, so the next begins at the next word; where fewer than ``SIZE`` words are left none does.
    pattern = "(?=(" + " ".join([word] * SIZE) + "))" + word + " "
    t = templates(texts, key).select(key, "template", F.regexp_extract_all("template", F.lit(pattern), F.lit(1)).alias("all"))
    t = t.select(key, F.when(F.size("all") > 0, SIZE).otherwise(F.size(F.split("template", " "))).alias("words"), F.when(F.size("all") > 0, F.col("all")).when(F.col("template") != "", F.array("template")).alias("all"))
    # The outer form: before the inner one Spark would put a filter that makes the windows once more.
    each = t.select(key, "words", F.posexplode_outer("all").alias("pos", "window"))
    # At most so many placeholders leave ``LITERALS`` words, or all words of a shorter text.
    most = F.greatest(F.col("words") - LITERALS, F.lit(0))
    weak = F.when(most == SIZE - LITERALS, F.col("window").like("%⟦" * (SIZE - LITERALS + 1) + "%")).otherwise(F.length("window") - F.length(F.translate("window", "⟦", "")) > most)
    each = each.select(key, "pos", "window", F.when(F.instr("window", "⟦") > 0, weak).otherwise(False).alias("weak"))
    bare = F.when((F.instr("window", "⟦") == 0) | F.col("weak"), F.col("window")).otherwise(F.regexp_replace("window", SLOT, "⟦$1⟧"))
    return each.withColumn("hash", F.xxhash64(bare))


def _slots(window: Column) -> Column:
    return F.when(F.instr(window, "⟦") > 0, F.regexp_extract_all(window, F.lit("⟦([anu][^⟧]*)⟧"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def item_windows(items: DataFrame) -> DataFrame:
    """``item, hash, own, at, windows``: the windows a form of an item is judged by, each with its first place, and their number.

    ``item`` is a struct of ``item_id`` and ``lower``, whether this is the form in lower case.
    """
    lower = items.where(F.col("text") != F.lower("text")).select(F.struct("item_id", F.lit(True).alias("lower")).alias("item"), F.lower("text").alias("text"))
    forms = items.select(F.struct("item_id", F.lit(False).alias("lower")).alias("item"), "text").unionByName(lower)
    own = windows(forms, "item").where("window is not null")
    own = own.groupBy("item", "hash", "weak", F.col("window").alias("own")).agg(F.min("pos").alias("at"))
    whole = Window.partitionBy("item")
    own = own.withColumn("strong", F.count_if(~F.col("weak")).over(whole)).withColumn("all", F.count(F.lit(1)).over(whole))
    mostly = F.col("strong") * 2 > F.col("all")
    return own.where(~(mostly & F.col("weak"))).select("item", "hash", "own", "at", F.when(mostly, F.col("strong")).otherwise(F.col("all")).alias("windows"))


def _occurrences(met: DataFrame) -> DataFrame:
    """``met`` with ``run``, the number of the occurrence, and ``weight``, the met windows on the same diagonal."""
    pair = ["doc_id", "item"]
    along = Window.partitionBy(*pair).orderBy("diagonal")
    reach = F.least(F.greatest(F.lit(SIZE), F.floor(F.col("windows") / 4)), F.col("windows") + 3)
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > reach).cast("int"), F.lit(0))
    met = met.withColumn("diagonal", F.col("pos") - F.col("at")).withColumn("apart", apart).withColumn("run", F.sum("apart").over(along))
    return met.withColumn("weight", F.count(F.lit(1)).over(Window.partitionBy(*pair, "diagonal"))).drop("apart", "diagonal")


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, found, windows, coverage, kind`` of every document and item that it is contaminated by."""
    own = item_windows(items)
    size = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("own")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= MOST_BROADCAST and size["bytes"] <= MOST_BYTES:
        own = F.broadcast(own)
    met = windows(docs.select("doc_id", "text"), "doc_id").join(own, "hash")
    met = met.select("doc_id", "item", "at", "pos", "windows", _slots(F.col("own")).alias("a"), _slots(F.col("window")).alias("b")).distinct()
    pair = ["doc_id", "item", "run"]
    slots = _occurrences(met).withColumn("slot", F.explode_outer(F.arrays_zip("a", "b")))
    slots = slots.select(*pair, "at", "pos", "windows", "weight", F.col("slot.a").alias("from"), F.col("slot.b").alias("to"))
    slots = slots.withColumn("votes", F.sum("weight").over(Window.partitionBy(*pair, "from", "to")))
    slots = slots.withColumn("stands", F.first("to").over(Window.partitionBy(*pair, "from").orderBy(F.col("votes").desc(), "to")))
    holds, changed = F.coalesce(F.col("to") == F.col("stands"), F.lit(True)), F.coalesce(F.col("from") != F.col("to"), F.lit(False))
    each = slots.groupBy(*pair, "windows", "at", "pos").agg(F.bool_and(holds).alias("holds"), F.bool_or(changed).alias("changed"))
    each = each.groupBy(*pair, "windows", "at").agg(F.bool_or("holds").alias("holds"), F.bool_and("changed").alias("changed"))
    runs = each.groupBy(*pair, "windows").agg(F.count_if("holds").alias("found"), (~F.bool_or("changed")).alias("same")).where(F.col("found") >= SHARE * F.col("windows"))
    coverage = F.col("found") / F.col("windows")
    best = runs.groupBy("doc_id", F.col("item.item_id").alias("item_id")).agg(F.max(F.struct(coverage.alias("coverage"), "same", "found", "windows")).alias("best"))
    kind = F.when(F.col("best.same"), "verbatim").otherwise("re-parameterised")
    return best.select("doc_id", "item_id", "best.found", "best.windows", "best.coverage", kind.alias("kind"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones."""
    bad = matches(docs, items).select(F.col("doc_id").alias("bad_doc")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_doc"]), "left_anti")
