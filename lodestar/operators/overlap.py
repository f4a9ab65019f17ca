"""For each question the text that shares most words with it, by prefixes of its rarest words.

A text that shares ``n`` words with a question of ``m`` holds at least one of its ``m - n + 1`` rarest. Texts that hold one of a question's ``FIRST`` rarest
words are counted first; the best of them says how many words a better one must share, and that how few of the question's words the rest of the
search needs. So common words fetch nothing, as long as any text fits well, and what is found is what comparing all pairs would find.

Only words of questions are kept of the texts, as numbers; texts that keep the same ones are one from there on, and so are questions of the same words. Texts are dealt into slices and questions
into blocks, by how many words they have together. A task counts a block's questions in a slice's texts, in a table of bits for some of the texts at a time, and
gives one text a question: neither pairs nor the words of a pair are shuffled.

Defined results: ties go to the smaller id; questions and texts without words, and null ones, match nothing; rows with
equal ids are one text with the words of all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.written import materialize

FIRST = 3
#: Words that a slice's texts and a block's questions have together; bytes of a task's table of bits, and places of it looked up at once.
SLICE, BLOCK, TABLE, PLACES = 1_000_000, 1_000_000, 64_000_000, 4_000_000


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all lists, and where each list begins; the end is its last."""
    sizes = pc.list_value_length(lists).to_numpy()
    return pc.list_flatten(lists).to_numpy(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each range, one behind the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _few(bits: np.ndarray, held: np.ndarray, texts: np.ndarray, words: np.ndarray, at: np.ndarray, asks: np.ndarray, low: np.ndarray, high: np.ndarray):
    """``ask, text, shared`` of the questions ``asks``: texts come from the lists of their words, and each pair stays where its first word brings it."""
    start = np.cumsum(held) - held
    of = np.repeat(asks, high[asks] - low[asks])
    place = _ranges(low[asks], high[asks] - low[asks])
    listed = words[at[of] + place]
    width = at[of + 1] - at[of]
    part = np.cumsum(held[listed] * width) // PLACES
    for cut in np.split(np.arange(len(of)), np.flatnonzero(np.diff(part)) + 1):
        pairs = np.repeat(cut, held[listed[cut]])
        if len(pairs):
            text, widest = texts[_ranges(start[listed[cut]], held[listed[cut]])], width[cut].max()
            own = np.full((len(cut), widest), len(bits) - 1)
            own[np.arange(widest) < width[cut][:, None]] = words[_ranges(at[of[cut]], width[cut])]
            hit = bits.ravel().take(own[pairs - cut[0]] * bits.shape[1] + text[:, None])
            new = hit.argmax(1) == place[pairs]
            yield of[pairs][new], text[new], hit.sum(1)[new]


def _many(bits: np.ndarray, words: np.ndarray, ask: int, low: int, high: int):
    """``_few`` of one question, of whose texts there are many: its words are counted in all of them."""
    hit = bits[words]
    text = np.flatnonzero(hit[low:high].any(0) & ~hit[:low].any(0))
    return np.full(len(text), ask), text, hit.sum(0, dtype=np.int32)[text]


def _pairs(words: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, held: np.ndarray, begins: np.ndarray):
    """``ask, text, shared`` of the pairs to be counted: texts that hold one of the words ``low`` to ``high`` of a question, and none before."""
    known, words = np.unique(words, return_inverse=True)
    step = max(1, min(20_000, TABLE // (len(known) + 1)))
    for n in range(0, len(begins) - 1, step):
        ends = begins[n : n + step + 1]
        word, text = held[ends[0] : ends[-1]], np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        place = np.minimum(np.searchsorted(known, word), len(known) - 1)
        place, text = place[found := known[place] == word], text[found]
        bits = np.zeros((len(known) + 1, len(ends) - 1), bool)  # the last row is nobody's word
        bits[place, text] = True
        texts, lists = text[np.argsort(place, kind="stable")], np.bincount(place, minlength=len(known))
        upto = np.concatenate([[0], np.cumsum(lists[words])])
        brought = upto[at[:-1] + high] - upto[at[:-1] + low]
        many = brought > len(ends) // 8
        for ask, text, shared in _few(bits, lists, texts, words, at, np.flatnonzero(~many & (brought > 0)), low, high):
            yield ask, text + n, shared
        for q in np.flatnonzero(many):
            ask, text, shared = _many(bits, words[at[q] : at[q + 1]], q, low[q], high[q])
            yield ask, text + n, shared


def _counted(questions: pa.Table, texts: pa.Table, every: bool) -> pa.Table:
    """``ask, give, shared`` of each question's best text of a slice, or of every pair that is counted."""
    asks, gives, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(questions) and len(texts):
        questions = questions.take(pc.sort_indices(pc.list_value_length(questions["words"])))  # equally long ones beside each other
        texts = texts.take(pc.sort_indices(texts["give"]))
        low, high = (questions[c].to_numpy().astype(np.int64) for c in ("low", "high"))
        best = np.full(len(questions), -1)
        for ask, text, shared in _pairs(*_flat(questions["words"]), low, high, *_flat(texts["holds"])):
            if every:
                asks.append(ask), gives.append(text), counts.append(shared)
            else:
                np.maximum.at(best, ask, shared.astype(np.int64) * 2**32 - text)
        if not every:
            asks.append(kept := np.flatnonzero(best >= 0))
            counts.append(shared := -(-best[kept] // 2**32))
            gives.append(shared * 2**32 - best[kept])
    ask, give, shared = (pa.array(np.concatenate(x).astype(np.int64)) for x in (asks, gives, counts))
    return pa.table({"ask": questions["ask"].take(ask), "give": texts["give"].take(give), "shared": shared.cast(pa.int32())})


def _met(questions: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``_counted`` of ``questions(ask, words, low, high)`` in all slices of ``texts(give, holds)``: each slice's best, and every pair."""
    size = lambda df, c: df.agg(F.sum(F.size(c))).first()[0] or 0
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = size(questions, "words")
    slices, blocks = max(1, -(-size(texts, "holds") // SLICE)), max(1, -(-asked // BLOCK))
    left = questions.select("*", dealt("ask", blocks).alias("block"), all_(slices).alias("slice"))
    # Without questions no text moves.
    right = texts.where(F.lit(asked > 0)).select("*", dealt("give", slices).alias("slice"), all_(blocks).alias("block"))
    met = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice"))
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((questions, "ask"), (texts, "give")))

    def counted(every: bool) -> DataFrame:
        return met.applyInArrow(lambda q, t: _counted(q, t, every), f"{kinds}, shared int")

    return counted(False), counted(True)


def _best(met: DataFrame) -> DataFrame:
    """``ask, give, shared`` of each question's best text."""
    best = met.groupBy("ask").agg(F.min(F.struct((-F.col("shared")).alias("less"), "give")).alias("best"))
    return best.select("ask", "best.give", (-F.col("best.less")).alias("shared"))


def best(asked: DataFrame, given: DataFrame, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """``ask, give, shared`` of the best text of each question of ``asked(ask, words)`` among ``given(give, words)``; and all pairs that were counted."""
    each = materialize(asked.where("ask IS NOT NULL").select("ask", F.explode("words").alias("word")).distinct(), "asked-words")
    vocabulary = materialize(each.select("word").distinct().withColumn("code", F.monotonically_increasing_id()), "vocabulary")
    codes = given.where("give IS NOT NULL").select("give", F.explode("words").alias("word")).join(vocabulary, "word").groupBy("give").agg(F.sort_array(F.collect_set("code")).alias("holds"))
    held = materialize(codes.where(F.size("holds") >= least).groupBy("holds").agg(F.min("give").alias("give")), "held-words")
    rarity = held.select(F.explode("holds").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("texts"))
    ranked = each.join(vocabulary, "word").join(rarity, "code").groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("texts", "code"))).alias("words"))
    ranked = ranked.where(F.size("words") >= least).select("ask", F.transform("words", lambda w: w["code"]).alias("words"))
    alike = ranked.groupBy("words").agg(F.min("ask").alias("first"))
    ranked = materialize(ranked.join(alike, "words"), "ranked-words")
    questions = ranked.where(F.col("ask") == F.col("first")).select("ask", "words")

    def searched(of: DataFrame, low: int, high: Column) -> DataFrame:
        return of.select("ask", "words", F.lit(low).alias("low"), F.least(high, F.size("words")).cast("int").alias("high"))

    found, counted = _met(searched(questions, 0, F.lit(FIRST)), held)
    found = materialize(_best(found), "first-best")
    needed = F.size("words") - F.greatest(F.coalesce("shared", F.lit(0)), F.lit(least)) + 1
    better, more = _met(searched(questions.join(found, "ask", "left").where(needed > FIRST), FIRST, needed), held)
    found = _best(found.unionByName(better)).where(F.col("shared") >= least)
    same = ranked.select(F.col("ask").alias("own"), F.col("first").alias("ask")).join(found, "ask")
    return materialize(same.select(F.col("own").alias("ask"), "give", "shared"), "best-texts"), counted.unionByName(more)
