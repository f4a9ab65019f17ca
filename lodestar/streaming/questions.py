"""Answering a stream of questions, and emitting an answer word by word."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import batched

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.cleaning import dense_ids
from ..plans.engine import Answer, Engine


#: Questions of a written slice; that many the driver holds at once, where each is asked of a generator or an embedder.
SLICE = 500


def answer_stream(questions: DataFrame, engine: Engine, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of ``questions(question)`` is answered as a set and written in slices, or slice by slice where a generator or an embedder is asked; a repeated batch overwrites its own."""
    def batch(df: DataFrame, n: int) -> None:
        if engine.alike():
            said = dense_ids(engine.answered(df.select("question")), "question").withColumn("slice", F.expr(f"_row_id div {SLICE}")).drop("_row_id")
            said.write.mode("overwrite").partitionBy("slice").parquet(f"{path}/batch={n}")
            return
        asked = (r["question"] for r in df.select("question").toLocalIterator())
        for i, part in enumerate(batched(asked, SLICE)):
            engine.answers(list(part)).write.mode("overwrite").parquet(f"{path}/batch={n}/slice={i}")

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by type and window; what comes later than ``late`` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def server_sent(answer: Answer) -> Iterator[str]:
    """Server-sent events: what is known of the answer, its words, and the end."""
    yield f"data: {json.dumps({'operation': answer.operation, 'support': answer.support, 'filters': answer.filters})}\n\n"
    for word in answer.answer.split():
        yield f"data: {json.dumps(word + ' ')}\n\n"
    yield "data: [DONE]\n\n"
