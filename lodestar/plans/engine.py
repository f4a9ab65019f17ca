"""Answers over one wide table: question, filters and retrieval, operation, evidence, answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from time import monotonic

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..config import Settings
from ..functions import text
from ..operators import aggregates, chunks, predicates, retrieval, schema, terms
from ..sources.written import drop, materialize
from . import compiled, matcher, operations, rewrite, together


@dataclass
class Answer:
    question: str
    operation: str
    answer: str
    support: str
    filters: dict[str, list[str]]
    evidence: list[str]
    unmatched: list[str] = field(default_factory=list)
    fell_back: bool = False
    risk: str = "High"
    method: str = ""
    confidence: str = "low"
    queries: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    debug: dict[str, object] = field(default_factory=dict)


class Engine:
    """Holds a knowledge table (with ``_row_id``) and what is known of its columns."""

    def __init__(self, table: DataFrame, settings: Settings | None = None, generator: rewrite.Generator | None = None, embed: Callable[[Column], Column] | None = None):
        self.table, self.settings, self.generator, self.embed = table, settings or Settings(), generator, embed
        self.vectors: DataFrame | None = None
        self.postings: retrieval.Kept | None = None
        self.texts = [c for c, t in table.dtypes if t == "string"]
        self.index = schema.index(table)
        self.match = predicates.matches(self.index)

    def numbers(self) -> list[str]:
        return [f.name for f in self.table.schema if isinstance(f.dataType, NumericType) and f.name != "_row_id"]

    def numeric_column(self, q: str) -> str | None:
        return compiled.metric(q, self.numbers())

    def group_column(self, q: str) -> str | None:
        """The text column that the question names, else the first whose values hold a longer word of it, as a whole word, in three of ten rows."""
        names = self.texts
        if named := compiled.group(q, names, {c.name: c.n_values for c in self.index.values()}):
            return named
        if not names or not (long := compiled.long_words(q)):
            return None
        holds = [F.avg(reduce(Column.__or__, [text.holds_word(F.col(c), w) for w in long]).cast("int")).alias(c) for c in names]
        share = self.table.agg(*holds).first()
        return next((c for c in names if (share[c] or 0) >= 0.3), None)

    def kept(self) -> retrieval.Kept:
        """The table's postings, made by the first question that searches."""
        if self.postings is None:
            self.postings = retrieval.keep(self.table, "_row_id", F.lower(chunks.row_text(self.table, self.texts, " ", " ")))
        return self.postings

    def retrieve(self, q: str, k: int | None = None, filters: dict[str, list[str]] | None = None, probes: list[str] | None = None) -> DataFrame:
        """Rows by fused BM25, overlap, vector and entity lists of every probe; the question and its phrases are the probes if none are given."""
        s = self.settings
        probes = (probes or rewrite.probes(q, self.index))[: s.most_probes or None]
        each = [retrieval.bm25_each(self.kept(), "_row_id", probes, s.probe_top_k), retrieval.overlap_each(self.table, probes, self.texts, "_row_id", s.probe_top_k)]
        lists = [found.select((2 * F.col("probe") + n).alias("list"), "_row_id", "rank") for n, found in enumerate(each)]
        n = 2 * len(probes)
        if filters:
            entity = predicates.entity_search(self.table, filters).withColumn("score", F.lit(1)).orderBy("_row_id").limit(s.probe_top_k)
            lists.append(retrieval.ranks(entity, "_row_id", n))
        for i, near in enumerate(self.nearest(probes), 1):
            lists.append(retrieval.ranks(near, "_row_id", n + i))
        # Probes that find few rows are joined by a wide search for the question itself.
        if reduce(DataFrame.unionByName, [x.select("_row_id") for x in lists]).distinct().limit(s.least_rows).count() < s.least_rows:
            lists.append(retrieval.ranks(retrieval.overlap(self.table, q, self.texts, "_row_id", s.fused_top_k), "_row_id", n + len(probes) + 1))
        fused = retrieval.rrf(lists, "_row_id", k=k or s.fused_top_k).select("_row_id", F.col("score").alias("_score"))
        return self.table.join(F.broadcast(fused), "_row_id")

    def rewritten(self, q: str, index: dict[str, schema.Column]) -> rewrite.Rewritten:
        """The question rewritten in two stages: probes, then queries in the terms that the probes' rows use. Without a generator, its phrases.

        Few rows or terms, or a filter that no row meets, make the result one of low trust.
        """
        s, begun = self.settings, rewrite.first(q, index, self.generator)
        if not self.generator:
            return begun
        filters = {c: v for c, v in begun.filters.items() if c in self.table.columns}
        rows = materialize(self.retrieve(q, filters={c: [v] for c, v in filters.items()}, probes=begun.queries), "probed")
        found = {r["term"]: list(r["columns"]) for r in terms.discover(rows, self.match, least=s.least_frequency, top=s.most_terms).collect()}
        quality = operations.retrieval_quality(rows, "_row_id", "_score", {v.lower(): c for c, v in filters.items()}).first().asDict()
        drop(rows)
        enough = len(found) >= s.least_terms
        done = rewrite.second(q, index, begun, found, self.generator if enough else None)
        missed = [v for v in filters.values() if not quality[f"hit_{v.lower()}"]]
        if quality["unique_rows"] < s.least_rows or not enough or not any(found.values()) or missed:
            return replace(done, confidence="low", warnings=[*done.warnings, "weak retrieval"])
        return done

    def nearest(self, asked: list[str], base: DataFrame | None = None) -> list[DataFrame]:
        """The rows, or those of ``base``, nearest to each probe; none without an embedder. The table's vectors are made once, as a written table."""
        if not self.embed:
            return []
        if self.vectors is None:
            body = chunks.row_text(self.table, self.texts)
            self.vectors = materialize(self.table.select("_row_id", self.embed(body).alias("embedding")), "vectors")
        known = self.vectors if base is None else self.vectors.join(base.select("_row_id"), "_row_id", "left_semi")
        probes = self.table.sparkSession.createDataFrame(list(enumerate(asked)), "n int, probe string").select("n", self.embed(F.col("probe")).alias("v")).orderBy("n").collect()
        return [retrieval.vector_search(known, r["v"], "_row_id", k=self.settings.top_k, threshold=self.settings.threshold).select("_row_id", "score") for r in probes]

    def vocabulary(self, rows: DataFrame) -> list[str]:
        return [r["term"] for r in terms.discover(rows, self.match, least=self.settings.least_frequency, top=self.settings.most_terms).collect()]

    def base(self, q: str, kind: str, filters: dict[str, list[str]], exhaustive: bool, probes: list[str]) -> tuple[DataFrame, bool]:
        """The rows that an operation sees, never cut short for an analytical one, and whether they are all rows for want of a hit."""
        hits = predicates.filtered(self.table, filters, self.match)
        some = bool(filters) and not hits.isEmpty()
        if kind in ("count", "rank", "aggregate_sum", "spof"):
            return (hits, False) if some else (self.table, bool(filters))
        if some:
            return hits, False
        single, used = predicates.best_single(self.table, filters, self.match, q)
        if used:
            return single, False
        return self.retrieve(q, max(self.settings.most_evidence, 100) if exhaustive else self.settings.most_evidence, filters, probes), True

    def alone(self) -> DataFrame | None:
        """The rows of roles that one company holds, if the table has both."""
        role = next((c for c in self.table.columns if "role" in c), None)
        return aggregates.single_points(self.table, role, "company") if role and "company" in self.table.columns else None

    def apply(self, kind: str, rows: DataFrame, q: str, direction: str = "desc", n: int = 1) -> DataFrame:
        """The operation's result, in order: of its own, of found rows' scores, else of ``_row_id``."""
        metric = self.numeric_column(q)
        if kind == "count":
            return aggregates.count(rows)
        if kind == "rank" and metric:
            return aggregates.ranked(rows, metric, "_row_id", n, direction)
        if kind == "aggregate_sum" and metric and (group := self.group_column(q)):
            return aggregates.grouped_sum(rows, group, metric, direction)
        if kind == "spof":
            alone = self.alone()
            return rows.limit(0) if alone is None else alone.orderBy("_row_id")
        return rows.orderBy(F.round("_score", 12).desc(), "_row_id") if "_score" in rows.columns else rows.orderBy("_row_id")

    def unheld(self) -> DataFrame | None:
        """``column, value, part``: values, and their parts between commas, of columns that have too many to hold."""
        many = [c for c in self.index.values() if not c.held and c.filterable]
        if not many:
            return None
        cells = self.table.select(F.explode(F.array(*[F.struct(F.lit(c.name).alias("column"), F.trim(c.name).alias("value")) for c in many])).alias("x")).select("x.*")
        cells = cells.where("value <> '' and lower(value) <> 'nan'").withColumn("part", F.lit(False))
        parts = cells.where(F.contains("value", F.lit(","))).select("column", F.explode(F.split("value", ",")).alias("value")).select("column", F.trim("value").alias("value"), F.lit(True).alias("part"))
        return cells.unionByName(parts.where(F.length("value") >= schema.LEAST_PART)).distinct()

    def known(self, q: str) -> dict[str, schema.Column]:
        """The columns, those of too many values to hold with the values that the question names."""
        cells = self.unheld()
        if cells is None:
            return self.index
        asked = self.table.sparkSession.createDataFrame([(0, q)], "id int, q string")
        hits = operations.value_matches(asked, cells).select("value").distinct().join(cells, "value").collect()
        named = lambda c, part: tuple(sorted(r["value"] for r in hits if r["column"] == c.name and r["part"] == part))
        return self.index | {c.name: replace(c, values=named(c, False), parts=named(c, True)) for c in self.index.values() if not c.held and c.filterable}

    def answer(self, q: str, n: int = 1) -> Answer:
        op, intent = operations.detect(q), operations.effective_intent(q, self.settings.strict)
        kind = str(intent["type"])
        index = self.known(q)
        said = self.rewritten(q, index)
        found = matcher.match(q, index)
        resolved = matcher.resolve(q, index)
        filters, warnings = predicates.merged(found.filters, resolved.filters, self.table.columns), list(said.warnings)
        if self.generator:
            for other in said.queries[1:]:
                filters = predicates.merged(filters, matcher.match(other, index).filters, self.table.columns)
            filters = filters or predicates.merged({}, said.filters, self.table.columns)
        filters, odd = compiled.without_odd_tiers(q, filters)
        warnings += [f"{v} doesn't filter {c}" for c, v in odd]
        rows, fell_back = self.base(q, kind, filters, bool(op["exhaustive"]) or said.exhaustive, said.queries)
        out = self.apply(kind, rows, q, str(intent.get("direction", "desc")), n)
        head = out.limit(self.settings.most_evidence).select(together.line(out).alias("line"), *(["count"] if kind == "count" else [])).collect()
        lines = [r["line"] for r in head]
        total = head[0]["count"] if kind == "count" else len(head)
        plain = f"There are {total}." if kind == "count" else "; ".join(lines[:5]) or "Nothing found."
        spoken, risk = self.said(q, plain, lines)
        support = operations.support_level(total, bool(filters), bool(found.unmatched))
        method = " + ".join(name for name, used in (("two stages", self.generator), ("filters", filters), ("BM25 and overlap", fell_back and "_score" in rows.columns), ("vectors", self.embed)) if used)
        return Answer(q, kind, spoken, support, filters, lines, found.unmatched, fell_back, risk, method or "whole table", said.confidence, said.queries, warnings, resolved.to_debug_dict())

    def said(self, q: str, plain: str, lines: list[str]) -> tuple[str, str]:
        """The generator's answer from the evidence, cleaned, or ``plain`` without one; and its risk, by what of it the evidence lacks."""
        prompt = f"Answer from the evidence alone.\nQuestion: {q}\nFound: {plain}\nEvidence:\n" + "\n".join(lines)
        raw = self.generator.generate(prompt) if self.generator else plain
        held = "\n".join([plain, *lines]) if lines else ""
        row = self.table.sparkSession.createDataFrame([(raw, held)], "answer string, evidence string")
        row = row.select(text.clean_answer(F.col("answer")).alias("answer"), "evidence")
        return tuple(row.select("answer", text.risk(F.col("answer"), F.col("evidence"))).first())

    def alike(self) -> bool:
        """Whether questions can be answered as a set: a generator or an embedder is asked for each alone."""
        return self.generator is None and self.embed is None

    def answered(self, asked: DataFrame) -> DataFrame:
        """An answer for each row of ``asked(question)``, in jobs whose number doesn't grow with the questions. Without a generator and an embedder only."""
        return together.answers(self, asked)

    def answers(self, asked: list[str]) -> DataFrame:
        """A row for each question. One by one, a question that fails has the error as its answer."""
        if self.alike():
            return self.answered(self.table.sparkSession.createDataFrame([(q,) for q in asked], "question string"))
        return self.timed(asked).drop("seconds")

    def timed(self, asked: list[str]) -> DataFrame:
        rows = []
        for q in asked:
            begun = monotonic()
            try:
                a = asdict(self.answer(q))
                row = (q, a["operation"], a["answer"], a["support"], len(a["evidence"]), a["fell_back"], a["risk"])
            except Exception as e:
                row = (q, "error", f"{type(e).__name__}: {e}"[:200], "Not Supported", 0, False, "High")
            rows.append((*row, monotonic() - begun))
        return self.table.sparkSession.createDataFrame(rows, "question string, operation string, answer string, support string, evidence_count long, fell_back boolean, risk string, seconds double")

    def evaluated(self, sheet: DataFrame) -> DataFrame:
        """A sheet of questions with human answers, each with its answer, the F1 of both and the seconds it took: as a set, its share of them."""
        asked = sheet.select("question").distinct()
        if self.alike():
            begun = monotonic()
            said = materialize(self.answered(asked), "answers")
            spent, n = monotonic() - begun, said.count()
            said = said.withColumn("seconds", F.lit(spent / max(n, 1)))
        else:
            said = self.timed([r["question"] for r in asked.orderBy("question").collect()])
        return sheet.join(said, "question").withColumn("f1", F.coalesce(text.token_f1(F.col("answer"), F.col("human_answer")), F.lit(0.0)))
