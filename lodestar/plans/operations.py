"""What a question asks for. One table of patterns serves single questions, columns of questions, and SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import automaton, overlap

#: The words that route a question.
SPOF = (
    r"single\s+point\s+of\s+failure", r"sole\s+supplier", r"only\s+one\s+supplier", r"only\s+one\s+company", r"only\s+a\s+single\s+company", r"only\s+a\s+single\s+supplier", r"single\s+supplier", r"sole\s+provider",
    r"roles?\s+with\s+(?:only\s+)?one\s+company", r"roles?\s+(?:served|covered|filled)\s+by\s+(?:only\s+)?(?:a\s+)?single", r"roles?\s+(?:served|covered|filled)\s+by\s+(?:only\s+)?one",
)
HIGH = ("highest", "most", "maximum", "largest", "top", "biggest", "greatest")
LOW = ("lowest", "minimum", "fewest", "least", "smallest", "bottom")
SUM = ("total", "sum", "combined", "aggregate", "overall")
NUMBER = ("employment", "employee", "employees", "jobs", "headcount", "investment", "amount", "capacity")
GROUP = ("county", "counties", "city", "cities", "tier", "role", "roles", "category", "categories", "type", "types", "location", "locations")
COUNT = (r"how\s+many", "count", r"number\s+of", r"total\s+number")
EXHAUSTIVE = ("all", "every", r"complete\s+list", r"full\s+list", "entire", *COUNT, "total", "sum", "combined", "highest", "lowest", "maximum", "minimum", "most", "least", "top", "bottom", r"single\s+point\s+of\s+failure", r"sole\s+supplier", r"only\s+one")
ANALYTICAL = (r"single\s+point\s+of\s+failure", r"sole\s+supplier", r"only\s+one", *COUNT[:3], *SUM, *HIGH, *LOW, "average", "rank", "ranking")
#: What the intent of the older rules looks for besides.
INTENT_SPOF = ("single point of failure", "sole supplier", "only one company", "only a single", "sole provider", "single supplier")
INTENT_NUMBER = (*NUMBER, "count", "number")


def bounded(words: tuple[str, ...]) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


def has(q: Column, words: tuple[str, ...]) -> Column:
    return F.regexp_like(F.lower(q), F.lit(bounded(words)))


def has_sql(q: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches(lower({q}), '{bounded(words)}')"


def operation(q: Column) -> Column:
    grouped = has(q, GROUP) & (has(q, SUM) | has(q, HIGH) | has(q, LOW)) & has(q, NUMBER)
    chain = F.when(has(q, SPOF), "spof").when(has(q, COUNT), "count").when(grouped | (has(q, SUM) & has(q, GROUP)), "aggregate_sum")
    return chain.when(has(q, EXHAUSTIVE), "exhaustive_list").otherwise("none")


def operation_sql(q: str) -> str:
    h = lambda w: has_sql(q, w)
    return f"CASE WHEN {h(SPOF)} THEN 'spof' WHEN {h(COUNT)} THEN 'count' WHEN ({h(GROUP)} AND ({h(SUM)} OR {h(HIGH)} OR {h(LOW)}) AND {h(NUMBER)}) OR ({h(SUM)} AND {h(GROUP)}) THEN 'aggregate_sum' WHEN {h(EXHAUSTIVE)} THEN 'exhaustive_list' ELSE 'none' END"


def direction(q: Column) -> Column:
    return F.when(has(q, LOW), "asc").otherwise("desc")


def direction_sql(q: str) -> str:
    return f"CASE WHEN {has_sql(q, LOW)} THEN 'asc' ELSE 'desc' END"


def exhaustive(q: Column) -> Column:
    return has(q, EXHAUSTIVE) | has(q, SPOF) | has(q, COUNT)


def exhaustive_sql(q: str) -> str:
    return f"({has_sql(q, EXHAUSTIVE)} OR {has_sql(q, SPOF)} OR {has_sql(q, COUNT)})"


def intent(q: Column) -> Column:
    spof = F.lit(False)
    for p in INTENT_SPOF:
        spof = spof | F.contains(F.lower(q), F.lit(p))
    ranked = has(q, HIGH) | has(q, LOW)
    summed = has(q, SUM)
    chain = F.when(spof, "spof").when(has(q, COUNT), "count").when(has(q, GROUP) & ((summed | ranked) & has(q, INTENT_NUMBER) | summed), "aggregate_sum")
    return chain.when(ranked, "rank").otherwise("filter")


def intent_sql(q: str) -> str:
    h = lambda w: has_sql(q, w)
    spof = " OR ".join(f"contains(lower({q}), '{p}')" for p in INTENT_SPOF)
    return f"CASE WHEN {spof} THEN 'spof' WHEN {h(COUNT)} THEN 'count' WHEN {h(GROUP)} AND ((({h(SUM)}) OR {h(HIGH)} OR {h(LOW)}) AND {h(INTENT_NUMBER)} OR {h(SUM)}) THEN 'aggregate_sum' WHEN {h(HIGH)} OR {h(LOW)} THEN 'rank' ELSE 'filter' END"


def found(q: str, words: tuple[str, ...]) -> bool:
    return re.search(bounded(words), q or "", re.I | re.A) is not None


def detect(q: str) -> dict[str, object]:
    """The same for one question, on the driver: operation, direction, exhaustive, the metric and the group named."""
    named = lambda words: next((m[0].lower() for m in [re.search(bounded(words), q or "", re.I | re.A)] if m), None)
    grouped = found(q, GROUP) and (found(q, SUM) or found(q, HIGH) or found(q, LOW)) and found(q, NUMBER)
    kind = "spof" if found(q, SPOF) else "count" if found(q, COUNT) else "aggregate_sum" if grouped or found(q, SUM) and found(q, GROUP) else "exhaustive_list" if found(q, EXHAUSTIVE) else "none"
    phrases = sorted({m[0].lower() for m in re.finditer(bounded(ANALYTICAL), q or "", re.I | re.A)})
    return {
        "operation": kind, "direction": "asc" if found(q, LOW) else "desc", "exhaustive": found(q, EXHAUSTIVE) or kind in ("spof", "count"), "metric": named(NUMBER), "group_by": named(GROUP), "analytical_phrases": phrases,
    }


def detect_intent(q: str) -> dict[str, object]:
    low = (q or "").lower()
    direction_ = "asc" if found(q, LOW) else "desc"
    if any(p in low for p in INTENT_SPOF):
        return {"type": "spof"}
    if found(q, COUNT):
        return {"type": "count"}
    ranked = found(q, HIGH) or found(q, LOW)
    if found(q, GROUP) and ((found(q, SUM) or ranked) and found(q, INTENT_NUMBER) or found(q, SUM)):
        return {"type": "aggregate_sum", "direction": direction_}
    return {"type": "rank", "n": 1, "direction": direction_} if ranked else {"type": "filter"}


def effective_intent(q: str, strict: bool = False) -> dict[str, object]:
    """The operation decides unless it is none; a list that is asked in order is a rank, but for ``strict``."""
    op, own = detect(q), detect_intent(q)
    if op["operation"] == "none" or op["operation"] == "exhaustive_list" and own["type"] == "rank" and not strict:
        return own
    return {"type": op["operation"], "direction": op["direction"]}


def analytical_tokens(q: str) -> set[str]:
    """The words of a question's analytical phrases, which never filter."""
    return {w for m in re.finditer(bounded(ANALYTICAL), q or "", re.I | re.A) for w in m[0].lower().split()}


def is_analytical_phrase(phrase: str) -> bool:
    return re.fullmatch(bounded(ANALYTICAL), phrase.strip(), re.I | re.A) is not None


#: Column names (in part) that each kind of phrase may filter; None is any column.
COLUMNS = {
    "tier": ("category", "tier", "supplier_type", "supplier_or_affiliation_type", "affiliation", "classification"),
    "product_component": ("ev_supply_chain_role", "role", "product_service", "product", "service", "industry_group", "primary_facility_type"),
    "location": ("location", "updated_location", "county", "city", "state", "address", "region"),
    "analytical": (),
    "general": None,
}
#: Words that make a phrase one of a product, or of a place.
PRODUCT = (
    "battery", "cell", "pack", "module", "modules", "thermal", "power", "electronics", "motor", "motors", "charging", "charger", "wiring", "harness", "component",
    "components", "materials", "management",
)
PLACE = (
    "county", "city", "georgia", "location", "region", "state",
)


def phrase_kind(p: Column) -> Column:
    low = F.lower(p)
    return (
        F.when(F.regexp_like(low, F.lit(r"\btier\s*[0-9]")), "tier")
        .when(F.regexp_like(F.trim(low), F.lit(f"^{bounded(ANALYTICAL)}$")), "analytical")
        .when(F.regexp_like(low, F.lit(bounded(tuple(PRODUCT)))), "product_component")
        .when(F.regexp_like(low, F.lit(bounded(tuple(PLACE)))), "location")
        .otherwise("general")
    )


def phrase_kind_sql(p: str) -> str:
    matches = lambda c, pattern: f"regexp_matches({c}, '{pattern}')"
    return (
        rf"CASE WHEN {matches(f'lower({p})', r'\btier\s*[0-9]')} THEN 'tier' WHEN {matches(f'trim(lower({p}))', f'^{bounded(ANALYTICAL)}$')} THEN 'analytical' "
        f"WHEN {matches(f'lower({p})', bounded(tuple(PRODUCT)))} THEN 'product_component' WHEN {matches(f'lower({p})', bounded(tuple(PLACE)))} THEN 'location' ELSE 'general' END"
    )


def kind_of(phrase: str) -> str:
    if re.search(r"\btier\s*\d", phrase, re.I):
        return "tier"
    if is_analytical_phrase(phrase):
        return "analytical"
    return "product_component" if found(phrase, tuple(PRODUCT)) else "location" if found(phrase, tuple(PLACE)) else "general"


def fits_column(phrase: str, column: str) -> bool:
    allowed = COLUMNS[kind_of(phrase)]
    return allowed is None or any(a in re.sub(r"[^a-z0-9]+", "_", column.lower()) for a in allowed)


def support(total: Column, has_filters: Column, has_unmatched: Column) -> Column:
    return (
        F.when((total == 0) & ~has_filters, "Not Supported")
        .when((total >= 3) & has_filters & ~has_unmatched, "Fully Supported")
        .when((total >= 2) & has_filters, "Mostly Supported")
        .when((total >= 1) & has_filters, "Partially Supported")
        .otherwise("Weakly Supported")
    )


def support_level(total: int, filters: bool, unmatched: bool) -> str:
    if total == 0 and not filters:
        return "Not Supported"
    if filters and total >= 1:
        return "Fully Supported" if total >= 3 and not unmatched else "Mostly Supported" if total >= 2 else "Partially Supported"
    return "Weakly Supported"


def value_matches(asked: DataFrame, values: DataFrame, least: int = 3) -> DataFrame:
    """``id, value``: the values that stand in each question of ``asked(id, q)``, whatever the case."""
    return automaton.holders(asked, values, least)


def best_answers(asked: DataFrame, given: DataFrame, ask_id: str, give_id: str, body: str = "text", least: int = 5) -> DataFrame:
    """For each question the text that shares most words with it, at least ``least``; ties to the smaller id."""
    words = text.long_answer_words(F.col(body)).alias("words")
    found, _ = overlap.best(asked.select(F.col(ask_id).alias("ask"), words), given.select(F.col(give_id).alias("give"), words), least)
    return found.select(F.col("ask").alias(ask_id), F.col("give").alias(give_id), "shared")


def summary(scored: DataFrame) -> DataFrame:
    f1 = F.col("f1")
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg(f1).alias("mean_f1"), F.count_if(f1 >= 0.8).alias("good"), F.count_if(f1 >= 0.5).alias("fair"), F.count_if(f1 == 0).alias("none"))


def support_counts(scored: DataFrame) -> DataFrame:
    """``support, n, with_evidence``: answers by support, the commonest first, and how many of them have any evidence."""
    counts = scored.groupBy("support").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("evidence_count") > 0).alias("with_evidence"))
    return counts.orderBy(F.col("n").desc(), "support")


def retrieval_quality(found_rows: DataFrame, key: str, score: str, hits: dict[str, str]) -> DataFrame:
    """One row: distinct rows, mean score, and whether each word stands in its column."""
    return found_rows.agg(
        F.count_distinct(key).alias("unique_rows"), F.avg(F.col(score).try_cast("double")).alias("mean_score"), *[F.bool_or(F.contains(F.lower(c), F.lit(w))).alias(f"hit_{w}") for w, c in hits.items()]
    )
