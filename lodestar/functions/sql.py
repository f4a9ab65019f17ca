"""The cleaning and text functions for queries in SQL text, as SQL functions that Spark inlines: no Python, the same plans as the Column forms.

``register(spark)`` makes them for a session: ``clean_numeric``, ``extract_county``, ``token_words``, ``token_f1``, ``record_id``, ``ngram_list``, an array, and ``text_ngrams``, a table
function for ``FROM documents, LATERAL text_ngrams(text, 3)``; Spark joins its rows back by the whole text, so large tables take the list. Nulls give what the Column forms give.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .cleaning import NULL_TOKENS

_TOKENS = ", ".join(f"'{t}'" for t in NULL_TOKENS)
#: A value made once, however often it is used, is the one element of an array.
_CELL = rf"get(transform(array(trim(regexp_replace(cell, '[ \\t\\n\\x0B\\f\\r]+', ' '))), f -> CASE WHEN lower(f) NOT IN ({_TOKENS}) THEN f END), 0)"
_WORDS = "array_distinct(filter(split(lower({c}), '[^a-z0-9_]+'), w -> length(w) >= 3))"
_F1 = "CASE WHEN size(s.x) > 0 AND size(s.y) > 0 THEN 2.0D * size(array_intersect(s.x, s.y)) / (size(s.x) + size(s.y)) ELSE 0.0D END"
DEFINITIONS = (
    f"clean_cell(cell STRING) RETURNS STRING RETURN {_CELL}",
    f"clean_numeric(cell STRING) RETURNS DOUBLE RETURN try_cast(regexp_extract(replace({_CELL}, ',', ''), '-?[0-9]+([.][0-9]+)?', 0) AS DOUBLE)",
    "extract_county(place STRING) RETURNS STRING RETURN coalesce(trim(get(filter(split(place, ','), p -> contains(lower(p), 'county')), 0)), trim(place), 'Unknown')",
    f"token_words(said STRING) RETURNS ARRAY<STRING> RETURN {_WORDS.format(c='said')}",
    f"token_f1(a STRING, b STRING) RETURNS DOUBLE RETURN get(transform(array(named_struct('x', {_WORDS.format(c='a')}, 'y', {_WORDS.format(c='b')})), s -> {_F1}), 0)",
    """record_id(row_id BIGINT, parts ARRAY<STRING>) RETURNS STRING RETURN
    concat('KB_ROW_', format_string('%04d', row_id), '_', left(md5(CAST(concat_ws('|', array_join(parts, '|', ''), CAST(row_id AS STRING)) AS BINARY)), 12))""",
    """ngram_list(said STRING, longest INT) RETURNS ARRAY<STRING> RETURN
    get(transform(array(regexp_extract_all(lower(said), '[a-z][a-z0-9-]*', 0)), words -> flatten(transform(sequence(1, longest), n -> transform(CASE WHEN size(words) >= n THEN sequence(1, size(words) - n + 1) ELSE CAST(array() AS ARRAY<INT>) END, i -> array_join(slice(words, i, n), ' '))))), 0)""",
    """text_ngrams(said STRING, longest INT) RETURNS TABLE(gram STRING) RETURN
    SELECT explode(flatten(transform(sequence(1, longest), n -> transform(CASE WHEN size(words) >= n THEN sequence(1, size(words) - n + 1) ELSE CAST(array() AS ARRAY<INT>) END, i -> array_join(slice(words, i, n), ' ')))))
    FROM (SELECT regexp_extract_all(lower(said), '[a-z][a-z0-9-]*', 0) AS words)""",
)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions for this session, in place of any of the same names, and returns their names."""
    for definition in DEFINITIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")
    return [d.split("(", 1)[0] for d in DEFINITIONS]
