"""The queries over the tables of a data folder, each with SQL that another engine can run on the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cleaning, sql, text, variants
from .operators import aggregates, chunks, predicates, retrieval, schema, terms
from .plans import operations
from .sources import upsert, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table that a query writes on its way."""
    return f"{written.folder(spark)}/{name}-{uuid.uuid4().hex}"


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


PART = {"p_name": "partial", "p_type": "exact", "p_brand": "exact"}
#: A knowledge table made of suppliers: a place, a role and a number for each.
SUPPLIER_KB = """SELECT s_suppkey AS _row_id, s_name AS company, 'Cat ' || CAST(s_suppkey % 3 AS VARCHAR) AS category, 'City ' || n_name || ', ' || n_name || ' County' AS updated_location,
 CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'role ' || CAST(s_suppkey % 40 AS VARCHAR) END AS ev_supply_chain_role, CAST(s_acctbal AS DOUBLE) AS employment
 FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def supplier_kb(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("s_suppkey").alias("_row_id"), F.col("s_name").alias("company"), F.concat(F.lit("Cat "), F.col("s_suppkey") % 3).alias("category"),
        F.concat(F.lit("City "), "n_name", F.lit(", "), "n_name", F.lit(" County")).alias("updated_location"),
        F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit("role "), F.col("s_suppkey") % 40)).alias("ev_supply_chain_role"), F.col("s_acctbal").cast("double").alias("employment"),
    )


@query("SELECT n_name, round(sum(s_acctbal), 6) AS total_s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def agg_sum_by_group(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return aggregates.grouped_sum(s.join(n, s["s_nationkey"] == n["n_nationkey"]), "n_name", "s_acctbal").withColumn("total_s_acctbal", r6("total_s_acctbal"))


@query("SELECT n_name, round(sum(c_acctbal), 6) AS total_c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def agg_sum_asc(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return aggregates.grouped_sum(c.join(n, c["c_nationkey"] == n["n_nationkey"]), "n_name", "c_acctbal", "asc").withColumn("total_c_acctbal", r6("total_c_acctbal"))


@query(f"SELECT trim(split_part(updated_location, ',', 2)) AS updated_location, round(sum(employment), 6) AS total_employment FROM ({SUPPLIER_KB}) GROUP BY 1")
def agg_sum_by_county(spark, d):
    return aggregates.grouped_sum(supplier_kb(spark, d), "updated_location", "employment").withColumn("total_employment", r6("total_employment"))


@query("SELECT count(*) AS \"count\" FROM part WHERE lower(p_type) = 'economy' AND (lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%bolt%')")
def count_filtered(spark, d):
    return aggregates.count(predicates.filtered(table(spark, d, "part"), {"p_type": ["economy"], "p_name": ["ring", "Bolt"]}, PART))


@query(f"""WITH k AS ({SUPPLIER_KB}), one AS (SELECT ev_supply_chain_role AS r, count(DISTINCT company) AS company_count FROM k WHERE ev_supply_chain_role IS NOT NULL GROUP BY 1 HAVING count(DISTINCT company) = 1)
SELECT _row_id, company, ev_supply_chain_role, company_count FROM k JOIN one ON r = ev_supply_chain_role""")
def spof_groups(spark, d):
    return aggregates.single_points(supplier_kb(spark, d), "ev_supply_chain_role", "company").select("_row_id", "company", "ev_supply_chain_role", "company_count")


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 1")
def rank_top1(spark, d):
    return aggregates.ranked(table(spark, d, "part"), "p_retailprice", "p_partkey").select("p_partkey", "p_name", "p_retailprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC NULLS LAST, o_orderkey LIMIT 25")
def rank_bottom_n(spark, d):
    return aggregates.ranked(table(spark, d, "orders"), "o_totalprice", "o_orderkey", 25, "asc").select("o_orderkey", "o_totalprice")


def part_filter(filters, match=PART):
    return lambda spark, d: predicates.filtered(table(spark, d, "part"), filters, match).select("p_partkey", "p_name", "p_type", "p_brand")


def named(name: str, f: Query, sql: str | None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


PARTS = "SELECT p_partkey, p_name, p_type, p_brand FROM part WHERE "
named("filter_exact", part_filter({"p_type": ["Promo"]}), PARTS + "p_type = 'PROMO'")
named("filter_partial", part_filter({"p_name": ["GEAR"]}), PARTS + "contains(lower(p_name), 'gear')")
named("filter_and_or", part_filter({"p_type": ["PROMO", "small"], "p_name": ["gear", "anvil"]}), PARTS + "p_type IN ('PROMO', 'SMALL') AND (contains(p_name, 'gear') OR contains(p_name, 'anvil'))")
named("filter_exact_fallback_contains", part_filter({"p_type": ["ECON"]}), PARTS + "contains(lower(p_type), 'econ')")
named("filter_none", part_filter({}), PARTS + "true")


@query(PARTS + "contains(lower(p_name), 'gear systems') OR contains(lower(p_name), 'gear')")
def filter_word_expansion(spark, d):
    return predicates.best_single(table(spark, d, "part"), {"p_name": ["gear systems"]}, PART)[0].select("p_partkey", "p_name", "p_type", "p_brand")


@query(f"""WITH h AS (SELECT 1 AS k, 0 AS soft, count(*) FILTER (p_type = 'PROMO') AS n FROM part UNION ALL SELECT 2, 0, count(*) FILTER (p_brand = 'Brand#2') FROM part UNION ALL SELECT 3, 1, count(*) FILTER (contains(p_name, 'gizmo')) FROM part),
w AS (SELECT k FROM h WHERE n > 0 ORDER BY soft, n, k LIMIT 1)
SELECT p_partkey, p_name, p_type, p_brand FROM part, w WHERE (k = 1 AND p_type = 'PROMO') OR (k = 2 AND p_brand = 'Brand#2') OR (k = 3 AND contains(p_name, 'gizmo'))""")
def filter_best_single(spark, d):
    return predicates.best_single(table(spark, d, "part"), {"p_type": ["PROMO"], "p_brand": ["Brand#2"], "p_name": ["gizmo"]}, PART)[0].select("p_partkey", "p_name", "p_type", "p_brand")


@query("SELECT p_partkey, p_type FROM part")
def deterministic_base_fallback(spark, d):
    return predicates.deterministic_base(table(spark, d, "part"), {"p_type": ["no such type"]}, PART).select("p_partkey", "p_type")


@query("SELECT p_partkey, p_type FROM part WHERE false")
def deterministic_base_empty(spark, d):
    return predicates.deterministic_base(table(spark, d, "part"), {"p_type": ["no such type"]}, PART, False).select("p_partkey", "p_type")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_mktsegment), 'house') AND (contains(lower(c_name), '#00000001') OR contains(lower(c_name), '7'))")
def entity_search(spark, d):
    return predicates.entity_search(table(spark, d, "customer"), {"c_mktsegment": ["House"], "c_name": ["#00000001", "7"], "absent": ["x"]}).select("c_custkey", "c_name", "c_mktsegment")


#: Cells made dirty in known ways, by the row's number.
DIRTY = """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '  ' || p_name || chr(13) || chr(10) || ' x ' WHEN 1 THEN 'n/a' WHEN 2 THEN NULL WHEN 3 THEN '  ' WHEN 4 THEN 'about 1,' || CAST(p_size + 100 AS VARCHAR) || '.5 people'
 WHEN 5 THEN '-' || CAST(p_size AS VARCHAR) WHEN 6 THEN p_name || ' / A, B|C & ; D' ELSE 'None' END AS cell,
 CASE p_partkey % 6 WHEN 0 THEN ' Y' WHEN 1 THEN 'partially' WHEN 2 THEN '0' WHEN 3 THEN 'maybe' WHEN 4 THEN 'TRUE' ELSE NULL END AS flag,
 CASE p_partkey % 6 WHEN 0 THEN 'An Automaker, supplier too' WHEN 1 THEN 'OEM' WHEN 2 THEN 'tier supplier' WHEN 3 THEN 'oem maker' WHEN 4 THEN 'participant' ELSE '' END AS kind FROM part"""


def dirty(spark: SparkSession, d: str) -> DataFrame:
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string")
    cell = F.when(k % 8 == 0, F.concat(F.lit("  "), name, F.lit("\r\n x "))).when(k % 8 == 1, "n/a").when(k % 8 == 2, None).when(k % 8 == 3, "  ")
    cell = cell.when(k % 8 == 4, F.concat(F.lit("about 1,"), (F.col("p_size") + 100).cast("string"), F.lit(".5 people"))).when(k % 8 == 5, F.concat(F.lit("-"), size)).when(k % 8 == 6, F.concat(name, F.lit(" / A, B|C & ; D"))).otherwise("None")
    flag = F.when(k % 6 == 0, " Y").when(k % 6 == 1, "partially").when(k % 6 == 2, "0").when(k % 6 == 3, "maybe").when(k % 6 == 4, "TRUE")
    kind = F.when(k % 6 == 0, "An Automaker, supplier too").when(k % 6 == 1, "OEM").when(k % 6 == 2, "tier supplier").when(k % 6 == 3, "oem maker").when(k % 6 == 4, "participant").otherwise("")
    return table(spark, d, "part").select("p_partkey", cell.alias("cell"), flag.alias("flag"), kind.alias("kind"))


CLEAN = r"CASE WHEN lower(trim(regexp_replace(cell, '\s+', ' ', 'g'))) IN ('', 'nan', 'none', 'null', 'na', 'n/a') THEN NULL ELSE trim(regexp_replace(cell, '\s+', ' ', 'g')) END"


@query(f"SELECT p_partkey, {CLEAN} AS cleaned, coalesce({CLEAN}, 'Unknown') AS shown FROM ({DIRTY})")
def clean_text(spark, d):
    c = cleaning.text(F.col("cell"))
    return dirty(spark, d).select("p_partkey", c.alias("cleaned"), cleaning.present(c).alias("shown"))


@query(f"SELECT p_partkey, TRY_CAST(nullif(regexp_extract(replace({CLEAN}, ',', ''), '-?[0-9]+([.][0-9]+)?', 0), '') AS DOUBLE) AS number FROM ({DIRTY})")
def clean_numeric(spark, d):
    return dirty(spark, d).select("p_partkey", cleaning.number(F.col("cell")).alias("number"))


@query(f"SELECT p_partkey, CASE WHEN lower(trim(flag)) IN ('yes','y','true','1') THEN 'Yes' WHEN lower(trim(flag)) IN ('no','n','false','0') THEN 'No' WHEN lower(trim(flag)) IN ('indirect','indirectly','partial','partially') THEN 'Indirect' ELSE 'Unknown' END AS relevance FROM ({DIRTY})")
def normalize_enum(spark, d):
    return dirty(spark, d).select("p_partkey", cleaning.relevance(F.col("flag")).alias("relevance"))


@query(f"""SELECT p_partkey, CASE WHEN contains(lower(kind), 'original equipment manufacturer') OR lower(kind) = 'oem' OR contains(lower(kind), 'automaker') OR contains(lower(kind), 'vehicle manufacturer') THEN 'Original Equipment Manufacturer'
 WHEN contains(lower(kind), 'supplier') OR contains(lower(kind), 'supply chain') OR contains(lower(kind), 'participant') THEN 'Automotive supply chain participant' ELSE 'Unknown' END AS affiliation FROM ({DIRTY})""")
def normalize_substring_enum(spark, d):
    return dirty(spark, d).select("p_partkey", cleaning.affiliation(F.col("kind")).alias("affiliation"))


@query(f"SELECT p_partkey, nullif(array_to_string(list_filter(list_transform(regexp_split_to_array({CLEAN}, '[/,|&;]'), lambda x: trim(x)), lambda x: x <> ''), '; '), '') AS oems FROM ({DIRTY})")
def split_multi_value(spark, d):
    return dirty(spark, d).select("p_partkey", cleaning.multi_value(F.col("cell")).alias("oems"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(' ' || p_name || ' / ' || p_brand || ' (%) ')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM part")
def norm_column(spark, d):
    raw = F.concat(F.lit(" "), "p_name", F.lit(" / "), "p_brand", F.lit(" (%) "))
    return table(spark, d, "part").select("p_partkey", cleaning.normalised_name(raw).alias("name"))


@query(f"SELECT count(*) FILTER ({CLEAN} IS NULL) AS missing, count(*) AS n_rows FROM ({DIRTY})")
def null_tokens(spark, d):
    return dirty(spark, d).agg(F.count_if(cleaning.text(F.col("cell")).isNull()).alias("missing"), F.count(F.lit(1)).alias("n_rows"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS _row_id FROM orders WHERE o_orderstatus <> 'P'")
def row_ids(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", F.struct("o_totalprice", "o_orderkey").alias("place"))
    return cleaning.dense_ids(o, "place").select("o_orderkey", "_row_id")


@query(f"SELECT _row_id, trim(split_part(updated_location, ',', 2)) AS county, company FROM ({SUPPLIER_KB})")
def extract_component(spark, d):
    return supplier_kb(spark, d).select("_row_id", text.component(F.col("updated_location")).alias("county"), "company")


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def value_counts(spark, d):
    return aggregates.value_counts(table(spark, d, "customer"), "c_mktsegment")


@query(f"""WITH k AS ({SUPPLIER_KB}), n AS (SELECT count(*) AS n FROM k)
SELECT 'ev_supply_chain_role' AS "column", count(*) FILTER (coalesce(ev_supply_chain_role, 'Unknown') = 'Unknown') AS missing, round(100.0 * count(*) FILTER (coalesce(ev_supply_chain_role, 'Unknown') = 'Unknown') / any_value(n), 2) AS percent FROM k, n
UNION ALL SELECT 'category', 0, 0.0""")
def missing_summary(spark, d):
    return aggregates.missing_summary(supplier_kb(spark, d).select("ev_supply_chain_role", "category"))


PROFILE = """SELECT '{c}' AS "column", count(*) AS n_values, round(avg(length(v)), 6) AS mean_length, CASE WHEN count(*) <= 60 AND avg(length(v)) <= 50 THEN 'exact' ELSE 'partial' END AS "match" FROM (SELECT DISTINCT trim({c}) AS v FROM part WHERE trim({c}) <> '' AND lower({c}) <> 'nan')"""


@query(" UNION ALL ".join(PROFILE.format(c=c) for c in ("p_name", "p_brand", "p_type")))
def schema_index(spark, d):
    return schema.profile(table(spark, d, "part")).withColumn("mean_length", r6("mean_length"))


@query(f"SELECT DISTINCT trim(c) AS component FROM (SELECT unnest(string_split(updated_location, ',')) AS c FROM ({SUPPLIER_KB})) WHERE length(trim(c)) >= 3")
def components(spark, d):
    return schema.components(supplier_kb(spark, d), "updated_location")


ID = "'KB_ROW_' || printf('%04d', s_suppkey) || '_' || substr(md5(s_name || '|' || coalesce(CASE WHEN s_suppkey % 3 > 0 THEN 'p' END, '') || '|' || CAST(s_suppkey AS VARCHAR)), 1, 12)"


@query(f"SELECT s_suppkey, {ID} AS record_id FROM supplier")
def record_id(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", chunks.record_id(F.col("s_suppkey"), [F.col("s_name"), F.when(F.col("s_suppkey") % 3 > 0, "p")]).alias("record_id"))


KB_ID = "'KB_ROW_' || printf('%04d', _row_id) || '_' || substr(md5(company || '|' || updated_location || '|Unknown|' || category || '|Unknown|' || CAST(_row_id AS VARCHAR)), 1, 12)"
PARENT = f"""SELECT *, {KB_ID} AS record_id FROM ({SUPPLIER_KB})"""
LINES = " || ".join(f"chr(10) || '{c.replace('_', ' ').title()}: ' || " + ("coalesce(ev_supply_chain_role, 'Unknown')" if c == "ev_supply_chain_role" else c if c in ("company", "category", "updated_location") else "'Unknown'") for c in chunks.FIELDS if c != "employment")


def kb_text(spark: SparkSession, d: str) -> DataFrame:
    return supplier_kb(spark, d).drop("employment")


@query(f"SELECT record_id, CAST(_row_id AS INTEGER) AS source_row_id, 'Record ID: ' || record_id || chr(10) || 'Source Type: kb' || chr(10) || {LINES.replace(chr(10), '')} AS head FROM ({PARENT})".replace("'Unknown' || chr(10) || 'Product Service", "'Unknown' || chr(10) || 'Employment: Unknown' || chr(10) || 'Product Service"))
def parent_text(spark, d):
    body = F.regexp_replace("parent_chunk_text", "\nOriginal Row ID: [0-9]+$", "")
    return chunks.parents(kb_text(spark, d)).select("record_id", "source_row_id", body.alias("head"))


@query(f"SELECT record_id || '_' || t AS chunk_id, record_id AS parent_record_id, t AS chunk_type FROM ({PARENT}), (SELECT unnest(['identity','product_role','oem_relationship','location_employment','classification']) AS t)")
def child_chunks(spark, d):
    return chunks.children(chunks.parents(kb_text(spark, d))).select("chunk_id", "parent_record_id", "chunk_type")


def chunk_sql(kind: str, fields: tuple[str, ...]) -> str:
    """A kind of chunk of the suppliers: its fields as JSON and as lines."""
    said = {"company": "company", "category": "category", "updated_location": "updated_location", "ev_supply_chain_role": "coalesce(ev_supply_chain_role, 'Unknown')"}
    value = {f: said.get(f, "'Unknown'") for f in fields}
    pairs = " || ',' || ".join(f"'\"{f}\":\"' || {v} || '\"'" for f, v in value.items())
    return f"SELECT record_id || '_{kind}' AS chunk_id, '{{' || {pairs} || '}}' AS metadata, 'chunk_type: {kind}'" + "".join(f" || chr(10) || '{f}: ' || {v}" for f, v in value.items()) + f" AS body FROM ({PARENT})"


@query(" UNION ALL ".join(chunk_sql(k, f) for k, f in chunks.CHUNKS.items()))
def child_metadata_json(spark, d):
    return chunks.children(chunks.parents(kb_text(spark, d))).select("chunk_id", "metadata", F.col("embedding_text").alias("body"))


def broken(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = chunks.parents(kb_text(spark, d))
    return p.where("source_row_id % 10 <> 3"), chunks.children(p).where("not (source_row_id % 10 = 4 and chunk_type = 'identity')")


@query(f"SELECT record_id || '_' || t AS chunk_id FROM ({PARENT}), (SELECT unnest(['identity','product_role','oem_relationship','location_employment','classification']) AS t) WHERE _row_id % 10 = 3")
def integrity_orphans(spark, d):
    p, c = broken(spark, d)
    return c.join(p, c["parent_record_id"] == p["record_id"], "left_anti").select("chunk_id")


@query("SELECT 'orphan' AS problem, 5 * count(*) FILTER (s_suppkey % 10 = 3) AS n FROM supplier UNION ALL SELECT 'duplicate', 0 UNION ALL SELECT 'uneven', count(*) FILTER (s_suppkey % 10 = 4) FROM supplier UNION ALL SELECT 'surplus', 5 * count(*) FILTER (s_suppkey % 10 = 3) - count(*) FILTER (s_suppkey % 10 = 4) FROM supplier")
def integrity_counts(spark, d):
    return chunks.integrity(*broken(spark, d))


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN 1.0 ELSE CAST(s_acctbal AS DOUBLE) END AS s_acctbal FROM supplier WHERE s_suppkey % 3 > 0 OR s_suppkey % 4 = 0")
def upsert_parents(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))
    path = scratch(spark, "suppliers")
    upsert.upsert(s.where("s_suppkey % 3 > 0"), path, ["s_suppkey"])
    upsert.upsert(s.where("s_suppkey % 4 = 0").withColumn("s_acctbal", F.lit(1.0)), path, ["s_suppkey"])
    return upsert.read(spark, path)


@query("""WITH b AS (SELECT page_id, url, 0 AS batch FROM pages WHERE page_id % 3 > 0 UNION ALL SELECT page_id, 'seen again: ' || url, 1 FROM pages WHERE page_id % 4 = 0 UNION ALL SELECT page_id, 'seen twice: ' || url, 2 FROM pages WHERE page_id % 8 = 0),
r AS (SELECT page_id, max(batch) AS batch FROM b GROUP BY page_id) SELECT page_id, url, batch FROM r JOIN b USING (page_id, batch)""")
def upsert_pages(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.lit(0).alias("batch"))
    path = scratch(spark, "pages")
    upsert.upsert(p.where("page_id % 3 > 0"), path, ["page_id"])
    again = [p.where(f"page_id % {by} = 0").select("page_id", F.concat(F.lit(said), "url").alias("url"), F.lit(n).alias("batch")) for n, by, said in ((1, 4, "seen again: "), (2, 8, "seen twice: "))]
    upsert.upsert(again[0].unionByName(again[1]), path, ["page_id"], order="batch")
    return upsert.read(spark, path)


@query("SELECT p_partkey, 'p_name: ' || p_name || ' | p_type: ' || p_type || ' | p_size: ' || CAST(p_size AS VARCHAR) AS body FROM part")
def row_text(spark, d):
    return table(spark, d, "part").select("p_partkey", chunks.row_text(table(spark, d, "part"), ["p_name", "p_type", "p_size"]).alias("body"))


@query("SELECT p_partkey, lower('p_name ' || p_name || ' p_brand ' || p_brand) AS body FROM part")
def bm25_text(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.lower(chunks.row_text(p, ["p_name", "p_brand"], " ", " ")).alias("body"))


@query("SELECT p_partkey, CASE WHEN starts_with(lower(p_name), 'small ') THEN p_name ELSE 'small ' || p_name END AS once FROM part")
def prefix_once(spark, d):
    return table(spark, d, "part").select("p_partkey", text.prefixed(F.col("p_name"), "Small ").alias("once")).withColumn("once", F.lower("once"))


@query("SELECT p_partkey, 'P Name: ' || p_name || ' | P Type: ' || p_type AS evidence FROM part ORDER BY p_partkey LIMIT 50")
def evidence_format(spark, d):
    return chunks.evidence(table(spark, d, "part").select("p_partkey", "p_name", "p_type"), "p_partkey")


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS length, unnest(ws) AS term FROM t), tf AS (SELECT doc_id, length, term, count(*) AS tf FROM p GROUP BY ALL), c AS (SELECT count(*) AS n, avg(len(ws)) AS mean_length FROM t),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), i AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, c), f AS (SELECT avg(idf) * 0.25 AS floor FROM i),
q AS (SELECT term, count(*) AS times FROM (SELECT unnest(['the', 'shther', 'thonor', 'the', 'de', 'ertion']) AS term) GROUP BY term)
SELECT doc_id, round(sum(times * CASE WHEN idf < 0 THEN floor ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 6) AS score FROM tf JOIN q USING (term) JOIN i USING (term), c, f GROUP BY doc_id HAVING score > 0 ORDER BY score DESC, doc_id LIMIT 50""")
def bm25_search(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), "doc_id", F.col("text"), "The shther thonor the de ertion").withColumn("score", r6("score"))


@query(r"""SELECT doc_id, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9-]*')), ['edly', 'ertion', 'of', 'shther', 'stand'])) AS INTEGER) AS score FROM documents
WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50""")
def column_overlap_search(spark, d):
    return retrieval.overlap(table(spark, d, "documents"), "Edly of ertion, stand shther", ["text"], "doc_id")


def first_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").orderBy("vec_id").first()["embedding"]


VECTORS = "WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS score FROM embeddings, q) "


@query(VECTORS + "SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= 0 ORDER BY s.score DESC, vec_id LIMIT 15")
def vector_topk(spark, d):
    return retrieval.vector_search(table(spark, d, "embeddings"), first_vector(spark, d), "vec_id").select("vec_id", r6("score").alias("score"))


@query(VECTORS + "SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= 0.35 ORDER BY s.score DESC, vec_id LIMIT 200")
def vector_threshold(spark, d):
    return retrieval.vector_search(table(spark, d, "embeddings"), first_vector(spark, d), "vec_id", k=200, threshold=0.35).select("vec_id", r6("score").alias("score"))


@query(VECTORS + ", n AS (SELECT * FROM s WHERE score >= 0 ORDER BY score DESC, vec_id LIMIT 60) SELECT label, round(max(score), 6) AS score FROM n GROUP BY label ORDER BY max(n.score) DESC, label LIMIT 15")
def chunk_vector_search(spark, d):
    return retrieval.chunk_search(table(spark, d, "embeddings"), first_vector(spark, d), "label", "vec_id").select("label", r6("score").alias("score"))


def part_lists(spark: SparkSession, d: str) -> list[DataFrame]:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice", "p_size")
    made = [p.withColumn("score", F.col("p_retailprice")), p.withColumn("score", F.col("p_size").cast("double")), p.where("p_size < 9").withColumn("score", -F.col("p_retailprice"))]
    return [retrieval.ranks(m.orderBy(F.col("score").desc(), "id").limit(n), "id", i) for i, (m, n) in enumerate(zip(made, (40, 60, 30), strict=True))]


LISTS = """WITH l AS (SELECT 0 AS list, p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS r FROM part QUALIFY r < 40
UNION ALL SELECT 1, p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS r FROM part QUALIFY r < 60 UNION ALL SELECT 2, p_partkey, row_number() OVER (ORDER BY -p_retailprice DESC, p_partkey) - 1 AS r FROM part WHERE p_size < 9 QUALIFY r < 30) """


@query(LISTS + "SELECT id, round(sum(1.0 / (60 + r + 1)), 6) AS score FROM l GROUP BY id ORDER BY round(sum(1.0 / (60 + r + 1)), 12) DESC, min(list * 1000000 + r), id LIMIT 100")
def rrf_fuse(spark, d):
    return retrieval.rrf(part_lists(spark, d), "id", k=100).select("id", r6("score").alias("score"))


@query(LISTS + """, a AS (SELECT id, row_number() OVER (ORDER BY round(s, 12) DESC, f, id) - 1 AS r FROM (SELECT id, sum(1.0 / (61 + r)) AS s, min(list * 1000000 + r) AS f FROM l WHERE list < 2 GROUP BY id)),
b AS (SELECT 0 AS list, id, r FROM a WHERE r < 50 UNION ALL SELECT 1, id, r FROM l WHERE list = 2)
SELECT id, round(sum(1.0 / (61 + r)), 6) AS score FROM b GROUP BY id ORDER BY round(sum(1.0 / (61 + r)), 12) DESC, min(list * 1000000 + r), id LIMIT 60""")
def rrf_two_level(spark, d):
    from pyspark.sql import Window

    lists = part_lists(spark, d)
    inner = retrieval.rrf(lists[:2], "id", k=50)
    order = Window.orderBy(F.round("score", 12).desc(), "first_list", "first_rank", "id")
    first = inner.select(F.lit(0).alias("list"), "id", (F.row_number().over(order) - 1).alias("rank"))
    return retrieval.rrf([first, lists[2].withColumn("list", F.lit(1))], "id", k=60).select("id", r6("score").alias("score"))


@query(LISTS + "SELECT id, list, r AS rank FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY list, r) = 1")
def hybrid_union_dedupe(spark, d):
    return retrieval.keep_first(part_lists(spark, d), "id").select("id", "list", "rank")


@query(r"""WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_name || ' of type ' || p_type), '[a-z][a-z0-9-]*') AS w FROM part)
SELECT p_partkey, gram FROM (SELECT p_partkey, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))) AS gram FROM t) WHERE length(gram) >= 4""")
def ngrams(spark, d):
    t = text.words("[a-z][a-z0-9-]*", F.lower(F.concat("p_name", F.lit(" of type "), "p_type")))
    return table(spark, d, "part").select("p_partkey", F.explode(text.ngrams(t, 3, 4)).alias("gram"))


@query("""WITH o AS (SELECT p_partkey AS row_, 'p_type' AS c, lower(p_type) AS term, 2.0 AS weight FROM part UNION ALL SELECT p_partkey, 'p_name', w, 0.5 FROM (SELECT p_partkey, unnest(list_concat(regexp_extract_all(p_name, '[a-z][a-z0-9-]*'), [p_name])) AS w FROM part) WHERE length(w) >= 4)
SELECT term, count(*) AS frequency, max(weight) AS weight, array_to_string(list_sort(list_distinct(list(c))), ',') AS "columns", array_to_string(list_sort(list_distinct(list(row_)))[1:5], ',') AS "rows"
FROM o GROUP BY term HAVING count(*) >= 2 ORDER BY max(weight) * count(*) DESC, term LIMIT 30""")
def term_discovery(spark, d):
    found = terms.discover(table(spark, d, "part"), {"p_type": "exact", "p_name": "partial"}, "p_partkey", weights={"p_type": 2.0})
    return found.select("term", "frequency", "weight", F.array_join("columns", ",").alias("columns"), F.array_join(F.col("rows").cast("array<string>"), ",").alias("rows"))


#: Questions of every kind, as a table.
ASKED = (
    "Which roles are single point of failure?", "Show all Tier 1/2 suppliers in Georgia", "Which county has the highest total employment?", "How many Battery Cell companies are there?", "Thermal Management suppliers",
    "total jobs by city", "Which role has the fewest employees?", "largest companies", "number of tiers", "List every sole supplier", "tier 1 and tier 3 parts", "Show battery/cell or Tier 2, 4 companies", "the smallest plant", "companies linked to acme",
)
QUESTIONS = "(SELECT conv_id * 1000 + turn AS id, [" + ", ".join("'" + q + "'" for q in ASKED) + f"][(conv_id + turn) % {len(ASKED)} + 1] || ' ' || text AS q FROM conversations)"


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Each turn of ``conversations`` behind one of the questions."""
    asked = F.element_at(F.array(*map(F.lit, ASKED)), ((F.col("conv_id") + F.col("turn")) % len(ASKED) + 1).cast("int"))
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(asked, F.lit(" "), "text").alias("q"))


@query(rf"""SELECT id, list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(lower(q), '\btier\s*([0-9]+)\s*(?:/|and|or|&|,)\s*(?:tier\s*)?([0-9]+)\b', 1), regexp_extract_all(lower(q), '\btier\s*([0-9]+)\s*(?:/|and|or|&|,)\s*(?:tier\s*)?([0-9]+)\b', 2)), regexp_extract_all(lower(q), '\btier\s*([0-9]+)\b', 1)))).array_to_string(',') AS tiers,
array_to_string(list_distinct(regexp_extract_all(lower(q), '(?:[a-z]+\s+)?[0-9]+/[0-9]+|[a-z]+/[a-z]+')), ',') AS slashed, trim(regexp_replace(lower(q), '[ \t\n/]+', ' ', 'g')) AS plain FROM {QUESTIONS}""")
def requested_tiers(spark, d):
    q = F.col("q")
    return questions(spark, d).select("id", F.array_join(text.tiers(q), ",").alias("tiers"), F.array_join(text.slash_phrases(q), ",").alias("slashed"), text.slash_flat(q).alias("plain"))


@query(rf"""WITH t AS (SELECT id, unnest(regexp_extract_all(lower(q), '[a-z0-9]+(?:/[a-z0-9]+)?')) AS t FROM {QUESTIONS})
SELECT DISTINCT id, t AS token FROM t UNION SELECT id, CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN t[:-4] || 'y' WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 3 THEN t[:-2] ELSE t END FROM t""")
def tokens_singular(spark, d):
    return questions(spark, d).select("id", F.explode(text.token_set(F.col("q"))).alias("token"))


@query(f"SELECT id, {operations.operation_sql('q')} AS operation, {operations.direction_sql('q')} AS direction, {operations.exhaustive_sql('q')} AS exhaustive FROM {QUESTIONS}")
def detect_operation_batch(spark, d):
    q = F.col("q")
    return questions(spark, d).select("id", operations.operation(q).alias("operation"), operations.direction(q).alias("direction"), operations.exhaustive(q).alias("exhaustive"))


@query(f"SELECT id, {operations.intent_sql('q')} AS intent FROM {QUESTIONS}")
def detect_intent_batch(spark, d):
    return questions(spark, d).select("id", operations.intent(F.col("q")).alias("intent"))


@query(f"SELECT conv_id, turn, {operations.operation_sql('text')} AS operation FROM conversations WHERE role = 'user'")
def detect_operation_conversations(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", operations.operation(F.col("text")).alias("operation"))


@query("""WITH v AS (SELECT DISTINCT word AS value FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part UNION SELECT substr(text, 5, 6) FROM conversations) WHERE length(word) >= 3) SELECT DISTINCT conv_id * 1000 + turn AS id, value FROM conversations, v WHERE contains(lower(text), lower(value))""")
def values_in_conversations(spark, d):
    turns = table(spark, d, "conversations")
    values = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("value")).unionByName(turns.select(F.substring("text", 5, 6).alias("value")))
    return operations.value_matches(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("q")), values)


@query("""WITH a AS (SELECT unnest(['show red gear and small bolt parts', 'old anvil', 'nothing here', 'blue ring or gizmo']) AS q, unnest([0, 1, 2, 3]) AS id), v AS (SELECT DISTINCT p_name AS value FROM part)
SELECT id, value FROM a, v WHERE contains(q, value)""")
def value_scan_join(spark, d):
    asked = spark.createDataFrame([(0, "show red gear and small bolt parts"), (1, "old anvil"), (2, "nothing here"), (3, "blue ring or gizmo")], "id int, q string")
    return operations.value_matches(asked, table(spark, d, "part").select(F.col("p_name").alias("value")))


PHRASES = "(SELECT conv_id, turn, CASE (conv_id + turn) % 7 WHEN 0 THEN 'tier 1/2' WHEN 1 THEN 'highest' WHEN 2 THEN 'battery cell' WHEN 3 THEN 'fulton county' WHEN 4 THEN 'acme' ELSE split_part(text, ' ', 1) END AS phrase FROM conversations)"


@query(f"SELECT conv_id, turn, {operations.phrase_kind_sql('phrase')} AS kind FROM {PHRASES}")
def phrase_type_compat(spark, d):
    n = (F.col("conv_id") + F.col("turn")) % 7
    phrase = F.when(n == 0, "tier 1/2").when(n == 1, "highest").when(n == 2, "battery cell").when(n == 3, "fulton county").when(n == 4, "acme").otherwise(F.split_part("text", F.lit(" "), F.lit(1)))
    return table(spark, d, "conversations").select("conv_id", "turn", operations.phrase_kind(phrase).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 AND p_size % 2 = 0 THEN 'Not Supported' WHEN p_size % 5 >= 3 AND p_size % 2 = 1 AND p_size % 3 = 0 THEN 'Fully Supported' WHEN p_size % 5 >= 2 AND p_size % 2 = 1 THEN 'Mostly Supported' WHEN p_size % 5 >= 1 AND p_size % 2 = 1 THEN 'Partially Supported' ELSE 'Weakly Supported' END AS support FROM part")
def support_level(spark, d):
    n = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", operations.support(n % 5, n % 2 == 1, n % 3 != 0).alias("support"))


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9_]+'), lambda w: length(w) >= 3))"


@query(f"""WITH q AS (SELECT item_id, unnest({WORDS.format(c='text')}) AS w FROM benchmark), g AS (SELECT doc_id, unnest({WORDS.format(c='text')}) AS w FROM documents),
n AS (SELECT item_id, doc_id, count(*) AS shared FROM q JOIN g USING (w) GROUP BY ALL HAVING count(*) >= 5) SELECT item_id, doc_id, shared FROM n QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) = 1""")
def qa_best_match(spark, d):
    return operations.best_answers(table(spark, d, "benchmark").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text"), "item_id", "doc_id")


def best_pairs(spark: SparkSession, d: str) -> DataFrame:
    """``item_id, doc_id`` and both texts of each benchmark item and the document that shares most words with it."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("asked"))
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("given"))
    # Documents meet the few found ids first, so that their texts are not shuffled.
    return docs.join(qa_best_match(spark, d), "doc_id").join(items, "item_id")


BEST = f"(SELECT item_id, doc_id, b.text AS asked, g.text AS given FROM ({SQL['qa_best_match']}) JOIN benchmark b USING (item_id) JOIN documents g USING (doc_id))"
PUNCT = r"""^[.,;?!\"''()\[\]{}:]+|[.,;?!\"''()\[\]{}:]+$"""
STOPS = ", ".join(f"'{w}'" for w in text.ANSWER_STOP_WORDS)


@query(rf"""WITH w AS (SELECT item_id, doc_id, given AS e, list_filter(list_transform(regexp_split_to_array(asked, '[ \t\n\r]+'), lambda w: lower(regexp_replace(w, '{PUNCT}', '', 'g'))), lambda w: length(w) > 4 AND NOT list_contains([{STOPS}], w) AND NOT regexp_matches(w, '^[0-9]+$')) AS ws FROM {BEST}),
r AS (SELECT item_id, doc_id, len(ws) AS n, len(list_filter(ws, lambda w: NOT contains(lower(e), w))) / greatest(len(ws), 1) AS ratio FROM w)
SELECT item_id, doc_id, CASE WHEN n = 0 THEN 'Low' WHEN ratio < 0.2 THEN 'Low' WHEN ratio < 0.45 THEN 'Medium' ELSE 'High' END AS risk FROM r""")
def risk_label(spark, d):
    return best_pairs(spark, d).select("item_id", "doc_id", text.risk(F.col("asked"), F.col("given")).alias("risk"))


@query(f"SELECT item_id, doc_id, round(CASE WHEN len({WORDS.format(c='asked')}) > 0 AND len({WORDS.format(c='given')}) > 0 THEN 2.0 * len(list_intersect({WORDS.format(c='asked')}, {WORDS.format(c='given')})) / (len({WORDS.format(c='asked')}) + len({WORDS.format(c='given')})) ELSE 0.0 END, 6) AS f1 FROM {BEST}")
def token_f1(spark, d):
    return best_pairs(spark, d).select("item_id", "doc_id", r6(text.words_f1(*[text.long_answer_words(F.col(c)) for c in ("asked", "given")])).alias("f1"))


@query(r"SELECT doc_id, trim(lower(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS norm FROM documents")
def norm_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.flat(F.col("text")).alias("norm"))


@query("SELECT p_partkey, trim(p_name || ' ' || p_brand) AS answer FROM part")
def clean_answer(spark, d):
    said = F.concat(F.lit("<think>" + "so\n" + "</think>\n```json\n"), "p_name", F.lit(" "), "p_brand", F.lit("\n```"))
    return table(spark, d, "part").select("p_partkey", text.clean_answer(said).alias("answer"))


@query(rf"""WITH t AS (SELECT id, regexp_extract_all(q, '[A-Za-z0-9]+(?:/[A-Za-z0-9]+)*') AS w FROM {QUESTIONS})
SELECT id, gram FROM (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' ')))) AS gram FROM t) WHERE length(gram) >= 3""")
def question_ngrams(spark, d):
    return questions(spark, d).select("id", F.explode(text.question_ngrams(F.col("q"), 2)).alias("gram"))


@query(f"WITH f AS ({SQL['token_f1']}) SELECT count(*) AS n, round(avg(f1), 6) AS mean_f1, count(*) FILTER (f1 >= 0.8) AS good, count(*) FILTER (f1 >= 0.5) AS fair, count(*) FILTER (f1 = 0) AS none FROM f")
def eval_summary(spark, d):
    return operations.summary(token_f1(spark, d)).withColumn("mean_f1", r6("mean_f1"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, true AS has_k, false AS has_z FROM events")
def json_extract_validate(spark, d):
    said = F.concat(F.lit("Sure: "), "props", F.lit(" done"))
    obj = text.json_object(said)
    return table(spark, d, "events").select("event_id", F.get_json_object(obj, "$.k").cast("int").alias("k"), text.holds_keys(said, ["k"]).alias("has_k"), text.holds_keys(said, ["k", "z"]).alias("has_z"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.none') AS absent, true AS has_k, false AS has_z, json_valid(props) AS fine FROM events")
def event_paths(spark, d):
    e = variants.parsed(table(spark, d, "events"), v="props")
    return e.select("event_id", variants.at("v", "$.k", "int").alias("k"), variants.at("v", "$.none").alias("absent"), variants.holds("v", ["k"]).alias("has_k"), variants.holds("v", ["k", "z"]).alias("has_z"), F.col("v").isNotNull().alias("fine"))


@query(f"SELECT CAST(_row_id AS INTEGER) AS source_row_id, company, ev_supply_chain_role AS role, CAST(_row_id AS BIGINT) AS row, 'Cat' AS kind FROM ({SUPPLIER_KB})")
def parent_paths(spark, d):
    p = variants.parsed(chunks.parents(kb_text(spark, d)).select("source_row_id", "raw_row"), raw="raw_row")
    path = scratch(spark, "variants")
    p.drop("raw_row").write.parquet(path)
    at = lambda name, kind="string": variants.at("raw", f"$.{name}", kind)
    return spark.read.parquet(path).select("source_row_id", at("company").alias("company"), at("ev_supply_chain_role").alias("role"), at("_row_id", "long").alias("row"), F.left(at("category"), F.lit(3)).alias("kind"))


@query(f"""WITH k AS ({SUPPLIER_KB}) SELECT _row_id, TRY_CAST(nullif(regexp_extract(replace(company, ',', ''), '-?[0-9]+([.][0-9]+)?', 0), '') AS DOUBLE) AS number, trim(split_part(updated_location, ',', 2)) AS county,
'KB_ROW_' || printf('%04d', _row_id) || '_' || substr(md5(company || '||' || CAST(_row_id AS VARCHAR)), 1, 12) AS id FROM k""")
def functions_in_sql(spark, d):
    sql.register(spark)
    supplier_kb(spark, d).createOrReplaceTempView("suppliers_kb")
    return spark.sql("SELECT _row_id, clean_numeric(company) AS number, extract_county(updated_location) AS county, record_id(_row_id, array(company, CAST(NULL AS STRING))) AS id FROM suppliers_kb")


@query(r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z][a-z0-9-]*') AS w FROM conversations), g AS (SELECT conv_id, turn, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' ')))) AS gram FROM t)
SELECT conv_id, turn, count(*) AS grams, count(DISTINCT gram) AS different FROM g GROUP BY conv_id, turn""")
def ngrams_in_sql(spark, d):
    sql.register(spark)
    # Dealt by the group's columns before the texts become n-grams: the texts are shuffled, not all their n-grams.
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    turns.repartition("conv_id", "turn").createOrReplaceTempView("turns_said")
    return spark.sql("SELECT conv_id, turn, count(*) AS grams, count(DISTINCT gram) AS different FROM (SELECT conv_id, turn, ngram_list(text, 2) AS said FROM turns_said) LATERAL VIEW explode(said) AS gram GROUP BY conv_id, turn")


@query("SELECT count(DISTINCT p_partkey) AS unique_rows, round(avg(p_retailprice), 6) AS mean_score, bool_or(contains(lower(p_name), 'gear')) AS hit_gear, bool_or(contains(lower(p_name), 'nowhere')) AS hit_nowhere FROM part WHERE p_size < 20")
def retrieval_quality(spark, d):
    return operations.retrieval_quality(table(spark, d, "part").where("p_size < 20"), "p_partkey", "p_retailprice", {"gear": "p_name", "nowhere": "p_name"}).withColumn("mean_score", r6("mean_score"))


@query()
def embed_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", retrieval.embed("text").alias("embedding"))


@query()
def pipeline_answer(spark, d):
    from .plans import engine

    kb = supplier_kb(spark, d)
    asked = ["Which county has the highest total employment?", "How many companies are there in Cat 1?", "Which roles are single point of failure?", "Show all Cat 2 companies"]
    return engine.Engine(kb).answers(asked)


#: A question about suppliers before the text of each turn. A text may hold a word for groups ("tier"), which makes a rank a sum; without a column for it, that sum is a list.
ABOUT_SUPPLIERS = f"""(SELECT conv_id, turn, {operations.has_sql('text', operations.GROUP)} AS grouped, (conv_id + turn) % 4 AS kind, 'Cat ' || CAST(turn % 3 AS VARCHAR) AS cat, n_name || ' County' AS place FROM conversations JOIN nation ON n_nationkey = conv_id % 25)"""


@query(f"""WITH k AS ({SUPPLIER_KB}), s AS (SELECT *, concat_ws(' | ', 'Company: ' || company, 'Category: ' || category, 'Updated Location: ' || updated_location, 'Ev Supply Chain Role: ' || ev_supply_chain_role, 'Employment: ' || CAST(round(employment, 6) AS VARCHAR)) AS line FROM k),
a AS {ABOUT_SUPPLIERS}, places AS (SELECT trim(split_part(updated_location, ',', 2)) AS place, count(*) AS n FROM k GROUP BY 1), pairs AS (SELECT category AS cat, trim(split_part(updated_location, ',', 2)) AS place, count(*) AS n FROM k GROUP BY 1, 2), cats AS (SELECT category AS cat, count(*) AS n FROM k GROUP BY 1),
counted AS (SELECT conv_id, turn, CASE WHEN places.n IS NULL THEN coalesce(cats.n, (SELECT count(*) FROM k)) ELSE coalesce(pairs.n, (SELECT count(*) FROM k)) END AS n, places.n IS NOT NULL AND pairs.n IS NULL AS fell_back FROM a LEFT JOIN places USING (place) LEFT JOIN cats USING (cat) LEFT JOIN pairs USING (cat, place) WHERE kind = 0),
listed AS (SELECT category AS cat, array_to_string(list_slice(list(line ORDER BY _row_id), 1, 5), '; ') AS lines, least(count(*), 50) AS n FROM s GROUP BY 1), top AS (SELECT category AS cat, arg_min(line, (-employment, _row_id)) AS lines FROM s GROUP BY 1),
summed AS (SELECT category AS cat, trim(split_part(updated_location, ',', 2)) AS place, sum(employment) AS total FROM k GROUP BY 1, 2), sums AS (SELECT cat, array_to_string(list_slice(list('Updated Location: ' || place || ' | Total Employment: ' || CAST(round(total, 6) AS VARCHAR) ORDER BY total DESC, place), 1, 5), '; ') AS lines, least(count(*), 50) AS n FROM summed GROUP BY 1)
SELECT conv_id, turn, 'count' AS operation, 'There are ' || CAST(n AS VARCHAR) || '.' AS answer, CAST(1 AS BIGINT) AS evidence_count, fell_back FROM counted
UNION ALL SELECT conv_id, turn, 'rank', lines, CAST(1 AS BIGINT), false FROM a JOIN top USING (cat) WHERE kind = 1 AND NOT grouped UNION ALL SELECT conv_id, turn, 'aggregate_sum', lines, CAST(n AS BIGINT), false FROM a JOIN listed USING (cat) WHERE kind = 1 AND grouped UNION ALL SELECT conv_id, turn, 'aggregate_sum', lines, CAST(n AS BIGINT), false FROM a JOIN sums USING (cat) WHERE kind = 2
UNION ALL SELECT conv_id, turn, 'exhaustive_list', lines, CAST(n AS BIGINT), false FROM a JOIN listed USING (cat) WHERE kind = 3""")
def answers_as_set(spark, d):
    from .plans import engine

    n, turns = table(spark, d, "nation"), table(spark, d, "conversations")
    cat, place, kind = F.concat(F.lit("Cat "), F.col("turn") % 3), F.concat("n_name", F.lit(" County")), (F.col("conv_id") + F.col("turn")) % 4
    q = F.when(kind == 0, F.concat(F.lit("How many companies are there in "), cat, F.lit(" in "), place, F.lit("? "), "text")).when(kind == 1, F.concat(F.lit("highest employment in "), cat, F.lit(" "), "text"))
    q = q.when(kind == 2, F.concat(F.lit("total employment by county in "), cat, F.lit(" "), "text")).otherwise(F.concat(F.lit("Show all companies in "), cat, F.lit(" "), "text"))
    asked = turns.join(n, n["n_nationkey"] == F.col("conv_id") % 25).select("conv_id", "turn", q.alias("question"))
    said = engine.Engine(supplier_kb(spark, d)).answered(asked.select("question").distinct())
    return asked.join(said, "question").select("conv_id", "turn", "operation", "answer", "evidence_count", "fell_back")
