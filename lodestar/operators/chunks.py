"""Parent records and their five child chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of each kind of chunk, and those of a parent record with their labels' order.
CHUNKS = {
    "identity": ("company", "category", "industry_group", "updated_location"),
    "product_role": ("company", "ev_supply_chain_role", "product_service", "ev_battery_relevant"),
    "oem_relationship": ("company", "primary_oems", "supplier_or_affiliation_type", "category"),
    "location_employment": ("company", "updated_location", "address", "latitude", "longitude", "employment"),
    "classification": ("company", "primary_facility_type", "classification_method", "category", "ev_battery_relevant"),
}
FIELDS = (
    "company", "category", "industry_group", "updated_location", "address", "latitude", "longitude", "primary_facility_type", "ev_supply_chain_role", "primary_oems",
    "supplier_or_affiliation_type", "employment", "product_service", "ev_battery_relevant", "classification_method",
)
#: What a record's id is made of, besides the row.
ID_FIELDS = ("company", "updated_location", "product_service", "category", "primary_facility_type")


def shown(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("Unknown")) if name in df.columns else F.lit("Unknown")


def record_id(row_id: Column, parts: list[Column]) -> Column:
    """``KB_ROW_``, the row with four digits or more, and twelve of the hash of the parts; NULL counts as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], row_id.cast("string"))
    return F.concat(F.lit("KB_ROW_"), F.format_string("%04d", row_id.cast("long")), F.lit("_"), F.substring(F.md5(joined.cast("binary")), 1, 12))


def parents(df: DataFrame, source_type: str = "kb") -> DataFrame:
    """A record for each row: id, fields (``Unknown`` where the table has none), the row as JSON, and its text."""
    key = record_id(F.col("_row_id"), [F.col(c) if c in df.columns else F.lit("Unknown") for c in ID_FIELDS])
    out = df.select(
        key.alias("record_id"), F.col("_row_id").cast("int").alias("source_row_id"), F.lit(source_type).alias("source_type"), *[shown(df, c).alias(c) for c in FIELDS],
        F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("raw_row"),
    )
    label = lambda c: c.replace("_", " ").title()
    lines = [F.concat(F.lit("Record ID: "), "record_id"), F.concat(F.lit("Source Type: "), "source_type"), F.lit("")]
    lines += [F.concat(F.lit(f"{label(c)}: "), c) for c in FIELDS] + [F.concat(F.lit("Original Row ID: "), F.col("source_row_id").cast("string"))]
    return out.withColumn("parent_chunk_text", F.concat_ws("\n", *lines))


def children(parents: DataFrame, chunks: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Five chunks for each parent, from the parent's own row: no join."""
    def chunk(kind: str, fields: tuple[str, ...]) -> Column:
        lines = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}: "), F.col(f))) for f in fields]
        return F.struct(
            F.concat("record_id", F.lit(f"_{kind}")).alias("chunk_id"), F.col("record_id").alias("parent_record_id"), F.lit(kind).alias("chunk_type"), "source_type", F.coalesce("source_row_id", F.lit(0)).alias("source_row_id"),
            F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("metadata"), F.concat_ws("\n", F.lit(f"chunk_type: {kind}"), *lines).alias("embedding_text"),
        )

    return parents.select(F.inline(F.array(*[chunk(k, f) for k, f in (chunks or CHUNKS).items()])))


def exported(parents: DataFrame, children: DataFrame) -> dict[str, DataFrame]:
    """What people read of the chunks, by the name of its sheet."""
    return {
        "parents": parents.select("record_id", "source_row_id", "parent_chunk_text"),
        "children": children.select("chunk_id", "parent_record_id", "chunk_type", "embedding_text"),
    }


def payload(children: DataFrame) -> DataFrame:
    """Chunks with their metadata as columns, NULL where a kind of chunk lacks the field."""
    fields = F.from_json("metadata", ", ".join(f"{c} string" for c in FIELDS))
    return children.withColumn("fields", fields).select("chunk_id", "parent_record_id", "chunk_type", "source_type", "source_row_id", "embedding_text", "fields.*")


def integrity(parents: DataFrame, children: DataFrame, each: int = len(CHUNKS)) -> DataFrame:
    """``problem, n``: orphans, ids used twice, parents with another number of chunks, and the surplus of chunks."""
    orphans = children.join(parents, children["parent_record_id"] == parents["record_id"], "left_anti").agg(F.count(F.lit(1)).alias("n"))
    twice = children.groupBy("chunk_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
    counts = children.groupBy("parent_record_id").agg(F.count(F.lit(1)).alias("c"))
    uneven = parents.join(counts, parents["record_id"] == counts["parent_record_id"], "left").where(F.coalesce("c", F.lit(0)) != each).agg(F.count(F.lit(1)).alias("n"))
    total = children.agg(F.count(F.lit(1)).alias("n")).crossJoin(parents.agg(F.count(F.lit(1)).alias("p"))).select((F.col("n") - each * F.col("p")).alias("n"))
    named = [df.select(F.lit(name).alias("problem"), F.col("n").cast("long")) for name, df in (("orphan", orphans), ("duplicate", twice), ("uneven", uneven), ("surplus", total))]
    return named[0].unionAll(named[1]).unionAll(named[2]).unionAll(named[3])


def row_text(df: DataFrame, columns: list[str], between: str = " | ", mark: str = ": ") -> Column:
    valid = lambda c: F.when(~F.lower(F.trim(F.col(c).cast("string"))).isin("", "nan"), F.concat(F.lit(f"{c}{mark}"), F.trim(F.col(c).cast("string"))))
    return F.concat_ws(between, *[valid(c) for c in columns])


def evidence(df: DataFrame, rank: str, most: int = 50, skipped: tuple[str, ...] = ("_row_id", "latitude", "longitude", "address")) -> DataFrame:
    """The first rows by ``rank`` as ``Label: value`` lines."""
    names = [c for c in df.columns if c not in skipped and c != rank]
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(c.replace("_", " ").title() + ": "), F.col(c).cast("string"))) for c in names]
    return df.orderBy(rank).limit(most).select(rank, F.concat_ws(" | ", *parts).alias("evidence"))
