"""Sources and sinks: typed readers of raw files, idempotent upserts, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALL_SCHEMA = "caller string, caller_number string, callee string, callee_number string, duration string, timestamp string, cell_tower string, _corrupt string"
TRANSFER_SCHEMA = "sender string, receiver string, from_account string, to_account string, amount string, date string, _corrupt string"


# Source types, and columns whose values are no entities.
CALL_SOURCES = ["cdr", "call", "calls"]
TRANSFER_SOURCES = ["financial", "transaction", "bank"]
RECORD_COLUMNS = ["amount", "amount_inr", "date", "time", "timestamp", "duration", "reference", "id", "balance"]


def read_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Call or transfer rows of CSV files with headers; a bad row fills ``_corrupt`` and never fails the file. Adds the file and the time of reading."""
    schema = {"calls": CALL_SCHEMA, "transfers": TRANSFER_SCHEMA}[kind]
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    return df.withColumn("source_file", F.col("_metadata.file_path")).withColumn("read_at", F.current_timestamp())


def call_entities(rows: DataFrame) -> DataFrame:
    """Numbers of call rows with 7 digits or more, one per row and number: all columns and ``number``."""
    number = lambda *c: F.regexp_replace(F.coalesce(*c, F.lit("")), "[^0-9]", "")
    both = F.array_distinct(F.array(number("caller", "caller_number"), number("callee", "callee_number")))
    return rows.withColumn("number", F.explode(both)).where(F.length("number") >= 7)


def transfer_parties(rows: DataFrame) -> DataFrame:
    """Party names of transfer rows: all columns and ``party``, blank ones left out."""
    parties = F.array_distinct(F.filter(F.array("sender", "receiver", "from_account", "to_account"), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))
    return rows.withColumn("party", F.explode(parties))


def generic_phones(rows: DataFrame, columns: list[str]) -> DataFrame:
    """First phone of each given column: (column, number)."""
    from caseweave.operators.text import PHONE

    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.regexp_extract(F.col(c).cast("string"), f"({PHONE})", 1).alias("hit")) for c in columns])
    out = rows.select(F.explode(cells).alias("x")).where("x.hit <> ''")
    return out.select("x.column", F.right(F.regexp_replace("x.hit", "[^0-9]", ""), F.lit(10)).alias("number"))


def with_digest(docs: DataFrame, content: str = "text") -> DataFrame:
    return docs.withColumn("file_hash", F.sha2(F.col(content), 256))


def new_files(docs: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per digest (the smallest doc_id) that ``existing`` doesn't have."""
    first = docs.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"))
    return first.join(existing.select("file_hash").distinct(), "file_hash", "left_anti")


def upsert_entities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entities by (case_id, entity_type, name): the latest confidence wins."""
    both = existing.withColumn("gen", F.lit(0)).unionByName(incoming.withColumn("gen", F.lit(1)))
    return both.groupBy("case_id", "entity_type", "name").agg(F.max_by("confidence", F.struct("gen", "confidence")).alias("confidence"), F.count("*").alias("records"))


def upsert_edges(edges: DataFrame) -> DataFrame:
    """Edges by (case_id, unordered pair, type): the largest weight stays."""
    key = edges.select("case_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "rel_type", "weight")
    return key.groupBy("case_id", "a", "b", "rel_type").agg(F.max("weight").alias("weight"), F.count("*").alias("records"))


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def delta(rows: DataFrame, seen: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose hash over ``columns`` was not seen; ``seen`` has row_hash."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    return rows.withColumn("row_hash", h).join(seen.select("row_hash"), "row_hash", "left_anti")


def job_metrics(rows: DataFrame) -> DataFrame:
    """Rows and bad rows per source file."""
    return rows.groupBy("source_file").agg(F.count("*").alias("records"), F.count_if(F.col("_corrupt").isNotNull()).alias("errors"))


def structured_entities(rows: DataFrame) -> DataFrame:
    """(row_id, entity_type, name) by source type: numbers of 7 digits or more of call rows, parties of transfer rows, the first phone of each cell of other rows but for those of amounts, times and the like.

    Rows: (row_id, source_type, cells map from column to value). Null or blank cells give nothing.
    """
    from caseweave.operators.text import PHONE

    kind, cell = F.lower("source_type"), lambda *c: F.coalesce(*[F.try_element_at("cells", F.lit(x)) for x in c], F.lit(""))
    calls, transfers = kind.isin(CALL_SOURCES), kind.isin(TRANSFER_SOURCES)
    found = lambda kind, names: F.transform(F.array_distinct(F.filter(names, lambda n: n != "")), lambda n: F.struct(F.lit(kind).alias("entity_type"), n.alias("name")))
    numbers = F.array(*[F.regexp_replace(cell(*c), "[^0-9]", "") for c in (("caller", "caller_number"), ("callee", "callee_number"))])
    parties = F.array(*[F.trim(cell(c)) for c in ("sender", "receiver", "from_account", "to_account")])
    other = F.transform(F.map_entries(F.map_filter("cells", lambda k, v: ~F.lower(k).isin(RECORD_COLUMNS))), lambda e: F.right(F.regexp_replace(F.regexp_extract(F.coalesce(e["value"], F.lit("")), f"({PHONE})", 1), "[^0-9]", ""), F.lit(10)))
    items = F.when(calls, found("Phone", F.filter(numbers, lambda n: F.length(n) >= 7))).when(transfers, found("Person", parties)).otherwise(found("Phone", other))
    return rows.select("row_id", F.explode(items).alias("e")).select("row_id", "e.entity_type", "e.name")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text, csv and json files under a folder; bytes that are no UTF-8 become replacement characters, other files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.where(F.lower("path").rlike(r"\.(txt|text|csv|json|md|log)$"))
    return named.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_case_records(spark: SparkSession, path: str) -> DataFrame:
    """The rows of JSON files that hold an array of case records under ``cases``."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")
