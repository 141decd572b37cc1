"""Stored tables that batches are merged into, and typed ingestion that counts while it reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from caseweave.plans.scratch import Scratch

ENTITY = "case_id long, entity_type string, name string, attributes map<string,string>, confidence double, part int"
EDGE = "case_id long, a string, b string, rel_type string, weight double, justification string, part int"
METRICS = "job string, records long, entities long, relationships long, errors long, status string"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _rewrite(spark: SparkSession, path: str, schema: str, incoming: DataFrame, merge, parts: int) -> list[int]:
    """Merges ``incoming``, which has a column ``part``, into the partitions of the stored table that it touches; the others' files stay as they are. Returns the partitions written.

    What the merge gives is written aside first and swapped in by partition; a run that breaks off is simply run again, as merging a batch twice gives what merging it once gives.
    Partitions whose rows the batch doesn't change are left alone.
    """
    scratch = Scratch(spark)
    new = scratch.write(incoming)
    old = _stored(spark, path, schema)
    touched = [r.part for r in new.select("part").distinct().collect()]  # at most ``parts``
    merged = scratch.write(merge(old.where(F.col("part").isin(touched)), new))
    def state(df):
        values = [F.to_json(F.array_sort(F.map_entries(f.name))) if f.dataType.typeName() == "map" else F.col(f.name) for f in merged.schema if f.name != "part"]
        return df.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*values).cast("decimal(38,0)")).alias("h"))

    changed = [r.part for r in state(merged).exceptAll(state(old.where(F.col("part").isin(touched)).select(*merged.columns))).select("part").distinct().collect()]
    if changed:
        rows = merged.where(F.col("part").isin(changed)).repartition(min(parts, len(changed)), "part")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    scratch.keep_only()
    return sorted(changed)


def upsert_stored_entities(path: str, incoming: DataFrame, *, parts: int = 64) -> list[int]:
    """Merges entities (case_id, entity_type, name, attributes map<string,string>, confidence, seq) into the table under ``path``, and returns the partitions that changed.

    The key is (case_id, entity_type, name). Attributes are united, each with its latest value (stored, then by seq, ties to the greatest value); the latest confidence that isn't null stays. A null map is empty, a null
    attribute value is no value. Cases are dealt to ``parts`` partitions by hash, which must stay the same for a table; only partitions with incoming rows are read, and only changed ones written.
    """
    part = F.pmod(F.xxhash64("case_id"), F.lit(parts)).cast("int")
    new = incoming.select("case_id", "entity_type", "name", "attributes", "confidence", F.col("seq").cast("long").alias("seq"), part.alias("part"))
    key = ["part", "case_id", "entity_type", "name"]

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rows = old.withColumn("seq", F.lit(None).cast("long")).unionByName(new)  # a stored row comes before any seq
        order = lambda v: F.struct(F.col("seq").isNotNull(), F.col("seq"), F.col(v))
        base = rows.groupBy(*key).agg(F.max_by("confidence", F.when(F.col("confidence").isNotNull(), order("confidence"))).alias("confidence"))
        cells = rows.select(*key, "seq", F.explode("attributes").alias("k", "v")).where("v IS NOT NULL").groupBy(*key, "k").agg(F.max_by("v", order("v")).alias("v"))
        maps = cells.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
        same = [base[c].eqNullSafe(maps[c]) for c in key]
        out = base.join(maps.hint("shuffle_merge"), same, "left").select(*[base[c] for c in key], "confidence", F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"))
        return out.select("case_id", "entity_type", "name", "attributes", "confidence", "part")

    return _rewrite(incoming.sparkSession, path, ENTITY, new, merge, parts)


def upsert_stored_edges(path: str, incoming: DataFrame, *, parts: int = 64) -> list[int]:
    """Merges edges (case_id, src, dst, rel_type, weight, justification, seq) into the table under ``path``, and returns the partitions that changed.

    The key is (case_id, unordered pair, rel_type). The largest weight stays, and the first justification that isn't blank (stored, then by seq, ties to the one that sorts first). Edges with a null end are left out.
    """
    part = F.pmod(F.xxhash64("case_id"), F.lit(parts)).cast("int")
    ends = [F.least("src", "dst").cast("string").alias("a"), F.greatest("src", "dst").cast("string").alias("b")]
    new = incoming.where("src IS NOT NULL AND dst IS NOT NULL").select("case_id", *ends, "rel_type", "weight", "justification", F.col("seq").cast("long").alias("seq"), part.alias("part"))

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rows = old.withColumn("seq", F.lit(None).cast("long")).unionByName(new)
        said = F.trim(F.coalesce("justification", F.lit(""))) != ""
        first = F.min_by("justification", F.when(said, F.struct(F.col("seq").isNotNull(), "seq", "justification")))
        return rows.groupBy("part", "case_id", "a", "b", "rel_type").agg(F.max("weight").alias("weight"), first.alias("justification")).select("case_id", "a", "b", "rel_type", "weight", "justification", "part")

    return _rewrite(incoming.sparkSession, path, EDGE, new, merge, parts)


def read_stored(spark: SparkSession, path: str, schema: str = ENTITY) -> DataFrame:
    """The rows of a stored table; none where nothing was stored yet."""
    return _stored(spark, path, schema).drop("part")


def typed_rows(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """``rows`` with the columns in ``types`` cast, and ``errors``: array<struct<column, value>> of the cells that don't take their type, which become null. Blank cells are null without error; no row fails."""
    text = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in types}
    cast = {c: text[c].try_cast(t) for c, t in types.items()}
    bad = F.array_compact(F.array(*[F.when(text[c].isNotNull() & cast[c].isNull(), F.struct(F.lit(c).alias("column"), text[c].alias("value"))) for c in types]))
    return rows.withColumns({"errors": bad, **cast})


def validation_report(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """(column, problem, n, example) of a file's rows against its schema: columns that are missing, and for each present one the cells that don't take their type, with the least as an example."""
    there = {c: t for c, t in types.items() if c in rows.columns}
    missing = [(c, "missing", 0, None) for c in types if c not in there]
    out = rows.sparkSession.createDataFrame(missing, "column string, problem string, n long, example string")
    if not there:
        return out
    cells = typed_rows(rows, there).select(F.explode("errors").alias("e"))
    kinds = F.create_map(*[F.lit(x) for c, t in there.items() for x in (c, f"not {t}")])
    return out.unionByName(cells.groupBy(F.col("e.column").alias("column")).agg(F.count("*").alias("n"), F.min("e.value").alias("example")).select("column", kinds[F.col("column")].alias("problem"), "n", "example"))


def ingest(rows: DataFrame, types: dict[str, str], entity_columns: list[str], path: str, job: str) -> DataFrame:
    """Writes typed rows under ``path`` (good rows under ``rows``, bad ones with their cells under ``errors``) and returns one row of the job's metrics: see ``METRICS``.

    Metrics are counted by an observation in the pass that types the rows: records, entities (filled cells of ``entity_columns`` in good rows), relationships (pairs of entities of one good row), errors (bad rows), status
    (``failed`` where a typed column is missing or all rows are bad, ``completed with errors``, ``completed``). A bad row never fails the job; a file with missing columns is refused and nothing is written.
    """
    spark = rows.sparkSession
    absent = [c for c in types if c not in rows.columns]
    if absent:
        return spark.createDataFrame([(job, 0, 0, 0, len(absent), "failed")], METRICS)
    scratch = Scratch(spark)
    good = F.size("errors") == 0
    filled: Column = sum((F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)).cast("long") for c in entity_columns), F.lit(0).cast("long"))
    seen = Observation(f"ingest {job}")
    marked = typed_rows(rows, types).observe(
        seen, F.count(F.lit(1)).alias("records"), F.sum(F.when(good, filled).otherwise(0)).alias("entities"),
        F.sum(F.when(good, filled * (filled - 1) / 2).otherwise(0)).cast("long").alias("relationships"), F.count_if(~good).alias("errors"),
    )
    marked = scratch.write(marked)
    found = {k: int(v or 0) for k, v in seen.get.items()}
    marked.where(good).drop("errors").write.mode("overwrite").parquet(f"{path}/rows")
    marked.where(~good).write.mode("overwrite").parquet(f"{path}/errors")
    scratch.keep_only()
    status = "failed" if found["records"] and found["errors"] == found["records"] else "completed with errors" if found["errors"] else "completed"
    return spark.createDataFrame([(job, found["records"], found["entities"], found["relationships"], found["errors"], status)], METRICS)
