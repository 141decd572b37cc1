"""Incremental operators on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.operators.detect import new_alerts


def contact_windows(contacts: DataFrame, minimum: int = 10, late: str = "1 hour") -> DataFrame:
    """Contacts per unordered pair in sliding windows of a day, from ``minimum`` on; rows later than the watermark are dropped."""
    pair = contacts.where("src <> dst").withWatermark("ts", late).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "ts")
    out = pair.groupBy(F.window("ts", "24 hours", "1 hour"), "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= minimum)
    return out.select("a", "b", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def without_repeats(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """The first of rows with equal ``row_hash`` inside the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["row_hash"])


def number_sessions(contacts: DataFrame, gap: str = "7 days", late: str = "1 day") -> DataFrame:
    """Activity sessions per number; state lives as long as the gap."""
    out = contacts.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "number").agg(F.count("*").alias("n"))
    return out.select("number", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def cross_case_sink(entities_path: str, out_path: str):
    """A ``foreachBatch`` function: alerts (alert_type, title, entity_type, name, cases) on names of the batch that another case has, in the stored entities or in the batch itself, go to ``out_path``.

    Exactly once: an epoch has a partition of its own, which a replay writes over, and only epochs before it count as known; so a replayed epoch gives the same rows, and a name that stayed alerted in
    an earlier epoch is not alerted again. Rows without name, type or case alert nothing. Names arrive late or early alike: a row is compared with all that is stored when its batch runs.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        here = batch.select("entity_type", "name", "case_id").dropna().distinct()
        known = spark.read.parquet(entities_path).select("entity_type", "name", "case_id").join(here.select("entity_type", "name").distinct().hint("shuffle_merge"), ["entity_type", "name"])
        cases = here.union(known).distinct().groupBy("entity_type", "name").agg(F.count("*").alias("cases")).where("cases > 1")
        found = cases.select(F.lit("cross_case").alias("alert_type"), F.concat_ws(": ", "entity_type", "name").alias("title"), "entity_type", "name", "cases")
        where = spark._jvm.org.apache.hadoop.fs.Path(out_path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            schema = "alert_type string, title string, entity_type string, name string, cases long, epoch long"
            found = new_alerts(found, spark.read.schema(schema).parquet(out_path).where(F.col("epoch") < epoch))
        found.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(out_path)

    return write
