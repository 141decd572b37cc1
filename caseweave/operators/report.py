"""Roll-ups, filters, rankings and interval analysis for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave.plans.blocks import pairs_within


def intervals(events: DataFrame, key: str, day: str) -> DataFrame:
    """Day gaps inside each ``key``: (key, seq, gap, change, direction) from the second event on."""
    w = Window.partitionBy(key).orderBy(day)
    out = events.withColumn("seq", F.row_number().over(w)).withColumn("gap", F.datediff(F.col(day), F.lag(day).over(w)))
    out = out.withColumn("change", F.col("gap") - F.lag("gap").over(w))
    direction = F.when(F.col("change") < 0, "accelerating").when(F.col("change") > 0, "decelerating").when(F.col("change") == 0, "constant")
    return out.where("gap IS NOT NULL").select(key, "seq", "gap", "change", direction.alias("direction"))


def interval_trend(gaps: DataFrame, key: str) -> DataFrame:
    """(key, gaps, trend): strictly growing gaps decelerate, shrinking ones accelerate; one gap counts as growing; mean second difference."""
    w = Window.partitionBy(key).orderBy("seq")
    second = F.lead("gap").over(w) - 2 * F.col("gap") + F.lag("gap").over(w)
    out = gaps.withColumn("second", second).groupBy(key).agg(F.count("*").alias("gaps"), F.bool_and(F.col("change") > 0).alias("up"), F.bool_and(F.col("change") < 0).alias("down"), F.avg("second").alias("mean_second"))
    trend = F.when(F.coalesce("up", F.lit(True)), "decelerating").when(F.coalesce("down", F.lit(True)), "accelerating").otherwise("irregular")
    return out.select(key, "gaps", trend.alias("trend"), "mean_second")


def min_max(df: DataFrame, value: str) -> DataFrame:
    """Adds ``scaled``: 0 to 100 between the least and the largest value; a flat column is 0."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    return df.crossJoin(F.broadcast(ends)).withColumn("scaled", (F.col(value) - F.col("_lo")) / span * 100).drop("_lo", "_hi")


def top_per(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def location_pairs(presence: DataFrame) -> DataFrame:
    """Locations that share persons: (loc_a, loc_b, shared)."""
    pairs = pairs_within(presence, ["person"], "location").select(F.col("a").alias("loc_a"), F.col("b").alias("loc_b"))
    return pairs.groupBy("loc_a", "loc_b").agg(F.count("*").alias("shared"))


def case_summary(cases: DataFrame, **parts: DataFrame) -> DataFrame:
    """Counts of each part's rows per case_id, 0 where there are none."""
    out = cases.select("case_id").distinct()
    for name, df in parts.items():
        out = out.join(df.groupBy("case_id").agg(F.count("*").alias(name)), "case_id", "left")
    return out.fillna(0, list(parts))


def common_links(entities: DataFrame, cases: DataFrame) -> DataFrame:
    """Names in two or more of the chosen cases: (entity_type, name, cases, records)."""
    chosen = entities.join(cases.select("case_id").distinct(), "case_id", "left_semi")
    return chosen.groupBy("entity_type", "name").agg(F.count_distinct("case_id").alias("cases"), F.count("*").alias("records")).where("cases >= 2")


def confidence_buckets(entities: DataFrame) -> DataFrame:
    bucket = F.when(F.col("unresolved"), "unresolved").when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low")
    return entities.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def search(df: DataFrame, column: str, term: str, limit: int = 500) -> DataFrame:
    """Rows whose column contains the term in any case, in order of the column, at most ``limit``."""
    return df.where(F.contains(F.lower(column), F.lit(term.lower()))).orderBy(column).limit(limit)


def scoped(df: DataFrame, assignments: DataFrame, user_id: str) -> DataFrame:
    """Rows of the cases assigned to the user."""
    return df.join(assignments.where(F.col("user_id") == user_id).select("case_id").distinct(), "case_id", "left_semi")


def rank_agreement(a: DataFrame, b: DataFrame, key: str, value: str, n: int = 5) -> DataFrame:
    """Share of the top ``n`` of one ranking that the other's top ``n`` has; valid from .6."""
    top = lambda d: d.orderBy(F.col(value).desc(), key).limit(n).select(key)
    shared = top(a).join(top(b), key).agg((F.count("*") / n).alias("agreement"))
    return shared.withColumn("valid", F.col("agreement") >= 0.6)
