"""Merges of entities as decisions over unchanged raw tables: taking a decision out and running again is the split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.plans.fixpoint import connected_components


def gated(recommended: Column, confidence: Column, minimum: float = 0.95) -> Column:
    """An automatic merge needs a confidence of ``minimum``; below it a person reviews."""
    return F.when((recommended == "auto") & (F.coalesce(confidence, F.lit(0.0)) < minimum), "review").otherwise(recommended)


def survivors(decisions: DataFrame) -> DataFrame:
    """(entity_id, survivor) of every entity in a decision (primary, secondary): chains end at the primary that no decision merges away, the smallest if several; of a cycle the smallest id."""
    nodes = connected_components(decisions, "primary", "secondary")
    gone = decisions.where("primary <> secondary").select(F.col("secondary").alias("node")).distinct().withColumn("gone", F.lit(True))
    marked = nodes.join(gone.hint("shuffle_merge"), "node", "left")
    heads = marked.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("gone").isNull(), F.col("node"))), F.min("node")).alias("survivor"))
    return nodes.join(heads.hint("shuffle_merge"), "component").select(F.col("node").alias("entity_id"), "survivor")


def merge_entities(entities: DataFrame, merged: DataFrame) -> DataFrame:
    """Entities (entity_id, entity_type, name, aliases, confidence) after merging: aliases are all aliases and the names merged away, sorted; confidence grows by .1 a merge up to 1.

    ``merged``: (entity_id, survivor). Entities only merge with their own type; others stay. Null aliases are none.
    """
    typed = entities.join(merged.hint("shuffle_merge"), "entity_id", "left")
    heads = entities.select(F.col("entity_id").alias("survivor"), F.col("entity_type").alias("head_type"))
    typed = typed.join(heads.hint("shuffle_merge"), "survivor", "left").withColumn("to", F.when(F.col("head_type") == F.col("entity_type"), F.col("survivor")).otherwise(F.col("entity_id")))
    own = F.col("entity_id") == F.col("to")
    names = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.when(own, F.array().cast("array<string>")).otherwise(F.array("name")))
    out = typed.groupBy(F.col("to").alias("entity_id")).agg(
        F.max(F.when(own, F.col("entity_type"))).alias("entity_type"), F.max(F.when(own, F.col("name"))).alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(names)))).alias("aliases"),
        F.max(F.when(own, F.col("confidence"))).alias("confidence"), F.count_if(~own).alias("merges"),
    )
    return out.withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + 0.1 * F.col("merges")))


def redirect_edges(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges (src, dst, rel_type, weight) of the survivors: each redirected end raises the weight by a fifth, 10 at most; of equal unordered pairs and types the heaviest stays."""
    end = lambda n: merged.select(F.col("entity_id").alias(n), F.nullif(F.col("survivor"), F.col("entity_id")).alias(f"{n}_to"))
    j = edges.join(end("src").hint("shuffle_merge"), "src", "left").join(end("dst").hint("shuffle_merge"), "dst", "left")
    weight = F.col("weight")
    for n in ("src_to", "dst_to"):
        weight = F.when(F.col(n).isNotNull(), F.least(weight * 1.2, F.lit(10.0))).otherwise(weight)
    j = j.select(F.coalesce("src_to", "src").alias("src"), F.coalesce("dst_to", "dst").alias("dst"), "rel_type", weight.alias("weight"))
    return heaviest(j)


def heaviest(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair and type, of the largest weight."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "rel_type").agg(F.max("weight").alias("weight"))


def flag_unresolved(entities: DataFrame, flags: DataFrame) -> DataFrame:
    """Adds status and reason; flagged entities lose .3 of their confidence, down to .1. ``flags``: (entity_id, reason)."""
    once = flags.groupBy("entity_id").agg(F.min("reason").alias("reason"), F.lit(True).alias("flagged"))
    j = entities.join(once.hint("shuffle_merge"), "entity_id", "left")
    low = F.greatest(F.lit(0.1), F.col("confidence") - 0.3)
    return j.withColumns({"status": F.when(F.col("flagged"), "unresolved").otherwise("resolved"), "confidence": F.when(F.col("flagged"), low).otherwise(F.col("confidence"))}).drop("flagged")


def history(log: DataFrame, actions: tuple[str, ...], limit: int = 50) -> DataFrame:
    """The latest ``limit`` rows of the log with one of the actions, newest first, ties by id."""
    return log.where(F.col("action").isin(*actions)).orderBy(F.col("ts").desc(), F.col("log_id").desc()).limit(limit)


def for_graph(entities: DataFrame, minimum: float = 0.6) -> DataFrame:
    """Entities that may enter a graph: confident enough or reviewed."""
    return entities.where((F.col("confidence") >= minimum) | F.coalesce(F.col("is_reviewed"), F.lit(False)))
