"""Merges and splits of entities as a log over unchanged tables: any past state can be replayed, and a new decision touches its own components only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.operators.resolution import survivors
from caseweave.plans.scratch import Scratch


def in_force(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """(primary, secondary) of the merges that hold after the decisions up to ``as_of`` (all by default): the last decision on a pair counts, whichever way round it names it; a split ends a merge.

    log: (seq, action merge or split, primary, secondary). Null ends and other actions are left out; of equal seqs the split counts.
    """
    known = log.where("primary IS NOT NULL AND secondary IS NOT NULL AND action IN ('merge', 'split')")
    known = known if as_of is None else known.where(F.col("seq") <= as_of)
    last = known.groupBy(F.least("primary", "secondary").alias("a"), F.greatest("primary", "secondary").alias("b")).agg(F.max_by(F.struct("action", "primary", "secondary"), F.struct("seq", "action")).alias("d"))
    return last.where("d.action = 'merge'").select("d.primary", "d.secondary")


def replay(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """(entity_id, survivor) after the decisions up to ``as_of``, for entities in a merge that holds."""
    return survivors(in_force(log, as_of))


def resume(before: DataFrame, log: DataFrame, since: int, as_of: int | None = None) -> DataFrame:
    """``replay`` up to ``as_of``, from the state ``before`` after ``since``: only components that hold an entity of a later decision are computed again, all others are taken over."""
    scratch = Scratch(log.sparkSession)
    later = log.where(F.col("seq") > since)
    later = later if as_of is None else later.where(F.col("seq") <= as_of)
    named = scratch.write(later.select(F.explode(F.array("primary", "secondary")).alias("entity_id")).where("entity_id IS NOT NULL").distinct())
    heads = before.join(named.hint("shuffle_merge"), "entity_id").select("survivor").distinct()
    touched = before.join(heads.hint("shuffle_merge"), "survivor").select("entity_id").union(named).distinct()
    touched = scratch.write(touched)
    held = in_force(log, as_of).join(touched.select(F.col("entity_id").alias("primary")).hint("shuffle_merge"), "primary")
    again = scratch.write(survivors(held))
    return before.join(touched.hint("shuffle_merge"), "entity_id", "left_anti").select("entity_id", "survivor").unionByName(again)


def merged_attributes(attributes: DataFrame, merged: DataFrame) -> DataFrame:
    """(entity_id, attributes map) of the survivors: attributes of all that were merged, the survivor's own value first, then that of the smallest entity_id.

    attributes: (entity_id, kind, value), one value a kind; of several the least counts. Null kinds and values are left out; entities in no merge keep theirs.
    """
    rows = attributes.where("kind IS NOT NULL AND value IS NOT NULL").join(merged.hint("shuffle_merge"), "entity_id", "left")
    to = F.coalesce("survivor", "entity_id")
    best = rows.groupBy(to.alias("to"), "kind").agg(F.min_by("value", F.struct(to != F.col("entity_id"), F.col("entity_id"), F.col("value"))).alias("value"))
    return best.groupBy(F.col("to").alias("entity_id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "value")))).alias("attributes"))
