"""Pairs of members of one group, with large groups dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs_within(rows: DataFrame, keys: list[str], member: str, block_rows: int = 2_000) -> DataFrame:
    """(keys, a, b), a < b: every pair of different members of a group, once for each group that holds both.

    A group of more than ``block_rows`` members is cut in blocks by hash, and each pair of blocks is a group of the join of its own: a task
    meets two blocks at most, and a member is sent once for each block of its group. Null keys and members make no pairs; repeated rows count once.
    """
    base = rows.select(*keys, F.col(member).alias("m")).dropna().distinct()
    met = _met(base, keys, [], block_rows)
    return met.select(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def pairs_carrying(rows: DataFrame, keys: list[str], member: str, carried: list[str], block_rows: int = 2_000) -> DataFrame:
    """``pairs_within`` with the columns ``carried`` of both members: (keys, a, b, columns ending in _a and _b), so that pairs are judged where they meet and are not shuffled.

    One row for each group and member. The join's tasks are fixed in number, as few rows make many pairs.
    """
    base = rows.select(*keys, F.col(member).alias("m"), *carried).dropna(subset=[*keys, "m"])
    met = _met(base, keys, carried, block_rows, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    first = F.col("x") < F.col("y")
    ends = [F.when(first == is_a, F.col(f"{c}_x")).otherwise(F.col(f"{c}_y")).alias(f"{c}_{end}") for c in carried for end, is_a in (("a", True), ("b", False))]
    return met.select(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *ends)


def _met(base: DataFrame, keys: list[str], carried: list[str], block_rows: int, tasks: int | None = None) -> DataFrame:
    blocks = base.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    dealt = base.join(blocks.hint("shuffle_merge"), keys).withColumn("block", F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int"))
    last = F.col("blocks") - 1
    with_ = lambda end: [F.col(c).alias(f"{c}_{end}") for c in carried]
    left = dealt.select(*keys, F.col("block").alias("i"), F.explode(F.sequence("block", last)).alias("j"), F.col("m").alias("x"), *with_("x"))
    right = dealt.select(*keys, F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("m").alias("y"), *with_("y"))
    if tasks:
        left, right = (side.repartition(tasks, *keys, "i", "j") for side in (left, right))
    met = left.join(right.hint("shuffle_merge"), [*keys, "i", "j"])
    return met.where((F.col("i") < F.col("j")) & (F.col("x") != F.col("y")) | (F.col("i") == F.col("j")) & (F.col("x") < F.col("y")))


def blocks_met(rows: DataFrame, keys: list[str], member: str, carried: list[str], block_rows: int = 2_000) -> DataFrame:
    """One row for each pair of blocks of a group that ``pairs_carrying`` joins member by member: (keys, x, y), arrays of structs (m, carried) of a block's members; y is empty where a block meets itself.

    For pairs that are judged in arrays within a task, with nothing shuffled after they meet.
    """
    base = rows.select(*keys, F.col(member).alias("m"), *carried).dropna(subset=[*keys, "m"])
    blocks = base.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"), F.count("*").alias("members")).where("members > 1").drop("members")
    dealt_out = base.join(blocks.hint("shuffle_merge"), keys).withColumn("block", F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int"))
    return _blocks_joined(dealt_out, blocks, keys, carried)


def all_blocks_met(rows: DataFrame, member: str, carried: list[str], block_rows: int = 2_000) -> DataFrame:
    """``blocks_met`` of all rows as one group: (x, y). The rows are counted first."""
    base = rows.select(F.lit(0).alias("_all"), F.col(member).alias("m"), *carried).dropna(subset=["m"])
    n = max(1, -(-base.count() // block_rows))
    blocks = rows.sparkSession.range(1).select(F.lit(0).alias("_all"), F.lit(n).alias("blocks"))
    return _blocks_joined(base.withColumns({"blocks": F.lit(n), "block": F.pmod(F.xxhash64("m"), F.lit(n)).cast("int")}), blocks, ["_all"], carried).select("x", "y")


def _blocks_joined(members: DataFrame, blocks: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    brought = F.struct("m", *carried)
    left = members.select(*keys, F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), brought.alias("s"))
    right = members.where("block > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), brought.alias("s"))
    alone = blocks.select(*keys, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).select(*keys, "i", F.col("i").alias("j"), F.lit(None).cast(left.schema["s"].dataType).alias("s"))
    tasks = 4 * members.sparkSession.sparkContext.defaultParallelism
    side = lambda df, name: df.repartition(tasks, *keys, "i", "j").groupBy(*keys, "i", "j").agg(F.collect_list("s").alias(name))
    return side(left, "x").join(side(right.unionByName(alone), "y").hint("shuffle_merge"), [*keys, "i", "j"]).select(*keys, "x", "y")


def dealt(rows: DataFrame, *keys, tasks_per_core: int = 16) -> DataFrame:
    """``rows`` by the hash of ``keys`` over many small tasks, in a number that adaptive execution leaves as it is.

    Joins and aggregates by these keys, or by these and more, need no further shuffle, so several of them share this one, and what one task holds stays small.
    """
    return rows.repartition(tasks_per_core * rows.sparkSession.sparkContext.defaultParallelism, *keys)
