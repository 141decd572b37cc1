"""Tamper evidence: hash chains, one per key."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

GENESIS = "0" * 64


def payload(*columns: str):
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def build_chain(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Adds block_index, previous_hash and block_hash, each over the row's payload and the hash before it, to one chain per ``key``.

    A chain is sequential by nature: the rows of a key are sorted in one task, which spills, and read once with only the last hash carried on; keys go side by side.
    Rows of equal order are taken by payload; a null key is a key. No rows give no rows.
    """
    sorted_rows = rows.select(F.col(key), F.col(order).cast("long").alias(order), payload(*columns).alias("p")).repartition(F.col(key)).sortWithinPartitions(key, order, "p")
    schema = StructType([rows.schema[key]]).add("block_index", "long").add(order, "long").add("previous_hash", "string").add("block_hash", "string")

    def link(batches):
        of, index, before = object(), 0, GENESIS
        for batch in batches:
            indices, previous, hashes = [], [], []
            for k, p in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != of:
                    of, index, before = k, 0, GENESIS
                indices.append(index)
                previous.append(before)
                before = hashlib.sha256(f"{p}|{before}".encode()).hexdigest()
                hashes.append(before)
                index += 1
            columns = [batch.column(0), pa.array(indices, pa.int64()), batch.column(1), pa.array(previous, pa.string()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return sorted_rows.mapInArrow(link, schema)


def verify_chain(blocks: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key: (blocks, first_bad, reason): a broken link outranks a wrong hash on the same block.

    Each block is matched with the one before it by key and index, so that the blocks of one long chain are verified over all tasks. Block 0 follows ``GENESIS``; a block whose predecessor is
    missing, or is there with two hashes, is a broken link. A null key is a key; rows repeated as a whole are blocks each. No blocks give no rows.
    """
    good = F.sha2(F.concat_ws("|", payload(*columns), F.col("previous_hash")), 256) == F.col("block_hash")
    base = blocks.select(F.col(key).alias("k"), F.struct(F.col(key).isNull(), F.col(key).cast("string")).alias("chain"), "block_index", "block_hash", "previous_hash", good.alias("good"))
    ahead = base.groupBy("chain", (F.col("block_index") + 1).alias("block_index")).agg(F.min("block_hash").alias("before"), F.max("block_hash").alias("other"))
    met = base.join(ahead.hint("shuffle_merge"), ["chain", "block_index"], "left")
    before = F.when(F.col("block_index") == 0, GENESIS).when(F.col("before") == F.col("other"), F.col("before"))
    link = F.coalesce(before == F.col("previous_hash"), F.lit(False))
    checked = met.withColumn("reason", F.when(~link, "link").when(~F.coalesce("good", F.lit(False)), "hash"))
    bad = F.when(F.col("reason").isNotNull(), F.col("block_index"))
    first = F.min_by("reason", F.when(bad.isNotNull(), F.struct(bad, F.col("reason") == "hash")))
    return checked.groupBy(F.col("k").alias(key)).agg(F.count("*").alias("blocks"), F.min(bad).alias("first_bad"), first.alias("reason"))


def block(blocks: DataFrame, index: int) -> DataFrame:
    """The block with this index of each chain."""
    return blocks.where(F.col("block_index") == index)
