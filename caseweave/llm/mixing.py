"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave.plans.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to rows of (source_size, weight): ``total`` shared by weight, none above ``max_epochs`` times its size.

    Each round clamps the sources whose share exceeds their cap and shares what is left by weight among
    the others, until no share exceeds its cap. A round is one aggregation; the driver sees two sums and
    a count. If all caps together are below ``total``, every target is its cap. No rows give no rows.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = 0.0
    clamped = -1
    while True:
        # a source stays clamped once its cap is below the rising level
        over = (cap < F.col("weight") * F.lit(level)) | (F.col("source_size") == 0)
        row = sources.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count_if(over)
        ).first()
        if row[2] == clamped or not row[1]:
            break
        clamped = row[2]
        level = max(level, (total - row[0]) / row[1])
    return sources.withColumn("target", F.when(over, cap).otherwise(F.least(cap, F.col("weight") * F.lit(level))))


def rank_by(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Adds the 0-based rank of each row in ``order`` without sorting all rows in one task.

    Rows are dealt by range, numbered inside their partition and shifted by the counts of the partitions
    before, of which there are as many as tasks. ``df`` must be cheap and stable to read, as a written table is.
    """
    dealt = df.withColumn("_k", order).repartitionByRange(F.col("_k").asc_nulls_last()).withColumn("_p", F.spark_partition_id())
    dealt = Scratch(df.sparkSession).write(dealt.sortWithinPartitions(F.col("_k").asc_nulls_last()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33)))
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return dealt.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_k", "_p", "_i", "_before")


def mix(
    docs: DataFrame,
    weights: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    total_share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 0,
    buckets: int = 4096,
    boundary: str = "partial",
    carry_text: bool = False,
) -> DataFrame:
    """How often the mix repeats each document.

    ``weights`` has (source, weight), one row per source, nulls matching null. All sources together take
    ``total_share`` times the words of ``docs``; water-filling gives each its target. A source of ``e`` epochs
    takes every document floor(e) times and, of one more seeded pass, the documents that come first in the
    order of a seeded hash until the rest of the target is reached. Running sums are taken per
    (source, hash bucket), so that a source with a third of all rows is no group of its own.
    ``boundary``: the document on the border gives its first words ("partial") or counts
    whole or not at all, whichever is nearer ("nearest").

    Returns id, size, source, source_size, target (double), epochs, whole (repetitions of the whole document),
    part (words of one more, cut repetition) and taken = whole * size + part, and the text if ``carry_text``.
    Null and empty texts have size 0 and take nothing; a null source is a source; repeated rows count each;
    rows equal in id and size are interchangeable; no rows give no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    text = [F.col(text_col).alias("text")] if carry_text else []
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"), *text)
    sized = scratch.write(sized.withColumn("bucket", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(buckets))))
    cells = scratch.write(sized.groupBy("source", "bucket").agg(F.sum("size").alias("cell")))
    totals = cells.groupBy("source").agg(F.sum("cell").alias("source_size"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double"))
    totals = scratch.write(totals.join(w, totals["source"].eqNullSafe(w["_s"])).drop("_s"))
    total = totals.agg(F.sum("source_size")).first()[0] or 0
    filled = water_fill(totals, total_share * total, max_epochs)
    filled = scratch.write(filled.withColumn("epochs", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    # words that the cut pass takes, and where each bucket of a source starts in it
    cut = F.round(F.col("target") - F.floor("epochs") * F.col("source_size")).cast("long")
    plan = filled.select("source", "source_size", "target", "epochs", F.floor("epochs").alias("passes"), cut.alias("cut"))
    starts = cells.withColumn("start", F.sum("cell").over(Window.partitionBy("source").orderBy("bucket")) - F.col("cell"))
    starts = starts.join(plan, same(starts, plan)).drop(plan["source"])
    starts = scratch.write(starts.withColumn("where", F.when(F.col("start") + F.col("cell") <= F.col("cut"), 1).when(F.col("start") >= F.col("cut"), 0).otherwise(2)))
    # the plan is dealt over sources and buckets, so a hot source is spread over its buckets
    at = sized.join(starts, same(sized, starts) & (sized["bucket"] == starts["bucket"])).drop(starts["source"], starts["bucket"])
    sure = at.where("where < 2").withColumn("part", F.when(F.col("where") == 1, F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("source", "bucket").orderBy("key", "size")
    split = at.where("where = 2").withColumn("from", F.col("start") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    room = F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut") - F.col("from")))
    if boundary == "nearest":
        room = F.when(room * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    out = sure.unionByName(split.withColumn("part", room.cast("long")).drop("from"))
    whole = F.col("passes") + F.when((F.col("part") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    out = out.withColumn("whole", F.least(whole, F.lit(max_epochs)).cast("int")).withColumn("part", F.when(F.col("part") < F.col("size"), F.col("part")).otherwise(0).cast("long"))
    out = out.withColumn("taken", (F.col("whole") * F.col("size") + F.col("part")).cast("long"))
    return out.select("id", "source", "size", "source_size", "target", "epochs", "whole", "part", "taken", *(["text"] if carry_text else []))


def repeat(mixed: DataFrame) -> DataFrame:
    """One row for each whole repetition of a mixed document, its number in ``repetition``. Documents not taken go."""
    return mixed.where("whole > 0").withColumn("repetition", F.explode(F.sequence(F.lit(1), F.col("whole"))))


def cycle_weights(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), source_col: str = "source") -> DataFrame:
    """(source, weight): the sources by code point, null last, get the given weights in turn."""
    names = Scratch(docs.sparkSession).write(docs.select(F.col(source_col).alias("source")).distinct())
    ranked = rank_by(names, F.col("source"), "rank")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    return ranked.select("source", pick.alias("weight"))


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs, cycle_weights(docs))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('0:' || doc_id) AS key
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source),
-- sources saturate in the order of cap / weight, so the clamped ones are a prefix
pre AS (
  SELECT *, 2.0 * source_size AS cap,
         coalesce(sum(2.0 * source_size) OVER w, 0) AS cap_before, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left,
         1.5 * sum(source_size) OVER () AS total
  FROM src WINDOW w AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT max((total - cap_before) / weight_left) AS level FROM pre WHERE cap / weight >= (total - cap_before) / weight_left),
tgt AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(cap, weight * level) END::DOUBLE AS target FROM pre, lev),
run AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target / t.source_size) END AS passes,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY (('0x' || key[1:8])::BIGINT % 4096), key, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS start
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (least(passes * size, 2 * size) + greatest(0, least(CASE WHEN passes >= 2 THEN 0 ELSE size END, round(target - passes * source_size)::BIGINT - start)))::BIGINT AS taken
FROM run
"""
