"""Pipeline stages over ``documents``: each takes (spark, docs, sf_dir) and, but for the last, returns the columns of documents.

All of them: null ids, texts, languages and sources are values of their own; empty tables give empty tables; columns beyond those of documents are carried and
may have any names, since rows travel as one struct; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.langid import document_evidence, identify
from caseweave.llm.mixing import cycle_weights, mix
from caseweave.llm.neardup import near_duplicates
from caseweave.llm.packing import default_tokenizer, pack_documents
from caseweave.llm.suffixdedup import remove_repeats
from caseweave.plans.scratch import Scratch


def row_key(*columns: str) -> Column:
    """128 bits of a row's columns as text: rows with equal keys are equal in them."""
    return F.concat(*[F.hex(F.xxhash64(F.lit(seed), *columns)) for seed in (1, 2)])


def _held(docs: DataFrame, **keys: Column) -> DataFrame:
    """Rows as one struct ``row`` beside the given columns."""
    return docs.select(F.struct(*docs.columns).alias("row"), *[column.alias(name) for name, column in keys.items()])


def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letters, no language likely enough, or a text unlike all of them) go; the others stay as they are. Equal rows share their verdict."""
    key = row_key("doc_id", "text", "lang", "source")
    found = identify(document_evidence(docs, id_column=key))
    rejected = Scratch(spark).write(found.where(~F.col("accepted")).select(F.col("id").alias("key")).distinct())
    return _held(docs, key=key).join(rejected.hint("shuffle_merge"), "key", "left_anti").select("row.*")


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in five-word shingles (0.8 or more, directly or over others) one stays: that with the smallest doc_id, a null one last, of equal ids that with the smallest text hash.

    Rows are told by id and text, so an id that stands on two texts loses neither unless it is a copy. Repeated rows give one. Documents without words are linked with nothing and stay.
    """
    scratch = Scratch(spark)
    found = scratch.write(near_duplicates(docs, shingle=5).where("comp IS NOT NULL").select("comp", F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "text_hash"))
    best = found.groupBy("comp").agg(F.min(F.struct("none", "id", "text_hash")).alias("best"))
    gone = found.join(best.hint("shuffle_merge"), "comp").where(F.struct("none", "id", "text_hash") != F.col("best"))
    gone = scratch.write(gone.select("none", "id", "text_hash").distinct())
    held = _held(docs, none=F.col("doc_id").isNull(), id=F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), text_hash=F.xxhash64("text"))
    rest = held.join(gone.hint("shuffle_merge"), ["none", "id", "text_hash"], "left_anti")
    return rest.dropDuplicates(["none", "id", "text_hash"]).select("row.*")


def suffix_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that stand elsewhere too are cut from all texts; n_chars follows. Documents stay, if with less text; repeated rows are cut whole, null texts stay null."""
    cut = remove_repeats(docs, keep_columns=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole: 150% of all words, sources weighted 5, 2, 1 in turn, none over two epochs.

    Documents without words are taken by no mix and go. Rows equal in id, text and source are taken alike.
    """
    key = row_key("doc_id", "text", "source")
    keyed = docs.select(key.alias("key"), "text", "source")
    taken = mix(keyed, cycle_weights(docs), id_col="key", boundary="nearest").groupBy(F.col("id").alias("key")).agg(F.max("whole").alias("whole"))
    taken = Scratch(spark).write(taken.where("whole > 0"))
    out = _held(docs, key=key).join(taken.hint("shuffle_merge"), "key").select("row", F.explode(F.sequence(F.lit(1), F.col("whole"))))
    return out.select("row.*")


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place. Repeated rows are packed each, texts that are null or empty as their closing id, longer ones than a sequence in pieces."""
    return pack_documents(docs, default_tokenizer())
