"""Quality classifier: a sparse ensemble of rules from tree paths, weighted by lasso logistic regression and compiled to column expressions."""

from __future__ import annotations

import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from caseweave.plans.scratch import Scratch

#: Rows that the trees and weights are fitted on: those with the smallest hashes of their id.
SAMPLE = 20_000
STATISTICS = ("log_chars", "word_length", "symbols", "digits", "capitals", "pipes", "bangs", "repeats", "distinct", "line_words", "marks")


_CLASSES = {"symbols": b"#$%&*@^~_=+<>[]{}\\/", "digits": b"0123456789", "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "pipes": b"|", "bangs": b"!", "marks": b".,"}


def text_statistics(text: str) -> tuple[float, ...]:
    """The ``STATISTICS`` of one whole text, in their order; all are defined for the empty text."""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "ignore"), np.uint8), minlength=256)
    words = text.lower().split()
    n, count = max(1, len(text)), max(1, len(words))
    share = {name: int(counts[list(chars)].sum()) / n for name, chars in _CLASSES.items()}
    share |= {
        "log_chars": math.log1p(len(text)), "word_length": len(text) / count, "repeats": sum(map(operator.eq, words, words[1:])) / count,
        "distinct": len(set(words)) / count, "line_words": count / (int(counts[10]) + 1),
    }
    return tuple(share[name] for name in STATISTICS)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the ``STATISTICS`` of each whole text; a null text counts as an empty one."""
    rows = docs.select("doc_id", "text")
    names = ["doc_id", *STATISTICS]

    def measured(batches):
        for batch in batches:
            found = [text_statistics(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in found], pa.float64()) for i in range(len(STATISTICS)))], names)

    return rows.mapInArrow(measured, StructType([rows.schema["doc_id"], *(StructField(name, DoubleType()) for name in STATISTICS)]))


def tree_paths(node, names) -> list[tuple[tuple[str, bool, float], ...]]:
    """Conjunctions (statistic, at most?, threshold) on the way to every inner node and leaf of a fitted tree."""
    out, todo = [], [(node, ())]
    while todo:
        at, path = todo.pop()
        if path:
            out.append(tuple(sorted(path)))
        if at.numDescendants() > 0:
            split = at.split()
            name = names[split.featureIndex()]
            todo += [(at.leftChild(), (*path, (name, True, split.threshold()))), (at.rightChild(), (*path, (name, False, split.threshold())))]
    return out


def rule_column(path) -> Column:
    return math_and([(F.col(name) <= F.lit(limit)) if below else (F.col(name) > F.lit(limit)) for name, below, limit in path])


def math_and(parts: list[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out & part
    return out


def fit_rules(labelled: DataFrame, *, trees: int = 16, depth: int = 3, strength: float = 0.001, seed: int = 7) -> tuple[float, list[tuple[tuple, float]]]:
    """(intercept, [(rule, weight)]) from rows of the statistics and ``label``: a forest gives the rules, the lasso keeps few of them.

    ``labelled`` is a bounded sample. With one label only, or too few rows for a split, the intercept is the smoothed log odds and there are no rules; without rows it is 0.
    """
    n, ones = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not n or ones in (0, n):
        return math.log((ones + 1) / (n - ones + 1)), []
    table = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(labelled)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, bootstrap=False, featureSubsetStrategy="0.5", maxBins=64, minInstancesPerNode=5).fit(table)
    rules = sorted({p for tree in forest.trees for p in tree_paths(tree._call_java("rootNode"), STATISTICS)})
    if not rules:  # no split holds enough rows on both sides
        return math.log((ones + 1) / (n - ones + 1)), []
    bits = labelled.select("label", *[rule_column(p).cast("double").alias(f"r{i}") for i, p in enumerate(rules)])
    table = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(bits).select("label", "features")
    model = LogisticRegression(regParam=strength, elasticNetParam=1.0, maxIter=60, standardization=False).fit(table.cache())
    table.unpersist()
    return float(model.intercept), [(p, float(w)) for p, w in zip(rules, model.coefficients, strict=True) if w]


def score_column(intercept: float, rules) -> Column:
    """The ensemble as one expression over the statistics' columns, 0 to 1."""
    total = F.lit(intercept)
    for path, weight in rules:
        total = total + F.when(rule_column(path), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """Per document: held_out, score (likelihood of quality 1) and predicted (1 if score >= ``threshold``).

    Rules see statistics of the whole text only. They are fitted on at most ``sample`` labelled rows that are not held out; labels that are null or of documents
    that are missing are not used, repeated labels each count. Only doc_id, text and quality are read, so other columns may have any names. Null and empty texts have statistics and so a score. Repeated documents are each scored. No labels give the score 0.5.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(statistics(docs))
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("label"))
    train = rows.where(~held_out(F.col("doc_id"))).join(known.hint("shuffle_merge"), "doc_id")
    picked = train.orderBy(F.xxhash64("doc_id"), "label").limit(sample).coalesce(2)
    intercept, rules = fit_rules(scratch.write(picked))
    score = score_column(intercept, rules)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
