"""Near-duplicate documents: MinHash bands find candidates, odd sketches estimate their similarity, full shingle sets confirm it."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.textkernels import SEGMENT, U, mix, shingle_set
from caseweave.plans.fixpoint import connected_components
from caseweave.plans.scratch import Scratch

BANDS, ROWS, BITS = 32, 5, 512
SAMPLES = BANDS * ROWS
_rng = np.random.Generator(np.random.PCG64(20240))
_XOR = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)[:, None]
_MUL = (_rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) | U(1))[:, None]
SKETCH = "id long, text_hash long, n_shingles long, cls binary, bands array<long>, odd array<long>"


def minhash(shingles: np.ndarray) -> np.ndarray:
    """``SAMPLES`` minima of a set of hashes, each under its own mixing."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, U)
    for at in range(0, len(shingles), 4096):
        np.minimum(low, (((shingles[at : at + 4096] ^ _XOR) * _MUL) >> U(24)).min(axis=1), out=low)
    return low


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of ``BITS`` bits as longs: each (position, sample) flips one bit, so the XOR of two sketches shows where their samples differ."""
    at = (mix(samples + np.arange(SAMPLES, dtype=U) * U(0x9E3779B97F4A7C15)) % U(BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def max_distance(similarity: float, deviations: float = 6.0) -> int:
    """Largest XOR population count of two odd sketches that sets of at least this similarity show, but for ``deviations`` standard deviations of MinHash; the bitmap's own noise is smaller and lies inside them."""
    low = max(0.0, similarity - deviations * math.sqrt(similarity * (1 - similarity) / SAMPLES))
    differing = 2 * SAMPLES * (1 - low)
    return math.ceil(BITS / 2 * (1 - math.exp(-2 * differing / BITS)))


def distance(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, BITS // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))


def sketches(docs: DataFrame, q: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: hash of the text, number of shingles, class (digest of the shingle set, null for an empty one), band keys and odd sketch."""
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("bands", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))])

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, cls, bands, odd = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set((text or "").encode(), q)
                    n.append(len(s))
                    if not len(s):
                        cls.append(None), bands.append(None), odd.append(None)
                        continue
                    cls.append(np.array([mix(s ^ U(11)).sum(), mix(s ^ U(13)).sum()]).tobytes())
                    low = minhash(s)
                    key = np.arange(BANDS, dtype=U) * U(0x2545F4914F6CDD1D)
                    for row in low.reshape(BANDS, ROWS).T:
                        key = mix(key ^ row)
                    bands.append(key.view(np.int64))
                    odd.append(odd_sketch(low))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), *(pa.array(x, f.type) for x, f in zip((cls, bands, odd), list(schema)[3:], strict=True))], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(text_col)).mapInArrow(rows, SKETCH)


def _by_differences(scratch: Scratch, group: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, buckets) that reach every link between two components of a group (leader, cls, score, comp), without holding all its members against each other.

    Let R be the elements that more than half of a group has, d_x the elements in only one of x and R, and m_x = (100 + percent) * |d_x| - (100 - percent) * |x|. Two members differ from each other in
    |d_a| + |d_b| - 2 * |d_a & d_b| elements, and are linked if (100 + percent) times that is at most (100 - percent) * (|a| + |b|), that is if m_a + m_b <= 2 * (100 + percent) * |d_a & d_b|.

    The member with the smallest m is the hub. A member with m + m_hub <= 0 is linked to it for certain: such pairs are returned. Members that then are in another component than the hub ask; let M be
    the smallest m among them. Every other link has an end that asks, so its ends share at least (m + M) / (2 * (100 + percent)) differences, and (m + m_hub) / (2 * (100 + percent)) for one that asks,
    for which also |d_x| - |x| * (100 - percent) / percent holds, since |d_b| >= |d_x| - (|x| + |b|) * (100 - percent) / (100 + percent) and |b| <= |x| * 100 / percent. Of t shared elements at least one is among
    the first |d| - t + 1 of each end in any common order; and if the first that they share has ``rest`` elements of an end from there on, they share at most ``rest``. Here what R lacks comes first, being rare, then what R lacks but an eighth of the group has, then what only R has.

    Buckets are (bucket, size, cls, score, comp, asks, first, rest, m) for those first elements; ``first`` tells those that partners that ask need.
    """
    per = 100 + percent
    whole = scratch.write(group.join(sets.hint("shuffle_merge"), "cls").select("leader", "cls", "score", "comp", "shingles"))
    members = whole.groupBy("leader").agg(F.count("*").alias("members"))
    counts = whole.select("leader", F.explode("shingles").alias("element")).groupBy("leader", "element").agg(F.count("*").alias("n"))
    often = counts.where("n > 1").join(members.hint("shuffle_merge"), "leader").where("n * 8 >= members")
    often = often.groupBy("leader").agg(F.array_sort(F.collect_list(F.when(F.expr("n * 2 > members"), F.col("element")))).alias("origin"), F.collect_list(F.when(F.expr("n * 2 <= members"), F.col("element"))).alias("often"))
    none = F.array().cast("array<long>")
    known = whole.join(scratch.write(often).hint("shuffle_merge"), "leader", "left").withColumn("origin", F.coalesce("origin", none)).withColumn("often", F.coalesce("often", none))
    known = known.withColumn("added", F.array_except("shingles", "origin"))
    order = F.concat(F.array_except("added", "often"), F.array_intersect("added", "often"), F.array_except("origin", "shingles"))
    known = known.select("leader", "cls", "score", "comp", F.size("shingles").alias("own"), order.alias("elements"))
    known = scratch.write(known.withColumn("m", (F.size("elements") * per - F.col("own") * (100 - percent)).cast("long")))
    hubs = known.groupBy("leader").agg(F.min(F.struct("m", "cls", "comp")).alias("hub")).select("leader", "hub.cls", "hub.comp", "hub.m").toDF("leader", "hub", "hub_comp", "hub_m")
    hubs = scratch.write(hubs)
    apart = known.select("leader", "cls", "comp", "m").join(hubs.hint("shuffle_merge"), "leader").where("comp <> hub_comp")
    sure = scratch.write(apart.where("m + hub_m <= 0").select("cls", "hub"))
    least = apart.where("m + hub_m > 0").groupBy("leader").agg(F.min("m").alias("least_m"))
    rows = known.join(hubs.join(least.hint("shuffle_merge"), "leader").hint("shuffle_merge"), "leader").withColumn("asks", F.expr("comp <> hub_comp AND m + hub_m > 0"))
    far = F.greatest(F.lit(1), F.ceil((F.col("m") + F.col("least_m")) / (2 * per)))
    every = F.greatest(F.lit(1), F.ceil((F.col("m") + F.col("hub_m")) / (2 * per)), F.ceil((F.size("elements") * percent - F.col("own") * (100 - percent)) / percent))
    first = lambda shared: F.greatest(F.lit(0), F.size("elements") - shared + 1).cast("int")
    rows = rows.select("leader", "cls", "score", F.when(F.expr("m + hub_m > 0"), F.col("comp")).otherwise(F.col("hub_comp")).alias("comp"), "asks", first(F.greatest(far, F.when(F.col("asks"), every))).alias("far"), first(every).alias("any"), "m", "elements")
    cut = rows.withColumn("whole", F.size("elements")).withColumn("elements", F.slice("elements", F.lit(1), F.when(F.col("asks"), F.col("any")).otherwise(F.col("far"))))
    cut = cut.select("leader", "cls", "score", "comp", "asks", "far", "m", "whole", F.posexplode("elements").alias("place", "element"))
    buckets = scratch.write(_met(cut.select(F.xxhash64("leader", "element").alias("bucket"), "cls", "score", "comp", "asks", (F.col("place") < F.col("far")).alias("first"), (F.col("whole") - F.col("place")).alias("rest"), "m")))
    scratch.drop(whole, known, hubs)
    return sure, buckets


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, small: int = 8, dense: int = 512, rounds: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of each document under: 100 * shared shingles >= ``percent`` * all shingles of the two.

    Returns (id, text_hash, n_shingles, cls, comp, component_id): the component is named by its smallest id, and ``comp`` tells it even where all ids are null; it is null for empty sets. A class ``cls`` is all documents of one shingle set, null for an empty one; one
    of them stands for all, so copies are never paired. Classes that share one of ``BANDS`` keys of ``ROWS`` MinHash values are candidates: a pair at the threshold 0.8
    is missed with probability 3e-6.

    A band's bucket is never searched by all its pairs, unless it has at most ``small`` members. Its members are held against one leader, the class
    that meets most others and so the likely origin of a group of copies. Pairs already in one component or too far apart by length or odd sketch are dropped, the others
    are confirmed on their full sets. Members that then still lie in several components are dealt into new buckets by (leader, element) for the first of their
    differences from what the group has in common (``_by_differences``), so that unrelated edits of one origin don't meet. There, only members outside the main component are held against others; a bucket
    of more than ``dense`` members is led and dealt again, and searched whole if it still is one after ``rounds`` rounds.

    Null and empty texts have 0 shingles, are linked with nothing and are their own component, as are rows with a null id and no words. Null ids count as members
    but never name a component with other ids. Texts with fewer words than ``shingle`` are one shingle. Repeated rows are copies. No rows give no rows. Clashing column names don't matter: only two columns are read.
    """
    scratch = Scratch(docs.sparkSession)
    all_rows = scratch.write(sketches(docs, shingle, id_col, text_col))
    # one row a class; the document that stands for it is found again by id and text
    classes = all_rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("low"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    classes = scratch.write(classes)
    members = scratch.write(_met(classes.select("cls", F.explode("bands").alias("bucket"))))
    # a class that meets many others in its buckets is likely the one that they were copied from: it leads
    scores = scratch.write(members.groupBy("cls").agg(F.sum("size").alias("score")))
    involved = scores.select("cls")
    features = scratch.write(classes.select("cls", "low", "n", "odd").join(involved.hint("shuffle_merge"), "cls"))
    # the texts of the classes in question; a null id is no key, so such classes give all their texts and one is kept
    want = features.select(F.coalesce(F.col("low"), F.lit(0)).alias("low"), F.col("low").isNull().alias("none"), "cls")
    found = all_rows.select(F.coalesce("id", F.lit(0)).alias("low"), F.col("id").isNull().alias("none"), "cls").join(want.hint("shuffle_merge"), ["low", "none", "cls"], "left_semi").distinct()
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("low"), F.col(id_col).isNull().alias("none"), F.col(text_col).alias("text"))
    texts = base.join(found.select("low", "none").distinct().hint("shuffle_merge"), ["low", "none"], "left_semi")
    sets = scratch.write(_sets_of(texts, shingle).join(involved.hint("shuffle_merge"), "cls", "left_semi").dropDuplicates(["cls"]))
    far = max_distance(percent / 100)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The links among candidate pairs (a, b): by length and odd sketch first, then on the full sets."""
        fa = features.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa"))
        fb = features.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob"))
        near = pairs.join(fa.hint("shuffle_merge"), "a").join(fb.hint("shuffle_merge"), "b")
        near = near.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (distance(F.col("oa"), F.col("ob")) <= far)).select("a", "b", "na", "nb")
        sa = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
        sb = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
        both = near.join(sa.hint("shuffle_merge"), "a").join(sb.hint("shuffle_merge"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        return both.where(F.col("common") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")

    labels = scores.select("cls", "score", F.col("cls").alias("comp"))
    open_ = members.join(labels.hint("shuffle_merge"), "cls").select("bucket", "size", "cls", "score", "comp", F.lit(True).alias("asks"), F.lit(True).alias("first"), F.lit(0).alias("rest"), F.lit(0).cast("long").alias("m"))
    open_ = scratch.write(open_)
    scratch.drop(members)
    sure = open_.sparkSession.createDataFrame([], "a binary, b binary")
    for done in itertools.count():
        # a bucket with more members is led by one, a smaller one is searched whole
        limit = small if not done else dense if done < rounds else 1 << 62
        leaders = open_.where(F.col("size") > limit).groupBy("bucket").agg(F.max(F.struct("score", "cls", "comp")).alias("top"))
        leaders = leaders.select("bucket", F.col("top.cls").alias("leader"), F.col("top.comp").alias("leader_comp"))
        led = scratch.write(open_.join(leaders.hint("shuffle_merge"), "bucket").where("cls <> leader").select("bucket", "cls", "leader", (F.col("comp") != F.col("leader_comp")).alias("apart")))
        few = open_.where(F.col("size") <= limit)
        x = few.where("asks").select("bucket", F.col("cls").alias("a"), F.col("comp").alias("a_comp"), F.col("first").alias("a_first"), F.col("rest").alias("a_rest"), F.col("m").alias("a_m"))
        y = few.where("first").select("bucket", F.col("cls").alias("b"), F.col("comp").alias("b_comp"), F.col("asks").alias("b_asks"), F.col("rest").alias("b_rest"), F.col("m").alias("b_m"))
        reach = F.least("a_rest", "b_rest") * (2 * (100 + percent)) >= F.col("a_m") + F.col("b_m")  # 0 >= 0 in a band
        pairs = x.join(y.hint("shuffle_merge"), "bucket").where(F.expr("a_comp <> b_comp AND (NOT b_asks OR a_first AND a < b)") & reach).select("a", "b")
        pairs = pairs.union(led.where("apart").select("cls", "leader"))
        links = scratch.write(confirmed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
        labels = _joined(scratch, labels, links.union(sure))
        scratch.drop(links, open_, sure)
        # a leader has met its whole bucket; a bucket whose others lie in one component is settled
        comp = labels.select("cls", "score", "comp")
        rest = scratch.write(led.select("bucket", "cls", "leader").join(comp.hint("shuffle_merge"), "cls"))
        mixed = rest.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
        group = scratch.write(rest.join(mixed.hint("shuffle_merge"), "bucket", "left_semi").select("leader", "cls", "score", "comp").distinct())
        scratch.drop(led, rest)
        if group.isEmpty():
            break
        sure, open_ = _by_differences(scratch, group, sets, percent)
        scratch.drop(group)
    scratch.drop(sets, features, scores, group)
    named = classes.select("cls", "low").join(labels.select("cls", "comp").hint("shuffle_merge"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    lowest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = scratch.write(named.join(lowest.hint("shuffle_merge"), "comp").select("cls", "comp", "component_id"))
    scratch.keep_only(all_rows, named)
    narrow = all_rows.select("id", "text_hash", "n_shingles", "cls")
    with_words = narrow.where("cls IS NOT NULL").join(named.hint("shuffle_merge"), "cls").select(*narrow.columns, "comp", "component_id")
    return with_words.unionByName(narrow.where("cls IS NULL").select("*", F.lit(None).cast("binary").alias("comp"), F.col("id").alias("component_id")))


def _met(rows: DataFrame) -> DataFrame:
    """Rows of (bucket, cls, ...) whose bucket has others, with its ``size``; of a bucket whose members have ``comp``, only if they lie in several."""
    several = [F.min("comp").alias("x"), F.max("comp").alias("y")] if "comp" in rows.columns else []
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size"), *several).where("size > 1" + (" AND x <> y" if several else ""))
    return rows.join(shared.select("bucket", "size").hint("shuffle_merge"), "bucket")


def _joined(scratch: Scratch, labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (cls, score, comp) after the components that ``links`` (a, b) join became one; only ends of links take part in the search."""
    comp = labels.select("cls", "comp")
    ends = links.join(comp.select(F.col("cls").alias("a"), F.col("comp").alias("src")).hint("shuffle_merge"), "a").join(comp.select(F.col("cls").alias("b"), F.col("comp").alias("dst")).hint("shuffle_merge"), "b")
    ends = scratch.write(ends.where("src <> dst").select("src", "dst").distinct())
    found = connected_components(ends)
    new = labels.join(found.select(F.col("node").alias("comp"), "component").hint("shuffle_merge"), "comp", "left")
    new = scratch.write(new.select("cls", "score", F.coalesce("component", "comp").alias("comp")))
    scratch.drop(ends, labels)
    return new


def _sets_of(texts: DataFrame, q: int) -> DataFrame:
    """(cls, shingles) of the texts, the class computed as in ``sketches``."""
    schema = pa.schema([("cls", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def rows(batches):
        for batch in batches:
            held, size = [], 0
            for text in batch.column(0):
                s = shingle_set((text.as_py() or "").encode(), q)
                if len(s):
                    held.append((np.array([mix(s ^ U(11)).sum(), mix(s ^ U(13)).sum()]).tobytes(), s.view(np.int64)))
                    size += len(s)
                if size > SEGMENT:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], f.type) for i, f in enumerate(schema)], schema=schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], f.type) for i, f in enumerate(schema)], schema=schema)

    return texts.select("text").mapInArrow(rows, "cls binary, shingles array<long>")


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
