"""Case-to-case similarity, and record linkage between entities."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from caseweave.functions import as_set, categorical_match, jaccard_of_sets, proximity, token_sort_ratio
from caseweave.operators.pairwise import Numbers, Sets, Values, judged_pairs
from caseweave.plans.blocks import all_blocks_met, dealt, pairs_within
from caseweave.plans.scratch import Scratch, numbered


def victim_similarity(a, b) -> Column:
    """Mean of age proximity over 50 years, gender, occupation (1 equal, .5 same first word, else 0) and risk; .5 where either side is missing, risk missing is low. ``a``, ``b``: column getters."""
    there = lambda c: c.isNotNull() & (c.cast("string") != "") & (c.cast("string") != "0")
    age = F.when(there(a("victim_age")) & there(b("victim_age")), proximity(a("victim_age"), b("victim_age"), 50)).otherwise(0.5)
    gender = F.when(there(a("victim_gender")) & there(b("victim_gender")), categorical_match(a("victim_gender"), b("victim_gender"))).otherwise(0.5)
    oa, ob = F.lower(a("victim_occupation")), F.lower(b("victim_occupation"))
    job = F.when(there(oa) & there(ob), F.when(oa == ob, 1.0).when(F.split(oa, r"\s+")[0] == F.split(ob, r"\s+")[0], 0.5).otherwise(0.0)).otherwise(0.5)
    risk = categorical_match(F.coalesce(a("victim_risk"), F.lit("low")), F.coalesce(b("victim_risk"), F.lit("low")))
    return (age + gender + job + risk) / 4


def method_similarity(a, b) -> Column:
    """Mean of approach, control and scene (missing compares as empty) and weapon (.5 when missing)."""
    same = lambda n: categorical_match(F.coalesce(a(n), F.lit("")), F.coalesce(b(n), F.lit("")))
    weapon = F.when((F.coalesce(a("weapon"), F.lit("")) != "") & (F.coalesce(b("weapon"), F.lit("")) != ""), categorical_match(a("weapon"), b("weapon"))).otherwise(0.5)
    return (same("approach") + same("control") + same("scene") + weapon) / 4


def signature_similarity(a, b) -> Column:
    """.7 Jaccard of the signature sets (see ``as_set``) + .3 proximity of the overkill scores over 10."""
    return 0.7 * jaccard_of_sets(a("signatures"), b("signatures")) + 0.3 * proximity(a("overkill"), b("overkill"), 10)


def composite(signature: Column, narrative: Column, victim: Column, method: Column) -> Column:
    """100 * (.40 signature + .25 narrative + .20 victim + .15 method) of the parts rounded to 4 digits, to 1 digit."""
    r = lambda c: F.round(c, 4)
    return F.round(100 * (0.40 * r(signature) + 0.25 * r(narrative) + 0.20 * r(victim) + 0.15 * r(method)), 1)


def case_links(cases: DataFrame, cosine: DataFrame | None = None, minimum: float = 60.0) -> DataFrame:
    """Pairs of cases with a composite score of at least ``minimum``: (case_a, case_b, score and its parts).

    Pairs are found without a triangle over all cases: without a common signature the parts reach at most 12 + 20 + 15, so above 47
    candidates share a signature or have a narrative cosine above (minimum - 47) / 25; up to 47 any cosine counts, and so do ``equal_attributes``.
    Those that share a signature are scored where they meet, and only what can reach ``minimum`` with a full cosine goes on. All are equi-joins. ``cosine``: (case_a, case_b, cosine), absent pairs 0; of pairs without a common signature those from (minimum - 47.05) / 25 are enough.
    """
    pairs = signature_candidates(cases, minimum)
    if cosine is not None:
        pairs = pairs.unionByName(cosine.where(F.col("cosine") >= (minimum - 47.05) / 25).select("case_a", "case_b"))
    if minimum <= 47.06:
        pairs = pairs.unionByName(equal_attributes(cases, minimum))
    scored = score_pairs(cases, pairs.distinct(), cosine)
    return scored.where(F.col("score") >= minimum)


def equal_attributes(cases: DataFrame, minimum: float) -> DataFrame:
    """Pairs of cases that can reach ``minimum`` with neither a common signature nor a narrative cosine: they agree in one of the smallest sets of attributes whose points are enough; all pairs where none are needed.

    Without an agreement there are at most 12 points of the overkill scores, 5 of the ages and half the points of weapon, gender and occupation.
    """
    filled = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
    known = lambda c: F.nullif(filled(c), F.lit(""))
    parts = {
        "approach": (3.75, filled("approach")), "control": (3.75, filled("control")), "scene": (3.75, filled("scene")), "weapon": (1.875, known("weapon")),
        "gender": (2.5, known("victim_gender")), "occupation": (2.5, known("victim_occupation")), "risk": (5.0, F.lower(F.coalesce("victim_risk", F.lit("low")))),
    }
    need = minimum - 0.06 - (12 + 5 + 1.875 + 2.5 + 2.5)
    points = lambda names: sum(parts[n][0] for n in names)
    sets = [c for k in range(len(parts) + 1) for c in combinations(parts, k) if points(c) >= need and all(points(c) - parts[n][0] < need for n in c)]
    keys = F.array(*[F.concat(F.lit(f"{i}"), *[F.concat(F.lit("|"), F.length(parts[n][1]).cast("string"), F.lit("|"), parts[n][1]) for n in c]) for i, c in enumerate(sets)])
    k = cases.select("case_id", F.explode(F.array_compact(keys)).alias("key"))
    return pairs_within(k, ["key"], "case_id").select(F.col("a").alias("case_a"), F.col("b").alias("case_b")).distinct()


def score_pairs(cases: DataFrame, pairs: DataFrame, cosine: DataFrame | None = None, digits: int = 4) -> DataFrame:
    """Composite score and its parts, rounded to ``digits``, of pairs (case_a, case_b)."""
    cases = cases.withColumn("signatures", as_set(F.col("signatures")))
    left, right = cases.select([F.col(c).alias(f"{c}_a") for c in cases.columns]), cases.select([F.col(c).alias(f"{c}_b") for c in cases.columns])
    j = pairs.join(left.hint("shuffle_merge"), F.col("case_a") == F.col("case_id_a")).join(right.hint("shuffle_merge"), F.col("case_b") == F.col("case_id_b"))
    if cosine is not None:
        j = j.join(cosine.hint("shuffle_merge"), ["case_a", "case_b"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    else:
        j = j.withColumn("cosine", F.lit(0.0))
    return _scores(j, digits)


def _scores(j: DataFrame, digits: int) -> DataFrame:
    a, b = (lambda n: F.col(f"{n}_a")), (lambda n: F.col(f"{n}_b"))
    return _rounded(j.withColumns({"signature": signature_similarity(a, b), "victim": victim_similarity(a, b), "method": method_similarity(a, b)}), digits)


def _rounded(j: DataFrame, digits: int) -> DataFrame:
    j = j.withColumns({c: F.round(c, digits) for c in ("signature", "victim", "method")})
    j = j.withColumn("score", composite(F.col("signature"), F.col("cosine"), F.col("victim"), F.col("method")))
    return j.select("case_a", "case_b", "score", "signature", "cosine", "victim", "method")


def _signature_judge(least: float | None):
    """Parts of pairs in arrays, as ``signature_similarity``, ``victim_similarity`` and ``method_similarity`` give them; with ``least`` only pairs whose points without the narrative reach it."""

    def judge(x: pa.StructArray, y: pa.StructArray):
        of = lambda kind, name: kind(x.field(name), y.field(name))
        sets, overkill, age = of(Sets, "signatures"), of(Numbers, "overkill"), of(Numbers, "age")
        gender, job, word, risk, weapon, *same = (of(Values, c) for c in ("gender", "job", "word", "risk", "weapon", "approach", "control", "scene"))

        def scores(lo: int, hi: int):
            signature = 0.7 * sets.jaccard(lo, hi) + 0.3 * overkill.near(lo, hi, 10)
            jobs = np.where(job.equal(lo, hi), 1.0, 0.5 * word.equal(lo, hi))
            known = lambda values, alike: np.where(values.known(lo, hi), alike, 0.5)
            victim = (known(age, age.near(lo, hi, 50)) + known(gender, gender.equal(lo, hi)) + known(job, jobs) + risk.equal(lo, hi)) / 4
            method = (sum(v.equal(lo, hi).astype(float) for v in same) + known(weapon, weapon.equal(lo, hi))) / 4
            kept = None if least is None else 100 * (0.40 * signature + 0.20 * victim + 0.15 * method) >= least
            return kept, [signature, victim, method]

        return scores

    return judge


def signature_parts(cases: DataFrame, least: float | None = None) -> DataFrame:
    """(case_a, case_b, signature, victim, method), not rounded, of all pairs of cases with a common signature, or of those with at least ``least`` points without the narrative.

    Each pair is judged at its least common signature, in arrays of a block of cases by a block, so pairs are not shuffled and only those that stay leave their task.
    """
    text = lambda c: F.col(c).cast("string")
    there = lambda c: F.when((c != "") & (c != "0"), c)
    job = there(F.lower(text("victim_occupation")))
    sides = cases.select(
        "case_id", as_set(F.col("signatures")).alias("signatures"), F.col("overkill").cast("double").alias("overkill"), F.when(there(text("victim_age")).isNotNull(), F.col("victim_age").cast("double")).alias("age"), there(text("victim_gender")).alias("gender"),
        job.alias("job"), F.split(job, r"\s+")[0].alias("word"), F.coalesce(text("victim_risk"), F.lit("low")).alias("risk"), F.nullif(text("weapon"), F.lit("")).alias("weapon"), *[F.coalesce(text(c), F.lit("")).alias(c) for c in ("approach", "control", "scene")],
    )
    found = judged_pairs(sides, "signatures", "case_id", [c for c in sides.columns if c != "case_id"], _signature_judge(least), ["signature", "victim", "method"])
    return found.withColumnsRenamed({"a": "case_a", "b": "case_b"})


def score_signature_pairs(cases: DataFrame, digits: int = 4) -> DataFrame:
    """``score_pairs`` of all pairs of cases with a common signature, with no cosine."""
    return _rounded(signature_parts(cases).withColumn("cosine", F.lit(0.0)), digits)


def signature_candidates(cases: DataFrame, minimum: float) -> DataFrame:
    """Pairs of cases with a common signature that reach ``minimum`` if their narratives are equal: (case_a, case_b)."""
    least = minimum - 0.06 - 25
    parts = 100 * (0.40 * F.col("signature") + 0.20 * F.col("victim") + 0.15 * F.col("method"))
    near = signature_parts(cases, least - 0.01).withColumn("cosine", F.lit(0.0))  # rounding moves a score by less
    return _rounded(near, 4).where(parts >= least).select("case_a", "case_b")


#: Terms whose counts a task holds before it hands them on.
HELD_TERMS = 200_000
_WORDS = re.compile(r"\w\w+", re.ASCII)


def _terms(low: str | None, stop_words: frozenset[str]) -> list[str]:
    """Words of two or more letters of a lower-case text, without stop words, and their bigrams."""
    words = [w for w in _WORDS.findall(low or "") if w not in stop_words]
    return words + [f"{x} {y}" for x, y in zip(words, words[1:])]


def tf_idf(docs: DataFrame, stop_words: list[str], max_terms: int = 5000) -> DataFrame:
    """(doc_id, term, weight): words of two or more letters without stop words and their bigrams, the ``max_terms`` most frequent terms, 1 + ln tf, ln((1 + n) / (1 + df)) + 1, unit length.

    Texts are dealt over many tasks and read twice: tasks count all terms, of which only counts are shuffled, then the kept ones of each text, which stay one row.
    """
    spark = docs.sparkSession
    scratch, stop = Scratch(spark), frozenset(stop_words)
    texts = dealt(docs.select("doc_id", F.lower("text").alias("low")), "doc_id", tasks_per_core=4)

    def counted(batches):
        held = Counter()
        hand_on = lambda: pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "n"])
        for batch in batches:
            for low in batch.column(0).to_pylist():
                held.update(_terms(low, stop))
                if len(held) >= HELD_TERMS:
                    yield hand_on()
                    held.clear()
        yield hand_on()

    counts = texts.select("low").mapInArrow(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("cf"))
    kept = [r.term for r in counts.orderBy(F.col("cf").desc(), "term").limit(max_terms).select("term").collect()]  # max_terms rows at most
    code = {t: i for i, t in enumerate(kept)}

    def of_each(batches):
        for batch in batches:
            found = [Counter(code[t] for t in _terms(low, stop) if t in code) for low in batch.column(1).to_pylist()]
            lists = [pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "codes", "tf"])

    kind = docs.schema["doc_id"].dataType
    row = StructType([StructField("doc_id", kind), StructField("codes", ArrayType(IntegerType())), StructField("tf", ArrayType(LongType()))])
    tf = scratch.write(texts.mapInArrow(of_each, row))
    n = tf.count()
    if not tf.groupBy("doc_id").count().where("count > 1").isEmpty():  # texts of one id are one document
        once = tf.select("doc_id", F.explode(F.arrays_zip("codes", "tf")).alias("t")).groupBy("doc_id", "t.codes").agg(F.sum("t.tf").alias("tf"))
        tf, parts = scratch.write(once.groupBy("doc_id").agg(F.collect_list(F.struct("codes", "tf")).alias("t")).select("doc_id", "t.codes", "t.tf")), tf
        scratch.drop(parts)
    df = np.zeros(len(kept))
    for r in tf.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # max_terms rows at most
        df[r.code] = r["count"]
    idf = np.log((1 + n) / (1 + df)) + 1
    terms = pa.array(kept, pa.string())

    def weighed(batches):
        for batch in batches:
            rows, codes, tf = _entries(batch, "codes", "tf")
            x = (1 + np.log(tf)) * idf[codes]
            norm = np.sqrt(np.bincount(rows, x * x, minlength=batch.num_rows))
            for lo in range(0, len(rows), 100_000):
                part = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[part])), terms.take(pa.array(codes[part])), pa.array(x[part] / norm[rows[part]])], ["doc_id", "term", "weight"])

    return tf.mapInArrow(weighed, StructType([StructField("doc_id", kind), StructField("term", StringType()), StructField("weight", DoubleType())]))


def cosine_pairs(vectors: DataFrame, minimum: float = 0.0) -> DataFrame:
    """(case_a, case_b, cosine) of pairs of unit vectors with a common term and a cosine of at least ``minimum``, 4 digits.

    Above 0 blocks of vectors meet and are multiplied as matrices, so only pairs that reach ``minimum`` leave their task.
    """
    least = minimum - 0.00006
    if least <= 0:
        return _dots(vectors).where(F.col("cosine") >= minimum)
    found = all_blocks_met(_coded(vectors), "doc_id", ["codes", "weights"]).mapInArrow(lambda batches: _block_cosines(batches, least), _cosine_schema(vectors))
    return found.withColumn("cosine", F.round("cosine", 4)).where(F.col("cosine") >= minimum)


def _dots(vectors: DataFrame) -> DataFrame:
    """(case_a, case_b, cosine) of all pairs that have a common term."""
    x = vectors.select(F.col("doc_id").alias("case_a"), "term", F.col("weight").alias("wa"))
    y = vectors.select(F.col("doc_id").alias("case_b"), "term", F.col("weight").alias("wb"))
    met = x.join(y.hint("shuffle_merge"), "term").where("case_a < case_b")
    return met.groupBy("case_a", "case_b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 4).alias("cosine"))


def _coded(vectors: DataFrame) -> DataFrame:
    """(doc_id, codes, weights): a row a vector, its terms as numbers; written to the shared folder."""
    scratch = Scratch(vectors.sparkSession)
    codes = scratch.write(numbered(vectors.select(F.col("term").alias("node")).distinct()).withColumnRenamed("node", "term"))
    rows = vectors.join(codes.hint("shuffle_merge"), "term").groupBy("doc_id").agg(F.collect_list(F.struct("place", "weight")).alias("t"))
    out = scratch.write(rows.select("doc_id", F.col("t.place").alias("codes"), F.col("t.weight").alias("weights")))
    scratch.drop(codes)
    return out


def _cosine_schema(vectors: DataFrame) -> StructType:
    kind = vectors.schema["doc_id"].dataType
    return StructType([StructField("case_a", kind), StructField("case_b", kind), StructField("cosine", DoubleType())])


def _entries(rows: pa.StructArray | pa.RecordBatch, codes: str, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and weight of all terms of vectors."""
    lists, w = (rows.field(c) if isinstance(rows, pa.StructArray) else rows.column(c) for c in (codes, weights))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(), w.flatten().to_numpy()


def _block_cosines(batches, least: float, terms_at_once: int = 2_048):
    """Pairs of two blocks' vectors with a cosine of at least ``least``: products of matrices over the terms that both blocks have, some terms at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            x, y = batch.column("x")[k].values, batch.column("y")[k].values
            same = not len(y)
            y = x if same else y
            sides = [_entries(side, "codes", "weights") for side in (x, y)]
            shared = np.intersect1d(sides[0][1], sides[1][1])
            cosine = np.zeros((len(x), len(y)))
            for at in range(0, len(shared), terms_at_once):
                some = shared[at : at + terms_at_once]
                parts = []
                for (rows, codes, weights), n in zip(sides, cosine.shape):
                    place = np.minimum(np.searchsorted(some, codes), len(some) - 1)
                    have = some[place] == codes
                    part = np.zeros((n, len(some)))
                    part[rows[have], place[have]] = weights[have]
                    parts.append(part)
                cosine += parts[0] @ parts[1].T
            ids = pa.concat_arrays([x.field("m"), y.field("m")])
            rank = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            kept = cosine >= least
            if same:
                kept &= rank[: len(x), None] < rank[len(x) :]
            rows, others = np.nonzero(kept)
            for lo in range(0, len(rows), 100_000):
                i, j = rows[lo : lo + 100_000], others[lo : lo + 100_000]
                first = rank[i] < rank[len(x) + j]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.where(first, i, len(x) + j))), ids.take(pa.array(np.where(first, len(x) + j, i))), pa.array(cosine[i, j])], ["case_a", "case_b", "cosine"])


def _pair_cosines(batches):
    """The cosine of each pair (case_a, case_b) that brings both vectors."""
    for batch in batches:
        (ra, ca, wa), (rb, cb, wb) = _entries(batch, "codes_a", "weights_a"), _entries(batch, "codes_b", "weights_b")
        width = max(ca.max(initial=0), cb.max(initial=0)) + 1
        _, i, j = np.intersect1d(ra.astype(np.int64) * width + ca, rb.astype(np.int64) * width + cb, assume_unique=True, return_indices=True)
        yield pa.RecordBatch.from_arrays([batch.column("case_a"), batch.column("case_b"), pa.array(np.bincount(ra[i], wa[i] * wb[j], minlength=batch.num_rows).astype(float))], ["case_a", "case_b", "cosine"])


def narrative_cosines(cases: DataFrame, vectors: DataFrame, minimum: float = 60.0) -> DataFrame:
    """The cosines that ``case_links`` needs for ``minimum``: those of ``signature_candidates`` that both have a vector, and of all others from (minimum - 47.05) / 25."""
    coded = _coded(vectors)
    side = lambda end: coded.select(F.col("doc_id").alias(f"case_{end}"), F.col("codes").alias(f"codes_{end}"), F.col("weights").alias(f"weights_{end}")).hint("shuffle_merge")
    told = coded.select("doc_id")
    pairs = signature_candidates(cases, minimum)
    for end in ("case_a", "case_b"):
        pairs = pairs.join(told.withColumnRenamed("doc_id", end).hint("shuffle_merge"), end, "left_semi")
    pairs = pairs.select("case_a", "case_b").join(side("a"), "case_a").join(side("b"), "case_b")
    shared = pairs.mapInArrow(_pair_cosines, _cosine_schema(vectors)).withColumn("cosine", F.round("cosine", 4)).where("cosine > 0")
    both = shared.unionByName(cosine_pairs(vectors, max(0.0, (minimum - 47.05) / 25)))
    return both.groupBy("case_a", "case_b").agg(F.max("cosine").alias("cosine"))


def candidate_matches(entities: DataFrame, minimum: float = 0.6, limit: int = 10) -> DataFrame:
    """Pairs of live entities of a type with alike names, blocked on common name tokens: (id_a, id_b, similarity, rank), the best ``limit`` of each entity on either side; rank is the better of the two.

    Names of one word match nothing but themselves partly: two of them 0, one inside the other name .3.
    """
    e = entities.where("merged_into IS NULL").select("entity_id", "entity_type", F.lower(F.trim("name")).alias("name"))
    t = e.withColumn("token", F.explode(F.array_distinct(F.split("name", r"\s+"))))
    pairs = t.alias("x").join(t.alias("y").hint("shuffle_merge"), ["entity_type", "token"]).where("x.entity_id < y.entity_id").select(F.col("x.entity_id").alias("id_a"), F.col("y.entity_id").alias("id_b"), F.col("x.name").alias("na"), F.col("y.name").alias("nb")).distinct()
    one_a, one_b = F.size(F.split("na", r"\s+")) == 1, F.size(F.split("nb", r"\s+")) == 1
    sim = F.when(one_a & one_b, 0.0).when(one_a | one_b, 0.3).otherwise(token_sort_ratio(F.col("na"), F.col("nb")))
    scored = pairs.withColumn("similarity", F.round(sim, 4)).where(F.col("similarity") >= minimum)
    ends = scored.select(F.col("id_a").alias("id"), F.col("id_b").alias("other"), "similarity").unionByName(scored.select(F.col("id_b").alias("id"), F.col("id_a").alias("other"), "similarity"))
    order = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "other")
    best = ends.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.groupBy(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), "similarity").agg(F.min("rank").alias("rank"))


def recommendation(signals: Column, partial: Column) -> Column:
    """Partial names: review from two signals, else no. Full names: auto from two, review with one, else no."""
    return F.when(partial, F.when(signals >= 2, "review").otherwise("no")).when(signals >= 2, "auto").when(signals == 1, "review").otherwise("no")
