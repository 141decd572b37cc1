"""Language identification: text likelihoods fused with declared language, address suffix and smoothed host priors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from caseweave.plans.scratch import Scratch

BUCKETS = 1 << 14
#: Overlapping trigrams say the same thing about three times.
TEMPER = 1 / 3
MOST_LANGUAGES = 64
#: Rows of a lookup table up to which it is broadcast; larger ones are met over ``SALTS`` tasks a key.
BROADCAST_ROWS, SALTS = 20_000, 16


def trigram_buckets(text: str) -> np.ndarray:
    """Hash bucket of each byte trigram of the lowered text, white space as single blanks."""
    data = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-8", "ignore"), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    h = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA6B) + data[2:] * np.uint32(0xC2B2AE35)
    return ((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int64)


def declared_languages(rows: DataFrame, most: int = MOST_LANGUAGES, least_share: float = 0.001) -> list[str]:
    """The declared values that at least ``least_share`` of the declaring rows have, the ``most`` frequent at most, in the order of their names."""
    counts = rows.where("declared IS NOT NULL").groupBy("declared").agg(F.count("*").alias("n"))
    counts = Scratch(rows.sparkSession).write(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") >= total * least_share).orderBy(F.col("n").desc(), "declared").limit(most)
    return sorted(r["declared"] for r in often.collect())


def training(rows: DataFrame, share: int = 5) -> DataFrame:
    """The rows that likelihoods are learnt from: those whose id's hash is not divisible by ``share``. The others are held out, so that accuracy on them is honest."""
    return rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) != 0)


def train(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Log probabilities (languages x BUCKETS) of trigram buckets from all given texts that declare one of the languages.

    Each task counts its texts; the sums are ``len(languages) * BUCKETS`` numbers, whatever the corpus.
    """
    number = {name: k for k, name in enumerate(languages)}

    def counted(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for text, declared in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if declared in number and text.is_valid:
                    total[number[declared]] += np.bincount(trigram_buckets(text.as_py()), minlength=BUCKETS)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[k, b])], ["k", "b", "n"])

    sums = rows.select("text", "declared").mapInArrow(counted, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(languages), BUCKETS), 0.5)
    counts[sums["k"], sums["b"]] += sums["n"]
    return np.log(counts / counts.sum(axis=1, keepdims=True))


_EVIDENCE = ["declared", "suffix", "domain", "host"]


def text_scores(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """id and the evidence columns with ``ll`` (tempered log likelihood per language), ``letters`` (whether the text has any), and of the trigrams of the text's words of letters under its best language ``tri`` (their number), ``fit`` (mean log likelihood) and ``spread`` (variance)."""
    names = ["id", *_EVIDENCE]

    def scored(batches):
        for batch in batches:
            ll, letters, tri, fit, spread = [], [], [], [], []
            for text in batch.column(0):
                raw = text.as_py() or ""
                b = trigram_buckets(raw)
                each = model[:, b]
                total = each.sum(axis=1) if len(b) else np.zeros(len(model))
                # addresses, numbers and keys say nothing about how the language's words look
                words = trigram_buckets(" ".join(w for w in raw.split() if w.strip(".,;:!?()'\"").isalpha()))
                best = model[int(total.argmax()), words] if len(words) else np.zeros(1)
                ll.append(TEMPER * total), letters.append(any(c.isalpha() for c in raw))
                tri.append(len(words)), fit.append(float(best.mean())), spread.append(float(best.var()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ll, pa.list_(pa.float64())), pa.array(letters), pa.array(tri, pa.int64()), pa.array(fit), pa.array(spread)], [*names, "ll", "letters", "tri", "fit", "spread"])

    carried = rows.select("id", *_EVIDENCE).schema.fields
    extra = [StructField("ll", ArrayType(DoubleType())), StructField("letters", BooleanType()), StructField("tri", LongType()), StructField("fit", DoubleType()), StructField("spread", DoubleType())]
    return rows.select("text", *names).mapInArrow(scored, StructType([*carried, *extra]))


def _counts(n: int) -> Column:
    return F.array(*[F.count_if(F.col("best") == k).cast("double") for k in range(n)])


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a written table of one row a key: broadcast if that is small, else dealt by key and salt, so that no key's rows land in one task."""
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys, "left")
    many = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).join(many.hint("shuffle_merge"), [*keys, "salt"], "left").drop("salt")


def identify(rows: DataFrame, *, languages: list[str] | None = None, strength: float = 5.0, min_posterior: float = 0.5, deviations: float = 12.0) -> DataFrame:
    """Language of each row of (id, text, declared, suffix, domain, host): id, the evidence columns, lang, posterior and accepted.

    The languages are the given ones or else ``declared_languages``. Evidence multiplies: tempered trigram likelihoods, learnt from the ``training`` rows; P(declared | language) and P(suffix | language)
    from counts of what rows of each text-decided language declare; and a host prior, smoothed to its domain's, smoothed to the global one, ``strength`` pseudo-counts each. All counts are grouped
    aggregations over all rows. A row without letters has no language (lang ``und``) and is not accepted; nor is one whose best posterior is below ``min_posterior``, nor one whose trigrams are
    likely under none of the languages: in words of letters only, their mean log likelihood is more than ``deviations`` standard deviations (of texts of that language and of trigrams in a text) below the language's mean.
    Null declared, suffix, domain and host values are values of their own kind without evidence (declared, suffix) or as one host. Repeated rows each count. No rows, or none that declares a language,
    give ``und`` for all. Columns beyond the six are not read.
    """
    scratch = Scratch(rows.sparkSession)
    languages = declared_languages(rows) if languages is None else list(languages)
    if not languages:
        return rows.select("id", *_EVIDENCE, F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    n = len(languages)
    scored = text_scores(rows, train(training(rows), languages))
    best = F.array_position("ll", F.array_max("ll")) - 1
    scored = scratch.write(scored.withColumn("best", F.when(F.col("letters"), best)).withColumn("domain", F.coalesce("domain", F.lit(""))).withColumn("host", F.coalesce("host", F.lit(""))))
    known = scored.where("best IS NOT NULL")
    whole = known.agg(_counts(n)).first()[0]
    total = sum(whole) + n
    prior = F.array(*[F.lit((c + 1) / total) for c in whole])
    share = lambda counts, base: F.transform(F.arrays_zip(counts.alias("c"), base.alias("p")), lambda z: (z["c"] + F.lit(strength) * z["p"]) / (F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + F.lit(strength)))
    domains = scratch.write(known.groupBy("domain").agg(_counts(n).alias("c")).select("domain", share(F.col("c"), prior).alias("p")))
    hosts = known.groupBy("domain", "host").agg(_counts(n).alias("c"), F.min("id").alias("id"))
    hosts = scratch.write(looked_up(hosts, domains, ["domain"]).select("domain", "host", share(F.col("c"), F.col("p")).alias("host_prior")))
    evidence = scored
    for name in ("declared", "suffix"):
        table = known.where(F.col(name).isNotNull()).groupBy(name).agg(_counts(n).alias("c"))
        size = F.array(*[F.lit(c + n) for c in whole])
        table = scratch.write(table.select(name, F.zip_with("c", size, lambda c, s: F.log((c + 1) / s)).alias(f"{name}_ll")))
        evidence = looked_up(evidence, table, [name])
    evidence = looked_up(evidence, hosts, ["domain", "host"])
    # how likely a language's own texts are, a row a language
    usual = {r["best"]: r for r in known.where("tri > 0").groupBy("best").agg(F.avg("fit").alias("mean"), F.coalesce(F.var_pop("fit"), F.lit(0.0)).alias("between"), F.avg("spread").alias("within")).collect()}
    at = lambda name: F.element_at(F.array(*[F.lit(float(usual[k][name]) if k in usual else 0.0) for k in range(n)]), (F.col("best") + 1).cast("int"))
    lowest = at("mean") - F.lit(deviations) * F.sqrt(at("between") + at("within") / TEMPER / F.greatest(F.lit(1), F.col("tri")))
    none = F.array(*[F.lit(0.0)] * n)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(add(F.col("ll"), F.coalesce("declared_ll", none)), add(F.coalesce("suffix_ll", none), F.transform(F.coalesce("host_prior", prior), lambda p: F.log(p))))
    out = evidence.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    posterior = 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(x) for x in languages])
    lang = F.when(F.col("letters"), F.element_at(names, F.array_position("logs", F.col("top")).cast("int"))).otherwise("und")
    out = out.withColumn("posterior", F.when(F.col("letters"), posterior).otherwise(0.0)).withColumn("lang", lang)
    accepted = F.col("letters") & (F.col("posterior") >= min_posterior) & ((F.col("tri") == 0) | (F.col("fit") >= lowest))
    return out.select("id", *_EVIDENCE, "lang", "posterior", accepted.alias("accepted"))


def document_evidence(docs: DataFrame, id_column: Column | None = None) -> DataFrame:
    """Evidence rows of ``documents``: the lang column is the declared language, the source the host; documents have no address."""
    none = F.lit(None).cast("string")
    return docs.select((F.col("doc_id").cast("long") if id_column is None else id_column).alias("id"), F.col("text"), F.lower("lang").alias("declared"), none.alias("suffix"), none.alias("domain"), F.col("source").alias("host"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Evidence rows of ``pages``: declared in the html tag, suffix and host from the address; the text is the html without tags."""
    from caseweave.llm.urlrules import host_of

    text = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    declared = F.nullif(F.lower(F.regexp_extract("html", r"""(?i)<html[^>]*?\blang=["']?([a-z]{2})""", 1)), F.lit(""))
    host = host_of(F.col("url"))
    labels = F.split(host, r"\.")
    last_two = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".")
    suffix = F.nullif(F.element_at(labels, -1), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("id"), text.alias("text"), declared.alias("declared"), suffix.alias("suffix"), last_two.alias("domain"), host.alias("host"))


def op7_language(spark, sf_dir: str) -> DataFrame:
    found = identify(document_evidence(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select(F.col("id").alias("doc_id"), "lang", "posterior", "accepted")


def language_of_pages(spark, sf_dir: str) -> DataFrame:
    found = identify(page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.select(F.col("id").alias("page_id"), "host", "declared", "lang", "posterior", "accepted")
