"""URL filters: host and path rules, and association rules mined from labelled URLs by FP-growth.

DataFrame and SQL functions only.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.plans.scratch import Scratch

#: Tables of up to so many rows are broadcast after a count; beyond, hot keys are dealt over so many salts.
FEW, SALTS = 50_000, 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path prefix)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null and for no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null and for no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule whose host is the URL's or a parent of it and whose path starts the URL's; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: host labels with their place from the right, path segments (digits as ``0``), query keys and scheme.

    A null URL, or one without ``://``, has no tokens.
    """
    labels = F.reverse(F.split(host, r"\."))
    host_tokens = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    segments = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "0"), "/"), lambda x: x != "")
    path_tokens = F.transform(segments, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), x))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^([^=]*)", 1)))
    scheme = F.array(F.concat(F.lit("s:"), F.regexp_extract(url, "(?s)^(.*?)://", 1)))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(scheme, host_tokens, path_tokens, keys)))


def _attach(rows: DataFrame, table: DataFrame, key: str, spread: Column) -> DataFrame:
    """``rows`` joined with a written ``table`` on ``key``: broadcast while its counted rows are few, else with the keys dealt over ``SALTS`` by ``spread``."""
    if table.limit(FEW + 1).count() <= FEW:
        return rows.join(table.hint("broadcast"), key)
    salted = table.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_merge"), [key, "salt"]).drop("salt")


def mine_rules(labelled: DataFrame, *, min_support: float = 0.01, min_confidence: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Rules (items array, verdict, confidence, support, key) and the items of tokens (token, item), from rows of (tokens, verdict).

    FP-growth over the URLs' items with the verdict as one more item; kept are the rules that conclude a verdict with at least ``min_confidence``
    and ``min_support``, unless a rule with fewer items and the same verdict, all of them in this one, is as sure. ``key`` is the item of the
    rule that fewest URLs have: the entry of the inverted index.

    Tokens that stand in just the same labelled URLs are one item, told by count and two 64-bit hashes of the rows, so that n tokens that
    always come together give one itemset and not 2^n. A token all of whose URLs have one verdict is a rule by itself, which no longer rule
    can beat, and is left out of the mining. Both leave the matches as they are. Mixed tokens that come together often, not always, still give
    an itemset for each combination with enough support. Null verdicts don't teach. No labelled rows give no rules.
    """
    scratch = Scratch(labelled.sparkSession)
    rows = scratch.write(labelled.where("verdict IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), "tokens", "verdict"))
    n = rows.count()
    counts = rows.select("row", "verdict", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("freq"), F.min("verdict").alias("low"), F.max("verdict").alias("high"), F.bit_xor(F.xxhash64("row")).alias("x1"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("x2")
    )
    often = scratch.write(counts.where(F.col("freq") >= math.ceil(min_support * n)))
    firsts = often.groupBy("freq", "x1", "x2").agg(F.min("token").alias("item"))
    items = often.join(firsts.hint("shuffle_hash"), ["freq", "x1", "x2"])
    items = scratch.write(items.select("token", "item", "freq", F.when(F.col("low") == F.col("high"), F.col("low")).alias("verdict")))
    singles = items.where("token = item").select("item", "freq", "verdict")
    pure = singles.where("verdict IS NOT NULL").select(F.array("item").alias("items"), "verdict", F.lit(1.0).alias("confidence"), (F.col("freq") / n).alias("support"))

    mixed = scratch.write(items.where("verdict IS NULL AND token = item").select("token"))
    left = _attach(rows.select("row", F.explode("tokens").alias("token")), mixed, "token", F.col("row")).groupBy("row").agg(F.collect_list("token").alias("items"))
    baskets = rows.select("row", "verdict").join(left.hint("shuffle_merge"), "row", "left")
    baskets = scratch.write(baskets.select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where("consequent[0] LIKE 'verdict=%' AND NOT exists(antecedent, x -> x LIKE 'verdict=%')")
    rules = rules.select(F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], 9, 99).alias("verdict"), "confidence", "support")
    rules = scratch.write(rules.unionByName(pure))
    # shorter rules that are as sure make a longer one needless: look up each rule's one-smaller subsets
    subsets = rules.select("items", "verdict", "confidence", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("less")).where("size(less) > 0")
    short = rules.select(F.col("items").alias("less"), "verdict", F.col("confidence").alias("c2"))
    needless = subsets.join(short.hint("shuffle_hash"), ["less", "verdict"]).where("c2 >= confidence").select("items", "verdict").distinct()
    kept = rules.join(needless.hint("shuffle_hash"), ["items", "verdict"], "left_anti")
    by_item = kept.withColumn("item", F.explode("items")).join(singles.select("item", "freq").hint("shuffle_hash"), "item")
    out = by_item.groupBy("items", "verdict").agg(F.first("confidence").alias("confidence"), F.first("support").alias("support"), F.min_by("item", F.struct("freq", "item")).alias("key"))
    return scratch.write(out), items.select("token", "item")


def match_rules(token_sets: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """(tokens, verdict, score) of the token sets that some rule fits, by an inverted index on each rule's rarest item.

    Only tokens whose item stands in a rule go on; a set then looks up the rules entered under its items and checks the rest of what they need.
    The verdict with the surer best rule wins, ties go to allow.
    """
    scratch = Scratch(token_sets.sparkSession)
    needed = rules.select(F.explode("items").alias("item")).distinct()
    named = scratch.write(items.join(needed.hint("shuffle_hash"), "item", "left_semi"))
    has = _attach(token_sets.select("tokens", F.explode("tokens").alias("token")), named, "token", F.col("tokens"))
    has = has.groupBy("tokens").agg(F.collect_set("item").alias("has"))
    index = rules.select("key", F.col("items").alias("need"), "verdict", "confidence")
    hit = _attach(has.withColumn("key", F.explode("has")), index, "key", F.col("tokens")).where(F.size(F.array_except("need", "has")) == 0)
    best = hit.groupBy("tokens").agg(F.max(F.when(F.col("verdict") == "block", F.col("confidence"))).alias("b"), F.max(F.when(F.col("verdict") == "allow", F.col("confidence"))).alias("a"))
    blocked = F.coalesce("b", F.lit(0.0)) > F.coalesce("a", F.lit(0.0))
    return best.select("tokens", F.when(blocked, "block").otherwise("allow").alias("verdict"), F.greatest("a", "b").alias("score"))


def judge_urls(pages: DataFrame, *, rules=RULES, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", min_support: float = 0.01, min_confidence: float = 0.9, default: str = "allow") -> DataFrame:
    """Verdict per page: of the longest fitting host/path rule, else of the association rules mined from the URLs that those rules label, else ``default``.

    With ``labels``, rows of (url, verdict) with verdicts allow or block, the mined rules learn from these instead.

    Returns id, host, path, rule (null where none fits), verdict and score (of the mined rule, else null). Null URLs and URLs without ``://`` have empty
    host and path, no rule and the default verdict. Repeated rows are judged each. Very long URLs are read whole; further columns of ``pages``,
    whatever their names, are not read and not returned. No rows give no rows.
    Each distinct token set is matched once, so hosts with a third of all pages cost no more than others.
    """
    scratch = Scratch(pages.sparkSession)
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    base = base.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", F.array_sort(url_tokens(F.col("host"), F.col("path"), F.col("url"))))
    base = scratch.write(base.select("page_id", "host", "path", "fit.rule", F.col("fit.verdict").alias("known"), "tokens"))
    labelled = base.where("known IS NOT NULL").select("tokens", F.col("known").alias("verdict"))
    if labels is not None:
        labelled = labels.select(url_tokens(host_of(F.col("url")), path_of(F.col("url")), F.col("url")).alias("tokens"), "verdict")
    mined, items = mine_rules(labelled, min_support=min_support, min_confidence=min_confidence)
    matched = scratch.write(match_rules(base.where("known IS NULL").select("tokens").distinct(), mined, items))
    open_ = base.where("known IS NULL")
    judged = open_.join(matched.hint("shuffle_merge"), "tokens", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"), "score")
    return base.where("known IS NOT NULL").select("page_id", "host", "path", "rule", F.col("known").alias("verdict"), F.lit(None).cast("double").alias("score")).unionByName(judged)


def op4_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("score")
