"""Which entities may be one: similar names found without a triangle, pairs that evidence brings together, and a recommendation for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave.functions import sorted_tokens, token_sort_ratio
from caseweave.operators.linkage import recommendation
from caseweave.operators.rollups import SIGNALS
from caseweave.plans.blocks import dealt, pairs_within
from caseweave.plans.scratch import Scratch

# Signals that count for partial names, and the ratio that fathers' names must exceed.
STRONG = ["identical_phone", "identical_address", "identical_dob", "identical_father_name"]
FATHER_RATIO = 0.85
#: Kinds of attributes that count as evidence.
KINDS = ["phone", "address", "dob", "father_name", "physical"]


def _numbered(grams: Column) -> Column:
    """Grams with the number of their occurrence, so that multisets compare as sets."""
    return F.transform(grams, lambda g, i: F.concat(g, F.lit("\x1f"), F.size(F.filter(F.slice(grams, 1, i + 1), lambda x: x == g)).cast("string")))


def similar_names(names: DataFrame, minimum: float = 0.6, name: str = "name") -> DataFrame:
    """(a, b, ratio) of pairs a < b of different names whose token-sort ratio is at least ``minimum``; none is lost.

    Ratio = 2 * LCS / (m + n) of the names in lower case with their tokens sorted. With s = minimum * (m + n) / 2 letters in common, two strings of m and n letters share at least
    s of their letters, and 3 s - m - n - 1 of their letter pairs, which count from a ``minimum`` of .8 on. Each string looks for partners by the rarest of its grams, as many as leave too few for
    the rest to be enough (prefix filter); lengths and whole gram sets then sort out most pairs, and the ratio is computed for what is left.
    Strings meet per gram in blocks of bounded size. At .6 letters decide little, so this is for names, not for texts; distinct names are compared once. Null and blank names match nothing.
    """
    q = 2 if minimum >= 0.8 else 1
    scratch = Scratch(names.sparkSession)
    n, t = F.col("n").cast("double"), float(minimum)
    distinct = names.select(F.lower(F.trim(name)).alias("name")).dropna().distinct().withColumn("said", sorted_tokens(F.col("name"))).where("said <> ''")
    texts = distinct.select("said").distinct().withColumn("n", F.length("said"))
    starts = F.when(F.col("n") >= q, F.sequence(F.lit(1), F.col("n") - (q - 1))).otherwise(F.array().cast("array<int>"))
    texts = scratch.write(texts.withColumn("grams", _numbered(F.transform(starts, lambda i: F.substring(F.col("said"), i, F.lit(q))))))
    common = scratch.write(texts.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")))
    ranked = texts.select("said", "n", F.explode("grams").alias("gram")).join(common.hint("shuffle_merge"), "gram")
    order = F.transform(F.array_sort(F.collect_list(F.struct("df", "gram"))), lambda x: x["gram"])
    ranked = ranked.groupBy("said", "n").agg(order.alias("grams"))
    shortest = F.ceil(n * t / (2 - t) - 1e-9)
    need = F.ceil(t * (n + shortest) / 2 - 1e-9) if q == 1 else F.ceil((1.5 * t - 1) * (n + shortest) - 1e-9) - 1
    prefix = F.slice("grams", 1, F.greatest(F.size("grams") - F.greatest(need, F.lit(1)) + 1, F.lit(0)).cast("int"))
    # strings too short to have to share a gram all meet
    tiny = F.when(need < 1, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    small = texts.where(F.size("grams") == 0).select("said", "n", F.array(F.lit("")).alias("keys"))
    keyed = ranked.select("said", "n", F.concat(prefix, tiny).alias("keys")).unionByName(small)
    reach = F.col("n")  # a string meets only strings whose length it can match: dealt by rounded logarithms of the length
    step = float((2 - t) / t)
    bin_ = F.floor(F.log(reach.cast("double")) / F.log(F.lit(step * (1 + 1e-9))))
    keyed = keyed.select("said", F.explode("keys").alias("gram"), F.explode(F.array(bin_, bin_ + 1)).alias("bin"))
    met = pairs_within(keyed, ["gram", "bin"], "said").select("a", "b").distinct()
    met = scratch.write(met)
    left, right = (texts.select(F.col("said").alias(c), F.col("n").alias(f"n_{c}"), F.col("grams").alias(f"g_{c}")) for c in "ab")
    met = met.join(left.hint("shuffle_merge"), "a").join(right.hint("shuffle_merge"), "b")
    total = (F.col("n_a") + F.col("n_b")).cast("double")
    shared = t * total / 2 - 1e-9 if q == 1 else 3 * t * total / 2 - total - 1 - 1e-9
    met = met.where((F.least("n_a", "n_b") >= t * total / 2 - 1e-9) & (F.size(F.array_intersect("g_a", "g_b")) >= shared))
    scored = met.withColumn("ratio", token_sort_ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= t - 1e-9).select("a", "b", "ratio")
    scored = scratch.write(scored)
    scratch.keep_only(scored)
    # back to the names: those that are equal once sorted, and those of similar strings
    same = pairs_within(distinct, ["said"], "name").select("a", "b", F.lit(1.0).alias("ratio"))
    one = distinct.select(F.col("said").alias("a"), F.col("name").alias("x"))
    two = distinct.select(F.col("said").alias("b"), F.col("name").alias("y"))
    other = scored.join(one.hint("shuffle_merge"), "a").join(two.hint("shuffle_merge"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "ratio")
    return same.unionByName(other)


def partial(name: Column) -> Column:
    """A name of one word or of under four characters, which may be anyone's."""
    t = F.trim(F.coalesce(name, F.lit("")))
    return (F.size(F.split(t, r"\s+")) <= 1) | (F.length(t) < 4)


def name_scores(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(a, b, similarity) of given pairs of entities (entity_id, entity_type, name, aliases): the best token-sort ratio over names and aliases.

    Different types, two names of one word and a word that the other name lacks give 0; a word inside the other name gives .3. Null names are empty, null aliases none.
    """
    about = entities.select("entity_id", "entity_type", F.lower(F.trim(F.coalesce("name", F.lit("")))).alias("name"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    side = lambda c: about.select(*[F.col(x).alias(f"{x}_{c}") for x in about.columns]).withColumnRenamed(f"entity_id_{c}", c)
    met = pairs.select("a", "b").distinct().join(side("a").hint("shuffle_merge"), "a").join(side("b").hint("shuffle_merge"), "b")
    words = lambda c: F.filter(F.split(F.col(f"name_{c}"), r"\s+"), lambda w: w != "")
    wa, wb = words("a"), words("b")
    inside = (F.size(F.array_except(wa, wb)) == 0) | (F.size(F.array_except(wb, wa)) == 0)
    one = (F.size(wa) == 1) | (F.size(wb) == 1)
    fixed = F.when(F.col("entity_type_a") != F.col("entity_type_b"), 0.0).when((F.size(wa) == 1) & (F.size(wb) == 1), 0.0).when(one & inside, 0.3).when(one, 0.0)
    said = lambda c: F.array_distinct(F.concat(F.array(f"name_{c}"), F.transform(f"aliases_{c}", F.lower)))
    met = met.select("a", "b", fixed.alias("fixed"), said("a").alias("said_a"), said("b").alias("said_b"))
    open_ = met.where("fixed IS NULL").select("a", "b", F.explode("said_a").alias("x"), "said_b").select("a", "b", "x", F.explode("said_b").alias("y"))
    texts = open_.select("x", "y").distinct().withColumn("ratio", token_sort_ratio(F.col("x"), F.col("y")))
    best = open_.join(texts.hint("shuffle_merge"), ["x", "y"]).groupBy("a", "b").agg(F.max("ratio").alias("similarity"))
    return met.where("fixed IS NOT NULL").select("a", "b", F.col("fixed").alias("similarity")).unionByName(best)


def _alike_fathers(facts: DataFrame) -> DataFrame:
    """(name, other), both ways: fathers' names that are alike by more than ``FATHER_RATIO``."""
    alike = similar_names(facts.where("kind = 'father_name'"), FATHER_RATIO, "value").where(F.col("ratio") > FATHER_RATIO)
    return alike.select(F.col("a").alias("name"), F.col("b").alias("other")).union(alike.select("b", "a"))


def _profiles(scratch: Scratch, entities: DataFrame, attributes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live entities (entity_id, class, partial, have, seek) and their classes (entity_id, entity_type, name, aliases), which are all that names are judged by.

    ``have``: the entity's values as kind=value, its case among them; ``seek``: those and fathers' names like its father's.
    """
    none = F.array().cast("array<string>")
    said = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    aliases = F.array_sort(F.array_distinct(F.transform(F.array_compact(F.coalesce("aliases", none)), F.lower)))
    live = entities.where("merged_into IS NULL AND entity_type IS NOT NULL")
    about = live.select("entity_id", "entity_type", said.alias("name"), aliases.alias("aliases"), (partial(F.col("name")) | F.coalesce("partial_identity", F.lit(False))).alias("partial"), F.col("case_id").cast("string").alias("case"))
    named = ["entity_type", "name", "aliases"]
    classes = scratch.write(about.select(*named).distinct().select(F.monotonically_increasing_id().alias("entity_id"), *named))
    blank = F.lower(F.trim("value")) == ""
    value = F.when((F.col("kind") == "father_name") & ~blank, F.lower(F.trim("value"))).otherwise(F.col("value").cast("string"))
    facts = attributes.where(F.col("kind").isin(KINDS) & F.col("value").isNotNull()).select("entity_id", "kind", value.alias("value")).distinct()
    alike = facts.where("kind = 'father_name'").join(_alike_fathers(facts).hint("shuffle_merge"), F.col("value") == F.col("name")).select("entity_id", "kind", F.col("other").alias("value"))
    key = F.concat("kind", F.lit("="), "value")
    keys = facts.withColumn("own", F.lit(True)).unionByName(alike.withColumn("own", F.lit(False))).groupBy("entity_id").agg(F.collect_set(F.when(F.col("own"), key)).alias("have"), F.collect_set(key).alias("seek"))
    case = F.when(F.col("case").isNotNull(), F.array(F.concat(F.lit("case="), "case"))).otherwise(none)
    both = [F.array_sort(F.array_union(F.coalesce(c, none), case)).alias(c) for c in ("have", "seek")]
    numbered = about.join(classes.withColumnRenamed("entity_id", "class").hint("shuffle_merge"), named)
    who = numbered.join(keys.hint("shuffle_merge"), "entity_id", "left").select("entity_id", "class", "partial", *both)
    return scratch.write(dealt(who, "entity_id")), classes


def _kind(key: Column) -> Column:
    return F.substring_index(key, "=", 1)


def _held(who: DataFrame, keys: str) -> DataFrame:
    """(entity_id, class, held) for each choice of keys of different kinds that an entity has and that is enough for a match: partial names need two strong ones."""
    start = F.array(F.array().cast("array<string>"))
    add = lambda acc, kind: F.concat(acc, F.flatten(F.transform(F.filter(keys, lambda k: _kind(k) == kind), lambda k: F.transform(acc, lambda c: F.concat(c, F.array(k))))))
    choices = F.aggregate(F.array(*[F.lit(k) for k in [*KINDS, "case"]]), start, add)
    strong = F.size(F.filter("held", lambda k: F.concat(F.lit("identical_"), _kind(k)).isin(STRONG)))
    rows = who.select("entity_id", "class", "partial", F.explode(choices).alias("held")).where(F.size("held") > 0)
    return rows.where(~F.col("partial") | (strong >= 2)).select("entity_id", "class", "held")


def _leading(who: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """(a, b, similarity): of each entity the ``limit`` best others that a value or case brings together with it, by number of common kinds, similarity, id; some pairs beyond may be among them.

    Whoever is among an entity's best with the kinds S in common is also among the best by similarity of those that have S in common with it, so only the first ones by similarity are kept for each
    choice of values and class of names. Each class lists its first ids for each choice, and classes are scored, not entities: groups of any size make no pairs.
    """
    order = Window.partitionBy("held", "class").orderBy("entity_id")
    first = _held(who, "have").withColumn("i", F.row_number().over(order)).where(F.col("i") <= limit + 1)
    first = first.groupBy("held", F.col("class").alias("other")).agg(F.collect_list("entity_id").alias("ids"))
    seekers = _held(who, "seek")
    near = seekers.select("held", "class").distinct().join(scores.hint("shuffle_merge"), "class").join(first.hint("shuffle_merge"), ["held", "other"])
    ranked = F.transform("ids", lambda i: F.struct((-F.col("similarity")).alias("s"), i.alias("id")))
    lists = near.groupBy("held", "class").agg(F.slice(F.array_sort(F.flatten(F.collect_list(ranked))), 1, limit + 1).alias("best"))
    met = seekers.join(lists.hint("shuffle_merge"), ["held", "class"])
    met = met.select("entity_id", F.transform("best", lambda x: F.struct((-F.size("held")).alias("n"), x["s"].alias("s"), x["id"].alias("id"))).alias("best"))
    every = met.groupBy("entity_id").agg(F.array_sort(F.flatten(F.collect_list("best"))).alias("best"))
    others = F.filter(F.array_distinct(F.transform("best", lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id")))), lambda x: x["id"] != F.col("entity_id"))
    found = every.select("entity_id", F.explode(F.slice(others, 1, limit)).alias("x"))
    return found.select(F.least("entity_id", "x.id").alias("a"), F.greatest("entity_id", "x.id").alias("b"), (-F.col("x.s")).alias("similarity"))


def _associates(who: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, ca, cb) of live entities with two common neighbours, and their classes."""
    near = edges.select(F.col("src").alias("entity_id"), F.col("dst").alias("other")).union(edges.select("dst", "src"))
    met = pairs_within(near, ["other"], "entity_id").groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 2").select("a", "b")
    for end in "ab":
        met = met.join(who.select(F.col("entity_id").alias(end), F.col("class").alias(f"c{end}")).hint("shuffle_merge"), end)
    return met.select("a", "b", "ca", "cb")


def _class_scores(who: DataFrame, classes: DataFrame, friends: DataFrame, minimum: float) -> DataFrame:
    """(class, other, similarity), both ways, of classes that a value, a case or associates bring together and whose names are similar from ``minimum`` on."""
    keyed = who.select("class", F.explode("seek").alias("key")).distinct()
    met = pairs_within(keyed, ["key"], "class").select("a", "b").union(friends.select(F.least("ca", "cb"), F.greatest("ca", "cb"))).union(classes.select("entity_id", "entity_id"))
    scored = name_scores(met, classes).where(F.col("similarity") >= minimum - 1e-9).select("a", "b", F.round("similarity", 4).alias("similarity"))
    both = scored.select(F.col("a").alias("class"), F.col("b").alias("other"), "similarity").union(scored.select("b", "a", "similarity").where("a <> b"))
    return both


def candidate_matches(entities: DataFrame, attributes: DataFrame, edges: DataFrame, minimum: float = 0.6, limit: int = 10, case_id=None) -> DataFrame:
    """Matches with their evidence: (a, b, similarity, signals, n_signals, weight, partial, action, rank), rank being the better one of the pair's two ends, best ``limit`` of each.

    entities: (entity_id, entity_type, name, aliases, case_id, partial_identity, merged_into); attributes: (entity_id, kind, value) with kinds phone, address, dob, father_name, physical;
    edges: (src, dst). Both ends are live, of one type, similar from ``minimum`` on, and, with ``case_id``, in that case. Partial names need two strong signals, entities of different cases one;
    a common case is a signal, so every match has one. Only pairs that can be among the best of an end are looked for (``_leading``, and all that share associates): no triangle over names or groups is made and none is lost.
    Ranked by signals, then similarity, then the other's id. Attributes of null value and null cases bring nothing together; entities without attributes match through cases and associates.
    An entity with many values of several kinds makes one row for each choice of them.
    """
    pool = entities if case_id is None else entities.where(F.col("case_id") == F.lit(case_id))
    scratch = Scratch(entities.sparkSession)
    who, classes = _profiles(scratch, pool, attributes)
    friends = scratch.write(_associates(who, edges))
    scores = scratch.write(_class_scores(who, classes, friends, minimum))
    alike = scores.select(F.col("class").alias("ca"), F.col("other").alias("cb"), "similarity")
    known = friends.join(alike.hint("shuffle_merge"), ["ca", "cb"]).select("a", "b", "similarity", F.lit(True).alias("friends"))
    found = _leading(who, scores, limit).withColumn("friends", F.lit(False)).unionByName(known).groupBy("a", "b").agg(F.max("similarity").alias("similarity"), F.max("friends").alias("friends"))
    side = lambda c, keys: who.select(F.col("entity_id").alias(c), F.col("partial").alias(f"p{c}"), F.col(keys).alias(f"k{c}"))
    found = found.join(side("a", "have").hint("shuffle_merge"), "a").join(side("b", "seek").hint("shuffle_merge"), "b")
    kinds = F.array_distinct(F.transform(F.array_intersect("ka", "kb"), lambda k: F.when(_kind(k) == "case", "shared_case").otherwise(F.concat(F.lit("identical_"), _kind(k)))))
    every = F.array_sort(F.concat(kinds, F.when(F.col("friends"), F.array(F.lit("shared_associates"))).otherwise(F.array().cast("array<string>"))))
    weights = F.create_map(*[F.lit(x) for item in SIGNALS.items() for x in item])
    strong = F.size(F.array_intersect("signals", F.array(*[F.lit(s) for s in STRONG])))
    found = found.withColumn("signals", every).withColumns({"partial": F.col("pa") | F.col("pb"), "n_signals": F.size("signals"), "weight": F.aggregate("signals", F.lit(0.0), lambda acc, s: acc + weights[s])})
    found = found.where(~F.col("partial") | (strong >= 2))
    found = scratch.write(found.select("a", "b", "similarity", "signals", "n_signals", "weight", "partial", recommendation(F.col("n_signals"), F.col("partial")).alias("action")))
    ends = found.select(F.col("a").alias("id"), F.col("b").alias("other"), "n_signals", "similarity").union(found.select("b", "a", "n_signals", "similarity"))
    order = Window.partitionBy("id").orderBy(F.col("n_signals").desc(), F.col("similarity").desc(), "other")
    best = ends.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    best = best.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.min("rank").alias("rank"))
    return found.join(best.hint("shuffle_merge"), ["a", "b"])
