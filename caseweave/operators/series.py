"""Series of cases: indicators found in their texts, what cases share, and summary scores."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions import as_set, jaccard, jaccard_of_sets
from caseweave.operators.pairwise import Numbers, Sets, Values, judged_pairs
from caseweave.plans.blocks import pairs_within

# Signature families, their weights and patterns.
SIGNATURE_FAMILIES = {
    "object_placement": (0.40, (
        r"placed\s+(neatly|deliberately|carefully|gently)\s+(on|beside|near|next to|by)",
        r"(?:brass|metal|small)\s+key\s+(?:found|placed|resting|sitting)",
        r"key\s+(?:found|placed)\s+(?:on|beside|near|next to|by)\s+(?:the\s+)?(?:workbench|dashboard|body|table|shelf)",
        r"(?:trophy|souvenir|memento|keepsake)",
        r"deliberately\s+(?:placed|left|positioned)",
    )),
    "dead_frequency": (0.40, (
        r"dead\s+frequency",
        r"(?:radio|transmission|transmitted).*(?:dead|static|off[- ]air|gone off)",
        r"tuned\s+to\s+(?:a\s+)?(?:dead|defunct|off[- ]air|inactive)\s+(?:frequency|station|channel)",
        r"static\s+only",
        r"backup\s+frequency",
        r"transmitted.*(?:seconds?\s+of\s+)?dead\s+air",
    )),
    "trophy_taking": (0.35, (
        r"missing\s+(?:item|object|thing|belonging|possession)",
        r"(?:took|taken|removed|stolen|missing)\s+(?:a\s+)?(?:single\s+)?(?:item|object|mug|badge|folder|key|blank)",
        r"(?:gap|missing)\s+(?:in|from|on)\s+(?:the\s+)?(?:pegboard|shelf|board|collection|desk)",
        r"(?:only\s+)?noticed\s+the\s+gap",
        r"(?:first|earliest)\s+indication.*(?:taking|took|missing|removed)",
    )),
    "victim_vulnerability": (0.25, (
        r"(?:found|found\s+dead)\s+(?:alone|by\s+herself|by\s+himself)",
        r"often\s+(?:stayed|worked|remained)\s+late",
        r"(?:working|alone)\s+(?:at|in|during|after)\s+(?:night|late|evening)",
        r"no\s+(?:indication|evidence)\s+(?:of\s+)?(?:struggle|fighting|defense)",
        r"doors?\s+were?\s+unlocked",
        r"unlocked.*(?:completely\s+out\s+of\s+character)",
    )),
    "cross_jurisdictional": (0.20, (
        r"(?:county|district|jurisdiction|precinct|station).*(?:different|separate|adjacent|bordering)",
        r"cross[- ]jurisdiction",
        r"multi[- ]county",
    )),
    "escalation_pattern": (0.30, (
        r"(?:interval|gap|period|spacing).*(?:increasing|growing|longer|shorter|accelerat)",
        r"(?:\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*(?:days?|weeks?|months?)",
        r"time\s+since\s+prior\s+case.*(?:\d+)\s+days?",
    )),
    "occupational_targeting": (0.25, (
        r"(?:retired|former|ex[- ]?).*(?:locksmith|engineer|archivist|teacher|actuary)",
        r"(?:radio|frequency|broadcast|station|transmission)",
        r"(?:archive|archive|records?|filing|catalog)",
        r"(?:key|lock|security|access)",
    )),
}
# Words of which any hit of a family's pattern has one, in the order of the patterns: a text without them isn't searched.
FAMILY_WORDS = {
    "object_placement": (("placed",), ("key",), ("key",), ("trophy", "souvenir", "memento", "keepsake"), ("deliberately",)),
    "dead_frequency": (("frequency",), ("dead", "static", "off-air", "off air", "gone off"), ("tuned",), ("static",), ("backup",), ("transmitted",)),
    "trophy_taking": (("missing",), ("took", "taken", "removed", "stolen", "missing"), ("pegboard", "shelf", "board", "collection", "desk"), ("noticed",), ("indication",)),
    "victim_vulnerability": (("found",), ("often",), ("working", "alone"), ("indication", "evidence"), ("unlocked",), ("unlocked",)),
    "cross_jurisdictional": (("different", "separate", "adjacent", "bordering"), ("jurisdiction",), ("multi",)),
    "escalation_pattern": (("increasing", "growing", "longer", "shorter", "accelerat"), ("day", "week", "month"), ("prior",)),
    "occupational_targeting": (("locksmith", "engineer", "archivist", "teacher", "actuary"), ("radio", "frequency", "broadcast", "station", "transmission"), ("archive", "record", "filing", "catalog"), ("key", "lock", "security", "access")),
}
# Method keywords by dimension.
METHOD_WORDS = {
    "approach": ("lured", "approached", "confronted", "ambush", "surprise", "stakeout", "followed", "watched", "targeted", "selected", "forced entry", "unlocked", "door", "window", "invited", "trusted", "known to victim"),
    "control": ("restrained", "tied", "bound", "gagged", "blindfolded", "threatened", "coerced", "intimidated", "held", "locked", "confined", "drugged", "sedated"),
    "violence": ("strangulation", "stabbing", "blunt force", "shooting", "overkill", "excessive force", "brutal", "violent", "beaten", "assaulted", "injuries"),
    "targeting": ("alone", "vulnerable", "isolated", "late night", "after hours", "working late", "no witnesses", "no forced entry", "no struggle"),
    "geographic": ("rural", "remote", "isolated", "secluded", "abandoned", "vacant", "detached"),
    "temporal": ("night", "evening", "dawn", "late", "weekend", "holiday", "off hours"),
    "organizational": (
        "syndicate", "network", "ring", "cartel", "faction", "courier", "mule", "stash", "safe house", "drop point", "cut-out", "front", "shell company", "benami", "phone tree", "burner", "coded language",
        "enforcer", "lieutenant", "kingpin", "financier", "route", "corridor", "smuggling route", "extortion", "protection", "racket",
    ),
    "financial": ("hawala", "hundi", "laundering", "proceeds", "circular", "round-trip", "kickback", "layering", "placement", "integration", "ghost employee", "fake invoice", "shell company", "dummy account", "cash intensive", "underreporting"),
}
# Method patterns by dimension, for lowered texts.
METHOD_PATTERNS = {
    "entry_method": (r"forced?\s+entry", r"unlocked", r"door\s+was\s+(?:open|unlocked|ajar)", r"window\s+(?:open|broken|forced)", r"invited\s+in", r"no\s+sign\s+of\s+(?:forced\s+)?entry"),
    "weapon_type": (r"(?:sharp|blunt)\s+(?:object|instrument|weapon)", r"(?:knife|gun|firearm|bat|pipe|rope|cord)", r"strangulation", r"asphyxiation", r"stab(?:bing|s)?"),
    "time_of_crime": (r"(?:late|early)\s+(?:night|morning|evening)", r"(?:between|around|near)\s+\d{1,2}\s*(?:am|pm|AM|PM)", r"(?:after|before)\s+(?:midnight|dawn|sunrise|sunset)", r"(?:night|evening|dawn|morning)"),
    "concealment": (r"(?:body|victim)\s+(?:found|hidden|concealed|dumped|left)", r"(?:cleaned|wiped|removed)\s+(?:evidence|fingerprints|traces)", r"staged", r"posed"),
    "communication": (r"(?:coded|encrypted|secret)\s+(?:language|message|channel)", r"(?:burner|prepaid|disposable)\s+(?:phone|sim)", r"(?:phone|sim)\s+(?:swap|swappped|changed)", r"(?:via|through)\s+(?:intermediary|middleman|cut[- ]?out)"),
    "financial_flow": (r"(?:hawala|hundi|underground\s+banking)", r"(?:circular|round[- ]?trip)\s+(?:transfer|transaction)", r"(?:launder|laundering|layering)", r"(?:shell|dummy|front)\s+(?:company|account|entity)", r"(?:benami|benamdar)"),
}
# Signals of a victim in lowered texts.
AGES = (r"(\d{1,2})[\s-]*(?:year[\s-]*old|yr[\s-]*old|y/?o)", r"(?:age|aged)\s*[:\s]*(\d{1,2})", r"(\d{1,2})\s*years?\s*(?:of\s+age|old)")
GENDER_TERMS = {"male": ("he", "him", "his", "male", "man", "boy", "gentleman"), "female": ("she", "her", "hers", "female", "woman", "girl", "lady")}
RISKS = {
    "alone_at_time_of_crime": r"\balone\b",
    "targeted_during_vulnerable_hours": r"(?:late|night|evening|after\s+hours)",
    "no_forced_entry": r"(?:unlocked|no\s+(?:forced|sign)\s+entry)",
    "no_defense": r"(?:no\s+struggle|no\s+indication.*struggle)",
    "working_late": r"(?:working\s+late|stayed\s+late|after\s+hours)",
    "isolated_location": r"(?:rural|isolated|detached|secluded)",
    "elderly_victim": r"(?:elderly|older|senior)",
    "lives_alone": r"(?:lived\s+alone|single)",
}
VICTIM_LINE = r"(?i)\*\*Victim:\*\*\s*(.+?)(?:\n|$)"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _present(conditions: dict[str, Column]) -> Column:
    """Names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def signature_families(docs: DataFrame) -> DataFrame:
    """(doc_id, family, matches, confidence, weight) of the families that a text shows: at most 3 hits a pattern count, confidence min(.5 + .15 matches, .95). Null texts show none."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("low", F.lower("text"))  # once a text, not once a word
    some = lambda words: reduce(lambda a, b: a | b, [F.contains("low", F.lit(w)) for w in words])
    hits = lambda p, words: F.when(some(words), F.least(F.lit(3), F.size(_all(F.col("text"), f"(?i){p}")))).otherwise(0)
    found = [F.struct(F.lit(f).alias("family"), reduce(lambda a, b: a + b, map(hits, patterns, FAMILY_WORDS[f])).alias("matches"), F.lit(w).alias("weight")) for f, (w, patterns) in SIGNATURE_FAMILIES.items()]
    rows = docs.select("doc_id", F.explode(F.array(*found)).alias("m")).select("doc_id", "m.*").where("matches > 0")
    return rows.select("doc_id", "family", "matches", F.least(0.5 + 0.15 * F.col("matches"), F.lit(0.95)).alias("confidence"), "weight")


def signature_intensity(families: DataFrame) -> DataFrame:
    """(doc_id, families, intensity): confidence times weight, summed."""
    return families.groupBy("doc_id").agg(F.count("*").alias("families"), F.sum(F.col("confidence") * F.col("weight")).alias("intensity"))


def method_indicators(docs: DataFrame) -> DataFrame:
    """(doc_id, dim, hits array<string>): keywords that a lowered text contains, and up to 3 hits of each pattern. Null texts have none."""
    docs = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))  # once a text, not once a keyword
    low = F.col("low")
    words = {d: F.filter(F.array(*map(F.lit, ws)), lambda w: F.contains(low, w)) for d, ws in METHOD_WORDS.items()}
    found = {d: F.concat(*[F.slice(_all(low, p), 1, 3) for p in ps]) for d, ps in METHOD_PATTERNS.items()}
    parts = [F.struct(F.lit(d).alias("dim"), c.alias("hits")) for d, c in (words | found).items()]
    return docs.select("doc_id", F.explode(F.array(*parts)).alias("m")).select("doc_id", "m.dim", "m.hits").where("size(hits) > 0")


def victim_signals(docs: DataFrame) -> DataFrame:
    """(doc_id, ages, genders, risks, profile): distinct ages from 10 to 100 ascending, genders with two terms or more, risk labels, and the line after "victim" (200 characters; empty without one)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))  # once a text, not once a pattern
    text, low = F.col("text"), F.col("low")
    ages = F.transform(F.concat(*[_all(low, p, 1) for p in AGES]), lambda x: x.cast("int"))
    terms = {g: reduce(lambda a, b: a + b, [low.rlike(rf"\b{t}\b").cast("int") for t in ts]) >= 2 for g, ts in GENDER_TERMS.items()}
    profile = F.substring(F.trim(F.regexp_extract(text, r"(?i)\*?\*?victim:?\*?\*?\s*(.+?)(?:\n|$)", 1)), 1, 200)
    return docs.select("doc_id", F.array_sort(F.array_distinct(F.filter(ages, lambda a: a.between(10, 100)))).alias("ages"), _present(terms).alias("genders"), _present({r: low.rlike(p) for r, p in RISKS.items()}).alias("risks"), profile.alias("profile"))


def victim_line(docs: DataFrame) -> DataFrame:
    """(doc_id, name, age, occupation) from a line ``**Victim:** name, age, occupation``; null where a part is missing."""
    raw = F.regexp_extract(F.coalesce("text", F.lit("")), VICTIM_LINE, 1)
    part = lambda p: F.nullif(F.trim(F.regexp_extract(raw, p, 1)), F.lit(""))
    return docs.select("doc_id", part(r"^(.+?)\s*,").alias("name"), part(r"(\d{1,2})\s*,").cast("int").alias("age"), part(r"\d{1,2}\s*,\s*(.+)").alias("occupation"))


def shared_locations(places: DataFrame) -> DataFrame:
    """One row (cases, shared, score): locations in two or more cases, and the share of all pairs of cases that have a common one. Rows: (case_id, name)."""
    p = places.select("case_id", F.lower(F.trim("name")).alias("name")).distinct()
    totals = p.agg(F.count_distinct("case_id").alias("cases"))
    shared = p.groupBy("name").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") >= 2).alias("shared"))
    pairs = pairs_within(p, ["name"], "case_id").select("a", "b").distinct().agg(F.count("*").alias("pairs"))
    n = F.col("cases")
    every = F.when(n > 1, n * (n - 1) / 2).otherwise(1.0)
    return totals.crossJoin(F.broadcast(shared)).crossJoin(F.broadcast(pairs)).select("cases", "shared", F.round(F.col("pairs") / every, 3).alias("score"))


def entity_links(entities: DataFrame) -> DataFrame:
    """(entity_type, shared): names in two or more cases by type; the row with a null type is the total."""
    names = entities.groupBy("entity_type", F.lower("name").alias("name")).agg(F.count_distinct("case_id").alias("cases")).where("cases >= 2")
    return names.rollup("entity_type").agg(F.count("*").alias("shared"))


def signature_overlap(terms: DataFrame) -> DataFrame:
    """One row (cases, mean_overlap, common): mean Jaccard of the term sets over all pairs of cases, pairs without a common term counting 0, and terms that all cases have. Rows: (case_id, term)."""
    t = terms.select("case_id", "term").distinct()
    sizes = t.groupBy("case_id").agg(F.count("*").alias("size"))
    both = pairs_within(t, ["term"], "case_id").groupBy(F.col("a").alias("case_id"), F.col("b").alias("other")).agg(F.count("*").alias("both"))
    scored = both.join(sizes.hint("shuffle_merge"), "case_id").join(sizes.select(F.col("case_id").alias("other"), F.col("size").alias("size_b")).hint("shuffle_merge"), "other")
    total = scored.agg(F.coalesce(F.sum(F.col("both") / (F.col("size") + F.col("size_b") - F.col("both"))), F.lit(0.0)).alias("total"))
    cases = sizes.agg(F.count("*").alias("cases"))
    common = t.groupBy("term").agg(F.count("*").alias("n")).crossJoin(F.broadcast(cases)).agg(F.count_if(F.col("n") == F.col("cases")).alias("common"))
    n = F.col("cases")
    return cases.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(common)).select("cases", F.when(n > 1, F.col("total") / (n * (n - 1) / 2)).otherwise(0.0).alias("mean_overlap"), "common")


def common_families(families: DataFrame) -> DataFrame:
    """One row (common, overlap): signature families in two or more cases, and their share of all families. Rows: (case_id, family)."""
    n = families.groupBy("family").agg(F.count_distinct("case_id").alias("cases")).where("cases >= 2")
    return n.agg(F.count("*").alias("common")).withColumn("overlap", F.col("common") / len(SIGNATURE_FAMILIES))


def victim_roll_up(victims: DataFrame) -> DataFrame:
    """One row (lowest, highest, spread, occupations, score): ages, distinct occupations and the share of cases with an age; spread is 0 with fewer than two ages. Rows: (case_id, age, occupation)."""
    return victims.agg(
        F.min("age").alias("lowest"), F.max("age").alias("highest"), F.when(F.count("age") > 1, F.max("age") - F.min("age")).otherwise(0).alias("spread"),
        F.count_distinct("occupation").alias("occupations"), (F.count("age") / F.greatest(F.count_distinct("case_id"), F.lit(1))).alias("score"),
    )


def cluster_roll_up(links: DataFrame, clusters: DataFrame, cases: DataFrame) -> DataFrame:
    """Per cluster: members, mean and largest link score, the strongest link's two cases (ties to the smallest ids), regions, and whether it crosses them.

    ``links``: (case_a, case_b, score); ``clusters``: (case_id, cluster); ``cases``: (case_id, region).
    """
    of_a = clusters.select(F.col("case_id").alias("case_a"), "cluster")
    scores = links.join(of_a, "case_a").groupBy("cluster").agg(F.avg("score").alias("avg_score"), F.max("score").alias("max_score"), F.min_by(F.struct("case_a", "case_b"), F.struct(F.negative("score"), "case_a", "case_b")).alias("anchor"))
    members = clusters.join(cases, "case_id").groupBy("cluster").agg(F.count("*").alias("members"), F.count_distinct("region").alias("regions"))
    return members.join(scores, "cluster").select("cluster", "members", "avg_score", "max_score", F.col("anchor.case_a").alias("anchor_a"), F.col("anchor.case_b").alias("anchor_b"), "regions", (F.col("regions") > 1).alias("cross_region"))


def map_similarity(a: Column, b: Column) -> Column:
    """Mean Jaccard over the dimensions that either map<dim, array<string>> has; one-sided dimensions score 0, null on both sides doesn't count, no dimension gives 0."""
    there = lambda m: F.map_keys(F.map_filter(m, lambda _, v: v.isNotNull()))
    both = F.array_intersect(there(a), there(b))
    dims = F.size(there(a)) + F.size(there(b)) - F.size(both)
    total = F.aggregate(both, F.lit(0.0), lambda s, d: s + jaccard(F.element_at(a, d), F.element_at(b, d)))
    return F.when(dims == 0, 0.0).otherwise(total / F.nullif(dims, F.lit(0)))


def signal_similarity(a, b) -> Column:
    """Mean of what both sides allow: closeness of mean ages over 15 years, equal gender sets, Jaccard of the risks (if either side has one); 0 without any.

    ``a``, ``b``: column getters of age (the mean), genders (sorted, null for none) and risks (a set).
    """
    parts = [
        F.when(a("age").isNotNull() & b("age").isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(a("age") - b("age")) / 15)),
        F.when(a("genders").isNotNull() & b("genders").isNotNull(), (a("genders") == b("genders")).cast("double")),
        F.when((F.size(a("risks")) > 0) | (F.size(b("risks")) > 0), jaccard_of_sets(a("risks"), b("risks"))),
    ]
    total, count = (reduce(lambda x, y: x + y, [f(p) for p in parts]) for f in (lambda p: F.coalesce(p, F.lit(0.0)), lambda p: p.isNotNull().cast("int")))
    return F.coalesce(total / F.nullif(count, F.lit(0)), F.lit(0.0))


def _text_sides(cases: DataFrame) -> DataFrame:
    """What ``text_links`` compares, once a case: sets, the mean age, genders as one value, and the methods as dimensions with sets of values."""
    mean = F.aggregate("ages", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size("ages"), F.lit(0))
    entries = F.filter(F.map_entries(F.coalesce("methods", F.create_map().cast("map<string,array<string>>"))), lambda e: e["value"].isNotNull())
    return cases.select(
        "case_id", as_set(F.col("terms")).alias("terms"), as_set(F.col("names")).alias("names"), F.transform(entries, lambda e: F.struct(e["key"].alias("dim"), F.array_distinct(e["value"]).alias("has"))).alias("methods"),
        F.when(F.size("ages") > 0, mean).alias("age"), F.when(F.size("genders") > 0, F.to_json(F.array_sort("genders"))).alias("genders"), as_set(F.col("risks")).alias("risks"),
    )


def _methods_alike(x: pa.Array, y: pa.Array):
    """``map_similarity`` of the dimensions of two blocks, over ranges of the left one's rows."""
    sides = []
    for side in (x, y):
        sizes = pc.list_value_length(side).to_numpy(zero_copy_only=False).astype(np.int64)
        entries = side.flatten()
        sides.append((sizes, np.repeat(np.arange(len(side)), sizes), entries.field("dim").to_pylist(), entries.field("has")))
    parts = []
    for dim in sorted(set(sides[0][2]) & set(sides[1][2])):
        lists = []
        for sizes, rows, dims, has in sides:
            of = np.full(len(sizes), -1, np.int64)
            picked = np.flatnonzero([d == dim for d in dims])
            of[rows[picked]] = picked
            lists.append((of >= 0, has.take(pa.array(of, mask=of < 0))))
        parts.append((lists[0][0], lists[1][0], Sets(*[pc.if_else(there, values, pa.scalar([], values.type)) for there, values in lists])))

    def alike(lo: int, hi: int) -> np.ndarray:
        dims, total = (sides[0][0][lo:hi, None] + sides[1][0]).astype(np.int64), 0.0
        for there_l, there_r, sets in parts:
            both = there_l[lo:hi, None] & there_r
            dims, total = dims - both, total + np.where(both, sets.jaccard(lo, hi), 0.0)
        return total / np.maximum(dims, 1)

    return alike


def _text_judge(minimum: float, signature_above: float | None):
    def judge(x: pa.StructArray, y: pa.StructArray):
        of = lambda kind, name: kind(x.field(name), y.field(name))
        terms = of(Sets, "terms")

        def scores(lo: int, hi: int):
            signature = terms.jaccard(lo, hi)
            if signature_above is not None and not (signature > signature_above).any():
                return np.zeros(signature.shape, bool), [signature] * 5
            if not rest:
                rest.update({"methods": _methods_alike(x.field("methods"), y.field("methods")), "names": of(Sets, "names"), "age": of(Numbers, "age"), "genders": of(Values, "genders"), "risks": of(Sets, "risks")})
            method, entity = rest["methods"](lo, hi), rest["names"].jaccard(lo, hi)
            ages, genders = rest["age"].known(lo, hi), rest["genders"].known(lo, hi)
            risks = (rest["risks"].size_l[lo:hi, None] > 0) | (rest["risks"].size_r > 0)
            total = np.where(ages, rest["age"].near(lo, hi, 15), 0.0) + rest["genders"].equal(lo, hi) + rest["risks"].jaccard(lo, hi)
            victim = total / np.maximum(ages.astype(np.int64) + genders + risks, 1)
            score = 0.40 * signature + 0.25 * method + 0.20 * victim + 0.15 * entity
            kept = score >= minimum
            return kept if signature_above is None else kept & (signature > signature_above), [score, signature, method, victim, entity]

        rest = {}
        return scores

    return judge


def text_links(cases: DataFrame, minimum: float = 0.25, signature_above: float | None = None) -> DataFrame:
    """Pairs of cases (case_a, case_b, score, signature, method, victim, entity) of at least ``minimum``: .40 signature + .25 method + .20 victim + .15 entity.

    Cases: (case_id, terms, names: array<string>, methods: map<string, array<string>>, ages, genders, risks). Pairs come from a common term, method value or name: without
    one only the victim part is left, at most .20, so a minimum above that loses no pair. With ``signature_above`` (0 or more) only pairs of a larger signature part
    are wanted, and they have a common term. A pair is judged at the least thing that it has in common, in arrays of a block by a block, so pairs are not shuffled and only those that stay leave their task.
    """
    keys = F.transform("terms", lambda x: F.concat(F.lit("t"), x))
    if signature_above is None:
        values = F.flatten(F.transform("methods", lambda e: F.transform(e["has"], lambda v: F.concat_ws("=", F.lit("m"), e["dim"], v))))
        keys = F.concat(values, F.transform("names", lambda x: F.concat(F.lit("n"), x)), keys)
    sides = _text_sides(cases)
    names = ["score", "signature", "method", "victim", "entity"]
    found = judged_pairs(sides.withColumn("keys", keys), "keys", "case_id", [c for c in sides.columns if c != "case_id"], _text_judge(minimum, signature_above), names)
    return found.select(F.col("a").alias("case_a"), F.col("b").alias("case_b"), *names)


def series_score(entity: Column, location: Column, signature: Column, escalating: Column, victim: Column | None = None) -> Column:
    """.30 entity + .15 location + .35 signature + .10 of .8 with an escalation, .2 without; with victim coverage .10 of that more."""
    score = 0.30 * F.least(entity, F.lit(1.0)) + 0.15 * location + 0.35 * signature + 0.10 * F.when(escalating, 0.8).otherwise(0.2)
    return score if victim is None else score + 0.10 * victim


def series_band(score: Column) -> Column:
    """CRITICAL from .7, HIGH from .5, MEDIUM from .3, else LOW."""
    return F.when(score >= 0.7, "CRITICAL").when(score >= 0.5, "HIGH").when(score >= 0.3, "MEDIUM").otherwise("LOW")
