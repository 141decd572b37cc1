"""What two case texts share in context: families of signs found near words that support them, and kinds of method."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.operators.tokens import cut
from caseweave.plans.blocks import dealt
from caseweave.plans.scratch import Scratch

# Patterns and labels of each family, words that must be near a sign, words too common to tell.
SIGNS = {
    "object_placement": [(r"placed\s+(?:neatly|deliberately|carefully|gently)", "deliberate"), (r"key\s+(?:found|placed|resting)\s+(?:on|beside|near|next to)", "key_placement"), (r"(?:brass|metal)\s+key", "brass_key"), (r"deliberately\s+(?:placed|left|positioned)", "deliberate")],
    "dead_frequency": [(r"dead\s+frequency", "dead_freq"), (r"tuned\s+to.*(?:dead|static|off[- ]air)", "tuned_dead"), (r"radio.*(?:on|tuned|playing)", "radio_on"), (r"(?:static|dead\s+air)", "static")],
    "trophy_taking": [(r"missing\s+(?:item|object|thing|belonging)", "missing_item"), (r"(?:took|taken|removed|stolen|missing)\s+(?:a\s+)?(?:item|mug|badge|folder|key)", "took_item")],
    "victim_vulnerability": [
        (r"(?:found|found\s+dead)\s+(?:alone|by\s+herself|by\s+himself)", "found_alone"), (r"(?:working|alone)\s+(?:at|in|during|after)\s+(?:night|late|evening)", "working_late"),
        (r"no\s+(?:indication|evidence)\s+(?:of\s+)?(?:struggle|fighting|defense)", "no_struggle"), (r"(?:doors?|entry)\s+were?\s+unlocked", "unlocked"),
    ],
    "occupational_targeting": [(r"(?:radio|frequency|broadcast|station|transmission)", "radio"), (r"(?:archive|archivist|records?|filing|catalog)", "archive"), (r"(?:key|lock|security|access|locksmith)", "locksmith")],
    "escalation": [(r"(?:interval|gap|period|spacing).*(?:increasing|growing|longer)", "escalating")],
}
NEAR = {
    "object_placement": ["body", "victim", "scene", "near", "beside"],
    "dead_frequency": ["radio", "frequency", "station", "transmission", "tuned"],
    "trophy_taking": ["missing", "took", "removed", "gap", "pegboard"],
    "victim_vulnerability": ["alone", "late", "night", "unlocked", "no struggle"],
    "occupational_targeting": ["radio", "locksmith", "archivist", "frequency"],
    "escalation": ["interval", "days", "since", "prior", "escalat"],
}
METHODS = {
    "entry": [(r"unlocked|no\s+(?:forced\s+)?entry", "unlocked_entry"), (r"forced\s+entry|broken", "forced_entry")],
    "targeting": [(r"alone", "alone"), (r"(?:late|night|evening)", "vulnerable_hours"), (r"(?:isolated|rural|detached|secluded)", "isolated")],
    "weapon": [(r"(?:rope|cord|wire|strap)", "ligature"), (r"(?:knife|blade|sharp)", "edged"), (r"(?:blunt|force|impact)", "blunt_force")],
}
COMMON = ["body", "victim", "scene", "found", "death", "killed", "murder", "crime", "evidence", "police", "officer", "case", "investigation", "suspect"]
REACH, SIGN_SHARE, METHOD_SHARE, BOTH = 100, 0.45, 0.30, 0.10
LEAST_TEXT, MONTHS = 50, 18


def _labels(found: list[tuple[Column, str]]) -> Column:
    return F.array_distinct(F.array_compact(F.array(*[F.when(hit, label) for hit, label in found])))


def pair_signs(cases: DataFrame) -> DataFrame:
    """Adds ``s_<family>`` and ``m_<kind>``, the labels found in ``text`` (null: none), and ``words``, its distinct words of four letters a to z or more.

    A sign counts where one of its family's words is within 100 characters of the pattern's first match.
    """
    low = F.lower(F.coalesce("text", F.lit("")))

    def near(pattern, family):
        at, size = F.regexp_instr(low, F.lit(pattern)), F.length(F.regexp_extract(low, pattern, 0))
        window = F.substring(low, F.greatest(at - REACH, F.lit(1)), at - 1 + size + REACH - F.greatest(at - 1 - REACH, F.lit(0)))
        return (at > 0) & window.rlike("|".join(NEAR[family]))

    signs = [_labels([(near(p, family), label) for p, label in patterns]).alias(f"s_{family}") for family, patterns in SIGNS.items()]
    methods = [_labels([(low.rlike(p), label) for p, label in patterns]).alias(f"m_{kind}") for kind, patterns in METHODS.items()]
    return cases.select("*", *signs, *methods, F.array_except(F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z]{4,}"), F.lit(0))), F.array(*map(F.lit, COMMON))).alias("words"))


def testable_pairs(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """Given pairs (a, b) whose texts both have 50 characters without the blanks at their ends, and whose days, where both are known, are at most 18 times 30 days apart: adds a_ and b_ columns of both cases."""
    return _near_in_time(pairs, cases.where(_long_enough()))


def _long_enough() -> Column:
    return F.length(cut(F.col("text"))) >= LEAST_TEXT


def _near_in_time(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        about = cases.select(F.col("case_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in cases.columns if c != "case_id"])
        pairs = pairs.join(about.hint("shuffle_merge"), side)
    return pairs.where(F.coalesce(F.abs(F.datediff("a_day", "b_day")) <= MONTHS * 30, F.lit(True)))


#: The bits of each family's and kind's labels in ``marks``.
_BITS: dict[str, dict[str, int]] = {}
for _prefix, _table in (("s", SIGNS), ("m", METHODS)):
    for _name, _patterns in _table.items():
        _used = sum(map(len, _BITS.values()))
        _BITS[f"{_prefix}_{_name}"] = {label: 1 << (_used + i) for i, label in enumerate(dict.fromkeys(label for _, label in _patterns))}


def _marks() -> Column:
    """All labels of a case as the bits of one long."""
    every = [F.when(F.array_contains(name, label), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")) for name, bits in _BITS.items() for label, bit in bits.items()]
    return reduce(lambda x, y: x + y, every)


def _share(name: str) -> Column:
    mask = F.lit(sum(_BITS[name].values())).cast("long")
    count = lambda bits: F.bit_count(bits.bitwiseAND(mask))
    a, b = F.col("a_marks"), F.col("b_marks")
    return count(a.bitwiseAND(b)) / F.greatest(count(a.bitwiseOR(b)), F.lit(1))


def level(share: Column) -> Column:
    return F.when(share >= 0.66, "strong").when(share >= 0.33, "moderate").when(share > 0, "weak").otherwise("none")


def _scored(pairs: DataFrame, cases: DataFrame, carried: list[str]) -> DataFrame:
    """The testable pairs with ``sign``, ``way``, ``score`` and the given columns of ``pair_signs``. Texts are dealt over many tasks, as a small file may hold many, and read once; pairs carry their marks."""
    marked = pair_signs(dealt(cases.where(_long_enough()), "case_id")).select("case_id", "day", _marks().alias("marks"), *carried)
    met = _near_in_time(pairs, Scratch(cases.sparkSession).write(marked))
    mean = lambda names: sum((_share(n) for n in names[1:]), _share(names[0])) / len(names)
    met = met.withColumn("sign", mean([f"s_{f}" for f in SIGNS])).withColumn("way", mean([f"m_{m}" for m in METHODS]))
    bonus = F.when((F.col("sign") > 0) & (F.col("way") > 0), BOTH).otherwise(0.0)
    return met.withColumn("score", F.floor(F.least(F.lit(100.0), (F.col("sign") * SIGN_SHARE + F.col("way") * METHOD_SHARE + bonus) * 100)).cast("int"))


def analyse_pairs(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """(a, b, score, signature, method, behaviours, surface_words) of the testable ones of the given pairs.

    score = whole part of min(100, 100 * (.45 * mean sign overlap + .30 * mean method overlap, and .10 where both are above 0)).
    ``behaviours``: at most five families that overlap, in the fixed order; ``surface_words``: the first five shared words by name, that don't count.
    """
    met = _scored(pairs, cases, ["words"])
    shown = F.slice(F.array_compact(F.array(*[F.when(_share(f"s_{f}") > 0, f.replace("_", " ")) for f in SIGNS])), 1, 5)
    return met.select("a", "b", "score", level(F.col("sign")).alias("signature"), level(F.col("way")).alias("method"), shown.alias("behaviours"), F.slice(F.array_sort(F.array_intersect("a_words", "b_words")), 1, 5).alias("surface_words"))


def pair_verdicts(pairs: DataFrame, cases: DataFrame, stored: DataFrame) -> DataFrame:
    """(a, b, score, backend): the stored score of a pair where there is one, else that of ``analyse_pairs``; pairs that aren't testable have none."""
    found = _scored(pairs, cases, []).select("a", "b", "score")
    known = stored.select("a", "b", F.col("score").alias("stored"))
    out = found.join(known.hint("shuffle_merge"), ["a", "b"], "left")
    return out.select("a", "b", F.coalesce("stored", "score").alias("score"), F.when(F.col("stored").isNotNull(), "stored").otherwise("heuristic").alias("backend"))
