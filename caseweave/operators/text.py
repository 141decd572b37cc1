"""Mentions and indicators in texts, by built-in regular expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Formats of mentions.
PHONE = r"(?:\+91[-\s]?)?0?[6-9]\d{9}\b|\d{3}[-.\s]\d{3}[-.\s]\d{4}\b|\(\d{3}\)\s*\d{3}[-.\s]\d{4}"
VEHICLE = r"(?i)\b[A-Z]{2}[\s-]?\d{1,2}[\s-]?[A-Z]{1,3}[\s-]?\d{1,4}\b|\b\d{1,2}-[A-Z]{3}-\d{4}\b"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE = rf"(?i)\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b|\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\b|\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
AMOUNT = r"(?i)(?:₹|Rs\.?|INR|USD|\$)\s*([\d,]+(?:\.\d{2})?)"
HANDLE = r"(?:^|[^\w.@])@(\w[\w.]{0,29})"
#: kind, entity type, pattern, confidence, rank
MENTIONS = (("phone", "Phone", PHONE, 0.95), ("vehicle", "Vehicle", VEHICLE, 0.90), ("date", "Event", DATE, 0.85), ("email", "Phone", EMAIL, 0.85))

# Severity of words in evidence texts.
SEVERITY = {
    "murder": 1.0, "homicide": 1.0, "kill": 0.9, "killed": 0.9, "terrorism": 1.0, "terror": 1.0, "rape": 0.9, "sexual assault": 0.85, "arson": 0.8, "bomb": 0.85,
    "robbery": 0.7, "armed robbery": 0.8, "dacoity": 0.75, "assault": 0.7, "gbh": 0.7, "grievous": 0.7, "kidnapping": 0.75, "abduction": 0.7,
    "drug": 0.5, "ndps": 0.5, "narcotics": 0.5, "trafficking": 0.5, "smuggling": 0.5, "possession": 0.4, "extortion": 0.5, "blackmail": 0.5, "ransom": 0.5,
    "fraud": 0.3, "cheating": 0.3, "forgery": 0.3, "theft": 0.3, "burglary": 0.3, "stealing": 0.3, "money laundering": 0.4, "hawala": 0.4,
    "corruption": 0.3, "bribery": 0.3, "illegal": 0.3, "unlawful": 0.3,
}
# Signs that a text clears rather than implicates.
NEGATION = (
    r"\bcleared?\b|\bexonerated\b|\bacquitted\b|\bfalse(?:ly)?\s+accus|\bwrongfully\s+accus|\bnot\s+implicated\b|\bno\s+evidence\b|\bdismissed\b|\bexonerat|\binnocent\b"
    r"|\bnot\s+charged\b|\bdropped\s+charges?\b|\bwitness(?:es)?\s+(?:only|merely|just)\b|\bpresent\s+at\b|\bmerely\s+present\b|\bnot\s+involved\b|\bno\s+involvement\b"
)
# Signature terms.
SIGNATURE_TERMS = (
    "overkill", "staged", "posed", "trophy", "ritualistic", "signature", "escalat", "pattern", "ritual", "placed", "deliberately", "neatly", "dead frequency", "static only", "off-air",
    "missing item", "gap", "took", "occupational", "radio", "frequency", "locksmith", "archivist", "key", "syndicate", "network", "ring", "cartel", "faction", "courier", "mule", "stash",
    "safe house", "drop point", "cut-out", "cutout", "front", "shell company", "hawala", "hundi", "layering", "placement", "proceeds", "laundering", "account", "phone tree", "burner", "swap",
    "coded", "coded language", "territory", "turf", "territorial", "enforcer", "lieutenant", "kingpin", "financier", "smuggling", "trafficking", "route", "corridor", "extortion", "protection",
    "racket", "circular", "round-trip", "round trip", "kickback", "ghost employee", "fake invoice", "benami", " shell ", "dummy",
)

# Fields of a case header, alternatives in order.
HEADER = {
    "case_number": (r"FIR\s*(?:No\.?|Number|#)?\s*:?\s*([A-Z0-9\-/]+(?:\d{4})?(?:/\d{4})?)", r"Case\s*(?:No\.?|Number|#)?\s*:?\s*([A-Z0-9\-/]+)", r"FIR\s+(?:No\.?\s*)?(\d+/\d{4})"),
    "subject": (r"Subject\s*:?\s*(.+?)(?:\n|$)", r"Re\s*:?\s*(.+?)(?:\n|$)", r"Subject:\s*(.+?)(?:\n|$)"),
    "police_station": (r"(?:Police\s+Station|P\.?S\.?|Station)\s*:?\s*(.+?)(?:\n|$)", r"Station\s*:?\s*(.+?)(?:\n|$)"),
    "date_filed": (r"Date\s+(?:of\s+)?(?:Report|Filed|Filing)\s*:?\s*(\d{1,2}[-/]\w+[-/]\d{2,4})", r"Date\s*:?\s*(\d{1,2}[-/]\w+[-/]\d{2,4})", r"Filed\s+(?:on\s+)?(\d{1,2}[-/]\w+[-/]\d{2,4})"),
    "complainant": (r"Complainant\s*(?:Details|Name)?\s*:?\s*\n?\s*Name\s*:?\s*(.+?)(?:\n|$)", r"Complainant\s*:?\s*(?:Name\s*:?\s*)?(.+?)(?:\n|$)"),
    "investigating_officer": (r"Investigating\s+Officer\s*:?\s*\n?\s*Name\s*:?\s*(.+?)(?:\n|$)", r"I\.?O\.?\s*:?\s*(.+?)(?:\n|$)"),
    "act_sections": (r"(?:Act|Statute)\s*\(?(?:s?\)?)\s*&?\s*Section\(s?\)\s*:?\s*(.+?)(?:\n|$)", r"Section\s+(\d+[a-z]?(?:\(\d+\))?(?:\s*,?\s*\d+[a-z]?(?:\(\d+\))?)*)"),
    "jurisdiction": (r"(?:District|Jurisdiction)\s*:?\s*(.+?)(?:\n|$)", r"P\.?S\.\s+.+?,\s*(.+?)(?:\n|$)"),
}


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def mentions(docs: DataFrame) -> DataFrame:
    """Typed mentions (doc_id, case_id, kind, entity_type, name, confidence, pos); the first of equal names in a text wins, in the order of ``MENTIONS``.

    Phones keep their last 10 digits, vehicles need 6 characters and are upper-cased, amounts are never mentions. Null texts have none.
    """
    clean = {"phone": lambda x: F.right(digits(x), F.lit(10)), "vehicle": F.upper}

    def hits(kind: str, pattern: str) -> Column:
        name = clean.get(kind, F.trim)
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda x, i: F.struct(F.lit(kind).alias("kind"), name(x).alias("name"), i.alias("pos")))

    found = [hits(kind, pattern) for kind, _, pattern, _ in MENTIONS]
    rows = docs.select("doc_id", "case_id", F.explode(F.concat(*found)).alias("m")).select("doc_id", "case_id", "m.*").where("kind <> 'vehicle' OR length(name) >= 6")
    info = F.create_map(*[x for i, (kind, entity_type, _, conf) in enumerate(MENTIONS) for x in (F.lit(kind), F.struct(F.lit(i).alias("rank"), F.lit(entity_type).alias("entity_type"), F.lit(conf).alias("confidence")))])
    rows = rows.withColumn("i", info[F.col("kind")])
    first = Window.partitionBy("doc_id", F.lower("name")).orderBy("i.rank", "pos")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("doc_id", "case_id", "kind", F.col("i.entity_type").alias("entity_type"), "name", F.col("i.confidence").alias("confidence"), "pos")


def amounts(text: Column) -> Column:
    """Currency amounts of a text as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))


def handles(docs: DataFrame) -> DataFrame:
    """At-sign handles outside of addresses: (doc_id, handle), one row each."""
    return docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(HANDLE), F.lit(1)))).alias("handle"))


#: One of these stands in every text that ``NEGATION`` matches.
NEGATION_STEMS = ("clear", "exonerat", "acquitted", "false", "wrongfully", "implicated", "evidence", "dismissed", "innocent", "charge", "witness", "present", "involve")


def severity(text: Column, low: Column | None = None) -> Column:
    """Largest severity of a word in the text, times .15 if the text clears; 0 for null and below 10 characters. ``low``: the lowered text, where a column has it already."""
    low = F.lower(text) if low is None else low
    worst = F.greatest(*[F.when(F.contains(low, F.lit(w)), F.lit(s)).otherwise(0.0) for w, s in SEVERITY.items()])
    clears = reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in NEGATION_STEMS]) & low.rlike(NEGATION)
    return F.when(F.coalesce(F.length(text), F.lit(0)) < 10, 0.0).otherwise(worst * F.when(clears, 0.15).otherwise(1.0))


def severity_level(score: Column) -> Column:
    return F.when(score >= 0.7, "strong").when(score >= 0.4, "moderate").when(score > 0, "weak").otherwise("none")


def signature_terms(text: Column, terms=SIGNATURE_TERMS) -> Column:
    """Terms that the lowered text contains."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(text), t))


def capitalised_runs(docs: DataFrame, most: int = 4) -> DataFrame:
    """Candidate names: runs of two to ``most`` capitalised words of any alphabet's letters, one row per document and name."""
    word, inside = r"\p{Lu}\p{M}*\p{Ll}[\p{Ll}\p{M}]*", r"[\p{L}\p{M}\p{N}_]"
    runs = F.regexp_extract_all("text", F.lit(rf"(?<!{inside}){word}(?:[ ]{word}){{1,{most - 1}}}(?!{inside})"), F.lit(0))
    return docs.select("doc_id", F.explode(F.array_distinct(runs)).alias("name"))


def neighbours(items: DataFrame, window: int = 20) -> DataFrame:
    """Co-occurrence of each item with the next ``window`` - 1 of its document: (doc_id, src, dst); items: (doc_id, pos, name)."""
    w = Window.partitionBy("doc_id").orderBy("pos", "name").rowsBetween(1, window - 1)
    return items.withColumn("next", F.collect_list("name").over(w)).select("doc_id", F.col("name").alias("src"), F.explode("next").alias("dst")).where("src <> dst")


def first_date(text: Column, default_year: int = 2026) -> Column:
    """The first English month and day, with the default year where none follows; null for an impossible date."""
    pattern = rf"({MONTHS})\s+(\d{{1,2}})(?:,?\s+(\d{{4}}))?"
    year = F.coalesce(F.nullif(F.regexp_extract(text, pattern, 3), F.lit("")), F.lit(str(default_year)))
    raw = F.concat_ws(" ", F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2), year)
    return F.try_to_timestamp(raw, F.lit("MMMM d yyyy")).cast("date")


def strip_labels(text: Column, kept_labels: list[str]) -> Column:
    """Line by line: values of the kept labels, plain lines as they are; lines of other labels go."""
    label = lambda x: F.lower(F.trim(F.regexp_extract(x, r"^\s*([A-Za-z][A-Za-z /]{0,40}):", 1)))
    value = lambda x: F.trim(F.regexp_replace(x, r"^\s*[A-Za-z][A-Za-z /]{0,40}:", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: (label(x) == "") | label(x).isin(kept_labels))
    return F.array_join(F.transform(lines, lambda x: F.when(label(x) == "", x).otherwise(value(x))), "\n")


def case_header(docs: DataFrame) -> DataFrame:
    """(doc_id, fields of ``HEADER``, name, description, accused array<struct<name, alias, role, status>>) of a text; empty where no alternative fits, the first that fits counts.

    Fields end after 200 characters, the name (subject, else the number) after 150, the description after 500. Accused come from rows ``1 | name | alias | role | status``. Null texts have empty fields.
    Letters, digits and spaces are those of Unicode, and only a newline ends a line.
    """
    text = F.coalesce("text", F.lit(""))
    first = lambda ps: F.substring(F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, f"(?iUd){p}", 1)), F.lit("")) for p in ps], F.lit("")), 1, 200)
    section = F.regexp_extract(text, r"(?isUd)(Accused\s+Persons?\s+Named.*?)(?:Investigating|$)", 1)
    cells = F.transform(F.regexp_extract_all(section, F.lit(r"(?Ud)\d+\s*\|\s*(.+?)(?:\n|$)"), F.lit(1)), lambda r: F.filter(F.transform(F.split(r, r"\|"), lambda c: F.trim(c)), lambda c: c != ""))
    cell = lambda c, i: F.coalesce(F.get(c, F.lit(i)), F.lit(""))
    people = F.transform(
        F.filter(cells, lambda c: (F.size(c) > 0) & (F.length(cell(c, 0)) > 2) & ~F.startswith(cell(c, 0), F.lit("#"))),
        lambda c: F.struct(cell(c, 0).alias("name"), F.regexp_replace(cell(c, 1), "^--$", "").alias("alias"), cell(c, 2).alias("role"), F.when(F.size(c) > 3, F.element_at(c, -1)).otherwise("").alias("status")),
    )
    facts = F.substring(F.trim(F.regexp_extract(text, r"(?isUd)Brief\s+Facts?\s+(?:of\s+the\s+)?Case\s*:?\s*(.+?)(?:Accused|Investigating|$)", 1)), 1, 500)
    out = docs.select("doc_id", *[first(ps).alias(f) for f, ps in HEADER.items()], facts.alias("description"), people.alias("accused"))
    name = F.when(F.col("subject") != "", F.substring("subject", 1, 150)).when(F.col("case_number") != "", F.concat(F.lit("Case "), "case_number")).otherwise("")
    return out.withColumn("name", name)


# Alias phrases, words that deny an event and how far before it they stand.
_FULL, _SHORT = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", r"([A-Z][a-zA-Z\s]+)"
ALIASES = (rf"(?i){_FULL}\s*,\s*alias(?:es)?\s+{_SHORT}", rf"(?i){_FULL}\s+(?:aka|a\.k\.a\.)\s+{_SHORT}", rf"(?i){_FULL}\s*,?\s+also\s+known\s+as\s+{_SHORT}", rf"(?m){_FULL}\s*\({_SHORT}\)\s*$")
DENIAL = r"\b(?:no|not|never|without|failed\s+to|were?\s+not|was\s+not|did\s+not|no\s+evidence|ruled\s+out)\b"
BEFORE_EVENT = 80


def alias_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, name, alias) of phrases that name a person twice; null texts give none."""
    found = F.flatten(F.array(*[F.arrays_zip(F.regexp_extract_all("text", F.lit(p), 1).alias("p"), F.regexp_extract_all("text", F.lit(p), 2).alias("q")) for p in ALIASES]))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    pairs = docs.where("text IS NOT NULL").select("doc_id", F.explode(found).alias("x")).select("doc_id", bare("x.p").alias("name"), bare("x.q").alias("alias"))
    return pairs.where("length(name) > 2 AND length(alias) > 1")


def fold_aliases(named: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mentions (doc_id, name) with the primary name instead of an alias of the same document."""
    primary = pairs.groupBy("doc_id", F.lower("alias").alias("low")).agg(F.min("name").alias("primary"))
    return named.withColumn("low", F.lower("name")).join(primary.hint("shuffle_merge"), ["doc_id", "low"], "left").withColumn("name", F.coalesce("primary", "name")).drop("low", "primary")


def number_amounts(text: Column) -> Column:
    """All numbers of a text as doubles, commas left out; null text gives none."""
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\d,]+(?:\.\d+)?"), 0)
    return F.filter(F.transform(hits, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull())


def event_check(text: Column, keyword: str, low: Column | None = None) -> Column:
    """struct(occurred, confidence): whether a text names an event with nothing in the 80 characters before that denies it. ``low``: the lowered text, where a column has it already."""
    low = F.lower(F.coalesce(text, F.lit(""))) if low is None else low
    at = F.locate(keyword.lower(), low)
    before = F.substring(low, F.greatest(F.lit(1), at - BEFORE_EVENT), F.least(at - 1, F.lit(BEFORE_EVENT)))
    denied = before.rlike(DENIAL)
    confidence = F.when(at == 0, 30).when(denied, 75).otherwise(50)
    return F.struct(((at > 0) & ~denied).alias("occurred"), confidence.alias("confidence"))


def with_verdicts(docs: DataFrame, verdicts: DataFrame, heuristic: Column) -> DataFrame:
    """Adds ``verdict``: that stored under the text's digest, else the heuristic one."""
    key = F.substring(F.sha2(F.lower(F.trim(F.coalesce("text", F.lit("")))), 256), 1, 16)
    return docs.withColumn("key", key).join(verdicts.select("key", F.col("verdict").alias("stored")).hint("shuffle_merge"), "key", "left").withColumn("verdict", F.coalesce("stored", heuristic)).drop("stored")


#: Scores of the levels of a verdict.
IMPLICATION = {"none": 0.0, "weak": 0.3, "moderate": 0.6, "strong": 1.0}


def normal_verdict(answer: Column, levels: dict[str, float] = IMPLICATION) -> Column:
    """struct(level, score) of an answer in JSON: an unknown level is none, a score is held to 0..1, a missing one is its level's; broken JSON is none."""
    raw = F.from_json(answer, "implication_level string, severity_score string")
    level = F.lower(F.coalesce(raw["implication_level"], F.lit("none")))
    level = F.when(level.isin(list(levels)), level).otherwise("none")
    usual = F.create_map(*[F.lit(x) for item in levels.items() for x in item])[level]
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw["severity_score"].try_cast("double")))
    return F.struct(level.alias("level"), F.coalesce(F.when(raw["severity_score"].try_cast("double").isNotNull(), score), usual).alias("score"))


def case_texts(docs: DataFrame) -> DataFrame:
    """(case_id, text): the non-empty texts of each case in the order of doc_id, with a blank line between."""
    kept = docs.where("trim(text) <> ''").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("x"))
    return kept.select("case_id", F.array_join(F.transform("x", lambda d: d["text"]), "\n\n").alias("text"))


def validation_flags(phone: Column, vehicle: Column, day: Column) -> Column:
    """Array of what looks wrong with a phone, a vehicle number or a date (1900 to 2100); values are flagged, never dropped."""
    wrong = lambda value, pattern: value.isNotNull() & ~value.rlike(f"^(?:{pattern})$")
    return F.array_compact(F.array(F.when(wrong(phone, PHONE), "phone"), F.when(wrong(vehicle, VEHICLE), "vehicle"), F.when(day.isNotNull() & ~F.year(day).between(1900, 2100), "date")))
