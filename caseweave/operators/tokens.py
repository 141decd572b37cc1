"""Tokens that name nothing: word lists, the type of a candidate, the gate before the graph, headings and table rows."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word lists, patterns and types; what they hold decides what becomes a node.
TYPES = ["PERSON", "ORGANIZATION", "LOCATION", "VEHICLE", "PHONE_NUMBER", "FINANCIAL_ACCOUNT", "CASE_REFERENCE"]
PLATFORMS = [
    "telegram", "whatsapp", "signal", "instagram", "facebook", "facebook messenger", "twitter", "snapchat", "discord", "slack", "imessage", "facetime", "viber", "line", "wechat", "imo",
    "hike", "gpay", "phonepe", "paytm", "email", "sms", "text message", "voice call", "video call", "x", "gmail",
]
PAYMENTS = ["neft", "rtgs", "imps", "upi", "cash", "cheque", "check", "demand draft", "dd", "hawala", "crypto", "bitcoin", "transfer", "wire transfer", "bank transfer", "online transfer", "atm withdrawal", "credit card", "debit card", "net banking"]
OFFENCES = [
    "assault", "fraud", "extortion", "murder", "robbery", "theft", "burglary", "arson", "kidnapping", "trafficking", "smuggling", "ndps", "bribery", "corruption", "cybercrime", "forgery",
    "dacoity", "riot", "attempt to murder", "culpable homicide", "cheating", "criminal intimidation", "house trespass",
]
COLUMN_WORDS = (
    r"^(?:txn|transaction|sr\.?\s*no|serial|amount|date|time|timestamp|duration|reference|ref|id|number|status|type|mode|method|from|to|sender|receiver|caller|callee|balance|debit|credit|"
    r"amount_inr|amount_rs|phone_number|cell_tower|location_lat|location_lng|description|remarks|notes|source|category|victim|accused|complainant|investigating|officer|"
    r"name|age|gender|address|occupation|risk_level|state|district|police_station|fir_number|signature|overkill|staging|approach|control|weapon|"
    r"latitude|longitude|tower_id|imei|call_duration|bank_name|account_number|ifsc|branch)$"
)
SECTIONS = [
    "call detail records", "call detail record", "cdr", "field intelligence / surveillance", "field intelligence", "surveillance report", "surveillance", "financial transaction ledger", "financial transactions",
    "financial ledger", "transaction ledger", "socmint report", "socmint", "police master database dossier", "master database dossier", "dossier", "case file", "first information report", "fir",
    "haryana past cases", "past cases", "criminal history", "known addresses", "known aliases", "known associates", "associated phone", "associated phones", "national id hash", "national id", "aadhaar hash",
    "physical surveillance", "recent posts", "brief facts", "incident details", "crime details", "suspect details", "victim details", "witness details", "complainant details", "investigation details",
    "evidence", "seizure", "arrest details", "recovery", "modus operandi", "background",
]
METADATA = [
    "ids", "id", "fifth", "the bharat", "the bharatiya", "transit house", "house", "street", "road", "b-12", "a-1", "c-3", "full name", "first name", "last name", "contact number", "phone number", "mobile number",
    "associated phone", "call detail", "past cases", "haryana past cases", "username", "user id", "user name",
]
STATUTES = ["bharatiya", "bharatiya nyaya", "bharatiya nagarik", "immoral traffic", "narcotic drugs", "psychotropic", "sohna road industrial"]
PLACE_ENDS = ["road", "street", "nagar", "colony", "sector", "block", "district", "police", "station", "camp", "market", "bazaar", "mandi", "extension", "layout", "puram", "ville", "abad", "garh", "ganj", "pura"]
LABELS = {"PERSON": "PERSON", "PER": "PERSON", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION", "ORG": "ORGANIZATION", "NORP": "ORGANIZATION"}
LOWER_LINES, CAPITALS, CAMEL = r"^[a-z_]+(_[a-z_]+)+$", r"^[A-Z][A-Z_]+$", r"^[a-z]+([A-Z][a-z0-9]*)+$"
SCHEMA_LINES = r"^[a-z]+(_[a-z0-9]+)+$"
SHAPES = (  # (type, characters that don't matter, pattern)
    ("PHONE_NUMBER", "[ +-]", r"^[0-9]{7,15}$"),
    ("VEHICLE", "", r"(?i)^[A-Z]{2}[\s-]?[0-9]{1,2}[\s-]?[A-Z]{1,3}[\s-]?[0-9]{1,4}$"),
    ("CASE_REFERENCE", "", r"(?i)^(?:FIR|Case|CrPC|IPC)\s*[/-]?\s*[0-9]"),
    ("FINANCIAL_ACCOUNT", "[ ]", r"^[0-9]{9,18}$"),
    ("FINANCIAL_ACCOUNT", "", r"^[\w.+-]+@\w+$"),
)
TITLE_WORDS = r"^\p{Lu}\S*(?:\s+\p{Lu}\S*){0,3}$"


def cut(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_malformed(name: Column) -> Column:
    """Null, not 2 to 60 characters, less than six of ten letters, digits or blanks, a colon at the end, or a word twice."""
    t = cut(name)
    parts = words(F.lower(t))
    solid = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\s]", "")) >= 0.6 * F.length(t)
    return ~F.coalesce(F.length(t).between(2, 60) & solid & ~t.endswith(":") & (F.size(F.array_distinct(parts)) == F.size(parts)), F.lit(False))


def is_schema_word(name: Column) -> Column:
    """snake_case in any case, camelCase, or an offence as 2 to 8 capitals."""
    t = cut(name)
    return F.coalesce(F.lower(t).rlike(SCHEMA_LINES) | t.rlike(CAMEL) | (t.rlike(r"^[A-Z]{2,8}$") & F.lower(t).isin(OFFENCES)), F.lit(False))


def is_listed(name: Column) -> Column:
    """A platform, payment method, offence, heading, column word, part of a statute's name, or a label's shape."""
    t = cut(name)
    low = F.lower(t)
    statute = reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in STATUTES])
    all_upper = (F.upper(t) == t) & (low != t)
    return F.coalesce(low.isin(PLATFORMS + PAYMENTS + OFFENCES + SECTIONS + METADATA) | statute | low.rlike(COLUMN_WORDS) | low.rlike(LOWER_LINES) | t.rlike(CAPITALS) | (all_upper & (F.length(t) > 10)), F.lit(False))


def is_excluded(name: Column) -> Column:
    """True for what must never become an entity; null and empty names are malformed."""
    return is_malformed(name) | is_listed(name) | is_schema_word(name)


def entity_type(name: Column, label: Column) -> Column:
    """One of ``TYPES`` or null: listed words are none, then shapes, then the recogniser's label, then one to four capitalised words, then place words. Null is none."""
    t = cut(name)
    shaped = F.coalesce(*[F.when((F.regexp_replace(t, away, "") if away else t).rlike(pattern), kind) for kind, away, pattern in SHAPES])
    labelled = F.coalesce(*[F.when(label == x, kind) for x, kind in LABELS.items()])
    place = F.exists(words(F.lower(t)), lambda w: w.isin(PLACE_ENDS))
    return F.when(~is_listed(name), F.coalesce(shaped, labelled, F.when(t.rlike(TITLE_WORDS), "PERSON"), F.when(place, "LOCATION")))


@lru_cache(maxsize=1)
def _decompositions() -> list[tuple[str, str]]:
    """Characters of one unit whose compatibility form differs, but for CJK and Hangul syllables, with that form."""
    letters = [chr(c) for c in [*range(0xA0, 0x2E80), *range(0x3000, 0x3100), *range(0xFB00, 0xFB07), *range(0xFE50, 0xFFEF)]]
    return [(c, d) for c in letters if (d := unicodedata.normalize("NFKD", c)) != c]


def compatibility_form(text: Column) -> Column:
    """Unicode's compatibility decomposition (accents apart, full-width letters and ligatures as plain ones), but for CJK and Hangul, which stay. ASCII texts pass untouched; null stays null.

    Marks that follow each other stay in the order in which they stand.
    """
    table = F.create_map(*[F.lit(x) for pair in _decompositions() for x in pair])
    plain = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c < "\u00a0", c).otherwise(F.coalesce(F.try_element_at(table, c), c))), "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), plain).otherwise(text)


def plain_key(name: Column) -> Column:
    """Lower case, no punctuation at the end, single blanks, then the compatibility form."""
    return compatibility_form(F.regexp_replace(cut(F.regexp_replace(F.lower(cut(name)), r"[!-/:-@\[-`{-~]+$", "")), r"\s+", " "))


# Words that are no names by themselves, and what marks a name in its context.
REJECTED = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty",
    "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "the", "this", "that", "these", "those", "which", "where", "when", "how",
]
NUMBER_WORDS = REJECTED[:28]
DESCRIPTORS = [
    "single", "total", "details", "detail", "investigator", "file", "field", "type", "number", "page", "report", "summary", "section", "chapter", "part", "system", "network", "group", "team", "unit", "board", "council", "commission", "agency",
    "authority", "office", "department", "division", "branch", "cell", "radio", "station", "frequency", "signal", "channel", "wave", "broadcast", "transmission", "wireless",
]
NAMED_IN_CONTEXT = r"\b(?:known|called|referred|named|alias)(?=\s+(?:as\s+)?(\w+))"
NAME_MARKERS = [
    r"\b(?:mr|mrs|ms|dr|inspector|si|dsp|ssp|ig|sp|dgp|constable|sub[\s-]?inspector)\b", r"\b(?:accused|suspect|witness|victim|informant|arrested|detained)\b",
    r"\b(?:son\s+of|daughter\s+of|wife\s+of|husband\s+of|father\s+of|mother\s+of)\b", r"\b(?:known\s+as|called|referred\s+as|alias|aka)\b",
]


def candidate_verdict(name: Column, kind: Column, context: Column, hard: bool = True) -> Column:
    """struct(genuine, confidence, reason) of a candidate name of a guessed type in its surrounding text, by rules in this order.

    With ``hard``, common words are out at 95 before all else. Number words are out at 90; descriptors at 85 unless the text calls someone by them; persons of up to two characters at 80. Persons of two words or more are in at 85,
    names beside a title, a role, kinship or an alias at 75, the rest at 60. Case doesn't matter; a null name is empty, a null text says nothing. One pass over the text for all markers.
    """
    t, around, person = cut(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(context, F.lit(""))), F.coalesce(kind == "PERSON", F.lit(False))
    low = F.lower(t)
    called = F.array_contains(F.regexp_extract_all(around, F.lit(NAMED_IN_CONTEXT), 1), low)
    out = lambda genuine, confidence, reason: F.struct(F.lit(genuine).alias("genuine"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))
    rules = F.when(low.isin(REJECTED), out(False, 95, "common word")) if hard else F
    return (
        rules.when(low.isin(NUMBER_WORDS), out(False, 90, "number word"))
        .when(low.isin(DESCRIPTORS) & ~called, out(False, 85, "descriptor"))
        .when((F.length(t) <= 2) & person, out(False, 80, "short"))
        .when((F.size(words(t)) >= 2) & person, out(True, 85, "several words"))
        .when(around.rlike("|".join(NAME_MARKERS)), out(True, 75, "marked in context"))
        .otherwise(out(True, 60, "no objection"))
    )


def gate_reason(name: Column, kind: Column) -> Column:
    """Why a candidate goes to review: malformed, type, excluded word or schema word; null where it is admitted."""
    return (
        F.when(is_malformed(name), "malformed")
        .when(~F.coalesce(kind.isin(TYPES), F.lit(False)), "type")
        .when(plain_key(name).isin(PLATFORMS + PAYMENTS + OFFENCES), "excluded word")
        .when(is_schema_word(name), "schema word")
    )


def gate(candidates: DataFrame, name: str = "name", kind: str = "entity_type") -> tuple[DataFrame, DataFrame]:
    """(admitted, for review with ``gate_reason``): every row is in one of them."""
    judged = candidates.withColumn("gate_reason", gate_reason(F.col(name), F.col(kind)))
    return judged.where("gate_reason IS NULL").drop("gate_reason"), judged.where("gate_reason IS NOT NULL")


def name_verdict(name: Column, kind: Column) -> Column:
    """empty or excluded names are invalid; a person of one word is ``partial``, the rest ``ok``."""
    t = cut(name)
    return F.when(F.coalesce(t, F.lit("")) == "", "empty").when(is_excluded(name), "excluded").when((kind == "PERSON") & (F.size(words(t)) == 1), "partial").otherwise("ok")


def without_headings(text: Column, headings: list[str]) -> Column:
    """The text without heading lines: a known heading, or 3 to 40 characters all in capitals before a line that isn't blank. Null stays null."""
    lines = F.split(text, "\n")

    def kept(line, i):
        t = cut(line)
        known = F.lower(F.regexp_replace(t, ":+$", "")).isin(headings)
        capitals = (F.upper(t) == t) & (F.lower(t) != t) & F.length(t).between(3, 40)
        return ~(known | (capitals & (cut(F.coalesce(F.get(lines, i + 1), F.lit(""))) != "")))

    return F.array_join(F.filter(lines, kept), "\n")


def table_row(headers: Column, cells: Column, kept: list[str]) -> Column:
    """Cells under a known header or none, joined by bars; blank cells and those under any other header are left out. Null where nothing is left."""
    names = F.transform(headers, lambda h: F.lower(cut(h)))
    header = lambda i: F.coalesce(F.get(names, i), F.lit(""))
    good = F.filter(F.transform(cells, lambda c, i: F.when((cut(c) != "") & ((header(i) == "") | header(i).isin(kept)), cut(c))), lambda c: c.isNotNull())
    return F.when(F.size(good) > 0, F.array_join(good, " | "))
