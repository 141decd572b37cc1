"""Filters of alerts, cases, entities, edges and locations. All are column predicates that reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that are no places, place words, place types, tower prefix.
NO_PLACES = ["north zone", "south zone", "processed", "contact", "unprocessed", "pending review", "flagged", "reviewed", "closed"]
PLACE_WORDS = ["colony", "nagar", "sector", "market", "road", "junction", "crossing", "toll", "plaza", "industrial", "area", "godown", "shop", "hospital", "station", "bus", "park", "gate"]
PLACE_TYPES = ["tower", "crime_scene", "safe_house", "meeting_point"]
TOWER = "RTP-"
LEVELS = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "MINIMAL": 0}


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Rows equal to every given value; a value of None asks for nothing. Strings match exactly."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def matching_any_case(rows: DataFrame, **wanted) -> DataFrame:
    """As ``matching``, whatever the case of letters."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.lower(column) == value.lower())
    return rows


def newest(rows: DataFrame, time: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows, the newest first, ties by key."""
    return rows.orderBy(F.col(time).desc(), F.col(key)).offset(offset).limit(limit)


def containing(rows: DataFrame, term: str, *columns: str) -> DataFrame:
    """Rows where one of the columns contains the term, whatever the case."""
    found = F.lit(False)
    for column in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(term.lower()))
    return rows.where(found)


def not_archived(cases: DataFrame, status: str | None = None) -> DataFrame:
    """Cases of a status; archived ones only if asked for."""
    return cases.where(F.col("status") == status) if status else cases.where(~F.col("status").eqNullSafe("Archived"))


def edges_of_types(edges: DataFrame, types: list[str] | None = None, min_confidence: float = 0.0) -> DataFrame:
    """Edges whose array ``types`` holds one of the given ones, from a confidence on."""
    edges = edges.where(F.coalesce(F.col("confidence"), F.lit(0.0)) >= min_confidence)
    return edges if types is None else edges.where(F.arrays_overlap("types", F.array(*[F.lit(t) for t in types])))


def people_only(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without locations, without presence edges and without edges to what is gone."""
    kept = nodes.where("entity_type <> 'Location'")
    ids = kept.select("id")
    rest = edges.where("rel_type <> 'Location Presence'")
    for end in ("src", "dst"):
        rest = rest.join(ids.withColumnRenamed("id", end).hint("shuffle_merge"), end, "left_semi")
    return kept, rest.select(edges.columns)


def is_real_location(name: Column, has_address: Column, place_type: Column) -> Column:
    """Whether a location's name, address or type shows that it is a place."""
    low = F.lower(F.trim(name))
    words = F.lit(False)
    for word in PLACE_WORDS:
        words = words | F.contains(low, F.lit(word))
    return ~low.isin(NO_PLACES) & (name.startswith(TOWER) | has_address | F.coalesce(place_type.isin(PLACE_TYPES), F.lit(False)) | words)


def busy_towers(presence: DataFrame, minimum: int) -> DataFrame:
    """Towers with at least ``minimum`` presence rows: location, n."""
    return presence.where(F.col("location").startswith(TOWER)).groupBy("location").agg(F.count("*").alias("n")).where(F.col("n") >= minimum)


def valid_at(presence: DataFrame, day: str) -> DataFrame:
    """Rows whose span of first_day to last_day holds the day; an open end goes on."""
    return presence.where((F.col("first_day") <= day) & (F.col("last_day").isNull() | (F.col("last_day") >= day)))


def from_level(rows: DataFrame, level: str | None, column: str = "level") -> DataFrame:
    """Rows of a level or a higher one; None asks for all."""
    if level is None:
        return rows
    return rows.where(F.col(column).isin([name for name, rank in LEVELS.items() if rank >= LEVELS[level]]))


def is_burner(attributes: Column) -> Column:
    """Whether a map of attributes marks a phone as unregistered or a burner; a null or empty map doesn't."""
    known = F.coalesce(attributes, F.create_map().cast("map<string,string>"))
    dump = F.lower(F.to_json(known))
    flags = (known["registered"] == "false") | (known["registration_status"] == "unregistered") | (known["is_burner"] == "true")
    return F.coalesce(flags, F.lit(False)) | F.contains(dump, F.lit("unregistered")) | F.contains(dump, F.lit("burner"))


def edges_between(edges: DataFrame, first: str | None = None, last: str | None = None, min_weight: float = 0.0) -> DataFrame:
    """Edges seen in a range of days, from a weight on."""
    out = edges.where(F.col("weight") >= min_weight)
    out = out.where(F.col("last_ts") >= F.lit(first).cast("timestamp")) if first else out
    return out.where(F.col("first_ts") <= F.lit(last).cast("timestamp")) if last else out


def similar_identifiers(rows: DataFrame, column: str, term: str, most: int = 1, prefix: int = 3) -> DataFrame:
    """Rows whose identifier contains the term, or has its first characters and is at most ``most`` edits away."""
    low, term = F.lower(F.col(column)), term.lower()
    near = F.levenshtein(low, F.lit(term), most)
    return rows.where(F.contains(low, F.lit(term)) | (low.startswith(term[:prefix]) & (near >= 0)))
