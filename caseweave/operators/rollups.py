"""Roll-ups for reports, joins of findings with their entities, corroborating signals and clusters of cases."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave.operators.graph import TYPE_WEIGHTS, canonical_entities, roll_up_edges
from caseweave.plans.blocks import dealt
from caseweave.plans.fixpoint import connected_components
from caseweave.plans.scratch import Scratch

# Roles whose edges don't count, states of an alert, weights of signals.
EXCLUDED_ROLES = "witness|victim|complainant"
STATES = ["New", "Under Review", "Confirmed", "Dismissed"]
SIGNALS = {"identical_phone": 1.0, "identical_address": 0.8, "identical_dob": 0.9, "identical_father_name": 0.85, "identical_physical": 0.7, "shared_associates": 0.5, "shared_case": 0.2}


def resolved_edges(entities: DataFrame, edges: DataFrame, include_witnesses: bool = False) -> DataFrame:
    """Edges (src, dst by entity_id) between the canonical names of their ends, with ``skip``: null, or why the graph leaves the edge out.

    ``unmapped``: an end is no live entity; ``self_loop``: both ends are one name; ``role``: the justification names a witness, victim or complainant.
    """
    named = entities.where("merged_into IS NULL").select("entity_id", F.expr("lower(trim(name))").alias("norm"))
    ends = edges
    for end in ("src", "dst"):
        ends = ends.join(named.select(F.col("entity_id").alias(end), F.col("norm").alias(f"{end}_name")).hint("shuffle_merge"), end, "left")
    unmapped = F.col("src_name").isNull() | F.col("dst_name").isNull()
    role = F.lit(False) if include_witnesses else F.lower(F.coalesce("justification", F.lit(""))).rlike(EXCLUDED_ROLES)
    return ends.withColumn("skip", F.when(unmapped, "unmapped").when(F.col("src_name") == F.col("dst_name"), "self_loop").when(role, "role"))


def resolved_graph(entities: DataFrame, edges: DataFrame, include_witnesses: bool = False, type_weights: dict[str, float] = TYPE_WEIGHTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counters) of the graph of canonical names: see ``canonical_entities``, ``roll_up_edges`` and ``resolved_edges``."""
    ends = resolved_edges(entities, edges, include_witnesses)
    kept = ends.where("skip IS NULL").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "rel_type", "case_id", "ts", "severity", "weight")
    counters = ends.groupBy(F.coalesce("skip", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))
    return canonical_entities(entities), roll_up_edges(kept, type_weights), counters


def named_ends(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the name and type of both ends, null for unknown ones."""
    for end in ("src", "dst"):
        about = entities.select(F.col("entity_id").alias(end), F.col("name").alias(f"{end}_name"), F.col("entity_type").alias(f"{end}_type"))
        edges = edges.join(about.hint("shuffle_merge"), end, "left")
    return edges


def person_at_location(edges: DataFrame) -> DataFrame:
    """(person, location, ...) of edges with src_type and dst_type of which one is a location, whichever side that is."""
    one = edges.where("(src_type = 'Location') <> (dst_type = 'Location')")
    there = F.col("src_type") == "Location"
    return one.withColumn("person", F.when(there, F.col("dst")).otherwise(F.col("src"))).withColumn("location", F.when(there, F.col("src")).otherwise(F.col("dst"))).drop("src", "dst", "src_type", "dst_type")


def shared_values(pairs: DataFrame, attributes: DataFrame) -> DataFrame:
    """(a, b, kind, n): values that both entities of a given pair have, by kind of attribute."""
    have = attributes.where("value IS NOT NULL").select("entity_id", "kind", "value").distinct()
    a = have.select(F.col("entity_id").alias("a"), "kind", "value")
    b = have.select(F.col("entity_id").alias("b"), "kind", "value")
    met = pairs.select("a", "b").distinct().join(a.hint("shuffle_merge"), "a").join(b.hint("shuffle_merge"), ["b", "kind", "value"])
    return met.groupBy("a", "b", "kind").agg(F.count("*").alias("n"))


def shared_associates(pairs: DataFrame, edges: DataFrame, minimum: int = 2) -> DataFrame:
    """(a, b, n): neighbours that both entities of a given pair have, from ``minimum`` on."""
    scratch = Scratch(edges.sparkSession)
    asked = pairs.select("a", "b").distinct()
    members = asked.select(F.explode(F.array("a", "b")).alias("entity_id")).distinct()
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("entity_id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("entity_id"), F.col("src").alias("other")))).alias("x")).select("x.*")
    near = scratch.write(dealt(ends, "entity_id").join(members.hint("shuffle_merge"), "entity_id", "left_semi").distinct())  # edges are read once, and kept where a pair asks
    a = near.select(F.col("entity_id").alias("a"), "other")
    b = near.select(F.col("entity_id").alias("b"), "other")
    met = dealt(dealt(asked, "a").join(a.hint("shuffle_merge"), "a"), "b", "other").join(b.hint("shuffle_merge"), ["b", "other"])
    return met.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= minimum)


def signals(pairs: DataFrame, attributes: DataFrame, edges: DataFrame, cases: DataFrame) -> DataFrame:
    """(a, b, signals, n_signals, weight) of given pairs that something corroborates: equal phone, address, dob, father_name or physical values, shared associates, a shared case."""
    kinds = shared_values(pairs, attributes).where(F.concat(F.lit("identical_"), "kind").isin(list(SIGNALS))).select("a", "b", F.concat(F.lit("identical_"), "kind").alias("signal"))
    friends = shared_associates(pairs, edges).select("a", "b", F.lit("shared_associates").alias("signal"))
    case = cases.select("entity_id", F.lit("case").alias("kind"), F.col("case_id").cast("string").alias("value"))
    same = shared_values(pairs, case).select("a", "b", F.lit("shared_case").alias("signal"))
    weight = F.create_map(*[F.lit(x) for item in SIGNALS.items() for x in item])
    every = kinds.union(friends).union(same).withColumn("weight", weight[F.col("signal")])
    return every.groupBy("a", "b").agg(F.array_sort(F.collect_set("signal")).alias("signals"), F.count("*").alias("n_signals"), F.sum("weight").alias("weight"))


def shared_identifiers(attributes: DataFrame, minimum: int = 2) -> DataFrame:
    """Alerts (kind, value, entities, cases) of attribute values that several entities have; no pairs are made."""
    return attributes.where("value IS NOT NULL").groupBy("kind", "value").agg(F.count_distinct("entity_id").alias("entities"), F.count_distinct("case_id").alias("cases")).where(F.col("entities") >= minimum)


def apply_reviews(alerts: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts with their new status and note, refused reviews with the reason): a state must be known, and a dismissal needs a note."""
    reason = F.when(~F.coalesce(F.col("new_status").isin(STATES), F.lit(False)), "unknown state").when((F.col("new_status") == "Dismissed") & (F.trim(F.coalesce("note", F.lit(""))) == ""), "dismissal without note")
    judged = reviews.withColumn("reason", reason)
    good = judged.where("reason IS NULL").select("alert_id", "new_status", "note")
    out = alerts.join(good.hint("shuffle_merge"), "alert_id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")
    return out, judged.where("reason IS NOT NULL")


def alert_stats(alerts: DataFrame) -> DataFrame:
    """One row: alerts in all and by state, and those of high severity that are still open."""
    active = (F.col("severity") == "high") & F.col("status").isin(STATES[:2])
    return alerts.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower().replace(" ", "_")) for s in STATES], F.count_if(active).alias("high_severity_active"))


def partial_identities(entities: DataFrame) -> DataFrame:
    """One row per (name, entity_type) with a partial record: the smallest case and its reason."""
    return entities.where("partial").groupBy("name", "entity_type").agg(F.min(F.struct("case_id", "reason")).alias("first")).select("name", "entity_type", "first.case_id", "first.reason")


def most_connected(entities: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` entities of each case with most edges: case_id, entity_id, edges, place. Entities without edges count 0."""
    counts = edge_counts(edges)
    ranked = entities.join(counts.hint("shuffle_merge"), "entity_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("long")))
    order = Window.partitionBy("case_id").orderBy(F.col("edges").desc(), "entity_id")
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("case_id", "entity_id", "edges", "place")


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges that touch each entity; a self loop touches once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("entity_id"))
    return ends.groupBy("entity_id").agg(F.count("*").alias("edges"))


def chain_status(log: DataFrame) -> DataFrame:
    """One row: entries, chained and unchained ones, and the last block's index and hash."""
    chained = F.col("block_hash").isNotNull()
    last = F.max_by(F.struct("block_index", "block_hash"), F.when(chained, F.col("block_index")))
    out = log.agg(F.count("*").alias("total"), F.count_if(chained).alias("chained"), F.count_if(~chained).alias("unchained"), last.alias("last"))
    return out.select("total", "chained", "unchained", "last.block_index", F.substring("last.block_hash", 1, 16).alias("block_hash"), F.when(F.col("unchained") > 0, "partial").otherwise("full").alias("integrity"))


def linkage_stats(clusters: DataFrame) -> DataFrame:
    """One row: clusters by band of average confidence."""
    c = F.col("avg_confidence")
    return clusters.agg(F.count("*").alias("clusters"), F.count_if(c >= 75).alias("high"), F.count_if((c >= 50) & (c < 75)).alias("medium"), F.count_if(c < 50).alias("low"))


def previews(mentions: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` names of each document and type, with confidence, in the order of ``pos``."""
    order = Window.partitionBy("doc_id", "entity_type").orderBy("pos", "name", "confidence")
    first = mentions.withColumn("i", F.row_number().over(order)).where(F.col("i") <= n)
    items = F.array_sort(F.collect_list(F.struct("i", "name", "confidence")))
    return first.groupBy("doc_id", "entity_type").agg(F.transform(items, lambda x: F.struct(x["name"].alias("name"), x["confidence"].alias("confidence"))).alias("preview"))


def timeline_days(presence: DataFrame) -> DataFrame:
    """The distinct first and last days of presences."""
    return presence.select(F.explode(F.array("first_day", "last_day")).alias("day")).where("day IS NOT NULL").distinct()


def links_of(links: DataFrame, case, minimum: float = 0.0) -> DataFrame:
    """Links of one case from a score on: the other case and the score."""
    here = links.where(((F.col("a") == case) | (F.col("b") == case)) & (F.col("score") >= minimum))
    return here.select(F.when(F.col("a") == case, F.col("b")).otherwise(F.col("a")).alias("other"), "score")


def with_users(cases: DataFrame, assignments: DataFrame, users: DataFrame) -> DataFrame:
    """Each case with its assigned users as a sorted array of (user_id, name), empty for none."""
    who = assignments.join(users.hint("shuffle_merge"), "user_id").groupBy("case_id").agg(F.array_sort(F.collect_set(F.struct("user_id", "name"))).alias("users"))
    return cases.join(who.hint("shuffle_merge"), "case_id", "left").withColumn("users", F.coalesce("users", F.expr("filter(array(named_struct('user_id', CAST(NULL AS INT), 'name', '')), x -> false)")))


def involved(alerts: DataFrame, entities: DataFrame) -> DataFrame:
    """(alert_id, entity_id, name) of each entity in an alert's ``entity_ids``; unknown ones have no name."""
    ids = alerts.select("alert_id", F.explode("entity_ids").alias("entity_id")).distinct()
    return ids.join(entities.select("entity_id", "name").hint("shuffle_merge"), "entity_id", "left")


def case_clusters(links: DataFrame, minimum: float = 60.0) -> DataFrame:
    """Clusters of cases that links of at least ``minimum`` join: cluster (its smallest case), members, links, average and best score; largest average first."""
    strong = links.where(F.col("score") >= minimum)
    where = connected_components(strong, "a", "b")
    inside = strong.join(where.withColumnRenamed("node", "a").hint("shuffle_merge"), "a").groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("links"), F.avg("score").alias("avg_score"), F.max("score").alias("best"))
    members = where.groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("members"))
    return inside.join(members.hint("shuffle_merge"), "cluster")


def near_vectors(points: DataFrame, flags: list[str], dims: list[str], eps: float = 0.45) -> DataFrame:
    """(id, cluster) of density clusters with two points at least: components of the graph of points closer than ``eps``; a point without one is left out.

    Flags are 0 or 1 and ``eps`` is below 1, so near points agree in all of them. Points of one cell, a little narrower than ``eps`` over the root of the number of dimensions, are
    all near each other, so cells are what is joined: two cells are near if two of their points are. Equal points count once, and pairs of points are neither shuffled nor written.
    """
    side = eps / math.sqrt(len(dims)) * (1 - 1e-9)
    reach = math.ceil(eps / side)
    cells = [f"cell_{i}" for i in range(len(dims))]
    finite = reduce(lambda x, y: x & y, [F.abs(F.col(d)) < float("inf") for d in dims])
    placed = points.dropna(subset=["id", *flags, *dims]).where(finite).withColumns({c: F.floor(F.col(d) / side).cast("long") for c, d in zip(cells, dims)})
    key = [*flags, *cells]
    scratch = Scratch(points.sparkSession)
    spots = scratch.write(placed.groupBy(*key, *dims).agg(F.min("id").alias("id"), F.count_distinct("id").alias("n")))
    groups = scratch.write(spots.groupBy(*key).agg(F.min("id").alias("root"), F.sum("n").alias("n")))
    own = spots.join(groups.drop("n").hint("shuffle_merge"), key).select(*key, *dims, "root")
    left = own.withColumnsRenamed({d: f"a_{d}" for d in dims} | {"root": "a"})
    for c in cells:
        left = left.withColumn(c, F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach)))
    right = own.withColumnsRenamed({d: f"b_{d}" for d in dims} | {"root": "b"})
    square = reduce(lambda x, y: x + y, [F.pow(F.col(f"a_{d}") - F.col(f"b_{d}"), 2) for d in dims])
    near = scratch.write(left.join(right.hint("shuffle_merge"), key).where(F.expr("a < b") & (square <= eps * eps)).select("a", "b").distinct())
    joined = connected_components(near, "a", "b")
    root = groups.join(joined.select(F.col("node").alias("root"), "component").hint("shuffle_merge"), "root", "left")
    kept = root.where("component IS NOT NULL OR n > 1").select(*key, F.coalesce("component", "root").alias("cluster"))
    return placed.select("id", *key).join(kept.hint("shuffle_merge"), key).select("id", "cluster").distinct()


def merged_graphs(nodes: DataFrame, key: list[str], first: str) -> DataFrame:
    """Rows of several case graphs without repeats: one a key, that of the first case."""
    rest = [c for c in nodes.columns if c not in key]
    return nodes.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(first, *rest)).alias("kept")).select(*key, "kept.*")


def allowed(requested: DataFrame, permitted: DataFrame, key: str = "case_id") -> DataFrame:
    """The requested ids that are permitted."""
    return requested.select(key).intersect(permitted.select(key))


def context_flags(days: Column, km: Column, state_a: Column, state_b: Column, district_a: Column, district_b: Column) -> Column:
    """What a pair of cases shows of space and time, as an array of words; it never changes a score."""
    return F.array_compact(F.array(
        F.when(state_a != state_b, "cross_state").when(district_a != district_b, "cross_district"),
        F.when(days <= 30, "closely_timed").when(days <= 90, "within_quarter"),
        F.when(km <= 50, "close").when(km <= 200, "regional"),
    ))


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted keys and no blanks."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def node_size(combined: Column, bridge: Column) -> Column:
    """20 to 60 by a centrality of 0 to 100, times 1.3 for a bridge."""
    return (F.lit(20.0) + combined / 100 * 40) * F.when(bridge, 1.3).otherwise(1.0)


def edge_width(weight: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(6.0), weight * 2))
