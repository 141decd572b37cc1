"""What a reader sees of graphs, clusters and cases: community profiles, display tables, briefs, explanations and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave.operators.filters import is_real_location
from caseweave.operators.graph import both_ways
from caseweave.operators.report import location_pairs
from caseweave.operators.rollups import edge_width, named_ends, node_size, person_at_location
from caseweave.plans.blocks import dealt
from caseweave.plans.fixpoint import connected_components
from caseweave.plans.scratch import Scratch

# Words that label a community, and how findings are named in texts.
CRIME_WORDS = ["murder", "extortion", "narcotics", "fraud", "robbery"]
SIGNATURE_NAMES = {"posing": "body posing", "trophy_taking": "trophy taking", "overkill": "excessive violence", "staging": "scene staging", "specific_mutilation": "mutilation pattern", "ritualistic_element": "ritualistic elements"}
DISCLAIMER = "Leads for human review, not accusations."


def strongest(rows: DataFrame, value: str, key: str | list[str], n: int | None = None) -> DataFrame:
    """Rows by falling value, ties by key; the first ``n`` of them where given."""
    out = rows.orderBy(F.col(value).desc_nulls_last(), *([key] if isinstance(key, str) else key))
    return out if n is None else out.limit(n)


def alternative_paths(paths: DataFrame, n: int = 3) -> DataFrame:
    """The path of the least cost as ``best``, then up to ``n - 1`` others by falling total weight: adds ``place`` from 0."""
    first = paths.orderBy("cost", "path").limit(1)
    others = paths.join(F.broadcast(first.select("path")), "path", "left_anti").orderBy(F.col("total_weight").desc(), "path").limit(n - 1)
    order = Window.orderBy(F.col("total_weight").desc(), "path")  # n - 1 rows at most
    return first.withColumn("place", F.lit(0)).unionByName(others.withColumn("place", F.row_number().over(order)))


def cross_case_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes in several cases or with an edge of several cases. Rows: (node, cases as a number), (a, b, cross_case)."""
    met = both_ways(edges.where("cross_case")).select(F.col("a").alias("node"))
    return nodes.where("cases > 1").select("node").union(met).distinct()


def member_profiles(nodes: DataFrame, edges: DataFrame, labels: DataFrame, bridges: DataFrame) -> DataFrame:
    """Each node of a community: connections, strength = inner connections / connections (2 digits), is_bridge, and red_herring = one connection, no bridge, one case at most.

    Rows: (node, cases), (a, b), (node, community), (node). Members are to be listed bridges first, then by connections.
    """
    arcs = both_ways(edges)
    own = labels.select(F.col("node").alias("a"), F.col("community").alias("ca"))
    other = labels.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    near = arcs.join(own.hint("shuffle_merge"), "a").join(other.hint("shuffle_merge"), "b").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("connections"), F.count_if(F.col("ca") == F.col("cb")).alias("inner"))
    out = labels.join(near.hint("shuffle_merge"), "node", "left").join(bridges.select("node", F.lit(True).alias("is_bridge")).distinct().hint("shuffle_merge"), "node", "left").join(nodes.select("node", "cases").hint("shuffle_merge"), "node", "left")
    out = out.fillna({"connections": 0, "inner": 0, "is_bridge": False, "cases": 0})
    strength = F.round(F.col("inner") / F.greatest(F.col("connections"), F.lit(1)), 2)
    return out.select("node", "community", "connections", "inner", strength.alias("strength"), "is_bridge", ((F.col("connections") == 1) & ~F.col("is_bridge") & (F.col("cases") <= 1)).alias("red_herring"))


def community_profiles(members: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per community, to be listed by size: size, internal_edges, bridges, red_herrings, keywords, label.

    ``evidence`` (node, justification): crime words of a community, sorted; the first two make its label, without any it is a numbered group.
    """
    sums = members.groupBy("community").agg(F.count("*").alias("size"), F.expr("sum(inner) div 2").alias("internal_edges"), F.count_if("is_bridge").alias("bridges"), F.count_if("red_herring").alias("red_herrings"))
    said = F.lower(F.coalesce("justification", F.lit("")))
    found = evidence.select("node", *[F.contains(said, F.lit(w)).alias(w) for w in CRIME_WORDS]).groupBy("node").agg(*[F.max(w).alias(w) for w in CRIME_WORDS])
    by_group = members.select("node", "community").join(found.hint("shuffle_merge"), "node").groupBy("community").agg(*[F.max(w).alias(w) for w in CRIME_WORDS])
    words = F.array_compact(F.array(*[F.when(F.col(w), w) for w in sorted(CRIME_WORDS)]))
    out = sums.join(by_group.hint("shuffle_merge"), "community", "left").withColumn("keywords", words)
    label = F.when(F.size("keywords") > 0, F.concat(F.initcap(F.array_join(F.slice("keywords", 1, 2), " / ")), F.lit(" Network"))).otherwise(F.concat(F.lit("Group "), F.col("community").cast("string")))
    return out.select("community", "size", "internal_edges", "bridges", "red_herrings", "keywords", F.replace(label, F.lit(" / "), F.lit("/")).alias("label"))


def view_nodes(nodes: DataFrame, centrality: DataFrame, cross_case: DataFrame) -> DataFrame:
    """Nodes with ``size`` on screen by centrality of 0 to 100 (none: 0), larger for cross-case ones."""
    out = nodes.join(centrality.select("node", "score").hint("shuffle_merge"), "node", "left").join(cross_case.select("node", F.lit(True).alias("cross_case")).hint("shuffle_merge"), "node", "left").fillna({"score": 0.0, "cross_case": False})
    return out.withColumn("size", F.round(node_size(F.col("score"), F.col("cross_case")), 1))


def view_edges(edges: DataFrame, rel_type: str | None = None) -> DataFrame:
    """(a, b, ..., width, confidence): rows (a, b, rel_type, weight, confidence) to one per pair; the largest confidence, 1 where none is known; only pairs that have ``rel_type``, where given."""
    pairs = edges.groupBy("a", "b").agg(F.array_sort(F.collect_set("rel_type")).alias("types"), F.sum("weight").alias("weight"), F.coalesce(F.max("confidence"), F.lit(1.0)).alias("confidence"), F.count("*").alias("evidence"))
    kept = pairs if rel_type is None else pairs.where(F.array_contains("types", rel_type))
    return kept.select("a", "b", "types", F.round("weight", 2).alias("weight"), "confidence", "evidence", F.round(edge_width(F.col("weight")), 1).alias("width"))


def one_entity(scores: DataFrame, node) -> DataFrame:
    return scores.where(F.col("node") == F.lit(node))


def not_of_type(scores: DataFrame, nodes: DataFrame, entity_type: str = "Person") -> DataFrame:
    """Scored rows that are no entity of the type: none, where the scores are sound."""
    return scores.join(nodes.where(F.col("entity_type") == entity_type).select("node").hint("shuffle_merge"), "node", "left_anti")


def location_graph(edges: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(locations with their persons and visits, pairs of locations with shared persons) from edges between persons and real locations."""
    there = person_at_location(named_ends(edges, entities).drop("src_name", "dst_name"))
    real = entities.where(is_real_location(F.col("name"), F.col("has_address"), F.col("place_type"))).select(F.col("entity_id").alias("location"), F.col("name").alias("location_name"))
    seen = there.select("person", "location").join(real.hint("shuffle_merge"), "location")
    places = seen.groupBy("location", "location_name").agg(F.count_distinct("person").alias("persons"), F.count("*").alias("visits"))
    return places, location_pairs(seen)


def entity_briefs(entities: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """One row per entity: connections, confirmed and inferred ones (made by a model with a confidence below .8), cases, weak threads (persons below .6), unconfirmed, the first ``most`` of either kind, narrative.

    Rows: (entity_id, name, entity_type, confidence, unresolved), (src, dst, rel_type, case_id, is_ai, confidence). Connections to unknown entities don't count.
    """
    inferred = F.coalesce(F.col("is_ai") & (F.col("confidence") < 0.8), F.lit(False)).alias("inferred")
    low = ((F.col("confidence") > 0) & (F.col("confidence") < 0.6)).alias("low")
    ends = edges.select(F.col("src").alias("entity_id"), F.col("dst").alias("other"), "rel_type", "case_id", inferred, low)
    back = edges.where("src <> dst").select(F.col("dst").alias("entity_id"), F.col("src").alias("other"), "rel_type", "case_id", inferred, low)
    about = entities.select(F.col("entity_id").alias("other"), F.col("name").alias("other_name"), (F.col("entity_type") == "Person").alias("person"))
    rows = ends.union(back).join(about.hint("shuffle_merge"), "other").withColumn("weak", F.col("low") & F.col("person")).drop("low", "person")
    order = Window.partitionBy("entity_id", "inferred").orderBy("rel_type", "other_name", "other", "case_id")
    rows = dealt(rows, "entity_id").withColumn("i", F.row_number().over(order))  # all sums and lists come from this one shuffle
    line = F.concat("rel_type", F.lit(": "), "other_name")
    lists = [F.array_sort(F.collect_list(F.when((F.col("i") <= most) & (F.col("inferred") == kind), F.struct("i", line.alias("line"))))).alias(name) for name, kind in (("first_confirmed", False), ("first_inferred", True))]
    sums = rows.groupBy("entity_id").agg(F.count("*").alias("connections"), F.count_if(~F.col("inferred")).alias("confirmed"), F.count_if("inferred").alias("inferred"), F.count_distinct("case_id").alias("cases"), F.count_if("weak").alias("weak_threads"), *lists)
    out = entities.select("entity_id", "name", "entity_type", (F.coalesce("unresolved", F.lit(False)) | F.coalesce((F.col("confidence") > 0) & (F.col("confidence") < 0.6), F.lit(False))).alias("unconfirmed"))
    out = dealt(out, "entity_id").join(sums.hint("shuffle_merge"), "entity_id", "left").fillna(0, ["connections", "confirmed", "inferred", "cases", "weak_threads"])
    for name in ("first_confirmed", "first_inferred"):
        out = out.withColumn(name, F.array_join(F.transform(name, lambda x: x["line"]), "; "))
    count = lambda c, said: F.when(F.col(c) > 0, F.concat(F.lit(f"{said} "), F.col(c).cast("string")))
    narrative = F.concat_ws("; ", F.concat("name", F.lit(" ("), F.lower("entity_type"), F.lit(")")), F.concat(F.lit("cases "), F.col("cases").cast("string")), count("confirmed", "links on record"), count("inferred", "links to check"))
    return out.fillna("", ["first_confirmed", "first_inferred"]).withColumn("narrative", narrative)


def clusters_with_terms(links: DataFrame, terms: DataFrame, minimum: float, most: int | None = None) -> DataFrame:
    """Clusters of cases that links of at least ``minimum`` join: cluster, members, avg_similarity over all links inside (3 digits), terms that every member has (sorted).

    A cluster's terms are counted by (cluster, term), never gathered by member.
    """
    scratch = Scratch(links.sparkSession)
    member = scratch.write(connected_components(links.where(F.col("score") >= minimum), "a", "b").select(F.col("node").alias("case_id"), F.col("component").alias("cluster")))
    sizes = member.groupBy("cluster").agg(F.count("*").alias("members"))
    have = terms.select("case_id", "term").distinct().join(member.hint("shuffle_merge"), "case_id").groupBy("cluster", "term").agg(F.count("*").alias("n"))
    shared = have.join(sizes.hint("shuffle_merge"), "cluster").where("n = members").groupBy("cluster").agg(F.array_sort(F.collect_list("term")).alias("shared"))
    ends = links.join(member.select(F.col("case_id").alias("a"), "cluster").hint("shuffle_merge"), "a").join(member.select(F.col("case_id").alias("b"), F.col("cluster").alias("other")).hint("shuffle_merge"), "b")
    inside = ends.where("cluster = other").groupBy("cluster").agg(F.round(F.avg("score"), 3).alias("avg_similarity"))
    out = sizes.join(inside.hint("shuffle_merge"), "cluster").join(shared.hint("shuffle_merge"), "cluster", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<string>")))
    return out if most is None else out.withColumn("shared", F.slice("shared", 1, most))


def cluster_texts(members: DataFrame) -> DataFrame:
    """(cluster, members, text): the signatures, ages, genders and states of a cluster's cases as a line of headed parts; parts without values are left out.

    Rows: (cluster, case_id, signatures, victim_age, victim_gender, state). Age 0 counts as unknown.
    """
    age, gender = F.nullif("victim_age", F.lit(0)), F.nullif("victim_gender", F.lit(""))
    sums = members.groupBy("cluster").agg(F.count("*").alias("members"), F.min(age).alias("lo"), F.max(age).alias("hi"), F.array_sort(F.collect_set("state")).alias("states"))
    signs = members.select("cluster", F.explode("signatures").alias("s")).distinct().groupBy("cluster").agg(F.array_sort(F.collect_list("s")).alias("signs"))
    counted = members.where(gender.isNotNull()).groupBy("cluster", "victim_gender").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct(F.negative("n").alias("n"), "victim_gender"))).alias("genders"))
    names = F.create_map(*[F.lit(x) for item in SIGNATURE_NAMES.items() for x in item])
    out = sums.join(signs.hint("shuffle_merge"), "cluster", "left").join(counted.hint("shuffle_merge"), "cluster", "left")
    listed = lambda c: F.array_join(c, ", ")
    shown = F.transform("signs", lambda s: F.coalesce(F.try_element_at(names, s), s))
    text = F.concat_ws(
        " | ",
        F.concat(F.lit("cases "), F.col("members").cast("string")),
        F.when(F.size("states") > 0, F.concat(F.when(F.size("states") > 1, "several states: ").otherwise("state: "), listed("states"))),
        F.when(F.col("lo").isNotNull(), F.concat(F.lit("ages "), F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string"))),
        F.when(F.size("genders") > 0, F.concat(F.lit("victims "), listed(F.transform("genders", lambda g: F.concat(F.negative(g["n"]).cast("string"), F.lit(" "), g["victim_gender"]))))),
        F.when(F.size("signs") > 0, F.concat(F.lit("marks "), listed(shown))),
    )
    return out.select("cluster", "members", text.alias("text"))


def link_text(a: Column, b: Column, score: Column, shared: Column) -> Column:
    """Struct (badge, text) of a link: its score, what both cases show (names of ``shared``), and the disclaimer; badge HIGH from 75, MEDIUM from 50."""
    names = F.create_map(*[F.lit(x) for item in SIGNATURE_NAMES.items() for x in item])
    listed = F.array_join(F.transform(F.array_sort(shared), lambda s: F.coalesce(F.try_element_at(names, s), s)), ", ")
    text = F.concat_ws(" | ", F.concat(F.lit("score "), score.cast("string"), F.lit(" of 100")), F.concat(F.lit("cases "), a.cast("string"), F.lit(" and "), b.cast("string")), F.when(F.size(shared) > 0, F.concat(F.lit("in common "), listed)), F.lit(DISCLAIMER))
    return F.struct(F.when(score >= 75, "HIGH").when(score >= 50, "MEDIUM").otherwise("LOW").alias("badge"), text.alias("text"))


def case_context(cases: DataFrame, entities: DataFrame, most: int = 10) -> DataFrame:
    """(case_id, all other columns of ``cases``, entities): the first ``most`` names of each type by name, as a map from type to names; an empty map without entities."""
    named = entities.select("case_id", "entity_type", "name").where("name IS NOT NULL").distinct()
    first = named.withColumn("i", F.row_number().over(Window.partitionBy("case_id", "entity_type").orderBy("name"))).where(F.col("i") <= most)
    lists = first.groupBy("case_id", "entity_type").agg(F.array_sort(F.collect_list("name")).alias("names")).groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "names")))).alias("entities"))
    return cases.join(lists.hint("shuffle_merge"), "case_id", "left").withColumn("entities", F.coalesce("entities", F.create_map().cast("map<string,array<string>>")))


def report_lines(cases: DataFrame, entities: DataFrame, edges: DataFrame, alerts: DataFrame) -> DataFrame:
    """(case_id, section, key, line) of a text report per case, in the order of section and key: title, entities, connections, alerts. A case's rows are never gathered."""
    title = cases.select("case_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("key"), F.format_string("Case %s: %s", F.col("case_id").cast("string"), "name").alias("line"))
    who = entities.select("case_id", F.lit(1), F.col("entity_id").cast("long"), F.format_string("%s (%s), confidence %.2f", "name", "entity_type", "confidence"))
    links = edges.select("case_id", F.lit(2), F.col("edge_id").cast("long"), F.format_string("%s -> %s [%s]", F.col("src").cast("string"), F.col("dst").cast("string"), "rel_type"))
    found = alerts.select("case_id", F.lit(3), F.col("alert_id").cast("long"), F.format_string("%s: %s (%s)", F.upper("severity"), "alert_type", "status"))
    parts = [p.join(cases.select("case_id").hint("shuffle_merge"), "case_id", "left_semi") for p in (who, links, found)]
    return title.union(parts[0]).union(parts[1]).union(parts[2])


def write_reports(lines: DataFrame, path: str) -> None:
    """A folder per case with its report's lines in text files, in order: rows are sorted by range, so that a large case has several files, whose names are in order."""
    order = ["case_id", "section", "key"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("case_id", "line").write.partitionBy("case_id").mode("errorifexists").text(path)


def export(table: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes a table as parquet, json or csv with a header."""
    table.write.mode("errorifexists").option("header", True).format(form).save(path)
