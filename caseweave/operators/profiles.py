"""Resolved nodes and edges with what stands behind them: other names, documents, attributes, evidence; and how the graph hangs together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave.operators.graph import OTHER_WEIGHT, TYPE_WEIGHTS, bridges
from caseweave.plans.fixpoint import connected_components
from caseweave.plans.scratch import Scratch


def _first(rows: DataFrame, keys: list[str], order: list, value, most: int, name: str) -> DataFrame:
    """(keys, name): the first ``most`` values of each key as an array, in order; the rest is cut off before rows are gathered."""
    kept = rows.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("i") <= most)
    lists = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", value.alias("x")))).alias("l"))
    return lists.select(*keys, F.transform("l", lambda e: e["x"]).alias(name))


def entity_profiles(entities: DataFrame, most: int = 10) -> DataFrame:
    """One row per normalised name of live entities: (norm, canonical_id, confidence, record_count, cases, documents, first_documents, aliases, attributes, unconfirmed).

    The most confident record is canonical, ties to the smallest id. Aliases are the records' aliases and other spellings, up to ``most`` by how many records have them, ties by name; attributes are united, each
    with the value of the most confident record that has one; documents are counted, and the ``most`` smallest ids listed. entities: (entity_id, case_id, name, aliases, document_id, attributes, confidence, merged_into).
    Null names make no row; null aliases, attributes and documents are none; below .6 a name is unconfirmed.
    """
    scratch = Scratch(entities.sparkSession)
    live = scratch.write(entities.where("merged_into IS NULL AND name IS NOT NULL").withColumn("norm", F.lower(F.trim("name"))))
    rank = F.struct("confidence", F.negative("entity_id"))
    base = live.groupBy("norm").agg(F.max_by("entity_id", rank).alias("canonical_id"), F.max_by(F.trim("name"), rank).alias("spelt"), F.max("confidence").alias("confidence"), F.count("*").alias("record_count"), F.count_distinct("case_id").alias("cases"), F.count_distinct("document_id").alias("documents"))
    said = live.select("norm", F.explode(F.array_distinct(F.concat(F.array(F.trim("name")), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("alias")).where("alias IS NOT NULL AND alias <> ''")
    other = said.groupBy("norm", "alias").agg(F.count("*").alias("n")).join(base.select("norm", "spelt").hint("shuffle_merge"), "norm").where("alias <> spelt")
    aliases = _first(other, ["norm"], [F.col("n").desc(), "alias"], F.col("alias"), most, "aliases")
    docs = _first(live.where("document_id IS NOT NULL").select("norm", "document_id").distinct(), ["norm"], ["document_id"], F.col("document_id"), most, "first_documents")
    cells = live.select("norm", "confidence", "entity_id", F.explode("attributes").alias("k", "v")).where("v IS NOT NULL").groupBy("norm", "k").agg(F.max_by("v", F.struct("confidence", F.negative("entity_id"))).alias("v"))
    maps = cells.groupBy("norm").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    out = base.drop("spelt")
    for part in (aliases, docs, maps):
        out = out.join(part.hint("shuffle_merge"), "norm", "left")
    none = {"aliases": F.array().cast("array<string>"), "attributes": F.create_map().cast("map<string,string>"), "first_documents": F.array().cast(f"array<{live.schema['document_id'].dataType.simpleString()}>")}
    return out.withColumns({c: F.coalesce(c, v) for c, v in none.items()} | {"unconfirmed": F.col("confidence") < 0.6})


def edge_profiles(edges: DataFrame, most: int = 3, type_weights: dict[str, float] = TYPE_WEIGHTS) -> DataFrame:
    """One row per unordered pair: (a, b, weight, n, cases, types map of summed weight by type, primary_type, ai_only, confidence, evidence).

    Weights as in ``roll_up_edges``. Evidence is up to ``most`` records (document_id, rel_type, justification, confidence), the most confident first, ties by document and type, of those that name a document or a justification.
    edges: (src, dst, rel_type, case_id, document_id, justification, confidence, is_ai, severity, weight). Self loops and null ends are left out; a null is_ai is a person's record, a null confidence 0.
    """
    base = F.lit(OTHER_WEIGHT)
    for kind, w in type_weights.items():
        base = F.when(F.col("rel_type") == kind, F.lit(w)).otherwise(base)
    worth = base * (1 + 0.2 * F.coalesce("severity", F.lit(0.0))) * F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(1.0))
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "rel_type", "case_id", "document_id", "justification", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("is_ai", F.lit(False)).alias("is_ai"), worth.alias("w"))
    e = Scratch(edges.sparkSession).write(e)
    kinds = e.groupBy("a", "b", "rel_type").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.bool_and("is_ai").alias("ai"), F.max("confidence").alias("c"))
    out = kinds.groupBy("a", "b").agg(
        F.sum("w").alias("weight"), F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("rel_type", F.lit("")).alias("k"), F.col("w").alias("v"))))).alias("types"),
        F.min_by("rel_type", F.struct(F.negative("w"), "rel_type")).alias("primary_type"), F.bool_and("ai").alias("ai_only"), F.max("c").alias("confidence"),
    )
    cases = e.where("case_id IS NOT NULL").select("a", "b", "case_id").distinct().groupBy("a", "b").agg(F.count("*").alias("cases"))
    shown = e.where("document_id IS NOT NULL OR trim(coalesce(justification, '')) <> ''")
    evidence = _first(shown, ["a", "b"], [F.col("confidence").desc(), "document_id", "rel_type", "justification"], F.struct("document_id", "rel_type", "justification", "confidence"), most, "evidence")
    out = out.join(cases.hint("shuffle_merge"), ["a", "b"], "left").join(evidence.hint("shuffle_merge"), ["a", "b"], "left")
    return out.withColumns({"cases": F.coalesce("cases", F.lit(0)), "evidence": F.coalesce("evidence", F.array().cast(evidence.schema["evidence"].dataType))})


def case_bridges(edges: DataFrame, labels: DataFrame, own_cases: DataFrame, edge_cases: DataFrame) -> DataFrame:
    """(node, outside, cases, cross_case): nodes with edges into another community, with the number of cases that they and their edges have; more than one makes a cross-case bridge.

    labels: (node, community); own_cases: (node, case_id); edge_cases: (a, b, case_id), either way round. Cases are counted by (node, case), never gathered.
    """
    found = bridges(edges, labels)
    ends = edge_cases.select(F.explode(F.array("a", "b")).alias("node"), "case_id")
    every = own_cases.select("node", "case_id").union(ends).dropna().distinct().join(found.select("node").hint("shuffle_merge"), "node").groupBy("node").agg(F.count("*").alias("cases"))
    out = found.join(every.hint("shuffle_merge"), "node", "left").withColumn("cases", F.coalesce("cases", F.lit(0)))
    return out.withColumn("cross_case", F.col("cases") > 1)


def connectivity_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: connected, components, largest, isolated, nodes, edges, split_names: how the graph of nodes (node, name) and edges (a, b) hangs together.

    A node without edges is a component of its own; edges to unknown nodes don't count. split_names are names, in lower case without outer blanks, that stand in more than one component: entities that resolution should have joined.
    A graph without nodes is connected and has no component.
    """
    scratch = Scratch(nodes.sparkSession)
    known = scratch.write(nodes.select("node", F.lower(F.trim("name")).alias("name")).where("node IS NOT NULL").dropDuplicates(["node"]))
    ends = edges.where("a <> b").join(known.select(F.col("node").alias("a")).hint("shuffle_merge"), "a", "left_semi").join(known.select(F.col("node").alias("b")).hint("shuffle_merge"), "b", "left_semi")
    ends = scratch.write(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    placed = known.join(connected_components(ends, "a", "b").hint("shuffle_merge"), "node", "left")
    placed = scratch.write(placed.select("node", "name", F.coalesce("component", "node").alias("component"), F.col("component").isNull().alias("alone")))
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"), F.max("alone").alias("alone"))
    sums = sizes.agg(F.count("*").alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.count_if("alone").alias("isolated"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"))
    split = placed.where("name IS NOT NULL").select("name", "component").distinct().groupBy("name").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("split_names"))
    out = sums.crossJoin(F.broadcast(split)).crossJoin(F.broadcast(ends.agg(F.count("*").alias("edges"))))  # one row each
    return out.select((F.col("components") <= 1).alias("connected"), "components", "largest", "isolated", "nodes", "edges", "split_names")

