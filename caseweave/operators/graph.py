"""Resolved graph: roll-ups of entities and edges, centralities, communities and paths."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave.functions import band
from caseweave.plans.scratch import Scratch, numbered

#: Base weight of each relationship type, and of any other.
TYPE_WEIGHTS = {"Co-accused": 1.0, "Financial Transaction": 0.95, "Ownership": 0.9, "Communication": 0.85, "Location Presence": 0.7, "Employment": 0.6, "Associate": 0.5, "Family": 0.4}
OTHER_WEIGHT = 0.3


def canonical_entities(entities: DataFrame, key: str = "lower(trim(name))") -> DataFrame:
    """One row per normalised name: the most confident record (ties to the smallest id) with counts and best confidence; unconfirmed below .6."""
    out = entities.where("merged_into IS NULL").groupBy(F.expr(key).alias("norm"))
    best = F.max_by("entity_id", F.struct("confidence", F.negative("entity_id")))
    out = out.agg(best.alias("canonical_id"), F.max("confidence").alias("confidence"), F.count("*").alias("record_count"), F.count_distinct("case_id").alias("cases"))
    return out.withColumn("unconfirmed", F.col("confidence") < 0.6)


def roll_up_edges(edges: DataFrame, type_weights: dict[str, float] = TYPE_WEIGHTS) -> DataFrame:
    """One row per unordered pair: weight = sum of type weight * (1 + .2 * severity) * raw weight (null or 0: 1), counts, cases, first and last time, primary type.

    The primary type has the largest summed weight, ties to the name that comes first.
    """
    base = F.coalesce(reduce(lambda a, kv: F.when(F.col("rel_type") == kv[0], F.lit(kv[1])).otherwise(a), type_weights.items(), F.lit(None).cast("double")), F.lit(OTHER_WEIGHT))
    raw = F.coalesce(F.nullif(F.col("weight"), F.lit(0.0)), F.lit(1.0))
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "rel_type", "case_id", "ts", (base * (1 + 0.2 * F.coalesce(F.col("severity"), F.lit(0.0))) * raw).alias("w"))
    by_type = e.groupBy("a", "b", "rel_type").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.collect_set("case_id").alias("cs"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    out = by_type.groupBy("a", "b").agg(
        F.sum("w").alias("weight"), F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("cs")))).alias("cases"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"),
        F.min_by("rel_type", F.struct(F.negative("w"), "rel_type")).alias("primary_type"),
    )
    return out.withColumn("cross_case", F.col("cases") > 1)


def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    return edges.select("a", "b", *extra).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *extra))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, degree, centrality = degree / (nodes - 1)) of an undirected edge table with one row per pair."""
    d = both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    return d.crossJoin(F.broadcast(d.agg(F.count("*").alias("nodes")))).select("node", "degree", (F.col("degree") / F.greatest(F.lit(1), F.col("nodes") - 1)).alias("centrality"))


def eigenvector_centrality(edges: DataFrame, max_rounds: int = 1000, tolerance: float = 1e-6, fixed_rounds: int | None = None) -> DataFrame:
    """(node, centrality): power iteration x <- x + A x with unit norm from a uniform start until the change is below nodes * ``tolerance``.

    Each round is one join and one aggregation, written to the shared folder; without convergence in ``max_rounds`` rounds all are 0.
    """
    scratch = Scratch(edges.sparkSession)
    arcs = scratch.write(both_ways(edges, "weight"))
    x = scratch.write(arcs.select(F.col("a").alias("node")).distinct().withColumn("x", F.lit(1.0)))
    n = x.count()
    for i in range(fixed_rounds or max_rounds):
        flow = arcs.join(x, arcs["b"] == x["node"]).select(F.col("a").alias("node"), (F.col("weight") * F.col("x")).alias("y"))
        y = scratch.write(flow.unionByName(x.select("node", F.col("x").alias("y"))).groupBy("node").agg(F.sum("y").alias("y")))
        norm = (y.agg(F.sum(F.col("y") * F.col("y"))).first()[0] or 1.0) ** 0.5
        z = scratch.write(y.join(x, "node").select("node", (F.col("y") / norm).alias("x"), F.abs(F.col("y") / norm - F.col("x")).alias("change")))
        change = z.agg(F.sum("change")).first()[0] or 0.0
        scratch.drop(x, y)
        x = z
        if not fixed_rounds and i and change < n * tolerance:
            break
    else:
        if not fixed_rounds:
            return x.select("node", F.lit(0.0).alias("centrality"))
    return x.select("node", F.col("x").alias("centrality"))


def _settle(scratch: Scratch, arcs: DataFrame, start: DataFrame, plus: float) -> DataFrame:
    """Values (s, node, x) that ``start`` gives to the heads of ``arcs`` (s, u, v, f), which have no cycles: the sum of f * (plus + x) over a head's arcs, once all their tails are settled.

    A round joins the arcs with what the last one settled only, and carries the sums of heads that still wait.
    """
    need = scratch.write(arcs.groupBy("s", F.col("v").alias("node")).agg(F.count("*").alias("need")))
    front, settled, states = start, [start], [need]
    waiting = None
    while True:
        sums = front.withColumnRenamed("node", "u").join(arcs, ["s", "u"]).groupBy("s", F.col("v").alias("node")).agg(F.sum(F.col("f") * (plus + F.col("x"))).alias("x"), F.count("*").alias("got"))
        sums = sums.join(need, ["s", "node"])
        if waiting is not None:
            sums = sums.unionByName(waiting).groupBy("s", "node").agg(F.sum("x").alias("x"), F.sum("got").alias("got"), F.max("need").alias("need"))
        states.append(scratch.write(sums))
        front, waiting = states[-1].where("got = need").select("s", "node", "x"), states[-1].where("got < need")
        if front.isEmpty():
            break
        settled.append(front)
    out = scratch.write(reduce(DataFrame.unionByName, settled))
    scratch.drop(*states)
    return out


def _runs(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices first[i], first[i] + 1, ... of all runs of ``counts[i]``, one after the other."""
    ends = np.cumsum(counts, dtype=np.int32)
    return np.repeat(first - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)


def _dependencies(tail: np.ndarray, head: np.ndarray, weight: np.ndarray, n: int, sources: np.ndarray) -> np.ndarray:
    """Summed dependencies of every node on paths from a few ``sources``, over arcs sorted by tail.

    Node v of the i-th source is cell i * n + v, so all sources settle at once: distances from the nearest cells on, then path counts along the arcs of shortest paths, each once all arcs into its tail are done, and dependencies back in the reverse order.
    """
    cells, base = len(sources) * n, np.arange(len(sources), dtype=np.int32) * n + sources
    degree = np.bincount(tail, minlength=n).astype(np.int32)
    first = np.cumsum(degree, dtype=np.int32) - degree
    dist, waits = np.full(cells, np.inf), np.zeros(cells, bool)
    dist[base] = 0.0
    front, nearest = base, max(1_000, cells // 40)
    while len(front):
        if len(front) > 2 * nearest:  # far cells are likely to come nearer yet
            now = dist[front] <= np.partition(dist[front], nearest)[nearest]
            waits[front[~now]] = True
            front = front[now]
        node = front % n
        arcs = _runs(first[node], degree[node])
        near = np.repeat(dist[front], degree[node]) + weight[arcs]
        at = np.repeat(front - node, degree[node]) + head[arcs]
        better = np.flatnonzero(near < dist[at])
        at, near = at[better], near[better]
        np.minimum.at(dist, at, near)
        waits[at] = True
        front = np.flatnonzero(waits).astype(np.int32)
        waits[front] = False
    tails, heads = [], []
    for i, d in enumerate(dist.reshape(-1, n)):
        with np.errstate(invalid="ignore"):
            on = np.flatnonzero(np.abs(d[tail] + weight - d[head]) < 1e-9)
        on = on[d[tail[on]] < d[head[on]]]
        tails.append(i * n + tail[on])
        heads.append(i * n + head[on])
    tail, head = np.concatenate(tails).astype(np.int32), np.concatenate(heads).astype(np.int32)  # arcs on shortest paths, still sorted by tail
    degree = np.bincount(tail, minlength=cells).astype(np.int32)
    first = np.cumsum(degree, dtype=np.int32) - degree
    need = np.bincount(head, minlength=cells)
    sigma, front, levels = np.zeros(cells), base, []
    sigma[base] = 1.0
    while len(arcs := _runs(first[front], degree[front])):
        tails, heads = np.repeat(front, degree[front]), head[arcs]
        levels.append((tails, heads))
        np.add.at(sigma, heads, sigma[tails])
        np.subtract.at(need, heads, 1)
        front = np.unique(heads[need[heads] == 0])
    delta = np.zeros(cells)
    for tails, heads in reversed(levels):
        np.add.at(delta, tails, sigma[tails] / sigma[heads] * (1.0 + delta[heads]))
    delta[base] = 0.0
    return delta.reshape(-1, n).sum(axis=0)


#: Arcs of a graph that every task can hold (16 bytes each), and nodes up to which a sample that was asked for is no use: all sources count.
BROADCAST_ARCS, EXACT_NODES = 16_000_000, 4_000
#: Arcs above which those that lie on no shortest path are dropped first, nodes that distances are bounded through, and arcs of each node that the bounds take.
PRUNED_ARCS, LANDMARKS, LIGHT_ARCS = 200_000, 8, 8
#: Rows (source, node) that ``relaxed_betweenness`` holds at once.
RELAXED_ROWS = 200_000_000


def _short_arcs(scratch: Scratch, arcs: DataFrame, nodes: DataFrame, max_rounds: int = 30) -> DataFrame:
    """``arcs`` (a, b, weight, both ways) without those that are longer than some path through a landmark, so that every shortest path and every distance stays as it is.

    The landmarks are the nodes of most arcs. Lengths of paths to them over each node's lightest arcs bound the distances from above, whether or not the rounds have settled. On graphs of many arcs what is left
    grows with the nodes, not with the arcs.
    """
    order = Window.partitionBy("a").orderBy("weight", "b")
    light = arcs.withColumn("i", F.row_number().over(order)).where(F.col("i") <= LIGHT_ARCS)
    light = scratch.write(both_ways(light, "weight").distinct())
    marks = [r.a for r in arcs.groupBy("a").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a").limit(LANDMARKS).collect()]
    names = [f"d{i}" for i in range(len(marks))]
    dist = scratch.write(nodes.select("node", *[F.when(F.col("node") == F.lit(m), 0.0).otherwise(float("inf")).alias(d) for m, d in zip(marks, names)]))
    seen = None
    for _ in range(max_rounds):
        step = light.join(dist.hint("shuffle_merge"), light["a"] == dist["node"]).select(F.col("b").alias("node"), *[(F.col(d) + F.col("weight")).alias(d) for d in names])
        nearer = scratch.write(step.unionByName(dist).groupBy("node").agg(*[F.min(d).alias(d) for d in names]))
        scratch.drop(dist)
        dist = nearer
        state = tuple(dist.agg(*[f(F.when(F.col(d) < float("inf"), F.col(d))) for d in names for f in (F.count, F.sum)]).first())
        if seen and all(abs(x - y) <= 1e-3 * abs(x) for x, y in zip(state, seen) if x is not None and y is not None) and [x is None for x in state] == [x is None for x in seen]:
            break  # later rounds hardly lower the bounds
        seen = state
    a, b = (dist.select(F.col("node").alias(c), *[F.col(d).alias(f"{c}_{d}") for d in names]) for c in "ab")
    bound = reduce(F.least, [F.col(f"a_{d}") + F.col(f"b_{d}") for d in names]) if len(names) > 1 else F.col("a_d0") + F.col("b_d0")
    met = arcs.where("a < b").join(a.hint("shuffle_merge"), "a").join(b.hint("shuffle_merge"), "b").where(F.col("weight") <= bound * (1 + 1e-12) + 1e-8)
    out = scratch.write(both_ways(met, "weight"))
    scratch.drop(light, dist)
    return out


def _packed(batches):
    """One row of bytes for each batch of arcs (t, h, w), so that copies of them are cheap."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(i).to_numpy(zero_copy_only=False).astype(kind).tobytes()], pa.binary()) for i, kind in enumerate(("<i4", "<i4", "<f8"))], ["t", "h", "w"])


def betweenness_centrality(edges: DataFrame, sources: DataFrame | None = None, error: float | None = None, confidence: float = 0.95) -> DataFrame:
    """(node, centrality, error_bound): share of weighted shortest paths through each node, weight as distance, halved and normalised by 2 / ((n-1)(n-2)).

    All sources count, whatever the size, and the bound is 0, unless the caller asks for less: with ``error``, above ``EXACT_NODES`` nodes as many sources as keep every node's error below it with the given ``confidence``
    (Hoeffding's bound on the mean of shares in 0..1, over all nodes at once) are taken by the hash of their name, and the bound is that of their number; ``sources`` (node) names the sample instead.
    Arcs that no shortest path takes are dropped first (``_short_arcs``), which changes no result. The sources are dealt over the tasks, each task gets a copy of the arcs left by a shuffle and settles a few sources at once;
    only sums by node are shuffled then, and nothing passes the driver but counts. A task holds ``BROADCAST_ARCS`` arcs at most; more go through ``relaxed_betweenness``, with the same results.
    Edges without a positive weight are left out; parallel ones count with the least; no edges give no rows.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    good = edges.where("a <> b AND weight > 0").select("a", "b", F.col("weight").cast("double").alias("weight"))
    arcs = scratch.write(both_ways(good, "weight").groupBy("a", "b").agg(F.min("weight").alias("weight")))
    nodes = scratch.write(numbered(scratch.write(arcs.select(F.col("a").alias("node")).distinct())))
    n, m = nodes.count(), arcs.count()
    chosen = nodes if sources is None else nodes.join(sources.select("node").distinct().hint("shuffle_merge"), "node")
    if sources is None and error is not None and n > EXACT_NODES:
        wanted = math.ceil(math.log(2 * n / (1 - confidence)) / (2 * error**2))
        chosen = scratch.write(nodes.orderBy(F.xxhash64(F.col("node").cast("string"))).limit(wanted))
    k = n if chosen is nodes else chosen.count()
    if m > PRUNED_ARCS:
        arcs, every = _short_arcs(scratch, arcs, nodes.select("node")), arcs
        scratch.drop(every)
        m = arcs.count()
    bound = 0.0 if k >= n else math.sqrt(math.log(2 * n / (1 - confidence)) / (2 * max(k, 1)))
    if m > BROADCAST_ARCS:
        return relaxed_betweenness(arcs.where("a < b"), chosen.select("node")).withColumn("error_bound", F.lit(bound))
    at_once = max(4, min(64, 250_000 // max(n, 1)))
    tasks = max(1, min(-(-k // at_once), 4 * spark.sparkContext.defaultParallelism))

    def sums(batches):
        ids, parts = [], []
        for batch in batches:
            for place, *arrays in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                if place is None:
                    parts.append([np.frombuffer(x, kind) for x, kind in zip(arrays, ("<i4", "<i4", "<f8"))])
                else:
                    ids.append(place)
        if not ids or not parts:
            return
        tail, head, weight = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((head, tail))
        tail, head, weight, total = tail[order], head[order], weight[order], np.zeros(n)
        for i in range(0, len(ids), at_once):
            total += _dependencies(tail, head, weight, n, np.array(ids[i : i + at_once], np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(total)], ["place", "x"])

    place = lambda end, alias: nodes.select(F.col("node").alias(end), F.col("place").alias(alias)).hint("shuffle_merge")
    packed = arcs.join(place("a", "t"), "a").join(place("b", "h"), "b").select("t", "h", F.col("weight").alias("w")).mapInArrow(_packed, "t binary, h binary, w binary")
    copies = packed.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(None).cast("int").alias("place"), "t", "h", "w")
    none = F.lit(None).cast("binary")
    asked = chosen.select(F.pmod(F.col("place"), F.lit(tasks)).alias("task"), "place", none.alias("t"), none.alias("h"), none.alias("w"))
    total = copies.unionByName(asked).repartitionById(tasks, "task").mapInArrow(sums, "place int, x double").groupBy("place").agg(F.sum("x").alias("x"))
    scale = 0.0 if n <= 2 or not k else (n / k) / ((n - 1) * (n - 2))
    out = scratch.write(nodes.join(total.hint("shuffle_merge"), "place", "left").select("node", (F.coalesce("x", F.lit(0.0)) * scale).alias("centrality"), F.lit(bound).alias("error_bound")))
    scratch.keep_only(out)
    return out


def relaxed_betweenness(edges: DataFrame, sources: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """``betweenness_centrality`` by joins, for graphs that don't fit a task: (node, centrality).

    As many sources as give ``RELAXED_ROWS`` rows relax at once: rows (source, node, dist) improve by a join with the arcs until none does; path counts then rise along the tight arcs and
    dependencies fall back along them, each round from the nodes that the last one settled. ``sources`` (node) limits the sources to a sample and scales the result: an estimate for large graphs.
    """
    scratch = Scratch(edges.sparkSession)
    arcs = scratch.write(both_ways(edges, "weight").withColumnRenamed("weight", "w"))
    nodes = scratch.write(arcs.select(F.col("a").alias("node")).distinct())
    n = nodes.count()
    starts = scratch.write(nodes if sources is None else nodes.join(sources.select("node"), "node"))
    s = starts.count()
    parts = max(1, math.ceil(s * n / RELAXED_ROWS))
    total = None
    for i in range(parts):
        own = Scratch(edges.sparkSession)
        found = _relaxed_sums(own, arcs, starts.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == i), max_rounds)
        summed = scratch.write(found if total is None else found.unionByName(total).groupBy("node").agg(F.sum("c").alias("c")))
        own.keep_only()
        if total is not None:
            scratch.drop(total)
        total = summed
    scratch.keep_only(nodes, total)
    scale = 0.0 if n <= 2 or not s else (n / s) / ((n - 1) * (n - 2))
    return nodes.join(total, "node", "left").select("node", (F.coalesce("c", F.lit(0.0)) * scale).alias("centrality"))


def _relaxed_sums(scratch: Scratch, arcs: DataFrame, starts: DataFrame, max_rounds: int) -> DataFrame:
    """(node, c): summed dependencies of the nodes on paths from ``starts``, over ``arcs`` (a, b, w)."""
    start = scratch.write(starts.select(F.col("node").alias("s"), "node"))
    dist = front = scratch.write(start.withColumn("d", F.lit(0.0)))
    for _ in range(max_rounds):
        step = front.join(arcs, front["node"] == arcs["a"]).groupBy("s", F.col("b").alias("node")).agg(F.min(F.col("d") + F.col("w")).alias("nd"))
        better = scratch.write(step.join(dist, ["s", "node"], "left").where("d IS NULL OR nd < d - 1e-12").select("s", "node", F.col("nd").alias("d")))
        if better.isEmpty():
            break
        dist, old = scratch.write(dist.unionByName(better).groupBy("s", "node").agg(F.min("d").alias("d"))), (dist, front)
        scratch.drop(*old)
        front = better
    u, v = dist.select("s", F.col("node").alias("u"), F.col("d").alias("du")), dist.select("s", F.col("node").alias("v"), F.col("d").alias("dv"))
    tight = scratch.write(u.join(arcs, F.col("u") == F.col("a")).withColumnRenamed("b", "v").join(v, ["s", "v"]).where("abs(du + w - dv) < 1e-9").select("s", "u", "v"))
    sigma = _settle(scratch, tight.withColumn("f", F.lit(1.0)), start.withColumn("x", F.lit(1.0)), 0.0)
    tails, heads = sigma.select("s", F.col("node").alias("u"), F.col("x").alias("su")), sigma.select("s", F.col("node").alias("v"), F.col("x").alias("sv"))
    # dependencies run against the arcs
    back = scratch.write(tight.join(tails, ["s", "u"]).join(heads, ["s", "v"]).select("s", F.col("v").alias("u"), F.col("u").alias("v"), (F.col("su") / F.col("sv")).alias("f")))
    leaves = sigma.select("s", "node").join(back.select("s", F.col("v").alias("node")), ["s", "node"], "left_anti")
    delta = _settle(scratch, back, scratch.write(leaves.withColumn("x", F.lit(0.0))), 1.0)
    return delta.where("s <> node").groupBy("node").agg(F.sum("x").alias("c"))


def combined_centrality(degree: DataFrame, betweenness: DataFrame, eigenvector: DataFrame) -> DataFrame:
    """.4 degree + .4 betweenness + .2 eigenvector, 4 digits, and scaled to 0..100 between the least and the largest."""
    j = degree.select("node", F.col("centrality").alias("degree")).join(betweenness.select("node", F.col("centrality").alias("betweenness")), "node").join(eigenvector.select("node", F.col("centrality").alias("eigenvector")), "node")
    j = j.withColumn("combined", F.round(0.4 * F.col("degree") + 0.4 * F.col("betweenness") + 0.2 * F.col("eigenvector"), 4))
    ends = j.agg(F.min("combined").alias("lo"), F.max("combined").alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return j.crossJoin(F.broadcast(ends)).withColumn("scaled", (F.col("combined") - F.col("lo")) / span * 100).drop("lo", "hi")


#: Nodes up to which tables with a row a node are sent to the tasks, by count, so that arcs stay where they are.
BROADCAST_NODES = 2_000_000


def communities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, community) by levels of local moves that raise modularity: the communities of a level are the nodes of the next, until a level raises it no more.

    In each round every other node (by hash) may join the neighbouring community of largest gain, synchronously, with ties to the smallest community; of two single nodes only the one with the larger name joins the other; a round is kept only if
    modularity rises, so the result is never worse than single nodes. Arcs lie by their first end and are read where they lie, labels come to them (up to ``BROADCAST_NODES``); only sums by node and community are shuffled.
    """
    scratch = Scratch(edges.sparkSession)
    arcs = scratch.write(both_ways(edges, "weight").repartition("a"))
    total = arcs.agg(F.sum("weight")).first()[0] or 1.0  # twice the weight of all edges
    label = scratch.write(arcs.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
    while True:
        moved = _local_moves(scratch, arcs, total, rounds)
        if moved is None:
            scratch.keep_only(label)
            return label
        size = moved.count()
        last = label
        label = scratch.write(label.withColumnRenamed("community", "of").join(_sent(moved.withColumnRenamed("node", "of"), size), "of").select("node", "community"))
        ends = arcs.join(_sent(moved.select(F.col("node").alias("a"), F.col("community").alias("ca")), size), "a").join(_sent(moved.select(F.col("node").alias("b"), F.col("community").alias("cb")), size), "b")
        merged = scratch.write(ends.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("weight").alias("weight")).repartition("a"))
        scratch.drop(arcs, last)
        arcs = merged


def _sent(rows: DataFrame, n: int) -> DataFrame:
    """A table of ``n`` rows for a join: sent to the tasks, or shuffled if it is too large for that."""
    return rows.hint("broadcast") if n <= BROADCAST_NODES else rows.hint("shuffle_merge")


def _local_moves(scratch: Scratch, arcs: DataFrame, total: float, rounds: int) -> DataFrame | None:
    """(node, community) of one level, None if no move raises modularity. An arc from a node to itself is the weight within it."""
    label = scratch.write(arcs.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k")).select("node", F.col("node").alias("community"), "k"))
    n = label.count()
    ends = lambda lab, node, name: _sent(lab.select(F.col("node").alias(node), F.col("community").alias(name)), n)

    def modularity(lab: DataFrame) -> float:
        inside = arcs.join(ends(lab, "a", "ca"), "a").join(ends(lab, "b", "cb"), "b").where("ca = cb").agg(F.sum("weight").alias("inside"))
        spread = lab.groupBy("community").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("spread"))
        both = inside.crossJoin(F.broadcast(spread)).first()
        return (both.inside or 0.0) / total - (both.spread or 0.0) / total**2

    first = best = modularity(label)
    idle = 0
    for i in range(rounds):
        turn = lambda node: F.pmod(F.xxhash64(F.col(node).cast("string")), F.lit(2)) == i % 2  # noqa: B023, E731
        sizes = label.groupBy("community").agg(F.sum("k").alias("kc"), F.count("*").alias("n"))
        own = label.join(sizes.select("community", F.col("n").alias("own_n")), "community").select("node", F.col("community").alias("own"), "k", "own_n")
        near = arcs.where((F.col("a") != F.col("b")) & turn("a")).join(ends(label, "b", "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("weight").alias("w"))
        options = near.join(_sent(own, n), "node").join(_sent(sizes, n), "community").where("own_n > 1 OR n > 1 OR community < own").withColumn("gain", F.col("w") - F.col("k") * (F.col("kc") - F.when(F.col("own") == F.col("community"), F.col("k")).otherwise(0)) / total)
        top = options.groupBy("node").agg(F.min_by(F.struct("community", "gain"), F.struct(F.negative("gain"), "community")).alias("t"), F.max(F.when(F.col("own") == F.col("community"), F.col("gain"))).alias("now"))
        better = top.where(F.col("t.gain") > F.coalesce("now", F.lit(0.0)) + 1e-12).select("node", F.col("t.community").alias("new"))
        nxt = scratch.write(label.join(better.hint("shuffle_merge"), "node", "left").select("node", F.coalesce("new", "community").alias("community"), "k"))
        q = modularity(nxt)
        if q > best + 1e-12:
            label, best, idle, gone = nxt, q, 0, label
        else:
            idle += 1
            gone = nxt
        scratch.drop(gone)
        if idle == 2:
            break
    return label.select("node", "community") if best > first else None


def bridges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes with an edge into another community: (node, outside)."""
    arcs = both_ways(edges)
    met = arcs.join(labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    return met.where("ca <> cb").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("outside"))


def paths(edges: DataFrame, start, goal, max_hops: int = 4, inverse: bool = True) -> DataFrame:
    """Simple paths from ``start`` to ``goal`` of at most ``max_hops`` edges: (path, hops, total_weight, cost), cost = 1/weight summed, or weight."""
    arcs = both_ways(edges, "weight")
    cost = 1 / F.col("weight") if inverse else F.col("weight")
    front = arcs.where(F.col("a") == F.lit(start)).select(F.array("a", "b").alias("path"), F.col("b").alias("at"), F.col("weight").alias("total_weight"), cost.alias("cost"))
    found = front.where(F.col("at") == F.lit(goal))
    for _ in range(max_hops - 1):
        front = front.where(F.col("at") != F.lit(goal)).join(arcs, front["at"] == arcs["a"]).where(~F.array_contains("path", F.col("b")))
        front = front.select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("at"), (F.col("total_weight") + F.col("weight")).alias("total_weight"), (F.col("cost") + cost).alias("cost"))
        found = found.unionByName(front.where(F.col("at") == F.lit(goal)))
    return found.select("path", (F.size("path") - 1).alias("hops"), "total_weight", "cost")


def cross_case_score(cases, total_cases):
    """0 for one case, else min(100, ln(cases) / ln(max(total, 2)) * 100)."""
    return F.when(cases <= 1, 0.0).otherwise(F.least(F.lit(100.0), F.log(cases.cast("double")) / F.log(F.greatest(total_cases, F.lit(2)).cast("double")) * 100))


def role_severity(edges: DataFrame) -> DataFrame:
    """(node, severity, score): over a node's pairs the sum of mean type weight * (.7 + .3 * severity of the evidence, where there is any), and that to 0..100 of the largest.

    Rows: (a, b, rel_type, w, severity), one per pair and type; the mean is over types of their summed weights. A null severity is none.
    """
    pairs = edges.groupBy("a", "b").agg(F.avg("w").alias("w"), F.coalesce(F.max("severity"), F.lit(0.0)).alias("severity"))
    worth = F.when(F.col("severity") > 0, F.col("w") * (0.7 + 0.3 * F.col("severity"))).otherwise(F.col("w"))
    nodes = both_ways(pairs.withColumn("worth", worth), "worth").groupBy(F.col("a").alias("node")).agg(F.sum("worth").alias("severity"))
    return _to_hundred(nodes, "severity")


def activity(edges: DataFrame, records: DataFrame) -> DataFrame:
    """(node, activity, score): 3 * degree + 2 * summed weights + records, and that to 0..100 of the largest. Rows: (a, b, weight) and (node, records)."""
    ends = both_ways(edges, "weight").groupBy(F.col("a").alias("node")).agg((3 * F.count("*") + 2 * F.sum("weight")).alias("base"))
    nodes = ends.join(records.hint("shuffle_merge"), "node", "left").select("node", (F.col("base") + F.coalesce("records", F.lit(0))).alias("activity"))
    return _to_hundred(nodes, "activity")


def _to_hundred(nodes: DataFrame, value: str) -> DataFrame:
    top = nodes.agg(F.coalesce(F.nullif(F.max(value), F.lit(0.0)), F.lit(1.0)).alias("top"))
    return nodes.crossJoin(F.broadcast(top)).select("node", value, (F.col(value) / F.col("top") * 100).alias("score"))


def importance(centrality: DataFrame, severity: DataFrame, cross_case: DataFrame, active: DataFrame) -> DataFrame:
    """(node, score and its four parts, band): .4 centrality + .3 role severity + .2 cross-case + .1 activity, each (node, score) of 0..100; a missing part is 0."""
    parts = {"centrality": (centrality, 0.4), "role": (severity, 0.3), "cross_case": (cross_case, 0.2), "activity": (active, 0.1)}
    out = None
    for name, (df, share) in parts.items():
        one = df.select("node", (F.col("score") * share).alias(name))
        out = one if out is None else out.join(one, "node", "full")
    total = sum((F.coalesce(name, F.lit(0.0)) for name in parts), F.lit(0.0))
    out = out.select("node", F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)).alias("score"), *[F.coalesce(n, F.lit(0.0)).alias(n) for n in parts])
    return out.withColumn("band", band(F.col("score")))
