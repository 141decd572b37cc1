"""Strongest connections between two nodes: the least-cost path and its heaviest alternatives, without listing all paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.operators.graph import both_ways
from caseweave.plans.scratch import Scratch

FIRST_WAVE, LARGEST_WAVE = 256, 65_536  # partial paths that one wave extends


def _arcs(edges: DataFrame, scratch: Scratch) -> DataFrame:
    good = edges.where("a <> b AND weight >= 0").select("a", "b", F.col("weight").cast("double").alias("weight"))
    return scratch.write(both_ways(good, "weight").groupBy("a", "b").agg(F.min("weight").alias("weight")))


def cheapest_path(edges: DataFrame, start, goal, max_rounds: int = 10_000, scratch: Scratch | None = None, arcs: DataFrame | None = None):
    """(path, cost) of least summed weight, or None where there is none; ties to fewer edges, then to the path that sorts first.

    A frontier of improved nodes relaxes its arcs, each node keeping its best (cost, edges, path); what costs more than the goal's best so far is dropped, so the
    search stays within the ball around ``start`` that the answer needs. Each round is two equi-joins and an aggregation over the frontier's arcs.
    Edges: (a, b, weight), undirected; those without weight or with a negative one are left out, parallel ones count with the least.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    arcs = _arcs(edges, scratch) if arcs is None else arcs
    if start == goal:
        return ([start], 0.0) if not arcs.where(F.col("a") == F.lit(start)).isEmpty() else None
    kind = arcs.schema["a"].dataType
    first = arcs.limit(1).select(F.lit(start).cast(kind).alias("node"), F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.array(F.lit(start).cast(kind)).alias("path")).alias("label"))
    known = front = scratch.write(first)
    limit = float("inf")
    for _ in range(max_rounds):
        near = front.where((F.col("label.cost") <= limit) & (F.col("node") != F.lit(goal))).join(arcs.hint("shuffle_merge"), F.col("node") == F.col("a"))
        longer = F.struct((F.col("label.cost") + F.col("weight")).alias("cost"), (F.col("label.hops") + 1).alias("hops"), F.concat("label.path", F.array("b")).alias("path"))
        tried = near.where(F.col("label.cost") + F.col("weight") <= limit).groupBy(F.col("b").alias("node")).agg(F.min(longer).alias("new"))
        better = tried.join(known.hint("shuffle_merge"), "node", "left").where("label IS NULL OR new < label").select("node", F.col("new").alias("label"))
        better = scratch.write(better)
        at_goal = better.where(F.col("node") == F.lit(goal)).select("label.cost").first()
        limit = at_goal.cost if at_goal else limit
        if better.isEmpty():
            break
        known, old = scratch.write(known.unionByName(better).groupBy("node").agg(F.min("label").alias("label"))), (known, front)
        scratch.drop(*old)
        front = better
    found = known.where(F.col("node") == F.lit(goal)).select("label.path", "label.cost").first()
    scratch.drop(known, front)
    return (list(found.path), found.cost) if found else None


def _reach(arcs: DataFrame, start, goal, limit: int, scratch: Scratch) -> DataFrame:
    """(node, left, tops): what at most ``left`` more edges can add on the way to the goal, as the ``limit`` + 1 best next nodes with bounds of their own.

    A bound is the heaviest walk that doesn't turn straight back; no simple path weighs more, and a next node outside the path is always among that many.
    """
    inner = arcs.where((F.col("b") != F.lit(start)) & (F.col("a") != F.lit(goal)))
    direct = inner.where(F.col("b") == F.lit(goal)).select(F.col("a").alias("node"), F.struct(F.col("weight").alias("most"), F.col("b").alias("next")).alias("option"))
    onward = scratch.write(inner.where(F.col("b") != F.lit(goal)))
    best = lambda options: options.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("option"), asc=False), 1, limit + 1).alias("tops"))
    levels = [scratch.write(best(direct))]
    for _ in range(limit - 1):
        back = levels[-1].select(F.col("node").alias("b"), "tops")
        ahead = F.filter("tops", lambda o: o["next"] != F.col("a"))
        met = onward.join(back.hint("shuffle_merge"), "b").where(F.size(ahead) > 0)
        step = met.select(F.col("a").alias("node"), F.struct((F.col("weight") + ahead[0]["most"]).alias("most"), F.col("b").alias("next")).alias("option"))
        levels.append(scratch.write(best(step.unionByName(direct))))
    out = levels[0].withColumn("left", F.lit(1))
    for i, level in enumerate(levels[1:], 2):
        out = out.unionByName(level.withColumn("left", F.lit(i)))
    return out


def strongest_paths(edges: DataFrame, start, goal, top: int = 3, extra_hops: int = 3) -> DataFrame:
    """(rank, is_primary, path, hops, weight): the least-cost path, then the ``top`` - 1 heaviest other simple paths of at most ``extra_hops`` more edges; ties to the path that sorts first.

    The alternatives come from a best-first search: partial paths are extended by falling bound (their weight plus the heaviest walk that could follow), in waves, and those
    that cannot reach the worst kept alternative are dropped. The driver holds the kept paths only. Bounds prune well where weights differ; on a dense graph of equal
    weights as many partial paths stay open as tie. No path, or a start or goal outside the graph, gives no rows.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    arcs = _arcs(edges, scratch)
    kind = arcs.schema["a"].dataType
    schema = f"rank int, is_primary boolean, path array<{kind.simpleString()}>, hops int, weight double"
    primary = cheapest_path(edges, start, goal, scratch=scratch, arcs=arcs)
    if primary is None:
        scratch.keep_only()
        return spark.createDataFrame([], schema)
    kept: list[tuple[float, list]] = []
    if start != goal and top > 1:
        kept = _alternatives(arcs, start, goal, primary[0], top - 1, len(primary[0]) - 1 + extra_hops, scratch)
    scratch.keep_only()
    rows = [(1, True, primary[0], len(primary[0]) - 1, float(primary[1]))]
    rows += [(i, False, path, len(path) - 1, weight) for i, (weight, path) in enumerate(kept, 2)]
    return spark.createDataFrame(rows, schema)


def _alternatives(arcs: DataFrame, start, goal, primary: list, wanted: int, limit: int, scratch: Scratch) -> list[tuple[float, list]]:
    kind = arcs.schema["a"].dataType
    reach = scratch.write(_reach(arcs, start, goal, limit, scratch))
    open_ = scratch.write(arcs.limit(1).select(F.array(F.lit(start).cast(kind)).alias("path"), F.lit(start).cast(kind).alias("at"), F.lit(0.0).alias("weight"), F.lit(float("inf")).alias("bound")))
    kept: list[tuple[float, list]] = []
    size = FIRST_WAVE
    while True:
        floor = kept[-1][0] - 1e-9 if len(kept) == wanted else float("-inf")
        live = open_.where(F.col("bound") >= floor)
        cut = live.select("bound").orderBy(F.col("bound").desc()).limit(size).agg(F.min("bound")).first()[0]
        if cut is None:
            return kept
        wave = live.where(F.col("bound") >= cut).join(arcs.hint("shuffle_merge"), F.col("at") == F.col("a")).where(~F.array_contains("path", F.col("b")))
        wave = scratch.write(wave.select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("at"), (open_["weight"] + arcs["weight"]).alias("weight")))
        done = wave.where((F.col("at") == F.lit(goal)) & (F.col("path") != F.array(*[F.lit(x).cast(kind) for x in primary]))).orderBy(F.col("weight").desc(), "path").limit(wanted).collect()
        kept = sorted([*kept, *((r.weight, list(r.path)) for r in done)], key=lambda x: (-x[0], x[1]))[:wanted]
        floor = kept[-1][0] - 1e-9 if len(kept) == wanted else float("-inf")
        far = wave.where(F.col("at") != F.lit(goal)).withColumn("left", F.lit(limit) - (F.size("path") - 1)).where("left > 0")
        far = far.join(reach.withColumnRenamed("node", "at").hint("shuffle_merge"), ["at", "left"])
        ahead = F.filter("tops", lambda o: ~F.array_contains("path", o["next"]))
        far = far.withColumn("bound", F.col("weight") + F.get(ahead, F.lit(0))["most"]).where(F.col("bound") >= floor).select("path", "at", "weight", "bound")
        following = scratch.write(live.where((F.col("bound") < cut) & (F.col("bound") >= floor)).unionByName(far))
        scratch.drop(open_, wave)
        open_, size = following, min(size * 8, LARGEST_WAVE)


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(rank, hop, src, dst and the columns of ``edges`` but its ends) of each step of ``strongest_paths``; ``edges`` has one row per pair (a, b), whichever way round."""
    steps = paths.select("rank", F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("src"), F.slice("path", 2, F.size("path") - 1).alias("dst"))).alias("hop", "ends")).select("rank", (F.col("hop") + 1).alias("hop"), "ends.*")
    about = edges.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).drop("a", "b")
    met = steps.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")}).join(about.hint("shuffle_merge"), ["lo", "hi"], "left")
    return met.drop("lo", "hi")
