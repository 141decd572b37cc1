"""Exact top-k inner products by best-first search in an M-tree.

The tree is tables: nodes with routing object, covering radius and distance to the parent's object, and leaf pages that hold vectors with their
distances to the leaf's object. By Cauchy-Schwarz and the triangle inequality <q, x> <= <q, c> + |q| * d(x, c), so what lies below a node
cannot reach a floor that this bound, over the node's radius, does not reach; over the parent's object the bound needs no product with the node's own one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave.plans.scratch import Scratch

PAGE_ROWS = 1024
FAN = 32  # a node has at most twice as many children
TASK_ROWS = 16384  # rows, or queries, that one group holds
SALTS = 16
ROOT = ""


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component; vectors that are null or hold null or non-finite components are left out."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    good = v.isNotNull() & ~F.coalesce(bad, F.lit(True))
    return rows.where(good).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _product(a: Column, b: Column) -> Column:
    """Inner product as double; the shorter vector counts as padded with zeros."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).cast("double") * F.coalesce(y, F.lit(0))), F.lit(0.0), lambda s, x: s + x)


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow((F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


@dataclass
class Tree:
    """``nodes``: (node, parent, depth, c, radius, to_parent, pages), pages 0 for an inner node; ``leaves``: (node, page, vec_id, v, away); ``depth``: of the deepest node; ``width`` of the vectors."""

    nodes: DataFrame
    leaves: DataFrame
    depth: int
    width: int


def build_tree(vectors: DataFrame, scratch: Scratch, *, page_rows: int = PAGE_ROWS, fan: int = FAN) -> Tree:
    """Bulk load of (vec_id, v), level by level, of all vectors.

    A node of more than ``page_rows`` rows that are not all equal takes as routing objects the vectors with the least and the greatest hash of each of ``fan`` cells,
    so at least two; each of its rows goes to the nearest. Rows are dealt in groups of bounded size whatever a node holds. The covering radius is the largest distance of any vector below.
    A leaf of equal vectors may hold more rows; it has several pages.
    """
    rows = scratch.write(vectors.withColumn("h", F.xxhash64("v")).withColumn("r", F.monotonically_increasing_id()))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    here = rows.select("vec_id", "v", "h", "r", F.lit(ROOT).alias("node"), F.lit(0.0).alias("away"))
    sizes = scratch.write(here.groupBy("node").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("away").alias("radius")))
    objects, node_parts, leaf_parts, depth = None, [], [], 0

    def route(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in ("vec_id", "v", "h", "r", "node", "away")})
        right = right.sort_values("child")
        c, kids = _matrix(right["c"], width).astype(float), right["child"].to_numpy()
        x = _matrix(left["v"], width).astype(float)
        at = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        out = left[["vec_id", "v", "h", "r"]].assign(node=kids[at], away=np.sqrt(((x - c[at]) ** 2).sum(axis=1)))
        return out.assign(vec_id=out["vec_id"].astype("Int64"))

    while True:
        is_open = (F.col("n") > page_rows) & (F.col("lo") != F.col("hi"))
        levels = sizes.withColumn("open", is_open).withColumn("depth", F.lit(depth)).withColumn("pages", F.when(is_open, 0).otherwise(F.ceil(F.col("n") / page_rows)).cast("long"))
        about = levels.select("node", "depth", "radius", "pages", "n", "open")
        if objects is None:
            node_parts.append(about.select("node", F.lit(None).cast("string").alias("parent"), "depth", F.array().cast("array<long>").alias("c"), "radius", F.lit(0.0).alias("to_parent"), "pages"))
        else:
            node_parts.append(about.join(objects.hint("shuffle_merge"), about["node"] == objects["child"]).select(about["node"], "parent", "depth", "c", "radius", "to_parent", "pages"))
        held = here.join(about.select("node", "pages", "n", "open").hint("shuffle_hash" if depth else "broadcast"), "node")
        leaf_parts.append(held.where("NOT open").select("node", F.pmod("r", F.greatest("pages", F.lit(1))).alias("page"), "vec_id", "v", "away"))
        if not about.where("open").limit(1).count():
            break
        depth += 1
        split = held.where("open").withColumn("cell", F.pmod(F.xxhash64("h", F.lit(depth)), F.lit(fan)))
        ends = split.groupBy("node", "cell").agg(F.array(F.min(F.struct("h", "v")), F.max(F.struct("h", "v"))).alias("ends"))
        found = scratch.write(ends.select("node", F.explode("ends").alias("e")).select("node", "e.h", F.col("e.v").alias("c")).dropDuplicates(["node", "h"]))
        parent_c = objects.select(F.col("child").alias("node"), F.col("c").alias("pc")) if objects is not None else None
        kids = found.withColumn("child", F.concat_ws("/", F.nullif("node", F.lit(ROOT)), F.hex("h")))
        kids = kids.join(parent_c.hint("shuffle_merge"), "node").withColumn("to_parent", _distance(F.col("c"), F.col("pc"))) if parent_c is not None else kids.withColumn("to_parent", F.lit(0.0))
        objects = scratch.write(kids.select(F.col("node").alias("parent"), "child", "c", "to_parent"))
        parts = F.ceil(F.col("n") / TASK_ROWS)
        dealt = split.withColumn("part", F.pmod("r", parts)).select("vec_id", "v", "h", "r", "node", "part")
        shown = objects.withColumnRenamed("parent", "node").join(about.where("open").select("node", "n").hint("shuffle_merge"), "node").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        schema = "vec_id long, v array<long>, h long, r long, node string, away double"
        here = scratch.write(dealt.groupBy("node", "part").cogroup(shown.select("node", "part", "child", "c").groupBy("node", "part")).applyInPandas(route, schema))
        sizes = scratch.write(here.groupBy("node").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("away").alias("radius")))
    nodes, leaves = node_parts[0], leaf_parts[0]
    for n, x in zip(node_parts[1:], leaf_parts[1:], strict=True):
        nodes, leaves = nodes.unionByName(n), leaves.unionByName(x)
    tree = Tree(scratch.write(nodes), scratch.write(leaves), depth, width)
    scratch.keep_only(tree.nodes, tree.leaves)
    return tree


def _children(front: DataFrame, tree: Tree, depth: int) -> DataFrame:
    """Queries at a node with each of its children. The root's are few; below, a node that many queries reach is salted."""
    kids = tree.nodes.where(F.col("depth") == depth).select(F.col("node").alias("child"), F.col("parent").alias("node"), "c", "radius", "to_parent", "pages")
    if depth == 1:  # at most twice FAN rows
        return front.join(F.broadcast(kids), "node")
    salted = front.withColumn("salt", F.pmod(F.xxhash64("query_id", "h"), F.lit(SALTS)))
    copies = kids.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies.hint("shuffle_hash"), ["node", "salt"]).drop("salt")


def _first_leaf(queries: DataFrame, tree: Tree) -> DataFrame:
    """Each query's leaf by greedy descent to the child with the largest product: (query_id, h, node, ip, pages)."""
    start = tree.nodes.where("depth = 0").select("node", "pages")  # one row
    front = queries.crossJoin(F.broadcast(start)).withColumn("ip", F.lit(0.0))
    done = front.where("pages > 0").select("query_id", "h", "node", "ip", "pages")
    for depth in range(1, tree.depth + 1):
        met = _children(front.where("pages = 0").drop("ip", "pages"), tree, depth)
        best = met.withColumn("ip", _product(F.col("q"), F.col("c"))).groupBy("query_id", "h").agg(F.max_by(F.struct("q", "child", "ip", "pages"), F.struct("ip", "child")).alias("t"))
        front = best.select("query_id", "h", "t.q", F.col("t.child").alias("node"), "t.ip", "t.pages")
        done = done.unionByName(front.where("pages > 0").select("query_id", "h", "node", "ip", "pages"))
    return done


def _reachable(queries: DataFrame, tree: Tree, scratch: Scratch) -> DataFrame:
    """Leaves whose bound reaches the query's ``floor``: (query_id, h, node, ip, bound, pages). A child that its distance to the parent's object rules out takes no product."""
    start = tree.nodes.where("depth = 0").select("node", "pages")  # one row
    reaches = lambda bound: bound + 1e-6 * (1 + F.abs(bound)) >= F.col("floor")
    front = queries.crossJoin(F.broadcast(start)).withColumn("ip", F.lit(0.0)).withColumn("bound", F.lit(float("inf")))
    out = front.where("pages > 0").select("query_id", "h", "node", "ip", "bound", "pages")
    for depth in range(1, tree.depth + 1):
        met = _children(front.where("pages = 0").drop("bound", "pages"), tree, depth)
        if depth > 1:
            met = met.where(reaches(F.col("ip") + F.col("norm") * (F.col("to_parent") + F.col("radius"))))
        met = met.withColumn("ip", _product(F.col("q"), F.col("c"))).withColumn("bound", F.col("ip") + F.col("norm") * F.col("radius")).where(reaches(F.col("bound")))
        front = scratch.write(met.select("query_id", "h", "q", "norm", "floor", F.col("child").alias("node"), "ip", "bound", "pages"))
        out = out.unionByName(front.where("pages > 0").select("query_id", "h", "node", "ip", "bound", "pages"))
    return out


def _search_pages(tree: Tree, wanted: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """The k best (query_id, h, vec_id, score) of each wanted leaf that reach the floor; wanted: (query_id, h, q, norm, floor, node, ip, pages).

    A vector whose distance to the leaf's object rules it out takes no product. Queries of a page that many want are dealt to several groups.
    """

    width = tree.width

    def search(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "h": [], "vec_id": [], "score": []})
        left = left.sort_values("away", ascending=False)
        x, away = _matrix(left["v"], width), left["away"].to_numpy()
        null = left["vec_id"].isna().to_numpy()
        ids = left["vec_id"].fillna(-1).astype("int64").to_numpy()
        key = np.where(null, np.iinfo(np.int64).max, ids)
        right = right.reset_index(drop=True)
        q, norm, ip, floor = _matrix(right["q"], width), right["norm"].to_numpy(), right["ip"].to_numpy(), right["floor"].to_numpy()
        slack = 1e-6 * (1 + np.abs(ip) + norm * away[0])
        open_floor = (norm == 0) | (floor == -np.inf)
        least = np.where(open_floor, -1.0, (floor - slack - ip) / np.where(norm == 0, 1.0, norm))
        upto = np.searchsorted(-away, -least, "right")  # rows from there on are too near the object to reach the floor
        order = np.argsort(upto, kind="stable")
        exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(width, 1) < 2**53  # then doubles hold every sum
        xf, qf = (x.astype(float), q.astype(float)) if exact else (x, q)
        own = right["query_id"].to_numpy()
        places, picked, scored = [], [], []
        for block in np.split(order, range(64, len(order), 64)):
            n = int(upto[block].max())
            scores = xf[:n] @ qf[block].T
            for j, place in enumerate(block):
                s = scores[:, j]
                good = np.flatnonzero((s >= floor[place]) & (null[:n] | (ids[:n] != own[place])))
                good = good[np.lexsort((key[good], -s[good]))[:k]]
                places.append(np.full(len(good), place))
                picked.append(good)
                scored.append(s[good])
        places, picked = np.concatenate(places), np.concatenate(picked)
        found = right[["query_id", "h"]].iloc[places].reset_index(drop=True)
        return found.assign(vec_id=pd.Series(ids[picked], dtype="Int64").mask(null[picked]), score=np.concatenate(scored).astype(np.int64))

    asked = wanted.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1)))
    parts = asked.groupBy("node", "page").agg(F.ceil(F.count("*") / TASK_ROWS).alias("parts"))
    parts = scratch.write(parts)
    pages = tree.leaves.join(parts.hint("shuffle_hash"), ["node", "page"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = asked.join(parts.hint("shuffle_hash"), ["node", "page"]).withColumn("part", F.pmod(F.xxhash64("query_id", "h"), F.col("parts")))
    keys = ["node", "page", "part"]
    both = pages.select(*keys, "vec_id", "v", "away").groupBy(*keys).cogroup(dealt.select(*keys, "query_id", "h", "q", "norm", "floor", "ip").groupBy(*keys))
    return scratch.write(both.applyInPandas(search, "query_id long, h long, vec_id long, score long"))


def search_tree(tree: Tree, queries: DataFrame, scratch: Scratch, *, k: int = 10, stats: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (query_id, v), each answered once per distinct vector.

    A query first searches the leaf of a greedy descent. Its k-th score is the floor for the descent to all leaves that can reach it, which it then visits by falling bound, in waves
    of 8, 64, ... leaves; after each the floor rises and leaves below it go. ``stats`` receives the visits of each wave.
    """
    norm = F.sqrt(_product(F.col("q"), F.col("q")))
    queries = scratch.write(queries.select("query_id", F.col("v").alias("q"), F.xxhash64("query_id", "v").alias("h")).dropDuplicates(["query_id", "h"]).withColumn("norm", norm))
    order = Window.partitionBy("query_id", "h").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    first = scratch.write(_first_leaf(queries, tree))
    keys, low = ["query_id", "h"], F.lit(float("-inf"))
    best = _search_pages(tree, first.join(queries.withColumn("floor", low).hint("shuffle_merge"), keys), k, scratch)
    best = scratch.write(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))

    def with_floor(found: DataFrame) -> DataFrame:
        floors = found.groupBy(*keys).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
        return queries.join(floors.hint("shuffle_merge"), keys, "left").withColumn("floor", F.coalesce("floor", low))

    asked = scratch.write(with_floor(best))
    left = scratch.write(_reachable(asked, tree, scratch).join(first.select(*keys, "node").hint("shuffle_merge"), [*keys, "node"], "left_anti"))
    wave, visits = 8, []
    while True:
        asked = with_floor(best)
        open_leaves = left.join(asked.hint("shuffle_merge"), keys).where(F.col("bound") + 1e-6 * (1 + F.abs("bound")) >= F.col("floor"))
        turn = Window.partitionBy(*keys).orderBy(F.col("bound").desc(), "node")
        placed = scratch.write(open_leaves.withColumn("turn", F.row_number().over(turn)).select(*keys, "node", "ip", "bound", "pages", "turn"))
        now = placed.where(F.col("turn") <= wave)
        visits.append(now.count())
        if not visits[-1]:
            break
        found = _search_pages(tree, now.drop("bound", "turn").join(asked.hint("shuffle_merge"), keys), k, scratch)
        met = best.unionByName(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
        best, left, wave = scratch.write(met), placed.where(F.col("turn") > wave).drop("turn"), wave * 8
    if stats is not None:
        stats["visits"] = visits
    scratch.keep_only(best)
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")


def top_k(rows: DataFrame, *, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", page_rows: int = PAGE_ROWS, fan: int = FAN, stats: dict | None = None) -> DataFrame:
    """For each row whose id is divisible by ``every``: the ``k`` highest inner products with the other rows, as (query_id, rank, vec_id, score).

    Ties go to the smaller id, a null id last. Rows with the query's id are no candidates. Shorter vectors count as padded with zeros. Repeated
    queries answer once; repeated candidates each count. Other columns play no part. No valid rows give no rows. Exact. See ``build_tree`` and ``search_tree``, for a tree that serves several searches.
    """
    scratch = Scratch(rows.sparkSession)
    tree = build_tree(valid_vectors(rows, id_col, vector_col, scale), scratch, page_rows=page_rows, fan=fan)
    asked = tree.leaves.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    return search_tree(tree, asked, scratch, k=k, stats=stats)


def op8_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
