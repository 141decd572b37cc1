"""Compression of vectors to codes: four parts, each replaced by the nearest entry of its codebook, fitted by exact k-means over metric trees.

Each part position has a forest of trees by the anchors hierarchy: among about n points some sqrt(n) anchors are chosen, each the point farthest from the
anchor that owns it, and take over points with the triangle inequality; anchors are joined pairwise upwards and cut again downwards (middle-out).
Balls cache the sum and the count of their points. A round descends with a list of codebook entries that could be nearest to any
point of the ball, each child inherits its parent's list, and where one entry is left the ball's sum and count go to it as a whole. Results are those of testing all pairs.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.textkernels import U, mix
from caseweave.plans.scratch import Scratch

PARTS, ENTRIES, ROUNDS = 4, 256, 4
TREE_ROWS = 4_096  # rows that a tree holds, about
LEAF = 48  # points below which a ball isn't cut
ROUTES = 32  # anchors that deal the points of a part to trees
SAMPLE = 2_048  # rows that those are chosen among; they decide which points share a tree, and no result
SALTS = 32
LARGEST = 1 << 26  # components beyond count as this, so that sums of squares fit


def anchor_points(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of at most ``k`` anchors, owner of each point, distance to it): each new anchor is the point farthest from its owner, and only points beyond half the distance between anchors are tested."""
    anchors = [0]
    owner = np.zeros(len(points), np.int64)
    away = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    while len(anchors) < k:
        far = int(away.argmax())
        if away[far] == 0:
            break
        apart = np.sqrt(((points[anchors] - points[far]) ** 2).sum(axis=1))
        open_ = np.flatnonzero(away > apart[owner] / 2)
        to_new = np.sqrt(((points[open_] - points[far]) ** 2).sum(axis=1))
        won = to_new < away[open_]
        taken = open_[won]
        owner[taken], away[taken] = len(anchors), to_new[won]
        owner[far], away[far] = len(anchors), 0.0
        anchors.append(far)
    return np.array(anchors), owner, away


class Ball:
    __slots__ = ("centre", "radius", "weight", "points", "children")

    def __init__(self, points: np.ndarray, centre: np.ndarray, radius: float, weight: int, children: tuple = ()):
        self.points, self.centre, self.radius, self.weight, self.children = points, centre, radius, weight, children


def _leaf(points: np.ndarray, x: np.ndarray, w: np.ndarray) -> Ball:
    weight = int(w[points].sum())
    centre = (x[points] * w[points, None]).sum(axis=0) / weight
    return Ball(points, centre, float(np.sqrt(((x[points] - centre) ** 2).sum(axis=1).max())), weight)


def _join(balls: list[Ball]) -> Ball:
    """Joins the two balls whose common ball is smallest, until one is left."""
    balls = list(balls)
    centres, radii = np.array([b.centre for b in balls]), np.array([b.radius for b in balls])

    def reach(i: int) -> np.ndarray:
        d = np.sqrt(((centres - centres[i]) ** 2).sum(axis=1))
        out = np.maximum((d + radii + radii[i]) / 2, np.maximum(radii, radii[i]))
        out[[j for j, b in enumerate(balls) if b is None]] = np.inf
        out[i] = np.inf
        return out

    cost = np.array([reach(i) for i in range(len(balls))])
    for _ in range(len(balls) - 1):
        i, j = divmod(int(cost.argmin()), len(balls))
        a, b = balls[i], balls[j]
        weight = a.weight + b.weight
        centre = (a.centre * a.weight + b.centre * b.weight) / weight
        radius = max(float(np.sqrt(((c.centre - centre) ** 2).sum())) + c.radius for c in (a, b))
        balls[i], balls[j] = Ball(np.concatenate([a.points, b.points]), centre, radius, weight, (a, b)), None
        centres[i], radii[i] = centre, radius
        cost[j], cost[:, j] = np.inf, np.inf
        cost[i] = reach(i)
        cost[:, i] = cost[i]
    return next(b for b in balls if b is not None)


def middle_out(points: np.ndarray, x: np.ndarray, w: np.ndarray) -> Ball:
    """The tree over ``points``, places in ``x`` with weights ``w``."""
    if len(points) <= LEAF:
        return _leaf(points, x, w)
    anchors, owner, _ = anchor_points(x[points], int(np.ceil(np.sqrt(len(points)))))
    if len(anchors) == 1:
        return _leaf(points, x, w)
    groups = [points[owner == i] for i in range(len(anchors))]
    return _join([middle_out(g, x, w) if len(g) > LEAF else _leaf(g, x, w) for g in groups])


def flat_tree(rows: np.ndarray, members: np.ndarray) -> dict:
    """A tree as plain arrays: distinct points in the order of the leaves, each ball with its run of points, children (-1 none), centre, radius, sum and count, root first."""
    distinct, back, w = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    root = middle_out(np.arange(len(distinct)), distinct.astype(float), w)
    order, balls, at = root.points, [], 0
    stack = [(root, -1, 0)]
    left, right = [], []
    while stack:
        ball, parent, first = stack.pop()
        me = len(balls)
        balls.append((first, first + len(ball.points), ball.centre))
        left.append(-1)
        right.append(-1)
        if parent >= 0:
            (left if left[parent] < 0 else right)[parent] = me
        for child in reversed(ball.children):
            start = first if child is ball.children[0] else first + len(ball.children[0].points)
            stack.append((child, me, start))
    points, w = distinct[order], w[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points.astype(np.int64) * w[:, None], axis=0)])
    counts = np.concatenate([[0], np.cumsum(w)])
    firsts, lasts = np.array([b[0] for b in balls]), np.array([b[1] for b in balls])
    radius = [float(np.sqrt(((points[a:b] - c) ** 2).sum(axis=1).max())) for a, b, c in balls]
    return {
        "members": members, "places": place[back.reshape(-1)].astype(np.int32), "points": points.reshape(-1).astype(np.int32), "weights": w.astype(np.int32), "left": np.array(left, np.int32), "right": np.array(right, np.int32),
        "first": firsts.astype(np.int32), "last": lasts.astype(np.int32), "centre": np.concatenate([b[2] for b in balls]), "radius": np.array(radius), "sums": (sums[lasts] - sums[firsts]).reshape(-1), "counts": counts[lasts] - counts[firsts],
    }


class Codebook:
    """Entries of one part, and what a descent needs of them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.real = entries.astype(float)
        self.apart = np.sqrt(((self.real[:, None, :] - self.real[None, :, :]) ** 2).sum(axis=2))
        self.first = np.sort(np.unique(entries, axis=0, return_index=True)[1])  # of equal entries, only the lowest can win
        self.norms = (self.entries**2).sum(axis=1)

    def distances(self, points: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Exact squared distances: in floating point where all sums are exact there, else in integers."""
        largest = max(int(np.abs(points).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        p = points.astype(np.int64)
        if points.shape[1] * 4 * largest**2 < 1 << 52:
            cross = (p.astype(float) @ self.real[among].T).astype(np.int64)
            return (p**2).sum(axis=1)[:, None] - 2 * cross + self.norms[among][None, :]
        return ((p[:, None, :] - self.entries[among][None, :, :]) ** 2).sum(axis=2)


def descend(tree: dict, book: Codebook):
    """(ball or None, place or None, entry or entries, ...) of every point: owned balls as (ball, entry), leaves as (first, last, entries of their points, squared distances)."""
    points = tree["points"].reshape(-1, book.entries.shape[1])
    centre = tree["centre"].reshape(-1, book.entries.shape[1])
    stack = [(0, book.first)]
    owned, tested = [], []
    while stack:
        ball, among = stack.pop()
        d2 = ((book.real[among] - centre[ball]) ** 2).sum(axis=1)
        best = int(d2.argmin())
        apart = book.apart[among[best], among]
        with np.errstate(divide="ignore", invalid="ignore"):
            beyond = (d2 - d2[best]) * (1 - 1e-9) / (2 * apart) - 1e-12 * (d2 + d2[best]) / np.maximum(apart, 1)
        keep = ~(beyond > tree["radius"][ball] * (1 + 1e-9) + 1e-9)
        keep[best] = True
        among = among[keep]
        if len(among) == 1:
            owned.append((ball, int(among[0])))
        elif tree["left"][ball] < 0:
            a, b = int(tree["first"][ball]), int(tree["last"][ball])
            d = book.distances(points[a:b], among)
            at = d.argmin(axis=1)
            tested.append((a, b, among[at], d[np.arange(b - a), at]))
        else:
            stack += [(int(tree["left"][ball]), among), (int(tree["right"][ball]), among)]
    return owned, tested


_LISTS = {"members": pa.int64(), "places": pa.int32(), "points": pa.int32(), "weights": pa.int32(), "left": pa.int32(), "right": pa.int32(), "first": pa.int32(), "last": pa.int32(), "centre": pa.float64(), "radius": pa.float64(), "sums": pa.int64(), "counts": pa.int64()}
_TREE = pa.schema([("part", pa.int32())] + [(n, pa.list_(t)) for n, t in _LISTS.items()])
_SQL_TYPES = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double"}
_TREE_DDL = "part int, " + ", ".join(f"{n} array<{_SQL_TYPES[t]}>" for n, t in _LISTS.items())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _nearest(parts: np.ndarray, routes: np.ndarray) -> np.ndarray:
    return ((routes**2).sum(axis=1) - 2.0 * parts @ routes.T).argmin(axis=1)


def _route_counts(routes: list[np.ndarray], width: int):
    def rows(batches):
        n = np.zeros((PARTS, ROUTES), np.int64)
        for batch in batches:
            v = _matrix(batch.column(0), width)
            for p, x in enumerate(np.split(v, PARTS, axis=1)):
                n[p] += np.bincount(_nearest(x.astype(float), routes[p]), minlength=ROUTES)
        part, route = np.indices(n.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (part, route, n)], ["part", "route", "n"])

    return rows


def _deal(routes: list[np.ndarray], first_group: np.ndarray, groups: np.ndarray, width: int):
    schema = pa.schema([("grp", pa.int64()), ("part", pa.int32()), ("rid", pa.int64()), ("x", pa.list_(pa.int32()))])

    def rows(batches):
        for batch in batches:
            rid = batch.column(0).to_numpy()
            v = _matrix(batch.column(1), width)
            for p, x in enumerate(np.split(v, PARTS, axis=1)):
                near = _nearest(x.astype(float), routes[p])
                grp = first_group[p][near] + (mix(rid.view(U)) % groups[p][near].astype(U)).astype(np.int64)
                flat = pa.ListArray.from_arrays(np.arange(len(rid) + 1, dtype=np.int32) * x.shape[1], pa.array(np.ascontiguousarray(x).reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(np.full(len(rid), p, np.int32)), batch.column(0), flat], schema=schema)

    return rows


def _trees(width: int):
    def rows(batches):
        grp, part, rids, xs = None, None, [], []

        def tree():
            t = flat_tree(np.concatenate(xs), np.concatenate(rids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([t[n]], f.type) for n, f in zip(_LISTS, list(_TREE)[1:], strict=True))], schema=_TREE)

        for batch in batches:
            g, p, r = (batch.column(i).to_numpy() for i in range(3))
            x = _matrix(batch.column(3), width // PARTS)
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1), len(g)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if rids and (g[a] != grp):
                    yield tree()
                    rids, xs = [], []
                grp, part = g[a], int(p[a])
                rids.append(r[a:b])
                xs.append(x[a:b])
        if rids:
            yield tree()

    return rows


def _tree_of(batch: pa.RecordBatch, i: int) -> dict:
    return {n: batch.column(n)[i].values.to_numpy() for n in batch.schema.names if n != "part"}


def _round(books: list[Codebook]):
    """Sums and counts of the points of each entry: (part, entry, place, total, n), once a task."""

    def rows(batches):
        m, width = books[0].entries.shape
        total, n = np.zeros((PARTS, m, width), np.int64), np.zeros((PARTS, m), np.int64)
        for batch in batches:
            for i, part in enumerate(batch.column("part").to_pylist()):
                tree = _tree_of(batch, i)
                sums, points = tree["sums"].reshape(-1, width), tree["points"].reshape(-1, width)
                owned, tested = descend(tree, books[part])
                for ball, e in owned:
                    total[part, e] += sums[ball]
                    n[part, e] += tree["counts"][ball]
                for a, b, entries, _ in tested:
                    w = tree["weights"][a:b].astype(np.int64)
                    np.add.at(total[part], entries, points[a:b] * w[:, None])
                    np.add.at(n[part], entries, w)
        part, entry = np.nonzero(n)
        place = np.tile(np.arange(width), len(part))
        columns = [np.repeat(part, width), np.repeat(entry, width), place, total[part, entry].reshape(-1), np.repeat(n[part, entry], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "place", "total", "n"])

    return rows


def _codes(books: list[Codebook]):
    def rows(batches):
        for batch in batches:
            for i, part in enumerate(batch.column("part").to_pylist()):
                tree = _tree_of(batch, i)
                book = books[part]
                points = tree["points"].reshape(-1, book.entries.shape[1])
                owned, tested = descend(tree, book)
                entry, error = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
                for ball, e in owned:
                    a, b = tree["first"][ball], tree["last"][ball]
                    entry[a:b] = e
                    error[a:b] = ((points[a:b].astype(np.int64) - book.entries[e]) ** 2).sum(axis=1)
                for a, b, e, d in tested:
                    entry[a:b], error[a:b] = e, d
                at = tree["places"]
                yield pa.RecordBatch.from_arrays([pa.array(tree["members"]), pa.array(np.full(len(at), part, np.int32)), pa.array(entry[at].astype(np.int32)), pa.array(error[at])], ["rid", "part", "entry", "error"])

    return rows


@contextmanager
def _few_rows_a_batch(spark, rows: int):
    """A row that holds a tree is large; tasks take a few of them at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def vector_codes(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 1024) -> DataFrame:
    """Codes of all vectors under four codebooks of at most 256 entries, after four rounds of exact k-means.

    Components count as floor(scale * x), at most ``LARGEST`` in size. Codebooks begin as the parts of the 256 vectors of least id (rows that share an id by their components);
    of entries at one distance the lowest wins; an entry becomes the floor of its parts' mean and stays where it has none. Returns vec_id, code (two hex digits a part),
    error (squared distance to the entries), label_error (error summed over the rows of the label, null being a label), codebooks_sha256.

    Rows whose vector is null or holds null, NaN or infinite components are left out; shorter vectors, empty ones too, count as padded with zeros to the longest, and that to a multiple of four.
    Repeated rows and ids are rows of their own; null ids come first. Other columns aren't read. No vectors give no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    v = F.col(vector_col)
    floors = F.transform(v, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    kept = rows.where(valid(v)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), floors.alias("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 1
    width = -(-longest // PARTS) * PARTS
    padded = F.when(F.size("v") == width, F.col("v")).otherwise(F.concat("v", F.array_repeat(F.lit(0), F.lit(width) - F.size("v"))))
    base = scratch.write(kept.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", padded.alias("v")))

    seeds = base.select("vec_id", "v").orderBy("vec_id", "v").limit(ENTRIES).collect()
    if not seeds:
        return base.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = [np.ascontiguousarray(x) for x in np.split(np.array([r.v for r in seeds], np.int64), PARTS, axis=1)]
    some = np.array([r.v for r in base.select("v", F.xxhash64("rid", "v").alias("h")).orderBy("h").limit(SAMPLE).collect()], float)
    routes = []
    for x in np.split(some, PARTS, axis=1):
        at = anchor_points(x, ROUTES)[0]
        routes.append(x[at])
    dealt = base.select("v").mapInArrow(_route_counts(routes, width), "part long, route long, n long").groupBy("part", "route").agg(F.sum("n").alias("n")).collect()
    groups = np.ones((PARTS, ROUTES), np.int64)
    for r in dealt:
        groups[r.part, r.route] = max(1, -(-r.n // TREE_ROWS))
    first_group = (np.cumsum(groups.ravel()) - groups.ravel()).reshape(groups.shape)
    parts = base.select("rid", "v").mapInArrow(_deal(routes, first_group, groups, width), "grp long, part int, rid long, x array<int>")
    trees = scratch.write(parts.repartition("grp").sortWithinPartitions("grp").mapInArrow(_trees(width), _TREE_DDL))

    with _few_rows_a_batch(spark, 32):
        for _ in range(ROUNDS):
            needed = trees.drop("members", "places")
            sums = needed.mapInArrow(_round([Codebook(b) for b in books]), "part long, entry long, place long, total long, n long")
            for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
                books[r.part][r.entry, r.place] = r.total // r.n
        found = trees.select("part", "members", "places", "points", "left", "right", "first", "last", "centre", "radius")
        found = found.mapInArrow(_codes([Codebook(b) for b in books]), "rid long, part int, entry int, error long")
        about = base.select("rid", F.lit(-1).alias("part"), F.lit(0).alias("entry"), F.lit(0).cast("long").alias("error"), "vec_id", "label")
        absent = {"vec_id": F.lit(None).cast("long"), "label": F.lit(None).cast(base.schema["label"].dataType)}
        code = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("part") == p, F.col("entry"))))), 2, "0") for p in range(PARTS)]
        coded = about.unionByName(found.withColumns(absent)).groupBy("rid").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.concat(*code).alias("code"), F.sum("error").alias("error"))
        coded = scratch.write(coded)
    scratch.drop(base, trees)
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    totals = totals.withColumnRenamed("label", "of_label").withColumnRenamed("salt", "of_salt")
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    out = salted.join(totals.hint("shuffle_merge"), F.col("label").eqNullSafe(F.col("of_label")) & (F.col("salt") == F.col("of_salt")))
    said = ",".join(str(x) for b in books for x in b.ravel().tolist())
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(said.encode()).hexdigest()).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, their errors and the digest of the codebooks."""
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """All pairs of parts and entries, component by component, in each of four rounds and once more."""
    steps = ["""
c AS MATERIALIZED (SELECT r, pos - 1 AS pos, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM
  (SELECT vec_id AS r, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)),
d AS (SELECT (max(pos) + 1) // 4 AS w FROM c),
k AS MATERIALIZED (SELECT r, pos // w AS p, pos % w AS j, x FROM c, d),
s AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS e FROM (SELECT DISTINCT r FROM k) QUALIFY e < 256),
b0 AS MATERIALIZED (SELECT p, e, j, x FROM k JOIN s USING (r))"""]  # fmt: skip
    for i in range(ROUNDS + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT r, p, min((d, e)) AS best FROM (SELECT k.r, k.p, b.e, sum((k.x - b.x) * (k.x - b.x))::BIGINT AS d FROM k JOIN b{i} b ON k.p = b.p AND k.j = b.j GROUP BY ALL) GROUP BY r, p)""")
        if i < ROUNDS:
            steps.append(f"""
m{i} AS (SELECT k.p, a.best[2] AS e, k.j, CAST(sum(k.x) AS BIGINT) AS t, count(*) AS n FROM k JOIN a{i} a ON a.r = k.r AND a.p = k.p GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, CASE WHEN t IS NULL THEN b.x WHEN t >= 0 OR t % n = 0 THEN t // n ELSE t // n - 1 END AS x FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.e = b.e AND m.j = b.j)""")
    steps.append(f"""
f AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT f.r AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) FROM b{ROUNDS}) AS codebooks_sha256
FROM f JOIN embeddings ON vec_id = f.r""")
    return "WITH" + ",".join(steps)


#: For rows of distinct ids and finite vectors of one length, which the given tables have.
OP13_SQL = _sql()
