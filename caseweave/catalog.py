"""Registry of queries over the driver's tables: name to function and, where SQL can say it, to the same query in SQL.

The tables hold no case files, so each query reads a view that gives the operator's input the shape it needs; see ``VIEWS`` for the same views in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave import sources
from caseweave.functions import band, haversine_km
from caseweave.operators import audit, detect, graph, incidents, linkage, report, resolution, series, text
from caseweave.plans.blocks import dealt
from caseweave.plans.fixpoint import connected_components
from caseweave.plans.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VIEWS = {
    "comm": "SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, l_orderkey AS case_id, l_shipdate AS ts, l_quantity::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "ev": "SELECT event_id, ts, user_id, event_type, value, regexp_extract(props, '\"k\": ([0-9]+)', 1)::INT AS k, strftime(ts, '%Y-%m-%d') AS day FROM events",
    "hop": "SELECT * FROM (SELECT event_id, lag(user_id) OVER (PARTITION BY event_type, k ORDER BY ts, event_id) AS src, user_id AS dst, event_type, day AS case_id, ts, value AS amount, value AS weight FROM ev) WHERE src <> dst",
    "flow": "SELECT * FROM hop WHERE event_type = 'purchase'",
    "presence": "SELECT user_id AS person, k AS location, day AS slot FROM ev",
    "ent": "SELECT l_orderkey * 10 + l_linenumber AS entity_id, l_orderkey AS case_id, 'Person' AS entity_type, s_name AS name, l_quantity / 50.0 AS confidence, l_returnflag = 'R' AS unresolved FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "trade": "SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, round(avg(l_discount) * 100, 6) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL",
    "caserec": "SELECT c_custkey AS case_id, (c_custkey % 60 + 15)::INT AS victim_age, CASE WHEN c_custkey % 2 = 0 THEN 'm' ELSE 'f' END AS victim_gender, lower(c_mktsegment) AS victim_occupation, CASE WHEN c_acctbal > 5000 THEN 'high' ELSE 'low' END AS victim_risk, 'n' || c_nationkey AS approach, c_mktsegment AS control, '' AS scene, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'w' || c_custkey % 5 END AS weapon, (c_custkey % 11)::DOUBLE AS overkill, list_distinct(list(strftime(o_orderdate, '%Y%m%d') || o_orderpriority)) AS signatures FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL",
}
#: Views that other modules add: functions of a table reader.
EXTRA_VIEWS: dict[str, Callable] = {}
_NEEDS = {"hop": ["ev"], "flow": ["ev", "hop"], "presence": ["ev"]}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    t = lambda n: _table(spark, sf_dir, n)
    if name in EXTRA_VIEWS:
        return EXTRA_VIEWS[name](t)
    if name == "comm":
        lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_quantity")
        j = dealt(lines, "l_orderkey").join(t("orders").select("o_orderkey", "o_custkey").hint("shuffle_merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        return j.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("l_orderkey").alias("case_id"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").cast("double").alias("weight"))
    if name == "ev":
        return t("events").select("event_id", "ts", "user_id", "event_type", "value", F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("int").alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    if name in ("hop", "flow"):
        w = Window.partitionBy("event_type", "k").orderBy("ts", "event_id")
        hop = _view(spark, sf_dir, "ev").select("event_id", F.lag("user_id").over(w).alias("src"), F.col("user_id").alias("dst"), "event_type", F.col("day").alias("case_id"), "ts", F.col("value").alias("amount"), F.col("value").alias("weight"))
        return (hop if name == "hop" else hop.where("event_type = 'purchase'")).where("src <> dst")
    if name == "presence":
        return _view(spark, sf_dir, "ev").select(F.col("user_id").alias("person"), F.col("k").alias("location"), F.col("day").alias("slot"))
    if name == "ent":
        j = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entity_id"), F.col("l_orderkey").alias("case_id"), F.lit("Person").alias("entity_type"), F.col("s_name").alias("name"), (F.col("l_quantity") / 50.0).alias("confidence"), (F.col("l_returnflag") == "R").alias("unresolved"), F.lit(None).cast("long").alias("merged_into"))
    if name == "trade":
        j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
        return j.groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.round(F.avg("l_discount") * 100, 6).alias("weight"))
    assert name == "caserec"
    k = F.col("c_custkey")
    j = t("customer").join(t("orders"), k == F.col("o_custkey")).groupBy("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal").agg(F.collect_set(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), "o_orderpriority")).alias("signatures"))
    return j.select(
        k.alias("case_id"), (k % 60 + 15).cast("int").alias("victim_age"), F.when(k % 2 == 0, "m").otherwise("f").alias("victim_gender"), F.lower("c_mktsegment").alias("victim_occupation"),
        F.when(F.col("c_acctbal") > 5000, "high").otherwise("low").alias("victim_risk"), F.concat(F.lit("n"), "c_nationkey").alias("approach"), F.col("c_mktsegment").alias("control"), F.lit("").alias("scene"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("w"), k % 5)).alias("weapon"), (k % 11).cast("double").alias("overkill"), "signatures",
    )


def query(name: str, views: str = "", tables: str = "", sql: str | None = None):
    """Registers a function of the named views and tables."""
    names = views.split()

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[_view(spark, sf_dir, v) for v in names], *[_table(spark, sf_dir, t) for t in tables.split()])

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            used = dict.fromkeys(x for v in names for x in [*_NEEDS.get(v, []), v])
            parts = [f"{v} AS ({VIEWS[v]})" for v in used]
            body = sql.strip()
            if body.startswith("WITH "):
                body = f", {body[5:]}" if parts else body.replace("WITH ", "WITH RECURSIVE ", 1)
            SQL[name] = f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
        return f

    return register


_PAIR = "SELECT least(src, dst) AS a, greatest(src, dst) AS b, * FROM"


@query("det1_communication_burst", "comm", sql="SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n, count(DISTINCT case_id) AS cases, round(avg(weight), 6) AS avg_weight, CASE WHEN count(*) >= 6 THEN 'high' WHEN count(*) >= 4 THEN 'medium' ELSE 'low' END AS severity FROM comm WHERE src <> dst GROUP BY 1, 2 HAVING count(*) >= 2")
def _(comm):
    return detect.contact_bursts(comm).select("a", "b", "n", "cases", F.round("avg_weight", 6).alias("avg_weight"), "severity")


@query("det2_circular_flow", "flow", sql="""WITH e AS (SELECT src, dst, list(DISTINCT case_id) AS cs FROM flow GROUP BY 1, 2)
SELECT x.src AS a, x.dst AS b, y.dst AS c, len(list_distinct(x.cs || y.cs || z.cs))::INT AS cases, CASE WHEN len(list_distinct(x.cs || y.cs || z.cs)) > 1 THEN 'high' ELSE 'medium' END AS severity
FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src WHERE x.src < x.dst AND y.dst > x.src""")
def _(flow):
    return detect.circular_flows(flow)


@query("det3_repeated_transfers", "flow", sql="SELECT src, dst, count(*) AS n, round(sum(amount), 4) AS total, count(*) FILTER (amount >= 5 AND amount < 20) AS near_limit, count(*) FILTER (amount >= 5 AND amount < 20) >= 2 AS structuring FROM flow GROUP BY 1, 2 HAVING count(*) >= 2")
def _(flow):
    return detect.repeated_transfers(flow, 5.0, 20.0).withColumn("total", F.round("total", 4))


@query("det4_directional_funding", "hop", sql=f"""WITH t AS (SELECT a, b, count(*) AS transfers, list(DISTINCT case_id) AS ct FROM ({_PAIR} hop WHERE event_type = 'purchase') GROUP BY 1, 2),
c AS (SELECT a, b, count(*) AS contacts, list(DISTINCT case_id) AS cc FROM ({_PAIR} hop WHERE event_type = 'view') GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT a, b, transfers, contacts, len(list_intersect(ct, cc))::INT AS common_cases FROM t JOIN c USING (a, b) WHERE list_has_any(ct, cc)""")
def _(hop):
    return detect.directional_funding(hop.where("event_type = 'purchase'"), hop.where("event_type = 'view'"))


@query("det6_co_location", "presence flow", sql="""WITH p AS (SELECT DISTINCT person, location, slot FROM presence WHERE person IS NOT NULL),
j AS (SELECT x.person AS p1, y.person AS p2, x.location, count(*) AS joint FROM p x JOIN p y USING (location, slot) WHERE x.person < y.person GROUP BY ALL)
SELECT p1, p2, location, joint, CASE WHEN joint >= 3 THEN 'high' WHEN joint = 2 THEN 'medium' ELSE 'low' END AS severity FROM j
WHERE NOT EXISTS (FROM flow WHERE least(src, dst) = p1 AND greatest(src, dst) = p2)""")
def _(presence, flow):
    return detect.co_locations(presence, flow.select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("det7_short_lived_number", "comm", sql="""WITH e AS (SELECT src AS number, ts FROM comm UNION ALL SELECT dst, ts FROM comm)
SELECT number, count(*) AS n, floor((epoch(max(ts)) - epoch(min(ts))) / 86400)::BIGINT AS days, CASE WHEN floor((epoch(max(ts)) - epoch(min(ts))) / 86400) <= 7 THEN 'medium' ELSE 'low' END AS severity FROM e GROUP BY 1""")
def _(comm):
    return detect.short_lived_numbers(comm).select("number", "n", "days", "severity")


@query("det8_run_all", "comm flow hop presence", "documents")
def _(comm, flow, hop, presence, documents):
    """All detectors' alerts by type and severity, each detector with the parameters of its own query; medium where a detector gives no severity."""
    spark = comm.sparkSession
    rules = spark.createDataFrame([("circular_flow", True), ("repeated_transfer", True)], "rule_type string, is_enabled boolean")
    medium = lambda df: df.withColumn("severity", F.lit("medium"))
    emails = text.mentions(documents.select("doc_id", F.col("source").alias("case_id"), "text")).where("kind = 'email'")
    long_flows = detect.long_circular_flows(flow).withColumns({"nodes": F.array_join("path", "-"), "severity": F.when(F.col("cases") > 1, "high").otherwise("medium")})
    found = {
        "burst": detect.as_alerts(detect.contact_bursts(comm), "burst", ["a", "b"]),
        "circular_flow": detect.as_alerts(detect.circular_flows(flow), "circular_flow", ["a", "b", "c"]),
        "repeated_transfer": detect.as_alerts(medium(detect.repeated_transfers(flow, 5.0, 20.0)), "repeated_transfer", ["src", "dst"]),
        "directional_funding": detect.as_alerts(medium(detect.directional_funding(hop.where("event_type = 'purchase'"), hop.where("event_type = 'view'"))), "directional_funding", ["a", "b"]),
        "cross_case_name": detect.as_alerts(detect.cross_case_names(emails), "cross_case_name", ["entity_type", "name"]),
        "co_location": detect.as_alerts(detect.co_locations(presence, flow.select(F.col("src").alias("a"), F.col("dst").alias("b"))), "co_location", ["p1", "p2", "location"]),
        "short_lived_number": detect.as_alerts(detect.short_lived_numbers(comm), "short_lived_number", ["number"]),
        "rolling_burst": detect.as_alerts(medium(detect.rolling_bursts(hop, 24, 2)), "rolling_burst", ["a", "b"]),
        "long_circular_flow": detect.as_alerts(long_flows, "long_circular_flow", ["nodes"]),
    }
    return detect.run_all(found, rules).groupBy("alert_type", "severity").agg(F.count("*").alias("n"))


@query("win9_rolling_burst", "hop", sql=f"""WITH w AS (SELECT a, b, count(*) OVER (PARTITION BY a, b ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n FROM ({_PAIR} hop))
SELECT a, b, max(n) AS peak FROM w GROUP BY 1, 2 HAVING max(n) >= 2""")
def _(hop):
    return detect.rolling_bursts(hop, 24, 2).select("a", "b", "peak")


@query("jon7_event_correlation", "hop ev", sql="""WITH p AS (SELECT src || '-' || dst || '-' || case_id AS id, case_id, min(ts) AS first_ts, max(ts) AS last_ts FROM hop WHERE event_type = 'purchase' GROUP BY 1, 2),
x AS (SELECT day AS case_id, event_id, ts, event_type AS label FROM ev WHERE event_type = 'error')
SELECT id, p.case_id, min(event_id) AS event_id, arg_min(label, event_id) AS label, count(*) AS n_events FROM p JOIN x ON p.case_id = x.case_id AND x.ts BETWEEN first_ts - INTERVAL 3 DAY AND last_ts + INTERVAL 3 DAY GROUP BY 1, 2""")
def _(hop, ev):
    pairs = hop.where("event_type = 'purchase'").groupBy(F.concat_ws("-", "src", "dst", "case_id").alias("id"), "case_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return incidents.correlate(pairs, ev.where("event_type = 'error'").select(F.col("day").alias("case_id"), "event_id", "ts", F.col("event_type").alias("label")))


@query("jon6_location_pairs", "presence", sql="WITH p AS (SELECT DISTINCT person, location FROM presence WHERE person IS NOT NULL) SELECT x.location AS loc_a, y.location AS loc_b, count(*) AS shared FROM p x JOIN p y USING (person) WHERE x.location < y.location GROUP BY 1, 2")
def _(presence):
    return report.location_pairs(presence)


@query("agg1_canonical_entities", "ent", sql="SELECT lower(trim(name)) AS norm, arg_min(entity_id, (-confidence, entity_id)) AS canonical_id, max(confidence) AS confidence, count(*) AS record_count, count(DISTINCT case_id) AS cases, max(confidence) < 0.6 AS unconfirmed FROM ent GROUP BY 1")
def _(ent):
    return graph.canonical_entities(ent)


_EDGES_SQL = """WITH e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, event_type AS rel_type, case_id, ts, (CASE event_type WHEN 'purchase' THEN 0.95 WHEN 'view' THEN 0.85 ELSE 0.3 END) * coalesce(nullif(weight, 0), 1) AS w FROM hop),
t AS (SELECT a, b, rel_type, sum(w) AS w, count(*) AS n FROM e GROUP BY 1, 2, 3),
c AS (SELECT a, b, count(DISTINCT case_id) AS cases FROM e GROUP BY 1, 2),
r AS (SELECT a, b, round(sum(w), 4) AS weight, sum(n)::BIGINT AS n FROM t GROUP BY 1, 2)"""


def _edges(hop: DataFrame) -> DataFrame:
    return graph.roll_up_edges(hop.withColumn("rel_type", F.col("event_type")).withColumn("severity", F.lit(0.0)), {"purchase": 0.95, "view": 0.85})


@query("agg2_edge_roll_up", "hop", sql=_EDGES_SQL + " SELECT a, b, weight, n, cases::INT AS cases, cases > 1 AS cross_case FROM r JOIN c USING (a, b)")
def _(hop):
    return _edges(hop).select("a", "b", F.round("weight", 4).alias("weight"), "n", "cases", "cross_case")


@query("gra2_degree_centrality", "hop", sql="WITH e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM hop), d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY 1) SELECT node, degree, round(degree / (SELECT count(*) - 1 FROM d), 9) AS centrality FROM d")
def _(hop):
    return graph.degree_centrality(_edges(hop)).withColumn("centrality", F.round("centrality", 9))


@query("gra12_components", "flow", sql="WITH e AS (SELECT src AS a, dst AS b FROM flow UNION SELECT dst, src FROM flow), r AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON r.node = e.a) SELECT node, min(c) AS component FROM r GROUP BY 1")
def _(flow):
    return connected_components(flow)


def _weighted(hop: DataFrame) -> DataFrame:
    """The rolled-up graph of all entities, written once: (a, b, weight)."""
    return Scratch(hop.sparkSession).write(_edges(hop).select("a", "b", "weight"))


def _combined(edges: DataFrame) -> DataFrame:
    return graph.combined_centrality(graph.degree_centrality(edges), graph.betweenness_centrality(edges), graph.eigenvector_centrality(edges))


@query("gra3_betweenness", "hop")
def _(hop):
    return graph.betweenness_centrality(_weighted(hop))


@query("gra4_eigenvector", "hop")
def _(hop):
    return graph.eigenvector_centrality(_weighted(hop)).withColumn("centrality", F.round("centrality", 4))


@query("gra5_combined_centrality", "hop")
def _(hop):
    return _combined(_weighted(hop)).withColumn("band", band(F.col("scaled")))


@query("gra6_communities", "hop")
def _(hop):
    return graph.communities(_weighted(hop))


@query("gra7_bridges", "hop")
def _(hop):
    edges = _weighted(hop)
    return graph.bridges(edges, graph.communities(edges))


@query("gra9_entity_paths", "hop")
def _(hop):
    """Paths between the first and the last entity of the rolled-up graph."""
    edges = _weighted(hop)
    first, last = edges.agg(F.min("a"), F.max("b")).first()
    return graph.paths(edges, first, last).select(F.array_join("path", "-").alias("path"), "hops", F.round("cost", 9).alias("cost"))


@query("gra9_paths", "trade", sql="WITH w AS (SELECT a, b, weight FROM trade UNION ALL SELECT b, a, weight FROM trade), p AS (SELECT '0-' || b AS path, 1 AS hops, 1 / weight AS cost FROM w WHERE a = 0 AND b = 24 UNION ALL SELECT '0-' || x.b || '-24', 2, 1 / x.weight + 1 / y.weight FROM w x JOIN w y ON x.b = y.a WHERE x.a = 0 AND y.b = 24 AND x.b NOT IN (0, 24)) SELECT path, hops::INT AS hops, round(cost, 9) AS cost FROM p")
def _(trade):
    return graph.paths(trade, 0, 24, 2).select(F.array_join("path", "-").alias("path"), "hops", F.round("cost", 9).alias("cost"))


@query("win1_intervals", "", "orders", sql="WITH d AS (SELECT o_custkey, o_orderdate::DATE AS d, row_number() OVER w AS seq, date_diff('day', lag(o_orderdate::DATE) OVER w, o_orderdate::DATE) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate::DATE)) SELECT o_custkey, seq, gap::INT AS gap FROM d WHERE gap IS NOT NULL")
def _(orders):
    return report.intervals(orders.withColumn("d", F.to_date("o_orderdate")), "o_custkey", "d").select("o_custkey", F.col("seq").cast("long").alias("seq"), "gap")


@query("win4_interval_trend", "", "orders", sql="""WITH d AS (SELECT o_custkey, row_number() OVER w AS seq, date_diff('day', lag(o_orderdate::DATE) OVER w, o_orderdate::DATE) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate::DATE)),
g AS (SELECT *, gap - lag(gap) OVER w AS change, lead(gap) OVER w - 2 * gap + lag(gap) OVER w AS second FROM d WHERE gap IS NOT NULL WINDOW w AS (PARTITION BY o_custkey ORDER BY seq))
SELECT o_custkey, count(*) AS gaps, CASE WHEN coalesce(bool_and(change > 0), true) THEN 'decelerating' WHEN coalesce(bool_and(change < 0), true) THEN 'accelerating' ELSE 'irregular' END AS trend, round(avg(second), 6) AS mean_second FROM g GROUP BY 1""")
def _(orders):
    gaps = report.intervals(orders.withColumn("d", F.to_date("o_orderdate")), "o_custkey", "d")
    return report.interval_trend(gaps, "o_custkey").withColumn("mean_second", F.round("mean_second", 6))


@query("win5_min_max", "", "customer", sql="SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) * 100, 6) AS scaled FROM customer")
def _(customer):
    return report.min_max(customer, "c_acctbal").select("c_custkey", F.round("scaled", 6).alias("scaled"))


@query("win8_neighbours", "", "conversations", sql="SELECT x.conv_id AS doc_id, x.name AS src, y.name AS dst FROM (SELECT conv_id, turn, role || turn AS name, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role || turn) AS i FROM conversations) x JOIN (SELECT conv_id, role || turn AS name, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role || turn) AS i FROM conversations) y ON x.conv_id = y.conv_id AND y.i BETWEEN x.i + 1 AND x.i + 9 WHERE x.name <> y.name")
def _(conversations):
    return text.neighbours(conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.concat("role", "turn").alias("name")), 10)


@query("top_suppliers_per_nation", "", "supplier", sql="SELECT s_nationkey, s_suppkey, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier) WHERE rank <= 10")
def _(supplier):
    return report.top_per(supplier, "s_nationkey", [F.col("s_acctbal").desc(), F.col("s_suppkey")], 10).select("s_nationkey", "s_suppkey", "rank")


@query("jon16_case_summary", "", "orders lineitem", sql="SELECT o_orderkey AS case_id, count(l_orderkey) AS items, count(*) FILTER (l_returnflag = 'R') AS returned FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(orders, lineitem):
    items = lineitem.select(F.col("l_orderkey").alias("case_id"), "l_returnflag")
    return report.case_summary(orders.select(F.col("o_orderkey").alias("case_id")), items=items, returned=items.where("l_returnflag = 'R'"))


@query("agg6_common_links", "ent", "orders", sql="SELECT entity_type, name, count(DISTINCT case_id) AS cases, count(*) AS records FROM ent WHERE case_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1, 2 HAVING count(DISTINCT case_id) >= 2")
def _(ent, orders):
    return report.common_links(ent, orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("case_id")))


@query("agg13_confidence_buckets", "ent", sql="SELECT CASE WHEN unresolved THEN 'unresolved' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n FROM ent GROUP BY 1")
def _(ent):
    return report.confidence_buckets(ent)


@query("flt2_entity_search", "", "customer", sql="SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00') ORDER BY c_name LIMIT 500")
def _(customer):
    return report.search(customer, "c_name", "00").select("c_custkey", "c_name")


@query("flt13_access_scope", "ent", "orders", sql="SELECT entity_id, case_id FROM ent WHERE case_id IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)")
def _(ent, orders):
    assigned = orders.select(F.concat(F.lit("u"), "o_custkey").alias("user_id"), F.col("o_orderkey").alias("case_id"))
    return report.scoped(ent, assigned, "u7").select("entity_id", "case_id")


@query("src6_file_digest", "", "documents", sql="SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def _(documents):
    return sources.new_files(sources.with_digest(documents), documents.sparkSession.createDataFrame([], "file_hash string"))


@query("src8_upsert_entities", "ent", sql="SELECT case_id, entity_type, name, max(confidence) AS confidence, count(*) AS records FROM ent GROUP BY 1, 2, 3")
def _(ent):
    e = ent.select("case_id", "entity_type", "name", "confidence")
    return sources.upsert_entities(e.limit(0), e)


@query("src9_upsert_edges", "hop", sql="SELECT case_id, least(src, dst) AS a, greatest(src, dst) AS b, event_type AS rel_type, max(weight) AS weight, count(*) AS records FROM hop GROUP BY 1, 2, 3, 4")
def _(hop):
    return sources.upsert_edges(hop.withColumnRenamed("event_type", "rel_type"))


@query("src12_delta", "ev", sql="SELECT count(*) AS rows, count(DISTINCT event_id) AS ids FROM ev")
def _(ev):
    out = sources.delta(ev, ev.sparkSession.createDataFrame([], "row_hash string"), ["event_id", "user_id", "value"])
    return out.agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("ids"))


@query("txt1_mentions", "", "documents", sql=r"""WITH m AS (
  SELECT doc_id, source AS case_id, 'phone' AS kind, 'Phone' AS entity_type, unnest(list_transform(regexp_extract_all(text, '(?:\+91[-\s]?)?0?[6-9]\d{9}\b|\d{3}[-.\s]\d{3}[-.\s]\d{4}\b|\(\d{3}\)\s*\d{3}[-.\s]\d{4}'), lambda x: right(regexp_replace(x, '[^0-9]', '', 'g'), 10))) AS name, 0 AS r FROM documents
  UNION ALL SELECT doc_id, source, 'email', 'Phone', unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')), 3 FROM documents)
SELECT DISTINCT ON (doc_id, lower(name)) doc_id, case_id, kind, entity_type, name FROM m ORDER BY doc_id, lower(name), r""")
def _(documents):
    found = text.mentions(documents.select("doc_id", F.col("source").alias("case_id"), "text"))
    return found.where("kind IN ('phone', 'email')").select("doc_id", "case_id", "kind", "entity_type", "name")


@query("det5_cross_case_names", "", "documents", sql=r"""WITH m AS (SELECT source AS case_id, 'Phone' AS entity_type, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS name FROM documents)
SELECT entity_type, name, count(DISTINCT case_id) AS cases, 'high' AS severity FROM m GROUP BY 1, 2 HAVING count(DISTINCT case_id) > 1""")
def _(documents):
    found = text.mentions(documents.select("doc_id", F.col("source").alias("case_id"), "text"))
    return detect.cross_case_names(found.where("kind = 'email'"))


@query("txt22_handles", "", "documents", sql=r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\w.@])@(\w[\w.]{0,29})', 1)) AS handle FROM documents")
def _(documents):
    return text.handles(documents)


_WORST = "list_max([" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN {v} ELSE 0.0 END" for w, v in text.SEVERITY.items()) + "])::DOUBLE"
_CLEARED = text.NEGATION.replace("'", "''")


@query("txt24_severity", "", "documents", sql=f"""WITH s AS (SELECT doc_id, CASE WHEN coalesce(length(text), 0) < 10 THEN 0.0 WHEN regexp_matches(lower(text), '{_CLEARED}') THEN {_WORST} * 0.15 ELSE {_WORST} END AS v FROM documents)
SELECT doc_id, round(v, 4) AS severity, CASE WHEN v >= 0.7 THEN 'strong' WHEN v >= 0.4 THEN 'moderate' WHEN v > 0 THEN 'weak' ELSE 'none' END AS level FROM s""")
def _(documents):
    lowered = documents.select("doc_id", "text", F.lower("text").alias("low"))
    scored = lowered.select("doc_id", text.severity(F.col("text"), F.col("low")).alias("score"))
    return scored.select("doc_id", F.round("score", 4).alias("severity"), text.severity_level(F.col("score")).alias("level"))


@query("txt30_signature_terms", "", "documents", sql="SELECT doc_id, len(list_filter([" + ", ".join(f"'{t}'" for t in text.SIGNATURE_TERMS) + "], lambda t: contains(lower(text), t)))::INT AS hits FROM documents")
def _(documents):
    return documents.select("doc_id", F.size(text.signature_terms(F.col("text"))).alias("hits"))


@query("txt7_capitalised_runs", "", "documents", sql=r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b[A-Z][a-z]+(?:[ ][A-Z][a-z]+){1,3}\b')) AS name FROM documents WHERE NOT regexp_matches(text, '[^\x00-\x7F]')")
def _(documents):
    return text.capitalised_runs(documents.where(~F.col("text").rlike(r"[^\x00-\x7F]")))


@query("txt7_all_capitalised_runs", "", "documents")
def _(documents):
    """The runs of every document; no SQL, as DuckDB's word boundaries know ASCII letters only."""
    return text.capitalised_runs(documents)


@query("sim1_tf_idf", "", "documents")
def _(documents):
    return linkage.tf_idf(documents, ["the", "and", "of", "to", "in"]).withColumn("weight", F.round("weight", 6))


@query("sim6_composite", "caserec", sql="""WITH s AS (SELECT case_id, unnest(signatures) AS g FROM caserec), p AS (SELECT DISTINCT x.case_id AS case_a, y.case_id AS case_b FROM s x JOIN s y USING (g) WHERE x.case_id < y.case_id),
j AS (SELECT case_a, case_b,
 round(0.7e0 * (len(list_intersect(a.signatures, b.signatures)) / len(list_distinct(a.signatures || b.signatures))) + 0.3e0 * (1 - least(abs(a.overkill - b.overkill) / 10e0, 1e0)), 12) AS signature,
 round(((1 - least(abs(a.victim_age - b.victim_age) / 50.0, 1.0)) + (a.victim_gender = b.victim_gender)::INT + (CASE WHEN a.victim_occupation = b.victim_occupation THEN 1.0 ELSE 0.0 END) + (a.victim_risk = b.victim_risk)::INT) / 4, 12) AS victim,
 round(((a.approach = b.approach)::INT + (a.control = b.control)::INT + 1.0 + CASE WHEN a.weapon <> '' AND b.weapon <> '' THEN (a.weapon = b.weapon)::INT ELSE 0.5 END) / 4, 12) AS method
 FROM p JOIN caserec a ON a.case_id = case_a JOIN caserec b ON b.case_id = case_b)
SELECT case_a, case_b, round(100 * (0.40 * signature + 0.20 * victim + 0.15 * method), 6) AS score FROM j""")
def _(caserec):
    out = linkage.signature_parts(caserec)
    return out.select("case_a", "case_b", F.round(100 * (0.40 * F.col("signature") + 0.20 * F.col("victim") + 0.15 * F.col("method")), 6).alias("score"))


@query("sim6_all_case_links", "caserec", "documents")
def _(caserec, documents):
    """Links from 60 with the narrative part; the narrative of a case is the document of its number. No SQL: it would be too slow."""
    scratch = Scratch(caserec.sparkSession)
    cases = scratch.write(caserec)
    narratives = documents.join(cases.select(F.col("case_id").alias("doc_id")), "doc_id", "left_semi")
    vectors = scratch.write(linkage.tf_idf(narratives, ["the", "and", "of", "to", "in"]))
    return linkage.case_links(cases, scratch.write(linkage.narrative_cosines(cases, vectors)))


@query("sca1_haversine", "", "orders customer", sql="SELECT o_orderkey, round(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)), 4) AS km FROM (SELECT o_orderkey, pow(sin(radians(c_nationkey * 3.0 - 36) / 2), 2) + cos(radians(c_nationkey * 3.0 - 36)) * pow(sin(radians(o_orderkey % 360 - 180) / 2), 2) AS h FROM orders JOIN customer ON o_custkey = c_custkey)")
def _(orders, customer):
    j = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.select("o_orderkey", F.round(haversine_km(F.lit(0.0), F.lit(0.0), F.col("c_nationkey") * 3.0 - 36, (F.col("o_orderkey") % 360 - 180).cast("double")), 4).alias("km"))


_CHAIN = ["event_id", "user_id", "event_type"]


@query("aud2_build_chain", "", "events", sql="WITH l AS (SELECT user_id, list(event_id || '|' || user_id || '|' || event_type ORDER BY event_id) AS p FROM events GROUP BY 1) SELECT user_id, len(p) AS blocks, list_reduce([repeat('0', 64)] || p, lambda h, x: sha256(x || '|' || h)) AS last_hash FROM l")
def _(events):
    chain = audit.build_chain(events, "user_id", "event_id", _CHAIN)
    return chain.groupBy("user_id").agg(F.count("*").alias("blocks"), F.max_by("block_hash", "block_index").alias("last_hash"))


@query("aud1_verify_chain", "", "events", sql="""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
SELECT user_id, count(*) AS blocks, min(i) FILTER (event_id % 89 = 0 OR event_id % 97 = 0) AS first_bad, arg_min(CASE WHEN event_id % 89 = 0 THEN 'link' ELSE 'hash' END, i) FILTER (event_id % 89 = 0 OR event_id % 97 = 0) AS reason FROM n GROUP BY 1""")
def _(events):
    """Some rows are tampered with after the chain was built: payloads of ids divisible by 97, links of those divisible by 89."""
    chain = audit.build_chain(events, "user_id", "event_id", _CHAIN)
    payload = events.select("user_id", "event_id", F.when(F.col("event_id") % 97 == 0, "tampered").otherwise(F.col("event_type")).alias("event_type"))
    blocks = chain.join(payload.hint("shuffle_merge"), ["user_id", "event_id"])
    blocks = blocks.withColumn("previous_hash", F.when(F.col("event_id") % 89 == 0, "broken").otherwise(F.col("previous_hash")))
    return audit.verify_chain(blocks, "user_id", _CHAIN)


@query("agg9_graph_stats", "hop", sql="SELECT event_type AS rel_type, count(*) AS n FROM hop GROUP BY 1")
def _(hop):
    return hop.groupBy(F.col("event_type").alias("rel_type")).agg(F.count("*").alias("n"))


@query("agg11_alert_cube", "comm", sql="SELECT severity, count(*) AS n FROM (SELECT CASE WHEN count(*) >= 6 THEN 'high' WHEN count(*) >= 4 THEN 'medium' ELSE 'low' END AS severity FROM comm GROUP BY least(src, dst), greatest(src, dst) HAVING count(*) >= 2) GROUP BY CUBE (severity)")
def _(comm):
    return detect.contact_bursts(comm).cube("severity").agg(F.count("*").alias("n"))


@query("gra15_cross_case_score", "ent", sql="WITH c AS (SELECT lower(trim(name)) AS norm, count(DISTINCT case_id) AS cases FROM ent GROUP BY 1), t AS (SELECT count(DISTINCT case_id) AS total FROM ent) SELECT norm, cases, round(CASE WHEN cases <= 1 THEN 0 ELSE least(100, ln(cases) / ln(greatest(total, 2)) * 100) END, 6)::DOUBLE AS score FROM c, t")
def _(ent):
    total = ent.agg(F.count_distinct("case_id").alias("total"))
    nodes = graph.canonical_entities(ent).crossJoin(F.broadcast(total))
    return nodes.select("norm", "cases", F.round(graph.cross_case_score(F.col("cases"), F.col("total")), 6).alias("score"))


_FAMILY_SQL = "SELECT doc_id, unnest([" + ", ".join("{'family': '" + f + "', 'matches': " + " + ".join(f"least(3, len(regexp_extract_all(text, '(?i){p}')))" for p in ps) + f", 'weight': {w}" + "}" for f, (w, ps) in series.SIGNATURE_FAMILIES.items()) + "], recursive := true) FROM documents"
_RISK_SQL = "[" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{r}' END" for r, p in series.RISKS.items()) + "]"
_GENDER_SQL = "[" + ", ".join("CASE WHEN " + " + ".join(rf"regexp_matches(lower(text), '\b{t}\b')::INT" for t in ts) + f" >= 2 THEN '{g}' END" for g, ts in series.GENDER_TERMS.items()) + "]"
_AGE_SQL = " || ".join(f"regexp_extract_all(lower(text), '{p}', 1)" for p in series.AGES)


@query("txt31_signature_families", "", "documents", sql=f"SELECT doc_id, family, matches::INT AS matches, round(least(0.5 + 0.15 * matches, 0.95), 6)::DOUBLE AS confidence, weight::DOUBLE AS weight FROM ({_FAMILY_SQL}) WHERE matches > 0")
def _(documents):
    return series.signature_families(documents).withColumn("confidence", F.round("confidence", 6))


@query("agg18_common_families", "", "documents", sql=f"SELECT count(*) AS common, round(count(*) / 7.0, 6)::DOUBLE AS overlap FROM (SELECT family FROM ({_FAMILY_SQL}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id) WHERE matches > 0 GROUP BY 1 HAVING count(DISTINCT source) >= 2)")
def _(documents):
    found = series.signature_families(documents).join(documents.select("doc_id", F.col("source").alias("case_id")).hint("shuffle_merge"), "doc_id")
    return series.common_families(found).withColumn("overlap", F.round("overlap", 6))


_METHOD_SQL = "SELECT doc_id, unnest([" + ", ".join(
    [f"{{'dim': '{d}', 'n': len(list_filter([" + ", ".join(f"'{w}'" for w in ws) + "], lambda w: contains(lower(text), w)))}" for d, ws in series.METHOD_WORDS.items()]
    + [f"{{'dim': '{d}', 'n': " + " + ".join(f"least(3, len(regexp_extract_all(lower(text), '{p}')))" for p in ps) + "}" for d, ps in series.METHOD_PATTERNS.items()]
) + "], recursive := true) FROM documents"


@query("txt28_method_indicators", "", "documents", sql=f"SELECT doc_id, dim, n::INT AS n FROM ({_METHOD_SQL}) WHERE n > 0")
def _(documents):
    return series.method_indicators(documents).select("doc_id", "dim", F.size("hits").alias("n"))


@query("txt29_victim_signals", "", "documents", sql=rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform({_AGE_SQL}, lambda x: x::INT), lambda x: x BETWEEN 10 AND 100))), ',') AS ages,
array_to_string(list_filter({_GENDER_SQL}, lambda x: x IS NOT NULL), ',') AS genders, array_to_string(list_filter({_RISK_SQL}, lambda x: x IS NOT NULL), ',') AS risks FROM documents""")
def _(documents):
    return series.victim_signals(documents).select("doc_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("ages", "genders", "risks")])


@query("txt32_victim_line", "", "documents", sql=rf"SELECT doc_id, nullif(trim(regexp_extract(v, '^(.+?)\s*,', 1)), '') AS name, TRY_CAST(regexp_extract(v, '(\d{{1,2}})\s*,', 1) AS INT) AS age, nullif(trim(regexp_extract(v, '\d{{1,2}}\s*,\s*(.+)', 1)), '') AS occupation FROM (SELECT doc_id, regexp_extract(text, '{series.VICTIM_LINE}', 1) AS v FROM documents)")
def _(documents):
    return series.victim_line(documents)


@query("agg19_victim_roll_up", "caserec", sql="SELECT min(victim_age) AS lowest, max(victim_age) AS highest, max(victim_age) - min(victim_age) AS spread, count(DISTINCT victim_occupation) AS occupations, count(victim_age) / count(DISTINCT case_id) AS score FROM caserec")
def _(caserec):
    return series.victim_roll_up(caserec.select("case_id", F.col("victim_age").alias("age"), F.col("victim_occupation").alias("occupation")))


def _header_sql() -> str:
    first = lambda ps: "substring(coalesce(" + ", ".join(f"nullif(trim(regexp_extract(text, '(?i){p}', 1)), '')" for p in ps) + ", ''), 1, 200)"
    return "SELECT doc_id, " + ", ".join(f"{first(ps)} AS {f}" for f, ps in text.HEADER.items()) + r" FROM documents WHERE NOT regexp_matches(text, '[^\x00-\x7F]')"


@query("txt21_case_header", "", "documents", sql=_header_sql())
def _(documents):
    return text.case_header(documents.where(~F.col("text").rlike(r"[^\x00-\x7F]"))).select("doc_id", *text.HEADER)


@query("txt21_all_case_headers", "", "documents")
def _(documents):
    """The fields of every document, empty ones of null texts; no SQL, as DuckDB's classes know ASCII letters only."""
    return text.case_header(documents).select("doc_id", *text.HEADER)


@query("agg15_shared_locations", "presence", sql="""WITH p AS (SELECT DISTINCT slot AS case_id, location FROM presence), n AS (SELECT count(DISTINCT case_id) AS cases FROM p),
s AS (SELECT count(*) AS shared FROM (SELECT location FROM p GROUP BY 1 HAVING count(*) >= 2)), q AS (SELECT count(*) AS pairs FROM (SELECT DISTINCT x.case_id, y.case_id FROM p x JOIN p y USING (location) WHERE x.case_id < y.case_id))
SELECT cases, shared, round(pairs / (CASE WHEN cases > 1 THEN cases * (cases - 1) / 2 ELSE 1 END), 3) AS score FROM n, s, q""")
def _(presence):
    return series.shared_locations(presence.select(F.col("slot").alias("case_id"), F.col("location").cast("string").alias("name")))


_LINKS_SQL = "SELECT entity_type, count(*) AS shared FROM (SELECT entity_type, lower(name) AS name FROM ent GROUP BY 1, 2 HAVING count(DISTINCT case_id) >= 2) GROUP BY ROLLUP (entity_type)"


@query("agg16_entity_links", "ent", sql=_LINKS_SQL)
def _(ent):
    return series.entity_links(ent)


_OVERLAP_SQL = """WITH t AS (SELECT DISTINCT day AS case_id, k AS term FROM ev WHERE event_type = 'error'), z AS (SELECT case_id, count(*) AS n FROM t GROUP BY 1), c AS (SELECT count(*) AS cases FROM z),
b AS (SELECT x.case_id AS a, y.case_id AS b, count(*) AS n FROM t x JOIN t y USING (term) WHERE x.case_id < y.case_id GROUP BY 1, 2), j AS (SELECT coalesce(sum(b.n / (za.n + zb.n - b.n)), 0) AS total FROM b JOIN z za ON za.case_id = a JOIN z zb ON zb.case_id = b.b),
m AS (SELECT count(*) AS common FROM (SELECT term FROM t GROUP BY 1 HAVING count(*) = (SELECT cases FROM c)))"""


def _error_terms(ev: DataFrame) -> DataFrame:
    return ev.where("event_type = 'error'").select(F.col("day").alias("case_id"), F.col("k").cast("string").alias("term"))


@query("agg17_signature_overlap", "ev", sql=_OVERLAP_SQL + " SELECT cases, round(CASE WHEN cases > 1 THEN total / (cases * (cases - 1) / 2) ELSE 0 END, 6) AS mean_overlap, common FROM c, j, m")
def _(ev):
    return series.signature_overlap(_error_terms(ev)).withColumn("mean_overlap", F.round("mean_overlap", 6))


@query("sim14_series_summary", "ev ent")
def _(ev, ent):
    """One row: the parts and the composite score of all cases as one series."""
    errors = _error_terms(ev)
    links = series.entity_links(ent).where("entity_type IS NULL").select("shared")
    place = series.shared_locations(errors.select("case_id", F.col("term").alias("name"))).select(F.col("score").alias("location"))
    both = series.signature_overlap(errors).crossJoin(F.broadcast(place)).crossJoin(F.broadcast(links))
    score = series.series_score(F.col("shared") / F.greatest("cases", F.lit(1)), F.col("location"), F.col("mean_overlap"), F.lit(False))
    return both.select("cases", "shared", "location", F.round("mean_overlap", 6).alias("mean_overlap"), F.round(score, 6).alias("score"), series.series_band(score).alias("band"))


def _text_cases(caserec: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    methods = F.when(F.col("weapon") == "", F.create_map().cast("map<string,array<string>>")).otherwise(F.create_map(F.lit("weapon"), F.array("weapon")))
    return caserec.select("case_id", F.col("signatures").alias("terms"), empty.alias("names"), methods.alias("methods"), F.array("victim_age").alias("ages"), F.array("victim_gender").alias("genders"), F.array("victim_risk").alias("risks"))


@query("sim10_text_links", "caserec", sql="""WITH s AS (SELECT case_id, unnest(signatures) AS g FROM caserec), p AS (SELECT DISTINCT x.case_id AS case_a, y.case_id AS case_b FROM s x JOIN s y USING (g) WHERE x.case_id < y.case_id),
j AS (SELECT case_a, case_b, len(list_intersect(a.signatures, b.signatures)) / len(list_distinct(a.signatures || b.signatures)) AS signature,
 (CASE WHEN a.weapon <> '' OR b.weapon <> '' THEN (a.weapon = b.weapon)::INT / 1.0e0 ELSE 0 END) AS method,
 (greatest(0, 1 - abs(a.victim_age - b.victim_age) / 15.0e0) + (a.victim_gender = b.victim_gender)::INT + (a.victim_risk = b.victim_risk)::INT) / 3 AS victim
 FROM p JOIN caserec a ON a.case_id = case_a JOIN caserec b ON b.case_id = case_b)
SELECT case_a, case_b, round(0.40e0 * signature + 0.25e0 * method + 0.20e0 * victim, 6) AS score FROM j WHERE signature > 0.1""")
def _(caserec):
    return series.text_links(_text_cases(caserec), 0.0, 0.1).select("case_a", "case_b", F.round("score", 6).alias("score"))


@query("sim10_all_text_links", "caserec", sql="""WITH j AS (SELECT a.case_id AS case_a, b.case_id AS case_b, len(list_intersect(a.signatures, b.signatures)) / len(list_distinct(a.signatures || b.signatures)) AS signature,
 (CASE WHEN a.weapon <> '' OR b.weapon <> '' THEN (a.weapon = b.weapon)::INT / 1.0e0 ELSE 0 END) AS method,
 (greatest(0, 1 - abs(a.victim_age - b.victim_age) / 15.0e0) + (a.victim_gender = b.victim_gender)::INT + (a.victim_risk = b.victim_risk)::INT) / 3 AS victim
 FROM caserec a JOIN caserec b ON a.case_id < b.case_id)
SELECT case_a, case_b, round(0.40e0 * signature + 0.25e0 * method + 0.20e0 * victim, 6) AS score FROM j WHERE 0.40e0 * signature + 0.25e0 * method + 0.20e0 * victim >= 0.25e0""")
def _(caserec):
    """Links from the operator's own minimum."""
    return series.text_links(_text_cases(caserec)).select("case_a", "case_b", F.round("score", 6).alias("score"))


_CLUSTER_SQL = """WITH l AS (SELECT a AS case_a, b AS case_b, weight AS score FROM trade), c AS (SELECT n_nationkey AS case_id, n_nationkey % 5 AS cluster, n_regionkey::VARCHAR AS region FROM nation),
m AS (SELECT cluster, count(*) AS members, count(DISTINCT region) AS regions FROM c GROUP BY 1),
s AS (SELECT cluster, avg(score) AS avg_score, max(score) AS max_score, arg_min(case_a, (-score, case_a, case_b)) AS anchor_a, arg_min(case_b, (-score, case_a, case_b)) AS anchor_b FROM l JOIN c ON case_a = case_id GROUP BY 1)
SELECT cluster, members, round(avg_score, 6) AS avg_score, max_score, anchor_a, anchor_b, regions, regions > 1 AS cross_region FROM m JOIN s USING (cluster)"""


@query("agg20_cluster_roll_up", "trade", "nation", sql=_CLUSTER_SQL)
def _(trade, nation):
    links = trade.select(F.col("a").alias("case_a"), F.col("b").alias("case_b"), F.col("weight").alias("score"))
    cases = nation.select(F.col("n_nationkey").alias("case_id"), (F.col("n_nationkey") % 5).alias("cluster"), F.col("n_regionkey").cast("string").alias("region"))
    return series.cluster_roll_up(links, cases.select("case_id", "cluster"), cases.select("case_id", "region")).withColumn("avg_score", F.round("avg_score", 6))


@query("agg20_community_roll_up", "hop")
def _(hop):
    """The communities of the rolled-up graph as clusters, the last digits of the entities as regions."""
    edges = _weighted(hop)
    found = graph.communities(edges)
    links = edges.select(F.col("a").alias("case_a"), F.col("b").alias("case_b"), F.col("weight").alias("score"))
    return series.cluster_roll_up(links, found.select(F.col("node").alias("case_id"), F.col("community").alias("cluster")), found.select(F.col("node").alias("case_id"), (F.col("node") % 10).cast("string").alias("region"))).withColumn("avg_score", F.round("avg_score", 6))


#: Every user whose number ends in 1 or 2 is merged into the one that ends in 0.
_TO = "CASE WHEN {0} % 10 IN (1, 2) THEN {0} - {0} % 10 ELSE {0} END"


def _merged(hop: DataFrame) -> DataFrame:
    users = hop.select(F.explode(F.array("src", "dst")).alias("u")).distinct().where("u % 10 IN (1, 2)")
    return resolution.survivors(users.select((F.col("u") - F.col("u") % 10).alias("primary"), F.col("u").alias("secondary")))


@query("er4_apply_merges", "hop", sql=f"""WITH u AS (SELECT src AS id FROM hop UNION SELECT dst FROM hop UNION SELECT id - id % 10 FROM (SELECT src AS id FROM hop UNION SELECT dst FROM hop) WHERE id % 10 IN (1, 2))
SELECT {_TO.format('id')} AS entity_id, array_to_string(list_sort(list('u' || id) FILTER (id % 10 IN (1, 2))), ',') AS aliases, count(*) FILTER (id % 10 IN (1, 2)) AS merges, least(1.0, round(0.5 + 0.1 * count(*) FILTER (id % 10 IN (1, 2)), 6))::DOUBLE AS confidence FROM u GROUP BY 1""")
def _(hop):
    merged = _merged(hop)
    ids = hop.select(F.explode(F.array("src", "dst")).alias("entity_id")).union(merged.select("survivor")).distinct()
    entities = ids.select("entity_id", F.lit("Person").alias("entity_type"), F.concat(F.lit("u"), "entity_id").alias("name"), F.lit(None).cast("array<string>").alias("aliases"), F.lit(0.5).alias("confidence"))
    out = resolution.merge_entities(entities, merged)
    return out.select("entity_id", F.nullif(F.array_join("aliases", ","), F.lit("")).alias("aliases"), "merges", F.round("confidence", 6).alias("confidence"))


@query("er5_merged_edges", "hop", sql=f"""WITH e AS (SELECT {_TO.format('src')} AS s, {_TO.format('dst')} AS d, event_type AS rel_type, CASE WHEN src % 10 IN (1, 2) THEN least(weight * 1.2, 10) ELSE weight END AS w, dst % 10 IN (1, 2) AS again FROM hop)
SELECT least(s, d) AS a, greatest(s, d) AS b, rel_type, round(max(CASE WHEN again THEN least(w * 1.2, 10) ELSE w END), 6) AS weight FROM e GROUP BY 1, 2, 3""")
def _(hop):
    edges = hop.select("src", "dst", F.col("event_type").alias("rel_type"), "weight")
    return resolution.redirect_edges(edges, _merged(hop)).withColumn("weight", F.round("weight", 6))


@query("er7_flag_unresolved", "ent", sql="WITH f AS (SELECT *, bool_or(unresolved) OVER (PARTITION BY entity_id) AS flagged FROM ent) SELECT entity_id, round(CASE WHEN flagged THEN greatest(0.1, confidence - 0.3) ELSE confidence END, 6)::DOUBLE AS confidence, CASE WHEN flagged THEN 'unresolved' ELSE 'resolved' END AS status, CASE WHEN flagged THEN 'returned' END AS reason FROM f")
def _(ent):
    flags = ent.where("unresolved").select("entity_id", F.lit("returned").alias("reason"))
    return resolution.flag_unresolved(ent.select("entity_id", "confidence"), flags).withColumn("confidence", F.round("confidence", 6)).select("entity_id", "confidence", "status", "reason")


@query("er8_history", "", "events", sql="SELECT event_id, event_type AS action FROM events WHERE event_type IN ('purchase', 'error') ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(events):
    log = events.select(F.col("event_id").alias("log_id"), F.col("event_type").alias("action"), "ts")
    return resolution.history(log, ("purchase", "error")).select(F.col("log_id").alias("event_id"), "action")


@query("er9_gate", "ent", sql="SELECT CASE WHEN confidence < 0.95 THEN 'review' ELSE 'auto' END AS decision, count(*) AS n FROM ent GROUP BY 1")
def _(ent):
    return ent.groupBy(resolution.gated(F.lit("auto"), F.col("confidence")).alias("decision")).agg(F.count("*").alias("n"))


@query("er10_for_graph", "ent", sql="SELECT entity_id FROM ent WHERE confidence >= 0.6")
def _(ent):
    return resolution.for_graph(ent.withColumn("is_reviewed", F.lit(None).cast("boolean"))).select("entity_id")


@query("det12_long_circular_flows", "flow", sql="""WITH e AS (SELECT src, dst, list(DISTINCT case_id) AS cs FROM flow GROUP BY 1, 2)
SELECT w.src || '-' || x.src || '-' || y.src || '-' || z.src AS path, len(list_distinct(w.cs || x.cs || y.cs || z.cs))::INT AS cases
FROM e w JOIN e x ON w.dst = x.src JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = w.src WHERE w.src < x.src AND w.src < y.src AND w.src < z.src AND x.src <> y.src AND x.src <> z.src AND y.src <> z.src""")
def _(flow):
    return detect.long_circular_flows(flow).select(F.array_join("path", "-").alias("path"), "cases")


_ROLE_SQL = """WITH e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, event_type, sum(weight) AS w, CASE WHEN event_type = 'error' THEN 0.5e0 ELSE 0 END AS severity FROM hop GROUP BY 1, 2, 3),
p AS (SELECT a, b, avg(w) * CASE WHEN max(severity) > 0 THEN 0.7e0 + 0.3e0 * max(severity) ELSE 1 END AS worth FROM e GROUP BY 1, 2), n AS (SELECT node, sum(worth) AS severity FROM (SELECT a AS node, worth FROM p UNION ALL SELECT b, worth FROM p) GROUP BY 1)"""


@query("gra14_role_severity", "hop", sql=_ROLE_SQL + " SELECT node, round(severity, 6) AS severity, round(severity / (SELECT max(severity) FROM n) * 100, 6) AS score FROM n")
def _(hop):
    return graph.role_severity(_typed(hop)).withColumns({"severity": F.round("severity", 6), "score": F.round("score", 6)})


def _typed(hop: DataFrame) -> DataFrame:
    return hop.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "event_type").agg(F.sum("weight").alias("w")).withColumn("severity", F.when(F.col("event_type") == "error", 0.5).otherwise(0.0))


@query("gra13_importance", "hop")
def _(hop):
    """Importance of every entity of the rolled-up graph: centrality, errors as severity, days as cases, moves as records."""
    edges = _weighted(hop)
    ends = hop.select(F.explode(F.array("src", "dst")).alias("node"), "case_id").groupBy("node").agg(F.count("*").alias("records"), F.count_distinct("case_id").alias("cases"))
    total = hop.agg(F.count_distinct("case_id").alias("total"))
    cross = ends.crossJoin(F.broadcast(total)).select("node", graph.cross_case_score(F.col("cases"), F.col("total")).alias("score"))
    central = _combined(edges).select("node", F.col("scaled").alias("score"))
    out = graph.importance(central, graph.role_severity(_typed(hop)), cross, graph.activity(edges, ends.select("node", "records")))
    return out.select("node", *[F.round(c, 3).alias(c) for c in ("score", "centrality", "role", "cross_case", "activity")], "band")


del _


from caseweave import catalog_casework, catalog_leads, catalog_views  # noqa: E402, F401  register their queries here
