"""Registered queries of filters, roll-ups, signals and case clusters: see ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave import sources
from caseweave.catalog import EXTRA_VIEWS, VIEWS, query
from caseweave.operators import filters, rollups, text

_STATE = "CASE WHEN o_orderkey % 11 = 0 THEN 'Dismissed' WHEN o_orderstatus = 'F' THEN 'Confirmed' WHEN o_orderstatus = 'O' THEN 'New' ELSE 'Under Review' END"
_SEVERITY = "CASE WHEN substring(o_orderpriority, 1, 1) = '1' THEN 'high' WHEN substring(o_orderpriority, 1, 1) = '2' THEN 'medium' ELSE 'low' END"

def _simple(name: str, table: str, columns: str) -> None:
    """A view whose columns are the same expressions in both dialects."""
    VIEWS[name] = f"SELECT {columns} FROM {table}"
    spark_columns = columns.replace("VARCHAR", "STRING").replace("::DOUBLE", "")
    EXTRA_VIEWS[name] = lambda read: read(table).selectExpr(*_split(spark_columns))


def _split(columns: str) -> list[str]:
    """Parts at the commas outside brackets and quotes."""
    out, depth, quoted, part = [], 0, False, ""
    for c in columns:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


_simple("alert", "orders", f"o_orderkey AS alert_id, o_custkey AS case_id, {_STATE} AS status, {_SEVERITY} AS severity, CASE WHEN o_orderkey % 3 = 0 THEN 'burst' ELSE 'flow' END AS alert_type, o_orderdate AS created_at")
_simple("cases", "customer", "c_custkey AS case_id, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 'Archived' WHEN c_custkey % 3 = 0 THEN 'Closed' ELSE 'Open' END AS status, CASE WHEN c_nationkey % 2 = 0 THEN 'Kerala' ELSE 'Goa' END AS state, c_mktsegment AS district")
_simple("note", "orders", "o_orderkey AS doc_id, o_custkey AS case_id, CASE WHEN o_orderkey % 5 = 0 THEN 'Ravi Kumar, alias Rocky' WHEN o_orderkey % 5 = 1 THEN 'There was no evidence of murder at the scene.' WHEN o_orderkey % 5 = 2 THEN concat('A murder after 1,', CAST(100 + o_orderkey % 900 AS VARCHAR), '.50 and 20') WHEN o_orderkey % 5 = 3 THEN 'Anil Rao also known as Bunty' ELSE '' END AS text")
_simple("rel", "lineitem", "l_orderkey * 10 + l_linenumber AS src, l_orderkey * 10 + l_linenumber + 1 AS dst, CASE WHEN l_linenumber % 3 = 0 THEN 'Communication' WHEN l_linenumber % 3 = 1 THEN 'Financial Transaction' ELSE 'Associate' END AS rel_type, l_orderkey AS case_id, l_shipdate AS ts, CAST(0 AS DOUBLE) AS severity, CAST(l_quantity AS DOUBLE) AS weight, CASE WHEN l_returnflag = 'R' THEN 'statement of a Witness' ELSE 'phone log' END AS justification")
_simple("place", "events", "user_id AS person, CASE WHEN user_id % 3 = 0 THEN concat('RTP-', CAST(user_id % 40 AS VARCHAR)) WHEN user_id % 3 = 1 THEN concat('Old Market ', CAST(user_id % 20 AS VARCHAR)) ELSE 'Contact' END AS location, CAST(ts AS DATE) AS first_day, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS last_day")
_simple("cust_phone", "customer", "c_custkey AS entity_id, c_custkey % 40 AS case_id, 'phone' AS kind, CAST(c_custkey % 50 AS VARCHAR) AS value")
_simple("cust_dob", "customer", "c_custkey AS entity_id, c_custkey % 40 AS case_id, 'dob' AS kind, CAST(c_nationkey AS VARCHAR) AS value")
VIEWS["attr"] = f"({VIEWS['cust_phone']}) UNION ALL ({VIEWS['cust_dob']})"
EXTRA_VIEWS["attr"] = lambda read: EXTRA_VIEWS["cust_phone"](read).union(EXTRA_VIEWS["cust_dob"](read))
VIEWS["pairs"] = "SELECT c_custkey AS a, c_custkey + k AS b FROM customer, (VALUES (1), (25), (50)) t(k)"
EXTRA_VIEWS["pairs"] = lambda read: read("customer").select(F.col("c_custkey").alias("a"), F.explode(F.array(*[F.col("c_custkey") + k for k in (1, 25, 50)])).alias("b"))
VIEWS["supply"] = "SELECT DISTINCT o_custkey AS src, -l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
EXTRA_VIEWS["supply"] = lambda read: read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (-F.col("l_suppkey")).alias("dst")).distinct()
VIEWS["link"] = "SELECT o_custkey AS a, o_custkey + 1 + o_orderkey % 9 AS b, round(max(o_orderkey % 100), 1)::DOUBLE AS score FROM orders GROUP BY 1, 2"
EXTRA_VIEWS["link"] = lambda read: read("orders").groupBy(F.col("o_custkey").alias("a"), (F.col("o_custkey") + 1 + F.col("o_orderkey") % 9).alias("b")).agg(F.max(F.col("o_orderkey") % 100).cast("double").alias("score"))


@query("flt3_alert_filter", "alert", sql="SELECT * FROM alert WHERE status = 'New' AND severity = 'high' ORDER BY created_at DESC, alert_id LIMIT 200")
def _(alert):
    return filters.newest(filters.matching(alert, case_id=None, status="New", alert_type=None, severity="high"), "created_at", "alert_id", 200)


@query("flt4_case_filter", "cases", sql="SELECT case_id, status FROM cases WHERE status <> 'Archived'")
def _(cases):
    return filters.not_archived(cases).select("case_id", "status")


@query("flt5_record_filter", "cases", sql="SELECT case_id, state, district, status FROM cases WHERE lower(state) = 'goa' AND lower(district) = 'building' AND status = 'Open'")
def _(cases):
    return filters.matching(filters.matching_any_case(cases, state="GOA", district="building"), status="Open").select("case_id", "state", "district", "status")


@query("flt6_audit_page", "ev", sql="SELECT event_id, user_id, event_type, ts FROM ev WHERE user_id % 2 = 0 AND contains(event_type, 'p') ORDER BY ts DESC, event_id LIMIT 50 OFFSET 20")
def _(ev):
    return filters.newest(filters.containing(ev.where("user_id % 2 = 0"), "P", "event_type"), "ts", "event_id", 50, 20).select("event_id", "user_id", "event_type", "ts")


@query("flt7_edge_types", "rel", sql="SELECT src, dst, list_sort(list(DISTINCT rel_type)) AS types, max(weight) / 50 AS confidence FROM rel GROUP BY 1, 2 HAVING list_contains(list(DISTINCT rel_type), 'Associate') AND max(weight) / 50 >= 0.5")
def _(rel):
    edges = rel.groupBy("src", "dst").agg(F.array_sort(F.collect_set("rel_type")).alias("types"), (F.max("weight") / 50).alias("confidence"))
    return filters.edges_of_types(edges, ["Associate"], 0.5)


@query("flt8_people_only", "place", sql="SELECT DISTINCT person FROM place WHERE person % 5 <> 0")
def _(place):
    nodes = place.select(F.col("person").alias("id"), F.when(F.col("person") % 5 == 0, "Location").otherwise("Person").alias("entity_type")).distinct()
    edges = place.select(F.col("person").alias("src"), F.col("person").alias("dst"), F.when(F.col("person") % 2 == 0, "Location Presence").otherwise("Associate").alias("rel_type"))
    people, rest = filters.people_only(nodes, edges)
    return people.select(F.col("id").alias("person")).join(rest.select(F.col("src").alias("person")).distinct().hint("shuffle_merge"), "person", "left").distinct()


@query("flt9_real_locations", "place", sql="SELECT DISTINCT location FROM place WHERE location LIKE 'RTP-%' OR contains(lower(location), 'market')")
def _(place):
    return place.select("location").distinct().where(filters.is_real_location(F.col("location"), F.lit(False), F.lit(None).cast("string")))


@query("flt10_busy_towers", "place", sql="SELECT location, count(*) AS n FROM place WHERE location LIKE 'RTP-%' GROUP BY 1 HAVING count(*) >= 20")
def _(place):
    return filters.busy_towers(place, 20)


@query("flt11_valid_at", "place", sql="WITH d AS (SELECT strftime(min(first_day) + INTERVAL 3 DAY, '%Y-%m-%d')::DATE AS day FROM place) SELECT person, location, first_day::VARCHAR AS first_day FROM place, d WHERE first_day <= day AND (last_day IS NULL OR last_day >= day)")
def _(place):
    day = place.agg(F.date_add(F.min("first_day"), 3).cast("string")).first()[0]
    return filters.valid_at(place, day).select("person", "location", F.col("first_day").cast("string").alias("first_day"))


@query("flt12_level_search", "link", sql="SELECT a, b, CASE WHEN score >= 80 THEN 'CRITICAL' ELSE 'HIGH' END AS level FROM link WHERE score >= 60 AND contains(a::VARCHAR, '1')")
def _(link):
    from caseweave.functions import band

    rows = link.withColumn("level", band(F.col("score"))).withColumn("a_text", F.col("a").cast("string"))
    return filters.containing(filters.from_level(rows, "HIGH"), "1", "a_text").select("a", "b", "level")


@query("flt14_burners", "", "customer", sql="SELECT c_custkey FROM customer WHERE c_custkey % 6 IN (0, 1, 2)")
def _(customer):
    kinds = F.create_map(F.lit(0), F.create_map(F.lit("registered"), F.lit("false")), F.lit(1), F.create_map(F.lit("note"), F.lit("likely BURNER phone")), F.lit(2), F.create_map(F.lit("registration_status"), F.lit("unregistered")), F.lit(3), F.create_map(F.lit("registered"), F.lit("true")))
    return customer.where(filters.is_burner(kinds[(F.col("c_custkey") % 6).cast("int")])).select("c_custkey")


@query("flt15_edges_between", "rel", sql="SELECT src, dst FROM rel WHERE weight >= 20 AND ts >= TIMESTAMP '1995-01-01' AND ts <= TIMESTAMP '1996-12-31'")
def _(rel):
    return filters.edges_between(rel.withColumn("first_ts", F.col("ts")).withColumn("last_ts", F.col("ts")), "1995-01-01", "1996-12-31", 20.0).select("src", "dst")


@query("flt16_cluster_filter", "link", sql="SELECT a AS cluster, avg(score) AS avg_confidence FROM link GROUP BY 1 HAVING avg(score) >= 50")
def _(link):
    return link.groupBy(F.col("a").alias("cluster")).agg(F.avg("score").alias("avg_confidence")).where("avg_confidence >= 50")


@query("flt17_case_search", "cases", sql="SELECT case_id, name FROM cases WHERE contains(lower(name), '0012') OR contains(lower(district), 'auto')")
def _(cases):
    return filters.containing(filters.containing(cases, "", "name"), "0012", "name").unionByName(filters.containing(cases, "AUTO", "district")).select("case_id", "name").distinct()


@query("flt18_similar_identifiers", "cases", sql="SELECT case_id, name FROM cases WHERE contains(lower(name), lower((SELECT min(name) FROM cases))) OR (starts_with(lower(name), lower((SELECT min(name) FROM cases))[1:3]) AND levenshtein(lower(name), lower((SELECT min(name) FROM cases))) <= 1)")
def _(cases):
    term = cases.agg(F.min("name")).first()[0]
    return filters.similar_identifiers(cases, "name", term).select("case_id", "name")


@query("gra1_resolved_graph", "ent rel", sql="""WITH n AS (SELECT entity_id, lower(trim(name)) AS norm FROM ent),
e AS (SELECT s.norm AS x, d.norm AS y, rel.* FROM rel JOIN n s ON src = s.entity_id JOIN n d ON dst = d.entity_id WHERE s.norm <> d.norm AND NOT contains(lower(justification), 'witness'))
SELECT least(x, y) AS a, greatest(x, y) AS b, round(sum(weight * CASE rel_type WHEN 'Communication' THEN 0.85 WHEN 'Financial Transaction' THEN 0.95 ELSE 0.5 END), 4) AS weight, count(*) AS n, count(DISTINCT case_id) AS cases FROM e GROUP BY 1, 2""")
def _(ent, rel):
    _, edges, _ = rollups.resolved_graph(ent.withColumn("merged_into", F.lit(None).cast("long")), rel)
    return edges.select("a", "b", F.round("weight", 4).alias("weight"), "n", F.col("cases").cast("long").alias("cases"))


@query("gra1_skip_counters", "ent rel", sql="""WITH n AS (SELECT entity_id, lower(trim(name)) AS norm FROM ent)
SELECT CASE WHEN s.norm IS NULL OR d.norm IS NULL THEN 'unmapped' WHEN s.norm = d.norm THEN 'self_loop' WHEN contains(lower(justification), 'witness') THEN 'role' ELSE 'kept' END AS outcome, count(*) AS n
FROM rel LEFT JOIN n s ON src = s.entity_id LEFT JOIN n d ON dst = d.entity_id GROUP BY 1""")
def _(ent, rel):
    return rollups.resolved_graph(ent.withColumn("merged_into", F.lit(None).cast("long")), rel)[2]


@query("jon2_named_ends", "ent rel", sql="SELECT src, dst, s.name AS src_name, s.entity_type AS src_type, d.name AS dst_name, d.entity_type AS dst_type FROM rel LEFT JOIN ent s ON src = s.entity_id LEFT JOIN ent d ON dst = d.entity_id")
def _(ent, rel):
    return rollups.named_ends(rel.select("src", "dst"), ent).select("src", "dst", "src_name", "src_type", "dst_name", "dst_type")


@query("jon3_person_at_location", "place", sql="SELECT person::VARCHAR AS person, location FROM place")
def _(place):
    turned = F.col("person") % 2 == 0
    person = F.col("person").cast("string")
    kinds = place.select(F.when(turned, F.col("location")).otherwise(person).alias("src"), F.when(turned, person).otherwise(F.col("location")).alias("dst"), F.when(turned, "Location").otherwise("Person").alias("src_type"), F.when(turned, "Person").otherwise("Location").alias("dst_type"))
    return rollups.person_at_location(kinds)


@query("jon13_shared_values", "pairs attr", sql="SELECT a, b, x.kind, count(DISTINCT x.value) AS n FROM pairs JOIN attr x ON a = x.entity_id JOIN attr y ON b = y.entity_id AND x.kind = y.kind AND x.value = y.value GROUP BY 1, 2, 3")
def _(pairs, attr):
    return rollups.shared_values(pairs, attr)


@query("jon14_shared_associates", "pairs supply", sql="SELECT a, b, count(DISTINCT x.dst) AS n FROM pairs JOIN supply x ON a = x.src JOIN supply y ON b = y.src AND x.dst = y.dst GROUP BY 1, 2 HAVING count(DISTINCT x.dst) >= 2")
def _(pairs, supply):
    return rollups.shared_associates(pairs, supply)


@query("er1_signals", "pairs attr supply", sql="""WITH s AS (SELECT a, b, 'identical_' || x.kind AS signal, CASE x.kind WHEN 'phone' THEN 1.0 ELSE 0.9 END AS w FROM pairs JOIN attr x ON a = x.entity_id JOIN attr y ON b = y.entity_id AND x.kind = y.kind AND x.value = y.value
UNION ALL SELECT a, b, 'shared_associates', 0.5 FROM pairs JOIN supply x ON a = x.src JOIN supply y ON b = y.src AND x.dst = y.dst GROUP BY 1, 2 HAVING count(*) >= 2
UNION ALL SELECT a, b, 'shared_case', 0.2 FROM pairs WHERE a % 40 = b % 40 AND b <= (SELECT max(c_custkey) FROM customer))
SELECT a, b, list_sort(list(DISTINCT signal)) AS signals, count(*) AS n_signals, round(sum(w), 6)::DOUBLE AS weight FROM s GROUP BY 1, 2""")
def _(pairs, attr, supply):
    found = rollups.signals(pairs, attr, supply, attr.select("entity_id", "case_id").distinct())
    return found.withColumn("weight", F.round("weight", 6))


@query("det10_reviews", "alert", sql="SELECT alert_id, CASE WHEN alert_id % 4 = 0 THEN 'Confirmed' WHEN alert_id % 4 = 1 AND alert_id % 8 = 1 THEN 'Dismissed' ELSE status END AS status FROM alert")
def _(alert):
    a = F.col("alert_id")
    reviews = alert.where("alert_id % 4 < 3").select("alert_id", F.when(a % 4 == 0, "Confirmed").when(a % 4 == 1, "Dismissed").otherwise("Lost").alias("new_status"), F.when(a % 8 == 1, "no case").otherwise("").alias("note"))
    return rollups.apply_reviews(alert, reviews)[0].select("alert_id", "status")


@query("det11_shared_identifiers", "attr", sql="SELECT kind, value, count(DISTINCT entity_id) AS entities, count(DISTINCT case_id) AS cases FROM attr GROUP BY 1, 2 HAVING count(DISTINCT entity_id) >= 2")
def _(attr):
    return rollups.shared_identifiers(attr)


@query("agg7_partial_identities", "ent", sql="SELECT name, entity_type, min(case_id) AS case_id, 'only a first name' AS reason FROM ent WHERE unresolved GROUP BY 1, 2")
def _(ent):
    return rollups.partial_identities(ent.withColumn("partial", F.col("unresolved")).withColumn("reason", F.lit("only a first name")))


@query("agg8_most_connected", "ent rel", sql="""WITH c AS (SELECT e AS entity_id, count(*) AS edges FROM (SELECT src AS e FROM rel UNION ALL SELECT dst FROM rel) GROUP BY 1)
SELECT * FROM (SELECT case_id, entity_id, coalesce(edges, 0) AS edges, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(edges, 0) DESC, entity_id)::INT AS place FROM ent LEFT JOIN c USING (entity_id)) WHERE place <= 3""")
def _(ent, rel):
    return rollups.most_connected(ent, rel, 3)


@query("agg10_alert_stats", "alert", sql="SELECT count(*) AS total, count(*) FILTER (status = 'New') AS new, count(*) FILTER (status = 'Under Review') AS under_review, count(*) FILTER (status = 'Confirmed') AS confirmed, count(*) FILTER (status = 'Dismissed') AS dismissed, count(*) FILTER (severity = 'high' AND status IN ('New', 'Under Review')) AS high_severity_active FROM alert")
def _(alert):
    return rollups.alert_stats(alert)


@query("agg12_totals", "alert note", sql="SELECT (SELECT count(*) FROM note WHERE text <> '') AS documents, (SELECT count(*) FROM alert) AS alerts")
def _(alert, note):
    return note.where("text <> ''").agg(F.count("*").alias("documents")).crossJoin(alert.agg(F.count("*").alias("alerts")))


@query("agg14_linkage_stats", "link", sql="SELECT count(*) AS clusters, count(*) FILTER (c >= 75) AS high, count(*) FILTER (c >= 50 AND c < 75) AS medium, count(*) FILTER (c < 50) AS low FROM (SELECT avg(score) AS c FROM link GROUP BY a)")
def _(link):
    return rollups.linkage_stats(link.groupBy("a").agg(F.avg("score").alias("avg_confidence")))


@query("agg22_chain_status", "ev", sql="SELECT count(*) AS total, count(*) FILTER (k % 2 = 0) AS chained, count(*) FILTER (k IS NULL OR k % 2 <> 0) AS unchained, max(event_id) FILTER (k % 2 = 0) AS block_index, left(sha256((max(event_id) FILTER (k % 2 = 0))::VARCHAR), 16) AS block_hash, CASE WHEN count(*) FILTER (k IS NULL OR k % 2 <> 0) > 0 THEN 'partial' ELSE 'full' END AS integrity FROM ev")
def _(ev):
    return rollups.chain_status(ev.select(F.col("event_id").alias("block_index"), F.when(F.col("k") % 2 == 0, F.sha2(F.col("event_id").cast("string"), 256)).alias("block_hash")))


@query("agg24_edge_counts", "rel", sql="SELECT e AS entity_id, count(*) AS edges FROM (SELECT src AS e FROM rel UNION ALL SELECT dst FROM rel) GROUP BY 1")
def _(rel):
    return rollups.edge_counts(rel)


@query("agg25_previews", "ent", sql="SELECT case_id AS doc_id, entity_type, string_agg(name || ':' || round(confidence, 2), ',' ORDER BY i) AS names FROM (SELECT *, row_number() OVER (PARTITION BY case_id, entity_type ORDER BY entity_id, name, confidence) AS i FROM ent) WHERE i <= 5 GROUP BY 1, 2")
def _(ent):
    found = rollups.previews(ent.withColumn("doc_id", F.col("case_id")).withColumn("pos", F.col("entity_id")))
    return found.select("doc_id", "entity_type", F.array_join(F.transform("preview", lambda x: F.concat(x["name"], F.lit(":"), F.round(x["confidence"], 2).cast("string"))), ",").alias("names"))


@query("agg26_timeline_days", "place", sql="SELECT DISTINCT first_day::VARCHAR AS day FROM place")
def _(place):
    return rollups.timeline_days(place).select(F.col("day").cast("string").alias("day"))


@query("agg27_level_counts", "link", sql="SELECT count(*) FILTER (score >= 80) AS critical, count(*) FILTER (score >= 60 AND score < 80) AS high FROM link")
def _(link):
    from caseweave.functions import band

    level = band(F.col("score"))
    return link.agg(F.count_if(level == "CRITICAL").alias("critical"), F.count_if(level == "HIGH").alias("high"))


@query("top1_ranking", "rel", sql="SELECT e AS entity_id, count(*) AS edges FROM (SELECT src AS e FROM rel UNION ALL SELECT dst FROM rel) GROUP BY 1 ORDER BY edges DESC, entity_id LIMIT 15")
def _(rel):
    return rollups.edge_counts(rel).orderBy(F.desc("edges"), "entity_id").limit(15)


@query("jon15_involved", "alert ent", sql="SELECT DISTINCT alert_id, x.entity_id, name FROM (SELECT alert_id, unnest([alert_id * 10 + 1, alert_id * 10 + 9]) AS entity_id FROM alert) x LEFT JOIN ent USING (entity_id)")
def _(alert, ent):
    return rollups.involved(alert.withColumn("entity_ids", F.array(F.col("alert_id") * 10 + 1, F.col("alert_id") * 10 + 9)), ent).distinct()


@query("jon17_links_of_case", "link", sql="SELECT CASE WHEN a = 10 THEN b ELSE a END AS other, score FROM link WHERE (a = 10 OR b = 10) AND score >= 30")
def _(link):
    return rollups.links_of(link, 10, 30.0)


@query("jon18_case_users", "cases alert", sql="SELECT case_id, count(DISTINCT u) AS users FROM cases LEFT JOIN (SELECT case_id, alert_id % 9 AS u FROM alert WHERE alert_id % 9 < 7) USING (case_id) GROUP BY 1")
def _(cases, alert):
    users = alert.select((F.col("alert_id") % 9).cast("int").alias("user_id")).where("user_id < 7").distinct().withColumn("name", F.concat(F.lit("user"), "user_id"))
    out = rollups.with_users(cases, alert.select("case_id", (F.col("alert_id") % 9).cast("int").alias("user_id")), users)
    return out.select("case_id", F.size("users").cast("long").alias("users"))


@query("sim8_case_clusters", "link", sql="""WITH e AS (SELECT a, b, score FROM link WHERE score >= 90), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
r AS (SELECT x AS node, x AS root FROM u UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.node), c AS (SELECT node, min(root) AS cluster FROM r GROUP BY 1),
m AS (SELECT cluster, count(*) AS members FROM c GROUP BY 1)
SELECT cluster, members, count(*) AS links, round(avg(score), 6) AS avg_score, max(score) AS best FROM e JOIN c ON a = node JOIN m USING (cluster) GROUP BY 1, 2""")
def _(link):
    return rollups.case_clusters(link, 90.0).withColumn("avg_score", F.round("avg_score", 6))


@query("sim9_density_clusters", "cases", sql="""WITH p AS (SELECT case_id AS id, case_id % 2 AS f, (case_id % 47) * 0.3 AS x, (case_id % 4) * 0.1 AS y FROM cases),
e AS (SELECT s.id AS a, t.id AS b FROM p s JOIN p t ON s.id <> t.id AND s.f = t.f AND abs(s.x - t.x) <= 0.45 AND (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) <= 0.45 * 0.45),
r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node) SELECT node AS id, min(root) AS cluster FROM r GROUP BY 1""")
def _(cases):
    i = F.col("case_id")
    return rollups.near_vectors(cases.select(i.alias("id"), (i % 2).alias("f"), ((i % 47) * F.lit(0.3)).alias("x"), ((i % 4) * F.lit(0.1)).alias("y")), ["f"], ["x", "y"])


@query("set3_merged_graphs", "ent", sql="SELECT name, entity_type, min(case_id) AS case_id FROM ent GROUP BY 1, 2")
def _(ent):
    return rollups.merged_graphs(ent.select("name", "entity_type", "case_id"), ["name", "entity_type"], "case_id")


@query("set5_allowed", "cases alert", sql="SELECT case_id FROM cases WHERE state = 'Goa' INTERSECT SELECT case_id FROM alert WHERE severity = 'high'")
def _(cases, alert):
    return rollups.allowed(cases.where("state = 'Goa'"), alert.where("severity = 'high'"))


@query("sca9_context_flags", "link", sql="SELECT a, b, concat_ws(',', CASE WHEN a % 2 <> b % 2 THEN 'cross_state' WHEN a % 5 <> b % 5 THEN 'cross_district' END, CASE WHEN score <= 30 THEN 'closely_timed' WHEN score <= 90 THEN 'within_quarter' END, CASE WHEN b % 300 <= 50 THEN 'close' WHEN b % 300 <= 200 THEN 'regional' END) AS flags FROM link")
def _(link):
    a, b = F.col("a"), F.col("b")
    return link.select("a", "b", F.array_join(rollups.context_flags(F.col("score"), b % 300, a % 2, b % 2, a % 5, b % 5), ",").alias("flags"))


@query("sca10_canonical_hash", "alert", sql="""SELECT alert_id, sha256('{"alert_id":' || alert_id || ',"severity":"' || severity || '","status":"' || status || '"}') AS hash FROM alert""")
def _(alert):
    return alert.select("alert_id", rollups.canonical_hash("status", "alert_id", "severity").alias("hash"))


@query("sca11_display_sizes", "link", sql="SELECT a, b, round((20 + score / 100 * 40) * CASE WHEN a % 2 = 0 THEN 1.3 ELSE 1 END, 6) AS node, greatest(1.0, least(6.0, score / 20 * 2))::DOUBLE AS edge FROM link")
def _(link):
    return link.select("a", "b", F.round(rollups.node_size(F.col("score"), F.col("a") % 2 == 0), 6).alias("node"), rollups.edge_width(F.col("score") / 20).alias("edge"))


@query("txt17_alias_pairs", "note", sql="SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Ravi Kumar' ELSE 'Anil Rao' END AS name, CASE WHEN doc_id % 5 = 0 THEN 'Rocky' ELSE 'Bunty' END AS alias FROM note WHERE doc_id % 5 IN (0, 3)")
def _(note):
    return text.alias_pairs(note)


@query("txt23_number_amounts", "note", sql="SELECT doc_id, (1100.5 + doc_id % 900 + 20)::DOUBLE AS total FROM note WHERE doc_id % 5 = 2")
def _(note):
    return note.select("doc_id", text.number_amounts(F.col("text")).alias("x")).where("size(x) > 0").select("doc_id", F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("txt25_event_check", "note", sql="SELECT doc_id, doc_id % 5 = 2 AS occurred, CASE doc_id % 5 WHEN 1 THEN 75 WHEN 2 THEN 50 ELSE 30 END::INT AS confidence FROM note")
def _(note):
    return note.select("doc_id", text.event_check(F.col("text"), "Murder").alias("e")).select("doc_id", "e.occurred", "e.confidence")


@query("txt26_stored_verdicts", "note", sql="SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'stored' ELSE 'heuristic' END AS verdict FROM note")
def _(note):
    stored = note.where("doc_id % 5 = 1").select(F.substring(F.sha2(F.lower(F.trim("text")), 256), 1, 16).alias("key")).distinct().withColumn("verdict", F.lit("stored"))
    return text.with_verdicts(note, stored, F.lit("heuristic")).select("doc_id", "verdict")


@query("txt27_normal_verdicts", "alert", sql="SELECT alert_id, CASE alert_id % 4 WHEN 0 THEN 'strong' WHEN 1 THEN 'none' WHEN 2 THEN 'weak' ELSE 'none' END AS level, CASE alert_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.4 WHEN 2 THEN 0.3 ELSE 0.0 END::DOUBLE AS score FROM alert")
def _(alert):
    k = F.col("alert_id") % 4
    answer = F.when(k == 0, '{"implication_level":"STRONG","severity_score":7}').when(k == 1, '{"implication_level":"huge","severity_score":"0.4"}').when(k == 2, '{"implication_level":"weak","severity_score":"n/a"}').otherwise("broken {")
    return alert.select("alert_id", text.normal_verdict(answer).alias("v")).select("alert_id", "v.level", "v.score")


@query("txt34_case_texts", "note", sql="SELECT case_id, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM note WHERE text <> '' GROUP BY 1")
def _(note):
    return text.case_texts(note)


@query("txt35_validation_flags", "", "customer", sql="SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'phone' END, CASE WHEN c_custkey % 3 = 0 THEN 'vehicle' END, CASE WHEN c_custkey % 5 = 0 THEN 'date' END) AS flags FROM customer")
def _(customer):
    k = F.col("c_custkey")
    flags = text.validation_flags(F.when(k % 2 == 0, "12345").otherwise("9876543210"), F.when(k % 3 == 0, "bus 7").otherwise("DL 1 CA 1234"), F.when(k % 5 == 0, F.lit("1066-10-14")).otherwise(F.lit("2024-02-29")).cast("date"))
    return customer.select("c_custkey", F.array_join(flags, ",").alias("flags"))


@query("src6_new_files", "", "documents", sql="SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)")
def _(documents):
    docs = sources.with_digest(documents)
    return sources.new_files(docs, docs.where("doc_id % 2 = 0"))


@query("src8_upsert_existing", "ent", sql="SELECT case_id, entity_type, name, arg_max(confidence, CASE WHEN entity_id % 2 = 0 THEN confidence + 10 ELSE confidence END) AS confidence, count(*) AS records FROM ent GROUP BY 1, 2, 3")
def _(ent):
    return sources.upsert_entities(ent.where("entity_id % 2 <> 0").drop("entity_id", "unresolved"), ent.where("entity_id % 2 = 0").drop("entity_id", "unresolved"))


@query("src12_delta_of_seen", "ev", sql="SELECT event_id FROM ev WHERE event_id % 3 <> 0")
def _(ev):
    hashed = sources.delta(ev, ev.limit(0).select(F.lit("").alias("row_hash")), ["event_id", "ts", "user_id"])
    return sources.delta(ev, hashed.where("event_id % 3 = 0"), ["event_id", "ts", "user_id"]).select("event_id")
