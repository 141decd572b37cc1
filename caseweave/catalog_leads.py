"""Registered queries of paths, entity matches, correlated alerts and stored ingestion: see ``catalog``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from caseweave.catalog import EXTRA_VIEWS, SQL, VIEWS, query
from caseweave.catalog_casework import _simple
from caseweave.operators import decisions, detect, filters, incidents, matching, profiles, routes, series, text, tokens
from caseweave.plans.scratch import shared_dir
from caseweave.sources import stored

_FIRST = "CASE c_custkey % 6 WHEN 0 THEN 'Ravi' WHEN 1 THEN 'Anil' WHEN 2 THEN 'Meera' WHEN 3 THEN 'Sunita' WHEN 4 THEN 'Rahul' ELSE 'Kiran' END"
_LAST = "CASE c_custkey % 7 WHEN 0 THEN 'Kumar' WHEN 1 THEN 'Sharma' WHEN 2 THEN 'Nair' WHEN 3 THEN 'Iyer' WHEN 4 THEN 'Khan' WHEN 5 THEN 'Das' ELSE 'Menon' END"
_NAME = f"CASE WHEN c_custkey % 13 = 0 THEN {_FIRST} WHEN c_custkey % 11 = 0 THEN concat({_LAST}, ' ', {_FIRST}, 'h') ELSE concat({_FIRST}, ' ', {_LAST}) END"
_PERSON = f"c_custkey AS entity_id, CASE WHEN c_custkey % 19 = 0 THEN 'Location' ELSE 'Person' END AS entity_type, {_NAME} AS name, c_custkey % 40 AS case_id, c_custkey % 23 = 0 AS partial_identity, CASE WHEN c_custkey % 29 = 0 THEN 1 ELSE NULL END AS merged_into"
_simple("person_base", "customer", _PERSON)
VIEWS["person"] = f"SELECT {_PERSON}, CASE WHEN c_custkey % 17 = 0 THEN ['Ravi Nair'] ELSE NULL END AS aliases FROM customer"
EXTRA_VIEWS["person"] = lambda read: EXTRA_VIEWS["person_base"](read).withColumn("aliases", F.when(F.col("entity_id") % 17 == 0, F.array(F.lit("Ravi Nair"))))
_simple("father", "customer", "c_custkey AS entity_id, c_custkey % 40 AS case_id, 'father_name' AS kind, CASE WHEN c_custkey % 50 = 0 THEN 'Gopal Krishnan' WHEN c_custkey % 50 = 25 THEN 'krishna gopal' WHEN c_custkey % 50 = 7 THEN 'Gopal Krishnamurthy' ELSE NULL END AS value")
VIEWS["proof"] = f"({VIEWS['cust_phone']}) UNION ALL ({VIEWS['cust_dob']}) UNION ALL ({VIEWS['father']})"
EXTRA_VIEWS["proof"] = lambda read: EXTRA_VIEWS["attr"](read).union(EXTRA_VIEWS["father"](read))

#: The longest common subsequence of all pairs in ``duo`` (x, y), a row of the table for each letter of x: within a row, lengths never fall.
_LCS = """lcs AS (SELECT x, y, 0 AS i, j, 0 AS v FROM duo, LATERAL (SELECT unnest(range(0, length(y) + 1)) AS j)
UNION ALL SELECT x, y, i + 1, j, max(c) OVER (PARTITION BY x, y ORDER BY j ROWS UNBOUNDED PRECEDING) FROM
  (SELECT x, y, i, j, CASE WHEN j > 0 AND substring(y, j, 1) = substring(x, i + 1, 1) THEN lag(v) OVER (PARTITION BY x, y ORDER BY j) + 1 ELSE v END AS c FROM lcs WHERE i < length(x))),
ratio AS (SELECT x, y, 2.0 * max(v) / (length(x) + length(y)) AS r FROM lcs WHERE i = length(x) AND j = length(y) GROUP BY x, y)"""
_SORTED = "array_to_string(list_sort(string_split(lower(trim({})), ' ')), ' ')"


@query("jon12_similar_names", "person", sql=f"""WITH d AS (SELECT DISTINCT lower(trim(name)) AS name, {_SORTED.format('name')} AS said FROM person),
duo AS (SELECT DISTINCT p.said AS x, q.said AS y FROM d p, d q WHERE p.said <= q.said), {_LCS}
SELECT p.name AS a, q.name AS b, round(r, 6)::DOUBLE AS ratio FROM d p JOIN d q ON p.name < q.name JOIN ratio ON x = least(p.said, q.said) AND y = greatest(p.said, q.said) WHERE r >= 0.6 - 1e-9""")
def _(person):
    """Pairs of names that are alike by .6."""
    return matching.similar_names(person).withColumn("ratio", F.round("ratio", 6))


@query("er2_candidates", "person father proof link", sql=f"""WITH p AS (SELECT *, lower(trim(name)) AS said, string_split(lower(trim(name)), ' ') AS ws FROM person),
nm AS (SELECT entity_id, {_SORTED.format('n')} AS s FROM (SELECT entity_id, said AS n FROM p UNION SELECT entity_id, lower(unnest(aliases)) FROM p)),
fa AS (SELECT entity_id, {_SORTED.format('value')} AS s FROM father WHERE value IS NOT NULL),
words AS (SELECT s FROM nm UNION SELECT s FROM fa),
duo AS (SELECT p.s AS x, q.s AS y FROM words p, words q WHERE p.s <= q.s), {_LCS},
fuzzy AS (SELECT p.entity_id AS a, q.entity_id AS b, max(r) AS r FROM nm p JOIN nm q ON p.entity_id < q.entity_id JOIN ratio ON x = least(p.s, q.s) AND y = greatest(p.s, q.s) GROUP BY 1, 2),
base AS (SELECT x.entity_id AS a, y.entity_id AS b, x.case_id AS ca, y.case_id AS cb, len(x.ws) = 1 OR length(x.said) < 4 OR x.partial_identity OR len(y.ws) = 1 OR length(y.said) < 4 OR y.partial_identity AS partial,
  CASE WHEN len(x.ws) = 1 AND len(y.ws) = 1 THEN 0 WHEN len(x.ws) = 1 OR len(y.ws) = 1 THEN CASE WHEN list_has_all(x.ws, y.ws) OR list_has_all(y.ws, x.ws) THEN 0.3 ELSE 0 END ELSE r END AS similarity
  FROM p x JOIN p y ON x.entity_id < y.entity_id AND x.entity_type = y.entity_type JOIN fuzzy ON a = x.entity_id AND b = y.entity_id WHERE x.merged_into IS NULL AND y.merged_into IS NULL),
near AS (SELECT a AS e, b AS o FROM link UNION SELECT b, a FROM link),
sig AS (SELECT x.entity_id AS a, y.entity_id AS b, 'identical_' || x.kind AS s FROM proof x JOIN proof y ON x.kind = y.kind AND x.value = y.value AND x.entity_id < y.entity_id
  UNION SELECT p.entity_id, q.entity_id, 'identical_father_name' FROM fa p JOIN fa q ON p.entity_id < q.entity_id JOIN ratio ON x = least(p.s, q.s) AND y = greatest(p.s, q.s) WHERE r > 0.85
  UNION SELECT x.e, y.e, 'shared_associates' FROM near x JOIN near y ON x.o = y.o AND x.e < y.e GROUP BY 1, 2 HAVING count(*) >= 2
  UNION SELECT x.entity_id, y.entity_id, 'shared_case' FROM person x JOIN person y ON x.case_id = y.case_id AND x.entity_id < y.entity_id),
m AS (SELECT a, b, ca, cb, partial, round(similarity, 4)::DOUBLE AS similarity, list_sort(list(s)) AS signals, count(*)::INT AS n_signals,
  count(*) FILTER (s IN ('identical_phone', 'identical_address', 'identical_dob', 'identical_father_name')) AS strong,
  sum(CASE s WHEN 'identical_phone' THEN 1.0 WHEN 'identical_dob' THEN 0.9 WHEN 'identical_father_name' THEN 0.85 WHEN 'shared_associates' THEN 0.5 ELSE 0.2 END) AS weight
  FROM base JOIN sig USING (a, b) WHERE similarity >= 0.6 - 1e-9 GROUP BY a, b, ca, cb, partial, similarity),
kept AS (SELECT * FROM m WHERE NOT partial OR strong >= 2),
ends AS (SELECT a AS id, b AS other, n_signals, similarity FROM kept UNION ALL SELECT b, a, n_signals, similarity FROM kept),
best AS (SELECT least(id, other) AS a, greatest(id, other) AS b, min(rk)::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n_signals DESC, similarity DESC, other) AS rk FROM ends) WHERE rk <= 10 GROUP BY 1, 2)
SELECT a, b, similarity, array_to_string(signals, ',') AS signals, n_signals, round(weight, 6)::DOUBLE AS weight, partial,
  CASE WHEN partial THEN CASE WHEN n_signals >= 2 THEN 'review' ELSE 'no' END WHEN n_signals >= 2 THEN 'auto' WHEN n_signals = 1 THEN 'review' ELSE 'no' END AS action, rank FROM kept JOIN best USING (a, b)""")
def _(person, father, proof, link):
    """Matches of all persons, with the evidence and what to do about them."""
    found = matching.candidate_matches(person, proof, link.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return found.select("a", "b", "similarity", F.array_join("signals", ",").alias("signals"), "n_signals", F.round("weight", 6).alias("weight"), "partial", "action", "rank")


def _route_sql(rounds: int = 9, extra: int = 1) -> str:
    parts = ["WITH g AS (SELECT a, b, score AS w FROM link UNION ALL SELECT b, a, score FROM link), arcs AS MATERIALIZED (SELECT a, b, min(w) AS w FROM g WHERE a <> b GROUP BY 1, 2)", "d0 AS MATERIALIZED (SELECT 1::BIGINT AS node, (0.0::DOUBLE, 0, [1::BIGINT]) AS label)"]
    for i in range(rounds):
        parts.append(f"d{i + 1} AS MATERIALIZED (SELECT node, min(label) AS label FROM (SELECT * FROM d{i} UNION ALL SELECT b, (label[1] + w, label[2] + 1, label[3] || [b]) FROM d{i} JOIN arcs ON a = node) GROUP BY node)")
    parts.append(f"best AS MATERIALIZED (SELECT label[3] AS path, label[2] AS hops FROM d{rounds} WHERE node = 14)")
    parts.append(f"grow AS (SELECT [1::BIGINT] AS path, 1::BIGINT AS tip, 0.0::DOUBLE AS weight UNION ALL SELECT path || [b], b, weight + w FROM grow JOIN arcs ON a = tip WHERE tip <> 14 AND NOT list_contains(path, b) AND len(path) <= (SELECT hops FROM best) + {extra})")
    parts.append("other AS (SELECT path, weight, row_number() OVER (ORDER BY weight DESC, path) AS r FROM grow WHERE tip = 14 AND path <> (SELECT path FROM best))")
    tail = "SELECT 1 AS rank, true AS is_primary, array_to_string(path, '-') AS path, hops::INT AS hops, (SELECT weight FROM grow g WHERE g.path = best.path) AS weight FROM best UNION ALL SELECT r::INT + 1, false, array_to_string(path, '-'), len(path)::INT - 1, weight FROM other WHERE r <= 2"
    return ", ".join(parts) + " " + tail


@query("gra9_strongest_paths", "link", sql=_route_sql())
def _(link):
    """The least-cost path between two nodes and its heaviest alternatives."""
    found = routes.strongest_paths(link.withColumnRenamed("score", "weight"), 1, 14, extra_hops=1)
    return found.select("rank", "is_primary", F.array_join("path", "-").alias("path"), "hops", "weight")


_NOTE = "CASE o_orderkey % 6 WHEN 0 THEN 'Two men were arrested near the depot.' WHEN 1 THEN 'There was no evidence of murder at the scene.' WHEN 2 THEN 'Goods recovered after the Shooting.' WHEN 3 THEN 'Nothing was seen.' WHEN 4 THEN 'No arrest was made. Much later that same week, on a road some miles away from town and in broad daylight, an attack took place.' ELSE NULL END"
_LABEL = "CASE o_orderkey % 6 WHEN 0 THEN 'arrest' WHEN 2 THEN 'recovery' WHEN 4 THEN 'attack' END"
_simple("report", "orders", f"o_orderkey AS doc_id, o_orderkey AS case_id, o_orderdate AS filed, {_NOTE} AS text")
VIEWS["report"] = f"SELECT o_orderkey AS doc_id, o_orderkey AS case_id, o_orderdate + INTERVAL 40 DAY AS ts, {_NOTE} AS text, {_LABEL} AS expected FROM orders"
_base = EXTRA_VIEWS["report"]
EXTRA_VIEWS["report"] = lambda read: _base(read).withColumn("ts", F.expr("filed + INTERVAL 40 DAYS")).drop("filed")
_HITS = """stated AS (SELECT case_id, doc_id, ts, expected AS label FROM report WHERE expected IS NOT NULL)"""


@query("jon7_document_events", "report", sql="SELECT doc_id AS event_id, case_id, expected AS label FROM report WHERE expected IS NOT NULL")
def _(report):
    """Documents that state an event, by their first keyword that nothing denies."""
    return incidents.document_events(report).select("event_id", "case_id", "label")


@query("det1_correlated_bursts", "comm report", sql=f"""WITH {_HITS},
p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM comm WHERE src <> dst GROUP BY 1, 2 HAVING count(*) >= 2),
pc AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, case_id FROM comm),
hit AS (SELECT a, b, min((case_id, doc_id, label)) AS h FROM p JOIN pc USING (a, b) JOIN stated s USING (case_id) WHERE s.ts BETWEEN first_ts - INTERVAL 3 DAY AND last_ts + INTERVAL 3 DAY GROUP BY 1, 2)
SELECT a, b, n, h[2] AS event_id, h[3] AS event_label, CASE WHEN h IS NOT NULL OR n >= 6 THEN 'high' WHEN n >= 4 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN h IS NOT NULL THEN 'confirmed' WHEN n >= 4 THEN 'statistically_unusual' ELSE 'unexplained' END AS confidence,
  n || ' contacts of ' || a || ' and ' || b || CASE WHEN h IS NOT NULL THEN ' around a documented ' || h[3] ELSE printf(', %.1f times the threshold', n / 2) END AS explanation FROM p LEFT JOIN hit USING (a, b)""")
def _(comm, report):
    """Bursts of contacts, upgraded by events of their cases."""
    found = incidents.correlated_bursts(comm, incidents.document_events(report))
    return found.select("a", "b", "n", "event_id", "event_label", "severity", "confidence", "explanation")


@query("det7_burner_numbers", "comm report", sql=f"""WITH {_HITS},
e AS (SELECT number, case_id, ts FROM (SELECT src AS number, case_id, ts FROM comm UNION ALL SELECT dst, case_id, ts FROM comm) WHERE substring(number, 2)::INT % 4 = 0),
p AS (SELECT number, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, floor((epoch(max(ts)) - epoch(min(ts))) / 86400)::BIGINT AS days FROM e GROUP BY 1),
hit AS (SELECT number, min((case_id, doc_id, label)) AS h FROM p JOIN (SELECT DISTINCT number, case_id FROM e) USING (number) JOIN stated s USING (case_id) WHERE s.ts BETWEEN first_ts - INTERVAL 3 DAY AND last_ts + INTERVAL 3 DAY GROUP BY 1)
SELECT number, n, days, h[2] AS event_id, CASE WHEN h IS NOT NULL THEN 'high' WHEN days <= 7 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN h IS NOT NULL THEN 'confirmed' WHEN days <= 7 THEN 'statistically_unusual' ELSE 'unexplained' END AS confidence FROM p LEFT JOIN hit USING (number)""")
def _(comm, report):
    """Activity of numbers that their attributes mark as burners."""
    numbers = comm.select(F.explode(F.array("src", "dst")).alias("number")).distinct()
    marks = F.create_map(F.lit("registered"), F.when(F.substring("number", 2, 20).cast("int") % 4 == 0, "false").otherwise("true"))
    return incidents.burner_numbers(comm, numbers.where(filters.is_burner(marks)), incidents.document_events(report)).select("number", "n", "days", "event_id", "severity", "confidence")


@query("win9_new_contact_bursts", "hop", sql="""WITH c AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, ts FROM hop), f AS (SELECT a, b, min(ts) AS first_ts FROM c GROUP BY 1, 2)
SELECT a, b, count(*) AS n, first_ts, max(ts) AS last_ts FROM c JOIN f USING (a, b) WHERE ts <= first_ts + INTERVAL 48 HOUR GROUP BY a, b, first_ts HAVING count(*) >= 2""")
def _(hop):
    """Pairs that had no contact before their burst."""
    return incidents.new_contact_bursts(hop, 48, 2)


@query("det8_isolated_run", "comm flow report", sql=f"""WITH {_HITS},
p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM comm WHERE src <> dst GROUP BY 1, 2 HAVING count(*) >= 3),
pc AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, case_id FROM comm),
hit AS (SELECT a, b, min((case_id, doc_id, label)) AS h FROM p JOIN pc USING (a, b) JOIN stated s USING (case_id) WHERE s.ts BETWEEN first_ts - INTERVAL 3 DAY AND last_ts + INTERVAL 3 DAY GROUP BY 1, 2)
SELECT 'communication_burst' AS alert_type, a || ' - ' || b AS title, CASE WHEN h IS NOT NULL OR n >= 9 THEN 'high' WHEN n >= 6 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN h IS NOT NULL THEN 'confirmed' WHEN n >= 6 THEN 'statistically_unusual' ELSE 'unexplained' END AS confidence,
  'n=' || n || coalesce(';event_label=' || h[3], '') AS evidence, NULL AS error FROM p LEFT JOIN hit USING (a, b)
UNION ALL SELECT 'repeated_transfer', src || ' - ' || dst, 'medium', 'unexplained', 'n=' || count(*), NULL FROM flow GROUP BY src, dst HAVING count(*) >= 2
UNION ALL SELECT 'broken', NULL, NULL, NULL, NULL, 'ValueError: no such table'""")
def _(comm, flow, report):
    """Alerts of detectors with thresholds from the rule table; one fails and one is off."""

    def broken(_):
        raise ValueError("no such table")

    spark = comm.sparkSession
    rules = spark.createDataFrame([("communication_burst", True, 3.0), ("burner_number", False, 1.0)], "rule_type string, is_enabled boolean, threshold double")
    detectors = {
        "communication_burst": lambda t: incidents.assembled_alerts(incidents.correlated_bursts(comm, incidents.document_events(report), int(t or 2)), "communication_burst", ["a", "b"], ["n", "event_label"]),
        "repeated_transfer": lambda _: incidents.assembled_alerts(detect.repeated_transfers(flow), "repeated_transfer", ["src", "dst"], ["n"]),
        "burner_number": broken,
        "broken": broken,
    }
    alerts, failures = incidents.run_isolated(spark, detectors, rules)
    facts = F.concat_ws(";", F.transform(F.map_entries("evidence"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    none = F.lit(None).cast("string")
    alerts = alerts.select("alert_type", "title", "severity", "confidence", facts.alias("evidence"), none.alias("error"))
    return alerts.unionByName(failures.select(F.col("detector").alias("alert_type"), none.alias("title"), none.alias("severity"), none.alias("confidence"), none.alias("evidence"), "error"))


def _batches(orders):
    key = F.col("o_orderkey")
    marks = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.concat(F.lit("k"), (key % 3).cast("string")), F.when(key % 5 > 0, F.col("o_orderstatus")))
    rows = orders.select((F.col("o_custkey") % 50).alias("case_id"), F.lit("Person").alias("entity_type"), F.concat(F.lit("clerk "), (F.col("o_custkey") % 7).cast("string")).alias("name"), marks.alias("attributes"), F.when(key % 4 > 0, (key % 100) / 100).alias("confidence"), key.alias("seq"))
    return rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")


@query("src8_stored_upsert", "", "orders", sql="""WITH r AS (SELECT o_custkey % 50 AS case_id, 'clerk ' || (o_custkey % 7) AS name, o_orderkey % 2 AS batch, o_orderkey AS seq, o_orderpriority AS p, 'k' || (o_orderkey % 3) AS k, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS s, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 100) / 100.0 END AS c FROM orders),
cells AS (SELECT case_id, name, 'priority' AS k, p AS v, batch, seq FROM r UNION ALL SELECT case_id, name, k, s, batch, seq FROM r WHERE s IS NOT NULL),
last AS (SELECT case_id, name, k, arg_max(v, (batch, seq)) AS v FROM cells GROUP BY ALL), m AS (SELECT case_id, name, string_agg(k || '=' || v, ',' ORDER BY k) AS attributes FROM last GROUP BY ALL),
b AS (SELECT case_id, name, arg_max(c, (batch, seq)) FILTER (c IS NOT NULL) AS confidence FROM r GROUP BY ALL)
SELECT case_id, name, attributes, round(confidence, 4)::DOUBLE AS confidence, 0 AS changed_by_replay FROM b JOIN m USING (case_id, name)""")
def _(orders):
    """Two batches of entities merged into a stored table, the second one twice."""
    path = f"{shared_dir(orders.sparkSession)}/entities-{uuid.uuid4().hex}"
    first, second = _batches(orders)
    stored.upsert_stored_entities(path, first, parts=8)
    stored.upsert_stored_entities(path, second, parts=8)
    again = stored.upsert_stored_entities(path, second, parts=8)
    said = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return stored.read_stored(orders.sparkSession, path).select("case_id", "name", said.alias("attributes"), F.round("confidence", 4).alias("confidence"), F.lit(len(again)).alias("changed_by_replay"))


@query("src10_ingest_metrics", "", "lineitem", sql="""WITH r AS (SELECT CASE WHEN l_orderkey % 97 = 0 THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS q, CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE 'p' || l_partkey END AS p FROM lineitem)
SELECT 'lines' AS job, count(*) AS records, (sum(1 + (p <> '')::INT) FILTER (q <> 'n/a'))::BIGINT AS entities, count(*) FILTER (q <> 'n/a' AND p <> '') AS relationships, count(*) FILTER (q = 'n/a') AS errors, CASE WHEN count(*) FILTER (q = 'n/a') > 0 THEN 'completed with errors' ELSE 'completed' END AS status FROM r
UNION ALL SELECT 'short', 0, 0, 0, 1, 'failed'""")
def _(lineitem):
    """Metrics of two ingestion jobs, one of a file that lacks a column."""
    k = F.col("l_orderkey")
    rows = lineitem.select(F.when(k % 97 == 0, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("quantity"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("part_name"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("supplier"))
    path = f"{shared_dir(lineitem.sparkSession)}/ingest-{uuid.uuid4().hex}"
    return stored.ingest(rows, {"quantity": "double"}, ["part_name", "supplier"], path, "lines").union(stored.ingest(rows, {"amount": "double"}, [], path, "short"))


@query("src11_validation_report", "", "lineitem", sql="""SELECT 'amount' AS "column", 'missing' AS problem, 0 AS n, NULL AS example
UNION ALL SELECT 'quantity', 'not double', count(*), min('q' || l_linenumber) FROM lineitem WHERE l_orderkey % 97 = 0 HAVING count(*) > 0""")
def _(lineitem):
    """Columns that are missing and cells that don't take their type."""
    rows = lineitem.select(F.when(F.col("l_orderkey") % 97 == 0, F.concat(F.lit("q"), F.col("l_linenumber").cast("string"))).otherwise(F.col("l_quantity").cast("string")).alias("quantity"), F.col("l_tax").cast("string").alias("tax"))
    return stored.validation_report(rows, {"quantity": "double", "tax": "double", "amount": "double"})


_simple("ruling", "orders", "o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'split' ELSE 'merge' END AS action, o_custkey AS a, o_custkey + 1 + o_orderkey % 2 AS b")


@query("er6_splits_replayed", "ruling", sql="""WITH d AS (SELECT a AS p, CASE WHEN a % 10 + b - a > 9 THEN a ELSE b END AS s, seq, action FROM ruling),
f AS (SELECT p, s FROM d WHERE p <> s GROUP BY p, s HAVING arg_max(action, seq) = 'merge'), u AS (SELECT p AS x, s AS y FROM f UNION SELECT s, p FROM f),
r AS (SELECT x AS node, x AS root FROM u UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.node), c AS (SELECT node, min(root) AS comp FROM r GROUP BY 1),
h AS (SELECT comp, coalesce(min(node) FILTER (node NOT IN (SELECT s FROM f)), min(node)) AS survivor FROM c GROUP BY 1)
SELECT node AS entity_id, survivor FROM c JOIN h USING (comp)""")
def _(ruling):
    """State after a log of merges and splits, resumed from the state at half of it."""
    b = F.when(F.col("a") % 10 + F.col("b") - F.col("a") > 9, F.col("a")).otherwise(F.col("b"))
    log = ruling.select("seq", "action", F.col("a").alias("primary"), b.alias("secondary")).where("primary <> secondary")
    half = log.agg(F.max("seq")).first()[0] // 2
    return decisions.resume(decisions.replay(log, half), log, half)


_CANDIDATES = [("Twelve", "PERSON", "", False, 95), ("radio", "PERSON", "a man known as Radio ran", True, 75), ("Radio", "PERSON", "heard on the radio", False, 85), ("Al", "PERSON", "Mr Al", False, 80), ("Deepak Rana", "PERSON", None, True, 85), ("Wolf", "PERSON", "the accused Wolf", True, 75), ("Wolf", "PERSON", "a wolf mask", True, 60), ("Goa", "LOCATION", "in Goa", True, 60), (None, "LOCATION", None, True, 60)]


@query("txt16_candidate_verdicts", "", "orders", sql="SELECT o_orderkey, CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN {str(c[3]).lower()}" for i, c in enumerate(_CANDIDATES)) + " END AS genuine, CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN {c[4]}" for i, c in enumerate(_CANDIDATES)) + " END AS confidence FROM orders")
def _(orders):
    """Whether candidates are names, by themselves and their context."""
    pick = lambda j: F.element_at(F.array(*[F.lit(c[j]).cast("string") for c in _CANDIDATES]), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return orders.select("o_orderkey", tokens.candidate_verdict(pick(0), pick(1), pick(2)).alias("v")).select("o_orderkey", "v.genuine", "v.confidence")


_simple("dossier_base", "lineitem", "l_orderkey * 10 + l_linenumber AS entity_id, l_orderkey AS case_id, CASE WHEN l_linenumber % 2 = 0 THEN concat('Firm ', CAST(l_suppkey AS VARCHAR)) ELSE concat(' FIRM ', CAST(l_suppkey AS VARCHAR)) END AS name, l_partkey % 90 AS document_id, l_quantity / 50.0 AS confidence, CASE WHEN l_returnflag = 'R' THEN 1 ELSE NULL END AS merged_into, concat('m', CAST(l_linenumber AS VARCHAR)) AS mode, l_linestatus AS line, l_suppkey AS sup")
VIEWS["dossier"] = VIEWS["dossier_base"]
EXTRA_VIEWS["dossier"] = lambda read: EXTRA_VIEWS["dossier_base"](read).select("*", F.when(F.col("entity_id") % 4 == 0, F.array(F.concat(F.lit("alias "), "mode"))).alias("aliases"), F.create_map(F.lit("mode"), "mode", F.lit("line"), F.when(F.col("entity_id") % 3 == 0, F.col("line"))).alias("attributes"))


@query("agg1_entity_profiles", "dossier", sql="""WITH l AS (SELECT *, lower(trim(name)) AS norm, trim(name) AS t FROM dossier WHERE merged_into IS NULL),
base AS (SELECT norm, arg_min(entity_id, (-confidence, entity_id)) AS canonical_id, arg_min(t, (-confidence, entity_id)) AS spelt, max(confidence) AS confidence, count(*) AS record_count, count(DISTINCT case_id) AS cases, count(DISTINCT document_id) AS documents FROM l GROUP BY 1),
said AS (SELECT norm, t AS alias FROM l UNION ALL SELECT norm, 'alias ' || mode FROM l WHERE entity_id % 4 = 0), a AS (SELECT norm, alias, count(*) AS n FROM said JOIN base USING (norm) WHERE alias <> spelt GROUP BY 1, 2),
al AS (SELECT norm, string_agg(alias, ',' ORDER BY n DESC, alias) AS aliases FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, alias) AS i FROM a) WHERE i <= 4 GROUP BY 1),
d AS (SELECT norm, string_agg(document_id, ',' ORDER BY document_id) AS docs FROM (SELECT norm, document_id, row_number() OVER (PARTITION BY norm ORDER BY document_id) AS i FROM (SELECT DISTINCT norm, document_id FROM l)) WHERE i <= 4 GROUP BY 1),
m AS (SELECT norm, arg_min(mode, (-confidence, entity_id)) AS mode, arg_min(line, (-confidence, entity_id)) FILTER (entity_id % 3 = 0) AS line FROM l GROUP BY 1)
SELECT norm, canonical_id, record_count, cases, documents, coalesce(aliases, '') AS aliases, docs, coalesce('line=' || line || ',', '') || 'mode=' || mode AS attributes, confidence < 0.6 AS unconfirmed FROM base JOIN d USING (norm) JOIN m USING (norm) LEFT JOIN al USING (norm)""")
def _(dossier):
    """Names with their other names, documents and attributes."""
    said = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return profiles.entity_profiles(dossier, 4).select("norm", "canonical_id", "record_count", "cases", "documents", F.array_join("aliases", ",").alias("aliases"), F.array_join(F.transform("first_documents", lambda x: x.cast("string")), ",").alias("docs"), said.alias("attributes"), "unconfirmed")


@query("agg2_edge_profiles", "hop", sql="""WITH e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, event_type AS k, case_id, event_id, event_id % 10 / 10.0 AS c, event_id % 2 = 0 AS ai, (CASE event_type WHEN 'purchase' THEN 0.95 WHEN 'view' THEN 0.85 ELSE 0.3 END) * coalesce(nullif(weight, 0), 1) AS w FROM hop),
k AS (SELECT a, b, k, sum(w) AS w, count(*) AS n FROM e GROUP BY 1, 2, 3), t AS (SELECT a, b, round(sum(w), 4) AS weight, sum(n)::BIGINT AS n, string_agg(k, ',' ORDER BY k) AS types, arg_min(k, (-w, k)) AS primary_type FROM k GROUP BY 1, 2),
s AS (SELECT a, b, count(DISTINCT case_id) AS cases, bool_and(ai) AS ai_only, max(c)::DOUBLE AS confidence FROM e GROUP BY 1, 2),
v AS (SELECT a, b, string_agg(event_id, ',' ORDER BY i) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY c DESC, event_id) AS i FROM e WHERE event_id % 3 > 0) WHERE i <= 3 GROUP BY 1, 2)
SELECT a, b, weight, n, types, primary_type, cases, ai_only, confidence, coalesce(evidence, '') AS evidence FROM t JOIN s USING (a, b) LEFT JOIN v USING (a, b)""")
def _(hop):
    """Pairs with weights by type and their best evidence."""
    k = F.col("event_id")
    e = hop.select("src", "dst", F.col("event_type").alias("rel_type"), "case_id", F.when(k % 3 > 0, k).alias("document_id"), F.lit(" ").alias("justification"), (k % 10 / 10).alias("confidence"), (k % 2 == 0).alias("is_ai"), F.lit(0.0).alias("severity"), "weight")
    found = profiles.edge_profiles(e, 3, {"purchase": 0.95, "view": 0.85})
    return found.select("a", "b", F.round("weight", 4).alias("weight"), "n", F.array_join(F.map_keys("types"), ",").alias("types"), "primary_type", "cases", "ai_only", "confidence", F.array_join(F.transform("evidence", lambda x: x["document_id"].cast("string")), ",").alias("evidence"))


@query("gra7_case_bridges", "hop", sql="""WITH e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM hop WHERE event_type = 'purchase'), r AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
o AS (SELECT a AS node, count(*) AS outside FROM r WHERE a % 7 <> b % 7 GROUP BY 1), c AS (SELECT node, count(DISTINCT case_id) AS cases FROM (SELECT src AS node, case_id FROM hop WHERE event_type = 'purchase' UNION ALL SELECT dst, case_id FROM hop WHERE event_type = 'purchase') GROUP BY 1)
SELECT node, outside, cases, cases > 1 AS cross_case FROM o JOIN c USING (node)""")
def _(hop):
    """Bridges between given communities, and whether they span cases."""
    e = hop.where("event_type = 'purchase'").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "case_id")
    pairs = e.select("a", "b").distinct()
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return profiles.case_bridges(pairs, nodes.withColumn("community", F.col("node") % 7), e.select(F.col("a").alias("node"), "case_id"), e)


@query("gra12_connectivity_report", "person link", sql="""WITH n AS (SELECT entity_id AS node, lower(trim(name)) AS name FROM person), e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM link SEMI JOIN n ON a = n.node WHERE b IN (SELECT node FROM n) AND a % 4 <> 0 AND b % 4 <> 0 AND a // 50 = b // 50),
u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT node, node AS root FROM n UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.node), p AS (SELECT node, min(root) AS c FROM r GROUP BY 1), s AS (SELECT c, count(*) AS k FROM p GROUP BY 1)
SELECT count(*) <= 1 AS connected, count(*) AS components, max(k) AS largest, count(*) FILTER (k = 1) AS isolated, sum(k)::BIGINT AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM (SELECT name FROM p JOIN n USING (node) GROUP BY name HAVING count(DISTINCT c) > 1)) AS split_names FROM s""")
def _(person, link):
    """Components of a graph that is cut in pieces, and names that stand in several."""
    e = link.where("a % 4 <> 0 AND b % 4 <> 0 AND floor(a / 50) = floor(b / 50)")
    return profiles.connectivity_report(person.select(F.col("entity_id").alias("node"), "name"), e)


# Every document with a line of its own that the text rules find, by its id; the documents alone hold few or none of them.
_MARK = """CASE doc_id % 8 WHEN 0 THEN 'A small key placed beside the shelf, a memento deliberately left there.' WHEN 1 THEN 'Tuned to a dead frequency, static only; the backup frequency was silent.'
WHEN 2 THEN '**Victim:** Anna Berg, 34, clerk' WHEN 3 THEN 'Write to @night.desk or (@blue_door), not to desk@post.example.org.' WHEN 4 THEN 'One missing badge: nobody noticed the gap on the board.'
WHEN 5 THEN 'The doors were unlocked; found alone, no evidence of struggle.' WHEN 6 THEN '**Victim:** Ivo Lund, unknown' ELSE concat('Gaps of 10, 20, 30 days; mail lead', doc_id % 5, '@post.example.org') END"""
_MARKED = f"doc_id, source, concat(coalesce(text, ''), chr(10), {_MARK}) AS text"
VIEWS["marked"] = f"SELECT {_MARKED} FROM documents"
EXTRA_VIEWS["marked"] = lambda read: read("documents").select("doc_id", "source", F.expr(f"concat(coalesce(text, ''), chr(10), {_MARK})").alias("text"))
_MARKED_SQL = {name: SQL[name].replace("FROM documents", "FROM marked").replace("WITH RECURSIVE ", "WITH ", 1) for name in ("txt31_signature_families", "txt22_handles", "txt32_victim_line", "det5_cross_case_names")}
_MARKED_FAMILIES = _MARKED_SQL["txt31_signature_families"]


@query("txt31_marked_families", "marked", sql=_MARKED_FAMILIES)
def _(marked):
    """Signature families of documents that hold some."""
    return series.signature_families(marked).withColumn("confidence", F.round("confidence", 6))


@query("txt30_marked_intensity", "marked", sql=f"SELECT doc_id, count(*) AS families, round(sum(confidence * weight), 6)::DOUBLE AS intensity FROM ({_MARKED_FAMILIES}) GROUP BY doc_id")
def _(marked):
    """Confidence times weight of a document's signature families, summed."""
    return series.signature_intensity(series.signature_families(marked)).withColumn("intensity", F.round("intensity", 6))


@query("agg18_marked_families", "marked", sql=f"""SELECT count(*) AS common, round(count(*) / {len(series.SIGNATURE_FAMILIES)}.0, 6)::DOUBLE AS overlap
FROM (SELECT family FROM ({_MARKED_FAMILIES}) JOIN (SELECT doc_id, source FROM marked) USING (doc_id) GROUP BY 1 HAVING count(DISTINCT source) >= 2)""")
def _(marked):
    """Signature families that documents of two or more sources hold."""
    found = series.signature_families(marked).join(marked.select("doc_id", F.col("source").alias("case_id")).hint("shuffle_merge"), "doc_id")
    return series.common_families(found).withColumn("overlap", F.round("overlap", 6))


@query("txt22_marked_handles", "marked", sql=_MARKED_SQL["txt22_handles"])
def _(marked):
    """Handles, told from mail addresses."""
    return text.handles(marked)


@query("txt32_marked_victims", "marked", sql=_MARKED_SQL["txt32_victim_line"])
def _(marked):
    """Victim lines, in full and without an age."""
    return series.victim_line(marked)


@query("det5_marked_names", "marked", sql=_MARKED_SQL["det5_cross_case_names"])
def _(marked):
    """Mail addresses that documents of two or more sources hold."""
    found = text.mentions(marked.select("doc_id", F.col("source").alias("case_id"), "text"))
    return detect.cross_case_names(found.where("kind = 'email'"))
