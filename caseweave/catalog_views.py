"""Registered queries of token gates, pair contexts, profiles, briefs and report lines: see ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave import sources
from caseweave.catalog import _NEEDS, EXTRA_VIEWS, VIEWS, query
from caseweave.catalog_casework import _simple
from caseweave.operators import audit, context, graph, tokens, views

_NAMES = [
    "Vikram Solanki", "Telegram", "NEFT", "assault", "amount_inr", "cellTower", "TOWER_ID", "Call Detail Records", "+91-98765 43210", "MH-12-AB-1234", "FIR 221/2024", "ravi@okbank",
    "123456789012345678", "Tower Legend Tower", "x", "Old Grain market", "the bharatiya nyaya act", "FINANCIAL TRANSACTION", "Vikram", "***##", "Suspect:", "Blue Star Ltd", "NDPS", "some words only",
]
_simple("token", "orders", "o_orderkey AS id, CASE o_orderkey % 25 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " ELSE concat('Clerk ', CAST(o_custkey AS VARCHAR)) END AS name, CASE o_orderkey % 6 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' WHEN 2 THEN 'GPE' WHEN 3 THEN 'DATE' ELSE NULL END AS label, CASE o_orderkey % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'VEHICLE' WHEN 2 THEN 'AMOUNT' ELSE 'LOCATION' END AS kind")
_simple("scene", "customer", "c_custkey AS case_id, concat('Case of ', c_name, ' and what was seen. ', CASE WHEN c_custkey % 2 = 0 THEN 'A brass key was placed neatly beside the body. ' ELSE '' END, CASE WHEN c_custkey % 3 = 0 THEN 'The radio was tuned to a dead frequency that evening. ' ELSE '' END, CASE WHEN c_custkey % 5 = 0 THEN 'She was found alone, with no evidence of struggle; doors were unlocked. ' ELSE '' END, CASE WHEN c_custkey % 7 = 0 THEN 'A rope and a knife lay in the rural lane.' ELSE '' END) AS text, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST('2024-01-01' AS DATE) + CAST(c_custkey * 37 % 900 AS INT) END AS day")
_simple("label", "supplier", "s_suppkey AS node, s_suppkey % 7 AS community, 1 + s_suppkey % 2 AS cases")
VIEWS["near"] = "SELECT least(s_suppkey, o) AS a, greatest(s_suppkey, o) AS b FROM (SELECT s_suppkey, s_suppkey * k % 9 + k AS o FROM supplier, (VALUES (1), (7), (14)) t(k)) WHERE s_suppkey <> o AND o IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2"


def _near(read):
    s = read("supplier").select("s_suppkey")
    k = F.explode(F.array(*[F.lit(x) for x in (1, 7, 14)]))
    e = s.select("s_suppkey", k.alias("k")).select("s_suppkey", (F.col("s_suppkey") * F.col("k") % 9 + F.col("k")).alias("o")).where("s_suppkey <> o")
    known = s.select(F.col("s_suppkey").alias("o"))
    return e.join(known.hint("shuffle_merge"), "o", "left_semi").select(F.least("s_suppkey", "o").alias("a"), F.greatest("s_suppkey", "o").alias("b")).distinct()


EXTRA_VIEWS["near"] = _near


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_CUT = "trim(name, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')"
_MALFORMED = rf"(name IS NULL OR length({_CUT}) NOT BETWEEN 2 AND 60 OR length(regexp_replace({_CUT}, '[^\p{{L}}\p{{N}}\s]', '', 'g')) < 0.6 * length({_CUT}) OR {_CUT} LIKE '%:' OR len(list_distinct(regexp_split_to_array(lower({_CUT}), '\s+'))) < len(regexp_split_to_array(lower({_CUT}), '\s+')))"
_SCHEMA = f"(regexp_matches(lower({_CUT}), '{tokens.SCHEMA_LINES}') OR regexp_matches({_CUT}, '{tokens.CAMEL}') OR (regexp_matches({_CUT}, '^[A-Z]{{2,8}}$') AND lower({_CUT}) IN {_in(tokens.OFFENCES)}))"
_LISTED = (
    f"(lower({_CUT}) IN {_in(tokens.PLATFORMS + tokens.PAYMENTS + tokens.OFFENCES + tokens.SECTIONS + tokens.METADATA)} OR " + " OR ".join(f"contains(lower({_CUT}), '{s}')" for s in tokens.STATUTES)
    + f" OR regexp_matches(lower({_CUT}), '{tokens.COLUMN_WORDS}') OR regexp_matches(lower({_CUT}), '{tokens.LOWER_LINES}') OR regexp_matches({_CUT}, '{tokens.CAPITALS}') OR (upper({_CUT}) = {_CUT} AND lower({_CUT}) <> {_CUT} AND length({_CUT}) > 10))"
)


@query("txt8_entity_types", "token", sql=f"""SELECT id, name, CASE WHEN {_LISTED} THEN NULL
{' '.join(f"WHEN regexp_matches(regexp_replace({_CUT}, '{away or '$^'}', '', 'g'), '{p}') THEN '{kind}'" for kind, away, p in tokens.SHAPES)}
{' '.join(f"WHEN label = '{x}' THEN '{kind}'" for x, kind in tokens.LABELS.items())}
WHEN regexp_matches({_CUT}, '{tokens.TITLE_WORDS}') THEN 'PERSON' WHEN len(list_intersect(regexp_split_to_array(lower({_CUT}), '\\s+'), {list(tokens.PLACE_ENDS)})) > 0 THEN 'LOCATION' END AS entity_type FROM token""")
def _(token):
    return token.select("id", "name", tokens.entity_type(F.col("name"), F.col("label")).alias("entity_type"))


@query("txt12_commit_gate", "token", sql=f"""SELECT id, CASE WHEN {_MALFORMED} THEN 'malformed' WHEN kind NOT IN {_in(tokens.TYPES)} THEN 'type'
WHEN regexp_replace(lower({_CUT}), '[[:punct:]]+$', '') IN {_in(tokens.PLATFORMS + tokens.PAYMENTS + tokens.OFFENCES)} THEN 'excluded word' WHEN {_SCHEMA} THEN 'schema word' END AS gate_reason FROM token""")
def _(token):
    admitted, review = tokens.gate(token, "name", "kind")
    return admitted.select("id", F.lit(None).cast("string").alias("gate_reason")).union(review.select("id", "gate_reason"))


@query("txt13_excluded_tokens", "token", sql=f"SELECT id, {_MALFORMED} OR {_LISTED} OR {_SCHEMA} AS excluded FROM token")
def _(token):
    return token.select("id", tokens.is_excluded(F.col("name")).alias("excluded"))


@query("txt15_name_verdicts", "token", sql=f"SELECT id, CASE WHEN {_MALFORMED} OR {_LISTED} OR {_SCHEMA} THEN 'excluded' WHEN kind = 'PERSON' AND NOT contains({_CUT}, ' ') THEN 'partial' ELSE 'ok' END AS verdict FROM token")
def _(token):
    return token.select("id", tokens.name_verdict(F.col("name"), F.col("kind")).alias("verdict"))


@query("txt19_without_headings", "token", sql=f"""WITH t AS (SELECT id, string_split('Brief Facts:' || chr(10) || name || chr(10) || 'SEEN' || chr(10) || coalesce(label, '') || chr(10) || 'He left.', chr(10)) AS ls FROM token)
SELECT id, array_to_string([l for l, i in ls if NOT (rtrim(lower(l), ':') IN {_in(tokens.SECTIONS)} OR (upper(l) = l AND lower(l) <> l AND length(l) BETWEEN 3 AND 40 AND coalesce(ls[i + 1], '') <> ''))], chr(10)) AS text FROM t""")
def _(token):
    lines = F.concat_ws("\n", F.lit("Brief Facts:"), "name", F.lit("SEEN"), F.coalesce("label", F.lit("")), F.lit("He left."))
    return token.select("id", tokens.without_headings(lines, tokens.SECTIONS).alias("text"))


@query("txt20_table_rows", "token", sql="SELECT id, nullif(concat_ws(' | ', name, label), '') AS line FROM token")
def _(token):
    headers = F.array(F.lit(" Full Name "), F.lit("Amount"), F.lit("label"), F.lit("weather"))
    cells = F.array(F.concat(F.lit(" "), "name"), F.lit("500"), F.coalesce("label", F.lit(" ")), F.lit("fine"))
    return token.select("id", tokens.table_row(headers, cells, ["full name", "label"]).alias("line"))


def _sql_labels(patterns, family=None) -> str:
    items = []
    for p, label in patterns:
        q = p.replace("'", "''")
        at, size = f"strpos(low, regexp_extract(low, '{q}'))", f"length(regexp_extract(low, '{q}'))"
        hit = f"regexp_matches(low, '{q}')"
        if family:
            hit += f" AND regexp_matches(substring(low, greatest({at} - 100, 1), {at} - 1 + {size} + 100 - greatest({at} - 101, 0)), '{'|'.join(context.NEAR[family])}')"
        items.append(f"CASE WHEN {hit} THEN '{label}' END")
    return f"list_distinct([{', '.join(items)}])"  # leaves out nulls


_SIGNED = "d AS (SELECT case_id, day, lower(text) AS low FROM scene), f AS (SELECT case_id, day, low, " + ", ".join([f"{_sql_labels(p, n)} AS s_{n}" for n, p in context.SIGNS.items()] + [f"{_sql_labels(p)} AS m_{n}" for n, p in context.METHODS.items()]) + " FROM d)"
_TEST = "FROM pairs JOIN f x ON x.case_id = pairs.a JOIN f y ON y.case_id = pairs.b WHERE length(x.low) >= 50 AND length(y.low) >= 50 AND coalesce(abs(x.day - y.day) <= 540, true)"
_OVERLAP = lambda n: f"len(list_intersect(x.{n}, y.{n}))::DOUBLE / greatest(len(list_distinct(x.{n} || y.{n})), 1)"
_SCORED = f"""{_SIGNED}, p AS (SELECT pairs.a, pairs.b, ({' + '.join(_OVERLAP(f's_{n}') for n in context.SIGNS)}) / 6 AS sign, ({' + '.join(_OVERLAP(f'm_{n}') for n in context.METHODS)}) / 3 AS way {_TEST}),
q AS (SELECT a, b, sign, way, floor(least(100e0, (sign * 45e-2 + way * 30e-2 + CASE WHEN sign > 0 AND way > 0 THEN 10e-2 ELSE 0e0 END) * 100))::INT AS score FROM p)"""
_LEVEL = lambda c: f"CASE WHEN {c} >= 66e-2 THEN 'strong' WHEN {c} >= 33e-2 THEN 'moderate' WHEN {c} > 0 THEN 'weak' ELSE 'none' END"


@query("jon11_testable_pairs", "pairs scene", sql="WITH f AS (SELECT case_id, day, text AS low FROM scene) SELECT pairs.a, pairs.b " + _TEST)
def _(pairs, scene):
    return context.testable_pairs(pairs, scene).select("a", "b")


@query("sim16_pair_context", "pairs scene", sql=f"WITH {_SCORED} SELECT a, b, score, {_LEVEL('sign')} AS signature, {_LEVEL('way')} AS method FROM q")
def _(pairs, scene):
    return context.analyse_pairs(pairs, scene).select("a", "b", "score", "signature", "method")


@query("sim17_pair_verdicts", "pairs scene", sql=f"WITH {_SCORED} SELECT a, b, CASE WHEN a % 3 = 0 THEN 77 ELSE score END AS score, CASE WHEN a % 3 = 0 THEN 'stored' ELSE 'heuristic' END AS backend FROM q")
def _(pairs, scene):
    return context.pair_verdicts(pairs, scene, pairs.where("a % 3 = 0").select("a", "b", F.lit(77).alias("score")))


_MEMBERS = """arcs AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), deg AS (SELECT x.node, x.community, x.cases, count(arcs.b) AS connections, count(*) FILTER (y.community = x.community) AS inner_n
FROM label x LEFT JOIN arcs ON arcs.a = x.node LEFT JOIN label y ON y.node = arcs.b GROUP BY ALL),
mem AS (SELECT node, community, connections, inner_n AS "inner", round(inner_n / greatest(connections, 1), 2) AS strength, inner_n < connections AS is_bridge, connections = 1 AND inner_n = connections AND cases <= 1 AS red_herring FROM deg)"""


def _members(label, near):
    return views.member_profiles(label.select("node", "cases"), near, label.select("node", "community"), graph.bridges(near, label).select("node"))


@query("top5_community_members", "label near", sql=f"WITH {_MEMBERS} SELECT * FROM mem ORDER BY is_bridge DESC, connections DESC, node")
def _(label, near):
    return _members(label, near).orderBy(F.col("is_bridge").desc(), F.col("connections").desc(), "node")


@query("gra8_community_profiles", "label near", sql=f"""WITH {_MEMBERS}, e AS (SELECT community, max((node % 5 = 0)::INT) AS fraud, max((node % 9 = 0)::INT) AS murder FROM label GROUP BY 1)
SELECT community, count(*) AS size, sum("inner") // 2 AS internal_edges, count(*) FILTER (is_bridge) AS bridges, count(*) FILTER (red_herring) AS red_herrings, concat_ws(',', CASE WHEN max(fraud) = 1 THEN 'fraud' END, CASE WHEN max(murder) = 1 THEN 'murder' END) AS keywords,
CASE WHEN max(fraud) + max(murder) = 2 THEN 'Fraud/Murder Network' WHEN max(fraud) = 1 THEN 'Fraud Network' WHEN max(murder) = 1 THEN 'Murder Network' ELSE 'Group ' || community END AS label FROM mem JOIN e USING (community) GROUP BY community""")
def _(label, near):
    said = F.concat_ws(" ", F.when(F.col("node") % 5 == 0, "Bank FRAUD."), F.when(F.col("node") % 9 == 0, "a murder"))
    return views.strongest(views.community_profiles(_members(label, near), label.select("node", said.alias("justification"))), "size", "community").withColumn("keywords", F.array_join("keywords", ","))


@query("gra10_cross_case_nodes", "label near", sql="SELECT node FROM label WHERE node % 6 = 1 UNION SELECT a FROM near WHERE (a + b) % 8 = 0 UNION SELECT b FROM near WHERE (a + b) % 8 = 0")
def _(label, near):
    return views.cross_case_nodes(label.select("node", F.when(F.col("node") % 6 == 1, 2).otherwise(1).alias("cases")), near.withColumn("cross_case", F.expr("(a + b) % 8 = 0")))


@query("gra11_view_nodes", "label near", sql="""WITH d AS (SELECT node, count(*) * 1e1 AS score FROM (SELECT a AS node FROM near UNION ALL SELECT b FROM near) GROUP BY 1), s AS (SELECT node, least(100, coalesce(score, 0)) AS score, node % 3 = 0 AS cross_case FROM label LEFT JOIN d USING (node))
SELECT node, score, cross_case, round((20 + score / 100 * 40) * CASE WHEN cross_case THEN 1.3e0 ELSE 1 END, 1) AS size FROM s""")
def _(label, near):
    score = graph.degree_centrality(near).select("node", F.least(F.lit(100.0), F.col("degree") * 10.0).alias("score"))
    return views.view_nodes(label.select("node"), score, label.where("node % 3 = 0").select("node")).select("node", "score", "cross_case", "size")


@query("gra11_view_edges", "rel", sql="""SELECT src AS a, dst AS b, round(sum(weight / 50), 2) AS weight, max(CASE WHEN rel_type = 'Associate' THEN NULL ELSE weight / 50 END) AS confidence, count(*) AS evidence, round(greatest(1, least(6, sum(weight / 50) * 2)), 1) AS width FROM rel GROUP BY 1, 2 HAVING bool_or(rel_type = 'Communication')""")
def _(rel):
    rows = rel.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel_type", (F.col("weight") / 50).alias("weight"), F.when(F.col("rel_type") != "Associate", F.col("weight") / 50).alias("confidence"))
    return views.view_edges(rows, "Communication").drop("types")


@query("gra16_one_entity", "near", sql="SELECT node, count(*) AS degree FROM (SELECT a AS node FROM near UNION ALL SELECT b FROM near) WHERE node = 3 GROUP BY 1")
def _(near):
    return views.one_entity(graph.degree_centrality(near), 3).select("node", "degree")


@query("gra17_not_persons", "label near", sql="SELECT node, count(*) AS degree FROM (SELECT a AS node FROM near UNION ALL SELECT b FROM near) WHERE node % 4 = 0 GROUP BY 1")
def _(label, near):
    kinds = label.select("node", F.when(F.col("node") % 4 == 0, "Location").otherwise("Person").alias("entity_type"))
    return views.not_of_type(graph.degree_centrality(near), kinds).select("node", "degree")


VIEWS["visit"] = "SELECT user_id AS person, CASE k % 3 WHEN 0 THEN 'RTP-' || k WHEN 1 THEN 'Old Market ' || k ELSE 'Contact' END AS location FROM ev WHERE k IS NOT NULL"
_NEEDS["visit"] = ["ev"]


def _visit(read):
    k = F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("int")
    named = F.when(k % 3 == 0, F.concat(F.lit("RTP-"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("Old Market "), k.cast("string"))).otherwise("Contact")
    return read("events").where(k.isNotNull()).select(F.col("user_id").alias("person"), named.alias("location"))


EXTRA_VIEWS["visit"] = _visit


def _locations(visit):
    """Persons and locations as entities, and an edge for each visit."""
    person = F.concat(F.lit("p"), F.col("person").cast("string"))
    persons = visit.select(person.alias("entity_id"), F.lit("Person").alias("entity_type")).distinct().withColumn("name", F.col("entity_id"))
    places = visit.select(F.col("location").alias("entity_id"), F.lit("Location").alias("entity_type"), F.col("location").alias("name")).distinct()
    entities = persons.unionByName(places).withColumn("has_address", F.lit(False)).withColumn("place_type", F.lit(None).cast("string"))
    return views.location_graph(visit.select(person.alias("src"), F.col("location").alias("dst")), entities)


@query("gra18_location_graph", "visit", sql="SELECT location, count(DISTINCT person) AS persons, count(*) AS visits FROM visit WHERE location <> 'Contact' GROUP BY 1")
def _(visit):
    return _locations(visit)[0].select("location", "persons", "visits")


@query("gra18_location_pairs", "visit", sql="WITH p AS (SELECT DISTINCT person, location FROM visit WHERE location <> 'Contact') SELECT x.location AS loc_a, y.location AS loc_b, count(*) AS shared FROM p x JOIN p y ON x.person = y.person AND x.location < y.location GROUP BY 1, 2")
def _(visit):
    return _locations(visit)[1]


@query("top2_most_connected", "trade", sql="SELECT node, count(*) AS degree FROM (SELECT a AS node FROM trade UNION ALL SELECT b FROM trade) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(trade):
    return views.strongest(graph.degree_centrality(trade).select("node", "degree"), "degree", "node", 10)


@query("top3_threat_ranking", "", "customer", sql="SELECT c_custkey AS node, c_acctbal AS score FROM customer ORDER BY 2 DESC, 1")
def _(customer):
    return views.strongest(customer.select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("score")), "score", "node")


@query("top6_links_by_score", "link", sql="SELECT a, b, score FROM link WHERE score >= 60 ORDER BY score DESC, a, b")
def _(link):
    return views.strongest(link.where("score >= 60"), "score", ["a", "b"])


@query("top8_alternative_paths", "trade", sql="""WITH e AS (SELECT a, b, weight FROM trade UNION ALL SELECT b, a, weight FROM trade), p AS (SELECT [0, b] AS path, weight AS w, 1 / weight AS c FROM e WHERE a = 0 UNION ALL SELECT [0, x.b, y.b], x.weight + y.weight, 1 / x.weight + 1 / y.weight FROM e x JOIN e y ON x.b = y.a WHERE x.a = 0 AND x.b <> 5 AND y.b <> 0),
g AS (SELECT * FROM p WHERE path[-1] = 5), f AS (SELECT * FROM g ORDER BY c, path LIMIT 1), o AS (SELECT *, row_number() OVER (ORDER BY w DESC, path) AS i FROM g WHERE path NOT IN (SELECT path FROM f))
SELECT array_to_string(path, '-') AS path, 0 AS place FROM f UNION ALL SELECT array_to_string(path, '-'), i::INT FROM o WHERE i <= 2""")
def _(trade):
    found = graph.paths(trade, 0, 5, 2)
    return views.alternative_paths(found, 3).select(F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"), "place")


@query("agg23_entity_briefs", "ent rel", sql="""WITH r AS (SELECT src, dst, rel_type, case_id, justification = 'phone log' AS is_ai, weight / 50 AS confidence FROM rel), b AS (SELECT src AS entity_id, dst AS other, rel_type, case_id, is_ai, confidence FROM r UNION ALL SELECT dst, src, rel_type, case_id, is_ai, confidence FROM r),
j AS (SELECT b.*, e.name AS other_name, is_ai AND b.confidence < 0.8 AS inferred FROM b JOIN ent e ON e.entity_id = other), s AS (SELECT entity_id, count(*) AS connections, count(*) FILTER (NOT inferred) AS confirmed, count(*) FILTER (inferred) AS inferred, count(DISTINCT case_id) AS cases, count(*) FILTER (confidence < 0.6) AS weak_threads,
array_to_string((list(rel_type || ': ' || other_name ORDER BY rel_type, other_name) FILTER (NOT inferred))[1:10], '; ') AS first_confirmed, array_to_string((list(rel_type || ': ' || other_name ORDER BY rel_type, other_name) FILTER (inferred))[1:10], '; ') AS first_inferred FROM j GROUP BY 1)
SELECT entity_id, unresolved OR confidence < 0.6 AS unconfirmed, coalesce(connections, 0) AS connections, coalesce(confirmed, 0) AS confirmed, coalesce(inferred, 0) AS inferred, coalesce(cases, 0) AS cases, coalesce(weak_threads, 0) AS weak_threads, coalesce(first_confirmed, '') AS first_confirmed, coalesce(first_inferred, '') AS first_inferred,
name || ' (person); cases ' || coalesce(cases, 0) || CASE WHEN confirmed > 0 THEN '; links on record ' || confirmed ELSE '' END || CASE WHEN inferred > 0 THEN '; links to check ' || inferred ELSE '' END AS narrative FROM ent LEFT JOIN s USING (entity_id)""")
def _(ent, rel):
    edges = rel.select("src", "dst", "rel_type", "case_id", (F.col("justification") == "phone log").alias("is_ai"), (F.col("weight") / 50).alias("confidence"))
    return views.entity_briefs(ent, edges).drop("name", "entity_type")


_CLUSTERS = """e AS (SELECT a, b, score FROM link WHERE score >= 90), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
r AS (SELECT x AS node, x AS root FROM u UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.node), c AS (SELECT node AS case_id, min(root) AS cluster FROM r GROUP BY 1)"""


@query("sim13_clusters_with_terms", "link", sql=f"""WITH {_CLUSTERS}, m AS (SELECT cluster, count(*) AS members, count(DISTINCT case_id % 2) = 1 AS even_odd, min(case_id % 2) AS rest FROM c GROUP BY 1),
i AS (SELECT x.cluster, round(avg(score), 3) AS avg_similarity FROM link JOIN c x ON link.a = x.case_id JOIN c y ON link.b = y.case_id AND x.cluster = y.cluster GROUP BY 1)
SELECT cluster, members, avg_similarity, 'all' || CASE WHEN even_odd THEN ',rest' || rest ELSE '' END AS shared FROM m JOIN i USING (cluster)""")
def _(link):
    ids = link.select(F.col("a").alias("case_id")).union(link.select("b")).distinct()
    terms = ids.select("case_id", F.lit("all").alias("term")).union(ids.select("case_id", F.concat(F.lit("rest"), (F.col("case_id") % 2).cast("string"))))
    return views.clusters_with_terms(link, terms, 90.0).select("cluster", "members", "avg_similarity", F.array_join("shared", ",").alias("shared"))


@query("agg21_cluster_texts", "", "customer", sql="""WITH c AS (SELECT c_nationkey AS cluster, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 15 + c_custkey % 60 END AS age, CASE WHEN c_custkey % 4 = 0 THEN 'm' ELSE 'f' END AS g, CASE WHEN c_custkey % 5 = 0 THEN 'Goa' ELSE 'Kerala' END AS state FROM customer), g AS (SELECT cluster, g, count(*) AS n FROM c GROUP BY 1, 2), t AS (SELECT cluster, string_agg(n || ' ' || g, ', ' ORDER BY n DESC, g) AS gs FROM g GROUP BY 1)
SELECT cluster, count(*) AS members, concat_ws(' | ', 'cases ' || count(*), CASE WHEN count(DISTINCT state) > 1 THEN 'several states: Goa, Kerala' ELSE 'state: ' || any_value(state) END, 'ages ' || min(nullif(age, 0)) || '-' || max(nullif(age, 0)), 'victims ' || any_value(gs), 'marks body posing, scene staging') AS text FROM c JOIN t USING (cluster) GROUP BY 1""")
def _(customer):
    k = F.col("c_custkey")
    return views.cluster_texts(customer.select(F.col("c_nationkey").alias("cluster"), k.alias("case_id"), F.array(F.lit("staging"), F.lit("posing")).alias("signatures"), F.when(k % 3 == 0, 0).otherwise((15 + k % 60).cast("int")).alias("victim_age"), F.when(k % 4 == 0, "m").otherwise("f").alias("victim_gender"), F.when(k % 5 == 0, "Goa").otherwise("Kerala").alias("state")))


@query("sim18_link_texts", "link", sql=f"""SELECT a, b, CASE WHEN score >= 75 THEN 'HIGH' WHEN score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS badge, 'score ' || score::INT || ' of 100 | cases ' || a || ' and ' || b || CASE WHEN a % 2 = 0 THEN ' | in common body posing, trophy taking' ELSE '' END || ' | {views.DISCLAIMER}' AS text FROM link""")
def _(link):
    shared = F.when(F.col("a") % 2 == 0, F.array(F.lit("trophy_taking"), F.lit("posing"))).otherwise(F.array().cast("array<string>"))
    return link.select("a", "b", views.link_text(F.col("a"), F.col("b"), F.col("score").cast("int"), shared).alias("t")).select("a", "b", "t.badge", "t.text")


@query("sim19_case_context", "cases ent", sql="""WITH n AS (SELECT case_id, name FROM (SELECT case_id, name, row_number() OVER (PARTITION BY case_id ORDER BY name) AS i FROM (SELECT DISTINCT case_id, name FROM ent)) WHERE i <= 10)
SELECT cases.case_id, coalesce(string_agg(n.name, ',' ORDER BY n.name), '') AS persons FROM cases LEFT JOIN n ON n.case_id = cases.case_id GROUP BY 1""")
def _(cases, ent):
    return views.case_context(cases.select("case_id"), ent).select("case_id", F.coalesce(F.array_join(F.try_element_at("entities", F.lit("Person")), ","), F.lit("")).alias("persons"))


@query("snk1_report_lines", "cases ent rel alert", sql="""SELECT case_id, 0 AS section, 0 AS key, 'Case ' || case_id || ': ' || name AS line FROM cases
UNION ALL SELECT case_id, 1, entity_id, format('{} ({}), confidence {:.2f}', name, entity_type, confidence) FROM ent SEMI JOIN cases USING (case_id)
UNION ALL SELECT case_id, 2, src, src || ' -> ' || dst || ' [' || rel_type || ']' FROM rel SEMI JOIN cases USING (case_id)
UNION ALL SELECT case_id, 3, alert_id, upper(severity) || ': ' || alert_type || ' (' || status || ')' FROM alert SEMI JOIN cases USING (case_id)""")
def _(cases, ent, rel, alert):
    return views.report_lines(cases, ent, rel.withColumn("edge_id", F.col("src")), alert)


@query("src4_dispatch", "", "orders", sql="""SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 4 < 2 THEN 'Phone' ELSE 'Person' END AS entity_type, CASE WHEN o_orderkey % 4 < 2 THEN (98765 + o_orderkey)::VARCHAR || '43' ELSE concat('Clerk ', CAST(o_custkey AS VARCHAR)) END AS name FROM orders WHERE o_orderkey % 4 < 3
UNION ALL SELECT o_orderkey, 'Phone', '9876543210' FROM orders WHERE o_orderkey % 4 = 3""")
def _(orders):
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(F.lit("cdr"), F.lit("calls"), F.lit("bank"), F.lit("notes")), (k % 4 + 1).cast("int"))
    cells = F.create_map(F.lit("caller"), F.concat((98765 + k).cast("string"), F.lit("-43")), F.lit("sender"), F.concat(F.lit("Clerk "), F.col("o_custkey").cast("string")), F.lit("remark"), F.lit("call 9876543210 now"), F.lit("amount"), F.lit("9876501234"))
    return sources.structured_entities(orders.select(k.alias("row_id"), kind.alias("source_type"), cells.alias("cells")))


@query("aud3_block_lookup", "ev", sql="SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS block_index FROM ev QUALIFY block_index = 7")
def _(ev):
    blocks = audit.build_chain(ev.where("event_id IS NOT NULL"), "event_type", "event_id", ["user_id"])
    return audit.block(blocks, 7).select("event_type", "event_id", "block_index")
