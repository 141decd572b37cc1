"""Operators on tiny inline tables with results worked out by hand."""

import datetime as dt
import hashlib
import math

from pyspark.sql import functions as F

from caseweave import sources
from caseweave.functions import day_gap, haversine_km, jaccard, token_sort_ratio
from caseweave.operators import audit, detect, graph, linkage, report, resolution, series, text, tokens
from caseweave.plans.fixpoint import connected_components


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_circular_flow_is_found_once(spark):
    e = spark.createDataFrame([("A", "B", 1), ("B", "C", 1), ("C", "A", 2), ("A", "A", 1), ("X", "Y", 1), ("Y", "X", 1), ("B", "C", 3)], "src string, dst string, case_id int")
    assert rows(detect.circular_flows(e)) == [("A", "B", "C", 3, "high")]


def test_burst_severity(spark):
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(a, "z", 1, t, 1.0) for a, n in (("a", 1), ("b", 2), ("c", 4), ("d", 6)) for _ in range(n)], "src string, dst string, case_id int, ts timestamp, weight double")
    assert [(r.a, r.severity) for r in detect.contact_bursts(e).orderBy("a").collect()] == [("b", "low"), ("c", "medium"), ("d", "high")]


def test_structuring(spark):
    e = spark.createDataFrame([("a", "b", 45000.0), ("a", "b", 48000.0), ("c", "d", 50000.0), ("c", "d", 1.0)], "src string, dst string, amount double")
    assert {(r.src, r.structuring) for r in detect.repeated_transfers(e).collect()} == {("a", True), ("c", False)}


def test_co_location_needs_two_people_without_an_edge(spark):
    p = spark.createDataFrame([("a", "L", 1), ("b", "L", 1), ("a", "L", 1), ("c", "M", 1), ("d", "M", 1), ("e", "N", 1)], "person string, location string, slot int")
    known = spark.createDataFrame([("d", "c")], "a string, b string")
    assert rows(detect.co_locations(p, known)) == [("a", "b", "L", 1, "low")]


def test_rolling_burst(spark):
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([("a", "b", t + dt.timedelta(hours=h)) for h in range(12)] + [("c", "d", t + dt.timedelta(hours=30 * h)) for h in range(12)], "src string, dst string, ts timestamp")
    assert [(r.a, r.peak) for r in detect.rolling_bursts(e).collect()] == [("a", 12)]


def test_components_do_not_depend_on_row_order(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    for order in (edges, edges[::-1]):
        out = dict(connected_components(spark.createDataFrame(order, "src int, dst int")).collect())
        assert out == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_betweenness_matches_brute_force(spark):
    import itertools
    import random

    dice = random.Random(4)
    weights = {p: dice.choice([1.0, 2.0, 3.0]) for p in itertools.combinations(range(9), 2) if dice.random() < 0.4}
    edges = spark.createDataFrame([(str(a), str(b), w) for (a, b), w in weights.items()], "a string, b string, weight double")
    near = {(a, b): w for (a, b), w in weights.items()} | {(b, a): w for (a, b), w in weights.items()}
    nodes = sorted({x for p in weights for x in p})
    through = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.combinations(nodes, 2):
        paths = []  # all simple paths
        stack = [(0.0, [s])]
        while stack:
            d, path = stack.pop()
            if path[-1] == t:
                paths.append((d, path))
                continue
            stack += [(d + near[path[-1], x], [*path, x]) for x in nodes if (path[-1], x) in near and x not in path]
        best = [p for d, p in paths if d == min(d for d, _ in paths)]
        for x in nodes:
            through[x] += sum(x in p[1:-1] for p in best) / len(best) if best else 0
    scale = 2 / ((len(nodes) - 1) * (len(nodes) - 2))
    want = {k: round(v * scale, 9) for k, v in through.items()}
    for found in (graph.betweenness_centrality(edges), graph.relaxed_betweenness(edges)):
        assert {int(k): round(v, 9) for k, v in found.select("node", "centrality").collect()} == want


def test_betweenness_of_path_and_star(spark):
    path = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "a int, b int, weight double")
    got = dict(graph.betweenness_centrality(path).select("node", "centrality").collect())
    assert all(abs(got[k] - v) < 0.01 for k, v in {0: 0, 1: 2 / 3, 2: 2 / 3, 3: 0}.items())
    star = spark.createDataFrame([(0, i, 1.0) for i in range(1, 5)], "a int, b int, weight double")
    got = dict(graph.betweenness_centrality(star).select("node", "centrality").collect())
    assert abs(got[0] - 1) < 0.01 and got[1] == 0


def test_betweenness_drops_arcs_off_shortest_paths(spark, monkeypatch):
    import random

    rnd = random.Random(5)
    rows = [(a, b, rnd.expovariate(1.0) + 1e-3) for a in range(60) for b in range(a + 1, 60)] + [(100, 101, 1.0), (101, 102, 1.0), (100, 102, 2.0)]
    edges = spark.createDataFrame(rows, "a long, b long, weight double")
    want = {r.node: r.centrality for r in graph.betweenness_centrality(edges).collect()}

    def joined(*_):
        raise AssertionError("the arcs of shortest paths fit a task")

    monkeypatch.setattr(graph, "relaxed_betweenness", joined)
    monkeypatch.setattr(graph, "PRUNED_ARCS", 0, raising=False)
    monkeypatch.setattr(graph, "BROADCAST_ARCS", len(rows))  # half of both directions
    got = {r.node: r.centrality for r in graph.betweenness_centrality(edges).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_sampled_betweenness_keeps_its_bound(spark, monkeypatch):
    import random

    dice = random.Random(8)
    rows = {(min(a, b), max(a, b)): float(dice.randint(1, 9)) for a, b in ((dice.randrange(300), dice.randrange(300)) for _ in range(700)) if a != b}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()] + [(1, 1, 2.0), (1, 2, None), (3, 4, -1.0)], "a int, b int, weight double")
    exact = {r.node: r for r in graph.betweenness_centrality(edges).collect()}
    assert {r.error_bound for r in exact.values()} == {0.0}
    monkeypatch.setattr(graph, "EXACT_NODES", 100)
    some = {r.node: r for r in graph.betweenness_centrality(edges, error=0.2).collect()}
    assert some.keys() == exact.keys() and 0 < next(iter(some.values())).error_bound <= 0.2
    assert all(abs(some[k].centrality - exact[k].centrality) <= some[k].error_bound for k in some)
    monkeypatch.setattr(graph, "BROADCAST_ARCS", 10)
    apart = {r.node: r.centrality for r in graph.betweenness_centrality(edges, sources=edges.select(edges.a.alias("node")).where("node < 3")).collect()}
    monkeypatch.setattr(graph, "BROADCAST_ARCS", 10_000)
    assert all(abs(r.centrality - apart[r.node]) < 1e-9 for r in graph.betweenness_centrality(edges, sources=edges.select(edges.a.alias("node")).where("node < 3")).collect())
    assert graph.betweenness_centrality(edges.limit(0)).collect() == []


def test_betweenness_is_exact_at_any_size_and_spares_the_driver(spark, monkeypatch):
    import random

    dice = random.Random(11)
    rows = {(min(a, b), max(a, b)): float(dice.randint(1, 9)) for a, b in ((dice.randrange(200), dice.randrange(200)) for _ in range(500)) if a != b}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "a int, b int, weight double")
    small = {r.node: (r.centrality, r.error_bound) for r in graph.betweenness_centrality(edges).collect()}

    def whole(*_):
        raise AssertionError("the graph goes through the driver")

    monkeypatch.setattr(graph, "EXACT_NODES", 10)
    monkeypatch.setattr(type(edges), "toPandas", whole)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", whole)
    large = {r.node: (r.centrality, r.error_bound) for r in graph.betweenness_centrality(edges, error=None).collect()}
    assert large.keys() == small.keys() and all(abs(large[k][0] - small[k][0]) < 1e-12 and large[k][1] == 0 for k in small)
    assert {r.error_bound for r in graph.betweenness_centrality(edges).collect()} == {0.0}
    monkeypatch.setattr(graph, "BROADCAST_ARCS", 10)
    monkeypatch.setattr(graph, "RELAXED_ROWS", 500)  # two batches of sources
    some = edges.where("a < 25 AND b < 60")
    joined = {r.node: r.centrality for r in graph.betweenness_centrality(some).collect()}
    monkeypatch.setattr(graph, "BROADCAST_ARCS", 10_000)
    dealt = {r.node: r.centrality for r in graph.betweenness_centrality(some).collect()}
    assert joined.keys() == dealt.keys() and all(abs(joined[k] - dealt[k]) < 1e-9 for k in dealt)


def test_eigenvector_of_star(spark):
    star = spark.createDataFrame([(0, i, 1.0) for i in range(1, 5)], "a int, b int, weight double")
    got = dict(graph.eigenvector_centrality(star).collect())
    assert abs(got[0] - 1 / math.sqrt(2)) < 0.01 and abs(got[1] - 1 / math.sqrt(8)) < 0.01


def test_two_cliques_are_two_communities(spark):
    clique = lambda s: [(a, b, 1.0) for a in range(s, s + 4) for b in range(a + 1, s + 4)]
    e = spark.createDataFrame(clique(0) + clique(4) + [(3, 4, 1.0)], "a int, b int, weight double")
    labels = graph.communities(e)
    got = dict(labels.collect())
    assert len({got[i] for i in range(4)}) == 1 and len({got[i] for i in range(4, 8)}) == 1 and got[0] != got[7]
    assert {r.node for r in graph.bridges(e, labels).collect()} == {3, 4}


def test_communities_keep_one_table_and_any_join(spark, monkeypatch):
    clique = lambda s: [(a, b, 1.0) for a in range(s, s + 3) for b in range(a + 1, s + 3)]
    e = spark.createDataFrame(clique(0) + clique(3) + [(2, 3, 1.0)], "a int, b int, weight double")
    made = []
    init = graph.Scratch.__init__
    monkeypatch.setattr(graph.Scratch, "__init__", lambda self, spark: (init(self, spark), made.append(self))[0])
    got = dict(graph.communities(e).collect())
    assert len(set(got.values())) == 2 and [len(x.paths) for x in made] == [1]
    monkeypatch.setattr(graph, "BROADCAST_NODES", 0)
    assert dict(graph.communities(e).collect()) == got


def test_path_costs_differ(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 3, 1.0), (0, 2, 5.0), (2, 3, 5.0)], "a int, b int, weight double")
    best = lambda inverse: graph.paths(e, 0, 3, 3, inverse).orderBy("cost").first().path
    assert best(True) == [0, 2, 3] and best(False) == [0, 1, 3]


def test_edge_roll_up(spark):
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([("a", "b", "Family", 1, t, None, 0.0), ("b", "a", "Financial Transaction", 2, t, 2.0, 1.0), ("a", "a", "Family", 1, t, 1.0, 0.0)], "src string, dst string, rel_type string, case_id int, ts timestamp, weight double, severity double")
    r = graph.roll_up_edges(e).first()
    assert abs(r.weight - (0.4 + 0.95 * 1.2 * 2)) < 1e-9 and r.n == 2 and r.cross_case and r.primary_type == "Financial Transaction"


def test_scalars(spark):
    d = spark.createDataFrame([("anna berg", "berg anna"), ("kitten", "sitting"), ("", "")], "a string, b string")
    assert [round(r[0], 6) for r in d.select(token_sort_ratio(F.col("a"), F.col("b"))).collect()] == [1.0, round(8 / 13, 6), 1.0]
    t = spark.sql("SELECT timestamp'2024-01-01 00:00' a, timestamp'2024-01-02 12:00' b")
    assert t.select(day_gap(F.col("a"), F.col("b")), day_gap(F.col("b"), F.col("a"))).first()[:] == (1, 2)
    assert abs(t.select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))).first()[0] - 10007.5) < 1
    assert t.select(jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))).first()[0] == 0


def test_intervals(spark):
    day = dt.date(2024, 1, 1)
    make = lambda k, gaps: [(k, day + dt.timedelta(days=sum(gaps[:i]))) for i in range(len(gaps) + 1)]
    e = spark.createDataFrame(make("acc", [30, 20, 10]) + make("dec", [10, 20, 30]) + make("irr", [10, 30, 20]) + make("two", [5]) + make("one", []), "k string, d date")
    got = {r.k: r.trend for r in report.interval_trend(report.intervals(e, "k", "d"), "k").collect()}
    assert got == {"acc": "accelerating", "dec": "decelerating", "irr": "irregular", "two": "decelerating"}


def test_mentions(spark):
    d = spark.createDataFrame([(1, 1, "call +91-9876543210 or (212) 555-0101, car MH-12-AB-1234 on 03/04/2024 for Rs. 4,500, mail x@y.org"), (2, 1, None)], "doc_id int, case_id int, text string")
    got = {(r.kind, r.name) for r in text.mentions(d).collect()}
    assert got == {("phone", "9876543210"), ("phone", "2125550101"), ("vehicle", "MH-12-AB-1234"), ("date", "03/04/2024"), ("email", "x@y.org")}
    assert d.select(text.amounts(F.col("text"))).first()[0] == [4500.0]


def test_severity_and_names(spark):
    d = spark.createDataFrame([("he was cleared of murder",), ("he confessed to murder",), ("murder",)], "t string")
    assert [round(r[0], 6) for r in d.select(text.severity(F.col("t"))).collect()] == [0.15, 1.0, 0.0]
    n = spark.createDataFrame([("Anna Berg",), ("amount_inr",), ("cellTower",), ("TOWER_ID",), ("Tower Legend Tower",)], "n string")
    assert [r[0] for r in n.select(~tokens.is_malformed(F.col("n")) & ~tokens.is_schema_word(F.col("n"))).collect()] == [True, False, False, False, False]


def test_strip_labels(spark):
    d = spark.createDataFrame([("Full Name: Anna Berg\nAmount: 500\nplain line",)], "t string")
    assert d.select(text.strip_labels(F.col("t"), ["full name"])).first()[0] == "Anna Berg\nplain line"


def test_pairs_of_large_groups_meet_once(spark):
    from caseweave.plans.blocks import pairs_within

    data = [("g", i) for i in range(23)] + [("g", 3), ("h", 1), ("h", 2), (None, 1), (None, 2), ("h", None), ("one", 5)]
    table = spark.createDataFrame(data, "k string, m int")
    want = sorted([("g", i, j) for i in range(23) for j in range(i + 1, 23)] + [("h", 1, 2)])
    for block_rows in (1, 4, 2000):
        assert sorted(map(tuple, pairs_within(table, ["k"], "m", block_rows).collect())) == want
    assert pairs_within(table.limit(0), ["k"], "m").count() == 0


def test_chains_of_several_keys(spark):
    data = [("a", 2, "x"), ("a", 1, "y"), (None, 1, "z"), ("b", 1, None), ("a", 1, "w")]
    got = {(r.k, r.block_index): (r.o, r.previous_hash, r.block_hash) for r in audit.build_chain(spark.createDataFrame(data, "k string, o int, v string"), "k", "o", ["v"]).collect()}
    before = audit.GENESIS
    for i, (o, v) in enumerate([(1, "w"), (1, "y"), (2, "x")]):
        h = hashlib.sha256(f"{v}|{before}".encode()).hexdigest()
        assert got["a", i] == (o, before, h)
        before = h
    assert got["b", 0][2] == hashlib.sha256(f"|{audit.GENESIS}".encode()).hexdigest() and got[None, 0][1] == audit.GENESIS and len(got) == 5


def test_chain_finds_the_first_bad_block(spark):
    base = spark.createDataFrame([("k", i, f"v{i}") for i in range(5)], "k string, o long, v string")
    chain = audit.build_chain(base, "k", "o", ["k", "v"]).join(base, ["k", "o"]).cache()
    assert audit.verify_chain(chain, "k", ["k", "v"]).first()[1:] == (5, None, None)
    changed = chain.withColumn("v", F.when(F.col("o") == 3, "x").otherwise(F.col("v")))
    assert audit.verify_chain(changed, "k", ["k", "v"]).first()[1:] == (5, 3, "hash")
    broken = chain.withColumn("previous_hash", F.when(F.col("o") == 3, "x").otherwise(F.col("previous_hash")))
    assert audit.verify_chain(broken, "k", ["k", "v"]).first()[1:] == (5, 3, "link")
    assert audit.verify_chain(chain.where("block_index <> 2"), "k", ["k", "v"]).first()[1:] == (4, 3, "link")
    assert audit.verify_chain(chain.union(chain.where("block_index = 2").withColumn("block_hash", F.lit("x"))), "k", ["k", "v"]).first()[1:] == (6, 2, "hash")


def test_candidates_and_recommendations(spark):
    e = spark.createDataFrame([(1, "Person", "Anna Berg", None), (2, "Person", "berg anna", None), (3, "Person", "Berg", None), (4, "Person", "Anna Holm", 1)], "entity_id int, entity_type string, name string, merged_into int")
    assert [(r.id_a, r.id_b, r.similarity) for r in linkage.candidate_matches(e).collect()] == [(1, 2, 1.0)]
    d = spark.createDataFrame([(0, False), (1, False), (2, False), (2, True), (1, True)], "s int, p boolean")
    assert [r[0] for r in d.select(linkage.recommendation(F.col("s"), F.col("p"))).collect()] == ["no", "review", "auto", "review", "no"]


def test_tf_idf_and_cosine(spark):
    d = spark.createDataFrame([(1, "red fox runs"), (2, "red fox runs"), (3, "blue whale"), (4, "")], "doc_id int, text string")
    assert rows(linkage.cosine_pairs(linkage.tf_idf(d, ["the"]))) == [(1, 2, 1.0)]


def test_sources(spark, tmp_path):
    (tmp_path / "calls.csv").write_text("caller,callee,duration\n+1 555 123 4567,555-999-8888,10\n12,5551234567,3\n")
    calls = spark.read.option("header", True).csv(str(tmp_path / "calls.csv")).withColumns({"caller_number": F.lit(None).cast("string"), "callee_number": F.lit(None).cast("string")})
    assert sorted(r.number for r in sources.call_entities(calls).collect()) == ["15551234567", "5551234567", "5559998888"]
    seen = sources.delta(calls, spark.createDataFrame([], "row_hash string"), ["caller", "callee"])
    assert sources.delta(calls, seen, ["caller", "callee"]).count() == 0
    assert sources.missing_columns(calls, ["caller", "amount"]) == ["amount"]


def test_streaming_windows(spark, tmp_path):
    from caseweave import streaming

    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("a", "b", t + dt.timedelta(minutes=m)) for m in range(12)] + [("c", "d", t)], "src string, dst string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src string, dst string, ts timestamp").parquet(str(tmp_path / "in"))
    q = streaming.contact_windows(stream).writeStream.format("memory").queryName("bursts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.a, r.n) for r in spark.table("bursts").collect()} == {("a", 12)}


def test_long_circular_flow_is_found_once(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 2), ("d", "a", 1), ("c", "a", 1), ("d", "b", 1), ("a", "a", 1), ("a", "b", 3)], "src string, dst string, case_id int")
    assert rows(detect.long_circular_flows(e)) == [(["a", "b", "c", "d"], 3)]
    assert rows(detect.long_circular_flows(e, 3)) == [(["a", "b", "c"], 2), (["b", "c", "d"], 2)]
    assert rows(detect.long_circular_flows(e.limit(0))) == []


def test_merge_chain_and_split(spark):
    e = spark.createDataFrame([("a", "P", "Anna", None, 0.5), ("b", "P", "Ann", ["A."], 0.9), ("c", "P", "Anne", None, 0.9), ("x", "Q", "Car", None, 1.0), ("z", "P", "Zoe", None, 0.2)], "entity_id string, entity_type string, name string, aliases array<string>, confidence double")
    decisions = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x")], "primary string, secondary string")
    out = resolution.merge_entities(e, resolution.survivors(decisions))
    assert {r.entity_id: (r.name, r.aliases, round(r.confidence, 6)) for r in out.collect()} == {"a": ("Anna", ["A.", "Ann", "Anne"], 0.7), "x": ("Car", [], 1.0), "z": ("Zoe", [], 0.2)}
    split = resolution.merge_entities(e, resolution.survivors(decisions.where("secondary <> 'b'")))
    assert {r.entity_id for r in split.collect()} == {"a", "b", "x", "z"}
    edges = spark.createDataFrame([("b", "z", "t", 9.0), ("z", "a", "t", 1.0), ("b", "c", "t", 2.0)], "src string, dst string, rel_type string, weight double")
    assert rows(resolution.redirect_edges(edges, resolution.survivors(decisions))) == [("a", "a", "t", 2.88), ("a", "z", "t", 10.0)]


def test_gate_and_flags(spark):
    d = spark.createDataFrame([("auto", 0.95), ("auto", 0.9), ("auto", None), ("no", 0.1)], "r string, c double")
    assert [r[0] for r in d.select(resolution.gated(F.col("r"), F.col("c"))).collect()] == ["auto", "review", "review", "no"]
    e = spark.createDataFrame([("a", 0.3), ("b", 0.9)], "entity_id string, confidence double")
    out = resolution.flag_unresolved(e, spark.createDataFrame([("a", "x"), ("a", "y")], "entity_id string, reason string"))
    assert rows(out.select("entity_id", "confidence", "status", "reason")) == [("a", 0.1, "unresolved", "x"), ("b", 0.9, "resolved", None)]


def test_signature_families(spark):
    d = spark.createDataFrame([(1, "Placed neatly beside; a TROPHY, trophy, trophy, trophy"), (2, None), (3, "")], "doc_id int, text string")
    assert rows(series.signature_families(d)) == [(1, "object_placement", 4, 0.95, 0.4)]
    assert rows(series.signature_intensity(series.signature_families(d))) == [(1, 1, 0.38)]


def test_victim_signals_and_line(spark):
    d = spark.createDataFrame([(1, "**Victim:** Ann Berg, 41, former clerk\nShe lived alone; her car. Aged 9, aged 41."), (2, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in series.victim_signals(d).collect()}
    assert (got[1].ages, got[1].genders, got[1].risks) == ([41], ["female"], ["alone_at_time_of_crime", "lives_alone"])
    assert got[1].profile == "Ann Berg, 41, former clerk" and got[2].ages == [] and got[2].profile == ""
    assert rows(series.victim_line(d).where("doc_id = 1")) == [(1, "Ann Berg", 41, "former clerk")]


def test_method_indicators(spark):
    d = spark.createDataFrame([(1, "Tied, then a knife, knife, knife, knife")], "doc_id int, text string")
    assert {r.dim: r.hits for r in series.method_indicators(d).collect()} == {"control": ["tied"], "weapon_type": ["knife"] * 3}


def test_series_roll_ups(spark):
    p = spark.createDataFrame([(1, "X"), (2, "x "), (3, "y"), (3, None)], "case_id int, name string")
    assert rows(series.shared_locations(p)) == [(3, 1, 0.333)]
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a")], "case_id int, term string")
    assert [(r.cases, round(r.mean_overlap, 6), r.common) for r in series.signature_overlap(t).collect()] == [(3, round((0.5 + 0.5 + 1) / 3, 6), 1)]
    assert rows(series.signature_overlap(t.limit(0))) == [(0, 0.0, 0)]
    links = spark.createDataFrame([(1, 2, 60.0), (2, 3, 80.0)], "case_a int, case_b int, score double")
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "case_id int, cluster int")
    regions = spark.createDataFrame([(1, "n"), (2, "n"), (3, "s")], "case_id int, region string")
    assert rows(series.cluster_roll_up(links, clusters, regions)) == [(1, 3, 70.0, 80.0, 2, 3, 2, True)]


def test_text_links(spark):
    schema = "case_id int, terms array<string>, names array<string>, methods map<string, array<string>>, ages array<int>, genders array<string>, risks array<string>"
    c = spark.createDataFrame([(1, ["a", "b"], ["n"], {"m": ["x"], "o": ["y"]}, [30], ["male"], []), (2, ["a"], [], {"m": ["x"]}, [36], ["male"], []), (3, [], [], {}, [30], ["male"], [])], schema)
    got = series.text_links(c).collect()
    assert [(r.case_a, r.case_b, round(r.score, 6)) for r in got] == [(1, 2, round(0.4 * 0.5 + 0.25 * 0.5 + 0.2 * 0.8, 6))]


def test_role_severity_and_importance(spark):
    e = spark.createDataFrame([("a", "b", "t", 1.0, 1.0), ("a", "b", "u", 3.0, None), ("b", "c", "t", 1.0, 0.0)], "a string, b string, rel_type string, w double, severity double")
    assert {r.node: (round(r.severity, 6), round(r.score, 4)) for r in graph.role_severity(e).collect()} == {"a": (2.0, 66.6667), "b": (3.0, 100.0), "c": (1.0, 33.3333)}
    part = lambda v: spark.createDataFrame([("a", v)], "node string, score double")
    assert [(round(r.score, 6), r.band) for r in graph.importance(part(100.0), part(100.0), part(50.0), part(0.0)).collect()] == [(80.0, "CRITICAL")]


def test_case_header(spark):
    d = spark.createDataFrame([(1, "FIR No: 12/2024\nSubject: Lost goods\nAccused Persons Named\n1 | Ann Berg | -- | lead | held\nInvestigating Officer: Name: Z"), (2, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in text.case_header(d).collect()}
    assert (got[1].case_number, got[1].subject, got[1].name, got[1].investigating_officer) == ("12/2024", "Lost goods", "Lost goods", "Z")
    assert [tuple(x) for x in got[1].accused] == [("Ann Berg", "", "lead", "held")]
    assert got[2].accused == [] and got[2].name == ""


def test_whole_names_and_headers_of_any_alphabet(spark, tmp_path):
    import re
    import unicodedata

    from caseweave import catalog

    texts = ["Anna Bergstr\u00f6m met \u00c9mile Zola", "\u00dcmit \u00d6zil, Jo\u00e3o", "Anna Berg", "xAnna Berg Anna9 Berg", None, "Fu\u0308r Max Mu\u0308ller", "A B C D", "Aa Bb Cc Dd Ee Ff", "\u00e9Anna Berg\u00e9\u00e9X Zed",
             "FIR No: 12/2024\nSubject:\u00a0Stra\u00dfe in K\u00f6ln\u2028zwei\nDate: 12-M\u00e4rz-2024\nStation: M\u00fcnchen", "Case No: 7\nSection 302\nDistrict: \u00c1vila"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def runs(t):
        cat = lambda i: unicodedata.category(t[i])[0] if 0 <= i < len(t) and t[i] != "_" else "L" if 0 <= i < len(t) else " "
        word = lambda w: (x := [c for c in w if unicodedata.category(c)[0] != "M"]) and len(x) > 1 and x[0].isupper() and all(c.islower() for c in x[1:])
        at = 0
        while at < len(t):
            ends = [j for j in range(at + 1, len(t) + 1) if cat(at - 1) not in "LMN" and cat(j) not in "LMN" and 2 <= len(t[at:j].split(" ")) <= 4 and all(map(word, t[at:j].split(" ")))]
            if ends:
                yield t[at : ends[-1]]
            at = ends[-1] if ends else at + 1

    got = catalog.QUERIES["txt7_all_capitalised_runs"](spark, str(tmp_path))
    assert rows(got) == sorted({(i, n) for i, t in enumerate(texts) for n in runs(t or "")}) and (0, "Anna Bergstr\u00f6m") in rows(got)
    found = lambda t, p: (m.group(1).strip(" ") if (m := re.search(p, t, re.I)) else "")
    want = sorted((i, *[next((x[:200] for p in ps if (x := found(t or "", p))), "") for ps in text.HEADER.values()]) for i, t in enumerate(texts))
    got = rows(catalog.QUERIES["txt21_all_case_headers"](spark, str(tmp_path)))
    assert got == want and got[9][2] == "Stra\u00dfe in K\u00f6ln\u2028zwei" and got[9][4] == "12-M\u00e4rz-2024" and got[4] == (4, *[""] * len(text.HEADER))


def test_case_links_equal_the_triangle(spark):
    from caseweave import catalog

    data = "/root/testdata/sf0.001"
    c = catalog._view(spark, data, "caserec").where("case_id < 90").withColumns({"weapon": F.nullif("weapon", F.lit("")), "scene": F.when(F.col("case_id") % 4 > 0, "s"), "signatures": F.slice("signatures", 1, 3)}).cache()
    docs = catalog._table(spark, data, "documents").where("doc_id < 90")
    vectors = linkage.tf_idf(docs, ["the"]).cache()
    cosine = linkage.cosine_pairs(vectors).cache()
    ids = c.select("case_id")
    triangle = linkage.score_pairs(c, ids.withColumnRenamed("case_id", "case_a").crossJoin(ids.withColumnRenamed("case_id", "case_b")).where("case_a < case_b"), cosine).cache()
    for m in (20.0, 30.0, 43.0, 55.0, 60.0):
        assert rows(linkage.case_links(c, linkage.narrative_cosines(c, vectors, m), m)) == rows(triangle.where(F.col("score") >= m))
    assert triangle.where("score >= 30 AND signature <= 0.3 AND cosine = 0").count() > 0
    assert rows(linkage.cosine_pairs(vectors, 0.4)) == rows(cosine.where("cosine >= 0.4"))


def test_communities_of_a_ring_grow_by_levels(spark):
    n = 60
    ring = spark.createDataFrame([(i, (i + 1) % n, 1.0) for i in range(n)] + [(100, 101, 1.0)], "a int, b int, weight double")
    got = dict(graph.communities(ring).collect())
    assert len(got) == n + 2 and got[100] == got[101]
    once = graph._local_moves(graph.Scratch(spark), graph.both_ways(ring, "weight"), 2.0 * (n + 1), 20)
    assert len(set(got.values())) < len({r.community for r in once.collect()})


def test_candidates_rank_both_ends_of_a_pair(spark):
    names = [(1, "Anna Berg"), *[(i, "Anna Berg") for i in range(2, 5)], (9, "Anna Bergs")]
    e = spark.createDataFrame([(i, "Person", n, None) for i, n in names], "entity_id int, entity_type string, name string, merged_into int")
    got = {(r.id_a, r.id_b): r["rank"] for r in linkage.candidate_matches(e, limit=1).collect()}
    assert got == {(1, 2): 1, (1, 3): 1, (1, 4): 1, (1, 9): 1}


def test_default_edge_weights_cover_every_type(spark):
    from caseweave.operators import graph

    types = {"Co-accused": 1.0, "Financial Transaction": 0.95, "Ownership": 0.9, "Communication": 0.85, "Location Presence": 0.7, "Employment": 0.6, "Associate": 0.5, "Family": 0.4, "Unknown": 0.3}
    rows = [(f"a{i}", f"b{i}", t, 1, None, None, 0.0) for i, t in enumerate(types)]
    edges = spark.createDataFrame(rows, "src string, dst string, rel_type string, case_id int, ts timestamp, severity double, weight double")
    assert {r.primary_type: round(r.weight, 6) for r in graph.roll_up_edges(edges).collect()} == types


def test_alias_pairs_fold_into_their_names(spark):
    from caseweave.operators import text

    docs = spark.createDataFrame([(1, "Ravi Kumar, alias Rocky\n. Anil Rao aka Bunty, went."), (2, "Meera Das (Mini)\nend"), (3, None), (4, "")], "doc_id int, text string")
    pairs = {(r.doc_id, r.name, r.alias) for r in text.alias_pairs(docs).collect()}
    assert {(1, "Ravi Kumar", "Rocky"), (1, "Anil Rao", "Bunty"), (2, "Meera Das", "Mini")} <= pairs
    named = spark.createDataFrame([(1, "ROCKY"), (1, "Other"), (2, "Rocky")], "doc_id int, name string")
    assert sorted((r.doc_id, r.name) for r in text.fold_aliases(named, text.alias_pairs(docs)).collect()) == [(1, "Other"), (1, "Ravi Kumar"), (2, "Rocky")]


def test_event_check_wants_whole_words(spark):
    from pyspark.sql import functions as F

    from caseweave.operators import text

    rows = [("He knows of a murder", (True, 50)), ("no evidence of murder", (False, 75)), ("nothing", (False, 30)), (None, (False, 30)), ("not" + " " * 90 + "murder", (True, 50))]
    got = spark.createDataFrame([(t,) for t, _ in rows], "text string").select(text.event_check(F.col("text"), "murder").alias("e")).collect()
    assert [tuple(r.e) for r in got] == [x for _, x in rows]


def test_scope_removes_what_was_written_inside(spark):
    from caseweave.plans.scratch import Scratch, scope

    outer = Scratch(spark)
    with scope():
        inner = Scratch(spark)
        gone = inner.write(spark.range(5))
        kept = outer.write(gone)
    assert kept.count() == 5 and not inner.paths and outer.paths
    outer.drop(kept)
    assert not outer.paths


def shuffled_above_pairs(df):
    """Whether the plan of ``df`` shuffles above the join in which pairs meet."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    return "Exchange" in plan.split("SortMergeJoin")[0]


def test_co_locations_equal_the_product_and_are_not_shuffled(spark):
    import random

    rnd = random.Random(8)
    data = [(rnd.randrange(12), rnd.choice("KL"), rnd.randrange(6)) for _ in range(90)] + [(None, "K", 1), (1, None, 1), (1, "K", None)]
    known = [(rnd.randrange(12), rnd.randrange(12)) for _ in range(15)] + [(None, 3)]
    there = {d for d in data if None not in d}
    hidden = {frozenset(k) for k in known}
    want = {}
    for p, place, slot in there:
        for q, other, same in there:
            if p < q and (place, slot) == (other, same) and frozenset((p, q)) not in hidden:
                want[p, q, place] = want.get((p, q, place), 0) + 1
    found = detect.co_locations(spark.createDataFrame(data, "person int, location string, slot int"), spark.createDataFrame(known, "a int, b int"))
    assert {(r.p1, r.p2, r.location): r.joint for r in found.collect()} == want and found.count() == len(want) and max(want.values()) > 1
    assert not shuffled_above_pairs(found)


def test_pairs_carry_both_members(spark):
    from caseweave.plans.blocks import pairs_carrying

    table = spark.createDataFrame([("g", i, f"v{i}") for i in range(9)] + [(None, 1, "x"), ("g", None, "y")], "k string, m int, v string")
    for block_rows in (1, 4, 2000):
        assert sorted(map(tuple, pairs_carrying(table, ["k"], "m", ["v"], block_rows).collect())) == [("g", i, j, f"v{i}", f"v{j}") for i in range(9) for j in range(i + 1, 9)]


def test_alerts_are_not_shuffled_for_the_rules(spark):
    rules = spark.createDataFrame([("x", False), ("y", True)], "rule_type string, is_enabled boolean")
    found = detect.run_all({t: spark.range(3).withColumn("alert_type", F.lit(t)) for t in "xyz"}, rules)
    assert sorted(r.alert_type for r in found.collect()) == ["y"] * 3 + ["z"] * 3
    assert "Exchange hash" not in found._jdf.queryExecution().executedPlan().toString()


def test_signature_pairs_are_scored_where_they_meet(spark):
    from caseweave import catalog

    c = catalog._view(spark, "/root/testdata/sf0.001", "caserec").where("case_id < 120").withColumn("signatures", F.transform("signatures", lambda s: F.substring(s, 1, 6))).cache()
    found = linkage.score_signature_pairs(c)
    side = lambda n: c.select(F.col("case_id").alias(f"case_{n}"), F.col("signatures").alias(f"s_{n}"))
    want = linkage.score_pairs(c, side("a").crossJoin(side("b")).where("case_a < case_b AND arrays_overlap(s_a, s_b)").select("case_a", "case_b"))
    assert rows(found) == rows(want) and found.count() > 100
    assert not shuffled_above_pairs(found)
    for query in ("sim6_composite", "sim10_text_links", "sim10_all_text_links"):
        assert not shuffled_above_pairs(catalog.QUERIES[query](spark, "/root/testdata/sf0.001"))


def test_text_links_equal_the_triangle(spark):
    import itertools
    import random

    rnd = random.Random(5)
    some = lambda xs, most: rnd.choice([None, rnd.sample(xs, rnd.randrange(most)), rnd.choices(xs, k=rnd.randrange(most))])
    data = [(i, some("abcde", 4), some("npq", 3), rnd.choice([None, {}, {"w": ["x"]}, {"w": some("xy", 3), "v": some("xy", 3)}]), some([20, 30, 41], 3), some(["f", "m"], 3), some("rs", 3)) for i in range(40)]
    schema = "case_id int, terms array<string>, names array<string>, methods map<string, array<string>>, ages array<int>, genders array<string>, risks array<string>"
    part = lambda x, y: len(set(x or ()) & set(y or ())) / len(set(x or ()) | set(y or ())) if x or y else 0.0
    mean = lambda xs: sum(xs) / len(xs) if xs else 0.0
    want = {}
    for a, b in itertools.combinations(data, 2):
        ma, mb = ({d: v for d, v in (x[3] or {}).items() if v is not None} for x in (a, b))
        near = [max(0.0, 1 - abs(mean(a[4]) - mean(b[4])) / 15)] if a[4] and b[4] else []
        near += [float(sorted(a[5]) == sorted(b[5]))] if a[5] and b[5] else []
        near += [part(a[6], b[6])] if a[6] or b[6] else []
        signature = part(a[1], b[1])
        score = 0.40 * signature + 0.25 * mean([part(ma.get(d), mb.get(d)) for d in {**ma, **mb}]) + 0.20 * mean(near) + 0.15 * part(a[2], b[2])
        want[a[0], b[0]] = (score, signature)
    cases = spark.createDataFrame(data, schema)
    got = {(r.case_a, r.case_b): round(r.score, 9) for r in series.text_links(cases).collect()}
    assert got == {k: round(s, 9) for k, (s, _) in want.items() if s >= 0.25} and len(got) > 50
    got = series.text_links(cases, 0.0, 0.1).collect()
    assert sorted((r.case_a, r.case_b) for r in got) == sorted(k for k, (_, s) in want.items() if s > 0.1)


def test_pairs_of_blocks_are_judged_in_arrays(spark, monkeypatch):
    import itertools

    from caseweave.operators import pairwise

    part = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    data = [(i, [f"t{i % 7}", f"t{i % 5 + 7}", None][: i % 4], ["n"] if i % 6 == 0 else None, {"w": [f"v{i % 2}"], "u": None} if i % 3 else None) for i in range(70)]
    cases = spark.createDataFrame(data, "case_id long, terms array<string>, names array<string>, methods map<string, array<string>>").withColumns({c: F.lit(None).cast(k) for c, k in (("ages", "array<int>"), ("genders", "array<string>"), ("risks", "array<string>"))})
    want = {}
    for a, b in itertools.combinations(data, 2):
        method = part(set(a[3]["w"]), set(b[3]["w"])) if a[3] and b[3] else 0.0
        score = 0.40 * part(set(a[1]), set(b[1])) + 0.25 * method + 0.15 * part(set(a[2] or ()), set(b[2] or ()))
        if score >= 0.25:
            want[a[0], b[0]] = round(score, 9)
    monkeypatch.setattr(pairwise, "PAIRS_AT_ONCE", 100)
    monkeypatch.setattr(pairwise, "BATCH_ROWS", 50)
    whole = pairwise.blocks_met
    monkeypatch.setattr(pairwise, "blocks_met", lambda *a: whole(*a[:4], 9))  # groups of several blocks
    found = series.text_links(cases)
    got = [(r.case_a, r.case_b, round(r.score, 9)) for r in found.collect()]
    assert {(a, b): s for a, b, s in got} == want and len(got) == len(want) > 300
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]


def test_cosines_come_from_products_of_blocks(spark, monkeypatch):
    import itertools
    import random

    rnd = random.Random(2)
    vectors = {}
    for i in range(40):
        bag = {f"t{rnd.randrange(12)}": rnd.random() + 0.1 for _ in range(5)}
        vectors[i] = {t: w / math.sqrt(sum(v * v for v in bag.values())) for t, w in bag.items()}
    rows_ = [(i, t, w) for i, v in vectors.items() for t, w in v.items()]
    dot = lambda a, b: sum(w * b.get(t, 0.0) for t, w in a.items())
    want = {(i, j): round(dot(vectors[i], vectors[j]), 3) for i, j in itertools.combinations(vectors, 2) if dot(vectors[i], vectors[j]) >= 0.5}
    whole = linkage.all_blocks_met
    monkeypatch.setattr(linkage, "all_blocks_met", lambda *a: whole(*a, 9))
    found = linkage.cosine_pairs(spark.createDataFrame(rows_, "doc_id long, term string, weight double"), 0.5)
    got = [(r.case_a, r.case_b, r.cosine) for r in found.collect()]
    assert len(got) == len(want) > 100 and all(abs(c - want[a, b]) < 6e-4 for a, b, c in got)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]  # pairs below the minimum don't leave their task


def test_texts_of_one_id_are_one_document(spark):
    found = linkage.tf_idf(spark.createDataFrame([(1, "red"), (1, "red"), (2, None), (3, "fox")], "doc_id int, text string"), [])
    assert {(r.doc_id, r.term): round(r.weight, 9) for r in found.collect()} == {(1, "red"): 1.0, (3, "fox"): 1.0}


def test_density_clusters_join_cells_not_points(spark, monkeypatch):
    import random

    from caseweave.operators import rollups

    rnd = random.Random(3)
    points = [(i, rnd.randrange(2), round(rnd.uniform(-3, 3), 2), round(rnd.uniform(0, 1.5), 2)) for i in range(60)] + [(i, 1, 9.0, 9.0) for i in range(100, 400)] + [(900, 1, 50.0, 0.0), (901, 1, None, 0.0), (902, 1, float("nan"), 0.0), (903, 0, float("inf"), 0.0)]
    good = [p for p in points if p[0] < 901]
    near = lambda p, q: p[1] == q[1] and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 0.45 * 0.45
    root = {p[0]: p[0] for p in good}
    while True:
        low = {p[0]: min(root[q[0]] for q in good if near(p, q)) for p in good}
        if low == root:
            break
        root = low
    want = {i: r for i, r in root.items() if list(root.values()).count(r) > 1}
    edges = []
    plain = rollups.connected_components
    monkeypatch.setattr(rollups, "connected_components", lambda df, *ends: edges.append(df.count()) or plain(df, *ends))
    got = rollups.near_vectors(spark.createDataFrame(points, "id int, f int, x double, y double"), ["f"], ["x", "y"]).collect()
    assert {r.id: r.cluster for r in got} == want and len(got) == len(want) and 900 not in want
    assert edges[0] < 1000  # the 300 equal points alone have 44,850 pairs


def test_tf_idf_equals_the_definition_and_shuffles_kept_terms(spark):
    from collections import Counter

    texts = {1: "the red fox runs, red fox", 2: "A red whale", 3: None, 4: "whale whale red fox", 5: "x"}
    bags = {}
    for i, t in texts.items():
        words = [w for w in __import__("re").findall(r"\w\w+", (t or "").lower()) if w != "the"]
        bags[i] = Counter(words + [" ".join(p) for p in zip(words, words[1:])])
    kept = sorted(Counter(sum(bags.values(), Counter())).items(), key=lambda kv: (-kv[1], kv[0]))[:4]
    df = {t: sum(t in b for b in bags.values()) for t, _ in kept}
    want = {}
    for i, b in bags.items():
        x = {t: (1 + math.log(b[t])) * (math.log(6 / (1 + df[t])) + 1) for t in df if t in b}
        want |= {(i, t): round(v / math.sqrt(sum(u * u for u in x.values())), 9) for t, v in x.items()}
    found = linkage.tf_idf(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), ["the"], 4)
    assert {(r.doc_id, r.term): round(r.weight, 9) for r in found.collect()} == want
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_lowered_once(spark):
    from caseweave import catalog

    for query in ("txt24_severity", "txt28_method_indicators", "txt29_victim_signals"):
        assert catalog.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    clears = ["cleared", "exonerated", "acquitted", "falsely accused", "wrongfully accused", "not implicated", "no evidence", "dismissed", "exonerate", "innocent", "not charged", "dropped charge", "witness only", "present at", "merely present", "not involved", "no involvement"]
    d = spark.createDataFrame([(f"murder {c}",) for c in clears], "t string")
    assert {round(r[0], 6) for r in d.select(text.severity(F.col("t"))).collect()} == {0.15}


def test_many_small_tasks_and_same_counts(spark):
    cores = spark.sparkContext.defaultParallelism
    contacts = spark.createDataFrame([("p", "q", 1, 1, 2.0), ("q", "p", None, 2, None), ("p", "q", 1, 3, 4.0), ("q", "q", 1, 4, 4.0), (None, "q", 1, 5, 4.0)], "src string, dst string, case_id int, ts int, weight double")
    by_case = detect.contacts_by_case(contacts)
    assert by_case.rdd.getNumPartitions() == 16 * cores
    assert [tuple(r) for r in detect.pair_counts(contacts).collect()] == [("p", "q", 3, 1, 3.0, 1, 3)]


def test_family_words_stand_in_every_hit(spark):
    import re

    texts = [
        "Placed neatly on a shelf. small KEY found; key placed near the body, a Trophy, deliberately left", "dead  frequency, radio off air, transmitted then static only, tuned to a dead station, BACKUP frequency transmitted 3 seconds of dead air",
        "missing item, took a single mug, gap in the pegboard, only noticed the gap, first indication of taking", "found alone, often stayed late, working at night, no evidence of struggle, door was unlocked completely out of character",
        "county and separate; cross-jurisdiction, multi county", "interval growing, 3, 5, 9 days, time since prior case: 4 days", "former teacher, broadcast, filing, security", "records of access", "plain text", "\u0130nterval \u212aey longer", None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.family): r.matches for r in series.signature_families(docs).collect()}
    want = {(i, f): n for i, t in enumerate(texts) for f, (_, ps) in series.SIGNATURE_FAMILIES.items() if (n := sum(min(3, len(re.findall(f"(?ia){p}", t or ""))) for p in ps))}
    assert got == want and {f for _, f in got} == set(series.SIGNATURE_FAMILIES)
    assert all(len(series.FAMILY_WORDS[f]) == len(ps) for f, (_, ps) in series.SIGNATURE_FAMILIES.items())


def test_paths_of_long_flows_carry_no_cases(spark):
    rows = [(1, 2, "x"), (1, 2, "y"), (2, 3, "x"), (3, 4, None), (4, 1, "z"), (4, 1, "z"), (2, 5, "w"), (5, 5, "w")]
    flows = spark.createDataFrame(rows, "src int, dst int, case_id string")
    got = detect.long_circular_flows(flows)
    assert [(r.path, r.cases) for r in got.collect()] == [([1, 2, 3, 4], 3)]
    assert len(got.inputFiles()) > 0  # closed cycles are written before their cases are looked up
    assert detect.long_circular_flows(flows.where("src < 4")).collect() == []
