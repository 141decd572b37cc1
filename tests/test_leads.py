"""Paths, matches, correlated alerts and stored ingestion against brute force."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from caseweave import streaming
from caseweave.operators import decisions, incidents, matching, profiles, routes, tokens
from caseweave.plans.scratch import Scratch
from caseweave.sources import stored


def brute_routes(edges, start, goal, top=3, extra=3):
    arcs = {}
    for a, b, w in edges:
        if a != b and w is not None and w >= 0:
            for x, y in ((a, b), (b, a)):
                arcs.setdefault(x, {})[y] = min(w, arcs.get(x, {}).get(y, w))
    every = []

    def grow(path, weight):
        if path[-1] == goal:
            every.append((weight, list(path)))
            return
        for b, w in arcs.get(path[-1], {}).items():
            if b not in path:
                grow([*path, b], weight + w)

    grow([start], 0.0)
    if not every:
        return []
    cost, first = min(every, key=lambda x: (x[0], len(x[1]), x[1]))
    others = sorted(((w, p) for w, p in every if p != first and len(p) - 1 <= len(first) - 1 + extra), key=lambda x: (-x[0], x[1]))[: top - 1]
    return [(first, cost)] + [(p, w) for w, p in others]


@pytest.mark.parametrize("kind", ["sparse", "dense", "equal"])
def test_strongest_paths_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(routes, "FIRST_WAVE", 4)
    rnd = random.Random(kind)
    n, m = (12, 18) if kind == "sparse" else (7, 18)
    edges = [(rnd.randrange(n), rnd.randrange(n), 1.0 if kind == "equal" else float(rnd.randint(0, 20))) for _ in range(m)] + [(0, 0, 5.0), (0, n - 1, None), (3, 4, -1.0)]
    got = routes.strongest_paths(spark.createDataFrame(edges, "a int, b int, weight double"), 0, n - 1).orderBy("rank").collect()
    assert [(r.path, r.weight) for r in got] == brute_routes(edges, 0, n - 1)
    assert [r.hops for r in got] == [len(r.path) - 1 for r in got]


def test_paths_that_are_not_there(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0)], "a int, b int, weight double")
    assert routes.strongest_paths(e, 0, 3).collect() == [] and routes.strongest_paths(e, 0, 9).collect() == []
    assert [tuple(r) for r in routes.strongest_paths(e, 1, 1).collect()] == [(1, True, [1], 0, 0.0)]
    about = e.withColumnRenamed("weight", "w")
    assert [tuple(r) for r in routes.path_edges(routes.strongest_paths(e, 1, 0), about).collect()] == [(1, 1, 1, 0, 1.0)]


def lcs_ratio(a, b):
    a, b = (" ".join(sorted(x.lower().split())) for x in (a, b))
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b, 1):
            new.append(row[j - 1] + 1 if c == d else max(row[j], new[-1]))
        row = new
    return 2 * row[-1] / (len(a) + len(b))


@pytest.mark.parametrize("minimum", [0.6, 0.85])
def test_similar_names_equal_the_triangle(spark, minimum):
    rnd = random.Random(4)
    bases = ["jon smyth", "john smith", "anna maria berg", "li", "al", "xu wei", "mohammed al rashid", "muhamad rashid", "o", "kumar ravi"]
    names = set(bases)
    while len(names) < 300:
        x = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(x) + 1)
            x[k : k + rnd.randint(0, 1)] = rnd.choice(["", "a", "z", "Q", " ", "é"])
        name = " ".join("".join(x).split()).lower()
        names |= {name} if name else set()
    names = sorted(names)
    want = {(a, b): round(r, 6) for a, b in itertools.combinations(names, 2) if (r := lcs_ratio(a, b)) >= minimum - 1e-9}
    df = spark.createDataFrame([(x,) for x in [*names, names[0].upper(), None, " "]], "name string")
    got = {(r.a, r.b): round(r.ratio, 6) for r in matching.similar_names(df, minimum).collect()}
    assert got == want and len(want) > 100


def test_matches_need_evidence(spark):
    people = [
        (1, "Person", "Jon Smyth", None, 1, None, None), (2, "Person", "John Smith", None, 2, None, None), (3, "Person", "Smith", None, 1, None, None), (4, "Person", "smith", ["John Smith"], 1, None, None),
        (5, "Person", "John Smith", None, 3, None, None), (6, "Location", "John Smith", None, 2, None, None), (7, "Person", "John Smith", None, 2, None, 2), (8, "Person", "Zed Quorn", None, 2, None, None), (9, "Person", "Smith Jon", None, 1, True, None),
    ]
    entities = spark.createDataFrame(people, "entity_id int, entity_type string, name string, aliases array<string>, case_id int, partial_identity boolean, merged_into int")
    facts = spark.createDataFrame([(1, "phone", "9"), (2, "phone", "9"), (1, "father_name", "Peter Smith"), (2, "father_name", "Smith Petter"), (9, "phone", "9"), (9, "dob", "1"), (2, "dob", "1"), (5, "phone", None)], "entity_id int, kind string, value string")
    edges = spark.createDataFrame([(1, 20), (1, 21), (5, 20), (21, 5)], "src int, dst int")
    got = {(r.a, r.b): (r.signals, r.action, r.partial) for r in matching.candidate_matches(entities, facts, edges).collect()}
    assert got == {
        (1, 2): (["identical_father_name", "identical_phone"], "auto", False),
        (1, 5): (["shared_associates"], "review", False),
        (2, 9): (["identical_dob", "identical_phone"], "review", True),
    }
    assert matching.candidate_matches(entities, facts, edges, case_id=2).collect() == []
    assert matching.candidate_matches(entities.limit(0), facts, edges).collect() == []


def test_matches_of_a_large_group_make_no_pairs(spark, monkeypatch):
    n = 700  # the fathers' names differ in case only
    names = ["John Smith", "Jon Smith", "Joan Smyth"]
    entities = spark.createDataFrame([(i, "Person", names[i % 3], None, 1, None, None) for i in range(n)], "entity_id int, entity_type string, name string, aliases array<string>, case_id int, partial_identity boolean, merged_into int")
    facts = spark.createDataFrame([(0, "father_name", "Peter Smith"), (n - 3, "father_name", " peter SMITH")], "entity_id int, kind string, value string")
    sizes, write = [], Scratch.write

    def counted(self, df):
        out = write(self, df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    found = matching.candidate_matches(entities, facts, spark.createDataFrame([], "src int, dst int")).collect()
    assert max(sizes) <= 10 * n < n * (n - 1) // 2
    best = {(r.a, r.b): (r.n_signals, r["rank"]) for r in found}
    assert best[0, n - 3] == (2, 1)
    assert {b for a, b in best if a == 3} >= {6, 9, 12} and len({x for pair in best for x in pair}) == n


def test_correlation_equals_the_product(spark):
    rnd = random.Random(6)
    origin = dt.datetime(1969, 12, 30)
    time = lambda: origin + dt.timedelta(seconds=rnd.choice([rnd.randrange(40 * 86400), 3600 * rnd.randrange(900)]))
    events = [(rnd.randrange(4), i, time() if rnd.random() < 0.95 else None, f"l{i}") for i in range(120)] + [(None, 900, time(), "x")]
    events += [(1, 901 + i, origin, "same") for i in range(5)]
    windows = [(i, rnd.randrange(5), t, t + dt.timedelta(seconds=rnd.choice([-1, 0, 59, 60, 61, 86400 * rnd.randrange(9)]))) for i in range(150) for t in [time()]] + [(500, 1, origin, origin), (501, None, origin, origin), (502, 1, None, origin)]
    for days in (0, 3):
        slack = dt.timedelta(days=days)
        want = {}
        for i, case, first, last in windows:
            if case is not None and first is not None:
                hits = sorted((e, label) for c, e, t, label in events if c == case and t is not None and first - slack <= t <= last + slack)
                if hits:
                    want[i] = (*hits[0], len(hits))
        got = incidents.correlate(spark.createDataFrame(windows, "id int, case_id int, first_ts timestamp, last_ts timestamp"), spark.createDataFrame(events, "case_id int, event_id int, ts timestamp, label string"), days)
        assert {r.id: (r.event_id, r.label, r.n_events) for r in got.collect()} == want and len(want) > 5


def test_events_take_the_first_keyword_that_nothing_denies(spark):
    t = dt.datetime(2024, 1, 1)
    docs = spark.createDataFrame([(1, 7, t, "No arrest was made, and nobody was killed. Later, and in another part of the town altogether, a robbery."), (2, 7, t, "SHOOTING and arrest"), (3, 7, t, None), (4, 7, None, "arrest"), (5, 7, t, "calm")], "doc_id int, case_id int, ts timestamp, text string")
    assert {(r.event_id, r.keyword, r.label) for r in incidents.document_events(docs).collect()} == {(1, "robbery", "robbery"), (2, "arrest", "arrest")}


def test_bursts_without_prior_contact(spark):
    t = dt.datetime(2024, 1, 1)
    at = lambda a, b, *hours: [(a, b, t + dt.timedelta(hours=h)) for h in hours]
    rows = at(1, 2, 0, 5, 24) + at(2, 1, 3) + at(3, 4, 0, 100, 101, 102, 103) + at(5, 5, 0, 0, 0, 0) + [(6, 7, None)] * 9
    got = incidents.new_contact_bursts(spark.createDataFrame(rows, "src int, dst int, ts timestamp"), 24, 3)
    assert [(r.a, r.b, r.n, r.last_ts) for r in got.collect()] == [(1, 2, 4, t + dt.timedelta(hours=24))]


def test_a_failing_detector_leaves_the_others(spark):
    found = spark.createDataFrame([(1, 2, 5, "high"), (3, 4, 9, "low"), (3, 4, 9, "low")], "a int, b int, n int, severity string")
    alerts = lambda kind: incidents.assembled_alerts(found, kind, ["a", "b"], ["n", "severity"])
    raised = incidents.assembled_alerts(found.withColumn("n", F.raise_error(F.lit("broken input"))), "late", ["a", "b"], ["n"])
    rules = spark.createDataFrame([("off", False, 2.0), ("good", True, 4.0), ("good", True, 3.0)], "rule_type string, is_enabled boolean, threshold double")
    seen = []
    detectors = {"good": lambda t: seen.append(t) or alerts("good"), "late": lambda _: raised, "off": lambda _: 1 / 0, "early": lambda _: 1 / 0, "none": lambda t: seen.append(t) or alerts("none")}
    old = spark.createDataFrame([("none", "1 - 2")], "alert_type string, title string")
    out, failures = incidents.run_isolated(spark, detectors, rules, old)
    assert seen == [4.0, None]
    assert {(r.alert_type, r.title, r.evidence["n"]) for r in out.collect()} == {("good", "1 - 2", "5"), ("good", "3 - 4", "9"), ("none", "3 - 4", "9")} and out.count() == 3
    assert {r.detector for r in failures.collect()} == {"late", "early"}
    none, failures = incidents.run_isolated(spark, {}, rules)
    assert none.collect() == [] and failures.collect() == []


def files_of(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_stored_upsert_rewrites_what_changes(spark, tmp_path):
    schema = "case_id long, entity_type string, name string, attributes map<string,string>, confidence double, seq long"
    path = tmp_path / "entities"
    first = [(1, "Person", "A", {"phone": "1", "dob": "x"}, 0.5, 1), (1, "Person", "A", {"phone": "2"}, None, 2), (2, "Person", "B", None, 0.9, 1), (3, "Person", None, {"k": None}, 0.1, 1)]
    stored.upsert_stored_entities(str(path), spark.createDataFrame(first, schema), parts=8)
    before = files_of(path)
    later = spark.createDataFrame([(1, "Person", "A", {"dob": "y", "age": "9"}, 0.7, 1), (4, "Person", "D", {}, 0.2, 1)], schema)
    changed = stored.upsert_stored_entities(str(path), later, parts=8)
    after = files_of(path)
    assert {f for f in before if f in after and f"part={changed[0]}" not in f and f"part={changed[-1]}" not in f} == {f for f in before if all(f"part={p}/" not in f for p in changed)}
    assert stored.upsert_stored_entities(str(path), later, parts=8) == [] and files_of(path) == after
    got = {(r.case_id, r.name): (r.attributes, r.confidence) for r in stored.read_stored(spark, str(path)).collect()}
    assert got == {(1, "A"): ({"age": "9", "dob": "y", "phone": "2"}, 0.7), (2, "B"): ({}, 0.9), (3, None): ({}, 0.1), (4, "D"): ({}, 0.2)}
    assert stored.read_stored(spark, str(tmp_path / "nothing")).collect() == []


def test_stored_edges_keep_weight_and_first_justification(spark, tmp_path):
    schema = "case_id long, src string, dst string, rel_type string, weight double, justification string, seq long"
    path = str(tmp_path / "edges")
    stored.upsert_stored_edges(path, spark.createDataFrame([(1, "b", "a", "T", 2.0, " ", 1), (1, "a", "b", "T", 1.0, "seen", 2), (1, "a", "b", "T", 1.0, "later", 3), (1, "a", None, "T", 1.0, "x", 1)], schema), parts=4)
    stored.upsert_stored_edges(path, spark.createDataFrame([(1, "a", "b", "T", 5.0, "earlier seq, later batch", 0), (1, "a", "b", "U", None, None, 1)], schema), parts=4)
    got = sorted((r.a, r.b, r.rel_type, r.weight, r.justification) for r in stored.read_stored(spark, path, stored.EDGE).collect())
    assert got == [("a", "b", "T", 5.0, "seen"), ("a", "b", "U", None, None)]


def test_bad_rows_are_counted_and_kept_apart(spark, tmp_path):
    rows = spark.createDataFrame([("1.5", "x", "p"), ("n/a", "y", "q"), (" ", None, "r"), ("2", "", None)], "amount string, sender string, receiver string")
    got = stored.ingest(rows, {"amount": "double"}, ["sender", "receiver"], str(tmp_path / "job"), "j").first()
    assert tuple(got) == ("j", 4, 3, 1, 1, "completed with errors")
    assert [tuple(e) for r in spark.read.parquet(str(tmp_path / "job/errors")).collect() for e in r.errors] == [("amount", "n/a")]
    assert sorted(str(r.amount) for r in spark.read.parquet(str(tmp_path / "job/rows")).collect()) == ["1.5", "2.0", "None"]
    assert stored.ingest(rows.limit(0), {"amount": "double"}, [], str(tmp_path / "none"), "e").first().status == "completed"
    assert stored.ingest(rows, {"other": "int"}, [], str(tmp_path / "no"), "f").first().status == "failed" and not (tmp_path / "no").exists()
    assert {tuple(r) for r in stored.validation_report(rows, {"amount": "double", "other": "int"}).collect()} == {("other", "missing", 0, None), ("amount", "not double", 1, "n/a")}


def test_splits_undo_merges(spark):
    log = [(1, "merge", 1, 2), (2, "merge", 2, 3), (3, "merge", 7, 8), (4, "split", 2, 1), (5, "merge", 9, 7), (6, "split", 9, 9), (7, "note", 1, 3), (8, "merge", None, 3), (9, "merge", 4, 3), (10, "split", 3, 4)]
    df = spark.createDataFrame(log, "seq int, action string, primary int, secondary int")
    state = lambda d: {r.entity_id: r.survivor for r in d.collect()}
    assert state(decisions.replay(df, 3)) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert state(decisions.replay(df)) == {2: 2, 3: 2, 7: 9, 8: 9, 9: 9} == state(decisions.replay(df.where("seq IN (2, 3, 5)")))
    for since in (0, 2, 4, 9):
        assert state(decisions.resume(decisions.replay(df, since), df, since)) == state(decisions.replay(df))
    facts = spark.createDataFrame([(7, "phone", "1"), (8, "phone", "0"), (8, "dob", "d"), (9, "age", None), (5, "phone", "5")], "entity_id int, kind string, value string")
    got = {r.entity_id: r.attributes for r in decisions.merged_attributes(facts, decisions.replay(df)).collect()}
    assert got == {9: {"phone": "1", "dob": "d"}, 5: {"phone": "5"}}


def test_cross_case_alerts_exactly_once(spark, tmp_path):
    people = "entity_type string, name string, case_id int"
    spark.createDataFrame([("Person", "A", 1), ("Person", "B", 1), ("Person", "A", 1)], people).write.parquet(str(tmp_path / "known"))
    out = str(tmp_path / "alerts")
    sink = streaming.cross_case_sink(str(tmp_path / "known"), out)
    batches = [[("Person", "A", 2), ("Person", "C", 5), ("Person", None, 2)], [("Person", "A", 3), ("Person", "D", 1), ("Person", "D", 2), ("Person", "B", 1)], []]
    for _ in range(2):  # the second time as after a crash
        for epoch, rows in enumerate(batches):
            sink(spark.createDataFrame(rows, people), epoch)
        got = sorted((r.epoch, r.title, r.cases) for r in spark.read.parquet(out).collect())
        assert got == [(0, "Person: A", 2), (1, "Person: D", 2)]


def test_streams_drop_late_rows_and_repeats(spark, tmp_path):
    at = lambda h, day=1: dt.datetime(2024, 1, day, h)
    schema = "src int, dst int, number string, row_hash string, ts timestamp"
    (tmp_path / "in").mkdir()
    files = [[(1, 2, "n", "h1", at(1)), (2, 1, "n", "h1", at(1)), (1, 2, "n", "h2", at(2))], [(1, 2, "n", "h3", at(1, 20))], [(1, 2, "n", "h5", at(2, 20))], [(1, 2, "n", "h4", at(3))], [(8, 9, "z", "h9", at(1, 30))]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    runs = {"windows": lambda s: streaming.contact_windows(s, 2), "repeats": lambda s: streaming.without_repeats(s).select("row_hash"), "sessions": lambda s: streaming.number_sessions(s.select("number", "ts"))}
    found = {}
    for name, run in runs.items():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
        rows = []
        q = run(stream).writeStream.foreachBatch(lambda b, _, rows=rows: rows.extend(b.collect())).option("checkpointLocation", str(tmp_path / f"cp-{name}")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        found[name] = rows
    assert sorted(r.row_hash for r in found["repeats"]) == ["h1", "h2", "h3", "h5", "h9"]  # h1 once, and h4 came too late
    assert max(r.n for r in found["windows"] if r.start < at(0, 10)) == 3
    assert (at(1), 3) in {(r.start, r.n) for r in found["sessions"]}


def test_candidates_and_compatibility_forms(spark):
    import unicodedata

    rows = [("Radio", "PERSON", "a man called as radio"), ("radio", "PERSON", "called in by radio"), ("hundred", "PERSON", ""), ("Al", "ORG", ""), ("x", "PERSON", "alias x")]
    df = spark.createDataFrame(rows, "name string, kind string, text string")
    got = [(r.v.genuine, r.v.confidence) for r in df.select(tokens.candidate_verdict(F.col("name"), F.col("kind"), F.col("text")).alias("v")).collect()]
    assert got == [(True, 75), (False, 85), (False, 95), (True, 60), (False, 80)]
    soft = df.select(tokens.candidate_verdict(F.col("name"), F.col("kind"), F.col("text"), hard=False).alias("v")).collect()[2].v
    assert (soft.genuine, soft.confidence) == (True, 60)
    texts = ["Éléonore Ångström:", "ﬁle ＡＢＣ１２", "½ № ™", "plain text!", "東京 한", "ẞ ǆ ﬃ", ""]
    names = spark.createDataFrame([(t,) for t in texts] + [(None,)], "name string")
    forms = [r[0] for r in names.select(tokens.compatibility_form(F.col("name"))).collect()]
    assert forms == [unicodedata.normalize("NFKD", t) if t != "東京 한" else t for t in texts] + [None]
    assert names.select(tokens.plain_key(F.col("name"))).first()[0] == unicodedata.normalize("NFKD", "éléonore ångström")


def test_profiles_keep_evidence(spark):
    people = [(1, 1, " Anil ", None, 9, {"dob": "1"}, 0.5, None), (2, 2, "anil", ["Kalu", "Anil"], None, {"dob": "2", "phone": None}, 0.9, None), (3, 2, None, None, 1, None, 0.9, None), (4, 1, "ANIL", ["Kalu"], 3, None, 0.9, None), (5, 1, "Anil", ["gone"], 3, None, 1.0, 2)]
    df = spark.createDataFrame(people, "entity_id int, case_id int, name string, aliases array<string>, document_id int, attributes map<string,string>, confidence double, merged_into int")
    (r,) = profiles.entity_profiles(df).collect()
    assert (r.norm, r.canonical_id, r.record_count, r.cases, r.documents, r.first_documents) == ("anil", 2, 3, 2, 2, [3, 9])
    assert r.aliases == ["Anil", "Kalu", "ANIL"] and r.attributes == {"dob": "2"} and not r.unconfirmed
    edges = [("a", "b", "Family", 1, 7, None, 0.5, True, None, None), ("b", "a", "Ownership", 2, None, "deed", 0.9, None, 1.0, 2.0), ("a", "a", "Family", 1, 1, "x", 1.0, False, None, 1.0), ("a", "b", "Family", None, None, " ", None, True, None, 0.0)]
    schema = "src string, dst string, rel_type string, case_id int, document_id int, justification string, confidence double, is_ai boolean, severity double, weight double"
    (e,) = profiles.edge_profiles(spark.createDataFrame(edges, schema)).collect()
    assert (e.n, e.cases, e.primary_type, e.ai_only, e.confidence) == (3, 2, "Ownership", False, 0.9)
    assert {k: round(v, 9) for k, v in e.types.items()} == {"Family": 0.8, "Ownership": 2.16} and [x.justification for x in e.evidence] == ["deed", None]
    assert profiles.entity_profiles(df.limit(0)).collect() == [] and profiles.edge_profiles(spark.createDataFrame([], schema)).collect() == []


def test_connectivity_and_bridges(spark):
    nodes = spark.createDataFrame([(1, "A"), (2, "B"), (3, "a "), (4, None), (5, None)], "node int, name string")
    edges = spark.createDataFrame([(1, 2), (2, 1), (4, 4), (3, 99), (4, 5)], "a int, b int")
    assert tuple(profiles.connectivity_report(nodes, edges).first()) == (False, 3, 2, 1, 5, 2, 1)
    assert tuple(profiles.connectivity_report(nodes.limit(0), edges).first()) == (True, 0, 0, 0, 0, 0, 0)
    labels = spark.createDataFrame([(1, 1), (2, 2), (4, 1), (5, 1)], "node int, community int")
    own, on_edges = spark.createDataFrame([(1, 7), (2, None)], "node int, case_id int"), spark.createDataFrame([(2, 1, 8)], "a int, b int, case_id int")
    got = {r.node: (r.outside, r.cases, r.cross_case) for r in profiles.case_bridges(edges.where("a = 1"), labels, own, on_edges).collect()}
    assert got == {1: (1, 2, True), 2: (1, 1, False)}


def test_contacts_are_read_once_and_few_events_make_no_blocks(spark, monkeypatch):
    def blocks(*_):
        raise AssertionError("a case of one event needs no blocks")

    monkeypatch.setattr(incidents, "_blocks", blocks)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [("p", "q", 1, day(0), 2.0), ("q", "p", 1, day(50), 4.0), ("p", "q", 2, day(90), None), ("p", "r", 1, day(1), 1.0), ("p", "p", 1, day(1), 1.0)]
    contacts = spark.createDataFrame(rows, "src string, dst string, case_id long, ts timestamp, weight double")
    events = spark.createDataFrame([(1, 7, day(20), "arrest"), (2, 3, day(200), "raid")], "case_id long, event_id long, ts timestamp, label string")
    (got,) = incidents.correlated_bursts(contacts, events).collect()
    assert (got.a, got.b, got.n, got.cases, got.avg_weight, got.event_id, got.event_label) == ("p", "q", 3, 2, 3.0, 7, "arrest")
    numbers = spark.createDataFrame([("q",), ("r",)], "number string")
    assert {(r.number, r.n, r.days, r.event_id) for r in incidents.burner_numbers(contacts, numbers, events).collect()} == {("q", 3, 90, 7), ("r", 1, 0, None)}
    # both forms give the same
    monkeypatch.undo()
    windows = spark.createDataFrame([("w", 1, day(0), day(4)), ("v", 2, day(300), day(301))], "id string, case_id long, first_ts timestamp, last_ts timestamp")
    plain = sorted(incidents.correlate(windows, events).collect())
    many = events.union(spark.createDataFrame([(1, 100 + i, day(30 + i), "late") for i in range(40)], events.schema))
    assert sorted(incidents.correlate(windows, many).collect()) == plain == []
    wide = windows.withColumn("last_ts", F.col("last_ts") + F.expr("INTERVAL 40 DAYS"))
    assert [tuple(r) for r in incidents.correlate(wide, many).collect()] == [("w", 1, 7, "arrest", 19)]
