"""Token gates, readers, reports and pair contexts on small rows worked out by hand."""

from pyspark.sql import functions as F

from caseweave import sources
from caseweave.operators import context, tokens, views


def test_entity_types_and_gate(spark):
    want = {
        "Vikram Solanki": "PERSON", "Telegram": None, "neft": None, "amount_inr": None, "TOWER_ID": None, "Call Detail Records": None, "+91-98765 43210": "PHONE_NUMBER", "mh-12-AB-1234": "VEHICLE", "FIR 221/2024": None, "FIR 22/24": "CASE_REFERENCE",
        "ravi@okbank": "FINANCIAL_ACCOUNT", "123456789012345678": "FINANCIAL_ACCOUNT", "the old grain market": "LOCATION", "FINANCIAL TRANSACTION": None, "five little words in a row": None, " Élan Vital ": "PERSON", "": None,
    }
    df = spark.createDataFrame([(k, None) for k in want] + [(None, None), ("blue star", "ORG"), ("telegram", "ORG")], "name string, label string")
    got = {r[0]: r[1] for r in df.select("name", tokens.entity_type(F.col("name"), F.col("label"))).collect()}
    assert got == want | {None: None, "blue star": "ORGANIZATION", "telegram": None}
    rows = [("Vikram Solanki", "PERSON"), ("Tower Legend Tower", "PERSON"), ("Whatsapp!", "PERSON"), ("cellTower", "LOCATION"), ("Goa", "DATE"), (None, "PERSON"), ("FRAUD", "ORGANIZATION")]
    admitted, review = tokens.gate(spark.createDataFrame(rows, "name string, entity_type string"))
    assert [r.name for r in admitted.collect()] == ["Vikram Solanki"]
    assert {r.name: r.gate_reason for r in review.collect()} == {"Tower Legend Tower": "malformed", "Whatsapp!": "excluded word", "cellTower": "schema word", "Goa": "type", None: "malformed", "FRAUD": "excluded word"}
    named = spark.createDataFrame([("Ravi",), ("Ravi K",), ("cash",), (" ",), (None,)], "name string")
    assert [r[0] for r in named.select(tokens.name_verdict(F.col("name"), F.lit("PERSON"))).collect()] == ["partial", "ok", "excluded", "empty", "empty"]
    assert tokens.gate(df.limit(0).withColumn("entity_type", F.lit("PERSON")))[1].count() == 0


def test_headings_and_table_rows(spark):
    text = spark.createDataFrame([("Background:\nHe ran.\nNOTES\nmore\nLAST\n\nRAVI",), ("",), (None,)], "text string")
    assert [r[0] for r in text.select(tokens.without_headings(F.col("text"), tokens.SECTIONS)).collect()] == ["He ran.\nmore\nLAST\n\nRAVI", "", None]
    cells = spark.createDataFrame([(["Name", "", "Amount"], [" Anil ", "x", "5", "over"]), (["Amount"], ["5"])], "h array<string>, c array<string>")
    assert [r[0] for r in cells.select(tokens.table_row(F.col("h"), F.col("c"), ["name"])).collect()] == ["Anil | x | over", None]


def test_pair_context(spark):
    far = "key found on the shelf. " + "z " * 90 + "body."
    cases = spark.createDataFrame([(1, "A brass key was placed neatly near the body, and a rope was found there.", None), (2, "The metal key lay beside the victim; a cord and a knife were found too.", None), (3, "short", None), (4, far, None)], "case_id int, text string, day date")
    signs = {r.case_id: r.s_object_placement for r in context.pair_signs(cases).collect()}
    assert signs == {1: ["deliberate", "brass_key"], 2: ["brass_key"], 3: [], 4: []}
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a int, b int")
    got = {r.b: r for r in context.analyse_pairs(pairs, cases).collect()}
    # signs: 1/2 of one of six families; methods: 1/2 of one of three kinds
    assert set(got) == {2, 4} and got[2].score == int((0.5 / 6 * 0.45 + 0.5 / 3 * 0.30 + 0.1) * 100) and got[2].behaviours == ["object placement"] and got[4].score == 0
    assert got[2].signature == "weak" and got[2].surface_words == []


def test_texts_of_one_file_are_dealt(spark, monkeypatch):
    written, write = [], context.Scratch.write
    monkeypatch.setattr(context.Scratch, "write", lambda self, df: (written.append(df), write(self, df))[1])
    cases = spark.createDataFrame([(i, "A brass key was placed neatly near the body, and a rope was found there.", None) for i in range(40)], "case_id int, text string, day date").coalesce(1)
    pairs = spark.createDataFrame([(0, 1)], "a int, b int")
    found = context.pair_verdicts(pairs, cases, pairs.where("a > 0").withColumn("score", F.lit(1)))
    share = 1 / 6 * 0.45 + 1 / 3 * 0.30 + 0.1
    assert [(r.score, r.backend) for r in found.collect()] == [(int(share * 100), "heuristic")]
    assert written[0].rdd.getNumPartitions() > 1 and written[0].columns == ["case_id", "day", "marks"]


def test_briefs_shuffle_edges_twice(spark):
    entities = spark.createDataFrame([(i, f"n{i}", "Person", 0.9, False) for i in range(4)], "entity_id int, name string, entity_type string, confidence double, unresolved boolean")
    edges = spark.createDataFrame([(0, i, "Associate", i, i == 3, 0.5) for i in (1, 2, 3, 9)] + [(0, 0, "Family", 1, False, 0.9)], "src int, dst int, rel_type string, case_id int, is_ai boolean, confidence double")
    out = views.entity_briefs(entities, edges, most=2)
    got = {r.entity_id: r for r in out.collect()}
    assert (got[0].connections, got[0].confirmed, got[0].inferred, got[0].cases, got[0].weak_threads) == (4, 3, 1, 3, 3)
    assert got[0].first_confirmed == "Associate: n1; Associate: n2" and got[0].first_inferred == "Associate: n3" and got[3].first_inferred == "Associate: n0"
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") <= 4


def test_readers_and_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"caf\xc3\xa9 \xff end\nline two")
    (tmp_path / "in" / "b.bin").write_bytes(b"no")
    (tmp_path / "cases.json").write_text('{"cases": [{"case_id": 1, "state": "Goa"},\n {"case_id": 2}]}')
    assert [r.text for r in sources.read_documents(spark, str(tmp_path / "in")).collect()] == ["café � end\nline two"]
    assert sorted((r.case_id, r.state) for r in sources.read_case_records(spark, str(tmp_path / "cases.json")).collect()) == [(1, "Goa"), (2, None)]
    cases = spark.createDataFrame([(1, "River"), (2, "Hill")], "case_id long, name string")
    who = spark.createDataFrame([(1, 7, "Anil", "Person", 0.5), (9, 8, "Nobody", "Person", 0.5)], "case_id long, entity_id long, name string, entity_type string, confidence double")
    links = spark.createDataFrame([(1, 3, 7, 8, "Associate")], "case_id long, edge_id long, src long, dst long, rel_type string")
    found = spark.createDataFrame([(1, 5, "high", "burst", "New")], "case_id long, alert_id long, severity string, alert_type string, status string")
    out = str(tmp_path / "out")
    views.write_reports(views.report_lines(cases, who, links, found), out)
    lines = [x for f in sorted((tmp_path / "out" / "case_id=1").glob("*.txt")) for x in f.read_text().splitlines()]
    assert lines == ["Case 1: River", "Anil (Person), confidence 0.50", "7 -> 8 [Associate]", "HIGH: burst (New)"]
    views.export(cases, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
