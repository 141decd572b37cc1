"""Registered queries against the same queries in SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from caseweave import catalog

DATA = "/root/testdata/sf0.001"


def compare(spark, name, queries, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    got, want = queries[name](spark, DATA).toPandas(), con.sql(sql[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    def cell(v):
        if v is None:
            return "None"
        if hasattr(v, "__len__") and not isinstance(v, (str, bytes, dict)):
            return str([cell(x) for x in v])
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return "None" if v != v else f"{float(v):.6f}"
        return str(v)

    clean = lambda d: sorted(tuple(cell(v) for v in r) for r in d[sorted(d.columns)].astype(object).where(d.notna(), None).itertuples(index=False))
    assert clean(got) == clean(want)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, name):
    compare(spark, name, catalog.QUERIES, catalog.SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_run_all_counts_every_detector(spark):
    single = {
        "burst": "det1_communication_burst", "circular_flow": "det2_circular_flow", "repeated_transfer": "det3_repeated_transfers", "directional_funding": "det4_directional_funding", "cross_case_name": "det5_cross_case_names",
        "co_location": "det6_co_location", "short_lived_number": "det7_short_lived_number", "rolling_burst": "win9_rolling_burst", "long_circular_flow": "det12_long_circular_flows",
    }
    got = {}
    for r in catalog.QUERIES["det8_run_all"](spark, DATA).collect():
        got[r.alert_type] = got.get(r.alert_type, 0) + r.n
    assert got == {t: n for t, q in single.items() if (n := catalog.QUERIES[q](spark, DATA).count())}
    assert len(got) > 5


def test_graph_queries_reach_every_entity(spark):
    nodes = {r.node for r in catalog.QUERIES["gra2_degree_centrality"](spark, DATA).collect()}
    for name in ("gra3_betweenness", "gra4_eigenvector", "gra6_communities", "gra13_importance"):
        assert {r.node for r in catalog.QUERIES[name](spark, DATA).collect()} == nodes
    edges = {frozenset((r.a, r.b)) for r in catalog.QUERIES["agg2_edge_roll_up"](spark, DATA).collect()}
    low, high = min(nodes), max(nodes)
    grow = lambda path: [path] if path[-1] == high else [p for n in nodes if len(path) < 5 and n not in path and frozenset((path[-1], n)) in edges for p in grow([*path, n])]
    assert sorted(r.path for r in catalog.QUERIES["gra9_entity_paths"](spark, DATA).collect()) == sorted("-".join(map(str, p)) for p in grow([low]))
