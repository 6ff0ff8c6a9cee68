"""Queries that answer for every start or query against SQL and brute force."""

import os

import pytest

from codeloom.queries import ORACLES, QUERIES
from tests.test_library import DATA, TABLES


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the standard tables")
@pytest.mark.parametrize("name", ["t1_vector_top_set", "t2_vector_top_roles_set", "t3_hybrid_search_set", "t4_semantic_seeds_set"])
def test_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = db.sql(ORACLES[name])
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [[r[c] for c in columns] for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(repr([r[want.columns.index(c)] for c in columns]) for r in want.fetchall())
    assert {r[columns.index("query_id")] for r in rows} == {x for (x,) in db.sql("SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0").fetchall()}


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = {
        "region": ("r_regionkey int, r_name string", [(0, "R")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0), (1, "M", 0)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int", [(i, f"C{i}", i % 2) for i in range(1, 4)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(1, "S1", 0), (2, "S2", 1)]),
        "part": ("p_partkey long, p_name string", [(i, f"P{i}") for i in range(1, 5)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string", [(i, 1 + i % 3, "FOP"[i % 3], "5-LOW") for i in range(1, 10)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long", [(i, 1 + (i + k) % 4, 1 + (i + k) % 2) for i in range(1, 9) for k in range(1 + i % 3)]),
    }
    for name, (ddl, data) in rows.items():
        spark.createDataFrame(data, ddl).write.parquet(f"{d}/{name}.parquet")
    return d


def reach(spark, d, most):
    from codeloom.queries import graph_edges

    edges = [(r["source_id"], r["target_id"]) for r in graph_edges(spark, d).collect()]
    out = set()
    for start in (f"o{i}" for i in range(1, 10)):
        seen, now = {start: 0}, {start}
        for depth in range(1, most + 1):
            now = {b for a, b in edges if a in now} - set(seen)
            seen |= dict.fromkeys(now, depth)
        out |= {(start, x, n) for x, n in seen.items()}
    return out


def test_reachability_starts_from_all_orders(spark, small_tables):
    got = [tuple(r) for r in QUERIES["g2_reachability"](spark, small_tables).select("start_id", "id", "depth").collect()]
    assert len(got) == len(set(got)) and set(got) == reach(spark, small_tables, 4)


def test_fan_in_counts_all_orders(spark, small_tables):
    want = {}
    for _, x, _ in reach(spark, small_tables, 3):
        if x[0] == "s":
            want[x] = want.get(x, 0) + 1
    assert {r["id"]: r["n_starts"] for r in QUERIES["a7_fan_in"](spark, small_tables).collect()} == want
