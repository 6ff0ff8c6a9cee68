"""Sources, streams and the SQL twins on the smallest tables."""

import os
import tempfile

import pytest

from codeloom.queries import ORACLES, QUERIES
from codeloom.sources import code, files
from codeloom.streaming import telemetry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the standard tables")
@pytest.mark.parametrize("name", ["t3_hybrid_search", "j5_typed_neighbors", "g1_traverse", "j14_snapshot_diff", "a14_merge_facts", "x11_route_keys", "a11_usage_rollup"])
def test_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = db.sql(ORACLES[name])
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[want.columns.index(c)] for c in columns]) for r in want.fetchall())


def test_stream_equals_batch(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = [(i, f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", "view" if i % 2 else "click", float(i)) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value")
    events.write.parquet(f"{folder}/events")
    stream = telemetry.event_stream(spark, f"{folder}/events", events.schema)
    got = telemetry.run_to_end(telemetry.daily_usage(stream), "usage", f"{folder}/c1", "complete").collect()
    assert sorted(got) == sorted(telemetry.daily_usage(events).collect())
    seen = telemetry.run_to_end(telemetry.first_seen(stream, ["event_type"], "10 days").select("event_type"), "seen", f"{folder}/c2").collect()
    assert sorted(r[0] for r in seen) == ["click", "view"]


def test_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    for path, content in {"a.ts": "export class A extends B {\n  go() {\n  }\n}", "node_modules/x.ts": "x", "b.md": "# T\ntext\n### U v", "c.json": '{"k": 1, "m": {}}', "d.json": "[1", "e.bin": "?"}.items():
        os.makedirs(os.path.dirname(f"{folder}/{path}"), exist_ok=True)
        with open(f"{folder}/{path}", "w") as f:
            f.write(content)
    tree = files.read_tree(spark, folder)
    assert sorted(r["path"] for r in tree.collect()) == ["a.ts", "b.md", "c.json", "d.json"]
    assert [(r["line"], r["level"], r["title"]) for r in files.headings(tree.where("language = 'markdown'")).orderBy("line").collect()] == [(1, 1, "T"), (3, 3, "U v")]
    assert sorted(r["key"] for r in files.json_keys(tree.where("language = 'json'")).collect()) == ["k", "m"]
    assert {(r["kind"], r["name"], r["container"], r["target"]) for r in code.symbols(tree.where("language = 'typescript'")).collect()} == {("class", "A", None, None), ("extends", "A", None, "B"), ("method", "go", "A", None)}


def test_status_rows(spark):
    lines = spark.createDataFrame([("M  a.ts",), ("R  old.ts -> new.ts",), ("?? n.ts",), ("AM b.ts",)], "line string")
    got = {(r["path"], r["previous_path"], r["scope"], r["type"]) for r in files.status_rows(lines).collect()}
    assert got == {("a.ts", None, "staged", "modified"), ("new.ts", "old.ts", "staged", "renamed"), ("n.ts", None, "untracked", "added"), ("b.ts", None, "staged", "added"), ("b.ts", None, "unstaged", "modified")}


def test_routes_and_calls():
    routes = code.scan_routes("Route::prefix('api')->middleware('auth')->group(function () {\n  Route::get('/u/{id}',\n    [UserController::class, 'show']);\n});\nRoute::post('x', 'C@m');")
    assert list(routes) == [("route", "GET /api/u/:param", 2, None, "UserController@show"), ("uses", "GET /api/u/:param", 2, None, "auth"), ("route", "POST /x", 5, None, "C@m")]
    calls = [s[1] for s in code.scan_script("http.get(`/api/u/${id}`);\nfetch('/x', {method: 'post'});\nfetch('no');") if s[0] == "http-call"]
    assert calls == ["GET /api/u/:param", "POST /x"]
