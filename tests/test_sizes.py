"""Steps that grew faster than their input, or met it anew: what they read, move and give."""

import random

from codeloom.operators import graph, intervals, php
from codeloom.plans import staging
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_levels_are_exact(spark):
    lengths = sorted({max(1, 4**k + d) for k in range(1, 20) for d in (-1, 0, 1)} | set(range(1, 70)))
    got = {r["n"]: r["k"] for r in spark.createDataFrame([(n,) for n in lengths], "n long").select("n", intervals._level(F.col("n")).alias("k")).collect()}
    assert got == {n: next(k for k in range(40) if 4**k >= n) for n in lengths}


def test_points_meet_scopes_once(spark):
    rng = random.Random(1)
    points = spark.createDataFrame([(rng.choice("ab"), rng.randrange(60)) for _ in range(80)], "key string, at long")
    scopes = spark.createDataFrame([(k, s, s + rng.choice([-1, 0, 3, 17, 40]), i) for i, (k, s) in enumerate((rng.choice("ac"), rng.randrange(60)) for _ in range(40))], "key string, start long, end long, name long")
    found = intervals.first_scope(points, scopes, ["key"], "at", "start", "end", ["start", "name"])
    have = [tuple(r) for r in scopes.collect()]
    assert plan(found).count("Join") == 1
    want = [(k, at, min(((s, n) for c, s, e, n in have if c == k and s <= at <= e), default=(None, None))[1]) for k, at in map(tuple, points.collect())]
    key = lambda r: (r[0], r[1], str(r[2]))
    assert sorted([(r["key"], r["at"], r["scope"]["name"] if r["scope"] else None) for r in found.collect()], key=key) == sorted(want, key=key)
    empty = intervals.first_scope(points, scopes.limit(0), ["key"], "at", "start", "end", ["start"])
    assert empty.count() == 80 and empty.where("scope is not null").count() == 0


def test_files_are_scanned_once(spark):
    from codeloom.sources.php import php_marks

    scanned = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            scanned.add(len(b))
            yield b

    files = spark.createDataFrame([("app/A.php", "<?php\nclass A {\n  public function f(B $b) {\n    Cache::put(1);\n  }\n}")], "path string, content string").mapInPandas(seen, "path string, content string")
    found = php.php_relations(php_marks(files), files.select("path")).collect()
    assert {(r["type"], r["source"], r["target"]) for r in found} == {("WRITES", "A.f", "Cache"), ("USES", "A.f", "B")}
    assert scanned.value <= 2  # the marks, and the paths


def test_neighbours_of_few_paths_move_no_edges(spark, monkeypatch):
    nodes = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("d", None)], "id string, file_path string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d")], "source_id string, target_id string")
    paths = spark.createDataFrame([("x",), (None,)], "path string")
    kept, written = graph.staged, []
    monkeypatch.setattr(graph, "staged", lambda df, name: (written.append(plan(df)) if name == "ends" else None, kept(df, name))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(r["path"] for r in graph.neighbour_paths(nodes, edges, paths).collect()) == ["x", "y"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in written[0] and "SortMergeJoin" not in written[0]
    monkeypatch.setattr(staging, "FEW", 0)
    assert sorted(r["path"] for r in graph.neighbour_paths(nodes, edges, paths).collect()) == ["x", "y"]


def test_texts_of_a_language_stay_where_they_are(spark, tmp_path):
    from codeloom.queries import QUERIES

    spark.createDataFrame([(3, "en", "alpha beta gamma"), (1, "en", "alpha beta delta"), (2, "de", "eins"), (4, None, "x")], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = QUERIES["x17_near_duplicates"](spark, str(tmp_path))
        assert {r["doc_id"]: r["near"] for r in found.collect()} == {1: True, 2: True, 3: False}
        assert "SortMergeJoin" not in plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_near_duplicates_write_no_pairs(spark, monkeypatch):
    from codeloom.operators import alike, refresh
    from test_states import plain_merge

    rng = random.Random(8)
    pool = [f"word{i}" for i in range(60)]
    facts = [(i, rng.choice(["a", "a", "b"]), " ".join(rng.sample(pool[:10], 9) if i % 2 else rng.choices(pool, k=rng.choice([1, 3, 12, 30]))), [f"p{i % 7}"], rng.choice([1, 2, 3, None]) or 0) for i in range(300)]
    written = []
    for module in (refresh, alike):
        monkeypatch.setattr(module, "staged", lambda df, name, kept=module.staged: (written.append((read := kept(df, name)).count()), read)[1])
    monkeypatch.setattr(alike, "ROWS", 60)
    monkeypatch.setattr(alike, "INDEXED", 16)
    monkeypatch.setattr(alike, "HELD", 1000)
    got = refresh.merge_near_duplicates(spark.createDataFrame(facts, "id int, category string, statement string, paths array<string>, ord int"))
    assert {r["id"]: r["paths"] for r in got.collect()} == plain_merge(facts)
    assert max(written) <= len(facts)


def test_tasks_around_nodes_stay_small(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"n{i}", "order" if i % 3 else "part") for i in range(40)], "id string, kind string")
    links = [(f"n{i}", f"n{i * 7 % 45}", "USES" if i % 2 else "DECLARES") for i in range(40)]
    edges = spark.createDataFrame(links + links[:9], "source_id string, target_id string, type string")
    starts = {f"n{i}" for i in range(40) if i % 3}
    want = sorted((starts | {b for a, b, kind in links if a in starts and kind == "USES"}) & {f"n{i}" for i in range(40)})
    for rows in (staging.DEALT, 2):
        monkeypatch.setattr(staging, "DEALT", rows)
        found = graph.entry_set(nodes, edges, "order")
        assert sorted(r["id"] for r in found.collect()) == want
    assert "REPARTITION_BY_NUM" in plan(found)


def test_invalidation_counts_repeated_edges_once(spark, monkeypatch):
    from codeloom.operators import refresh

    changed = spark.createDataFrame([("x",), ("x",), (None,)], "path string")
    symbols = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "symbol_id int, path string")
    nodes = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("d", None)], "id string, file_path string")
    edges = spark.createDataFrame([("b", "c"), ("b", "c"), ("c", "d"), ("a", "b"), ("b", "a"), ("c", "e")], "source_id string, target_id string")
    for rows in (staging.DEALT, 1):
        monkeypatch.setattr(staging, "DEALT", rows)
        for repeats, kept in ((True, 3), (False, 4)):
            assert tuple(refresh.invalidation(changed, symbols, nodes, edges, repeats=repeats).first()) == (1, 1, 3, kept, "partial-invalidation")
