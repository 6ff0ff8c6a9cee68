"""Candidates and evidence on small frames."""

from pyspark.sql import functions as F

from codeloom.operators import retrieval


def test_summary_chunks(spark):
    rows = [("A first paragraph here.\n\nshort\n\n- one item that is long\n  and goes on\n- two is also long enough\n1. three\n",), ("",), (None,)]
    got = spark.createDataFrame(rows, "s string").select(retrieval.summary_chunks(F.col("s")).alias("c")).collect()
    assert [r["c"] for r in got] == [["A first paragraph here.", "- one item that is long and goes on", "- two is also long enough"], [], None]


def test_append_notes(spark):
    old = spark.createDataFrame([("a", ["x"] * 14), ("b", ["y"] * 16), ("c", [])], "id string, notes array<string>")
    new = spark.createDataFrame([("a", "n2", 2), ("a", "n1", 1), ("b", "z", 1), ("d", "q", 1)], "id string, note string, ord int")
    got = {r["id"]: r["notes"] for r in retrieval.append_notes(old, new).collect()}
    assert got == {"a": ["x"] * 14 + ["n1"], "b": ["y"] * 16, "c": [], "d": ["q"]}


def test_known_facts_and_empty_frames(spark):
    evidence = spark.createDataFrame([("p", 1), ("q", 2), (None, 3), ("p", 4)], "path string, score int")
    facts = spark.createDataFrame([(7, ["p", "p", "r"]), (5, ["p"]), (9, None)], "fact_id int, paths array<string>")
    got = sorted(map(tuple, retrieval.apply_known_facts(evidence, facts).select("score", "n_facts", "first_fact").collect()), key=repr)
    assert got == sorted([(7, 2, 5), (10, 2, 5), (2, 0, None), (3, 0, None)], key=repr)
    assert retrieval.apply_known_facts(evidence.limit(0), facts.limit(0)).count() == 0
