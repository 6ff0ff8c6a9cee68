"""The dense form of prefix doubling and the sparse one agree, and columns pass through the pipeline's cut."""

import datetime
import decimal

from codeloom.llm import doubling, suffix

from test_suffix import brute, corpus

FIELDS = ("doc_id", "n_bytes", "n_removed", "n_spans")


def rows_of(df):
    return sorted((tuple(r[k] for k in FIELDS) for r in df.collect()), key=repr)


def test_dense_and_sparse_and_brute_force_agree(spark):
    rows = corpus(150, 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dense = rows_of(doubling.repeats(docs))
    assert dense == rows_of(suffix.remove_repeats(docs, with_kept=False)) == sorted((x[:4] for x in brute(rows)), key=repr)
    assert doubling.repeats(docs.limit(0)).count() == 0


def test_cut_texts_keeps_columns_as_they_are(spark):
    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    long = "é" + "abcdefghij" * 12
    ddl = "extra timestamp, doc_id long, n_chars int, text string, __extra decimal(20,4), bucket map<string,array<double>>, kept binary"
    rows = [(at, 1, 0, long, decimal.Decimal("1.2345"), {"a": [0.1]}, b"\xff"), (None, 2, 0, "x" + long + "y", None, None, None), (at, None, 0, None, decimal.Decimal("-1"), {}, b"")]
    docs = spark.createDataFrame(rows, ddl)
    got = suffix.cut_texts(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    found = {r["doc_id"]: r for r in got.collect()}
    assert tuple(found[1]) == (at, 1, len(long), long, decimal.Decimal("1.2345"), {"a": [0.1]}, b"\xff")
    assert found[2]["text"] == "xy" and found[2]["n_chars"] == 2 and found[2]["extra"] is None
    assert found[None]["extra"] == at and found[None]["text"] == ""
    assert suffix.cut_texts(docs.select("doc_id", "text")).columns == ["doc_id", "text"]
