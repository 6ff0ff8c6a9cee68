"""The dense form of prefix doubling: a (position, rank) row for every byte.

Spark groups and sorts these rows at growing offsets: ranks of ``FIRST`` bytes, then of
twice that, then of ``LENGTH`` by two overlapping halves.  A class of equal strings is
reranked to its least position, and positions whose string is unique take no part in
the next round.  All comparisons are exact.

This is the plain form of what :mod:`suffix` does sparsely.  It shuffles many times the
input (README), so it serves as the check of the other on small tables.

Null texts count as empty; a null doc_id is larger than any other; rows of one doc_id
never remove from each other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, numbered, staged, text_of
from .suffix import LAST, LENGTH

FIRST = 16


def _reranked(strings: DataFrame, *key: str) -> DataFrame:
    """(row, at, doc, rank, least): rank names the class of equal keys, least is its smallest doc; unique ones are dropped."""
    place = F.struct(ROW, "at")
    classes = strings.groupBy(*key).agg(F.min(place).alias("rank"), F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return staged(strings.join(classes, list(key)).select(ROW, "at", "doc", "rank", "least"), "ranks")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed and n_spans of every row of ``docs`` (doc_id, text), as :func:`suffix.remove_repeats` has them."""
    rows = numbered(docs.select("doc_id", text_of("text").cast("binary").alias("bytes")))
    doc = F.coalesce("doc_id", F.lit(int(LAST))).alias("doc")
    long = rows.where(F.octet_length("bytes") >= LENGTH)
    starts = long.select(ROW, doc, "bytes", F.explode(F.sequence(F.lit(1), F.octet_length("bytes") - (FIRST - 1))).alias("at"))
    now, size = _reranked(starts.select(ROW, "at", "doc", F.substring("bytes", F.col("at"), F.lit(FIRST)).alias("string")), "string"), FIRST
    while size < LENGTH:
        offset = min(size, LENGTH - size)
        second = now.select(ROW, (F.col("at") - offset).alias("at"), F.col("rank").alias("second"))
        first = now.select(ROW, "at", "doc", F.col("rank").alias("first"))
        now, size = _reranked(first.join(second, [ROW, "at"]), "first", "second"), size + offset
    by_place = Window.partitionBy(ROW).orderBy("at")
    hit = now.where("least < doc").select(ROW, "at", F.lag("at").over(by_place).alias("before"))
    removed = hit.groupBy(ROW).agg(
        F.sum(F.least(F.lit(LENGTH), F.coalesce(F.col("at") - F.col("before"), F.lit(LENGTH)))).alias("n_removed"),
        F.count(F.when(F.col("before").isNull() | (F.col("at") - F.col("before") > LENGTH), 1)).alias("n_spans"),
    )
    found = rows.select(ROW, "doc_id", F.octet_length("bytes").cast("long").alias("n_bytes")).join(removed, ROW, "left")
    return found.select("doc_id", "n_bytes", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")])
