"""Exact dedup by content-defined chunk recipes, in DataFrame functions alone.

A normalised text is cut where its content says so, so copies are cut alike.
Each distinct chunk is moved once, next to the chunks of the same digest, and
its identifier holds only if all of them are the same string.  A document is then
its recipe, the ordered list of chunk identifiers; documents are equal when
their recipes are, and only recipes move from there on.

Null texts count as empty; empty texts have one chunk, the empty string, and are equal to
each other.  A null doc_id is a document of its own and comes last in a tie.  Rows
that repeat a doc_id count each; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, keep_rows, numbered, released, staged, table, text_of

#: 1024 characters at least, then up to one of these letter pairs or 4096 characters; then what is left.
CHUNK = r"(?s).{1024}(?:.{0,3070}?(?:an|en|er|he|in|io|ld|on|or|ri|st|ti)|.{0,3072})|.+"
WHITE = " \t\n\x0b\f\r"


def chunks_of(normal: F.Column) -> F.Column:
    return F.when(F.length(normal) <= 1024, F.array(normal)).otherwise(F.regexp_extract_all(normal, F.lit(CHUNK), F.lit(0)))


def recipes(docs: DataFrame, row: F.Column) -> DataFrame:
    """A written row per document: row, doc_id, n_points, text_sha256 and the digests of its chunks in order."""
    normal = docs.select(row.alias("row"), "doc_id", F.length(text_of("text")).alias("n_points"), F.translate(text_of("text"), WHITE, "").alias("normal"))
    cut = normal.select("row", "doc_id", "n_points", F.sha2("normal", 256).alias("text_sha256"), F.transform(chunks_of(F.col("normal")), lambda c: F.unhex(F.sha2(c, 256))).alias("digests"))
    return staged(cut, "recipes")


def verified_chunks(docs: DataFrame) -> DataFrame:
    """The digest of every distinct chunk; the job fails if two different chunks share one."""
    normal = docs.select(F.translate(text_of("text"), WHITE, "").alias("normal"))
    chunk = normal.select(F.explode(chunks_of(F.col("normal"))).alias("chunk"))
    distinct = chunk.select(F.unhex(F.sha2("chunk", 256)).alias("digest"), "chunk").distinct()
    checked = distinct.groupBy("digest").agg(F.count("*").alias("n"))
    return checked.select("digest", F.when(F.col("n") > 1, F.raise_error(F.lit("two chunks share a digest"))).otherwise(F.xxhash64("digest")).cast("long").alias("seen"))


def row_groups(docs: DataFrame, row: F.Column) -> DataFrame:
    """row, doc_id, keep_id, group_size, kept and text_sha256 for every row, which ``row`` names."""
    made = recipes(docs, row)
    verified = staged(verified_chunks(docs), "verified")
    rows = made.select("row", F.posexplode("digests").alias("at", "digest"))
    known = rows.join(verified, "digest").groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]).alias("recipe"))
    listed = staged(made.select("row", "doc_id", "n_points", "text_sha256").join(known, "row", "left").withColumn("recipe", F.coalesce("recipe", F.array().cast("array<binary>"))), "listed")
    released(docs.sparkSession, made, verified)
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("not_id"), F.bitwise_not("row").alias("not_row")))  # not x falls as x grows, without overflow
    groups = staged(listed.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    both = listed.join(groups, "recipe")
    return both.select("row", "doc_id", F.bitwise_not("best.not_id").alias("keep_id"), "group_size", (F.col("row") == F.bitwise_not("best.not_row")).alias("kept"), "text_sha256")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row; see the module."""
    return row_groups(docs, F.monotonically_increasing_id()).drop("row")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay."""
    rows = numbered(docs)
    return keep_rows(rows, row_groups(rows, F.col(ROW)).where("kept"), docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document and whether it stays."""
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
