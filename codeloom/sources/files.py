"""Directory trees and structured text as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guards import is_ignored, language_of
from ..functions.text import content_hash, stable_id

MAX_BYTES = 2 << 20


def read_tree(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """Files of known languages below ``root``, without ignored directories and files over 2 MiB.

    Without content only names and sizes are read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    relative = F.regexp_replace(F.col("path"), r"^(file|hdfs|s3a?|gs|abfss?):/*", "/")
    files = raw.select(F.replace(relative, F.lit(base), F.lit("")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), *([F.decode("content", "UTF-8").alias("content")] if with_content else []))
    known = files.withColumn("language", language_of(F.col("path"))).where(F.col("language").isNotNull() & ~is_ignored(F.col("path")) & (F.col("size") <= MAX_BYTES))
    if not with_content:
        return known
    return known.select(stable_id(F.lit(base), F.col("path")).alias("id"), "path", "language", "size", "modified_at", content_hash(F.col("content")).alias("content_hash"), "content")


def headings(files: DataFrame) -> DataFrame:
    """Markdown headings: path, 1-based line, level and title."""
    line = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    level = F.length(F.regexp_extract("text", r"^(#{1,6})\s+(.+)$", 1))
    return line.where(F.col("text").rlike(r"^#{1,6}\s+.+$")).select("path", (F.col("at") + 1).alias("line"), level.alias("level"), F.regexp_extract("text", r"^(#{1,6})\s+(.+)$", 2).alias("title"))


def json_keys(files: DataFrame) -> DataFrame:
    """Top-level keys of JSON objects; other JSON and broken files have none."""
    return files.select("path", F.explode(F.json_object_keys("content")).alias("key"))


def env_values(files: DataFrame) -> DataFrame:
    """KEY=VALUE lines without comments; one pair of outer quotes is taken off."""
    line = files.select("path", F.explode(F.split("content", "\r?\n")).alias("line")).where(F.col("line").rlike(r"^\s*[A-Za-z_]\w*\s*="))
    value = F.trim(F.regexp_extract("line", r"^\s*([A-Za-z_]\w*)\s*=(.*)$", 2))
    return line.select("path", F.regexp_extract("line", r"^\s*([A-Za-z_]\w*)\s*=", 1).alias("key"), F.regexp_replace(value, r"""^(["'])(.*)\1$""", "$2").alias("value"))


def status_rows(lines: DataFrame) -> DataFrame:
    """Two-letter status lines (column line) as change rows: path, previous_path, scope and type."""
    code, rest = F.substring("line", 1, 2), F.substring(F.col("line"), F.lit(4), F.lit(1 << 20))
    path = F.element_at(F.split(rest, " -> "), -1)
    previous = F.when(F.contains(rest, F.lit(" -> ")), F.element_at(F.split(rest, " -> "), 1))
    kind = lambda c: F.when(c == "A", "added").when(c == "D", "deleted").when(c == "R", "renamed").when(c == "?", "added").otherwise("modified")
    staged, work = F.substring(code, 1, 1), F.substring(code, 2, 1)
    both = F.array_compact(F.array(F.when(~staged.isin(" ", "?"), F.struct(F.lit("staged").alias("scope"), kind(staged).alias("type"))), F.when(work == "?", F.struct(F.lit("untracked").alias("scope"), F.lit("added").alias("type"))).when(work != " ", F.struct(F.lit("unstaged").alias("scope"), kind(work).alias("type")))))
    return lines.select(path.alias("path"), previous.alias("previous_path"), F.explode(both).alias("c")).select("path", "previous_path", "c.scope", "c.type").distinct()
