"""Knowledge tables: upserts, freshness, memory, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_wins(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key."""
    return new.unionByName(old.join(new.select(key), key, "left_anti").select(*new.columns))


def merge_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Facts (id, confidence, paths): the greatest confidence and the sorted union of paths."""
    both = old.unionByName(new)
    conf = both.groupBy("id").agg(F.max("confidence").alias("confidence"))
    paths = both.select("id", F.explode("paths").alias("p")).groupBy("id").agg(F.array_sort(F.collect_set("p")).alias("paths"))
    return conf.join(paths, "id", "left")


def merge_glossary(rows: DataFrame) -> DataFrame:
    """(project, term, definition, confidence, seq): one row a lower-cased term, the definition of greatest confidence, then latest."""
    return rows.groupBy("project", F.lower("term").alias("term")).agg(F.max_by("definition", F.struct("confidence", "seq")).alias("definition"), F.max("confidence").alias("confidence"))


def fact_status(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Facts with (id, path, hash) rows: valid where ANY path has its hash still, stale_any where any differs or is gone."""
    match = F.coalesce(F.col("hash") == F.col("now_hash"), F.lit(False))
    joined = paths.join(files.select("path", F.col("hash").alias("now_hash")), "path", "left")
    return joined.groupBy("id").agg(F.bool_or(match).alias("valid"), (~F.bool_and(match)).alias("stale_any"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("rn = 1").drop("rn")


def tail(df: DataFrame, key: str, order: str, n: int = 6, head: str | None = None) -> DataFrame:
    """The last n rows of each key; with ``head`` only those since the key's head last changed (a null head is one of its own)."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    if head:
        # reading back, the first row of another head ends the memory
        newest = F.first(F.struct(head)).over(last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        df = df.withColumn("_other", (~F.struct(head).eqNullSafe(newest)).cast("int"))
        df = df.withColumn("_gone", F.max("_other").over(last.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_gone = 0").drop("_other", "_gone")
    return df.withColumn("rn", F.row_number().over(last)).where(F.col("rn") <= n).drop("rn")


def churn(commits: DataFrame, fix: str = r"(?i)fix|error|regression|patch") -> DataFrame:
    """(file, subject) rows: commits, fixes and commits + 2 * fixes of each file."""
    fixes = F.count_if(F.col("subject").rlike(fix))
    return commits.groupBy("file").agg(F.count("*").alias("commits"), fixes.alias("fixes"), (F.count("*") + 2 * fixes).alias("churn"))


def usage(rows: DataFrame) -> DataFrame:
    """Calls and tokens by role and in total (role null)."""
    return rows.rollup("role").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


def progress(units: DataFrame) -> DataFrame:
    """Fresh and total units and the rounded share, 100 where there are none (column fresh)."""
    n, fresh = F.count("*"), F.count_if(F.col("fresh"))
    return units.agg(fresh.alias("fresh"), n.alias("total"), F.when(n == 0, F.lit(100)).otherwise(F.floor(100 * fresh / n + 0.5)).cast("long").alias("percent"))


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(id, hash) frames: counts of added, removed, changed and reused ids."""
    both = previous.select("id", F.col("hash").alias("old")).join(current.select("id", F.col("hash").alias("new")), "id", "full_outer")
    return both.agg(
        F.count_if(F.col("old").isNull()).alias("added"),
        F.count_if(F.col("new").isNull()).alias("removed"),
        F.count_if(F.col("old") != F.col("new")).alias("changed"),
        F.count_if(F.col("old") == F.col("new")).alias("reused"),
    )


def change_summary(changes: DataFrame) -> DataFrame:
    """Counts of changes by scope and type."""
    return changes.groupBy("scope", "type").agg(F.count("*").alias("n"))


def replay(turns: DataFrame, key: str, order: str) -> DataFrame:
    """The turns of each conversation, numbered in their order."""
    return turns.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(order)))
