"""Refreshing what is known: plans of an incremental index, facts against current files, near-duplicate facts, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_path
from ..plans.staging import deal, few, staged
from .alike import first_kept


def index_plan(changes: DataFrame, previous: DataFrame, most: int = 500) -> DataFrame:
    """(role, path, source) of changes (path, previous_path, type) and previous files (path): changed, deleted, renamed from source, and the first ``most`` reusable paths."""
    named = changes.select(normalize_path(F.col("path")).alias("path"), normalize_path(F.col("previous_path")).alias("source"), "type")
    none = F.lit(None).cast("string").alias("source")
    out = named.select(F.lit("changed").alias("role"), "path", none).distinct()
    out = out.unionByName(named.where("type = 'deleted'").select(F.lit("deleted").alias("role"), "path", none).distinct())
    out = out.unionByName(named.where("type = 'renamed' and source is not null").select(F.lit("renamed").alias("role"), "path", "source").distinct())
    kept = previous.select(normalize_path(F.col("path")).alias("path")).join(named.select("path"), "path", "left_anti").distinct()
    return out.unionByName(kept.orderBy("path").limit(most).select(F.lit("reusable").alias("role"), "path", none))


def invalidation(changed: DataFrame, symbols: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 150, repeats: bool = False) -> DataFrame:
    """One row: how many paths changed, the symbols they invalidate, the nodes and edges that stay, and the mode.

    changed (path), symbols (symbol_id, path), nodes (id, file_path), edges (source_id,
    target_id).  Edges stay where neither end lies in a changed path; ends that aren't
    nodes, and nodes without a path, don't count as changed.  With ``repeats`` an edge that
    repeats counts once; then only what is left moves for its target.  Edges and nodes are
    counted first, so that tasks stay small.
    """
    paths = few(staged(changed.select("path").where("path is not null").distinct(), "paths"))
    lost = staged(nodes.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select("id"), "lost")
    dealt = deal(edges.select("source_id"), nodes.select("id"))
    gone = lambda key: dealt(lost.withColumnRenamed("id", key), key)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    kept = dealt(edges, "source_id").join(gone("source_id"), "source_id", "left_anti")
    kept = kept.distinct() if repeats else kept  # a source's edges lie together
    kept = dealt(kept, "target_id").join(gone("target_id"), "target_id", "left_anti")
    out = one(paths, "changed").crossJoin(one(symbols.join(paths, "path", "left_semi").select("symbol_id").distinct(), "symbols"))  # one row each
    out = out.crossJoin(one(dealt(nodes, "id").join(gone("id"), "id", "left_anti"), "nodes_kept")).crossJoin(one(kept, "edges_kept"))
    return out.withColumn("mode", F.when(F.col("changed").between(1, most), "partial-invalidation").otherwise("full-refresh"))


def scoped_paths(changes: DataFrame, workspace: DataFrame) -> DataFrame:
    """Paths of a workspace that a change has as its path or previous path."""
    named = changes.select(F.explode(F.array("path", "previous_path")).alias("path"))
    return named.join(workspace.select("path"), "path", "left_semi").distinct()


def relevant_facts(facts: DataFrame, paths: DataFrame, files: DataFrame, renames: DataFrame, most: int = 100) -> DataFrame:
    """The ``most`` latest facts that aren't deprecated, by current files: (id, status, paths).

    facts (id, status, confirmed_at), paths (id, path, hash at the time), files (path,
    hash), renames (path, new_path).  Paths follow renames; a fact of which no path has
    its hash, kept under the old path, is potentially stale.
    """
    latest = facts.where("status <> 'deprecated'").orderBy(F.col("confirmed_at").desc(), "id").limit(most)
    moved = paths.join(latest.select("id"), "id", "left_semi").join(renames.groupBy("path").agg(F.min("new_path").alias("new_path")), "path", "left")
    moved = moved.select("id", F.coalesce("new_path", "path").alias("path"), "hash")
    seen = moved.join(files.select("path", F.col("hash").alias("now_hash")), "path", "left")
    state = seen.groupBy("id").agg(F.bool_or(F.coalesce(F.col("hash") == F.col("now_hash"), F.lit(False))).alias("valid"), F.array_sort(F.collect_set("path")).alias("paths"))
    joined = latest.join(state, "id", "left")
    return joined.select("id", F.when(F.coalesce("valid", F.lit(False)), F.col("status")).otherwise("potentially_stale").alias("status"), F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))


def expired(status: Column, age_days: Column, valid: Column, contradicted_days: int = 7, stale_days: int = 60) -> Column:
    """Whether a fact goes: contradicted for longer than a week, or unconfirmed for sixty days and no longer valid."""
    return F.coalesce(((status == "contradicted") & (age_days > contradicted_days)) | ((status == "fresh") & (age_days >= stale_days) & ~valid), F.lit(False))


def merge_near_duplicates(facts: DataFrame, share: float = 0.7) -> DataFrame:
    """Facts (id, category, statement, paths, ord) without near duplicates: (id, category, paths).

    Within a category, from the greatest ord down (least id on ties), a fact is merged
    into the first one kept that shares ``share`` of the words (four ASCII letters,
    digits or '_' or more) of the smaller of the two; the one kept takes its paths.
    Ids are unique.  Facts without such words are kept.

    Who is kept is found by :func:`.alike.first_kept`, block after block; no pairs are written and no category is gathered.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("statement", F.lit(""))), F.lit("[a-z0-9_]{4,}"), F.lit(0)))
    merged = staged(first_kept(facts.withColumn("category", F.coalesce("category", F.lit(""))), words, share), "merged").withColumnRenamed("id", "later")
    target = facts.join(merged.select(F.col("later").alias("id"), "first"), "id", "left").withColumn("id", F.coalesce("first", "id"))
    paths = target.select("id", F.explode("paths").alias("path")).groupBy("id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    stay = facts.select("id", "category").join(merged.select(F.col("later").alias("id")), "id", "left_anti")
    return stay.join(paths, "id", "left").select("id", "category", F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))


def to_embed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, hash) whose vector is missing or of other content."""
    return files.join(known.select("path", "hash"), ["path", "hash"], "left_anti")


def prune(known: DataFrame, files: DataFrame) -> DataFrame:
    """Vectors of files that are there still."""
    return known.join(files.select("path"), "path", "left_semi")


def requested(asked: DataFrame, there: DataFrame) -> DataFrame:
    """(id, found) for each distinct id asked for."""
    return asked.select("id").distinct().join(there.select("id").distinct().withColumn("found", F.lit(True)), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def project_state(baseline: Column, head: Column, is_git: Column, unmerged: Column, dirty: Column) -> Column:
    """(freshness, sync, worktree) of a project by the head its baseline was made at."""
    fresh = F.when(baseline.isNull(), "missing").when(baseline == head, "fresh").otherwise("stale")
    sync = F.when(~is_git, "degraded").when(fresh == "fresh", "ready").otherwise("syncing")
    return F.struct(fresh.alias("freshness"), sync.alias("sync"), F.when(unmerged, "conflict").when(dirty, "overlay").otherwise("clean").alias("worktree"))


def recovered(runs: DataFrame) -> DataFrame:
    """Runs after a restart: those that were running have failed."""
    return runs.withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")))


def stale_order(units: DataFrame, churn: DataFrame) -> DataFrame:
    """Units (unit, ord, crawled) with ``place``: never crawled ones in their order, then by falling churn of the unit's own files (path, churn), then in their order.

    A unit's files are those it is itself or a folder of, found by an equi join on each path's folders.
    """
    p = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.array_join(F.slice(p, F.lit(1), n), "/"))
    total = churn.select(F.explode(above).alias("unit"), "churn").groupBy("unit").agg(F.sum("churn").alias("churn"))
    scored = units.join(total, "unit", "left").withColumn("churn", F.coalesce("churn", F.lit(0)))
    order = [F.col("crawled"), F.when(F.col("crawled"), -F.col("churn")).otherwise(F.lit(0)), F.col("ord")]
    return scored.orderBy(*order)


def stage_durations(stages: DataFrame) -> DataFrame:
    """Stages (run, stage, ts) with their order and the microseconds until the next one of the run; null for the last."""
    w = Window.partitionBy("run").orderBy("ts", "stage")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return stages.select("run", "stage", F.row_number().over(w).cast("long").alias("place"), (F.lead(at).over(w) - at).alias("micros"))


def relabelled(nodes: DataFrame, label: str) -> DataFrame:
    """Nodes of another root: ids and paths begin with its label, so that they never meet those of this one."""
    pre = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("/", F.lit(label), c)).alias(c)
    return nodes.select(*[pre(c) if c in ("id", "file_path", "source_id", "target_id") else F.col(c) for c in nodes.columns])
