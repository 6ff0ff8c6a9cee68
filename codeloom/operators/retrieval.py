"""Candidates and evidence: entity matches, known facts, duplicates, ranking, chunks of summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How candidates of equal score rank.
PRIORITY = {"critical": 3, "high": 2, "supporting": 1}
LIST_ITEM = r"(?:[-•*]|\d+\.)\s"


def entity_strength(text: Column, hints: list[tuple[str, list[str]]]) -> Column:
    """The best match of (compact name, its parts) hints in a text: 3 the compact name, 2 all of two parts or more, 1 any part, 0 none."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def has(part: str) -> Column:
        return F.contains(low, F.lit(part))

    out = [F.lit(0)]
    for compact, parts in hints:
        every, some = F.lit(len(parts) >= 2), F.lit(False)
        for p in parts:
            every, some = every & has(p), some | has(p)
        out.append(F.when(has(compact) if compact else F.lit(False), 3).when(every, 2).when(some, 1).otherwise(0))
    return F.greatest(*out) if len(out) > 1 else out[0]


def apply_known_facts(evidence: DataFrame, facts: DataFrame, bonus: int = 6) -> DataFrame:
    """Evidence (path, score) with facts (fact_id, paths): the score raised once where any fact names the path, how many do, and the least fact_id.

    Facts are reduced to a row for each path before the join, so neither a path that many facts name nor evidence on it multiplies rows.
    """
    named = facts.select("fact_id", F.explode(F.array_distinct("paths")).alias("path")).groupBy("path").agg(F.count("*").alias("n_facts"), F.min("fact_id").alias("first_fact"))
    joined = evidence.join(named, "path", "left")
    return joined.withColumn("n_facts", F.coalesce("n_facts", F.lit(0))).withColumn("score", F.col("score") + F.when(F.col("n_facts") > 0, bonus).otherwise(0))


def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    """Of candidates (type, path or null, label, score, ord) with one key, type and path or else label, that of greatest score, then of least ord."""
    key = F.concat_ws(":", "type", F.coalesce("path", "label"))
    best = F.min_by(F.struct(*candidates.columns), F.struct((-F.col("score")).alias("s"), "ord")).alias("best")  # aggregated before the shuffle, unlike a window
    return candidates.groupBy(key.alias("key")).agg(best).select("best.*")


def rank_candidates(candidates: DataFrame, n: int) -> DataFrame:
    """The first n by score, priority, then fewest tokens and label."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("priority")), F.lit(0))
    return candidates.orderBy(F.col("score").desc(), weight.desc(), F.col("tokens").asc(), F.col("label").asc()).limit(n)


def best_by_tier(rows: DataFrame, key: str, tiers: list[Column], newest: str, tie: str) -> DataFrame:
    """Of each key the row of the first tier that any row meets, there the newest, then that of least ``tie``; rows that meet none rank last.  One aggregation."""
    tier = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(tiers)], F.lit(len(tiers))).cast("long")
    ranked = rows.withColumn("tier", tier)
    order = F.struct((-F.col("tier")).alias("t"), F.col(newest).alias("n"), (-F.col(tie)).alias("i"))
    return ranked.groupBy(key).agg(F.max_by(F.struct(*[c for c in ranked.columns if c != key]), order).alias("best")).select(key, "best.*")


def summary_chunks(text: Column, least: int = 15) -> Column:
    """Paragraphs, or in a paragraph with list markers its items, of ``least`` characters or more."""
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    paragraphs = F.transform(F.split(text, r"\n\s*\n"), trimmed)
    marked = F.transform(paragraphs, lambda p: F.when(p.rlike(rf"(?m)^[ \t]*{LIST_ITEM}"), F.transform(F.split(F.regexp_replace(p, rf"\n[ \t]*(?={LIST_ITEM})", "\x00"), "\x00"), lambda x: trimmed(F.regexp_replace(x, r"\s*\n\s*", " ")))).otherwise(F.array(p)))
    return F.filter(F.flatten(marked), lambda x: F.length(x) >= least)


def fingerprint(df: DataFrame, key: str, part: Column) -> DataFrame:
    """(key, fingerprint): SHA-1 of the sorted parts of each key, a line each; for keys of a bounded number of rows."""
    return df.groupBy(key).agg(F.sha1(F.array_join(F.array_sort(F.collect_list(part)), "\n")).alias("fingerprint"))


def prefers_selective(profile: Column, is_git: Column, has_unmerged: Column, changed: Column) -> Column:
    """Whether a large repository without conflicts has 1 to 150 changed files."""
    return F.coalesce((profile == "large-repository") & is_git & ~has_unmerged & (changed > 0) & (changed <= 150), F.lit(False))


def deleted_paths(previous: DataFrame, current: DataFrame, explicit: DataFrame) -> DataFrame:
    """Distinct paths that were there and are no more, and those that are stated as deleted."""
    return previous.select("path").join(current.select("path"), "path", "left_anti").unionByName(explicit.select("path")).distinct()


def append_notes(old: DataFrame, new: DataFrame, most: int = 15) -> DataFrame:
    """Units (id, notes) with new (id, note, ord) appended in order while a unit has fewer than ``most``."""
    fresh = new.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where(F.col("rn") <= most)  # the limit goes before the shuffle
    added = fresh.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rn", "note"))).alias("added"))
    both = F.concat(F.coalesce("notes", F.array().cast("array<string>")), F.coalesce(F.transform("added", lambda x: x["note"]), F.array().cast("array<string>")))
    kept = F.when(F.size("notes") >= most, F.col("notes")).otherwise(F.slice(both, 1, most))
    return old.join(added, "id", "full_outer").select("id", kept.alias("notes"))


def module_relations(nodes: DataFrame, edges: DataFrame, modules: DataFrame, type_: str = "DEPENDS_ON") -> DataFrame:
    """(module_id, direction, other_id, label) of the edges of a type at each module (column id)."""
    own = edges.where(F.col("type") == type_)
    ends = own.select(F.col("source_id").alias("id"), F.lit("outgoing").alias("direction"), F.col("target_id").alias("other_id"))
    ends = ends.unionByName(own.select(F.col("target_id").alias("id"), F.lit("incoming").alias("direction"), F.col("source_id").alias("other_id")))
    held = ends.join(modules.select("id"), "id", "left_semi").withColumnRenamed("id", "module_id")
    return held.join(nodes.select(F.col("id").alias("other_id"), "label"), "other_id").select("module_id", "direction", "other_id", "label")
