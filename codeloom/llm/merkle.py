"""A Merkle manifest of documents: higher-order functions over blocks of ordered leaves.

Leaves are put in order per language, cut into blocks of 512 and collapsed there, 8
nodes a run and three levels a block, by sequence, transform, slice and aggregate; the
roots of the blocks are the next round's nodes.  A language needs a round for every
factor of 512 in its size.  The subroots of the languages are the nodes of a last tree.
Down again, a block gets the siblings that stand above it, so each leaf's proof is
put together inside its block, and no row carries more than its own siblings.

A null in any column is a value of its own.  Texts of any length are hashed whole and moved
nowhere.  A null language comes first, a null doc_id first within its language and is never
tampered with; equal doc_ids are ordered by their leaves, and rows that are equal throughout
are leaves of their own in any order (their digests are the same).  An empty table has no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, staged, table
from .ranges import dealt, placed

ARITY, DEPTH = 8, 3
BLOCK = ARITY**DEPTH
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest_of(x: Column) -> Column:
    return F.sha2(x, 256)


def leaf_of(text: Column | None = None) -> Column:
    """The digest of a row of documents, of its text or of another one in its place."""
    values = [F.col(c).cast("string") for c in FIELDS[:-1]] + [F.col("text") if text is None else text]
    return digest_of(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]))


def tampered_text() -> Column:
    return F.translate("text", string.ascii_uppercase, string.ascii_lowercase)


def height(total: Column) -> Column:
    """Levels above ``total`` nodes: the least h with 8^h of them or more."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(20)), F.lit(0), lambda h, i: h + (F.call_function("shiftleft", F.lit(1).cast("bigint"), 3 * i) < total).cast("int"))


def runs_of(nodes: Column) -> Column:
    """The nodes in runs of 8, the last one of fewer."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int")), lambda j: F.slice(nodes, j * ARITY + 1, ARITY))


def levels_of(nodes: Column, height: Column) -> Column:
    """The levels of a block from its nodes up, each as its runs: every run becomes its digest, ``height`` times."""
    over = lambda runs: F.transform(runs, lambda run: digest_of(F.array_join(run, "")))
    times = F.slice(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(1), height)
    return F.aggregate(times, F.array(runs_of(nodes)), lambda all_, _: F.concat(all_, F.array(runs_of(over(F.element_at(all_, -1))))))


def path_of(levels: Column, at: Column) -> Column:
    """For the node at place ``at`` of a block, the (before, after) digests of its run on each level but the block's last."""

    def pair(runs: Column, k: Column) -> Column:
        place = F.call_function("shiftright", at, 3 * k)
        run, own = runs[F.shiftright(place, 3)], place % ARITY
        return F.struct(F.array_join(F.slice(run, F.lit(1), own), "").alias("before"), F.array_join(F.slice(run, own + 2, ARITY), "").alias("after"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), pair)


def collapsed(nodes: DataFrame, carry: list[str]) -> list[DataFrame]:
    """A written table of blocks for each round over ``nodes`` (key, pos, total, digest, columns to carry).

    A block: key, block, height (levels of its key from here on), nodes in order and levels.
    """
    now, rounds = nodes.withColumn("height", height(F.col("total"))), []
    while True:
        blocks = now.groupBy("key", F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block")).agg(
            F.max("height").alias("height"), F.array_sort(F.collect_list(F.struct("pos", "digest", *carry))).alias("nodes")
        )
        rounds.append(staged(blocks.withColumn("levels", levels_of(F.col("nodes.digest"), F.least(F.col("height"), F.lit(DEPTH)))), "blocks"))
        higher = rounds[-1].where(F.col("height") > DEPTH)
        if higher.isEmpty():
            return rounds
        now, carry = higher.select("key", F.col("block").alias("pos"), top(), (F.col("height") - DEPTH).alias("height")), []


def top() -> Column:
    return F.element_at("levels", -1)[0][0].alias("digest")


def roots(rounds: list[DataFrame]) -> DataFrame:
    """key and digest of every key's root."""
    found = [r.where(F.col("height") <= DEPTH).select("key", top()) for r in rounds]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def lifted(rounds: list[DataFrame], above: DataFrame, carry: dict[str, str]) -> DataFrame:
    """A row for each first-round block: its nodes and levels, the path above it and ``carry`` of its key.

    ``above`` has key, path (what stands above the key's root) and the columns of ``carry``.
    """
    up = None
    for blocks in reversed(rounds):
        ends = blocks.where(F.col("height") <= DEPTH).select("key", "block").join(above, "key")
        up = ends if up is None else ends.unionByName(up)
        joined = blocks.join(up, ["key", "block"])
        if blocks is rounds[0]:
            return joined
        paths = F.transform("nodes", lambda x, i: F.struct(x["pos"].alias("block"), F.concat(path_of(F.col("levels"), i), F.col("path")).alias("path")))
        up = staged(joined.select("key", *carry, F.inline(paths)), "paths").select("key", "block", "path", *carry)


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row of ``docs``."""
    spark = docs.sparkSession
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("key")
    leaves = staged(docs.select(key, "doc_id", leaf_of().alias("digest"), F.when(hit, leaf_of(tampered_text())).alias("changed"), F.monotonically_increasing_id().alias("row")), "leaves")
    totals = leaves.groupBy("key").agg(F.count("*").alias("total"))
    ranged = dealt(leaves, ["key", "doc_id", "digest", "row"])
    rounds = collapsed(placed(ranged, ["key"]).join(totals, "key"), ["doc_id", "changed"])
    subroots = dealt(roots(rounds).withColumnRenamed("key", "name"), ["name"])
    crown = collapsed(placed(subroots, []).withColumns({"key": F.lit(""), "total": F.lit(subroots.count())}), ["name"])
    released(spark, leaves, ranged, subroots)
    root = roots(crown).first()
    root = F.lit(root["digest"] if root else "")
    none = spark.createDataFrame([("", [])], "key string, path array<struct<before string, after string>>")
    subs = F.transform("nodes", lambda x, i: F.struct(x["name"].alias("key"), x["digest"].alias("subroot"), F.concat(path_of(F.col("levels"), i), F.col("path")).alias("path")))
    above = staged(lifted(crown, none, {}).select(F.inline(subs)), "above")

    def proof(x: Column, i: Column) -> Column:
        path = F.array(F.concat(path_of(F.col("levels"), i), F.col("path")))
        fold = lambda p: F.aggregate(p, F.coalesce(x["changed"], x["digest"]), lambda node, s: digest_of(F.concat(s["before"], node, s["after"])))
        said = lambda p: digest_of(F.array_join(F.transform(p, lambda s: F.concat(s["before"], s["after"])), ""))
        return F.transform(path, lambda p: F.struct(x["doc_id"].alias("doc_id"), x["digest"].alias("leaf"), said(p).alias("proof_sha256"), fold(p).alias("folded_root")))[0]

    found = lifted(rounds, above, {"subroot": "string"}).select("subroot", F.inline(F.transform("nodes", proof)))
    return found.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, with the tampered ones told by their folds."""
    return proofs(table(spark, sf_dir, "documents"))


#: The unsigned CRC-32 of a short string of ASCII characters, bit by bit.
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0,0,0,0,0,0,0,0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def _field(x: str) -> str:
    return f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, [*FIELDS[:-1], text])) + ")"


#: Levels are numbered through: those of the languages, then those over the subroots, which begin at level 100.
ORACLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS k, {_leaf('text')} AS leaf,
    CASE WHEN {CRC32.format('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
low AS (
  SELECT 0 AS level, k, pos, leaf AS digest, count(*) OVER (PARTITION BY k) AS n FROM placed
  UNION ALL
  SELECT any_value(level) + 1, k, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM low WHERE n > 1 GROUP BY k, pos // 8),
subs AS (SELECT k, digest, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 100 AS level, pos, digest, n FROM subs
  UNION ALL
  SELECT any_value(level) + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM high WHERE n > 1 GROUP BY pos // 8),
nodes AS (SELECT level, k, pos, digest FROM low WHERE n > 1 UNION ALL SELECT level, '', pos, digest FROM high WHERE n > 1),
steps AS (
  SELECT p.k, p.pos, n.level, n.pos AS place, n.digest, n.pos = p.pos >> (3 * n.level) AS own FROM placed p JOIN nodes n ON n.level < 100 AND n.k = p.k AND n.pos >> 3 = p.pos >> (3 * n.level + 3)
  UNION ALL
  SELECT p.k, p.pos, n.level, n.pos, n.digest, n.pos = s.pos >> (3 * (n.level - 100)) FROM placed p JOIN subs s USING (k) JOIN nodes n ON n.level >= 100 AND n.pos >> 3 = s.pos >> (3 * (n.level - 100) + 3)),
runs AS (
  SELECT k, pos, level, coalesce(string_agg(digest, '' ORDER BY place) FILTER (NOT own AND place < mine), '') AS before, coalesce(string_agg(digest, '' ORDER BY place) FILTER (NOT own AND place > mine), '') AS after
  FROM (SELECT *, max(place) FILTER (own) OVER (PARTITION BY k, pos, level) AS mine FROM steps) GROUP BY k, pos, level),
paths AS (SELECT k, pos, list({{'b': before, 'a': after}} ORDER BY level) AS path, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM runs GROUP BY k, pos),
folds AS (
  SELECT p.k, p.pos, 0 AS i, coalesce(changed, leaf) AS digest, coalesce(path, []) AS path, coalesce(proof, sha256('')) AS proof FROM placed p LEFT JOIN paths USING (k, pos)
  UNION ALL
  SELECT k, pos, i + 1, sha256(path[i + 1].b || digest || path[i + 1].a), path, proof FROM folds WHERE i < len(path))
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, f.proof AS proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
FROM placed p JOIN subs s USING (k) JOIN folds f ON f.k = p.k AND f.pos = p.pos AND f.i = len(f.path), (SELECT digest FROM high WHERE n = 1) r
"""
