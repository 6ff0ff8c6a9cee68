"""The prefix trie of conversations, merged from partial tries.

A node is a distinct beginning of rebuilt conversations.  Its id is a sum of hashes of
(place, turn), so beginnings are known by running totals, which add up over pieces of a
conversation however long it is; that equal ids have one parent and one turn is checked,
node by node, and ends the job where it fails.

Ranges of 4096 conversations emit partial tries, locally combined; tables of 64 ranges are
merged by hash of the node's id, round after round, until there is one.  The lists of ends are
merged in runs of 256 conversations that stay in order, and their digest reads run after run.
What a subtree holds is rolled up bottom-up along each conversation, from its end to its
start: every node counts at the smallest of its members, its owner, so a node's subtree is the
sum over its members of what they own from there down, at any depth in two passes.

A row without conv_id belongs to no conversation.  Null roles and texts are empty, turns
of equal number (null first) are ordered by the digest of role and text, and repeated rows are turns
of their own.  Texts of any length count whole; they are digested where they are read.  An empty
table has no conversation and thus no row, not even the root.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, released, slices, staged, table, text_of
from .merkle import CRC32
from .ranges import dealt, placed

PART, FAN, RUN, CHUNK = 4096, 64, 256, 1024
#: What a conversation shares with that of the next lower multiple of STEP: fewer turns than HEAD, by its hash.
STEP, HEAD = 5, 9
LANES = ["s1", "s2", "s3", "s4"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest of role and text, n_bytes of the text and row for every turn of a conversation."""
    role, text = text_of("role"), text_of("text")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"))


def scanned(rows: DataFrame, values: list[str], up: bool = False) -> DataFrame:
    """``values`` become running totals over depth within conv_id, from the end if ``up``; long conversations go by chunks."""
    way = (lambda c: F.col(c).desc()) if up else F.col
    rows = rows.withColumn("chunk", F.floor(F.col("depth") / CHUNK).cast("bigint"))
    here = Window.partitionBy("conv_id", "chunk").orderBy(way("depth")).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy("conv_id").orderBy(way("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "chunk").agg(*[F.sum(v).alias(v) for v in values])
    over = sums.select("conv_id", "chunk", *[F.sum(v).over(past).alias(f"past_{v}") for v in values]).where(f"past_{values[0]} is not null")
    both = rows.withColumns({v: F.sum(v).over(here) for v in values}).join(over, ["conv_id", "chunk"], "left")
    return both.withColumns({v: F.col(v) + F.coalesce(f"past_{v}", F.lit(0)) for v in values}).drop("chunk", *[f"past_{v}" for v in values])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """A written row per turn of the rebuilt conversations, and one of depth 0 for each: conv_id, rank, depth, digest, n_bytes and last."""
    turns = staged(turns_of(conversations), "turns")
    ranged = dealt(turns, ["conv_id", "turn", "digest", "row"])
    own = staged(placed(ranged, ["conv_id"]).select("conv_id", "pos", "digest", "n_bytes"), "own")
    heads = own.where(f"pos < {HEAD - 1} and conv_id % {STEP} = 0").groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "n_bytes"))).alias("head"))
    ids = dealt(own.groupBy("conv_id").agg(F.count("*").alias("n")), ["conv_id"])
    cut = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    found = placed(ids, []).select("conv_id", F.col("pos").alias("rank"), "n", cut.alias("cut"), (F.col("conv_id") - F.col("conv_id") % STEP).alias("base")).join(heads, "base", "left")
    found = found.withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,digest:binary,n_bytes:bigint>>")), F.lit(1), F.col("cut")))
    found = found.withColumn("size", F.size("head") + F.greatest(F.col("n") - F.col("cut"), F.lit(0)))
    told = staged(found.select("conv_id", "rank", "cut", "head", "size"), "told")
    turn = ["digest", "n_bytes", (F.col("depth") == F.col("size")).alias("last")]
    tops = told.withColumns({"depth": F.lit(0).cast("bigint"), "digest": F.lit(b""), "n_bytes": F.lit(0).cast("bigint")}).select("conv_id", "rank", "depth", *turn)
    shared = told.select("conv_id", "rank", "size", F.inline("head")).withColumn("depth", F.col("pos") + 1).select("conv_id", "rank", "depth", *turn)
    rest = own.join(told.select("conv_id", "rank", "cut", "size", F.size("head").alias("lead")), "conv_id").where("pos >= cut")
    rest = rest.withColumn("depth", F.col("lead") + F.col("pos") - F.col("cut") + 1).select("conv_id", "rank", "depth", *turn)
    out = staged(tops.unionByName(shared).unionByName(rest), "rebuilt")
    released(out.sparkSession, turns, ranged, own, ids, told)
    return out


def identified(rows: DataFrame) -> DataFrame:
    """A written copy of the rebuilt rows with the id of each one's node and of its parent."""
    hashes = [F.when(F.col("depth") > 0, F.xxhash64(F.lit(i), "depth", "digest")).otherwise(0) for i in (1, 2)]
    lanes = [x for h in hashes for x in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    name = lambda sums, depth: F.unhex(F.md5(F.concat_ws(",", *sums, depth)))
    rows = scanned(rows.withColumns(dict(zip(LANES, lanes))), LANES)
    parent = F.when(F.col("depth") > 0, name([F.col(s) - x for s, x in zip(LANES, lanes)], F.col("depth") - 1))
    return staged(rows.select("conv_id", "rank", "depth", "digest", "n_bytes", "last", name(LANES, F.col("depth")).alias("id"), parent.alias("parent")), "steps")


def merged(rows: DataFrame, sizes: int, sums: dict[str, Column], least: dict[str, Column], most: dict[str, Column]) -> DataFrame:
    """One row a node of the partial tries of ``rows`` (id, rank): tables of FAN ranges are merged until one is left."""
    both = lambda f: {**{k: F.sum(f(k, x)) for k, x in sums.items()}, **{k: F.min(f(k, x)) for k, x in least.items()}, **{k: F.max(f(k, x)) for k, x in most.items()}}
    now = rows.groupBy("id", F.floor(F.col("rank") / PART).alias("range")).agg(*[x.alias(k) for k, x in both(lambda k, x: x).items()])
    ranges = -(-sizes // PART)
    while ranges > 1:
        now, ranges = staged(now, "tries"), -(-ranges // FAN)
        now = now.groupBy("id", F.floor(F.col("range") / FAN).alias("range")).agg(*[x.alias(k) for k, x in both(lambda k, x: F.col(k)).items()])
    return now.drop("range")


ENDS = "id binary, ends_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's runs, which come in order; one run is in memory at a time."""
    schema, node, state = arrow_schema(ENDS), None, None
    for batch in (b for x in batches for b in slices([x])):
        done = []
        for key, run in zip(batch["id"].to_pylist(), batch["run"].to_pylist()):
            if key != node:
                if state:
                    done.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(run.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], schema=schema)


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node; see the module and the columns of :func:`op12_prefix_trie`."""
    steps = identified(rebuilt(conversations))
    n = steps.where("depth = 0").count()
    turn = F.struct("parent", "digest", "depth", "n_bytes")
    nodes = merged(steps, n, {"n_convs": F.lit(1), "n_ends": F.col("last").cast("long")}, {"conv_id": F.col("conv_id"), "turn": turn}, {"other": turn})
    same = F.when(F.col("turn").eqNullSafe(F.col("other")), F.lit(True)).otherwise(F.raise_error(F.lit("two nodes share an id")).cast("boolean"))
    nodes = staged(nodes.where(same).select("id", "turn.parent", "turn.depth", "conv_id", "n_convs", "n_ends"), "nodes")
    owners = nodes.select("id", "conv_id", (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"))
    held = steps.join(owners, ["id", "conv_id"], "left").select("id", "conv_id", "rank", "depth", F.when(F.col("leaf").isNull(), F.col("n_bytes")).otherwise(0).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaves"))
    held = staged(held, "held")
    totals = merged(scanned(held, ["saved", "leaves"], up=True), n, {"saved_tokens": F.col("saved"), "n_leaves": F.col("leaves")}, {}, {})
    runs = steps.where("last").groupBy("id", F.floor(F.col("rank") / RUN).alias("at")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("run"))
    ends = runs.repartition("id").sortWithinPartitions("id", "at").select("id", "run").mapInArrow(_digests, ENDS)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(totals, "id").join(children, "id", "left").join(ends, "id", "left").join(parents, "parent", "left")
    none = hashlib.sha256().hexdigest()
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    return trie(table(spark, sf_dir, "conversations"))


ORACLE_SQL = f"""
WITH turns AS (SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, octet_length(encode(coalesce(text, ''))) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, conv_id - conv_id % {STEP} AS base, {CRC32.format('CAST(conv_id AS VARCHAR)')} % {HEAD} AS h, list({{'d': digest, 'b': bytes}} ORDER BY turn NULLS FIRST, digest) AS l FROM turns GROUP BY conv_id),
built AS (SELECT o.conv_id, list_concat(coalesce(b.l, [])[1:o.h], o.l[o.h + 1:]) AS l FROM own o LEFT JOIN own b ON b.conv_id = o.base),
steps AS (SELECT conv_id, l, unnest(range(len(l) + 1)) AS depth FROM built),
nodes AS (
  SELECT list_transform(l[1:depth], lambda x: x.d) AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(l[depth].b), 0) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = len(l)), '')) AS ends_sha256
  FROM steps GROUP BY ALL),
kids AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, up.conv_id AS parent_conv_id FROM nodes LEFT JOIN kids USING (p, depth) LEFT JOIN nodes up ON up.depth = nodes.depth - 1 AND up.p = nodes.p[1:nodes.depth - 1]),
below AS (SELECT v.p, count(*) FILTER (x.n_children = 0) AS n_leaves, CAST(sum((x.n_convs - 1) * x.bytes) AS BIGINT) AS saved_tokens FROM full_ v JOIN full_ x ON x.depth >= v.depth AND x.p[1:v.depth] = v.p GROUP BY v.p)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM full_ JOIN below USING (p)
"""
