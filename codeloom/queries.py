"""Queries over the standard tables, one per operator family, and their DuckDB twins.

Documents stand for files (source is the root, lang the language), customers,
orders, parts and suppliers for graph nodes, pages for routes and calls, events for
commits and telemetry, conversations for memory, labels for facts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import guards, text
from .operators import graph, knowledge, retrieval, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TERMS = ["license", "the", "token"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The stated query of the vector searches: the vector of id 0."""
    return list(t(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


# ---- scalar functions ----


@query("x1_stable_ids", "SELECT doc_id, sha1(concat(source, '::', lang, '::', CAST(doc_id AS VARCHAR))) AS id, sha1(text) AS content_hash FROM documents")
def _(spark, d):
    docs = t(spark, d, "documents")
    return docs.select("doc_id", text.stable_id(F.col("source"), F.col("lang"), F.col("doc_id")).alias("id"), text.content_hash(F.col("text")).alias("content_hash"))


@query("x4_tokenize", "SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9а-яё_/-]+'), lambda x: length(x) >= 2) AS w FROM documents)")
def _(spark, d):
    words = t(spark, d, "documents").select("doc_id", text.tokenize(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query(
    "x5_score_groups",
    "SELECT doc_id, CAST(contains(lower(text), 'license') AS BIGINT) + CAST(contains(lower(text), 'the') AS BIGINT) + CAST(contains(lower(text), 'token') AS BIGINT) AS terms, CAST(contains(lower(text), 'license') AND contains(lower(text), 'version') AS BIGINT) + CAST(contains(lower(text), 'token') AND contains(lower(text), '=') AS BIGINT) AS groups FROM documents",
)
def _(spark, d):
    c = F.col("text")
    return t(spark, d, "documents").select("doc_id", text.score_text(c, TERMS).alias("terms"), text.score_groups(c, [["license", "version"], ["token", "="]]).alias("groups"))


@query("x12_estimate_tokens", "SELECT doc_id, greatest(20, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens, CAST(1 + length(left(text, 400)) - length(replace(left(text, 400), chr(10), '')) AS BIGINT) AS line_at_400 FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"), text.line_number(F.col("text"), F.lit(400)).cast("long").alias("line_at_400"))


@query("x13_excerpt", "SELECT doc_id, left(coalesce(list_filter(l, lambda x: contains(lower(x), 'license'))[1], l[1], ''), 280) AS excerpt FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents)")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", text.excerpt(F.col("text"), ["license"]).alias("excerpt"))


@query("x11_route_keys", r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]+', '') AS path FROM pages),
q AS (SELECT page_id, regexp_replace(path, '[?#].*$', '') AS path FROM p),
r AS (SELECT page_id, regexp_replace(regexp_replace(path, '\$\{[^}]*\}|\{[^}]*\}|:[A-Za-z_][A-Za-z0-9_]*', ':param', 'g'), '/[0-9]+(/|\.|$)', '/:param\1', 'g') AS path FROM q),
s AS (SELECT page_id, regexp_replace(path, '/+', '/', 'g') AS path FROM r)
SELECT page_id, CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/$', '') END AS route FROM s""")
def _(spark, d):
    path = F.regexp_replace("url", "^[a-z]+://[^/]+", "")
    return t(spark, d, "pages").select("page_id", text.route_key(path).alias("route"))


@query("x17_near_duplicates", r"""
WITH w AS (SELECT doc_id, lang, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS w FROM documents),
f AS (SELECT lang, arg_min(w, doc_id) AS w0 FROM w GROUP BY lang)
SELECT doc_id, least(len(w), len(w0)) > 0 AND len(list_intersect(w, w0)) >= 0.7 * least(len(w), len(w0)) AS near FROM w JOIN f USING (lang)""")
def _(spark, d):
    docs = t(spark, d, "documents")
    least = docs.groupBy("lang").agg(F.min("doc_id").alias("doc_id"))
    first = docs.join(F.broadcast(least), ["lang", "doc_id"]).groupBy("lang").agg(F.min_by("text", "doc_id").alias("first_text"))
    # a row a language, sent to the texts: a join by language would move all texts of one to one task
    return docs.join(F.broadcast(first), "lang").select("doc_id", text.near_duplicate(F.col("text"), F.col("first_text")).alias("near"))


# ---- scans and filters ----


@query("s3_overview", "SELECT source, lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def _(spark, d):
    return t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query("s20_grep", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS rn FROM l WHERE regexp_matches(line_text, '(?i)licen[cs]e'))
SELECT doc_id, CAST(line AS BIGINT) AS line, left(line_text, 220) AS line_text FROM m WHERE rn <= 2 ORDER BY doc_id, line LIMIT 25""")
def _(spark, d):
    return search.grep(t(spark, d, "documents"), "licen[cs]e").withColumn("line", F.col("line").cast("long"))


@query("a26_grep_counts", """
SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text FROM documents) WHERE regexp_matches(line_text, '(?i)the') GROUP BY doc_id""")
def _(spark, d):
    return search.grep(t(spark, d, "documents"), "the", per_file=2**31 - 1, top=None).groupBy("doc_id").agg(F.count("*").alias("hits"))


@query("f10_security_findings", r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
k AS (SELECT *, regexp_extract(s, '(?i)\b(?:api[_-]?key|apikey|secret|secret[_-]?key|password|passwd|access[_-]?token|auth[_-]?token|private[_-]?key|\w+[_-]?secret)\s*[:=]\s*["'']([^"'']{8,})["'']', 1) AS v FROM l),
f AS (SELECT doc_id, line, 'hardcoded-secret' AS category FROM k WHERE v <> '' AND NOT regexp_matches(v, '(?i)^(x{3}|your[-_]|example|change-?me|placeholder|dummy|fake|test|sample|000|<[^>]*>|\{\{.*\}\}|\.\.\.|%s|\$\{)') AND NOT regexp_matches(source, '(?i)(^|\W)(tests?|specs?|fixtures?|__tests__|__mocks__|mocks?|examples?)(\W|$)')
UNION ALL SELECT doc_id, line, 'bare-token' FROM l WHERE regexp_matches(s, '(?i)(^|\W)token\s*[=:]\s*["''][0-9a-f]{40}["'']')
UNION ALL SELECT doc_id, line, 'sql-injection' FROM l WHERE (regexp_matches(s, '(?i)\bselect\b[^;]*\bfrom\b') OR regexp_matches(s, '(?i)\binsert\s+into\b') OR regexp_matches(s, '(?i)\bupdate\b[^;]*\bset\b') OR regexp_matches(s, '(?i)\bdelete\s+from\b')) AND (regexp_matches(s, '["''`]\s*\.\s*\$\w+') OR regexp_matches(s, '\$\w+\s*\.\s*["''`]') OR regexp_matches(s, '["''`]\s*\+\s*\w+') OR regexp_matches(s, '\$\{[^}]+\}'))
UNION ALL SELECT doc_id, line, 'dangerous-eval' FROM l WHERE regexp_matches(s, '\b(eval|exec|system|shell_exec|passthru|proc_open|popen)\s*\(\s*(\$|["''`]\s*\.|`[^`]*\$\{)') OR regexp_matches(s, 'new\s+Function\s*\(')
UNION ALL SELECT doc_id, line, 'path-traversal' FROM l WHERE regexp_matches(s, '(?i)\b(fopen|file_get_contents|file_put_contents|readFileSync|require|include|include_once|require_once)\s*\([^)]*\$_(GET|POST|REQUEST|COOKIE)\b') OR regexp_matches(s, '(?i)\.\./[^"'']*\$_(GET|POST|REQUEST)\b'))
SELECT doc_id, CAST(line AS BIGINT) AS line, category FROM f""")
def _(spark, d):
    line = t(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("at", "s"))
    return line.select("doc_id", (F.col("at") + 1).cast("long").alias("line"), F.explode(guards.findings(F.col("s"), F.col("source"))).alias("category"))


# ---- search ----

_SIM = "round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6)"


@query("t1_vector_top", f"SELECT vec_id, {_SIM} AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 8")
def _(spark, d):
    return search.vector_top(t(spark, d, "embeddings"), first_vector(spark, d)).select("vec_id", "similarity")


@query("t2_vector_top_roles", f"SELECT vec_id, label, {_SIM} AS similarity FROM embeddings WHERE label IN (1, 3, 5) ORDER BY similarity DESC, vec_id LIMIT 8")
def _(spark, d):
    return search.vector_top(t(spark, d, "embeddings").where(F.col("label").isin(1, 3, 5)), first_vector(spark, d)).select("vec_id", "label", "similarity")


@query("t4_semantic_seeds", f"SELECT vec_id, similarity FROM (SELECT vec_id, {_SIM} AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 8) WHERE similarity >= 0.45 ORDER BY similarity DESC, vec_id LIMIT 3")
def _(spark, d):
    top = search.vector_top(t(spark, d, "embeddings"), first_vector(spark, d))
    return top.where("similarity >= 0.45").orderBy(F.col("similarity").desc(), "vec_id").limit(3).select("vec_id", "similarity")


@query("t3_hybrid_search", f"""
WITH v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM (SELECT vec_id, {_SIM} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 8)),
h AS (SELECT doc_id, CAST(contains(lower(text), 'license') AS BIGINT) + CAST(contains(lower(text), 'the') AS BIGINT) + CAST(contains(lower(text), 'token') AS BIGINT) AS hits FROM documents),
l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY hits DESC, doc_id) AS r FROM (SELECT * FROM h WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 8))
SELECT id, round(coalesce(1 / (60.0 + v.r), 0) + coalesce(1 / (60.0 + l.r), 0), 8) AS score FROM v FULL JOIN l USING (id) ORDER BY score DESC, id LIMIT 8""")
def _(spark, d):
    a = search.ranked(search.vector_top(t(spark, d, "embeddings"), first_vector(spark, d)), "vec_id", F.col("similarity").desc(), F.col("vec_id"))
    b = search.ranked(search.lexical_top(t(spark, d, "documents"), TERMS), "doc_id", F.col("hits").desc(), F.col("doc_id"))
    return search.fuse(a, b)


# The same searches for every vector whose id is divisible by 20, against all rows.


def _set_sql(where: str = "TRUE") -> str:
    sim = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"
    return f"top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM (SELECT q.vec_id AS query_id, e.vec_id, e.label, {sim} AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND {where}) QUALIFY r <= 8)"


def _set_top(spark: SparkSession, d: str, *labels: int) -> DataFrame:
    rows = t(spark, d, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.vector_top_set(rows.where(F.col("label").isin(*labels)) if labels else rows, asked).withColumnRenamed("id", "vec_id")


@query("t1_vector_top_set", f"WITH {_set_sql()} SELECT query_id, vec_id, similarity FROM top")
def _(spark, d):
    return _set_top(spark, d).select("query_id", "vec_id", "similarity")


@query("t2_vector_top_roles_set", f"WITH {_set_sql('e.label IN (1, 3, 5)')} SELECT query_id, vec_id, label, similarity FROM top")
def _(spark, d):
    return _set_top(spark, d, 1, 3, 5).join(t(spark, d, "embeddings").select("vec_id", "label"), "vec_id").select("query_id", "vec_id", "label", "similarity")


@query("t4_semantic_seeds_set", f"WITH {_set_sql()} SELECT query_id, vec_id, similarity FROM top WHERE similarity >= 0.45 AND r <= 3")
def _(spark, d):
    return _set_top(spark, d).where("similarity >= 0.45 AND rank <= 3").select("query_id", "vec_id", "similarity")


@query("t3_hybrid_search_set", f"""
WITH {_set_sql()},
h AS (SELECT doc_id, CAST(contains(lower(text), 'license') AS BIGINT) + CAST(contains(lower(text), 'the') AS BIGINT) + CAST(contains(lower(text), 'token') AS BIGINT) AS hits FROM documents),
l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY hits DESC, doc_id) AS r FROM (SELECT * FROM h WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 8)),
b AS (SELECT query_id, vec_id AS id, 1 / (60.0 + r) AS part FROM top UNION ALL SELECT query_id, id, 1 / (60.0 + r) FROM l, (SELECT DISTINCT query_id FROM top)),
s AS (SELECT query_id, id, round(sum(part), 8) AS score FROM b GROUP BY ALL)
SELECT query_id, id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 8""")
def _(spark, d):
    top = _set_top(spark, d)
    words = search.ranked(search.lexical_top(t(spark, d, "documents"), TERMS), "doc_id", F.col("hits").desc(), F.col("doc_id"))
    part = (1 / (F.lit(60.0) + F.col("rank"))).alias("part")
    lexical = top.select("query_id").distinct().crossJoin(F.broadcast(words)).select("query_id", "id", part)  # eight rows
    fused = top.select("query_id", F.col("vec_id").alias("id"), part).unionByName(lexical).groupBy("query_id", "id").agg(F.round(F.sum("part"), 8).alias("score"))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return fused.withColumn("rn", rn).where("rn <= 8").select("query_id", "id", "score")


@query("a25_spread_over_sources", "SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source, doc_id LIMIT 50")
def _(spark, d):
    return search.spread_over(t(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 50).select("doc_id", "source", F.col("turn").cast("long").alias("turn"))


# ---- graph ----

_NODES = """nodes AS (
SELECT 'r' || r_regionkey AS id, 'region' AS kind, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation
UNION ALL SELECT 'c' || c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name FROM supplier
UNION ALL SELECT 'p' || p_partkey, 'part', p_name FROM part UNION ALL SELECT 'o' || o_orderkey, 'order', o_orderstatus FROM orders)"""
_EDGES = """edges AS (
SELECT 'BELONGS_TO' AS type, 'n' || n_nationkey AS source_id, 'r' || n_regionkey AS target_id FROM nation
UNION ALL SELECT 'BELONGS_TO', 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'BELONGS_TO', 's' || s_suppkey, 'n' || s_nationkey FROM supplier
UNION ALL SELECT 'REFERENCES', 'o' || o_orderkey, 'c' || o_custkey FROM orders
UNION ALL SELECT DISTINCT 'USES', 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION ALL SELECT DISTINCT 'DEPENDS_ON', 'p' || l_partkey, 's' || l_suppkey FROM lineitem)"""
_BOTH = "step AS (SELECT source_id AS a, target_id AS b, type FROM edges UNION ALL SELECT target_id, source_id, type FROM edges)"


def _node(df: DataFrame, prefix: str, key: str, kind: str, label: str) -> DataFrame:
    return df.select(F.concat(F.lit(prefix), F.col(key)).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"))


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key))


#: Prefixes of ids, by number; a keyed id is a long, its prefix's number above the 48 bits of its key.
_PREFIXES = "rncspo"


def _keyed(prefix: str, key: str) -> Column:
    return F.lit(_PREFIXES.index(prefix) << 48) + F.col(key).cast("long")


def _named(keyed: str) -> Column:
    """The id that a keyed one stands for."""
    prefix = F.element_at(F.array(*map(F.lit, _PREFIXES)), (F.shiftright(keyed, 48) + 1).cast("int"))
    return F.concat(prefix, F.col(keyed).bitwiseAND(F.lit((1 << 48) - 1)).cast("string"))


#: Digits of a key that :func:`ordered_id` holds.
_DIGITS = 14


def ordered_id(prefix: str, key: str) -> Column:
    """Like :func:`_keyed`, a long that sorts as the id does: prefixes by letter, then the digits from the left, then how many there are."""
    digits = F.col(key).cast("string")
    return F.lit(sorted(_PREFIXES).index(prefix) << 52) + F.rpad(digits, _DIGITS, "0").cast("long") * 16 + F.length(digits)


def ordered_name(ordered: str) -> Column:
    prefix = F.element_at(F.array(*map(F.lit, sorted(_PREFIXES))), (F.shiftright(ordered, 52) + 1).cast("int"))
    digits = F.lpad(F.shiftright(F.col(ordered).bitwiseAND(F.lit((1 << 52) - 1)), 4).cast("string"), _DIGITS, "0")
    return F.concat(prefix, F.substring(digits, F.lit(1), F.col(ordered).bitwiseAND(F.lit(15)).cast("int")))


def _edge(df: DataFrame, type_: str, p: str, a: str, q: str, b: str, id_: Callable[[str, str], Column] = _id) -> DataFrame:
    return df.select(F.lit(type_).alias("type"), id_(p, a).alias("source_id"), id_(q, b).alias("target_id"))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    out = _node(t(spark, d, "region"), "r", "r_regionkey", "region", "r_name")
    for table, p, k, kind, label in (("nation", "n", "n_nationkey", "nation", "n_name"), ("customer", "c", "c_custkey", "customer", "c_name"), ("supplier", "s", "s_suppkey", "supplier", "s_name"), ("part", "p", "p_partkey", "part", "p_name"), ("orders", "o", "o_orderkey", "order", "o_orderstatus")):
        out = out.unionByName(_node(t(spark, d, table), p, k, kind, label))
    return out


def graph_edges(spark: SparkSession, d: str, repeats: bool = False, id_: Callable[[str, str], Column] = _id) -> DataFrame:
    """Edges of the tables; with ``repeats`` a part's or supplier's as often as items have it, for what asks only whether there is one; ``id_`` makes the ids."""
    item = t(spark, d, "lineitem")
    out = _edge(t(spark, d, "nation"), "BELONGS_TO", "n", "n_nationkey", "r", "n_regionkey", id_)
    out = out.unionByName(_edge(t(spark, d, "customer"), "BELONGS_TO", "c", "c_custkey", "n", "c_nationkey", id_)).unionByName(_edge(t(spark, d, "supplier"), "BELONGS_TO", "s", "s_suppkey", "n", "s_nationkey", id_))
    out = out.unionByName(_edge(t(spark, d, "orders"), "REFERENCES", "o", "o_orderkey", "c", "o_custkey", id_))
    # distinct by keys, which are narrower than the ids made of them
    uses, needs = item.select("l_orderkey", "l_partkey"), item.select("l_partkey", "l_suppkey")
    uses, needs = (uses, needs) if repeats else (uses.distinct(), needs.distinct())
    return out.unionByName(_edge(uses, "USES", "o", "l_orderkey", "p", "l_partkey", id_)).unionByName(_edge(needs, "DEPENDS_ON", "p", "l_partkey", "s", "l_suppkey", id_))


@query("a1_graph_summary", f"WITH {_NODES}, {_EDGES} SELECT 'node' AS what, kind AS name, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY ALL")
def _(spark, d):
    return graph.summary(graph_nodes(spark, d), graph_edges(spark, d))


@query("j5_typed_neighbors", f"WITH {_NODES}, {_EDGES}, {_BOTH} SELECT DISTINCT a AS start_id, nodes.* FROM step JOIN nodes ON b = id WHERE a IN (SELECT id FROM nodes WHERE kind = 'nation') AND type = 'BELONGS_TO'")
def _(spark, d):
    nodes = graph_nodes(spark, d)
    return graph.neighbors(nodes, graph_edges(spark, d), graph.nodes_of(nodes, "nation"), "both", ("BELONGS_TO",)).select("start_id", "id", "kind", "label")


@query("j3_two_hop", f"WITH {_EDGES} SELECT DISTINCT u.source_id AS order_id, v.target_id AS supplier_id FROM edges u JOIN edges v ON u.target_id = v.source_id WHERE u.type = 'USES' AND v.type = 'DEPENDS_ON'")
def _(spark, d):
    edges = graph_edges(spark, d, id_=_keyed)
    u = graph.edges_of(edges, "USES").select(F.col("source_id").alias("at"), F.col("target_id").alias("via"))
    v = graph.edges_of(edges, "DEPENDS_ON").select(F.col("source_id").alias("via"), F.col("target_id").alias("to"))
    return graph.two_hops(u, v).select(_named("at").alias("order_id"), _named("to").alias("supplier_id"))


@query("j10_module_dependencies", f"""
WITH {_EDGES}, m AS (SELECT 'c' || c_custkey AS id, c_mktsegment AS module FROM customer UNION ALL SELECT 'o' || o_orderkey, o_orderpriority FROM orders UNION ALL SELECT 'p' || p_partkey, p_brand FROM part)
SELECT DISTINCT a.module AS source, b.module AS target, type FROM edges JOIN m a ON a.id = source_id JOIN m b ON b.id = target_id WHERE a.module <> b.module""")
def _(spark, d):
    m = t(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("module"))
    m = m.unionByName(t(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("module"))).unionByName(t(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_brand").alias("module")))
    return graph.module_dependencies(graph_edges(spark, d), m)


@query("g1_traverse", f"""
WITH RECURSIVE {_EDGES}, {_BOTH},
r AS (SELECT 'r0' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN step ON a = id WHERE depth < 2 AND type = 'BELONGS_TO')
SELECT id, min(depth) AS depth FROM r GROUP BY id""")
def _(spark, d):
    nodes = graph_nodes(spark, d)
    return graph.traverse(graph_edges(spark, d), nodes.where("id = 'r0'"), 2, ("BELONGS_TO",))


def _all_orders(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select(_keyed("o", "o_orderkey").alias("id"))


_REACHED = f"""WITH RECURSIVE {_EDGES},
r AS (SELECT 'o' || o_orderkey AS start_id, 'o' || o_orderkey AS id, 0 AS depth FROM orders UNION SELECT start_id, target_id, depth + 1 FROM r JOIN edges ON source_id = id WHERE depth < %d)"""


@query("g2_reachability", _REACHED % 4 + " SELECT start_id, id, min(depth) AS depth FROM r GROUP BY ALL")
def _(spark, d):
    found = graph.reachability(graph_edges(spark, d, id_=_keyed), _all_orders(spark, d), 4)
    return found.select(_named("start_id").alias("start_id"), _named("id").alias("id"), "depth")


@query("a7_fan_in", _REACHED % 3 + " SELECT id, count(DISTINCT start_id) AS n_starts FROM r WHERE id LIKE 's%' GROUP BY id")
def _(spark, d):
    suppliers = t(spark, d, "supplier").select(_keyed("s", "s_suppkey").alias("id"), F.lit("supplier").alias("kind"))
    return graph.fan_in_within(graph_edges(spark, d, id_=_keyed), _all_orders(spark, d), suppliers, "supplier", 3).select(_named("id").alias("id"), "n_starts")


@query("j9_link_calls", r"""
WITH r AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1) AS key FROM pages), last AS (SELECT key, max(page_id) AS route_id FROM r GROUP BY key),
c AS (SELECT doc_id, lang AS key FROM documents)
SELECT doc_id AS call_id, route_id, key FROM c JOIN last USING (key)""")
def _(spark, d):
    routes = t(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)", 1).alias("key"), F.col("page_id").alias("ord"))
    return graph.link_calls(t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("key")), routes)


@query("s12_anchors", r"""
SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""")
def _(spark, d):
    a = t(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return a.groupBy("page_id", "href").agg(F.count("*").alias("n"))


# The labelled documents stand for the current state, toxic ones as changed; all documents for the earlier one.
_STATES = "p AS (SELECT doc_id AS id, source AS file_path, sha1(text) AS hash FROM documents), c AS (SELECT doc_id AS id, source AS file_path, CASE WHEN toxic = 1 THEN 'x' ELSE sha1(text) END AS hash FROM documents JOIN labels USING (doc_id))"


def states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = t(spark, d, "documents")
    now = docs.join(t(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"), F.when(F.col("toxic") == 1, F.lit("x")).otherwise(F.sha1("text")).alias("hash"))
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"), F.sha1("text").alias("hash")), now


@query("j15_merge_graph", f"WITH {_STATES} SELECT * FROM c UNION ALL SELECT * FROM p WHERE file_path NOT IN ('src1', 'src2') AND id NOT IN (SELECT id FROM c)")
def _(spark, d):
    return graph.merge_graph(*states(spark, d), spark.createDataFrame([("src1",), ("src2",)], "path string"))


# ---- knowledge, memory, telemetry ----


@query("j14_snapshot_diff", f"WITH {_STATES} SELECT count(*) FILTER (p.id IS NULL) AS added, count(*) FILTER (c.id IS NULL) AS removed, count(*) FILTER (p.hash <> c.hash) AS changed, count(*) FILTER (p.hash = c.hash) AS reused FROM p FULL JOIN c ON p.id = c.id")
def _(spark, d):
    return knowledge.snapshot_diff(*states(spark, d))


@query("j21_fact_status", f"WITH {_STATES} SELECT p.file_path AS id, bool_or(coalesce(p.hash = c.hash, false)) AS valid, NOT bool_and(coalesce(p.hash = c.hash, false)) AS stale_any FROM p LEFT JOIN c ON p.id = c.id GROUP BY p.file_path")
def _(spark, d):
    before, now = states(spark, d)
    return knowledge.fact_status(before.select(F.col("file_path").alias("id"), F.col("id").alias("path"), "hash"), now.select(F.col("id").alias("path"), "hash"))


@query("a14_merge_facts", """
WITH b AS (SELECT source AS id, quality AS confidence, lang FROM documents JOIN labels USING (doc_id))
SELECT id, max(confidence) AS confidence, list_sort(list(DISTINCT lang)) AS paths FROM b GROUP BY id""")
def _(spark, d):
    facts = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select(F.col("source").alias("id"), F.col("quality").alias("confidence"), F.array("lang").alias("paths"), "toxic")
    return knowledge.merge_facts(facts.where("toxic = 1").drop("toxic"), facts.where("not coalesce(toxic = 1, false)").drop("toxic"))


@query("a15_merge_glossary", "SELECT source AS project, lower(lang) AS term, arg_max(sha1(text), (quality, doc_id)) AS definition, max(quality) AS confidence FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def _(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    return knowledge.merge_glossary(rows.select(F.col("source").alias("project"), F.upper("lang").alias("term"), F.sha1("text").alias("definition"), F.col("quality").alias("confidence"), F.col("doc_id").alias("seq")))


@query("w1_latest_turn", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def _(spark, d):
    return knowledge.latest(t(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


@query("w3_memory_tail", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6")
def _(spark, d):
    return knowledge.tail(t(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


@query("a6_churn", "SELECT user_id AS file, count(*) AS commits, count(*) FILTER (event_type = 'error') AS fixes, count(*) + 2 * count(*) FILTER (event_type = 'error') AS churn FROM events GROUP BY user_id")
def _(spark, d):
    return knowledge.churn(t(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("subject")))


@query("t13_hot_files", "SELECT user_id AS file, count(*) FILTER (event_type = 'error') AS fixes FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'error') >= 2 ORDER BY fixes DESC, file LIMIT 3")
def _(spark, d):
    c = knowledge.churn(t(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("subject")))
    return c.where("fixes >= 2").orderBy(F.col("fixes").desc(), "file").limit(3).select("file", "fixes")


@query("a11_usage_rollup", "SELECT event_type AS role, count(*) AS calls, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY ROLLUP (event_type)")
def _(spark, d):
    return knowledge.usage(t(spark, d, "events").select(F.col("event_type").alias("role"), F.get_json_object("props", "$.k").cast("long").alias("tokens")))


@query("a12_progress", "SELECT count(*) FILTER (quality = 1) AS fresh, count(*) AS total, CAST(floor(100 * count(*) FILTER (quality = 1) / count(*) + 0.5) AS BIGINT) AS percent FROM labels")
def _(spark, d):
    return knowledge.progress(t(spark, d, "labels").select((F.col("quality") == 1).alias("fresh")))


@query("r9_daily_usage", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    from .streaming.telemetry import daily_usage

    return daily_usage(t(spark, d, "events"))


# ---- candidates, evidence and states ----

HINTS = [("licenseversion", ["license", "version"]), ("token", ["token"]), ("", ["apache", "zzz"])]


def _strength(compact: str, parts: list[str]) -> str:
    has = [f"contains(low, '{p}')" for p in parts]
    return f"CASE WHEN {f'contains(low, {chr(39)}{compact}{chr(39)})' if compact else 'false'} THEN 3 WHEN {len(parts) >= 2} AND {' AND '.join(has)} THEN 2 WHEN {' OR '.join(has)} THEN 1 ELSE 0 END"


@query("x9_entity_strength", f"SELECT doc_id, greatest({', '.join(_strength(*h) for h in HINTS)}) AS strength FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", retrieval.entity_strength(F.col("text"), HINTS).alias("strength"))


@query(
    "j17_known_facts",
    "SELECT p_partkey AS path, p_size + CASE WHEN n > 0 THEN 6 ELSE 0 END AS score, coalesce(n, 0) AS n_facts, first_fact FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n, min(l_orderkey) AS first_fact FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey",
)
def _(spark, d):
    facts = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("fact_id")).agg(F.collect_set("l_partkey").alias("paths"))  # an order has a few lines
    return retrieval.apply_known_facts(t(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("score")), facts).select("path", "score", "n_facts", "first_fact")


@query(
    "u4_dedupe_candidates",
    "SELECT type, path, label, score, ord FROM (SELECT *, row_number() OVER (PARTITION BY type, coalesce(path, label) ORDER BY score DESC, ord) AS rn FROM (SELECT lang AS type, CASE WHEN n_chars % 3 = 0 THEN NULL ELSE source END AS path, source AS label, n_chars AS score, doc_id AS ord FROM documents)) WHERE rn = 1",
)
def _(spark, d):
    docs = t(spark, d, "documents")
    path = F.when(F.col("n_chars") % 3 == 0, F.lit(None)).otherwise(F.col("source"))
    return retrieval.dedupe_candidates(docs.select(F.col("lang").alias("type"), path.alias("path"), F.col("source").alias("label"), F.col("n_chars").alias("score"), F.col("doc_id").alias("ord")))


_PRIORITY_SQL = "CASE WHEN o_orderpriority = '1-URGENT' THEN 'critical' WHEN o_orderpriority = '2-HIGH' THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'supporting' ELSE 'other' END"


@query("t7_ranked_candidates", f"SELECT score, priority, tokens, label FROM (SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS score, {_PRIORITY_SQL} AS priority, o_custkey AS tokens, CAST(o_orderkey AS VARCHAR) AS label FROM orders) ORDER BY score DESC, CASE priority WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'supporting' THEN 1 ELSE 0 END DESC, tokens, label LIMIT 40")
def _(spark, d):
    priority = F.expr(_PRIORITY_SQL)
    orders = t(spark, d, "orders").select(F.floor(F.col("o_totalprice") / 50000).alias("score"), priority.alias("priority"), F.col("o_custkey").alias("tokens"), F.col("o_orderkey").cast("string").alias("label"))
    return retrieval.rank_candidates(orders, 40)


@query(
    "w4_baseline",
    "SELECT custkey, orderkey, tier FROM (SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY tier, day DESC, orderkey) AS rn FROM (SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_orderdate AS day, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS tier FROM orders)) WHERE rn = 1",
)
def _(spark, d):
    orders = t(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderdate").alias("day"), "o_orderstatus", "o_orderpriority")
    tiers = [(F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"), F.col("o_orderstatus") == "O"]
    return retrieval.best_by_tier(orders, "custkey", tiers, "day", "orderkey").select("custkey", "orderkey", "tier")


@query("x21_fingerprint", "SELECT l_orderkey AS orderkey, sha1(string_agg(part, chr(10) ORDER BY part)) AS fingerprint FROM (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) || ':' || l_returnflag AS part FROM lineitem) GROUP BY l_orderkey")
def _(spark, d):
    items = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.concat_ws(":", F.col("l_partkey").cast("string"), "l_returnflag").alias("part"))
    return retrieval.fingerprint(items, "orderkey", F.col("part"))


@query("f9_prefers_selective", "SELECT o_orderkey AS orderkey, o_totalprice > 100000 AND o_orderstatus <> 'P' AND NOT o_orderpriority = '5-LOW' AND o_custkey > 0 AND o_custkey <= 150 AS selective FROM orders")
def _(spark, d):
    profile = F.when(F.col("o_totalprice") > 100000, "large-repository").otherwise("plain")
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), retrieval.prefers_selective(profile, F.col("o_orderstatus") != "P", F.col("o_orderpriority") == "5-LOW", F.col("o_custkey")).alias("selective"))


@query("j16_deleted_paths", "SELECT DISTINCT l_partkey AS path FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') UNION SELECT p_partkey FROM part WHERE p_size = 7")
def _(spark, d):
    items = t(spark, d, "lineitem").select(F.col("l_partkey").alias("path"), "l_returnflag")
    return retrieval.deleted_paths(items.where("l_returnflag = 'R'"), items.where("l_returnflag = 'A'"), t(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("path")))


@query("a3_change_summary", "SELECT o_orderstatus AS scope, o_orderpriority AS type, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, d):
    return knowledge.change_summary(t(spark, d, "orders").select(F.col("o_orderstatus").alias("scope"), F.col("o_orderpriority").alias("type")))


@query("w2_replay", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal, role FROM conversations")
def _(spark, d):
    return knowledge.replay(t(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.col("ordinal").cast("long").alias("ordinal"), "role")


@query("a5_module_relations", f"WITH {_NODES}, {_EDGES} SELECT source_id AS module_id, 'outgoing' AS direction, target_id AS other_id, label FROM edges JOIN nodes ON id = target_id WHERE type = 'DEPENDS_ON' AND source_id IN (SELECT id FROM nodes WHERE kind = 'part') UNION ALL SELECT target_id, 'incoming', source_id, label FROM edges JOIN nodes ON id = source_id WHERE type = 'DEPENDS_ON' AND target_id IN (SELECT id FROM nodes WHERE kind = 'part')")
def _(spark, d):
    nodes = graph_nodes(spark, d)
    return retrieval.module_relations(nodes, graph_edges(spark, d), graph.nodes_of(nodes, "part"))


@query("f3_node_by_id", f"WITH {_NODES} SELECT id, kind, label FROM nodes WHERE id = 'c1'")
def _(spark, d):
    return graph_nodes(spark, d).where(F.col("id") == "c1")


from . import code_queries, focus_queries, state_queries, text_queries  # noqa: E402,F401  they register their own
