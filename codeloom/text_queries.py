"""Queries over trees of paths and lines of text: work units, sections, passages; with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.guards import IGNORED_DIRECTORIES
from .operators import passages, worklist
from .queries import query, t
from .sources.sections import sections

# ---- S22, S23: lines of orders are files of a tree, by the brand and name of their part ----

_TREE = """'src/' || replace(p_brand, '#', '') || '/' || l_returnflag || '/' || (l_suppkey % 7) || CASE WHEN l_linenumber = 7 THEN '/vendor' WHEN l_linenumber = 6 THEN '/deep/er/and/deeper/still/yet' ELSE '' END || '/f' || l_orderkey || '.ts'"""


def tree_files(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").join(t(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    chains = t(spark, d, "supplier").select(F.expr("'lib/only/one/s' || (s_suppkey % 3) || '/' || s_suppkey || '.ts'").alias("path"))
    return lines.select(F.expr(_TREE).alias("path")).unionByName(chains)


_DIRS = f"""
w AS (SELECT DISTINCT path FROM (SELECT {_TREE} AS path FROM lineitem JOIN part ON p_partkey = l_partkey UNION ALL SELECT 'lib/only/one/s' || (s_suppkey % 3) || '/' || s_suppkey || '.ts' FROM supplier)),
f AS (SELECT path, string_split(path, '/')[1:-2] AS f FROM w WHERE len(list_intersect(string_split(path, '/')[1:-2], {IGNORED_DIRECTORIES})) = 0 AND NOT regexp_matches(path, '(^|/)\\.[^/]*/')),
u AS (SELECT path, f, unnest(range(1, len(f) + 1)) AS n FROM f),
n AS (SELECT array_to_string(f[1:n], '/') AS dir, count(*) FILTER (len(f) - n <= 8) AS n_files FROM u GROUP BY ALL),
c AS (SELECT array_to_string(string_split(dir, '/')[1:-2], '/') AS dir, dir AS child FROM n WHERE contains(dir, '/')),
dirs AS (SELECT n.dir, n_files, count(child) AS n_below FROM n LEFT JOIN c ON c.dir = n.dir GROUP BY ALL),
walk AS (
  SELECT dir, dir AS top, 0 AS level, n_below, n_files FROM dirs WHERE NOT contains(dir, '/')
  UNION ALL
  SELECT c.child, CASE WHEN w.n_below = 1 THEN w.top ELSE c.child END, w.level + 1, d.n_below, d.n_files FROM walk w JOIN c ON c.dir = w.dir JOIN dirs d ON d.dir = c.child WHERE w.level <= 6 AND w.n_below > 0 AND (w.n_below = 1 OR w.n_files > 150)),
units AS (SELECT DISTINCT CASE WHEN level > 6 THEN dir WHEN n_below = 0 THEN top ELSE dir END AS unit FROM walk WHERE level > 6 OR n_below = 0 OR (n_below > 1 AND n_files <= 150))"""


@query("s22_work_units", f"WITH RECURSIVE {_DIRS} SELECT unit FROM units")
def _(spark, d):
    return worklist.work_units(tree_files(spark, d), None)


@query("s23_unit_files", f"WITH RECURSIVE {_DIRS} SELECT unit, path FROM units JOIN u ON array_to_string(f[1:n], '/') = unit WHERE len(f) - n <= 8 QUALIFY row_number() OVER (PARTITION BY unit ORDER BY path) <= 300")
def _(spark, d):
    files = tree_files(spark, d)
    return worklist.unit_files(files, worklist.work_units(files, None))


# ---- X15: documents whose sentences begin sections and whose commas begin bullets ----


@query("x15_sections", r"""
WITH d AS (SELECT doc_id, regexp_replace(replace(text, ', ', chr(10) || '- '), '\. ([A-Z])', chr(10) || '## \1', 'g') AS x FROM documents),
l AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS raw, generate_subscripts(string_split(x, chr(10)), 1) AS n FROM d),
t AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM l),
m AS (SELECT *, CASE WHEN regexp_matches(line, '^##\s+.+$') THEN trim(regexp_extract(line, '^##\s+(.+)$', 1)) END AS name FROM t),
p AS (SELECT *, count(name) OVER (PARTITION BY doc_id ORDER BY n) AS part FROM m),
s AS (SELECT doc_id, part, max(name) AS section, list(raw ORDER BY n) FILTER (name IS NULL) AS raws, list(line ORDER BY n) FILTER (name IS NULL) AS lines FROM p WHERE part > 0 GROUP BY ALL),
k AS (SELECT * FROM s WHERE len(raws) > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY part DESC) = 1)
SELECT doc_id, section, regexp_replace(array_to_string(raws, chr(10)), '^\s+|\s+$', '', 'g') AS body, array_to_string(list_filter(lines, lambda x: length(x) > 0 AND NOT regexp_matches(x, '^[-*•]')), ' ') AS said,
list_filter(list_transform(list_filter(lines, lambda x: regexp_matches(x, '^[-*•]')), lambda x: trim(regexp_replace(x, '^[-*•]\s*', ''))), lambda x: x <> '')[1:4] AS bullets FROM k""")
def _(spark, d):
    text = F.regexp_replace(F.replace("text", F.lit(", "), F.lit("\n- ")), r"\. ([A-Z])", "\n## $1")
    return sections(t(spark, d, "documents").select("doc_id", text.alias("text")))


# ---- T18, X24: the second to fourth line of every twentieth document, spaced otherwise, against all documents ----

_ASKED = "WITH q AS (SELECT doc_id AS search, replace(array_to_string(string_split(text, chr(10))[2:4], chr(10)), ' ', '  ') AS passage FROM documents WHERE doc_id % 20 = 0)"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").where("doc_id % 20 = 0")  # the stated set of queries
    lines = F.array_join(F.slice(F.split("text", "\n"), 2, 3), "\n")
    return docs.select(F.col("doc_id").alias("search"), F.col("doc_id").alias("file"), F.replace(lines, F.lit(" "), F.lit("  ")).alias("passage"))


@query("t18_tolerant_matches", _ASKED + r""",
norm AS (SELECT doc_id AS file, text, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS l FROM documents WHERE text IS NOT NULL),
n AS (SELECT search, list_transform(string_split(passage, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS p FROM q WHERE passage IS NOT NULL),
b AS (SELECT search, p, list_filter(range(1, len(p) + 1), lambda i: p[i] <> '') AS full_ FROM n), s AS (SELECT search, p[full_[1]:full_[-1]] AS p FROM b WHERE len(full_) > 0),
lines AS (SELECT file, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM norm),
m AS (SELECT search, file, i, p, text FROM s JOIN lines ON lines.line = s.p[1] JOIN norm USING (file) WHERE l[i:i + len(p) - 1] = p),
f AS (SELECT search, file, min(i) AS i, count(*) AS n, any_value(p) AS p, any_value(text) AS text FROM m GROUP BY search, file)
SELECT search, file, CAST(i - 1 AS INTEGER) AS line, CAST(list_sum(list_append(list_transform(string_split(text, chr(10))[1:i - 1], lambda x: length(x) + 1), 0)) AS INTEGER) AS begins, CAST(length(array_to_string(string_split(text, chr(10))[i:i + len(p) - 1], chr(10))) AS BIGINT) AS n_chars, n FROM f""")
def _(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content"))
    return passages.tolerant_matches(docs, _asked(spark, d)).select("search", "file", F.col("at").alias("line"), F.col("start").alias("begins"), F.col("length").alias("n_chars"), "n")


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9_]+'), lambda w: length(w) >= 2))"


@query("x24_nearest_lines", _ASKED + rf""",
l AS (SELECT search, unnest(string_split(passage, chr(10))) AS raw, generate_subscripts(string_split(passage, chr(10)), 1) AS n FROM q),
a AS (SELECT search, {_WORDS.format('arg_min(raw, n)')} AS w FROM l WHERE length(regexp_replace(raw, '^\s+|\s+$', '', 'g')) >= 6 GROUP BY search),
d AS (SELECT doc_id AS search, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE doc_id % 20 = 0),
s AS (SELECT search, line, CAST(len(list_intersect(w, {_WORDS.format('raw')})) AS DOUBLE) / greatest(len(w), len({_WORDS.format('raw')})) AS likeness FROM a JOIN d USING (search) WHERE len(w) > 0)
SELECT search, CAST(line AS INTEGER) AS line, likeness FROM s WHERE likeness >= 0.4 QUALIFY row_number() OVER (PARTITION BY search ORDER BY likeness DESC, line) = 1""")
def _(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content"))
    return passages.nearest_lines(docs, _asked(spark, d)).select("search", F.col("at").alias("line"), "likeness")
