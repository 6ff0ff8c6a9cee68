"""Queries over questions, evidence, refreshes, plans and graph views, with their DuckDB twins.

Whole tables are read, as :mod:`codeloom.queries` does.  Where a rule is about words, paths or
commands that no table has, they are made from the rows of one: Latin words spelt in
Cyrillic letters, paths and commands of stated patterns around a row's own values.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules, words
from .operators import evidence, graph, planning, questions, refresh
from .queries import _EDGES, _NODES, _STATES, graph_edges, graph_nodes, query, states, t
from .streaming import monitor


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _pick(number: str, patterns: list[str]) -> str:
    """SQL for the pattern that a number chooses; {0}, {1} in it are columns.  Spark and DuckDB read it alike."""
    whens = []
    for k, p in enumerate(patterns):
        parts = [x if n % 2 else _text(x) for n, x in enumerate(re.split(r"[{}]", p)) if n % 2 or x]
        whens.append(f"WHEN {k} THEN {' || '.join(parts or [_text('')])}")
    return f"CASE {number} % {len(patterns)} {' '.join(whens)} END"


# ---- words, names and paths ----

LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшыюз"
#: Starts of borrowed words that are put before a third of the words, else there are none.
STARTS = ["", "", "сервис", "", "", "токен", "", "", "юзер"]
PATHS = [
    "app/src/Containers/{source}/Models/{lang}.php", "app/src/Ship/{source}.php", "resources/lang/{lang}/auth.php", "resources/views/{source}/index.vue", "database/migrations/{source}.php", "routes/{source}.php", "packages/{source}/src/index.ts", "", "/lang/{lang}/x.json", "web/Locales/{lang}.json", "config/{source}.php", ".env", "a/.env.{lang}",
    "app/Http/Controllers/{source}Controller.php", "app/Services/ServerCredential.php", "src/models/Password{source}.php", "docs/{source}.md", "src/{lang}.test.ts", "app/Enums/{source}.php", "app/Repositories/User{lang}.php", "app/Structural/{source}/../{lang}.php", "{source}/forwarding/Port{lang}.ts", "{lang}",
]
COMMANDS = ["git push {o_orderstatus}", "git status", "rm -rf {o_orderstatus}", "rm {o_orderstatus}", "php artisan migrate", "php artisan migrate:status", "php artisan migrate:seed", "php artisan migrate --pretend", "npm ci", "npm run {o_orderstatus}", "docker compose up -d", "docker ps", "DROP TABLE {o_orderstatus}", "sudo ls", "composer install --dry-run", "artisan migrate:{o_orderpriority}", "git {o_orderpriority}"]
_SQL_WORDS = f"(SELECT DISTINCT {_pick('length(w)', STARTS)} || translate(w, '{LATIN}', '{CYRILLIC}') AS x FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) q)"
_SQL_PATHS = f"(SELECT doc_id, {_pick('doc_id', PATHS)} AS x FROM documents)"


def _words(spark: SparkSession, d: str) -> DataFrame:
    words_ = t(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    return words_.select(F.concat(F.expr(_pick("length(w)", STARTS)), F.translate("w", LATIN, CYRILLIC)).alias("x")).distinct()


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.expr(_pick("doc_id", PATHS)).alias("x"))


@query("x8_stems", f"SELECT x, coalesce(list_filter(list_transform([{', '.join(map(_text, words.ENDINGS))}], lambda e: CASE WHEN ends_with(x, e) AND length(x) - length(e) >= 4 THEN left(x, length(x) - length(e)) END), lambda y: y IS NOT NULL)[1], x) AS stem FROM {_SQL_WORDS}")
def _(spark, d):
    return _words(spark, d).select("x", words.stem(F.col("x")).alias("stem"))


_STEMS = ", ".join(f"({_text(a)}, {_text(b)})" for a, b in words.BORROWED)


@query("x6_transliterated", f"SELECT x, list_sort(list_distinct(list_append(coalesce(list(latin) FILTER (latin IS NOT NULL), []), x))) AS tokens FROM {_SQL_WORDS} LEFT JOIN (VALUES {_STEMS}) s(stem, latin) ON starts_with(x, stem) GROUP BY x")
def _(spark, d):
    return _words(spark, d).select("x", F.array_sort(words.transliterate(F.array("x"))).alias("tokens"))


@query("x7_compound_groups", r"SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(x, '[^A-Za-z0-9_/-]+'), lambda w: array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9а-яё]+'), lambda p: length(p) >= 2), '+')), lambda g: contains(g, '+')) AS groups FROM (SELECT conv_id, turn, text AS x FROM conversations UNION ALL SELECT -o_orderkey, NULL, 'place' || replace(o_orderpriority, '-', '_') || 'By' || o_orderstatus || ' get_' || lower(o_orderstatus) || 'Of2' FROM orders)")
def _(spark, d):
    said = t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("x"))
    made = F.concat(F.lit("place"), F.replace("o_orderpriority", F.lit("-"), F.lit("_")), F.lit("By"), "o_orderstatus", F.lit(" get_"), F.lower("o_orderstatus"), F.lit("Of2"))
    made = t(spark, d, "orders").select((-F.col("o_orderkey")).alias("conv_id"), F.lit(None).cast("long").alias("turn"), made.alias("x"))
    return said.unionByName(made).select("conv_id", "turn", F.transform(words.compound_groups(F.col("x")), lambda g: F.array_join(g, "+")).alias("groups"))


@query("x10_path_labels", f"""
WITH p AS (SELECT doc_id, x, list_filter(string_split(x, '/'), lambda s: s <> '') AS p FROM {_SQL_PATHS}),
q AS (SELECT *, list_transform(p, lambda s: lower(s)) AS l FROM p)
SELECT doc_id, x, CASE WHEN p[1] = 'app' AND p[2] = 'src' AND p[3] = 'Containers' AND p[4] IS NOT NULL THEN 'containers:' || p[4] WHEN p[1] = 'app' AND p[2] = 'src' AND p[3] = 'Ship' THEN 'ship'
WHEN p[1] = 'resources' AND p[2] = 'lang' AND p[3] IS NOT NULL THEN 'localization:' || p[3] WHEN p[1] = 'resources' AND p[2] = 'views' AND p[3] IS NOT NULL THEN 'views:' || p[3]
WHEN p[1] IN ('database', 'routes') AND p[2] IS NOT NULL THEN p[1] || ':' || p[2] ELSE coalesce(p[1], 'root') END AS module,
coalesce(CASE WHEN list_contains(l, 'lang') THEN p[list_position(l, 'lang') + 1] END, CASE WHEN list_contains(l, 'locales') THEN p[list_position(l, 'locales') + 1] END) AS bucket,
CASE WHEN len(p) = 0 THEN 'root' ELSE array_to_string(p[1:3], '/') END AS planning FROM q""")
def _(spark, d):
    x = F.col("x")
    return _paths(spark, d).select("doc_id", "x", words.module_label(x).alias("module"), words.localization_bucket(x).alias("bucket"), words.planning_label(x).alias("planning"))


@query("f7_path_classes", f"""
WITH p AS (SELECT doc_id, x, lower(x) AS l FROM {_SQL_PATHS})
SELECT doc_id, x, starts_with(l, 'lang/') OR contains(l, '/lang/') OR starts_with(l, 'locales/') OR contains(l, '/locales/') OR contains(l, '/i18n/') OR contains(l, '/translations/') AS localization,
starts_with(l, 'config/') OR contains(l, '/config/') OR ends_with(l, '.env') OR contains(l, '.env.') AS config,
contains(l, '/servers/') OR contains(l, '/vault/') OR contains(l, '/migrations/') OR contains(l, '/repositories/') OR contains(l, '/requests/') OR contains(l, '/models/server') OR contains(l, '/models/password') OR (contains(l, 'server') AND contains(l, 'credential')) OR (contains(l, 'forwarding') AND contains(l, 'port')) AS storage FROM p""")
def _(spark, d):
    x = F.col("x")
    return _paths(spark, d).select("doc_id", "x", words.is_localization(x).alias("localization"), words.is_config(x).alias("config"), words.is_storage(x).alias("storage"))


@query("x28_path_points", f"""
WITH p AS (SELECT doc_id, x, lower(x) AS l FROM {_SQL_PATHS})
SELECT doc_id, x, CASE WHEN regexp_matches(l, '^(app|src|lib|packages)/') THEN 10 ELSE 0 END + CASE WHEN contains(l, '/src/') THEN 12 ELSE 0 END + CASE WHEN contains(l, 'user') THEN 22 ELSE 0 END
- CASE WHEN contains(l, '/test') OR contains(l, '.test.') OR contains(l, '.spec.') THEN 20 ELSE 0 END - CASE WHEN contains(l, '/docs/') OR ends_with(l, '.md') THEN 16 ELSE 0 END AS points,
CASE WHEN contains(l, '/routes/') THEN 28 ELSE 0 END + CASE WHEN contains(l, '/controllers/') THEN 24 ELSE 0 END + CASE WHEN contains(l, '/services/') OR contains(l, '/actions/') THEN 18 ELSE 0 END + CASE WHEN contains(l, '/requests/') OR contains(l, '/middleware/') THEN 14 ELSE 0 END
+ CASE WHEN contains(l, '/models/') THEN 10 ELSE 0 END - CASE WHEN contains(l, '/lang/') OR contains(l, '/config/') THEN 12 ELSE 0 END + CASE WHEN contains(l, 'route') OR contains(l, 'controller') OR contains(l, 'login') OR contains(l, 'auth') THEN 12 ELSE 0 END AS entry_points FROM p""")
def _(spark, d):
    x = F.col("x")
    return _paths(spark, d).select("doc_id", "x", rules.path_points(x, ["config"], ["User"]).alias("points"), rules.points(rules.CONTEXT_RULES["entrypoint-traversal"], path=x, text=x).alias("entry_points"))


# ---- questions ----


def _type_sql(low: str) -> str:
    """The rules as a list of (weight, order, type), the greatest first."""
    cases = []
    for i, (name, weight, groups, forbidden) in enumerate(questions.TYPE_RULES):
        ok = [f"regexp_matches({low}, {_text(questions.word_pattern(*groups))})"] + [f"NOT contains({low}, {_text(w)})" for w in forbidden]
        cases.append(f"CASE WHEN {' AND '.join(ok)} THEN {{'weight': {weight}, 'at': {-i}, 'type': {_text(name)}}} END")
    return f"list_sort(list_filter([{', '.join(cases)}], lambda r: r IS NOT NULL), 'DESC')[1]"


QUESTIONS = ["где используется {role}", "Есть ли {role} в проекте", "what columns does the table have", "How does the auth flow work", "why does a change of the model break the report", "list all routes and events", "config of the websocket server", "google oauth config", "fix the error of the {role}", "plain", "causes of allocation", "Как определяется порт", "when was it added", "нужно ли подтвердить email", ""]
#: Every turn of a conversation, and a question that its numbers choose.
_ASKED = f"(SELECT text AS x FROM conversations UNION ALL SELECT {_pick('(conv_id + turn)', QUESTIONS)} FROM conversations)"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    turns = t(spark, d, "conversations")
    return turns.select(F.col("text").alias("x")).union(turns.select(F.expr(_pick("(conv_id + turn)", QUESTIONS))))


@query("x25_question_types", f"WITH q AS (SELECT x, lower(coalesce(x, '')) AS low FROM {_ASKED}), b AS (SELECT x, {_type_sql('low')} AS best FROM q) SELECT sha1(x) AS question, coalesce(best.type, 'unknown') AS type, CAST(coalesce(best.weight, 10) AS DOUBLE) / 100 AS confidence FROM b")
def _(spark, d):
    kind = questions.question_type(F.col("x"))
    return _asked(spark, d).select(F.sha1("x").alias("question"), kind.alias("k")).select("question", "k.type", "k.confidence")


def _profile_sql() -> str:
    w = lambda *words_: f"regexp_matches(low, {_text(questions.word_pattern('|'.join(words_)))})"
    cases = [f"CASE WHEN type = {_text(n)} THEN {_text(p)} END" for n, ps in questions.DEFAULT_PROFILES.items() for p in ps]
    cases += [f"CASE WHEN {w(*ws)}{'' if n is None else f' AND type = {_text(n)}'} THEN {_text(p)} END" for n, ws, ps in questions.WORD_PROFILES for p in ps]
    cases += [f"CASE WHEN {' AND '.join(w(x) for x in ws)} THEN {_text(p)} END" for ws, ps in questions.BOTH_WORDS for p in ps]
    cases += [f"CASE WHEN type = 'existence' AND {w('auth')} THEN 'config-inventory' END"]
    return f"list_sort(list_distinct(list_filter([{', '.join(cases)}], lambda p: p IS NOT NULL)))"


@query("x26_search_profiles", f"WITH q AS (SELECT x, lower(x) AS low FROM {_ASKED}), b AS (SELECT x, low, coalesce({_type_sql('low')}.type, 'unknown') AS type FROM q) SELECT sha1(x) AS question, type, {_profile_sql()} AS profiles FROM b")
def _(spark, d):
    typed = _asked(spark, d).select("x", questions.question_type(F.col("x"))["type"].alias("type"))
    return typed.select(F.sha1("x").alias("question"), "type", F.array_sort(questions.search_profiles(F.col("x"), F.col("type"))).alias("profiles"))


@query("f14_task_cues", "SELECT sha1(x) AS task, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(x), {_text(p)}) THEN {_text(n)} END" for n, p in questions.TASK_CUES.items()) + f"], lambda c: c IS NOT NULL) AS cues FROM {_ASKED}")
def _(spark, d):
    return _asked(spark, d).select(F.sha1("x").alias("task"), questions.task_cues(F.col("x")).alias("cues"))


@query("f11_command_rules", "SELECT o_orderkey, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(x, {_text(p)}){' AND NOT regexp_matches(x, ' + _text(questions.DRY_RUN) + ')' if n == 'database' else ''} THEN {_text(n)} END" for n, p in questions.COMMAND_RULES.items()) + f"], lambda c: c IS NOT NULL) AS rules FROM (SELECT o_orderkey, {_pick('o_orderkey', COMMANDS)} AS x FROM orders)")
def _(spark, d):
    asked = t(spark, d, "orders").select("o_orderkey", F.expr(_pick("o_orderkey", COMMANDS)).alias("x"))
    return asked.select("o_orderkey", questions.command_rules(F.col("x")).alias("rules"))


@query("u5_note_keys", r"WITH f AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'Note: ' ELSE 'blocker : ' END || lang || ', ' || source || '!' AS x FROM documents JOIN labels USING (doc_id)), k AS (SELECT doc_id, starts_with(lower(x), 'note') AS note, trim(regexp_replace(regexp_replace(lower(regexp_replace(x, '(?i)^(blocker|note)\s*:\s*', '')), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM f) SELECT CASE WHEN note THEN 'note' ELSE 'blocker' END AS severity, key, min(doc_id) AS first FROM k GROUP BY ALL")
def _(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    x = F.concat(F.when(F.col("toxic") == 1, "Note: ").otherwise("blocker : "), "lang", F.lit(", "), "source", F.lit("!"))
    return rows.select("doc_id", questions.finding(x).alias("f")).groupBy("f.severity", "f.key").agg(F.min("doc_id").alias("first"))


# ---- evidence: orders are evidence of their customers' questions ----

_EVIDENCE = "e AS (SELECT o_custkey AS question, o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' THEN 'error' ELSE o_orderpriority END AS path, CAST(floor(o_totalprice / 5000) AS BIGINT) AS score FROM orders)"


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("o_orderstatus") == "P", F.lit(None)).when(F.col("o_orderstatus") == "F", "error").otherwise(F.col("o_orderpriority"))
    return t(spark, d, "orders").select(F.col("o_custkey").alias("question"), F.col("o_orderkey").alias("id"), path.alias("path"), F.floor(F.col("o_totalprice") / 5000).alias("score"))


@query("w7_top_evidence", f"""
WITH {_EVIDENCE}, m AS (SELECT *, path IS NOT NULL AND row_number() OVER (PARTITION BY question, path ORDER BY score DESC, id) = 1 AS anchor FROM e),
k AS (SELECT *, anchor OR path IS NULL OR score >= 40 AS taken FROM m),
c AS (SELECT *, count(*) FILTER (taken) OVER w AS n, count(*) FILTER (anchor) OVER w AS a FROM k WINDOW w AS (PARTITION BY question ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, NOT taken AND n < 6 AND a < 4 AS late FROM c)
SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY late, score DESC, id) AS place FROM l QUALIFY place <= 12""")
def _(spark, d):
    return evidence.select_top(_evidence(spark, d).withColumn("ord", F.col("id"))).select("question", "id", F.col("place").cast("long").alias("place"))


@query("j19_evidence_origins", f"WITH {_EVIDENCE}, c AS (SELECT DISTINCT event_type AS path FROM events UNION SELECT '1-URGENT'), o AS (SELECT question, CASE WHEN path IS NULL THEN 'structural' WHEN path IN (SELECT path FROM c) THEN 'overlay' ELSE 'baseline' END AS o FROM e) SELECT question, count(*) FILTER (o = 'baseline') AS baseline, count(*) FILTER (o = 'overlay') AS overlay, count(*) FILTER (o = 'structural') AS structural, CAST(0 AS BIGINT) AS recalled, CAST(0 AS BIGINT) AS conversation, count(*) FILTER (o = 'overlay') > 0 AS overlay_influenced FROM o GROUP BY question")
def _(spark, d):
    changed = t(spark, d, "events").select(F.lit("1-URGENT").alias("path"), F.col("event_type").alias("previous_path"))
    return evidence.origin_summary(evidence.with_origin(_evidence(spark, d), changed))


@query("j18_prior_turn", f"""
WITH {_EVIDENCE}, p AS (SELECT user_id AS question, event_id AS id, event_type AS path, CAST(floor(value) AS BIGINT) AS score, value > 50 AS related FROM events),
s AS (SELECT c_custkey AS question, c_mktsegment = 'FURNITURE' AS same FROM customer),
own AS (SELECT e.*, coalesce(same, false) AS same, path IS NOT NULL AND EXISTS (SELECT 1 FROM p WHERE p.question = e.question AND p.path = e.path) AS known FROM e LEFT JOIN s USING (question)),
n AS (SELECT question, count(*) FILTER (known) AS raised FROM own GROUP BY question),
b AS (SELECT p.* FROM p LEFT JOIN s USING (question) LEFT JOIN n USING (question) WHERE (coalesce(same, false) OR (related AND coalesce(raised, 0) < 4)) AND NOT EXISTS (SELECT 1 FROM e WHERE e.question = p.question AND e.path = p.path)),
o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY question, path ORDER BY score DESC, id) = 1),
k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, id) <= 3)
SELECT question, id, path, score + CASE WHEN NOT known THEN 0 WHEN same THEN 30 ELSE 5 END AS score, 'own' AS origin FROM own UNION ALL SELECT question, id, path, greatest(18, least(score, 55)), 'conversation' FROM k""")
def _(spark, d):
    prior = t(spark, d, "events").select(F.col("user_id").alias("question"), F.col("event_id").alias("id"), F.col("event_type").alias("path"), F.floor("value").alias("score"), (F.col("value") > 50).alias("related"))
    topics = t(spark, d, "customer").select(F.col("c_custkey").alias("question"), (F.col("c_mktsegment") == "FURNITURE").alias("same_topic"))
    return evidence.with_prior_turn(_evidence(spark, d), prior, topics)


@query("a20_ambiguity", """
WITH m AS (SELECT l_suppkey AS question, l_returnflag || l_linestatus AS module, CAST(sum(l_quantity) AS BIGINT) AS score FROM lineitem GROUP BY ALL), g AS (SELECT *, max(score) OVER (PARTITION BY question) AS top FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, module) AS rn FROM g WHERE top >= 500 AND score >= 0.65 * top)
SELECT question, coalesce(n BETWEEN 2 AND 4, false) AS ambiguous, coalesce(names[1:4], []) AS competing FROM (SELECT DISTINCT question FROM m) LEFT JOIN (SELECT question, least(count(*), 5) AS n, list(module ORDER BY rn) AS names FROM k GROUP BY question) USING (question)""")
def _(spark, d):
    scores = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("question"), F.concat("l_returnflag", "l_linestatus").alias("module")).agg(F.sum("l_quantity").cast("long").alias("score"))
    return evidence.ambiguity(scores)


@query("a21_evidence_quality", f"WITH {_EVIDENCE}, q AS (SELECT question, 8 * count(*) FILTER (score >= 14) + 3 * count(path) + 4 * count(DISTINCT o_orderpriority) AS q FROM e JOIN orders ON id = o_orderkey GROUP BY question), n AS (SELECT user_id AS question, count(*) AS n FROM events GROUP BY user_id) SELECT question, q + 4 * least(coalesce(n, 0), 6) AS quality FROM q LEFT JOIN n USING (question)")
def _(spark, d):
    origin = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("origin"))
    return evidence.quality(_evidence(spark, d).join(origin, "id"), t(spark, d, "events").groupBy(F.col("user_id").alias("question")).agg(F.count("*").alias("n")))


def _strength(c: str) -> str:
    return f"CASE WHEN contains(lower({c}), 'bluewidget') THEN 3 WHEN contains(lower({c}), 'blue') AND contains(lower({c}), 'widget') THEN 2 WHEN contains(lower({c}), 'blue') OR contains(lower({c}), 'widget') THEN 1 ELSE 0 END"


def _hits(c: str) -> str:
    return f"(CAST(contains(lower({c}), 'widget') AS BIGINT) + CAST(contains(lower({c}), 'the') AS BIGINT) + CAST(contains(lower({c}), 'blue') AND contains(lower({c}), 'widget') AS BIGINT))"


@query("t6_scored_retrieval", f"""
WITH a AS (SELECT 'file' AS kind, doc_id AS id, source || '/' || lang AS path, _f.* FROM (SELECT doc_id, source, lang, {_hits("source || '/' || lang")} * 6 + {_hits('text')} + CASE {_strength("source || '/' || lang")} WHEN 3 THEN 42 WHEN 2 THEN 20 ELSE 0 END AS score FROM documents) _f),
s AS (SELECT p_partkey AS id, {_hits('p_name')} * 8 + {_hits('p_brand')} * 3 + CASE {_strength('p_brand')} WHEN 3 THEN 56 WHEN 2 THEN 28 ELSE CASE {_strength('p_name')} WHEN 3 THEN 16 WHEN 2 THEN 8 ELSE 0 END END AS score FROM part),
r AS (SELECT page_id AS id, {_hits('url')} * 10 + 12 + CASE {_strength('url')} WHEN 3 THEN 14 WHEN 2 THEN 6 ELSE 0 END AS score FROM pages),
m AS (SELECT n_nationkey AS id, {_hits('n_name')} * 14 + CASE {_strength('n_name')} WHEN 3 THEN 18 WHEN 2 THEN 8 ELSE 0 END AS score FROM nation)
SELECT kind, id, score FROM a WHERE score > 0 UNION ALL SELECT 'symbol', id, score FROM s WHERE score > 0 UNION ALL SELECT 'route', id, score FROM r UNION ALL SELECT 'module', id, score FROM m WHERE score > 0""")
def _(spark, d):
    files = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang").alias("path"), F.col("text").alias("content"))
    symbols = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("path"))
    routes = t(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("label"), F.lit(None).cast("string").alias("path"))
    modules = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("label"))
    return evidence.retrieve(files, symbols, routes, modules, [["widget"], ["the"], ["blue", "widget"]], [("bluewidget", ["blue", "widget"])]).select("kind", "id", "score")


# ---- refreshes ----

_CHANGES = "ch AS (SELECT 's' || s_suppkey AS path, CASE WHEN s_acctbal > 5000 THEN 'p' || s_nationkey END AS previous_path, CASE WHEN s_acctbal > 5000 THEN 'renamed' WHEN s_acctbal < 0 THEN 'deleted' ELSE 'modified' END AS type FROM supplier)"


def _changes(spark: SparkSession, d: str) -> DataFrame:
    moved = F.col("s_acctbal") > 5000
    kind = F.when(moved, "renamed").when(F.col("s_acctbal") < 0, "deleted").otherwise("modified")
    return t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("path"), F.when(moved, F.concat(F.lit("p"), "s_nationkey")).alias("previous_path"), kind.alias("type"))


@query("j23_index_plan", f"WITH {_CHANGES} SELECT DISTINCT 'changed' AS role, path, CAST(NULL AS VARCHAR) AS source FROM ch UNION ALL SELECT DISTINCT 'deleted', path, NULL FROM ch WHERE type = 'deleted' UNION ALL SELECT DISTINCT 'renamed', path, previous_path FROM ch WHERE type = 'renamed' UNION ALL (SELECT 'reusable', id, NULL FROM (SELECT DISTINCT 's' || l_partkey AS id FROM lineitem) WHERE id NOT IN (SELECT path FROM ch) ORDER BY id LIMIT 500)")
def _(spark, d):
    return refresh.index_plan(_changes(spark, d), t(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_partkey").alias("path")))


@query("j24_scoped_paths", f"WITH {_CHANGES} SELECT DISTINCT path FROM (SELECT path FROM ch UNION ALL SELECT previous_path FROM ch) WHERE path IN (SELECT 'p' || p_partkey FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier)")
def _(spark, d):
    there = t(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path")).unionByName(t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("path")))
    return refresh.scoped_paths(_changes(spark, d), there)


@query("j22_invalidation", f"WITH {_NODES}, {_EDGES}, x AS (SELECT id FROM nodes WHERE label IN (SELECT DISTINCT o_orderstatus FROM orders WHERE o_totalprice < 2000 UNION SELECT r_name FROM region)), g AS (SELECT DISTINCT o_orderstatus AS p FROM orders WHERE o_totalprice < 2000 UNION SELECT r_name FROM region) SELECT (SELECT count(*) FROM g) AS changed, (SELECT count(DISTINCT doc_id) FROM documents WHERE lang IN (SELECT p FROM g)) AS symbols, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id FROM x)) AS nodes_kept, (SELECT count(*) FROM edges WHERE source_id NOT IN (SELECT id FROM x) AND target_id NOT IN (SELECT id FROM x)) AS edges_kept, CASE WHEN (SELECT count(*) FROM g) BETWEEN 1 AND 150 THEN 'partial-invalidation' ELSE 'full-refresh' END AS mode")
def _(spark, d):
    changed = t(spark, d, "orders").where("o_totalprice < 2000").select(F.col("o_orderstatus").alias("path")).unionByName(t(spark, d, "region").select(F.col("r_name").alias("path")))
    symbols = t(spark, d, "documents").select(F.col("doc_id").alias("symbol_id"), F.col("lang").alias("path"))
    return refresh.invalidation(changed, symbols, graph_nodes(spark, d).withColumn("file_path", F.col("label")), graph_edges(spark, d, repeats=True), repeats=True)


@query("j20_relevant_facts", f"""
WITH {_STATES}, f AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'deprecated' ELSE 'fresh' END AS status, o_orderdate AS day FROM orders), latest AS (SELECT * FROM f WHERE status <> 'deprecated' ORDER BY day DESC, id LIMIT 100),
m AS (SELECT DISTINCT l_orderkey AS id, 'd' || l_partkey AS old FROM lineitem WHERE l_orderkey IN (SELECT id FROM latest)), r AS (SELECT 'd' || s_suppkey AS old, 'd' || s_nationkey AS new FROM supplier),
v AS (SELECT m.id, coalesce(new, m.old) AS path, p.hash FROM m LEFT JOIN p ON 'd' || p.id = m.old LEFT JOIN r ON r.old = m.old), w AS (SELECT v.id, path, coalesce(v.hash = c.hash, false) AS ok FROM v LEFT JOIN c ON 'd' || c.id = path)
SELECT l.id, CASE WHEN bool_or(ok) THEN min(status) ELSE 'potentially_stale' END AS status, list_sort(list(DISTINCT path)) AS paths FROM latest l JOIN w ON w.id = l.id GROUP BY l.id
UNION ALL SELECT id, 'potentially_stale', [] FROM latest WHERE id NOT IN (SELECT id FROM m)""")
def _(spark, d):
    before, now = (x.select(F.concat(F.lit("d"), "id").alias("path"), "hash") for x in states(spark, d))
    facts = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "deprecated").otherwise("fresh").alias("status"), F.col("o_orderdate").alias("confirmed_at"))
    paths = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("d"), "l_partkey").alias("path")).distinct().join(before, "path", "left")
    renames = t(spark, d, "supplier").select(F.concat(F.lit("d"), "s_suppkey").alias("path"), F.concat(F.lit("d"), "s_nationkey").alias("new_path"))
    return refresh.relevant_facts(facts, paths, now, renames)


@query("a13_merge_near_duplicates")
def _(spark, d):
    facts = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(":", "source", "lang").alias("category"), F.col("text").alias("statement"), F.array("source").alias("paths"), F.col("n_chars").alias("ord"))
    return refresh.merge_near_duplicates(facts)


@query("r4_to_embed", f"WITH {_STATES} SELECT id AS path, hash FROM p WHERE (id, hash) NOT IN (SELECT id, hash FROM c)")
def _(spark, d):
    before, now = (x.select(F.col("id").alias("path"), "hash") for x in states(spark, d))
    return refresh.to_embed(before, now)


@query("r4_pruned", "SELECT vec_id AS path, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return refresh.prune(t(spark, d, "embeddings").select(F.col("vec_id").alias("path"), "label"), t(spark, d, "labels").select(F.col("doc_id").alias("path")))


@query("u7_requested", "SELECT DISTINCT vec_id AS id, vec_id IN (SELECT doc_id FROM labels) AS found FROM embeddings")
def _(spark, d):
    return refresh.requested(t(spark, d, "embeddings").select(F.col("vec_id").alias("id")), t(spark, d, "labels").select(F.col("doc_id").alias("id")))


@query("j28_shared_keys", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)")
def _(spark, d):
    often = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).count().where("count > 1")
    return t(spark, d, "customer").join(often, "c_custkey", "left_semi").select("c_custkey")


@query("r8_project_state", "SELECT o_orderkey AS id, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN c_mktsegment = 'FURNITURE' THEN 'fresh' ELSE 'stale' END AS freshness, CASE WHEN o_orderstatus = 'P' THEN 'degraded' WHEN coalesce(c_mktsegment = 'FURNITURE', false) THEN 'ready' ELSE 'syncing' END AS sync, CASE WHEN o_totalprice < 50000 THEN 'conflict' WHEN o_totalprice < 100000 THEN 'overlay' ELSE 'clean' END AS worktree FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def _(spark, d):
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    state = refresh.project_state(F.col("c_mktsegment"), F.lit("FURNITURE"), F.col("o_orderstatus") != "P", F.col("o_totalprice") < 50000, F.col("o_totalprice") < 100000)
    return rows.select(F.col("o_orderkey").alias("id"), state.alias("s")).select("id", "s.*")


@query("r7_recovered_runs", "SELECT CASE WHEN o_orderstatus IN ('P', 'failed') THEN 'failed' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, d):
    runs = t(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "running").otherwise(F.col("o_orderstatus")).alias("status"))
    return refresh.recovered(runs).groupBy("status").agg(F.count("*").alias("n"))


@query("w9_stage_durations", "SELECT user_id AS run, event_type AS stage, row_number() OVER w AS place, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS micros FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)")
def _(spark, d):
    return refresh.stage_durations(t(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), "ts"))


@query("t11_stale_units", "SELECT s_suppkey AS ord, 'u/' || s_nationkey AS unit, s_acctbal >= 0 AS crawled, CAST(coalesce(churn, 0) AS BIGINT) AS churn FROM supplier LEFT JOIN (SELECT c_nationkey, sum(churn) AS churn FROM customer JOIN (SELECT o_custkey, count(*) AS churn FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey GROUP BY c_nationkey) ON c_nationkey = s_nationkey")
def _(spark, d):
    units = t(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("u/"), "s_nationkey").alias("unit"), (F.col("s_acctbal") >= 0).alias("crawled"))
    n = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("churn"))
    files = t(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey")).select(F.concat(F.lit("u/"), "c_nationkey", F.lit("/"), "c_custkey").alias("path"), "churn")
    return refresh.stale_order(units, files).select("ord", "unit", "crawled", "churn")


@query("j30_relabelled", f"WITH {_NODES} SELECT id, label FROM nodes UNION ALL SELECT 'web/' || id, label FROM nodes")
def _(spark, d):
    nodes = graph_nodes(spark, d).select("id", "label")
    return nodes.unionByName(refresh.relabelled(nodes, "web"))


# ---- plans ----

_HOST = "regexp_replace(url, '^[a-z]+://([^?#]*).*$', '\\1')"


def _host(c: str = "url"):
    return F.regexp_replace(c, r"^[a-z]+://([^?#]*).*$", "$1")


@query("a8_dominant_modules", f"""
WITH o AS (SELECT lang AS plan, f FROM (SELECT regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1) AS lang, string_split({_HOST}, '/') AS p FROM pages), LATERAL (SELECT list_filter(p, lambda s: s <> '') AS q), LATERAL (SELECT q[1:len(q) - 1] AS f)),
n AS (SELECT plan, ceil(0.6 * count(*)) AS need FROM o GROUP BY plan),
c AS (SELECT plan, p, count(*) AS n FROM (SELECT plan, unnest(list_transform(range(1, len(f) + 1), lambda i: f[1:i])) AS p FROM o) GROUP BY ALL),
b AS (SELECT c.plan, p FROM c JOIN n ON c.plan = n.plan WHERE c.n >= need QUALIFY row_number() OVER (PARTITION BY c.plan ORDER BY len(p) DESC, p) = 1),
i AS (SELECT plan, list_filter(p, lambda s: NOT list_contains(['app', 'src', 'apps', 'packages', 'lib', 'source', 'containers', 'modules', 'domains', 'features', 'components'], lower(s)))[-1] AS name FROM b),
s AS (SELECT plan, s, count(*) AS n FROM (SELECT plan, unnest(list_distinct(f)) AS s FROM o) GROUP BY ALL), g AS (SELECT plan, s FROM s QUALIFY row_number() OVER (PARTITION BY plan ORDER BY n DESC, s) = 1)
SELECT n.plan, coalesce(name, g.s, 'none') AS module FROM n LEFT JOIN i ON i.plan = n.plan LEFT JOIN g ON g.plan = n.plan""")
def _(spark, d):
    return planning.dominant_module(t(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)", 1).alias("plan"), _host().alias("path")))


@query("j27_group_chains", """
WITH l AS (SELECT c_custkey AS f, c_mktsegment AS g FROM customer), d AS (SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
x AS (SELECT x.g AS from_label, y.g AS to_label, CAST(a AS VARCHAR) AS path, CAST(b AS VARCHAR) AS needs FROM d JOIN l x ON x.f = a JOIN l y ON y.f = b WHERE x.g <> y.g)
SELECT from_label, to_label, path, needs FROM x QUALIFY row_number() OVER (PARTITION BY from_label, to_label ORDER BY length(path) + length(needs), path, needs) = 1""")
def _(spark, d):
    labels = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.col("c_mktsegment").alias("label"))
    needs = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    needs = needs.select(F.col("o_custkey").cast("string").alias("path"), F.col("l_suppkey").cast("string").alias("needs"))
    return planning.chains(needs, labels)


@query("t12_group_order", "WITH g AS (SELECT p_brand AS label, count(*) AS n FROM (SELECT DISTINCT p_brand, p_name FROM part) GROUP BY p_brand), c AS (SELECT 'Brand#' || s_nationkey AS label, count(*) AS needed_by FROM supplier GROUP BY ALL) SELECT label, n, coalesce(needed_by, 0) AS needed_by FROM g LEFT JOIN c USING (label)")
def _(spark, d):
    grouped = planning.groups(t(spark, d, "part").select("p_brand", F.col("p_name").alias("path")), F.col("p_brand"))
    return planning.group_order(grouped, t(spark, d, "supplier").select(F.concat(F.lit("Brand#"), "s_nationkey").alias("to_label"))).select("label", "n", "needed_by")


@query("g12_hybrid", "SELECT o_orderkey AS id, o_orderstatus <> 'P' AND o_custkey > 1 AND (o_orderkey // 3) > 1 AND o_totalprice < 100000 AND o_custkey < greatest((o_orderkey // 3) - 1, 2) AS hybrid FROM orders")
def _(spark, d):
    profile = F.when(F.col("o_orderstatus") == "P", "broad-scan").otherwise("entrypoint-traversal")
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), planning.prefers_hybrid(profile, F.col("o_custkey"), F.floor(F.col("o_orderkey") / 3), F.when(F.col("o_totalprice") < 100000, 0).otherwise(2), F.col("o_custkey")).alias("hybrid"))


# ---- views of the graph: nations are files, customers their symbols, parts modules and orders entry points ----

_FILES = f"""{_NODES}, {_EDGES}, fn AS (SELECT id, CASE kind WHEN 'nation' THEN 'file' ELSE kind END AS kind, label, CASE WHEN kind = 'order' THEN label WHEN kind = 'nation' THEN label END AS file_path FROM nodes),
fe AS (SELECT CASE WHEN source_id LIKE 'c%' THEN 'DECLARES' ELSE 'USES' END AS type, target_id AS source_id, source_id AS target_id FROM edges WHERE source_id LIKE 'c%' OR source_id LIKE 'o%')"""


def _file_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = graph_nodes(spark, d).withColumn("file_path", F.when(F.col("kind").isin("order", "nation"), F.col("label"))).withColumn("kind", F.when(F.col("kind") == "nation", "file").otherwise(F.col("kind")))
    edges = graph_edges(spark, d).where("source_id like 'c%' or source_id like 'o%'")
    return nodes, edges.select(F.when(F.col("source_id").like("c%"), "DECLARES").otherwise("USES").alias("type"), F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))


@query("j8_file_dependencies", f"WITH {_FILES} SELECT DISTINCT a.source_id AS file_id, n.id FROM fe a JOIN fe b ON a.target_id = b.source_id JOIN fn n ON n.id = b.target_id JOIN fn f ON f.id = a.source_id WHERE a.type = 'DECLARES' AND b.type = 'USES' AND f.kind = 'file' AND n.file_path IS NOT NULL AND n.file_path <> f.file_path")
def _(spark, d):
    return graph.file_dependencies(*_file_graph(spark, d))


@query("g11_impact_preview", f"WITH {_FILES}, x AS (SELECT DISTINCT a.source_id AS file_id, b.target_id AS id FROM fe a JOIN fe b ON a.target_id = b.source_id WHERE a.type = 'DECLARES' AND b.type = 'USES') SELECT id, file_id, row_number() OVER (PARTITION BY id ORDER BY file_id) AS place FROM x QUALIFY place <= 8")
def _(spark, d):
    nodes, edges = _file_graph(spark, d)
    return graph.impact_preview(graph.file_dependencies(nodes, edges), graph.nodes_of(nodes, "order")).withColumn("place", F.col("place").cast("long"))


@query("g3_subgraph", f"WITH {_NODES}, {_EDGES}, s AS (SELECT id FROM nodes WHERE kind = 'nation' AND label LIKE '%A%') SELECT id, kind, label FROM nodes WHERE id IN (SELECT id FROM s UNION SELECT source_id FROM edges WHERE target_id IN (SELECT id FROM s) UNION SELECT target_id FROM edges WHERE source_id IN (SELECT id FROM s))")
def _(spark, d):
    nodes = graph_nodes(spark, d)
    return graph.around(nodes, graph_edges(spark, d, repeats=True), nodes.where("kind = 'nation' and label like '%A%'"))


@query("g4_dependents", f"WITH {_EDGES} SELECT DISTINCT target_id AS start_id, source_id AS id FROM edges WHERE type = 'DEPENDS_ON'")
def _(spark, d):
    nodes = graph_nodes(spark, d)
    return graph.neighbors(nodes, graph_edges(spark, d), graph.nodes_of(nodes, "supplier"), "in", ("DEPENDS_ON",)).select("start_id", "id")


@query("g5_entry_set", f"WITH {_NODES}, {_EDGES} SELECT id, kind, label FROM nodes WHERE kind = 'order' OR id IN (SELECT target_id FROM edges WHERE source_id LIKE 'o%' AND type IN ('REFERENCES', 'CALLS', 'USES', 'BELONGS_TO'))")
def _(spark, d):
    return graph.entry_set(graph_nodes(spark, d), graph_edges(spark, d, repeats=True), "order")


@query("t16_broad_seeds", f"WITH {_NODES} SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY id) AS place FROM nodes WHERE kind IN ('part', 'order', 'customer') QUALIFY place <= CASE kind WHEN 'order' THEN 8 ELSE 12 END")
def _(spark, d):
    return graph.broad_seeds(graph_nodes(spark, d), {"part": 12, "order": 8, "customer": 12}).select("id", "kind", F.col("place").cast("long").alias("place"))


@query("j25_neighbour_paths", f"WITH {_NODES}, {_EDGES}, h AS (SELECT id FROM nodes WHERE label IN (SELECT r_name FROM region)), e AS (SELECT * FROM edges WHERE source_id IN (SELECT id FROM h) OR target_id IN (SELECT id FROM h)) SELECT DISTINCT label AS path FROM nodes WHERE id IN (SELECT source_id FROM e UNION SELECT target_id FROM e)")
def _(spark, d):
    nodes = graph_nodes(spark, d).withColumn("file_path", F.col("label"))
    return graph.neighbour_paths(nodes, graph_edges(spark, d), t(spark, d, "region").select(F.col("r_name").alias("path")))


@query("j26_label_fallback", f"WITH f AS (SELECT page_id, {_HOST} AS path FROM pages), v AS (SELECT regexp_replace(path, '^[^/]*/', '') AS path, count(*) AS value FROM f GROUP BY ALL UNION ALL SELECT min(path), 0 FROM f) SELECT page_id, f.path, coalesce(a.value, b.value) AS value FROM f LEFT JOIN v a ON a.path = f.path LEFT JOIN v b ON b.path = regexp_replace(f.path, '^[^/]*/', '')")
def _(spark, d):
    files = t(spark, d, "pages").select("page_id", _host().alias("path"))
    values = files.groupBy(F.regexp_replace("path", "^[^/]*/", "").alias("path")).agg(F.count("*").alias("value")).unionByName(files.agg(F.min("path").alias("path"), F.lit(0).cast("long").alias("value")))
    return graph.with_label_fallback(files, values)


@query("j26_without_bare", f"WITH f AS (SELECT {_HOST} AS path FROM pages), a AS (SELECT path FROM f UNION SELECT regexp_replace(path, '^[^/]*/', '') FROM f) SELECT path FROM a WHERE path NOT IN (SELECT regexp_replace(path, '^[^/]*/', '') FROM a WHERE contains(path, '/'))")
def _(spark, d):
    files = t(spark, d, "pages").select(_host().alias("path"))
    return graph.without_bare_duplicates(files.unionByName(files.select(F.regexp_replace("path", "^[^/]*/", "").alias("path"))))


@query("j29_without_runs", "SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.conv_id AND e.event_id = c.turn)")
def _(spark, d):
    runs = t(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"))
    return t(spark, d, "conversations").join(runs, ["conv_id", "turn"], "left_anti").select("conv_id", "turn")


# ---- monitors: users are paths, days heads, every third event a tick without stale units ----


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    source = f"{d}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source + "*")  # a pattern, as a stream's plain path must be a folder
    return events.select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.date_format("ts", "yyyy-MM-dd").alias("head"), (F.col("event_id") % 3).cast("int").alias("stale"), "event_type")


@query("r5_observer_passes")
def _(spark, d):
    return monitor.written_to_end(monitor.machine(_ticks(spark, d).drop("event_type"), monitor.observer_step))


@query("r2_auto_syncs")
def _(spark, d):
    """Errors are ends of runs, purchases questions; of the rest every third state is fresh."""
    ticks = _ticks(spark, d)
    kind, fresh = F.when(F.col("event_type") == "error", "run").otherwise("state"), F.when(F.col("stale") == 0, "fresh").otherwise("stale")
    seen = ticks.select("path", "ts", "head", kind.alias("kind"), fresh.alias("freshness"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.lit(False).alias("changes"), (F.col("event_type") == "purchase").alias("busy"))
    return monitor.written_to_end(monitor.machine(seen, monitor.sync_step))
