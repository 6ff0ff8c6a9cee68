"""Queries over the subjects of questions, the points that these give and the modules that are meant; with their DuckDB twins.

Questions are the turns of conversations, files the documents, at paths of a stated pattern;
a stated phrase around a row's own values is added to each, so that the rules have what to
meet.  The twins evaluate the rules as written, literal after literal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import boosts, words
from .functions.text import tokenize
from .operators import intents
from .queries import query, t
from .state_queries import _pick, _text

#: Phrases added to a turn, to a document's text and to the names of symbols.
ASKED = ["", "how does the locale work", "where is the server password", "which config variables", "google {role}", "websocket channel", "redis queue", "таблица {role}", "как работает язык", "серверами", "login token for the {role}", "the env {role}"]
SAID = ["", "private_key host port username", "$this->belongsTo({lang})", "__('{lang}')", "request->header('X-Lang')", "env('{lang}')", "socialite provider", "pusher realtime", "cache session", "server credential", "app()->setLocale('{lang}')", "protected $casts"]
LABELS = ["{lang}", "ServerRepository.find", "Model.hasMany", "getLocale", "queueWorker", "Google.{source}", "invoice", "config.env"]
FILES = [
    "app/Servers/{source}.php", "lang/{lang}/f.php", "config/{source}.php", "app/Models/Server{lang}.php", "routes/Channels/{source}.php", "app/Http/Middleware/{lang}.php", "app/Jobs/{source}.php", "src/auth/{lang}.ts", "app/Http/Controllers/auth/{source}.php", "database/migrations/{lang}.php", "app/Repositories/Server{source}.php", "vault/{lang}/{source}.ts",
    "app/observers/{lang}.php", "{source}.env.{lang}", "app/billing/vault/{lang}.php",
]
KINDS = ["class", "method", "route", "function", "variable", "middleware", "interface"]
_SQL_ASKED = f"(SELECT conv_id, turn, coalesce(text, '') || ' ' || {_pick('(conv_id + coalesce(turn, 0))', ASKED)} AS x FROM conversations)"
_SQL_FILES = f"(SELECT doc_id, {_pick('doc_id', FILES)} || CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') || ' ' || {_pick('(doc_id // 5)', SAID)} AS content, {_pick('(doc_id // 7)', LABELS)} AS label, {_pick('(doc_id // 3)', KINDS)} AS kind, {_pick('(doc_id // 11)', ASKED).replace('role', 'source')} AS question FROM documents)"


def _spark_sql(x: str) -> str:
    return x.replace(" // ", " DIV ")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    added = F.expr(_pick("(conv_id + coalesce(turn, 0))", ASKED))
    return t(spark, d, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce(added, F.lit(""))).alias("x"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda number, patterns: F.expr(_spark_sql(_pick(number, patterns)))
    question = F.expr(_spark_sql(_pick("(doc_id // 11)", ASKED).replace("role", "source")))
    return t(spark, d, "documents").select(
        "doc_id", F.concat(pick("doc_id", FILES), F.col("doc_id").cast("string")).alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), pick("(doc_id // 5)", SAID)).alias("content"), pick("(doc_id // 7)", LABELS).alias("label"), pick("(doc_id // 3)", KINDS).alias("kind"), question.alias("question")
    )


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _foci_sql(tokens: str) -> str:
    meets = lambda listed: f"coalesce(list_has_any({tokens}, {_listed(listed)}), false)"
    named = [(n, meets(x + boosts.TABLE_WORDS if n == "model-schema" else x)) for n, x in boosts.FOCUS_WORDS.items()]
    named += [("locale-behavior", f"{meets(boosts.FOCUS_WORDS['localization'])} AND {meets(boosts.BEHAVIOR_WORDS)}"), ("sign-in", meets(boosts.SIGN_IN_WORDS)), ("settings", meets(boosts.SETTING_WORDS))]
    return "list_filter([" + ", ".join(f"CASE WHEN {holds} THEN {_text(n)} END" for n, holds in named) + "], lambda f: f IS NOT NULL)"


_TOKENS = "regexp_extract_all(lower(x), '[a-z0-9а-яё_/-]{2,}')"


@query("f13_question_subjects", f"SELECT conv_id, turn, {_foci_sql('tokens')} AS subjects FROM (SELECT conv_id, turn, {_TOKENS} AS tokens FROM {_SQL_ASKED})")
def _(spark, d):
    return _asked(spark, d).select("conv_id", "turn", boosts.foci(tokenize("x")).alias("subjects"))


_LOOKS = {"localization": "regexp_matches({0}, '^lang/|/lang/|^locales/|/locales/|/i18n/|/translations/')", "config": "regexp_matches({0}, '^config/|/config/|\\.env$|\\.env\\.')"}


def _mark_sql(mark: boosts.Mark) -> str:
    field, test, literal = mark
    if test == "looks":
        return _LOOKS[literal].format("path")
    if test == "lacks":
        return f"NOT list_contains(about, {_text(literal)})"
    if test == "asked":
        return f"len(list_filter(tokens, lambda w: contains({field}, w))) > 0"
    return {"has": f"contains({field}, {_text(literal)})", "starts": f"starts_with({field}, {_text(literal)})", "ends": f"ends_with({field}, {_text(literal)})", "is": f"{field} = {_text(literal)}"}[test]


def _points_sql(rules: boosts.Rules, first: bool = False) -> str:
    out = []
    for focus, listed in rules.items():
        holds = lambda c: "(" + " OR ".join("(" + (" AND ".join(map(_mark_sql, a)) or "true") + ")" for a in c) + ")"
        each = [f"WHEN {holds(c)} THEN {n}" for c, n in listed]
        points = f"CASE {' '.join(each)} ELSE 0 END" if first else " + ".join(f"CASE {x} ELSE 0 END" for x in each)
        out.append(f"CASE WHEN list_contains(about, {_text(focus)}) THEN {points} ELSE 0 END")
    return " + ".join(out)


@query("x27_subject_points", f"""
WITH f AS (SELECT doc_id, lower(path) AS path, lower(content) AS content, lower(label) AS label, kind, question AS x FROM {_SQL_FILES}),
q AS (SELECT *, {_TOKENS} AS tokens FROM f), a AS (SELECT *, {_foci_sql('tokens')} AS about FROM q)
SELECT doc_id, about, CAST({_points_sql(boosts.BOOSTS['file'])} AS INTEGER) AS file_points, CAST({_points_sql(boosts.BOOSTS['symbol'])} AS INTEGER) AS symbol_points, CAST({_points_sql(boosts.BOOSTS['route'], first=True)} AS INTEGER) AS route_points FROM a""")
def _(spark, d):
    """Every document as file, symbol and route, in the light of a question."""
    files = _files(spark, d).withColumn("tokens", tokenize("question"))
    given = {"file": ["path", "content"], "symbol": ["path", "label", "kind"], "route": ["path"]}
    fields = {kind: {f: F.col(f) for f in listed} for kind, listed in given.items()}
    met = files.select("*", boosts.foci(F.col("tokens")).alias("about"), *[boosts.marks(rules, **fields[kind]).alias(f"{kind}_marks") for kind, rules in boosts.BOOSTS.items()])
    return met.select("doc_id", "about", *[boosts.boost(rules, F.col(f"{kind}_marks"), F.col("tokens"), F.col("about"), first=kind == "route", **fields[kind]).alias(f"{kind}_points") for kind, rules in boosts.BOOSTS.items()])


def _alias_sql(low: str, alias: str) -> str:
    if alias in intents._JOINED:
        return f"contains({low}, {_text(alias)})"
    token = f"list_contains(regexp_extract_all({low}, '[a-z0-9а-яё_/-]{{2,}}'), {_text(alias)})"
    return token if len(alias) < 4 else f"({token} OR regexp_matches({low}, {_text(rf'(^|[^\p{{L}}\p{{N}}_]){alias}([^\p{{L}}\p{{N}}_]|$)')}))"


def _stem_sql(x: str) -> str:
    return f"regexp_replace({x}, '^(.{{{words.STEM_LEAST},}}?)(?:{'|'.join(words.ENDINGS)})$', '\\1')"


_ALIASES = ", ".join(f"({_text(m)}, {n}, {_text(a.lower())})" for n, (m, listed) in enumerate(intents.PROFILES.items()) for a in listed)
_HITS = lambda low: "list_filter([" + ", ".join(f"CASE WHEN {_alias_sql(low, a)} THEN {_text(a)} END" for a in intents._ALIASES) + "], lambda h: h IS NOT NULL)"
_CYRILLIC = "regexp_matches({0}, '[а-яё]')"


@query("a9_module_intents", rf"""
WITH al(module, ord, a) AS (VALUES {_ALIASES}),
q AS (SELECT conv_id * 1000 + coalesce(turn, 0) AS question, {_TOKENS} AS tokens FROM {_SQL_ASKED}),
w AS (SELECT question, unnest(list_distinct(tokens)) AS w FROM q), v AS (SELECT DISTINCT w FROM w WHERE w NOT IN {tuple(words.NO_ALIAS)}),
mw AS (SELECT DISTINCT w, module FROM v JOIN al ON w = a OR (length(w) >= 4 AND (starts_with(a, w) OR ends_with(a, w))) OR (length(a) >= 4 AND (starts_with(w, a) OR ends_with(w, a)))
  OR ({_CYRILLIC.format('w')} AND {_CYRILLIC.format('a')} AND length({_stem_sql('w')}) >= 4 AND {_stem_sql('w')} = {_stem_sql('a')})),
mq AS (SELECT DISTINCT question, module FROM w JOIN mw USING (w)),
m AS (SELECT DISTINCT module, ord FROM al), sub AS (SELECT question, list_filter({_foci_sql('tokens')}, lambda f: list_contains({_listed(intents.SUBJECTS)}, f)) AS sub FROM q),
ways AS (SELECT question, list_sort(sub) AS sub, m.module, ord, mq.module IS NOT NULL AS men FROM sub CROSS JOIN m LEFT JOIN mq USING (question, module)),
way AS (SELECT DISTINCT module, sub, men FROM ways),
f AS (SELECT path, lower(path) AS low, lower(content) AS c, lower(label) AS l FROM {_SQL_FILES}),
h AS (SELECT path, low, c, {_HITS('low')} AS hp, {_HITS('l')} AS hs, {_HITS('c')} AS hc FROM f),
g AS (SELECT module, list(DISTINCT a) AS al FROM al GROUP BY module),
e AS (SELECT path, low, c, module, len(list_intersect(hp, al)) AS p, len(list_intersect(hs, al)) AS s, len(list_intersect(hc, al)) AS n, regexp_matches(low, '/routes/|/controllers/|/auth/') AS handler FROM h CROSS JOIN g),
on_ AS (SELECT e.*, sub, men, list_contains(sub, 'infrastructure') AS i, list_contains(sub, 'localization') AS lo, list_contains(sub, 'locale-behavior') AS lb, list_contains(sub, 'config') AS co FROM e JOIN way USING (module)),
s AS (SELECT module, sub, men, path, p * 8 + s * 6 + least(n, 2) + CASE WHEN men THEN 20 ELSE 0 END
  - CASE WHEN i AND module = 'auth' AND NOT contains(low, '/auth/') AND NOT contains(low, 'authcontroller') THEN 18 ELSE 0 END
  + CASE WHEN i AND module IN ('servers', 'vault') AND p + s > 0 THEN 24 ELSE 0 END
  + CASE WHEN i AND (module = 'servers' AND contains(c, 'private_key') OR module = 'vault' AND contains(c, 'credential')) THEN 16 ELSE 0 END
  + CASE WHEN lo AND module = 'localization' AND {_LOOKS['localization'].format('low')} THEN 48 ELSE 0 END + CASE WHEN lo AND module = 'localization' AND p + s > 0 THEN 24 ELSE 0 END
  - CASE WHEN lo AND module <> 'localization' AND handler THEN 30 ELSE 0 END + CASE WHEN lb AND module = 'localization' AND p + s > 0 THEN 12 ELSE 0 END
  + CASE WHEN lb AND regexp_matches(low, '/middleware/|/http/|/requests/|/config/') THEN 20 ELSE 0 END
  + CASE WHEN co AND module = 'config' AND {_LOOKS['config'].format('low')} THEN 52 ELSE 0 END + CASE WHEN co AND module = 'config' AND regexp_matches(c, 'env\(|process\.env|import\.meta\.env') THEN 24 ELSE 0 END
  - CASE WHEN co AND module <> 'config' AND handler THEN 28 ELSE 0 END - CASE WHEN p + s = 0 AND n > 0 THEN 8 ELSE 0 END AS score FROM on_),
r AS (SELECT module, sub, men, CAST(sum(score) AS BIGINT) AS score, list(path ORDER BY score DESC, path)[1:4] AS files FROM s WHERE score > 0 GROUP BY ALL)
SELECT question, row_number() OVER (PARTITION BY question ORDER BY score DESC, ord) AS place, module, score, files FROM ways JOIN r USING (module, sub, men) QUALIFY place <= 5""")
def _(spark, d):
    """What every turn of the conversations asks for among all documents."""
    files = _files(spark, d)
    asked = _asked(spark, d).select((F.col("conv_id") * 1000 + F.coalesce("turn", F.lit(0))).alias("question"), F.col("x").alias("text"))
    found = intents.module_intents(files.select("path", "content"), files.select("path", "label"), asked)
    return found.select("question", F.col("place").cast("long").alias("place"), "module", F.col("score").cast("long").alias("score"), "files")
