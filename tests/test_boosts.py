import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import boosts
from codeloom.operators import evidence


def plainly(rules, row, tokens, about, first):
    """The points by substring tests, rule after rule."""
    text = {k: (v or "").lower() for k, v in row.items()}
    path = text.get("path", "")
    looks = {
        "localization": path.startswith(("lang/", "locales/")) or any(x in path for x in ("/lang/", "/locales/", "/i18n/", "/translations/")),
        "config": path.startswith("config/") or "/config/" in path or path.endswith(".env") or ".env." in path,
    }

    def met(mark):
        field, test, literal = mark
        if test == "looks":
            return looks[literal]
        if test == "lacks":
            return literal not in about
        if test == "asked":
            return any(t in text[field] for t in tokens)
        value = text[field]
        return {"has": literal in value, "starts": value.startswith(literal), "ends": value.endswith(literal), "is": value == literal}[test]

    total = 0
    for focus in [f for f in rules if f in about]:
        for condition, points in rules[focus]:
            if any(all(met(m) for m in alternative) for alternative in condition):
                total += points
                if first:
                    break
    return total


@pytest.mark.parametrize("target", ["file", "symbol", "route"])
def test_boosts_equal_plain_evaluation(spark, target):
    rules, rng = boosts.BOOSTS[target], random.Random(5)
    fields = {"file": ["path", "content"], "symbol": ["path", "label", "kind"], "route": ["path"]}[target]
    literals = {f: sorted({m[2] for r in rules.values() for c, _ in r for a in c for m in a if m[0] == f and m[1] in boosts._IN_TEXT}) for f in fields}
    about_all = [*rules, "sign-in", "functional", "settings"]
    rows = []
    for n in range(400):
        row = {f: rng.choice([None, "", "x"]) if rng.random() < 0.1 else rng.choice(["", "app", "İ😀"]).join(rng.choice(literals[f]) for _ in range(rng.randint(1, 1 if f == "kind" else 4))) for f in fields}
        tokens = rng.sample(["server", "lang", "zebra", "ж", "cache"], rng.randint(0, 3))
        rows.append((n, tokens, rng.sample(about_all, rng.randint(0, 5)), *[row[f] for f in fields]))
    df = spark.createDataFrame(rows, "n int, tokens array<string>, about array<string>, " + ", ".join(f"{f} string" for f in fields))
    given = {f: F.col(f) for f in fields}
    out = df.withColumn("met", boosts.marks(rules, **given)).select("n", boosts.boost(rules, F.col("met"), F.col("tokens"), F.col("about"), first=target == "route", **given).alias("p"))
    got = {r.n: r.p for r in out.collect()}
    want = {r[0]: plainly(rules, dict(zip(fields, r[3:])), r[1], r[2], target == "route") for r in rows}
    assert got == want
    assert len(set(want.values())) > 20 or target == "route"


@pytest.mark.parametrize(
    "target, focus, row, points",
    [
        ("file", "infrastructure", {"path": "app/Servers/Server.php", "content": "host port username"}, 40 + 18),
        ("file", "infrastructure", {"path": "app/auth/Login.php", "content": "private_key"}, 24 - 30),
        ("file", "localization", {"path": "lang/en.php", "content": "trans('x')"}, 60 + 24 + 10),
        ("file", "locale-behavior", {"path": "app/Http/Middleware/SetLocale.php", "content": "app()->setLocale($request->header('X-Lang'))"}, 34 + 42 + 28 + 36),
        ("file", "config", {"path": "config/app.php", "content": "env('A')"}, 58 + 26),
        ("file", "model-schema", {"path": "app/Models/A.php", "content": "protected $casts; $this->belongsTo()"}, 50 + 20),
        ("file", "auth", {"path": "app/Auth/Google.php", "content": "OAuth providers"}, 50 + 30 + 20),
        ("file", "websocket", {"path": "routes/Channels/x.php", "content": "websocket"}, 50 + 20),
        ("file", "redis", {"path": "app/Jobs/Sync.php", "content": "session"}, 50 + 20),
        ("symbol", "infrastructure", {"path": "app/Repositories/ServerRepository.php", "label": "ServerRepository.find", "kind": "method"}, 24 + 22 + 24),
        ("symbol", "model-schema", {"path": "app/Models/A.php", "label": "A.hasMany", "kind": "class"}, 25 + 20 + 10),
        ("symbol", "redis", {"path": "routes/x.php", "label": "queue", "kind": "route"}, 20 - 10),
        ("route", "infrastructure", {"path": "app/auth/servers/x.php"}, 16),
        ("route", "infrastructure", {"path": "x.php"}, -4),
        ("route", "localization", {"path": "x.php"}, -42),
        ("route", "locale-behavior", {"path": "x.php"}, 0),
        ("route", "websocket", {"path": "app/vault/x.php"}, -20),
    ],
)
def test_points_of_each_family(spark, target, focus, row, points):
    rules, given = boosts.BOOSTS[target], {f: F.lit(v) for f, v in row.items()}
    empty = F.array().cast("array<string>")
    met = spark.range(1).select(boosts.marks(rules, **given).alias("met"))
    out = met.select(boosts.boost(rules, F.col("met"), empty, F.array(F.lit(focus)), first=target == "route", **given).alias("p"))
    assert out.first().p == points


def test_foci(spark):
    asked = [["where", "is", "the", "locale", "set"], ["translations"], ["таблица"], ["redis", "login"], [], None, ["how"], ["belongsto"]]
    df = spark.createDataFrame([(n, x) for n, x in enumerate(asked)], "n int, tokens array<string>")
    got = {r.n: r.a for r in df.select("n", boosts.foci(F.col("tokens")).alias("a")).collect()}
    assert got == {0: ["localization", "locale-behavior"], 1: ["localization"], 2: ["model-schema"], 3: ["redis", "sign-in"], 4: [], 5: [], 6: ["functional"], 7: []}


def test_retrieve_with_subjects(spark):
    files = spark.createDataFrame([(1, "config/app.php", "x" * 50 + " env('A')"), (2, "app/Http/Auth/routes/a.php", ""), (3, None, None)], "id int, path string, content string")
    symbols = spark.createDataFrame([(4, "Config.get", "config/app.php", "method"), (5, None, None, None)], "id int, label string, path string, kind string")
    routes = spark.createDataFrame([(6, "GET /a", "routes/a.php")], "id int, label string, path string")
    modules = spark.createDataFrame([], "id int, label string")
    out = evidence.retrieve(files, symbols, routes, modules, [["config"]], [], tokens=["how", "config"], intents=[("config", ["config/app.php"])])
    got = {r.id: r.score for r in out.collect()}
    # file: path 6, looks 58, env( 26, asked 6, module 32; symbol: label 8, path 3, kind 24, looks 20, label 10, method -28, asked 4, module 32; route: 36 - 42
    assert got == {1: 6 + 58 + 26 + 6 + 32, 4: 8 + 3 + 24 + 20 + 10 - 28 + 4 + 32}
    short = evidence.retrieve(files, symbols, routes, modules, [["config"]], [], tokens=["config"], limit=10)
    assert {r.id: r.score for r in short.where("kind = 'file'").collect()} == {1: 6 + 58 + 6}
