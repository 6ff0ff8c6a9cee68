import random
import re

from pyspark.sql import functions as F

from codeloom.functions import words
from codeloom.functions.boosts import FOCUS_WORDS, foci
from codeloom.operators import intents
from codeloom.operators.intents import PROFILES, alias_hits, mentions, module_intents

WORD = r"[^\W_]|_"


def tokens_of(text):
    return set(re.findall("[a-z0-9а-яё_/-]{2,}", (text or "").lower()))


def count(text, aliases):
    low, n = (text or "").lower(), 0
    for a in (x.lower() for x in aliases):
        if a in tokens_of(low):
            n += 1
        elif re.search("[_/-]", a):
            n += a in low
        elif len(a) >= 4:
            n += bool(re.search(rf"(?<!\w){re.escape(a)}(?!\w)" if not a.startswith(" ") else rf"(^|\W){re.escape(a)}(?!\w)", low))
    return n


def test_alias_hits_equal_counts(spark):
    rng = random.Random(2)
    aliases = sorted({a for x in PROFILES.values() for a in x})
    texts = [None, "", "src/auth/login.ts", "authx login_", "real-time", "x бродкаст y", ", бродкаст.", "бродкаст", "the ws sms port", "HASMANY"]
    texts += ["".join(rng.choice(aliases) + rng.choice([" ", "/", "-", "_", "s", ", ", "й"]) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = {r.n: r.h for r in df.select("n", alias_hits(F.col("text")).alias("h")).collect()}
    for n, text in enumerate(texts):
        for module, listed in PROFILES.items():
            assert len(set(got[n]) & {a.lower() for a in listed}) == count(text, listed), (text, module)


def test_mentions_equal_the_pairwise_rule(spark):
    asked = [["transportation", "usernames"], ["серверами"], ["the"], ["транспортировка"], ["authorizations", "modelling"], [], ["ключом", "зашифрован"], ["subscript"], ["ws"]]
    df = spark.createDataFrame(list(enumerate(asked)), "question int, tokens array<string>")
    got = {r.question: r.modules for r in mentions(df).collect()}
    pairs = spark.createDataFrame([(q, t, m, a) for q, ts in enumerate(asked) for t in ts for m, x in PROFILES.items() for a in x], "q int, t string, m string, a string")
    want = {n: set() for n in range(len(asked))}
    for r in pairs.where(words.alias_matches(F.col("t"), F.col("a"))).collect():
        want[r.q].add(r.m)
    assert {q: set(m) for q, m in got.items()} == want
    assert want[1] and not want[2]


def plain_intents(files, symbols, questions):
    localized = lambda p: p.startswith(("lang/", "locales/")) or any(x in p for x in ("/lang/", "/locales/", "/i18n/", "/translations/"))
    configured = lambda p: p.startswith("config/") or "/config/" in p or p.endswith(".env") or ".env." in p
    out = []
    for question, subjects, meant in questions:
        scores = []
        for order, (m, aliases) in enumerate(PROFILES.items()):
            total, ranked = 0, []
            for path, content in files:
                p, c = path.lower(), (content or "").lower()
                np, ns, nc = count(path, aliases), count(" ".join(x for f, x in symbols if f == path), aliases), count(content, aliases)
                s = np * 8 + ns * 6 + min(nc, 2) + (20 if m in meant else 0)
                handler = any(x in p for x in ("/routes/", "/controllers/", "/auth/"))
                if "infrastructure" in subjects:
                    s -= 18 if m == "auth" and "/auth/" not in p and "authcontroller" not in p else 0
                    s += 24 if m in ("servers", "vault") and np + ns else 0
                    s += 16 if (m == "servers" and "private_key" in c) or (m == "vault" and "credential" in c) else 0
                if "localization" in subjects:
                    s += (48 if localized(p) else 0) + (24 if np + ns else 0) if m == "localization" else -30 if handler else 0
                if "locale-behavior" in subjects:
                    s += 12 if m == "localization" and np + ns else 0
                    s += 20 if any(x in p for x in ("/middleware/", "/http/", "/requests/", "/config/")) else 0
                if "config" in subjects:
                    s += (52 if configured(p) else 0) + (24 if any(x in c for x in ("env(", "process.env", "import.meta.env")) else 0) if m == "config" else -28 if handler else 0
                s -= 8 if nc and not np + ns else 0
                if s > 0:
                    total += s
                    ranked.append((-s, path))
            if total:
                scores.append((-total, order, m, [p for _, p in sorted(ranked)[:4]]))
        out += [(question, place + 1, m, -t, f) for place, (t, _, m, f) in enumerate(sorted(scores)[:5])]
    return sorted(out)


def test_module_intents_equal_the_plain_form(spark):
    rng = random.Random(9)
    parts = ["app", "Auth", "servers", "lang", "config", "Http", "Middleware", "routes", "Controllers", "models", "vault", "x"]
    said = ["private_key", "credential", "env('A')", "user", "google", "invoice", "locale", "plain", "queue"]
    files = [("/".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + f"/f{n}.php", rng.choice([None, "", " ".join(rng.choice(said) for _ in range(4))])) for n in range(60)]
    symbols = [(rng.choice(files)[0], rng.choice(["User.email", "Invoice", "getLocale", "queue worker", None, "Token-X"])) for _ in range(40)]
    questions = [(1, "how does the locale work"), (2, "where is the server password"), (3, "which config variables"), (4, "zebra"), (5, None), (6, "invoice and users"), (7, "zebra"), (8, "how is the language of the server set in config")]
    asked = spark.createDataFrame(questions, "question int, text string")
    tokens = {q: sorted(tokens_of(x)) for q, x in questions}
    frame = spark.createDataFrame(list(tokens.items()), "question int, tokens array<string>")
    about = {r.question: r.a for r in frame.select("question", foci(F.col("tokens")).alias("a")).collect()}
    meant = {r.question: r.modules for r in mentions(frame).collect()}
    f = spark.createDataFrame(files + [(None, "user")], "path string, content string")
    s = spark.createDataFrame([x for x in symbols if x[1]] + [(symbols[0][0], None), (None, "User")], "path string, label string")
    got = sorted(tuple(r) for r in module_intents(f, s, asked).select("question", "place", "module", "score", "files").collect())
    assert got == plain_intents(files, [x for x in symbols if x[1]], [(q, about[q], meant[q]) for q, _ in questions])
    assert FOCUS_WORDS["config"] == PROFILES["config"]
    assert module_intents(f.limit(0), s, asked).count() == 0


def test_kinds_of_files_are_scored_not_files(spark, monkeypatch):
    scored = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (scored.add(1), x)[1], "int").asNondeterministic()
    monkeypatch.setattr(intents, "_score", lambda subjects, kept=intents._score: seen(kept(subjects).cast("int")))
    files = spark.createDataFrame([(f"app/auth/{i:03}.php", "login of a user" if i % 2 else "nothing") for i in range(300)], "path string, content string")
    asked = spark.createDataFrame([(1, "how does the login work")], "question int, text string")
    found = intents.module_intents(files, files.select("path", F.lit("auth").alias("label")), asked).orderBy("place").collect()
    assert found[0]["module"] == "auth" and found[0]["files"] == [f"app/auth/{i:03}.php" for i in (1, 3, 5, 7)]
    assert scored.value < 300
