"""Which modules a question means, by words of the question, of paths, of symbols and of contents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words
from ..functions.boosts import FOCUS_WORDS, foci
from ..functions.text import tokenize
from ..plans.staging import staged

# The modules and the words that stand for them; those named for a subject share its words.
PROFILES: dict[str, list[str]] = {
    "auth": [
        "auth", "authentication", "authorization", "authorize", "authorisation", "login", "signin", "sign-in", "signon", "session", "token", "jwt", "oauth", "passport", "verify", "verified",
        "авторизация", "авторизации", "авториз", "аутентификация", "аутентификации", "аутентифик", "логин", "вход", "токен", "сессия",
    ],
    "billing": [
        "billing", "bill", "payment", "payments", "invoice", "subscription", "subscriptions", "checkout", "cashier", "paddle", "subscribed", "trial", "trials",
        "биллинг", "платеж", "платежи", "оплата", "счет", "инвойс", "подписка", "подписки", "триал", "триалы", "пробный", "пробник",
    ],
    "user": ["user", "users", "profile", "profiles", "account", "accounts", "пользователь", "профиль", "аккаунт"],
    "localization": FOCUS_WORDS["localization"],
    "config": FOCUS_WORDS["config"],
    "servers": [
        "server", "servers", "ssh", "sftp", "ftp", "host", "hostname", "port", "private_key", "private-key", "passphrase", "forwarding", "tunnel", "connection", "connections",
        "соединение", "соединения", "подключение", "подключения", "сервер", "серверы", "ssh-соединение", "ssh-соединения", "хост", "порт", "ключ", "туннель",
    ],
    "vault": [
        "vault", "credential", "credentials", "password", "passwords", "private_key", "share", "shared", "sharing", "envelope", "encryption", "encrypt", "decrypt",
        "пароль", "пароли", "креды", "учетные", "учётные", "секрет", "секреты", "ключ", "ключи", "расшар", "шифр", "шифрование",
    ],
    "notification": ["notification", "notifications", "email", "mail", "sms", "уведомление", "уведомления", "письмо"],
    "model-schema": FOCUS_WORDS["model-schema"],
    "auth-inventory": FOCUS_WORDS["auth"],
    "websocket-inventory": FOCUS_WORDS["websocket"],
    "redis-inventory": FOCUS_WORDS["redis"],
}
#: The subjects of a question that change scores, the first for its modules alone; with the word of the module itself, a module has at most 32 ways to be asked for.
SUBJECTS = ["infrastructure", "localization", "locale-behavior", "config"]
PLACED = ["auth", "servers", "vault"]
_ALIASES = sorted({a.lower() for listed in PROFILES.values() for a in listed})
_JOINED = [a for a in _ALIASES if re.search("[_/-]", a)]
_SPACED = [a for a in _ALIASES if " " in a]
_PLAIN = [a for a in _ALIASES if a not in _JOINED and a not in _SPACED]


def alias_hits(text: Column) -> Column:
    """The aliases that stand in the text: as a token, joined ones anywhere, others of four letters or more as a whole word."""
    low = F.lower(F.coalesce(text, F.lit("")))
    whole = F.filter(F.split(low, r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= words.ALIAS_LEAST)
    plain = F.array_intersect(F.concat(tokenize(low), whole), F.lit(_PLAIN))
    other = [F.when(F.contains(low, F.lit(a)), F.lit(a)) for a in _JOINED] + [F.when(F.contains(low, F.lit(a)) & low.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){a}([^\p{{L}}\p{{N}}_]|$)"), F.lit(a)) for a in _SPACED]
    return F.concat(plain, F.array_compact(F.array(*other)))


def _alias_stem(alias: str) -> str | None:
    stem = re.sub(f"^(.{{{words.STEM_LEAST},}}?)(?:{'|'.join(words.ENDINGS)})$", r"\1", alias)
    return stem if re.search("[а-яё]", alias) and len(stem) >= words.STEM_LEAST else None


def mentions(questions: DataFrame) -> DataFrame:
    """(question, modules) of the modules whose aliases the tokens of a question mean; questions (question, tokens).

    What a word means is worked out once for each distinct token of all questions: it
    means an alias if they are equal, one of four letters or more begins or ends the other,
    or both are Cyrillic with one stem.  Each of these is a key that tokens and aliases are
    joined on; the aliases' keys are a fixed table.
    """
    tokens = questions.select("question", F.explode(F.array_distinct("tokens")).alias("token"))
    known = tokens.select("token").distinct().where(~F.col("token").isin(words.NO_ALIAS))
    least, longest = words.ALIAS_LEAST, max(map(len, _ALIASES))
    stem, token = words.stem(F.col("token")), F.col("token")
    lengths = F.when(F.length(token) >= least, F.sequence(F.lit(least), F.least(F.length(token), F.lit(longest)))).otherwise(F.array().cast("array<int>"))
    ends = F.array_distinct(F.concat(F.transform(lengths, lambda n: F.left(token, n)), F.transform(lengths, lambda n: F.right(token, n))))
    key = lambda way, x: F.struct(F.lit(way).alias("way"), x.alias("key"))
    stems = F.when(token.rlike("[а-яё]") & (F.length(stem) >= words.STEM_LEAST), stem)
    keys = F.concat(F.array(key("whole", token), key("stem", stems)), F.transform(ends, lambda x: key("end", x)))

    fixed = set()
    for module, aliases in PROFILES.items():
        for a in {x.lower() for x in aliases} - set(words.NO_ALIAS):
            fixed |= {("whole", a, module)} | {("whole", x, module) for n in range(least, len(a)) for x in (a[:n], a[-n:])} | {("end", a, module)} | {("stem", _alias_stem(a), module)}
    listed = sorted(x for x in fixed if x[1] is not None and (x[0] != "end" or len(x[1]) >= least))
    table = questions.sparkSession.createDataFrame(listed, "way string, key string, meant string")

    meant = known.select("token", F.inline(keys)).join(F.broadcast(table), ["way", "key"]).select("token", "meant").distinct()
    found = tokens.join(meant, "token").groupBy("question").agg(F.sort_array(F.collect_set("meant")).alias("modules"))
    return questions.select("question").join(found, "question", "left").select("question", F.coalesce("modules", F.array().cast("array<string>")).alias("modules"))


#: What a file's path and content have that changes scores, beside the aliases of modules.
MARKS = ["keyed", "credited", "read", "signed", "handling", "localized", "passing", "configured"]


def _score(subjects: Column) -> Column:
    """What a file is worth for a module, asked for with these subjects; columns module, p, s, c, mentioned and MARKS."""
    module = F.col("module")
    has = lambda *xs: F.array_contains(F.lit(list(xs)), module)
    on = lambda subject: F.array_contains(subjects, subject)
    named = (F.col("p") > 0) | (F.col("s") > 0)
    # Points of a module, beside those of its words.
    adjusted = [
        (F.col("mentioned"), 20),
        (on("infrastructure") & has("auth") & ~F.col("signed"), -18),
        (on("infrastructure") & has("servers", "vault") & named, 24),
        (on("infrastructure") & has("servers") & F.col("keyed"), 16),
        (on("infrastructure") & has("vault") & F.col("credited"), 16),
        (on("localization") & has("localization") & F.col("localized"), 48),
        (on("localization") & has("localization") & named, 24),
        (on("localization") & ~has("localization") & F.col("handling"), -30),
        (on("locale-behavior") & has("localization") & named, 12),
        (on("locale-behavior") & F.col("passing"), 20),
        (on("config") & has("config") & F.col("configured"), 52),
        (on("config") & has("config") & F.col("read"), 24),
        (on("config") & ~has("config") & F.col("handling"), -28),
        (~named & (F.col("c") > 0), -8),
    ]
    base = F.col("p") * 8 + F.col("s") * 6 + F.least(F.col("c"), F.lit(2))
    return sum((F.when(holds, F.lit(n)).otherwise(F.lit(0)) for holds, n in adjusted), base)


def module_intents(files: DataFrame, symbols: DataFrame, questions: DataFrame, limit: int | None = None, most_files: int = 4, most: int = 5) -> DataFrame:
    """(question, place from 1, module, score, files) of the modules that each question means, the likeliest first.

    files (path, content) with distinct paths, symbols (path, label), questions (question,
    text).  A module's score is the sum over all files that score above 0 for it; of files
    with one score the least path goes first, of modules the one that PROFILES lists first.
    Whole contents are read unless ``limit`` says how many characters; the surveyed rule
    takes 2,000.  Null texts count as empty; files without a path are left out.

    A file's score depends on a question only through whether it names the module and
    which of SUBJECTS it has, at most 32 ways a module, and on the file only through its
    counts of aliases and MARKS.  So files of like counts and marks are counted, with the
    least paths of each kind; kinds are scored once for each way that occurs, and questions
    then look the results up: files never meet ways or questions.
    """
    asked = questions.select("question", F.coalesce(tokenize("text"), F.array().cast("array<string>")).alias("tokens"))
    asked = asked.join(mentions(asked), "question").select("question", "modules", F.array_intersect(F.lit(SUBJECTS), foci(F.col("tokens"))).alias("subjects"))
    asked = staged(asked, "asked")
    relevant = F.when(F.col("module").isin(PLACED), F.col("subjects")).otherwise(F.array_remove("subjects", "infrastructure"))
    ways = asked.select("question", "subjects", F.explode(F.transform(F.lit(list(PROFILES)), lambda m: F.struct(m.alias("module"), F.array_contains("modules", m).alias("mentioned")))).alias("w")).select("question", "subjects", "w.*").withColumn("subjects", relevant)
    occurring = F.broadcast(ways.select("module", "mentioned", "subjects").distinct())  # 12 modules, 32 ways each at most

    own = symbols.select("path", F.explode(alias_hits(F.col("label"))).alias("alias")).groupBy("path").agg(F.collect_set("alias").alias("by_symbol"))
    text = F.lower(F.coalesce(F.col("content") if limit is None else F.substring("content", 1, limit), F.lit("")))
    holds = lambda *xs: F.lit(False) if not xs else F.contains(text, F.lit(xs[0])) | holds(*xs[1:])
    low = F.lower("path")
    in_path = lambda *xs: F.lit(False) if not xs else F.contains(low, F.lit(xs[0])) | in_path(*xs[1:])
    seen = [holds("private_key"), holds("credential"), holds("env(", "process.env", "import.meta.env"), in_path("/auth/", "authcontroller"), in_path("/routes/", "/controllers/", "/auth/"), words.is_localization(low), in_path("/middleware/", "/http/", "/requests/", "/config/"), words.is_config(low)]
    read = files.where("path is not null").select("path", alias_hits(F.col("path")).alias("by_path"), alias_hits(text).alias("by_content"), *[m.alias(name) for m, name in zip(seen, MARKS)])
    read = read.join(own, "path", "left").withColumn("by_symbol", F.coalesce("by_symbol", F.array().cast("array<string>")))
    read = staged(read, "hits")  # read several times below, and the texts are not
    n = lambda hits, aliases: F.size(F.array_intersect(hits, F.lit([a.lower() for a in aliases])))
    counted = F.array(*[F.struct(F.lit(m).alias("module"), n("by_path", a).alias("p"), n("by_symbol", a).alias("s"), n("by_content", a).alias("c")) for m, a in PROFILES.items()])
    each = read.select("path", *MARKS, F.inline(counted)).withColumn("c", F.least("c", F.lit(2)))  # no score tells more of them apart
    kind = ["module", "p", "s", "c", *MARKS]
    nth = F.row_number().over(Window.partitionBy(*kind).orderBy("path"))
    least = each.withColumn("n", nth).where(F.col("n") <= most_files).groupBy(*kind).agg(F.collect_list("path").alias("paths"))
    kinds = least.join(each.groupBy(*kind).agg(F.count("*").alias("many")), kind)
    scored = kinds.join(occurring, "module").withColumn("score", _score(F.col("subjects"))).where("score > 0")

    way = ["module", "mentioned", "subjects"]
    total = scored.groupBy(*way).agg(F.sum(F.col("score") * F.col("many")).alias("score"))
    first = scored.select(*way, "score", F.explode("paths").alias("path")).withColumn("n", F.row_number().over(Window.partitionBy(*way).orderBy(F.col("score").desc(), "path"))).where(F.col("n") <= most_files)
    strongest = first.groupBy(*way).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]).alias("files"))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.col("score").desc(), F.array_position(F.lit(list(PROFILES)), F.col("module"))))
    answers = ways.join(F.broadcast(total.join(strongest, way)), way)
    return answers.withColumn("place", place).where(F.col("place") <= most).select("question", "place", "module", "score", "files")
