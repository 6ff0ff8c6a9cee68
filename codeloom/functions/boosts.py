"""What a question is about, and the points that its subjects give to files, symbols and routes.

A rule gives points where a condition holds.  Conditions are alternatives of marks that
must all be met; a mark is a literal in a field, a look of the path, or a word of the
question.  All literals of a field are found in one pass over its text by an automaton
(:func:`marks`), however many rules there are; what the marks are worth is then reckoned by
array functions (:func:`boost`), so a candidate's marks serve every question.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words

#: (field, test, literal); test is "has", "starts", "ends", "is", "looks" or "asked".
Mark = tuple[str, str, str]
#: Alternatives; each holds where all its marks are met, so one without marks always does.
Condition = tuple[tuple[Mark, ...], ...]

ALWAYS: Condition = ((),)


def some(field: str, *literals: str, test: str = "has") -> Condition:
    return tuple(((field, test, x),) for x in literals)


def either(*conditions: Condition) -> Condition:
    return tuple(alternative for c in conditions for alternative in c)


def both(*conditions: Condition) -> Condition:
    return tuple(tuple(m for alternative in picked for m in alternative) for picked in product(*conditions))


def looks(kind: str) -> Condition:
    return some("path", kind, test="looks")


def asked(*fields: str) -> Condition:
    """A token of the question stands in one of the fields."""
    return either(*[some(f, "", test="asked") for f in fields])


# The words by which a question shows its subject.
FOCUS_WORDS: dict[str, list[str]] = {
    "infrastructure": [
        "ssh", "sftp", "ftp", "server", "servers", "connection", "connections", "credential", "credentials", "host", "hostname", "port", "private_key", "passphrase", "vault",
        "сервер", "серверу", "сервером", "подключение", "подключения", "соединение", "соединения", "ssh-соединения", "хост", "порт", "пароль", "пароли", "ключ", "ключи",
    ],
    "localization": [
        "localization", "locale", "locales", "translation", "translations", "translate", "i18n", "lang", "language", "languages",
        "локализация", "локализации", "перевод", "переводы", "язык", "языки", "языков", "локаль", "локали", "локалей",
    ],
    "config": [
        "config", "configs", "configuration", "settings", "setting", "env", "environment", "variable", "variables", "dotenv",
        "конфиг", "конфиги", "конфигурация", "настройка", "настройки", "переменная", "переменные", "окружение", "env-переменные",
    ],
    "model-schema": [
        "model", "models", "schema", "schemas", "entity", "entities", "field", "fields", "column", "columns", "attribute", "attributes", "property", "properties", "relation", "relations", "relationship", "relationships", "belongsTo", "hasMany", "hasOne", "morphMany", "morphOne",
        "модель", "модели", "схема", "схемы", "сущность", "сущности", "поле", "поля", "колонка", "колонки", "атрибут", "атрибуты", "свойство", "свойства", "отношение", "отношения",
    ],
    "auth": ["google", "oauth", "socialite", "provider", "providers", "google-auth", "googleauth", "google-authentication", "google-авторизация", "google-аутентификация", "гугл", "гугл-авторизация", "гугл-аутентификация", "google-логин", "google-вход"],
    "websocket": [
        "websocket", "websockets", "ws", "socket", "sockets", "realtime", "real-time", "pusher", "laravel-echo", "echo", "broadcast", "broadcasting", "channel", "channels",
        "вебсокет", "вебсокеты", "сокет", "сокеты", "реалтайм", "реал-тайм", "пушер", "эхо", " бродкаст", " бродкастинг", "канал", "каналы",
    ],
    "redis": ["redis", "cache", "caching", "session", "sessions", "queue", "queues", "job", "jobs", "worker", "workers", "редис", "кэш", "кэширование", "сессия", "сессии", "очередь", "очереди", "джоб", "джобы", "воркер", "воркеры"],
    "functional": ["how", "work", "works", "flow", "behavior", "behaviour", "работает", "работа", "как", "зачем", "why", "process", "модуль", "module"],
}
#: Words that ask for a table's columns, for what a locale does, for sign-in and for settings.
TABLE_WORDS = ["table", "tables", "таблица", "таблицы", "таблице", "таблицу", "таблицей", "таблиц"]
BEHAVIOR_WORDS = [
    "how", "work", "works", "flow", "behavior", "behaviour", "request", "response", "header", "headers", "middleware", "default", "fallback", "where", "set", "sets",
    "выбирается", "выбора", "где", "задается", "задаётся", "устанавливается", "определяется", "определение", "работает", "как", "почему", "ответ", "ответа", "заголовок", "заголовки", "мидлвар", "дефолт",
]
SIGN_IN_WORDS = ["auth", "login", "oauth", "token"]
SETTING_WORDS = ["config", "конфиг", "env"]


def foci(tokens: Column) -> Column:
    """The subjects of a question with these tokens, in the order of FOCUS_WORDS.

    "locale-behavior" stands for a question on locales that also asks how something works;
    "sign-in" and "settings" say that such words are asked for.  Null tokens give none.
    """
    meets = lambda listed: F.coalesce(F.arrays_overlap(tokens, F.lit(listed)), F.lit(False))
    named = [(name, meets(listed + TABLE_WORDS if name == "model-schema" else listed)) for name, listed in FOCUS_WORDS.items()]
    named += [("locale-behavior", meets(FOCUS_WORDS["localization"]) & meets(BEHAVIOR_WORDS)), ("sign-in", meets(SIGN_IN_WORDS)), ("settings", meets(SETTING_WORDS))]
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in named]))


_SERVER_PATH = either(some("path", "/servers/"), both(some("path", "server"), some("path", "credential")), both(some("path", "/models/"), some("path", "server")))
_HANDLERS = some("path", "/routes/", "/controllers/")
_SCHEMAS = some("path", "/models/", "/entities/", "/schemas/")
_SIGN_IN = some("path", "/auth/", "socialite", "google")
_CHANNELS = some("path", "/websocket/", "/websockets/", "/broadcast/", "/channels/", "/echo/")
_QUEUES = some("path", "/redis/", "/cache/", "/queue/", "/jobs/", "/workers/")
_FOREIGN = some("path", "/billing/", "/servers/", "/vault/")
_ENTRY = some("kind", "route", "method", test="is")
_UNASKED = ((("question", "lacks", "sign-in"),),)

# Points of a condition in questions on a subject.  Of files and symbols all
# that hold add up, of routes the first counts.  Texts are lower-cased and literals are not,
# so names such as belongsTo are never met in a content.
BOOSTS: dict[str, dict[str, list[tuple[Condition, int]]]] = {
    "file": {
        "infrastructure": [
            (_SERVER_PATH, 40),
            (both(some("path", "/repositories/", "/repository/"), some("path", "server")), 38),
            (both(some("path", "/requests/", "/dto/", "/validators/"), some("path", "server")), 40),
            (some("path", "/vault/", "/models/password"), 24),
            (both(some("path", "migration"), some("content", "server")), 36),
            (both(some("content", "credential"), some("content", "server")), 36),
            (some("content", "private_key"), 24),
            (both(some("content", "forwarding"), some("content", "port")), 22),
            (both(some("content", "host"), some("content", "port"), some("content", "username")), 18),
            (some("path", "/observers/"), -34),
            (both(some("path", "/auth/"), _UNASKED), -30),
        ],
        "localization": [
            (looks("localization"), 60),
            (either(some("path", "/lang/"), some("path", "lang/", test="starts"), some("path", "/translations/")), 24),
            (some("content", "__(", "trans("), 10),
            (either(_HANDLERS, some("path", "/auth/")), -36),
            (asked("path"), 6),
        ],
        "locale-behavior": [
            (some("path", "/middleware/", "/http/", "/requests/"), 34),
            (some("path", "/config/"), 26),
            (some("path", "/lang/", "/translations/"), -18),
            (some("content", "x-lang", "accept-language"), 42),
            (some("content", "request->header", "header(", "headers->get"), 28),
            (some("content", "setlocale", "app()->setlocale", "set_locale"), 36),
            (some("content", "config(", "env(", "fallback_locale", "default_locale"), 18),
            (asked("path", "content"), 6),
        ],
        "config": [
            (looks("config"), 58),
            (some("content", "env(", "process.env", "import.meta.env"), 26),
            (either(_HANDLERS, some("path", "/auth/")), -36),
            (asked("path"), 6),
        ],
        "model-schema": [
            (_SCHEMAS, 50),
            (some("content", "belongsTo", "hasMany", "hasOne", "morphMany", "morphOne"), 30),
            (some("content", "protected $fillable", "protected $casts", "protected $dates"), 20),
            (some("path", "/migrations/"), -20),
            (asked("path", "content"), 6),
        ],
        "auth": [
            (_SIGN_IN, 50),
            (some("content", "socialite", "google", "oauth"), 30),
            (some("content", "provider", "providers"), 20),
            (_HANDLERS, -10),
            (asked("path", "content"), 6),
        ],
        "websocket": [
            (_CHANNELS, 50),
            (some("content", "pusher", "laravel-echo", "broadcast", "channel"), 30),
            (some("content", "realtime", "real-time", "websocket"), 20),
            (_HANDLERS, -10),
            (asked("path", "content"), 6),
        ],
        "redis": [
            (_QUEUES, 50),
            (some("content", "redis", "cache", "queue", "job", "worker"), 30),
            (some("content", "session", "sessions"), 20),
            (_HANDLERS, -10),
            (asked("path", "content"), 6),
        ],
    },
    "symbol": {
        "infrastructure": [
            (some("label", "server", "credential", "forwarding", "privatekey"), 24),
            (both(some("label", "repository", "request", "validator"), some("label", "server")), 22),
            (_SERVER_PATH, 24),
            (both(some("path", "/repositories/", "/repository/", "/requests/", "/dto/", "/validators/"), some("path", "server")), 24),
            (some("path", "/observers/"), -30),
            (both(some("path", "/auth/"), _UNASKED), -24),
        ],
        "localization": [
            (looks("localization"), 20),
            (some("label", "lang", "locale", "translation"), 12),
            (_ENTRY, -28),
            (asked("label"), 4),
        ],
        "locale-behavior": [
            (some("path", "/middleware/", "/http/", "/config/"), 18),
            (some("label", "locale", "lang", "language"), 18),
            (some("label", "middleware", "header", "request"), 16),
            (some("kind", "middleware", "method", test="is"), 12),
            (looks("localization"), -14),
            (asked("label"), 6),
        ],
        "config": [
            (looks("config"), 20),
            (some("label", "config", "env", "settings"), 10),
            (_ENTRY, -28),
            (asked("label"), 4),
        ],
        "model-schema": [
            (_SCHEMAS, 25),
            (some("label", "model", "entity", "schema", "field", "column", "attribute", "property", "relation"), 15),
            (some("label", "belongsto", "hasmany", "hasone", "morphmany", "morphone"), 20),
            (some("kind", "class", "interface", test="is"), 10),
            (_ENTRY, -15),
            (asked("label"), 4),
        ],
        "auth": [
            (_SIGN_IN, 25),
            (some("label", "google", "oauth", "socialite", "provider"), 20),
            (_ENTRY, -10),
            (asked("label"), 4),
        ],
        "websocket": [
            (_CHANNELS, 25),
            (some("label", "websocket", "socket", "pusher", "echo", "broadcast", "channel"), 20),
            (_ENTRY, -10),
            (asked("label"), 4),
        ],
        "redis": [
            (_QUEUES, 25),
            (some("label", "redis", "cache", "queue", "job", "worker", "session"), 20),
            (_ENTRY, -10),
            (asked("label"), 4),
        ],
    },
    "route": {
        "infrastructure": [(some("path", "/servers/"), 16), (some("path", "/auth/"), -22), (ALWAYS, -4)],
        "localization": [(looks("localization"), 8), (ALWAYS, -42)],
        "locale-behavior": [(some("path", "/middleware/", "/http/"), 12), (looks("localization"), -24)],
        "config": [(looks("config"), 8), (ALWAYS, -42)],
        "model-schema": [(_SCHEMAS, 10), (either(_HANDLERS, some("path", "/auth/")), -30), (ALWAYS, -5)],
        "auth": [(_SIGN_IN, 15), (_FOREIGN, -20), (ALWAYS, -5)],
        "websocket": [(_CHANNELS, 15), (_FOREIGN, -20), (ALWAYS, -5)],
        "redis": [(_QUEUES, 15), (_FOREIGN, -20), (ALWAYS, -5)],
    },
}
Rules = dict[str, list[tuple[Condition, int]]]
_LOOKS = {"localization": words.is_localization, "config": words.is_config}
_IN_TEXT = {"has": lambda at_start, at_end: True, "starts": lambda at_start, at_end: at_start, "ends": lambda at_start, at_end: at_end, "is": lambda at_start, at_end: at_start and at_end}


def _numbered(rules: Rules) -> dict[Mark, int]:
    """A number for every mark of the rules."""
    return {m: n for n, m in enumerate(sorted({m for listed in rules.values() for condition, _ in listed for a in condition for m in a}))}


def marks(rules: Rules, **fields: Column) -> Column:
    """The numbers of the marks that a candidate meets whatever the question; null fields count as empty.

    Every field is lower-cased and read once; the time depends on its length and on what is
    found, not on the number of rules.  :func:`boost` takes the result as a column of its
    own, made in an earlier select.
    """
    known = _numbered(rules)
    names = [f for f in fields if any(m[0] == f and m[1] in _IN_TEXT for m in known)]
    wanted = {f: [(m[2], m[1], n) for m, n in known.items() if m[0] == f and m[1] in _IN_TEXT] for f in names}

    def met(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        import ahocorasick

        automata = []
        for f in names:
            by_literal: dict[str, list[tuple[str, int]]] = {}
            for literal, test, n in wanted[f]:
                by_literal.setdefault(literal, []).append((test, n))
            automaton = ahocorasick.Automaton()
            for literal, ways in by_literal.items():
                automaton.add_word(literal, (len(literal), ways))
            automaton.make_automaton()
            automata.append(automaton)
        for columns in batches:
            columns = (columns,) if isinstance(columns, pd.Series) else columns
            out = []
            for texts in zip(*columns):
                found = set()
                for automaton, text in zip(automata, texts):
                    for end, (length, ways) in automaton.iter(text):
                        found.update(n for test, n in ways if _IN_TEXT[test](end + 1 == length, end + 1 == len(text)))
                out.append(sorted(found))
            yield pd.Series(out, dtype=object)

    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    once = F.pandas_udf(met, "array<int>").asNondeterministic()  # else a filter on the points would be pushed below and read the texts again
    out = [once(*[text(fields[f]) for f in names])] if names else []
    seen = [F.when(_LOOKS[m[2]](F.coalesce(fields[m[0]], F.lit(""))), F.lit(n)) for m, n in known.items() if m[1] == "looks"]
    return F.concat(*out, F.array_compact(F.array(*seen)).cast("array<int>")) if out or seen else F.array().cast("array<int>")


def boost(rules: Rules, met: Column, tokens: Column, about: Column, first: bool = False, **fields: Column) -> Column:
    """The points of the rules of a question's subjects ``about`` for a candidate with the marks ``met``.

    ``first`` takes the first rule that holds of each subject instead of the sum of all.
    Null tokens or subjects give 0.
    """
    known = _numbered(rules)
    text = lambda f: F.lower(F.coalesce(fields[f], F.lit("")))
    tokens, about = F.coalesce(tokens, F.array().cast("array<string>")), F.coalesce(about, F.array().cast("array<string>"))
    holds_one = lambda value: F.exists(tokens, lambda x: F.contains(value, x))
    later = [F.when(holds_one(text(m[0])), F.lit(n)) for m, n in known.items() if m[1] == "asked"]
    later += [F.when(~F.array_contains(about, m[2]), F.lit(n)) for m, n in known.items() if m[1] == "lacks"]
    met = F.concat(met, F.array_compact(F.array(*later))) if later else met
    row = lambda focus, condition, points: F.struct(F.lit(focus).alias("focus"), F.lit(points).alias("points"), F.lit([[known[m] for m in a] for a in condition]).cast("array<array<int>>").alias("any"))
    table = F.array(*[row(focus, condition, points) for focus, listed in rules.items() for condition, points in listed])
    held = F.filter(table, lambda r: F.array_contains(about, r["focus"]) & F.exists(r["any"], lambda a: F.size(F.array_except(a, met)) == 0))
    if first:
        held = F.filter(held, lambda r, n: F.array_position(F.transform(held, lambda x: x["focus"]), r["focus"]) == n + 1)
    return F.aggregate(held, F.lit(0), lambda total, r: total + r["points"])


def kind_points(kind: Column, about: Column) -> Column:
    """What a symbol's kind is worth in a question on the subjects ``about``."""
    has = lambda x: F.array_contains(about, x)
    # Points by kind, in questions on infrastructure, in those that ask how something works, in others.
    placed = {"class": 24, "method": 16, "route": 14, "function": 10}
    plain = {"route": (42, 18), "method": (24, 10), "class": (12, 12), "function": (8, 8)}
    out = F.when(F.lit(False), F.lit(0))
    for name, n in placed.items():
        out = out.when(has("infrastructure") & (kind == name), F.lit(n))
    for name, (how, else_) in plain.items():
        out = out.when(kind == name, F.when(has("functional"), F.lit(how)).otherwise(F.lit(else_)))
    return out.when((kind == "variable") & has("settings"), F.lit(10)).otherwise(F.lit(0))


def module_points(path: Column, intents: list[tuple[str, list[str]]]) -> Column:
    """What the modules that a question means, the likeliest first, are worth to a file: more for their strongest files than for a path that names one."""
    out, low = F.lit(0), F.lower(F.coalesce(path, F.lit("")))
    for n, (module, files) in enumerate(intents):
        strongest = path.isin(files) if files else F.lit(False)
        out = out + F.when(strongest, F.lit(max(32 - 8 * n, 8))).when(F.contains(low, F.lit(module.lower())), F.lit(max(18 - 4 * n, 4))).otherwise(F.lit(0))
    return out
