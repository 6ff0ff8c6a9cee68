"""Words of questions, names and paths as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_path, tokenize

# Endings that a stem loses, how much of a word must stay, stems of borrowed
# terms with their Latin words, and words that never match an alias.
ENDINGS = ["иями", "иях", "ями", "ами", "его", "ему", "ыми", "ими", "ой", "ей", "ем", "ём", "ов", "ев", "ёв", "ая", "яя", "ое", "ее", "ых", "их", "ую", "юю", "ы", "и", "а", "я", "у", "ю", "е", "ь"]
STEM_LEAST = 4
BORROWED = [
    ("алиас", "alias"), ("консол", "console"), ("контроллер", "controller"), ("роут", "route"), ("сервис", "service"), ("компонент", "component"), ("интерфейс", "interface"), ("экшен", "action"), ("экшн", "action"), ("ивент", "event"), ("хендлер", "handler"),
    ("хэндлер", "handler"), ("миграц", "migration"), ("репозитор", "repository"), ("валидатор", "validator"), ("провайдер", "provider"), ("мидлвар", "middleware"), ("мидлвэр", "middleware"), ("воркер", "worker"), ("джоб", "job"), ("токен", "token"), ("сессия", "session"),
    ("кэш", "cache"), ("кеш", "cache"), ("юзер", "user"), ("профил", "profile"), ("релейш", "relation"), ("репликейт", "replicate"), ("репликейш", "replicat"), ("кейс", "case"), ("флоу", "flow"), ("эквайр", "acquir"), ("гугл", "google"), ("подписк", "subscription"),
]
NO_ALIAS = [
    "при", "из-за", "из", "за", "для", "под", "над", "про", "на", "по", "как", "что", "это", "эта", "эти", "этот", "эту", "если", "или", "либо", "так", "уже", "все", "всех", "всей", "всем", "куда", "когда", "чем", "чему", "чтобы", "то", "тот", "которая", "который", "которые",
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "her", "was", "one", "our", "out", "his", "has", "had",
]
ALIAS_LEAST = 4
LAYOUT_FOLDERS = ["app", "src", "apps", "packages", "lib", "source", "containers", "modules", "domains", "features", "components"]


def stem(word: Column) -> Column:
    """The word without its longest known ending, where at least STEM_LEAST letters stay."""
    return F.regexp_replace(word, f"^(.{{{STEM_LEAST},}}?)(?:{'|'.join(ENDINGS)})$", "$1")


def transliterate(tokens: Column) -> Column:
    """The tokens and the Latin word of each known borrowed stem that one begins with, without repeats."""
    return F.array_distinct(F.concat(tokens, F.flatten(F.transform(tokens, lambda t: F.array_compact(F.array(*[F.when(t.startswith(s), F.lit(latin)) for s, latin in BORROWED]))))))


def name_parts(name: Column) -> Column:
    """Lower-cased parts of two characters or more of a camelCase or separated name."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9а-яё]+"), lambda p: F.length(p) >= 2)


def raw_names(text: Column) -> Column:
    return F.filter(F.split(text, "[^A-Za-z0-9_/-]+"), lambda x: x != "")


def compound_groups(text: Column) -> Column:
    """The parts of each name in the text that has two or more; all of a group must match."""
    return F.filter(F.transform(raw_names(text), name_parts), lambda g: F.size(g) > 1)


def token_groups(text: Column) -> Column:
    """Each token of the text, transliterated ones too, as a group of its own, then the compound groups."""
    return F.concat(F.transform(transliterate(tokenize(text)), lambda x: F.array(x)), compound_groups(text))


def entity_hints(text: Column) -> Column:
    """(compact, parts) of names with two parts or more, and of capitalised ones of six characters or more."""
    named = F.transform(raw_names(text), lambda r: F.struct(r.alias("raw"), name_parts(r).alias("parts")))
    named = F.transform(named, lambda x: F.struct(x["raw"].alias("raw"), F.array_join(x["parts"], "").alias("compact"), x["parts"].alias("parts")))
    kept = F.filter(named, lambda x: (F.size(x["parts"]) >= 2) | (x["raw"].rlike("[A-Z]") & (F.length(x["compact"]) >= 6)))
    return F.transform(kept, lambda x: F.struct(x["compact"].alias("compact"), x["parts"].alias("parts")))


def alias_matches(token: Column, alias: Column) -> Column:
    """Whether a token means an alias: equal, one of four letters or more at an end of the other, or equal stems of Cyrillic words."""
    ends = lambda whole, part: (F.length(part) >= ALIAS_LEAST) & (whole.startswith(part) | whole.endswith(part))
    stems = token.rlike("[а-яёА-ЯЁ]") & alias.rlike("[а-яёА-ЯЁ]") & (F.length(stem(token)) >= STEM_LEAST) & (stem(token) == stem(alias))
    return ~token.isin(NO_ALIAS) & ~alias.isin(NO_ALIAS) & ((token == alias) | ends(alias, token) | ends(token, alias) | stems)


def distinctive(text: Column) -> Column:
    """Tokens that name something: with digits, short acronyms, mixed case, or snake case; the first of each spelling without case."""
    found = F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9_-]*"), F.lit(0))
    kept = F.filter(found, lambda x: x.rlike("[0-9]") | x.rlike("^[A-Z]{2,6}$") | (x.rlike("[a-z]") & x.rlike("[A-Z]") & (F.length(x) >= 3)) | (F.contains(x, F.lit("_")) & (F.length(x) >= 5)))
    low = F.transform(kept, lambda x: F.lower(x))
    return F.filter(kept, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


# ---- labels and classes of paths ----


def _parts(path: Column) -> Column:
    return F.filter(F.split(normalize_path(path), "/"), lambda p: p != "")


def module_label(path: Column) -> Column:
    """The structural module of a path: a known layout's label, else its first folder, else 'root'."""
    p = _parts(path)
    at = lambda n: F.try_element_at(p, F.lit(n))
    labelled = F.when((at(1) == "app") & (at(2) == "src") & (at(3) == "Containers") & at(4).isNotNull(), F.concat(F.lit("containers:"), at(4)))
    labelled = labelled.when((at(1) == "app") & (at(2) == "src") & (at(3) == "Ship"), F.lit("ship"))
    labelled = labelled.when((at(1) == "resources") & (at(2) == "lang") & at(3).isNotNull(), F.concat(F.lit("localization:"), at(3)))
    labelled = labelled.when((at(1) == "resources") & (at(2) == "views") & at(3).isNotNull(), F.concat(F.lit("views:"), at(3)))
    for folder in ("database", "routes"):
        labelled = labelled.when((at(1) == folder) & at(2).isNotNull(), F.concat(F.lit(folder + ":"), at(2)))
    return F.coalesce(labelled, at(1), F.lit("root"))


def localization_bucket(path: Column) -> Column:
    """The folder or file after the first 'lang', else after the first 'locales'; null if none."""
    p = _parts(path)
    low = F.transform(p, lambda x: F.lower(x))
    after = lambda name: F.when(F.array_position(low, F.lit(name)) > 0, F.try_element_at(p, (F.array_position(low, F.lit(name)) + 1).cast("int")))
    return F.coalesce(after("lang"), after("locales"))


def planning_label(path: Column) -> Column:
    joined = F.array_join(F.slice(_parts(path), 1, 3), "/")
    return F.when(joined == "", F.lit("root")).otherwise(joined)


def folders(path: Column) -> Column:
    """The folders of a path, outermost first."""
    p = _parts(path)
    return F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))


def is_localization(path: Column) -> Column:
    low = F.lower(normalize_path(path))
    return low.rlike("^lang/|/lang/|^locales/|/locales/|/i18n/|/translations/")


def is_config(path: Column) -> Column:
    low = F.lower(normalize_path(path))
    return low.rlike(r"^config/|/config/|\.env$|\.env\.")


def is_storage(path: Column) -> Column:
    low = F.lower(normalize_path(path))
    pair = lambda a, b: F.contains(low, F.lit(a)) & F.contains(low, F.lit(b))
    return low.rlike("/servers/|/vault/|/migrations/|/repositories/|/requests/|/models/server|/models/password") | pair("server", "credential") | pair("forwarding", "port")
