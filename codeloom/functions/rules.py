"""Scores from rule tables: a rule adds points where a field meets a test on any of its literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules are (field, test, literals, points); test is "has", "starts" or "ends".
Rule = tuple[str, str, tuple[str, ...], int]

# What a path and its text are worth in the context of each search profile.
CONTEXT_RULES: dict[str, list[Rule]] = {
    "entrypoint-traversal": [
        ("path", "has", ("/routes/",), 28),
        ("path", "has", ("/controllers/",), 24),
        ("path", "has", ("/services/", "/actions/"), 18),
        ("path", "has", ("/requests/", "/middleware/"), 14),
        ("path", "has", ("/models/",), 10),
        ("path", "has", ("/lang/", "/config/"), -12),
        ("text", "has", ("route", "controller", "login", "auth"), 12),
    ],
    "storage-topology": [
        ("path", "has", ("/models/", "/repositories/"), 18),
        ("path", "has", ("/migrations/", "/requests/"), 16),
        ("text", "has", ("host", "port", "username", "private_key"), 16),
        ("path", "has", ("/views/", "/lang/"), -20),
    ],
    "localization-inventory": [
        ("text", "has", ("translation", "locale", "локал", "язык"), 12),
        ("path", "has", ("/routes/", "/controllers/", "/services/"), -28),
    ],
    "config-inventory": [
        ("text", "has", ("env(", "process.env", "import.meta.env"), 14),
        ("path", "has", ("/routes/", "/controllers/", "/views/"), -28),
    ],
    "broad-scan": [
        ("path", "starts", ("app/", "src/", "packages/"), 12),
        ("path", "has", ("/routes/", "/controllers/", "/config/"), 8),
        ("text", "has", ("summary", "фокус-зона"), -4),
    ],
}
#: Folders that hold sources, and what asks for tests, documents and settings.
SOURCE_RULES: list[Rule] = [("path", "starts", ("app/", "src/", "lib/", "packages/"), 10), ("path", "has", ("/src/",), 12)]
ASKED = {"test": ("test", "тест", "coverage"), "doc": ("doc", "docs", "док", "documentation"), "config": ("config", "конфиг", "env", "environment")}
#: Points of an entity match of strength 3 and 2 in the path, then in the label.
ENTITY_POINTS = {"file": ((42, 20), (0, 0)), "symbol": ((56, 28), (16, 8)), "route": ((26, 12), (14, 6)), "module": ((0, 0), (18, 8))}


def holds(value: Column, test: str, literals: tuple[str, ...]) -> Column:
    one = {"has": lambda x: F.contains(value, F.lit(x)), "starts": lambda x: value.startswith(x), "ends": lambda x: value.endswith(x)}[test]
    out = F.lit(False)
    for x in literals:
        out = out | one(x)
    return F.coalesce(out, F.lit(False))


def points(rules: list[Rule], **fields: Column) -> Column:
    """The sum of the points of all rules that hold; fields are lower-cased."""
    low = {k: F.lower(F.coalesce(v, F.lit(""))) for k, v in fields.items()}
    return sum((F.when(holds(low[field], test, literals), F.lit(n)).otherwise(F.lit(0)) for field, test, literals, n in rules), F.lit(0))


def path_points(path: Column, tokens: list[str], zones: list[str]) -> Column:
    """What a path is worth: source folders and focus zones add; tests, documents and settings that no token asks for take away."""
    rules = [*SOURCE_RULES]
    if zones:
        rules.append(("path", "has", tuple(z.lower() for z in zones), 22))
    score, low = points(rules, path=path), F.lower(path)
    for kind, test, loss in (("test", holds(low, "has", ("/test", ".test.", ".spec.")), 20), ("doc", holds(low, "has", ("/docs/",)) | holds(low, "ends", (".md",)), 16), ("config", holds(low, "ends", (".json",)) | holds(low, "has", ("config",)), 8)):
        if not set(tokens) & set(ASKED[kind]):
            score = score - F.when(test, F.lit(loss)).otherwise(F.lit(0))
    return score


def entity_points(kind: str, path_strength: Column | None, label_strength: Column | None) -> Column:
    """Points of the best entity match of a candidate; the path's, where it has any, go before the label's."""
    out = F.when(F.lit(False), F.lit(0))
    for strength, (most, less) in zip((path_strength, label_strength), ENTITY_POINTS[kind]):
        if strength is not None and most:
            out = out.when(strength >= 3, F.lit(most)).when(strength == 2, F.lit(less))
    return out.otherwise(F.lit(0))
