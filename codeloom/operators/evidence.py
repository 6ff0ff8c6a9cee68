"""Evidence of questions: scored retrieval, the choice of the best, what earlier turns and facts add, and how good it is."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boosts
from ..functions.rules import entity_points
from ..functions.text import score_groups
from .retrieval import entity_strength


def _first(rows: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rn") -> DataFrame:
    """The first n rows of each key; the limit is applied in every task before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def retrieve(files: DataFrame, symbols: DataFrame, routes: DataFrame, modules: DataFrame, groups: list[list[str]], hints: list[tuple[str, list[str]]], functional: bool = False, tokens: list[str] | None = None, intents: list[tuple[str, list[str]]] | None = None, limit: int | None = None) -> DataFrame:
    """(kind, id, label, path, score) of everything that scores above 0 for a question's token groups and entity hints.

    files (id, path, content), symbols and routes (id, label, path; symbols may have a
    kind), modules (id, label).  With ``tokens`` the subjects that they show boost, and
    ``functional`` follows from them; ``intents`` are the modules that the question means,
    as :func:`codeloom.operators.intents.module_intents` finds them.  Whole contents are
    searched unless ``limit`` says how many characters; the surveyed rule takes 4,000.
    Nulls count as empty.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    hit, strength = (lambda c, n: score_groups(text(c), groups) * n), (lambda c: entity_strength(text(c), hints))
    if limit is not None:
        files = files.withColumn("content", F.substring("content", 1, limit))
    asked = F.lit(tokens or []).cast("array<string>")
    about = boosts.foci(asked)

    def marked(df: DataFrame, kind: str, *fields: str) -> DataFrame:
        return df if tokens is None else df.withColumn("_marks", boosts.marks(boosts.BOOSTS[kind], **{f: F.col(f) for f in fields}))

    def subject(kind: str, *fields: str) -> Column:
        if tokens is None:
            return F.lit(0)
        return boosts.boost(boosts.BOOSTS[kind], F.col("_marks"), asked, about, first=kind == "route", **{f: F.col(f) for f in fields})

    def scored(df: DataFrame, kind: str, label: str, path: str | None, score: Column) -> DataFrame:
        if path and intents:
            score = score + boosts.module_points(F.col(path), intents)
        return df.select(F.lit(kind).alias("kind"), "id", F.col(label).alias("label"), (F.col(path) if path else F.lit(None).cast("string")).alias("path"), score.cast("long").alias("score"))

    kinds = boosts.kind_points(F.col("kind"), about) if tokens is not None and "kind" in symbols.columns else F.lit(0)
    how = F.when(F.array_contains(about, "functional"), F.lit(36)).otherwise(F.lit(12)) if tokens is not None else F.lit(36 if functional else 12)
    out = scored(marked(files, "file", "path", "content"), "file", "path", "path", hit("path", 6) + hit("content", 1) + entity_points("file", strength("path"), None) + subject("file", "path", "content"))
    if "kind" not in symbols.columns:
        symbols = symbols.withColumn("kind", F.lit(None).cast("string"))
    out = out.unionByName(scored(marked(symbols, "symbol", "path", "label", "kind"), "symbol", "label", "path", hit("label", 8) + hit("path", 3) + entity_points("symbol", strength("path"), strength("label")) + kinds + subject("symbol", "path", "label", "kind")))
    out = out.unionByName(scored(marked(routes, "route", "path"), "route", "label", "path", hit("label", 10) + hit("path", 4) + entity_points("route", strength("path"), strength("label")) + how + subject("route", "path")))
    out = out.unionByName(scored(modules, "module", "label", None, hit("label", 14) + entity_points("module", None, strength("label"))))
    return out.where("score > 0")


def is_noise(path: Column, label: Column, infrastructure: bool = False, locale: bool = False) -> Column:
    """Editor settings; observers where a question is on infrastructure; settings.json where it is on locales."""
    p, name = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(label, F.lit("")))
    out = F.contains(p, F.lit("/.vscode/")) | p.startswith(".vscode/")
    if infrastructure:
        out = out | F.contains(p, F.lit("/observers/")) | F.contains(name, F.lit("observer"))
    return out | F.contains(name, F.lit("settings.json")) if locale else out


def select_top(candidates: DataFrame, limit: int = 12, near: int = 6, anchors: int = 4, strong: int = 40) -> DataFrame:
    """The best ``limit`` candidates of each question, spread over files: all columns and ``place`` from 1.

    Candidates have question, path (or null), score and ord; ord is unique within a
    question.  They are taken by falling score, then ord.  Until ``near`` are taken or
    ``anchors`` files are reached, a further candidate of a file taken before waits if
    it scores below ``strong``; those that wait fill the places left in the end.

    No question is gathered whole: a file's first candidate comes from an aggregation,
    and of those that never wait, of those that wait and of the rest only the first
    ``limit`` can be chosen, so each is cut to that in every task before the shuffle.
    """
    rows = candidates.withColumn("_key", F.struct((-F.col("score")).alias("s"), F.col("ord").alias("o")))
    first = rows.where("path is not null").groupBy("question", "path").agg(F.min("_key").alias("_key")).withColumn("_anchor", F.lit(1))
    rows = rows.join(first, ["question", "path", "_key"], "left")
    taken = F.col("_anchor").isNotNull() | F.col("path").isNull() | (F.col("score") >= strong)
    order = [F.col("_key")]
    head = _first(rows.where(taken), ["question"], order, limit, "_n")
    counted = head.withColumn("_a", F.count("_anchor").over(Window.partitionBy("question").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)))
    gate = counted.where((F.col("_n") >= min(near, limit)) | (F.col("_a") >= anchors)).groupBy("question").agg(F.min("_key").alias("_gate"))
    rest = rows.where(~taken).join(gate, "question", "left").withColumn("_late", F.col("_gate").isNull() | (F.col("_key") < F.col("_gate")))
    rest = _first(rest, ["question", "_late"], order, limit, "_n").drop("_gate")
    both = head.withColumn("_late", F.lit(False)).unionByName(rest)
    return _first(both, ["question"], [F.col("_late"), F.col("_key")], limit, "place").select(*candidates.columns, "place")


def with_origin(evidence: DataFrame, changed: DataFrame) -> DataFrame:
    """``origin``: overlay where a change (path, previous_path) names the evidence's path, structural where it has none, else baseline."""
    named = changed.select(F.explode(F.array("path", "previous_path")).alias("path")).where("path is not null").distinct().withColumn("_changed", F.lit(1))
    origin = F.when(F.col("path").isNull(), "structural").when(F.col("_changed").isNotNull(), "overlay").otherwise("baseline")
    return evidence.join(named, "path", "left").withColumn("origin", origin).drop("_changed").select(*evidence.columns, "origin")


def origin_summary(evidence: DataFrame) -> DataFrame:
    """How many of each question's evidence come from where, and whether local changes had a part."""
    n = lambda x: F.count_if(F.col("origin") == x)
    names = ("baseline", "overlay", "structural", "recalled", "conversation")
    return evidence.groupBy("question").agg(*[n(x).alias(x) for x in names], (n("overlay") > 0).alias("overlay_influenced"))


def with_prior_turn(evidence: DataFrame, prior: DataFrame, topics: DataFrame, most: int = 3) -> DataFrame:
    """Evidence (question, id, path, score) raised where the prior turn's has its path, and up to ``most`` of the prior turn's other paths.

    ``prior`` has question, id, path, score and related, whether it shares words with
    the question; ``topics`` question and same_topic.  On the same topic a raise is 30,
    else 5.  Without it only related rows are carried over, and none where four or
    more were raised.  A path is carried over once, its best first, at 18 to 55 points.
    """
    paths = prior.where("path is not null").select("question", "path").distinct().withColumn("_known", F.lit(1))
    same = topics.select("question", "same_topic")
    own = evidence.join(paths, ["question", "path"], "left").join(same, "question", "left").withColumn("same_topic", F.coalesce("same_topic", F.lit(False)))
    raised = own.withColumn("score", F.col("score") + F.when(F.col("_known").isNull(), 0).when(F.col("same_topic"), 30).otherwise(5))
    counts = own.groupBy("question").agg(F.count("_known").alias("_raised"))
    best = prior.where("path is not null").join(evidence.where("path is not null").select("question", "path").distinct(), ["question", "path"], "left_anti")
    best = best.join(same, "question", "left").withColumn("same_topic", F.coalesce("same_topic", F.lit(False))).join(counts, "question", "left")
    best = best.where(F.col("same_topic") | (F.col("related") & (F.coalesce("_raised", F.lit(0)) < 4)))
    best = best.groupBy("question", "path").agg(F.max_by(F.struct("id", "score"), F.struct("score", (-F.col("id")).alias("i"))).alias("b")).select("question", "path", "b.id", "b.score")
    carried = _first(best, ["question"], [F.col("score").desc(), F.col("id")], most).withColumn("score", F.greatest(F.lit(18), F.least(F.col("score"), F.lit(55))))
    columns = ["question", "id", "path", "score"]
    return raised.select(*columns, F.lit("own").alias("origin")).unionByName(carried.select(*columns, F.lit("conversation").alias("origin")))


def ambiguity(modules: DataFrame, least: int = 500, share: float = 0.65, most: int = 4) -> DataFrame:
    """(question, ambiguous, competing) from (question, module, score): modules of ``share`` of the best score, which must reach ``least``; two to ``most`` compete."""
    top = modules.groupBy("question").agg(F.max("score").alias("top"))
    near = modules.join(top, "question").where((F.col("top") >= least) & (F.col("score") >= share * F.col("top")))
    few = _first(near, ["question"], [F.col("score").desc(), F.col("module")], most + 1)
    found = few.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("rn", "module"))).alias("m"))
    names = F.coalesce(F.transform("m", lambda x: x["module"]), F.array().cast("array<string>"))
    return top.select("question").join(found, "question", "left").select("question", F.size(names).between(2, most).alias("ambiguous"), F.slice(names, 1, most).alias("competing"))


def quality(evidence: DataFrame, anchors: DataFrame) -> DataFrame:
    """(question, quality) of evidence (question, score, path, origin): 8 a strong one, 3 a file, 4 an origin, and 4 each for up to six structural anchors (question, n)."""
    strong, filed = F.count_if(F.col("score") >= 14), F.count_if(F.col("path").isNotNull())
    own = evidence.groupBy("question").agg((8 * strong + 3 * filed + 4 * F.count_distinct("origin")).alias("q"))
    return own.join(anchors, "question", "left").select("question", (F.col("q") + 4 * F.least(F.coalesce("n", F.lit(0)), F.lit(6))).cast("long").alias("quality"))


CHUNK = "question long, id long, place int"


def pack_context(candidates: DataFrame, zones: list[str], budget: int = 6000, most: int = 12, per_zone: int = 4, outside: int = 2) -> DataFrame:
    """(question, id, place): the candidates that fill each question's context of ``most`` chunks and ``budget`` tokens.

    Candidates (question, id, type, label, path, tokens, rank, anchor): rank is their
    order, anchor whether research confirmed them.  First up to three functional ones,
    then one for each focus zone, then the rest by rank: up to six functional ones
    while four places stay for others, one chunk a file, ``per_zone`` in a zone and
    ``outside`` beyond all zones, where only anchors go; zones don't bound anchors.
    The candidates of a question must be few, as :func:`select_top` leaves them: they are
    one group.
    """

    def zone_of(label: str | None, path: str | None) -> str | None:
        a, b = (label or "").lower(), (path or "").lower()
        return next((z for z in zones if z.lower() in a or z.lower().replace(":", "/") in b), None)

    def choose(question: pd.DataFrame) -> pd.DataFrame:
        rows = list(question.sort_values(["rank", "id"]).itertuples(index=False))
        zone = {r.id: zone_of(r.label, r.path) for r in rows}
        chosen: list = []

        def take(r) -> bool:
            if len(chosen) < most and sum(c.tokens for c in chosen) + r.tokens <= budget:
                chosen.append(r)
                return True
            return False

        plain = lambda: [c for c in chosen if c.type != "functional"]
        for r in rows:
            if len(chosen) >= 3:
                break
            if r.type == "functional":
                take(r)
        for z in zones:
            for r in rows:
                if r.type != "functional" and r not in chosen and (z.lower() in (r.label or "").lower() or z.lower().replace(":", "/") in (r.path or "").lower()):
                    take(r)
                    break
        for r in rows:
            if r in chosen:
                continue
            if r.type == "functional":
                missing = max(4 - len(plain()), 0)
                if len(chosen) - len(plain()) >= 6 or (missing and most - len(chosen) <= missing):
                    continue
            elif r.path and any(c.path == r.path for c in plain()):
                continue
            elif zone[r.id]:
                if not r.anchor and sum(zone[c.id] == zone[r.id] for c in plain()) >= per_zone:
                    continue
            elif not r.anchor or sum(zone[c.id] is None for c in plain()) >= outside:
                continue
            take(r)
        return pd.DataFrame({"question": [c.question for c in chosen], "id": [c.id for c in chosen], "place": range(1, len(chosen) + 1)})

    return candidates.select("question", "id", "type", "label", "path", "tokens", "rank", "anchor").groupBy("question").applyInPandas(choose, CHUNK)
