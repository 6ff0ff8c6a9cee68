"""Toxic passages by maximal-scoring segments of token log-odds.

Learning takes a bounded sample of labelled rows (``SAMPLE`` doc_ids, those of least
hash; all of them where there are fewer).  Tokens are words and, marked with ``*``,
the beginnings of words; a token counts once a document.  Copies aren't evidence of
their own: documents of one label whose least hash of five words in a row is the
same share the weight of one.  A token's score is the log-odds of its rate in toxic
against other documents under a Dirichlet prior drawn from both.  A beginning is a token
only if ``AGREE`` different words or more that begin so, each met in two documents at
least, lean the same way, three in four of all such words, and if no longer beginning has just
the same words: one vile word says nothing of the plain words that begin alike.  Only tokens carry
their score whose log-odds are strong and significant at a level that is divided by the
number of tokens tested; a word takes its own score, else that of its longest
beginning that has one, and any other word costs ``GAP``.  A linear scan finds all
maximal-scoring segments of a text.

Extreme-value parameters turn a segment's score into the expected number of chance
hits in a clean text of that length: the scale from the clean token rates, the
constant from segments of clean documents.  A logistic curve with weights that are
never negative maps the calibrated best segment, and what the other significant
ones add to it, to a probability.  Constant and curve are fitted on documents that took no part in the
counts behind the scores they get there (``FOLDS`` parts, copies in the same one).

A null or empty text has no tokens and gets the score of a text without hits.
Null doc_ids are scored and teach nothing; without labels of both kinds every score
is the share of toxic labels, or 0.  A doc_id with several labels is toxic if one of
them is; one with several rows teaches by its least text.  Repeated rows score
alike; ties of the sample's hash are broken by doc_id.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, released, slices, staged, strings, table, text_of

#: Bound of the model: labelled doc_ids it learns from.
SAMPLE = 20_000
GAP, LEAST_LOG_ODDS, LEVEL, PRIOR, FLAT, SIGNIFICANT, FOLDS = -0.25, 1.0, 0.05, 0.001, 0.5, 0.05, 4
#: Lengths of the beginnings that are tokens too, and in how many words, and in what share of all, a beginning must lean one way.
STEMS, AGREE, AGREED = (4, 5, 6, 7, 8), 4, 0.75
_WORD = re.compile(r"[^\W\d_]+")


def tokens_of(words: list[str]) -> set[str]:
    """Words and beginnings of words, the latter marked with ``*``."""
    distinct = set(words)
    return distinct | {w[:k] + "*" for w in distinct for k in STEMS if len(w) > k}


def sketch(words: list[str]) -> int:
    """The least hash of five words in a row, alike for most pairs of near copies."""
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))) >> 1


def segments(hits: list[tuple[int, float]], gap: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score) in linear time.

    ``hits`` are the positions and scores of the tokens that score other than ``gap``.
    Candidates are kept with the running total before and after them; a candidate is
    joined to the nearest earlier one that starts lower and ends lower.
    """
    out: list[tuple[int, int, float, float, int]] = []  # first, last, total before, total after, nearest candidate that starts lower
    total, at = 0.0, 0
    for position, score in hits:
        total += gap * (position - at)
        at = position + 1
        before, total = total, total + score
        if score <= 0:
            continue
        first = position
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= before:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                break
            first, _, before, _, up = out[j]
            del out[j:]
            j = up
        out.append((first, position, before, total, j))
    return [(a, b, after - before) for a, b, before, after, _ in out]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    constant: float = 1.0
    weights: list[float] = field(default_factory=lambda: [-20.0, 0.0, 0.0])
    known: dict[str, float | None] = field(default_factory=dict, repr=False)

    def score_of(self, word: str) -> float | None:
        """The word's own score, else that of its longest known beginning; None costs ``GAP``."""
        found = self.scores.get(word)
        for k in reversed(STEMS):
            if found is not None:
                break
            if len(word) > k:
                found = self.scores.get(word[:k] + "*")
        return found

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        words, known, hits = _WORD.findall(text.lower()), self.known, []
        for i, w in enumerate(words):
            if w in known:
                s = known[w]
            else:
                if len(known) > 500_000:
                    known.clear()
                s = known[w] = self.score_of(w)
            if s is not None:
                hits.append((i, s))
        return len(words), segments(hits, GAP) if hits else []

    def expected(self, score: float, n: int) -> float:
        """Number of segments with this score that a clean text of n tokens has by chance."""
        return self.constant * max(1, n) * math.exp(-min(700.0, self.rate * score))

    def features(self, n: int, scores: list[float]) -> list[float]:
        """1, the best segment's calibrated score, and the total of the other significant ones."""
        level = math.log(self.constant * max(1, n))
        best, *rest = sorted([*(self.rate * s - level for s in scores), -10.0], reverse=True)
        return [1.0, best / 10, math.log1p(sum(x for x in rest if x > -math.log(SIGNIFICANT)))]

    def probability(self, n: int, scores: list[float]) -> float:
        z = sum(a * b for a, b in zip(self.weights, self.features(n, scores)))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def solve_rate(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum(p * exp(rate * s)) = 1; 1 where there is none."""
    if not len(s) or s.max() <= 0 or (p * s).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    value = lambda r: float((p * np.exp(np.minimum(700, r * s))).sum()) - 1
    while value(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton's method with a small ridge and steps that are halved until the loss falls; the first column is the constant, other weights that would be negative are 0."""
    use = list(range(x.shape[1]))
    while True:
        own, w = x[:, use], np.zeros(len(use))

        def loss(v: np.ndarray) -> float:
            z = own @ v  # noqa: B023
            return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * v @ v)

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            h = (own * (p * (1 - p))[:, None]).T @ own + ridge * np.eye(len(w))
            step, size, now = np.linalg.solve(h, own.T @ (y - p) - ridge * w), 1.0, loss(w)
            while size > 1e-6 and loss(w + size * step) > now:
                size /= 2
            w = w + size * step
            if np.abs(size * step).max() < 1e-9:
                break
        worst = min(range(1, len(use)), key=lambda k: w[k], default=0)
        if not worst or w[worst] >= 0:
            out = np.zeros(x.shape[1])
            out[use] = w
            return out
        del use[worst]


def scores_of(counts: np.ndarray, clean_and_toxic: np.ndarray, least_z: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of tokens (0 where weak or by chance) and their rates in clean documents.

    ``counts`` has a row (clean, toxic weight) for each token, ``clean_and_toxic`` holds
    the sums over all tokens.  Significance is the signed root of the likelihood ratio.
    """
    clean, toxic = counts.T
    no, yes = clean_and_toxic
    both = clean + toxic
    prior = PRIOR * both + FLAT
    a, b, whole = toxic + prior, clean + prior, PRIOR * (yes + no) + FLAT
    odds = np.log(a / (yes + whole - a)) - np.log(b / (no + whole - b))
    share = yes / (yes + no)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(toxic > 0, toxic * np.log(toxic / (both * share)), 0) + np.where(clean > 0, clean * np.log(clean / (both * (1 - share))), 0)
    z = np.sqrt(2 * np.maximum(0, ratio))
    return np.where((z >= least_z) & (np.abs(odds) >= LEAST_LOG_ODDS), odds, 0), b / (no + whole)


def agreeing(words: DataFrame) -> DataFrame:
    """The beginnings (token, marked) that are tokens: several words (token, lean 0 or 1) lean one way, and not those of a longer one alone."""
    cut = F.filter(F.array(*[F.when(F.length("token") > k, F.substring("token", 1, k)) for k in STEMS]), lambda x: x.isNotNull())
    begun = words.select(F.explode(cut).alias("start"), "lean").groupBy("start").agg(F.count("*").alias("words"), F.greatest(F.sum("lean"), F.count("*") - F.sum("lean")).alias("agree"))
    longer = begun.where(F.length("start") > STEMS[0]).select(F.expr("substring(start, 1, length(start) - 1)").alias("start"), "words")
    told = begun.where((F.col("agree") >= AGREE) & (F.col("agree") >= AGREED * F.col("words"))).join(longer, ["start", "words"], "left_anti")
    return told.select(F.concat("start", F.lit("*")).alias("token"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic 0 or 1).

    What comes to the driver: the tokens that any fold's counts make significant, and a
    short row for each document of the sample, ``sample`` at most.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "chosen")
    joined = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")  # ``sample`` rows of two numbers
    own = staged(joined.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([sketch(_WORD.findall(t.lower())) for t in strings(batch.column(2))], pa.int64())], names=["doc_id", "toxic", "text", "sketch"])

    rows = staged(own.mapInArrow(sketched, "doc_id long, toxic int, text string, sketch long"), "sketched")
    alike = rows.groupBy("toxic", "sketch").agg((1 / F.count("*")).alias("weight"))  # no more than ``sample`` rows
    weighed = staged(rows.join(F.broadcast(alike), ["toxic", "sketch"]).withColumn("fold", F.pmod(F.xxhash64("sketch"), F.lit(FOLDS)).cast("int")), "weighed")
    share, kinds = weighed.agg(F.coalesce(F.avg("toxic"), F.lit(0.0)), F.countDistinct("toxic")).first()
    if kinds < 2:
        return Model(weights=[math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1 << 20):
            found = [tokens_of(_WORD.findall(t.lower())) for t in strings(batch.column(3))]
            sizes = [len(x) for x in found]
            columns = [batch.column(k).to_numpy(zero_copy_only=False).repeat(sizes) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2]), pa.array([w for x in found for w in x], pa.string())], names=["toxic", "fold", "weight", "token"])

    met = weighed.select("toxic", "fold", "weight", "text").mapInArrow(tokens, "toxic int, fold int, weight double, token string")
    each = [F.sum(F.when((F.col("fold") == k) & (F.col("toxic") == y), F.col("weight")).otherwise(0.0)).alias(f"c{k}_{y}") for k in range(FOLDS) for y in (0, 1)]
    every = counted = staged(met.groupBy("token").agg(*each), "counts")
    names = counted.columns[1:]
    of = lambda y: sum((F.col(f"c{k}_{y}") for k in range(FOLDS)), F.lit(0.0))
    no, yes = weighed.agg(F.sum(F.when(F.col("toxic") == 0, F.col("weight"))), F.sum(F.when(F.col("toxic") == 1, F.col("weight")))).first()
    whole = counted.where(~F.endswith("token", F.lit("*")))
    starts = agreeing(whole.where(of(0) + of(1) >= 2).select("token", (of(1) / yes > of(0) / no).cast("int").alias("lean")))
    counted = staged(whole.unionByName(counted.join(starts, "token", "left_semi")), "tokens")
    tested, *sums = counted.agg(F.count("*"), *[F.sum(c) for c in names]).first()
    least_z = NormalDist().inv_cdf(1 - LEVEL / max(1, tested) / 2)
    sums = np.array(sums).reshape(FOLDS, 2)
    without = [sums.sum(0) - sums[k] for k in range(FOLDS)] + [sums.sum(0)]  # counts less each fold, and all

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 1 + 2 * FOLDS)], 1).reshape(-1, FOLDS, 2)
            found = [scores_of(counts.sum(1) - (counts[:, k] if k < FOLDS else 0), total, least_z) for k, total in enumerate(without) if total.min() > 0]
            yield batch.filter(pa.array(np.any([s != 0 for s, _ in found], axis=0) if found else np.zeros(batch.num_rows, bool)))

    strong = counted.mapInArrow(telling, counted.schema).orderBy("token").collect()
    counts = np.array([[r[c] for c in names] for r in strong], float).reshape(-1, FOLDS, 2)
    models = []
    for k, total in enumerate(without):
        model = Model()
        if len(strong) and total.min() > 0:
            s, p = scores_of(counts.sum(1) - (counts[:, k] if k < FOLDS else 0), total, least_z)
            model.scores = {r["token"]: float(x) for r, x in zip(strong, s) if x}
            p = p[s != 0]
            model.rate = solve_rate(np.append(p, max(0.0, 1 - p.sum())), np.append(s[s != 0], GAP))
        models.append(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [models[k].scan(t) for k, t in zip(batch.column(1).to_pylist(), strings(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([[s for *_, s in x] for _, x in found], pa.list_(pa.float64()))], names=["toxic", "fold", "n", "scores"])

    own_rows = weighed.select("toxic", "fold", "text").mapInArrow(scan, "toxic int, fold int, n long, scores array<double>").collect()  # at most ``sample`` short rows
    model = models[-1]
    clean = [r for r in own_rows if not r["toxic"]]
    least = min((models[r["fold"]].rate * s for r in own_rows for s in r["scores"]), default=1.0)
    constant = (sum(len(r["scores"]) for r in clean) + 0.5) / (max(1, sum(r["n"] for r in clean)) * math.exp(-min(700.0, least)))
    for m in models:
        m.constant = constant
    x = np.array([models[r["fold"]].features(r["n"], r["scores"]) for r in own_rows])
    model.weights = logistic(x, np.array([float(r["toxic"]) for r in own_rows])).tolist()
    model.known.clear()
    released(docs.sparkSession, chosen, own, rows, weighed, every, counted)
    return model


SCORED = "doc_id long, score double, predicted int, n_tokens long, passages string"


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Score of every document and its significant passages, JSON [[first character, end, score, expected], ...]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(SCORED)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                n, found = model.scan(text)
                score = model.probability(n, [s for *_, s in found])
                passages = []
                if found:
                    spans = [m.span() for m in _WORD.finditer(text.lower())]
                    passages = [[spans[a][0], spans[b][1], round(s, 4), e] for a, b, s in found if (e := model.expected(s, n)) <= SIGNIFICANT]
                rows.append((doc_id, score, int(score >= 0.5), n, json.dumps(passages)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(run, SCORED)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for text in strings(batch.column(at)):
                n, found = model.scan(text)
                keep.append(model.probability(n, [s for *_, s in found]) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learned from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    found = score_documents(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
