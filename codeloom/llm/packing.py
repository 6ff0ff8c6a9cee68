"""Sequence packing by non-negative least squares.

Documents are encoded once into record files.  A document fills whole windows
and leaves a tail; only tails need packing.  Their histogram over lengths, at
most ``window`` bins however large the corpus, decides the plan:

1. every combination of up to three length classes that fills a window is
   enumerated, and repeat counts that reproduce the histogram are solved for by
   non-negative least squares and rounded down;
2. tails that the rounded counts leave over are combined greedily, longest
   first, each with the longest that still fit;
3. windows that would stay more than ``slack`` short are laid end to end and cut
   at window borders.

A tail's place follows from its rank among tails of its length, which is a
running count within its task plus the counts of the tasks before it; no
document moves to be ranked, and a frequent length is only a larger number.

Null texts count as empty (one end id); repeated and null doc_ids are documents
of their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import OnceFile, arrow_schema, open_input, scratch, slices, staged, strings, table, text_of
from .pieces import hf_cache

WINDOW, STEP, SLACK = 2048, 16, 32
CUT = -1

ROWS = "task int, at long, doc_id long, doc_tokens long, tail int, rank_in_task long, full_before long, path string, byte_at long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


# ---- the plan: arithmetic over the histogram of tail lengths ----


def combinations(classes: int) -> np.ndarray:
    """All (a, b, c) with a >= b >= c >= 0 and a + b + c = classes; a class of 0 is no piece."""
    a, b = np.meshgrid(np.arange(1, classes + 1), np.arange(0, classes + 1), indexing="ij")
    c = classes - a - b
    ok = (c >= 0) & (a >= b) & (b >= c)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def nnls(a: np.ndarray, y: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 with a small ``|a x - y|``: the active-set method, at most ``rounds`` columns entering (what they leave unsolved is for the greedy step)."""
    x, passive, tol = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool), 1e-9 * max(1.0, float(np.abs(y).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (y - a @ x)
        gain[passive] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tol:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, at], y, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[at] = z
                break
            down = z <= 0
            old = x[at]
            step = min(1.0, float((old[down] / np.maximum(old[down] - z[down], 1e-300)).min()))
            x[at] = old + step * (z - old)
            gone = at[down & (x[at] <= 1e-12 * max(1.0, float(x.max())))]
            if not len(gone):
                gone = at[down]
            x[gone] = 0
            passive[gone] = False
            if not passive.any():
                break
    return x


def solve_counts(histogram: np.ndarray, step: int = STEP) -> list[tuple[tuple[int, ...], int]]:
    """(length classes of a window, repeats) with no class used more often than there are tails of it."""
    classes = (len(histogram) - 1) // step
    have = np.zeros(classes + 1)
    for length, n in enumerate(histogram):
        have[-(-length // step)] += n
    combos = combinations(classes)
    a = np.zeros((classes, len(combos)))
    for k in range(3):
        used = combos[:, k] > 0
        np.add.at(a, (combos[used, k] - 1, np.flatnonzero(used)), 1)
    x = np.floor(nnls(a, have[1:]) + 1e-6).astype(np.int64)
    left, out = have[1:].astype(np.int64), []
    for j in np.flatnonzero(x):
        need = a[:, j].astype(np.int64)
        most = int(min(x[j], (left[need > 0] // need[need > 0]).min()))
        if most > 0:
            left -= most * need
            out.append((tuple(int(c) for c in combos[j] if c), most))
    return out


def make_plan(histogram: np.ndarray, window: int = WINDOW, step: int = STEP, slack: int = SLACK) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs of places for the tails of each length, and the number of windows.

    A run (length, first rank, ranks, first window, offset) puts rank r of that
    length at the offset in window first window + r - first rank.  With an offset of
    ``CUT``, the tails lie end to end: first window is then the position in tokens.
    """
    left, used = histogram.astype(np.int64).copy(), np.zeros(len(histogram), np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    windows = 0

    def place(lengths: list[int], repeats: int) -> None:
        nonlocal windows
        offset = 0
        seen: dict[int, int] = {}
        for length in lengths:
            first = int(used[length]) + seen.get(length, 0) * repeats
            seen[length] = seen.get(length, 0) + 1
            runs.append((length, first, repeats, windows, offset))
            offset += length
        for length, k in seen.items():
            used[length] += k * repeats
            left[length] -= k * repeats
        windows += repeats

    def longest(top: int, bottom: int) -> int:
        found = np.flatnonzero(left[bottom : top + 1])
        return bottom + int(found[-1]) if len(found) else 0

    for classes, repeats in solve_counts(histogram, step):
        while repeats:
            lengths: list[int] = []
            for c in classes:  # the longest tails of a class first
                left_now = {x: int(left[x]) - lengths.count(x) for x in range(c * step, (c - 1) * step, -1)}
                lengths.append(next(x for x, n in left_now.items() if n > 0))
            most = min([repeats, *(int(left[x]) // lengths.count(x) for x in set(lengths))])
            place(lengths, most)
            repeats -= most
    short: list[tuple[int, int]] = []
    while top := longest(len(histogram) - 1, 1):
        lengths, room = [top], window - top
        left[top] -= 1
        for x in np.flatnonzero(left[1 : room + 1])[::-1] + 1:  # as many of the longest that fit as there are, then of the next
            n = min(room // int(x), int(left[x]))
            lengths += [int(x)] * n
            room -= n * int(x)
            if not room:
                break
        left[top] += 1
        if room <= slack:
            place(lengths, min(int(left[x]) // lengths.count(x) for x in set(lengths)))
        else:
            short.append((top, int(left[top])))
            left[top] = 0
    line = windows * window
    for length, n in short:
        runs.append((length, int(used[length]), n, line, CUT))
        line += length * n
    return runs, -(-line // window)


class Plan:
    """Looks up places; its size is bounded by the window, not by the corpus."""

    def __init__(self, runs: list[tuple[int, int, int, int, int]]):
        self.by_length: dict[int, tuple[np.ndarray, list]] = {}
        grouped: dict[int, list] = {}
        for run in runs:
            grouped.setdefault(run[0], []).append(run)
        for length, own in grouped.items():
            own.sort(key=lambda r: r[1])
            self.by_length[length] = np.array([r[1] for r in own]), own

    def pieces(self, length: int, rank: int, window: int) -> list[tuple[int, int, int, int]]:
        """(start in the tail, length, window number, offset) of each piece of a tail."""
        firsts, own = self.by_length[length]
        _, first, _, at, offset = own[int(np.searchsorted(firsts, rank, "right")) - 1]
        if offset != CUT:
            return [(0, length, at + rank - first, offset)]
        at += (rank - first) * length
        out, done = [], 0
        while done < length:
            n = min(length - done, window - at % window)
            out.append((done, n, at // window, at % window))
            done, at = done + n, at + n
        return out


# ---- the jobs ----


def id_width(vocabulary: str, end_id: int) -> str:
    """The kind of integer that the stored ids need."""
    from tokenizers import Tokenizer

    return "<u2" if max(end_id, Tokenizer.from_file(vocabulary).get_vocab_size() - 1) <= 0xFFFF else "<u4"


def encode(docs: DataFrame, vocabulary: str, end_id: int, folder: str, window: int, kind: str) -> DataFrame:
    """Write the ids of every document to a file per task; returns a written row per document with its counts so far."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, cache, task = arrow_schema(ROWS), hf_cache(vocabulary), TaskContext.get().partitionId()
        path, out, at, full = f"{folder}/{task:06d}-{TaskContext.get().taskAttemptId()}.ids", None, 0, 0  # rows name the file of their own attempt
        ranks = np.zeros(window, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            out, rows = out or OnceFile(path), []
            for doc_id, ids in zip(batch.column(0).to_pylist(), cache.documents(strings(batch.column(1)))):
                ids += end
                n = len(ids) // 4
                rows.append((task, at, doc_id, n, n % window, int(ranks[n % window]), full, path, out.size))
                ranks[n % window] += 1
                full += n // window
                at += 1
                out.write(ids if kind == "<u4" else np.frombuffer(ids, "<u4").astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if out is not None:
            out.commit()

    return staged(docs.select("doc_id", text_of("text").alias("text")).mapInArrow(write, ROWS), "encoded")


def pack(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Every piece of every packed document with its sequence, its offset there and its ids."""
    spark = docs.sparkSession
    kind = id_width(vocabulary, end_id)
    width = int(kind[-1])
    rows = encode(docs, vocabulary, end_id, scratch(spark, "ids"), window, kind)
    tails = rows.where("tail > 0").groupBy("task", "tail").agg(F.count("*").alias("n"))
    per_task = staged(tails, "tails")
    histogram = np.zeros(window + 1, np.int64)
    for tail, n in per_task.groupBy("tail").agg(F.sum("n")).collect():  # a row per length: at most window - 1
        histogram[tail] = n
    runs, packed = make_plan(histogram, window)
    plan = Plan(runs)

    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_task.select("task", "tail", F.coalesce(F.sum("n").over(before.partitionBy("tail").orderBy("task")), F.lit(0)).alias("rank_before"))
    fulls = rows.groupBy("task").agg(F.sum(F.floor(F.col("doc_tokens") / window)).alias("n"))
    full = fulls.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("task_full"))
    placed = rows.join(ranks.hint("shuffle_merge"), ["task", "tail"], "left").join(full, "task")  # a row for each length of each task: it grows with the tasks
    ordered = placed.select("path", "byte_at", "doc_id", "doc_tokens", "tail", (F.col("rank_in_task") + F.coalesce("rank_before", F.lit(0))).alias("rank"), (F.col("full_before") + F.col("task_full") + packed).alias("first_full")).repartition(max(1, fulls.count()), "path").sortWithinPartitions("path", "byte_at")  # a file per task: rows are short, their ids aren't

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, source, out, size = arrow_schema(PIECES), None, None, [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            for path, byte_at, doc_id, n, tail, rank, first in zip(*(c.to_pylist() for c in batch.columns)):
                if path != now:
                    if source is not None:
                        source.close()
                    now, source, at = path, open_input(path), 0
                if at != byte_at:
                    source.seek(byte_at)
                ids = source.read(width * n)
                at = byte_at + width * n
                if width == 2:
                    ids = np.frombuffer(ids, kind).astype("<u4").tobytes()
                places = [(k * window, window, first + k, 0) for k in range(n // window)]
                if tail:
                    places += [(n - tail + a, m, w, o) for a, m, w, o in plan.pieces(tail, rank, window)]
                for start, m, w, offset in places:
                    own = ids[4 * start : 4 * (start + m)]
                    out.append((doc_id, start, m, zlib.crc32(own), n, w, offset, own if with_ids else None))
                    size += 4 * m if with_ids else 64
                if size > 8 << 20:
                    yield made()
                    out, size = [], 0
        if out:
            yield made()
        if source is not None:
            source.close()

    return ordered.mapInArrow(cut, PIECES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, with_ids=False)
    return pieces.drop("ids")
