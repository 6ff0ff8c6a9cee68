"""Vector, lexical and hybrid ranking with total orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, score_text
from ..plans.staging import scratch


def vector_top(vectors: DataFrame, query: list[float], k: int = 8, id_column: str = "vec_id") -> DataFrame:
    """The k rows of greatest cosine similarity to ``query``; null vectors are left out, ties go to the least id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where("embedding is not null").withColumn("similarity", F.round(cosine(F.col("embedding"), q), 6))
    return scored.orderBy(F.col("similarity").desc(), id_column).limit(k)


def vector_top_set(vectors: DataFrame, queries: DataFrame, k: int = 8, id_column: str = "vec_id", block: int = 1024, buffer: int = 32768) -> DataFrame:
    """(query_id, id, similarity, rank): for each of ``queries`` (query_id, query) its k rows of greatest cosine similarity; ties go to the least id.

    The queries are written in blocks of about half ``block`` to the shared folder.  One pass over the
    rows scores up to ``buffer`` of them at a time against block after block, which tasks read from
    there, and keeps each query's best k; these are merged per query, partly before they move.  A
    task holds a buffer and a block, whatever there is of either.  Nulls among ids and vectors are left out on
    both sides; vectors of length 0 have no similarity and come last.  All must have one dimension.
    """
    spark = vectors.sparkSession
    given = queries.where("query_id is not null and query is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
    parts = max(1, -(-given.count() // block) * 2)
    folder = scratch(spark, "queries")
    given.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).repartition(parts, "part").write.partitionBy("part").parquet(folder)
    rows = vectors.where(F.col(id_column).isNotNull() & F.col("embedding").isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))

    def unit(column: pa.Array) -> np.ndarray:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def block_of(part: int) -> tuple[np.ndarray, np.ndarray] | None:
        files, at = pafs.FileSystem.from_uri(f"{folder}/part={part}")
        if files.get_file_info(at).type == pafs.FileType.NotFound:
            return None
        found = pq.read_table(at, filesystem=files, columns=["query_id", "query"], partitioning=None).combine_chunks()
        return found["query_id"].to_numpy(), unit(found["query"].chunk(0))

    def best_of(ids: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = min(k, len(ids))
        for part in range(parts):
            asked = block_of(part)
            if asked is None:
                continue
            best = None
            for at in range(0, len(ids), 4096):
                sims = np.round(asked[1] @ v[at : at + 4096].T, 6)
                neg, own = np.where(np.isnan(sims), np.inf, -sims), np.broadcast_to(ids[at : at + 4096], sims.shape)
                if best is not None:
                    neg, own = np.concatenate([best[0], neg], axis=1), np.concatenate([best[1], own], axis=1)
                order = np.lexsort((own, neg), axis=1)[:, :k]
                best = np.take_along_axis(neg, order, 1), np.take_along_axis(own, order, 1)
            flat = best[0].ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked[0], n)), pa.array(best[1].ravel()), pa.array(-flat, mask=np.isinf(flat))], names=["query_id", "id", "similarity"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), unit(batch.column(1))))
            size += batch.num_rows
            if size >= buffer:
                yield from best_of(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
        if size:
            yield from best_of(*(np.concatenate(x) for x in zip(*held)))

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc_nulls_last(), "id"))
    return rows.mapInArrow(score, "query_id long, id long, similarity double").withColumn("rank", rank).where(F.col("rank") <= k)


def lexical_top(docs: DataFrame, terms: list[str], k: int = 8, id_column: str = "doc_id") -> DataFrame:
    """The k rows that hold most of the terms."""
    scored = docs.withColumn("hits", score_text(F.col("text"), terms)).where("hits > 0")
    return scored.orderBy(F.col("hits").desc(), id_column).limit(k)


def ranked(df: DataFrame, id_column: str, *order: Column) -> DataFrame:
    """(id, rank): 1-based, for frames a top-k has bounded."""
    return df.select(F.col(id_column).alias("id"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


def fuse(a: DataFrame, b: DataFrame, k: int = 60, top: int = 8) -> DataFrame:
    """Reciprocal rank fusion of two bounded rankings (id, rank)."""
    both = a.select("id", F.col("rank").alias("ra")).join(b.select("id", F.col("rank").alias("rb")), "id", "full_outer")
    part = lambda c: F.coalesce(1 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    return both.select("id", F.round(part("ra") + part("rb"), 8).alias("score")).orderBy(F.col("score").desc(), "id").limit(top)


def grep(docs: DataFrame, pattern: str, per_file: int = 2, top: int | None = 25, width: int = 220) -> DataFrame:
    """Matching lines without regard to case: doc_id, 1-based line and the cut text, at most ``per_file`` a file."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line_text")).where(F.col("line_text").rlike(f"(?i){pattern}"))
    first = lines.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))).where(F.col("rn") <= per_file)
    out = first.select("doc_id", (F.col("at") + 1).alias("line"), F.substring("line_text", 1, width).alias("line_text"))
    return out.orderBy("doc_id", "line").limit(top) if top else out


def spread_over(files: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """A round robin over groups: first files of all groups, then second ones, up to ``limit``."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return files.withColumn("turn", n).where(F.col("turn") <= limit).orderBy("turn", group, order).limit(limit)
