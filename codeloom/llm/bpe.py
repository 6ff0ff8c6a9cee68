"""Byte-level BPE encoding and decoding by DuckDB recursive queries in each task.

Each match of the pre-tokenizer's pattern is a word.  A task's new words become
rows (word, position, token); a recursive query joins neighbouring tokens to the
merge table and contracts every word's leftmost pair of least rank, all words at
once, until no word has a pair left.  Words repeat, so a worker keeps a bounded
cache of what it has encoded.  Decoding joins (document, position, token) rows to
the vocabulary and aggregates their bytes in order.

Words of over ``LONG`` bytes are first cut between bytes that lie side by side in no
token, where no merge can reach across.  Of a part that is still long, a step contracts every
occurrence of the pair of least rank that doesn't overlap one to its left: the result is the
same, as what a contraction makes has a higher rank in a vocabulary each of
whose tokens can be reached by merges.

A query takes about ``QUERY_BYTES`` bytes (one part at least) and contracts as often as
``STEP_ROWS`` rows over all its steps allow; parts that still have pairs start the next one,
so very long words cost time but little memory.  Null texts count as empty and have
no tokens; null and repeated doc_ids are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_schema, slices, strings, table, text_of
from .pieces import PieceCache

STEPS, QUERY_BYTES, STEP_ROWS, LONG = 48, 400_000, 20_000_000, 64

_PAIRS = """
  SELECT p.w, p.pos, p.tok, m.n, p.next_pos
  FROM (SELECT w, pos, tok, lead(tok) OVER o AS next_tok, lead(pos) OVER o AS next_pos FROM {rows} WINDOW o AS (PARTITION BY w ORDER BY pos)) p
  LEFT JOIN merges m ON m.l = p.tok AND m.r = p.next_tok"""
#: Rows of a step; key orders the pairs by rank and position and holds how far the pair's second token lies behind its first.
_RANKED = f"""
SELECT *, {{step}} AS step, min(key) OVER (PARTITION BY w) AS best FROM (
  SELECT w, pos, tok, n, (n::BIGINT << 42) | (pos::BIGINT << 10) | (next_pos - pos) AS key FROM ({_PAIRS}))
"""
_CONTRACTED = """(
  SELECT w, pos, CASE WHEN key = best THEN n ELSE tok END AS tok FROM s
  WHERE pos <> ((best >> 10) & 4294967295) + (best & 1023))"""
#: The same for all occurrences of the least pair; of a row of overlapping ones, every second.
_RANKED_LONG = f"""
SELECT w, pos, tok, n, chosen, coalesce(lag(chosen) OVER (PARTITION BY w ORDER BY pos), false) AS gone, {{step}} AS step, best FROM (
  SELECT *, n IS NOT NULL AND n = best AND (place - max(CASE WHEN n = best THEN 0 ELSE place END) OVER (PARTITION BY w ORDER BY pos)) % 2 = 1 AS chosen FROM (
    SELECT *, min(n) OVER (PARTITION BY w) AS best, row_number() OVER (PARTITION BY w ORDER BY pos) AS place FROM ({_PAIRS})))
"""
_CONTRACTED_LONG = "(SELECT w, pos, CASE WHEN chosen THEN n ELSE tok END AS tok FROM s WHERE best IS NOT NULL AND NOT gone)"


def _recursive(ranked: str, contracted: str) -> str:
    return f"""
WITH RECURSIVE s AS (
{ranked.format(step="0", rows="start_rows")}
UNION ALL
{ranked.format(step="(SELECT max(step) FROM s) + 1", rows=contracted)}  WHERE (SELECT max(step) FROM s) < $steps
)
SELECT w, pos, tok, best IS NULL AS done FROM s WHERE best IS NULL OR step = $steps ORDER BY w, pos
"""


ENCODE, ENCODE_LONG = _recursive(_RANKED, _CONTRACTED), _recursive(_RANKED_LONG, _CONTRACTED_LONG)
DECODE = "SELECT d, array_to_string(list(txt ORDER BY pos), '') AS txt FROM id_rows JOIN vocabulary USING (tok) GROUP BY d ORDER BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(l, r, n): tokens l and r side by side may become n."""
    rows = [(ranks[t[:i]], ranks[t[i:]], n) for t, n in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return pa.table({k: pa.array(v, pa.int32()) for k, v in zip("lrn", zip(*rows))} if rows else {k: pa.array([], pa.int32()) for k in "lrn"})


class DuckBPE:
    """Encodes and decodes with one vocabulary in one DuckDB connection of one thread."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.bytes_to_token = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        inside = [t for t in ranks if len(t) > 1]
        first, second = (np.frombuffer(b"".join(x), np.uint8) for x in ([t[:-1] for t in inside], [t[1:] for t in inside]))
        self.side_by_side = np.zeros((256, 256), bool)
        self.side_by_side[first, second] = True
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        merges = merge_table(ranks)
        vocabulary = pa.table({"tok": pa.array(ranks.values(), pa.int32()), "txt": [t.decode("latin-1") for t in ranks]})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.cache = PieceCache(self.encode_pieces, most=1_200_000)

    def run(self, name: str, rows: pa.Table, query: str, given: dict | None = None) -> dict[str, np.ndarray]:
        self.db.register(name, rows)
        try:
            return self.db.execute(query, given).fetchnumpy()
        finally:
            self.db.unregister(name)

    def contract(self, parts: list[bytes], query: str) -> list[bytes]:
        """Ids of each part as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(parts)
        begin = 0
        while begin < len(parts):
            end, size = begin, 0
            while end < len(parts) and (end == begin or size + len(parts[end]) <= QUERY_BYTES):
                size += len(parts[end])
                end += 1
            lengths = np.array([len(b) for b in parts[begin:end]])
            flat = np.frombuffer(b"".join(parts[begin:end]), np.uint8)
            w = np.repeat(np.arange(end - begin, dtype=np.int32), lengths)
            pos = (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            tok = self.bytes_to_token[flat]
            while len(w):
                steps = max(1, min(STEPS, STEP_ROWS // len(w)))
                got = self.run("start_rows", pa.table({"w": w, "pos": pos, "tok": tok}), query, {"steps": steps})
                done = got["done"]
                ids, owner = got["tok"][done].astype("<u4"), got["w"][done]
                data = ids.tobytes()
                cuts = np.flatnonzero(np.diff(owner, prepend=-1))
                for k, a, b in zip(owner[cuts].tolist(), (4 * cuts).tolist(), [*(4 * cuts[1:]).tolist(), len(data)]):
                    out[begin + k] = data[a:b]
                w, pos, tok = (got[k][~done] for k in ("w", "pos", "tok"))
            begin = end
        return out

    def cut(self, word: bytes) -> list[bytes]:
        """The parts of a word between which no token can lie."""
        flat = np.frombuffer(word, np.uint8)
        cuts = (np.flatnonzero(~self.side_by_side[flat[:-1], flat[1:]]) + 1).tolist()
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        if max(map(len, raw), default=0) <= LONG:
            return self.contract(raw, ENCODE)
        split = [self.cut(b) if len(b) > LONG else [b] for b in raw]
        distinct = list(dict.fromkeys(p for parts in split for p in parts))
        ids: dict[bytes, bytes] = {}
        for query, parts in ((ENCODE, [p for p in distinct if len(p) <= LONG]), (ENCODE_LONG, [p for p in distinct if len(p) > LONG])):
            ids.update(zip(parts, self.contract(parts, query)))
        return [b"".join([ids[p] for p in parts]) for parts in split]

    def encode_pieces(self, pieces: list[str], _: int) -> list[bytes]:
        """Ids of texts whose words are new or known; words with a space before them are also kept."""
        known, find = self.cache.known, self.pattern.findall
        split = [find(p) for p in pieces]
        new: dict[str, bytes] = {}
        for words in split:
            for w in words:
                if not (w[0] == " " and w[1:] in known):
                    new[w] = b""
        words = list(new)
        for w, ids in zip(words, self.encode_words(words)):
            new[w] = ids
        return [b"".join([new[w] if w in new else known[w[1:]] for w in words]) for words in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        d = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        out = [b""] * len(ids)
        if len(flat):
            got = self.run("id_rows", pa.table({"d": d, "pos": np.arange(len(flat), dtype=np.int32), "tok": flat}), DECODE)
            for k, txt in zip(got["d"].tolist(), got["txt"].tolist()):
                out[k] = txt.encode("latin-1")
        return out


_CODERS: dict[tuple[str, str], DuckBPE] = {}


def coder(path: str, pattern: str) -> DuckBPE:
    """This worker's coder of a vocabulary."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = DuckBPE(read_ranks(path), pattern)
    return _CODERS[path, pattern]


ENCODED = "doc_id long, ids binary"
DECODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, bytes binary"


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): each text's token ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, schema = coder(path, pattern), arrow_schema(ENCODED)
        for batch in slices(batches, rows=2048, size=6 << 20):
            ids = bpe.cache.documents(strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str, pattern: str, with_bytes: bool = True) -> DataFrame:
    """Counts, digests and the decoded bytes (null without ``with_bytes``) of every row of ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, schema = coder(path, pattern), arrow_schema(DECODED)
        for batch in slices(batches, size=2 << 20):
            ids = batch.column(1).to_pylist()
            texts = bpe.decode(ids)
            columns = [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x).hexdigest() for x in texts], texts if with_bytes else [None] * len(ids)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encode`` and ``decode`` in one pass, so that a task keeps one worker and one cache; without the bytes."""
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, schema = coder(path, pattern), arrow_schema(ddl)
        for batch in slices(batches, rows=2048, size=6 << 20):
            ids = bpe.cache.documents(strings(batch.column(1)))
            texts = [t for i in range(0, len(ids), 512) for t in bpe.decode(ids[i : i + 512])]
            columns = [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x).hexdigest() for x in texts]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(run, ddl)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of the bytes they decode to."""
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
