"""Token ids in length-delimited binary record files with an offset index.

A record file is a run of frames, each

    length of the payload          unsigned 64 bit
    masked checksum of the length  unsigned 32 bit
    payload
    masked checksum of the payload unsigned 32 bit

all little-endian.  A checksum is CRC-32, masked (rotated right by 15 bits plus
a constant) so that checksums of data that hold checksums stay sound.  A payload
is one serialized sequence: flags, the document's id and its token ids, two
bytes each where the file's largest id allows, else four.  Beside each record file stands
``.idx`` with a fixed-width entry per record (offset, frame length), so a
reader can fetch records in any order, as a shuffling data loader does.
"""

from __future__ import annotations

import random
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import OnceFile, arrow_schema, open_input, scratch, slices, staged, strings, table, text_of, write_once
from .pieces import hf_cache

MASK_DELTA = 0xA282EAD8
HEAD, INDEX = "<QI", "<QQ"
NULL_ID, WIDE = 1, 2

MANIFEST = "task int, part int, path string, records long, ids long"
READ = "doc_id long, in_file long, n_tokens long, ids binary"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one whole frame; ValueError where a length or a checksum is wrong."""
    length, crc = struct.unpack_from(HEAD, data)
    if masked_crc(data[:8]) != crc or len(data) != 12 + length + 4:
        raise ValueError("damaged frame header")
    payload = data[12 : 12 + length]
    if masked_crc(payload) != struct.unpack_from("<I", data, 12 + length)[0]:
        raise ValueError("damaged payload")
    return payload


def pack_sequence(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return struct.pack("<Bq", NULL_ID * (doc_id is None) | WIDE * wide, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack_sequence(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", payload)
    return None if flags & NULL_ID else doc_id, np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=9).astype("<u4")


def write_records(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, file_bytes: int = 64 << 20) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write record files in ascending doc_id order.

    Tasks take ranges of doc_id, sort them and write files of about
    ``file_bytes``; file order (task, part) is id order.  Returns the manifest,
    a row per file.  Null texts count as empty; a null doc_id sorts first;
    repeated ids stay, next to each other.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, attempt, part, cache, schema = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, hf_cache(vocabulary), arrow_schema(MANIFEST)
        end = np.array([end_id], dtype="<u4").tobytes()
        out, index, ids = None, [], 0

        def close() -> pa.RecordBatch:
            out.commit()
            write_once(path + ".idx", b"".join(index))
            return pa.RecordBatch.from_pylist([{"task": task, "part": part, "path": path, "records": len(index), "ids": ids}], schema)

        for batch in slices(batches):
            encoded = cache.documents(strings(batch.column(1)))
            for doc_id, tokens in zip(batch.column(0).to_pylist(), encoded):
                if out is None:
                    path = f"{folder}/{task:06d}-{attempt}-{part:04d}.rec"  # the manifest names the file of its own attempt
                    out, index, ids = OnceFile(path), [], 0
                sequence = np.frombuffer(tokens + end, "<u4")
                framed = frame(pack_sequence(doc_id, sequence))
                index.append(struct.pack(INDEX, out.size, len(framed)))
                out.write(framed)
                ids += len(sequence)
                if out.size >= file_bytes:
                    yield close()
                    out, part = None, part + 1
        if out is not None:
            yield close()

    ranged = docs.select("doc_id", text_of("text").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return staged(ranged.mapInArrow(write, MANIFEST), "manifest")


def read_file(path: str, seed: int | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """Checked sequences of one record file; ``seed`` shuffles them by way of the index."""
    with open_input(path + ".idx") as f:
        index = f.read()
    entries = list(struct.iter_unpack(INDEX, index))
    if seed is not None:
        random.Random(seed).shuffle(entries)
    with open_input(path) as f:
        at = 0
        for offset, length in entries:
            if offset != at:
                f.seek(offset)
            at = offset + length
            yield unpack_sequence(unframe(f.read(length)))


def read_records(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Read record files back; ``files`` has a path and an integer ``base``, kept beside each row.

    Returns base, doc_id, in_file (ids before it in its file), n_tokens, ids_crc32
    and the ids as little-endian unsigned 32-bit integers (null without ``with_ids``).
    """
    ddl = "base long, doc_id long, in_file long, n_tokens long, ids_crc32 long, ids binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, at, size = [], 0, 0
                for doc_id, ids in read_file(path):
                    raw = ids.tobytes()
                    rows.append((base, doc_id, at, len(ids), zlib.crc32(raw), raw if with_ids else None))
                    at += len(ids)
                    size += len(raw) if with_ids else 64
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.select("path", "base").repartition(max(1, files.count()), "path").mapInArrow(read, ddl)


def with_bases(manifest: DataFrame) -> DataFrame:
    """Adds to each file the number of ids in all files before it (a row per file, so one small sort)."""
    before = F.sum("ids").over(Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("base", F.coalesce(before, F.lit(0)))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in the record files, read back from them."""
    manifest = write_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "records"))
    read = read_records(with_bases(manifest), with_ids=False)
    return read.select("doc_id", (F.col("base") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32")
