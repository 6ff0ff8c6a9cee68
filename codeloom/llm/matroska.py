"""Media columns as Matroska: EBML elements parsed into packet tables.

``mux`` stores a run of 8-bit samples as a Matroska audio file: EBML header, a
Segment with Info, Tracks, Clusters of laced SimpleBlocks, and Cues.  ``demux``
parses any such file into a packet table: a row per frame with its timestamp,
track and byte range, whichever of the four lacings its block uses.

An empty or null text is one 64-byte frame of zeros; long texts are cut into
frames, blocks and clusters of fixed size, so that a file is a plain run of small
elements.  Equal texts give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_schema, slices, staged, strings, table, text_of

# Element ids of EBML and Matroska: fixed values.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

RATE, FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER = 8000, 1024, 8, 4


def size_vint(n: int) -> bytes:
    length = 1
    while n >= (1 << 7 * length) - 1:  # all ones means unknown
        length += 1
    return ((1 << 7 * length) | n).to_bytes(length, "big")


def id_bytes(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def element(i: int, data: bytes) -> bytes:
    return id_bytes(i) + size_vint(len(data)) + data


def uint(i: int, n: int) -> bytes:
    return element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def float8(i: int, x: float) -> bytes:
    return element(i, struct.pack(">d", x))


def signed_vint(n: int) -> bytes:
    """Differences of EBML lacing: biased so that the middle of a length's range is 0."""
    length = 1
    while not -((1 << 7 * length - 1) - 1) <= n <= (1 << 7 * length - 1) - 1:
        length += 1
    return ((1 << 7 * length) | (n + (1 << 7 * length - 1) - 1)).to_bytes(length, "big")


def lace(frames: list[bytes], lacing: int) -> bytes:
    if lacing == NO_LACING:
        return frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(x) for x in frames]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += size_vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1]))
    return head + b"".join(frames)


def block(track: int, relative: int, frames: list[bytes]) -> bytes:
    """A SimpleBlock: frames of one size are laced as such, else by EBML lacing; a single one isn't laced."""
    lacing = NO_LACING if len(frames) == 1 else FIXED if len({len(x) for x in frames}) == 1 else EBML_LACING
    return element(SIMPLE_BLOCK, size_vint(track) + struct.pack(">hB", relative, 0x80 | lacing << 1) + lace(frames, lacing))


_HEAD = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, FRAME * 10**9 // RATE) + element(AUDIO, float8(SAMPLING_FREQUENCY, RATE) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))))


def mux(samples: bytes) -> bytes:
    """Samples as a Matroska file with one 8-bit PCM track; timestamps in milliseconds."""
    parts = [element(INFO, uint(TIMESTAMP_SCALE, 10**6) + float8(DURATION, len(samples) * 1000 / RATE) + element(MUXING_APP, b"codeloom") + element(WRITING_APP, b"codeloom")), _TRACKS]
    at, cues = len(parts[0]) + len(parts[1]), []
    per_block, per_cluster = FRAME * FRAMES_A_BLOCK, FRAME * FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    for c in range(0, len(samples), per_cluster):
        time = c * 1000 // RATE
        blocks = []
        for b in range(c, min(c + per_cluster, len(samples)), per_block):
            end = min(b + per_block, len(samples))
            blocks.append(block(1, b * 1000 // RATE - time, [samples[i : min(i + FRAME, end)] for i in range(b, end, FRAME)]))
        cluster = element(CLUSTER, uint(TIMESTAMP, time) + b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


def read_vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, int]:
    """(value, next position, length) of a variable-length integer."""
    first = data[at]
    if not first:
        raise ValueError("a variable-length integer of over eight bytes")
    length = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + length], "big")
    if at + length > len(data):
        raise ValueError("the data end inside an integer")
    return (value if keep_marker else value & ((1 << 7 * length) - 1)), at + length, length


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start of its data, end) of every element, masters before what they hold.

    A master of unknown size ends with what holds it, or before an element of its own level.
    """
    while at < end:
        start = at
        i, at, _ = read_vint(data, at, True)
        n, at, length = read_vint(data, at, False)
        stop = end if n == (1 << 7 * length) - 1 else at + n
        if stop > end:
            raise ValueError("an element is longer than what holds it")
        yield i, start, at, stop
        at = at if i in MASTERS else stop


def frame_ranges(data: bytes, at: int, end: int) -> tuple[int, int, list[tuple[int, int]]]:
    """(track, relative timestamp, byte ranges of the frames) of a Block or SimpleBlock."""
    track, at, _ = read_vint(data, at, False)
    relative, flags = struct.unpack_from(">hB", data, at)
    at, lacing = at + 3, flags >> 1 & 3
    if lacing == NO_LACING:
        return track, relative, [(at, end)]
    n, at, sizes = data[at] + 1, at + 1, []
    if lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == EBML_LACING and n > 1:
        size, at, _ = read_vint(data, at, False)
        sizes.append(size)
        for _ in range(n - 2):
            biased, at, length = read_vint(data, at, False)
            size += biased - ((1 << 7 * length - 1) - 1)
            sizes.append(size)
    elif lacing == FIXED:
        if (end - at) % n:
            raise ValueError("fixed lacing of frames that differ")
        sizes = [(end - at) // n] * (n - 1)
    ranges = []
    for size in sizes:
        ranges.append((at, at + size))
        at += size
    if at > end or min(sizes, default=0) < 0:
        raise ValueError("the sizes of laced frames don't fit their block")
    return track, relative, [*ranges, (at, end)]


def demux(data: bytes) -> dict:
    """The packet table of a Matroska file: packets (track, timestamp, start, end) and cues (time, track, position)."""
    packets, cues, clusters, duration, now, segment, scale, info = [], [], [], {}, 0, 0, 10**6, {}
    cue = cue_track = entry = None
    for i, start, at, end in elements(data, 0, len(data)):
        if i == SEGMENT:
            segment = at
        elif i == CLUSTER:
            clusters.append(start - segment)
        elif i == TIMESTAMP:
            now = int.from_bytes(data[at:end], "big")
        elif i in (SIMPLE_BLOCK, BLOCK):
            number, relative, ranges = frame_ranges(data, at, end)
            step = duration.get(number, 0) / scale
            packets += [(number, int(now + relative + k * step), a, b) for k, (a, b) in enumerate(ranges)]
        elif i == TIMESTAMP_SCALE:
            scale = int.from_bytes(data[at:end], "big")
        elif i == TRACK_ENTRY:  # its number and duration come in any order
            entry = {}
        elif i in (TRACK_NUMBER, DEFAULT_DURATION) and entry is not None:
            entry[i] = int.from_bytes(data[at:end], "big")
            if len(entry) == 2:
                duration[entry[TRACK_NUMBER]] = entry[DEFAULT_DURATION]
        elif i == CODEC_ID:
            info["codec"] = data[at:end].decode()
        elif i == CUE_TIME:
            cue = int.from_bytes(data[at:end], "big")
        elif i == CUE_TRACK:
            cue_track = int.from_bytes(data[at:end], "big")
        elif i == CUE_CLUSTER_POSITION:
            cues.append((cue, cue_track, int.from_bytes(data[at:end], "big")))
    return info | {"packets": packets, "cues": cues, "clusters": clusters, "segment": segment}


def feature(samples: np.ndarray, found: dict) -> str:
    """Counts of the packet table, the last timestamp, mean, root mean square and crossings of the middle value."""
    x = samples.astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"packets={len(found['packets'])};clusters={len(found['clusters'])};cues={len(found['cues'])};last_ms={found['packets'][-1][1]};mean={x.mean():.6f};rms={np.sqrt((x * x).mean()):.6f};crossings={crossings}"


MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
PACKETS = "doc_id long, track long, timestamp_ms long, start long, length long"


def with_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text, padded to a positive multiple of 64 bytes, as a stored media file."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(MEDIA)
        for batch in slices(batches):
            raw = [t.encode() for t in strings(batch.column(1))]
            media = [mux(x + bytes(-len(x) % 64 or 64 * (not x))) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return staged(docs.select("doc_id", text_of("text").alias("text")).mapInArrow(store, MEDIA), "media")


def packet_table(media: DataFrame) -> DataFrame:
    """A row per packet of every file of the media column."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(PACKETS)
        for batch in slices(batches):
            rows = [(d, t, ms, a, b - a) for d, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if m is not None for t, ms, a, b in demux(m)["packets"]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return media.select("doc_id", "media").mapInArrow(read, PACKETS)


def media_features(media: DataFrame) -> DataFrame:
    """Digests and a feature string of what the packets of each stored file hold."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(FEATURES)
        for batch in slices(batches):
            rows = []
            for doc_id, n, m in zip(*(c.to_pylist() for c in batch.columns)):
                found = demux(m)
                payload = b"".join(m[a:b] for _, _, a, b in found["packets"])
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(np.frombuffer(payload, np.uint8), found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, FEATURES)


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a media file and read back through its packet table."""
    return media_features(with_media(table(spark, sf_dir, "documents")))
