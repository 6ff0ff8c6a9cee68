"""SimHash near-duplicates by tiled exact comparison.

A document's 64-bit fingerprint is the bitwise majority of its shingles' hashes.
Distinct fingerprints are laid out in tiles by the population counts of their
four 16-bit quarters.  Two fingerprints that differ in at most r bits have counts
that differ by at most r in sum, so a pair of tiles whose counts lie farther
apart is skipped as a whole; all other pairs are compared in full, by exclusive
or and bit counts in numpy.  A pair of tiles gives a spanning forest of its links
rather than the links, so that a group of copies never turns into all its pairs.

Null texts count as empty; texts without words have the fingerprint zero and are
linked like any other.  A null doc_id never names a component unless all of its
component's are null.  Repeated rows share a fingerprint.  An empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, OnceFile, arrow_schema, keep_rows, numbered, open_input, released, scratch, slices, staged, strings, table, text_of, write_once
from .components import components

TILE = 8192
SEED = 42
#: For each byte, a word whose byte j is bit j.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_hashes(text: str, width: int) -> list[int]:
    words = text.encode().lower().split()  # bytes: only A-Z change, only the six ASCII white spaces split
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    digest = xxhash.xxh64_intdigest
    return [digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(width))))]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprint of each list: bits that are set in over half of it."""
    counts = np.array([len(x) for x in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    flat = np.concatenate([np.array(hashes[i], np.uint64) for i in some]).view(np.uint8).reshape(-1, 8)
    ends = np.cumsum(counts[some])
    starts = ends - counts[some]
    parts = -(-counts[some] // 255)  # byte lanes hold sums up to 255
    first = np.cumsum(parts) - parts
    cuts = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    for k in range(8):
        lanes = np.add.reduceat(_LANES[flat[:, k]], cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(lanes, first, axis=0)
        bits = (2 * ones > counts[some][:, None]).astype(np.uint64)
        out[some] |= (bits << np.arange(8 * k, 8 * k + 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    ddl = "doc_id long, fp long"

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in slices(batches, rows=128, size=2 << 20):
            fp = majority([shingle_hashes(t, width) for t in strings(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], schema=schema)

    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(compute, ddl)


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's component."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, label[label]):
            label = label[label]


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within a pair of tiles: (fingerprint, another of its component)."""
    nodes, label, u, v, kept = np.concatenate([a, b]), None, [], [], 0

    def reduce() -> None:
        nonlocal label, u, v, kept
        old = [] if label is None else [(np.arange(len(nodes)), label)]
        pairs = [*zip(u, v), *old]
        label = forest(len(nodes), np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs]))
        u, v, kept = [], [], 0

    rows = max(1, (1 << 17) // max(1, len(b)))
    for i in range(0, len(a), rows):
        near = np.bitwise_count(a[i : i + rows, None] ^ b[None, :]) <= radius
        if near.any():
            r, c = np.nonzero(near)
            if same:
                r, c = r[r + i < c], c[r + i < c]
            u.append(r + i)
            v.append(c + len(a) if not same else c)
            kept += len(r)
            if kept > 1 << 20:
                reduce()
    if u:
        reduce()
    if label is None:
        return nodes[:0], nodes[:0]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _lay_out(cells: list[tuple[int, int, int, int, int]]) -> pd.DataFrame:
    """Tiles for cells (q0, q1, q2, q3, count): runs of cells with equal halves, up to ``TILE`` rows; a larger cell is dealt over chunks."""
    out, tile, last, filled = [], -1, None, 0
    for q0, q1, q2, q3, n in sorted(cells, key=lambda c: (c[0] + c[1], c[2] + c[3], c[0], c[2])):
        half = (q0 + q1, q2 + q3)
        if half != last or filled + n > TILE:
            tile, last, filled = tile + 1, half, 0
        filled += n
        out.append((q0, q1, q2, q3, tile, -(-n // TILE)))
    return pd.DataFrame(out, columns=["q0", "q1", "q2", "q3", "tile", "chunks"])


def near_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that span every group linked within ``radius`` bits."""
    spark = fps.sparkSession
    quarters = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))).alias(f"q{k}") for k in range(4)]
    counted = staged(fps.select("fp", *quarters), "quarters")
    cells = counted.groupBy("q0", "q1", "q2", "q3").agg(F.count("*").alias("n")).collect()  # 17 ** 4 rows at most
    if not cells:
        return spark.createDataFrame([], "a long, b long")
    layout = spark.createDataFrame(_lay_out([tuple(c) for c in cells]), "q0 int, q1 int, q2 int, q3 int, tile int, chunks int")
    placed = counted.join(F.broadcast(layout), ["q0", "q1", "q2", "q3"])  # a row per cell: 17 ** 4 at most
    keyed = placed.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    box = [f(f"q{k}").alias(f"{n}{k}") for k in range(4) for n, f in (("lo", F.min), ("hi", F.max))]
    tiles = staged(keyed.groupBy("tile", "chunk").agg(F.collect_list("fp").alias("fps"), *box, F.min(F.col("q0") + F.col("q1")).alias("h0"), F.min(F.col("q2") + F.col("q3")).alias("h1")), "tiles")

    boxes = tiles.drop("fps").withColumn("id", F.struct("tile", "chunk"))
    steps = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if abs(x) + abs(y) <= radius]
    left = boxes.select(*[F.col(c).alias("l_" + c) for c in boxes.columns], F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps])).alias("s"))
    left = left.select("*", (F.col("l_h0") + F.col("s.x")).alias("h0"), (F.col("l_h1") + F.col("s.y")).alias("h1"))
    gap = sum((F.greatest(F.lit(0), F.col(f"lo{k}") - F.col(f"l_hi{k}"), F.col(f"l_lo{k}") - F.col(f"hi{k}")) for k in range(4)), F.lit(0))
    pairs = left.join(boxes, ["h0", "h1"]).where((F.col("l_id") <= F.col("id")) & (gap <= radius)).select(F.col("l_tile").alias("tile_a"), F.col("l_chunk").alias("chunk_a"), F.col("tile").alias("tile_b"), F.col("chunk").alias("chunk_b"))
    blobs = tiles.select("tile", "chunk", "fps")
    with_a = pairs.join(blobs.toDF("tile_a", "chunk_a", "fps_a"), ["tile_a", "chunk_a"])
    with_b = with_a.join(blobs.toDF("tile_b", "chunk_b", "fps_b"), ["tile_b", "chunk_b"])
    same = (F.col("tile_a") == F.col("tile_b")) & (F.col("chunk_a") == F.col("chunk_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(k)[i].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in (0, 1))
                x, y = tile_links(a, b, batch.column(2)[i].as_py(), radius)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    return with_b.select("fps_a", "fps_b", same.alias("same")).mapInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id linked to it through any chain, for every row."""
    prints = staged(fingerprints(docs, width), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(near_links(distinct.select("fp"), radius))
    rooted = staged(distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")
    least = staged(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    classes = staged(rooted.join(least, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of each component the one of least doc_id."""
    rows = numbered(docs)
    found = near_groups(rows.select(F.col(ROW).alias("doc_id"), "text"), width, radius).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    named = rows.select(F.col(ROW).alias("row"), "doc_id")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    kept = found.join(named, "row").groupBy("component").agg(best).select(F.col("best.row").alias("row"))
    return keep_rows(rows, kept, docs.columns)


# ---- similar shingle sets ----
#
# A wide radius finds what is similar but also much that is not, so each pair found
# is checked on its shingle sets.  Population counts rule nothing out at such a radius;
# the sizes of the sets do, as a share of common shingles bounds their ratio.  Tiles
# therefore hold sets of like sizes.  What is found by chance grows with the square of the
# sets; nearly all of it is ruled out, exactly, by how many members each set has in each of
# MARKS classes of hashes, before a text is read.  A task unites what it has found similar and
# checks no pair that is united already, so a group of copies never turns into all
# its pairs.

#: Classes of hashes whose members are counted, in a byte each; a set with a count that doesn't fit has FULL in all.
MARKS, FULL = 128, 255
#: A set in a tile: fingerprint, shingles, row, where its text lies, and its counts.
_ENTRY = np.dtype([*((k, "<u8" if k == "fp" else "<i8") for k in ("fp", "n", "row", "file", "at", "size", "raw")), ("marks", "u1", (MARKS,))])
#: Bytes of shingle sets and number of open files that a comparing task keeps.
CACHE, OPEN = 64 << 20, 32


def shingle_set(text: str, width: int) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def alike(a: int | np.ndarray, b: int | np.ndarray, common: int | np.ndarray, share: float) -> bool | np.ndarray:
    """Whether sets of ``a`` and ``b`` members have ``share`` of their union in common."""
    return common + 1e-9 >= share * (a + b - common)


def marks_of(members: np.ndarray) -> np.ndarray:
    """How many members of a set each class of hashes has; FULL in all where one has as many or more."""
    counts = np.bincount((members & np.uint64(MARKS - 1)).astype(np.int64), minlength=MARKS)
    return np.full(MARKS, FULL, np.uint8) if counts.max() >= FULL else counts.astype(np.uint8)


def most_common(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The most members that sets of such marks (a row each) and sizes can have in common."""
    most = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    return np.where((a[:, 0] == FULL) | (b[:, 0] == FULL), np.minimum(na, nb), most)


def _set_prints(rows: DataFrame, store: str, width: int) -> DataFrame:
    """A row per document: fingerprint, size and digest of its shingle set, and where its text lies in ``store``."""
    ddl = "row long, doc_id long, fp long, n long, digest long, file long, at long, size long, raw long, marks binary"

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, codec, attempt, out = arrow_schema(ddl), pa.Codec("zstd"), TaskContext.get().taskAttemptId(), None
        for batch in slices(batches, rows=128, size=2 << 20):
            out = out or OnceFile(f"{store}/texts-{attempt}")
            texts = strings(batch.column(2))
            sets = [shingle_set(x, width) for x in texts]
            # an even count takes its least hash twice: no bit is tied, and similar sets mostly share it
            fp = majority([x if len(x) % 2 else np.concatenate([x[:1], x]) for x in sets])
            at, size, raw = [], [], []
            for x in texts:
                data = x.encode()
                packed = codec.compress(data, asbytes=True)
                at.append(out.size)
                size.append(len(packed))
                raw.append(len(data))
                out.write(packed)
            digest = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            columns = [batch.column(0), batch.column(1), fp.view(np.int64), [len(x) for x in sets], digest, [attempt] * len(texts), at, size, raw]
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([marks_of(x).tobytes() for x in sets], pa.binary())], schema=schema)
        if out:
            out.commit()

    return rows.select(F.col(ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(compute, ddl)


class _Sets:
    """The shingle sets of entries, read from the store; a bounded number of bytes is kept."""

    def __init__(self, store: str, width: int):
        self.store, self.width, self.codec = store, width, pa.Codec("zstd")
        self.sets: OrderedDict[int, np.ndarray] = OrderedDict()
        self.files: OrderedDict[int, pa.NativeFile] = OrderedDict()
        self.held = 0

    def __call__(self, e: np.void) -> np.ndarray:
        row, file = int(e["row"]), int(e["file"])
        found = self.sets.pop(row, None)
        if found is None:
            opened = self.files.pop(file, None) or open_input(f"{self.store}/texts-{file}")
            self.files[file] = opened
            if len(self.files) > OPEN:
                self.files.popitem(last=False)[1].close()
            opened.seek(int(e["at"]))
            found = shingle_set(self.codec.decompress(opened.read(int(e["size"])), int(e["raw"]), asbytes=True).decode(), self.width)
            self.held += found.nbytes
        self.sets[row] = found
        while self.held > CACHE and len(self.sets) > 2:
            self.held -= self.sets.popitem(last=False)[1].nbytes
        return found


def similar_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int, share: float, load: Callable[[np.void], np.ndarray]) -> list[tuple[int, int]]:
    """Links (row, row) that span the groups of similar sets within a pair of tiles."""
    nodes = a if same else np.concatenate([a, b])
    base = 0 if same else len(a)
    label, out = np.arange(len(nodes)), []
    fa, fb, na, nb = (np.ascontiguousarray(x[k]) for k in ("fp", "n") for x in (a, b))
    ma, mb = a["marks"], b["marks"]
    step = max(1, (1 << 17) // max(1, len(b)))
    for start in range(0, len(a), step):
        r, c = np.nonzero(np.bitwise_count(fa[start : start + step, None] ^ fb[None, :]) <= radius)
        r += start
        fits = alike(na[r], nb[c], np.minimum(na[r], nb[c]), share)
        if same:
            fits &= r < c
        r, c = r[fits], c[fits]
        some = alike(na[r], nb[c], most_common(ma[r], mb[c], na[r], nb[c]), share)
        r, c = r[some], c[some] + base
        heads = np.flatnonzero(np.diff(r, prepend=-1))
        for x, y in zip(heads, [*heads[1:], len(r)]):
            i = r[x]
            left = c[x:y][label[c[x:y]] != label[i]]
            while len(left):
                j, left = left[0], left[1:]
                u, v = load(nodes[i]), load(nodes[j])
                if alike(len(u), len(v), len(np.intersect1d(u, v, assume_unique=True)), share):
                    out.append((int(nodes["row"][i]), int(nodes["row"][j])))
                    label[label == label[j]] = label[i]
                    left = left[label[left] != label[i]]
    return out


def _size_tiles(cells: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """[first bucket, last bucket, least n, greatest n, chunks] for cells (bucket, count, least n, greatest n): runs of up to ``TILE`` sets."""
    tiles, filled = [], TILE
    for bucket, count, low, high in sorted(cells):
        if filled + count > TILE:
            tiles.append([bucket, bucket, low, high, -(-count // TILE)])
            filled = 0
        filled += count
        tiles[-1][1], tiles[-1][3] = bucket, high
    return tiles


def similar_sets(sets: DataFrame, store: str, width: int, share: float, radius: int) -> DataFrame:
    """(a, b): links between rows of ``sets`` that span every group of similar ones found within ``radius`` bits."""
    spark = sets.sparkSession
    bucket = F.floor(F.log(F.col("n").cast("double")) / math.log(1.02)).cast("int")
    # smaller sets are similar only if equal
    sized = sets.where(F.col("n") + 1e-9 >= share / (1 - share)).withColumn("bucket", bucket)
    cells = sized.groupBy("bucket").agg(F.count("*"), F.min("n"), F.max("n")).collect()  # a row per 2 % of size
    if not cells:
        return spark.createDataFrame([], "a long, b long")
    tiles = _size_tiles([tuple(x) for x in cells])
    near = []  # of runs of sizes, as few as those
    for i, (_, _, _, high, _) in enumerate(tiles):
        for j in range(i, len(tiles)):
            if high + 1e-9 < share * tiles[j][2]:
                break
            near.append((i, j))
    layout = spark.createDataFrame([(k, i, tile[4]) for i, tile in enumerate(tiles) for k in range(tile[0], tile[1] + 1)], "bucket int, tile int, chunks int")
    placed = sized.join(F.broadcast(layout), "bucket").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))
    names = list(_ENTRY.names)
    grouped = placed.groupBy("tile", "chunk").agg(F.collect_list(F.struct(*names)).alias("entries"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                entries = batch.column(2)[i].values
                data = np.empty(len(entries), _ENTRY)
                for name in names:
                    if name == "marks":
                        data[name] = np.frombuffer(b"".join(entries.field(name).to_pylist()), np.uint8).reshape(-1, MARKS)
                        continue
                    x = entries.field(name).to_numpy(zero_copy_only=False)
                    data[name] = x.view(np.uint64) if name == "fp" else x
                write_once(f"{store}/tile-{batch.column(0)[i]}-{batch.column(1)[i]}", data.tobytes())
            yield batch.select([0, 1])

    present = staged(grouped.mapInArrow(write, "tile int, chunk int"), "tiles")
    a, b = (present.select(F.col("tile").alias(f"tile_{x}"), F.col("chunk").alias(f"chunk_{x}")) for x in "ab")
    pairs = a.join(F.broadcast(spark.createDataFrame(near, "tile_a int, tile_b int")), "tile_a").join(b, "tile_b").where("tile_a < tile_b or chunk_a <= chunk_b")
    pairs = staged(pairs.select("tile_a", "chunk_a", "tile_b", "chunk_b"), "tile-pairs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = _Sets(store, width)

        def read(tile: int, chunk: int) -> np.ndarray:
            with open_input(f"{store}/tile-{tile}-{chunk}") as f:
                return np.frombuffer(f.read(), _ENTRY)

        for batch in batches:
            for i, x, j, y in zip(*(c.to_pylist() for c in batch.columns)):
                found = similar_links(read(i, x), read(j, y), (i, x) == (j, y), radius, share, load)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    tasks = max(1000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pairs.repartition(max(1, min(pairs.count(), tasks)))
    return dealt.mapInArrow(compare, "a long, b long")


def drop_similar(docs: DataFrame, width: int = 5, share: float = 0.8, radius: int = 18) -> DataFrame:
    """The rows of ``docs`` that stay: of each group linked by similar shingle sets the one of least doc_id.

    Two sets are similar if ``share`` of their union is common to both.  Pairs are
    looked for within ``radius`` bits; of those with just that share nearly all lie there.
    """
    rows = numbered(docs)
    store = scratch(docs.sparkSession, "similar")
    prints = staged(_set_prints(rows, store, width), "set-prints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "file", "at", "size", "raw", "marks")).alias("best")
    sets = staged(prints.groupBy("fp", "n", "digest").agg(best).select("fp", "n", "best.*"), "sets")
    links = staged(similar_sets(sets, store, width, share, radius), "links")
    released(docs.sparkSession, store, prints)
    roots = components(links)
    rooted = sets.join(roots.select(F.col("node").alias("row"), "root"), "row", "left").withColumn("component", F.coalesce("root", "row"))
    kept = rooted.groupBy("component").agg(F.min(F.struct("none", "doc_id", "row")).alias("best")).select("best.row")
    return keep_rows(rows, staged(kept, "kept"), docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
