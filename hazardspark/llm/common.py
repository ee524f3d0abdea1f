"""What several operators share: words and hashes of whole batches, sketches, components.

Words are the runs of bytes outside space and \\t \\n \\v \\f \\r. All hashes are
64-bit polynomials over the bytes of a word, mixed once more, and computed for
a few megabytes of text at a time, so memory follows the longest single text
and not the partition.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F | 1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode, as in tests, one of our own where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(own or f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """A table of its own in the shared folder, compressed: for rows that hold texts."""
    return stored_at(df, f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}")


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """df written to a path of the shared folder and read again; dropped() takes it away."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table that stored_at wrote."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def release() -> None:
    """Give memory that is free back to the machine: a worker stays for later tasks, of other stages too."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lean(f: Callable) -> Callable:
    """f over batches, releasing after each and at the end of the task."""

    def settled(batches):
        for batch in batches:
            yield batch
            del batch
            release()

    def run(batches):
        yield from f(settled(batches))
        release()

    return run


def lean_group(f: Callable) -> Callable:
    """f from the table of a group to a table, releasing after each."""

    def run(tab):
        out = f(tab)
        del tab
        release()
        return out

    return run


def width(df: DataFrame) -> int:
    """Tasks for a shuffle that is dealt out by hand."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64, i below n."""
    got = _powers.get(int(base))
    if got is None or len(got[0]) < n:
        m = max(n, CHUNK_BYTES + 4096)
        one, inverse = np.ones(m, dtype=np.uint64), pow(int(base), -1, 1 << 64)
        up, down = one.copy(), one
        up[1:], down = base, np.full(m, np.uint64(inverse))
        down[0] = 1
        got = _powers[int(base)] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if m > 5 * CHUNK_BYTES // 2:  # a single huge text: don't keep its tables
            _powers.pop(int(base))
    return got


def pieces(texts: list[bytes | None], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about size bytes; a longer text is a range of its own."""
    lo, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and total + n > size:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(texts):
        yield lo, len(texts)


class Words:
    """The words of some texts: start and end in buf, first[i]:first[i + 1] are those of text i."""

    def __init__(self, texts: list[bytes | None], lower: bool = False, space: np.ndarray = SPACE):
        texts = [t or b"" for t in texts]
        raw = b" ".join(texts) + b" "
        self.raw = raw
        buf = np.frombuffer(raw, dtype=np.uint8)
        self.buf = LOWER[buf] if lower else buf
        self.at = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.at[1:])
        inside = np.zeros(len(buf) + 2, dtype=np.int8)
        inside[1:-1] = ~space[buf]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, self.at)

    def hashes(self, base: np.uint64 = _BASE) -> np.ndarray:
        up, down = powers(base, len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, dtype=np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[: len(self.buf)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def grams(words: np.ndarray, n: int, base: np.uint64 = _BASE2) -> np.ndarray:
    """Hash of the n words from each place that has n; texts are not told apart here."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(base, len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1] + np.uint64(n))


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many rows, so that few texts are held as Python objects at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


# --- sketches: sorted cells as gaps, merged by slice -------------------------------------------

SLICE_BITS = 20


def encode_gaps(cells: np.ndarray) -> bytes:
    """Sorted distinct numbers as gaps: 255 stands for 255 more, any other byte ends a gap."""
    gap = np.diff(cells.astype(np.int64), prepend=-1) - 1
    out = np.full(int((gap // 255 + 1).sum()), 255, dtype=np.uint8)
    out[np.cumsum(gap // 255 + 1) - 1] = gap % 255
    return out.tobytes()


def decode_gaps(data: bytes) -> np.ndarray:
    gap = np.frombuffer(data, dtype=np.uint8)
    ends = gap != 255
    return np.cumsum(gap.astype(np.int64))[ends] + np.arange(int(ends.sum()))


SKETCH_SCHEMA = "slice int, cells binary, counts binary"


def sketch_rows(cells: np.ndarray) -> pa.RecordBatch:
    """A partition's sketch: each of its cells with a count of at most 255. cells: one for each document and item."""
    cells, counts = np.unique(cells, return_counts=True)
    if not len(cells):
        return pa.RecordBatch.from_pylist([], pa.schema([("slice", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())]))
    slices = (cells >> SLICE_BITS).astype(np.int64)
    cut = np.flatnonzero(np.diff(slices, prepend=-1))
    counts = np.minimum(counts, 255).astype(np.uint8)
    rows = [(int(slices[a]), encode_gaps(cells[a:b] & ((1 << SLICE_BITS) - 1)), counts[a:b].tobytes() if (counts[a:b] > 1).any() else b"") for a, b in zip(cut, [*cut[1:], len(cells)], strict=True)]
    s, c, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(c, pa.binary()), pa.array(n, pa.binary())], names=["slice", "cells", "counts"])


def merged_sketch(partial: DataFrame, bits: int, at_least: int | None = None, scale: int = 0) -> np.ndarray:
    """Sum the partition sketches slice by slice; at_least: one bit a cell, set if its count reaches that, else uint16 counts, halved scale times.

    The result has 2**bits cells whatever the input, so what reaches the driver is bounded by bits.
    """
    size, bitmap = 1 << min(bits, SLICE_BITS), at_least is not None

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, cells, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = total.setdefault(s, np.zeros(size, dtype=np.uint32))
                at = decode_gaps(cells)
                more = np.frombuffer(counts, dtype=np.uint8) if counts else np.ones(1, dtype=np.uint8)
                own[at] = np.minimum(own[at].astype(np.int64) + more, 2**32 - 1)
        for s, own in total.items():
            data = np.packbits(own >= at_least, bitorder="little") if bitmap else np.minimum(own >> np.uint32(scale), 65535).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["slice", "data"])

    out = np.zeros((1 << bits) // 8 if bitmap else 1 << bits, dtype=np.uint8 if bitmap else np.uint16)
    step = size // 8 if bitmap else size
    for row in partial.repartition(width(partial), "slice").mapInArrow(lean(merge), "slice int, data binary").toLocalIterator():
        out[row[0] * step : (row[0] + 1) * step] = np.frombuffer(row[1], dtype=out.dtype)
    return out


def bits_for(items: int, load: float, most: int) -> int:
    """Cells, as a power of two, for so many items at this load; at most 2**most, for a bounded broadcast."""
    return int(min(most, max(10, np.ceil(np.log2(max(items, 1) / load)))))


# --- row blocks ------------------------------------------------------------------------------


def row_blocks(rows: DataFrame, by: list[str], bin: str, id: str, size: int, counts: DataFrame | None = None) -> DataFrame:
    """Deal rows out so that each meets all rows of its bin, and all of the next bin, in some block of about 2 * size rows.

    Bins are integers within the columns by. A bin of k * size rows is cut into
    k parts by a hash of id; the columns x, y number pairs of parts, bin is the lower
    bin, is_left marks its rows on one side, is_upper the rows of the next bin. A pair of one bin meets twice, as left
    and right in either order (or once, in the same block, where k is 1).
    counts: rows to count instead, where these are cheaper to make.
    """
    tiles = (rows if counts is None else counts).groupBy(*by, bin).agg(F.ceil(F.count("*") / size).cast("long").alias("k"))
    near = lambda step, name: tiles.select(*by, (F.col(bin) + step).alias(bin), F.col("k").alias(name))
    rows = rows.join(tiles.join(near(-1, "above"), [*by, bin], "left").join(near(1, "below"), [*by, bin], "left"), [*by, bin])
    own = F.pmod(F.xxhash64(id), F.col("k"))
    upto = lambda k: F.sequence(F.lit(0).cast("long"), k - 1)
    part = lambda b, x, y, left: F.struct(b.cast("int").alias(bin), x.alias("x"), y.alias("y"), F.lit(left).alias("is_left"), (b != F.col(bin)).alias("is_upper"))
    none = F.array().cast(f"array<struct<{bin}:int,x:bigint,y:bigint,is_left:boolean,is_upper:boolean>>")
    as_left = F.transform(upto(F.greatest("k", F.coalesce("above", F.lit(1).cast("long")))), lambda y: part(F.col(bin), own, y, True))
    as_right = F.transform(upto(F.col("k")), lambda x: part(F.col(bin), x, own, False))
    as_upper = F.when(F.col("below").isNotNull(), F.transform(upto(F.col("below")), lambda x: part(F.col(bin) - 1, x, own, False))).otherwise(none)
    return rows.withColumn("t", F.explode(F.concat(as_left, as_right, as_upper))).drop(bin, "k", "above", "below").select("*", "t.*").drop("t")


# --- connected components --------------------------------------------------------------------


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable in a graph of n nodes held in one task; by halving of parents."""
    parent = np.arange(n)
    while len(a):
        ra, rb = parent[a], parent[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        open_ = parent[a] != parent[b]
        a, b = a[open_], b[open_]
    return parent


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over edges; only nodes with an edge come out.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each
    is a minimum per node, combined on the map side, and an equi-join that AQE
    may split, so a node with very many edges isn't gathered anywhere. Each
    round is checkpointed in the shared folder; rounds end when nothing changes.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = checkpointed(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u go to the smallest in u's neighbourhood
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below u, and u, go to the smallest of them
        small = big.groupBy("u").agg(F.min("v").alias("m"))
        e = big.join(small, "u").select("u", "v", "m")
        e = e.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = checkpointed(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.groupBy("u").agg(F.min("v").alias("m")).select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("m").alias("component")), F.struct(F.col("m").alias("node"), F.col("m").alias("component")))).alias("x")).select("x.node", "x.component").distinct()
