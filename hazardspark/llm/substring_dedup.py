"""Substring dedup: a count-min prefilter over word windows, then exact groups of what it lets through.

A window is `window` consecutive words of one document. Each partition sketches
how many of its documents hold each window; the merged sketch never
underestimates, so a window whose cell stays below two is in one document only and
is dropped. A window's cell is that of its anchor, which its neighbours mostly share. The others are grouped exactly by a 96-bit hash. In a map task a
window is sent once, for the smallest document that has it there: the other
documents of the task are known to repeat it. So a passage of very many
documents is a row for each task, not for each document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.llm import common as c

_BASE3 = np.uint64(0xD1342543DE82EF95)
MOST_BITS = 30
FLUSH = 800_000


def windows(texts: list[bytes | None], size: int, second: bool) -> tuple[np.ndarray, ...]:
    """First and second hash of every window, its anchor, the index of its text and its first word there."""
    w = c.Words(texts)
    h, count = w.hashes(), np.diff(w.first)
    own = np.maximum(count - size + 1, 0)
    doc = np.repeat(np.arange(len(texts)), own)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own)
    at = w.first[doc] + start
    one = c.grams(h, size)
    none = np.empty(0, np.uint64)
    if not len(at):
        return none, none, none, doc, start
    return one[at], c.grams(h, size, _BASE3)[at] if second else none, anchors(h, size)[at], doc, start


def anchors(words: np.ndarray, size: int) -> np.ndarray:
    """For each window, the least hash of its runs of about two thirds of it.

    Equal windows have equal anchors, and neighbouring windows mostly share one, so a
    sketch of anchors overestimates window counts with a third of the cells.
    """
    run = max(1, size * 2 // 3 + 1)
    g = c.grams(words, run)
    n = len(words) - size + 1
    least = g[:n].copy()
    for k in range(1, size - run + 1):
        np.minimum(least, g[k : n + k], out=least)
    return c.mix(least)


def _batches(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), c.binary(batch.column(1))
            for lo, hi in c.pieces(texts):
                yield ids[lo:hi], texts[lo:hi]


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of starts."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    return np.cumsum(edge)[:n] > 0


def repeated_windows(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, starts): the first words of the windows that a smaller doc_id has too, as packed uint32.

    docs: doc_id long, text. A row for each document that has any.
    """
    spark = docs.sparkSession
    letters = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = c.bits_for(letters // 18, 0.2, MOST_BITS)
    shift = np.uint64(64 - bits)

    def sketch(batches):
        held, many = [np.empty(0, dtype=np.uint64)], 0
        for ids, texts in _batches(batches):
            _, _, h, doc, _ = windows(texts, window, False)
            cell = np.unique(((h >> shift) << np.uint64(64 - bits)) | (doc.astype(np.uint64) & ((np.uint64(1) << shift) - np.uint64(1)))) >> shift  # once a document
            held.append(cell)
            many += len(cell)
            if many > FLUSH:
                yield c.sketch_rows(np.concatenate(held).astype(np.int64))
                held, many = [np.empty(0, dtype=np.uint64)], 0
        yield c.sketch_rows(np.concatenate(held).astype(np.int64))

    twice = spark.sparkContext.broadcast(c.merged_sketch(docs.mapInArrow(c.lean(sketch), c.SKETCH_SCHEMA), bits, at_least=2))
    shards = max(c.width(docs), math.ceil(letters / 6 / 2_000_000))

    def settle(one, two, doc, start):
        """Occurrences in order of window and document, and whether the window has a smaller document."""
        order = np.lexsort((start, doc, two, one))
        one, two, doc, start = one[order], two[order], doc[order], start[order]
        new = np.ones(len(one), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        return one, two, doc, start, doc > doc[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(one) else np.zeros(0, dtype=bool)

    def rows(shard, data):
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(data, pa.binary())], names=["shard", "data"])

    def by_bucket(doc, start):
        """Known windows packed for the buckets of their documents."""
        bucket = (c.mix(doc.view(np.uint64).copy()) % np.uint64(shards)).astype(np.int32)
        order = np.lexsort((start, doc, bucket))
        cut = np.searchsorted(bucket[order], np.arange(shards + 1))
        ids = np.flatnonzero(np.diff(cut)).astype(np.int32)
        return ids, [packed_starts(doc[i], start[i]) for i in (order[cut[k] : cut[k + 1]] for k in ids)]

    def suspects(batches):
        """Packed windows of a shard, and (shard -1) documents with windows repeated from this task's own rows."""

        def flush(held):
            one, two, doc, start, known = settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
            ids, data = by_bucket(doc[known], start[known])
            yield rows(-1 - ids, data)
            one, two, doc, start = one[~known], two[~known], doc[~known], start[~known]
            shard = (c.mix(one) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            ids = np.flatnonzero(np.diff(cut))
            yield rows(ids, [packed_windows(*(x[order[cut[i] : cut[i + 1]]] for x in (one, two, doc, start))) for i in ids])

        held, many = [], 0
        for ids, texts in _batches(batches):
            one, two, anchor, doc, start = windows(texts, window, True)
            cell = (anchor >> shift).astype(np.int64)
            open_ = (twice.value[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
            held.append((one[open_], (two[open_] >> np.uint64(32)).astype(np.uint32), ids[doc[open_]].astype(np.int64), start[open_].astype(np.uint32)))
            many += int(open_.sum())
            if many > FLUSH:
                yield from flush(held)
                held, many = [], 0
        if held:
            yield from flush(held)

    def exact(tab: pa.Table) -> pa.Table:
        data = tab.column("data").to_pylist()
        if tab.column("shard")[0].as_py() < 0:
            return pa.table({"bucket": pa.array([-1 - tab.column("shard")[0].as_py()] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})
        _, _, doc, start, known = settle(*(np.concatenate(x) for x in zip(*map(read_windows, data), strict=True)))
        ids, out = by_bucket(doc[known], start[known])
        return pa.table({"bucket": pa.array(ids, pa.int32()), "data": pa.array(out, pa.binary())})

    def by_doc(tab: pa.Table) -> pa.Table:
        doc, start = (np.concatenate(x) for x in zip(*map(read_starts, tab.column("data").to_pylist()), strict=True))
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        cut = [*np.flatnonzero(np.diff(doc)) + 1]
        return pa.table({"doc_id": doc[[0, *cut]] if len(doc) else doc, "starts": pa.array([x.tobytes() for x in np.split(start, cut)] if len(doc) else [], pa.binary())})

    found = docs.mapInArrow(c.lean(suspects), "shard int, data binary")
    known = found.groupBy("shard").applyInArrow(c.lean_group(exact), "bucket int, data binary")
    return known.groupBy("bucket").applyInArrow(c.lean_group(by_doc), "doc_id long, starts binary")


def packed_windows(one: np.ndarray, two: np.ndarray, doc: np.ndarray, start: np.ndarray) -> bytes:
    ids, place = np.unique(doc, return_inverse=True)
    return b"".join([np.array([len(ids), len(one)], np.int64).tobytes(), ids.tobytes(), one.tobytes(), two.tobytes(), place.astype(np.uint32).tobytes(), start.tobytes()])


def read_windows(data: bytes) -> tuple[np.ndarray, ...]:
    n, m = np.frombuffer(data, np.int64, 2)
    at = 16 + 8 * n
    ids, one = np.frombuffer(data, np.int64, n, 16), np.frombuffer(data, np.uint64, m, at)
    two, place, start = (np.frombuffer(data, np.uint32, m, at + (8 + 4 * k) * m) for k in range(3))
    return one, two, ids[place], start


def packed_starts(doc: np.ndarray, start: np.ndarray) -> bytes:
    """doc in order."""
    ids, many = np.unique(doc, return_counts=True)
    return b"".join([np.array([len(ids), len(doc)], np.int64).tobytes(), ids.tobytes(), many.astype(np.uint32).tobytes(), start.astype(np.uint32).tobytes()])


def read_starts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(data, np.int64, 2)
    ids, many = np.frombuffer(data, np.int64, n, 16), np.frombuffer(data, np.uint32, n, 16 + 8 * n)
    return np.repeat(ids, many), np.frombuffer(data, np.uint32, m, 16 + 12 * n)


def _cut(text: bytes | None, marks: bytes | None, window: int) -> tuple[int, int, bytes | None]:
    """Words, words that go, and the text that stays."""
    w = (text or b"").split()
    if not marks:
        return len(w), 0, text
    out = covered(np.frombuffer(marks, dtype=np.uint32).astype(np.int64), window, len(w))
    return len(w), int(out.sum()), b" ".join([x for x, g in zip(w, out.tolist(), strict=True) if not g])


def _flags(docs: DataFrame, window: int, id: str, text: str) -> DataFrame:
    read = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return repeated_windows(read, window)


def substring_dedup(docs: DataFrame, window: int = 13, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the text without the words of repeated windows.

    A word goes if a window that covers it also starts in a document with a
    smaller id; windows are judged on the input. Where nothing goes, kept is
    the text as it is, else its words joined by single spaces. Null and empty
    texts, and texts shorter than a window, lose nothing. Rows that repeat an id are
    judged as one document and each give a row; rows without an id lose nothing.
    """

    def cut(batches):
        for batch in batches:
            n, gone, kept = zip(*(_cut(t, m, window) for t, m in zip(c.binary(batch.column("text")), batch.column("starts").to_pylist(), strict=True)), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    read = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.join(_flags(docs, window, id, text), "doc_id", "left").mapInArrow(c.lean(cut), "doc_id long, n_words long, n_removed long, kept string")


def without_repeats(docs: DataFrame, window: int = 13, id: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with texts cut as by substring_dedup, all columns kept; texts that lose every word go.

    A column of lengths, where there is one, is set anew for texts that changed.
    """
    schema = docs.schema
    own, marks = (next(x for x in (f"{name}_{k}" for k in range(len(docs.columns) + 1)) if x not in docs.columns) for name in ("of", "starts"))  # names of no column of docs
    flags = _flags(docs, window, id, text).select(F.col("doc_id").alias(own), F.col("starts").alias(marks))

    def cut(batches):
        for batch in batches:
            got = [_cut(t, m, window) for t, m in zip(c.binary(batch.column(text)), batch.column(marks).to_pylist(), strict=True)]
            kept = pa.array([g[2] for g in got], pa.binary()).cast(pa.string())
            columns = {f.name: batch.column(f.name) for f in schema} | {text: kept}
            if length in columns:
                new = pa.array([None if t is None else len(t) for t in kept.to_pylist()], columns[length].type)
                columns[length] = pa.compute.if_else(pa.array([g[1] > 0 for g in got], pa.bool_()), new, columns[length])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).filter(pa.array([not g[1] or g[1] < g[0] for g in got], pa.bool_()))

    return docs.join(flags, F.col(id).cast("long") == F.col(own), "left").drop(own).mapInArrow(c.lean(cut), schema)


def digest(kept: DataFrame) -> DataFrame:
    """kept_sha256 of the words of kept, joined by one space."""
    words = F.trim(F.regexp_replace(F.coalesce("kept", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))
