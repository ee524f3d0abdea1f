"""Packing of token sequences by shortest-pack-first over the length histogram.

A document is cut into pieces of `size` ids and a rest. Only the histogram of
piece lengths (at most `size` numbers) reaches the driver: lengths are placed
longest first, each on the shortest pack that has room, and packs alike are one
pattern with a count. A piece then finds its pattern by its rank among the
pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.llm import common as c

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_encoders: dict[str, object] = {}


def encoder(path: str):
    """text -> uint32 ids, as the file's byte-level BPE gives them without added special tokens.

    tiktoken runs the same vocabulary several times as fast; texts that hold one
    of the file's special strings go to the tokenizers library.
    """
    if path not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(byte_of[x] for x in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow = Tokenizer.from_file(path)

        def encode(text: str) -> np.ndarray:
            if any(s in text for s in special):
                return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            return fast.encode_to_numpy(text, disallowed_special=())

        _encoders[path] = encode
    return _encoders[path]


def token_pieces(docs: DataFrame, size: int = 1024, tokenizer: str | None = None, end: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the pieces of each document's ids with the end id."""
    path = tokenizer or default_tokenizer()

    def rows(batches):
        encode = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(t or ""), np.uint32(end)).astype("<u4")
                data = memoryview(ids).cast("B")
                out += [(d, a, min(size, len(ids) - a), zlib.crc32(data[4 * a : 4 * (a + size)]), len(ids)) for a in range(0, len(ids), size)]
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(c.lean(rows), PIECES)


def patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs as (lengths, how many), by shortest-pack-first with the longest lengths first."""
    open_: dict[int, list[list]] = defaultdict(list)  # by how full
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fits = [s for s in open_ if s + length <= size]
            if not fits:
                open_[length].append([(length,), left])
                break
            short = min(fits)
            pack = open_[short][-1]
            n = min(left, pack[1])
            open_[short + length].append([(*pack[0], length), n])
            pack[1] -= n
            left -= n
            if not pack[1]:
                open_[short].pop()
                if not open_[short]:
                    del open_[short]
    total: dict[tuple[int, ...], int] = defaultdict(int)
    for packs in open_.values():
        for lengths, n in packs:
            total[lengths] += n
    return sorted(total.items(), reverse=True)


def slots(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) of each place in a pattern."""
    used: dict[int, int] = defaultdict(int)
    out, base = [], 0
    for lengths, n in packs:
        at = 0
        for length in lengths:
            out.append((length, used[length], used[length] + n, base, at))
            used[length] += n
            at += length
        base += n
    return out


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """pieces and sequence_id, offset. No sequence is longer than size; a sequence's pieces lie gapless from 0.

    Any number of pieces may share id, start and length; each gets a place of
    its own. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    pieces = c.checkpointed(pieces)
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most size rows
    salts = max(64, sum(histogram.values()) // 1_000_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = salted.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start")) - 1).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    places = spark.createDataFrame(slots(patterns(histogram, size)), "length long, lo long, hi long, base long, offset long")  # a few thousand rows, set by the histogram
    return (
        ranked.join(F.broadcast(places), "length")
        .where("rank >= lo and rank < hi")
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
    )


def pack_documents(docs: DataFrame, size: int = 1024, tokenizer: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and offset. Null and empty texts are the end id alone; a null id is kept."""
    return pack(token_pieces(docs, size, tokenizer, 0, id, text), size)
