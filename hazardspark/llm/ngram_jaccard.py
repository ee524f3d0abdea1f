"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Two documents link when 100 * |A & B| >= percent * |A | B| over their sets of
distinct word n-grams. The product is never formed whole:

1. A sketch of document frequencies, of at most 2**MOST_BITS cells, orders all n-grams, rare first.
   With s grams in a set, a linked pair shares one of the first
   s - ceil(percent / 100 * s) + 1 of either; only this part of the incidence
   matrix is dealt out, in column blocks. The sketch orders, so its errors
   cost time and lose nothing.
2. In a column block, pairs that share a gram are kept only if their sizes and
   the places of the gram leave room for enough overlap. What leaves a block is
   a spanning forest of these pairs, a row for each document at most. A gram
   that the sketch calls very frequent (HOT documents beyond eight times the mean of a cell) is joined batch by batch in the map
   tasks, so no task gathers all its documents: a batch sends a head with the
   range of sizes behind it, and heads meet where their ranges may link.
3. The documents of a candidate component are cut by size and, where many, by
   hash into row blocks, and each row block meets those whose sizes may link.
   First blocks of about WIDE signatures meet: parities of a set's hashes, about
   a bit for each gram. Two signatures differ in no more bits than the
   sets in grams, so a pair that differs in too many can't link and goes, and no link is lost. Only
   what is left of a component meets again, with its texts, in blocks of about TILE:
   each pair of row blocks is multiplied exactly, in strips of columns. A spanning
   forest of the pairs leaves either step.

Equal sets are one row (64-bit fingerprint) in all of this. The time grows with the
square of the largest candidate component, as it must where thousands of
different texts are near the threshold. Signatures, a fiftieth of the text, are copied for each row block
of such a component; texts only within components of sets that are alike by signature.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.llm import common as c

TILE = 512
WIDE = 1024
HOT = 4096
MOST_BITS = 24
STRIP = 2048
SIGN_BITS = 6, 15  # of a signature: powers of two, least and most
_COPY = np.uint64(0x94D049BB133111EB)


def sets(texts: list[bytes | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after another, and where each text's begin.

    A text of fewer than n words has its whole sequence as one gram; one without words has none.
    """
    w = c.Words(texts, lower=True)
    h, count = w.hashes(), np.diff(w.first)
    own = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(own, out=at[1:])
    out = np.empty(at[-1], dtype=np.uint64)
    full = c.grams(h, n)
    long_ = np.flatnonzero(count >= n)
    if len(long_):
        where = np.repeat(w.first[long_] - at[long_], own[long_])
        place = np.flatnonzero(np.repeat(count >= n, own))
        out[place] = full[place + where]
    for k in range(1, n):
        few = np.flatnonzero(count == k)
        if len(few):
            out[at[few]] = c.grams(h, k)[w.first[few]]
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a > 1:
            out[a:b].sort()
    doc = np.repeat(np.arange(len(texts)), own)
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[fresh], np.searchsorted(doc[fresh], np.arange(len(texts) + 1))


def fingerprints(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for each set, equal for equal sets."""
    total = np.zeros(len(grams) + 1, dtype=np.uint64)
    np.cumsum(c.mix(grams ^ _COPY), out=total[1:])
    return c.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64) * _COPY).view(np.int64)


def signatures(grams: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Of each set: for each place of 2**b the parity of how many hashes have it as last b bits; 2**b is at least the set's size, within SIGN_BITS."""
    size = np.diff(at)
    least, most = SIGN_BITS
    bits = np.int64(1) << np.clip(np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), least, most)
    ends = np.cumsum(bits)
    place = np.repeat(ends - bits, size) + (grams & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64)
    data = np.packbits(np.bincount(place, minlength=ends[-1] if len(ends) else 0) & 1, bitorder="little").tobytes()
    return [data[a:b] for a, b in zip((ends - bits) // 8, ends // 8, strict=True)]


def folded(signature: bytes, size: int) -> bytes:
    """The signature as one of so many bytes: parities of halves add up."""
    x = np.frombuffer(signature, dtype=np.uint8)
    return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0).tobytes()


def alike(signs: list[bytes], size: np.ndarray, percent: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, one of left and one of right, whose signatures leave room for a link: sets that link differ in at most (100 - percent) / (100 + percent) of their grams, both counted."""
    width = min(map(len, signs))
    m = np.frombuffer(b"".join(x if len(x) == width else folded(x, width) for x in signs), dtype=np.uint8).reshape(-1, width)
    same = np.zeros((len(left), len(right)), dtype=np.float32)  # bits that agree less those that differ
    for lo in range(0, width, STRIP // 16):
        one = np.unpackbits(m[:, lo : lo + STRIP // 16], axis=1).astype(np.float32) * 2 - 1
        same += one[left] @ one[right].T
    apart = (8 * width - same.astype(np.int64)) // 2
    small, large = np.minimum.outer(size[left], size[right]), np.maximum.outer(size[left], size[right])
    x, y = np.nonzero(((100 + percent) * apart <= (100 - percent) * (small + large)) & (percent * large <= 100 * small))
    x, y = left[x], right[y]
    return x[x != y], y[x != y]


def bounds(percent: int) -> tuple:
    prefix = lambda s: s - -(-percent * s // 100) + 1
    need = lambda a, b: -(-percent * (a + b) // (100 + percent))
    return prefix, need


def _each(batches, text: str = "text"):
    for whole in batches:
        for batch in c.slices(whole):
            texts = c.binary(batch.column(batch.schema.get_field_index(text)))
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            for lo, hi in c.pieces(texts):
                yield ids[lo:hi], texts[lo:hi]


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names.split())


def candidate_pairs(key: np.ndarray, node: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of nodes, of the pairs within a key that sizes and places allow."""
    _, need = bounds(percent)
    nodes, local = np.unique(node, return_inverse=True)
    order = np.lexsort((local, size, key))
    key, local, size, place = key[order], local[order], size[order], place[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (local[1:] != local[:-1])
    key, local, size, place = key[fresh], local[fresh], size[fresh].astype(np.int64), place[fresh].astype(np.int64)
    parent = np.arange(len(nodes))
    left, d = np.arange(len(key)), 1
    held: list[np.ndarray] = []
    many = 0

    def settle():
        nonlocal parent, held, many
        if held:
            pairs = np.concatenate(held, axis=1)
            own = np.flatnonzero(parent != np.arange(len(parent)))
            parent = c.forest(len(nodes), np.concatenate([pairs[0], own]), np.concatenate([pairs[1], parent[own]]))
            held, many = [], 0

    while len(left):
        left = left[left + d < len(key)]
        right = left + d
        near = (key[left] == key[right]) & (percent * size[right] <= 100 * size[left])  # by size in a key, so the next are larger still
        left, right = left[near], right[near]
        room = np.minimum(place[left], place[right]) + 1 + np.minimum(size[left] - place[left], size[right] - place[right]) - 1
        good = (room >= need(size[left], size[right])) & (parent[local[left]] != parent[local[right]])
        held.append(np.stack([local[left[good]], local[right[good]]]))
        many += int(good.sum())
        if many > 1_000_000:
            settle()
        d += 1
    settle()
    child = np.flatnonzero(parent != np.arange(len(parent)))
    return nodes[child], nodes[parent[child]]


def head_pairs(key: np.ndarray, node: np.ndarray, least: np.ndarray, most: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes that connect the heads of a key wherever sizes behind them, from least to most, may link."""
    order = np.lexsort((least, key))
    key, node, least, most = key[order], node[order], least[order].astype(np.int64), most[order].astype(np.int64)
    number = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
    upto = np.maximum.accumulate((number << 32) + most) - (number << 32)  # within a key
    near = np.flatnonzero((key[1:] == key[:-1]) & (percent * least[1:] <= 100 * upto[:-1]) & (node[1:] != node[:-1]))
    return node[near], node[near + 1]


def linked(grams: np.ndarray, at: np.ndarray, percent: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, one of left and one of right, that link: a product of 0/1 matrices in strips of columns."""
    size = np.diff(at)
    column = np.unique(grams, return_inverse=True)[1]
    often = np.bincount(column) > 1
    used = often[column]
    row, column = np.repeat(np.arange(len(size)), size)[used], (np.cumsum(often) - 1)[column[used]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((len(left), len(right)), dtype=np.float32)
    for lo in range(0, int(often.sum()), STRIP):
        a, b = np.searchsorted(column, [lo, lo + STRIP])
        m = np.zeros((len(size), min(STRIP, int(often.sum()) - lo)), dtype=np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        overlap += m[left] @ m[right].T
    total = size[left][:, None] + size[right][None, :]
    x, y = np.nonzero((100 + percent) * overlap.astype(np.int64) >= percent * total)
    x, y = left[x], right[y]
    return x[x != y], y[x != y]


def fingerprinted(docs: DataFrame, n: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, node, signature) for each row with an id: node is null for an empty set."""

    def rows(batches):
        for ids, texts in _each(batches):
            g, at = sets(texts, n)
            s = np.diff(at)
            yield _batch("doc_id n_shingles node signature", ids, s, pa.array(fingerprints(g, at), mask=s == 0), pa.array(signatures(g, at), pa.binary()))

    return docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(c.lean(rows), "doc_id long, n_shingles long, node long, signature binary")


def ngram_jaccard(docs: DataFrame, n: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of docs that has an id.

    component_id is the smallest id reachable over links, the own id included.
    Null and empty texts have no shingles and link with nothing; rows that
    repeat an id are nodes of one document; other columns of docs are not read.
    Rows without an id take no part. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    prefix, _ = bounds(percent)
    docs = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows, letters = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bits = c.bits_for(letters // 6, 8, MOST_BITS)
    shift = np.uint64(64 - bits)
    load = letters / 6 / (1 << bits)  # grams a cell: past 2**MOST_BITS cells it grows, and what is very frequent with it
    scale = max(0, math.ceil(math.log2(max(load, 1) / 512)))
    hot_at = min(65535, math.ceil((HOT + 8 * load) / (1 << scale)))

    def sketch(batches):
        cells = [np.empty(0, dtype=np.uint64)]
        for _, texts in _each(batches):
            cells.append(sets(texts, n)[0] >> shift)
            if sum(map(len, cells)) > 3_000_000:
                yield c.sketch_rows(np.concatenate(cells).astype(np.int64))
                cells = []
        if cells:
            yield c.sketch_rows(np.concatenate(cells).astype(np.int64))

    frequency = spark.sparkContext.broadcast(c.merged_sketch(docs.mapInArrow(c.lean(sketch), c.SKETCH_SCHEMA), bits, scale=scale))
    blocks = max(c.width(docs), math.ceil(letters / 6 * (100 - percent) / 100 / 1_000_000))

    def incidence(batches):
        """Packed rows of a column block; block -1: pairs of nodes that share a very frequent gram."""
        for batch in batches:
            parts, seen = [], set()
            for _, texts in _each([batch]):
                g, at = sets(texts, n)
                node, size = fingerprints(g, at), np.diff(at)
                key = (frequency.value[g >> shift].astype(np.uint64) << np.uint64(48)) | (g >> np.uint64(16))
                first = [i for i, x in enumerate(node.tolist()) if size[i] and not (x in seen or seen.add(x))]  # equal sets once
                for i in first:
                    key[at[i] : at[i + 1]].sort()
                take = np.zeros(len(size), dtype=np.int64)
                take[first] = prefix(size[first])
                which = np.repeat(np.arange(len(size)), take)
                place = np.arange(len(which)) - np.repeat(np.cumsum(take) - take, take)
                parts.append((key[at[which] + place], node[which], size[which].astype(np.uint32), place.astype(np.uint32)))
            if not parts:
                continue
            key, node, size, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            hot = np.flatnonzero((key >> np.uint64(48)) >= hot_at)
            if len(hot):  # in this batch the documents of a very frequent gram hang on the smallest of them, anew where sizes leave a gap that no link crosses
                order = hot[np.lexsort((node[hot], size[hot], key[hot]))]
                sizes = size[order].astype(np.int64)
                starts = np.flatnonzero(np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (percent * sizes[1:] > 100 * sizes[:-1])]))
                head = np.repeat(order[starts], np.diff([*starts, len(order)]))
                local = np.unique(np.concatenate([node[order], node[head]]), return_inverse=True)
                half = len(order)
                parent = c.forest(len(local[0]), local[1][:half], local[1][half:])
                child = np.flatnonzero(parent != np.arange(len(parent)))
                yield _batch("block data", pa.array([-1], pa.int32()), [np.stack([local[0][child], local[0][parent[child]]]).tobytes()])
                keep = np.ones(len(key), dtype=bool)
                keep[order] = False
                keep[order[starts]] = True
                place[order[starts]] = size[order[np.append(starts[1:], len(order)) - 1]]  # a head stands for sizes from its own to this
                key, node, size, place = key[keep], node[keep], size[keep], place[keep]
            block = (c.mix(key) % np.uint64(blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            cut = np.searchsorted(block[order], np.arange(blocks + 1))
            ids = np.flatnonzero(np.diff(cut)).astype(np.int32)
            data = [b"".join(x[order[cut[i] : cut[i + 1]]].tobytes() for x in (key, node, size, place)) for i in ids]
            yield _batch("block data", ids, pa.array(data, pa.binary()))

    def pairs(tab: pa.Table) -> pa.Table:
        data = tab.column("data").to_pylist()
        if tab.column("block")[0].as_py() < 0:
            a, b = np.concatenate([np.frombuffer(x, dtype=np.int64).reshape(2, -1) for x in data], axis=1)
        else:
            parts = []
            for x in data:
                m = len(x) // 24
                parts.append((np.frombuffer(x, np.uint64, m), np.frombuffer(x, np.int64, m, 8 * m), np.frombuffer(x, np.uint32, m, 16 * m), np.frombuffer(x, np.uint32, m, 20 * m)))
            rows = [np.concatenate(x) for x in zip(*parts, strict=True)]
            hot = rows[0] >> np.uint64(48) >= hot_at
            found = candidate_pairs(*(x[~hot] for x in rows), percent), head_pairs(*(x[hot] for x in rows), percent)
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"a": a, "b": b})

    part = docs.mapInArrow(c.lean(incidence), "block int, data binary")
    spread = part.withColumn("salt", F.when(F.col("block") < 0, (F.rand(7) * c.width(docs)).cast("int")).otherwise(0))
    near = c.components(spread.groupBy("block", "salt").applyInArrow(c.lean_group(pairs), "a long, b long"))

    # row blocks of each candidate component
    base = math.log(100 / percent)
    whole = c.checkpointed(fingerprinted(docs, n))
    reps = whole.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("s"))
    binned = F.col("component").alias("comp"), F.floor(F.log("s") / F.lit(base) + 1e-9).cast("int").alias("bin")
    groups = c.width(docs) * 4

    def compare(tab: pa.Table) -> pa.Table:
        tab = tab.combine_chunks()
        group = np.unique(np.stack([tab.column(x).to_numpy() for x in ("comp", "bin", "x", "y")]), axis=1, return_inverse=True)[1].ravel()
        node, size, is_left, signs = tab.column("node").to_numpy(), tab.column("s").to_numpy(), tab.column("is_left").to_numpy(zero_copy_only=False), tab.column("signature")
        order = np.argsort(group, kind="stable")
        a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            nodes, first, row = np.unique(node[part], return_index=True, return_inverse=True)
            if len(nodes) > 1:
                left, right = np.unique(row[is_left[part]]), np.unique(row[~is_left[part]])
                x, y = alike(signs.take(part[first]).to_pylist(), size[part[first]], percent, left, right)
                parent = c.forest(len(nodes), x, y)
                child = np.flatnonzero(parent != np.arange(len(parent)))
                a.append(nodes[child])
                b.append(nodes[parent[child]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    signed = c.checkpointed(reps.join(near, "node").select("doc_id", "node", "s", *binned))
    signed = c.row_blocks(signed, ["comp"], "bin", "node", WIDE).join(whole.select("doc_id", "node", "signature"), ["doc_id", "node"])
    signed = signed.withColumn("g", F.pmod(F.xxhash64("comp", "bin", "x", "y"), F.lit(max(groups, rows // 2000))))
    near = c.components(signed.groupBy("g").applyInArrow(c.lean_group(compare), "a long, b long"))
    active = c.checkpointed(reps.join(near, "node").select("doc_id", *binned))
    placed = c.row_blocks(active, ["comp"], "bin", "doc_id", TILE)
    member = np.uint64(64 - 25)

    def cells(batches):
        for batch in batches:
            yield c.sketch_rows((c.mix(batch.column(0).to_numpy().view(np.uint64)) >> member).astype(np.int64))

    present = spark.sparkContext.broadcast(c.merged_sketch(active.select("doc_id").mapInArrow(c.lean(cells), c.SKETCH_SCHEMA), 25, at_least=1))

    def wanted(batches):
        """Drop most documents that are in no candidate component before the text is shuffled; the join drops the rest."""
        for batch in batches:
            cell = (c.mix(batch.column(0).to_numpy().view(np.uint64)) >> member).astype(np.int64)
            yield batch.filter(pa.array((present.value[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1))

    def verify(tab: pa.Table) -> pa.Table:
        tab = tab.combine_chunks()
        group = np.unique(np.stack([tab.column(x).to_numpy() for x in ("comp", "bin", "x", "y")]), axis=1, return_inverse=True)[1].ravel()
        ids, is_left, texts = tab.column("doc_id").to_numpy(), tab.column("is_left").to_numpy(zero_copy_only=False), c.binary(tab.column("text"))
        order = np.argsort(group, kind="stable")
        a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            docs_, first, row = np.unique(ids[part], return_index=True, return_inverse=True)
            if len(docs_) > 1:
                g, at = sets([texts[i] for i in part[first]], n)
                left, right = np.unique(row[is_left[part]]), np.unique(row[~is_left[part]])
                x, y = linked(g, at, percent, left, right)
                parent = c.forest(len(docs_), x, y)
                child = np.flatnonzero(parent != np.arange(len(parent)))
                a.append(docs_[child])
                b.append(docs_[parent[child]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    text_of = docs.mapInArrow(c.lean(wanted), "doc_id long, text string").dropDuplicates(["doc_id"])
    work = placed.join(text_of, "doc_id").withColumn("g", F.pmod(F.xxhash64("comp", "bin", "x", "y"), F.lit(max(groups, rows // 2000))))
    links = work.groupBy("g").applyInArrow(c.lean_group(verify), "a long, b long")
    found = c.components(links).withColumnRenamed("node", "rep")
    return (
        whole.drop("signature").join(reps.select("node", F.col("doc_id").alias("rep")), "node", "left")
        .join(found, "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    )
