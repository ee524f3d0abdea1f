"""Suffix-array dedup: bytes in strings of `size` bytes that start anywhere else, too, are found by external induced sorting.

A window is `size` bytes of one text. Its anchor is the least hash of the runs of about a
quarter of it; equal windows have equal anchors, so what repeats meets in one shard, and
no match is lost. Neighbouring windows mostly share an anchor: they are one segment, the bytes
that they cover. Three shuffles follow, each of packed rows:

1. anchors are grouped; an anchor that occurs once holds no repeated window and goes;
2. the segments of the others are cut from the texts and dealt to shards by anchor. In a shard equal segments are one with a
   weight, and all segments of anchors that have different ones are joined to a text of which the suffixes are sorted, see
   induced_sort. Windows that share `size` bytes stand side by side;
3. repeated windows go back to their texts as runs of starts.

A map task sends equal anchors, and equal segments, once: the others are known to repeat. So a group of very many copies is a row
for each task. Anchors of more than a set share of all places are few, are broadcast, and are parted
by a second anchor, so that a common line in very many different contexts is spread.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.llm import common as c
from hazardspark.llm import induced_sort

ANCHOR = np.dtype([("key", "<u8"), ("doc", "<i8"), ("part", "<u4"), ("start", "<u4"), ("many", "<u4"), ("times", "u1")])
SEGMENT = np.dtype([("key", "<u8"), ("doc", "<i8"), ("part", "<u4"), ("start", "<u4"), ("weight", "<u4"), ("length", "<u4")])
RUN = np.dtype([("doc", "<i8"), ("part", "<u4"), ("start", "<u4"), ("many", "<u4")])
FLUSH = 400_000
FLUSH_BYTES = 24 << 20
SHARD_BYTES = 2 << 20
HOT_LEAST, HOT_MOST = 20_000, 1 << 20
MOST = np.uint64(2**64 - 1)


def sliding(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w in a row."""
    n = len(x)
    padded = np.full(-(-n // w) * w, MOST)
    padded[:n] = x
    block = padded.reshape(-1, w)
    up = np.minimum.accumulate(block, axis=1).ravel()
    down = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[: n - w + 1], up[w - 1 : n])


def grams(buf: np.ndarray, k: int) -> np.ndarray:
    up, down = c.powers(c._BASE, len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return c.mix((total[k:] - total[:-k]) * down[: len(buf) - k + 1])


def runs_of(value: np.ndarray, usable: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of equal values among usable places; none is longer than most, or goes on past a fresh place."""
    begins = usable & fresh
    begins[:1] = usable[:1]
    begins[1:] |= usable[1:] & ((value[1:] != value[:-1]) | ~usable[:-1])
    start = np.flatnonzero(begins)
    many = np.flatnonzero(usable & np.append(~usable[1:] | begins[1:], True)) + 1 - start
    if len(many) and many.max() > most:
        cut = -(-many // most)
        k = np.arange(int(cut.sum())) - np.repeat(np.cumsum(cut) - cut, cut)
        start, stop = np.repeat(start, cut) + k * most, np.repeat(start + many, cut)
        many = np.minimum(most, stop - start)
    return start, many


class Anchors:
    def __init__(self, size: int):
        self.size, self.gram = size, max(1, size // 4)
        self.most = size - self.gram + 1

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(key, text, start in it, windows, times) of the segments of some texts; times is 2 where the anchor is twice or more in the segment, else 1."""
        buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
        if len(buf) < self.size:
            return np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 4
        h = grams(buf, self.gram)
        least = sliding(h, self.most)
        length = np.array([len(t) for t in texts])
        end = np.cumsum(length)
        usable = np.zeros(len(buf) + 1, dtype=np.int8)
        fit = np.flatnonzero(length >= self.size)
        np.add.at(usable, end[fit] - length[fit], 1)
        np.add.at(usable, end[fit] - self.size + 1, -1)
        usable = np.cumsum(usable[: len(least)]) > 0
        fresh = np.zeros(len(buf) + 1, dtype=bool)
        fresh[end] = True
        start, many = runs_of(least, usable, fresh[: len(least)], self.most)
        text = np.searchsorted(end, start, side="right")
        key = least[start]
        return key, text, start - (end - length)[text], many, self.times(h, key, start, start + many + self.most - 1)

    def times(self, h: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """2 where h[low:high] has the key more than once, else 1: only there can a window repeat within its segment."""
        cells = np.zeros(1 << 20, dtype=bool)
        cells[key >> np.uint64(44)] = True
        at = np.flatnonzero(cells[h >> np.uint64(44)])
        at = at[np.lexsort((at, h[at]))]
        value = h[at]
        group = np.cumsum(np.diff(value, prepend=value[:1]) != 0)
        place = group * (len(h) + 1) + at
        own = group[np.searchsorted(value, key)] * (len(h) + 1) if len(key) else key.astype(np.int64)
        return 1 + (np.searchsorted(place, own + high) - np.searchsorted(place, own + low) > 1)

    def second(self, data: bytes, key: int) -> list[tuple[int, int, int]]:
        """(key, start, windows) of a segment by the least hash but that of its anchor."""
        h = grams(np.frombuffer(data, np.uint8), self.gram)
        other = c.mix(h ^ np.uint64(0x5851F42D4C957F2D))
        other[h == np.uint64(key)] = MOST
        least = sliding(other, self.most)
        start, many = runs_of(least, np.ones(len(least), dtype=bool), np.zeros(len(least), dtype=bool), self.most)
        return list(zip(c.mix(least[start] ^ np.uint64(key)).tolist(), start.tolist(), many.tolist(), strict=True))


def _packed(items: np.ndarray, bucket: np.ndarray, name: str) -> pa.RecordBatch:
    """Items, by bucket, as bytes; a column of the record after the other, which compresses."""
    order = np.argsort(bucket, kind="stable")
    items, bucket = items[order], bucket[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-(1 << 40)))
    data = [_columns(items[a:b]) for a, b in zip(cut, np.append(cut[1:], len(items))[: len(cut)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), pa.array(data, pa.binary())], names=[name, "data"])


def _columns(items: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(items[f]).tobytes() for f in items.dtype.names)


def _items(data: list[bytes], dtype: np.dtype) -> np.ndarray:
    out = []
    for x in data:
        n = len(x) // dtype.itemsize
        own, at = np.empty(n, dtype), 0
        for f in dtype.names:
            own[f] = np.frombuffer(x, dtype[f], n, at)
            at += n * dtype[f].itemsize
        out.append(own)
    return np.concatenate(out) if out else np.empty(0, dtype)


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return (c.mix(key.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _texts(batches, rows: int = 500):
    for whole in batches:
        for batch in c.slices(whole, rows):
            doc, part, texts = batch.column("doc").to_numpy(), batch.column("part").to_numpy(), [t or b"" for t in c.binary(batch.column("text"))]
            for lo, hi in c.pieces(texts):
                yield doc[lo:hi], part[lo:hi], texts[lo:hi]


def squeezed(rows: DataFrame) -> DataFrame:
    """rows with text as compressed bytes, for a shuffle; null stays null."""

    names = rows.columns

    def squeeze(batches):
        tool = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for batch in c.slices(whole):
                columns = {name: batch.column(name) for name in names}
                columns["text"] = pa.array([None if t is None else tool.compress(t) for t in c.binary(batch.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kinds = ", ".join(f"{f.name} {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(c.lean(squeeze), kinds)


def _repeated_anchors(rows: DataFrame, anchors: Anchors, buckets: int, least: int) -> DataFrame:
    """(bucket, data, hot): segments whose anchor occurs again, by bucket of their document; in bucket -1 the anchors met more than least times."""

    def local(batches):
        held, many = [], 0

        def flush():
            items = np.concatenate(held)
            items = items[np.argsort(items["key"], kind="stable")]
            new = np.ones(len(items), dtype=bool)
            new[1:] = items["key"][1:] != items["key"][:-1]
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(items)))
            times = np.add.reduceat(items["times"].astype(np.int64), first)
            again = np.repeat(times > 1, size)
            yield _packed(items[again], -2 - _bucket(items["doc"][again], buckets), "shard")
            send = items[first].copy()
            told = times > 1  # the segments themselves are on their way: start and many hold how many there were
            send["start"][told], send["many"][told] = np.minimum(times[told], 2**32 - 1), 0
            yield _packed(send, _bucket(send["key"], buckets), "shard")

        for doc, part, texts in _texts(batches):
            key, text, start, n, times = anchors.of(texts)
            items = np.empty(len(key), ANCHOR)
            for name, x in zip(ANCHOR.names, (key, doc[text], part[text], start, n, times), strict=True):
                items[name] = x
            held.append(items)
            many += len(items)
            if many > FLUSH:
                yield from flush()
                held.clear()
                many = 0
        if many:
            yield from flush()

    def settle(tab: pa.Table) -> pa.Table:
        shard, data = tab.column("shard")[0].as_py(), tab.column("data").to_pylist()
        if shard < 0:
            return pa.table({"bucket": pa.array([-2 - shard] * len(data), pa.int32()), "data": pa.array(data, pa.binary()), "hot": pa.array([b""] * len(data), pa.binary())})
        items = _items(data, ANCHOR)
        items = items[np.argsort(items["key"], kind="stable")]
        first = np.flatnonzero(np.diff(items["key"], prepend=~items["key"][:1]) != 0)
        own = items["many"] > 0
        times = np.add.reduceat(np.where(own, items["times"], items["start"].astype(np.int64)), first)
        size = np.diff(np.append(first, len(items)))
        keep = items[own & np.repeat(times > 1, size)]
        batch = _packed(keep, _bucket(keep["doc"], buckets), "bucket")
        hot = items["key"][first][times > least]
        return pa.table({"bucket": pa.concat_arrays([batch.column(0), pa.array([-1], pa.int32())]), "data": pa.concat_arrays([batch.column(1), pa.array([b""], pa.binary())]), "hot": pa.array([b""] * batch.num_rows + [hot.tobytes()], pa.binary())})

    return rows.mapInArrow(c.lean(local), "shard int, data binary").groupBy("shard").applyInArrow(c.lean_group(settle), "bucket int, data binary, hot binary")


def _by_text(found: DataFrame, dtype: np.dtype) -> DataFrame:
    """(doc, part, items): packed items by text."""

    def gather(tab: pa.Table) -> pa.Table:
        items = _items(tab.column("data").to_pylist(), dtype)
        items = items[np.lexsort((items["start"], items["part"], items["doc"]))]
        new = np.ones(len(items), dtype=bool)
        new[1:] = (items["doc"][1:] != items["doc"][:-1]) | (items["part"][1:] != items["part"][:-1])
        cut = np.flatnonzero(new)
        return pa.table({"doc": items["doc"][cut], "part": items["part"][cut].astype(np.int64), "items": pa.array([_columns(items[a:b]) for a, b in zip(cut, np.append(cut[1:], len(items))[: len(cut)], strict=True)], pa.binary())})

    return found.groupBy("bucket").applyInArrow(c.lean_group(gather), "doc long, part long, items binary")


def _segments(marked: DataFrame, anchors: Anchors, hot, shards: int, buckets: int) -> DataFrame:
    """Segments by shard of their anchor, and (shard -2 - bucket) runs of windows that this task's own rows repeat."""

    def cut(batches):
        held, size, read = {}, 0, zstandard.ZstdDecompressor()

        def flush():
            known = [(o, n) for owners, n, _ in held.values() if len(owners) > 1 for o in owners]
            if known:
                runs = np.array([(d, p, s, n) for (d, p, s), n in known], RUN)
                yield _packed(runs, -2 - _bucket(runs["doc"], buckets), "shard")
            items, texts = np.zeros(len(held), SEGMENT), []
            for i, ((key, _), (owners, _, own)) in enumerate(held.items()):
                items[i] = (key, *(owners[0] if len(owners) == 1 else (0, 0, 0)), len(owners), len(own))
                texts.append(own)
            at, tool = _bucket(items["key"], shards), zstandard.ZstdCompressor(level=3)
            order = np.argsort(at, kind="stable")
            cut = np.flatnonzero(np.diff(at[order], prepend=-1))
            for part in np.split(order, cut[1:]):
                data = tool.compress(np.int64(len(part)).tobytes() + _columns(items[part]) + b"".join([texts[i] for i in part]))
                yield pa.RecordBatch.from_arrays([pa.array([at[part[0]]], pa.int32()), pa.array([data], pa.binary())], names=["shard", "data"])

        for whole in batches:
            for batch in c.slices(whole, 100):
                for doc, part, text, data in zip(batch.column("doc").to_pylist(), batch.column("part").to_pylist(), c.binary(batch.column("text")), batch.column("items").to_pylist(), strict=True):
                    items, text = _items([data], ANCHOR), read.decompress(text)
                    for key, start, many in zip(items["key"].tolist(), items["start"].tolist(), items["many"].tolist(), strict=True):
                        piece = text[start : start + many + anchors.size - 1]
                        for k, s, n in anchors.second(piece, key) if key in hot.value else ((key, 0, many),):
                            own = piece[s : s + n + anchors.size - 1]
                            got = held.setdefault((k, hashlib.blake2b(own, digest_size=16).digest()), ([], n, own))
                            if not got[0]:
                                size += len(own)
                            got[0].append((doc, part, start + s))
                    if size > FLUSH_BYTES:
                        yield from flush()
                        held, size = {}, 0
        if held:
            yield from flush()

    return marked.mapInArrow(c.lean(cut), "shard int, data binary")


def _sorted_shards(dealt: DataFrame, size: int, buckets: int) -> DataFrame:
    """Runs of repeated windows by bucket of their document; a task streams its shard to disk and sorts it there."""

    def sort(batches):
        with induced_sort.scratch() as path:
            folder, read = induced_sort.Folder(path), zstandard.ZstdDecompressor()
            spool, seen, anchor = folder.name(), {}, {}
            where, owner = [], []  # of each text: offset, length, weight, key; of each owner: text, document, part, start
            with open(spool, "wb") as out:
                for batch in batches:
                    yield from passed(batch)
                    for shard, packed in zip(batch.column("shard").to_pylist(), batch.column("data").to_pylist(), strict=True):
                        if shard < 0:
                            continue
                        plain = read.decompress(packed)
                        n = int(np.frombuffer(plain, np.int64, 1)[0])
                        at = 8 + n * SEGMENT.itemsize
                        for key, doc, part, start, weight, length in _items([plain[8:at]], SEGMENT).tolist():
                            data = plain[at : at + length]
                            at += length
                            mark = (key, hashlib.blake2b(data, digest_size=16).digest())
                            own = seen.get(mark)
                            if own is None:
                                own = seen[mark] = len(where)
                                where.append([out.tell(), length, 0, key])
                                out.write(data)
                                anchor[key] = anchor.get(key, 0) + 1
                            where[own][2] += weight
                            if weight == 1:
                                owner.append((own, doc, part, start))
            if not where:
                return
            seen.clear()
            table = np.array([(o, n, w, anchor[k] > 1 or w < 2) for o, n, w, k in where], dtype=np.int64)
            del where, anchor
            hits = repeats(spool, table, size, folder)
            own = np.array(owner, dtype=np.int64).reshape(-1, 4)
            del owner
            for lo in range(0, len(own), 100_000):
                runs = []
                for at, doc, part, start in own[lo : lo + 100_000].tolist():
                    o, n, w, sort_ = table[at]
                    if not sort_:
                        runs.append((doc, part, start, n - size + 1))
                        continue
                    hit = hits(at)
                    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                    runs += [(doc, part, start + a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                if runs:
                    runs = np.array(runs, RUN)
                    yield _packed(runs, _bucket(runs["doc"], buckets), "bucket")
            del hits

    def passed(batch):
        known = batch.filter(pc.less(batch.column("shard"), 0))
        if known.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([-2 - x for x in known.column("shard").to_pylist()], pa.int32()), known.column("data")], names=["bucket", "data"])

    return dealt.mapInArrow(c.lean(sort), "bucket int, data binary")


def repeats(spool: str, table: np.ndarray, size: int, folder: induced_sort.Folder):
    """A function from a text's number to which of its windows repeat, for the texts of the spool that are to be sorted. table: offset, length, weight, sorted."""
    chosen = np.flatnonzero(table[:, 3])
    length = table[chosen, 1]
    first = np.concatenate([[0], np.cumsum(length)])
    n = int(first[-1])
    text = folder.array(n + 17, np.uint8)
    raw = np.memmap(spool, np.uint8, mode="r")
    for (o, m, _, _), at in zip(table[chosen].tolist(), first[:-1].tolist(), strict=True):
        text[8 + at : 8 + at + m] = raw[o : o + m] + 1
    hit = folder.array(max(n, 1), bool)
    last = folder.array(max(n, 1), np.uint8)  # 0: no window of its own starts here, else its weight, 2 for more
    for at, m, w in zip(first[:-1].tolist(), length.tolist(), table[chosen, 2].tolist(), strict=True):
        last[at : at + m - size + 1] = min(w, 2)
    held: list[np.ndarray] = []
    total = 0

    def close():
        if total > 1:
            for p in held:
                hit[p] = True

    for pos, shared in induced_sort.suffixes(text, folder, size):
        part = np.flatnonzero(shared < size)
        inside = pos < n
        weight = np.where(inside, last[np.minimum(pos, max(n - 1, 0))], 0).astype(np.int64) if n else np.zeros(len(pos), np.int64)
        if not len(part):
            held.append(pos[weight > 0])
            total += int(weight.sum())
            continue
        a, b = int(part[0]), int(part[-1])
        held.append(pos[:a][weight[:a] > 0])
        total += int(weight[:a].sum())
        close()
        if b > a:
            sums = np.add.reduceat(weight[a:b], part[:-1] - a)
            many = np.repeat(sums, np.diff(part))
            hit[pos[a:b][(many > 1) & (weight[a:b] > 0)]] = True
        held, total = [pos[b:][weight[b:] > 0]], int(weight[b:].sum())
    close()
    place = {int(t): k for k, t in enumerate(chosen)}
    return lambda at: hit[first[place[at]] : first[place[at]] + table[at, 1] - size + 1]


def repeated_spans(docs: DataFrame, size: int = 200) -> DataFrame:
    """(doc, part, items): runs of starts of repeated windows, as packed RUN; docs: doc long, part long, text."""
    spark, anchors = docs.sparkSession, Anchors(size)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(c.width(docs), math.ceil(total / (size / 2) / 150_000))
    least = max(HOT_LEAST, total // HOT_MOST)  # so fewer than HOT_MOST are met more often, whatever the input
    marks = c.stored(_repeated_anchors(docs, anchors, buckets, least))
    keys = {k for r in marks.where("bucket = -1 and octet_length(hot) > 0").select("hot").toLocalIterator() for k in np.frombuffer(r[0], np.uint64).tolist()}
    sent = spark.sparkContext.broadcast(keys)
    marks = marks.where("bucket >= 0").select("bucket", "data")
    held = marks.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    letters = held // ANCHOR.itemsize * (size * 3 // 2)
    shards = max(c.width(docs), math.ceil(letters / SHARD_BYTES))
    marked = squeezed(docs).join(_by_text(marks, ANCHOR), ["doc", "part"])
    dealt = _segments(marked, anchors, sent, shards, buckets).repartition(shards, "shard")
    return _by_text(_sorted_shards(dealt, size, buckets), RUN)


def suffix_dedup(docs: DataFrame, size: int = 200, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): spans are the maximal runs (start, end) of bytes that go, kept the others, as binary.

    A byte goes if a string of size bytes that covers it starts anywhere else, in
    the same text or another; strings are judged on the input. Texts are UTF-8; null is empty, and texts shorter than size
    lose nothing. Rows that repeat an id, with the same or another text, and rows without an id are texts of their own: what they share repeats.
    An empty table gives no row.
    """
    kind = docs.schema[id].dataType.simpleString()
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("own_id"), F.coalesce(F.col(id).cast("long"), F.xxhash64(content)).alias("doc"), F.crc32(F.concat(F.when(F.col(id).isNull(), "-").otherwise("+"), content)).alias("part"), content.alias("text"))
    spans = repeated_spans(rows.select("doc", "part", "text"), size)

    def cut(batches):
        read = zstandard.ZstdDecompressor()
        for whole in batches:
            for batch in c.slices(whole, 500):
                n, spans_, kept = [], [], []
                for t, data in zip(map(read.decompress, c.binary(batch.column("text"))), batch.column("items").to_pylist(), strict=True):
                    runs = _items([data], RUN) if data else np.empty(0, RUN)
                    edge = np.zeros(len(t) + 1, dtype=np.int32)
                    np.add.at(edge, runs["start"].astype(np.int64), 1)
                    np.add.at(edge, runs["start"].astype(np.int64) + runs["many"].astype(np.int64) + size - 1, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                    n.append(len(t))
                    spans_.append([{"start": a, "end": b} for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)])
                    kept.append(t if not len(runs) else np.frombuffer(t, np.uint8)[~gone].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("own_id"), pa.array(n, pa.int64()), pa.array(spans_, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return squeezed(rows).join(spans, ["doc", "part"], "left").select("own_id", "text", "items").mapInArrow(c.lean(cut), f"doc_id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
