"""Phrase collocation mining by dynamic itemset counting.

The texts are written once as `shards` tables, which are scanned in turn, again
and again. Words are counted from the first scan on. A longer phrase becomes
active in the scan after both its subphrases (without its last and without its
first word) have reached the threshold, and is counted for one full cycle from
there, whatever shard that begins with; so all lengths are counted in the same scans.
Which phrases have reached it, and when, is all that a scan needs to
know: activity follows from these times, and equal phrases are active in
the same scans everywhere.

Counters live in a table of packed rows, one for each range of keys, and are
merged after each scan. A key is a 64-bit hash of language and words. Phrases that end their cycle below the threshold go. The
list of reached phrases is broadcast in parts of at most LIST entries; with
several parts a scan is repeated for each pair of parts, prefixes from one and suffixes from the other.
Strings are only fetched for the phrases that are left at the end.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.llm import common as c

BREAK = np.zeros(256, dtype=bool)
BREAK[[9, 10, 11, 12, 13, 32, *b".,;:!?"]] = True
PIECE = BREAK.copy()
PIECE[[9, 32]] = False
LIST = 1 << 22
FLUSH = 3_000_000
NEVER = np.int32(1 << 30)
PACKED = "bucket int, data binary"
ITEM = np.dtype([("key", "<u8"), ("count", "<i8"), ("start", "<i4"), ("reach", "<i4"), ("k", "u1")])


def salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Grams:
    """The words of some texts of one language each, and keys of their phrases."""

    def __init__(self, texts: list[bytes | None], langs: list[str]):
        self.w = c.Words(texts, lower=True, space=BREAK)
        self.h = self.w.hashes()
        raw = np.frombuffer(self.w.raw, dtype=np.uint8)
        many = np.diff(self.w.first)
        self.doc = np.repeat(np.arange(len(texts)), many)
        known = {x: salt(x) for x in set(langs)}
        self.salts = np.array([known[x] for x in langs], dtype=np.uint64)
        self.salt, self.many = self.salts[self.doc], many
        start, end = self.w.start, self.w.end
        cut = np.ones(len(start), dtype=bool)  # a word begins a piece if a mark is in the gap before it
        cut[1:] = PIECE[raw[end[:-1]]] | PIECE[raw[start[1:] - 1]]
        wide = np.flatnonzero(~cut[1:] & (start[1:] - end[:-1] > 2)) + 1
        if len(wide):
            marks = np.flatnonzero(PIECE[raw])
            cut[wide] = np.searchsorted(marks, start[wide]) > np.searchsorted(marks, end[wide - 1])
        self.piece = np.cumsum(cut) + self.doc  # grows from text to text, too

    def keys(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The key of the k words from each place that has so many, and whether they are in one piece."""
        n = len(self.h) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        if k == 1:
            return self.h ^ self.salt, np.ones(n, dtype=bool)
        return c.grams(self.h, k) ^ self.salt[:n], (self.piece[:n] == self.piece[k - 1 :]) & (self.doc[:n] == self.doc[k - 1 :])

    def phrase(self, at: int, k: int) -> str:
        return b" ".join([self.w.buf[self.w.start[i] : self.w.end[i]].tobytes() for i in range(at, at + k)]).decode()


def _chunks(batches):
    for whole in batches:
        for batch in c.slices(whole, 500):
            langs, texts = batch.column("lang").to_pylist(), c.binary(batch.column("text"))
            for lo, hi in c.pieces(texts):
                yield Grams(texts[lo:hi], langs[lo:hi])


class Reached:
    """Sorted keys with the scan after which each had reached the threshold."""

    def __init__(self, keys: np.ndarray, times: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], times[order]
        self.shift = np.uint64(64 - max(12, int(len(keys) * 8).bit_length()))
        self.cells = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.cells[self.keys >> self.shift] = True

    def times(self, asked: np.ndarray, among: np.ndarray) -> np.ndarray:
        out = np.full(len(asked), NEVER, dtype=np.int32)
        near = np.flatnonzero(among & self.cells[asked >> self.shift])
        if len(near) and len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, asked[near]), len(self.keys) - 1)
            hit = self.keys[place] == asked[near]
            out[near[hit]] = self.at[place[hit]]
        return out


def _lists(data: tuple, levels: int) -> list[Reached]:
    keys, times, k = data
    return [Reached(keys[k == i], times[k == i]) for i in range(1, levels + 1)]


def _rows(items: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Items sorted by key, packed by range of keys."""
    bucket = ((items["key"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    ids = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([items[cut[i] : cut[i + 1]].tobytes() for i in ids], pa.binary())], names=["bucket", "data"])


def _summed(items: np.ndarray) -> np.ndarray:
    """One item a key: counts added, the earliest time of reaching kept; start and k are the same for all of a key."""
    items = items[np.argsort(items["key"])]
    first = np.flatnonzero(np.diff(items["key"], prepend=~items["key"][:1]) != 0) if len(items) else np.empty(0, np.int64)
    out = items[first].copy()
    if len(items):
        out["count"] = np.add.reduceat(items["count"], first)
        out["reach"] = np.minimum.reduceat(items["reach"], first)
    return out


def _scan(shard: DataFrame, u: int, cycle: int, longest: int, part: tuple[int, int], prefixes, suffixes, buckets: int) -> DataFrame:
    """Counts of what is active in scan u, packed."""

    def count(batches):
        before, after = (_lists(x.value, longest - 1) for x in (prefixes, suffixes))
        late = lambda x: x.at.max(initial=-1) >= u - cycle
        levels = [k for k in range(2, longest + 1) if late(before[k - 2]) or late(after[k - 2])]  # else nothing is active there

        def flush(held):
            out = []
            for (k, start), keys in held.items():
                keys = np.sort(np.concatenate(keys))  # plain keys sort much faster than with their places
                first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
                own = np.zeros(len(first), ITEM)
                own["key"], own["count"], own["start"], own["k"], own["reach"] = keys[first], np.diff(np.append(first, len(keys))), start, k, NEVER
                out.append(own)
            out = np.concatenate(out)
            return _rows(out[np.argsort(out["key"])], buckets)

        held, size, words = {}, 0, {}

        def add(keys, start, k):
            nonlocal size
            if len(keys):
                held.setdefault((k, start), []).append(keys)
                size += len(keys)

        for g in _chunks(batches):
            if u < cycle and part == (0, 0):
                add(g.keys(1)[0], 0, 1)
                for s, n in zip(g.salts.tolist(), g.many.tolist(), strict=True):
                    words[s] = words.get(s, 0) + n
            for k in levels:
                (key, _), (longer, fits) = g.keys(k - 1), g.keys(k)
                if not (m := len(longer)):
                    break
                a = before[k - 2].times(key[:m], fits)
                b = after[k - 2].times(key[1:], fits & (a < NEVER))
                start = np.maximum(a, b) + 1
                for s in range(max(1, u - cycle + 1), u + 1):
                    add(longer[start == s], s, k)
            if size > FLUSH:
                yield flush(held)
                held.clear()
                size = 0
        if held:
            yield flush(held)
        if words:
            out = np.zeros(len(words), ITEM)
            out["key"], out["count"], out["reach"] = sorted(words), [words[x] for x in sorted(words)], NEVER
            yield _rows(out, buckets)

    return shard.mapInArrow(c.lean(count), PACKED)


def _merged(state: DataFrame | None, found: DataFrame, u: int, cycle: int, least: int, buckets: int) -> DataFrame:
    """Counters after scan u; top: the latest time of reaching, many: how many have reached, by their length."""

    def merge(tab: pa.Table) -> pa.Table:
        items = _summed(np.concatenate([np.frombuffer(x, ITEM) for x in tab.column("data").to_pylist()]))
        ripe = items["count"] >= least
        items["reach"] = np.where(ripe & (items["reach"] == NEVER), u, items["reach"])
        items = items[ripe | (items["start"] + cycle - 1 > u) | (items["k"] == 0)]
        shown = (items["k"] > 0) & (items["reach"] < NEVER)
        reached = items[shown]
        return pa.table({"bucket": pa.array([tab.column("bucket")[0].as_py()], pa.int32()), "data": pa.array([items.tobytes()], pa.binary()), "reached": pa.array([reached.tobytes()], pa.binary())})

    both = found if state is None else found.unionByName(state.select("bucket", "data"))
    return both.groupBy("bucket").applyInArrow(c.lean_group(merge), f"{PACKED}, reached binary")


def _known(state: DataFrame | None, part: int, parts: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, times and lengths of the reached phrases that can be part of longer ones; of one part of all."""
    got = [np.empty(0, ITEM)]
    if state is not None:
        for row in state.select("reached").toLocalIterator():
            items = np.frombuffer(row[0], ITEM)
            got.append(items[(items["k"] < longest) & (c.mix(items["key"].copy()) % np.uint64(parts) == part)])
    items = np.concatenate(got)
    return items["key"].copy(), items["reach"].copy(), items["k"].copy()


def counted(docs: DataFrame, least: int = 100, longest: int = 5, shards: int = 4, lang: str = "lang", text: str = "text", id: str = "doc_id") -> tuple[list[DataFrame], DataFrame]:
    """The shards, and the packed counters of all phrases of up to longest words whose count is least or more, of its words, and of all words of a language (length 0)."""
    spark = docs.sparkSession
    path = f"{c.shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    own = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.pmod(F.xxhash64(F.col(id), F.lit(1)), F.lit(shards)).cast("int").alias("shard"))
    own.write.partitionBy("shard").parquet(path)
    whole = spark.read.schema("lang string, text string, shard int").parquet(path)
    letters = whole.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(c.width(docs), math.ceil(letters / 6 / 1_000_000))
    tables = [whole.where(F.col("shard") == s).select("lang", "text") for s in range(shards)]
    state, old, u, last = None, [], 0, shards - 1
    while True:  # as long as something can be active in scan u
        many, late = 0, -1
        if state is not None:
            for row in state.select("reached").toLocalIterator():
                items = np.frombuffer(row[0], ITEM)
                short = items["k"] < longest
                many += int(short.sum())
                late = max(late, int(items["reach"][short].max(initial=-1)))
            last = max(last, late + shards)
        if u > last:
            break
        parts = max(1, math.ceil(many / LIST))
        found, sent = None, []
        for i in range(parts):
            sent.append(first := spark.sparkContext.broadcast(_known(state, i, parts, longest)))
            for j in range(parts):
                second = first
                if j != i:
                    sent.append(second := spark.sparkContext.broadcast(_known(state, j, parts, longest)))
                some = _scan(tables[u % shards], u, shards, longest, (i, j), first, second, buckets)
                found = some if found is None else found.unionByName(some)
        now = c.stored_at(_merged(state, found, u, shards, least, buckets), made := f"{path}-{u}")
        for b in sent:
            b.destroy()
        for x in old:
            c.dropped(spark, x)
        state, old = now, [made]
        u += 1
    return tables, state


def _named(shard: DataFrame, wanted: DataFrame, longest: int) -> DataFrame:
    """(key, lang, phrase, firsts, rests): strings of wanted phrases that occur in a shard, with the keys of their parts at each cut."""
    spark = shard.sparkSession
    total, found = wanted.count(), None
    parts = max(1, math.ceil(total / LIST))
    for part in range(parts):
        keys, k = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for batch in wanted.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).select("key", "k").toLocalIterator():
            keys.append(np.array([batch[0]], np.int64))
            k.append(np.array([batch[1]], np.int32))
        keys, k = np.concatenate(keys).view(np.uint64), np.concatenate(k)
        sent = spark.sparkContext.broadcast((keys, np.zeros(len(keys), np.int32), k))

        def name(batches, sent=sent):
            lists, seen = _lists(sent.value, longest), set()
            names = ["key", "lang", "phrase", "firsts", "rests"]
            for whole in batches:
                for batch in c.slices(whole, 500):
                    langs, texts = batch.column("lang").to_pylist(), c.binary(batch.column("text"))
                    out = []
                    for lo, hi in c.pieces(texts):
                        g = Grams(texts[lo:hi], langs[lo:hi])
                        every = [g.keys(j) for j in range(1, longest + 1)]
                        for n in range(2, longest + 1):
                            key, fits = every[n - 1]
                            hit = np.flatnonzero(lists[n - 1].times(key, fits) < NEVER)
                            _, first = np.unique(key[hit], return_index=True)
                            for at in hit[first].tolist():
                                if (own := int(key[at])) not in seen:
                                    seen.add(own)
                                    cut = lambda j, a: int(every[j - 1][0][a].astype(np.int64))
                                    out.append((int(np.uint64(own).astype(np.int64)), langs[lo + g.doc[at]], g.phrase(at, n), [cut(j, at) for j in range(1, n)], [cut(n - j, at + j) for j in range(1, n)]))
                    if out:
                        a, b, p, x, y = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(p, pa.string()), pa.array(x, pa.list_(pa.int64())), pa.array(y, pa.list_(pa.int64()))], names=names)

        some = shard.mapInArrow(c.lean(name), "key long, lang string, phrase string, firsts array<long>, rests array<long>")
        found = some if found is None else found.unionByName(some)
    return found.groupBy("key").agg(F.min(F.struct("lang", "phrase", "firsts", "rests")).alias("x")).select("key", "x.*")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, shards: int = 4, lang: str = "lang", text: str = "text", id: str = "doc_id") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the top phrases of each language by score, then count, then bytes of the phrase.

    Texts are lower-cased (A-Z), cut at .,;:!? and line ends into pieces, and these at
    spaces and tabs into words; a phrase lies within a piece. A null language is `und`, a null text is empty. Rows are counted as they
    come: rows that repeat, and rows without an id, each count. A phrase of 2 to
    longest words and a count a of least or more scores the least of floor(1000 a n / (l r)) over its cuts, ties
    to the earliest cut. It goes if a longer candidate that holds it has the same count. An empty table gives no row.
    """
    tables, state = counted(docs, least, longest, shards, lang, text, id)

    def unpacked(batches):
        for batch in batches:
            for x in batch.column("data").to_pylist():
                items = np.frombuffer(x, ITEM)
                items = items[(items["k"] == 0) | (items["count"] >= least)]
                yield pa.RecordBatch.from_arrays([pa.array(items["key"].view(np.int64) if items["key"].flags.c_contiguous else items["key"].copy().view(np.int64)), pa.array(items["k"].astype(np.int32)), pa.array(items["count"].astype(np.int64))], names=["key", "k", "f"])

    counts = c.stored(state.select("data").mapInArrow(c.lean(unpacked), "key long, k int, f long"))
    wanted, names = counts.where("k >= 2"), None
    for shard in tables:
        some = c.stored(_named(shard, wanted, longest))
        names = some if names is None else names.unionByName(some)
        wanted = c.stored(wanted.join(some.select("key"), "key", "left_anti"))
        if wanted.isEmpty():
            break
    totals = tables[0].limit(0).select("lang") if names is None else names.select("lang").distinct()
    salted = F.udf(lambda x: int(np.uint64(salt(x)).astype(np.int64)), "long")  # once a language
    n = totals.withColumn("key", salted("lang")).join(counts.where("k = 0"), "key").select("lang", F.col("f").alias("n"))
    found = names.join(counts.select("key", F.col("f").alias("a")), "key").join(n, "lang")
    inside = found.where(F.size("firsts") >= 2).select(F.explode(F.array_distinct(F.array(F.element_at("firsts", -1), F.element_at("rests", 1)))).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    found = found.join(inside, "key", "left").where("longer is null or longer < a").drop("longer")
    part = lambda name: counts.select(F.col("key").alias(f"{name}_key"), F.col("f").alias(name))
    cuts = found.select("lang", "phrase", "a", "n", F.posexplode(F.arrays_zip("firsts", "rests")).alias("at", "cut")).select("*", F.col("cut.firsts").alias("l_key"), F.col("cut.rests").alias("r_key"))
    scored = cuts.join(part("l"), "l_key").join(part("r"), "r_key").withColumn("score", F.expr("(1000bd * cast(a as decimal(16,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "at", "l", "r")).alias("x")).select("lang", "phrase", "a", "n", "x.score", "x.l", "x.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = best.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(c.width(docs)))).withColumn("near", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("near") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
