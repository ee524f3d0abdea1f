"""Toxicity by a convolutional text classifier trained in numpy.

A word is hashed into HASHES rows of one embedding table, which are added;
filters one to three words wide run over the text, the largest answer of each
filter counts, and a logistic unit weighs them. One part of the embedding begins as
the log odds of its row in all labelled texts that train and one filter as its
reader; all of it is then trained on all of them: in each epoch every block of about BLOCK texts is walked from the same net, in a
task of its own, and what blocks moved is averaged over the blocks that moved it. Thresholds are set for each language on
all labelled rows kept out of training, and scores are shifted so that the
threshold of the language that is predicted from the text lies at THRESHOLD.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.llm import common as c
from hazardspark.llm.context_mixing import opened, squeezed
from hazardspark.llm.language_id import LanguageId

BUCKETS = 1 << 17
HASHES = 3
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
BLOCK = 4000
MARKS = 27
SLICE = 1 << 14
GRID = 256
FAR = 32
THRESHOLD = 0.3
EPOCHS = 6
_APART = np.ones(256, dtype=bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def hashes_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of letters and digits in lower case, and how many each text has."""
    w = c.Words(texts, lower=True, space=_APART)
    return w.hashes(), np.diff(w.first)


def embedded(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word of texts of own words; where each text begins.

    Each text is followed by two blanks (row BUCKETS), so no filter sees two texts.
    """
    at = np.zeros(len(own) + 1, dtype=np.int64)
    np.cumsum(own + max(WIDTHS) - 1 + (own == 0), out=at[1:])
    out = np.full((at[-1], HASHES), BUCKETS, dtype=np.int32)
    place = np.arange(len(h)) + np.repeat(at[:-1] - np.cumsum(own) + own, own)
    for k in range(HASHES):
        out[place, k] = (h >> np.uint64(21 * k)) & np.uint64(BUCKETS - 1)
    return out, at


class Hashed:
    """Texts as hashes of words, one text after another, and how many words each has."""

    def __init__(self, h: np.ndarray, own: np.ndarray):
        self.h, self.own, self.at = h, own, np.concatenate([[0], np.cumsum(own)]).astype(np.int64)

    @staticmethod
    def of(own: np.ndarray, distinct: np.ndarray, code: np.ndarray) -> Hashed:
        return Hashed(distinct[code], own.astype(np.int64))

    def coded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As of() takes them."""
        distinct, code = np.unique(self.h, return_inverse=True)
        return self.own.astype("<i4"), distinct, code.astype("<i4")

    def some(self, i: np.ndarray) -> Hashed:
        return Hashed(np.concatenate([np.empty(0, np.uint64), *(self.h[self.at[k] : self.at[k + 1]] for k in i)]), self.own[i])

    def embedded(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.some(i)
        return embedded(own.h, own.own)


@dataclass
class Net:
    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    base: float

    def features(self, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest answer of each filter in each text, and the answers by place."""
        x = self.table[rows].sum(axis=1)
        most, answers = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            a = np.zeros((len(x), f.shape[2]), dtype=np.float32)
            n = len(x) - w + 1
            for j in range(w):
                a[:n] += x[j : j + n] @ f[j]
            a += b
            answers.append(a)
            most.append(np.maximum.reduceat(a, at[:-1], axis=0))
        return np.maximum(np.concatenate(most, axis=1), 0), answers

    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.features(*embedded(*hashes_of(texts)))[0] @ self.out + self.base


@dataclass
class State:
    """A net and Adagrad's sums of squares: one for each row of the table, one for each other number."""

    net: Net
    past: dict

    @staticmethod
    def first(odds: np.ndarray, share: float, seed: int = 5) -> State:
        rng = np.random.default_rng(seed)
        total = len(WIDTHS) * FILTERS
        table = rng.normal(0, 0.02, (BUCKETS + 1, DIM)).astype(np.float32)
        table[:, 0] = odds / HASHES
        table[BUCKETS] = 0
        filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        filters[0][0, :, 0] = 0
        filters[0][0, 0, 0] = 1
        bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        bias[0][0] = -1.0
        out = rng.normal(0, 0.05, total).astype(np.float32)
        out[0] = 2.0
        net = Net(table, filters, bias, out, float(np.log(share / (1 - share))) - 1.0)
        return State(net, {"table": np.full(len(table), 1e-3, np.float32), "dense": np.full(len(dense(net)), 1e-3, np.float32)})

    def copy(self) -> State:
        n = self.net
        return State(Net(n.table.copy(), [x.copy() for x in n.filters], [x.copy() for x in n.bias], n.out.copy(), n.base), {k: x.copy() for k, x in self.past.items()})

    def walk(self, texts: Hashed, labels: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
        """One epoch of Adagrad over batches of texts, in place; only places that a filter's maximum names get a gradient. Which rows of the table moved."""
        net, used = self.net, np.zeros(BUCKETS + 1, dtype=bool)
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), 32):
            part = order[lo : lo + 32]
            own, begin = texts.embedded(part)
            most, answers = net.features(own, begin)
            p = 1 / (1 + np.exp(-np.clip(most @ net.out + net.base, -30, 30)))
            err = ((p - labels[part]) * weight[part] / len(part)).astype(np.float32)
            back = np.where(most > 0, err[:, None] * net.out, 0)
            g_table_rows, g_table, g_filters = [], [], []
            for k, (w, a) in enumerate(zip(WIDTHS, answers, strict=True)):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                top = np.stack([begin[i] + a[begin[i] : begin[i + 1]].argmax(axis=0) for i in range(len(part))])
                gf = np.zeros_like(net.filters[k])
                for j in range(w):
                    place = np.minimum(top + j, len(own) - 1)
                    x = net.table[own[place]].sum(axis=2)  # text, filter, dim
                    gf[j] = np.einsum("tf,tfd->df", g, x)
                    gx = g[:, :, None] * net.filters[k][j].T[None]
                    for h in range(HASHES):
                        g_table_rows.append(own[place, h].ravel())
                        g_table.append(gx.reshape(-1, DIM))
                g_filters.append(gf)
            g_bias = [back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
            grad = np.concatenate([*(x.ravel() for x in g_filters), *g_bias, most.T @ err, [err.sum()]]).astype(np.float32)
            self.past["dense"] += grad * grad
            set_dense(net, dense(net) - 0.05 * grad / np.sqrt(self.past["dense"]))
            r, back_ = np.unique(np.concatenate(g_table_rows), return_inverse=True)
            g = np.zeros((len(r), DIM), dtype=np.float32)
            np.add.at(g, back_, np.concatenate(g_table))
            self.past["table"][r] += (g * g).mean(axis=1)
            net.table[r] -= 0.05 * g / np.sqrt(self.past["table"][r])[:, None]
            net.table[BUCKETS] = 0
            used[r] = True
        return used

    def moved(self, old: State, used: np.ndarray) -> list[np.ndarray]:
        """What to add up over blocks, by slices of the table; the last is of all other numbers."""
        net, was = self.net, old.net
        table = np.concatenate([net.table - was.table, (self.past["table"] - old.past["table"])[:, None], used[:, None].astype(np.float32)], axis=1)[:BUCKETS]
        rest = np.concatenate([dense(net) - dense(was), self.past["dense"] - old.past["dense"], [1]]).astype(np.float32)
        return [*np.split(table, BUCKETS // SLICE), rest]

    def add(self, k: int, total: np.ndarray) -> None:
        """Move slice k by the mean over the blocks that moved a row, of their sum."""
        if k == BUCKETS // SLICE:
            mean = total[:-1] / max(total[-1], 1)
            many = len(mean) // 2
            set_dense(self.net, dense(self.net) + mean[:many])
            self.past["dense"] += mean[many:]
            return
        total = total.reshape(-1, DIM + 2)
        mean = total[:, :-1] / np.maximum(total[:, -1:], 1)
        at = slice(k * SLICE, (k + 1) * SLICE)
        self.net.table[at] += mean[:, :DIM]
        self.past["table"][at] += mean[:, DIM]


def dense(net: Net) -> np.ndarray:
    """All numbers but those of the table."""
    return np.concatenate([*(x.ravel() for x in net.filters), *net.bias, net.out, [net.base]]).astype(np.float32)


def set_dense(net: Net, x: np.ndarray) -> None:
    at = 0
    for own in (*net.filters, *net.bias, net.out):
        own[...] = x[at : at + own.size].reshape(own.shape)
        at += own.size
    net.base = float(x[at])


def best_threshold(cell: np.ndarray, many: np.ndarray, hits: np.ndarray) -> float:
    """The cut with the best F1 between cells of 1 / GRID; the middle of the widest gap among equally good ones. many, hits: rows in a cell, and those of label 1."""
    order = np.argsort(-cell)
    cell, hit, found = cell[order] / GRID, np.cumsum(hits[order]), np.cumsum(many[order])
    f1 = 2 * hit / (found + hits.sum())
    gap = np.minimum(cell - np.append(cell[1:] + 1 / GRID, cell[-1] - 1), 4)
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    i = top[gap[top].argmax()]
    return float(cell[i] - gap[i] / 2)


class Toxicity:
    def __init__(self, net: Net, cuts: dict[str, float], cut: float, language: LanguageId):
        self.net, self.cuts, self.cut, self.language = net, cuts, cut, language

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        lang, _ = self.language.predict(texts)
        z = self.net.logits(texts) - np.array([self.cuts.get(x, self.cut) for x in lang])
        return 1 / (1 + np.exp(-np.clip(z + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, language: LanguageId, epochs: int = EPOCHS, block: int = BLOCK) -> Toxicity:
    """docs: doc_id, text; labels: doc_id, toxic. Four fifths of all labelled rows train, by a hash of the id, and one fifth sets the thresholds,
    for each predicted language that has ten rows of either label there, else for all languages together.

    Labelled texts become hashes of words where they are read, and these go into blocks of about so many texts, stored once. Epochs
    are a job each: blocks are walked apart and merged by slices of the net. The driver gets counts and the merged net, whose size does not follow the corpus.
    """
    own = (F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.lit(23)).alias("h"))
    rows = labels.where("toxic in (0, 1) and doc_id is not null").select(*own, F.col("toxic").cast("int").alias("toxic"))
    n = rows.count()
    shards, bits = max(1, math.ceil(n / block)), c.bits_for(n, 1 / 8, MARKS)
    shard = F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard")

    def marks(batches):
        yield c.sketch_rows(np.concatenate([np.empty(0, np.int64), *(batch.column("h").to_numpy() & ((1 << bits) - 1) for batch in batches)]))

    held = docs.sparkSession.sparkContext.broadcast((language, c.merged_sketch(rows.select("h").mapInArrow(c.lean(marks), c.SKETCH_SCHEMA), bits, at_least=1)))

    def hashed(batches):
        language, marked = held.value
        for batch in batches:
            cell = batch.column("h").to_numpy() & ((1 << bits) - 1)
            labelled = batch.filter(pa.array((marked[cell >> 3] >> (cell & 7) & 1).astype(bool)))  # and a few more: an exact match follows
            shard, ids, langs, words, own = labelled.column("shard").to_numpy(), labelled.column("doc_id").to_numpy(), [], [], []
            for part in c.slices(labelled):
                texts, kept = c.binary(part.column("text")), part.column("h").to_numpy() % 5 == 0
                for a, b in c.pieces(texts):
                    h, many = hashes_of(texts[a:b])
                    lang = np.full(b - a, None, dtype=object)
                    if kept[a:b].any():
                        lang[kept[a:b]] = language.predict([texts[a + i] for i in np.flatnonzero(kept[a:b])])[0]
                    langs.append(lang)
                    words.append(h)
                    own.append(many)
            if len(ids):
                lang, texts = np.concatenate(langs), Hashed(np.concatenate(words), np.concatenate(own))
                for s in np.unique(shard):
                    i = np.flatnonzero(shard == s)
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([lang[i]], pa.list_(pa.string())), pa.array([squeezed((ids[i], *texts.some(i).coded()))], pa.binary())], names=["shard", "lang", "data"])

    def gathered(key, texts, labels):
        parts = [opened(x, ("<i8", "<i4", "<u8", "<i4")) for x in texts.column("data").to_pylist()]
        held_ = [Hashed.of(*x[1:]) for x in parts]
        ids = np.concatenate([np.empty(0, np.int64), *(x[0] for x in parts)])
        lang = [x for row in texts.column("lang").to_pylist() for x in row]
        t = Hashed(np.concatenate([np.empty(0, np.uint64), *(x.h for x in held_)]), np.concatenate([np.empty(0, np.int64), *(x.own for x in held_)]))
        i = pa.table({"doc_id": ids, "i": np.arange(len(ids))}).join(labels.select(["doc_id", "toxic"]), "doc_id", join_type="inner")
        found = sorted(zip(i.column("doc_id").to_pylist(), i.column("toxic").to_pylist(), i.column("i").to_pylist(), strict=True), key=lambda x: (x[0], x[1], t.h[t.at[x[2]] : t.at[x[2] + 1]].tobytes()))
        toxic, order = np.array([y for _, y, _ in found], np.uint8), np.array([k for _, _, k in found], np.int64)
        out = [key[0].as_py()], [[lang[k] for k in order]], [squeezed((toxic, *t.some(order).coded()))]
        del parts, held_, t, texts
        c.release()
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int32(), pa.list_(pa.string()), pa.binary()), strict=True)], names=["shard", "lang", "data"])

    kind = "shard int, lang array<string>, data binary"
    texts = docs.where("doc_id is not null").select(*own, "text").select("doc_id", "h", shard, "text").mapInArrow(c.lean(hashed), kind).repartition(shards, "shard")
    labelled = rows.select("doc_id", "toxic", shard).repartition(shards, "shard")
    blocks = c.stored(texts.groupBy("shard").cogroup(labelled.groupBy("shard")).applyInArrow(gathered, kind))

    seen, many = np.zeros((2, BUCKETS), dtype=np.float32), np.zeros(2)
    for k, total in summed(blocks, counts):
        if k == BUCKETS // SLICE:
            many = total.astype(np.float64)
        else:
            seen[:, k * SLICE : (k + 1) * SLICE] = total.reshape(2, -1)
    odds = np.zeros(BUCKETS + 1, dtype=np.float32)
    odds[:BUCKETS] = np.where(seen.sum(axis=0) >= 5, np.clip(np.log((seen[1] + 0.5) / (many[1] + 1)) - np.log((seen[0] + 0.5) / (many[0] + 1)), -3, 3), 0)
    share = float(np.clip(many[1] / many.sum() if many.sum() else 0.5, 0.01, 0.99))
    state = State.first(odds, share)
    for epoch in range(epochs if many.min() else 0):
        sent = docs.sparkSession.sparkContext.broadcast(state)

        def walked(shard, texts, labels, lang, epoch=epoch, sent=sent):
            own = sent.value.copy()
            return own.moved(sent.value, own.walk(texts, labels, share, np.random.default_rng((5, epoch, shard))))

        merged = list(summed(blocks, walked))
        state = state.copy()
        for k, total in merged:
            state.add(k, total)
        sent.unpersist()
    return Toxicity(state.net, *thresholds(blocks, state.net), language)


def each_block(batches, kept: bool):
    """Number, words, labels and languages of each block's texts that train, or of those kept out."""
    for batch in batches:
        for r in range(batch.num_rows):
            lang = np.array(batch.column("lang")[r].as_py(), dtype=object)
            toxic, *texts = opened(batch.column("data")[r].as_py(), ("u1", "<i4", "<u8", "<i4"))
            which = np.flatnonzero((lang != None) == kept)  # noqa: E711
            yield batch.column("shard")[r].as_py(), Hashed.of(*texts).some(which), toxic[which].astype(np.float64), lang[which]


def counts(shard: int, texts: Hashed, labels: np.ndarray, lang: np.ndarray) -> list[np.ndarray]:
    """In how many texts of either label each row of the table occurs, by slices; and how many texts there are."""
    seen = np.zeros((2, BUCKETS + 1), dtype=np.float32)
    for lo in range(0, len(labels), 200):
        part = np.arange(lo, min(lo + 200, len(labels)))
        rows, at = texts.embedded(part)
        cells = np.unique(np.repeat(np.arange(len(part)), np.diff(at))[:, None] * (BUCKETS + 1) + rows)
        np.add.at(seen, (labels[part][cells // (BUCKETS + 1)].astype(np.int64), cells % (BUCKETS + 1)), 1)
    return [*np.split(seen[:, :BUCKETS], BUCKETS // SLICE, axis=1), np.bincount(labels.astype(np.int64), minlength=2).astype(np.float32)]


def summed(blocks: DataFrame, f: Callable):
    """f(number, texts, labels, languages) gives arrays for each block's texts that train; each array summed over blocks, in order of their numbers."""

    def each(batches):
        for shard, texts, labels, lang in each_block(batches, kept=False):
            if len(labels):
                for k, x in enumerate(f(shard, texts, labels, lang)):
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([k], pa.int32()), pa.array([x.nbytes], pa.int32()), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["shard", "k", "size", "data"])

    def merge(key, tab):
        tab, total = tab.sort_by("shard"), 0
        for size, data in zip(tab.column("size").to_pylist(), tab.column("data").to_pylist(), strict=True):
            total = total + np.frombuffer(pa.decompress(data, size, "zstd", asbytes=True), np.float32)
        return pa.table({"k": key[0:1], "data": [total.tobytes()]}, schema=pa.schema([("k", pa.int32()), ("data", pa.binary())]))

    for k, data in blocks.mapInArrow(c.lean(each), "shard int, k int, size int, data binary").groupBy("k").applyInArrow(merge, "k int, data binary").toLocalIterator():
        yield k, np.frombuffer(data, np.float32)


def thresholds(blocks: DataFrame, net: Net) -> tuple[dict[str, float], float]:
    """The cut of each language with ten rows of either label among those kept out, and one for all others. Scores are counted in cells of 1 / GRID, up to FAR either way."""
    held = blocks.sparkSession.sparkContext.broadcast(net)

    def cells(batches):
        for _, texts, labels, lang in each_block(batches, kept=True):
            for a in range(0, len(labels), 64):
                x = texts.embedded(np.arange(a, min(a + 64, len(labels))))
                z = held.value.features(*x)[0] @ held.value.out + held.value.base
                cell = np.floor(np.clip(z, -FAR, FAR) * GRID).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(lang[a : a + 64], pa.string()), pa.array(cell), pa.array(labels[a : a + 64].astype(np.int64))], names=["lang", "cell", "toxic"])

    found = blocks.mapInArrow(c.lean(cells), "lang string, cell int, toxic long").groupBy("lang", "cell").agg(F.count("*"), F.sum("toxic")).collect()
    lang = np.array([r[0] for r in found], dtype=object)
    cell, many, hits = (np.array([r[k] for r in found], dtype=np.int64) for k in (1, 2, 3))
    if not 0 < hits.sum() < many.sum():
        return {}, 0.0

    def cut(which):
        at, back = np.unique(cell[which], return_inverse=True)
        return best_threshold(at, np.bincount(back, weights=many[which]), np.bincount(back, weights=hits[which]))

    cuts = {x: cut(lang == x) for x in sorted(set(lang)) if min(hits[lang == x].sum(), (many - hits)[lang == x].sum()) >= 10}
    return cuts, cut(np.ones(len(lang), dtype=bool))


def score(docs: DataFrame, model: Toxicity, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted), a row for each row; null and empty texts are scored as texts without words.

    Only the two named columns are read. predicted is 1 where score >= THRESHOLD.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for batch in batches:
            for part in c.slices(batch):
                s = scored(held.value, c.binary(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(c.lean(rows), "doc_id long, score double, predicted int")


def scored(model: Toxicity, texts: list[bytes | None]) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(model.scores(texts[a:b]) for a, b in c.pieces(texts, c.CHUNK_BYTES // 2))])


def clean(docs: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns kept. Null and empty texts are scored as texts without words."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for batch in batches:
            for part in c.slices(batch):
                yield part.filter(pa.array(scored(held.value, c.binary(part.column(text))) < THRESHOLD))

    return docs.mapInArrow(c.lean(rows), docs.schema)
