"""Language-model scoring by logistic context mixing over bits.

A text is words and the separators between them in turn, cut into segments of at
most CUT bytes, each closed by an end symbol. A word with one capital in front is a mark for that and the word in
lower case. A symbol is a walk down a Huffman tree that the symbol before it
selects; each step is a bit. Four predictors know how often their context saw 0 and 1 there:
the symbol before (exact), two and three symbols (hashed into SLOTS cells each; the number of short
contexts does not grow with the corpus), and the whole segment so far from three bytes on. The last grows with
the corpus and is counted exactly over all whole training texts: distinct segments first, their contexts from these.
Texts are read once, into pieces that hold the numbers of their segments; pieces meet the contexts, and the exact counts
of words, in one join by shards of contexts, at every size.

The predictors' log odds are mixed with weights that a gate selects: how often the longest context was
seen and whether one symbol only followed it, or how near the segment's start is. Weights start where Newton's steps over every bit of all training
texts leave them (a bit's odds depend on its segment alone, so each distinct segment stands for all its occurrences), and are
refined after every bit. A text is cut into stretches of STRETCH bits, which run side by side and
each start from the learnt weights. Beside it stands a unigram base score from exact word counts.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardspark.llm import common as c

CUT = 32
END, CAPITAL, SYMBOLS, START, NONE, BEFORE = 256, 257, 258, 258, 266, 267
DEEP = 3
SLOTS = 22
GATES = 14
STRETCH = 2048
NEWTON = 6
RATE = 0.004
UNIT = 16.0
PIECE_BYTES = 14 << 20
LIMIT = 12.0
SHARD_BYTES = 16_000_000
_CHUNK = 1 << 20
_STEPS = 64
_TYPES = 50_000
_FEW = 10_000
_SEGMENTS = 600_000
_KIND = np.uint64(0xA24BAED4963EE407)
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[33, 46, 63]] = True
_UPPER = np.triu_indices(4)


# --- texts as segments, segments as symbols, symbols as bits --------------------------------------


class Segments:
    """Word, separator, word, ... of each text, the last separator empty; in parts of CUT bytes.

    kind: 0 word, 1 separator, 2 and 3 further parts of these; + 4 where a sentence begins or has ended; + 8 where the
    first letter, here in lower case, is a capital.
    """

    def __init__(self, texts: list[bytes]):
        w = c.Words(texts)
        at, end, many = w.at[:-1], w.at[1:] - 1, np.diff(w.first)
        some = many > 0
        head = np.full(len(texts), -1, dtype=np.int64)
        tail = head.copy()
        head[some], tail[some] = w.start[w.first[:-1][some]], w.end[w.first[1:][some] - 1]
        lead = at[~some | (head > at)]
        trail = end[np.where(some, tail < end, end > at)]
        start = np.concatenate([w.start, lead, trail])
        order = np.argsort(start, kind="stable")
        start, stop = start[order], np.concatenate([w.end, lead, trail])[order]
        doc = np.searchsorted(w.at, start, side="right") - 1
        gap = end[doc]
        inner = np.flatnonzero(doc[1:] == doc[:-1])
        gap[inner] = start[inner + 1]
        raw = w.buf
        ended = (stop > start) & _ENDS[raw[np.maximum(stop - 1, 0)]]
        opens = np.ones(len(start), dtype=bool)
        opens[inner + 1] = ended[inner]
        upper = (raw >= 65) & (raw <= 90)
        capital = (stop > start) & upper[start] & ((stop - start == 1) | ~upper[np.minimum(start + 1, len(raw) - 1)])
        self.buf = raw.copy()
        self.buf[start[capital]] += 32
        begin, size = np.stack([start, stop], axis=1).ravel(), np.stack([stop - start, gap - stop], axis=1).ravel()
        kind = np.stack([4 * opens + 8 * capital, 1 + 4 * ended], axis=1).ravel()
        parts = size // CUT + 1
        j = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        self.begin = np.repeat(begin, parts) + CUT * j
        self.size = np.minimum(np.repeat(size, parts) - CUT * j, CUT)
        self.kind = np.where(j > 0, 2 + np.repeat(kind & 1, parts), np.repeat(kind, parts))
        self.doc = np.repeat(np.repeat(doc, 2), parts)
        self.long = np.flatnonzero(stop - start >= CUT)
        self.long_doc = doc[self.long]
        size = (stop - start)[self.long]  # hashed apart: these are few
        self.long_hash = word_hashes(raw[ranges(start[self.long], size)], np.cumsum(size) - size, size)

    def hashes(self) -> np.ndarray:
        return prefix_hashes(self.buf)(self.begin, self.size, self.kind)

    def take(self, i: np.ndarray) -> Types:
        size = self.size[i]
        return Types(self.buf[ranges(self.begin[i], size)], size, self.kind[i])


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers begin, begin + 1, ... of each range, one range after the other."""
    return np.arange(int(size.sum())) + np.repeat(begin - np.cumsum(size) + size, size)


def strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """data[at[k]:at[k + 1]] of each k as a string of bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * data.itemsize).astype("<i8")), pa.py_buffer(data)])


def taken(of: pa.Array, i: np.ndarray, kind: type) -> np.ndarray:
    """The strings i, one after the other. Arrow copies each whole; places of single numbers take longer and more memory."""
    out = of.take(pa.array(i)).buffers()[2]
    return np.frombuffer(out, kind) if out and out.size else np.empty(0, kind)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each number once. By a sort: np.unique without further results hashes, which takes far longer and more memory here."""
    x = np.sort(x)
    return x[firsts(x)]


def firsts(x: np.ndarray) -> np.ndarray:
    """Where a number of sorted x is met first."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, dtype=np.int64)


def places(h: np.ndarray) -> np.ndarray:
    """An order that sorts h. Hashes differ in their first bits, so these are sorted with the places as last bits, which is much faster than finding an order; if some do not, the order is found."""
    low = np.uint64((1 << max(len(h) - 1, 0).bit_length()) - 1)
    order = (np.sort(h & ~low | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)
    x = h[order]
    return order if (x[1:] >= x[:-1]).all() else np.argsort(h)


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers, sorted; a place of each in h; and which of them each place holds."""
    order = places(h)
    h = h[order]
    at = firsts(h)
    back = np.empty(len(h), dtype=np.int32)
    back[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.append(at, len(h))))
    return h[at], order[at], back


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the exact sum of each one's n, which are not negative.

    A key and its n are sorted as one number where 64 bits hold both, as sorting is much faster than finding an order.
    """
    key, n = key.astype(np.uint64), n.astype(np.int64)
    spare = 64 - max(int(key.max()).bit_length(), 1) if len(key) else 0
    much = n >> spare > 0
    if spare and not much.all():
        if much.any():
            parts = [summed(key[~much], n[~much]), in_order_summed(key[much], n[much])]
            return in_order_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        both = np.sort(key << np.uint64(spare) | n.astype(np.uint64))
        key = both >> np.uint64(spare)
        at = firsts(key)
        return key[at], np.add.reduceat((both & np.uint64((1 << spare) - 1)).astype("<i8"), at)
    return in_order_summed(key, n)


def in_order_summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key = key[order]
    at = firsts(key)
    return key[at], np.add.reduceat(n[order].astype("<i8"), at) if len(at) else np.empty(0, "<i8")


def prefix_hashes(buf: np.ndarray) -> Callable:
    """A function from begin, size and kind to hashes of those bytes."""
    up, down = c.powers(c._BASE, len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return lambda begin, size, kind: c.mix((total[begin + size] - total[begin]) * down[begin] + size.astype(np.uint64) + kind.astype(np.uint64) * _KIND)


def word_hashes(buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of words in lower case."""
    return prefix_hashes(c.LOWER[buf])(begin, size, np.zeros(len(size), dtype=np.int64))


@dataclass
class Symbols:
    """All symbols of some segments, one after another: which segment, place there, the symbol and those before it."""

    owner: np.ndarray
    depth: np.ndarray
    symbol: np.ndarray
    before: list[np.ndarray]

    def context(self, k: int) -> np.ndarray:
        out = self.before[0]
        for j in range(1, k):
            out = out * BEFORE + self.before[j]
        return out


@dataclass
class Types:
    """Distinct segments: their bytes, one after another, sizes and kinds."""

    data: np.ndarray
    size: np.ndarray
    kind: np.ndarray

    def hashes(self) -> np.ndarray:
        return prefix_hashes(self.data)(np.cumsum(self.size) - self.size, self.size, self.kind)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Which segments are whole words, and their hashes in lower case."""
        which = np.flatnonzero((self.kind & 3 == 0) & (self.size > 0) & (self.size < CUT))
        return which, word_hashes(self.data, (np.cumsum(self.size) - self.size)[which], self.size[which])

    def in_order(self) -> np.ndarray:
        """Segments by their first bytes, for the compression of what is written."""
        at, first = np.cumsum(self.size) - self.size, np.zeros(len(self.size), dtype=np.uint64)
        data = np.append(self.data, np.zeros(8, dtype=np.uint8))
        for j in range(8):
            first = first << np.uint64(8) | np.where(self.size > j, data[at + j], 0).astype(np.uint64)
        return np.argsort(first, kind="stable")

    def some(self, i: np.ndarray) -> Types:
        at = np.cumsum(self.size) - self.size
        return Types(self.data[ranges(at[i], self.size[i])], self.size[i], self.kind[i])

    def parts(self, many: int = _TYPES) -> Iterator[Types]:
        """Some segments at a time."""
        at = np.cumsum(self.size) - self.size
        for lo in range(0, len(self.size), many):
            hi = min(lo + many, len(self.size))
            yield Types(self.data[at[lo] : at[hi - 1] + self.size[hi - 1]], self.size[lo:hi], self.kind[lo:hi])

    def symbols(self) -> Symbols:
        capital = self.kind >> 3
        many = capital + self.size + (self.size < CUT)
        owner = np.repeat(np.arange(len(many)), many)
        depth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many + capital, many)  # -1: the mark of a capital
        at = (np.cumsum(self.size) - self.size)[owner] + np.maximum(depth, 0)
        data = np.append(self.data, np.zeros(CUT + 1, dtype=np.uint8)).astype(np.int64)
        kind = self.kind[owner]
        first = depth == -(kind >> 3)
        start = START + np.where(first | (kind & 1 == 1), kind & 7, kind & 3)
        before = [np.where(depth >= k, data[at - k], np.where((depth == k - 1) | (depth < 0) & (k == 1), start, NONE)) for k in (1, 2, 3)]
        return Symbols(owner, depth, np.where(depth < 0, CAPITAL, np.where(depth < self.size[owner], data[at], END)), before)

    def keys(self, s: Symbols) -> tuple[np.ndarray, np.ndarray]:
        """For the symbols of DEEP places and more: a number for the segment so far, the symbol before and the symbol; and which symbols these are."""
        deep = np.flatnonzero(s.depth >= DEEP)
        own = s.owner[deep]
        h = prefix_hashes(self.data)((np.cumsum(self.size) - self.size)[own], s.depth[deep], self.kind[own] & 3)
        return h >> np.uint64(30) << np.uint64(18) | (s.before[0][deep] << 9 | s.symbol[deep]).astype(np.uint64), deep


@dataclass
class Trees:
    """Of each symbol before: nodes and bits on the way to each symbol."""

    node: np.ndarray
    bit: np.ndarray
    first: np.ndarray

    def sizes(self, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        at = before * SYMBOLS + symbol
        return self.first[at + 1] - self.first[at]

    def paths(self, before: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every bit of the symbols: which symbol it belongs to, and its place in node and bit."""
        at = before * SYMBOLS + symbol
        many = self.first[at + 1] - self.first[at]
        return np.repeat(np.arange(len(at)), many), ranges(self.first[at], many)


def tree(count: np.ndarray) -> list[list[tuple[int, int]]]:
    heap = [(int(n) + 1, s, (s,)) for s, n in enumerate(count)]
    heapq.heapify(heap)
    ways: list[list[tuple[int, int]]] = [[] for _ in count]
    node = len(count) - 2
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for bit, part in enumerate((a[2], b[2])):
            for s in part:
                ways[s].append((node, bit))
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        node -= 1
    return [w[::-1] for w in ways]


def trees(pairs: np.ndarray) -> Trees:
    """pairs[before, symbol]: how often."""
    flat = tree(np.zeros(SYMBOLS))
    ways = [w for row in pairs for w in (tree(row) if row.any() else flat)]
    first = np.concatenate([[0], np.cumsum([len(w) for w in ways])])
    return Trees(np.array([n for w in ways for n, _ in w], dtype=np.int64), np.array([b for w in ways for _, b in w], dtype=np.uint8), first)


def odds_of(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log odds in steps of 1 / UNIT."""
    return np.clip(np.rint(np.log((n1 + 0.4) / (n0 + 0.4)) * UNIT), -127, 127).astype(np.int8)


def slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    x = (context * 512 + node).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOTS)).astype(np.int64)


# --- mixing -----------------------------------------------------------------------------------


def mixed(odds: np.ndarray, gate: np.ndarray, at: np.ndarray, weights: np.ndarray, rate: float = RATE) -> np.ndarray:
    """Natural-log cost of each lane.

    odds: four int8 as an int32 for each bit, of the bit that was met; gate: of each bit; both with _STEPS spare ones at the end; lane i is the bits from at[i] to at[i + 1]. Weights move after every bit.
    """
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    longest, begin = n[order], at[:-1][order]
    # a row of four weights for each lane and gate, moved about as one number of 16 bytes; a row of odds as one of 4. Weights are held negative, and for odds in steps of 1 / UNIT
    w = np.tile(weights.astype(np.float32) / np.float32(-UNIT), (len(n), 1)).view(np.complex128).ravel()
    four, gates = (np.lib.stride_tricks.sliding_window_view(x, _STEPS) for x in (odds, gate))
    cost = np.zeros(len(n))
    base = np.arange(len(n)) * GATES
    # each step writes into the same arrays: for some thousand lanes calls and new arrays cost as much as the sums
    every_z, every_row = np.empty(len(n), dtype=np.float32), np.empty(len(n), dtype=np.complex128)
    every_part, spread = np.empty((len(n), 4), dtype=np.float32), np.empty((len(n), 4), dtype=np.float32)
    low, high, one, rate = np.float32(-LIMIT), np.float32(LIMIT), np.float32(1), np.float32(-rate / UNIT**2)
    many = -1
    for lo in range(0, int(longest[0]) if len(n) else 0, _STEPS):
        live = int(np.searchsorted(-longest, -lo))
        steps = min(_STEPS, int(longest[0]) - lo)
        x = four[begin[:live] + lo].T[:steps].copy().view(np.int8).astype(np.float32).reshape(steps, live, 4)
        place = gates[begin[:live] + lo].T[:steps] + base[:live]
        against = np.ones((_STEPS, live), dtype=np.float32)  # 1 and the odds against the bit
        for t, m in enumerate(np.searchsorted(-longest, -(lo + np.arange(steps))).tolist()):
            if m != many:
                many, z, row, part, errs = m, every_z[:m], every_row[:m], every_part[:m], spread[:m]
                wt, (p0, p1, p2, p3), err_columns = row.view(np.float32).reshape(m, 4), part.T, list(errs.T)
            i, xt = place[t, :m], x[t, :m]
            w.take(i, out=row, mode="clip")  # no place is clipped; the other modes copy once more
            np.multiply(xt, wt, out=part)
            np.add(p0, p2, out=z)
            np.add(z, p1, out=z)
            np.add(z, p3, out=z)
            np.maximum(z, low, out=z)
            np.minimum(z, high, out=z)
            np.exp(z, out=z)
            np.divide(z, np.add(z, one, out=against[t, :m]), out=z)  # the probability of the other bit
            np.multiply(z, rate, out=z)
            for column in err_columns:  # whole columns: rows of four are slow to broadcast over
                column[...] = z
            np.multiply(xt, errs, out=part)
            np.add(wt, part, out=wt)
            w[i] = row
        product = against[0::4] * against[1::4] * against[2::4] * against[3::4]  # of four, each at most 1 + exp(LIMIT)
        cost[order[:live]] += np.log(product, out=product).sum(axis=0, dtype=np.float64)
    return cost


@dataclass
class Model:
    """Trees and the odds of the three short contexts; those of the longest come to each piece of texts by a join."""

    trees: Trees
    one: np.ndarray
    two: np.ndarray
    three: np.ndarray

    def features(self, types: Types, deep: Deep) -> tuple[np.ndarray, ...]:
        """odds, and gate and bit, of every bit of the segments, and how many bits each has."""
        odds_, gate_, many_ = np.empty(0, np.int32), np.empty(0, np.uint8), [np.empty(0, np.int64)]
        for part in types.parts(_FEW):
            sym = part.symbols()
            owner, way = self.trees.paths(sym.before[0], sym.symbol)
            node = self.trees.node[way]
            key, which = part.keys(sym)
            level, values, begin = deep.of(key)
            at = len(odds_)
            odds_.resize(at + len(way), refcheck=False)  # longer in place, so that nothing is held twice
            gate_.resize(at + len(way), refcheck=False)
            odds = odds_[at:].view(np.int8).reshape(-1, 4)
            odds[:, 0] = self.one[sym.before[0][owner] * 512 + node]
            odds[:, 1] = self.two[slots(sym.context(2)[owner], node)]
            odds[:, 2] = self.three[slots(sym.context(3)[owner], node)]
            many = np.bincount(owner, minlength=len(sym.symbol))
            starts, seen = np.cumsum(many) - many, level > 0
            hit, source = np.zeros(len(many), dtype=bool), np.empty(len(many), dtype=np.int64)
            hit[which], source[which] = seen, begin - starts[which]
            bits = np.flatnonzero(hit[owner])
            odds[bits, 3] = values[bits + source[owner[bits]]]
            apart = part.kind[sym.owner] & 1
            gate = np.where(apart == 1, 12 + np.minimum(sym.depth, 1), 9 + np.clip(sym.depth, 0, 2))
            gate[which] = np.where(apart[which] == 1, 13, level)
            gate_[at:] = (2 * gate).astype(np.uint8)[owner] | self.trees.bit[way]
            many_.append(np.bincount(sym.owner, weights=many, minlength=len(part.size)).astype(np.int64))
            del odds
        return odds_.view(np.int8).reshape(-1, 4), gate_, np.concatenate(many_)

    def lanes(self, piece: Piece, deep: Deep, docs: np.ndarray) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]]:
        """For ranges of the piece's documents (numbers in docs): odds of the bit met and gate, of every bit, _STEPS spare ones at the end, and where each lane begins; and each lane's document."""
        odds, gate, many = self.features(piece.types, deep)
        odds, type_at = odds.view(np.int32).ravel(), np.append(0, np.cumsum(many))
        for lo in range(0, len(odds), _CHUNK):
            other = np.flatnonzero(gate[lo : lo + _CHUNK] & 1 == 0) + lo
            odds[other] = np.negative(odds[other].view(np.int8)).view(np.int32)
        gate >>= 1
        odds_of_types, gate_of_types = strings(odds, type_at), strings(gate, type_at)
        for part, which, own in piece.chunks(docs):
            size = np.add.reduceat(many[which], np.cumsum(own) - own)
            lanes = -(-size // STRETCH)
            text = np.repeat(part, lanes)
            j = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            total = int(size.sum())
            at = np.append(np.repeat(np.cumsum(size) - size, lanes) + j * STRETCH, total)
            bits, done = (np.zeros(total + _STEPS, odds.dtype), np.zeros(total + _STEPS, gate.dtype)), 0
            for k in range(0, len(which), _TYPES):  # a part at a time, as it is there twice
                some = which[k : k + _TYPES]
                end = done + int(many[some].sum())
                bits[0][done:end], bits[1][done:end] = taken(odds_of_types, some, np.int32), taken(gate_of_types, some, np.uint8)
                done = end
            bits = (*bits, at)
            yield bits, text
            del bits

    def costs(self, piece: Piece, deep: Deep, weights: np.ndarray) -> np.ndarray:
        """log10 probability of each document."""
        out = np.zeros(len(piece.ids))
        for bits, text in self.lanes(piece, deep, np.arange(len(out))):
            np.add.at(out, text, mixed(*bits, weights))
            del bits  # before the next ones are made
        return -out / math.log(10)


class Piece:
    """Documents as numbers of distinct segments; words of CUT bytes and more beside them."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, own: np.ndarray, which: np.ndarray, types: Types, seen: np.ndarray, long_doc: np.ndarray, long_hash: np.ndarray, train: np.ndarray):
        """own: how many segments each document has; seen: how often each type occurs in training documents."""
        self.ids, self.nulls, self.own, self.which, self.types, self.seen, self.long_doc, self.long_hash, self.train = ids, nulls, own, which, types, seen, long_doc, long_hash, train

    @staticmethod
    def of(texts: list[bytes], ids: np.ndarray, nulls: np.ndarray, train: np.ndarray) -> Piece:
        held, parts, own, docs, hashes = [], [], [], [], []
        for lo, hi in c.pieces(texts, _CHUNK):
            s = Segments(texts[lo:hi])
            h, first, back = numbered(s.hashes())
            t = s.take(first)
            held.append((h, np.bincount(back, weights=train[lo:hi][s.doc], minlength=len(h)), t.size, t.kind, t.data))
            parts.append((h, back))
            own.append(np.bincount(s.doc, minlength=hi - lo))
            docs.append(s.long_doc + lo)
            hashes.append(s.long_hash)
        h, n, _, size, kind, data = merged_types(held)
        types = Types(data, size, kind)
        order = types.in_order()
        number = np.empty(len(order), dtype=np.int32)
        number[order] = np.arange(len(order))
        which = np.concatenate([number[np.searchsorted(h, x)][back] for x, back in parts])
        return Piece(ids, nulls, np.concatenate(own), which, types.some(order), n[order], np.concatenate(docs), np.concatenate(hashes), train)

    def written(self) -> tuple[bytes, bytes]:
        """The segments; and the documents."""
        t = self.types
        light = (t.size.astype(np.uint8), t.kind.astype(np.uint8), t.data, self.seen.astype("<i8"), self.long_hash, self.train[self.long_doc].astype(np.uint8))
        return squeezed(light), squeezed((self.ids, self.nulls, self.own.astype("<i4"), np.frombuffer(planes(self.which), np.uint8), self.long_doc.astype("<i4"), self.train.astype(np.uint8)))

    @staticmethod
    def read(types: bytes, body: bytes | None = None) -> Piece:
        size, kind, data, seen, long_hash, long_train = opened(types, ("u1", "u1", "u1", "<i8", "<u8", "u1"))
        t = Types(data, size.astype(np.int64), kind.astype(np.int64))
        none = np.empty(0, np.int64)
        if body is None:
            return Piece(none, none, none, none, t, seen, np.arange(len(long_hash)), long_hash, long_train)
        ids, nulls, own, which, long_doc, train = opened(body, ("<i8", "?", "<i4", "u1", "<i4", "u1"))
        return Piece(ids, nulls, own.astype(np.int64), unplaned(which, "<i4"), t, seen, long_doc, long_hash, train)

    def chunks(self, docs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Some documents at a time: their numbers, all their segments, and how many each has."""
        at = np.cumsum(self.own) - self.own
        many = np.cumsum(self.own[docs])
        for k in range(int(many[-1]) // _SEGMENTS + 1 if len(docs) else 0):
            part = docs[np.searchsorted(many, k * _SEGMENTS, side="right") if k else 0 : np.searchsorted(many, (k + 1) * _SEGMENTS, side="right")]
            if len(part):
                yield part, self.which[ranges(at[part], self.own[part])], self.own[part]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys of the longest contexts, and the distinct hashes of words."""
        deep = [np.empty(0, np.uint64), *(distinct(p.keys(p.symbols())[0]) for p in self.types.parts(_FEW))]
        return distinct(np.concatenate(deep)), distinct(np.concatenate([self.types.words()[1], self.long_hash]))


def squeezed(arrays: tuple[np.ndarray, ...]) -> bytes:
    raw = b"".join([np.array([len(arrays), *(x.nbytes for x in arrays)], "<i8").tobytes(), *(np.ascontiguousarray(x).tobytes() for x in arrays)])
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def opened(data: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int(np.frombuffer(data, "<i8", 1)[0]), "zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    size = np.frombuffer(raw, "<i8", n, 8)
    at = 8 * (n + 1) + np.cumsum(size) - size
    return [np.frombuffer(raw, kind, int(m) // np.dtype(kind).itemsize, int(a)) for kind, m, a in zip(kinds, size, at, strict=True)]


class Deep:
    """The answers to the longest contexts' keys: a level (0 for a context never seen) and an odds for each bit of the symbol."""

    def __init__(self, key: np.ndarray, level: np.ndarray, values: np.ndarray, t: Trees):
        self.key, self.level, self.values = key, level, values
        size = np.where(level > 0, t.sizes(*before_symbol(key)), 0)
        self.begin = np.cumsum(size) - size
        # keys are spread evenly: where those with the same first bits begin
        self.shift = np.uint64(max(52 - len(key).bit_length(), 0))
        self.first = np.append(0, np.cumsum(np.bincount((key >> self.shift).astype(np.int64)))) if len(key) else np.zeros(1, dtype=np.int64)

    def of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros(len(key), dtype=np.int64), self.values, np.zeros(len(key), dtype=np.int64)
        i = (key >> self.shift).astype(np.int64)
        i, many = self.first[i], self.first[i + 1] - self.first[i]
        rest = np.flatnonzero(many > 1)  # every key was asked for, so it is one of these
        many, key = many[rest], key[rest]
        while len(rest):  # by halves
            half = many >> 1
            above = self.key[i[rest] + half] <= key
            i[rest] += np.where(above, half, 0)
            many = np.where(above, many - half, half)
            still = np.flatnonzero(many > 1)
            rest, many, key = rest[still], many[still], key[still]
        return self.level[i].astype(np.int64), self.values, self.begin[i]


def before_symbol(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = (key & np.uint64((1 << 18) - 1)).astype(np.int64)
    return low >> 9, low & 511


# --- packing of sorted numbers --------------------------------------------------------------------


def packed(x: np.ndarray) -> bytes:
    """Sorted uint64 numbers as gaps, byte by byte, for the compression of files and shuffles."""
    return planes(np.diff(x, prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data, "<u8"), dtype=np.uint64)


def planes(x: np.ndarray) -> bytes:
    """First bytes of all numbers, then second bytes, and so on."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplaned(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.concatenate([x for x, _ in parts] or [np.empty(0, np.uint64)]), np.concatenate([n for _, n in parts] or [np.empty(0)]))


def by_shard(h: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shards and the places in h, in order, that belong to them."""
    shard = (c.mix(h) % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)
    order = np.argsort(shard, kind="stable")  # short numbers are sorted digit by digit
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cut)):
        yield int(s), order[cut[s] : cut[s + 1]]


def rows(kind: str, *columns) -> pa.RecordBatch:
    """A batch of columns named and typed like a Spark schema of int, long, double and binary."""
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    names, of = zip(*(x.split() for x in kind.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, types[t]) for x, t in zip(columns, of, strict=True)], names=list(names))


def table_of(kind: str, batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches or [rows(kind, *[[] for _ in kind.split(", ")])])


# --- what is gathered from the corpus ----------------------------------------------------------------

COUNTS = "word int, shard int, data binary"


def counts_written(key: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys and how often each occurs."""
    return squeezed((np.frombuffer(packed(key), np.uint8), np.frombuffer(planes(n.astype("<i8")), np.uint8)))


def counts_read(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    key, n = opened(data, ("u1", "u1"))
    return unpacked(key), unplaned(n, "<i8")


def types_written(t: Types, n: np.ndarray) -> bytes:
    order = t.in_order()
    t = t.some(order)
    return squeezed((np.frombuffer(planes(n[order].astype("<i8")), np.uint8), t.size.astype(np.uint8), t.kind.astype(np.uint8), t.data))


def types_read(data: bytes) -> tuple[np.ndarray, Types]:
    n, size, kind, text = opened(data, ("u1", "u1", "u1", "u1"))
    return unplaned(n, "<i8"), Types(text, size.astype(np.int64), kind.astype(np.int64))


def in_pieces(docs: DataFrame) -> DataFrame:
    """(piece, types, body), stored: docs (doc_id, text, train), each read once, in pieces of about PIECE_BYTES of text."""

    def rows_(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def piece():
            ids, texts, train = (pa.concat_arrays([x[k] for x in held]) for k in range(3))
            nulls = np.asarray(ids.is_null())
            texts = [t or b"" for t in c.binary(texts)]
            return rows("piece long, types binary, body binary", [number], *([x] for x in Piece.of(texts, ids.fill_null(0).to_numpy(), nulls, train.to_numpy(zero_copy_only=False)).written()))

        for batch in batches:
            sizes = [len(t or b"") for t in c.binary(batch.column(1))]
            lo = 0
            for hi in range(1, len(sizes) + 1):
                size += sizes[hi - 1]
                if size >= PIECE_BYTES:
                    held.append(batch.slice(lo, hi - lo).columns)
                    yield piece()
                    number, held, size, lo = number + 1, [], 0, hi
            if lo < len(sizes):
                held.append(batch.slice(lo).columns)
        if held:
            yield piece()

    return c.stored(docs.select("doc_id", "text", "train").mapInArrow(c.lean(rows_), "piece long, types binary, body binary"))


def type_counts(pieces: DataFrame, shards: int) -> DataFrame:
    """COUNTS: exact counts of all segments (word 0, with their bytes), and of all lower-cased words (word 1), of the training documents of pieces, by shards."""

    def count(batches):
        held, words, many = [], [], 0

        def flush():
            h, n, _, size, kinds, data = merged_types(held)
            t = Types(data, size, kinds)
            for s, i in by_shard(h, shards):
                yield rows(COUNTS, [0], [s], [types_written(t.some(i), n[i])])
            key, n = added(words)
            for s, i in by_shard(key, shards):
                yield rows(COUNTS, [1], [s], [counts_written(key[i], n[i])])

        for batch in batches:
            for data in batch.column("types").to_pylist():
                p = Piece.read(data)
                own = np.flatnonzero(p.seen)
                t = p.types.some(own)
                held.append((t.hashes(), p.seen[own], t.size, t.kind, t.data))
                which, h = p.types.words()
                seen = p.seen[which] > 0
                words.append(added([(h[seen], p.seen[which][seen]), (p.long_hash[p.train > 0], np.ones(int((p.train > 0).sum())))]))
                many += len(own)
                if many > 1_500_000:
                    yield from flush()
                    held, words, many = [], [], 0
        if held:
            yield from flush()

    def merge(key, tab):
        word, s, data = key[0].as_py(), key[1].as_py(), tab.column("data").to_pylist()
        if word:
            return pa.Table.from_batches([rows(COUNTS, [1], [s], [counts_written(*added([counts_read(x) for x in data]))])])
        _, n, _, size, kinds, text = merged_types([(t.hashes(), n, t.size, t.kind, t.data) for n, t in map(types_read, data)])
        return pa.Table.from_batches([rows(COUNTS, [0], [s], [types_written(Types(text, size, kinds), n)])])

    return pieces.select("types").mapInArrow(c.lean(count), COUNTS).groupBy("word", "shard").applyInArrow(merge, COUNTS)


def merged_types(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    h, n, size, kind, data = (np.concatenate(x) for x in zip(*parts, strict=True))
    own, first, back = numbered(h)
    at = np.cumsum(size) - size
    return own, np.bincount(back, weights=n, minlength=len(own)).astype("<i8"), first, size[first], kind[first], data[ranges(at[first], size[first])]


def each_type(batches) -> Iterator[tuple[np.ndarray, Types]]:
    """Counts and segments of rows of COUNTS of word 0, a part at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            n, types = types_read(batch.column("data")[i].as_py())
            for k, part in enumerate(types.parts()):
                yield n[k * _TYPES : (k + 1) * _TYPES], part


def pair_counts(types: DataFrame) -> np.ndarray:
    """How often each symbol follows each; at most BEFORE * SYMBOLS numbers reach the driver."""

    def count(batches):
        total = np.zeros(BEFORE * SYMBOLS)
        for n, t in each_type(batches):
            s = t.symbols()
            total += np.bincount(s.before[0] * SYMBOLS + s.symbol, weights=n[s.owner], minlength=len(total))
        i = np.flatnonzero(total)
        yield rows("i int, n long", i.astype(np.int32), total[i].astype(np.int64))

    out = np.zeros(BEFORE * SYMBOLS, dtype=np.int64)
    for i, n in types.mapInArrow(c.lean(count), "i int, n long").groupBy("i").agg(F.sum("n")).collect():
        out[i] = n
    return out.reshape(BEFORE, SYMBOLS)


def short_odds(types: DataFrame, t: Trees) -> list[np.ndarray]:
    """Odds of the contexts of two and three symbols in 2**SLOTS cells each, summed by slices of cells."""
    step = 1 << (SLOTS - 6)

    def count(batches):
        for n, part in each_type(batches):
            s = part.symbols()
            owner, way = t.paths(s.before[0], s.symbol)
            for k in (2, 3):
                own, many = summed(slots(s.context(k)[owner], t.node[way]) * 2 + t.bit[way], n[s.owner[owner]])
                cut = np.searchsorted(own, np.arange(0, (2 << SLOTS) + 1, 2 * step).astype(np.uint64))
                for j in np.flatnonzero(np.diff(cut)):
                    own_, many_ = own[cut[j] : cut[j + 1]], many[cut[j] : cut[j + 1]]
                    yield rows("k int, slice int, cells binary, counts binary", [k], [j], [packed(own_ - np.uint64(2 * step * j))], [planes(many_)])

    def merge(key, tab):
        total = np.zeros(2 * step)
        for cells, n in zip(tab.column("cells").to_pylist(), tab.column("counts").to_pylist(), strict=True):
            total[unpacked(cells).astype(np.int64)] += unplaned(n, "<i8")
        return pa.Table.from_batches([rows("k int, slice int, odds binary", [key[0].as_py()], [key[1].as_py()], [odds_of(total[0::2], total[1::2]).tobytes()])])

    out = [np.zeros(1 << SLOTS, dtype=np.int8) for _ in range(2)]
    found = types.mapInArrow(c.lean(count), "k int, slice int, cells binary, counts binary").groupBy("k", "slice").applyInArrow(merge, "k int, slice int, odds binary")
    for k, j, data in found.toLocalIterator():
        out[k - 2][j * step : (j + 1) * step] = np.frombuffer(data, dtype=np.int8)
    return out


def deep_counts(types: DataFrame, shards: int) -> DataFrame:
    """COUNTS with word 0: how often each symbol follows each segment so far, exact, by shards of contexts."""

    def count(batches):
        held = []
        for n, t in each_type(batches):
            s = t.symbols()
            key, which = t.keys(s)
            held.append(added([(key, n[s.owner[which]])]))
        key, n = added(held)
        for s, i in by_shard(key >> np.uint64(9), shards):
            yield rows(COUNTS, [0], [s], [counts_written(key[i], n[i])])

    def merge(key, tab):
        return pa.Table.from_batches([rows(COUNTS, [0], [key[0].as_py()], [counts_written(*added([counts_read(x) for x in tab.column("data").to_pylist()]))])])

    return types.mapInArrow(c.lean(count), COUNTS).groupBy("shard").applyInArrow(merge, COUNTS)


class Answers:
    """What a shard knows of its contexts. key, n: sorted keys, and how often."""

    def __init__(self, key: np.ndarray, n: np.ndarray, t: Trees):
        self.key, self.n, self.trees = key, n, t
        context = key >> np.uint64(9)
        at = firsts(context)
        self.context, number = context[at], np.repeat(np.arange(len(at)), np.diff(np.append(at, len(key))))
        self.total = np.bincount(number, weights=n, minlength=len(self.context))
        self.kinds = np.bincount(number, minlength=len(self.context))
        owner, way = t.paths(*before_symbol(key))
        cell, many = summed((number[owner] * 512 + t.node[way]) * 2 + t.bit[way], n[owner])
        cell = cell.astype(np.int64)
        at = firsts(cell >> 1)
        self.node, self.both = cell[at] >> 1, np.zeros((2, len(at)))
        self.both[cell & 1, np.repeat(np.arange(len(at)), np.diff(np.append(at, len(cell))))] = many

    def of(self, asked: np.ndarray, less: int) -> tuple[np.ndarray, np.ndarray]:
        """Levels of the asked keys and the odds of their bits. less: occurrences of each asked key to leave out."""
        t = self.trees
        if not len(self.key) or not len(asked):
            return np.zeros(len(asked), np.uint8), np.empty(0, np.int8)
        i = np.minimum(np.searchsorted(self.context, asked >> np.uint64(9)), len(self.context) - 1)
        hit = self.context[i] == asked >> np.uint64(9)
        seen, kinds = np.where(hit, self.total[i] - less, 0), self.kinds[i]
        if less:  # a symbol seen only where it is left out is none
            j = np.minimum(np.searchsorted(self.key, asked), len(self.key) - 1)
            kinds = kinds - ((self.key[j] == asked) & (self.n[j] <= less))
        level = np.select([seen < 1, seen < 2, seen < 4, seen < 16], [0, 1, 2, 3], 4)
        level = (level + np.where((level > 0) & (kinds == 1), 4, 0)).astype(np.uint8)
        want = np.flatnonzero(level)
        owner, way = t.paths(*before_symbol(asked[want]))
        at = i[want][owner] * 512 + t.node[way]
        place = np.minimum(np.searchsorted(self.node, at), len(self.node) - 1)
        met = self.node[place] == at
        n0, n1 = (x[place] * met for x in self.both)
        if less:
            bit = t.bit[way]
            n0, n1 = np.maximum(n0 - less * (1 - bit.astype(np.int8)), 0), np.maximum(n1 - less * bit.astype(np.int8), 0)
        return level, odds_of(n0, n1)


# --- pieces of texts -------------------------------------------------------------------------------


def answered(pieces: DataFrame, counts: DataFrame, shards: int, held: Broadcast, less: int = 0, made: Callable = iter) -> DataFrame:
    """(word, shard, piece, data): what the shards know of the distinct keys of each piece, in the order of the keys, so that only levels, odds and counts travel back.

    made: makes batches of pieces from those of the table, in the same step: a step of its own would have its own workers, which then stay and hold memory.
    """

    def ask(batches):
        for batch in made(batches):
            for piece, data in zip(batch.column("piece").to_pylist(), batch.column("types").to_pylist(), strict=True):
                for word, key in enumerate(Piece.read(data).keys()):
                    for s, i in by_shard(key if word else key >> np.uint64(9), shards):
                        yield rows("word int, shard int, piece long, keys binary", [word], [s], [piece], [packed(key[i])])

    def answer(key, left, right):
        word, s, out = key[0].as_py(), key[1].as_py(), []
        known = right.column("data").to_pylist()
        k, n = counts_read(known[0]) if known else (np.empty(0, np.uint64), np.empty(0, np.int64))
        shard = None if word else Answers(k, n, held.value.trees)
        for piece, own in zip(left.column("piece").to_pylist(), left.column("keys").to_pylist(), strict=True):
            own = unpacked(own)
            if word:
                i = np.minimum(np.searchsorted(k, own), max(len(k) - 1, 0))
                found = (np.frombuffer(planes(np.where(k[i] == own, n[i], 0).astype("<i8") if len(k) else np.zeros(len(own), "<i8")), np.uint8),)
            else:
                found = shard.of(own, less)
            out.append(rows(kind, [word], [s], [piece], [squeezed(found)]))
        c.release()
        return table_of(kind, out)

    kind = "word int, shard int, piece long, data binary"
    asked = pieces.mapInArrow(c.lean(ask), "word int, shard int, piece long, keys binary")
    return asked.groupBy("word", "shard").cogroup(counts.groupBy("word", "shard")).applyInArrow(answer, kind)


def over_pieces(pieces: DataFrame, answers: DataFrame, shards: int, held: Broadcast, f: Callable, kind: str) -> DataFrame:
    """f(piece, deep, words, n) for each piece with its answers: n are the counts of the piece's words."""

    def run(key, left, right):
        t = held.value.trees
        got = {(w, s): opened(x, ("u1",) if w else ("u1", "i1")) for w, s, x in zip(*(right.column(k).to_pylist() for k in ("word", "shard", "data")), strict=True)}
        piece = Piece.read(left.column("types")[0].as_py(), left.column("body")[0].as_py())
        keys, words = piece.keys()
        level, n, parts = np.zeros(len(keys), dtype=np.uint8), np.zeros(len(words), dtype=np.int64), []
        for s, i in by_shard(keys >> np.uint64(9), shards):
            level[i] = got[0, s][0]
            parts.append((i, got[0, s][1]))
        size = np.where(level > 0, t.sizes(*before_symbol(keys)), 0)
        begin, values = np.cumsum(size) - size, np.zeros(int(size.sum()), dtype=np.int8)
        for i, x in parts:
            values[ranges(begin[i], size[i])] = x
        for s, i in by_shard(words, shards):
            n[i] = unplaned(got[1, s][0], "<i8")
        out = f(piece, Deep(keys, level, values, t), words, n)
        c.release()
        return out

    return pieces.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(run, kind)


def share(rows: int) -> float:
    """The part of so many training texts that the first weights are learnt on: all of them."""
    return 1.0


def slopes(odds: np.ndarray, gate: np.ndarray, times: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Cost of so many bits of each row of odds, its four slopes by the weights, and the ten second ones. Sums are over whole columns, which is much faster than over rows of four."""
    out = np.empty((15, len(odds)))
    x = odds.view(np.int8).reshape(-1, 4).T.astype(np.float64, order="C")
    x *= (2.0 / UNIT) * (gate & 1) - 1 / UNIT  # of the bit that is met
    g = gate >> 1
    z = x[0] * weights[g, 0]
    for k in range(1, 4):
        z += x[k] * weights[g, k]
    against = np.exp(-np.clip(z, -LIMIT, LIMIT, out=z))
    out[0] = times * np.log1p(against)
    other = against / (1 + against)
    np.multiply(x, times * other, out=out[1:5])
    bent = out[1:5] * (1 - other)
    for i, (j, k) in enumerate(zip(*_UPPER, strict=True)):
        np.multiply(bent[j], x[k], out=out[5 + i])
    return out


def learnt(types: DataFrame, counts: DataFrame, shards: int, held: Broadcast) -> np.ndarray:
    """Weights with the least cost of all bits of all training texts, found by Newton's steps for each gate; a step that does not help is halved.

    types: rows of COUNTS of word 0. Their segments meet the longest contexts as pieces do; what an occurrence itself adds to these is left out, as for texts never seen.
    Equal rows of odds are counted once and stored; a step is a sum over these, some 20 numbers a gate.
    """

    def alone(batches):
        for batch in batches:
            for s, data in zip(batch.column("shard").to_pylist(), batch.column("data").to_pylist(), strict=True):
                n, t = types_read(data)
                yield rows("piece long, types binary, body binary", [s], [squeezed((t.size.astype(np.uint8), t.kind.astype(np.uint8), t.data, n, np.empty(0, "<u8"), np.empty(0, np.uint8)))], [None])

    def cells(piece, deep, words, n):
        odds, gate, many = held.value.features(piece.types, deep)
        cell, times = summed(odds.view(np.uint32).ravel() | gate.astype(np.uint64) << np.uint64(32), np.repeat(piece.seen, many))
        return pa.Table.from_batches([rows("data binary", [squeezed((np.frombuffer(packed(cell), np.uint8), np.frombuffer(planes(times.astype("<i8")), np.uint8)))])])

    own = types.select("shard", "data")
    pieces = own.mapInArrow(c.lean(alone), "piece long, types binary, body binary")
    found = c.stored(over_pieces(pieces, answered(own, counts, shards, held, less=1, made=alone), shards, held, cells, "data binary"))
    best, least, step = np.full((GATES, 4), 0.3), np.full(GATES, np.inf), np.zeros((GATES, 4))
    for _ in range(NEWTON):

        def sums(batches, weights=best + step):
            total = np.zeros((15, GATES))
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    cell, times = counts_read(data)
                    for a in range(0, len(cell), _FEW):
                        gate = (cell[a : a + _FEW] >> np.uint64(32)).astype(np.uint8)  # in order
                        at = firsts(gate >> 1)
                        own = gate[at] >> 1
                        total[:, own] += np.add.reduceat(slopes(cell[a : a + _FEW].astype(np.uint32), gate, times[a : a + _FEW], weights), at, axis=1)
            total = total.ravel()
            yield rows("i int, x double", np.arange(len(total), dtype=np.int32), total)

        total = np.zeros(GATES * 15)
        for i, v in found.mapInArrow(c.lean(sums), "i int, x double").groupBy("i").agg(F.sum("x")).collect():
            total[i] = v
        total = total.reshape(15, GATES)
        for g in range(GATES):
            if total[0, g] <= least[g]:
                best[g] += step[g]
                least[g] = total[0, g]
                bend = np.zeros((4, 4))
                bend[_UPPER] = total[5:, g]
                step[g] = np.linalg.solve(bend + np.triu(bend, 1).T + np.eye(4), total[1:5, g])
            else:
                step[g] /= 2
    return np.round(best, 5).astype(np.float32)  # sums may differ in their last digits with the order of rows


@dataclass
class Fitted:
    """A model with its counts by shards, ready to score pieces."""

    held: Broadcast
    weights: np.ndarray
    counts: DataFrame
    shards: int
    ends: int
    total: int
    distinct: int


def fit(docs: DataFrame, pieces: DataFrame) -> Fitted:
    """docs: doc_id, text, train; pieces: the same as pieces. All training documents are counted whole, and the first weights come from all of them."""
    train = docs.where("train")
    ends, letters = train.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(c.width(docs), math.ceil(letters / SHARD_BYTES))
    both = c.stored(type_counts(pieces, shards))
    types = both.where("word = 0")
    pairs = pair_counts(types)
    t = trees(pairs)
    owner, way = t.paths(np.repeat(np.arange(BEFORE), SYMBOLS), np.tile(np.arange(SYMBOLS), BEFORE))
    cell = (np.repeat(np.arange(BEFORE), SYMBOLS)[owner] * 512 + t.node[way]) * 2 + t.bit[way]
    n01 = np.bincount(cell, weights=pairs.ravel()[owner], minlength=BEFORE * 1024).reshape(-1, 2)
    held = docs.sparkSession.sparkContext.broadcast(Model(t, odds_of(n01[:, 0], n01[:, 1]), *short_odds(types, t)))
    words = both.where("word = 1")
    counts = c.stored(deep_counts(types, shards).unionByName(words))

    def sizes(batches):
        for batch in batches:
            n = [counts_read(x)[1] for x in batch.column(0).to_pylist()]
            yield rows("n long, v long", [int(x.sum()) for x in n], [len(x) for x in n])

    total, distinct = words.select("data").mapInArrow(c.lean(sizes), "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    return Fitted(held, learnt(types, counts, shards, held), counts, shards, ends, total + ends, distinct + (ends > 0))


def score(docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score): one row for each id; rows that share an id, null included, add up.

    Learns from the rows for which train holds, null being no. Null texts are empty; an empty
    text has one token, its end. With no training rows every count is 0 and every bit costs about one bit.
    Only the two named columns, and those of train, are read. An empty table gives an empty table.
    """
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    pieces = in_pieces(docs)
    m = fit(docs, pieces)
    below = math.log10(m.total + 0.5 * (m.distinct + 1))
    end, known_end, weights, held = math.log10(m.ends + 0.5), int(m.ends > 0), m.weights, m.held
    kind = "doc_id long, n_tokens long, n_known long, base double, score double"

    def scores(piece, deep, words, n):
        which, h = piece.types.words()
        of_type = np.full(len(piece.types.size), -1, dtype=np.int64)  # count of the type's word; -1: no word
        of_type[which] = n[np.searchsorted(words, h)]
        long = n[np.searchsorted(words, piece.long_hash)] if len(piece.long_hash) else np.empty(0, np.int64)
        tokens, known, base = np.ones(len(piece.ids), dtype=np.int64), np.full(len(piece.ids), known_end, dtype=np.int64), np.full(len(piece.ids), end)
        for part, own, many in piece.chunks(np.arange(len(piece.ids))):
            count = of_type[own]
            at = np.cumsum(many) - many
            tokens[part] += np.add.reduceat((count >= 0).astype(np.int64), at)
            known[part] += np.add.reduceat((count > 0).astype(np.int64), at)
            base[part] += np.add.reduceat(np.where(count >= 0, np.log10(np.maximum(count, 0) + 0.5), 0.0), at)
        np.add.at(tokens, piece.long_doc, 1)
        np.add.at(known, piece.long_doc, (long > 0).astype(np.int64))
        np.add.at(base, piece.long_doc, np.log10(long + 0.5))
        return pa.table({"doc_id": pa.array(piece.ids, mask=piece.nulls), "n_tokens": tokens, "n_known": known, "base": base, "score": held.value.costs(piece, deep, weights)})

    answers = answered(pieces.select("piece", "types"), m.counts, m.shards, held)
    found = over_pieces(pieces, answers, m.shards, held, scores, kind).groupBy("doc_id").agg(*(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")))
    return found.select("doc_id", "n_tokens", "n_known", F.lit(m.total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(below)).alias("base_score"), "score")
