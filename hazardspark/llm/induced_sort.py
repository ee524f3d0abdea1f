"""Suffix order and common-prefix lengths of a text on disk, by external induced sorting.

The text is bytes from 1 to 0xFE and a 0 at its end, in a mapped file. Its S* suffixes (those that begin where the text
turns upward) are named by their stretch up to the next one; where names repeat, the string of names is sorted by the
same rule, recursively. From the order of the S* suffixes all others are induced: first the falling (L) suffixes
upward, then the rising (S) ones downward. An induction is a priority queue of tuples (position, up to eight bytes before
it, length of the prefix shared with the tuple before it in its bucket). Its priority is (first byte, arrival), so it is a queue for each byte, each of which goes to
disk beyond a bound. A tuple pops, and pushes the suffix one byte to its left. Prefix lengths travel along: the new one is one more than the least
between the two tuples that pushed, and stops counting at `most`.
Arrays that grow with the text are mapped files once they are large; what is in memory is a batch.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

ITEM = np.dtype([("pos", "<i8"), ("pre", "<u8"), ("left", "u1"), ("lcp", "u1")])
BATCH = 1 << 18
HELD = 64 << 20
PART = 1 << 21
SMALL = 8 << 20


def scratch() -> tempfile.TemporaryDirectory:
    """A folder of this task's own beside Spark's spill files; it goes with the task, which starts anew if it is lost."""
    at = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryDirectory(prefix="suffixes-", dir=at if at and os.path.isdir(at) else None)


class Folder:
    def __init__(self, path: str):
        self.path, self.n = path, 0

    def name(self) -> str:
        self.n += 1
        return os.path.join(self.path, str(self.n))

    def array(self, n: int, dtype) -> np.ndarray:
        """In memory below SMALL bytes, else on disk."""
        return np.memmap(self.name(), dtype=dtype, mode="w+", shape=(n,)) if n * np.dtype(dtype).itemsize > SMALL else np.zeros(n, dtype)


class Queues:
    """Tuples by first byte, in order of arrival; the oldest of the fullest queue go to disk when more than HELD bytes wait."""

    def __init__(self, folder: Folder, held: int = 0):
        self.memory: list[list[np.ndarray]] = [[] for _ in range(256)]
        self.files: list[list[tuple[str, int]]] = [[] for _ in range(256)]
        self.size, self.most, self.total, self.folder = [0] * 256, held or HELD, 0, folder

    def push(self, b: int, items: np.ndarray) -> None:
        self.memory[b].append(items)
        self.size[b] += items.nbytes
        self.total += items.nbytes
        if self.total > self.most:
            full = int(np.argmax(self.size))
            path = self.folder.name()
            np.concatenate(self.memory[full]).tofile(path)
            self.files[full].append((path, self.size[full]))
            self.memory[full], self.total, self.size[full] = [], self.total - self.size[full], 0

    def pop(self, b: int) -> Iterator[np.ndarray]:
        """All that waits in b, in batches, also what arrives meanwhile."""
        while self.files[b] or self.memory[b]:
            if self.files[b]:
                path, size = self.files[b].pop(0)
                for at in range(0, size, BATCH * ITEM.itemsize):
                    yield np.fromfile(path, ITEM, min(BATCH, (size - at) // ITEM.itemsize), offset=at)
                os.remove(path)
            else:
                own, self.memory[b] = self.memory[b], []
                self.total -= self.size[b]
                self.size[b] = 0
                for at in slices(own):
                    yield at

    def stacked(self, b: int) -> Iterator[np.ndarray]:
        """All of b, the last to arrive first."""
        for at in reversed(list(slices(self.memory[b]))):
            yield at[::-1]
        for path, size in reversed(self.files[b]):
            for end in range(size, 0, -BATCH * ITEM.itemsize):
                at = max(0, end - BATCH * ITEM.itemsize)
                yield np.fromfile(path, ITEM, (end - at) // ITEM.itemsize, offset=at)[::-1]
            os.remove(path)
        self.total -= self.size[b]
        self.memory[b], self.files[b], self.size[b] = [], [], 0


def slices(arrays: list[np.ndarray]) -> Iterator[np.ndarray]:
    if arrays:
        whole = arrays[0] if len(arrays) == 1 else np.concatenate(arrays)
        for at in range(0, len(whole), BATCH):
            yield whole[at : at + BATCH]


# --- names and the order of the S* suffixes ---------------------------------------------------


def turns(s: np.ndarray, folder: Folder) -> np.ndarray:
    """S* positions of a string that ends in its only least symbol: where it fell last and rises next, and its end."""
    found, before = [], np.empty(0, np.int64)
    for lo in range(0, len(s) - 1, PART):
        part = np.asarray(s[lo : lo + PART + 1])
        change = np.flatnonzero(part[1:] != part[:-1]) + lo
        change = np.concatenate([before, change])
        if len(change):
            up = np.asarray(s[change + 1]) > np.asarray(s[change])
            found.append(change[:-1][~up[:-1] & up[1:]] + 1)
            before = change[-1:]
    found.append(np.array([len(s) - 1]))
    total = np.concatenate(found)
    out = folder.array(len(total), np.int64)
    out[:] = total
    return out


def split(rank: np.ndarray, sub: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Refine the ranks of sub by key, in place; ranks are places where a group begins. Returns those that still share one."""
    order = np.lexsort((key, rank[sub]))
    sub, key = sub[order], key[order]
    old = np.asarray(rank[sub])
    first = np.ones(len(sub), dtype=bool)
    first[1:] = old[1:] != old[:-1]
    new = first.copy()
    new[1:] |= key[1:] != key[:-1]
    start = np.flatnonzero(first)[np.cumsum(first) - 1]
    head = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    rank[sub] = old + head[which] - start
    return sub[np.diff(np.append(head, len(sub)))[which] > 1]


def parts(key: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of key in ranges of its values, upward, so that one range at a time is sorted; equal values stay together."""
    n = len(key)
    if n <= PART:
        yield np.arange(n)
        return
    sample = np.sort(np.asarray(key[:: max(1, n // 100_000)]))
    cut = np.unique(sample[:: max(1, len(sample) * PART // n)][1:])
    for k in range(len(cut) + 1):
        own = []
        for lo in range(0, n, PART):
            place = np.searchsorted(cut, key[lo : lo + PART], side="right")
            own.append(np.flatnonzero(place == k) + lo)
        yield np.concatenate(own)


def ranks_of(key: np.ndarray, folder: Folder) -> tuple[np.ndarray, np.ndarray]:
    """The place where each key's group begins in their order, and those that share a key."""
    rank, done, tied = folder.array(len(key), np.int64), 0, []
    for idx in parts(key):
        rank[idx] = done
        tied.append(split(rank, idx, np.asarray(key[idx])))
        done += len(idx)
    return rank, np.concatenate(tied)


def words_of(text: np.ndarray) -> np.ndarray:
    """text has eight bytes more at either end; item p is the eight bytes before text position p."""
    return np.ndarray((len(text) - 7,), dtype=">u8", buffer=text, strides=(1,))


def names(text: np.ndarray, stars: np.ndarray, folder: Folder) -> tuple[np.ndarray, bool]:
    """A name for each S* stretch, ordered as these are; whether all differ. A stretch that ends is above one that goes on."""
    words, m = words_of(text), len(stars)
    length = folder.array(m, np.int64)
    length[:-1] = stars[1:] - stars[:-1] + 1
    length[-1] = 1

    def at(i: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(np.asarray(length[i]) - depth, 0, 8)
        pad = np.array([(1 << 8 * (8 - k)) - 1 for k in range(9)], dtype=np.uint64)[left]
        full = left > 0
        out = np.full(len(i), np.uint64(2**64 - 1))
        out[full] = words[np.asarray(stars[i[full]]) + depth + 8].astype(np.uint64) | pad[full]
        return out

    key = folder.array(m, np.uint64)
    for lo in range(0, m, PART):
        key[lo : lo + PART] = at(np.arange(lo, min(m, lo + PART)), 0)
    rank, tied = ranks_of(key, folder)
    apart, depth = m - len(tied), 8
    while len(tied):
        on = np.asarray(length[tied]) >= depth
        before = int(on.sum())
        tied = split(rank, tied[on], at(tied[on], depth))
        apart += before - len(tied)
        depth += 8
    return rank, apart == m


def order(s: np.ndarray, folder: Folder) -> np.ndarray:
    """The rank of every suffix of a string of numbers that ends in its only least one, by induction from its S* suffixes."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    stars = turns(s, folder)
    change = np.flatnonzero(np.asarray(s[1:]) != np.asarray(s[:-1]))
    up = np.asarray(s[change + 1]) > np.asarray(s[change])
    rising = np.ones(n, dtype=bool)
    rising[:-1] = up[np.searchsorted(change, np.arange(n - 1))]
    # names of the S* stretches, as far as they tie
    m, length = len(stars), np.append(np.diff(stars) + 1, 1)
    name, tied = ranks_of(np.asarray(s[stars]), folder)
    depth = 1
    while len(tied):
        on = length[tied] >= depth
        on = tied[on]
        inside = length[on] > depth
        key = np.full(len(on), np.iinfo(np.int64).max)
        key[inside] = s[np.asarray(stars[on[inside]]) + depth]
        tied = split(name, on, key)
        depth += 1
    seen = np.sort(np.asarray(name))
    star_rank = order(name, folder) if (seen[1:] == seen[:-1]).any() else name
    # falling suffixes, from those to their right: falling or S*
    falls = np.flatnonzero(~rising)
    some = np.concatenate([falls, np.asarray(stars)])
    kind = np.concatenate([np.zeros(len(falls), np.int64), 1 + np.asarray(star_rank)])
    cur = folder.array(n, np.int64)
    _start(cur, some, np.asarray(s[some]), kind)
    _settle(cur, falls[_shared(cur[some])[: len(falls)]])
    # rising suffixes, from falling or rising ones
    kind = np.where(rising, n, np.asarray(cur))
    _start(cur, np.arange(n), np.asarray(s), kind)
    _settle(cur, np.flatnonzero(rising & _shared(np.asarray(cur))))
    return cur


def _start(cur: np.ndarray, some: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
    order_ = np.lexsort((second, first))
    a, b = first[order_], second[order_]
    new = np.ones(len(some), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    cur[some[order_]] = np.flatnonzero(new)[np.cumsum(new) - 1]


def _shared(rank: np.ndarray) -> np.ndarray:
    many = np.bincount(rank)
    return many[rank] > 1


def _settle(cur: np.ndarray, tied: np.ndarray) -> None:
    """Ranks from those of the suffixes to the right, twice as far each time."""
    step = 1
    while len(tied):
        tied = split(cur, tied, np.asarray(cur[tied + step]))
        step *= 2


# --- induction of all suffixes ------------------------------------------------------------------


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffixes at a and b share, most at the most."""
    words, out = words_of(text), np.full(len(a), most, dtype=np.uint8)
    here, depth, end = np.arange(len(a)), 0, len(text) - 8
    while len(here) and depth < most:
        x, y = a[here] + depth + 8, b[here] + depth + 8
        differ = words[np.minimum(x, end)].astype(np.uint64) ^ words[np.minimum(y, end)].astype(np.uint64)
        stop = differ != 0
        bits = np.frexp((differ[stop] >> np.uint64(11)).astype(np.float64))[1] + 11
        bits[differ[stop] < 2048] = 8  # within the last byte or two: looked at one by one
        small = np.flatnonzero(differ[stop] < 2048)
        bits[small] = [int(t).bit_length() for t in differ[stop][small]]
        out[here[stop]] = np.minimum(most, depth + (64 - bits) // 8)
        here, depth = here[~stop], depth + 8
    return out


class Induction:
    """One direction: what has been pushed, and the least shared prefix since the last push to each queue."""

    def __init__(self, text: np.ndarray, folder: Folder, most: int, held: int):
        self.text, self.words, self.most = text, words_of(text), most
        self.queues = Queues(folder, held)
        self.least, self.begun = np.full(256, 255, dtype=np.uint8), np.zeros(256, dtype=bool)

    def items(self, pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        out = np.empty(len(pos), ITEM)
        out["pos"], out["lcp"] = pos, lcp
        out["left"], out["pre"] = 0, 0
        return out

    def scan(self, batch: np.ndarray, low: int, high: int) -> None:
        """Push the left neighbours of the batch whose first byte is from low to high."""
        pos, pre, left, lcp = (batch[k].copy() for k in ("pos", "pre", "left", "lcp"))
        dry = np.flatnonzero((left == 0) & (pos > 0))
        if len(dry):
            dry = dry[np.argsort(pos[dry])]  # the text is read forward
            pre[dry] = self.words[pos[dry]]
            left[dry] = np.minimum(8, pos[dry])
        prev = (pre & np.uint64(255)).astype(np.uint8)
        idx = np.flatnonzero((pos > 0) & (prev >= low) & (prev <= high))
        by = np.argsort(prev[idx], kind="stable")
        idx = idx[by]
        target = prev[idx]
        edge = np.flatnonzero(np.diff(target, prepend=-1, append=-1) if len(target) else np.empty(0))
        every = np.minimum.accumulate(lcp)
        if len(idx):
            low_, high_ = np.zeros(len(idx), np.int64), idx + 1
            low_[1:] = idx[:-1] + 1
            low_[edge[:-1]] = 0
            shared = ranges(lcp, low_, high_)
            for a in edge[:-1].tolist():
                t = target[a]
                shared[a] = min(shared[a], self.least[t]) if self.begun[t] else 255
            new = np.empty(len(idx), ITEM)
            new["pos"], new["pre"], new["left"] = pos[idx] - 1, pre[idx] >> np.uint64(8), left[idx] - 1
            new["lcp"] = np.minimum(shared, self.most - 1) + 1
        self.least = np.minimum(self.least, every[-1])
        if len(idx):
            after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], 255)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                t = int(target[a])
                if not self.begun[t]:
                    new["lcp"][a] = 0
                self.begun[t] = True
                self.least[t] = after[idx[b - 1] + 1]
                self.queues.push(t, new[a:b])


def ranges(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(x[low:high]) of each pair, by minima over powers of two."""
    size = high - low
    level = np.frexp(size.astype(np.float64))[1] - 1
    out, table = np.empty(len(low), x.dtype), x
    for k in range(int(level.max()) + 1):
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k)])
        if len(table) > 1 << k:
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


def suffixes(text: np.ndarray, folder: Folder, most: int = 200, held: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, shared): all suffixes downward, each with the bytes it shares with the one before, most at the most; text as in words_of."""
    plain = text[8:-8]
    stars = turns(plain, folder)
    name, apart = names(text, stars, folder)
    rank = name if apart else order(name, folder)
    seeds = folder.array(len(stars), np.int64)
    for lo in range(0, len(stars), PART):
        seeds[np.asarray(rank[lo : lo + PART])] = stars[lo : lo + PART]
    begin = np.searchsorted(_First(plain, seeds), np.arange(257))
    falling = Induction(text, folder, most, held)
    kept = Queues(folder, held)
    pair = lambda a, b: common(text, np.array([a]), np.array([b]), most)[0]
    for c in range(256):
        last = None
        for batch in falling.queues.pop(c):
            kept.push(c, batch)
            falling.scan(batch, c, 255)
            last = batch["pos"][-1]
        for lo in range(int(begin[c]), int(begin[c + 1]), BATCH):
            pos = np.asarray(seeds[lo : min(lo + BATCH, begin[c + 1])])
            ahead = np.asarray(seeds[lo - 1 : lo - 1 + len(pos)]) if lo > begin[c] else np.append(pos[:1], pos[:-1])
            lcp = common(text, ahead, pos, most)
            if lo == begin[c]:
                lcp[0] = 0 if last is None else pair(last, pos[0])
            falling.scan(falling.items(pos, lcp), c + 1, 255)
    rising = Induction(text, folder, most, held)
    for c in range(255, -1, -1):
        last = None
        for batch in rising.queues.pop(c):
            yield batch["pos"], batch["lcp"]
            rising.scan(batch, 0, c)
            last = batch["pos"][-1]
        shared = None
        for batch in kept.stacked(c):
            batch = batch.copy()
            up = batch["lcp"].copy()
            if shared is None:
                shared = 0 if last is None else pair(last, batch["pos"][0])
            batch["lcp"][1:] = up[:-1]
            batch["lcp"][0] = shared
            shared = up[-1]
            yield batch["pos"], batch["lcp"]
            rising.scan(batch, 0, c - 1)


class _First:
    """First bytes of sorted suffixes, for a binary search."""

    def __init__(self, text: np.ndarray, at: np.ndarray):
        self.text, self.at = text, at

    def __array__(self, dtype=None, copy=None):
        return np.asarray(self.text[np.asarray(self.at)], dtype=dtype)
