"""SentencePiece encoding by a relational lattice and a Viterbi fold, and decoding.

A text is cut before each run of spaces, and its words wherever two characters meet
that are side by side in no piece. No piece crosses such a place,
so a segment can be encoded by itself, once for each batch of documents. The
lattice of all segments of a batch is made set-wise: their substrings of at most the
longest piece's length are joined to the piece table by equality, and edges are
grouped by segment and end. The best path is a fold with Spark's aggregate():
each end takes the best sum of an edge and of the entry where it begins. No
shuffle is needed: segments travel in front of their documents through three narrow steps,
and Spark keeps the order of rows within a partition.

Scores are the model's, ties go to the longer last piece. A character that no
piece covers costs LAST below the least score and becomes byte pieces. The fold takes FOLD ends at a
time, so a segment without spaces of any length is linear work.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.llm import common as c

FOLD = 256
LAST = 10.0
CHUNK = 32 << 20
_SPACE, _LITERAL = 0x2581, 1 << 21
_SEGMENT = re.compile(r" *[^ ]+| +")
_EDGES = "array<array<array<struct<n:int,id:int,w:double>>>>"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The piece table of a model file: ordinary pieces by hash, byte pieces by byte.

    A piece that scores less than other pieces in a row that spell it is on no best path; the lattice leaves it out.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) and re.fullmatch("▁*[^▁]*", self.text[i])]
        self.score = {i: sp.get_score(i) for i in plain}
        self.byte = np.full(256, sp.unk_id(), dtype=np.int32)
        self.bytes: list[bytes] = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                b = int(self.text[i][3:5], 16)
                self.byte[b], self.bytes[i] = i, bytes([b])
        for i in plain:
            self.bytes[i] = self.text[i].replace("▁", " ").encode()
        self.missing = min(self.score.values()) - LAST
        by_text = {self.text[i]: i for i in plain}
        scores = {t: self.score[i] for t, i in by_text.items()}
        useful = {t: i for t, i in by_text.items() if best_split(t, scores) <= self.score[i] + 1e-6}
        self.longest = max(map(len, useful))
        self.by_length = []
        for k in range(1, self.longest + 1):
            own = sorted({t[:k] for t in useful if len(t) >= k})
            h = prefixes(np.array([ord(x) for t in own for x in t], dtype=np.uint32))(np.arange(len(own)) * k, k)
            order = np.argsort(h)
            sieve = np.zeros(1 << 20, dtype=bool)
            sieve[h >> np.uint64(44)] = True
            ids = np.array([useful.get(own[i], -1) for i in order], dtype=np.int32)
            self.by_length.append((h[order], ids, np.array([self.score.get(i, 0.0) for i in ids.tolist()]), sieve))
        self.pairs = np.unique(np.array([0] + [ord(a) << 32 | ord(b) for t in useful for a, b in zip(t, t[1:], strict=False)], dtype=np.uint64))


def best_split(text: str, scores: dict[str, float]) -> float:
    """The best sum of two or more pieces that spell text."""
    best = [0.0]
    for e in range(1, len(text) + 1):
        best.append(max((best[b] + scores.get(text[b:e], -np.inf) for b in range(1 if e == len(text) else 0, e)), default=-np.inf))
    return best[-1]


def prefixes(points: np.ndarray):
    """A function from places and a length to the hashes of the substrings that begin there."""
    up, down = c.powers(c._BASE2, len(points) + 1)
    total = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(points.astype(np.uint64) * up[: len(points)], out=total[1:])
    return lambda at, k: c.mix((total[at + k] - total[at]) * down[at] + np.uint64(k))


_tables: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _tables:
        _tables[path] = Pieces(path)
    return _tables[path]


def points_of(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all segments, with the mark for spaces, and where each begins."""
    at = np.zeros(len(segments) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in segments], out=at[1:])
    p = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    p[p == _SPACE] += _LITERAL  # the mark itself in a text is no space
    p[p == 32] = _SPACE
    return p, at


def irreducible(words: list[str], table: Pieces) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct segments of words; which of them, in order, make them up; and where each word's begin.

    A word is cut between two characters that stand side by side in no piece: no edge crosses that place.
    """
    index, which, sizes = Numbers(), [np.empty(0, dtype=np.int64)], [np.zeros(1, dtype=np.int64)]
    for lo, hi in c.pieces(words, c.CHUNK_BYTES):
        p, at = points_of(words[lo:hi])
        first = np.zeros(len(p) + 1, dtype=bool)
        pair = p[:-1].astype(np.uint64) << np.uint64(32) | p[1:]
        first[1:-1] = table.pairs[np.minimum(np.searchsorted(table.pairs, pair), len(table.pairs) - 1)] != pair
        first[at] = True
        begin = np.flatnonzero(first)
        text, ends = "".join(words[lo:hi]), begin.tolist()
        which.append(np.fromiter((index[text[a:b]] for a, b in zip(ends, ends[1:], strict=False)), np.int64))
        sizes.append(np.diff(np.searchsorted(begin, at)))
    return list(index), np.concatenate(which), np.cumsum(np.concatenate(sizes))


def lattice(segments: list[str], table: Pieces) -> pa.Array:
    """Edges of each segment by end, the ends in parts of FOLD: n characters back, piece id, score.

    Substrings are lengthened only as long as they begin a piece.
    An id below 0 is a character without a piece: its code point is -id - 1.
    """
    p, at = points_of(segments)
    size = np.diff(at)
    stop = np.repeat(at[1:], size)
    ends, ns, ids, ws = [], [], [], []
    hashes, begin = prefixes(p), np.arange(len(p))
    for k, (h, own, score, sieve) in enumerate(table.by_length, 1):
        begin = begin[begin + k <= stop[begin]]
        g = hashes(begin, k)
        likely = sieve[g >> np.uint64(44)]
        begin, g = begin[likely], g[likely]
        place = np.minimum(np.searchsorted(h, g), len(h) - 1)
        hit = h[place] == g
        begin, place = begin[hit], place[hit]
        piece = own[place] >= 0
        ends.append(begin[piece] + k - 1)
        ns.append(np.full(len(ends[-1]), k, dtype=np.int32))
        ids.append(own[place[piece]])
        ws.append(score[place[piece]])
    single = np.zeros(len(p), dtype=bool)
    for e, n in zip(ends, ns, strict=True):
        if len(n) and n[0] == 1:
            single[e] = True
    bare = np.flatnonzero(~single)
    end = np.concatenate([*ends, bare])
    order = np.argsort(end, kind="stable")
    n = np.concatenate([*ns, np.ones(len(bare), dtype=np.int32)])[order]
    i = np.concatenate([*ids, -1 - p[bare].astype(np.int64)]).astype(np.int32)[order]
    w = np.concatenate([*ws, np.full(len(bare), table.missing)])[order]
    edges = pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(i, pa.int32()), pa.array(w, pa.float64())], names=["n", "id", "w"])
    by_end = pa.ListArray.from_arrays(pa.array(np.searchsorted(end[order], np.arange(len(p) + 1)).astype(np.int32)), edges)
    parts = -(-size // FOLD)
    part_of = np.repeat(np.arange(len(size)), parts)
    cut = at[part_of] + FOLD * (np.arange(len(part_of)) - np.repeat(np.cumsum(parts) - parts, parts))
    by_part = pa.ListArray.from_arrays(pa.array(np.append(cut, len(p)).astype(np.int32)), by_end)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(parts)]).astype(np.int32)), by_part)


def viterbi(edges, longest: int):
    """array<struct<s,m,id>> of the best edge into each end: its sum, its length m and its piece, as a fold over ends."""
    start = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("m"), F.lit(0).alias("id")))

    def tail(best):
        return F.slice(best, F.greatest(F.size(best) - longest + 1, F.lit(1)), longest)

    def into(best, es):
        return F.concat(best, F.array(F.array_max(F.transform(es, lambda e: F.struct((F.element_at(best, -e["n"])["s"] + e["w"]).alias("s"), e["n"].alias("m"), e["id"].alias("id"))))))

    def part(done, ends):
        return F.concat(done, F.array(F.aggregate(ends, tail(F.element_at(done, -1)), into)))

    return F.flatten(F.transform(F.slice(F.aggregate(edges, F.array(start), part), 2, 1 << 30), lambda x, i: F.slice(x, F.when(i == 0, 2).otherwise(longest + 1), 1 << 30)))


def paths(n: np.ndarray, i: np.ndarray, at: np.ndarray, table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each segment, read from its end to its beginning, and where each segment's begin."""
    cur, who = np.diff(at).astype(np.int64), np.arange(len(at) - 1)
    owner, step, found, k = [], [], [], 0
    live = cur > 0
    who, cur = who[live], cur[live]
    while len(who):
        e = at[who] + cur - 1
        owner.append(who)
        step.append(np.full(len(who), k))
        found.append(i[e])
        cur = cur - n[e]
        who, cur = who[cur > 0], cur[cur > 0]
        k += 1
    if not owner:
        return np.empty(0, dtype=np.int32), np.zeros(len(at), dtype=np.int64)
    o, s, f = np.concatenate(owner), np.concatenate(step), np.concatenate(found)
    order = np.lexsort((-s, o))
    o, f = o[order], f[order]
    bare = np.flatnonzero(f < 0)
    if len(bare):  # bytes of characters without a piece
        own = {int(b): [int(table.byte[x]) for x in chr((-int(f[b]) - 1) & (_LITERAL - 1)).encode("utf-8", "surrogatepass")] for b in bare}
        space = {b: [int(table.byte[32])] for b in own if -int(f[b]) - 1 == _SPACE}
        own |= space
        many = np.ones(len(f), dtype=np.int64)
        many[bare] = [len(own[int(b)]) for b in bare]
        out = np.repeat(f, many)
        first = np.cumsum(many) - many
        for b in bare:
            out[first[b] : first[b] + many[b]] = own[int(b)]
        o, f = np.repeat(o, many), out
    return f.astype(np.int32), np.searchsorted(o, np.arange(len(at)))


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges lo to hi, one range after the other."""
    n = hi - lo
    return np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)


def encode(docs: DataFrame, model: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>), a row for each row of docs, null ids included.

    A text gets a space in front, as the model expects. Null and empty texts have no ids. Other columns are not read.
    """
    path = model or default_model()
    longest = pieces(path).longest

    def segments(batches):
        table = pieces(path)
        none = pa.nulls
        kind = pa.list_(pa.list_(pa.list_(pa.struct([("n", pa.int32()), ("id", pa.int32()), ("w", pa.float64())]))))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in c.pieces(texts, CHUNK):
                index = Numbers()
                rows = [np.fromiter(map(index.__getitem__, _SEGMENT.findall(" " + t)), np.int32) if t else np.empty(0, np.int32) for t in texts[lo:hi]]
                own, which, at = irreducible(list(index), table)
                for a, b in c.pieces(own, c.CHUNK_BYTES // 8):
                    yield pa.RecordBatch.from_arrays([none(b - a, pa.int64()), none(b - a, pa.binary()), lattice(own[a:b], table)], names=["doc_id", "payload", "edges"])
                for a in range(0, hi - lo, 1000):
                    part = rows[a : a + 1000]
                    yield pa.RecordBatch.from_arrays([ids[lo + a : lo + a + len(part)], pa.array([which[ranges(at[r], at[r + 1])].astype(np.int32).tobytes() for r in part], pa.binary()), none(len(part), kind)], names=["doc_id", "payload", "edges"])

    def documents(batches):
        table = pieces(path)
        flat: list[np.ndarray] = []
        size: list[np.ndarray] = []
        whole = None
        for batch in batches:
            payload = batch.column("payload")
            is_doc = np.asarray(payload.is_valid())
            for run in np.split(np.arange(len(is_doc)), np.flatnonzero(np.diff(is_doc)) + 1):
                if not len(run):
                    continue
                part = batch.slice(int(run[0]), len(run))
                if not is_doc[run[0]]:
                    if whole is not None:
                        flat, size, whole = [], [], None
                    best = part.column("best")
                    off = best.offsets.to_numpy().astype(np.int64)
                    inner = best.values
                    f, at = paths(inner.field("m").to_numpy(), inner.field("id").to_numpy(), off, table)
                    flat.append(f)
                    size.append(np.diff(at))
                else:
                    if whole is None:
                        at = np.concatenate([[0], np.cumsum(np.concatenate(size or [np.empty(0, np.int64)]))]).astype(np.int64)
                        whole = (np.concatenate(flat or [np.empty(0, np.int32)]), at)
                    out, ends = [], [0]
                    for p in part.column("payload").to_pylist():
                        seg = np.frombuffer(p, dtype=np.int32)
                        place = ranges(whole[1][seg], whole[1][seg + 1])
                        out.append(whole[0][place])
                        ends.append(ends[-1] + len(place))
                    ids = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.concatenate(out)))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    read = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    cut = read.mapInArrow(c.lean(segments), f"doc_id long, payload binary, edges {_EDGES}")
    folded = cut.select("doc_id", "payload", viterbi(F.col("edges"), longest).alias("best"))
    return folded.mapInArrow(c.lean(documents), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the pieces' characters and bytes, without the space in front. Null ids give null."""
    path = model or default_model()

    def rows(batches):
        table = pieces(path).bytes
        for batch in batches:
            out = [None if x is None else b"".join([table[i] for i in x])[1:].decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(c.lean(rows), "doc_id long, text string")
