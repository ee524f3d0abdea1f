"""Exact top-k inner products by no-random-access aggregation.

Vectors become integers. They are packed into blocks; in a block each dimension
is a list sorted by value, which a query reads from the end its sign favours. After
each stretch of reading every row has a lower and an upper bound on its score:
the part seen, plus the least or the most that its unseen dimensions can
add, given how far each list was read. When the k-th best lower bound of a
query is above the upper bounds of all but a few rows, reading stops and the
scores of these few are made final. Bounds of a block of queries and a
block of rows are matrix products, so many queries share one reading.

Rows with a component beyond PLAIN, whose sums floats can't hold exactly, meet all others in whole numbers of Python.

The queries are a stated set that grows with the table: they are cut into blocks too, and each
pair of blocks is a row of an equi-join on the number of the query block.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 16384
QUERIES = 1024
STOPS = (0.25, 0.5, 0.75, 1.0)
PLAIN = 1 << 20


def nra(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) indexes of each query's k best rows of this block, ties to the smaller id; rows of the query's own id are none."""
    m, d = x.shape
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * d
    kind = np.float32 if most < 2**24 else np.float64  # sums of whole numbers below these are exact: PLAIN**2 * d is, up to 4,096 dimensions
    if not m or most >= 2**53:
        return exact(q, qid, x, xid, k, np.arange(len(q)), None)
    q, x = q.astype(kind), x.astype(kind)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    order = np.argsort(-x, axis=0, kind="stable")
    rank = np.empty((m, d), dtype=np.int32)
    np.put_along_axis(rank, order, np.arange(m, dtype=np.int32)[:, None], axis=0)
    ranked = np.take_along_axis(x, order, axis=0)
    own = qid[:, None] == xid[None, :]
    out: list[tuple] = []
    open_ = np.arange(len(q))
    for stop in STOPS:
        r = max(1, math.ceil(stop * m))
        high, low = rank < r, rank >= m - r
        both, unseen = np.concatenate([x * high, x * low], axis=1), np.concatenate([~high, ~low], axis=1).astype(kind)
        p, n = up[open_], down[open_]
        seen = np.concatenate([p, n], axis=1) @ both.T
        upper = seen + np.concatenate([p * ranked[r - 1], n * ranked[m - r]], axis=1) @ unseen.T
        lower = seen + np.concatenate([p * ranked[m - 1], n * ranked[0]], axis=1) @ unseen.T
        lower[own[open_]], upper[own[open_]] = -np.inf, -np.inf
        kth = np.partition(lower, m - min(k, m), axis=1)[:, m - min(k, m)]
        maybe = (upper >= kth[:, None]) & np.isfinite(upper)
        few = maybe.sum(axis=1) <= 4 * k
        done = few if stop < 1 else np.ones(len(open_), dtype=bool)
        if done.any():
            out.append(exact(q, qid, x, xid, k, open_[done], maybe[done]))
        open_ = open_[~done]
        if not len(open_):
            break
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.empty(0, int),) * 3


def exact(q, qid, x, xid, k, which, maybe):
    """Final scores of the rows that may still be among the k best."""
    if maybe is None:
        maybe = qid[which][:, None] != xid[None, :]
    a, b = np.nonzero(maybe)
    if q.dtype == object or x.dtype == object or max(np.abs(q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) * x.shape[1] >= 2**53:
        score = np.array([sum(int(u) * int(v) for u, v in zip(q[which[i]].tolist(), x[j].tolist(), strict=True)) for i, j in zip(a, b, strict=True)], dtype=object)
    else:
        score = np.empty(len(a), dtype=np.int64)
        for lo in range(0, len(a), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            score[s] = np.einsum("ij,ij->i", q[which[a[s]]].astype(np.float64), x[b[s]].astype(np.float64)).astype(np.int64)
    order = np.array(sorted(range(len(a)), key=lambda i: (a[i], -score[i], xid[b[i]])), dtype=np.int64) if score.dtype == object else np.lexsort((xid[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    keep = place < k
    return which[a[keep]], b[keep], np.array([max(min(s, 2**63 - 1), -(2**63)) for s in score[keep].tolist()], dtype=np.int64)


def large(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if data[:1] == b"4" else np.float64, offset=1).astype(np.float64).reshape(-1, dim)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers of Python, whatever their size."""
    return np.array([[math.floor(Fraction(v) * scale) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def both_ways(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, scale: int):
    """nra() of the rows within PLAIN, and exact() where either side is beyond; of raw vectors."""
    with np.errstate(over="ignore"):
        fq, fx = np.floor(scale * q), np.floor(scale * x)
    pq, px = np.abs(fq).max(axis=1, initial=0) < PLAIN, np.abs(fx).max(axis=1, initial=0) < PLAIN
    for lo in range(0, int(pq.sum()), QUERIES // 2):
        i, j = np.flatnonzero(pq)[lo : lo + QUERIES // 2], np.flatnonzero(px)
        a, b, s = nra(fq[i], qid[i], fx[j], xid[j], k)
        yield qid[i][a], xid[j][b], s
    for i, j in ((np.flatnonzero(pq), np.flatnonzero(~px)), (np.flatnonzero(~pq), np.arange(len(x)))):
        for lo in range(0, len(i) if len(j) else 0, 16):
            a, b, s = exact(whole(q[i[lo : lo + 16]], scale), qid[i[lo : lo + 16]], whole(x[j], scale), xid[j], k, np.arange(len(i[lo : lo + 16])), None)
            yield qid[i[lo:]][a], xid[j][b], s


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row for which queries holds.

    Components become floor(scale * x); the score is the whole-number inner product, ties go to the
    smaller id. Vectors that are null, empty or hold null or non-finite
    components, and rows without an id, take no part; vectors of different
    lengths don't meet. Of rows that repeat an id each is a candidate of its own for other ids, and the one with the least vector is
    the query. Scores beyond 64 bits are ranked exactly within a block of rows, and given as the nearest number of 64 bits.
    Other columns are read only by queries. An empty table gives an empty table.
    """
    sound = F.col(id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(sound).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("dim"), queries.alias("is_query"))
    asked = rows.where("is_query").groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n = math.ceil(asked.count() / QUERIES) or 1

    def small(v: np.ndarray) -> bytes:
        """As float32 where that loses nothing."""
        with np.errstate(over="ignore"):
            light = v.astype(np.float32)
        return b"4" + light.tobytes() if np.array_equal(light.astype(np.float64), v) else b"8" + v.tobytes()

    def packed(tab: pa.Table) -> dict:
        v = tab.column("v").combine_chunks()
        return {"ids": tab.column("id").to_numpy().astype(np.int64).tobytes(), "data": small(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64))}

    def block(key, tab):
        p = packed(tab)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()), "qids": pa.array([p["ids"]]), "qdata": pa.array([p["data"]])})

    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).groupBy("part", "dim").applyInArrow(block, "part int, dim int, qids binary, qdata binary")

    def blocks(batches):
        held: dict[int, list] = {}
        for batch in batches:
            tab = pa.Table.from_batches([batch])
            for d in set(tab.column("dim").to_pylist()):
                own = tab.filter(pa.compute.equal(tab.column("dim"), d))
                held.setdefault(d, []).append(packed(own))
                if sum(len(p["ids"]) for p in held[d]) >= 8 * ROWS:
                    yield joined(d, held.pop(d))
        for d, parts in held.items():
            yield joined(d, parts)

    def joined(d, parts):
        return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([b"".join(p["ids"] for p in parts)]), pa.array([small(np.concatenate([large(p["data"], d).ravel() for p in parts]))])], names=["dim", "ids", "data"])

    cut = rows.select("id", "v", "dim").mapInArrow(blocks, "dim int, ids binary, data binary")
    pairs = cut.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(asked, ["part", "dim"])

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                qid, xid = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["ids"], np.int64)
                for a, b, s in both_ways(large(r["qdata"], r["dim"]), qid, large(r["data"], r["dim"]), xid, k, scale):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

    best = pairs.select("dim", "ids", "data", "qids", "qdata").mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
