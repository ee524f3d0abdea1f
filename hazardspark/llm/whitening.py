"""Embedding whitening from exact, bit-sliced cross-products.

Entries become whole numbers x = floor(scale * c) + shift. Each distinct x vector enters the fit once. In a task, blocks of
rows are shifted by their least value a dimension, and bit b of dimension i becomes
a plane: one bit a row, packed into 64-bit words. The cross-product of two
dimensions is the sum of 2**(a + b) * popcount(plane a of one AND plane b of the other), so
no product is rounded and nothing overflows; a plane of ones gives the sums.
What tasks return is added by Spark, as two decimals, and centred as whole numbers
(n * Sxy - Sx * Sy) before eigh. Where the wanted eigenvalues
are far below the largest, the rest of the space is projected in whole numbers again and solved on
its own, so that small components are as exact as large ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.llm import common as c

BLOCK = 8192
LIMB = 60
EDGE = 1 << 61
DEFLATE = 1e-6
NOTHING = 1e-24


def whole(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * v) as int64; beyond 2**61 the nearest of these bounds."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(v.astype(np.float64) * scale), -float(EDGE), float(EDGE)).astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in the fewest bytes an entry, that width first: equal rows have equal bytes."""
    top = np.maximum(x.max(axis=1, initial=0), ~x.min(axis=1, initial=0))
    out = np.empty(len(x), dtype=object)
    for width in (8, 4, 2, 1):
        own = np.flatnonzero(top < 1 << (8 * width - 1)) if width < 8 else np.arange(len(x))
        data = x[own].astype(f"<i{width}")
        out[own] = [bytes([width]) + row.tobytes() for row in data]
    return out.tolist()


def unpacked(rows: list[bytes]) -> dict[int, np.ndarray]:
    """The rows as int64, by their length."""
    groups: dict[tuple[int, int], list[bytes]] = {}
    for row in rows:
        groups.setdefault(((len(row) - 1) // row[0], row[0]), []).append(row)
    out: dict[int, list[np.ndarray]] = {}
    for (dim, width), own in groups.items():
        flat = np.frombuffer(b"".join(own), np.uint8).reshape(len(own), -1)[:, 1:]
        out.setdefault(dim, []).append(np.ascontiguousarray(flat).view(f"<i{width}").reshape(len(own), dim).astype(np.int64))
    return {dim: np.concatenate(x) for dim, x in out.items()}


def cross_products(x: np.ndarray) -> np.ndarray:
    """Exact sums of x_i * x_j over the rows, as Python's whole numbers; the last row and column belong to a dimension of ones."""
    n, dim = x.shape
    low = x.min(axis=0)
    u = np.concatenate([(x - low).astype(np.uint64), np.ones((n, 1), np.uint64)], axis=1)
    width = [max(1, int(t).bit_length()) for t in u.max(axis=0)]
    owner = np.repeat(np.arange(dim + 1), width)
    bit = np.concatenate([np.arange(w) for w in width])
    padded = np.zeros((len(owner), -(-n // 64) * 64), dtype=np.uint8)
    padded[:, :n] = (u.T[owner] >> bit.astype(np.uint64)[:, None]) & np.uint64(1)
    words = np.packbits(padded, axis=1).view(np.uint64)
    count = np.empty((len(owner),) * 2, dtype=np.int64)
    for p in range(len(owner)):
        count[p:, p] = count[p, p:] = np.bitwise_count(words[p:] & words[p]).sum(axis=1, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(width)[:-1]])
    if 2 * max(width) + int(n).bit_length() < 62:
        weight = np.int64(1) << bit.astype(np.int64)
        total = np.add.reduceat(np.add.reduceat(count * weight[:, None] * weight, first, axis=0), first, axis=1).astype(object)
    else:
        weight = np.array([1 << int(b) for b in bit], dtype=object)
        total = np.add.reduceat(np.add.reduceat(count.astype(object) * weight[:, None] * weight, first, axis=0), first, axis=1)
    low = np.array([*low.tolist(), 0], dtype=object)
    ones = total[dim]
    return total + np.outer(low, ones) + np.outer(ones, low) + n * np.outer(low, low)


def eigen(exact: np.ndarray, unit: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of exact / unit, a matrix of whole numbers, and their unit vectors as columns; those that are nothing are 0."""
    basis, values, vectors, top = np.eye(len(exact)), [], [], None
    while True:
        part = exact
        if top is not None:  # the rest of the space, projected without rounding
            q = np.array([[round(t * 2**LIMB) for t in row] for row in basis.tolist()], dtype=object)
            part, scale = q.T.dot(exact).dot(q), unit << (2 * LIMB)
        else:
            scale = unit
        e, v = np.linalg.eigh(np.array([[t / scale for t in row] for row in part], dtype=np.float64).reshape(part.shape))
        e, v = e[::-1], v[:, ::-1]
        top = max(e[0], 0.0) if top is None else top
        good = e > max(DEFLATE * max(e[0], 0.0), NOTHING * top)
        if not good.any():
            break
        values += e[good].tolist()
        vectors.append(basis @ v[:, good])
        basis = basis @ v[:, ~good]
        if len(values) >= most or not basis.shape[1]:
            break
    e, v = np.array(values[:most]), np.concatenate([np.empty((len(exact), 0)), *vectors], axis=1)[:, :most]
    v = v / np.sqrt((v * v).sum(axis=0))
    more = min(most, len(exact)) - len(e)
    return np.concatenate([e, np.zeros(more)]), np.concatenate([v, np.zeros((len(exact), more))], axis=1)


def solved(dim: int, total: np.ndarray, most: int) -> dict:
    """The model of the vectors of one length, from their exact cross-products."""
    n, sums = total[dim, dim], total[dim, :dim]
    centred = n * total[:dim, :dim] - np.outer(sums, sums)
    trace = sum(centred[i, i] for i in range(dim))
    e, v = eigen(centred, n * n, most) if dim else (np.empty(0), np.empty((0, 0)))
    sound = e > 0
    error = None
    if sound.any():
        w = v[:, sound] / np.sqrt(e[sound])
        whole_w = np.array([[round(t * 2**80) for t in row] for row in w.tolist()], dtype=object)
        got = whole_w.T.dot(centred).dot(whole_w)
        unit = (n * n) << 160
        error = max(abs((t - unit * (i == j)) / unit) for i, row in enumerate(got) for j, t in enumerate(row))
    share = [float(x) / (trace / (n * n)) if x > 0 else (0.0 if trace else None) for x in e]
    return {"dim": dim, "n": int(n), "sums": [str(s) for s in sums], "vectors": np.ascontiguousarray(v).tobytes(), "e": e.tolist(), "explained": share, "identity_error": error}


def fit(vectors: DataFrame, vector: str = "embedding", most: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """A row for each length of vectors: n, sums, and up to most components. What is added up for a length is at most (length + 1)**2 numbers."""

    def packed_rows(batches):
        for whole_batch in batches:
            for batch in c.slices(whole_batch, 4096):
                for _, x in matrices(batch.column("v"), scale):
                    yield pa.RecordBatch.from_arrays([pa.array(packed(x), pa.binary())], names=["x"])

    distinct = sound(vectors, vector).select("v").mapInArrow(c.lean(packed_rows), "x binary").distinct()

    def scatter(batches):
        total: dict[int, np.ndarray] = {}
        held: dict[int, list[np.ndarray]] = {}

        def flush(dim):
            x = np.concatenate(held.pop(dim))
            got = cross_products(x)
            total[dim] = total[dim] + got if dim in total else got

        for batch in batches:
            for dim, x in unpacked(batch.column("x").to_pylist()).items():
                for at in range(0, len(x), BLOCK):
                    held.setdefault(dim, []).append(x[at : at + BLOCK])
                    if sum(map(len, held[dim])) >= BLOCK:
                        flush(dim)
        for dim in list(held):
            flush(dim)
        for dim, s in total.items():
            i, j = np.triu_indices(dim + 1)
            values = s[i, j]
            high = [int(t) >> LIMB for t in values]
            low = [int(t) & ((1 << LIMB) - 1) for t in values]
            as_decimal = lambda xs: pa.array([str(t) for t in xs]).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), as_decimal(high), as_decimal(low)], names=["dim", "i", "j", "high", "low"])

    def solve(tab: pa.Table) -> pa.Table:
        dim = tab.column("dim")[0].as_py()
        total = np.zeros((dim + 1, dim + 1), dtype=object)
        for i, j, high, low in zip(*(tab.column(k).to_pylist() for k in ("i", "j", "high", "low")), strict=True):
            total[i, j] = total[j, i] = (int(high) << LIMB) + int(low)
        total[dim, :dim] += shift * total[dim, dim]
        total[:dim, :dim] += shift * np.add.outer(old := total[:dim, dim].copy(), old) + shift * shift * total[dim, dim]
        total[:dim, dim] = total[dim, :dim]
        return pa.Table.from_pylist([solved(dim, total, most)], schema=pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("vectors", pa.binary()), ("e", pa.list_(pa.float64())), ("explained", pa.list_(pa.float64())), ("identity_error", pa.float64())]))

    sums = distinct.mapInArrow(c.lean(scatter), "dim int, i int, j int, high decimal(38,0), low decimal(38,0)").groupBy("dim", "i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return sums.groupBy("dim").applyInArrow(solve, "dim int, n long, sums array<string>, vectors binary, e array<double>, explained array<double>, identity_error double")


def sound(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector isn't null and holds no null or non-finite entry, as v."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(F.col(vector).isNotNull() & good, F.lit(False))).withColumn("v", F.col(vector))


def matrices(column: pa.Array, scale: int):
    """(rows, x) for each length among the vectors of a batch; x is without the shift."""
    offsets = column.offsets.to_numpy()
    size, flat = np.diff(offsets), column.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        at = offsets[rows][:, None] + np.arange(dim)
        yield rows, whole(flat[at] if dim else np.empty((len(rows), 0)), scale)


def whitened(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", most: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each sound vector and component.

    deviation is a decimal of 38 digits, exact. Rows that repeat an id, or
    have none, each give their rows; equal vectors are one in the fit. Vectors of different lengths are fitted apart; an empty vector
    has no component and so no row. A component without variance (all vectors equal, fewer vectors than components) has whitened null and
    explained 0, or null if there is no variance at all; identity_error covers the others, and is null if there are none. Entries
    beyond 2**61 / scale count as that. An empty table gives no row.
    The model is a row of at most 16 components for each length of vector: its size follows the length, not the rows, and it is checked before it is sent.
    """
    model = c.checkpointed(fit(vectors, vector, most, scale, shift))
    held = model.agg(F.sum(F.octet_length("vectors") + 40 * F.col("dim") + 200)).first()[0] or 0
    if held > 1 << 28:
        raise ValueError(f"the models of all lengths take {held} bytes: fit fewer lengths at once")
    models = {r["dim"]: r for r in model.collect()}
    sent = vectors.sparkSession.sparkContext.broadcast({d: (r["n"], [int(s) for s in r["sums"]], bytes(r["vectors"]), r["e"]) for d, r in models.items()})
    kind = vectors.schema[id].dataType.simpleString()

    def apply(batches):
        for whole_batch in batches:
            for batch in c.slices(whole_batch, 4096):
                for rows, x in matrices(batch.column("v"), scale):
                    dim = x.shape[1]
                    if dim not in sent.value:
                        continue
                    n, sums, data, e = sent.value[dim]
                    q, e = np.frombuffer(data).reshape(dim, len(e)), np.array(e)
                    sums = [s - n * shift for s in sums]
                    reach = n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, sums), default=0)
                    kind_of = np.int64 if reach * reach * max(dim, 1) < 1 << 62 else object
                    off = x.astype(kind_of) * n - np.array(sums, dtype=kind_of)
                    deviation = (off * off).sum(axis=1) if dim else np.zeros(len(x), np.int64)
                    exact = pa.array(deviation).cast(pa.decimal128(38, 0)) if kind_of is np.int64 else pa.array([str(t) if abs(t) < 10**38 else None for t in deviation], pa.string()).cast(pa.decimal128(38, 0))
                    y = np.array(off / n, dtype=np.float64) @ q
                    good = e > 0
                    y[:, good] /= np.sqrt(e[good])
                    y[:, ~good] = np.nan
                    flat = pa.array(y.ravel(), from_pandas=True)  # NaN as null
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array([dim] * len(rows), pa.int32()), exact, pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * y.shape[1], pa.int32()), flat)], names=["id", "dim", "deviation", "y"])

    found = sound(vectors, vector).select(F.col(id).alias("id"), "v").mapInArrow(c.lean(apply), f"id {kind}, dim int, deviation decimal(38,0), y array<double>")
    each = found.select("id", "dim", "deviation", F.posexplode("y").alias("at", "whitened"))
    said = F.broadcast(model.select(F.col("dim").alias("of"), "n", F.posexplode("explained").alias("place", "explained"), "identity_error"))
    return each.join(said, (F.col("dim") == F.col("of")) & (F.col("at") == F.col("place"))).select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", "explained", "identity_error"
    )
