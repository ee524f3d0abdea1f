"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= c are at most sqrt(2 - 2c) apart. After a fixed
rotation the dimensions are cut into BLOCKS; of a close pair one block at least has its
proportional part of the squared distance or less. So each block is range-joined
under that budget: by cells of its first COORDINATES coordinates, as wide as the radius. Of the first, neighbouring
slabs meet; of any other a row is in its own cell and in the next, and a pair counts in the first cell that both share.
Large cells are cut into row blocks. What the range join of a
block finds is verified by the cosine in double precision, and counted in the
first block that finds it. A task returns link counts and a spanning forest of
its links, so a large group of near copies writes a row for each vector, not for each pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.llm import common as c

BLOCKS = 4
COORDINATES = 2
TILE = 1024
PAIRS = 1 << 16


def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(12345 + dim).normal(size=(dim, dim)))[0]


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which is exact, so that squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0))[1][:, None])


def units(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def rotated(v: np.ndarray) -> np.ndarray:
    """Without BLAS, whose sums depend on how many rows there are: every task must get the same bits."""
    return np.einsum("ij,kj->ik", units(v), rotation(v.shape[1]))


def edges_of(dim: int) -> np.ndarray:
    return np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)


def budgets(dim: int, cosine: float) -> np.ndarray:
    """Squared distance of each block, in proportion to its dimensions, and a little for rounding."""
    return (2 - 2 * cosine) * np.diff(edges_of(dim)) / dim * (1 + 1e-6) + 1e-12


def links(left: np.ndarray, right: np.ndarray, lid: np.ndarray, rid: np.ndarray, same: np.ndarray, late: np.ndarray, rlate: np.ndarray, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that link and are found in this block first. same: right rows of the left rows' own slab; late, rlate: in which coordinates a row is not in its own cell."""
    dim = left.shape[1]
    cut, budget = edges_of(dim), budgets(dim, cosine)
    rl, rr = rotated(left), rotated(right)
    nl, nr = np.sqrt(np.einsum("ij,ij->i", left, left)), np.sqrt(np.einsum("ij,ij->i", right, right))
    own = slice(cut[block], cut[block + 1])
    a, b = rl[:, own], rr[:, own]
    near = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T <= budget[block] + 1e-9
    near &= ~(same[None, :] & (lid[:, None] >= rid[None, :])) & (late[:, None] & rlate[None, :] == 0)
    x, y = np.nonzero(near)
    keep = np.zeros(len(x), dtype=bool)
    for lo in range(0, len(x), PAIRS):
        s = slice(lo, lo + PAIRS)
        i, j = x[s], y[s]
        good = np.einsum("ij,ij->i", left[i], right[j]) / (nl[i] * nr[j]) >= cosine
        part = np.stack([((rl[i, cut[k] : cut[k + 1]] - rr[j, cut[k] : cut[k + 1]]) ** 2).sum(1) <= budget[k] for k in range(block + 1)], axis=1)
        keep[s] = good & part[:, block] & ~part[:, :block].any(axis=1)
    return x[keep], y[keep]


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of vectors with an id.

    Rows are compared within a label only. Null labels and vectors that are null,
    empty, zero or hold null or non-finite components link with nothing; vectors
    of different lengths don't either. Equal vectors are one in the join and are
    counted as links of each other. Rows without an id take no part. A row that repeats an id gives a row of its own:
    links are counted between different ids that hold equal vectors, and between vectors otherwise.
    """
    rows = vectors.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.where(F.coalesce(sound, F.lit(False)))
    reps = c.checkpointed(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n")))

    def slabs(with_vector: bool):
        def run(batches):
            for batch in batches:
                for tab in by_length(pa.Table.from_batches([batch])):
                    v = matrix(tab.column("v"))
                    dim, n = v.shape[1], len(v)
                    r, width = rotated(v), np.sqrt(budgets(dim, cosine))
                    for k in range(len(width)):
                        first, last = edges_of(dim)[k : k + 2]
                        cell = np.floor(r[:, first : min(last, first + COORDINATES)] / width[k]).astype(np.int32)
                        for late in range(1 << (cell.shape[1] - 1)):
                            more = [cell[:, j] + (late >> (j - 1) & 1) if j < cell.shape[1] else np.zeros(n, np.int32) for j in range(1, 3)]
                            cols = [tab.column("label").combine_chunks(), pa.array([dim] * n, pa.int32()), pa.array([k] * n, pa.int32()), *(pa.array(x, pa.int32()) for x in more), pa.array(cell[:, 0]), tab.column("rep").combine_chunks()]
                            if with_vector:
                                cols += [pa.array([late] * n, pa.int32()), tab.column("n").combine_chunks(), tab.column("v").combine_chunks()]
                            yield pa.RecordBatch.from_arrays(cols, names=["label", "dim", "block", "c1", "c2", "slab", "rep", "late", "n", "v"][: len(cols)])

        return run

    kind, item = reps.schema["label"].dataType.simpleString(), reps.schema["v"].dataType.simpleString()
    keys = f"label {kind}, dim int, block int, c1 int, c2 int, slab int, rep long"
    light = reps.mapInArrow(c.lean(slabs(False)), keys)
    placed = c.row_blocks(reps.mapInArrow(c.lean(slabs(True)), f"{keys}, late int, n long, v {item}"), ["label", "dim", "block", "c1", "c2"], "slab", "rep", TILE, light)
    home = F.struct("label", "dim", "block", "c1", "c2", "slab", "x", "y")

    def join(tab: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64),) * 3]
        group = tab.column("h").to_numpy()
        order = np.argsort(group, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            own = tab.take(pa.array(part))
            for t in split_rows(own):
                v, ids, n = matrix(t.column("v")), t.column("rep").to_numpy(), t.column("n").to_numpy()
                is_left, up = t.column("is_left").to_numpy(zero_copy_only=False), t.column("is_upper").to_numpy(zero_copy_only=False)
                left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
                if not len(left) or not len(right):
                    continue
                late = t.column("late").to_numpy()
                x, y = links(v[left], v[right], ids[left], ids[right], ~up[right], late[left], late[right], t.column("block")[0].as_py(), cosine)
                if len(x):
                    nodes, local = np.unique(np.concatenate([ids[left][x], ids[right][y]]), return_inverse=True)
                    a, b = local[: len(x)], local[len(x) :]
                    count = np.bincount(a, weights=n[right][y], minlength=len(nodes)) + np.bincount(b, weights=n[left][x], minlength=len(nodes))
                    out.append((nodes, nodes[c.forest(len(nodes), a, b)], count.astype(np.int64)))
        a, b, n = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.table({"a": a, "b": b, "n": n})

    work = placed.withColumn("h", F.xxhash64(home)).withColumn("g", F.pmod("h", F.lit(c.width(reps) * 8)))
    found = c.checkpointed(work.groupBy("g").applyInArrow(c.lean_group(join), "a long, b long, n long"))
    linked = c.components(found)
    count = found.groupBy("a").agg(F.sum("n").alias("m"))
    tied = reps.join(count, F.col("rep") == F.col("a"), "left").join(linked, F.col("rep") == F.col("node"), "left")
    tied = tied.select(F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return (
        rows.join(tied, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    a = column.combine_chunks()
    return scaled(a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1))


def by_length(tab: pa.Table):
    n = np.diff(tab.column("v").combine_chunks().offsets.to_numpy()) if len(tab) else np.empty(0)
    for d in np.unique(n):
        yield tab.filter(pa.array(n == d))


def split_rows(tab: pa.Table):
    """The groups of a hash value: one, but for a collision."""
    names = ("label", "dim", "block", "c1", "c2", "slab", "x", "y")
    if all(pc.count_distinct(tab.column(k), mode="all").as_py() == 1 for k in names):
        yield tab
        return
    keys: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(tab.column(k).to_pylist() for k in ("label", "dim", "block", "c1", "c2", "slab", "x", "y")), strict=True)):
        keys.setdefault(key, []).append(i)
    for rows in keys.values():
        yield tab if len(rows) == len(tab) else tab.take(pa.array(rows))
