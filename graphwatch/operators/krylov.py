"""Smallest non-zero eigenpairs of a large component's normalized Laplacian.

In one task (``smallest_pairs``): Lanczos with thick restarts and full
reorthogonalization on ``M = 2I − L``, whose largest eigenvalues are ``2 − λ``
for L's smallest; the known null vector is projected out, and a pair counts
only when its residual is below RESIDUAL. Graphs whose small eigenvalues crowd
at zero (long rings and paths) do not settle that way; for them the same loop
runs on the inverse of L, applied by conjugate gradients, where they lie far
apart. A single start vector meets each eigenspace once, so the search is
repeated orthogonally to what it has found until it finds nothing as small:
that brings the other vectors of repeated eigenvalues. Memory: the component's
edges and BASIS vectors.

Beyond TASK_PAIRS pairs (``smallest_pairs_distributed``): Spark's own
``IndexedRowMatrix.computeSVD`` (ARPACK on the driver, products on the
executors). The driver holds about 2·(keep + 1) vectors of one number per
node, and the result: 1.5 GB at ten million nodes.

Both raise where the pairs do not settle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["source_id", "window_no", "component"]
TASK_PAIRS = 4_000_000
BASIS = 160              # Lanczos vectors held
KEPT_AT_RESTART = 40
PRODUCTS = 1600          # matrix products of one search, at most; an eighth where each is a solution
RESIDUAL = 1e-10         # relative to the operator's norm
CG_RESIDUAL = 1e-13

Operator = Callable[[np.ndarray], np.ndarray]


def _search(times: Operator, start: np.ndarray, locked: np.ndarray, keep: int, products: int
            ) -> tuple[np.ndarray, np.ndarray] | None:
    """The ``keep`` largest eigenpairs that a start vector reaches, orthogonal to
    the columns of ``locked``; None where they do not settle."""
    n = len(start)
    room = min(BASIS, n - locked.shape[1])
    basis, h = np.zeros((room, n)), np.zeros((room, room))

    def free(v: np.ndarray, used: int) -> np.ndarray:
        for _ in range(2):
            v = v - locked @ (locked.T @ v)
            v = v - basis[:used].T @ (basis[:used] @ v)
        return v

    v = free(start, 0)
    v /= np.linalg.norm(v)
    used = 0
    for _ in range(products):
        basis[used] = v
        w = times(v)
        used += 1
        h[:used, used - 1] = h[used - 1, :used] = basis[:used] @ w
        w = free(w, used)
        beta = np.linalg.norm(w)
        scale = max(np.abs(h[:used, :used]).max(), 1e-300)
        closed = beta <= 1e-13 * scale or used == n - locked.shape[1]
        if closed or used == room or used % 10 == 0:
            values, s = np.linalg.eigh(h[:used, :used])
            values, s = values[::-1], s[:, ::-1]
            top = min(keep, used)
            settled = beta * np.abs(s[-1, :top]) <= RESIDUAL * np.abs(values[0])
            if closed or (used >= keep and settled.all()):
                return values[:top], basis[:used].T @ s[:, :top]
            if used == room:
                used = min(KEPT_AT_RESTART, room - 1)
                basis[:used] = s[:, :used].T @ basis
                h[:] = 0
                h[np.arange(used), np.arange(used)] = values[:used]
        v = w / beta
    return None


def _inverse(times: Operator, u: np.ndarray) -> Operator:
    """``times`` inverted on the vectors orthogonal to ``u`` by conjugate gradients."""
    def solve(b: np.ndarray) -> np.ndarray:
        b = b - u * (u @ b)
        x, r = np.zeros_like(b), b.copy()
        p, rr = r.copy(), r @ r
        limit = CG_RESIDUAL ** 2 * rr
        for _ in range(20 * len(b)):
            if rr <= limit:
                break
            q = times(p)
            a = rr / (p @ q)
            x += a * p
            r -= a * q
            new = r @ r
            p = r + (new / rr) * p
            rr = new
        return x - u * (u @ x)
    return solve


def smallest_pairs(i: np.ndarray, j: np.ndarray, weight: np.ndarray, n: int, keep: int
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(degree, values, vectors): the ``keep`` smallest non-zero eigenvalues of the
    normalized Laplacian of a connected graph with directed weights ``i -> j``
    (symmetrized, loops ignored), and their vectors as columns."""
    off = i != j
    i, j, w = i[off], j[off], weight[off] * 0.5
    degree = np.bincount(i, w, n) + np.bincount(j, w, n)
    rows, cols, vals = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w])
    vals = vals / np.sqrt(degree[rows] * degree[cols])
    order = np.argsort(rows, kind="stable")
    cols, vals = cols[order], vals[order]
    begin = np.searchsorted(rows[order], np.arange(n))        # every node has an edge
    u = np.sqrt(degree / degree.sum())

    def near(v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(vals * v[cols], begin)

    keep = min(keep, n - 1)
    draw = np.random.default_rng(n)
    # the plain search first; the inverse where it does not settle
    for times, value_of, products in ((lambda v: v + near(v), lambda t: 2.0 - t, PRODUCTS),
                                      (_inverse(lambda v: v - near(v), u), lambda t: 1.0 / t, PRODUCTS // 8)):
        values, vectors = np.zeros(0), np.zeros((n, 0))
        while True:
            found = _search(times, draw.standard_normal(n), np.column_stack([u, vectors]), keep, products)
            if found is None:
                break
            new = value_of(found[0])
            if len(values) == keep and new[0] >= values[-1] * (1 - 1e-9):
                return degree, values, vectors           # nothing as small is left
            both = np.concatenate([values, new])
            order = np.argsort(both, kind="stable")[:keep]
            values, vectors = both[order], np.column_stack([vectors, found[1]])[:, order]
            if len(values) == n - 1:
                return degree, values, vectors
    raise RuntimeError(f"eigenpairs of a component of {n} nodes have not settled")


def smallest_pairs_distributed(edges: DataFrame, keep: int) -> DataFrame:
    """``(source_id, window_no, component, node, degree, vals, vec)`` for every
    component in ``edges (..., src, dst, weight)``, one after another."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    from graphwatch.operators.windows import sequence_rank

    spark = edges.sparkSession
    off = edges.filter(F.col("src") != F.col("dst"))
    both = (off.select(*KEY, F.col("src").alias("node"), F.col("dst").alias("other"), (F.col("weight") / 2).alias("w"))
            .unionByName(off.select(*KEY, F.col("dst").alias("node"), F.col("src").alias("other"), (F.col("weight") / 2).alias("w"))))
    degree = both.groupBy(*KEY, "node").agg(F.sum("w").alias("degree"))
    one_key = F.concat_ws("\u0001", *KEY)
    indexed = sequence_rank(degree.withColumn("_key", one_key), ["node"], "_key", rank_col="i").drop("_key").checkpoint(eager=True)
    to = indexed.select(*KEY, F.col("node").alias("other"), F.col("i").alias("j"), F.col("degree").alias("dj"))
    entries = (both.groupBy(*KEY, "node", "other").agg(F.sum("w").alias("w"))
               .join(indexed, [*KEY, "node"]).join(to, [*KEY, "other"])
               .select(*KEY, "i", "j", (F.col("w") / F.sqrt(F.col("degree") * F.col("dj"))).alias("a")))
    diagonal = indexed.select(*KEY, "i", F.col("i").alias("j"), F.lit(1.0).alias("a"))
    rows = (entries.unionByName(diagonal).groupBy(*KEY, "i")
            .agg(F.sort_array(F.collect_list(F.struct("j", "a"))).alias("row")).checkpoint(eager=True))
    sizes = indexed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("degree").alias("vol")).collect()
    out = None
    for c in sizes:                                   # giant components: few
        n = c["n"]
        mine = (F.col("source_id").eqNullSafe(F.lit(c["source_id"])) & (F.col("window_no") == c["window_no"])
                & (F.col("component") == c["component"]))
        vectors = (rows.filter(mine).select("i", "row").rdd
                   .map(lambda r, n=n: IndexedRow(r.i, Vectors.sparse(n, [e.j for e in r.row], [e.a for e in r.row]))).cache())
        # the largest singular value is 2, of the null vector; the others follow
        svd = IndexedRowMatrix(vectors, n, n).computeSVD(min(keep + 1, n), False)
        vectors.unpersist()
        values, v = 2.0 - svd.s.toArray(), svd.V.toArray()
        if len(values) < min(keep + 1, n):
            raise RuntimeError(f"eigenpairs of a component of {n} nodes have not settled")
        table = spark.createDataFrame(((k, v[k, 1:].tolist()) for k in range(n)), "i long, vec array<double>")
        part = (indexed.filter(mine).join(table, "i")
                .select(*KEY, "node", "degree", F.array(*[F.lit(float(x)) for x in values[1:]]).alias("vals"), "vec"))
        out = part if out is None else out.unionByName(part)
    return out
