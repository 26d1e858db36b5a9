"""Low end of the normalized-Laplacian spectrum of every window graph.

Each window is one group of a grouped Arrow function (``applyInPandas``):
the window's adjacency rows arrive as one pandas frame, the graph is split
into connected components, and every component is solved with a dense
symmetric eigensolver (``numpy.linalg.eigh``). The spectrum of the whole
graph is the union of the component spectra, so splitting first is exact
and keeps every matrix as small as its component.

Result per window (basis-independent definition):

* ``eigenvalues`` – the ``k = min(8, n-1)`` smallest, ascending, clipped to [0, 2];
* ``lambda2`` – the second smallest; ``mult`` – how many of them are below 0.01;
* embedding – null space spanned canonically by one ``D^1/2·1`` vector per
  component with the global one projected out, then the eigenvectors of the
  smallest non-zero eigenvalues, ``k-1`` columns at most. A repeated
  eigenvalue cut by the ``k-1`` limit is dropped as a whole (``degenerate``),
  so distances never depend on which basis the solver happened to return;
* ``outliers`` – nodes farther from the embedding centroid than
  ``mean + sigma * std`` (population std, floored at 1e-3);
* ``sub_nodes`` – outliers first, then nodes by descending |Fiedler score|
  (ties by node id after rounding to 1e-9), at most ``top_k``.

Group size is the number of distinct (src, dst) pairs of a window, which
count windows bound by their size. Windows above ``max_local`` pairs are
routed to ``operators.distributed_spectrum`` instead of one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwatch.schema import SPECTRUM_SCHEMA
from graphwatch.session import scratch_path, ship_package

# Fixed values of the detection rules.
K_MAX = 8            # eigenpairs kept per window
ZERO_EPS = 0.01      # an eigenvalue below this counts as zero
SIGMA = 3.0          # outlier distance: mean + 3 population std
STD_FLOOR = 1e-3     # floor of that std
TOP_K = 8            # subgraph size
CLIP_LO, CLIP_HI = 0.0, 2.0

GROUP_TOL = 1e-9     # eigenvalues closer than this are one repeated value
SCORE_DECIMALS = 9   # Fiedler scores are compared after rounding


def _component_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Connected components by vectorized min-label propagation with pointer jumping;
    the label of a component is its smallest index."""
    labels = np.arange(n)
    if len(i) == 0:
        return labels
    while True:
        m = np.minimum(labels[i], labels[j])
        new = labels.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, labels):
            return labels
        labels = new


def _same(a: float, b: float) -> bool:
    return abs(a - b) <= GROUP_TOL * max(1.0, abs(a), abs(b))


def graph_spectrum(node_ids: Sequence[str], weights: np.ndarray, k_max: int = K_MAX,
                   sigma: float = SIGMA, top_k: int = TOP_K) -> dict:
    """Spectral summary of one graph given sorted node ids and a dense symmetric matrix.

    ``weights`` must already be symmetrized; its diagonal (self-loops) is ignored.
    """
    n = len(node_ids)
    W = np.array(weights, dtype=float, copy=True)
    np.fill_diagonal(W, 0.0)
    deg = W.sum(axis=1)
    k = max(1, min(k_max, n - 1))
    ii, jj = np.nonzero(np.triu(W, 1))
    roots = _component_roots(n, ii, jj)
    comp_roots, comp_of = np.unique(roots, return_inverse=True)   # ordered by smallest member
    z = len(comp_roots)
    sqrt_d = np.sqrt(np.clip(deg, 0.0, None))
    comp_volume = np.bincount(comp_of, weights=deg, minlength=z)

    # canonical null space: one D^1/2·1 vector per component (unit vector when isolated)
    null_mat = np.zeros((n, z))
    null_mat[np.arange(n), comp_of] = sqrt_d
    for c in np.flatnonzero(comp_volume <= 0):
        members = np.flatnonzero(comp_of == c)
        null_mat[members, c] = 0.0
        null_mat[members[0], c] = 1.0
    null_mat /= np.linalg.norm(null_mat, axis=0, keepdims=True)

    # non-zero eigenpairs per component, kept as (values, members, vectors)
    blocks = []
    for c in range(z):
        members = np.flatnonzero(comp_of == c)
        if len(members) < 2:
            continue
        inv = 1.0 / sqrt_d[members]
        lap = np.eye(len(members)) - W[np.ix_(members, members)] * inv[:, None] * inv[None, :]
        vals, vecs = np.linalg.eigh((lap + lap.T) * 0.5)
        blocks.append((vals[1:], members, vecs[:, 1:]))   # column 0 is the component's zero
    if blocks:
        nz_vals = np.concatenate([b[0] for b in blocks])
        nz_block = np.concatenate([np.full(len(b[0]), t) for t, b in enumerate(blocks)])
        nz_col = np.concatenate([np.arange(len(b[0])) for b in blocks])
        order = np.argsort(nz_vals, kind="stable")
        nz_vals, nz_block, nz_col = nz_vals[order], nz_block[order], nz_col[order]
    else:
        nz_vals = np.zeros(0)
        nz_block = nz_col = np.zeros(0, dtype=int)

    def vector(t: int) -> np.ndarray:
        v = np.zeros(n)
        vals, members, vecs = blocks[nz_block[t]]
        v[members] = vecs[:, nz_col[t]]
        return v

    spectrum_all = np.concatenate([np.zeros(z), nz_vals])
    eigenvalues = [float(x) for x in np.clip(spectrum_all[:k], CLIP_LO, CLIP_HI)]
    lambda2 = float(eigenvalues[1]) if len(eigenvalues) > 1 else 0.0
    mult = int(sum(1 for x in eigenvalues if x < ZERO_EPS))

    # ---- embedding: columns 1..k-1 of the low spectrum, canonical basis ----
    columns: list[np.ndarray] = []
    degenerate = False
    g = sqrt_d.copy()
    g_norm = np.linalg.norm(g)
    if z > k or g_norm == 0:
        degenerate = z > 1
    else:
        g /= g_norm
        if z >= 2:
            U = null_mat - np.outer(g, g @ null_mat)
            left, sing, _ = np.linalg.svd(U, full_matrices=False)
            columns.extend(left[:, s] for s in range(len(sing)) if sing[s] > 1e-8)
        take = k - z
        if take > 0:
            chosen = list(range(min(take, len(nz_vals))))
            if len(nz_vals) > take and _same(nz_vals[take - 1], nz_vals[take]):
                cut = nz_vals[take - 1]
                chosen = [t for t in chosen if not _same(nz_vals[t], cut)]
                degenerate = True
            columns.extend(vector(t) for t in chosen)
    dims = len(columns)

    outliers: list[str] = []
    if dims > 0:
        X = np.column_stack(columns)
        dist = np.linalg.norm(X - X.mean(axis=0), axis=1)
        mu, sd = float(dist.mean()), max(float(dist.std()), STD_FLOOR)
        outliers = [node_ids[t] for t in np.flatnonzero(dist > mu + sigma * sd)]

    # ---- Fiedler score per node ----
    if z == 1 and len(nz_vals):
        first = nz_vals[0]
        close = np.abs(nz_vals - first) <= GROUP_TOL * np.maximum(1.0, np.maximum(np.abs(nz_vals), abs(first)))
        group = np.flatnonzero(close).tolist()
        score = np.sqrt(np.sum(np.column_stack([vector(t) for t in group]) ** 2, axis=1))
    else:
        pick = min(range(z), key=lambda c: (comp_volume[c], comp_roots[c]))
        score = np.abs(null_mat[:, pick])
    rounded = np.round(score, SCORE_DECIMALS)
    ranked = np.lexsort((np.arange(n), -rounded))
    sub_nodes: list[str] = list(outliers[:top_k])
    seen = set(sub_nodes)
    for t in ranked:
        if len(sub_nodes) >= top_k:
            break
        name = node_ids[t]
        if name not in seen:
            sub_nodes.append(name)
            seen.add(name)
    return {"n": n, "components": z, "eigenvalues": eigenvalues, "lambda2": lambda2,
            "mult": mult, "embed_dims": dims, "degenerate": bool(degenerate),
            "outliers": outliers, "sub_nodes": sub_nodes}


def tiny_summary(n: int) -> dict:
    return {"n": n, "components": None, "eigenvalues": [], "lambda2": 0.0, "mult": 1,
            "embed_dims": 0, "degenerate": False, "outliers": [], "sub_nodes": []}


def summarize_pairs(src: np.ndarray, dst: np.ndarray, weight: np.ndarray,
                    k_max: int = K_MAX, sigma: float = SIGMA, top_k: int = TOP_K) -> dict:
    """Spectral summary of one window from its directed (src, dst, weight) rows."""
    node_ids = np.unique(np.concatenate([src.astype(object), dst.astype(object)]))
    n = len(node_ids)
    if n < 3:
        return tiny_summary(n)
    i = np.searchsorted(node_ids, src)
    j = np.searchsorted(node_ids, dst)
    A = np.zeros((n, n))
    np.add.at(A, (i, j), weight.astype(float))
    return graph_spectrum(list(node_ids), (A + A.T) * 0.5, k_max, sigma, top_k)


def _window_fn(k_max: int, sigma: float, top_k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        summary = summarize_pairs(pdf["src"].to_numpy(), pdf["dst"].to_numpy(),
                                  pdf["weight"].to_numpy(), k_max, sigma, top_k)
        m = int(pdf["cnt"].sum()) if "cnt" in pdf.columns else len(pdf)
        row = {"source_id": pdf["source_id"].iloc[0], "window_no": int(pdf["window_no"].iloc[0]),
               "m": m, "pairs": len(pdf), **summary}
        return pd.DataFrame([row], columns=SPECTRUM_SCHEMA.fieldNames())
    return run


def spectrum(adj: DataFrame, k_max: int = K_MAX, sigma: float = SIGMA, top_k: int = TOP_K,
             max_local: int = 4000, pairs_bound: int | None = None) -> DataFrame:
    """Spectral summary per window of an adjacency table ``(source_id, window_no, src, dst, weight)``.

    ``pairs_bound``: a known upper bound on pairs per window (count windows:
    the window size). When it is within ``max_local`` every window is solved
    locally; otherwise the pairs are written once, windows are split by their
    pair count and the large ones, if any, go to the distributed solver.
    """
    ship_package(adj.sparkSession)
    key = ["source_id", "window_no"]
    extra = ["cnt"] if "cnt" in adj.columns else []
    cols = adj.select(*key, "src", "dst", "weight", *extra)
    fn = _window_fn(k_max, sigma, top_k)
    if pairs_bound is not None and pairs_bound <= max_local:
        return cols.groupBy(*key).applyInPandas(fn, SPECTRUM_SCHEMA)
    # Windows of unknown size: the pairs are read from files below, not computed anew
    # for every use, and Spark knows their size (a streaming batch without new rows
    # that closes windows counts as empty, and all joins would be broadcast).
    path = scratch_path(adj.sparkSession, "pairs")
    cols.write.parquet(path)
    cols = adj.sparkSession.read.schema(cols.schema).parquet(path)
    # Count pairs per window with a partial aggregation (a hot window never lands
    # in one task), then split rows by semi/anti joins on the window key (adaptive
    # execution splits a skewed join partition).
    big_keys = (cols.groupBy(*key).agg(F.count(F.lit(1)).alias("_gw_pairs"))
                .filter(F.col("_gw_pairs") > max_local).select(*key).checkpoint(eager=True))
    if big_keys.isEmpty():
        return cols.groupBy(*key).applyInPandas(fn, SPECTRUM_SCHEMA)
    from graphwatch.operators.distributed_spectrum import few_rows, large_window_spectrum
    big_keys = few_rows(big_keys)
    small = (cols.join(big_keys, key, "left_anti")
             .groupBy(*key).applyInPandas(fn, SPECTRUM_SCHEMA))
    big = cols.join(big_keys, key, "left_semi")
    return small.unionByName(large_window_spectrum(big, k_max=k_max, sigma=sigma, top_k=top_k, stored=True))


# ---------------------------------------------------------------- spectral bisection (G18)

SUSPECT_THRESHOLD = 0.3      # fixed value: Fiedler entry above which a node is listed


def fiedler_entries(node_ids: Sequence[str], weights: np.ndarray) -> np.ndarray | None:
    """Unit Fiedler vector with its sign fixed (largest-magnitude entry positive).

    Connected graph with a simple λ₂: the eigenvector of λ₂. Disconnected
    graph: ``D^1/2·1`` on the smallest-volume component (ties: smallest id),
    normalized. A repeated λ₂ of a connected graph has no unique vector: None.
    """
    n = len(node_ids)
    W = np.array(weights, dtype=float, copy=True)
    np.fill_diagonal(W, 0.0)
    deg = W.sum(axis=1)
    ii, jj = np.nonzero(np.triu(W, 1))
    roots = _component_roots(n, ii, jj)
    comp_roots, comp_of = np.unique(roots, return_inverse=True)
    if len(comp_roots) > 1:
        vol = np.bincount(comp_of, weights=deg, minlength=len(comp_roots))
        pick = min(range(len(comp_roots)), key=lambda c: (vol[c], comp_roots[c]))
        v = np.where(comp_of == pick, np.sqrt(np.clip(deg, 0, None)), 0.0)
        if not v.any():
            v = (comp_of == pick).astype(float)
    else:
        inv = 1.0 / np.sqrt(deg)
        lap = np.eye(n) - W * inv[:, None] * inv[None, :]
        vals, vecs = np.linalg.eigh((lap + lap.T) * 0.5)
        if n > 2 and _same(vals[1], vals[2]):
            return None
        v = vecs[:, 1]
    v = v / np.linalg.norm(v)
    lead = int(np.argmax(np.abs(np.round(v, SCORE_DECIMALS))))
    return v if v[lead] > 0 else -v


def fiedler_suspects(adj: DataFrame, threshold: float = SUSPECT_THRESHOLD,
                     pairs_bound: int | None = None, max_local: int = 4000) -> DataFrame:
    """``(source_id, window_no, node, fiedler)`` for nodes whose sign-fixed Fiedler entry
    exceeds ``threshold``. Windows must be bounded (count windows: ``pairs_bound``)."""
    import pandas as pd

    if pairs_bound is None or pairs_bound > max_local:
        raise ValueError("fiedler_suspects needs windows of at most max_local pairs")
    ship_package(adj.sparkSession)
    key = ["source_id", "window_no"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst = pdf["src"].to_numpy(object), pdf["dst"].to_numpy(object)
        names = np.unique(np.concatenate([src, dst]))
        cols = ["source_id", "window_no", "node", "fiedler"]
        if len(names) < 3:
            return pd.DataFrame(columns=cols)
        A = np.zeros((len(names), len(names)))
        np.add.at(A, (np.searchsorted(names, src), np.searchsorted(names, dst)), pdf["weight"].to_numpy(float))
        v = fiedler_entries(list(names), (A + A.T) * 0.5)
        if v is None:
            return pd.DataFrame(columns=cols)
        hit = np.flatnonzero(np.round(v, SCORE_DECIMALS) > threshold)
        return pd.DataFrame({"source_id": pdf["source_id"].iloc[0], "window_no": int(pdf["window_no"].iloc[0]),
                             "node": names[hit], "fiedler": v[hit]})

    return (adj.select(*key, "src", "dst", "weight").groupBy(*key)
            .applyInPandas(run, "source_id string, window_no long, node string, fiedler double"))
