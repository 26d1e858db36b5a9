"""Spectral summary of windows too large for one task.

Same definition as ``operators.spectrum`` (the union of component spectra,
canonical null space, cut repeated groups dropped), computed without ever
holding a whole window in one task:

1. connected components of every large window by distributed label
   propagation (``graph.propagate_components``);
2. every component is one group of a grouped Arrow function, solved densely
   up to MAX_COMPONENT_NODES and by restarted Lanczos above
   (``operators.krylov``); it emits one row per node with the component's ``k+1`` smallest non-zero
   eigenvalues and the node's entries of their eigenvectors. A window of two or
   more components has a zero for each: where these fill its ``k`` values, no
   non-zero pair enters the summary, and only degrees are computed;
3. the window summary is assembled with DataFrame aggregations: the k
   smallest values of the union, null-space coordinates from component
   volumes (``sqrt(d_i/vol_c)·Q_c`` with ``Q`` an orthonormal basis of the
   complement of ``(sqrt(vol_c/vol))_c``), centroid distances in long form
   (a node has a coordinate only in its own component's columns), outliers,
   Fiedler scores, and the top-k subgraph ranking.

A component of more than ``max_task_pairs`` pairs is never solved in one task:
it goes to Spark's distributed singular value decomposition
(``krylov.smallest_pairs_distributed``). Where λ₂ repeats as often as values
are computed (a star of thousands of leaves above MAX_COMPONENT_NODES), its
whole eigenspace is not known and its nodes rank by id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphwatch.operators.graph import propagate_components
from graphwatch.operators.krylov import TASK_PAIRS, smallest_pairs, smallest_pairs_distributed
from graphwatch.operators.spectrum import (GROUP_TOL, K_MAX, SCORE_DECIMALS, SIGMA, STD_FLOOR,
                                           TOP_K, ZERO_EPS)
from graphwatch.schema import SPECTRUM_SCHEMA
from graphwatch.session import ship_package

KEY = ["source_id", "window_no"]
MAX_COMPONENT_NODES = 6000

_NODE_SCHEMA = T.StructType([
    T.StructField("source_id", T.StringType()), T.StructField("window_no", T.LongType()),
    T.StructField("component", T.StringType()), T.StructField("node", T.StringType()),
    T.StructField("degree", T.DoubleType()), T.StructField("vals", T.ArrayType(T.DoubleType())),
    T.StructField("vec", T.ArrayType(T.DoubleType())),
    T.StructField("g1", T.DoubleType()),
])


def _lambda2_norm(vals: np.ndarray, vecs: np.ndarray, whole: bool) -> np.ndarray:
    """Each node's norm over the eigenspace of the smallest non-zero value; 0 where
    that value fills all columns, which need not be ``whole``."""
    if not len(vals):
        return np.zeros(len(vecs))
    first = vals[0]
    same = np.abs(vals - first) <= GROUP_TOL * np.maximum(1.0, np.maximum(np.abs(vals), abs(first)))
    if same.all() and not whole:
        return np.zeros(len(vecs))
    return np.sqrt(np.sum(vecs[:, same] ** 2, axis=1))


def _component_fn(keep: int, dense_nodes: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([pdf["src"].to_numpy(object), pdf["dst"].to_numpy(object)]))
        n = len(names)
        i = np.searchsorted(names, pdf["src"].to_numpy(object))
        j = np.searchsorted(names, pdf["dst"].to_numpy(object))
        weight = pdf["weight"].to_numpy(float)
        deg = np.bincount(i, weight * (i != j) * 0.5, n) + np.bincount(j, weight * (i != j) * 0.5, n)
        if n < 2 or not np.all(deg > 0):
            vals, vecs, g1 = np.zeros(0), np.zeros((n, 0)), np.zeros(n)
        elif n > dense_nodes:
            deg, vals, vecs = smallest_pairs(i, j, weight, n, keep)
            g1 = _lambda2_norm(vals, vecs, whole=len(vals) == n - 1)
        else:
            A = np.zeros((n, n))
            np.add.at(A, (i, j), weight)
            W = (A + A.T) * 0.5
            np.fill_diagonal(W, 0.0)
            inv = 1.0 / np.sqrt(deg)
            lap = np.eye(n) - W * inv[:, None] * inv[None, :]
            vals, vecs = np.linalg.eigh((lap + lap.T) * 0.5)
            g1 = _lambda2_norm(vals[1:], vecs[:, 1:], whole=True)
            vals, vecs = vals[1:keep + 1], vecs[:, 1:keep + 1]
        return pd.DataFrame({
            "source_id": pdf["source_id"].iloc[0], "window_no": int(pdf["window_no"].iloc[0]),
            "component": pdf["component"].iloc[0], "node": names, "degree": deg,
            "vals": [list(map(float, vals))] * n, "vec": [list(map(float, r)) for r in vecs],
            "g1": g1.astype(float)})
    return run


def _null_basis_fn(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per window (z <= k components): rows of an orthonormal basis of a^⊥, a_c = sqrt(vol_c/vol)."""
    pdf = pdf.sort_values("component")
    z = len(pdf)
    vol = pdf["vol"].to_numpy(float)
    a = np.sqrt(vol / vol.sum()) if vol.sum() > 0 else np.zeros(z)
    P = np.eye(z) - np.outer(a, a)
    left, sing, _ = np.linalg.svd(P)
    Q = left[:, sing > 1e-8]
    return pd.DataFrame({"source_id": pdf["source_id"].to_numpy(), "window_no": pdf["window_no"].to_numpy(),
                         "component": pdf["component"].to_numpy(),
                         "q": [list(map(float, r)) for r in Q]})


def _degree_rows(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of ``_NODE_SCHEMA`` without eigenpairs: each node with its degree (loops count nothing)."""
    w = F.coalesce("weight", F.lit(float("nan"))) * (F.col("src") != F.col("dst")).cast("double") * 0.5
    degree = F.sum("w")
    return (pairs.select(*KEY, w.alias("w"), F.explode(F.array("src", "dst")).alias("node"))
            .groupBy(*KEY, "node").agg(F.when(~F.isnan(degree), degree).alias("degree"))
            .join(comps.hint("merge"), [*KEY, "node"])
            .withColumns({"vals": F.array().cast("array<double>"), "vec": F.array().cast("array<double>"), "g1": F.lit(0.0)})
            .select(*_NODE_SCHEMA.fieldNames()))


FEW_ROWS = 100_000


def few_rows(windows: DataFrame) -> DataFrame:
    """A table with a row per window, sent to every task where it has at most
    FEW_ROWS: a join with it then leaves the pairs of a few large windows where
    they are, instead of dealing them by window."""
    return F.broadcast(windows) if windows.limit(FEW_ROWS + 1).count() <= FEW_ROWS else windows


SALT = 256


def _top_rows(df: DataFrame, order: list, limit: Column | int, salt_cols: list[str],
              rank_col: str) -> DataFrame:
    """Rows ranked ``1..limit`` per window by ``order``, in two levels: the first
    ``limit`` per (window, salt) are kept, then ranked per window among those
    candidates (at most ``SALT * limit`` rows), so no window is sorted whole."""
    lim = F.lit(limit) if isinstance(limit, int) else limit
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_cols), F.lit(SALT)))
    w1 = Window.partitionBy(*KEY, "_salt").orderBy(*order)
    cand = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= lim)
    w2 = Window.partitionBy(*KEY).orderBy(*order)
    return (cand.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= lim)
            .drop("_salt", "_r1"))


def large_window_spectrum(adj: DataFrame, k_max: int = K_MAX, sigma: float = SIGMA,
                          top_k: int = TOP_K, max_component_nodes: int | None = None,
                          max_task_pairs: int = TASK_PAIRS, stored: bool = False) -> DataFrame:
    """Spectral summary rows (``SPECTRUM_SCHEMA``) for the windows in ``adj``.
    ``stored``: its rows are read from files, not computed anew for every use."""
    spark = adj.sparkSession
    ship_package(spark)
    dense_nodes = max_component_nodes or MAX_COMPONENT_NODES
    if not stored:
        adj = adj.checkpoint(eager=True)
    comps = propagate_components(adj, KEY).checkpoint(eager=True)
    sizes = adj.groupBy(*KEY).agg(F.count(F.lit(1)).alias("pairs"),
                                  (F.sum("cnt") if "cnt" in adj.columns else F.count(F.lit(1))).alias("m")).checkpoint(eager=True)
    # ---- per component: one group of a grouped function or, above max_task_pairs,
    # the distributed decomposition; one row per node
    # (tables with a row per node or component are merged, never broadcast)
    k_of = F.greatest(F.lit(1), F.least(F.lit(k_max), F.col("n") - 1))
    # windows whose zeros fill the k values
    full = (comps.groupBy(*KEY, "component").agg(F.count(F.lit(1)).alias("n_c"))
            .groupBy(*KEY).agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("z"))
            .filter((F.col("z") > 1) & (F.col("z") >= k_of)).select(*KEY).checkpoint(eager=True))
    full = few_rows(full)
    with_comp = (adj.join(full, KEY, "left_anti").join(comps.withColumnRenamed("node", "src").hint("merge"), [*KEY, "src"])
                 .select(*KEY, "component", "src", "dst", "weight"))
    large = (with_comp.groupBy(*KEY, "component").agg(F.count(F.lit(1)).alias("_pairs"))
             .filter(F.col("_pairs") > max_task_pairs).select(*KEY, "component").checkpoint(eager=True))
    small = with_comp.join(large, [*KEY, "component"], "left_anti")
    nodes = small.groupBy(*KEY, "component").applyInPandas(_component_fn(k_max + 1, dense_nodes), _NODE_SCHEMA)
    if large.limit(1).count():
        giant = with_comp.join(large, [*KEY, "component"], "left_semi").checkpoint(eager=True)
        solved = smallest_pairs_distributed(giant, k_max + 1)
        # the norm over the columns that hold the smallest value, unless it holds all
        first = F.get("vals", F.lit(0))
        alike = F.transform("vals", lambda x: F.abs(x - first) <= F.lit(GROUP_TOL) * F.greatest(F.lit(1.0), F.abs(x), F.abs(first)))
        square = F.aggregate(F.zip_with("vec", alike, lambda x, a: F.when(a, x * x).otherwise(0.0)), F.lit(0.0), lambda t, x: t + x)
        nodes = nodes.unionByName(solved.withColumn(
            "g1", F.when(F.forall(alike, lambda a: a), F.lit(0.0)).otherwise(F.sqrt(square))))
    nodes = nodes.unionByName(_degree_rows(adj.join(full, KEY, "left_semi"), comps))
    nodes = nodes.checkpoint(eager=True)
    comp = (nodes.groupBy(*KEY, "component")
            .agg(F.count(F.lit(1)).alias("n_c"), F.sum("degree").alias("vol"),
                 F.first("vals").alias("vals")))
    win = (comp.groupBy(*KEY).agg(F.sum("n_c").cast("int").alias("n"),
                                  F.count(F.lit(1)).cast("int").alias("z"),
                                  F.sum("vol").alias("vol_all"))
           .withColumn("k", k_of)
           .join(sizes, KEY))
    # ---- the low non-zero spectrum of the union
    nz = (comp.select(*KEY, "component", F.posexplode("vals").alias("idx", "val"))
          .join(win.select(*KEY, "k", "z"), KEY))
    nz = _top_rows(nz, [F.col("val"), F.col("component"), F.col("idx")], F.col("k") + 1,
                   ["component"], "rk").checkpoint(eager=True)
    low = (nz.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rk", "val"))).alias("_v"))
           .select(*KEY, F.transform("_v", lambda s: s["val"]).alias("nz_vals")))
    win = win.join(low, KEY, "left").withColumn(
        "nz_vals", F.coalesce("nz_vals", F.array().cast("array<double>")))
    all_vals = F.concat(F.array_repeat(F.lit(0.0), F.col("z")), F.col("nz_vals"))
    eig = F.transform(F.slice(all_vals, 1, F.col("k")),
                      lambda x: F.least(F.lit(2.0), F.greatest(F.lit(0.0), x)))
    take = F.col("k") - F.col("z")
    v_last, v_next = F.get("nz_vals", take - 1), F.get("nz_vals", take)      # null out of bounds
    same = F.abs(v_last - v_next) <= F.lit(GROUP_TOL) * F.greatest(F.lit(1.0), F.abs(v_last),
                                                                   F.abs(v_next))
    cut_nz = (take > 0) & (F.size("nz_vals") > take) & F.coalesce(same, F.lit(False))
    win = (win.withColumn("eigenvalues", eig)
           .withColumn("lambda2", F.coalesce(F.element_at("eigenvalues", 2), F.lit(0.0)))
           .withColumn("mult", F.size(F.filter("eigenvalues", lambda x: x < F.lit(ZERO_EPS))))
           .withColumn("cut_val", F.when(cut_nz, v_last))
           .withColumn("null_ok", (F.col("z") <= F.col("k")) & (F.col("vol_all") > 0))
           .withColumn("degenerate", (F.col("z") > F.col("k")) & (F.col("z") > 1) | cut_nz)
           .checkpoint(eager=True))
    # ---- embedding coordinates in long form: (key, node, dim, x)
    chosen = (nz.join(win.select(*KEY, "cut_val", "null_ok"), KEY)
              .filter(F.col("null_ok") & (F.col("rk") <= F.col("k") - F.col("z")))
              .filter(F.col("cut_val").isNull()
                      | (F.abs(F.col("val") - F.col("cut_val"))
                         > F.lit(GROUP_TOL) * F.greatest(F.lit(1.0), F.abs("val"), F.abs("cut_val")))))
    ev_coords = (nodes.join(chosen.select(*KEY, "component", "idx", "rk"), [*KEY, "component"])
                 .select(*KEY, "node", F.concat(F.lit("e"), F.col("rk").cast("string")).alias("dim"),
                         F.element_at("vec", F.col("idx") + 1).alias("x")))
    multi = win.filter(F.col("null_ok") & (F.col("z") >= 2)).select(*KEY)
    qrows = (comp.join(multi, KEY, "left_semi").select(*KEY, "component", "vol")
             .groupBy(*KEY).applyInPandas(
                 _null_basis_fn, "source_id string, window_no long, component string, q array<double>"))
    null_coords = (nodes.join(qrows, [*KEY, "component"]).join(
        comp.select(*KEY, "component", "vol").hint("merge"), [*KEY, "component"])
                   .select(*KEY, "node", F.posexplode("q").alias("_j", "_q"),
                           F.sqrt(F.col("degree") / F.col("vol")).alias("_u"))
                   .select(*KEY, "node", F.concat(F.lit("z"), F.col("_j").cast("string")).alias("dim"),
                           (F.col("_u") * F.col("_q")).alias("x")))
    coords = ev_coords.unionByName(null_coords).checkpoint(eager=True)
    n_of = win.select(*KEY, "n")
    mu = coords.groupBy(*KEY, "dim").agg(F.sum("x").alias("_sx")).join(n_of, KEY) \
        .withColumn("mu", F.col("_sx") / F.col("n"))
    s_all = mu.groupBy(*KEY).agg(F.sum(F.col("mu") ** 2).alias("S"), F.count(F.lit(1)).alias("dims"))
    part = (coords.join(mu.select(*KEY, "dim", "mu"), [*KEY, "dim"])
            .groupBy(*KEY, "node").agg(F.sum(F.col("x") ** 2 - 2 * F.col("x") * F.col("mu")).alias("_p")))
    dist = (nodes.select(*KEY, "node", "component", "degree").join(part.hint("merge"), [*KEY, "node"], "left")
            .join(s_all, KEY, "left")
            .withColumn("d", F.sqrt(F.greatest(F.lit(0.0), F.coalesce("S", F.lit(0.0))
                                               + F.coalesce("_p", F.lit(0.0))))))
    stats = dist.groupBy(*KEY).agg(F.avg("d").alias("_m"),
                                   F.greatest(F.stddev_pop("d"), F.lit(STD_FLOOR)).alias("_sd"))
    dist = dist.join(stats, KEY).withColumn(
        "is_out", F.coalesce(F.col("dims"), F.lit(0)) > 0).withColumn(
        "is_out", F.col("is_out") & (F.col("d") > F.col("_m") + F.lit(sigma) * F.col("_sd")))
    # ---- Fiedler score
    # connected window: norm of the node's row over the whole lowest non-zero eigenspace
    conn_score = (nodes.join(win.filter(F.col("z") == 1).select(*KEY), KEY, "left_semi")
                  .select(*KEY, "node", F.col("g1").alias("score")))
    picked = (comp.join(win.filter(F.col("z") > 1).select(*KEY), KEY, "left_semi")
              .groupBy(*KEY).agg(F.min_by(F.struct("component", "vol"),
                                          F.struct("vol", "component")).alias("_p"))
              .select(*KEY, F.col("_p.component").alias("component"), F.col("_p.vol").alias("_pv")))
    disc_score = nodes.join(picked, [*KEY, "component"]).select(
        *KEY, "node", F.when(F.col("_pv") > 0, F.sqrt(F.col("degree") / F.col("_pv")))
        .otherwise(F.lit(1.0)).alias("score"))
    scores = conn_score.unionByName(disc_score)
    ranked = (dist.join(scores.hint("merge"), [*KEY, "node"], "left")
              .withColumn("score", F.coalesce("score", F.lit(0.0))))
    order = [F.when(F.col("is_out"), 0).otherwise(1), F.when(F.col("is_out"), F.col("node")),
             F.desc(F.round("score", SCORE_DECIMALS)), F.col("node")]
    top = _top_rows(ranked, order, top_k, ["node"], "_pos")
    subs = top.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("_pos", "node"))).alias("_s"))
    outs = dist.filter("is_out").groupBy(*KEY).agg(F.array_sort(F.collect_list("node")).alias("outliers"))
    return (win.join(subs, KEY, "left").join(outs, KEY, "left").join(s_all.select(*KEY, "dims"), KEY, "left")
            .select(*KEY, "n", F.col("m").cast("long").alias("m"), F.col("pairs").cast("long").alias("pairs"),
                    F.col("z").alias("components"), "eigenvalues", "lambda2", F.col("mult").cast("int").alias("mult"),
                    F.coalesce("dims", F.lit(0)).cast("int").alias("embed_dims"), "degenerate",
                    F.coalesce("outliers", F.array().cast("array<string>")).alias("outliers"),
                    F.coalesce(F.transform("_s", lambda s: s["node"]), F.array().cast("array<string>"))
                    .alias("sub_nodes"))
            .select(*SPECTRUM_SCHEMA.fieldNames()))
