"""Graph construction per window: adjacency, node index, degrees, Laplacian, components.

Every graph is a long-form table keyed by ``(source_id, window_no)``; an
adjacency matrix in COO form *is* a table, so no matrix object is ever
built on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_KEY = ["source_id", "window_no"]


def adjacency(windowed: DataFrame, key: Sequence[str] = WINDOW_KEY,
              colocate: bool = False, partitions: int | None = None) -> DataFrame:
    """Directed weighted adjacency: parallel edges of a window summed.

    Output ``(*key, src, dst, weight, cnt)``. Spark aggregates partially
    before the shuffle, so repeated pairs cost one shuffled row per task.
    ``colocate=True`` hash-partitions by the window key first: the pair
    aggregation and any later per-window grouping (the spectrum) then share
    that one exchange instead of shuffling twice. The partition count is
    explicit (``spark.sql.shuffle.partitions`` unless given), because the
    per-window eigen step is CPU-bound: adaptive execution would otherwise
    merge the small shuffle output into a few tasks and serialize it.
    """
    if colocate:
        n = partitions or int(windowed.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        src = windowed.repartition(n, *key)
    else:
        src = windowed
    return (src.groupBy(*key, "src", "dst")
            .agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("cnt")))


def nodes(adj: DataFrame, key: Sequence[str] = WINDOW_KEY) -> DataFrame:
    """Distinct nodes of each window (src ∪ dst)."""
    return (adj.select(*key, F.col("src").alias("node"))
            .union(adj.select(*key, F.col("dst").alias("node")))
            .distinct())


def node_index(adj: DataFrame, key: Sequence[str] = WINDOW_KEY) -> DataFrame:
    """``(*key, node, idx)``: 0-based lexicographic (code-point) position of each node."""
    w = Window.partitionBy(*key).orderBy("node")
    return nodes(adj, key).withColumn("idx", (F.row_number().over(w) - 1).cast("int"))


def window_graph_sizes(adj: DataFrame, key: Sequence[str] = WINDOW_KEY) -> DataFrame:
    """``(*key, n)``: node count per window."""
    return nodes(adj, key).groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("n"))


def symmetrize(adj: DataFrame, key: Sequence[str] = WINDOW_KEY) -> DataFrame:
    """``(A + Aᵀ) / 2`` as ``(*key, src, dst, weight)``; self-loops keep their weight."""
    fwd = adj.select(*key, "src", "dst", "weight")
    rev = adj.select(*key, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return (fwd.union(rev).groupBy(*key, "src", "dst")
            .agg((F.sum("weight") / 2.0).alias("weight")))


def degrees(adj: DataFrame, key: Sequence[str] = WINDOW_KEY) -> DataFrame:
    """Weighted degree of the symmetrized graph, self-loops excluded; 0 for isolated nodes."""
    off = adj.filter(F.col("src") != F.col("dst"))
    half = (off.select(*key, F.col("src").alias("node"), (F.col("weight") / 2.0).alias("w"))
            .union(off.select(*key, F.col("dst").alias("node"), (F.col("weight") / 2.0).alias("w")))
            .groupBy(*key, "node").agg(F.sum("w").alias("degree")))
    return (nodes(adj, key).join(half, [*key, "node"], "left")
            .select(*key, "node", F.coalesce("degree", F.lit(0.0)).alias("degree")))


def laplacian_entries(adj: DataFrame, key: Sequence[str] = WINDOW_KEY) -> DataFrame:
    """Non-zero entries of ``I - D^-1/2 W D^-1/2`` as ``(*key, i, j, value)``.

    ``W`` is the symmetrized graph without self-loops; the diagonal is 1,
    or 0 for a node without neighbours. ``i``/``j`` are node indexes.
    """
    idx = node_index(adj, key)
    deg = degrees(adj, key)
    info = idx.join(deg, [*key, "node"])
    sym = symmetrize(adj, key).filter((F.col("src") != F.col("dst")) & (F.col("weight") != 0))
    a = info.select(*key, F.col("node").alias("src"), F.col("idx").alias("i"),
                    F.col("degree").alias("d_i"))
    b = info.select(*key, F.col("node").alias("dst"), F.col("idx").alias("j"),
                    F.col("degree").alias("d_j"))
    off = (sym.join(a, [*key, "src"]).join(b, [*key, "dst"])
           .select(*key, "i", "j",
                   (-F.col("weight") / F.sqrt(F.col("d_i") * F.col("d_j"))).alias("value")))
    diag = info.select(*key, F.col("idx").alias("i"), F.col("idx").alias("j"),
                       F.when(F.col("degree") > 0, 1.0).otherwise(0.0).alias("value"))
    return off.unionByName(diag).filter(F.col("value") != 0)


def _local_components(key: Sequence[str]):
    import numpy as np
    import pandas as pd

    from graphwatch.operators.spectrum import _component_roots

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([pdf["src"].to_numpy(object), pdf["dst"].to_numpy(object)]))
        off = pdf[pdf["src"] != pdf["dst"]]
        roots = _component_roots(len(names), np.searchsorted(names, off["src"].to_numpy(object)),
                                 np.searchsorted(names, off["dst"].to_numpy(object)))
        out = pd.DataFrame({"node": names, "component": names[roots]})
        for k in key:
            out.insert(0, k, pdf[k].iloc[0])
        return out
    return run


def components(adj: DataFrame, key: Sequence[str] = WINDOW_KEY, pairs_bound: int | None = None,
               max_local: int = 4000, max_iter: int = 64) -> DataFrame:
    """Connected components of each window's undirected graph (self-loops ignored).

    Output ``(*key, node, component)``; ``component`` is the smallest node
    id of the component. When every window is known to hold at most
    ``max_local`` pairs (``pairs_bound``, e.g. the count-window size), each
    window is solved by union-find in a grouped Arrow function. Otherwise
    the distributed min-label propagation runs (``propagate_components``).
    """
    from graphwatch.session import ship_package

    k = list(key)
    if pairs_bound is not None and pairs_bound <= max_local:
        ship_package(adj.sparkSession)
        schema = adj.select(*k).schema.add("node", "string").add("component", "string")
        return adj.select(*k, "src", "dst").groupBy(*k).applyInPandas(_local_components(k), schema)
    return propagate_components(adj, k)


def propagate_components(adj: DataFrame, key: Sequence[str] = WINDOW_KEY,
                         max_iter: int = 200) -> DataFrame:
    """Components: pairs contracted task by task, then alternating star steps as
    DataFrame joins.

    Contraction (union-find over what a task sees) leaves at most a link for each
    node and task. A large-star step links every larger neighbour of a node to the smallest
    node around it, a small-star step every smaller one. Links of a component
    end as one star around its smallest node; a path of any length settles in a
    number of rounds that grows with the logarithm of its nodes. Every round's
    links are written with a reliable ``checkpoint()``. Raises where
    ``max_iter`` rounds do not settle, instead of returning wrong components.
    Tables with a row per node are merged, never broadcast through the driver.
    """
    from graphwatch.session import ship_package

    k = list(key)
    ship_package(adj.sparkSession)
    linked = F.coalesce(F.col("src") != F.col("dst"), F.lit(False))
    pairs = adj.filter(linked).select(*k, "src", "dst")
    # pairs of one end lie together (a large end is split), so that contraction leaves
    # little more than a link for each node
    near = (pairs.withColumn("_bucket", F.pmod(F.xxhash64("src"), F.lit(CONTRACTION_BUCKETS)))
            .hint("rebalance", *[F.col(c) for c in (*k, "_bucket")]).select(*pairs.columns))
    links = (near.mapInArrow(_contracted(k), pairs.schema)
             .select(*k, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
             .distinct().checkpoint(eager=True))
    every = nodes(links.select(*k, F.col("u").alias("src"), F.col("v").alias("dst"))
                  .unionByName(adj.filter(~linked).select(*k, "src", "dst")), k)
    before = _links_state(links, k)
    for _ in range(max_iter):
        links = _small_star(_large_star(links, k), k).checkpoint(eager=True)
        now = _links_state(links, k)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {max_iter} rounds")
    named = links.select(*k, F.col("u").alias("node"), F.col("v").alias("component")).hint("merge")
    return (every.join(named, [*k, "node"], "left")
            .select(*k, "node", F.coalesce("component", "node").alias("component")))


CONTRACTION_BUCKETS = 16     # of a window's pairs, by their first end
CONTRACTION_ROWS = 1 << 18   # pairs that are contracted at once
CONTRACTION_LINKS = 1 << 20  # links of a window that a task holds; beyond, they are given out


def _contracted(key: Sequence[str]):
    """Pairs (key, src, dst) -> links that join the same nodes in the same components:
    of what a task sees, one link from each node but one to the component's first."""
    import numpy as np
    import pyarrow as pa

    from graphwatch.operators.spectrum import _component_roots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: dict[tuple, tuple[pa.Array, pa.Array]] = {}
        held, n, schema = [], 0, None

        def rows_of(window: tuple) -> pa.RecordBatch:
            src, dst = links.pop(window)
            keys = [pa.array([x] * len(src), schema.field(c).type) for x, c in zip(window, key)]
            return pa.RecordBatch.from_arrays([*keys, src, dst], schema=schema)

        def contract() -> None:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            code = np.zeros(rows.num_rows, np.int64)
            for c in range(len(key)):
                column = rows.column(c).dictionary_encode(null_encoding="encode")
                code = np.unique(code * len(column.dictionary) + column.indices.to_numpy(), return_inverse=True)[1]
            for k in range(int(code.max()) + 1):
                own = rows.take(pa.array(np.flatnonzero(code == k)))
                window = tuple(own.column(c)[0].as_py() for c in range(len(key)))
                src, dst = (own.column(len(key) + c) for c in (0, 1))
                if window in links:
                    src, dst = (pa.concat_arrays([x, y]) for x, y in zip((src, dst), links[window]))
                ends = pa.concat_arrays([src, dst]).dictionary_encode()
                at = ends.indices.to_numpy()
                roots = _component_roots(len(ends.dictionary), at[:len(src)], at[len(src):])
                far = np.flatnonzero(roots != np.arange(len(roots)))
                links[window] = ends.dictionary.take(pa.array(far)), ends.dictionary.take(pa.array(roots[far]))

        for batch in batches:
            if batch.num_rows:
                schema = batch.schema
                held.append(batch)
                n += batch.num_rows
            if n >= CONTRACTION_ROWS:
                contract()
                held, n = [], 0
                yield from [rows_of(w) for w in list(links) if len(links[w][0]) > CONTRACTION_LINKS]
        if held:
            contract()
        for w in list(links):
            yield rows_of(w)
    return run


def _large_star(links: DataFrame, k: list[str]) -> DataFrame:
    both = links.unionByName(links.select(*k, F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(*k, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return (both.join(low.hint("merge"), [*k, "u"]).filter(F.col("v") > F.col("u"))
            .select(*k, F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(links: DataFrame, k: list[str]) -> DataFrame:
    low = links.groupBy(*k, "u").agg(F.min("v").alias("m"))
    moved = links.join(low.hint("merge"), [*k, "u"]).select(*k, F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select(*k, "u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct()


def _links_state(links: DataFrame, k: list[str]) -> tuple:
    h = F.xxhash64(*k, "u", "v")
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.xxhash64(h).cast("decimal(38,0)"))).first())


def component_counts(comps: DataFrame, key: Sequence[str] = WINDOW_KEY) -> DataFrame:
    """``(*key, n_components, largest)`` per window."""
    sizes = comps.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("n_components"),
                                   F.max("size").cast("int").alias("largest"))
