"""Anomaly subgraph, its DOT text, and the window's first log lines.

Only anomalous windows pay for this: the chosen nodes (at most ``k`` per
window, already picked by the spectrum step) are joined back to the
adjacency, and the raw lines are joined back by window. The anomalous
window set is not size-bounded (a bad baseline can flag every window), so
these are plain joins — adaptive execution turns them into broadcasts at
run time when the measured side is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwatch.functions.text import fmt_g
from graphwatch.schema import STATUS_ANOMALY

WINDOW_KEY = ["source_id", "window_no"]
LOG_LINES = 30           # fixed value: raw lines attached to an anomaly

# Own DOT style.
DOT_NAME = "graphwatch"
HOT = "#d62728"
COLD = "#7f7f7f"


def induced_edges(adj: DataFrame, chosen: DataFrame, key: Sequence[str] = WINDOW_KEY) -> DataFrame:
    """Directed adjacency cells with both ends in ``chosen (*key, node)`` and weight ≠ 0."""
    k = list(key)
    s = chosen.select(*k, F.col("node").alias("src"))
    d = chosen.select(*k, F.col("node").alias("dst"))
    return (adj.filter(F.col("weight") != 0)
            .join(s, [*k, "src"], "left_semi")
            .join(d, [*k, "dst"], "left_semi")
            .select(*k, "src", "dst", "weight"))


def subgraph_edges(windows: DataFrame, adj: DataFrame, key: Sequence[str] = WINDOW_KEY,
                   nodes_col: str = "sub_nodes") -> DataFrame:
    """``(*key, edges array<struct<src,dst,weight>>)`` for every window row given, sorted by (src, dst)."""
    k = list(key)
    chosen = windows.select(*k, F.explode(nodes_col).alias("node"))
    e = induced_edges(adj, chosen, k)
    return (e.groupBy(*k)
            .agg(F.array_sort(F.collect_list(F.struct("src", "dst", "weight"))).alias("edges")))


def dot_text(nodes: Column, edges: Column, anomalous: Column) -> Column:
    """DOT digraph: anomalous nodes and edges touching them in the hot colour; ``%g`` labels."""
    node_lines = F.transform(nodes, lambda n: F.format_string(
        '  "%s" [color="%s", fontcolor="%s"];', n,
        F.when(F.array_contains(anomalous, n), HOT).otherwise(COLD),
        F.when(F.array_contains(anomalous, n), HOT).otherwise(COLD)))
    edge_lines = F.transform(edges, lambda e: F.format_string(
        '  "%s" -> "%s" [label="%s", color="%s"];', e["src"], e["dst"], fmt_g(e["weight"]),
        F.when(F.array_contains(anomalous, e["src"]) | F.array_contains(anomalous, e["dst"]), HOT)
        .otherwise(COLD)))
    body = F.concat(F.array(F.lit(f"digraph {DOT_NAME} {{"), F.lit("  rankdir=LR;")),
                    node_lines, F.coalesce(edge_lines, F.array()), F.array(F.lit("}")))
    return F.concat(F.array_join(body, "\n"), F.lit("\n"))


LOG_SALT = 256           # first-stage split of a window for the top-k of its lines


def window_logs(windowed: DataFrame, windows: DataFrame, key: Sequence[str] = WINDOW_KEY,
                limit: int = LOG_LINES, order: str | Sequence[str] = "rank") -> DataFrame:
    """First ``limit`` non-empty raw lines (in stream order) of each window in ``windows``.

    Two-level top-k: the first ``limit`` per (window, salt) are kept, then
    the first ``limit`` of those candidates (at most ``256 * limit`` rows per
    window), so even a window holding a large share of all rows is never
    sorted in one task.
    """
    k = list(key)
    ords = [order] if isinstance(order, str) else list(order)
    lines = (windowed.filter(F.col("raw").isNotNull() & (F.col("raw") != ""))
             .join(windows.select(*k), k, "left_semi")
             .withColumn("_salt", F.pmod(F.xxhash64(*ords), F.lit(LOG_SALT))))
    w1 = Window.partitionBy(*k, "_salt").orderBy(*ords)
    cand = lines.withColumn("_n1", F.row_number().over(w1)).filter(F.col("_n1") <= limit)
    w = Window.partitionBy(*k).orderBy(*ords)
    first = cand.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit)
    return (first.groupBy(*k)
            .agg(F.array_sort(F.collect_list(F.struct("_n", "raw"))).alias("_l"))
            .select(*k, F.transform("_l", lambda s: s["raw"]).alias("logs")))


def anomaly_details(windows: DataFrame, adj: DataFrame, windowed: DataFrame,
                    key: Sequence[str] = WINDOW_KEY) -> DataFrame:
    """Anomalous windows with ``nodes``, ``edges``, ``dot`` and ``logs`` attached."""
    k = list(key)
    anom = windows.filter(F.col("status") == STATUS_ANOMALY)
    edges = subgraph_edges(anom, adj, k)
    logs = window_logs(windowed, anom, k)
    out = (anom.join(edges, k, "left").join(logs, k, "left")
           .withColumn("nodes", F.col("sub_nodes"))
           .withColumn("edges", F.coalesce("edges", F.array().cast(
               "array<struct<src:string,dst:string,weight:double>>")))
           .withColumn("logs", F.coalesce("logs", F.array().cast("array<string>"))))
    anomalous = F.when(F.size("outliers") > 0, F.col("outliers")).otherwise(F.col("nodes"))
    return out.withColumn("dot", dot_text(F.col("nodes"), F.col("edges"), anomalous))
