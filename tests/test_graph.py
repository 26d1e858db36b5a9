"""Graph operators: components (grouped and distributed), window positions with tiny windows."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from graphwatch.operators import baseline as bl
from graphwatch.operators import graph as G
from graphwatch.operators.graph import components, propagate_components


def test_components_long_chain_and_grouped_agree(spark):
    # window 0: a chain of 60 nodes (diameter 59) plus a separate pair; window 1: a star
    rows = [("s", 0, f"n{i:03d}", f"n{i + 1:03d}", 1.0) for i in range(59)]
    rows += [("s", 0, "x1", "x2", 1.0), ("s", 0, "y", "y", 2.0)]
    rows += [("s", 1, "hub", f"l{i}", 1.0) for i in range(10)]
    adj = spark.createDataFrame(rows, "source_id string, window_no long, src string, dst string, weight double")
    dist = {(r.window_no, r.node): r.component for r in propagate_components(adj).collect()}
    grp = {(r.window_no, r.node): r.component for r in components(adj, pairs_bound=100).collect()}
    assert dist == grp
    assert dist[(0, "n059")] == "n000" and dist[(0, "x2")] == "x1" and dist[(0, "y")] == "y"
    assert {dist[(1, f"l{i}")] for i in range(10)} == {"hub"}


def test_window_positions_skip_tiny_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(bl, "RANK_BUCKET", 7)
    n = [2 if w % 5 == 0 else 10 for w in range(40)]          # every 5th window is tiny
    df = spark.createDataFrame([("s", w, n[w]) for w in range(40)], "source_id string, window_no long, n int")
    got = {r.window_no: r.r for r in bl.rank_windows(df).collect()}
    expect, k = {}, 0
    for w in range(40):
        if n[w] >= 3:
            expect[w] = k
            k += 1
        else:
            expect[w] = None
    assert got == expect


def test_running_counts_and_changes(spark, monkeypatch):
    from graphwatch.operators import analyze as A

    monkeypatch.setattr(A, "POSITION_BUCKET", 4)
    st = ["normal", "ANOMALY", "ANOMALY", "normal", "normal", "ANOMALY"] * 3
    df = spark.createDataFrame([("s", w, s, 1) for w, s in enumerate(st)],
                               "source_id string, window_no long, status string, mult int")
    run = {r.window_no: r.anomalies_so_far for r in A.running_anomalies(df).collect()}
    acc, expect = 0, {}
    for w, s in enumerate(st):
        acc += s == "ANOMALY"
        expect[w] = acc
    assert run == expect
    ch = sorted(r.window_no for r in A.snapshot_changes(df, ("status",)).collect())
    assert ch == [0] + [w for w in range(1, len(st)) if st[w] != st[w - 1]]
    assert A.snapshot_changes(df, ("status",)).filter(F.col("window_no") == 0).count() == 1


def test_contraction_leaves_a_link_a_node(monkeypatch):
    rng = random.Random(4)
    rows = [(w, w and len(w), f"{w}{rng.randrange(40)}", f"{w}é{rng.randrange(40)}") for w in ("a", None, "bc") for _ in range(700)]
    rows += [("a", 1, f"x{k}", f"x{k + 1}") for k in range(30)]
    rng.shuffle(rows)
    table = pa.table(dict(zip(("source_id", "window_no", "src", "dst"), map(list, zip(*rows)))))
    for size, most in ((1 << 18, 1 << 20), (100, 1 << 20), (100, 20)):
        monkeypatch.setattr(G, "CONTRACTION_ROWS", size)
        monkeypatch.setattr(G, "CONTRACTION_LINKS", most)
        links = [tuple(r.values()) for b in G._contracted(["source_id", "window_no"])(iter(table.to_batches(37))) for r in b.to_pylist()]

        def groups(pairs):
            root = {}
            for *w, u, v in pairs:
                a, b = (root.setdefault((*w, x), {(*w, x)}) for x in (u, v))
                if a is not b:
                    a |= b
                    root.update(dict.fromkeys(b, a))
            return {frozenset(x) for x in root.values()}

        assert groups(links) == groups(rows)
        assert most < 100 or len(links) == sum(len(x) - 1 for x in groups(rows)) < len(rows) / 5
