"""Spectral core: analytic spectra, agreement with dense numpy, invariance, distributed path."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from graphwatch.operators.spectrum import graph_spectrum, summarize_pairs


def _dense(n, edges):
    W = np.zeros((n, n))
    for a, b, w in edges:
        W[a, b] += w / 2
        W[b, a] += w / 2
    return W


def _full_laplacian_eigs(W):
    W = W.copy()
    np.fill_diagonal(W, 0)
    d = W.sum(1)
    inv = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    L = np.diag((d > 0).astype(float)) - W * inv[:, None] * inv[None, :]
    return np.sort(np.linalg.eigvalsh(L))


def test_path_graph_has_zero_first():
    s = graph_spectrum(["a", "b", "c"], _dense(3, [(0, 1, 1), (1, 2, 1)]))
    assert abs(s["eigenvalues"][0]) < 1e-9 and s["mult"] == 1


def test_two_disjoint_edges_second_zero():
    s = graph_spectrum(list("abcd"), _dense(4, [(0, 1, 1), (2, 3, 1)]))
    assert abs(s["lambda2"]) < 1e-9 and s["mult"] == 2 and s["components"] == 2


@pytest.mark.parametrize("n", [4, 7, 12])
def test_complete_graph(n):
    W = np.ones((n, n)) - np.eye(n)
    s = graph_spectrum([f"n{i:02d}" for i in range(n)], W)
    assert abs(s["lambda2"] - n / (n - 1)) < 1e-9


@pytest.mark.parametrize("n", [5, 9])
def test_star_and_cycle(n):
    star = _dense(n, [(0, i, 1) for i in range(1, n)])
    assert abs(graph_spectrum([f"n{i}" for i in range(n)], star)["lambda2"] - 1.0) < 1e-9
    cyc = _dense(n, [(i, (i + 1) % n, 1) for i in range(n)])
    assert abs(graph_spectrum([f"n{i}" for i in range(n)], cyc)["lambda2"]
               - (1 - math.cos(2 * math.pi / n))) < 1e-9


def test_agrees_with_dense_numpy_and_counts_zeros():
    rng = random.Random(5)
    for _ in range(20):
        n = rng.randint(5, 40)
        edges = [(rng.randrange(n), rng.randrange(n), rng.choice([1.0, 2.5])) for _ in range(rng.randint(3, 60))]
        W = _dense(n, edges)
        s = graph_spectrum([f"v{i:03d}" for i in range(n)], W)
        ref = np.clip(_full_laplacian_eigs(W)[: len(s["eigenvalues"])], 0, 2)
        assert np.allclose(s["eigenvalues"], ref, atol=1e-9)
        assert s["mult"] == int(np.sum(ref < 0.01))


def test_self_loop_only_node_adds_a_zero():
    s = graph_spectrum(list("abcd"), _dense(4, [(0, 1, 1), (1, 2, 1), (3, 3, 4)]))
    assert s["components"] == 2 and s["mult"] == 2


def test_outlier_and_ranking_invariant_to_row_order():
    rng = random.Random(1)
    src = [f"c{rng.randrange(12)}" for _ in range(150)] + ["h1", "h2", "h3"] * 10
    dst = [f"s{rng.randrange(5)}" for _ in range(150)] + ["c2"] * 30
    w = [1.0] * len(src)
    base = summarize_pairs(np.array(src, object), np.array(dst, object), np.array(w))
    for seed in range(5):
        idx = list(range(len(src)))
        random.Random(seed).shuffle(idx)
        s = summarize_pairs(np.array(src, object)[idx], np.array(dst, object)[idx], np.array(w)[idx])
        assert s["outliers"] == base["outliers"] and s["sub_nodes"] == base["sub_nodes"]
        assert np.allclose(s["eigenvalues"], base["eigenvalues"])


def test_subgraph_cap_and_outlier_first():
    # complete graph of 12 nodes: every node ties, cap at 8, ids break ties
    W = np.ones((12, 12)) - np.eye(12)
    s = graph_spectrum([f"n{i:02d}" for i in range(12)], W)
    assert len(s["sub_nodes"]) == 8


def test_tiny_graph_summary():
    s = summarize_pairs(np.array(["a"], object), np.array(["b"], object), np.array([1.0]))
    assert s["n"] == 2 and s["lambda2"] == 0.0 and s["mult"] == 1


def test_distributed_path_equals_local(spark):
    from graphwatch.operators.distributed_spectrum import large_window_spectrum
    from graphwatch.operators.graph import adjacency
    from graphwatch.operators.spectrum import spectrum
    from graphwatch.plans.scenarios import event_windows
    adj = adjacency(event_windows(spark, "/root/testdata/sf0.001", 50, "unit", True))
    a = {r.window_no: r for r in spectrum(adj, pairs_bound=50).collect()}
    b = {r.window_no: r for r in large_window_spectrum(adj).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].outliers == b[k].outliers and a[k].sub_nodes == b[k].sub_nodes
        assert np.allclose(a[k].eigenvalues, b[k].eigenvalues, atol=1e-9)
        assert a[k].mult == b[k].mult and a[k].components == b[k].components


def _forced(spark, **options):
    from pyspark.sql import functions as F

    from graphwatch.operators.distributed_spectrum import large_window_spectrum
    from graphwatch.operators.graph import adjacency
    from graphwatch.operators.spectrum import spectrum
    from graphwatch.plans.scenarios import event_windows

    win = event_windows(spark, "/root/testdata/sf0.01", 200, "unit", True).filter(F.col("window_no").isin(13, 15))
    adj = adjacency(win)
    a = {r.window_no: r for r in spectrum(adj, pairs_bound=200).collect()}
    b = {r.window_no: r for r in large_window_spectrum(adj, **options).collect()}
    for k in a:
        assert np.allclose(a[k].eigenvalues, b[k].eigenvalues, atol=1e-8)
        assert a[k].outliers == b[k].outliers and a[k].sub_nodes == b[k].sub_nodes


def test_lanczos_in_a_task_equals_dense(spark):
    _forced(spark, max_component_nodes=1)


def _laplacian_values(n, i, j, w):
    A = np.zeros((n, n))
    np.add.at(A, (i, j), w)
    W = (A + A.T) / 2
    np.fill_diagonal(W, 0)
    d = W.sum(axis=1)
    return np.linalg.eigvalsh(np.eye(n) - W / np.sqrt(np.outer(d, d)))


def test_smallest_pairs_of_a_random_graph():
    from graphwatch.operators.krylov import smallest_pairs

    rng = np.random.default_rng(2)
    n = 300
    i = np.concatenate([np.arange(n), rng.integers(0, n, 500), [7]])
    j = np.concatenate([(np.arange(n) + 1) % n, rng.integers(0, n, 500), [7]])
    w = rng.random(len(i)) + 0.1
    degree, values, vectors = smallest_pairs(i, j, w, n, 9)
    assert np.allclose(values, _laplacian_values(n, i, j, w)[1:10], atol=1e-10)
    assert np.allclose(vectors.T @ vectors, np.eye(9), atol=1e-9)
    for n in (2, 3, 6):                              # fewer pairs than asked for
        i, j = np.arange(n - 1), np.arange(1, n)
        _, values, _ = smallest_pairs(i, j, np.ones(n - 1), n, 9)
        assert np.allclose(values, _laplacian_values(n, i, j, np.ones(n - 1))[1:], atol=1e-10)


def test_star_and_ring_of_seven_thousand_nodes():
    """λ = 1 some 7,000 times; and pairs of equal values that crowd at zero."""
    from graphwatch.operators.krylov import smallest_pairs

    n = 7000
    _, values, vectors = smallest_pairs(np.zeros(n - 1, int), np.arange(1, n), np.ones(n - 1), n, 9)
    assert np.allclose(values, 1, atol=1e-10) and np.allclose(vectors.T @ vectors, np.eye(9), atol=1e-9)
    at = np.arange(n)
    _, values, _ = smallest_pairs(at, (at + 1) % n, np.ones(n), n, 2)
    assert np.allclose(values, np.sort(1 - np.cos(2 * np.pi * np.arange(1, n) / n))[:2], rtol=1e-6)


def test_pairs_that_do_not_settle_raise(monkeypatch):
    from graphwatch.operators import krylov

    monkeypatch.setattr(krylov, "PRODUCTS", 16)
    at = np.arange(400)
    with pytest.raises(RuntimeError, match="not settled"):
        krylov.smallest_pairs(at, (at + 1) % 400, np.ones(400), 400, 9)


def test_time_windows_mixed_routing_equals_local(spark):
    from graphwatch.operators.graph import adjacency
    from graphwatch.operators.spectrum import spectrum
    from graphwatch.operators.windows import time_windows
    from graphwatch.plans.scenarios import event_edges

    adj = adjacency(time_windows(event_edges(spark, "/root/testdata/sf0.001", "unit"), seconds=86400))
    local = {r.window_no: r for r in spectrum(adj, max_local=100000).collect()}
    mixed = {r.window_no: r for r in spectrum(adj, max_local=20).collect()}
    assert local.keys() == mixed.keys() and any(r.pairs > 20 for r in local.values())
    for k in local:
        a, b = local[k], mixed[k]
        assert (a.n, a.m, a.mult, a.components, a.outliers, a.sub_nodes) == \
               (b.n, b.m, b.mult, b.components, b.outliers, b.sub_nodes)
        assert np.allclose(a.eigenvalues, b.eigenvalues, atol=1e-9)


def test_fiedler_entries_path_and_repeated():
    from graphwatch.operators.spectrum import fiedler_entries

    # path a-b-c-d-e: the Fiedler vector splits the ends, sign fixed positive at the max
    W = _dense(5, [(i, i + 1, 1) for i in range(4)])
    v = fiedler_entries(list("abcde"), W)
    # antisymmetric vector: |v| ties at both ends, the first node by id is made positive
    assert v is not None and v[0] > 0 and abs(v[0] + v[4]) < 1e-9
    # star: lambda2 = 1 is repeated -> no unique vector
    assert fiedler_entries([f"n{i}" for i in range(6)], _dense(6, [(0, i, 1) for i in range(1, 6)])) is None


def _one_component(spark, pairs):
    rows = [("s", 0, "c", f"n{a:02d}", f"n{b:02d}", 1.0) for a, b in pairs]
    return spark.createDataFrame(rows, "source_id string, window_no long, component string, src string, dst string, weight double")


def test_distributed_decomposition_equals_dense(spark):
    from graphwatch.operators.krylov import smallest_pairs_distributed

    rng = np.random.default_rng(3)
    n = 90
    pairs = sorted({(min(a, b), max(a, b)) for a, b in [*((k, (k + 1) % n) for k in range(n)), *rng.integers(0, n, (120, 2)).tolist()]
                    if a != b})
    rows = smallest_pairs_distributed(_one_component(spark, pairs), 5).collect()
    i, j = np.array(pairs).T
    expected = _laplacian_values(n, i, j, np.ones(len(pairs)))[1:6]
    assert len(rows) == n and all(np.allclose(r.vals, expected, atol=1e-8) for r in rows)
    vectors = np.array([r.vec for r in rows])
    assert np.allclose(vectors.T @ vectors, np.eye(5), atol=1e-6)
    degree = np.bincount(np.concatenate([i, j]), minlength=n) / 2
    assert {r.node: r.degree for r in rows} == {f"n{k:02d}": degree[k] for k in range(n)}


def test_large_star_does_not_rank_within_a_cut_eigenspace(spark):
    from graphwatch.operators.distributed_spectrum import large_window_spectrum

    star = _one_component(spark, [(0, i) for i in range(1, 40)]).drop("component")
    (r,) = large_window_spectrum(star, max_component_nodes=1).collect()
    assert all(abs(v - 1) < 1e-9 for v in r.eigenvalues[1:]) and r.degenerate
    assert r.sub_nodes == [f"n{k:02d}" for k in range(8)]


def test_pairs_of_unknown_windows_are_computed_once(spark):
    """The split into small and large windows reads written pairs, whose size Spark knows."""
    from graphwatch.operators.spectrum import spectrum

    seen = spark.sparkContext.accumulator(0)
    rows = [("s", w, f"a{w}{k}", f"b{k % 3}", 1.0) for w in range(4) for k in range(10 * (w + 1))]

    def count(r):
        seen.add(1)
        return r

    adj = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(count),
                                "source_id string, window_no long, src string, dst string, weight double")
    got = {r.window_no: (r.n, r.pairs) for r in spectrum(adj, max_local=20).collect()}
    assert got == {w: (10 * (w + 1) + 3, 10 * (w + 1)) for w in range(4)}
    assert seen.value == len(rows)


def test_window_whose_zeros_fill_its_values_is_not_solved(spark, monkeypatch):
    """As many components as values are kept, or more: the summary holds no other pair."""
    from graphwatch.operators import distributed_spectrum as ds
    from graphwatch.operators.spectrum import spectrum

    def unexpected(*_):
        raise AssertionError("solved")

    monkeypatch.setattr(ds, "smallest_pairs_distributed", unexpected)
    rows = [("s", w, f"n{c}{a}", f"n{c}{b}", 1.0 + c + a) for w, z in ((0, 8), (1, 12)) for c in range(z)
            for a, b in ((0, 1), (1, 2), (2, 0), (2, 2))]
    adj = spark.createDataFrame(rows, "source_id string, window_no long, src string, dst string, weight double")
    local = {r.window_no: r for r in spectrum(adj, pairs_bound=200).collect()}
    large = {r.window_no: r for r in ds.large_window_spectrum(adj, max_task_pairs=1).collect()}
    assert local.keys() == large.keys()
    for k in local:
        assert local[k] == large[k]
    with pytest.raises(AssertionError, match="solved"):
        ds.large_window_spectrum(adj.filter("window_no = 0 and src < 'n7'"), max_task_pairs=1)
