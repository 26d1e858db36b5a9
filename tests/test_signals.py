"""Signals, vote, baseline, feedback — the reference's threshold facts on DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from graphwatch.operators.signals import (cluster_signal, embedding_outliers, fiedler_signal,
                                          multiplicity_signal, near_zero_count, vote)


def test_fiedler_signal(spark):
    df = spark.createDataFrame([(0.342, 0.087), (0.342, 0.339), (0.0, 0.1)], "b double, c double")
    got = [r.s.fired for r in df.select(fiedler_signal(F.col("b"), F.col("c")).alias("s")).collect()]
    assert got == [True, False, False]


def test_multiplicity_signal_and_count(spark):
    df = spark.createDataFrame([(1, 4), (1, 1)], "b int, c int")
    got = [r.s.fired for r in df.select(multiplicity_signal(F.col("b"), F.col("c")).alias("s")).collect()]
    assert got == [True, False]
    e = spark.createDataFrame([([0.0, 0.005, 0.5, 1.2],)], "e array<double>")
    assert e.select(near_zero_count(F.col("e")).alias("n")).first().n == 2


def test_vote(spark):
    df = spark.createDataFrame([(True, True, False), (True, False, False), (False, False, False)],
                               "a boolean, b boolean, c boolean")
    v, an = vote([F.col("a"), F.col("b"), F.col("c")])
    rows = df.select(v.alias("v"), an.alias("an")).collect()
    assert [(r.v, r.an) for r in rows] == [(2, True), (1, False), (0, False)]


def test_cluster_signal_score(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "o array<string>")
    rows = df.select(cluster_signal(F.col("o")).alias("s")).collect()
    assert rows[0].s.fired and abs(rows[0].s.score - 0.25) < 1e-12 and not rows[1].s.fired


def test_embedding_outliers_far_point_and_tight_cluster(spark):
    pts = [(i, [float(i % 3), float(i // 3)]) for i in range(8)] + [(8, [50.0, 50.0])]
    far = spark.createDataFrame([(0, i, v) for i, v in pts], "g int, id int, v array<double>")
    got = {r.id for r in embedding_outliers(far, ["g"], "v", "id").collect()}
    # population std: with 9 points one point can reach z = sqrt(8) < 3 -> no outlier
    assert got == set()
    rng = np.random.default_rng(0)
    big = [(1, i, list(map(float, rng.normal(0, 0.01, 8)))) for i in range(20)]
    big += [(2, i, [float(i % 5), 0.0]) for i in range(40)] + [(2, 99, [400.0, 0.0])]
    df = spark.createDataFrame(big, "g int, id int, v array<double>")
    got = {(r.g, r.id) for r in embedding_outliers(df, ["g"], "v", "id").collect()}
    assert got == {(2, 99)}


def test_adaptive_ema_matches_sequential_across_chunks(spark):
    from graphwatch.operators.baseline import ema_columns

    rng = np.random.default_rng(3)
    xs = rng.uniform(0, 1, 300).tolist()
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "source_id string, r long, x double")
    # chunks of 7 with alpha 0.9: weight older than two chunks is 0.1**14, so the
    # chunk-crossing logic is checked at double precision (the default chunk size
    # makes that weight e**-600 for any alpha)
    out = {r.r: (r.e_before, r.e_after) for r in ema_columns(df, "x", 0.9, chunk=7, prefixes="e").collect()}
    e = xs[0]
    for i, x in enumerate(xs):
        before = e
        e = 0.9 * x + 0.1 * e if i else x
        assert abs(out[i][0] - before) < 1e-9 and abs(out[i][1] - e) < 1e-9


def test_adaptive_ema_default_chunks(spark):
    from graphwatch.operators.baseline import ema_columns

    rng = np.random.default_rng(4)
    xs = rng.uniform(0, 1, 4000).tolist()          # spans two default chunks for alpha 0.3
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "source_id string, r long, x double")
    out = {r.r: r.e_after for r in ema_columns(df, "x", 0.3, prefixes="e").collect()}
    e = xs[0]
    for i, x in enumerate(xs):
        e = 0.3 * x + 0.7 * e if i else x
        assert abs(out[i] - e) < 1e-9


def test_feedback_alpha_matches_fold(spark):
    from graphwatch.operators.baseline import feedback_alpha

    rng = np.random.default_rng(7)
    labels = [rng.choice(["false_positive", "true_positive", "none"]) for _ in range(3000)]
    df = spark.createDataFrame([(i, str(l)) for i, l in enumerate(labels)], "o long, fb string")
    a = 0.3
    for l in labels:
        if l == "false_positive":
            a = min(0.7, a + 0.05)
        elif l == "true_positive":
            a = max(0.1, a - 0.05)
    got = feedback_alpha(df, "o", "fb").first()
    assert got.n_labels == 3000 and abs(got.alpha - a) < 1e-9
