"""The three spectral signals, the vote, and centroid-distance outliers on any table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the detection rules.
DEFAULT_DELTA = 0.20      # relative λ₂ drop that fires signal 1
NO_BASELINE_EPS = 1e-9    # a baseline λ₂ at or below this never fires
MIN_VOTES = 2             # signals needed for an anomaly
OUTLIER_SCORE_DIV = 8.0   # signal 3 score = min(1, outliers / 8)
COMPARE_DECIMALS = 12     # λ₂ values are compared after rounding (summation-order noise)


def _signal(fired: Column, score: Column, detail: Column, nodes: Column | None = None) -> Column:
    return F.struct(fired.alias("fired"), score.cast("double").alias("score"),
                    detail.alias("detail"),
                    (nodes if nodes is not None else F.lit(None).cast("array<string>")).alias("nodes"))


def fiedler_signal(baseline: Column, current: Column, delta: float = DEFAULT_DELTA) -> Column:
    """Signal 1: relative drop of λ₂ below the baseline exceeds ``delta``."""
    b = F.round(baseline, COMPARE_DECIMALS)
    c = F.round(current, COMPARE_DECIMALS)
    drop = (b - c) / b
    no_base = b <= NO_BASELINE_EPS
    return F.when(no_base, _signal(F.lit(False), F.lit(0.0), F.lit("no baseline"))).otherwise(
        _signal(drop > F.lit(delta), F.least(F.lit(1.0), F.greatest(F.lit(0.0), drop)),
                F.format_string("lambda2 %.3f -> %.3f", baseline, current)))


def multiplicity_signal(baseline: Column, current: Column) -> Column:
    """Signal 2: more near-zero eigenvalues than the baseline."""
    fired = current > baseline
    return _signal(fired, F.when(fired, 1.0).otherwise(0.0),
                   F.format_string("zero multiplicity %d -> %d", baseline, current))


def cluster_signal(outliers: Column) -> Column:
    """Signal 3: any node far from the spectral-embedding centroid."""
    cnt = F.coalesce(F.size(outliers), F.lit(0))
    return _signal(cnt > 0, F.least(F.lit(1.0), cnt / F.lit(OUTLIER_SCORE_DIV)),
                   F.format_string("%d outlying nodes", cnt), outliers)


def near_zero_count(eigenvalues: Column, eps: float = 0.01) -> Column:
    """How many eigenvalues are below ``eps``."""
    return F.size(F.filter(eigenvalues, lambda x: x < F.lit(eps)))


def vote(signals: Sequence[Column], min_votes: int = MIN_VOTES) -> tuple[Column, Column]:
    """``(votes, anomaly)`` from fired-booleans: anomaly when at least ``min_votes`` fire."""
    votes = sum((F.coalesce(s, F.lit(False)).cast("int") for s in signals), F.lit(0))
    return votes.cast("int"), votes >= F.lit(min_votes)


# The detectors that vote: (column of the window table, signal made from the row's
# columns and the λ₂ threshold). More can be appended here or passed to ``classify``.
DETECTORS: list[tuple[str, Callable[[float], Column]]] = [
    ("fiedler", lambda delta: fiedler_signal(F.col("cmp_lambda2"), F.col("lambda2"), delta)),
    ("mult_sig", lambda delta: multiplicity_signal(F.col("cmp_mult"), F.col("mult"))),
    ("cluster", lambda delta: cluster_signal(F.col("outliers"))),
]


def embedding_outliers(df: DataFrame, group: Sequence[str], vector: str, ident: str,
                       sigma: float = 3.0, std_floor: float = 1e-3) -> DataFrame:
    """Rows whose vector lies farther than ``mean + sigma*std`` from their group's centroid.

    Distances are Euclidean; ``std`` is the population standard deviation
    floored at ``std_floor``. Two partial aggregations (mean per dimension, then
    distance statistics) whose results, one row per group, are joined to the
    rows; the distance is computed inside the row, so no vector is shuffled by
    dimension. Null and empty vectors are no outliers. Output: the input columns
    of the outlying rows plus ``distance``, ``mean_distance`` and ``threshold``.
    """
    g = list(group)
    means = (df.select(*g, F.posexplode(vector).alias("_d", "_v"))
             .groupBy(*g, "_d").agg(F.avg(F.col("_v").cast("double")).alias("_mu")))
    centroid = (means.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("_d", "_mu"))).alias("_c"))
                .select(*g, F.transform("_c", lambda s: s["_mu"]).alias("_c")))
    squares = F.zip_with(F.col(vector), F.col("_c"),
                         lambda v, mu: F.coalesce((v.cast("double") - mu) * (v.cast("double") - mu), F.lit(0.0)))
    dist = (df.filter(F.size(vector) > 0).join(centroid, g)
            .withColumn("distance", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)))
            .drop("_c"))
    stats = dist.groupBy(*g).agg(F.avg("distance").alias("mean_distance"),
                                 F.greatest(F.stddev_pop("distance"), F.lit(std_floor)).alias("_sd"))
    scored = (dist.join(stats, g)
              .withColumn("threshold", F.col("mean_distance") + F.lit(sigma) * F.col("_sd")))
    return scored.filter(F.col("distance") > F.col("threshold")).drop("_sd")
