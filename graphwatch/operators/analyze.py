"""Window analysis: windows -> spectra -> baseline -> signals -> status; calibration; summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwatch.operators import baseline as bl
from graphwatch.operators.graph import adjacency
from graphwatch.operators.signals import DEFAULT_DELTA, DETECTORS, vote
from graphwatch.operators.spectrum import spectrum
from graphwatch.operators.windows import count_windows
from graphwatch.schema import (REASON_TINY, STATUS_ANOMALY, STATUS_BASELINE, STATUS_NORMAL)

WINDOW_KEY = ["source_id", "window_no"]

# Fixed values of the batch job.
DEFAULT_WINDOW = 200
CALIBRATION_DELTAS = (0.10, 0.15, 0.20, 0.30)


def with_baseline(spec: DataFrame, warmup: int = bl.DEFAULT_WARMUP, adaptive: bool = False,
                  alpha: float = bl.DEFAULT_ALPHA, partitions: int | None = None) -> DataFrame:
    """Rank non-tiny windows and attach compared (``cmp_*``) and reported baselines."""
    ranked = bl.rank_windows(spec, partitions=partitions)
    return bl.apply_adaptive(ranked, alpha) if adaptive else bl.apply_fixed(ranked, warmup)


def classify(based: DataFrame, warmup: int = bl.DEFAULT_WARMUP,
             delta: float = DEFAULT_DELTA, detectors=None) -> DataFrame:
    """Signals, votes and status for windows carrying a baseline. ``detectors`` (else
    ``signals.DETECTORS``) names the signal columns and how each one is made."""
    tiny = F.col("n") < bl.TINY_NODES
    warm = F.col("r") < warmup
    detect = ~tiny & ~warm
    detectors = DETECTORS if detectors is None else detectors
    out = based.withColumns({name: F.when(detect, signal(delta)) for name, signal in detectors})
    votes, anomaly = vote([F.col(f"{name}.fired") for name, _ in detectors])
    return (out.withColumn("votes", F.when(detect, votes))
            .withColumn("status", F.when(tiny, STATUS_NORMAL).when(warm, STATUS_BASELINE)
                        .when(anomaly, STATUS_ANOMALY).otherwise(STATUS_NORMAL))
            .withColumn("reason", F.when(tiny, REASON_TINY))
            .withColumn("baseline_lambda2", F.when(detect, F.col("baseline_lambda2")))
            .withColumn("baseline_mult", F.when(detect, F.col("baseline_mult"))))


WINDOW_COLUMNS = ["source_id", "window_no", "n", "m", "lambda2", "mult", "eigenvalues", "status",
                  "reason", "baseline_lambda2", "baseline_mult", "fiedler", "mult_sig", "cluster",
                  "votes", "outliers", "sub_nodes", "components", "degenerate", "embed_dims"]


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (folder from ``spark.checkpoint.dir``).

    Used on the spectra table before it feeds several plan branches, so the
    grouped eigen step runs once and a lost executor does not recompute it.
    """
    from graphwatch.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def analyze_spectra(spec: DataFrame, warmup: int = bl.DEFAULT_WARMUP,
                    delta: float = DEFAULT_DELTA, adaptive: bool = False,
                    alpha: float = bl.DEFAULT_ALPHA, partitions: int | None = None) -> DataFrame:
    """Window table from per-window spectra (one row per window)."""
    spec = materialize(spec)
    based = with_baseline(spec, warmup, adaptive, alpha, partitions)
    return classify(based, warmup, delta).select(*WINDOW_COLUMNS)


def window_spectra(edges: DataFrame, window_size: int = DEFAULT_WINDOW,
                   partitions: int | None = None, max_local: int = 4000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(windowed edges, adjacency, spectra)`` for count windows of ``window_size`` edges."""
    windowed = count_windows(edges, window_size, partitions=partitions)
    adj = adjacency(windowed, colocate=True)
    spec = spectrum(adj, pairs_bound=window_size, max_local=max_local)
    return windowed, adj, spec


def analyze(edges: DataFrame, window_size: int = DEFAULT_WINDOW, warmup: int = bl.DEFAULT_WARMUP,
            delta: float = DEFAULT_DELTA, adaptive: bool = False, alpha: float = bl.DEFAULT_ALPHA,
            partitions: int | None = None) -> DataFrame:
    """All-window analysis of an edge table: one row per (source_id, window_no)."""
    _, _, spec = window_spectra(edges, window_size, partitions)
    return analyze_spectra(spec, warmup, delta, adaptive, alpha, partitions)


def calibrate(spec: DataFrame, deltas: Sequence[float] = CALIBRATION_DELTAS,
              warmup: int = bl.DEFAULT_WARMUP, key: str = "source_id") -> DataFrame:
    """Threshold sweep: per δ the anomaly count, window count and λ₂ range.

    The spectra and baseline are computed once and crossed with the δ list
    (a handful of literals, broadcast). As in the tool being mirrored, the
    λ₂ range filters on ``status != 'tiny graph'``, which no status equals,
    so tiny windows' 0.0 stays in the range. ``recommended`` is the smallest
    δ with no anomaly (null when every δ flags something).
    """
    based = with_baseline(materialize(spec), warmup)
    spark = spec.sparkSession
    dl = spark.createDataFrame([(float(d),) for d in deltas], "delta double")
    crossed = based.crossJoin(F.broadcast(dl))
    tiny = F.col("n") < bl.TINY_NODES
    warm = F.col("r") < warmup
    detect = ~tiny & ~warm
    # signal 1 fires when the relative drop exceeds δ: evaluated per δ row
    b = F.round(F.col("cmp_lambda2"), 12)
    c = F.round(F.col("lambda2"), 12)
    f_fired = F.when(b <= 1e-9, F.lit(False)).otherwise((b - c) / b > F.col("delta"))
    m_fired = F.col("mult") > F.col("cmp_mult")
    c_fired = F.coalesce(F.size("outliers"), F.lit(0)) > 0
    votes, anomaly = vote([f_fired, m_fired, c_fired])
    status = (F.when(tiny, STATUS_NORMAL).when(warm, STATUS_BASELINE)
              .when(anomaly, STATUS_ANOMALY).otherwise(STATUS_NORMAL))
    per = crossed.withColumn("status", status).withColumn("_detect", detect)
    sweep = (per.groupBy(key, "delta")
             .agg(F.count_if(F.col("status") == STATUS_ANOMALY).alias("anomalies"),
                  F.count(F.lit(1)).alias("windows"),
                  F.count_if(F.col("_detect") & f_fired).alias("fiedler_fired"),
                  F.count_if(F.col("_detect") & m_fired).alias("mult_fired"),
                  F.min(F.when(F.col("status") != REASON_TINY, F.col("lambda2"))).alias("lambda2_min"),
                  F.max(F.when(F.col("status") != REASON_TINY, F.col("lambda2"))).alias("lambda2_max")))
    zero = Window.partitionBy(key)
    return sweep.withColumn(
        "recommended", F.min(F.when(F.col("anomalies") == 0, F.col("delta"))).over(zero))


def run_summary(windows: DataFrame, key: str = "source_id") -> DataFrame:
    """Per stream: windows, anomalies, latest window's status/votes/λ₂/mult, and a note."""
    latest = F.max_by(F.struct("status", "votes", "lambda2", "mult"), F.col("window_no"))
    agg = windows.groupBy(key).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col("status") == STATUS_ANOMALY).alias("anomalies"),
        latest.alias("_latest"))
    is_anom = F.col("_latest.status") == STATUS_ANOMALY
    return agg.select(
        key, "windows", "anomalies",
        is_anom.alias("anomaly"),
        F.coalesce(F.col("_latest.votes"), F.lit(0)).alias("votes"),
        F.col("_latest.lambda2").alias("lambda2"),
        F.col("_latest.mult").alias("multiplicity"),
        summary_note(is_anom, F.col("anomalies")).alias("note"))


def summary_note(latest_anomalous: Column, anomalies: Column) -> Column:
    return (F.when(latest_anomalous, F.lit("latest window is anomalous"))
            .otherwise(F.format_string("latest window normal, %d anomalous in total", anomalies)))


def latest(windows: DataFrame, key: str = "source_id", status: str | None = None) -> DataFrame:
    """The latest window (optionally of one status) per stream, as a full row."""
    rows = windows if status is None else windows.filter(F.col("status") == status)
    cols = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.col("window_no")).alias("_r"))
    return picked.select(key, "_r.*")


def window_summary(windows: DataFrame) -> DataFrame:
    """API shape of a window row: window, n, m, λ₂ rounded to 4 places, status."""
    return windows.select("source_id", F.col("window_no").alias("window"), "n", "m",
                          F.round("lambda2", 4).alias("lambda2"), "status")


POSITION_BUCKET = 4096


def window_positions(windows: DataFrame, key: str = "source_id", flag: str | None = None) -> DataFrame:
    """Add ``pos`` (0-based position among the stream's windows by ``window_no``) and,
    when ``flag`` names a 0/1 column, ``flag_before`` (its sum over earlier windows).

    Two-level count over buckets of 4096 window numbers: a prefix sum over the
    bucket table plus a running count inside the bucket — no stream is sorted
    in one task.
    """
    f = F.col(flag).cast("long") if flag else F.lit(0).cast("long")
    w = (windows.withColumn("_b", F.floor(F.col("window_no") / POSITION_BUCKET).cast("long"))
         .withColumn("_f", f))
    per_b = w.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_c"), F.sum("_f").alias("_fs"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = per_b.select(key, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_co"),
                       F.coalesce(F.sum("_fs").over(before), F.lit(0)).alias("_fo"))
    inside = Window.partitionBy(key, "_b").orderBy("window_no").rowsBetween(Window.unboundedPreceding, -1)
    out = (w.join(off, [key, "_b"])
           .withColumn("pos", (F.col("_co") + F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0))).cast("long"))
           .withColumn("flag_before", (F.col("_fo") + F.coalesce(F.sum("_f").over(inside), F.lit(0))).cast("long")))
    return out.drop("_b", "_f", "_co", "_fo")


def running_anomalies(windows: DataFrame, key: str = "source_id") -> DataFrame:
    """Running count of anomalies in window order (feed counter)."""
    flagged = windows.withColumn("_a", (F.col("status") == STATUS_ANOMALY).cast("long"))
    return (window_positions(flagged, key, "_a")
            .withColumn("anomalies_so_far", F.col("flag_before") + F.col("_a"))
            .drop("_a", "pos", "flag_before"))


def snapshot_changes(windows: DataFrame, cols: Sequence[str] = ("status", "votes", "mult"),
                     key: str = "source_id") -> DataFrame:
    """Windows whose snapshot differs from the previous window's (emit-on-change feed).

    The previous window is found by an equi-join on position − 1.
    """
    pos = window_positions(windows, key).withColumn("_snap", F.struct(*[F.col(c) for c in cols]))
    prev = pos.select(key, (F.col("pos") + 1).alias("pos"), F.col("_snap").alias("_prev"))
    return (pos.join(prev, [key, "pos"], "left")
            .filter(~F.col("_snap").eqNullSafe(F.col("_prev")))
            .drop("_snap", "_prev", "pos", "flag_before"))
