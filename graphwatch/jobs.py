"""End-to-end jobs: batch analysis, calibration, export, diagnosis of posted edges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwatch import sinks
from graphwatch.functions.diagnosis import diagnose as rule_diagnose
from graphwatch.functions.diagnosis import parse_response
from graphwatch.functions.mitigation import fallback_mitigation, validate_mitigations
from graphwatch.operators.analyze import (analyze_spectra, calibrate, latest, run_summary,
                                          window_spectra, window_summary)
from graphwatch.operators.graph import adjacency
from graphwatch.operators.spectrum import spectrum
from graphwatch.operators.subgraph import anomaly_details
from graphwatch.operators.windows import quarter_windows
from graphwatch.schema import STATUS_ANOMALY
from graphwatch.sources.registry import load_edges

# Fixed values of the jobs.
DEFAULT_WINDOW_SECONDS = 5
DEFAULT_BASELINE_SECONDS = 60.0
POSTED_MIN_EDGES = 12
POSTED_WARMUP = 3


def warmup_windows(baseline_seconds: float = DEFAULT_BASELINE_SECONDS,
                   window_seconds: int = DEFAULT_WINDOW_SECONDS) -> int:
    """Warm-up length in windows: ``max(1, int(baseline / window))``."""
    return max(1, int(baseline_seconds / max(1, window_seconds)))


@dataclass
class BatchResult:
    windows: DataFrame
    anomalies: DataFrame
    report: DataFrame
    summary: DataFrame


def diagnosed(details: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Anomaly details with a diagnosis and the verdict on the script that it carries.

    ``responses`` (source_id, window_no, text) are model replies: where a window has
    one, its diagnosis comes from there, else from the rule. A diagnosis without a
    script gets the rendered one for the first node."""
    details = rule_diagnose(details)
    if responses is not None:
        reply = responses.select("source_id", "window_no", parse_response(F.col("text")).alias("_reply"))
        details = details.join(reply, ["source_id", "window_no"], "left")
        diagnosis = F.col("diagnosis")
        for field, part in (("diagnosis", "diagnosis"), ("root_cause", "root_cause"),
                            ("confidence.spectral", "spectral"), ("confidence.log", "log"),
                            ("confidence.total", "total"), ("mitigation.type", "kind"),
                            ("mitigation.script", "script"), ("mitigation.explanation", "explanation")):
            diagnosis = diagnosis.withField(field, F.when(F.col("_reply").isNotNull(), F.col(f"_reply.{part}"))
                                            .otherwise(F.col(f"diagnosis.{field}")))
        details = details.withColumn("diagnosis", diagnosis).drop("_reply")
    script = fallback_mitigation(F.col("diagnosis.mitigation.type"), F.col("diagnosis.mitigation.script"),
                                 F.col("nodes"))
    details = details.withColumn("diagnosis", F.col("diagnosis")
                                 .withField("mitigation.type", script["type"])
                                 .withField("mitigation.script", script["script"]))
    return validate_mitigations(details, "diagnosis.mitigation.type", "diagnosis.mitigation.script")


def analyze_edges(edges: DataFrame, window_size: int = 200, warmup: int = 12, delta: float = 0.2,
                  adaptive: bool = False, alpha: float = 0.3, mitigate: bool = True,
                  feedback: str = "", responses: DataFrame | None = None) -> BatchResult:
    """Windows -> spectra -> status; anomaly details, diagnosis, validated mitigation."""
    windowed, adj, spec = window_spectra(edges, window_size)
    windows = analyze_spectra(spec, warmup, delta, adaptive, alpha)
    details = anomaly_details(windows, adj, windowed)
    if mitigate:
        details = diagnosed(details, responses)
    events = sinks.anomaly_events(details, feedback)
    report = sinks.run_report(windows, details)
    return BatchResult(windows, events, report, run_summary(windows))


def run_batch(spark: SparkSession, specs: Sequence[str], out: str | None = None,
              fmt: str | None = None, start: str | None = None, end: str | None = None,
              window_size: int = 200, baseline_seconds: float = DEFAULT_BASELINE_SECONDS,
              window_seconds: int = DEFAULT_WINDOW_SECONDS, adaptive: bool = False,
              mitigate: bool = True, dry_run: bool = False, feedback: str = "") -> BatchResult:
    """Load sources, analyze, and (unless ``dry_run``) write anomalies, audit and report."""
    edges = load_edges(spark, specs, fmt, start, end)
    res = analyze_edges(edges, window_size, warmup_windows(baseline_seconds, window_seconds),
                        adaptive=adaptive, mitigate=mitigate, feedback=feedback)
    if out and not dry_run:
        res.windows.write.mode("overwrite").parquet(f"{out}/windows")
        res.anomalies.write.mode("overwrite").parquet(f"{out}/anomalies")
        sinks.write_audit(res.anomalies, f"{out}/audit")
        sinks.write_report(res.report, f"{out}/report")
    return res


def run_calibrate(spark: SparkSession, specs: Sequence[str], window_size: int = 200,
                  baseline_seconds: float = DEFAULT_BASELINE_SECONDS,
                  window_seconds: int = DEFAULT_WINDOW_SECONDS) -> DataFrame:
    """Threshold sweep over the sources (spectra computed once)."""
    edges = load_edges(spark, specs)
    _, _, spec = window_spectra(edges, window_size)
    return calibrate(spec, warmup=warmup_windows(baseline_seconds, window_seconds))


def run_export(spark: SparkSession, specs: Sequence[str], out: str | None = None,
               window_size: int = 200) -> DataFrame:
    """Threat-intel bundle of the latest anomaly per stream."""
    res = analyze_edges(load_edges(spark, specs), window_size, mitigate=False)
    bundles = sinks.stix_bundles(res.anomalies, latest_only=True)
    if out:
        bundles.select("bundle").write.mode("overwrite").text(out)
    return bundles


def diagnose(edges: DataFrame, min_edges: int = POSTED_MIN_EDGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Diagnosis of posted edges: ``(summary, anomalies, windows)``.

    Windows are a quarter of each stream (``max(3, n // 4)`` edges), warm-up
    3. Streams with fewer than ``min_edges`` edges get an error row in the
    summary instead of an analysis.
    """
    counts = edges.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"))
    ok = counts.filter(F.col("_n") >= min_edges).select("source_id")
    usable = edges.join(ok, "source_id", "left_semi")
    windowed = quarter_windows(usable)
    adj = adjacency(windowed)
    spec = spectrum(adj)
    windows = analyze_spectra(spec, warmup=POSTED_WARMUP)
    details = diagnosed(anomaly_details(windows, adj, windowed))
    events = sinks.anomaly_events(details)
    errors = counts.filter(F.col("_n") < min_edges).select(
        "source_id", F.lit(False).alias("ok"),
        F.lit(f"at least {min_edges} edges with src and dst are needed").alias("error"))
    summary = run_summary(windows).withColumn("ok", F.lit(True)).withColumn(
        "error", F.lit(None).cast("string"))
    return summary.unionByName(errors, allowMissingColumns=True), events, window_summary(windows)


def latest_snapshot(windows: DataFrame) -> DataFrame:
    """Detection snapshot per stream (latest window's status plus run counts)."""
    return run_summary(windows)


def latest_anomaly(windows: DataFrame) -> DataFrame:
    return latest(windows, status=STATUS_ANOMALY)
