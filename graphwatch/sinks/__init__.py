"""Outputs: anomaly table, audit log, threat-intel bundles, run report, feeds.

Each builder returns a DataFrame (so it can be inspected or tested), and a
``write_*`` helper persists it with the DataFrame writer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwatch.schema import STATUS_ANOMALY

# Fixed values of the bundle format (own identifiers).
BUNDLE_PREFIX = "bundle--graphwatch-"
INDICATOR_PREFIX = "indicator--graphwatch-"
INDICATOR_NAME = "Graph window with a spectral outlier"
INDICATOR_PATTERN = "[x-graphwatch:anomaly = 'spectral']"


def anomaly_events(details: DataFrame, feedback: str = "") -> DataFrame:
    """One row per anomaly: nodes, signals, diagnosis, mitigation, DOT, feedback.

    ``details`` is ``anomaly_details`` output, optionally with ``diagnosis``
    (from ``functions.diagnosis.diagnose``) and ``validation`` columns.
    """
    cols = set(details.columns)
    diag = F.col("diagnosis") if "diagnosis" in cols else F.lit(None)
    return details.select(
        F.concat_ws("-", "source_id", F.col("window_no").cast("string")).alias("anomaly_id"),
        "source_id", "window_no",
        F.col("nodes"), F.col("edges"),
        F.struct(F.col("lambda2"), F.col("mult").alias("multiplicity"), F.col("votes")).alias("signals"),
        diag.alias("diagnosis"),
        (F.col("diagnosis.mitigation") if "diagnosis" in cols else F.lit(None)).alias("mitigation"),
        (F.col("validation.valid") if "validation" in cols else F.lit(None).cast("boolean")).alias("validated"),
        F.col("dot"), F.col("logs"), F.lit("").alias("png_path"), F.lit(feedback).alias("feedback"),
        F.lit(True).alias("is_anomaly"))


def audit_rows(events: DataFrame, kind: str = "anomaly") -> DataFrame:
    """Audit records ``{ts, type, ...event}`` with a UTC ``day`` partition column."""
    now = F.current_timestamp()
    return events.select(now.alias("ts"), F.lit(kind).alias("type"), "*",
                         F.date_format(now, "yyyy-MM-dd").alias("day"))


def write_audit(events: DataFrame, path: str, kind: str = "anomaly") -> None:
    """Append NDJSON audit records, one folder per UTC day."""
    audit_rows(events, kind).write.mode("append").partitionBy("day").json(path)


def stix_bundles(events: DataFrame, latest_only: bool = False) -> DataFrame:
    """One threat-intel bundle (JSON text) per anomaly, or only the latest per stream."""
    ev = events
    if latest_only:   # partial aggregate: no stream's anomalies are sorted in one task
        cols = [c for c in events.columns if c != "source_id"]
        ev = (events.groupBy("source_id").agg(F.max_by(F.struct(*cols), F.col("window_no")).alias("_r"))
              .select("source_id", "_r.*"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    ext = F.struct(F.col("nodes"), F.col("signals"), F.col("diagnosis"), F.col("mitigation"),
                   F.col("dot"), F.col("png_path"), F.col("feedback"))
    indicator = F.struct(
        F.lit("indicator").alias("type"),
        F.concat(F.lit(INDICATOR_PREFIX), F.col("anomaly_id")).alias("id"),
        now.alias("created"), now.alias("modified"),
        F.lit(INDICATOR_NAME).alias("name"), F.lit(INDICATOR_PATTERN).alias("pattern"),
        now.alias("valid_from"), F.array(F.lit("anomaly")).alias("labels"),
        F.struct(ext.alias("graphwatch")).alias("extensions"))
    bundle = F.struct(F.lit("bundle").alias("type"),
                      F.concat(F.lit(BUNDLE_PREFIX), F.col("anomaly_id")).alias("id"),
                      F.array(indicator).alias("objects"))
    # fields without a value are written as null, not left out
    return ev.select("anomaly_id", "source_id", "window_no",
                     F.to_json(bundle, {"ignoreNullFields": "false"}).alias("bundle"))


def run_report(windows: DataFrame, details: DataFrame | None = None, mode: str = "batch",
               source: str = "") -> DataFrame:
    """Report lines ``(source_id, window_no, part, line)`` in reading order
    ``(window_no, part)``: header counts (window_no -1), one line per window, and
    the DOT text after each anomalous window. The order key is carried instead of
    a global line number, so no stream is numbered in one task; ``write_report``
    writes the lines range-partitioned in that order."""
    head = windows.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("_w"), F.count_if(F.col("status") == STATUS_ANOMALY).alias("_a"))
    header = head.select("source_id", F.posexplode(F.array(
        F.lit(f"# graphwatch {mode} report"),
        F.concat(F.lit("source: "), F.lit(source) if source else F.col("source_id")),
        F.format_string("windows: %d", F.col("_w")), F.format_string("anomalies: %d", F.col("_a")),
        F.lit(""))).alias("_k", "line")).select("source_id", F.lit(-1).cast("long").alias("window_no"),
                                                "_k", "line")
    per = windows.select("source_id", "window_no", F.lit(0).alias("_k"), F.format_string(
        "- window %d: nodes=%d edges=%d lambda2=%.3f [%s]", F.col("window_no"), F.col("n"),
        F.col("m"), F.col("lambda2"), F.col("status")).alias("line"))
    parts = header.unionByName(per)
    if details is not None:
        dot = details.select("source_id", "window_no", F.posexplode(F.concat(
            F.array(F.lit(""), F.lit("```dot")), F.split(F.rtrim(F.col("dot")), "\n"),
            F.array(F.lit("```"), F.lit("")))).alias("_p", "line")).select(
            "source_id", "window_no", (F.col("_p") + 1).alias("_k"), "line")
        parts = parts.unionByName(dot)
    return parts.select("source_id", "window_no", F.col("_k").alias("part"), "line")


def write_report(report: DataFrame, path: str) -> None:
    """Report text files whose names follow the reading order (range partitions)."""
    (report.repartitionByRange("source_id", "window_no", "part")
     .sortWithinPartitions("source_id", "window_no", "part")
     .select("line").write.mode("overwrite").text(path))


def window_feed(windows: DataFrame, live: bool = False) -> DataFrame:
    """Per-window feed events: window, n, m, λ₂ (6 places), mult, votes, status, live flag."""
    return windows.select(
        "source_id", F.col("window_no").alias("window"), "n", "m",
        F.round("lambda2", 6).alias("lambda2"), "mult", F.coalesce("votes", F.lit(0)).alias("votes"),
        "status", F.lit(live).alias("live"))


def anomaly_payload() -> Column:
    """An anomaly event as the feed's JSON."""
    return F.to_json(F.struct("anomaly_id", "window_no", "nodes", "signals", "diagnosis", "mitigation", "validated"))


def anomaly_feed(events: DataFrame) -> DataFrame:
    """Each anomaly once, as a JSON payload."""
    return events.dropDuplicates(["anomaly_id"]).select("anomaly_id", anomaly_payload().alias("payload"))


def mitigation_store(events: DataFrame) -> DataFrame:
    """Mitigations keyed by anomaly id (type, script, explanation, validated, nodes, dot, diagnosis)."""
    return events.select(
        "anomaly_id", F.col("mitigation.type").alias("type"), F.col("mitigation.script").alias("script"),
        F.col("mitigation.explanation").alias("explanation"), "validated", "nodes", "dot", "diagnosis")


def lookup_mitigation(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested ids left-joined to the store; ``found`` false for unknown ids."""
    return (ids.join(store, "anomaly_id", "left")
            .withColumn("found", F.col("type").isNotNull()))
