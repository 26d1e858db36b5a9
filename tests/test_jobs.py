"""Posted-edge diagnosis: filtering of posted rows, minimum-size guard, quarter windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphwatch.jobs import diagnose, warmup_windows
from graphwatch.sources.tables import edges_from_rows, to_edges


def test_warmup_windows():
    assert warmup_windows(60.0, 5) == 12 and warmup_windows(3.0, 5) == 1


def test_edges_from_rows_filters_and_defaults(spark):
    df = spark.createDataFrame([(0, "a", "b", 2.0), (1, "", "b", 1.0), (2, "a", None, 1.0), (3, "c", "d", None)],
                               "o long, src string, dst string, weight double")
    rows = {r.seq: (r.src, r.dst, r.weight) for r in edges_from_rows(df, order=["o"]).collect()}
    assert rows == {0: ("a", "b", 2.0), 3: ("c", "d", 1.0)}


def test_diagnose_guard_and_windows(spark):
    big = [("big", i, f"c{i % 6}", f"s{i % 4}", 1.0) for i in range(40)]
    small = [("small", i, "a", "b", 1.0) for i in range(5)]
    df = spark.createDataFrame(big + small, "sid string, o long, src string, dst string, weight double")
    posted = to_edges(df, src=F.col("src"), dst=F.col("dst"), weight=F.col("weight"),
                      source_id=F.col("sid"), seq=F.col("o"))
    summary, anomalies, windows = diagnose(posted)
    s = {r.source_id: r for r in summary.collect()}
    assert s["small"].ok is False and "12" in s["small"].error
    assert s["big"].ok is True and s["big"].windows == 4
    sizes = sorted(r.m for r in windows.collect())
    assert sizes == [10, 10, 10, 10]


def test_replies_and_fallback_scripts_reach_the_event(spark):
    from graphwatch.jobs import diagnosed

    details = spark.createDataFrame(
        [("s", 1, ["h1", "h2"], ["x"], 2), ("s", 2, ["h3"], ["y"], 2)],
        "source_id string, window_no long, nodes array<string>, logs array<string>, votes int")
    replies = spark.createDataFrame(
        [("s", 1, '{"diagnosis": "d", "root_cause": "r", "confidence": {"total": 0.3}}')],
        "source_id string, window_no long, text string")
    said, rule = diagnosed(details, replies).orderBy("window_no").collect()
    assert (said.diagnosis.diagnosis, said.diagnosis.confidence.total) == ("d", 0.3)
    assert "-s h1" in said.diagnosis.mitigation.script and said.validation.valid
    assert rule.diagnosis.diagnosis.startswith("Rule-based") and "-s h3" in rule.diagnosis.mitigation.script
