"""Sinks: anomaly table, bundles, audit rows, report lines, feeds, mitigation lookup."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from graphwatch import sinks
from graphwatch.jobs import analyze_edges
from graphwatch.sources.lines import parse_access_log

TEMPLATE = '{ip} - - [05/Oct/2026:10:00:02 +0000] "GET {path} HTTP/1.1" 200 3437 "-" "curl/7.81"'


def _lines():
    benign = [TEMPLATE.format(ip=f"10.0.0.{1 + i % 8}", path=f"/s{i % 7}/x") for i in range(200 * 12 + 100)]
    beacon = [TEMPLATE.format(ip=f"10.0.0.{h}", path="/c2/beacon") for h in (14, 21, 22, 23, 24) for _ in range(20)]
    return benign + beacon


def test_batch_outputs(spark, tmp_dir):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(_lines())], "seq long, value string")
    res = analyze_edges(parse_access_log(df, source_id="t"), 200, 12)
    ev = res.anomalies.collect()
    assert len(ev) == 1 and ev[0].anomaly_id == "t-12" and ev[0].validated is True
    assert ev[0].dot.startswith("digraph") and len(ev[0].logs) == 30
    assert all("10.0.0." not in line for line in ev[0].diagnosis.diagnosis.split())  # nodes ok, logs redacted
    bundle = json.loads(sinks.stix_bundles(res.anomalies).first().bundle)
    ind = bundle["objects"][0]
    assert bundle["type"] == "bundle" and ind["type"] == "indicator" and ind["labels"] == ["anomaly"]
    assert ind["extensions"]["graphwatch"]["nodes"] == ev[0].nodes
    lines = [r.line for r in res.report.orderBy("window_no", "part").collect()]
    assert lines[0].startswith("# graphwatch") and "windows: 13" in lines and "anomalies: 1" in lines
    assert any(line.startswith("- window 12:") and "[ANOMALY]" in line for line in lines)
    assert "```dot" in lines
    summary = res.summary.first()
    assert summary.windows == 13 and summary.anomalies == 1 and summary.anomaly
    sinks.write_report(res.report, os.path.join(tmp_dir, "report"))
    parts = sorted(f for f in os.listdir(os.path.join(tmp_dir, "report")) if f.startswith("part-"))
    written = [ln.rstrip("\n") for f in parts for ln in open(os.path.join(tmp_dir, "report", f))]
    assert written == lines
    path = os.path.join(tmp_dir, "audit")
    sinks.write_audit(res.anomalies, path)
    days = [d for d in os.listdir(path) if d.startswith("day=")]
    assert len(days) == 1
    feed = sinks.anomaly_feed(res.anomalies.unionByName(res.anomalies)).collect()
    assert len(feed) == 1 and json.loads(feed[0].payload)["anomaly_id"] == "t-12"
    store = sinks.mitigation_store(res.anomalies)
    ids = spark.createDataFrame([("t-12",), ("t-99",)], "anomaly_id string")
    got = {r.anomaly_id: r.found for r in sinks.lookup_mitigation(store, ids).collect()}
    assert got == {"t-12": True, "t-99": False}
    wf = sinks.window_feed(res.windows).filter(F.col("window") == 12).first()
    assert wf.status == "ANOMALY" and wf.live is False
