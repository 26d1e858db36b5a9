"""The live path: places by ledger, analysis per batch, retries, drains and feeds."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from graphwatch import sinks
from graphwatch.jobs import analyze_edges
from graphwatch.operators.analyze import snapshot_changes
from graphwatch.sources.registry import load_edges
from graphwatch.streaming import live
from test_pipeline import beacon, benign


def _write(folder, name, lines, stamp):
    path = os.path.join(folder, name)
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")
    os.utime(path, (stamp, stamp))


def _folder(tmp_dir, lines, per_file):
    folder = os.path.join(tmp_dir, "in")
    os.makedirs(folder)
    for i in range(0, len(lines), per_file):
        _write(folder, f"part-{i:06d}.log", lines[i:i + per_file], 1_000_000 + i)
    return folder


def _attack():
    return benign(200 * 12) + benign(100) + beacon(100) + benign(300) + ["no log line"] * 3 + benign(100) + beacon(100) + benign(150)


def test_anomalies_snapshot_and_changes_equal_a_batch_job(spark, tmp_dir):
    folder, out = _folder(tmp_dir, _attack(), 350), os.path.join(tmp_dir, "out")
    live.run_stream(spark, folder, out, window_size=200, warmup=12, max_files_per_trigger=1).awaitTermination(600)
    res = analyze_edges(load_edges(spark, ["nginx:" + folder], source_id="live"), 200, 12)
    full = res.windows.filter(F.col("m") == 200)
    last = f"{out}/snapshot/batch={max(int(x[6:]) for x in os.listdir(os.path.join(out, 'snapshot')))}"

    def rows(df, cols):
        return sorted(str(r) for r in df.select(*cols).collect())

    cols = ["source_id", "window_no", "n", "m", "status", "votes", "mult", F.round("lambda2", 9)]
    assert rows(spark.read.parquet(f"{out}/windows"), cols) == rows(full, cols) and full.count() == 16
    cols = ["anomaly_id", "nodes", "edges", "logs", "dot", "diagnosis", "mitigation", "validated", "is_anomaly"]
    events = spark.read.parquet(f"{out}/anomalies")
    assert rows(events, cols) == rows(res.anomalies, cols) and events.count() >= 2
    audit = spark.read.json(f"{out}/audit")
    assert audit.count() == events.count() and {r.type for r in audit.collect()} == {"anomaly"}
    from graphwatch.operators.analyze import run_summary
    cols = ["source_id", "windows", "anomalies", "anomaly", "votes", "multiplicity", "note", F.round("lambda2", 9)]
    assert rows(spark.read.parquet(last), cols) == rows(run_summary(full), cols)
    cols = ["source_id", "window_no", "status", "votes", "mult"]
    assert rows(spark.read.parquet(f"{out}/changes"), cols) == rows(snapshot_changes(full), cols)


def _lines(spark, texts, part, slices=1):
    rows = [(x, part, 0) for x in texts]
    return spark.createDataFrame(rows, "value string, part string, pos long").coalesce(slices)


def test_a_batch_that_runs_again_writes_the_same(spark, tmp_dir):
    lines, out = benign(730), os.path.join(tmp_dir, "out")
    names = ("windows", "edges", "open", "progress", "state", "snapshot", "changes", "last")

    def written():
        return {n: sorted(map(str, spark.read.parquet(f"{out}/{n}").collect())) for n in names}

    live.live_batch(spark, _lines(spark, lines[:330], "a"), out, 0, window_size=100, warmup=2)
    live.live_batch(spark, _lines(spark, lines[330:], "b"), out, 1, window_size=100, warmup=2)
    first = written()
    live.live_batch(spark, _lines(spark, lines[330:], "b"), out, 1, window_size=100, warmup=2)
    assert written() == first
    edges = spark.read.parquet(f"{out}/edges").orderBy("rank").collect()
    assert [r.raw for r in edges] == lines[:700] and [r.rank for r in edges] == list(range(700))
    assert [r.window_no for r in edges] == [i // 100 for i in range(700)]
    (p,) = spark.read.parquet(f"{out}/progress/batch=1").collect()
    assert (p.next_rank, p.open_edges, p.dropped) == (700, 30, 0)


def test_a_capped_open_window_keeps_its_newest_edges_and_counts_the_others(spark, tmp_dir):
    lines, out = benign(400), os.path.join(tmp_dir, "out")
    options = {"window_size": 100, "warmup": 2, "buffer_cap": 20, "mitigate": False}
    live.live_batch(spark, _lines(spark, lines[:150], "a"), out, 0, **options)
    live.live_batch(spark, _lines(spark, ["bad"], "b"), out, 1, **options)
    live.live_batch(spark, _lines(spark, lines[150:], "c"), out, 2, **options)
    edges = spark.read.parquet(f"{out}/edges").orderBy("rank").collect()
    assert [r.raw for r in edges] == lines[:100] + lines[130:330]
    p = {r.batch: (r.next_rank, r.open_edges, r.dropped) for r in spark.read.parquet(f"{out}/progress").collect()}
    assert p == {0: (100, 20, 30), 1: (100, 20, 30), 2: (300, 20, 80)}


def test_drain_by_lines_and_by_idle_time(spark, tmp_dir):
    lines = benign(1000)
    folder, out = _folder(tmp_dir, lines, 100), os.path.join(tmp_dir, "out")

    def start():
        return live.run_stream(spark, folder, out, window_size=100, warmup=2, available_now=False, processing_time="0 seconds",
                               max_files_per_trigger=1, mitigate=False)

    assert 250 <= live.drain(start(), max_lines=250) < 1000
    live.drain(start(), idle_seconds=3)
    edges = spark.read.parquet(f"{out}/edges").orderBy("rank").collect()
    assert [r.raw for r in edges] == lines


def test_each_anomaly_reaches_the_feed_once(spark, tmp_dir):
    folder, out, feed = _folder(tmp_dir, _attack(), 1200), os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "feed")
    live.run_stream(spark, folder, out, window_size=200, warmup=12, max_files_per_trigger=1).awaitTermination(600)
    live.run_anomaly_feed(spark, out, feed).awaitTermination(300)
    events = spark.read.parquet(f"{out}/anomalies")
    expected = sorted(r.anomaly_id for r in events.collect())
    assert sorted(r.anomaly_id for r in spark.read.parquet(feed).collect()) == expected and len(expected) >= 2
    # the last batch's events once more, as a batch that ran twice leaves them
    again = events.filter(F.col("batch") == events.agg(F.max("batch")).first()[0]).drop("batch")
    again.withColumn("found_at", F.current_timestamp()).write.mode("append").parquet(f"{out}/anomalies/batch=99")
    live.run_anomaly_feed(spark, out, feed).awaitTermination(300)
    assert sorted(r.anomaly_id for r in spark.read.parquet(feed).collect()) == expected
    payloads = {r.anomaly_id: r.payload for r in sinks.anomaly_feed(events.drop("batch")).collect()}
    assert {r.anomaly_id: r.payload for r in spark.read.parquet(feed).collect()} == payloads
