"""Formats, detectors and validators that a user adds."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from graphwatch.functions import mitigation
from graphwatch.operators.analyze import classify
from graphwatch.operators.signals import DETECTORS
from graphwatch.sources import registry
from graphwatch.sources.tables import to_edges


def test_a_line_parser_and_a_reader_become_formats(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(registry, "SOURCES", dict(registry.SOURCES))

    def piped(df, col="value", source_id=None, keep_rejects=False):
        part = F.split(F.col(col), r"\|")
        return (df.filter(F.size(part) == 2)
                .select(F.lit(source_id).alias("source_id"), F.col("part"), F.col("pos"), F.col("seq"), part[0].alias("src"),
                        part[1].alias("dst"), F.lit(1.0).alias("weight"), F.col(col).alias("raw"), F.lit("").alias("timestamp"),
                        F.lit(None).cast("timestamp").alias("ts")))

    registry.register_line_parser("piped", piped)
    path = os.path.join(tmp_dir, "a.txt")
    with open(path, "w") as fh:
        fh.write("a|b\nnothing\nb|c\n")
    got = registry.load_edges(spark, ["piped:" + path]).orderBy("seq").collect()
    assert [(r.src, r.dst) for r in got] == [("a", "b"), ("b", "c")]

    def fixed(spark, paths, source_id="batch", source_index=0):
        return piped(spark.createDataFrame([("x|y", "p", 0, 0)], "value string, part string, pos long, seq long"), "value", source_id)

    registry.register_source("fixed", fixed)
    (r,) = registry.load_edges(spark, ["fixed:" + path]).collect()
    assert (r.src, r.dst) == ("x", "y")
    with pytest.raises(ValueError):
        registry.load_edges(spark, ["unheard:" + path]).collect()


def test_any_table_with_two_columns_is_a_source(spark):
    df = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 3.0)], "caller string, callee string, seconds double")
    got = to_edges(df, src=F.col("caller"), dst=F.col("callee"), weight=F.col("seconds")).orderBy("src").collect()
    assert [(r.src, r.dst, r.weight) for r in got] == [("a", "b", 2.0), ("b", "c", 3.0)]


def test_a_fourth_detector_votes(spark):
    rows = [(k, 10 + k, 0.5, 1, 0.5, 1) for k in range(3)]
    windows = spark.createDataFrame(rows, "window_no long, n int, lambda2 double, mult int, cmp_lambda2 double, cmp_mult int").select(
        F.lit("s").alias("source_id"), "*", (F.col("window_no") + 12).alias("r"), F.array().cast("array<string>").alias("outliers"),
        F.col("cmp_lambda2").alias("baseline_lambda2"), F.col("cmp_mult").alias("baseline_mult"))

    def crowded(delta):
        return F.struct((F.col("n") > 10).alias("fired"), F.lit(1.0).alias("score"), F.lit("crowded").alias("detail"),
                        F.array().cast("array<string>").alias("nodes"))

    plain = {r.window_no: r.votes for r in classify(windows, 12).collect()}
    assert plain == {0: 0, 1: 0, 2: 0}
    more = [*DETECTORS, ("crowd", crowded), ("crowd2", crowded)]
    rows = {r.window_no: r for r in classify(windows, 12, detectors=more).collect()}
    assert {k: r.votes for k, r in rows.items()} == {0: 0, 1: 2, 2: 2}
    assert rows[1].status == "ANOMALY" and rows[0].status == "normal"


def test_a_validator_of_ones_own(spark, monkeypatch):
    monkeypatch.setattr(mitigation, "VALIDATORS", dict(mitigation.VALIDATORS))
    mitigation.register_validator(" Rota ", lambda s: F.struct(s.startswith("call").alias("valid"), F.lit("on call").alias("reason")))
    df = spark.createDataFrame([(1, "rota", "call Ada"), (2, "rota", "mail Ada"), (3, "docker", "{}")], "i int, kind string, script string")
    got = {r.i: r.validation for r in mitigation.validate_mitigations(df, "kind", "script").collect()}
    assert (got[1].valid, got[1].reason, got[2].valid, got[3].valid) == (True, "on call", False, False)
