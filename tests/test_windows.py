"""Window assignment: exact two-level rank, count/quarter/time windows, range filter."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from graphwatch.operators.windows import count_windows, quarter_windows, range_filter, sequence_rank
from graphwatch.plans.scenarios import event_edges

SF = "/root/testdata/sf0.001"


def test_rank_equals_global_row_number(spark):
    ref = dict(duckdb.sql(f"select event_id, row_number() over (order by ts, event_id) - 1 "
                          f"from '{SF}/events.parquet'").fetchall())
    for parts in (1, 3, 7):
        shuffled = event_edges(spark, SF).repartition(5)
        got = {r.seq: r.rank for r in sequence_rank(shuffled, partitions=parts).select("seq", "rank").collect()}
        assert got == ref


def test_rank_per_stream(spark):
    e = event_edges(spark, SF)
    two = e.unionByName(e.withColumn("source_id", F.lit("copy")))
    counts = sequence_rank(two).groupBy("source_id").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"),
                                                         F.countDistinct("rank").alias("d")).collect()
    assert all(r.lo == 0 and r.hi == r.d - 1 for r in counts)


def test_count_windows_short_last(spark):
    w = count_windows(event_edges(spark, SF), 300)
    sizes = sorted((r.window_no, r.c) for r in w.groupBy("window_no").agg(F.count("*").alias("c")).collect())
    assert sizes == [(0, 300), (1, 300), (2, 300), (3, 100)]


def test_quarter_windows(spark):
    w = quarter_windows(event_edges(spark, SF))
    assert {r.window_size for r in w.select("window_size").distinct().collect()} == {250}


def test_range_filter_lexical_keeps_empty_on_end_only(spark):
    df = spark.createDataFrame([("a",), ("",), ("c",)], "timestamp string")
    assert [r.timestamp for r in range_filter(df, start="b").collect()] == ["c"]
    assert sorted(r.timestamp for r in range_filter(df, end="b").collect()) == ["", "a"]
