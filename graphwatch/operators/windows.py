"""Window assignment: count-based tumbling windows and event-time windows.

Count windows need an exact position for every edge inside its stream.
A global ``row_number()`` over an unpartitioned window would pull every
edge into one task, so the rank is computed in two levels:

1. range-partition the edges on ``(source_id, order...)`` and sort each
   partition (the range partitioner samples the keys, so partitions stay
   balanced even when one stream or one instant holds most rows — the
   order key is unique, so no single key value can be hot);
2. number rows inside each partition (``monotonically_increasing_id``
   counts in partition order) and count rows per ``(partition, stream)``;
3. prefix-sum that count table — at most ``partitions + streams`` rows —
   and broadcast it back as an offset.

The order key must be unique inside a stream (``(part, pos, seq)`` for
the built-in sources), otherwise ties could be numbered differently on a
re-run.

The range partitioner draws its key sample with a seed tied to the plan
instance, so two plan branches (the count table and the rows, or two
consumers with different column pruning) would not share partition
bounds. The locally numbered frame is therefore materialized once with a
reliable ``checkpoint()`` into ``spark.checkpoint.dir`` — what
``zipWithIndex`` users do — which also makes a re-run after a lost
executor read identical positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwatch.schema import ORDER_COLUMNS
from graphwatch.session import ensure_checkpoint_dir

_PID = "_gw_pid"
_LOC = "_gw_loc"


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return int(partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def sequence_rank(df: DataFrame, order: Sequence[str] = ORDER_COLUMNS,
                  key: str = "source_id", partitions: int | None = None,
                  rank_col: str = "rank") -> DataFrame:
    """Add a 0-based position of each row inside ``key`` following ``order``."""
    n_parts = _partitions(df, partitions)
    sort_keys = [F.col(key).asc_nulls_first()] + [F.col(c).asc_nulls_first() for c in order]
    local = (df.repartitionByRange(n_parts, *sort_keys)
             .sortWithinPartitions(*sort_keys)
             .withColumn(_PID, F.spark_partition_id())
             .withColumn(_LOC, F.monotonically_increasing_id()
                         - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    # Fix partition and local index once; counts and rows both read this.
    ensure_checkpoint_dir(df.sparkSession)
    local = local.checkpoint(eager=True)
    # One row per (partition, stream): bounded by partitions + streams - 1,
    # because a range partition boundary splits at most one stream.
    counts = local.groupBy(_PID, key).agg(F.count(F.lit(1)).alias("_gw_cnt"),
                                          F.min(_LOC).alias("_gw_first"))
    before = Window.partitionBy(key).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PID, key, "_gw_first",
                            F.coalesce(F.sum("_gw_cnt").over(before), F.lit(0)).alias("_gw_off"))
    return (local.join(F.broadcast(offsets), [_PID, key])
            .withColumn(rank_col, F.col("_gw_off") + F.col(_LOC) - F.col("_gw_first"))
            .drop(_PID, _LOC, "_gw_off", "_gw_first"))


def count_windows(edges: DataFrame, size: int | Column = 200,
                  order: Sequence[str] = ORDER_COLUMNS, key: str = "source_id",
                  partitions: int | None = None) -> DataFrame:
    """Tumbling windows of ``size`` edges per stream (the last one may be short).

    Adds ``rank`` (0-based position in the stream) and ``window_no``.
    ``size`` may be a column (e.g. a per-stream size joined in).
    """
    ranked = sequence_rank(edges, order, key, partitions)
    size_col = size if isinstance(size, Column) else F.lit(int(size))
    return ranked.withColumn("window_no", F.floor(F.col("rank") / size_col).cast("long"))


def quarter_windows(edges: DataFrame, order: Sequence[str] = ORDER_COLUMNS,
                    key: str = "source_id", partitions: int | None = None) -> DataFrame:
    """Windows of ``max(3, count // 4)`` edges per stream (posted-edge diagnosis)."""
    ranked = sequence_rank(edges, order, key, partitions)
    sizes = (ranked.groupBy(key).agg(F.count(F.lit(1)).alias("_gw_total"))
             .select(key, F.greatest(F.lit(3), F.floor(F.col("_gw_total") / 4))
                     .cast("long").alias("window_size")))
    return (ranked.join(sizes, key)
            .withColumn("window_no", F.floor(F.col("rank") / F.col("window_size")).cast("long")))


def time_windows(edges: DataFrame, seconds: float = 5.0, ts_col: str = "ts",
                 key: str = "source_id") -> DataFrame:
    """Event-time tumbling windows aligned to the epoch, numbered from each stream's first.

    ``window_no = floor(ts / width) - floor(first_ts / width)``; empty
    windows keep their number (gaps), which keeps numbering a per-row
    expression instead of a global ranking. Rows without ``ts`` are dropped.
    """
    width = int(round(seconds * 1_000_000))
    bucket = F.floor(F.unix_micros(F.col(ts_col)) / F.lit(width)).cast("long")
    with_bucket = edges.filter(F.col(ts_col).isNotNull()).withColumn("_gw_bucket", bucket)
    first = with_bucket.groupBy(key).agg(F.min("_gw_bucket").alias("_gw_first"))
    return (with_bucket.join(first, key)
            .withColumn("window_no", F.col("_gw_bucket") - F.col("_gw_first"))
            .withColumn("window_start", F.timestamp_micros(F.col("_gw_bucket") * F.lit(width)))
            .withColumn("window_end", F.timestamp_micros((F.col("_gw_bucket") + 1) * F.lit(width)))
            .drop("_gw_bucket", "_gw_first"))


def range_filter(edges: DataFrame, start: str | None = None, end: str | None = None,
                 mode: str = "lexical", fmt: str = "dd/MMM/yyyy:HH:mm:ss Z") -> DataFrame:
    """Keep edges with ``start <= timestamp <= end``.

    ``mode="lexical"`` compares the timestamp text (edges without one are
    dropped by ``start`` and kept by ``end``). ``mode="event_time"`` parses
    ``timestamp`` with ``fmt`` (or uses ``ts``) and compares instants.
    """
    out = edges
    if mode == "lexical":
        if start:
            out = out.filter((F.col("timestamp") != "") & (F.col("timestamp") >= F.lit(start)))
        if end:
            out = out.filter((F.col("timestamp") == "") | F.col("timestamp").isNull()
                             | (F.col("timestamp") <= F.lit(end)))
        return out
    if mode != "event_time":
        raise ValueError(f"unknown range mode: {mode!r}")
    # rows with an instant are cut on the plain column, which a scan can take over
    ts = F.col("ts")
    when = F.coalesce(ts, F.try_to_timestamp(F.col("timestamp"), F.lit(fmt)))
    if start:
        bound = F.to_timestamp(F.lit(start))
        out = out.filter(ts.isNull() | (ts >= bound)).filter(when >= bound)
    if end:
        bound = F.to_timestamp(F.lit(end))
        out = out.filter(ts.isNull() | (ts <= bound)).filter(when <= bound)
    return out


def window_sizes(windowed: DataFrame, key: str = "source_id") -> DataFrame:
    """Edges per window ``m`` (one row per window)."""
    return windowed.groupBy(key, "window_no").agg(F.count(F.lit(1)).alias("m"))
