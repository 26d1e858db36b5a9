"""Edges from tables (posted edge records, driver tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwatch.schema import EDGE_COLUMNS


def to_edges(df: DataFrame, *, src: Column, dst: Column, weight: Column | None = None,
             source_id: str | Column = "table", part: Column | None = None,
             pos: Column | None = None, seq: Column | None = None,
             raw: Column | None = None, timestamp: Column | None = None,
             ts: Column | None = None) -> DataFrame:
    """Project any table onto the edge schema."""
    sid = F.lit(source_id) if isinstance(source_id, str) else source_id
    return df.select(
        sid.cast("string").alias("source_id"),
        (part if part is not None else F.lit(None)).cast("string").alias("part"),
        (pos if pos is not None else F.lit(None)).cast("long").alias("pos"),
        (seq if seq is not None else F.lit(None)).cast("long").alias("seq"),
        src.cast("string").alias("src"),
        dst.cast("string").alias("dst"),
        (weight if weight is not None else F.lit(1.0)).cast("double").alias("weight"),
        (raw if raw is not None else F.lit("")).cast("string").alias("raw"),
        (timestamp if timestamp is not None else F.lit("")).cast("string").alias("timestamp"),
        (ts if ts is not None else F.lit(None)).cast("timestamp").alias("ts"),
    )


def edges_from_rows(df: DataFrame, src: str = "src", dst: str = "dst",
                    weight: str | None = "weight", raw: str | None = "raw",
                    source_id: str = "posted", order: list[str] | None = None) -> DataFrame:
    """Posted edge records: keep rows whose two ends are non-empty; weight defaults to 1.0.

    ``order`` names the columns that give the posted order (first one long-typed
    or castable); without it the rows keep the order of ``monotonically_increasing_id``.
    """
    cols = set(df.columns)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight and weight in cols else F.lit(1.0)
    r = F.coalesce(F.col(raw).cast("string"), F.lit("")) if raw and raw in cols else F.lit("")
    seq = F.col(order[0]) if order else F.monotonically_increasing_id()
    kept = df.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()
                     & (F.length(F.col(src).cast("string")) > 0)
                     & (F.length(F.col(dst).cast("string")) > 0))
    return to_edges(kept, src=F.col(src), dst=F.col(dst), weight=w, raw=r,
                    source_id=source_id, seq=seq)


def event_log_line(events: DataFrame) -> Column:
    """Render an ``events`` row as a combined access-log line (text form of the table)."""
    ip = F.format_string("10.%d.%d.%d", F.expr("user_id div 65536") % 256,
                         F.expr("user_id div 256") % 256, F.col("user_id") % 256)
    method = F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET")
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    return F.format_string(
        '%s - - [%s] "%s /%s HTTP/1.1" %d %d "-" "gw-agent/1.0"',
        ip, F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss Z"), method, F.col("event_type"),
        status, (F.col("value") * 100).cast("long"))


def _utc(c: str) -> "Column":
    """Table timestamps may be TIMESTAMP_NTZ; read them as instants in the session zone (UTC)."""
    return F.col(c).cast("timestamp")


def edges_from_events(events: DataFrame, weight: str = "value",
                      source_id: str = "events") -> DataFrame:
    """Default event graph: ``u<user_id> -> event_type``, ordered by ``(ts, event_id)``.

    ``weight="value"`` uses the event value, ``weight="unit"`` weight 1.
    """
    w = F.col("value") if weight == "value" else F.lit(1.0)
    ev = events.withColumn("ts", _utc("ts"))
    return to_edges(
        ev, src=F.concat(F.lit("u"), F.col("user_id").cast("string")),
        dst=F.col("event_type"), weight=w, source_id=source_id,
        pos=F.unix_micros("ts"), seq=F.col("event_id"), raw=event_log_line(ev),
        timestamp=F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss Z"), ts=F.col("ts"))


def edges_from_orders(lineitem: DataFrame, orders: DataFrame,
                      source_id: str = "orders") -> DataFrame:
    """Customer -> supplier graph from ``lineitem`` joined to ``orders``; weight ``l_quantity``.

    Ordered by ``(o_orderdate, l_orderkey, l_linenumber)``. Both sides are large,
    so this is a shuffle join on the order key (co-locate by bucketing both
    tables on it when the job is repeated).
    """
    li = lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    od = orders.select("o_orderkey", "o_custkey", _utc("o_orderdate").alias("o_orderdate"))
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    return to_edges(
        j, src=F.concat(F.lit("c"), F.col("o_custkey").cast("string")),
        dst=F.concat(F.lit("s"), F.col("l_suppkey").cast("string")),
        weight=F.col("l_quantity"), source_id=source_id,
        pos=F.unix_micros("o_orderdate"),
        seq=F.col("l_orderkey") * 8 + F.col("l_linenumber"),
        raw=F.format_string("order %d line %d: customer %d -> supplier %d qty %.1f",
                            F.col("l_orderkey"), F.col("l_linenumber"), F.col("o_custkey"),
                            F.col("l_suppkey"), F.col("l_quantity")),
        ts=F.col("o_orderdate"))


__all__ = ["EDGE_COLUMNS", "edges_from_events", "edges_from_orders", "edges_from_rows",
           "event_log_line", "to_edges"]
