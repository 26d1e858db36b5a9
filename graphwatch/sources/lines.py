"""Line-oriented sources: parsers as column expressions, readers over text files.

Every parser takes a DataFrame with a text column and returns the edge
columns (rows that do not parse are dropped; ``quarantine`` returns them).
Readers add the file order key: ``part`` = file path (prefixed with the
source's position in a multi-source load), ``pos`` = split start,
``seq`` = position inside the split (``monotonically_increasing_id`` of
the scan, increasing in line order within a split).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwatch.functions.text import first_path_segment, strip
from graphwatch.schema import EDGE_COLUMNS

# Record patterns of the supported formats.
ACCESS_LOG_PATTERN = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S+)'
IPV4_PATTERN = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
SYSLOG_PAIR_PATTERN = r"src=(\S+)\s+dst=(\S+)"
FLOW_LOG_VERSION = "2"
FLOW_LOG_MIN_FIELDS = 12
ARROW = "->"


def _edge_select(df: DataFrame, keep: Column, src: Column, dst: Column, weight: Column,
                 raw: Column, timestamp: Column | None = None,
                 source_id: str | None = None, keep_rejects: bool = False) -> DataFrame:
    """Project parsed columns onto the edge schema, keeping order columns if present.

    ``keep_rejects=True`` keeps every row and adds ``parsed_ok`` (for a quarantine sink).
    """
    cols = set(df.columns)
    order = [F.col(c) if c in cols else F.lit(None).alias(c) for c in ("part", "pos", "seq")]
    sid = (F.lit(source_id) if source_id else
           (F.col("source_id") if "source_id" in cols else F.lit("lines"))).alias("source_id")
    extra = [F.coalesce(keep, F.lit(False)).alias("parsed_ok")] if keep_rejects else []
    base = df if keep_rejects else df.filter(keep)
    return base.select(
        *extra,
        sid, order[0].cast("string").alias("part"), order[1].cast("long").alias("pos"),
        order[2].cast("long").alias("seq"),
        src.alias("src"), dst.alias("dst"), weight.cast("double").alias("weight"),
        raw.alias("raw"), (timestamp if timestamp is not None else F.lit("")).alias("timestamp"),
        F.lit(None).cast("timestamp").alias("ts"))


# ---------------------------------------------------------------- access log (S1, S12, C2)

def parse_access_log(df: DataFrame, col: str = "value", source_id: str | None = None, keep_rejects: bool = False,
                     parse_time: bool = True) -> DataFrame:
    """Combined access-log lines -> ``ip -> first path segment``, weight 1, timestamp text kept.

    ``ts`` is filled from the bracketed time (``dd/MMM/yyyy:HH:mm:ss Z``)
    when ``parse_time``; unparseable times leave it null.
    """
    line = F.col(col)
    ok = line.isNotNull() & line.rlike(ACCESS_LOG_PATTERN)
    out = _edge_select(
        df, ok, F.regexp_extract(line, ACCESS_LOG_PATTERN, 1),
        first_path_segment(F.regexp_extract(line, ACCESS_LOG_PATTERN, 4)),
        F.lit(1.0), line, F.regexp_extract(line, ACCESS_LOG_PATTERN, 2), source_id, keep_rejects)
    if parse_time:
        out = out.withColumn("ts", F.try_to_timestamp(F.col("timestamp"),
                                                       F.lit("dd/MMM/yyyy:HH:mm:ss Z")))
    return out


# ---------------------------------------------------------------- flow log (S6)

def parse_flow_log(df: DataFrame, col: str = "value", source_id: str | None = None, keep_rejects: bool = False) -> DataFrame:
    """Space-separated flow-log v2 records: ``srcaddr -> dstaddr``, weight = packets (else 1.0).

    Needs at least 12 fields, version ``2``, and neither address ``-``;
    accept/reject is not filtered.
    """
    parts = F.split(strip(F.col(col)), r"\s+")
    n = F.size(parts)
    src, dst = F.element_at(parts, 4), F.element_at(parts, 5)
    ok = (F.col(col).isNotNull() & (n >= FLOW_LOG_MIN_FIELDS)
          & (F.element_at(parts, 1) == FLOW_LOG_VERSION) & (src != "-") & (dst != "-"))
    weight = F.coalesce(F.element_at(parts, 9).try_cast("double"), F.lit(1.0))
    return _edge_select(df, ok, src, dst, weight, strip(F.col(col)), None, source_id, keep_rejects)


# ---------------------------------------------------------------- syslog (S8)

def parse_syslog(df: DataFrame, col: str = "value", source_id: str | None = None, keep_rejects: bool = False) -> DataFrame:
    """Host pairs from syslog lines: ``src=… dst=…``; else the first IPv4 on each side of
    ``->``; else the first two IPv4 addresses on the line."""
    line = F.col(col)
    has_pair = line.rlike(SYSLOG_PAIR_PATTERN)
    at = F.instr(line, ARROW)
    left = F.substring_index(line, ARROW, 1)
    right = F.substring(line, at + len(ARROW), 1 << 30)
    l_ips = F.regexp_extract_all(left, F.lit(IPV4_PATTERN), 0)
    r_ips = F.regexp_extract_all(right, F.lit(IPV4_PATTERN), 0)
    all_ips = F.regexp_extract_all(line, F.lit(IPV4_PATTERN), 0)
    arrow_ok = (at > 0) & (F.size(l_ips) > 0) & (F.size(r_ips) > 0)
    src = (F.when(has_pair, F.regexp_extract(line, SYSLOG_PAIR_PATTERN, 1))
           .when(arrow_ok, F.element_at(l_ips, 1)).otherwise(F.element_at(all_ips, 1)))
    dst = (F.when(has_pair, F.regexp_extract(line, SYSLOG_PAIR_PATTERN, 2))
           .when(arrow_ok, F.element_at(r_ips, 1)).otherwise(F.element_at(all_ips, 2)))
    ok = line.isNotNull() & (has_pair | arrow_ok | (F.size(all_ips) >= 2))
    return _edge_select(df, ok, src, dst, F.lit(1.0), line, None, source_id, keep_rejects)


# ---------------------------------------------------------------- "a -> b" lines (S9)

def parse_arrow_lines(df: DataFrame, col: str = "value", source_id: str | None = None, keep_rejects: bool = False) -> DataFrame:
    """``a -> b`` lines split on the first arrow, both ends trimmed and non-empty."""
    line = F.col(col)
    at = F.instr(line, ARROW)
    src = strip(F.substring_index(line, ARROW, 1))
    dst = strip(F.substring(line, at + len(ARROW), 1 << 30))
    ok = line.isNotNull() & (at > 0) & (F.length(src) > 0) & (F.length(dst) > 0)
    return _edge_select(df, ok, src, dst, F.lit(1.0), line, None, source_id, keep_rejects)


# ---------------------------------------------------------------- readers

def read_lines(spark: SparkSession, paths: str | Sequence[str], source_index: int = 0) -> DataFrame:
    """Text lines with the file order key (``part``, ``pos``, ``seq``)."""
    plist = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.text(plist)
    return df.select(
        "value",
        F.format_string("%05d:%s", F.lit(source_index), F.col("_metadata.file_path")).alias("part"),
        F.col("_metadata.file_block_start").alias("pos"),
        F.monotonically_increasing_id().alias("seq"))


def read_access_log(spark: SparkSession, paths, source_id: str = "batch", source_index: int = 0):
    return parse_access_log(read_lines(spark, paths, source_index), source_id=source_id)


def read_flow_log(spark: SparkSession, paths, source_id: str = "batch", source_index: int = 0):
    return parse_flow_log(read_lines(spark, paths, source_index), source_id=source_id)


def read_syslog(spark: SparkSession, paths, source_id: str = "batch", source_index: int = 0):
    """Syslog files; the text reader replaces invalid UTF-8 like Python's ``errors='replace'``."""
    return parse_syslog(read_lines(spark, paths, source_index), source_id=source_id)


def read_arrow_lines(spark: SparkSession, paths, source_id: str = "batch", source_index: int = 0):
    return parse_arrow_lines(read_lines(spark, paths, source_index), source_id=source_id)


def quarantine(df: DataFrame, parsed_ok: Column) -> DataFrame:
    """Rows a parser rejects (for a quarantine sink)."""
    return df.filter(~F.coalesce(parsed_ok, F.lit(False)))


__all__ = ["ACCESS_LOG_PATTERN", "EDGE_COLUMNS", "parse_access_log", "parse_arrow_lines",
           "parse_flow_log", "parse_syslog", "read_access_log", "read_arrow_lines",
           "read_flow_log", "read_lines", "read_syslog"]
