"""Fixed schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# One communication record. ``source_id`` names the stream a baseline is
# learned for; ``(part, pos, seq)`` is a total order inside it (Spark has
# no implicit row order): for text files the file, the split start and the
# line's position in the split, for tables a data key. ``ts`` is the parsed
# event time when the source has one, ``timestamp`` the original text.
EDGE_SCHEMA = T.StructType([
    T.StructField("source_id", T.StringType(), False),
    T.StructField("part", T.StringType(), True),
    T.StructField("pos", T.LongType(), True),
    T.StructField("seq", T.LongType(), True),
    T.StructField("src", T.StringType(), True),
    T.StructField("dst", T.StringType(), True),
    T.StructField("weight", T.DoubleType(), True),
    T.StructField("raw", T.StringType(), True),
    T.StructField("timestamp", T.StringType(), True),
    T.StructField("ts", T.TimestampType(), True),
])

EDGE_COLUMNS = [f.name for f in EDGE_SCHEMA.fields]
ORDER_COLUMNS = ["part", "pos", "seq"]

SIGNAL_TYPE = T.StructType([
    T.StructField("fired", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("detail", T.StringType()),
    T.StructField("nodes", T.ArrayType(T.StringType())),
])

SUBGRAPH_EDGE_TYPE = T.StructType([
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("weight", T.DoubleType()),
])

# Per-window spectral summary produced by ``operators.spectrum``.
SPECTRUM_SCHEMA = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("window_no", T.LongType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("m", T.LongType()),
    T.StructField("pairs", T.LongType()),
    T.StructField("components", T.IntegerType()),
    T.StructField("eigenvalues", T.ArrayType(T.DoubleType())),
    T.StructField("lambda2", T.DoubleType()),
    T.StructField("mult", T.IntegerType()),
    T.StructField("embed_dims", T.IntegerType()),
    T.StructField("degenerate", T.BooleanType()),
    T.StructField("outliers", T.ArrayType(T.StringType())),
    T.StructField("sub_nodes", T.ArrayType(T.StringType())),
])

STATUS_BASELINE = "baseline"
STATUS_NORMAL = "normal"
STATUS_ANOMALY = "ANOMALY"
REASON_TINY = "tiny graph"
