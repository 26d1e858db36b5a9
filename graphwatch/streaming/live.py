"""Structured Streaming: live count windows, live baseline, event-time windows.

Count windows (R1): lines of files that arrive in a folder are parsed in
``foreachBatch`` and written once, numbered by the scan (dense inside every
file split, since the number is taken after the parser's filter). A ledger
with one row per split (count, first number) and its prefix sums give every
edge its exact place in the stream, so no task holds a file or a stream and
nothing is sorted. What does not fill a window (fewer than ``window_size``
edges per stream; ``buffer_cap`` may trim it) is written as the batch's open
edges and joins the next batch; live mode never analyses a short window.

The full windows of a batch go through the same operators as a batch job
(adjacency, grouped spectrum) and are classified against a persisted
baseline state with one row per stream (R2: windows seen, sum of the
warm-up λ₂, first multiplicity, last EMA values), so each batch does work
proportional to its own windows. Anomalous windows get their subgraph, logs,
diagnosis and checked mitigation; audit records, the snapshot per stream and
the changes of it follow. Every output is written under ``batch=<id>`` with
overwrite: a retried batch replaces its own rows and no other's.

Event-time windows (R3): ``withWatermark`` + ``window()`` aggregate the
adjacency per tumbling window; rows later than the watermark are dropped
(Spark reports them as ``numRowsDroppedByWatermark``; ``late_rows`` adds
them up).
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphwatch.operators.graph import adjacency
from graphwatch.operators.spectrum import spectrum
from graphwatch.session import ensure_checkpoint_dir
from graphwatch.sources import lines as L

# Fixed values of the live mode.
LIVE_WINDOW = 200
BUFFER_CAP = None              # newest edges kept of an unfinished window; None: all of them

SPLIT = ["source_id", "part", "pos"]
OPEN_SCHEMA = "source_id string, rank long, src string, dst string, weight double, raw string"
PROGRESS_SCHEMA = "source_id string, next_rank long, open_edges long, dropped long"

Parser = Callable[..., DataFrame]


def line_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None,
                start: str = "earliest") -> DataFrame:
    """``(value, part, pos)``: lines of files arriving in ``folder`` (rolled logs)
    with their file and split.

    The file source takes new files oldest first (modification time), and
    inside a micro-batch files follow one another by path, so rolled files
    must carry increasing modification times and sortable names.
    ``start="latest"`` skips files already present when the query starts.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(folder).select(
        "value", F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("pos"),
        F.col("_metadata.file_modification_time").alias("mtime"))
    if start == "latest":
        # files modified before the query was built are skipped; the instant is fixed
        # once here (current_timestamp() would move with every micro-batch)
        import datetime as _dt
        started = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        raw = raw.filter(F.col("mtime") >= F.lit(started).cast("timestamp"))
    return raw.drop("mtime")


def parsed_lines(lines: DataFrame, parser: Parser, source_id: str) -> DataFrame:
    """Edges of a batch's lines with ``part``, ``pos`` and ``line``: a number that
    is dense and in line order inside every split."""
    edges = parser(lines.withColumn("seq", F.lit(0).cast("long")), "value", source_id)
    return (edges.select("source_id", "part", "pos", "src", "dst", "weight", "raw")
            .withColumn("line", F.monotonically_increasing_id()))


def place_edges(arrived: DataFrame, open_edges: DataFrame | None, progress: DataFrame | None,
                window_size: int = LIVE_WINDOW, buffer_cap: int | None = BUFFER_CAP
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(windowed, open, progress)`` of one batch.

    ``arrived``: a written table of ``parsed_lines``. ``open_edges`` and
    ``progress`` are those of the batch before (None at the start). Windows that
    are full come back with their numbers; ``progress`` has, per stream, the rank
    that the first open edge has, how many are open and how many were dropped."""
    spark = arrived.sparkSession
    if progress is None:
        open_edges, progress = spark.createDataFrame([], OPEN_SCHEMA), spark.createDataFrame([], PROGRESS_SCHEMA)
    # the ledger: a row per split, with the stream's edges before it
    splits = arrived.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"))
    before = Window.partitionBy("source_id").orderBy("part", "pos").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.col("next_rank") + F.col("open_edges"), F.lit(0))
    ledger = (splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
              .join(progress.select("source_id", "next_rank", "open_edges"), "source_id", "left")
              .select(*SPLIT, "first", (done + F.col("before")).alias("base")))
    new = (arrived.join(ledger, SPLIT)
           .withColumn("rank", F.col("base") + F.col("line") - F.col("first")))
    columns = ["source_id", "rank", "src", "dst", "weight", "raw"]
    both = new.select(*columns).unionByName(open_edges.select(*columns))
    # where the full windows of each stream end
    counts = splits.groupBy("source_id").agg(F.sum("n").alias("n"))
    size = F.lit(int(window_size))
    ends = (progress.join(counts, "source_id", "full")
            .withColumn("from", F.coalesce("next_rank", F.lit(0)))
            .withColumn("all", F.coalesce("open_edges", F.lit(0)) + F.coalesce("n", F.lit(0)))
            .withColumn("end", F.col("from") + F.floor(F.col("all") / size) * size)
            .withColumn("left", F.col("from") + F.col("all") - F.col("end"))
            .withColumn("cut", F.greatest(F.col("left") - F.lit(buffer_cap), F.lit(0)) if buffer_cap is not None
                        else F.lit(0).cast("long")))
    placed = both.join(ends.select("source_id", "end", "cut"), "source_id")
    windowed = (placed.filter(F.col("rank") < F.col("end"))
                .withColumn("window_no", F.floor(F.col("rank") / size).cast("long"))
                .select("source_id", "window_no", "rank", "src", "dst", "weight", "raw"))
    # of an open window that is trimmed the newest edges stay, and move up
    rest = (placed.filter(F.col("rank") >= F.col("end") + F.col("cut"))
            .withColumn("rank", F.col("rank") - F.col("cut")).select(*columns))
    moved = ends.select("source_id", F.col("end").alias("next_rank"), (F.col("left") - F.col("cut")).alias("open_edges"),
                        (F.coalesce("dropped", F.lit(0)) + F.col("cut")).alias("dropped"))
    return windowed, rest, moved


STATE_SCHEMA = ("source_id string, n_seen long, sum_first double, first_mult int, "
                "ema_l2 double, ema_mult double, batch long")


def continue_baseline(spec: DataFrame, state: DataFrame | None, warmup: int = 12,
                      adaptive: bool = False, alpha: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Classify one batch of new windows against the stream's baseline state.

    ``state`` holds one row per stream (windows seen, sum of the first
    ``warmup`` λ₂, first multiplicity, last EMA values). Returns the new
    windows' rows and the updated state. Only this batch's windows are
    touched, so a long-running stream does constant work per batch.
    """
    from graphwatch.operators import baseline as bl
    from graphwatch.operators.analyze import WINDOW_COLUMNS, classify

    spark = spec.sparkSession
    if state is None:
        state = spark.createDataFrame([], STATE_SCHEMA)
    st = state.drop("batch")
    keep = F.col("n") >= bl.TINY_NODES
    per = Window.partitionBy("source_id").orderBy("window_no")   # this batch's windows of one stream
    w = (spec.join(st, "source_id", "left")  # state: one row per stream
         .withColumn("_keep", keep.cast("long"))
         .withColumn("_i", F.sum("_keep").over(per.rowsBetween(Window.unboundedPreceding, 0)) - 1)
         .withColumn("n_seen", F.coalesce("n_seen", F.lit(0)))
         .withColumn("r", F.when(keep, F.col("n_seen") + F.col("_i")).cast("long")))
    stream = Window.partitionBy("source_id")
    w = (w.withColumn("_first_new", F.sum(F.when(F.col("r") < warmup, F.col("lambda2"))).over(stream))
         .withColumn("_first_mult_new", F.max(F.when(F.col("r") == 0, F.col("mult"))).over(stream))
         .withColumn("_sum_first", F.coalesce("sum_first", F.lit(0.0)) + F.coalesce("_first_new", F.lit(0.0)))
         .withColumn("_first_mult", F.coalesce("first_mult", "_first_mult_new").cast("int")))
    if adaptive:
        seed = (st.filter(F.col("n_seen") > 0)
                .select("source_id", (F.col("n_seen") - 1).alias("r"), F.col("ema_l2").alias("lambda2"),
                        F.col("ema_mult").alias("mult"), F.lit(True).alias("_seed")))
        rows = w.filter(F.col("r").isNotNull()).select("source_id", "r", "lambda2", F.col("mult").cast("double"),
                                                       F.lit(False).alias("_seed"))
        both = seed.unionByName(rows)
        base_r = both.groupBy("source_id").agg(F.min("r").alias("_r0"))
        local = both.join(base_r, "source_id").withColumn("r", F.col("r") - F.col("_r0"))
        ema = (bl.ema_columns(local, ["lambda2", "mult"], alpha, "source_id", ["_l2", "_mu"])
               .filter(~F.col("_seed")).withColumn("r", F.col("r") + F.col("_r0"))
               .select("source_id", "r", "_l2_before", "_l2_after", "_mu_before", "_mu_after"))
        w = (w.join(ema, ["source_id", "r"], "left")
             .withColumn("cmp_lambda2", F.col("_l2_before"))
             .withColumn("cmp_mult", F.bround("_mu_before", 0).cast("int"))
             .withColumn("baseline_lambda2", F.col("_l2_after"))
             .withColumn("baseline_mult", F.bround("_mu_after", 0).cast("int")))
    else:
        w = (w.withColumn("cmp_lambda2", F.col("_sum_first") / F.lit(float(warmup)))
             .withColumn("cmp_mult", F.col("_first_mult"))
             .withColumn("baseline_lambda2", F.col("cmp_lambda2"))
             .withColumn("baseline_mult", F.col("cmp_mult")))
    w = w.checkpoint(eager=True)
    windows = classify(w, warmup).select(*WINDOW_COLUMNS)
    if adaptive:
        pair = F.struct(F.col("_l2_after").alias("l2"), F.col("_mu_after").alias("mu"))
    else:
        pair = F.struct(F.lit(None).cast("double").alias("l2"), F.lit(None).cast("double").alias("mu"))
    last = F.max_by(pair, F.col("r"))
    upd = (w.groupBy("source_id").agg(
        F.max("n_seen").alias("_prev"), F.sum("_keep").alias("_add"),
        F.max("_sum_first").alias("_sf"), F.max("_first_mult").alias("_fm"), last.alias("_last"),
        F.max("ema_l2").alias("_el"), F.max("ema_mult").alias("_em"))
        .select("source_id", (F.col("_prev") + F.col("_add")).alias("n_seen"),
                F.col("_sf").alias("sum_first"), F.col("_fm").alias("first_mult"),
                F.coalesce(F.col("_last.l2"), F.col("_el")).alias("ema_l2"),
                F.coalesce(F.col("_last.mu"), F.col("_em")).alias("ema_mult")))
    untouched = st.join(upd.select("source_id"), "source_id", "left_anti")
    return windows, upd.unionByName(untouched)


SNAPSHOT_SCHEMA = ("source_id string, windows long, anomalies long, anomaly boolean, votes int, lambda2 double, "
                   "multiplicity int, note string")


def merge_snapshot(now: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """One row per stream: the latest window's values with counts over all batches.
    ``now``: ``run_summary`` of the batch's windows."""
    from graphwatch.operators.analyze import summary_note

    if earlier is None:
        return now
    old = earlier.toDF(*[c if c == "source_id" else f"old_{c}" for c in earlier.columns])
    both = (now.join(old, "source_id", "full")
            .withColumn("latest", F.col("windows").isNotNull()))
    total = {c: F.coalesce(c, F.lit(0)) + F.coalesce(f"old_{c}", F.lit(0)) for c in ("windows", "anomalies")}
    kept = {c: F.when(F.col("latest"), F.col(c)).otherwise(F.col(f"old_{c}"))
            for c in ("anomaly", "votes", "lambda2", "multiplicity")}
    return (both.select("source_id", *[c.alias(n) for n, c in total.items()], *[c.alias(n) for n, c in kept.items()])
            .withColumn("note", summary_note(F.col("anomaly"), F.col("anomalies"))))


def analyze_batch(spark: SparkSession, windowed: DataFrame, out: str, batch_id: int, warmup: int = 12,
                  adaptive: bool = False, window_size: int = LIVE_WINDOW, alpha: float = 0.3,
                  mitigate: bool = True, feedback: str = "") -> None:
    """One micro-batch: spectra of its full windows, classified against the persisted
    baseline state; anomalies with subgraph, logs, diagnosis and mitigation; audit
    records; snapshot per stream and its changes. Every output is written under
    ``batch=<id>`` with overwrite, so a retried batch replaces its own rows."""
    from graphwatch import sinks
    from graphwatch.jobs import diagnosed
    from graphwatch.operators.analyze import latest, materialize, run_summary, snapshot_changes
    from graphwatch.operators.subgraph import anomaly_details

    def at(name: str, batch: int = batch_id) -> str:
        return f"{out}/{name}/batch={batch}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(at(name))
        return spark.read.schema(df.schema).parquet(at(name))

    def earlier(name: str, schema) -> DataFrame | None:
        # every batch writes all streams, so the last one's is read alone; only
        # the first batch has none, and a read error stops the query
        return spark.read.schema(schema).parquet(at(name, batch_id - 1)) if batch_id > 0 else None

    windowed = written(windowed, "edges")
    adj = adjacency(windowed, colocate=True)
    spec = materialize(spectrum(adj, pairs_bound=window_size))
    spec.write.mode("overwrite").parquet(at("spectra"))
    windows, state = continue_baseline(spec, earlier("state", STATE_SCHEMA), warmup, adaptive, alpha)
    windows = written(windows, "windows")
    state.drop("batch").write.mode("overwrite").parquet(at("state"))
    details = anomaly_details(windows, adj, windowed)
    if mitigate:
        details = diagnosed(details)
    events = written(sinks.anomaly_events(details, feedback).withColumn("found_at", F.current_timestamp()), "anomalies")
    sinks.audit_rows(events.drop("found_at")).write.mode("overwrite").json(at("audit"))
    written(merge_snapshot(run_summary(windows), earlier("snapshot", SNAPSHOT_SCHEMA)), "snapshot")
    last = earlier("last", windows.schema)
    known = windows if last is None else last.unionByName(windows)
    changes = snapshot_changes(known)
    if last is not None:
        changes = changes.join(last.select("source_id", "window_no"), ["source_id", "window_no"], "left_anti")
    changes.write.mode("overwrite").parquet(at("changes"))
    latest(known).select(*windows.columns).write.mode("overwrite").parquet(at("last"))


def live_batch(spark: SparkSession, lines: DataFrame, out: str, batch_id: int, parser: Parser = L.parse_access_log,
               source_id: str = "live", window_size: int = LIVE_WINDOW, buffer_cap: int | None = BUFFER_CAP,
               **options) -> None:
    """Parse and number a micro-batch's lines, cut full windows and analyse them."""
    def at(name: str, batch: int = batch_id) -> str:
        return f"{out}/{name}/batch={batch}"

    edges = parsed_lines(lines, parser, source_id)
    edges.write.mode("overwrite").parquet(at("arrived"))
    arrived = spark.read.schema(edges.schema).parquet(at("arrived"))
    open_edges = progress = None
    if batch_id > 0:
        open_edges = spark.read.schema(OPEN_SCHEMA).parquet(at("open", batch_id - 1))
        progress = spark.read.schema(PROGRESS_SCHEMA).parquet(at("progress", batch_id - 1))
    windowed, rest, moved = place_edges(arrived, open_edges, progress, window_size, buffer_cap)
    rest.write.mode("overwrite").parquet(at("open"))
    moved.write.mode("overwrite").parquet(at("progress"))
    analyze_batch(spark, windowed, out, batch_id, window_size=window_size, **options)


def run_stream(spark: SparkSession, folder: str, out: str, checkpoint: str | None = None,
               parser: Parser = L.parse_access_log, source_id: str = "live",
               window_size: int = LIVE_WINDOW, warmup: int = 12, adaptive: bool = False,
               available_now: bool = True, processing_time: str = "1 second",
               max_files_per_trigger: int | None = None, start: str = "earliest",
               buffer_cap: int | None = BUFFER_CAP, mitigate: bool = True) -> StreamingQuery:
    """Start the live analysis; returns the ``StreamingQuery``.

    ``available_now=True`` drains what is in the folder and stops (bounded
    run); otherwise the query polls every ``processing_time``, and ``drain``
    stops it after a number of lines or an idle time. ``start="latest"`` leaves
    out the files that are there when it starts. ``buffer_cap`` keeps only the
    newest edges of a window that waits to be filled; the dropped ones are
    counted in ``progress``.
    """
    ensure_checkpoint_dir(spark)

    def batch(df: DataFrame, batch_id: int) -> None:
        live_batch(spark, df, out, batch_id, parser, source_id, window_size, buffer_cap, warmup=warmup,
                   adaptive=adaptive, mitigate=mitigate)

    writer = (line_stream(spark, folder, max_files_per_trigger, start).writeStream
              .option("checkpointLocation", checkpoint or f"{out}/_checkpoint").foreachBatch(batch))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime=processing_time)
    return writer.start()


def drain(query: StreamingQuery, max_lines: int | None = None, idle_seconds: float | None = None,
          poll_seconds: float = 0.2) -> int:
    """Stop a polling query after the batch with which ``max_lines`` input lines are
    reached, or once no line has come for ``idle_seconds``; returns the lines read.
    The checkpoint stays, so the query can be started again where it stopped."""
    counted, changed = {}, time.monotonic()
    while query.isActive:
        for p in query.recentProgress:
            if p.numInputRows and p.batchId not in counted:
                counted[p.batchId], changed = p.numInputRows, time.monotonic()
        idle = not query.status["isTriggerActive"] and time.monotonic() - changed
        if max_lines is not None and sum(counted.values()) >= max_lines:
            break
        if idle_seconds is not None and idle and idle >= idle_seconds:
            break
        query.awaitTermination(poll_seconds)
    query.stop()
    return sum(counted.values())


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark, over the query's recent progress."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def run_anomaly_feed(spark: SparkSession, out: str, feed: str, checkpoint: str | None = None,
                     keep: str = "7 days", available_now: bool = True) -> StreamingQuery:
    """Feed of a live run's anomalies, each once: events that ``analyze_batch`` wrote
    below ``out`` are appended to ``feed`` as JSON payloads. A batch that ran twice
    writes its anomalies again; ids seen within ``keep`` are left out."""
    from graphwatch.sinks import anomaly_payload

    schema = spark.read.parquet(f"{out}/anomalies").drop("batch").schema
    events = spark.readStream.schema(schema).option("ignoreMissingFiles", True).parquet(f"{out}/anomalies")
    once = events.withWatermark("found_at", keep).dropDuplicatesWithinWatermark(["anomaly_id"])
    writer = (once.select("anomaly_id", anomaly_payload().alias("payload")).writeStream.outputMode("append").format("parquet")
              .option("checkpointLocation", checkpoint or f"{feed}/_checkpoint").option("path", feed))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
    return writer.start()


def run_quarantine_stream(spark: SparkSession, folder: str, out: str,
                          parser: Parser = L.parse_access_log, source_id: str = "live",
                          checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Lines of arriving files that do not parse, below ``out`` with file, split and
    line number in the split (R6: malformed input never fails ingestion and is kept
    for inspection). Runs as its own query with its own checkpoint next to
    ``run_stream``; a batch that runs again replaces its rows."""
    ensure_checkpoint_dir(spark)

    def batch(df: DataFrame, batch_id: int) -> None:
        lines = df.withColumn("seq", F.monotonically_increasing_id())
        first = lines.groupBy("part", "pos").agg(F.min("seq").alias("first"))
        bad = parser(lines, "value", source_id, keep_rejects=True).filter(~F.col("parsed_ok"))
        (bad.join(first, ["part", "pos"]).select("source_id", "part", "pos", (F.col("seq") - F.col("first")).alias("line"), "raw")
         .write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))

    writer = (line_stream(spark, folder).writeStream
              .option("checkpointLocation", checkpoint or f"{out}/_checkpoint_quarantine").foreachBatch(batch))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
    return writer.start()


def event_time_adjacency(edges: DataFrame, seconds: float = 5.0, lateness: str = "10 seconds",
                         ts_col: str = "ts") -> DataFrame:
    """Streaming adjacency per event-time tumbling window, emitted once the watermark passes."""
    w = F.window(F.col(ts_col), f"{seconds} seconds")
    return (edges.withWatermark(ts_col, lateness)
            .groupBy("source_id", w.alias("win"), "src", "dst")
            .agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("cnt"))
            .select("source_id", F.col("win.start").alias("window_start"),
                    (F.unix_micros(F.col("win.start")) / F.lit(int(seconds * 1_000_000))).cast("long")
                    .alias("window_no"), "src", "dst", "weight", "cnt"))


def run_event_time_stream(spark: SparkSession, folder: str, out: str, seconds: float = 5.0,
                          lateness: str = "10 seconds", parser: Parser = L.parse_access_log,
                          source_id: str = "live", checkpoint: str | None = None):
    """Event-time windows over arriving files; spectra per closed window appended to ``out``."""
    ensure_checkpoint_dir(spark)
    lines = line_stream(spark, folder).withColumn("seq", F.lit(0).cast("long"))
    edges = parser(lines, "value", source_id).withColumn("ts", F.try_to_timestamp(F.regexp_extract(
        "raw", L.ACCESS_LOG_PATTERN, 2), F.lit("dd/MMM/yyyy:HH:mm:ss Z")))
    adj = event_time_adjacency(edges, seconds, lateness)

    def per_batch(df: DataFrame, batch_id: int) -> None:
        # overwritten under the batch's name, so a batch that runs again replaces its rows
        spectrum(df.select("source_id", "window_no", "src", "dst", "weight", "cnt")) \
            .write.mode("overwrite").parquet(f"{out}/spectra/batch={batch_id}")

    return (adj.writeStream.outputMode("append")
            .option("checkpointLocation", checkpoint or f"{out}/_checkpoint_et")
            .foreachBatch(per_batch).trigger(availableNow=True).start())
