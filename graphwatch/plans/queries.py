"""Driver queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver tables (or text Spark renders from them), so
its work grows with the scale factor. Doubles are rounded to 6 places so
that a SQL engine summing in another order gives the same digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwatch import jobs as J
from graphwatch import sinks as K
from graphwatch.functions import mitigation as M
from graphwatch.functions.diagnosis import build_prompt, diagnose, parse_response
from graphwatch.functions.redact import redact, redaction_report
from graphwatch.functions.text import first_path_segment
from graphwatch.operators import analyze as A
from graphwatch.operators import graph as G
from graphwatch.operators.analyze import analyze_spectra, calibrate
from graphwatch.operators.baseline import feedback_alpha
from graphwatch.operators.signals import embedding_outliers
from graphwatch.operators.subgraph import dot_text, induced_edges, window_logs
from graphwatch.operators.windows import count_windows, quarter_windows, range_filter, time_windows
from graphwatch.plans import scenarios as sc
from graphwatch.session import scratch_path
from graphwatch.sources import lines as L
from graphwatch.sources import structured as S
from graphwatch.sources.registry import load_edges
from graphwatch.sources.tables import edges_from_rows, event_log_line

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- edges / windows

@query("edges_events")
def edges_events(spark, sf):
    e = sc.event_edges(spark, sf)
    return e.select("seq", "src", "dst", r6("weight").alias("weight"), "timestamp", "raw")


@query("edges_orders")
def edges_orders(spark, sf):
    e = sc.order_edges(spark, sf)
    return e.select("seq", "src", "dst", r6("weight").alias("weight"))


@query("count_windows")
def q_count_windows(spark, sf):
    w = count_windows(sc.event_edges(spark, sf), 200)
    return w.select("seq", "rank", "window_no")


@query("quarter_windows")
def q_quarter_windows(spark, sf):
    w = quarter_windows(sc.event_edges(spark, sf))
    return w.select("seq", "window_no", "window_size")


@query("time_windows")
def q_time_windows(spark, sf):
    w = time_windows(sc.event_edges(spark, sf), seconds=3600)
    return (w.groupBy("window_no", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"))
            .agg(F.count(F.lit(1)).alias("m"), F.min("seq").alias("first_seq")))


@query("range_filter")
def q_range_filter(spark, sf):
    e = range_filter(sc.event_edges(spark, sf), start="05/Jan/2024", end="20/Jan/2024")
    return e.select("seq", "timestamp")


@query("range_filter_event_time")
def q_range_filter_event_time(spark, sf):
    e = range_filter(sc.event_edges(spark, sf), start="2024-01-05 00:00:00",
                     end="2024-01-20 00:00:00", mode="event_time")
    return e.select("seq", "timestamp")


# ---------------------------------------------------------------- graph tables

def _adj(spark, sf, weight="value", beacon=False):
    return G.adjacency(sc.event_windows(spark, sf, 200, weight, beacon), colocate=True)


@query("adjacency")
def q_adjacency(spark, sf):
    return _adj(spark, sf).select("window_no", "src", "dst", r6("weight").alias("weight"), "cnt")


@query("node_index")
def q_node_index(spark, sf):
    return G.node_index(_adj(spark, sf)).select("window_no", "node", "idx")


@query("degrees")
def q_degrees(spark, sf):
    return G.degrees(_adj(spark, sf)).select("window_no", "node", r6("degree").alias("degree"))


@query("symmetrized")
def q_symmetrized(spark, sf):
    return G.symmetrize(_adj(spark, sf)).select("window_no", "src", "dst",
                                                r6("weight").alias("weight"))


@query("laplacian_entries")
def q_laplacian(spark, sf):
    return G.laplacian_entries(_adj(spark, sf)).select("window_no", "i", "j",
                                                       r6("value").alias("value"))


@query("components")
def q_components(spark, sf):
    comps = G.components(_adj(spark, sf, "unit", True), pairs_bound=200)
    return comps.select("window_no", "node", "component")


@query("components_propagation")
def q_components_propagation(spark, sf):
    comps = G.propagate_components(_adj(spark, sf, "unit", True))
    return comps.select("window_no", "node", "component")


@query("component_counts")
def q_component_counts(spark, sf):
    comps = G.components(_adj(spark, sf, "unit", True), pairs_bound=200)
    return G.component_counts(comps).select("window_no", "n_components", "largest")


# ---------------------------------------------------------------- spectrum, baseline, signals

def _windows(spark, sf, weight="value", beacon=False, adaptive=False, delta=0.2):
    _, _, spec = sc.event_spectra(spark, sf, 200, weight, beacon)
    return analyze_spectra(spec, warmup=12, delta=delta, adaptive=adaptive)


@query("window_lambda2")
def q_window_lambda2(spark, sf):
    _, _, spec = sc.event_spectra(spark, sf, 200, "value", False)
    return spec.select("window_no", "n", "m", r6("lambda2").alias("lambda2"))


@query("multiplicity")
def q_multiplicity(spark, sf):
    _, _, spec = sc.event_spectra(spark, sf, 200, "unit", True)
    return spec.select("window_no", "n", "mult")


@query("baseline_fixed")
def q_baseline_fixed(spark, sf):
    w = _windows(spark, sf, "value")
    return (w.filter(F.col("status") != "baseline")
            .select("window_no", r6("baseline_lambda2").alias("baseline_lambda2"), "baseline_mult"))


@query("baseline_adaptive")
def q_baseline_adaptive(spark, sf):
    w = _windows(spark, sf, "value", adaptive=True)
    return (w.filter(F.col("status") != "baseline")
            .select("window_no", r6("lambda2").alias("lambda2"),
                    r6("baseline_lambda2").alias("baseline_lambda2"), "baseline_mult"))


@query("fiedler_signal")
def q_fiedler_signal(spark, sf):
    w = _windows(spark, sf, "value")
    return (w.filter(F.col("status") != "baseline")
            .select("window_no", r6("lambda2").alias("lambda2"),
                    F.col("fiedler.fired").alias("fired"), r6("fiedler.score").alias("score")))


@query("mult_signal")
def q_mult_signal(spark, sf):
    w = _windows(spark, sf, "unit", True)
    return (w.filter(F.col("status") != "baseline")
            .select("window_no", "mult", "baseline_mult", F.col("mult_sig.fired").alias("fired"),
                    F.col("mult_sig.score").alias("score")))


@query("attack_anomalies")
def q_attack_anomalies(spark, sf):
    w = _windows(spark, sf, "unit", True)
    return w.select("window_no", r6("lambda2").alias("lambda2"), "mult", "status")


@query("analyze")
def q_analyze(spark, sf):
    w = _windows(spark, sf, "value", True)
    return w.select("window_no", "n", "m", r6("lambda2").alias("lambda2"), "mult", "status",
                    "votes", F.col("cluster.fired").alias("cluster_fired"), "outliers",
                    "sub_nodes")


@query("calibrate")
def q_calibrate(spark, sf):
    _, _, spec = sc.event_spectra(spark, sf, 200, "unit", True)
    cal = calibrate(spec)
    return cal.select("delta", "windows", "fiedler_fired", "mult_fired",
                      r6("lambda2_min").alias("lambda2_min"), r6("lambda2_max").alias("lambda2_max"))


@query("embedding_outliers")
def q_embedding_outliers(spark, sf):
    emb = sc.table(spark, sf, "embeddings")
    out = embedding_outliers(emb, ["label"], "embedding", "vec_id")
    return out.select("label", "vec_id", r6("distance").alias("distance"),
                      r6("threshold").alias("threshold"))


@query("feedback_alpha")
def q_feedback_alpha(spark, sf):
    lab = sc.table(spark, sf, "labels").withColumn(
        "feedback", F.when(F.col("quality") == 1, "true_positive").otherwise("false_positive"))
    return feedback_alpha(lab, order="doc_id", label="feedback", key=None)


# ---------------------------------------------------------------- sources / parsers


@query("parse_access_log")
def q_parse_access_log(spark, sf):
    e = L.parse_access_log(sc.access_log_lines(spark, sf))
    return e.select("seq", "src", "dst", "weight", "timestamp")


@query("parse_flow_log")
def q_parse_flow_log(spark, sf):
    e = L.parse_flow_log(sc.flow_log_lines(spark, sf))
    return e.select("seq", "src", "dst", r6("weight").alias("weight"))


@query("parse_syslog")
def q_parse_syslog(spark, sf):
    return L.parse_syslog(sc.syslog_lines(spark, sf)).select("seq", "src", "dst")


@query("parse_edge_ndjson")
def q_parse_edge_ndjson(spark, sf):
    e = S.parse_edge_ndjson(sc.edge_json_lines(spark, sf))
    return e.select("seq", "src", "dst", r6("weight").alias("weight"))


@query("parse_socket_trace")
def q_parse_socket_trace(spark, sf):
    e = S.parse_socket_trace(sc.socket_json_lines(spark, sf))
    return e.select("seq", "src", "dst", r6("weight").alias("weight"))


@query("parse_arrow_lines")
def q_parse_arrow_lines(spark, sf):
    return L.parse_arrow_lines(sc.arrow_lines(spark, sf)).select("seq", "src", "dst")


@query("parse_network_snapshot")
def q_parse_network_snapshot(spark, sf):
    e = S.parse_network_snapshot(sc.network_snapshot_docs(spark, sf))
    return e.select("src", "dst", r6("weight").alias("weight"))


@query("page_first_segment")
def q_page_first_segment(spark, sf):
    pages = sc.table(spark, sf, "pages")
    path = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+(/.*)?$", 1)
    return pages.select("page_id", first_path_segment(path).alias("segment"))


# ---------------------------------------------------------------- text functions, diagnosis, mitigation


@query("redact_documents")
def q_redact_documents(spark, sf):
    docs = sc.table(spark, sf, "documents")
    return docs.select("doc_id", redact(F.col("text")).alias("text"))


@query("redaction_report")
def q_redaction_report(spark, sf):
    return redaction_report(sc.table(spark, sf, "documents"), "text", "doc_id")


@query("redact_event_lines")
def q_redact_event_lines(spark, sf):
    return sc.secret_lines(spark, sf).select("seq", redact(F.col("value")).alias("text"))


def _windowed_plain(spark, sf):
    return sc.event_windows(spark, sf, 200, "value", False)


@query("window_logs30")
def q_window_logs30(spark, sf):
    win = _windowed_plain(spark, sf)
    logs = window_logs(win, win.select("source_id", "window_no").distinct())
    return logs.select("window_no", F.posexplode("logs").alias("line_no", "raw"))


def degree_top(adj, k=8):
    """Subgraph nodes ranked by weighted degree (a score SQL can reproduce)."""
    deg = G.degrees(adj)
    w = Window.partitionBy("source_id", "window_no").orderBy(F.desc(F.round("degree", 9)), "node")
    return deg.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


@query("subgraph_nodes")
def q_subgraph_nodes(spark, sf):
    top = degree_top(G.adjacency(_windowed_plain(spark, sf)))
    return top.select("window_no", "pos", "node")


@query("subgraph_edges")
def q_subgraph_edges(spark, sf):
    adj = G.adjacency(_windowed_plain(spark, sf))
    e = induced_edges(adj, degree_top(adj))
    return e.select("window_no", "src", "dst", r6("weight").alias("weight"))


def _degree_windows(spark, sf):
    win = _windowed_plain(spark, sf)
    adj = G.adjacency(win)
    top = degree_top(adj)
    nodes = (top.groupBy("source_id", "window_no")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("_n"))
             .select("source_id", "window_no", F.transform("_n", lambda s: s["node"]).alias("nodes")))
    edges = (induced_edges(adj, top).groupBy("source_id", "window_no")
             .agg(F.array_sort(F.collect_list(F.struct("src", "dst", "weight"))).alias("edges")))
    logs = window_logs(win, nodes)
    return nodes.join(edges, ["source_id", "window_no"], "left").join(logs, ["source_id", "window_no"], "left")


@query("dot_text")
def q_dot_text(spark, sf):
    w = _degree_windows(spark, sf)
    return w.select("window_no", dot_text(F.col("nodes"), F.col("edges"),
                                          F.slice("nodes", 1, 3)).alias("dot"))


@query("diagnosis")
def q_diagnosis(spark, sf):
    w = _degree_windows(spark, sf).withColumn("votes", F.lit(2))
    d = diagnose(w)
    return d.select("window_no", "top_target", "top_hits", "distinct_targets",
                    F.col("diagnosis.diagnosis").alias("diagnosis"),
                    F.col("diagnosis.root_cause").alias("root_cause"),
                    F.col("diagnosis.confidence.total").alias("confidence"),
                    F.col("diagnosis.mitigation.script").alias("script"))


@query("validate_mitigations")
def q_validate_mitigations(spark, sf):
    m = M.validate_mitigations(sc.mitigation_scripts(spark, sf))
    return m.select("c_custkey", "kind", F.col("validation.valid").alias("valid"),
                    F.col("validation.reason").alias("reason"))


@query("mitigation_rejections")
def q_mitigation_rejections(spark, sf):
    return M.rejection_counts(M.validate_mitigations(sc.mitigation_scripts(spark, sf)))


@query("parse_responses")
def q_parse_responses(spark, sf):
    r = sc.model_responses(spark, sf)
    p = parse_response(F.col("text"))
    return r.select("conv_id", "turn", p["parsed"].alias("parsed"), p["diagnosis"].alias("diagnosis"),
                    p["root_cause"].alias("root_cause"), p["total"].alias("total"))


# ---------------------------------------------------------------- window-table outputs, sinks, jobs


def _attack(spark, sf):
    return _windows(spark, sf, "unit", True)


@query("running_anomalies")
def q_running_anomalies(spark, sf):
    return A.running_anomalies(_attack(spark, sf)).select("window_no", "status", "anomalies_so_far")


@query("latest_anomaly")
def q_latest_anomaly(spark, sf):
    return J.latest_anomaly(_attack(spark, sf)).select("window_no", r6("lambda2").alias("lambda2"),
                                                       "mult")


@query("snapshot_changes")
def q_snapshot_changes(spark, sf):
    return A.snapshot_changes(_attack(spark, sf), ("status", "mult")).select("window_no", "status", "mult")


@query("run_summary")
def q_run_summary(spark, sf):
    s = A.run_summary(_attack(spark, sf))
    return s.select("windows", "anomalies", "anomaly", "multiplicity", r6("lambda2").alias("lambda2"),
                    "note")


@query("window_summary")
def q_window_summary(spark, sf):
    return A.window_summary(_attack(spark, sf)).select("window", "n", "m", "lambda2", "status")


def _attack_result(spark, sf):
    win = sc.event_windows(spark, sf, 200, "unit", True)
    adj = G.adjacency(win)
    from graphwatch.operators.spectrum import spectrum as _spectrum
    windows = analyze_spectra(_spectrum(adj, pairs_bound=200), warmup=12)
    from graphwatch.operators.subgraph import anomaly_details
    details = diagnose(anomaly_details(windows, adj, win))
    details = M.validate_mitigations(details.withColumn("_k", F.col("diagnosis.mitigation.type"))
                                     .withColumn("_s", F.col("diagnosis.mitigation.script")), "_k", "_s")
    return windows, details


@query("anomaly_events")
def q_anomaly_events(spark, sf):
    _, details = _attack_result(spark, sf)
    ev = K.anomaly_events(details)
    return ev.select("anomaly_id", "window_no", "nodes", "validated",
                     F.col("diagnosis.diagnosis").alias("diagnosis"), "dot", F.size("logs").alias("logs"))


@query("stix_bundle")
def q_stix_bundle(spark, sf):
    _, details = _attack_result(spark, sf)
    return K.stix_bundles(K.anomaly_events(details), latest_only=True).select("anomaly_id", "bundle")


@query("audit_rows")
def q_audit_rows(spark, sf):
    _, details = _attack_result(spark, sf)
    return K.audit_rows(K.anomaly_events(details)).select("type", "anomaly_id", "window_no", "day")


@query("report_lines")
def q_report_lines(spark, sf):
    windows, details = _attack_result(spark, sf)
    return K.run_report(windows, details).select("window_no", "part", "line")


@query("anomaly_prompts")
def q_anomaly_prompts(spark, sf):
    _, details = _attack_result(spark, sf)
    return details.select("window_no", build_prompt(F.col("dot"), F.col("redacted_logs"),
                                                    F.col("votes") / 3.0).alias("prompt"))


@query("diagnose_posted_edges")
def q_diagnose_posted_edges(spark, sf):
    li = sc.table(spark, sf, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"),
        F.col("l_quantity").alias("weight"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"))
    edges = edges_from_rows(li, order=["ord"], source_id="posted")
    summary, events, windows = J.diagnose(edges)
    return windows.select("window", "n", "m", "lambda2", "status")


@query("read_edge_csv")
def q_read_edge_csv(spark, sf):
    path = scratch_path(spark, "csv")
    cu = sc.table(spark, sf, "customer")
    (cu.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"),
               F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"),
               F.col("c_acctbal").alias("weight"))
     .write.option("header", True).csv(path))
    e = S.read_edge_csv(spark, path)
    return e.select("src", "dst", r6("weight").alias("weight"))


@query("load_edges_multi")
def q_load_edges_multi(spark, sf):
    ev = sc.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    grp = F.col("event_type").isin("view", "click")
    dirs = []
    for i, cond in enumerate((grp, ~grp)):
        d = scratch_path(spark, f"logs{i}")
        (ev.filter(cond).repartitionByRange(4, "ts", "event_id").sortWithinPartitions("ts", "event_id")
         .select(event_log_line(ev).alias("value")).write.text(d))
        dirs.append(d)
    edges = load_edges(spark, ["nginx:" + dirs[0], dirs[1]])
    w = count_windows(edges, 200)
    return w.select("rank", "window_no", "src", "dst", "timestamp")


@query("read_packet_capture")
def q_read_packet_capture(spark, sf):
    path = sc.write_captures(spark, sf)
    e = S.read_packet_capture(spark, path)
    return e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("packets"))


# ---------------------------------------------------------------- streaming

def _write_rolled_logs(spark, sf, files=8):
    """Access-log text of ``events`` as rolled files (name order = time order)."""
    ev = sc.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    d = scratch_path(spark, "rolled")
    (ev.repartitionByRange(files, "ts", "event_id").sortWithinPartitions("ts", "event_id")
     .select(event_log_line(ev).alias("value")).write.text(d))
    return d


@query("stream_windows")
def q_stream_windows(spark, sf):
    from graphwatch.streaming.live import run_stream
    folder = _write_rolled_logs(spark, sf)
    out = scratch_path(spark, "live")
    q = run_stream(spark, folder, out, window_size=200, warmup=12)
    q.awaitTermination()
    w = spark.read.parquet(f"{out}/windows")
    return w.select("window_no", "n", "m", r6("lambda2").alias("lambda2"))


@query("stream_event_time")
def q_stream_event_time(spark, sf):
    from graphwatch.streaming.live import run_event_time_stream
    folder = _write_rolled_logs(spark, sf)
    out = scratch_path(spark, "live-et")
    q = run_event_time_stream(spark, folder, out, seconds=3600, lateness="0 seconds")
    q.awaitTermination()
    s = spark.read.parquet(f"{out}/spectra")
    return s.select("window_no", "n", "m")


@query("window_feed")
def q_window_feed(spark, sf):
    return K.window_feed(_attack(spark, sf)).select("window", "n", "m", "lambda2", "mult", "status", "live")


@query("anomaly_feed")
def q_anomaly_feed(spark, sf):
    _, details = _attack_result(spark, sf)
    return K.anomaly_feed(K.anomaly_events(details))


@query("mitigation_lookup")
def q_mitigation_lookup(spark, sf):
    _, details = _attack_result(spark, sf)
    store = K.mitigation_store(K.anomaly_events(details))
    # every window id is asked for; only anomalous windows have a stored mitigation
    ids = _attack(spark, sf).select(F.concat_ws("-", "source_id", F.col("window_no").cast("string"))
                                    .alias("anomaly_id"))
    return K.lookup_mitigation(store, ids).select("anomaly_id", "found", "type", "validated")


@query("fiedler_suspects")
def q_fiedler_suspects(spark, sf):
    from graphwatch.operators.spectrum import fiedler_suspects
    s = fiedler_suspects(_adj(spark, sf, "value"), pairs_bound=200)
    return s.select("window_no", "node", r6("fiedler").alias("fiedler"))
