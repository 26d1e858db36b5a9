"""Graphs derived from the driver tables for queries, tests and the benchmark.

The tables hold no logs, so the graph of ``events`` (``u<user_id> ->
event_type``) is the default stream, and a *beacon* variant rewires part
of it into a disjoint component so that anomalies exist deterministically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwatch.operators.graph import adjacency
from graphwatch.operators.spectrum import spectrum
from graphwatch.operators.windows import count_windows
from graphwatch.sources.tables import edges_from_events, edges_from_orders

# Fixed values of the beacon scenario.
BEACON_FROM_WINDOW = 12      # first window that may carry the beacon
BEACON_EVERY = 5             # every 5th window from there
BEACON_USER_MOD = 3          # users with id % 3 == 0 talk to the beacon endpoint
BEACON_ENDPOINT = "c2"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_edges(spark: SparkSession, sf_dir: str, weight: str = "value") -> DataFrame:
    return edges_from_events(table(spark, sf_dir, "events"), weight=weight)


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_from_orders(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


def inject_beacon(windowed: DataFrame) -> DataFrame:
    """Rewire, in windows >= 12 with ``window_no % 5 == 0``, the events of users with
    ``id % 3 == 0`` to ``h<id> -> c2`` (a component disjoint from the services)."""
    uid = F.substring("src", 2, 64).cast("long")
    hit = ((F.col("window_no") >= BEACON_FROM_WINDOW)
           & (F.col("window_no") % BEACON_EVERY == 0)
           & F.col("src").startswith("u") & (uid % BEACON_USER_MOD == 0))
    return (windowed.withColumn("_hit", hit)
            .withColumn("dst", F.when(F.col("_hit"), F.lit(BEACON_ENDPOINT)).otherwise(F.col("dst")))
            .withColumn("src", F.when(F.col("_hit"), F.concat(F.lit("h"), uid.cast("string")))
                        .otherwise(F.col("src")))
            .drop("_hit"))


def event_windows(spark: SparkSession, sf_dir: str, window_size: int = 200,
                  weight: str = "value", beacon: bool = False) -> DataFrame:
    """Count-windowed event edges, optionally with the beacon rewiring."""
    win = count_windows(event_edges(spark, sf_dir, weight), window_size)
    return inject_beacon(win) if beacon else win


def event_spectra(spark: SparkSession, sf_dir: str, window_size: int = 200,
                  weight: str = "value", beacon: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    win = event_windows(spark, sf_dir, window_size, weight, beacon)
    adj = adjacency(win, colocate=True)
    return win, adj, spectrum(adj, pairs_bound=window_size)


# ---------------------------------------------------------------- text renderings of the tables
# Each rendering mixes valid records with the malformed variants a parser must
# skip; the variant is picked from the row key.

def _ip(prefix: str, col: str):
    return F.format_string(prefix + ".%d.%d", F.expr(f"({col} div 256) % 256"), F.col(col) % 256)


def access_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    eid = F.col("event_id")
    path = (F.when(eid % 7 == 0, F.concat(F.lit("/?q="), eid.cast("string")))
            .when(eid % 11 == 0, F.lit("//"))
            .when(eid % 13 == 0, F.concat(F.lit("http://h/"), F.col("event_type")))
            .otherwise(F.format_string("/%s/%d", F.col("event_type"), eid)))
    method = F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET")
    line = F.when(eid % 17 == 0, F.concat(F.lit("malformed line "), eid.cast("string"))).otherwise(
        F.format_string('%s - - [%s] "%s %s HTTP/1.1" 200 512 "-" "gw-agent/1.0"',
                        _ip("10.0", "user_id"), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss Z"),
                        method, path))
    return ev.select(eid.alias("seq"), line.alias("value"))


def flow_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    ln = F.col("l_linenumber")
    start = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    fields = F.concat_ws(
        " ", F.when(ln == 7, "3").otherwise("2"), F.lit("123456789012"),
        F.format_string("eni-%d", F.col("l_orderkey") % 1000),
        F.when(F.col("l_orderkey") % 50 == 0, F.lit("-")).otherwise(_ip("10.1", "l_partkey")),
        _ip("10.2", "l_suppkey"), (40000 + ln).cast("string"), F.lit("443"), F.lit("6"),
        F.when(ln == 6, F.lit("-")).otherwise(F.col("l_quantity").cast("long").cast("string")),
        F.col("l_extendedprice").cast("long").cast("string"), start.cast("string"),
        (start + 60).cast("string"),
        F.when(ln == 5, F.lit(None)).otherwise(
            F.when(F.col("l_returnflag") == "R", "REJECT").otherwise("ACCEPT")),
        F.when(ln == 5, F.lit(None)).otherwise(F.lit("OK")))
    line = F.when(ln == 5, F.element_at(F.split(fields, " "), 1)).otherwise(fields)
    line = F.when(ln == 5, F.array_join(F.slice(F.split(fields, " "), 1, 11), " ")).otherwise(line)
    line = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("  "), line, F.lit(" "))).otherwise(line)
    return li.select((F.col("l_orderkey") * 8 + ln).alias("seq"), line.alias("value"))


def syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    a = _ip("10.0", "user_id")
    b = F.concat(F.lit("172.16.0."), F.length("event_type").cast("string"))
    v = eid % 4
    line = (F.when(v == 0, F.format_string("<34>host sshd: conn src=%s dst=%s proto=tcp", a, b))
            .when(v == 1, F.format_string("kernel: flow %s:22 -> %s:443 len=%d", a, b, eid))
            .when(v == 2, F.format_string("firewall: allowed from %s to %s port 80", a, b))
            .otherwise(F.format_string("note: only %s seen", a)))
    return ev.select(eid.alias("seq"), line.alias("value"))


def edge_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    eid, v = F.col("event_id"), F.col("event_id") % 10
    u = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    t = F.col("event_type")
    line = (F.when(v == 0, F.format_string('{"src": "%s", "dst": "%s"}', u, t))
            .when(v == 1, F.format_string('{"src": "%s", "dst": ', u))
            .when(v == 2, F.format_string('{"src": "%s"}', u))
            .when(v == 3, F.format_string('{"src": "%s", "dst": 7}', u))
            .when(v == 4, F.format_string('["%s", "%s"]', u, t))
            .when(v == 5, F.format_string('{"src": "", "dst": "%s"}', t))
            .when(v == 6, F.lit("   "))
            .otherwise(F.format_string('{"src": "%s", "dst": "%s", "weight": %.2f}', u, t,
                                       F.col("value"))))
    return ev.select(eid.alias("seq"), line.alias("value"))


def socket_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    eid, v = F.col("event_id"), F.col("event_id") % 6
    a = _ip("10.0", "user_id")
    b = F.concat(F.lit("172.16.0."), F.length("event_type").cast("string"))
    line = (F.when(v == 0, F.format_string('{"saddr": "%s", "daddr": "%s", "bytes": %d}', a, b, eid))
            .when(v == 1, F.format_string('{"src": "%s", "dst": "%s", "weight": %.2f}', a, b,
                                          F.col("value")))
            .when(v == 2, F.format_string('{"src": "%s", "daddr": "%s"}', a, b))
            .when(v == 3, F.format_string('{"saddr": "%s", "dst": "%s", "bytes": "n/a"}', a, b))
            .when(v == 4, F.format_string('{"src": %d, "dst": "%s"}', F.col("user_id"), b))
            .otherwise(F.format_string('{"src": null, "saddr": "%s", "dst": "%s"}', a, b)))
    return ev.select(eid.alias("seq"), line.alias("value"))


def arrow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    eid, v = F.col("event_id"), F.col("event_id") % 6
    u = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    t = F.col("event_type")
    line = (F.when(v == 0, F.concat(F.lit("no arrow here "), eid.cast("string")))
            .when(v == 1, F.concat(F.lit(" -> "), t))
            .when(v == 2, F.concat(u, F.lit(" ->   ")))
            .when(v == 3, F.concat(F.lit("  "), u, F.lit("  ->  "), t, F.lit("  ")))
            .otherwise(F.concat(u, F.lit(" -> "), t, F.lit(" -> extra"))))
    return ev.select(eid.alias("seq"), line.alias("value"))


def network_snapshot_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot document per region: region 0 lists flows, region 4 is an
    unnamed network inside a JSON array, the others list attached containers."""
    na = table(spark, sf_dir, "nation")
    rg = table(spark, sf_dir, "region")
    j = na.join(rg, na.n_regionkey == rg.r_regionkey)
    cname = F.when(F.col("n_nationkey") % 5 == 1, F.lit("")).otherwise(F.col("n_name"))
    flow = F.format_string('{"src": "%s", "dst": "%s", "weight": %d}',
                           F.col("n_name"), F.col("r_name"), F.col("n_nationkey"))
    member = F.format_string('"%d": {"Name": "%s"}', F.col("n_nationkey"), cname)
    per = (j.groupBy("r_regionkey", "r_name")
           .agg(F.array_sort(F.collect_list(F.struct("n_nationkey", flow.alias("f"),
                                                     member.alias("m")))).alias("items")))
    flows = F.array_join(F.transform("items", lambda s: s["f"]), ", ")
    members = F.array_join(F.transform("items", lambda s: s["m"]), ", ")
    doc = (F.when(F.col("r_regionkey") == 0,
                  F.format_string('{"Name": "%s", "flows": [%s]}', F.col("r_name"), flows))
           .when(F.col("r_regionkey") == 4, F.format_string('[{"Containers": {%s}}]', members))
           .otherwise(F.format_string('{"Name": "%s", "Containers": {%s}}', F.col("r_name"), members)))
    return per.select(F.col("r_regionkey").cast("long").alias("seq"), doc.alias("value"))


def secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with addresses, mail addresses and credentials, from ``events``."""
    ev = table(spark, sf_dir, "events")
    eid, v = F.col("event_id"), F.col("event_id") % 4
    a = _ip("10.0", "user_id")
    line = (F.when(v == 0, F.format_string("login u%d from %s mail u%d@example.com ok",
                                           F.col("user_id"), a, F.col("user_id")))
            .when(v == 1, F.format_string("GET /%s Authorization: Bearer tk%dZ.x-y/=", F.col("event_type"), eid))
            .when(v == 2, F.format_string("config API-KEY = s3cr%d end, peer %s", eid, a))
            .otherwise(F.format_string("plain %s event %d", F.col("event_type"), eid)))
    return ev.select(eid.alias("seq"), line.alias("value"))


def mitigation_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mitigation per customer, kind by key, with broken variants by key."""
    from graphwatch.functions import mitigation as M

    cu = table(spark, sf_dir, "customer")
    ck = F.col("c_custkey")
    kind = (F.when(ck % 23 == 0, F.lit("unknown")).when(ck % 4 == 0, "iptables")
            .when(ck % 4 == 1, "docker").when(ck % 4 == 2, "k8s").otherwise("nginx"))
    base_kind = F.when(ck % 4 == 0, "iptables").when(ck % 4 == 1, "docker") \
        .when(ck % 4 == 2, "k8s").otherwise("nginx")
    seg = F.lower(F.col("c_mktsegment"))
    target = (F.when(ck % 13 == 0, F.lit("<ATTACKER_IP>"))
              .when(ck % 4 == 0, _ip("10.9", "c_custkey")).when(ck % 4 == 1, F.col("c_name"))
              .when(ck % 4 == 2, seg).otherwise(F.concat(F.lit("/"), seg)))
    script = M.render(base_kind, target)
    script = (F.when(ck % 17 == 0, F.lit("iptables -F"))
              .when(ck % 19 == 0, F.lit(""))
              .when(ck % 29 == 0, F.lit("iptables -A INPUT -s 'a b' -j DROP"))
              .when(ck % 31 == 0, F.concat(script, F.lit("\niptables -A CUSTOM -s 1.2.3.4 -j DROP")))
              .otherwise(script))
    kind = F.when(ck % 29 == 0, F.lit("iptables")).otherwise(kind)
    return cu.select("c_custkey", kind.alias("kind"), script.alias("script"))


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies rendered from ``conversations``: fenced JSON, plain text, broken JSON."""
    cv = table(spark, sf_dir, "conversations")
    clean = F.regexp_replace("text", "[^a-zA-Z ]", "")
    obj = F.format_string('{"diagnosis": "%s", "root_cause": "r%d", "confidence": {"total": 0.5}}',
                          clean, F.col("turn"))
    v = F.col("conv_id") % 3
    text = (F.when((v == 0) & (F.col("turn") % 2 == 0), F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
            .when(v == 0, F.concat(F.lit("  ```\n"), obj, F.lit("\n```  ")))
            .when(v == 1, F.concat(F.lit("  "), clean, F.lit("  ")))
            .otherwise(F.concat(F.lit('{"diagnosis": "'), clean)))
    return cv.select("conv_id", "turn", text.alias("text"))


# Packets of a capture file, at most.
CAPTURE_PACKETS = 100_000


def _capture_bytes(pdf, order: str) -> bytes:
    """Records of line items in a byte order (``<`` or ``>``): an ARP frame for line 3, a
    frame cut after 20 bytes for line 4."""
    import numpy as np

    def put(at: int, kind: str, values) -> None:
        kind = np.dtype(kind)
        whole[:, at:at + kind.itemsize] = np.ascontiguousarray(values, dtype=kind).view(np.uint8).reshape(len(pdf), -1)

    if pdf[["l_orderkey", "l_partkey", "l_suppkey"]].isna().to_numpy().any():
        raise ValueError("a line item without its keys makes no packet")
    keys = {c: pdf[c].to_numpy(np.int64) for c in ("l_orderkey", "l_partkey", "l_suppkey")}
    line = pdf["l_linenumber"].to_numpy()
    cut = np.where(line == 4, 20, 54)
    whole = np.zeros((len(pdf), 16 + 54), np.uint8)
    put(0, order + "u4", keys["l_orderkey"])
    put(8, order + "u4", cut)
    put(12, order + "u4", cut)
    whole[:, 16:22], whole[:, 22:28] = 2, 4
    put(28, ">u2", np.where(line == 3, 0x0806, 0x0800))
    whole[:, 30] = 0x45
    put(32, ">u2", np.full(len(pdf), 40))
    put(34, ">u2", keys["l_orderkey"] % 65536)
    whole[:, 38], whole[:, 39] = 64, 6
    for at, net, key in ((42, 1, "l_partkey"), (46, 2, "l_suppkey")):
        whole[:, at], whole[:, at + 1] = 10, net
        put(at + 2, ">u2", keys[key] % 65536)
    return whole[np.arange(16 + 54) < (16 + cut)[:, None]].tobytes()


def _capture_writer(out_dir: str, most: int):
    import os
    import struct

    import pandas as pd
    from pyspark import TaskContext

    def run(batches):
        os.makedirs(out_dir, exist_ok=True)
        part, number, packets, group, fh = TaskContext.get().partitionId(), 0, 0, None, None
        for pdf in batches:
            # rows come sorted by group; a file ends with its group or when it is full
            for grp, rows in pdf.groupby("grp", sort=True, dropna=False):
                order = ">" if int(grp) == 7 else "<"
                while len(rows):
                    if fh is None or grp != group or packets >= most:
                        if fh is not None:
                            fh.close()
                        fh = open(os.path.join(out_dir, f"capture-{int(grp):02d}-{part:05d}-{number:05d}.pcap"), "wb")
                        fh.write(struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
                        group, packets, number = grp, 0, number + 1
                    now, rows = rows.iloc[:most - packets], rows.iloc[most - packets:]
                    fh.write(_capture_bytes(now, order))
                    packets += len(now)
            yield pd.DataFrame({"packets": [len(pdf)]})
        if fh is not None:
            fh.close()
    return run


def write_captures(spark: SparkSession, sf_dir: str, files: int = 8) -> str:
    """Write classic capture files built from ``lineitem`` (one packet per line item in
    ``files`` groups, ARP frames for line 3, truncated frames for line 4, group 7
    big-endian); returns the folder. A file has CAPTURE_PACKETS packets at most, as a
    capture tool that rotates its files would write, so their number follows the table
    and no task holds more than a batch of rows. Test-fixture writer: it needs a POSIX
    path visible to executors."""
    from graphwatch.session import scratch_path, ship_package

    ship_package(spark)
    out = scratch_path(spark, "pcap")
    local = out[5:] if out.startswith("file:") else out
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_orderkey") % files).alias("grp"))
    parts = files * max(1, -(-li.count() // (files * CAPTURE_PACKETS)))
    order = ["grp", "l_orderkey", "l_linenumber"]
    (li.repartitionByRange(parts, *order).sortWithinPartitions(*order)
     .mapInPandas(_capture_writer(local, CAPTURE_PACKETS), "packets long").agg(F.sum("packets")).collect())
    return out
