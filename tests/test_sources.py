"""Parsers and readers (facts pinned by the reference's source tests)."""

from __future__ import annotations

import json
import os
import struct

from pyspark.sql import functions as F

from graphwatch.operators.graph import adjacency
from graphwatch.sources import lines as L
from graphwatch.sources import structured as S
from graphwatch.sources.registry import load_edges, resolve

LINE = '10.0.0.6 - - [05/Oct/2026:10:00:02 +0000] "GET /api/v1/health HTTP/1.1" 200 3437 "-" "curl/7.81"'


def _df(spark, lines):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq long, value string")


def test_access_log_line(spark):
    r = L.parse_access_log(_df(spark, [LINE])).first()
    assert (r.src, r.dst, r.weight, r.raw) == ("10.0.0.6", "api", 1.0, LINE)
    assert r.timestamp == "05/Oct/2026:10:00:02 +0000" and r.ts is not None


def test_access_log_garbage_and_segments(spark):
    lines = ["garbage line", LINE.replace("/api/v1/health", "/"), LINE.replace("/api/v1/health", "/?q=1"),
             LINE.replace("/api/v1/health", "http://h/x")]
    got = [r.dst for r in L.parse_access_log(_df(spark, lines)).orderBy("seq").collect()]
    assert got == ["/", "?q=1", "http:"]


def test_csv_duplicates_sum(spark, tmp_dir):
    p = os.path.join(tmp_dir, "e.csv")
    with open(p, "w") as fh:
        fh.write("src,dst,weight\na,b,2\na,b,3\n")
    e = S.read_edge_csv(spark, p).withColumn("window_no", F.lit(0))
    rows = adjacency(e).collect()
    assert len(rows) == 1 and rows[0].weight == 5.0


def test_ndjson_skips_bad(spark):
    lines = ['{"src": "a", "dst": "b", "weight": 2}', "not json", '{"src": "a"}', "", '["a","b"]',
             '{"src": "a", "dst": "b"} trailing']
    rows = S.parse_edge_ndjson(_df(spark, lines)).collect()
    assert [(r.src, r.dst, r.weight) for r in rows] == [("a", "b", 2.0)]


def test_ndjson_weight_that_is_no_number(spark):
    for weight in ('"abc"', "null"):
        lines = _df(spark, ['{"src": "a", "dst": "b", "weight": %s}' % weight])
        try:
            S.parse_edge_ndjson(lines).collect()
        except Exception as e:  # noqa: BLE001 - the job fails with the line in its message
            assert "weight is not a number" in str(e)
        else:
            raise AssertionError("bad weight accepted")
        assert not S.parse_edge_ndjson(lines, keep_rejects=True).first().parsed_ok


def test_white_space_at_line_ends(spark):
    flow = "\t2 123 eni-1 10.0.0.1 10.0.0.2 443 5555 6 12 999 1 2 ACCEPT OK\t"
    assert L.parse_flow_log(_df(spark, [flow])).first().src == "10.0.0.1"
    row = L.parse_arrow_lines(_df(spark, ["\ta\t->\tb\t"])).first()
    assert (row.src, row.dst) == ("a", "b")


def test_network_snapshot_types_and_order(spark):
    flows = [{"src": 5, "dst": "b"}, {"src": "a", "dst": "b", "weight": "2"}, {"src": "a", "dst": "c", "weight": "x"}]
    docs = spark.createDataFrame([(2 ** 37, json.dumps({"flows": flows}))], "seq long, value string")
    rows = S.parse_network_snapshot(docs).orderBy("part", "pos", "seq").collect()
    assert [(r.src, r.dst, r.weight, r.seq) for r in rows] == [("a", "b", 2.0, 1), ("a", "c", 1.0, 2)]


def test_socket_trace_keys_and_weights(spark):
    lines = [json.dumps({"saddr": "1.1.1.1", "daddr": "2.2.2.2", "bytes": 10}),
             json.dumps({"src": "a", "dst": "b", "weight": "x"}),
             json.dumps({"src": None, "saddr": "1.1.1.1", "dst": "b"}),
             json.dumps({"src": "a", "dst": "b", "weight": True})]
    rows = S.parse_socket_trace(_df(spark, lines)).orderBy("seq").collect()
    assert [(r.src, r.dst, r.weight) for r in rows] == [("1.1.1.1", "2.2.2.2", 10.0), ("a", "b", 1.0),
                                                       ("a", "b", 1.0)]


def test_flow_log(spark):
    ok = "2 123 eni-1 10.0.0.1 10.0.0.2 443 5555 6 12 999 1 2 ACCEPT OK"
    lines = [ok, ok.replace(" 12 ", " - "), "3 " + ok[2:], ok.replace("10.0.0.1", "-"), "2 a b c"]
    rows = L.parse_flow_log(_df(spark, lines)).orderBy("seq").collect()
    assert [(r.src, r.dst, r.weight) for r in rows] == [("10.0.0.1", "10.0.0.2", 12.0),
                                                       ("10.0.0.1", "10.0.0.2", 1.0)]


def test_syslog_forms(spark):
    lines = ["x src=h1 dst=h2 y", "a 10.0.0.1:5 -> 10.0.0.2:6 b", "from 10.0.0.3 to 10.0.0.4",
             "only 10.0.0.9"]
    rows = L.parse_syslog(_df(spark, lines)).orderBy("seq").collect()
    assert [(r.src, r.dst) for r in rows] == [("h1", "h2"), ("10.0.0.1", "10.0.0.2"), ("10.0.0.3", "10.0.0.4")]


def test_arrow_lines(spark):
    rows = L.parse_arrow_lines(_df(spark, [" a -> b -> c ", "x ->", "none"])).collect()
    assert [(r.src, r.dst) for r in rows] == [("a", "b -> c")]


def test_network_snapshot(spark):
    docs = [json.dumps({"Name": "net1", "Containers": {"id1": {"Name": "web"}, "id2": {"Name": ""}}}),
            json.dumps([{"flows": [{"src": "a", "dst": "b", "weight": 3}, {"src": "", "dst": "x"}]},
                        {"Containers": {"id3": {"Name": "db"}}}])]
    rows = S.parse_network_snapshot(_df(spark, docs)).collect()
    assert sorted((r.src, r.dst, r.weight) for r in rows) == [
        ("a", "b", 3.0), ("db", "bridge", 1.0), ("id2", "net1", 1.0), ("web", "net1", 1.0)]


def _pcap(path, order="<"):
    hdr = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    ip = bytes([0x45, 0]) + struct.pack("!HHHBBH", 40, 1, 0, 64, 6, 0) + bytes([1, 2, 3, 4, 5, 6, 7, 8])
    frame = b"\x00" * 12 + struct.pack("!H", 0x0800) + ip + b"\x00" * 20
    arp = b"\x00" * 12 + struct.pack("!H", 0x0806) + ip + b"\x00" * 20
    recs = [struct.pack(order + "IIII", 0, 0, len(f), len(f)) + f for f in (frame, arp, frame[:20])]
    with open(path, "wb") as fh:
        fh.write(hdr + b"".join(recs))


def test_packet_capture_both_byte_orders(spark, tmp_dir):
    _pcap(os.path.join(tmp_dir, "a.pcap"), "<")
    _pcap(os.path.join(tmp_dir, "b.pcap"), ">")
    rows = S.read_packet_capture(spark, tmp_dir).collect()
    assert sorted((r.src, r.dst) for r in rows) == [("1.2.3.4", "5.6.7.8")] * 2


def test_packet_capture_in_pieces_equals_whole(spark, tmp_dir, monkeypatch):
    """Records, and the file header, that lie across pieces; a last frame that is cut; a file named twice."""
    a = os.path.join(tmp_dir, "a.pcap")
    _pcap(a, ">")
    with open(a, "rb") as fh:
        blob = fh.read()
    frame = blob[24:24 + 16 + 54]
    with open(a, "wb") as fh:
        fh.write(blob + frame * 40 + frame[:16 + 40])
    for piece in (1 << 22, 7, 50):
        monkeypatch.setattr(S, "PIECE", piece)
        rows = S.read_packet_capture(spark, [a, a]).collect()
        assert sorted((r.seq, r.src, r.dst) for r in rows) == sorted(
            (k, "1.2.3.4", "5.6.7.8") for k in (0, *range(3, 44)) for _ in range(2))


def test_captures_are_written_in_bounded_files(spark, tmp_dir, monkeypatch):
    """No file, and so no task, holds a whole group of packets."""
    from graphwatch.plans import scenarios

    monkeypatch.setattr(scenarios, "CAPTURE_PACKETS", 50)
    rows = [(k // 3, k % 7, k * 40 % 70000, k % 300) for k in range(3000)] + [(7, 1, 5, 5)] * 400
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long") \
        .write.parquet(os.path.join(tmp_dir, "lineitem.parquet"))
    folder = scenarios.write_captures(spark, tmp_dir)
    folder = folder[5:] if folder.startswith("file:") else folder
    assert max(os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder)) <= 24 + 50 * 70
    got = sorted((r.src, r.dst) for r in S.read_packet_capture(spark, folder).collect())
    assert got == sorted((f"10.1.{p // 256 % 256}.{p % 256}", f"10.2.{s // 256 % 256}.{s % 256}")
                         for _, ln, p, s in rows if ln not in (3, 4))


def test_registry_prefix_and_order(spark, tmp_dir):
    a, b = os.path.join(tmp_dir, "a.log"), os.path.join(tmp_dir, "b.txt")
    with open(a, "w") as fh:
        fh.write(LINE + "\n")
    with open(b, "w") as fh:
        fh.write("x -> y\n")
    assert resolve(spark, "nginx:" + a)[0] == "nginx"
    e = load_edges(spark, ["nginx:" + a, "arrow:" + b])
    got = [(r.src, r.dst) for r in e.orderBy("part", "pos", "seq").collect()]
    assert got == [("10.0.0.6", "api"), ("x", "y")]
    try:
        resolve(spark, "nosuch:" + a)
    except ValueError:
        pass
    else:
        raise AssertionError("unknown prefix accepted")


def test_quarantine_stream(spark, tmp_dir):
    from graphwatch.streaming.live import run_quarantine_stream

    inp = os.path.join(tmp_dir, "in")
    os.makedirs(inp)
    with open(os.path.join(inp, "a.log"), "w") as fh:
        fh.write("\n".join([LINE, "garbage one", LINE, "garbage two"]) + "\n")
    q = run_quarantine_stream(spark, inp, os.path.join(tmp_dir, "bad"))
    q.awaitTermination(300)
    got = sorted((r.line, r.raw) for r in spark.read.parquet(os.path.join(tmp_dir, "bad")).collect())
    assert got == [(1, "garbage one"), (3, "garbage two")]
