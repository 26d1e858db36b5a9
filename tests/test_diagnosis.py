"""Redaction, response parsing, rule-based diagnosis, prompt text, DOT."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphwatch.functions.diagnosis import build_prompt, diagnose, parse_response
from graphwatch.functions.redact import redact
from graphwatch.functions.text import fmt_g
from graphwatch.operators.subgraph import dot_text


def test_redaction_order(spark):
    df = spark.createDataFrame([("from 10.1.2.3 mail a.b@ex.com Authorization: Bearer abc.def api_key=zz9",)], "t string")
    out = df.select(redact(F.col("t")).alias("r")).first().r
    assert out == "from [REDACTED-IP] mail [REDACTED-EMAIL] Authorization: [REDACTED-SECRET] [REDACTED-SECRET]"


def test_parse_fenced_and_plain(spark):
    df = spark.createDataFrame([('```json\n{"diagnosis": "x", "confidence": {"total": 0.9}}\n```',),
                                ("just text  ",), ('{"diagnosis": "y"} extra',)], "t string")
    rows = df.select(parse_response(F.col("t")).alias("p")).collect()
    assert rows[0].p.parsed and rows[0].p.diagnosis == "x" and rows[0].p.total == 0.9
    assert not rows[1].p.parsed and rows[1].p.diagnosis == "just text" and rows[1].p.total == 0.0
    assert not rows[2].p.parsed


def test_heuristic_rules(spark):
    beacon = ['1.1.1.1 - - [x] "GET /c2/beacon HTTP/1.1" 200 1'] * 4
    many = ['"GET /a', '"GET /b', '"GET /a']
    df = spark.createDataFrame([(beacon, ["h1", "c2"], 3), (many, ["a", "b", "c", "d", "e"], 2),
                                (many, ["a"], 2)], "logs array<string>, nodes array<string>, votes int")
    rows = diagnose(df).orderBy(F.size("nodes")).collect()
    texts = [r.diagnosis.diagnosis for r in rows]
    assert "beacon-like" in texts[1] and "/c2/beacon (4 hits)" in texts[1]
    assert "dense subgraph" in texts[0]
    assert "a fans out to 4 peers" in texts[2]
    assert rows[1].diagnosis.confidence.total == 0.8 and rows[2].top_target == "/a"


def test_fmt_g(spark):
    vals = [1.5, 100.0, 1234567.0, 0.0001234, 2.0, 0.5, 123456.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r.g for r in df.select(fmt_g(F.col("v")).alias("g")).collect()]
    assert got == ["%g" % v for v in vals]


def test_dot_and_prompt(spark):
    df = spark.createDataFrame([(["a", "b"], [("a", "b", 2.0)], ["a"])],
                               "nodes array<string>, edges array<struct<src:string,dst:string,weight:double>>, an array<string>")
    dot = df.select(dot_text(F.col("nodes"), F.col("edges"), F.col("an")).alias("d")).first().d
    assert dot.startswith("digraph") and '"a" -> "b" [label="2"' in dot and dot.endswith("}\n")
    p = df.select(build_prompt(F.lit(dot), F.array(F.lit("l1")), F.lit(2 / 3)).alias("p")).first().p
    assert "0.67" in p and "l1" in p and "digraph" in p


def test_elapsed_stamp(spark):
    from graphwatch.functions.text import elapsed_stamp

    df = spark.createDataFrame([(i,) for i in (0, 1, 11, 12, 25)], "w long")
    got = [r.s for r in df.select(elapsed_stamp(F.col("w"), 5).alias("s")).collect()]
    assert got == [f"{w * 5 // 60:02d}:{w * 5 % 60:02d}" for w in (0, 1, 11, 12, 25)]
    fast = [r.s for r in df.select(elapsed_stamp(F.col("w"), 5, speed=2.0).alias("s")).collect()]
    assert fast == [f"{w * 5 / 2.0 / 60:02.0f}:{w * 5 / 2.0 % 60:02.0f}" for w in (0, 1, 11, 12, 25)]
