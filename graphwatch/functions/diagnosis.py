"""Rule-based diagnosis of anomalous windows, model-response parsing, prompt text.

All of it is column expressions over a table with one row per anomaly
(``nodes array<string>``, ``logs array<string>``, ``votes int``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwatch.functions.redact import redact_lines
from graphwatch.functions.text import REQUEST_TARGET_PATTERN, parse_json_strict

# Fixed values of the diagnosis rule.
BEACON_MIN_HITS = 3          # one request target with at least this many hits
FANOUT_MIN_NODES = 5         # otherwise: at least this many subgraph nodes
CONFIDENCE_SLOPE = 0.5       # confidence = clip(0.5 * strength + 0.3, 0, 1), 2 places
CONFIDENCE_BASE = 0.3
LOG_CONFIDENCE = 0.3
MITIGATION_KIND = "iptables"


def target_counts(logs: Column) -> Column:
    """``array<struct<target, hits, first>>`` of request targets in the lines, in first-seen order."""
    with_pos = F.transform(logs, lambda line, i: F.struct(
        F.regexp_extract(line, REQUEST_TARGET_PATTERN, 1).alias("target"),
        line.rlike(REQUEST_TARGET_PATTERN).alias("ok"), i.alias("pos")))
    hits = F.filter(with_pos, lambda s: s["ok"])
    distinct = F.array_distinct(F.transform(hits, lambda s: s["target"]))
    return F.transform(distinct, lambda t: F.struct(
        t.alias("target"),
        F.size(F.filter(hits, lambda s: s["target"] == t)).alias("hits"),
        F.array_position(F.transform(hits, lambda s: s["target"]), t).alias("first")))


def top_target(counts: Column) -> Column:
    """Most frequent target; ties go to the one seen first."""
    ranked = F.array_sort(counts, lambda a, b: F.when(a["hits"] != b["hits"], b["hits"] - a["hits"])
                          .otherwise(a["first"] - b["first"]).cast("int"))
    return F.get(ranked, F.lit(0))


def confidence(strength: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0),
                                                  F.lit(CONFIDENCE_SLOPE) * strength
                                                  + F.lit(CONFIDENCE_BASE))), 2)


def firewall_script(host: Column) -> Column:
    """Two append-only drop rules for one host (inbound from it, outbound to it)."""
    return F.format_string("iptables -A INPUT -s %s -j DROP\niptables -A OUTPUT -d %s -j DROP",
                           host, host)


def diagnose(df: DataFrame, nodes: str = "nodes", logs: str = "logs", votes: str = "votes",
             redact_first: bool = True) -> DataFrame:
    """Attach ``diagnosis struct`` (pattern text, root cause, confidence, mitigation).

    Rule: a single request target with at least 3 hits -> beaconing; else at
    least 5 subgraph nodes -> fan-out from the first node; else a dense
    subgraph. Logs are redacted first; node names are not.
    """
    lg = redact_lines(F.col(logs)) if redact_first else F.col(logs)
    counts = target_counts(F.coalesce(lg, F.array().cast("array<string>")))
    top = top_target(counts)
    n_targets = F.size(counts)
    top_name = F.coalesce(top["target"], F.lit("unknown"))
    top_hits = F.coalesce(top["hits"], F.lit(0))
    node_list = F.coalesce(F.col(nodes), F.array().cast("array<string>"))
    first = F.coalesce(F.get(node_list, F.lit(0)), F.lit("unknown"))
    strength = F.col(votes).cast("double") / 3.0
    pattern = (F.when((n_targets == 1) & (top_hits >= BEACON_MIN_HITS),
                      F.format_string("repeated requests to %s (%d hits), beacon-like", top_name, top_hits))
               .when(F.size(node_list) >= FANOUT_MIN_NODES,
                     F.format_string("%s fans out to %d peers", first, F.size(node_list) - 1))
               .otherwise(F.lit("unusually dense subgraph")))
    diag = F.struct(
        F.concat(F.lit("Rule-based finding: "), pattern, F.lit(".")).alias("diagnosis"),
        F.format_string("Likely origin: %s.", first).alias("root_cause"),
        F.struct(F.round(strength, 2).alias("spectral"), F.lit(LOG_CONFIDENCE).alias("log"),
                 confidence(strength).alias("total")).alias("confidence"),
        F.struct(F.lit(MITIGATION_KIND).alias("type"), firewall_script(first).alias("script"),
                 F.lit("Block the likely origin until an operator reviews it.").alias("explanation"))
        .alias("mitigation"))
    return (df.withColumn("redacted_logs", lg)
            .withColumn("top_target", top_name).withColumn("top_hits", top_hits.cast("long"))
            .withColumn("distinct_targets", n_targets.cast("long"))
            .withColumn("diagnosis", diag))


# ---------------------------------------------------------------- model responses (C4)

_WS = r"^\s+|\s+$"


def parse_response(text: Column) -> Column:
    """A model's reply -> ``struct<parsed, diagnosis, root_cause, total, kind, script,
    explanation, spectral, log>``.

    Code fences (with an optional ``json`` tag) are removed and the rest is
    parsed as a JSON object; anything else becomes the fallback shape with
    the original text as diagnosis. Never fails.
    """
    t0 = F.regexp_replace(text, _WS, "")
    fenced = t0.startswith("```")
    t1 = F.regexp_replace(t0, r"^`+|`+$", "")
    t1 = F.when(F.lower(t1).startswith("json"), F.substring(t1, 5, 1 << 30)).otherwise(t1)
    body = F.when(fenced, F.regexp_replace(t1, _WS, "")).otherwise(t0)
    v = parse_json_strict(body)
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.struct(
        ok.alias("parsed"),
        F.when(ok, F.try_variant_get(v, "$.diagnosis", "string")).otherwise(t0).alias("diagnosis"),
        F.when(ok, F.try_variant_get(v, "$.root_cause", "string"))
        .otherwise(F.lit("unparsed reply, see raw text")).alias("root_cause"),
        F.when(ok, F.try_variant_get(v, "$.confidence.total", "double"))
        .otherwise(F.lit(0.0)).alias("total"),
        F.when(ok, F.try_variant_get(v, "$.mitigation.type", "string"))
        .otherwise(F.lit("none")).alias("kind"),
        F.when(ok, F.try_variant_get(v, "$.mitigation.script", "string"))
        .otherwise(F.lit("")).alias("script"),
        F.when(ok, F.try_variant_get(v, "$.mitigation.explanation", "string"))
        .otherwise(F.lit("")).alias("explanation"),
        F.when(ok, F.try_variant_get(v, "$.confidence.spectral", "double"))
        .otherwise(F.lit(0.0)).alias("spectral"),
        F.when(ok, F.try_variant_get(v, "$.confidence.log", "double"))
        .otherwise(F.lit(0.0)).alias("log"))


# ---------------------------------------------------------------- prompt text (C11)

DIAGNOSE_TEMPLATE = (
    "You review a communication graph window flagged by spectral analysis.\n"
    "Signal strength: {strength}\n"
    "Subgraph (DOT):\n{dot}\n"
    "Log excerpt (redacted):\n{logs}\n"
    "Answer with one JSON object: diagnosis, root_cause, confidence{{spectral, log, total}}, "
    "mitigation{{type, script, explanation}}.")


def build_prompt(dot: Column, logs: Column, strength: Column,
                 template: str = DIAGNOSE_TEMPLATE) -> Column:
    """Fill a template holding ``{dot}``, ``{logs}`` and ``{strength}`` (2 places)."""
    filled = F.lit(template.replace("{{", "{").replace("}}", "}"))
    filled = F.replace(filled, F.lit("{strength}"), F.format_string("%.2f", strength))
    filled = F.replace(filled, F.lit("{dot}"), F.coalesce(dot, F.lit("")))
    return F.replace(filled, F.lit("{logs}"), F.array_join(F.coalesce(logs, F.array()), "\n"))
