"""Baselines learned over a stream's window table (one row per window).

``fixed``: λ₂ baseline = mean over the first ``warmup`` non-tiny windows,
multiplicity baseline = the very first window's; frozen afterwards.

``adaptive``: exponential moving average over *all* non-tiny windows,
seeded with the first value; detection compares against the value
*before* a window's update, the window record reports the value *after*.
The multiplicity baseline is the EMA rounded half-to-even.

Window positions come from a two-level count over the integer window
number (no global sort in one task). The EMA is a linear recurrence; it is evaluated in
chunks of ``C`` windows with a closed form
``e_i = q^(i+1)·e_in + q^i·Σ_{j<=i} α·x_j·q^(-j)`` (``q = 1-α``) as a
running window sum, and each chunk's entry value comes from the two
preceding chunks by equi-joins. ``C`` is chosen so that ``q^C ≈ e^-600``:
contributions older than two chunks are below 1e-500 relative, i.e.
exactly zero in double precision.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphwatch.operators.windows import sequence_rank

# Fixed values of the baseline rules.
DEFAULT_WARMUP = 12
DEFAULT_ALPHA = 0.3
TINY_NODES = 3           # windows with fewer nodes never touch the baseline


def _chunk_size(alpha: float) -> int:
    q = 1.0 - alpha
    if q <= 0.0:
        return 1
    return max(1, int(600.0 / -math.log(q)))


RANK_BUCKET = 4096       # windows per bucket of the two-level position count


def rank_windows(windows: DataFrame, key: str = "source_id",
                 partitions: int | None = None) -> DataFrame:
    """Add ``r``: 0-based position among the stream's non-tiny windows (null for tiny ones).

    ``window_no`` is an integer, so positions come from a deterministic
    two-level count: non-tiny windows per bucket of 4096 numbers, a prefix
    sum over the (small) bucket table, plus a running count inside the
    bucket. No global sort, no sampling, no materialization.
    """
    keep = (F.col("n") >= TINY_NODES).cast("long")
    w = (windows.withColumn("_gw_b", F.floor(F.col("window_no") / RANK_BUCKET).cast("long"))
         .withColumn("_gw_keep", keep))
    per_b = w.groupBy(key, "_gw_b").agg(F.sum("_gw_keep").alias("_gw_cnt"))
    before_b = Window.partitionBy(key).orderBy("_gw_b").rowsBetween(Window.unboundedPreceding, -1)
    off = per_b.select(key, "_gw_b", F.coalesce(F.sum("_gw_cnt").over(before_b), F.lit(0))
                       .alias("_gw_off"))
    inside = Window.partitionBy(key, "_gw_b").orderBy("window_no").rowsBetween(
        Window.unboundedPreceding, -1)
    r = F.col("_gw_off") + F.coalesce(F.sum("_gw_keep").over(inside), F.lit(0))
    return (w.join(off, [key, "_gw_b"])
            .withColumn("r", F.when(F.col("_gw_keep") == 1, r).cast("long"))
            .drop("_gw_b", "_gw_keep", "_gw_off"))


def fixed_baseline(ranked: DataFrame, warmup: int = DEFAULT_WARMUP,
                   key: str = "source_id") -> DataFrame:
    """Per stream: ``(base_lambda2, base_mult)`` from the first ``warmup`` non-tiny windows."""
    return (ranked.filter(F.col("r").isNotNull())
            .groupBy(key)
            .agg(F.avg(F.when(F.col("r") < warmup, F.col("lambda2"))).alias("base_lambda2"),
                 F.min_by(F.col("mult"), F.col("r")).cast("int").alias("base_mult")))


def apply_fixed(ranked: DataFrame, warmup: int = DEFAULT_WARMUP,
                key: str = "source_id") -> DataFrame:
    """Attach the compared and reported baseline (identical in fixed mode)."""
    base = fixed_baseline(ranked, warmup, key)       # one row per stream
    return (ranked.join(base, key, "left")
            .withColumn("cmp_lambda2", F.col("base_lambda2"))
            .withColumn("cmp_mult", F.col("base_mult"))
            .withColumnRenamed("base_lambda2", "baseline_lambda2")
            .withColumnRenamed("base_mult", "baseline_mult"))


def ema_columns(ranked: DataFrame, values: str | list[str], alpha: float = DEFAULT_ALPHA,
                key: str = "source_id", prefixes: str | list[str] = "ema",
                chunk: int | None = None) -> DataFrame:
    """Add ``{prefix}_before`` / ``{prefix}_after`` EMA of each value over rows ordered by ``r``.

    Several value columns share one pass (one running window, one chunk
    table). Rows with null ``r`` are passed through with null EMA columns.
    """
    vals = [values] if isinstance(values, str) else list(values)
    pres = [prefixes] if isinstance(prefixes, str) else list(prefixes)
    q = 1.0 - alpha
    size = chunk or _chunk_size(alpha)
    rows = ranked.filter(F.col("r").isNotNull())
    rest = ranked.filter(F.col("r").isNull())
    rows = (rows.withColumn("_c", F.floor(F.col("r") / size).cast("long"))
            .withColumn("_i", F.col("r") - F.col("_c") * size))
    running = Window.partitionBy(key, "_c").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    for t, v in enumerate(vals):
        rows = rows.withColumn(f"_term{t}", F.lit(alpha) * F.col(v).cast("double")
                               * F.pow(F.lit(q), -F.col("_i")))
        rows = rows.withColumn(f"_s{t}", F.sum(f"_term{t}").over(running))
    seed = rows.filter(F.col("r") == 0).select(
        key, *[F.col(v).cast("double").alias(f"_x0{t}") for t, v in enumerate(vals)])  # one row per stream
    # Chunk table: length and, per value, B = the value at the chunk end when entered with 0.
    chunks = (rows.groupBy(key, "_c")
              .agg(F.max("_i").alias("_last"),
                   *[F.max_by(f"_s{t}", "_i").alias(f"_sl{t}") for t in range(len(vals))])
              .select(key, "_c", (F.col("_last") + 1).alias("_len"),
                      *[(F.pow(F.lit(q), F.col("_last")) * F.col(f"_sl{t}")).alias(f"_b{t}")
                        for t in range(len(vals))]))
    p1 = chunks.select(key, (F.col("_c") + 1).alias("_c"), F.col("_len").alias("_len1"),
                       *[F.col(f"_b{t}").alias(f"_b1_{t}") for t in range(len(vals))])
    p2 = chunks.select(key, (F.col("_c") + 2).alias("_c"),
                       *[F.col(f"_b{t}").alias(f"_b2_{t}") for t in range(len(vals))])
    entry = (chunks.select(key, "_c").join(p1, [key, "_c"], "left").join(p2, [key, "_c"], "left")
             .join(seed, key, "left"))
    qc = F.pow(F.lit(q), F.lit(float(size)))     # every chunk before the last is full
    # (a small test chunk keeps older chunks' weight above double precision; the
    # default size makes it exactly negligible)
    e_ins = []
    for t in range(len(vals)):
        x0, b1, b2 = F.col(f"_x0{t}"), F.col(f"_b1_{t}"), F.col(f"_b2_{t}")
        e_ins.append((F.when(F.col("_c") == 0, x0)
                      .when(F.col("_c") == 1, b1 + F.pow(F.lit(q), F.col("_len1")) * x0)
                      .when(F.col("_c") == 2, b1 + qc * (b2 + qc * x0))
                      .otherwise(b1 + qc * b2)).alias(f"_e{t}"))
    entry = entry.select(key, "_c", *e_ins)
    qi = F.pow(F.lit(q), F.col("_i"))
    out = rows.join(entry, [key, "_c"])
    drop = ["_c", "_i"]
    for t, pre in enumerate(pres):
        e, s_, term = F.col(f"_e{t}"), F.col(f"_s{t}"), F.col(f"_term{t}")
        out = (out.withColumn(f"{pre}_after", qi * F.lit(q) * e + qi * s_)
               .withColumn(f"{pre}_before", F.when(F.col("_i") == 0, e).otherwise(
                   qi * e + F.pow(F.lit(q), F.col("_i") - 1) * (s_ - term))))
        drop += [f"_term{t}", f"_s{t}", f"_e{t}"]
    out = out.drop(*drop)
    for pre in pres:
        rest = (rest.withColumn(f"{pre}_after", F.lit(None).cast("double"))
                .withColumn(f"{pre}_before", F.lit(None).cast("double")))
    return out.unionByName(rest)


def apply_adaptive(ranked: DataFrame, alpha: float = DEFAULT_ALPHA,
                   key: str = "source_id") -> DataFrame:
    """EMA baselines: compared = before this window's update, reported = after."""
    out = ema_columns(ranked, ["lambda2", "mult"], alpha, key, ["_l2", "_mu"])
    return (out.withColumn("cmp_lambda2", F.col("_l2_before"))
            .withColumn("cmp_mult", F.bround(F.col("_mu_before"), 0).cast("int"))
            .withColumn("baseline_lambda2", F.col("_l2_after"))
            .withColumn("baseline_mult", F.bround(F.col("_mu_after"), 0).cast("int"))
            .drop("_l2_before", "_l2_after", "_mu_before", "_mu_after"))


_BIG = 1e300
FEEDBACK_STEP = 0.05     # fixed values of the feedback rule
ALPHA_MAX = 0.7
ALPHA_MIN = 0.1
FEEDBACK_CHUNK = 1024


def _compose(acc, d, lo, hi):
    """(D, L, H) of ``x -> clamp(x + D, L, H)`` followed by ``clamp(. + d, lo, hi)``."""
    return F.struct(
        (acc["D"] + d).alias("D"),
        F.least(hi, F.greatest(lo, acc["L"] + d)).alias("L"),
        F.least(hi, F.greatest(lo, acc["H"] + d)).alias("H"))


def _identity():
    return F.struct(F.lit(0.0).alias("D"), F.lit(-_BIG).alias("L"), F.lit(_BIG).alias("H"))


def feedback_alpha(labels: DataFrame, order: str, label: str, key: str | None = None,
                   start: float = DEFAULT_ALPHA) -> DataFrame:
    """Fold operator feedback into α: false positive +0.05 (capped 0.7), true positive
    −0.05 (floored 0.1), anything else unchanged, applied in ``order``.

    Each step is a map ``x -> clamp(x + d, lo, hi)``; such maps compose into
    another one of the same form, so the ordered fold is associative and runs
    in two levels: chunks of ``FEEDBACK_CHUNK`` consecutive labels are folded
    with ``aggregate``, then the per-key chunk summaries (labels/1024 rows).
    """
    k = key or "_gw_key"
    fb = F.lower(F.trim(F.col(label).cast("string")))
    d = (F.when(fb == "false_positive", F.lit(FEEDBACK_STEP))
         .when(fb == "true_positive", F.lit(-FEEDBACK_STEP)).otherwise(F.lit(0.0)))
    lo = F.when(fb == "true_positive", F.lit(ALPHA_MIN)).otherwise(F.lit(-_BIG))
    hi = F.when(fb == "false_positive", F.lit(ALPHA_MAX)).otherwise(F.lit(_BIG))
    steps = labels.select((F.col(key) if key else F.lit("all")).cast("string").alias(k),
                          F.col(order).alias("_o"), d.alias("d"), lo.alias("lo"), hi.alias("hi"))
    ranked = sequence_rank(steps, order=["_o"], key=k, rank_col="_r")
    per_chunk = (ranked.groupBy(k, F.floor(F.col("_r") / FEEDBACK_CHUNK).alias("_chunk"))
                 .agg(F.array_sort(F.collect_list(F.struct("_r", "d", "lo", "hi"))).alias("_s"),
                      F.count(F.lit(1)).alias("_n"))
                 .select(k, "_chunk", "_n", F.aggregate(
                     "_s", _identity(), lambda acc, s: _compose(acc, s["d"], s["lo"], s["hi"])
                 ).alias("_f")))
    per_key = (per_chunk.groupBy(k)
               .agg(F.array_sort(F.collect_list(F.struct("_chunk", "_f"))).alias("_s"),
                    F.sum("_n").alias("n_labels"))
               .select(k, "n_labels", F.aggregate(
                   "_s", _identity(),
                   lambda acc, s: _compose(acc, s["_f"]["D"], s["_f"]["L"], s["_f"]["H"])
               ).alias("_f")))
    alpha = F.least(F.col("_f.H"), F.greatest(F.col("_f.L"), F.lit(start) + F.col("_f.D")))
    out = per_key.select(k, F.col("n_labels").cast("long").alias("n_labels"),
                         F.round(alpha, 10).alias("alpha"))
    return out if key else out.drop(k)
