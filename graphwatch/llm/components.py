"""Connected components of a link table by alternating large-star and
small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond"). Links stay distributed; the driver sees two sums per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (u, v). ``large``: every larger neighbour of u is
    linked to the smallest node around u; else every smaller one, and u."""
    if large:
        links = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    near = links.join(low, "u")
    if large:
        out = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (near.select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(low.select("u", F.col("m").alias("v"))))
    return out.filter(F.col("u") != F.col("v")).distinct()


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                    F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(u, v) links of any comparable type -> (node, component): every node that
    has a link, with the smallest node of its component. Loops and nulls are
    ignored. Raises where the rounds do not suffice."""
    links = written(links.select("u", "v").filter(F.col("u") != F.col("v")).distinct(), "links")
    before = _state(links)
    if before[0] == 0:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        links = written(_star(_star(links, large=True), large=False), "stars")
        now = _state(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    named = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return named.unionByName(roots)
