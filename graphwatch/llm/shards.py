"""Global shuffle into shards by a two-pass external shuffle, in DataFrame
functions alone.

First pass: every record goes to one of many buckets by a seeded hash of its
id; a bucket holds about BUCKET_ROWS records or BUCKET_BYTES of text. Second
pass: each bucket is shuffled by Fisher-Yates (Spark's ``shuffle`` function is
the inside-out Fisher-Yates, here over the bucket's record numbers), and the
buckets, end to end, are the shuffled corpus. Shards are equal runs of it, so
their counts are at most one apart. The text moves once, in the first pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, row_salt, written

SHARDS = 24
SEED = 20240501
BUCKET_ROWS = 2048
BUCKET_BYTES = 16 << 20
TASKS = 4096                    # of the second pass, or as many as keep TASK_BYTES each
TASK_BYTES = 256 << 20
_RUN = 1024                     # buckets whose sizes are added up in one group


def _buckets(counts: DataFrame, seed: int, parts: int) -> DataFrame:
    """(bucket, n) -> (bucket, before, places): records before the bucket, and a
    Fisher-Yates permutation of its record numbers."""
    run = F.expr(f"bucket div {_RUN}")
    runs = counts.groupBy(run.alias("run")).agg(F.sum("n").alias("n"))
    ahead = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("of_run"))
    inside = Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("run", run).withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    # a fixed number of partitions in bucket order: the seeded draws of a
    # partition come out alike when it is made again
    dealt = counts.join(runs, "run").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.select("bucket", (F.col("inside") + F.col("of_run")).alias("before"),
                        F.shuffle(F.sequence(F.lit(0), F.col("n") - 1), seed).alias("places"))


def shuffle_shards(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard`` (0 to n_shards - 1) and ``slot`` (0, 1, ... in each
    shard) added; columns of these names are replaced.

    Shard sizes differ by one row at most. Null ids and texts are dealt like
    others; rows that repeat an id are told apart by their place in the table.
    Fewer rows than shards leave the last shards empty, an empty table all.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()
    if n == 0:
        return docs.drop("shard", "slot").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    buckets = max(1, -(-n // BUCKET_ROWS), -(-int(size) // BUCKET_BYTES))
    parts = min(buckets, max(TASKS, -(-int(size) // TASK_BYTES)))
    salt = row_salt(docs, id_col)
    key = F.xxhash64(F.lit(seed), F.col(id_col), salt)
    bucket = F.pmod(key, F.lit(buckets)).cast("long")
    counts = docs.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    plan = written(_buckets(counts, seed, parts), "buckets")
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    # the row's own columns stand in a struct, so that no name can meet a helper's
    keyed = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), bucket.alias("bucket"), key.alias("key"), salt.alias("salt"))
    inside = Window.partitionBy("bucket").orderBy("key", f"row.`{id_col}`", "salt")
    ranked = keyed.repartition(parts, "bucket").withColumn("no", F.row_number().over(inside))
    place = (F.col("before") + F.element_at("places", F.col("no"))).cast("long")
    placed = ranked.join(plan.hint("merge"), "bucket").select("row", place.alias("place"))
    shard = F.expr(f"place * {n_shards} div {n}")
    first = F.expr(f"(shard * {n} + {n_shards - 1}) div {n_shards}")
    return (placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("place") - first)
            .select(*[F.col("row").getField(c).alias(c) for c in columns], "shard", "slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, **options) -> None:
    """Shards as folders ``shard=N`` of Parquet files: a shard's files in the order
    of their names have its rows in slot order. Every row is written once, with
    its columns as they are; an empty table writes no folder."""
    placed = written(shuffle_shards(docs, n_shards, **options), "shards")
    files = max(n_shards, placed.rdd.getNumPartitions())
    (placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
