"""Exact duplicates by Grace hashing.

Records are dealt by a hash of their normalised text into buckets; a bucket
that would not fit is split again by the next hash, until each one fits an
open-addressing table (Python's ``dict`` over whole texts: open addressing,
hash first, then the complete content). The spill files of the partitioning
are Spark's shuffle files, so a lost executor's share is made again.

The split is planned on digests, so a text is moved once; what stays and how
large its group is comes out of the tables, and digests lead back to the rows. Before that move each
task folds the copies it has read: a text that holds a third of all rows is
sent once a task, and its bucket's table holds it once.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, written

BUCKET_BYTES = 8 << 20      # content of one table
FAN_OUT = 8                 # parts of a bucket that is split again
FOLD_BYTES = 8 << 20        # copies are folded over so much text at a time
MAX_LEVELS = 12
LISTED = 4096               # more buckets than this to split: all are split
TASKS = 8192                # tasks at most; each works through its buckets one by one

_DIGEST = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("n_bytes", pa.int64())])
_CONTENT = pa.schema([("text_sha256", pa.string()), ("content", pa.binary()), ("copies", pa.int64()), ("top_id", pa.int64())])
_FOUND = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _contents(texts: pa.Array) -> list[bytes]:
    """Normalised texts: bytes.lower() changes A-Z only."""
    return [(t or b"").lower() for t in texts.cast(pa.binary()).to_pylist()]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contents = _contents(batch.column(1))
        pairs = [(hashlib.sha256(c).hexdigest(), len(c)) for c in contents]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([p[0] for p in pairs], pa.string()),
             pa.array([p[1] for p in pairs], pa.int64())], schema=_DIGEST)


def _later(a: int | None, b: int | None) -> int | None:
    """The larger of two ids; null only where both are."""
    return a if b is None else b if a is None else max(a, b)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct contents of what the task reads, with how many rows hold each and
    the largest doc_id among them, in runs of FOLD_BYTES."""
    table: dict[bytes, list] = {}
    held = 0

    def flush() -> pa.RecordBatch:
        keys = list(table)
        return pa.RecordBatch.from_arrays(
            [pa.array([hashlib.sha256(k).hexdigest() for k in keys], pa.string()), pa.array(keys, pa.binary()),
             pa.array([e[0] for e in table.values()], pa.int64()), pa.array([e[1] for e in table.values()], pa.int64())],
            schema=_CONTENT)

    for batch in batches:
        for doc_id, content in zip(batch.column(0).to_pylist(), _contents(batch.column(1))):
            entry = table.get(content)
            if entry is not None:
                entry[0] += 1
                entry[1] = _later(entry[1], doc_id)
            else:
                table[content] = [1, doc_id]
                held += len(content)
                if held >= FOLD_BYTES:
                    yield flush()
                    table, held = {}, 0
    if table:
        yield flush()


def _found(table: dict[bytes, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([e[k] for e in table.values()], kind) for k, kind in enumerate(_FOUND.types)], schema=_FOUND)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket after bucket, one table of complete contents each: the digest, the
    doc_id that stays and the rows that hold the content. Rows come sorted by
    bucket. A digest names one content; two in one digest stop the job."""
    table: dict[bytes, list] = {}
    digests: set[str] = set()
    now = None
    for batch in batches:
        for bucket, sha, content, n, top in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now:
                if table:
                    yield _found(table)
                now, table, digests = bucket, {}, set()
            entry = table.get(content)
            if entry is not None:
                entry[1], entry[2] = _later(entry[1], top), entry[2] + n
                continue
            if sha in digests:
                raise ValueError("two contents share a digest")
            digests.add(sha)
            table[content] = [sha, top, n]
    if table:
        yield _found(table)


def _bucket(level: int, parts: int):
    """The bucket of a digest by this level's hash."""
    return F.pmod(F.xxhash64(F.lit(level), "text_sha256"), F.lit(parts))


def plan_buckets(groups: DataFrame, bucket_bytes: int = BUCKET_BYTES):
    """Column that names a record's bucket, as a path of parts, and the number
    of buckets. ``groups``: text_sha256, n_bytes (one row per distinct text)."""
    total = groups.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    parts = max(1, -(-int(total) // bucket_bytes))
    while True:
        path = _bucket(0, parts).cast("string")
        for level in range(1, MAX_LEVELS):
            # the bucket's one largest text cannot be split further
            large = (groups.groupBy(path.alias("path"))
                     .agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
                     .filter((F.col("b") > 2 * bucket_bytes) & (F.col("n") > 1))
                     .select("path").limit(LISTED + 1).collect())
            if not large:
                return path, parts
            if len(large) > LISTED:
                break
            again = F.concat_ws(".", path, _bucket(level, FAN_OUT).cast("string"))
            path = F.when(path.isin([r["path"] for r in large]), again).otherwise(path)
            parts += len(large) * (FAN_OUT - 1)
        else:
            return path, parts
        parts *= FAN_OUT


def exact_duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every document.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty, and empty texts are equal to each other. Of equal texts the row
    with the largest doc_id stays. Rows that repeat both id and text are one
    document, returned once and counted one by one in group_size. A null doc_id
    stays only where its whole group has none (keep_id is then null). Other
    columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    digests = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_digests, "doc_id long, text_sha256 string, n_bytes long"), "digests")
    path, buckets = plan_buckets(written(
        digests.groupBy("text_sha256").agg(F.max("n_bytes").alias("n_bytes")), "sizes"), bucket_bytes)
    stays = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .mapInArrow(_fold, "text_sha256 string, content binary, copies long, top_id long")
             .select(path.alias("bucket"), "text_sha256", "content", "copies", "top_id")
             .repartition(min(buckets, TASKS), "bucket").sortWithinPartitions("bucket")
             .mapInArrow(_tables, "text_sha256 string, keep_id long, group_size long"))
    stays = written(stays, "tables")
    # groups that hold over 1/1024 of the rows are 1023 at most: those are sent
    # to every task, the others meet their documents by a shuffle
    rows = digests.count()
    limit = max(rows // 1024, 1)
    hot = F.broadcast(stays.filter(F.col("group_size") > limit)
                      .select("text_sha256", F.col("keep_id").alias("hot_id"),
                              F.col("group_size").alias("hot_size")))
    marked = digests.join(hot, "text_sha256", "left")
    one = marked.filter(F.col("hot_size").isNotNull()).select(
        "doc_id", F.col("hot_id").alias("keep_id"), F.col("hot_size").alias("group_size"), "text_sha256")
    rest = (marked.filter(F.col("hot_size").isNull()).select("doc_id", "text_sha256")
            .join(stays.filter(F.col("group_size") <= limit), "text_sha256")
            .select("doc_id", "keep_id", "group_size", "text_sha256"))
    both = one.unionByName(rest).dropDuplicates(["doc_id", "text_sha256"])
    return both.select("doc_id", "keep_id", "group_size",
                       F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay (see ``exact_duplicates``), with all their columns
    whatever their names; rows that repeat id and text are kept once (any of them
    where other columns differ). Null texts count as empty. An empty table gives
    an empty result."""
    keep = (exact_duplicates(docs, **options).filter("kept")
            .select(F.struct("text_sha256", *_null_safe(F.col("doc_id"))).alias("key")))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    key = F.struct(F.sha2(F.encode(lowered, "UTF-8"), 256).alias("text_sha256"), *_null_safe(F.col("row.doc_id")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).withColumn("key", key)
    return rows.join(keep, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def _null_safe(doc_id: Column) -> tuple[Column, Column]:
    """An id as two columns that are never null."""
    doc_id = doc_id.cast("long")
    return F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("no_id")
