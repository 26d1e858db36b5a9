"""Packing of documents into training sequences by the sum-of-squares rule.

Documents are encoded and followed by an end id; what exceeds a sequence is cut
into whole sequences, with the document's first piece the short one. The pieces
of a partition, longest first, are placed one by one: a piece goes where the
squared numbers of open sequences per residual gap add up to the least, that
is, where it closes gaps that many sequences share. A new sequence is opened
only where the piece fits in none (longest first, an early new sequence could
never be won back). Partitions are dealt by a hash of the document and hold
about PARTITION_BYTES of text, so each packs alone and loses at most its last,
unfilled sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, row_salt
from .tokens import encoder, tokenizer_path

LENGTH = 1024
END_ID = 2
PARTITION_BYTES = 12 << 20

_PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PLACED = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


def sum_of_squares(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, placed in the given order."""
    open_count = np.zeros(capacity + 1, np.int64)          # sequences per gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = 0
    for i, size in enumerate(lengths.tolist()):
        # taking gap g to g - size changes the sum of squares by
        # 2 * (N[g - size] - N[g]) + 2; a gap closed to 0 leaves the sum
        gain = -2 * open_count[size:capacity]
        gain[1:] += 2 * open_count[1:capacity - size] + 1
        gain += 1
        gain[open_count[size:capacity] == 0] = 1 << 40
        at = int(gain.argmin()) if len(gain) else -1
        if at >= 0 and gain[at] < 1 << 40:
            gap = size + at
            seq = stacks[gap].pop()
            open_count[gap] -= 1
        else:
            gap, seq = capacity, used
            used += 1
        sequence[i], offset[i] = seq, capacity - gap
        if gap - size:
            stacks[gap - size].append(seq)
            open_count[gap - size] += 1
    return sequence, offset


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    head = n % length
    return ([(0, head)] if head else []) + [(s, length) for s in range(head, n, length)]


def _packer(path: str, length: int, end_id: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path)
        rows: list[tuple] = []
        end = np.array([end_id], "<u4")
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of.encode(batch.column(1))):
                whole = np.concatenate([ids.astype("<u4"), end])
                rows += [(doc_id, k, s, n, whole[s:s + n].tobytes()) for k, (s, n) in enumerate(cut(len(whole), length))]
        # a lost task that runs again packs alike, in whatever order its rows come
        rows.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[4]))
        sequence, offset = sum_of_squares(np.array([r[3] for r in rows], np.int64), length)
        sequence += TaskContext.get().partitionId() << 32
        for lo in range(0, len(rows), 2000):
            part = rows[lo:lo + 2000]
            cols = list(zip(*part))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(cols, _PLACED.types)),
                 pa.array(sequence[lo:lo + 2000]), pa.array(offset[lo:lo + 2000])], schema=_PLACED)
    return pack


def pack_documents(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, tokenizer: str | None = None,
                   partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset), one row per piece;
    ``ids`` holds little-endian unsigned 32-bit ids.

    Null and empty texts are a piece of the end id alone. Repeated rows and null
    doc_ids are packed like others. Other columns are not read. An empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)
    text = F.col("text").cast("string")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-int(total) // partition_bytes))
    salt = row_salt(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64("doc_id", salt).alias("_deal"))
    return (rows.repartition(parts, "_deal").select("doc_id", "text")
            .mapInArrow(_packer(tokenizer_path(tokenizer), length, end_id), PLACED))


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids for the ids."""
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
