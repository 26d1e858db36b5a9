"""Token ids as directly addressable codes.

Documents are encoded in ascending doc_id order, each followed by an end id,
and written as segments. In a segment an id is split into chunks of eight bits.
Level 0 has the lowest chunk of every id and a continuation bit that tells
whether the id goes on; level 1 has the next chunk of those that do, and so on.
A rank directory counts a bitmap's ones before every 512th bit, so the place of
an id in the next level is a directory entry plus the ones of one block: any
token is read without decoding its neighbours (Brisaboa, Ladra, Navarro).

Segments are rows of a Parquet table, so executors write and read them through
Spark on any store. ``(part, segment)`` is their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, row_salt, text_slices
from .tokens import SLICE, encoder, tokenizer_path

END_ID = 0
CHUNK = 8
BLOCK = 512                  # bits a directory entry
LEVELS = 4                   # of eight bits: any 32-bit id
PART_BYTES = 32 << 20

SEGMENTS = ("part int, segment int, n_tokens long, doc_ids binary, no_id binary, ends binary, "
            + ", ".join(f"chunks{k} binary, bits{k} binary, ranks{k} binary" for k in range(LEVELS)))


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, continuation bitmap, rank directory) of each level."""
    left = ids.astype(np.uint64)
    out = []
    for _ in range(LEVELS):
        chunks = (left & np.uint64(255)).astype(np.uint8)
        left = left >> np.uint64(CHUNK)
        goes_on = left > 0
        bits = np.packbits(goes_on, bitorder="little")
        blocks = np.add.reduceat(goes_on, np.arange(0, len(goes_on), BLOCK), dtype=np.uint32) if len(goes_on) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(blocks)]).astype("<u4")
        out.append((chunks, bits, ranks))
        left = left[goes_on]
    return out


def token_at(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], i: int) -> int:
    """The i-th id, by one directory entry and one block a level."""
    out = 0
    for k, (chunks, bits, ranks) in enumerate(levels):
        out |= int(chunks[i]) << (CHUNK * k)
        if not (bits[i >> 3] >> (i & 7)) & 1:
            break
        block = i // BLOCK
        before = np.unpackbits(bits[block * BLOCK // 8:(i >> 3) + 1], bitorder="little")[:i - block * BLOCK]
        i = int(ranks[block]) + int(before.sum())
    return out


def decode_levels(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """All ids of a segment."""
    out = levels[0][0].astype(np.uint32)
    at = np.arange(len(out))
    for k in range(1, len(levels)):
        bits = np.unpackbits(levels[k - 1][1], count=len(at), bitorder="little").astype(bool)
        at = at[bits]
        if not len(at):
            break
        out[at] |= levels[k][0].astype(np.uint32) << np.uint32(CHUNK * k)
    return out


def _writer(path: str, end_id: int):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, segment = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, b, off in text_slices(batch.column(1), SLICE):
                ids, first = ids_of.encode_slice(b, off)
                docs = len(off) - 1
                ends = first[1:] + np.arange(1, docs + 1)
                whole = np.full(len(ids) + docs, end_id, np.int64)
                place = np.ones(len(whole), bool)
                place[ends - 1] = False
                whole[place] = ids
                doc_ids = batch.column(0).slice(lo, docs)
                cells = [part, segment, len(whole),
                         doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
                         np.packbits(doc_ids.is_null().to_numpy(zero_copy_only=False), bitorder="little").tobytes(),
                         ends.astype("<i8").tobytes()]
                for level in encode_levels(whole):
                    cells += [x.tobytes() for x in level]
                segment += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cells[0]], pa.int32()), pa.array([cells[1]], pa.int32()), pa.array([cells[2]], pa.int64()),
                     *(pa.array([c], pa.binary()) for c in cells[3:])], names=_NAMES)
    return segments


_NAMES = [c.split()[0] for c in SEGMENTS.split(", ")]


def write_codes(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                part_bytes: int = PART_BYTES) -> None:
    """Write the segments of ``docs`` in ascending doc_id order (null ids first,
    then by a hash of the text). Null texts count as empty and have the end id
    alone; repeated rows are written as often as they come; other columns are
    not read. An empty table writes no segment."""
    prepare(docs.sparkSession)
    text = F.col("text").cast("string")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-int(total) // part_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64(text).alias("_h"), row_salt(docs).alias("_salt"))
    order = ["doc_id", "_h", "_salt"]
    (rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(_writer(tokenizer_path(tokenizer), end_id), SEGMENTS).write.parquet(path))


def levels_of(row: dict) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return [(np.frombuffer(row[f"chunks{k}"], np.uint8), np.frombuffer(row[f"bits{k}"], np.uint8),
             np.frombuffer(row[f"ranks{k}"], "<u4")) for k in range(LEVELS)]


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}
            ids = decode_levels(levels_of(row))
            doc_ids, ends = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["ends"], "<i8")
            null = np.unpackbits(np.frombuffer(row["no_id"], np.uint8), count=len(doc_ids), bitorder="little").astype(bool)
            starts = np.concatenate([[0], ends[:-1]])
            for lo in range(0, len(doc_ids), 1000):
                part = slice(lo, lo + 1000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc_ids[part]), row["part"], np.int32)),
                     pa.array(np.full(len(doc_ids[part]), row["segment"], np.int32)),
                     pa.array(doc_ids[part], pa.int64(), mask=null[part]), pa.array(starts[part]), pa.array(ends[part] - starts[part]),
                     pa.array([ids[s:e].astype("<u4").tobytes() for s, e in zip(starts[part], ends[part])], pa.binary())],
                    names=["part", "segment", "doc_id", "start", "n_tokens", "ids"])


def _starts(segments: DataFrame) -> DataFrame:
    """(part, segment, before): ids before each segment, by a running sum inside
    each part and one over the parts' totals."""
    sizes = segments.select("part", "segment", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("of_part"))
    w = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.select("part", "segment", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("inside"))
    return inside.join(parts, "part").select("part", "segment", (F.col("inside") + F.col("of_part")).alias("before"))


def read_codes(spark, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from written segments: ``start`` counts the
    ids of all documents before, ``ids`` are little-endian unsigned 32-bit. With
    ``digest`` their crc32 (ids_crc32) takes the place of ``ids``."""
    prepare(spark)
    segments = spark.read.parquet(path)
    docs = segments.mapInArrow(_reader, "part int, segment int, doc_id long, start long, n_tokens long, ids binary")
    if digest:           # before the join, so that no ids are moved for it
        docs = docs.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return (docs.join(_starts(segments), ["part", "segment"])
            .select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", docs.columns[-1]))


def read_token(spark, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, place, token) for the rows (doc_id, place) of ``wanted``: single
    tokens, read through the rank directories without decoding their neighbours.
    Places count from 0 in the document; the last one holds the end id. Rows
    without such a document or place are left out; a document that is written
    more than once answers once for each."""
    prepare(spark)
    segments = spark.read.parquet(path)
    holds = segments.select("part", "segment", "doc_ids", "no_id", "ends").mapInArrow(
        _holds, "part int, segment int, doc_id long, first long, n_tokens long")
    asked = (wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("place").cast("long").alias("place"))
             .join(holds, "doc_id").filter((F.col("place") >= 0) & (F.col("place") < F.col("n_tokens"))))
    asked = (asked.groupBy("part", "segment").agg(F.collect_list(F.struct(
        "doc_id", "place", (F.col("first") + F.col("place")).alias("at"))).alias("asked")))
    levels = [f"{c}{k}" for k in range(LEVELS) for c in ("chunks", "bits", "ranks")]
    return (segments.select("part", "segment", *levels).join(asked, ["part", "segment"])
            .mapInArrow(_tokens_at, "doc_id long, place long, token long"))


def _holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each document stands in its segment; null ids are asked for by nobody."""
    for batch in batches:
        for row in batch.to_pylist():
            doc_ids, ends = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["ends"], "<i8")
            null = np.unpackbits(np.frombuffer(row["no_id"], np.uint8), count=len(doc_ids), bitorder="little").astype(bool)
            first = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ends), row[c], np.int32)) for c in ("part", "segment")]
                + [pa.array(doc_ids, pa.int64(), mask=null), pa.array(first), pa.array(ends - first)],
                names=["part", "segment", "doc_id", "first", "n_tokens"])


def _tokens_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            levels = levels_of(row)
            found = [(a["doc_id"], a["place"], token_at(levels, a["at"])) for a in row["asked"]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["doc_id", "place", "token"])
