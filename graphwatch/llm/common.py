"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwatch.session import ensure_checkpoint_dir, scratch_path, ship_package

# Texts are worked on in pieces of about this many bytes, so that the numpy
# temporaries of a task stay small whatever the Arrow batch holds.
SLICE_BYTES = 1 << 20
BATCH_ROWS = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder known, package importable in the Python workers, and
    Arrow batches that hold whole documents kept to a few megabytes."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: cuts the
    lineage with files that every executor sees."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def row_salt(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """A column that tells rows with the same id apart.

    Ids are normally unique and the salt is the constant 0, so results depend
    on content alone. Where ids repeat (or are null), a row number of the scan
    is used: one id may then hold any share of the rows without meeting in one
    task. It needs a table as input, whose rows come in the same order when a
    lost task is run again.
    """
    repeated = (docs.groupBy(id_col).count().filter(F.col("count") > 1).limit(1).count()) > 0
    return F.monotonically_increasing_id() if repeated else F.lit(0).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_slices(texts: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, row offsets) over slices of about ``slice_bytes``.

    Null texts count as empty. A row is never cut."""
    if len(texts) == 0:
        return
    arr = texts.cast(pa.large_binary()).fill_null(b"")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, n = 0, len(arr)
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + slice_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def lower_ascii(b: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    out = b.copy()
    out[(b >= 65) & (b <= 90)] += 32
    return out


# The five separators of the word contract: blank and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
# Word bytes for benchmark matching: letters, digits and everything beyond ASCII.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[np.r_[48:58, 65:91, 97:123, 128:256]] = False

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = len(_POWERS.get("up", ()))
    if have < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        for name, base in (("up", _R), ("down", _R_INV)):
            p = np.full(size, np.uint64(base), np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_spans(b: np.ndarray, off: np.ndarray, separators: np.ndarray, breaks: np.ndarray | None = None
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of every row of a slice: (byte starts, byte ends, first word of
    each row, with one entry more than rows). A word also ends before each byte
    that ``breaks`` marks."""
    n = len(b)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~separators[b]
    first = np.zeros(n + 1, bool)
    first[off[off < n]] = True
    if breaks is not None:
        first[:n] |= breaks
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:n]
    starts = np.flatnonzero(start)
    stop = np.ones(n, bool)                      # a word ends before a separator, a row or a start
    stop[:-1] = ~word[1:] | first[1:n]
    ends = np.flatnonzero(word & stop) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(b: np.ndarray, off: np.ndarray, separators: np.ndarray, breaks: np.ndarray | None = None
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every row of a slice: (hashes, byte starts, byte ends, first
    word of each row, with one entry more than rows).

    A word's hash is a polynomial over its bytes modulo 2**64, read off a
    running sum, so that no Python step is taken per word."""
    starts, ends, first = word_spans(b, off, separators, breaks)
    n = len(b)
    if n == 0:
        return np.zeros(0, np.uint64), starts, ends, first
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = mix64((sums[ends] - sums[starts]) * down[starts])
    return h, starts, ends, first


def word_codes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of a slice as an Arrow array, and for each the number of its
    content: equal numbers mean equal bytes."""
    if not len(starts):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    flags = np.zeros(len(b) + 1, np.int8)
    flags[starts] += 1
    flags[ends] -= 1
    held = b[np.cumsum(flags[:-1], dtype=np.int8).astype(bool)]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(held)])
    coded = words.dictionary_encode()
    return words, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every c of ``counts``, end to end."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)
