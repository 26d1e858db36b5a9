"""Hard-negative mining with segment summaries.

Every vector is cut into segments, and each segment's mean and deviation (the
length of what is left when the mean is taken away) are stored with it. Over a
segment of n components the inner product of two vectors is n times the product
of the means plus the inner product of the leftovers, and the latter lies
between minus and plus the product of the deviations. So

    n * mean * mean' - dev * dev'  <=  inner product  <=  n * mean * mean' + dev * dev'

summed over the segments. One segment for the whole vector comes first; pairs
that can't matter by their bounds are put aside, the others are bounded again on
segments half as long, down to the stored ones, and what is left is scored
exactly.

Anchors (the queries) are dealt into blocks and rows into chunks of bounded
size; a task meets one block with one chunk and keeps the first few of each
anchor, which are merged by rank over all chunks. Rows are looked through twice:
for the positives of an anchor, then for the negatives that score within the
window that each positive sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, prepare, written

SEGMENTS = 8               # of a vector, at the finest level (a power of two)
CHUNK_ROWS = 16384         # rows that a task holds
BLOCK_ANCHORS = 2048       # anchors that a task holds
STRIP = 64                 # anchors whose bounds are held as one table
SEEDS = 64                 # rows scored at once for a first limit
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100        # percent of the positive's score

_INDEXED = "id long, label string, chunk int, anchor boolean, content long, vec binary, mean binary, dev binary"


def _index(n_chunks: int, width: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are dealt in turn, so that equal ones spread as others do
        turn = int(mix64(np.array([TaskContext.get().partitionId()], np.uint64))[0] % np.uint64(n_chunks))
        for batch in batches:
            n = len(batch)
            vectors = batch.column(2)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), sizes)
            x = np.zeros((n, width))
            x[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            parts = x.reshape(n, SEGMENTS, -1)
            mean = parts.mean(axis=2)
            dev = np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))
            chunk = (turn + np.arange(n)) % n_chunks
            turn = (turn + n) % n_chunks
            rows = [[r.tobytes() for r in a] for a in (x.astype(np.int32), mean, dev)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(chunk.astype(np.int32)), batch.column(3), batch.column(4),
                 *(pa.array(r, pa.binary()) for r in rows)],
                names=["id", "label", "chunk", "anchor", "content", "vec", "mean", "dev"])
    return index


class Side:
    """Vectors of a block or a chunk with their summaries at every level."""

    def __init__(self, table: pa.Table, exact: type):
        def matrix(name: str, kind: type) -> np.ndarray:
            data = b"".join(table.column(name).to_pylist())
            return np.frombuffer(data, kind).reshape(len(table), -1)

        self.id = table.column("id").to_numpy()
        self.label = np.array(table.column("label").to_pylist(), dtype=str)
        self.vec = matrix("vec", np.int32).astype(exact)
        mean, dev = matrix("mean", np.float64), matrix("dev", np.float64)
        length = self.vec.shape[1] / SEGMENTS
        self.levels = [(length, mean, dev)]
        while mean.shape[1] > 1:
            left, right = mean[:, ::2], mean[:, 1::2]
            dev = np.sqrt(dev[:, ::2] ** 2 + dev[:, 1::2] ** 2 + length / 2 * (left - right) ** 2)
            mean, length = (left + right) / 2, length * 2
            self.levels.insert(0, (length, mean, dev))
        self.norm = np.sqrt((self.vec.astype(float) ** 2).sum(axis=1))

    def bounds(self, mine: np.ndarray, other: Side, theirs: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores between rows of both sides, with
        room for rounding."""
        length, mean, dev = self.levels[level]
        _, mean2, dev2 = other.levels[level]
        middle = length * (mean[mine] @ mean2[theirs].T)
        reach = dev[mine] @ dev2[theirs].T
        reach += 1e-9 * np.outer(self.norm[mine], other.norm[theirs]) + 1e-6
        return middle - reach, middle + reach

    def scores(self, mine: np.ndarray, other: Side, theirs: np.ndarray) -> np.ndarray:
        return self.vec[mine] @ other.vec[theirs].T


def _best_same(block: Side, chunk: Side, k: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, row, score): each anchor's first k rows of its label in a chunk."""
    for label in np.unique(block.label):
        rows_of = np.flatnonzero(chunk.label == label)
        of = np.flatnonzero(block.label == label)
        for s in range(0, len(of), STRIP):
            mine, rows = of[s:s + STRIP], rows_of
            other = block.id[mine][:, None] != chunk.id[rows][None, :]
            # k rows are known to score as much as the limit, or more
            limit = _kth(np.where(other[:, :SEEDS], block.scores(mine, chunk, rows[:SEEDS]).astype(float), -np.inf), k)
            alive = other
            for level in range(len(block.levels)):
                if not len(rows):
                    break
                low, high = block.bounds(mine, chunk, rows, level)
                limit = np.maximum(limit, _kth(np.where(alive, low, -np.inf), k))
                alive = alive & (high >= limit[:, None])
                some = alive.any(axis=0)
                rows, alive = rows[some], alive[:, some]
            score = block.scores(mine, chunk, rows)
            for i, a in enumerate(mine):
                at = np.flatnonzero(alive[i])
                for j in at[np.lexsort((chunk.id[rows[at]], -score[i, at]))][:k]:
                    yield int(a), int(rows[j]), int(score[i, j])


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of every row; minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _best_other(block: Side, positives: list[list[int]], chunk: Side, k: int, low_percent: int, high_percent: int
                ) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, place of the positive, row, score): each positive's first k rows
    of other labels within its window, in a chunk."""
    least = np.full(len(positives), np.inf)
    most = np.full(len(positives), -np.inf)
    for i, scores in enumerate(positives):
        for p in scores:
            lo, hi = -(-low_percent * p // 100), high_percent * p // 100
            if lo <= hi:
                least[i], most[i] = min(least[i], lo), max(most[i], hi)
    wanted = np.flatnonzero(least <= most)
    for s in range(0, len(wanted), STRIP):
        mine, rows = wanted[s:s + STRIP], np.arange(len(chunk.id))
        alive = block.label[mine][:, None] != chunk.label[None, :]
        for level in range(len(block.levels)):
            if not len(rows):
                break
            low, high = block.bounds(mine, chunk, rows, level)
            alive = alive & (high >= least[mine][:, None]) & (low <= most[mine][:, None])
            some = alive.any(axis=0)
            rows, alive = rows[some], alive[:, some]
        score = block.scores(mine, chunk, rows)
        for i, a in enumerate(mine):
            at = np.flatnonzero(alive[i] & (score[i] >= least[a]) & (score[i] <= most[a]))
            at = at[np.lexsort((chunk.id[rows[at]], -score[i, at]))]
            found = score[i, at]
            for place, p in enumerate(positives[a]):
                first = int(np.searchsorted(-found, -(high_percent * p // 100)))
                for j in range(first, min(first + k, len(at))):
                    if 100 * int(found[j]) < low_percent * p:
                        break
                    yield int(a), place, int(rows[at[j]]), int(found[j])


def _columns(names: list[str], rows: list[tuple]) -> pa.Table:
    return pa.table({name: pa.array([r[k] for r in rows], pa.int64()) for k, name in enumerate(names)})


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label",
                        vector_col: str = "vector", positives: int = POSITIVES, negatives: int = NEGATIVES,
                        low_percent: int = LOW, high_percent: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors``: an id (long), a label of any type and an array of integers; a
    shorter array counts as filled up with zeros. A row's score is its inner
    product with the anchor; higher scores come first, ties by smaller id. An
    anchor is a row for which ``is_anchor`` holds; its positives are its first
    ``positives`` rows of its label with another id, and each positive's
    negatives its first ``negatives`` rows of other labels that score from
    ``low_percent`` to ``high_percent`` percent of the positive.

    Rows with a null id, label, vector or component take no part. Rows that
    repeat count as often as they come as positives and negatives, once as
    anchors; rows of one id with different contents are anchors of their own.
    Anchors with fewer rows to find return fewer; an empty table, or one without
    anchors, returns no rows; other columns are not read, whatever their names.
    Components of 2**31 or more, and vectors whose scores could exceed a long,
    stop the job with an error."""
    spark = vectors.sparkSession
    prepare(spark)
    vector = F.col(vector_col)
    used = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        vector.cast("array<long>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
             & F.forall("vector", lambda c: c.isNotNull()))
    largest = F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector")))
    totals = used.agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors"), F.max(F.size("vector")).alias("width"),
                      F.max(largest).alias("largest")).first()
    width = max(1, -(-(totals["width"] or 0) // SEGMENTS)) * SEGMENTS
    most = totals["largest"] or 0
    if most >= 1 << 31 or width * most * most >= 1 << 63:
        raise ValueError(f"components up to {most} over {width} places: scores could exceed a long")
    exact = np.float64 if width * most * most < 1 << 53 else np.int64
    n_chunks = max(1, -(-totals["rows"] // CHUNK_ROWS))
    n_blocks = max(1, -(-totals["anchors"] // BLOCK_ANCHORS))

    indexed = written(used.select("id", "label", "vector", "anchor", F.xxhash64("label", "vector").alias("content"))
                      .mapInArrow(_index(n_chunks, width), _INDEXED), "vectors")
    anchors = (indexed.filter("anchor").drop("anchor", "chunk").dropDuplicates(["id", "content"])
               .withColumn("block", F.pmod(F.xxhash64("id", "content"), F.lit(n_blocks)).cast("int")))
    rows = indexed.drop("anchor", "content").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def met(anchors: DataFrame, kernel, schema: str) -> DataFrame:
        dealt = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
        # columns under new identities: both sides come from the same table
        left, right = (df.toDF(*df.columns) for df in (dealt, rows))
        return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(kernel, schema)

    def same(left: pa.Table, right: pa.Table) -> pa.Table:
        names, out = ["id", "content", "row", "score"], []
        if len(left) and len(right):
            block, chunk = Side(left, exact), Side(right, exact)
            content = left.column("content").to_pylist()
            out = [(block.id[a], content[a], chunk.id[r], s) for a, r, s in _best_same(block, chunk, positives)]
        return _columns(names, out)

    def other(left: pa.Table, right: pa.Table) -> pa.Table:
        names, out = ["id", "content", "place", "row", "score"], []
        if len(left) and len(right):
            block, chunk = Side(left, exact), Side(right, exact)
            content = left.column("content").to_pylist()
            out = [(block.id[a], content[a], p, chunk.id[r], s) for a, p, r, s in
                   _best_other(block, left.column("scores").to_pylist(), chunk, negatives, low_percent, high_percent)]
        return _columns(names, out)

    best = Window.partitionBy("id", "content").orderBy(F.desc("score"), "row")
    found = (met(anchors, same, "id long, content long, row long, score long")
             .withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
             .groupBy("id", "content").agg(F.sort_array(F.collect_list(F.struct("place", "row", "score"))).alias("found")))
    found = written(found, "positives")
    asked = anchors.join(found.select("id", "content", F.col("found.score").alias("scores")), ["id", "content"])
    first = Window.partitionBy("id", "content", "place").orderBy(F.desc("score"), "row")
    near = (met(asked, other, "id long, content long, place long, row long, score long")
            .withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives))
    of = F.get("found", F.col("place"))
    return (near.join(found, ["id", "content"])
            .select(F.col("id").alias("anchor_id"), of["row"].alias("positive_id"), "rank", F.col("row").alias("negative_id"),
                    of["score"].alias("positive_score"), F.col("score").alias("negative_score")))
