"""Token counts that follow edits.

A document keeps a segment tree over its pre-token pieces (see ``tokens``):
leaves hold the bytes and ids of LEAF_PIECES pieces, inner nodes the sums of the
two below, and the root the document's token count. An edit is found by going
down the byte sums; only the text of the leaves that it touches is encoded
again, widened to neighbours until both borders are places where pieces may be
cut (the boundary context). The leaves' new sums are then carried up their paths.
A leaf may end up with more or fewer pieces than it began with, or with none:
the tree's shape stays as it was built.

Trees are rows (doc_id, text, tree) and can be kept as a table between edits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_slices
from .tokens import SLICE, PieceEncoder, encoder, ends_visibly, tokenizer_path

LEAF_PIECES = 32
EDITS = "array<struct<at:bigint,remove:bigint,insert:string>>"
TREES = "doc_id long, text string, tree binary"
COUNTED = "doc_id long, text string, tree binary, n_before long, n_tokens long, n_edits long, n_bytes long, reencoded long"


class Tree:
    """Nodes in heap order (root at 1), a row of (bytes, ids) each."""

    def __init__(self, nodes: np.ndarray):
        self.nodes, self.leaves = nodes, len(nodes) // 2

    @classmethod
    def build(cls, leaves: np.ndarray) -> Tree:
        size = 1
        while size < len(leaves):
            size *= 2
        nodes = np.zeros((2 * size, 2), np.int64)
        nodes[size:size + len(leaves)] = leaves
        while size > 1:
            nodes[size // 2:size] = nodes[size:2 * size].reshape(-1, 2, 2).sum(axis=1)
            size //= 2
        return cls(nodes)

    @classmethod
    def read(cls, raw: bytes) -> Tree:
        return cls(np.frombuffer(raw, "<i8").reshape(-1, 2).copy())

    def write(self) -> bytes:
        return self.nodes.astype("<i8").tobytes()

    @property
    def tokens(self) -> int:
        return int(self.nodes[1, 1])

    def find(self, byte: int) -> tuple[int, int]:
        """(leaf, first byte of it) that holds a byte; the last leaf with text
        for the end of the text."""
        byte = min(byte, max(0, int(self.nodes[1, 0]) - 1))
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            if byte - start >= self.nodes[node, 0]:
                start += int(self.nodes[node, 0])
                node += 1
        return node - self.leaves, start

    def put(self, leaf: int, size: int, ids: int) -> None:
        node = leaf + self.leaves
        change = np.array([size, ids]) - self.nodes[node]
        while node:
            self.nodes[node] += change
            node //= 2


def build_trees(b: np.ndarray, off: np.ndarray, ids_of: PieceEncoder) -> list[Tree]:
    """A tree for each text of a slice."""
    cut, counts = ids_of.counted(b, off)
    sizes = np.diff(np.append(cut, len(b)))
    first = np.searchsorted(cut, off)
    out = []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
        if s == e:
            out.append(Tree.build(np.zeros((1, 2), np.int64)))
            continue
        at = np.arange(0, e - s, LEAF_PIECES)
        out.append(Tree.build(np.column_stack([np.add.reduceat(sizes[s:e], at), np.add.reduceat(counts[s:e], at)])))
    return out


def _byte_edits(text: str, raw: bytes, edits: list[dict]) -> list[tuple[int, int, bytes]]:
    """Edits with byte places, in order, made not to overlap: places and sizes
    are held inside the text, and an edit that begins in what an earlier one
    removes begins where that ends."""
    out, last = [], 0
    plain = len(raw) == len(text)
    for e in sorted(edits, key=lambda e: (e["at"] or 0, e["remove"] or 0, e["insert"] or "")):
        s = min(max(e["at"] or 0, last), len(text))
        t = min(max((e["at"] or 0) + max(e["remove"] or 0, 0), s), len(text))
        last = t
        out.append((s, t, (e["insert"] or "").encode()))
    if plain:
        return out
    place = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    place = np.append(place, len(raw))
    return [(int(place[s]), int(place[t]), new) for s, t, new in out]


class Edited:
    """One document on its way through its edits."""

    def __init__(self, raw: bytes, tree: Tree, edits: list[tuple[int, int, bytes]]):
        self.raw, self.tree = raw, tree
        # runs of leaves: [first leaf, end leaf, first byte, end byte, edits]
        self.runs: list[list] = []
        for s, t, new in edits:
            if s == t and not new:
                continue
            run = self._cover(s, t) + [[(s, t, new)]]
            if self.runs and run[0] < self.runs[-1][1]:
                self.runs[-1] = self._joined(self.runs[-1], run)
            else:
                self.runs.append(run)
        self._widen()

    def _cover(self, s: int, t: int) -> list:
        leaf, start = self.tree.find(s)
        last, begin = self.tree.find(max(s, t - 1))
        return [leaf, last + 1, start, begin + int(self.tree.nodes[last + self.tree.leaves, 0])]

    @staticmethod
    def _joined(a: list, b: list) -> list:
        return [min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), a[4] + b[4]]

    def text(self, run: list) -> bytes:
        out, at = [], run[2]
        for s, t, new in run[4]:
            out += [self.raw[at:s], new]
            at = t
        return b"".join(out) + self.raw[at:run[3]]

    def _widen(self) -> None:
        """Widen runs until pieces may be cut at both borders. Untouched
        neighbours keep the border they had; a border is good where the run's
        text begins with a blank and ends visibly, or at the text's ends."""
        changed = True
        while changed:
            changed = False
            for k, run in enumerate(self.runs):
                new = self.text(run)
                left = run[2] > 0 and new[:1] != b" "
                right = run[3] < len(self.raw) and not (new and ends_visibly(new))
                if left:
                    leaf, start = self.tree.find(run[2] - 1)
                    run[0], run[2], changed = leaf, start, True
                if right:
                    leaf, start = self.tree.find(run[3])
                    run[1], run[3], changed = leaf + 1, start + int(self.tree.nodes[leaf + self.tree.leaves, 0]), True
                if k and run[0] < self.runs[k - 1][1]:
                    self.runs[k - 1:k + 1] = [self._joined(self.runs[k - 1], run)]
                    changed = True
                    break

    def finish(self, counts: list[int]) -> bytes:
        """Put the runs' new sums in place; the new text."""
        out, at = [], 0
        for run, n in zip(self.runs, counts):
            new = self.text(run)
            out += [self.raw[at:run[2]], new]
            at = run[3]
            self.tree.put(run[0], len(new), n)
            for leaf in range(run[0] + 1, run[1]):
                if self.tree.nodes[leaf + self.tree.leaves].any():
                    self.tree.put(leaf, 0, 0)
        return b"".join(out) + self.raw[at:]


def _planter(path: str):
    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [t.write() for _, b, off in text_slices(batch.column(1), SLICE)
                     for t in build_trees(b, off, encoder(path))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(trees, pa.binary()), *batch.columns[2:]],
                names=["doc_id", "text", "tree", *batch.schema.names[2:]])
    return plant


def _editor(path: str):
    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                work, before, edits_of = [], [], part.column(3).to_pylist()
                for text, tree, edits in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), edits_of):
                    raw = (text or "").encode()
                    t = Tree.read(tree)
                    before.append(t.tokens)
                    work.append(Edited(raw, t, _byte_edits(text or "", raw, [e for e in edits or [] if e])))
                again = [w.text(run) for w in work for run in w.runs]
                counts = [len(x) for x in ids_of.encode(pa.array(again, pa.large_binary()))]
                texts, at, touched = [], 0, []
                for w in work:
                    n = len(w.runs)
                    touched.append(sum(map(len, again[at:at + n])))
                    texts.append(w.finish(counts[at:at + n]))
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()),
                     pa.array([w.tree.write() for w in work], pa.binary()), pa.array(before, pa.int64()),
                     pa.array([w.tree.tokens for w in work], pa.int64()),
                     pa.array([len(e or []) for e in edits_of], pa.int64()),
                     pa.array([len(t) for t in texts], pa.int64()), pa.array(touched, pa.int64())],
                    names=[c.split()[0] for c in COUNTED.split(", ")])
    return edit


def plant_trees(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text, tree) and, where ``docs`` has a column ``edits``, that too.
    Null texts have the tree of the empty text. Other columns are left out."""
    prepare(docs.sparkSession)
    more = ["edits"] if "edits" in docs.columns else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    schema = TREES + (f", edits {EDITS}" if more else "")
    return rows.mapInArrow(_planter(tokenizer_path(tokenizer)), schema)


def with_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Attach a table (doc_id, at, remove, insert) to documents or trees, one
    array per document; documents without edits get an empty one."""
    cell = F.struct(F.col("at").cast("long").alias("at"), F.col("remove").cast("long").alias("remove"),
                    F.col("insert").cast("string").alias("insert"))
    lists = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(cell)).alias("edits"))
    return rows.drop("edits").join(lists, "doc_id", "left").withColumn("edits", F.coalesce("edits", F.array().cast(EDITS)))


def apply_edits(trees: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text, tree, edits) -> the edited text and tree, the token count
    before (n_before) and after (n_tokens), n_edits, n_bytes after, and how many
    bytes were encoded again (reencoded).

    ``at`` and ``remove`` count code points of the text before any edit; edits
    apply in the order of their places. Places beyond the text are its end, null
    or negative numbers 0, a null insert is empty, and an edit that begins in
    what an earlier one removes begins at that one's end. Null texts are empty.
    Repeated rows are answered one by one. An empty table gives an empty result.
    """
    prepare(trees.sparkSession)
    rows = trees.select("doc_id", "text", "tree", F.col("edits").cast(EDITS).alias("edits"))
    return rows.mapInArrow(_editor(tokenizer_path(tokenizer)), COUNTED)
