"""Benchmark decontamination by CGK embedding and bit sampling.

Documents and benchmark items are sequences of words (letters and digits,
lower-cased; punctuation and layout do not count; in scripts written without
blanks every character is a word). The CGK embedding walks over
a sequence: at step t it writes the word it stands on and moves on one word or
stays, as bit t of a random hash of that word says. Two sequences at a small
edit distance fall into step again soon after each edit, so most steps write
the same word, and edit distance becomes Hamming distance (Chakraborty,
Goldenberg, Koucky). Sampling a few steps gives a locality-sensitive key.

Every word of a document starts a window (and, for a second family of walks
that run backwards, ends one). A window is compared with the items through the
sampled steps only, one after the other, so that nearly all windows are gone
after the first. Walks are repeated with new random bits until a leak at the
allowed edit distance is found with the target recall; the number comes from a
simulation on the items. What is left is verified by exact edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, lower_ascii, mix64, prepare, ragged, text_slices, word_hashes

EDIT_RATIO = 0.2          # a leak differs from its item in at most so many words a word of the item
TARGET_RECALL = 0.95
MIN_WORDS = 5             # shorter items are no evidence
PART_WORDS = 256          # longer items are looked for part by part
BLOCK_BYTES = 256 << 10   # items that one pass looks for
SAMPLED = 3
MAX_STEPS = 48
MAX_WALKS = 1024          # where these do not reach the target recall, the index is refused

_PAD = MAX_STEPS + PART_WORDS * 2
_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("part", pa.int64()), ("first_word", pa.int64()),
                   ("n_words", pa.int64()), ("edits", pa.int64())])


def _unspaced(b: np.ndarray) -> np.ndarray:
    """Where the characters of scripts without blanks (Thai, Lao, Burmese, Khmer,
    kana, Han) begin, and what follows each: all are three bytes long."""
    following = np.append(b[1:], np.uint8(0))
    lead = (((b >= 0xE3) & (b <= 0xE9)) | ((b == 0xE0) & (following >= 0xB8) & (following <= 0xBB))
            | ((b == 0xE1) & (((following >= 0x80) & (following <= 0x82)) | (following == 0x9E) | (following == 0x9F))))
    out = lead.copy()
    out[3:] |= lead[:-3]
    return out


def words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, first word of each row) over slices."""
    for lo, b, off in text_slices(texts):
        h, _, _, first = word_hashes(lower_ascii(b), off, NOT_ALNUM, _unspaced(b))
        yield lo, h, first


@dataclass
class Walk:
    """One repetition for one class of items: random bits, sampled steps, and
    the items' words at those steps."""

    seed: int
    backward: bool
    steps: tuple[int, ...]
    keys: list[np.ndarray] = field(default_factory=list)   # sorted keys after each sampled step
    owner: np.ndarray | None = None                        # item of each full key, in key order


@dataclass
class Index:
    ids: np.ndarray              # item id of each part
    numbers: np.ndarray          # its place in the item
    seqs: list[np.ndarray]       # vocabulary ids of each part's words
    vocabulary: np.ndarray       # sorted word hashes
    has: np.ndarray              # parts x vocabulary (+ unknown): word occurs in part
    walks: list[Walk]
    ratio: float


def _bits(h: np.ndarray, seed: int) -> np.ndarray:
    return mix64(h ^ np.uint64(seed))


def _move(bits: np.ndarray, pos: np.ndarray, start: int, stop: int) -> np.ndarray:
    for t in range(start, stop):
        pos = pos + ((bits[pos] >> np.uint64(t)) & np.uint64(1)).astype(np.int64)
    return pos


def _sampled_words(seq: np.ndarray, walk: Walk) -> list[int]:
    """Positions at the sampled steps of a walk over one sequence."""
    bits, pos, at, out = _bits(seq, walk.seed), 0, 0, []
    for t in walk.steps:
        while at < t and pos < len(seq) - 1:
            pos += (int(bits[pos]) >> at) & 1
            at += 1
        out.append(pos)
    return out


def _mutated(seq: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with so many random word edits (half substitutions, a quarter each
    insertions and deletions)."""
    out = list(seq)
    for _ in range(edits):
        kind, i = rng.integers(4), int(rng.integers(len(out)))
        word = np.uint64(rng.integers(1 << 62))
        if kind < 2:
            out[i] = word
        elif kind == 2:
            out.insert(i, word)
        elif len(out) > 1:
            del out[i]
    return np.array(out, np.uint64)


def build_index(items: list[tuple[int, np.ndarray]], ratio: float = EDIT_RATIO,
                recall: float = TARGET_RECALL) -> Index | None:
    """Index of (item id, word hashes). None where no item is long enough. Raises
    where MAX_WALKS walks do not reach ``recall``."""
    parts, numbers = [], []
    for i, h in items:
        # the last part takes what is too short to be one
        cuts = [*range(0, max(1, len(h) - MIN_WORDS + 1), PART_WORDS), len(h)]
        for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
            if e - s >= MIN_WORDS:
                parts.append((i, h[s:e]))
                numbers.append(k)
    if not parts:
        return None
    vocabulary = np.unique(np.concatenate([h for _, h in parts]))
    seqs = [np.searchsorted(vocabulary, h) for _, h in parts]
    has = np.zeros((len(parts), len(vocabulary) + 1), bool)
    for k, s in enumerate(seqs):
        has[k, s] = True
    lengths = np.array([len(s) for s in seqs])
    rng = np.random.default_rng(20240501)
    walks: list[Walk] = []
    # classes of like lengths: steps stay below the shortest of the class, so a
    # walk never leaves an item before its last sampled step
    for c in np.unique(np.log2(lengths).astype(int)):
        members = np.flatnonzero(np.log2(lengths).astype(int) == c)
        reach = min(MAX_STEPS, max(MIN_WORDS, 1 << int(c)))
        sample = members[rng.permutation(len(members))[:40]]
        trials = [(parts[k][1], _mutated(parts[k][1], int(ratio * lengths[k]), rng)) for k in sample for _ in range(3)]
        missed = np.ones(len(trials))                       # still not found, by trial
        for r in range(MAX_WALKS):
            first = int(rng.integers(min(4, reach // 2)))
            rest = np.sort(rng.permutation(np.arange(first + 1, reach))[:SAMPLED - 1])
            walk = Walk(int(rng.integers(1, 1 << 63)), bool(r % 2), (first, *map(int, rest)))
            turn = slice(None, None, -1) if walk.backward else slice(None)
            at = np.array([seqs[k][turn][_sampled_words(parts[k][1][turn], walk)] for k in members], np.int64)
            v = len(vocabulary) + 1
            key = at[:, 0].copy()
            walk.keys.append(np.unique(key))
            for j in range(1, SAMPLED):
                key = key * v + at[:, j] if v ** (j + 1) < 1 << 62 else mix64((key * v + at[:, j]).view(np.uint64)).view(np.int64)
                walk.keys.append(np.unique(key))
            order = np.argsort(key, kind="stable")
            walk.keys[-1], walk.owner = key[order], members[order]
            walks.append(walk)
            for i, (a, b) in enumerate(trials):
                if missed[i]:
                    x, y = a[turn], b[turn]
                    missed[i] = not np.array_equal(x[_sampled_words(x, walk)], y[_sampled_words(y, walk)])
            if r >= 3 and missed.mean() <= 1 - recall:
                break
        else:
            raise ValueError(f"{MAX_WALKS} walks find {1 - missed.mean():.2f} of the leaks of items of {1 << int(c)} words or more")
    return Index(np.array([i for i, _ in parts], object), np.array(numbers), seqs, vocabulary, has, walks, ratio)


def _candidates(index: Index, h: np.ndarray, known: np.ndarray) -> dict[bool, np.ndarray]:
    """(start word, part) that agree in all sampled steps of some walk, for both
    directions; starts count from the end for backward walks."""
    n, found = len(h), {False: [], True: []}
    v = len(index.vocabulary) + 1
    padded = {}
    for back in (False, True):
        turn = slice(None, None, -1) if back else slice(None)
        padded[back] = (np.concatenate([h[turn], np.zeros(_PAD, np.uint64)]),
                        np.concatenate([known[turn], np.full(_PAD, v - 1)]))
    for walk in index.walks:
        hashes, vid = padded[walk.backward]
        bits = _bits(hashes, walk.seed)
        may = np.zeros(v, bool)
        may[walk.keys[0]] = True
        pos = _move(bits, np.arange(n), 0, walk.steps[0])
        key = vid[pos]
        start = np.flatnonzero(may[key])
        pos, key = pos[start], key[start]
        for j in range(1, SAMPLED):
            pos = _move(bits, pos, walk.steps[j - 1], walk.steps[j])
            key = key * v + vid[pos]
            if v ** (j + 1) >= 1 << 62:
                key = mix64(key.view(np.uint64)).view(np.int64)
            at = np.searchsorted(walk.keys[j], key)
            at[at == len(walk.keys[j])] = 0
            ok = walk.keys[j][at] == key
            start, pos, key = start[ok], pos[ok], key[ok]
        lo, hi = np.searchsorted(walk.keys[-1], key), np.searchsorted(walk.keys[-1], key, side="right")
        many = hi - lo
        if many.sum():
            owner = walk.owner[np.repeat(lo, many) + ragged(many)]
            found[walk.backward].append(np.repeat(start, many) * len(index.seqs) + owner)
    return {k: np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for k, x in found.items()}


def edit_distance(window: np.ndarray, size: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edit distance of ``item`` to the best prefix of each window (rows; -1
    beyond the window's size), and that prefix's length. Words beyond ``size``
    are no part of the window."""
    c, m = window.shape
    j = np.arange(m + 1)
    row = np.broadcast_to(j, (c, m + 1)).astype(np.int32)
    for i, word in enumerate(item, 1):
        step = np.minimum(row[:, :-1] + (window != word), row[:, 1:] + 1)
        row = np.concatenate([np.full((c, 1), i, np.int32), step], axis=1)
        row = (np.minimum.accumulate(row - j, axis=1) + j).astype(np.int32)
    row = np.where(j[None, :] <= size[:, None], row, 1 << 30)
    end = row.argmin(axis=1)
    return row[np.arange(c), end], end


def find(index: Index, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(row, part, first word, words, edits): each text's best window for each
    part that it holds."""
    out = []
    for lo, h, first in words(texts):
        if not len(h):
            continue
        at = np.searchsorted(index.vocabulary, h)
        at[at == len(index.vocabulary)] = 0
        known = np.where(index.vocabulary[at] == h, at, len(index.vocabulary))
        row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for back, pairs in _candidates(index, h, known).items():
            start, part = np.divmod(pairs, len(index.seqs))
            for k in np.unique(part):
                seq = index.seqs[k]
                allowed = int(index.ratio * len(seq))
                s = start[part == k]
                word = len(h) - 1 - s if back else s                 # the window's outer word
                row = row_of[word]
                room = word - first[row] + 1 if back else first[row + 1] - word
                size = np.minimum(room, len(seq) + allowed)
                ok = size >= len(seq) - allowed
                word, row, size = word[ok], row[ok], size[ok]
                for p in range(0, len(word), 2000):
                    w, sz = word[p:p + 2000], size[p:p + 2000]
                    j = np.arange(len(seq) + allowed)
                    places = w[:, None] - j if back else w[:, None] + j
                    window = np.where(j < sz[:, None], known[np.clip(places, 0, len(h) - 1)], -1)
                    near = (index.has[k][window] & (window >= 0)).sum(axis=1) >= len(seq) - allowed
                    if not near.any():
                        continue
                    w, sz, rows = w[near], sz[near], row[p:p + 2000][near]
                    d, end = edit_distance(window[near], sz, seq[::-1] if back else seq)
                    for x, r, e, n in zip(w[d <= allowed], rows[d <= allowed], d[d <= allowed], end[d <= allowed]):
                        f = int(x - n + 1 if back else x) - int(first[r])
                        new = (int(e), f, int(n))
                        if new < best.get((int(r), int(k)), (1 << 30, 0, 0)):
                            best[int(r), int(k)] = new
        out += [(lo + r, k, f, n, e) for (r, k), (e, f, n) in sorted(best.items())]
    return out


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items in blocks of about ``block_bytes`` of text, one at a time on the
    driver. Items too short to be evidence are left out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-int(total) // block_bytes))
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().collect()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        block = []
        for lo, h, first in words(pa.array([r["text"] for r in rows], pa.string())):
            block += [(rows[lo + i]["item_id"], h[first[i]:first[i + 1]]) for i in range(len(first) - 1)]
        yield block


def _indexes(benchmark: DataFrame, ratio: float, recall: float) -> list[Index]:
    built = (build_index(block, ratio, recall) for block in benchmark_blocks(benchmark))
    return [i for i in built if i is not None]


def leaks(docs: DataFrame, benchmark: DataFrame, ratio: float = EDIT_RATIO,
          recall: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, item_id, part, first_word, n_words, edits): one row for each
    document and part of a benchmark item of which the document holds a copy that
    differs in at most ``ratio`` of the part's words, with the copy's best place.

    An item of up to 256 words is one part (number 0); a longer one is looked for
    in parts of 256 words, the last one up to four words longer, and each part
    that a document holds is a leak. Null and empty texts and items hold nothing;
    items of fewer than five words (characters, in scripts without blanks) are no
    evidence and are not looked for. Repeated documents and items are reported
    once per doc_id, item_id and part. Other columns are not read. Empty tables
    give an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in _indexes(benchmark, ratio, recall):
        sent = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                hits = find(index, batch.column(1))
                ids = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[r] for r, *_ in hits], pa.int64()),
                     pa.array([index.ids[k] for _, k, *_ in hits], pa.int64()),
                     pa.array([index.numbers[k] for _, k, *_ in hits], pa.int64()),
                     *(pa.array([h[i] for h in hits], pa.int64()) for i in (2, 3, 4))], schema=_HITS)

        part = rows.mapInArrow(scan, "doc_id long, item_id long, part long, first_word long, n_words long, edits long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.limit(0).selectExpr("doc_id", "doc_id as item_id", "doc_id as part", "doc_id as first_word",
                                        "doc_id as n_words", "doc_id as edits")
    best = F.min(F.struct("edits", "first_word", "n_words")).alias("b")
    return (out.groupBy("doc_id", "item_id", "part").agg(best)
            .select("doc_id", "item_id", "part", "b.first_word", "b.n_words", "b.edits"))


def leak_flag(index_sent, text: Column) -> Column:
    @F.pandas_udf("boolean")
    def held(texts: pd.Series) -> pd.Series:
        flag = np.zeros(len(texts), bool)
        for hit in find(index_sent.value, pa.Array.from_pandas(texts, type=pa.string())):
            flag[hit[0]] = True
        return pd.Series(flag)

    return held(text.cast("string"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, ratio: float = EDIT_RATIO,
               recall: float = TARGET_RECALL) -> DataFrame:
    """The documents that hold no part of a benchmark item (see ``leaks``), with all
    their columns whatever their names. Null and empty texts hold none and stay;
    rows that repeat stay alike. Empty tables give an empty result, and all
    documents where the benchmark is empty."""
    prepare(docs.sparkSession)
    for index in _indexes(benchmark, ratio, recall):
        docs = docs.filter(~leak_flag(docs.sparkSession.sparkContext.broadcast(index), F.col("text")))
    return docs
