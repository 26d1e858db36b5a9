"""Fuzzy line duplicates.

Lines are normalised (letters and digits, lower-cased, one blank between words)
and equal ones counted as one. A line's SimHash is voted block by block: a hash
deals each word to one block, and a block's 64 bits are the majority of the bits
of its words' hashes. A changed word touches the block that the old word was in
and the one that the new word falls into, so by the pigeonhole principle lines
with fewer changes than half the blocks agree in a whole block; lines that agree
in one are compared. The number of blocks follows the number of words (some
three a block), several deals give every line about BLOCKS of them, and lines
whose number of words is near a step of that number are dealt both ways. Blocks
with too few letters to say anything are left out. Lines of few words are also
dealt by their three-letter pieces.

Candidates are verified by edit similarity, and one occurrence per connected
group is kept: the first by (doc_id, line number). In every block the line that
meets most others is the hub; each line is compared with the hub of most of its
blocks, and what that leaves in different groups is then compared pair by pair
where the lines of a block meet, so that no candidate is lost and no pair is
written.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, lower_ascii, mix64, prepare, ragged, text_slices, word_hashes, written
from .components import components

SIMILARITY = 0.8
BLOCKS = 20                # of a line, about, over all its deals
LETTERS_PER_BLOCK = 10.0   # at least, on average; up to twice as many
LETTERS = 14               # letters beyond the second of its words that a block must hold; a fifth of
LEAST_LETTERS = 6          # the line's in short lines, but so many at least
FEW_WORDS = 7              # lines of up to so many words are dealt by pieces too
PIECES_PER_BLOCK = 2.0
PIECES, LEAST_PIECES = 6, 2   # pieces that a block must hold; a seventh of the line's, but so many at least
NEAR_STEP = 0.1            # lines so near a step of the number of blocks (in powers of two) go both ways
FILTER_WORDS = 1 << 20     # 64-bit words of the table that tells which lines are candidates at all
BUCKET_BYTES = 16 << 20    # of pairs (key, id) in a bucket, at most on average
PACK_PAIRS = 1024          # of a bucket in one row, about
HELD_BYTES = 128 << 20     # of a bucket that are held at once
LOOKS = 128                # columns of an edit distance between two looks at whether it can still do
PAIRED = 1024              # lines of a block that are compared in one task, about, and against as many others
PAIRED_BYTES = 8 << 20     # of these lines, about
MET_IN_TASK = 16384        # lines that meet in a task, about
TOGETHER = 8192            # pairs whose edit distances are computed side by side
WAITING = 4 * TOGETHER     # pairs that wait for others, about
MASK_BYTES = 32 << 20      # of the tables that say where a line has a letter

_LINES = pa.schema([("doc_id", pa.int64()), ("of", pa.int64()), ("line_no", pa.int64()), ("digest", pa.binary()),
                    ("id", pa.int64()), ("copies", pa.int64()), ("keys", pa.binary())])
_PACKED = pa.schema([("bucket", pa.int32()), ("pairs", pa.binary())])
_SHARED = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("size", pa.int64())])
_TEXTS = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("line", pa.string())])
_GOLD = np.uint64(0x9E3779B97F4A7C15)


# -------------------------------------------------------------------- lines

def _cut(texts: pa.Array) -> Iterator[tuple]:
    """Per slice: first row, bytes in lower case, row offsets, line offsets."""
    for lo, b, off in text_slices(texts):
        # a line feed ends a row: lines are the rows of a finer cut
        yield lo, lower_ascii(b), off, np.unique(np.concatenate([off, np.flatnonzero(b == 10) + 1]))


def _normal(low: np.ndarray, cut: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The normalised lines: words with one blank between."""
    if not len(starts):
        return [b""] * (len(cut) - 1)
    held = np.append(_ALNUM[low], False)
    held[ends] = True                                   # one byte behind each word, for the blank
    text = np.append(low, np.uint8(32))
    text[ends] = 32
    # words that touch without a byte between them do so only where a text ends
    touch = np.flatnonzero(ends[:-1] == starts[1:])
    size = ends - starts + 1
    if len(touch):
        at = np.repeat(starts, size) + ragged(size)
        raw = text[np.minimum(at, len(text) - 1)]
        bounds = np.concatenate([[0], np.cumsum(size)])
        raw[bounds[1:] - 1] = 32
        raw[bounds[touch + 1]] = low[starts[touch + 1]]
    else:
        raw = text[held]
        bounds = np.concatenate([[0], np.cumsum(size)])
    whole = raw.tobytes()
    edges = bounds[first].tolist()
    return [whole[s:e - 1] if e > s else b"" for s, e in zip(edges[:-1], edges[1:])]


def _digest(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


_ALNUM = ~NOT_ALNUM
_BLANKED = bytes(32 if NOT_ALNUM[k] else k for k in range(256))
_STEP = math.log(1.04)
_CLASSES = np.array([min(255, int(math.log(max(1, n)) / _STEP)) for n in range(int(math.exp(256 * _STEP)) + 1)], np.uint64)


def line_hashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """55 bits for each line, from the hashes of its words in their order."""
    count = np.diff(first)
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        votes = mix64(h + _GOLD * (ragged(count) + 1).astype(np.uint64))
        out[full] = np.add.reduceat(votes, first[full])
    return mix64(out) >> np.uint64(9)


def line_ids(hashes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The hashes below a class of the lines' lengths: one class per 4 %."""
    return (_CLASSES[np.minimum(letters, len(_CLASSES) - 1)] << np.uint64(55) | hashes).view(np.int64)


def _inner(low: np.ndarray) -> np.ndarray:
    """The number of bytes before each that begin no letter."""
    out = np.zeros(len(low) + 1, np.int32)
    np.cumsum((low & 0xC0) == 0x80, dtype=np.int32, out=out[1:])
    return out


def _letters(low: np.ndarray, cut: np.ndarray, inner: np.ndarray, normal: list[bytes]) -> np.ndarray:
    """Code points of the normalised lines."""
    try:
        low.tobytes().decode()
    except UnicodeDecodeError:
        return np.array([len(x.decode("utf-8", "replace")) for x in normal], np.int64)
    return np.fromiter(map(len, normal), np.int64, len(normal)) - np.diff(inner[cut])


def _classes_apart(similarity: float) -> int:
    """How far the classes of two lines at ``similarity`` can lie apart."""
    return math.ceil(-math.log(max(similarity, 1e-9)) / _STEP)


# ----------------------------------------------------------------- SimHashes

def majority(votes: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each group of votes (``count`` of them from ``begin``) the bits that
    half of them or more have set. Counts are kept as bit planes, so that one
    operation counts all 64 bits."""
    order = np.argsort(-count, kind="stable")            # groups with a k-th vote come first
    begin, count = begin[order], count[order]
    most = int(count[0]) if len(count) else 0
    planes = [np.zeros(len(begin), np.uint64) for _ in range(max(1, most.bit_length()))]
    left = len(begin)
    for k in range(most):
        left = int(np.searchsorted(-count[:left], -k, side="left"))
        carry = votes[begin[:left] + k]
        for plane in planes[:(k + 1).bit_length()]:
            plane[:left], carry = plane[:left] ^ carry, plane[:left] & carry
    need = (count + 1) // 2
    enough = np.full(len(begin), ~np.uint64(0))
    for k, plane in enumerate(planes):
        wanted = np.where((need >> k) & 1, ~np.uint64(0), np.uint64(0))
        enough = (plane & ~wanted) | (~(plane ^ wanted) & enough)
    out = np.empty(len(begin), np.uint64)
    out[order] = enough
    return out


def _steps(n: np.ndarray, per_block: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of two of the numbers of blocks of lines of weight ``n``: one, or two
    near a step."""
    x = np.log2(np.maximum(n, 1) / per_block)
    return (np.maximum(np.floor(x - NEAR_STEP), least).astype(np.int64),
            np.maximum(np.floor(x + NEAR_STEP), least).astype(np.int64))


def _dealt(h: np.ndarray, weight: np.ndarray, first: np.ndarray, lines: np.ndarray, step: int, need: np.ndarray, kind: int
           ) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the blocks of ``lines``, each dealt into 2**step blocks."""
    m = 1 << step
    deals, used = -(-BLOCKS // m), min(m, BLOCKS)
    count = first[lines + 1] - first[lines]
    row = np.repeat(np.arange(len(lines)), count)
    at = np.arange(len(row)) + (first[lines + 1] - np.cumsum(count))[row]
    own = h[at]
    # the low bits of a hash deal, the high ones are the feature's identity
    low = ((own >> np.uint64(36)) << np.uint64(4)) | np.minimum(weight[at], 15).astype(np.uint64)
    low |= row.astype(np.uint64) * np.uint64(deals * used) << np.uint64(32)
    parts = []
    for r in range(deals):
        block = (own >> np.uint64(r * step)) & np.uint64(m - 1)
        packed = low + (block + np.uint64(r * used) << np.uint64(32))
        parts.append(packed[block < used] if used < m else packed)
    x = np.sort(np.concatenate(parts))
    if not len(x):
        return lines[:0], x
    fresh = np.ones(len(x), bool)
    fresh[1:] = x[1:] != x[:-1]
    x = x[fresh]                                         # a word counts once in its block
    group = x >> np.uint64(32)
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    count = np.diff(np.append(begin, len(x)))
    held = np.add.reduceat((x & np.uint64(15)).astype(np.int64), begin)
    group = group[begin]
    line = (group // np.uint64(deals * used)).astype(np.int64)
    strong = held >= need[lines[line]]
    begin, count, group, line = begin[strong], count[strong], group[strong], line[strong]
    sim = majority(mix64(x & np.uint64(0xFFFFFFF0)), begin, count)
    number = group % np.uint64(deals * used) + np.uint64(1024 * (step + 64 * kind))
    return lines[line], mix64(sim + _GOLD * (number + np.uint64(1)))


def block_keys(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, normal: list[bytes],
               inner: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) for all blocks of the lines of a slice that are ``wanted``, by line."""
    letters = ends - starts - (inner[ends] - inner[starts])
    found = _by_features(h, np.maximum(letters - 2, 0), first, wanted, LETTERS_PER_BLOCK, 1, LETTERS, LEAST_LETTERS, 5, 0)
    few = np.flatnonzero(wanted & (np.diff(first) > 0) & (np.diff(first) <= FEW_WORDS))
    if len(few):
        padded = [" " + normal[k].decode("utf-8", "replace") + " " for k in few]
        points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.array([len(t) for t in padded])
        of = np.repeat(np.arange(len(few)), sizes)[:-2]
        piece = mix64((points[:-2] * _GOLD + points[1:-1]) * _GOLD + points[2:])
        inside = ragged(sizes)[:-2] < sizes[of] - 2
        cut = np.concatenate([[0], np.cumsum(sizes - 2)])
        line, key = _by_features(piece[inside], np.ones(int(inside.sum()), np.int64), cut, np.ones(len(few), bool),
                                 PIECES_PER_BLOCK, 2, PIECES, LEAST_PIECES, 7, 1)
        found = np.concatenate([found[0], few[line]]), np.concatenate([found[1], key])
    order = np.argsort(found[0], kind="stable")
    return found[0][order], found[1][order]


def _by_features(h, weight, first, wanted, per_block: float, least: int, most: int, floor: int, share: int, kind: int
                 ) -> tuple[np.ndarray, np.ndarray]:
    taken = wanted & (np.diff(first) > 0)
    run = np.concatenate([[0], np.cumsum(np.minimum(weight, 15))])
    need = np.clip((run[first[1:]] - run[first[:-1]]) // share, floor, most)
    low, high = _steps(run[first[1:]] - run[first[:-1]], per_block, least)
    lines, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for step in np.unique(np.concatenate([low[taken], high[taken]])):
        which = np.flatnonzero(taken & ((low == step) | (high == step)))
        line, key = _dealt(h, weight, first, which, int(step), need, kind)
        lines.append(line)
        keys.append(key)
    return np.concatenate(lines), np.concatenate(keys)


# --------------------------------------------------------------- the operator

def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, low, off, cut in _cut(batch.column(2)):
            h, starts, ends, first = word_hashes(low, cut, NOT_ALNUM)
            normal = _normal(low, cut, starts, ends, first)
            begins = cut[:-1]
            row = np.searchsorted(off, begins, side="right") - 1
            number = np.arange(len(begins)) - np.searchsorted(begins, off[row])
            taken = pa.array(lo + row)
            doc_id, of = batch.column(0).take(taken), batch.column(1).take(taken)
            digests = [_digest(x) if x else None for x in normal]
            full = np.array([d is not None for d in digests], bool)
            # of a slice's equal lines the first in place has the keys
            place = np.lexsort((of.to_numpy(zero_copy_only=False), number, doc_id.fill_null(0).to_numpy(zero_copy_only=False),
                                doc_id.is_null().to_numpy(zero_copy_only=False)))
            place = place[full[place]].tolist()
            first_of = dict(zip((digests[k] for k in reversed(place)), reversed(place)))
            copies = np.bincount([first_of[digests[k]] for k in place], minlength=len(normal)) if place else np.zeros(len(normal), np.int64)
            inner = _inner(low)
            line, key = block_keys(h, starts, ends, first, normal, inner, copies > 0)
            ids = line_ids(line_hashes(h, first), _letters(low, cut, inner, normal))
            bounds = (8 * np.searchsorted(line, np.arange(len(normal) + 1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [doc_id, of, pa.array(number, pa.int64()), pa.array(digests, pa.binary()), pa.array(ids, mask=~full),
                 pa.array(copies, pa.int64(), mask=copies == 0),
                 pa.Array.from_buffers(pa.binary(), len(normal), [None, pa.py_buffer(bounds), pa.py_buffer(key.astype("<u8"))])],
                schema=_LINES)


# ------------------------------------------------------------ lines that meet

def _packer(buckets: int):
    """(id, keys) -> (bucket, pairs): the pairs (key, id) of one bucket, packed.
    A key's bucket depends on the key alone."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            keys = batch.column(1)
            edges = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset:keys.offset + len(keys) + 1]
            key = np.frombuffer(keys.buffers()[2], "u1")[edges[0]:edges[-1]].view("<u8") if edges[-1] > edges[0] else np.zeros(0, "<u8")
            held.append(np.column_stack([key.view("<i8"), np.repeat(batch.column(0).to_numpy(), np.diff(edges) // 8)]))
            n += len(key)
            if n >= min(buckets * PACK_PAIRS, 1 << 20):
                yield _packed(np.concatenate(held), buckets)
                held, n = [], 0
        if n:
            yield _packed(np.concatenate(held), buckets)
    return pack


def _packed(pairs: np.ndarray, buckets: int) -> pa.RecordBatch:
    bucket = ((pairs[:, 0].view(np.uint64) >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    bounds = (16 * np.append(begin, len(bucket))).astype(np.int32)
    cells = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(pairs[order])])
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin].astype(np.int32)), cells], schema=_PACKED)


def meeting(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (key, id) in any order: those of keys that hold two ids or more,
    each once, with the key's number of ids; and the places of one pair of every key."""
    order = np.argsort(pairs[:, 0])
    key = pairs[order, 0]
    again = key[1:] == key[:-1]
    one = order[np.r_[True, ~again]]
    pairs = pairs[order[np.r_[False, again] | np.r_[again, False]]]
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    pairs = pairs[fresh]                                 # copies from other slices
    begin = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]])[:len(pairs)]
    size = np.diff(np.append(begin, len(pairs)))
    size = np.repeat(size, size)
    return np.column_stack([pairs, size])[size > 1], one


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, size) of the keys that hold two ids or more, from packed pairs
    in order of their buckets. Of a bucket beyond HELD_BYTES one pair a key is
    held on; its rows may then come more than once, with the sizes found so far."""
    bucket, held, n, most = None, [], 0, HELD_BYTES
    for batch in batches:
        for of, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (of != bucket or n > most):
                pairs = np.frombuffer(b"".join(held), "<i8").reshape(-1, 2)
                rows, one = meeting(pairs)
                yield from _rows_of(rows)
                held = [pairs[one].tobytes()] if of == bucket else []
                n = sum(map(len, held))
                most = max(HELD_BYTES, 2 * n)
            bucket = of
            held.append(raw)
            n += len(raw)
    if held:
        yield from _rows_of(meeting(np.frombuffer(b"".join(held), "<i8").reshape(-1, 2))[0])


def _rows_of(rows: np.ndarray, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), most):
        part = np.ascontiguousarray(rows[lo:lo + most].T)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in part], schema=_SHARED)


# --------------------------------------------------------------- verification

def _agree(a: str, b: str) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _words_apart(a: str, b: str, most: int) -> int:
    """An upper bound of the edit distance: words compared one by one, those that
    differ written anew. Where the numbers of words differ, a word is also left
    out on one side if the next one fits the other side's. Ends beyond ``most``."""
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y):
        return sum(max(len(p), len(q)) for p, q in zip(x, y) if p != q)
    i = j = apart = 0
    m, n = len(x), len(y)
    while i < m and j < n and apart <= most:
        p, q = x[i], y[j]
        if p != q:
            if i + 1 < m and x[i + 1] == q:
                apart += len(p) + 1
                j -= 1
            elif j + 1 < n and y[j + 1] == p:
                apart += len(q) + 1
                i -= 1
            else:
                apart += max(len(p), len(q))
        i += 1
        j += 1
    return apart + sum(len(p) + 1 for p in x[i:]) + sum(len(q) + 1 for q in y[j:])


def _letters_apart(a: str, b: str) -> int:
    """A lower bound of the edit distance: the letters that one text has more of."""
    more, fewer, left = 0, 0, len(a) - len(b)
    for c in "etaoinshrdlucmfwypvbgk ":
        n = a.count(c) - b.count(c)
        left -= n
        if n > 0:
            more += n
        else:
            fewer -= n
    return max(more + max(left, 0), fewer + max(-left, 0))


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two texts is at most ``most``. What they
    begin and end with alike is left out; the rest goes by bit-parallel columns
    (Myers 1999), one integer as long as the longer text, and ends early where no
    cell of a column can lead to ``most``."""
    if _words_apart(a, b, most) <= most:
        return True
    k = _agree(a, b)
    a, b = a[k:], b[k:]
    k = _agree(a[::-1], b[::-1])
    a, b = a[:len(a) - k], b[:len(b) - k]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    if len(a) <= most:
        return True
    if _letters_apart(a, b) > most:
        return False
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    every = (1 << len(a)) - 1
    wide, wider = 2 * every + 1, 4 * every + 3           # sums and shifts reach beyond the rows
    up, down = every, 0
    for column in range(0, len(b), LOOKS):
        for c in b[column:column + LOOKS]:
            same = at.get(c, 0)
            diagonal = (((same & up) + up) ^ up) | same
            right = ((down | (wide ^ (diagonal | up))) << 1) | 1
            vertical = same | down
            up = (((up & diagonal) << 1) | (wider ^ (vertical | right))) & every
            down = right & vertical
        column = min(column + LOOKS, len(b))
        left = len(b) - column
        if column + up.bit_count() - down.bit_count() - left > most:
            return False
        if left and _least_at(up, down, len(a), column, left, most) > most:
            return False
    return True


def _least_at(up: int, down: int, rows: int, column: int, left: int, most: int, step: int = 16) -> int:
    """A lower bound of the distance by way of a column's cells: each sampled
    cell's value and the rest of the way, less what lies between two samples."""
    least = 1 << 40
    for i in range(max(0, column - most) // step * step, min(rows, column + most) + step, step):
        i = min(i, rows)
        mask = (1 << i) - 1
        cell = column + (up & mask).bit_count() - (down & mask).bit_count()
        least = min(least, cell + abs(rows - i - left))
    return least - step


def _most(one: np.ndarray, two: np.ndarray, similarity: float) -> np.ndarray:
    """The largest distance allowed to lines of these lengths; a hair more than the
    product, which is not exact."""
    return (np.maximum(one, two) * (1 - similarity) + 1e-9).astype(np.int64)


def near_pairs(lines: list[str], one: np.ndarray, two: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the edit distance of each pair of ``lines``, given by their numbers,
    is small enough: what ``within`` says, for many pairs side by side."""
    size = np.array([len(x) for x in lines], np.int64)
    # the longer line's letters are the rows, the other's the columns
    swap = size[one] < size[two]
    one, two = np.where(swap, two, one), np.where(swap, one, two)
    most = _most(size[one], size[two], similarity)
    out = (size[two] == 0) & (size[one] <= most)
    left = np.flatnonzero((size[one] - size[two] <= most) & (size[two] > 0))
    letters, kinds = _numbered(lines, np.unique(np.concatenate([one[left], two[left]])))
    left = left[_letters_allow(letters, one[left], two[left], most[left])]
    left = left[np.argsort(size[two[left]], kind="stable")]
    while len(left):
        # pairs of about the same length (few pairs take as long as some more), of as
        # many lines as their tables may hold
        alike, some = np.searchsorted(size[two[left]], size[two[left[0]]] * np.array([5, 16]) // 4 + 32, side="right")
        part = left[:min(max(alike, min(some, TOGETHER // 4)), TOGETHER)]
        longest = int(size[one[part]].max())
        rows, of = np.unique(one[part], return_index=True)
        if len(rows) > (held := max(1, MASK_BYTES // (8 * (longest // 64 + 1) * (kinds + 1)))):
            part = part[:np.sort(of)[held]]
        blocks = int(most[part].max()) // 64 + 2
        # microseconds a column, about
        if len(part) * (0.7 + longest * 6e-4) < (22 * blocks + 8) * (0.7 + len(part) * 6e-4):
            out[part] = [within(lines[a], lines[b], m)
                         for a, b, m in zip(one[part].tolist(), two[part].tolist(), most[part].tolist())]
        else:
            out[part] = _side_by_side(letters, kinds, one[part], two[part], most[part])
        left = left[len(part):]
    return out


def _numbered(lines: list[str], used: np.ndarray) -> tuple[dict[int, np.ndarray], int]:
    """The letters of the lines ``used`` as numbers from 0, and how many kinds there are."""
    points = {k: np.frombuffer(lines[k].encode("utf-32-le", "surrogatepass"), np.uint32) for k in used.tolist()}
    kinds = np.zeros(0x110000, bool)
    for x in points.values():
        kinds[x] = True
    number = np.cumsum(kinds) - 1
    return {k: number[x] for k, x in points.items()}, int(kinds.sum())


def _letters_allow(letters: dict[int, np.ndarray], one: np.ndarray, two: np.ndarray, most: np.ndarray, classes: int = 64
                   ) -> np.ndarray:
    """False where one line has so many more of some letters that the edit distance
    is beyond ``most``."""
    at = {k: row for row, k in enumerate(letters)}
    held = np.array([np.minimum(np.bincount(x % classes, minlength=classes), 30000) for x in letters.values()], np.int16)
    one, two = (np.array([at[k] for k in x.tolist()], np.int64) for x in (one, two))
    out = np.zeros(len(one), bool)
    for lo in range(0, len(one), TOGETHER):
        apart = held[one[lo:lo + TOGETHER]] - held[two[lo:lo + TOGETHER]]
        more = np.maximum(apart, 0).sum(axis=1, dtype=np.int64)
        fewer = more - apart.sum(axis=1, dtype=np.int64)
        out[lo:lo + TOGETHER] = np.maximum(more, fewer) <= most[lo:lo + TOGETHER]
    return out


def _masks(rows: list[np.ndarray], width: int) -> np.ndarray:
    """For every 64 places of each row and each letter the places that hold it, as bits."""
    size = np.array([len(x) for x in rows], np.int64)
    place, blocks = ragged(size), int(size.max() + 63) // 64
    # sums of different powers of two below 2**32 are exact in doubles
    cell = (place // 32 * len(rows) + np.repeat(np.arange(len(rows)), size)) * width + np.concatenate(rows)
    half = np.bincount(cell, np.exp2(place % 32), 2 * blocks * len(rows) * width).astype(np.uint64)
    half = half.reshape(blocks, 2, len(rows) * width)
    return half[:, 0] | half[:, 1] << np.uint64(32)


def _side_by_side(letters: dict[int, np.ndarray], kinds: int, one: np.ndarray, two: np.ndarray, most: np.ndarray
                  ) -> np.ndarray:
    """Whether the edit distances of pairs of lines, the longer one first, are at
    most ``most``: bit-parallel columns in blocks of 64 rows (Myers 1999, Hyyro
    2003), a step for all pairs at once. Rows beyond the diagonals that ``most``
    allows (Ukkonen 1985) are left out; the values at their edge are those of ways
    along it, so what is found within ``most`` is exact. Pairs of which no cell of a
    column can lead to ``most`` are dropped."""
    rows, at = np.unique(one, return_inverse=True)
    texts, of = np.unique(two, return_inverse=True)
    rows, texts = [letters[k] for k in rows.tolist()], [letters[k] for k in texts.tolist()]
    masks = _masks(rows, kinds + 1)
    m, n = np.array([len(x) for x in rows])[at], np.array([len(x) for x in texts])[of]
    codes = np.full((int(n.max()), len(texts)), kinds, np.int64)
    for k, x in enumerate(texts):
        codes[:len(x), k] = x
    at = at * (kinds + 1)
    pair = np.arange(len(one))
    out = np.zeros(len(one), bool)
    blocks, first = len(masks), 0
    one_bit, high, every = np.uint64(1), np.uint64(63), ~np.uint64(0)
    up, down = np.full((blocks, len(pair)), every), np.zeros((blocks, len(pair)), np.uint64)
    above = np.zeros(len(pair), np.int64)                # the cell over the first block

    def sized() -> tuple:
        return (int(((most - m + n) // 2).max()), int(((most + m - n) // 2).max()),
                *(np.empty(len(pair), np.uint64) for _ in range(7)))

    back, on, same, x, h, more, less, right, left = sized()
    for column in range(1, len(codes) + 1):
        while 64 * (first + 1) < column - back:
            above += np.bitwise_count(up[first]).astype(np.int64) - np.bitwise_count(down[first])
            first += 1
        above += 1
        last = min(blocks, (column + on - 1) // 64 + 1)
        symbol = codes[column - 1].take(of) + at
        right.fill(1)
        left.fill(0)
        for w in range(first, last):
            u, d = up[w], down[w]
            np.take(masks[w], symbol, out=same, mode="clip")
            np.bitwise_or(same, d, out=x)
            np.bitwise_or(same, left, out=same)
            np.bitwise_and(same, u, out=h)
            np.add(h, u, out=h)
            np.bitwise_xor(h, u, out=h)
            np.bitwise_or(h, same, out=h)
            np.bitwise_or(h, u, out=more)
            np.invert(more, out=more)
            np.bitwise_or(more, d, out=more)
            np.bitwise_and(u, h, out=less)
            np.right_shift(more, high, out=same)         # what the next block begins with
            np.right_shift(less, high, out=h)
            np.left_shift(more, one_bit, out=more)
            np.bitwise_or(more, right, out=more)
            np.left_shift(less, one_bit, out=less)
            np.bitwise_or(less, left, out=less)
            right, same, left, h = same, right, h, left
            np.bitwise_or(x, more, out=u)
            np.invert(u, out=u)
            np.bitwise_or(u, less, out=u)
            np.bitwise_and(more, x, out=d)
        ended = np.flatnonzero(n == column)
        if len(ended):
            value = above[ended]
            for w in range(first, last):
                rest = np.clip(m[ended] - 64 * w, 0, 64).astype(np.uint64)
                mask = np.where(rest == 64, every, (one_bit << np.minimum(rest, high)) - one_bit)
                value = value + np.bitwise_count(up[w, ended] & mask) - np.bitwise_count(down[w, ended] & mask)
            out[pair[ended]] = value <= most[ended]
        if column % 64 == 0 and column < len(codes):
            alive = (n > column) & (_leads_to(up[first:last], down[first:last], above, 64 * first, m - n + column) <= most)
            if alive.sum() < 0.75 * len(alive):
                pair, at, of, m, n, most, above = (v[alive] for v in (pair, at, of, m, n, most, above))
                if not len(pair):
                    break
                up, down = up[:, alive], down[:, alive]
                back, on, same, x, h, more, less, right, left = sized()
                # blocks that are left now are begun anew when they are reached
                up[(column + on) // 64 + 1:], down[(column + on) // 64 + 1:] = every, 0
    return out


def _leads_to(up: np.ndarray, down: np.ndarray, above: np.ndarray, row: int, target: np.ndarray, step: int = 16) -> np.ndarray:
    """A lower bound of the distances by way of a column's cells, of which every
    ``step``-th is looked at; ``target`` is the row of the diagonal that ends right."""
    blocks, pairs = up.shape
    least = above + np.abs(target - row)
    value = above
    up, down = (np.bitwise_count(np.ascontiguousarray(v).view(np.uint16)).reshape(blocks, pairs, 4) for v in (up, down))
    for w in range(blocks):
        for k in range(4):
            row += step
            value = value + up[w, :, k] - down[w, :, k]
            least = np.minimum(least, value + np.abs(target - row))
    return least - step


def _close(similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the largest distance allowed; a hair more than the product, which is not exact
            near = [within(a, b, int(max(len(a), len(b)) * (1 - similarity) + 1e-9))
                    for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))
    return verify


def _filter_words(ids: DataFrame) -> np.ndarray:
    """A table of FILTER_WORDS * 64 bits in which the last bits of every id of
    ``ids`` set one; so much reaches the driver, however many ids there are."""
    place = F.col("id").bitwiseAND(F.lit(FILTER_WORDS * 64 - 1))
    words = (ids.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("n"))
             .select("word", F.expr("shiftleft(1L, n)").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect())
    table = np.zeros(FILTER_WORDS, np.int64)
    for r in words:
        table[r["word"]] = r["bits"]
    return table.view(np.uint64)


def _texts(table):
    """(id, digest, line) of the lines whose id may be in the table."""
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            for _, low, _, cut in _cut(batch.column(0)):
                h, _, _, first = word_hashes(low, cut, NOT_ALNUM)
                hashes = line_hashes(h, first)
                place = hashes % np.uint64(FILTER_WORDS * 64)
                hit = (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)
                hit[np.diff(first) == 0] = 0
                hit = np.flatnonzero(hit)
                whole = low.tobytes().translate(_BLANKED)
                found = {b" ".join(whole[cut[k]:cut[k + 1]].split()): k for k in hit.tolist()}
                lines = [x.decode("utf-8", "replace") for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(line_ids(hashes[list(found.values())], np.array([len(x) for x in lines], np.int64))),
                     pa.array([_digest(x) for x in found], pa.binary()), pa.array(lines, pa.string())], schema=_TEXTS)
    return texts


def _meetings(members: DataFrame, tasks: int) -> DataFrame:
    """Lines with their ``blocks`` (key, parts) -> a row for every meeting of a line:
    each part of a block meets itself and every other part. Meetings lie together,
    the smaller part first."""
    own = F.pmod(F.xxhash64("node"), F.col("b.parts")).cast("int")
    other = F.transform(F.sequence(F.lit(0), F.col("b.parts") - 1),
                        lambda q: F.struct(F.least(own, q).alias("i"), F.greatest(own, q).alias("j")))
    rows = (members.select("*", F.explode("blocks").alias("b"))
            .select("id", "hub", "c", "line", F.col("b.key").alias("key"), own.alias("own"),
                    F.filter(F.transform("blocks", lambda x: x["key"]), lambda k: k < F.col("b.key")).alias("lower"),
                    F.explode(other).alias("m")))
    return (rows.select("key", F.col("m.i").alias("i"), F.col("m.j").alias("j"), "own", "id", "hub", "c", "lower", "line")
            .repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j", "own"))


def _meeting_pairs(rows: pa.RecordBatch, apart: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of the pairs to compare in whole meetings: of different groups,
    alike in size, not compared as line and hub, and without a smaller block in common."""
    key, i, j, own, ids, hub, c = (rows.column(k).to_numpy() for k in range(7))
    fresh = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
    begin = np.append(np.flatnonzero(fresh), len(key))
    meeting = np.cumsum(fresh) - 1
    # a row meets those behind it, or only those of the other part
    place, end = np.arange(len(key)), begin[meeting + 1]
    other = begin[:-1] + np.add.reduceat((own == i).astype(np.int64), begin[:-1])
    start = np.where(i == j, place + 1, np.where(own == i, other[meeting], end))
    size, lower = ids >> 55, rows.column(7)
    count = end - start
    total = np.cumsum(count)
    lo = 0
    while lo < len(key):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (PAIRED << 10), side="right")))
        one = np.repeat(place[lo:hi], count[lo:hi])
        two = np.repeat(start[lo:hi], count[lo:hi]) + ragged(count[lo:hi])
        lo = hi
        open_ = np.flatnonzero((c[one] != c[two]) & (np.abs(size[one] - size[two]) <= apart)
                               & (hub[one] != ids[two]) & (ids[one] != hub[two]))
        one, two = one[open_], two[open_]
        if len(one):
            used, of = np.unique(np.concatenate([one, two]), return_inverse=True)
            sets = [frozenset(x) for x in lower.take(pa.array(used)).to_pylist()]
            first = np.fromiter((sets[a].isdisjoint(sets[b]) for a, b in zip(of[:len(one)].tolist(), of[len(one):].tolist())),
                                bool, len(one))
            yield one[first], two[first]


def _compared(similarity: float):
    """(u, v) of the groups that a pair of lines links, from meetings that lie
    together. Pairs whose groups others have linked meanwhile are left out."""
    apart = _classes_apart(similarity)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        def links(lines: list[str], c: np.ndarray, one: np.ndarray, two: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = []
            for most in (2, len(one)):                   # pairs of two groups that are compared before they are looked at again
                names, of = np.unique(c, return_inverse=True)
                roots = np.array([root(x) for x in names.tolist()], np.int64)[of]
                left = roots[one] != roots[two]
                one, two = one[left], two[left]
                if not len(one):
                    break
                ends = np.sort(np.column_stack([roots[one], roots[two]]), axis=1)
                order = np.lexsort((ends[:, 1], ends[:, 0]))
                ends = ends[order]
                begin = np.flatnonzero(np.r_[True, (ends[1:] != ends[:-1]).any(axis=1)])
                now = np.zeros(len(one), bool)
                now[order] = ragged(np.diff(np.append(begin, len(ends)))) < most
                near = near_pairs(lines, one[now], two[now], similarity)
                for u, v in zip(c[one[now]][near].tolist(), c[two[now]][near].tolist()):
                    a, b = root(u), root(v)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        found.append((u, v))
                one, two = one[~now], two[~now]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["u", "v"])

        waiting: tuple[list, list, list, list] = ([], [], [], [])
        held, letters = 0, 0
        for rows in _together(batches):
            for one, two in _meeting_pairs(rows, apart):
                used, of = np.unique(np.concatenate([one, two]), return_inverse=True)
                taken = rows.take(pa.array(used))
                at = len(waiting[0])
                waiting[0].extend(taken.column(8).to_pylist())
                for k, x in enumerate((taken.column(6).to_numpy(), at + of[:len(one)], at + of[len(one):]), 1):
                    waiting[k].append(x)
                held, letters = held + len(one), letters + taken.column(8).nbytes
                if held >= WAITING or letters >= 4 * PAIRED_BYTES:
                    yield from links(waiting[0], *map(np.concatenate, waiting[1:]))
                    waiting = ([], [], [], [])
                    held, letters = 0, 0
        if held:
            yield from links(waiting[0], *map(np.concatenate, waiting[1:]))
    return compare


def _together(batches: Iterator[pa.RecordBatch], most: int = 4 * PAIRED) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, i, j) in batches of whole meetings, of about ``most`` rows or one meeting."""
    held, n = [], 0

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= most:
            rows = whole(held)
            where = np.column_stack([rows.column(k).to_numpy() for k in range(3)])
            end = np.flatnonzero((where[1:] != where[:-1]).any(axis=1))
            if len(end):
                yield rows.slice(0, int(end[-1]) + 1)
                rows = rows.slice(int(end[-1]) + 1)
            held, n = [rows], rows.num_rows
    if held:
        yield whole(held)


def _components(rows: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """(digest, component) of the lines that agree in a block with others to which
    their edit similarity is at least ``similarity``."""
    spark = rows.sparkSession
    buckets = max(16, lines.count() * BLOCKS * 16 // BUCKET_BYTES)
    packed = (lines.filter("copies is not null").select("id", "keys")
              .mapInArrow(_packer(buckets), "bucket int, pairs binary"))
    met = written(packed.repartition("bucket").sortWithinPartitions("bucket")
                  .mapInArrow(_meet, "key long, id long, size long"), "shared")
    shared = met.select("key", "id")
    # a block's hub is the line that meets most others in all its blocks: of
    # edited copies, the text that they were made from
    degree = met.groupBy("id").agg(F.sum("size").alias("degree"))
    hubs = shared.join(degree, "id").groupBy("key").agg(F.max_by("id", F.struct("degree", "id")).alias("hub"))
    most = _classes_apart(similarity)

    def alike_in_size(a: str, b: str) -> Column:
        return F.abs(F.shiftright(F.col(a), 55) - F.shiftright(F.col(b), 55)) <= most

    star = shared.join(hubs, "key").filter((F.col("hub") != F.col("id")) & alike_in_size("hub", "id"))
    first = star.groupBy("id", "hub").count().groupBy("id").agg(F.max_by("hub", F.struct("count", "hub")).alias("u"))
    first = written(first.select("u", F.col("id").alias("v")), "first")
    wanted = written(shared.select("id").distinct(), "wanted")
    table = spark.sparkContext.broadcast(_filter_words(wanted))
    texts = (rows.select("text").mapInArrow(_texts(table), "id long, digest binary, line string")
             .join(wanted, "id", "left_semi").dropDuplicates(["digest"]))
    # a line's node is a number as wide as ids, but never that of two digests
    texts = written(texts.withColumn("node", F.monotonically_increasing_id()), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(texts.select(F.col("id").alias("u"), F.col("node").alias("du"), F.col("line").alias("a")), "u")
                .join(texts.select(F.col("id").alias("v"), F.col("node").alias("dv"), F.col("line").alias("b")), "v"))
        return written(both.select(F.col("du").alias("u"), F.col("dv").alias("v"), "a", "b")
                       .mapInArrow(_close(similarity), "u long, v long"), "verified")

    # every line meets the hub that it shares most blocks with
    links = verified(first)
    named = written(components(links), "named")
    # only blocks that still hold two groups have pairs to compare; the lines of such
    # a block meet part by part
    group = F.coalesce("component", "node")
    lined = texts.join(named, "node", "left").select("id", "node", group.alias("c"), "line")
    label = written(lined.groupBy("id").agg(F.min("c").alias("c"), F.max(F.length("line")).alias("size")), "labels")
    split = (shared.join(label, "id").groupBy("key")
             .agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
             .filter("low != high")
             .select("key", F.greatest(F.ceil(F.col("n") / PAIRED), F.ceil(F.col("size") / PAIRED_BYTES)).cast("int").alias("parts")))
    blocks = (shared.join(split, "key").groupBy("id").agg(F.sort_array(F.collect_set(F.struct("key", "parts"))).alias("blocks"))
              .join(first.select(F.col("v").alias("id"), F.col("u").alias("hub")), "id", "left"))
    blocks = written(blocks.select("id", F.coalesce("hub", "id").alias("hub"), "blocks"), "open")
    rows_met = blocks.agg(F.sum(F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + b["parts"]))).first()[0]
    if rows_met:
        # what these pairs link are components, or lines alone
        tasks = max(2 * spark.sparkContext.defaultParallelism, rows_met // MET_IN_TASK)
        more = written(_meetings(lined.join(blocks, "id"), tasks).mapInArrow(_compared(similarity), "u long, v long"), "verified")
        joined = written(components(more), "joined")
        alone = joined.join(named.select("node"), "node", "left_anti")
        named = (named.toDF("node", "old").join(joined.toDF("old", "new"), "old", "left")
                 .select("node", F.coalesce("new", "old").alias("component")).unionByName(alone))
    return texts.select("node", "digest").join(named, "node").select("digest", "component")


def _line_groups(docs: DataFrame, similarity: float) -> DataFrame:
    """The columns of ``fuzzy_lines``, and ``of``: a hash of the line's text."""
    prepare(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("of"), text.alias("text"))
    lines = written(rows.mapInArrow(
        _scan, "doc_id long, of long, line_no long, digest binary, id long, copies long, keys binary"), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no", "of")
    named = _components(rows, lines, similarity)
    # only lines with copies or links need the places of others; a slice has one row at most for a line
    first = lines.filter("copies is not null")
    repeated = first.groupBy("digest").agg(F.sum("copies").alias("copies")).filter("copies > 1")
    needed = written(repeated.join(named, "digest", "full"), "needed")
    placed = written(first.select("digest", place.alias("at")).join(needed, "digest")
                     .groupBy("digest", "component", "copies").agg(F.min("at").alias("at")), "placed")
    linked = placed.filter("component is not null")
    of_group = linked.groupBy("component").agg(F.min("at").alias("g"))
    groups = (linked.join(of_group, "component").select("digest", F.coalesce("copies", F.lit(1)).alias("copies"), "g")
              .unionByName(placed.filter("component is null").select("digest", "copies", F.col("at").alias("g"))))
    out = _with_groups(lines, written(groups, "line-groups"), place)
    same = (F.col("doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("line_no") == F.col("g.line_no"))
            & F.col("of").eqNullSafe(F.col("g.of")))
    return out.select("doc_id", "line_no", F.col("g.doc_id").alias("group_doc"), F.col("g.line_no").alias("group_line"),
                      F.when(F.col("g").isNull(), True).otherwise(same).alias("kept"), "of")


def fuzzy_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, line_no, group_doc, group_line, kept) for every line of every
    text; lines are what line feeds part, numbered from 0.

    Two distinct normalised lines are linked where they agree in a block of
    their SimHashes and their edit distance is at most (1 - similarity) of the
    longer one's code points. (group_doc, group_line) is the group's first
    occurrence, null ids last; kept marks it. Lines without a letter or digit
    are in no group and kept. Null and empty texts have no lines. Rows that
    repeat an id are told apart by their texts; equal rows are kept alike.
    Other columns are not read. An empty table gives an empty result.
    """
    return _line_groups(docs, similarity).drop("of")


def _with_groups(lines: DataFrame, groups: DataFrame, place: Column) -> DataFrame:
    """Every line with its group: its own place where it has no copy and no link.
    A line that makes up over 1/1024 of all lines (1023 distinct ones at most)
    is sent to every task."""
    limit = max(lines.count() // 1024, 1)
    hot = F.broadcast(groups.filter(F.col("copies") > limit).select("digest", F.col("g").alias("hot_g")))
    marked = lines.select("doc_id", "of", "line_no", "digest").join(hot, "digest", "left")
    settled = marked.filter("hot_g is not null or digest is null").select("doc_id", "of", "line_no", F.col("hot_g").alias("g"))
    rest = (marked.filter("hot_g is null and digest is not null").select("doc_id", "of", "line_no", "digest")
            .join(groups.filter(F.col("copies") <= limit).select("digest", "g"), "digest", "left")
            .select("doc_id", "of", "line_no", F.coalesce("g", place).alias("g")))
    return settled.unionByName(rest)


def drop_fuzzy_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the lines that are not kept taken out of ``text``.

    Every row stays, with all its columns whatever their names; a text of which
    no line stays becomes empty, null stays null. Equal rows (same doc_id and
    text) lose the same lines. An empty table gives an empty result."""
    gone = (_line_groups(docs, similarity).filter("not kept").groupBy("doc_id", "of")
            .agg(F.collect_set("line_no").alias("gone"))
            .select(F.struct("doc_id", "of", "gone").alias("found")))
    text = F.col("row.text").cast("string")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    marked = rows.join(gone, F.col("row.doc_id").cast("long").eqNullSafe(F.col("found.doc_id"))
                       & (F.xxhash64(text) == F.col("found.of")), "left")
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("found.gone", i.cast("long")))
    cut = F.when(F.col("found").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return marked.select(*[cut.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
