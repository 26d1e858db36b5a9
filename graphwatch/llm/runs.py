"""Periodic runs of words by string synchronising sets.

A run is a stretch of words that repeats with smallest period q, four periods
long or longer, and cannot be made longer on either side. For every scale
t = 4, 8, 16, ... the method looks for the periods t <= q < 2t:

* every position gets a hash of its window of t words; windows inside a region
  of a period of at most t/4 get none (these regions are the runs that smaller
  scales have found);
* a position belongs to the synchronising set if the smallest hash among the
  windows at i .. i+t is the one at i or at i+t. Whether it does depends on its
  context of 2t words alone, so equal contexts are in the set together;
* a run of such a period holds a member in its first t positions and the same
  context one period later, and nowhere between. Members with equal contexts,
  next to each other in the text, therefore propose (place, distance);
* a proposal is followed to both sides on the words themselves.

Periods 1 to 3, which the smallest scale leaves out, are found directly from
words that equal the q-th word behind them. Hashes only select and propose;
words are compared by content. Work is linear in the words times the scales.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import SPACE, mix64, prepare, text_slices, word_codes, word_spans

MIN_LENGTH = 6             # words of a run, at least
MIN_PERIODS = 4            # periods of a run, at least
SMALL = 3                  # periods found directly; the first scale is SMALL + 1
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                    T.StructField("period", T.LongType())])
_RUN_ARROW = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of true flags."""
    edge = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    edge = np.concatenate([[0] if len(flags) and flags[0] else [], edge,
                           [len(flags)] if len(flags) and flags[-1] else []]).astype(np.int64)
    return edge[::2], edge[1::2]


def _joined(ids: np.ndarray, step: int) -> np.ndarray:
    """Hashes of windows twice as long. Windows past the end hold the last
    text's end mark, which no other window holds."""
    out = ids * _LEFT
    out[:-step] += ids[step:] * _RIGHT
    return mix64(out)


def _small_periods(x: np.ndarray) -> list[np.ndarray]:
    found = []
    for q in range(1, SMALL + 1):
        begin, end = _stretches(x[:-q] == x[q:])
        ok = end - begin >= (MIN_PERIODS - 1) * q
        begin, end = begin[ok], end[ok]
        if q > 1 and len(begin):         # a prime period: the smallest, or all words are equal
            own = (x[begin[:, None] + np.arange(1, q)] != x[begin][:, None]).any(axis=1)
            begin, end = begin[own], end[own]
        found.append(np.column_stack([begin, end - begin + q, np.full(len(begin), q)]))
    return found


def _covered(runs: list[np.ndarray], where: np.ndarray, t: int) -> np.ndarray | None:
    """Positions whose window of t words lies in a run of a period of t/4 or less."""
    every = np.concatenate(runs)
    every = every[(every[:, 2] * 4 <= t) & (every[:, 1] >= t)]
    if not len(every):
        return None
    flags = np.zeros(len(where) + 1, np.int64)
    np.add.at(flags, np.searchsorted(where, every[:, 0]), 1)
    np.add.at(flags, np.searchsorted(where, every[:, 0] + every[:, 1] - t + 1), -1)
    return np.cumsum(flags[:-1]) > 0


def synchronising_set(ids: np.ndarray, t: int, without: np.ndarray | None) -> np.ndarray:
    """Positions i at which the smallest hash of the windows i .. i+t is that of
    the first or the last; windows of ``without`` have no hash."""
    if len(ids) <= t:
        return np.zeros(0, np.int64)
    v = ids if without is None else np.where(without, _NONE, ids)
    least, width = v, 1
    while width < t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:len(v) - t], v[t:])
    return np.flatnonzero(((least == v[:-t]) | (least == v[t:])) & (least != _NONE))


def find_runs(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All stretches of a smallest period q with MIN_PERIODS periods or more,
    as rows (start, length, period) over ``x``.

    ``x`` holds the word numbers of several texts, each followed by a number of
    its own; text d takes the places first[d] .. first[d+1]-1."""
    if len(x) < 2:
        return np.zeros((0, 3), np.int64)
    runs = _small_periods(x)
    size = np.diff(first) - 1
    where = np.arange(len(x))
    text = np.repeat(np.arange(len(size)), size + 1)
    ids, t = mix64(x.astype(np.uint64) + _LEFT), 1
    while t <= SMALL:
        ids, t = _joined(ids, t), 2 * t
    while True:
        long_enough = size[text] >= MIN_PERIODS * t
        if not long_enough.any():
            break
        if not long_enough.all():
            ids, where, text = ids[long_enough], where[long_enough], text[long_enough]
        members = synchronising_set(ids, t, _covered(runs, where, t))
        ids = _joined(ids, t)                            # hashes of the contexts, and the next scale's windows
        context = ids[members]
        order = np.argsort(context, kind="stable")
        left, right = members[order[:-1]], members[order[1:]]
        near = (context[order[1:]] == context[order[:-1]]) & (right - left >= t) & (right - left < 2 * t)
        near &= text[left] == text[right]
        left, step = left[near], (right - left)[near]
        if len(left):
            runs.append(_followed(x, first, text[left], where[left], step))
        t *= 2
    return np.concatenate(runs)


def _followed(x: np.ndarray, first: np.ndarray, text: np.ndarray, place: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The runs that proposals (text, place, distance) lie in."""
    order = np.lexsort((place, step, text))
    text, place, step = text[order], place[order], step[order]
    cut = np.flatnonzero((text[1:] != text[:-1]) | (step[1:] != step[:-1])) + 1
    found = []
    for s, e in zip(np.r_[0, cut], np.r_[cut, len(text)]):
        q, base = int(step[s]), int(first[text[s]])
        own = x[base:first[text[s] + 1]]
        breaks = np.flatnonzero(own[:-q] != own[q:])     # never empty: the end mark breaks
        at = np.searchsorted(breaks, place[s:e] - base)
        at = np.unique(at)
        end = breaks[at]
        begin = np.where(at > 0, breaks[at - 1] + 1, 0)
        ok = end - begin >= (MIN_PERIODS - 1) * q
        begin, end = begin[ok], end[ok]
        found.append(np.column_stack([begin + base, end - begin + q, np.full(len(begin), q)]))
    return np.concatenate(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, b, off in text_slices(batch.column(1)):
            starts, ends, first = word_spans(b, off, SPACE)
            words, codes = word_codes(b, starts, ends)
            n = len(off) - 1
            # every text is followed by an end mark of its own
            x = np.empty(len(codes) + n, np.int64)
            begin = first + np.arange(n + 1)
            mark = np.zeros(len(x), bool)
            mark[begin[1:] - 1] = True
            x[mark] = len(codes) + np.arange(n)
            x[~mark] = codes
            runs = find_runs(x, begin)
            flags = np.zeros(len(x) + 1, np.int64)
            runs = runs[runs[:, 1] >= MIN_LENGTH]
            np.add.at(flags, runs[:, 0] + runs[:, 2], 1)
            np.add.at(flags, runs[:, 0] + runs[:, 1], -1)
            dropped = np.cumsum(flags[:-1]) > 0
            kept = np.flatnonzero(~dropped[~mark])
            text_of = np.searchsorted(begin, runs[:, 0], side="right") - 1
            runs[:, 0] -= begin[text_of]
            order = np.lexsort((runs[:, 2], runs[:, 0], text_of))
            runs, text_of = runs[order], text_of[order]
            listed = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in runs.T], fields=list(_RUN_ARROW))
            texts = pc.binary_join(pa.ListArray.from_arrays(
                pa.array(np.searchsorted(kept, first).astype(np.int32)), words.take(pa.array(kept)).cast(pa.binary())), b" ")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n),
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(text_of, np.arange(n + 1)).astype(np.int32)), listed),
                 texts.cast(pa.string())], names=["id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, runs, collapsed) for every row of ``docs``.

    ``runs``: array of (start, length, period) in words, by start, then period.
    ``collapsed``: the words that no run repeats (of each run the first period
    stays), with one blank between. Words are separated by blanks and the bytes
    9 to 13. A null or empty text has no words, no runs and an empty
    ``collapsed``; rows that repeat are answered as often as they come; other
    columns are not read, whatever their names; an empty table gives an empty
    result. A text is worked on whole, in memory proportional to its words."""
    prepare(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("runs", T.ArrayType(RUN)),
                           T.StructField("collapsed", T.StringType())])
    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(_scan, schema)
