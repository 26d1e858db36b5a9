"""Quality classifier from weak labels.

Ten heuristic labellers vote good, bad or nothing on every document. The
votes of the whole corpus are counted per pattern (3**10 at most), and
expectation-maximisation over the counted patterns estimates how often each
labeller votes what, given a good or a bad document, together with the share of
good ones. The posterior of a pattern is the label of its documents; a hashed
linear scorer is trained on these labels and scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, SPACE, prepare, text_slices, word_hashes

LABELLERS = ("capitals", "symbols", "doubled", "wordless", "repetition", "echoes", "word_length", "sentences",
             "prose", "variety")
DIMS = 1024                # hashed features
TRAIN_ROWS = 8192          # about so many documents train the scorer (bounded sample, by hash of id and text)
THRESHOLD = 0.5            # documents that score less are rejected

_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LETTER = _UPPER.copy()
_LETTER[np.r_[97:123, 128:256]] = 1
_PLAIN = np.zeros(256, np.int64)                    # what running text is made of
_PLAIN[np.r_[48:58, 65:91, 97:123, 128:256, 32, 9:14]] = 1
for _c in b".,;:'\"()-?":
    _PLAIN[_c] = 1
_STATS = ("n_bytes", "n_words", "capitals", "symbols", "doubled", "distinct", "word_bytes", "per_stop", "short",
          "wordless", "echoes")


def statistics(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: (statistics of every text, bytes, offsets)."""
    for _, b, off in text_slices(texts):
        h, starts, ends, first = word_hashes(b, off, SPACE)

        def total(flags: np.ndarray, off: np.ndarray = off) -> np.ndarray:
            run = np.zeros(len(flags) + 1, np.int64)
            np.cumsum(flags, out=run[1:])
            return run[off[1:]] - run[off[:-1]]

        n = np.diff(off).astype(float)
        words = np.diff(first).astype(float)
        some, wsome = np.maximum(n, 1), np.maximum(words, 1)
        odd = 1 - _PLAIN[b]
        twice = np.zeros(len(b), np.int64)
        if len(b) > 1:
            twice[1:] = odd[1:] & (b[1:] == b[:-1])
        # words without a letter or digit, and words equal to the one before
        alnum = np.concatenate([[0], np.cumsum(~NOT_ALNUM[b])])
        wordless = alnum[ends] == alnum[starts]
        echo = np.zeros(len(h), bool)
        echo[1:] = h[1:] == h[:-1]
        echo[first[:-1][first[:-1] < len(h)]] = False
        distinct = np.array([len(np.unique(h[s:e])) for s, e in zip(first[:-1], first[1:])], float)
        yield np.column_stack([
            n, words, total(_UPPER[b]) / np.maximum(total(_LETTER[b]), 1), total(odd) / some,
            total(twice) / wsome, np.where(words > 0, distinct / wsome, 1.0),
            total(1 - SPACE[b].astype(np.int64)) / wsome,
            words / np.maximum(total((b == 46) | (b == 63) | (b == 33)), 1),
            total_words(ends - starts <= 3, first) / wsome, total_words(wordless, first) / wsome,
            total_words(echo, first) / wsome]) if len(n) else np.zeros((0, len(_STATS))), b, off


def total_words(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[first[1:]] - run[first[:-1]]


def votes(stats: np.ndarray) -> np.ndarray:
    """Votes of the labellers: 0 nothing, 1 good, 2 bad; one row per document."""
    s = dict(zip(_STATS, stats.T))

    def vote(good, bad) -> np.ndarray:
        return np.where(bad, 2, np.where(good, 1, 0))

    many = s["n_words"] >= 40
    never = np.zeros(len(stats), bool)
    calm = (s["symbols"] < 0.02) & (s["doubled"] < 0.02) & (s["capitals"] < 0.15)
    return np.column_stack([
        vote(never, s["capitals"] > 0.4),
        vote(never, s["symbols"] > 0.05),
        vote(never, s["doubled"] > 0.2),
        vote(never, s["wordless"] > 0.2),
        vote(never, many & (s["distinct"] < 0.2)),
        vote(never, many & (s["echoes"] > 0.3)),
        vote(never, (s["word_bytes"] < 2) | (s["word_bytes"] > 14)),
        vote(never, many & ((s["per_stop"] > 150) | (s["short"] < 0.02))),
        vote(calm & (s["wordless"] < 0.05), s["n_words"] < 2),
        vote(calm & (s["echoes"] < 0.05) & (s["n_words"] >= 2), s["echoes"] > 0.6)]).astype(np.int64)


_BASE = 3 ** np.arange(len(LABELLERS))


@dataclass
class LabelModel:
    """good: share of good documents; table[j, v, y]: how often labeller j votes
    v on documents of class y (0 bad, 1 good)."""

    good: float
    table: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes. Only votes that were cast
        count: bad documents are of many kinds, and the silence of the
        labellers that look for other kinds speaks for neither class."""
        j = np.arange(v.shape[1])
        cast = np.where((v > 0)[:, :, None], np.log(self.table[j, v]), 0.0)
        logs = cast.sum(axis=1) + np.log([1 - self.good, self.good])
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))


PRIOR_GOOD, RIGHT_BAD, RIGHT_GOOD = 0.8, 0.9, 0.95


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """EM over counted vote patterns. A weak prior (the weight of 2 % of the
    documents, bad votes right nine times of ten) keeps the classes named as
    the labellers name them, also where one class is absent."""
    n = max(1.0, float(counts.sum()))
    onehot = np.eye(3)[patterns]                                   # rows x labellers x votes
    spoken = np.einsum("r,rjv->jv", counts, onehot) / n
    prior = np.empty((patterns.shape[1], 3, 2))
    prior[:, 1, 1] = spoken[:, 1] * RIGHT_GOOD / PRIOR_GOOD
    prior[:, 1, 0] = spoken[:, 1] * (1 - RIGHT_GOOD) / (1 - PRIOR_GOOD)
    prior[:, 2, 0] = spoken[:, 2] * RIGHT_BAD / (1 - PRIOR_GOOD)
    prior[:, 2, 1] = spoken[:, 2] * (1 - RIGHT_BAD) / PRIOR_GOOD
    prior = np.clip(prior, 1e-4, 0.98)
    prior[:, 0] = np.maximum(1 - prior[:, 1] - prior[:, 2], 1e-3)
    prior /= prior.sum(axis=1, keepdims=True)
    weight = max(1.0, 0.02 * n)
    model = LabelModel(PRIOR_GOOD, prior)
    for _ in range(rounds):
        p = model.posterior(patterns)
        by = np.column_stack([counts * (1 - p), counts * p])       # rows x classes
        table = np.einsum("ry,rjv->jvy", by, onehot) + weight * prior
        table /= table.sum(axis=1, keepdims=True)
        good = (by[:, 1].sum() + PRIOR_GOOD * weight) / (n + weight)
        settled = abs(good - model.good) < 1e-9 and np.abs(table - model.table).max() < 1e-7
        model = LabelModel(float(good), table)
        if settled:
            break
    return model


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % DIMS


_STEPS = {"capitals": [.05, .15, .3, .5], "symbols": [.01, .02, .04, .06, .1, .2], "doubled": [.02, .1, .3, .6, 1.2],
          "distinct": [.1, .15, .2, .25, .3, .4, .5, .7], "word_bytes": [2, 3, 4, 5, 6, 7, 8, 9, 11, 14],
          "per_stop": [2, 5, 10, 20, 40, 80, 150], "short": [.03, .08, .15, .25, .4, .6], "wordless": [.02, .05, .1, .25, .4], "echoes": [.02, .05, .1, .3, .6],
          "n_words": [1, 2, 5, 10, 20, 40, 80, 160, 320, 640, 1280, 2560]}
_SLOTS = {k: np.array([_slot(f"{k}:{i}") for i in range(len(v) + 1)]) for k, v in _STEPS.items()}
_BYTE_PAIR = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)


def features(texts: pa.Array) -> np.ndarray:
    """Hashed features: root of each byte pair's share, and the step that each
    statistic lies in."""
    out = []
    for stats, b, off in statistics(texts):
        x = np.zeros((len(off) - 1, DIMS), np.float32)
        pair = _BYTE_PAIR[b[:-1].astype(np.int64) * 256 + b[1:]] if len(b) > 1 else np.zeros(0, np.int64)
        for i, (s, e) in enumerate(zip(off[:-1], off[1:])):
            if e - s > 1:
                x[i] = np.sqrt(np.bincount(pair[s:e - 1], minlength=DIMS) / (e - s - 1))
        for name, steps in _STEPS.items():
            at = _SLOTS[name][np.searchsorted(steps, stats[:, _STATS.index(name)], side="right")]
            x[np.arange(len(x)), at] += 1
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, DIMS), np.float32)


def _count_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(3 ** len(LABELLERS), np.int64)
    for batch in batches:
        for stats, _, _ in statistics(batch.column(0)):
            counts += np.bincount(votes(stats) @ _BASE, minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())],
                                     names=["pattern", "n"])


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column(1)).astype(np.float16)
        v = np.concatenate([votes(s) for s, _, _ in statistics(batch.column(1))] or [np.zeros((0, len(LABELLERS)), np.int64)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(v @ _BASE, pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())],
            names=["rank", "pattern", "x"])


def fit_scorer(x: np.ndarray, target: np.ndarray, steps: int = 300, penalty: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels (Adam, full batch, fixed start); the
    last weight is the constant. Both classes weigh the same."""
    x = np.column_stack([x.astype(np.float32), np.ones(len(x), np.float32)])
    target = target.astype(np.float32)
    good = float(np.clip(target.mean() if len(target) else 0.5, 0.02, 0.98))
    weight = target / (2 * good) + (1 - target) / (2 * (1 - good))
    w = np.zeros(x.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - target)) / max(1, len(x)) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def patterns_of(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // _BASE) % 3


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Label model from the votes on every document, scorer from about
    ``train_rows`` documents. The driver gets the counted patterns (59,049 at
    most) and the sample's features."""
    prepare(docs.sparkSession)
    text = F.col("text").cast("string").alias("text")
    counted = (docs.select(text).mapInArrow(_count_votes, "pattern long, n long")
               .groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect())
    codes = np.array([r["pattern"] for r in counted], np.int64)
    counts = np.array([r["n"] for r in counted], float)
    if not len(codes):
        return QualityModel(LabelModel(0.8, np.full((len(LABELLERS), 3, 2), 1 / 3)), np.zeros(DIMS + 1, np.float32))
    labels = fit_labels(patterns_of(codes), counts)
    rank = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11)
    share = min(1.0, train_rows / counts.sum())
    sample = (docs.select(rank.alias("rank"), text).filter(F.col("rank") <= int(share * 2 ** 53))
              .mapInArrow(_training_rows, "rank long, pattern long, x binary")
              .dropDuplicates(["rank"]).orderBy("rank").limit(2 * train_rows).collect())
    x = (np.stack([np.frombuffer(r["x"], np.float16) for r in sample]) if sample
         else np.zeros((0, DIMS), np.float16))
    target = labels.posterior(patterns_of(np.array([r["pattern"] for r in sample], np.int64)))
    return QualityModel(labels, fit_scorer(x, target))


def score_column(model: QualityModel, text: Column) -> Column:
    """Probability of good; null and empty texts score 0."""
    w = model.weights

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        arr = pa.Array.from_pandas(texts, type=pa.large_string())
        out = []
        for lo in range(0, len(arr), 2000):
            part = arr.slice(lo, 2000)
            z = features(part).astype(np.float64) @ w[:-1] + w[-1]
            size = np.array([len(t or "") for t in part.to_pylist()])
            out.append(np.where(size > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score(text.cast("string"))


def classify(docs: DataFrame, model: QualityModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, kept) for every row of ``docs``, in any order.

    Null and empty texts score 0 and are rejected. Equal texts score equally;
    repeated rows are returned as often as they come. Columns other than doc_id
    and text are not read. An empty table gives an empty result."""
    model = model or fit(docs)
    return (docs.select("doc_id", score_column(model, F.col("text")).alias("score"))
            .withColumn("kept", F.col("score") >= threshold))


def keep_good(docs: DataFrame, model: QualityModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    model = model or fit(docs)
    return docs.filter(score_column(model, F.col("text")) >= threshold)
