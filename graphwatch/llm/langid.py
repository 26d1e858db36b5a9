"""Language identification by rank-order profiles.

A text becomes words of letters in lower case with one blank before, between
and after them; its n-grams of one to three characters are counted (those of
blanks alone are left out) and ranked, most frequent first, ties in character
order. A language's profile ranks the n-grams counted over all training
documents of the language. A document's distance to a language is the sum, over
its own PROFILE most frequent n-grams, of how far each is out of place: the
difference of the two ranks, or PROFILE where the profile does not have it. The
language with the least distance is predicted.

Counting runs in numpy over slices of texts: an n-gram is one integer, made of
character numbers, so that a sort counts all texts of a slice at once. Partial
counts per (language, n-gram) are added up by Spark, and the profiles are
ranked there; only PROFILE rows a language reach the driver.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, prepare

GRAMS = 3                  # longest n-gram
PROFILE = 400              # ranks of a profile, and of a document
SLICE_CHARS = 1 << 18
HELD_GRAMS = 1 << 19       # distinct (language, n-gram) that a task holds before it passes them on
UNKNOWN = "und"
_BLANK = 32


@cache
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: what it counts as (lower case of letters, marks as
    they are, a blank for all else), and whether it is a letter."""
    kinds = np.zeros(0x110000, np.int32)
    letter = np.zeros(0x110000, bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            kinds[c] = ord(low) if len(low) == 1 else c
            letter[c] = kind == "L"
        else:
            kinds[c] = _BLANK
    return kinds, letter


@dataclass
class Counted:
    """n-grams of the texts of a slice: row, n-gram, count, by row and n-gram."""

    row: np.ndarray
    gram: np.ndarray           # index into ``names``
    count: np.ndarray
    names: list[str]
    lettered: np.ndarray       # rows that hold a letter


def count_grams(texts: list[str | None], longest: int = GRAMS) -> Counted:
    kinds, letter = _alphabet()
    joined = " ".join(t or "" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t or "") for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    lettered = np.logical_or.reduceat(np.append(letter[points], False), first[:-1]) if len(texts) else letter[:0]
    # one blank before each text, and none behind another blank
    chars = np.concatenate([[_BLANK], kinds[points], [_BLANK]]).astype(np.int32)
    kept = np.ones(len(chars), bool)
    kept[1:] = (chars[1:] != _BLANK) | (chars[:-1] != _BLANK)
    kept[:1] = True
    at = np.flatnonzero(kept)
    chars = chars[at]
    row = np.searchsorted(first[1:], at, side="right")     # the blank that ends a text begins the next
    numbers = np.zeros(int(chars.max()) + 1, np.uint64)     # characters numbered from 1, in their order
    numbers[chars] = 1
    letters = np.flatnonzero(numbers)
    numbers[letters] = np.arange(1, len(letters) + 1)
    number = numbers[chars]
    bits = np.uint64(max(1, int(len(letters) + 1).bit_length()))
    blank = chars == _BLANK
    keys = []
    for n in range(1, longest + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        code = np.zeros(m, np.uint64)
        for k in range(n):
            code = (code << bits) | number[k:k + m]
        code <<= bits * np.uint64(longest - n)
        # the blank before a word counts to the word's text; none has a blank inside, so words do not run into each other
        own = row[:m] if n == 1 else np.where(blank[:m], row[1:m + 1], row[:m])
        ok = ~blank[:m] if n == 1 else np.ones(m, bool)
        for k in range(1, n - 1):
            ok &= ~blank[k:k + m]
        keys.append((code | (own.astype(np.uint64) << (bits * np.uint64(longest))))[ok])
    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    keys, count = keys[begin], np.diff(np.append(begin, len(keys)))
    grams = keys & ((np.uint64(1) << (bits * np.uint64(longest))) - np.uint64(1))
    distinct = np.unique(grams)
    gram = np.searchsorted(distinct, grams)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    lookup = np.concatenate([[0], letters]).astype(np.uint32)
    spelled = np.column_stack([lookup[((distinct >> (bits * np.uint64(longest - 1 - k))) & mask).astype(np.int64)]
                               for k in range(longest)]) if len(distinct) else np.zeros((0, longest), np.uint32)
    names = [s.rstrip("\0") for s in _spell(spelled)]
    return Counted((keys >> (bits * np.uint64(longest))).astype(np.int64), gram, count, names, lettered)


def _spell(points: np.ndarray) -> list[str]:
    if not len(points):
        return []
    width = points.shape[1]
    whole = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[i:i + width] for i in range(0, len(whole), width)]


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of about SLICE_CHARS characters; a text is never cut."""
    values, lo, size = texts.to_pylist(), 0, 0
    for k, t in enumerate(values):
        size += len(t or "") + 1
        if size >= SLICE_CHARS or k + 1 - lo >= BATCH_ROWS:
            yield lo, values[lo:k + 1]
            lo, size = k + 1, 0
    if lo < len(values):
        yield lo, values[lo:]


def _count_languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], int] = {}

    def passed_on() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()),
                                           pa.array(list(held.values()), pa.int64())], names=["lang", "gram", "n"])

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for lo, texts in _slices(batch.column(1)):
            c = count_grams(texts)
            tags, tag = np.unique(langs[lo:lo + len(texts)].astype(str), return_inverse=True)
            flat = np.bincount(tag[c.row] * max(1, len(c.names)) + c.gram, weights=c.count, minlength=0)
            for k in np.flatnonzero(flat):
                key = (str(tags[k // len(c.names)]), c.names[k % len(c.names)])
                held[key] = held.get(key, 0) + int(flat[k])
            if len(held) > HELD_GRAMS:
                yield passed_on()
                held.clear()
    yield passed_on()


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", ranks: int = PROFILE) -> DataFrame:
    """(lang, gram, n, rank from 0): the ``ranks`` most frequent n-grams of each
    language over all rows; rows with a null language or text have no part."""
    prepare(docs.sparkSession)
    used = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).dropna()
    counts = (used.mapInArrow(_count_languages, "lang string, gram string, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", place - 1).filter(F.col("rank") < ranks)


@dataclass
class RankModel:
    """Profiles as a table: ``place[gram]`` is the row of ``ranks``, whose columns
    are the languages (PROFILE where a profile does not have the n-gram)."""

    langs: list[str]
    place: dict[str, int]
    ranks: np.ndarray
    size: int

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        c = count_grams(texts)
        out = [UNKNOWN] * len(texts)
        score = np.zeros(len(texts))
        if not self.langs or not len(c.row):
            return out, score
        # a document's own ranks: by count, ties by n-gram (the order that they come in)
        order = np.lexsort((c.gram, -c.count, c.row))
        row, gram = c.row[order], c.gram[order]
        begin = np.searchsorted(row, np.arange(len(texts) + 1))
        rank = np.arange(len(row)) - begin[row]
        top = rank < self.size
        row, gram, rank = row[top], gram[top], rank[top]
        known = np.array([self.place.get(name, len(self.ranks) - 1) for name in c.names], np.int64)
        theirs = self.ranks[known[gram]]
        apart = np.where(theirs < self.size, np.abs(theirs - rank[:, None]), self.size)
        total = np.column_stack([np.bincount(row, weights=apart[:, k], minlength=len(texts)) for k in range(len(self.langs))])
        used = np.bincount(row, minlength=len(texts))
        best = total.argmin(axis=1)
        least = total[np.arange(len(texts)), best]
        for i in np.flatnonzero(c.lettered & (used > 0)):
            out[i] = self.langs[best[i]]
            score[i] = 1 - least[i] / (used[i] * self.size)
        return out, score


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", ranks: int = PROFILE) -> RankModel:
    """The profiles on the driver: ``ranks`` rows a language."""
    rows = profiles(docs, lang_col, text_col, ranks).collect()
    langs = sorted({r["lang"] for r in rows})
    place = {g: i for i, g in enumerate(sorted({r["gram"] for r in rows}))}
    table = np.full((len(place) + 1, len(langs)), ranks, np.int64)
    column = {x: k for k, x in enumerate(langs)}
    for r in rows:
        table[place[r["gram"]], column[r["lang"]]] = r["rank"]
    return RankModel(langs, place, table, ranks)


def predict(docs: DataFrame, model: RankModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, lang_pred, score) for every row of ``docs``.

    ``score`` is 1 less the distance over its largest possible value. Equally
    near languages: the first by name. A text that is null, empty or without a
    letter, and every text where no language was learned, is ``und`` with score
    0. Repeated rows are answered as often as they come; other columns are not
    read, whatever their names; an empty table gives an empty result. Texts
    count whole."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)     # PROFILE rows a language

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in _slices(batch.column(1)):
                langs, score = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(langs, pa.string()),
                                                  pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(answer, schema)


def fold(id_column: Column, folds: int = 3) -> Column:
    """crc32 of an id written as text, modulo ``folds``; null for null."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(folds))
