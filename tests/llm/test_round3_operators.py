"""Periodic runs, hard negatives and language identification against brute
force, with the awkward cases: nulls, empty and very long texts, ties, repeated
rows, empty tables, other columns with clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphwatch.llm import hardneg, langid, queries, runs

CLASHING = "id long, runs string, collapsed int, start long, lang_pred string, score string, gram string, n long"


def _frame(spark, rows, schema):
    extra = (7, "r", 1, 2, "x", "y", "g", 3)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{schema}, {CLASHING}").coalesce(3)


# ---------------------------------------------------------------- 11 periodic runs

def _words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def _runs(w):
    """All runs (start, length, period), by comparing every period."""
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            smallest = not any(q % p == 0 and s <= i and s + m >= i + length for s, m, p in found)
            if j > i and length >= max(6, 4 * q) and smallest:
                found.append((i, length, q))
            i = max(i + 1, j)
    return sorted((s, m, q) for s, m, q in found)


def _collapsed(w, found):
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def _texts(rng):
    out = [None, "", " \n\t ", "one", "a a a a a", "a a a a a a", "a\tb\na b  a b\x0ba b\x0ca b", "x " * 3000, "a b " * 4 + "b a " * 5,
           "a a b a a b a a b a a b", "é é é é é é é", "a a a a a b b b b b b", ("p q r s t u v " * 500)[:-3]]
    for _ in range(120):
        w = [rng.choice("abcdefgh"[:rng.choice([1, 2, 3, 8])]) * rng.choice([1, 1, 2]) for _ in range(rng.choice([3, 20, 90, 300]))]
        for _ in range(rng.randint(0, 3)):
            q, at, s = rng.randint(1, 25), rng.randrange(len(w)), rng.randrange(len(w))
            c = w[s:s + q] * rng.randint(2, 9)
            w[at:at] = c[:len(c) - rng.randint(0, q - 1)]
        out.append(" ".join(w))
    return out


def test_runs_against_every_period(spark):
    texts = _texts(random.Random(2))
    rows = list(enumerate(texts)) + [(3, texts[4]), (None, "z z z z z z z"), (None, None)]
    got = {}
    for r in runs.periodic_runs(_frame(spark, rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(([(x.start, x.length, x.period) for x in r.runs], r.collapsed))
    assert sum(map(len, got.values())) == len(rows)
    some = 0
    for k, t in rows:
        w = _words(t)
        found = _runs(w)
        some += len(found)
        assert (found, _collapsed(w, found)) in got[k]
    assert some > 60


def test_runs_of_two_thousand_words_at_every_scale(spark):
    rng = random.Random(5)
    w = [str(rng.randrange(10 ** 6)) for _ in range(600)]
    for q in (1, 2, 3, 4, 7, 8, 15, 16, 31, 33, 64, 100):
        w += [f"{q}.{k}" for k in range(q)] * 4 + [str(rng.randrange(10 ** 6)) for _ in range(5)]
    (r,) = runs.periodic_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).collect()
    assert [(x.start, x.length, x.period) for x in r.runs] == [x for x in _runs(w)]
    assert [x.period for x in r.runs] == [2, 3, 4, 7, 8, 15, 16, 31, 33, 64, 100]      # one word four times is too short


def test_no_documents_have_no_runs(spark):
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_synchronising_sets_are_consistent():
    """Equal contexts of 2t words are in the set together."""
    rng = np.random.default_rng(3)
    x = np.tile(rng.integers(0, 50, 40), 6)
    x = np.concatenate([x, rng.integers(0, 3, 300), [1000]])
    ids = runs.mix64(x.astype(np.uint64))
    t = 1
    for _ in range(3):
        members = set(runs.synchronising_set(ids, t, None).tolist())
        seen = {}
        for i in range(len(x) - 2 * t):
            key = tuple(x[i:i + 2 * t])
            assert seen.setdefault(key, i in members) == (i in members)
        ids, t = runs._joined(ids, t), 2 * t


def test_query_of_runs(spark, tmp_path):
    rng = random.Random(11)
    texts = {i: t for i, t in enumerate(_texts(rng) + [" ".join(str(rng.randrange(50)) for _ in range(200)) for _ in range(150)])}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    planted = 0
    for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect():
        w, h = _words(texts[r.doc_id]), zlib.crc32(str(r.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        found = _runs(w)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        assert r.n_runs == len(found)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(_collapsed(w, found).encode()).hexdigest()
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == (
            (*best, 1000 * best[1] // best[2]) if best else (None, None, None, None))
    assert planted > 10


# ---------------------------------------------------------------- 12 hard negatives

VECTORS = "vec_id long, label string, vector array<long>, anchor boolean"
MORE = "id long, chunk string, block int, content string, place int, score string, found int, row int"


def _mined(rows, k=5, m=5, low=80, high=100):
    used = [(i, lab, v, a) for i, lab, v, a in rows if None not in (i, lab, v) and None not in v]

    def score(x, y):
        return sum(p * q for p, q in zip(x, y))

    out = []
    for i, lab, v in {(i, lab, tuple(v)) for i, lab, v, a in used if a}:
        ranked = sorted((-score(v, w), j, other) for j, other, w, _ in used)
        for s, j, _ in [x for x in ranked if x[2] == lab and x[1] != i][:k]:
            near = [(-t, j2) for t, j2, other in ranked if other != lab and -s * low <= -t * 100 <= -s * high]
            out += [(i, j, r + 1, j2, -s, t) for r, (t, j2) in enumerate(near[:m])]
    return sorted(out)


def _vectors(rng, n, width=64, spread=60):
    centres = [[rng.gauss(0, spread) for _ in range(width)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, rng.choice("abc"), [math.floor(x + rng.gauss(0, spread / 2)) for x in c], i % 10 == 0))
    return rows


def _checked(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "c", 2, "d", 3, "e", 4, 5) for r in rows], f"{VECTORS}, {MORE}").coalesce(2)
    got = hardneg.mine_hard_negatives(df, F.col("anchor"), **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def test_hard_negatives_over_many_chunks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "CHUNK_ROWS", 70)
    monkeypatch.setattr(hardneg, "BLOCK_ANCHORS", 20)
    rows = _vectors(random.Random(4), 400)
    expected = _mined(rows)
    assert len(expected) > 300
    assert _checked(spark, rows) == expected


def test_hard_negatives_of_awkward_rows(spark):
    rng = random.Random(6)
    rows = _vectors(rng, 60, width=5, spread=3)
    same = [4, 4, 0, -1, 2]
    rows += [(100 + k, "abc"[k % 3], same, k in (0, 1)) for k in range(40)]           # one vector many times: ties by id
    rows += [(200, None, same, True), (201, "a", None, True), (202, "a", [1, None, 2, 3, 4], True), (None, "a", same, True)]
    rows += [(203, "a", [], True), (204, "b", [9], True), (205, "c", [0, 0, 0, 0, 0, 0, 7], False), (206, "d", same, True)]
    rows += [(207, "a", [-x for x in same], True)]
    assert _checked(spark, rows) == _mined([(i, lab, v and (v + [0] * 7)[:7] if v is not None else v, a) for i, lab, v, a in rows])
    few = _checked(spark, rows, positives=2, negatives=3, low_percent=50, high_percent=90)
    assert few == _mined([(i, lab, (v + [0] * 7)[:7] if v is not None else v, a) for i, lab, v, a in rows], 2, 3, 50, 90)


def test_repeated_rows_count_as_often_as_they_come(spark):
    rows = [(0, "a", [3, 1], True), (0, "a", [3, 1], True), (1, "a", [2, 2], False), (1, "a", [2, 2], False), (2, "b", [2, 2], False),
            (2, "b", [2, 2], False), (0, "b", [1, 1], True)]
    assert _checked(spark, rows) == _mined(rows)


def test_bounds_hold(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (50, 64))
    side = hardneg.Side(_table(x), np.float64)
    exact = x @ x.T
    at = np.arange(50)
    widths = []
    for level in range(len(side.levels)):
        low, high = side.bounds(at, side, at, level)
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).mean())
    assert widths == sorted(widths, reverse=True) and len(widths) == 4


def _table(x):
    parts = x.reshape(len(x), hardneg.SEGMENTS, -1).astype(float)
    mean = parts.mean(axis=2)
    dev = np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))
    return pa.table({"id": np.arange(len(x)), "label": ["a"] * len(x), "vec": [r.astype(np.int32).tobytes() for r in x],
                     "mean": [r.tobytes() for r in mean], "dev": [r.tobytes() for r in dev]})


def test_no_anchors_and_no_rows(spark):
    rows = [(1, "a", [1, 2], False), (2, "b", [1, 2], None)]
    assert _checked(spark, rows) == []
    assert hardneg.mine_hard_negatives(spark.createDataFrame([], VECTORS), F.col("anchor")).count() == 0
    with pytest.raises(ValueError):
        hardneg.mine_hard_negatives(spark.createDataFrame([(1, "a", [1 << 31], True)], VECTORS), F.col("anchor"))


def test_query_of_hard_negatives(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)], rng.randrange(10)) for i in range(300)]
    rows += [(300, [0.1] * 8, None), (301, None, 3), (302, [0.1, float("nan")] * 4, 3), (303, [float("inf")] + [0.1] * 7, 3),
             (304, [None] + [0.1] * 7, 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(np.float32(x))) for x in v], i % 100 == 0)
             for i, v, lab in rows[:300]]
    got = queries.op12_hard_negatives(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == _mined(whole)


# ---------------------------------------------------------------- 13 language id

def _grams(text):
    out = Counter()
    kept = "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else " " for c in text or "")
    for w in kept.split(" "):
        for n in (1, 2, 3) if w else ():
            padded = f" {w} " if n > 1 else w
            out.update(padded[i:i + n] for i in range(len(padded) - n + 1))
    return out


def _ranks(counts, size):
    return {g: k for k, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size])}


def _predicted(text, profiles, size):
    own = _ranks(_grams(text), size)
    if not any(unicodedata.category(c)[0] == "L" for c in text or "") or not profiles:
        return "und", 0.0
    far = {lang: sum(abs(p[g] - k) if g in p else size for g, k in own.items()) for lang, p in profiles.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (len(own) * size)


AWKWARD = [None, "", " ", "12 - 7!", "a", "Ünï Ünï", "ΣΑΣ σας", "İstanbul", "日本語 テスト", "क्या है", "́", "x" * 5000, "the " * 4000, "A\x00b c"]


@pytest.mark.parametrize("size", [20, 400])
def test_languages_against_brute_force(spark, size):
    rng = random.Random(size)
    syllables = {"aa": "ba be bi bo".split(), "bb": "ka ke ki bo".split(), "cc": "ñu ße ki mo".split()}
    rows = []
    for i in range(90):
        lang = rng.choice([*syllables, None])
        text = " ".join("".join(rng.choice(syllables[lang or "aa"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 60)))
        rows.append((i, text.title() + ".", lang))
    rows += [(100 + k, t, "aa") for k, t in enumerate(AWKWARD)] + [rows[3], (None, "bo ki", "bb")]
    docs = _frame(spark, rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, ranks=size)
    counts = {}
    for _, t, lang in rows:
        if t is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(_grams(t))
    profiles = {lang: _ranks(c, size) for lang, c in counts.items()}
    assert model.langs == sorted(profiles)
    got = {}
    for r in langid.predict(docs, model).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert sum(map(len, got.values())) == len(rows)
    for k, t, _ in rows:
        assert _predicted(t, profiles, size) in got[k], t


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in langid.predict(docs, langid.learn(docs)).collect()) == [(1, "und", 0.0), (2, "und", 0.0)]
    assert langid.predict(docs.limit(0), langid.learn(docs)).count() == 0


def test_held_out_documents(spark):
    rows = queries.op13_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held_out = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held_out} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held_out) >= 0.98 * len(held_out) and len(held_out) > 250
    assert all(0 <= r.score <= 1 for r in rows)
