"""Column names that meet helpers', repeated ids, nulls and empty tables, for the
operators that return documents and for the pipeline's stages."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphwatch.llm import decontam, exact, fuzzylines, minhash, pii, quality, shards
from graphwatch.session import scratch_path

# names that helpers inside the operators have, or had
NAMES = ["_id", "_no_id", "_sha", "_row", "_spans", "_key", "_salt", "_bucket", "_no", "_place", "_gone", "before", "places",
         "bucket", "key", "salt", "row", "place", "no", "shard_no", "of", "found", "gone", "whole", "number", "spans", "clean",
         "text_sha256", "digest", "line", "u", "v", "edits", "part", "score", "kept", "n", "id", "lang", "source", "n_chars"]


def _sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def _table(spark, rows):
    """A written table of (doc_id, text) with all the names above."""
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES)
    path = scratch_path(spark, "edges")
    spark.createDataFrame([(i, t, *(f"{n}!" for n in NAMES)) for i, t in rows], schema).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


def _rows():
    rng = random.Random(4)
    a, b, c, item = (_sentence(rng, 60) for _ in range(4))
    near = a.replace(a.split()[30], "zzzz", 1)
    return [(1, a), (2, a.upper()), (3, near), (4, b), (5, b), (5, c), (6, None), (7, ""), (None, a), (None, None), (4, b),
            (8, f"mail me: a.b@example.com or 10.1.2.3\n{c}"), (9, c + " " + item), (10, "  \n ")], item


def _same_columns(docs, out):
    assert out.columns == docs.columns
    for r in out.collect():
        assert all(r[n] == f"{n}!" for n in NAMES)


def _kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def test_exact_duplicates_go_and_columns_stay(spark):
    rows, _ = _rows()
    docs = _table(spark, rows)
    out = exact.drop_exact(docs)
    _same_columns(docs, out)
    texts = {}
    for i, t in rows:
        texts.setdefault((t or "").lower(), []).append(i)
    expected = sorted((max((i for i in v if i is not None), default=0), k) for k, v in texts.items())
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in out.collect()) == expected


def test_near_duplicates_are_told_apart_by_text(spark):
    rows, _ = _rows()
    docs = _table(spark, rows)
    out = minhash.drop_near(docs, percent=80)
    _same_columns(docs, out)
    got = _kept(out)
    texts = dict(rows)
    assert (1, rows[0][1]) in got and (2, texts[2]) not in got and (3, texts[3]) not in got and (None, rows[0][1]) not in got
    assert got.count((4, texts[4])) == 2                     # equal rows stay alike
    assert (5, rows[4][1]) not in got and (5, rows[5][1]) in got
    assert all((i, t) in got for i, t in rows if not (t or "").strip())


def test_lines_are_told_apart_by_text(spark):
    rows, _ = _rows()
    docs = _table(spark, rows + [(5, "short line of its own\n" + rows[3][1])])
    out = fuzzylines.drop_fuzzy_lines(docs)
    _same_columns(docs, out)
    got = _kept(out)
    assert len(got) == len(rows) + 1
    assert (1, rows[0][1]) in got and (2, "") in got and (None, "") in got and (6, None) in got and (7, "") in got
    # of the rows with id 5: b is a copy, c comes first, the last keeps its own line alone
    assert [t for i, t in got if i == 5] == sorted(["", rows[5][1], "short line of its own"])


def test_lines_with_awkward_texts(spark, monkeypatch):
    rng = random.Random(3)
    long = _sentence(rng, 9000)
    other = long.replace("a", "b", 40)
    texts = [long, other, "x\n" * 50, "x", "é", "é é", "a b c", None, "\n\n", "same line here\nsame line here\nSame, line here!"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, long)], "doc_id long, text string")
    rows = {}
    for r in fuzzylines.fuzzy_lines(docs).collect():
        rows.setdefault((r.doc_id, r.line_no), []).append(r)
    assert rows[0, 0][0].kept and len(rows[0, 0]) == 2
    assert (rows[1, 0][0].group_doc, rows[1, 0][0].kept) == (0, False)
    assert [rows[2, k][0].kept for k in range(50)] == [True] + [False] * 49
    assert not rows[3, 0][0].kept and rows[3, 0][0].group_doc == 2
    assert [rows[9, k][0].kept for k in range(3)] == [True, False, False]


def test_shards_with_any_names_and_in_slot_order(spark, tmp_path):
    rows, _ = _rows()
    docs = _table(spark, rows)
    out = shards.shuffle_shards(docs, 3)
    assert out.columns == [*docs.columns, "shard", "slot"]
    got = out.collect()
    assert len(got) == len(rows) and all(r[n] == f"{n}!" for r in got for n in NAMES)
    path = scratch_path(spark, "many")
    spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")).write.parquet(path)
    many = spark.read.parquet(path)
    shards.write_shards(many, f"{tmp_path}/out", 2)
    place = {r.doc_id: (r.shard, r.slot) for r in shards.shuffle_shards(many, 2).collect()}
    import glob

    import pyarrow.parquet as pq
    seen = 0
    for shard in range(2):
        ids = [i for f in sorted(glob.glob(f"{tmp_path}/out/shard={shard}/*.parquet")) for i in pq.read_table(f)["doc_id"].to_pylist()]
        assert [place[i] for i in ids] == [(shard, k) for k in range(30_000)]
        seen += len(ids)
    assert seen == 60_000


def test_redaction_of_a_frame_that_is_no_table(spark):
    rows, _ = _rows()
    docs = _table(spark, rows)
    shuffled = docs.repartition(5).orderBy(F.rand(3))
    out = pii.redact(shuffled)
    _same_columns(docs, out)
    got = _kept(out)
    assert len(got) == len(rows)
    (eight,) = [t for i, t in got if i == 8]
    assert eight.startswith("mail me: <email> or <ip>\n")
    assert all(t == (dict(rows[:3]).get(i) or t) for i, t in got if i in (1, 2, 3))


def test_leaks_of_unspaced_scripts_and_of_parts(spark):
    rng = random.Random(8)
    japanese = "東京都の人口は約千四百万人で日本の首都である"
    long = [_sentence(rng, 1) for _ in range(700)]
    items = [(1, japanese), (2, " ".join(long)), (3, "too short an item"), (4, None)]
    docs = [(1, f"前置き。{japanese}。おわり"), (2, "x y " + " ".join(long[256:512]) + " z"), (3, " ".join(long[:100])),
            (4, " ".join(long)), (5, "京都の東人"), (6, "too short an item"), (7, None), (8, "")]
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                           spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.part) for r in found) == [(1, 1, 0), (2, 2, 1), (4, 2, 0), (4, 2, 1), (4, 2, 2)]
    # 516 words: the last four go with the second part
    tail = [(9, " ".join(long[:516]))]
    found = decontam.leaks(spark.createDataFrame(tail, "doc_id long, text string"),
                           spark.createDataFrame(tail, "item_id long, text string")).collect()
    assert sorted((r.part, r.n_words, r.edits) for r in found) == [(0, 256, 0), (1, 260, 0)]


def test_an_index_below_the_target_recall_is_refused(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(decontam, "MAX_WALKS", 4)
    rng = random.Random(1)
    (_, h, first), = decontam.words(pa.array([_sentence(rng, 40)]))
    with pytest.raises(ValueError, match="walks find"):
        decontam.build_index([(1, h)], recall=1.1)


def test_single_tokens_through_the_directories(spark):
    from graphwatch.llm import directcodes
    from graphwatch.llm.tokens import encoder, tokenizer_path

    rng = random.Random(2)
    texts = {i: _sentence(rng, rng.randint(0, 400)) for i in range(40)}
    path = scratch_path(spark, "codes")
    directcodes.write_codes(spark.createDataFrame(list(texts.items()) + [(None, "x")], "doc_id long, text string"), path, part_bytes=9000)
    ids = {i: [*encoder(tokenizer_path()).tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    asked = [(i, rng.randrange(len(x) + 3)) for i, x in ids.items() for _ in range(5)] + [(99, 0), (3, -1), (None, 0)]
    got = directcodes.read_token(spark, path, spark.createDataFrame(asked, "doc_id long, place int")).collect()
    expected = sorted((i, p, ids[i][p]) for i, p in asked if i in ids and 0 <= p < len(ids[i]))
    assert sorted(tuple(r) for r in got) == expected and len(expected) > 100


def _pipeline_input(spark, tmp_path, rows, items):
    docs = _table(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs


def test_stages_of_awkward_documents(spark, tmp_path):
    rows, item = _rows()
    docs = _pipeline_input(spark, tmp_path, rows, [(1, item), (2, None)])
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "stage")
        _same_columns(_table(spark, []), docs)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] >= 1
    assert not any(item in (r.text or "") for r in docs.collect())
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_of_no_documents(spark, tmp_path):
    _pipeline_input(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_keeps_names_and_takes_empty_tables(spark):
    rows, _ = _rows()
    docs = _table(spark, rows)
    _same_columns(docs, quality.keep_good(docs))
    assert quality.keep_good(_table(spark, [])).count() == 0


def test_no_plain_grouping_decides_what_stays():
    """The rows of the exact duplicates come out of the bucket tables."""
    import inspect

    source = inspect.getsource(exact.exact_duplicates)
    assert len(re.findall(r"groupBy", source)) == 1 and "_tables" in source     # the one plans the buckets by size


def test_two_contents_in_one_digest_stop_the_job():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array(["0", "0"]), pa.array(["d", "d"]), pa.array([b"a", b"b"]), pa.array([1, 1]), pa.array([1, 2])],
        names=["bucket", "text_sha256", "content", "copies", "top_id"])
    with pytest.raises(ValueError, match="share a digest"):
        list(exact._tables(iter([batch])))
