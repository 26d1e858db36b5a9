"""The registered queries of the operators, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwatch.session import scratch_path

from . import (
    decontam, directcodes, editcounts, exact, fuzzylines, hardneg, langid, minhash, packing, pii, quality, runs, shards,
)
from .common import documents


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shuffle_shards(documents(spark, sf_dir).select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(documents(spark, sf_dir))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.written_out(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.written_out(F.col("spans")).alias("spans"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op6_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "codes")
    directcodes.write_codes(documents(spark, sf_dir), path)
    return directcodes.read_codes(spark, path, digest=True)


def derived_edits() -> Column:
    """Three edits of each document, from its own columns: its source's name is
    put in at one place, up to 40 code points are removed at another, and at a
    third eight give way to its language."""
    size = F.length(F.coalesce("text", F.lit("")))

    def place(k: int) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(k)), size + 1)

    def edit(at, remove, insert) -> Column:
        return F.struct(at.cast("long").alias("at"), F.lit(remove).cast("long").alias("remove"), insert.alias("insert"))

    return F.array(edit(place(1), 0, F.concat(F.lit(" "), F.coalesce("source", F.lit("")), F.lit(": "))),
                   edit(place(2), 40, F.lit("")), edit(place(3), 8, F.coalesce("lang", F.lit(""))))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("edits", derived_edits())
    return editcounts.apply_edits(editcounts.plant_trees(docs)).select(
        "doc_id", "n_before", "n_tokens", "n_edits", "n_bytes", "reencoded")


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzylines.fuzzy_lines(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_crc(packing.pack_documents(documents(spark, sf_dir)))


WORD = "[^\\x20\\x09-\\x0D]+"


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of one document in ten (by crc32 of its id), the words from
    one place on give way to copies of the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(
        h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    cut = chosen.withColumn("a", F.when(n > 0, (g % n).cast("int")))
    left = n - F.col("a")
    cut = cut.withColumn("p", (1 + F.floor(left / (3 + g % 8))).cast("int"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    copies = F.flatten(F.array_repeat(period, F.ceil(left / F.col("p")).cast("int")))
    words = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(copies, F.lit(1), left))
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_planted_repeats(documents(spark, sf_dir)))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "runs", "collapsed", longest.alias("m")).select(
        "doc_id", "n_runs", (-F.col("m.start")).alias("start"), F.col("m.length").alias("length"), (-F.col("m.period")).alias("period"),
        F.expr("1000 * m.length div -m.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector): components floor(256 * x), rows with a null or
    non-finite part left out, every seventh label moved on by one."""
    x = F.col("embedding").cast("array<double>")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
            .select("vec_id", moved.alias("label"), F.transform(x, lambda c: F.floor(256 * c)).alias("vector")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hardneg.mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(langid.fold(F.col("doc_id")) == 1, F.lit(False))
    model = langid.learn(docs.filter(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_sharding, op3_quality, op4_pii, op5_exact_dedup, op6_token_codes, op7_token_counts,
    op8_fuzzy_lines, op9_packing, op10_minhash, op11_periodic_runs, op12_hard_negatives, op13_language_id)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

# crc32 of an id written as text: the table of the reflected polynomial, then one step a digit
_CRC_TABLE = """
    SELECT list(v ORDER BY i) AS crc_table FROM (
        SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                              lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
        FROM range(256) r(i))"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                       lambda x, y: xor(x >> 8, crc_table[1 + (xor(x, y) & 255)])), 4294967295)"""
_WORD = "[^\\x20\\x09-\\x0D]+"

ORACLES = {
    "op5_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {_AZ})) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op10_minhash": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORD}') AS w FROM documents),
        placed AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS w FROM words),
        fives AS (
            SELECT doc_id, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s
            FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        shingles AS (
            SELECT DISTINCT doc_id, hash(s) AS s FROM fives WHERE s IS NOT NULL
            UNION ALL SELECT doc_id, hash(array_to_string(w, ' ')) FROM words WHERE len(w) BETWEEN 1 AND 4),
        sizes AS (SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            GROUP BY ALL),
        links AS (
            SELECT u, v FROM shared JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v
            WHERE 100 * shared.n >= 85 * (a.n + b.n - shared.n)),
        reached AS (
            SELECT doc_id, doc_id AS r FROM sizes UNION SELECT reached.doc_id, links.v FROM reached JOIN links ON links.u = reached.r)
        SELECT doc_id, any_value(n)::BIGINT AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
        FROM reached JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "op11_periodic_runs": f"""
        WITH hashed AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, {_CRC} AS h FROM documents, ({_CRC_TABLE})),
        cut AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % len(w) AS a FROM hashed),
        step AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
        planted AS (
            SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
                   THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w
            FROM step),
        words AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS w FROM planted),
        threes AS (
            SELECT doc_id, n, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS t FROM words
            WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        alike AS (
            SELECT x.doc_id, x.i, y.i - x.i AS period FROM threes x JOIN threes y
            ON x.doc_id = y.doc_id AND x.t = y.t AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS k FROM alike),
        repeats AS (
            SELECT doc_id, min(i) AS start, count(*) + 2 + period AS length, period FROM islands GROUP BY doc_id, period, k
            HAVING count(*) + 2 + period >= greatest(6, 4 * period)),
        runs AS (
            SELECT * FROM repeats r WHERE NOT EXISTS (
                SELECT 1 FROM repeats s WHERE s.doc_id = r.doc_id AND s.period < r.period AND r.period % s.period = 0
                AND s.start <= r.start AND s.start + s.length >= r.start + r.length)),
        longest AS (
            SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(start, length, period), (-length, start, period)) AS m,
                   string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
            FROM runs GROUP BY doc_id),
        kept AS (
            SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS collapsed FROM words
            WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = words.doc_id AND i >= r.start + r.period AND i < r.start + r.length)
            GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, m.start AS start, m.length AS length, m.period AS period,
               1000 * m.length // m.period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
               sha256(coalesce(collapsed, '')) AS collapsed_sha256
        FROM planted LEFT JOIN longest USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                   list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score,
               score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5""",
    "op13_language_id": f"""
        WITH docs AS (
            SELECT doc_id, lang, coalesce(text, '') AS text, {_CRC} % 3 = 1 AS held_out FROM documents, ({_CRC_TABLE})),
        words AS (
            SELECT doc_id, w, count(*) AS n FROM (
                SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}]+', ' ', 'g'), ' ')) AS w FROM docs)
            WHERE w <> '' GROUP BY ALL),
        grams AS (
            SELECT doc_id, g, sum(n)::BIGINT AS n FROM (
                SELECT doc_id, n, unnest(list_concat(
                    list_transform(range(1, len(w) + 1), lambda i: substr(w, i, 1)),
                    list_transform(range(1, len(w) + 2), lambda i: substr(' ' || w || ' ', i, 2)),
                    list_transform(range(1, len(w) + 1), lambda i: substr(' ' || w || ' ', i, 3)))) AS g FROM words)
            GROUP BY ALL),
        profiles AS (
            SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) - 1 AS place
            FROM grams JOIN docs USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g
            QUALIFY place < {langid.PROFILE}),
        own AS (
            SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) - 1 AS place FROM grams
            QUALIFY place < {langid.PROFILE}),
        apart AS (
            SELECT doc_id, l.lang, count(*) AS used,
                   sum(CASE WHEN p.place IS NULL THEN {langid.PROFILE} ELSE abs(p.place - own.place) END) AS d
            FROM own CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN profiles p ON p.lang = l.lang AND p.g = own.g
            GROUP BY ALL),
        nearest AS (SELECT doc_id, used, d, lang FROM apart QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d, lang) = 1)
        SELECT doc_id, held_out, CASE WHEN regexp_matches(text, '\\p{{L}}') THEN coalesce(n.lang, 'und') ELSE 'und' END AS lang_pred,
               CASE WHEN regexp_matches(text, '\\p{{L}}') AND n.lang IS NOT NULL
                    THEN 1 - d::DOUBLE / (used * {langid.PROFILE}) ELSE 0 END::DOUBLE AS score
        FROM docs LEFT JOIN nearest n USING (doc_id)""",
}
