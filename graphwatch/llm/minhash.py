"""Near duplicates by one-permutation MinHash.

A document's shingles are hashed once. The top bits of a hash name one of 128
bins and the smallest hash of a bin is its signature entry; an empty bin takes
the entry of another bin drawn by a fixed random sequence until a full one is
met (optimal densification). Signature entries are grouped in bands; documents
with an equal band share a bucket. A bucket proposes the links of a star, from its
hub to all others, so that proposals grow with the members and not with their
square; the hub is the member that shares most buckets, which in a group of
edited copies is the text that they were made from. Links are confirmed on the
full shingle sets. A bucket whose members are not yet all connected then tests
what its star left open: pairs between members of different components, so that
no link that shares a bucket is lost.

Shingles that no other member of any bucket has bound what a pair can share, so
copies with too many edits of their own are ruled out without a comparison.

21 bands of 6: a pair of similarity 0.85 shares a bucket with probability
1 - (1 - 0.85**6)**21 > 0.9999.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, lower_ascii, mix64, prepare, text_slices, word_hashes, written
from .components import components

WORDS = 5
BINS = 128
RECALL = 0.9999            # of one pair at the least similarity that is a link
_BIN_SHIFT = np.uint64(57)
_ODD = mix64(np.arange(1, 64, dtype=np.uint64)) | np.uint64(1)
# donors of empty bins: row t has the bin that each bin asks at attempt t
_DONORS = (mix64(np.arange(4096 * BINS, dtype=np.uint64) ^ np.uint64(0x5BD1E995)) >> _BIN_SHIFT
           ).astype(np.int64).reshape(4096, BINS)

_SIGNED = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("of", pa.int64()), ("n_shingles", pa.int64()),
                     ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("digest", pa.binary()), ("shingles", pa.binary())])


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for each text. Fewer words than
    ``words`` make one shingle, no words an empty set."""
    for lo, b, off in text_slices(texts):
        h, _, _, first = word_hashes(lower_ascii(b), off, SPACE)
        rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            rolled += h[k:k + len(rolled)] * _ODD[k]
        rolled = mix64(rolled)
        for i in range(len(off) - 1):
            s, e = int(first[i]), int(first[i + 1])
            if e - s >= words:
                yield lo + i, np.unique(rolled[s:e - words + 1])
            elif e > s:
                short = (h[s:e] * _ODD[:e - s]).sum(dtype=np.uint64) + np.uint64(e - s)
                yield lo + i, mix64(np.array([short], np.uint64))
            else:
                yield lo + i, np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """One-permutation signature of a sorted, non-empty set."""
    bins = (hashes >> _BIN_SHIFT).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    sig = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    sig[bins[first]] = hashes[first]
    full[bins[first]] = True
    if len(first) == 1:
        sig[:] = hashes[first[0]]
        return sig
    empty = np.flatnonzero(~full)
    for donors in _DONORS:
        if not len(empty):
            break
        asked = donors[empty]
        ok = full[asked]
        sig[empty[ok]] = sig[asked[ok]]
        empty = empty[~ok]
    sig[empty] = hashes[0]
    return sig


def band_shape(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands in which a pair at ``percent`` shares a
    bucket with probability RECALL at least, by all the bins they fill."""
    for rows in range(6, 1, -1):
        bands = BINS // rows
        if 1 - (1 - (percent / 100) ** rows) ** bands >= RECALL:
            return bands, rows
    return BINS, 1


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = sig[:bands * rows].reshape(bands, rows)
    mixed = (mix64(cut) * _ODD[:rows]).sum(axis=1, dtype=np.uint64)
    return mix64(mixed + np.arange(bands, dtype=np.uint64) * _ODD[20]).view(np.int64)


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _sign(percent: int):
    n_bands, n_rows = band_shape(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands = [], [], []
            for _, hashes in shingle_sets(batch.column(3)):
                sizes.append(len(hashes))
                digests.append(_digest(hashes))
                bands.append(band_keys(signature(hashes), n_bands, n_rows) if len(hashes) else np.zeros(0, np.int64))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            ends = np.cumsum([0] + [len(x) for x in bands]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=_SIGNED)
    return sign


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [h for _, h in shingle_sets(batch.column(0))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([_digest(h) for h in sets], pa.binary()),
             pa.array([h.tobytes() for h in sets], pa.binary())], schema=_SETS)


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of the intersections and unions of sets, as sorted hashes."""
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        common, every = [], []
        for i in range(batch.num_rows):
            x = np.frombuffer(a[i].as_py(), np.uint64)
            y = np.frombuffer(b[i].as_py(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            common.append(int((y[at] == x).sum()))
            every.append(len(x) + len(y) - common[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(common, pa.int64()), pa.array(every, pa.int64())],
                                         names=["u", "v", "common", "every"])


def _own_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), i, np.int64))], names=["shingle", "id"])


def _near(shared: Column, percent: int) -> Column:
    """Whether a pair that shares at most ``shared`` shingles can be linked."""
    return shared * 100 >= (F.col("u_n") + F.col("v_n") - shared) * percent


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Words are what lies between blanks and the bytes 9 to 13, after lower-casing
    A-Z; a set has the distinct 5-word shingles, or the whole sequence where
    there are fewer words. Documents are linked where
    ``100 * intersection >= percent * union``. Null and empty texts have an
    empty set and no link. component_id is the smallest doc_id of the component
    and kept marks the row that has it. A null doc_id takes part in links; its
    row is kept only where its component has no id (component_id is then null).
    Rows that repeat id and text all get the same result. Other columns are not
    read. An empty table gives an empty result.
    """
    return _groups(docs, percent).drop("of")


def _groups(docs: DataFrame, percent: int) -> DataFrame:
    """The columns of ``near_duplicates``, and ``of``: a hash of the row's text."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.col("text").cast("string")
    rid = F.coalesce(F.col("doc_id").cast("long"),
                     F.lit(-1) - F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 2))
    rows = docs.select(rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("of"),
                       text.alias("text"))
    signed = written(rows.mapInArrow(
        _sign(percent), "rid long, doc_id long, of long, n_shingles long, digest binary, bands array<long>"), "signed")
    # documents of one set are one class from here on
    members = signed.filter("n_shingles > 0").select("rid", "n_shingles", "digest", "bands")
    classes = written(
        members.groupBy("digest").agg(F.min("rid").alias("rid"), F.first("n_shingles").alias("n"),
                                      F.first("bands").alias("bands")), "classes")
    entries = classes.select(F.explode("bands").alias("key"), "digest", "n", "rid")
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = written(entries.join(sizes, "key"), "shared")
    # sets of the documents that share a bucket, made again from their texts
    wanted = shared.select("rid").distinct()
    sets = written(rows.select("rid", "text").join(wanted.hint("merge"), "rid", "left_semi").select("text")
                   .mapInArrow(_sets, "digest binary, shingles binary")
                   .join(shared.select("digest").distinct(), "digest", "left_semi")
                   .dropDuplicates(["digest"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("digest").alias("u"), F.col("shingles").alias("u_set"))
        b = sets.select(F.col("digest").alias("v"), F.col("shingles").alias("v_set"))
        return written(pairs.join(a, "u").join(b, "v").select("u", "v", "u_set", "v_set")
                       .mapInArrow(_intersect, "u binary, v binary, common long, every long")
                       .withColumn("linked", F.col("common") * 100 >= F.col("every") * percent), "confirmed")

    ends = F.min(F.struct("digest", "n")).alias("a"), F.max(F.struct("digest", "n")).alias("b")
    two = (shared.filter("size = 2").groupBy("key").agg(*ends)
           .select(F.col("a.digest").alias("u"), F.col("b.digest").alias("v"), F.col("a.n").alias("u_n"), F.col("b.n").alias("v_n"))
           .filter(_near(F.least("u_n", "v_n"), percent)).select("u", "v"))
    members = _with_hubs(shared.filter("size > 2").select("key", "digest", "n"), sets, percent)
    star = members.filter("digest != hub").select(F.least("hub", "digest").alias("u"), F.greatest("hub", "digest").alias("v"))
    first = written(two.unionByName(star).distinct(), "first")
    tested = confirmed(first)
    named = components(tested.filter("linked"))
    # what the stars left open: pairs of one bucket in different components
    open_pairs = written(_open_pairs(members, tested, named, percent).join(first, ["u", "v"], "left_anti"), "open")
    if open_pairs.limit(1).count():
        named = components(tested.unionByName(confirmed(open_pairs)).filter("linked"))
    named = written(named, "named")
    lowest = (signed.select("digest", "doc_id").join(named.withColumnRenamed("node", "digest"), "digest")
              .groupBy("component").agg(F.min("doc_id").alias("component_id")))
    of_class = named.join(lowest, "component").select(F.col("node").alias("digest"), "component_id")
    alone = (signed.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("own_id"))
             .join(of_class, "digest", "left")
             .select("digest", F.coalesce("component_id", "own_id").alias("component_id")))
    out = _named_rows(signed, alone)
    return out.select("doc_id", "of", "n_shingles", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _named_rows(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Every row with its class's component. A class of over 1/1024 of the rows
    (1023 at most) is sent to every task, the others meet by a shuffle."""
    rows = signed.select("doc_id", "of", "n_shingles", "digest")
    empty = rows.filter("n_shingles = 0").select("doc_id", "of", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = rows.filter("n_shingles > 0")
    limit = max(signed.count() // 1024, 1)
    sizes = rows.groupBy("digest").count().filter(F.col("count") > limit).select("digest")
    hot = F.broadcast(classes.join(sizes, "digest").select(
        "digest", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot")))
    marked = rows.join(hot, "digest", "left")
    one = marked.filter("hot").select("doc_id", "of", "n_shingles", F.col("hot_id").alias("component_id"))
    rest = (marked.filter(F.col("hot").isNull()).select("doc_id", "of", "n_shingles", "digest")
            .join(classes, "digest").select("doc_id", "of", "n_shingles", "component_id"))
    return empty.unionByName(one).unionByName(rest)


def _with_hubs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members (key, digest, n) of the buckets of three and more, with their own
    shingles (own), without those whose own shingles rule out any link, and with
    each bucket's hub: the member with most neighbours over all its buckets."""
    present = members.select("digest").distinct()
    held = (sets.join(present, "digest", "left_semi").select(F.xxhash64("digest").alias("id"), "shingles")
            .mapInArrow(_own_shingles, "shingle long, id long"))
    own = (held.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).filter("c = 1")
           .groupBy("id").agg(F.count(F.lit(1)).alias("own")))
    counted = (members.withColumn("id", F.xxhash64("digest")).join(own, "id", "left").drop("id")
               .withColumn("own", F.coalesce("own", F.lit(0).cast("long")))
               .filter((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent))
    counted = written(counted, "members")
    sizes = counted.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    near = counted.join(sizes, "key").groupBy("digest").agg(F.sum("size").alias("degree"))
    node = F.struct("degree", "digest", "n", "own")
    ranked = written(counted.join(near, "digest").select("key", node.alias("node")), "ranked")
    hubs = (ranked.groupBy("key").agg(F.max("node").alias("hub"), F.count(F.lit(1)).alias("size"))
            .filter("size > 1").select("key", "hub"))
    return written(ranked.join(hubs, "key").select(
        "key", "node.digest", "node.n", "node.own", F.col("hub.digest").alias("hub")), "hubs")


def _open_pairs(members: DataFrame, tested: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """Pairs (u < v) of one bucket whose components differ, each from the first
    bucket that it shares. One side is always outside the component of the
    bucket's hub, so a bucket that its star has connected proposes none.

    What a pair can share is bounded by the star: shingles that the hub has, as
    many as the one with fewer of them, and others, as many as the one with
    fewer that are not its own."""
    label = named.select(F.col("node").alias("digest"), "component")
    of_hub = named.select(F.col("node").alias("hub"), F.col("component").alias("hub_c"))
    c, hub_c = F.coalesce("component", "digest"), F.coalesce("hub_c", "hub")
    with_hub = tested.select(F.col("u").alias("_u"), F.col("v").alias("_v"), "common")
    common = F.when(F.col("digest") == F.col("hub"), F.col("n")).otherwise(F.col("common"))
    # a copy's own shingles are among those that the hub has not; the hub's own are its own
    others = F.when(F.col("digest") == F.col("hub"), F.lit(0)).otherwise(F.col("n") - F.col("common") - F.col("own"))
    keys = members.groupBy("digest").agg(F.collect_set("key").alias("keys"))
    at = written(members.join(label, "digest", "left").join(of_hub, "hub", "left").join(keys, "digest")
                 .withColumns({"_u": F.least("digest", "hub"), "_v": F.greatest("digest", "hub")})
                 .join(with_hub, ["_u", "_v"], "left")
                 .select("key", "digest", "n", "keys", common.alias("common"), others.cast("long").alias("others"),
                         c.alias("c"), (c != hub_c).alias("out")), "labels")
    outer = at.filter("out").select("key", *(F.col(x).alias(f"u{y}") for x, y in _SIDES))
    inner = at.select("key", *(F.col(x).alias(f"v{y}") for x, y in _SIDES))
    shared = F.least("u_common", "v_common") + F.least("u_others", "v_others")
    first = F.array_min(F.array_intersect("u_keys", "v_keys")) == F.col("key")
    return (outer.join(inner, "key").filter((F.col("u_c") != F.col("v_c")) & _near(shared, percent) & first)
            .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())


_SIDES = (("digest", ""), ("n", "_n"), ("c", "_c"), ("common", "_common"), ("others", "_others"), ("keys", "_keys"))


def drop_near(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each group (see ``near_duplicates``), with all its columns
    whatever their names. Rows are told apart by id and text: of rows that repeat
    an id only those with a kept text stay, and equal rows stay alike. Null and
    empty texts are linked with nothing and stay. An empty table gives an empty
    result."""
    keep = _groups(docs, percent).filter("kept").select("doc_id", "of").distinct().select(F.struct(
        F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "of").alias("key"))
    doc_id = F.col("row.doc_id").cast("long")
    key = F.struct(F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("no_id"),
                   F.xxhash64(F.col("row.text").cast("string")).alias("of"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).withColumn("key", key)
    return rows.join(keep, "key", "left_semi").select("row.*")
