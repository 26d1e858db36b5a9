"""Personal data by candidate generation and gradient-boosted trees, in
DataFrame functions (and Spark ML's trees, which run in the JVM).

Generators propose spans, and may overlap: the base patterns, and wider ones
(any run of digits and separators, bracketed "at" and "dot"). A span is
described by its format and by the text around it. Base spans that pass their
checks (octets, Luhn, number of digits) are positives, all other proposals
negatives; equal descriptions are counted once with their weight, so training
reads one small table whatever the corpus holds. The trees see no check, so
their score says how much a proposal looks like the data that passes it. On the
documents that did not train, each kind's threshold is set to the lowest score
at which the proposals above are right to the wanted precision; spans above it
are added to the base ones, which always stay.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, written

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9
TREES, DEPTH = 12, 3
CONTEXT = 24                    # code points before and after a span that describe it

_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
# (kind, pattern, a cheap test that rules most texts out). The base patterns are
# fixed by the contract; their loops are possessive and start only where a run
# starts, which changes no match and keeps them linear on long texts.
BASE = (
    ("email", _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", "."),
    ("card", r"[0-9](?:[ -]?+[0-9])++", None),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+"),
)
WIDE = (
    ("email", _LOCAL + r" ?+(?:@|[(\[{]at[)\]}]) ?+[A-Za-z0-9-]++(?: ?+(?:\.|[(\[{]dot[)\]}]) ?+[A-Za-z0-9-]++)++", "at"),
    ("number", r"(?<![0-9])[+(]?+[0-9][0-9 ().-]{5,}[0-9]", None),
)
GENERATORS = BASE + WIDE


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hits(text: Column, number: int, pattern: str, needs: str | None) -> Column:
    """The matches of one generator, with the code points since the last match
    and the text on both sides."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needs:
        found = F.when(F.contains(text, F.lit(needs)), found)

    def described(hits: Column) -> Column:
        def each(pieces: Column) -> Column:
            return F.transform(hits, lambda hit, i: F.struct(
                F.lit(number).alias("gen"), i.cast("int").alias("idx"), hit.alias("hit"),
                F.length(F.get(pieces, i)).alias("gap"), F.right(F.get(pieces, i), F.lit(CONTEXT)).alias("before"),
                F.left(F.get(pieces, i + 1), F.lit(CONTEXT)).alias("after")))
        return F.when(F.size(hits) > 0, _let(F.split(text, pattern, -1), each))

    kind = "array<struct<gen:int,idx:int,hit:string,gap:int,before:string,after:string>>"
    return F.coalesce(_let(found, described), F.array().cast(kind)).cast(kind)


def _luhn(digits: Column) -> Column:
    """Luhn's check, from the last digit."""
    def value(d: Column, i: Column) -> Column:
        n = d.cast("int") * F.when(i % 2 == 1, F.lit(2)).otherwise(F.lit(1))
        return F.when(n > 9, n - 9).otherwise(n)
    figures = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(figures, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(gen: Column, hit: Column) -> Column:
    """The checks of the base kinds."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    small = F.forall(F.split(hit, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3)
                     & (F.right(p, F.lit(3)).cast("int") <= 255))
    return (F.when(gen == 0, F.lit(True)).when(gen == 1, small)
            .when(gen == 2, F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False))
            .when(gen == 3, F.length(digits).between(8, 15)).otherwise(False))


def _side(c: Column) -> Column:
    """Class of the character next to a span."""
    return (F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike("^[0-9]$"), 2)
            .when(c.rlike(r"^\p{L}$"), 3).otherwise(4))


FEATURES = ("f_kind", "f_digits", "f_groups", "f_longest", "f_separator", "f_plus", "f_brackets", "f_at",
            "f_before", "f_after", "f_cue", "f_other_cue")


def _features(c: DataFrame) -> DataFrame:
    hit, digits = F.col("hit"), F.length(F.regexp_replace("hit", "[^0-9]", ""))
    groups = F.filter(F.split("hit", "[^0-9]+"), lambda g: g != "")
    near = F.lower(F.concat_ws(" ", "before", "after"))
    separators = (F.contains(hit, F.lit(" ")).cast("int") + F.contains(hit, F.lit("-")).cast("int") * 2
                  + F.contains(hit, F.lit(".")).cast("int") * 4)
    return c.withColumns({
        "f_kind": sum((F.when(F.col("kind") == k, i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0)),
        "f_digits": F.least(digits, F.lit(24)),
        "f_groups": F.least(F.size(groups), F.lit(8)),
        "f_longest": F.least(F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), F.lit(20)),
        "f_separator": separators,
        "f_plus": F.startswith(hit, F.lit("+")).cast("int"),
        "f_brackets": F.contains(hit, F.lit("(")).cast("int"),
        "f_at": F.when(F.contains(hit, F.lit("@")), 1).when(hit.rlike(r"[(\[{]at"), 2).otherwise(0),
        "f_before": _side(F.right("before", F.lit(1))), "f_after": _side(F.left("after", F.lit(1))),
        "f_cue": near.rlike(r"\b(?:tel|phone|call|fax|mobile|mail|contact|card|visa|iban|host|address|ip)\b").cast("int"),
        "f_other_cue": near.rlike(r"\b(?:version|isbn|order|no|id|ref|page|fig|key|token|password|sha|md5)\b").cast("int")})


def candidates(docs: DataFrame, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): the documents with a row number (``row``, or that of the
    scan), and every proposed span of every text with its place, check and
    description."""
    row = F.monotonically_increasing_id() if row is None else row
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    arrays = [_hits(F.col("text"), i, p, need) for i, (_, p, need) in enumerate(GENERATORS)]
    rows = written(docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                               text.alias("text"))
                   .select("row", "doc_id", F.concat(*arrays).alias("hits")), "hits")
    each = rows.filter(F.size("hits") > 0).select("row", F.inline("hits"))
    so_far = Window.partitionBy("row", "gen").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("hit")).over(so_far)
    placed = (each.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("hit"))
              .withColumn("base", _passes(F.col("gen"), F.col("hit"))))
    digits = F.length(F.regexp_replace("hit", "[^0-9]", ""))
    kind = F.when(F.col("gen") == 5, F.when(digits >= 13, "card").otherwise("phone"))
    for i, (k, _, _) in enumerate(GENERATORS[:5]):
        kind = kind.when(F.col("gen") == i, k)
    return rows, written(_features(placed.withColumn("kind", kind)).drop("hit", "gap", "before", "after", "idx"), "spans")


def _model_scores(spans: DataFrame, precision: float) -> DataFrame | None:
    """Descriptions whose proposals are added: one row each. None where the
    spans give the trees nothing to learn."""
    counted = written(spans.groupBy(*FEATURES, "kind").agg(
        *(F.sum((F.col("base") & (F.pmod(F.xxhash64("row"), F.lit(2)) == f)).cast("long")).alias(f"right{f}") for f in (0, 1)),
        *(F.sum((F.pmod(F.xxhash64("row"), F.lit(2)) == f).cast("long")).alias(f"all{f}") for f in (0, 1))), "patterns")
    classes = counted.agg(F.sum("right0"), F.sum(F.col("all0") - F.col("right0"))).first()
    if not classes[0] or not classes[1]:
        return None
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(counted)
    labelled = (assembled.select("features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("right0").cast("double").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("all0") - F.col("right0")).cast("double").alias("weight")))).alias("x"))
        .select("features", "x.label", "x.weight").filter("weight > 0"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, weightCol="weight",
                          checkpointInterval=-1).fit(labelled.coalesce(1))
    scored = trees.transform(assembled).withColumn("score", vector_to_array("probability")[1])
    above = Window.partitionBy("kind").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    good = F.sum("right1").over(above) >= precision * F.sum("all1").over(above)
    ranked = scored.withColumn("good", good & (F.sum("all1").over(above) > 0))
    limit = F.min(F.when(F.col("good"), F.col("score"))).over(Window.partitionBy("kind"))
    return ranked.withColumn("limit", limit).filter("score >= limit").select(*FEATURES, "kind")


def find_spans(docs: DataFrame, precision: float = PRECISION, row: Column | None = None) -> DataFrame:
    """(row, doc_id, base, spans) for every document: arrays of (kind number,
    start, end), by kind as in KINDS, then start; code points, end exclusive.

    ``base`` has the spans of the base patterns that pass their checks. ``spans``
    has these and the added ones; an added span overlaps no base span and no
    added span before it. Null and empty texts have none; repeated rows are
    answered one by one. Columns other than doc_id and text are not read.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows, spans = candidates(docs, row)
    number = sum((F.when(F.col("kind") == k, i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))
    chosen = _model_scores(spans, precision)
    cell = F.struct(number.alias("k"), "start", "end")
    own = spans.filter("base").select("row", cell.alias("s"), F.lit(True).alias("is_base"))
    if chosen is not None:
        added = spans.filter("not base").join(chosen, [*FEATURES, "kind"], "left_semi")
        own = own.unionByName(added.select("row", cell.alias("s"), F.lit(False).alias("is_base")))
    lists = own.groupBy("row").agg(F.sort_array(F.collect_set(F.when(F.col("is_base"), F.col("s")))).alias("base"),
                                   F.sort_array(F.collect_set(F.when(~F.col("is_base"), F.struct("s.start", "s.end", "s.k")))).alias("more"))
    free = F.filter("more", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,k:int>>")
    # left to right: a span stays where it starts behind the last that stayed
    kept = F.aggregate(free, F.struct(F.lit(0).cast("long").alias("last"), nothing.alias("out")),
                       lambda acc, a: F.when(a["start"] >= acc["last"], F.struct(
                           a["end"].alias("last"), F.array_append(acc["out"], a).alias("out"))).otherwise(acc),
                       lambda acc: acc["out"])
    kind = "array<struct<k:int,start:bigint,end:bigint>>"
    added = F.transform(kept, lambda a: F.struct(a["k"].alias("k"), a["start"].alias("start"), a["end"].alias("end")))
    lists = lists.select("row", F.col("base").cast(kind).alias("base"),
                         F.sort_array(F.concat(F.col("base").cast(kind), added.cast(kind))).alias("spans"))
    none = F.array().cast(kind)
    return (rows.select("row", "doc_id").join(lists, "row", "left")
            .select("row", "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans")))


def written_out(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in angle
    brackets, and all other columns as they are, whatever their names. Null texts
    become empty; rows that repeat id and text are alike before and after; an
    empty table gives an empty result. The rows are numbered and written once, so
    any DataFrame may come."""
    numbered = written(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"))
                       .withColumn("number", F.monotonically_increasing_id()), "numbered")
    spans = find_spans(numbered.select(F.col("whole.doc_id").alias("doc_id"), F.col("whole.text").alias("text"), "number"),
                       precision, F.col("number")).select(F.col("row").alias("number"), "spans")
    text = F.coalesce(F.col("whole.text").cast("string"), F.lit(""))
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    cuts = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["k"].alias("k"))))

    def rebuilt(c: Column) -> Column:
        parts = F.transform(c, lambda s, i: F.concat(
            F.substring(text, F.when(i > 0, F.get(c, i - 1)["b"]).otherwise(F.lit(0)).cast("int") + 1,
                        F.greatest((s["a"] - F.when(i > 0, F.get(c, i - 1)["b"]).otherwise(F.lit(0))).cast("int"), F.lit(0))),
            F.get(names, s["k"])))
        tail = F.substring(text, F.coalesce(F.array_max(F.transform(c, lambda s: s["b"])), F.lit(0)).cast("int") + 1, F.length(text))
        return F.concat(F.array_join(parts, ""), tail)

    joined = numbered.join(spans, "number").withColumn("clean", _let(cuts, rebuilt))
    return joined.select(*[F.col("clean" if c == "text" else f"whole.`{c}`").alias(c) for c in docs.columns])
