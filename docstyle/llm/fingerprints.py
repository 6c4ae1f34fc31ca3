"""Operator 9, document fingerprints [native]: consistent weighted sampling (Ioffe 2010).

Each term of a document, weighted by its count, gets for each slot a gamma-based sample; the slot keeps the least.
Two documents agree in a slot with a chance equal to the generalised Jaccard similarity of their weighted terms.
DataFrame functions only; every draw is a function of the term and the slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, ranges_of, stored, table, text_of, values_table

SLOTS = 64


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """An exclusive uniform from some bits of a hash."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(0.5)) * F.lit(1.0 / (1 << width))


def samples(terms: DataFrame, keys: list[str], slots: int = SLOTS, *more: Column) -> DataFrame:
    """keys and s0, s1, ...: each slot's least sample over rows (keys, term long, weight).

    The draw has r and c from gamma(2, 1) and a uniform beta, t = floor(ln w / r + beta) and a = c exp(-r (t - beta + 1)). Of a
    gamma(2, 1) variable cut at a uniform share, both parts are independent exponentials: with r beta = -ln u1 and
    r (1 - beta) = -ln u2, exp(-r) is q = u1 u2 and a = c u2 q^t. t is 0 while u1 <= w < 1 / u2 and 1 below 1 / (u2 q), so that
    only heavy terms take logarithms, which Spark leaves to StrictMath: the same bits on every machine. c, of which only small
    values win, is the quantile of a uniform u by its series in sqrt(2 u), within 3 % up to the median and closer below. As a
    is a function of the term, the slot and t, equal values of the least a stand for equal (term, t), so the value itself is
    the sample: a fixed-width aggregate that runs in generated code and is combined by tasks."""
    w = F.col("weight").cast("double")
    aggs = []
    for j in range(slots):
        h = F.xxhash64("term", F.lit(j))
        u1, u2 = _uniform(h, 0, 19), _uniform(h, 19, 19)
        q, begin = u1 * u2, w * u2
        x = F.sqrt(_uniform(h, 38, 26) * F.lit(2.0))
        c = x * (F.lit(1.0) + x * (F.lit(1 / 3) + x * (F.lit(11 / 72) + x * (F.lit(43 / 540) + x * (F.lit(769 / 17280) + x * F.lit(221 / 8505))))))
        power = F.when((begin < 1.0) & (w >= u1), F.lit(1.0)).when((begin >= 1.0) & (begin * q < 1.0), q).otherwise(F.pow(q, F.floor(F.log(w / u1) / -F.log(q))))
        aggs.append(F.min(c * u2 * power).alias(f"s{j}"))
    return terms.groupBy(*keys).agg(*aggs, *more)


def text_terms(text: Column) -> Column:
    """Lower-cased words as an array; a text without words has one term, the empty string."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("")))


def fingerprint_of(prefix: str, slots: int = SLOTS) -> Column:
    """16 bits of each slot's sample, as bytes."""
    samples = F.array(*[F.col(f"{prefix}{j}") for j in range(slots)])
    return F.unhex(F.array_join(F.transform(samples, lambda s: F.lpad(F.hex(F.xxhash64(s).bitwiseAND(F.lit(0xFFFF))), 4, "0")), ""))


def likeness(a: Column, b: Column, slots: int = SLOTS) -> Column:
    """Share of the slots in which two fingerprints agree, null if either is."""
    at = F.sequence(F.lit(1), F.lit(2 * slots - 1), F.lit(2))
    same = F.filter(at, lambda i: F.substring(a, i, F.lit(2)) == F.substring(b, i, F.lit(2)))
    return F.when(a.isNotNull() & b.isNotNull(), F.size(same) / F.lit(float(slots)))


def following(ids: DataFrame, ranges: int = 256) -> DataFrame:
    """(doc_id, next_id): the next smaller distinct id, and the largest after the smallest.

    Ids are cut into ranges at quantiles; within a range a window finds the next, and one row per range, on the
    driver, joins the ranges. No task has all ids."""
    spark = ids.sparkSession
    ids = ids.where("doc_id IS NOT NULL").select("doc_id").distinct()
    cuts = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    ranged = checkpoint(ids.withColumn("r", ranges_of("doc_id", sorted(set(cuts)))))
    ends = sorted((x.r, x.lo, x.hi) for x in ranged.groupBy("r").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect())
    links = values_table(spark, [(lo, ends[i - 1][2]) for i, (_, lo, _) in enumerate(ends)], "lo long, over long")
    inside = ranged.withColumn("n", F.lead("doc_id").over(Window.partitionBy("r").orderBy(F.desc("doc_id"))))
    return inside.join(F.broadcast(links), inside.doc_id == links.lo, "left").select("doc_id", F.coalesce("n", "over").alias("next_id"))


def _signed(rows: DataFrame, slots: int) -> DataFrame:
    """(doc_id, text, head, next_id), dealt out by doc_id, to (doc_id, next_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint), the last three as bytes.

    The two texts of a row are its sides 0 and 1. A term that has the same weight in both, as most of the half that they share,
    is drawn for once: mask 3, where masks 1 and 2 hold what one side alone has. A row's other results travel beside them as
    sides of one term, for the aggregates then hold fixed-width values only. Nothing here needs an exchange, as every group
    has doc_id first."""
    rows = rows.withColumn("n_chars", F.length("text"))
    half = (F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("head", F.lit(1), half)))
    rows = rows.withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256))
    parts = [F.conv(F.substring("sha", 8 * i + 1, 8), 16, 10) for i in range(8)]
    sides = [F.col("text"), F.col("edited"), F.col("n_chars").cast("string"), F.col("next_id").cast("string"), *parts]
    # the row's number is taken below the generator, so that all sides of a row share it
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("doc_id", "row", F.inline(F.array(*[F.struct(F.lit(i).alias("side"), t.alias("t")) for i, t in enumerate(sides)])))
    words = rows.select("doc_id", "row", "side", F.explode(text_terms(F.col("t"))).alias("w"))
    term = F.when(F.col("side") < 2, F.xxhash64("w")).otherwise(F.col("w").try_cast("long"))
    times = [F.sum((F.col("side") == i).cast("long")).alias(c) for i, c in enumerate("ab")]
    counted = words.groupBy("doc_id", "row", F.greatest("side", F.lit(1)).alias("kind"), term.alias("term")).agg(*times)
    one = lambda *x: F.array(*[F.struct(m.alias("mask"), w.alias("weight")) for m, w in x])
    a, b = F.col("a"), F.col("b")
    weighted = F.when(F.col("kind") > 1, one((F.col("kind") + 2, F.lit(1).cast("long")))).when(a == b, one((F.lit(3), a))).when(a == 0, one((F.lit(2), b))).when(b == 0, one((F.lit(1), a))).otherwise(one((F.lit(1), a), (F.lit(2), b)))
    drawn = samples(counted.select("doc_id", "row", "term", F.inline(weighted)), ["doc_id", "row", "mask"], slots, F.max("term").alias("carried"))
    least = [F.min(F.when(F.col("mask").isin(i, 3), F.col(f"s{j}"))).alias(f"{c}{j}") for i, c in ((1, "a"), (2, "b")) for j in range(slots)]
    carried = [F.max(F.when(F.col("mask") == 4 + i, F.col("carried"))).alias(f"c{i}") for i in range(10)]
    flat = drawn.groupBy("doc_id", "row").agg(*least, *carried)
    sha = F.unhex(F.concat(*[F.lpad(F.hex(f"c{2 + i}"), 8, "0") for i in range(8)]))
    return flat.select("doc_id", F.col("c1").alias("next_id"), F.col("c0").alias("n_chars"), sha.alias("edited_sha256"), fingerprint_of("a", slots).alias("fingerprint"), fingerprint_of("b", slots).alias("edited_fingerprint"))


def fingerprints(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The edited text is the text less its last floor(n_chars / 2) code points, plus as many of the next document's
    first ones, the next being that of the next smaller doc_id. Null texts count as empty. Of rows that share a
    doc_id each has its fingerprint and all have the same next document; as the next of another, the least of their
    heads and of their fingerprints count. A row without doc_id has no next: its edited text gets nothing, near_next is
    null. One document alone is its own next. Equal texts have equal fingerprints, as they have equal terms.

    Texts cross the network once by doc_id (both joins reuse that exchange), prefixes once more; terms never do: the
    aggregates group by doc_id first, which the join has already dealt out."""
    base = text_of(docs)
    known = base.where("doc_id IS NOT NULL")
    order = checkpoint(following(known.select("doc_id")))
    half = known.select("doc_id", (F.length("text") / 2).cast("int").alias("half")).groupBy("doc_id").agg(F.max("half").alias("half"))
    need = order.join(half, "doc_id").select(F.col("doc_id").alias("of"), F.col("next_id").alias("doc_id"), "half")
    prefix = known.join(need, "doc_id").select(F.col("of").alias("doc_id"), F.col("doc_id").alias("next_id"), F.substring("text", F.lit(1), F.col("half")).alias("head"))
    prefix = prefix.groupBy("doc_id").agg(F.min("head").alias("head"), F.min("next_id").alias("next_id"))
    signed = stored(_signed(known.join(prefix, "doc_id"), slots))
    lone = base.where("doc_id IS NULL")
    # the draws of all slots make a large plan, so the driver never has two of them at once
    if not lone.select("doc_id").isEmpty():
        lone = lone.withColumn("head", F.lit("")).withColumn("next_id", F.lit(None).cast("long"))
        signed = signed.unionAll(stored(_signed(lone, slots)))
    after = signed.groupBy(F.col("doc_id").alias("next_id")).agg(F.min(F.hex("fingerprint")).alias("next_fingerprint"))
    out = signed.join(after.withColumn("next_fingerprint", F.unhex("next_fingerprint")), "next_id", "left")
    text = lambda c: F.lower(F.hex(c)).alias(c)
    near = lambda c: likeness(F.col("fingerprint"), F.col(c), slots)
    return out.select("doc_id", "n_chars", text("edited_sha256"), text("fingerprint"), text("edited_fingerprint"), near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
