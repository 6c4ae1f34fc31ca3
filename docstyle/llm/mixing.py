"""Operator 6, mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Each source's documents form blocks by a hash. A source's target says how many times all of its blocks are taken and
how many more of them come once; the exact block quotas of all sources are then split over the output shards by a
binary tree of multivariate-hypergeometric draws, each shard draws disjoint blocks in a permuted order, and rows
are shuffled within their shard only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, table, values_table

CAP = 3


def targets(sizes: dict[str | None, int], weights=(1, 2, 3), cap: int = CAP) -> dict[str | None, float]:
    """Shares of the whole by weight, none above cap times its source; the excess is reshared by weight."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), [s for s in order], {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def split_tree(quotas: np.ndarray, n_shards: int, rng: np.random.Generator) -> np.ndarray:
    """Deals exact block quotas (one per source) to shards: at each node the left half's blocks are drawn without
    replacement from the node's, so every quota is kept exactly and each shard gets an equal number of blocks, to one."""
    if n_shards == 1:
        return quotas[None, :]
    left = n_shards // 2
    drawn = int(quotas.sum()) * left // n_shards
    part = rng.multivariate_hypergeometric(quotas, drawn, method="marginals") if drawn else np.zeros_like(quotas)
    return np.vstack([split_tree(part, left, rng), split_tree(quotas - part, n_shards - left, rng)])


def plan(docs: DataFrame, weights=(1, 2, 3), n_shards: int = 8, blocks: int = 2048, seed: int = 6) -> DataFrame:
    """What the mix takes of each row: doc_id, size, source, source_size, target, taken, shards (one for each time the
    row is taken, as an array), place (its order within a shard).

    The input has doc_id, source, key and size (words). Blocks number about `blocks` plus the sources in all, whatever the
    input's size; the driver holds one row per source and block. A row belongs to a block by a hash of doc_id, so a
    rerun takes the same. Where a source's last block is needed in part, its rows are taken in the order of their
    hash until the quota is met, the last of them in part: taken words meet the target to the word. Rows with equal
    doc_id share a block; null doc_id hashes as any other value; the null source is a source, the last in order. A
    source without words has target 0 and none of its rows are taken.
    """
    spark = docs.sparkSession
    sizes = {x.source: x.b for x in docs.groupBy("source").agg(F.sum("size").alias("b")).collect()}
    goal, total = targets(sizes, weights), sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    n = {s: max(1, round(blocks * sizes[s] / max(1, total))) for s in order}
    facts = values_table(spark, [(i, s, sizes[s], float(goal[s]), n[s]) for i, s in enumerate(order)], "si int, source string, source_size long, target double, n_blocks int")
    # the sources' table is one short row per source; Spark broadcasts it only while it is under its own threshold
    rows = docs.join(facts, docs.source.eqNullSafe(facts.source)).drop(facts.source)
    rows = rows.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("block", F.pmod("h", "n_blocks").cast("int"))
    rows = rows.withColumn("place", F.xxhash64("h", F.lit(seed + 1)))
    heights = {(x.si, x.block): x.b for x in rows.groupBy("si", "block").agg(F.sum("size").alias("b")).collect()}
    rng = np.random.default_rng(seed)
    draws, partial = [], []
    for i, s in enumerate(order):
        whole, rest = divmod(round(goal[s]), max(1, sizes[s]))
        own = [(i, int(b)) for b in rng.permutation(n[s]) if (i, int(b)) in heights]
        mine = [(*k, e) for e in range(whole) for k in own]
        for k in own:
            if rest <= 0:
                break
            if heights[k] <= rest:
                mine.append((*k, whole))
            else:
                partial.append((*k, whole, rest))
                mine.append((*k, whole))
            rest -= heights[k]
        draws.append(mine)
    quotas = np.array([len(x) for x in draws], dtype=np.int64)
    dealt = split_tree(quotas, n_shards, rng) if len(quotas) else np.zeros((n_shards, 0), dtype=np.int64)
    taken: dict[tuple[int, int], list[int]] = {}
    for i, mine in enumerate(draws):
        shard_of = rng.permutation(np.repeat(np.arange(n_shards), dealt[:, i]))
        for (si, b, _), shard in zip(mine, shard_of):
            taken.setdefault((si, b), []).append(int(shard))
    cut = {(si, b): (e, rest) for si, b, e, rest in partial}
    t = values_table(spark, [(*k, ",".join(map(str, v)), *(cut.get(k) or (None, None))) for k, v in taken.items()], "si int, block int, dealt string, cut_at int, rest long")
    rows = rows.join(t, ["si", "block"], "left")
    # a block that is taken in part, one per source at most, is the only one whose rows need their order
    inside = Window.partitionBy("si", "block").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    some = rows.where("cut_at IS NOT NULL").withColumn("got", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.coalesce(F.sum("size").over(inside), F.lit(0)))))
    rows = rows.where("cut_at IS NULL").withColumn("got", F.lit(None).cast("long")).unionByName(some)
    shards = F.coalesce(F.split("dealt", ",").cast("array<int>"), F.array().cast("array<int>"))
    times = F.size(shards)
    return rows.select(
        "doc_id", "size", "source", "source_size", "target",
        F.when(F.col("got").isNull(), F.col("size") * times).otherwise(F.col("size") * (times - 1) + F.col("got")).cast("long").alias("taken"),
        F.when(F.col("got") == 0, F.slice(shards, 1, F.greatest(times - 1, F.lit(0)))).otherwise(shards).alias("shards"), "place", "key",
    )


def _key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (which tells rows of one doc_id apart) and the words of each text (null: 0), written once so that the passes of plan() read no text."""
    return checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _key().alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the input's columns, a row for each time a document is taken, in no order between shards but
    shuffled within them (column mix_shard aside, repartition by it and sort by mix_place to write shards).

    A document taken in part keeps its beginning up to its last word taken, white space included. Rows that are equal
    throughout are taken alike. Columns added: mix_size, mix_taken, mix_place, mix_time, mix_shard; a name that the input
    has is lengthened by underscores."""
    width = max([0, *map(len, docs.columns)])
    of = lambda k: k + "_" * width * (k in docs.columns)
    own, key = ("mix" + "_" * width + x for x in "ik")
    p = plan(sized(docs), **options).where("taken > 0 OR (size = 0 AND size(shards) > 0)")
    p = p.groupBy(F.col("doc_id").alias(own), F.col("key").alias(key)).agg(F.min(F.struct("size", "taken", "shards", "place")).alias(own + "m"))
    j = docs.join(p, docs.doc_id.cast("long").eqNullSafe(F.col(own)) & (_key() == F.col(key)))
    m = lambda k: F.col(f"`{own}m`.{k}").alias(of(f"mix_{k}"))
    j = j.select(*[docs[c] for c in docs.columns], m("size"), m("taken"), m("place"), F.posexplode(F.col(f"`{own}m`.shards")).alias(of("mix_time"), of("mix_shard")))
    size = F.col(of("mix_size"))
    words = F.least(size, F.col(of("mix_taken")) - F.col(of("mix_time")) * size).cast("int")
    # split at words, the last piece being what follows the last word taken
    after = F.element_at(F.split("text", WORD, F.greatest(words, F.lit(0)) + 1), -1)
    head = F.when(words >= size, F.col("text")).when(words > 0, F.substring("text", F.lit(1), F.length("text") - F.length(after))).otherwise(F.lit(""))
    out = j.withColumn("text", head)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(sized(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "shards")
