"""Operator 5, sharding [native]: sampled splitters over a range-partitioned key.

A size-weighted sample of keys gives quantile boundaries; records are range-partitioned by them; ranges that turn
out overfull (a text that a third of all rows share is one key) or that straddle a shard's edge are subdivided.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, ranges_of, table, text_of, values_table

N_SHARDS = 8


def shard_by_bytes(docs: DataFrame, n_shards: int = N_SHARDS, ranges_per_shard: int = 16, sample_per_range: int = 40, pieces: int = 16, rows_per_piece: int = 1_000_000) -> DataFrame:
    """Deals documents into n_shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Key: a 64-bit hash of the text, so equal texts lie in one range and stay together wherever that range is not
    subdivided. The sample takes a key with a chance in proportion to its size, decided by a hash, so reruns agree;
    it holds about n_shards * ranges_per_shard * sample_per_range keys, however large the table, and only those and
    one row of counts per piece reach the driver. Exact counts of all rows then decide which ranges are subdivided
    (by a hash of doc_id) and where a shard ends. A piece holds about rows_per_piece rows at most, so slots are
    numbered within pieces and shifted by the exact counts of the pieces before.

    Null or empty text: size 1, crc 0. Null doc_id: an ordinary row. Repeated rows: each has a slot of its own.
    A document larger than a shard's share stays whole, and its shard is then that much larger. Empty table: no rows.
    """
    spark = docs.sparkSession
    base = text_of(docs).select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("k"))
    base = checkpoint(base.withColumn("s", F.xxhash64("doc_id", F.lit(5))))
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n_ranges = n_shards * ranges_per_shard
    draws = n_ranges * sample_per_range
    # a row of at least total / draws bytes is drawn for certain and then counts for its size
    unit = max(1.0, total / draws)
    chance = F.col("size") / F.lit(unit)
    uniform = F.shiftrightunsigned(F.xxhash64("k", "s"), 11) / F.lit(float(1 << 53))
    sample = sorted(base.where(uniform < chance).select("k", F.greatest(F.col("size").cast("double"), F.lit(unit)).alias("w")).collect())
    weight, splitters, step = 0.0, [], sum(x.w for x in sample) / n_ranges
    for x in sample:
        weight += x.w
        if weight >= step * (len(splitters) + 1) and len(splitters) < n_ranges - 1 and (not splitters or x.k > splitters[-1]):
            splitters.append(x.k)
            # a heavy key passes several quantiles at once: they collapse into one boundary
            weight = max(weight, step * len(splitters))
    ranged = base.withColumn("r", ranges_of("k", splitters))
    counts = sorted(ranged.groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect())
    share, done, cut = total / n_shards, 0, {}
    for x in counts:
        straddles = int(done / share) != int((done + x.b) / share) if share else False
        cut[x.r] = max(pieces if straddles or x.b > 2 * total / n_ranges else 1, -(-x.b * n_ranges // max(1, total)) * (pieces if x.b > 2 * total / n_ranges else 1), -(-x.n // rows_per_piece))
        done += x.b
    cuts = values_table(spark, [(r, n) for r, n in cut.items()], "r int, cut int")
    pieced = ranged.join(F.broadcast(cuts), "r").withColumn("p", F.pmod(F.col("s"), F.col("cut")).cast("int"))
    # one row per piece: as many as there are ranges, their subdivisions and millions of rows
    done, places, slots = 0, [], [0] * n_shards
    for x in sorted(pieced.groupBy("r", "p").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()):
        shard = min(n_shards - 1, int((done + x.b / 2) / share)) if share else 0
        places.append((x.r, x.p, shard, slots[shard]))
        slots[shard] += x.n
        done += x.b
    placed = pieced.join(F.broadcast(values_table(spark, places, "r int, p int, shard int, first long")), ["r", "p"])
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("r", "p").orderBy("k", "doc_id", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + at - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))
