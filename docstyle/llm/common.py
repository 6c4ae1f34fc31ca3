"""What the operators of this subpackage share: reading, checkpoints, batches, small tables, connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts define them: runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null becomes empty); every other column is left behind, so no name can clash.

    A doc_id that is a long already is taken as it is: an alias would keep Spark from reusing an exchange of it."""
    doc_id = F.col("doc_id") if docs.schema["doc_id"].dataType.simpleString() == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(doc_id, F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a copy in the folder of spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent a temporary folder serves in local mode, as in tests; on a cluster it is an error."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same for many narrow rows: a Parquet table in that folder, which takes a fraction of a checkpoint's disk.

    It does not keep how the rows are partitioned; the driver removes it when it ends."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001  the JVM is gone already
        pass


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Marks a table of a few short columns for broadcasting if it has at most `most` rows, counted no further than that;
    a larger one is left to a shuffled join, with the same result."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 4) -> None:
    """Bounds Arrow batches by rows and bytes, so that long texts do not add up in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20)
    except Exception:  # noqa: BLE001  an older Spark has no such setting
        pass


def values_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of driver-side rows as literals, so that its plan is a LocalRelation whose size Spark knows."""
    names = [x.split()[0] for x in schema.split(",")]
    kinds = [x.split()[1] for x in schema.split(",")]
    lit = lambda v: "NULL" if v is None else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v)
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {k}) AS {n}" for n, k in zip(names, kinds)) + " WHERE false")
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return spark.sql(f"SELECT {', '.join(f'CAST({n} AS {k}) AS {n}' for n, k in zip(names, kinds))} FROM VALUES {body} AS t({', '.join(names)})")


def ranges_of(key: str, splitters: list[int]) -> Column:
    """Number of splitters that are <= key, as a balanced tree of comparisons that whole-stage codegen compiles."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"IF({key} < {splitters[mid]}L, {tree(lo, mid)}, {tree(mid + 1, hi)})"

    return F.expr(tree(0, len(splitters)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components: (node, component), component being the smallest node that is reachable.

    Alternates large-star and small-star (Kiveris et al. 2014, "Connected components in MapReduce and beyond"): the
    depth of the trees shrinks geometrically, every round is two shuffles of the remaining edges, and each step is
    checkpointed. Neighbourhoods are never collected: the smallest neighbour is an aggregate joined back by key.
    """
    e = checkpoint(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    for _ in range(most_rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(least, "u")
        small = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(j.select("u", F.col("m").alias("v")))
        e = checkpoint(small.where("u > v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
