"""Readers and writers: JSON lines, CSV, Parquet tables, lexica, model tables, append-only completion logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def load_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON object per line; a broken line fails the read."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def load_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV whose cells may hold quotes and line ends. Without a schema all columns are strings, so ids keep leading zeros."""
    reader = spark.read.option("header", header).option("multiLine", True).option("escape", '"').option("sep", sep)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """Parquet by suffix, else CSV; None if nothing is there."""
    try:
        return spark.read.parquet(path) if path.endswith(".parquet") else load_csv(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet if the path ends so, else CSV with a header."""
    if path.endswith(".parquet"):
        df.write.mode(mode).parquet(path)
    else:
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row, UTF-8, nulls left out."""
    df.write.mode(mode).json(path)


def append_completions(df: DataFrame, path: str) -> None:
    """Adds (id, completion, model, max_new_tokens, timestamp_utc) to an append-only JSON log."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    df.withColumn("timestamp_utc", stamp).write.mode("append").json(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, ord): the lines of a small file in its order."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\r?\n")).alias("ord", "line"))


def _last(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Of rows with the same key the last in the file."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), "ord").alias("v")).select(*keys, "v.*")


def _sniffed(spark: SparkSession, path: str, sep: str | None) -> DataFrame:
    lines = _lines(spark, path)
    first = lines.where("ord = 0").select("line").first()
    return lines.select("ord", F.split("line", sep or ("\t" if first and "\t" in first[0] else ",")).alias("f"))


def load_vad_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term, valence, arousal, dominance); short rows and rows without numbers, as a header, are passed over."""
    num = lambda i: F.col("f")[i].try_cast("double")
    rows = _sniffed(spark, path, None).where("size(f) >= 4").select("ord", F.lower(F.trim(F.col("f")[0])).alias("term"), num(1).alias("valence"), num(2).alias("arousal"), num(3).alias("dominance"))
    return _last(rows.where("valence IS NOT NULL AND arousal IS NOT NULL AND dominance IS NOT NULL"), ["term"], ["valence", "arousal", "dominance"])


def load_emotion_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term, emotion, score) from three tab-separated fields; any emotion name is kept, lower-cased."""
    rows = _lines(spark, path).select("ord", F.split("line", "\t").alias("f")).where("size(f) = 3")
    rows = rows.select("ord", F.lower(F.trim(F.col("f")[0])).alias("term"), F.lower(F.trim(F.col("f")[1])).alias("emotion"), F.col("f")[2].try_cast("double").alias("score"))
    return _last(rows.where("score IS NOT NULL"), ["term", "emotion"], ["score"])


def load_norm_lexicon(spark: SparkSession, path: str, term_col: int = 0, score_col: int = 1, sep: str | None = None, skip_header: bool = True) -> DataFrame:
    """(token, score) by position."""
    rows = _sniffed(spark, path, sep).where(F.size("f") > max(term_col, score_col)).where(F.col("ord") >= int(skip_header))
    rows = rows.select("ord", F.lower(F.trim(F.col("f")[term_col])).alias("token"), F.col("f")[score_col].try_cast("double").alias("score"))
    return _last(rows.where("score IS NOT NULL"), ["token"], ["score"])


def load_norm_by_name(spark: SparkSession, path: str, term_field: str, score_field: str, sep: str | None = None) -> DataFrame:
    """(token, score) by column name; KeyError, listing the columns, if one is missing."""
    head = _sniffed(spark, path, sep).where("ord = 0").first()
    names = [x.strip() for x in head.f] if head else []
    for c in (term_field, score_field):
        if c not in names:
            raise KeyError(f"no column {c!r}; found {names}")
    return load_norm_lexicon(spark, path, names.index(term_field), names.index(score_field), sep)


def save_model(spark: SparkSession, fitted: dict, moments: dict[str, tuple[float, float]], path: str) -> None:
    """A fitted factor model as a Parquet table: feature, ord, mean, scale, loadings, weights."""
    rows = [(c, i, *map(float, moments[c]), fitted["pattern"][i].tolist(), fitted["weights"][i].tolist()) for i, c in enumerate(fitted["columns"])]
    spark.createDataFrame(rows, "feature string, ord int, mean double, scale double, loadings array<double>, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> tuple[list[str], dict[str, tuple[float, float]], list[list[float]]]:
    rows = spark.read.parquet(path).orderBy("ord").collect()
    return [x.feature for x in rows], {x.feature: (x.mean, x.scale) for x in rows}, [list(x.weights) for x in rows]
