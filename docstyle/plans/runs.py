"""Runs that can be resumed: work whose key is done is anti-joined away, new rows are appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import todo
from ..sources.io import append_completions, read_table


def resumable(spark: SparkSession, records: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, keys: list[str], commits: int = 1) -> DataFrame:
    """Scores the records that `path` (a Parquet table) lacks, appends them, and returns the whole table.

    Of records with the same keys one is scored. commits: records are dealt by a hash of their keys into so many
    batches, each appended when it is done, so a run that breaks off loses one batch at most. Nothing is written
    if nothing is left."""
    done = read_table(spark, path)
    left = (records if done is None else todo(records, done, keys)).dropDuplicates(keys)
    if done is not None and left.isEmpty():
        return done
    for k in range(commits):
        score(left if commits == 1 else left.where(F.pmod(F.xxhash64(*keys), F.lit(commits)) == k)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def mapped(records: DataFrame, function: Callable[[dict], dict], schema: str, keys: list[str], on_error: str = "skip") -> DataFrame:
    """function of each record (as a dict) as a table of the keys, the columns of `schema` and error (null if it went well).

    on_error: "skip" drops a record whose function raises, "record" keeps its keys and the error, "raise" fails the run.
    For functions that only Python has; what columns can say is cheaper said so."""
    if on_error not in ("skip", "record", "raise"):
        raise ValueError(f"on_error is skip, record or raise, not {on_error!r}")
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    whole = StructType([records.schema[k] for k in keys] + _parse_datatype_string(schema).fields + [StructField("error", _parse_datatype_string("string"))])
    names = [f.name for f in whole][len(keys) : -1]
    arrow = to_arrow_schema(whole)

    def run(batches):
        for b in batches:
            rows = []
            for x in b.to_pylist():
                own = {k: x[k] for k in keys}
                try:
                    got = function(x)
                    rows.append(own | {c: got.get(c) for c in names} | {"error": None})
                except Exception as e:  # noqa: BLE001  any failure of the caller's function
                    if on_error == "raise":
                        raise
                    if on_error == "record":
                        rows.append(own | dict.fromkeys(names) | {"error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return records.mapInArrow(run, whole)


_BUILT: dict = {}


def once_per_worker(name: str, build: Callable[[], object]) -> object:
    """What build() gives, built once in the life of a Python worker: for parsers, embedders and language models, which are
    costly to load and can't be sent. Call it inside a function that runs on executors."""
    if name not in _BUILT:
        _BUILT[name] = build()
    return _BUILT[name]


def complete(prompts: DataFrame, generate: Callable[..., str], path: str, model: str, max_new_tokens: int = 650, template: Callable[[str], str] | None = None, **sampling) -> None:
    """Completes the prompts (id, prompt) that the JSON log at `path` lacks; broken lines of the log are passed over.

    generate(prompt, max_new_tokens, **sampling) runs on executors, once per prompt; it may build its model by
    once_per_worker(). sampling: temperature, top_p, penalties, whatever the model takes. template: makes a model's chat
    format of a prompt."""
    import pyarrow as pa

    template = template or str

    spark = prompts.sparkSession
    try:
        done = spark.read.schema("id string, completion string").option("mode", "DROPMALFORMED").json(path).where("id IS NOT NULL")
        left = todo(prompts, done, ["id"])
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        left = prompts

    def run(batches):
        for b in batches:
            text = [generate(template(p), max_new_tokens, **sampling) for p in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(text, pa.string())], names=["id", "completion"])

    out = left.select("id", "prompt").mapInArrow(run, "id string, completion string")
    append_completions(out.withColumn("model", F.lit(model)).withColumn("max_new_tokens", F.lit(max_new_tokens)), path)


def reverse_words(prompt: str, max_new_tokens: int) -> str:
    """A provider for tests: the last words of a prompt, backwards."""
    return " ".join(prompt.split()[::-1][:max_new_tokens])
