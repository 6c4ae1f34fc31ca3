"""Assembling text tables, resuming finished work, and cutting excerpts for continuation prompts."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SENTENCE_END, after_marker, words
from .scoring import small_batches

INSTRUCTION = "Continue the passage below in the same voice for about {n} words. Write prose only.\n\nPASSAGE:\n"


def text_table(records: DataFrame, outputs: DataFrame | None = None, source: str = "human", output_source: str = "ai", prompt: str | None = None, marker: str = "PASSAGE:") -> DataFrame:
    """(id, source, text): a row per record, and one per record that has an output. Of outputs with one id the last (by ord) counts."""
    text = after_marker(F.col(prompt), marker) if prompt else F.col("text")
    human = records.select(F.col("id").cast("string").alias("id"), F.lit(source).alias("source"), text.alias("text"))
    if outputs is None:
        return human
    last = outputs.groupBy(F.col("id").cast("string").alias("id")).agg(F.max_by("completion", "ord").alias("text"))
    return human.unionByName(human.select("id").join(last, "id").select("id", F.lit(output_source).alias("source"), "text"))


def todo(records: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Records whose key is not done yet."""
    return records.join(done.select(*keys).distinct(), keys, "left_anti")


def merge_families(base: DataFrame, *families: DataFrame, keys=("id", "source")) -> DataFrame:
    """Left joins of metric tables on the keys; each brings its metrics only."""
    for f in families:
        base = base.join(f, list(keys), "left")
    return base


def segments(docs: DataFrame, n_chunks: int = 3, least: int = 500, key: str = "doc_id", keep=()) -> DataFrame:
    """(key, or source_id if that is id; chunk_idx, id, words, keep...) of texts of at least `least` words: equal parts, the last with the remainder."""
    w = docs.select(key, *keep, words(F.col("text")).alias("w")).where(F.size("w") >= least)
    size = F.floor(F.size("w") / n_chunks).cast("int")
    part = lambda i: F.slice(F.col("w"), i * size + 1, F.when(i == n_chunks - 1, F.size("w") - i * size).otherwise(size))
    s = w.select(key, *keep, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n_chunks - 1)), part)).alias("chunk_idx", "words"))
    return s.select(F.col(key).alias("source_id" if key == "id" else key), "chunk_idx", F.concat(F.col(key).cast("string"), F.lit("__chunk"), F.lpad(F.col("chunk_idx").cast("string"), 2, "0")).alias("id"), "words", *keep)


def bounds(ends: np.ndarray, n: int, start: np.ndarray, raw: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, stop) in words of the excerpt that each window [start, start + raw) of n words gives; 0, 0 where it gives none.

    ends: after how many words a sentence ends, ascending. An excerpt stops at the last end that `most` words reach, or at
    the window's first; it begins after the earliest end from which it is of least to most words, or at the window's
    start. A window without an end is cut at `most` words."""
    limit = np.minimum(start + raw, n)
    padded = np.append(ends, np.iinfo(np.int64).max)
    first = padded[np.searchsorted(ends, start, side="right")]
    last = np.append(-1, ends)[np.searchsorted(ends, np.minimum(limit, start + most), side="right")]
    stop = np.where(first > limit, np.minimum(limit, start + most), np.where(last > start, last, np.minimum(first, start + most)))
    begin = padded[np.searchsorted(ends, np.maximum(start + 1, stop - most), side="left")]
    begin = np.where((first <= limit) & (begin <= stop - least), begin, start)
    fits = stop - begin >= least
    return np.where(fits, begin, 0), np.where(fits, stop, 0)


def sentence_ends(w: list[str]) -> np.ndarray:
    """After how many words a sentence ends: those that hold an end."""
    return np.array([i for i, x in enumerate(w, 1) if re.search(SENTENCE_END, x)], dtype=np.int64)


def window(n: int, ends: np.ndarray, least: int, most: int, rng: np.random.Generator, extra=(50, 120), tries: int = 60) -> tuple[int, int]:
    """(begin, stop) of the excerpt of the first of some random windows of n words that gives one, all drawn at once; failing
    all, that of the text's beginning. A window has extra[0] to extra[1] words more than the excerpt may have."""
    raw = np.append(np.minimum(n, most + rng.integers(extra[0], extra[1] + 1, tries)), most + extra[1])
    start = np.append(rng.integers(0, np.maximum(1, n - raw[:-1])), 0)
    begin, stop = bounds(ends, n, start, raw, least, most)
    at = int(np.argmax(stop > begin))
    return int(begin[at]), int(stop[at])


def sample(w: list[str], least: int, most: int, rng: np.random.Generator, extra=(50, 120), tries: int = 60) -> list[str]:
    """The words of window()."""
    begin, stop = window(len(w), sentence_ends(w), least, most, rng, extra, tries)
    return w[begin:stop]


def excerpts(docs: DataFrame, n_chunks: int = 3, least: int = 500, most: int = 600, seed: int = 19, key: str = "doc_id", keep=()) -> DataFrame:
    """id, source_id, chunk_idx, target_words, excerpt_words, excerpt, keep...; draws are seeded by the excerpt's id, so they do
    not depend on the order of rows or on partitions. Segments without an excerpt give no row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    small_batches(docs.sparkSession)
    names = ["id", "source_id", "chunk_idx", "target_words", "excerpt_words", "excerpt", *keep]

    def run(batches):
        for b in batches:
            # the parts are those of segments(); texts are split once, and their sentences' ends found for all words at once
            size = pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False)
            first = np.cumsum(size) - size
            flat = b.column(2).flatten()
            ends = np.flatnonzero(pc.match_substring_regex(flat, SENTENCE_END).to_numpy(zero_copy_only=False)) + 1
            at, own = [], {c: [] for c in names[2:6] + ["id"]}
            for i, key_text in enumerate(b.column(1).to_pylist()):
                n = int(size[i])
                if n < least:
                    continue
                for j in range(n_chunks):
                    lo = int(first[i]) + j * (n // n_chunks)
                    hi = int(first[i]) + (n if j == n_chunks - 1 else (j + 1) * (n // n_chunks))
                    name = None if key_text is None else key_text + "__chunk" + f"{j:02d}"[:2]
                    rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(f"{seed}:{name}".encode(), digest_size=8).digest(), "big"))
                    goal = int(rng.integers(least, most + 1))
                    begin, stop = window(hi - lo, ends[np.searchsorted(ends, lo, side="right") : np.searchsorted(ends, hi, side="right")] - lo, least, most, rng)
                    if stop > begin:
                        at.append(i)
                        for c, v in zip(own, (j, goal, stop - begin, " ".join(flat.slice(lo + begin, stop - begin).to_pylist()), name)):
                            own[c].append(v)
            rows = pa.array(at, pa.int64())
            made = [pa.array(own[c], pa.string() if c == "excerpt" else pa.int32()) for c in names[2:6]]
            yield pa.record_batch([pa.array(own["id"], pa.string()), b.column(0).take(rows), *made, *(b.column(3 + j).take(rows) for j in range(len(keep)))], names=names)

    kind = lambda c: docs.schema[c].dataType.simpleString()
    schema = f"id string, source_id {kind(key)}, chunk_idx int, target_words int, excerpt_words int, excerpt string"
    rows = docs.select(key, F.col(key).cast("string").alias("key_"), words(F.col("text")).alias("w_"), *keep)
    return rows.mapInArrow(run, schema + "".join(f", `{c}` {kind(c)}" for c in keep))


def excerpts_and_prompts(records: DataFrame, key: str = "id", text: str = "text", n_chunks: int = 3, least: int = 500, most: int = 600, seed: int = 19) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(excerpts with the records' other columns, prompts (id, prompt), skipped (key, words)) of records with unique keys;
    skipped are the texts of under `least` words, null ones included."""
    docs = records.withColumn("text", F.col(text)) if text != "text" else records
    taken = {key, text, "text", "id", "source_id", "chunk_idx", "target_words", "excerpt_words", "excerpt"}
    found = excerpts(docs, n_chunks, least, most, seed, key, [c for c in records.columns if c not in taken])
    count = F.greatest(F.coalesce(F.size(words(F.col(text))), F.lit(0)), F.lit(0))
    return found, found.select("id", prompt(F.col("excerpt"), F.col("target_words")).alias("prompt")), records.select(key, count.alias("words")).where(F.col("words") < least)


def prompt(excerpt, target_words):
    head, tail = INSTRUCTION.split("{n}")
    return F.concat(F.lit(head), target_words.cast("string"), F.lit(tail), excerpt)


def first_of_each(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    over = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(over)).where("_n = 1").drop("_n")
