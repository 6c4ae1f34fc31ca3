"""The metrics table: one row per document with every metric of the taxonomy that its inputs allow.

What needs a text's tokens is one Arrow pass over a token array that Spark makes; a batch's tokens are dictionary-encoded, so
strings are looked at once per distinct token, and the rest is arithmetic on codes. Nothing of it is shuffled. Lexica of
up to lexicon.BROADCAST_ROWS tokens and a parser that is a function work in the same pass; larger lexica, parse tables and
vectors are tables of their own and are joined by the keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import punctuation, sentences, tokens, truncate, words
from . import lexicon, semantic, sequence, syntax

LENGTHS = [
    "n_tokens", "n_unique_tokens", "doc_length", "mean_word_length", "alpha_ratio", "token_length_mean", "token_length_median", "token_length_std",
    "syllables_per_token_mean", "syllables_per_token_median", "syllables_per_token_std", "chars", "syllable_count", "hard", "long_words",
]
SENTENCES = ["n_sentences", "sentence_length_mean", "sentence_length_median", "sentence_length_std"]
TOP, DUPLICATE = (2, 3, 4), (5, 6, 7, 8, 9, 10)
REPETITION = [f"top_ngram_share_{n}" for n in TOP] + [f"duplicate_ngram_chr_fraction_{n}" for n in DUPLICATE]
WHOLE = {"n_tokens", "n_unique_tokens", "doc_length", "chars", "syllable_count", "hard", "long_words", "n_sentences"}
# The tags of universal dependencies.
TAGS = ["ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X"]


def _spread(x: np.ndarray) -> tuple:
    """Mean, median and population deviation; nothing of nothing."""
    return (float(x.mean()), float(np.median(x)), float(x.std())) if len(x) else (None, None, None)


def _lengths(codes: np.ndarray, word: np.ndarray, size: np.ndarray, syllables: np.ndarray, alpha: np.ndarray) -> tuple:
    """LENGTHS of one text. A word is a token that begins with a letter, a digit or an underscore."""
    w = codes[word[codes]]
    l, s = size[w], syllables[w]  # noqa: E741
    share = float(alpha[w].mean()) if len(w) else None
    whole = float(size[codes].mean()) if len(codes) else None
    return len(w), len(np.unique(w)), len(codes), whole, share, *_spread(l), *_spread(s), int(l.sum()), int(s.sum()), int((s >= 3).sum()), int((l > 6).sum())


def _least_runs(at: np.ndarray, n: int, codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Of the places `at`, in order, one for each text that has some: where its least run of n tokens begins."""
    for k in range(n):
        first = np.flatnonzero(np.diff(owner[at], prepend=-1))
        code = codes[at + k]
        at = at[code == np.repeat(np.minimum.reduceat(code, first), np.diff(first, append=len(at)))] if len(at) else at
    return at[np.flatnonzero(np.diff(owner[at], prepend=-1))]


def _repetition(codes: np.ndarray, owner: np.ndarray, n_docs: int, size: np.ndarray, wanted: set[str]) -> dict[str, np.ndarray]:
    """REPETITION of all texts of a batch at once; codes must be in the order of their tokens. NaN where there is no n-gram.

    top_ngram_share_n is the length of the most frequent n-gram, with spaces (of several the least in order), times its count.
    A run of n tokens that is repeated begins with a repeated one of n - 1, so only those are made longer and counted."""
    out = {}
    longest = max((n for n in (*TOP, *DUPLICATE) if wanted & {f"top_ngram_share_{n}", f"duplicate_ngram_chr_fraction_{n}"}), default=1)
    before = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(size[codes])])  # characters before each token
    last = np.cumsum(np.bincount(owner, minlength=n_docs))  # where each text ends
    total = np.diff(before[last], prepend=0)
    base = int(codes.max(initial=0)) + 1
    # where repeated runs begin, in order, and their numbers, by text and then in the order of the runs
    at, gram = np.arange(len(codes)), owner * base + codes
    for n in range(1, longest + 1):
        if n > 1:
            within = at + n <= last[owner[at]]
            at, gram = at[within], gram[within]
            gram = gram * base + codes[at + n - 1]
        gram, count = np.unique(gram, return_inverse=True, return_counts=True)[1:]
        count = count[gram]
        again = count > 1
        at, gram, count = at[again], gram[again], count[again]
        if n in TOP and f"top_ngram_share_{n}" in wanted:
            order = np.lexsort((gram, -count, owner[at]))
            order = order[np.flatnonzero(np.diff(owner[at][order], prepend=-1))]
            share = np.full(n_docs, np.nan)
            share[owner[at[order]]] = count[order] * (before[at[order] + n] - before[at[order]] + n - 1)
            start = np.flatnonzero(np.isnan(share)[owner] & (np.arange(len(codes)) + n <= last[owner]))
            start = _least_runs(start, n, codes, owner)
            share[owner[start]] = before[start + n] - before[start] + n - 1
            out[f"top_ngram_share_{n}"] = share
        if n in DUPLICATE and f"duplicate_ngram_chr_fraction_{n}" in wanted:
            fresh = np.maximum(at, np.concatenate([np.zeros(1, dtype=np.int64), at[:-1] + n])[: len(at)])
            hit = np.bincount(owner[at], weights=before[at + n] - before[fresh], minlength=n_docs)
            out[f"duplicate_ngram_chr_fraction_{n}"] = hit / np.where(total > 0, total, np.nan)
    return out


@dataclass(frozen=True)
class Tokens:
    """The tokens of some texts in order: codes into the sorted distinct `values`, the text of each, and how many each text has."""

    values: pa.Array
    codes: np.ndarray
    owner: np.ndarray
    counts: np.ndarray


#: Columns (doubles, NaN where undefined) and what gives them for some texts at once.
Extra = tuple[list[str], Callable[[Tokens], dict[str, np.ndarray]]]
#: About so many tokens are looked at at once, so that a worker's memory does not depend on how many rows a batch has.
TOKENS_AT_ONCE = 1 << 19


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 4) -> None:
    """Bounds Arrow batches by rows and bytes, so that long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20)
    except Exception:  # noqa: BLE001  an older Spark has no such setting
        pass


def _pieces(b: pa.RecordBatch, at: int, most: int):
    """A batch in slices of consecutive rows whose lists in column `at` hold `most` items, or of single longer rows."""
    total = np.cumsum(pc.fill_null(pc.list_value_length(b.column(at)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield b.slice(lo, hi - lo)
        lo = hi


def token_metrics(docs: DataFrame, keys: list[str], wanted: list[str], text: Column | None = None, split: str = "seeded", window: int = 100, test_frac: float = 0.2, alpha: float = 0.1, seed: int = 2001, extra: tuple[Extra, ...] = (), at_once: int = TOKENS_AT_ONCE) -> DataFrame:
    """keys and the wanted columns of LENGTHS, SENTENCES, REPETITION and sequence.COLUMNS, then those of extra; others are not computed.

    Null and empty texts have counts of 0 and nulls for the rest."""
    small_batches(docs.sparkSession)
    text = docs.text if text is None else text
    added = [c for names, _ in extra for c in names]
    need = set(wanted)
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    per_sentence = F.transform(sentences(text), lambda s: F.regexp_count(s, F.lit(r"[\p{L}\p{N}_]+"))) if need & set(SENTENCES) else F.array().cast("array<int>")
    nk = len(keys)

    def run(batches):
        for b in (piece for batch in batches for piece in _pieces(batch, nk, at_once)):
            lists = pc.fill_null(pc.list_value_length(b.column(nk)), 0).to_numpy(zero_copy_only=False)
            encoded = b.column(nk).flatten().dictionary_encode()
            values = encoded.dictionary
            codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            rank = np.empty(len(values), dtype=np.int64)
            order = pc.sort_indices(values).to_numpy()
            rank[order] = np.arange(len(values))
            codes, values = rank[codes], values.take(pa.array(order))
            number = lambda x, kind=np.int64: x.to_numpy(zero_copy_only=False).astype(kind)
            size = number(pc.utf8_length(values))
            if need & set(LENGTHS):
                word = number(pc.match_substring_regex(values, r"^[\p{L}\p{N}_]"), bool)
                syllables = np.maximum(1, number(pc.count_substring_regex(values, "[aeiouy]+")))
                letter = number(pc.match_substring_regex(values, r"\p{L}"), float)
            ends = np.cumsum(lists)
            owner = np.repeat(np.arange(b.num_rows), lists)
            found: dict[str, list] = {c: [] for c in wanted}
            give = lambda names, row: [found[c].append(v) for c, v in zip(names, row) if c in need]
            counts = b.column(nk + 1).to_pylist()
            for i, (hi, n) in enumerate(zip(ends, lists)):
                c = codes[hi - n : hi]
                if need & set(LENGTHS):
                    give(LENGTHS, _lengths(c, word, size, syllables, letter))
                if need & set(SENTENCES):
                    x = np.array(counts[i] or [], dtype=np.int64)
                    give(SENTENCES, (len(x), *_spread(x)))
                if need & set(sequence.COLUMNS):
                    give(sequence.COLUMNS, sequence.all_metrics(np.unique(c, return_inverse=True)[1] if n else c, need, split, window, test_frac, alpha, seed))
            if need & set(REPETITION):
                for c, v in _repetition(codes, owner, b.num_rows, size, need).items():
                    found[c] = [None if np.isnan(x) else float(x) for x in v]
            cols = [pa.array(found[c], pa.int64() if c in WHOLE else pa.float64()) for c in wanted]
            for names, f in extra:
                got = f(Tokens(values, codes, owner, lists))
                cols += [pa.array(got[c], pa.float64(), from_pandas=True) for c in names]
            yield pa.record_batch([*(b.column(i) for i in range(nk)), *cols], names=[*keys, *wanted, *added])

    rows = docs.select(*keys, tokens(text).alias("t"), per_sentence.alias("s"))
    return rows.mapInArrow(run, kinds + "".join(f", {c} {'long' if c in WHOLE else 'double'}" for c in [*wanted, *added]))


def readability_of() -> dict[str, Column]:
    """The classic formulas over LENGTHS and n_sentences; null where a text has no word or no sentence."""
    w, s = F.when(F.col("n_tokens") > 0, F.col("n_tokens")), F.when(F.col("n_sentences") > 0, F.col("n_sentences"))
    asl, asw, chars, hard = w / s, F.col("syllable_count") / w, F.col("chars"), F.col("hard")
    return {
        "flesch_reading_ease": F.lit(206.835) - F.lit(1.015) * asl - F.lit(84.6) * asw, "flesch_kincaid_grade": F.lit(0.39) * asl + F.lit(11.8) * asw - F.lit(15.59),
        "smog": F.lit(1.043) * F.sqrt(F.lit(30.0) * hard / s) + F.lit(3.1291), "gunning_fog": F.lit(0.4) * (asl + F.lit(100.0) * hard / w),
        "automated_readability_index": F.lit(4.71) * chars / w + F.lit(0.5) * asl - F.lit(21.43), "coleman_liau_index": F.lit(5.88) * chars / w - F.lit(29.6) * s / w - F.lit(15.8),
        "lix": asl + F.lit(100.0) * F.col("long_words") / w, "rix": F.col("long_words") / s,
    }


def duplicate_share(text: Column, separator: str = "\n") -> Column:
    """Share of a text's characters in lines (or paragraphs) that it has had before: all of them less the distinct ones."""
    once = F.length(F.array_join(F.array_distinct(F.split(text, separator)), ""))
    return F.when(F.length(text) > 0, (F.length(F.replace(text, F.lit(separator), F.lit(""))) - once) / F.length(text))


def text_metrics(docs: DataFrame, keys: list[str], split: str = "seeded", max_chars: int | None = None, extra: tuple[Extra, ...] = ()) -> DataFrame:
    """keys and every metric that needs the text alone, under the taxonomy's names, then those of extra."""
    text = docs.text if max_chars is None else truncate(docs.text, max_chars)
    lines = {"duplicate_line_chr_fraction": duplicate_share(text), "duplicate_paragraph_chr_fraction": duplicate_share(text, "\n\n")}
    own = {"n_characters": F.length(text), **lines, **punctuation(text)}
    rows = docs.select(*keys, text.alias("text"), F.struct(*[c.cast("double" if n != "n_characters" else "int").alias(n) for n, c in own.items()]).alias("own_"))
    m = token_metrics(rows, [*keys, "own_"], [*LENGTHS, *SENTENCES, *REPETITION, *sequence.COLUMNS], split=split, extra=extra)
    whole = F.col("own_.n_characters")
    shares = [(F.col(f"top_ngram_share_{n}") / F.when(whole > 0, whole)).alias(f"top_ngram_chr_fraction_{n}") for n in TOP]
    unique = (F.col("n_unique_tokens") / F.when(F.col("n_tokens") > 0, F.col("n_tokens"))).alias("proportion_unique_tokens")
    skip = {"chars", "syllable_count", "hard", "long_words"}
    plain = [c for c in [*LENGTHS, *SENTENCES, *(f"duplicate_ngram_chr_fraction_{n}" for n in DUPLICATE), *sequence.COLUMNS] if c not in skip]
    return m.select(*keys, "own_.*", unique, *plain, *shares, *[c.alias(n) for n, c in readability_of().items()], *[c for names, _ in extra for c in names])


def score_documents(docs: DataFrame, keys: tuple[str, ...] = ("id", "source"), lexica: dict[str, DataFrame] | None = None, parse: DataFrame | Callable | None = None, vectors: DataFrame | None = None, affect: str = "historical", split: str = "seeded", max_chars: int | None = None) -> DataFrame:
    """The metrics table: keys and one column per metric, named as in the taxonomy; one row per row of docs (keys, text).

    lexica: concreteness, aoa, prevalence (token, score), vad (token, valence, arousal, dominance), emotion (term, emotion,
    score), vocabulary (token). affect "historical" takes concreteness only, "modern" all of them. parse: keys, sent, k, token,
    pos, dep, head, or a function that parses tokens (see syntax.parsed). vectors: keys, idx, vec. A family whose table is missing is left out; a document that such a table
    lacks has nulls. Keys must be unique; documents are compared with nothing, so only the tables' joins are shuffles."""
    if affect not in ("historical", "modern"):
        raise ValueError(f"affect is historical or modern, not {affect!r}")
    keys, lexica = list(keys), lexica or {}
    key = F.struct(*keys)
    keyed = docs.select(key.alias("doc_id"), "text")
    parts, extra = [], []
    norms = {"concreteness": ("mean", "std"), "aoa": ("mean", "std"), "prevalence": ("mean",)}
    norms = [(n, ("score",), stats) for n, stats in norms.items() if n in lexica and (affect == "modern" or n == "concreteness")]
    if affect == "modern" and "vad" in lexica:
        norms.append(("vad", ("valence", "arousal", "dominance"), ("mean", "std")))
    # lexica look at whole texts, the pass at their first max_chars
    inline = lambda table: max_chars is None and lexicon.is_small(table)
    for name, columns, stats in norms:
        if inline(lexica[name]):
            extra.append(lexicon.score_inline(lexica[name], name, columns, stats))
        else:
            parts.append(lexicon.score(keyed, lexica[name], name, columns, stats, coverage=False))
    if affect == "modern" and "emotion" in lexica:
        if inline(lexica["emotion"]):
            extra.append(lexicon.emotions_inline(lexica["emotion"]))
        else:
            parts.append(lexicon.emotions(keyed, lexica["emotion"]))
    if "vocabulary" in lexica:
        if inline(lexica["vocabulary"]):
            extra.append(lexicon.out_of_vocabulary_inline(lexica["vocabulary"]))
        else:
            parts.append(lexicon.out_of_vocabulary(keyed, lexica["vocabulary"]))
    if callable(parse):
        extra.append(syntax.inline(parse, TAGS))
    elif parse is not None:
        p = parse.select(key.alias("doc_id"), "sent", "k", "token", "pos", "dep", "head")
        parts += [syntax.complexity(p), syntax.tree_depth(p), syntax.dependency_distance(p), syntax.pos_proportions(p, TAGS)]
    out = text_metrics(docs, keys, split, max_chars, tuple(extra))
    if vectors is not None:
        v = vectors.select(key.alias("doc"), "idx", "vec")
        many = keyed.select("doc_id", F.size(words(F.col("text"))).alias("words_"))
        path = semantic.trajectory(v).withColumnRenamed("doc", "doc_id").join(many, "doc_id")
        path = path.withColumn("semantic_trajectory_length_per_word", F.col("cumulative_semantic_trajectory_length") / F.when(F.col("words_") > 0, F.col("words_"))).drop("words_")
        parts += [path, *(f(v).withColumnRenamed("doc", "doc_id") for f in (semantic.range_max, semantic.dispersion, semantic.topic_structure))]
    if not parts:
        return out
    out = out.select(key.alias("doc_id"), *[c for c in out.columns if c not in keys])
    for part in parts:
        out = out.join(part, "doc_id", "left")
    return out.select(*[F.col(f"doc_id.{k}").alias(k) for k in keys], *[c for c in out.columns if c != "doc_id"])
