"""Descriptive, readability and repetition statistics of a table of (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scoring


def descriptive(docs: DataFrame) -> DataFrame:
    """Counts, distinct share, and mean, median and population deviation of token lengths and syllables; null of no words."""
    rows = docs.select("doc_id", "text", F.length("text").alias("n_characters"))
    m = scoring.token_metrics(rows, ["doc_id", "n_characters"], [*scoring.LENGTHS, "n_sentences"])
    return m.withColumn("proportion_unique_tokens", F.col("n_unique_tokens") / F.when(F.col("n_tokens") > 0, F.col("n_tokens")))


def readability(docs: DataFrame) -> DataFrame:
    """The classic formulas; null where a text has no word or no sentence."""
    m = scoring.token_metrics(docs, ["doc_id"], ["n_tokens", "chars", "syllable_count", "hard", "long_words", "n_sentences"])
    return m.select("doc_id", *[c.alias(n) for n, c in scoring.readability_of().items()])


def sentence_lengths(docs: DataFrame) -> DataFrame:
    """Mean, median and population deviation of words per sentence."""
    return scoring.token_metrics(docs, ["doc_id"], scoring.SENTENCES[1:])


def duplicate_lines(docs: DataFrame, separator: str = "\n", name: str = "duplicate_line_chr_fraction") -> DataFrame:
    """Share of a text's characters in lines (or paragraphs) that it has had before."""
    return docs.select("doc_id", scoring.duplicate_share(F.col("text"), separator).alias(name))


def top_ngrams(docs: DataFrame, sizes=scoring.TOP) -> DataFrame:
    """For each n the share of characters that all occurrences of the most frequent n-gram have (ties: the least)."""
    rows = docs.select("doc_id", "text", F.length("text").alias("n_characters"))
    m = scoring.token_metrics(rows, ["doc_id", "n_characters"], [f"top_ngram_share_{n}" for n in sizes])
    return m.select("doc_id", *[(F.col(f"top_ngram_share_{n}") / F.when(F.col("n_characters") > 0, F.col("n_characters"))).alias(f"top_ngram_chr_fraction_{n}") for n in sizes])


def duplicate_ngrams(docs: DataFrame, sizes=scoring.DUPLICATE) -> DataFrame:
    """For each n the share of token characters that n-grams seen more than once cover, overlaps counted once."""
    return scoring.token_metrics(docs, ["doc_id"], [f"duplicate_ngram_chr_fraction_{n}" for n in sizes])
