"""What the pass over tokens holds at once does not grow with the rows of an Arrow batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docstyle.operators import scoring, textstats


def batch(rows: int) -> pa.RecordBatch:
    """Texts of 1,000 tokens of a small vocabulary, all in one batch."""
    codes = np.random.default_rng(5).integers(0, 500, rows * 1000)
    words = pa.array([f"w{i}" for i in range(500)]).take(pa.array(codes))
    t = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * 1000, pa.int32()), words)
    return pa.record_batch([pa.array(np.arange(rows)), pa.array(np.full(rows, 6000)), t, pa.array([[]] * rows, pa.list_(pa.int32()))], names=["doc_id", "n_characters", "t", "s"])


@pytest.mark.parametrize("query", ["top_ngrams", "duplicate_ngrams"])
def test_peak_does_not_grow_with_the_batch(spark, monkeypatch, query):
    docs, kept = spark.createDataFrame([(0, "a")], "doc_id long, text string"), {}

    def caught(self, run, schema):
        kept["run"] = run
        return original(self, run, schema)

    original = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", caught)
    getattr(textstats, query)(docs)
    first = [0, 1, 2, 3] if query == "top_ngrams" else [0, 2, 3]
    peaks = []
    for rows in (600, 2400):
        b = batch(rows).select(first)
        tracemalloc.start()
        n = sum(out.num_rows for out in kept["run"](iter([b])))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert n == rows
    assert peaks[1] < 1.5 * peaks[0], peaks
    assert peaks[1] < 100 << 20, peaks


def test_what_is_held_at_once_is_bounded_over_sparks_own_batches(spark):
    # one task of 2,000,000 tokens of a letter, of which an Arrow batch of 4 MB holds more than a piece may
    docs = spark.range(0, 1000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('a b ', 1000)").alias("text"))
    held = (["held"], lambda t: {"held": np.full(len(t.counts), float(len(t.codes)))})
    for first in ("duplicate_ngram_chr_fraction_5", "top_ngram_share_2"):
        got = scoring.token_metrics(docs, ["doc_id"], [first], extra=(held,)).agg(F.count("*"), F.max("held"), F.min("held")).first()
        assert got[0] == 1000 and 2000 <= got[2] <= got[1] <= scoring.TOKENS_AT_ONCE


def test_top_ngrams_counts_no_runs_longer_than_asked(monkeypatch):
    codes, owner = np.tile(np.arange(5), 200), np.repeat(np.arange(2), 500)
    assert counted(monkeypatch, codes, owner, [f"top_ngram_share_{n}" for n in scoring.TOP]) <= 4 * len(codes)


def test_dup_ngrams_counts_only_runs_that_can_be_repeated(monkeypatch):
    codes, owner = np.random.default_rng(5).integers(0, 300, 10_000), np.repeat(np.arange(10), 1000)
    assert counted(monkeypatch, codes, owner, [f"duplicate_ngram_chr_fraction_{n}" for n in scoring.DUPLICATE]) <= 3 * len(codes)


def counted(monkeypatch, codes, owner, wanted) -> int:
    """How many runs are sorted to number them."""
    seen, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, *a, **k: seen.append(len(x)) or unique(x, *a, **k))
    got = scoring._repetition(codes, owner, int(owner.max()) + 1, np.ones(int(codes.max()) + 1, dtype=np.int64), set(wanted))
    assert set(got) == set(wanted)
    return sum(seen)


def test_repetition_of_runs_of_unlike_lengths_and_ties():
    rng = np.random.default_rng(7)
    size = np.array([3, 1, 5, 2, 4, 1, 9, 2])
    texts = [[], [4], [2, 7], [5, 1, 0, 3, 2], [0, 1, 2, 0, 1], [1] * 12, *(rng.integers(0, m, k).tolist() for m in (2, 4, 8) for k in (3, 6, 11, 40))]
    codes, owner = np.array(sum(texts, []), dtype=np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = scoring._repetition(codes, owner, len(texts), size, set(scoring.REPETITION))
    for i, t in enumerate(texts):
        for n in (*scoring.TOP, *scoring.DUPLICATE):
            grams = [tuple(t[k : k + n]) for k in range(len(t) - n + 1)]
            if n in scoring.TOP:
                best = min(grams, key=lambda g: (-grams.count(g), g), default=None)
                want = np.nan if best is None else grams.count(best) * (sum(size[c] for c in best) + n - 1)
                assert np.array_equal(got[f"top_ngram_share_{n}"][i], want, equal_nan=True)
            else:
                hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(n)}
                want = sum(size[t[k]] for k in hit) / sum(size[c] for c in t) if t else np.nan
                assert got[f"duplicate_ngram_chr_fraction_{n}"][i] == pytest.approx(want, nan_ok=True)
