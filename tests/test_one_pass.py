"""The metrics table in one pass, in pieces of a bounded number of tokens, against the ways that join tables."""

import pytest
from pyspark.sql import functions as F

from docstyle import catalogue
from docstyle.operators import lexicon, scoring

TEXT = "The quick brown fox jumps over the lazy dog. The fox sat! A dog sat, too? "
ROWS = [("a", TEXT * 20), ("b", TEXT + "\none\ntwo\none"), ("c", ""), ("d", None), ("e", "..."), ("f", "fox " * 40 + "dog")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id string, text string").coalesce(1)


def tables(df):
    return {r.doc_id: tuple(round(x, 9) if isinstance(x, float) else x for x in r[1:]) for r in df.select("doc_id", *sorted(set(df.columns) - {"doc_id"})).collect()}


def test_lexica_and_parse_in_the_pass_equal_the_joins(spark, docs, monkeypatch):
    # a token with two scores and one with a null; they count as in a join
    word = spark.createDataFrame([("fox", 0.5), ("dog", 1.0), ("dog", 0.25), ("the", None), (None, 3.0)], "token string, score double")
    vad = word.select("token", *[F.col("score").alias(c) for c in ("valence", "arousal", "dominance")])
    emotion = spark.createDataFrame([("fox", "joy", 1.0), ("sat", "fear", 0.5), ("sat", "joy", 0.25), ("the", "calm", 1.0)], "term string, emotion string, score double")
    lexica = {"concreteness": word, "aoa": word, "prevalence": word, "vad": vad, "emotion": emotion, "vocabulary": word.select("token")}
    one = scoring.score_documents(docs, ("doc_id",), lexica, catalogue.parse_tokens, affect="modern")
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(lexicon, "is_small", lambda *a: False)
    many = scoring.score_documents(docs, ("doc_id",), lexica, catalogue.parse_table(docs), affect="modern")
    assert set(one.columns) == set(many.columns) and tables(one) == tables(many)


def test_pieces_do_not_change_results(docs):
    wanted = [*scoring.LENGTHS, *scoring.SENTENCES, *scoring.REPETITION, "mattr"]
    whole, cut = (scoring.token_metrics(docs, ["doc_id"], wanted, at_once=n) for n in (1 << 30, 50))
    assert tables(whole) == tables(cut)


def test_pieces_are_bounded():
    import pyarrow as pa

    b = pa.record_batch([pa.array([["x"] * n if n is not None else None for n in (3, 0, None, 2, 9, 1, 4, 5)])], names=["t"])
    sizes = [[len(x or []) for x in p.column(0).to_pylist()] for p in scoring._pieces(b, 0, 5)]
    assert sizes == [[3, 0, 0, 2], [9], [1, 4], [5]]


def test_batches_are_bounded(spark, docs):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    scoring.token_metrics(docs, ["doc_id"], ["top_ngram_share_2"])
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 1000
