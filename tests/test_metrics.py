"""Golden values of the definitions, null contracts, and loaders."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstyle.functions import text as T
from docstyle.operators import corpus, factor, lexicon, semantic, sequence
from docstyle.plans import runs
from docstyle.sources import io

TOKENS = "the quick brown fox jumps over the lazy dog the fox".split()


def codes(tokens):
    return np.unique(tokens, return_inverse=True)[1]


def test_mattr():
    assert sequence.mattr(codes(TOKENS), 5) == pytest.approx(0.9428571428571428)
    assert sequence.mattr(codes(list("abc")), 10) == 1.0
    assert sequence.mattr(codes(TOKENS * 20), 100) == pytest.approx(0.08)
    assert sequence.mattr(codes([]), 10) is None


def test_windowed_entropy():
    assert sequence.windowed_entropy(codes(TOKENS), 5) == pytest.approx((1.540123194378106, 0.12005661338529439, 4.665164957684038))
    assert sequence.windowed_entropy(codes(TOKENS * 20), 100) == pytest.approx((1.9689290721857473, 0.005012449779697531, 7.163001321956363))
    assert sequence.windowed_entropy(codes([])) == (None, None, None)


@pytest.mark.parametrize("seed,want", [(42, (2.3863381260905894, 10.873603186347673)), (2001, (2.168169180073816, 8.742263869299252))])
def test_trigram_entropy(seed, want):
    c = codes(TOKENS * 10)
    assert sequence.trigram_entropy(c, sequence.seeded_mask(len(c), 0.2, seed)) == pytest.approx(want)
    assert sequence.trigram_entropy(c[:9], np.ones(9, dtype=bool)) == (None, None)


def test_punctuation(spark):
    text = 'Well, she said: "no" — really? Yes! (maybe...) a - b; c… d–e'
    df = spark.createDataFrame([(text,), ("",), (None,)], "text string").select(*[c.alias(n) for n, c in T.punctuation(F.col("text")).items()])
    first, empty, null = df.collect()
    assert list(first) == pytest.approx([1000 / 60 * k for k in (1, 1, 1, 3, 1, 1, 1, 2, 2)])
    assert set(empty) == set(null) == {None}


def test_chunks(spark):
    sizes = [0, 1, 97, 98, 194, 195, 250, 292, 388]
    df = spark.createDataFrame([(n, " ".join(["w"] * n)) for n in sizes], "n int, text string").select("n", T.chunks(F.col("text")).alias("c"))
    assert {r.n: len(r.c) for r in df.collect()} == {0: 0, 1: 1, 97: 1, 98: 2, 194: 2, 195: 3, 250: 3, 292: 4, 388: 4}


def test_lexicon(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, ""), (3, "none here")], "doc_id long, text string")
    lex = spark.createDataFrame([("quick", 0.8), ("brown", 0.4), ("fox", 0.6)], "token string, score double")
    got = {r.doc_id: tuple(r)[1:] for r in lexicon.score(docs, lex, "s").collect()}
    assert got[1] == pytest.approx((0.6, 0.16329931618554522, 0.75))
    assert got[2] == (None, None, None) and got[3] == (None, None, 0.0)


def test_emotions_uniform(spark):
    words = ["ein", "zwei", "drei", "vier", "acht", "sechs", "sieben", "zehn"]
    lex = spark.createDataFrame([(w, e, 1.0) for w, e in zip(words, lexicon.EMOTIONS)], "term string, emotion string, score double")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "other")], "doc_id long, text string")
    got = {r.doc_id: r.emo_diversity for r in lexicon.emotions(docs, lex).collect()}
    assert got[1] == pytest.approx(math.log(8)) and got[2] == 0.0


def test_semantic(spark):
    v = [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0], [-0.6, 0.8]]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)] + [(2, 0, [1.0, 0.0])], "doc long, idx long, vec array<float>")
    t = {r.doc: tuple(r)[1:] for r in semantic.trajectory(df).collect()}
    assert t[1] == pytest.approx((0.7333333, 0.14, 0.8, 0.0942809, 1.6), abs=1e-6)
    assert t[2] == (None,) * 5
    assert semantic.range_max(df).where("doc = 1").first()[1] == pytest.approx(1.6, abs=1e-6)
    assert semantic.dispersion(df).where("doc = 1").first()[1] == pytest.approx(0.3035806, abs=1e-6)
    c = semantic.components_of(np.array(v, dtype=np.float32))
    assert (c["pc1_topic_strength"], c["pc_top5_strength"]) == pytest.approx((0.8810293, 1.0), abs=1e-6)
    assert semantic.shannon_entropy(np.array([10, 10, 10, 10])) == pytest.approx(1.386294361115881)


def test_planted_factors():
    rng = np.random.default_rng(3)
    pattern = np.zeros((8, 2))
    pattern[:4, 0], pattern[4:, 1] = (0.8, 0.7, 0.75, 0.6), (0.7, 0.8, 0.65, 0.75)
    phi = np.array([[1, 0.3], [0.3, 1]])
    r = pattern @ phi @ pattern.T
    np.fill_diagonal(r, 1)
    x = rng.multivariate_normal(np.zeros(8), r, size=4000)
    got = factor.fit(np.corrcoef(x, rowvar=False), [f"m{i}" for i in range(8)], 2)
    p = got["pattern"][:, np.argsort(-np.abs(got["pattern"][0]))]
    assert np.abs(p - pattern).max() < 0.08 and abs(got["phi"][0, 1] - 0.3) < 0.08
    assert factor.adequacy(r, 4000)["kmo"] > 0.6
    with pytest.raises(ValueError):
        factor.fit(r, [], 0)


@pytest.mark.parametrize("x,df,want", [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (0.0, 4, 1.0)])
def test_chi2(x, df, want):
    assert factor.chi2_tail(x, df) == pytest.approx(want, abs=1e-9)


def test_impute_and_missing(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 3.0, None), (3, None, 1.0), (4, 10.0, 2.0)], "id long, a double, b double")
    assert factor.kept_features(df, ["a", "b"]) == ["a"]
    assert sorted(r.a for r in factor.impute(df, ["a"]).collect()) == [1.0, 3.0, 3.0, 10.0]


def test_snap_and_excerpts(spark):
    cut = lambda w, least, most: w[slice(*(int(x[0]) for x in corpus.bounds(corpus.sentence_ends(w), len(w), np.array([0]), np.array([most + 200]), least, most)))]
    assert cut(["word"] * 15, 10, 12) == ["word"] * 12
    assert cut(["Hi."], 5, 10) == []
    assert cut("Cut off. One two three. Four five six. Seven eight".split(), 3, 6) == "One two three.".split()
    text = "One two three four five six. Seven eight nine ten. " * 60
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    a, b = (sorted(map(tuple, corpus.excerpts(docs.repartition(n), 2, 20, 40).collect())) for n in (1, 3))
    assert a == b and len(a) == 2 and all(20 <= r[4] <= 40 for r in a)


def test_text_table_and_resume(spark, tmp_path):
    rec = spark.createDataFrame([(1, "PASSAGE:\n hello "), (2, "plain")], "id long, prompt string")
    out = spark.createDataFrame([("1", "old", 0), ("1", "new", 1)], "id string, completion string, ord int")
    got = sorted(map(tuple, corpus.text_table(rec, out, prompt="prompt").collect()))
    assert got == [("1", "ai", "new"), ("1", "human", "hello"), ("2", "human", "plain")]
    path = str(tmp_path / "scores.parquet")
    score = lambda df: df.select("id", F.length("prompt").alias("n"))
    assert runs.resumable(spark, rec.where("id = 1"), score, path, ["id"]).count() == 1
    assert runs.resumable(spark, rec, score, path, ["id"]).count() == 2
    assert runs.resumable(spark, rec, score, path, ["id"]).count() == 2
    log = str(tmp_path / "log")
    prompts = spark.createDataFrame([("a", "x y"), ("b", "z")], "id string, prompt string")
    runs.complete(prompts.where("id = 'a'"), runs.reverse_words, log, "stub")
    runs.complete(prompts, runs.reverse_words, log, "stub")
    assert sorted((r.id, r.completion) for r in spark.read.json(log).collect()) == [("a", "y x"), ("b", "z")]


def test_loaders(spark, tmp_path):
    (tmp_path / "vad.tsv").write_text("term\tv\ta\td\nHappy\t0.9\t0.5\t0.4\nhappy\t0.8\t0.5\t0.4\nshort\t1\n")
    assert [tuple(r) for r in io.load_vad_lexicon(spark, str(tmp_path / "vad.tsv")).collect()] == [("happy", 0.8, 0.5, 0.4)]
    (tmp_path / "emo.tsv").write_text("furious\tAnger\t0.9\nfurious\tanger\tbad\nx\ty\n")
    assert [tuple(r) for r in io.load_emotion_lexicon(spark, str(tmp_path / "emo.tsv")).collect()] == [("furious", "anger", 0.9)]
    (tmp_path / "norm.csv").write_text("Word,Rating\nSun,4.5\nmoon,3\n")
    assert sorted(map(tuple, io.load_norm_by_name(spark, str(tmp_path / "norm.csv"), "Word", "Rating").collect())) == [("moon", 3.0), ("sun", 4.5)]
    with pytest.raises(KeyError):
        io.load_norm_by_name(spark, str(tmp_path / "norm.csv"), "A", "B")
    assert io.read_table(spark, str(tmp_path / "none.parquet")) is None
    df = spark.createDataFrame([("001", 'a "quoted"\nline')], "id string, text string")
    io.write_table(df, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in io.read_table(spark, str(tmp_path / "t.csv")).collect()] == [("001", 'a "quoted"\nline')]


def test_model_round_trip(spark, tmp_path):
    r = np.eye(3) * 0.5 + 0.5
    f = factor.fit(r, ["a", "b", "c"], 1)
    io.save_model(spark, f, dict.fromkeys("abc", (1.0, 2.0)), str(tmp_path / "m"))
    cols, moments, weights = io.load_model(spark, str(tmp_path / "m"))
    assert cols == ["a", "b", "c"] and moments["b"] == (1.0, 2.0) and np.allclose(weights, f["weights"])
