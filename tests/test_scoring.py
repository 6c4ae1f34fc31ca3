"""The metrics table, the factor stages over it, runs with errors, and prompts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstyle import prompts, taxonomy
from docstyle.operators import corpus, factor, scoring
from docstyle.plans import runs

TEXT = "The quick brown fox jumps over the lazy dog. The fox sat! A dog sat, too? "


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("a", "human", TEXT * 20), ("b", "ai", TEXT + "\none\ntwo\none"), ("c", "ai", ""), ("d", "human", None), ("e", "ai", "...")]
    return spark.createDataFrame(rows, "id string, source string, text string")


def test_every_metric_has_a_name_of_the_taxonomy(spark, docs):
    word = spark.createDataFrame([("fox", 0.5), ("dog", 1.0)], "token string, score double")
    vad = word.select("token", *[F.col("score").alias(c) for c in ("valence", "arousal", "dominance")])
    emotion = spark.createDataFrame([("fox", "joy", 1.0)], "term string, emotion string, score double")
    parse = spark.createDataFrame([("a", "human", 0, 1, "fox", "NOUN", "nsubj", 2), ("a", "human", 0, 2, "sat", "VERB", "root", 2)], "id string, source string, sent int, k int, token string, pos string, dep string, head int")
    vectors = spark.createDataFrame([("a", "human", i, v) for i, v in enumerate(([1.0, 0.0], [0.6, 0.8], [0.0, 1.0], [-0.6, 0.8]))], "id string, source string, idx int, vec array<float>")
    lexica = {"concreteness": word, "aoa": word, "prevalence": word, "vad": vad, "emotion": emotion, "vocabulary": word.select("token")}
    m = scoring.score_documents(docs, lexica=lexica, parse=parse, vectors=vectors, affect="modern")
    assert set(m.columns) - {"id", "source"} <= set(taxonomy.CATEGORY)
    # what the taxonomy has and no scorer gives is left out of factor analysis anyway
    assert set(taxonomy.CATEGORY) - set(m.columns) <= set(taxonomy.LEFT_OUT)
    assert set(taxonomy.features(m, ["id", "source"]).columns) == {"id", "source", *taxonomy.CATEGORY} - set(taxonomy.LEFT_OUT)
    got = {r.id: r for r in m.collect()}
    assert set(got) == set("abcde") and got["a"].vad_valence_mean == pytest.approx(0.75) and got["a"].aoa_std == pytest.approx(0.25)
    assert got["a"].semantic_trajectory_length_per_word == pytest.approx(0.8 / (16 * 20), abs=1e-6)
    assert got["b"].duplicate_line_chr_fraction == pytest.approx(3 / len(TEXT + "\none\ntwo\none")) and got["b"].n_sentences == 4
    assert got["c"].n_tokens == got["d"].n_tokens == 0 and got["c"].mattr is None and got["d"].smog is None and got["e"].n_tokens == 0 and got["e"].doc_length == 3
    historical = scoring.score_documents(docs, lexica=lexica).columns
    assert "concreteness_mean" in historical and not any(c.startswith(("aoa", "vad", "emo", "prevalence")) for c in historical)
    with pytest.raises(ValueError):
        scoring.score_documents(docs, affect="other")


def test_repetition_against_plain_counts(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(list("abc"), rng.integers(0, 40)))) for i in range(30)]
    names = scoring.REPETITION
    got = {r.i: r for r in scoring.token_metrics(spark.createDataFrame(rows, "i long, text string").coalesce(1), ["i"], names).collect()}
    for i, t in rows:
        w = t.split()
        for n in (*scoring.TOP, *scoring.DUPLICATE):
            grams = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
            if n in scoring.TOP:
                want = max((grams.count(g) * len(" ".join(g)) for g in grams if grams.count(g) == max(map(grams.count, grams))), default=None)
                assert got[i][f"top_ngram_share_{n}"] == want
            else:
                hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(n)}
                assert got[i][f"duplicate_ngram_chr_fraction_{n}"] == (pytest.approx(len(hit) / len(w)) if w else None)


def test_factor_stages(spark):
    rng = np.random.default_rng(0)
    names = ["mattr", "oov_ratio", "comma_rate", "gunning_fog", "vad_valence_mean", "emo_joy"]
    x = rng.standard_normal((60, 2)) @ rng.standard_normal((2, 6)) + 0.5 * rng.standard_normal((60, 6))
    rows = [(str(i), "s", *(None if (i + j) % 11 == 0 else float(v) for j, v in enumerate(r)), 1.0, None) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, source string, " + ", ".join(f"{n} double" for n in names) + ", lix double, prevalence_mean double")
    scaled, stats = factor.prepare(df, ["id", "source"])
    assert sorted(stats) == sorted(names)
    column = np.array([r[2] for r in rows], dtype=float)
    column[np.isnan(column)] = np.nanmedian(column)
    assert stats["mattr"].mean == pytest.approx(column.mean()) and stats["mattr"].scale == pytest.approx(column.std())
    r, n = factor.correlation_matrix(scaled, names)
    assert n == 60 and np.allclose(r, np.corrcoef(np.array([[v[c] for c in names] for v in scaled.collect()]), rowvar=False))
    model = factor.fit_factors(df, ["id", "source"], 2)
    assert model["variance"].columns == ["factor", "SS_loadings", "pct_var", "cumulative_pct"]
    order = [x.category for x in model["loadings"].collect()]
    assert order == sorted(order)
    for impute in ("new", "train"):
        a, b = (np.array([list(v)[2:] for v in d.orderBy("id").collect()]) for d in (model["scores"], factor.apply_factors(df, model, ["id", "source"], impute)))
        assert np.allclose(a, b, rtol=1e-5)
    top = factor.described_loadings(model, 3).collect()
    assert len(top) == 6 and {"category", "pct_var"} <= set(top[0].asDict())
    gone = df.withColumn("mattr", F.lit(None).cast("double"))
    assert factor.apply_factors(gone, model, ["id"]).where("F1 IS NOT NULL").count() == 0
    assert factor.apply_factors(gone, model, ["id"], "train").where("F1 IS NULL").count() == 0


def test_errors_and_commits(spark, tmp_path):
    df = spark.createDataFrame([(str(i), i) for i in range(6)], "id string, v int")
    inverse = lambda r: {"w": 1 / r["v"]}
    assert runs.mapped(df, inverse, "w double", ["id"]).count() == 5
    kept = runs.mapped(df, inverse, "w double", ["id"], "record").where("error IS NOT NULL").collect()
    assert [(r.id, r.w) for r in kept] == [("0", None)] and "ZeroDivisionError" in kept[0].error
    with pytest.raises(Exception, match="ZeroDivisionError"):
        runs.mapped(df, inverse, "w double", ["id"], "raise").collect()
    path = str(tmp_path / "t.parquet")
    score = lambda d: d.select("id", (F.col("v") * 2).alias("v"))
    assert runs.resumable(spark, df.unionAll(df), score, path, ["id"], commits=3).count() == 6
    assert runs.resumable(spark, df, score, path, ["id"]).count() == 6


def test_prompts(spark, tmp_path):
    text = "One two three four five six. Seven eight nine ten. " * 60
    df = spark.createDataFrame([("r1", text, "me"), ("r2", "short", "you"), ("r3", None, "x")], "id string, text string, author string")
    found, made, skipped = corpus.excerpts_and_prompts(df, n_chunks=2, least=20, most=40)
    assert found.columns[-1] == "author" and {r.author for r in found.collect()} == {"me"}
    assert sorted(r.id for r in made.collect()) == ["r1__chunk00", "r1__chunk01"] and sorted(r.id for r in skipped.collect()) == ["r2", "r3"]
    df.write.json(str(tmp_path / "in.jsonl"))
    args = [str(tmp_path / x) for x in ("in.jsonl", "excerpts.csv", "prompts.jsonl")]
    assert prompts.main([*args, "--least", "20", "--most", "40"]) == 0
    assert spark.read.json(args[2]).columns == ["id", "prompt"]
    with pytest.raises(RuntimeError):
        prompts.main([*args, "--least", "5000", "--most", "6000"])
