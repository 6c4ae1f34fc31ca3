"""Metrics of tokens against lexica: norms, valence-arousal-dominance, emotions, vocabulary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

# The emotions that discrete lexica name.
EMOTIONS = ["anger", "anticipation", "disgust", "fear", "joy", "sadness", "surprise", "trust"]
#: A lexicon is broadcast only if it has at most this many rows; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def small(lexicon: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a lexicon for broadcasting after counting no further than the limit."""
    return F.broadcast(lexicon) if is_small(lexicon, most) else lexicon


def is_small(lexicon: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    return lexicon.limit(most + 1).count() <= most


def exploded(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.explode_outer(tokens(F.col(text))).alias("token"))


def counted(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, token, n): occurrences are combined before any join, so the join sees each type of a document once."""
    return exploded(docs, key).groupBy(key, "token").agg(F.count("token").alias("n"))


def score(docs: DataFrame, lexicon: DataFrame, prefix: str, columns=("score",), stats=("mean", "std"), coverage: bool = True, key: str = "doc_id") -> DataFrame:
    """Per document: mean, population deviation, min and max over covered token occurrences, and their share of all.

    Columns are <prefix>_<stat>, with the score column's name between where there are several."""
    j = counted(docs, key).join(small(lexicon), "token", "left")
    aggs = []
    for c in columns:
        name = prefix if len(columns) == 1 else f"{prefix}_{c}"
        n = F.sum(F.when(F.col(c).isNotNull(), F.col("n")))
        mean = F.sum(F.col(c) * F.col("n")) / n
        aggs += [{"mean": mean, "std": F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col(c) * F.col(c) * F.col("n")) / n - mean * mean))), "min": F.min(c), "max": F.max(c)}[s].alias(f"{name}_{s}") for s in stats]
    if coverage:
        total = F.sum("n")
        aggs.append(F.when(total > 0, F.coalesce(F.sum(F.when(F.col(columns[0]).isNotNull(), F.col("n"))), F.lit(0)) / total).alias(f"{prefix}_coverage"))
    return j.groupBy(key).agg(*aggs)


def by_emotion(lexicon: DataFrame, names=tuple(EMOTIONS)) -> DataFrame:
    """A row per term with its score of each emotion, 0 without one."""
    return lexicon.groupBy("term").agg(*[F.coalesce(F.max(F.when(F.col("emotion") == e, F.col("score"))), F.lit(0.0)).alias(e) for e in names]).withColumnRenamed("term", "token")


def emotions(docs: DataFrame, lexicon: DataFrame, names=tuple(EMOTIONS), key: str = "doc_id") -> DataFrame:
    """emo_<name>: summed scores by token count, uncovered tokens as 0; emo_diversity: the entropy (nats) of their shares."""
    wide = by_emotion(lexicon, names)
    j = counted(docs, key).join(small(wide), "token", "left")
    total = F.sum("n")
    out = j.groupBy(key).agg(*[F.when(total > 0, F.coalesce(F.sum(F.col(e) * F.col("n")), F.lit(0.0)) / total).alias(f"emo_{e}") for e in names])
    cols = [F.col(f"emo_{e}") for e in names]
    whole = sum(cols[1:], cols[0])
    parts = [F.when(c > 0, -(c / whole) * F.log(c / whole)).otherwise(F.lit(0.0)) for c in cols]
    return out.withColumn("emo_diversity", F.when(whole.isNull(), F.lit(None)).when(whole <= 0, F.lit(0.0)).otherwise(sum(parts[1:], parts[0])))


def out_of_vocabulary(docs: DataFrame, vocabulary: DataFrame, key: str = "doc_id") -> DataFrame:
    j = counted(docs, key).join(small(vocabulary.select("token").distinct().withColumn("known", F.lit(1))), "token", "left")
    total = F.sum("n")
    return j.groupBy(key).agg(F.when(total > 0, F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)) / total).alias("oov_ratio"))


def _sums(table: DataFrame):
    """What gives for each text the sums over its token occurrences of each column but the first of a small table (token, ...)."""
    got = table.where("token IS NOT NULL").toPandas()
    known, weight = pa.array(got.iloc[:, 0].tolist(), pa.string()), got.iloc[:, 1:].to_numpy(dtype=np.float64)

    def run(t) -> np.ndarray:
        at = pc.index_in(t.values, known).to_numpy(zero_copy_only=False)
        at = np.where(np.isnan(at), -1, at).astype(np.int64)[t.codes]
        hit = at >= 0
        owner, w = t.owner[hit], weight[at[hit]]
        return np.stack([np.bincount(owner, weights=w[:, j], minlength=len(t.counts)) for j in range(weight.shape[1])])

    return run


def score_inline(lexicon: DataFrame, prefix: str, columns=("score",), stats=("mean", "std")):
    """Means and deviations as score() has them, for a small lexicon, as scoring.Extra: tokens are neither exploded nor shuffled."""
    moments = [f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("s", lambda c: F.coalesce(F.sum(c), F.lit(0.0))), ("q", lambda c: F.coalesce(F.sum(F.col(c) * F.col(c)), F.lit(0.0))))]
    sums = _sums(lexicon.groupBy("token").agg(*moments))
    names = [prefix if len(columns) == 1 else f"{prefix}_{c}" for c in columns]

    def run(t):
        out, x = {}, sums(t)
        for i, name in enumerate(names):
            n = np.where(x[3 * i] > 0, x[3 * i], np.nan)
            mean = x[3 * i + 1] / n
            out[f"{name}_mean"], out[f"{name}_std"] = mean, np.sqrt(np.maximum(0.0, x[3 * i + 2] / n - mean * mean))
        return out

    return [f"{name}_{s}" for name in names for s in stats], run


def emotions_inline(lexicon: DataFrame, names=tuple(EMOTIONS)):
    """emotions() for a small lexicon, as scoring.Extra."""
    sums = _sums(by_emotion(lexicon, names))

    def run(t):
        share = sums(t) / np.where(t.counts > 0, t.counts, np.nan)
        whole = share.sum(0)
        p = share / np.where(whole > 0, whole, 1.0)
        diversity = -(p * np.log(np.where(p > 0, p, 1.0))).sum(0) + 0.0
        return {f"emo_{e}": x for e, x in zip(names, share)} | {"emo_diversity": diversity}

    return [*(f"emo_{e}" for e in names), "emo_diversity"], run


def out_of_vocabulary_inline(vocabulary: DataFrame):
    """out_of_vocabulary() for a small vocabulary, as scoring.Extra."""
    sums = _sums(vocabulary.select("token").distinct().withColumn("known", F.lit(1.0)))
    return ["oov_ratio"], lambda t: {"oov_ratio": (t.counts - sums(t)[0]) / np.where(t.counts > 0, t.counts, np.nan)}
