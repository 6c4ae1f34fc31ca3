"""Operator 10, toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document
labels, then used to locate the offending sentences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_of
from .textkernels import Words, mix, raw
from .trees import held_out, labels_of

#: Most labelled documents that training reads, by a hash of doc_id.
TRAIN_ROWS = 12_000

_APART = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def terms(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their two term hashes (the word; its first five bytes, which its forms share), the sentence of each word
    (numbered over all texts), and the first sentence of each text."""
    w = Words(texts, separator=_APART)
    stops = np.concatenate([[0], np.cumsum(_STOP[w.buf])])
    return w, np.stack([w.hash(), mix(w.prefix_hash(5) + np.uint64(5))]), stops[w.start], stops[w.text_start]


@dataclass
class Model:
    keys: np.ndarray
    weight: np.ndarray
    bias: float
    power: float = 1.0

    def sentences(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words, np.ndarray]:
        """Score of each sentence that has words, the text it is in, its number in the text, the words and their sentence."""
        w, h, sentence, first = terms(texts)
        z = np.zeros(len(w.start))
        if len(self.keys):
            for k in h:
                at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
                z += np.where(self.keys[at] == k, self.weight[at], 0)
        begins = np.flatnonzero(np.diff(sentence, prepend=-1))
        total = np.add.reduceat(z, begins) if len(begins) else z
        clean = 1 / (1 + np.exp(np.clip(total + self.bias, -30, 30)))
        return 1 - clean**self.power, w.text[begins], sentence[begins] - first[w.text[begins]], w, begins

    def documents(self, texts: list[bytes]):
        """Noisy-or of each text's sentences, with its worst sentence's number and score; a text of no words scores as one neutral sentence."""
        p, text, number, _, _ = self.sentences(texts)
        quiet = np.bincount(text, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(texts))
        score = 1 - np.exp(quiet)
        none = np.bincount(text, minlength=len(texts)) == 0
        score[none] = 1 - (1 + np.exp(self.bias)) ** -self.power
        worst = np.full(len(texts), -1, dtype=np.int64)
        order = np.lexsort((number, -p, text))
        lead = order[np.flatnonzero(np.diff(text[order], prepend=-1))] if len(order) else order
        worst[text[lead]] = number[lead]
        top = np.zeros(len(texts))
        top[text[lead]] = p[lead]
        return score, worst, top


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_terms: int, rounds: int = 150, l2: float = 1e-4, rate: float = 0.15) -> tuple[np.ndarray, float]:
    """Noisy-or likelihood by Adam over all documents at once. A bag: the term indexes of a document, and the sentence each is in.

    With s the sum of softplus(z) over sentences, a document is toxic with chance 1 - exp(-s)."""
    sizes = [int(s.max()) + 1 if len(s) else 1 for _, s in bags]
    start = np.concatenate([[0], np.cumsum(sizes)])
    term = np.concatenate([t for t, _ in bags]) if bags else np.zeros(0, dtype=np.int64)
    sent = np.concatenate([s + o for (_, s), o in zip(bags, start)]) if bags else term
    doc = np.repeat(np.arange(len(bags)), sizes)
    w, b = np.zeros(n_terms), -5.0
    m, v = np.zeros(n_terms + 1), np.zeros(n_terms + 1)
    for i in range(1, rounds + 1 if bags else 1):
        z = np.bincount(sent, weights=w[term], minlength=start[-1]) + b
        s = np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(bags))
        to_s = np.where(y == 1, -1 / np.expm1(np.clip(s, 1e-9, 50)), 1.0) / len(bags)
        to_z = to_s[doc] / (1 + np.exp(-np.clip(z, -50, 50)))
        g = np.append(np.bincount(term, weights=to_z[sent], minlength=n_terms) + l2 * w, to_z.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        step = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def calibrate(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_terms: int, folds: int = 3) -> float:
    """The power to which a sentence's chance of being clean is raised, so that 0.5 is the score at which F1 is best on
    training documents that the model of the other folds hasn't seen; 1 if there are too few to tell."""
    if min((y == 1).sum(), (y == 0).sum()) < 10 * folds:
        return 1.0
    quiet = np.zeros(len(bags))
    for k in range(folds):
        test = np.arange(len(bags)) % folds == k
        w, b = fit([bags[i] for i in np.flatnonzero(~test)], y[~test], n_terms)
        for i in np.flatnonzero(test):
            t, s = bags[i]
            quiet[i] = np.logaddexp(0, np.bincount(s, weights=w[t]) + b).sum()
    order = np.argsort(-quiet, kind="stable")
    hits = np.cumsum(y[order] == 1)
    best = int(np.argmax(2 * hits / (np.arange(1, len(y) + 1) + hits[-1])))
    return float(np.log(2) / np.clip(quiet[order[best]], 0.02, 2.0))


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, fold: int = 0, of: int = 5) -> Model:
    """Trains on at most `rows` labelled documents outside of the held-out fold.

    Terms are those that at least three of the sample's toxic documents have, and are at least twice as frequent there
    as elsewhere, or half as frequent (in ten others or more); all of them have a weight. Counted by Spark; only those terms
    of the sample's documents reach the driver."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = labels_of(labels, "toxic", fold, of).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` rows of two short columns: its size is bounded by the parameter
    chosen = text_of(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")

    def distinct(batches):
        for b in batches:
            w, h, _, _ = terms(raw(b.column(2)))
            both, text = h.ravel(), np.concatenate([w.text, w.text])
            order = np.lexsort((both, text))
            keep = order[np.append(True, (np.diff(both[order]) != 0) | (np.diff(text[order]) != 0))[: len(order)]]
            yield pa.record_batch([pa.array(both[keep].view(np.int64)), pa.array(b.column(1).to_numpy(zero_copy_only=False)[text[keep]].astype(np.int32))], names=["term", "y"])

    n_pos, n_all = chosen.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    n_neg = n_all - n_pos
    counted = chosen.mapInArrow(distinct, "term long, y int").groupBy("term").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    lift = (F.col("p") + 0.5) / (n_pos + 1) / ((F.col("n") + 0.5) / (n_neg + 1))
    strong = counted.where((F.col("p") + F.col("n") >= 3) & ((F.col("p") >= 3) & (lift >= 2) | (F.col("n") >= 10) & (lift <= 0.5)))
    keys = np.sort(np.array([x.term for x in strong.select("term").collect()], dtype=np.int64).view(np.uint64))

    def bags(batches):
        for b in batches:
            w, h, sentence, first = terms(raw(b.column(2)))
            at = [np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1)) for k in h]
            hit = [keys[a] == k if len(keys) else np.zeros(len(k), dtype=bool) for a, k in zip(at, h)]
            # sentences are numbered among those with words, as they are when scored
            dense = np.cumsum(np.diff(sentence, prepend=-1) != 0) - 1
            blobs, many = [], []
            lows = dense[np.minimum(w.first[:-1], max(0, len(dense) - 1))] if len(dense) else np.zeros(b.num_rows, dtype=np.int64)
            for i in range(b.num_rows):
                lo, hi = w.first[i], w.first[i + 1]
                parts = [np.stack([a[lo:hi][k[lo:hi]], (dense[lo:hi] - lows[i])[k[lo:hi]]]) for a, k in zip(at, hit)]
                blobs.append(np.concatenate(parts, axis=1).astype("<i4").tobytes())
                many.append(int(dense[hi - 1] - lows[i]) + 1 if hi > lo else 1)
            yield pa.record_batch([b.column(0), b.column(1).cast(pa.int32()), pa.array(blobs, pa.binary()), pa.array(many, pa.int32())], names=["doc_id", "y", "bag", "sentences"])

    # an order of their own, so that folds and sums of floats do not depend on partitions
    got = chosen.mapInArrow(bags, "doc_id long, y int, bag binary, sentences int").toPandas().sort_values(["doc_id", "bag"])
    found = []
    for blob, many in zip(got.bag, got.sentences):
        t, s = np.frombuffer(blob, dtype="<i4").reshape(2, -1).astype(np.int64)
        # a term without a weight of its own holds the number of sentences
        found.append((np.append(t, len(keys)), np.append(s, many - 1)))
    weight, bias = fit(found, got.y.to_numpy(), len(keys) + 1)
    return Model(keys, weight[:-1], bias, calibrate(found, got.y.to_numpy(), len(keys) + 1))


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, worst_sentence (its number from 0; -1 in a text of no words), worst_score.

    Every row has its own score; null and empty texts score as one neutral sentence. Without labels nothing is
    learned, and scores are low and alike. Sentences end at . ! ? and line ends."""
    model = fit_toxicity(docs, labels, rows)

    def run(batches):
        for b in batches:
            score, worst, top = model.documents(raw(b.column(1)))
            yield pa.record_batch([b.column(0), pa.array(score), pa.array(worst.astype(np.int32)), pa.array(top)], names=["doc_id", "score", "worst_sentence", "worst_score"])

    scored = text_of(docs).mapInArrow(run, "doc_id long, score double, worst_sentence int, worst_score double")
    return scored.select("doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_sentence", "worst_score")


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, sentence (number), score, text of every sentence that scores `least` or more."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = raw(b.column(1))
            p, text, number, w, begins = model.sentences(texts)
            joined = b"\n".join(texts) + b"\n"
            ends = np.append(begins[1:], len(w.start))
            hot = np.flatnonzero(p >= least)
            parts = [joined[w.start[begins[i]] : w.end[ends[i] - 1]].decode("utf-8", "replace") for i in hot]
            yield pa.record_batch([b.column(0).take(pa.array(text[hot])), pa.array(number[hot], pa.int32()), pa.array(p[hot]), pa.array(parts, pa.string())], names=["doc_id", "sentence", "score", "text"])

    return text_of(docs).mapInArrow(run, "doc_id long, sentence int, score double, text string")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
