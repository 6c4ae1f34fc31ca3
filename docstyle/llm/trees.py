"""Operator 2, quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed by numpy kernels over whole Arrow batches, trees are trained here on a bounded sample of
labelled documents, then flattened into arrays that score a batch by vectorised traversal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, small_batches, table, text_of
from .textkernels import Words, raw

#: Most labelled rows that training reads; chosen by a hash of doc_id, so a rerun trains on the same.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7

NAMES = (
    "log_bytes log_words word_mean word_sd word_longest upper digit symbol bang pipe mark white newline non_ascii "
    "distinct top_share echo short_words all_caps symbol_words sentence_words enders line_mean line_twice "
    "line_upper line_symbol line_pipe line_echo line_unended worst_symbol worst_upper"
).split()


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_SYMBOL, _MARK, _END = _class("#$%&*@^~<>{}[]\\/_=+`"), _class(".,;:'\"()-?"), _class(".!?")
_LETTER = _UPPER | _class("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
_LINE = _class("\n")


def _sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of a mask between consecutive bounds, empty intervals included."""
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[bounds])


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of NAMES for each text; an empty text is all zeros."""
    n = len(texts)
    w = Words(texts, lower=False)
    buf, bounds = w.buf, w.text_start
    size = np.array([len(x) for x in texts], dtype=np.float64)
    per = lambda a, b: a / np.maximum(b, 1)
    count = {k: _sums(m[buf], bounds) for k, m in (("upper", _UPPER), ("digit", _DIGIT), ("symbol", _SYMBOL), ("mark", _MARK), ("letter", _LETTER), ("end", _END))}
    non_ascii = _sums(buf >= 128, bounds)
    bang, pipe, newline = (_sums(buf == ord(c), bounds) for c in "!|\n")
    newline = newline - 1
    length = (w.end - w.start).astype(np.float64)
    words = np.diff(w.first)
    by_text = lambda x: np.bincount(w.text, weights=x, minlength=n)
    mean = per(by_text(length), words)
    sd = np.sqrt(np.maximum(per(by_text(length**2), words) - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, w.text, length)
    h = w.hash()
    order = np.lexsort((h, w.text))
    hs, ts = h[order], w.text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])
    distinct = np.bincount(ts[new], minlength=n)
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, ts[new], runs)
    echo = np.zeros(len(h), dtype=bool)
    echo[1:] = (h[1:] == h[:-1]) & (w.text[1:] == w.text[:-1])
    in_word = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.stack([w.start, w.end])], axis=0)[0]
    w_upper, w_letter, w_symbol = in_word(_UPPER[buf]), in_word(_LETTER[buf]), in_word(_SYMBOL[buf])
    ended = _END[buf[w.end - 1]] if len(h) else np.zeros(0, dtype=bool)
    # lines: shares of a text's bytes that lie in lines of some look
    breaks = np.append(0, np.flatnonzero(_LINE[buf]) + 1)
    line_of = np.searchsorted(bounds, breaks[:-1], side="right") - 1
    line_size = np.diff(breaks) - 1.0
    line_by = lambda x: np.bincount(line_of, weights=x, minlength=n)
    first_word = np.searchsorted(w.start, breaks)
    line_words = np.diff(first_word)
    in_lines = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first_word])
    l_upper, l_letter, l_symbol, l_pipe = (_sums(m, breaks) for m in (_UPPER[buf], _LETTER[buf], _SYMBOL[buf], buf == ord("|")))
    l_hash = in_lines(h * np.uint64(2 * 0x1000193 + 1) if len(h) else h) + np.uint64(1) * line_words.astype(np.uint64)
    lo = np.lexsort((l_hash, line_of))
    again = np.zeros(len(lo), dtype=bool)
    again[lo[1:]] = (l_hash[lo[1:]] == l_hash[lo[:-1]]) & (line_of[lo[1:]] == line_of[lo[:-1]]) & (line_words[lo[1:]] > 0)
    share_symbol, share_upper = per(l_symbol, line_size), per(l_upper, np.maximum(l_letter, 1))
    long_line = line_words >= 5
    worst_symbol, worst_upper = np.zeros(n), np.zeros(n)
    np.maximum.at(worst_symbol, line_of, np.where(long_line, share_symbol, 0))
    np.maximum.at(worst_upper, line_of, np.where(long_line, share_upper, 0))
    l_ended = _END[buf[np.maximum(breaks[1:] - 2, 0)]]
    columns = [
        np.log1p(size), np.log1p(words), mean, sd, longest, per(count["upper"], np.maximum(count["letter"], 1)), per(count["digit"], size), per(count["symbol"], size), per(bang, size), per(pipe, size), per(count["mark"], size),
        per(size - by_text(length), size), per(newline, size), per(non_ascii, size), per(distinct, words), per(top, words), per(by_text(echo), words), per(by_text(length <= 3), words),
        per(by_text((w_letter > 1) & (w_upper == w_letter)), words), per(by_text(w_symbol > 0), words), per(words, np.maximum(count["end"], 1)), per(by_text(ended), words), per(size, newline + 1), per(line_by(line_size * again), size),
        per(line_by(line_size * (share_upper > 0.5) * (l_letter > 3)), size), per(line_by(line_size * (share_symbol > 0.08)), size), per(line_by(line_size * (l_pipe > 1)), size), per(line_by(line_size * (in_lines(echo) > 0.3 * line_words)), size), per(line_by(line_size * ~l_ended), size),
        worst_symbol, worst_upper,
    ]
    return np.where(size[:, None] > 0, np.stack(columns, axis=1), 0).astype(np.float32)


@dataclass
class Forest:
    """Trees as flat arrays; a leaf points at itself, so a traversal of fixed depth needs no branches."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = self.child[at, (x[rows, self.feature[at]] > self.threshold[at]).astype(np.int8)]
            z += self.value[at]
        return 1 / (1 + np.exp(-z))


def train(x: np.ndarray, y: np.ndarray, trees: int = 120, leaves: int = 12, depth: int = 6, rate: float = 0.1, bins: int = 64, least: int = 20, l2: float = 1.0) -> Forest:
    """Logistic loss, quantile bins, histograms of gradients per leaf, the best leaf split first; deterministic."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)).astype(np.float32) for j in range(m)] if n else []
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1) if n else np.zeros((0, m), dtype=np.int64)
    flat = binned + np.arange(m) * bins
    prior = (y.sum() + 1) / (n + 2)
    base = float(np.log(prior / (1 - prior)))
    z = np.full(n, base)
    feature, threshold, child, value, roots = [], [], [], [], []

    def node() -> int:
        k = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        child.append([k, k])
        value.append(0.0)
        return k

    def histogram(rows):
        f = flat[rows].ravel()
        return [np.bincount(f, weights=np.repeat(v[rows], m), minlength=m * bins).reshape(m, bins) for v in (g, hess, np.ones(n))]

    def best(hist):
        left = [np.cumsum(v, axis=1) for v in hist]
        total = [v[:, -1:] for v in left]
        right = [t - v for t, v in zip(total, left)]
        gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - total[0] ** 2 / (total[1] + l2)
        gain[(left[2] < least) | (right[2] < least)] = -1
        k = int(gain.argmax())
        return gain.flat[k], k // bins, k % bins

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-z))
        g, hess = y - p, p * (1 - p)
        root = node()
        roots.append(root)
        hist = histogram(np.arange(n))
        open_ = [(best(hist), root, np.arange(n), hist, 0)]
        done = []
        while open_ and len(open_) + len(done) < leaves:
            open_.sort(key=lambda t: t[0][0])
            (gain, j, b), k, rows, hist, d = open_.pop()
            if gain <= 1e-6 or d >= depth or b >= len(edges[j]):
                done.append((k, rows))
                continue
            go = binned[rows, j] > b
            feature[k], threshold[k] = j, edges[j][b]
            child[k] = [node(), node()]
            parts = rows[~go], rows[go]
            small = int(len(parts[0]) > len(parts[1]))
            one = histogram(parts[small])
            other = [a - c for a, c in zip(hist, one)]
            for side in (0, 1):
                own = one if side == small else other
                open_.append((best(own), child[k][side], parts[side], own, d + 1))
        for k, rows in done + [(t[1], t[2]) for t in open_]:
            value[k] = rate * g[rows].sum() / (hess[rows].sum() + l2)
            z[rows] += value[k]
    empty = [0] if not feature else []
    return Forest(np.array(feature + empty), np.array(threshold + [np.inf] * len(empty), dtype=np.float32), np.array(child + [[0, 0]] * len(empty)), np.array(value + [0.0] * len(empty)), np.array(roots, dtype=np.int64), depth, base)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array of float, in the order of NAMES) of every whole text; null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            x = statistics(raw(b.column(1)))
            flat = pa.array(x.ravel(), pa.float32())
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), flat)], names=["doc_id", "stats"])

    return text_of(docs).mapInArrow(run, "doc_id long, stats array<float>")


def held_out(fold: int, of: int, doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == fold, F.lit(False))


def labels_of(labels: DataFrame, column: str, fold: int, of: int) -> DataFrame:
    """One label per doc_id outside of the held-out fold: rows that disagree count by their majority, 1 at a tie."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    return known.where(~held_out(fold, of)).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))


def sampled(labels: DataFrame, column: str, rows: int, fold: int, of: int) -> DataFrame:
    """At most `rows` labels outside of the held-out fold, by a hash of doc_id, to broadcast: two short columns of a bounded number."""
    return F.broadcast(labels_of(labels, column, fold, of).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))


def fit_quality(stats: DataFrame, sample: DataFrame) -> Forest:
    """Trains on the documents of a sample of labels; without any label the score is 0.5."""
    got = stats.join(sample, "doc_id").select("doc_id", "stats", "y").toPandas()
    # an order of their own, so that sums of floats do not depend on partitions
    got = got.assign(key=[s.tobytes() for s in got.stats.map(np.array)]).sort_values(["doc_id", "key"])
    x = np.array(got.stats.tolist(), dtype=np.float32).reshape(len(got), len(NAMES))
    return train(x, got.y.to_numpy(dtype=np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Each row has its own score: repeated rows and rows without doc_id or text included. Statistics are written once,
    for training and scoring; no text is shuffled."""
    stats = checkpoint(features(docs))
    forest = fit_quality(stats, sampled(labels, "quality", rows, 2, 4))

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(NAMES))
            yield pa.record_batch([b.column(0), pa.array(forest.score(x))], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(2, 4).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score `threshold` or more, with all their columns; nothing but training data is shuffled, and
    of the texts only those of the sample are looked at twice."""
    sample = sampled(labels, "quality", rows, 2, 4)
    forest = fit_quality(features(text_of(docs).join(sample.select("doc_id"), "doc_id", "left_semi")), sample)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(forest.score(statistics(raw(b.column(at)))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
