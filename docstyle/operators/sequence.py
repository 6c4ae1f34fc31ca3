"""Metrics of token sequences: moving type-token ratio, windowed entropy, self-predicted trigram entropy.

They need a document's tokens in order, so one Arrow pass computes all of them and nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

COLUMNS = ["mattr", "H_unigram_win_mean_nats", "H_unigram_win_std_nats", "PPL_unigram_win_mean", "H_3gram_self_nats", "PPL_3gram_self_nats"]


def mattr(codes: np.ndarray, window: int = 100) -> float | None:
    """Mean over windows of distinct tokens by window size: each token counts in the windows where it is the first of its kind."""
    n = len(codes)
    if n == 0:
        return None
    if n < window:
        return len(np.unique(codes)) / n
    order = np.argsort(codes, kind="stable")
    before = np.full(n, -1)
    same = codes[order[1:]] == codes[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    i = np.arange(n)
    first = np.maximum(np.maximum(0, i - window + 1), before + 1)
    return float(np.maximum(0, np.minimum(i, n - window) - first + 1).sum() / (window * (n - window + 1)))


def windowed_entropy(codes: np.ndarray, window: int = 100, step: int | None = None) -> tuple:
    """Mean, population deviation and exponential of the mean of the entropy (nats) of hopping windows."""
    n = len(codes)
    if n == 0:
        return None, None, None
    window = min(window, n)
    step = step or max(1, window // 2)
    found = []
    for at in range(0, n - window + 1, step):
        p = np.unique(codes[at : at + window], return_counts=True)[1] / window
        found.append(-(p * np.log(p)).sum())
    return float(np.mean(found)), float(np.std(found)), float(np.exp(np.mean(found)))


def seeded_mask(n: int, test_frac: float, seed: int) -> np.ndarray:
    """Which positions train: the first of a seeded permutation."""
    mask = np.zeros(n, dtype=bool)
    mask[np.random.default_rng(seed).permutation(n)[: int(n * (1 - test_frac))]] = True
    return mask


def hashed_mask(n: int) -> np.ndarray:
    """Which positions train: about four in five by a multiplicative hash, which SQL can repeat."""
    return np.arange(n, dtype=np.int64) * 2654435761 % 100 < 80


def trigram_entropy(codes: np.ndarray, train: np.ndarray, alpha: float = 0.1) -> tuple:
    """Mean surprise (nats) of the held-back tokens' trigrams under add-alpha counts of the training tokens', and its exponential.

    Both parts close up over the tokens they leave out. A bigram counts only where a third token follows."""
    n = len(codes)
    a, b = codes[train].astype(np.int64), codes[~train].astype(np.int64)
    if n < 10 or len(a) == 0 or len(b) < 3:
        return None, None
    base = int(codes.max()) + 1
    tri = lambda x: (x[:-2] * base + x[1:-1]) * base + x[2:]
    keys, counts = np.unique(tri(a), return_counts=True) if len(a) > 2 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    pairs, pair_counts = np.unique(a[:-2] * base + a[1:-1], return_counts=True) if len(a) > 2 else (keys, counts)

    def look(keys, counts, x):
        at = np.minimum(np.searchsorted(keys, x), max(0, len(keys) - 1))
        return np.where(keys[at] == x, counts[at], 0) if len(keys) else np.zeros(len(x))

    h = -np.log((look(keys, counts, tri(b)) + alpha) / (look(pairs, pair_counts, b[:-2] * base + b[1:-1]) + alpha * len(np.unique(a)))).mean()
    return float(h), float(np.exp(h))


def all_metrics(codes: np.ndarray, wanted: set[str], split: str = "seeded", window: int = 100, test_frac: float = 0.2, alpha: float = 0.1, seed: int = 2001) -> tuple:
    """COLUMNS of one text; families of which none is wanted are left at None."""
    first = mattr(codes, window) if COLUMNS[0] in wanted else None
    entropy = windowed_entropy(codes, window) if wanted & set(COLUMNS[1:4]) else (None,) * 3
    if not wanted & set(COLUMNS[4:]):
        return first, *entropy, None, None
    train = seeded_mask(len(codes), test_frac, seed) if split == "seeded" else hashed_mask(len(codes))
    return first, *entropy, *trigram_entropy(codes, train, alpha)


def sequence_metrics(docs: DataFrame, keys=("doc_id",), wanted=tuple(COLUMNS), **options) -> DataFrame:
    """keys and the wanted ones of COLUMNS for each row; null where a metric is undefined."""
    from .scoring import token_metrics

    return token_metrics(docs, list(keys), list(wanted), **options)
