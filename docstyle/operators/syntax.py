"""Metrics over a parse table (doc_id, sent, k, token, pos, dep, head): a tree per sentence, the root its own head."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Relations of universal dependencies.
SUBORDINATE = ["advcl", "ccomp", "xcomp", "acl", "relcl", "csubj", "csubjpass", "acl:relcl"]
COORDINATE = ["conj", "cc"]


def complexity(parse: DataFrame) -> DataFrame:
    """Ratios per sentence of subordination, coordination and clauses; share of sentences with a subordinate; dependents by head."""
    p = parse.withColumn("sub", F.lower("dep").isin(SUBORDINATE).cast("int")).withColumn("coord", F.lower("dep").isin(COORDINATE).cast("int")).withColumn("clause", F.col("pos").isin("VERB", "AUX").cast("int"))
    s = p.groupBy("doc_id", "sent").agg(F.sum("sub").alias("sub"), F.sum("coord").alias("coord"), F.sum("clause").alias("clause"), F.sum((F.col("head") != F.col("k")).cast("int")).alias("children"), F.countDistinct(F.when(F.col("head") != F.col("k"), F.col("head"))).alias("heads"))
    return s.groupBy("doc_id").agg(F.avg("sub").alias("subordination_ratio"), F.avg("coord").alias("coordination_ratio"), F.avg("clause").alias("clauses_per_sentence"), (F.sum("children") / F.when(F.sum("heads") > 0, F.sum("heads"))).alias("mean_dependents_per_head"), F.avg((F.col("sub") > 0).cast("int")).alias("prop_complex_sentences"))


def depths(owner: np.ndarray, n: int, k: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Depth of the tree of each of n sentences, to which owner deals the tokens; 0 of none."""
    base = int(max(k.max(initial=0), head.max(initial=0))) + 1
    order = np.argsort(owner * base + k, kind="stable")
    key = (owner * base + k)[order]
    at = np.minimum(np.searchsorted(key, owner * base + head), max(0, len(key) - 1))
    up = np.where(key[at] == owner * base + head, order[at], np.arange(len(k))) if len(k) else at
    depth, here = np.ones(len(k), dtype=np.int64), np.arange(len(k))
    # a tree's depth is its sentence's length at most; more steps would mean a cycle
    for _ in range(int(np.bincount(owner, minlength=n).max(initial=0))):
        move = up[here] != here
        if not move.any():
            break
        depth += move
        here = up[here]
    deepest = np.zeros(n, dtype=np.int64)
    np.maximum.at(deepest, owner, depth)
    return deepest


def tree_depth(parse: DataFrame) -> DataFrame:
    """Mean and population deviation over sentences of the tree's depth, the root alone being 1.

    A sentence is a bounded group; the heads of all sentences of a batch are climbed at once. A head that its sentence lacks
    counts as the root."""
    rows = parse.groupBy("doc_id", "sent").agg(F.collect_list(F.struct("k", "head")).alias("t"))

    def run(batches):
        for b in batches:
            lists = b.column(2)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            k, head = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            owner = np.repeat(np.arange(len(size)), size)
            deepest = depths(owner, len(size), k, head)
            yield pa.record_batch([b.column(0), pa.array(deepest, pa.int32())], names=["doc_id", "depth"])

    kind = parse.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, depth int").groupBy("doc_id").agg(F.avg("depth").alias("parse_tree_depth_mean"), F.stddev_pop("depth").alias("parse_tree_depth_std"))


def dependency_distance(parse: DataFrame) -> DataFrame:
    """Mean and population deviation over sentences of the mean distance to the head and of the share at distance 1."""
    d = F.abs(F.col("k") - F.col("head"))
    s = parse.groupBy("doc_id", "sent").agg(F.avg(d).alias("d"), F.avg((d == 1).cast("int")).alias("a"))
    return s.groupBy("doc_id").agg(F.avg("d").alias("dependency_distance_mean"), F.stddev_pop("d").alias("dependency_distance_std"), F.avg("a").alias("prop_adjacent_dependency_relation_mean"), F.stddev_pop("a").alias("prop_adjacent_dependency_relation_std"))


def pos_proportions(parse: DataFrame, tags: list[str]) -> DataFrame:
    return parse.groupBy("doc_id").agg(*[F.avg((F.col("pos") == t).cast("int")).alias(f"pos_prop_{t}") for t in tags])


COLUMNS = [
    "subordination_ratio", "coordination_ratio", "clauses_per_sentence", "mean_dependents_per_head", "prop_complex_sentences", "parse_tree_depth_mean", "parse_tree_depth_std",
    "dependency_distance_mean", "dependency_distance_std", "prop_adjacent_dependency_relation_mean", "prop_adjacent_dependency_relation_std",
]


def parsed(owner: np.ndarray, n: int, sent: np.ndarray, k: np.ndarray, head: np.ndarray, pos: pa.DictionaryArray, dep: pa.DictionaryArray, tags: list[str]) -> dict[str, np.ndarray]:
    """COLUMNS and pos_prop_<tag> of n texts, to which owner deals the tokens, as the functions above give them; NaN of none."""
    is_in = lambda x, of: np.isin(np.arange(len(x.dictionary)), [i for i, v in enumerate(x.dictionary.to_pylist()) if v in of])[x.indices.to_numpy(zero_copy_only=False)]
    lower = pa.DictionaryArray.from_arrays(dep.indices, pc.utf8_lower(dep.dictionary))
    base = int(sent.max(initial=0)) + 1
    found, at = np.unique(owner * base + sent, return_inverse=True)
    text, m = found // base, len(found)
    per_sentence = lambda x: np.bincount(at, weights=x, minlength=m)
    size, child = np.bincount(at, minlength=m), head != k
    high = int(head.max(initial=0)) + 1
    heads = np.bincount(np.unique(at[child] * high + head[child]) // high, minlength=m)
    sub, distance = per_sentence(is_in(lower, SUBORDINATE)), np.abs(k - head)
    some = lambda x: np.where(x > 0, x, np.nan)
    by_text = lambda x: np.bincount(text, weights=x, minlength=n)
    many = some(np.bincount(text, minlength=n))

    def spread(x):
        mean = by_text(x) / many
        return mean, np.sqrt(by_text((x - mean[text]) ** 2) / many)

    mean = lambda x: by_text(x) / many
    values = [
        mean(sub), mean(per_sentence(is_in(lower, COORDINATE))), mean(per_sentence(is_in(pos, ("VERB", "AUX")))), by_text(per_sentence(child)) / some(by_text(heads)), mean(sub > 0),
        *spread(depths(at, m, k, head)), *spread(per_sentence(distance) / size), *spread(per_sentence(distance == 1) / size),
    ]
    tokens = some(np.bincount(owner, minlength=n))
    return dict(zip(COLUMNS, values)) | {f"pos_prop_{t}": np.bincount(owner, weights=is_in(pos, (t,)), minlength=n) / tokens for t in tags}


def inline(parser, tags: list[str]):
    """The families of a parser that is a function, as scoring.Extra: nothing is exploded or shuffled. It takes scoring.Tokens
    and gives (sent, k, head, pos, dep) of each token: numbers as arrays, names as Arrow dictionary arrays."""
    return [*COLUMNS, *(f"pos_prop_{t}" for t in tags)], lambda t: parsed(t.owner, len(t.counts), *parser(t), tags)
