"""Operator 4, n-gram Jaccard join with set-relation skipping.

1. Gate. Two sets that reach the threshold agree on a known number of shingles among the least of each (by hash). Those
   shingles meet over the whole corpus; a set of which too few are found in any other set has no partner and goes no further.
2. Lists. The shingles of the sets that are left are counted exactly, and a set enters the index lists of its prefix, its
   rarest shingles first: sets that reach the threshold meet in a list. Sets that meet, directly or not, form a cluster.
3. Join. Inside a cluster, lists are in order of position, and a probe skips the blocks of entries whose position can't
   reach the overlap; a set that is highly similar to one already answered derives its answer from that one's overlaps,
   corrected through the lists of the few shingles in which the two differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import meeting
from .common import checkpoint, components, few, partitions, small_batches, stored, table
from .textkernels import Words, mix, raw, shingles

#: Sets per block of a cluster, and shingles per block: a task holds two blocks at most.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
#: A set asks this share of its size (in percent) more of its least shingles than it must to meet a partner once.
MORE = 10
#: Sets within this distance (in percent) of an answered one derive their answers from it.
NEAR = 10
_U = np.uint64


def sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    w = Words(texts)
    h = w.hash()
    return [shingles(h[lo:hi], n) for lo, hi in zip(w.first[:-1], w.first[1:])]


def digests(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums by which equal sets are told; the first also names the set."""
    return tuple(mix(s + _U(salt)).sum(dtype=_U).astype(np.int64) for salt in (1, 2))


def must(n, percent: int):
    """The least overlap of a set of n shingles with any partner."""
    return -(-n * percent // 100)


def asked(n, percent: int):
    """How many of its least shingles a set shows: with a partner it shares at least met(n) of them that both show."""
    return n - must(n, percent) + np.maximum(1, -(-n * MORE // 100))


def met(n, percent: int):
    """A partner may be smaller, and then shows fewer."""
    return np.maximum(1, -(-must(n, percent) * MORE // 100))


def join_group(group: list[np.ndarray], block: np.ndarray, weight: np.ndarray, percent: int, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """(component, links) of each set among a group's: the smallest position that is reachable, and the summed weight of
    the sets that link to it. across: the group is that of two blocks, and sets are compared across blocks only."""
    n = len(group)
    order = np.argsort([len(s) for s in group], kind="stable")
    size = np.array([len(group[i]) for i in order], dtype=np.int64)
    block, weight = block[order], weight[order]
    flat = np.concatenate([group[i] for i in order])
    owner = np.repeat(np.arange(n), size)
    _, token, often = np.unique(flat, return_inverse=True, return_counts=True)
    # rare shingles first, so that prefixes are selective
    rank = np.empty(len(often), dtype=np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    token = rank[token]
    by = np.lexsort((token, owner))
    token = token[by]
    begin = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(len(token)) - begin[owner]
    lists = np.lexsort((place, token))
    list_owner, list_place = owner[lists], place[lists]
    head = np.searchsorted(token[lists], np.arange(len(often) + 1))
    # distances are a metric: who links to a set within NEAR of x is within this similarity of x
    reach = max(1, percent - NEAR)
    prefix = size - -(-size * reach // 100) + 1
    label, links = np.arange(n), np.zeros(n, dtype=np.int64)
    done = np.zeros(n, dtype=bool)
    shown = np.zeros(len(often), dtype=bool)

    def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
        """The indexes of several runs, one after the other."""
        return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))

    def probe(x: int) -> np.ndarray:
        """The sets that may reach `reach` with x, by the lists of its prefix, skipping by position."""
        s = size[x]
        back, ahead = s * (100 - reach) // 100, s * (100 - reach) // reach
        found = np.zeros(n, dtype=bool)
        for i, t in enumerate(token[begin[x] : begin[x] + prefix[x]]):
            lo, hi = head[t], head[t + 1]
            if hi - lo < 2:
                continue
            # entries are in order of position: blocks too far before or after i can't reach the overlap
            a = lo + np.searchsorted(list_place[lo:hi], i - back)
            b = lo + np.searchsorted(list_place[lo:hi], i + ahead, side="right")
            y, at = list_owner[a:b], list_place[a:b]
            need = -(-reach * (s + size[y]) // (100 + reach))
            found[y[(at < prefix[y]) & (np.minimum(i, at) + np.minimum(s - i, size[y] - at) >= need)]] = True
        found[x] = False
        return np.flatnonzero(found)

    def settle(x: int, some: np.ndarray, overlap: np.ndarray) -> None:
        """Answers x, given its overlaps with the sets that may link to it."""
        hit = (100 * overlap >= percent * (size[x] + size[some] - overlap)) & (some != x)
        if across:
            hit &= block[some] != block[x]
        y = some[hit]
        links[x] = weight[y].sum()
        own = np.unique(np.append(label[y], label[x]))
        if len(own) > 1:
            label[np.isin(label, own)] = own[0]

    for x in range(n):
        if done[x]:
            continue
        done[x] = True
        some = probe(x)
        if len(some) == 0:
            continue
        some = np.append(some, x)
        mine = token[begin[x] : begin[x + 1]]
        shown[mine] = True
        overlap = np.add.reduceat(shown[token[spread(begin[some], size[some])]].astype(np.int64), np.cumsum(size[some]) - size[some])
        settle(x, some, overlap)
        near = (100 * overlap >= (100 - NEAR) * (size[x] + size[some] - overlap)) & ~done[some]
        where = np.full(n, len(some))
        where[some] = np.arange(len(some))
        for y in some[near]:
            # y's overlaps are x's, less those through what only x has, and those through what only y has
            theirs = token[begin[y] : begin[y + 1]]
            come = theirs[~shown[theirs]]
            gone = np.setdiff1d(mine, theirs, assume_unique=True)
            count = lambda t: np.bincount(where[list_owner[spread(head[t], head[t + 1] - head[t])]], minlength=len(some) + 1)[:-1]
            done[y] = True
            settle(y, some, overlap - count(gone) + count(come))
        shown[mine] = False
    out_label, out_links = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    least = np.full(n, n)
    np.minimum.at(least, label, order)
    out_label[order], out_links[order] = least[label], links
    return out_label, out_links


def _gated(base: DataFrame, n: int, percent: int) -> DataFrame:
    """base: doc_id, h (a hash of the text), text. Rows of two kinds: doc_id, h, size, k1, k2, shared of each document (its
    set's size and digests), and doc_id, shared: of the shingles that it shows, so many are shown by another set of the
    corpus as well; to be summed over a document's rows."""
    buckets = meeting.buckets_of(base)
    own = ["doc_id", "h", "size", "k1", "k2", "shared"]
    names, schema = ["bucket", "n", "blob", *own], ", ".join(f"{c} long" for c in own)

    def show(batches):
        for (ids, h), texts in meeting.lots(batches, 2):
            s = sets(texts, n)
            size = np.array([len(x) for x in s], dtype=np.int64)
            k1, k2 = (np.array(k, dtype=np.int64) for k in zip(*map(digests, s)))
            # of the equal sets of a lot one is shown
            lead = np.unique(np.stack([size, k1, k2], axis=1), axis=0, return_index=True)[1]
            lead = np.sort(lead[size[lead] > 0])
            some = [s[i][: asked(len(s[i]), percent)] for i in lead]
            row = np.repeat(lead, [len(x) for x in some])
            # 48 bits of a hash: a few more sets may pass, none is lost
            key = np.concatenate(some) & ~_U(0xFFFF) if len(some) else np.zeros(0, dtype=_U)
            u, first, at, often = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            known = np.bincount(row[often[at] > 1], minlength=len(s))
            at_doc = np.array(ids, dtype=np.int64)
            first = np.sort(first)
            many = (often[at[first]] > 1).astype(np.int64)
            b, m, x = meeting.blobs(key[first], [at_doc[row[first]], many], buckets)
            none = pa.nulls(len(b), pa.int64())
            yield pa.record_batch([pa.array(b, pa.int32()), pa.array(m, pa.int32()), pa.array(x, pa.binary()), *[none] * len(own)], names=names)
            yield pa.record_batch([pa.array(at_doc % buckets, pa.int32()), pa.nulls(len(s), pa.int32()), pa.nulls(len(s), pa.binary()), *map(pa.array, (at_doc, np.array(h, dtype=np.int64), size, k1, k2, known))], names=names)

    def tell(batches):
        for rows, columns in meeting.by_bucket(batches, [np.int64, np.int64, np.uint64]):
            if rows is not None:
                yield rows.select(own)
                continue
            doc, many, key = columns
            _, at, often = np.unique(key, return_inverse=True, return_counts=True)
            # in several lots, or in several sets of one; where its own lot knew, a shingle is counted already
            told = ((often[at] > 1) | (np.bincount(at, weights=many)[at] > 0)) & (many == 0)
            ids, count = np.unique(doc[told], return_counts=True)
            none = pa.nulls(len(ids), pa.int64())
            yield pa.record_batch([pa.array(ids), none, none, none, none, pa.array(count.astype(np.int64))], names=own)

    return meeting.met(base.mapInArrow(show, f"bucket int, n int, blob binary, {schema}")).mapInArrow(tell, schema)


def _clusters(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, component) of the sets (node, text) that meet in a list of a shingle of both prefixes."""

    def emit(batches):
        for b in batches:
            s = sets(raw(b.column(1)), n)
            many = np.array([len(x) for x in s], dtype=np.int64)
            flat = np.concatenate(s) if s else np.zeros(0, dtype=_U)
            row = np.repeat(np.arange(len(s)), many)
            yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array(many[row]), pa.array(flat.view(np.int64))], names=["node", "n", "s"])

    s = texts.select("node", "text").mapInArrow(emit, "node long, n long, s long")
    often = s.groupBy("s").agg(F.count("*").alias("often")).where("often > 1")
    shared = s.join(often, "s")
    need = F.ceil(F.col("n") * percent / 100)
    per = Window.partitionBy("node")
    prefix = shared.withColumn("shared", F.count("*").over(per)).withColumn("place", F.row_number().over(per.orderBy("often", "s")))
    # the shingles that one set alone has come first in its prefix; what is left of it are these
    prefix = checkpoint(prefix.where((F.col("shared") >= need) & (F.col("place") + F.col("n") - F.col("shared") <= F.col("n") - need + 1)).select("node", "s"))
    first = prefix.groupBy("s").agg(F.min("node").alias("first"), F.count("*").alias("m")).where("m > 1").select("s", "first")
    return components(prefix.join(first, "s").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")))


def _verified(texts: DataFrame, clusters: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, least, links, whole) for each set and task that compared it: who it reaches there, how many documents link to
    it, and whether that task had its whole cluster."""
    spark = texts.sparkSession
    sized = clusters.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    member = clusters.join(sized, "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # a cluster over one block is compared by pairs of blocks; each set goes to as many tasks as there are blocks
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    member = member.select("node", "component", "block", "weight", "blocks", other.alias("o")).select("node", "component", "block", "weight", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), (F.col("blocks") == 1).alias("whole"))
    keys = ["component", "i", "j"]
    rows = texts.select("node", "text").join(few(member), "node").select(*keys, "node", "block", "weight", "whole", "text")
    dealt = rows.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "node")

    def run(batches):
        def finish(group):
            s = sets([r[5] for r in group], n)
            label, links = join_group(s, np.array([r[2] for r in group]), np.array([r[3] for r in group]), percent, group[0][0][1] != group[0][0][2])
            ids = [r[1] for r in group]
            return ids, [min(ids[x], ids[i]) for i, x in enumerate(label.tolist())], links.tolist(), [r[4] for r in group]

        def give(columns):
            kinds = [pa.int64()] * 3 + [pa.bool_()]
            return pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds)], names=["node", "least", "links", "whole"])

        held, key = [], None
        for b in batches:
            found: tuple[list, ...] = ([], [], [], [])
            k = list(zip(*(b.column(i).to_pylist() for i in range(3))))
            rest = zip(*(b.column(i).to_pylist() for i in range(3, 7)), raw(b.column(7)))
            for here, r in zip(k, rest):
                if here != key:
                    if len(held) > 1:
                        for out, new in zip(found, finish(held)):
                            out += new
                    held, key = [], here
                held.append((here, *r))
            yield give(found)
        if len(held) > 1:
            yield give(finish(held))

    return dealt.mapInArrow(run, "node long, least long, links long, whole boolean")


def _linked(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, h (a hash of the text), n, k1, k2 of each row of docs that has a doc_id; and of each distinct
    set that isn't empty n, k1, k2, component, component_id, n_links, component being a name without a meaning."""
    small_batches(docs.sparkSession)
    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(docs).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    # of equal texts the first alone is looked into: a copy would tell all that its original shows
    facts = known.select("doc_id", "h", F.xxhash64(F.lit(1), "text").alias("g"))
    again = few(checkpoint(facts.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "g", "first")))
    copies = checkpoint(facts.join(again, ["h", "g"]).where("doc_id > first").select("doc_id", "h", "first"))
    known = known.join(few(copies.select("doc_id", "h").distinct()), ["doc_id", "h"], "left_anti")
    gated = stored(_gated(known, n, percent))
    own = gated.where("size IS NOT NULL").select("doc_id", "h", F.col("size").alias("n"), "k1", "k2")
    firsts = own.withColumnRenamed("doc_id", "first").join(again.select("first", "h"), ["first", "h"], "left_semi").distinct()
    rows = checkpoint(own.unionByName(copies.join(few(firsts), ["first", "h"]).drop("first")))
    full = rows.where("n > 0")
    keys = ["n", "k1", "k2"]
    least = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * percent / 100) * MORE / 100))
    shared = gated.where("shared > 0").groupBy("doc_id").agg(F.sum("shared").alias("shared"))
    passed = own.join(shared, "doc_id").where(F.col("shared") >= least).select(*keys).distinct()
    classes = checkpoint(full.groupBy(*keys).agg(F.min(F.struct("doc_id", "h")).alias("head"), F.count("*").alias("weight")).select(*keys, "head.*", "weight"))
    # a class is named by a digest, as several may have rows of one doc_id
    heads = checkpoint(classes.join(passed, keys, "left_semi").select("doc_id", "h", F.col("k1").alias("node"), "n", "weight"))
    texts = stored(known.join(few(heads.select("doc_id", "h", "node")), ["doc_id", "h"]).select("node", "text").dropDuplicates(["node"]))
    sizes = heads.groupBy("node").agg(F.max("n").alias("n"), F.sum("weight").alias("weight"))
    clusters = checkpoint(_clusters(texts, n, percent).join(sizes, "node"))
    checked = checkpoint(_verified(texts, clusters, n, percent))
    # what one task has seen as a whole is settled
    part = checked.where("NOT whole").select(F.col("node").alias("a"), F.col("least").alias("b"))
    comp = checked.where("whole").select("node", F.col("least").alias("component")).unionAll(components(part))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(comp.withColumnRenamed("node", "k1"), "k1", "left").join(links.withColumnRenamed("node", "k1"), "k1", "left")
    named = named.withColumn("component", F.coalesce("component", "k1"))
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = named.join(lowest, "component").select(*keys, "component", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return rows, checkpoint(out)


def _text_hash(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs.text, F.lit("")))


def linked(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (rows that link to it directly, copies included), for each row.

    A document's set: the distinct runs of n words, lower-cased in A-Z; with fewer words the whole as one run. Two link
    when 100 * intersection >= percent * union. Null and empty texts have an empty set and link with nothing. Rows
    that share a doc_id are compared each by its own text; a row without doc_id has a null component and no links."""
    rows, classes = _linked(docs, n, percent)
    out = rows.where("n > 0").join(classes, ["n", "k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    rest = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))

    names = ["doc_id", "n_shingles", "component_id", "n_links"]

    def alone(batches):
        for b in batches:
            size = pa.array([len(s) for s in sets(raw(b.column(0)), n)], pa.int64())
            yield pa.record_batch([pa.nulls(b.num_rows, pa.int64()), size, pa.nulls(b.num_rows, pa.int64()), pa.array([0] * b.num_rows, pa.int64())], names=names)

    lone = docs.where("doc_id IS NULL").select(F.coalesce("text", F.lit("")).alias("text"))
    return out.unionAll(rest).unionAll(lone.mapInArrow(alone, "doc_id long, n_shingles long, component_id long, n_links long"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the smallest doc_id stays (where two texts
    have it, the one of the smaller hash), one of it where rows repeat. Rows without doc_id and those with an empty set stay.

    No text is shuffled while the rows that go are few enough to be broadcast (see common.few)."""
    rows, classes = _linked(docs, n, percent)
    named = rows.where("n > 0").join(classes.select("n", "k1", "k2", "component"), ["n", "k1", "k2"])
    first = named.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    counted = checkpoint(named.join(first, "component").groupBy("doc_id", "h", (F.struct("doc_id", "h") == F.col("first")).alias("stays")).agg(F.count("*").alias("c")))
    name = lambda k: f"{k}{'_' * max([0, *(len(c) for c in docs.columns)])}"
    of = lambda some: few(some.select(F.col("doc_id").alias(name("i")), F.col("h").alias(name("h"))))
    same = (docs.doc_id.cast("long") == F.col(name("i"))) & (_text_hash(docs) == F.col(name("h")))
    left = docs.join(of(counted.where("NOT stays")), same, "left_anti")
    again = counted.where("stays AND c > 1")
    if not again.limit(1).count():
        return left
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    once = docs.join(of(again), same, "left_semi").withColumn(name("n"), F.row_number().over(order)).where(F.col(name("n")) == 1).drop(name("n"))
    return left.join(of(again), same, "left_anti").unionByName(once)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
