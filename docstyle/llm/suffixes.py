"""Operator 8, suffix-array dedup by depth-limited radix sort.

Suffixes are ordered only through their first DEPTH bytes, by most-significant-digit passes; groups that are still
equal after the last digit are exactly the repeated windows. The passes are spread over the cluster so:

1. Whole texts: of equal texts only the first is looked into; a later one is covered throughout.
2. First digit: the least hash among the 16-byte strings inside a window. Equal windows have equal digits, and neighbouring
   windows mostly share one, so a run of windows travels as one short row. Runs whose digit one document alone has
   drop out; where all runs of a digit are the same string, the first document decides them at once, and a run that a
   smaller document has as a whole is covered and, as that document has its windows, needs no comparison.
3. Remaining digits: the windows of the other runs, grouped by their first digit, are refined eight bytes at a time by
   a radix sort in numpy, groups of one leaving after each pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, partitions, small_batches, table, text_of
from .meeting import blobs, buckets_of, by_bucket, lots, met
from .textkernels import _BYTE, _powers, mix, raw

DEPTH = 50
GRAM = 16
#: Texts are looked at in pieces of so many bytes, which bounds the arrays of a batch or of a very long text.
PIECE = 1 << 19
#: Digits that this share of a sample of documents has are hot: few by definition, decided by an aggregate.
HOT_SHARE = 0.004
HOT_SAMPLE = 20_000
#: First digits keep so many bits: two strings under one digit cost a comparison and change nothing.
DIGIT = np.uint64((1 << 48) - 1)
#: More runs than this under one digit are not sorted in one task; their windows are grouped by the cluster.
GROUP = 40_000


def runs(texts: list[bytes], depth: int = DEPTH):
    """(text, at, count, digit, mark) of each run of consecutive windows that share their first digit.

    mark: 40 bits of a hash of the run's bytes, above its count of windows modulo 64."""
    out = []
    lots, lot, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - depth + 1), PIECE):
            part = t[at : at + PIECE + depth - 1]
            lot.append((i, at, part))
            size += len(part)
            if size >= PIECE:
                lots.append(lot)
                lot, size = [], 0
    for lot in lots + [lot] * bool(lot):
        buf = np.frombuffer(b"".join(p for _, _, p in lot) + bytes(16), dtype=np.uint8)
        begins = np.cumsum([0] + [len(p) for _, _, p in lot])
        n = int(begins[-1])
        word = np.ndarray((n,), dtype="<u8", buffer=buf, strides=(1,)).astype(np.uint64)
        h = mix(word * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        gram = mix(h[: n - 8] + word[8:] * np.uint64(0xD1B54A32D192ED03))[: n - GRAM + 1]
        width, least, span = depth - GRAM + 1, gram, 1
        while 2 * span <= width:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        rest = width - span
        digit = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        piece = np.searchsorted(begins, np.arange(len(digit)), side="right") - 1
        inside = np.arange(len(digit)) + depth <= begins[piece + 1]
        new = np.ones(len(digit), dtype=bool)
        new[1:] = (digit[1:] != digit[:-1]) | (piece[1:] != piece[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new & inside)
        stop = np.append(np.flatnonzero(new | ~inside), len(digit))
        last = stop[np.searchsorted(stop, first, side="right")]
        power, inverse = _powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[buf[:n]] * power[:n], out=sums[1:])
        whole = mix((sums[last + depth - 1] - sums[first]) * inverse[first])
        count = last - first
        mark = (whole >> np.uint64(24) << np.uint64(6)) | (count % 64).astype(np.uint64)
        owner = np.array([i for i, _, _ in lot])[piece[first]]
        offset = np.array([a for _, a, _ in lot])[piece[first]] + first - begins[piece[first]]
        out.append((owner, offset, count, digit[first] & DIGIT, mark))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def equal_windows(group: np.ndarray, at: np.ndarray, buf: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Depth-limited most-significant-digit radix sort of the windows of buf that begin at `at`.

    Returns (order, group): indexes of the windows that equal another of the same given group, in the order of their
    bytes, and for each the number of its group of equal windows. Windows alone in their group leave after each digit."""
    order = np.lexsort((at, group))
    group = group[order]
    for p in range(0, depth, 8):
        new = np.append(True, group[1:] != group[:-1])[: len(group)]
        number = np.cumsum(new) - 1
        more = np.bincount(number, minlength=1)[number] > 1 if len(number) else new
        order, number = order[more], number[more]
        if len(order) == 0:
            return order, number
        digit = np.ndarray((len(buf) - 7,), dtype=">u8", buffer=buf, strides=(1,))[at[order] + p].astype(np.uint64)
        if p + 8 > depth:
            digit = digit >> np.uint64(8 * (p + 8 - depth))
        by = np.lexsort((digit, number))
        order, number, digit = order[by], number[by], digit[by]
        group = np.cumsum(np.append(True, (number[1:] != number[:-1]) | (digit[1:] != digit[:-1]))[: len(number)]) - 1
    more = np.bincount(group, minlength=1)[group] > 1
    order, group = order[more], group[more]
    return order, np.cumsum(np.append(True, group[1:] != group[:-1])[: len(group)]) - 1


def _intervals(row: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of [at, at + depth) for windows sorted by row and at, as (row, begin, end)."""
    if len(row) == 0:
        return row, at, at
    new = np.append(True, (row[1:] != row[:-1]) | (at[1:] > at[:-1] + depth))
    first = np.flatnonzero(new)
    return row[first], at[first], at[np.append(first[1:], len(row)) - 1] + depth


def _compare(digits, docs, ats, segs, depth: int):
    """Coverage of the runs of some digits, all of whose runs are given: (doc, begin, end) arrays."""
    buf = np.frombuffer(b"".join(segs) + bytes(64), dtype=np.uint8)
    length = np.array([len(s) for s in segs])
    begins = np.cumsum(length) - length
    many = length - depth + 1
    row = np.repeat(np.arange(len(segs)), many)
    step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    order, group = equal_windows(digits[row], begins[row] + step, buf, depth)
    if len(order) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    doc = docs[row[order]]
    first = np.minimum.reduceat(doc, np.flatnonzero(np.append(True, group[1:] != group[:-1])))
    hit = np.sort(order[doc > first[group]])
    r, b, e = _intervals(row[hit], ats[row[hit]] + step[hit], depth)
    return docs[r], b, e


def settle(doc: np.ndarray, mark: np.ndarray, key: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, digit, mark, status) of the runs of some digits that are covered (1), to be compared in a task (0) or by the
    cluster (2), of all runs of those digits. key: the digit above 16 bits."""
    order = np.lexsort((doc, mark, key))
    doc, mark, key = doc[order], mark[order], key[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    begin = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    ends = np.append(begin[1:], len(key))
    if len(begin) == 0:
        return doc, doc, mark, doc.astype(np.int32)
    first, last = np.minimum.reduceat(doc, begin)[number], np.maximum.reduceat(doc, begin)[number]
    several, n = (mark[begin] < mark[ends - 1])[number], (ends - begin)[number]
    same = np.flatnonzero(new | np.append(True, mark[1:] != mark[:-1]))
    whole = np.repeat(doc[same], np.diff(np.append(same, len(key))))
    status = np.where(whole < doc, 1, np.where(n > group, 2, np.where(several, 0, 1))).astype(np.int32)
    keep = (first < last) & ((status != 1) | (doc > first))
    return doc[keep], (key[keep] >> np.uint64(16)).view(np.int64), mark[keep], status[keep]


def coverage(docs: DataFrame, depth: int = DEPTH, sample_of: DataFrame | None = None) -> DataFrame:
    """(doc_id, begin, end) byte intervals, unions of the windows that also begin in a document with a smaller doc_id.

    docs: doc_id (not null) and text, equal texts reduced to one. Rows that share a doc_id count as one document.
    sample_of: where hot digits are looked for, docs if not given; a table that is read without a shuffle."""
    spark = docs.sparkSession
    small_batches(spark)

    def digits(batches):
        for b in batches:
            text, _, _, digit, mark = runs(raw(b.column(1)), depth)
            yield pa.record_batch([b.column(0).take(pa.array(text)), pa.array(digit.view(np.int64)), pa.array(mark.view(np.int64))], names=["doc_id", "digit", "mark"])

    schema = "doc_id long, digit long, mark long"
    sample_of = docs if sample_of is None else sample_of
    sample = sample_of.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(HOT_SAMPLE)
    # the sample's size is a parameter; it only decides which way a digit's rows take, not what comes out
    some = sample_of.join(F.broadcast(sample.distinct()), "doc_id")
    least = max(50, int(HOT_SHARE * HOT_SAMPLE))
    hot_digits = [x.digit for x in some.mapInArrow(digits, schema).distinct().groupBy("digit").agg(F.countDistinct("doc_id").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "digit").limit(50_000).select("digit").collect()]
    facts = [F.min("doc_id"), F.max("doc_id"), F.min("mark"), F.max("mark"), F.count("*")]
    names = ["first", "last", "lo", "hi", "n"]
    hot = np.sort(np.array(hot_digits, dtype=np.int64))
    group, buckets = GROUP, buckets_of(docs)

    def is_hot(digit):
        at = np.minimum(np.searchsorted(hot, digit), max(0, len(hot) - 1))
        return hot[at] == digit if len(hot) else np.zeros(len(digit), dtype=bool)

    def packed(batches):
        for (ids,), texts in lots(batches, 1):
            text, _, _, digit, mark = runs(texts, depth)
            cold = ~is_hot(digit.view(np.int64))
            doc = np.array(ids, dtype=np.int64)[text[cold]]
            # the digit's 48 bits above, as buckets are ranges of the key
            bucket, n, blob = blobs(digit[cold] << np.uint64(16), [doc, mark[cold].view(np.int64)], buckets)
            yield pa.record_batch([pa.array(bucket, pa.int32()), pa.array(n, pa.int32()), pa.array(blob, pa.binary())], names=["bucket", "n", "blob"])

    def decide(batches):
        for _, columns in by_bucket(batches, [np.int64, np.int64, np.uint64]):
            if columns:
                doc, digit, mark, status = settle(*columns, group)
                # a run by its digit and mark in one long
                yield pa.record_batch([pa.array(doc), pa.array(digit ^ mark << 17), pa.array(status)], names=["doc_id", "run", "status"])

    found = met(docs.mapInArrow(packed, "bucket int, n int, blob binary")).mapInArrow(decide, "doc_id long, run long, status int")
    if len(hot):

        def only_hot(batches):
            for b in digits(batches):
                yield b.filter(pa.array(is_hot(b.column(1).to_numpy())))

        warm = docs.mapInArrow(only_hot, schema)
        # as many rows as there are hot digits, which the sample's share bounds
        decided = warm.groupBy("digit").agg(*[f.alias(n) for f, n in zip(facts, names)])
        status = F.when(F.col("n") > GROUP, 2).when(F.col("lo") < F.col("hi"), 0).otherwise(1)
        warm = warm.join(F.broadcast(decided), "digit").where("first < last").withColumn("status", status).where("status <> 1 OR doc_id > first")
        found = found.unionByName(warm.select("doc_id", F.col("digit").bitwiseXOR(F.shiftleft("mark", 17)).alias("run"), "status"))
    told = found.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set(F.struct("run", "status")).alias("told"))
    joined = docs.join(told, docs.doc_id == told.of).select("doc_id", "text", "told")

    def open_runs(batches):
        for b in batches:
            texts, told = raw(b.column(1)), b.column(2)
            ids = b.column(0).to_numpy()
            text, at, count, digit, mark = runs(texts, depth)
            lists, flat = told.offsets.to_numpy(), told.values
            known, state = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy()
            owner = np.repeat(np.arange(b.num_rows), np.diff(lists))
            known = known[lists[0] : lists[-1]] if len(lists) else known
            state = state[lists[0] : lists[-1]] if len(lists) else state
            key = mix(known.view(np.uint64) + mix(owner.astype(np.uint64) + np.uint64(1)))
            by = np.argsort(key, kind="stable")
            key, state = key[by], state[by]
            own = mix((digit ^ mark << np.uint64(17)) + mix(text.astype(np.uint64) + np.uint64(1)))
            j = np.minimum(np.searchsorted(key, own), max(0, len(key) - 1))
            hit = key[j] == own if len(key) else np.zeros(len(own), dtype=bool)
            state = np.where(hit, state[j], 9) if len(key) else np.full(len(own), 9)
            done = np.flatnonzero(state == 1)
            # covered runs, neighbours joined
            cr, cb, ce = text[done], at[done], at[done] + count[done] + depth - 1
            new = np.append(True, (cr[1:] != cr[:-1]) | (cb[1:] > ce[:-1]))[: len(cr)]
            f = np.flatnonzero(new)
            ends = np.maximum.reduceat(ce, f) if len(f) else ce
            rest = np.flatnonzero((state == 0) | (state == 2))
            route = np.concatenate([ids[cr[f]], np.where(state[rest] == 0, digit[rest].view(np.int64), ids[text[rest]])])
            segs = [None] * len(f) + [texts[i][a : a + c + depth - 1] for i, a, c in zip(text[rest].tolist(), at[rest].tolist(), count[rest].tolist())]
            yield pa.record_batch([pa.array(np.concatenate([ids[cr[f]], ids[text[rest]]])), pa.array(np.concatenate([np.full(len(f), 1), state[rest]]).astype(np.int32)), pa.array(route), pa.array(np.concatenate([cb[f], at[rest]]).astype(np.int64)), pa.array(np.concatenate([ends, np.zeros(len(rest))]).astype(np.int64)), pa.array(segs, pa.binary())], names=["doc_id", "status", "route", "begin", "end", "seg"])

    opened = joined.mapInArrow(open_runs, "doc_id long, status int, route long, begin long, end long, seg binary").repartition(partitions(spark), "route")

    def compare(batches):
        left: list = []

        def finish(rows):
            d, doc, at = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1, 2))
            return _compare(d, doc, at, [r[3] for r in rows], depth)

        def give(doc, b, e):
            return pa.record_batch([pa.array(doc, pa.int64()), pa.array(b, pa.int64()), pa.array(e, pa.int64())], names=["doc_id", "begin", "end"])

        for b in batches:
            status = b.column(1).to_numpy()
            done = b.filter(pa.array(status == 1))
            if done.num_rows:
                yield give(done.column(0), done.column(3), done.column(4))
            r = b.filter(pa.array(status == 0))
            left += zip(r.column(2).to_pylist(), r.column(0).to_pylist(), r.column(3).to_pylist(), r.column(5).to_pylist())
            # rows come sorted by digit: all but the last digit are complete
            if left and len(left) > 2000:
                cut = next((i for i in range(len(left) - 1, 0, -1) if left[i][0] != left[i - 1][0]), 0)
                if cut:
                    yield give(*finish(left[:cut]))
                    left = left[cut:]
        if left:
            yield give(*finish(left))

    closed = opened.sortWithinPartitions("status", "route").mapInArrow(compare, "doc_id long, begin long, end long")

    def windows(batches):
        def give(rows):
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "begin", "window"])

        for b in batches:
            b, rows = b.filter(pa.array(b.column(1).to_numpy() == 2)), []
            for d, at, seg in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(5).to_pylist()):
                for i in range(len(seg) - depth + 1):
                    rows.append((d, at + i, seg[i : i + depth]))
                    if len(rows) >= 20_000:
                        yield give(rows)
                        rows = []
            if rows:
                yield give(rows)

    # the windows of digits with too many runs for one task: one row each, grouped by all of their bytes at once. All three
    # uses of opened take it whole, in Python, so that they share one exchange and nothing has to be stored between
    many = opened.mapInArrow(windows, "doc_id long, begin long, window binary")
    first = many.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("window", "first")
    wide = many.join(first, "window").where("doc_id > first").select("doc_id", "begin", (F.col("begin") + depth).alias("end"))
    return closed.unionByName(wide)


def dedup(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, covers (removed [begin, end) byte intervals) for each row.

    A byte goes if a window of `depth` bytes that covers it also begins in a document with a smaller doc_id; windows
    are those of the input. Null text is empty; texts shorter than a window keep all. Rows of one doc_id count as one
    document, and each has its result; rows without doc_id keep all and are compared with nothing."""
    spark = docs.sparkSession
    base = text_of(docs)
    known = base.where("doc_id IS NOT NULL")
    # equal texts by a 256-bit hash; the aggregate is combined by tasks first, so thousands of copies are no hot group
    classes = checkpoint(known.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    heads = classes.groupBy("sha").agg(F.min("doc_id").alias("head"))
    later = checkpoint(classes.join(heads, "sha").where("doc_id > head").select(F.col("doc_id").alias("copy"), "sha").distinct())
    # a doc_id may have several texts: what counts as a copy is the row with that text
    sha = F.sha2(F.col("text").cast("binary"), 256)
    copies = later.groupBy("copy").agg(F.collect_set("sha").alias("shas"))
    firsts = known.join(copies, known.doc_id == copies.copy, "left").where(F.col("shas").isNull() | ~F.array_contains("shas", sha)).select("doc_id", "text")
    cover = coverage(firsts, depth, known).groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("begin", "end")).alias("covers"))
    rows = known.join(copies, known.doc_id == copies.copy, "left").join(cover, known.doc_id == cover.of, "left")
    rows = rows.select("doc_id", "text", F.when(F.array_contains("shas", sha), F.lit(True)).otherwise(False).alias("copied"), "covers")
    rows = rows.unionAll(base.where("doc_id IS NULL").select("doc_id", "text", F.lit(False), F.lit(None).cast("array<struct<begin:bigint,end:bigint>>")))

    def cut(batches):
        for b in batches:
            found = []
            for t, copied, c in zip(raw(b.column(1)), b.column(2).to_pylist(), b.column(3)):
                if copied and len(t) >= depth:
                    spans = [(0, len(t))]
                else:
                    spans = []
                    for x in sorted((x["begin"], min(x["end"], len(t))) for x in (c.as_py() or [])):
                        if x[1] - x[0] < depth:
                            continue
                        if spans and x[0] <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], max(spans[-1][1], x[1]))
                        else:
                            spans.append(x)
                kept, at = hashlib.sha256(), 0
                for lo, hi in spans:
                    kept.update(t[at:lo])
                    at = hi
                kept.update(t[at:])
                found.append((len(t), sum(hi - lo for lo, hi in spans), len(spans), kept.hexdigest(), [{"begin": lo, "end": hi} for lo, hi in spans]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
            yield pa.record_batch([b.column(0), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "covers"])

    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, covers array<struct<begin: long, end: long>>")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("covers")
