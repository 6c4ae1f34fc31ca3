"""Operator 7, substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed, the hashes meet in one aggregate over the corpus, and the
sentences that any but the first occurrence of a repeated span covers are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import meeting
from .common import few, small_batches, stored, table
from .textkernels import Words, mix, raw

#: A span: at least this many sentences, and as many more as it takes to have this many words.
SENTENCES = 2
WORDS = 20
#: A longer sentence is cut at places that its words decide, so that text without sentence ends has spans too.
LONGEST = 15
#: Of so many places in a row inside a longer sentence, it is cut at the one of least hash. A repeat cuts alike but for its
#: first and last 2 * WINDOW - 1 words at most, so one of over 50 words holds WORDS words between two such cuts.
WINDOW = 8
#: What may stand between a sentence's end and the white space after it: quotes and brackets.
_AFTER = [x.encode() for x in "\"')]}»«›‹”“’‘」』）"]
_ENDS = [x.encode() for x in ".!?…。！？"]


#: Bits of a place that hold a count of sentences.
_SIZE = 31


def _found(buf: np.ndarray, pattern: bytes) -> np.ndarray:
    """Where a pattern's last byte stands."""
    at = np.flatnonzero(buf == pattern[-1])
    at = at[at >= len(pattern) - 1]
    for i in range(2, len(pattern) + 1):
        at = at[buf[at - i + 1] == pattern[-i]]
    return at


def _closes(w: Words) -> np.ndarray:
    """Whether a word ends a sentence: its last character is . ! ? or their like, quotes and brackets after it aside."""
    rest, ends = np.arange(len(w.buf)), np.zeros(len(w.buf), dtype=bool)
    for x in _AFTER:
        at = _found(w.buf, x)
        for i in range(len(x)):
            rest[at - i] = -1
    for x in _ENDS:
        ends[_found(w.buf, x)] = True
    last = np.maximum.accumulate(rest)[w.end - 1]
    return (last >= w.start) & ends[last]


def _cuts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """First words of the pieces that sentences of more than LONGEST words are cut into."""
    size = np.diff(np.append(first, len(h)))
    long = np.repeat(size > LONGEST, size)
    # the place before a word is told by the words on both sides of it; a sentence's first word has no such place
    place = mix(np.append(np.uint64(0), h[:-1]) * np.uint64(3) + h)
    inside = long.copy()
    inside[first] = False
    run = np.flatnonzero(inside)
    # windows of places that lie in one sentence
    run = run[run + WINDOW <= np.repeat(np.append(first[1:], len(h)), size)[run]]
    least, at = place[run], run.copy()
    for i in range(1, WINDOW):
        less = place[run + i] <= least
        least = np.where(less, place[run + i], least)
        at = np.where(less, run + i, at)
    return np.unique(at)


def sentences(texts: list[bytes]):
    """(words, their hashes, first word of each sentence, text of each sentence), sentences being runs of words up to one
    that ends in . ! or ? (see _closes), or to a line end or the end of the text; those of over LONGEST words in pieces."""
    w = Words(texts)
    if len(w.start) == 0:
        return w, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h = w.hash()
    lines = np.concatenate([[0], np.cumsum(w.buf == 10)])
    new = np.ones(len(w.start), dtype=bool)
    new[1:] = _closes(w)[:-1] | (lines[w.start[1:]] != lines[w.start[:-1]]) | (w.text[1:] != w.text[:-1])
    new[_cuts(h, np.flatnonzero(new))] = True
    first = np.flatnonzero(new)
    return w, h, first, w.text[first]


def span_hashes(texts: list[bytes], least: int = SENTENCES, words: int = WORDS):
    """For each span: its text, first sentence (numbered in the text), number of sentences, hash; by sentence position."""
    w, h, first, text = sentences(texts)
    n = len(first)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64)
    bounds = np.append(first, len(w.start))
    # a sum of mixed (word, place in sentence) is taken per sentence, then sentences are chained in order
    place = np.arange(len(h)) - np.repeat(first, np.diff(bounds))
    sentence = mix(np.add.reduceat(mix(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first) + np.diff(bounds).astype(np.uint64))
    number = np.arange(n) - np.repeat(np.flatnonzero(np.diff(text, prepend=-1)), np.diff(np.append(np.flatnonzero(np.diff(text, prepend=-1)), n)))
    end_of_text = np.searchsorted(text, text, side="right")
    # the first sentence count at which the words suffice
    last = np.maximum(np.arange(n) + least, np.searchsorted(bounds, first + words, side="left"))
    ok = last <= end_of_text
    start, last = np.flatnonzero(ok), last[ok]
    size = last - start
    out = np.zeros(len(start), dtype=np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        go = size > k
        out[go] = mix(out[go] * np.uint64(0xD1B54A32D192ED03) + sentence[start[go] + k])
    return text[start], number[start], size, mix(out + size.astype(np.uint64))


def keyed(docs: DataFrame) -> Column:
    """What tells rows of one doc_id apart: a hash of the text, or 0 if no doc_id repeats, as that shrinks when shuffled."""
    again = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long")).count().where("count > 1").limit(1).collect()
    return F.xxhash64(F.coalesce(docs.text, F.lit(""))) if again else F.lit(0).cast("long")


def covers(docs: DataFrame, key: Column, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """of, key, covers: for each text (doc_id and hash) that loses something, the sorted places of its spans that are not the
    first of their hash, the order being doc_id, key (see keyed()), then position. A place is the number of a first sentence
    and a count of sentences in one long.

    A lot of texts knows all but its own first span of a hash to be no first, and joins them to runs of sentences; only the
    first crosses the network, so a passage that a third of all documents share is as many rows as there are lots."""
    small_batches(docs.sparkSession)
    buckets = meeting.buckets_of(docs)
    names = ["bucket", "n", "blob", "doc_id", "key", "place"]

    def emit(batches):
        for (ids, keys), texts in meeting.lots(batches, 2):
            text, at, size, h = span_hashes(texts, least, words)
            doc, key, place = np.array(ids, dtype=np.int64)[text], np.array(keys, dtype=np.int64)[text], at << _SIZE | size
            order = np.lexsort((place, key, doc, h))
            new = np.append(True, h[order[1:]] != h[order[:-1]])[: len(order)]
            first, later = np.sort(order[new]), np.sort(order[~new])
            doc_, key_, place_ = doc[first], key[first], place[first]
            # spans come by text and position, and of two the later ends no earlier
            begin, end, whose = at[later], at[later] + size[later], text[later]
            run = np.flatnonzero(np.append(True, (whose[1:] != whose[:-1]) | (begin[1:] > end[:-1]))[: len(later)])
            doc, key = doc[later][run], key[later][run]
            place = begin[run] << _SIZE | (end[np.append(run[1:], len(later)) - 1] - begin[run] if len(run) else run)
            b, m, x = meeting.blobs(h[first], [doc_, key_, place_], buckets)
            yield pa.record_batch([pa.array(b, pa.int32()), pa.array(m, pa.int32()), pa.array(x, pa.binary()), *[pa.nulls(len(b), pa.int64())] * 3], names=names)
            yield pa.record_batch([pa.array(doc % buckets, pa.int32()), pa.nulls(len(doc), pa.int32()), pa.nulls(len(doc), pa.binary()), pa.array(doc), pa.array(key), pa.array(place)], names=names)

    def tell(batches):
        for rows, columns in meeting.by_bucket(batches, [np.int64, np.int64, np.int64, np.uint64]):
            if rows is not None:
                yield rows.select(names[3:])
                continue
            doc, key, place, h = columns
            order = np.lexsort((place, key, doc, h))
            later = order[np.append(False, h[order[1:]] == h[order[:-1]])[: len(order)]]
            yield pa.record_batch([pa.array(doc[later]), pa.array(key[later]), pa.array(place[later])], names=names[3:])

    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    places = meeting.met(known.mapInArrow(emit, "bucket int, n int, blob binary, doc_id long, key long, place long")).mapInArrow(tell, "doc_id long, key long, place long")
    return stored(places.groupBy(F.col("doc_id").alias("of"), "key").agg(F.sort_array(F.collect_set("place")).alias("covers")))


def _cut(texts: list[bytes], found: list) -> list[tuple[bytes, int, int, int]]:
    """For each text without the sentences of its spans' places (None: it has none): what is left; bytes, runs and
    sentences removed."""
    w, _, first, text = sentences(texts)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    out = []
    for i, (t, places) in enumerate(zip(texts, found)):
        if places is None:
            out.append((t, 0, 0, 0))
            continue
        own = first[bounds[i] : bounds[i + 1]]
        places = np.array(places, dtype=np.int64)
        gone = np.zeros(len(own) + 1, dtype=np.int64)
        begin, size = places >> _SIZE, places & ((1 << _SIZE) - 1)
        np.add.at(gone, begin, 1)
        np.add.at(gone, np.minimum(begin + size, len(own)), -1)
        gone = np.cumsum(gone)[:-1] > 0
        # a sentence owns the white space after it, so that what stays is contiguous
        begin = np.append(w.start[own] - w.text_start[i], len(t))
        begin[0] = 0
        kept = b"".join(t[begin[k] : begin[k + 1]] for k in np.flatnonzero(~gone))
        out.append((kept, len(t) - len(kept), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), int(gone.sum())))
    return out


def cleaned(docs: DataFrame, least: int = SENTENCES, words: int = WORDS, counts: bool = False) -> DataFrame:
    """The same rows and columns with repeated spans taken out of text; n_chars, if there, follows. counts: three columns
    more, at the end: removed_bytes, removed_runs, removed_sentences (a name that docs has is lengthened by underscores).

    A document's own later repeats go as well. Rows that share a doc_id are told apart by their text; rows
    without doc_id keep their text and are compared with nothing, null texts stay null. Texts under `least` sentences or
    `words` words hold no span. Spans compare lower-cased words, so other spacing or case does not hide a repeat.
    Only texts that lose something are shuffled, while they are few enough for their ids to be broadcast (common.few)."""
    key, names = keyed(docs), docs.columns
    found = covers(docs, key, least, words)
    more = [c + "_" * (c in names) * max(map(len, names)) for c in ("removed_bytes", "removed_runs", "removed_sentences")]
    i, k, c = (x + "_" * max(map(len, names)) for x in ("of", "key", "covers"))
    found = found.select(F.col("of").alias(i), F.col("key").alias(k), F.col("covers").alias(c))
    same = (docs.doc_id.cast("long") == F.col(i)) & (key == F.col(k))
    ids = found.select(i, k)
    marked = few(ids)
    some = docs if marked is ids else docs.join(marked, same, "left_semi")
    joined = some.join(found, (some.doc_id.cast("long") == F.col(i)) & (key == F.col(k)), "left").select(*[some[x] for x in names], c)
    at = names.index("text")

    def run(batches):
        for b in batches:
            null = b.column(at).is_null()
            done = _cut(raw(b.column(at)), b.column(len(names)).to_pylist())
            text = pa.array([None if z else x[0] for x, z in zip(done, null.to_pylist())], pa.binary()).cast(pa.string())
            yield pa.record_batch([*(b.column(j) if j != at else text for j in range(len(names))), *(pa.array([x[j] for x in done], pa.int64()) for j in (1, 2, 3))], names=[*names, *more])

    out = joined.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{x}` long" for x in more)]))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    if marked is not ids:
        out = out.unionByName(docs.join(marked, same, "left_anti").select("*", *[F.lit(0).cast("long").alias(x) for x in more]))
    return out if counts else out.select(*names)


def remove(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """doc_id, text (null becomes empty, repeated spans removed), n_removed (bytes), n_spans, n_sentences for each row.
    See cleaned()."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return cleaned(plain, least, words, counts=True).toDF("doc_id", "text", "n_removed", "n_spans", "n_sentences")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (F.octet_length("text") + F.col("n_removed")).cast("long").alias("n_bytes"), "n_removed", "n_spans", "n_sentences", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
