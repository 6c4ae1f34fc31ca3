"""Operator 1, best-fit packing of token pieces into sequences, by best-two-fit over the histogram of lengths.

Lengths are integers up to the sequence length, so a plan over counts of each length places any number of pieces:
its size and the driver's work depend on the sequence length and not on the data.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, small_batches, table, text_of

CAPACITY = 4096
END_ID = 1
_LOADED: dict[str, "Ids"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Ids:
    """Token ids of texts as little-endian uint32 bytes.

    The tokenizer drops white space and merges only within what lies between, so the ids of such a run of characters
    are kept and reused. That holds where lower-casing, NFC and white space are plain: a text with a run outside of
    that range, or that may spell a special token, goes through the tokenizer whole. Tests hold both ways together.
    """

    PLAIN = r"[\x21-\x7e\xa1-įı-ɏ]+"
    ODD_SPACE = "\x1c\x1d\x1e\x1f"

    def __init__(self, path: str, most: int = 600_000):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        self.most = most
        self.plain = re.compile(self.PLAIN).fullmatch

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, runs: list[str], at_once: int = 100) -> None:
        """Keeps the ids of each run, encoded many in a call and told apart by their offsets; None if it isn't plain."""
        fit = [w for w in runs if self.plain(w)]
        self.kept.update(dict.fromkeys(runs))
        for k in range(0, len(fit), at_once):
            some = fit[k : k + at_once]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begins = np.cumsum([0] + [len(w) + 1 for w in some])
            ids = np.array(found.ids, dtype="<u4")
            cut = np.searchsorted(np.array([o[0] for o in found.offsets], dtype=np.int64), begins)
            for w, lo, hi in zip(some, cut[:-1].tolist(), cut[1:].tolist()):
                self.kept[w] = ids[lo:hi].tobytes()

    def __call__(self, text: str) -> bytes:
        if "<|" in text or any(c in text for c in self.ODD_SPACE):
            return self.encode(text)
        runs = text.lower().split()
        missing = set(runs).difference(self.kept)
        if missing:
            if len(self.kept) > self.most:
                self.older, self.kept, missing = self.kept, {}, set(runs)
            if known := missing & self.older.keys():
                self.kept.update((w, self.older[w]) for w in known)
                missing -= known
            self.learn(list(missing))
        try:
            return b"".join(map(self.kept.__getitem__, runs))
        except TypeError:
            return self.encode(text)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, little-endian uint32).

    A document is its ids and END_ID; null and empty texts are END_ID alone. Only documents over the capacity are
    cut, all pieces but the last being full. Repeated rows each have pieces of their own."""
    path = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)

    def run(batches):
        ids = _LOADED.get(path) or _LOADED.setdefault(path, Ids(path))
        end, step = np.array([END_ID], dtype="<u4").tobytes(), 4 * capacity
        for b in batches:
            row, piece, length, crc, kept = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                data = ids(text) + end
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    row.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            start = pa.array(np.array(piece, dtype=np.int64) * capacity)
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), start, pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.record_batch(cols + [pa.array(kept, pa.binary())] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return text_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan_bins(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-two-fit over counts[length]: (times, [(length, how many)]) patterns that use up every count exactly.

    A bin opens with the longest piece and is filled greedily with the longest that fits. If a gap is left, the bin's
    smallest piece is exchanged for the two unpacked pieces whose sum comes nearest to piece plus gap from above the
    piece, as long as that tightens the bin. The pattern is repeated while counts last."""
    left = counts.astype(np.int64).copy()
    out = []
    present = [int(x) for x in np.flatnonzero(left)]
    while present:
        use: dict[int, int] = {}
        gap = capacity
        at = len(present)
        while gap > 0 and at > 0:
            at = min(at, bisect_right(present, gap))
            if at == 0:
                break
            x = present[at - 1]
            n = 1 if not use else min(int(left[x]) - use.get(x, 0), gap // x)
            if n > 0:
                use[x] = use.get(x, 0) + n
                gap -= n * x
            if n == 0 or left[x] == use[x]:
                at -= 1
        while gap > 0 and sum(use.values()) > 1:
            small = min(use)
            free = left.copy()
            for x, n in use.items():
                free[x] -= n
            a = np.flatnonzero(free[: small + gap])
            if len(a) == 0:
                break
            b = np.searchsorted(a, small + gap - a, side="right") - 1
            mate = a[b]
            # the same length twice needs two of them, else the next shorter one
            alone = (mate == a) & (free[a] < 2)
            b = b - alone
            ok = b >= 0
            total = np.where(ok, a + a[np.maximum(b, 0)], 0)
            best = int(total.argmax())
            if total[best] <= small:
                break
            for x, n in ((small, -1), (int(a[best]), 1), (int(a[b[best]]), 1)):
                use[x] = use.get(x, 0) + n
                if use[x] == 0:
                    del use[x]
            gap -= int(total[best]) - small
        times = min(int(left[x]) // n for x, n in use.items())
        out.append((times, sorted(use.items(), reverse=True)))
        for x, n in use.items():
            left[x] -= times * n
            if left[x] == 0:
                present.remove(x)
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY, salts: int = 64, copies: bool = False) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...); copies: and copy, which numbers pieces of one
    doc_id and number from 0, as where a mix has taken a document twice. The pieces' own columns stay whatever their names.

    Pieces of a length are ranked within hash-salted groups, shifted by exact counts, so that a length that a third of
    all pieces have is ranked by many tasks; the rank then decides the sequence by binary search in the plan. The
    driver holds at most capacity * salts counts; more salts part the pieces of one length over more tasks. Nulls can't
    occur in pieces(); an empty table gives no rows."""
    salt_, rank_, copy_ = (x + "_" * max(map(len, parts.columns)) for x in ("salt", "rank", "copy"))
    salted = parts.withColumn(salt_, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counted = sorted(tuple(x) for x in salted.groupBy("length", salt_).agg(F.count("*").alias("n")).collect())
    keys = np.array([x * salts + s for x, s, _ in counted], dtype=np.int64)
    n = np.array([x[2] for x in counted], dtype=np.int64)
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    np.add.at(histogram, keys // salts, n)
    before = np.cumsum(n) - n
    before -= before[np.searchsorted(keys, keys // salts * salts)] if len(keys) else 0
    runs, used, sequence = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for times, items in plan_bins(histogram, capacity):
        offset = 0
        for length, many in items:
            runs.append((length, used[length], many, sequence, offset))
            used[length] += times * many
            offset += length * many
        sequence += times
    table_ = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    lengths, first_rank, many, first_sequence, first_offset = table_.T.copy()
    begins = np.searchsorted(lengths, np.arange(capacity + 2))
    names = [c for c in parts.columns]
    ranked = salted.withColumn(rank_, F.row_number().over(Window.partitionBy("length", salt_).orderBy("doc_id", "piece", "ids_crc32")))
    # equal pieces lie side by side in that order, so this needs no exchange and no sort of its own
    ranked = ranked.withColumn(copy_, F.row_number().over(Window.partitionBy("length", salt_, "doc_id", "piece").orderBy("ids_crc32")) - 1)

    def run(batches):
        for b in batches:
            length, salt, rank = (b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", salt_, rank_))
            rank = before[np.searchsorted(keys, length * salts + salt)] + rank - 1
            at = np.empty(len(length), dtype=np.int64)
            for x in np.unique(length):
                mine = length == x
                lo, hi = begins[x], begins[x + 1]
                at[mine] = lo + np.searchsorted(first_rank[lo:hi], rank[mine], side="right") - 1
            q = rank - first_rank[at]
            cols = [b.column(b.schema.get_field_index(c)) for c in names]
            more = [b.column(b.schema.get_field_index(copy_)).cast(pa.int32())] * copies
            yield pa.record_batch([*cols, pa.array(first_sequence[at] + q // many[at]), pa.array(first_offset[at] + q % many[at] * length), *more], names=[*names, "sequence_id", "offset", *["copy"] * copies])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long" + ", copy int" * copies)


def sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary), pieces (doc_id, piece, offset, length in order).

    A sequence gathers at most `capacity` ids, so its group is bounded."""
    placed = pack(checkpoint(pieces(docs, tokenizer, capacity, with_ids=True)), capacity)
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("p"))
    return rows.select("sequence_id", F.expr("aggregate(p.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("pieces"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(checkpoint(pieces(table(spark, sf_dir, "documents"))))
