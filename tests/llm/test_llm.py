"""The operators of the subpackage on small tables: against brute force, and on nulls, empty texts, ties and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from docstyle.llm import fingerprints, jaccard, media, mixing, packing, registry, sharding, spans, suffixes, toxicity, trees

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, digit string"


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = [". ".join(" ".join(word() for _ in range(rng.randint(3, 12))).capitalize() for _ in range(rng.randint(1, 12))) + "." for _ in range(n)]
    shared = " ".join(word() for _ in range(40)) + ". " + " ".join(word() for _ in range(20)) + "."
    for i in range(0, n, 5):
        texts[i] += " " + shared
    for i in range(1, n, 7):
        t = texts[i - 1].split()
        t[len(t) // 2] = "changed"
        texts[i] = " ".join(t)
    texts[3] = texts[2]
    texts += [None, "", " \n ", "x", "ÄÖ ß ñ 日本語 text. " * 40, "rep rep. " * 500, texts[2], "İ ΣΑΣ <|endoftext|> don't"]
    rows = [(i * 3 + 1, t, "en", f"s{i % 4}" if i % 9 else None, None, 7, 7, "x") for i, t in enumerate(texts)]
    return rows + [(None, "no id here at all", None, "s1", None, None, None, None), (4, "a second row of an id", "en", "s0", 1, 1, 1, "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def plain(spark):
    """Without repeated or missing ids, as brute force has it simpler."""
    return spark.createDataFrame(corpus()[:-2], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i * 3 + 1, int(i % 5 > 0), int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def test_empty_tables(spark, nothing, labels):
    for df in (sharding.shard_by_bytes(nothing), mixing.plan(mixing.sized(nothing)), packing.pack(packing.pieces(nothing)), media.media_digest(media.text_media(nothing)), jaccard.linked(nothing), spans.remove(nothing), suffixes.dedup(nothing), fingerprints.fingerprints(nothing), trees.score_quality(nothing, labels), toxicity.score_toxicity(nothing, labels)):
        assert df.count() == 0


def test_packing(docs):
    rows = packing.pack(packing.pieces(docs, capacity=64), capacity=64).collect()
    ids = packing.Ids(packing.default_tokenizer())
    want = {}
    for d, t, *_ in corpus():
        whole = ids.encode(t or "") + np.array([1], "<u4").tobytes()
        for k, at in enumerate(range(0, len(whole), 256)):
            want.setdefault((d, k), []).append((zlib.crc32(whole[at : at + 256]), len(whole[at : at + 256]) // 4, k * 64))
    got = {}
    bins = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece), []).append((r.ids_crc32, r.length, r.start))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in rows) // 64) + 2


def test_sequences(docs):
    for r in packing.sequences(docs, capacity=64).collect():
        assert len(r.ids) == 4 * sum(p.length for p in r.pieces) <= 256


def test_two_fit():
    counts = np.zeros(11, dtype=int)
    counts[[7, 3, 2, 4, 6]] = [1, 1, 1, 1, 1]
    p = packing.plan_bins(counts, 10)
    assert sum(t for t, _ in p) == 3 and all(sum(x * n for x, n in items) <= 10 for _, items in p)


def test_sharding(docs):
    rows = sharding.shard_by_bytes(docs, rows_per_piece=10).collect()
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted((d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in corpus())
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_mixing(docs):
    rows = mixing.plan(mixing.sized(docs)).collect()
    assert len(rows) == len(corpus())
    by = {}
    for r in rows:
        x = by.setdefault(r.source, [0, r.target, 0])
        x[0] += r.taken
        x[2] += r.size
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(t - g) <= 1 for t, g, _ in by.values())
    assert sum(g for _, g, _ in by.values()) == pytest.approx(sum(r.size for r in rows))
    assert sorted(map(str, mixing.plan(mixing.sized(docs.repartition(3))).collect())) == sorted(map(str, rows))
    taken = mixing.mix(docs)
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in taken.collect())
    assert abs(words - sum(r.taken for r in rows)) <= 60  # rows of one id are taken alike


def test_targets():
    assert mixing.targets({"a": 1, "b": 10, "c": 100}) == pytest.approx({"a": 3.0, "b": 30.0, "c": 78.0})


def test_split_tree():
    q = np.array([5, 9, 0, 20])
    t = mixing.split_tree(q, 8, np.random.default_rng(0))
    assert (t.sum(0) == q).all() and t.sum(1).max() - t.sum(1).min() <= 1


def test_media(docs):
    rows = media.media_digest(media.text_media(docs)).collect()
    want = []
    for d, t, *_ in corpus():
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want.append((d or 0, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    assert all(np.load(__import__("io").BytesIO(bytes(r.tile))).shape == (32, 32) for r in rows[:5])


def test_image_formats(spark):
    rng = np.random.default_rng(0)
    g, c = rng.integers(0, 256, (9, 7), dtype=np.uint8), rng.integers(0, 256, (6, 5, 3), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(g)) == g).all() and (media.decode(media.encode_bmp(c)) == c).all()
    assert (media.decode(b"P3\n# c\n1 1 255\n1 2 3\n") == [[[1, 2, 3]]]).all()
    assert media.decode(b"nonsense") is None and media.decode(None) is None and media.decode(b"P5\n9 9\n255\nx") is None
    assert np.allclose(media.area_resize(np.ones((13, 5)) * 7, 8, 9), 7)
    a = rng.random((12, 8))
    assert np.allclose(media.area_resize(a, 4, 4), a.reshape(4, 3, 4, 2).mean((1, 3)))
    t = media.tiles(spark.createDataFrame([(1, bytearray(media.encode_pgm(g))), (2, None)], "id long, m binary"), "id", "m").collect()
    assert sorted((r.id, r.height) for r in t) == [(1, 9), (2, None)]


def brute_links(rows, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    comp, links = {d: d for d in sets}, dict.fromkeys(sets, 0)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = comp[a], comp[b]
                comp = {d: min(x, y) if c in (x, y) else c for d, c in comp.items()}
    return {d: (len(s), comp[d], links[d]) for d, s in sets.items()}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 60)])
def test_jaccard(plain, n, percent, monkeypatch):
    if n == 5:
        monkeypatch.setattr(jaccard, "BLOCK", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.linked(plain, n, percent).collect()}
    assert got == brute_links(corpus()[:-2], n, percent)


def test_jaccard_odd_rows(docs):
    rows = jaccard.linked(docs).collect()
    assert len(rows) == len(corpus()) and [r.component_id for r in rows if r.doc_id is None] == [None]
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL").count() == 1


def test_join_group_random():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**60, 60).astype(np.uint64)
    group = []
    for _ in range(80):
        s = base.copy()
        at = rng.random(60) < rng.choice([0.01, 0.05, 0.1])
        s[at] = rng.integers(0, 2**60, int(at.sum())).astype(np.uint64)
        group.append(np.unique(s[: rng.integers(50, 61)]))
    label, links = jaccard.join_group(group, np.zeros(80, dtype=int), np.ones(80, dtype=int), 85, False)
    for i, a in enumerate(group):
        want = [j for j, b in enumerate(group) if j != i and 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))]
        assert links[i] == len(want) and all(label[j] == label[i] for j in want)


def test_join_group_of_one_block():
    """Two blocks of which one is empty: their pair finds nothing, as the block alone has been compared already."""
    group = [np.arange(20, dtype=np.uint64)] * 2
    for across, want in ((False, [3, 2]), (True, [0, 0])):
        assert jaccard.join_group(group, np.zeros(2, dtype=int), np.array([2, 3]), 85, across)[1].tolist() == want


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, plain, name, tmp_path):
    import duckdb

    plain.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def brute_suffixes(rows, depth=50):
    seen, out = set(), {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        w = [b[i : i + depth] for i in range(len(b) - depth + 1)]
        gone = np.zeros(len(b) + 1, dtype=int)
        for i, x in enumerate(w):
            if x in seen:
                gone[i] += 1
                gone[i + depth] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        seen |= set(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("group,hot", [(40_000, 0.004), (1, 0.004), (40_000, 0.0)])
def test_suffixes(plain, group, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(plain).collect()}
    assert got == brute_suffixes(corpus()[:-2])


def test_suffixes_odd_rows(docs):
    rows = suffixes.dedup(docs).collect()
    assert len(rows) == len(corpus()) and [r.n_removed for r in rows if r.doc_id is None] == [0]


def test_suffixes_shuffle_texts_once(spark):
    """Texts cross the network once and runs as blobs, in figures: 2.8 times the texts' bytes; it was 4.1."""
    rng = random.Random(7)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .", k=6000))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    jsc = spark.sparkContext._jsc.sc()

    def written():
        jsc.listenerBus().waitUntilEmpty(30_000)
        found = jsc.statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = written()
    assert suffixes.dedup(df).agg({"n_removed": "sum"}).first()[0] == 0
    ratio = (written() - before) / (400 * 6000)
    assert ratio < 3.3, ratio


def test_settle_against_plain_groups():
    rng = np.random.default_rng(3)
    doc, mark, digit = rng.integers(0, 6, 400), rng.integers(0, 3, 400), rng.integers(0, 90, 400).astype(np.uint64)
    want = []
    for d, m, g in zip(doc, mark, digit):
        own = digit == g
        first, whole = doc[own].min(), doc[own & (mark == m)].min()
        status = 1 if whole < d else 2 if own.sum() > 5 else 0 if mark[own].min() < mark[own].max() else 1
        if first < doc[own].max() and (status != 1 or d > first):
            want.append((d, int(g), m, status))
    assert sorted(zip(*suffixes.settle(doc, mark, digit << np.uint64(16), 5))) == sorted(want) and want


def test_radix_sort():
    buf = np.frombuffer(b"abcabcabcx" * 3 + bytes(70), dtype=np.uint8)
    at = np.arange(20)
    order, group = suffixes.equal_windows(np.zeros(20, dtype=int), at, buf, 10)
    found = sorted(tuple(sorted(order[group == g].tolist())) for g in np.unique(group))
    assert found == [(i, i + 10) for i in range(10)]


def test_spans(spark, docs):
    passage = " ".join(f"word{i} goes here and there now." for i in range(10))
    rows = [(1, "Start here. " + passage), (2, "Another beginning of text. " + passage + " And an end."), (3, "Clean text stays as it is. It has nothing in common."), (None, passage), (5, None)]
    got = {r.doc_id: r for r in spans.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[3].n_removed == 0 and got[None].n_removed == 0 and got[5].text == ""
    assert got[2].text == "Another beginning of text. And an end." and got[2].n_spans == 1
    out = spans.cleaned(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_spans_of_text_without_sentence_ends(spark):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = words(60)
    rows = [(1, f"{words(40)} {passage} {words(40)}")] + [(2 + i, f"{words(30 + i)} {passage} {words(35)}") for i in range(15)]
    got = {r.doc_id: r for r in spans.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0
    for d, t in rows[1:]:
        left = got[d].text.split()
        # at most 15 words at each end of a repeat are cut otherwise, and nothing else goes
        assert 30 <= len(t.split()) - len(left) <= 60 and [w for w in left if w not in passage] == [w for w in t.split() if w not in passage]


def test_a_repeat_of_51_words_holds_a_span():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    for trial in range(400):
        end = rng.choice([0, 0, 0.03, 0.1])
        run = lambda n: [word() + (rng.choice([".", '."', "?)", "\u2026", "!\u201d"]) if rng.random() < end else "") for _ in range(n)]  # noqa: B023, E731
        passage = run(51)
        a, b = (" ".join(run(rng.randint(0, 40)) + passage + run(rng.randint(0, 40))).encode() for _ in range(2))
        h = [set(spans.span_hashes([x])[3].tolist()) for x in (a, b)]
        assert h[0] & h[1], (trial, a, b)


def test_sentence_ends():
    for end in (".", "!", "?", '."', "?)", ".'\u201d", "\u2026", "!\u00bb", "\u3002"):
        assert len(spans.sentences([f"One two{end} Three".encode()])[2]) == 2, end
    for end in ("", ",", '"', ")", ".x", "\u201d"):
        assert len(spans.sentences([f"One two{end} Three".encode()])[2]) == 1, end


def test_fingerprints(plain, docs):
    rows = sorted(((d, t or "") for d, t, *_ in corpus()[:-2]), reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprints(plain).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    same = {}
    for d, t in rows:
        assert same.setdefault(t, got[d].fingerprint) == got[d].fingerprint
    assert fingerprints.fingerprints(docs).count() == len(corpus())


def test_fingerprints_plan_one_signing_at_a_time(spark, monkeypatch):
    """Rows without doc_id are signed by a plan of their own, only where there are some, and come out alike."""
    calls, signed = [], fingerprints._signed
    monkeypatch.setattr(fingerprints, "_signed", lambda *a: calls.append(1) or signed(*a))
    rows = [(2, "one two two three"), (1, "four five"), (None, "one two two three")]
    got = fingerprints.fingerprints(spark.createDataFrame(rows[:2], "doc_id long, text string"), 4).collect()
    assert len(calls) == 1 and len(got) == 2
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert len(calls) == 3 and set(got) == {1, 2, None}
    assert got[None].fingerprint == got[2].fingerprint and got[None].near_next is None and got[2].near_next is not None


def test_likeness_against_exact_similarity(spark):
    from collections import Counter

    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randint(0, 400):03d}" for _ in range(60))) for i in range(200)]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = []
    for i, t in rows:
        edited = t[: len(t) - len(t) // 2] + rows[i - 1][1][: len(t) // 2]
        a, b = Counter(t.split()), Counter(edited.split())
        wrong.append(got[i].near_edited - (a & b).total() / (a | b).total())
    assert abs(np.mean(wrong)) < 0.02 and np.std(wrong) < 0.08


def test_quality(docs, labels):
    rows = trees.score_quality(docs, labels).collect()
    assert len(rows) == len(corpus()) and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert trees.keep_quality(docs, labels).columns == docs.columns


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    f = trees.train(x[:2000], y[:2000])
    assert ((f.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def test_toxicity(spark, docs, labels):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randint(0, 80)}" for _ in range(12)) + ". " + ("you moron fool. " if i % 3 == 0 else "you kind soul. ") + " ".join(f"w{rng.randint(0, 80)}" for _ in range(12)) + ".") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = [r for r in toxicity.score_toxicity(d, lab).collect() if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in got]) > 0.97
    assert all(r.worst_sentence == 1 for r in got if r.predicted)
    found = toxicity.offending_sentences(d, toxicity.fit_toxicity(d, lab)).collect()
    assert found and all(r.text == "you moron fool" for r in found)
    assert len(toxicity.score_toxicity(docs, labels).collect()) == len(corpus())


def test_components(spark):
    from docstyle.llm.common import components

    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (95, 100), (95, 95)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(2, 41)) and got[100] == got[95] == 90


def plain_spans(rows):
    """By plain Python: sentences as the operator cuts them, spans as strings, the first of each in order kept."""
    text = {d: (t or "") for d, t in rows}
    cut, seen, gone = {}, {}, {}
    for d in sorted(text):
        w, _, first, _ = spans.sentences([text[d].encode()])
        first = first.tolist()
        all_words = [w.buf[a:b].tobytes() for a, b in zip(w.start, w.end)]
        cut[d] = [all_words[a:b] for a, b in zip(first, [*first[1:], len(all_words)])]
        gone[d] = [False] * len(cut[d])
        for i in range(len(cut[d])):
            for j in range(i + spans.SENTENCES, len(cut[d]) + 1):
                if sum(map(len, cut[d][i:j])) >= spans.WORDS:
                    key = tuple(map(tuple, cut[d][i:j]))
                    if seen.setdefault(key, (d, i)) != (d, i):
                        gone[d][i:j] = [True] * (j - i)
                    break
    return {d: (sum(g), sum(1 for k, x in enumerate(g) if x and not (k and g[k - 1])), [x for s, z in zip(cut[d], g) if not z for x in s]) for d, g in gone.items()}


def test_spans_against_plain_sentences(spark):
    rng = random.Random(8)
    bank = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(2, 14))) + rng.choice([".", "!", "?", ".\n"]) for _ in range(40)]
    rows = [(i, " ".join(bank[rng.randint(0, 39) : ][: rng.randint(1, 9)] + [f"Own {i} words {rng.random()}."] + rng.choices(bank, k=rng.randint(0, 12)))) for i in range(150)] + [(200, None), (201, ""), (202, " \n ")]
    got = {r.doc_id: r for r in spans.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = plain_spans(rows)
    assert any(n for n, _, _ in want.values())
    for d, (n, k, left) in want.items():
        assert (got[d].n_sentences, got[d].n_spans) == (n, k), d
        assert got[d].text.lower().encode().split() == left, d


def test_sharding_balance_and_reruns(spark):
    rng = random.Random(4)
    rows = [(i, "w" * rng.randint(0, 400)) for i in range(1200)] + [(5000 + i, "one text that many rows have") for i in range(600)]
    a, b = (sorted(map(tuple, sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect())) for n in (2, 5))
    assert a == b
    load = np.bincount([r[4] for r in a], weights=[r[1] for r in a], minlength=8)
    assert load.max() < 1.05 * load.mean() and load.min() > 0.95 * load.mean()


def test_flat_trees_against_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.random((500, 5)).astype(np.float32)
    f = trees.train(x, (x[:, 0] + x[:, 3] > 1).astype(float), trees=15)
    for row, score in zip(x[:100], f.score(x[:100])):
        z = f.base
        for at in f.roots:
            while f.child[at, 0] != at:
                at = f.child[at, int(row[f.feature[at]] > f.threshold[at])]
            z += f.value[at]
        assert score == pytest.approx(1 / (1 + np.exp(-z)))


def test_noisy_or_against_plain_sentences():
    words = ["bad", "worse", "kind"]
    keys = np.array([int(toxicity.terms([w.encode()])[1][0][0]) for w in words], dtype=np.uint64)
    order = np.argsort(keys)
    weight = dict(zip(words, (3.0, 5.0, -1.0)))
    m = toxicity.Model(keys[order], np.array([weight[words[i]] for i in order]), -4.0, 1.7)
    texts = ["Bad day. A kind man.", "worse and worse! bad\nfine", "", "nothing. here"]
    got = m.documents([t.encode() for t in texts])[0]
    for t, score in zip(texts, got):
        clean = 1.0
        for s in [s for s in re.split(r"[.!?\n]", t) if re.search(r"\w", s)] or [""]:
            z = sum(weight.get(w, 0) for w in re.findall(r"\w+", s.lower())) - 4.0
            clean *= (1 - 1 / (1 + np.exp(-z))) ** 1.7
        assert score == pytest.approx(1 - clean)


def test_broken_images_are_no_images():
    for data in (b"P5\n99999999999999 99999999999999\n255\nx", b"P5\n2 2\n0\nabcd", b"P2\n1 1\n70000\n1", b"P5\n100000 100000\n255\n", b"BM" + bytes(60), b"P3\n1 1\n255\n1 2"):
        assert media.decode(data) is None


def test_names_that_clash_and_parts_of_texts(spark):
    d = spark.createDataFrame([(i, f" a{i}  b\nc d\te ", f"s{i % 3}", 1, 2, 3, 4) for i in range(40)], "doc_id long, text string, source string, mix_id int, mix_shard int, salt int, rank int")
    out = mixing.mix(d)
    assert {"mix_id", "mix_shard", "salt", "rank"} <= set(out.columns) and {r.salt for r in out.collect()} == {3}
    for r in out.collect():
        assert f" a{r.doc_id}  b\nc d\te ".startswith(r.text)
    parts = packing.pieces(d).withColumn("salt", __import__("pyspark").sql.functions.lit(777))
    assert {r.salt for r in packing.pack(parts).collect()} == {777}
    twice = packing.pack(packing.pieces(d.unionAll(d)), copies=True).collect()
    assert sorted((r.doc_id, r.copy) for r in twice) == sorted((i, c) for i in range(40) for c in (0, 1))
    kept = jaccard.one_of_each(d.withColumnRenamed("rank", "kept_id"))
    assert "kept_id" in kept.columns
    rows = [(1, "a b c d e f g h", "x"), (1, "quite another text of the same id here", "x"), (1, "a b c d e f g h", "x"), (2, "a b c d e f g h", "x")]
    assert sorted(r.text for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n string")).collect()) == sorted({rows[0][1], rows[1][1]})
