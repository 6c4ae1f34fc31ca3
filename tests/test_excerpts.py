"""Excerpts by one pass over words against segments() and sample()."""

import hashlib

import numpy as np

from docstyle.operators import corpus


def test_excerpts_equal_those_of_segments(spark):
    rng = np.random.default_rng(11)
    text = lambda n: " ".join(f"w{i}" + ("." if rng.random() < 0.1 else ".”" if rng.random() < 0.02 else "") for i in range(n))
    rows = [(i, text(n), f"k{i}") for i, n in enumerate([0, 39, 40, 41, 200, 777, 1500, 90])] + [(90, None, "x"), (91, "no end " * 200, None), (None, text(300), "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string").coalesce(1)
    df = corpus.excerpts(docs, 3, 40, 60, seed=4, keep=["tag"])
    want = []
    for r in corpus.segments(docs, 3, 40, keep=["tag"]).collect():
        g = np.random.default_rng(int.from_bytes(hashlib.blake2b(f"4:{r.id}".encode(), digest_size=8).digest(), "big"))
        goal = int(g.integers(40, 61))
        if got := corpus.sample(r.words, 40, 60, g):
            want.append((r.id, r.doc_id, r.chunk_idx, goal, len(got), " ".join(got), r.tag))
    assert len(want) > 9 and sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.collect())
    # texts are split into words once, not once more for a filter, and rows are not multiplied on the way to Python
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Generate" not in plan
