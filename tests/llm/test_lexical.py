"""Ranked search against plain scoring of every document."""

import math
import random
import re

import numpy as np
import pytest
from pulseloom.llm import lexical

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, w) for i, w in own if w]
    n, total = len(own), sum(len(w) for _, w in own)
    df = {}
    for _, w in own:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        ranked = []
        for doc, w in own:
            m = 100 - 25 + (25 * len(w) * n) // total
            score = 0
            for t in terms(text):
                if t in w:
                    tf = w.count(t)
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                ranked.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(ranked, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def run(spark, docs, items):
    index = lexical.build_index(spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, m int, term string"))
    found = lexical.search(index, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int"))
    return sorted((tuple(r) for r in found.collect()), key=str)


WORDS = ["a", "b", "Der", "tür", "x1", "ÉTÉ", "the", "of", "and"] + [f"w{i}" for i in range(60)]


def corpus(seed, size):
    rng = random.Random(seed)
    pick = lambda n: " ".join(rng.choice(WORDS[:9]) if rng.random() < 0.6 else rng.choice(WORDS) for _ in range(n))
    docs = [(i, pick(rng.choice([1, 3, 8, 8, 30, 200]))) for i in range(size)]
    docs += [(i, docs[3][1]) for i in range(size, size + 30)]  # ties beyond the twentieth place
    return docs, [(i, pick(rng.choice([1, 4, 12]))) for i in range(12)]


@pytest.mark.parametrize("small", [False, True])
def test_against_every_document(spark, monkeypatch, small):
    docs, items = corpus(3, 300)
    docs += [(5, "the tür x1"), (5, "other, w7 w8"), (None, docs[3][1]), (None, None), (600, ""), (601, " .,! "), (602, "a" * 100_000 + " tür")]
    items += [(3, "w1 w2 w1 w1"), (3, "w5"), (None, "tür TÜR tuer"), (77, None), (78, "never seen"), (79, ". !")]
    if small:  # many blocks and passes, and a pilot that ends at once
        for name, value in (("BLOCK_DOCS", 7), ("QUERY_ITEMS", 5), ("PILOT_DOCS", 1), ("EXPAND", 64), ("SMALL_ROWS", 0)):
            monkeypatch.setattr(lexical, name, value)
    assert run(spark, docs, items) == brute(docs, items)


def test_empty(spark):
    assert run(spark, [(1, "a b")], []) == []
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, None), (2, ", ;")], [(1, "a")]) == []


def test_threshold_leaves_out_nothing():
    """A block ranked with the true last score as threshold gives what it gives without one."""
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"t{x}" for x in rng.zipf(1.5, 60) % 40)) for i in range(400)]
    import pyarrow as pa

    bags = [lexical.counted(t) for _, t in docs]
    block = pa.table({"m": [100] * 400, "block": [0] * 400, "doc_id": [i for i, _ in docs], "terms": [b" ".join(b) for b in bags],
                      "tfs": [np.fromiter(b.values(), np.uint32, len(b)).tobytes() for b in bags]})
    post = lexical.block_postings(block)
    names = sorted({t for t in post["term"].to_pylist() if t is not None})
    t = [lexical.NOWHERE if x is None else names.index(x) for x in post["term"].to_pylist()]
    post = post.append_column("t", pa.array(t, pa.int64()))
    q = lexical.Queries(np.repeat(np.arange(3), 8), np.tile(np.arange(8), 3) * np.repeat([1, 2, 3], 8), np.tile(np.arange(1, 9) ** 3, 3), 3)
    free = lexical.rank_block(post, q, np.ones(3, np.int64), 20).to_pydict()
    last = np.array([min(s for i, s in zip(free["item"], free["score"]) if i == j) for j in range(3)])
    assert lexical.rank_block(post, q, last, 20).to_pydict() == free
    assert len(free["item"]) == 60
