"""Operator 12 against scores by definition: random tables with many ties, small blocks, several groups of items, odd input."""

import collections
import math
import random
import re

import pytest

from quarrylens.llm import lexical_search

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
DOCS = "doc_id long, text string, score double, rank int, item string, n long"


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def by_definition(docs, items, k):
    held = [(i, collections.Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scores = []
        for doc, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


def rows(df):
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


@pytest.mark.parametrize("block,item_bytes", [(1 << 16, 1 << 24), (7, 1 << 24), (50, 600)])
def test_by_definition(spark, monkeypatch, block, item_bytes):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", item_bytes)
    rnd = random.Random(11)
    words = ["w%d" % int(rnd.paretovariate(0.6)) for _ in range(4000)]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 2, 5, 40, 200])))) for i in range(400)]
    docs += [(1000 + i, docs[i % 5][1]) for i in range(200)]  # many ties
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 3, 30])))) for i in range(25)]
    got = lexical_search.lexical_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id int, text string"), k=7)
    assert rows(got) == by_definition(docs, items, 7)


def test_accumulators_are_limited():
    """Once a new document cannot reach the k-th partial score, it gets no accumulator."""
    import numpy as np

    made = []

    class Watched(np.ndarray):
        def __setitem__(self, at, value):
            made.extend(np.atleast_1d(at).tolist() if np.any(value) else [])
            super().__setitem__(at, value)

    real = np.zeros
    n = 1000
    docs = np.concatenate([np.arange(5), np.arange(n)])
    shares = np.concatenate([np.full(5, 100), np.full(n, 3)])
    try:
        np.zeros = lambda *a, **k: real(*a, **k).view(Watched)
        found = list(lexical_search.best_of_block([(0, np.array([0, 1]), np.array([1, 1]))], np.array([0, 5, 5 + n]), docs, shares, np.array([100, 3]), np.array([5, n]), np.arange(n), 5, {}))
    finally:
        np.zeros = real
    assert set(made) == set(range(5))
    assert found[0][2].tolist() == [103] * 5


def test_odd(spark):
    docs = [(1, "Same words, same WORDS", 1.0, 1, "x", 1)] * 2 + [(2, None, None, None, None, None), (3, "", None, None, None, None), (None, "words", None, None, None, None), (4, " \n.,", None, None, None, None), (5, "long " * 60000 + "words é漢", None, None, None, None), (6, "Éé 漢字 x1_y2", None, None, None, None)]
    items = [(0, "words SAME", "a"), (0, "words SAME", "b"), (1, None, None), (2, "", None), (3, "?!", None), (4, "é漢 x1 é漢", None), (5, "nowhere", None), (None, "words", None), (0, "long", None)]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string, doc_id string")
    got = lexical_search.lexical_search(d, i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got) == by_definition([(r[0], r[1]) for r in docs], [(r[0], r[1]) for r in items], 20)
    assert lexical_search.lexical_search(d.limit(0), i).count() == 0
    assert lexical_search.lexical_search(d, i.limit(0)).count() == 0
