"""Operator 11 against its definition: small tiles, dictionaries by broadcast and by join, odd input."""

import collections
import random
import re

import pytest

from quarrylens.llm import collocations

DOCS = "doc_id long, text string, lang string, rank long, words string, part long, n string"


def by_definition(docs, least=30, longest=4, top=2000, share=80):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = tuple(re.findall("[^ \t]+", piece))
            n[lang] += len(w)
            f.update((lang, w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    frequent = {k: v for k, v in f.items() if v >= least}
    rows = collections.defaultdict(list)
    for (lang, w), a in frequent.items():
        if len(w) < 2:
            continue
        longer = (v for (g, x), v in frequent.items() if g == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x))))
        if any(100 * v >= share * a for v in longer):
            continue
        score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        rows[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(str((lang, r, p.decode(), -a, l_, r_, n[lang], -s)) for lang, found in rows.items() for r, (s, a, p, l_, r_) in enumerate(sorted(found)[:top], 1))


def rows(df):
    return sorted(str((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score)) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(13)
    words = ["A", "b", "é", "漢字", "ç x", "\x1c"] + ["w%d" % i for i in range(40)]
    weights = [1 / (i + 1) for i in range(len(words))]
    sentence = lambda: rnd.choice(["fixed phrase of four", "fixed phrase", " ".join(rnd.choices(words, weights, k=rnd.randrange(9)))])
    return [(rnd.choice([" ", ", ", ".\n", "\t\t"]).join(sentence() for _ in range(rnd.randrange(12))), rnd.choice(["en", "en", "en", "de", None])) for _ in range(500)]


@pytest.mark.parametrize("broadcast", [1 << 25, 0, 3000])
@pytest.mark.parametrize("small", [False, True])
def test_by_definition(spark, monkeypatch, texts, broadcast, small):
    monkeypatch.setattr(collocations, "BROADCAST", broadcast)
    if small:
        for name, value in (("PART_BYTES", 700), ("TILE", 4), ("DENSE", 2), ("SPARSE", 3), ("FRESH", 40), ("HELD", 30)):
            monkeypatch.setattr(collocations, name, value)
    df = spark.createDataFrame(texts, "text string, lang string").repartition(3)
    assert rows(collocations.collocations(df, least=8, top=25)) == by_definition(texts, least=8, top=25)


def test_odd(spark):
    same = (1, "Same words here. Same words here!", "en", 1, "x", 1, "y")
    docs = [same] * 40 + [(2, None, None, None, None, None, None), (3, "", "en", None, None, None, None), (None, "a b " * 20, None, None, None, None, None), (4, " \t\n.,", "de", None, None, None, None), (5, "long wort " * 60000, "de", None, None, None, None), (6, "a b " * 20, "und", None, None, None, None)]
    df = spark.createDataFrame(docs, DOCS)
    assert rows(collocations.collocations(df)) == by_definition([(d[1], d[2]) for d in docs])
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.where("doc_id = 2")).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_products_beyond_64_bits(spark):
    n = 6_000_000_000_000
    found = spark.createDataFrame([("en", ["a", "b"], n)], "lang string, words array<string>, f long")
    longer = spark.createDataFrame([("en", ["a", "b", "c"], n // 5 * 4)], "lang string, words array<string>, f long")
    single = spark.createDataFrame([("en", "a", n), ("en", "b", n + 7), ("en", "c", n)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", 3 * n)], "lang string, n long")
    got = collocations._ranked([found, longer], single, totals, 10, 80).collect()
    a = n // 5 * 4
    assert [(r.phrase, r.score, r.l, r.r) for r in got] == [("a b c", 2000000 * a // (n + n), n, n)]
