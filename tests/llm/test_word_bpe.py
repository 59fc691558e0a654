"""Operator 13 against the tokenizers library: given texts, noise, every character, long pre-tokens, odd input."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import word_bpe
from quarrylens.llm.common import table

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, ids string, decoded string, n_tokens long"


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def encoder(path):
    return word_bpe.Encoder(word_bpe.compiled(path))


def same(encoder, library, texts):
    ids, sizes = encoder.encode(texts)
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, ends - sizes, ends):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want, text
        assert encoder.decode(ids[a:b]) == library.decode(want, skip_special_tokens=False)


def test_noise(encoder, library):
    rnd = random.Random(3)
    signs = [*"abst rdvlemd'''  \n\t!?1234éßÇ漢字🙂 　▁<>İΣσ̧́각각ﬁΩक़̈\u0085\x1c\x00½²", "<|endoftext|>", "<|startoftext|>", "'re", "'LL", "the ", "ing"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(80))) for _ in range(1500)] + ["", "", "<|endoftext|>"]
    for at in range(0, len(texts), 50):
        same(encoder, library, texts[at : at + 50])


def test_every_character(encoder, library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, 0x30000, 4000):
        same(encoder, library, [f"X{c}y'S" for c in every[at : at + 4000]])


def test_long_pre_tokens(encoder, library):
    rnd = random.Random(5)
    for n in (1, 2, 3, 31, 32, 33, 34, 35, 64, 65, 66, 700):
        same(encoder, library, ["".join(rnd.choice("etain") for _ in range(n)), "a" * n, "!" * n])
    same(encoder, library, ["ab" * 20000, ("é " * 40000), "=-" * 9000])


def test_one_tree_as_many(encoder):
    """The trees in lockstep and the tree of one pre-token give the same."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("theindao") for _ in range(rnd.randrange(2, 33))).encode() for _ in range(400)]
    assert encoder.merged(words) == [word_bpe.merge_long(encoder.m, w).astype("<u4").tobytes() for w in words]


def test_cache_is_bounded(path, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "CACHE", 200)
    small = word_bpe.Encoder(word_bpe.compiled(path))
    rnd = random.Random(9)
    for _ in range(30):
        same(small, library, [" ".join("".join(rnd.choice("abcde") for _ in range(4)) for _ in range(30))])
        assert sum(map(len, small.young)) < 200 + 4 * 30 + 1


def test_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in table(spark, DATA, "documents").collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = word_bpe.op13_word_bpe(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(" ".join(map(str, ids))))
        assert r.decoded_sha256 == digest(library.decode(ids, skip_special_tokens=False))


def test_odd(spark, path, library):
    rows = [(1, "Same", "a", "b", 1), (1, "Same", "a", "b", 1), (2, None, None, None, None), (3, "", "", "", 0), (None, "no id <|endoftext|>", "x", "y", 2), (4, " \n\t", None, None, None), (5, "Wort " * 40000, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    both = word_bpe.word_bpe_decode(word_bpe.word_bpe_encode(df, path), path)
    assert both.columns == ["doc_id", "ids", "decoded"]
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in both.collect()) == sorted(want)
    assert word_bpe.word_bpe_decode(word_bpe.word_bpe_encode(df.limit(0), path), path).count() == 0
    ids = spark.createDataFrame([(None, "clash"), ([], "x"), ([0, None, 99999999, -5], "y")], "ids array<int>, DECODED string")
    assert {r.decoded for r in word_bpe.word_bpe_decode(ids, path).select(F.col("decoded")).collect()} == {None, "", library.id_to_token(0)}
