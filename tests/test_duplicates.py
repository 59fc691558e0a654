"""Hashes of blocks: known values of the folds, windows against blocks of lines, the same time at any size."""

import collections
import random
import time

import numpy as np
from pyspark.sql import functions as F

from quarrylens.operators import duplicates


def java_hash(s):
    raw, h = s.encode("utf-16-be"), 0
    for k in range(0, len(raw), 2):
        h = (h * 31 + int.from_bytes(raw[k : k + 2], "big")) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def fold(hashes):
    x = 0xCBF29CE484222325
    for h in hashes:
        x = (x ^ (h & 0xFFFFFFFFFFFFFFFF)) * 0x100000001B3 % (1 << 64)
    return x - (1 << 64) if x >> 63 else x


def test_known_values(spark):
    texts = ["", "a", "hello", "The quick brown fox", "한글 줄", "🙂x𐍈", "\x7f\u0080￿", "z" * 300]
    assert (java_hash("hello"), java_hash("polygenelubricants")) == (99162322, -2147483648)
    got = spark.createDataFrame([(t,) for t in [*texts, "polygenelubricants", "hello"]], "t string").select("t", duplicates.java_hash(F.col("t")).alias("h"))
    assert all(r.h == java_hash(r.t) for r in got.collect())
    rnd = random.Random(4)
    lists = [[], [0], [97], [-1, 2147483647, -2147483648]] + [[rnd.randrange(-(2**31), 2**31) for _ in range(rnd.randrange(40))] for _ in range(50)]
    got = spark.createDataFrame([(x,) for x in lists], "l array<int>").select("l", duplicates.fnv1a(F.col("l")).alias("h"))
    assert all(r.h == fold(r.l) for r in got.collect())
    assert fold([97]) == 0xAF63DC4C8601EC8C - (1 << 64)  # FNV-1a of the letter a


def test_windows_are_blocks(spark):
    rnd = random.Random(8)
    docs = [(str(i), "\n".join(rnd.choice(["a", " b", "", "a  b", "c" * 50]) for _ in range(rnd.randrange(30)))) for i in range(60)] + [("n", None), ("e", ""), ("one", "x")]
    for size in (1, 2, 3, 7):
        got = duplicates.windows(spark.createDataFrame(docs, "path string, text string").repartition(3), size).collect()
        want = {}
        for path, text in docs:
            lines = [" ".join(x.split()) for x in (text or "").split("\n") if x.strip()]
            want |= {(path, k): tuple(lines[k : k + size]) for k in range(len(lines) - size + 1)}
        assert {(r.path, r.at) for r in got} == set(want)
        by_hash, by_block = collections.defaultdict(set), collections.defaultdict(set)
        for r in got:
            by_hash[r.h].add(want[r.path, r.at])
            by_block[want[r.path, r.at]].add((r.h, r.g))
        assert all(len(v) == 1 for v in by_hash.values()) and all(len(v) == 1 for v in by_block.values())


def test_size_costs_nothing():
    lines = np.random.default_rng(1).integers(0, 1 << 63, 500_000).astype(np.uint64)
    ends = np.arange(500, 500_001, 500)
    took = {}
    for size in (3, 30, 3, 30):
        began = time.process_time()
        duplicates.window_hashes(lines, ends, size)
        took[size] = min(took.get(size, 99), time.process_time() - began)
    assert took[30] < 1.5 * took[3]
