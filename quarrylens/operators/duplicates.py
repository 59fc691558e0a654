"""Duplicate blocks across texts: windows of equal normalised lines, merged to maximal blocks against the earliest site.

A window is `size` consecutive non-blank lines. Lines are hashed once by Spark; sums of the hashes times powers of a base
run through all lines of a batch, so that a window's hash is a difference of two sums, whatever its size. A window has four
residues modulo primes below 2^31: two make the key, two more are compared where keys are equal. Windows are grouped by
key to their earliest site (pre-aggregated); only windows that occur more than once are joined back, in a plain shuffled
join that Spark's adaptive skew join splits where one window is very common. Consecutive hits on the same earlier site
are merged by gaps and islands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Primes below 2^31 with a base each.
MODULI = ((2147483647, 1103515245), (2147483629, 747796405), (2147483587, 1664525), (2147483579, 69069))
#: Fixed values of FNV-1a for 64 bits.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def java_hash(text: Column) -> Column:
    """The 32-bit hash h = 31 h + unit over a text's UTF-16 units, as an int."""
    low = F.lit(0xFFFFFFFF)
    unit = lambda h, u: (h * 31 + u).bitwiseAND(low)
    point = lambda c: F.ascii(c).cast("long")

    def step(h: Column, c: Column) -> Column:
        beyond = point(c) - 0x10000
        return F.when(point(c) < 0x10000, unit(h, point(c))).otherwise(unit(unit(h, F.shiftright(beyond, 10) + 0xD800), beyond.bitwiseAND(0x3FF) + 0xDC00))

    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("long"), step, lambda h: F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int"))


def fnv1a(hashes: Column) -> Column:
    """The FNV-1a fold of 32-bit hashes to 64 bits, as a long: (x xor h) * prime, wrapped.

    The product is made of halves of 32 bits, as the prime is 2^40 + 0x1b3; nothing overflows a long on the way."""
    low = F.lit(0xFFFFFFFF)

    def step(x: Column, h: Column) -> Column:
        x = x.bitwiseXOR(h.cast("long"))
        right = x.bitwiseAND(low)
        product = right * (FNV_PRIME & 0xFFFF)
        left = F.shiftrightunsigned(x, 32) * (FNV_PRIME & 0xFFFF) + F.shiftright(product, 32) + F.shiftleft(right, 8)
        return F.shiftleft(left.bitwiseAND(low), 32).bitwiseOR(product.bitwiseAND(low))

    return F.aggregate(hashes, F.lit(FNV_OFFSET - (1 << 64)).cast("long"), step)


def normal_lines(text: Column) -> Column:
    """A text's lines with white space made one space and trimmed, blank ones left out."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    out, step = np.ones(1, np.int64), base
    while len(out) < n:
        out = np.concatenate([out, out * step % modulus])
        step = step * step % modulus
    return out[:n]


def window_hashes(lines: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The places where a window of `size` lines begins, and its residues. lines: 64-bit hashes of all texts' lines; ends: where each text ends."""
    last = np.repeat(ends, np.diff(ends, prepend=0))  # of each line: where its text ends
    starts = np.flatnonzero(np.arange(len(lines)) + size <= last)
    residues = []
    for modulus, base in MODULI:
        sums = np.concatenate([[0], np.cumsum((lines % np.uint64(modulus)).astype(np.int64) * _powers(base, modulus, len(lines)) % modulus)])
        back = _powers(pow(base, -1, modulus), modulus, len(lines))
        residues.append((sums[starts + size] - sums[starts]) % modulus * back[starts] % modulus)
    return starts, residues


def windows(corpus: DataFrame, size: int) -> DataFrame:
    """path, at (from 0, among non-blank lines), h and g (hashes of the normalised lines) of every window."""
    kind = corpus.schema["path"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            begins = np.concatenate([[0], ends[:-1]])
            lines = lists.flatten().to_numpy().view(np.uint64)
            if not len(lines):
                continue
            starts, (a, b, c, d) = window_hashes(lines, ends, size)
            row = np.searchsorted(ends, starts, "right")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array((starts - begins[row]).astype(np.int32)), pa.array(a << 31 | b), pa.array(c << 31 | d)], ["path", "at", "h", "g"])

    rows = corpus.where("text is not null").select("path", F.transform(normal_lines(F.col("text")), lambda x: F.xxhash64(x)).alias("l"))
    return rows.mapInArrow(run, f"path {kind}, at int, h long, g long")


def duplicate_blocks(corpus: DataFrame, size: int = 3) -> DataFrame:
    """path, first_at, lines, of_path, of_at: runs of lines that stand earlier in another text (texts in order of path)."""
    hashed = windows(corpus, size)
    first = hashed.groupBy("h").agg(F.min(F.struct("path", "at", "g")).alias("first"), F.count("*").alias("n")).where("n > 1")
    hits = hashed.join(first, "h").where("path <> first.path and g = first.g").select("path", "at", F.col("first.path").alias("of_path"), F.col("first.at").alias("of_at"))
    w = Window.partitionBy("path", "of_path", "line").orderBy("at")
    islands = hits.withColumn("line", F.col("of_at") - F.col("at")).withColumn("island", F.col("at") - F.row_number().over(w))
    runs = islands.groupBy("path", "of_path", "line", "island").agg(F.min("at").alias("first_at"), F.count("*").alias("n"), F.min("of_at").alias("of_at"))
    return runs.select("path", "first_at", (F.col("n") + size - 1).alias("lines"), "of_path", "of_at")


def reportable(blocks: DataFrame, changed: DataFrame) -> DataFrame:
    """The blocks that concern changed texts (path): as they are if the later site is changed, turned round if only the earlier one is; others are left out.

    blocks come from all texts, so an unchanged one can still be the earlier site."""
    paths = changed.select("path").distinct()
    later = blocks.join(paths, "path", "left_semi")
    earlier = blocks.join(paths, "path", "left_anti").join(paths.withColumnRenamed("path", "of_path"), "of_path", "left_semi")
    return later.select("path", "first_at", "lines", "of_path", "of_at").union(earlier.select(F.col("of_path"), F.col("of_at"), "lines", F.col("path"), F.col("first_at")))
