"""Line diffs of text pairs, exact at any size: a longest common subsequence of lines, deletions before insertions.

Let L(i, j) be the length of the longest common subsequence of the old lines from i on and the new ones from j on. A row
of L falls by 0 or 1 from each j to the next, so a row is a whole number of one bit for each new line, and the next row
follows from it by an addition and three bit operations (bit-parallel dynamic programming). Rows are made from the last
old line to the first; only every STEP-th is kept, and those between are made again when the walk from the beginning
gets there. n old and m new lines take some n m / 32 bit operations of words and 2 m sqrt(n) bits of memory.

Equal lines at the beginning and end are set aside first. An old line that no new one equals is deleted as soon as the
walk reaches it, whatever else there is, so such lines take no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Changed lines handed on at once, and bytes of masks of frequent lines that are kept.
ROWS = 20_000
MASKS = 1 << 26


def lines_of(text: str | None) -> list[str]:
    """The lines of a text: CR LF ends a line as LF does, the end of the last line begins no other, an empty text has none."""
    if not text:
        return []
    return text.replace("\r\n", "\n").removesuffix("\n").split("\n")


class _Rows:
    """The rows of L for old lines x and new lines y as whole numbers: bit k of row i is 0 if L(i, j) = L(i, j + 1) + 1, j = m - 1 - k."""

    def __init__(self, x: list[str], y: list[str]):
        self.x, self.m = x, len(y)
        self.full = (1 << self.m) - 1
        self.places: dict[str, list[int]] = {}
        for j, line in enumerate(y):
            self.places.setdefault(line, []).append(self.m - 1 - j)
        self.kept: dict[str, int] = {}
        self.most = MASKS // (self.m // 8 + 32)
        self.step = max(1, isqrt(len(x)))
        row, self.marks = self.full, {len(x): self.full}
        for i in range(len(x) - 1, -1, -1):
            row = self.before(row, x[i])
            if i % self.step == 0:
                self.marks[i] = row
        self.block: dict[int, int] = {}

    def mask(self, line: str) -> int:
        """The bits of the new lines that are equal to a line."""
        places = self.places[line]
        if len(places) < 8:
            return sum(1 << k for k in places)
        found = self.kept.get(line)
        if found is None:
            bits = bytearray(self.m // 8 + 1)
            for k in places:
                bits[k >> 3] |= 1 << (k & 7)
            found = int.from_bytes(bits, "little")
            if len(self.kept) < self.most:
                self.kept[line] = found
        return found

    def before(self, row: int, line: str) -> int:
        hit = row & self.mask(line)
        return (row + hit | row - hit) & self.full

    def row(self, i: int) -> int:
        """Row i, made again from the next kept one together with those of its block."""
        if i in self.marks:
            return self.marks[i]
        if i not in self.block:
            top = min(-(-i // self.step) * self.step, len(self.x))
            row, self.block = self.marks[top], {}
            for k in range(top - 1, i - i % self.step, -1):
                row = self.before(row, self.x[k])
                self.block[k] = row
        return self.block[i]


def line_diff(old: str | None, new: str | None) -> list[tuple[str, int, int, str]]:
    """(op, old line, new line, text) with op ' ', '-' or '+', 0 for no line."""
    a, b = lines_of(old), lines_of(new)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    y = b[head : len(b) - tail]
    known = set(y)
    shared = [i for i in range(head, len(a) - tail) if a[i] in known]
    rows = _Rows([a[i] for i in shared], y)
    out = [(" ", k + 1, k + 1, a[k]) for k in range(head)]
    at, j, m = head, 0, len(y)

    def delete(until: int) -> None:
        nonlocal at
        out.extend(("-", k + 1, 0, a[k]) for k in range(at, until))
        at = until

    for i, place in enumerate(shared):
        delete(place)
        if j == m or y[j] != a[place]:
            ahead = (1 << m - j) - 1  # the bits of the new lines from j on
            if (rows.row(i) & ahead).bit_count() == (rows.row(i + 1) & ahead).bit_count():
                continue  # L(i, j) = L(i + 1, j): the old line can go without loss
            while y[j] != a[place]:  # else it has to stay, so all up to its equal is new
                out.append(("+", 0, head + j + 1, y[j]))
                j += 1
        out.append((" ", place + 1, head + j + 1, y[j]))
        at, j = place + 1, j + 1
    delete(len(a) - tail)
    out.extend(("+", 0, head + k + 1, y[k]) for k in range(j, m))
    return out + [(" ", len(a) - k, len(b) - k, a[len(a) - 1 - k]) for k in range(tail - 1, -1, -1)]


def diff_pairs(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """key, op, old_line, new_line, text of every changed line of each pair."""
    kind = pairs.schema[key].dataType.simpleString()

    names = ["key", "op", "old_line", "new_line", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, (x, y) in enumerate(zip(batch.column(1), batch.column(2))):
                changed = [r for r in line_diff(x.as_py(), y.as_py()) if r[0] != " "]
                at += [k] * len(changed)
                rows += changed
                if len(rows) > ROWS or k == batch.num_rows - 1 and rows:
                    ops, old_lines, new_lines, texts = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(ops), pa.array(old_lines, pa.int32()), pa.array(new_lines, pa.int32()), pa.array(texts)], names)
                    at, rows = [], []

    return pairs.select(F.col(key).alias("key"), F.col(old), F.col(new)).mapInArrow(run, f"key {kind}, op string, old_line int, new_line int, text string").withColumnRenamed("key", key)
