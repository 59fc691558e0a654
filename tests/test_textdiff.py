"""Exact line diffs: against the table of a longest common subsequence, at sizes that no table holds, odd texts."""

import random
import time
import tracemalloc

import pytest

from quarrylens.operators import textdiff


def by_table(old, new):
    a, b = textdiff.lines_of(old), textdiff.lines_of(new)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    end_a, end_b = len(a) - tail, len(b) - tail
    middle = by_walk(a[head:end_a], b[head:end_b], head)
    return [(" ", k + 1, k + 1, a[k]) for k in range(head)] + middle + [(" ", end_a + k + 1, end_b + k + 1, a[end_a + k]) for k in range(tail)]


def by_walk(a, b, head):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append((" ", head + i + 1, head + j + 1, a[i]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append(("-", head + i + 1, 0, a[i]))
            i += 1
        else:
            out.append(("+", 0, head + j + 1, b[j]))
            j += 1
    return out


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"])
def test_same_as_the_table(letters):
    rnd = random.Random(len(letters))
    for _ in range(400):
        old = [rnd.choice(letters) for _ in range(rnd.randrange(40))]
        new = [rnd.choice(letters + "#") for _ in range(rnd.randrange(40))] if rnd.random() < 0.5 else [c for c in old if rnd.random() < 0.8] + ["x"] * rnd.randrange(3)
        assert textdiff.line_diff("\n".join(old), "\n".join(new)) == by_table("\n".join(old), "\n".join(new))


def test_frequent_lines_beyond_the_masks(monkeypatch):
    monkeypatch.setattr(textdiff, "MASKS", 40)
    rnd = random.Random(3)
    for _ in range(20):
        old, new = ("\n".join(rnd.choice(["", "", "x", "y", "z%d" % rnd.randrange(9)]) for _ in range(200)) for _ in range(2))
        assert textdiff.line_diff(old, new) == by_table(old, new)


def test_a_hundred_thousand_lines():
    """Far beyond a table (10^10 cells): deletions and insertions come out as they were made, in bounded memory."""
    rnd = random.Random(5)
    old = [f"line {k}" for k in range(100_000)]
    new, want = [], []
    for k, line in enumerate(old):
        if rnd.random() < 0.1:
            want.append(("-", line))
        else:
            new.append(line)
        if rnd.random() < 0.1:
            new.append(f"new {k}")
            want.append(("+", f"new {k}"))
    began = time.time()
    tracemalloc.start()
    found = textdiff.line_diff("\n".join(old), "\n".join(new))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    changed = [(op, text) for op, _, _, text in found if op != " "]
    assert sorted(changed) == sorted(want)
    assert [t for op, t in changed if op == "-"] == [t for op, t in want if op == "-"]
    assert peak < 400 << 20 and time.time() - began < 120
    kept = [(a, b) for op, a, b, _ in found if op == " "]
    assert kept == sorted(kept) and len(kept) == len(old) - sum(op == "-" for op, _ in want)


def test_repeated_lines_at_size():
    """20,000 lines of four kinds each: as long a common subsequence as rows of length alone give."""
    rnd = random.Random(6)
    old, new = ([rnd.choice("abcd") for _ in range(20_000)] for _ in range(2))
    kept = [(a, b) for op, a, b, _ in textdiff.line_diff("\n".join(old), "\n".join(new)) if op == " "]
    assert all(old[a - 1] == new[b - 1] for a, b in kept) and all(p < q and r < s for (p, r), (q, s) in zip(kept, kept[1:]))
    row, full = (1 << len(new)) - 1, (1 << len(new)) - 1
    masks = {c: sum(1 << k for k, d in enumerate(new) if d == c) for c in "abcd"}
    for c in old:
        hit = row & masks[c]
        row = (row + hit | row - hit) & full
    assert len(kept) == len(new) - row.bit_count()


def test_odd_texts():
    assert textdiff.line_diff(None, "") == [] == textdiff.line_diff("", None)
    assert textdiff.line_diff("a\r\nb\r\n", "a\nb") == [(" ", 1, 1, "a"), (" ", 2, 2, "b")]
    assert textdiff.line_diff("", "a") == [("+", 0, 1, "a")]
    assert textdiff.line_diff("a\n\n", None) == [("-", 1, 0, "a"), ("-", 2, 0, "")]
    assert textdiff.line_diff("a\nb", "b\na") == [("-", 1, 0, "a"), (" ", 2, 1, "b"), ("+", 0, 2, "a")]
