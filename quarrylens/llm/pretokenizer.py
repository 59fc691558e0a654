"""The byte-level pre-tokenizer as a compiled finite-state transducer.

The pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+` is compiled into
a deterministic transducer of eight states over ten symbols. A symbol is a character's class with what the
pattern may look ahead to: whether white space is followed by non-space, and how long a contraction begins at an
apostrophe. A transition carries one bit: a pre-token begins here.

A text is cut into chunks of CHUNK symbols. All chunks advance in lockstep from all eight states, giving each
chunk's state map (a number in the transducer's transition monoid, so a step is one table look-up); the maps are
composed by a parallel prefix scan; then each chunk runs once from its now known state to give its bits. Texts are joined with a RESET symbol between them, so that one run serves many texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

L, N, O, SPACE, WHITE, APOS, RESET = range(7)
#: Symbols: 0 RESET, 1 letter, 2 number, 3 other, 4 and 5 apostrophe with one or two letters of a contraction,
#: 6 and 7 a space before white space or the end, or before a non-space; 8 and 9 the same for other white space.
START, LETTERS, NUMBERS, OTHERS, PENDING, WHITES, ONE_MORE, TWO_MORE = range(8)
CHUNK = 128
SENTINEL = 0x110000


def _machine() -> tuple[np.ndarray, np.ndarray]:
    go = np.zeros((10, 8), np.uint8)
    cut = np.ones((10, 8), np.uint8)
    for s in range(8):
        for sym, run in ((1, LETTERS), (2, NUMBERS), (3, OTHERS)):
            go[sym, s] = run
            cut[sym, s] = s not in (run, PENDING)
        for sym, left in ((4, ONE_MORE), (5, TWO_MORE)):
            joins = s in (OTHERS, PENDING)  # the apostrophe goes on a run of other signs
            go[sym, s] = OTHERS if joins else left
            cut[sym, s] = not joins
        for sym in (6, 8):
            go[sym, s] = WHITES
            cut[sym, s] = s != WHITES
        go[7, s], go[9, s] = PENDING, START
    for s, then in ((ONE_MORE, START), (TWO_MORE, ONE_MORE)):
        go[1:, s], cut[1:, s] = then, 0
    go[0], cut[0] = START, 1
    return go, cut


def _monoid(go: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The state maps that any run of symbols can give, numbered (0 is the identity): each followed by a symbol, each
    followed by another, and where each leads from START."""
    maps = [tuple(range(8))]
    number = {maps[0]: 0}
    step = []
    for m in maps:  # grows while it is read
        row = []
        for sym in range(10):
            then = tuple(int(go[sym, s]) for s in m)
            if then not in number:
                number[then] = len(maps)
                maps.append(then)
            row.append(number[then])
        step.append(row)
    product = [[number[tuple(b[s] for s in a)] for b in maps] for a in maps]
    return np.array(step), np.array(product), np.array([m[START] for m in maps])


GO, CUT = _machine()
STEP, PRODUCT, FROM_START = _monoid(GO)


def compile_classes(tokenizer) -> np.ndarray:
    """Each code point's class as the tokenizers library itself has it (its Unicode tables decide), by probing its pre-tokenizer."""
    import regex

    split = tokenizer.pre_tokenizer.pre_tokenize_str
    table = np.full(SENTINEL + 1, O, np.uint8)

    def probe(c: str) -> int:
        return next((k for k, before in ((L, "a"), (N, "1"), (O, "!")) if len(split(before + c)) == 1), WHITE)

    every = "".join(map(chr, (c for c in range(SENTINEL) if not 0xD800 <= c <= 0xDFFF and c not in (0x20, 0x27))))
    for pattern in (r"\p{L}", r"\p{N}", r"\s", r"[^\s\p{L}\p{N}]"):
        alike = "".join(regex.findall(pattern, every))
        for _, (a, b) in split(alike):  # a piece is of one class
            table[np.frombuffer(alike[a:b].encode("utf-32-le"), np.uint32)] = probe(alike[a])
    table[0x20], table[0x27], table[SENTINEL] = SPACE, APOS, RESET
    return table


def _symbols(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    cls = classes[points]
    sym = np.array([1, 2, 3, 6, 8, 3, 0], np.uint8)[cls]
    following = np.append(cls[1:], np.uint8(RESET))
    before_text = (following != SPACE) & (following != WHITE) & (following != RESET)
    sym += ((cls == SPACE) | (cls == WHITE)) & before_text
    at = np.flatnonzero(cls == APOS)
    if at.size:
        padded = np.concatenate([points, np.array([SENTINEL, SENTINEL], points.dtype)])
        a, b = padded[at + 1], padded[at + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        sym[at] = np.where(one, 4, np.where(two, 5, 3))
    return sym


def _cuts(sym: np.ndarray) -> np.ndarray:
    """The transducer's bit for each symbol, by chunk state maps and a prefix scan of them."""
    n = len(sym)
    k = -(-n // CHUNK)
    lanes = np.zeros(k * CHUNK, np.uint8)
    lanes[:n] = sym
    rows = np.ascontiguousarray(lanes.reshape(k, CHUNK).T).astype(np.intp)
    step, product, n_maps = STEP.ravel(), PRODUCT.ravel(), len(PRODUCT)
    maps = np.zeros(k, np.intp)
    for row in rows:
        maps = step[maps * 10 + row]
    ahead = 1
    while ahead < k:  # Hillis-Steele scan: after it, maps[i] is the composition of chunks 0..i
        maps = np.concatenate([maps[:ahead], product[maps[:-ahead] * n_maps + maps[ahead:]]])
        ahead *= 2
    go, cut = GO.ravel().astype(np.intp), CUT.ravel()
    state = np.concatenate([[START], FROM_START[maps[:-1]]])
    out = np.empty((CHUNK, k), np.uint8)
    for j, row in enumerate(rows):
        at = row * 8 + state
        out[j] = cut[at]
        state = go[at]
    return out.T.ravel()[:n]


def split_texts(texts: list[str], classes: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pre-tokens, the pre-tokens of all texts in order as places among them, and how many each text has."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
    if not len(points):
        return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1  # where the joiner after each text stands
    joiners = ends[:-1]
    after = np.ones(len(points), np.uint8)  # UTF-8 bytes of each code point
    for least in (0x80, 0x800, 0x10000):
        after += points >= least
    after = np.cumsum(after, dtype=np.int64)
    points[joiners] = SENTINEL
    cuts = np.flatnonzero(_cuts(_symbols(points, classes)))
    places = np.append(np.where(cuts > 0, after[cuts - 1], 0), after[-1])
    pieces = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(places), pa.py_buffer(joined.encode())).dictionary_encode()
    keep = points[cuts] != SENTINEL
    index = pieces.indices.to_numpy()[keep].astype(np.int64)
    return pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), index, np.diff(np.searchsorted(cuts[keep], ends), prepend=0)
