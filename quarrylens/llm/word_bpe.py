"""Operator 13, BPE encoding and decoding: a segment tree over the ranks of adjacent pairs.

A pre-token's bytes are its first symbols; the last carries the word end. The leaves of a segment tree hold, for each
symbol, the rank of the merge that it and its right neighbour allow, with its place, so that the root is the leftmost
pair of the lowest rank. A merge renews three leaves (the pair's own, the one that goes, the one before) and their
ancestors, so it costs a logarithm of the length; when the root holds no rank, the symbols left are the tokens. Short
pre-tokens advance in lockstep as the columns of one numpy tree of each size; a long one has a tree of its own, of
packed integers, so a pre-token of n bytes takes some 40 n bytes and n log n steps.

Normalisation (NFC, lower case) and the classes of characters are compiled from the tokenizers library itself, so its
Unicode tables decide: a table of code points serves texts whose characters stand alone; texts with characters that
may combine go through the library's own normaliser, in parts that end at spaces. A pre-token never crosses a space,
an equal pre-token has equal tokens, and frequent ones stay in a cache of two generations that is bounded in bytes.

Results for odd input: null text counts as empty; an empty text has no ids and decodes to the empty text; texts of any
length are read whole; repeated rows and null ids each give their row; an empty table gives an empty result. The
string of a special token in a text is that token, as the library has it by default. Decoding leaves out ids that the
vocabulary does not have, and null ids. Columns beyond the two named are not read, so their names cannot clash.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm.common import table, text_groups
from quarrylens.llm.token_counts import byte_letters, sums_of

LETTER, NUMBER, OTHER, SPACE, EDGE = range(5)
#: Stands between texts that are read together; no text holds it, as it is no code point.
SENTINEL = 0x110000
#: The most leaves of the trees that advance in lockstep, and the cells of such trees at once.
LANES, CELLS = 32, 1 << 20
NEVER = 1 << 30
#: Bytes of text taken up at once, bytes of pre-tokens in one generation of the cache, and of the longest that it keeps.
GROUP, CACHE, KEPT = 1 << 22, 1 << 22, 64


class WordBpe:
    """A word-end BPE file of the tokenizers library as arrays: symbols of bytes, ranks of pairs, spelling of tokens."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"] or model["unk_token"] or model["ignore_merges"] or spec["decoder"]:
            raise ValueError("only lower-casing word-end BPE files without a decoder can be compiled")
        self.json = json.dumps(spec)
        ids, end = model["vocab"], model["end_of_word_suffix"]
        letters = {b: c for c, b in byte_letters().items()}
        self.inner = np.array([ids[letters[b]] for b in range(256)], np.int64)
        self.final = np.array([ids[letters[b] + end] for b in range(256)], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.base = max(max(ids.values()), *self.special.values()) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([ids[a] * (self.base + 1) + ids[b] for a, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], order.astype(np.int32)
        spelt = {i: t for t, i in (ids | self.special).items()}
        self.spelling = [spelt.get(i) for i in range(self.base)]
        splitter = pre_tokenizers.Split(Regex(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), "removed", invert=True)
        self.lower, self.classes = self._tables(Tokenizer.from_file(path).normalizer, splitter)

    @staticmethod
    def _tables(normalizer, splitter) -> tuple[np.ndarray, np.ndarray]:
        """For each code point: its normalised form if it has one by itself (else -1), and the class of its normalised form.

        A code point may combine with others if it is a mark, a conjoining letter of Hangul or unassigned here."""
        import regex

        lower, classes = np.full(SENTINEL + 1, -1, np.int32), np.full(SENTINEL + 1, OTHER, np.uint8)
        alone = [c for c in range(1, SENTINEL) if unicodedata.category(chr(c)) not in ("Mn", "Mc", "Me", "Cn", "Cs") and not 0x1100 <= c <= 0x11FF]
        for c, form in zip(alone, normalizer.normalize_str("\0".join(map(chr, alone))).split("\0")):
            if len(form) == 1:
                lower[c] = ord(form)
        every = "".join(chr(c) for c in range(SENTINEL) if not 0xD800 <= c <= 0xDFFF)
        split = splitter.pre_tokenize_str

        def kind(c: str) -> int:
            return LETTER if len(split("a" + c)) == 1 else OTHER if len(split("!" + c)) == 1 else NUMBER

        for pattern in (r"\p{L}", r"\p{N}", r"\s", r"[^\s\p{L}\p{N}]"):
            alike = "".join(regex.findall(pattern, every))
            found = np.full(len(alike), SPACE, np.uint8)  # what no piece holds is dropped as white space
            for _, (a, b) in split(alike):  # a piece is of one class
                found[a:b] = kind(alike[a])
            classes[np.frombuffer(alike.encode("utf-32-le"), np.uint32)] = found
        lower[SENTINEL], classes[SENTINEL] = SENTINEL, EDGE
        return lower, classes

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NEVER if there is none."""
        wanted = left * (self.base + 1) + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.ranks[at], NEVER)


@functools.lru_cache(maxsize=2)
def compiled(path: str) -> WordBpe:
    """The model of a file; making its tables takes some seconds."""
    return WordBpe(path)


def merge_lanes(m: WordBpe, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of many pre-tokens (runs of raw) of at most leaves + 1 bytes: all in order, and how many each has.

    Each column of `tree` is one pre-token's segment tree: node 1 the root, nodes leaves to 2 * leaves - 1 the pairs."""
    n, bits = len(starts), leaves.bit_length()
    place = np.arange(leaves + 1)[:, None]
    inside = place < sizes
    at = np.where(inside, starts + place, 0)
    symbol = np.where(inside, np.where(place == sizes - 1, m.final[raw[at]], m.inner[raw[at]]), m.base)
    symbol = np.vstack([symbol, np.full((1, n), m.base)])  # the row of the neighbour that is none
    none = leaves + 1
    after = np.where(place + 1 < sizes, place + 1, none)
    before = np.where(place > 0, place - 1, none) + np.zeros((1, n), np.int64)
    before = np.vstack([before, np.zeros((1, n), np.int64)])
    rank = m.rank_of(symbol[:leaves], symbol[1 : leaves + 1]).astype(np.int64)
    tree = np.full((2 * leaves, n), NEVER << bits)
    tree[leaves:] = (rank << bits) + place[:leaves]
    for node in range(leaves - 1, 0, -1):
        np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])
    live = np.arange(n)
    while True:
        root = tree[1, live]
        keep = root < NEVER << bits
        live, root = live[keep], root[keep]
        if not len(live):
            break
        left, merged = root & ((1 << bits) - 1), m.made[root >> bits]
        right = after[left, live]
        follows, leads = after[right, live], before[left, live]
        symbol[left, live], symbol[right, live] = merged, -1
        after[left, live], before[follows, live] = follows, left
        first = leads == none
        leads = np.where(first, left, leads)  # no pair before: its leaf stands for it once more
        own = (m.rank_of(merged, symbol[follows, live]).astype(np.int64) << bits) + left
        tree[leaves + np.minimum(right, leaves - 1), live] = NEVER << bits
        tree[leaves + left, live] = own
        tree[leaves + leads, live] = np.where(first, own, (m.rank_of(symbol[leads, live], merged).astype(np.int64) << bits) + leads)
        node, lane = leaves + np.concatenate([left, np.minimum(right, leaves - 1), leads]), np.concatenate([live, live, live])
        for _ in range(bits - 1):
            node >>= 1
            tree[node, lane] = np.minimum(tree[2 * node, lane], tree[2 * node + 1, lane])
    kept = (symbol >= 0) & (symbol < m.base)
    return symbol.T[kept.T], kept.sum(axis=0)


def merge_long(m: WordBpe, raw: bytes) -> np.ndarray:
    """Tokens of one pre-token of any length, by a tree of its own."""
    n = len(raw)
    symbol = m.inner[np.frombuffer(raw, np.uint8)]
    symbol[-1] = m.final[raw[-1]]
    leaves, shift, never = 1 << (n - 1).bit_length(), 40, NEVER << 32
    tree = np.full(2 * leaves, never, np.int64)
    ranks = m.rank_of(symbol[:-1], symbol[1:]).astype(np.int64)
    tree[leaves : leaves + n - 1] = np.where(ranks < NEVER, (ranks << shift) + np.arange(n - 1), never)
    width = leaves
    while width > 1:
        np.minimum(tree[width : 2 * width : 2], tree[width + 1 : 2 * width : 2], out=tree[width // 2 : width])
        width //= 2
    tree, symbol = array("q", tree.tobytes()), array("q", symbol.tobytes())
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    known: dict[int, int] = {}

    def rank(a: int, b: int) -> int:
        key = a * (m.base + 1) + b
        found = known.get(key)
        if found is None:
            at = int(np.searchsorted(m.pairs, key))
            found = known[key] = int(m.ranks[at]) if at < len(m.pairs) and m.pairs[at] == key else NEVER
        return found

    def put(i: int, value: int) -> None:
        node = leaves + i
        tree[node] = value
        node >>= 1
        while node:
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    while tree[1] < never:
        found, left = tree[1] >> shift, tree[1] & ((1 << shift) - 1)
        right = after[left]
        symbol[left], symbol[right] = int(m.made[found]), -1
        follows, leads = after[right], before[left]
        after[left] = follows
        put(right, never)
        if follows < n:
            before[follows] = left
            r = rank(symbol[left], symbol[follows])
            put(left, (r << shift) + left if r < NEVER else never)
        else:
            put(left, never)
        if leads >= 0:
            r = rank(symbol[leads], symbol[left])
            put(leads, (r << shift) + leads if r < NEVER else never)
    out = np.frombuffer(symbol, np.int64)
    return out[out >= 0]


class Encoder:
    """Encodes and decodes texts with a compiled model; what frequent pre-tokens gave is kept."""

    def __init__(self, model: WordBpe):
        from tokenizers import Tokenizer

        self.m = model
        self.normalizer = Tokenizer.from_str(model.json).normalizer
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0
        self.any_special = re.compile("|".join(map(re.escape, sorted(model.special, key=len, reverse=True))) or r"(?!)")
        spelt = [b"" if s is None else s.encode() + b" " for s in model.spelling]
        self.letters = np.frombuffer(b"".join(spelt), np.uint8)
        self.ends = np.cumsum([0, *map(len, spelt)])

    def slowly(self, text: str) -> str:
        """The library's normalised text, in parts that begin at spaces (nothing combines with a space before it)."""
        parts, at = [], 0
        while at < len(text):
            cut = text.find(" ", at + (1 << 16))
            cut = len(text) if cut < 0 else cut
            parts.append(self.normalizer.normalize_str(text[at:cut]))
            at = cut
        return "".join(parts)

    def split(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct pre-tokens, all pre-tokens in order as places among them, and how many each text has."""
        m = self.m
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer(bytearray(("\n".join(texts) + "\n").encode("utf-32-le")), np.uint32)
        ends = np.cumsum(sizes + 1) - 1
        points[ends] = SENTINEL
        low = m.lower[points]
        hard = np.unique(np.searchsorted(ends, np.flatnonzero(low < 0)))
        if len(hard):
            texts = list(texts)
            parts, at = [], 0
            for k in hard.tolist():
                texts[k] = self.slowly(texts[k])
                parts += [low[at : ends[k] - sizes[k]], np.frombuffer(texts[k].encode("utf-32-le"), np.int32)]
                at, sizes[k] = ends[k], len(texts[k])
            low = np.concatenate([*parts, low[at:]])
            ends = np.cumsum(sizes + 1) - 1
        cls = m.classes[low]
        begins = np.ones(len(low), bool)
        begins[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == NUMBER)
        signs = np.flatnonzero((low == ord("'")) & begins)
        if len(signs):
            a, b = low[np.minimum(signs + 1, len(low) - 1)], low[np.minimum(signs + 2, len(low) - 1)]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            begins[signs[one | two] + 1] = False
            begins[signs[one] + 2] = True
            begins[signs[two] + 3] = True
        at = np.flatnonzero(begins)
        width = np.ones(len(low), np.uint8)
        for least in (0x80, 0x800, 0x10000):
            width += low >= least
        low[ends] = ord("\n")
        width[ends] = 1
        utf8 = low.astype("<u4").tobytes().decode("utf-32-le").encode()
        places = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[np.append(at, len(low))]
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(utf8)])
        keep = (cls[at] != SPACE) & (cls[at] != EDGE)
        coded = pieces.filter(pa.array(keep)).dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(np.searchsorted(at[keep], ends), prepend=0)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's token ids as little-endian 32-bit integers, by segment trees."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts, raw = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(pieces), np.uint8)
        leaves, done = 1, 1
        while leaves <= LANES:
            mine = np.flatnonzero((sizes >= done) & (sizes <= leaves + 1))
            for at in range(0, len(mine), CELLS // leaves):
                some = mine[at : at + CELLS // leaves]
                ids, counts = merge_lanes(self.m, raw, starts[some], sizes[some], leaves)
                packed, begin = ids.astype("<u4").tobytes(), 0
                for k, end in zip(some.tolist(), (4 * np.cumsum(counts)).tolist()):
                    out[k] = packed[begin:end]
                    begin = end
            done, leaves = leaves + 2, leaves * 2
        for k in np.flatnonzero(sizes >= done).tolist():
            out[k] = merge_long(self.m, pieces[k]).astype("<u4").tobytes()
        return out

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        if self.held > CACHE:
            self.young, self.old, self.held = {}, self.young, 0
        young, old = self.young, self.old
        found = list(map(young.get, pieces))
        fresh = [k for k, ids in enumerate(found) if ids is None]
        for k in fresh:
            found[k] = old.get(pieces[k])
        new = [k for k in fresh if found[k] is None]
        for k, ids in zip(new, self.merged([pieces[k] for k in new])):
            found[k] = ids
        for k in fresh:
            if len(pieces[k]) <= KEPT:
                young[pieces[k]] = found[k]
                self.held += len(pieces[k])
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in order, and how many each text has."""
        if not any(s in t for s in self.m.special for t in texts):
            return self._plain(texts)
        parts, marks, per_text = [], [], []
        for t in texts:
            before, at = len(parts), 0
            for found in self.any_special.finditer(t):
                parts.append(t[at : found.start()])
                marks.append(self.m.special[found[0]])
                at = found.end()
            parts.append(t[at:])
            marks.append(-1)
            per_text.append(len(parts) - before)
        ids, per_part = self._plain(parts)
        mark = np.array(marks)
        ids = np.insert(ids, np.cumsum(per_part)[mark >= 0], mark[mark >= 0])
        return ids, sums_of(per_part + (mark >= 0), np.array(per_text))

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        distinct, index, per_text = self.split(texts)
        if not len(index):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        found = self.ids_of(distinct)
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, lengths = (np.cumsum(sizes) - sizes)[index], sizes[index]
        before = np.cumsum(lengths) - lengths
        return pool[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))], sums_of(lengths, per_text)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' spelling, joined by spaces: what the library decodes to where the file has no decoder."""
        out = []
        for at in range(0, len(ids), 1 << 18):
            some = ids[at : at + (1 << 18)].astype(np.int64)
            some = some[(some >= 0) & (some < self.m.base)]
            lengths = (self.ends[1:] - self.ends[:-1])[some]
            before = np.cumsum(lengths) - lengths
            out.append(self.letters[np.repeat(self.ends[some] - before, lengths) + np.arange(int(lengths.sum()))].tobytes())
        return b"".join(out)[:-1].decode()


def word_bpe_encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array<int>) of every row's whole text."""
    model = df.sparkSession.sparkContext.broadcast(compiled(tokenizer_path))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(model.value)
            for a, texts in text_groups(batch.column(1), GROUP):
                ids, per_text = encoder.encode(texts)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), lists], ["id", "ids"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def word_bpe_decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """df with `decoded`, the text that its ids decode to (null for null ids); an earlier column of that name goes."""
    model = df.sparkSession.sparkContext.broadcast(compiled(tokenizer_path))
    read = df.select(*[c for c in df.columns if c.lower() != "decoded"])
    at, names = read.columns.index(ids_col), [*read.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for batch in batches:
            decoder = decoder or Encoder(model.value)
            lists = batch.column(at)
            texts = [None if not v.is_valid else decoder.decode(np.asarray(v.values.drop_null())) for v in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return read.mapInArrow(run, T.StructType([*read.schema.fields, T.StructField("decoded", T.StringType())]))


def op13_word_bpe(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    ids = word_bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path)
    both = word_bpe_decode(ids, tokenizer_path)
    written = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
