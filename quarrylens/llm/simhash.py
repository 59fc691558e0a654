"""Operator 4, SimHash near-duplicates: binary tries of fingerprints, joined with themselves.

A fingerprint's bit is 1 if set in over half the XXH64 hashes (seed 42) of a text's word shingles. The self-join
walks pairs of trie nodes from the root down, adds up the bits in which the two differ, and leaves a pair once the
Hamming budget is spent; node pairs so low that the budget left cannot be spent above the leaves are compared value
by value. To spread it over a cluster, the one trie becomes a forest: the 64 bits are cut into budget + 2 blocks, and
two fingerprints within the budget agree on at least two of them; so for each pair of blocks there is a set of tries,
one for each value of those blocks, and a link is found in at least one of them. A trie that holds too many
fingerprints (a key may hold a third of all rows) is cut again by the same principle, until a trie is small or so few
bits are open that its size is bounded by them; under a wide budget (over NARROW), where that would multiply the
entries, it is dealt out as pairs of chunks.

A wide budget finds more than the similarity asked for. `one_of_each` therefore takes WORDS words of 64 bits for each
text (the first is the fingerprint, the others come from the same hashes, mixed), searches by the first and links two
texts only if all bits together differ in no more than the similarity allows.

Only distinct fingerprints are joined; each trie yields a spanning forest of its links, not all pairs. The
components of these forests are the classes. Links of all fingerprints stay on the executors. Classes are joined back
to rows by plain shuffled joins, so a fingerprint of many rows is split by Spark's adaptive skew join.

Results for odd input: null and blank texts have fingerprint 0 and are linked like any other; fewer words than a
shingle give one shingle; repeated rows each give their row; a null id takes part, but names no class unless all
ids of its class are null (then null); an empty table gives an empty result; texts of any length are read whole.
Columns beyond the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import fresh, scratch, table
from quarrylens.llm.components import components

HOT = 8192
#: Budgets up to this one cut a hot trie again; wider ones deal tries of over CROWD fingerprints as pairs of chunks.
NARROW = 4
CROWD = 1 << 15
#: Words of 64 bits that decide a link under a wide budget.
WORDS = 4
#: A trie with so few open bits is never cut again: it holds 2 ** OPEN fingerprints at most.
OPEN = 18
ROWS = 1 << 17
LEAF = 64
PAIRS = 1 << 14
#: Node pairs of so many value pairs are compared value by value at once if the budget left cannot run out in them.
DENSE = 1 << 11, 1 << 18


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of hashes, independent for each k (an add, xor-shift and multiply finaliser)."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, shingle: int, words: int = 1) -> np.ndarray:
    """The fingerprint, followed by words - 1 further words of 64 bits."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(words, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(w) + 1 for w in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(tokens))
    starts, ends = starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64 * words, np.int64)
    for at in range(0, len(starts), ROWS):
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[at : at + ROWS], ends[at : at + ROWS])), "<u8")
        if words > 1:
            h = np.stack([h, *(_mixed(h, i) for i in range(1, words))], axis=1)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(total * 2 > len(starts), bitorder="little").view("<u8").astype(np.uint64)


def word_names(words: int) -> list[str]:
    return ["fp", *(f"w{k}" for k in range(1, words))]


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int, digest: bool = False, words: int = 1) -> DataFrame:
    """id, fp (the fingerprint as a signed long), w1 to w(words - 1) of every row, and if asked for the MD5 digest of its text."""
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", *word_names(words), *(["digest"] if digest else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle, words) for t in batch.column(1)]
            found = np.stack(found).view(np.int64) if found else np.zeros((0, words), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(words)), *batch.columns[2:]], names)

    read = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.md5(text_col).alias("digest")] if digest else []))
    return read.mapInArrow(run, f"id {kind}, " + ", ".join(f"{w} long" for w in word_names(words)) + (", digest string" if digest else ""))


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of the classes of i and j; a class's label is its least member."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(labels, up := labels[labels]):
            labels = up
    return labels


def trie_classes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int, rest: np.ndarray | None = None, whole_budget: int = 0) -> np.ndarray:
    """For tries over values[start:end) (sorted): each value's class, as the index of its least member.

    With `rest` (further words, a row for each), a link also needs the whole to differ in whole_budget bits at most."""
    labels = np.arange(len(values))
    ones: dict[int, np.ndarray] = {}

    def middle(lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        """Where the right child begins: a node is a run of sorted values with a common prefix."""
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        return hi - (ones[bit][hi] - ones[bit][lo])

    def link(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal labels
        if rest is not None:
            apart = labels[i] != labels[j]
            i, j = i[apart], j[apart]
            bits = np.bitwise_count(values[i] ^ values[j]).astype(np.int64)
            for word in rest:
                bits += np.bitwise_count(word[i] ^ word[j])
            i, j = i[bits <= whole_budget], j[bits <= whole_budget]
        labels = merge(labels, i, j)

    stack = [(starts, ends, starts, ends, np.zeros(len(starts), np.int64), 63)]
    while stack:
        lo1, hi1, lo2, hi2, used, bit = stack.pop()
        if len(lo1) > PAIRS:
            for at in range(0, len(lo1), PAIRS):
                stack.append((*(x[at : at + PAIRS] for x in (lo1, hi1, lo2, hi2, used)), bit))
            continue
        cells = (hi1 - lo1) * (hi2 - lo2)
        leaf = (cells <= LEAF) | (bit < 0)
        if leaf.any():
            n, width = cells[leaf], (hi2 - lo2)[leaf]
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            i, j = np.repeat(lo1[leaf], n) + k // np.repeat(width, n), np.repeat(lo2[leaf], n) + k % np.repeat(width, n)
            near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            link(i[near], j[near])
        levels = np.log2(np.maximum(np.maximum(hi1 - lo1, hi2 - lo2), 1))
        dense = ~leaf & (cells >= DENSE[0]) & (cells <= DENSE[1]) & (levels <= budget - used)
        for p in np.flatnonzero(dense).tolist():
            i, j = np.nonzero(np.bitwise_count(values[lo1[p] : hi1[p], None] ^ values[None, lo2[p] : hi2[p]]) <= budget)
            i, j = i + lo1[p], j + lo2[p]
            link(i[i < j], j[i < j])
        lo1, hi1, lo2, hi2, used = (x[~(leaf | dense)] for x in (lo1, hi1, lo2, hi2, used))
        if not len(lo1):
            continue
        m1, m2, same = middle(lo1, hi1, bit), middle(lo2, hi2, bit), lo1 == lo2
        pairs = [(lo1, m1, lo2, m2, used), (m1, hi1, m2, hi2, used), (lo1, m1, m2, hi2, used + 1), (m1, np.where(same, m1, hi1), lo2, m2, used + 1)]
        lo1, hi1, lo2, hi2, used = (np.concatenate(x) for x in zip(*pairs))
        open_ = (lo1 < hi1) & (lo2 < hi2) & (used <= budget)
        stack.append((*(x[open_] for x in (lo1, hi1, lo2, hi2, used)), bit - 1))
    return labels


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks of n runs of the given bit positions, as equal as can be."""
    cuts = [len(bits) * k // n for k in range(n + 1)]
    return [sum(1 << b for b in bits[a:c]) for a, c in zip(cuts, cuts[1:])]


def forest_links(nodes: DataFrame, budget: int, words: int = 1, whole_budget: int = 0) -> DataFrame:
    """(a, b) links of a spanning forest of each trie, over the distinct rows of nodes (fp, w1, ...).

    With one word a node is named by its fp, with several by the array of its words."""
    spark = nodes.sparkSession
    names = word_names(words)
    masks = [a | b for a, b in combinations(_blocks(list(range(64)), budget + 2), 2)]
    node = "long" if words == 1 else "array<long>"

    def named(rows: np.ndarray) -> pa.Array:
        if words == 1:
            return pa.array(rows[0])
        return pa.ListArray.from_arrays(np.arange(rows.shape[1] + 1, dtype=np.int32) * words, pa.array(rows.T.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of mask, part and the words, sorted by trie."""
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray, last: bool) -> tuple[pa.RecordBatch | None, np.ndarray]:
            keys = np.stack([rows[0], rows[1], rows[0] & rows[2]])
            begins = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
            if not last:  # the last trie may go on in the next batch
                rows, kept, begins = rows[:, : begins[-1]], rows[:, begins[-1] :], begins[:-1]
            else:
                kept = rows[:, :0]
            if not rows.shape[1]:
                return None, kept
            ends = np.append(begins[1:], rows.shape[1])
            several = ends - begins > 1
            # sorted as signed longs: within a trie, flip the sign bit to get the order of unsigned values
            values = rows[2].view(np.uint64) ^ np.uint64(1 << 63)
            labels = trie_classes(values, begins[several], ends[several], budget, rows[3:].view(np.uint64) if words > 1 else None, whole_budget)
            i = np.flatnonzero(labels != np.arange(len(labels)))
            return pa.RecordBatch.from_arrays([named(rows[2:, i]), named(rows[2:, labels[i]])], ["a", "b"]), kept

        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            if sum(x.shape[1] for x in held) >= ROWS:
                out, kept = flush(np.concatenate(held, axis=1), False)
                held = [kept]
                if out is not None:
                    yield out
        rows = np.concatenate(held, axis=1) if held else np.zeros((2 + words, 0), np.int64)
        if rows.shape[1]:
            out, _ = flush(rows, True)
            if out is not None:
                yield out

    def joined(entries: DataFrame, part=F.lit(0).cast("long")) -> DataFrame:
        key = F.col("fp").bitwiseAND(F.col("mask"))
        dealt = entries.select("mask", part.alias("part"), *names).repartition("mask", key, "part").sortWithinPartitions("mask", "part", key, "fp")
        return dealt.mapInArrow(run, f"a {node}, b {node}")

    found = []
    entries = nodes.select(F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"), *names)
    while True:
        key = F.col("fp").bitwiseAND(F.col("mask"))
        cut = [m for m in masks if 64 - m.bit_count() > OPEN]
        if not cut:
            return _all([*found, joined(entries)])
        most = HOT if budget <= NARROW else CROWD
        hot = scratch(spark, entries.groupBy("mask", key.alias("key")).count().where(F.col("count") > most).where(F.col("mask").isin([_signed(m) for m in cut])), "hot-tries")
        if hot.isEmpty():
            return _all([*found, joined(entries)])
        keyed = entries.withColumn("key", key)
        found.append(joined(keyed.join(hot, ["mask", "key"], "left_anti")))
        if budget > NARROW:  # every pair of chunks is a trie of its own
            chunks = F.ceil(F.col("count") / CROWD)
            chunked = keyed.join(hot, ["mask", "key"]).withColumns({"chunks": chunks, "chunk": F.pmod(F.xxhash64(*names), chunks)})
            chunked = chunked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).where("chunks > 1")
            return _all([*found, joined(chunked, F.least("chunk", "other") * (1 << 31) + F.greatest("chunk", "other"))])
        finer = [(m, m | b) for m in cut for b in _blocks([i for i in range(64) if not m >> i & 1], budget + 1)]
        below = spark.createDataFrame([(_signed(m), _signed(k)) for m, k in finer], "mask long, finer long")
        finer_rows = keyed.join(hot, ["mask", "key"], "left_semi").join(F.broadcast(below), "mask").select(F.col("finer").alias("mask"), *names)
        entries = scratch(spark, finer_rows, "hot-entries")
        masks = [k for _, k in finer]


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def simhash_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3) -> DataFrame:
    """id, fp (signed long), fingerprint (hex) and component_id of every row: the smallest id reachable by links of budget bits or fewer."""
    rows = scratch(df.sparkSession, fingerprints(df, id_col, text_col, shingle), "fingerprints")
    nodes = scratch(df.sparkSession, rows.groupBy("fp").agg(F.min("id").alias("least_id")), "nodes")
    roots = components(forest_links(nodes.select("fp"), budget)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_fp = rooted.select("fp", "root").join(classes, "root").select("fp", "component_id")
    out = rows.join(of_fp, "fp")
    return out.select(F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def allowed_bits(similarity: float, bits: int) -> int:
    """How many of `bits` fingerprint bits two texts of that Jaccard similarity (of sets of equal size) differ in, on average and one and a half standard deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + 1.5 * math.sqrt(bits * share * (1 - share)))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, budget: int = 13, similarity: float = 0.8) -> DataFrame:
    """One row of each class of texts of that similarity or more on their shingles, with all its columns.

    It is the row of the least id (a null id is the greatest), then of the least text digest, then of the least hash of
    all columns. Similarity is estimated on WORDS * 64 bits; candidates differ in `budget` bits of the first 64."""
    spark = df.sparkSession
    names = word_names(WORDS)
    rows = scratch(spark, fingerprints(df, id_col, text_col, shingle, digest=True, words=WORDS), "fingerprints")
    pairs = rows.groupBy(*names, "id", "digest").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest", "n"))
    nodes = scratch(spark, pairs.groupBy(*names).agg(least.alias("least")), "nodes")
    roots = components(forest_links(nodes.select(*names), budget, WORDS, allowed_bits(similarity, 64 * WORDS))).select(F.col("a").alias("code"), F.col("b").alias("root"))
    coded = nodes.select(F.array(*names).alias("code"), "least")
    kept = coded.join(roots, "code", "left").groupBy(F.coalesce("root", "code").alias("root")).agg(F.min("least").alias("least"))
    own_id, own_digest, copies = fresh(df, "kept_id"), fresh(df, "kept_digest"), fresh(df, "kept_copies")
    kept = kept.select(F.col("least.id").alias(own_id), F.coalesce("least.digest", F.lit("")).alias(own_digest), F.col("least.n").alias(copies))
    kept = scratch(spark, kept, "kept")
    met = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.coalesce(F.md5(text_col), F.lit("")) == F.col(own_digest))
    alone = df.join(kept.where(F.col(copies) == 1), met, "left_semi")
    equal = df.join(kept.where(F.col(copies) > 1), met)
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    first = F.min_by(F.struct(*df.columns), F.xxhash64(*hashed)).alias(own_id + "_")
    return alone.union(equal.groupBy(own_id, own_digest).agg(first).select(own_id + "_.*"))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"), shingle=3, budget=3).select("doc_id", "fingerprint", "component_id")
