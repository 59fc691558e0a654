"""Operator 11, phrase collocations: direct-address tiles of frequency-ranked ids, applied again to what is frequent.

Texts are read once. Each task codes its texts in parts of about PART_BYTES bytes of one language: the part's distinct
words with their counts, and the sequence of their places, written as a table. All later passes read that table.

* Words that occur often enough are numbered by frequency within their language, so that frequent words have small,
  neighbouring numbers. A pair (a, b) of neighbours is a cell of the tile (a // TILE, b // TILE).
* A task counts the tiles of the most frequent ids densely, by numpy's bincount into direct-address arrays; pairs of
  other tiles, and of tiles that a part hardly touches, are kept as sorted coordinates with counts and are handed on
  whenever they outgrow their bound. Spark adds up the counts of all tasks by cell.
* Frequent pairs are numbered by frequency in turn, and (pair, next word) is counted the same way, then (triple, next
  word). A phrase can be frequent only if both phrases that are shorter by one word are, so only such places count.

How a task finds the numbers of its words and pairs: up to BROADCAST bytes of frequent ones are broadcast; beyond, each
part gets its own dictionary by a join of its distinct words or pairs with the numbered table. Both give the same rows.

Scores, drops and ranks are joins and groupings of the frequent phrases with their counts. Products are decimals of 38
digits. Counts are never cut: a threshold on the final count is the operator's only one.

Results for odd input: null texts are empty; null languages are `und`; texts of any length and their phrases are read
whole; repeated rows count each time; ids are not read, nor are other columns; an empty table, or one without frequent
phrases, gives no rows. Ties of score and count are ordered by the phrase's bytes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import scratch, table, text_groups

#: Bytes of a language's texts that make a part; a longer text is a part alone.
PART_BYTES = 3 << 20
#: Ids a tile spans each way; tiles each way that may be dense; cells of a part in a tile below which it stays sparse.
TILE, DENSE, SPARSE = 1 << 9, 4, 1 << 12
#: Sparse cells held before they are sorted, and distinct ones before they are handed on.
FRESH, HELD = 1 << 18, 1 << 19
#: Bytes of a dictionary that is broadcast.
BROADCAST = 1 << 25
BREAK = 0xFF
#: Shares in which a language's phrases are ranked before all together.
SHARES = 32
#: Parts are rows of megabytes: row groups of a few of them, so that a reader holds no more at once.
ROW_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: A-Z become a-z; the signs between pieces become a byte that UTF-8 does not use.
FOLD = bytes(c + 32 if 65 <= c <= 90 else BREAK if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def _coded(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """part, lang, n (words with repeats), words, counts and seq: the places of the words in order as 32-bit integers, -1 between pieces."""

    def code(part: int, lang: str, texts: list[bytes]) -> pa.RecordBatch:
        blob = b"\xff".join(texts).replace(b"\xff", b" \xff ")
        coded = pa.array(itertools.chain([b"\xff"], blob.split()), pa.large_binary()).dictionary_encode()
        seq = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) - 1  # the first entry is the break
        counts = np.bincount(seq[seq >= 0], minlength=len(coded.dictionary) - 1)
        words = coded.dictionary.slice(1).cast(pa.large_string())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words.cast(pa.string()), pa.array(counts, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([lang]), pa.array([int(counts.sum())], pa.int64()), *lists, pa.array([seq.tobytes()], pa.binary())], ["part", "lang", "n", "words", "counts", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for begin, texts in text_groups(batch.column(1)):
                for lang, text in zip(langs[begin:], texts):
                    held.setdefault(lang, []).append(text.encode().translate(FOLD))
                    sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1]) + 64
                    if sizes[lang] > PART_BYTES or sum(sizes.values()) > 4 * PART_BYTES:
                        most = max(sizes, key=sizes.get)
                        del sizes[most]
                        yield code(part, most, held.pop(most))
                        part += 1
        for lang in list(held):
            yield code(part, lang, held.pop(lang))
            part += 1

    read = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, "part long, lang string, n long, words array<string>, counts array<long>, seq binary")


def _numbered(df: DataFrame, what: str, *order: Column) -> DataFrame:
    """df, written, with `id`: the place of each row in the given order, from 0; no row passes through one task for it."""
    spark = df.sparkSession
    rows = scratch(spark, df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), what)
    slice_, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(tuple(r) for r in rows.groupBy(slice_.alias("slice")).count().collect())  # one row a partition
    first, offsets = 0, []
    for k, n in sizes:
        offsets.append((k, first))
        first += n
    starts = spark.createDataFrame(offsets, "slice long, first long")
    return rows.join(F.broadcast(starts), slice_ == F.col("slice")).withColumn("id", F.col("first") + within).drop("at", "slice", "first")


class Tiles:
    """Counts pairs (a, b) of non-negative ids: dense tiles for the lowest ids, sorted coordinates for the others."""

    def __init__(self, n_words: int):
        self.n_words = n_words
        self.dense: dict[int, np.ndarray] = {}
        self.fresh: list[np.ndarray] = []
        self.waiting = 0
        self.codes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes the pairs up; yields codes (a * n_words + b) with counts when too many are held."""
        low = (a < TILE * DENSE) & (b < TILE * DENSE)
        tile = (a[low] // TILE * DENSE + b[low] // TILE).astype(np.uint8)
        order = np.argsort(tile, kind="stable")  # a radix sort, as tiles are bytes
        x, y = a[low][order], b[low][order]
        ends = np.cumsum(np.bincount(tile, minlength=DENSE * DENSE))
        for t, (begin, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            if end - begin < SPARSE and t not in self.dense:
                self._sparse(x[begin:end] * self.n_words + y[begin:end])
            elif end > begin:
                if t not in self.dense:
                    self.dense[t] = np.zeros(TILE * TILE, np.int64)
                self.dense[t] += np.bincount(x[begin:end] % TILE * TILE + y[begin:end] % TILE, minlength=TILE * TILE)
        self._sparse(a[~low] * self.n_words + b[~low])
        if self.waiting > FRESH:
            self._sort()
            if len(self.codes) > HELD:
                yield self.codes, self.counts
                self.codes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _sparse(self, codes: np.ndarray) -> None:
        if len(codes):
            self.fresh.append(codes)
            self.waiting += len(codes)

    def _sort(self) -> None:
        codes = np.concatenate(self.fresh)
        self.fresh, self.waiting = [], 0
        codes.sort()
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        counts = np.diff(np.append(starts, len(codes)))
        both, n = np.concatenate([self.codes, codes[starts]]), np.concatenate([self.counts, counts])
        order = np.argsort(both, kind="stable")  # two sorted runs
        both, n = both[order], n[order]
        starts = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        self.codes, self.counts = both[starts], np.add.reduceat(n, starts)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.fresh:
            self._sort()
        yield self.codes, self.counts
        for t, cells in self.dense.items():
            at = np.flatnonzero(cells)
            yield (t // DENSE * TILE + at // TILE) * self.n_words + t % DENSE * TILE + at % TILE, cells[at]


class Dictionaries:
    """What gives a part's words and phrases their numbers: a broadcast table, or else the part's own columns."""

    def __init__(self, spark, n_words: int):
        self.spark, self.n_words = spark, n_words
        self.words = None
        self.phrases: list = []

    def sequences(self, row: dict) -> list[np.ndarray]:
        """For phrases of 1, 2, ... words: the number of the phrase that begins at each place, -1 if it is not frequent."""
        seq = np.frombuffer(row["seq"], np.int32)
        ids = np.full(len(row["words"]) + 1, -1, np.int64)  # the last is that of a break
        if self.words is None:
            ids[row["own1"].field("k").to_numpy()] = row["own1"].field("id").to_numpy()
        elif row["lang"] in self.words.value:
            known, numbers = self.words.value[row["lang"]]
            at = pc.index_in(row["words"], value_set=known)
            found = at.is_valid().to_numpy(zero_copy_only=False)
            ids[:-1][found] = numbers[at.drop_null().to_numpy()]
        out = [ids[seq]]
        for j, shared in enumerate(self.phrases, 2):
            a, b, place = self.places(out)
            if shared is None:
                codes, numbers = row[f"own{j}"].field("k").to_numpy(), row[f"own{j}"].field("id").to_numpy()
            else:
                codes, numbers = shared.value
            longer = np.full(len(seq), -1, np.int64)
            if len(codes) and len(a):
                wanted = a * self.n_words + b
                at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
                hit = codes[at] == wanted
                longer[place[hit]] = numbers[at[hit]]
            out.append(longer)
        return out

    @staticmethod
    def places(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrase, next word and place, wherever a phrase that is longer by one word may be frequent."""
        words, phrases, k = sequences[0], sequences[-1], len(sequences)
        if len(words) <= k:
            return (np.zeros(0, np.int64),) * 3
        place = np.flatnonzero((phrases[:-k] >= 0) & (phrases[1 : len(phrases) - k + 1] >= 0))
        return phrases[place], words[place + k], place


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's parts as dictionaries; list columns stay Arrow arrays."""
    for i in range(batch.num_rows):
        row = {}
        for name, column in zip(batch.schema.names, batch.columns):
            row[name] = column[i].values if pa.types.is_list(column.type) else column[i].as_py()
        yield row


def _counted(parts: DataFrame, dictionaries: Dictionaries) -> DataFrame:
    """code and n: how often each possible phrase, longer by one word than the dictionaries know, occurs in a task's parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles(dictionaries.n_words)

        def some(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(codes), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(codes[at : at + (1 << 18)]), pa.array(n[at : at + (1 << 18)])], ["code", "n"])

        for batch in batches:
            for row in _rows(batch):
                a, b, _ = Dictionaries.places(dictionaries.sequences(row))
                for full in tiles.add(a, b):
                    yield from some(*full)
        for held in tiles.rest():
            yield from some(*held)

    return parts.mapInArrow(run, "code long, n long")


def _own_codes(parts: DataFrame, dictionaries: Dictionaries) -> DataFrame:
    """part and code: the distinct codes that _counted counts in each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                a, b, _ = Dictionaries.places(dictionaries.sequences(row))
                codes = np.unique(a * dictionaries.n_words + b)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), row["part"])), pa.array(codes)], ["part", "code"])

    return parts.mapInArrow(run, "part long, code long")


def _with_own(parts: DataFrame, keys: DataFrame, numbered: DataFrame, on: list[str], key: str, name: str, what: str) -> DataFrame:
    """parts with a column of each part's own dictionary, its keys in ascending order; keys: part, the join's columns and `key`."""
    found = keys.join(numbered.select(*on, "id"), on).select("part", F.col(key).alias("k"), "id")
    own = found.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("k", "id"))).alias(name))
    return scratch(parts.sparkSession, parts.join(own, "part", "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType))), what, **ROW_GROUPS)


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, share: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of 2 to `longest` words that occur `least`
    times or more; a phrase goes if one that holds it occurs in at least `share` percent of its places."""
    spark = docs.sparkSession
    parts = scratch(spark, _coded(docs, text_col, lang_col), "phrase-parts", **ROW_GROUPS)
    totals = parts.groupBy("lang").agg(F.sum("n").alias("n"))
    each = parts.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    counted = each.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")).where(F.col("f") >= least)
    words = scratch(spark, _numbered(counted, "phrase-words", F.col("lang"), F.desc("f"), F.col("word")), "phrase-word-ids")
    n_words, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word") + 40), F.lit(0))).first()
    known = Dictionaries(None, max(n_words, 1))
    if size <= BROADCAST:
        by_lang: dict[str, tuple[list, list]] = {}
        for lang, word, i in words.select("lang", "word", "id").collect():
            mine = by_lang.setdefault(lang, ([], []))
            mine[0].append(word)
            mine[1].append(i)
        known.words = spark.sparkContext.broadcast({lang: (pa.array(w, pa.string()), np.array(i, np.int64)) for lang, (w, i) in by_lang.items()})
    else:
        keys = parts.select("part", "lang", F.posexplode("words").alias("pos", "word"))
        parts = _with_own(parts, keys, words, ["lang", "word"], "pos", "own1", "phrase-parts-1")
    phrases = words.select("id", "lang", F.array("word").alias("words"), "f")
    single = phrases.select("lang", F.col("words")[0].alias("phrase"), "f")
    found = []
    for k in range(2, longest + 1):
        if k > 2 and (n_phrases + 1) * known.n_words >= 1 << 63:
            raise OverflowError("too many frequent phrases for codes of 64 bits")
        sums = _counted(parts, known).groupBy("code").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        frequent = scratch(spark, _numbered(sums, f"phrases-{k}", F.desc("f"), F.col("code")), f"phrase-ids-{k}")
        n_phrases = frequent.count()
        if k < longest:
            if 16 * n_phrases <= BROADCAST:
                some = frequent.select("code", "id").toArrow().sort_by("code")
                known.phrases.append(spark.sparkContext.broadcast(tuple(some.column(c).to_numpy() for c in ("code", "id"))))
            else:
                parts = _with_own(parts, _own_codes(parts, known), frequent, ["code"], "code", f"own{k}", f"phrase-parts-{k}")
                known.phrases.append(None)
        head = phrases.select(F.col("id").alias("a"), "lang", "words")
        tail = words.select(F.col("id").alias("b"), "word")
        spelt = frequent.select("id", "f", F.expr(f"code div {known.n_words}").alias("a"), F.expr(f"code % {known.n_words}").alias("b"))
        phrases = spelt.join(head, "a").join(tail, "b").select("id", "lang", F.concat("words", F.array("word")).alias("words"), "f")
        phrases = scratch(spark, phrases, f"phrases-spelt-{k}")
        found.append(phrases.drop("id"))
    return _ranked(found, single, totals, top, share)


def _ranked(found: list[DataFrame], single: DataFrame, totals: DataFrame, top: int, share: int) -> DataFrame:
    """Scores, drops and ranks of the frequent phrases; found: those of 2, 3, ... words with lang, words and f."""
    spelt = F.array_join("words", " ")
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    every = every.withColumn("phrase", spelt)
    counts = every.select("lang", "phrase", "f").union(single)
    cuts = every.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    first = F.array_join(F.slice("words", F.lit(1), F.col("k")), " ")
    rest = F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", first.alias("first"), rest.alias("rest"))
    l = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    r = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)")
    scored = cuts.join(l, ["lang", "first"]).join(r, ["lang", "rest"]).withColumn("score", score.cast("long"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = []
    for k, longer in enumerate(found[1:], 3):
        slices = [F.array_join(F.slice("words", at, m), " ") for m in range(2, k) for at in range(1, k - m + 2)]
        inside.append(longer.select("lang", "f", F.explode(F.array(*slices)).alias("phrase")))
    kept = lowest
    if inside:
        held = inside[0]
        for i in inside[1:]:
            held = held.union(i)
        held = held.groupBy("lang", "phrase").agg(F.max("f").alias("held"))
        over = F.expr(f"cast(held as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {int(share)}")
        kept = lowest.join(held, ["lang", "phrase"], "left").where(F.col("held").isNull() | ~over)
    order = (F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    shares = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    first = F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))
    shares = shares.withColumn("first", first).where(F.col("first") <= top)  # so the last window has at most SHARES * top rows a language
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (
    select lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)
), places as (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces),
grams as (
  select lang, array_to_string(w[i : i + m - 1], ' ') as phrase, m, count(*) as f
  from places, (values (1), (2), (3), (4)) sizes(m) where i + m - 1 <= len(w) group by all
), totals as (select lang, sum(f)::bigint as n from grams where m = 1 group by lang),
frequent as (select *, string_split(phrase, ' ') as w from grams where f >= 30),
cuts as (
  select c.lang, c.phrase, c.m, c.f as a, k, x.f as l, y.f as r, (2000000::hugeint * c.f) // (x.f::hugeint + y.f) as score
  from frequent c, (values (1), (2), (3)) ks(k), frequent x, frequent y
  where c.m >= 2 and k < c.m and x.lang = c.lang and y.lang = c.lang
    and x.phrase = array_to_string(c.w[1 : k], ' ') and y.phrase = array_to_string(c.w[k + 1 :], ' ')
), lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select lang, phrase, max(f) as held from (
    select c.lang, array_to_string(c.w[i : i + sizes.m - 1], ' ') as phrase, c.f
    from frequent c, (values (2), (3)) sizes(m), (values (1), (2), (3)) places(i)
    where c.m > sizes.m and i + sizes.m - 1 <= c.m)
  group by all
), kept as (
  select lowest.* from lowest left join inside using (lang, phrase) where held is null or 100::hugeint * held < 80::hugeint * a
)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
) join totals using (lang) where rank <= 2000
"""
