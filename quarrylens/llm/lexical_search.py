"""Operator 12, ranked lexical search: term-at-a-time with a limit on accumulators.

One pass over the documents writes a forward index: for each document its length and the numbers and counts of those of
its terms that any item asks for. From it Spark takes N, L and each term's document frequency. The second pass reads
the index in blocks of documents; a block is turned into posting lists with the exact share of the score that each
posting gives, and each item is searched term at a time, the rarest first:

* the remaining bound of a term is the sum of the largest shares that it and the terms after it give in the block;
* accumulators are created as long as a new one could still reach the k-th best score: the k-th largest partial
  score of the block, or the k-th score of the task's earlier blocks, whichever is larger;
* from then on no document enters. Survivors are updated exactly; one that can no longer reach the k-th is let go.

A document is let go only if it falls short of the bound, not if it ties, so results are exact. Each task gives an
item's k best rows, and a window over these gives the k best of all; documents never meet in one task.

The items are broadcast in groups of at most ITEM_BYTES of text; more of them are searched group by group, each group
with a pass of its own, so a broadcast never outgrows the bound.

Results for odd input: null texts have no term (documents) and no result (items); documents without a term do not
count in N; repeated documents are ranked each by itself; null document ids come after all others of their score;
repeated items (id and text alike) count once, and an item id with several texts has a ranking for each; items with no
term in the documents have no rows; empty tables give no rows. Only ids and texts are read, so other columns' names
cannot clash. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import scratch, table, text_groups

#: Bytes of item texts broadcast at once.
ITEM_BYTES = 1 << 24
#: Postings of a block of documents, and its documents.
POSTINGS, BLOCK = 1 << 21, 1 << 16
#: Every byte that is no part of a term becomes a space; A-Z become a-z. Bytes from 0x80 on belong to terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text as UTF-8: runs of ASCII letters, digits and all characters beyond ASCII."""
    return text.encode().translate(FOLD).split()


def forward_index(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """id, n (terms with repeats), and terms and counts: the numbers of the vocabulary's terms that the document holds, and how often. Documents without terms are left out."""
    numbers = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in batches:
            rows, n, terms, counts, ends = [], [], [], [], [0]
            for begin, texts in text_groups(batch.column(1)):
                for i, text in enumerate(texts, begin):
                    found = terms_of(text)
                    if not found:
                        continue
                    held = Counter(filter(known.__contains__, found))
                    rows.append(i)
                    n.append(len(found))
                    terms += map(known.__getitem__, held)
                    counts += held.values()
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, terms array<int>, counts array<long>")


def best_of_block(items: list[tuple[int, np.ndarray, np.ndarray]], starts: np.ndarray, docs: np.ndarray, shares: np.ndarray, most: np.ndarray, df: np.ndarray, place: np.ndarray, k: int, floor: dict[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, documents, scores) of one block: each item's k best, less those that the task's earlier blocks rule out.

    Term t's postings are docs and shares [starts[t], starts[t + 1]), the documents ascending; most[t] is its largest
    share; place is each document's place in the order of ids, which decides ties."""
    score = np.zeros(len(place), np.int64)
    for item, terms, times in items:
        here = starts[terms + 1] > starts[terms]
        order = np.flatnonzero(here)[np.lexsort((terms[here], df[terms[here]]))]
        own, repeats = terms[order], times[order]
        gains = most[own] * repeats
        left = np.append(np.cumsum(gains[::-1])[::-1], 0)  # what the terms from each on can still give
        kth, alive, creating = floor.get(item, 0), np.zeros(0, np.int64), True
        for j, (t, times_t) in enumerate(zip(own.tolist(), repeats.tolist())):
            d, s = docs[starts[t] : starts[t + 1]], shares[starts[t] : starts[t + 1]]
            if creating:
                if len(alive) >= k and left[j] < left[0] - left[j]:  # a bound is worth its price only if it may hold
                    kth = max(kth, int(np.partition(score[alive], len(alive) - k)[len(alive) - k]))
                creating = left[j] >= kth
            if creating:
                score[d] += s * times_t
                alive = np.union1d(alive, d) if len(alive) else d
                continue
            at = np.minimum(np.searchsorted(d, alive), len(d) - 1)
            hit = d[at] == alive
            score[alive[hit]] += s[at[hit]] * times_t
            if len(alive) > k:
                now = score[alive]
                kth = max(kth, int(np.partition(now, len(now) - k)[len(now) - k]))
                stay = now + left[j + 1] >= kth
                score[alive[~stay]] = 0
                alive = alive[stay]
        scores = score[alive]
        score[alive] = 0
        held = (scores > 0) & (scores >= floor.get(item, 0))
        alive, scores = alive[held], scores[held]
        best = np.lexsort((place[alive], -scores))[:k]
        alive, scores = alive[best], scores[best]
        if len(alive) == k:
            floor[item] = int(scores[-1])
        yield item, alive, scores


def _search(index: DataFrame, queries: list[tuple[int, list[int], list[int]]], weights: list[int], df: list[int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (its number), id and score: of each block of documents, every item's k best."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast((queries, np.array(weights, np.int64), np.array(df, np.int64)))
    kind = index.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight, frequency = shared.value
        items = [(i, np.array(t, np.int64), np.array(c, np.int64)) for i, t, c in asked]
        floor: dict[int, int] = {}
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            at = 0
            while at < batch.num_rows:
                n = int(min(max(np.searchsorted(np.cumsum(sizes[at : at + BLOCK]), POSTINGS, "right"), 1), batch.num_rows - at))
                part = batch.slice(at, n)
                at += n
                length = part.column(1).to_numpy()
                term, tf = part.column(2).flatten().to_numpy().astype(np.int64), part.column(3).flatten().to_numpy()
                doc = np.repeat(np.arange(n), np.diff(part.column(2).offsets.to_numpy()))
                m = 75 + (25 * length * n_docs) // n_terms
                share = weight[term] * ((1000000000 * tf) // (1000 * tf + 12 * m[doc]))
                order = np.argsort(term, kind="stable")
                term, doc, share = term[order], doc[order], share[order]
                starts = np.searchsorted(term, np.arange(len(weight) + 1))
                most, held = np.zeros(len(weight), np.int64), np.flatnonzero(starts[1:] > starts[:-1])
                if len(held):
                    most[held] = np.maximum.reduceat(share, starts[held])
                ids, place = part.column(0), np.empty(n, np.int64)
                place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(n)
                found = [(i, d, s) for i, d, s in best_of_block(items, starts, doc, share, most, frequency, place, k, floor) if len(d)]
                if found:
                    rows = np.concatenate([d for _, d, _ in found])
                    number = np.repeat([i for i, _, _ in found], [len(d) for _, d, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), ids.take(pa.array(rows)), pa.array(np.concatenate([s for _, _, s in found]))], ["item", "id", "score"])

    return index.mapInArrow(run, f"item long, id {kind}, score long")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item id, rank, document id and score of each item's k best documents."""
    spark = docs.sparkSession
    item_kind, doc_kind = items.schema[item_col].dataType, docs.schema[id_col].dataType
    asked = scratch(spark, items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null").distinct(), "search-items")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, math.ceil(2 * total / ITEM_BYTES))
    parts = []
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g).collect() if total else []
        wanted = [Counter(terms_of(r.text)) for r in rows]
        vocabulary = sorted(set().union(*wanted))
        index = scratch(spark, forward_index(docs, vocabulary, id_col, text_col), "search-index")
        n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = [0] * len(vocabulary)
        for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most as many as the group's terms
            df[r["term"]] = r["count"]
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in df]
        number = {t: i for i, t in enumerate(vocabulary)}
        queries = [(i, [number[t] for t in w], list(w.values())) for i, w in enumerate(wanted)]
        found = _search(index, queries, weights, df, n_docs, max(n_terms, 1), k)
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], f"item long, name {item_kind.simpleString()}")
        parts.append(ranked.join(F.broadcast(names), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    out = lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


ORACLE_SQL = r"""
with words as (
  select row_number() over () as d, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents
), lengths as (select d, any_value(doc_id) as doc_id, count(*) as n from words group by d),
totals as (select count(*) as docs, sum(n)::bigint as terms from lengths),
counts as (select d, term, count(*) as tf from words group by d, term),
weights as (
  select term, floor(1000 * ln((2.0::double * docs + 2) / (2.0::double * df + 1)))::bigint as w
  from (select term, count(*) as df from counts group by term), totals
), asked as (
  select item_id, term, count(*) as times from (
    select i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select row_number() over () as i, item_id, text from (select distinct item_id, text from benchmark where text is not null)))
  group by i, item_id, term
), scores as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::bigint as score
  from asked join weights using (term) join counts using (term) join lengths using (d), totals
  group by item_id, d, doc_id
)
select * from (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id asc nulls last)::integer as rank, doc_id, score
  from scores where score > 0
) where rank <= 20
"""
