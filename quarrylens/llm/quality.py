"""Operator 2, quality by Bradley-Terry ranking: P(a beats b) = sigmoid(score(a) - score(b)), score = w . features.

Every document of label 1 beats every one of label 0; w minimises the mean logistic loss over all these pairs of all
labelled documents, with a ridge penalty, by Newton's method. The threshold is a quantile of the scores of all
labelled documents: the share of label 0 among them. Scores are given as sigmoid(score - threshold + logit(CUT)), so
that a document is predicted good from CUT on exactly if it lies at the quantile or above.

Features come from the text alone: frequencies of character-class pairs, word repetition, distinct words, lengths.
They are made once for the labelled documents and stored; each step of Newton's method passes over all of them twice.
A pair matters by the difference of its two scores only, so the pairs need not be listed: a first pass counts the
scores of either label on a grid of 1 / FINE, each shared between its two next points, which gives every score's mean chance to lose
against the whole other label; a second pass adds up gradient and curvature with these. The grid moves a chance by less than
1e-5 (scores beyond LIMIT count as LIMIT there). Sums are made by tasks and added up by Spark; the driver gets the total, whose size depends on the features alone.

Results for odd input: null texts count as empty; empty texts get the score of their features like any other;
null labels are not learned from, several labels of an id count as their least, several texts of an id as the one of the least digest; equal scores are equal predictions; without labels of both kinds all
scores are CUT; null ids are scored but never learned from; repeated rows each give their row; an empty table gives
an empty result. Columns beyond those named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import crc32_mod, scratch, table, text_groups

PAIRS = 40_000
CUT = 0.7
RIDGE = 1.0  # of the loss of PAIRS pairs
KINDS = 13
LIMIT, FINE, COARSE = 32, 64, 4  # scores are counted from -LIMIT to LIMIT, in steps of 1 / FINE, for the curvature of 1 / COARSE
TOLERANCE = 1e-6
PARTS = 4096


def _kinds() -> np.ndarray:
    """Each code point's class: letters by case, digits, spaces, line ends, and groups of marks."""
    table = np.full(0x110000, 11, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s.islower():
            table[c] = 0
        elif s.isupper():
            table[c] = 1
        elif s.isalpha():
            table[c] = 2
        elif s.isdecimal():
            table[c] = 3
        elif s.isspace():
            table[c] = 4
    for k, marks in ((5, "\n"), (6, "."), (7, ",;:"), (8, "!?"), (9, "%$#*&@~^_=+"), (10, "|<>{}[]\\/")):
        for s in marks:
            table[ord(s)] = k
    table[0] = 12  # between texts
    return table


_table: list[np.ndarray] = []


def features(texts: list[str]) -> np.ndarray:
    """One row of features for each text, in single precision."""
    if not _table:
        _table.append(_kinds())
    joined = "\0".join(["", *(t.replace("\0", "\x01") for t in texts), ""])
    kind = _table[0][np.frombuffer(joined.encode("utf-32-le"), np.uint32)].astype(np.int64)
    of_text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    cells = KINDS * KINDS
    pairs = np.bincount(of_text * cells + kind[:-1] * KINDS + kind[1:], minlength=len(texts) * cells).reshape(len(texts), cells)
    more = np.zeros((len(texts), 6))
    for i, t in enumerate(texts):
        words = t.split()
        n = max(1, len(words))
        more[i] = (
            np.log1p(len(t)),
            sum(map(eq, words, words[1:])) / n,
            len(set(words)) / n,
            np.log1p(len(set(words))),
            len(t) / n / 10,
            t.count("\n") / n,
        )
    return np.hstack([np.sqrt(pairs / pairs.sum(axis=1, keepdims=True)), more]).astype(np.float32)


class Model:
    """Standardised features, weights and the score threshold."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        self.mean = mean
        self.scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0.0)
        self.w, self.threshold = np.zeros(len(mean)), 0.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) * self.scale

    def raw(self, z: np.ndarray) -> np.ndarray:
        """Scores of standardised features; a row's does not depend on the rows beside it."""
        return (z * self.w).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = self.raw(self.standard(x)) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


class Ranker(Model):
    """The model of arrays in memory over PAIRS drawn pairs: the plain form, which no query uses."""

    def __init__(self, x: np.ndarray, good: np.ndarray):
        super().__init__(x.mean(axis=0), x.std(axis=0))
        z = self.standard(x)
        rng = np.random.default_rng(42)
        a, b = rng.choice(np.flatnonzero(good), PAIRS), rng.choice(np.flatnonzero(~good), PAIRS)
        d = z[a] - z[b]
        w = np.zeros(d.shape[1])
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            gradient = d.T @ (1 - p) - RIDGE * w
            curvature = (d * (p * (1 - p))[:, None]).T @ d + RIDGE * np.eye(len(w))
            w = w + np.linalg.solve(curvature, gradient)
        self.w = w
        self.threshold = float(np.quantile(z @ w, 1 - good.mean()))


def grid(per: int) -> np.ndarray:
    return np.arange(-LIMIT * per, LIMIT * per + 1) / per


def shares(s: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray]:
    """The grid point below each score, and the share of the score that the next point has."""
    u = np.clip((s + LIMIT) * per, 0, 2 * LIMIT * per)
    at = np.minimum(u.astype(np.int64), 2 * LIMIT * per - 1)
    return at, u - at


def counted(s: np.ndarray, per: int, weights: np.ndarray | float = 1.0) -> np.ndarray:
    """The number (or weight) of scores at each grid point."""
    at, part = shares(s, per)
    n = 2 * LIMIT * per + 1
    return np.bincount(at, (1 - part) * weights, n) + np.bincount(at + 1, part * weights, n)


def against(counts: np.ndarray, per: int, of_lead) -> np.ndarray:
    """At each grid point, the sum of of_lead(other score - own score) over the counted scores."""
    lead = np.arange(1 - len(counts), len(counts)) / per
    return np.correlate(of_lead(lead), counts, "valid")[::-1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def slope(x: np.ndarray) -> np.ndarray:
    return sigmoid(x) * sigmoid(-x)


def totals(rows: DataFrame, parts: Callable[[np.ndarray, np.ndarray], Iterable[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """By key, the sums over all rows of the arrays that parts(features, good) gives for some of them."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for key, v in parts(unpacked(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)):
                    found[key] = found[key] + v if key in found else v
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([task] * len(found), pa.int32()), pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], ["key", "task", "v"])

    def summed(of_key: pa.Table) -> pa.Table:
        v = of_key.sort_by("task")["v"].to_pylist()
        return pa.table({"key": of_key["key"][:1], "v": pa.array([np.sum(v, axis=0).tolist()], pa.list_(pa.float64()))})

    sums = rows.mapInArrow(of_task, "key int, task int, v array<double>").groupBy("key").applyInArrow(summed, "key int, v array<double>")
    return {r.key: np.array(r.v) for r in sums.collect()}


def unpacked(x: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(v, np.float32) for v in x.to_pylist()], np.float64)


def fit(rows: DataFrame) -> Model | None:
    """The model of all rows (good, x); None without both labels."""
    sums = totals(rows, lambda x, good: [(int(k), np.append(x[good == k].sum(axis=0), (good == k).sum())) for k in (False, True)])
    if len(sums) < 2 or not sums[0][-1] or not sums[1][-1]:
        return None
    bad_n, good_n = sums[0][-1], sums[1][-1]
    n = bad_n + good_n
    mean = ((sums[0] + sums[1])[:-1] / n).astype(np.float32).astype(np.float64)
    model = Model(mean, np.sqrt(totals(rows, lambda x, good: [(0, ((x - mean) ** 2).sum(axis=0))])[0] / n).astype(np.float32))
    size, ridge, best, base, step = len(mean), RIDGE / PAIRS, np.inf, model.w, model.w
    fine, coarse = grid(FINE), grid(COARSE)

    def counts_of(x: np.ndarray, good: np.ndarray):
        s = model.raw(model.standard(x))
        return [(int(k), counted(s[good == k], FINE)) for k in (False, True)]

    for _ in range(60):
        scores = totals(rows, counts_of)
        loss = scores[1] @ against(scores[0], FINE, lambda d: np.logaddexp(0, d)) / (good_n * bad_n) + ridge * (model.w @ model.w) / 2
        if loss > best + 1e-6:  # too far a step
            step = step / 2
            model.w = base + step
            continue
        base, best = model.w, loss
        lost = {1: against(scores[0], FINE, sigmoid) / bad_n, 0: against(scores[1], FINE, lambda d: sigmoid(-d)) / good_n}
        steps = {k: counted(fine, COARSE, scores[k]) for k in (0, 1)}
        bent = {1: against(steps[0], COARSE, slope) / bad_n, 0: against(steps[1], COARSE, slope) / good_n}

        def derived(x: np.ndarray, good: np.ndarray):
            z = model.standard(x)
            s = model.raw(z)
            for k, m in ((0, bad_n), (1, good_n)):
                mine, t = z[good == k], s[good == k]
                if not len(t):
                    continue
                push = np.interp(t, fine, lost[k]) / m * (1 if k else -1)
                yield 0, push @ mine
                yield from enumerate((mine * (np.interp(t, coarse, bent[k]) / m)[:, None]).T @ mine, 1)
                at, part = shares(t, COARSE)
                first = at.min()
                shared = np.zeros((len(t), at.max() - first + 2))
                shared[np.arange(len(t)), at - first] = 1 - part
                shared[np.arange(len(t)), at - first + 1] = part
                yield from enumerate(shared.T @ mine, 1 + size + k * len(coarse) + int(first))

        got = totals(rows, derived)
        zero = np.zeros(size)
        at_points = [np.array([got.get(1 + size + k * len(coarse) + j, zero) for j in range(len(coarse))]) for k in (0, 1)]
        crossed = at_points[1].T @ slope(coarse[:, None] - coarse) @ at_points[0] / (good_n * bad_n)
        curvature = np.array([got[1 + j] for j in range(size)]) - crossed - crossed.T + ridge * np.eye(size)
        step = np.linalg.solve(curvature, got[0] - ridge * model.w)
        model.w = base + step
        if np.abs(step).max() < TOLERANCE:
            break
    model.w = np.round(model.w, 7)  # below that, the order of sums would show

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(model.standard(unpacked(batch.column(1)))))], ["s"])

    scores = scratch(rows.sparkSession, rows.mapInArrow(raw, "s double"), "quality-scores")
    low = value_at(scores, int(bad_n) - 1)
    at_most, above = scores.agg(F.count_if(F.col("s") <= low), F.min(F.when(F.col("s") > low, F.col("s")))).first()
    high = low if at_most > bad_n else above
    model.threshold = low + (high - low) * good_n / n  # the quantile of bad_n / n, as numpy has it
    return model


def value_at(scores: DataFrame, k: int) -> float:
    """The value that has k of all values s before it in ascending order, by counts in ever smaller parts of their range."""
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    while low < high:
        part = F.least(F.floor((F.col("s") - low) / ((high - low) / PARTS)), F.lit(PARTS - 1))
        parts = scores.where(F.col("s").between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
        for r in sorted(parts.collect(), key=lambda r: r.part):
            if k < r.n:
                low, high = r.low, r.high
                break
            k -= r.n
    return low


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """A model of all labelled documents that docs holds; None without both labels."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in text_groups(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), batch.column(2).slice(a, len(texts)), pa.array([x.tobytes() for x in features(texts)], pa.binary())], ["id", "digest", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.md5(text_col), F.lit("")).alias("digest"))
    rows = read.mapInArrow(run, f"id {kind}, digest string, x binary").join(known, "id").groupBy("id").agg(F.min(F.struct("digest", "label", "x")).alias("own"))
    return fit(scratch(docs.sparkSession, rows.select((F.col("own.label") == 1).alias("good"), "own.x"), "quality-features"))


def score_quality(df: DataFrame, ranker: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted of every row."""
    model = df.sparkSession.sparkContext.broadcast(ranker)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in text_groups(batch.column(1)):
                s = model.value.score(features(texts)) if model.value is not None else np.full(len(texts), CUT)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["id", "score", "predicted"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, ranker: Model | None, text_col: str = "text") -> DataFrame:
    """The rows that are predicted good, with all their columns."""
    model = df.sparkSession.sparkContext.broadcast(ranker)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in text_groups(batch.column(at)):
                good = model.value.score(features(texts)) >= CUT if model.value is not None else np.ones(len(texts), bool)
                yield batch.slice(a, len(texts)).filter(pa.array(good))

    return df.mapInArrow(run, df.schema)


def train_on_tables(spark, docs: DataFrame, sf_dir: str) -> Model | None:
    learned = crc32_mod("doc_id", 4) != 2
    return train(docs.where(learned), table(spark, sf_dir, "labels").where(learned))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, train_on_tables(spark, docs, sf_dir))
    return out.select("doc_id", F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
