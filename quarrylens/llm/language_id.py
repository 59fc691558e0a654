"""Operator 10, language identification by interpolated Kneser-Ney character models, one for each language.

A text is its words (runs of letters and combining marks, lower case); a word is scored sign by sign, with its end
as a last sign, in contexts of up to ORDER - 1 signs that do not leave the word. The highest order counts all
training words of all training rows; lower orders count continuations (distinct preceding signs). The language with
the least cross-entropy per sign wins.

Rejection is calibrated on the training counts: a text is rejected if its cross-entropy per sign exceeds the
midpoint between its language's own entropy and the cross-entropy that the nearest other model has on that
language, plus SIGMAS standard errors for the text's length; and if it has no letter at all.

Counts cover all training rows and are never cut. Up to BROADCAST_GRAMS n-grams, the models are sorted hash arrays
(64-bit keys of n-grams and contexts, looked up by binary search) that are broadcast to the workers (`Identifier`).
A greater model stays in tables and is joined with the n-grams of the distinct words (`TableIdentifier`): the same
probabilities by shuffles, for any number of n-grams.

Results for odd input: null texts and texts without a letter give `und`, score 0; ties go to the language that sorts
first; without any training row all texts give `und`; repeated rows and null ids each give their row (a null id
is never learned from and not held out); texts of any length are read whole; an empty table gives an empty result.
Columns beyond those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import crc32_mod, fresh, scratch, table

ORDER = 4
#: The largest model, in n-grams of the highest order, that is broadcast (about 100 bytes each).
BROADCAST_GRAMS = 4_000_000
SIGMAS = 6.0
#: Rows of counts that a task holds before it merges them, words that a worker keeps scored, bytes scored at once.
MERGE = 1 << 20
CACHE = 1 << 18
GROUP = 1 << 20
BEGIN, END = 2, 3
#: An odd multiplier: the key of an n-gram is the sum of its signs times its powers, modulo 2 ** 64.
POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(ORDER)], np.uint64)


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words, all words in order as places among them, and each text's number of words."""
    low = pc.fill_null(pc.utf8_lower(texts.cast(pa.large_string())), "")
    plain = pc.utf8_trim_whitespace(pc.replace_substring_regex(low, r"[^\p{L}\p{M}]+", " "))
    lists = pc.split_pattern(plain, " ")
    flat = pc.list_flatten(lists)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    counts[pc.equal(plain, "").to_numpy(zero_copy_only=False)] = 0
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    flat = flat.filter(pc.not_equal(flat, ""))
    coded = flat.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64), counts


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all words (row k: the sign k places back), one for each sign and end, and which word each belongs to."""
    if not words:
        return np.zeros((ORDER, 0), np.uint32), np.zeros(0, np.int64)
    pad = chr(BEGIN) * (ORDER - 1)
    points = np.frombuffer("".join([f"{pad}{w}{chr(END)}" for w in words]).encode("utf-32-le"), np.uint32)
    at = np.flatnonzero(points != BEGIN)
    ends = np.flatnonzero(points == END)
    return np.stack([points[at - back] for back in range(ORDER)]), np.searchsorted(ends, at, side="left")


def key_of(grams: np.ndarray, k: int) -> np.ndarray:
    """The hash key of the last k signs; less the last sign it is that of their context."""
    with np.errstate(over="ignore"):
        key = grams[0].astype(np.uint64)
        for back in range(1, k):
            key = key + grams[back] * POWERS[back]
    return key


def spelt(grams: np.ndarray) -> list[str]:
    whole = np.ascontiguousarray(grams[::-1].T).astype("<u4").tobytes().decode("utf-32-le")
    return [whole[at : at + ORDER] for at in range(0, len(whole), ORDER)]


def unspelt(grams: list[str]) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, ORDER).T[::-1]


def byte_groups(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(total):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, side="right")))
        yield begin, end
        begin = end


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, grams and counts of all parts, each key once."""
    keys, grams, counts = (np.concatenate(x, axis=-1) for x in zip(*parts))
    distinct, first, index = np.unique(keys, return_index=True, return_inverse=True)
    return distinct, grams[:, first], np.bincount(index, counts, len(distinct)).astype(np.int64)


def count_grams(rows: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of text and lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def emit():
            for lang, parts in held.items():
                _, grams, counts = _merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(spelt(grams), pa.string()), pa.array(counts)], ["lang", "gram", "n"])

        for batch in batches:
            for a, b in byte_groups(batch.column(0), GROUP):
                words, index, per_text = words_of(batch.column(0).slice(a, b - a))
                grams, of_word = grams_of(words)
                keys = key_of(grams, ORDER)
                langs = batch.column(1).slice(a, b - a).dictionary_encode()
                of_token = np.repeat(langs.indices.to_numpy(), per_text)
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    times = np.bincount(index[of_token == k], minlength=len(words))[of_word]
                    some = times > 0
                    parts = held.setdefault(lang, [])
                    parts.append(_merged([(keys[some], grams[:, some], times[some])]))
                    if sum(len(x[0]) for x in parts) > MERGE:
                        parts[:] = [_merged(parts)]
            if sum(len(x[0]) for parts in held.values() for x in parts) > 4 * MERGE:
                yield from emit()
                held.clear()
        yield from emit()

    return rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discount_of(once, twice):
    """The Kneser-Ney discount from the numbers of n-grams that were counted once and twice."""
    return once / (once + 2 * twice) if once and twice else 0.5


class Model:
    """One language's interpolated Kneser-Ney model in sorted hash arrays."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, vocabulary: int):
        """grams: distinct n-grams of the highest order, as of grams_of."""
        self.floor = 1.0 / max(vocabulary, 1)
        levels = []
        for k in range(ORDER, 0, -1):
            keys = key_of(grams, k)
            order = np.argsort(keys)
            keys, grams, counts = keys[order], grams[:, order], counts[order]
            contexts, of = np.unique(keys - grams[0], return_inverse=True)
            discount = discount_of((counts == 1).sum(), (counts == 2).sum())
            total, kinds = np.bincount(of, counts), np.bincount(of)
            levels.append((keys, np.maximum(counts - discount, 0) / total[of], contexts, discount * kinds / total))
            if k > 1:  # continuation counts of the next lower order
                _, first, counts = np.unique(key_of(grams, k - 1), return_index=True, return_counts=True)
                grams = grams[:, first]
        self.levels = levels[::-1]

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        p = np.full(grams.shape[1], self.floor)
        for k, (keys, own, contexts, weight) in enumerate(self.levels, 1):
            key = key_of(grams, k)
            context = key - grams[0]
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            g = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            p = np.where(contexts[at] == context, weight[at] * p + np.where(keys[g] == key, own[g], 0), p)
        return np.log(p)


def limits_of(langs: list[str], mean: dict[tuple[str, str], float]) -> list[float]:
    """Each language's midpoint between its own entropy and the least cross-entropy of another model. mean: (language, model) -> entropy."""
    out = []
    for x in langs:
        others = [mean[x, y] for y in langs if y != x]
        out.append((mean[x, x] + min(others)) / 2 if others else mean[x, x] + 1.0)
    return out


class Identifier:
    """All languages' models, with the calibration of rejection."""

    def __init__(self, lang: np.ndarray, gram: list[str], n: np.ndarray):
        self.langs = sorted(set(lang.tolist()))
        grams = unspelt(gram)
        vocabulary = len(np.unique(grams[0]))
        data = [(grams[:, lang == x], n[lang == x]) for x in self.langs]
        self.models = [Model(g, c, vocabulary) for g, c in data]
        self.spread, mean = [], {}
        for i, (x, (g, c)) in enumerate(zip(self.langs, data)):
            bits = [-m.log_p(g) for m in self.models]
            mean |= {(x, y): float(np.average(b, weights=c)) for y, b in zip(self.langs, bits)}
            self.spread.append(float(np.sqrt(np.average((bits[i] - mean[x, x]) ** 2, weights=c))))
        self.limit = limits_of(self.langs, mean)
        self.cache: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs) + 1))

    def sums(self, words: list[str]) -> np.ndarray:
        """For each word the log-probability by each model, and its number of signs."""
        if len(self.cache) > CACHE:
            self.cache, self.scores = {}, self.scores[:0]
        new = [w for w in words if w not in self.cache]
        if new:
            grams, of_word = grams_of(new)
            _, first, index = np.unique(key_of(grams, ORDER), return_index=True, return_inverse=True)
            distinct = grams[:, first]
            columns = [np.bincount(of_word, m.log_p(distinct)[index], len(new)) for m in self.models] + [np.bincount(of_word, minlength=len(new))]
            self.cache.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            self.scores = np.concatenate([self.scores, np.stack(columns, axis=1)])
        return self.scores[np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))]

    def identify(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Each text's language, score and whether it is rejected."""
        words, index, per_text = words_of(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        total = np.concatenate([np.zeros((1, len(self.langs) + 1)), np.cumsum(self.sums(words)[index], axis=0)])
        ends = np.cumsum(per_text)
        sums = total[ends] - total[ends - per_text]
        signs = np.maximum(sums[:, -1:], 1)
        entropy = -sums[:, :-1] / signs
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(best)), best]
        score = 1 / np.exp(least[:, None] - entropy).sum(axis=1)
        none = per_text == 0
        limit = np.array(self.limit)[best] + SIGMAS * np.array(self.spread)[best] / np.sqrt(signs[:, 0])
        return ["und" if z else self.langs[b] for z, b in zip(none.tolist(), best.tolist())], np.where(none, 0.0, score), none | (least > limit)


class TableIdentifier:
    """The same models as tables that are joined with n-grams; only what is bounded by the number of languages is collected."""

    def __init__(self, grams: DataFrame):
        """grams: lang, gram, n, a written table."""
        spark = grams.sparkSession
        self.langs = sorted(r[0] for r in grams.select("lang").distinct().collect())
        vocabulary = grams.agg(F.countDistinct(F.substring("gram", ORDER, 1))).first()[0]
        self.floor = 1.0 / max(vocabulary, 1)
        level, self.levels = grams.select("lang", "gram", F.col("n").alias("c")), []
        for k in range(ORDER, 0, -1):
            found = level.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).collect()
            discounts = spark.createDataFrame([(r["lang"], float(discount_of(r["once"], r["twice"]))) for r in found], "lang string, d double")
            contexts = level.groupBy("lang", F.substring("gram", 1, k - 1).alias("context")).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
            contexts = contexts.join(F.broadcast(discounts), "lang").select("lang", "context", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("weight"))
            contexts = scratch(spark, contexts, "language-contexts")
            own = level.withColumn("context", F.substring("gram", 1, k - 1)).join(contexts, ["lang", "context"])
            own = scratch(spark, own.select("lang", "gram", "c", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("own")), "language-own")
            self.levels.append((k, own.select("lang", F.col("gram").alias("tail"), "own"), contexts.select("lang", "context", "weight")))
            level = own.groupBy("lang", F.substring("gram", 2, k - 1).alias("gram")).agg(F.count("*").alias("c"))
        seen = grams.select("gram").distinct()
        bits = -F.col("log_p")
        per_pair = grams.select(F.col("lang").alias("of"), "gram", "n").join(self.log_p(seen), "gram").groupBy("of", "lang")
        stats = per_pair.agg(*(F.sum(F.col("n") * x) for x in (F.lit(1), bits, bits * bits))).collect()
        mean = {(of, lang): x / n for of, lang, n, x, _ in stats}
        self.limit = dict(zip(self.langs, limits_of(self.langs, mean)))
        self.spread = {of: float(np.sqrt(max(xx / n - (x / n) ** 2, 0.0))) for of, lang, n, x, xx in stats if of == lang}

    def log_p(self, grams: DataFrame) -> DataFrame:
        """gram, lang, log_p of each distinct n-gram by each model."""
        langs = F.explode(F.array(*map(F.lit, self.langs))).alias("lang")
        out = grams.select("gram", langs).withColumn("p", F.lit(self.floor))
        for k, own, contexts in reversed(self.levels):
            out = out.withColumns({"tail": F.substring("gram", ORDER + 1 - k, k), "context": F.substring("gram", ORDER + 1 - k, k - 1)})
            out = out.join(own, ["lang", "tail"], "left").join(contexts, ["lang", "context"], "left")
            p = F.when(F.col("weight").isNotNull(), F.col("weight") * F.col("p") + F.coalesce("own", F.lit(0.0))).otherwise(F.col("p"))
            out = out.select("gram", "lang", p.alias("p"))
        return scratch(grams.sparkSession, out.select("gram", "lang", F.log("p").alias("log_p")), "language-log-p")

    def identify(self, texts: DataFrame) -> DataFrame:
        """digest, lang_pred, score, rejected of each distinct text that has a letter. texts: digest, text."""
        spark = texts.sparkSession

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in byte_groups(batch.column(1), GROUP):
                    words, index, per_text = words_of(batch.column(1).slice(a, b - a))
                    pairs, n = np.unique(np.repeat(np.arange(b - a), per_text) * len(words) + index, return_counts=True)
                    of = pa.array(pairs // max(len(words), 1))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(of), pa.array(words, pa.string()).take(pa.array(pairs % max(len(words), 1))), pa.array(n)], ["digest", "word", "n"])

        words = scratch(spark, texts.mapInArrow(run, "digest string, word string, n long").dropDuplicates(["digest", "word"]), "language-words")
        padded = F.concat(F.lit(chr(BEGIN) * (ORDER - 1)), "word", F.lit(chr(END)))
        every = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))
        of_word = words.select("word").distinct().select("word", F.explode(every).alias("gram"))
        of_word = of_word.join(self.log_p(of_word.select("gram").distinct()), "gram").groupBy("word", "lang").agg(F.sum("log_p").alias("log_p"), F.count("*").alias("signs"))
        sums = words.join(scratch(spark, of_word, "language-word-sums"), "word").groupBy("digest", "lang").agg(F.sum(F.col("n") * F.col("log_p")).alias("s"), F.sum(F.col("n") * F.col("signs")).alias("signs"))
        entropy = F.collect_list(F.struct((-F.col("s") / F.col("signs")).alias("e"), "lang"))  # one for each language
        out = sums.groupBy("digest").agg(entropy.alias("all"), F.first("signs").alias("signs")).withColumn("best", F.array_min("all"))
        score = 1 / F.aggregate("all", F.lit(0.0), lambda t, x: t + F.exp(F.col("best.e") - x["e"]))
        of_lang = lambda values: F.element_at(F.create_map(*(F.lit(v) for x in self.langs for v in (x, values[x]))), F.col("best.lang"))
        rejected = F.col("best.e") > of_lang(self.limit) + SIGMAS * of_lang(self.spread) / F.sqrt("signs")
        return out.select("digest", F.col("best.lang").alias("lang_pred"), score.alias("score"), rejected.alias("rejected"))


def train(rows: DataFrame) -> Identifier | TableIdentifier:
    """Models of all non-null langs of the rows (text, lang)."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    grams = scratch(rows.sparkSession, count_grams(rows.select("text", "lang")), "language-grams")
    if grams.count() > BROADCAST_GRAMS:
        return TableIdentifier(grams)
    found = grams.toArrow()
    return Identifier(np.array(found["lang"].to_pylist(), object), found["gram"].to_pylist(), found["n"].to_numpy())


def _joined(df: DataFrame, identifier: TableIdentifier, text_col: str, names: dict[str, str]) -> DataFrame:
    """df with the columns that names gives to lang_pred, score and rejected."""
    digest = fresh(df, "digest")
    texts = df.where(F.col(text_col).isNotNull()).select(F.md5(text_col).alias("digest"), F.col(text_col).alias("text"))
    found = scratch(df.sparkSession, identifier.identify(texts), "language-found").withColumnsRenamed({"digest": digest} | names)
    out = df.withColumn(digest, F.md5(text_col)).join(found, digest, "left").drop(digest)
    missing = {"lang_pred": "und", "score": 0.0, "rejected": True}
    return out.withColumns({own: F.coalesce(own, F.lit(missing[k])) for k, own in names.items()})


def identify_languages(df: DataFrame, identifier: Identifier | TableIdentifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, rejected of every row."""
    read = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if isinstance(identifier, TableIdentifier):
        return _joined(read, identifier, "text", {k: k for k in ("lang_pred", "score", "rejected")}).drop("text").withColumnRenamed("id", id_col)
    model = df.sparkSession.sparkContext.broadcast(identifier)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_groups(batch.column(1), GROUP):
                langs, score, rejected = model.value.identify(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

    return read.mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def keep_identified(df: DataFrame, identifier: Identifier | TableIdentifier, text_col: str = "text") -> DataFrame:
    """The rows that identification does not reject, with all their columns."""
    if isinstance(identifier, TableIdentifier):
        names = {k: fresh(df, k + "_found") for k in ("lang_pred", "score", "rejected")}
        return _joined(df, identifier, text_col, names).where(~F.col(names["rejected"])).select(*df.columns)
    model = df.sparkSession.sparkContext.broadcast(identifier)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_groups(batch.column(at), GROUP):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(~model.value.identify(part.column(at))[2]))

    return df.mapInArrow(run, df.schema)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(crc32_mod(id_col, folds) == 0, F.lit(False))


def train_on_documents(docs: DataFrame) -> Identifier:
    return train(docs.where(crc32_mod("doc_id", 5) != 0).select("text", "lang"))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify_languages(docs, train_on_documents(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.round("score", 6).alias("score"), "rejected")


def _oracle_sql() -> str:
    """The same query for an engine that runs on one machine: counts, Kneser-Ney levels, calibration, scores."""
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"
    words = r"list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}]+', ' ', 'g')), ' '), lambda x: x <> '')"
    every = f"unnest(list_transform(range(1, len(word) + 2), lambda i: substr(repeat(chr({BEGIN}), {ORDER - 1}) || word || chr({END}), i, {ORDER}))) AS g"
    ctes = [
        f"d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce({crc} % 5 = 0, false) AS held, doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL AS known, {words} AS w FROM documents)",
        "u AS MATERIALIZED (SELECT rid, lang, held, known, unnest(w) AS word FROM d)",
        f"k{ORDER} AS MATERIALIZED (SELECT lang, g, CAST(sum(n) AS DOUBLE) AS c FROM (SELECT lang, n, {every} FROM (SELECT lang, word, count(*) AS n FROM u WHERE known AND NOT held GROUP BY ALL)) GROUP BY ALL)",
    ]
    for k in range(ORDER - 1, 0, -1):
        ctes.append(f"k{k} AS MATERIALIZED (SELECT lang, substr(g, 2) AS g, CAST(count(*) AS DOUBLE) AS c FROM k{k + 1} GROUP BY ALL)")
    ctes += [
        f"langs AS (SELECT DISTINCT lang FROM k{ORDER})",
        f"aw AS MATERIALIZED (SELECT word, {every} FROM (SELECT DISTINCT word FROM u))",
        f"p0 AS (SELECT g, lang, 1.0::DOUBLE / (SELECT count(DISTINCT right(g, 1)) FROM k{ORDER}) AS p FROM (SELECT g FROM aw UNION SELECT g FROM k{ORDER}), langs)",
    ]
    for k in range(1, ORDER + 1):
        tail, context = f"substr(p{k - 1}.g, {ORDER + 1 - k}, {k})", f"substr(p{k - 1}.g, {ORDER + 1 - k}, {k - 1})"
        ctes += [
            f"e{k} AS (SELECT lang, CASE WHEN once > 0 AND twice > 0 THEN once / (once + 2 * twice) ELSE 0.5 END AS d FROM (SELECT lang, (count(*) FILTER (WHERE c = 1))::DOUBLE AS once, (count(*) FILTER (WHERE c = 2))::DOUBLE AS twice FROM k{k} GROUP BY 1))",
            f"c{k} AS (SELECT lang, substr(g, 1, {k - 1}) AS context, sum(c) AS total, any_value(d) AS d, any_value(d) * count(*) / sum(c) AS weight FROM k{k} JOIN e{k} USING (lang) GROUP BY ALL)",
            f"o{k} AS (SELECT k{k}.lang, g AS tail, greatest(c - d, 0) / total AS own FROM k{k} JOIN c{k} ON c{k}.lang = k{k}.lang AND context = substr(g, 1, {k - 1}))",
            f"p{k} AS MATERIALIZED (SELECT p{k - 1}.g, p{k - 1}.lang, CASE WHEN weight IS NULL THEN p ELSE weight * p + coalesce(own, 0) END AS p FROM p{k - 1} LEFT JOIN o{k} ON o{k}.lang = p{k - 1}.lang AND tail = {tail} LEFT JOIN c{k} ON c{k}.lang = p{k - 1}.lang AND context = {context})",
        ]
    ctes += [
        f"m AS (SELECT a.lang AS of_lang, p.lang, sum(c * -ln(p)) / sum(c) AS mean, sqrt(greatest(sum(c * ln(p) * ln(p)) / sum(c) - (sum(c * ln(p)) / sum(c)) ** 2, 0)) AS spread FROM k{ORDER} a JOIN p{ORDER} p USING (g) GROUP BY ALL)",
        "l AS (SELECT of_lang AS lang, coalesce((any_value(mean) FILTER (WHERE of_lang = lang) + min(mean) FILTER (WHERE of_lang <> lang)) / 2, any_value(mean) FILTER (WHERE of_lang = lang) + 1) AS least, any_value(spread) FILTER (WHERE of_lang = lang) AS spread FROM m GROUP BY 1)",
        f"ws AS MATERIALIZED (SELECT word, lang, sum(ln(p)) AS s, count(*) AS signs FROM aw JOIN p{ORDER} USING (g) GROUP BY ALL)",
        "t AS (SELECT rid, ws.lang, -sum(n * s) / sum(n * signs) AS e, sum(n * signs) AS signs FROM (SELECT rid, word, count(*) AS n FROM u GROUP BY ALL) JOIN ws USING (word) GROUP BY ALL)",
        "b AS (SELECT rid, min({'e': e, 'lang': lang}) AS best, any_value(signs) AS signs, list(e) AS every FROM t GROUP BY 1)",
        f"f AS (SELECT rid, best.lang AS lang_pred, round(1 / list_sum(list_transform(every, lambda x: exp(best.e - x))), 6) AS score, best.e > least + {SIGMAS} * spread / sqrt(signs) AS rejected FROM b JOIN l ON l.lang = best.lang)",
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, held AS held_out, coalesce(lang_pred, 'und') AS lang_pred, coalesce(score, 0) AS score, coalesce(rejected, true) AS rejected FROM d LEFT JOIN f USING (rid)"


ORACLE_SQL = _oracle_sql()
