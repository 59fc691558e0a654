"""Standard words, domains and their coverage: what a naming run used of its dictionaries, and the grades of document columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.naming import PRIORITY

#: Fixed labels of the dictionaries, in the order in which a word's sources are listed.
LABELS = (("word", "공통표준단어"), ("org", "기관표준단어"), ("user", "사용자입력"))
#: Fixed texts of domains to review.
OTHER_SPEC, NO_CONCEPT = "규격 다름", "개념어 없음"


def word_rows(used: DataFrame, words: DataFrame) -> DataFrame:
    """abbr, word_ko, form_word, source, duplicates of the used tokens (token) that a dictionary has.

    words: kind, abbr, word_ko, form_word. The form-word flag is that of the common entry, if the word came from there and
    has one, else of a common entry with the same Korean word, else N; duplicates lists the dictionaries if several have it."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("kind"))
    entry = words.groupBy(F.upper("abbr").alias("abbr")).agg(
        F.min_by(F.struct("word_ko", "kind"), rank).alias("best"),
        F.max(F.when(F.col("kind") == "word", F.nullif("form_word", F.lit("")))).alias("own_form"),
        F.collect_set("kind").alias("kinds"),
    )
    by_word = words.where("kind = 'word' and coalesce(form_word, '') <> ''").groupBy("word_ko").agg(F.min_by("form_word", "abbr").alias("other_form"))
    found = used.select(F.upper("token").alias("abbr")).distinct().join(entry, "abbr").select("abbr", "best.word_ko", "best.kind", "own_form", "kinds").join(by_word, "word_ko", "left")
    label = lambda kind: F.element_at(F.create_map(*(F.lit(x) for pair in LABELS for x in pair)), kind)
    sources = F.array_compact(F.array(*(F.when(F.array_contains("kinds", k), text) for k, text in LABELS)))
    form = F.coalesce(F.when(F.col("kind") == "word", F.col("own_form")), "other_form", F.lit("N"))
    return found.select("abbr", "word_ko", form.alias("form_word"), label(F.col("kind")).alias("source"), F.when(F.size(sources) > 1, F.array_join(sources, "/")).otherwise("").alias("duplicates"))


def type_code(native_type: Column) -> Column:
    """V for varying texts, C for fixed ones, N for numbers, empty for others."""
    up = F.upper(native_type)
    return F.when(up.rlike("VARCHAR|CHARACTER VARYING"), "V").when(up.contains("CHAR"), "C").when(up.rlike("NUMERIC|DECIMAL|NUMBER|FLOAT|DOUBLE|REAL|INT"), "N").otherwise("")


def domain_rows(columns: DataFrame, concepts: DataFrame, domains: DataFrame) -> DataFrame:
    """key, domain, native_type, length, scale, frequency, review: one row for each domain that typed columns need.

    columns: ordinal, logical, native_type, length, scale; concepts: logical, concept (as of naming.longest_suffix);
    domains: concept, class, domain, native_type, length, scale. A column's key is M with the domain if its concept has
    one of the same type code and sizes (the first by name), W with the concept if it has none, U without a concept."""
    typed = columns.where("coalesce(native_type, '') <> ''").join(concepts.select("logical", "concept"), "logical", "left").withColumn("code", type_code(F.col("native_type")))
    spec = domains.select("concept", type_code(F.col("native_type")).alias("code"), F.col("length").alias("l"), F.col("scale").alias("s"), F.concat_ws("|", "class", "domain").alias("spec"))
    spec = spec.where("code <> ''").groupBy("concept", "code", "l", "s").agg(F.min("spec").alias("spec"))
    same = (typed.concept == spec.concept) & (typed.code == spec.code) & typed.length.eqNullSafe(spec.l) & typed.scale.eqNullSafe(spec.s)
    met = typed.join(spec, same, "left").select("ordinal", typed.concept, "native_type", "length", "scale", "spec")
    size = [F.upper("native_type"), F.coalesce(F.col("length").cast("string"), F.lit("")), F.coalesce(F.col("scale").cast("string"), F.lit(""))]
    key = F.when(F.col("spec").isNotNull(), F.concat_ws("|", F.lit("M"), "spec")).when(F.col("concept").isNotNull(), F.concat_ws("|", F.lit("W"), "concept", *size)).otherwise(F.concat_ws("|", F.lit("U"), *size))
    first = F.min_by(F.struct("native_type", "length", "scale", "spec", "concept"), "ordinal").alias("x")
    grouped = met.groupBy(key.alias("key")).agg(first, F.count("*").alias("frequency"))
    review = F.when(F.col("x.spec").isNotNull(), "").when(F.col("x.concept").isNotNull(), OTHER_SPEC).otherwise(NO_CONCEPT)
    return grouped.select("key", F.coalesce(F.element_at(F.split("x.spec", "\\|"), -1), F.lit("")).alias("domain"), "x.native_type", "x.length", "x.scale", "frequency", review.alias("review"))


def word_use(words: DataFrame, used: DataFrame, abbr: str = "abbr") -> DataFrame:
    """words with `used`: Y if their abbreviation is among the used ones (abbr), else N."""
    marks = used.select(F.upper(F.trim(abbr)).alias("key__")).where("key__ <> ''").distinct().withColumn("used", F.lit("Y"))
    return words.withColumn("key__", F.upper(F.trim(F.col(abbr)))).join(marks, "key__", "left").drop("key__").withColumn("used", F.coalesce("used", F.lit("N")))


def coverage(used: DataFrame, rank: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: words used, unregistered tokens and their occurrences (rank: token, cnt), terms and how many of them match in part or not at all (terms: source as of naming.logical_names)."""
    words = used.select(F.upper("token").alias("t")).distinct().agg(F.count("*").alias("words"))
    missing = rank.where("cnt > 0").agg(F.count("*").alias("missing_tokens"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("missing_occurrences"))
    found = terms.agg(F.count("*").alias("terms"), F.count_if(F.col("source") == "mix").alias("partial"), F.count_if(F.col("source") == "none").alias("unmatched"))
    return words.crossJoin(missing).crossJoin(found)  # three single rows


def grade_counts(grades: DataFrame) -> DataFrame:
    """doc, auto, guess, manual: how many columns of each document are filled how. grades: doc, column, level."""
    return grades.groupBy("doc").agg(*(F.count_if(F.col("level") == x).alias(x) for x in ("auto", "guess")), F.count_if(~F.col("level").isin("auto", "guess")).alias("manual"))
