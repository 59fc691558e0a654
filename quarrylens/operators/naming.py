"""Names and dictionaries: physical names to logical ones by prioritised lookup, token ranks, domains, standard terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dictionaries from the first to ask to the last.
PRIORITY = ("user", "org", "word")


def tokens(names: DataFrame, name: str) -> DataFrame:
    """name, pos, token: the parts of each distinct name between underscores, upper case, empty parts left out."""
    return names.select(F.upper(name).alias("name")).distinct().select("name", F.posexplode(F.split("name", "_")).alias("pos", "token")).where("token <> ''")


def looked_up(parts: DataFrame, words: DataFrame) -> DataFrame:
    """tokens with word_ko and source: the entry of the first dictionary that has the token. words: kind, abbr, word_ko."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("kind"))
    best = words.groupBy(F.upper("abbr").alias("token")).agg(F.min_by(F.struct("word_ko", "kind"), rank).alias("best"))
    return parts.join(best, "token", "left").select("name", "pos", "token", F.col("best.word_ko").alias("word_ko"), F.col("best.kind").alias("source"))


def logical_names(names: DataFrame, name: str, words: DataFrame) -> DataFrame:
    """name, logical, source, missing: words joined, an underscore only between two parts that follow each other unfound.

    source: the dictionary if all parts come from one, multi if from several, mix if some are unfound, none if all are."""
    parts = looked_up(tokens(names, name), words)
    rows = parts.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "word_ko", "source"))).alias("p"))
    piece = lambda x, i: F.when(x["word_ko"].isNotNull(), x["word_ko"]).when((i > 0) & F.get("p", i - 1)["word_ko"].isNull(), F.concat(F.lit("_"), x["token"])).otherwise(x["token"])
    missing = F.transform(F.filter("p", lambda x: x["word_ko"].isNull()), lambda x: x["token"])
    kinds = F.array_distinct(F.filter(F.transform("p", lambda x: x["source"]), lambda x: x.isNotNull()))
    source = F.when(F.size(missing) == F.size("p"), "none").when(F.size(missing) > 0, "mix").when(F.size(kinds) > 1, "multi").otherwise(F.get(kinds, F.lit(0)))
    return rows.select("name", F.array_join(F.transform("p", piece), "").alias("logical"), source.alias("source"), F.array_join(missing, ",").alias("missing"))


def match_statistics(logical: DataFrame) -> DataFrame:
    return logical.groupBy("source").agg(F.count("*").alias("cnt"))


def missing_rank(names: DataFrame, name: str, words: DataFrame) -> DataFrame:
    """token, cnt: occurrences of tokens that no dictionary has, over all rows of names; counted before the lookup."""
    counts = names.groupBy(F.upper(name).alias("name")).agg(F.count("*").alias("n"))
    each = counts.select("n", F.explode(F.split("name", "_")).alias("token")).where("token <> ''").groupBy("token").agg(F.sum("n").alias("cnt"))
    return each.join(words.select(F.upper("abbr").alias("token")).distinct(), "token", "left_anti")


def longest_suffix(names: DataFrame, name: str, concepts: DataFrame) -> DataFrame:
    """name, concept: the longest concept that a name ends with. Suffixes are exploded and equi-joined, so there is no nested loop."""
    low = F.lower(F.col(name))
    tails = names.select(low.alias("name")).distinct().select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("n")).select("name", F.expr("right(name, n)").alias("concept"))
    return tails.join(concepts.select(F.lower("concept").alias("concept")).distinct(), "concept").groupBy("name").agg(F.max_by("concept", F.length("concept")).alias("concept"))


def standard_terms(rows: DataFrame, name: str, order: str) -> DataFrame:
    """name, first_at, cnt: each name once, as it first occurs, with its frequency; a grouping, so no window holds a hot name."""
    key = F.upper(F.col(name))
    return rows.groupBy(key.alias("term")).agg(F.min_by(F.col(name), F.col(order)).alias("name"), F.min(order).alias("first_at"), F.count("*").alias("cnt"))


def domain_rule(native_type: Column, length: Column, scale: Column) -> Column:
    """V20, C10, N13,2: VARCHAR before CHAR before numeric names; null for other types."""
    up = F.upper(native_type)
    number = F.concat(F.lit("N"), length.cast("string"), F.when(scale > 0, F.concat(F.lit(","), scale.cast("string"))).otherwise(""))
    numeric = up.rlike("NUM|DEC|INT|FLOAT|DOUBLE|REAL|MONEY")
    return F.when(up.contains("VARCHAR"), F.concat(F.lit("V"), length.cast("string"))).when(up.contains("CHAR"), F.concat(F.lit("C"), length.cast("string"))).when(numeric, number)


def relation_candidates(columns: DataFrame, pks: DataFrame, crowd: int = 30) -> DataFrame:
    """child, parent, column: a column named and typed like another table's single-column key; a key that over `crowd` tables share is dropped; key to key is reported once."""
    key = F.upper("name").alias("key")
    parent = pks.select(F.col("table_name").alias("parent"), key, F.col("native_type").alias("pt"), F.col("length").alias("pl"))
    child = columns.select(F.col("table_name").alias("child"), key, F.col("native_type").alias("ct"), F.col("length").alias("cl"))
    own = pks.select(F.col("table_name").alias("child"), key, F.lit(True).alias("child_is_key"))
    pairs = child.join(parent, "key").where((F.col("child") != F.col("parent")) & (F.col("ct") == F.col("pt")) & F.col("cl").eqNullSafe(F.col("pl")))
    pairs = pairs.join(own, ["child", "key"], "left").where(F.col("child_is_key").isNull() | (F.col("child") > F.col("parent")))
    shared = pairs.groupBy("key").agg(F.countDistinct("child").alias("n")).where(F.col("n") <= crowd)
    return pairs.join(shared, "key", "left_semi").select("child", "parent", F.col("key").alias("column"))


def first_by_name(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, in full."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("rank__", F.row_number().over(w)).where("rank__ = 1").drop("rank__")
