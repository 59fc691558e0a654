"""The naming audit: comments, unknown parts of names, abbreviations outside the standard, and domain specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.text import js_trim, remove_spaces
from quarrylens.operators import naming
from quarrylens.operators.definitions import filled

RULES = ("NO_COMMENT", "UNMATCHED_TOKEN", "NON_STANDARD_ABBR", "DOMAIN_SPEC")


def audit(columns: DataFrame, words: DataFrame, domains: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """table_name, name, rule, detail. columns: table_name, name, comment, native_type, length; domains: concept, native_type, length.

    COMMENT_MISMATCH (off unless named) compares comments with names that were found whole, without spaces."""
    logical = naming.logical_names(columns, "name", words).withColumnRenamed("name", "key")
    rows = columns.withColumn("key", F.upper("name")).join(logical, "key", "left")
    standard = words.where("kind = 'word'").select(F.upper("abbr").alias("token")).distinct()
    others = words.where("kind <> 'word'").select(F.upper("abbr").alias("token")).distinct().join(standard, "token", "left_anti")
    odd = naming.tokens(columns, "name").join(others, "token", "left_semi").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("p"))
    odd = odd.select(F.col("name").alias("key"), F.array_join(F.array_distinct(F.transform("p", lambda x: x["token"])), ",").alias("detail"))
    concepts = naming.longest_suffix(rows.select("logical"), "logical", domains).select(F.col("name").alias("low"), "concept")
    specs = domains.select(F.lower("concept").alias("concept"), F.upper("native_type").alias("t"), F.col("length").alias("n")).distinct()
    typed = rows.withColumn("low", F.lower("logical")).join(concepts, "low").withColumns({"t": F.upper("native_type"), "n": F.col("length")})
    fits = typed.alias("x").join(specs.alias("s"), (F.col("x.concept") == F.col("s.concept")) & (F.col("x.t") == F.col("s.t")) & F.col("x.n").eqNullSafe(F.col("s.n")), "left_anti")
    found = {
        "NO_COMMENT": rows.where(~filled(F.col("comment"))).select("table_name", "name", F.lit("").alias("detail")),
        "COMMENT_MISMATCH": rows.where(filled(F.col("comment")) & (F.col("missing") == "") & (remove_spaces(js_trim(F.col("comment"))) != remove_spaces(F.col("logical")))).select("table_name", "name", F.col("logical").alias("detail")),
        "UNMATCHED_TOKEN": rows.where("missing <> ''").select("table_name", "name", F.col("missing").alias("detail")),
        "NON_STANDARD_ABBR": rows.select("table_name", "name", "key").join(odd, "key").select("table_name", "name", "detail"),
        "DOMAIN_SPEC": fits.select("table_name", "name", F.concat_ws(" ", "concept", "t", F.col("n").cast("string")).alias("detail")),
    }
    out = None
    for rule in rules:
        one = found[rule].select("table_name", "name", F.lit(rule).alias("rule"), "detail")
        out = one if out is None else out.union(one)
    return out
