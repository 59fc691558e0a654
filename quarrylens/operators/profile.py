"""Column profiling: one pass and, where values are grouped, one pre-aggregated shuffle each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.dates import date_is_odd, date_normalise
from quarrylens.functions.text import format_mask

#: Fixed set: values that stand for a missing one.
NULL_LIKE = ("-", ".", "0", "N/A", "NA", "NULL", "없음", "미상", "해당없음", "99999999", "99991231")


def format_profile(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.groupBy(format_mask(c).alias("fmt")).agg(F.count("*").alias("cnt"), F.min(c).alias("sample1"), F.max(c).alias("sample2"))


def null_like(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.where(c.isNull() | (F.trim(c) == "") | F.trim(c).isin(*NULL_LIKE)).groupBy(c.alias("value")).agg(F.count("*").alias("cnt"))


def dirty_characters(df: DataFrame, column: str) -> DataFrame:
    """Counts of values with outer spaces, a full-width space, line ends or tabs, non-digits, and multi-byte signs."""
    c = F.col(column)
    tests = {
        "untrimmed": c != F.trim(c),
        "full_width_space": c.contains("　"),
        "line_or_tab": c.rlike(r"[\n\r\t]"),
        "non_digit": c.rlike("[^0-9]"),
        "multibyte": F.octet_length(c) != F.char_length(c),
    }
    return df.agg(*(F.count_if(t).alias(name) for name, t in tests.items()))


def code_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("code")).agg(F.count("*").alias("cnt"))


def orphan_codes(df: DataFrame, column: str, codes: DataFrame, code: str) -> DataFrame:
    """Values that the code table lacks, with their counts; counted first, so only distinct values are joined."""
    return code_distribution(df, column).join(codes.select(F.col(code).alias("known")).distinct(), F.col("code") == F.col("known"), "left_anti")


def key_duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("cnt")).where("cnt > 1")


def null_keys(df: DataFrame, *keys: str) -> DataFrame:
    missing: Column = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    return df.agg(F.count_if(missing).alias("null_keys"))


def dates(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("value"), date_normalise(F.col(column)).alias("norm_date"))


def odd_dates(df: DataFrame, column: str) -> DataFrame:
    return dates(df, column).where(date_is_odd(F.col("norm_date")))
