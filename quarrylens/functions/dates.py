"""Date texts in mixed shapes brought to yyyyMMdd, without ever failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_normalise(c: Column) -> Column:
    """`2018-09-18…` and `2019/03/29…` without their marks, `Mar 29 2019…` by its month, eight leading digits as they are; else null."""
    english = F.regexp_replace(F.regexp_extract(c, r"^([A-Za-z]+ +[0-9]+ +[0-9]+)", 1), " +", " ")
    return (
        F.when(c.rlike("^[0-9]{4}-"), F.left(F.replace(c, F.lit("-"), F.lit("")), F.lit(8)))
        .when(c.rlike("^[0-9]{4}/"), F.left(F.replace(c, F.lit("/"), F.lit("")), F.lit(8)))
        .when(c.rlike("^[A-Za-z]"), F.date_format(F.try_to_timestamp(F.nullif(english, F.lit("")), F.lit("MMM d yyyy")), "yyyyMMdd"))
        .when(c.rlike("^[0-9]{8}"), F.left(c, F.lit(8)))
    )


def date_is_odd(normal: Column) -> Column:
    """Whether a normalised date is missing, or its month or day cannot be."""
    month, day = F.substring(normal, 5, 2), F.substring(normal, 7, 2)
    return normal.isNull() | ~month.between("01", "12") | ~day.between("01", "31")
