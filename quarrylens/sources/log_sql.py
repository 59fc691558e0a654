"""Statements restored from log lines: each `Preparing:` line with the values of the next `Parameters:` line of its thread.

Lines are rows (thread, seq, line); a thread may hold any share of them. They are sorted into ranges of (thread, seq); in
each range a line finds the last statement before it by a window over the range's own lines, and what stood before the
range comes from one row for each range and thread. So no thread is ever one task. Everything is Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.session import scratch

#: Fixed names of types whose values stand in SQL as they are.
RAW_TYPES = ["Integer", "Long", "Short", "Byte", "BigDecimal", "BigInteger", "Double", "Float", "Boolean", "int", "long", "short", "byte", "double", "float", "boolean"]
TYPED = r"^(.*?)\(([A-Za-z_][\w.$]*)\)(?:, )?$"
MISSING, COUNT = "parameters", "count"


def literals(line: Column) -> Column:
    """The SQL literals of a parameter line: `1(Integer), a, b(String), null`. A comma within a value belongs to it if a type follows later."""
    parts = F.regexp_extract_all(F.trim(line), F.lit(r"(null(?:, |$)|.*?\([A-Za-z_][\w.$]*\)(?:, |$)|, |.+?(?:, |$))"), F.lit(1))

    def literal(x: Column) -> Column:
        value = F.when(x.rlike(TYPED), F.regexp_extract(x, TYPED, 1)).otherwise(F.regexp_replace(x, ", $", ""))
        kind = F.regexp_extract(x, TYPED, 2)
        plain = F.when(kind != "", F.element_at(F.split(kind, r"\."), -1).isin(RAW_TYPES)).otherwise(value.rlike(r"^-?\d+(\.\d+)?$"))
        quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
        return F.when(x.rlike("^null(, )?$"), "NULL").when(plain, value).otherwise(quoted)

    return F.transform(parts, literal)


def tokens(sql: Column) -> Column:
    """A statement in parts: quoted texts and names (an open one to the end), question marks, and what is between."""
    return F.regexp_extract_all(sql, F.lit(r"""('(?:[^']|'')*(?:'|$)|"(?:[^"]|"")*(?:"|$)|\?|[^'"?]+)"""), F.lit(1))


def filled(parts: Column, values: Column) -> Column:
    """The parts joined, each question mark replaced by the next value."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))
    put = lambda s, x: F.struct(F.concat(s["text"], F.when(x == "?", F.get(values, s["n"])).otherwise(x)).alias("text"), (s["n"] + (x == "?").cast("int")).alias("n"))
    return F.aggregate(parts, start, put, lambda s: s["text"])


def paired(lines: DataFrame) -> DataFrame:
    """thread, seq, sql and parameters (null if none) of each `Preparing:` line; the first `Parameters:` line before the next statement of its thread counts. lines: thread, seq, line."""
    spark = lines.sparkSession
    sql, parameters = F.regexp_extract("line", r"Preparing:\s?(.*)$", 1), F.regexp_extract("line", r"Parameters:\s?(.*)$", 1)
    is_sql = F.col("line").rlike(r"Preparing:\s?.*$")
    kept = lines.where(is_sql | F.col("line").rlike(r"Parameters:\s?.*$"))
    rows = kept.select("thread", "seq", F.when(is_sql, F.trim(sql)).alias("sql"), F.when(~is_sql, parameters).alias("parameters"))
    rows = scratch(spark, rows.repartitionByRange("thread", "seq").withColumn("range", F.spark_partition_id()), "log-lines")
    own = Window.partitionBy("range", "thread").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("at", F.last(F.when(F.col("sql").isNotNull(), F.col("seq")), ignorenulls=True).over(own))
    ends = rows.where("sql is not null").groupBy("thread", "range").agg(F.max("seq").alias("end"))
    spans = rows.select("thread", "range").distinct().join(ends, ["thread", "range"], "left")
    before = Window.partitionBy("thread").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a thread
    carried = spans.select("thread", "range", F.last("end", ignorenulls=True).over(before).alias("carried"))
    found = near.join(carried, ["thread", "range"]).withColumn("at", F.coalesce("at", "carried"))
    first = F.min_by("parameters", F.when(F.col("parameters").isNotNull(), F.col("seq")))
    return found.where("at is not null").groupBy("thread", "at").agg(F.max("sql").alias("sql"), first.alias("parameters")).withColumnRenamed("at", "seq")


def restored(lines: DataFrame) -> DataFrame:
    """thread, seq, sql, restored and warning of each statement of a log. Where the question marks have no parameter line
    (`parameters`) or another number of values (`count`) the statement stays as it is."""
    parts = tokens(F.col("sql"))
    df = paired(lines).withColumn("parts", parts).withColumn("marks", F.size(F.filter("parts", lambda x: x == "?")))
    df = df.withColumn("values", F.when(F.length(F.trim("parameters")) > 0, literals(F.col("parameters"))).otherwise(F.array().cast("array<string>")))
    warning = F.when(F.col("parameters").isNull() & (F.col("marks") > 0), MISSING).when(F.col("marks") != F.size("values"), COUNT)
    return df.withColumn("warning", warning).select("thread", "seq", "sql", F.when(F.col("warning").isNull(), filled(F.col("parts"), F.col("values"))).otherwise(F.col("sql")).alias("restored"), "warning")
