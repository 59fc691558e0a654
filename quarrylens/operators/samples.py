"""Sample rows whose keys hold: tables in the order of their foreign keys, parents' keys dealt out by number.

Tables are placed in layers: a table comes after all that its foreign keys refer to; where keys go in a circle, one of
them is cut. Row i of a child takes its parent's key number i modulo their count. Keys are numbered in their order by
sorted ranges and the ranges' offsets, so no task ever sees them all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.session import scratch

#: Fixed name endings of one-letter columns that hold Y or N.
YES_NO = r"(?i).*(_YN|YN|_FLAG|_FL)$"


@dataclass(frozen=True)
class SampleColumn:
    """A column to fill: kind is text, number, boolean, date or timestamp; allowed lists its CHECK or ENUM domain."""

    name: str
    kind: str
    length: int = 0
    scale: int = 0
    key: bool = False
    allowed: tuple[str, ...] = ()


@dataclass(frozen=True)
class Reference:
    """A foreign key: columns refer to ref_columns of table ref."""

    columns: tuple[str, ...]
    ref: str
    ref_columns: tuple[str, ...]


@dataclass(frozen=True)
class SampleTable:
    name: str
    columns: tuple[SampleColumn, ...]
    references: tuple[Reference, ...] = ()
    rows: int = 0
    cut: tuple[Reference, ...] = ()


def layers(tables: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """table_name and layer of every table, and the keys that are cut.

    tables: table_name; keys: table_name, name, ref_table. References to a table itself or to tables that are not listed do
    not count. A table's layer is one more than the highest it refers to. Where none of the tables left can be placed, keys
    go in a circle: of the tables whose references are most placed already, the first by name has its other keys cut."""
    spark = tables.sparkSession
    names = tables.select("table_name").distinct()
    edges = keys.where("table_name <> ref_table").join(names, "table_name", "left_semi").join(names.withColumnRenamed("table_name", "ref_table"), "ref_table", "left_semi")
    edges = scratch(spark, edges.select("table_name", "name", "ref_table").distinct(), "layer-keys")
    left, placed, cut, layer = names, None, edges.limit(0), 0
    while True:
        waiting = edges.groupBy("table_name").agg(F.count("*").alias("n"))
        free = left.join(waiting, "table_name", "left_anti")
        if free.isEmpty():
            if left.isEmpty():
                break
            first = waiting.orderBy("n", "table_name").limit(1).select("table_name")
            loose = scratch(spark, edges.join(first, "table_name", "left_semi"), "layer-cut")
            cut = cut.union(loose.select(*cut.columns))
            edges = scratch(spark, edges.join(first, "table_name", "left_anti"), "layer-keys")
            continue
        free = scratch(spark, free.select("table_name", F.lit(layer).alias("layer")), "layer")
        placed = free if placed is None else placed.union(free)
        left = scratch(spark, left.join(free, "table_name", "left_anti"), "layer-left")
        edges = scratch(spark, edges.join(free.select(F.col("table_name").alias("ref_table")), "ref_table", "left_anti").select("table_name", "name", "ref_table"), "layer-keys")
        layer += 1
    return (placed if placed is not None else names.select("table_name", F.lit(0).alias("layer"))), cut


def numbered(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """df with `number`, the place of each row in the order from 0, and their count."""
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    rows = scratch(spark, df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at), "numbered")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(tuple(r) for r in rows.groupBy(part.alias("part")).count().collect())  # a row for each partition
    first, starts = 0, []
    for k, n in sizes:
        starts.append((k, first))
        first += n
    offsets = spark.createDataFrame(starts, "part long, first long")
    out = rows.join(F.broadcast(offsets), part == F.col("part")).withColumn("number", F.col("first") + within)
    return out.drop("at", "part", "first"), first


def value(c: SampleColumn, i: Column) -> Column:
    """The value of a column in row i (from 0): its domain in turn; or numbers, words with numbers, and days that go back."""
    if c.allowed:
        return F.element_at(F.array(*map(F.lit, c.allowed)), (i % len(c.allowed) + 1).cast("int"))
    if c.kind == "boolean":
        return i % 2 == 0
    if c.kind in ("date", "timestamp"):
        return F.date_sub(F.lit("2024-01-01").cast("date"), i.cast("int")).cast(c.kind)
    if c.kind == "number":
        if c.key:
            return i + 1
        part = 10 ** min(c.scale, 9)
        whole = 0 if c.length and c.length <= c.scale else max(1, min((c.length or 4) - c.scale, 9))
        number = i % (10**whole - 1) + 1 if whole else F.lit(0)
        return ((number * part + (i + 1) % part).cast("decimal(20,0)") / part).cast(f"decimal(20,{min(c.scale, 9)})") if c.scale else number
    number = F.lpad((i + 1).cast("string"), 3, "0")
    number = F.when(i >= 999, (i + 1).cast("string")).otherwise(number)
    most = c.length or 30
    if most == 1 and re.match(YES_NO, c.name):
        return F.when(i % 2 == 0, "Y").otherwise("N")
    word = F.left(F.concat(F.left(F.lit(c.name.upper()), F.greatest(F.lit(1), F.lit(most - 1) - F.length(number))), F.lit("_"), number), F.lit(most))
    if c.key:
        word = F.when(F.length(number) + 2 > most, F.lpad((i + 1).cast("string"), most, "0")).otherwise(word)
    return F.when(F.length(number) >= most, F.right(number, F.lit(most))).otherwise(word)


def sample_table(spark: SparkSession, t: SampleTable, parents: dict[str, DataFrame]) -> DataFrame:
    """The table's rows. Columns of a reference take the parent's keys in turn; those of a cut reference, or of a parent without rows, are null."""
    rows = spark.range(t.rows).withColumnRenamed("id", "i")
    taken: dict[str, Column] = {}
    for n, r in enumerate(t.references):
        known = parents[r.ref].select(*(F.col(c).alias(f"key{n}_{k}") for k, c in enumerate(r.ref_columns))).distinct() if r.ref in parents and r not in t.cut else None
        if known is not None:
            keys, count = numbered(known.dropna(), *known.columns)
            if count:
                rows = rows.withColumn("number", F.col("i") % count).join(keys.where(F.col("number") < t.rows), "number", "left").drop("number")
                taken |= {c: F.col(f"key{n}_{k}") for k, c in enumerate(r.columns)}
                continue
        taken |= {c: F.lit(None) for c in r.columns}
    return rows.select(*(taken.get(c.name, value(c, F.col("i"))).alias(c.name) for c in t.columns))


def domains(checks: DataFrame) -> DataFrame:
    """table_name, name and allowed (texts) of the CHECK conditions and ENUM types that list a column's values.

    checks: table_name, name (of a column, or null), condition: `x IN (...)`, `x = ANY (ARRAY[...])`, `x = 'a' OR x = 'b'`, `x BETWEEN 1 AND 5` (whole
    numbers, a thousand of them at most), or a type `enum('a','b')` or `set(...)`. Conditions that say something else give no row."""
    text = F.trim(F.regexp_replace(F.regexp_replace("condition", r"^[\s(]+", ""), r"::[a-zA-Z ]+(\[\])?", ""))
    column = F.regexp_extract(text, r'^["`\[]?(\w+)', 1)
    listed = text.rlike(r"""(?i)^["`\[]?\w+["`\]]?\s+in\s*\([^()]*\)\s*\)*$""") | text.rlike(r"(?i)^((enum|set)\s*\([^()]*\)$|\W?\w+\W*=\s*any\s*\(+array\[)")
    equal = text.rlike(r"""(?i)^["`\[]?(\w+)["`\]]?\s*=\s*('([^']|'')*'|-?\d+)(\s+or\s+["`\[]?\1["`\]]?\s*=\s*('([^']|'')*'|-?\d+))*\s*\)*$""")
    between = r"(?i)^[\"`\[]?\w+[\"`\]]?\s+between\s+(-?\d{1,9})\s+and\s+(-?\d{1,9})\s*\)*$"
    body = F.when(listed, F.regexp_extract(text, r"[(\[](.*)$", 1)).when(equal, text)
    tokens = F.regexp_extract_all(body, F.lit(r"('(?:[^']|'')*'|(?<![\w'])-?\d+(?:\.\d+)?(?!\w))"), F.lit(1))
    literal = F.transform(tokens, lambda x: F.when(x.startswith("'"), F.replace(F.regexp_replace(x, "^'|'$", ""), F.lit("''"), F.lit("'"))).otherwise(x))
    low, high = F.regexp_extract(text, between, 1).cast("int"), F.regexp_extract(text, between, 2).cast("int")
    whole = F.when(text.rlike(between) & (low <= high) & (high - low < 1000), F.transform(F.sequence(low, high), lambda x: x.cast("string")))
    named = F.when(text.rlike(r"(?i)^(enum|set)\s*\("), F.col("name")).otherwise(F.coalesce("name", column))
    return checks.select("table_name", named.alias("name"), F.coalesce(literal, whole).alias("allowed")).where("size(allowed) > 0")


def _lcm(a: Column, b: Column) -> Column:
    """The least common multiple of two positive numbers, by Euclid's steps (92 are enough for 64 bits)."""
    divisor = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("x"), b.alias("y")), lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.greatest(s["y"], F.lit(1))).alias("y"))))
    return (a.cast("decimal(38,0)") / F.greatest(divisor["x"], F.lit(1))).cast("decimal(38,0)") * b


def key_overlaps(keys: DataFrame, sizes: DataFrame, rows: Column | int) -> DataFrame:
    """table_name, columns, combos: keys whose values repeat within so many rows, as their columns' domains in turn only give
    combos (the least common multiple of their sizes) different ones. Keys with a column of no known domain never repeat.

    keys: table_name, columns; sizes: table_name, name, n (values of the domain). A key that is listed twice counts once."""
    each = keys.select("table_name", "columns").distinct().select("table_name", "columns", F.explode("columns").alias("name"))
    found = each.join(sizes.select("table_name", "name", "n"), ["table_name", "name"], "left").groupBy("table_name", "columns")
    found = found.agg(F.collect_list("n").alias("ns"), F.count("*").alias("all"))
    combos = F.aggregate("ns", F.lit(1).cast("decimal(38,0)"), lambda a, b: F.least(_lcm(a.cast("long"), b.cast("long")), F.lit(10**18).cast("decimal(38,0)")))
    return found.where("size(ns) = all").select("table_name", "columns", combos.cast("long").alias("combos")).where(F.col("combos") < rows)
