"""Structure lint over metadata relations: tables, columns, constraints and indexes, names in upper case, views left out.

Every rule returns (rule, table_name, detail). tables: table_name; columns: table_name, name, ordinal, native_type,
length, nullable, default_value; constraints: table_name, name, kind, columns, ref_table, ref_columns;
indexes: table_name, name, is_unique, columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.text import type_normalise
from quarrylens.operators.graphs import strongly_connected

#: Fixed lists: type names that mean the same, and large-object types.
SYNONYMS = {"INT": "INTEGER", "INT4": "INTEGER", "INT8": "BIGINT", "INT2": "SMALLINT", "VARCHAR2": "VARCHAR", "NVARCHAR2": "NVARCHAR", "CHARACTER VARYING": "VARCHAR", "CHARACTER": "CHAR", "BPCHAR": "CHAR", "NUMBER": "NUMERIC", "DECIMAL": "NUMERIC", "FLOAT8": "DOUBLE", "DOUBLE PRECISION": "DOUBLE", "FLOAT4": "REAL", "BOOL": "BOOLEAN", "TIMESTAMPTZ": "TIMESTAMP WITH TIME ZONE", "TIMETZ": "TIME WITH TIME ZONE", "DATETIME": "TIMESTAMP"}
LOBS = ("BLOB", "CLOB", "NCLOB", "LONGBLOB", "MEDIUMBLOB", "LONGTEXT", "MEDIUMTEXT", "BYTEA", "IMAGE", "NTEXT", "XML", "LONG", "LONG RAW", "BFILE", "VARBINARY(MAX)", "VARCHAR(MAX)")


def canonical_type(c: Column) -> Column:
    plain = type_normalise(c)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv)), plain), plain)


def _rule(df: DataFrame, rule: str, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), "table_name", detail.alias("detail"))


def _keys(constraints: DataFrame, indexes: DataFrame) -> DataFrame:
    return constraints.where(F.col("kind").isin("PK", "UQ")).select("table_name", "columns").union(indexes.select("table_name", "columns"))


def _heads(keys: DataFrame) -> DataFrame:
    """keys (columns) once for each beginning of its columns, from none to all of them, as `head`: what starts with some columns is then found by equality."""
    return keys.where("columns is not null").withColumn("n", F.explode(F.sequence(F.lit(0), F.size("columns")))).withColumn("head", F.slice("columns", F.lit(1), F.col("n"))).drop("n")


def fk_no_index(constraints: DataFrame, indexes: DataFrame) -> DataFrame:
    fks = constraints.where("kind = 'FK'").select("table_name", "columns", F.array_sort("columns").alias("head"))
    led = _heads(_keys(constraints, indexes)).select("table_name", F.array_sort("head").alias("head")).distinct()
    return _rule(fks.join(led, ["table_name", "head"], "left_anti"), "fkNoIndex", F.array_join("columns", ","))


def no_relation(tables: DataFrame, constraints: DataFrame) -> DataFrame:
    fks = constraints.where("kind = 'FK'")
    related = fks.select("table_name").union(fks.select("ref_table")).distinct()
    return _rule(tables.join(related, "table_name", "left_anti"), "noRelation", F.lit(""))


def no_index(tables: DataFrame, constraints: DataFrame, indexes: DataFrame) -> DataFrame:
    return _rule(tables.join(_keys(constraints, indexes).select("table_name").distinct(), "table_name", "left_anti"), "noIndex", F.lit(""))


def no_pk(tables: DataFrame, constraints: DataFrame, indexes: DataFrame) -> DataFrame:
    """Tables without a primary key that do have a unique key or an index."""
    pks, keyed = constraints.where("kind = 'PK'"), _keys(constraints, indexes).select("table_name").distinct()
    return _rule(tables.join(pks, "table_name", "left_anti").join(keyed, "table_name", "left_semi"), "noPk", F.lit(""))


def column_counts(columns: DataFrame, most: int) -> DataFrame:
    n = columns.groupBy("table_name").agg(F.count("*").alias("n"))
    many = _rule(n.where(F.col("n") > most), "tooManyColumns", F.col("n").cast("string")) if most else None
    one = _rule(n.where("n = 1"), "singleColumn", F.lit("1"))
    return one if many is None else many.union(one)


def missing_required(tables: DataFrame, columns: DataFrame, required: list[str]) -> DataFrame:
    wanted = tables.select("table_name", F.explode(F.array(*map(F.lit, required))).alias("name"))
    there = columns.select("table_name", F.upper("name").alias("name")).where(F.col("name").isin(required))
    return _rule(wanted.join(there, ["table_name", "name"], "left_anti"), "missingRequired", F.col("name"))


def repeated_relation(constraints: DataFrame) -> DataFrame:
    fks = constraints.where("kind = 'FK'").select("table_name", "ref_table", F.array_join(F.array_sort("columns"), ",").alias("cols"))
    return _rule(fks.groupBy("table_name", "ref_table", "cols").count().where("count > 1"), "dupRelation", F.concat("cols", F.lit("->"), "ref_table"))


def serial_columns(columns: DataFrame) -> DataFrame:
    parts = columns.select("table_name", F.upper(F.regexp_extract("name", r"^(.*[A-Za-z_])([0-9]{1,9})$", 1)).alias("stem")).where("stem <> ''")
    return _rule(parts.groupBy("table_name", "stem").count().where("count >= 3"), "serialColumns", F.col("stem"))


def default_null_text(columns: DataFrame) -> DataFrame:
    return _rule(columns.where(F.trim("default_value").rlike(r"(?i)^'NULL'(::.*)?$")), "defaultNullString", F.col("name"))


def fk_type_mismatch(constraints: DataFrame, columns: DataFrame) -> DataFrame:
    """Foreign-key columns that differ from their parents' in canonical type, else length, else scale (if columns have it). A key that names no parent columns refers to the parent's primary key."""
    pks = constraints.where("kind = 'PK'").select(F.col("table_name").alias("ref_table"), F.col("columns").alias("pk"))
    fks = constraints.where("kind = 'FK'").join(pks, "ref_table", "left").withColumn("refs", F.when(F.size("ref_columns") > 0, F.col("ref_columns")).otherwise(F.col("pk")))
    fks = fks.select("table_name", "ref_table", F.explode(F.arrays_zip(F.col("columns").alias("c"), F.col("refs").alias("p"))).alias("z"))
    scale = F.col("scale") if "scale" in columns.columns else F.lit(None).cast("int")
    side = lambda table, name, p: columns.select(F.col("table_name").alias(table), F.upper("name").alias(name), canonical_type(F.col("native_type")).alias(f"{p}t"), F.col("length").alias(f"{p}l"), scale.alias(f"{p}s"))
    pairs = fks.select("table_name", "ref_table", F.upper("z.c").alias("c"), F.upper("z.p").alias("p")).join(side("table_name", "c", "c"), ["table_name", "c"]).join(side("ref_table", "p", "p"), ["ref_table", "p"])
    what = F.when(F.col("ct") != F.col("pt"), "type").when(~F.col("cl").eqNullSafe(F.col("pl")), "length").when(~F.col("cs").eqNullSafe(F.col("ps")), "scale")
    return _rule(pairs.withColumn("what", what).where("what is not null"), "fkTypeMismatch", F.concat("c", F.lit(" "), "what"))


def covered_index(constraints: DataFrame, indexes: DataFrame) -> DataFrame:
    """Indexes that are a prefix of another key of their table; a unique one only if another unique is identical; of two identical the later name.

    Keys are summed up by their beginnings: the least and the last name tell whether one has another name, so no index meets its table's keys one by one."""
    own = indexes.select("table_name", "name", "is_unique", "columns")
    keys = constraints.where(F.col("kind").isin("PK", "UQ")).select("table_name", F.col("name").alias("other"), F.lit(True).alias("other_unique"), "columns", F.lit(True).alias("constraint"))
    keys = keys.union(indexes.select("table_name", F.col("name").alias("other"), F.col("is_unique").alias("other_unique"), "columns", F.lit(False).alias("constraint")))
    same = F.size("head") == F.size("columns")
    kinds = {"longer": ~same, "key": same & F.col("constraint"), "unique": same & F.col("other_unique"), "plain": same & ~F.col("other_unique")}
    ends = [end(F.when(kind, F.col("other"))).alias(f"{which}_{k}") for k, kind in kinds.items() for which, end in (("least", F.min), ("last", F.max))]
    sums = _heads(keys).groupBy("table_name", "head").agg(*ends).withColumnRenamed("head", "columns")
    another = lambda k: (F.col(f"least_{k}") != F.col("name")) | (F.col(f"last_{k}") != F.col("name"))
    earlier = lambda k: F.col(f"least_{k}") < F.col("name")
    hit = F.when(F.col("is_unique"), another("key") | earlier("unique")).otherwise(another("longer") | another("key") | (~F.col("is_unique") & (another("unique") | earlier("plain"))))
    return _rule(own.join(sums, ["table_name", "columns"]).where(hit).select("table_name", "name").distinct(), "dupIndex", F.col("name"))


def unique_nullable(constraints: DataFrame, columns: DataFrame) -> DataFrame:
    uniques = constraints.where("kind = 'UQ'").select("table_name", F.explode("columns").alias("c"))
    loose = columns.where("nullable").select("table_name", F.upper("name").alias("c"))
    return _rule(uniques.select("table_name", F.upper("c").alias("c")).distinct().join(loose, ["table_name", "c"]), "uniqueNullable", F.col("c"))


def many_lobs(columns: DataFrame) -> DataFrame:
    n = columns.groupBy("table_name").agg(F.count_if(F.upper("native_type").isin(*LOBS)).alias("n"))
    return _rule(n.where("n > 1"), "tooManyLobs", F.col("n").cast("string"))


def fk_cycle(constraints: DataFrame) -> DataFrame:
    """Tables in a cycle of foreign keys of two tables or more: those of a strongly connected component."""
    edges = constraints.where("kind = 'FK'").select(F.col("table_name").alias("a"), F.col("ref_table").alias("b"))
    cyclic = strongly_connected(edges).select(F.col("node").alias("table_name"))
    return _rule(cyclic, "fkCycle", F.lit(""))


def all_rules(tables: DataFrame, columns: DataFrame, constraints: DataFrame, indexes: DataFrame, most_columns: int = 100, required: list[str] | None = None) -> DataFrame:
    found = [
        fk_no_index(constraints, indexes), no_relation(tables, constraints), no_index(tables, constraints, indexes), no_pk(tables, constraints, indexes),
        column_counts(columns, most_columns), repeated_relation(constraints), serial_columns(columns), default_null_text(columns),
        fk_type_mismatch(constraints, columns), covered_index(constraints, indexes), unique_nullable(constraints, columns), many_lobs(columns), fk_cycle(constraints),
    ]
    if required:
        found.append(missing_required(tables, columns, required))
    return reduce(DataFrame.union, found)
