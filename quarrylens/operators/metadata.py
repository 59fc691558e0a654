"""Metadata relations: snapshots of table schemas, selection by scope, and structural diffs of two snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.session import table

COLUMN_FIELDS = ("native_type", "length", "precision", "scale", "nullable", "default_value", "comment")
COLUMNS = "schema_name string, table_name string, name string, ordinal int, native_type string, length long, precision int, scale int, nullable boolean, default_value string, comment string"


def columns_of(spark: SparkSession, sf_dir: str, tables: list[str], schema: str = "main") -> DataFrame:
    """The column relation of Parquet tables, from their schemas alone: no data are read. One row a column, on the driver like any catalog."""
    rows = []
    for t in tables:
        for i, f in enumerate(table(spark, sf_dir, t).schema.fields, 1):
            d = f.dataType
            decimal = isinstance(d, T.DecimalType)
            rows.append((schema, t, f.name, i, d.simpleString().upper(), None, d.precision if decimal else None, d.scale if decimal else None, f.nullable, None, None))
    return spark.createDataFrame(rows, COLUMNS)


def row_counts(spark: SparkSession, sf_dir: str, tables: list[str]) -> DataFrame:
    """table_name, row_count: one union of counts, answered from Parquet footers."""
    out = None
    for t in tables:
        one = table(spark, sf_dir, t).agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
        out = one if out is None else out.union(one)
    return out


@dataclass(frozen=True)
class Scope:
    """A selection of tables; names compare without case. An include list leaves excludes aside."""

    schemas: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    pattern: str = ""
    excluded: tuple[str, ...] = ()
    included: tuple[str, ...] = ()
    skip_empty: bool = False

    def reason(self, schema: Column, name: Column, rows: Column) -> Column:
        """Why a table is left out: schema, empty, include, prefix, suffix, pattern or list; '' if it is kept."""
        up = F.upper(name)
        upper = lambda xs: [x.upper() for x in xs]
        chain = F.when(F.lit(False), "")
        if self.schemas:
            chain = chain.when(~F.upper(schema).isin(*upper(self.schemas)), "schema")
        if self.skip_empty:
            chain = chain.when(rows == 0, "empty")  # an unknown count is not zero
        if self.included:
            return chain.when(~up.isin(*upper(self.included)), "include").otherwise("")
        for p in upper(self.prefixes):
            chain = chain.when(up.startswith(p), "prefix")
        for p in upper(self.suffixes):
            chain = chain.when(up.endswith(p), "suffix")
        if self.pattern:
            chain = chain.when(name.rlike(f"(?i){self.pattern}"), "pattern")
        if self.excluded:
            chain = chain.when(up.isin(*upper(self.excluded)), "list")
        return chain.otherwise("")


def table_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """table_name, change: added, removed or common, by table name as it is written."""
    a = old.select("table_name").distinct().withColumn("in_old", F.lit(True))
    b = new.select("table_name").distinct().withColumn("in_new", F.lit(True))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("common")
    return a.join(b, "table_name", "full_outer").select("table_name", change.alias("change"))


def column_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """table_name, name, change, fields: columns added, removed or changed in tables of both snapshots, with the fields that differ."""
    both = old.select("table_name").distinct().join(new.select("table_name").distinct(), "table_name", "left_semi")
    pick = lambda df, tag: df.join(both, "table_name", "left_semi").select("table_name", "name", F.struct(*COLUMN_FIELDS).alias(tag))
    joined = pick(old, "o").join(pick(new, "n"), ["table_name", "name"], "full_outer")
    differing = F.concat_ws(",", *(F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), f) for f in COLUMN_FIELDS))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed")
    out = joined.select("table_name", "name", change.alias("change"), F.when(change == "changed", differing).otherwise("").alias("fields"))
    return out.where("change <> 'changed' or fields <> ''")


def structure(constraints: DataFrame) -> DataFrame:
    """table_name, text: constraints by what they say, not by name; rules that are the default are left out, white space in checks is evened.

    constraints: table_name, kind (PK, FK, UQ, CK, and IX and UX for indexes), columns, ref_table, ref_columns, delete_rule, update_rule, condition."""
    cols, refs = F.array_join("columns", ","), F.array_join("ref_columns", ",")
    rule = lambda c, word: F.when(F.coalesce(F.col(c), F.lit("NO ACTION")).isin("NO ACTION", "RESTRICT"), "").otherwise(F.concat(F.lit(f" ON {word} "), F.col(c)))
    text = (
        F.when(F.col("kind") == "FK", F.concat(F.lit("FK("), cols, F.lit(")->"), F.col("ref_table"), F.lit("("), refs, F.lit(")"), rule("delete_rule", "DELETE"), rule("update_rule", "UPDATE")))
        .when(F.col("kind") == "CK", F.concat(F.lit("CK("), F.trim(F.regexp_replace("condition", r"\s+", " ")), F.lit(")")))
        .otherwise(F.concat(F.col("kind"), F.lit("("), cols, F.lit(")")))
    )
    return constraints.select("table_name", text.alias("text"))


def structure_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """table_name, text, change: structures of one snapshot only."""
    a, b = structure(old).distinct(), structure(new).distinct()
    added = b.join(a, ["table_name", "text"], "left_anti").withColumn("change", F.lit("added"))
    return a.join(b, ["table_name", "text"], "left_anti").withColumn("change", F.lit("removed")).union(added)


def repeated_names(columns: DataFrame) -> DataFrame:
    """Table names that more than one schema has."""
    return columns.select("schema_name", "table_name").distinct().groupBy("table_name").agg(F.count("*").alias("schemas")).where("schemas > 1")
