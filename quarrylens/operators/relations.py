"""Relations between tables that no foreign key declares, inferred from the joins of statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def statement_relations(joins: DataFrame, pks: DataFrame, declared: DataFrame, views: DataFrame) -> DataFrame:
    """strength, child, parent, columns, statements of pairs of tables that statements join and no foreign key declares.

    joins: ns_id, table_a, col_a, table_b, col_b; pks: table_name, columns; declared: child, parent; views: table_name.
    A pair is strong if some statement joins the whole primary key of one side but not of the other, and no statement
    does so the other way round; that side is the parent. Other pairs, and those with a view, are weak: one row for each
    pair of columns, `child` and `parent` in order of name. Joins of tables without pks rows or of a table with itself are left out."""
    up = [F.upper(c).alias(c) for c in ("table_a", "col_a", "table_b", "col_b")]
    rows = joins.select("ns_id", *up).where("table_a <> table_b")
    turned = F.col("table_a") > F.col("table_b")
    side = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    pair = F.struct(side("col_a", "col_b").alias("ca"), side("col_b", "col_a").alias("cb"))
    shapes = rows.select("ns_id", side("table_a", "table_b").alias("a"), side("table_b", "table_a").alias("b"), pair.alias("c")).groupBy("ns_id", "a", "b").agg(F.sort_array(F.collect_set("c")).alias("shape"))
    counts = shapes.groupBy("a", "b", "shape").agg(F.count("*").alias("n"))  # statements join alike: few shapes, however many statements
    known = declared.select(F.least(F.upper("child"), F.upper("parent")).alias("a"), F.greatest(F.upper("child"), F.upper("parent")).alias("b")).distinct()
    keys = pks.select(F.upper("table_name").alias("t"), F.transform("columns", lambda x: F.upper(x)).alias("key"))
    counts = counts.join(known, ["a", "b"], "left_anti").join(keys.select(F.col("t").alias("a"), F.col("key").alias("key_a")), "a").join(keys.select(F.col("t").alias("b"), F.col("key").alias("key_b")), "b")
    views = views.select(F.upper("table_name").alias("v")).distinct()
    whole = lambda key, cols: (F.size(key) > 0) & (F.size(F.array_except(key, cols)) == 0)
    full = counts.withColumns({"full_a": whole("key_a", F.col("shape.ca")), "full_b": whole("key_b", F.col("shape.cb"))})
    some = lambda when: F.sum(F.when(F.expr(when), F.col("n")).otherwise(0))
    pairs = full.groupBy("a", "b", "key_a", "key_b").agg(some("full_a and not full_b").alias("a_parent"), some("full_b and not full_a").alias("b_parent"), F.sum("n").alias("statements"))
    for side_ in ("a", "b"):
        pairs = pairs.join(views.select(F.col("v").alias(side_), F.lit(True).alias(f"view_{side_}")), side_, "left")
    kind = F.when(F.coalesce("view_a", F.lit(False)) | F.coalesce("view_b", F.lit(False)), "weak").when(F.expr("a_parent > 0 and b_parent = 0"), "a").when(F.expr("b_parent > 0 and a_parent = 0"), "b").otherwise("weak")
    pairs = pairs.withColumn("kind", kind)
    strong = pairs.where("kind <> 'weak'").select(
        F.lit("strong").alias("strength"),
        F.when(F.col("kind") == "a", F.col("b")).otherwise(F.col("a")).alias("child"),
        F.when(F.col("kind") == "a", F.col("a")).otherwise(F.col("b")).alias("parent"),
        F.array_join(F.when(F.col("kind") == "a", F.col("key_a")).otherwise(F.col("key_b")), ",").alias("columns"),
        "statements",
    )
    weak = counts.join(pairs.where("kind = 'weak'").select("a", "b"), ["a", "b"], "left_semi").select("a", "b", "n", F.explode("shape").alias("c"))
    weak = weak.groupBy("a", "b", "c.ca", "c.cb").agg(F.sum("n").alias("statements"))
    return strong.union(weak.select(F.lit("weak"), "a", "b", F.concat_ws("=", "ca", "cb"), "statements"))
