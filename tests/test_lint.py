from pyspark.sql import functions as F

from quarrylens.operators import limits, lint


def test_index_rules_of_a_wide_table(spark):
    """30,000 columns with some 60,000 keys and references in one table: no index may meet all keys of its table (that takes many minutes)."""
    i, n = F.col("id"), 30_000
    of = lambda prefix, where, *columns: spark.range(1, n).where(where).select(F.lit("T").alias("table_name"), F.concat(F.lit(prefix), "id").alias("name"), F.array(*columns).alias("columns"))
    column = F.concat(F.lit("C"), i)
    constraints = of("FK", "id % 3 = 0", column).withColumn("kind", F.lit("FK")).union(of("UQ", "id % 10 = 0", column).withColumn("kind", F.lit("UQ")))
    indexes = of("IX", "id % 2 = 0", column).union(of("IX2_", "id % 4 = 0", column, F.lit("C0"))).withColumn("is_unique", F.lit(False))
    found = limits.within(spark, 60, lambda: {f: sorted(r.detail for r in f(constraints, indexes).collect()) for f in (lint.fk_no_index, lint.covered_index)})
    assert found[lint.fk_no_index] == sorted(f"C{k}" for k in range(1, n) if k % 6 == 3)
    assert found[lint.covered_index] == sorted(f"IX{k}" for k in range(1, n) if k % 4 == 0 or k % 10 == 0)


def test_covered_indexes_of_odd_keys(spark):
    """Unique indexes, repeated and missing names, missing flags and indexes of no columns."""
    constraints = spark.createDataFrame([("T", "U", "UQ", ["A"]), ("T", None, "UQ", ["D"]), ("V", "P", "PK", ["A"])], "table_name string, name string, kind string, columns array<string>")
    indexes = [
        ("T", "I1", False, ["A"]), ("T", "I2", True, ["A"]), ("T", "U", False, ["A"]), ("T", "I3", True, ["B"]), ("T", "I4", False, ["B"]), ("T", "I5", True, ["B", "C"]), ("T", "I6", None, ["B", "C"]),
        ("T", "I7", False, ["D"]), ("T", None, False, ["A"]), ("V", "P", False, ["A"]), ("V", "E", False, []), ("W", "E", False, []), ("W", "N", False, None), ("W", "X1", False, ["A"]), ("W", "X2", False, ["A"]),
    ]
    indexes = spark.createDataFrame(indexes, "table_name string, name string, is_unique boolean, columns array<string>")
    found = {(r.table_name, r.detail) for r in lint.covered_index(constraints, indexes).collect()}
    assert found == {("T", "I1"), ("T", "I2"), ("T", "U"), ("T", "I4"), ("V", "E"), ("W", "E"), ("W", "X2")}
