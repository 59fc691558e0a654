import random

import duckdb

from quarrylens.plans import registry


def test_finding_order_of_equal_findings(spark, tmp_path):
    """Many findings of equal place over many files, as rules in and out of the list and missing values: in the order of the SQL, row by row."""
    kinds = [("LARGE TIN", "B", "x", 3), ("LARGE TIN", "B", None, 3), ("TIN", None, "x", 12), ("STEEL", "B", "x", None), ("SMALL", "A", "w", 12), (None, "A", "w", 3)]
    rows = [(k, *kinds[k % 6 if k > 40 else k % 2]) for k in range(1, 121)]
    random.Random(4).shuffle(rows)
    spark.createDataFrame(rows, "p_partkey long, p_type string, p_brand string, p_name string, p_size int").repartition(7).write.parquet(str(tmp_path / "part.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    wanted = [r[0] for r in duck.execute(registry.oracle_sql()["finding_order"]).fetchall()]
    assert [r.p_partkey for r in registry.queries()["finding_order"](spark, str(tmp_path)).collect()] == wanted


def test_table_sizes_of_large_and_unknown_sources(spark, tmp_path):
    """Sizes from 1024 MB on stay MB, halves go to the even decimal, and a source of missing texts has no size."""
    sizes = [("large", 6_000_000), ("large", 6_000_000), ("edge", 10_737_419), ("half", 65_536), ("odd", 3 * 65_536), ("small", 1), ("empty", 0), ("none", None), (None, 65_536)]
    rows = spark.createDataFrame(sizes, "source string, n int").selectExpr("source", "repeat('x', n) as text")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    wanted = set(duck.execute(registry.oracle_sql()["table_sizes"]).fetchall())
    assert ("large", "1144.4 MB") in wanted and ("half", "6.2 MB") in wanted and ("none", None) in wanted
    assert {tuple(r) for r in registry.queries()["table_sizes"](spark, str(tmp_path)).collect()} == wanted
