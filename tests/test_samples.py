"""Key-consistent sample rows: layers with circles cut, values by rule, domains of CHECK conditions, overlaps of keys."""

from math import gcd

from pyspark.sql import functions as F

from quarrylens.operators import samples
from quarrylens.operators.samples import Reference, SampleColumn, SampleTable, value


def rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def test_layers(spark):
    tables = spark.createDataFrame([(t,) for t in ("A", "B", "C", "D", "X", "Y", "Z", "ALONE")], "table_name string")
    keys = spark.createDataFrame([("B", "b1", "A"), ("C", "c1", "B"), ("C", "c2", "A"), ("D", "d1", "D"), ("X", "x1", "Y"), ("Y", "y1", "X"), ("Z", "z1", "Y"), ("A", "a1", "ELSEWHERE")], "table_name string, name string, ref_table string")
    placed, cut = samples.layers(tables, keys)
    assert dict(map(tuple, placed.collect())) == {"A": 0, "ALONE": 0, "D": 0, "B": 1, "C": 2, "X": 3, "Y": 4, "Z": 5}
    assert [(r.table_name, r.name) for r in cut.collect()] == [("X", "x1")]
    assert samples.layers(tables.limit(0), keys)[0].count() == 0


def test_values_by_rule(spark):
    df = spark.createDataFrame([(0,), (1,), (998,), (999,), (123456,)], "i long")
    cells = lambda c: [r[0] for r in df.orderBy("i").select(value(c, F.col("i"))).collect()]
    assert cells(SampleColumn("user_name", "text", 10)) == ["USER_N_001", "USER_N_002", "USER_N_999", "USER__1000", "USE_123457"]
    assert cells(SampleColumn("cd", "text", 2)) == ["01", "02", "99", "00", "57"]
    assert cells(SampleColumn("cd", "text", 4, key=True)) == ["0001", "0002", "0999", "1000", "3457"]
    assert cells(SampleColumn("use_yn", "text", 1)) == ["Y", "N", "Y", "N", "Y"]
    assert cells(SampleColumn("n", "number", 3)) == [1, 2, 999, 1, 580]
    assert [str(x) for x in cells(SampleColumn("n", "number", 12, 2))] == ["1.01", "2.02", "999.99", "1000.00", "123457.57"]
    assert [str(x) for x in cells(SampleColumn("n", "number", 2, 2))] == ["0.01", "0.02", "0.99", "0.00", "0.57"]
    assert cells(SampleColumn("x", "text", 5, allowed=("p", "q")))[:3] == ["p", "q", "p"]
    assert [str(x) for x in cells(SampleColumn("d", "date"))][:2] == ["2024-01-01", "2023-12-31"]


def test_keys_hold(spark):
    parent = spark.createDataFrame([(k, m) for k in (5, 3, 9) for m in "ab"] + [(None, "c"), (3, "a")], "k int, m string").repartition(3)
    t = SampleTable("t", (SampleColumn("id", "number", key=True), SampleColumn("pk", "number"), SampleColumn("pm", "text"), SampleColumn("no", "number"), SampleColumn("c", "number")),
                    (Reference(("pk", "pm"), "p", ("k", "m")), Reference(("no",), "empty", ("k",)), Reference(("c",), "p", ("k",))), 14, (Reference(("c",), "p", ("k",)),))
    got = samples.sample_table(spark, t, {"p": parent, "empty": parent.limit(0)})
    keys = [(3, "a"), (3, "b"), (5, "a"), (5, "b"), (9, "a"), (9, "b")]
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(i + 1, *keys[i % 6], None, None) for i in range(14)]


def test_domains(spark):
    checks = [
        ("T", None, "STATUS IN ('A', 'it''s', 'C D')"), ("T", None, "(\"flag\" = 'Y' OR \"flag\" = 'N')"), ("T", None, "level between 2 and 4"), ("T", "kind", "enum('x','y')"), ("T", None, "(((state)::text = ANY (ARRAY['A'::text, 'B'::text])))"),
        ("T", None, "n IN (1, -2)"), ("T", None, "amount > 0"), ("T", None, "a = 'x' OR b = 'y'"), ("T", None, None), ("T", None, "level between 5 and 4"),
    ]
    got = samples.domains(spark.createDataFrame(checks, "table_name string, name string, condition string"))
    assert {r.name: r.allowed for r in got.collect()} == {"STATUS": ["A", "it's", "C D"], "flag": ["Y", "N"], "level": ["2", "3", "4"], "kind": ["x", "y"], "state": ["A", "B"], "n": ["1", "-2"]}


def test_overlaps(spark):
    keys = spark.createDataFrame([("t", ["a", "b"]), ("t", ["a", "b"]), ("t", ["b", "c"]), ("t", ["a", "free"]), ("u", ["a"])], "table_name string, columns array<string>")
    sizes = [("t", "a", 4), ("t", "b", 6), ("t", "c", 35), ("u", "a", 128)]
    got = samples.key_overlaps(keys, spark.createDataFrame(sizes, "table_name string, name string, n long"), 100)
    assert rows(got.select("table_name", F.array_join("columns", ","), "combos")) == [("t", "a,b", "12")]
    pairs = [(x, y) for x in (1, 2, 12, 97, 360, 2**31) for y in (1, 5, 18, 97, 2**20)]
    df = spark.createDataFrame(pairs, "x long, y long").select("x", "y", samples._lcm(F.col("x"), F.col("y")).cast("long").alias("l"))
    assert all(r.l == r.x * r.y // gcd(r.x, r.y) for r in df.collect())
