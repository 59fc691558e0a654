"""Sample rows in the shape of orders and their lines, with keys of real customers and parts; overlaps of narrow keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators import samples
from quarrylens.operators.samples import Reference, SampleColumn, SampleTable
from quarrylens.session import table

STATES = ("F", "O", "P")
KEYS = [("lineitem", ["l_returnflag", "l_linestatus"]), ("lineitem", ["l_linenumber"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("orders", ["o_orderpriority", "o_orderstatus"]), ("part", ["p_size", "p_brand"])]
NARROW = [("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("lineitem", "l_linenumber"), ("orders", "o_orderpriority"), ("orders", "o_orderstatus"), ("part", "p_size"), ("part", "p_brand")]


def sample_orders(s, d):
    """As many orders as there are, of all customers in turn."""
    columns = (SampleColumn("order_no", "number", key=True), SampleColumn("cust_no", "number"), SampleColumn("status", "text", 1, allowed=STATES), SampleColumn("order_day", "date"), SampleColumn("memo", "text", 12), SampleColumn("use_yn", "text", 1))
    t = SampleTable("orders", columns, (Reference(("cust_no",), "customer", ("c_custkey",)),), table(s, d, "orders").count())
    return samples.sample_table(s, t, {"customer": table(s, d, "customer")})


def sample_lines(s, d):
    """As many lines as there are, of all sample orders and all parts in turn."""
    columns = (SampleColumn("line_no", "number", key=True), SampleColumn("order_no", "number"), SampleColumn("part_no", "number"), SampleColumn("amount", "number", 6, 2))
    references = (Reference(("order_no",), "orders", ("order_no",)), Reference(("part_no",), "part", ("p_partkey",)))
    return samples.sample_table(s, SampleTable("lines", columns, references, table(s, d, "lineitem").count()), {"orders": sample_orders(s, d), "part": table(s, d, "part")})


def overlaps(s, d):
    sizes = [table(s, d, t).agg(F.countDistinct(c).alias("n")).select(F.lit(t).alias("table_name"), F.lit(c).alias("name"), "n") for t, c in NARROW]
    rows = [table(s, d, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), "rows") for t in ("lineitem", "orders", "part")]
    keys = s.createDataFrame(KEYS, "table_name string, columns array<string>").join(reduce(DataFrame.union, rows), "table_name")
    found = samples.key_overlaps(keys, reduce(DataFrame.union, sizes), 1 << 62)
    return found.join(keys, ["table_name", "columns"]).where("combos < rows").select("table_name", F.array_join("columns", ",").alias("columns"), "combos", "rows")


QUERIES = {
    "sample_orders": (
        sample_orders,
        """WITH k AS (SELECT c_custkey AS key, row_number() OVER (ORDER BY c_custkey) - 1 AS number FROM (SELECT DISTINCT c_custkey FROM customer)), n AS (SELECT count(*) AS n FROM k),
        i AS (SELECT unnest(range(0, (SELECT count(*) FROM orders))) AS i)
        SELECT i + 1 AS order_no, key AS cust_no, ['F', 'O', 'P'][i % 3 + 1] AS status, CAST(DATE '2024-01-01' - CAST(i AS INTEGER) AS DATE) AS order_day, left('MEMO_' || CASE WHEN i < 999 THEN lpad(CAST(i + 1 AS VARCHAR), 3, '0') ELSE CAST(i + 1 AS VARCHAR) END, 12) AS memo,
        CASE WHEN i % 2 = 0 THEN 'Y' ELSE 'N' END AS use_yn FROM i, n JOIN k ON number = i % n""",
    ),
    "sample_lines": (
        lambda s, d: sample_lines(s, d).join(sample_orders(s, d).select("order_no", "cust_no"), "order_no").select("line_no", "order_no", "part_no", "cust_no", F.col("amount").cast("double").alias("amount")),
        """WITH o AS (SELECT row_number() OVER () AS order_no FROM orders), c AS (SELECT c_custkey AS cust_no, row_number() OVER (ORDER BY c_custkey) - 1 AS number FROM customer), p AS (SELECT p_partkey AS part_no, row_number() OVER (ORDER BY p_partkey) - 1 AS number FROM part),
        i AS (SELECT unnest(range(0, (SELECT count(*) FROM lineitem))) AS i), l AS (SELECT i, i % (SELECT count(*) FROM o) AS q FROM i)
        SELECT i + 1 AS line_no, q + 1 AS order_no, part_no, cust_no, CAST(i % 9999 + 1 + ((i + 1) % 100) / 100.0 AS DOUBLE) AS amount FROM l JOIN p ON p.number = i % (SELECT count(*) FROM p) JOIN c ON c.number = q % (SELECT count(*) FROM c)""",
    ),
    "key_overlaps": (
        overlaps,
        """SELECT 'lineitem' AS table_name, 'l_returnflag,l_linestatus' AS columns, CAST(lcm(count(DISTINCT l_returnflag), count(DISTINCT l_linestatus)) AS BIGINT) AS combos, count(*) AS rows FROM lineitem
        UNION ALL SELECT 'lineitem', 'l_linenumber', count(DISTINCT l_linenumber), count(*) FROM lineitem
        UNION ALL SELECT 'orders', 'o_orderpriority,o_orderstatus', CAST(lcm(count(DISTINCT o_orderpriority), count(DISTINCT o_orderstatus)) AS BIGINT), count(*) FROM orders
        UNION ALL FROM (SELECT 'part' AS table_name, 'p_size,p_brand' AS columns, CAST(lcm(count(DISTINCT p_size), count(DISTINCT p_brand)) AS BIGINT) AS combos, count(*) AS rows FROM part) WHERE combos < rows""",
    ),
}
