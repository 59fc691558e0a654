"""Catalog shapes: literal dictionary rows, and the star schema standing for catalogs where rows are many."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import catalog, naming
from quarrylens.plans.metadata_plans import values
from quarrylens.plans.naming_plans import columns as column_rows
from quarrylens.plans.naming_plans import column_values, words, W
from quarrylens.session import table

KEYS = "schema_name string, table_name string, name string, column string, seq int, ref_schema string, ref_table string, ref_column string"
FKS = [("a", "T", "F1", "Y", 2, "a", "U", "V"), ("a", "T", "F1", "X", 1, "a", "U", "W"), ("a", "T", "F2", "Z", 1, "b", "R", "K")]
INDEX = [("T", "PK_T", True, "ID", 1), ("T", "UX", True, "B", 2), ("T", "UX", True, "A", 1), ("T", "IX", False, "C", 1), ("T", None, False, None, 0), ("T", "UX2", True, "ID", 1)]


def index_rows(s):
    return s.createDataFrame(INDEX, "table_name string, name string, is_unique boolean, column string, seq int")


def pk_rows(s):
    return catalog.primary_keys(s.createDataFrame([("T", "PK_T", "ID", 1)], "table_name string, name string, column string, seq int"))


def joined(df, *lists):
    return df.withColumns({c: F.array_join(c, ",") for c in lists})


MENU = [("주문 > 목록", "/o/list.do?x=1", "yes"), (" a ＞b", " ", "0"), (">", "/x", "Y"), ("c", None, "maybe")]
WORDS = [(3, "주문", "코드"), (1, "주문", ""), (2, "주문", "번호"), (4, "고객", None)]

QUERIES = {
    "user_schemas": (
        lambda s, d: catalog.user_schemas(s.createDataFrame([("app",), ("pg_toast_1",), ("INFORMATION_SCHEMA",), ("sys",), ("App2",)], "schema_name string")),
        values([("app",), ("App2",)], "schema_name"),
    ),
    "first_columns": (
        lambda s, d: catalog.first_columns(table(s, d, "lineitem").select(F.col("l_suppkey").alias("table_name"), F.col("l_partkey").alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))).groupBy("table_name").agg(F.count("*").alias("n"), F.min("ordinal").alias("first")),
        "SELECT l_suppkey AS table_name, count(DISTINCT l_partkey) AS n, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1",
    ),
    "foreign_keys": (
        lambda s, d: joined(catalog.foreign_keys(s.createDataFrame(FKS, KEYS)), "columns", "ref_columns"),
        values([("T", "F1", "X,Y", None, "U", "W,V"), ("T", "F2", "Z", "b", "R", "K")], "table_name, name, columns, ref_schema, ref_table, ref_columns"),
    ),
    "indexes": (lambda s, d: joined(catalog.indexes(index_rows(s), pk_rows(s)), "columns").drop("is_unique"), values([("T", "UX", "A,B"), ("T", "IX", "C"), ("T", "UX2", "ID")], "table_name, name, columns")),
    "unique_keys": (lambda s, d: joined(catalog.unique_keys(index_rows(s), pk_rows(s)), "columns"), values([("T", "UX", "A,B")], "table_name, name, columns")),
    "vendor_overlay": (
        lambda s, d: catalog.overlay(table(s, d, "nation").select(F.lower("n_name").alias("table_name"), F.lit(None).cast("string").alias("comment"), F.col("n_nationkey").cast("long").alias("row_count")), catalog.known_rows(table(s, d, "nation").select(F.col("n_name").alias("table_name"), F.col("n_name").alias("comment"), (F.col("n_regionkey") - 2).cast("long").alias("row_count"))), "comment", "row_count"),
        "SELECT lower(n_name) AS table_name, n_name AS comment, CASE WHEN n_regionkey > 2 THEN n_regionkey - 2 ELSE n_nationkey END AS row_count FROM nation",
    ),
    "partition_rows": (
        lambda s, d: catalog.partition_rows(table(s, d, "lineitem").select(F.col("l_partkey").alias("table_name"), (F.col("l_linenumber") % 4).alias("index_id"), F.col("l_orderkey").alias("rows"))),
        "SELECT l_partkey AS table_name, CAST(sum(l_orderkey) AS BIGINT) AS row_count FROM lineitem WHERE l_linenumber % 4 IN (0, 1) GROUP BY 1",
    ),
    "key_positions": (
        lambda s, d: catalog.key_positions(s.createDataFrame([("T", "K", [3, 1])], "table_name string, name string, numbers array<int>"), s.createDataFrame([("T", 1, "A"), ("T", 2, "B"), ("T", 3, "C")], "table_name string, number int, column string")),
        values([("T", "K", 1, "C"), ("T", "K", 2, "A")], 'table_name, name, place, "column"'),
    ),
    "allocated_pages": (
        lambda s, d: catalog.allocated(table(s, d, "lineitem").select(F.col("l_orderkey").alias("container"), (F.col("l_linenumber") % 4).alias("kind"), F.col("l_linenumber").cast("long").alias("pages")), table(s, d, "orders").select(F.col("o_orderstatus").alias("table_name"), (F.col("o_orderkey") + 1).alias("id"), F.col("o_orderkey").alias("hobt"))),
        "SELECT o_orderstatus AS table_name, CAST(sum(l_linenumber) AS BIGINT) AS pages FROM lineitem JOIN orders ON (l_linenumber % 4 IN (1, 3) AND l_orderkey = o_orderkey) OR (l_linenumber % 4 = 2 AND l_orderkey = o_orderkey + 1) GROUP BY 1",
    ),
    "own_checks": (
        lambda s, d: catalog.own_checks(s.createDataFrame([('"A" IS NOT NULL',), ("a > 0",), ("b is not null",), ("b IS NOT NULL OR c = 1",)], "condition string")),
        values([("a > 0",), ("b IS NOT NULL OR c = 1",)], "condition"),
    ),
    "dictionary_upsert": (
        lambda s, d: catalog.upsert(table(s, d, "customer").select("c_custkey", "c_mktsegment"), table(s, d, "customer").where("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment")), "c_custkey"),
        "WITH n AS (SELECT c_custkey * 2 AS c_custkey, 'NEW' AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0) SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n",
    ),
    "domains_by_word": (lambda s, d: catalog.domains_by_word(s.createDataFrame(WORDS, "id int, word_ko string, domain string")), values([("주문", "번호"), ("고객", None)], "word_ko, domain")),
    "dictionary_version": (lambda s, d: table(s, d, "documents").agg(F.max("source").alias("version")), "SELECT max(source) AS version FROM documents"),
    "menu_rows": (
        lambda s, d: catalog.menus(s.createDataFrame(MENU, "path string, url string, use string")),
        values([("주문 > 목록", "목록", "/o/list.do", "Y"), ("a > b", "b", None, "N"), ("c", "c", None, "maybe")], "path, menu, url, use"),
    ),
    "derived_crud": (
        lambda s, d: catalog.derived_crud(s.createDataFrame([("findByName",), ("saveAll",), ("deleteById",), ("removeX",), ("doIt",), ("countBy",), ("getter",)], "method string")),
        values([("findByName", "R"), ("saveAll", "CU"), ("deleteById", "D"), ("removeX", "D"), ("doIt", None), ("countBy", "R"), ("getter", None)], "method, crud"),
    ),
    "insert_warnings": (
        lambda s, d: catalog.insert_warnings(
            s.createDataFrame([(1, "A", "abcdef"), (1, "N", "12x"), (2, "N", "12345"), (2, "D", "2024.1.1"), (3, "Q", "1"), (3, "R", ""), (4, "A", "abc"), (4, "D", "20240101")], "row int, name string, value string"),
            s.createDataFrame([("A", "VARCHAR", 5, True, False), ("N", "NUMBER", 4, True, False), ("D", "DATE", None, True, False), ("R", "CHAR", 1, False, False)], "name string, native_type string, length int, nullable boolean, has_default boolean"),
        ),
        values([(1, "A", "too long"), (1, "N", "no number"), (2, "N", "too many digits"), (2, "D", "no date"), (3, "Q", "unknown column"), (3, "R", "required")], '"row", name, warning'),
    ),
    "changed_only": (
        lambda s, d: catalog.restricted(table(s, d, "events").select(F.col("user_id").alias("path"), "event_id"), table(s, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("path"))),
        "SELECT user_id AS path, event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)",
    ),
    "missing_screens": (
        lambda s, d: catalog.missing_screens(table(s, d, "orders").select(F.col("o_custkey").alias("view"), F.col("o_orderkey").alias("program_id")), table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("view"))),
        "SELECT o_custkey AS view, count(DISTINCT o_orderkey) AS programs FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1",
    ),
    "token_examples": (
        lambda s, d: catalog.examples(naming.looked_up(naming.tokens(column_rows(s, d), "name"), words(s)).where("word_ko is null").join(column_rows(s, d).select("table_name", F.upper("name").alias("name")), "name").select("token", "table_name", "name")),
        f"""WITH t AS (SELECT DISTINCT unnest(string_split(upper(name), '_')) AS token, table_name || '.' || upper(name) AS at_ FROM ({column_values()})), r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY at_) AS k FROM t WHERE token <> '' AND token NOT IN (SELECT abbr FROM ({W})))
        SELECT token, string_agg(at_, ', ' ORDER BY k) AS samples FROM r WHERE k <= 3 GROUP BY 1""",
    ),
    "index_columns": (
        lambda s, d: catalog.index_columns(
            s.createDataFrame([("O", "IX", 1, "A", False), ("O", "IX", 2, "SYS_NC1$", True), ("P", "IX", 2, "B", False)], "owner string, name string, place int, column string, descending boolean"),
            s.createDataFrame([("O", "IX", 2, "UPPER(B)")], "owner string, name string, place int, expression string"),
        ),
        values([("O", "IX", 1, "A", False), ("O", "IX", 2, "UPPER(B)", True), ("P", "IX", 2, "B", False)], 'owner, name, place, "column", descending'),
    ),
    "described_columns": (
        lambda s, d: catalog.described_columns(
            s.createDataFrame([(1, 10, "t", "r"), (2, 10, "i", "i"), (3, 11, "t", "r")], "class int, namespace int, table_name string, kind string"), s.createDataFrame([(10, "app"), (11, "other")], "namespace int, schema_name string"),
            s.createDataFrame([(1, 1, "a", False), (1, 2, "gone", True), (1, -1, "ctid", False), (3, 1, "z", False)], "class int, number int, column string, dropped boolean"),
            s.createDataFrame([(1, 0, "the table"), (1, 1, "the column"), (1, 2, "x"), (2, 0, "x"), (3, 1, "x")], "class int, number int, comment string"), "app",
        ),
        values([("t", "", "the table"), ("t", "a", "the column")], 'table_name, "column", comment'),
    ),
    "extended_comments": (
        lambda s, d: catalog.extended_comments(
            s.createDataFrame([(1, 5, "T", "U"), (2, 5, "P", "P"), (3, 6, "T", "U")], "object_id int, schema_id int, table_name string, type string"), s.createDataFrame([(5, "dbo"), (6, "x")], "schema_id int, schema_name string"),
            s.createDataFrame([(1, 1, "A"), (1, 2, "B"), (3, 1, "A")], "object_id int, column_id int, column string"),
            s.createDataFrame([(1, 0, 1, "MS_Description", "t"), (1, 2, 1, "MS_Description", "b"), (1, 1, 1, "Other", "x"), (1, 1, 7, "MS_Description", "x"), (3, 0, 1, "MS_Description", "x")], "major int, minor int, class int, property string, value string"), "dbo",
        ),
        values([("T", "", "t"), ("T", "B", "b")], 'table_name, "column", comment'),
    ),
    "table_info": (
        lambda s, d: catalog.table_info(s.createDataFrame([("a", "T", " hello ", 5, "BASE TABLE"), ("a", "V", "VIEW", 3, "VIEW"), ("a", "E", "", 0, "BASE TABLE"), ("b", "X", "x", 1, "BASE TABLE")], "schema_name string, table_name string, comment string, row_count long, type string"), "a"),
        values([("T", "hello", 5, False), ("V", None, None, True), ("E", None, 0, False)], "table_name, comment, row_count, is_view"),
    ),
    "named_checks": (
        lambda s, d: catalog.named_checks(
            s.createDataFrame([("a", "c1", "x > 0"), ("a", "c2", "y > 0"), ("b", "c1", "z > 0")], "schema_name string, name string, condition string"),
            s.createDataFrame([("a", "c1", "T", "CHECK"), ("a", "c2", "T", "UNIQUE"), ("b", "c1", "U", "CHECK")], "schema_name string, name string, table_name string, type string"),
        ),
        values([("T", "c1", "x > 0"), ("U", "c1", "z > 0")], "table_name, name, condition"),
    ),
    "schema_bytes": (lambda s, d: catalog.schema_bytes(s.createDataFrame([("a", 10, 5), ("a", None, 3), ("a", 7, 0), ("b", 99, 99)], "schema_name string, data_bytes long, index_bytes long"), "a"), "SELECT CAST(22 AS BIGINT) AS bytes"),
    "listed_types": (
        lambda s, d: catalog.listed_types(s.createDataFrame([("T", "A", "ENUM"), ("T", "B", "INT")], "table_name string, name string, native_type string"), s.createDataFrame([("T", "A", "enum", "enum('x','y')"), ("T", "B", "int", "int(11)")], "table_name string, name string, data_type string, column_type string")),
        values([("T", "A", "enum('x','y')"), ("T", "B", "INT")], "table_name, name, native_type"),
    ),
    "tables_of": (
        lambda s, d: catalog.tables_of(s.createDataFrame([("a_b", "T", "TABLE"), ("axb", "T", "TABLE"), ("a_b", "V", "VIEW"), ("a_b", "S", "SEQUENCE")], "schema_name string, table_name string, type string"), "a_b").select("table_name", "type"),
        values([("T", "TABLE"), ("V", "VIEW")], "table_name, type"),
    ),
}
