"""Snapshots, scope, diffs and lint: over the tables' own schemas and over a small faulty schema given as literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import lint, metadata
from quarrylens.session import TABLES, table

#: A small schema with known faults: table -> columns (name, type, length, nullable, default).
FAULTY = {
    "ORDERS": [("ID", "INT4", None, False, None), ("USER_ID", "VARCHAR", 10, True, None), ("MEMO", "CLOB", None, True, "'NULL'"), ("BODY", "BLOB", None, True, "'NULL' || x")],
    "USERS": [("ID", "VARCHAR2", 20, False, None), ("EMAIL", "VARCHAR", 50, True, None), ("TEL1", "CHAR", 4, True, None), ("TEL2", "CHAR", 4, True, None), ("TEL3", "CHAR", 4, True, None), ("BOSS_ORDER", "INTEGER", None, True, None)],
    "ALONE": [("X", "DATE", None, True, None), ("Y", "DATE", None, True, None)],
    "LOGS": [("LINE", "VARCHAR", 400, True, None)],
    "ITEMS": [("ORDER_ID", "INTEGER", None, False, None), ("NO", "INT", None, False, None), ("QTY", "NUMBER", 9, True, None), ("COL10", "CHAR", 4, True, None), ("COL11", "CHAR", 4, True, None), ("COL12", "CHAR", 4, True, None)],
}
CONSTRAINTS = [
    ("ORDERS", "PK_O", "PK", ["ID"], None, None), ("USERS", "PK_U", "PK", ["ID"], None, None), ("USERS", "UQ_MAIL", "UQ", ["EMAIL"], None, None),
    ("ORDERS", "FK_OU", "FK", ["USER_ID"], "USERS", ["ID"]), ("USERS", "FK_UO", "FK", ["BOSS_ORDER"], "ORDERS", ["ID"]),
    ("ITEMS", "FK_IO", "FK", ["ORDER_ID"], "ORDERS", ["ID"]), ("ITEMS", "FK_IO2", "FK", ["ORDER_ID"], "ORDERS", ["ID"]), ("ITEMS", "FK_II", "FK", ["NO"], "ITEMS", ["NO"]), ("LOGS", "FK_LU", "FK", ["LINE"], "USERS", None),
]
INDEXES = [("ITEMS", "IX_A", False, ["ORDER_ID"]), ("ITEMS", "IX_B", True, ["ORDER_ID", "NO"]), ("USERS", "IX_BOSS", False, ["BOSS_ORDER"]), ("USERS", "IX_BOSS2", False, ["BOSS_ORDER"])]
#: What the rules find in it.
EXPECTED = [
    ("fkNoIndex", "ORDERS", "USER_ID"), ("fkNoIndex", "ITEMS", "NO"), ("noRelation", "ALONE", ""), ("noIndex", "ALONE", ""), ("missingRequired", "ALONE", "REG_DT"), ("noIndex", "LOGS", ""), ("fkNoIndex", "LOGS", "LINE"), ("fkTypeMismatch", "LOGS", "LINE length"), ("noPk", "ITEMS", ""), ("singleColumn", "LOGS", "1"),
    ("tooManyColumns", "USERS", "6"), ("tooManyColumns", "ITEMS", "6"), ("serialColumns", "ITEMS", "COL"), ("dupRelation", "ITEMS", "ORDER_ID->ORDERS"), ("serialColumns", "USERS", "TEL"), ("defaultNullString", "ORDERS", "MEMO"),
    ("fkTypeMismatch", "ORDERS", "USER_ID length"), ("dupIndex", "ITEMS", "IX_A"), ("dupIndex", "USERS", "IX_BOSS2"), ("uniqueNullable", "USERS", "EMAIL"), ("tooManyLobs", "ORDERS", "2"),
    ("fkCycle", "ORDERS", ""), ("fkCycle", "USERS", ""), ("missingRequired", "ORDERS", "REG_DT"), ("missingRequired", "USERS", "REG_DT"), ("missingRequired", "LOGS", "REG_DT"), ("missingRequired", "ITEMS", "REG_DT"),
]


def faulty(s):
    columns = [(t, n, i, k, size, null, default) for t, cs in FAULTY.items() for i, (n, k, size, null, default) in enumerate(cs, 1)]
    return (
        s.createDataFrame([(t,) for t in FAULTY], "table_name string"),
        s.createDataFrame(columns, "table_name string, name string, ordinal int, native_type string, length long, nullable boolean, default_value string"),
        s.createDataFrame(CONSTRAINTS, "table_name string, name string, kind string, columns array<string>, ref_table string, ref_columns array<string>"),
        s.createDataFrame(INDEXES, "table_name string, name string, is_unique boolean, columns array<string>"),
    )


def lint_all(s, d):
    return lint.all_rules(*faulty(s), most_columns=5, required=["REG_DT"])


def values(rows, names):
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({names})"


def snapshots(s, d):
    """The tables' columns now, and as if before: events without its last column, orders with a shorter type, no part, an old table."""
    now = metadata.columns_of(s, d, TABLES)
    old = now.where("not (table_name = 'events' and name = 'props') and table_name <> 'part'")
    old = old.withColumn("native_type", F.when((F.col("table_name") == "orders") & (F.col("name") == "o_totalprice"), "INT").otherwise(F.col("native_type")))
    gone = old.where("table_name = 'region'").withColumn("table_name", F.lit("area"))
    return old.union(gone), now


SCOPE = metadata.Scope(schemas=("main",), prefixes=("line",), suffixes=("ion",), pattern="^p.*s$", excluded=("Labels",), skip_empty=True)


def scoped(s, d):
    counts = metadata.row_counts(s, d, TABLES).withColumn("row_count", F.when(F.col("table_name") == "supplier", 0).when(F.col("table_name") == "part", F.lit(None)).otherwise(F.col("row_count")))
    return counts.select("table_name", SCOPE.reason(F.lit("main"), F.col("table_name"), F.col("row_count")).alias("reason"))


STRUCT_OLD = [("T", "PK", ["A"], None, None, None, None, None), ("T", "FK", ["B"], "U", ["X"], "NO ACTION", None, None), ("T", "CK", [], None, None, None, None, "A  >\n 0"), ("T", "UQ", ["C"], None, None, None, None, None), ("T", "IX", ["D"], None, None, None, None, None)]
STRUCT_NEW = [("T", "PK", ["A", "B"], None, None, None, None, None), ("T", "FK", ["B"], "U", ["X"], "CASCADE", None, None), ("T", "CK", [], None, None, None, None, "A > 0"), ("T", "UQ", ["C"], None, None, None, None, None), ("T", "UX", ["D"], None, None, None, None, None)]
STRUCT = "table_name string, kind string, columns array<string>, ref_table string, ref_columns array<string>, delete_rule string, update_rule string, condition string"

QUERIES = {
    "struct_lint": (lint_all, values(EXPECTED, "rule, table_name, detail")),
    "fk_cycle": (
        lambda s, d: lint.fk_cycle(faulty(s)[2]).select("table_name"),
        f"""WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM ({values([(t, r) for t, _, k, _, r, _ in CONSTRAINTS if k == "FK"], "a, b")}) WHERE a <> b), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT DISTINCT a AS table_name FROM r WHERE a = b""",
    ),
    "tables_without_pk": (
        lambda s, d: faulty(s)[0].join(faulty(s)[2].where("kind = 'PK'"), "table_name", "left_anti"),
        f"SELECT table_name FROM ({values([(t,) for t in FAULTY], 'table_name')}) WHERE table_name NOT IN ('ORDERS', 'USERS')",
    ),
    "row_counts": (
        lambda s, d: metadata.row_counts(s, d, TABLES),
        " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES),
    ),
    "scope_reason": (
        scoped,
        f"""WITH t AS ({values([(t,) for t in TABLES], "table_name")}) SELECT table_name, CASE WHEN table_name = 'supplier' THEN 'empty' WHEN starts_with(table_name, 'line') THEN 'prefix' WHEN suffix(table_name, 'ion') THEN 'suffix'
        WHEN regexp_matches(table_name, '^p.*s$') THEN 'pattern' WHEN table_name = 'labels' THEN 'list' ELSE '' END AS reason FROM t""",
    ),
    "snapshot_tables": (lambda s, d: metadata.table_diff(*snapshots(s, d)), values([(t, "added" if t == "part" else "common") for t in TABLES] + [("area", "removed")], "table_name, change")),
    "snapshot_columns": (lambda s, d: metadata.column_diff(*snapshots(s, d)), values([("events", "props", "added", ""), ("orders", "o_totalprice", "changed", "native_type")], "table_name, name, change, fields")),
    "snapshot_structures": (
        lambda s, d: metadata.structure_diff(s.createDataFrame(STRUCT_OLD, STRUCT), s.createDataFrame(STRUCT_NEW, STRUCT)),
        values([("T", "PK(A)", "removed"), ("T", "PK(A,B)", "added"), ("T", "FK(B)->U(X)", "removed"), ("T", "FK(B)->U(X) ON DELETE CASCADE", "added"), ("T", "IX(D)", "removed"), ("T", "UX(D)", "added")], "table_name, text, change"),
    ),
    "repeated_names": (
        lambda s, d: metadata.repeated_names(metadata.columns_of(s, d, ["orders", "part"]).union(metadata.columns_of(s, d, ["part", "nation"], "other"))),
        values([("part", 2)], "table_name, schemas"),
    ),
    "row_cap": (
        lambda s, d: table(s, d, "customer").orderBy("c_custkey").limit(101).agg(F.least(F.count("*"), F.lit(100)).alias("rows"), (F.count("*") > 100).alias("truncated")),
        "SELECT least(count(*), 100) AS rows, count(*) > 100 AS truncated FROM (SELECT 1 FROM customer ORDER BY c_custkey LIMIT 101)",
    ),
}
