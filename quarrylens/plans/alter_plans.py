"""Alter plans over parts: a brand is a table, a part a column of it, and rules on sizes and prices change them, in four dialects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators import alter
from quarrylens.session import table

DIALECTS = ("postgresql", "oracle", "mssql", "mariadb")


def columns(s, d, new):
    """Every part as a column, but each fiftieth that only the other side has."""
    p = table(s, d, "part").where(F.col("p_partkey") % 50 != (0 if new else 1))
    size, narrow = F.col("p_size") + 10, F.when(F.col("p_size") > 40, 5).otherwise(0)
    return p.select(
        F.upper(F.translate("p_brand", "#", "_")).alias("table_name"), F.concat(F.lit("C"), "p_partkey").alias("name"), F.lit("VARCHAR").alias("native_type"), (size - narrow if new else size).alias("length"), F.lit(None).cast("int").alias("scale"),
        (F.col("p_size") % 7 != 0 if new else F.lit(True)).alias("nullable"), F.when((F.col("p_size") % 5 == 0) if new else (F.col("p_size") % 15 == 0), "'x'").alias("default_value"),
    )


def keys(s, d, new):
    """The primary key of a table is its first column, later with its last; a CHECK changes its bound, another only its spaces; an index stays."""
    c = columns(s, d, True).groupBy("table_name").agg(F.min("name").alias("a"), F.max("name").alias("b"))
    row = lambda kind, name, cols, cond: F.struct(F.lit(kind).alias("kind"), name.alias("name"), cols.alias("columns"), cond.alias("condition"))
    none = F.lit(None).cast("string")
    rows = F.array(
        row("PK", F.concat(F.lit("PK_"), "table_name"), F.array("a", "b") if new else F.array("a"), none),
        row("CK", F.lit("CK_1"), F.array(), F.concat("a", F.lit(" > 1") if new else F.lit(" > 0"))),
        row("CK", none, F.array(), F.concat("a", F.lit("  <\n 9") if new else F.lit(" < 9"))),
        row("CK", none, F.array(), F.concat("b", F.lit(" <> 3") if new else F.lit(" <> 2"))),
        row("UQ", F.lit("UQ_1"), F.array("b") if new else F.array("a"), none),
        row("IX", F.lit("IX_1"), F.array("a"), none),
    )
    return c.select("table_name", F.explode(rows).alias("k")).select("table_name", "k.*", none.alias("ref_table"), F.array().cast("array<string>").alias("ref_columns"))


def plans(s, d):
    one = lambda x: alter.alter_plan(columns(s, d, False), columns(s, d, True), keys(s, d, False), keys(s, d, True), x).select(F.lit(x).alias("dialect"), "section", "table_name", "text", "tag")
    return reduce(DataFrame.union, map(one, DIALECTS))


HAND = "'-- the default of ' || c || ' is a constraint: DROP it by its name' || coalesce(', then ADD CONSTRAINT ... DEFAULT ' || dn || ' FOR ' || c, '')"
SQL = f"""WITH p AS (SELECT upper(translate(p_brand, '#', '_')) AS t, 'C' || p_partkey AS c, p_partkey % 50 AS m, p_size + 10 AS l, p_size + 10 - CASE WHEN p_size > 40 THEN 5 ELSE 0 END AS n, p_size % 7 <> 0 AS nullable, CASE WHEN p_size % 15 = 0 THEN '''x''' END AS d, CASE WHEN p_size % 5 = 0 THEN '''x''' END AS dn FROM part),
  x AS (SELECT *, 'ALTER TABLE ' || t AS tab, c || ' VARCHAR(' || n || ')' || coalesce(' DEFAULT ' || dn, '') || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END AS def, l <> n AS typed, NOT nullable AS nulled, d IS DISTINCT FROM dn AS defaulted FROM p),
  k AS (SELECT * FROM x WHERE m NOT IN (0, 1)),
  changed AS (
    SELECT 'postgresql' AS dialect, t, tab || ' ALTER COLUMN ' || c || ' TYPE VARCHAR(' || n || ')' AS text, 'data' AS tag FROM k WHERE typed UNION ALL SELECT 'postgresql', t, tab || ' ALTER COLUMN ' || c || ' SET NOT NULL', 'data' FROM k WHERE nulled
    UNION ALL SELECT 'postgresql', t, tab || ' ALTER COLUMN ' || c || coalesce(' SET DEFAULT ' || dn, ' DROP DEFAULT'), '' FROM k WHERE defaulted
    UNION ALL SELECT 'oracle', t, tab || ' MODIFY (' || c || ' VARCHAR(' || n || '))', 'data' FROM k WHERE typed UNION ALL SELECT 'oracle', t, tab || ' MODIFY (' || c || ' NOT NULL)', 'data' FROM k WHERE nulled
    UNION ALL SELECT 'oracle', t, tab || ' MODIFY (' || c || ' DEFAULT ' || coalesce(dn, 'NULL') || ')', '' FROM k WHERE defaulted
    UNION ALL SELECT 'mssql', t, tab || ' ALTER COLUMN ' || c || ' VARCHAR(' || n || ')' || CASE WHEN nullable THEN ' NULL' ELSE ' NOT NULL' END, 'data' FROM k WHERE typed OR nulled
    UNION ALL SELECT 'mssql', t, CASE WHEN d IS NULL THEN tab || ' ADD CONSTRAINT DF_' || t || '_' || c || ' DEFAULT ' || dn || ' FOR ' || c ELSE {HAND} END, CASE WHEN d IS NULL THEN '' ELSE 'hand' END FROM k WHERE defaulted
    UNION ALL SELECT 'mariadb', t, tab || ' MODIFY COLUMN ' || def, 'data' FROM k WHERE typed OR nulled
    UNION ALL SELECT 'mariadb', t, tab || ' ALTER COLUMN ' || c || coalesce(' SET DEFAULT ' || dn, ' DROP DEFAULT'), '' FROM k WHERE defaulted AND NOT typed AND NOT nulled),
  e AS (SELECT unnest(['postgresql', 'oracle', 'mssql', 'mariadb']) AS dialect),
  moved AS (
    SELECT dialect, t, tab || CASE dialect WHEN 'oracle' THEN ' ADD (' || def || ')' WHEN 'mssql' THEN ' ADD ' || def ELSE ' ADD COLUMN ' || def END AS text, CASE WHEN NOT nullable AND dn IS NULL THEN 'data' ELSE '' END AS tag FROM x, e WHERE m = 1
    UNION ALL SELECT dialect, t, '-- ' || tab || ' DROP COLUMN ' || c, 'delete' FROM x, e WHERE m = 0
    UNION ALL SELECT dialect, t, '-- columns are both dropped and added: RENAME if a name changed', 'rename' FROM e, (SELECT t FROM x GROUP BY t HAVING bool_or(m = 0) AND bool_or(m = 1))),
  g AS (SELECT t, 'ALTER TABLE ' || t AS tab, min(c) AS a, max(c) AS b FROM x WHERE m <> 0 GROUP BY t),
  ks AS (
    SELECT dialect, t, tab || CASE WHEN dialect = 'mariadb' THEN ' DROP PRIMARY KEY' ELSE ' DROP CONSTRAINT PK_' || t END AS text, '' AS tag, a, b FROM g, e
    UNION ALL SELECT dialect, t, tab || CASE WHEN dialect = 'mariadb' THEN ' ADD ' ELSE ' ADD CONSTRAINT PK_' || t || ' ' END || 'PRIMARY KEY (' || a || ', ' || b || ')', '', a, b FROM g, e
    UNION ALL SELECT dialect, t, tab || ' DROP CONSTRAINT CK_1', '', a, b FROM g, e UNION ALL SELECT dialect, t, tab || ' ADD CONSTRAINT CK_1 CHECK (' || a || ' > 1)', '', a, b FROM g, e
    UNION ALL SELECT dialect, t, '-- the name of CK(' || b || ' <> 2) on ' || t || ' is not known: DROP it by hand', 'hand', a, b FROM g, e UNION ALL SELECT dialect, t, tab || ' ADD CONSTRAINT CK_' || t || ' CHECK (' || b || ' <> 3)', '', a, b FROM g, e),
  uq AS (
    SELECT dialect, 'drop indexes' AS section, t, tab || CASE WHEN dialect = 'mariadb' THEN ' DROP INDEX UQ_1' ELSE ' DROP CONSTRAINT UQ_1' END AS text FROM g, e WHERE a <> b
    UNION ALL SELECT dialect, 'add indexes', t, tab || ' ADD CONSTRAINT UQ_1 UNIQUE (' || b || ')' FROM g, e WHERE a <> b)
  SELECT dialect, 'changed tables' AS section, t AS table_name, text, tag FROM (FROM changed UNION ALL FROM moved UNION ALL SELECT dialect, t, text, tag FROM ks) UNION ALL SELECT dialect, section, t, text, '' FROM uq"""
QUERIES = {"alter_dialects": (plans, SQL)}
