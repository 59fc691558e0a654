"""Scripts and mappers as rows: over files made of the parts, and over literal ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.plans.metadata_plans import values
from quarrylens.session import table
from quarrylens.sources import ddl, mappers

SCRIPT = """-- users
CREATE TABLE app."USERS" (
  ID NUMBER(19) NOT NULL, -- key
  NM VARCHAR2(20 CHAR) DEFAULT 'a,b' NOT NULL COMMENT 'the ''name''',
  AMT DECIMAL(9,2) DEFAULT (1 + 2),
  AT TIMESTAMP(6) WITH TIME ZONE DEFAULT CURRENT_TIMESTAMP,
  ORG_ID INT REFERENCES ORG (ID),
  CONSTRAINT PK_U PRIMARY KEY (ID), UNIQUE (NM), CHECK (AMT > 0), KEY IX_A (AT)
);
CREATE UNIQUE INDEX UX ON USERS (AMT, NM);
COMMENT ON TABLE USERS IS 'people';
COMMENT ON COLUMN app.USERS.ID IS 'number';
ALTER TABLE USERS ADD CONSTRAINT FK_B FOREIGN KEY (AMT) REFERENCES B (X, Y);
ALTER TABLE USERS ADD (C1 CHAR(1), C2 DATE);
CREATE TABLE COPY AS SELECT 1;
CREATE TABLE P (A INT PRIMARY KEY, B DATE NOT NULL);
CREATE TABLE L (Z INT, LIKE P);
CREATE TABLE P1 PARTITION OF app.P FOR VALUES IN (1);
CREATE TABLE CT AS SELECT * FROM P;
CREATE TABLE NL LIKE NOWHERE;
ALTER TABLE P DROP COLUMN B;
INSERT INTO USERS VALUES (1);
"""
ROWS = [
    ("TABLE", "USERS", "USERS", None, None, None, None, None, None, "people"), ("COLUMN", "USERS", "ID", 1, "NUMBER", 19, None, False, None, "number"), ("COLUMN", "USERS", "NM", 2, "VARCHAR2", 20, None, False, "'a,b'", "the 'name'"),
    ("COLUMN", "USERS", "AMT", 3, "DECIMAL", 9, 2, True, "(1 + 2)", None), ("COLUMN", "USERS", "AT", 4, "TIMESTAMP WITH TIME ZONE", 6, None, True, "CURRENT_TIMESTAMP", None), ("COLUMN", "USERS", "ORG_ID", 5, "INT", None, None, True, None, None),
    ("COLUMN", "USERS", "C1", 6, "CHAR", 1, None, True, None, None), ("COLUMN", "USERS", "C2", 7, "DATE", None, None, True, None, None), ("CK", "USERS", None, None, None, None, None, None, "AMT > 0", None),
    ("TABLE", "COPY", "COPY", None, None, None, None, None, None, None), ("NOTE", "COPY", "CREATE TABLE COPY AS SELECT 1", None, None, None, None, None, None, None),
    *[("TABLE", t, t, None, None, None, None, None, None, None) for t in ("P", "L", "P1", "CT", "NL")], ("NOTE", "NL", "CREATE TABLE NL LIKE NOWHERE", None, None, None, None, None, None, None),
    ("COLUMN", "L", "Z", 1, "INT", None, None, True, None, None), *[("COLUMN", t, c, k + n, kind, None, None, False, None, None) for t, k in (("P", 0), ("L", 1), ("P1", 0), ("CT", 0)) for n, (c, kind) in enumerate((("A", "INT"), ("B", "DATE")), 1)],
    ("UNREADABLE", "P", "ALTER TABLE P DROP COLUMN B", None, None, None, None, None, None, None),
]
KEYS = [*[("PK", t, None, "A", None, None) for t in ("P", "L", "P1")], ("PK", "USERS", "PK_U", "ID", None, None), ("UQ", "USERS", None, "NM", None, None), ("IX", "USERS", "IX_A", "AT", None, None), ("UQ", "USERS", "UX", "AMT,NM", None, None), ("FK", "USERS", None, "ORG_ID", "ORG", "ID"), ("FK", "USERS", "FK_B", "AMT", "B", "X,Y")]

MAPPERS = [
    ("a.xml", '<?xml version="1.0"?>\n<!DOCTYPE mapper PUBLIC "-//x//EN" "http://none/x.dtd">\n<mapper namespace="user">\n<sql id="cols">a, <include refid="other.more"/></sql>\n<select id="list">SELECT <include refid="cols"/> FROM t1 JOIN t2 ON t1.id = t2.id <if test="x">WHERE x = #{x}</if></select>\n<update id="all">UPDATE t1 SET a = 1</update>\n<delete id="one">DELETE FROM t1 WHERE a &lt; 1</delete>\n</mapper>'),
    ("b.xml", '<mapper namespace="other"><sql id="more">(SELECT max(b) FROM t3) b</sql>\n<insert id="add">INSERT INTO t4 (a) VALUES (#{a})</insert>\n<insert id="add">INSERT INTO t5 SELECT * FROM t4</insert></mapper>'),
    ("c.xml", "<mapper namespace='x'><select id='a'>oops"), ("d.xml", "<beans/>"), ("e.xml", None), ("f.xml", ""),
]


def script(s):
    return ddl.ddl_rows(s.createDataFrame([(1, SCRIPT), (2, None), (3, "")], "id int, sql string"), "sql", "id")


def files(s):
    return s.createDataFrame(MAPPERS, "path string, text string")


def part_mappers(s, d):
    """A mapper file of each brand, with a statement of each of its parts: fragments of its own, of a shared file, missing ones, and one in itself."""
    size, name = F.col("p_size"), F.concat(F.lit("q"), "p_partkey")
    tail = F.when(size % 9 == 0, '<include refid="nowhere"/>').when(size % 9 == 1, '<include refid="shared.deep"/>').when(size % 9 == 2, '<include refid="ring"/>').when(size % 9 == 3, '<if test="x">WHERE b = #{b}</if>').otherwise("")
    body = F.concat(F.lit('<select id="'), name, F.lit('">SELECT <include refid="cols"/> FROM t'), size, F.lit(" "), tail, F.lit("</select>\n"))
    head = F.concat(F.lit('<mapper namespace="'), F.lower(F.translate("p_brand", "#", "_")), F.lit('">\n<sql id="cols">a, c</sql>\n<sql id="ring">[<include refid="ring"/>]</sql>\n'))
    files = table(s, d, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list(F.struct("p_partkey", body.alias("x"))))["x"], "").alias("x"))
    shared = s.createDataFrame([("z.xml", '<mapper namespace="shared"><sql id="deep">WHERE <include refid="shared.key"/> = 1</sql><sql id="key">k</sql><sql id="cols">not these</sql></mapper>')], "path string, text string")
    return files.select(F.concat("p_brand", F.lit(".xml")).alias("path"), F.concat(head, "x", F.lit("</mapper>")).alias("text")).union(shared)


PART_STATEMENTS = "SELECT p_brand || '.xml' AS path, lower(translate(p_brand, '#', '_')) || '.q' || p_partkey AS ns_id, CAST(3 + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS line, p_size % 9 AS k, p_size, lower(translate(p_brand, '#', '_')) AS ns FROM part"
QUERIES = {
    "part_statements": (
        lambda s, d: mappers.statements(part_mappers(s, d)),
        f"""SELECT path, ns_id, 'select' AS tag, k = 3 AS dynamic, line, 'SELECT a, c FROM t' || p_size || CASE k WHEN 1 THEN ' WHERE k = 1' WHEN 2 THEN ' [ [ [ [ [ [ ] ] ] ] ] ]' WHEN 3 THEN ' WHERE b = #{{b}}' ELSE '' END AS sql FROM ({PART_STATEMENTS})""",
    ),
    "include_notes": (
        lambda s, d: mappers.resolved(part_mappers(s, d))[1],
        f"SELECT path, ns_id, line, CASE k WHEN 0 THEN 'missing' ELSE 'depth' END AS kind, ns || CASE k WHEN 0 THEN '.nowhere' ELSE '.ring' END AS ref FROM ({PART_STATEMENTS}) WHERE k IN (0, 2)",
    ),
    "ddl_columns": (
        lambda s, d: script(s).where("kind not in ('PK', 'UQ', 'FK', 'IX')").select("kind", "table_name", "name", "ordinal", "native_type", "length", "scale", "nullable", "default_value", "comment"),
        values(ROWS, "kind, table_name, name, ordinal, native_type, length, scale, nullable, default_value, comment"),
    ),
    "ddl_keys": (
        lambda s, d: script(s).where("kind in ('PK', 'UQ', 'FK', 'IX')").selectExpr("kind", "table_name", "name", "array_join(columns, ',') as columns", "ref_table", "array_join(ref_columns, ',') as ref_columns"),
        values(KEYS, "kind, table_name, name, columns, ref_table, ref_columns"),
    ),
    "mapper_statements": (
        lambda s, d: mappers.statements(files(s)).select("path", "ns_id", "tag", "dynamic", "line", "sql"),
        values([
            ("a.xml", "user.list", "select", True, 5, "SELECT a, (SELECT max(b) FROM t3) b FROM t1 JOIN t2 ON t1.id = t2.id WHERE x = #{x}"), ("a.xml", "user.all", "update", False, 6, "UPDATE t1 SET a = 1"),
            ("a.xml", "user.one", "delete", False, 7, "DELETE FROM t1 WHERE a < 1"), ("b.xml", "other.add", "insert", False, 2, "INSERT INTO t4 (a) VALUES (#{a})"), ("b.xml", "other.add", "insert", False, 3, "INSERT INTO t5 SELECT * FROM t4"),
        ], "path, ns_id, tag, dynamic, line, sql"),
    ),
    "mapper_tables": (
        lambda s, d: mappers.statement_tables(files(s)),
        values([("user.list", "T1", "R"), ("user.list", "T2", "R"), ("user.list", "T3", "R"), ("user.all", "T1", "U"), ("user.one", "T1", "D"), ("other.add", "T4", "CR"), ("other.add", "T5", "C")], "ns_id, table_name, crud"),
    ),
    "mapper_rules": (
        lambda s, d: mappers.without_where(files(s)).union(mappers.repeated_ids(files(s))).union(mappers.raw_statements(files(s)).where("tag = 'parse'").selectExpr("path", "line", "'mybatis.parseError' as rule")),
        values([("a.xml", 6, "mybatis.noWhere"), ("b.xml", 3, "mybatis.dupId"), ("c.xml", 1, "mybatis.parseError")], "path, line, rule"),
    ),
}
