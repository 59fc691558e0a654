"""A catalog made of the parts: a brand is a table, a part one of its columns; keys and indexes follow from sizes. Lint over all of it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylens.functions import names
from quarrylens.operators import catalog as catalogs
from quarrylens.operators import definitions, lint, metadata
from quarrylens.plans import alter_plans
from quarrylens.session import scratch, table


def parts(s, d):
    """table_name, name, ordinal, native_type, length, nullable, default_value, size and the next maker's table of every part."""
    p = table(s, d, "part")
    name = F.concat(F.when(F.col("p_size") % 5 == 0, "TEL").otherwise("C_"), "p_partkey", F.when(F.col("p_size") % 5 == 0, "").otherwise("X"))
    kind = F.element_at(F.array(*map(F.lit, ("INT4", "VARCHAR2", "CLOB", "NUMBER"))), F.col("p_size") % 4 + 1)
    t = F.upper(F.translate("p_brand", "#", "_"))
    number = F.regexp_extract("p_brand", "#([0-9]+)", 1).cast("int")
    other = F.concat(F.lit("BRAND_"), F.when(number >= 50, number - 40).otherwise(number + 10))
    return p.select(
        t.alias("table_name"), name.alias("name"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("ordinal"), kind.alias("native_type"), F.col("p_size").cast("long").alias("length"), (F.col("p_size") % 2 == 0).alias("nullable"),
        F.when(F.col("p_size") % 7 == 0, "'NULL'").alias("default_value"), F.col("p_size").alias("size"), other.alias("other"),
    )


def catalog(s, d, p=None):
    """tables, columns, constraints and indexes, of p if the parts are at hand. The first column is the primary key of tables whose first size is even; a size
    that ends in 3 refers to the next maker's primary key, one of 13 or 33 twice; one that ends in 4 is unique; a size of 1 or 7
    modulo 12 is an index alone, and one of 1 also before the first column."""
    p = parts(s, d) if p is None else p
    first = p.where("ordinal = 1").select("table_name", F.col("name").alias("first"), F.col("size").alias("first_size"))
    pk = first.where("first_size % 2 = 0")
    none, texts = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    constraint = lambda df, prefix, kind, ref=none, refs=texts: df.select("table_name", F.concat(F.lit(prefix), "name").alias("name"), F.lit(kind).alias("kind"), F.array("name").alias("columns"), ref.alias("ref_table"), refs.alias("ref_columns"))
    refers = p.where("size % 10 = 3")
    constraints = constraint(pk.withColumnRenamed("first", "name"), "PK_", "PK").union(constraint(p.where("size % 10 = 4"), "UQ_", "UQ"))
    constraints = constraints.union(constraint(refers, "FK_", "FK", F.col("other"))).union(constraint(refers.where("size in (13, 33)"), "FK2_", "FK", F.col("other")))
    index = lambda df, prefix, columns: df.select("table_name", F.concat(F.lit(prefix), "name").alias("name"), F.lit(False).alias("is_unique"), columns.alias("columns"))
    indexes = index(p.where("size % 12 in (1, 7)"), "IX_", F.array("name")).union(index(p.where("size % 12 = 1").join(first, "table_name").where("name <> first"), "IX2_", F.array("name", "first")))
    return p.select("table_name").distinct(), p.select("table_name", "name", "ordinal", "native_type", "length", "nullable", "default_value"), constraints, indexes


CATALOG = """p AS (SELECT upper(translate(p_brand, '#', '_')) AS t, CASE WHEN p_size % 5 = 0 THEN 'TEL' || p_partkey ELSE 'C_' || p_partkey || 'X' END AS c, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS o, ['INT4', 'VARCHAR2', 'CLOB', 'NUMBER'][p_size % 4 + 1] AS k,
    p_size AS l, p_size % 2 = 0 AS n, p_size % 7 = 0 AS dn, CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS INTEGER) AS b FROM part),
  f AS (SELECT t, c AS fc, l AS fl, k AS fk FROM p WHERE o = 1),
  pk AS (SELECT t, fc AS c, fl, fk FROM f WHERE fl % 2 = 0),
  fks AS (SELECT t, c, k, l, 'BRAND_' || CASE WHEN b >= 50 THEN b - 40 ELSE b + 10 END AS r, l IN (13, 33) AS twice FROM p WHERE l % 10 = 3),
  ix AS (SELECT t, 'IX_' || c AS name, [c] AS cols FROM p WHERE l % 12 IN (1, 7) UNION ALL SELECT t, 'IX2_' || c, [c, fc] FROM p JOIN f USING (t) WHERE l % 12 = 1 AND c <> fc),
  con AS (SELECT t, 'PK_' || c AS name, [c] AS cols FROM pk UNION ALL SELECT t, 'UQ_' || c, [c] FROM p WHERE l % 10 = 4),
  keys AS (SELECT t, name, cols, true AS con FROM con UNION ALL SELECT t, name, cols, false FROM ix),
  ts AS (SELECT DISTINCT t FROM p)"""
LINT = f"""WITH RECURSIVE {CATALOG},
  e AS (SELECT DISTINCT t AS a, r AS b FROM fks WHERE t <> r), walk AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM walk w JOIN e ON w.b = e.a),
  known AS (SELECT k, CASE k WHEN 'INT4' THEN 'INTEGER' WHEN 'VARCHAR2' THEN 'VARCHAR' WHEN 'NUMBER' THEN 'NUMERIC' ELSE k END AS same FROM (SELECT DISTINCT k FROM p)),
  led AS (SELECT x.*, a.same AS ca, z.same AS pa, pk.fl FROM fks x JOIN pk ON pk.t = x.r JOIN known a ON a.k = x.k JOIN known z ON z.k = pk.fk)
  SELECT 'fkNoIndex' AS rule, t AS table_name, c AS detail FROM fks WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.t = fks.t AND k.cols[1] = fks.c) UNION ALL SELECT 'fkNoIndex', t, c FROM fks WHERE twice AND NOT EXISTS (SELECT 1 FROM keys k WHERE k.t = fks.t AND k.cols[1] = fks.c)
  UNION ALL SELECT 'noRelation', t, '' FROM ts WHERE t NOT IN (SELECT t FROM fks UNION SELECT r FROM fks) UNION ALL SELECT 'noIndex', t, '' FROM ts WHERE t NOT IN (SELECT t FROM keys)
  UNION ALL SELECT 'noPk', t, '' FROM ts WHERE t NOT IN (SELECT t FROM pk) AND t IN (SELECT t FROM keys)
  UNION ALL SELECT 'tooManyColumns', t, CAST(count(*) AS VARCHAR) FROM p GROUP BY t HAVING count(*) > 8 UNION ALL SELECT 'singleColumn', t, '1' FROM p GROUP BY t HAVING count(*) = 1
  UNION ALL SELECT 'missingRequired', t, 'REG_DT' FROM ts
  UNION ALL SELECT 'dupRelation', t, c || '->' || r FROM fks WHERE twice
  UNION ALL SELECT 'serialColumns', t, 'TEL' FROM p WHERE starts_with(c, 'TEL') GROUP BY t HAVING count(*) >= 3 UNION ALL SELECT 'defaultNullString', t, c FROM p WHERE dn
  UNION ALL SELECT 'fkTypeMismatch', t, c || CASE WHEN ca <> pa THEN ' type' ELSE ' length' END FROM led, range(0, 2) again(i) WHERE (ca <> pa OR l <> fl) AND (i = 0 OR twice)
  UNION ALL SELECT DISTINCT 'dupIndex', i.t, i.name FROM ix i JOIN keys k ON k.t = i.t AND k.name <> i.name WHERE k.cols[1 : len(i.cols)] = i.cols AND (len(k.cols) > len(i.cols) OR k.con OR k.name < i.name)
  UNION ALL SELECT 'uniqueNullable', t, c FROM p WHERE l % 10 = 4 AND n
  UNION ALL SELECT 'tooManyLobs', t, CAST(count(*) AS VARCHAR) FROM p WHERE k = 'CLOB' GROUP BY t HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'fkCycle', a, '' FROM walk WHERE a = b"""


def key_rows(s, d):
    """One row for each column of an index or key, as drivers list them: with the rows of statistics, that have no name, and the primary keys' own."""
    _, _, constraints, indexes = catalog(s, d)
    named = indexes.select("table_name", "name", "is_unique", "columns").union(constraints.where("kind in ('PK', 'UQ')").select("table_name", "name", F.lit(True), "columns"))
    rows = named.select("table_name", "name", "is_unique", F.posexplode("columns").alias("at", "column")).select("table_name", "name", "is_unique", "column", (F.col("at") + 1).alias("seq"))
    return rows.union(indexes.select("table_name", F.lit(None).cast("string"), F.lit(False), F.lit(None).cast("string"), F.lit(0)))


def primary(s, d):
    return catalog(s, d)[2].where("kind = 'PK'").select("table_name", "name", "columns")


def foreign_rows(s, d):
    """References to the next maker's table, by two columns each, of another schema where the size ends in 3 after an odd ten."""
    p = parts(s, d).where("size % 10 = 3")
    pairs = F.array(F.struct(F.lit(2).alias("seq"), F.lit("B").alias("column"), F.lit("Y").alias("ref_column")), F.struct(F.lit(1).alias("seq"), F.col("name").alias("column"), F.lit("X").alias("ref_column")))
    schema = F.when(F.col("size") % 20 == 3, "main").otherwise("other")
    return p.select(F.lit("main").alias("schema_name"), "table_name", F.concat(F.lit("FK_"), "name").alias("name"), schema.alias("ref_schema"), F.col("other").alias("ref_table"), F.explode(pairs).alias("c")).select("schema_name", "table_name", "name", "ref_schema", "ref_table", "c.*")


def snapshot(s, d, new):
    none = F.lit(None)
    return alter_plans.columns(s, d, new).withColumns({"precision": none.cast("int"), "comment": none.cast("string"), "schema_name": F.lit("main")})


def structures(s, d, new):
    none = F.lit(None).cast("string")
    return alter_plans.keys(s, d, new).withColumns({"delete_rule": none, "update_rule": none})


def described(s, d):
    return table(s, d, "part").select(F.when(F.col("p_size") % 3 != 0, F.col("p_name")).otherwise(" \t ").alias("comment"))


SNAPSHOT = "SELECT upper(translate(p_brand, '#', '_')) AS t, 'C' || p_partkey AS c, p_partkey % 50 AS m, p_size FROM part"
ENDS = f"SELECT t, min(c) AS a, max(c) AS b FROM ({SNAPSHOT}) WHERE m <> 0 GROUP BY t"
WORDS = "SELECT DISTINCT p_type, string_split(p_type, ' ') AS w FROM part"
QUERIES = {
    "lint_parts": (lambda s, d: lint.all_rules(*catalog(s, d, scratch(s, parts(s, d), "parts")), most_columns=8, required=["REG_DT"]), LINT),
    "no_pk_parts": (lambda s, d: catalog(s, d)[0].join(primary(s, d), "table_name", "left_anti"), f"WITH {CATALOG} SELECT t AS table_name FROM ts WHERE t NOT IN (SELECT t FROM pk)"),
    "key_info_parts": (
        lambda s, d: definitions.key_info(catalog(s, d)[1], catalog(s, d)[2]),
        f"""WITH {CATALOG}, u AS (SELECT t, c, row_number() OVER (PARTITION BY t ORDER BY 'UQ_' || c) AS k FROM p WHERE l % 10 = 4)
        SELECT p.t AS table_name, p.c AS name, CASE WHEN pk.c IS NULL THEN '' ELSE 'PK01' END AS pk, coalesce('AK_' || u.k || '-01', '') AS ak, coalesce(r || CASE WHEN twice THEN ', ' || r ELSE '' END, '') AS fk
        FROM p LEFT JOIN pk ON pk.t = p.t AND pk.c = p.c LEFT JOIN u ON u.t = p.t AND u.c = p.c LEFT JOIN fks ON fks.t = p.t AND fks.c = p.c""",
    ),
    "indexes_parts": (
        lambda s, d: catalogs.indexes(key_rows(s, d), primary(s, d)).select("table_name", "name", "is_unique", F.array_join("columns", ",").alias("columns")),
        f"WITH {CATALOG} SELECT t AS table_name, name, false AS is_unique, array_to_string(cols, ',') AS columns FROM ix UNION ALL SELECT t, 'UQ_' || c, true, c FROM p WHERE l % 10 = 4",
    ),
    "unique_keys_parts": (
        lambda s, d: catalogs.unique_keys(key_rows(s, d), primary(s, d)).select("table_name", "name", F.array_join("columns", ",").alias("columns")),
        f"WITH {CATALOG} SELECT t AS table_name, 'UQ_' || c AS name, c AS columns FROM p WHERE l % 10 = 4 AND NOT EXISTS (SELECT 1 FROM pk WHERE pk.t = p.t AND pk.c = p.c)",
    ),
    "foreign_keys_parts": (
        lambda s, d: catalogs.foreign_keys(foreign_rows(s, d)).select("table_name", "name", F.array_join("columns", ",").alias("columns"), "ref_schema", "ref_table", F.array_join("ref_columns", ",").alias("ref_columns")),
        f"WITH {CATALOG} SELECT t AS table_name, 'FK_' || c AS name, c || ',B' AS columns, CASE WHEN l % 20 <> 3 THEN 'other' END AS ref_schema, r AS ref_table, 'X,Y' AS ref_columns FROM fks",
    ),
    "snapshot_parts": (
        lambda s, d: metadata.column_diff(snapshot(s, d, False), snapshot(s, d, True)),
        f"""SELECT t AS table_name, c AS name, CASE m WHEN 0 THEN 'removed' WHEN 1 THEN 'added' ELSE 'changed' END AS change, CASE WHEN m < 2 THEN '' ELSE f END AS fields FROM (
        SELECT *, concat_ws(',', CASE WHEN p_size > 40 THEN 'length' END, CASE WHEN p_size % 7 = 0 THEN 'nullable' END, CASE WHEN p_size % 5 = 0 AND p_size % 15 <> 0 THEN 'default_value' END) AS f FROM ({SNAPSHOT})) WHERE m < 2 OR f <> ''""",
    ),
    "structures_parts": (
        lambda s, d: metadata.structure_diff(structures(s, d, False), structures(s, d, True)),
        f"""WITH g AS ({ENDS}), o AS (SELECT t, unnest(['PK(' || a || ')', 'CK(' || a || ' > 0)', 'CK(' || a || ' < 9)', 'CK(' || b || ' <> 2)', 'UQ(' || a || ')', 'IX(' || a || ')']) AS text FROM g),
        n AS (SELECT t, unnest(['PK(' || a || ',' || b || ')', 'CK(' || a || ' > 1)', 'CK(' || a || ' < 9)', 'CK(' || b || ' <> 3)', 'UQ(' || b || ')', 'IX(' || a || ')']) AS text FROM g)
        SELECT t AS table_name, text, 'removed' AS change FROM (FROM o EXCEPT FROM n) UNION ALL SELECT t, text, 'added' FROM (FROM n EXCEPT FROM o)""",
    ),
    "constraint_text_parts": (
        lambda s, d: definitions.constraint_text(alter_plans.columns(s, d, True), alter_plans.keys(s, d, True).where("kind = 'CK'").select("table_name", "condition")),
        f"""WITH g AS ({ENDS}), k AS (SELECT t, a AS c, ['CHECK (' || a || '  <' || chr(10) || ' 9)', 'CHECK (' || a || ' > 1)'] AS cs FROM g UNION ALL SELECT t, b, ['CHECK (' || b || ' <> 3)'] FROM g),
        m AS (SELECT t, c, array_to_string(list_sort(flatten(list(cs))), '; ') AS text FROM k GROUP BY ALL)
        SELECT x.t AS table_name, x.c AS name, concat_ws('; ', CASE WHEN p_size % 5 = 0 THEN 'DEFAULT ''x''' END, m.text) AS text FROM ({SNAPSHOT}) x LEFT JOIN m ON m.t = x.t AND m.c = x.c WHERE x.m <> 0""",
    ),
    "length_text_parts": (
        lambda s, d: table(s, d, "part").select("p_partkey", definitions.length_text(F.when(F.col("p_size") % 3 == 0, F.col("p_size")), F.when(F.col("p_size") % 3 == 1, F.col("p_size")), F.col("p_size") % 4).alias("text")),
        "SELECT p_partkey, CASE p_size % 3 WHEN 2 THEN '' WHEN 0 THEN CAST(p_size AS VARCHAR) ELSE p_size || CASE WHEN p_size % 4 > 0 THEN ',' || (p_size % 4) ELSE '' END END AS text FROM part",
    ),
    "comment_fill_parts": (
        lambda s, d: definitions.comment_fill(table(s, d, "part").groupBy("p_brand").agg(F.max(F.when(F.col("p_size") > 48, F.col("p_name"))).alias("comment")), described(s, d)),
        "SELECT 'table' AS level, count(*) FILTER (WHERE x) AS with_comment, count(*) AS total FROM (SELECT max(p_size) > 48 AS x FROM part GROUP BY p_brand) UNION ALL SELECT 'column', count(*) FILTER (WHERE p_size % 3 <> 0), count(*) FROM part",
    ),
    "schema_size_parts": (
        lambda s, d: definitions.schema_size(table(s, d, "part").select(F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("long") * 65536).alias("size_bytes"))),
        "SELECT CASE WHEN mb < 1024 THEN printf('%.1f MB', mb) ELSE printf('%.1f GB', mb / 1024) END AS size FROM (SELECT sum(p_size * 65536) / 1048576.0 AS mb FROM part WHERE p_size % 3 = 0)",
    ),
    "repeated_names_parts": (
        lambda s, d: metadata.repeated_names(table(s, d, "part").select(F.col("p_brand").alias("schema_name"), F.col("p_type").alias("table_name"))),
        "SELECT p_type AS table_name, count(DISTINCT p_brand) AS schemas FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1",
    ),
    "business_parts": (
        lambda s, d: parts(s, d).groupBy("table_name").count().select("table_name", definitions.classified(F.col("table_name"), {"one": ["brand_1"], "odd": ["/brand_[0-9]*[13579]/"], "none": [" "]}).alias("class")),
        "SELECT DISTINCT t AS table_name, CASE WHEN t LIKE 'BRAND@_1%' ESCAPE '@' THEN 'one' WHEN regexp_full_match(t, 'BRAND_[0-9]*[13579]') THEN 'odd' ELSE '' END AS class FROM (SELECT upper(translate(p_brand, '#', '_')) AS t FROM part)",
    ),
    "field_names_parts": (
        lambda s, d: table(s, d, "part").select("p_type").distinct().select("p_type", names.field_name(F.translate("p_type", " ", "_")).alias("field"), names.class_name(F.translate("p_type", " ", "_"), ["STANDARD"]).alias("class")),
        f"""WITH x AS (SELECT *, list_transform(w, lambda v: upper(v[1]) || lower(v[2:])) AS u, CASE WHEN upper(w[1]) = 'STANDARD' AND len(w) > 1 THEN 2 ELSE 1 END AS k FROM ({WORDS}))
        SELECT p_type, lower(w[1]) || array_to_string(u[2:], '') AS field, array_to_string(u[k:], '') AS class FROM x""",
    ),
    "java_types_parts": (
        lambda s, d: table(s, d, "part").select("p_partkey", names.java_type(F.lit("DECIMAL"), F.col("p_size"), F.col("p_size") % 3 - 1).alias("java")),
        "SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 'java.math.BigDecimal' WHEN p_size <= 9 THEN 'Integer' WHEN p_size <= 19 THEN 'Long' ELSE 'java.math.BigDecimal' END AS java FROM part",
    ),
    "path_normalise_pages": (
        lambda s, d: table(s, d, "pages").select("page_id", names.path_normalise(F.concat(F.lit(" C:\\X\\..\\"), F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", ""), F.lit("/./Y//"))).alias("path")),
        "SELECT page_id, '/c:/' || array_to_string(list_filter(string_split(lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '')), '/'), lambda x: x NOT IN ('', '.')), '/') || '/y' AS path FROM pages WHERE url IS NOT NULL",
    ),
}
