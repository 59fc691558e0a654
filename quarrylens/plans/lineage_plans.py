"""Lineage over the star schema: a supplier is a program, a brand a table, a return flag a CRUD letter, a nation a url, a region's nations its screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions.text import url_module, url_normalise
from quarrylens.operators import lineage
from quarrylens.session import table

CRUD = "SELECT l_suppkey AS program_id, p_brand AS table_name, translate(l_returnflag, 'ANR', 'CRU') || CASE WHEN l_linenumber = 7 THEN 'D' ELSE '' END AS crud FROM lineitem JOIN part ON p_partkey = l_partkey"
PROGRAMS = "SELECT s_suppkey AS program_id, '/n' || s_nationkey AS url, 'm' || (s_suppkey % 4) AS module, 'ns.q' || s_suppkey AS ns_id FROM supplier"
LINKS = "SELECT '/n' || n_nationkey AS url, 'screen' || n_regionkey AS screen FROM nation WHERE n_nationkey % 5 <> 0"
STATEMENTS = "SELECT 'q.' || replace(p_type, ' ', '.') || '.' || p_size AS ns_id FROM part"
CALLED = f"SELECT DISTINCT ns_id FROM ({STATEMENTS}) WHERE ns_id LIKE '%5'"
CALLED_BY_PREFIX = "SELECT DISTINCT 'q.' || replace(p_type, ' ', '.') || '.' AS prefix FROM part WHERE p_size > 45 AND p_brand = 'Brand#55'"
PREFIXES = "SELECT DISTINCT 'q.' || split_part(p_type, ' ', 1) || '.' AS prefix FROM part WHERE p_size < 3"
UNION_LETTERS = "concat(max(CASE WHEN contains(crud, 'C') THEN 'C' ELSE '' END), max(CASE WHEN contains(crud, 'R') THEN 'R' ELSE '' END), max(CASE WHEN contains(crud, 'U') THEN 'U' ELSE '' END), max(CASE WHEN contains(crud, 'D') THEN 'D' ELSE '' END))"
BRANDS = [f"Brand#{maker}{line}" for maker in range(1, 6) for line in range(1, 6)]


def crud(s, d):
    l = table(s, d, "lineitem")
    letter = F.concat(F.translate("l_returnflag", "ANR", "CRU"), F.when(F.col("l_linenumber") == 7, "D").otherwise(""))
    return l.join(table(s, d, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("program_id"), F.col("p_brand").alias("table_name"), letter.alias("crud"))


def programs(s, d):
    text = lambda a, b: F.concat(F.lit(a), b.cast("string"))
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("program_id"), text("/n", F.col("s_nationkey")).alias("url"), text("m", F.col("s_suppkey") % 4).alias("module"), text("ns.q", F.col("s_suppkey")).alias("ns_id"))


def links(s, d):
    return table(s, d, "nation").where("n_nationkey % 5 <> 0").select(F.concat(F.lit("/n"), "n_nationkey").alias("url"), F.concat(F.lit("screen"), "n_regionkey").alias("screen"))


def statements(s, d):
    return table(s, d, "part").select(F.concat(F.lit("q."), F.replace("p_type", F.lit(" "), F.lit(".")), F.lit("."), "p_size").alias("ns_id"))


def called(s, d):
    return statements(s, d).where("ns_id like '%5'").distinct()


def prefixes(s, d):
    return table(s, d, "part").where("p_size < 3").select(F.concat(F.lit("q."), F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit(".")).alias("prefix")).distinct()


def called_by_prefix(s, d):
    return table(s, d, "part").where("p_size > 45 and p_brand = 'Brand#55'").select(F.concat(F.lit("q."), F.replace("p_type", F.lit(" "), F.lit(".")), F.lit(".")).alias("prefix")).distinct()


def stock(s, d):
    """Database tables: brands, which code uses, and types of parts, which it does not; those of small parts only are empty."""
    names = table(s, d, "part").select(F.explode(F.array(F.lower("p_brand"), F.lower("p_type"))).alias("table_name"), "p_size")
    return names.groupBy("table_name").agg(F.when(F.max("p_size") > 40, F.lit(None)).otherwise(F.lit(0)).cast("long").alias("row_count"))


def risks(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("risk_id"), F.concat(F.lit("ns.q"), F.col("c_custkey") % 300).alias("ns_id"))


def menus(s, d):
    return table(s, d, "nation").where("n_nationkey < 9").select(F.concat(F.lit("/n"), "n_nationkey").alias("url"), F.col("n_name").alias("menu")).union(
        table(s, d, "region").where("r_regionkey < 3").select(F.concat(F.lit("screen"), "r_regionkey"), "r_name"))


MENUS = "SELECT '/n' || n_nationkey AS url, n_name AS menu FROM nation WHERE n_nationkey < 9 UNION ALL SELECT 'screen' || r_regionkey, r_name FROM region WHERE r_regionkey < 3"

QUERIES = {
    "crud_long": (lambda s, d: lineage.crud_long(crud(s, d)), f"SELECT program_id, table_name, {UNION_LETTERS} AS crud FROM ({CRUD}) GROUP BY ALL"),
    "module_matrix": (lambda s, d: lineage.module_matrix(crud(s, d), programs(s, d)), f"SELECT table_name, module, {UNION_LETTERS} AS crud FROM ({CRUD}) JOIN ({PROGRAMS}) USING (program_id) GROUP BY ALL"),
    "crud_matrix": (
        lambda s, d: lineage.crud_matrix(crud(s, d), "program_id", BRANDS),
        "WITH c AS (" + CRUD + ") SELECT program_id, " + ", ".join(f"concat({', '.join(f'''max(CASE WHEN table_name = '{b}' AND contains(crud, '{x}') THEN '{x}' ELSE '' END)''' for x in 'CRUD')}) AS {b.lower().replace('#', '_')}" for b in BRANDS) + " FROM c GROUP BY 1",
    ),
    "program_counts": (lambda s, d: lineage.program_counts(crud(s, d)), f"SELECT table_name, count(DISTINCT program_id) AS programs FROM ({CRUD}) GROUP BY 1"),
    "impact": (lambda s, d: lineage.impact(crud(s, d), programs(s, d), links(s, d)), f"SELECT DISTINCT table_name, program_id, screen FROM ({CRUD}) JOIN ({PROGRAMS}) USING (program_id) LEFT JOIN ({LINKS}) USING (url)"),
    "programs_touching": (lambda s, d: lineage.touching(programs(s, d), crud(s, d), "Brand#12"), f"SELECT * FROM ({PROGRAMS}) WHERE program_id IN (SELECT program_id FROM ({CRUD}) WHERE table_name = 'Brand#12')"),
    "consistency": (
        lambda s, d: lineage.consistency(crud(s, d).union(s.createDataFrame([(0, "TB_GHOST", "R")], "a long, b string, c string")), stock(s, d), F.col("table_name").endswith("brass"), F.col("table_name").startswith("promo")),
        f"""WITH c AS (SELECT DISTINCT upper(table_name) AS t FROM ({CRUD}) UNION SELECT 'TB_GHOST'), b AS (SELECT n, CASE WHEN max(p_size) > 40 THEN NULL ELSE 0 END AS r FROM (SELECT lower(p_brand) AS n, p_size FROM part UNION ALL SELECT lower(p_type), p_size FROM part) GROUP BY 1)
        SELECT t AS table_name, 'missing_in_db' AS side, 'none' AS reason FROM c WHERE t NOT IN (SELECT upper(n) FROM b)
        UNION ALL SELECT upper(n), 'unused_in_code', CASE WHEN n LIKE '%brass' THEN 'scope' WHEN n LIKE 'promo%' THEN 'schema' WHEN r = 0 THEN 'empty' ELSE 'none' END FROM b WHERE upper(n) NOT IN (SELECT t FROM c)""",
    ),
    "orphan_statements": (
        lambda s, d: lineage.orphan_statements(statements(s, d).distinct(), called(s, d), called_by_prefix(s, d)),
        f"SELECT DISTINCT ns_id FROM ({STATEMENTS}) s WHERE ns_id NOT LIKE '%5' AND NOT EXISTS (SELECT 1 FROM ({CALLED_BY_PREFIX}) p WHERE starts_with(s.ns_id, p.prefix))",
    ),
    "prefix_expand": (
        lambda s, d: lineage.prefix_expand(statements(s, d).distinct(), prefixes(s, d)),
        f"SELECT prefix, ns_id FROM (SELECT DISTINCT ns_id FROM ({STATEMENTS})) JOIN ({PREFIXES}) ON starts_with(ns_id, prefix)",
    ),
    "suffix_match": (
        lambda s, d: lineage.suffix_match(table(s, d, "pages").select(F.regexp_extract("url", "([^/]+/[^/]+)$", 1).alias("view")).where("view <> ''"), table(s, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))),
        """WITH v AS (SELECT DISTINCT regexp_extract(url, '([^/]+/[^/]+)$', 1) AS view FROM pages), p AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)
        SELECT view, path FROM v JOIN p ON path = view OR suffix(path, '/' || view) WHERE view <> ''""",
    ),
    "risk_left_join": (
        lambda s, d: lineage.reached_risks(risks(s, d), programs(s, d)),
        f"SELECT risk_id, ns_id, count(program_id) AS reached FROM (SELECT c_custkey AS risk_id, 'ns.q' || (c_custkey % 300) AS ns_id FROM customer) LEFT JOIN ({PROGRAMS}) USING (ns_id) GROUP BY ALL",
    ),
    "menu_overlay": (
        lambda s, d: lineage.menu_overlay(programs(s, d), menus(s, d), links(s, d)),
        f"""WITH m AS ({MENUS}), o AS (SELECT url, min(menu) AS own FROM m GROUP BY 1), v AS (SELECT l.url, min(m.menu) AS via FROM ({LINKS}) l JOIN m ON m.url = l.screen GROUP BY 1)
        SELECT program_id, coalesce(own, via) AS menu, CASE WHEN own IS NOT NULL THEN 'url' WHEN via IS NOT NULL THEN 'screen' ELSE 'none' END AS basis FROM ({PROGRAMS}) LEFT JOIN o USING (url) LEFT JOIN v USING (url)""",
    ),
    "url_modules": (
        lambda s, d: table(s, d, "pages").select(url_module(F.regexp_replace("url", "^[a-z]+:/", "")).alias("module"), url_normalise(F.col("url")).alias("u")).groupBy("module").agg(F.count("*").alias("cnt"), F.countDistinct("u").alias("urls")),
        """WITH a AS (SELECT list_filter(string_split(split_part(regexp_replace(url, '^[a-z]+:/', ''), '?', 1), '/'), lambda x: x <> '') AS p, nullif(trim(split_part(trim(url), '?', 1)), '') AS u FROM pages)
        SELECT CASE WHEN len(p) <= 1 THEN '/' ELSE '/' || array_to_string(p[1:least(2, len(p) - 1)], '/') END AS module, count(*) AS cnt, count(DISTINCT u) AS urls FROM a GROUP BY 1""",
    ),
    "call_reach": (
        lambda s, d: lineage.reachable(table(s, d, "nation").select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") * 2 % 25).alias("b")), 4),
        "WITH RECURSIVE e AS (SELECT n_nationkey AS a, n_nationkey * 2 % 25 AS b FROM nation), r AS (SELECT a, b, 1 AS k FROM e UNION SELECT r.a, e.b, k + 1 FROM r JOIN e ON r.b = e.a WHERE k < 4) SELECT DISTINCT a, b FROM r",
    ),
}
