"""Report counts, orders, standards, names, relations and alter plans: over the star schema where its rows can stand in, else over literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions import names
from quarrylens.operators import alter, catalog, inputs, masking, metadata, naming, relations, reports, standards
from quarrylens.plans.metadata_plans import SCOPE, values
from quarrylens.session import TABLES, table


def menus(s, d):
    """Customers as menus: those of a negative balance have no url."""
    return table(s, d, "customer").select(F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("/c"), "c_nationkey")).alias("url"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("c_nationkey")).alias("loaded_at"))


def warnings(s, d):
    """Error events as warnings: users as codes, some unknown."""
    e = table(s, d, "events").where("event_type in ('error', 'view')")
    return e.select(F.col("event_type").alias("kind"), F.when(F.col("value") > 10, "42000").alias("sqlstate"), F.when(F.col("user_id") > 50, F.col("user_id").cast("int") % 10).alias("code"))


WARNINGS = "SELECT event_type AS kind, CASE WHEN value > 10 THEN '42000' END AS sqlstate, CASE WHEN user_id > 50 THEN user_id % 10 END AS code FROM events WHERE event_type IN ('error', 'view')"


def screen_programs(s, d):
    """Parts as programs: the size says what views one has."""
    k = F.col("p_size") % 6
    kinds = F.when(k == 0, F.array(F.lit("view"), F.lit("redirect"))).when(k == 1, F.array(F.lit("redirect"))).when(k == 2, F.array(F.lit("class"), F.lit("forward"))).when(k == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("forward"), F.lit("view")))
    return table(s, d, "part").select(F.when(k == 4, "json").otherwise("page").alias("kind"), kinds.alias("view_kinds"))


def outcomes(s, d):
    """Line items as probed statements."""
    k = F.col("l_linenumber")
    return table(s, d, "lineitem").select(F.when(k <= 3, "PASS").when(k == 4, "ERROR").when(k == 5, "SKIP_DYNAMIC").when(k == 6, "SKIP_DOLLAR").otherwise("SKIP_REFUSED").alias("status"))


OUTCOMES = "SELECT CASE WHEN l_linenumber <= 3 THEN 'PASS' WHEN l_linenumber = 4 THEN 'ERROR' WHEN l_linenumber = 5 THEN 'SKIP_DYNAMIC' WHEN l_linenumber = 6 THEN 'SKIP_DOLLAR' ELSE 'SKIP_REFUSED' END AS status FROM lineitem"


def ordered_findings(s, d):
    """Parts as findings in a report's order; those of equal place by their key."""
    p = table(s, d, "part").select(F.element_at(F.split("p_type", " "), -1).alias("rule"), F.col("p_brand").alias("schema_name"), F.col("p_name").alias("table_name"), F.when(F.col("p_size") > 9, F.col("p_size").cast("string")).alias("column"), "p_partkey")
    return reports.finding_order(p, ["TIN", "STEEL", "NICKEL", "BRASS", "COPPER"], "p_partkey")


USED, RARE = "SELECT DISTINCT unnest(string_split(upper(p_name), ' ')) AS token FROM part", 3


def used_tokens(s, d):
    return table(s, d, "part").select(F.explode(F.split(F.upper("p_name"), " ")).alias("token")).distinct()


def words(s, d):
    """The tokens of part names as words: all common, the short ones also an organisation's, those with an A also a user's."""
    t = used_tokens(s, d)
    common = t.select(F.lit("word").alias("kind"), F.col("token").alias("abbr"), F.lower("token").alias("word_ko"), F.when(F.length("token") > 4, "Y").otherwise("").alias("form_word"))
    org = t.where("length(token) < 6").select(F.lit("org"), "token", F.concat(F.lower("token"), F.lit("_o")), F.lit(""))
    user = t.where("contains(token, 'A')").select(F.lit("user"), "token", F.concat(F.lower("token"), F.lit("_u")), F.lit(""))
    return common.union(org).union(user)


WORD_ROWS = f"""SELECT token AS abbr, CASE WHEN contains(token, 'A') THEN lower(token) || '_u' WHEN length(token) < 6 THEN lower(token) || '_o' ELSE lower(token) END AS word_ko,
  CASE WHEN NOT contains(token, 'A') AND length(token) >= 6 THEN 'Y' ELSE 'N' END AS form_word,
  CASE WHEN contains(token, 'A') THEN '사용자입력' WHEN length(token) < 6 THEN '기관표준단어' ELSE '공통표준단어' END AS source,
  CASE WHEN contains(token, 'A') OR length(token) < 6 THEN '공통표준단어' || CASE WHEN length(token) < 6 THEN '/기관표준단어' ELSE '' END || CASE WHEN contains(token, 'A') THEN '/사용자입력' ELSE '' END ELSE '' END AS duplicates FROM ({USED})"""


def domain_columns(s, d):
    """Parts as columns: the last word of the type is the concept, the size the length."""
    return table(s, d, "part").select(
        F.col("p_partkey").alias("ordinal"), F.lower("p_type").alias("logical"), F.when(F.col("p_size") % 3 == 0, "VARCHAR2").when(F.col("p_size") % 3 == 1, "NUMBER").otherwise("").alias("native_type"),
        (F.col("p_size") % 5).alias("length"), F.when(F.col("p_size") % 2 == 0, 0).alias("scale"),
    )


CONCEPTS = [("tin",), ("brass",), ("steel",)]
DOMAINS = [("tin", "T", "V3", "VARCHAR", 3, None), ("tin", "T", "V3b", "VARCHAR", 3, None), ("tin", "T", "N1", "NUMERIC", 1, 0), ("brass", "B", "C3", "CHAR", 3, None)]


def domains(s, d):
    columns = domain_columns(s, d)
    found = naming.longest_suffix(columns, "logical", s.createDataFrame(CONCEPTS, "concept string")).withColumnRenamed("name", "logical")
    return standards.domain_rows(columns, found, s.createDataFrame(DOMAINS, "concept string, class string, domain string, native_type string, length int, scale int")).select("key", "domain", "native_type", "length", "scale", "frequency", "review")


DOMAIN_ROWS = f"""WITH c AS (SELECT p_partkey, lower(p_type) AS logical, CASE p_size % 3 WHEN 0 THEN 'VARCHAR2' WHEN 1 THEN 'NUMBER' ELSE '' END AS t, p_size % 5 AS l, CASE WHEN p_size % 2 = 0 THEN 0 END AS s FROM part),
  k AS (SELECT *, CASE WHEN suffix(logical, 'tin') THEN 'tin' WHEN suffix(logical, 'brass') THEN 'brass' WHEN suffix(logical, 'steel') THEN 'steel' END AS concept FROM c WHERE t <> ''),
  m AS (SELECT *, CASE WHEN concept = 'tin' AND t = 'VARCHAR2' AND l = 3 AND s IS NULL THEN 'V3' WHEN concept = 'tin' AND t = 'NUMBER' AND l = 1 AND s = 0 THEN 'N1' END AS domain FROM k),
  z AS (SELECT *, '|' || t || '|' || l || '|' || coalesce(CAST(s AS VARCHAR), '') AS size FROM m)
  SELECT CASE WHEN domain IS NOT NULL THEN 'M|T|' || domain WHEN concept IS NOT NULL THEN 'W|' || concept || size ELSE 'U' || size END AS key, coalesce(domain, '') AS domain, t AS native_type, l AS length, s AS scale, count(*) AS frequency,
  CASE WHEN domain IS NOT NULL THEN '' WHEN concept IS NOT NULL THEN '{standards.OTHER_SPEC}' ELSE '{standards.NO_CONCEPT}' END AS review FROM z GROUP BY ALL"""


def coverage(s, d):
    """The words that all names use, the unregistered parts of customers' names, and the terms of suppliers' names by balance."""
    rank = table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("token")).agg(F.count_if(F.col("c_acctbal") < 0).alias("cnt"))
    terms = table(s, d, "supplier").select(F.when(F.col("s_acctbal") < 0, "none").when(F.col("s_acctbal") < 1000, "mix").otherwise("word").alias("source"))
    return standards.coverage(used_tokens(s, d), rank, terms)


COVERAGE = f"""WITH r AS (SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal < 0) AS cnt FROM customer GROUP BY 1)
  SELECT (SELECT count(*) FROM ({USED})) AS words, (SELECT count(*) FROM r WHERE cnt > 0) AS missing_tokens, (SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) FROM r) AS missing_occurrences,
  count(*) AS terms, count(*) FILTER (WHERE s_acctbal >= 0 AND s_acctbal < 1000) AS partial, count(*) FILTER (WHERE s_acctbal < 0) AS unmatched FROM supplier"""


def mapper_joins(s, d):
    """Line items as statements that join parts, orders and suppliers as tables, by one key column or by both."""
    l = table(s, d, "lineitem").select(F.concat(F.lit("s"), "l_orderkey").alias("ns_id"), "l_linenumber", "l_returnflag")
    row = lambda a, ca, b, cb: F.struct(F.lit(a).alias("table_a"), F.lit(ca).alias("col_a"), F.lit(b).alias("table_b"), F.lit(cb).alias("col_b"))
    k = F.col("l_linenumber")
    return l.select("ns_id", F.when(k == 1, row("Items", "order_id", "ORDERS", "id")).when(k == 2, row("PARTS", "id", "items", "part_id")).when(k == 3, row("items", "seq", "STOCK", "seq")).when(k == 4, row("items", "no", "STOCK", "no")).when(k == 5, row("V_ALL", "id", "ORDERS", "id")).otherwise(row("ORDERS", "user_id", "USERS", "id")).alias("r")).select("ns_id", "r.*")


PKS = [("ITEMS", ["ORDER_ID", "PART_ID"]), ("ORDERS", ["ID"]), ("PARTS", ["ID"]), ("STOCK", ["SEQ", "NO"]), ("V_ALL", []), ("USERS", ["ID"])]


def mapper_relations(s, d):
    return relations.statement_relations(mapper_joins(s, d), s.createDataFrame(PKS, "table_name string, columns array<string>"), s.createDataFrame([("orders", "users")], "child string, parent string"), s.createDataFrame([("v_all",)], "table_name string"))


OLD_COLUMNS = [("T", "A", "INTEGER", None, None, False, None), ("T", "B", "VARCHAR", 20, None, True, None), ("T", "C", "CHAR", 4, None, True, "'x'"), ("T", "D", "DATE", None, None, True, None), ("GONE", "X", "INTEGER", None, None, True, None), ("S", "ID", "BIGINT", None, None, False, None)]
NEW_COLUMNS = [("t", "a", "BIGINT", None, None, False, None), ("t", "b", "VARCHAR", 10, None, False, None), ("t", "c", "CHAR", 4, None, True, None), ("t", "e", "NUMERIC", 9, 2, False, None), ("FRESH", "ORDER", "VARCHAR", 5, None, False, "'a'"), ("S", "ID", "BIGINT", None, None, False, None), ("S", "N", "INTEGER", None, None, True, None)]
OLD_KEYS = [("T", "UQ_B", "UQ", ["B"], None, None), ("T", "IX_D", "IX", ["D"], None, None), ("T", "FK_S", "FK", ["A"], "S", ["ID"]), ("GONE", "IX_X", "IX", ["X"], None, None)]
NEW_KEYS = [("T", "UQ_B", "UQ", ["b"], None, None), ("T", "FK_S", "FK", ["A"], "S", ["N"]), ("T", "IX_E", "IX", ["E"], None, None)]
COLUMN_KIND = "table_name string, name string, native_type string, length int, scale int, nullable boolean, default_value string"
KEY_KIND = "table_name string, name string, kind string, columns array<string>, ref_table string, ref_columns array<string>"
PLAN = [
    ("changed tables", "T", "a", 'ALTER TABLE T ALTER COLUMN a TYPE BIGINT', "data"), ("changed tables", "T", "b", "ALTER TABLE T ALTER COLUMN b TYPE VARCHAR(10)", "data"), ("changed tables", "T", "b", "ALTER TABLE T ALTER COLUMN b SET NOT NULL", "data"),
    ("changed tables", "T", "c", "ALTER TABLE T ALTER COLUMN c DROP DEFAULT", ""), ("changed tables", "T", "e", "ALTER TABLE T ADD COLUMN e NUMERIC(9,2) NOT NULL", "data"), ("changed tables", "T", "D", "-- ALTER TABLE T DROP COLUMN D", "delete"),
    ("changed tables", "T", "", "-- columns are both dropped and added: RENAME if a name changed", "rename"), ("changed tables", "S", "N", "ALTER TABLE S ADD COLUMN N INTEGER", ""), ("new tables", "FRESH", "", "CREATE TABLE FRESH (\"order\" VARCHAR(5) DEFAULT 'a' NOT NULL)", ""),
    ("drop tables", "GONE", "", "-- DROP TABLE GONE", "delete"), ("drop indexes", "T", "IX_D", "DROP INDEX IX_D", ""), ("drop foreign keys", "T", "FK_S", "ALTER TABLE T DROP CONSTRAINT FK_S", ""),
    ("add foreign keys", "T", "FK_S", "ALTER TABLE T ADD CONSTRAINT FK_S FOREIGN KEY (A) REFERENCES S (N)", ""), ("add indexes", "T", "IX_E", "CREATE INDEX IX_E ON T (E)", ""),
]


def alter_plan(s, d):
    return alter.alter_plan(s.createDataFrame(OLD_COLUMNS, COLUMN_KIND), s.createDataFrame(NEW_COLUMNS, COLUMN_KIND), s.createDataFrame(OLD_KEYS, KEY_KIND), s.createDataFrame(NEW_KEYS, KEY_KIND))


NAMES = [("USER_NM", "userNm", "UserNm", True), ("order", "order", "Order", True), ("a__b", "a_b", "A_b", True), ("class", "class_", "Class", True), ("1st_col", "_1stCol", "T_1stCol", False), ("사용자_명", "사용자_명", "사용자_명", True), ("x-y z", "x_y_z", "X_y_z", False), ("TB_TN_USER", "tbTnUser", "User", True), ("TB_", "tb_", "T", True)]
TYPES = [("VARCHAR2(20)", 20, None, "String", "VARCHAR(20)"), ("NUMBER", 9, 0, "Integer", "INTEGER"), ("number(12)", 12, None, "Long", "BIGINT"), ("NUMBER", 9, 2, "java.math.BigDecimal", "NUMERIC(9,2)"), ("timestamp(6) with time zone", None, None, "java.time.LocalDateTime", "TIMESTAMP"), ("DATE", None, None, "java.time.LocalDate", "DATE"), ("LONG RAW", None, None, "String", "VARCHAR()"), ("geometry", None, None, None, None)]
PATHS = [("C:\\Work\\a\\..\\B\\", "/c:/work/b"), ("/x//./y/", "/x/y"), ("/../z", "/z"), ("/", "/"), (" /A/b ", "/a/b")]
CSV = [("T", "A", "예", "N", " VARCHAR ", "10"), ("T", "B", "", "y", "DATE", None), (None, "C", "0", "?", None, "x")]
CSV_INPUTS = [("own", "T", "A", "VARCHAR", "10", "", "Y", "Y", ""), ("own", "T", "B", "DATE", "", "", "N", "N", ""), ("own", "", "C", "", "x", "", "N", "", "")]


def name_table(s):
    c = F.col("name")
    out = s.createDataFrame([(n,) for n, *_ in NAMES], "name string")
    return out.select("name", names.field_name(c).alias("field"), names.class_name(c, ["TB", "TN"]).alias("class"), names.is_identifier(c).alias("sound"))


def type_table(s):
    n, p, q = F.col("native"), F.col("p"), F.col("q")
    java = names.java_type(n, p, q, "postgresql")
    return s.createDataFrame([t[:3] for t in TYPES], "native string, p int, q int").select("native", java.alias("java"), names.target_type(java, p, p, q, "postgresql").alias("target"))


def shown(s, d):
    return names.display(table(s, d, "orders").select("o_orderkey", "o_orderdate", F.encode("o_orderstatus", "UTF-8").alias("raw"), F.to_date("o_orderdate").alias("day")))


def update_texts(s, d):
    found = s.createDataFrame([("S", "USERS", "EMAIL", "email", 2), ("S", "USERS", "NAME", "name", 1), ("S", "CARDS", "CARD_NO", "card", 1)], "owner string, table_name string, name string, kind string, ordinal int")
    return masking.update_texts(found, "postgresql")


UPDATES = [
    ("CARDS", "UPDATE S.CARDS SET CARD_NO = CASE WHEN CHAR_LENGTH(CARD_NO) <= 10 THEN REPEAT('*', CHAR_LENGTH(CARD_NO)) ELSE LEFT(CARD_NO, 6) || REPEAT('*', CHAR_LENGTH(CARD_NO) - 10) || RIGHT(CARD_NO, 4) END WHERE CARD_NO IS NOT NULL;"),
    ("USERS", "UPDATE S.USERS SET NAME = CASE WHEN CHAR_LENGTH(NAME) <= 1 THEN REPEAT('*', CHAR_LENGTH(NAME)) ELSE LEFT(NAME, 1) || REPEAT('*', CHAR_LENGTH(NAME) - 1) END, "
     "EMAIL = CASE WHEN STRPOS(EMAIL, '@') > 1 THEN CASE WHEN CHAR_LENGTH(LEFT(EMAIL, STRPOS(EMAIL, '@') - 1)) <= 2 THEN REPEAT('*', CHAR_LENGTH(LEFT(EMAIL, STRPOS(EMAIL, '@') - 1))) ELSE LEFT(LEFT(EMAIL, STRPOS(EMAIL, '@') - 1), 2) || REPEAT('*', CHAR_LENGTH(LEFT(EMAIL, STRPOS(EMAIL, '@') - 1)) - 2) END || SUBSTR(EMAIL, STRPOS(EMAIL, '@')) "
     "ELSE CASE WHEN CHAR_LENGTH(EMAIL) <= 2 THEN REPEAT('*', CHAR_LENGTH(EMAIL)) ELSE LEFT(EMAIL, 2) || REPEAT('*', CHAR_LENGTH(EMAIL) - 2) END END WHERE NAME IS NOT NULL OR EMAIL IS NOT NULL;"),
]


def snapshot(s, d):
    return metadata.columns_of(s, d, TABLES)


def dictionary(s, d):
    """The tables' columns as a dictionary view gives them."""
    c = snapshot(s, d)
    return c.select(F.lit("OWN").alias("owner"), "table_name", F.col("name").alias("column"), F.col("ordinal").alias("column_id"), F.when(F.col("native_type") == "STRING", "VARCHAR2").when(F.col("native_type") == "BIGINT", "NUMBER(19)").otherwise("XMLTYPE").alias("data_type"), F.lit(4000).alias("data_length"), F.lit(19).alias("data_precision"), F.lit(1000).alias("char_length"), F.lit("Y").alias("nullable"))


QUERIES = {
    "menu_info": (lambda s, d: reports.menu_info(menus(s, d)), "SELECT count(*) AS menus, count(*) FILTER (WHERE c_acctbal >= 0) AS with_url, DATE '2024-01-01' + max(c_nationkey) AS loaded_at FROM customer"),
    "warning_counts": (lambda s, d: reports.warning_counts(warnings(s, d)), f"SELECT kind, coalesce(sqlstate, '') AS sqlstate, CAST(coalesce(code, 0) AS INTEGER) AS code, count(*) AS cnt FROM ({WARNINGS}) GROUP BY ALL"),
    "excluded_views": (
        lambda s, d: reports.excluded_views(screen_programs(s, d)),
        "SELECT CAST(CASE kind WHEN 'json' THEN 1 WHEN 'redirect' THEN 2 ELSE 4 END AS INTEGER) AS place, kind, count(*) AS cnt FROM (SELECT CASE p_size % 6 WHEN 4 THEN 'json' WHEN 1 THEN 'redirect' WHEN 2 THEN 'class' END AS kind FROM part) WHERE kind IS NOT NULL GROUP BY kind",
    ),
    "probe_totals": (lambda s, d: reports.probe_totals(outcomes(s, d)), f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'ERROR') AS failed, count(*) FILTER (WHERE starts_with(status, 'SKIP')) AS skipped FROM ({OUTCOMES})"),
    "probe_skips": (lambda s, d: reports.probe_skips(outcomes(s, d)), f"SELECT CAST(CASE status WHEN 'SKIP_DYNAMIC' THEN 3 WHEN 'SKIP_DOLLAR' THEN 4 ELSE 6 END AS INTEGER) AS place, status, count(*) AS cnt FROM ({OUTCOMES}) WHERE starts_with(status, 'SKIP') GROUP BY status"),
    "run_sizes": (lambda s, d: reports.with_sizes(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey"), "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS size FROM customer"),
    "finding_order": (
        lambda s, d: ordered_findings(s, d).limit(100).select("p_partkey"),
        "SELECT p_partkey FROM part ORDER BY list_position(['TIN', 'STEEL', 'NICKEL', 'BRASS', 'COPPER'], string_split(p_type, ' ')[-1]), p_brand, p_name, CASE WHEN p_size > 9 THEN CAST(p_size AS VARCHAR) ELSE '' END, p_partkey LIMIT 100",
    ),
    "screen_order": (
        lambda s, d: reports.screen_order(table(s, d, "customer").select(F.col("c_mktsegment").alias("module"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("url"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey") % 2).alias("file"), F.col("c_custkey").alias("line"))).limit(100),
        "SELECT c_mktsegment AS module, CASE WHEN c_nationkey > 3 THEN c_nationkey END AS url, CASE WHEN c_acctbal > 0 THEN c_nationkey % 2 END AS file, c_custkey AS line FROM customer ORDER BY module, url NULLS FIRST, file NULLS FIRST, line LIMIT 100",
    ),
    "recent_list": (lambda s, d: reports.recent(table(s, d, "events").select("user_id", "ts"), "user_id", "ts"), "SELECT user_id, max(ts) AS ts FROM events GROUP BY 1 ORDER BY ts DESC, user_id LIMIT 20"),
    "sound_statements": (
        lambda s, d: reports.sound_statements(table(s, d, "pages").select(F.translate(F.regexp_replace("url", "^[a-z]+://", ""), "/", ".").alias("ns_id"))).groupBy("ns_id").agg(F.count("*").alias("cnt")),
        f"WITH n AS (SELECT translate(regexp_replace(url, '^[a-z]+://', ''), '/', '.') AS ns_id FROM pages) SELECT ns_id, count(*) AS cnt FROM n WHERE regexp_matches(ns_id, '{reports.STATEMENT_ID}') GROUP BY 1",
    ),
    "parent_values": (lambda s, d: reports.parent_values(table(s, d, "part"), ["p_brand", "p_type"], 200), "SELECT DISTINCT p_brand, p_type FROM part ORDER BY 1, 2 LIMIT 200"),
    "code_rows": (lambda s, d: reports.code_rows(table(s, d, "nation"), ["n_regionkey", "n_nationkey", "n_name"], "n_regionkey", "n_nationkey"), "SELECT n_regionkey, n_nationkey, n_name FROM nation ORDER BY 1, 2 LIMIT 20000"),
    "word_rows": (lambda s, d: standards.word_rows(used_tokens(s, d), words(s, d)), WORD_ROWS),
    "domain_rows": (domains, DOMAIN_ROWS),
    "word_use": (
        lambda s, d: standards.word_use(table(s, d, "nation").select(F.upper(F.substring("n_name", 1, 3)).alias("abbr"), "n_name"), table(s, d, "region").select(F.concat(F.lit(" "), F.lower(F.substring("r_name", 1, 3))).alias("abbr"))),
        "SELECT upper(left(n_name, 3)) AS abbr, n_name, CASE WHEN upper(left(n_name, 3)) IN (SELECT upper(left(r_name, 3)) FROM region) THEN 'Y' ELSE 'N' END AS used FROM nation",
    ),
    "coverage": (coverage, COVERAGE),
    "grade_counts": (
        lambda s, d: standards.grade_counts(table(s, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("doc"), F.when(F.col("l_returnflag") == "A", "auto").when(F.col("l_returnflag") == "N", "guess").otherwise("manual").alias("level"))),
        "SELECT CAST(l_shipdate AS DATE) AS doc, count(*) FILTER (WHERE l_returnflag = 'A') AS auto, count(*) FILTER (WHERE l_returnflag = 'N') AS guess, count(*) FILTER (WHERE l_returnflag = 'R') AS manual FROM lineitem GROUP BY 1",
    ),
    "mapper_relations": (
        mapper_relations,
        """WITH n AS (SELECT l_linenumber AS k, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1), two AS (SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem WHERE l_linenumber IN (3, 4) GROUP BY 1))
        SELECT 'strong' AS strength, 'ITEMS' AS child, 'ORDERS' AS parent, 'ID' AS columns, n AS statements FROM n WHERE k = 1 UNION ALL SELECT 'strong', 'ITEMS', 'PARTS', 'ID', n FROM n WHERE k = 2
        UNION ALL SELECT 'strong', 'ITEMS', 'STOCK', 'SEQ,NO', n FROM two UNION ALL SELECT 'weak', 'ORDERS', 'V_ALL', 'ID=ID', n FROM n WHERE k = 5""",
    ),
    "alter_plan": (alter_plan, values(PLAN, "section, table_name, name, text, tag")),
    "field_names": (lambda s, d: name_table(s), values(NAMES, "name, field, class, sound")),
    "type_map": (lambda s, d: type_table(s), values([(n, j, t) for n, _, _, j, t in TYPES], "native, java, target")),
    "quoted_names": (
        lambda s, d: snapshot(s, d).withColumn("name", F.element_at(F.split("name", "_"), -1)).select("name", *(names.quoted(F.col("name"), x).alias(x) for x in ("oracle", "postgresql", "mariadb", "mssql"))).distinct(),
        "SELECT DISTINCT name, " + ", ".join(f"CASE WHEN upper(name) IN ({', '.join(repr(w) for w in sorted(names.RESERVED))}) THEN {q} ELSE name END AS {x}" for x, q in (("oracle", "'\"' || upper(name) || '\"'"), ("postgresql", "'\"' || lower(name) || '\"'"), ("mariadb", "'`' || name || '`'"), ("mssql", "'[' || name || ']'")))
        + f" FROM (SELECT string_split(column_name, '_')[-1] AS name FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in TABLES)}))",
    ),
    "path_normalise": (lambda s, d: s.createDataFrame([(p,) for p, _ in PATHS], "path string").select("path", names.path_normalise(F.col("path")).alias("plain")), values(PATHS, "path, plain")),
    "comment_fallback": (
        lambda s, d: table(s, d, "documents").select("doc_id", names.filled(F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, "  "), F.when(F.length("source") > 4, F.col("source")), "(none)").alias("title")),
        "SELECT doc_id, coalesce(nullif(trim(CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN '  ' END), ''), CASE WHEN length(source) > 4 THEN source END, '(none)') AS title FROM documents",
    ),
    "display_values": (
        shown,
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M') || CASE WHEN second(o_orderdate) = 0 AND microsecond(o_orderdate) % 1000000 = 0 THEN '' ELSE strftime(o_orderdate, ':%S') END AS o_orderdate, '(BLOB ' || strlen(o_orderstatus) || ' bytes)' AS raw, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders",
    ),
    "optional_equal": (
        lambda s, d: table(s, d, "orders").where(names.optional_equal(F.col("o_orderstatus"), "O") & names.optional_equal(F.col("o_orderpriority"), None)).groupBy("o_orderpriority").agg(F.count("*").alias("cnt")),
        "SELECT o_orderpriority, count(*) AS cnt FROM orders WHERE ('O' IS NULL OR o_orderstatus = 'O') AND (NULL IS NULL OR o_orderpriority = NULL) GROUP BY 1",
    ),
    "mask_updates": (update_texts, values(UPDATES, "table_name, sql")),
    "column_inputs": (
        lambda s, d: inputs.column_inputs(s.createDataFrame(CSV, "`테이블명` string, COLUMN_NAME string, PK string, NULLABLE string, `데이터타입` string, LENGTH string"), "own"),
        values([(*r[:8], r[8]) for r in CSV_INPUTS], "owner, table_name, name, native_type, length, scale, pk, not_null, ordinal"),
    ),
    "in_scope": (
        lambda s, d: inputs.in_scope(metadata.row_counts(s, d, TABLES).select(F.lit("main").alias("schema_name"), "table_name", "row_count"), SCOPE).select("table_name"),
        f"SELECT table_name FROM ({values([(t,) for t in TABLES], 'table_name')}) WHERE NOT starts_with(table_name, 'line') AND NOT suffix(table_name, 'ion') AND NOT regexp_matches(table_name, '^p.*s$') AND table_name <> 'labels'",
    ),
    "dictionary_columns": (
        lambda s, d: catalog.dictionary_columns(dictionary(s, d), "OWN").groupBy("native_type", "jdbc_type", "length").agg(F.count("*").alias("cnt")),
        "SELECT CASE data_type WHEN 'VARCHAR' THEN 'VARCHAR2' WHEN 'BIGINT' THEN 'NUMBER(19)' ELSE 'XMLTYPE' END AS native_type, CAST(CASE data_type WHEN 'VARCHAR' THEN 12 WHEN 'BIGINT' THEN 2 ELSE 1111 END AS INTEGER) AS jdbc_type, "
        f"CAST(CASE data_type WHEN 'VARCHAR' THEN 1000 ELSE 19 END AS INTEGER) AS length, count(*) AS cnt FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in TABLES)}) GROUP BY ALL",
    ),
}
