"""Text scans over documents, pages and conversations, duplicate blocks, line diffs and SQL texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions.text import digest12, line_count
from quarrylens.operators import comments, duplicates, scan, sqltext, textdiff
from quarrylens.plans.metadata_plans import values
from quarrylens.session import table
from quarrylens.sources import page_links


def corpus(s, d):
    return table(s, d, "documents").select(F.format_string("%08d", "doc_id").alias("path"), "text")


def pages(s, d):
    return table(s, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))


CORPUS = "SELECT printf('%08d', doc_id) AS path, text FROM documents"
MARKED = [
    ("a", "x = 1 // tb-ignore\nTODO: y\nsecret: k -- tb-ignore secret\n# tb-ignore-next todo\nTODO z tail"), ("b", "todo here // tb-ignore *\ntodo there"), ("c", None), ("d", ""),
    ("e", "foo(); todo();// tb-ignore todo 이유 글\n<%-- tb-ignore-next --%>\ntodo\n * tb-ignore secret todo\ntodo // see tb-ignore\ntodo // tb-ignore-file\ntodo # tb-ignore-next\n"),
    ("f", "todo /* tb-ignore secret */ // tb-ignore todo,tab"),
]
SQLS = [
    (1, "SELECT a.x FROM t1 a JOIN s.t2 b ON a.id = b.t1_id WHERE a.d = NULL LIMIT 5"),
    (2, "WITH c AS (SELECT * FROM t3) INSERT INTO t4 SELECT * FROM c, t5 x WHERE x.k = c.k"),
    (3, "DELETE t6 FROM t6 JOIN t7 ON t6.a = t7.b"),
    (4, "MERGE INTO t8 m USING t9 n ON (m.id = n.id) WHEN MATCHED THEN UPDATE SET m.v = n.v"),
    (5, "SELECT EXTRACT(DAY FROM d) FROM dual, t10 WHERE x NOT IN (SELECT y FROM t11) AND p IS DISTINCT FROM q"),
    (6, "UPDATE t12 SET a = '1' WHERE b = (SELECT max(b) FROM t13)"),
    (7, None),
    (8, "UPDATE t SET a = 1, b = NULL WHERE c IN (SELECT d FROM u WHERE e <> NULL)"),
    (9, "SELECT * FROM a, b WHERE a.x = 1 FETCH FIRST 1 ROWS ONLY"),
    (10, "SELECT * FROM a CROSS JOIN b x JOIN c ORDER BY 1 LIMIT 5"),
    (11, "SELECT * FROM a, b WHERE UPPER(a.n) = UPPER(b.n) AND ROWNUM <= 10"),
    (12, "SELECT * FROM a, b WHERE a.n = z"),
    (13, "INSERT IGNORE INTO x.y VALUES (1, NULL)"),
    (14, "select * from t for share"),
    (15, "ｓｅｌｅｃｔ 1"),
    (16, "/* a */ -- b\n with c as (select 1) select * from c ; ;"),
    (17, "select 'drop' from t"),
    (18, "select 1 /* open"),
    (19, "select /*M! 1 */ 1"),
    (20, "select 1; select 2"),
    (21, "select * from t with (updlock)"),
    (22, "select 1INTO x"),
    (23, "  ;"),
    (24, "selection"),
]
LINES = f"SELECT path, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM ({CORPUS})"
BLOCKS = f"""WITH l AS (SELECT path, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM ({CORPUS})),
        w AS (SELECT path, CAST(i AS INTEGER) AS pos, array_to_string(l[i + 1:i + 3], chr(10)) AS b FROM l, range(0, 100000) t(i) WHERE i <= len(l) - 3),
        f AS (SELECT b, min({{'p': path, 'a': pos}}) AS f FROM w GROUP BY 1 HAVING count(*) > 1),
        h AS (SELECT path, pos, f.p AS of_path, f.a AS of_at FROM w JOIN f USING (b) WHERE path <> f.p),
        k AS (SELECT *, of_at - pos AS line, pos - row_number() OVER (PARTITION BY path, of_path, of_at - pos ORDER BY pos) AS island FROM h)
        SELECT path, min(pos) AS first_at, count(*) + 2 AS lines, of_path, min(of_at) AS of_at FROM k GROUP BY path, of_path, line, island"""
RULE_SQL = [(r.id, r.group, r.severity, r.pattern.replace("'", "''")) for r in scan.RULES]
EXCERPT = "left(trim(content, ' '), 160)"


def views(s, d):
    """Each page's address in JSP texts: a link below the application's path, a form, a script by an unknown base, one in a comment."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]*", ""), r"(\.html|/)$", "")
    text = F.concat(F.lit('<a href="${pageContext.request.contextPath}'), path, F.lit(".do?x=1\">\n<%-- <a href='/hidden.do'> --%> <form action='"), path, F.lit("/save.do'>\n"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("location.href = '${base}"), path, F.lit(".do';"))).otherwise("var u = 'none.do.x';"))
    return table(s, d, "pages").select("page_id", text.alias("text"))


VIEW_PATHS = r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '(\.html|/)$', '') AS path FROM pages"


def sqls(s, rows=SQLS):
    return s.createDataFrame(rows, "id int, sql string")


def diff_input(s, d):
    """Each document against itself with every line that holds a digit changed and its last line of several dropped."""
    lines = F.split("text", "\n")
    changed = F.transform(lines, lambda x: F.when(x.rlike("[0-9]"), F.concat(x, F.lit(" ‹changed›"))).otherwise(x))
    new = F.array_join(F.slice(changed, 1, F.greatest(F.size(changed) - 1, F.lit(1))), "\n")
    return table(s, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("old"), new.alias("new"))


def diff_counts(s, d):
    found = textdiff.diff_pairs(diff_input(s, d), "doc_id", "old", "new")
    return found.groupBy("doc_id").agg(F.count_if(F.col("op") == "-").alias("removed"), F.count_if(F.col("op") == "+").alias("added"), F.count_if(F.col("op") == "?").alias("too_long"))


def diff_edits(s, d):
    """Each document with its lines numbered, against itself with every third line gone and a new one before every fifth."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("i"), F.concat((i + 1).cast("string"), F.lit(":"), x).alias("t")))
    old = F.transform(numbered, lambda x: x["t"])
    fresh = lambda x: F.when(x["i"] % 5 == 0, F.array(F.concat(F.lit("new "), x["i"].cast("string")))).otherwise(F.array().cast("array<string>"))
    kept = lambda x: F.when(x["i"] % 3 != 0, F.array(x["t"])).otherwise(F.array().cast("array<string>"))
    new = F.flatten(F.transform(numbered, lambda x: F.concat(fresh(x), kept(x))))
    pairs = table(s, d, "documents").where("text is not null").select("doc_id", F.array_join(old, "\n").alias("old"), F.array_join(new, "\n").alias("new"))
    return textdiff.diff_pairs(pairs, "doc_id", "old", "new").select("doc_id", "op", "old_line", "new_line")


QUERIES = {
    "line_rule_scan": (
        lambda s, d: scan.line_rules(corpus(s, d)),
        " UNION ALL ".join(f"SELECT path, CAST(line AS INTEGER) AS line, '{i}' AS rule, '{g}' AS grp, '{v}' AS severity, {EXCERPT} AS excerpt FROM ({LINES}) WHERE regexp_matches(content, '{p}')" for i, g, v, p in RULE_SQL),
    ),
    "rule_counts": (
        lambda s, d: scan.line_rules(corpus(s, d)).groupBy("rule", "severity").agg(F.count("*").alias("cnt"), F.countDistinct("path").alias("files")),
        "SELECT rule, severity, count(*) AS cnt, count(DISTINCT path) AS files FROM (" + " UNION ALL ".join(f"SELECT path, '{i}' AS rule, '{v}' AS severity FROM ({LINES}) WHERE regexp_matches(content, '{p}')" for i, _, v, p in RULE_SQL) + ") GROUP BY ALL",
    ),
    "absent_rule": (
        lambda s, d: scan.absent_rule(pages(s, d), "relMissing", '<a href="', r"rel="),
        """SELECT CAST(page_id AS VARCHAR) AS path, CAST(len(string_split(split_part(html, '<a href="', 1), chr(10))) AS INTEGER) AS line, 'relMissing' AS rule FROM pages WHERE contains(html, '<a href="') AND NOT contains(html, 'rel=')""",
    ),
    "count_rule": (
        lambda s, d: scan.count_rule(pages(s, d), "manyLinks", '<a href="', 5),
        """SELECT CAST(page_id AS VARCHAR) AS path, CAST(len(string_split(split_part(html, '<a href="', 1), chr(10))) AS INTEGER) AS line, 'manyLinks' AS rule, CAST(len(regexp_extract_all(html, '<a href="')) AS BIGINT) AS hits FROM pages WHERE len(regexp_extract_all(html, '<a href="')) > 5""",
    ),
    "luhn_cards": (
        lambda s, d: scan.card_numbers(corpus(s, d)),
        f"""WITH n AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '\\b([3-6][0-9]{{15}})\\b', 1)) AS number FROM ({CORPUS})),
        g AS (SELECT path, number, i, CAST(substr(number, i, 1) AS INTEGER) AS x FROM n, range(1, 17) t(i))
        SELECT path, number FROM g GROUP BY ALL HAVING sum(CASE WHEN i % 2 = 0 THEN x WHEN x * 2 > 9 THEN x * 2 - 9 ELSE x * 2 END) % 10 = 0""",
    ),
    "card_findings": (
        lambda s, d: scan.card_findings(corpus(s, d)),
        f"""WITH n AS (SELECT DISTINCT path, CAST(line AS INTEGER) AS line, content, unnest(regexp_extract_all(content, '\\b([3-6][0-9]{{15}})\\b', 1)) AS number FROM ({LINES})),
        g AS (SELECT *, CAST(substr(number, i, 1) AS INTEGER) AS x FROM n, range(1, 17) t(i))
        SELECT path, line, number, left(trim(replace(content, number, repeat('*', 12) || right(number, 4)), ' '), 160) AS excerpt FROM g GROUP BY ALL HAVING sum(CASE WHEN i % 2 = 0 THEN x WHEN x * 2 > 9 THEN x * 2 - 9 ELSE x * 2 END) % 10 = 0""".replace("SELECT *, CAST(substr", "SELECT path, line, content, number, i, CAST(substr").replace("FROM g GROUP BY ALL HAVING", "FROM g GROUP BY path, line, content, number HAVING"),
    ),
    "view_links": (
        lambda s, d: page_links.view_links(views(s, d), "page_id", "text")[0],
        f"SELECT page_id, path || '.do' AS url, 'link' AS kind FROM ({VIEW_PATHS}) UNION ALL SELECT page_id, path || '/save.do', 'form' FROM ({VIEW_PATHS})",
    ),
    "view_links_unknown": (
        lambda s, d: page_links.view_links(views(s, d), "page_id", "text")[1],
        f"SELECT page_id, 3 AS line, '${{}}' || path || '.do' AS shape FROM ({VIEW_PATHS}) WHERE page_id % 3 = 0",
    ),
    "html_comments": (
        lambda s, d: comments.without_comments(table(s, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"), F.lit("html").alias("lang"))).select("path", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("n")),
        r"""WITH c AS (SELECT CAST(page_id AS VARCHAR) AS path, html, list_distinct(regexp_extract_all(html, '(?s)<!--.*?(?:-->|\z)')) AS found FROM pages)
        SELECT path, sha256(t) AS digest, length(t) AS n FROM (SELECT path, list_reduce(found, lambda t, x: replace(t, x, regexp_replace(x, '[^\n]', ' ', 'g')), html) AS t FROM c)""",
    ),
    "suppressed": (
        lambda s, d: scan.suppressed(scan.line_rules(s.createDataFrame(MARKED, "path string, text string")), s.createDataFrame(MARKED, "path string, text string")).select("path", "line", "rule", "suppressed"),
        "SELECT path, CAST(line AS INTEGER) AS line, rule, supp = 1 AS suppressed FROM (" + values([("a", 2, "todo", 0), ("a", 3, "secret", 1), ("a", 4, "todo", 0), ("a", 5, "todo", 1), ("b", 1, "todo", 1), ("b", 2, "todo", 0), ("e", 1, "todo", 1), ("e", 3, "todo", 1), ("e", 4, "todo", 0), ("e", 5, "todo", 0), ("e", 6, "todo", 0), ("e", 7, "todo", 0), ("f", 1, "todo", 1)], "path, line, rule, supp") + ")",
    ),
    "unused_markers": (
        lambda s, d: scan.unused_markers(scan.line_rules(s.createDataFrame(MARKED, "path string, text string")), s.createDataFrame(MARKED, "path string, text string")),
        values([("a", 1, scan.UNUSED), ("e", 4, scan.UNUSED), ("e", 7, scan.UNUSED), ("f", 1, scan.UNUSED)], "path, line, rule"),
    ),
    "duplicate_blocks": (lambda s, d: duplicates.duplicate_blocks(corpus(s, d), 3), BLOCKS),
    "block_hashes": (
        lambda s, d: corpus(s, d).where("text is not null").select("path", duplicates.fnv1a(F.transform(duplicates.normal_lines(F.col("text")), duplicates.java_hash)).alias("h")),
        f"""WITH l AS (SELECT path, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM ({CORPUS}) WHERE text IS NOT NULL),
        j AS (SELECT path, list_transform(l, lambda x: list_reduce(list_transform(string_split(x, ''), lambda c: CAST(unicode(c) AS HUGEINT)), lambda a, b: (a * 31 + b) % 4294967296, CAST(0 AS HUGEINT))) AS hs FROM l),
        f AS (SELECT path, list_reduce(list_transform(hs, lambda h: CASE WHEN h >= 2147483648 THEN h - 4294967296 + 18446744073709551616 ELSE h END), lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616, CAST(14695981039346656037 AS HUGEINT)) AS x FROM j)
        SELECT path, CAST(CASE WHEN x >= 9223372036854775808 THEN x - 18446744073709551616 ELSE x END AS BIGINT) AS h FROM f""",
    ),
    "long_blocks": (lambda s, d: duplicates.duplicate_blocks(corpus(s, d), 30), BLOCKS.replace("i + 3]", "i + 30]").replace("len(l) - 3", "len(l) - 30").replace("count(*) + 2", "count(*) + 29")),
    "changed_blocks": (
        lambda s, d: duplicates.reportable(duplicates.duplicate_blocks(corpus(s, d), 3), table(s, d, "documents").where("source < 'src3'").select(F.format_string("%08d", "doc_id").alias("path"))),
        f"""WITH c AS (SELECT printf('%08d', doc_id) AS path FROM documents WHERE source < 'src3'), b AS ({BLOCKS})
        SELECT path, first_at, lines, of_path, of_at FROM b WHERE path IN (FROM c) UNION ALL SELECT of_path, of_at, lines, path, first_at FROM b WHERE path NOT IN (FROM c) AND of_path IN (FROM c)""",
    ),
    "line_counts": (
        lambda s, d: corpus(s, d).select("path", line_count(F.col("text")).alias("lines"), digest12(F.col("text")).alias("digest")),
        f"SELECT path, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END END AS INTEGER) AS lines, left(sha256(text), 12) AS digest FROM ({CORPUS})",
    ),
    "page_links": (
        lambda s, d: page_links.hrefs(table(s, d, "pages"), "page_id", "html"),
        """SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) GROUP BY ALL""",
    ),
    "line_diff": (
        diff_counts,
        """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
        c AS (SELECT doc_id, len(l) AS n, len(list_filter(l, lambda x: regexp_matches(x, '[0-9]'))) AS k, CASE WHEN len(l) > 1 THEN 1 ELSE 0 END AS cut, CASE WHEN len(l) > 1 AND regexp_matches(l[-1], '[0-9]') THEN 1 ELSE 0 END AS cut_and_changed FROM l)
        SELECT doc_id, k + cut - cut_and_changed AS removed, k - cut_and_changed AS added, 0 AS too_long FROM c WHERE k + cut > 0""",
    ),
    "line_diff_rows": (
        diff_edits,
        """WITH n AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, '-' AS op, CAST(i AS INTEGER) AS old_line, 0 AS new_line FROM n WHERE i % 3 = 0
        UNION ALL SELECT doc_id, '+', 0, CAST(i // 5 + (i - 1) - (i - 1) // 3 AS INTEGER) FROM n WHERE i % 5 = 0""",
    ),
    "sql_tables": (
        lambda s, d: sqltext.table_refs(sqls(s, SQLS[:7]), "sql", "id"),
        values([(1, "T1", "R"), (1, "T2", "R"), (2, "T3", "R"), (2, "T4", "C"), (2, "T5", "R"), (3, "T6", "RD"), (3, "T7", "R"), (4, "T8", "U"), (4, "T9", "R"), (5, "T10", "R"), (5, "T11", "R"), (6, "T12", "U"), (6, "T13", "R")], "id, table_name, crud"),
    ),
    "sql_joins": (lambda s, d: sqltext.join_equalities(sqls(s, SQLS[:7]), "sql", "id"), values([(1, "T1", "ID", "T2", "T1_ID"), (3, "T6", "A", "T7", "B"), (4, "T8", "ID", "T9", "ID")], "id, table_a, col_a, table_b, col_b").replace("(4,", "(4, 'T8', 'V', 'T9', 'V'), (4,")),
    "sql_lint": (lambda s, d: sqltext.lint_sql(sqls(s), "sql", "id"), values([(1, "nullCompare"), (1, "pagingOrder"), (2, "insertColumns"), (5, "crossJoin"), (5, "notInQuery"), (8, "nullCompare"), (9, "crossJoin"), (10, "crossJoin"), (11, "pagingOrder"), (13, "insertColumns")], "id, rule")),
    "sql_gate": (lambda s, d: sqltext.gate(sqls(s), "sql", "id"), "SELECT CAST(id AS INTEGER) AS id, id IN (1, 5, 9, 10, 11, 12, 16) AS read_only FROM range(1, 25) t(id)"),
}
