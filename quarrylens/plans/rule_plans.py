"""The rule catalogue by group, run over all documents, pages and conversations, with all path patterns opened."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quarrylens.operators import rule_catalog, scan, sqltext
from quarrylens.plans.metadata_plans import values
from quarrylens.session import table


#: Code that the rules are about; the data's texts are prose and pages.
SNIPPETS = [
    ("code/a.html", 'debugger;\nconsole.log(1); alert (2)\nxalert(3)\n<html>\n<img src="a"><img alt="x" src="b">\n<input name="q"><input type="hidden" name="h">\n<iframe src="x"></iframe>\n<td onclick="go()">x</td><td onclick="go()" onkeydown="go()">y</td>\n<center>c</center> document.all\n<th>h</th>\n<select name="s"><textarea id="t">'),
    ("code/b.jsp", '<%= request.getParameter("a") %>\n<c:out value="x" escapeXml="false"/>\n<a target="_blank" href="x">y</a> <a target=_blank rel="noopener">z</a>\n${param.name}\n<% int i = 0; %>\nnew FileReader(request.getParameter("f"))\nresponse.sendRedirect(request.getHeader("to"))'),
    ("code/c.java", 'System . out.println(1); e.printStackTrace();\n// TODO later\nString url = "http://localhost/x"; String ip = "10.1.2.3";\nString password = "secret1";\nString q = "select * from t where a = " + a;\nMessageDigest.getInstance("MD5"); Cipher.getInstance("DES/CBC"); new Random();\nRuntime.getRuntime().exec(c); new ObjectInputStream(in); out.println(e.getMessage());\nnew URL(request.getParameter("u")); response.addHeader("a", request.getHeader("b"));\nlog.info("x {}", password); new SecretKeySpec("abc", "AES"); MultipartFile f; parseExpression(x)'),
    ("code/d.tsx", 'debugger\nconsole.warn(1)\nconst a: any = b as any\n// eslint-disable-next-line\n<li key={index}>\n<img src={a}/>\n<a onClick={f}>x</a>\n<div onClick={f}>x</div>\nel.innerHTML = x; eval(y); setTimeout("z()", 1)\ndangerouslySetInnerHTML={h} VITE_API_SECRET localStorage.setItem("jwt", t)\n<a href="javascript:void(0)">'),
    ("code/e.xml", '<mapper namespace="m">\nselect * from t where a = ${a}\nselect t.* from t\n</mapper>\n<root level="debug">'),
    ("code/f.xml", 'select * from t where a = ${a}\n<web-app>\n<session-timeout>30</session-timeout>'),
    ("code/g.properties", 'log4j.rootLogger=DEBUG, a\nserver.error.include-stacktrace=always\ndb.password=abcdef\nuser 900101-1234567 card 4111-1111-1111-1111 tel 010-1234-5678'),
    ("code/h", None), ("code/i", ""),
]


def corpus(s, d):
    """Every text of the data and of SNIPPETS, with a path that says where it is from."""
    docs = table(s, d, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), "text")
    pages = table(s, d, "pages").select(F.concat(F.lit("page/"), "page_id").alias("path"), F.col("html").alias("text"))
    talks = table(s, d, "conversations").select(F.concat(F.lit("talk/"), "conv_id", F.lit("/"), "turn").alias("path"), "text")
    return docs.union(pages).union(talks).union(s.createDataFrame(SNIPPETS, "path string, text string"))


CORPUS = "SELECT 'doc/' || doc_id AS path, text FROM documents UNION ALL SELECT 'page/' || page_id, html FROM pages UNION ALL SELECT 'talk/' || conv_id || '/' || turn, text FROM conversations UNION ALL " + values(SNIPPETS, "path, text")
LINES = f"SELECT path, text, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM ({CORPUS})"


def opened(group: str) -> tuple[scan.Rule, ...]:
    return tuple(replace(r, globs=("*",)) for r in rule_catalog.GROUPS[group])


def text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def rule_sql(r: scan.Rule) -> str:
    hit = f"regexp_matches(content, {text(r.pattern)})"
    if r.without:
        hit = f"len(list_filter(regexp_extract_all(content, {text(r.pattern)}), lambda m: NOT regexp_matches(m, {text(r.without)}))) > 0"
    gate = f" AND regexp_matches(text, {text(r.when)})" if r.when else ""
    return f"SELECT path, CAST(line AS INTEGER) AS line, '{r.id}' AS rule, '{r.severity}' AS severity FROM l WHERE {hit}{gate}"


def group_query(group: str):
    rules = opened(group)
    sql = f"WITH l AS MATERIALIZED ({LINES}) " + " UNION ALL ".join(map(rule_sql, rules))
    return (lambda s, d: scan.line_rules(corpus(s, d), rules).select("path", "line", "rule", "severity")), sql


def absent_rules(s, d):
    found = [scan.absent_rule(corpus(s, d), rule, when, required) for rule, _, when, required in rule_catalog.ABSENT]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def absent_sql(rule: str, when: str, required: str) -> str:
    first = f"list_position(list_transform(string_split(text, chr(10)), lambda x: regexp_matches(x, {text(when)})), true)"
    return f"SELECT path, CAST({first} AS INTEGER) AS line, '{rule}' AS rule FROM ({CORPUS}) WHERE regexp_matches(text, {text(when)}) AND NOT regexp_matches(text, {text(required)})"


#: Statements of a mapper, made of the parts' names.
STATEMENTS = (
    (0, "select * from t_{k} where a = null"), (1, "select a.x from t_{k} a, u b where a.id = b.id limit 10"), (2, "insert into t_{k} values (1)"), (3, "select x from t_{k} where y not in (select z from u)"),
    (4, "select a.x from t_{k} a, u b where a.v = 1"), (5, "select x from t_{k} order by x limit 10"),
)
BROKEN = (("nullCompare", 0), ("pagingOrder", 1), ("insertColumns", 2), ("notInQuery", 3), ("crossJoin", 4))


def statement_lint(s, d):
    """The statement rules over one statement for each part: which of six it is depends on the part's size."""
    k = F.col("p_size") % len(STATEMENTS)
    sql = F.lit(None).cast("string")
    for n, form in STATEMENTS:
        sql = F.when(k == n, F.replace(F.lit(form), F.lit("{k}"), F.col("p_partkey").cast("string"))).otherwise(sql)
    return sqltext.lint_sql(table(s, d, "part").select("p_partkey", sql.alias("sql")), "sql", "p_partkey")


TAG_TEXTS = [("a", '<a href="x"\n target="_blank">y</a>\n<a target=_blank\nrel=noopener>z</a> <a target="_blank">w</a>\n<input\n name="q"\n/><input id="x">\n<input name="r" />'), ("b", None), ("c", ""), ("d", "<a>")]
IMPORTS = [("a", 'import React, { useState, useRef as ref } from "react"\nimport * as all from "all"\nimport type T from "t"\nimport "side"\nconst [x] = useState<T>(React)'), ("b", None), ("c", 'import $q from "q"\n$q.a()\nimport z from "z"')]


def tag_rules(s, d):
    """Over the pages, and over texts with tags that go over line ends."""
    texts = corpus(s, d).union(s.createDataFrame(TAG_TEXTS, "path string, text string"))
    found = [scan.tag_rule(texts, rule, pattern, without) for rule, _, pattern, without in rule_catalog.TAGS]
    return found[0].union(found[1]).where("path not like 'code/%'")


QUERIES = {f"rules_{g}": group_query(g) for g in rule_catalog.GROUPS} | {
    "rules_absent": (absent_rules, " UNION ALL ".join(absent_sql(rule, when, required) for rule, _, when, required in rule_catalog.ABSENT)),
    "rules_tags": (tag_rules, values([("a", 1, "jsp.blankNoopener"), ("a", 4, "jsp.blankNoopener"), ("a", 5, "a11y.jsxInputLabel"), ("a", 8, "a11y.jsxInputLabel")], "path, line, rule")),
    "unused_imports": (lambda s, d: scan.unused_imports(s.createDataFrame(IMPORTS, "path string, text string")), values([("a", 1, "tsx.unusedImport", "ref"), ("a", 2, "tsx.unusedImport", "all"), ("c", 3, "tsx.unusedImport", "z")], "path, line, rule, name")),
    "statement_lint": (statement_lint, " UNION ALL ".join(f"SELECT p_partkey, '{rule}' AS rule FROM part WHERE p_size % {len(STATEMENTS)} = {n}" for rule, n in BROKEN)),
}
