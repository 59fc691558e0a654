from pyspark.sql import functions as F

from quarrylens.functions import text
from quarrylens.operators import generate, lineage, textdiff
from quarrylens.sources import page_links, text_files


def test_decode_and_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿이름;값\r\n\"a;\"\"b\";1\r\n\r\n".encode())
    (tmp_path / "b.csv").write_bytes("이름,값\n홍,2\n".encode("cp949"))
    rows = {(r.path.rsplit("/", 1)[-1], r.row): r.cells for r in text_files.read_csvs(spark, str(tmp_path)).collect()}
    assert rows == {("a.csv", 0): ["이름", "값"], ("a.csv", 1): ['a;"b', "1"], ("b.csv", 0): ["이름", "값"], ("b.csv", 1): ["홍", "2"]}
    found = {r.path.rsplit("/", 1)[-1]: (r.encoding, r.eol) for r in text_files.read_texts(spark, str(tmp_path)).collect()}
    assert found == {"a.csv": ("utf-8-bom", "crlf"), "b.csv": ("ms949", "lf")}
    assert text_files.read_texts(spark, str(tmp_path), ["**/*.txt"]).count() == 0


def test_delimiter_and_header():
    assert text_files.delimiter_of("a,b;c;d\n") == ";"
    assert text_files.delimiter_of("plain") == ","
    assert text_files.column_at(["No", "Word name"], ["name"]) == 1
    assert text_files.column_at(["No"], ["x"]) == -1


def test_action_links(spark):
    df = spark.createDataFrame([(1, '<a href="/x/list.do?p=1">'), (2, "window.open('/pop.do')"), (3, None)], "id long, t string")
    assert sorted(map(tuple, page_links.action_links(df, "id", "t").collect())) == [(1, "/x/list.do", "link"), (2, "/pop.do", "popup")]


def test_line_diff_applies():
    for old, new in (("a\nb\nc", "a\nx\nc\nd"), ("", "a"), ("a", ""), ("a\na\nb", "a\nb\nb"), ("x", "x")):
        diff = textdiff.line_diff(old, new)
        assert [t for op, _, _, t in diff if op in " -"] == (old.split("\n") if old else [])  # an empty text has no lines
        assert [t for op, _, _, t in diff if op in " +"] == (new.split("\n") if new else [])


def test_masks(spark):
    df = spark.createDataFrame([("abcdef",), ("ab",), (None,), ("joe@x.org",), ("",)], "s string")
    rows = [tuple(r) for r in df.select(text.mask(F.col("s"), 2, 1), text.mask_email(F.col("s"), 1, 0)).collect()]
    assert rows == [("ab***f", "a*****"), ("**", "a*"), (None, None), ("jo******g", "j**@x.org"), ("", "")]


def test_scalars(spark):
    df = spark.createDataFrame([(" 12ab", " x　", "/a/b/c.do?q")], "n string, t string, u string")
    row = df.select(text.int_or_null(F.col("n")), text.js_trim(F.col("t")), text.url_module(F.col("u")), text.folder_at(F.col("u"), 3), text.line_count(F.lit("a\nb\n"))).first()
    assert tuple(row) == (12, "x", "/a/b", "/a/b", 2)


def test_sql_texts(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
    assert generate.ddl("t", schema, "postgresql", ["id"]) == 'CREATE TABLE "t" (\n  "id" bigint NOT NULL,\n  "v" text,\n  PRIMARY KEY ("id")\n);'
    assert generate.upsert("t", ["id"], ["id"], "postgresql").endswith("DO NOTHING")
    assert "WHEN MATCHED" not in generate.upsert("t", ["id"], ["id"], "oracle")
    assert generate.overlap_warning([2, 3], 7) and not generate.overlap_warning([2, 3], 6)


def test_reachable_has_no_duplicates(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (2, 3)], "a int, b int")
    got = sorted(map(tuple, lineage.reachable(edges, 5).collect()))
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]


def test_stream_counts(spark, tmp_path):
    from quarrylens.streaming.run_history import daily_counts

    spark.sql("select timestamp'2024-01-01 10:00:00' as ts, 'a' as event_type union all select timestamp'2024-01-05 00:00:00', 'b'").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "e"))
    q = daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("daily").start()
    try:
        q.processAllAvailable()
        assert spark.table("daily").count() == 2
    finally:
        q.stop()


def test_view_links(spark):
    texts = [
        (1, "<a href='/a/b.do'> location.href='/c.do?x' $.post('${ctx}/d.do', {url: '/e.do'}) <c:import url='${pageContext.request.contextPath}/f.do'/>"),
        (2, "<%-- href='/no.do' --%>\n<!-- /no.do -->\nx = 'relative.do' + '/done.done' + '/z.do_x' <iframe src=\"/g.do\"> window.open('/h.do') <c:url var='u' value='/i.do'/>"),
        (3, None), (4, ""), (5, "<a href='/a.do'><a href='/a.do'>\n<form action='/a.do'>\n'${x}${y}.do'"),
    ]
    links, unknown = page_links.view_links(spark.createDataFrame(texts, "id int, t string"), "id", "t")
    assert sorted(map(tuple, links.collect())) == [(1, "/a/b.do", "link"), (1, "/c.do", "script"), (1, "/e.do", "ajax"), (1, "/f.do", "include"), (2, "/g.do", "include"), (2, "/h.do", "popup"), (2, "/i.do", "other"), (5, "/a.do", "form"), (5, "/a.do", "link")]
    assert sorted(map(tuple, unknown.collect())) == [(1, 1, "${}/d.do"), (5, 3, "${}${}.do")]


def test_fingerprint_changes_with_a_rule(spark):
    from dataclasses import replace

    from quarrylens.operators import scan

    digest = lambda rules: spark.range(1).select(scan.fingerprint(rules)).first()[0]
    rules = list(scan.RULES)
    assert digest(rules) == digest(rules[::-1]) and len(digest(rules)) == 64
    assert digest(rules) != digest([replace(rules[0], severity="other"), *rules[1:]]) != digest(rules[1:])
