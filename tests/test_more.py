import pytest
from pyspark.sql import functions as F

from quarrylens import session
from quarrylens.operators import adhoc, comments, folders, inputs, lineage, metadata, scan, sqltext
from quarrylens.sources import sinks, text_files


def test_sinks(spark, tmp_path):
    runs = spark.createDataFrame([(1, "a"), (2, "b")], "run_id int, file string")
    for run in (1, 2):
        sinks.append_run(runs.where(F.col("run_id") == run), str(tmp_path / "h"))
    sinks.replace_partitions(spark.createDataFrame([("c", 2)], "file string, run_id int"), str(tmp_path / "h"), "run_id")
    assert sorted((r.run_id, r.file) for r in spark.read.parquet(str(tmp_path / "h")).collect()) == [(1, "a"), (2, "c")]
    sinks.write_baseline(runs.union(runs), "file", str(tmp_path / "b"))
    assert [r.k for r in sinks.read_baseline(spark, str(tmp_path / "b"), "k").collect()] == ["a", "b"]
    sinks.write_csv(runs.withColumn("file", F.lit('q"x,')), str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first().file == 'q"x,'


def test_adhoc(spark):
    rows, more = adhoc.select(spark, "SELECT id FROM range(10) WHERE id >= :low", {"low": 3}, most=5)
    assert rows.count() == 5 and more.first().truncated
    with pytest.raises(ValueError):
        adhoc.select(spark, "DROP TABLE x")
    assert [adhoc.probe(spark, q) for q in ("SELECT id FROM range(3)", "SELECT nope FROM range(3)", "DELETE FROM x")] == ["PASS", "ERROR", "SKIP"]


def test_gate_and_lint(spark):
    assert sqltext.read_only("select 1") and sqltext.read_only("WITH a AS (SELECT 1) SELECT * FROM a")
    for bad in ("select 1; drop table t", "update t set a = 1", "select * from t for update", "select /*! x */ 1", "select 1 /* open", "", None, "select * into x from y"):
        assert not sqltext.read_only(bad)
    for bad in ("select * from t for share", "ｓｅｌｅｃｔ 1", "select 'drop' from t", "select 1; select 2", "select /* a /* b */ */ 1", "select 1 waitfor delay '1'", "selection", "select 1 ｉｎｔｏ x", "select 𝐢𝐧𝐭𝐨 y", "select 1 reﬆore", "select a ﬁ, diﬅab, ⓓⓡⓞⓟ", "select 1 for update share", "/*m! x */ select 1", "--x"):
        assert not sqltext.read_only(bad)
    assert sqltext.read_only("select 'ﬁ é 한글 🙂' as x, forshare, share from intox") and sqltext.read_only("/* a */ select 1 ;; ") and sqltext.read_only("-- x\nwith a as (select 1) select * from a")
    assert sqltext.lint("select * from a cross join b") == [] and sqltext.lint("insert into t (a) values (1)") == []  # a cross join that is spelt out is meant
    assert sqltext.lint("select * from a, b") == ["crossJoin"] and sqltext.lint("select * from a join b where a.x = b.x") == []
    assert sqltext.lint("update t set a = 1, b = null") == [] and sqltext.lint("delete from t where a = null") == ["nullCompare"]


def test_comments():
    assert comments.blanked('a = "//x"; // y\n/* z */b', "java") == 'a = "//x";     \n       b'
    assert comments.blanked("select '--' -- x\n1", "sql") == "select '--'     \n1"
    assert comments.blanked("k=v # no\n# yes", "properties") == "k=v # no\n     "
    assert comments.blanked("a: '#' # c", "yaml") == "a: '#'    " and comments.blanked(None, "java") is None


def test_csv_with_mark(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, None), (2, 'a"b\n')], "n int, t string").coalesce(1), str(tmp_path / "m"))
    data = next((tmp_path / "m").glob("part-*")).read_bytes().decode()
    assert data == '﻿"n","t"\r\n"1",""\r\n"2","a""b\n"\r\n'


def test_large_files_are_told(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("short")
    (tmp_path / "b.txt").write_text("long" * 10)
    monkeypatch.setattr(text_files, "MOST_BYTES", 20)
    assert {(r.path[-5:], r.text, r.encoding) for r in text_files.read_texts(spark, str(tmp_path)).collect()} == {("a.txt", "short", "utf-8"), ("b.txt", None, "too-large")}


def test_snapshot_readers(spark):
    tables = spark.createDataFrame([("B", "T"), ("A", "T"), ("A", "U")], "schema_name string, table_name string")
    columns = spark.createDataFrame([("A", "T", 2, "y", "INT"), ("A", "T", 1, "x", "CHAR"), ("B", "T", 1, "z", "INT")], "schema_name string, table_name string, ordinal int, name string, native_type string")
    constraints = spark.createDataFrame([("A", "T", "PK", "P", ["x"])], "schema_name string, table_name string, kind string, name string, columns array<string>")
    rows = inputs.nested_tables(tables, columns, constraints, name="T").collect()
    assert [(r.schema_name, [c.name for c in r.columns], r.constraints[0].columns) for r in rows] == [("A", ["x", "y"], ["x"])]
    assert {(r.schema_name, r.table_name) for r in inputs.nested_tables(tables, columns, constraints).collect()} == {("A", "T"), ("A", "U"), ("B", "T")}
    listed = columns.selectExpr("schema_name as owner", "table_name", "name", "ordinal", "native_type", "cast(null as bigint) as length", "9 as precision", "2 as scale", "name = 'y' as nullable")
    found = inputs.snapshot_inputs(listed, constraints.selectExpr("schema_name as owner", "table_name", "columns"))
    assert {(r.name, r.length, r.scale, r.pk, r.not_null) for r in found.collect()} == {("x", "9", "2", "Y", "Y"), ("y", "9", "2", "N", "N"), ("z", "9", "2", "N", "Y")}
    scope = metadata.Scope(prefixes=("TB_",), skip_empty=True)
    assert inputs.scope_summary(scope) == "prefix TB_; without empty tables" and inputs.is_filtered(scope) and not inputs.is_filtered(metadata.Scope())


def test_matrix_of_its_own_tables(spark):
    crud = spark.createDataFrame([("p", "B", "RC"), ("p", "A", "U"), ("q", "B", "D")], "program_id string, table_name string, crud string")
    found = lineage.crud_matrix(crud, "program_id")
    assert found.columns == ["program_id", "a", "b"] and sorted(map(tuple, found.collect())) == [("p", "U", "CR"), ("q", "", "D")]
    with pytest.raises(ValueError):
        lineage.crud_matrix(crud, "program_id", most=1)


def test_scratch_tables(spark):
    kept = session.scratch(spark, spark.range(3), "x")
    assert kept.count() == 3 and session.drop_scratch(spark) > 0 and session.drop_scratch(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0]).count()


def test_file_header(spark):
    df = spark.createDataFrame([("a", "# owner x\ny", "utf-8", "lf"), ("b", "y\n" * 30 + "# owner", "utf-8", "lf"), ("c", "", "utf-8", "lf")], "path string, text string, encoding string, eol string")
    assert sorted(map(tuple, folders.file_checks(df, header="# owner").collect())) == [("b", "header"), ("c", "header")]


def test_paths_of_rules(spark):
    rule = scan.Rule("r", "x", globs=("*.jsp", "*.html"))
    df = spark.createDataFrame([("a.JSP", "x"), ("b.txt", "x"), ("c.html", "y\nx")], "path string, text string")
    assert {(r.path, r.line) for r in scan.line_rules(df, (rule,)).collect()} == {("a.JSP", 1), ("c.html", 2)}
    assert scan.line_rules(df.limit(0), (rule,)).count() == 0
