"""Time limits, footers, saved runs, the text folder source."""

import time

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import limits
from quarrylens.sources import footers, runs, text_folder


def slow(spark, seconds):
    return spark.range(8).repartition(4).where(F.expr(f"java_method('java.lang.Thread', 'sleep', cast({int(seconds * 1000)} as bigint)) is null"))


def test_slow_counts_are_unknown_and_their_jobs_gone(spark):
    spark.range(1).count()
    tables = {"fast": spark.range(7), "slow": slow(spark, 12), "known": slow(spark, 12), "broken": spark.range(1).where("raise_error('x') is null"), "last": spark.range(3)}
    began = time.monotonic()
    counts, warnings = limits.counts_within(spark, tables, {"known": 5}, per_table=3)
    assert dict(map(tuple, counts.collect())) == {"fast": 7, "slow": None, "known": 5, "broken": None, "last": 3}
    warned = dict(map(tuple, warnings.collect()))
    assert warned.pop("time") == 1 and list(warned.values()) == [1]
    assert time.monotonic() - began < 30
    deadline = time.monotonic() + 20
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.monotonic() < deadline:
        time.sleep(0.1)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    assert not spark.sparkContext.getJobTags()


def test_whole_time(spark):
    counts, warnings = limits.counts_within(spark, {"a": spark.range(1), "b": spark.range(1)}, in_all=0)
    assert [tuple(r) for r in counts.orderBy("table_name").collect()] == [("a", None), ("b", None)]
    assert [tuple(r) for r in warnings.collect()] == [("skipped", 2)]
    assert limits.counts_within(spark, {})[0].count() == 0


def test_select_within(spark):
    rows, more = limits.select_within(spark, "select id from range(10) where id >= :least", {"least": 3}, most=5)
    assert [r.id for r in rows] == [3, 4, 5, 6, 7] and more
    assert limits.select_within(spark, "select 1 as x", most=5)[1] is False
    with pytest.raises(ValueError):
        limits.select_within(spark, "drop table x")
    with pytest.raises(limits.OutOfTime):
        limits.select_within(spark, "select id from range(2) where java_method('java.lang.Thread', 'sleep', cast(12000 as bigint)) is null", seconds=1)
    with pytest.raises(Exception, match="nowhere"):
        limits.select_within(spark, "select * from nowhere")


def test_footers(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") * 0.5).alias("x"), F.lit(None).cast("string").alias("none"), F.concat(F.lit("t"), "id").alias("t"), F.struct(F.col("id").alias("in")).alias("s"))
    df.repartition(3).write.option("parquet.block.size", "2048").parquet(str(tmp_path / "a b"))
    df.limit(0).write.parquet(str(tmp_path / "empty"))
    chunks = footers.column_chunks(spark, {"a": str(tmp_path / "a b"), "empty": str(tmp_path / "empty")})
    got = {(r.table_name, r.name): r for r in footers.column_statistics(chunks).collect()}
    assert (got["a", "id"].rows, got["a", "id"].nulls, got["a", "id"].low, got["a", "id"].high) == (1000, 0, 0.0, 999.0)
    assert (got["a", "x"].nulls, got["a", "x"].low, got["a", "x"].high) == (334, 0.5, 499.0)
    assert (got["a", "none"].nulls, got["a", "none"].first, got["a", "none"].low) == (1000, None, None)
    assert (got["a", "t"].first, got["a", "t"].last) == ("t0", "t999")
    assert got["a", "s.in"].high == 999.0 and got["a", "id"].bytes > 0
    assert {r.table_name: r.row_count for r in footers.table_statistics(chunks).collect()}["a"] == 1000


def test_runs_are_whole_or_absent(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "store"))
    assert store.runs() == [] and store.sweep() == 0
    a, b = spark.range(5).selectExpr("id", "'abcdef' as t"), spark.range(3)
    store.save("one", {"a": a, "b": b}, {"a": {"t": 4}})
    assert {r.t for r in store.read("one", "a").collect()} == {"abcd"} and store.read("one", "b").count() == 3
    broken = spark.range(2).selectExpr("raise_error('killed') as e")
    for relations, most in (({"a": a, "b": broken}, None), ({"b": b, "a": a}, 4)):
        with pytest.raises(Exception, match="killed|rows"):
            store.save("two", relations, most_rows=most)
    with pytest.raises(FileExistsError):
        store.save("one", {"a": b})
    assert [(r.run_id, r.relations) for r in store.runs()] == [("one", {"a": 5, "b": 3})]
    assert len(list((tmp_path / "store" / "staged").iterdir())) == 1
    with pytest.raises(KeyError):
        store.read("two", "a")
    b.write.parquet(str(tmp_path / "store" / "staged" / "killed" / "b"))  # as a killed driver leaves it
    assert [r.run_id for r in store.runs()] == ["one"]
    assert store.sweep() == 0 and store.sweep(older_than=-5) == 1
    store.save("two", {"b": b})
    store.remove("one")
    assert [r.run_id for r in store.runs()] == ["two"]
    with pytest.raises(ValueError):
        store.save("../x", {"b": b})


def test_text_folder(spark, tmp_path):
    text_folder.register(spark)
    rows = [("a/한글.txt", "가나다\n라\n", "ms949", "crlf"), ("b.txt", "é漢🙂\r\nx", "utf-8", "lf"), ("c/d/e.sql", "x\ny\n", "utf-8-bom", "crlf"), ("empty", None, "utf-8", "lf")]
    df = spark.createDataFrame(rows, "path string, text string, encoding string, eol string").withColumn("more", F.lit(1)).repartition(3)
    out = str(tmp_path / "out")
    df.write.format("text_folder").mode("append").save(out)
    read = lambda **o: {r.path: r for r in spark.read.format("text_folder").options(**o).load(out).collect()}
    got = read()
    assert {k: (r.text, r.encoding, r.eol) for k, r in got.items()} == {"a/한글.txt": ("가나다\n라\n", "ms949", "crlf"), "b.txt": ("é漢🙂\nx", "utf-8", "lf"), "c/d/e.sql": ("x\ny\n", "utf-8-bom", "crlf"), "empty": ("", "utf-8", "lf")}
    assert (tmp_path / "out" / "a" / "한글.txt").read_bytes() == "가나다\r\n라\r\n".encode("cp949")
    assert (tmp_path / "out" / "c" / "d" / "e.sql").read_bytes() == b"\xef\xbb\xbfx\r\ny\r\n"
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".staging")]
    assert set(read(include="*.sql,**/*.txt")) == {"a/한글.txt", "b.txt", "c/d/e.sql"} and set(read(exclude="**/*.txt, empty")) == {"c/d/e.sql"}
    short = read(mostBytes=5)
    assert (short["b.txt"].text, short["b.txt"].truncated, short["b.txt"].bytes) == ("é漢", True, 11) and not short["empty"].truncated
    assert short["a/한글.txt"].text == "가나" and {r.path for r in read(mostFiles=2).values()} == {"a/한글.txt", "b.txt", None} and read(mostFiles=2)[None].truncated
    assert spark.read.format("text_folder").option("partitionBytes", 1).load(out).rdd.getNumPartitions() == 4
    df.write.format("text_folder").mode("append").save(out)  # its own folder may be written again
    assert set(read()) == set(got)


@pytest.mark.parametrize("row", [("../x", "a", "utf-8", "lf"), ("/x", "a", "utf-8", "lf"), ("", "a", "utf-8", "lf"), (None, "a", "utf-8", "lf"), ("x", "é", "ms949", "lf"), ("x", "a", "utf-16", "lf"), ("x", "a", "utf-8", "cr"), ("C:/x", "a", "utf-8", "lf")])
def test_text_folder_writes_all_or_nothing(spark, tmp_path, row):
    text_folder.register(spark)
    out = tmp_path / "out"
    df = spark.createDataFrame([("good", "a", "utf-8", "lf"), row], "path string, text string, encoding string, eol string").repartition(2)
    with pytest.raises(Exception, match="relative path|encoding|encode"):
        df.write.format("text_folder").mode("append").save(str(out))
    assert not out.exists() or all(p.name.startswith(".staging") for p in out.iterdir())  # a task that is killed late may leave its staging
    assert not out.exists() or spark.read.format("text_folder").load(str(out)).count() == 0


def test_text_folder_leaves_strangers_alone(spark, tmp_path):
    text_folder.register(spark)
    (tmp_path / "mine").write_text("x")
    df = spark.createDataFrame([("a", "a", "utf-8", "lf")], "path string, text string, encoding string, eol string")
    with pytest.raises(Exception, match="has not written"):
        df.write.format("text_folder").mode("append").save(str(tmp_path))
    two = df.union(df)
    with pytest.raises(Exception, match="two rows"):
        two.write.format("text_folder").mode("append").save(str(tmp_path / "new"))
