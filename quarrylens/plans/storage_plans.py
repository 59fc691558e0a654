"""What is stored and read back: footers, saved runs, text folders, counts within time, restored log lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrylens.operators import limits, metadata, sqltext
from quarrylens.plans import lineage_plans
from quarrylens.session import TABLES, shared_dir, table
from quarrylens.sources import footers, log_sql, runs, text_folder

#: Tables of flat columns with their numbers, and with their texts of which the footers keep bounds.
NUMBERS = {
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "part": ["p_partkey", "p_size", "p_retailprice"], "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"], "nation": ["n_nationkey", "n_regionkey"], "region": ["r_regionkey"], "events": ["event_id", "user_id", "value"],
    "documents": ["doc_id", "n_chars"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn"], "embeddings": ["vec_id"],
}
TEXTS = {"customer": ["c_name", "c_mktsegment"], "lineitem": ["l_returnflag", "l_linestatus"], "orders": ["o_orderstatus", "o_orderpriority"], "part": ["p_name", "p_brand", "p_type"], "events": ["event_type"], "documents": ["lang", "source"], "conversations": ["role"]}


def chunks(s, d):
    return footers.column_chunks(s, {t: f"{d}/{t}.parquet" for t in TABLES})


def statistics(s, d):
    wanted = s.createDataFrame([(t, c) for group in (NUMBERS, TEXTS) for t, cs in group.items() for c in cs], "table_name string, name string")
    return footers.column_statistics(chunks(s, d)).join(F.broadcast(wanted), ["table_name", "name"]).drop("bytes")


def footer_scope(s, d):
    """The second scope pass: empty tables are left out, by counts from footers."""
    scope = metadata.Scope(schemas=("main",), prefixes=("line",), pattern="^p.*s$", skip_empty=True)
    return footers.table_statistics(chunks(s, d)).select("table_name", "row_count", scope.reason(F.lit("main"), F.col("table_name"), F.col("row_count")).alias("reason"))


def saved_run(s, d):
    """The lineage of a run in two relations, saved together and read back."""
    store = runs.RunStore(s, f"{shared_dir(s)}/runs-{uuid.uuid4().hex}")
    store.save("first", {"crud": lineage_plans.crud(s, d), "program": lineage_plans.programs(s, d)}, {"program": {"url": 3}})
    crud, program = store.read("first", "crud"), store.read("first", "program")
    return crud.join(program, "program_id").groupBy("url", "table_name").agg(F.count("*").alias("n"))


def folder_files(s, d):
    """Every document as a file, in two encodings and with both line ends, read back."""
    text_folder.register(s)
    path = f"{shared_dir(s)}/texts-{uuid.uuid4().hex}"
    name = F.concat_ws("/", F.coalesce("lang", F.lit("und")), F.concat("doc_id", F.lit(".txt")))
    rows = table(s, d, "documents").select(name.alias("path"), "text", F.when(F.col("doc_id") % 2 == 0, "utf-8-bom").otherwise("utf-8").alias("encoding"), F.when(F.col("doc_id") % 3 == 0, "crlf").otherwise("lf").alias("eol"))
    rows.write.format("text_folder").mode("append").save(path)
    return s.read.format("text_folder").load(path).select("path", "encoding", "eol", "bytes", "truncated", F.sha2("text", 256).alias("digest"))


def log_lines(s, d):
    """Two log lines of every event, its user being the thread: errors log no values, views one too few."""
    e = table(s, d, "events").select(F.col("user_id").alias("thread"), "event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    values = F.when(F.col("event_type") == "view", F.concat("cents", F.lit("(Long)"))).otherwise(F.concat("cents", F.lit("(Long), "), F.coalesce(F.concat("event_type", F.lit("'s(String)")), F.lit("null"))))
    first = e.select("thread", (F.col("event_id") * 2).alias("seq"), F.lit("12:00 DEBUG ==>  Preparing: UPDATE stats SET v = ? WHERE k = ? AND note <> '?' ").alias("line"))
    return first.union(e.where("event_type <> 'error'").select("thread", F.col("event_id") * 2 + 1, F.concat(F.lit("12:00 DEBUG ==> Parameters: "), values)))


def statements(s, d):
    """A statement of every event, of a form by its type."""
    forms = F.when(F.col("event_type") == "error", "SELECT v FROM stats FOR SHARE OF ").when(F.col("event_type") == "view", "/* ok */ with a as (select 1) select * from a where k = ").when(F.col("event_type") == "click", "SELECT ｖ FROM stats WHERE n = ").otherwise("UPDATE stats SET v = ")
    return table(s, d, "events").select("event_id", F.concat(forms, F.col("user_id"), F.when(F.col("event_id") % 5 == 0, " ; select 2").otherwise(" ; ")).alias("sql"))


def one_statistic(t, c, number):
    bounds = f"CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, CAST(NULL AS VARCHAR) AS first, CAST(NULL AS VARCHAR) AS last" if number else f"CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), min({c}), max({c})"
    return f"SELECT '{t}' AS table_name, '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS nulls, {bounds} FROM {t}"


QUERIES = {
    "footer_statistics": (statistics, " UNION ALL ".join([one_statistic(t, c, True) for t, cs in NUMBERS.items() for c in cs] + [one_statistic(t, c, False) for t, cs in TEXTS.items() for c in cs])),
    "footer_scope": (
        footer_scope,
        "SELECT *, CASE WHEN row_count = 0 THEN 'empty' WHEN starts_with(table_name, 'line') THEN 'prefix' WHEN regexp_matches(table_name, '^p.*s$') THEN 'pattern' ELSE '' END AS reason FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES) + ")",
    ),
    "timed_counts": (
        lambda s, d: limits.counts_within(s, {t: table(s, d, t) for t in TABLES}, per_table=600, in_all=3600)[0],
        " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES),
    ),
    "saved_run": (saved_run, f"SELECT left(url, 3) AS url, table_name, count(*) AS n FROM ({lineage_plans.CRUD}) JOIN ({lineage_plans.PROGRAMS}) USING (program_id) GROUP BY ALL"),
    "text_folder": (
        folder_files,
        """WITH d AS (SELECT doc_id, coalesce(lang, 'und') || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS t FROM documents), n AS (SELECT *, len(t) - len(replace(t, chr(10), '')) AS ends FROM d)
        SELECT path, CASE WHEN doc_id % 2 = 0 THEN 'utf-8-bom' ELSE 'utf-8' END AS encoding, CASE WHEN doc_id % 3 = 0 AND ends > 0 THEN 'crlf' ELSE 'lf' END AS eol,
        CAST(octet_length(encode(t)) + CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN ends ELSE 0 END AS BIGINT) AS bytes, false AS truncated, sha256(t) AS digest FROM n""",
    ),
    "gate_events": (
        lambda s, d: sqltext.gate(statements(s, d), "sql", "event_id"),
        "SELECT event_id, event_type IN ('view', 'click') AND event_id % 5 <> 0 AS read_only FROM events",
    ),
    "log_restore": (
        lambda s, d: log_sql.restored(log_lines(s, d)),
        """WITH e AS (SELECT user_id AS thread, event_id * 2 AS seq, event_type AS t, CAST(round(value * 100) AS BIGINT) AS c, 'UPDATE stats SET v = ? WHERE k = ? AND note <> ''?''' AS sql FROM events)
        SELECT thread, seq, sql, CASE WHEN t IN ('error', 'view') THEN sql ELSE 'UPDATE stats SET v = ' || c || ' WHERE k = ''' || t || '''''s'' AND note <> ''?''' END AS restored, CASE t WHEN 'error' THEN 'parameters' WHEN 'view' THEN 'count' END AS warning FROM e""",
    ),
}
