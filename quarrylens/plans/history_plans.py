"""Run history over `events`: a day is a run, a user a file, an event type a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import history
from quarrylens.session import table

FINDINGS = """SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT) AS run_id, CAST(user_id AS VARCHAR) AS file, event_type AS rule,
  CASE WHEN event_type IN ('error', 'purchase') THEN 'core' ELSE 'web' END AS grp, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS severity, event_id FROM events"""
RUNS = "SELECT DISTINCT run_id, 'p' || (run_id % 2) AS profile, CASE WHEN run_id < 15 THEN 'a' ELSE 'b' END AS rules_hash, run_id % 9 = 0 AS changed_only FROM f"


def findings(s, d):
    e = table(s, d, "events")
    run = (F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).cast("long")
    return e.select(
        run.alias("run_id"), F.col("user_id").cast("string").alias("file"), F.col("event_type").alias("rule"),
        F.when(F.col("event_type").isin("error", "purchase"), "core").otherwise("web").alias("grp"), F.when(F.col("value") > 50, "high").otherwise("low").alias("severity"), "event_id",
    )


def runs(s, d):
    r = findings(s, d).select("run_id").distinct()
    return r.select("run_id", F.concat(F.lit("p"), F.col("run_id") % 2).alias("profile"), F.when(F.col("run_id") < 15, "a").otherwise("b").alias("rules_hash"), (F.col("run_id") % 9 == 0).alias("changed_only"))


QUERIES = {
    "trend_groups": (lambda s, d: history.trend_parts(runs(s, d), findings(s, d), "grp"), f"SELECT run_id, grp, count(*) AS cnt FROM ({FINDINGS}) WHERE run_id % 9 <> 0 GROUP BY ALL"),
    "trend_severities": (lambda s, d: history.trend_parts(runs(s, d), findings(s, d), "severity"), f"SELECT run_id, severity, count(*) AS cnt FROM ({FINDINGS}) WHERE run_id % 9 <> 0 GROUP BY ALL"),
    "run_counts": (lambda s, d: history.run_counts(findings(s, d)), f"SELECT run_id, grp, severity, count(*) AS cnt FROM ({FINDINGS}) GROUP BY ALL"),
    "run_trend": (
        lambda s, d: history.trend(runs(s, d), findings(s, d)),
        f"""WITH f AS ({FINDINGS}), r AS ({RUNS}), p AS (SELECT *, lag(run_id) OVER w AS prev, lag(rules_hash) OVER w AS prev_hash FROM r WHERE NOT changed_only WINDOW w AS (PARTITION BY profile ORDER BY run_id)),
        bag AS (SELECT run_id, file, rule, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT run_id, count(*) AS total FROM f GROUP BY ALL),
        a AS (SELECT p.run_id, file, rule, n FROM p JOIN bag USING (run_id)), b AS (SELECT p.run_id, file, rule, n FROM p JOIN bag ON bag.run_id = p.prev),
        j AS (SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.run_id = b.run_id AND a.file = b.file AND a.rule = b.rule),
        m AS (SELECT run_id, sum(greatest(y - x, 0)) AS fixed, sum(greatest(x - y, 0)) AS added FROM j GROUP BY ALL)
        SELECT p.run_id, coalesce(total, 0) AS total, CASE WHEN prev IS NOT NULL AND prev_hash = rules_hash THEN CAST(coalesce(fixed, 0) AS BIGINT) END AS fixed,
          CASE WHEN prev IS NOT NULL AND prev_hash = rules_hash THEN CAST(coalesce(added, 0) AS BIGINT) END AS added FROM p LEFT JOIN t USING (run_id) LEFT JOIN m USING (run_id)""",
    ),
    "recent_runs": (
        lambda s, d: history.run_counts(findings(s, d)).groupBy("run_id").agg(F.sum("cnt").alias("total")).orderBy(F.desc("run_id")).limit(20),
        f"SELECT run_id, count(*) AS total FROM ({FINDINGS}) GROUP BY 1 ORDER BY run_id DESC LIMIT 20",
    ),
    "folder_rollup": (
        lambda s, d: history.folder_rollup(table(s, d, "pages").withColumn("p", F.regexp_replace("url", "^[a-z]+://", "")), "p", 2, F.col("page_id") % 2 == 0, F.col("page_id") % 2 == 1),
        """WITH p AS (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS x, page_id FROM pages), q AS (SELECT CASE WHEN len(x) <= 1 THEN '(root)' ELSE array_to_string(x[1:least(2, len(x) - 1)], '/') END AS folder, page_id FROM p)
        SELECT folder, count(*) FILTER (WHERE page_id % 2 = 0) AS now, count(*) FILTER (WHERE page_id % 2 = 1) AS before FROM q GROUP BY 1""",
    ),
    "baseline_diff": (
        lambda s, d: history.baseline_diff(findings(s, d).where("run_id > 15"), findings(s, d).where("run_id <= 15"), "file", "rule"),
        f"""WITH f AS ({FINDINGS}), a AS (SELECT file, rule, count(*) AS n FROM f WHERE run_id > 15 GROUP BY ALL), b AS (SELECT file, rule, count(*) AS n FROM f WHERE run_id <= 15 GROUP BY ALL),
        j AS (SELECT coalesce(a.file, b.file) AS file, coalesce(a.rule, b.rule) AS rule, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.file = b.file AND a.rule = b.rule)
        SELECT file, rule, greatest(x - y, 0) AS fresh, least(x, y) AS hidden, greatest(y - x, 0) AS stale FROM j""",
    ),
    "numbered_findings": (
        lambda s, d: history.numbered(findings(s, d), "run_id", "file", "rule", order="event_id").select("event_id", "occurrence"),
        f"SELECT event_id, CAST(row_number() OVER (PARTITION BY run_id, file, rule ORDER BY event_id) AS INTEGER) AS occurrence FROM ({FINDINGS})",
    ),
}
