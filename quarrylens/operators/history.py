"""Run history: finding counts, trends between runs, folder roll-ups and baselines.

Findings are rows (run_id, file, rule, ...). Runs compare as multisets of (file, rule): counts are grouped before
they are joined, so a shuffle carries distinct keys only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.text import folder_at


def run_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("run_id", "grp", "severity").agg(F.count("*").alias("cnt"))


def trend(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """run_id, total, fixed, added: against the previous run of the same profile that is not changed-only; both null for the first run and where the rules' hash changed.

    runs: run_id, profile, rules_hash, changed_only. One row a run is windowed, never findings.
    """
    plotted = runs.where(~F.col("changed_only"))
    w = Window.partitionBy("profile").orderBy("run_id")
    plotted = plotted.withColumns({"prev": F.lag("run_id").over(w), "prev_hash": F.lag("rules_hash").over(w)})
    bag = findings.groupBy("run_id", "file", "rule").agg(F.count("*").alias("n"))
    totals = bag.groupBy("run_id").agg(F.sum("n").alias("total"))
    now = plotted.select("run_id", "prev").join(bag, "run_id").select(F.col("run_id"), "file", "rule", F.col("n").alias("now"), F.lit(0).cast("long").alias("before"))
    before = plotted.where("prev is not null").select("run_id", "prev").join(bag.withColumnRenamed("run_id", "prev"), "prev").select("run_id", "file", "rule", F.lit(0).cast("long").alias("now"), F.col("n").alias("before"))
    moved = now.union(before).groupBy("run_id", "file", "rule").agg(F.sum("now").alias("now"), F.sum("before").alias("before"))
    moved = moved.groupBy("run_id").agg(F.sum(F.greatest(F.col("before") - F.col("now"), F.lit(0))).alias("fixed"), F.sum(F.greatest(F.col("now") - F.col("before"), F.lit(0))).alias("added"))
    comparable = F.col("prev").isNotNull() & F.col("prev_hash").eqNullSafe(F.col("rules_hash"))
    out = plotted.join(totals, "run_id", "left").join(moved, "run_id", "left")
    value = lambda c: F.when(comparable, F.coalesce(c, F.lit(0)))
    return out.select("run_id", F.coalesce("total", F.lit(0)).alias("total"), value(F.col("fixed")).alias("fixed"), value(F.col("added")).alias("added"))


def trend_parts(runs: DataFrame, findings: DataFrame, part: str) -> DataFrame:
    """run_id, part, cnt of the runs that a trend plots: its points by group, by severity or by another column."""
    plotted = runs.where(~F.col("changed_only")).select("run_id")
    return findings.groupBy("run_id", part).agg(F.count("*").alias("cnt")).join(plotted, "run_id", "left_semi")


def folder_rollup(findings: DataFrame, path: str, depth: int, now: Column, before: Column) -> DataFrame:
    return findings.groupBy(folder_at(F.col(path), depth).alias("folder")).agg(F.count_if(now).alias("now"), F.count_if(before).alias("before"))


def numbered(findings: DataFrame, *keys: str, order: str) -> DataFrame:
    """Equal keys numbered in input order, so that a multiset becomes a set: key#1, key#2, ..."""
    w = Window.partitionBy(*keys).orderBy(order)
    return findings.withColumn("occurrence", F.row_number().over(w))


def baseline_diff(findings: DataFrame, baseline: DataFrame, *keys: str) -> DataFrame:
    """Per key: fresh (beyond the baseline), hidden (in both) and stale (only in the baseline) occurrences."""
    now = findings.groupBy(*keys).agg(F.count("*").alias("now"))
    old = baseline.groupBy(*keys).agg(F.count("*").alias("old"))
    both = now.join(old, list(keys), "full_outer").fillna(0, ["now", "old"])
    zero = F.lit(0).cast("long")
    return both.select(
        *keys,
        F.greatest(F.col("now") - F.col("old"), zero).alias("fresh"),
        F.least("now", "old").alias("hidden"),
        F.greatest(F.col("old") - F.col("now"), zero).alias("stale"),
    )
