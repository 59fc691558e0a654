"""Ad-hoc reads behind the read-only gate, and probes that analyse a statement without running it."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from quarrylens.operators.sqltext import read_only


def select(spark: SparkSession, sql: str, args: dict | None = None, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The first `most` rows of a statement, and a frame of one row that says whether there are more. Binds are named parameters."""
    if not read_only(sql):
        raise ValueError("only one SELECT statement without writing or locking words is taken")
    found = spark.sql(sql, args=args or {}).limit(most + 1)
    return found.limit(most), found.selectExpr(f"count(*) > {most} AS truncated")


def probe(spark: SparkSession, sql: str) -> str:
    """PASS if a statement's tables and columns are known, ERROR if not, SKIP if the gate refuses it. Nothing is run."""
    if not read_only(sql):
        return "SKIP"
    try:
        spark.sql(f"SELECT 1 FROM ({sql}) WHERE 1 = 0").schema  # noqa: B018
    except (AnalysisException, ParseException):
        return "ERROR"
    return "PASS"
