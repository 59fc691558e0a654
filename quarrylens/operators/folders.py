"""Folder diffs and file checks over corpus rows (path, text or content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folder_diff(a: DataFrame, b: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, status (ONLY_A, ONLY_B, SAME, DIFF): sizes and digests are joined, never contents."""
    side = lambda df, x: df.select(path, F.octet_length(content).alias(f"size_{x}"), F.sha2(F.col(content).cast("binary"), 256).alias(f"sha_{x}"))
    both = side(a, "a").join(side(b, "b"), path, "full_outer")
    status = F.when(F.col("sha_b").isNull(), "ONLY_A").when(F.col("sha_a").isNull(), "ONLY_B").when((F.col("size_a") == F.col("size_b")) & (F.col("sha_a") == F.col("sha_b")), "SAME").otherwise("DIFF")
    return both.select(F.col(path).alias("path"), status.alias("status"))


def language_of(text: Column) -> Column:
    """xml, jsp, java, ts or js, by what a text begins with and holds."""
    head = F.ltrim(F.coalesce(text, F.lit("")))
    return (
        F.when(head.startswith("<?xml") | head.contains("<mapper"), "xml")
        .when(head.contains("<%") | head.contains("<c:") | (head.startswith("<") & head.contains("${")), "jsp")
        .when(head.rlike(r"(?m)^\s*(?:package\s+[\w.]+;|import\s+[\w.*]+;|(?:public|private|protected|abstract|final)\s+(?:class|interface|enum|@interface|record)\b)"), "java")
        .when(head.rlike(r"(?m)^\s*import\s+type\b|^\s*(?:export\s+)?interface\s+\w+") | head.contains(": string") | head.contains(": number"), "ts")
        .otherwise("js")
    )


def file_checks(corpus: DataFrame, encoding: str = "utf-8", eol: str = "lf", header: str = "", header_lines: int = 20) -> DataFrame:
    """path, rule: texts beyond ASCII in another encoding, other line ends, lines indented by tabs beside lines indented by spaces, and texts without the header in their first lines (if a pattern is given)."""
    text = F.col("text")
    tests = {
        "encoding": text.rlike(r"[^\x00-\x7F]") & (F.lower("encoding") != encoding),
        "lineEnding": text.contains("\n") & (F.lower("eol") != eol),
        "mixedIndent": text.rlike(r"(?m)^\t") & text.rlike(r"(?m)^  +\S"),
    }
    if header:
        tests["header"] = ~F.substring_index(text, "\n", header_lines).rlike(header)
    return corpus.select("path", F.explode(F.array_compact(F.array(*(F.when(t, name) for name, t in tests.items())))).alias("rule"))
