"""Text and CSV files of mixed encodings as rows. Spark lists and reads the files; decoding runs in Arrow batches,
since Spark SQL knows neither MS949 nor a byte order mark's rule."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 10 * 1024 * 1024
SKIPPED = (".git", "target", "node_modules")
DELIMITERS = (",", "\t", ";", "|")


def decode(data: bytes) -> tuple[str, str, str]:
    """(text, encoding, line end): a byte order mark, else strict UTF-8, else MS949; line ends evened to \\n, the commoner kept as the name."""
    if data.startswith(b"\xef\xbb\xbf"):
        text, encoding = data[3:].decode("utf-8", "replace"), "utf-8-bom"
    else:
        try:
            text, encoding = data.decode("utf-8"), "utf-8"
        except UnicodeDecodeError:
            text, encoding = data.decode("cp949", "replace"), "ms949"
    windows = text.count("\r\n")
    eol = "crlf" if windows * 2 > text.count("\n") else "lf"
    return text.replace("\r\n", "\n").replace("\r", "\n"), encoding, eol


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: ** for any folders, * and ? within a name."""
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def path_filter(path: Column, include: list[str], exclude: list[str]) -> Column:
    keep = F.lit(not include)
    for g in include:
        keep = keep | path.rlike(glob_pattern(g))
    for g in [*exclude, *(f"**/{s}/**" for s in SKIPPED)]:
        keep = keep & ~path.rlike(glob_pattern(g))
    return keep


def read_texts(spark: SparkSession, folder: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """path, text, encoding, eol of every file. One of over MOST_BYTES has a null text and the encoding `too-large`: its content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where(path_filter(F.col("path"), include or [], exclude or []))
    large = files.where(F.col("length") > MOST_BYTES).select("path", F.lit(None).cast("string").alias("text"), F.lit("too-large").alias("encoding"), F.lit(None).cast("string").alias("eol"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode(x.as_py()) for x in batch.column(1)]
            columns = [pa.array([f[k] for f in found], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["path", "text", "encoding", "eol"])

    small = files.where(F.col("length") <= MOST_BYTES).select("path", "content")
    return small.mapInArrow(run, "path string, text string, encoding string, eol string").union(large)


def delimiter_of(text: str) -> str:
    """The commonest delimiter outside quotes in the first five lines; of equals the first listed."""
    plain = re.sub(r'"(?:[^"]|"")*"', "", text)
    head = "\n".join(plain.split("\n")[:5])
    return max(DELIMITERS, key=lambda d: (head.count(d), -DELIMITERS.index(d)))


def parse_csv(text: str, delimiter: str | None = None) -> list[list[str]]:
    """Rows of a CSV text: doubled quotes, no carriage returns, no byte order mark, blank rows left out."""
    text = text.lstrip("﻿").replace("\r", "")
    rows = csv.reader(io.StringIO(text), delimiter=delimiter or delimiter_of(text))
    return [r for r in rows if any(x.strip() for x in r)]


def column_at(header: list[str], names: list[str]) -> int:
    """Where a header has one of the names: exactly if it can, else within it; -1 if nowhere."""
    low = [h.strip().lower() for h in header]
    exact = next((low.index(n.lower()) for n in names if n.lower() in low), -1)
    return exact if exact >= 0 else next((i for n in names for i, h in enumerate(low) if n.lower() in h), -1)


def read_csvs(spark: SparkSession, folder: str) -> DataFrame:
    """path, row (from 0, the header's row being 0), cells of every CSV file under a folder."""
    rows = read_texts(spark, folder, ["**/*.csv"]).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = parse_csv(text)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.list_(pa.string()))], ["path", "row", "cells"])

    return rows.select("path", "text").mapInArrow(run, "path string, row long, cells array<string>")
