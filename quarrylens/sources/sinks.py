"""Writers: run histories, replaced partitions, CSV, baselines. All go through Spark's own committers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_run(df: DataFrame, path: str, run: str = "run_id") -> None:
    """A run's rows beside those of earlier runs, one folder a run, so that a run reads without the others. Excerpts of the texts are not kept."""
    df.drop("excerpt").write.mode("append").partitionBy(run).parquet(path)


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """The partitions that df has rows of are replaced as a whole; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def cut_to_width(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """df with its texts cut to the widths of a store's columns."""
    return df.withColumns({c: F.substring(c, 1, n) for c, n in widths.items()})


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files of quoted cells with a byte order mark and a header each, lines ended by CR LF; null is an empty cell."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    header = "\ufeff" + ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([header])], ["line"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["line"])

    lines = df.select(F.concat_ws(",", *(quoted(F.col(f"`{c}`").cast("string")) for c in df.columns)).alias("line"))
    lines.mapInArrow(run, "line string").write.option("lineSep", "\r\n").text(path)


def write_baseline(df: DataFrame, key: str, path: str) -> None:
    """Distinct keys in order, one a line."""
    df.select(df[key].cast("string").alias("value")).distinct().orderBy("value").write.text(path)


def read_baseline(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", key)
