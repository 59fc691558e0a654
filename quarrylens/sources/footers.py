"""Statistics of Parquet tables from their footers: no row is read. Files are dealt to tasks, each opens its files' footers only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "table_name string, file string, row_group int, rows long, name string, nulls long, low double, high double, first string, last string, bytes long"


def column_chunks(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One row for each column of each row group of the tables (name -> path): rows, nulls (null if the file does not say),
    low and high of numbers, first and last of texts, compressed bytes. Nested columns come by their dotted leaf names.

    Spark lists the files; tasks open them by their address through Arrow's file systems (local, HDFS, S3, GCS)."""
    files = [(t, f) for t, path in paths.items() for f in spark.read.parquet(path).inputFiles()]
    rows = spark.createDataFrame(files, "table_name string, file string")
    names = [f.split(" ")[0] for f in CHUNKS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import unquote

        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            for t, address in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), unquote(address.removeprefix("file:")))
                with store.open_input_file(path) as f:
                    meta = pq.ParquetFile(f).metadata
                out = []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        chunk = group.column(c)
                        s = chunk.statistics
                        low, high = (s.min, s.max) if s is not None and s.has_min_max else (None, None)
                        number = isinstance(low, (int, float)) and not isinstance(low, bool)
                        text = isinstance(low, str)
                        nulls = s.null_count if s is not None and s.has_null_count else None
                        out.append((t, address, g, group.num_rows, chunk.path_in_schema, nulls, float(low) if number else None, float(high) if number else None, low if text else None, high if text else None, chunk.total_compressed_size))
                if out:
                    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    return rows.repartition(min(max(len(files), 1), spark.sparkContext.defaultParallelism * 4), "file").mapInArrow(read, CHUNKS)


def column_statistics(chunks: DataFrame) -> DataFrame:
    """table_name, name, rows, nulls, low, high, first, last, bytes of each column; a count or bound that any part does not know is null."""
    sure = lambda of, c: F.when(F.count(F.when((F.col("rows") > F.coalesce("nulls", F.lit(0))) & F.col(c).isNull(), 1)) == 0, of(c))
    known = F.when(F.count("nulls") == F.count("*"), F.sum("nulls"))
    return chunks.groupBy("table_name", "name").agg(F.sum("rows").alias("rows"), known.alias("nulls"), sure(F.min, "low").alias("low"), sure(F.max, "high").alias("high"), sure(F.min, "first").alias("first"), sure(F.max, "last").alias("last"), F.sum("bytes").alias("bytes"))


def table_statistics(chunks: DataFrame) -> DataFrame:
    """table_name, row_count and bytes of each table, from any one of its columns' rows and all columns' bytes."""
    groups = chunks.groupBy("table_name", "file", "row_group").agg(F.max("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    return groups.groupBy("table_name").agg(F.sum("rows").alias("row_count"), F.sum("bytes").alias("bytes"))
